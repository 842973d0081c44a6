"""Pieces shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Word separators of all contracts: 0x20 and 0x09-0x0D, which bytes.split() uses too.
SPACE_CLASS = r"[\x20\x09-\x0D]"


#: Bytes of rows that travel to a Python worker at a time, one row at least.
BATCH_BYTES = 8_000_000


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the input folder."""
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers by bytes, in this session: ten thousand rows of long texts would fill memory on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 0) != BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def spread(df: DataFrame, most_bytes: int = 64_000_000) -> DataFrame:
    """A small table in fewer files than there are cores is dealt to all cores; any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a session on one machine uses a temporary folder; on
    a cluster there is nothing that executors could see, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="inkfold-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_RESIDENT: dict[str, object] = {}


def resident(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks: one object, made anew when another one is asked for. Workers serve many stages; only the last one's tables stay in memory."""
    if name not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[name] = make()
    return _RESIDENT[name]


def released() -> None:
    """Gives freed memory back to the system: a worker that has done with a task waits for others with what it kept."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library


def dropped(df: DataFrame) -> None:
    """Deletes a table of `stored` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (id, text), under fixed names, so that clashing extra columns cannot interfere."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def with_maybe(rows: DataFrame, id_col: str, ids: DataFrame, most_bytes: int = 64_000_000) -> DataFrame:
    """Adds __maybe: false only for rows whose id is surely not among ids (one column, id).

    A bitmap of hashed ids, 16 bits for each, is broadcast; beyond most_bytes
    none is made and __maybe is true for all rows. So an exact join needs to
    shuffle only the rows that may be in it.
    """
    bits = max(1 << 20, 16 * ids.count())
    if bits // 8 > most_bytes:
        return rows.withColumn("__maybe", F.lit(True))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(bits))
    maps = ids.select(place("id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__map"))
    at = F.bitmap_bit_position(place(id_col))
    byte = F.conv(F.hex(F.substring("__map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (at % 8).cast("int")) == 1
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(id_col)) == F.col("__bucket"), "left")
    return joined.withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("__bucket", "__map")


def map_texts(
    docs: DataFrame,
    fn: Callable[[list[bytes | None]], dict[str, list]],
    fields: list[T.StructField],
    text_col: str = "text",
    piece: int = 2000,
    piece_bytes: int = 4_000_000,
) -> DataFrame:
    """Adds columns computed from whole texts, batch by batch, through Arrow.

    fn takes UTF-8 texts (None for null) and returns a list for each field.
    Batches are cut to `piece` rows or about `piece_bytes` bytes (one text at
    least), so memory stays bounded whatever the batch size of the session.
    The text column itself is not returned. Columns named like a new field
    are replaced by it.
    """
    small_batches(docs.sparkSession)
    fresh = {f.name.lower() for f in fields}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c == text_col or c.lower() not in fresh))
    keep = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*keep, *fields])
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index(text_col), piece, piece_bytes):
                at = batch.schema.get_field_index(text_col)
                column = batch.column(at)
                texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
                made = fn(texts)
                kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
                arrays = [*kept, *(pa.array(made[n], k) for n, k in zip(names, kinds, strict=True))]
                del texts, made
                yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in keep), *names])
                del batch, column, kept, arrays
        released()

    return docs.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, at: int, piece: int, piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows and bytes of its text column."""
    start, total = 0, 0
    sizes = pa.compute.binary_length(batch.column(at)).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and (i - start >= piece or total + n > piece_bytes):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)
