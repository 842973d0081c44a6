"""Sources: text lines, captions, embeddings, taxonomy files, lexicons and images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.functions.images import decode_png
from inkfold.functions.strings import collapsed
from inkfold.operators.lexicon import LEXICON_SCHEMA
from inkfold.operators.taxonomy import parse_super_map


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) for every line that is not blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of one text corpus in the order of file names and lines, blank lines kept in the count and then dropped.

    Each file is cut into blocks by Spark; lines are counted in each block
    and numbered from the sums before it, files by name and blocks by place,
    so the text is never in one task.
    """
    return read_all_lines(spark, path).select("line_no", F.trim("value").alias("text")).where("text <> ''")


def read_street_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a street list, one a line, trimmed, blank lines left out."""
    return read_lines(spark, path).withColumnRenamed("text", "name")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(caption) of one JSON file: an object with `annotations`, or a list; the Korean caption first, else the plain one."""
    rows = spark.read.option("multiLine", True).json(path)
    if "annotations" in rows.columns:
        rows = rows.select(F.explode("annotations").alias("a")).select("a.*")
    names = [c for c in ("caption_ko", "caption") if c in rows.columns]
    if not names:
        return spark.createDataFrame([], "caption string")
    return rows.select(F.trim(F.replace(F.coalesce(*names), F.lit("\n"), F.lit(" "))).alias("caption")).where("caption <> ''")


def read_caption_folder(spark: SparkSession, path: str, names: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """((caption), (bad_files)) of all JSON files under a folder; files that are no JSON are counted, a byte-order mark is skipped."""
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    ann = "struct<caption_ko:string,caption:string>"
    parsed = whole.select(F.from_json(text, f"struct<annotations:array<{ann}>,caption_ko:string,caption:string>").alias("o"), F.from_json(text, f"array<{ann}>").alias("l"), F.try_parse_json(text).isNull().alias("bad"))
    single = F.when(F.col("o.caption_ko").isNotNull() | F.col("o.caption").isNotNull(), F.array(F.struct(F.col("o.caption_ko").alias("caption_ko"), F.col("o.caption").alias("caption"))))
    rows = parsed.where(~F.col("bad")).select(F.explode(F.coalesce("o.annotations", "l", single)).alias("a"))
    captions = rows.select(collapsed(F.coalesce("a.caption_ko", "a.caption")).alias("caption")).where("caption <> ''")
    return captions, parsed.agg(F.count_if("bad").alias("bad_files"))


def read_embedding_records(spark: SparkSession, path: str) -> DataFrame:
    """(ids, emb, meta (line, win)) from JSON lines; lines that do not parse go."""
    return spark.read.schema("ids array<int>, emb array<float>, meta struct<line: bigint, win: int>").json(path).where("emb is not null")


def read_word_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(token, emb) from JSON lines."""
    return spark.read.schema("token string, emb array<float>").json(path).where("token is not null")


def _npy(path: str) -> tuple:
    """The file system, place, shape, type and first byte of the data of an .npy file, from its header alone."""
    from numpy.lib import format as npy
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    with files.open_input_file(place) as f:
        version = npy.read_magic(f)
        shape, fortran, dtype = npy.read_array_header_1_0(f) if version == (1, 0) else npy.read_array_header_2_0(f)
        if fortran and len(shape) > 1 or dtype.hasobject:
            raise ValueError("rows must lie one after the other, as plain numbers")
        return files, place, shape, dtype, f.tell()


def read_npy(spark: SparkSession, path: str, step: int = 65_536) -> DataFrame:
    """(row_id, emb) from a two-dimensional .npy file, of any size: each task reads its own rows."""
    shape = _npy(path)[2]
    if len(shape) != 2:
        raise ValueError(f"a matrix is expected, not {len(shape)} dimensions")
    return _ranges(spark, shape[0], step).mapInPandas(_reader(path, shape[1], step, "emb", lambda part: list(part.astype(np.float32))), "row_id long, emb array<float>")


def read_npy_vector(spark: SparkSession, path: str, step: int = 1_000_000) -> DataFrame:
    """(row_id, label) from a one-dimensional .npy file of whole numbers, of any size."""
    shape = _npy(path)[2]
    if len(shape) != 1:
        raise ValueError(f"a vector is expected, not {len(shape)} dimensions")
    return _ranges(spark, shape[0], step).mapInPandas(_reader(path, 1, step, "label", lambda part: part[:, 0].astype(np.int64)), "row_id long, label long")


def _ranges(spark: SparkSession, n: int, step: int) -> DataFrame:
    """(id): the first row of each run of rows, one run to a partition."""
    return spark.range(0, n, step, max(1, -(-n // step)))


def _reader(path: str, width: int, step: int, name: str, shown: Callable[[np.ndarray], object]) -> Callable:
    """First rows in, rows of the file out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, place, shape, dtype, begin = _npy(path)
        size = width * dtype.itemsize
        with files.open_input_file(place) as f:
            for pdf in frames:
                for first in pdf["id"].tolist():
                    n = min(step, shape[0] - first)
                    f.seek(begin + first * size)
                    part = np.frombuffer(f.read(n * size), dtype).reshape(n, width)
                    yield pd.DataFrame({"row_id": np.arange(first, first + n), name: shown(part)})

    return run


def read_super_map(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, super_id) from a JSON object or list."""
    return spark.read.text(path, wholetext=True).select(F.explode(parse_super_map(F.col("value"))).alias("e")).select("e.*")


def read_super_names(spark: SparkSession, runtime: str | None = None, names: str | None = None) -> DataFrame:
    """(super_id, name): those of the runtime bundle, and only without one those of the names file."""
    whole = spark.read.text(runtime or names, wholetext=True)
    table = F.from_json("value", "struct<super_names: map<string,string>>")["super_names"] if runtime else F.from_json("value", "map<string,string>")
    return whole.select(F.explode(table).alias("k", "name")).select(F.col("k").cast("int").alias("super_id"), "name")


def read_category_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(place, category, keywords) from a JSON object of lists, in file order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("place", "e")).select("place", F.col("e.key").alias("category"), F.col("e.value").alias("keywords"))


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(word), without blank lines and comments."""
    return read_lines(spark, path).where(~F.col("text").startswith("#")).select(F.col("text").alias("word")).distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Twelve-column lexicon rows of one or many CSV files, without header, with the file name."""
    return spark.read.schema(LEXICON_SCHEMA).option("pathGlobFilter", "*.csv").csv(path, quote='"', escape='"').withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_import_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an import file up to its first empty line: thirteen columns, or fourteen with a class.

    (surface, pos, read, semantic_class, type, start_pos, end_pos,
    expression, class_name, is_available, is_inspected); a missing class is
    null. Rows are numbered as lines, so quoted fields may not hold line
    feeds.
    """
    lines = read_all_lines(spark, path)
    end = lines.where("trim(value) = ''").agg(F.min("line_no").alias("end"))
    kept = lines.join(F.broadcast(end)).where("end is null or line_no < end")  # one row
    names = ", ".join(f"c{k} string" for k in range(14))
    row = F.from_csv("value", F.lit(names), {"quote": '"', "escape": '"'})
    parts = kept.select("line_no", row.alias("r"))
    picked = dict(surface=0, pos=4, read=7, semantic_class=5, type=8, start_pos=9, end_pos=10, expression=12, class_name=13)
    return parts.select("line_no", *(F.col(f"r.c{k}").alias(n) for n, k in picked.items()), F.lit(1).alias("is_available"), F.lit(1).alias("is_inspected"))


def read_all_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of all lines of a file, blank ones too."""
    whole = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = whole.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return whole.join(starts, ["file", "block"]).select((F.col("start") + F.col("at") - F.col("first")).alias("line_no"), "value")


def read_config_rows(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Delimited rows of a settings file, comments and blank lines left out; missing fields are null."""
    lines = read_lines(spark, path).where(~F.col("text").startswith("#"))
    parts = F.split("text", sep)
    return lines.select(*(F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(columns)))


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table through JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of image files, readable or not."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").option("recursiveFileLookup", True).load(path).select("path", "content")


def readable_images(images: DataFrame) -> DataFrame:
    """The PNG images that can be read, with their height and width; any others go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            shapes = [None if (m := decode_png(raw)) is None else m.shape for raw in pdf["content"]]
            good = np.array([x is not None for x in shapes], bool)
            yield pdf[good].assign(height=[x[0] for x in shapes if x], width=[x[1] for x in shapes if x])

    return images.mapInPandas(run, T.StructType([*images.schema.fields, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType())]))


def first_present(spark: SparkSession, paths: list[str], default: str | None = None) -> str:
    """The first path that exists; else the default, or an error that names all that were tried."""
    found = {r["path"] for r in present(spark, {p: p for p in paths}).where("exists").collect()}
    hit = next((p for p in paths if p in found), default)
    if hit is None:
        raise FileNotFoundError("none of these exists: " + ", ".join(paths))
    return hit


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(chat_id, prompt_idx, text) from JSON-lines requests {chatId, promptContents}; blank prompts go."""
    rows = spark.read.schema("chatId string, promptContents array<string>").json(path)
    return rows.select(F.col("chatId").alias("chat_id"), F.posexplode("promptContents").alias("prompt_idx", "text")).select("chat_id", "prompt_idx", F.trim("text").alias("text")).where("text <> ''")


def present(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, path, exists) of artifacts, by Hadoop's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = [(n, p, bool(jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p)))) for n, p in paths.items()]
    return spark.createDataFrame(found, "name string, path string, exists boolean")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics file as one row."""
    return spark.read.option("multiLine", True).json(path)
