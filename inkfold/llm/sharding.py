"""Sharding by jump consistent hashing, in built-in expressions only.

A stable key and the number of shards decide the shard; there is no ring
table. The hash draws a sequence of jumps from a 64-bit linear congruential
generator that the key seeds, and keeps the last one below the number of
shards; so a further shard takes rows only into itself. The 64-bit products
are built from 32-bit halves, because Spark's long arithmetic is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import stored

MASK = 0xFFFFFFFF
#: The generator's multiplier, as 32-bit halves.
MULTIPLIER = 2862933555777941757


def _low_product(a: Column, c: int) -> Column:
    """a * c mod 2**32 for 0 <= a, c < 2**32."""
    return ((F.shiftright(a, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536) + a.bitwiseAND(F.lit(0xFFFF)) * F.lit(c)).bitwiseAND(F.lit(MASK))


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, as 32-bit halves."""
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & MASK
    low = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(c_lo) + F.lit(1)
    high = F.shiftright(lo, 16) * F.lit(c_lo)
    total = low + high.bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    carry = F.shiftright(total, 32) + F.shiftright(high, 16)
    return (carry + _low_product(hi, c_lo) + _low_product(lo, c_hi)).bitwiseAND(F.lit(MASK)), total.bitwiseAND(F.lit(MASK))


def jump_hash(key: Column, shards: list[int]) -> list[Column]:
    """The shard of a long key for each of several numbers of shards, from one walk over the jumps."""
    most = max(shards)
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(MASK)).alias("lo"),
        zero.alias("next"),
        *(zero.alias(f"b{n}") for n in shards),
    )

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        ahead = F.floor((s["next"] + 1) * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), ahead.alias("next"), *(F.when(s["next"] < n, s["next"]).otherwise(s[f"b{n}"]).alias(f"b{n}") for n in shards))
        return F.when(s["next"] < most, moved).otherwise(s)

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(most)), start, jump)
    return [walked[f"b{n}"].cast("int") for n in shards]


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int = 512) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the id and the number of shards decide. A null id is a
    key of its own; null text has size 1 and the checksum of an empty text.
    Slots number the rows of a shard from 0 without a gap. Repeated rows are
    counted before they are numbered and spread again afterwards, so one key
    may hold any share of the rows: rows are numbered within `buckets` parts
    of each shard, and only one count for each part is summed in one place.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    now, grown = jump_hash(F.col("key"), [shards, shards + 1])
    placed = same.withColumn("key", key).withColumn("jumps", F.struct(now.alias("now"), grown.alias("grown")))
    placed = stored(placed.select("doc_id", "size", "text_crc32", "copies", F.col("jumps.now").alias("shard"), F.col("jumps.grown").alias("grown_shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("part")))
    parts = placed.groupBy("shard", "part").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # shards x buckets rows at most
    offsets = F.broadcast(parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("until", F.sum("copies").over(order)).join(offsets, ["shard", "part"])
    first = F.col("offset") + F.col("until") - F.col("copies")
    return numbered.withColumn("slot", F.explode(F.sequence(first, first + F.col("copies") - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


def moved(placed: DataFrame) -> DataFrame:
    """(shard, grown_shard, n): how many rows a further shard moves, and from where."""
    return placed.where("shard <> grown_shard").groupBy("shard", "grown_shard").agg(F.count("*").alias("n"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, and where they would be in 17."""
    from inkfold.llm.common import documents

    return shard_documents(documents(spark, sf_dir), 16)
