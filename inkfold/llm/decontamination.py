"""Benchmark decontamination by greedy string tiling.

A document that shares a seed (a run of `seed` tokens) with a benchmark item
is tiled against it: the longest common runs of tokens are marked first, by
running Karp-Rabin hashes, without overlap on either side, down to the seed
length. The share of the item's tokens under tiles is its coverage, so a
passage whose parts were reordered is still found.

The benchmark is the query set. While its texts stay within `block_bytes`,
it is broadcast: seeds meet in the workers, and no document is shuffled. A
larger one is joined by its seeds: documents send the hashes of those seeds
that a bitmap of bounded size lets through, seeds that meet are counted by
pair, and only pairs that can reach the threshold are tiled. Both ways give
the same rows.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_digest

from inkfold.llm.common import released, resident, slices, stored, with_maybe

#: A-Z to a-z; ASCII characters other than letters and digits to spaces; other bytes stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, in lower case."""
    text = text or b""
    return (text if text.isascii() else text.decode("utf-8", "replace").lower().encode()).translate(FOLD).split()


class Running:
    """Karp-Rabin hashes (modulo 2**64) of all runs of a sequence, of any length, from one running sum.

    The sum of id * BASE**-place is kept; a run's part of it, moved back by
    its place, is the hash of its ids alone.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids) + 1
        self.ids = ids
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)])
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)))])
        self.sum = np.r_[np.uint64(0), np.cumsum((ids + 1).astype(np.uint64) * inverse[: n - 1])]
        self.taken = ids < 0

    def hashes(self, n: int) -> np.ndarray:
        """Of every run of n ids."""
        if len(self.ids) < n:
            return np.zeros(0, np.uint64)
        return (self.sum[n:] - self.sum[:-n]) * self.power[: len(self.sum) - n]

    def free(self, n: int) -> np.ndarray:
        """Places of runs of n ids without a taken one."""
        used = np.r_[0, np.cumsum(self.taken)]
        return np.flatnonzero(used[n:] == used[:-n]) if len(self.ids) >= n else np.zeros(0, np.int64)

    def take(self, at: int, n: int) -> None:
        self.taken[at : at + n] = True


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length), longest first, none overlapping. Negative ids match nothing.

    Runs of equal length are taken in order of their place in the item and
    then in the text. The longest length with a common run is found by
    halving, as a shorter part of a common run is common too. Equal hashes
    are confirmed id by id. A place of the text that is taken never comes up
    again, so repetitive texts cost no more than others.
    """
    a, b = Running(item), Running(text)
    out: list[tuple[int, int, int]] = []
    most = len(item)
    while True:
        most = min(most, _longest(a.taken), _longest(b.taken))
        if most < least:
            return out
        low, high, found = least, most, None
        while low <= high:
            n = (low + high) // 2
            hit = _common(a, b, n)
            if hit is None:
                high = n - 1
            else:
                low, found = n + 1, (n, *hit)
        if found is None:
            return out
        n, at_a, of_a, at_b, of_b = found
        where: dict[int, deque[int]] = defaultdict(deque)
        for j, h in zip(at_b.tolist(), of_b.tolist(), strict=True):
            where[h].append(j)
        for i, h in zip(at_a.tolist(), of_a.tolist(), strict=True):
            if a.taken[i : i + n].any():
                continue
            places, other = where[h], []
            while places:
                j = places.popleft()
                if b.taken[j : j + n].any():
                    continue
                if np.array_equal(item[i : i + n], text[j : j + n]):
                    out.append((i, j, n))
                    a.take(i, n)
                    b.take(j, n)
                    break
                other.append(j)  # another run of the same hash
            places.extendleft(reversed(other))
        most = n - 1


def _common(a: Running, b: Running, n: int) -> tuple[np.ndarray, ...] | None:
    """Places and hashes of free runs of n ids that both hold; None without any."""
    at_a, at_b = a.free(n), b.free(n)
    if not len(at_a) or not len(at_b):
        return None
    of_a, of_b = a.hashes(n)[at_a], b.hashes(n)[at_b]
    in_a, in_b = np.isin(of_a, of_b), np.isin(of_b, of_a)
    return (at_a[in_a], of_a[in_a], at_b[in_b], of_b[in_b]) if in_a.any() else None


def _longest(taken: np.ndarray) -> int:
    """The length of the longest run that is not taken."""
    edge = np.flatnonzero(np.r_[True, taken, True])
    return int(np.diff(edge).max() - 1)


class Benchmark:
    """Benchmark items, ready for comparison. An item under `seed` tokens is a seed as a whole; one without tokens matches nothing."""

    def __init__(self, items: list[tuple[object, bytes | None]], seed: int):
        self.seed = seed
        self.vocab: dict[bytes, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        hashes: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for key, text in items:
            ids = np.array([self.vocab.setdefault(t, len(self.vocab)) for t in tokens_of(text)], np.int64)
            n = min(seed, len(ids))
            if n:
                h = np.unique(Running(ids).hashes(n))
                hashes[n].append(h)
                owners[n].append(np.full(len(h), len(self.items)))
            self.items.append((key, ids))
        # for each length of seeds: sorted hashes and the items that hold them
        self.seeds = {}
        for n in sorted(hashes):
            h, o = np.concatenate(hashes[n]), np.concatenate(owners[n])
            order = np.argsort(h, kind="stable")
            self.seeds[n] = h[order], o[order].astype(np.int64)

    def compare(self, texts: list[bytes | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, tokens of the item, tokens under tiles, longest tile) for every pair that shares a seed."""
        split = [tokens_of(t) for t in texts]
        get = self.vocab.get
        flat = np.fromiter((get(t, -1) for w in split for t in w), np.int64, sum(map(len, split)))
        owner = np.repeat(np.arange(len(split)), [len(w) for w in split])
        out = []
        for n, (hashes, owners) in self.seeds.items():
            out += self._meet(flat, owner, n, hashes, owners)
        return out

    def _meet(self, flat: np.ndarray, owner: np.ndarray, n: int, hashes: np.ndarray, owners: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        # windows with an unknown token, or over the end of a text, hold no seed
        if len(flat) < n:
            return []
        known = np.cumsum(np.r_[0, flat < 0])
        whole = (known[n:] == known[:-n]) & (owner[: len(flat) - n + 1] == owner[n - 1 :])
        places = np.flatnonzero(whole)
        h = Running(flat).hashes(n)[places]
        lo = np.searchsorted(hashes, h, "left")
        hi = np.searchsorted(hashes, h, "right")
        hit = hi > lo
        if not hit.any():
            return []
        places, lo, hi = places[hit], lo[hit], hi[hit]
        count = hi - lo
        items = owners[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        at = np.repeat(places, count)
        pair = owner[at] * len(self.items) + items
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
        out = []
        starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pair)], strict=True):
            doc, item = divmod(int(pair[a]), len(self.items))
            ids = self.items[item][1]
            # only tokens inside a shared seed can be part of a tile
            text: list[int] = []
            end = -1
            for p in at[a:b].tolist():
                if p > end:
                    text.append(-1)
                    text += flat[p : p + n].tolist()
                else:
                    text += flat[end : p + n].tolist()
                end = p + n
            found = tiles(ids, np.array(text, np.int64), n)
            if found:
                out.append((doc, item, len(ids), sum(t[2] for t in found), max(t[2] for t in found)))
        return out


@dataclasses.dataclass(frozen=True)
class Rule:
    """When a pair counts as a leak: tiles over a share of the item, or one tile of `passage` tokens."""

    seed: int = 5
    coverage: float = 0.5
    passage: int = 50

    def holds(self, tokens: int, covered: int, longest: int) -> bool:
        return covered >= self.coverage * tokens or longest >= self.passage


def _ready(shared, seed: int) -> Benchmark:
    name, items = shared.value
    return resident(name, lambda: Benchmark(items, seed))


def _small(benchmark: DataFrame, block_bytes: int):
    """The benchmark (item_id, text) as a broadcast list, if its texts are within block_bytes; else None."""
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size > block_bytes:
        return None
    table = rows.toArrow()
    items = sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[1] or b"", str(r[0])))
    return benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rule: Rule = Rule(),
    block_bytes: int = 16_000_000,
) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered_tokens, coverage, longest_run) for every pair that the rule holds for.

    Ids keep their types. Null and empty texts and items match nothing; an
    item shorter than a seed is found where a text holds it whole. A null id
    stays null; repeated rows give repeated results; an empty table on either
    side gives none. Very long texts are compared whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    shared = _small(items, block_bytes)
    if shared is not None:
        kinds = [rows.schema["doc_id"].dataType, items.schema["item_id"].dataType]
        schema = T.StructType([T.StructField(n, k) for n, k in zip(COLUMNS, [*kinds, T.IntegerType(), T.IntegerType(), T.DoubleType(), T.IntegerType()], strict=True)])
        return rows.mapInArrow(_compare(shared, rule, to_arrow_type(kinds[1])), schema)
    # rows of either table meet the pairs of texts by the texts' digests
    of_docs = with_maybe(rows.withColumn("digest", _digest("text")), "digest", (pairs := text_pairs(rows, items, rule)).select(F.col("digest").alias("id")).distinct())
    of_items = items.select("item_id", _digest("text").alias("item_digest"))
    met = of_docs.where("__maybe").select("doc_id", "digest").join(pairs, "digest").join(of_items, "item_digest")
    return met.select("doc_id", "item_id", "item_tokens", "covered_tokens", (F.col("covered_tokens") / F.col("item_tokens")).alias("coverage"), "longest_run")


#: Columns of `overlaps`.
COLUMNS = ("doc_id", "item_id", "item_tokens", "covered_tokens", "coverage", "longest_run")


def _compare(shared, rule: Rule, item_kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _ready(shared, rule.seed)
        for whole in batches:
            for batch in slices(whole, 1, 1000, 4_000_000):
                found = [f for f in bench.compare(batch.column(1).cast(pa.large_binary()).to_pylist()) if rule.holds(*f[2:])]
                if found:
                    arrays = [
                        batch.column(0).take(pa.array([f[0] for f in found])),
                        pa.array([bench.items[f[1]][0] for f in found], item_kind),
                        pa.array([f[2] for f in found], pa.int32()),
                        pa.array([f[3] for f in found], pa.int32()),
                        pa.array([f[3] / f[2] for f in found], pa.float64()),
                        pa.array([f[4] for f in found], pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=list(COLUMNS))

    return run


# ------------------------------------------------------- joining seeds in Spark


def _digest(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def seed_hashes(text: bytes | None, n: int) -> Counter:
    """How often each hash of n tokens in a row occurs."""
    parts = tokens_of(text)
    return Counter(np.frombuffer(b"".join(map(xxh64_digest, map(b" ".join, zip(*(parts[k:] for k in range(n)), strict=False)), repeat(n))), ">i8").tolist())


def _item_seeds(seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1000, 4_000_000):
                keys, size, length, hashes, n = [], [], [], [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    total = len(tokens_of(text))
                    found = seed_hashes(text, min(seed, total)) if total else {}
                    keys += [key] * len(found)
                    size += [total] * len(found)
                    length += [min(seed, total)] * len(found)
                    hashes += found.keys()
                    n += found.values()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(size, pa.int32()), pa.array(length, pa.int32()), pa.array(hashes, pa.int64()), pa.array(n, pa.int32())], names=["item_digest", "item_tokens", "length", "h", "n"])

    return run


def _text_seeds(lengths: list[int], shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = shared.value
        for whole in batches:
            for batch in slices(whole, 1, 1000, 4_000_000):
                keys, hashes = [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    for n in lengths:
                        h = np.fromiter(seed_hashes(text, n), np.int64)
                        at = h & mask
                        h = h[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                        keys += [key] * len(h)
                        hashes.append(h)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate([*hashes, np.zeros(0, np.int64)]))], names=["digest", "h"])

    return run


def _bitmap(seeds: DataFrame, most_bits: int = 1 << 28) -> tuple[np.ndarray, int]:
    """A bitmap of the hashes, of 16 bits a hash up to most_bits, and the mask that names a hash's bit."""
    size = 1 << 16
    n = seeds.count()
    while size < min(16 * n, most_bits):
        size *= 2
    place = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
    parts = seeds.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map"))
    bits = np.zeros(size // 8, np.uint8)
    # at most most_bits / 8 bytes in all
    for row in parts.toLocalIterator():
        bits[(row["k"] - 1) * 4096 : row["k"] * 4096] |= np.frombuffer(row["map"], np.uint8)[: max(0, len(bits) - (row["k"] - 1) * 4096)]
    return bits, size - 1


def text_pairs(rows: DataFrame, items: DataFrame, rule: Rule) -> DataFrame:
    """(digest, item_digest, item_tokens, covered_tokens, longest_run) of all pairs of distinct texts that the rule holds for.

    A tile covers at least one seed of the item, and a place of a seed covers
    `seed` tokens at most; so the shared places bound the tokens under tiles,
    and pairs below the threshold are dropped before any text moves.
    """
    texts = rows.select(_digest("text").alias("digest"), "text").where("text is not null")
    distinct = stored(items.select(_digest("text").alias("item_digest"), "text").where("text is not null").groupBy("item_digest").agg(F.first("text").alias("text")))
    seeds = stored(distinct.mapInArrow(_item_seeds(rule.seed), "item_digest binary, item_tokens int, length int, h long, n int"))
    # at most `seed` lengths
    lengths = sorted(r["length"] for r in seeds.select("length").distinct().collect())
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(seeds.select("h").distinct()))
    # copies of a text count once
    hits = stored(texts.mapInArrow(_text_seeds(lengths, shared), "digest binary, h long").distinct())
    need = F.least(F.ceil(F.lit(rule.coverage) * F.col("item_tokens")), F.lit(rule.passage))
    near = hits.join(seeds, "h").groupBy("digest", "item_digest", "item_tokens").agg(F.sum("n").alias("places")).where(F.col("places") * rule.seed >= need)
    near = stored(near.select("digest", "item_digest"))
    held = with_maybe(texts, "digest", near.select(F.col("digest").alias("id")).distinct()).where("__maybe").groupBy("digest").agg(F.first("text").alias("text"))
    both = near.join(held, "digest").join(distinct.withColumnRenamed("text", "item_text"), "item_digest").select("digest", "item_digest", "text", "item_text")
    return stored(both.mapInArrow(_tiled(rule), "digest binary, item_digest binary, item_tokens int, covered_tokens int, longest_run int"))


def _tiled(rule: Rule):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, i, text, item in zip(*(batch.column(k).cast(pa.large_binary()).to_pylist() for k in range(4)), strict=True):
                out += [(d, i, *f[2:]) for f in Benchmark([(None, item)], rule.seed).compare([text]) if rule.holds(*f[2:])]
            kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["digest", "item_digest", "item_tokens", "covered_tokens", "longest_run"])

    return run


# ------------------------------------------------------------------- filtering


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", rule: Rule = Rule(), block_bytes: int = 16_000_000) -> DataFrame:
    """The rows of docs, all columns, for which the rule holds with no item; null and empty texts stay.

    Rows are judged by their own text, whatever their id. An empty benchmark
    leaves all rows.
    """
    items = benchmark.select(F.lit(None).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    shared = _small(items, block_bytes)
    if shared is not None:
        return docs.mapInArrow(_clean(shared, docs.columns.index(text_col), rule), docs.schema)
    leaks = text_pairs(docs.select(F.col(text_col).alias("text")), items, rule).select(F.col("digest").alias("id")).distinct()
    marked = with_maybe(docs.withColumn("__digest", _digest(text_col)), "__digest", leaks)
    unsure = marked.where("__maybe").join(leaks, F.col("__digest") == F.col("id"), "left_anti")
    return marked.where("not __maybe").unionByName(unsure).select(*docs.columns)


def _clean(shared, at: int, rule: Rule):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _ready(shared, rule.seed)
        for whole in batches:
            for batch in slices(whole, at, 1000, 4_000_000):
                found = {f[0] for f in bench.compare(batch.column(at).cast(pa.large_binary()).to_pylist()) if rule.holds(*f[2:])}
                yield batch if not found else batch.take(pa.array([i for i in range(batch.num_rows) if i not in found], pa.int64()))
        released()

    return run


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it leaks."""
    from inkfold.llm.common import documents

    return overlaps(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
