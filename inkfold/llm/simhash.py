"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints come from word shingles. Pairs within the radius are found
exactly: by the pigeonhole principle two fingerprints at `radius` differing
bits agree in at least one of radius + 1 blocks, or in k of radius + k; so
every value of k blocks is a bucket, and inside a bucket all rows are
compared. k follows from the number of rows, so that buckets stay small as
the corpus grows. The comparison keeps the
fingerprints as vertical bit planes (one machine word holds one bit of 64
rows), updates 64 distances at once with carry-save counters, and abandons a
word as soon as all its 64 distances exceed the radius.

Groups: equal fingerprints are collapsed first. A bucket only emits a
spanning forest of its links, never all pairs. A bucket over `chunk` rows is
cut into chunks, and each pair of chunks is a task's unit of its own, so no
task holds more than two chunks of any bucket.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_digest

from inkfold.llm.common import LOWER, map_texts, released, resident, stored, with_maybe
from inkfold.llm.components import connected_components

#: Shingles hashed at a time: bounds memory for very long texts.
RUN = 50_000
#: Rows of a group from which the breadth-first search replaces the list of all row-word items.
SEARCH_FROM = 2048
#: Row-word items compared at a time.
ITEMS = 32_768
#: Distinct shingles up to which a fingerprint says too little: the set's candidates come from shared shingles too.
SHORT = 32


# ---------------------------------------------------------------- fingerprints


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64-bit hashes from one, by a multiply-xorshift mixer; lane 0 is the hash itself."""
    if lane == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes | None, words: int = 4, lanes: int = 1, seed: int = 42) -> bytes:
    """The fingerprint of one text, 8 bytes a lane, most significant bit first.

    Null, empty or blank text: all bits zero. Fewer words than a shingle:
    the whole sequence is the one shingle. A bit is 1 if set in over half of
    the shingles' hashes, repeats included.
    """
    parts = (text or b"").translate(LOWER).split()
    if not parts:
        return bytes(8 * lanes)
    total = max(1, len(parts) - words + 1)
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, total, RUN):
        run = parts[at : at + RUN + words - 1] if len(parts) > words else parts
        grams = map(b" ".join, zip(*(run[k:] for k in range(words)), strict=False)) if len(run) >= words else [b" ".join(run)]
        h = np.frombuffer(b"".join(map(xxh64_digest, grams, repeat(seed))), ">u8")
        for lane in range(lanes):
            bits = np.unpackbits((h if lane == 0 else _mixed(h.astype(np.uint64), lane).astype(">u8")).view(np.uint8).reshape(-1, 8), axis=1)
            for k in range(0, len(bits), 255):
                counts[64 * lane : 64 * lane + 64] += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > total).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, lanes: int = 1, seed: int = 42, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns in extra, fp binary) for every row; null ids and repeated rows stay."""

    def run(texts: list[bytes | None]) -> dict[str, list]:
        resident("shingles", dict)
        known: dict[bytes | None, bytes] = {}
        out = []
        for t in texts:
            fp = known.get(t)
            if fp is None:
                fp = known[t] = fingerprint(t, words, lanes, seed)
            out.append(fp)
        return {"fp": out}

    rows = docs.select(F.col(id_col).alias("doc_id"), *extra, F.col(text_col).alias("__text"))
    return map_texts(rows, run, [T.StructField("fp", T.BinaryType())], "__text")


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    parts = (text or b"").translate(LOWER).split()
    grams = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)] if parts else []
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, grams, repeat(42))), ">u8").astype(np.uint64))


def set_print(grams: np.ndarray, lanes: int) -> bytes:
    """The fingerprint of a shingle set, each shingle once, and 8 bytes that name the set: equal only for equal sets."""
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(grams), RUN):
        h = grams[at : at + RUN]
        for lane in range(lanes):
            bits = np.unpackbits(_mixed(h, lane).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            for k in range(0, len(bits), 255):
                counts[64 * lane : 64 * lane + 64] += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(grams)).tobytes() + xxh64_digest(grams.tobytes())


def short_prefix(grams: np.ndarray, similarity: float) -> list[int]:
    """The smallest shingles of a short set, of which two sets with at least this Jaccard similarity share one; empty for long sets.

    Sets that a short one can be similar to are short here too.
    """
    n = len(grams)
    if n > SHORT / similarity:
        return []
    return grams[: n - int(np.ceil(similarity * n - 1e-9)) + 1].astype(np.int64).tolist()


def set_prints(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, lanes: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns in extra, fp binary, prefix array<long>) for every row: set_print and short_prefix of its shingle set."""

    def run(texts: list[bytes | None]) -> dict[str, list]:
        resident("shingles", dict)
        known: dict[bytes | None, tuple[bytes, list[int]]] = {}
        out = []
        for t in texts:
            made = known.get(t)
            if made is None:
                grams = shingle_set(t, words)
                made = known[t] = (set_print(grams, lanes), short_prefix(grams, similarity))
            out.append(made)
        return {"fp": [m[0] for m in out], "prefix": [m[1] for m in out]}

    rows = docs.select(F.col(id_col).alias("doc_id"), *extra, F.col(text_col).alias("__text"))
    return map_texts(rows, run, [T.StructField("fp", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))], "__text")


# ------------------------------------------------------- bit-sliced comparison


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: [bit, word], where bit k of word w belongs to row 64 w + k. fps: uint8 [row, byte]."""
    bits = np.unpackbits(fps, axis=1).T
    rows = np.zeros((bits.shape[0], (-bits.shape[1]) % 64 + bits.shape[1]), np.uint8)
    rows[:, : bits.shape[1]] = bits
    return np.packbits(rows, axis=1, bitorder="little").view(np.uint64)


def _add(counters: list[np.ndarray], level: int, x: np.ndarray) -> None:
    """Adds x at a weight of 2**level; carries ripple up."""
    while level < len(counters):
        counters[level], x = counters[level] ^ x, counters[level] & x
        level += 1
    counters.append(x)


def _full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three planes."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """The rows whose count is over the radius, as bits."""
    over, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(max(len(counters), radius.bit_length()) - 1, -1, -1):
        c = counters[k] if k < len(counters) else np.zeros_like(over)
        if radius >> k & 1:
            equal &= c
        else:
            over |= equal & c
            equal &= ~c
    return over


def near(planes: np.ndarray, flips: np.ndarray, q: np.ndarray, w: np.ndarray, valid: np.ndarray, radius: int, first: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items (query row q, word w, valid bits): those with rows within the radius, and their bits.

    flips: [bit, row], all ones where the row's bit is set. Items are dropped
    after the first 16 planes, and then after every 16, once all valid rows
    exceed the radius; the count of a row never falls.
    """
    counters = [np.zeros(len(q), np.uint64)]
    for b in range(0, len(planes), 4):
        x = [planes[k][w] ^ flips[k][q] for k in range(b, b + 4)]
        s, two_a = _full(counters[0], x[0], x[1])
        counters[0], two_b = _full(s, x[2], x[3])
        if len(counters) == 1:
            counters.append(np.zeros_like(counters[0]))
        counters[1], four = _full(counters[1], two_a, two_b)
        _add(counters, 2, four)
        if (b + 4) % first == 0:
            valid = valid & ~_over(counters, radius)
            alive = valid != 0
            if b + 4 == len(planes) or alive.mean() < 0.75:
                q, w, valid = q[alive], w[alive], valid[alive]
                counters = [c[alive] for c in counters]
                if not len(q):
                    break
    return q, w, valid


def _bits_between(word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bits of rows lo <= row < hi in each word."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    a, b = np.clip(lo - 64 * word, 0, 64), np.clip(hi - 64 * word, 0, 64)
    left = np.where(a >= 64, np.uint64(0), ones << np.minimum(a, 63).astype(np.uint64))
    right = np.where(b <= 0, np.uint64(0), ones >> (64 - np.maximum(b, 1)).astype(np.uint64))
    return left & right


def _pairs(q: np.ndarray, w: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(query row, other row) of every set bit."""
    at, k = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return np.stack([q[at], w[at] * 64 + k], axis=1)


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for a, b in pairs.tolist():
        ra, rb = top(a), top(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _search(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of all links in one large group, by breadth-first search over rows not yet reached.

    Each row is a query once and is compared with unreached rows only, so a
    large group of copies costs little more than one pass.
    """
    n = len(fps)
    planes = planes_of(fps)
    flips = np.where(np.unpackbits(fps, axis=1).T, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    words = planes.shape[1]
    fresh = _bits_between(np.arange(words), np.zeros(words, np.int64), np.full(words, n))
    out: list[tuple[int, int]] = []
    ones = np.uint64(1)

    def bit(row: int) -> np.uint64:
        return ones << np.uint64(row & 63)

    def near_fresh(rows: list[int]) -> list[list[int]]:
        """(row, fresh row) pairs within the radius."""
        ahead = np.flatnonzero(fresh)
        if not len(ahead):
            return []
        q, w = np.repeat(np.array(rows), len(ahead)), np.tile(ahead, len(rows))
        own = np.where(q >> 6 == w, ones << (q & 63).astype(np.uint64), np.uint64(0))
        return _pairs(*near(planes, flips, q, w, fresh[w] & ~own, radius)).tolist()

    def reach(pairs: list[list[int]]) -> None:
        for a, b in pairs:
            if fresh[b >> 6] & bit(b):
                fresh[b >> 6] &= ~bit(b)
                out.append((a, b))
                queue.append(b)

    nxt, queue = 0, []
    while True:
        step = max(1, ITEMS // max(1, np.count_nonzero(fresh)))
        if queue:
            now, queue = queue[:step], queue[step:]
            reach(near_fresh(now))
            continue
        # seeds without a fresh neighbour are complete; the first with one starts the next tree
        seeds = []
        while nxt < n and len(seeds) < step:
            if fresh[nxt >> 6] & bit(nxt):
                seeds.append(nxt)
            nxt += 1
        if not seeds:
            return out
        pairs = near_fresh(seeds)
        start = min((a for a, _ in pairs), default=n)
        for a in seeds:
            if a <= start:
                fresh[a >> 6] &= ~bit(a)
        if start < n:
            nxt = start + 1
            reach([p for p in pairs if p[0] == start])


def links(group: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links at `radius` or fewer bits between rows of the same group. Rows are sorted by group."""
    if not len(group):
        return []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    out: list[tuple[int, int]] = []
    for s, n in zip(starts[sizes >= SEARCH_FROM].tolist(), sizes[sizes >= SEARCH_FROM].tolist(), strict=True):
        out += [(a + s, b + s) for a, b in _search(fps[s : s + n], radius)]
    small = np.repeat((sizes < SEARCH_FROM) & (sizes > 1), sizes)
    if small.any():
        end = np.repeat(starts + sizes, sizes)
        rows = np.flatnonzero(small)
        rows = rows[end[rows] > rows + 1]
        at = np.unique(np.r_[0, np.searchsorted(rows, np.arange(0, len(group), 100_000))])
        for block in np.split(rows, at[1:]):
            if not len(block):
                continue
            lo, hi = block[0], int(end[block].max())
            planes = planes_of(fps[lo:hi])
            flips = np.where(np.unpackbits(fps[lo:hi], axis=1).T, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
            q, e = block - lo, end[block] - lo
            first, last = (q + 1) >> 6, (e - 1) >> 6
            n = last - first + 1
            qs, es = np.repeat(q, n), np.repeat(e, n)
            w = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for k in range(0, len(qs), ITEMS):
                a, b, c = qs[k : k + ITEMS], w[k : k + ITEMS], es[k : k + ITEMS]
                out += [(x + lo, y + lo) for x, y in _forest(_pairs(*near(planes, flips, a, b, _bits_between(b, a + 1, c), radius)))]
    return out


# ------------------------------------------------------------------ Spark plan


def _blocks(bits: int, radius: int, rows: int = 0, mean: int = 256) -> list[list[int]]:
    """Sets of bits, of which two fingerprints at `radius` differing bits agree in all bits of at least one.

    The bits are cut into radius + k blocks, as even as can be, and each
    choice of k blocks is a set. k is the least for which evenly spread rows
    make buckets of at most `mean` rows, as long as there are blocks of four
    bits for it.
    """
    for k in range(1, bits):
        blocks = radius + k
        cut = np.linspace(0, bits, blocks + 1).round().astype(int).tolist()
        ranges = [list(range(a, b)) for a, b in itertools.pairwise(cut)]
        sets = [sum(chosen, []) for chosen in itertools.combinations(ranges, k)]
        if rows <= mean << min(map(len, sets)) or bits < 4 * (blocks + 1):
            return sets
    raise ValueError("a fingerprint needs more bits than the radius")


def _bands(bits: int, rows: int, share: float, missed: float = 0.003, seed: int = 3) -> list[list[int]]:
    """Random sets of bits, so that two fingerprints that agree in a share of their bits agree in all bits of a set, up to a chance of `missed`.

    The sets grow with the logarithm of the number of rows, so that the mean
    bucket stays near a hundred rows; the smaller chance of a match is made up
    for by more sets.
    """
    width = min(24, max(10, (max(rows, 1) // 128).bit_length()))
    count = int(np.ceil(np.log(missed) / np.log1p(-(share**width))))
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(bits, width, replace=False).tolist()) for _ in range(count)]


def _to_buckets(sets: list[list[int]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            fps = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
            bits = np.unpackbits(fps.reshape(len(column), -1), axis=1)
            for k, at in enumerate(sets):
                key = bits[:, at].astype(np.int64) @ (1 << np.arange(len(at), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([column, pa.array(key * len(sets) + k, pa.int64())], names=["fp", "bucket"])

    return run


def _to_links(radius: int, width: int | None):
    """Sorted (bucket, pair, fp) rows in, links out; a group that spans batches is held until it is whole."""

    def emit(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids = np.stack([table[c].to_numpy() for c in ("bucket", "part_a", "part_b")], axis=1)
        group = np.r_[0, np.cumsum((ids[1:] != ids[:-1]).any(axis=1))]
        column = table["fp"].to_pylist()
        fps = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)[:, :width]
        found = links(group, fps, radius)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([column[a] for a, _ in found], pa.binary()), pa.array([column[b] for _, b in found], pa.binary())], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("bucket", "part_a", "part_b")], axis=1)
            change = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1))
            cut = int(change[-1]) + 1 if len(change) else 0
            if held:
                last = held[-1].slice(held[-1].num_rows - 1)
                if any(last.column(last.schema.get_field_index(c))[0].as_py() != ids[0, k] for k, c in enumerate(("bucket", "part_a", "part_b"))):
                    yield from emit(held)
                    held = []
            if cut:
                yield from emit([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from emit(held)
        del held
        released()

    return run


def link_table(fps: DataFrame, sets: list[list[int]], radius: int = 4, chunk: int = 4096, width: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints: all links of each bucket, as a spanning forest.

    fps: (fp binary), each value once; its first `width` bytes (all if None)
    are the fingerprint, any others only name the row. sets: rows that agree in all bits of a
    set meet in a bucket. If the sets are blocks by the pigeonhole principle,
    the components of the result are those of the full graph of pairs at
    `radius` or fewer bits.
    """
    spark = fps.sparkSession
    rows = fps.select("fp").mapInArrow(_to_buckets(sets), "fp binary, bucket long")
    hot = _hot_buckets(rows, fps.count() * len(sets), chunk)
    few, many = rows, None
    if n_hot := hot.count():
        side = F.broadcast(hot) if n_hot <= 10_000 else hot  # a counted side
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        few = rows.join(side, "bucket", "left_anti")
        many = (
            rows.join(side, "bucket")
            .select("fp", "bucket", part.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
            .select("fp", "bucket", F.least("p", "o").alias("part_a"), F.greatest("p", "o").alias("part_b"))
        )
    both = few.select("fp", "bucket", F.lit(0).alias("part_a"), F.lit(0).alias("part_b"))
    both = both if many is None else both.union(many)
    key = ["bucket", "part_a", "part_b"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(_to_links(radius, width), "a binary, b binary")


def _hot_buckets(rows: DataFrame, total: int, chunk: int) -> DataFrame:
    """(bucket, parts) of buckets over `chunk` rows, and into how many parts to cut them.

    Coarse bins are counted first; only buckets of bins over `chunk` rows are
    counted themselves, so the count does not shuffle every bucket.
    """
    bins = max(65_536, total // 512)
    binned = rows.select("bucket", F.pmod(F.xxhash64("bucket"), F.lit(bins)).alias("bin"))
    full = stored(binned.groupBy("bin").count().where(F.col("count") > chunk).select("bin"))
    n_full = full.count()
    if not n_full:
        return rows.sparkSession.range(0).selectExpr("id as bucket", "cast(id as int) as parts")
    side = F.broadcast(full) if n_full <= 10_000 else full  # a counted side
    counts = binned.join(side, "bin", "left_semi").groupBy("bucket").count().where(F.col("count") > chunk)
    return stored(counts.select("bucket", F.ceil(F.col("count") / chunk).cast("int").alias("parts")))


def _named(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every node (fp, least), from component labels (node, root)."""
    named = labels.join(nodes, labels["node"] == nodes["fp"]).select("fp", "root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = stored(named.join(least, "root").select("fp", "root", "component_id"))
    alone = nodes.join(linked, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return linked.union(alone)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    lanes: int = 1,
    radius: int = 4,
    chunk: int = 4096,
) -> DataFrame:
    """One row for each row of docs: doc_id, fp (binary), component_id (smallest id that links reach).

    Null text counts as empty (fingerprint zero, linked like any other). A
    null id stays and never names a component unless all its ids are null.
    Equal texts share a fingerprint, so repeated rows are one node. Very long
    texts are read in runs of shingles; an empty table stays empty.
    """
    each = stored(fingerprints(docs, id_col, text_col, words, lanes))
    nodes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected_components(link_table(nodes, _blocks(64 * lanes, radius, nodes.count()), radius, chunk))
    return each.join(_named(nodes, labels), "fp").select("doc_id", "fp", "component_id")


def similarity_radius(bits: int, similarity: float, slack: float = 1.0) -> int:
    """Differing bits that fingerprints of texts with this Jaccard similarity show on average, and `slack` standard deviations more.

    A bit differs with a chance of the angle between the shingle counts over
    pi; sets of a Jaccard similarity s and of equal size have a cosine of
    2 s / (1 + s).
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + slack * np.sqrt(bits * p * (1 - p)))


def jaccard_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sets have at least this Jaccard similarity. Empty sets link to each other.

    Breadth-first search over sets not yet reached: a set's intersections
    with them are counted at once, from the lists of sets that hold an
    element. The lists are made anew when half of their sets are reached, so
    a large group of copies costs little more than one pass.
    """
    size = np.array([len(x) for x in sets], np.int64)
    fresh = size > 0
    empty = np.flatnonzero(~fresh).tolist()
    out = [(empty[0], x) for x in empty[1:]]
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    listed = left = int(fresh.sum())
    for seed in range(len(sets)):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        left -= 1
        queue = [seed]
        while queue and left:
            if 2 * left < listed:
                keep = fresh[owner]
                element, owner, listed = element[keep], owner[keep], left
            i = queue.pop()
            x = sets[i]
            lo, hi = np.searchsorted(element, x, "left"), np.searchsorted(element, x, "right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            other = owner[at]
            ids, common = np.unique(other[fresh[other]], return_counts=True)
            for j in ids[common >= similarity * (size[ids] + size[i] - common) - 1e-9].tolist():
                fresh[j] = False
                left -= 1
                out.append((i, j))
                queue.append(j)
    return out


def _to_verified(similarity: float):
    """Sorted (root, part_a, part_b, fp, grams) rows in, verified links out, unit by unit."""

    def emit(fps: list[bytes], grams: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = jaccard_links([np.frombuffer(g, np.uint64) for g in grams], similarity)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([fps[a] for a, _ in found], pa.binary()), pa.array([fps[b] for _, b in found], pa.binary())], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, fps, grams = None, [], []
        for batch in batches:
            for *u, f, g in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("root", "part_a", "part_b", "fp", "grams")), strict=True):
                if u != unit:
                    yield from emit(fps, grams) if len(fps) > 1 else ()
                    unit, fps, grams = u, [], []
                if not fps or fps[-1] != f:
                    fps.append(f)
                    grams.append(g)
        yield from emit(fps, grams) if len(fps) > 1 else ()
        del fps, grams
        released()

    return run


def similar_groups(docs: DataFrame, each: DataFrame, id_col: str, text_col: str, words: int, similarity: float, lanes: int, chunk: int, held: int) -> DataFrame:
    """(fp, root, component_id) for every distinct shingle set of each (doc_id, fp, prefix, size): components of pairs with at least this Jaccard similarity.

    Sets whose fingerprints are within a wide radius (2.5 standard deviations
    beyond the similarity) are candidates, and so are short sets that share a
    shingle of their prefixes; they form loose components. All pairs of a
    loose component are verified on the whole shingle sets, whatever its
    size: one of over `held` bytes of text is cut into parts of about that
    size, and each pair of parts is a task's unit of its own.
    """
    spark = docs.sparkSession
    bits = 64 * lanes
    nodes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.max("size").alias("size")))
    share = 1 - similarity_radius(bits, similarity, 0) / bits
    sets = _bands(bits, nodes.count(), share)
    short = each.select("fp", F.explode("prefix").alias("gram")).distinct()
    least = short.groupBy("gram").agg(F.min("fp").alias("b"))
    shared = stored(short.join(least, "gram").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())
    loose = connected_components(link_table(nodes, sets, similarity_radius(bits, similarity, 2.5), chunk, 8 * lanes).union(shared))
    members = stored(loose.join(nodes, loose["node"] == nodes["fp"]).select("fp", "root", "least", "size"))
    parts = members.groupBy("root").agg(F.ceil(F.sum("size") / held).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.greatest("parts", F.lit(1))).cast("int")
    chosen = stored(members.join(parts, "root").select(F.col("least").alias("__id"), F.col("root").alias("__root"), F.col("fp").alias("__fp"), F.col("parts").alias("__parts"), part.alias("__part")))
    named = chosen.where("__id is not null")
    narrow = with_maybe(docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")), "__doc", named.select(F.col("__id").alias("id"))).where("__maybe")
    texts = narrow.join(named, F.col("__doc") == F.col("__id")).select("__root", "__fp", "__parts", "__part", "__text")

    def run(rows: list[bytes | None]) -> dict[str, list]:
        grams = [shingle_set(t, words) for t in rows]
        return {"fp": [set_print(g, lanes) for g in grams], "grams": [g.tobytes() for g in grams]}

    fields = [T.StructField("fp", T.BinaryType()), T.StructField("grams", T.BinaryType())]
    made = map_texts(texts, run, fields, "__text").where("fp = __fp")
    if chosen.where("__id is null").limit(1).count():
        # texts that occur only without an id
        lone = map_texts(docs.where(F.col(id_col).isNull()).select(F.col(text_col).alias("__text")), run, fields, "__text")
        made = made.unionByName(lone.join(chosen.where("__id is null"), F.col("fp") == F.col("__fp")).select(*made.columns))
    # the other parts that a part meets; a component of one part meets itself
    others = F.when(F.col("__parts") > 1, F.array_remove(F.sequence(F.lit(0), F.col("__parts") - 1), F.col("__part"))).otherwise(F.array(F.col("__part")))
    units = made.withColumn("__other", F.explode(others)).select(
        F.col("__root").alias("root"), F.least("__part", "__other").alias("part_a"), F.greatest("__part", "__other").alias("part_b"), "fp", "grams"
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["root", "part_a", "part_b"]
    links = units.repartition(n, *key).sortWithinPartitions(*key, "fp").mapInArrow(_to_verified(similarity), "a binary, b binary")
    return _named(nodes, connected_components(links))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, lanes: int = 4, chunk: int = 4096, held: int = 8_000_000) -> DataFrame:
    """The rows of docs, all columns, with one row of each group: that of the smallest id.

    Groups are components of pairs of texts whose sets of word shingles have
    a Jaccard similarity of at least `similarity` (see `similar_groups`).
    Null texts count as empty. Rows without an id stay only in groups without
    any id, one for each group.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"))
    each = stored(set_prints(sized, "doc_id", "text", words, similarity, lanes, ("size",)))
    groups = similar_groups(docs, each, id_col, text_col, words, similarity, lanes, chunk, held)
    first = each.join(groups, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stored(first.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp")).select("doc_id", "fp"))
    named = kept.where("doc_id is not null").select(F.col("doc_id").alias("__id"))
    gone = stored(each.where("doc_id is not null").join(named, F.col("doc_id") == F.col("__id"), "left_anti").select(F.col("doc_id").alias("id")).distinct())
    marked = with_maybe(docs.where(F.col(id_col).isNotNull()), id_col, gone)
    unsure = marked.where("__maybe").drop("__maybe").join(named, F.col(id_col) == F.col("__id"), "left_semi")
    once = marked.where("not __maybe").drop("__maybe").unionByName(unsure)
    if each.groupBy("doc_id").count().where("doc_id is not null and count > 1").limit(1).count():
        # ids that occur more than once: of their rows, the first by text
        many = stored(each.groupBy("doc_id").count().where("doc_id is not null and count > 1").select(F.col("doc_id").alias("__id")))
        order = Window.partitionBy(id_col).orderBy(text_col)
        twice = once.join(many, F.col(id_col) == F.col("__id"), "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
        once = once.join(many, F.col(id_col) == F.col("__id"), "left_anti").unionByName(twice)
    if kept.where("doc_id is null").limit(1).count():
        made = set_prints(docs.where(F.col(id_col).isNull()).withColumn("__row", F.struct(*docs.columns)).select(F.lit(None).cast("long").alias("doc_id"), text_col, "__row"), "doc_id", text_col, words, similarity, lanes, ("__row",))
        nameless = made.withColumnRenamed("fp", "__fp").join(kept.where("doc_id is null").select(F.col("fp").alias("__fp")), "__fp", "left_semi")
        nameless = nameless.withColumn("__n", F.row_number().over(Window.partitionBy("__fp").orderBy(F.col("__row")[text_col]))).where("__n = 1")
        once = once.unionByName(nameless.select("__row.*"))
    return once


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents: 4-word shingles, radius 4."""
    from inkfold.llm.common import documents

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
