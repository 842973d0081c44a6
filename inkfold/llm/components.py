"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import dropped, stored

#: Edges that a task holds at a time when it thins them.
RUN = 250_000
#: Edges that make a node a hub, and hubs that travel to the edges.
HUB, MOST_HUBS = 1000, 20_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in, a spanning forest of each run of at most RUN edges out."""
    up: dict = {}
    seen = 0

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def emit() -> Iterator[pa.RecordBatch]:
        # every node straight to its root: short paths
        pairs = [(n, top(n)) for n in up]
        pairs = [(n, r) for n, r in pairs if n != r]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in pairs], kind), pa.array([r for _, r in pairs], kind)], names=["a", "b"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= RUN:
            yield from emit()
            up, seen = {}, 0
    yield from emit()


def _thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each task replaces a bounded run of edges by stars, while that makes them fewer."""
    n = edges.count()
    while n:
        less = stored(edges.repartition(-(-n // RUN)).mapInArrow(_forests, edges.schema).distinct())
        after = less.count()
        dropped(edges)
        if after > 0.5 * n:
            return less
        edges, n = less, after
    return edges


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): every edge with the least neighbour of its first end.

    Hubs, the nodes with over HUB edges, are at most a HUB-th of the edges;
    while they are few, their least neighbours travel to the edges, so that
    no task holds all edges of a hub.
    """
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    hubs = least.where(F.col("n") > HUB).select("a", "m")
    few = hubs.limit(MOST_HUBS + 1).count()
    rest = least.select("a", "m")
    if not 0 < few <= MOST_HUBS:
        return edges.join(rest, "a")
    hubs = F.broadcast(hubs)  # a counted side
    plain = edges.join(hubs.select("a"), "a", "left_anti").join(rest, "a")
    return edges.join(hubs, "a").select("a", "b", "m").unionAll(plain.select("a", "b", "m"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Labels (node, root) for every node on an edge; root is the smallest node of its component.

    edges: (a, b) of any orderable type; loops, repeats and null ends are
    ignored. An empty table gives an empty table. Tasks first thin the edges,
    each a bounded run of them; then large-star and small-star
    steps alternate until the edge set is stable (a number of rounds that is
    logarithmic in the size of a component); each round is written to the
    shared folder, and the one before is deleted. The least neighbour is a
    partial aggregate, and hubs meet theirs without a shuffle.
    """
    now = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now = _thinned(now)
    state = _state(now)
    for _ in range(rounds if state[0] else 0):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stored(_with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        joined = _with_least(large)
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        before, now = now, stored(small.distinct())
        after = _state(now)
        dropped(before)
        if after == state:
            break
        state = after
    else:
        if state[0]:
            raise RuntimeError(f"components not stable after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
