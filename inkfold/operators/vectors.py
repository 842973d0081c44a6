"""Vectors and centroids: assignment, similarity graphs, statistics.

Centroids are a small side. Their number is checked before they travel as
one row with all of them; a larger set is compared block by block, each
block as small, so no side is broadcast unchecked and nothing is multiplied
out into rows.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.vectors import cosine, doubles, dot, norm, squared_distance, unit, unit_soft

#: Centroids that travel in one row.
BLOCK = 4096


def mean_vectors(vectors: DataFrame, key: str, emb: str = "embedding") -> DataFrame:
    """(key, emb): the element-wise mean of each key's vectors, by a vector aggregate with partial sums. Null keys and vectors do not count."""
    rows = vectors.where(F.col(key).isNotNull() & F.col(emb).isNotNull()).select(key, array_to_vector(doubles(F.col(emb))).alias("__v"))
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias(emb))


def _blocks(centroids: DataFrame, cid: str, emb: str) -> list[DataFrame]:
    """One-row frames (all array<struct<cid, v>>) of at most BLOCK centroids each."""
    n = centroids.count()
    parts = max(1, -(-n // BLOCK))
    rows = centroids.select(F.col(cid).alias("cid"), doubles(F.col(emb)).alias("v"))
    if parts == 1:
        return [rows.agg(F.sort_array(F.collect_list(F.struct("cid", "v"))).alias("all"))]
    return [rows.where(F.pmod(F.xxhash64("cid"), F.lit(parts)) == k).agg(F.sort_array(F.collect_list(F.struct("cid", "v"))).alias("all")) for k in range(parts)]


def _best(points: DataFrame, centroids: DataFrame, cid: str, emb: str, score: str) -> DataFrame:
    """Adds best (struct<key, cid>): the least key, ties by the smaller cid."""
    out = points.withColumn("__v", doubles(F.col(emb)))
    names = []
    for k, block in enumerate(_blocks(centroids, cid, emb)):
        key = (lambda c: squared_distance(F.col("__v"), c["v"])) if score == "distance" else (lambda c: -cosine(F.col("__v"), c["v"]))
        # one row of at most BLOCK centroids
        out = out.join(F.broadcast(block)).withColumn(f"__b{k}", F.array_min(F.transform("all", lambda c: F.struct(key(c).alias("key"), c["cid"].alias("cid"))))).drop("all")  # noqa: B023
        names.append(f"__b{k}")
    best = F.col(names[0]) if len(names) == 1 else F.least(*names)
    return out.withColumn("best", best).drop("__v", *names)


def assign_nearest(points: DataFrame, centroids: DataFrame, cid: str = "cluster_id", emb: str = "embedding") -> DataFrame:
    """Adds cluster_id: the nearest centroid by Euclidean distance, ties by the smaller id; null without centroids."""
    return _best(points, centroids, cid, emb, "distance").withColumn(cid, F.col("best.cid")).drop("best")


def most_similar(points: DataFrame, centroids: DataFrame, cid: str = "cluster_id", emb: str = "embedding") -> DataFrame:
    """Adds the centroid of the largest cosine similarity, and the similarity."""
    return _best(points, centroids, cid, emb, "cosine").withColumn(cid, F.col("best.cid")).withColumn("similarity", -F.col("best.key")).drop("best")


def pairwise(centroids: DataFrame, value: Column, cid: str = "cluster_id", emb: str = "embedding") -> DataFrame:
    """(a, b, w) for a < b over centroids, with value of va and vb; the number of centroids is checked first."""
    n = centroids.count()
    if n > BLOCK:
        raise ValueError(f"{n} centroids; all pairs are made for at most {BLOCK}")
    rows = centroids.select(F.col(cid).alias("cid"), doubles(F.col(emb)).alias("v"))
    left, right = rows.select(F.col("cid").alias("a"), F.col("v").alias("va")), F.broadcast(rows.select(F.col("cid").alias("b"), F.col("v").alias("vb")))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", value.alias("w"))


def affinity(centroids: DataFrame, alpha: float = 0.9, cid: str = "cluster_id", emb: str = "embedding") -> DataFrame:
    """(a, b, w), a < b: alpha times the cosine similarity, clipped to [0, 1]. (The co-occurrence term is zero for one label a line.)"""
    unit_rows = centroids.select(cid, unit_soft(doubles(F.col(emb))).alias(emb))
    cos = F.least(F.greatest(dot(F.col("va"), F.col("vb")), F.lit(0.0)), F.lit(1.0))
    return pairwise(unit_rows, F.least(F.greatest(alpha * cos, F.lit(0.0)), F.lit(1.0)), cid, emb)


def cooccurrence(lines: DataFrame, cid: str = "cluster_id", line: str = "line_no") -> DataFrame:
    """(a, b, n), a < b: lines on which both clusters occur."""
    held = lines.select(line, cid).distinct().groupBy(line).agg(F.sort_array(F.collect_set(cid)).alias("ids")).where(F.size("ids") > 1)
    pairs = held.select(F.explode("ids").alias("a"), "ids").select("a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def knn_sparsify(edges: DataFrame, k: int) -> DataFrame:
    """(a, b, w), both directions: each node keeps its k heaviest edges (ties by the other node); an edge stays if either end keeps it."""
    both = edges.select("a", "b", "w").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    if k <= 0:
        return both
    kept = both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))).where(F.col("n") <= k).select("a", "b", "w")
    return kept.union(kept.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w"))


def near_pairs(centroids: DataFrame, threshold: float = 0.995, most: int = 200, cid: str = "cluster_id", emb: str = "embedding") -> DataFrame:
    """(a, b, w): pairs of centroids over the cosine threshold; none are looked for beyond `most` centroids."""
    value = cosine(F.col("va"), F.col("vb"))
    if centroids.count() > most:
        return centroids.sparkSession.createDataFrame([], f"a {dict(centroids.dtypes)[cid]}, b {dict(centroids.dtypes)[cid]}, w double")
    return pairwise(centroids, value, cid, emb).where(F.col("w") > threshold)


def norm_stats(vectors: DataFrame, emb: str = "embedding") -> DataFrame:
    """(n, mean, std, min, max, zeros) of the norms; std of the population."""
    n = norm(doubles(F.col(emb))).alias("x")
    return vectors.select(n).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count_if(F.col("x") == 0).alias("zeros"))


def percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """One column p5, p25 and so on, exact with linear interpolation."""
    return rows.agg(*(F.percentile(value, F.lit(s)).alias(f"p{round(100 * s)}") for s in shares))


def balance(sizes: DataFrame, size: str = "n") -> DataFrame:
    """(balance): half p10 over the median, half the median over p90, clipped to [0, 1]; 0 without sizes or for a median of 0."""
    p = sizes.agg(*(F.percentile(size, F.lit(s)).alias(f"p{round(100 * s)}") for s in (0.1, 0.5, 0.9)))
    raw = 0.5 * F.try_divide(F.col("p10"), F.col("p50")) + 0.5 * (F.col("p50") / (F.col("p90") + 1e-9))
    return p.select(F.when(F.coalesce(F.col("p50"), F.lit(0.0)) <= 0, 0.0).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).alias("balance"))


def sized_clusters(labels: DataFrame, cid: str = "cluster_id") -> DataFrame:
    """(cluster_id, n)."""
    return labels.groupBy(cid).agg(F.count("*").alias("n"))


def largest_clusters(labels: DataFrame, most: int = 10, cid: str = "cluster_id") -> DataFrame:
    """The `most` largest clusters (cluster_id, n), ties by id."""
    return sized_clusters(labels, cid).orderBy(F.desc("n"), cid).limit(most)


def cluster_sizes(labels: DataFrame, cid: str = "cluster_id") -> DataFrame:
    """(clusters, min, median, max, small): sizes of clusters, and how many have at most five rows."""
    sizes = sized_clusters(labels, cid)
    return sizes.agg(F.count("*").alias("clusters"), F.min("n").alias("min"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("max"), F.count_if(F.col("n") <= 5).alias("small"))


def normalized(vectors: DataFrame, emb: str = "embedding", soft: bool = False) -> DataFrame:
    """Vectors of norm one, by either rule for small norms."""
    return vectors.withColumn(emb, unit_soft(doubles(F.col(emb))) if soft else unit(doubles(F.col(emb))))


def hashed_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """At most n rows, in order of a seeded digest of the key: the same rows whatever the partitions."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def pooled(hidden: Column, mask: Column, how: str = "mean") -> Column:
    """Pools token vectors (array<array<double>>) by mean or max over the mask, or takes the first."""
    if how == "cls":
        return F.element_at(hidden, 1)
    kept = F.transform(F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda z: z["m"] > 0), lambda z: z["h"])
    fold = (lambda a, b: F.greatest(a, b)) if how == "max" else (lambda a, b: a + b)
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.get(kept, F.lit(0)), lambda s, v: F.zip_with(s, v, fold))
    return total if how == "max" else F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
