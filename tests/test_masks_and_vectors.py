"""Masks and vectors against plain Python and numpy."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from inkfold.operators import clustering, masks, taxonomy, vectors


def test_suppression_leaves_no_overlap(spark):
    rng = np.random.default_rng(1)
    xy = rng.integers(0, 50, (60, 2))
    rows = [(0, i, float(x), float(y), float(x + 10), float(y + 10), float(s)) for i, ((x, y), s) in enumerate(zip(xy, rng.random(60), strict=True))]
    kept = masks.suppress(spark.createDataFrame(rows, "image_id int, box_id int, x0 double, y0 double, x1 double, y1 double, score double"), 0.3).collect()
    for a in kept:
        for b in kept:
            if a["box_id"] < b["box_id"]:
                w = max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
                assert w / (200 - w) <= 0.3


@settings(max_examples=40, deadline=None)
@given(hs.lists(hs.booleans(), min_size=1, max_size=40))
def test_small_regions(bits):
    mask = np.array(bits * 2).reshape(2, -1)
    out, changed = masks.small_regions_removed(mask, 3, False)
    assert changed or np.array_equal(out, mask)
    assert not (out & ~mask).any()


def test_coco_counts(spark):
    got = spark.createDataFrame([([0, 5, 40],), (None,)], "c array<int>").select(masks.coco_counts(F.col("c")).alias("s")).collect()
    assert got[0]["s"] == "05X1" and got[1]["s"] is None


def test_region_removal_on_run_lengths(spark):
    rows = spark.createDataFrame([(1, 3, 3, [4, 1, 4])], "mask_id int, height int, width int, counts array<long>")
    assert masks.remove_small_regions(rows, 1).first()["changed"] is False


def test_agglomeration_is_average_linkage():
    edges = [(0, 1, 0.9), (2, 3, 0.8), (1, 2, 0.3)]
    assert clustering.agglomerate(edges, [0, 1, 2, 3], 2) == {0: 0, 1: 0, 2: 1, 3: 1}
    assert len(set(clustering.agglomerate(edges, [0, 1, 2, 3], 1).values())) == 1
    assert clustering.k_candidates(100) == [80, 90, 100, 110, 120]


def test_assignment_in_blocks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, rng.random(4).tolist()) for i in range(40)], "vec_id int, embedding array<double>")
    centers = spark.createDataFrame([(i, rng.random(4).tolist()) for i in range(9)], "cluster_id int, embedding array<double>")
    whole = {r["vec_id"]: r["cluster_id"] for r in vectors.assign_nearest(points, centers).collect()}
    monkeypatch.setattr(vectors, "BLOCK", 4)
    assert {r["vec_id"]: r["cluster_id"] for r in vectors.assign_nearest(points, centers).collect()} == whole


def test_pooling(spark):
    row = spark.createDataFrame([([[1.0, 2.0], [3.0, 5.0], [9.0, 9.0]], [1, 1, 0])], "h array<array<double>>, m array<int>")
    got = row.select(*(vectors.pooled(F.col("h"), F.col("m"), how).alias(how) for how in ("mean", "max", "cls"))).first()
    assert got["mean"] == [2.0, 3.5] and got["max"] == [3.0, 5.0] and got["cls"] == [1.0, 2.0]


def test_bundle_and_map_forms(spark):
    forms = spark.createDataFrame([('{"0": 2, "1": 0}',), ("[2, 0]",)], "t string").select(taxonomy.parse_super_map(F.col("t")).alias("m")).collect()
    assert all([(e["cluster_id"], e["super_id"]) for e in sorted(r["m"])] == [(0, 2), (1, 0)] for r in forms)
    m = spark.createDataFrame([(0, 1), (1, 1)], "cluster_id int, super_id int")
    names = spark.createDataFrame([(1, "sky")], "super_id int, name string")
    words = spark.createDataFrame([(1, "cloud", 3, 1), (1, "sun", 2, 2)], "super_id int, token string, n long, place int")
    assert taxonomy.bundle(m, names, words, "a\\b").first()["bundle"] == '{"centroids_path":"a/b","centroid_to_super":[1,1],"super_names":{"1":"sky"},"super_keywords":{"1":["cloud","sun"]}}'


def test_euclidean_silhouette_reads_every_row(spark):
    n = 20_300
    rng = np.random.default_rng(3)
    x, label = np.round(rng.normal(size=(n, 2)), 3), rng.integers(0, 3, n)
    x += 2 * label[:, None]
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": range(n), "cluster_id": label, "embedding": x.tolist()}))
    hot, want = np.eye(3)[label], []
    size = hot.sum(axis=0)
    for v, c in zip(x, label, strict=True):
        s = np.sqrt(((x - v) ** 2).sum(axis=1)) @ hot
        a, b = s[c] / (size[c] - 1), min(s[k] / size[k] for k in range(3) if k != c)
        want.append((b - a) / max(a, b))
    assert abs(clustering.silhouette_euclid(rows).first()[0] - np.mean(want)) < 1e-9
    few = rows.where("vec_id < 40")
    assert abs(clustering.silhouette_euclid(few, block=9).first()[0] - clustering.silhouette_euclid(few).first()[0]) < 1e-12
    assert clustering.silhouette_euclid(rows.where("cluster_id = 1 and vec_id < 40")).first()[0] == 0.0


def plain_coco(counts):
    out = []
    for i, c in enumerate(counts):
        x = c - (counts[i - 2] if i > 2 else 0)
        while True:
            bits, x = x & 31, x >> 5
            more = x != (-1 if bits & 16 else 0)
            out.append(chr(48 + bits + (32 if more else 0)))
            if not more:
                break
    return "".join(out)


def test_compressed_run_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(0, 10 ** int(rng.integers(1, 7)), int(rng.integers(0, 30))).tolist()) for k in range(60)] + [(90, None), (91, [])]
    got = spark.createDataFrame(rows, "mask_id int, counts array<long>").select("mask_id", masks.coco_counts("counts").alias("c")).collect()
    assert {r["mask_id"]: r["c"] for r in got} == {k: None if c is None else plain_coco(c) for k, c in rows}


def test_sweep_and_spectral_groups(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(4, 6)) * 5
    rows = [(i, (middles[i % 4] + rng.normal(size=6) * 0.2).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best, report, (centers, labelled) = clustering.k_sweep(table, 4, sample=80)
    assert [k for k, _, _ in report] == clustering.k_candidates(4) and best == max(report, key=lambda r: r[1])[0] == 4
    groups = {}
    for r in labelled.collect():
        groups.setdefault(r["cluster_id"], set()).add(r["vec_id"] % 4)
    assert centers.count() == 4 and all(len(g) == 1 for g in groups.values())
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 0.01)], "a int, b int, w double")
    found = {r["cluster_id"]: r["super_id"] for r in clustering.spectral_groups(edges, 2).collect()}
    assert len(found) == 6 and set(found.values()) <= {0, 1}
