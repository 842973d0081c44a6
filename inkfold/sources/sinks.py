"""Sinks: lines, JSON, embeddings, bundles, lexicon files and mask tables."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.images import decode_png, encode_png
from inkfold.operators.lexicon import export_rows


def write_lines(rows: DataFrame, path: str, text: str = "text", mode: str = "overwrite") -> None:
    """One sentence a line; line feeds inside become spaces."""
    rows.select(F.trim(F.regexp_replace(text, r"[\r\n]+", " ")).alias("value")).where("value <> ''").write.mode(mode).text(path)


def write_sorted_unique(rows: DataFrame, path: str, text: str = "text", before: DataFrame | None = None) -> None:
    """Distinct lines in code-point order, with those of an earlier output if given."""
    lines = rows.select(F.col(text).alias("value"))
    lines = lines if before is None else lines.unionByName(before.select(F.col(text).alias("value")))
    lines.where("value <> ''").distinct().orderBy("value").write.mode("overwrite").text(path)


def write_token_lines(rows: DataFrame, path: str, tokens: str = "tokens") -> None:
    """Tokens of a row on a line, with spaces."""
    rows.select(F.array_join(tokens, " ").alias("value")).where("value <> ''").write.mode("overwrite").text(path)


def write_records(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines."""
    rows.write.mode(mode).json(path)


def write_vectors(rows: DataFrame, path: str, emb: str = "emb") -> None:
    """Parquet with 32-bit vectors; keys stay beside them."""
    rows.withColumn(emb, F.col(emb).cast("array<float>")).write.mode("overwrite").parquet(path)


def write_json_value(rows: DataFrame, path: str, value: Column) -> None:
    """One JSON text for each row."""
    rows.select(F.to_json(value).alias("value")).write.mode("overwrite").text(path)


def json_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(value): one JSON object of a table whose rows are known to be few."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))
    return rows.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_side_files(folder: str, super_map: DataFrame, names: DataFrame, keywords: DataFrame) -> None:
    """The three files beside a runtime bundle, each one JSON object by id: clusters' super-categories, names, and keywords in order."""
    lists = keywords.groupBy("super_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("words"))
    json_map(super_map, "cluster_id", "super_id").write.mode("overwrite").text(f"{folder}/centroid_to_super.json")
    json_map(names, "super_id", "name").write.mode("overwrite").text(f"{folder}/super_names.json")
    json_map(lists, "super_id", "words").write.mode("overwrite").text(f"{folder}/super_keywords.json")


def preview_report(super_map: DataFrame, edges: DataFrame, keywords: DataFrame, most: int = 40) -> DataFrame:
    """(super_id, report): for each super-category a paragraph with its clusters, its most central one, and its first `most` tokens with counts.

    super_map: (cluster_id, super_id); edges: (a, b, w) of the affinity;
    keywords: (super_id, token, n, place). Central is the cluster with the
    largest sum of weights to the others of its super-category, ties by id.
    """
    of = super_map.select(F.col("cluster_id").alias("c"), "super_id")
    both = edges.select("a", "b", "w").unionAll(edges.select("b", "a", "w"))
    inner = both.join(of, F.col("a") == F.col("c")).drop("c").join(of.select(F.col("c"), F.col("super_id").alias("other")), F.col("b") == F.col("c")).where("super_id = other")
    sums = of.join(inner.groupBy(F.col("a").alias("c")).agg(F.sum("w").alias("w")), "c", "left").fillna(0.0, ["w"])
    members = sums.groupBy("super_id").agg(F.sort_array(F.collect_list("c")).alias("members"), F.max_by("c", F.struct("w", (-F.col("c")).alias("t"))).alias("central"))
    tokens = keywords.where(F.col("place") <= most).groupBy("super_id").agg(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(":", "token", F.col("n").cast("string")).alias("t")))).alias("l"))
    text = F.concat(
        F.lit("[super "), F.col("super_id").cast("string"), F.lit("]\n members: ["), F.array_join(F.col("members").cast("array<string>"), ", "), F.lit("]\n central: "), F.col("central").cast("string"),
        F.lit("\n top_tokens: "), F.coalesce(F.array_join(F.transform("l", lambda x: x["t"]), ", "), F.lit("")),
    )
    return members.join(tokens, "super_id", "left").select("super_id", text.alias("report"))


def write_class_files(lexicon: DataFrame, path: str) -> None:
    """CSV files of rows with a class, one folder for each class; rows without one go by pos (see write_lexicon)."""
    classed = lexicon.where(F.nullif(F.col("class_name"), F.lit("")).isNotNull())
    rows = export_rows(classed, extra=("class_name",))
    rows.write.mode("overwrite").partitionBy("class_name").csv(path, quote='"', escape='"', emptyValue="")


def write_shards(rows: DataFrame, path: str, shard: str = "shard", mode: str = "append") -> None:
    """Rows under one folder for each shard, added to what is there: all shards in one job."""
    rows.write.mode(mode).partitionBy(shard).parquet(path)


def write_npy(rows: DataFrame, path: str, order: str, value: str, dtype: str = "float32") -> int:
    """One .npy file of a column of vectors or numbers, in order of a key; returns the number of rows.

    Rows come to the driver part by part and go straight to the file, so
    only one part is in memory; the file system is whatever the path names.
    """
    from numpy.lib import format as npy
    from pyarrow import fs

    n, first = rows.count(), rows.select(value).first()
    shape = (n,) if first is None or not isinstance(first[0], list) else (n, len(first[0]))
    files, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with files.open_output_stream(place) as out:
        npy.write_array_header_2_0(out, {"descr": npy.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": shape})
        for r in rows.select(order, value).orderBy(order).toLocalIterator():
            out.write(np.asarray(r[1], dtype).tobytes())
    return n


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """CSV files without header, one folder for each pos, quoted where needed."""
    rows = export_rows(lexicon)
    rows.withColumn("file_name", F.col("pos")).write.mode("overwrite").partitionBy("file_name").csv(path, quote='"', escape='"', emptyValue="")


def write_table(rows: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """A database table through JDBC; mode overwrite drops and creates it."""
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def write_mask_table(masks: DataFrame, path: str) -> None:
    """Mask metadata as CSV with a header."""
    names = ["id", "area", *(f"bbox_{c}" for c in ("x0", "y0", "w", "h")), "point_input_x", "point_input_y", "predicted_iou", "stability_score", *(f"crop_box_{c}" for c in ("x0", "y0", "w", "h"))]
    flat = masks.select(
        F.col("mask_id"), "area", *(F.col("bbox")[k] for k in range(4)), F.col("point_coords")[0][0], F.col("point_coords")[0][1], "predicted_iou", "stability_score", *(F.col("crop_box")[k] for k in range(4))
    ).toDF(*names)
    flat.write.mode("overwrite").csv(path, header=True)


def write_mask_images(masks: DataFrame, path: str) -> None:
    """One black and white PNG file for each mask (mask_id, counts in column order, height, width), beside the table of write_mask_table.

    Executors write to the file system that the path names, which all of them must reach.
    """

    def run(rows: Iterable) -> None:
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        files.create_dir(place, recursive=True)
        for r in rows:
            on = np.repeat(np.arange(len(r["counts"])) % 2 == 1, r["counts"]).reshape(r["width"], r["height"]).T
            with files.open_output_stream(f"{place}/{str(r['mask_id']).replace('/', '_')}.png") as out:
                out.write(encode_png(on.astype(np.uint8) * 255))

    masks.select("mask_id", "counts", "height", "width").foreachPartition(run)


def cut_outs(images: DataFrame, masks: DataFrame, margin: int = 10) -> DataFrame:
    """(image_id, mask_id, png): each mask's box with a margin, cut out of its image, with what lies outside the mask transparent.

    images: (image_id, content), PNG files; masks: (image_id, mask_id,
    counts in column order). Empty masks and images that cannot be read have
    no rows.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in frames:
            out = []
            for image, mask, content, counts in zip(pdf["image_id"], pdf["mask_id"], pdf["content"], pdf["counts"], strict=True):
                pixels = decode_png(content)
                if pixels is None:
                    continue
                h, w = pixels.shape[:2]
                on = np.repeat(np.arange(len(counts)) % 2 == 1, counts).reshape(w, h).T
                ys, xs = np.flatnonzero(on.any(axis=1)), np.flatnonzero(on.any(axis=0))
                if not len(ys):
                    continue
                y0, y1, x0, x1 = max(0, ys[0] - margin), min(h, ys[-1] + 1 + margin), max(0, xs[0] - margin), min(w, xs[-1] + 1 + margin)
                cut = np.dstack([pixels, on.astype(np.uint8) * 255])[y0:y1, x0:x1]
                out.append((image, mask, encode_png(cut)))
            yield pd.DataFrame(out, columns=["image_id", "mask_id", "png"])

    kinds = dict(images.dtypes), dict(masks.dtypes)
    both = masks.select("image_id", "mask_id", F.col("counts").cast("array<long>").alias("counts")).join(images.select("image_id", "content"), "image_id")
    return both.mapInPandas(run, f"image_id {kinds[0]['image_id']}, mask_id {kinds[1]['mask_id']}, png binary")


def encoded_images(rows: DataFrame, content: str = "png") -> DataFrame:
    """Adds a random id and the base64 text of a binary column."""
    return rows.withColumn("object_id", F.expr("uuid()")).withColumn("image_base64", F.base64(content))
