"""Queries on generated masks, boxes and crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.operators import masks
from inkfold.plans.registry import query
from inkfold.plans.text_queries import GREEDY_SQL

#: Discs of growing size on a raster of 24 by 32 pixels; mask 0 is empty, mask 11 full.
PIXELS_SQL = "px AS (SELECT m AS mask_id, y, x, (CASE WHEN m = 0 THEN -9.0 WHEN m = 11 THEN 9.0 ELSE (m * m * 4 - (x - 16) * (x - 16) - (y - 12) * (y - 12)) / 10.0 END)::DOUBLE AS logit FROM range(12) a(m), range(24) b(y), range(32) c(x))"
ON_SQL = f"{PIXELS_SQL}, o AS (SELECT mask_id, y, x, x * 24 + y AS p, logit > 0 AS is_on FROM px)"


def pixels(spark):
    m, y, x = F.floor(F.col("id") / 768), F.floor(F.col("id") % 768 / 32), F.col("id") % 32
    disc = (m * m * 4 - (x - 16) * (x - 16) - (y - 12) * (y - 12)) / 10.0
    return spark.range(12 * 768).select(m.alias("mask_id"), y.alias("y"), x.alias("x"), F.when(m == 0, -9.0).when(m == 11, 9.0).otherwise(disc).cast("double").alias("logit"))


def coded(spark):
    return masks.encode_rle(masks.binarized(pixels(spark)), F.lit(24))


RUNS_SQL = f"""{ON_SQL}, ch AS (SELECT *, CASE WHEN lag(is_on) OVER w IS DISTINCT FROM is_on THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY mask_id ORDER BY p)),
rn AS (SELECT mask_id, is_on, sum(new) OVER (PARTITION BY mask_id ORDER BY p) AS run FROM ch), sz AS (SELECT mask_id, run, any_value(is_on) AS is_on, count(*) AS n FROM rn GROUP BY mask_id, run),
rle AS (SELECT mask_id, list_concat(CASE WHEN first(is_on ORDER BY run) THEN [0] ELSE [] END, list(n ORDER BY run)) AS counts FROM sz GROUP BY mask_id)"""


@query(f"WITH {RUNS_SQL} SELECT mask_id, array_to_string(counts, ',') AS counts FROM rle")
def mask_rle(spark, sf_dir):
    return coded(spark).select("mask_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query(f"WITH {ON_SQL} SELECT mask_id, count(*) FILTER (is_on) AS area FROM o GROUP BY mask_id")
def mask_rle_area(spark, sf_dir):
    return coded(spark).select("mask_id", masks.rle_area(F.col("counts")).alias("area"))


@query(f"WITH {ON_SQL} SELECT mask_id, y, x, is_on FROM o")
def rle_round_trip(spark, sf_dir):
    return masks.decode_rle(coded(spark).withColumn("height", F.lit(24).cast("long"))).select("mask_id", "y", "x", F.col("on").alias("is_on"))


@query(f"WITH {ON_SQL} SELECT mask_id, coalesce(min(x) FILTER (is_on), 0) AS x0, coalesce(min(y) FILTER (is_on), 0) AS y0, coalesce(max(x) FILTER (is_on), 0) AS x1, coalesce(max(y) FILTER (is_on), 0) AS y1 FROM o GROUP BY mask_id")
def mask_boxes(spark, sf_dir):
    return masks.mask_boxes(masks.binarized(pixels(spark)))


@query(f"WITH {PIXELS_SQL} SELECT mask_id, round(CASE WHEN count(*) FILTER (logit > -1) > 0 THEN count(*) FILTER (logit > 1) / count(*) FILTER (logit > -1) END, 6) AS stability FROM px GROUP BY mask_id")
def mask_stability(spark, sf_dir):
    return masks.stability(pixels(spark)).withColumn("stability", F.round("stability", 6))


BOXES_SQL = "bx AS (SELECT i AS box_id, i % 4 AS image_id, (i * 37 % 90)::DOUBLE AS x0, (i * 53 % 70)::DOUBLE AS y0, (i * 37 % 90 + 8 + i % 11)::DOUBLE AS x1, (i * 53 % 70 + 9 + i % 7)::DOUBLE AS y1, (i * 29 % 100)::DOUBLE AS score FROM range(200) t(i))"


def boxes(spark):
    i = F.col("id")
    d = lambda c, n: c.cast("double").alias(n)
    return spark.range(200).select(i.alias("box_id"), (i % 4).alias("image_id"), d(i * 37 % 90, "x0"), d(i * 53 % 70, "y0"), d(i * 37 % 90 + 8 + i % 11, "x1"), d(i * 53 % 70 + 9 + i % 7, "y1"), d(i * 29 % 100, "score"))


@query(f"WITH {BOXES_SQL} SELECT box_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM bx")
def box_xywh(spark, sf_dir):
    return boxes(spark).select("box_id", *(c.alias(n) for c, n in zip(masks.xyxy_to_xywh(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))), "xywh", strict=True)))


IOU_SQL = """pairs AS (SELECT a.box_id AS i, b.box_id AS j, b.image_id, b.score, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS inter,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS both_areas FROM bx a JOIN bx b ON a.image_id = b.image_id AND (a.score > b.score OR a.score = b.score AND a.box_id < b.box_id)),
over AS (SELECT * FROM pairs WHERE inter / (both_areas - inter) > 0.3)"""


@query(f"WITH RECURSIVE {BOXES_SQL}, {IOU_SQL}, {GREEDY_SQL.replace('FROM pairs', 'FROM over').format(order='image_id, score DESC, j', by='j, image_id, score')} SELECT * FROM bx WHERE box_id NOT IN (SELECT id FROM gone)")
def mask_nms(spark, sf_dir):
    return masks.suppress(boxes(spark), 0.3)


EDGE_SQL = "((abs({b} + {o} - {c}) <= 20) AND NOT (abs({b} + {o} - {i}) <= 20))"


@query(
    f"WITH {BOXES_SQL} SELECT box_id FROM bx WHERE NOT ("
    + " OR ".join(EDGE_SQL.format(b=b, o=o, c=c, i=i) for b, o, c, i in (("x0", 40, 40, 0), ("y0", 30, 30, 0), ("x1", 40, 140, 300), ("y1", 30, 120, 300)))
    + ")"
)
def crop_edge_filter(spark, sf_dir):
    rows = boxes(spark).select("*", F.lit(40).alias("cx0"), F.lit(30).alias("cy0"), F.lit(140).alias("cx1"), F.lit(120).alias("cy1"), F.lit(0).alias("ix0"), F.lit(0).alias("iy0"), F.lit(300).alias("ix1"), F.lit(300).alias("iy1"))
    return rows.where(~masks.near_crop_edge(("x0", "y0", "x1", "y1"), ("cx0", "cy0", "cx1", "cy1"), ("ix0", "iy0", "ix1", "iy1"))).select("box_id")


IMAGES_SQL = "im AS (SELECT i AS image_id, 200 + i * 37 AS height, 300 + i * 61 AS width FROM range(10) t(i))"


def images(spark):
    return spark.range(10).select(F.col("id").alias("image_id"), (200 + F.col("id") * 37).alias("height"), (300 + F.col("id") * 61).alias("width"))


def crop_layer_sql(k: int) -> str:
    n = 2 ** (k + 1)
    return f"""SELECT image_id, {k + 1} AS layer, (w - overlap) * i AS x0, (h - overlap) * j AS y0, least((w - overlap) * i + w, width) AS x1, least((h - overlap) * j + h, height) AS y1
FROM (SELECT *, ceil((overlap * {n - 1} + width) / {n})::BIGINT AS w, ceil((overlap * {n - 1} + height) / {n})::BIGINT AS h FROM (SELECT *, floor(512 / 1500 * least(height, width) * (2 / {n}))::BIGINT AS overlap FROM im)), range({n}) a(i), range({n}) b(j)"""


@query(f"WITH {IMAGES_SQL}, c AS (SELECT image_id, 0 AS layer, 0 AS x0, 0 AS y0, width AS x1, height AS y1 FROM im UNION ALL {crop_layer_sql(0)} UNION ALL {crop_layer_sql(1)}) SELECT image_id, layer::INT AS layer, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1 FROM c")
def crop_boxes(spark, sf_dir):
    return masks.crop_boxes(images(spark), 2)


@query("SELECT round((i + 0.5) / 8, 9) AS x, round((j + 0.5) / 8, 9) AS y FROM range(8) a(i), range(8) b(j)")
def point_grid(spark, sf_dir):
    return masks.point_grid(spark, 8).select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(f"WITH {IMAGES_SQL} SELECT image_id, floor(height * (1024 / greatest(height, width)) + 0.5)::INT AS h, floor(width * (1024 / greatest(height, width)) + 0.5)::INT AS w FROM im")
def resize_shape(spark, sf_dir):
    h, w = masks.resized_shape(F.col("height"), F.col("width"))
    return images(spark).select("image_id", h.alias("h"), w.alias("w"))


@query("WITH p AS (SELECT i // 4 AS prompt_id, (i % 4)::INT AS mask_idx, (i * 31 % 97) / 100.0::DOUBLE AS iou, (1 + i // 4 % 4)::INT AS n FROM range(80) t(i)), s AS (SELECT *, iou + (n - 2.5) * CASE WHEN mask_idx = 0 THEN 1000 ELSE 0 END AS s FROM p) SELECT prompt_id, mask_idx, iou::DOUBLE AS iou FROM s QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY s DESC, mask_idx) = 1")
def best_mask(spark, sf_dir):
    i = F.col("id")
    rows = spark.range(80).select(F.floor(i / 4).alias("prompt_id"), (i % 4).cast("int").alias("mask_idx"), ((i * 31 % 97) / F.lit(100.0)).alias("iou"), (1 + F.floor(i / 4) % 4).cast("int").alias("n_points"))
    return masks.best_mask(rows)


CROP_SQL = "cb AS (SELECT *, 10 * image_id AS cx, 5 * image_id AS cy, 400 AS w, 300 AS h FROM bx)"


def cropped_boxes(spark):
    at = {"crop_x0": 10, "crop_y0": 5}
    return boxes(spark).select("*", *((n * F.col("image_id")).alias(c) for c, n in at.items()), F.lit(400).alias("width"), F.lit(300).alias("height"))


@query(f"WITH {BOXES_SQL}, {CROP_SQL} SELECT box_id, x0 + cx AS x0, y0 + cy AS y0, x1 + cx AS x1, y1 + cy AS y1 FROM cb")
def uncropped_boxes(spark, sf_dir):
    return masks.uncropped(cropped_boxes(spark)).select("box_id", *(F.col(f"full_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"WITH {BOXES_SQL}, {CROP_SQL} SELECT box_id, x0 + cx AS x, y0 + cy AS y FROM cb")
def uncropped_points(spark, sf_dir):
    points = cropped_boxes(spark).select("box_id", F.col("x0").alias("x"), F.col("y0").alias("y"), "crop_x0", "crop_y0")
    return masks.uncropped_points(points).select("box_id", F.col("full_x").alias("x"), F.col("full_y").alias("y"))


@query(f"WITH {BOXES_SQL}, {CROP_SQL} SELECT box_id, greatest(x0 - 10, 0) AS x0, greatest(y0 - 10, 0) AS y0, least(x1 + 10, w) AS x1, least(y1 + 10, h) AS y1 FROM cb")
def margin_boxes(spark, sf_dir):
    return cropped_boxes(spark).select("box_id", *masks.margin_box(10))


SCALE_SQL = "s AS (SELECT *, floor(w * (1024 / greatest(h, w)) + 0.5) / w AS fx, floor(h * (1024 / greatest(h, w)) + 0.5) / h AS fy FROM cb)"


@query(f"WITH {BOXES_SQL}, {CROP_SQL}, {SCALE_SQL} SELECT box_id, round(x0 * fx, 6) AS x0, round(y0 * fy, 6) AS y0, round(x1 * fx, 6) AS x1, round(y1 * fy, 6) AS y1 FROM s")
def scaled_boxes(spark, sf_dir):
    return masks.scaled_boxes(cropped_boxes(spark)).select("box_id", *(F.round(f"s{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"WITH {BOXES_SQL}, {CROP_SQL}, {SCALE_SQL} SELECT box_id, round(x0 * fx, 6) AS x, round(y0 * fy, 6) AS y FROM s")
def scaled_points_of_images(spark, sf_dir):
    points = cropped_boxes(spark).select("box_id", F.col("x0").alias("x"), F.col("y0").alias("y"), "width", "height")
    return masks.scaled_coordinates(points).select("box_id", F.round("sx", 6).alias("x"), F.round("sy", 6).alias("y"))


@query(f"WITH {IMAGES_SQL} SELECT image_id, floor(height * (512 / greatest(height, width)))::INT AS h, floor(width * (512 / greatest(height, width)))::INT AS w FROM im")
def limited_shapes(spark, sf_dir):
    h, w = masks.limited_shape(F.col("height"), F.col("width"))
    return images(spark).select("image_id", h.alias("h"), w.alias("w"))


@query(f"WITH {IMAGES_SQL}, c AS (SELECT image_id, 0 AS layer, 0 AS x0, 0 AS y0, width AS x1, height AS y1 FROM im UNION ALL {crop_layer_sql(0)}), n AS (SELECT layer, 4 // (layer + 1) AS n FROM range(2) t(layer)), g AS (SELECT layer, (i + 0.5) / n AS gx, (j + 0.5) / n AS gy FROM n, range(4) a(i), range(4) b(j) WHERE i < n AND j < n) SELECT image_id, layer::INT AS layer, x0::INT AS x0, y0::INT AS y0, round(gx * (x1 - x0), 6) AS px, round(gy * (y1 - y0), 6) AS py FROM c JOIN g USING (layer)")
def grid_points_of_crops(spark, sf_dir):
    placed = masks.scaled_points(masks.layer_grids(spark, 4, 1, 2), masks.crop_boxes(images(spark), 1))
    return placed.select("image_id", "layer", "x0", "y0", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


QUALITY_SQL = "q AS (SELECT i AS mask_id, (i * 31 % 100) / 100.0::DOUBLE AS iou, (i * 17 % 100) / 100.0::DOUBLE AS st FROM range(500) t(i))"


@query(f"WITH {QUALITY_SQL} SELECT mask_id FROM q WHERE iou > 0.5 AND st >= 0.4")
def mask_quality_filter(spark, sf_dir):
    i = F.col("id")
    rows = spark.range(500).select(i.alias("mask_id"), ((i * 31 % 100) / F.lit(100.0)).alias("predicted_iou"), ((i * 17 % 100) / F.lit(100.0)).alias("stability_score"))
    return masks.quality_filter(rows, 0.5, 0.4).select("mask_id")


@query(f"WITH {PIXELS_SQL} SELECT mask_id, count(*) FILTER (logit > 0.5) AS area FROM px GROUP BY mask_id HAVING count(*) FILTER (logit > 0.5) >= 100")
def mask_least_pixels(spark, sf_dir):
    return masks.binarized(pixels(spark), 0.5, 100).groupBy("mask_id").agg(F.count_if("on").alias("area"))


@query(f"WITH {ON_SQL} SELECT mask_id, min(x) FILTER (is_on)::INT AS x0, min(y) FILTER (is_on)::INT AS y0, max(x) FILTER (is_on)::INT AS x1, max(y) FILTER (is_on)::INT AS y1, count(*) FILTER (is_on) AS area FROM o GROUP BY mask_id HAVING count(*) FILTER (is_on) > 0")
def mask_boxes_of_runs(spark, sf_dir):
    return masks.with_box(masks.boxes_of_runs(coded(spark).withColumn("height", F.lit(24))))


@query(f"WITH {ON_SQL}, fr AS (SELECT m AS mask_id, y, x FROM range(12) a(m), range(40) b(y), range(50) c(x)), pl AS (SELECT fr.mask_id, fr.x * 40 + fr.y AS p, coalesce(is_on, false) AS is_on FROM fr LEFT JOIN o ON o.mask_id = fr.mask_id AND o.x = fr.x - 7 AND o.y = fr.y - 3) SELECT mask_id, sum(p) FILTER (is_on)::BIGINT AS places, count(*) FILTER (is_on) AS area FROM pl GROUP BY mask_id HAVING count(*) FILTER (is_on) > 0")
def uncropped_mask_runs(spark, sf_dir):
    at = {"crop_x0": 7, "crop_y0": 3, "crop_x1": 39, "crop_y1": 27, "height": 40, "width": 50}
    whole = masks.uncropped_masks(coded(spark).select("*", *(F.lit(n).alias(c) for c, n in at.items())))
    back = masks.decode_rle(whole.withColumn("height", F.lit(40).cast("long"))).where("on")
    return back.groupBy("mask_id").agg(F.sum(F.col("x") * 40 + F.col("y")).alias("places"), F.count("*").alias("area"))


@query(f"WITH {ON_SQL}, b AS (SELECT mask_id, coalesce(min(x) FILTER (is_on), 0) AS x0, coalesce(min(y) FILTER (is_on), 0) AS y0, coalesce(max(x) FILTER (is_on), 0) AS x1, coalesce(max(y) FILTER (is_on), 0) AS y1, count(*) FILTER (is_on) AS area FROM o GROUP BY mask_id) SELECT mask_id, area, x0::DOUBLE AS x, y0::DOUBLE AS y, (x1 - x0)::DOUBLE AS w, (y1 - y0)::DOUBLE AS h, 32.0::DOUBLE AS crop_w, mask_id::DOUBLE AS px FROM b")
def mask_record_fields(spark, sf_dir):
    shape = {"crop_x0": 0, "crop_y0": 0, "crop_x1": 32, "crop_y1": 24, "height": 24, "width": 32}
    rows = coded(spark).join(masks.mask_boxes(masks.binarized(pixels(spark))), "mask_id").select("*", *(F.lit(n).alias(c) for c, n in shape.items()), F.lit(0.9).alias("predicted_iou"), F.lit(0.9).alias("stability_score"), F.col("mask_id").alias("point_x"), F.lit(1).alias("point_y"))
    made = masks.mask_records(rows)
    return made.select("mask_id", "area", *(F.col("bbox")[k].alias(c) for k, c in enumerate("xywh")), F.col("crop_box")[2].alias("crop_w"), F.col("point_coords")[0][0].alias("px"))


@query("SELECT y, x, round((y + 0.5) / 6, 9) AS py, round((x + 0.5) / 9, 9) AS px, round(sin(2 * pi() * ((2 * (x + 0.5) / 9 - 1) * 0.3 + (2 * (y + 0.5) / 6 - 1) * -0.7)), 6) + 0.0 AS s, round(cos(2 * pi() * ((2 * (x + 0.5) / 9 - 1) * 0.3 + (2 * (y + 0.5) / 6 - 1) * -0.7)), 6) + 0.0 AS c FROM range(6) a(y), range(9) b(x)")
def position_encodings(spark, sf_dir):
    made = masks.position_encoding(masks.position_grid(spark, 6, 9), [(0.3, -0.7)])
    return made.select("y", "x", F.round("py", 9).alias("py"), F.round("px", 9).alias("px"), (F.round(F.col("encoding")[0], 6) + 0.0).alias("s"), (F.round(F.col("encoding")[1], 6) + 0.0).alias("c"))


@query(f"WITH {BOXES_SQL} SELECT box_id, CASE WHEN box_id < 100 THEN x0 END AS x0, CASE WHEN box_id >= 100 THEN y0 END AS y0 FROM bx")
def stacked_mask_tables(spark, sf_dir):
    rows = boxes(spark)
    return masks.all_masks(rows.where("box_id < 100").select("box_id", "x0"), rows.where("box_id >= 100").select("box_id", "y0"))
