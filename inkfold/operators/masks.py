"""Mask records: run-length encoding, boxes, stability, crops, filters and suppression.

Masks enter as pixel rows (mask_id, y, x, value) or as run lengths; neural
inference is an outside provider.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.operators.storage import stored


def encode_rle(pixels: DataFrame, height: Column, key: str = "mask_id") -> DataFrame:
    """(key, counts): run lengths in column order, starting with a run of zeros. pixels: (key, y, x, on), every pixel once."""
    at = pixels.select(key, (F.col("x") * height + F.col("y")).alias("at"), F.col("on").cast("boolean").alias("on"))
    order = Window.partitionBy(key).orderBy("at")
    runs = at.withColumn("new", (F.lag("on").over(order).isNull() | (F.lag("on").over(order) != F.col("on"))).cast("int")).withColumn("run", F.sum("new").over(order))
    sizes = runs.groupBy(key, "run").agg(F.count("*").alias("n"), F.first("on").alias("on"))
    listed = sizes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("run", "n", "on"))).alias("runs"))
    counts = F.transform("runs", lambda r: r["n"])
    return listed.select(key, F.when(F.element_at("runs", 1)["on"], F.concat(F.array(F.lit(0).cast("long")), counts)).otherwise(counts).alias("counts"))


def decode_rle(masks: DataFrame, key: str = "mask_id") -> DataFrame:
    """(key, y, x, on) from (key, height, counts). Runs become rows with their ends from one running sum."""
    runs = masks.select(key, "height", F.posexplode(F.col("counts").cast("array<long>")).alias("k", "n"))
    before = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("end", F.sum("n").over(before)).where(F.col("n") > 0)
    at = runs.select(key, "height", (F.col("k") % 2 == 1).alias("on"), F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("at"))
    return at.select(key, (F.col("at") % F.col("height")).alias("y"), F.floor(F.col("at") / F.col("height")).alias("x"), "on")


def rle_area(counts: Column) -> Column:
    """Pixels that are on: every second run."""
    return F.aggregate(F.filter(counts, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x)


def stability(pixels: DataFrame, threshold: float = 0.0, offset: float = 1.0, key: str = "mask_id") -> DataFrame:
    """(key, stability): pixels over the higher threshold per pixels over the lower one; null if there are none."""
    high, low = F.count_if(F.col("logit") > threshold + offset), F.count_if(F.col("logit") > threshold - offset)
    return pixels.groupBy(key).agg(F.try_divide(high.cast("double"), low.cast("double")).alias("stability"))


def mask_boxes(pixels: DataFrame, key: str = "mask_id") -> DataFrame:
    """(key, x0, y0, x1, y1): the box around pixels that are on, ends included; zeros for an empty mask."""
    on = lambda c: F.when(F.col("on"), F.col(c))
    box = pixels.groupBy(key).agg(F.min(on("x")).alias("x0"), F.min(on("y")).alias("y0"), F.max(on("x")).alias("x1"), F.max(on("y")).alias("y1"))
    return box.fillna(0, ["x0", "y0", "x1", "y1"])


def binarized(pixels: DataFrame, threshold: float = 0.0, least: int = 0, key: str = "mask_id") -> DataFrame:
    """Adds on (logit > threshold); masks with fewer than `least` such pixels go."""
    rows = pixels.withColumn("on", F.col("logit") > threshold)
    if least <= 0:
        return rows
    return rows.join(rows.groupBy(key).agg(F.count_if("on").alias("n")).where(F.col("n") >= least).select(key), key, "left_semi")


def quality_filter(masks: DataFrame, iou: float = 0.88, stable: float = 0.95) -> DataFrame:
    """Predicted quality over iou (not tested if iou <= 0), stability at least `stable` (likewise)."""
    kept = masks.where(F.col("predicted_iou") > iou) if iou > 0 else masks
    return kept.where(F.col("stability_score") >= stable) if stable > 0 else kept


def near_crop_edge(box: tuple[str, str, str, str], crop: tuple[str, str, str, str], image: tuple[str, str, str, str], atol: float = 20.0) -> Column:
    """Whether any side of a box in crop coordinates lies near the crop's edge but not near the image's."""
    out = F.lit(False)
    for k in range(4):
        side = F.col(box[k]) + F.col(crop[k % 2])
        out = out | ((F.abs(side - F.col(crop[k])) <= atol) & ~(F.abs(side - F.col(image[k])) <= atol))
    return out


def xyxy_to_xywh(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    return [x0, y0, x1 - x0, y1 - y0]


def uncropped(boxes: DataFrame) -> DataFrame:
    """Boxes moved by the offset of their crop (crop_x0, crop_y0)."""
    return boxes.select("*", *((F.col(c) + F.col(f"crop_{c[0]}0")).alias(f"full_{c}") for c in ("x0", "y0", "x1", "y1")))


def uncropped_points(points: DataFrame) -> DataFrame:
    """Points (x, y) of a crop in the image's frame."""
    return points.select("*", (F.col("x") + F.col("crop_x0")).alias("full_x"), (F.col("y") + F.col("crop_y0")).alias("full_y"))


def uncropped_masks(masks: DataFrame, key: str = "mask_id") -> DataFrame:
    """(key, counts): run lengths of a crop's masks in the frame of the image, off outside the crop.

    masks: (key, counts in column order, crop_x0, crop_y0, crop_x1, crop_y1,
    height, width of the image). Runs move column by column; only the pixels
    that are on are placed.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for counts, x0, y0, x1, y1, h, w in zip(*(pdf[c] for c in ("counts", "crop_x0", "crop_y0", "crop_x1", "crop_y1", "height", "width")), strict=True):
                part = np.repeat(np.arange(len(counts)) % 2 == 1, counts).reshape(x1 - x0, y1 - y0)
                whole = np.zeros((w, h), bool)
                whole[x0:x1, y0:y1] = part
                out.append(run_lengths(whole.reshape(-1)))
            yield pd.DataFrame({key: pdf[key], "counts": out})

    ints = [F.col(c).cast("int").alias(c) for c in ("crop_x0", "crop_y0", "crop_x1", "crop_y1", "height", "width")]
    return masks.select(key, F.col("counts").cast("array<long>").alias("counts"), *ints).mapInPandas(run, f"{key} {dict(masks.dtypes)[key]}, counts array<long>")


def run_lengths(flat: np.ndarray) -> list[int]:
    """Run lengths of a row of pixels, the first of pixels that are off."""
    edge = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True]) if len(flat) else np.zeros(1, int)
    return ([0] if len(flat) and flat[0] else []) + np.diff(edge).tolist()


def with_box(masks: DataFrame) -> DataFrame:
    """Masks whose box (x0, y0, x1, y1, ends included) holds a pixel: empty ones go. area: pixels that are on."""
    return masks.where((F.col("area") > 0) & (F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0")))


def scaled_coordinates(points: DataFrame, long_side: int = 1024) -> DataFrame:
    """Adds sx, sy: points (x, y) in an image (height, width) scaled so that its longer side is long_side."""
    h, w = resized_shape(F.col("height"), F.col("width"), long_side)
    return points.select("*", (F.col("x") * (w / F.col("width"))).alias("sx"), (F.col("y") * (h / F.col("height"))).alias("sy"))


def scaled_boxes(boxes: DataFrame, long_side: int = 1024) -> DataFrame:
    """Adds sx0, sy0, sx1, sy1: boxes (x0, y0, x1, y1) in the scaled image."""
    h, w = resized_shape(F.col("height"), F.col("width"), long_side)
    return boxes.select("*", *((F.col(c) * ((w / F.col("width")) if c[0] == "x" else (h / F.col("height")))).alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")))


def position_grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(y, x, py, px): middles of the cells of a grid, as shares of its height and width."""
    cells = spark.range(height * width).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    return cells.select("y", "x", ((F.col("y") + 0.5) / height).alias("py"), ((F.col("x") + 0.5) / width).alias("px"))


def position_encoding(grid: DataFrame, matrix: list[tuple[float, float]]) -> DataFrame:
    """Adds encoding: sines, then cosines, of 2 pi (2 p - 1) projected by a matrix of (weight of px, weight of py) rows."""
    turn = lambda a, b: ((2 * F.col("px") - 1) * F.lit(a) + (2 * F.col("py") - 1) * F.lit(b)) * F.lit(2 * np.pi)
    return grid.select("*", F.array(*(f(turn(a, b)) for f in (F.sin, F.cos) for a, b in matrix)).alias("encoding"))


def margin_box(margin: int) -> list[Column]:
    """A box (x0, y0, x1, y1) widened by a margin, inside the image (width, height)."""
    return [F.greatest(F.col("x0") - margin, F.lit(0)).alias("x0"), F.greatest(F.col("y0") - margin, F.lit(0)).alias("y0"), F.least(F.col("x1") + margin, F.col("width")).alias("x1"), F.least(F.col("y1") + margin, F.col("height")).alias("y1")]


def point_grid(spark: SparkSession, side: int) -> DataFrame:
    """(x, y): side * side points, evenly spaced in the unit square, row by row."""
    at = lambda c: (F.col(c) + 0.5) / side
    return spark.range(side * side).select((F.col("id") % side).alias("i"), F.floor(F.col("id") / side).alias("j")).select(at("i").alias("x"), at("j").alias("y"))


def layer_grids(spark: SparkSession, side: int, layers: int, scale: int = 1) -> DataFrame:
    """(layer, x, y): a grid for each crop layer, thinner by `scale` from layer to layer."""
    out = None
    for k in range(layers + 1):
        grid = point_grid(spark, int(side / scale**k)).select(F.lit(k).alias("layer"), "x", "y")
        out = grid if out is None else out.union(grid)
    return out


def scaled_points(grids: DataFrame, crops: DataFrame) -> DataFrame:
    """Grid points in the pixels of every crop of their layer."""
    return crops.join(grids, "layer").select("*", (F.col("x") * (F.col("x1") - F.col("x0"))).alias("px"), (F.col("y") * (F.col("y1") - F.col("y0"))).alias("py"))


def crop_boxes(images: DataFrame, layers: int, overlap_ratio: float = 512 / 1500) -> DataFrame:
    """(image_id, layer, x0, y0, x1, y1): the whole image, and overlapping crops for each layer. images: (image_id, height, width)."""
    whole = images.select("image_id", F.lit(0).alias("layer"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").cast("int").alias("x1"), F.col("height").cast("int").alias("y1"))
    for k in range(layers):
        n = 2 ** (k + 1)
        overlap = F.floor(overlap_ratio * F.least("height", "width") * (2 / n)).cast("int")
        size = lambda c: F.ceil((F.col("overlap") * (n - 1) + F.col(c)) / n).cast("int")  # noqa: B023, E731
        rows = images.withColumn("overlap", overlap).select("image_id", "height", "width", "overlap", size("width").alias("w"), size("height").alias("h"))
        steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        placed = rows.withColumn("i", steps).withColumn("j", steps)
        x0, y0 = (F.col("w") - F.col("overlap")) * F.col("i"), (F.col("h") - F.col("overlap")) * F.col("j")
        crop = placed.select("image_id", F.lit(k + 1).alias("layer"), x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), F.least(x0 + F.col("w"), F.col("width")).cast("int").alias("x1"), F.least(y0 + F.col("h"), F.col("height")).cast("int").alias("y1"))
        whole = whole.union(crop)
    return whole


def resized_shape(height: Column, width: Column, long_side: int = 1024) -> list[Column]:
    """Height and width scaled so that the longer one is long_side, rounded half up."""
    scale = long_side / F.greatest(height, width)
    return [F.floor(height * scale + 0.5).cast("int"), F.floor(width * scale + 0.5).cast("int")]


def limited_shape(height: Column, width: Column, long_side: int = 512) -> list[Column]:
    """Scaled so that the longer side is long_side, cut to whole pixels."""
    scale = long_side / F.greatest(height, width)
    return [F.floor(height * scale).cast("int"), F.floor(width * scale).cast("int")]


def best_mask(masks: DataFrame) -> DataFrame:
    """The mask of the best quality of each prompt (prompt_id, mask_idx, iou, n_points); the first mask counts only for several clicks."""
    score = F.col("iou") + (F.col("n_points") - 2.5) * F.when(F.col("mask_idx") == 0, 1000).otherwise(0)
    return masks.groupBy("prompt_id").agg(F.max_by(F.struct("mask_idx", "iou"), F.struct(score.alias("s"), (-F.col("mask_idx")).alias("t"))).alias("m")).select("prompt_id", "m.mask_idx", "m.iou")


def kept_boxes(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """Greedy suppression: in order of score (ties by row), a box goes if its IoU with a kept one is over the threshold."""
    order = np.argsort(-scores, kind="stable")
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    alive, out = np.ones(len(boxes), bool), []
    for i in order.tolist():
        if not alive[i]:
            continue
        out.append(i)
        w = np.clip(np.minimum(boxes[:, 2], boxes[i, 2]) - np.maximum(boxes[:, 0], boxes[i, 0]), 0, None)
        h = np.clip(np.minimum(boxes[:, 3], boxes[i, 3]) - np.maximum(boxes[:, 1], boxes[i, 1]), 0, None)
        inter = w * h
        alive &= ~(inter / np.maximum(area + area[i] - inter, 1e-12) > threshold)
    return out


def suppress(boxes: DataFrame, threshold: float = 0.7, group: str = "image_id") -> DataFrame:
    """Non-maximum suppression in each image. boxes: (image_id, box_id, x0, y0, x1, y1, score); an image's boxes are a bounded group by the generator's points."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("box_id", ignore_index=True)
        return pdf.iloc[sorted(kept_boxes(pdf[["x0", "y0", "x1", "y1"]].to_numpy(float), pdf["score"].to_numpy(float), threshold))]

    return boxes.groupBy(group).applyInPandas(run, boxes.schema)


def crop_suppress(boxes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Suppression across crops: boxes of smaller crops come first. boxes need crop_x0 to crop_y1."""
    area = (F.col("crop_x1") - F.col("crop_x0")) * (F.col("crop_y1") - F.col("crop_y0"))
    return suppress(boxes.withColumn("score", F.try_divide(F.lit(1.0), area.cast("double"))), threshold)


def small_regions_removed(mask: np.ndarray, least: int, holes: bool) -> tuple[np.ndarray, bool]:
    """Fills holes, or drops islands, of fewer than `least` pixels (8-connected); if all islands are small, the largest stays."""
    work = ~mask if holes else mask
    label = np.zeros(mask.shape, int)
    sizes: list[list[tuple[int, int]]] = []
    for y, x in zip(*np.nonzero(work), strict=True):
        if label[y, x]:
            continue
        sizes.append([])
        label[y, x] = len(sizes)
        todo = [(int(y), int(x))]
        while todo:
            a, b = todo.pop()
            sizes[-1].append((a, b))
            for c in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for d in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if work[c, d] and not label[c, d]:
                        label[c, d] = len(sizes)
                        todo.append((c, d))
    small = [k for k, s in enumerate(sizes, 1) if len(s) < least]
    if not small:
        return mask, False
    if holes:
        return mask | np.isin(label, small), True
    keep = [k for k in range(1, len(sizes) + 1) if k not in small] or [max(range(1, len(sizes) + 1), key=lambda k: len(sizes[k - 1]))]
    return np.isin(label, keep), True


def remove_small_regions(masks: DataFrame, least: int, key: str = "mask_id") -> DataFrame:
    """(key, height, width, counts, changed): run lengths after filling holes and dropping islands. masks: (key, height, width, counts)."""

    def run(frames):
        for pdf in frames:
            out, changed = [], []
            for h, w, counts in zip(pdf["height"], pdf["width"], pdf["counts"], strict=True):
                flat = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
                mask, a = small_regions_removed(flat.reshape(w, h).T, least, True)
                mask, b = small_regions_removed(mask, least, False)
                out.append(run_lengths(mask.T.reshape(-1)))
                changed.append(a or b)
            yield pdf[[key, "height", "width"]].assign(counts=out, changed=changed)

    return masks.select(key, "height", "width", F.col("counts").cast("array<long>").alias("counts")).mapInPandas(run, f"{key} {dict(masks.dtypes)[key]}, height {dict(masks.dtypes)['height']}, width {dict(masks.dtypes)['width']}, counts array<long>, changed boolean")


@F.pandas_udf(T.StringType())
def coco_counts(counts: pd.Series) -> pd.Series:
    """COCO's compressed run lengths: differences to the count two before, five bits a character, for all masks of a batch at once."""
    size = np.array([-1 if c is None else len(c) for c in counts])
    flat = np.concatenate([np.asarray(c, np.int64) for c in counts if c is not None] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    x = flat.copy()
    late = np.flatnonzero(place > 2)
    x[late] -= flat[late - 2]
    # one character of every number in a round, as long as a number has bits left
    at, codes, order = np.arange(len(x)), [], []
    step = 0
    while len(at):
        bits, rest = x[at] & 31, x[at] >> 5
        more = rest != np.where(bits & 16, -1, 0)
        codes.append(48 + bits + np.where(more, 32, 0))
        order.append(at * 16 + step)
        x[at] = rest
        at, step = at[more], step + 1
    if codes:
        codes, order = np.concatenate(codes), np.concatenate(order)
        sort = np.argsort(order, kind="stable")
        text, ends = codes[sort].astype(np.uint8).tobytes().decode(), np.cumsum(np.bincount(owner[order // 16], minlength=len(size)))
    else:
        text, ends = "", np.zeros(len(size), np.int64)
    starts = np.r_[0, ends[:-1]] if len(size) else ends
    return pd.Series([None if n < 0 else text[a:b] for n, a, b in zip(size.tolist(), starts.tolist(), ends.tolist(), strict=True)], dtype=object)


def mask_records(masks: DataFrame) -> DataFrame:
    """Annotation records: segmentation, area, bbox (x, y, width, height), quality, point and crop."""
    box = F.array(*(c.cast("double") for c in xyxy_to_xywh(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))))
    crop = F.array(*(c.cast("double") for c in xyxy_to_xywh(*(F.col(f"crop_{c}") for c in ("x0", "y0", "x1", "y1")))))
    return masks.select(
        "mask_id",
        F.struct(F.array("height", "width").alias("size"), "counts").alias("segmentation"),
        rle_area(F.col("counts").cast("array<long>")).alias("area"),
        box.alias("bbox"),
        "predicted_iou",
        F.array(F.array(F.col("point_x").cast("double"), F.col("point_y").cast("double"))).alias("point_coords"),
        "stability_score",
        crop.alias("crop_box"),
    )


def all_masks(*tables: DataFrame) -> DataFrame:
    """Mask tables under one another; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def generate_masks(
    images: DataFrame,
    propose: Callable[[DataFrame, DataFrame], DataFrame],
    layers: int = 0,
    side: int = 32,
    iou: float = 0.88,
    stable: float = 0.95,
    box_threshold: float = 0.7,
    crop_threshold: float = 0.7,
    least_region: int = 0,
    overlap_ratio: float = 512 / 1500,
    grid_scale: int = 1,
) -> DataFrame:
    """Annotation records of all images (image_id, height, width, and what the mask model needs): the whole generator.

    propose takes (images, points), with a point (image_id, crop_id, layer,
    x0, y0, x1, y1, px, py) in every grid place of every crop, and returns
    candidate masks (image_id, crop_id, counts in the crop's frame, iou,
    stability, px, py): an outside model behind `providers.propose_at`. Then
    quality filters, boxes, crop edges, suppression within a crop and across
    crops, small regions, and records follow. Images without masks have no
    rows.
    """
    spark = images.sparkSession
    sizes = images.select("image_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"))
    crops = crop_boxes(sizes, layers, overlap_ratio).withColumn("crop_id", F.concat_ws("_", "layer", "x0", "y0", "x1", "y1"))
    points = scaled_points(layer_grids(spark, side, layers, grid_scale), crops).select("image_id", "crop_id", "layer", "x0", "y0", "x1", "y1", "px", "py")
    # the model runs once
    found = stored(quality_filter(propose(images, points).withColumnsRenamed({"iou": "predicted_iou", "stability": "stability_score"}), iou, stable))
    named = found.withColumn("mask_id", F.concat_ws("/", F.col("image_id").cast("string"), "crop_id", F.col("px").cast("string"), F.col("py").cast("string"), F.md5(F.to_json("counts"))))
    framed = named.join(crops.select("image_id", "crop_id", *(F.col(c).alias(f"crop_{c}") for c in ("x0", "y0", "x1", "y1"))), ["image_id", "crop_id"]).join(sizes, "image_id")
    boxed = framed.join(boxes_of_runs(framed.select("mask_id", "counts", (F.col("crop_y1") - F.col("crop_y0")).alias("height"))), "mask_id")
    edge = near_crop_edge(("x0", "y0", "x1", "y1"), ("crop_x0", "crop_y0", "crop_x1", "crop_y1"), ("__0", "__0", "width", "height"))
    kept = stored(with_box(boxed.withColumn("__0", F.lit(0)).where(~edge).drop("__0")))
    once = suppress(kept.select(F.concat_ws("|", F.col("image_id").cast("string"), "crop_id").alias("group"), F.col("mask_id").alias("box_id"), "x0", "y0", "x1", "y1", F.col("predicted_iou").alias("score")), box_threshold, "group")
    kept = kept.join(once.select(F.col("box_id").alias("mask_id")), "mask_id", "left_semi")
    whole = uncropped_masks(kept.select("mask_id", "counts", "crop_x0", "crop_y0", "crop_x1", "crop_y1", "height", "width"))
    moved = [(F.col(c) + F.col(f"crop_{c[0]}0")).alias(c) for c in ("x0", "y0", "x1", "y1")]
    rest = [c for c in kept.columns if c not in ("counts", "x0", "y0", "x1", "y1", "area")]
    full = stored(kept.select(*rest, *moved).join(whole, "mask_id"))
    if layers:
        across = crop_suppress(full.select("image_id", F.col("mask_id").alias("box_id"), "x0", "y0", "x1", "y1", "crop_x0", "crop_y0", "crop_x1", "crop_y1"), crop_threshold)
        full = full.join(across.select(F.col("box_id").alias("mask_id")), "mask_id", "left_semi")
    if least_region > 0:
        clean = remove_small_regions(full.select("mask_id", "height", "width", "counts"), least_region).select("mask_id", F.col("counts").alias("clean"), "changed")
        boxes = boxes_of_runs(clean.join(full.select("mask_id", "height"), "mask_id").select("mask_id", F.col("clean").alias("counts"), "height")).drop("area")
        again = full.drop("x0", "y0", "x1", "y1", "counts").join(clean, "mask_id").join(boxes, "mask_id").withColumnRenamed("clean", "counts")
        left = suppress(again.select("image_id", F.col("mask_id").alias("box_id"), "x0", "y0", "x1", "y1", F.when(F.col("changed"), 0.0).otherwise(1.0).alias("score")), max(box_threshold, crop_threshold))
        full = again.join(left.select(F.col("box_id").alias("mask_id")), "mask_id", "left_semi")
    records = mask_records(full.withColumns({"point_x": F.col("px") + F.col("crop_x0"), "point_y": F.col("py") + F.col("crop_y0")}))
    return records.join(full.select("mask_id", "image_id"), "mask_id")


def boxes_of_runs(masks: DataFrame) -> DataFrame:
    """(mask_id, x0, y0, x1, y1, area) from run lengths in column order (mask_id, counts, height), ends included; zeros for an empty mask."""

    def run(frames):
        for pdf in frames:
            out = []
            for counts, h in zip(pdf["counts"], pdf["height"], strict=True):
                ends = np.cumsum(counts)
                on = np.arange(len(counts)) % 2 == 1
                first, last = (ends - counts)[on], ends[on] - 1
                first, last = first[last >= first], last[last >= first]
                if not len(first):
                    out.append((0, 0, 0, 0, 0))
                    continue
                over = first // h != last // h  # a run over a column's end holds its last and the next one's first pixel
                y0 = 0 if over.any() else int((first % h).min())
                y1 = h - 1 if over.any() else int((last % h).max())
                out.append((int(first.min() // h), y0, int(last.max() // h), y1, int((last - first + 1).sum())))
            yield pd.DataFrame(out, columns=["x0", "y0", "x1", "y1", "area"]).assign(mask_id=pdf["mask_id"].to_numpy())[["mask_id", "x0", "y0", "x1", "y1", "area"]]

    rows = masks.select("mask_id", F.col("counts").cast("array<long>").alias("counts"), F.col("height").cast("int").alias("height"))
    return rows.mapInPandas(run, f"mask_id {dict(masks.dtypes)['mask_id']}, x0 int, y0 int, x1 int, y1 int, area long")
