"""Outside engines behind a small interface: taggers, embedders and mask models.

A provider is made once in each worker and is fed Arrow batches. None is
shipped: the engines are third-party programs and weights. The hash embedder
and the table embedder stand in for tests and queries.
"""

from __future__ import annotations

import hashlib
import inspect
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.functions.images import decode_png


class Tagger(Protocol):
    """Tags words of a text."""

    def tag(self, text: str) -> list[tuple[str, str]]: ...


class Embedder(Protocol):
    """Embeds texts, one row each."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


class MaskModel(Protocol):
    """Proposes masks of an image: dicts with height, width, counts, iou and point."""

    def masks(self, image: bytes) -> list[dict]: ...


class CostModel(Protocol):
    """Context ids and cost of a lexicon entry: (left_id, right_id, cost)."""

    def costs(self, entry: dict) -> tuple[int, int, int]: ...


class PointModel(Protocol):
    """Masks of a crop at points: for each point a list of dicts with counts (column order), iou and stability."""

    def masks_at(self, crop: np.ndarray, points: np.ndarray) -> list[list[dict]]: ...


class HashEmbedder:
    """Deterministic vectors from word hashes; for tests."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                h = hashlib.md5(w.encode()).digest()
                out[i, int.from_bytes(h[:4], "little") % self.width] += 1 if h[4] & 1 else -1
        return out


_MADE: dict[bytes, object] = {}


def _made(make: Callable[[], object]) -> object:
    """One instance for each provider in a worker: providers are told apart by their pickled form."""
    key = hashlib.sha256(cloudpickle.dumps(make)).digest()
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def given(**options: object) -> dict[str, object]:
    """Only the options that were given a value, for engines with defaults of their own."""
    return {k: v for k, v in options.items() if v is not None}


def call_metric(metric: Callable, texts: list[str], *place: object, resources: dict | None = None) -> tuple[float, float, float, float]:
    """A score and its three parts from a metric of either kind: one that takes loaded resources or one that does not; parts that it does not return are 0."""
    takes = "resources" in inspect.signature(metric).parameters or any(p.kind is inspect.Parameter.VAR_KEYWORD for p in inspect.signature(metric).parameters.values())
    value = metric(texts, *place, resources=resources) if takes else metric(texts, *place)
    if isinstance(value, tuple) and len(value) >= 4:
        return tuple(float(v) for v in value[:4])
    return float(value), 0.0, 0.0, 0.0


def first_tagger(*makers: Callable[[], Tagger]) -> Tagger:
    """The first tagger that can be made: the preferred engine, else the next one."""
    failed = []
    for make in makers:
        try:
            return make()
        except (ImportError, OSError, RuntimeError) as e:
            failed.append(str(e))
    raise RuntimeError("no tagger: " + "; ".join(failed))


def tag_texts(texts: DataFrame, make: Callable[[], Tagger], key: str = "line_no", text: str = "text") -> DataFrame:
    """(key, pos, word, tag): one row for each tagged word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = _made(make)
        for pdf in frames:
            rows = [(k, i, w, t) for k, s in zip(pdf["k"], pdf["t"], strict=True) for i, (w, t) in enumerate(tagger.tag(s or ""))]
            yield pd.DataFrame(rows, columns=[key, "pos", "word", "tag"])

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, pos int, word string, tag string")


def tag_best(texts: DataFrame, make: Callable[[], Tagger], n: int = 10, key: str = "line_no", text: str = "text") -> DataFrame:
    """(key, rank, pos, word, tag): the n best taggings of each text, the best one first, from a tagger with tag_best(text, n)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = _made(make)
        for pdf in frames:
            rows = [(k, r, i, w, t) for k, s in zip(pdf["k"], pdf["t"], strict=True) for r, words in enumerate(tagger.tag_best(s or "", n)[:n]) for i, (w, t) in enumerate(words)]
            yield pd.DataFrame(rows, columns=[key, "rank", "pos", "word", "tag"])

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, rank int, pos int, word string, tag string")


def generate_costs(entries: DataFrame, make: Callable[[], CostModel]) -> DataFrame:
    """User entries (the lexicon's columns) with left_id, right_id and cost from a trained model; all other columns stay."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _made(make)
        for pdf in frames:
            found = [model.costs(r) for r in pdf.to_dict("records")]
            yield pdf.assign(**{c: [f[k] for f in found] for k, c in enumerate(("left_id", "right_id", "cost"))})

    return entries.mapInPandas(run, entries.schema)


def fetch_images(urls: DataFrame, fetch: Callable[[str], bytes] | None = None, url: str = "url") -> DataFrame:
    """urls with content: what each address holds; addresses that cannot be read go, as do images that cannot be."""
    fetch = fetch or _download

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for u in pdf[url]:
                try:
                    out.append(fetch(u))
                except (OSError, ValueError):
                    out.append(None)
            yield pdf.assign(content=out)

    return urls.mapInPandas(run, T.StructType([*urls.schema.fields, T.StructField("content", T.BinaryType())])).where("content is not null")


def _download(url: str, timeout: float = 30.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read()


def embed_texts(texts: DataFrame, make: Callable[[], Embedder], key: str = "line_no", text: str = "text") -> DataFrame:
    """(key, embedding)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _made(make)
        for pdf in frames:
            yield pd.DataFrame({key: pdf["k"], "embedding": list(model.embed(pdf["t"].fillna("").tolist()))})

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<float>")


def propose_masks(images: DataFrame, make: Callable[[], MaskModel], key: str = "path", content: str = "content") -> DataFrame:
    """(key, mask_no, height, width, counts, iou, point_x, point_y): run lengths leave the worker, never pixels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _made(make)
        names = [key, "mask_no", "height", "width", "counts", "iou", "point_x", "point_y"]
        for pdf in frames:
            rows = [(k, i, m["height"], m["width"], m["counts"], m["iou"], *m["point"]) for k, c in zip(pdf["k"], pdf["c"], strict=True) for i, m in enumerate(model.masks(c))]
            yield pd.DataFrame(rows, columns=names)

    schema = f"{key} {dict(images.dtypes)[key]}, mask_no int, height int, width int, counts array<long>, iou double, point_x double, point_y double"
    return images.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(run, schema)


def propose_at(make: Callable[[], PointModel], batch: int = 64) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The proposer of `masks.generate_masks` from a point model. images: (image_id, content, height, width), PNG files.

    An image meets the points of one crop at a time; the model gets them in
    batches. Run lengths leave the worker, never pixels.
    """
    schema = "image_id {kind}, crop_id string, counts array<long>, iou double, stability double, px double, py double"

    def propose(images: DataFrame, points: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = _made(make)
            for pdf in frames:
                for r in pdf.itertuples(index=False):
                    pixels = decode_png(r.content)
                    if pixels is None:
                        continue
                    crop, at, rows = pixels[r.y0 : r.y1, r.x0 : r.x1], np.array([(p["px"], p["py"]) for p in r.points]), []
                    for k in range(0, len(at), batch):
                        for (px, py), found in zip(at[k : k + batch].tolist(), model.masks_at(crop, at[k : k + batch]), strict=True):
                            rows += [(r.image_id, r.crop_id, m["counts"], m["iou"], m["stability"], px, py) for m in found]
                    yield pd.DataFrame(rows, columns=["image_id", "crop_id", "counts", "iou", "stability", "px", "py"])

        crops = points.groupBy("image_id", "crop_id", "x0", "y0", "x1", "y1").agg(F.sort_array(F.collect_list(F.struct("py", "px"))).alias("points"))  # a grid's points
        both = crops.join(images.select("image_id", "content"), "image_id")
        return both.mapInPandas(run, schema.format(kind=dict(images.dtypes)["image_id"]))

    return propose
