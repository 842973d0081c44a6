"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Every term has a sparse random index vector that follows from a hash of the
term; a word vector is the weighted sum of the index vectors of the terms
around its occurrences, plus its own. A document is the mean of its words'
vectors. Word vectors, network and temperature are fitted by the driver on a
bounded sample of labelled documents, each read whole; all documents are
scored in full.

Terms are words in lower case with their punctuation split off, and marks
for what a bag of words would lose: a word that repeats the one before it
(`=`), a word in capitals (`^`), a run of symbols. Terms that the sample
does not hold share a term by shape.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from inkfold.llm.common import id_remainder, map_texts, released, resident, slices, stored

#: Dimensions of index vectors; +1 and -1 entries of one.
DIM, NONZERO = 96, 6
PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Terms whose neighbours are added up at a time.
RUN = 200_000
#: Marks, as terms of their own.
SAME, CAPITALS = "\x01=", "\x01^"


def terms(text: bytes | None) -> list[str]:
    """Words, and runs of digits or symbols."""
    return PIECE.findall((text or b"").decode("utf-8", "replace"))


def index_vector(term: str) -> np.ndarray:
    """The sparse ternary vector of a term, from its hash alone."""
    out = np.zeros(DIM, np.float32)
    for k in range(NONZERO):
        h = xxh64_intdigest(term, k)
        out[h % DIM] += 1.0 if h >> 40 & 1 else -1.0
    return out


def shape_of(term: str) -> str:
    """The shared term of words that the vocabulary lacks."""
    if term[0].isdigit():
        return "\x02number"
    if not (term[0].isalpha() or term[0] == "_"):
        return "\x02symbols"
    return f"\x02word{min(len(term), 16) // 3}"


class Vectors:
    """Random-indexing word vectors of a vocabulary."""

    def __init__(self, ids: dict[str, int], table: np.ndarray):
        self.ids, self.table = ids, table

    def rows(self, text: bytes | None, new: dict[str, int]) -> np.ndarray:
        """Vocabulary rows of a text's terms and marks. new: rows of terms met before that the vocabulary lacks, kept by the caller."""
        found = terms(text)
        get = self.ids.get
        plain = [t.lower() for t in found]
        rows = np.fromiter(map(get, plain, repeat(-1)), np.int64, len(plain))
        for i in np.flatnonzero(rows < 0).tolist():
            t = plain[i]
            r = new.get(t)
            if r is None:
                r = get(shape_of(t), self.ids["\x02symbols"])
                if len(new) < 100_000:
                    new[t] = r
            rows[i] = r
        again = sum(map(eq, plain, plain[1:]))
        capitals = sum(map(_capitals, found))
        return np.concatenate([rows, np.full(again, self.ids[SAME]), np.full(capitals, self.ids[CAPITALS])])

    def pool(self, rows: list[np.ndarray]) -> np.ndarray:
        """The mean vector of each document, and its logarithmic length and share of distinct terms."""
        out = np.zeros((len(rows), self.table.shape[1] + 2), np.float32)
        for i, r in enumerate(rows):
            if len(r):
                kinds, n = np.unique(r, return_counts=True)
                out[i, :-2] = n.astype(np.float32) @ self.table[kinds] / len(r)
                out[i, -2:] = np.log1p(len(r)) / 10, len(kinds) / len(r)
        return out


def _capitals(t: str) -> bool:
    return len(t) > 1 and t.isupper()


def learn_vectors(texts: Callable[[], Iterable[bytes | None]], span: int = 2, least: int = 2, most: int = 60_000) -> Vectors:
    """Word vectors from texts: terms with at least `least` occurrences, the most frequent `most` of them.

    texts gives the texts anew each time it is called: they are read twice,
    one after the other, and never held together.
    """
    counts: Counter = Counter()
    for x in texts():
        counts.update(t.lower() for t in terms(x))
    chosen = sorted((t for t, n in counts.items() if n >= least), key=lambda t: (-counts[t], t))[:most]
    del counts
    shapes = ["\x02number", "\x02symbols", *(f"\x02word{k}" for k in range(6))]
    ids = {t: i for i, t in enumerate([*chosen, *shapes, SAME, CAPITALS])}
    index = np.array([index_vector(t) for t in ids])
    # an index vector has few entries: their places and values, filled up with zeros
    place = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
    value = np.take_along_axis(index, place, 1)
    table = np.zeros(index.size)

    def near(at: np.ndarray, other: np.ndarray, weight: float) -> None:
        np.add.at(table, at[:, None] * DIM + place[other], value[other] * weight)

    for x in texts():
        s = [t.lower() for t in terms(x)]
        r = np.fromiter((i if (i := ids.get(t, -1)) >= 0 else ids[shape_of(t)] for t in s), np.int64, len(s))
        for first in range(0, len(r), RUN):
            run = r[first : first + RUN + span]
            for k in range(1, span + 1):
                left, right = run[: max(0, min(RUN, len(run) - k))], run[k : k + RUN]
                near(left, right, 1 / k)
                near(right, left, 1 / k)
    table = table.reshape(index.shape)
    norm = np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    return Vectors(ids, (table / norm + 0.5 * index / np.sqrt(NONZERO)).astype(np.float32))


class Network:
    """Standardised input, one hidden layer (tanh), one logit, divided by a temperature."""

    def __init__(self, width: int, hidden: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1])
        return z @ self.w[2] + self.w[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def loss(self, x: np.ndarray, y: np.ndarray, decay: float = 0.0) -> float:
        """The mean logistic loss, and half the decay times the squares of the two layers' weights."""
        z = self.logits(x)
        return float(np.mean(np.logaddexp(0, z) - y * z)) + decay / 2 * float((self.w[0] ** 2).sum() + (self.w[2] ** 2).sum())

    def gradients(self, x: np.ndarray, y: np.ndarray, decay: float = 0.0) -> list[np.ndarray]:
        """Of the loss, by each array of weights."""
        a = (x - self.mean) / self.scale
        z = np.tanh(a @ self.w[0] + self.w[1])
        p = 1 / (1 + np.exp(-np.clip(z @ self.w[2] + self.w[3][0], -40, 40)))
        g = (p - y) / len(y)
        dz = np.outer(g, self.w[2]) * (1 - z * z)
        return [a.T @ dz + decay * self.w[0], dz.sum(axis=0), z.T @ g + decay * self.w[2], np.array([g.sum()])]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 6) -> None:
        """Adam on the logistic loss."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                at = order[k : k + batch]
                t += 1
                for i, d in enumerate(self.gradients(x[at], y[at], decay)):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    self.w[i] = self.w[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the least logistic loss, among a grid from 1/4 to 8."""
        z = self.logits(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [float(np.mean(np.logaddexp(0, z / t) - y * z / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(x) else 1.0


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt."""
    return id_remainder(id_col, 5) == 0


def learn_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 5000, hidden: int = 24) -> tuple[Vectors, Network] | None:
    """Fits on at most `sample` labelled documents outside the held-out fold, in order of a hash of the id; a fifth of them sets the temperature.

    The sample is written to the shared folder; the driver reads it text by
    text, whatever its length, and holds one part of a few texts at a time.
    Rows with a null id or label are left out; several labels of an id count
    as the largest, several texts of an id as the first. Without labels of
    both kinds there is no classifier.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").alias("quality")).where("id is not null and quality is not null").where(~held_out("id")).groupBy("id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` ids
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    rows = stored(rows.repartitionByRange(-(-sample // 250), "id").sortWithinPartitions("id"))
    kinds = rows.select("id", "quality").orderBy("id").toArrow()
    y = np.array(kinds["quality"].to_pylist(), np.float64)
    if len(y) == 0 or y.min() == y.max():
        return None
    ids = kinds["id"].to_pylist()
    late = np.array([zlib.crc32(b"late" + str(i).encode()) % 5 == 0 for i in ids])
    place = {i: k for k, i in enumerate(ids)}

    def texts() -> Iterator[tuple[int, bytes]]:
        # sums do not depend on the order beyond rounding; parts come in order all the same
        for r in rows.toLocalIterator():
            yield place[r["id"]], r["text"].encode()

    vectors = learn_vectors(lambda: (t for k, t in texts() if not late[k]))
    new: dict[str, int] = {}
    x = np.zeros((len(y), DIM + 2))
    for k, t in texts():
        x[k] = vectors.pool([vectors.rows(t, new)])[0]
    net = Network(x.shape[1], hidden)
    net.fit(x[~late], y[~late])
    net.calibrate(x[late], y[late])
    return vectors, net


def classify_documents(docs: DataFrame, model: tuple[Vectors, Network] | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Each row without its text column, with score (0 to 1) and predicted (1 if score >= threshold), in place of columns of these names.

    Null text counts as empty, and an empty text has a score too. Texts are
    scored whole, whatever their length; null ids and repeated rows stay; an
    empty table stays empty. Without a classifier every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    def run(texts: list[bytes | None]) -> dict[str, list]:
        name, model = shared.value
        if model is None:
            return {"score": [0.5] * len(texts)}
        (vectors, net), new = model, resident(name, dict)
        return {"score": net.scores(vectors.pool([vectors.rows(t, new) for t in texts]).astype(np.float64)).tolist()}

    docs = docs.select(*(c for c in docs.columns if c == text_col or c.lower() != "predicted"))
    made = map_texts(docs, run, [T.StructField("score", T.DoubleType())], text_col)
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: tuple[Vectors, Network] | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, with a score of at least the threshold; a null text is scored as an empty one. Without a classifier all rows stay."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, (vectors, net) = shared.value
        new = resident(name, dict)
        for whole in batches:
            for batch in slices(whole, at, 2000, 4_000_000):
                texts = batch.column(at).cast(pa.large_binary()).to_pylist()
                good = net.scores(vectors.pool([vectors.rows(t, new) for t in texts]).astype(np.float64)) >= threshold
                del texts
                yield batch.filter(pa.array(good))
        released()

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    from inkfold.llm.common import documents

    docs = documents(spark, sf_dir)
    model = learn_classifier(docs, documents(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return classify_documents(rows, model)
