"""Quality rules: learned decision lists over text statistics, in built-in expressions only.

Sequential covering works on labelled counts: statistics of labelled
documents are cut at quantiles, rows with equal cuts are counted by label in
Spark, and the driver grows a rule by the condition of the best gain, prunes
it on the rest of the counts, and removes what it covers. The result is an
ordered list of threshold conjunctions, applied as one conditional
expression.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import SPACE_CLASS, stored

#: Statistics that rules may use, besides the base columns: all per word or per line.
RATIOS = ("mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "mark_ratio", "digit_ratio", "words_per_line")
#: Quantiles of either class at which statistics are cut.
CUTS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base columns and the ratios to each row; null text counts as empty.

    Words are runs of characters other than 0x20 and 0x09-0x0D.
    n_repeat_words counts the word places inside 5-word windows that occur
    twice or more in the text. Windows are compared by a chained 64-bit hash
    of their words; only texts with a repeated window are sorted.
    """
    own = [c for c in docs.columns if c not in ("__text", "__words")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*own, text.alias("__text"), F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "").alias("__words"))
    n = F.size("__words")
    hashes = F.expr("transform(sequence(0, size(__words) - 5), i -> xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2), get(__words, i + 3), get(__words, i + 4)))")
    joined = F.array_join("__words", "")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.size(F.array_distinct("__words")).cast("long").alias("__distinct"),
        F.length(F.regexp_replace("__text", r"[^\p{Lu}]+", "")).cast("long").alias("__upper"),
        F.length(F.regexp_replace("__text", r"[^!?]+", "")).cast("long").alias("__marks"),
        F.length(F.regexp_replace("__text", r"[^0-9]+", "")).cast("long").alias("__digits"),
        F.when(n >= 5, hashes).alias("__windows"),
    )
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    rows = rows.withColumn("__sorted", F.when(again, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.expr("filter(__sorted, (x, k) -> coalesce(x.h = get(__sorted, k - 1).h, false) or coalesce(x.h = get(__sorted, k + 1).h, false))")
    rows = rows.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.expr("aggregate(transform(__places, (x, k) -> least(5, coalesce(get(__places, k + 1) - x, 5))), 0, (a, x) -> a + x)")
    rows = rows.select(
        *own,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("__n_lines"),
        "__distinct",
        "__upper",
        "__marks",
        "__digits",
    )
    words, chars, n_lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("__n_lines", F.lit(1))
    values = (
        F.col("word_chars") / words,
        F.col("n_symbols") / words,
        F.col("n_dup_lines") / n_lines,
        F.col("n_repeat_words") / words,
        F.col("__distinct") / words,
        F.col("__upper") / chars,
        F.col("__marks") / words,
        F.col("__digits") / chars,
        F.col("n_words") / n_lines,
    )
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*own, *base, *(v.alias(r) for r, v in zip(RATIOS, values, strict=True)))


@dataclasses.dataclass(frozen=True)
class Condition:
    """statistic >= value, or statistic < value."""

    name: str
    at_least: bool
    value: float

    def column(self) -> Column:
        return F.col(self.name) >= self.value if self.at_least else F.col(self.name) < self.value


@dataclasses.dataclass(frozen=True)
class Rule:
    """Rejects the rows that meet all conditions."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.name} {'>=' if c.at_least else '<'} {c.value:.6g}" for c in self.conditions)


def labelled_counts(stats: DataFrame, bad: Column, key: Column, names: tuple[str, ...] = RATIOS) -> tuple[list[list[float]], list[tuple]]:
    """Cut values of each statistic, and rows (cut of each statistic..., pruning part, good, bad): counts by label.

    The number of count rows is at most that of labelled rows in stats, which
    the caller bounds.
    """
    labelled = stats.select(*names, bad.alias("bad"), (F.pmod(key, F.lit(3)) == 0).alias("late"))
    asked = [F.percentile_approx(F.when(F.col("bad") == side, F.col(n)), list(CUTS), 10_000).alias(f"{n}_{int(side)}") for n in names for side in (False, True)]
    row = labelled.agg(*asked).first()
    cuts = [sorted({float(v) for side in (0, 1) for v in (row[f"{n}_{side}"] or [])}) for n in names]

    def place(n: str, values: list[float]) -> Column:
        return F.size(F.filter(F.array(*(F.lit(v) for v in values)), lambda v: v <= F.col(n))) if values else F.lit(0)

    cut = labelled.select(*(place(n, v).alias(n) for n, v in zip(names, cuts, strict=True)), "bad", "late")
    counted = cut.groupBy(*names, "late").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("n_bad"))
    return cuts, [tuple(r) for r in counted.orderBy(*names, "late").collect()]


def cover(cuts: list[list[float]], counts: list[tuple], names: tuple[str, ...] = RATIOS, precision: float = 0.9, least: int = 5, most_conditions: int = 4, most_rules: int = 24) -> list[Rule]:
    """Sequential covering of the bad rows. Ties: the first statistic, the lowest cut, `>=` before `<`."""
    if not counts:
        return []
    table = np.array([c[: len(names)] for c in counts], np.int64)
    late = np.array([c[len(names)] for c in counts], bool)
    good, bad = np.array([c[-2] for c in counts], float), np.array([c[-1] for c in counts], float)
    literals = [(f, up, k) for f, values in enumerate(cuts) for k in range(1, len(values) + 1) for up in (True, False)]
    hits = np.array([(table[:, f] >= k) if up else (table[:, f] < k) for f, up, k in literals]).reshape(len(literals), len(counts))
    open_rows, rules = np.ones(len(counts), bool), []

    def quality(at: np.ndarray) -> tuple[float, float]:
        return float(bad[at].sum()), float(good[at].sum())

    while len(rules) < most_rules and bad[open_rows & ~late].sum() >= least:
        at, chosen = open_rows & ~late, []
        while len(chosen) < most_conditions:
            p, n = quality(at)
            if n == 0:
                break
            ps, ns = hits[:, at] @ bad[at], hits[:, at] @ good[at]
            gain = np.where(ps > 0, ps * (np.log2((ps + 1e-9) / (ps + ns + 1e-9)) - np.log2(p / (p + n))), -1.0)
            best = int(gain.argmax())
            if gain[best] <= 1e-6:
                break
            chosen.append(best)
            at = at & hits[best]

        # prune: the shortest prefix of the best worth on the counts set aside
        def worth(k: int) -> float:
            on = open_rows & late & (hits[chosen[:k]].all(axis=0) if k else True)
            p, n = quality(on)
            return (p - n) / (p + n) if p + n else -1.0

        if not chosen:
            break
        keep = max(range(1, len(chosen) + 1), key=lambda k: (worth(k), -k))
        covered = open_rows & hits[chosen[:keep]].all(axis=0)
        p, n = quality(covered)
        if p < least or p / (p + n) < precision:
            break
        rules.append(Rule(tuple(Condition(names[f], up, cuts[f][k - 1]) for f, up, k in (literals[i] for i in chosen[:keep]))))
        open_rows &= ~covered
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, **how) -> list[Rule]:
    """The decision list for labels (doc_id, quality), from at most `sample` labelled documents, taken in order of a hash of the id.

    Rows with a null id or label are left out; several labels of one id count
    as the largest. Without labels of both kinds the list is empty.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").alias("quality")).where("id is not null and quality is not null").groupBy("id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    stats = stored(text_statistics(rows, "text").drop("text"))
    return cover(*labelled_counts(stats, F.col("quality") == 0, F.xxhash64("id")), **how)


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects: an ordered conditional expression."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(False)).otherwise(out)
    return out


def judge_documents(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, the base columns, base_failed, kept."""
    stats = text_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all documents by rules learned from labels."""
    from inkfold.llm.common import documents

    docs = documents(spark, sf_dir)
    return judge_documents(docs, learn_rules(docs, documents(spark, sf_dir, "labels")))
