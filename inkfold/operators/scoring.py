"""Prompt scores: fluency, persistence and creativity by chat.

All functions take long-form tables and aggregate in two levels (chat and
token, then chat), so a chat of any size is pre-aggregated before its rows
meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.vectors import clipped, saturation

#: Tags of words that count as modifiers.
MODIFIER_TAGS = ("VA", "MAG", "MM", "Adjective", "Adverb", "Determiner")
TINY = 1e-12


def text_counts(texts: DataFrame, chat: str = "chat_id") -> DataFrame:
    """(chat, n_texts). Null texts do not count."""
    return texts.where("text is not null").groupBy(chat).agg(F.count("*").alias("n_texts"))


def _shares(words: DataFrame, chat: str, word: str, weight: Column) -> DataFrame:
    counts = words.groupBy(chat, word).agg(F.count("*").alias("c")).withColumn("w", weight)
    totals = counts.groupBy(chat).agg(F.sum("w").alias("total"), F.sum("c").alias("n_tokens"), F.count("*").alias("n_distinct"))
    return counts.join(totals, chat).withColumn("p", F.col("w") / F.col("total"))


def fluency_parts(texts: DataFrame, words: DataFrame, chat: str = "chat_id", word: str = "word", tau_s: float = 8, tau_k: float = 20, floor_k: float = 0.2) -> DataFrame:
    """(chat, n_texts, n_tokens, n_distinct, s, k): saturation of texts, and vocabulary entropy with a floor.

    A floor over 1 is a percentage. Chats without words have k at the floor.
    """
    floor = floor_k / 100 if floor_k and floor_k > 1 else floor_k or 0.0
    entropy = _shares(words, chat, word, F.col("c").cast("double")).groupBy(chat, "n_tokens", "n_distinct").agg(F.sum(-F.col("p") * F.log(F.col("p") + TINY)).alias("h"))
    base = F.log(F.least("n_distinct", F.lit(500)) + TINY)
    raw = F.when(F.col("n_distinct") > 1, clipped(F.try_divide(F.col("h"), base) * saturation(F.col("n_tokens"), tau_k))).otherwise(0.0)
    return (
        text_counts(texts, chat)
        .join(entropy, chat, "left")
        .select(
            chat,
            "n_texts",
            F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
            saturation(F.col("n_texts"), tau_s).alias("s"),
            F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(float(floor))).alias("k"),
        )
    )


def lexical_focus(words: DataFrame, chat: str = "chat_id", word: str = "word", power: float = 1.3) -> DataFrame:
    """(chat, n_tokens, n_distinct, r): half concentration, half normalised entropy of power-weighted counts; 0 for a single distinct word."""
    shares = _shares(words, chat, word, F.pow(F.col("c").cast("double"), F.lit(power)))
    parts = shares.groupBy(chat, "n_tokens", "n_distinct").agg(F.sum(F.col("p") * F.col("p")).alias("simpson"), F.sum(-F.col("p") * F.log(F.col("p") + TINY)).alias("h"))
    return parts.select(chat, "n_tokens", "n_distinct", (0.5 * F.col("simpson") + 0.5 * F.col("h") / F.log(F.col("n_distinct") + TINY)).alias("r"))


def cluster_coverage(texts: DataFrame, assigned: DataFrame, clusters: int, chat: str = "chat_id", alpha: float = 0.5, tau: float = 5, most: int = 64) -> DataFrame:
    """(chat, c): entropy of smoothed cluster shares over all clusters, those without a text included.

    assigned: (chat, cluster_id), one row for each embedded text. Empty
    clusters need no rows: each adds the same term.
    """
    counts = assigned.groupBy(chat, "cluster_id").agg(F.count("*").alias("n"))
    totals = counts.groupBy(chat).agg(F.sum("n").alias("total"), F.count("*").alias("met"))
    share = (F.col("n") + alpha) / (F.col("total") + alpha * clusters)
    none = F.lit(alpha) / (F.col("total") + alpha * clusters)
    h = counts.join(totals, chat).groupBy(chat, "total", "met").agg(F.sum(-share * F.log(share + TINY)).alias("h"))
    whole = F.col("h") + (clusters - F.col("met")) * (-none * F.log(none + TINY))
    base = F.log(F.lit(float(min(clusters, most))) + TINY)
    return text_counts(texts, chat).join(h, chat, "left").select(chat, F.coalesce(clipped(whole / base * saturation(F.col("n_texts"), tau)), F.lit(0.0)).alias("c"))


def cluster_focus(texts: DataFrame, assigned: DataFrame, chat: str = "chat_id", tau: float = 5) -> DataFrame:
    """(chat, f): concentration of texts on clusters, damped for few texts; 0 without embedded texts."""
    counts = assigned.groupBy(chat, "cluster_id").agg(F.count("*").alias("n"))
    parts = counts.groupBy(chat).agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.greatest(F.sum("n"), F.lit(1)).cast("double"), F.lit(2.0))).alias("q"))
    return text_counts(texts, chat).join(parts, chat, "left").select(chat, F.coalesce(clipped(F.col("q") * saturation(F.col("n_texts"), tau)), F.lit(0.0)).alias("f"))


def modifier_saturation(morphs: DataFrame, chat: str = "chat_id", tau: float = 3) -> DataFrame:
    """(chat, n_modifiers, s): saturation of the number of modifiers, by exact tag."""
    n = F.count_if(F.col("tag").isin(*MODIFIER_TAGS))
    return morphs.groupBy(chat).agg(n.alias("n_modifiers")).withColumn("s", saturation(F.col("n_modifiers"), tau))


def weighted_score(parts: list[Column], weights: list[float] | None = None) -> Column:
    """The weighted mean of part scores, clipped to [0, 1], in per cent; 0 if the weights sum to 0."""
    weights = weights or [1.0] * len(parts)
    total = sum(weights)
    if total <= 0:
        return F.lit(0.0)
    return 100 * clipped(sum((w * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0)) / total)


def first_texts(texts: DataFrame, most: int = 1000, chat: str = "chat_id", order: str = "turn") -> DataFrame:
    """The first `most` texts of each chat, in order of a whole number that no two texts of a chat share: those that are embedded.

    Rows are counted by runs of `most` places first, so that only runs that
    can hold a first text are numbered, each by itself.
    """
    run = F.floor(F.col(order) / most)
    rows = texts.withColumn("__run", run)
    counts = rows.groupBy(chat, "__run").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(chat).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_runs = counts.withColumn("__before", before).where(F.col("__before") < most).select(F.col(chat).alias("__chat"), F.col("__run").alias("__r"), "__before")
    near = rows.join(open_runs, (F.col(chat) == F.col("__chat")) & (F.col("__run") == F.col("__r")))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(chat, "__run").orderBy(order))
    return near.withColumn("__place", place).where(F.col("__place") <= most).select(*texts.columns)


def _folded(pairs: Column, value: Callable[[Column], Column]) -> Column:
    """The sum over (c, m) pairs of m times a value of c."""
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["m"] * value(x["c"].cast("double")))


def creativity(texts: DataFrame, words: DataFrame, morphs: DataFrame, assigned: DataFrame, clusters: int, chat: str = "chat_id", floor_k: float = 0.2) -> DataFrame:
    """(chat, fluency, persistence, creativity, fluency_skc, persistence_srf) for every chat with a text.

    texts (chat, text), words (chat, word), morphs (chat, tag), assigned
    (chat, cluster_id). Parts of chats without rows in a table are those of
    an empty list. All tables are counted in one pass: by chat, kind and key;
    then how many keys have each count, of which a chat has few; then each
    chat is a row, and its scores are sums over these pairs. No table is read
    twice and nothing is joined.
    """
    none = F.lit(None).cast("string")
    rows = texts.where("text is not null").select(F.col(chat).alias("chat"), F.lit("t").alias("kind"), none.alias("key"))
    rows = rows.unionAll(words.select(chat, F.lit("w"), F.col("word").cast("string")))
    rows = rows.unionAll(morphs.where(F.col("tag").isin(*MODIFIER_TAGS)).select(chat, F.lit("m"), none))
    rows = rows.unionAll(assigned.select(chat, F.lit("c"), F.col("cluster_id").cast("string")))
    counts = rows.groupBy("chat", "kind", "key").agg(F.count("*").alias("c")).groupBy("chat", "kind", "c").agg(F.count("*").alias("m"))
    lists = counts.groupBy("chat").agg(*(F.collect_list(F.when(F.col("kind") == k, F.struct("c", "m"))).alias(k) for k in "twmc"))
    total = lambda k: _folded(F.col(k), lambda c: c)
    kinds = lambda k: _folded(F.col(k), lambda c: F.lit(1.0))
    sums = lists.select("chat", "w", "c", total("t").alias("texts"), total("m").alias("modifiers"), total("w").alias("tokens"), kinds("w").alias("distinct"), total("c").alias("embedded"), kinds("c").alias("met"), _folded(F.col("w"), lambda c: F.pow(c, F.lit(1.3))).alias("powered"))
    sums = sums.where("texts > 0")
    entropy = lambda k, share: _folded(F.col(k), lambda c: -share(c) * F.log(share(c) + TINY))
    floor = floor_k / 100 if floor_k and floor_k > 1 else floor_k or 0.0
    base_k = F.log(F.least("distinct", F.lit(500.0)) + TINY)
    k = F.when(F.col("distinct") > 1, clipped(F.try_divide(entropy("w", lambda c: c / F.col("tokens")), base_k) * saturation(F.col("tokens"), 20))).otherwise(0.0)
    smooth = 0.5
    none_share = F.lit(smooth) / (F.col("embedded") + smooth * clusters)
    h = entropy("c", lambda c: (c + smooth) / (F.col("embedded") + smooth * clusters)) + (clusters - F.col("met")) * (-none_share * F.log(none_share + TINY))
    cover = clipped(h / F.log(F.lit(float(min(clusters, 64))) + TINY) * saturation(F.col("texts"), 5))
    share = lambda c: F.pow(c, F.lit(1.3)) / F.col("powered")
    r = 0.5 * _folded(F.col("w"), lambda c: share(c) * share(c)) + 0.5 * entropy("w", share) / F.log(F.col("distinct") + TINY)
    focus = clipped(_folded(F.col("c"), lambda c: c * c) / (F.col("embedded") * F.col("embedded")) * saturation(F.col("texts"), 5))
    has = F.col("embedded") > 0
    parts = sums.select(
        F.col("chat").alias(chat),
        saturation(F.col("texts"), 8).alias("s"),
        F.greatest(k, F.lit(float(floor))).alias("k"),
        F.when(has, cover).otherwise(0.0).alias("c"),
        saturation(F.col("modifiers"), 3).alias("ps"),
        F.when(F.col("tokens") > 0, r).otherwise(0.0).alias("r"),
        F.when(has, focus).otherwise(0.0).alias("f"),
    )
    fluency, persistence = weighted_score([F.col("s"), F.col("k"), F.col("c")]), weighted_score([F.col("ps"), F.col("r"), F.col("f")])
    return parts.select(
        chat,
        fluency.alias("fluency"),
        persistence.alias("persistence"),
        (0.5 * fluency + 0.5 * persistence).alias("creativity"),
        F.struct("s", "k", "c").alias("fluency_skc"),
        F.struct(F.col("ps").alias("s"), "r", "f").alias("persistence_srf"),
    )


def reply(scores: DataFrame, digits: int = 4) -> DataFrame:
    """The nested score record with rounded numbers (half to even)."""
    rounded = lambda c: F.bround(c, digits)
    return scores.select(
        "*",
        F.struct(
            *(rounded(F.col(c)).alias(c) for c in ("fluency", "persistence", "creativity")),
            F.struct(*(rounded(F.col("fluency_skc")[k]).alias(k) for k in ("s", "k", "c"))).alias("fluencySkc"),
            F.struct(*(rounded(F.col("persistence_srf")[k]).alias(k) for k in ("s", "r", "f"))).alias("persistenceSrf"),
        ).alias("reply"),
    )
