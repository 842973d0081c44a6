"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

Documents are aggregated by encoded length, so everything after the encoder
works on one row for each distinct length. Sums run in two levels (ranges of
lengths, then lengths within a range), so no task holds all lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.bpe import encode_documents
from inkfold.llm.common import stored

#: Lengths in a range of the two-level sums.
RANGE = 4096


def token_lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for every row; null and empty texts have 0 tokens."""
    return encode_documents(docs, path, id_col, text_col, decoded=False).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) for each distinct length. A null length counts as 0; an empty table gives an empty histogram."""
    return lengths.groupBy(F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each distinct length L, taken as a context limit: exact totals on both sides of it.

    docs_le, tokens_le: documents of at most L tokens, and their tokens.
    docs_over: documents that a limit of L cuts. tokens_total: all tokens.
    truncated_total: tokens left if every document is cut to L.
    quantile: the share of documents of at most L tokens.
    Between two neighbouring lengths, truncated totals are linear in the
    limit, so these rows answer every limit (see `at_limits`).
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / RANGE).alias("part"))
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("part_docs"), F.sum("tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def prior(c: str) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    parts = parts.select("part", prior("part_docs").alias("docs_before"), prior("part_tokens").alias("tokens_before"), F.sum("part_docs").over(every).alias("docs_total"), F.sum("part_tokens").over(every).alias("tokens_total"))
    upto = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(parts, "part").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(upto)).alias("docs_le"),
        (F.col("tokens_before") + F.sum("tokens").over(upto)).alias("tokens_le"),
        "docs_total",
        "tokens_total",
    )
    over = F.col("docs_total") - F.col("docs_le")
    return out.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_le",
        over.alias("docs_over"),
        "tokens_le",
        "tokens_total",
        (F.col("tokens_le") + F.col("n_tokens") * over).alias("truncated_total"),
        (F.col("docs_le") / F.col("docs_total")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_total) for each distinct limit, from the rows of `suffix_sums`. No documents: zeros.

    Each length meets only the least limit that is not below it; the sums at
    a limit are the largest of all limits up to it.
    """
    spark = sums.sparkSession
    asked = sorted({int(x) for x in limits})
    place = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in asked)), lambda x: x < F.col("context_limit")))
    met = sums.groupBy(place.alias("k")).agg(F.max("docs_le").alias("le"), F.max("tokens_le").alias("tokens"))
    # one row for each limit
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = spark.createDataFrame(list(enumerate(asked)), "k int, context_limit long").join(met, "k", "left")
    top = rows.select("context_limit", F.coalesce(F.max("le").over(upto), F.lit(0)).alias("le"), F.coalesce(F.max("tokens").over(upto), F.lit(0)).alias("tokens"))
    total = sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs_total"))
    over = F.col("docs_total") - F.col("le")
    # one row
    return top.join(F.broadcast(total)).select("context_limit", over.alias("docs_over"), (F.col("tokens") + F.col("context_limit") * over).alias("truncated_total"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the least length that at least a share q of the documents does not exceed; null without documents."""
    return sums.where(F.col("quantile") >= q).agg(F.min("context_limit").alias("n_tokens"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Suffix sums over all documents for every length that occurs."""
    from inkfold.llm.common import documents

    return suffix_sums(stored(length_histogram(token_lengths(documents(spark, sf_dir)))))
