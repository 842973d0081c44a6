"""Vocabularies: token counts, filtered unigrams and bigrams, morph filters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions.strings import adjacent_pairs
from inkfold.operators.storage import stored

#: Tags that the morph filter drops, verbs of no content, tags of meaning words and of words with a category.
STOP_TAGS = ("JKS", "JKC", "JKO", "JKB", "JX", "JC", "JKG", "EF", "EC", "EP", "ETN", "ETM", "SF", "SE", "SP", "SS", "SO", "XSN", "XSV")
COMMON_VERBS = ("하다", "되다", "있다", "없다", "같다", "이다")
MEANING_TAGS = "^(NN|VV|VA)"
CATEGORY_TAGS = ("NNG", "NNP", "NP", "VA", "Noun", "Adjective")
CORPUS_TAGS = ("NNG", "NNP", "VA", "VV", "XR")
#: Words that travel to the lines.
MOST_WORDS = 500_000


def exploded(lines: DataFrame, tokens: str = "tokens", *keys: str) -> DataFrame:
    """(keys..., pos, token), one row for each token."""
    return lines.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def filter_morphs(morphs: DataFrame, stopwords: DataFrame | None = None) -> DataFrame:
    """Drops empty and one-character words, stop tags (exact match), common verbs, and stopwords (one column, word)."""
    kept = morphs.where((F.length("word") > 1) & ~F.col("tag").isin(*STOP_TAGS) & ~F.col("word").isin(*COMMON_VERBS))
    return kept if stopwords is None else kept.join(stopwords.select("word").distinct(), "word", "left_anti")


def meaning_words(morphs: DataFrame) -> DataFrame:
    """Nouns, verbs and adjectives, by the start of the tag."""
    return morphs.where(F.col("tag").rlike(MEANING_TAGS))


def category_words(morphs: DataFrame) -> DataFrame:
    """Words whose tag, by exact match, can have a category."""
    return morphs.where(F.col("tag").isin(*CATEGORY_TAGS))


def corpus_words(morphs: DataFrame, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """Words with a corpus tag that are no stopword, in lower case."""
    kept = morphs.where(F.col("tag").isin(*CORPUS_TAGS))
    return (kept.where(~F.col("word").isin(*stopwords)) if stopwords else kept).withColumn("word", F.lower("word"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """(token, n)."""
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def relative_frequency(counts: DataFrame) -> DataFrame:
    """(token, n, freq): share of all tokens."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("token", "n", (F.col("n") / F.col("total")).alias("freq"))  # one row


def most_common(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens; ties by token."""
    return counts.orderBy(F.desc("n"), "token").limit(k)


def vocabulary(counts: DataFrame, min_freq: int = 1, top_k_common: int = 0) -> DataFrame:
    """Tokens with at least min_freq occurrences, without the top_k_common most frequent ones (only if the vocabulary is larger than that)."""
    kept = counts.where(F.col("n") >= min_freq)
    if top_k_common <= 0:
        return kept
    larger = kept.limit(top_k_common + 1).count() > top_k_common
    return kept.join(most_common(kept, top_k_common).select("token"), "token", "left_anti") if larger else kept


def _lists(values: pa.Array, owner: pa.Array, n: int) -> pa.ListArray:
    """n lists of values, by the number of the list that owns each value, in ascending order."""
    ends = np.r_[0, np.cumsum(np.bincount(owner.to_numpy(), minlength=n))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _known_words(words: DataFrame) -> Broadcast | None:
    """The words (token), sent to all workers; None if they are over MOST_WORDS."""
    few = words.select("token").distinct()
    return few.sparkSession.sparkContext.broadcast(few.toArrow()["token"].combine_chunks()) if few.count() <= MOST_WORDS else None


def keep_known(lines: DataFrame, words: DataFrame, key: str = "line_no", tokens: str = "tokens") -> DataFrame:
    """Lines with only those of their tokens that are in words (token), in order; other columns and lines without any such token stay.

    A counted number of words travels to the lines, which are then filtered
    where they are, list by list in Arrow; beyond it tokens meet the words by
    a join and are put together again.
    """
    shared = _known_words(words)
    if shared is None:
        kept = exploded(lines, tokens, key).join(words.select("token").distinct(), "token", "left_semi")
        again = kept.groupBy(F.col(key).alias("__key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("__kept"))
        joined = lines.join(again, F.col(key) == F.col("__key"), "left")
        return joined.select(*(F.coalesce("__kept", F.array().cast("array<string>")).alias(c) if c == tokens else F.col(c) for c in lines.columns))
    names, at = lines.columns, lines.columns.index(tokens)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            values, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
            known = pc.is_in(values, value_set=shared.value.cast(values.type))
            made = _lists(values.filter(known), owner.filter(known), batch.num_rows)
            yield pa.RecordBatch.from_arrays([made if i == at else batch.column(i) for i in range(batch.num_columns)], names=names)

    return lines.mapInArrow(run, lines.schema)


def with_pairs(lines: DataFrame, key: str = "line_no", sep: str = "_") -> DataFrame:
    """(key, tokens, pairs): each token joined with its successor in the line, list by list in Arrow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, owner = pc.list_flatten(batch.column(1)), pc.list_parent_indices(batch.column(1))
            same = pc.equal(owner[:-1], owner[1:]) if len(owner) else pa.array([], pa.bool_())
            pairs = pc.binary_join_element_wise(values[:-1].filter(same), values[1:].filter(same), sep) if len(owner) else values
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(pairs, owner[:-1].filter(same) if len(owner) else owner, batch.num_rows)], names=[key, "tokens", "pairs"])

    return lines.select(key, "tokens").mapInArrow(run, f"{key} {dict(lines.dtypes)[key]}, tokens array<string>, pairs array<string>")


def filtered_bigrams(lines: DataFrame, key: str = "line_no", min_freq: int = 5, min_bigram: int = 5, sep: str = "_", top_k_common: int = 0, min_tokens: int = 1) -> DataFrame:
    """(line, tokens): known tokens followed by known pairs of neighbouring known tokens; lines under min_tokens go.

    Pairs are taken after the token filter, so they may join words that were
    apart. Lines are tokenized once and written, filtered lines with their
    pairs likewise; only counts of tokens and pairs are shuffled.
    """
    lines = stored(lines.select(key, "tokens"))
    known = vocabulary(token_counts(exploded(lines, "tokens", key).select("token")), min_freq, top_k_common)
    filtered = stored(with_pairs(keep_known(lines, known, key), key, sep))
    frequent = token_counts(filtered.select(F.explode("pairs").alias("token"))).where(F.col("n") >= min_bigram)
    kept = keep_known(filtered, frequent, key, "pairs")
    return kept.select(key, F.concat("tokens", "pairs").alias("tokens")).where(F.size("tokens") >= min_tokens)


def ordered_pair_counts(lines: DataFrame, key: str = "line_no", sep: str = "_") -> DataFrame:
    """(token, n) of neighbouring pairs."""
    return token_counts(exploded(lines.select(key, adjacent_pairs(F.col("tokens"), sep).alias("tokens")), "tokens", key))
