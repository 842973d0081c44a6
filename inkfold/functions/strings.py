"""String functions as column expressions; Arrow functions only where Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that the fallback tokenizer drops.
TOKEN_STOPWORDS = tuple("정면 좌측 우측 시선 향해 카메라 포즈 무표정 기쁜 슬픈 분노한 청년 중년 여성 남성 소년 소녀 사람 얼굴 표정 바라보다 응시하다".split())


def hangul_only(text: Column) -> Column:
    """Keeps Hangul syllables and white space, collapses runs of white space, trims. (A spacing model, if any, runs before.)"""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^가-힣\s]", " "), r"(?U)\s+", " "))


#: White space as the library sees it, Unicode's and four separators, as a character class.
BLANK_CLASS = r"[ \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def collapsed(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, BLANK_CLASS + "+", " "))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition (NFC), which Spark lacks as a built-in."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


#: Ranges of characters that are composed and combine with none of their kind: Latin, punctuation, kana, Han and Hangul syllables.
COMPOSED = ((0x0000, 0x02FF), (0x2010, 0x2027), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF9D))


def normalized(text: Column) -> Column:
    """NFC, then collapsed white space; null counts as empty. Texts of composed characters only do not go through Python."""
    plain = text.rlike(r"\A[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in COMPOSED) + r"]*+\z")
    return collapsed(F.coalesce(nfc(F.when(~plain, text)), text, F.lit("")))


def split_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and Hangul syllables, with empty strings between; null gives none."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9A-Za-z가-힣 ]+", " "), " +")


def plain_tokens(text: Column, stopwords: tuple[str, ...] = TOKEN_STOPWORDS) -> Column:
    """The tokens of a text in order, without stopwords; case stays. Null gives no tokens."""
    return F.filter(split_tokens(text), lambda t: (t != "") & ~t.isin(*stopwords) if stopwords else t != "")


def token_rows(texts: DataFrame, keys: list[str], text: str = "text", name: str = "token", stopwords: tuple[str, ...] = TOKEN_STOPWORDS) -> DataFrame:
    """(keys..., name), one row for each token: rows are filtered after they are exploded, in compiled code."""
    rows = texts.select(*keys, F.explode(split_tokens(F.col(text))).alias(name))
    return rows.where((F.col(name) != "") & ~F.col(name).isin(*stopwords) if stopwords else F.col(name) != "")


def ngram_set(tokens: Column, n: int = 3) -> Column:
    """Distinct runs of n tokens, joined by spaces (no token holds one); none if there are fewer tokens.

    Built from shifted copies, so that tokens is evaluated n times for a row
    and not for each place; joined, so that Spark compares them by hash.
    """
    size = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), size)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(k + 1), size), lambda run, t: F.concat(run, F.lit(" "), t))
    return F.array_distinct(out)


def ngram_hashes(tokens: str, n: int = 3) -> Column:
    """Distinct 64-bit hashes of runs of n tokens. tokens names a column that is stored as it is: it is read for every place."""
    parts = ", ".join(f"get({tokens}, i + {k})" for k in range(n))
    return F.when(F.size(tokens) >= n, F.array_distinct(F.expr(f"transform(sequence(0, size({tokens}) - {n}), i -> xxhash64({parts}))"))).otherwise(F.array().cast("array<bigint>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def signature(tokens: Column, first: int = 6) -> Column:
    """MD5 of the sorted first tokens, joined by a bar."""
    return F.md5(F.array_join(F.sort_array(F.slice(tokens, 1, first)), "|").cast("binary"))


def shard_of(signature_hex: Column, shards: int) -> Column:
    """The first eight hexadecimal digits as a number, modulo the number of shards."""
    return (F.conv(F.substring(signature_hex, 1, 8), 16, 10).cast("long") % shards).cast("int")


def template(tokens: Column) -> Column:
    """The first four tokens, as a key for near-identical patterns."""
    return F.slice(tokens, 1, 4)


def adjacent_pairs(tokens: Column, sep: str = "_") -> Column:
    """Each token joined with its successor."""
    size = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), size), F.slice(tokens, F.lit(2), size), lambda a, b: F.concat(a, F.lit(sep), b))


def token_windows(tokens: Column, max_len: int = 256, stride: int = 32) -> Column:
    """Overlapping windows of tokens, two shorter than max_len, that share `stride` tokens.

    A list that fits gives one window, an empty one none; longer ones are cut
    at every step, so the last windows may lie within earlier ones.
    """
    inner = max_len - 2 if max_len > 2 else 2
    step = inner - stride if inner > stride else inner
    size = F.size(tokens)
    starts = F.sequence(F.lit(0), size - 1, F.lit(step))
    many = F.transform(starts, lambda i: F.slice(tokens, i + 1, inner))
    return F.when(size == 0, F.array().cast("array<array<string>>")).when(size <= inner, F.array(tokens)).otherwise(many)


def prefixes(parts: Column) -> Column:
    """Running concatenation: the first part, the first two, and so on."""
    size = F.size(parts)
    return F.when(size >= 1, F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(parts, 1, i), ""))).otherwise(F.array().cast("array<string>"))


def final_consonant(word: Column) -> Column:
    """T or F: whether the last character, a Hangul syllable, ends in a consonant; * for any other character or an empty word."""
    last = F.right(word, F.lit(1))
    code = F.ascii(last)
    return F.when(word.isNull() | (word == "") | ~last.rlike("^[가-힣]$"), "*").when((code - 44032) % 28 > 0, "T").otherwise("F")


def json_escaped_newlines(text: Column) -> Column:
    """Line feeds inside a sentence become spaces, for files of one sentence a line."""
    return F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))


def forward_slashes(path: Column) -> Column:
    """Backslashes of a path become slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))
