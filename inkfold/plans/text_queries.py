"""Queries on documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions.strings import TOKEN_STOPWORDS, jaccard, ngram_set, plain_tokens, shard_of, token_rows, token_windows
from inkfold.functions.vectors import doubles
from inkfold.operators import dedup, scoring, vectors, vocab
from inkfold.operators.storage import stored
from inkfold.plans.registry import query, table, texts_of

STOP_SQL = ", ".join(f"'{w}'" for w in TOKEN_STOPWORDS)
#: Tokens of a text, in DuckDB.
TOKENS_SQL = f"list_filter(string_split(regexp_replace(coalesce(text, ''), '[^0-9A-Za-z가-힣 ]', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN ({STOP_SQL}))"
TURNS_SQL = "turns AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND trim(text) <> '')"
WORDS_SQL = f"words AS (SELECT conv_id, unnest({TOKENS_SQL}) AS word FROM turns)"
LINES_SQL = f"lines AS (SELECT doc_id AS line_no, {TOKENS_SQL} AS tokens FROM documents)"
LONG_SQL = "long AS (SELECT line_no, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM lines)"
CENTERS_SQL = "centers AS (SELECT cluster_id, list(x ORDER BY i) AS c FROM (SELECT label AS cluster_id, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY cluster_id)"
NEAREST_SQL = "nearest AS (SELECT vec_id, arg_min(cluster_id, {'d': list_distance(embedding::DOUBLE[], c), 'k': cluster_id}) AS cluster_id FROM embeddings, centers GROUP BY vec_id)"
ASSIGNED_SQL = "nv AS (SELECT count(*) AS nv FROM embeddings), assigned AS (SELECT conv_id, cluster_id FROM turns, nv JOIN nearest ON vec_id = (conv_id * 8 + turn) % nv)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text) of the user's turns that are not blank: the prompts of a chat."""
    return table(spark, sf_dir, "conversations").where("role = 'user' and trim(text) <> ''").select("conv_id", "turn", "text")


def words_of(texts: DataFrame) -> DataFrame:
    return token_rows(texts, ["conv_id"], name="word")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, tokens) of documents."""
    return texts_of(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("line_no"), plain_tokens(F.col("text")).alias("tokens"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, text) of documents."""
    return texts_of(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "line_no")


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, embedding): mean vectors by label, written once, as most plans read them several times."""
    return stored(vectors.mean_vectors(table(spark, sf_dir, "embeddings"), "label").withColumnRenamed("label", "cluster_id"))


def assigned(spark: SparkSession, sf_dir: str, middles: DataFrame | None = None) -> DataFrame:
    """(conv_id, cluster_id): each embedded prompt's nearest cluster; the vector of a prompt stands at a place that its ids give."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nearest = vectors.assign_nearest(points, centers(spark, sf_dir) if middles is None else middles).select("vec_id", "cluster_id")
    prompts = scoring.first_texts(turns(spark, sf_dir), 1000, "conv_id", "turn")
    return prompts.select("conv_id", ((F.col("conv_id") * 8 + F.col("turn")) % points.count()).alias("vec_id")).join(nearest, "vec_id").select("conv_id", "cluster_id")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


FLUENCY_SQL = """n AS (SELECT conv_id, count(*) AS n_texts FROM turns GROUP BY conv_id),
c AS (SELECT conv_id, word, count(*)::DOUBLE AS c FROM words GROUP BY conv_id, word),
t AS (SELECT conv_id, sum(c) AS t, count(*) AS u FROM c GROUP BY conv_id),
h AS (SELECT conv_id, any_value(t.t) AS t, any_value(t.u) AS u, sum(-(c / t.t) * ln(c / t.t + 1e-12)) AS h FROM c JOIN t USING (conv_id) GROUP BY conv_id),
fl AS (SELECT n.conv_id, n_texts, coalesce(t, 0)::BIGINT AS n_tokens, coalesce(u, 0)::BIGINT AS n_distinct, 1 - exp(-n_texts / 8.0) AS s,
  greatest(coalesce(CASE WHEN u > 1 THEN least(greatest(h / ln(least(u, 500) + 1e-12) * (1 - exp(-t / 20.0)), 0), 1) ELSE 0 END, 0), 0.2) AS k FROM n LEFT JOIN h USING (conv_id))"""


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, {FLUENCY_SQL} SELECT conv_id, n_texts, n_tokens, n_distinct, round(s, 6) AS s, round(k, 6) AS k FROM fl")
def fluency_by_conversation(spark, sf_dir):
    texts = turns(spark, sf_dir)
    return rounded(scoring.fluency_parts(texts, words_of(texts), "conv_id"), "s", "k")


FOCUS_SQL = """w AS (SELECT conv_id, word, pow(count(*), 1.3) AS w FROM words GROUP BY conv_id, word),
wt AS (SELECT conv_id, sum(w) AS t, count(*) AS u FROM w GROUP BY conv_id),
lex AS (SELECT conv_id, any_value(u) AS n_distinct, 0.5 * sum((w / t) * (w / t)) + 0.5 * sum(-(w / t) * ln(w / t + 1e-12)) / ln(any_value(u) + 1e-12) AS r FROM w JOIN wt USING (conv_id) GROUP BY conv_id)"""


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, {FOCUS_SQL} SELECT conv_id, n_distinct, round(r, 6) AS r FROM lex")
def persistence_lexical_r(spark, sf_dir):
    return rounded(scoring.lexical_focus(words_of(turns(spark, sf_dir)), "conv_id").select("conv_id", "n_distinct", "r"), "r")


MORPHS_SQL = "m AS (SELECT conv_id, count(*) FILTER (word LIKE '%ly') AS n_modifiers FROM words GROUP BY conv_id)"


def morphs(texts: DataFrame) -> DataFrame:
    """(conv_id, word, tag): words in -ly stand for modifiers, as no tagger is part of the library."""
    return words_of(texts).withColumn("tag", F.when(F.col("word").endswith("ly"), "Adverb").otherwise("Noun"))


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, {MORPHS_SQL} SELECT conv_id, n_modifiers, round(1 - exp(-n_modifiers / 3.0), 6) AS s FROM m")
def modifier_saturation(spark, sf_dir):
    return rounded(scoring.modifier_saturation(morphs(turns(spark, sf_dir)), "conv_id"), "s")


COVER_SQL = """k AS (SELECT count(*) AS k FROM centers),
cn AS (SELECT conv_id, cluster_id, count(*) AS n FROM assigned GROUP BY conv_id, cluster_id),
ct AS (SELECT conv_id, sum(n) AS t, count(*) AS met FROM cn GROUP BY conv_id),
nt AS (SELECT conv_id, count(*) AS n_texts FROM turns GROUP BY conv_id),
ch AS (SELECT conv_id, any_value(t) AS t, any_value(met) AS met, sum(-((n + 0.5) / (t + 0.5 * k)) * ln((n + 0.5) / (t + 0.5 * k) + 1e-12)) AS h, sum(n * n) / pow(any_value(t), 2) AS q FROM cn JOIN ct USING (conv_id), k GROUP BY conv_id),
cov AS (SELECT nt.conv_id,
  coalesce(least(greatest((h + (k - met) * (-(0.5 / (t + 0.5 * k)) * ln(0.5 / (t + 0.5 * k) + 1e-12))) / ln(least(k, 64) + 1e-12) * (1 - exp(-n_texts / 5.0)), 0), 1), 0) AS c,
  coalesce(least(greatest(q * (1 - exp(-n_texts / 5.0)), 0), 1), 0) AS f FROM nt LEFT JOIN ch USING (conv_id), k)"""


@query(f"WITH {TURNS_SQL}, {CENTERS_SQL}, {NEAREST_SQL}, {ASSIGNED_SQL}, {COVER_SQL} SELECT conv_id, round(c, 6) AS c FROM cov")
def cluster_coverage_c(spark, sf_dir):
    middles = centers(spark, sf_dir)
    return rounded(scoring.cluster_coverage(turns(spark, sf_dir), assigned(spark, sf_dir, middles), middles.count(), "conv_id"), "c")


@query(f"WITH {TURNS_SQL}, {CENTERS_SQL}, {NEAREST_SQL}, {ASSIGNED_SQL}, {COVER_SQL} SELECT conv_id, round(f, 6) AS f FROM cov")
def cluster_focus_f(spark, sf_dir):
    return rounded(scoring.cluster_focus(turns(spark, sf_dir), assigned(spark, sf_dir), "conv_id"), "f")


@query(
    f"""WITH {TURNS_SQL}, {WORDS_SQL}, {FLUENCY_SQL}, {FOCUS_SQL}, {MORPHS_SQL}, {CENTERS_SQL}, {NEAREST_SQL}, {ASSIGNED_SQL}, {COVER_SQL},
sc AS (SELECT conv_id, 100 * least(greatest((s + k + c) / 3, 0), 1) AS fluency, 100 * least(greatest((1 - exp(-coalesce(n_modifiers, 0) / 3.0) + coalesce(r, 0) + f) / 3, 0), 1) AS persistence
  FROM fl JOIN cov USING (conv_id) LEFT JOIN lex USING (conv_id) LEFT JOIN m USING (conv_id))
SELECT conv_id, round(fluency, 4) AS fluency, round(persistence, 4) AS persistence, round(0.5 * fluency + 0.5 * persistence, 4) AS creativity FROM sc"""
)
def creativity_scores(spark, sf_dir):
    texts, middles = turns(spark, sf_dir), centers(spark, sf_dir)
    scores = scoring.creativity(texts, words_of(texts), morphs(texts), assigned(spark, sf_dir, middles), middles.count(), "conv_id")
    return rounded(scores.select("conv_id", "fluency", "persistence", "creativity"), "fluency", "persistence", "creativity", digits=4)


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def first_prompts(spark, sf_dir):
    return scoring.first_texts(turns(spark, sf_dir), 2, "conv_id", "turn").select("conv_id", "turn")


# ------------------------------------------------------------------ vocabulary


@query(f"WITH {LINES_SQL}, {LONG_SQL} SELECT token, count(*) AS n FROM long GROUP BY token")
def token_frequency(spark, sf_dir):
    return vocab.token_counts(token_rows(raw_lines(spark, sf_dir), []))


@query(f"WITH {LINES_SQL}, {LONG_SQL} SELECT token, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS freq FROM long GROUP BY token")
def relative_frequency(spark, sf_dir):
    return rounded(vocab.relative_frequency(stored(token_frequency(spark, sf_dir))), "freq", digits=9)


@query(f"WITH {LINES_SQL}, p AS (SELECT unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || '_' || tokens[i + 1])) AS token FROM lines) SELECT token, count(*) AS n FROM p GROUP BY token")
def bigram_frequency(spark, sf_dir):
    return vocab.ordered_pair_counts(lines(spark, sf_dir))


@query(
    f"""WITH {LINES_SQL}, {LONG_SQL}, keep AS (SELECT token FROM long GROUP BY token HAVING count(*) >= 20),
f AS (SELECT line_no, list(token ORDER BY pos) AS tokens FROM long SEMI JOIN keep USING (token) GROUP BY line_no),
b AS (SELECT line_no, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || '_' || tokens[i + 1])) AS bg, unnest(range(1, len(tokens))) AS pos FROM f),
kb AS (SELECT bg FROM b GROUP BY bg HAVING count(*) >= 5),
fb AS (SELECT line_no, list(bg ORDER BY pos) AS bgs FROM b SEMI JOIN kb USING (bg) GROUP BY line_no),
a AS (SELECT line_no, list_concat(f.tokens, coalesce(bgs, [])) AS tokens FROM f LEFT JOIN fb USING (line_no))
SELECT line_no, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM a WHERE len(tokens) >= 3"""
)
def vocab_filtered_bigrams(spark, sf_dir):
    made = vocab.filtered_bigrams(lines(spark, sf_dir), min_freq=20, min_bigram=5, min_tokens=3)
    return made.select("line_no", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query(f"WITH {LINES_SQL}, {LONG_SQL}, c AS (SELECT token, count(*) AS n FROM long GROUP BY token HAVING count(*) >= 5), common AS (SELECT token FROM c ORDER BY n DESC, token LIMIT 50) SELECT token, n FROM c ANTI JOIN common USING (token)")
def drop_common_topk(spark, sf_dir):
    return vocab.vocabulary(stored(token_frequency(spark, sf_dir)), 5, 50)


@query(f"WITH {LINES_SQL} SELECT line_no, len(tokens) AS n FROM lines WHERE len(tokens) >= 100")
def min_token_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("line_no", F.size("tokens").cast("long").alias("n")).where("n >= 100")


# ---------------------------------------------------------------- deduplication


#: A normalised text, in DuckDB, whose white space in patterns is ASCII's only.
NORMAL_SQL = r"trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"
CLEAN_SQL = f"clean AS (SELECT doc_id, {NORMAL_SQL} AS text FROM documents)"


@query(f"WITH {CLEAN_SQL} SELECT min(doc_id) AS line_no FROM clean WHERE text <> '' GROUP BY text")
def exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(raw_lines(spark, sf_dir)).select("line_no")


@query(f"WITH {CLEAN_SQL} SELECT count(*) AS n_in, count(DISTINCT CASE WHEN text <> '' THEN text END) AS n_out FROM clean")
def dedup_counts(spark, sf_dir):
    return dedup.dedup_counts(raw_lines(spark, sf_dir))


SIGN_SQL = f"{CLEAN_SQL}, lines AS (SELECT doc_id AS line_no, text, {TOKENS_SQL} AS tokens FROM clean), sg AS (SELECT line_no, text, md5(array_to_string(list_sort(tokens[1:6]), '|')) AS sig, tokens FROM lines)"


@query(f"WITH {SIGN_SQL} SELECT line_no, sig, (('0x' || sig[1:8])::BIGINT % 1024)::INT AS shard FROM sg")
def shard_signature(spark, sf_dir):
    return dedup.with_signature(raw_lines(spark, sf_dir)).select("line_no", "sig", "shard")


#: Of pairs (i, j), i before j: the rows that go if a row goes with any earlier one that stays.
GREEDY_SQL = """nodes AS (SELECT j, row_number() OVER (ORDER BY {order}) AS n, list(i) AS before FROM pairs GROUP BY {by}),
walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone UNION ALL
  SELECT nodes.n, CASE WHEN len(list_filter(before, lambda i: NOT list_contains(gone, i))) > 0 THEN list_append(gone, j) ELSE gone END FROM walk JOIN nodes ON nodes.n = walk.n + 1),
gone AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM walk ORDER BY n DESC LIMIT 1))"""


@query(
    f"""WITH RECURSIVE {SIGN_SQL}, g AS (SELECT min(line_no) AS line_no, any_value(('0x' || sig[1:8])::BIGINT % 1024) AS shard,
  list_distinct(list_transform(range(1, greatest(len(any_value(tokens)) - 1, 1)), lambda k: any_value(tokens)[k] || ' ' || any_value(tokens)[k + 1] || ' ' || any_value(tokens)[k + 2])) AS g FROM sg WHERE text <> '' GROUP BY text),
pairs AS (SELECT a.line_no AS i, b.line_no AS j FROM g a JOIN g b ON a.shard = b.shard AND a.line_no < b.line_no WHERE len(a.g) > 0 AND len(b.g) > 0
  AND least(len(a.g), len(b.g)) >= 0.9 * greatest(len(a.g), len(b.g)) AND len(list_intersect(a.g, b.g)) >= 0.9 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))),
{GREEDY_SQL.format(order="j", by="j")} SELECT line_no FROM g WHERE line_no NOT IN (SELECT id FROM gone)""".replace("any_value(tokens)", "first(tokens)")
)
def near_dup_greedy(spark, sf_dir):
    return dedup.near_dedup(raw_lines(spark, sf_dir), 0.9, 1024).select("line_no")


@query(f"WITH {SIGN_SQL}, p AS (SELECT line_no, row_number() OVER (PARTITION BY sig[1:8], tokens[1:4] ORDER BY md5(text), line_no) AS n FROM sg WHERE text <> '') SELECT line_no FROM p WHERE n <= 2")
def template_cap(spark, sf_dir):
    return dedup.cap_templates(raw_lines(spark, sf_dir), 2, shards=1 << 31).select("line_no")


@query(f"WITH {LINES_SQL}, w AS (SELECT line_no, tokens, unnest(CASE WHEN len(tokens) = 0 THEN [] WHEN len(tokens) <= 62 THEN [0] ELSE range(0, len(tokens), 46) END) AS st FROM lines) SELECT line_no, (st // 46)::INT AS win, md5(array_to_string(tokens[st + 1:st + 62], ' ')) AS digest FROM w")
def token_window_digests(spark, sf_dir):
    made = lines(spark, sf_dir).select("line_no", F.posexplode(token_windows(F.col("tokens"), 64, 16)).alias("win", "w"))
    return made.select("line_no", "win", F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query("SELECT DISTINCT text FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT text FROM documents WHERE doc_id % 2 = 1) WHERE text <> ''")
def corpus_union_append(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old, new = docs.where("doc_id % 2 = 0").select("text"), docs.where("doc_id % 2 = 1").select("text")
    return old.unionByName(new).where("text <> ''").distinct()


GRAMS_SQL = "list_distinct(list_transform(range(1, greatest(len(tokens) - 1, 1)), lambda i: tokens[i:i + 2]))"


@query(
    f"""WITH {LINES_SQL}, g AS (SELECT line_no, CASE WHEN len(tokens) >= 3 THEN {GRAMS_SQL} ELSE [] END AS g FROM lines),
p AS (SELECT a.line_no, len(list_intersect(a.g, b.g)) AS i, len(a.g) AS x, len(b.g) AS y FROM g a JOIN g b ON b.line_no = a.line_no + 1)
SELECT line_no, round(CASE WHEN x = 0 OR y = 0 THEN 0.0 ELSE i / (x + y - i) END, 6) AS similarity FROM p"""
)
def neighbour_jaccard(spark, sf_dir):
    g = lines(spark, sf_dir).select("line_no", ngram_set(F.col("tokens")).alias("g"))
    nxt = g.select((F.col("line_no") - 1).alias("line_no"), F.col("g").alias("h"))
    return g.join(nxt, "line_no").select("line_no", F.round(jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from inkfold.streaming.streams import windowed_counts

    return rounded(windowed_counts(table(spark, sf_dir, "events")), "total", digits=4)


def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.normalized(table(spark, sf_dir, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("embedding")))


# ------------------------------------------------------------- tagged words

TAGS = ("NNG", "JKS", "VV", "EF", "VA", "NNP", "SF", "XR", "MAG", "NP")
TAGGED_SQL = f"tagged AS (SELECT conv_id, word, {list(TAGS)}[('0x' || md5(word)[1:8])::BIGINT % 10 + 1] AS tag FROM words)"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, word, tag): words with tags that follow from their digest, in place of a tagger."""
    at = shard_of(F.md5(F.col("word").cast("binary")), 10)
    return words_of(turns(spark, sf_dir)).withColumn("tag", F.get(F.array(*map(F.lit, TAGS)), at))


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, {TAGGED_SQL} SELECT word, tag, count(*) AS n FROM tagged WHERE length(word) > 1 AND tag NOT IN ('JKS', 'EF', 'SF') AND word NOT IN ('the', 'of') GROUP BY ALL")
def morph_filter(spark, sf_dir):
    stop = spark.createDataFrame([("the",), ("of",), ("of",)], "word string")
    return vocab.filter_morphs(tagged(spark, sf_dir), stop).groupBy("word", "tag").agg(F.count("*").alias("n"))


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, {TAGGED_SQL} SELECT word, count(*) AS n FROM tagged WHERE tag IN ('NNG', 'NNP', 'VV', 'VA') GROUP BY ALL")
def morph_meaning_words(spark, sf_dir):
    return vocab.meaning_words(tagged(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, {TAGGED_SQL} SELECT lower(word) AS word, count(*) AS n FROM tagged WHERE tag IN ('NNG', 'NNP', 'VA', 'VV', 'XR') AND word NOT IN ('and', 'The') GROUP BY ALL")
def morph_corpus_words(spark, sf_dir):
    return vocab.corpus_words(tagged(spark, sf_dir), ("and", "The")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, {TAGGED_SQL} SELECT DISTINCT conv_id, word FROM tagged WHERE tag IN ('NNG', 'NNP', 'NP', 'VA')")
def category_words(spark, sf_dir):
    return vocab.category_words(tagged(spark, sf_dir)).select("conv_id", "word").distinct()


# ------------------------------------------------------------ string functions


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^가-힣\\s\\x0B\\x1C-\\x1F]', ' ', 'g'), '[\\s\\x0B\\x1C-\\x1F]+', ' ', 'g')) AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '가 나' FROM documents WHERE doc_id % 2 = 1")
def hangul_text(spark, sf_dir):
    from inkfold.functions.strings import hangul_only

    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("가,  나!").alias("text"))
    return rows.select("doc_id", hangul_only(F.col("text")).alias("text"))


@query(f"WITH {CLEAN_SQL} SELECT doc_id, md5(text) AS digest FROM clean")
def normalized_text(spark, sf_dir):
    from inkfold.functions.strings import normalized

    return raw_lines(spark, sf_dir).select(F.col("line_no").alias("doc_id"), F.md5(normalized(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(trim(replace(text, chr(10), ' '))) AS digest, 'a/b/' || doc_id AS path FROM documents")
def escaped_text(spark, sf_dir):
    from inkfold.functions.strings import forward_slashes, json_escaped_newlines

    path = F.concat(F.lit("a\\b\\"), F.col("line_no").cast("string"))
    return raw_lines(spark, sf_dir).select(F.col("line_no").alias("doc_id"), F.md5(json_escaped_newlines(F.col("text")).cast("binary")).alias("digest"), forward_slashes(path).alias("path"))
