"""Queries on embeddings, clusters and taxonomies."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions.strings import TOKEN_STOPWORDS, split_tokens
from inkfold.operators import clustering, taxonomy, vectors
from inkfold.operators.storage import stored
from inkfold.plans.registry import query, table
from inkfold.plans.text_queries import CENTERS_SQL, LINES_SQL, LONG_SQL, NEAREST_SQL, TOKENS_SQL, centers, raw_lines, rounded, unit_rows

COS_SQL = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-12)"


@query(f"WITH {CENTERS_SQL}, {NEAREST_SQL} SELECT vec_id, cluster_id FROM nearest")
def cluster_assign_nearest(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.assign_nearest(points, centers(spark, sf_dir)).select("vec_id", "cluster_id")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-9), 6) AS first FROM embeddings")
def unit_vectors(spark, sf_dir):
    from inkfold.functions.vectors import doubles, norm

    raw = table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(doubles(F.col("embedding"))), 6).alias("norm"))
    return raw.join(unit_rows(spark, sf_dir).select("vec_id", F.round(F.col("embedding")[0], 6).alias("first")), "vec_id")


@query(f"""WITH {CENTERS_SQL}, s AS (SELECT vec_id, max({COS_SQL.format(a="embedding::DOUBLE[]", b="c")}) AS m FROM embeddings, centers GROUP BY vec_id)
SELECT round(quantile_cont(m, 0.05), 6) AS p5, round(quantile_cont(m, 0.25), 6) AS p25, round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.75), 6) AS p75, round(quantile_cont(m, 0.95), 6) AS p95, round(quantile_cont(m, 0.99), 6) AS p99 FROM s""")
def nearest_cosine_percentiles(spark, sf_dir):
    best = vectors.most_similar(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), centers(spark, sf_dir))
    p = vectors.percentiles(best, "similarity")
    return rounded(p, *p.columns)


AFFINITY_SQL = f"""{CENTERS_SQL}, e AS (SELECT a.cluster_id AS a, b.cluster_id AS b, 0.9 * least(greatest({COS_SQL.format(a="a.c", b="b.c")}, 0), 1) AS w FROM centers a JOIN centers b ON a.cluster_id <> b.cluster_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS n FROM e),
kn AS (SELECT a, b, w FROM r WHERE n <= 3), sy AS (SELECT a, b, max(w) AS w FROM (SELECT * FROM kn UNION ALL SELECT b, a, w FROM kn) GROUP BY a, b)"""


@query(f"WITH {AFFINITY_SQL} SELECT a, b, round(w, 6) AS w FROM sy")
def centroid_affinity_knn(spark, sf_dir):
    return rounded(vectors.knn_sparsify(vectors.affinity(centers(spark, sf_dir)), 3), "w")


@query(f"WITH {AFFINITY_SQL} SELECT a AS node, round(sum(w), 6) AS w FROM e GROUP BY a")
def centroid_centrality(spark, sf_dir):
    return rounded(clustering.centrality(vectors.affinity(centers(spark, sf_dir))), "w")


@query(f"WITH {CENTERS_SQL} SELECT a.cluster_id AS a, b.cluster_id AS b, round({COS_SQL.format(a='a.c', b='b.c')}, 6) AS w FROM centers a JOIN centers b ON a.cluster_id < b.cluster_id WHERE {COS_SQL.format(a='a.c', b='b.c')} > 0.05")
def near_duplicate_centroids(spark, sf_dir):
    return rounded(vectors.near_pairs(centers(spark, sf_dir), 0.05), "w")


@query(f"WITH {CENTERS_SQL}, x AS (SELECT sqrt(list_dot_product(c, c)) AS x FROM centers) SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, count(*) FILTER (x = 0) AS zeros FROM x")
def centroid_norm_stats(spark, sf_dir):
    return rounded(vectors.norm_stats(centers(spark, sf_dir)), "mean", "std", "min", "max")


@query("WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS clusters, min(n) AS min, quantile_cont(n, 0.5) AS median, max(n) AS max, count(*) FILTER (n <= 5) AS small FROM s")
def cluster_size_stats(spark, sf_dir):
    return vectors.cluster_sizes(table(spark, sf_dir, "embeddings"), "label")


@query("WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90 FROM s) SELECT round(least(greatest(0.5 * p10 / p50 + 0.5 * (p50 / (p90 + 1e-9)), 0), 1), 6) AS balance FROM p")
def cluster_balance(spark, sf_dir):
    return rounded(vectors.balance(table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))), "balance")


SILHOUETTE_SQL = """v AS (SELECT vec_id, label, {v} AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum({d}) AS s, count(*) AS n FROM v a JOIN v b ON true GROUP BY ALL),
i AS (SELECT vec_id, max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b, max(CASE WHEN own = other THEN n END) AS n FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM i"""


@query("WITH " + SILHOUETTE_SQL.format(v="embedding::DOUBLE[]", d="list_distance(a.v, b.v)"))
def silhouette_euclid(spark, sf_dir):
    return rounded(clustering.silhouette_euclid(table(spark, sf_dir, "embeddings"), "vec_id", "label"), "silhouette")


@query("WITH " + SILHOUETTE_SQL.format(v="embedding::DOUBLE[]", d="1 - list_cosine_similarity(a.v, b.v)"))
def silhouette_cosine(spark, sf_dir):
    value = clustering.silhouette_cosine(table(spark, sf_dir, "embeddings"), "label")
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


@query(f"""WITH {CENTERS_SQL}, s AS (SELECT label, avg(list_distance(embedding::DOUBLE[], c)) AS s FROM embeddings JOIN centers ON label = cluster_id GROUP BY label),
r AS (SELECT a.cluster_id AS a, max((x.s + y.s) / list_distance(a.c, b.c)) AS r FROM centers a JOIN centers b ON a.cluster_id <> b.cluster_id JOIN s x ON x.label = a.cluster_id JOIN s y ON y.label = b.cluster_id GROUP BY a.cluster_id) SELECT round(avg(r), 6) AS dbi FROM r""")
def davies_bouldin(spark, sf_dir):
    return rounded(clustering.davies_bouldin(table(spark, sf_dir, "embeddings"), "label"), "dbi")


@query()
def super_category_groups(spark, sf_dir):
    c = centers(spark, sf_dir)
    return clustering.super_categories(vectors.knn_sparsify(vectors.affinity(c), 5).where("a < b"), c, (2, 3, 4))[0]


@query()
def kmeans_assignment(spark, sf_dir):
    _, labelled = clustering.fit_kmeans(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 8, max_iter=20)
    return labelled.select("vec_id", "cluster_id")


# ------------------------------------------------------------------- taxonomy

LABELLED_SQL = f"{LINES_SQL}, {LONG_SQL}, lab AS (SELECT line_no, label AS cluster_id, (label % 4)::INT AS super_id, pos, token FROM long JOIN embeddings ON vec_id = line_no)"


def labelled(spark, sf_dir):
    """(line_no, cluster_id, tokens): documents with the label of the vector of the same number; stopwords are dropped with the keywords'."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_no"), F.col("label").alias("cluster_id"))
    return taxonomy.labelled_lines(raw_lines(spark, sf_dir), labels).withColumn("tokens", split_tokens(F.col("text"))).drop("text")


def super_map(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"), (F.col("label") % 4).cast("int").alias("super_id")).distinct()


RANKED_SQL = "SELECT {k}, token, count(*) AS n, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, min({{'l': line_no, 'p': pos}}), token) AS place FROM {t} GROUP BY {k}, token"


@query(f"WITH {LABELLED_SQL}, r AS ({RANKED_SQL.format(k='super_id', t='lab')}) SELECT super_id, token, n, place::INT AS place FROM r WHERE place <= 30")
def super_top_keywords(spark, sf_dir):
    return taxonomy.super_keywords(taxonomy.super_of(labelled(spark, sf_dir), super_map(spark, sf_dir)), stop=taxonomy.KEYWORD_STOP_RUNTIME + TOKEN_STOPWORDS)


@query(f"""WITH {LABELLED_SQL}, big AS (SELECT cluster_id FROM (SELECT label AS cluster_id, count(*) AS n FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY label) ORDER BY n DESC, cluster_id LIMIT 5),
lb AS (SELECT * FROM lab SEMI JOIN big USING (cluster_id)), r AS ({RANKED_SQL.format(k="cluster_id", t="lb")}) SELECT cluster_id, token, n, place::INT AS place FROM r WHERE place <= 10""")
def top_tokens_per_cluster(spark, sf_dir):
    return taxonomy.top_clusters(labelled(spark, sf_dir), 5, 10, stop=TOKEN_STOPWORDS)


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 10")
def largest_clusters(spark, sf_dir):
    return vectors.largest_clusters(table(spark, sf_dir, "embeddings"), 10, "label")


@query("SELECT vec_id AS line_no, (label % 4)::INT AS super_id FROM embeddings")
def line_super_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_no"), F.col("label").alias("cluster_id"))
    return taxonomy.super_labels(labels, super_map(spark, sf_dir)).select("line_no", "super_id")


@query("SELECT i::INT AS cluster_id, 'missing' AS what FROM range(12) t(i) WHERE i NOT IN (SELECT label FROM embeddings)")
def uncovered_clusters(spark, sf_dir):
    return taxonomy.uncovered(super_map(spark, sf_dir), 12)


CATEGORIES = [(0, "weather", ["rain", "cloud", "sun"]), (1, "place", ["the", "park", "cloud"]), (2, "mood", ["of", "calm", "of"])]


def categories(spark):
    return spark.createDataFrame(CATEGORIES, "place int, category string, keywords array<string>")


INVERTED_SQL = "inv AS (SELECT * FROM (VALUES ('rain', 'weather'), ('cloud', 'place'), ('sun', 'weather'), ('the', 'place'), ('park', 'place'), ('of', 'mood'), ('calm', 'mood')) v(keyword, category))"


@query(f"WITH {INVERTED_SQL} SELECT keyword, category FROM inv")
def keyword_map_inversion(spark, sf_dir):
    return taxonomy.keyword_categories(categories(spark))


@query(
    f"""WITH {CENTERS_SQL}, {NEAREST_SQL}, {INVERTED_SQL},
w AS (SELECT DISTINCT conv_id AS prompt_id, unnest({TOKENS_SQL}) AS word FROM conversations WHERE role = 'user' AND trim(text) <> ''),
v AS (SELECT prompt_id, word, ('0x' || md5(word)[1:8])::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM w)
SELECT prompt_id, word, coalesce(category, CASE WHEN cluster_id % 4 = 1 THEN 'one' ELSE 'super_' || (cluster_id % 4) END) AS category FROM v LEFT JOIN inv ON keyword = word LEFT JOIN nearest USING (vec_id)"""
)
def category_lookup_fallback(spark, sf_dir):
    from inkfold.functions.strings import shard_of
    from inkfold.plans.text_queries import turns, words_of

    points = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    words = stored(words_of(turns(spark, sf_dir)).withColumnRenamed("conv_id", "prompt_id").distinct())
    place = shard_of(F.md5(F.col("word").cast("binary")), points.count()).cast("long")
    embedded = words.select("word").distinct().withColumn("vec_id", place).join(points, "vec_id").select("word", "embedding")
    names = spark.createDataFrame([(1, "one")], "super_id int, name string")
    return taxonomy.predict_categories(words, taxonomy.keyword_categories(categories(spark)), embedded, centers(spark, sf_dir), super_map(spark, sf_dir), names)


LINED_SQL = "lc AS (SELECT DISTINCT vec_id // 10 AS line_no, label AS c FROM embeddings)"


@query(f"WITH {LINED_SQL} SELECT a.c AS a, b.c AS b, count(*) AS n FROM lc a JOIN lc b ON a.line_no = b.line_no AND a.c < b.c GROUP BY ALL")
def cluster_cooccurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("line_no"), F.col("label").alias("cluster_id"))
    return vectors.cooccurrence(rows)


CATEGORY_SQL = "kw AS (SELECT vec_id % 3 AS place, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 30), km AS (SELECT place, list(x ORDER BY i) AS m FROM (SELECT place, i, avg(e[i]) AS x FROM kw, range(1, 65) t(i) GROUP BY place, i) GROUP BY place)"


@query(f"WITH {CENTERS_SQL}, {CATEGORY_SQL}, s AS (SELECT cluster_id, place, {COS_SQL.format(a='c', b='m')} AS w FROM centers, km) SELECT cluster_id, 'k' || place AS category, round(w, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, place) = 1")
def category_of_centroids(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id < 30")  # the keywords of the categories
    embedded = rows.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), "embedding")
    lists = [(p, f"k{p}", [f"w{v}" for v in range(30) if v % 3 == p]) for p in range(3)]
    given = spark.createDataFrame(lists, "place int, category string, keywords array<string>")
    return rounded(taxonomy.category_of_centroids(given, embedded, centers(spark, sf_dir)), "similarity")


@query("SELECT k::INT AS k, c::INT AS candidate FROM (SELECT k, unnest(list_distinct([k] || list_transform([0.8, 0.9, 1.1, 1.2], lambda r: greatest(2, floor(k * r)::INT)))) AS c FROM range(1, 120, 7) t(k))")
def k_candidates(spark, sf_dir):
    return spark.createDataFrame([(k, c) for k in range(1, 120, 7) for c in clustering.k_candidates(k)], "k int, candidate int")


@query("SELECT vec_id FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return vectors.hashed_sample(table(spark, sf_dir, "embeddings").select("vec_id"), 100, "vec_id")
