"""Taxonomy: clusters to super-categories, keywords by super-category, and category prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.vectors import assign_nearest

#: Words that are no keywords, for the two bundle builders.
KEYWORD_STOP_RUNTIME = ("것", "수", "들", "하다", "되다", "있다", "없다", "이다", "그리고", "등", "및", "또는", "이번", "오늘", "같다", "같은")
KEYWORD_STOP_FIX = ("것", "수", "들", "하다", "되다", "있다", "없다", "이다", "위해", "그리고", "등", "및", "또는", "같다", "같은", "이번", "오늘")


def labelled_lines(lines: DataFrame, labels: DataFrame, key: str = "line_no") -> DataFrame:
    """Lines with their labels, by key; lines or labels without a partner go."""
    return lines.join(labels, key)


def super_of(labelled: DataFrame, super_map: DataFrame, cid: str = "cluster_id") -> DataFrame:
    """Adds super_id; clusters that the map lacks go."""
    return labelled.join(super_map.select(cid, "super_id"), cid)


def super_name(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds super_name, super_N where no name is known."""
    return rows.join(names.select("super_id", "name"), "super_id", "left").withColumn("super_name", F.coalesce("name", F.concat(F.lit("super_"), F.col("super_id").cast("string")))).drop("name")


def super_keywords(lines: DataFrame, top_n: int = 30, stop: tuple[str, ...] = KEYWORD_STOP_RUNTIME, key: str = "line_no") -> DataFrame:
    """(super_id, token, n, place): the most frequent tokens of each super-category; ties by first place in the corpus.

    lines: (key, super_id, tokens). The count is the feature's own limit.
    """
    long = lines.select(key, "super_id", F.posexplode("tokens").alias("pos", "token"))
    if stop:
        long = long.where(~F.col("token").isin(*stop))
    counts = long.where("token <> ''").groupBy("super_id", "token").agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy("super_id").orderBy(F.desc("n"), "first", "token"))
    return counts.withColumn("place", place).where(F.col("place") <= top_n).select("super_id", "token", "n", "place")


def top_clusters(lines: DataFrame, show: int = 10, top_n: int = 15, cid: str = "cluster_id", key: str = "line_no", stop: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent tokens of the largest clusters; ties by cluster id."""
    largest = lines.groupBy(cid).agg(F.count("*").alias("size")).orderBy(F.desc("size"), cid).limit(show)
    rows = lines.join(F.broadcast(largest), cid).select(key, F.col(cid).alias("super_id"), "tokens")  # `show` rows
    return super_keywords(rows, top_n, stop, key).withColumnRenamed("super_id", cid)


def super_labels(labels: DataFrame, super_map: DataFrame) -> DataFrame:
    """Line labels as super-categories."""
    return super_of(labels, super_map)


def uncovered(super_map: DataFrame, clusters: int, cid: str = "cluster_id") -> DataFrame:
    """(cluster_id, what): ids missing from 0 .. clusters - 1, and ids beyond; empty if the map is complete."""
    spark = super_map.sparkSession
    want = spark.range(clusters).select(F.col("id").cast("int").alias(cid))
    have = super_map.select(F.col(cid).cast("int").alias(cid)).distinct()
    missing = want.join(have, cid, "left_anti").select(cid, F.lit("missing").alias("what"))
    return missing.union(have.join(want, cid, "left_anti").select(cid, F.lit("unknown").alias("what")))


def keyword_categories(categories: DataFrame) -> DataFrame:
    """(keyword, category) from (place, category, keywords): of a keyword's categories the last one wins."""
    long = categories.select("place", "category", F.posexplode("keywords").alias("pos", "keyword"))
    return long.groupBy("keyword").agg(F.max_by("category", F.struct("place", "pos")).alias("category"))


def predict_categories(words: DataFrame, keywords: DataFrame, embedded: DataFrame, centroids: DataFrame, super_map: DataFrame, names: DataFrame) -> DataFrame:
    """(prompt_id, word, category), one row for each distinct word of a prompt.

    Known keywords need no vector; only the others are compared with the
    centroids. embedded: (word, embedding). Words with neither go.
    """
    distinct = words.select("prompt_id", "word").distinct()
    known = distinct.join(keywords.withColumnRenamed("keyword", "word"), "word").select("prompt_id", "word", "category")
    rest = distinct.join(keywords.select(F.col("keyword").alias("word")), "word", "left_anti")
    vectors = rest.select("word").distinct().join(embedded, "word")
    named = super_name(super_of(assign_nearest(vectors, centroids), super_map), names)
    return known.union(rest.join(named.select("word", "super_name"), "word").select("prompt_id", "word", F.col("super_name").alias("category")))


def category_of_centroids(categories: DataFrame, embedded: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, category, similarity): the category whose keywords' mean vector is most similar; ties by place in the list."""
    from inkfold.operators.vectors import mean_vectors, most_similar

    long = categories.select("place", F.explode("keywords").alias("word")).join(embedded, "word")
    means = mean_vectors(long, "place").withColumnRenamed("place", "at")
    best = most_similar(centroids.withColumnRenamed("cluster_id", "of"), means, "at")
    return best.join(categories.select(F.col("place").alias("at"), "category"), "at").select(F.col("of").alias("cluster_id"), "category", "similarity")


def bundle(super_map: DataFrame, names: DataFrame, keywords: DataFrame, centroids_path: str) -> DataFrame:
    """One row: the runtime bundle as JSON, from tables whose rows are super-categories and clusters."""
    clusters = super_map.agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster_id", "super_id"))), lambda x: x["super_id"]).alias("centroid_to_super"))
    named = names.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("super_id").cast("string"), "name")))).alias("super_names"))
    lists = keywords.groupBy("super_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("words"))
    words = lists.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("super_id").cast("string"), "words")))).alias("super_keywords"))
    row = F.struct(F.lit(centroids_path.replace("\\", "/")).alias("centroids_path"), "centroid_to_super", "super_names", "super_keywords")
    return clusters.join(F.broadcast(named)).join(F.broadcast(words)).select(F.to_json(row).alias("bundle"))  # one row each


def parse_super_map(text: Column) -> Column:
    """A JSON object or list as array<struct<cluster_id, super_id>>."""
    entries = F.transform(F.map_entries(F.from_json(text, "map<string,int>")), lambda e: F.struct(e["key"].cast("int").alias("cluster_id"), e["value"].alias("super_id")))
    listed = F.transform(F.from_json(text, "array<int>"), lambda x, i: F.struct(i.alias("cluster_id"), x.alias("super_id")))
    return F.when(F.ltrim(text).startswith("["), listed).otherwise(entries)
