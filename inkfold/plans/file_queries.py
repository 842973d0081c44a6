"""Queries that write tables in a source's format and read them back: readers, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.operators import scoring, taxonomy, vectors
from inkfold.operators.storage import shared_dir, stored
from inkfold.plans.registry import query, table
from inkfold.plans.text_queries import FLUENCY_SQL, NORMAL_SQL, TURNS_SQL, WORDS_SQL, raw_lines, rounded, turns
from inkfold.sources import readers, sinks
from inkfold.streaming import streams


def folder(spark: SparkSession) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


ONE_LINE_SQL = r"trim(regexp_replace(text, '[\r\n]+', ' ', 'g'))"


@query(f"SELECT {ONE_LINE_SQL} AS text FROM documents WHERE {ONE_LINE_SQL} <> ''")
def line_round_trip(spark, sf_dir):
    place = folder(spark)
    sinks.write_lines(raw_lines(spark, sf_dir), place)
    return readers.read_lines(spark, place)


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS line_no, c_name AS text FROM customer QUALIFY c_custkey % 7 <> 3")
def numbered_line_round_trip(spark, sf_dir):
    place = folder(spark)
    names = table(spark, sf_dir, "customer").orderBy("c_custkey").select(F.when(F.col("c_custkey") % 7 == 3, "").otherwise(F.col("c_name")).alias("value"))
    names.write.text(place)
    return readers.read_numbered_lines(spark, place)


CAPTIONS_SQL = "SELECT CASE WHEN n_nationkey % 2 = 0 THEN '도시 ' || n_name ELSE n_name END AS caption FROM nation"


@query(CAPTIONS_SQL)
def caption_file(spark, sf_dir):
    place = folder(spark)
    row = F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("도시\n"), "n_name")).alias("caption_ko"), "n_name")
    listed = table(spark, sf_dir, "nation").select(row.alias("r")).select("r.caption_ko", F.col("r.n_name").alias("caption"))
    listed.agg(F.to_json(F.struct(F.collect_list(F.struct("caption_ko", "caption")).alias("annotations"))).alias("value")).write.text(place)
    return readers.read_captions(spark, place)


@query(f"WITH c AS ({CAPTIONS_SQL}) SELECT caption, 2::BIGINT AS bad_files FROM c")
def caption_folder(spark, sf_dir):
    place = folder(spark)
    rows = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("part"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("도시 "), "n_name")).alias("caption_ko"), F.col("n_name").alias("caption"))
    for k in range(5):
        one = rows.where(F.col("part") == k).agg(F.to_json(F.collect_list(F.struct("caption_ko", "caption"))).alias("value")).coalesce(1)
        one.write.text(f"{place}/{k}")
    for k in (5, 6):
        spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{place}/{k}")
    captions, bad = readers.read_caption_folder(spark, place, "*.txt")
    return captions.join(F.broadcast(bad))


@query("SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def embedding_record_round_trip(spark, sf_dir):
    place = folder(spark)
    rows = table(spark, sf_dir, "embeddings")
    sinks.write_records(rows.select(F.array(F.col("label").cast("int")).alias("ids"), F.col("embedding").alias("emb"), F.struct(F.col("vec_id").alias("line"), F.lit(0).alias("win")).alias("meta")), place)
    back = readers.read_embedding_records(spark, place)
    total = F.aggregate(F.col("emb").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return back.select(F.col("meta.line").alias("vec_id"), F.col("ids")[0].cast("int").alias("label"), F.round(total, 4).alias("total"))


@query("SELECT vec_id AS row_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last, label::BIGINT AS label FROM embeddings")
def npy_round_trip(spark, sf_dir):
    place = folder(spark).removeprefix("file:")
    rows = table(spark, sf_dir, "embeddings")
    spark.createDataFrame([], "x int").write.parquet(f"{place}/made")
    sinks.write_npy(rows, f"{place}/m.npy", "vec_id", "embedding")
    sinks.write_npy(rows, f"{place}/v.npy", "vec_id", "label", "int32")
    back = readers.read_npy(spark, f"{place}/m.npy").join(readers.read_npy_vector(spark, f"{place}/v.npy"), "row_id")
    return back.select("row_id", F.round(F.col("emb")[0].cast("double"), 6).alias("first"), F.round(F.col("emb")[63].cast("double"), 6).alias("last"), "label")


def maps(spark, sf_dir):
    """(cluster_id, super_id), (super_id, name), (super_id, token, n, place): nations by region, as a small taxonomy."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    of = nation.select(F.col("n_nationkey").cast("int").alias("cluster_id"), F.col("n_regionkey").cast("int").alias("super_id"))
    names = region.select(F.col("r_regionkey").cast("int").alias("super_id"), F.col("r_name").alias("name"))
    words = nation.select(F.col("n_regionkey").cast("int").alias("super_id"), F.col("n_name").alias("token"), F.lit(1).cast("long").alias("n"), (F.col("n_nationkey") + 1).cast("int").alias("place"))
    return of, names, words


@query("SELECT n_nationkey::INT AS cluster_id, n_regionkey::INT AS super_id FROM nation")
def super_map_round_trip(spark, sf_dir):
    place = folder(spark)
    sinks.json_map(maps(spark, sf_dir)[0], "cluster_id", "super_id").write.text(place)
    return readers.read_super_map(spark, place)


@query("SELECT r_regionkey::INT AS super_id, r_name AS name, list(n_name ORDER BY n_nationkey)::VARCHAR AS words, count(*) AS clusters FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def runtime_bundle(spark, sf_dir):
    place = folder(spark)
    of, names, words = maps(spark, sf_dir)
    taxonomy.bundle(of, names, words, "a\\b.npy").write.text(f"{place}/bundle")
    sinks.write_side_files(place, of, names, words)
    named = readers.read_super_names(spark, runtime=f"{place}/bundle").join(readers.read_super_names(spark, names=f"{place}/super_names.json"), ["super_id", "name"])
    lists = spark.read.text(f"{place}/super_keywords.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("k", "w"))
    whole = spark.read.text(f"{place}/bundle", wholetext=True).select(F.from_json("value", "struct<centroid_to_super:array<int>>")["centroid_to_super"].alias("c"))
    sizes = whole.select(F.explode("c").alias("super_id")).groupBy("super_id").agg(F.count("*").alias("clusters"))
    shown = lists.select(F.col("k").cast("int").alias("super_id"), F.concat(F.lit("["), F.array_join("w", ", "), F.lit("]")).alias("words"))
    return named.join(shown, "super_id").join(sizes, "super_id")


@query("""WITH t AS (SELECT n_regionkey AS s, list(n_nationkey ORDER BY n_nationkey) AS m, list(n_name || ':1' ORDER BY n_nationkey) AS w FROM nation GROUP BY 1)
SELECT s::INT AS super_id, '[super ' || s || ']' || chr(10) || ' members: [' || array_to_string(m, ', ') || ']' || chr(10) || ' central: ' || m[1] || chr(10) || ' top_tokens: ' || array_to_string(w, ', ') AS report FROM t""")
def super_preview(spark, sf_dir):
    of, _, words = maps(spark, sf_dir)
    edges = of.alias("a").join(of.alias("b"), F.expr("a.super_id = b.super_id and a.cluster_id < b.cluster_id")).select(F.col("a.cluster_id").alias("a"), F.col("b.cluster_id").alias("b"), F.lit(1.0).alias("w"))
    return sinks.preview_report(of, edges, words)


@query("SELECT DISTINCT lower(n_name) AS word FROM nation WHERE n_nationkey % 3 <> 0")
def stopword_file(spark, sf_dir):
    place = folder(spark)
    rows = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("#"), "n_name")).otherwise(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).alias("value"))
    rows.unionAll(rows).write.text(place)
    return readers.read_stopwords(spark, place)


@query("SELECT row_number() OVER (ORDER BY r_regionkey)::INT - 1 AS place, r_name AS category, list(n_name ORDER BY n_nationkey)::VARCHAR AS keywords FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def category_keyword_file(spark, sf_dir):
    place = folder(spark)
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    rows = lists.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", F.transform("l", lambda x: x["n_name"]).alias("w"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name", "w"))), lambda x: F.struct(x["r_name"], x["w"]))
    rows.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.text(place)
    return readers.read_category_keywords(spark, place).select("place", "category", F.concat(F.lit("["), F.array_join("keywords", ", "), F.lit("]")).alias("keywords"))


@query("SELECT s_name AS surface, s_nationkey::INT AS left_id, s_suppkey::INT AS cost, s_name || ', ' || chr(34) || s_suppkey || chr(34) AS read, 'N' || (s_suppkey % 3) AS pos FROM supplier")
def lexicon_csv_round_trip(spark, sf_dir):
    place = folder(spark)
    n = lambda c: F.col(c).cast("int")
    tag = F.concat(F.lit("N"), (F.col("s_suppkey") % 3).cast("string"))
    empty = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("surface"), n("s_nationkey").alias("left_id"), F.lit(0).alias("right_id"), n("s_suppkey").alias("cost"), tag.alias("pos"), empty.alias("semantic_class"), F.concat("s_name", F.lit(', "'), F.col("s_suppkey").cast("string"), F.lit('"')).alias("read"), *(empty.alias(c) for c in ("type", "start_pos", "end_pos", "expression")))
    sinks.write_lexicon(rows, place)
    return readers.read_lexicon(spark, f"{place}/*").select("surface", "left_id", "cost", "read", "pos")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line_no, p_name AS surface, 'NNG' AS pos, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS class_name FROM part QUALIFY row_number() OVER (ORDER BY p_partkey) <= 100")
def import_until_empty_row(spark, sf_dir):
    place = folder(spark)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", "p_name", F.lit("0,0,0,NNG,*,F"), "p_name", F.lit("*,*,*,*,*")).alias("row"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(","), "p_brand")).otherwise(F.lit("")).alias("more"))
    first = rows.orderBy("p_partkey").limit(100).select("p_partkey", F.concat("row", "more").alias("value"))  # the rows before the empty one
    rest = rows.join(first.select("p_partkey"), "p_partkey", "left_anti").select("p_partkey", F.col("row").alias("value"))
    empty = first.agg(F.max("p_partkey").alias("p_partkey")).select("p_partkey", F.lit("").alias("value"))
    ordered = first.withColumn("part", F.lit(0)).unionAll(empty.withColumn("part", F.lit(1))).unionAll(rest.withColumn("part", F.lit(2))).orderBy("part", "p_partkey")
    ordered.select("value").write.text(place)
    return readers.read_import_rows(spark, place).select("line_no", "surface", "pos", "class_name")


@query("SELECT n_name AS a, n_regionkey::VARCHAR AS b FROM nation WHERE n_nationkey % 4 <> 0")
def config_rows(spark, sf_dir):
    place = folder(spark)
    table(spark, sf_dir, "nation").select(F.concat(F.when(F.col("n_nationkey") % 4 == 0, "# ").otherwise(""), F.concat_ws(",", "n_name", "n_regionkey")).alias("value")).write.text(place)
    return readers.read_config_rows(spark, place, ["a", "b"])


@query(f"WITH {TURNS_SQL} SELECT conv_id::VARCHAR AS chat_id, (turn * 2)::INT AS place, trim(text) AS text FROM turns")
def request_records(spark, sf_dir):
    place = folder(spark)
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l"))
    # blank prompts stand between the turns and are dropped
    most = F.col("l")[F.size("l") - 1]["turn"]
    held = F.map_from_entries("l")
    listed = F.transform(F.sequence(F.lit(0).cast("long"), 2 * most.cast("long")), lambda i: F.when(i % 2 == 0, F.coalesce(F.try_element_at(held, (i / 2).cast("int").cast(dict(turns(spark, sf_dir).dtypes)["turn"])), F.lit(" "))).otherwise(" "))
    rows.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("chatId"), listed.alias("promptContents"))).alias("value")).write.text(place)
    return readers.read_requests(spark, place).select("chat_id", F.col("prompt_idx").alias("place"), "text")


@query("SELECT DISTINCT event_type AS value FROM events")
def sorted_unique_lines(spark, sf_dir):
    place, again = folder(spark), folder(spark)
    sinks.write_sorted_unique(table(spark, sf_dir, "events").where("event_id % 2 = 0"), place, "event_type")
    sinks.write_sorted_unique(table(spark, sf_dir, "events").where("event_id % 2 = 1"), again, "event_type", spark.read.text(place).withColumnRenamed("value", "event_type"))
    return spark.read.text(again)


@query("SELECT l_returnflag AS token, round(count(*) / sum(count(*)) OVER (), 9) AS freq FROM lineitem GROUP BY l_returnflag")
def frequency_json(spark, sf_dir):
    from inkfold.operators import vocab

    place = folder(spark)
    counts = vocab.token_counts(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("token")))
    sinks.json_map(vocab.relative_frequency(counts), "token", "freq").write.text(place)
    return spark.read.text(place).select(F.explode(F.from_json("value", "map<string,double>")).alias("token", "freq")).select("token", F.round("freq", 9).alias("freq"))


@query("SELECT l_orderkey % 8 AS shard, count(*) * 2 AS n FROM lineitem GROUP BY 1")
def appended_shards(spark, sf_dir):
    place = folder(spark)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 8).alias("shard"))
    for _ in range(2):
        sinks.write_shards(rows, place)
    return spark.read.parquet(place).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('there', true), ('gone', false)) v(name, \"exists\")")
def artifact_report(spark, sf_dir):
    return readers.present(spark, {"there": f"{sf_dir}/nation.parquet", "gone": f"{sf_dir}/none.parquet"}).select("name", "exists")


@query("SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem")
def metrics_round_trip(spark, sf_dir):
    place = folder(spark)
    sinks.write_json_value(table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.avg(F.col("l_quantity").cast("double")).alias("mean")), place, F.struct("n", "mean"))
    return rounded(readers.read_metrics(spark, place).select("n", "mean"), "mean")


@query(f"SELECT DISTINCT {NORMAL_SQL} AS text FROM conversations WHERE role = 'user' AND {NORMAL_SQL} <> ''")
def stream_dedup(spark, sf_dir):
    place = folder(spark)
    source = stored(turns(spark, sf_dir).select(F.trim("text").alias("text")).repartition(4))
    stream = streams.dedup_stream(streams.stream_of(spark, source.inputFiles()[0].rsplit("/", 1)[0]))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{place}/out")


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, {FLUENCY_SQL} SELECT conv_id, n_texts, n_tokens, round(s, 6) AS s, round(k, 6) AS k FROM fl")
def stream_scores(spark, sf_dir):
    place = folder(spark)
    source = stored(turns(spark, sf_dir).select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("prompt_idx"), "text").coalesce(1))
    stream = streams.stream_of(spark, source.inputFiles()[0].rsplit("/", 1)[0], 1000)
    streams.score_stream(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{place}/out/batch={n}"), f"{place}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{place}/out").select(F.col("chat_id").alias("conv_id"), "n_texts", "n_tokens", "s", "k"), "s", "k")


@query(f"WITH {TURNS_SQL}, {WORDS_SQL}, {FLUENCY_SQL} SELECT conv_id, round(round(100 * s, 8), 4) AS s, round(round(100 * k, 8), 4) AS k FROM fl")
def reply_numbers(spark, sf_dir):
    parts = scoring.fluency_parts(turns(spark, sf_dir), streams_words(spark, sf_dir), "conv_id")
    shown = scoring.reply(parts.select("conv_id", F.round(100 * F.col("s"), 8).alias("fluency"), F.lit(0.0).alias("persistence"), F.round(100 * F.col("k"), 8).alias("creativity"), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("k"), F.lit(0.0).alias("c")).alias("fluency_skc"), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("r"), F.lit(0.0).alias("f")).alias("persistence_srf")))
    return shown.select("conv_id", F.col("reply.fluency").alias("s"), F.col("reply.creativity").alias("k"))


def streams_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkfold.plans.text_queries import words_of

    return words_of(turns(spark, sf_dir))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:8]::DOUBLE[], lambda x: x)) / 8, 6) AS mean, round(list_max(embedding[1:8]::DOUBLE[]), 6) AS top, round(embedding[1]::DOUBLE, 6) AS cls FROM embeddings")
def pooled_tokens(spark, sf_dir):
    hidden = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.array(x))
    mask = F.transform("embedding", lambda x, i: F.when(i < 8, 1).otherwise(0))
    shown = lambda how: F.round(vectors.pooled(hidden, mask, how)[0], 6).alias({"mean": "mean", "max": "top", "cls": "cls"}[how])
    return table(spark, sf_dir, "embeddings").select("vec_id", shown("mean"), shown("max"), shown("cls"))
