"""Queries on small lexicon tables given in place."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions.strings import final_consonant
from inkfold.operators import lexicon as lx
from inkfold.plans.registry import query, table, texts_of

WORDS = ("하늘", "바다", "글", "나무", "abc", "사과1", "꽃", "")


@query("SELECT * FROM (VALUES ('하늘', 'T'), ('바다', 'F'), ('글', 'T'), ('나무', 'F'), ('abc', '*'), ('사과1', '*'), ('꽃', 'T'), ('', '*')) v(word, jongsung)")
def lexicon_jongsung(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in WORDS], "word string").select("word", final_consonant(F.col("word")).alias("jongsung"))


ROWS = [("가", 1, 2, 500, "NNG", "*"), ("이승기", 1, 2, 900, "NNP", "인명"), ("내방", 1, 2, 800, "NNP", "지명"), ("민주주의", 1, 2, 700, "NNG", "*"), ("가", 1, 2, 400, "NNP", "지명"), ("김철수", 1, 2, 901, "NNP", "인명"), ("내방동", 1, 2, -5, "NNP", "지명")]
ROWS_SQL = "l AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, {c}, {d}, '{e}', '{f}')" for a, b, c, d, e, f in ROWS) + ") v(surface, left_id, right_id, cost, pos, semantic_class))"


def rows(spark):
    return spark.createDataFrame(ROWS, "surface string, left_id int, right_id int, cost int, pos string, semantic_class string")


@query(f"WITH {ROWS_SQL}, o AS (SELECT * FROM (VALUES ('가', 'NNG', '*', 77), ('내방', 'NNP', '지명', 5)) v(surface, pos, semantic_class, new_cost)) SELECT surface, pos, semantic_class, coalesce(new_cost, cost) AS cost FROM l LEFT JOIN o USING (surface, pos, semantic_class)")
def lexicon_cost_override(spark, sf_dir):
    new = spark.createDataFrame([("가", "NNG", "*", 77), ("내방", "NNP", "지명", 5)], "surface string, pos string, semantic_class string, new_cost int")
    return lx.override_costs(rows(spark), new).select("surface", "pos", "semantic_class", "cost")


@query(
    f"""WITH {ROWS_SQL}, k AS (SELECT *, CASE semantic_class WHEN '인명' THEN 'person' WHEN '지명' THEN 'place' ELSE 'noun' END AS kind FROM l)
SELECT surface, pos, semantic_class, (CASE WHEN kind = 'person' AND length(surface) >= 3 THEN CASE WHEN surface LIKE '이%' AND cost > 0 THEN trunc(cost * 0.4) ELSE trunc(cost * 0.75) END
WHEN kind = 'place' AND length(surface) >= 2 AND surface LIKE '내%' AND cost > 0 THEN trunc(cost * 0.4) WHEN kind = 'noun' AND length(surface) >= 4 AND surface LIKE '%주의' AND cost > 0 THEN trunc(cost * 0.6) ELSE cost END)::INT AS cost FROM k"""
)
def lexicon_cost_rules(spark, sf_dir):
    kind = F.when(F.col("semantic_class") == "인명", "person").when(F.col("semantic_class") == "지명", "place").otherwise("noun")
    return rows(spark).select("surface", "pos", "semantic_class", lx.ruled_cost(kind).alias("cost"))


#: The classes' ranges without overlap, as code points: what the table of rows comes to, written apart from it.
CLASS_RANGES = {
    "SPACE": "(9, 11), (13, 13), (32, 32)",
    "SYMBOL": "(33, 47), (58, 64), (91, 96), (123, 126), (161, 191), (8192, 8303), (8352, 8527), (8592, 9215), (9312, 9471), (9473, 9982), (9984, 10623), (10752, 11263), (12288, 12351), (12800, 13054), (13056, 13311), (65072, 65131), (65281, 65295), (65306, 65311), (65339, 65344), (65371, 65381), (65504, 65519)",
    "NUMERIC": "(48, 57), (8304, 8351), (8528, 8591), (65296, 65305)",
    "ALPHA": "(65, 90), (97, 122), (192, 566), (7680, 7929), (65313, 65338), (65345, 65370)",
    "GREEK": "(884, 1019)",
    "CYRILLIC": "(1024, 1273), (1280, 1295)",
    "HANGUL": "(4352, 4607), (12592, 12687), (44032, 55203)",
    "HANJA": "(11904, 12019), (13312, 19893), (19969, 19970), (19972, 19974), (19976, 19976), (19978, 20060), (20062, 20107), (20109, 20115), (20117, 20739), (20741, 20805), (20807, 20842), (20844, 20844), (20846, 21312), (21314, 21314), (21316, 22234), (22236, 30333), (30335, 40869), (63744, 64045), (64048, 64106)",
    "KANJI": "(12032, 12245)",
    "HIRAGANA": "(12353, 12447)",
    "KATAKANA": "(12449, 12543), (12784, 12799), (65382, 65439)",
    "HANJANUMERIC": "(19968, 19968), (19971, 19971), (19975, 19975), (19977, 19977), (20061, 20061), (20108, 20108), (20116, 20116), (20740, 20740), (20806, 20806), (20843, 20843), (20845, 20845), (21313, 21313), (21315, 21315), (22235, 22235), (30334, 30334)",
}
RANGES_SQL = "r AS (" + " UNION ALL ".join(f"SELECT lo, hi, '{name}' AS class FROM (VALUES {ranges}) v(lo, hi)" for name, ranges in CLASS_RANGES.items()) + ")"


@query(f"WITH {RANGES_SQL}, ch AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) SELECT ch, coalesce(class, 'DEFAULT') AS class FROM ch LEFT JOIN r ON unicode(ch) BETWEEN lo AND hi WHERE ch <> ''")
def char_class_range(spark, sf_dir):
    chars = texts_of(spark, sf_dir, "documents", "text").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").distinct()
    return chars.select("ch", lx.character_class(F.col("ch")).alias("class"))


@query(f"WITH {RANGES_SQL}, cp AS (SELECT i AS cp FROM range(9, 65536) t(i) WHERE i NOT BETWEEN 55296 AND 57343) SELECT cp, coalesce(class, 'DEFAULT') AS class FROM cp LEFT JOIN r ON cp BETWEEN lo AND hi")
def char_class_table(spark, sf_dir):
    points = spark.range(9, 65536).where("id not between 55296 and 57343").select(F.col("id").alias("cp"))
    text = F.decode(F.unhex(F.lpad(F.hex("cp"), 4, "0")), "UTF-16BE")
    return points.select("cp", lx.character_class(text).alias("class"))


@query("SELECT * FROM (VALUES ('１', 'SN'), ('Ａ', 'SL'), ('€', 'SY'), ('一', 'SH'), ('가', 'UNKNOWN'), ('あ', 'SL'), ('〇', 'SY'), ('я', 'SL'), (' ', 'SP'), ('𝄞', 'SY')) v(ch, tag)")
def unknown_word_tags(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in "１Ａ€一가あ〇я 𝄞"], "ch string").select("ch", lx.unknown_tag(F.col("ch")).alias("tag"))


POS_ROWS = [(1, ["*", "*", "*", "*", "Compound", "*", "*", "*"], 1), (2, ["*", "*", "*", "*", "Inflect", "EC", "*", "*"], 200), (3, ["*", "*", "*", "*", "Inflect", "*", "*", "*"], 2), (4, ["NNG", *["*"] * 7], 150), (5, ["SF", *["*"] * 7], 160)]


@query("SELECT * FROM (VALUES (1, 1), (2, 200), (3, 2), (4, 150), (5, 160), (6, NULL)) v(id, pos_id)")
def pos_id_first_match(spark, sf_dir):
    table_ = spark.createDataFrame(POS_ROWS, "place int, pattern array<string>, pos_id int")
    feats = [["NNG", "*", "T", "가", "Compound", "*", "*", "x"], ["VV", "*", "F", "가", "Inflect", "EC", "EC", "x"], ["VV", "*", "F", "가", "Inflect", "VV", "ETM", "x"], ["NNG", "지명", "T", "가", "*", "*", "*", "*"], ["SF", "*", "*", ".", "*", "*", "*", "*"], ["XX", "*", "*", "q", "*", "*", "*", "*"]]
    return lx.pos_ids(spark.createDataFrame(list(enumerate(feats, 1)), "id int, features array<string>"), table_)


CONTEXTS = [(1, 5, "NNG,*,T,하늘,*"), (2, 6, "NNG,*,T,바다,*"), (3, 7, "NNG,*,F,나무,*"), (4, 8, "NNP,인명,T,철,*")]


@query("SELECT * FROM (VALUES (1, 'NNG,.*,T', 5), (2, 'NNG,.*,F', 7), (3, 'NN[GP],인명,T,철', 8), (4, 'VV', NULL)) v(key, pattern, context_id)")
def context_regex_first_match(spark, sf_dir):
    ids = spark.createDataFrame(CONTEXTS, "place int, id int, features string")
    wanted = spark.createDataFrame([(1, "NNG,.*,T"), (2, "NNG,.*,F"), (3, "NN[GP],인명,T,철"), (4, "VV")], "key int, pattern string")
    return lx.matched_context_id(wanted, ids).select("key", "pattern", "context_id")


EXPRESSIONS = [("수륙양용기", "Compound", "수륙/NNG/*/1/1+수륙양용/NNG/*/0/2+기/XSN/*/1/1"), ("가나", "Preanalysis", "가/NNG/지명/1/1+나/NNP/인명/1/x"), ("다라", "Compound", "다/NNG/*/1+라/NNG/bad/1/1"), ("마", "Inflect", "마/VV/*/1/1")]


def compounds(spark):
    return spark.createDataFrame(EXPRESSIONS, "surface string, type string, index_expression string")


@query("SELECT * FROM (VALUES ('수륙양용기', 'NNG', 'XSN', '수륙/NNG/*+기/XSN/*'), ('가나', 'NNG', 'NNP', '가/NNG/지명+나/NNP/인명'), ('다라', 'NNG', 'NNG', '다/NNG/*+라/NNG/bad')) v(surface, start_pos, end_pos, compound_expression)")
def expression_parse(spark, sf_dir):
    return lx.edit_compounds(compounds(spark)).select("surface", "start_pos", "end_pos", "compound_expression")


@query("SELECT * FROM (VALUES ('가나', '나/NNP/인명/1/x', 'number'), ('다라', '다/NNG/*/1', 'parts'), ('다라', '라/NNG/bad/1/1', 'class')) v(surface, token, problem)")
def expression_violations(spark, sf_dir):
    return lx.invalid_expressions(compounds(spark)).select("surface", "token", "problem")


@query("SELECT * FROM (VALUES ('수륙', NULL, NULL), ('수륙양용', '수륙+양용', '수륙/NNG/1/1+수륙양용/NNG/0/2')) v(surface, compound_expression, index_expression)")
def suffix_compounds(spark, sf_dir):
    row = spark.createDataFrame([("수륙양용기", "Compound", "NNG", "수륙+양용+기")], "surface string, type string, pos string, compound_expression string")
    return lx.expand_suffix_compounds(row)[1].select("surface", "compound_expression", "index_expression")


@query("SELECT * FROM (VALUES ('갈', '갈/VV/*+서울/NNP/지명+민수/NNP/인명')) v(surface, compound_expression)")
def inflection_classes(spark, sf_dir):
    cols = "surface string, type string, pos string, semantic_class string, compound_expression string"
    data = [("갈", "Inflect", "VV", "*", "갈/VV/*/1/1+서울/NNP/*/1/1+민수/NNP/*/1/1"), ("서울", "*", "NNP", "인명", None), ("서울", "*", "NNP", "지명", None), ("민수", "*", "NNP", "인명", None)]
    return lx.edit_inflections(spark.createDataFrame(data, cols)).select("surface", "compound_expression")


RULES = [
    (1, ["SF", *["*"] * 7], ["$1", "$2", "$3", "$4", "$5", "$6", "$7", "BOS/EOS"]),
    (2, ["*", "*", "*", "*", "(Inflect|Preanalysis)", "*", "*", "*"], ["$6", "$2", *["*"] * 6]),
    (3, ["*"] * 8, ["$1", "$2", *["*"] * 6]),
]


@query("SELECT * FROM (VALUES (1, 'SF,*,T,.,*,*,*,BOS/EOS'), (2, 'VV,*,*,*,*,*,*,*'), (3, 'NNG,지명,*,*,*,*,*,*')) v(id, rewritten)")
def rewrite_rules(spark, sf_dir):
    feats = [(1, ["SF", "*", "T", ".", "*", "*", "*", "*"]), (2, ["EC", "*", "F", "가", "Inflect", "VV", "EC", "x"]), (3, ["NNG", "지명", "T", "하늘", "*", "*", "*", "*"])]
    rules = spark.createDataFrame(RULES, "rule_no int, pattern array<string>, template array<string>")
    return lx.rewrite(spark.createDataFrame(feats, "id int, features array<string>"), rules)


# ---------------------------------------------- lexicons made of the part table

PARTS_SQL = """lex AS (SELECT p_name AS surface, 0 AS left_id, 0 AS right_id, p_size AS cost, 'N' || (p_partkey % 3) AS pos, CASE WHEN p_partkey % 4 = 0 THEN '지명' END AS semantic_class,
  NULL::VARCHAR AS read, CASE WHEN p_partkey % 5 = 0 THEN 'Compound' END AS type, (p_partkey % 7 <> 0)::INT AS is_available, CASE WHEN p_partkey % 6 = 0 THEN p_brand END AS class_name FROM part)"""


def parts(spark, sf_dir):
    k, empty = F.col("p_partkey"), F.lit(None).cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("surface"), F.lit(0).alias("left_id"), F.lit(0).alias("right_id"), F.col("p_size").alias("cost"), F.concat(F.lit("N"), (k % 3).cast("string")).alias("pos"),
        F.when(k % 4 == 0, "지명").alias("semantic_class"), empty.alias("jongsung"), empty.alias("read"), F.when(k % 5 == 0, "Compound").alias("type"), empty.alias("start_pos"), empty.alias("end_pos"),
        empty.alias("expression"), (k % 7 != 0).cast("int").alias("is_available"), F.when(k % 6 == 0, F.col("p_brand")).alias("class_name"),
    )


@query(f"WITH {PARTS_SQL} SELECT surface, cost, pos, coalesce(semantic_class, '*') AS semantic_class, coalesce(type, '*') AS type, '*' AS expression FROM lex WHERE is_available = 1")
def lexicon_export(spark, sf_dir):
    return lx.export_rows(parts(spark, sf_dir)).select("surface", "cost", "pos", "semantic_class", "type", "expression")


@query(f"WITH {PARTS_SQL} SELECT surface, cost FROM lex WHERE is_available = 1 AND pos = 'N1' AND class_name IS NULL")
def lexicon_export_by_pos(spark, sf_dir):
    rows = lx.main_rows(parts(spark, sf_dir))
    return lx.export_rows(rows.where("pos = 'N1'")).select("surface", "cost")


@query(f"WITH {PARTS_SQL} SELECT class_name, surface FROM lex WHERE is_available = 1 AND class_name IS NOT NULL")
def lexicon_export_by_class(spark, sf_dir):
    from inkfold.plans.file_queries import folder
    from inkfold.sources import sinks

    place = folder(spark)
    sinks.write_class_files(parts(spark, sf_dir), place)
    return spark.read.option("quote", '"').option("escape", '"').schema("surface string").csv(place).select("class_name", "surface")


@query(f"WITH {PARTS_SQL} SELECT surface, pos FROM lex WHERE (surface, pos, coalesce(semantic_class, '*')) NOT IN (SELECT (surface, pos, coalesce(semantic_class, '*')) FROM lex WHERE is_available = 1 AND cost < 25)")
def lexicon_new_entries(spark, sf_dir):
    rows = parts(spark, sf_dir)
    return lx.new_entries(rows, rows.where("cost < 25")).select("surface", "pos")


@query(f"WITH {PARTS_SQL} SELECT surface, pos, coalesce(semantic_class, '*') AS semantic_class, count(*) AS n FROM lex GROUP BY ALL HAVING count(*) > 1")
def lexicon_repeated_entries(spark, sf_dir):
    return lx.repeated_entries(lx.null_to_missing(parts(spark, sf_dir)))


@query(f"WITH {PARTS_SQL} SELECT DISTINCT pos AS name FROM lex UNION ALL SELECT DISTINCT semantic_class FROM lex WHERE semantic_class IS NOT NULL")
def lexicon_names(spark, sf_dir):
    rows = lx.null_to_missing(parts(spark, sf_dir))
    return lx.distinct_names(rows).toDF("name").unionAll(lx.distinct_names(rows, "semantic_class"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1000 ELSE p_size END AS cost FROM part")
def lexicon_applied_edits(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("cost"))
    return lx.apply_edits(rows, rows.where("id % 10 = 0").withColumn("cost", F.col("cost") + 1000), ["id"])


@query("SELECT * FROM (VALUES ('.', 5, 6, 'SF'), (']', 5, 6, 'SF'), ('(', 1, 2, 'SSO')) v(surface, left_id, right_id, pos)")
def lexicon_symbol_ids(spark, sf_dir):
    return lx.borrow_symbol_ids(spark.createDataFrame([(".", 5, 6, "SF"), ("]", 1, 2, "SSC"), ("(", 1, 2, "SSO")], "surface string, left_id int, right_id int, pos string"))


@query("SELECT o_custkey % 50 AS right_id, o_orderkey AS left_id, CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE 7 END AS cost FROM orders")
def lexicon_connection_costs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("right_id"), F.col("o_orderkey").alias("left_id"), F.lit(7).alias("cost"))
    new = rows.where("left_id % 9 = 0").select("right_id", "left_id", F.lit(-1).alias("new_cost"))
    return lx.override_connections(rows, new)
