"""Morphological lexicon tables: parsing, editing, cost rules, validation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.functions.strings import final_consonant, prefixes

#: The columns of a lexicon row, in file order.
LEXICON_COLUMNS = ("surface", "left_id", "right_id", "cost", "pos", "semantic_class", "jongsung", "read", "type", "start_pos", "end_pos", "expression")
LEXICON_SCHEMA = T.StructType([T.StructField(c, T.IntegerType() if c in ("left_id", "right_id", "cost") else T.StringType()) for c in LEXICON_COLUMNS])
#: Semantic classes that an expression may name.
EXPRESSION_CLASSES = ("*", "인명", "지명")
#: Code points from, to, and their classes; of several rows for a code point the last one holds.
CHARACTER_TABLE = """
0020 0020 SPACE
000D 000D SPACE
0009 0009 SPACE
000B 000B SPACE
000A 000A SPACE
0021 002F SYMBOL
0030 0039 NUMERIC
003A 0040 SYMBOL
0041 005A ALPHA
005B 0060 SYMBOL
0061 007A ALPHA
007B 007E SYMBOL
00A1 00BF SYMBOL
00C0 00FF ALPHA
0100 017F ALPHA
0180 0236 ALPHA
1E00 1EF9 ALPHA
0400 04F9 CYRILLIC
0500 050F CYRILLIC
0374 03FB GREEK
AC00 D7A3 HANGUL
1100 11FF HANGUL
3130 318F HANGUL
3041 309F HIRAGANA
30A1 30FF KATAKANA
31F0 31FF KATAKANA
30FC 30FC KATAKANA
FF66 FF9D KATAKANA
FF9E FF9F KATAKANA
2E80 2EF3 HANJA
3005 3005 HANJA
3007 3007 HANJA
3400 4DB5 HANJA
4E00 9FA5 HANJA
F900 FA2D HANJA
FA30 FA6A HANJA
2F00 2FD5 KANJI
4E00 4E00 HANJANUMERIC HANJA
4E8C 4E8C HANJANUMERIC HANJA
4E09 4E09 HANJANUMERIC HANJA
56DB 56DB HANJANUMERIC HANJA
4E94 4E94 HANJANUMERIC HANJA
516D 516D HANJANUMERIC HANJA
4E03 4E03 HANJANUMERIC HANJA
516B 516B HANJANUMERIC HANJA
4E5D 4E5D HANJANUMERIC HANJA
5341 5341 HANJANUMERIC HANJA
767E 767E HANJANUMERIC HANJA
5343 5343 HANJANUMERIC HANJA
4E07 4E07 HANJANUMERIC HANJA
5104 5104 HANJANUMERIC HANJA
5146 5146 HANJANUMERIC HANJA
FF10 FF19 NUMERIC
FF21 FF3A ALPHA
FF41 FF5A ALPHA
FF01 FF0F SYMBOL
FF1A FF1F SYMBOL
FF3B FF40 SYMBOL
FF5B FF65 SYMBOL
FFE0 FFEF SYMBOL
2000 206F SYMBOL
2070 209F NUMERIC
20A0 20CF SYMBOL
20D0 20FF SYMBOL
2100 214F SYMBOL
2150 218F NUMERIC
2100 214B SYMBOL
2190 21FF SYMBOL
2200 22FF SYMBOL
2300 23FF SYMBOL
2460 24FF SYMBOL
2501 257F SYMBOL
2580 259F SYMBOL
25A0 25FF SYMBOL
2600 26FE SYMBOL
2700 27BF SYMBOL
27F0 27FF SYMBOL
27C0 27EF SYMBOL
2800 28FF SYMBOL
2900 297F SYMBOL
2B00 2BFF SYMBOL
2A00 2AFF SYMBOL
3300 33FF SYMBOL
3200 32FE SYMBOL
3000 303F SYMBOL
FE30 FE4F SYMBOL
FE50 FE6B SYMBOL
3007 3007 SYMBOL HANJANUMERIC
"""
#: (from, to, classes) of each row.
CHARACTER_CLASSES = tuple((int(a, 16), int(b, 16), tuple(names)) for a, b, *names in (row.split() for row in CHARACTER_TABLE.split("\n") if row))
#: The tag of unknown words by character class.
UNKNOWN_TAGS = {
    "DEFAULT": "SY", "SPACE": "SP", "ALPHA": "SL", "CYRILLIC": "SL", "GREEK": "SL", "HANGUL": "UNKNOWN", "HANJA": "SH",
    "HIRAGANA": "SL", "KANJI": "SL", "HANJANUMERIC": "SH", "KATAKANA": "SL", "NUMERIC": "SN", "SYMBOL": "SY",
}


def missing_to_null(lexicon: DataFrame) -> DataFrame:
    """The mark * becomes null in text columns."""
    return lexicon.select(*(F.nullif(F.col(c), F.lit("*")).alias(c) if t == "string" and c != "surface" else F.col(c) for c, t in lexicon.dtypes))


def null_to_missing(lexicon: DataFrame) -> DataFrame:
    """Nulls become * in text columns."""
    return lexicon.select(*(F.coalesce(F.col(c), F.lit("*")).alias(c) if t == "string" else F.col(c) for c, t in lexicon.dtypes))


def with_final_consonant(lexicon: DataFrame) -> DataFrame:
    """Sets jongsung from the reading, or from the surface without one."""
    return lexicon.withColumn("jongsung", final_consonant(F.coalesce(F.nullif(F.col("read"), F.lit("*")), F.col("surface"))))


def class_rows(lexicon: DataFrame, class_name: str) -> DataFrame:
    """The twelve columns of available rows of a class, in export order."""
    return export_rows(lexicon.where(F.col("class_name") == class_name))


def main_rows(lexicon: DataFrame) -> DataFrame:
    """Rows of no class, which are exported by pos."""
    return lexicon.where(F.nullif(F.col("class_name"), F.lit("")).isNull())


def export_rows(lexicon: DataFrame, pos: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The twelve columns in file order, and any extra ones, by surface, pos and class; available rows only, of one pos if given."""
    rows = lexicon.where(F.coalesce(F.col("is_available"), F.lit(1)) == 1) if "is_available" in lexicon.columns else lexicon
    rows = rows if pos is None else rows.where((F.col("pos") == pos) & (F.coalesce(F.col("semantic_class"), F.lit("*")) == "*"))
    return null_to_missing(with_final_consonant(rows).select(*LEXICON_COLUMNS, *extra)).orderBy("surface", "pos", "semantic_class")


def expression_tokens(expression: Column, all_parts: bool = False) -> Column:
    """array<struct<surface, pos, semantic_class, step, length>> of an expression; tokens of step 1 only, unless all_parts."""
    parts = F.transform(
        F.split(expression, r"\+"),
        lambda e: F.struct(*(F.get(F.split(e, "/"), F.lit(k)).alias(n) for k, n in enumerate(("surface", "pos", "semantic_class", "step", "length")))),
    )
    return parts if all_parts else F.filter(parts, lambda t: t["step"] == "1")


def joined_tokens(tokens: Column) -> Column:
    """surface/pos/class of each token, joined by a plus sign."""
    return F.array_join(F.transform(tokens, lambda t: F.concat_ws("/", t["surface"], t["pos"], t["semantic_class"])), "+")


def edit_compounds(lexicon: DataFrame) -> DataFrame:
    """Compound and preanalysed rows: first and last pos and a compound expression from the index expression."""
    rows = lexicon.where(F.col("type").isin("Compound", "Preanalysis")).withColumn("__t", expression_tokens(F.col("index_expression")))
    return rows.select(
        *(c for c in lexicon.columns if c not in ("start_pos", "end_pos", "compound_expression")),
        F.get("__t", F.lit(0))["pos"].alias("start_pos"),
        F.get("__t", F.size("__t") - 1)["pos"].alias("end_pos"),
        joined_tokens(F.col("__t")).alias("compound_expression"),
    )


def edit_inflections(lexicon: DataFrame) -> DataFrame:
    """Inflected rows: proper nouns in the expression get the class of the lexicon's place, else person, of that surface."""
    rows = lexicon.where(F.col("type") == "Inflect")
    proper = lexicon.where((F.col("pos") == "NNP") & F.col("semantic_class").isin("지명", "인명")).groupBy("surface").agg(F.min(F.when(F.col("semantic_class") == "지명", 0).otherwise(1)).alias("rank"))
    tokens = rows.select(*rows.columns, F.posexplode(expression_tokens(F.col("compound_expression"), True)).alias("__k", "__t"))
    named = tokens.join(proper.select(F.col("surface").alias("__s"), "rank"), (F.col("__t.surface") == F.col("__s")) & (F.col("__t.pos") == "NNP"), "left")
    kind = F.when(F.col("rank") == 0, "지명").when(F.col("rank") == 1, "인명").otherwise(F.col("__t.semantic_class"))
    fixed = named.withColumn("__e", F.concat_ws("/", "__t.surface", "__t.pos", kind))
    own = [c for c in rows.columns if c != "compound_expression"]
    listed = fixed.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("__k", "__e"))).alias("__l"))
    return listed.select(*own, F.array_join(F.transform("__l", lambda x: x["__e"]), "+").alias("compound_expression"))


def index_expression(parts: Column) -> Column:
    """Running prefixes as tokens: the first with step 1, the others with step 0, and their lengths in parts."""
    return F.array_join(F.transform(prefixes(parts), lambda p, i: F.concat(p, F.lit("/NNG/"), F.when(i == 0, "1").otherwise("0"), F.lit("/"), (i + 1).cast("string"))), "+")


def expand_suffix_compounds(lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the compounds as preanalysed rows, new rows): the first part as a word, and every longer proper prefix as a compound."""
    rows = lexicon.where((F.col("type") == "Compound") & (F.col("pos") == "NNG")).withColumn("__p", F.split("compound_expression", r"\+"))
    changed = rows.withColumn("type", F.lit("Preanalysis")).withColumn("start_pos", F.lit("NNG")).withColumn("end_pos", F.lit("NNG")).withColumn("index_expression", index_expression(F.col("__p"))).drop("__p")
    counts = F.sequence(F.lit(1), F.greatest(F.size("__p") - 1, F.lit(1)))
    new = rows.select("__p", F.explode(counts).alias("n")).withColumn("q", F.slice("__p", F.lit(1), F.col("n")))
    more = F.col("n") > 1
    return changed, new.select(
        F.array_join("q", "").alias("surface"),
        F.lit("NNG").alias("pos"),
        F.array_join("q", "").alias("read"),
        F.when(more, "NNG").alias("start_pos"),
        F.when(more, "NNG").alias("end_pos"),
        F.when(more, F.array_join("q", "+")).alias("compound_expression"),
        F.when(more, index_expression(F.col("q"))).alias("index_expression"),
    )


def invalid_expressions(lexicon: DataFrame) -> DataFrame:
    """(surface, expression, token, problem): tokens without five parts, with a step or length that is no number, or with an unknown class."""
    rows = lexicon.where(F.col("type").isin("Compound", "Preanalysis")).select("surface", F.col("index_expression").alias("expression"), F.explode(F.split("index_expression", r"\+")).alias("token"))
    p = F.split("token", "/")
    whole = lambda k: F.get(p, F.lit(k)).try_cast("int").isNotNull()
    problem = (
        F.when(F.size(p) < 5, "parts").when(F.size(p) != 5, "parts").when(~whole(3) | ~whole(4), "number").when(~F.get(p, F.lit(2)).isin(*EXPRESSION_CLASSES), "class")
    )
    return rows.withColumn("problem", problem).where("problem is not null")


def repeated_entries(lexicon: DataFrame) -> DataFrame:
    """(surface, pos, semantic_class, n): entries that break uniqueness."""
    return lexicon.groupBy("surface", "pos", "semantic_class").agg(F.count("*").alias("n")).where("n > 1")


def new_entries(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows whose surface, pos and class no available row of the lexicon has."""
    key = lambda c: F.coalesce(F.col(c), F.lit("*"))
    have = lexicon.where(F.coalesce(F.col("is_available"), F.lit(1)) == 1) if "is_available" in lexicon.columns else lexicon
    have = have.select(*(key(c).alias(f"__{c}") for c in ("surface", "pos", "semantic_class"))).distinct()
    return rows.join(have, (key("surface") == F.col("__surface")) & (key("pos") == F.col("__pos")) & (key("semantic_class") == F.col("__semantic_class")), "left_anti")


def distinct_names(lexicon: DataFrame, column: str = "pos") -> DataFrame:
    """Names of tags or classes, without missing ones."""
    return lexicon.select(F.nullif(F.col(column), F.lit("*")).alias(column)).where(F.col(column).isNotNull()).distinct()


def override_costs(lexicon: DataFrame, overrides: DataFrame) -> DataFrame:
    """New costs by surface, pos and class (surface, pos, semantic_class, new_cost); the last of equal keys counts by `place`, if there is one."""
    keys = ["surface", "pos", "semantic_class"]
    order = F.col("place") if "place" in overrides.columns else F.lit(0)
    last = overrides.groupBy(*keys).agg(F.max_by("new_cost", order).alias("new_cost"))
    return lexicon.join(last, keys, "left").withColumn("cost", F.coalesce("new_cost", "cost")).select(*lexicon.columns)


def ruled_cost(kind: Column) -> Column:
    """Cheaper names and compounds by kind of row (person, place, noun): by start or end of the surface and its length, cut to whole numbers."""
    n, cost = F.length("surface"), F.col("cost")
    cut = lambda f: (cost * F.lit(f)).cast("int")
    starts = lambda s: F.col("surface").startswith(s) & (cost > 0)
    return (
        F.when((kind == "person") & (n >= 3), F.when(starts("이"), cut(0.4)).otherwise(cut(0.75)))
        .when((kind == "place") & (n >= 2) & starts("내"), cut(0.4))
        .when((kind == "noun") & (n >= 4) & F.col("surface").endswith("주의") & (cost > 0), cut(0.6))
        .otherwise(cost)
    )


def first_context_id(features: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the id of the first row (id, place, keys...) of a context table that has the features; null without one."""
    first = ids.groupBy(*keys).agg(F.min_by("id", "place").alias("context_id"))
    return features.join(first, keys, "left")


def override_connections(matrix: DataFrame, overrides: DataFrame) -> DataFrame:
    """Connection costs (right_id, left_id, cost) with new ones (right_id, left_id, new_cost)."""
    last = overrides.groupBy("right_id", "left_id").agg(F.max("new_cost").alias("new_cost"))
    return matrix.join(last, ["right_id", "left_id"], "left").withColumn("cost", F.coalesce("new_cost", "cost")).select("right_id", "left_id", "cost")


def character_classes(character: Column) -> Column:
    """All classes of the first character, its own class first; DEFAULT outside all ranges, null for an empty string."""
    cp = F.ascii(character)
    out = F.when(character.isNull() | (character == ""), F.lit(None).cast("array<string>"))
    for low, high, names in reversed(CHARACTER_CLASSES):
        out = out.when(cp.between(low, high), F.array(*map(F.lit, names)))
    return out.otherwise(F.array(F.lit("DEFAULT")))


def character_class(character: Column) -> Column:
    """The class of the first character."""
    return F.get(character_classes(character), F.lit(0))


def unknown_tag(character: Column) -> Column:
    """The tag that a word of unknown characters gets, by the class of its first one."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in UNKNOWN_TAGS.items() for x in pair)), character_class(character))


def pos_ids(features: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """(key, pos_id): of each row of features (key, features array) by the first row (place, pattern array, pos_id) of a table that it matches, * being anything; null without one.

    A table row is a regular expression over joined features, and the table
    is a fixed, short list, so it becomes one ordered conditional.
    """
    joined, out = F.array_join("features", ","), None
    for r in table.orderBy("place").collect():
        hit = joined.rlike("^" + ",".join("[^,]*" if p == "*" else re.escape(p) for p in r["pattern"]) + "$")
        out = F.when(hit, r["pos_id"]) if out is None else out.when(hit, r["pos_id"])
    return features.select(key, (F.lit(None).cast("int") if out is None else out).alias("pos_id"))


def matched_context_id(wanted: DataFrame, ids: DataFrame, key: str = "key", pattern: str = "pattern") -> DataFrame:
    """Adds context_id: of the first line (place, id, features) whose features the row's pattern matches from their start, as a search of the file for its first hit does; null without one.

    wanted is the short list of lines of a settings file (see
    `context_pattern`); its patterns go to the table, so each line of the
    table is read once. Over 10,000 patterns are refused.
    """
    few = wanted.select(F.col(key).alias("__key"), F.col(pattern).alias("__pattern"))
    if (n := few.count()) > 10_000:
        raise ValueError(f"{n} patterns; a settings list of at most 10000 is expected")
    hit = ids.join(F.broadcast(few), F.expr("regexp_like(features, concat('^', __pattern))"))  # a counted side
    first = hit.groupBy("__key").agg(F.min_by("id", "place").alias("context_id"))
    return wanted.join(first, F.col(key) == F.col("__key"), "left").drop("__key")


def context_pattern(side: str, tag: Column, semantic_class: Column, jongsung: Column, reading: Column) -> Column:
    """The pattern that a left or right context is looked up with; a right one without a reading ends with the final consonant."""
    last = F.lit(r"\*") if side == "left" else jongsung
    whole = F.concat_ws(",", tag, semantic_class, last, reading)
    return whole if side == "left" else F.when(F.coalesce(reading, F.lit("")) == "", F.concat_ws(",", tag, semantic_class, last)).otherwise(whole)


def pattern_to_regex(pattern: Column) -> Column:
    """A rule's feature patterns (array; * is anything, (A|B) a choice) as one regular expression over joined features."""
    return F.concat(F.lit("^"), F.array_join(F.transform(pattern, lambda p: F.when(p == "*", "[^,]*").otherwise(p)), ","), F.lit("$"))


def rewrite(features: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, rewritten): each row of features (key, features array) by the first rule (rule_no, pattern, template) that it matches; $n is feature n.

    Rules are a fixed, short list and are applied as one ordered conditional.
    """
    joined = F.array_join("features", ",")
    out = None
    for r in rules.orderBy("rule_no").collect():
        regex = "^" + ",".join("[^,]*" if p == "*" else p for p in r["pattern"]) + "$"
        made = F.concat_ws(",", *(F.get("features", F.lit(int(t[1:]) - 1)) if t.startswith("$") else F.lit(t) for t in r["template"]))
        out = F.when(joined.rlike(regex), made) if out is None else out.when(joined.rlike(regex), made)
    return features.select(key, (F.lit(None).cast("string") if out is None else out).alias("rewritten"))


def borrow_symbol_ids(lexicon: DataFrame) -> DataFrame:
    """The closing bracket gets the tag SF and the ids of the full stop."""
    stop = lexicon.where(F.col("surface") == ".").agg(F.first("left_id").alias("__l"), F.first("right_id").alias("__r"))
    hit = (F.col("surface") == "]") & F.col("__l").isNotNull()
    return lexicon.join(F.broadcast(stop)).select(*(F.when(hit, F.col("__l")).otherwise(F.col(c)).alias(c) if c == "left_id" else F.when(hit, F.col("__r")).otherwise(F.col(c)).alias(c) if c == "right_id" else F.when(hit, F.lit("SF")).otherwise(F.col(c)).alias(c) if c == "pos" else F.col(c) for c in lexicon.columns))  # one row


def apply_edits(lexicon: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """The lexicon with edited rows in place of those of the same key; without writing anything (a preview until it is written)."""
    place = Window.partitionBy(*key).orderBy("__src")
    both = lexicon.withColumn("__src", F.lit(1)).unionByName(edits.withColumn("__src", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__src", "__n")


#: Editors by name.
EDITORS = {"compound": edit_compounds, "inflect": edit_inflections, "suffix": lambda lexicon: expand_suffix_compounds(lexicon)[0]}
