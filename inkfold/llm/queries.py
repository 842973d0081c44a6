"""Queries of the training-data operators: name -> function of (spark, sf_dir)."""

from inkfold.llm.bpe import op3_bpe
from inkfold.llm.decontamination import op6_decontamination
from inkfold.llm.html_text import op2_html
from inkfold.llm.language_model import op9_lm_scoring
from inkfold.llm.quality_classifier import op7_quality_classifier
from inkfold.llm.quality_rules import op5_quality_rules
from inkfold.llm.secrets import op1_secrets
from inkfold.llm.sharding import op8_sharding
from inkfold.llm.simhash import op4_simhash
from inkfold.llm.token_counts import op10_token_counts

def secrets_base(spark, sf_dir: str):
    """The counts of the fixed patterns, from op1_secrets."""
    return op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_base(spark, sf_dir: str):
    """The columns that do not depend on rules, from op5_quality_rules."""
    return op5_quality_rules(spark, sf_dir).drop("kept")


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_html": op2_html,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_sharding": op8_sharding,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_counts": op10_token_counts,
    "secrets_base": secrets_base,
    "quality_base": quality_base,
}

#: DuckDB SQL with the same result, where SQL can express it.
ORACLE_SQL: dict[str, str] = {
    "secrets_base": r"""SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
  len(regexp_extract_all(coalesce(text, ''), '[0-9a-f]{24,}')) AS n_hex FROM documents""",
    "quality_base": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
v AS (SELECT r, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS v, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
t AS (SELECT r, i FROM v QUALIFY count(*) OVER (PARTITION BY r, v) > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM t, range(5) k(k) GROUP BY r),
s AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM d JOIN l USING (r) LEFT JOIN p USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s""",
}
