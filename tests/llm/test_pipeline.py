"""The pipeline's stages keep columns, take effect, and agree with the operators alone."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkfold.llm import bpe, simhash
from inkfold.llm.common import stored
from inkfold.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    more = spark.createDataFrame([(9001, bench, "en", "s", 1), (9002, "secret = abcdefgh1 " + "plain words of a clean text here " * 1, "en", "s", 1), (9003, None, None, None, None)], docs.schema)
    rows = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, rows, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        texts = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "benchmark_decontamination":
            assert 9001 not in texts and 9002 in texts and 9003 in texts
        if name == "secret_scan":
            assert texts[9002].startswith("[secret] plain") and len(texts) == rows.count()
        if name == "simhash_near_dedup":
            assert len(set(texts.values())) == len(texts) == out.count()


def test_run_encodes_what_is_left(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(out) < 200
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in out)
    assert bpe.default_path()


def test_there_is_a_query_for_every_operator():
    assert [n.split("_")[0] for n in QUERIES][:10] == [f"op{k}" for k in range(1, 11)]


COLUMNS = {
    "op1_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_keep_their_contract(spark, name):
    made = QUERIES[name](spark, DATA)
    assert ", ".join(f"{c} {t}" for c, t in made.dtypes).startswith(COLUMNS[name])
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert Counter(r["doc_id"] for r in made.collect()) == Counter(r["doc_id"] for r in docs.collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


def test_stages_take_any_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (2, "", "en", None, 0), (3, "clean words " * 200_000, "en", "s", 1), (3, "clean words " * 200_000, "en", "s", 1)]
    odd = spark.createDataFrame(rows, docs.schema)
    wide = odd.withColumns({c: F.lit("x") for c in ("score", "predicted", "fp", "ids", "decoded", "spans")})
    for name, stage in corpus_pipeline.STAGES:
        for given in (odd, odd.limit(0), wide):
            out = stage(spark, given, DATA)
            if name != "bpe_encoding":
                assert out.columns == given.columns, name
            n = out.count()
            assert n <= len(rows) and (n > 0 or given.limit(1).count() == 0 or name == "quality_classifier"), name


def test_near_copies_are_found_among_all_documents(spark):
    """Recall at a Jaccard similarity of 0.8 of every second document against all, by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sized = docs.withColumn("size", F.lit(1).cast("long"))
    each = stored(simhash.set_prints(sized, "doc_id", "text", 5, 0.8, 4, ("size",)))
    root = {r["doc_id"]: bytes(r["root"]) for r in each.join(simhash.similar_groups(docs, each, "doc_id", "text", 5, 0.8, 4, 4096, 8_000_000), "fp").collect()}
    sets = {r["doc_id"]: set(simhash.shingle_set((r["text"] or "").encode(), 5).tolist()) for r in docs.collect()}
    pairs = [(a, b) for a in sets if a % 2 == 0 for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 50 and sum(root[a] == root[b] for a, b in pairs) >= 0.95 * len(pairs)
