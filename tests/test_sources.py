"""Sources, sinks and streams through files."""

import json

import numpy as np
import pytest

from inkfold.plans import providers
from inkfold.sources import readers, sinks
from inkfold.streaming import streams


def test_lines_and_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \n#x\n", encoding="utf-8")
    path = str(tmp_path / "a.txt")
    assert [r["text"] for r in readers.read_lines(spark, path).collect()] == ["one", "two", "#x"]
    assert {r["line_no"]: r["text"] for r in readers.read_numbered_lines(spark, path).collect()} == {0: "one", 2: "two", 3: "#x"}
    assert {r["word"] for r in readers.read_stopwords(spark, path).collect()} == {"one", "two"}


def test_captions(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text(json.dumps({"annotations": [{"caption_ko": "하늘\n구름"}, {"caption": " sky "}]}), encoding="utf-8")
    (tmp_path / "d/b.json").write_text("﻿" + json.dumps([{"caption": "sea"}]), encoding="utf-8")
    (tmp_path / "d/c.json").write_text("{broken", encoding="utf-8")
    assert {r["caption"] for r in readers.read_captions(spark, str(tmp_path / "d/a.json")).collect()} == {"하늘 구름", "sky"}
    rows, bad = readers.read_caption_folder(spark, str(tmp_path / "d"))
    assert {r["caption"] for r in rows.collect()} == {"하늘 구름", "sky", "sea"} and bad.first()["bad_files"] == 1


def test_npy(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.save(tmp_path / "v.npy", np.array([3, 1, 2], np.int32))
    assert [r["emb"] for r in readers.read_npy(spark, str(tmp_path / "m.npy")).orderBy("row_id").collect()] == [[0, 1], [2, 3], [4, 5]]
    assert [r["label"] for r in readers.read_npy_vector(spark, str(tmp_path / "v.npy")).orderBy("row_id").collect()] == [3, 1, 2]


def test_lexicon_round_trip(spark, tmp_path):
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex/Symbol.csv").write_text('"가,",1,2,30,SY,*,F,가,*,*,*,*\n나,1,2,-4,NNG,*,F,나,*,*,*,*\n', encoding="utf-8")
    rows = readers.read_lexicon(spark, str(tmp_path / "lex"))
    assert {(r["surface"], r["cost"], r["file_name"]) for r in rows.collect()} == {("가,", 30, "Symbol.csv"), ("나", -4, "Symbol.csv")}
    sinks.write_lexicon(rows, str(tmp_path / "out"))
    assert {r["surface"] for r in spark.read.csv(str(tmp_path / "out"), quote='"', escape='"').toDF(*[f"c{i}" for i in range(12)], "file").selectExpr("c0 as surface").collect()} == {"가,", "나"}


def test_text_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b\nc",), ("a",), ("a",)], "text string")
    sinks.write_lines(rows, str(tmp_path / "x"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "x")).collect()) == ["a", "a", "b c"]
    sinks.write_sorted_unique(rows.where("text = 'a'"), str(tmp_path / "y"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "y")).collect()] == ["a"]
    assert sinks.json_map(spark.createDataFrame([("k", 1)], "a string, b int"), "a", "b").first()["value"] == '{"k":1}'


def test_streamed_dedup_and_scores(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a b"), (1, 1, "a b"), (2, 0, "c")], "chat_id int, prompt_idx int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    q = streams.dedup_stream(streams.stream_of(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("deduped").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from deduped").count() == 2
    seen = []
    q = streams.score_stream(streams.stream_of(spark, str(tmp_path / "in"), 100), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {r["chat_id"] for r in seen} == {1, 2}


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "line_no int, text string")
    got = providers.embed_texts(rows, lambda: providers.HashEmbedder(8)).collect()
    assert len(got) == 2 and all(len(r["embedding"]) == 8 for r in got)


@pytest.mark.parametrize("text", ['{"chatId": "c", "promptContents": [" hi ", ""]}'])
def test_requests(spark, tmp_path, text):
    (tmp_path / "r.json").write_text(text)
    assert [(r["chat_id"], r["prompt_idx"], r["text"]) for r in readers.read_requests(spark, str(tmp_path / "r.json")).collect()] == [("c", 0, "hi")]
