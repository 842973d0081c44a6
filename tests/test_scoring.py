"""Scores against the formulas in plain Python."""

import math
from collections import Counter

from inkfold.operators import scoring


def chats(spark):
    texts = [(1, "a b a"), (1, "b c"), (2, "x"), (3, "y y y"), (4, "q")]
    words = [(c, w) for c, t in texts for w in t.split() if c != 4]
    return spark.createDataFrame(texts, "chat_id int, text string"), spark.createDataFrame(words, "chat_id int, word string"), texts


def test_fluency_follows_the_formula(spark):
    texts, words, raw = chats(spark)
    got = {r["chat_id"]: r for r in scoring.fluency_parts(texts, words).collect()}
    for chat in (1, 2, 3, 4):
        mine = [t for c, t in raw if c == chat]
        toks = [w for t in mine for w in t.split() if chat != 4]
        n = Counter(toks)
        k = 0.0
        if len(n) > 1:
            h = -sum(v / len(toks) * math.log(v / len(toks) + 1e-12) for v in n.values())
            k = min(max(h / math.log(min(len(n), 500) + 1e-12) * (1 - math.exp(-len(toks) / 20)), 0), 1)
        assert abs(got[chat]["k"] - max(k, 0.2)) < 1e-9
        assert abs(got[chat]["s"] - (1 - math.exp(-len(mine) / 8))) < 1e-12


def test_one_distinct_word_has_no_focus(spark):
    _, words, _ = chats(spark)
    got = {r["chat_id"]: r["r"] for r in scoring.lexical_focus(words).collect()}
    assert abs(got[2]) < 1e-9 and abs(got[3]) < 1e-9 and got[1] > 0


def test_coverage_counts_empty_clusters(spark):
    texts, _, _ = chats(spark)
    assigned = spark.createDataFrame([(1, 0), (1, 2), (2, 1)], "chat_id int, cluster_id int")
    got = {r["chat_id"]: r["c"] for r in scoring.cluster_coverage(texts, assigned, 5).collect()}
    p = [1.5 / 4.5, 0.5 / 4.5, 1.5 / 4.5, 0.5 / 4.5, 0.5 / 4.5]
    h = -sum(x * math.log(x + 1e-12) for x in p)
    assert abs(got[1] - h / math.log(5 + 1e-12) * (1 - math.exp(-2 / 5))) < 1e-9
    assert got[4] == 0


def test_scores_stay_in_range_whatever_the_order(spark):
    texts, words, _ = chats(spark)
    morphs = words.selectExpr("chat_id", "word", "'VA' as tag")
    assigned = spark.createDataFrame([(1, 0), (1, 2), (2, 1)], "chat_id int, cluster_id int")
    a = {r["chat_id"]: r for r in scoring.creativity(texts, words, morphs, assigned, 5).collect()}
    b = {r["chat_id"]: r for r in scoring.creativity(texts.orderBy("text", ascending=False), words.orderBy("word"), morphs, assigned, 5).collect()}
    assert a.keys() == b.keys() == {1, 2, 3, 4}
    for k in a:
        assert 0 <= a[k]["creativity"] <= 100 and abs(a[k]["creativity"] - b[k]["creativity"]) < 1e-9
    assert set(scoring.reply(scoring.creativity(texts, words, morphs, assigned, 5)).first()["reply"].asDict()) == {"fluency", "persistence", "creativity", "fluencySkc", "persistenceSrf"}
