"""Text, vocabulary and deduplication operators on small inline tables."""

from pyspark.sql import functions as F

from inkfold.functions import strings as st
from inkfold.operators import dedup, vocab


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def test_cleaning(spark):
    assert one(spark, " 하늘이, 파랗다!  abc ", st.hangul_only) == "하늘이 파랗다"
    assert one(spark, "하", st.normalized) == "하"
    assert one(spark, None, st.normalized) == ""
    assert one(spark, "a-b 여성 C1", st.plain_tokens) == ["a", "b", "C1"]
    assert one(spark, None, st.plain_tokens) == []


def test_windows(spark):
    def windows(n, max_len, stride):
        return one(spark, " ".join(map(str, range(n))), lambda t: st.token_windows(st.plain_tokens(t), max_len, stride))

    assert windows(0, 10, 2) == []
    assert windows(8, 10, 2) == [[str(i) for i in range(8)]]
    assert [w[0] for w in windows(20, 10, 2)] == ["0", "6", "12", "18"]
    assert [w[0] for w in windows(5, 4, 9)] == ["0", "2", "4"]


def test_near_copies_are_dropped_in_order(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty and more words"
    rows = [(0, base), (1, base + " again"), (2, base), (3, "a b"), (4, "a b c"), (5, None), (6, " ")]
    kept = dedup.near_dedup(spark.createDataFrame(rows, "line_no int, text string"), 0.9, 4)
    assert sorted(r["line_no"] for r in kept.collect()) == [0, 3, 4]
    again = dedup.near_dedup(kept, 0.9, 4)
    assert sorted(r["line_no"] for r in again.collect()) == [0, 3, 4]


def test_filtered_bigrams_join_words_that_were_apart(spark):
    rows = [(i, ["a", "rare" + str(i), "b"]) for i in range(3)]
    got = vocab.filtered_bigrams(spark.createDataFrame(rows, "line_no int, tokens array<string>"), min_freq=3, min_bigram=3)
    assert {r["line_no"]: r["tokens"] for r in got.collect()} == {i: ["a", "b", "a_b"] for i in range(3)}


def test_morph_filter(spark):
    rows = [("하다", "VV"), ("하늘", "NNG"), ("은", "JX"), ("은은", "JX"), ("빠른", "VV+ETM"), ("멈춤", "NNG")]
    morphs = spark.createDataFrame(rows, "word string, tag string")
    stop = spark.createDataFrame([("멈춤",)], "word string")
    assert {r["word"] for r in vocab.filter_morphs(morphs, stop).collect()} == {"하늘", "빠른"}
    assert {r["word"] for r in vocab.meaning_words(morphs).collect()} == {"하다", "하늘", "빠른", "멈춤"}


def test_spellings_of_one_line_are_one_line(spark):
    import unicodedata

    composed = "하늘이 é 파랗다 a b"
    rows = [(0, composed), (1, unicodedata.normalize("NFD", composed)), (2, "하늘이  é\u3000파랗다 a b "), (3, "a b c d"), (4, "a  b\tc\x1cd"), (5, "\u212b x"), (6, "Å x"), (7, None), (8, " \u2003")]
    table = spark.createDataFrame(rows, "line_no int, text string")
    kept = {r["line_no"]: r["text"] for r in dedup.exact_dedup(table).collect()}
    assert kept == {0: composed, 3: "a b c d", 5: "Å x"}
    assert dedup.dedup_counts(table).first() == (9, 3)
    assert {r["sig"] for r in dedup.with_signature(table.where("line_no in (3, 4)")).collect()} == {dedup.with_signature(table.where("line_no = 3")).first()["sig"]}


def test_characters_taken_as_composed_are():
    import unicodedata

    seconds = {int(d.split()[1], 16) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    for low, high in st.COMPOSED:
        for c in range(low, high + 1):
            assert unicodedata.normalize("NFC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in seconds


def test_words_travel_or_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(0, ["a", "b", "a", "c"]), (1, []), (2, ["x"]), (3, ["b", "b", "c", "a", "b"])], "line_no long, tokens array<string>")
    made = []
    for most in (500_000, 0):
        monkeypatch.setattr(vocab, "MOST_WORDS", most)
        made.append({r["line_no"]: r["tokens"] for r in vocab.filtered_bigrams(rows, min_freq=2, min_bigram=2, min_tokens=0).collect()})
    assert made[0] == made[1] == {0: ["a", "b", "a", "c", "a_b"], 1: [], 2: [], 3: ["b", "b", "c", "a", "b", "a_b"]}


def test_first_texts(spark):
    from inkfold.operators import scoring

    rows = spark.createDataFrame([(c, t, "x") for c in (1, 2) for t in range(0, 50, c)], "chat_id int, turn int, text string")
    got = scoring.first_texts(rows, 7).groupBy("chat_id").agg(F.sort_array(F.collect_list("turn")).alias("t")).collect()
    assert {r["chat_id"]: r["t"] for r in got} == {1: list(range(7)), 2: list(range(0, 14, 2))}
