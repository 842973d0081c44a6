"""Images, outside engines and the assembled mask generator, with stand-ins for the engines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.functions.images import decode_png, encode_png
from inkfold.operators import lexicon as lx
from inkfold.operators import masks
from inkfold.plans import providers
from inkfold.sources import readers, sinks


def picture(h=40, w=60):
    out = np.full((h, w, 3), 20, np.uint8)
    out[5:15, 6:20] = 200
    out[22:36, 30:50] = 150
    return out


class Flood:
    """Proposes the connected patch of equal colour around each point, and a poor mask beside it."""

    def masks_at(self, crop, points):
        out = []
        for x, y in points:
            on = (crop == crop[int(y), int(x)]).all(axis=2)
            counts = masks.run_lengths(on.T.reshape(-1))
            good = 0.99 if crop[int(y), int(x)][0] > 100 else 0.1
            out.append([{"counts": counts, "iou": good, "stability": 0.99}, {"counts": counts, "iou": 0.5, "stability": 0.2}])
        return out


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (5, 7, 1), (3, 4, 2), (6, 5, 3), (4, 4, 4)):
        a = rng.integers(0, 256, shape, dtype=np.uint8)
        got = decode_png(encode_png(a))
        want = a if a.ndim == 3 and a.shape[2] >= 3 else np.repeat(a.reshape(*a.shape[:2], -1)[:, :, :1], 3, axis=2)
        assert (got == want[:, :, :3]).all()
    assert decode_png(b"no image") is None and decode_png(None) is None and decode_png(encode_png(a)[:-20]) is None


def test_png_filters():
    import struct
    import zlib

    from inkfold.functions import images

    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (5, 4, 3), dtype=np.uint8).astype(int)
    rows = b""
    for y in range(5):
        line, up = a[y].reshape(-1), (a[y - 1].reshape(-1) if y else np.zeros(12, int))
        left, corner = np.r_[0, 0, 0, line[:-3]], np.r_[0, 0, 0, up[:-3]]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * line, left, up, (left + up) // 2, paeth][y]
        rows += bytes([y]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = images.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
    assert (decode_png(raw) == a).all()


@pytest.mark.parametrize(("layers", "least"), [(0, 0), (1, 0), (0, 30)])
def test_mask_generator(spark, layers, least):
    rows = [(1, encode_png(picture()), 40, 60), (2, b"broken", 40, 60)]
    images = spark.createDataFrame(rows, "image_id long, content binary, height int, width int")
    made = masks.generate_masks(images, providers.propose_at(Flood, 5), layers=layers, side=6, least_region=least)
    got = {tuple(r["bbox"]): r for r in made.collect()}
    assert {(6.0, 5.0, 13.0, 9.0), (30.0, 22.0, 19.0, 13.0)} <= set(got)
    assert all(r["image_id"] == 1 and r["predicted_iou"] > 0.88 for r in got.values())
    one = got[6.0, 5.0, 13.0, 9.0]
    assert one["area"] == 140 and sum(one["segmentation"]["counts"]) == 40 * 60
    if not layers:
        assert len(got) == 2 and made.count() == 2


def test_cut_outs_and_mask_files(spark, tmp_path):
    images = spark.createDataFrame([(1, encode_png(picture())), (2, b"broken")], "image_id long, content binary")
    on = np.zeros((40, 60), bool)
    on[5:15, 6:20] = True
    table = [(1, 10, masks.run_lengths(on.T.reshape(-1)), 40, 60), (1, 11, [2400], 40, 60), (2, 12, [2400], 40, 60)]
    found = spark.createDataFrame(table, "image_id long, mask_id long, counts array<long>, height int, width int")
    cuts = sinks.encoded_images(sinks.cut_outs(images, found, 3)).collect()
    assert len(cuts) == 1 and cuts[0]["mask_id"] == 10 and len(cuts[0]["object_id"]) == 36
    assert (decode_png(cuts[0]["png"]) == picture()[2:18, 3:23]).all()
    sinks.write_mask_images(found, str(tmp_path / "masks"))
    assert sorted(p.name for p in (tmp_path / "masks").iterdir()) == ["10.png", "11.png", "12.png"]
    assert (decode_png((tmp_path / "masks/10.png").read_bytes())[:, :, 0] == on * 255).all()


def test_images_from_folders_and_addresses(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(encode_png(picture()))
    (tmp_path / "b.png").write_bytes(b"broken")
    good = readers.readable_images(readers.read_images(spark, str(tmp_path))).collect()
    assert [(r["height"], r["width"]) for r in good] == [(40, 60)]
    urls = spark.createDataFrame([(f"file://{tmp_path}/a.png",), (f"file://{tmp_path}/none.png",)], "url string")
    assert [r["url"][-5:] for r in readers.readable_images(providers.fetch_images(urls)).collect()] == ["a.png"]


class Tagger:
    def tag(self, text):
        return [(w, "NNG") for w in text.split()]

    def tag_best(self, text, n):
        return [[(w, f"T{k}") for w in text.split()] for k in range(n)]


class Costs:
    def costs(self, entry):
        return 1, 2, 100 * len(entry["surface"])


def test_taggers_and_costs(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "line_no int, text string")
    assert providers.tag_texts(rows, Tagger).count() == 2
    best = providers.tag_best(rows, Tagger, 3).collect()
    assert {(r["rank"], r["word"], r["tag"]) for r in best} == {(k, w, f"T{k}") for k in range(3) for w in "ab"}
    entries = spark.createDataFrame([("abc", 0, 0, 0, "x")], "surface string, left_id int, right_id int, cost int, more string")
    assert tuple(providers.generate_costs(entries, Costs).first()) == ("abc", 1, 2, 300, "x")

    def fails():
        raise ImportError("not there")

    assert isinstance(providers.first_tagger(fails, Tagger), Tagger)
    with pytest.raises(RuntimeError):
        providers.first_tagger(fails)


def test_metric_calls_and_options():
    assert providers.given(a=1, b=None, c=0) == {"a": 1, "c": 0}
    assert providers.call_metric(lambda texts, resources=None: (1, 2, 3, 4, 5), ["x"]) == (1.0, 2.0, 3.0, 4.0)
    assert providers.call_metric(lambda texts, place: 7, ["x"], "here") == (7.0, 0.0, 0.0, 0.0)


def test_providers_are_told_apart_by_what_they_are():
    one, two = providers._made(lambda: providers.HashEmbedder(8)), providers._made(lambda: providers.HashEmbedder(16))
    assert (one.width, two.width) == (8, 16)


def test_paths_and_street_names(spark, tmp_path):
    (tmp_path / "s.txt").write_text("가로\n\n 나로 \n", encoding="utf-8")
    assert [r["name"] for r in readers.read_street_names(spark, str(tmp_path / "s.txt")).collect()] == ["가로", "나로"]
    here, gone = str(tmp_path / "s.txt"), str(tmp_path / "t.txt")
    assert readers.first_present(spark, [gone, here]) == here and readers.first_present(spark, [gone], "d") == "d"
    with pytest.raises(FileNotFoundError):
        readers.first_present(spark, [gone])


def test_numbers_follow_file_names(spark, tmp_path):
    (tmp_path / "n").mkdir()
    for name, n in (("a.txt", 3), ("b.txt", 400), ("c.txt", 1)):
        (tmp_path / "n" / name).write_text("".join(f"{name}{i}\n" for i in range(n)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        got = [r["text"] for r in readers.read_numbered_lines(spark, str(tmp_path / "n")).orderBy("line_no").collect()]
        assert got == [f"{name}{i}" for name, n in (("a.txt", 3), ("b.txt", 400), ("c.txt", 1)) for i in range(n)]
        assert readers.read_all_lines(spark, str(tmp_path / "n")).select(F.min("line_no"), F.max("line_no"), F.countDistinct("line_no")).first() == (0, 403, 404)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_database_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    sinks.write_table(rows, url, "words", "overwrite")
    sinks.write_table(rows, url, "words")
    assert readers.read_table(spark, url, "words").count() == 4
    sinks.write_table(rows.limit(1), url, "words", "overwrite")
    assert readers.read_table(spark, url, "words").count() == 1


def test_context_patterns(spark):
    rows = spark.createDataFrame([("left", "NNG", "*", "T", "가"), ("right", "NNG", "*", "T", ""), ("right", "NNG", "*", "T", "가")], "side string, t string, c string, j string, r string")
    made = lambda side: lx.context_pattern(side, F.col("t"), F.col("c"), F.col("j"), F.col("r"))
    got = rows.select(F.when(F.col("side") == "left", made("left")).otherwise(made("right")).alias("p"))
    assert [r["p"] for r in got.collect()] == [r"NNG,*,\*,가", "NNG,*,T", "NNG,*,T,가"]
