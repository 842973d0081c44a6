"""SimHash, components, sharding, rules, tiling, classifier and language model against brute force."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkfold.llm import components, context_tree, decontamination, language_model, quality_classifier, quality_rules, sharding, simhash

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, fp string, component_id string, shard string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], COLUMNS)


def brute_components(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(0, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            if copy:
                copy[rng.randrange(len(copy))] = "Changed"
            texts.append("\t".join(copy))
    rows = [*enumerate(texts), (1000, None), (1001, "  \n"), (1002, texts[3]), (1002, texts[3]), (None, texts[0]), (None, "lonely é text")]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = defaultdict(set)
    for i, t in rows:
        prints[brute_print(t)].add(i)
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 4]
    root = brute_components(pairs, list(prints))
    least = {}
    for p, ids in prints.items():
        for i in ids:
            if i is not None:
                least[root[p]] = min(least.get(root[p], i), i)
    by = Counter((r["doc_id"], bytes(r["fp"]).hex(), r["component_id"]) for r in got)
    assert by == Counter((i, f"{brute_print(t):016x}", least.get(root[brute_print(t)])) for i, t in rows)


def test_bit_sliced_links_are_all_links():
    rng = np.random.default_rng(2)
    for n, groups, radius in ((300, 5, 4), (200, 1, 20), (1, 1, 4)):
        center = rng.integers(0, 256, (groups, 8), dtype=np.uint8)
        group = np.sort(rng.integers(0, groups, n))
        fps = np.packbits(np.unpackbits(center[group], axis=1) ^ (rng.random((n, 64)) < 0.06), axis=1)
        d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
        want = brute_components([(a, b) for a, b in zip(*np.nonzero((d <= radius) & (group[:, None] == group[None])), strict=True) if a < b], range(n))
        assert brute_components(simhash.links(group, fps, radius), range(n)) == want
        for k in range(groups):
            at = np.flatnonzero(group == k)
            got = brute_components([(at[a], at[b]) for a, b in simhash._search(fps[at], radius)], at.tolist())
            assert got == {int(a): want[a] for a in at}


def test_buckets_stay_small_and_lose_no_pair_as_rows_grow():
    rng = np.random.default_rng(7)
    sizes = []
    for rows in (2_000, 20_000, 200_000):
        sets = simhash._blocks(64, 4, rows, mean=1)
        bits = rng.integers(0, 2, (rows, 64), dtype=np.int64)
        biggest = max(int(np.unique(bits[:, at] @ (1 << np.arange(len(at))), return_counts=True)[1].max()) for at in sets[:6])
        sizes.append((len(sets), biggest))
    assert sizes[0][0] == 5 and sizes[1][0] == 15 and max(b for _, b in sizes) <= 12
    assert [len(simhash._blocks(64, 4, n)) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [5, 5, 15, 35, 70]
    for rows in (0, 10**8, 10**10, 10**12):
        sets = [set(x) for x in simhash._blocks(64, 4, rows)]
        for _ in range(2000):
            flipped = set(rng.choice(64, 4, replace=False).tolist())
            assert any(not s & flipped for s in sets)


def test_hot_buckets_are_cut_without_losing_links(spark):
    rng = np.random.default_rng(4)
    center = rng.integers(0, 2, 64)
    fps = np.unique(np.packbits((center ^ (rng.random((400, 64)) < 0.04)).astype(np.uint8), axis=1), axis=0)
    rows = spark.createDataFrame([(f.tobytes(),) for f in fps], "fp binary")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in components.connected_components(simhash.link_table(rows, simhash._blocks(64, 4), 4, chunk=30)).collect()}
    d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    want = brute_components([(a, b) for a, b in zip(*np.nonzero(d <= 4), strict=True) if a < b], range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        x, y = fps[a].tobytes(), fps[b].tobytes()
        assert (want[a] == want[b]) == (roots.get(x, x) == roots.get(y, y))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)] + [(100, 101), (101, 100), (None, 3)]])
@pytest.mark.parametrize("hub", [3, 1000])
def test_components(spark, edges, hub, monkeypatch):
    monkeypatch.setattr(components, "RUN", 16)
    monkeypatch.setattr(components, "HUB", hub)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components(real, {x for e in real for x in e})


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    x, y = grams(a or ""), grams(b or "")
    return 1.0 if not x and not y else len(x & y) / max(1, len(x | y))


def test_near_duplicate_removal_is_exact(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(500)]
    rows = []
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 300))]
        for k in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(k * 2):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1]), (None, rows[5][1]), (None, "only here without an id"), (None, "only here without an id")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(table(spark, rows)).collect()]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    groups = defaultdict(list)
    for k, r in brute_components(pairs, range(len(rows))).items():
        groups[r].append(rows[k])
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert sorted(i for i, _ in kept if i is not None) == sorted(i for i, _ in want if i is not None)
    assert [t for i, t in kept if i is None] == ["only here without an id"]


@pytest.mark.parametrize("held", [8_000_000, 200_000])
def test_large_groups_are_verified_exactly(spark, held):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(600):
        copy = list(base)
        for at in rng.sample(range(200), 3):
            copy[at] = f"x{k}_{at}"
        rows.append((len(rows), " ".join(copy)))
        if k % 10 == 0:
            copy[rng.randrange(200)] = "changed"
            rows.append((len(rows), " ".join(copy)))
    rows += [(None, " ".join([*base[:100], "lone", *base[100:150]])), (None, " ".join([*base[:100], "lone", *base[100:151]]))]
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = brute_components(pairs, range(len(rows)))
    want = sorted(rows[r][0] for r in set(roots.values()) if rows[r][0] is not None)
    kept = simhash.drop_near_duplicates(table(spark, rows), held=held).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == want
    assert sum(r["doc_id"] is None for r in kept) == 1


def test_candidates_come_from_distinct_shingles(spark):
    rng = random.Random(9)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    body, line, long_line = words(200), words(10), words(11)
    rows = [(0, f"{body} {line}"), (1, f"{body} " + f"{line} " * 30)]  # 0.98: one stays
    rows += [(2, f"{words(100)} " + f"{long_line} " * 400), (3, f"{words(100)} " + f"{long_line} " * 400)]  # 0.05: both stay
    for k in range(200):
        short = words(8)
        rows += [(10 + 2 * k, short), (11 + 2 * k, f"{short} {words(1)}")]  # 4 of 5 shingles: one stays
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(table(spark, rows)).collect()}
    assert kept == {0, 2, 3, *(10 + 2 * k for k in range(200))}


def test_jump_hash_and_slots(spark):
    rows = [(i, f"t{i % 7}") for i in range(600)] + [(5, "t5")] * 300 + [(None, None), (None, ""), (-3, "é")]
    got = sharding.shard_documents(table(spark, rows), 16).collect()
    assert len(got) == len(rows)
    keys = {r["doc_id"]: r["k"] for r in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").distinct().select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("k")).collect()}

    def jump(key, n):
        key, b, j = key & (2**64 - 1), -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    slots = defaultdict(list)
    for r in got:
        assert (r["shard"], r["grown_shard"]) == (jump(keys[r["doc_id"]], 16), jump(keys[r["doc_id"]], 17)) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert sharding.shard_documents(table(spark, []), 16).count() == 0


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    places = {p for i, w in enumerate(windows) if n[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def test_statistics_and_verdicts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 40, "line\nline\n\n line", "é#ü b $", "q" * 5000, " lead\x0btrail\x0c "]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "|", "Z! "]) for _ in range(rng.randint(0, 200))) for _ in range(40)]
    rows = [*enumerate(texts), (None, "a b c"), (0, "again")]
    rule = quality_rules.Rule((quality_rules.Condition("symbol_ratio", True, 0.1),))
    got = Counter((r["doc_id"], *list(r)[1:6], r["base_failed"], r["kept"]) for r in quality_rules.judge_documents(table(spark, rows), [rule]).collect())
    want = Counter()
    for i, t in rows:
        s = brute_statistics(t)
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        want[(i, *s, failed, not failed and s[2] / max(s[0], 1) < 0.1)] += 1
    assert got == want


def brute_cover(cuts, counts, names, precision, least, most_conditions, most_rules):
    """Sequential covering, condition by condition, over plain rows."""
    rows = [(dict(zip(names, c[: len(names)], strict=True)), c[len(names)], c[-2], c[-1]) for c in counts]
    literals = [(n, up, k) for n, values in zip(names, cuts, strict=True) for k in range(1, len(values) + 1) for up in (True, False)]

    def hit(row, literal):
        n, up, k = literal
        return row[0][n] >= k if up else row[0][n] < k

    def total(some):
        return sum(r[3] for r in some), sum(r[2] for r in some)

    out = []
    while len(out) < most_rules and total([r for r in rows if not r[1]])[0] >= least:
        grown, left = [], [r for r in rows if not r[1]]
        while len(grown) < most_conditions and total(left)[1]:
            p, n = total(left)
            gains = []
            for x in literals:
                a, b = total([r for r in left if hit(r, x)])
                gains.append(a * (math.log2((a + 1e-9) / (a + b + 1e-9)) - math.log2(p / (p + n))) if a else -1.0)
            best = max(range(len(literals)), key=lambda i: (round(gains[i], 9), -i))
            if gains[best] <= 1e-6:
                break
            grown.append(literals[best])
            left = [r for r in left if hit(r, literals[best])]
        if not grown:
            break

        def worth(k, grown=grown):
            p, n = total([r for r in rows if r[1] and all(hit(r, x) for x in grown[:k])])
            return (p - n) / (p + n) if p + n else -1.0

        keep = max(range(1, len(grown) + 1), key=lambda k: (worth(k), -k))
        covered = [r for r in rows if all(hit(r, x) for x in grown[:keep])]
        p, n = total(covered)
        if p < least or p / (p + n) < precision:
            break
        out.append([(n_, up, cuts[names.index(n_)][k - 1]) for n_, up, k in grown[:keep]])
        rows = [r for r in rows if r not in covered]
    return out


def test_covering_is_that_of_plain_rows():
    rng, names = random.Random(12), ("one", "two", "three")
    lengths = set()
    for _ in range(25):
        cuts = [sorted(rng.sample(range(100), rng.randint(1, 4))) for _ in names]
        seen = {}
        for _ in range(200):
            at = tuple(rng.randint(0, len(c)) for c in cuts)
            bad = (at[0] > len(cuts[0]) // 2) ^ (at[1] == 0 and rng.random() < 0.9) if rng.random() < 0.95 else rng.random() < 0.5
            key = (*at, rng.random() < 1 / 3)
            good_n, bad_n = seen.get(key, (0, 0))
            seen[key] = (good_n + (not bad), bad_n + bad)
        counts = [(*k, *v) for k, v in sorted(seen.items())]
        got = quality_rules.cover(cuts, counts, names)
        want = brute_cover(cuts, counts, names, 0.9, 5, 4, 24)
        assert [[(c.name, c.at_least, c.value) for c in r.conditions] for r in got] == want
        lengths.add(len(want))
    assert max(lengths) > 1


def test_rules_separate_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality_rules.learn_rules(docs, labels)
    judged = quality_rules.judge_documents(docs.join(labels, "doc_id"), rules).join(labels, "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert quality_rules.learn_rules(docs, labels.where("quality = 5")) == []


def brute_tiles(a, b, least):
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    for n in range(min(len(a), len(b)), least - 1, -1):
        for i in range(len(a) - n + 1):
            for j in range(len(b) - n + 1):
                if not any(used_a[i : i + n]) and not any(used_b[j : j + n]) and a[i : i + n] == b[j : j + n]:
                    out.append((i, j, n))
                    used_a[i : i + n] = used_b[j : j + n] = [True] * n
    return out


def test_tiling_is_greedy_and_catches_reordering():
    rng = random.Random(8)
    for letters in (1, 2, 4):
        for _ in range(60):
            a, b = ([rng.randrange(letters) for _ in range(rng.randint(0, 25))] for _ in range(2))
            assert decontamination.tiles(np.array(a, np.int64), np.array(b, np.int64), 3) == brute_tiles(a, b, 3)
    a = list(range(40))
    assert sum(n for _, _, n in decontamination.tiles(np.array(a), np.array(a[20:] + [-1] + a[:20]), 5)) == 40


def test_tiling_of_repetitive_texts_is_fast():
    rng = np.random.default_rng(3)
    began = time.time()
    for pattern in (np.zeros(1, np.int64), np.arange(3), rng.integers(0, 2, 7)):
        item, text = np.resize(pattern, 8000), np.resize(pattern, 50_000)
        assert sum(n for _, _, n in decontamination.tiles(item, text, 5)) == 8000
    decontamination.tiles(rng.integers(0, 2, 4000), rng.integers(0, 2, 20_000), 5)
    assert time.time() - began < 20


def plain_words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def test_leaks_are_those_of_brute_force_whatever_the_way(spark):
    item = " ".join(f"word{i}" for i in range(30))
    long_item = " ".join(f"long{i}" for i in range(200))
    texts = [item.upper() + "!", "before " + item.replace(" ", "\n") + " after", " ".join(item.split()[15:] + ["x"] + item.split()[:15]), " ".join(item.split()[:8]), None, "", "clean text of nothing"]
    texts += ["it is too  SHORT, so", "too very short", "x " + " ".join(long_item.split()[20:75]) + " y", " ".join(long_item.split()[20:60]), "a b " * 5000, item + " " + long_item]
    rng = random.Random(3)
    for _ in range(14):
        parts = [item.split(), long_item.split(), ["other"] * 3, ["a", "b"] * 6]
        texts.append(" ".join(w for _ in range(5) for p in [rng.choice(parts)] for at in [rng.randrange(len(p))] for w in p[at : at + rng.randint(2, 30)]))
    rows = [*enumerate(texts), (None, item), (0, item), (0, item)]
    docs = table(spark, rows)
    items = [("one", item), ("none", None), ("few", "too short"), ("other", "other words that are not there at all in any text"), ("long", long_item), ("again", long_item), (None, "a b " * 20), ("empty", "!!")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rule = decontamination.Rule()
    want = Counter()
    for d, t in rows:
        for i, q in items:
            a, b = plain_words(q), plain_words(t)
            least = min(rule.seed, len(a))
            found = brute_tiles(a, b[:400], least) if a else []
            if found and rule.holds(len(a), sum(x[2] for x in found), max(x[2] for x in found)):
                want[d, i, len(a), sum(x[2] for x in found), max(x[2] for x in found)] += 1
    assert {(d, i) for d, i, *_ in want} >= {(0, "one"), (2, "one"), (None, "one"), (7, "few"), (9, "long"), (9, "again"), (11, None)} and (10, "long") not in {k[:2] for k in want}
    clean = Counter(d for d, _ in rows)
    gone = {t for d, t in rows if any(k[0] == d for k in want)}
    for size in (16_000_000, 60):
        got = decontamination.overlaps(docs, bench, rule=rule, block_bytes=size)
        assert dict(got.dtypes)["item_id"] == "string"
        assert Counter((r["doc_id"], r["item_id"], r["item_tokens"], r["covered_tokens"], r["longest_run"]) for r in got.collect()) == want
        kept = decontamination.decontaminate(docs, bench, rule=rule, block_bytes=size)
        assert kept.columns == docs.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, t in rows if t not in gone)
        assert decontamination.overlaps(docs.limit(0), bench, block_bytes=size).count() == 0 and decontamination.decontaminate(docs.limit(0), bench, block_bytes=size).count() == 0
    assert sum(clean.values()) == len(rows)
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0 and decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_word_vectors_are_those_of_the_definition(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gamma!", "12", "$$", "rare" + str(k)]) for _ in range(rng.randint(0, 30))).encode() for k in range(20)] + [None, b""]
    monkeypatch.setattr(quality_classifier, "RUN", 4)
    made = quality_classifier.learn_vectors(lambda: texts, least=3)
    want = {t: np.zeros(quality_classifier.DIM) for t in made.ids}
    for x in texts:
        words = [t.lower() for t in quality_classifier.terms(x)]
        words = [t if t in made.ids else quality_classifier.shape_of(t) for t in words]
        for i, j in itertools.permutations(range(len(words)), 2):
            if abs(i - j) <= 2:
                want[words[i]] += quality_classifier.index_vector(words[j]) / abs(i - j)
    for t, i in made.ids.items():
        v = want[t] / max(np.linalg.norm(want[t]), 1e-9) + 0.5 * quality_classifier.index_vector(t) / np.sqrt(quality_classifier.NONZERO)
        assert np.allclose(made.table[i], v, atol=1e-5)
    assert "alpha" in made.ids and "rare1" not in made.ids


def test_gradients_and_temperature():
    rng = np.random.default_rng(1)
    net = quality_classifier.Network(5, 3)
    x, y = rng.normal(size=(40, 5)), (rng.random(40) < 0.4).astype(float)
    net.mean, net.scale = x.mean(axis=0), x.std(axis=0)
    for w, g in zip(net.w, net.gradients(x, y, 0.1), strict=True):
        for at in np.ndindex(w.shape):
            old = w[at]
            w[at] = old + 1e-5
            up = net.loss(x, y, 0.1)
            w[at] = old - 1e-5
            down = net.loss(x, y, 0.1)
            w[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6
    # labels drawn with logits three times too sure: the temperature undoes it
    z = rng.normal(size=20_000) * 2
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    net.logits = lambda rows: 3 * rows
    net.calibrate(z, labels)
    assert 2.6 < net.temperature < 3.4


def test_classifier_takes_any_rows(spark):
    rows = [(i, ("good words here " if i % 2 else "$$ BAD!! $$ ") * (i % 7 + 1), "x", "y") for i in range(300)] + [(7, "$$ BAD", "x", "y")] * 2 + [(None, None, None, None), (1001, "", "x", "y"), (301, "good words " * 150_000, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, Predicted string")
    labels = spark.createDataFrame([(i, int(i % 2 == 1)) for i in range(302)] + [(None, 1), (5, None), (3, 0)], "doc_id long, quality int")
    model = quality_classifier.learn_classifier(docs, labels)
    made = quality_classifier.classify_documents(docs, model)
    assert made.columns == ["doc_id", "score", "predicted"] and made.count() == len(rows)
    got = {r["doc_id"]: r["score"] for r in made.collect()}
    assert got[11] > 0.7 > 0.3 > got[10] and got[301] > 0.5 and 0 <= got[None] <= 1 and got[1001] == got[None]
    assert quality_classifier.classify_documents(docs.limit(0), model).count() == 0 and quality_classifier.keep_good(docs.limit(0), model).count() == 0
    assert quality_classifier.learn_classifier(docs.limit(0), labels) is None


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.learn_classifier(docs, labels)
    extra = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (-1, ""), (-2, "​")], "doc_id long, text string"))
    rows = quality_classifier.classify_documents(extra.withColumn("held_out", quality_classifier.held_out()), model)
    assert rows.count() == extra.count() and rows.where("score < 0 or score > 1 or score is null").count() == 0
    pairs = [(r["score"], r["quality"]) for r in rows.where("held_out").join(labels, "doc_id").collect()]
    good, bad = [s for s, q in pairs if q == 1], [s for s, q in pairs if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert quality_classifier.learn_classifier(docs, labels.limit(0)) is None
    assert quality_classifier.classify_documents(extra, None).where("score <> 0.5").count() == 0
    kept = quality_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def brute_tree(data, depth):
    """Sequential context-tree weighting by recursion over the same contexts."""
    counts = defaultdict(lambda: [0, 0])
    for i in range(depth, len(data)):
        for k in range(8):
            prefix = (256 | data[i]) >> (8 - k)
            for d in range(depth + 1):
                counts[bytes(data[i - d : i]), prefix][data[i] >> (7 - k) & 1] += 1

    def weighted(ctx, prefix):
        if (ctx, prefix) not in counts:
            return 0.0
        a, b = counts[ctx, prefix]
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        if len(ctx) == depth:
            return kt
        below = sum(weighted(bytes([c]) + ctx, prefix) for c in range(256))
        return math.log(0.5) + np.logaddexp(kt, below)

    def predict(ctx, byte):
        out = 0.0
        for k in range(8):
            prefix, bit = (256 | byte) >> (8 - k), byte >> (7 - k) & 1
            before = weighted(b"", prefix)
            touched = [(ctx[len(ctx) - d :], prefix) for d in range(depth + 1)]
            new = [t for t in touched if t not in counts]
            for t in touched:
                counts[t][bit] += 1
            out += (weighted(b"", prefix) - before) / math.log(2)
            for t in touched:
                counts[t][bit] -= 1
            for t in new:
                del counts[t]
        return out

    return predict


def test_tree_predicts_what_the_weighted_sum_says():
    data = b"\n\nabracadabra abra\n\ncadabra\n"
    codes = context_tree.gram_codes(np.frombuffer(data, np.uint8), 2)
    grams, n = np.unique(codes, return_counts=True)
    tree, predict = context_tree.Tree(grams, n, 2), brute_tree(data, 2)
    for ctx, byte in ((b"ab", ord("r")), (b"ra", ord(" ")), (b"zz", ord("a")), (b"xb", ord("r")), (b"ab", 200), (b"\n\n", ord("a"))):
        code = np.array([ctx[0] << 16 | ctx[1] << 8 | byte], np.uint64)
        assert abs(tree.log2(code)[0] - predict(ctx, byte)) < 1e-5
    logs = tree.log2(grams)
    for slots in (1, 4, 12):
        table_ = context_tree.Table(grams[::-1], logs[::-1], slots)
        assert (table_.log2(grams) == logs).all() and np.isnan(table_.log2(np.array([1, 2], np.uint64))).all()
    assert np.isnan(context_tree.Table(grams[:0], logs[:0], 4).log2(grams)).all()
    every = np.arange(256, dtype=np.uint64) | np.uint64(ord("a") << 16 | ord("b") << 8)
    assert abs(np.exp2(tree.log2(every)).sum() - 1) < 1e-5


def test_language_model(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "The cat  ran", None, "", "a dog\nsat", "the the the", "zebra unseen"] * 4)] + [(None, "cat"), (1, "The cat  ran")]
    got = language_model.score_documents(table(spark, rows), frequent=2, depth=3).collect()
    assert len(got) == len(rows)
    split = [(i, (t or "").lower().split(), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    count = Counter(w for _, ws, held in split if not held for w in [*ws, "\n"])
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for i, ws, held in split:
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in [*ws, "\n"])
        want[i, held, len(ws) + 1, sum(count[w] > 0 for w in [*ws, "\n"]), total, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    none = language_model.score_documents(table(spark, [(1, "ab"), (2, None)]), held_out=F.lit(True)).collect()
    assert {(r["base_score"], round(r["score"] / math.log10(2))) for r in none} == {(0.0, -24), (0.0, -8)}
    assert language_model.score_documents(table(spark, [])).count() == 0
    small = language_model.score_documents(table(spark, rows), depth=4, most_grams=40).collect()
    assert len(small) == len(rows) and all(r["score"] < 0 for r in small)


def test_scores_are_the_tree_s_whatever_the_limits(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(200, None), (201, ""), (None, "abc"), (None, "abc"), (300, "Zq " * 50_000)]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    codes = [context_tree.gram_codes(np.frombuffer(b"\xff" * 3 + (t or "").encode().translate(language_model.LOWER) + b"\xff", np.uint8), 3) for _, t in rows]
    grams, n = np.unique(np.concatenate([c for c, (i, _) in zip(codes, rows, strict=True) if not held[i]]), return_counts=True)
    tree = context_tree.Tree(grams, n, 3)
    want = Counter((i, round(tree.log2(c).sum() * math.log10(2), 3), round(-tree.log2(c).mean(), 4)) for c, (i, _) in zip(codes, rows, strict=True))
    for limits in ({}, {"most_grams": 100}, {"block_grams": 50}, {"most_grams": 1, "block_grams": 5}):
        got = language_model.score_documents(table(spark, rows), depth=3, **limits).collect()
        assert Counter((r["doc_id"], round(r["score"], 3), round(r["bits_per_byte"], 4)) for r in got) == want


def test_id_bitmap_never_misses(spark):
    from inkfold.llm.common import with_maybe

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    ids = spark.range(0, 20_000, 40)
    marked = with_maybe(rows, "doc_id", ids)
    assert marked.count() == 20_000
    assert marked.where("__maybe and doc_id % 40 = 0").count() == 500
    assert marked.where("__maybe and doc_id % 40 <> 0").count() < 200
    assert with_maybe(rows, "doc_id", ids, most_bytes=1).where("not __maybe").count() == 0
    assert with_maybe(rows, "doc_id", ids.limit(0)).where("__maybe").count() == 0
