"""Secret scans: a linear-chain conditional random field over tokens, on top of three fixed patterns.

Every token of every text is tagged as begin, inside or outside of a secret
from its shape, its neighbours and features of the whole text; the best tag
sequence is found by Viterbi. What a token adds to the scores is worked out
once for each distinct token and looked up afterwards. Weights are whole
numbers, so sums do not depend on their order, and Viterbi runs over all
texts of a batch at once: blocks of tokens in lockstep, joined by the exact
scores between them. The result is the best path of each whole text.

The field is trained by the driver on generated lines (seeded, no corpus
rows), by stochastic gradient on the conditional log-likelihood; its weights
are some thousand numbers and travel with the code.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string
import uuid
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.llm.common import LOWER, id_text, map_texts, resident

#: Fixed patterns, in the order of their kinds.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Words that announce a secret.
KEYWORDS = (b"password", b"passwd", b"passphrase", b"pwd", b"secret", b"token", b"api_key", b"apikey", b"credential", b"bearer", b"private_key", b"access_key", b"auth")

#: A token, with the white space after it.
PIECE = re.compile(rb"(?:[A-Za-z0-9+/_.\-]+|[\x80-\xff]+|[^A-Za-z0-9+/_.\-\x80-\xff\x20\x09-\x0D])[\x20\x09-\x0D]*")
SPACE = b" \t\n\x0b\x0c\r"
RUNS = re.compile(rb"[0-9]+|[A-Z]+|[a-z]+|[\x80-\xff]+|(.)\1*", re.DOTALL)
KEYWORD = re.compile(b"|".join(re.escape(k) for k in sorted(KEYWORDS, key=len, reverse=True)))
HEXADECIMAL = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
CONSONANTS = re.compile(rb"[bcdfghjklmnpqrstvwxz]+")
CASE_TURNS = re.compile(rb"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
#: Weights are whole multiples of 1 / SCALE; BAR stands for what may not be.
SCALE, BAR = 4096, 1 << 40


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, in bytes: leftmost and non-overlapping for each kind; failing matches are dropped."""
    out = []
    low = text.translate(LOWER)
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


# -------------------------------------------------------------------- features


def _shape(token: bytes) -> str:
    """Runs of character classes, at most nine of them."""
    if token.isalpha() and token.islower():
        return "a"
    out = []
    for m in RUNS.finditer(token):
        c = token[m.start()]
        out.append("9" if 48 <= c <= 57 else "A" if 65 <= c <= 90 else "a" if 97 <= c <= 122 else chr(c) if c < 128 else "u")
        if len(out) == 9:
            break
    return "".join(out)


@functools.cache
def plain_features(n: int, entropy: int, longest: int) -> list[str]:
    """Features of a token of small letters only."""
    return [f"n{n // 4}", "sa", f"e{entropy}", "d0", "h0", "l0", "u0", "dots0", "dash0", "t0", f"t0n{n // 8}", f"c{longest}"]


def _own(token: bytes, shape: str) -> list[str]:
    """Features of a token by itself; the first two are its length and shape."""
    n, kinds = len(token), set(token)
    entropy = math.log2(n)
    if len(kinds) < n:
        entropy -= sum(c * math.log2(c) for c in map(token.count, kinds)) / n
    digits = 0 if token.isalpha() else n - len(token.translate(None, b"0123456789"))
    low = token.translate(LOWER)
    upper = token != low
    mixed = upper and token.upper() != token
    turns = len(CASE_TURNS.findall(token)) if mixed else 0
    longest = max(map(len, CONSONANTS.findall(low)), default=0) if n >= 8 else 0
    if not upper and n > 1 and token.isalpha():
        return plain_features(min(n, 48), int(entropy * 2), min(longest, 12) // 2)
    out = [
        f"n{min(n, 48) // 4}",
        f"s{shape if len(shape) <= 4 else 'mix' + str(len(shape))}",
        f"e{int(entropy * 2)}",
        f"d{4 * digits // n}",
        f"h{int(n >= 12 and digits > 0 and HEXADECIMAL.fullmatch(token) is not None)}",
        f"l{int(n >= 12 and mixed) + int(n >= 12 and mixed and digits > 0)}",
        f"u{int(n >= 16 and upper and not mixed and token.isalnum() and digits > 0)}",
        f"dots{min(token.count(b'.'), 3)}",
        f"dash{min(token.count(b'-'), 3)}",
        f"t{min(turns, 12) // 2}",
        f"t{min(turns, 12) // 2}n{min(n, 48) // 8}",
        f"c{min(longest, 12) // 2}",
    ]
    return out + [f"w{token.decode('latin-1')}"] * (n == 1)


def _near(token: bytes, shape: str) -> str:
    """How a neighbour is seen."""
    if len(token) > 2 and (m := KEYWORD.search(token.translate(LOWER))):
        return "K" + m[0].decode()
    return token.decode("latin-1") if len(token) == 1 else shape[:3]


def _is_key(near: str) -> bool:
    """Whether a neighbour announces a secret; a K alone is the letter."""
    return len(near) > 1 and near[0] == "K"


def pieces_of(text: bytes) -> tuple[int, list[bytes]]:
    """Where the first token begins, and all tokens with the white space after them."""
    lead = len(text) - len(text.lstrip(SPACE))
    return lead, PIECE.findall(text, lead)


def features(text: bytes) -> list[list[str]]:
    """Features of every token of a text, by name: the plain form, for training and tests."""
    found = pieces_of(text)[1]
    tokens = [p.rstrip(SPACE) for p in found]
    shapes = [_shape(t) for t in tokens]
    seen = ["^", "^", "^", *map(_near, tokens, shapes), "^"]
    file = file_features(text)
    out = []
    for i, (t, shape) in enumerate(zip(tokens, shapes, strict=True)):
        own = _own(t, shape)
        near = seen[i : i + 3]
        key = int(any(_is_key(s) for s in near))
        glued = int(i > 0 and len(found[i - 1]) == len(tokens[i - 1]))
        out.append([*own, f"{own[4]}{own[5]}{own[6]}{own[2]}", "b", f"p{near[2]}", f"q{near[1]}", f"r{seen[i + 4]}", f"k{key}", f"{own[0]}{own[1]}k{key}", f"g{glued}", f"g{glued}p{near[2]}", *file])
    return out


def file_features(text: bytes) -> list[str]:
    """Features of the whole text: whether it looks like settings or code, and whether a keyword occurs."""
    lines = text.count(b"\n") + 1
    marks = text.count(b"=") + text.count(b"{") + text.count(b";")
    return [f"fm{min(2 * marks // lines, 3)}", f"fk{int(KEYWORD.search(text.translate(LOWER)) is not None)}"]


# ------------------------------------------------------------------- the field


class Field:
    """Whole-number weights of a linear-chain conditional random field with three tags, and the scores of tokens met before."""

    def __init__(self, emit: dict[str, np.ndarray], move: np.ndarray, kept: int = 250_000, kept_bytes: int = 32_000_000):
        self.emit, self.move, self.kept, self.kept_bytes = emit, move, kept, kept_bytes
        # the ways a neighbour can be seen that carry weight
        names = sorted({f.split("p", 1)[1] if f[0] == "g" else f[1:] for f in emit if f[0] in "pqr" or f[0] == "g" and "p" in f} | {"^"})
        self.near_id = {n: i for i, n in enumerate(names, 1)}
        zero = np.zeros(3, np.int64)
        self.zero = zero
        table = lambda lead: np.array([zero, *(emit.get(lead + n, zero) for n in names)])
        self.before, self.second, self.after = table("p"), table("q"), table("r")
        self.glued = np.array([table("g0p") + emit.get("g0", zero), table("g1p") + emit.get("g1", zero)])
        self.keyed = np.array([emit.get("k0", zero), emit.get("k1", zero)])
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.known: dict[bytes, tuple] = {}
        self.alike: dict[tuple, tuple] = {}
        self.held = 0
        self.table, self.used = np.zeros((4096, 12), np.int64), 0

    def _sum(self, names: list[str]) -> np.ndarray:
        found = [v for n in names if (v := self.emit.get(n)) is not None]
        return sum(found, self.zero)

    def _learn(self, pieces: set[bytes]) -> None:
        if len(self.ids) + len(pieces) > self.kept or self.held > self.kept_bytes:
            self._forget()
        rows = []
        for p in pieces:
            if p in self.ids:
                continue
            t = p.rstrip(SPACE)
            row = self.known.get(t)
            if row is None:
                shape = _shape(t)
                own, near = tuple(_own(t, shape)), _near(t, shape)
                alike = self.alike.get((own, near))
                if alike is None:
                    fixed = self._sum([*own, f"{own[4]}{own[5]}{own[6]}{own[2]}", "b"])
                    big = own[0] + own[1]
                    alike = (*fixed.tolist(), *self._sum([big + "k0"]).tolist(), *self._sum([big + "k1"]).tolist(), self.near_id.get(near, 0), int(_is_key(near)))
                    self.alike[own, near] = alike
                self.known[t] = row = alike
                self.held += len(t)
            self.ids[p] = self.used + len(rows)
            rows.append((*row, int(len(t) == len(p))))
            self.held += len(p)
        if not rows:
            return
        end = self.used + len(rows)
        if end > len(self.table):
            self.table = np.concatenate([self.table[: self.used], np.zeros((2 * end - self.used, 12), np.int64)])
        self.table[self.used : end] = rows
        self.used = end

    def scores(self, texts: list[bytes], found: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores [token, tag] of all tokens of all texts, and which tokens begin a text."""
        self._learn(set().union(*found))
        size = np.array([len(p) for p in found], np.int64)
        at = np.fromiter(map(self.ids.__getitem__, (x for p in found for x in p)), np.int64, int(size.sum()))
        start = np.zeros(len(at) + 1, bool)
        start[np.cumsum(size) - size] = True
        start = start[:-1]
        row = self.table[at]
        place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        edge = self.near_id["^"]

        def back(v: np.ndarray, k: int, outside: int) -> np.ndarray:
            out = np.full(len(v), outside, np.int64)
            out[k:] = v[:-k]
            out[place < k] = outside
            return out

        near, key, bare = row[:, 9], row[:, 10], row[:, 11]
        following = np.full(len(at), edge, np.int64)
        following[:-1] = np.where(start[1:], edge, near[1:])
        before = back(near, 1, edge)
        keyed = back(key, 1, 0) | back(key, 2, 0) | back(key, 3, 0)
        out = row[:, :3] + np.where(keyed[:, None] == 1, row[:, 6:9], row[:, 3:6]) + self.keyed[keyed]
        out += self.before[before] + self.second[back(near, 2, edge)] + self.after[following]
        glued = back(bare, 1, 0)
        out += self.glued[glued, before]
        out[glued == 0, INSIDE] -= BAR  # a secret holds no white space
        file = np.array([self._sum(file_features(t)) for t in texts]).reshape(-1, 3)
        return out + np.repeat(file, size, axis=0), start

    def tags(self, texts: list[bytes], found: list[list[bytes]]) -> np.ndarray:
        """The best tag sequences of all texts, one after the other."""
        return viterbi(*self.scores(texts, found), self.move)


def viterbi(scores: np.ndarray, start: np.ndarray, move: np.ndarray, block: int = 128) -> np.ndarray:
    """The best tags of a run of sequences; start marks the first step of each. Ties: the lower tag, from the end.

    scores: whole numbers [step, tag]. At a start any tag may come before,
    at no cost, so the run as a whole falls apart into its sequences; inside
    cannot start one. Blocks are taken in lockstep: first the scores of each
    block from every tag to every tag, then the exact scores at all borders
    one after the other, then steps back from every tag, of which one by one
    the right ones are chosen.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int8)
    count = -(-n // block)
    e = np.zeros((count * block, k), np.int64)
    e[:n] = scores
    begin = np.ones(count * block, bool)
    begin[:n] = start
    begin[0] = True
    e[n:, 1:] -= BAR
    e[begin, INSIDE] -= BAR
    e, begin = e.reshape(count, block, k), begin.reshape(count, block, 1)
    # step by step, and axes in the order tag before, tag, block: what is added up lies side by side
    e, begin = np.ascontiguousarray(e.transpose(1, 2, 0)), np.ascontiguousarray(begin[:, :, 0].T)
    free = ~begin
    whole = np.full((k, k, count), -BAR, np.int64)
    whole[np.arange(k), np.arange(k)] = 0
    for t in range(block):
        cost = move[:, :, None] * free[t]
        best = whole[:, 0, None] + cost[0]
        for a in range(1, k):
            best = np.maximum(best, whole[:, a, None] + cost[a])
        whole = best + e[t]
    border = np.zeros((count + 1, k), np.int64)
    for b, m in enumerate(whole.transpose(2, 0, 1)):
        border[b + 1] = (border[b][:, None] + m).max(axis=0)
    came = np.empty((block, count, k), np.int8)
    now = np.ascontiguousarray(border[:-1].T)
    for t in range(block):
        cost = move[:, :, None] * free[t]
        best, of = now[0] + cost[0], np.zeros((k, count), np.int8)
        for a in range(1, k):
            other = now[a] + cost[a]
            of[other > best] = a
            best = np.maximum(best, other)
        came[t], now = of.T, best + e[t]
    path = np.empty((block, count, k), np.int8)
    tag = np.tile(np.arange(k, dtype=np.int8), (count, 1))
    for t in range(block - 1, -1, -1):
        path[t] = tag
        tag = np.take_along_axis(came[t], tag.astype(np.int64), axis=1)
    chosen, last = np.empty(count, np.int64), int(border[-1].argmax())
    for b in range(count - 1, -1, -1):
        chosen[b] = last
        last = int(tag[b, last])
    return path[:, np.arange(count), chosen].T.reshape(-1)[:n]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(samples: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.2, batch: int = 10, seed: int = 7) -> Field:
    """Stochastic gradient ascent on the conditional log-likelihood (forward-backward), step falling with the epochs.

    The lines of a batch run in lockstep, filled up to the longest; filled
    steps have no features and no gradient.
    """
    name: dict[str, int] = {}
    most = max((len(fs) for feats, _ in samples for fs in feats), default=1)
    rows = []
    for feats, tags in samples:
        # place 0 is no feature
        ids = np.array([[name.setdefault(f, len(name) + 1) for f in fs] + [0] * (most - len(fs)) for fs in feats])
        rows.append((ids, np.array(tags), np.array(["g0" in fs for fs in feats])))
    emit, move = np.zeros((len(name) + 1, 3)), np.zeros((3, 3))
    bar = np.zeros((3, 3))
    bar[OUTSIDE, INSIDE] = -1e9
    order, rng = list(range(len(rows))), random.Random(seed)
    for epoch in range(epochs):
        rng.shuffle(order)
        step = rate / (1 + epoch)
        for first in range(0, len(order), batch):
            part = [rows[k] for k in order[first : first + batch]]
            size = np.array([len(t) for _, t, _ in part])
            n = int(size.max())
            real = np.arange(n) < size[:, None]
            at, tags, apart = np.zeros((len(part), n, most), np.int64), np.zeros((len(part), n), np.int64), np.zeros((len(part), n), bool)
            at[real], tags[real], apart[real] = (np.concatenate([p[k] for p in part]) for k in range(3))
            e = emit[at].sum(axis=2)
            e[apart, INSIDE] -= 1e9
            m = move + bar
            fwd, bwd = np.empty_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for i in range(1, n):
                fwd[:, i] = np.where(real[:, i, None], e[:, i] + _log_sum(fwd[:, i - 1, :, None] + m, 1), fwd[:, i - 1])
            for i in range(n - 2, -1, -1):
                bwd[:, i] = np.where(real[:, i + 1, None], _log_sum(m + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2), 0)
            z = _log_sum(fwd[:, -1], 1)[:, None, None]
            g = -np.exp(fwd + bwd - z)
            np.put_along_axis(g, tags[:, :, None], np.take_along_axis(g, tags[:, :, None], 2) + 1, 2)
            np.add.at(emit, at[real], step * g[real][:, None, :])
            emit[0] = 0
            if n > 1:
                on = real[:, 1:]
                pairs = np.exp(fwd[:, :-1, :, None] + m + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[..., None])
                move -= step * pairs[on].sum(axis=0)
                np.add.at(move, (tags[:, :-1][on], tags[:, 1:][on]), step)
    whole = np.round(emit * SCALE).astype(np.int64)
    blocked = np.round(move * SCALE).astype(np.int64) + np.where(bar < 0, -BAR, 0)
    return Field({f: whole[i] for f, i in name.items() if whole[i].any()}, blocked)


# ------------------------------------------------------------- generated lines


def _word(rng: random.Random) -> str:
    """A made-up word: mostly syllables, some letters in any order."""
    if rng.random() < 0.25:
        word = "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(1, 9)))
    else:
        word = "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiouy") + rng.choice(["", "", "n", "r", "s", "l", "ch", "st"]) for _ in range(rng.choice([1, 1, 2, 2, 2, 3, 3, 4, 6, 9])))
    how = rng.random()
    return word.capitalize() if how < 0.12 else word.upper() if how < 0.16 else word


def _drawn(rng: random.Random, letters: str, lo: int, hi: int) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))


def _with_digit(rng: random.Random, s: str) -> str:
    at = rng.randrange(len(s))
    return s if any(c.isdigit() for c in s) else s[:at] + rng.choice(string.digits) + s[at + 1 :]


def generated_line(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """One line of prose or settings with secrets, of letters alone too, or with words and numbers that are none; and the secrets' places."""
    letters, mixed, low = string.ascii_letters, string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    leads = ["ghp_", "sk-", "xoxb-", "pk_live_", "glpat-", "npm_"]
    secret = {
        "hex": lambda: _with_digit(rng, _drawn(rng, "0123456789abcdef", 16, 64)),
        "mixed": lambda: _drawn(rng, mixed, 16, 48),
        "letters": lambda: _drawn(rng, letters, 20, 48),
        "key": lambda: rng.choice(["AKIA", "ASIA"]) + _drawn(rng, string.ascii_uppercase + string.digits, 16, 16),
        "lead": lambda: rng.choice(leads) + _drawn(rng, rng.choice([mixed, letters]), 20, 40),
        "web": lambda: "eyJ" + _drawn(rng, mixed, 20, 40) + "." + _drawn(rng, mixed, 30, 60) + "." + _drawn(rng, mixed + "_-", 20, 43),
        "pass": lambda: _with_digit(rng, _drawn(rng, low, 8, 18)),
        "plain": lambda: _drawn(rng, string.ascii_lowercase, 8, 20),
        "marks": lambda: _drawn(rng, mixed, 3, 7) + rng.choice("@#$%!&*") + _drawn(rng, mixed, 3, 7) + rng.choice(["", rng.choice("@#$%!&*") + _drawn(rng, mixed, 2, 5)]),
    }
    told = ("pass", "plain", "marks")
    harmless = [
        lambda: f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
        lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
        lambda: f"{_word(rng)}.{_word(rng)}{rng.randint(1, 999)}@{_word(rng)}{rng.choice(['.com', '.example.org'])}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(1, 99999)}{rng.choice(['', '.', ',', '%', ')', '.' + str(rng.randint(0, 99))])}",
        lambda: "".join(rng.choice(string.digits) for _ in range(rng.randint(8, 19))),
        lambda: "-".join(str(rng.randint(1000, 9999)) for _ in range(rng.randint(2, 5))),
        lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}",
        lambda: f"https://{_word(rng)}.com/{_word(rng)}/{rng.randint(1, 9999)}?page={rng.randint(1, 9)}",
        lambda: f"{_word(rng)}{rng.randint(1, 99)}",
        lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02}",
        lambda: f"{_word(rng)} = {rng.randint(0, 9999)}",
        lambda: f"{rng.choice(['token', 'password', 'secret', 'key'])} {rng.choice(['of', 'is', 'for', 'was'])} {_word(rng)} {rng.randint(1, 99)}",
        lambda: f"the {rng.choice(['token', 'password', 'secret', 'auth'])} {_word(rng)} {_word(rng)}{rng.choice(['.', ',', ''])}",
        lambda: f"{rng.choice(['token', 'password', 'Secret', 'credential', 'bearer'])} {rng.choice(['of', 'is', 'for', 'was', 'and'])} {rng.choice([str.lower, str.capitalize])(''.join(_word(rng) for _ in range(rng.randint(2, 5))))}",
        lambda: "".join(_word(rng).capitalize() for _ in range(rng.randint(2, 5))),
        lambda: rng.choice("_-/.").join(_word(rng) for _ in range(rng.randint(2, 6))),
        lambda: "".join(_word(rng) for _ in range(rng.randint(2, 4))).lower(),
        lambda: f"{_word(rng)}{rng.choice(['é', 'ü', 'ß', 'ñ', 'ø', 'ł'])}{_word(rng)}",
        lambda: rng.choice([str.lower, str.upper, str.capitalize])("".join(rng.choice(["tion", "ent", "a", "qu", "ich", "sch", "o", "ment", "é", "ê", "ö", "ó", "ñ", "í"]) for _ in range(rng.randint(2, 9)))),
        lambda: "".join(rng.choice("가나다라마바사한글日本語中文") for _ in range(rng.randint(2, 9))),
        lambda: rng.choice(["=", "-", "*", "#", "."]) * rng.randint(3, 40),
        lambda: f"{rng.choice(['<', '[', '('])}{_word(rng)}{rng.choice(['>', ']', ')'])}",
        lambda: " ".join(_word(rng).upper() + rng.choice(["!!", "!", "?", "$$$", "&&&"]) for _ in range(rng.randint(1, 5))),
        lambda: rng.choice("$&%#@!*") * rng.randint(1, 3) + _word(rng) + rng.choice("$&%#@!*") * rng.randint(1, 3),
    ]
    text, spans = " ".join(_word(rng) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(0, 8))), []
    for _ in range(rng.randint(1, 3)):
        text += " " if text else ""
        if rng.random() < 0.6:
            text += rng.choice(harmless)()
        else:
            kind = rng.choice(list(secret))
            value = secret[kind]()
            name = rng.choice(["password", "token", "secret", "api_key", "apikey", "auth", "bearer", "access_key", "credential", "PASSWORD", "Token", "pwd", "passphrase"])
            if kind in told or rng.random() < 0.5:
                quote = rng.choice(["", "", '"', "'"])
                text += name + rng.choice(["=", ": ", " = ", ":"] + [" "] * (kind not in told)) + quote
            else:
                quote = ""
            spans.append((len(text), len(text) + len(value)))
            text += value + quote
        text += " " + " ".join(_word(rng) for _ in range(rng.randint(0, 5)))
    return text, spans


@functools.cache
def trained(lines: int = 3000, seed: int = 11) -> Field:
    """The field that the queries use."""
    rng = random.Random(seed)
    samples = []
    for _ in range(lines):
        line, spans = generated_line(rng)
        raw = line.encode()
        # places in bytes
        spans = [(len(line[:s].encode()), len(line[:e].encode())) for s, e in spans]
        at, found = pieces_of(raw)
        tags = []
        for p in found:
            inside = next(((s, e) for s, e in spans if s <= at and at + len(p.rstrip(SPACE)) <= e), None)
            tags.append(OUTSIDE if inside is None else BEGIN if at == inside[0] else INSIDE)
            at += len(p)
        if found:
            samples.append((features(raw), tags))
    return train(samples)


# ----------------------------------------------------------------------- spans


def field_spans(field: Field, texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each text the byte spans that the field tags as secrets."""
    leads, found = zip(*map(pieces_of, texts), strict=True) if texts else ((), ())
    tags = field.tags(texts, list(found))
    size = np.array([len(p) for p in found], np.int64)
    last = np.cumsum(size)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for k in np.unique(np.searchsorted(last, np.flatnonzero(tags == BEGIN), side="right")).tolist():
        own, pieces = tags[last[k] - size[k] : last[k]], found[k]
        places = leads[k] + np.cumsum([0, *map(len, pieces)])
        for i in np.flatnonzero(own == BEGIN).tolist():
            j = i
            while j + 1 < len(own) and own[j + 1] == INSIDE:
                j += 1
            out[k].append((int(places[i]), int(places[j]) + len(pieces[j].rstrip(SPACE))))
    return out


def find_spans(field: Field, texts: list[bytes | None]) -> list[list[tuple[str, int, int]]]:
    """All spans of each text in code points, by start and then kind: the fixed patterns', and the field's that overlap none of them."""
    plain = [t or b"" for t in texts]
    out = []
    for text, tagged in zip(plain, field_spans(field, plain), strict=True):
        found = sorted(base_spans(text), key=lambda s: s[1])
        starts, ends = [s[1] for s in found], list(accumulate((s[2] for s in found), max))
        for a, b in tagged:
            k = bisect_left(starts, b)
            if not k or ends[k - 1] <= a:
                found.append(("crf", a, b))
        if found and not text.isascii():
            # how many characters begin before each byte
            before = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
            found = [(k, int(before[a]), int(before[b])) for k, a, b in found]
        out.append(sorted(found, key=lambda x: (x[1], KINDS.index(x[0]))))
    return out


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row.

    Places are code points, end exclusive. Null and empty texts have no
    spans; null ids and repeated rows stay; an empty table stays empty.
    Memory grows with the longest text, of which every token is tagged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(("field " + uuid.uuid4().hex, trained()))

    def run(texts: list[bytes | None]) -> dict[str, list]:
        name, field = shared.value
        field = resident(name, lambda: field)
        return {"spans": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in found] for found in find_spans(field, texts)]}

    return map_texts(id_text(docs, id_col, text_col), run, [T.StructField("spans", SPAN)], piece_bytes=2_000_000)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every span, and every union of overlapping spans, replaced by a mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row with its secrets replaced in text_col; other columns stay. A null text stays null, an empty table empty."""
    shared = docs.sparkSession.sparkContext.broadcast(("field " + uuid.uuid4().hex, trained()))

    def run(texts: list[bytes | None]) -> dict[str, list]:
        name, field = shared.value
        field = resident(name, lambda: field)
        return {"__clean": [None if t is None else redacted(t.decode(), spans) if spans else t.decode() for t, spans in zip(texts, find_spans(field, texts), strict=True)]}

    made = map_texts(docs.withColumn("__scan", F.col(text_col)).drop(text_col), run, [T.StructField("__clean", T.StringType())], "__scan", piece_bytes=2_000_000)
    return made.select(*(F.col("__clean").alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Secret spans of all documents, with counts and a digest of the fixed patterns' spans."""
    from inkfold.llm.common import documents

    found = scan_documents(documents(spark, sf_dir))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("crf").alias("n_crf"))
