"""Byte-pair encoding and decoding by speculation and verification.

Words that are new to a worker are encoded together. A greedy longest-match
pass proposes tokens, and one vectorised check over the token merge trees
tests every adjacent pair: if no pair could have merged across its border,
the proposal is the encoding. Only words with a failing pair are merged
exactly. Encoded words are kept in a bounded table, so a text costs one
split and one look-up per word.

The tokenizer file is a parameter; it is read by the driver and broadcast
(its size is that of a vocabulary, not of the data). The results are those of
the tokenizers library with the same file.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_hexdigest

from inkfold.llm.common import id_text, map_texts, resident

#: Words that a worker keeps encoded; beyond, the table starts anew.
KEPT_WORDS = 200_000
#: Marks the end of a word inside the matcher; no word holds a line feed.
END = "\n"
NEVER = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _class(kind: str) -> str:
    """Code points under U+0300 of a general category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == kind)


#: White space of the tokenizer's regular expressions, under U+0300.
BLANK = "\t\n\x0b\x0c\r \x85\xa0"
#: The normaliser and the splitter that `Bpe.words` stands for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _outside() -> str:
    """Characters under U+0300 whose lower case is not plain: it leaves that range other than by a combining dot."""
    return "".join(chr(c) for c in range(0x300) if any(ord(x) >= 0x300 and x != "\u0307" for x in chr(c).lower()))


class Bpe:
    """A word-level BPE with end-of-word marks, from a tokenizers JSON file's text."""

    def __init__(self, spec: str):
        spec_dict = json.loads(spec)
        model = spec_dict["model"]
        if spec_dict["normalizer"] != NORMALIZER or spec_dict["pre_tokenizer"] != SPLITTER or spec_dict["decoder"] is not None or model["type"] != "BPE":
            raise ValueError("the file has another normaliser, splitter, decoder or model than this encoder")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec_dict["added_tokens"]):
            raise ValueError("added tokens must match as they are written")
        self.spec, self.suffix = spec, model["end_of_word_suffix"]
        to_byte = byte_alphabet()
        self.token_text = {i: t for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec_dict["added_tokens"]}
        self.token_text |= {i: t for t, i in self.added.items()}
        self.added_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        size = max(self.token_text) + 1

        def form(token: str) -> str:
            end = token.endswith(self.suffix) and len(token) > len(self.suffix)
            body = token[: -len(self.suffix)] if end else token
            return "".join(chr(to_byte[c]) for c in body) + (END if end else "")

        self.forms = {i: form(t) for t, i in model["vocab"].items()}
        ids = {f: i for i, f in self.forms.items()}
        self.base = {f: i for f, i in ids.items() if len(f) == 1 or len(f) == 2 and f[1] == END}
        if len(self.base) != 512:
            raise ValueError("the vocabulary lacks single bytes")
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        keys = np.empty(len(merges), np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.rank[z] >= 0 or max(self.rank[x], self.rank[y]) >= r:
                raise ValueError("merges must make each token once, from earlier tokens")
            keys[r], self.left[z], self.right[z], self.rank[z] = x * size + y, x, y, r
            self.merge[x, y] = (r, z)
        order = np.argsort(keys)
        self.size, self.keys, self.key_rank = size, keys[order], order.astype(np.int64)
        self.length = np.array([len(self.forms.get(i, "")) for i in range(size)])
        valid = np.zeros(size, bool)
        valid[list(self.base.values())] = True
        made = np.flatnonzero(self.rank >= 0)
        alone = self._agree(self.left[made], self.right[made], inner=True)
        for z, good in sorted(zip(made.tolist(), alone.tolist(), strict=True), key=lambda p: self.rank[p[0]]):
            valid[z] = good and valid[self.left[z]] and valid[self.right[z]]
        self.matcher = ahocorasick.Automaton()
        for f, i in ids.items():
            if valid[i] and END not in f[:-1] and f != END:
                self.matcher.add_word(f, i)
        self.matcher.make_automaton()
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, bytes] = {}
        letter, number = _class("L"), _class("N")
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{BLANK}{letter}{number}]+")
        self.high = re.compile(f"[{_outside()}\u0300-\U0010ffff]")
        self._library = None

    # ------------------------------------------------------------ verification

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def _agree(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether tokens a, b stay apart side by side: no merge across the border comes before the merges inside.

        The merge trees are undone from the top, the later merge first. At
        each step the two symbols at the border could merge at rank m; they
        would, if m comes before the merge that takes the left symbol away
        (equal ranks: that one is further left and wins) and not after the one
        that takes the right symbol. inner: a and b are the halves of one
        token, whose own merge does not count.
        """
        ok = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        first = inner
        while len(at):
            m = self._pair_rank(x, y)
            bad = np.zeros(len(at), bool) if first else (m < until_x) & (m <= until_y)
            first = False
            ok[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry, until_x, until_y = (v[go] for v in (at, x, y, rx, ry, until_x, until_y))
            undo = rx > ry
            until_x, until_y = np.where(undo, rx, until_x), np.where(undo, until_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    # ---------------------------------------------------------------- merging

    def exact(self, form: str) -> list[int]:
        """Merges in order of rank, leftmost first. form: the word's bytes as characters, with its end mark."""
        body = form.removesuffix(END)
        syms = [self.base[c] for c in body[:-1]] + [self.base[body[-1] + END]]
        n = len(syms)
        if n == 1:
            return syms
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*self.merge[p], i, *p) for i in range(n - 1) if (p := (syms[i], syms[i + 1])) in self.merge]
        heap = [(r, i, x, y, z) for r, z, i, x, y in heap]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or syms[i] != x or j >= n or syms[j] != y:
                continue
            syms[i], alive[j], after[i] = z, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := self.merge.get((syms[a], syms[b]))):
                    heapq.heappush(heap, (m[0], a, syms[a], syms[b], m[1]))
        return [s for s, live in zip(syms, alive, strict=True) if live]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of many words: (ids, ends), where ends[k] is the end of word k in ids; and how many failed verification."""
        forms = [(w if w.isascii() else w.encode().decode("latin-1")) + END for w in words]
        stop = np.cumsum([len(f) for f in forms])
        found = list(self.matcher.iter_long("".join(forms)))
        flat = np.array(found, np.int64).reshape(-1, 2)
        end, ids = flat[:, 0] + 1, flat[:, 1]
        word = np.searchsorted(stop, end, side="left")
        counts = np.bincount(word, minlength=len(forms))
        # the proposal must cover the word without a gap
        begin = end - self.length[ids]
        gap = begin != np.r_[0, end[:-1]]
        failed = np.zeros(len(forms), bool)
        np.logical_or.at(failed, word[gap], True)
        failed |= np.bincount(word, weights=self.length[ids], minlength=len(forms)).astype(np.int64) != np.diff(np.r_[0, stop])
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(ids[inside] * self.size + ids[inside + 1], return_inverse=True)
        clash = ~self._agree(pairs // self.size, pairs % self.size)[back]
        failed[word[inside[clash]]] = True
        if failed.any():
            keep = ~failed[word]
            redo = np.flatnonzero(failed)
            merged = [self.exact(forms[k]) for k in redo.tolist()]
            counts[redo] = [len(m) for m in merged]
            ends = np.cumsum(counts)
            out = np.empty(int(ends[-1]), np.int64)
            fixed = np.repeat(failed, counts)
            out[~fixed] = ids[keep]
            out[fixed] = np.concatenate([np.array(m, np.int64) for m in merged])
            return out, ends, len(redo)
        return ids, np.cumsum(counts), 0

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not in the table."""
        if len(self.ids_of) + len(words) > KEPT_WORDS:
            self.ids_of, self.text_of = {}, {}
        new = sorted(words - self.ids_of.keys())
        for k in range(0, len(new), 50_000):
            run = new[k : k + 50_000]
            ids, ends, _ = self.encode_words(run)
            raw = ids.astype("<u4").tobytes()
            text = [self.token_text[i] for i in ids.tolist()]
            a = 0
            for w, b in zip(run, ends.tolist(), strict=True):
                self.ids_of[w] = raw[4 * a : 4 * b]
                self.text_of[w] = " ".join(text[a:b]).encode()
                a = b

    # -------------------------------------------------------------- splitting

    def words(self, text: str) -> list[str]:
        """The words that the tokenizer's normaliser and splitter make of a text.

        Texts under U+0300 are composed already and need lower case only; for
        others, and for the few characters whose lower case lies beyond, the
        library's own normaliser and splitter decide, as Unicode tables differ
        between versions.
        """
        if text.isascii() or not self.high.search(text):
            return self.pattern.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec)
            self._bytes = {ord(c): b for c, b in byte_alphabet().items()}
        lib = self._library
        return [w.translate(self._bytes).encode("latin-1").decode() for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens, in order; an added token is led by END."""
        if not self.added_pattern or not self.added_pattern.search(text):
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.added_pattern.split(text)):
            out += [END + part] if k % 2 else self.words(part)
        return out

    def encode(self, texts: list[bytes | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids (little-endian unsigned 32-bit) and decoded texts (UTF-8); null is an empty text."""
        split = [self.pieces((t or b"").decode()) for t in texts]
        self.learn({w for w in set().union(*split) if w[0] != END})
        for t, i in self.added.items():
            self.ids_of[END + t], self.text_of[END + t] = np.array([i], "<u4").tobytes(), t.encode()
        ids, text = self.ids_of.__getitem__, self.text_of.__getitem__
        return [b"".join(map(ids, p)) for p in split], [b" ".join(map(text, p)) for p in split]

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode(): the file has no decoder, so tokens are joined with spaces; unknown ids are left out."""
        return " ".join(self.token_text[i] for i in ids.tolist() if i in self.token_text)


def loaded(spec: str) -> Bpe:
    """One instance a worker."""
    return resident("bpe " + xxh3_128_hexdigest(spec), lambda: Bpe(spec))


def default_path() -> str:
    """The public word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True, keep: bool = False) -> DataFrame:
    """Adds ids (binary: little-endian unsigned 32-bit) and, if wanted, decoded (binary: UTF-8) to each row.

    Null and empty texts: no ids, empty decoded text. Null ids and repeated
    rows stay; an empty table stays empty. keep: all other columns are kept,
    but for those named like the new ones, which are replaced; else doc_id
    only. Texts that spell an added token give that token's id, as in the
    library. A file with another normaliser or splitter is refused.
    """
    with open(path or default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(texts: list[bytes | None]) -> dict[str, list]:
        ids, text = loaded(spec.value).encode(texts)
        return {"ids": ids, "decoded": text}

    if keep:
        docs, text_col = docs.withColumn("__text", F.col(text_col)), "__text"
    else:
        docs, text_col = id_text(docs, id_col, text_col), "text"
    fields = [T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.BinaryType())] * decoded]
    return map_texts(docs, run, fields, text_col, piece=1000, piece_bytes=2_000_000)


def decode_documents(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (string) to rows with ids (binary, as from encode_documents), in place of a column of that name; null ids decode to an empty text."""
    with open(path or default_path(), encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(rows: list[bytes | None]) -> dict[str, list]:
        bpe = loaded(spec.value)
        return {"decoded": [bpe.decode(np.frombuffer(r or b"", "<u4")) for r in rows]}

    return map_texts(encoded.withColumn("__ids", F.col(ids_col)), run, [T.StructField("decoded", T.StringType())], "__ids")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of all documents."""
    from inkfold.llm.common import documents

    made = encode_documents(documents(spark, sf_dir))
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
