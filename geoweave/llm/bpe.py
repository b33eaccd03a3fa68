r"""BPE encoding and decoding with a contiguous rank array (op9).

A word is held as two arrays: the ids of its parts, and beside each part the rank of merging it with the next (NONE if no merge has it).
The least rank is found by a scan, its boundary is deleted, and only the two neighbouring ranks are looked up again. For short words,
nearly all, this beats a heap or a linked list. Words of over LONG bytes would take quadratic time and are merged with a heap over linked
parts, in the same order. Encoded words are remembered in a table of bounded size.

Splitting and lower-casing follow Python's Unicode tables, with the letters that Unicode 16.0 and 17.0 added as the library sees them.

The vocabulary file is a parameter (the JSON of the tokenizers library). Supported: BPE without continuing prefix, an optional end-of-word
suffix, byte-level alphabets, NFC and lower-case normalisers, one split pattern, special tokens matched in the raw text.

Edge cases: null text is empty; empty text has no tokens and decodes to ""; a text's special-token strings become their ids; repeated
rows and null doc_ids give a row each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table, texts

NONE = 1 << 60
CACHE_WORDS = 60_000
#: Bytes of the longest word that is merged by scans; longer ones take a heap, with the same result.
LONG = 256
#: White_Space of Unicode, as the library's patterns see `\s` (Python's has four more).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [char[b] for b in range(256)]


#: Letters and digits that Unicode 16.0 added, which the library's pattern classes know (first, last).
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
#: Lower-case letters of Unicode 16.0 and 17.0 that Python's tables may lack (first upper, last upper, first lower).
LOWER_NEW = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
STAND_IN = "\ue000"  # neither a letter nor a digit nor white space


def newer_letters(known=()) -> str:
    """A class of the letters and digits that Python's Unicode tables leave unassigned and `regex` knows, without those in `known`."""
    every = "".join(map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))))
    ranges: list[list[int]] = []
    for c in map(ord, regex.findall(r"[\p{L}\p{N}]", every)):
        if unicodedata.category(chr(c)) == "Cn" and not any(a <= c <= b for a, b in known):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]" if ranges else r"(?!)"


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.tokens[i] = t
        self.alphabet = byte_alphabet()
        self.start = [vocab.get(c, -1) for c in self.alphabet]
        self.last = [vocab.get(c + self.suffix, -1) for c in self.alphabet]
        self.rank: dict[int, tuple[int, int]] = {}  # left << 32 | right -> rank, merged id
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a] << 32 | vocab[b]] = (r, vocab[a + b])
        kinds, pattern = self._steps(spec)
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.newer = re.compile(newer_letters()).search
        self.hide = re.compile(newer_letters(UNICODE_16)).sub
        self.lower_new = {a + i: c + i for a, b, c in LOWER_NEW for i in range(b - a + 1)}
        self.pattern = regex.compile(pattern.replace(r"\s", WHITE))
        self.find = self.pattern.findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _steps(spec: dict) -> tuple[set[str], str]:
        norm = spec.get("normalizer") or {}
        kinds = {n["type"] for n in norm.get("normalizers", [norm] if norm else [])}
        pre = spec["pre_tokenizer"]
        split = [p["pattern"]["Regex"] for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split"]
        if len(split) != 1 or kinds - {"NFC", "Replace", "Lowercase"}:
            raise ValueError("unsupported tokenizer file")
        return kinds, split[0]

    def merge(self, data: bytes) -> list[int]:
        """The ids of one word's bytes."""
        ids = [self.start[b] for b in data]
        ids[-1] = self.last[data[-1]]
        rank = self.rank
        none = (NONE, 0)
        ranks = [rank.get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best[0] == NONE:
                break
            i = ranks.index(best)
            ids[i] = best[1]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] << 32 | ids[i], none)
        return ids

    def merge_long(self, data: bytes) -> list[int]:
        """The same for a long word, whose scans would be quadratic: a heap of (rank, place) over linked parts; equal ranks left to right."""
        ids = array("q", [self.start[b] for b in data])
        n = len(ids)
        ids[n - 1] = self.last[data[-1]]
        rank, none = self.rank, (NONE, 0)
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [r << 40 | i for i, r in enumerate(rank.get(a << 32 | b, none)[0] for a, b in zip(ids, ids[1:])) if r != NONE]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & (1 << 40) - 1
            j = after[i] if ids[i] >= 0 else n
            if j >= n:
                continue
            r, merged = rank.get(ids[i] << 32 | ids[j], none)
            if r != top >> 40:  # an older entry: one of the parts has changed since
                continue
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(merged << 32 | ids[k], none)[0]
                if r != NONE:
                    heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0:
                r = rank.get(ids[h] << 32 | merged, none)[0]
                if r != NONE:
                    heappush(heap, r << 40 | h)
        return [x for x in ids if x >= 0]

    def _words(self, text: str) -> list[str]:
        """Normalised words of a text that has letters newer than Python's tables: those that the pattern's classes don't know stand aside."""
        if self.lower:
            text = text.translate(self.lower_new)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.hide(STAND_IN, text))]

    def _plain(self, text: str) -> list[bytes]:
        newer = False
        if not text.isascii():
            newer = not _latin(text) and self.newer(text)
            if self.nfc:
                text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        known, out = self.known, []
        for w in self._words(text) if newer else self.find(text):
            x = known.get(w)
            if x is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                data = w.encode()
                x = np.array(self.merge(data) if len(data) <= LONG else self.merge_long(data), "<u4").tobytes()
                if len(w) <= 64:
                    known[w] = x
            out.append(x)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        parts = self.cut(text or "") if self.cut else [text or ""]
        out: list[bytes] = []
        for i, p in enumerate(parts):
            out += [np.array([self.special[p]], "<u4").tobytes()] if i % 2 else self._plain(p) if p else []
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        """The tokens joined by a space, as the library does for files without a decoder."""
        return " ".join(map(self.tokens.__getitem__, np.asarray(ids).tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids of every row."""
    path = path or default_path()

    def make():
        bpe = load(path)
        return lambda x: {"doc_id": x["doc_id"], "ids": [bpe.encode(t).astype(np.int32) for t in x["text"]]}

    return map_rows(texts(docs), make, "doc_id long, ids array<int>")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids."""
    path = path or default_path()

    def make():
        bpe = load(path)

        def rows(x):
            out = {"doc_id": x["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in x["text"]:
                ids = bpe.encode(t)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return out

        return rows

    return map_rows(texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLE: dict[str, str] = {}
