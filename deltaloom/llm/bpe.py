"""Byte-pair encoding and decoding from a tokenizer file, by a backtracking encoder.

A word's tokens are taken greedily, the longest first, as an Aho-Corasick pass over the word found them at
every place. Each next token is checked against the last one in a table of pairs: a pair is compatible if
encoding both strings as one would have kept the border between them, which the merges' order decides. If
no token fits, the last one is taken back and the place is marked, so that no place is tried twice with the
same token. The outcome is what applying the merges in their order gives, in time linear in the word.

A text is cut at white space; what a piece between white space encodes to depends on nothing around it, so
each worker keeps the results of the first `remembered` different pieces, and as many words, that it has seen.
Decoding looks tokens up in one blob of bytes by a table of offsets.

Characters that Python's Unicode tables do not know yet are folded, and parted into words, by the tokenizers
library, whose tables are newer.

Supports tokenizer files with byte-level BPE: an optional normalizer of NFC, white space and lower case
with a split pattern and word ends (`</w>`), and added tokens, which are found in raw text.

Defined results: a null text is an empty one and has no tokens; texts of any length are encoded whole;
repeated rows stay rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import map_rows

#: Added to the last character of a word that ends in the end-of-word mark, which makes it one unit.
ENDED = 0x1000
#: The characters that byte-level BPE shows as themselves, as ranges of bytes.
SHOWN = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
#: White space to str.split() but not to tokenizer patterns.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [b for lo, hi in SHOWN for b in range(lo, hi + 1)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(shown)))
    return [out[b] for b in range(256)]


def _unassigned(c: str) -> bool:
    return unicodedata.category(c) == "Cn"


class Encoder:
    """The tables of one tokenizer file. piece(s) gives the ids of a piece of text without white space."""

    def __init__(self, path: str, remembered: int = 200_000):
        self.path = path
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        steps = str(spec.get("normalizer") or "")
        self.nfc, self.lower = "'NFC'" in steps, "'Lowercase'" in steps
        split = next((p["pattern"]["Regex"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        if split is None:
            raise ValueError(f"{path}: only files that split by a pattern and drop white space are supported here")
        self.pattern = regex.compile(split)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.byte_chars = byte_characters()
        self._build(model["merges"])
        strings = {i: s for s, i in {**self.vocab, **self.specials}.items()}
        self.offsets = np.zeros(max(strings) + 2, np.int64)
        blob = bytearray()
        for i in range(len(self.offsets) - 1):
            self.offsets[i] = len(blob)
            blob += strings.get(i, "").encode("utf-8")
        self.offsets[-1] = len(blob)
        self.blob = bytes(blob)
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.remembered = remembered
        self.memo: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, list[int]] = {}

    def _units(self, token: str) -> str:
        """The token as a string of units: one character each, the last one moved if a word ends there."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + ENDED)
        return token

    def _build(self, merges: list) -> None:
        self.rank: dict[tuple[str, str], int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.order: dict[str, int] = {}
        for k, merge in enumerate(merges):
            a, b = map(self._units, merge if isinstance(merge, list) else merge.split(" "))
            self.rank.setdefault((a, b), k)
            if a + b not in self.halves:
                self.halves[a + b], self.order[a + b] = (a, b), k
        self.ids = {self._units(t): i for t, i in self.vocab.items()}
        usable = {u for u in self.ids if len(u) == 1 or u in self.halves}
        self.finder = ahocorasick.Automaton()
        for u in usable:
            self.finder.add_word(u, len(u))
        self.finder.make_automaton()
        self.shorter = {u: next((u[:n] for n in range(len(u) - 1, 0, -1) if u[:n] in usable), None) for u in usable}
        self.pairs: dict[tuple[str, str], bool] = {}

    def compatible(self, a: str, b: str) -> bool:
        """Whether a border between the tokens a and b stays when their strings are encoded together. Of the
        two, the later merge is undone again and again, down to single units; the border goes if what then
        touches it could merge before the merge undone last."""
        if (known := self.pairs.get((a, b))) is not None:
            return known
        left, right, limit = a, b, len(self.rank) * 2 + 1
        ok = True
        while True:
            # Each merge counts twice: on the left of the border an equal merge comes first.
            if (r := self.rank.get((left, right))) is not None and 2 * r < limit:
                ok = False
                break
            l, r = self.order.get(left, -1), self.order.get(right, -1)
            if l < 0 and r < 0:
                break
            if l > r:
                limit, left = 2 * l, self.halves[left][1]
            else:
                limit, right = 2 * r + 1, self.halves[right][0]
        if len(self.pairs) < 500_000:
            self.pairs[a, b] = ok
        return ok

    def word(self, units: str) -> list[str]:
        """The tokens of one string of units."""
        n = len(units)
        longest = [1] * n
        for end, size in self.finder.iter(units):
            if size > longest[end - size + 1]:
                longest[end - size + 1] = size
        out: list[str] = []
        dead = bytearray(n + 1)
        at, token = 0, units[: longest[0]] if n else None
        while at < n:
            while token is not None and (dead[at + len(token)] or out and not self.compatible(out[-1], token)):
                token = self.shorter.get(token)
            if token is not None:
                out.append(token)
                at += len(token)
                token = units[at : at + longest[at]] if at < n else None
            else:
                if not out:
                    raise ValueError("no tokens for a unit")
                dead[at] = 1
                last = out.pop()
                at -= len(last)
                token = self.shorter.get(last)
        return out

    def _unit_ids(self, units: str) -> list[int]:
        """The ids of one word in the characters that stand for its bytes."""
        if self.suffix:
            units = units[:-1] + chr(ord(units[-1]) + ENDED)
        return [self.ids[t] for t in self.word(units)]

    def _word_ids(self, word: str) -> list[int]:
        if (known := self.words.get(word)) is not None:
            return known
        out = self._unit_ids("".join([self.byte_chars[b] for b in word.encode("utf-8", "surrogatepass")]))
        if len(self.words) < self.remembered:
            self.words[word] = out
        return out

    def _plain(self, s: str) -> list[int]:
        if not s.isascii() and any(map(_unassigned, s)):
            return self._cut_by_library(s)
        if self.nfc and not s.isascii():
            s = unicodedata.normalize("NFC", s)
        if self.lower:
            s = s.replace("Σ", "σ").lower()  # each letter by itself: no final form
        return [i for m in self.pattern.finditer(s) for i in self._word_ids(m.group())]

    @functools.cached_property
    def library(self):
        """The tokenizers library's own normalizer and pre-tokenizer of the file."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _cut_by_library(self, s: str) -> list[int]:
        """For characters that are newer than Python's tables: the library folds and cuts, the words are
        encoded here all the same."""
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(s))
        return [i for units, _ in words for i in self._unit_ids(units)]

    def piece(self, s: str) -> tuple[int, ...]:
        if self.special and "<" in s and self.special.search(s):
            return tuple(i for k, part in enumerate(self.special.split(s)) for i in ([self.specials[part]] if k % 2 else self._plain(part)))
        return tuple(self._plain(s))

    def pieces(self, text: str) -> list[str]:
        """The text cut at its white space."""
        return regex.split(r"\s+", text) if any(c in text for c in ODD_SPACE) else text.split()

    def encode(self, text: str) -> list[int]:
        memo = self.memo
        out: list[int] = []
        for s in self.pieces(text):
            if (ids := memo.get(s)) is None:
                ids = self.piece(s)
                if len(memo) < self.remembered:
                    memo[s] = ids
            out += ids
        return out

    def token_bytes(self, i: int) -> bytes:
        return self.blob[self.offsets[i] : self.offsets[i + 1]]

    def decode(self, ids: list[int]) -> str:
        """What the ids stand for: token strings parted by spaces, as files without a decoder have it, or
        bytes joined and read as UTF-8."""
        parts = [self.token_bytes(i) for i in ids]
        if not self.byte_decoder:
            return b" ".join(parts).decode("utf-8")
        back = {c: b for b, c in enumerate(self.byte_chars)}
        return bytes(back[c] for p in parts for c in p.decode("utf-8")).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str, remembered: int = 200_000) -> Encoder:
    """One encoder per worker process; its tables and memory live on from task to task."""
    return Encoder(path, remembered)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, token_ids): the tokens of every whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(path)
        ids = [np.array(coder.encode(t or ""), np.int32) for t in batch.column(1).to_pylist()]
        sizes = np.array([len(x) for x in ids], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists], ["id", "n_tokens", "token_ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, token_ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "id", ids_col: str = "token_ids") -> DataFrame:
    """(id, decoded) from arrays of token ids; null arrays decode to an empty text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["id", "decoded"])

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_rows(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, decoded string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encode() and decode() without token arrays between
    stages: per piece of text, its ids in decimal and its decoded bytes are kept beside its ids."""
    import hashlib

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(path)
        if coder.byte_decoder:
            raise ValueError("pieces of byte-level texts don't decode one by one")
        memo = coder.__dict__.setdefault("digest_memo", {})
        sizes, ids_out, text_out = [], [], []
        for text in batch.column(1).to_pylist():
            rows = []
            for s in coder.pieces(text or ""):
                if (row := memo.get(s)) is None:
                    ids = coder.piece(s)
                    row = (len(ids), b" ".join([b"%d" % i for i in ids]), b" ".join([coder.token_bytes(i) for i in ids]))
                    if len(memo) < coder.remembered:
                        memo[s] = row
                if row[0]:
                    rows.append(row)
            sizes.append(sum([r[0] for r in rows]))
            ids_out.append(hashlib.sha256(b" ".join([r[1] for r in rows])).hexdigest())
            text_out.append(hashlib.sha256(b" ".join([r[2] for r in rows])).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_out), pa.array(text_out)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
