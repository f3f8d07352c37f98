"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as lower-case code points with white space in one piece each. An item is cut into
overlapping segments of `segment` characters (a shorter item is one); a segment of length m may match with
e = floor(rate * m) edits. By the q-gram lemma, a region that matches shares at least m + 1 - q - q * e of its
q-grams with the segment, all within 2e + 1 neighbouring diagonals, so they meet in one of the bands of
width 2(2e + 1) that overlap by half. The steps, each over whole batches of texts at once:

1. every q-gram of a text, hashed, is looked up in a bitmap of the items' q-grams;
2. places with too few marked q-grams in the length of a region drop out;
3. what is left is joined with the segments' q-grams, and counted per segment and band;
4. bands that reach the bound are verified by an alignment of the segment within the band.

Items below `whole` characters are looked for as they are, with the edits that still leave a shared q-gram
(none below 16 characters), and count only where they stand as whole words; of items below q characters the
q-gram is the whole item.

The items are a query set against all texts. They are read in blocks of `block` items and indexed; up to
`most` bytes of indexes are sent to the workers at once, and the texts are read once for all of them. Larger
sets take one pass over the texts for every `most` bytes, whose results are written before the next begins.

Defined results: null texts and items match nothing, nor do items without a letter or digit; an item given
twice is two items; repeated documents are reported each; an empty table on either side gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from deltaloom.llm.common import Shared, map_rows, stash

BITMAP = 22
#: Marked places worked on at once.
SECTION = 1 << 14
#: Added to diagonals, which may begin before the text does.
SHIFT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """Per code point of the first plane: its lower case (where that is one character), and whether it is white space."""
    every = [chr(c) for c in range(0x10000)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 and not 0xD800 <= ord(c) < 0xE000 else ord(c) for c in every], np.uint32)
    return lower, np.array([c.isspace() for c in every])


def normalize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, and the place of each in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower, space = _folding()
    low = np.minimum(codes, 0xFFFF)
    codes = np.where(codes < 0x10000, lower[low], codes)
    blank = space[low] & (codes < 0x10000)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    place = np.flatnonzero(keep)
    return np.where(blank, np.uint32(32), codes)[place], place


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of q code points."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    out, size, run, width, factor = None, 0, codes.astype(np.uint64), 1, 0x100000001B3
    while True:  # runs of 1, 2, 4, ... are put together as the bits of q have it
        if q & width:
            n = len(codes) - size - width + 1
            out = run if out is None else out[:n] * np.uint64(pow(0x100000001B3, width, 1 << 64)) + run[size : size + n]
            size += width
        if size == q:
            break
        run = run[:-width] * np.uint64(factor) + run[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    out = out * _BASE
    return out ^ (out >> np.uint64(29))


class Segments:
    """One block of items, cut and indexed. words: a match must not begin or end within a word."""

    def __init__(self, items: list[tuple[object, str]], segment: int = 64, rate: float = 0.08, q: int = 8, words: bool = False):
        self.q, self.words = q, words
        codes, item = [], []
        for i, (_, text) in enumerate(items):
            own, _ = normalize(text)
            if len(own) < q:
                continue
            step = segment // 2
            starts = [0] if len(own) <= segment else sorted({*range(0, len(own) - segment, step), len(own) - segment})
            codes += [own[s : s + segment] for s in starts]
            item += [i] * len(starts)
        self.items = [d for d, _ in items]
        self.codes, self.item = codes, np.array(item, np.int64)
        self.length = np.array([len(c) for c in codes], np.int64)
        # No more edits than leave one of the segment's q-grams whole.
        self.edits = np.minimum((rate * self.length).astype(np.int64), (self.length - q) // q)
        self.least = self.length + 1 - q - q * self.edits
        hashes = [grams(c, q) for c in codes]
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(codes)), [len(h) for h in hashes]).astype(np.int64)
        at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.owner, self.at = self.hash[order], owner[order], at[order]
        self.bitmap = np.zeros(1 << BITMAP, bool)
        self.bitmap[self.hash >> np.uint64(64 - BITMAP)] = True

    def __getstate__(self):
        return self.__dict__ | {"bitmap": np.packbits(self.bitmap)}

    def __setstate__(self, state):
        self.__dict__ = state | {"bitmap": np.unpackbits(state["bitmap"]).astype(bool)}

    @property
    def size(self) -> int:
        return self.hash.nbytes + self.owner.nbytes + self.at.nbytes + 4 * int(self.length.sum()) + (1 << BITMAP)

    def _dense(self, marked: np.ndarray) -> np.ndarray:
        """Marked places that have enough marked ones near them for any segment."""
        if not len(marked):
            return marked
        reach = int((self.length + 2 * self.edits).max())
        least = int(self.least.min())
        # Some window of `reach` places around it must have `least` marks: look `least` - 1 marks ahead from
        # each mark of the window's beginning, and spread what is found over the window.
        if len(marked) < least:
            return marked[:0]
        full = marked[least - 1 :] - marked[: len(marked) - least + 1] < reach
        begins = np.flatnonzero(full)
        cover = np.zeros(len(marked) + 1, np.int64)
        ends = np.searchsorted(marked, marked[begins] + reach)
        np.add.at(cover, begins, 1)
        np.add.at(cover, ends, -1)
        return marked[np.cumsum(cover[:-1]) > 0]

    def search(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(segment, begin, end, edits) in codes: the best region of each segment and band."""
        if len(codes) < self.q or not len(self.hash):
            return []
        h = grams(codes, self.q)
        marked = np.flatnonzero(self.bitmap[h >> np.uint64(64 - BITMAP)])
        marked = self._dense(marked)
        if not len(marked):
            return []
        candidates = self._candidates(h, marked)
        found = [x for at in range(0, len(candidates), 512) for x in self._align(codes, candidates[at : at + 512])]
        return [x for x in found if self._apart(codes, x[1], x[2])] if self.words else found

    @staticmethod
    def _apart(codes: np.ndarray, begin: int, end: int) -> bool:
        """Whether neither border of a region is within a word."""
        letter = lambda i: 0 <= i < len(codes) and chr(codes[i]).isalnum()
        return not (letter(begin - 1) and letter(begin)) and not (letter(end - 1) and letter(end))

    def _candidates(self, h: np.ndarray, marked: np.ndarray) -> list[tuple[int, int]]:
        """(segment, band) with enough hits, by sections of the marked places that overlap by a region. A
        band has the diagonals of two halves, so each hit is in two bands."""
        found: set[int] = set()
        reach = int((self.length + 2 * self.edits).max())
        for begin in range(0, len(marked), SECTION):
            last = marked[min(begin + SECTION, len(marked)) - 1]
            some = marked[begin : np.searchsorted(marked, last + reach)]
            lo, hi = np.searchsorted(self.hash, h[some], "left"), np.searchsorted(self.hash, h[some], "right")
            n = hi - lo
            entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            owner = self.owner[entry]
            band = (np.repeat(some, n) - self.at[entry] + SHIFT) // (2 * self.edits[owner] + 1)
            keys = np.concatenate([owner << 40 | band, owner << 40 | (band - 1)])
            own, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
            least = self.least[own >> 40]
            enough = counts >= least
            if not enough.any():
                continue
            for side in (np.repeat(some, n), self.at[entry]):  # different places of the text, and of the segment
                hit = enough[back]
                pairs = np.unique(back[hit] << 32 | np.tile(side, 2)[hit])
                enough &= np.bincount(pairs >> 32, minlength=len(own)) >= least
            found.update(own[enough].tolist())
        return [(k >> 40, k & ((1 << 40) - 1)) for k in sorted(found)]

    def _align(self, codes: np.ndarray, candidates: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Edit distance of each segment to the best region whose alignment stays in its band, for many
        candidates in step. Row r holds, for each diagonal of the band, the least edits that align the first
        r characters; a region may begin at any diagonal. What ends within the edits is a match."""
        own = np.array([s for s, _ in candidates])
        half = 2 * self.edits[own] + 1
        first = np.array([b for _, b in candidates]) * half - SHIFT
        width = int((2 * half).max())
        rows = int(self.length[own].max())
        pad = np.full((len(own), rows), 0xFFFFFFFF, np.uint32)
        for i, s in enumerate(own):
            pad[i, : self.length[s]] = self.codes[s]
        big = 1 << 20
        spread = np.arange(width)
        valid = spread[None, :] < (2 * half)[:, None]
        cost = np.where(valid, 0, big)
        origin = np.broadcast_to(spread, cost.shape).copy()
        best = np.full(len(own), big)
        ends = np.zeros((len(own), 2), np.int64)
        for r in range(rows + 1):
            done = self.length[own] == r
            if done.any():
                for i in np.flatnonzero(done):
                    k = int(cost[i].argmin())
                    best[i] = cost[i, k]
                    ends[i] = first[i] + origin[i, k], first[i] + k + r
            if r == rows:
                break
            at = first[:, None] + spread[None, :] + r
            inside = (at >= 0) & (at < len(codes))
            char = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)], np.uint32(0xFFFFFFFE))
            step = cost + (char != pad[:, r : r + 1])
            step = np.where(inside, step, big)
            up = np.full_like(cost, big)
            up[:, :-1] = cost[:, 1:] + 1  # a segment character with none in the text
            from_up = up < step
            new = np.where(from_up, up, step)
            new_origin = np.where(from_up, np.concatenate([origin[:, 1:], origin[:, -1:]], axis=1), origin)
            for _ in range(int(self.edits[own].max())):  # text characters with none in the segment
                left = np.full_like(new, big)
                left[:, 1:] = new[:, :-1] + 1
                better = left < new
                if not better.any():
                    break
                new = np.where(better, left, new)
                new_origin = np.where(better, np.concatenate([new_origin[:, :1], new_origin[:, :-1]], axis=1), new_origin)
            cost = np.where(valid, np.minimum(new, big), big)
            origin = new_origin
        hit = best <= self.edits[own]
        return [(int(s), max(0, int(b)), min(len(codes), int(e)), int(c)) for s, (b, e), c in zip(own[hit], ends[hit], best[hit], strict=True)]


Match = tuple[object, int, int, int, float]


def indexes(items: list[tuple[object, str]], q: int = 8, whole: int = 40, **options) -> list[Segments]:
    """The items of one block by how they are looked for: in segments, as a whole, or by their own length."""
    kinds: dict[tuple[int, bool], list] = defaultdict(list)
    for i, text in items:
        n = len(normalize(text)[0])
        if any(c.isalnum() for c in text):
            kinds[min(n, q), n < whole].append((i, text))
    return [Segments(own, q=width, words=short, **options) for (width, short), own in sorted(kinds.items(), key=lambda k: k[0])]


def passes(items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", block: int = 4096, most: int = 64 << 20, **options) -> Iterator[list[Shared]]:
    """The items as lists of indexes that are sent to the workers, each list of `most` bytes or one index. The
    driver holds the items of one block, and the indexes of one list."""
    spark = items.sparkSession
    rows = items.select(F.col(item_col), F.col(item_text_col).cast("string")).where(F.col(item_text_col).isNotNull()).toLocalIterator()
    out: list[Shared] = []
    query: list[tuple[object, str]] = []
    size = 0

    def take() -> Iterator[list[Shared]]:
        nonlocal out, size
        for own in indexes(query, **options):
            if out and size + own.size > most:
                yield out
                out, size = [], 0
            out.append(Shared(spark, own))
            size += own.size
        query.clear()

    for r in rows:
        query.append((r[0], r[1]))
        if len(query) == block:
            yield from take()
    yield from take()
    if out:
        yield out


def matches(text: str | None, blocks: list) -> list[Match]:
    """(item, begin, end, edits, share) of each item of which the text has a segment."""
    if not text or not blocks:
        return []
    codes, place = normalize(text)
    out = []
    for segments in (b.value for b in blocks):
        per: dict[int, list] = {}
        for k, begin, end, edits in segments.search(codes):
            per.setdefault(int(segments.item[k]), []).append((begin, end, edits, k))
        for i, hits in sorted(per.items()):
            begin, end = min(h[0] for h in hits), max(h[1] for h in hits)
            share = len({h[3] for h in hits}) / int((segments.item == i).sum())
            out.append((segments.items[i], int(place[min(begin, len(place) - 1)]), int(place[end - 1]) + 1, min(h[2] for h in hits), share))
    return out


def _leaks(text: Column, blocks: list[Shared]) -> Column:
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(matches(t, blocks)) for t in texts], dtype="bool")

    return leaks(text.cast("string"))


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, whose text has no segment of any item."""
    for last, blocks in _marked(passes(items, **options)):
        docs = docs.where(~_leaks(F.col(text_col), blocks))
        if not last:
            docs = stash(docs, "kept")
            for b in blocks:
                b.drop()
    return docs


def _marked(parts: Iterator) -> Iterator[tuple[bool, list]]:
    """Each part and whether it is the last one."""
    held = next(parts, None)
    while held is not None:
        following = next(parts, None)
        yield following is None, held
        held = following


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """(id, item, begin, end, edits, share): for each document and item of which it has a segment, the
    matching part from begin to end in code points of the whole text, the least edits of a segment, and the
    share of the item's segments that were found."""
    item_type = items.schema[item_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item {item_type.simpleString()}, begin int, end int, edits int, share double"

    def search(blocks: list[Shared]) -> DataFrame:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matches(t, blocks)]
            types = [batch.schema.field(0).type, to_arrow_type(item_type), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            cols = zip(*found, strict=True) if found else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "item", "begin", "end", "edits", "share"])

        return map_rows(rows, work, schema)

    out = None
    for last, blocks in _marked(passes(items, item_col, **options)):
        found = search(blocks)
        if not last:
            found = stash(found, "leaks")
            for b in blocks:
                b.drop()
        out = found if out is None else out.unionByName(found)
    return search([]) if out is None else out
