"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words, and the beginnings of its longer ones, hashed into `buckets`;
each counts once. The score is the logistic of a bias, a weight per term, and the inner product of the two
factors of every pair of terms, so a pair can count for more than the sum of its terms. Weights and factors
are learned by AdaGrad on a sample of labelled rows of at most `sample` documents - all of them where there
are fewer, else those of least hash. Training texts never leave the executors: the sample's terms are counted
there, by label, and only the terms of the model are gathered, at most `terms_kept` for a document. Those are
the terms whose counts in toxic and other documents differ more than chance would have it - of largest
likelihood-ratio statistic, at least `least_gain` - and those that differ so among the documents that have
one of the `leaders` foremost terms: a term that means nothing alone, and much beside another.

Defined results: a null or wordless text scores by the bias alone; null labels, and labels without a
document, teach nothing; repeated rows stay rows; without two classes of labels the bias alone is learned;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import Shared, map_rows, stash

WORD = regex.compile(r"\w+")
#: Lengths of the beginnings that count as terms of longer words.
HEADS = (3, 4, 5, 6)
REMEMBERED = 150_000
#: Documents that must have both terms of a pair for it to tell anything.
SUPPORT = 3


def hashed(piece: str, buckets: int) -> list[int]:
    """The buckets of the terms in a piece of text without white space."""
    out = []
    for w in WORD.findall(piece):
        out += [w, *(f"{w[:n]}\x00" for n in HEADS if len(w) > n)]
    return [xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % buckets for w in out]


def terms(text: str | None, buckets: int) -> np.ndarray:
    """The different buckets of a text's terms, ascending."""
    pieces = set((text or "").lower().split())
    return np.array(sorted({b for piece in pieces for b in hashed(piece, buckets)}), np.int32)


@dataclass
class Machine:
    """bias; weight and factors of each bucket."""

    buckets: int
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.memo: dict[str, tuple[int, ...]] = {}

    def margin(self, ids: np.ndarray) -> float:
        v = self.factors[ids]
        both = v.sum(axis=0)
        return float(self.bias + self.weight[ids].sum() + 0.5 * (both @ both - np.einsum("ij,ij->", v, v)))

    def active(self, text: str | None) -> np.ndarray:
        """The text's different buckets that the model has; each worker remembers the pieces it has seen."""
        memo, found = self.memo, set()
        for piece in (text or "").lower().split():
            if (own := memo.get(piece)) is None:
                own = tuple(b for b in hashed(piece, self.buckets) if self.weight[b])
                if len(memo) < REMEMBERED:
                    memo[piece] = own
            if own:
                found.update(own)
        return np.array(sorted(found), np.int64)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(self.active(text)), -40, 40))))


def gains(yes: np.ndarray, no: np.ndarray, p: np.ndarray | float, n: np.ndarray | float) -> np.ndarray:
    """The likelihood-ratio statistic of presence against the label, from the p toxic and n other documents
    and how many of each have the term."""
    share = (yes + no) / np.maximum(p + n, 1)
    part = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    return 2 * (part(yes, p * share) + part(no, n * share) + part(p - yes, p * (1 - share)) + part(n - no, n * (1 - share)))


def foremost(buckets: np.ndarray, yes: np.ndarray, no: np.ndarray, p: float, n: float, least_gain: float, most: int) -> np.ndarray:
    """The buckets of largest gain, the best first, from their counts."""
    if not 0 < p < p + n or not len(buckets):
        return np.zeros(0, np.int64)
    gain = gains(yes.astype(float), no.astype(float), p, n)
    order = np.lexsort((buckets, -gain))[:most]
    return buckets[order[gain[order] >= least_gain]].astype(np.int64)


def pair_counts(lists: list[np.ndarray], toxic: np.ndarray, leaders: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, yes, no): how many toxic and other documents have a leader and another term; a key is the
    leader's place times buckets, and the term. The leader's own key counts the documents that have it."""
    place = {int(b): k for k, b in enumerate(leaders)}
    keys = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for own, y in zip(lists, toxic, strict=True):
        for b in own:
            if (k := place.get(int(b))) is not None:
                keys[int(y)].append(k * buckets + own.astype(np.int64))
    every, back = np.unique(np.concatenate([*keys[1], *keys[0]]), return_inverse=True)
    is_yes = np.arange(len(back)) < sum(map(len, keys[1]))
    return every, np.bincount(back[is_yes], minlength=len(every)), np.bincount(back[~is_yes], minlength=len(every))


def beside(keys: np.ndarray, yes: np.ndarray, no: np.ndarray, leaders: np.ndarray, buckets: int, least_gain: float, most: int) -> np.ndarray:
    """The terms, the best first, that part toxic from other documents among those with a leader."""
    enough = yes + no >= SUPPORT
    keys, yes, no = keys[enough], yes[enough], no[enough]
    leader, term = keys // buckets, keys % buckets
    own = term == leaders[leader]
    p, n = np.zeros(len(leaders)), np.zeros(len(leaders))
    p[leader[own]], n[leader[own]] = yes[own], no[own]
    gain = gains(yes.astype(float), no.astype(float), p[leader], n[leader])
    order = np.lexsort((term, -gain))
    order = order[(gain[order] >= least_gain) & ~own[order]]
    return np.array(list(dict.fromkeys(term[order].tolist()))[:most], np.int64)


def chosen_terms(lists: list[np.ndarray], toxic: np.ndarray, buckets: int, least_gain: float = 16.0, terms_kept: int = 4096, leaders: int = 32, pair_gain: float = 24.0) -> np.ndarray:
    """The model's terms from term lists: what fit() finds by counts on the executors."""
    count = lambda which: np.bincount(np.concatenate([np.zeros(0, np.int32), *(x for x, t in zip(lists, toxic, strict=True) if t == which)]), minlength=buckets)
    single = foremost(np.arange(buckets), count(1), count(0), float(toxic.sum()), float(len(toxic) - toxic.sum()), least_gain, terms_kept)
    first = single[:leaders]
    pairs = beside(*pair_counts(lists, toxic, first, buckets), first, buckets, pair_gain, terms_kept)
    return np.array(list(dict.fromkeys([*single.tolist(), *pairs.tolist()]))[:terms_kept], np.int64)


def train(lists: list[np.ndarray], toxic: np.ndarray, buckets: int, used: np.ndarray | None = None, factors: int = 8, epochs: int = 15, rate: float = 0.2, decay: float = 1e-4, seed: int = 11, **choice) -> Machine:
    """Learns from term lists and 0/1 labels with the terms of used (chosen from the lists if there is none).
    Shuffling and first factors come from the seed."""
    rng = np.random.default_rng(seed)
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(buckets, np.float32), np.zeros((buckets, factors), np.float32)
    if not 0 < toxic.sum() < len(toxic):
        return Machine(buckets, bias, w, v)
    if used is None:
        used = chosen_terms(lists, toxic, buckets, **choice)
    used = np.sort(used)
    if not len(used):
        return Machine(buckets, bias, w, v)
    chosen, place = np.zeros(buckets, bool), np.zeros(buckets, np.int64)
    chosen[used], place[used] = True, np.arange(len(used))
    lists = [place[x[chosen[x]]] for x in lists]
    wu, vu = np.full(len(used), 1e-6), rng.normal(0, 0.01, (len(used), factors))
    gw, gv, gb = np.full(len(used), 1e-3), np.full((len(used), factors), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(lists))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            sizes = np.array([len(lists[k]) for k in some])
            ids = np.concatenate([lists[k] for k in some])
            row = np.repeat(np.arange(len(some)), sizes)
            own = vu[ids]
            sums = np.zeros((len(some), factors))
            np.add.at(sums, row, own)
            squares = np.bincount(row, (own * own).sum(axis=1), len(some))
            m = bias + np.bincount(row, wu[ids], len(some)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            slope = 1 / (1 + np.exp(-np.clip(m, -40, 40))) - toxic[some]
            found, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, slope[row], len(found)) + decay * len(some) * wu[found]
            each = slope[row][:, None] * (sums[row] - own)
            dv = np.stack([np.bincount(back, each[:, f], len(found)) for f in range(factors)], axis=1) + decay * len(some) * vu[found]
            gw[found] += dw * dw
            gv[found] += dv * dv
            wu[found] -= rate * dw / np.sqrt(gw[found])
            vu[found] -= 0.2 * rate * dv / np.sqrt(gv[found])
            gb += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(gb)
    w[used], v[used] = wu, vu
    return Machine(buckets, bias, w, v)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text has remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", buckets: int = 1 << 18, sample: int = 8_192, least_gain: float = 16.0, terms_kept: int = 4096, leaders: int = 32, pair_gain: float = 24.0, **options) -> Machine:
    """Learns from labelled rows that are not held out. Gathered are counts of at most `buckets` terms, of
    pairs' terms at most `terms_kept`, and for each of `sample` documents the terms it has of `terms_kept`."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [terms(t, buckets).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(lists, pa.binary()), batch.column(0), batch.column(2)], ["terms", "y", "id"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").select("y", "text", "id")  # at most `sample` rows are sent
    taken = stash(map_rows(rows, work, f"terms binary, y int, id {rows.schema['id'].dataType.simpleString()}"), "terms")
    # Ids that repeat bring more rows than the sample has: those of least hash are taken.
    if taken.count() > sample:
        taken = stash(taken.orderBy(F.xxhash64("id"), "id", F.xxhash64("terms"), "terms").limit(sample), "sampled")
    lists_of = lambda batch: [np.frombuffer(x.as_py(), np.int32) for x in batch.column(0)]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, y = lists_of(batch), batch.column(1).to_numpy()
        every, back = np.unique(np.concatenate(lists), return_inverse=True)
        hit = np.repeat(y, [len(x) for x in lists]) == 1
        return pa.RecordBatch.from_arrays([pa.array(every.astype(np.int64)), pa.array(np.bincount(back[hit], minlength=len(every))), pa.array(np.bincount(back[~hit], minlength=len(every)))], ["term", "yes", "no"])

    summed = lambda counts: counts.groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    table_of = lambda counts: tuple(c.to_numpy().astype(np.int64) for c in counts.toArrow().select(["term", "yes", "no"]).columns)
    classes = {r["y"]: r["n"] for r in taken.groupBy("y").agg(F.count("*").alias("n")).collect()}
    p, n = float(classes.get(1, 0)), float(classes.get(0, 0))
    single = foremost(*table_of(summed(map_rows(taken, count, "term long, yes long, no long"))), p, n, least_gain, terms_kept)
    first = single[:leaders]

    def count_pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in pair_counts(lists_of(batch), batch.column(1).to_numpy(), first, buckets)], ["term", "yes", "no"])

    pairs = np.zeros(0, np.int64)
    if len(first):
        counts = summed(map_rows(taken, count_pairs, "term long, yes long, no long"))
        counts = counts.where(F.col("yes") + F.col("no") >= SUPPORT)  # the others are most, and dropped by beside() too
        pairs = beside(*table_of(counts), first, buckets, pair_gain, terms_kept)
    used = np.array(list(dict.fromkeys([*single.tolist(), *pairs.tolist()]))[:terms_kept], np.int64)

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [x[np.isin(x, used)].tobytes() for x in lists_of(batch)]
        return pa.RecordBatch.from_arrays([pa.array(lists, pa.binary()), batch.column(1), batch.column(2)], ["terms", "y", "id"])

    got = map_rows(taken, narrow, taken.schema).collect()
    got.sort(key=lambda r: (repr(r["id"]), bytes(r["terms"]), r["y"]))
    lists = [np.frombuffer(r["terms"], np.int32) for r in got]
    return train(lists, np.array([r["y"] for r in got], float), buckets, used, **options)


def scorer(spark: SparkSession, machine: Machine) -> Callable[[Column], Column]:
    """What gives the score of a column of texts. The model, of buckets x (factors + 1) x 4 bytes, is sent to the workers once."""
    model = Shared(spark, machine)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = model.value
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return lambda text: score(text.cast("string"))
