"""Near-duplicates by SimHash fingerprints under a Hamming bound, with generalised pigeonhole probing.

The 64 bits are dealt into partitions, correlated bits together. Partition i gets a threshold t_i with
sum(t_i + 1) = bound + 1, so two fingerprints within the bound differ in at most t_i bits of some partition i.
Number of partitions and thresholds come from dynamic programming on estimated candidate counts: how many
pairs of points lie at each distance in a partition follows from the frequencies of all pairs of bits, which
are counted over all points, along a tree of the partition's most dependent ones; to it comes what the probes
cost. A partition with t_i = -1 is not probed, one with t_i = 0 by equal keys. For larger ones both sides of a
pair go half the way: every point stands under all keys within ceil(t_i / 2) bits of its own, so two points
that differ in at most t_i bits meet. Whatever meets is compared in full.

Equal fingerprints are one point before anything is joined, so exact copies cost nothing. A bucket's
points are verified against each other inside the tasks, which put out a chain of links for each group they
find, never all pairs. A bucket of more than `tile` points is dealt in blocks, and each pair of blocks is a
task's work of its own.

A point may carry a second fingerprint, of longer shingles. It is not probed, but must agree within a bound
of its own: at many bits the first alone would link texts that have little in common. An expected share of
acos(2s / (1 + s)) / pi of its bits differ between texts of which a share s of the shingles is common (Jaccard).

With a similarity, fingerprints only find candidates. The groups they link are taken apart again by the exact
similarity (Jaccard) of the texts' shingle sets: two texts are linked if their fingerprints are within the bounds
and a share of at least `similarity` of their shingles is common. One text stands for each fingerprint, so copies
cost nothing here either; larger groups are dealt in blocks, a pair of blocks to a task, and texts that a task has already joined are not compared again.

Defined results: null or wordless texts have fingerprint 0 and link like any other; texts of fewer words
than a shingle are one shingle; repeated rows stay rows; null ids stay null and never name a component that
has another id; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import connected_components, map_rows, stash

BITS = 64
#: Shingles whose bits are spread out at once; bounds memory on very long texts.
SPREAD = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        hashes = digest(b" ".join(words), 42)
    else:
        hashes = b"".join([digest(b" ".join(t), 42) for t in zip(*(words[i:] for i in range(shingle)), strict=False)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), SPREAD):
        ones += np.unpackbits(rows[at : at + SPREAD], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, check: int | None = None) -> DataFrame:
    """(id, tag, fp, fp2): tag is a hash of the whole text, fp the fingerprint as a signed long, fp2 that of
    shingles of `check` words (zero without)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        marks = lambda n: pa.array(np.array([fingerprint(x, n) if n else 0 for x in texts], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), marks(shingle), marks(check)], ["id", "tag", "fp", "fp2"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    return map_rows(rows, work, "id long, tag long, fp long, fp2 long")


def bit_statistics(points: DataFrame) -> tuple[int, np.ndarray]:
    """Over all points: their number, and for each two bits the share of points in which both are one."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
        both = (bits.T @ bits).astype(np.int64)
        i, j = np.triu_indices(BITS)
        return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[i, j])], ["i", "j", "n"])

    total = points.count()
    both = np.zeros((BITS, BITS))
    for i, j, n in map_rows(points.select("fp"), work, "i int, j int, n long", 1 << 20).groupBy("i", "j").agg(F.sum("n")).collect():  # at most 2080 rows
        both[i, j] = both[j, i] = n
    return total, both / total if total else np.full((BITS, BITS), 0.25) + np.eye(BITS) / 4


def correlations(both: np.ndarray) -> np.ndarray:
    """The bits' correlations (absolute)."""
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the bits into parts of nearly equal width: each part starts at the strongest free pair and takes
    the free bit most correlated with those it has."""
    free = set(range(BITS))
    out = []
    for k in range(parts, 0, -1):
        width = -(-len(free) // k)
        rest = sorted(free)
        first = max(rest, key=lambda b: (max((correlation[b, c] for c in rest if c != b), default=0), -b))
        own = [first]
        while len(own) < width:
            own.append(max(sorted(free - set(own)), key=lambda b: sum(correlation[b, c] for c in own)))
        free -= set(own)
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], bound: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = bound + 1 of least total cost; costs[i][t + 1] is that of t in
    part i. Dynamic programming over parts and what is spent."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, ts) in best.items():
            for t1 in range(bound + 2 - spent):
                if (c := cost + own[t1]) < new.get(spent + t1, (float("inf"),))[0]:
                    new[spent + t1] = (c, [*ts, t1 - 1])
        best = new
    return best[bound + 1][1]


def part_keys(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values of the bits (0 is the most significant) of each fingerprint, as longs."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(BITS - 1 - b)) & np.uint64(1)) << np.uint64(k)
    return out.view(np.int64)


def _masks(width: int, radius: int) -> list[tuple[int, int]]:
    """(mask, bits set) of every change of at most `radius` of `width` bits."""
    return [(sum(1 << b for b in c), r) for r in range(radius + 1) for c in combinations(range(width), r)]


def _keys(points: DataFrame, layout: list[list[int]], radius: list[int]) -> DataFrame:
    """(part, key, fp, fp2): each point under all keys within ceil(t / 2) bits of its own."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        signed, second = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fps = signed.view(np.uint64)
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for i, (bits, t) in enumerate(zip(layout, radius, strict=True)):
            if t < 0:
                continue
            keys = part_keys(fps, bits)
            for r in range((t + 1) // 2 + 1):
                for change in combinations(range(len(bits)), r):
                    mask = np.uint64(sum(1 << b for b in change)).astype(np.int64)
                    for col, x in zip(cols, (np.full(len(fps), i, np.int32), keys ^ mask, signed, second), strict=True):
                        col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["part", "key", "fp", "fp2"])

    return map_rows(points.select("fp", "fp2"), work, "part int, key long, fp long, fp2 long", 1 << 14)


def distances(both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """The odds that two points differ in 0, 1, ... `most` of the bits. Bits hang together in the tree of
    strongest correlations, each depending on the one it hangs on alone; of the pairs of values two points
    can have there, (0, 0), (0, 1), (1, 0), (1, 1), the two in the middle count as a difference."""
    p, strength = np.diag(both), correlations(both)
    parent: dict[int, int | None] = {bits[0]: None}
    while len(parent) < len(bits):
        b, on = max(((b, a) for b in bits if b not in parent for a in parent), key=lambda e: (strength[e], -e[0], -e[1]))
        parent[b] = on
    below = {b: np.zeros((4, most + 1)) for b in bits}  # for each pair of values: the odds of differences under the bit
    for table in below.values():
        table[:, 0] = 1
    for b in reversed(list(parent)):
        own = below[b].copy()  # with the bit's own difference
        own[1:3, 1:], own[1:3, 0] = below[b][1:3, :-1], 0
        on = parent[b]
        if on is None:
            q = np.array([1 - p[b], p[b]])
            return np.outer(q, q).reshape(4) @ own
        joint = np.array([[1 - p[on] - p[b] + both[on, b], p[b] - both[on, b]], [p[on] - both[on, b], both[on, b]]]).clip(0)
        given = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-12)
        under = np.einsum("ac,bd->abcd", given, given).reshape(4, 4) @ own
        below[on] = np.stack([np.convolve(x, y)[: most + 1] for x, y in zip(below[on], under, strict=True)])
    raise ValueError("no bits")


#: What a probe row costs against a comparison of two points: it is made, shuffled and sorted (about 1 us to 20 ns).
ROW_COST = 40.0


def part_costs(both: np.ndarray, bits: list[int], total: int, bound: int) -> list[float]:
    """The cost of thresholds -1 to `bound` in a part: its probe rows, and a comparison for each key at which
    two points meet. Points that differ in d bits meet at as many keys as lie within the radius of both."""
    w = len(bits)
    pairs = distances(both, bits, bound + 1) * total * max(total - 1, 0) / 2
    out = [0.0]
    for t in range(bound + 1):
        r = (t + 1) // 2
        meet = [sum(comb(d, a) * comb(w - d, b) for a in range(d + 1) for b in range(w - d + 1) if max(a, d - a) + b <= r) if d <= w else 0 for d in range(2 * r + 1)]
        out.append(float(sum(m * n for m, n in zip(meet, pairs, strict=False)) + ROW_COST * total * sum(comb(w, k) for k in range(r + 1))))
    return out


def plan_probes(points: DataFrame, bound: int) -> tuple[list[list[int]], list[int]]:
    """The layout of the bits and the threshold of each part: of the layouts of 1 to bound + 2 parts, the one
    whose best thresholds cost least."""
    total, both = bit_statistics(points)
    strength = correlations(both)
    best: tuple[float, list[list[int]], list[int]] | None = None
    for m in range(1, min(bound + 2, BITS) + 1):
        layout = group_bits(strength, m)
        costs = [part_costs(both, bits, total, bound) for bits in layout]
        radius = allocate(costs, bound)
        cost = sum(c[t + 1] for c, t in zip(costs, radius, strict=True))
        if best is None or cost < best[0]:
            best = cost, layout, radius
    return best[1], best[2]


def _groups(fps: np.ndarray, seconds: np.ndarray, start: np.ndarray, size: np.ndarray, bound: int, check: int) -> np.ndarray:
    """A label for each row: rows of one run (start, size of its run) that are linked share one. Pairs at
    growing distance in the run are compared all at once."""
    at = np.arange(len(fps))
    parent = at.copy()
    stop = start + size
    gap = 1
    live = at[at + gap < stop]
    unsigned, second = fps.view(np.uint64), seconds.view(np.uint64)
    while len(live):
        other = live + gap
        ok = np.bitwise_count(unsigned[live] ^ unsigned[other]) <= bound
        a, b = live[ok], other[ok]
        if check < BITS:
            ok = np.bitwise_count(second[a] ^ second[b]) <= check
            a, b = a[ok], b[ok]
        while len(a):
            ra, rb = parent[a], parent[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            np.minimum.at(parent, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
            while not np.array_equal(up := parent[parent], parent):
                parent = up
        gap += 1
        live = live[live + gap < stop[live]]
    return parent


BUCKET = ("part", "key", "lo", "hi")


def _verify(rows: DataFrame, bound: int, check: int) -> DataFrame:
    """Links (u, v) from rows sorted by bucket within their partitions; u and v are point numbers."""

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        part, key, lo, hi, fp, fp2, point = (table.column(c).to_numpy() for c in (*BUCKET, "fp", "fp2", "point"))
        new = np.ones(len(fp), bool)
        new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(fp)))
        for long_ones in (False, True):  # long runs one by one, else each step would pass over all rows
            chosen = np.flatnonzero((length > 256) if long_ones else (length > 1) & (length <= 256))
            for own in [[c] for c in chosen] if long_ones else [chosen] if len(chosen) else []:
                sizes = length[own]
                start = np.repeat(np.cumsum(sizes) - sizes, sizes)
                idx = np.repeat(begin[own], sizes) + np.arange(sizes.sum()) - start
                label = _groups(fp[idx], fp2[idx], start, np.repeat(sizes, sizes), bound, check)
                order = np.argsort(label, kind="stable")
                same = label[order][1:] == label[order][:-1]
                u, v = point[idx][order][:-1][same], point[idx][order][1:][same]
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, BUCKET, 1 << 19):
            yield from links(table)

    return rows.mapInArrow(run, "u long, v long")


def links(points: DataFrame, bound: int = 3, tile: int = 4096, check: int = BITS, plan: tuple[list[list[int]], list[int]] | None = None) -> DataFrame:
    """(u, v) between distinct points (fp, fp2), known by point_of(): whatever is within both bounds is joined
    by a path of them. plan: a layout and thresholds, instead of those of plan_probes()."""
    if "fp2" not in points.columns:
        points = points.withColumn("fp2", F.lit(0).cast("long"))
    layout, radius = plan or plan_probes(points, bound)
    keyed = _keys(points, layout, radius)
    hot = stash(keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile), "hot")
    carried = ("fp", "fp2", point_of().alias("point"))
    if hot.isEmpty():
        rows = keyed.select("part", "key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), *carried)
    else:
        blocks = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        rows = stash(keyed, "keys").join(hot, ["part", "key"], "left")
        rows = rows.select("part", "key", "fp", "fp2", F.pmod(F.xxhash64("fp", "fp2"), blocks).cast("int").alias("own"), other.alias("other"))
        rows = rows.select("part", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *carried)
    buckets = rows.repartition(*BUCKET).sortWithinPartitions(*BUCKET)
    return _verify(buckets, bound, check)


def point_of() -> Column:
    """What a point is known by in links: its fingerprint, or with a second one the hash of both."""
    return F.when(F.col("fp2") == 0, F.col("fp")).otherwise(F.xxhash64("fp", "fp2"))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, ascending."""
    own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    runs = [own] if 0 < len(own) < words else zip(*(own[i:] for i in range(words)), strict=False)
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(b" ".join(t), 42) for t in runs]), np.int64))


def similar_links(texts: DataFrame, words: int, similarity: float, bound: int, check: int, tile: int = 64) -> DataFrame:
    """(u, v) between the points of each group whose texts are alike: texts has (root, point, fp, fp2, text), a
    row per point, root naming the group. A group is dealt in blocks of `tile` texts, of more where that would
    be over 64 blocks, but never of more than 256 times as many: a text stands in as many rows as there are
    blocks."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([shingle_set(t, words) for t in batch.column(4).to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), sets], ["root", "point", "fp", "fp2", "shingles"])

    cut_up = stash(map_rows(texts.select("root", "point", "fp", "fp2", "text"), cut, "root long, point long, fp long, fp2 long, shingles array<long>", 256), "shingles")
    blocks = F.greatest(F.least(F.ceil(F.col("n") / tile), F.lit(64)), F.ceil(F.col("n") / (256 * tile))).cast("int")
    sizes = cut_up.groupBy("root").agg(F.count("*").alias("n"))
    rows = cut_up.join(sizes, "root").where("n > 1").withColumn("own", F.pmod(F.xxhash64("point"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "point", "fp", "fp2", "shingles")
    own_key = ("root", "lo", "hi")

    def links(table: pa.Table) -> pa.RecordBatch:
        key = [table.column(c).to_numpy() for c in own_key]
        point, fps, seconds = (table.column(c).to_numpy() for c in ("point", "fp", "fp2"))
        sets = [x.values.to_numpy() for c in table.column("shingles").chunks for x in c]
        new = np.ones(len(point), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        begin = np.append(np.flatnonzero(new), len(point))
        found = []
        for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            parent = np.arange(lo, hi)  # of each row, the least row it is joined with
            for i in range(lo, hi - 1):
                near = (np.bitwise_count(fps[i + 1 : hi].view(np.uint64) ^ fps[i].view(np.uint64)) <= bound) & (np.bitwise_count(seconds[i + 1 : hi].view(np.uint64) ^ seconds[i].view(np.uint64)) <= check)
                near &= parent[i + 1 - lo :] != parent[i - lo]  # the others are joined already
                for j in (np.flatnonzero(near) + i + 1).tolist():
                    a, b = parent[i - lo], parent[j - lo]
                    if a == b or min(len(sets[i]), len(sets[j])) < similarity * max(len(sets[i]), len(sets[j])):
                        continue
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common and common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                        parent[parent == max(a, b)] = min(a, b)
                        found.append((point[i], point[j]))
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (links(t) for t in _whole_groups(batches, own_key, 1 << 11))

    return rows.repartition(*own_key).sortWithinPartitions(*own_key).mapInArrow(run, "u long, v long")


def _whole_groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], least: int) -> Iterator[pa.Table]:
    """Tables of about `least` rows or more of rows sorted by a key, each with all rows of its keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        now = pa.Table.from_batches(held)
        same = np.ones(n, bool)  # the last group may go on in the next batch
        for c in key:
            same &= now.column(c).to_numpy() == now.column(c)[n - 1].as_py()
        cut = n - int(same[::-1].argmin() if not same.all() else n)
        if cut:
            yield now.slice(0, cut).combine_chunks()
        held, n = now.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bound: int = 3, tile: int = 4096, check: tuple[int, int] | None = None, similarity: float | None = None) -> DataFrame:
    """(id, tag, fp, component, root): component is the least id among all rows reachable over links, root
    tells components apart even where ids repeat. check: words of the shingles of a second fingerprint, and
    its bound; similarity: that of the sets of such shingles which linked texts have at least."""
    words, second = check or (None, BITS)
    rows = stash(fingerprints(docs, id_col, text_col, shingle, words).withColumn("point", point_of()), "fingerprints")
    points = stash(rows.groupBy("point", "fp", "fp2").agg(F.min("id").alias("first"), F.min(F.struct(F.col("id").isNull(), "id", "tag")).alias("one")), "points")
    roots = connected_components(stash(links(points, bound, tile, second), "links"))
    if similarity is not None:
        group = points.join(roots, points.point == roots.node).select("root", "point", "fp", "fp2", F.col("one.id").alias("one_id"), F.col("one.tag").alias("one_tag"))
        group = stash(group, "groups")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        texts = texts.join(group, F.col("id").eqNullSafe(F.col("one_id")) & (F.xxhash64("text") == F.col("one_tag")))
        once = texts.groupBy("point").agg(*(F.first(c).alias(c) for c in ("root", "fp", "fp2", "text")))  # rows may repeat
        roots = connected_components(stash(similar_links(once, words or shingle, similarity, bound, second), "alike"))
    linked = stash(points.join(roots, points.point == roots.node).select("point", "first", "root"), "linked")
    least = stash(linked.groupBy("root").agg(F.min("first").alias("component")), "least")
    named = linked.join(least, "root").select("point", "component", "root")
    whole = points.select("point", "first").join(named, "point", "left").select("point", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component")).alias("component"), F.coalesce("root", "point").alias("root"))
    return rows.join(stash(whole, "components"), "point").select("id", "tag", "fp", "component", "root")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the least id. A row is known again
    by its id and its text's hash; of rows alike in both, one stays, and only such rows are shuffled for it."""
    found = near_duplicates(docs, id_col, text_col, **options)
    key = F.struct(F.col("id").isNull().alias("none"), "id", "tag")
    copies = found.groupBy("root", "id", "tag").agg(F.count("*").alias("n"))
    best = copies.groupBy("root").agg(F.min(F.struct(key.alias("key"), "n")).alias("m")).select("m.key.id", "m.key.tag", "m.n")
    mine = {c: f"{c}_{uuid.uuid4().hex}" for c in ("id", "tag", "n")}  # no column of docs has such a name
    best = stash(best.toDF(*mine.values()), "representatives")
    tag = F.xxhash64(F.col(text_col).cast("string"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(mine["id"])) & (tag == F.col(mine["tag"]))
    once = docs.join(best.where(F.col(mine["n"]) == 1), same, "left_semi")
    often = best.where(F.col(mine["n"]) > 1)
    if often.isEmpty():
        return once
    again = docs.join(often, same, "left_semi").withColumn(mine["tag"], tag)
    return once.unionByName(again.dropDuplicates([id_col, mine["tag"]]).drop(mine["tag"]))
