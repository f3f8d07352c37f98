"""Quality rules: ordered decision lists learned from labelled statistics, as Spark conditional expressions.

Text statistics are DataFrame expressions alone. Learning is sequential covering: a rule begins empty, takes
the threshold condition of most information gain on the growing rows until it covers few good rows or has
`max_conditions`, is pruned from its end while its precision on the pruning rows does not fall, and is kept
if that precision reaches `min_precision`; then the rows it covers leave, and the next rule begins. Every
step is one grouped count over all labelled rows that are left - per feature and bin, of good and of bad
ones - so nothing but counts reaches the driver and no labelled row is left out. The bins' edges are
quantiles over all labelled rows.

The list comes out as one nested conditional, `when(rule 1, reject).when(rule 2, reject)...otherwise(keep)`.

Defined results: a null, empty or wordless text has no words and every count 0; null labels and labels
without a document teach nothing; repeated label rows count as often as they are given; with no labelled
bad row the list is empty and keeps everything; an empty table gives an empty result; other columns of the
tables, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import let, stash

#: White space and symbols of the base statistics.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more, the first included. Windows are told
    apart by 64-bit hashes. A text without a repeated window costs one set; else windows are sorted by hash,
    neighbours with equal hashes give the places, and each place adds what it covers beyond the one before."""
    n = F.size(words) - WINDOW + 1
    at = lambda i, k: F.get(words, i + k)
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))

    def cover(h: Column) -> Column:
        tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"].eqNullSafe(F.get(s, b)["h"])
            twice = F.filter(s, lambda x, j: same(j, j - 1) & (j > 0) | same(j, j + 1) & (j + 1 < F.size(s)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(let(tagged, places), start, step, lambda acc: acc["n"])

    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), cover(h)).otherwise(0))
    return F.when(n > 1, some).otherwise(0)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, n_lines, n_capitals)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    rows = rows.select("id", "text", words_of(F.col("text")).alias("words"), lines.alias("lines"))
    w = F.col("words")
    return rows.select(
        "id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )


def features() -> dict[str, Column]:
    """What the learned rules test, from the columns of statistics()."""
    per = lambda c, by: F.col(c) / F.greatest(F.col(by), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "distinct_share": per("n_distinct", "n_words"),
        "line_words": per("n_words", "n_lines"),
        "capital_share": per("n_capitals", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    edge: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.edge if self.above else c <= self.edge

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.edge:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules that reject; a row that no rule covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        if not self.rules:
            return F.lit(True)
        hit = [_all(rule) for rule in self.rules]
        out = F.when(hit[0], False)
        for h in hit[1:]:
            out = out.when(h, False)
        return out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "keep"


def _all(conditions: tuple[Condition, ...] | list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _gain(bad: int, good: int, before_bad: int, before_good: int) -> float:
    """Bad rows times the bits their share gained."""
    if not bad:
        return -math.inf
    share = lambda b, g: math.log2((b + 1e-9) / (b + g + 2e-9))
    return bad * (share(bad, good) - share(before_bad, before_good))


def learn(labelled: DataFrame, names: list[str], bad_col: str = "bad", key_col: str = "id", bins: int = 24, max_rules: int = 8, max_conditions: int = 4, min_precision: float = 0.97, min_bad: int = 5) -> DecisionList:
    """A decision list from rows with the named double columns, a boolean `bad_col` and a key that deals a
    third of the rows to pruning."""
    grow = F.pmod(F.xxhash64(F.col(key_col), F.lit("prune")), F.lit(3)) > 0
    rows = labelled.where(F.col(bad_col).isNotNull()).select(*names, F.col(bad_col).alias("bad"), grow.alias("grow"))
    if not rows.take(1):
        return DecisionList(())
    quantiles = [k / bins for k in range(1, bins)]
    # The edges between bad and good rows matter most: quantiles of each kind by itself.
    cuts = rows.groupBy("bad").agg(*(F.percentile_approx(n, quantiles, 2000).alias(n) for n in names)).collect()
    edges = {n: sorted({float(e) for r in cuts for e in (r[n] or [])}) for n in names}
    # A value's bin is the number of edges below it; rules are grown on bins.
    below = lambda n: F.size(F.filter(F.array(*map(F.lit, edges[n])), lambda e: F.col(n) > e))
    cells = stash(rows.select("bad", "grow", *(below(n).alias(n) for n in names)), "cells")

    def covers(rule: list[Condition] | tuple[Condition, ...]) -> Column:
        out = F.lit(True)
        for c in rule:
            k = edges[c.feature].index(c.edge)
            out = out & ((F.col(c.feature) > k) if c.above else (F.col(c.feature) <= k))
        return out

    def counts(left: Column) -> dict[tuple[bool, str, int], tuple[int, int]]:
        """Bad and good rows left, per half, feature and bin."""
        each = F.explode(F.array(*(F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names)))
        got = cells.where(left).select("bad", "grow", each.alias("c")).groupBy("grow", "c.f", "c.b").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
        return {(r["grow"], r["f"], r["b"]): (r["bad"], r["good"]) for r in got.collect()}

    def totals(table: dict, half: bool) -> tuple[int, int]:
        own = [v for (g, f, _), v in table.items() if g is half and f == names[0]]
        return sum(b for b, _ in own), sum(g for _, g in own)

    def best(table: dict) -> tuple[float, Condition | None]:
        bad, good = totals(table, True)
        top: tuple[float, Condition | None] = (0.0, None)
        for n in names:
            b = g = 0
            for k, e in enumerate(edges[n]):
                x, y = table.get((True, n, k), (0, 0))
                b, g = b + x, g + y
                for above, own in ((False, (b, g)), (True, (bad - b, good - g))):
                    if own[0] >= min_bad and (v := _gain(*own, bad, good)) > top[0] + 1e-9:
                        top = (v, Condition(n, above, e))
        return top

    rules: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    table = counts(left)
    while len(rules) < max_rules:
        rule: list[Condition] = []
        held = [totals(table, False)]
        now = table
        while len(rule) < max_conditions and totals(now, True)[1]:
            _, condition = best(now)
            if condition is None:
                break
            rule.append(condition)
            now = counts(left & covers(rule))
            held.append(totals(now, False))
        precision = lambda c: (c[0] + 1) / (c[0] + c[1] + 2)
        while len(rule) > 1 and precision(held[len(rule) - 1]) >= precision(held[len(rule)]):
            rule.pop()
        bad, good = held[len(rule)]
        if not rule or bad < min_bad / 2 or bad / max(bad + good, 1) < min_precision:
            break
        rules.append(tuple(rule))
        left = left & ~covers(rule)
        table = counts(left)
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """The statistics of every row with `kept`; the list is learned from the rows that labels marks 0 or 1."""
    rows = stash(statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 0).alias("bad"))
    wide = rows.select("*", *(c.alias(n) for n, c in features().items()))
    names = list(features())
    labelled = stash(wide.join(known, "id").select("id", "bad", *names), "labelled")
    rules = learn(labelled, names, **options)
    return wide.select(*rows.columns, rules.kept().alias("kept"), F.lit(str(rules)).alias("rules"))
