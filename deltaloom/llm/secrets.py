"""Secret scans with corpus-wide ownership frequency, as DataFrame expressions alone.

Every text is searched for base kinds (assignments, access keys, hex strings) and for opaque strings: long
runs of key characters with letters and digits in them. A candidate's value is hashed; over the whole corpus
the distinct repositories and owners of each hash are counted. A value found with many owners is an example
that was copied; one that belongs to few looks live, however often they repeat it. Where an owner is not
known, many repositories tell a copied example too. The base spans always stand;
opaque strings outside base spans stand only if they look live.

Defined results: a null text is empty and has no spans; a null owner or repository is one of its own; equal
values count once per repository and owner, however often they repeat; repeated rows stay rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import let, running, stash

#: The patterns of the base kinds. Access keys and hex strings have their least lengths in the
#: pattern, which finds the same as dropping shorter matches does: a run begins at its first character.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: An opaque string: at least 20 key characters, not within a longer run of them.
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
KINDS = [*PATTERNS, "opaque"]


def _matches(text: Column, kind: str) -> Column:
    """Array of (start, end, value) in code points."""
    pattern = PATTERNS.get(kind, OPAQUE)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(ms: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pairs = F.zip_with(ms, F.slice(gaps, F.lit(1), F.size(ms)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))
        def one(at: Column, p: Column) -> Column:
            return F.struct((at + p["g"]).alias("s"), (at + p["g"] + p["n"]).alias("e"), p["m"].alias("v"))

        return running(pairs, F.lit(0), lambda at, p: at + p["g"] + p["n"], one)

    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    out = let(found, lambda ms: F.when(F.size(ms) == 0, none).otherwise(spans(ms)))
    if kind == "assign":
        value = lambda x: F.regexp_extract(x["v"], pattern, 2)
        out = F.filter(F.transform(out, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), value(x).alias("v"))), lambda x: F.length(x["v"]) >= 6)
    if kind == "opaque":
        out = F.filter(out, lambda x: x["v"].rlike("[0-9].*[0-9].*[0-9]") & x["v"].rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]"))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, owner, repo, kept, found): kept has the columns in keep; found is every candidate as (start, kind, end, hash), kind by its place in
    KINDS; opaque strings that touch a base span are left to it."""
    named = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    kept = F.struct(*keep) if keep else F.struct(F.lit(None).cast("string").alias("none"))
    rows = docs.select(F.col(id_col).alias("id"), named(owner_col).alias("owner"), named(repo_col).alias("repo"), kept.alias("kept"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "owner", "repo", "kept", *(_matches(F.col("text"), k).alias(k) for k in KINDS))
    tag = lambda c, k: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.sha2(x["v"], 256).alias("h")))
    every = F.concat(*(tag(F.col(k), i) for i, k in enumerate(KINDS)))
    rows = rows.select("id", "owner", "repo", "kept", F.array_sort(every).alias("found"))
    return rows.withColumn("found", F.when(F.size("found") > 1, _apart(F.col("found"))).otherwise(F.col("found")))


def _apart(found: Column) -> Column:
    """The candidates in order without opaque strings that overlap a base span: those that begin before the
    last end of the base spans so far, or, going backward, end after the next base span begins."""
    base = lambda x: x["k"] < len(PATTERNS)
    marked = lambda at, x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["h"].alias("h"), (base(x) | at).alias("free"))
    ahead = running(found, F.lit(0), lambda end, x: F.when(base(x), F.greatest(end, x["e"])).otherwise(end), lambda end, x: marked(x["s"] >= end, x))
    behind = running(F.reverse(ahead), F.lit((1 << 31) - 1), lambda begin, x: F.when(base(x), x["s"]).otherwise(begin), lambda begin, x: marked(x["free"] & (x["e"] <= begin), x))
    free = F.filter(F.reverse(behind), lambda x: x["free"])
    return F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["h"].alias("h")))


def ownership(candidates: DataFrame) -> DataFrame:
    """(h, owners, repos, unknown) from (h, owner, repo): distinct ones over the whole corpus, and whether an
    owner is null. Counts meet in partial
    sums, so a value that a third of the rows hold is a few rows by then."""
    null = F.lit("\x00")
    once = candidates.groupBy("h", F.coalesce("owner", null).alias("owner"), F.coalesce("repo", null).alias("repo")).agg(F.lit(1).alias("one"))
    # The owner's share of repositories first: a repository belongs to one owner or counts once for each.
    per = once.groupBy("h", "owner").agg(F.count("*").alias("repos"))
    return per.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max(F.col("owner") == null).alias("unknown"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = "doc_id", max_owners: int = 2, max_repos: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, spans) for every row, or the columns in keep instead of id: spans is an array of (start, end, kind, live), sorted by start and kind;
    live: at most max_owners owners of the whole corpus hold the value, and, if one of them is null, at most max_repos repositories."""
    rows = stash(scan(docs, id_col, text_col, owner_col, repo_col, keep).withColumn("row", F.monotonically_increasing_id()), "scan")
    each = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("c")).select("row", "owner", "repo", "c.*")
    owned = stash(ownership(each), "ownership").select("h", ((F.col("owners") <= max_owners) & (~F.col("unknown") | (F.col("repos") <= max_repos))).alias("live"))
    # Sides that are read from tables: a hash that many rows hold is dealt to many tasks.
    judged = each.join(owned, "h").where((F.col("k") < len(PATTERNS)) | F.col("live"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    spans = judged.select("row", F.struct("s", "k", "e", kind.alias("kind"), "live").alias("x")).groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("spans"))
    bare = F.transform(F.col("spans"), lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), x["kind"].alias("kind"), x["live"].alias("live")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,live:boolean>>")
    own = [F.col("kept")[c].alias(c) for c in keep] or [F.col("id")]
    empty = rows.where(F.size("found") == 0).select(*own, none.alias("spans"))
    some = rows.where(F.size("found") > 0).select("row", "id", "kept").join(spans, "row", "left").select(*own, F.coalesce(bare, none).alias("spans"))
    return empty.unionByName(some)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by the mark; spans that overlap are one."""
    piece = lambda at, x: F.when(x["start"] < at, "").otherwise(F.concat(F.substring(text, at + 1, x["start"] - at), F.lit(mark)))
    before = F.array_join(running(spans, F.lit(0), lambda at, x: F.greatest(at, x["end"]), piece), "")
    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    return F.when(F.size(spans) > 0, F.concat(before, F.substring(text, last + 1, F.length(text)))).otherwise(text)
