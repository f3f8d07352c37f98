"""What the operators of this subpackage share: the cluster's shared folder, written tables, components."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import pickle
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir. Only on a local master, where one
    machine has everything, a temporary folder is made and set if there is none; elsewhere that is an error."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="deltaloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


_FOLDERS: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path no one else uses, in a folder of this application, which is deleted when the application ends:
    lazy results may read what is in it until then."""
    folder = f"{shared_dir(spark)}/deltaloom-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        path, fs = _hadoop(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, name: str) -> tuple:
    """Hadoop's path of a name, and the file system it is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: For each thread, what stash() wrote in each scratch() block it is in, the innermost last.
_SCOPES = threading.local()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again. What depends on it starts from files
    that outlive any executor, so a lost one never repeats the work above. It goes at the end of the
    surrounding scratch() block of the thread, or of the application."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if scopes := getattr(_SCOPES, "open", []):
        scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for name in paths:
        path, fs = _hadoop(spark, name)
        fs.delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this thread's stash() writes in its block, at its end."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    _SCOPES.open.append([])
    try:
        yield
    finally:
        remove(spark, _SCOPES.open.pop())


class Shared:
    """A value that is sent to the workers once. Each worker process keeps what it has unpacked under the
    value's own digest, the least recently used going first beyond `KEPT` bytes of packed values: a
    broadcast's address says nothing, as a later one may stand where an earlier one was."""

    KEPT = 256 << 20

    def __init__(self, spark: SparkSession, value: object, most: int = 256 << 20):
        packed = pickle.dumps(value)
        if len(packed) > most:
            raise ValueError(f"{len(packed)} bytes are more than the {most} that may be sent to every worker")
        self.key, self.size = hashlib.sha256(packed).hexdigest(), len(packed)
        self.packed = spark.sparkContext.broadcast(packed)

    @property
    def value(self):
        if (own := _UNPACKED.pop(self.key, None)) is None:
            own = (pickle.loads(self.packed.value), self.size)
        _UNPACKED[self.key] = own
        while len(_UNPACKED) > 1 and sum(n for _, n in _UNPACKED.values()) > self.KEPT:
            del _UNPACKED[next(iter(_UNPACKED))]
        return own[0]

    def drop(self) -> None:
        self.packed.unpersist()


_UNPACKED: dict[str, tuple[object, int]] = {}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(xs: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], run: int = 64) -> Column:
    """An array of out(state, x) for every x of an array, where state is what step(state, x) made of zero and
    the elements before x. Results are put together in runs, and the runs into one array, so that no long
    array is copied for every element."""

    def inner(state: Column, part: Column) -> Column:
        first = let(part, lambda p: F.transform(F.slice(p, 1, 1), lambda x: out(state, x)))
        begin = F.struct(step(state, part[0]).alias("state"), first.alias("outs"))
        more = lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["outs"], F.array(out(acc["state"], x))).alias("outs"))
        return F.aggregate(F.slice(part, F.lit(2), F.lit(run)), begin, more)

    def outer(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / run).cast("int")), lambda k: F.slice(xs, k * run + 1, F.lit(run)))
        first = let(F.slice(xs, F.lit(1), F.lit(run)), lambda p: inner(zero, p))
        begin = let(first, lambda f: F.struct(f["state"].alias("state"), F.array(f["outs"]).alias("runs")))
        more = lambda acc, p: let(inner(acc["state"], p), lambda f: F.struct(f["state"].alias("state"), F.concat(acc["runs"], F.array(f["outs"])).alias("runs")))
        return F.flatten(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), begin, more, lambda acc: acc["runs"]))

    return let(xs, lambda a: F.when(F.size(a) > 0, outer(a)).otherwise(F.transform(a, lambda x: out(zero, x))))


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, most: int = 1024) -> DataFrame:
    """mapInArrow with a function of one batch of at most `most` rows, which bounds what a worker holds of
    long texts and their results. An empty partition gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                if (out := work(batch.slice(at, most))) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), two longs. Rounds of contraction: each node moves to
    its neighbour of least priority, if less than its own; priorities are drawn anew each round, so the
    number of nodes falls by a constant factor whatever the shape of the graph. Every round ends in written
    tables. Nothing is gathered on the driver but whether edges are left. No edges: no rows."""
    spark = edges.sparkSession
    pairs = lambda e: (
        e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )
    left = stash(pairs(edges.where("u is not null and v is not null")), "edges")
    where = spark.createDataFrame([], "node long, root long")
    turn = 0
    while not left.isEmpty():
        turn += 1
        priority = functools.partial(F.xxhash64, F.lit(turn))
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(F.struct(priority("v").alias("p"), F.col("v"))).alias("m"))
        own = F.struct(priority("u").alias("p"), F.col("u").alias("v"))
        moves = stash(near.select(F.col("u").alias("node"), F.least(F.col("m"), own)["v"].alias("to")), "moves")
        at = lambda c, name: moves.select(F.col("node").alias(c), F.col("to").alias(name))
        moved = left.join(at("u", "a"), "u").join(at("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if turn == 1:
            where = moves.select("node", F.col("to").alias("root"))
        else:
            where = stash(
                where.join(at("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots"
            )
        left = stash(pairs(moved), "edges")
    return where
