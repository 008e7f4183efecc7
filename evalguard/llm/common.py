"""Shared helpers: durable intermediate tables, connected components, fixed-size prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"file://{LOCAL_CHECKPOINTS}").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone; the folder is scratch space
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, so a lost executor never makes an expensive stage run again, and later
    readers prune columns (unlike a checkpointed RDD).
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make, name: str) -> DataFrame:
    """Write what ``make()`` returns, then delete the tables that were written on the way: nothing reads them any more."""
    at = len(_written)
    out = materialise(make(), name)
    own = _written.pop()
    for session, path in _written[at:]:
        drop_path(session, path)
    _written[at:] = [own]
    return out


#: Rows and bytes of an Arrow batch: texts may be long, and both sides of the pipe hold whole batches. A longer row stands alone.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


#: What an operator keeps in a worker process between its tasks, by operator.
kept_in_worker: dict[str, dict] = {}


def in_arrow(df: DataFrame, run, schema: str, keep: str = "") -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_ROWS rows and, but for a single longer row, BATCH_BYTES.

    Spark reads both from the session when the plan runs, so the session keeps them; lower values stay.
    A task drops what operators other than ``keep`` have left in its worker.
    """
    bound_batches(df.sparkSession)

    def whole(batches):
        forget_others(keep)
        yield from run(batches)
        release_memory()

    return df.mapInArrow(whole, schema)


def bound_batches(spark: SparkSession) -> None:
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(key, None) or "0"
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))


def forget_others(keep: str) -> None:
    for name in [n for n in kept_in_worker if n != keep]:
        del kept_in_worker[name]


def release_memory() -> None:
    """Give freed memory back to the system: a worker outlives its task and waits beside others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def components(members: DataFrame, node: str, group: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of nodes that share a group: (node, comp), comp the least node.

    Min-label propagation over the bipartite node-group table plus pointer jumping. A hot group is
    only ever aggregated (map side first) or joined, and each label table is written before its
    join, so that skewed joins can be split. Empty input gives an empty table.
    """
    spark = members.sparkSession
    m = materialise(members.select(F.col(node).alias("node"), F.col(group).alias("grp")).distinct(), "cc-members")
    lab = materialise(m.select("node", F.col("node").alias("comp")).distinct(), "cc-labels")
    for _ in range(max_rounds):
        new = settle(spark, lambda: _round(m, lab), "cc-labels")  # noqa: B023
        same = new.join(lab.withColumnRenamed("comp", "old"), "node").where("comp != old").isEmpty()
        lab = new
        if same:
            return lab
    raise RuntimeError("connected components did not converge")


def _round(m: DataFrame, lab: DataFrame) -> DataFrame:
    """Least labels over groups and back to nodes, then one jump along the pointers."""
    g = materialise(m.join(lab, "node").groupBy("grp").agg(F.min("comp").alias("gmin")), "cc-groups")
    n = materialise(m.join(g, "grp").groupBy("node").agg(F.min("gmin").alias("comp")), "cc-nodes")
    up = n.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    return n.join(up, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"))


def letters(c: Column) -> Column:
    """True where the text holds a letter of any script."""
    return F.coalesce(c.rlike(r"\p{L}"), F.lit(False))


#: A side of a join is broadcast up to this many narrow rows (some 16 MB); beyond it, Spark shuffles both sides.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows; give it a written table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
