"""Helpers the operators of this subpackage share: checkpoints, sized joins, Arrow batches, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only up to this many bytes, taken as counted rows times a stated row width.
BROADCAST_BYTES = 32 << 20
#: Edges (16 bytes each) that one task may join in Python, and by DataFrame functions.
ONE_TASK, ONE_NATIVE_TASK = 500_000, 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local master without one (tests, a laptop) gets one of this machine's own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for large tables of which parts are read; it goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows fit the bound, else as it is (a shuffle join)."""
    rows = small.count() if rows is None else rows
    return F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small


def hidden(df: DataFrame, *names: str) -> list[str]:
    """``names``, each led by as many underscores as make it no column of ``df`` (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def partitions(spark: SparkSession, rows: int = 0, per_task: int = 500_000) -> int:
    """Shuffle partitions for ``rows`` rows: the session's number, more if a task would get too many."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def crc_remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id written in decimal, modulo ``mod``; null ids give null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod))


def pieces(batches, rows: int = 2048, limit: int = 32 << 20):
    """Arrow batches cut into parts of at most ``rows`` rows and about ``limit`` bytes (a longer row stands alone)."""
    for batch in batches:
        start, n = 0, batch.num_rows
        each = max(1, min(rows, int(rows if not n else limit / max(1, batch.nbytes / n))))
        while start < n:
            yield batch.slice(start, each)
            start += each
    release()


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task shares its executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _joined(batches):
    """(node, component) of the edges (u, v) of one partition, by union-find; roots are the smallest nodes."""
    above: dict[int, int] = {}

    def root(i: int) -> int:
        above.setdefault(i, i)
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            u, v = root(u), root(v)
            if u != v:
                above[max(u, v)] = min(u, v)
    nodes = list(above)
    yield pd.DataFrame({"node": np.array(nodes, np.int64), "component": np.array([root(i) for i in nodes], np.int64)})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, native: bool = False) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Up to ONE_TASK counted edges between long ids are joined by one task's union-find; more of
    them, and always if ``native``, by rounds of
    alternating large-star and small-star contraction. There, minima are aggregated before
    the shuffle, so a hub costs one row a task; the join that hands a hub its minimum is an
    ordinary equi-join that adaptive execution may split. A round over at most ONE_NATIVE_TASK edges
    takes one partition and no exchange. Nodes may be of any orderable
    type. Self-loops, repeated edges and nulls are allowed: the first two say nothing
    new and rows with a null end are ignored. No edges: no rows.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    if edges.schema[a].dataType.typeName() == "struct":
        u, v = F.when(F.col(a) > F.col(b), F.col(a)).otherwise(F.col(b)), F.when(F.col(a) > F.col(b), F.col(b)).otherwise(F.col(a))
    e = checkpointed(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct())
    sign = _signature(e)
    if not native and sign[0] <= ONE_TASK and e.schema["u"].dataType.typeName() == "long":
        return e.coalesce(1).mapInPandas(_joined, "node long, component long")
    for _ in range(max_rounds):
        if not sign[0]:
            break
        alone = sign[0] <= ONE_NATIVE_TASK
        e = e.coalesce(1) if alone else e
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = _with_least(both, alone).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v") if _plain(e) else F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("v")).distinct()
        small = _with_least(large, alone).select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        e = checkpointed(small.where("u != v").distinct())
        last, sign = sign, _signature(e)
        if sign == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _plain(e: DataFrame) -> bool:
    return e.schema["u"].dataType.typeName() != "struct"


def _with_least(e: DataFrame, alone: bool) -> DataFrame:
    """(u, v, m): edges with the least v of their u; in one partition by a window, else by a join that may be split."""
    if alone:
        return e.withColumn("m", F.min("v").over(W.partitionBy("u")))
    return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")


def _signature(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
