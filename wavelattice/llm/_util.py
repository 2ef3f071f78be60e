"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: a few MB of ordinary text, tens of MB of very long ones.
ARROW_ROWS = 1000
#: Rows that may be broadcast, after they were counted (some 100 bytes each).
FEW = 200_000
#: Edges that are gathered (16 bytes each) and joined to components on the driver, after a count; more take rounds of jobs, each of which costs the driver plans and tasks.
EDGES = 200_000


def prepare(spark: SparkSession) -> SparkSession:
    """Sets small Arrow batches for the session and turns broadcasts by estimated size off (the caller's settings are replaced), and see shared_folder.

    An estimate leaves out what an explode adds: tables put at under 10 MB went through the driver as hundreds. What may be broadcast is counted, see few.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    for threshold in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(threshold, "-1")
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a local master gets a temporary one; a cluster is an error."""
    place, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not place:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            place = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(place)
    return place or known.get()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the shared checkpoint folder, so a lost executor loses nothing."""
    prepare(df.sparkSession)
    return df.checkpoint()


_FOLDERS: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes all tables of Scratch so far; for callers that have written what was made of them."""
    while _FOLDERS:
        delete(spark, _FOLDERS.pop())


class Scratch:
    """Tables written as Parquet to the shared folder, so that readers take only the columns they need."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = prepare(spark), f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        _FOLDERS.append(self.top)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.top}/{name}")
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; all of them if none is named."""
        for path in [f"{self.top}/{name}" for name in names] or [self.top]:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that are over; else they wait for the driver's next full collection."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns a Python worker's free memory to the system: it stays, idle, while other stages run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # the C library may be another
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def few(df: DataFrame, bound: int = FEW) -> DataFrame:
    """df, marked for broadcast if it has at most `bound` rows; df is a table that is cheap to count."""
    return F.broadcast(df) if df.count() <= bound else df


def unused(name: str, columns: list[str]) -> str:
    """A column name like `name` that is not among columns, whatever their case."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different nodes of the edges, and the smallest node reachable from each."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def connected_components(edges: DataFrame, max_rounds: int = 60, gathered: int = EDGES) -> DataFrame:
    """(node, label): label is the smallest node reachable over edges (u, v); nodes are longs.

    Up to `gathered` different edges are joined on the driver. More alternate
    large-star and small-star steps, so a chain of n nodes needs about log(n)
    rounds and a hub is a min() with map-side combine, never a collected
    neighbour list. Each round is checkpointed; only counts come to the driver. Should max_rounds not suffice, it raises RuntimeError.
    """
    flow = cut(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    if flow.count() <= gathered:
        table = flow.toArrow()
        nodes, labels = components(*(table[c].to_numpy() for c in "uv"))
        return cut(flow.sparkSession.createDataFrame(pa.table({"node": nodes, "label": labels}), "node long, label long"))
    seen = None
    for _ in range(max_rounds):
        both = flow.unionByName(flow.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        flow = cut(
            small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = flow.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return flow.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        flow.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def document_key(docs: DataFrame) -> list[Column]:
    """k0 and k1: doc_id as a long (null comes first) and a hash of the text; rows alike in both are one document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k0"), F.xxhash64(F.col("text").cast("string")).alias("k1")]
