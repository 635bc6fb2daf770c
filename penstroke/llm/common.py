"""Shared plumbing: tables, the cluster's shared folder, null-safe text, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The column's text; a null text is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    set_already = spark.conf.get("spark.checkpoint.dir", None)
    if set_already:
        return set_already.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="penstroke-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write the frame as a table in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/penstroke/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task of mapInArrow that gives the memory it has freed back to the system when it ends.

    Workers are used again and stay while stages without Python run; allocators would keep for them what a task took at most.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
            if trim is not None:
                trim(0)

    return task


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) with root the smallest node reachable, for every node that an edge (a, b) names.

    Alternating large-star and small-star steps: each keeps a graph of at most as many edges and points
    nodes at ever smaller neighbours, until every node points at its component's smallest one. A step
    groups by node with map-side minima only, so no neighbour list is ever gathered into one task.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        # large star: u's larger neighbours move to the smallest of u and its neighbours
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "minima")
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small star: u and its smaller neighbours move to the smallest of these
        down = materialize(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "down")
        moved = large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(down, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        current = materialize(moved.unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "small")
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
