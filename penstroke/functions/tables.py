"""Reading tables, and writing intermediate ones into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="penstroke-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/penstroke/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cumulative(counts: DataFrame, group: str, value: str, number: str) -> DataFrame:
    """Adds `below`: the sum of `number` over the group's smaller values. Rows must be distinct in (group, value).

    Values are dealt out by range, so that a group spreads over many tasks; the driver gets one sum per task and group.
    """
    spark = counts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(n, group, value).sortWithinPartitions(group, value).withColumn("_place", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranged").withColumn("_part", F.shiftrightunsigned("_place", 33))
    sums = dealt.groupBy("_part", group).agg(F.sum(number).alias("s"))
    total, sums = dict(sums.dtypes)["s"], sums.collect()
    starts, running, none = [], {}, 0.0 if total == "double" else 0
    for r in sorted(sums, key=lambda r: r["_part"]):
        starts.append((r["_part"], r[group], running.get(r[group], none)))
        running[r[group]] = running.get(r[group], none) + r["s"]
    kind = dict(counts.dtypes)[group]
    start = spark.createDataFrame(starts, f"_part long, {group} {kind}, _start {total}")
    from pyspark.sql import Window

    within = F.sum(number).over(Window.partitionBy("_part", group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.join(F.broadcast(start), ["_part", group]).withColumn("below", F.col("_start") + F.coalesce(within, F.lit(0).cast(total)))
    return out.drop("_part", "_place", "_start")


def running(df: DataFrame, key: str, order: list[str], number: str) -> DataFrame:
    """Adds `upto`: the sum of `number` over the key's rows up to each row, in order. Keys aren't null; a key's order has no ties that matter.

    A key of any number of rows spreads over ranges; only a range's first key can have rows before it, so that the driver sees a row for each range.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).withColumn("_place", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ordered").withColumn("_part", F.shiftrightunsigned("_place", 33))
    parts = dealt.groupBy("_part", key).agg(F.sum(number).alias("s")).groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("s", key).alias("s"))
    starts, open_, before = [], None, 0
    for r in sorted(parts.collect(), key=lambda r: r["_part"]):
        goes_on = open_ is not None and r["first"] == open_
        if goes_on:
            starts.append((r["_part"], r["first"], before))
        before = r["s"] + (before if goes_on and r["last"] == open_ else 0)
        open_ = r["last"]
    start = spark.createDataFrame(starts, f"_part long, {key} {dict(df.dtypes)[key]}, _start long")
    within = F.sum(number).over(Window.partitionBy("_part", key).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_within", within).join(F.broadcast(start), ["_part", key], "left")
    return out.withColumn("upto", F.col("_within") + F.coalesce("_start", F.lit(0))).drop("_part", "_place", "_within", "_start")
