"""Thresholds, bands, discrimination, and their clustered bootstraps.

A frame of classed distances has class (author, distractor), document, distance. Point estimates are plain
aggregates. Resamples are counted, not drawn row by row: SplitMix64 is a counter, so each resample's draws can
be computed anywhere, and an estimate over drawn clusters needs only how often each cluster was drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.tables import cumulative, materialize

#: Draws that one row of work makes.
DRAWS = 1 << 20
#: Codes whose draws travel in one row.
CHUNK = 1 << 12


def tail_shares(distances: DataFrame) -> DataFrame:
    """(class, distance, ties, below, size) for each distinct distance of a class."""
    counts = distances.where("distance is not null").groupBy("class", "distance").agg(F.count("*").alias("ties"))
    ranked = cumulative(counts, "class", "distance", "ties")
    sizes = counts.groupBy("class").agg(F.sum("ties").alias("size"))
    return ranked.join(F.broadcast(sizes), "class")  # two rows


def thresholds(distances: DataFrame, author_target: float = C.AUTHOR_TARGET, distractor_target: float = C.DISTRACTOR_TARGET) -> DataFrame:
    """One row: low is the least author distance that at most the target's share reaches, high the largest distractor distance that at most its share stays under."""
    s = tail_shares(distances)
    above, upto = (F.col("size") - F.col("below")) / F.col("size"), (F.col("below") + F.col("ties")) / F.col("size")
    out = s.agg(
        F.min(F.when((F.col("class") == "author") & (above <= author_target), F.col("distance"))).alias("low"),
        F.max(F.when((F.col("class") == "distractor") & (upto <= distractor_target), F.col("distance"))).alias("high"),
        F.coalesce(F.max(F.when(F.col("class") == "author", F.col("size"))), F.lit(0)).alias("authors"),
        F.coalesce(F.max(F.when(F.col("class") == "distractor", F.col("size"))), F.lit(0)).alias("distractors"),
    )
    enough = (F.col("authors") >= math.ceil(1 / author_target)) & (F.col("distractors") >= math.ceil(1 / distractor_target))
    out = out.select(F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), "authors", "distractors")
    return out.withColumn("verdict", F.when(F.col("low").isNull() | F.col("high").isNull(), "uncalibrated").when(F.col("low") < F.col("high"), "separated").otherwise("pair-incompatible"))


def banded(distances: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds band: in-range up to low, not-you from high, drifting between; null without thresholds or if low > high."""
    j = distances.crossJoin(F.broadcast(limits.select("low", "high")))  # one row
    ok = F.col("low") <= F.col("high")
    band = F.when(ok & (F.col("distance") <= F.col("low")), "in-range").when(ok & (F.col("distance") >= F.col("high")), "not-you").when(ok & F.col("distance").isNotNull(), "drifting")
    return j.withColumn("band", band).drop("low", "high")


def occupancy(banded_: DataFrame) -> DataFrame:
    return banded_.where("band is not null").groupBy("band").agg(F.count_if(F.col("class") == "author").alias("author"), F.count_if(F.col("class") == "distractor").alias("distractor"))


def auc(distances: DataFrame, score: str = "distance", positive: str = "class = 'distractor'") -> DataFrame:
    """One row (auc, positives, negatives): the share of pairs in which the positive scores higher, ties counting half, from ranks."""
    flagged = distances.where(f"{score} is not null").select(F.expr(positive).alias("pos"), F.col(score).alias("x"))
    counts = flagged.groupBy("x").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("q")).withColumn("g", F.lit(0))
    ranked = cumulative(counts, "g", "x", "q")
    out = ranked.agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)).alias("wins"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    both = F.col("positives") * F.col("negatives")
    return out.select(F.when(both > 0, F.col("wins") / both).alias("auc"), "positives", "negatives")


def splitmix(seed: int, first: int, count: int) -> np.ndarray:
    """Outputs `first`, `first` + 1, ... of SplitMix64; the state is a counter, so any stretch can be made anywhere."""
    with np.errstate(over="ignore"):
        k = np.arange(first + 1, first + 1 + count, dtype=np.uint64)
        z = np.uint64(seed & (1 << 64) - 1) + k * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def draws(seed: int, clusters: int, resample: int) -> np.ndarray:
    """How often each cluster is drawn in a resample: SplitMix64 outputs modulo the number of clusters."""
    return np.bincount((splitmix(seed, resample * clusters, clusters) % np.uint64(clusters)).astype(np.int64), minlength=clusters)


def drawn(spark: SparkSession, clusters: dict[str, int], resamples: int, seed: int) -> DataFrame:
    """(class, code, times): for each cluster a byte for each resample, which says how often the cluster is drawn in it.

    A row of work is a resample and a block of its draws; it counts them over all codes and hands on a row for each CHUNK of codes. A chunk's rows of all
    resamples then become a row for each of its codes.
    """
    sides = [(i + 1, name, clusters.get(name, 0)) for i, name in enumerate(("author", "distractor"))]
    work = None
    for salt, name, n in sides:
        blocks = -(-n // DRAWS)
        own = spark.range(resamples * blocks).select(F.lit(salt).alias("salt"), F.lit(name).alias("class"), F.lit(n).cast("long").alias("n"), F.floor(F.col("id") / max(blocks, 1)).alias("resample"), (F.col("id") % max(blocks, 1)).alias("block"))
        work = own if work is None else work.unionByName(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for salt, name, n, resample, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = block * DRAWS
                counts = np.bincount((splitmix(seed + salt, resample * n + low, min(DRAWS, n - low)) % np.uint64(n)).astype(np.int64), minlength=n)
                if counts.max() > 255:
                    raise OverflowError("a cluster is drawn more often than a byte holds")
                raw = counts.astype(np.uint8).tobytes()
                parts = [raw[at : at + CHUNK] for at in range(0, n, CHUNK)]
                for at in range(0, len(parts), 256):
                    some = parts[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(np.arange(at, at + len(some))), pa.array([resample] * len(some), pa.int64()), pa.array(some, pa.binary())], names=["class", "chunk", "resample", "counts"])

    def turned(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's rows by resample become rows by code."""
        chunk, sums = key[1].as_py(), None
        for batch in batches:
            resample, counts = batch.column("resample").to_numpy(), batch.column("counts")
            if sums is None:
                sums = np.zeros((resamples, len(counts[0].as_buffer())), np.uint16)
            for i, r in enumerate(resample.tolist()):
                sums[r] += np.frombuffer(counts[i].as_buffer(), np.uint8)
        if sums.max() > 255:
            raise OverflowError("a cluster is drawn more often than a byte holds")
        rows = np.ascontiguousarray(sums.astype(np.uint8).T)
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(some)), pa.array(np.arange(chunk * CHUNK + at, chunk * CHUNK + at + len(some))), pa.array([r.tobytes() for r in some], pa.binary())], names=["class", "code", "times"])

    each = work.repartition("resample", "block").mapInArrow(run, "class string, chunk long, resample long, counts binary")
    return each.groupBy("class", "chunk").applyInArrow(turned, "class string, code long, times binary")


def resampled(
    distances: DataFrame, low: float | None = None, high: float | None = None, resamples: int = C.RESAMPLES, seed: int = C.BOOTSTRAP_SEED,
    author_target: float = C.AUTHOR_TARGET, distractor_target: float = C.DISTRACTOR_TARGET,
) -> DataFrame:
    """(resample, low, high, auc, author_error, distractor_error), one row per resample, whatever the number of distances.

    Clusters' distinct distances are counted once and dealt out by ranges of distances as narrow rows. They meet, twice, how often their cluster is drawn, a
    byte for each resample: once for the sum of each range, class and resample, which is what the driver sees, and once, sorted, when with what lies
    below it each range finds its own candidates for the thresholds and its part of the sums.
    """
    spark = distances.sparkSession
    rows = distances.where("distance is not null").select("class", F.col("document").cast("string").alias("document"), F.col("distance").cast("double").alias("distance"))
    cells = materialize(rows.groupBy("class", "document", "distance").agg(F.count("*").alias("ties")), "cells")
    labels = cells.select("class", "document").distinct().withColumn("one", F.lit(1).cast("long"))
    codes = materialize(cumulative(labels, "class", "document", "one").select("class", "document", F.col("below").alias("code")), "codes")
    clusters = {r[0]: r[1] for r in codes.groupBy("class").count().collect()}
    if not (clusters.get("author") and clusters.get("distractor")):
        return spark.range(resamples).select(F.col("id").alias("resample"), *[F.lit(None).cast("double").alias(c) for c in ("low", "high", "auc", "author_error", "distractor_error")])
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.join(codes, ["class", "document"]).select("distance", (F.col("class") == "distractor").alias("distractor"), "class", "code", "ties")
    dealt = materialize(dealt.repartitionByRange(ranges, "distance").withColumn("part", F.spark_partition_id()), "dealt")
    # the plan would take the drawn table for as small as the rows of work it comes from, and send all of it through the driver
    times = materialize(drawn(spark, clusters, resamples, seed), "drawn").hint("merge")

    def met(cells: DataFrame) -> DataFrame:
        return cells.join(times, ["class", "code"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            for i, (part, side, ties) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                own = total.setdefault((part, side), np.zeros(resamples, np.int64))
                raw = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8)
                own += raw if ties == 1 else raw * np.int64(ties)
        yield out(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            for part, side, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = total.setdefault((part, side), np.zeros(resamples, np.int64))
                own += np.frombuffer(raw, np.int64)
        yield out(total)

    def out(total: dict[tuple[int, bool], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.bool_()), pa.array([w.tobytes() for w in total.values()], pa.binary())], names=["part", "distractor", "weights"])

    kind = "part int, distractor boolean, weights binary"
    whole_cells = dealt.groupBy("part", "distractor", "class", "code").agg(F.sum("ties").alias("ties"))
    partial = met(whole_cells).select("part", "distractor", "ties", "times").mapInArrow(summed, kind)
    totals_ = partial.repartition(ranges, "part", "distractor").mapInArrow(again, kind)

    below: dict[int, np.ndarray] = {}
    sums: dict[int, np.ndarray] = {}
    for r in totals_.toLocalIterator():
        sums.setdefault(r["part"], np.zeros((2, resamples), np.int64))[int(r["distractor"])] += np.frombuffer(r["weights"], np.int64)
    whole = np.zeros((2, resamples), np.int64)
    for part in sorted(sums):
        below[part] = whole.copy()
        whole += sums[part]
    na, nd = whole
    enough = (na >= math.ceil(1 / author_target)) & (nd >= math.ceil(1 / distractor_target))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part: low and high within it, and its share of the sums, by resample."""
        state, part, held = None, None, None

        def settle(at: np.ndarray, weights: np.ndarray) -> None:
            """Whole distances in order: weights[i] are those of both classes at at[i]."""
            author, distractor = weights[:, 0], weights[:, 1]
            above = na - (state["below"][0] + np.cumsum(author, 0) - author)
            upto = state["below"][1] + np.cumsum(distractor, 0)
            lows, highs = (author > 0) & (above / na <= author_target), (distractor > 0) & (upto / nd <= distractor_target)
            state["low"] = np.fmin(state["low"], np.where(lows.any(0), at[lows.argmax(0)], np.nan))
            state["high"] = np.fmax(state["high"], np.where(highs.any(0), at[len(at) - 1 - highs[::-1].argmax(0)], np.nan))
            state["wins"] += (author * (nd - upto + distractor / 2)).sum(0)
            state["author"] += author[at >= high].sum(0) if high is not None else 0
            state["distractor"] += distractor[at <= low].sum(0) if low is not None else 0
            state["below"] += weights.sum(0)

        def ended() -> pa.RecordBatch:
            if held is not None:
                settle(*held)
            columns = [np.arange(resamples), *(state[c] for c in ("low", "high", "wins", "author", "distractor"))]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(float) if i else c, from_pandas=True) for i, c in enumerate(columns)], names=["resample", "low", "high", "wins", "author", "distractor"])

        for batch in batches:
            distance, side, of = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(int), batch.column(2).to_numpy()
            ties = batch.column(3).to_numpy()
            for own in np.unique(of):
                for chunk in np.array_split(np.flatnonzero(of == own), max(1, int((of == own).sum()) // 256)):
                    if own != part:
                        if part is not None:
                            yield ended()
                        part, held = own, None
                        state = {"below": below[int(own)].copy(), **{c: np.full(resamples, np.nan) for c in ("low", "high")}, **{c: np.zeros(resamples) for c in ("wins", "author", "distractor")}}
                    at, k = np.unique(distance[chunk], return_inverse=True)
                    weights = np.zeros((len(at), 2, resamples), np.int64)
                    for i, j in zip(chunk.tolist(), k.tolist(), strict=True):
                        weights[j, side[i]] += np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8) * ties[i]
                    if held is not None:  # the last distance may go on
                        if held[0][0] == at[0]:
                            weights[0] += held[1][0]
                        else:
                            at, weights = np.concatenate([held[0], at]), np.concatenate([held[1], weights])
                    if len(at) > 1:
                        settle(at[:-1], weights[:-1])
                    held = (at[-1:], weights[-1:])
        if part is not None:
            yield ended()

    sorted_ = met(dealt).select("distance", "distractor", "part", "ties", "times").repartition(ranges, "part").sortWithinPartitions("part", "distance")
    found = sorted_.mapInArrow(ranged, "resample long, low double, high double, wins double, author double, distractor double")
    one = found.groupBy("resample").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("wins").alias("wins"), F.sum("author").alias("author"), F.sum("distractor").alias("distractor"))
    totals = spark.createDataFrame([(i, int(na[i]), int(nd[i]), bool(enough[i])) for i in range(resamples)], "resample long, na long, nd long, enough boolean")
    both = F.col("enough") & F.col("low").isNotNull() & F.col("high").isNotNull()
    return one.join(F.broadcast(totals), "resample").select(
        "resample", F.when(both, F.col("low")).alias("low"), F.when(both, F.col("high")).alias("high"), (F.col("wins") / (F.col("na") * F.col("nd"))).alias("auc"),
        (F.col("author") / F.col("na") if high is not None else F.lit(None).cast("double")).alias("author_error"),
        (F.col("distractor") / F.col("nd") if low is not None else F.lit(None).cast("double")).alias("distractor_error"),
    )


def _at(values: list[float], index: int) -> float | None:
    return values[min(max(index, 0), len(values) - 1)] if values else None


def intervals(draws_: DataFrame, confidence: float = C.CONFIDENCE, min_qualified: float = C.MIN_QUALIFIED) -> DataFrame:
    """One row: order-statistic intervals of both thresholds, without interpolation, and whether they can be used."""
    rows = draws_.collect()  # a row per resample
    lows, highs = sorted(r["low"] for r in rows if r["low"] is not None), sorted(r["high"] for r in rows if r["low"] is not None)
    n, alpha = len(lows), 1 - confidence
    ends = [_at(v, math.floor(q * n)) for v in (lows, highs) for q in (alpha / 2, 1 - alpha / 2)]
    usable = bool(rows) and n / len(rows) >= min_qualified
    actionable = bool(n) and ends[1] < ends[2]
    reason = "insufficient-qualified-resamples" if not usable else "" if actionable else "overlapping-intervals"
    return draws_.sparkSession.createDataFrame([(*ends, n, len(rows), usable, actionable, usable and actionable, reason)], "low_lower double, low_upper double, high_lower double, high_upper double, qualified int, resamples int, usable boolean, actionable boolean, shippable boolean, reason string")


def error_bounds(draws_: DataFrame, author_clusters: int, distractor_clusters: int, confidence: float = C.CONFIDENCE, author_target: float = C.AUTHOR_TARGET, distractor_target: float = C.DISTRACTOR_TARGET) -> DataFrame:
    """Per claiming band: the larger of the one-sided bootstrap bound and 3 / clusters, and whether it is within the target."""
    rows, out = draws_.collect(), []  # a row per resample
    for band, col, clusters, target in (("not-you", "author_error", author_clusters, author_target), ("in-range", "distractor_error", distractor_clusters, distractor_target)):
        rates = sorted(r[col] for r in rows if r[col] is not None)
        if not rates or not clusters:
            out.append((band, None, False, "empty-error-class"))
            continue
        bound = max(_at(rates, math.floor(confidence * len(rates))), 3 / clusters)
        out.append((band, float(bound), bound <= target, "" if bound <= target else "error-bound-exceeds-target"))
    return draws_.sparkSession.createDataFrame(out, "band string, bound double, emitted boolean, reason string")


def auc_bound(draws_: DataFrame, clusters: int, floor: float = C.AUC_FLOOR, confidence: float = C.CONFIDENCE) -> DataFrame:
    """One row: the lower bound of AUC, at most 1 - 3 / clusters, and whether it reaches the floor."""
    values = sorted(r["auc"] for r in draws_.collect() if r["auc"] is not None)  # a row per resample
    bound = None if not values or not clusters else min(_at(values, math.floor((1 - confidence) * len(values))), 1 - 3 / clusters)
    return draws_.sparkSession.createDataFrame([(bound, bound is not None and bound >= floor)], "auc_lower double, passed boolean")


def release(limits: DataFrame, bounds: DataFrame, discrimination: DataFrame) -> DataFrame:
    """One row: a release ships if thresholds separate, AUC's bound reaches the floor and a claiming band is within its target."""
    b = bounds.agg(F.count_if("emitted").alias("emitted"))
    j = limits.crossJoin(b).crossJoin(discrimination)  # one row each
    reason = F.when(~F.col("passed"), "discrimination-failed").when((F.col("verdict") != "separated") | (F.col("emitted") == 0), "uncalibrated").otherwise("")
    return j.select("verdict", "emitted", "auc_lower", reason.alias("reason"), (reason == "").alias("shippable"))
