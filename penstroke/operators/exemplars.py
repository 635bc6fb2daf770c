"""Representative segments: self-ranked vectors, density by nearest neighbours, an eligibility cut, medoids by stratum, and the record of the choice.

Distance is the mean absolute difference over the features that both have, of which there must be three. Neighbours are exact at any number of
candidates: equal vectors are one point with a weight; points are dealt to blocks by a tree of splits, which is fitted on a bounded sample and need
not be good to be right; each point meets its own block, and then the blocks whose bounding box isn't farther away than its k-th
best so far. Sums of distances to all others, which medoids are chosen by, need no pairs: over a feature they follow from how many values lie
below and what they add up to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import content_id, probit
from ..functions.tables import cumulative, materialize

#: Features that two vectors must share.
SHARED = 3
#: Points that a block is meant to have, rows of the sample that splits are fitted on, and splits one after another at most.
BLOCK, SAMPLE, DEPTH = 1024, 1 << 17, 14
#: Points that meet a block in one task.
ASKED = 20_000
NAMES = list(C.FEATURES)


def self_ranked(long: DataFrame) -> DataFrame:
    """Adds u = (lower + ties / 2 + 1/2) / (n + 1) within the feature's own values, and its normal quantile."""
    ranks = cumulative(long.where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("ties")), "feature", "value", "ties")
    sizes = long.groupBy("feature").agg(F.count("value").alias("size"))
    j = long.join(ranks, ["feature", "value"], "left").join(F.broadcast(sizes), "feature")  # a row per feature
    j = j.withColumn("u", (F.col("below") + F.col("ties") / 2.0 + 0.5) / (F.col("size") + 1)).drop("ties", "below", "size")
    return j.withColumn("q", F.when(F.col("u").isNotNull(), probit("u")))


def wide(ranked: DataFrame) -> DataFrame:
    """(id, a column for each feature's q)."""
    return ranked.groupBy("id").agg(*[F.max(F.when(F.col("feature") == f, F.col("q"))).alias(f) for f in NAMES])


def pair_distances(x: np.ndarray, y: np.ndarray, shared: int = SHARED) -> np.ndarray:
    """Mean absolute difference over features that both have; infinite below the shared minimum."""
    total, n = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for f in range(x.shape[1]):
        d = np.abs(x[:, f, None] - y[None, :, f])
        ok = ~np.isnan(d)
        total += np.where(ok, d, 0)
        n += ok
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n >= shared, total / n, np.inf)


def nearest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """The k least distances of each x to the points y, each counted as often as its weight says; own: the y that x itself is one of."""
    out = np.full((len(x), k), np.inf)
    for low in range(0, len(x), 256):
        d = pair_distances(x[low : low + 256], y)
        rows = np.arange(len(d))[:, None]
        # one more than k, as its own point may be among them and count for nothing
        few = min(k + 1, d.shape[1])
        at = np.argpartition(d, few - 1, axis=1)[:, :few]
        if own is not None:  # its own point is always looked at
            mine = own[low : low + 256, None]
            at = np.where((at == mine).any(1, keepdims=True), at, np.concatenate([at[:, :-1], mine], 1))
        at = at[rows, np.argsort(d[rows, at], axis=1, kind="stable")]
        times = weight[at] if own is None else weight[at] - (at == own[low : low + 256, None])
        upto, best = np.cumsum(times, 1), np.concatenate([d[rows, at], np.full((len(d), 1), np.inf)], 1)
        for j in range(k):
            out[low : low + 256, j] = best[rows[:, 0], (upto <= j).sum(1)]
    return out


def splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, value) of the nodes of a tree of the given depth, the root being 1: medians of the feature that spreads widest."""
    feature, value = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
    todo = [(1, sample)]
    while todo:
        node, own = todo.pop()
        if node >= 1 << depth or len(own) < 2:
            continue
        feature[node] = own.std(0).argmax()
        value[node] = np.median(own[:, feature[node]])
        right = own[:, feature[node]] > value[node]
        todo += [(2 * node, own[~right]), (2 * node + 1, own[right])]
    return feature, value


def leaf_of(x: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    for _ in range(int(len(value)).bit_length() - 1):
        node = 2 * node + (x[np.arange(len(x)), feature[node]] > value[node])
    return node


def bounds(x: np.ndarray, low: np.ndarray, high: np.ndarray, shared: int = SHARED) -> np.ndarray:
    """For each x and each box (a box's features are those without nan) what no distance to a point of the box is below."""
    total, n = np.zeros((len(x), len(low))), np.zeros((len(x), len(low)))
    for f in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, f] - x[:, f, None], x[:, f, None] - high[None, :, f]), 0)
        ok = ~np.isnan(gap)
        total += np.where(ok, gap, 0)
        n += ok
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n >= shared, total / n, np.inf)


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(f).to_numpy(**({"zero_copy_only": False} if isinstance(batch, pa.RecordBatch) else {})).astype(float) for f in NAMES], 1)


def neighbourhood(n: int) -> int:
    """How many neighbours make a density."""
    return min(max(math.isqrt(n), 3), 15)


def densities(ranked: DataFrame, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(id, density): the mean distance to the k nearest others, k = sqrt(n) within 3 to 15; null with fewer valid ones."""
    rows = materialize(wide(ranked), "vectors")
    n = rows.count()
    k, columns = neighbourhood(n), ", ".join(f"{f} double" for f in NAMES)
    points = materialize(rows.groupBy(*NAMES).agg(F.count("*").alias("weight")).withColumn("point", F.monotonically_increasing_id()), "points")
    size = points.count()
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(size, 1) / block))))
    share = min(1.0, sample / max(size, 1))
    seen = points.select(*NAMES) if share == 1.0 else points.select(*NAMES).where(F.pmod(F.xxhash64("point"), F.lit(1 << 30)) < int(share * (1 << 30)))
    fitted = splits(np.nan_to_num(seen.limit(2 * sample).toPandas().to_numpy(float).reshape(-1, len(NAMES))), depth)  # a sample of bounded size

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            mask = (~np.isnan(x) * (1 << np.arange(len(NAMES)))).sum(1)
            yield batch.append_column("block", pa.array((mask << 20) + leaf_of(np.nan_to_num(x), *fitted)))

    dealt = materialize(points.mapInArrow(placed, f"{columns}, weight long, point long, block long"), "blocks")
    # a row for each block: at most 2^DEPTH for each set of features that occurs
    boxes = dealt.groupBy("block").agg(*[F.min(f).alias(f"l{i}") for i, f in enumerate(NAMES)], *[F.max(f).alias(f"h{i}") for i, f in enumerate(NAMES)]).orderBy("block").toPandas()
    number, low, high = boxes["block"].to_numpy(np.int64), *(boxes[[f"{c}{i}" for i in range(len(NAMES))]].to_numpy(float) for c in "lh")

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(x.reshape(-1)))

    def within(group: pa.Table) -> pa.Table:
        x, weight = _matrix(group), group.column("weight").to_numpy()
        best = nearest(x, x, weight, k, np.arange(len(x)))
        return group.drop_columns(["weight"]).append_column("best", lists(best))

    own = materialize(dealt.groupBy("block").applyInArrow(within, f"{columns}, point long, block long, best array<double>"), "within")

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                limit = np.asarray([b[-1] for b in batch.column("best").to_pylist()])
                bound = bounds(_matrix(batch), low, high)
                # a box whose points share too few features is infinitely far away and never asked
                row, box = np.nonzero((bound <= limit[:, None]) & np.isfinite(bound) & (number[None, :] != batch.column("block").to_numpy()[:, None]))
                yield batch.select([*NAMES, "point"]).take(pa.array(row)).append_column("block", pa.array(number[box]))

    asked = materialize(own.mapInArrow(asking, f"{columns}, point long, block long"), "asked")
    salts = asked.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("salts"))  # a row for each block
    left = asked.join(F.broadcast(salts), "block").withColumn("salt", F.pmod(F.xxhash64("point"), F.col("salts")).cast("int")).drop("salts")
    right = dealt.join(F.broadcast(salts), "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def across(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        best = nearest(_matrix(mine), _matrix(theirs), theirs.column("weight").to_numpy(), k) if mine.num_rows and theirs.num_rows else np.full((mine.num_rows, k), np.inf)
        return pa.table([mine.column("point"), lists(best)], names=["point", "best"])

    others = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(across, "point long, best array<double>")
    every = own.select("point", "best").unionByName(others).groupBy("point").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    mean = F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / k
    found = points.join(every, "point").select(*NAMES, "weight", F.when(mean < float("inf"), mean).alias("density"))
    # a vector of very many candidates is broadcast: there are fewer than a thousand of them
    hot = F.col("weight") * 1000 > n
    same = [rows[f].eqNullSafe(F.col(f"_{f}")) for f in NAMES]
    named = found.select(*[F.col(f).alias(f"_{f}") for f in NAMES], "weight", "density")
    often = rows.join(F.broadcast(named.where(hot).select(*[f"_{f}" for f in NAMES], F.struct("density").alias("often"))), same, "left").select("id", *NAMES, "often")
    rest = named.where(~hot).select(*[f"_{f}" for f in NAMES], "density")
    cold = often.where("often is null")
    cold = cold.join(rest, [cold[f].eqNullSafe(rest[f"_{f}"]) for f in NAMES], "left").select("id", "density")
    return cold.unionByName(often.where("often is not null").select("id", "often.density"))


def eligible(dense: DataFrame, share: float = 0.75) -> DataFrame:
    """The lowest ceil(share * n) densities, ties by id. n counts all candidates."""
    n = dense.count()
    return dense.where("density is not null").orderBy("density", "id").limit(math.ceil(share * n))


def strata(candidates: DataFrame) -> DataFrame:
    """(stratum, size, place): largest first, ties by key."""
    return candidates.groupBy("stratum").agg(F.count("*").alias("size")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "stratum")))  # a row per stratum


def _mask() -> Column:
    out = F.lit(0)
    for i, f in enumerate(NAMES):
        out = out + F.when(F.col(f).isNotNull(), 1 << i).otherwise(0)
    return out


def distance_sums(members: DataFrame) -> DataFrame:
    """(id, stratum, features, mask, total, partners) from a written table (id, stratum, features): what the valid distances to all others of the
    stratum add up to, and how many they are."""
    own = members.withColumn("mask", _mask())
    masks = own.groupBy("stratum", "mask").agg(F.count("*").alias("members"))
    each = own.select("id", "stratum", "mask", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("q")) for i, f in enumerate(NAMES)])).alias("v")).select("id", "stratum", "mask", "v.f", "v.q").where("q is not null")
    # every value meets every set of features of its stratum that has this one: at most 42 sets
    their = masks.select("stratum", F.col("mask").alias("their"), "members")
    shared = F.bit_count(F.col("mask").bitwiseAND(F.col("their")))
    met = each.join(their, "stratum").where(F.expr("shiftright(their, f) & 1 = 1") & (shared >= SHARED))
    group = F.to_json(F.struct("stratum", "their", "f"))
    asked = met.select(group.alias("g"), "q", F.when(F.col("mask") == F.col("their"), 1).otherwise(0).cast("long").alias("one"))
    values = materialize(asked.groupBy("g", "q").agg(F.sum("one").alias("ties")).withColumn("mass", F.col("q") * F.col("ties")), "values")
    under = cumulative(values.select("g", "q", "ties"), "g", "q", "ties").withColumnRenamed("below", "n_below")
    mass = cumulative(values.select("g", "q", "mass"), "g", "q", "mass").select("g", "q", F.col("below").alias("m_below"))
    whole = values.groupBy("g").agg(F.sum("ties").alias("n_all"), F.sum("mass").alias("m_all"))
    sums = under.join(mass, ["g", "q"]).join(whole, "g")
    spread = F.col("q") * F.col("n_below") - F.col("m_below") + (F.col("m_all") - F.col("m_below") - F.col("q") * F.col("ties")) - F.col("q") * (F.col("n_all") - F.col("n_below") - F.col("ties"))
    part = met.withColumn("g", group).join(sums.select("g", "q", spread.alias("spread")), ["g", "q"]).select("id", (F.col("spread") / shared).alias("part"))
    total = part.groupBy("id").agg(F.sum("part").alias("total"))
    count = own.select("stratum", "mask").distinct().join(their, "stratum").where(shared >= SHARED).groupBy("stratum", "mask").agg(F.sum(F.col("members") - F.when(F.col("mask") == F.col("their"), 1).otherwise(0)).alias("partners"))
    return own.join(total, "id", "left").join(F.broadcast(count), ["stratum", "mask"], "left").fillna(0, ["total", "partners"])


@dataclass(frozen=True)
class Selection:
    """What was chosen, and what it takes to check it. ties: records of what an order by id decided."""

    selection_id: str
    k: int
    density: DataFrame
    medoids: DataFrame
    ties: DataFrame


def medoids(ranked: DataFrame, chosen: DataFrame, n: int = 3) -> tuple[list[tuple], list[tuple]]:
    """(picks (round, stratum, id, sum), ties) of up to n picks: by round, each stratum in turn gives its remaining member of the least distance sum.

    chosen: (id, stratum). Sums are compared at 6 decimals, ties go by id. A member that shares too few features with all others is picked only as the last.
    """
    members = materialize(wide(ranked).join(chosen.select("id", "stratum"), "id"), "members")
    sums = materialize(distance_sums(members), "sums")
    sizes = members.groupBy("stratum").agg(F.count("*").alias("size"))
    order = [(r["stratum"], r["size"]) for r in sizes.orderBy(F.desc("size"), "stratum").limit(n).collect()]  # no more strata than picks are asked
    first = sizes.groupBy("size").agg(F.min("stratum").alias("stratum"), F.count("*").alias("n")).where("n > 1")
    ties = [("stratum-order", 0, r["stratum"]) for r in first.orderBy(F.desc("size")).collect()]
    picks: list[tuple] = []
    taken: dict[str, list] = {s: [] for s, _ in order}
    round_ = 0
    while len(picks) < n:
        round_ += 1
        before = len(picks)
        for s, size in order:
            if len(picks) == n or len(taken[s]) == size:
                continue
            left = sums.where(F.col("stratum") == s).where(~F.col("id").isin([p["id"] for p in taken[s]]) if taken[s] else F.lit(True))
            total, partners = F.col("total"), F.col("partners")
            for p in taken[s]:  # what was picked no longer counts
                terms = [F.abs(F.col(f) - F.lit(p[f])) for f in NAMES if p[f] is not None]
                both = [F.col(f).isNotNull().cast("int") for f in NAMES if p[f] is not None]
                shared = sum(both, F.lit(0))
                d = F.when(shared >= SHARED, sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)) / shared)
                total, partners = total - F.coalesce(d, F.lit(0.0)), partners - d.isNotNull().cast("int")
            alone = size - len(taken[s]) == 1
            ranked_ = left.withColumns({"sum": F.lit(0.0) if alone else F.round(total, 6), "left": partners}).where(F.lit(alone) | (F.col("left") > 0))
            best = ranked_.orderBy("sum", "id").limit(2).collect()
            if not best:
                continue
            if len(best) == 2 and best[0]["sum"] == best[1]["sum"]:
                ties.append(("medoid", round_, str(best[0]["id"])))
            taken[s].append(best[0])
            picks.append((round_, s, best[0]["id"], float(best[0]["sum"])))
        if len(picks) == before:
            break
    return picks, ties


def select(ranked: DataFrame, stratum: DataFrame, n: int = 3) -> Selection:
    """Picks n representative segments of ranked vectors; stratum: (id, stratum). Refuses populations of fewer than 30 or 10 n, and fewer eligible ones than n."""
    dense = materialize(densities(ranked).withColumn("density", F.round("density", 6)), "density")
    population = dense.count()
    if population < max(30, 10 * n):
        raise ValueError(f"population-too-small: {population}")
    kept = materialize(eligible(dense), "eligible")
    keep = kept.count()
    if keep < n:
        raise ValueError(f"insufficient-eligible: {keep}")
    last = kept.orderBy(F.desc("density"), F.desc("id")).first()
    also = dense.where(F.col("density") == last["density"]).where(F.col("id") > F.lit(last["id"])).isEmpty()
    picks, ties = medoids(ranked, kept.join(stratum, "id"), n)
    if len(picks) < n:
        raise ValueError(f"insufficient-eligible: {len(picks)}")
    ties = [*([] if also else [("eligibility", 0, str(last["id"]))]), *ties]
    spark, kind = ranked.sparkSession, dict(ranked.dtypes)["id"]
    name = spark.range(1).select(content_id(*[F.lit(str(p[2])) for p in picks]).alias("id")).first()["id"]
    flagged = dense.join(kept.select("id", F.lit(True).alias("eligible")), "id", "left").fillna(False, ["eligible"])
    return Selection(name, neighbourhood(population), flagged, spark.createDataFrame(picks, f"round int, stratum string, id {kind}, distance_sum double"), spark.createDataFrame(ties, "tie string, round int, what string"))
