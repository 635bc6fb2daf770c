"""Gates between the steps: enough of a corpus, declared members, equal bindings, bands that may be claimed, reports that hold together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from .preserve import CLASSES

# --- fixed values: Roman digits ---
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def adequacy(admitted: DataFrame, paragraphs: DataFrame, key: str) -> DataFrame:
    """(key, documents, eligible, train, paragraphs, gate): the first requirement of a profile that isn't met, or empty.

    Documents count whatever their admission; paragraphs are those of train documents above the floor.
    """
    docs = admitted.groupBy(key).agg(F.count("*").alias("documents"), F.count_if(F.col("admission") == "eligible").alias("eligible"), F.count_if(F.col("split") == "train").alias("train"))
    held = paragraphs.where("split = 'train'").groupBy(key).agg(F.count("*").alias("paragraphs"))
    j = docs.join(held, key, "left").fillna(0, ["paragraphs"])
    gate = F.when(F.col("eligible") == 0, "no-eligible-document").when(F.col("documents") < C.MIN_DOCUMENTS, "too-few-documents").when(F.col("train") == 0, "no-train-document")
    return j.withColumn("gate", gate.when(F.col("paragraphs") < C.MIN_PARAGRAPHS, "too-few-paragraphs").otherwise(""))


def inactive_reason(rules: DataFrame, key: str) -> DataFrame:
    """(key, reason) of sets of rules (key, provenance, category, in_scope); empty if one may decide."""
    fit = (F.col("provenance") == "derived") & F.col("category").isin("author-deviation", "source-contamination")
    s = rules.groupBy(key).agg(F.bool_or(fit).alias("validated"), F.bool_or(fit & F.col("in_scope")).alias("active"))
    return s.select(key, F.when(F.col("active"), "").when(F.col("validated"), "no-rule-in-scope").otherwise("no-validated-rule").alias("reason"))


def calibrated_bands(distances: DataFrame, low: float, high: float, emitted: dict[str, bool], calibrated: bool = True) -> DataFrame:
    """Adds band and reason: a claim that isn't emitted falls to drifting; without a calibration, or a distance, there is none."""
    if calibrated and low > high:
        raise ValueError("the thresholds don't separate")
    d = F.col("distance")
    geometric = F.when(d <= low, "in-range").when(d >= high, "not-you").otherwise("drifting")
    withheld = [b for b, ok in emitted.items() if not ok]
    claimed = F.when(geometric.isin(withheld), "drifting").otherwise(geometric) if withheld else geometric
    reason = F.when(d.isNull(), "undefined-distance").when(~F.lit(calibrated), "uncalibrated").otherwise("")
    return distances.withColumn("reason", reason).withColumn("band", F.when(F.col("reason") == "", claimed))


def judged_segment(segments: Column, distance: Column, band: Column, candidate: bool, allow_uncalibrated: bool = False) -> Column:
    """Why a report can't be judged, or empty: it must be of one segment, measured, and in a band."""
    code = F.when(segments != 1, "not-one-segment").when(distance.isNull(), "candidate-unscoreable" if candidate else "unscoreable")
    return (code if allow_uncalibrated else code.when(band.isNull(), "uncalibrated")).otherwise("")


def strangers(segments: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Segments of documents that aren't declared members."""
    return segments.join(members.select(key).distinct(), key, "left_anti")


def mismatches(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, declared, found): keys that don't stand exactly once on both sides. Both are counted before they meet."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((declared, "declared"), (found, "found")))
    return a.join(b, key, "full").fillna(0, ["declared", "found"]).where("declared <> 1 or found <> 1")


def bound_alike(rows: DataFrame, key: str, *binding: str) -> DataFrame:
    """(key, rows, alike): whether all rows of a key have the same values in all binding columns, nulls included."""
    ends = [F.struct(*[f(F.struct(F.col(c).isNull(), c)) for c in binding]) for f in (F.min, F.max)]
    s = rows.groupBy(key).agg(F.count("*").alias("rows"), ends[0].alias("_low"), ends[1].alias("_high"))
    return s.select(key, "rows", (F.col("_low") == F.col("_high")).alias("alike"))


def ordered_differences(differences: DataFrame) -> DataFrame:
    """Adds ordinal within the pair: by class, lost before invented, by item."""
    rank = F.array_position(F.lit(list(CLASSES)), F.col("class"))
    return differences.withColumn("ordinal", F.row_number().over(Window.partitionBy("pair_id").orderBy(rank, F.desc("direction"), "item")) - 1)


def report_violations(reports: DataFrame) -> DataFrame:
    """(id, violation) of band reports (id, bound, target, clusters, emitted) that contradict themselves."""
    c = F.col
    finite = c("bound").isNotNull() & ~F.isnan("bound") & (F.abs("bound") < float("inf"))
    found = {
        "bound-not-finite": c("emitted") & ~finite,
        "decision": finite & (c("emitted") != (c("bound") <= c("target"))),
        "bound-below-floor": finite & (c("clusters") > 0) & (c("bound") < 3 / c("clusters")),
        "too-few-clusters": c("emitted") & (c("clusters") < F.ceil(3 / c("target"))),
    }
    each = F.array(*[F.when(bad, name) for name, bad in found.items()])
    return reports.select("id", F.explode(F.array_compact(each)).alias("violation"))


def roman(x: Column) -> Column:
    """The value of a Roman numeral, read from its end; 0 if it has any other character."""
    digits = F.transform(F.filter(F.split(F.reverse(x), ""), lambda d: d != ""), lambda d: F.coalesce(F.create_map(*[F.lit(v) for kv in ROMAN.items() for v in kv])[d], F.lit(0)))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def step(s: Column, v: Column) -> Column:
        smaller = v < s["most"]
        return F.struct(F.when(smaller, s["total"] - v).otherwise(s["total"] + v).alias("total"), F.greatest(s["most"], v).alias("most"))

    return F.when(x.rlike(f"^[{''.join(ROMAN)}]*$"), F.aggregate(digits, zero, step)["total"]).otherwise(0)


def leading_space(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.ltrim(x))
