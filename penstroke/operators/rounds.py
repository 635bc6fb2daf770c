"""Rewriting in rounds over all targets at once.

A target is a paragraph that is measured; each round meets it with its next candidate, names the first guard that the candidate fails, and moves to the
candidate if there is none. State is one row a target in a written table, so that a round is two joins whatever the number of targets, and a lost
executor costs a part of one round. What is invariant is held against the original (preserved items, growth in length, overgrown scripts); what may
improve is held against the state (features, scripts, tells, distance).

A measured text is (key, segments, distance, banded, features, lexical, scripts, errors, warns, infos, comparable): how many paragraphs it is, its
distance (null if undefined), whether that falls in a calibrated band, the features that the distance rests on, lexical tokens, scripts, and its
tells. A missing or empty candidate ends a target. Defined results: a null count is 0, a null list is empty, null flags are false but for `comparable`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import lexical_tokens
from ..functions.tables import materialize
from . import preserve

MEASURED = ["segments", "distance", "banded", "features", "lexical", "scripts", "errors", "warns", "infos", "comparable"]
#: What a candidate is beside its measurement, all against the original: items kept, scripts overgrown, whether it splices back as one leaf.
AGAINST = ["empty", "preserved", "overgrown", "intact"]
ATTEMPT = ["target", "index", "code", "accepted", "distance", "current_distance", "preserved", "introduced", "overgrown", "comparison", "comparable", "intact", "lexical", "original_lexical"]


@dataclass(frozen=True)
class Outcome:
    """targets: (target, terminal, reason, changed, accepted, distance); attempts: a row for each candidate that was judged."""

    targets: DataFrame
    attempts: DataFrame


def _filled(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    out = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("segments", "lexical", "errors", "warns", "infos")} | {c: F.coalesce(c, none) for c in ("features", "scripts")})
    return out.withColumns({"banded": F.coalesce("banded", F.lit(False)), "comparable": F.coalesce("comparable", F.lit(True))})


def unjudged(of: str, candidate: bool, allow_uncalibrated: bool) -> Column:
    """Why a measured text (a struct column) can't be judged, or the empty text."""
    x = F.col(of)
    code = F.when(x["segments"] != 1, "not-one-segment").when(x["distance"].isNull(), "candidate-unscoreable" if candidate else "unscoreable")
    return (code if allow_uncalibrated else code.when(~x["banded"], "uncalibrated")).otherwise("")


def tells(a: str) -> Column:
    x = F.col(a)
    return F.struct(x["errors"], x["warns"], x["infos"])


def verdict(allow_uncalibrated: bool, expansion: float, epsilon: float) -> Column:
    """The first guard that the candidate `new` fails against `original` and the state `now`, all 13 codes in their order, or the empty text."""
    now, new = F.col("now"), F.col("new")
    return (
        F.when(unjudged("new", True, allow_uncalibrated) != "", unjudged("new", True, allow_uncalibrated))
        .when(F.array_sort(now["features"]) != F.array_sort(new["features"]), "different-features")
        .when(~F.col("preserved"), "not-preserved")
        .when(new["lexical"] > F.lit(expansion) * F.col("original")["lexical"], "expanded")
        .when(F.size(F.array_except(new["scripts"], now["scripts"])) > 0, "language")
        .when(F.col("overgrown"), "language-growth")
        .when(~(now["comparable"] & new["comparable"]), "tells-incomparable")
        .when(tells("new") > tells("now"), "tells-worse")
        .when(new["distance"] > now["distance"] - F.lit(epsilon), "not-improved")
        .when(~F.col("intact"), "not-spliceable")
        .otherwise("")
    )


def run(targets: DataFrame, candidates: DataFrame, attempts: int = 3, allow_uncalibrated: bool = False, expansion: float = C.EXPANSION, epsilon: float = C.EPSILON) -> Outcome:
    """Rounds over targets (target, MEASURED) and candidates (target, index, MEASURED, AGAINST); index counts from 0, one candidate an index."""
    if attempts <= 0:
        raise ValueError("attempts")
    flags = {c: F.coalesce(c, F.lit(False)) for c in AGAINST}
    offered = _filled(candidates).withColumns(flags).where(F.col("index") < attempts)
    offered = materialize(offered.select("target", F.col("index").cast("int").alias("index"), F.struct(*MEASURED).alias("new"), *AGAINST), "candidates")
    start = _filled(targets).select("target", F.struct(*MEASURED).alias("original")).withColumn("now", F.col("original"))
    reason = unjudged("now", False, allow_uncalibrated)
    state = start.withColumns({"reason": reason, "terminal": F.when(reason != "", "not-entered"), "accepted": F.lit(-1)})
    state = materialize(state, "state")
    rows: list[DataFrame] = []
    for index in range(attempts):
        own = offered.where(F.col("index") == index).drop("index")
        met = state.join(own, "target", "left")
        live = F.col("terminal").isNull()
        gone = live & (F.col("new").isNull() | F.col("empty"))
        code = F.when(live & ~gone, verdict(allow_uncalibrated, expansion, epsilon))
        met = materialize(met.withColumn("code", code).withColumn("terminal", F.when(gone, "empty-provider-response").otherwise(F.col("terminal"))), f"round{index}")
        accepted = F.col("code") == ""
        judged = F.col("code").isNotNull()
        new, now = F.col("new"), F.col("now")
        comparison = F.when(tells("new") > tells("now"), 1).when(tells("new") < tells("now"), -1).otherwise(0)
        record = {
            "index": F.lit(index), "accepted": accepted, "distance": new["distance"], "current_distance": now["distance"], "introduced": F.array_sort(F.array_except(new["scripts"], now["scripts"])),
            "comparison": comparison, "comparable": now["comparable"] & new["comparable"], "lexical": new["lexical"], "original_lexical": F.col("original")["lexical"],
        }
        rows.append(met.where(judged).withColumns(record).select(*ATTEMPT))
        moved = {"now": F.when(accepted, new).otherwise(now), "accepted": F.when(accepted, index).otherwise(F.col("accepted"))}
        state = materialize(met.withColumns(moved).select(*state.columns), "state")
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    terminal = F.coalesce("terminal", F.lit("attempts-exhausted"))
    done = state.select("target", terminal.alias("terminal"), "reason", (F.col("accepted") >= 0).alias("changed"), "accepted", F.col("now")["distance"].alias("distance"))
    return Outcome(done, every)


def against(texts: DataFrame, tells_of: DataFrame | None = None) -> DataFrame:
    """(target, index, lexical, scripts, errors, warns, infos, comparable, empty, preserved, overgrown) of candidates (target, index, original, text).

    tells_of: (target, index, errors, warns, infos) of those that have any; without it nothing can be compared.
    """
    key = F.to_json(F.struct("target", "index"))
    named = materialize(texts.select("target", "index", key.alias("pair_id"), F.coalesce("original", F.lit("")).alias("current"), F.coalesce("text", F.lit("")).alias("candidate")), "candidates")
    changed = preserve.differences(named).select("pair_id").distinct().withColumn("changed", F.lit(True))
    old, new = (preserve.script_counts(named, "pair_id", c) for c in ("current", "candidate"))
    grown = preserve.overgrown(old, new, "pair_id").select("pair_id").distinct().withColumn("overgrown", F.lit(True))
    scripts = new.groupBy("pair_id").agg(F.array_sort(F.collect_list("script")).alias("scripts"))
    j = named.join(changed, "pair_id", "left").join(grown, "pair_id", "left").join(scripts, "pair_id", "left")
    out = j.select(
        "target", "index", F.size(lexical_tokens(F.col("candidate"))).alias("lexical"), F.coalesce("scripts", F.array().cast("array<string>")).alias("scripts"),
        (F.col("candidate") == "").alias("empty"), F.col("changed").isNull().alias("preserved"), F.col("overgrown").isNotNull().alias("overgrown"),
    )
    if tells_of is None:
        return out.withColumns({c: F.lit(0) for c in ("errors", "warns", "infos")} | {"comparable": F.lit(False)})
    return out.join(tells_of.select("target", "index", "errors", "warns", "infos"), ["target", "index"], "left").fillna(0, ["errors", "warns", "infos"]).withColumn("comparable", F.lit(True))
