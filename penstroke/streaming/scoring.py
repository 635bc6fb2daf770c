"""Scoring paragraphs of a stream against a fixed profile and reference. All steps are row by row; nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import probit
from ..operators import style


def scored(stream: DataFrame, stats: DataFrame, reference: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(keys, distance) of lines of a stream (doc_id, seg, line); the reference's sorted values are checked to be at most `most`."""
    if reference.count() > most:
        raise ValueError(f"a reference of more than {most} values")
    arrays = {r["feature"]: sorted(r["v"]) for r in reference.where("z is not null").groupBy("feature").agg(F.collect_list("z").alias("v")).collect()}
    rows = {r["feature"]: r for r in stats.collect()}  # a row per feature
    wide = style.vectors(stream, floor=C.MIN_LEXICAL)
    devs = []
    for f in C.FEATURES:
        s, ref = rows.get(f), arrays.get(f, [])
        if s is None or s["mean"] is None or s["variance"] is None or len(ref) < C.MIN_REFERENCE:
            continue
        z = (F.col(f) - s["mean"]) / F.sqrt(F.when(F.col(f"sv_{f}") + s["variance"] > 0, F.col(f"sv_{f}") + s["variance"]))
        wide = wide.withColumn(f"z_{f}", z)
        values = F.lit(ref)
        at = F.col(f"z_{f}")
        below, upto = F.size(F.filter(values, lambda v: v < at)), F.size(F.filter(values, lambda v: v <= at))
        wide = wide.withColumn(f"u_{f}", F.when(F.col(f"z_{f}").isNotNull(), (below + (upto - below) / 2.0 + 0.5) / (len(ref) + 1)))
        devs.append(F.abs(probit(f"u_{f}")))
    got = F.filter(F.array(*devs), lambda d: d.isNotNull()) if devs else F.array().cast("array<double>")
    mean = F.aggregate(got, F.lit(0.0), lambda a, d: a + d) / F.size(got)
    return wide.select("doc_id", "seg", F.when(F.size(got) >= C.MIN_FEATURES, mean).alias("distance"))
