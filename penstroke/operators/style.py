"""Six style features per segment, profiles, standardised deviations, rank transform, distance.

Features stay in long form (segment keys, feature, value, sampling variance) where rows are compared with
statistics by feature; those tables have six rows and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import count_in, exact_sum, probit, words
from ..functions.tables import cumulative, materialize

KEYS = ["doc_id", "seg"]
_COUNTED = sorted({*C.FUNCTION_WORDS, *C.CLAUSE_MARKERS})


def vectors(segments: DataFrame, text: str = "line", floor: int = 0) -> DataFrame:
    """Adds lexical count, the six values and their sampling variances (null where undefined) to each segment."""
    # as a generator's output tokens are made once, whatever is pushed below the columns that use them
    with_tokens = segments.withColumn("_t", F.explode(F.array(words(F.col(text)))))
    with_tokens = with_tokens.where(F.size("_t") >= floor) if floor else with_tokens
    # lower case in one go; what neither list has is left out once
    low = F.split(F.lower(F.array_join("_t", " ")), " ")
    with_tokens = with_tokens.withColumn("_fw", F.explode(F.array(F.filter(low, lambda x: x.isin(*_COUNTED)))))
    raw = with_tokens.select(
        *segments.columns,
        F.size("_t").alias("lexical"),
        F.char_length(F.array_join("_t", "")).cast("long").alias("_chars"),
        F.aggregate("_t", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x) * F.char_length(x)).alias("_squares"),
        *[(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c)))).alias(f"_n{k}") for k, c in enumerate(",;:")],
        count_in(F.col("_fw"), C.FUNCTION_WORDS).alias("_fw"),
        count_in(F.col("_fw"), C.CLAUSE_MARKERS).alias("_cm"),
    )
    d = F.when(F.col("lexical") > 0, F.col("lexical").cast("double"))
    mean = F.col("_chars") / d
    out = {"word_length_mean": mean, "sv_word_length_mean": F.when(d >= 2, F.greatest((F.col("_squares") - F.col("_chars") * mean) / (d - 1), F.lit(0.0)) / d)}
    for k, name in enumerate(("comma_density", "semicolon_density", "colon_density")):
        out |= {name: F.col(f"_n{k}") / d, f"sv_{name}": F.col(f"_n{k}") / d / d}
    for col, name in (("_fw", "function_word_rate"), ("_cm", "clause_marker_rate")):
        p = F.col(col) / d
        out |= {name: p, f"sv_{name}": p * (1 - p) / d}
    return raw.withColumns(out).drop("_chars", "_squares", "_n0", "_n1", "_n2", "_fw", "_cm")


def long_form(wide: DataFrame) -> DataFrame:
    keys = [c for c in wide.columns if c not in C.FEATURES and not c.startswith("sv_")]
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col(f"sv_{f}").alias("sv")) for f in C.FEATURES])
    return wide.select(*keys, F.explode(each).alias("_f")).select(*keys, "_f.feature", "_f.value", "_f.sv")


def profile(long: DataFrame, min_n: int = C.MIN_OBSERVATIONS) -> DataFrame:
    """Per feature: n, undefined, mean and sample variance, both null below min_n observations.

    Both have the same bits however the rows are dealt, as the last bits decide whether z that are equal but for rounding tie.
    Rows are read twice: they should be a written table.
    """
    # equal values have a variance of 0, not one of rounding
    mean = F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(exact_sum(F.col("value")) / F.count("value"))
    s = materialize(long.groupBy("feature").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("undefined"), mean.alias("mean")), "means")
    off = long.join(F.broadcast(s.select("feature", "mean")), "feature").withColumn("_off", F.col("value") - F.col("mean"))  # a row per feature
    squares = off.groupBy("feature").agg(exact_sum(F.col("_off") * F.col("_off")).alias("_squares"))
    ok = F.col("n") >= min_n
    variance = F.when(ok & (F.col("n") > 1), F.col("_squares") / (F.col("n") - 1))
    return s.join(F.broadcast(squares), "feature").select("feature", "n", "undefined", F.when(ok, F.col("mean")).alias("mean"), variance.alias("variance"))


def mad_trimmed(long: DataFrame, limit: float) -> DataFrame:
    """Keeps values within limit scaled median deviations of their feature's median; a limit or deviation of 0 keeps all."""
    med = long.groupBy("feature").agg(F.median("value").alias("med"))
    dev = long.join(F.broadcast(med), "feature").withColumn("dev", F.abs(F.col("value") - F.col("med")))  # a row per feature
    mad = dev.groupBy("feature").agg(F.median("dev").alias("mad"))
    bound = F.lit(limit * C.MAD_SCALE) * F.col("mad")
    kept = dev.join(F.broadcast(mad), "feature").where((F.lit(limit) == 0) | (F.col("mad") == 0) | (F.col("dev") <= bound))
    return kept.select(*long.columns)


def standardized(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds z = (x - mean) / sqrt(variance + sv), or null and the first reason that holds."""
    j = long.join(F.broadcast(stats.select("feature", "mean", "variance")), "feature")  # a row per feature
    spread = F.col("variance") + F.col("sv")
    reason = (
        F.when(F.col("value").isNull(), "feature-undefined")
        .when(F.col("sv").isNull(), "sampling-variance-undefined")
        .when(F.col("mean").isNull(), "profile-undefined")
        .when(F.col("variance").isNull(), "profile-variance-undefined")
        .when(spread <= 0, "zero-variance")
    )
    return j.withColumn("reason", reason).withColumn("z", F.when(F.col("reason").isNull(), (F.col("value") - F.col("mean")) / F.sqrt(spread)))


def reference_sizes(reference: DataFrame, minimum: int = C.MIN_REFERENCE) -> DataFrame:
    """Per feature: size, whether it is available, and the cap that size puts on a deviation."""
    s = reference.groupBy("feature").agg(F.count("z").alias("size"))
    s = s.withColumn("available", F.col("size") >= minimum).withColumn("_u", 1 - 1 / (2.0 * (F.col("size") + 1)))
    return s.select("feature", "size", "available", probit("_u").alias("cap"))


def deviations(query: DataFrame, reference: DataFrame, minimum: int = C.MIN_REFERENCE) -> DataFrame:
    """Adds u = (lower + ties / 2 + 1/2) / (n + 1) against the reference's z of the feature, and dev = probit(u).

    Distinct values of both sides are ranked together by range; queries then meet their value's rank by equality.
    """
    both = reference.where("z is not null").groupBy("feature", "z").agg(F.count("*").alias("ties"))
    asked = query.where("z is not null").select("feature", "z").distinct().withColumn("ties", F.lit(0).cast("long"))
    ranks = cumulative(both.unionByName(asked).groupBy("feature", "z").agg(F.sum("ties").alias("ties")), "feature", "z", "ties")
    sizes = reference.groupBy("feature").agg(F.count("z").alias("size"))
    # rows without a value have no rank; in the join, all of a feature would meet in one task
    ranked = query.where("z is not null").join(ranks, ["feature", "z"], "left")
    j = ranked.unionByName(query.where("z is null"), allowMissingColumns=True).join(F.broadcast(sizes), "feature", "left")  # a row per feature
    u = (F.col("below") + F.col("ties") / 2.0 + 0.5) / (F.col("size") + 1)
    reason = F.coalesce("reason", F.when(F.coalesce("size", F.lit(0)) < minimum, "reference-too-small"))
    j = j.withColumn("reason", reason).withColumn("u", F.when(F.col("reason").isNull(), u))
    return j.withColumn("dev", F.when(F.col("u").isNotNull(), probit("u"))).drop("ties", "below", "size")


def distances(devs: DataFrame, keys: list[str], minimum: int = C.MIN_FEATURES) -> DataFrame:
    """Mean absolute deviation over the defined features, null with fewer than the tier's minimum."""
    d = devs.groupBy(*keys).agg(F.count("dev").alias("available"), F.avg(F.abs("dev")).alias("_d"))
    met = F.col("available") >= minimum
    return d.select(*keys, "available", met.alias("met"), F.when(met, F.col("_d")).alias("distance"))


def deltas(devs: DataFrame) -> DataFrame:
    return devs.withColumn("direction", F.when(F.col("dev") > 0, "above").when(F.col("dev") < 0, "below").when(F.col("dev") == 0, "typical"))
