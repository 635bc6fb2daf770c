"""What a rewrite must keep: multisets of numbers, entities, negations, addresses and quotes; scripts; the order of rejections.

Pairs have pair_id, current, candidate. Items are counted per pair and class on both sides and compared by a
full outer join, dealt out by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import QUOTE, URL, extract_all, lexical_tokens, numbers

CLASSES = ("number", "entity", "negation", "url", "quote")
_NEGATIONS = [*C.NEGATIONS, *C.NEGATIVE_CONTRACTIONS, *[w.replace("'", "’") for w in C.NEGATIVE_CONTRACTIONS]]


def urls(x: Column) -> Column:
    return F.filter(F.transform(extract_all(x, URL), lambda u: F.regexp_replace(u, "[.,;:!?)\\]}\"'”’]+$", "")), lambda u: u != "")


def quotes(x: Column) -> Column:
    """Quotes up to the first mark that is opened and never closed."""
    closed = lambda q: (q.startswith('"') & q.endswith('"') & (F.length(q) > 1)) | (q.startswith("“") & q.endswith("”"))
    return F.filter(extract_all(x, QUOTE), closed)


def entities(x: Column) -> Column:
    words = F.lit(list(C.FUNCTION_WORDS))
    return F.filter(lexical_tokens(x), lambda t: t.rlike("^\\p{Lu}") & ~F.array_contains(words, F.lower(t)))


def items(x: Column) -> Column:
    """Array of (class, item) of the classes that one side alone decides."""
    negations = F.lit(_NEGATIONS)
    by_class = {"number": numbers(x), "negation": F.filter(F.transform(lexical_tokens(x), lambda t: F.lower(t)), lambda t: F.array_contains(negations, t)), "url": urls(x), "quote": quotes(x)}

    def marked(v: Column, name: str) -> Column:
        return F.transform(v, lambda i: F.struct(F.lit(name).alias("class"), i.alias("item")))

    return F.concat(*[marked(v, k) for k, v in by_class.items()])


def differences(pairs: DataFrame) -> DataFrame:
    """(pair_id, class, item, direction, n): items whose count differs, lost or invented, n by how many.

    An entity is a token that starts upper-case on either side; it is then counted, in any case, on both.
    """
    watched = F.array_distinct(F.transform(F.concat(entities(F.col("current")), entities(F.col("candidate"))), lambda t: F.lower(t)))
    both = pairs.select("pair_id", "current", "candidate", watched.alias("watched"))

    def side(name: str, sign: int) -> DataFrame:
        seen = F.filter(F.transform(lexical_tokens(F.col(name)), lambda t: F.lower(t)), lambda t: F.array_contains("watched", t))
        all_items = F.concat(items(F.col(name)), F.transform(seen, lambda t: F.struct(F.lit("entity").alias("class"), t.alias("item"))))
        return both.select("pair_id", F.explode(all_items).alias("i"), F.lit(sign).alias("sign")).select("pair_id", "i.class", "i.item", "sign")

    net = side("candidate", 1).unionByName(side("current", -1)).groupBy("pair_id", "class", "item").agg(F.sum("sign").alias("net")).where("net <> 0")
    return net.select("pair_id", "class", "item", F.when(F.col("net") > 0, "invented").otherwise("lost").alias("direction"), F.abs("net").alias("n"))


def audit_id(class_: Column, direction: Column, item: Column) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("\u0000", F.lit("preserve-v1"), class_, direction, item), 256), 1, 16)
    return F.concat_ws(":", F.lit("preserve-v1"), class_, direction, digest)


def scripts(spark: SparkSession) -> list[str]:
    """Names of all Unicode scripts that the JVM knows but the shared ones."""
    names = [s.name() for s in spark.sparkContext._jvm.java.lang.Character.UnicodeScript.values()]
    return ["_".join(part.capitalize() for part in n.split("_")) for n in names if n not in ("COMMON", "INHERITED", "UNKNOWN")]


def script_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, script, letters) for scripts that the text has letters of; letters that scripts share count for none.

    Scripts are looked for among the text's distinct letters first, so that a text is counted for its own scripts alone.
    """
    # ASCII letters are all Latin, so that one stands for them; runs of other characters go at once
    rest = F.regexp_replace(text, "[\\P{L}a-zA-Z]+", "")
    latin = F.when(F.col(text).rlike("[a-zA-Z]"), "a").otherwise("")
    letters = F.concat(latin, F.array_join(F.array_distinct(extract_all(rest, "\\p{L}")), ""))
    df = df.select(key, text, letters.alias("_letters"))

    def count(s: str) -> Column:
        pattern = f"[\\p{{L}}&&\\p{{Is{s}}}]"
        kept = F.regexp_replace(text, f"[\\P{{L}}\\P{{Is{s}}}]+", "")
        return F.when(F.col("_letters").rlike(pattern), F.char_length(kept)).otherwise(0)

    each = F.array(*[F.struct(F.lit(s).alias("script"), count(s).alias("letters")) for s in scripts(df.sparkSession)])
    return df.select(key, F.explode(each).alias("x")).select(key, "x.script", "x.letters").where("letters > 0")


def overgrown(original: DataFrame, candidate: DataFrame, key: str, established: float = C.SCRIPT_ESTABLISHED, ceiling: float = C.SCRIPT_CEILING) -> DataFrame:
    """Scripts of the candidate that weren't established, exceed the ceiling, and either grew in letters and share or took over."""
    def shared(df: DataFrame, n: str) -> DataFrame:
        total = df.groupBy(key).agg(F.sum("letters").alias("total"))
        return df.join(total, key).select(key, "script", F.col("letters").alias(f"{n}_letters"), (F.col("letters") / F.col("total")).alias(f"{n}_share"))

    j = shared(candidate, "new").join(shared(original, "old"), [key, "script"], "left").fillna(0, ["old_letters"]).fillna(0.0, ["old_share"])
    grew = (F.col("new_letters") > F.col("old_letters")) & (F.col("new_share") > F.col("old_share"))
    return j.where((F.col("old_share") < established) & (F.col("new_share") > ceiling) & (grew | (F.col("new_share") >= established))).select(key, "script", "old_letters", "new_letters")


def introduced(current: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    return candidate.join(current, [key, "script"], "left_anti").select(key, "script")


#: Rejections in the order in which they are looked for; each names a boolean column that is true if it holds.
REJECTIONS = ("not-one-segment", "unscoreable", "candidate-unscoreable", "uncalibrated", "different-features", "not-preserved", "expanded", "language", "language-growth", "tells-incomparable", "tells-worse", "not-improved", "not-spliceable")


def rejection(present: dict[str, Column]) -> Column:
    """The first rejection that holds, or the empty text."""
    out = None
    for name in REJECTIONS:
        if name in present:
            out = F.when(present[name], name) if out is None else out.when(present[name], name)
    return out.otherwise("")


def judged(pairs: DataFrame) -> DataFrame:
    """(pair_id, code): guards that need no profile, in their order."""
    lost = differences(pairs).select("pair_id").distinct().withColumn("changed", F.lit(True))
    old, new = (script_counts(pairs, "pair_id", c) for c in ("current", "candidate"))
    foreign = introduced(old, new, "pair_id").select("pair_id").distinct().withColumn("foreign", F.lit(True))
    grown = overgrown(old, new, "pair_id").select("pair_id").distinct().withColumn("grown", F.lit(True))
    n = {c: F.size(lexical_tokens(F.col(c))) for c in ("current", "candidate")}
    base = pairs.select("pair_id", *[v.alias(f"n_{k}") for k, v in n.items()])
    j = base.join(lost, "pair_id", "left").join(foreign, "pair_id", "left").join(grown, "pair_id", "left").fillna(False, ["changed", "foreign", "grown"])
    code = rejection({"unscoreable": F.col("n_current") == 0, "candidate-unscoreable": F.col("n_candidate") == 0, "not-preserved": F.col("changed"), "expanded": F.col("n_candidate") > C.EXPANSION * F.col("n_current"), "language": F.col("foreign"), "language-growth": F.col("grown")})
    return j.select("pair_id", "n_current", "n_candidate", code.alias("code"))


def accepted(attempts: DataFrame, epsilon: float = C.EPSILON, most: int = 3) -> DataFrame:
    """(target, accepted, distance) from attempts (target, index, start, distance, code): only strict improvements advance, every attempt counts."""
    listed = attempts.where(F.col("index") < most).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("index", "distance", "code"))).alias("a"), F.first("start").alias("start"))
    zero = F.struct(F.lit(-1).cast("int").alias("at"), F.col("start").alias("d"))

    def step(s: Column, a: Column) -> Column:
        better = (a["code"] == "") & (a["distance"] <= s["d"] - epsilon)
        return F.struct(F.when(better, a["index"].cast("int")).otherwise(s["at"]).alias("at"), F.when(better, a["distance"]).otherwise(s["d"]).alias("d"))

    return listed.select("target", F.aggregate("a", zero, step).alias("s")).select("target", F.col("s.at").alias("accepted"), F.col("s.d").alias("distance"))
