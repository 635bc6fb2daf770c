"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its lower-cased words between white space, weighted by their counts. For each of K
samples a term draws r and c from Gamma(2, 1) and b from [0, 1), all functions of (term, k) alone. With
t = floor(ln w / r + b) the sample is the (term, t) of the smallest a = c * exp(-r * (t - b + 1)). Two texts share
a sample with a probability of sum(min w) / sum(max w), the generalised Jaccard similarity of their counts.

The draws are made from uniform u, v and y so that a weight of 1, which most terms have, needs no logarithm. A Gamma(2, 1)
cut at a uniform place gives two independent exponentials: r * b = E = -ln u and r * (1 - b) = D make r = D + E; and
c * exp(-D) = x = -ln v and c - x = -ln y make c = x - ln y and D = ln c - ln x. At w = 1, t is 0 and a is x: samples are
ordered by 1 - exp(-a), which is then 1 - v, bits of the hash. Other weights have t = floor((ln w + E) / r), ln a = ln c + E - r * (t + 1).

Defined results: a null text is the empty text; a text without terms has the fingerprint "" (likeness 1 to
another such text, 0 to any other); rows that share a doc_id are fingerprinted each on its own, and the
"next" text and fingerprint of their neighbour is the least of those that the next doc_id has; rows without
a doc_id stand outside the order and take an empty text as their next one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_of


SAMPLES = 32
#: Bits of a code that order samples.
PLACE = 46


def _draws(samples: int, weights: list[str]) -> list[Column]:
    """For each sample 1 - v as a long below 2^46 and, for terms of a weight above 1, ln c, E and ln x, from the term's hashes."""
    heavy = F.greatest(F.lit(0.0), *[F.col(f"ln_{w}") for w in weights]) > 0
    uniform = lambda x: (x.bitwiseAND(0xFFFFFFFF) + 0.5) / float(1 << 32)
    out = []
    for k in range(samples):
        z, h = F.col(f"z{k}"), F.xxhash64("term", F.lit(~k))
        x = -F.log1p((z + 0.5) / -float(1 << PLACE))
        ln_c, e = F.log(x - F.log(uniform(h))), -F.log(uniform(F.shiftrightunsigned(h, 32)))
        out += [z, F.when(heavy, ln_c).alias(f"c{k}"), F.when(heavy, e).alias(f"e{k}"), F.when(heavy, F.log(x)).alias(f"x{k}")]
    return out


def _codes(samples: int, weights: list[str]) -> list[Column]:
    """For each weight and sample the long whose upper bits order 1 - exp(-a) and whose lower 16 bits name (term, t)."""
    out = []
    for k in range(samples):
        z, ln_c, e = F.col(f"z{k}"), F.col(f"c{k}"), F.col(f"e{k}")
        r = ln_c - F.col(f"x{k}") + e
        name = F.shiftrightunsigned(F.col("term"), k % 48)
        light = F.shiftleft(z, 16).bitwiseOR(name.bitwiseAND(65535))
        for w in weights:
            ln_w = F.col(f"ln_{w}")
            t = F.floor((ln_w + e) / r)
            order = (-F.expm1(-F.exp(ln_c + e - r * (t + 1))) * float(1 << PLACE)).cast("long")
            # at t = 0 the sample is that of weight 1, to the last bit
            code = F.when(t == 0, light).otherwise(F.shiftleft(order, 16).bitwiseOR(name.bitwiseXOR(t).bitwiseAND(65535)))
            out.append(F.when(ln_w == 0, light).when(ln_w > 0, code).alias(f"{w}_{k}"))
    return out


def _fingerprint(w: str, samples: int) -> Column:
    hexes = [F.lpad(F.lower(F.hex(F.col(f"{w}_{k}").bitwiseAND(65535))), 4, "0") for k in range(samples)]
    return F.when(F.col(f"{w}_0").isNull(), F.lit("")).otherwise(F.concat(*hexes))


def fingerprint(df: DataFrame, keys: list[str], texts: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """One row per row of keys (which must tell rows apart) with a fingerprint for each of the texts, name -> column.

    Terms are counted and sampled where the rows are: if df is dealt out by one of the keys, nothing more is shuffled.
    """
    names = list(texts)
    cut = {n: F.split(F.lower(text_of(texts[n])), r"\s+") for n in names}
    words = df.select(*keys, *[cut[n].alias(f"_w{i}") for i, n in enumerate(names)])
    ends, total = [], F.lit(0)
    for i in range(len(names)):
        total = total + F.size(f"_w{i}")
        ends.append(total)
    exploded = words.select(*keys, *[e.alias(f"_e{i}") for i, e in enumerate(ends)], F.posexplode(F.concat(*[f"_w{i}" for i in range(len(names))])).alias("_pos", "_word"))
    which = F.lit(len(names) - 1)
    for i in range(len(names) - 2, -1, -1):
        which = F.when(F.col("_pos") < F.col(f"_e{i}"), i).otherwise(which)
    # the empty word takes part, so that every row keeps a group; it gets no weight
    counted = exploded.select(*keys, F.when(F.col("_word") != "", F.xxhash64("_word")).alias("term"), which.alias("_which"))
    counted = counted.groupBy(*keys, "term").agg(*[F.sum(F.when(F.col("_which") == i, 1).otherwise(0)).alias(n) for i, n in enumerate(names)])
    # a null logarithm makes a null sample, which a minimum leaves out
    logs = [F.when(F.col("term").isNotNull() & (F.col(n) > 0), F.log(F.col(n))).alias(f"ln_{n}") for n in names]
    placed = counted.select(*keys, "term", *logs, *[F.shiftrightunsigned(F.xxhash64("term", F.lit(k)), 64 - PLACE).alias(f"z{k}") for k in range(samples)])
    drawn = placed.select(*keys, "term", *[f"ln_{n}" for n in names], *_draws(samples, names))
    coded = drawn.select(*keys, *_codes(samples, names))
    least = coded.groupBy(*keys).agg(*[F.min(f"{n}_{k}").alias(f"{n}_{k}") for k in range(samples) for n in names])
    return least.select(*keys, *[_fingerprint(n, samples).alias(n) for n in names])


def likeness(a: str, b: str) -> Column:
    """The share of equal samples of two fingerprints, 0 to 1."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)), F.lit(4))
    same = F.aggregate(places, F.lit(0), lambda n, i: n + F.when(F.substr(F.col(a), i, F.lit(4)) == F.substr(F.col(b), i, F.lit(4)), 1).otherwise(0))
    return F.when(F.col(b).isNull(), F.lit(None)).when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(same.cast("double") / (F.length(a) / 4))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, need, next_id): the next lower doc_id (after the lowest: the highest), and the most that an edit takes of it.

    Ids alone are sorted, and ranked by each partition's count, of which the driver sees one number per partition.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.char_length(text_of()) / 2)).cast("int").alias("need"))
    ordered = materialize(materialize(ids, "ids").orderBy(F.desc("doc_id")).withColumn("place", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("part")).count().collect()  # one row per partition
    before, total = [], 0
    for row in sorted(counts, key=lambda x: x["part"]):
        before.append((row["part"], total))
        total += row["count"]
    spark = docs.sparkSession
    starts = spark.createDataFrame(before or [(0, 0)], "part long, start long")
    ranked = ordered.select("doc_id", "need", part.alias("part"), at.alias("at")).join(F.broadcast(starts), "part").select("doc_id", "need", (F.col("start") + F.col("at")).alias("rank"))
    following = ranked.select(F.col("doc_id").alias("next_id"), ((F.col("rank") + (total - 1 if total else 0)) % max(total, 1)).alias("rank"))
    return ranked.join(following, "rank").select("doc_id", "need", "next_id")


def edited(docs: DataFrame) -> DataFrame:
    """Each row with its edited text and next_id: the last half of its text replaced by the first as much of the next one's."""
    near = materialize(neighbours(docs), "neighbours")
    # a slot that is never null keeps both joins below on one and the same exchange of the texts, over which rows without an id spread
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()).alias("slot"), F.col("doc_id").isNotNull().alias("named"), text_of().alias("text"))
    heads = own.join(near.select(F.col("next_id").alias("slot"), "doc_id", "need"), "slot")
    # the slot of a row without an id may be another's id: it gives no head, and takes none
    head = F.when(F.col("named"), F.struct(F.left("text", F.col("need")).alias("head"), F.col("slot").alias("next_id")))
    heads = heads.groupBy(F.col("doc_id").alias("of")).agg(F.min(head).alias("h")).select("of", "h.head", "h.next_id")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    both = own.join(heads, (F.col("slot") == F.col("of")) & F.col("named"), "left").withColumn("n_chars", n.cast("long"))
    return both.select("slot", "next_id", "n_chars", "text", F.concat(F.left("text", n - half), F.left(F.coalesce("head", F.lit("")), half)).alias("edited"))


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The rows that op10 returns. Rows with an id, and no others, have a next one (the only one: itself)."""
    rows = edited(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["slot", "row", "next_id", "n_chars", "edited_sha256"]
    prints = materialize(fingerprint(rows, keys, {"fingerprint": "text", "edited_fingerprint": "edited"}, samples), "fingerprints")
    named = F.col("next_id").isNotNull()
    following = prints.where(named).groupBy(F.col("slot").alias("after")).agg(F.min("fingerprint").alias("next_fingerprint"))
    out = prints.join(following, (F.coalesce("next_id", "row") == F.col("after")) & named, "left")
    return out.select(F.when(named, F.col("slot")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
