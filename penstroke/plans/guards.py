"""Queries of policies, freshness, usability and bundles, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import lexical_tokens
from ..functions.tables import read
from ..operators import corpus, gates, policy, style
from . import catalogue as K
from . import checks


def invalid_bytes(spark, sf):
    """Where documents' bytes stop being UTF-8, after a byte that never is has been put behind the text of some."""
    raw = F.col("text").cast("binary")
    spoilt = F.when(F.col("doc_id") % 3 == 0, F.concat(raw, F.unhex(F.lit("FF41")))).otherwise(raw)
    return K._docs(spark, sf).select("doc_id", policy.invalid_at(spoilt).alias("invalid_at"))


def draft_freshness(spark, sf):
    """Drafts against files of which some have changed, some have gone, and some would lie outside of their folder."""
    d = corpus.hashed(K._docs(spark, sf))
    name = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    files = d.where("doc_id % 5 <> 0").select(name.alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")).cast("binary").alias("content"))
    return policy.freshness(d.select(name.alias("path"), "content_hash"), files)


def profile_usability(spark, sf):
    """A profile for each source; some are of another unit, and some lack a feature."""
    long = K._long(spark, sf).where("split = 'train' and source is not null")
    stats = long.groupBy("source", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance")).withColumnRenamed("source", "profile_id")
    stats = stats.where("not (profile_id like '%3' and feature = 'comma_density')")
    heads = long.groupBy(F.col("source").alias("profile_id")).agg(F.countDistinct("doc_id").alias("documents"), (F.count("*") / len(C.FEATURES)).cast("long").alias("paragraphs"))
    return policy.usable(heads.withColumns({"unit": F.when(F.col("profile_id").endswith("7"), "document").otherwise("paragraph"), "floor": F.lit(C.MIN_LEXICAL)}), stats)


def overlap_attested(spark, sf):
    d = corpus.hashed(K._docs(spark, sf))
    a = policy.overlap_attestation(d.where(F.col("source").isin(K.AUTHORS)), d.where(~F.col("source").isin(K.AUTHORS)))
    return a.select("algorithm", "state", "shared", (F.length("author_id") + F.length("distractor_id")).alias("digits"))


def scoring_bundles(spark, sf):
    """Customers as heads, urgent orders as references, finished ones as releases."""
    o = read(spark, sf, "orders")
    heads = read(spark, sf, "customer").select(F.col("c_custkey").alias("register"), F.col("c_custkey").alias("profile_id"))
    own = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("profile_id"), "o_orderpriority", "o_orderstatus")
    return policy.bundles(heads, own.where("o_orderpriority = '1-URGENT'").select("id", "profile_id"), own.where("o_orderstatus = 'F'").select("id", "profile_id"))


def token_sets(spark, sf):
    """Whether turns have the same words in the same order, and in any order."""
    a, b = (F.transform(lexical_tokens(F.col(c)), lambda t: F.lower(t)) for c in ("current", "candidate"))
    p = K._pairs(spark, sf)
    turned = p.select("pair_id", "current", F.array_join(F.reverse(F.split("current", " ")), " ").alias("candidate"))
    both = p.unionByName(turned).select("pair_id", a.alias("a"), b.alias("b"))
    return both.select("pair_id", (F.col("a") == F.col("b")).alias("positional"), policy.same_set("a", "b").alias("same")).groupBy("positional", "same").agg(F.count("*").alias("n"))


def unlike_corpora(spark, sf):
    """Copies of texts that one of two halves of the corpus has more of."""
    d = corpus.hashed(K._docs(spark, sf))
    return policy.unlike_rows(d.where("doc_id % 2 = 0").select("content_hash"), d.where("doc_id % 2 <> 0").select("content_hash"))


def report_totals(spark, sf):
    """By class: paragraphs of the test split that were scored, and those below the floor."""
    banded = gates.calibrated_bands(K._distances(spark, sf), checks.LOW, checks.HIGH, {})
    below = style.vectors(K._segments(spark, sf)).where(f"lexical < {C.MIN_LEXICAL} and (class = 'distractor' or split = 'test')").select("class")
    return policy.report_counts(banded, below, "class")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (invalid_bytes, draft_freshness, profile_usability, overlap_attested, scoring_bundles, token_sets, unlike_corpora, report_totals)
}

_LOWER = "list_transform({}, lambda t: lower(t))"
ORACLE: dict[str, str] = {
    "invalid_bytes": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN strlen(coalesce(text, '')) END AS invalid_at FROM documents",
    "draft_freshness": f"WITH {K._DOCS} SELECT CASE WHEN doc_id % 13 = 0 THEN '../' ELSE '' END || path AS path, CASE WHEN doc_id % 13 = 0 THEN 'not-local' WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'stale' ELSE 'ok' END AS state FROM d",
    "profile_usability": f"""WITH {K._VECTORS}, h AS (SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS paragraphs FROM v WHERE split = 'train' AND source IS NOT NULL GROUP BY source)
SELECT source AS profile_id, CASE WHEN source LIKE '%7' THEN 'other-unit' WHEN source LIKE '%3' THEN 'other-manifest' WHEN documents < {C.MIN_DOCUMENTS} THEN 'too-few-documents' WHEN paragraphs < {C.MIN_PARAGRAPHS} THEN 'too-few-paragraphs' ELSE '' END AS reason FROM h""",
    "overlap_attested": f"WITH {K._DOCS}, s AS (SELECT hash FROM d WHERE source IN {K._AUTHORS} INTERSECT SELECT hash FROM d WHERE source NOT IN {K._AUTHORS}) SELECT '{policy.OVERLAP}' AS algorithm, CASE WHEN count(*) > 0 THEN 'failed' ELSE 'passed' END AS state, count(*) AS shared, 128 AS digits FROM s",
    "scoring_bundles": """WITH r AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS id FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), e AS (SELECT o_custkey, max(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS register, c_custkey AS profile_id, CASE WHEN n = 1 THEN r.id END AS reference_id, e.id AS release_id, CASE WHEN n IS NULL THEN 'no-reference' WHEN n > 1 THEN 'ambiguous-reference' ELSE 'ok' END AS state
FROM customer LEFT JOIN r ON r.o_custkey = c_custkey LEFT JOIN e ON e.o_custkey = c_custkey""",
    "token_sets": f"""WITH {K._PAIRS}, q AS (SELECT current, candidate FROM p UNION ALL SELECT current, array_to_string(list_reverse(string_split(current, ' ')), ' ') FROM p), w AS (SELECT {_LOWER.format(K._lex("current"))} AS a, {_LOWER.format(K._lex("candidate"))} AS b FROM q)
SELECT a = b AS positional, list_sort(a) = list_sort(b) AS same, count(*) AS n FROM w GROUP BY ALL""",
    "unlike_corpora": f"WITH {K._DOCS} SELECT hash AS content_hash, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS n FROM d GROUP BY hash HAVING sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) <> 0",
    "report_totals": f"""WITH x AS ({K.ORACLE["distance_scores"]}), f AS (WITH {K._RAW} SELECT class, count(*) AS below_floor FROM raw WHERE lexical < {C.MIN_LEXICAL} AND (class = 'distractor' OR split = 'test') GROUP BY class)
SELECT class, count(*) AS segments, count(distance) AS measured, count(*) FILTER (distance <= {checks.LOW}) AS in_range, count(*) FILTER (distance > {checks.LOW} AND distance < {checks.HIGH}) AS drifting, count(*) FILTER (distance >= {checks.HIGH}) AS not_you, max(below_floor) AS below_floor FROM x JOIN f USING (class) GROUP BY class""",
}
