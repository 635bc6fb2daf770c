"""Queries of the gates, the token stream and the surface, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import surface
from ..functions import constants as C
from ..functions.tables import read
from ..operators import corpus, gates, preserve, tokens
from . import catalogue as K

#: Bands that may be claimed, and thresholds.
LOW, HIGH, EMITTED = 0.6, 1.0, {"in-range": True, "not-you": False}


def profile_adequacy(spark, sf):
    """By source, most of which are too small by themselves."""
    return gates.adequacy(K._admitted(spark, sf), K._vectors(spark, sf).select("source", "split"), "source")


def distractor_pool(spark, sf):
    d = corpus.hashed(K._docs(spark, sf)).where(~F.col("source").isin(K.AUTHORS))
    return d.select("content_hash").distinct()


def copies_by_source(spark, sf):
    d = corpus.hashed(K._docs(spark, sf)).groupBy("source", "content_hash").agg(F.count("*").alias("n"))
    return d.groupBy("source").agg(F.sum("n").alias("documents"), F.count("*").alias("texts"), F.max("n").alias("most_copies"))


def index_counts(spark, sf):
    """One row (documents, eligible, nodes, train_paragraphs, tool_output)."""
    a = K._admitted(spark, sf)
    docs = a.agg(F.count("*").alias("documents"), F.count_if(F.col("admission") == "eligible").alias("eligible"), F.sum(F.when(F.col("admission") == "eligible", F.size(F.split("text", "\n")))).alias("nodes"))
    train = K._vectors(spark, sf).agg(F.count_if(F.col("split") == "train").alias("train_paragraphs"))
    flagged = K.tool_output_screen(spark, sf).agg(F.count_if("tool_output").alias("tool_output"))
    return docs.crossJoin(train).crossJoin(flagged)  # one row each


def calibrated_bands(spark, sf):
    b = gates.calibrated_bands(K._distances(spark, sf), LOW, HIGH, EMITTED)
    return b.groupBy("class", "band", "reason").agg(F.count("*").alias("n"))


def judged_segments(spark, sf):
    """Each document as a report: judged only if it has one paragraph above the floor, with a distance and a band."""
    b = gates.calibrated_bands(K._distances(spark, sf), LOW, HIGH, EMITTED)
    r = b.groupBy("class", "doc_id").agg(F.count("*").alias("segments"), F.max("distance").alias("distance"), F.max("band").alias("band"))
    codes = {n: gates.judged_segment(F.col("segments"), F.col("distance"), F.col("band"), n == "candidate") for n in ("current", "candidate")}
    return r.select("class", "doc_id", *[c.alias(n) for n, c in codes.items()])


def membership_strangers(spark, sf):
    members = read(spark, sf, "labels").select("doc_id")
    return gates.strangers(read(spark, sf, "documents").select("doc_id", "source"), members, "doc_id")


def manifest_mismatches(spark, sf):
    c, o = read(spark, sf, "customer").select(F.col("c_custkey").alias("key")), read(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    return gates.mismatches(c, o, "key")


def binding_states(spark, sf):
    return gates.bound_alike(read(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


def ordered_differences(spark, sf):
    return gates.ordered_differences(preserve.differences(K._pairs(spark, sf)))


def leading_spaces(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.explode(F.split(F.coalesce("html", F.lit("")), "\n")).alias("line"))
    return p.groupBy("page_id").agg(F.count("*").alias("lines"), F.sum(gates.leading_space(F.col("line"))).cast("long").alias("spaces"))


def registers_by_source(spark, sf):
    d = read(spark, sf, "documents").where("source is not null and lang is not null")
    return d.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("registers"))


def token_classes(spark, sf):
    t = tokens.stream(K._docs(spark, sf).select("doc_id", "text"))
    return t.where("class in ('word', 'symbol')").groupBy("doc_id", "class").agg(F.count("*").alias("tokens"), F.sum("length").alias("bytes"))


def token_offsets(spark, sf):
    """Per document, its last token, whose offset depends on all before it."""
    t = tokens.stream(K._docs(spark, sf).select("doc_id", "text")).where("class = 'word'")
    return t.groupBy("doc_id").agg(F.max("start").alias("last_word_start"))


def run_tokens(spark, sf):
    """Tokens by line of the author's documents, without the first five bytes of a line."""
    docs = K._docs(spark, sf).where(F.col("source").isin(K.AUTHORS)).select("doc_id", "text")
    w = Window.partitionBy("doc_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("line").cast("long")
    lines = corpus.lines(docs).select("doc_id", "seg", size.alias("length"), F.coalesce(F.sum(size + 1).over(w), F.lit(0)).cast("long").alias("start"))
    cut = F.array(F.struct(F.col("start").alias("start"), F.lit(5).cast("long").alias("length")))
    kept = tokens.run_tokens(tokens.stream(docs), lines.withColumn("excisions", cut))
    return kept.groupBy("doc_id", "leaf_start").agg(F.count("*").alias("tokens"))


def snapped_spans(spark, sf):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(n).alias("length")) for a, n in ((0, 1), (7, 13), (100, 1000))])
    return tokens.snapped(K._docs(spark, sf).select("doc_id", "text", spans.alias("spans")))


def surface_scores(spark, sf):
    """The author's test paragraphs against the author's own profile, through the surface."""
    indexed = surface.index(K._docs(spark, sf))
    author = indexed.where(F.col("source").isin(K.AUTHORS))
    return surface.score(surface.profile(author), surface.features(author.where("split = 'test'"))).select("doc_id", "seg", "available", "met", "distance")


def surface_plan(spark, sf):
    """Dispositions of the author's test paragraphs under fixed thresholds."""
    indexed = surface.index(K._docs(spark, sf))
    author = indexed.where(F.col("source").isin(K.AUTHORS))
    drafts = author.where("split = 'test'")
    scored = surface.score(surface.profile(author), surface.features(drafts), surface.Evaluation(LOW, HIGH, "separated", None))
    published = K._passages(spark, sf).select(F.sha2(F.trim("text"), 256).alias("h"))
    return surface.plan_rewrite(scored, corpus.lines(drafts).select("doc_id", "seg", "line"), published)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        profile_adequacy, distractor_pool, copies_by_source, index_counts, calibrated_bands, judged_segments, membership_strangers, manifest_mismatches, binding_states,
        ordered_differences, leading_spaces, registers_by_source, token_classes, token_offsets, run_tokens, snapped_spans, surface_scores, surface_plan,
    )
}

_BAND = f"CASE WHEN distance <= {LOW} THEN 'in-range' WHEN distance IS NOT NULL THEN 'drifting' END"
_REASON = "CASE WHEN distance IS NULL THEN 'undefined-distance' ELSE '' END"
_DS = K.ORACLE["distance_scores"]


def _judged(unscored: str) -> str:
    return f"CASE WHEN n <> 1 THEN 'not-one-segment' WHEN d IS NULL THEN '{unscored}' ELSE '' END"


ORACLE: dict[str, str] = {
    "profile_adequacy": f"""WITH {K._VECTORS}, by_source AS (SELECT source, count(*) AS documents, count(*) FILTER (admission = 'eligible') AS eligible, count(*) FILTER (split = 'train') AS train FROM a GROUP BY source),
trained AS (SELECT source, count(*) AS n FROM v WHERE split = 'train' GROUP BY source)
SELECT source, documents, eligible, train, coalesce(n, 0) AS paragraphs, CASE WHEN eligible = 0 THEN 'no-eligible-document' WHEN documents < {C.MIN_DOCUMENTS} THEN 'too-few-documents'
  WHEN train = 0 THEN 'no-train-document' WHEN coalesce(n, 0) < {C.MIN_PARAGRAPHS} THEN 'too-few-paragraphs' ELSE '' END AS gate FROM by_source LEFT JOIN trained USING (source)""",
    "distractor_pool": f"SELECT DISTINCT sha256(coalesce(text, '')) AS content_hash FROM documents WHERE source NOT IN {K._AUTHORS}",
    "copies_by_source": "SELECT source, sum(n)::BIGINT AS documents, count(*) AS texts, max(n) AS most_copies FROM (SELECT source, coalesce(text, '') AS t, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source",
    "index_counts": f"""WITH {K._VECTORS} SELECT (SELECT count(*) FROM a) AS documents, (SELECT count(*) FROM a WHERE admission = 'eligible') AS eligible, (SELECT count(*) FROM s) AS nodes,
  (SELECT count(*) FROM v WHERE split = 'train') AS train_paragraphs, (SELECT count(*) FROM ({K.ORACLE["tool_output_screen"]}) AS x WHERE tool_output) AS tool_output""",
    "calibrated_bands": f"SELECT class, {_BAND} AS band, {_REASON} AS reason, count(*) AS n FROM ({_DS}) AS x GROUP BY ALL",
    "judged_segments": f"SELECT class, doc_id, {_judged('unscoreable')} AS current, {_judged('candidate-unscoreable')} AS candidate FROM (SELECT class, doc_id, count(*) AS n, max(distance) AS d FROM ({_DS}) AS x GROUP BY class, doc_id)",
    "membership_strangers": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "manifest_mismatches": """WITH c AS (SELECT c_custkey AS key, 1 AS d, 0 AS f FROM customer UNION ALL SELECT o_custkey, 0, 1 FROM orders)
SELECT key, sum(d)::BIGINT AS declared, sum(f)::BIGINT AS found FROM c GROUP BY key HAVING sum(d) <> 1 OR sum(f) <> 1""",
    "binding_states": "SELECT o_custkey, count(*) AS rows, count(DISTINCT (o_orderstatus, o_orderpriority)) = 1 AS alike FROM orders GROUP BY o_custkey",
    "ordered_differences": f"""SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY CASE class WHEN 'number' THEN 1 WHEN 'entity' THEN 2 WHEN 'negation' THEN 3 WHEN 'url' THEN 4 ELSE 5 END,
  CASE direction WHEN 'lost' THEN 0 ELSE 1 END, item) - 1 AS ordinal FROM ({K.ORACLE["preserve_differences"]}) AS x""",
    "leading_spaces": """WITH l AS (SELECT page_id, unnest(string_split(coalesce(html, ''), chr(10))) AS line FROM pages)
SELECT page_id, count(*) AS lines, sum(length(line) - length(ltrim(line, ' ')))::BIGINT AS spaces FROM l GROUP BY page_id""",
    "registers_by_source": "SELECT source, string_agg(lang, ',' ORDER BY lang) AS registers FROM (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) GROUP BY source",
    "token_classes": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, 'word' AS class, unnest({K._lex("text")}) AS x FROM t
UNION ALL SELECT doc_id, 'symbol', unnest(regexp_extract_all(text, '[\\p{{So}}\\p{{Sc}}]')) FROM t) SELECT doc_id, class, count(*) AS tokens, sum(strlen(x))::BIGINT AS bytes FROM w GROUP BY doc_id, class""",
    "token_offsets": f"""WITH {K._DOCS}, x AS (SELECT doc_id, text, regexp_extract(text, '[0-9]*[\\p{{L}}\\p{{M}}][\\p{{L}}\\p{{M}}\\p{{Nd}}]*(?:[-''’‑][\\p{{L}}\\p{{M}}\\p{{Nd}}]+)*[^\\p{{L}}\\p{{M}}]*$') AS rest FROM d)
SELECT doc_id, strlen(text) - strlen(rest) AS last_word_start FROM x WHERE rest <> ''""",
    "surface_scores": f"SELECT doc_id, seg, available, met, distance FROM ({_DS}) AS x WHERE class = 'author'",
    "surface_plan": f"""WITH ds AS ({_DS}), {K._PASSAGES}, ln AS (SELECT doc_id, i - 1 AS seg, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS g(i))
SELECT doc_id, seg, CASE WHEN distance IS NULL THEN 'unmeasurable' WHEN sha256(trim(line)) IN (SELECT h FROM ps) THEN 'already-rewritten' WHEN distance <= {LOW} THEN 'in-range'
  WHEN contains(line, '`') THEN 'contains-excisions' ELSE 'target' END AS disposition FROM ds JOIN ln USING (doc_id, seg) WHERE class = 'author'""",
}
