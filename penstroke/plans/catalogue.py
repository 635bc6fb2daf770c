"""Named queries over the tables, and the SQL that must give the same rows.

Authors are the sources src0 to src9, distractors all other sources; paragraphs are the lines of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import LEXICAL, ends_terminal, lexical_tokens, probit_sql
from ..functions.tables import materialize, read
from ..operators import corpus, evaluate, exemplars, lint, preserve, rewrite, store, structure, style

AUTHORS = [f"src{i}" for i in range(10)]


def _r(x: str | Column, n: int = 9) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, n)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.from_documents(read(spark, sf, "documents"))


def _admitted(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.admitted(_docs(spark, sf))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    e = corpus.eligible(_admitted(spark, sf)).select("doc_id", "source", "split", "text")
    return corpus.lines(e).withColumn("class", F.when(F.col("source").isin(AUTHORS), "author").otherwise("distractor"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return style.vectors(_segments(spark, sf), floor=C.MIN_LEXICAL).drop("line")


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return style.long_form(_vectors(spark, sf))


def _fit(long: DataFrame) -> DataFrame:
    return style.profile(long.where("class = 'author' and split = 'train'"))


def _standard(spark: SparkSession, sf: str) -> DataFrame:
    """Only what is asked of it later, as it is written."""
    keys = ["class", "split", "doc_id", "seg", "feature"]
    long = materialize(_long(spark, sf).select(*keys, "value", "sv"), "features")
    return style.standardized(long, _fit(long)).select(*keys, "z", "reason")


def _deviations(spark: SparkSession, sf: str, split: str = "test") -> DataFrame:
    z = materialize(_standard(spark, sf), "standard")
    reference = z.where("class = 'author' and split = 'calibrate'")
    return style.deviations(z.where(f"class = 'distractor' or split = '{split}'"), reference)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of all distractors' paragraphs and the author's held-out ones, standardised and ranked once. A written table."""
    z = materialize(_standard(spark, sf), "standard")
    devs = style.deviations(z.where("class = 'distractor' or split in ('test', 'calibrate')"), z.where("class = 'author' and split = 'calibrate'"))
    d = style.distances(devs, ["class", "split", "doc_id", "seg"])
    return materialize(d.withColumn("document", F.col("doc_id")).withColumn("distance", _r("distance")), "distances")


def _of(scored: DataFrame, split: str) -> DataFrame:
    return scored.where(f"class = 'distractor' or split = '{split}'")


def _distances(spark: SparkSession, sf: str, split: str = "test") -> DataFrame:
    return _of(_scored(spark, sf), split)


def _bounded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(thresholds, resamples of the test distances under them, clusters by class)."""
    scored = _scored(spark, sf)
    test, limits = _of(scored, "test"), materialize(evaluate.thresholds(_of(scored, "calibrate")), "limits")
    row = limits.first()
    clusters = {r[0]: r[1] for r in test.where("distance is not null").groupBy("class").agg(F.countDistinct("document")).collect()}
    return limits, materialize(evaluate.resampled(test, row["low"], row["high"]), "draws"), {c: clusters.get(c, 0) for c in ("author", "distractor")}


def doc_admission(spark, sf):
    files = _docs(spark, sf).select("path", F.col("text").cast("binary").alias("content"))
    return corpus.admit_bytes(files).select("path", "valid", "had_bom", F.octet_length("text").alias("bytes"), "content_hash")


def dedupe_first_wins(spark, sf):
    return corpus.first_wins(corpus.hashed(_docs(spark, sf))).select("path", "content_hash", "duplicate_of")


def split_assignment(spark, sf):
    return _admitted(spark, sf).select("doc_id", "admission", "split")


def corpus_summary(spark, sf):
    return corpus.summary(_admitted(spark, sf))


def overlap_screen(spark, sf):
    d = corpus.hashed(_docs(spark, sf))
    return corpus.overlap(d.where(F.col("source").isin(AUTHORS)), d.where(~F.col("source").isin(AUTHORS)))


def _passages(spark, sf):
    return read(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("text")).where("length(trim(text)) > 0")


def tool_output_screen(spark, sf):
    return corpus.published_screen(_docs(spark, sf), _passages(spark, sf))


def check_statuses(spark, sf):
    flagged = tool_output_screen(spark, sf).where("tool_output").limit(1).count()
    return corpus.checks(spark, True, flagged)


def already_rewritten_flags(spark, sf):
    published = _passages(spark, sf).select(F.sha2(F.trim("text"), 256).alias("h"))
    asked = corpus.lines(_docs(spark, sf)).select(F.sha2(F.trim("line"), 256).alias("h")).distinct()
    return corpus.already_rewritten(asked, published)


def token_counts(spark, sf):
    return corpus.all_tokens(_docs(spark, sf))


def sentential_lines(spark, sf):
    s = corpus.lines(_docs(spark, sf)).withColumn("words", F.size(lexical_tokens(F.col("line")))).withColumn("terminal", ends_terminal(F.col("line")))
    return s.select("doc_id", "seg", "words", "terminal", ((F.col("terminal") & (F.col("words") >= C.MIN_SENTENTIAL)) | (F.col("words") >= C.MIN_UNPUNCTUATED)).alias("sentential"))


def feature_vectors(spark, sf):
    return _vectors(spark, sf).select("doc_id", "seg", "lexical", *[_r(f).alias(f) for f in C.FEATURES])


def sampling_variance(spark, sf):
    return _vectors(spark, sf).select("doc_id", "seg", *[_r(f"sv_{f}", 12).alias(f"sv_{f}") for f in C.FEATURES])


def paragraph_floor_partition(spark, sf):
    v = style.vectors(_segments(spark, sf)).withColumn("kept", F.col("lexical") >= C.MIN_LEXICAL)
    return v.groupBy("split", "class").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("below_floor"))


def profile_stats(spark, sf):
    return _fit(materialize(_long(spark, sf).where("class = 'author' and split = 'train'").select("class", "split", "feature", "value"), "train")).select("feature", "n", "undefined", _r("mean").alias("mean"), _r("variance").alias("variance"))


def profile_by_source(spark, sf):
    s = _long(spark, sf).groupBy("source", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    return s.select("source", "feature", "n", _r("mean").alias("mean"), _r("variance").alias("variance"))


def profile_stats_mad(spark, sf):
    long = materialize(_long(spark, sf).where("class = 'author' and split = 'train'"), "train")
    return style.profile(materialize(style.mad_trimmed(long, 3.0).select("feature", "value"), "trimmed")).select("feature", "n", _r("mean").alias("mean"), _r("variance").alias("variance"))


def standardized_values(spark, sf):
    return _standard(spark, sf).where("class = 'author' and split <> 'train'").select("doc_id", "seg", "feature", _r("z").alias("z"), "reason")


def reference_sizes_caps(spark, sf):
    z = _standard(spark, sf).where("class = 'author' and split = 'calibrate'")
    return style.reference_sizes(z).select("feature", "size", "available", _r("cap").alias("cap"))


def rank_transform(spark, sf):
    return _deviations(spark, sf).where("class = 'author'").select("doc_id", "seg", "feature", _r("u").alias("u"), _r("dev").alias("dev"))


def distance_scores(spark, sf):
    return _distances(spark, sf).select("class", "doc_id", "seg", "available", "met", "distance")


def feature_deltas(spark, sf):
    return style.deltas(_deviations(spark, sf)).groupBy("class", "feature", "direction").agg(F.count("*").alias("n"))


def tier_plan(spark, sf):
    z = _standard(spark, sf).where("class = 'author' and split = 'calibrate'")
    s = style.reference_sizes(z).agg(F.count("*").alias("manifest"), F.count_if("available").alias("available"))
    need = F.floor(F.col("manifest") / 2) + 1
    return s.select("manifest", "available", need.cast("long").alias("required"), (F.col("available") >= need).alias("met"))


def thresholds(spark, sf):
    return evaluate.thresholds(_distances(spark, sf, "calibrate"))


def band_occupancy(spark, sf):
    """Bands between both thresholds, the lower one first: as they come, they needn't separate."""
    scored = _scored(spark, sf)
    limits = evaluate.thresholds(_of(scored, "calibrate")).select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))
    return evaluate.occupancy(evaluate.banded(_of(scored, "test"), limits))


def achieved_rates(spark, sf):
    d = _distances(spark, sf, "calibrate")
    j = d.where("distance is not null").crossJoin(F.broadcast(evaluate.thresholds(d).select("low", "high")))  # one row
    a, b = F.col("class") == "author", F.col("class") == "distractor"
    return j.agg(_r(F.avg(F.when(a, (F.col("distance") >= F.col("low")).cast("double")))).alias("author_rate"), _r(F.avg(F.when(b, (F.col("distance") <= F.col("high")).cast("double")))).alias("distractor_rate"))


def auc_midrank(spark, sf):
    return evaluate.auc(_distances(spark, sf)).select(_r("auc").alias("auc"), "positives", "negatives")


def quality_auc(spark, sf):
    lab = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.auc(lab, "n_chars", "quality = 1").select(_r("auc").alias("auc"), "positives", "negatives")


def bootstrap_intervals(spark, sf):
    return evaluate.intervals(materialize(evaluate.resampled(_distances(spark, sf, "calibrate")), "draws"))


def band_error_bounds(spark, sf):
    _, draws, clusters = _bounded(spark, sf)
    return evaluate.error_bounds(draws, clusters["author"], clusters["distractor"])


def auc_lower_bound(spark, sf):
    _, draws, clusters = _bounded(spark, sf)
    return evaluate.auc_bound(draws, min(clusters.values())).select(_r("auc_lower").alias("auc_lower"), "passed")


def release_verdict(spark, sf):
    limits, draws, clusters = _bounded(spark, sf)
    bounds = evaluate.error_bounds(draws, clusters["author"], clusters["distractor"])
    return evaluate.release(limits, bounds, evaluate.auc_bound(draws, min(clusters.values()))).withColumn("auc_lower", _r("auc_lower"))


def _candidates(spark, sf):
    """The author's train paragraphs, named so that their order is that of documents and lines."""
    long = _long(spark, sf).where("class = 'author' and split = 'train'")
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit(":"), F.lpad(F.col("seg").cast("string"), 10, "0"))
    return materialize(long.withColumn("id", name).select("id", "source", "feature", "value"), "candidates")


def self_midrank(spark, sf):
    return exemplars.self_ranked(_candidates(spark, sf)).select("id", "feature", _r("u").alias("u"), _r("q").alias("q"))


def exemplar_density(spark, sf):
    return exemplars.densities(exemplars.self_ranked(_candidates(spark, sf))).select("id", _r("density", 6).alias("density"))


def exemplar_eligible(spark, sf):
    return exemplars.eligible(materialize(exemplar_density(spark, sf), "density"))


def _selection(spark, sf):
    """Twelve exemplars over a stratum for each source."""
    candidates = _candidates(spark, sf)
    stratum = candidates.select("id", F.concat(F.lit("paragraph|"), "source").alias("stratum")).distinct()
    return exemplars.select(materialize(exemplars.self_ranked(candidates), "ranked"), stratum, 12)


def exemplar_medoids(spark, sf):
    return _selection(spark, sf).medoids


def exemplar_certificate(spark, sf):
    """One row: how many neighbours make a density, the population, the eligible ones, and what they add up to."""
    s = _selection(spark, sf)
    return s.density.agg(F.lit(s.k).alias("k"), F.count("*").alias("population"), F.count_if("eligible").alias("eligible"), F.round(F.sum(F.when(F.col("eligible"), F.col("density"))), 3).alias("density"))


def stratum_order(spark, sf):
    s = _segments(spark, sf).where("class = 'author'").select(F.concat_ws("|", F.lit("paragraph"), "source").alias("stratum"))
    return exemplars.strata(s)


#: Derived rules that the invented prose does match.
DERIVED = [lint.Rule("doubled-article", "error", "(the the|la la|de de|die die)", "derived"), lint.Rule("pipe-table", "warn", " \\| ", "derived", "source-contamination"), lint.Rule("exclaimed", "info", "!!", "derived", "formatting")]


def lint_severity_vector(spark, sf):
    return lint.severity_vector(lint.findings(_docs(spark, sf), DERIVED))


def lint_overlap_filtered(spark, sf):
    return lint.without_overlaps(lint.findings(_docs(spark, sf), DERIVED))


def _pairs(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    old, new = (c.where(f"role = '{r}'") for r in ("user", "assistant"))
    j = old.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("current")).join(new.select("conv_id", "turn", F.col("text").alias("candidate")), ["conv_id", "turn"])
    return j.select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"), "current", "candidate")


def preserve_differences(spark, sf):
    return preserve.differences(_pairs(spark, sf))


def audit_identifiers(spark, sf):
    d = preserve.differences(_pairs(spark, sf)).select("class", "direction", "item").distinct()
    return d.select("class", "direction", "item", preserve.audit_id(F.col("class"), F.col("direction"), F.col("item")).alias("identifier"))


def script_counts(spark, sf):
    return preserve.script_counts(_docs(spark, sf), "doc_id", "text")


def expansion_guard(spark, sf):
    return preserve.judged(_pairs(spark, sf)).select("pair_id", "n_current", "n_candidate", (F.col("n_candidate") > C.EXPANSION * F.col("n_current")).alias("expanded"))


def rejection_codes(spark, sf):
    return preserve.judged(_pairs(spark, sf)).select("pair_id", "code")


def accepted_attempts(spark, sf):
    """Each document's first line as the paragraph, every line after it as an attempt."""
    d = _distances(spark, sf).where("distance is not null").select("doc_id", "seg", "distance")
    first = d.where("seg = 0").select("doc_id", F.col("distance").alias("start"))
    tries = d.where("seg > 0").join(first, "doc_id").select(F.col("doc_id").alias("target"), (F.col("seg") - 1).alias("index"), "start", "distance", F.lit("").alias("code"))
    return preserve.accepted(tries, most=(1 << 31) - 1)


def urls_extracted(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.explode(preserve.urls(F.coalesce("html", F.lit("")))).alias("url"))
    return p.groupBy("page_id", "url").agg(F.count("*").alias("n"))


def quotes_extracted(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.explode(preserve.quotes(F.coalesce("html", F.lit("")))).alias("quote"))
    return p.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.char_length("quote")).alias("chars"))


def interval_union(spark, sf):
    """Spans [ts, ts + value seconds) of a user's events, merged where they overlap; touching ones stay apart."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = read(spark, sf, "events").where("user_id is not null and ts is not null and value > 0").select("user_id", micros.alias("s"), (micros + (F.col("value") * 1e6).cast("long")).alias("e"))
    w = Window.partitionBy("user_id").orderBy("s", "e")
    m = e.withColumn("upto", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.row_number().over(w))
    m = m.withColumn("island", F.sum(F.when(F.col("upto").isNull() | (F.col("s") >= F.col("upto")), 1).otherwise(0)).over(w))
    return m.groupBy("user_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("parts")).select("user_id", "s", "e", "parts")


def content_ids(spark, sf):
    from ..functions.scalars import content_id

    h = corpus.hashed(_docs(spark, sf))
    return h.select("path", content_id(F.lit("snapshot"), F.col("path")).alias("document_id"), content_id(content_id(F.lit("snapshot"), F.col("path")), F.lit("0")).alias("node_id"))


def structure_leaves(spark, sf):
    return structure.document_leaves(_docs(spark, sf)).select("doc_id", "ordinal", "role", "start", "length", "words", "terminal", "included", "exclusion")


def replacement_shift(spark, sf):
    e = corpus.lines(_docs(spark, sf)).select("doc_id", F.col("seg").cast("long").alias("start"), F.octet_length("line").cast("long").alias("length"), (F.octet_length("line") * 2 % 7).cast("long").alias("new_length"))
    return rewrite.shifted(e).select("doc_id", "start", "new_start")


def paragraph_dispositions(spark, sf):
    scored = _scored(spark, sf)
    d = evaluate.banded(_of(scored, "test"), evaluate.thresholds(_of(scored, "calibrate")))
    flags = already_rewritten_flags(spark, sf)
    text = corpus.lines(_docs(spark, sf)).select("doc_id", "seg", F.sha2(F.trim("line"), 256).alias("h"), F.contains("line", F.lit("`")).alias("excised"))
    j = d.join(text, ["doc_id", "seg"]).join(flags, "h")
    return j.withColumn("disposition", rewrite.disposition(False)).groupBy("class", "disposition").agg(F.count("*").alias("n"))


def register_selection(spark, sf):
    heads_ = read(spark, sf, "documents").select(F.col("lang").alias("register"))
    parts = [("none", heads_.where("false"), None), ("one", heads_.where("register = 'en'"), None), ("many", heads_, None), ("named", heads_, "de"), ("unknown", heads_, "xx")]
    out = [rewrite.select_register(h, w).withColumn("asked", F.lit(n)) for n, h, w in parts]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def head_pointers(spark, sf):
    return store.heads(read(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


def sole_artifact(spark, sf):
    return store.sole(read(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("priority")), "o_custkey", "priority")


def ordinal_gaps(spark, sf):
    return store.gaps(read(spark, sf, "lineitem").where("l_quantity > 2").select("l_orderkey", (F.col("l_linenumber") - 1).alias("ordinal")), "l_orderkey")


def invalid_ids(spark, sf):
    h = corpus.hashed(_docs(spark, sf)).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.upper("content_hash")).otherwise(F.col("content_hash")).alias("id"))
    return store.bad_ids(h, "id").select("doc_id")


def rehydrate_nodes(spark, sf):
    docs = corpus.hashed(_docs(spark, sf))
    expected = docs.where("doc_id % 3 <> 0").select("path", "content_hash")
    files = docs.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    nodes = docs.select(F.col("doc_id").alias("node_id"), "path", F.lit(0).alias("start"), F.lit(1).alias("length"))
    return store.rehydrated(nodes, expected, files).groupBy("outcome").agg(F.count("*").alias("n"))


def reachability_prune(spark, sf):
    nation, customer, orders = (read(spark, sf, t) for t in ("nation", "customer", "orders"))

    def edge(df, a, x, b, y):
        return df.select(F.lit(a).alias("from_kind"), F.col(x).cast("long").alias("from_id"), F.lit(b).alias("to_kind"), F.col(y).cast("long").alias("to_id"))

    edges = edge(nation, "region", "n_regionkey", "nation", "n_nationkey").unionByName(edge(customer, "nation", "c_nationkey", "customer", "c_custkey")).unionByName(edge(orders, "customer", "o_custkey", "order", "o_orderkey"))
    seeds = read(spark, sf, "region").where("r_regionkey < 2").select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("id"))
    objects = edges.select(F.col("to_kind").alias("kind"), F.col("to_id").alias("id")).distinct()
    return store.pruned(objects, seeds, edges)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        doc_admission, dedupe_first_wins, split_assignment, corpus_summary, check_statuses, overlap_screen, tool_output_screen, already_rewritten_flags, token_counts, sentential_lines,
        feature_vectors, sampling_variance, paragraph_floor_partition, profile_stats, profile_by_source, profile_stats_mad, standardized_values, reference_sizes_caps, rank_transform, distance_scores,
        feature_deltas, tier_plan, thresholds, band_occupancy, achieved_rates, auc_midrank, quality_auc, bootstrap_intervals, band_error_bounds, auc_lower_bound, release_verdict, self_midrank,
        exemplar_density, exemplar_eligible, exemplar_medoids, exemplar_certificate, stratum_order, lint_severity_vector, lint_overlap_filtered, preserve_differences, audit_identifiers, script_counts,
        structure_leaves, replacement_shift, paragraph_dispositions, register_selection, head_pointers, sole_artifact, ordinal_gaps, invalid_ids, rehydrate_nodes, reachability_prune,
        expansion_guard, rejection_codes, accepted_attempts, urls_extracted, quotes_extracted, interval_union, content_ids,
    )
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lex(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, {_q(LEXICAL)}), lambda t: NOT regexp_matches(t, '^[0-9]+$'))"


def _in(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


_AUTHORS = "(" + ", ".join(map(_q, AUTHORS)) + ")"
_DOCS = "d AS (SELECT doc_id, lpad(doc_id::VARCHAR, 20, '0') AS path, coalesce(text, '') AS text, source, sha256(coalesce(text, '')) AS hash FROM documents)"
_ADMITTED = f"""{_DOCS}, w AS (SELECT *, min(path) OVER (PARTITION BY hash) AS winner, len({_lex('text')}) AS lexical FROM d),
adm AS (SELECT *, CASE WHEN path <> winner THEN 'rejected-duplicate' WHEN lexical < 1 THEN 'rejected-too-short' ELSE 'eligible' END AS admission,
  ('0x' || substr(sha256('17:content-sha256-v112:penstroke-v164:' || hash), 1, 16))::UBIGINT % 10 AS bucket FROM w),
a AS (SELECT *, CASE WHEN admission <> 'eligible' THEN '' WHEN bucket < 8 THEN 'train' WHEN bucket = 8 THEN 'calibrate' ELSE 'test' END AS split FROM adm)"""
_SEGMENTS = f"""{_ADMITTED}, sp AS (SELECT doc_id, source, split, string_split(text, chr(10)) AS ls FROM a WHERE admission = 'eligible'),
s AS (SELECT doc_id, source, split, i - 1 AS seg, ls[i] AS line, CASE WHEN source IN {_AUTHORS} THEN 'author' ELSE 'distractor' END AS class FROM sp, unnest(generate_series(1, len(ls))) AS g(i))"""
_RAW = f"""{_SEGMENTS}, tk AS (SELECT *, {_lex('line')} AS t FROM s),
raw AS (SELECT *, len(t) AS lexical, CASE WHEN len(t) > 0 THEN len(t)::DOUBLE END AS n, coalesce(list_sum(list_transform(t, lambda x: length(x))), 0)::DOUBLE AS chars,
  coalesce(list_sum(list_transform(t, lambda x: length(x) * length(x))), 0)::DOUBLE AS squares,
  length(regexp_replace(line, '[^,]', '', 'g')) AS n0, length(regexp_replace(line, '[^;]', '', 'g')) AS n1, length(regexp_replace(line, '[^:]', '', 'g')) AS n2,
  len(list_filter(t, lambda x: list_contains({_in(C.FUNCTION_WORDS)}, lower(x)))) AS fw, len(list_filter(t, lambda x: list_contains({_in(C.CLAUSE_MARKERS)}, lower(x)))) AS cm FROM tk)"""
_VECTORS = f"""{_RAW}, v AS (SELECT doc_id, source, split, class, seg, lexical, chars / n AS word_length_mean,
  CASE WHEN n >= 2 THEN greatest((squares - chars * (chars / n)) / (n - 1), 0) / n END AS sv_word_length_mean, n0 / n AS comma_density, n0 / n / n AS sv_comma_density,
  n1 / n AS semicolon_density, n1 / n / n AS sv_semicolon_density, n2 / n AS colon_density, n2 / n / n AS sv_colon_density,
  fw / n AS function_word_rate, fw / n * (1 - fw / n) / n AS sv_function_word_rate, cm / n AS clause_marker_rate, cm / n * (1 - cm / n) / n AS sv_clause_marker_rate
  FROM raw WHERE lexical >= {C.MIN_LEXICAL})"""
_LONG = f"{_VECTORS}, l AS (" + " UNION ALL ".join(f"SELECT doc_id, source, split, class, seg, '{f}' AS feature, {f} AS value, sv_{f} AS sv FROM v" for f in C.FEATURES) + ")"
_STATS = f"""st AS (SELECT feature, count(value) AS n, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS undefined, CASE WHEN count(value) >= {C.MIN_OBSERVATIONS} THEN avg(value) END AS mean,
  CASE WHEN count(value) >= {C.MIN_OBSERVATIONS} THEN var_samp(value) END AS variance FROM l WHERE class = 'author' AND split = 'train' GROUP BY feature)"""
_Z = f"""{_LONG}, {_STATS}, r AS (SELECT l.*, CASE WHEN value IS NULL THEN 'feature-undefined' WHEN sv IS NULL THEN 'sampling-variance-undefined' WHEN mean IS NULL THEN 'profile-undefined'
  WHEN variance IS NULL THEN 'profile-variance-undefined' WHEN variance + sv <= 0 THEN 'zero-variance' END AS reason, mean, variance FROM l JOIN st USING (feature)),
z AS (SELECT *, CASE WHEN reason IS NULL THEN (value - mean) / sqrt(variance + sv) END AS z FROM r)"""
_REF = "ref AS (SELECT feature, z FROM z WHERE class = 'author' AND split = 'calibrate' AND z IS NOT NULL), rs AS (SELECT feature, count(*) AS size FROM ref GROUP BY feature)"


def _dev(split: str) -> str:
    """Ranks by windows over the union of queries and reference."""
    return f"""{_Z}, {_REF}, un AS (SELECT doc_id, seg, class, feature, z, reason, 0 AS w FROM z WHERE class = 'distractor' OR split = '{split}' UNION ALL SELECT NULL, NULL, NULL, feature, z, NULL, 1 FROM ref),
  rk AS (SELECT *, sum(w) OVER (PARTITION BY feature ORDER BY z RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(w) OVER (PARTITION BY feature, z) AS ties FROM un WHERE z IS NOT NULL),
  du AS (SELECT doc_id, seg, class, feature, CASE WHEN size >= {C.MIN_REFERENCE} THEN (upto - ties + ties / 2e0 + 0.5e0) / (size + 1) END AS u FROM rk LEFT JOIN rs USING (feature) WHERE w = 0
    UNION ALL SELECT doc_id, seg, class, feature, NULL FROM un WHERE z IS NULL),
  dv AS (SELECT *, CASE WHEN u IS NOT NULL THEN {probit_sql('u')} END AS dev FROM du)"""


def _dist(split: str) -> str:
    return f"{_dev(split)}, ds AS (SELECT class, doc_id, seg, count(dev) AS available, count(dev) >= {C.MIN_FEATURES} AS met, CASE WHEN count(dev) >= {C.MIN_FEATURES} THEN round(avg(abs(dev)), 9) END AS distance FROM dv GROUP BY class, doc_id, seg)"


_LIMITS = f"""x AS (SELECT class, distance, count(*) OVER (PARTITION BY class) AS size, count(*) OVER (PARTITION BY class ORDER BY distance RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  count(*) OVER (PARTITION BY class ORDER BY distance DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above FROM ds WHERE distance IS NOT NULL),
lm0 AS (SELECT min(CASE WHEN class = 'author' AND above / size::DOUBLE <= {C.AUTHOR_TARGET} THEN distance END) AS low, max(CASE WHEN class = 'distractor' AND upto / size::DOUBLE <= {C.DISTRACTOR_TARGET} THEN distance END) AS high,
  coalesce(max(CASE WHEN class = 'author' THEN size END), 0) AS authors, coalesce(max(CASE WHEN class = 'distractor' THEN size END), 0) AS distractors FROM x),
lm AS (SELECT CASE WHEN authors >= 20 AND distractors >= 10 THEN low END AS low, CASE WHEN authors >= 20 AND distractors >= 10 THEN high END AS high, authors, distractors FROM lm0)"""
_PASSAGES = "ps AS (SELECT DISTINCT sha256(trim(l)) AS h FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark) WHERE length(trim(l)) > 0)"
_DLINES = "dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)"
_PAIRS = """c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT o.conv_id || ':' || n.turn AS pair_id, o.text AS current, n.text AS candidate FROM c o JOIN c n ON o.conv_id = n.conv_id AND n.turn = o.turn + 1 WHERE o.role = 'user' AND n.role = 'assistant')"""
_CAND = f"{_LONG}, k AS (SELECT lpad(doc_id::VARCHAR, 20, '0') || ':' || lpad(seg::VARCHAR, 10, '0') AS id, source, feature, value FROM l WHERE class = 'author' AND split = 'train'), sr AS (SELECT id, source, feature, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY feature ORDER BY value) - 1 + count(*) OVER (PARTITION BY feature, value) / 2e0 + 0.5e0) / (count(value) OVER (PARTITION BY feature) + 1) END AS u FROM k)"
_Q = [f"q{i}" for i in range(len(C.FEATURES))]
_APART = "(" + " + ".join(f"coalesce(abs(a.{q} - b.{q}), 0)" for q in _Q) + ") / (" + " + ".join(f"(a.{q} IS NOT NULL AND b.{q} IS NOT NULL)::INT" for q in _Q) + ")"
_MET = " + ".join(f"(a.{q} IS NOT NULL AND b.{q} IS NOT NULL)::INT" for q in _Q) + " >= 3"
# the k least distances of each against all, by brute force
_DENS = f"""{_CAND}, sq AS (SELECT *, {probit_sql('u')} AS q FROM sr), wq AS (SELECT id, any_value(source) AS source, {", ".join(f"max(CASE WHEN feature = '{f}' THEN q END) AS q{i}" for i, f in enumerate(C.FEATURES))} FROM sq GROUP BY id),
  kk AS (SELECT least(greatest(floor(sqrt(count(*))), 3), 15)::INT AS k, count(*) AS n FROM wq),
  nr AS (SELECT a.id, min({_APART}, 15) AS best FROM wq a JOIN wq b ON a.id <> b.id WHERE {_MET} GROUP BY a.id),
  den AS (SELECT id, round(list_avg(best[1:k]), 6) AS density FROM nr, kk WHERE len(best) >= k),
  eli AS (SELECT id, density FROM (SELECT id, density, row_number() OVER (ORDER BY density, id) AS rn FROM den), kk WHERE rn <= ceil(0.75 * n))"""


def _medoids(picks: int) -> str:
    """Round by round over strata in order, sums of all pairs that are left: rd0, rd1, ... hold what was picked up to then."""
    out = f"""{_DENS}, ew AS (SELECT wq.*, 'paragraph|' || source AS stratum FROM wq JOIN eli USING (id)), so AS (SELECT stratum, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, stratum) AS place FROM ew GROUP BY stratum),
  ps AS (SELECT a.id AS a, b.id AS b, a.stratum, {_APART} AS apart FROM ew a JOIN ew b ON a.stratum = b.stratum AND a.id <> b.id WHERE {_MET}),
  sm AS (SELECT a AS id, stratum, sum(apart) AS total FROM ps GROUP BY a, stratum),
  rd0 AS (SELECT NULL::INT AS round, NULL::VARCHAR AS stratum, NULL::VARCHAR AS id, NULL::DOUBLE AS distance_sum, 0 AS place WHERE false)"""
    for n in range(1, picks + 1):
        out += f""", lf{n} AS (SELECT m.stratum, m.id, round(m.total - coalesce((SELECT sum(p.apart) FROM ps p WHERE p.a = m.id AND p.b IN (SELECT id FROM rd{n - 1})), 0), 6) AS total FROM sm m WHERE m.id NOT IN (SELECT id FROM rd{n - 1})),
  rd{n} AS (SELECT * FROM rd{n - 1} UNION ALL SELECT {n}, stratum, id, total, place FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY total, id) AS rn FROM lf{n}) JOIN so USING (stratum) WHERE rn = 1)"""
    return out


#: Scripts that the SQL looks for, letter by letter; the queries know all.
_SQL_SCRIPTS = ("Latin", "Greek", "Cyrillic", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Devanagari", "Thai", "Armenian", "Georgian")


def _scripts(name: str, source: str, key: str, text: str) -> str:
    of = "CASE " + " ".join(f"WHEN regexp_matches(c, '\\p{{{s}}}') THEN '{s}'" for s in _SQL_SCRIPTS) + " END"
    letters = f"SELECT {key}, c, count(*) AS k FROM (SELECT {key}, unnest(string_split({text}, '')) AS c FROM {source}) WHERE regexp_matches(c, '\\p{{L}}') GROUP BY ALL"
    return f"{name} AS (SELECT {key}, script, sum(k)::BIGINT AS letters FROM (SELECT {key}, k, {of} AS script FROM ({letters})) WHERE script IS NOT NULL GROUP BY {key}, script)"


def _sql_quotes(x: str) -> str:
    # an opening mark that is never closed takes the rest of the text with it
    every = f"regexp_extract_all({x}, '\"[^\"]*\"|“[^”]*”|[\"“](?s:.)*')"
    return f"list_filter({every}, lambda q: (left(q, 1) = '\"' AND right(q, 1) = '\"' AND length(q) > 1) OR (left(q, 1) = '“' AND right(q, 1) = '”'))"


def _items(name: str) -> str:
    neg = _in(preserve._NEGATIONS)
    # runs of digits with single separators, and a comma after them, are whole numbers or fall to digits
    words = LEXICAL.rsplit("|", 1)[0]
    chunks = f"list_filter(regexp_extract_all({name}, {_q(words + '|[0-9](?:[0-9]|[.,][0-9])*,?')}), lambda x: regexp_matches(x, '^[0-9][0-9.,]*$'))"
    good = "regexp_matches(x, '^([0-9]{1,3}(,[0-9]{3})+|[0-9]+[.][0-9]+|[0-9]{1,3}(,[0-9]{3})+[.][0-9]+)$')"
    number = f"flatten(list_transform({chunks}, lambda x: CASE WHEN {good} THEN [x] ELSE regexp_extract_all(x, '[0-9]+') END))"
    url = "(?:https?://|www[.])[^ \\t-\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*"
    strip = "'[.,;:!?)\\]}\"''”’]+$'"
    parts = {
        "number": number,
        "negation": f"list_filter(list_transform({_lex(name)}, lambda x: lower(x)), lambda x: list_contains({neg}, x))",
        "url": f"list_filter(list_transform(regexp_extract_all({name}, {_q(url)}), lambda x: regexp_replace(x, {strip}, '')), lambda x: x <> '')",
        "quote": _sql_quotes(name),
    }
    return " UNION ALL ".join([f"SELECT pair_id, '{k}' AS class, unnest({v}) AS item FROM wp" for k, v in parts.items()] + [f"SELECT pair_id, 'entity', unnest(list_filter(list_transform({_lex(name)}, lambda x: lower(x)), lambda x: list_contains(watched, x))) FROM wp"])


def _entities(name: str) -> str:
    return f"list_transform(list_filter({_lex(name)}, lambda x: regexp_matches(x, '^\\p{{Lu}}') AND NOT list_contains({_in(C.FUNCTION_WORDS)}, lower(x))), lambda x: lower(x))"


_DIFF = f"""{_PAIRS}, wp AS (SELECT *, list_concat({_entities('current')}, {_entities('candidate')}) AS watched FROM p),
cur AS ({_items('current')}), new AS ({_items('candidate')}),
nt AS (SELECT pair_id, class, item, sum(sign) AS net FROM (SELECT *, 1 AS sign FROM new UNION ALL SELECT *, -1 FROM cur) GROUP BY ALL HAVING sum(sign) <> 0),
df AS (SELECT pair_id, class, item, CASE WHEN net > 0 THEN 'invented' ELSE 'lost' END AS direction, abs(net)::BIGINT AS n FROM nt)"""
_SCR = f"{_scripts('so', 'p', 'pair_id', 'current')}, {_scripts('sn', 'p', 'pair_id', 'candidate')}"
_OVER = f"""sh AS (SELECT n.pair_id, n.script, coalesce(o.letters, 0) AS ol, n.letters AS nl, coalesce(o.letters / o.t, 0) AS os, n.letters / n.t AS ns
  FROM (SELECT *, sum(letters) OVER (PARTITION BY pair_id)::DOUBLE AS t FROM sn) n LEFT JOIN (SELECT *, sum(letters) OVER (PARTITION BY pair_id)::DOUBLE AS t FROM so) o USING (pair_id, script)),
ov AS (SELECT pair_id, script, ol AS old_letters, nl AS new_letters FROM sh WHERE os < {C.SCRIPT_ESTABLISHED} AND ns > {C.SCRIPT_CEILING} AND ((nl > ol AND ns > os) OR ns >= {C.SCRIPT_ESTABLISHED}))"""


def _framed(*parts: str) -> str:
    return "sha256(" + " || ".join(f"strlen({p})::VARCHAR || ':' || {p}" for p in parts) + ")"


_FLIST = ", ".join(f"round({f}, 9) AS {f}" for f in C.FEATURES)
_SVLIST = ", ".join(f"round(sv_{f}, 12) AS sv_{f}" for f in C.FEATURES)
_APO = "lower(replace(t, '’', ''''))"
_SUFFIX = "(" + " OR ".join(f"ends_with({_APO}, {_q(x)})" for x in C.CONTRACTION_SUFFIXES) + ")"
_HOST = f"list_contains({_in(C.S_HOSTS)}, regexp_replace({_APO}, '''s$', ''))"

ORACLE: dict[str, str] = {
    "doc_admission": f"WITH {_DOCS} SELECT path, true AS valid, starts_with(text, chr(65279)) AS had_bom, strlen(text) - CASE WHEN starts_with(text, chr(65279)) THEN 3 ELSE 0 END AS bytes, hash AS content_hash FROM d",
    "dedupe_first_wins": f"WITH {_DOCS} SELECT path, hash AS content_hash, CASE WHEN path <> first_value(path) OVER w THEN first_value(path) OVER w END AS duplicate_of FROM d WINDOW w AS (PARTITION BY hash ORDER BY path)",
    "split_assignment": f"WITH {_ADMITTED} SELECT doc_id, admission, split FROM a",
    "corpus_summary": f"WITH {_ADMITTED} SELECT count(*) AS documents, count(*) FILTER (admission = 'eligible') AS eligible, count(*) FILTER (admission = 'rejected-duplicate') AS duplicates, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'calibrate') AS calibrate, count(*) FILTER (split = 'test') AS test, sum(lexical)::BIGINT AS lexical_tokens FROM a",
    "check_statuses": f"WITH {_DOCS}, {_PASSAGES}, {_DLINES} SELECT unnest(['near-duplicate', 'language', 'contamination', 'source-control', 'overlap']) AS check_name, 'not-performed' AS state UNION ALL SELECT 'tool-output', CASE WHEN EXISTS (SELECT 1 FROM dl JOIN ps ON h = sha256(trim(line))) THEN 'failed' ELSE 'passed' END",
    "overlap_screen": f"WITH {_DOCS} SELECT hash AS content_hash FROM d WHERE source IN {_AUTHORS} INTERSECT SELECT hash FROM d WHERE source NOT IN {_AUTHORS}",
    "tool_output_screen": f"WITH {_DOCS}, {_PASSAGES}, {_DLINES} SELECT doc_id, bool_or(sha256(trim(line)) IN (SELECT h FROM ps)) AS tool_output FROM dl GROUP BY doc_id",
    "already_rewritten_flags": f"WITH {_DOCS}, {_PASSAGES}, {_DLINES} SELECT DISTINCT sha256(trim(line)) AS h, sha256(trim(line)) IN (SELECT h FROM ps) AS produced FROM dl",
    "token_counts": f"WITH {_DOCS} SELECT doc_id, len({_lex('text')}) AS lexical, len(regexp_extract_all(text, '[0-9]+')) AS digit_runs, len(regexp_extract_all(text, '[,;:.!?]')) AS punctuation, len(regexp_extract_all(text, '[\\p{{So}}\\p{{Sc}}]')) AS symbols FROM d",
    "sentential_lines": f"WITH {_DOCS}, q AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d), y AS (SELECT doc_id, i - 1 AS seg, len({_lex('ls[i]')}) AS words, regexp_matches(ls[i], '[.!?][\"''”’)\\]}}*_]* *$') AS terminal FROM q, unnest(generate_series(1, len(ls))) AS g(i)) SELECT doc_id, seg, words, terminal, (terminal AND words >= 4) OR words >= 8 AS sentential FROM y",
    "feature_vectors": f"WITH {_VECTORS} SELECT doc_id, seg, lexical, {_FLIST} FROM v",
    "sampling_variance": f"WITH {_VECTORS} SELECT doc_id, seg, {_SVLIST} FROM v",
    "paragraph_floor_partition": f"WITH {_RAW} SELECT split, class, count(*) FILTER (lexical >= {C.MIN_LEXICAL}) AS kept, count(*) FILTER (lexical < {C.MIN_LEXICAL}) AS below_floor FROM raw GROUP BY split, class",
    "profile_stats": f"WITH {_LONG}, {_STATS} SELECT feature, n, undefined, round(mean, 9) AS mean, round(variance, 9) AS variance FROM st",
    "profile_by_source": f"WITH {_LONG} SELECT source, feature, count(value) AS n, round(avg(value), 9) AS mean, round(var_samp(value), 9) AS variance FROM l GROUP BY source, feature",
    "profile_stats_mad": f"WITH {_LONG}, tr AS (SELECT * FROM l WHERE class = 'author' AND split = 'train'), m AS (SELECT feature, median(value) AS med FROM tr GROUP BY feature), e AS (SELECT tr.feature, value, abs(value - med) AS dev FROM tr JOIN m USING (feature)), md AS (SELECT feature, median(dev) AS mad FROM e GROUP BY feature) SELECT feature, count(value) AS n, round(avg(value), 9) AS mean, round(var_samp(value), 9) AS variance FROM e JOIN md USING (feature) WHERE mad = 0 OR dev <= 3e0 * {C.MAD_SCALE}e0 * mad GROUP BY feature",
    "standardized_values": f"WITH {_Z} SELECT doc_id, seg, feature, round(z, 9) AS z, reason FROM z WHERE class = 'author' AND split <> 'train'",
    "reference_sizes_caps": f"WITH {_Z}, q AS (SELECT feature, count(z) AS size, 1 - 1 / (2e0 * (count(z) + 1)) AS u FROM z WHERE class = 'author' AND split = 'calibrate' GROUP BY feature) SELECT feature, size, size >= {C.MIN_REFERENCE} AS available, round({probit_sql('u')}, 9) AS cap FROM q",
    "rank_transform": f"WITH {_dev('test')} SELECT doc_id, seg, feature, round(u, 9) AS u, round(dev, 9) AS dev FROM dv WHERE class = 'author'",
    "distance_scores": f"WITH {_dist('test')} SELECT class, doc_id, seg, available, met, distance FROM ds",
    "feature_deltas": f"WITH {_dev('test')} SELECT class, feature, CASE WHEN dev > 0 THEN 'above' WHEN dev < 0 THEN 'below' WHEN dev = 0 THEN 'typical' END AS direction, count(*) AS n FROM dv GROUP BY ALL",
    "tier_plan": f"WITH {_Z}, q AS (SELECT feature, count(z) AS size FROM z WHERE class = 'author' AND split = 'calibrate' GROUP BY feature), y AS (SELECT count(*) AS manifest, count(*) FILTER (size >= {C.MIN_REFERENCE}) AS available FROM q) SELECT manifest, available, (manifest // 2 + 1)::BIGINT AS required, available >= manifest // 2 + 1 AS met FROM y",
    "thresholds": f"WITH {_dist('calibrate')}, {_LIMITS} SELECT low, high, authors, distractors, CASE WHEN low IS NULL OR high IS NULL THEN 'uncalibrated' WHEN low < high THEN 'separated' ELSE 'pair-incompatible' END AS verdict FROM lm",
    "achieved_rates": f"WITH {_dist('calibrate')}, {_LIMITS} SELECT round(avg(CASE WHEN class = 'author' THEN (distance >= low)::INT END), 9) AS author_rate, round(avg(CASE WHEN class = 'distractor' THEN (distance <= high)::INT END), 9) AS distractor_rate FROM ds, lm WHERE distance IS NOT NULL",
    "auc_midrank": f"WITH {_dist('test')}, y AS (SELECT class, distance AS x FROM ds WHERE distance IS NOT NULL), pr AS (SELECT avg(CASE WHEN p.x > q.x THEN 1e0 WHEN p.x = q.x THEN 0.5e0 ELSE 0e0 END) AS auc FROM y p, y q WHERE p.class = 'distractor' AND q.class = 'author') SELECT round(auc, 9) AS auc, (SELECT count(*) FROM y WHERE class = 'distractor') AS positives, (SELECT count(*) FROM y WHERE class = 'author') AS negatives FROM pr",
    "quality_auc": "WITH y AS (SELECT quality, n_chars AS x FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL), pr AS (SELECT avg(CASE WHEN p.x > q.x THEN 1e0 WHEN p.x = q.x THEN 0.5e0 ELSE 0e0 END) AS auc FROM y p, y q WHERE p.quality = 1 AND q.quality <> 1) SELECT round(auc, 9) AS auc, (SELECT count(*) FROM y WHERE quality = 1) AS positives, (SELECT count(*) FROM y WHERE quality <> 1) AS negatives FROM pr",
    "self_midrank": f"WITH {_CAND} SELECT id, feature, round(u, 9) AS u, round({probit_sql('u')}, 9) AS q FROM sr",
    "exemplar_density": f"WITH {_DENS} SELECT wq.id, density FROM wq LEFT JOIN den USING (id)",
    "exemplar_eligible": f"WITH {_DENS} SELECT id, density FROM eli",
    "exemplar_medoids": f"WITH {_medoids(2)} SELECT round, stratum, id, distance_sum FROM rd2 ORDER BY round, place LIMIT 12",
    "exemplar_certificate": f"WITH {_DENS} SELECT k, n AS population, (SELECT count(*) FROM eli) AS eligible, (SELECT round(sum(density), 3) FROM eli) AS density FROM kk",
    "stratum_order": f"WITH {_SEGMENTS}, y AS (SELECT 'paragraph|' || source AS stratum, count(*) AS size FROM s WHERE class = 'author' GROUP BY 1) SELECT stratum, size, row_number() OVER (ORDER BY size DESC, stratum) AS place FROM y",
    "lint_severity_vector": f"WITH {_DOCS}, y AS (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, {_q(r.pattern)})) AS n{i}" for i, r in enumerate(DERIVED)) + " FROM d) SELECT doc_id, n0 AS errors, n1 AS warns, 0 AS infos, CASE WHEN n0 + n1 > 0 THEN 'flagged' ELSE 'indeterminate' END AS screening FROM y WHERE n0 + n1 + n2 > 0",
    "preserve_differences": f"WITH {_DIFF} SELECT pair_id, class, item, direction, n FROM df",
    "audit_identifiers": f"WITH {_DIFF} SELECT DISTINCT class, direction, item, 'preserve-v1:' || class || ':' || direction || ':' || substr(sha256('preserve-v1' || chr(0) || class || chr(0) || direction || chr(0) || item), 1, 16) AS identifier FROM df",
    "script_counts": f"WITH {_DOCS}, {_scripts('y', 'd', 'doc_id', 'text')} SELECT doc_id, script, letters FROM y",
    "expansion_guard": f"WITH {_PAIRS} SELECT pair_id, len({_lex('current')}) AS n_current, len({_lex('candidate')}) AS n_candidate, len({_lex('candidate')}) > 1.5 * len({_lex('current')}) AS expanded FROM p",
    "rejection_codes": f"WITH {_DIFF}, {_SCR}, {_OVER}, y AS (SELECT pair_id, len({_lex('current')}) AS a, len({_lex('candidate')}) AS b FROM p) SELECT pair_id, CASE WHEN a = 0 THEN 'unscoreable' WHEN b = 0 THEN 'candidate-unscoreable' WHEN pair_id IN (SELECT pair_id FROM df) THEN 'not-preserved' WHEN b > 1.5 * a THEN 'expanded' WHEN pair_id IN (SELECT pair_id FROM sn ANTI JOIN so USING (pair_id, script)) THEN 'language' WHEN pair_id IN (SELECT pair_id FROM ov) THEN 'language-growth' ELSE '' END AS code FROM y",
    "urls_extracted": f"WITH y AS (SELECT page_id, unnest(list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '(?:https?://|www[.])[^ \\t-\\r\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]*'), lambda x: regexp_replace(x, '[.,;:!?)\\]}}\"''”’]+$', '')), lambda x: x <> '')) AS url FROM pages) SELECT page_id, url, count(*) AS n FROM y GROUP BY page_id, url",
    "quotes_extracted": f"WITH y AS (SELECT page_id, unnest({_sql_quotes("coalesce(html, '')")}) AS quote FROM pages) SELECT page_id, count(*) AS n, sum(length(quote))::BIGINT AS chars FROM y GROUP BY page_id",
    "interval_union": "WITH e AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + trunc(value * 1e6)::BIGINT AS e FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value > 0), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM e), i AS (SELECT *, sum(CASE WHEN upto IS NULL OR s >= upto THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM m) SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS parts FROM i GROUP BY user_id, island",
    "content_ids": f"WITH {_DOCS} SELECT path, {_framed(_q('snapshot'), 'path')} AS document_id, {_framed(_framed(_q('snapshot'), 'path'), _q('0'))} AS node_id FROM d",
}
ORACLE["band_occupancy"] = f"""WITH lim AS (WITH {_dist('calibrate')}, {_LIMITS} SELECT least(low, high) AS low, greatest(low, high) AS high FROM lm), dd AS (WITH {_dist('test')} SELECT class, distance FROM ds),
y AS (SELECT class, CASE WHEN low <= high THEN CASE WHEN distance <= low THEN 'in-range' WHEN distance >= high THEN 'not-you' WHEN distance IS NOT NULL THEN 'drifting' END END AS band FROM dd, lim)
SELECT band, count(*) FILTER (class = 'author') AS author, count(*) FILTER (class = 'distractor') AS distractor FROM y WHERE band IS NOT NULL GROUP BY band"""
ORACLE |= {
    "replacement_shift": f"WITH {_DOCS}, q AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d), y AS (SELECT doc_id, i - 1 AS start, strlen(ls[i]) AS length, strlen(ls[i]) * 2 % 7 AS new_length FROM q, unnest(generate_series(1, len(ls))) AS g(i)) SELECT doc_id, start, start + coalesce(sum(new_length - length) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_start FROM y",
    "register_selection": "SELECT * FROM (VALUES ('none', 'no-profile', NULL), ('one', 'sole-head', 'en'), ('many', 'ambiguous', NULL), ('named', 'explicit', 'de'), ('unknown', 'unknown-register', NULL)) AS t(asked, state, register)",
    "head_pointers": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
    "sole_artifact": "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS priority, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN 'sole' ELSE 'ambiguous' END AS state FROM orders GROUP BY o_custkey",
    "ordinal_gaps": "SELECT DISTINCT l_orderkey FROM (SELECT l_orderkey, l_linenumber - 1 AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS want FROM lineitem WHERE l_quantity > 2) WHERE o <> want",
    "invalid_ids": f"WITH {_DOCS} SELECT doc_id FROM d WHERE doc_id % 7 = 0 AND regexp_matches(hash, '[a-f]')",
    "rehydrate_nodes": "SELECT CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'content-changed' ELSE 'ok' END AS outcome, count(*) AS n FROM documents GROUP BY 1",
    "reachability_prune": "WITH RECURSIVE e AS (SELECT 'region' AS fk, n_regionkey::BIGINT AS fi, 'nation' AS tk, n_nationkey::BIGINT AS ti FROM nation UNION ALL SELECT 'nation', c_nationkey, 'customer', c_custkey FROM customer UNION ALL SELECT 'customer', o_custkey, 'order', o_orderkey FROM orders), r AS (SELECT 'region' AS kind, r_regionkey::BIGINT AS id FROM region WHERE r_regionkey < 2 UNION SELECT tk, ti FROM r JOIN e ON fk = kind AND fi = id) SELECT DISTINCT tk AS kind, ti AS id FROM e ANTI JOIN r ON tk = kind AND ti = id",
}


def _resampled(seed: int) -> str:
    """Draws by SplitMix64 in 64-bit arithmetic, row by row, over the distances ds: rcl (clusters), rws (weights by resample and distance), rnn (their sums)."""
    top = "18446744073709551616::UHUGEINT"

    def mixed(z: str, shift: int, factor: str) -> str:
        return f"(xor({z}, {z} >> {shift}) * {factor}::UHUGEINT) % {top}"

    return f"""rcl AS (SELECT class, document, row_number() OVER (PARTITION BY class ORDER BY document) - 1 AS code, count(*) OVER (PARTITION BY class) AS n FROM (SELECT DISTINCT class, doc_id::VARCHAR AS document FROM ds WHERE distance IS NOT NULL)),
rcn AS (SELECT class, max(n) AS n FROM rcl GROUP BY class),
z0 AS (SELECT class, n, r, (({seed} + CASE class WHEN 'author' THEN 1 ELSE 2 END)::UHUGEINT + (r * n + k)::UHUGEINT * 11400714819323198485::UHUGEINT) % {top} AS z FROM rcn, range({C.RESAMPLES}) AS a(r), unnest(range(1, n + 1)) AS b(k)),
z1 AS (SELECT class, n, r, {mixed("z", 30, "13787848793156543929")} AS z FROM z0), z2 AS (SELECT class, n, r, {mixed("z", 27, "10723151780598845931")} AS z FROM z1),
dw AS (SELECT class, r, (xor(z, z >> 31) % n::UHUGEINT)::BIGINT AS code, count(*) AS times FROM z2 GROUP BY ALL),
rce AS (SELECT class, doc_id::VARCHAR AS document, distance, count(*) AS ties FROM ds WHERE distance IS NOT NULL GROUP BY ALL),
rws AS (SELECT class, r, distance, sum(times * ties) AS w FROM rce JOIN rcl USING (class, document) JOIN dw USING (class, code) GROUP BY ALL),
rcu AS (SELECT *, sum(w) OVER (PARTITION BY class, r) AS total, sum(w) OVER (PARTITION BY class, r ORDER BY distance) AS upto FROM rws),
rnn AS (SELECT r, sum(w) FILTER (class = 'author') AS na, sum(w) FILTER (class = 'distractor') AS nd FROM rws GROUP BY r)"""


_ORDERED = f"""rts AS (SELECT r, min(CASE WHEN class = 'author' AND (total - upto + w) / total::DOUBLE <= {C.AUTHOR_TARGET} THEN distance END) AS low, max(CASE WHEN class = 'distractor' AND upto / total::DOUBLE <= {C.DISTRACTOR_TARGET} THEN distance END) AS high FROM rcu GROUP BY r),
ok AS (SELECT low, high FROM rts JOIN rnn USING (r) WHERE na >= 20 AND nd >= 10 AND low IS NOT NULL AND high IS NOT NULL),
ar AS (SELECT list_sort(list(low)) AS l, list_sort(list(high)) AS h, count(*) AS q FROM ok)"""
_DRAWS = C.BOOTSTRAP_SEED
# the SQL's own order statistics: index floor(p n) from 0, at most the last
ORACLE["bootstrap_intervals"] = f"""WITH {_dist('calibrate')}, {_resampled(_DRAWS)}, {_ORDERED},
iv AS (SELECT l[least(floor((1 - {C.CONFIDENCE}) / 2 * q), q - 1)::INT + 1] AS low_lower, l[least(floor((1 - (1 - {C.CONFIDENCE}) / 2) * q), q - 1)::INT + 1] AS low_upper,
  h[least(floor((1 - {C.CONFIDENCE}) / 2 * q), q - 1)::INT + 1] AS high_lower, h[least(floor((1 - (1 - {C.CONFIDENCE}) / 2) * q), q - 1)::INT + 1] AS high_upper, q FROM ar)
SELECT low_lower, low_upper, high_lower, high_upper, q::INT AS qualified, {C.RESAMPLES} AS resamples, q / {C.RESAMPLES}::DOUBLE >= {C.MIN_QUALIFIED} AS usable, coalesce(low_upper < high_lower, false) AS actionable,
  q / {C.RESAMPLES}::DOUBLE >= {C.MIN_QUALIFIED} AND coalesce(low_upper < high_lower, false) AS shippable,
  CASE WHEN q / {C.RESAMPLES}::DOUBLE < {C.MIN_QUALIFIED} THEN 'insufficient-qualified-resamples' WHEN coalesce(low_upper < high_lower, false) THEN '' ELSE 'overlapping-intervals' END AS reason FROM iv"""
_BOUNDS = f"""lim AS (WITH {_dist('calibrate')}, {_LIMITS} SELECT low, high, CASE WHEN low IS NULL OR high IS NULL THEN 'uncalibrated' WHEN low < high THEN 'separated' ELSE 'pair-incompatible' END AS verdict FROM lm), ds AS (SELECT * FROM (WITH {_dist('test')} SELECT * FROM ds)), {_resampled(_DRAWS)},
er AS (SELECT r, sum(CASE WHEN class = 'author' AND distance >= lim.high THEN w ELSE 0 END) / max(na)::DOUBLE AS ae, sum(CASE WHEN class = 'distractor' AND distance <= lim.low THEN w ELSE 0 END) / max(nd)::DOUBLE AS de FROM rws JOIN rnn USING (r), lim GROUP BY r),
el AS (SELECT list_sort(list(ae)) AS a, list_sort(list(de)) AS d FROM er),
eb AS (SELECT 'not-you' AS band, CASE WHEN (SELECT high FROM lim) IS NOT NULL THEN greatest(a[least(floor({C.CONFIDENCE} * len(a)), len(a) - 1)::INT + 1], 3e0 / (SELECT n FROM rcn WHERE class = 'author')) END AS bound, {C.AUTHOR_TARGET} AS target FROM el
  UNION ALL SELECT 'in-range', CASE WHEN (SELECT low FROM lim) IS NOT NULL THEN greatest(d[least(floor({C.CONFIDENCE} * len(d)), len(d) - 1)::INT + 1], 3e0 / (SELECT n FROM rcn WHERE class = 'distractor')) END, {C.DISTRACTOR_TARGET} FROM el),
bd AS (SELECT band, bound, coalesce(bound <= target, false) AS emitted, CASE WHEN bound IS NULL THEN 'empty-error-class' WHEN bound <= target THEN '' ELSE 'error-bound-exceeds-target' END AS reason FROM eb)"""
_AUCS = f"""rbc AS (SELECT r, distance, sum(CASE WHEN class = 'author' THEN w ELSE 0 END) AS wa, sum(CASE WHEN class = 'distractor' THEN w ELSE 0 END) AS wd FROM rws GROUP BY ALL),
uc AS (SELECT *, sum(wd) OVER (PARTITION BY r ORDER BY distance DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM rbc),
au AS (SELECT r, sum(wa * (coalesce(over, 0) + wd / 2e0)) / max(na * nd)::DOUBLE AS auc FROM uc JOIN rnn USING (r) GROUP BY r), al AS (SELECT list_sort(list(auc)) AS u FROM au),
ab AS (SELECT least(u[least(floor((1 - {C.CONFIDENCE}) * len(u)), len(u) - 1)::INT + 1], 1 - 3e0 / (SELECT min(n) FROM rcn)) AS auc_lower FROM al)"""
ORACLE["band_error_bounds"] = f"WITH {_BOUNDS} SELECT band, bound, emitted, reason FROM bd"
ORACLE["auc_lower_bound"] = f"WITH {_BOUNDS}, {_AUCS} SELECT round(auc_lower, 9) AS auc_lower, auc_lower >= {C.AUC_FLOOR} AS passed FROM ab"
ORACLE["release_verdict"] = f"""WITH {_BOUNDS}, {_AUCS}, rv AS (SELECT verdict, (SELECT count(*) FROM bd WHERE emitted) AS emitted, auc_lower FROM lim, ab)
SELECT verdict, emitted, round(auc_lower, 9) AS auc_lower, CASE WHEN auc_lower < {C.AUC_FLOOR} THEN 'discrimination-failed' WHEN verdict <> 'separated' OR emitted = 0 THEN 'uncalibrated' ELSE '' END AS reason, auc_lower >= {C.AUC_FLOOR} AND verdict = 'separated' AND emitted > 0 AS shippable FROM rv"""
ORACLE["accepted_attempts"] = f"""WITH {_dist('test')}, tr AS (SELECT doc_id AS target, list({{'i': seg - 1, 'd': distance}} ORDER BY seg) FILTER (seg > 0) AS a, max(distance) FILTER (seg = 0) AS start FROM ds WHERE distance IS NOT NULL GROUP BY doc_id),
ac AS (SELECT target, list_reduce(list_prepend({{'i': -1::BIGINT, 'd': start}}, a), lambda s, x: CASE WHEN x.d <= s.d - {C.EPSILON} THEN x ELSE s END) AS s FROM tr WHERE start IS NOT NULL AND a IS NOT NULL)
SELECT target, s.i::INT AS accepted, s.d AS distance FROM ac"""
ORACLE["paragraph_dispositions"] = f"""WITH {_DOCS}, {_PASSAGES}, lim AS (WITH {_dist('calibrate')}, {_LIMITS} SELECT low, high FROM lm), dd AS (WITH {_dist('test')} SELECT class, doc_id, seg, distance FROM ds),
lx AS (SELECT doc_id, i - 1 AS seg, string_split(text, chr(10))[i] AS line FROM d, unnest(generate_series(1, len(string_split(text, chr(10))))) AS g(i))
SELECT class, CASE WHEN distance IS NULL THEN 'unmeasurable' WHEN sha256(trim(line)) IN (SELECT h FROM ps) THEN 'already-rewritten' WHEN low <= high AND distance <= low THEN 'in-range' WHEN contains(line, '`') THEN 'contains-excisions' ELSE 'target' END AS disposition, count(*) AS n
FROM dd JOIN lx USING (doc_id, seg), lim GROUP BY ALL"""
