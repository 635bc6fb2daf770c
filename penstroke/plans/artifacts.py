"""Queries of identities, rewriting rounds and pruning, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import lexical_tokens
from ..functions.tables import materialize, read
from ..operators import corpus, identity, rounds, store
from . import catalogue as K

POLICY = {"min-lexical": 1, "seed": "penstroke-v1", "weights": "8/1/1"}
ATTEMPTS = 6


def snapshot_identity(spark, sf):
    docs = materialize(K._admitted(spark, sf), "admitted")
    return docs.agg(F.count("*").alias("documents")).withColumn("snapshot_id", F.lit(identity.snapshot_id(docs, identity.policy_id(spark, **POLICY))))


def _edited(spark, sf) -> DataFrame:
    """The corpus with some texts changed and some gone, admitted again."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return corpus.admitted(K._docs(spark, sf).where("doc_id % 11 <> 0").withColumn("text", text))


def snapshot_changes(spark, sf):
    return identity.changes(K._admitted(spark, sf), _edited(spark, sf))


def profile_identity(spark, sf):
    stats = K.profile_stats(spark, sf).select("feature", "n", "mean", "variance")
    return spark.range(1).select(F.lit(identity.artifact_id(materialize(stats, "stats"), "profile", register="all")).alias("profile_id"))


def _measured(spark, sf) -> DataFrame:
    """Every line as a measured text: what it is measured as follows from its characters alone."""
    lines, n = corpus.lines(K._docs(spark, sf)), F.col("n")
    lines = lines.withColumns({"n": F.char_length("line"), "lexical": F.size(lexical_tokens(F.col("line")))})
    return lines.select(
        F.col("doc_id").alias("target"), (F.col("seg") - 1).alias("index"), F.when(n % 17 == 3, 2).otherwise(1).alias("segments"), F.when(F.col("lexical") > 0, (n % 97) / 10).alias("distance"), (n % 19 != 4).alias("banded"),
        F.when(n % 13 == 5, F.lit(["a", "b"])).otherwise(F.lit(["a", "b", "c"])).alias("features"), "lexical", F.when(n % 11 == 6, F.lit(["Greek", "Latin"])).otherwise(F.lit(["Latin"])).alias("scripts"), (n % 3).alias("errors"),
        F.lit(0).alias("warns"), F.lit(0).alias("infos"), (n % 23 != 7).alias("comparable"), (n == 0).alias("empty"), (n % 5 != 1).alias("preserved"), (n % 7 == 2).alias("overgrown"), (n % 2 == 0).alias("intact"),
    )


def _rounds(spark, sf) -> rounds.Outcome:
    """Each document's first line as the paragraph, and the lines after it as its candidates."""
    measured = materialize(_measured(spark, sf), "measured")
    return rounds.run(measured.where("index = -1"), measured.where("index >= 0"), ATTEMPTS)


def rewrite_rounds(spark, sf):
    return _rounds(spark, sf).targets


def rewrite_attempts(spark, sf):
    a = _rounds(spark, sf).attempts
    return a.groupBy("code").agg(F.count("*").alias("attempts"), F.count_if("accepted").alias("accepted"), F.count_if(F.size("introduced") > 0).alias("introduced"), F.sum("comparison").alias("comparison"))


def _tables(spark, sf) -> dict[str, DataFrame]:
    """Artifacts of documents: a snapshot, a profile, a reference and a selection for each source, three nodes for each document."""
    d = read(spark, sf, "documents").where("source is not null").select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("source").alias("snapshot_id"), F.regexp_extract("source", "[0-9]+$", 0).cast("int").alias("k"))
    s = d.select(F.col("snapshot_id").alias("source"), "k").distinct()
    profile, of = F.concat(F.lit("p"), "source").alias("profile_id"), F.concat(F.lit("p"), "source")
    node = F.concat_ws(":", "id", "i")
    owner = s.select(F.concat(F.lit("x"), "source").alias("selection_id"), F.col("k").cast("long").alias("own"))
    members = d.withColumn("own", F.col("doc_id") % 40).join(owner, "own").select("selection_id", F.concat_ws(":", "id", F.lit(0)).alias("node_id"))
    return {
        "snapshot": s.select(F.col("source").alias("id")), "document": d.select("id", "snapshot_id"), "node": d.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(node.alias("id"), F.col("id").alias("document_id")),
        "profile": s.select(of.alias("id"), F.col("source").alias("snapshot_id")), "reference": s.select(F.concat(F.lit("r"), "source").alias("id"), profile), "selection": s.select(F.concat(F.lit("x"), "source").alias("id"), profile),
        "selection_member": members, "evaluation": s.where("k % 9 = 4").select(profile), "attempt": d.where("doc_id % 97 = 0").select(F.lit(None).cast("string").alias("profile_id"), F.concat_ws(":", "id", F.lit(1)).alias("node_id")),
        "head": s.select(F.col("source").alias("register"), profile), "threshold": s.select(F.concat(F.lit("t"), "source").alias("id"), profile),
    }


def _keep(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["profile"].where("id in ('psrc1', 'psrc2')").select("id")


def kept_artifacts(spark, sf):
    tables = _tables(spark, sf)
    return store.kept_artifacts(tables, _keep(tables))


def pruned_artifacts(spark, sf):
    tables = _tables(spark, sf)
    return store.prune_artifacts(tables, _keep(tables))[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (snapshot_identity, snapshot_changes, profile_identity, rewrite_rounds, rewrite_attempts, kept_artifacts, pruned_artifacts)}


def _named(**fields: str) -> str:
    """A hash of named fields, each of them SQL; nulls are marked."""
    parts = []
    for name in sorted(fields):
        parts += [K._q(name), f"CASE WHEN {fields[name]} IS NULL THEN '-' ELSE '+' || ({fields[name]})::VARCHAR END"]
    return K._framed(*[f"({p})" for p in parts])


def _tree(members: str) -> str:
    """The levels of the tree over a relation with a column digest; t0 has its one row."""
    out, at = [], (members, "digest")
    for n in identity.PREFIXES:
        out.append(f"t{n} AS (SELECT left({at[1]}, {n}) AS p, sha256(string_agg(digest, '' ORDER BY digest)) AS digest FROM {at[0]} GROUP BY 1)")
        at = (f"t{n}", "p")
    return ", ".join(out)


def _number(x: str) -> str:
    """A double's shortest digits, put as `identity.shortest` puts them, from the engine's own shortest text."""
    s = f"abs({x})::VARCHAR"
    mantissa, power = f"regexp_replace({s}, 'e.*', '')", f"coalesce(TRY_CAST(regexp_extract({s}, 'e([+-]?[0-9]+)$', 1) AS INT), 0)"
    every = f"replace({mantissa}, '.', '')"
    digits = f"regexp_replace(regexp_replace({every}, '^0+', ''), '0+$', '')"
    point = f"(length(split_part({mantissa}, '.', 1)) + {power} - (length({every}) - length(regexp_replace({every}, '^0+', ''))))"
    big = f"left({digits}, 1) || CASE WHEN length({digits}) > 1 THEN '.' || substr({digits}, 2) ELSE '' END || CASE WHEN {point} < 1 THEN 'e-' ELSE 'e+' END || lpad(abs({point} - 1)::VARCHAR, greatest(2, length(abs({point} - 1)::VARCHAR))::INT, '0')"
    plain = f"CASE WHEN {point} <= 0 THEN '0.' || repeat('0', -{point}) || {digits} WHEN {point} >= length({digits}) THEN rpad({digits}, {point}::INT, '0') ELSE left({digits}, {point}) || '.' || substr({digits}, {point} + 1) END"
    return f"(CASE WHEN {x} = 0 THEN '0' WHEN {x} IS NOT NULL THEN CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE WHEN {point} < -3 OR {point} > 6 THEN {big} ELSE {plain} END END)"


_MEMBER = _named(path="path", content="hash", admission="admission", duplicate="CASE WHEN path <> winner THEN winner END")
_POLICY = _named(**{k: K._q(str(v)) for k, v in POLICY.items()})
_NEW = K._ADMITTED.replace("FROM documents", "FROM (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)")
_SIDE = "SELECT path, hash AS content_hash, admission, CASE WHEN path <> winner THEN winner END AS duplicate_of FROM a"
_ROUNDS = f"""RECURSIVE ln AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), m0 AS (SELECT doc_id AS target, (i - 2)::INT AS index, length(ls[i]) AS n, len({K._lex("ls[i]")}) AS lexical FROM ln, unnest(generate_series(1, len(ls))) AS g(i)),
mm AS (SELECT target, index, lexical, CASE WHEN n % 17 = 3 THEN 2 ELSE 1 END AS segments, CASE WHEN lexical > 0 THEN (n % 97) / 10e0 END AS distance, n % 19 <> 4 AS banded, n % 13 = 5 AS few, n % 11 = 6 AS greek, n % 3 AS errors, n % 23 <> 7 AS comparable,
  n = 0 AS empty, n % 5 <> 1 AS preserved, n % 7 = 2 AS overgrown, n % 2 = 0 AS intact FROM m0),
st AS (SELECT target, -1 AS index, CASE WHEN segments <> 1 THEN 'not-one-segment' WHEN distance IS NULL THEN 'unscoreable' WHEN NOT banded THEN 'uncalibrated' ELSE '' END AS reason, -1 AS accepted, distance, few, greek, errors, comparable, lexical AS original,
    NULL::VARCHAR AS code, false AS introduced, 0 AS comparison, false AS ended FROM mm WHERE index = -1
  UNION ALL SELECT target, index, reason, CASE WHEN code = '' THEN index ELSE accepted END, CASE WHEN code = '' THEN nd ELSE distance END, CASE WHEN code = '' THEN nf ELSE few END, CASE WHEN code = '' THEN ng ELSE greek END, CASE WHEN code = '' THEN ne ELSE errors END,
    CASE WHEN code = '' THEN nc ELSE comparable END, original, code, ng AND NOT greek, sign(ne - errors)::INT, coalesce(gone, true) FROM (
      SELECT st.target, st.index + 1 AS index, st.reason, st.accepted, st.distance, st.few, st.greek, st.errors, st.comparable, st.original, c.distance AS nd, c.few AS nf, c.greek AS ng, c.errors AS ne, c.comparable AS nc, c.target IS NULL OR c.empty AS gone,
        CASE WHEN c.target IS NULL OR c.empty THEN NULL WHEN c.segments <> 1 THEN 'not-one-segment' WHEN c.distance IS NULL THEN 'candidate-unscoreable' WHEN NOT c.banded THEN 'uncalibrated' WHEN c.few <> st.few THEN 'different-features' WHEN NOT c.preserved THEN 'not-preserved'
          WHEN c.lexical > {C.EXPANSION} * st.original THEN 'expanded' WHEN c.greek AND NOT st.greek THEN 'language' WHEN c.overgrown THEN 'language-growth' WHEN NOT (c.comparable AND st.comparable) THEN 'tells-incomparable' WHEN c.errors > st.errors THEN 'tells-worse'
          WHEN c.distance > st.distance - {C.EPSILON} THEN 'not-improved' WHEN NOT c.intact THEN 'not-spliceable' ELSE '' END AS code
      FROM st LEFT JOIN mm c ON c.target = st.target AND c.index = st.index + 1 WHERE st.reason = '' AND NOT st.ended AND st.index + 1 < {ATTEMPTS}))"""
_ARTIFACTS = """RECURSIVE d AS (SELECT doc_id, doc_id::VARCHAR AS id, source, regexp_extract(source, '[0-9]+$')::INT AS k FROM documents WHERE source IS NOT NULL), s AS (SELECT DISTINCT source, k FROM d),
nd AS (SELECT id || ':' || i AS id, id AS document, source FROM d, range(3) AS g(i)), mb AS (SELECT 'x' || s.source AS x, d.id || ':0' AS node FROM d JOIN s ON d.doc_id % 40 = s.k),
e AS (SELECT 'profile' AS fk, 'p' || source AS fi, 'snapshot' AS tk, source AS ti FROM s UNION ALL SELECT 'profile', 'p' || source, 'reference', 'r' || source FROM s UNION ALL SELECT 'profile', 'p' || source, 'selection', 'x' || source FROM s
  UNION ALL SELECT 'snapshot', source, 'document', id FROM d UNION ALL SELECT 'document', document, 'node', id FROM nd UNION ALL SELECT 'node', id, 'document', document FROM nd UNION ALL SELECT 'document', id, 'snapshot', source FROM d UNION ALL SELECT 'selection', x, 'node', node FROM mb),
r AS (SELECT * FROM (SELECT 'profile' AS kind, 'p' || source AS id FROM s WHERE source IN ('src1', 'src2') OR k % 9 = 4 UNION SELECT 'node', id || ':1' FROM d WHERE doc_id % 97 = 0) UNION SELECT tk, ti FROM r JOIN e ON fk = kind AND fi = id)"""

ORACLE: dict[str, str] = {
    "snapshot_identity": f"WITH {K._ADMITTED}, mb AS (SELECT {_MEMBER} AS digest FROM a), {_tree('mb')} SELECT (SELECT count(*) FROM a) AS documents, {_named(algorithm=K._q(identity.ALGORITHM), policy=_POLICY, documents='digest')} AS snapshot_id FROM t0",
    "snapshot_changes": f"""WITH o AS (WITH {K._ADMITTED} {_SIDE}), n AS (WITH {_NEW} {_SIDE}), j AS (SELECT coalesce(o.path, n.path) AS path, o.path IS NULL AS added, n.path IS NULL AS removed, o.content_hash AS oc, n.content_hash AS nc, o.admission AS oa, n.admission AS na, o.duplicate_of AS od, n.duplicate_of AS nd FROM o FULL JOIN n ON o.path = n.path)
SELECT path, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN oc <> nc THEN 'content_hash' WHEN oa <> na THEN 'admission' ELSE 'duplicate_of' END AS change,
  CASE WHEN NOT (added OR removed) THEN CASE WHEN oc <> nc THEN oc WHEN oa <> na THEN oa ELSE od END END AS before, CASE WHEN NOT (added OR removed) THEN CASE WHEN oc <> nc THEN nc WHEN oa <> na THEN na ELSE nd END END AS after
FROM j WHERE added OR removed OR oc <> nc OR oa <> na OR od IS DISTINCT FROM nd""",
    "profile_identity": f"""WITH ps AS ({K.ORACLE["profile_stats"]}), mb AS (SELECT {_named(feature="feature", n="n", mean=_number("mean"), variance=_number("variance"))} AS digest FROM ps), {_tree('mb')}
SELECT {_named(kind="'profile'", rows="digest", **{"header register": "'all'"})} AS profile_id FROM t0""",
    "rewrite_rounds": f"""WITH {_ROUNDS}, la AS (SELECT target, max(index) AS index FROM st GROUP BY target)
SELECT target, CASE WHEN reason <> '' THEN 'not-entered' WHEN ended THEN 'empty-provider-response' ELSE 'attempts-exhausted' END AS terminal, reason, accepted >= 0 AS changed, accepted, distance FROM st JOIN la USING (target, index)""",
    "rewrite_attempts": f"WITH {_ROUNDS} SELECT code, count(*) AS attempts, count(*) FILTER (code = '') AS accepted, count(*) FILTER (introduced) AS introduced, sum(comparison)::BIGINT AS comparison FROM st WHERE code IS NOT NULL GROUP BY code",
    "kept_artifacts": f"WITH {_ARTIFACTS} SELECT kind, id FROM r",
    "pruned_artifacts": f"""WITH {_ARTIFACTS}, al AS (SELECT 'snapshot' AS kind, 'snapshot' AS of, source AS id FROM s UNION ALL SELECT 'document', 'document', id FROM d UNION ALL SELECT 'node', 'node', id FROM nd UNION ALL SELECT 'profile', 'profile', 'p' || source FROM s UNION ALL SELECT 'reference', 'reference', 'r' || source FROM s
  UNION ALL SELECT 'selection', 'selection', 'x' || source FROM s UNION ALL SELECT 'selection_member', 'selection', x FROM mb UNION ALL SELECT 'head', 'profile', 'p' || source FROM s UNION ALL SELECT 'threshold', 'profile', 'p' || source FROM s)
SELECT al.kind, count(*) AS removed FROM al ANTI JOIN r ON r.kind = al.of AND r.id = al.id GROUP BY al.kind""",
}
