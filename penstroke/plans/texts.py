"""Queries of lint directives, papers, and of cases that the tables' own texts don't hold, over texts derived from them.

The invented prose has no tells, directives, contractions or second scripts. Documents' lines are brought down to their words and put into sentences that
have them, and letters of conversations are exchanged for Greek ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import contraction, lexical_tokens, possessive
from ..functions.tables import materialize, read
from ..operators import gates, lint, papers, preserve, publication, rewrite, store, structure
from . import catalogue as K
from . import documents

RULES = lint.default_rules()
ALLOW = '<!-- lint:allow delve reason="quoted" -->'
UNKNOWN, MALFORMED = '<!-- lint:allow nosuch reason="x" -->', "<!-- lint:allow delve -->"
#: (text before the words, text after them) of the blocks that lines become in turn.
BLOCKS = [("", "."), ("We delve into ", " at the end of the day, and  so."), (f"{ALLOW}\nWe delve and delve here, ", ""), (UNKNOWN, None), (MALFORMED, None)]
LIMIT = 4
EDITION, NAMES = "THE EDITION.", {"DE": "German", "EN": "English", "ES": "Spanish", "FR": "French"}
# --- fixed values: Roman numerals by place ---
UNITS = [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "M", "MM", "MMM"]]


def _words(text: str = "text"):
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}]+", " "))), lambda x: x != "")


def annotated(spark, sf) -> DataFrame:
    """(doc_id, text): tells and directives around the words of documents."""

    def block(t, i):
        out = F.lit("")
        for k in range(len(BLOCKS) - 1, -1, -1):
            a, b = BLOCKS[k]
            out = F.when(i % len(BLOCKS) == k, F.lit(a) if b is None else F.concat(F.lit(a), t, F.lit(b))).otherwise(out)
        return out

    return K._docs(spark, sf).select("doc_id", F.array_join(F.transform(_words(), block), "\n").alias("text"))


def lint_findings(spark, sf):
    f = lint.findings(annotated(spark, sf), RULES, honour=True)
    return f.select("doc_id", "rule", "start", "length", "severity", "widened", "suppressed", F.coalesce("reason", F.lit("")).alias("reason"))


def lint_directives(spark, sf):
    return lint.directives(annotated(spark, sf), RULES).select("doc_id", "start", "length", "rule", "reason", "state")


def lint_limited(spark, sf):
    f = lint.findings(annotated(spark, sf), RULES, limit=LIMIT)
    return f.groupBy("doc_id").agg(F.count("*").alias("findings"), F.max("truncated").alias("truncated"))


def lint_counts(spark, sf):
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.coalesce("html", F.lit("")).alias("text"))
    texts = K._docs(spark, sf).select("doc_id", "text").unionByName(pages).unionByName(annotated(spark, sf))
    return lint.counts(texts, RULES).groupBy("rule").agg(F.sum("n").alias("findings"), F.count("*").alias("texts"))


def edition_papers(spark, sf):
    """Each three lines of a document as a paper of an edition: a title, then a body, by the language's name; numerals start again at six."""
    d = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.upper(F.coalesce("lang", F.lit("en"))).alias("name"))
    each = d.select("doc_id", "name", F.posexplode(_words()).alias("i", "words"))
    n = (F.floor(F.col("i") / 3) % 5 + 1).cast("int")
    numeral = F.concat(F.lit("No. "), F.element_at(F.lit(UNITS[0]), n + 1), F.lit("."))
    # a full stop, which words never have, so that a title or body of the same letters isn't taken for it; languages without a name have such a line too
    said = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    by = F.concat(F.coalesce(said[F.col("name")], F.lit("")), F.lit("."))
    heading = F.array(F.lit(EDITION), numeral, F.lit(""), F.col("words"), by, F.lit(""))
    lines = F.when(F.col("i") % 3 == 0, heading).otherwise(F.array(F.concat(F.lit("  "), "words"), F.lit("")))
    rows = each.select("doc_id", "i", F.posexplode(lines).alias("k", "line")).select("doc_id", (F.col("i") * 8 + F.col("k")).alias("seg"), "line")
    # numbers of lines without gaps, from the lengths of what stands before
    before = (F.floor(F.col("seg") / 8) * 2 + F.floor((F.floor(F.col("seg") / 8) + 2) / 3) * 4).cast("int")
    out = papers.papers(rows.select("doc_id", (before + F.col("seg") % 8).alias("seg"), "line"), EDITION, {f"{n}.": n for n in ("", *NAMES.values())})
    return out.withColumn("attribution", F.nullif("attribution", F.lit("")))


def contraction_flags(spark, sf):
    """Over documents' own tokens and the first three words of each with endings."""
    first = K._docs(spark, sf).select(F.slice(F.split(F.array_join(_words(), " "), " "), 1, 3).alias("w")).where("size(w) = 3")
    ended = first.select(F.concat(F.get("w", F.lit(0)), F.lit("'s "), F.get("w", F.lit(1)), F.lit("n't "), F.get("w", F.lit(2)), F.lit("s' it's we’ll")).alias("text"))
    t = K._docs(spark, sf).select("text").unionByName(ended).select(F.explode(lexical_tokens(F.col("text"))).alias("t")).where("t rlike '[\\'’]'")
    return t.groupBy("t").agg(F.count("*").alias("n")).select("t", "n", contraction(F.col("t")).alias("contraction"), possessive(F.col("t")).alias("possessive"))


def _greek(spark, sf) -> DataFrame:
    """Pairs of turns with Greek letters in some of them."""
    conv = F.split_part("pair_id", F.lit(":"), F.lit(1)).cast("long")
    old = F.when(conv % 2 == 0, F.translate("current", "z", "ζ")).otherwise(F.col("current"))
    new = F.when(conv % 3 == 0, F.translate("candidate", "aeo", "αεο")).otherwise(F.when(conv % 3 == 1, F.translate("candidate", "z", "ζ")).otherwise(F.col("candidate")))
    return K._pairs(spark, sf).select("pair_id", old.alias("current"), new.alias("candidate"))


def scripts_introduced(spark, sf):
    p = _greek(spark, sf)
    return preserve.introduced(preserve.script_counts(p, "pair_id", "current"), preserve.script_counts(p, "pair_id", "candidate"), "pair_id")


def scripts_overgrown(spark, sf):
    p = _greek(spark, sf)
    return preserve.overgrown(preserve.script_counts(p, "pair_id", "current"), preserve.script_counts(p, "pair_id", "candidate"), "pair_id")


def orphan_rows(spark, sf):
    """Customers without an order."""
    return store.orphans(read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def publication_evidence(spark, sf):
    e = rewrite.evidence(structure.document_leaves(documents.markdown(K._docs(spark, sf))))
    return e.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.min("paragraph_hash").alias("first_hash"))


def _replaced(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(Markdown documents, their leaves, replacements of plain paragraphs and of what definitions say)."""
    docs = documents.markdown(K._docs(spark, sf)).select("doc_id", "text")
    leaves = materialize(structure.document_leaves(docs), "leaves")
    plain = (F.size("excisions") == 0) & (F.col("role").isin("paragraph", "definition-description")) & ~F.array_contains("containers", "list") & ~F.array_contains("containers", "block-quote")
    return docs, leaves, leaves.where(plain).select("doc_id", "start", "length", F.concat("text", F.lit(" Indeed.")).alias("text"))


def assembled_documents(spark, sf):
    """Documents with their replacements; every tenth also has one that is of no leaf."""
    docs, leaves, new = _replaced(spark, sf)
    stray = docs.where("doc_id % 10 = 0").select("doc_id", F.lit(1).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit("x").alias("text"))
    return publication.assembled(docs, leaves, new.unionByName(stray)).select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("replaced").cast("long").alias("replaced"), F.coalesce("refused", F.lit("")).alias("refused"))


def publication_checks(spark, sf):
    """Assembled documents against what was expected of them, which is made wrong for some."""
    docs, leaves, new = _replaced(spark, sf)
    k = F.col("doc_id") % 10
    wrong = {"role": F.when(k == 1, "caption").otherwise(F.col("role")), "tokens": F.when(k == 2, "none").otherwise(F.col("tokens")), "length": F.when(k == 3, F.col("length") + 1).otherwise(F.col("length"))}
    found = publication.checked(publication.expectations(leaves, new).withColumns(wrong), publication.assembled(docs, leaves, new).select("doc_id", "text"))
    return found.groupBy("doc_id", "outcome").agg(F.count("*").alias("leaves"))


def inactive_reasons(spark, sf):
    """Rule sets by source, a rule for each document."""
    d, k = read(spark, sf, "documents").where("source is not null"), F.col("doc_id")
    category = F.element_at(F.lit(["formatting", "author-deviation", "source-contamination"]), (k % 3 + 1).cast("int"))
    return gates.inactive_reason(d.select("source", F.when(k % 40 == 0, "derived").otherwise("unvalidated").alias("provenance"), category.alias("category"), (F.col("lang") == "en").alias("in_scope")), "source")


def report_violations(spark, sf):
    """A report of a band for each order."""
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    bound = F.when(k % 31 != 0, (k % 40).cast("double") / 250)
    return gates.report_violations(o.select(k.alias("id"), bound.alias("bound"), F.when(k % 3 == 0, 0.05).otherwise(0.1).alias("target"), (F.col("o_custkey") % 120).alias("clusters"), (k % 7 < 4).alias("emitted")))


def roman_values(spark, sf):
    """Numerals of parts' keys, put together place by place."""
    n = (F.col("p_partkey") % 3999 + 1).cast("int")
    places = [F.element_at(F.lit(UNITS[p]), (F.floor(n / 10**p) % 10 + 1).cast("int")) for p in (3, 2, 1, 0)]
    return read(spark, sf, "part").select("p_partkey", F.concat(*places).alias("numeral")).select("p_partkey", gates.roman(F.col("numeral")).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lint_findings, lint_directives, lint_limited, lint_counts, edition_papers, contraction_flags, scripts_introduced, scripts_overgrown, orphan_rows, publication_evidence, assembled_documents, publication_checks, inactive_reasons, report_violations, roman_values,
    )
}

_NL = "chr(10)"
_CL = f"wl AS (SELECT doc_id, list_filter(list_transform(string_split(text, {_NL}), lambda x: trim(regexp_replace(x, '[^\\p{{L}}]+', ' ', 'g'))), lambda x: x <> '') AS ts FROM d)"
_KINDS = " ".join(f"WHEN {k} THEN {K._q(a) if b is None else f'{K._q(a)} || t || {K._q(b)}'}" for k, (a, b) in enumerate(BLOCKS))
_ANNOTATED = f"""{K._DOCS}, {_CL}, wb AS (SELECT doc_id, i, ts[i + 1] AS t, i % {len(BLOCKS)} AS k FROM wl, unnest(range(len(ts))) AS g(i)), wt AS (SELECT *, CASE k {_KINDS} END AS block FROM wb),
wp AS (SELECT *, strlen(t) AS n, coalesce(sum(strlen(block) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM wt)"""
_INSIDE = len("<!-- lint:allow ")
_FOUND = f"""{_ANNOTATED}, fd AS (SELECT doc_id, 'delve' AS rule, pos + 3 AS start, 5 AS length, false AS suppressed FROM wp WHERE k = 1 UNION ALL SELECT doc_id, 'at-the-end-of-the-day', pos + 15 + n, 22, false FROM wp WHERE k = 1
  UNION ALL SELECT doc_id, 'double-space', pos + 41 + n, 2, false FROM wp WHERE k = 1 UNION ALL SELECT doc_id, 'delve', pos + {_INSIDE}, 5, false FROM wp WHERE k IN (2, 4)
  UNION ALL SELECT doc_id, 'delve', pos + {len(ALLOW) + 4}, 5, true FROM wp WHERE k = 2 UNION ALL SELECT doc_id, 'delve', pos + {len(ALLOW) + 14}, 5, true FROM wp WHERE k = 2)"""
_GREEK = f"""{K._PAIRS.replace("p AS (", "p0 AS (")}, p AS (SELECT pair_id, CASE WHEN split_part(pair_id, ':', 1)::BIGINT % 2 = 0 THEN translate(current, 'z', 'ζ') ELSE current END AS current,
  CASE split_part(pair_id, ':', 1)::BIGINT % 3 WHEN 0 THEN translate(candidate, 'aeo', 'αεο') WHEN 1 THEN translate(candidate, 'z', 'ζ') ELSE candidate END AS candidate FROM p0)"""

ORACLE: dict[str, str] = {
    "lint_findings": f"WITH {_FOUND} SELECT doc_id, rule, start::BIGINT AS start, length::BIGINT AS length, 'warn' AS severity, false AS widened, suppressed, CASE WHEN suppressed THEN 'quoted' ELSE '' END AS reason FROM fd",
    "lint_directives": f"""WITH {_ANNOTATED} SELECT doc_id, pos AS start, CASE k WHEN 2 THEN {len(ALLOW)} WHEN 3 THEN {len(UNKNOWN)} ELSE {len(MALFORMED)} END::BIGINT AS length, CASE k WHEN 3 THEN 'nosuch' ELSE 'delve' END AS rule,
  CASE k WHEN 2 THEN 'quoted' WHEN 3 THEN 'x' ELSE '' END AS reason, CASE k WHEN 2 THEN 'applied' WHEN 3 THEN 'unknown' ELSE 'malformed' END AS state FROM wp WHERE k >= 2""",
    "lint_limited": f"WITH {_FOUND} SELECT doc_id, least(count(*), {LIMIT}) AS findings, count(*) > {LIMIT} AS truncated FROM fd GROUP BY doc_id",
    "lint_counts": f"WITH {_ANNOTATED}, ta AS (SELECT doc_id, string_agg(block, {_NL} ORDER BY i) AS text FROM wt GROUP BY doc_id), tx AS (SELECT text FROM d UNION ALL SELECT coalesce(html, '') FROM pages UNION ALL SELECT text FROM ta), y AS (" + " UNION ALL ".join(f"SELECT {K._q(r.id)} AS rule, len(regexp_extract_all(text, {K._q(r.pattern)})) AS n FROM tx" for r in RULES) + ") SELECT rule, sum(n)::BIGINT AS findings, count(*) AS texts FROM y WHERE n > 0 GROUP BY rule",
    "edition_papers": f"""WITH {K._DOCS}, {_CL}, wi AS (SELECT doc_id, i, ts[i + 1] AS t FROM wl, unnest(range(len(ts))) AS g(i)), pp AS (SELECT doc_id, (i // 3)::INT AS index, any_value(t) FILTER (i % 3 = 0) AS title,
    trim(coalesce(string_agg('  ' || t, {_NL} || {_NL} ORDER BY i) FILTER (i % 3 > 0), ''), ' ') AS text FROM wi GROUP BY 1, 2),
  nm AS (SELECT *, index % 5 + 1 AS number FROM pp)
SELECT doc_id, index, number::INT AS number, {K._in(UNITS[0])}[number + 1] AS roman, title, CASE upper(coalesce(lang, 'en')) WHEN 'DE' THEN 'German' WHEN 'EN' THEN 'English' WHEN 'ES' THEN 'Spanish' WHEN 'FR' THEN 'French' END AS attribution, nm.text,
  count(*) OVER (PARTITION BY doc_id, number) > 1 AS duplicate, index = min(index) OVER (PARTITION BY doc_id, number) AS first FROM nm JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""",
    "contraction_flags": f"""WITH {K._DOCS}, {_CL}, w3 AS (SELECT string_split(array_to_string(ts, ' '), ' ')[1:3] AS w FROM wl), tx AS (SELECT text FROM d UNION ALL SELECT w[1] || '''s ' || w[2] || 'n''t ' || w[3] || 's'' it''s we’ll' FROM w3 WHERE len(w) = 3),
k AS (SELECT unnest({K._lex('text')}) AS t FROM tx) SELECT t, count(*) AS n, NOT ends_with({K._APO}, '''') AND ({K._SUFFIX} OR (ends_with({K._APO}, '''s') AND {K._HOST})) AS contraction, ends_with({K._APO}, '''') OR (ends_with({K._APO}, '''s') AND NOT {K._HOST}) AS possessive FROM k WHERE regexp_matches(t, '[''’]') GROUP BY t""",
    "scripts_introduced": f"WITH {_GREEK}, {K._SCR} SELECT pair_id, script FROM sn ANTI JOIN so USING (pair_id, script)",
    "scripts_overgrown": f"WITH {_GREEK}, {K._SCR}, {K._OVER} SELECT pair_id, script, old_letters, new_letters FROM ov",
    "orphan_rows": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "publication_evidence": f"""WITH {documents._LEAVES}, ev AS (SELECT doc_id, CASE WHEN k = 5 AND part = 0 THEN 'Said so.' ELSE t || '.' END AS text FROM bk, unnest(range(CASE k WHEN 5 THEN 2 ELSE 1 END)) AS g(part) WHERE k IN (0, 4, 5) OR (k = 3 AND w >= {C.MIN_SENTENTIAL}))
SELECT doc_id, count(*) AS paragraphs, min(sha256(nfc_normalize(text))) AS first_hash FROM ev GROUP BY doc_id""",
    "assembled_documents": f"""WITH {documents._LEAVES}, bt AS (SELECT doc_id, i, k, doc_id % 10 = 0 AS off, CASE k WHEN 0 THEN t || '.' WHEN 1 THEN '# ' || t WHEN 2 THEN '> ' || t || '.' WHEN 3 THEN '- ' || t || '.' WHEN 4 THEN 'Term' || {_NL} || ': ' || t || '.' ELSE 'Said so.[^' || i || ']' || {_NL} || {_NL} || '[^' || i || ']: ' || t || '.' END AS block FROM bk),
ax AS (SELECT doc_id, string_agg(block || CASE WHEN k IN (0, 4) AND NOT off THEN ' Indeed.' ELSE '' END, {_NL} || {_NL} ORDER BY i) AS text, count(*) FILTER (k IN (0, 4) AND NOT off) AS replaced FROM bt GROUP BY doc_id)
SELECT doc_id, sha256(coalesce(ax.text, '')) AS sha256, coalesce(replaced, 0) AS replaced, CASE WHEN doc_id % 10 = 0 THEN 'not-a-leaf' ELSE '' END AS refused FROM d LEFT JOIN ax USING (doc_id)""",
    "publication_checks": f"""WITH {documents._LEAVES} SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'role' WHEN 2 THEN 'tokens' WHEN 3 THEN 'missing' ELSE 'ok' END AS outcome, count(*) AS leaves FROM lv WHERE exclusion = '' GROUP BY ALL""",
    "inactive_reasons": """WITH v AS (SELECT source, doc_id % 40 = 0 AND doc_id % 3 <> 0 AS fit, coalesce(lang = 'en', false) AS here FROM documents WHERE source IS NOT NULL)
SELECT source, CASE WHEN bool_or(fit AND here) THEN '' WHEN bool_or(fit) THEN 'no-rule-in-scope' ELSE 'no-validated-rule' END AS reason FROM v GROUP BY source""",
    "report_violations": """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31 <> 0 THEN (o_orderkey % 40)::DOUBLE / 250 END AS bound, CASE WHEN o_orderkey % 3 = 0 THEN 0.05e0 ELSE 0.1e0 END AS target, o_custkey % 120 AS clusters, o_orderkey % 7 < 4 AS emitted FROM orders)
SELECT id, 'bound-not-finite' AS violation FROM r WHERE emitted AND bound IS NULL UNION ALL SELECT id, 'decision' FROM r WHERE (bound <= target) <> emitted
UNION ALL SELECT id, 'bound-below-floor' FROM r WHERE clusters > 0 AND bound < 3 / clusters::DOUBLE UNION ALL SELECT id, 'too-few-clusters' FROM r WHERE emitted AND clusters < ceil(3 / target)""",
    "roman_values": "SELECT p_partkey, (p_partkey % 3999 + 1)::INT AS value FROM part",
}
