"""Queries of the document structure and the node graph, and the SQL that must give the same rows.

The tables hold no Markdown, so that documents are rewritten as such: each line, brought down to its words, becomes one of six blocks in turn
(paragraph, heading, quote, list item, definition, a claim with its footnote). The SQL knows what each block's leaves and containers are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.tables import materialize, read
from ..operators import corpus, ingest, structure
from . import catalogue as K


def markdown(docs: DataFrame) -> DataFrame:
    """The corpus with its texts as Markdown."""
    words = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}]+", " "))), lambda x: x != "")

    def block(t, i):
        note = F.concat(F.lit("[^"), i.cast("string"), F.lit("]"))
        kinds = [
            F.concat(t, F.lit(".")), F.concat(F.lit("# "), t), F.concat(F.lit("> "), t, F.lit(".")), F.concat(F.lit("- "), t, F.lit(".")), F.concat(F.lit("Term\n: "), t, F.lit(".")),
            F.concat(F.lit("Said so."), note, F.lit("\n\n"), note, F.lit(": "), t, F.lit(".")),
        ]
        out = kinds[-1]
        for k in range(4, -1, -1):
            out = F.when(i % 6 == k, kinds[k]).otherwise(out)
        return out

    return docs.withColumn("text", F.array_join(F.transform(words, block), "\n\n"))


def markdown_leaves(spark, sf):
    leaves = structure.document_leaves(markdown(K._docs(spark, sf)))
    return leaves.select("doc_id", "ordinal", "role", F.array_join("containers", "|").alias("containers"), "start", "length", "words", "exclusion")


def structure_nodes(spark, sf):
    docs = markdown(K._docs(spark, sf))
    nodes = structure.nodes(docs, materialize(structure.document_leaves(docs), "leaves"))
    up = nodes.where("kind = 'container'").select("doc_id", F.col("node").alias("parent"), F.col("name").alias("parent_name"), F.col("start").alias("parent_start"))
    return nodes.join(up, ["doc_id", "parent"], "left").select("doc_id", "kind", "name", "start", "length", "parent_name", "parent_start")


def structure_enclosure(spark, sf):
    """Over pages, Markdown and plain documents: nodes outside of their parents and nodes that don't lead up to the root, of which there are none."""
    pages = read(spark, sf, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.coalesce("html", F.lit("")).alias("text"))
    docs = markdown(K._docs(spark, sf)).select("doc_id", "text").unionByName(pages)
    nodes = materialize(structure.nodes(docs, materialize(structure.document_leaves(docs), "leaves")), "nodes")
    return structure.enclosure(nodes).select("doc_id", "outside", (F.col("nodes") - F.col("reached")).alias("unreached"))


def contained_values(spark, sf):
    """Attribute values of pages (what stands between two quotation marks) in the one tag or even-numbered line that holds them."""
    pages = read(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))

    def pieces(mark: str) -> DataFrame:
        """(page_id, i, piece, at): what stands between marks, and where."""
        parts = pages.select("page_id", F.split("html", mark).alias("p"))
        step = F.transform("p", lambda x: F.char_length(x) + 1)
        ends = F.aggregate(step, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return parts.withColumn("at", ends).select("page_id", F.posexplode(F.arrays_zip(F.col("p"), F.slice("at", 1, F.size("p")).alias("at"))).alias("i", "x")).select("page_id", "i", F.col("x.p").alias("piece"), F.col("x.at").cast("long").alias("at"))

    values = pieces('"').where("i % 2 = 1").select("page_id", F.col("i").cast("long").alias("id"), F.col("at").alias("start"), (F.col("at") + F.char_length("piece")).alias("end"))
    tags = pieces("<").where("i > 0 and contains(piece, '>')").select("page_id", (F.col("i") * 2).cast("long").alias("id"), (F.col("at") - 1).alias("start"), (F.col("at") + F.position(F.lit(">"), F.col("piece"))).cast("long").alias("end"))
    lines = pieces("\n").where("i % 2 = 0").select("page_id", (F.col("i") * 2 + 1).cast("long").alias("id"), F.col("at").alias("start"), (F.col("at") + F.char_length("piece")).alias("end"))
    return structure.uniquely_contained(values, tags.unionByName(lines), "page_id").select("page_id", "id", "candidate")


def _graph(spark, sf, segmenter: str) -> DataFrame:
    docs = markdown(K._docs(spark, sf)) if segmenter == "markdown" else K._docs(spark, sf)
    g = ingest.ingest(materialize(corpus.admitted(docs), "admitted"), "snapshot", segmenter)
    nodes = g.nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if("included").alias("included"), F.sum("length").alias("bytes"))
    vectors = g.vectors.groupBy("doc_id").agg(F.count("*").alias("vectors"), F.round(F.sum("word_length_mean"), 6).alias("word_lengths"))
    out = g.documents.join(nodes, "doc_id", "left").join(vectors, "doc_id", "left").fillna(0, ["nodes", "included", "bytes", "vectors", "word_lengths"])
    return out.select("doc_id", "document_id", "admission", "nodes", "included", "bytes", "vectors", "word_lengths")


def ingest_lines(spark, sf):
    return _graph(spark, sf, "line")


def ingest_markdown(spark, sf):
    return _graph(spark, sf, "markdown")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (markdown_leaves, structure_nodes, structure_enclosure, contained_values, ingest_lines, ingest_markdown)}

_NL = "chr(10)"
# w: words, n: bytes, k: the block's kind, dg: digits of its note; pos: where the block starts
_BLOCKS = f"""cl AS (SELECT doc_id, path, list_filter(list_transform(string_split(text, {_NL}), lambda x: trim(regexp_replace(x, '[^\\p{{L}}]+', ' ', 'g'))), lambda x: x <> '') AS ts FROM d),
bl AS (SELECT doc_id, path, i, ts[i + 1] AS t, i % 6 AS k, strlen(ts[i + 1]) AS n, len(string_split(ts[i + 1], ' ')) AS w, length(i::VARCHAR) AS dg FROM cl, unnest(range(len(ts))) AS g(i)),
sz AS (SELECT *, CASE k WHEN 0 THEN n + 1 WHEN 1 THEN n + 2 WHEN 2 THEN n + 3 WHEN 3 THEN n + 3 WHEN 4 THEN n + 8 ELSE 8 + 3 + dg + 2 + 5 + dg + n + 1 END AS size FROM bl),
bk AS (SELECT *, coalesce(sum(size + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM sz)"""
_LEAVES = f"""{K._DOCS}, {_BLOCKS}, lv AS (
  SELECT doc_id, 'paragraph' AS role, 'document' AS containers, pos AS start, n + 1 AS length, w AS words, '' AS exclusion FROM bk WHERE k = 0
  UNION ALL SELECT doc_id, 'heading', 'document', pos + 2, n, w, 'excluded-by-role' FROM bk WHERE k = 1
  UNION ALL SELECT doc_id, 'paragraph', 'document|block-quote', pos + 2, n + 1, w, 'excluded-by-block-quote-policy' FROM bk WHERE k = 2
  UNION ALL SELECT doc_id, 'paragraph', 'document|list|list-item', pos + 2, n + 1, w, CASE WHEN w >= {C.MIN_SENTENTIAL} THEN '' ELSE 'excluded-not-sentential' END FROM bk WHERE k = 3
  UNION ALL SELECT doc_id, 'definition-term', 'document|definition-list', pos, 4, 1, 'excluded-by-role' FROM bk WHERE k = 4
  UNION ALL SELECT doc_id, 'definition-description', 'document|definition-list', pos + 7, n + 1, w, '' FROM bk WHERE k = 4
  UNION ALL SELECT doc_id, 'paragraph', 'document', pos, 11 + dg, 2, '' FROM bk WHERE k = 5
  UNION ALL SELECT doc_id, 'footnote', 'document|footnote-section|footnote', pos + 18 + 2 * dg, n + 1, w, '' FROM bk WHERE k = 5)"""
_WHOLE = "(SELECT doc_id, coalesce(max(pos + size), 0)::BIGINT AS bytes FROM d LEFT JOIN bk USING (doc_id) GROUP BY doc_id)"


def _split_at(name: str, mark: str) -> str:
    """(page_id, i, piece, pos) of what stands between marks."""
    return f"""{name}0 AS (SELECT page_id, i - 1 AS i, string_split(html, {mark})[i] AS piece FROM pg, unnest(generate_series(1, len(string_split(html, {mark})))) AS g(i)),
{name} AS (SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM {name}0)"""


ORACLE: dict[str, str] = {
    "markdown_leaves": f"WITH {_LEAVES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS ordinal, role, containers, start, length, words, exclusion FROM lv",
    "structure_nodes": f"""WITH {_LEAVES}, fs AS (SELECT doc_id, min(start) AS start, max(start + length) - min(start) AS length FROM lv WHERE role = 'footnote' GROUP BY doc_id),
tree AS (SELECT doc_id, 'container' AS kind, 'document' AS name, 0 AS start, bytes AS length, NULL AS parent_name, NULL AS parent_start FROM {_WHOLE}
  UNION ALL SELECT doc_id, 'container', 'block-quote', pos + 2, n + 1, 'document', 0 FROM bk WHERE k = 2
  UNION ALL SELECT doc_id, 'container', 'list', pos + 2, n + 1, 'document', 0 FROM bk WHERE k = 3
  UNION ALL SELECT doc_id, 'container', 'list-item', pos + 2, n + 1, 'list', pos + 2 FROM bk WHERE k = 3
  UNION ALL SELECT doc_id, 'container', 'definition-list', pos, n + 8, 'document', 0 FROM bk WHERE k = 4
  UNION ALL SELECT doc_id, 'container', 'footnote-section', start, length, 'document', 0 FROM fs
  UNION ALL SELECT doc_id, 'container', 'footnote', pos + 18 + 2 * dg, n + 1, 'footnote-section', fs.start FROM bk JOIN fs USING (doc_id) WHERE k = 5
  UNION ALL SELECT doc_id, 'leaf', role, lv.start, lv.length, CASE containers WHEN 'document' THEN 'document' WHEN 'document|block-quote' THEN 'block-quote' WHEN 'document|list|list-item' THEN 'list-item' WHEN 'document|definition-list' THEN 'definition-list' ELSE 'footnote' END,
    CASE WHEN containers = 'document' THEN 0 WHEN role = 'definition-description' THEN lv.start - 7 ELSE lv.start END FROM lv)
SELECT doc_id, kind, name, start::BIGINT AS start, length::BIGINT AS length, parent_name, parent_start::BIGINT AS parent_start FROM tree""",
    "structure_enclosure": "SELECT doc_id, 0 AS outside, 0 AS unreached FROM documents UNION ALL SELECT -1 - page_id, 0, 0 FROM pages",
    "contained_values": f"""WITH pg AS (SELECT page_id, coalesce(html, '') AS html FROM pages), {_split_at("v", "chr(34)")}, {_split_at("t", "'<'")}, {_split_at("l", _NL)},
q AS (SELECT page_id, i AS id, pos AS s, pos + length(piece) AS e FROM v WHERE i % 2 = 1),
c AS (SELECT page_id, i * 2 AS id, pos - 1 AS s, pos + strpos(piece, '>') AS e FROM t WHERE i > 0 AND contains(piece, '>') UNION ALL SELECT page_id, i * 2 + 1, pos, pos + length(piece) FROM l WHERE i % 2 = 0)
SELECT q.page_id, q.id, CASE WHEN count(c.id) = 1 THEN min(c.id) END AS candidate FROM q LEFT JOIN c ON c.page_id = q.page_id AND c.s < q.s AND q.e < c.e GROUP BY q.page_id, q.id""",
    "ingest_lines": f"""WITH {K._VECTORS}, nd AS (SELECT doc_id, count(*) AS nodes, sum(strlen(line)) AS bytes FROM s GROUP BY doc_id), vc AS (SELECT doc_id, count(*) AS vectors, sum(word_length_mean) AS lengths FROM v GROUP BY doc_id)
SELECT a.doc_id, {K._framed(K._q("snapshot"), "path")} AS document_id, admission, coalesce(nodes, 0) AS nodes, coalesce(nodes, 0) AS included, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(vectors, 0) AS vectors, round(coalesce(lengths, 0), 6) AS word_lengths
FROM a LEFT JOIN nd USING (doc_id) LEFT JOIN vc USING (doc_id)""",
    "ingest_markdown": f"""WITH {_LEAVES}, tx AS (SELECT doc_id, array_to_string(ts, chr(0)) AS md FROM cl), ad AS (SELECT doc_id, d.path, CASE WHEN d.path <> min(d.path) OVER (PARTITION BY md) THEN 'rejected-duplicate' WHEN md = '' THEN 'rejected-too-short' ELSE 'eligible' END AS admission FROM d JOIN tx USING (doc_id)),
el AS (SELECT lv.* FROM lv JOIN ad USING (doc_id) WHERE admission = 'eligible'), nd AS (SELECT doc_id, count(*) AS nodes, count(*) FILTER (exclusion = '') AS included, sum(length) AS bytes FROM el GROUP BY doc_id),
vc AS (SELECT doc_id, count(*) AS vectors, sum((length(t) - (w - 1)) / w::DOUBLE) AS lengths FROM bk JOIN ad USING (doc_id) WHERE admission = 'eligible' AND w >= {C.MIN_LEXICAL} AND k IN (0, 3, 4, 5) GROUP BY doc_id)
SELECT ad.doc_id, {K._framed(K._q("snapshot"), "path")} AS document_id, admission, coalesce(nodes, 0) AS nodes, coalesce(included, 0) AS included, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(vectors, 0) AS vectors, round(coalesce(lengths, 0), 6) AS word_lengths
FROM ad LEFT JOIN nd USING (doc_id) LEFT JOIN vc USING (doc_id)""",
}
