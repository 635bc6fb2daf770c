"""From admitted documents to a graph of nodes and their feature vectors.

A document keeps its row whatever its admission; only eligible ones have nodes. Nodes are the segmenter's paragraphs in order, or all leaves of the Markdown
structure; vectors belong to included nodes that reach the floor of lexical tokens. Texts are parsed once: nodes are written, vectors are read off them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import content_id
from ..functions.tables import materialize
from . import corpus as corpora
from . import structure, style

DOCUMENT = ["doc_id", "document_id", "path", "content_hash", "admission", "split"]
NODE = ["doc_id", "node_id", "ordinal", "role", "containers", "start", "length", "included", "exclusion"]


@dataclass(frozen=True)
class Graph:
    documents: DataFrame
    nodes: DataFrame
    vectors: DataFrame


def line_leaves(corpus: DataFrame) -> DataFrame:
    """Every line as an included paragraph of the document; spans are bytes."""
    each = corpus.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    length = F.octet_length("text").cast("long")
    # a line starts after those before it and a line feed each
    before = F.sum(length + 1).over(Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    plain = {"role": F.lit("paragraph"), "containers": F.array(F.lit("document")), "included": F.lit(True), "exclusion": F.lit(""), "length": length}
    return each.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")).withColumns(plain)


def ingest(admitted: DataFrame, snapshot: str, segmenter: str = "markdown", floor: int = C.MIN_LEXICAL) -> Graph:
    """The graph of a corpus with admission and split, under the id of its snapshot. doc_ids are distinct."""
    if segmenter not in ("line", "markdown"):
        raise ValueError(f"no segmenter {segmenter!r}")
    named = admitted.withColumn("document_id", content_id(F.lit(snapshot), F.col("path")))
    eligible = corpora.eligible(named)
    leaves = structure.document_leaves(eligible) if segmenter == "markdown" else line_leaves(eligible)
    owner = eligible.select("doc_id", "document_id")
    rows = leaves.join(owner, "doc_id").withColumn("node_id", content_id(F.col("document_id"), F.col("ordinal").cast("string")))
    rows = materialize(rows.select(*NODE, "text"), "nodes")
    vectors = style.vectors(rows.where("included").select("doc_id", "node_id", "ordinal", F.col("text").alias("line")), floor=floor).drop("line", "_t")
    return Graph(named.select(*DOCUMENT), rows.drop("text"), vectors)
