"""Long texts of many papers, cut at their heading lines.

A heading is a line with the edition's name followed by a line with a numeral. Which paper a line belongs to is a running count of headings over the lines in
order, which spreads over tasks however long a text is. Between a heading and the line that says who wrote it stands the title; what follows is the body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialize, running
from .gates import roman

NUMERAL = r"^No\. ([IVXLCDM]+)\.?$"


def papers(lines: DataFrame, edition: str, attributions: dict[str, str], numeral: str = NUMERAL, not_title: str = "^$") -> DataFrame:
    """(doc_id, index, number, roman, title, attribution, text, duplicate, first) of texts given as lines (doc_id, seg, line).

    attributions: what a line says of whom, by line. Lines before the first heading belong to no paper. A paper without such a line has a null
    attribution, no title and no text. Lines that match not_title aren't part of a title. duplicate: its number occurs more than once in the text; first: it
    is the first of them.
    """
    own = F.trim("line")
    # the line before, by place rather than by a window over a whole text
    named = lines.select("doc_id", "seg", "line", own.alias("own"), F.regexp_extract(own, numeral, 1).alias("roman"))
    above = named.where(F.col("own") == edition).select("doc_id", (F.col("seg") + 1).alias("seg"), F.lit(True).alias("headed"))
    below = named.where("roman <> ''").select("doc_id", (F.col("seg") - 1).alias("seg"), F.lit(True).alias("heads"))
    marked = named.join(above, ["doc_id", "seg"], "left").join(below, ["doc_id", "seg"], "left")
    starts = (F.col("roman") != "") & F.coalesce("headed", F.lit(False))
    edge = (F.col("own") == edition) & F.coalesce("heads", F.lit(False))
    placed = running(marked.withColumn("head", starts.cast("long")).withColumn("edge", edge), "doc_id", ["seg"], "head")
    # a heading's first line belongs to neither paper
    placed = materialize(placed.where("upto > 0 and not edge").withColumn("index", (F.col("upto") - 1).cast("int")), "placed")
    said = F.create_map(*[F.lit(x) for pair in attributions.items() for x in pair])
    by = placed.where("head = 0").withColumn("attribution", said[F.col("own")]).where("attribution is not null")
    by = by.groupBy("doc_id", "index").agg(F.min(F.struct("seg", "attribution")).alias("by")).select("doc_id", "index", F.col("by.seg").alias("at"), "by.attribution")
    j = placed.join(by, ["doc_id", "index"], "left")
    title = F.when((F.col("head") == 0) & (F.col("seg") < F.col("at")) & ~F.col("own").rlike(not_title), F.struct("seg", "own"))
    body = F.when(F.col("seg") > F.col("at"), F.struct("seg", "line"))
    rows = j.groupBy("doc_id", "index").agg(F.max(F.when(F.col("head") == 1, F.col("roman"))).alias("roman"), F.first("attribution").alias("attribution"), F.array_sort(F.collect_list(title)).alias("t"), F.array_sort(F.collect_list(body)).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["line"]), "\n")
    # trailing empty lines and the edition's name go, and white space around the whole
    tail = F.regexp_replace(text, rf"(?:\n(?:{edition.replace('.', chr(92) + '.')})?)+$", "")
    out = rows.select("doc_id", "index", roman(F.col("roman")).alias("number"), "roman", F.array_join(F.transform("t", lambda x: x["own"]), " ").alias("title"), "attribution", F.trim(F.regexp_replace(tail, r"^\s+|\s+$", "")).alias("text"))
    same = out.groupBy("doc_id", "number").agg(F.count("*").alias("copies"), F.min("index").alias("least"))
    return out.join(same, ["doc_id", "number"]).select(*out.columns, (F.col("copies") > 1).alias("duplicate"), (F.col("index") == F.col("least")).alias("first"))
