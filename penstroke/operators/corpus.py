"""Admission, first-wins dedupe, splits, overlap and published-text screens.

A corpus frame has doc_id, path, text, source. Everything after `admitted` is a projection or a join by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import extract_all, lexical_tokens, split_of

BOM = "EFBBBF"


def from_documents(docs: DataFrame) -> DataFrame:
    """Paths are ids of as many digits as the longest have, so that their order is that of the ids."""
    return docs.select("doc_id", F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"), F.coalesce("text", F.lit("")).alias("text"), "source")


def admit_bytes(files: DataFrame) -> DataFrame:
    """(path, valid, had_bom, text, content_hash) from (path, content): valid UTF-8, and one byte order mark stripped."""
    bom = F.hex(F.substring("content", 1, 3)) == BOM
    body = F.when(bom, F.expr("substring(content, 4)")).otherwise(F.col("content"))
    out = files.select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), bom.alias("had_bom"), body.alias("body"), F.sha2("content", 256).alias("content_hash"))
    return out.select("path", "valid", "had_bom", F.when(F.col("valid"), F.col("body").cast("string")).alias("text"), "content_hash")


def hashed(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("content_hash", F.sha2("text", 256))


def first_wins(corpus: DataFrame) -> DataFrame:
    """Adds duplicate_of: the first path, in byte order, with the same content; null for the first itself.

    Winners are a map-side minimum by hash; a hash that very many paths share meets it in a join whose
    partitions adaptive execution may split, never in a window over the group.
    """
    winners = corpus.groupBy("content_hash").agg(F.min("path").alias("winner"))
    return corpus.join(winners, "content_hash").withColumn("duplicate_of", F.when(F.col("path") != F.col("winner"), F.col("winner"))).drop("winner")


def admitted(corpus: DataFrame, min_lexical: int = 1) -> DataFrame:
    """Adds tokens counts, admission and split. A short first copy still claims its hash."""
    marked = first_wins(hashed(corpus)).withColumn("lexical_tokens", F.size(lexical_tokens(F.col("text"))))
    # whether there is a token at all shows without tokenising
    short = ~F.col("text").rlike("[\\p{L}\\p{M}]") if min_lexical == 1 else F.col("lexical_tokens") < min_lexical
    verdict = F.when(F.col("duplicate_of").isNotNull(), "rejected-duplicate").when(short, "rejected-too-short").otherwise("eligible")
    marked = marked.withColumn("admission", verdict)
    return marked.withColumn("split", F.when(F.col("admission") == "eligible", split_of(F.col("content_hash"))).otherwise(""))


def eligible(admitted_: DataFrame) -> DataFrame:
    return admitted_.where("admission = 'eligible'")


def overlap(author: DataFrame, distractor: DataFrame) -> DataFrame:
    """Shared content hashes of two corpora."""
    return author.select("content_hash").distinct().join(distractor.select("content_hash").distinct(), "content_hash", "left_semi")


def lines(corpus: DataFrame) -> DataFrame:
    """A row per line (doc_id, source, seg, line): the paragraphs of line-separated texts."""
    return corpus.select(*[c for c in corpus.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("seg", "line"))


def segments(corpus: DataFrame, segmenter: str = "line") -> DataFrame:
    """A row per paragraph (seg, line, other columns than text): lines, or with "markdown" the included leaves' text without their excisions."""
    if segmenter == "line":
        return lines(corpus)
    if segmenter != "markdown":
        raise ValueError(f"no segmenter {segmenter!r}")
    from . import structure

    leaves = structure.document_leaves(corpus).where("included").select("doc_id", F.col("ordinal").alias("seg"), F.col("text").alias("line"))
    return corpus.drop("text").join(leaves, "doc_id")


def published_screen(corpus: DataFrame, published: DataFrame | None) -> DataFrame:
    """doc_id, tool_output: whether any line is a published paragraph. A null published table is not an empty one: no screening, null flags."""
    if published is None:
        return corpus.select("doc_id", F.lit(None).cast("boolean").alias("tool_output"))
    hashes = published.select(F.sha2(F.trim("text"), 256).alias("h")).distinct()
    hit = lines(corpus).select("doc_id", F.sha2(F.trim("line"), 256).alias("h")).join(hashes, "h", "left_semi").select("doc_id").distinct().withColumn("tool_output", F.lit(True))
    return corpus.select("doc_id").join(hit, "doc_id", "left").withColumn("tool_output", F.coalesce("tool_output", F.lit(False)))


def already_rewritten(items: DataFrame, published: DataFrame) -> DataFrame:
    """(h, produced): for each hash asked for, whether it was published."""
    known = published.select("h").distinct().withColumn("hit", F.lit(True))
    return items.join(known, "h", "left").select(*items.columns, F.coalesce("hit", F.lit(False)).alias("produced"))


def summary(admitted_: DataFrame) -> DataFrame:
    c = F.col
    return admitted_.agg(
        F.count("*").alias("documents"),
        F.count_if(c("admission") == "eligible").alias("eligible"),
        F.count_if(c("admission") == "rejected-duplicate").alias("duplicates"),
        F.count_if(c("split") == "train").alias("train"),
        F.count_if(c("split") == "calibrate").alias("calibrate"),
        F.count_if(c("split") == "test").alias("test"),
        F.sum("lexical_tokens").alias("lexical_tokens"),
    )


def checks(spark, screened: bool, flagged: int) -> DataFrame:
    """The status of each declared check. Only the tool-output screen is performed."""
    rows = [(name, "not-performed") for name in ("near-duplicate", "language", "contamination", "source-control", "overlap")]
    rows.append(("tool-output", ("failed" if flagged else "passed") if screened else "skipped-by-policy"))
    return spark.createDataFrame(rows, "check_name string, state string")


def all_tokens(corpus: DataFrame) -> DataFrame:
    """(doc_id, lexical, numbers, commas, ...) counts by class in the fast tokenisation."""
    t = F.col("text")
    return corpus.select(
        "doc_id",
        F.size(lexical_tokens(t)).alias("lexical"),
        F.size(F.filter(extract_all(t, "[0-9]+"), lambda x: F.length(x) > 0)).alias("digit_runs"),
        F.size(extract_all(t, "[,;:.!?]")).alias("punctuation"),
        F.size(extract_all(t, r"[\p{So}\p{Sc}]")).alias("symbols"),
    )


def keep_order(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ordinal, from 0, within the key."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
