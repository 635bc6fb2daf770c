"""A training corpus from documents: toxic ones go, one of each near-duplicate group stays, secrets are masked, the rest is packed.

Near duplicates are found among texts, not ids: rows that share a doc_id, or have none, but differ in text are documents of
their own, so that a row goes only if another of its group stays. Of rows that share both, one stays. Empty texts are
near duplicates of nothing. A null text is an empty one. Columns that documents doesn't have are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import materialize, table
from penstroke.llm.neardup import components
from penstroke.llm.packing import packed_documents
from penstroke.llm.secrets import default_net, redacted_documents
from penstroke.llm.toxicity import learn, scored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of the same component at this width of shingles and similarity are near duplicates.
WIDTH, PERCENT = 5, 80
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = learn(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).where("score < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the least doc_id; where doc_ids repeat or are null, a hash of id and text takes their place."""
    docs = docs.select(*COLUMNS)
    unclear = materialize(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id", F.lit(True).alias("unclear")), "unclear")
    if not unclear.isEmpty():
        named = docs.join(unclear, docs["doc_id"].eqNullSafe(unclear["doc_id"]), "left").drop(unclear["doc_id"])
        node = F.when(F.col("unclear"), F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))).otherwise(F.col("doc_id"))
        docs = materialize(named.withColumn("node", node).groupBy("node").agg(*[F.min(F.struct(*COLUMNS)).alias("r")]).select("node", "r.*"), "named")
    else:
        docs = docs.withColumn("node", F.col("doc_id"))
    kept = components(docs.select(F.col("node").alias("doc_id"), "text"), WIDTH, PERCENT).where("kept").select(F.col("doc_id").alias("node"))
    return docs.join(kept, "node", "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted_documents(docs.select(*COLUMNS), default_net())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
