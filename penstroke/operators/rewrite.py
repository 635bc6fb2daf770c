"""Planning a rewrite, and what is published of it. Candidates come from a table; no provider is called."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CandidateProvider(Protocol):
    def candidates(self, prompts: DataFrame) -> DataFrame:
        """(target, index, candidate) for prompts (target, prompt)."""


class TableProvider:
    """Candidates that are already in a table."""

    def __init__(self, table: DataFrame):
        self.table = table

    def candidates(self, prompts: DataFrame) -> DataFrame:
        return self.table.join(prompts.select("target"), "target", "left_semi").select("target", "index", "candidate")


def disposition(explicit: bool) -> Column:
    """What becomes of a scored paragraph (distance, band, chosen, produced, excised); explicit targets are those chosen."""
    if explicit:
        return F.when(~F.col("chosen"), "not-selected").when(F.col("distance").isNull(), "unmeasurable").when(F.col("excised"), "contains-excisions").otherwise("target")
    return (
        F.when(F.col("distance").isNull(), "unmeasurable").when(F.col("produced"), "already-rewritten").when(F.col("band") == "in-range", "in-range").when(F.col("excised"), "contains-excisions").otherwise("target")
    )


def select_register(heads: DataFrame, wanted: str | None) -> DataFrame:
    """One row (state, register): explicit, sole-head, ambiguous, unknown-register or no-profile."""
    s = heads.agg(F.countDistinct("register").alias("n"), F.min("register").alias("only"), F.max(F.col("register") == F.lit(wanted)).alias("known"))
    state = F.when(F.col("n") == 0, "no-profile")
    state = state.when(F.coalesce("known", F.lit(False)), "explicit").otherwise("unknown-register") if wanted is not None else state.when(F.col("n") == 1, "sole-head").otherwise("ambiguous")
    return s.select(state.alias("state"), F.when(F.lit(wanted is not None) & F.coalesce("known", F.lit(False)), F.lit(wanted)).when(F.lit(wanted is None) & (F.col("n") == 1), F.col("only")).alias("register"))


def normalized_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def fenced(x: Column) -> Column:
    return F.concat(F.lit("> "), F.replace(normalized_newlines(x), F.lit("\n"), F.lit("\n> ")))


def prompts(targets: DataFrame, exemplars: DataFrame, instruction: str) -> DataFrame:
    """(target, prompt): the instruction, the exemplars as quotes in order, the paragraph."""
    shown = exemplars.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda e: fenced(e["text"])), "\n\n").alias("shown"))  # a handful of rows
    return targets.crossJoin(F.broadcast(shown)).select("target", F.concat_ws("\n\n", F.lit(instruction), "shown", normalized_newlines(F.col("text"))).alias("prompt"))


def shifted(replacements: DataFrame) -> DataFrame:
    """Adds new_start: where each of a document's replacements (doc_id, start, length, new_length) begins in the new text."""
    w = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return replacements.withColumn("new_start", F.col("start") + F.coalesce(F.sum(F.col("new_length") - F.col("length")).over(w), F.lit(0)))


def publication_check(expected: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, start, outcome): each expected leaf must be parsed again at its exact span, with its role and containers."""
    j = expected.alias("e").join(parsed.alias("p"), ["doc_id", "start", "length"], "left")
    same = F.col("e.role").eqNullSafe(F.col("p.role")) & F.col("e.containers").eqNullSafe(F.col("p.containers"))
    return j.select("doc_id", "start", F.when(F.col("p.role").isNull(), "missing").when(same, "ok").otherwise("changed").alias("outcome"))


def evidence(leaves: DataFrame) -> DataFrame:
    return leaves.where("included").select("doc_id", F.sha2("text", 256).alias("paragraph_hash"))
