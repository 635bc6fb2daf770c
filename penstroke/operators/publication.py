"""Publishing rewritten documents: assembly, a check of what was assembled, and two steps that can be taken again.

Replacements are put into whole documents or not at all. What comes out is parsed again, and every leaf that was expected must be there with its role,
containers, tokens and measurement. Documents are then staged, made visible, and recorded as evidence. Each step overwrites its own part of a table and is
marked when it has ended, so that a run that was killed anywhere is taken up where its last mark stands and ends as one that wasn't.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import materialize
from . import identity, structure
from .tokens import scan

STATES = ("staged", "published", "recorded")


def refusals(leaves: DataFrame, replacements: DataFrame) -> DataFrame:
    """(doc_id, start, reason) of replacements (doc_id, start, length, text) that aren't of a whole included leaf without excisions, or overlap."""
    j = replacements.alias("r").join(leaves.alias("l"), ["doc_id", "start", "length"], "left")
    size = replacements.groupBy("doc_id", "start").agg(F.count("*").alias("same"))
    reason = (
        F.when(F.col("r.text").isNull(), "no-text").when(F.col("l.role").isNull(), "not-a-leaf").when(~F.col("l.included"), "excluded").when(F.size("l.excisions") > 0, "contains-excisions").when(F.col("same") > 1, "repeated")
    )  # leaves don't overlap, and so neither do replacements of different ones
    return j.join(size, ["doc_id", "start"]).select("doc_id", "start", reason.alias("reason")).where("reason is not null").distinct()


def assembled(documents: DataFrame, leaves: DataFrame, replacements: DataFrame) -> DataFrame:
    """(doc_id, text, replaced, refused) of documents (doc_id, text): with all of a document's replacements, or with none and the reason."""
    bad = refusals(leaves, replacements).groupBy("doc_id").agg(F.min("reason").alias("refused"))
    listed = replacements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", F.col("text").alias("new")))).alias("rs"))
    j = documents.join(listed, "doc_id", "left").join(bad, "doc_id", "left").withColumn("raw", F.col("text").cast("binary"))

    def cut(start: Column, end: Column | None) -> Column:
        return F.substr("raw", (start + 1).cast("int"), (end - start).cast("int")).cast("string") if end is not None else F.substr("raw", (start + 1).cast("int")).cast("string")

    def end(i: Column) -> Column:
        last = F.get("rs", i - 1)
        return F.when(i == 0, F.lit(0).cast("long")).otherwise(last["start"] + last["length"])

    pieces = F.transform("rs", lambda r, i: F.concat(cut(end(i), r["start"]), r["new"]))
    whole = F.concat(F.array_join(pieces, ""), cut(end(F.size("rs")), None))
    done = F.col("rs").isNotNull() & F.col("refused").isNull()
    return j.select("doc_id", F.when(done, whole).otherwise(F.col("text")).alias("text"), F.when(done, F.size("rs")).otherwise(0).alias("replaced"), "refused")


def splices(documents: DataFrame, leaves: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, start, index, intact) of candidates (doc_id, start, length, index, text) for included leaves: whether a document with only this candidate in the
    leaf's place has, of all that touch the place, one included leaf, of its exact span and with the old one's containers."""
    old = leaves.where("included").select("doc_id", "start", "length", F.col("containers").alias("old"))
    raw = F.col("whole").cast("binary")
    head, tail = F.substr(raw, F.lit(1), F.col("start").cast("int")), F.substr(raw, (F.col("start") + F.col("length") + 1).cast("int"))
    j = candidates.join(old, ["doc_id", "start", "length"]).join(documents.select("doc_id", F.col("text").alias("whole")), "doc_id")
    made = j.select("doc_id", "start", "index", "old", F.octet_length("text").cast("long").alias("size"), F.concat(head.cast("string"), "text", tail.cast("string")).alias("spliced"))
    made = materialize(made.withColumn("row", F.monotonically_increasing_id()), "spliced")
    found = structure.document_leaves(made.select(F.col("row").alias("doc_id"), F.col("spliced").alias("text"))).where("included").select(F.col("doc_id").alias("row"), F.col("start").alias("at"), F.col("length").alias("n"), "containers")
    met = made.drop("spliced").join(found, "row").where((F.col("at") < F.col("start") + F.col("size")) & (F.col("start") < F.col("at") + F.col("n")))
    exact = (F.col("at") == F.col("start")) & (F.col("n") == F.col("size")) & (F.col("containers") == F.col("old"))
    one = met.groupBy("row").agg((F.count("*") == 1).alias("alone"), F.bool_and(exact).alias("exact"))
    intact = F.coalesce(F.col("alone") & F.col("exact"), F.lit(False)).alias("intact")
    known = made.join(one, "row", "left").select("doc_id", "start", "index", intact)
    return candidates.select("doc_id", "start", "index").join(known, ["doc_id", "start", "index"], "left").fillna(False, ["intact"])


def token_signature(text: Column) -> Column:
    """A hash of a text's tokens and their classes, in order."""

    def signed(x: str | None) -> str:
        digest = hashlib.sha256()
        for _, _, token, kind in scan(x or ""):
            digest.update(f"{len(token)}:{token}:{kind};".encode("utf-8", "surrogatepass"))
        return digest.hexdigest()

    return F.udf(signed, "string", useArrow=True)(text)


def expectations(leaves: DataFrame, replacements: DataFrame) -> DataFrame:
    """(doc_id, start, length, role, containers, tokens) of all included leaves as they must be found after assembly: replaced ones with their new text's
    tokens, the others with their own, all at the place to which what stands before moves them."""
    new = replacements.select("doc_id", "start", "length", F.col("text").alias("new"))
    j = leaves.join(new, ["doc_id", "start", "length"], "left")
    grown = F.coalesce(F.octet_length("new").cast("long"), F.col("length")) - F.col("length")
    # what replacements before a leaf add up to: they are few, and met as a list
    moves = replacements.groupBy("doc_id").agg(F.collect_list(F.struct("start", (F.octet_length("text").cast("long") - F.col("length")).alias("by"))).alias("moves"))
    shift = F.aggregate(F.filter("moves", lambda m: m["start"] < F.col("start")), F.lit(0).cast("long"), lambda a, m: a + m["by"])
    out = j.where("included").join(moves, "doc_id", "left")
    return out.select("doc_id", (F.col("start") + F.coalesce(shift, F.lit(0))).alias("start"), (F.col("length") + grown).alias("length"), "role", "containers", token_signature(F.coalesce("new", "text")).alias("tokens"))


def checked(expected: DataFrame, texts: DataFrame, measured: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, outcome) for each expected leaf (doc_id, start, length, role, containers, tokens) of the texts (doc_id, text), parsed again.

    outcome: ok, missing, role, tokens, or measurement where measured and found (doc_id, start, and equal columns) are given and differ. Only
    measured leaves are compared; one that isn't found there differs.
    """
    got = structure.document_leaves(texts).where("included").select("doc_id", "start", "length", "role", "containers", token_signature(F.col("text")).alias("tokens"))
    j = expected.alias("e").join(got.alias("g"), ["doc_id", "start", "length"], "left")
    alike = F.lit(True)
    if measured is not None and found is not None:
        columns = [c for c in measured.columns if c not in ("doc_id", "start")]
        m, f = (d.select("doc_id", "start", F.struct(*columns).alias(n)) for d, n in ((measured, "m"), (found, "f")))
        j = j.join(m, ["doc_id", "start"], "left").join(f, ["doc_id", "start"], "left")
        alike = F.col("m").isNull() | F.col("m").eqNullSafe(F.col("f"))
    same = F.col("e.role").eqNullSafe(F.col("g.role")) & F.col("e.containers").eqNullSafe(F.col("g.containers"))
    outcome = F.when(F.col("g.role").isNull(), "missing").when(~same, "role").when(F.col("e.tokens") != F.col("g.tokens"), "tokens").when(~alike, "measurement").otherwise("ok")
    return j.select("doc_id", "start", outcome.alias("outcome"))


@dataclass(frozen=True)
class Publisher:
    """Publications in a folder: staged, published and evidence tables by invocation, and the marks of the steps that have ended."""

    spark: SparkSession
    folder: str

    def _at(self, table: str, invocation: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}/invocation={invocation}"

    def _marks(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("invocation string, state string, digest string").parquet(f"{self.folder.rstrip('/')}/marks")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def states(self) -> DataFrame:
        """(invocation, state): the last step of each that has ended."""
        marks = self._marks()
        if marks is None:
            return self.spark.createDataFrame([], "invocation string, state string")
        place = F.array_position(F.lit(list(STATES)), F.col("state"))
        return marks.groupBy("invocation").agg(F.max_by("state", place).alias("state"))

    def state(self, invocation: str) -> str:
        row = self.states().where(F.col("invocation") == invocation).first()
        return row["state"] if row else "unknown"

    def gaps(self) -> DataFrame:
        """Invocations that are visible but aren't recorded as evidence."""
        return self.states().where("state = 'published'").select("invocation")

    def _mark(self, invocation: str, state: str, digest: str) -> None:
        self.spark.createDataFrame([(invocation, state, digest)], "invocation string, state string, digest string").coalesce(1).write.mode("append").parquet(f"{self.folder.rstrip('/')}/marks")

    def stage(self, documents: DataFrame) -> str:
        """Writes documents (doc_id, text) and gives the invocation, which is the identity of what they are: the same documents are the same invocation."""
        held = materialize(documents.select("doc_id", "text"), "documents")
        invocation = identity.artifact_id(held, "publication")
        if self.state(invocation) == "unknown":
            held.write.mode("overwrite").parquet(self._at("staged", invocation))
            self._mark(invocation, "staged", invocation)
        return invocation

    def publish(self, invocation: str) -> None:
        """Makes the staged documents visible, after their identity is derived from them again."""
        if self.state(invocation) == "unknown":
            raise LookupError(f"{invocation} isn't staged")
        if self.state(invocation) != "staged":
            return
        held = self.spark.read.parquet(self._at("staged", invocation))
        if identity.artifact_id(held, "publication") != invocation:
            raise identity.Mismatch(f"what is staged as {invocation} is something else")
        held.write.mode("overwrite").parquet(self._at("published", invocation))
        self._mark(invocation, "published", invocation)

    def record(self, invocation: str) -> None:
        """Records the hashes of the visible documents' included paragraphs."""
        state = self.state(invocation)
        if state == "recorded":
            return
        if state != "published":
            raise LookupError(f"{invocation} isn't published")
        leaves = structure.document_leaves(self.spark.read.parquet(self._at("published", invocation))).where("included")
        leaves.select("doc_id", "ordinal", F.sha2("text", 256).alias("paragraph_hash")).write.mode("overwrite").parquet(self._at("evidence", invocation))
        self._mark(invocation, "recorded", invocation)

    def resume(self, invocation: str) -> str:
        """Takes the steps that are left, and gives the state."""
        self.publish(invocation)
        self.record(invocation)
        return self.state(invocation)

    def published(self) -> DataFrame:
        """The visible documents of all invocations whose publication has ended; what a killed run left half written isn't among them."""
        done = self.states().where("state <> 'staged'")
        rows = self.spark.read.schema("doc_id long, text string, invocation string").parquet(f"{self.folder.rstrip('/')}/published")
        return rows.join(done.select("invocation"), "invocation", "left_semi")
