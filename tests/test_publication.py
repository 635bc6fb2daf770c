"""Assembly, the check of what was assembled, and publications that are killed between their steps."""

import pytest
from penstroke.operators import identity, publication, structure
from pyspark.sql import functions as F

TEXT = "First pärt is here now.\n\n> A quote of somebody.\n\n- An item that is a sentence.\n\nWith `code` in it.\n\nLast one ends it all.\n"


def setting(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, TEXT), (3, TEXT), (4, None)], "doc_id long, text string").fillna("")
    leaves = structure.document_leaves(docs).cache()
    at = {(r["doc_id"], r["text"][:5]): (r["start"], r["length"]) for r in leaves.collect()}
    return docs, leaves, at


def test_replacements_are_all_put_in_or_none(spark):
    docs, leaves, at = setting(spark)
    rows = [(1, *at[1, "Last "], "The énd."), (1, *at[1, "First"], "Begin now."), (2, *at[2, "First"], "x"), (2, *at[2, "A quo"], "y"), (3, *at[3, "With "], "z")]
    out = {r["doc_id"]: r for r in publication.assembled(docs, leaves, spark.createDataFrame(rows, "doc_id long, start long, length long, text string")).collect()}
    assert out[1]["text"] == TEXT.replace("First pärt is here now.", "Begin now.").replace("Last one ends it all.", "The énd.") and out[1]["replaced"] == 2
    assert (out[2]["text"], out[2]["replaced"], out[2]["refused"]) == (TEXT, 0, "excluded") and out[3]["refused"] == "contains-excisions" and out[4]["text"] == ""
    bad = [(1, 3, 4, "x"), (1, *at[1, "Last "], None), (2, *at[2, "Last "], "a"), (2, *at[2, "Last "], "b")]
    got = {(r["doc_id"], r["start"], r["reason"]) for r in publication.refusals(leaves, spark.createDataFrame(bad, "doc_id long, start long, length long, text string")).collect()}
    assert got == {(1, 3, "not-a-leaf"), (1, at[1, "Last "][0], "no-text"), (2, at[2, "Last "][0], "repeated")}


def test_what_was_assembled_is_checked(spark):
    docs, leaves, at = setting(spark)
    changes = spark.createDataFrame([(1, *at[1, "First"], "Begin with this sentence."), (2, *at[2, "First"], "# Now a heading"), (3, *at[3, "First"], "Two parts.\n\nOf it.")], "doc_id long, start long, length long, text string")
    out = publication.assembled(docs, leaves, changes)
    expected = publication.expectations(leaves, changes)

    def outcomes(*more):
        got = {}
        for r in publication.checked(expected, out, *more).orderBy("start").collect():
            got.setdefault(r["doc_id"], []).append(r["outcome"])
        return got

    # each has four included leaves; a heading has none of the span, two paragraphs none of the length
    assert outcomes() == {1: ["ok"] * 4, 2: ["missing", "ok", "ok", "ok"], 3: ["missing", "ok", "ok", "ok"]}
    assert publication.checked(expected.withColumn("tokens", F.lit("t")), out).where("outcome = 'tokens'").count() == 10
    assert publication.checked(expected.withColumn("role", F.lit("caption")), out).where("outcome = 'role'").count() == 10
    measured = spark.createDataFrame([(1, 0, 0.5, "drifting"), (2, 99, 0.1, None)], "doc_id long, start long, distance double, band string")
    assert outcomes(measured, measured)[1] == ["ok"] * 4
    assert outcomes(measured, measured.withColumn("distance", F.lit(0.25)))[1] == ["measurement", "ok", "ok", "ok"]
    assert outcomes(measured, measured.limit(0))[1] == ["measurement", "ok", "ok", "ok"]


@pytest.mark.parametrize("killed", ["write staged", "mark staged", "write published", "mark published", "write evidence", "mark recorded", "never"])
def test_a_killed_publication_ends_as_one_that_was_not(spark, tmp_path, monkeypatch, killed):
    docs, _, _ = setting(spark)
    folder, step = f"file://{tmp_path}/p", killed.split()
    at, mark = publication.Publisher._at, publication.Publisher._mark

    def failing_at(self, table, invocation):
        if step[0] == "write" and step[-1] == table:
            raise RuntimeError("killed")
        return at(self, table, invocation)

    def failing_mark(self, invocation, state, digest):
        if step[0] == "mark" and step[-1] == state:
            raise RuntimeError("killed")
        mark(self, invocation, state, digest)

    p = publication.Publisher(spark, folder)
    with monkeypatch.context() as m:
        m.setattr(publication.Publisher, "_at", failing_at)
        m.setattr(publication.Publisher, "_mark", failing_mark)
        if killed == "never":
            p.resume(p.stage(docs))
        else:
            with pytest.raises(RuntimeError, match="killed"):
                p.resume(p.stage(docs))
    assert p.gaps().count() == (killed in ("write evidence", "mark recorded"))
    invocation = p.stage(docs)  # the next run
    assert p.resume(invocation) == "recorded" == p.state(invocation) and p.gaps().count() == 0
    assert sorted((r["doc_id"], r["text"]) for r in p.published().collect()) == sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert spark.read.parquet(f"{folder}/evidence").count() == 12 and p.states().count() == 1
    assert p.resume(invocation) == "recorded" and p._marks().count() == 3


def test_only_what_is_staged_is_published(spark, tmp_path):
    docs, _, _ = setting(spark)
    p = publication.Publisher(spark, f"file://{tmp_path}/p")
    with pytest.raises(LookupError):
        p.publish("nothing")
    name = p.stage(docs)
    with pytest.raises(LookupError):
        p.record(name)
    docs.withColumn("text", F.lit("other")).write.mode("overwrite").parquet(f"{tmp_path}/p/staged/invocation={name}")
    with pytest.raises(identity.Mismatch):
        p.publish(name)
    assert p.state(name) == "staged"
