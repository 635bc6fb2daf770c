import pytest
from penstroke.operators import policy
from pyspark.sql import functions as F


def test_policies_refuse_what_is_outside_their_vocabulary(spark):
    good = policy.Policy("en-gb")
    assert good.identity(spark) == policy.Policy("en-gb").identity(spark) != policy.Policy("en-gb", seed="other").identity(spark)
    for bad in ({"register": ""}, {"register": "-en"}, {"register": "EN"}, {"register": "e" * 33}, {"role": "editor"}, {"min_lexical": 0}, {"seed": ""}, {"weights": {"train": 1}}, {"weights": {"train": 8, "calibrate": 0, "test": 1}}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            policy.Policy(**{"register": "en", **bad})


def test_the_first_invalid_byte(spark):
    rows = [(b"abc", None), (b"\xff", 0), ("é".encode() + b"\xc3", 2), (b"a\xed\xa0\x80", 1), ("�".encode(), None), (b"", None), (None, None)]
    df = spark.createDataFrame([(r, i) for r, i in rows], "content binary, want long")
    assert all(r["got"] == r["want"] for r in df.select("want", policy.invalid_at(F.col("content")).alias("got")).collect())


def test_drafts_stand_alone(spark):
    docs = spark.createDataFrame([(1, "a.md", "same words", "s"), (2, "b.md", "same words", "s"), (3, "c.md", "...", "s")], "doc_id long, path string, text string, source string")
    (r,) = policy.draft_snapshot(docs, "b.md").collect()
    assert (r["split"], r["admission"]) == ("draft", "eligible")  # a copy elsewhere doesn't make it a duplicate
    with pytest.raises(ValueError, match="rejected-too-short"):
        policy.draft_snapshot(docs, "c.md")
    with pytest.raises(LookupError):
        policy.draft_snapshot(docs, "d.md")


def test_checks_that_were_not_performed(spark):
    rows = [(c, "passed") for c in policy.QUALIFYING]
    kind = "check_name string, state string"
    assert not policy.requires_checks(spark.createDataFrame([*rows, ("overlap", "not-performed")], kind))
    assert policy.requires_checks(spark.createDataFrame(rows[1:], kind)) and policy.requires_checks(spark.createDataFrame([("language", "not-performed"), *[r for r in rows if r[0] != "language"]], kind))


def test_screens_are_bound_to_their_pair(spark):
    a, b = (spark.createDataFrame([(x * 64,) for x in s], "content_hash string") for s in ("ab", "cd"))
    screen = policy.overlap_attestation(a, b)
    r = screen.first()
    assert policy.attested(screen, r["author_id"], r["distractor_id"]) == "" and policy.attested(screen, r["distractor_id"], r["author_id"]) == "not-screened"
    assert policy.attested(screen, r["author_id"], r["distractor_id"], "other-v2") == "other-algorithm"
    both = screen.unionByName(screen.withColumn("shared", F.lit(3).cast("long")))
    assert policy.attested(both, r["author_id"], r["distractor_id"]) == "contradicting-screens"
    same = policy.overlap_attestation(a, a)
    assert policy.attested(same, r["author_id"], r["author_id"]) == "overlapping" and same.first()["shared"] == 2


def test_lists_of_paragraphs():
    assert policy.chosen_paragraphs("3,0,12") == [3, 0, 12]
    for bad in ("", "1,", "a", "-1", "1,01", " 1", "1,1", "٣"):
        with pytest.raises(ValueError):
            policy.chosen_paragraphs(bad)
