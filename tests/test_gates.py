"""The token stream, graphemes, gates and the surface."""

import random
import unicodedata

import pytest
from penstroke import surface
from penstroke.operators import gates, tokens, structure
from pyspark.sql import functions as F


def scanned(text):
    return [(t, c) for _, _, t, c in tokens.scan(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("It's 3rd.", [("It's", "word"), ("3rd", "word"), (".", "punctuation")]),
        ("1,234.5 12", [("1,234.5", "number"), ("12", "number")]),
        ("1.2.3", [("1", "number"), (".", "punctuation"), ("2", "number"), (".", "punctuation"), ("3", "number")]),
        ("abc123 ½ €5 −2", [("abc123", "word"), ("½", "number"), ("€", "symbol"), ("5", "number"), ("−", "punctuation"), ("2", "number")]),
        ("the dogs' 'dogs'", [("the", "word"), ("dogs'", "word"), ("'", "punctuation"), ("dogs", "word"), ("'", "punctuation")]),
        ("re-read a‑b c- d", [("re-read", "word"), ("a‑b", "word"), ("c", "word"), ("-", "punctuation"), ("d", "word")]),
        ("café слово 漢字", [("café", "word"), ("слово", "word"), ("漢字", "word")]),
        (" \t \n", []),
    ],
)
def test_tokens_of_all_classes(text, want):
    assert scanned(text) == want


def test_offsets_cut_the_tokens_out_of_the_bytes():
    r = random.Random(4)
    text = "".join(r.choice("aé漢😀'-1., ́€\n") for _ in range(5000))
    for start, length, token, _ in tokens.scan(text):
        assert unicodedata.normalize("NFC", text.encode()[start : start + length].decode()) == token


def test_stream_and_run_tokens(spark):
    df = spark.createDataFrame([(1, "It's `x` here"), (2, None), (3, "")], "doc_id long, text string")
    got = tokens.stream(df)
    assert [tuple(r) for r in got.orderBy("ordinal").select("doc_id", "start", "token", "contraction").limit(2).collect()] == [(1, 0, "It's", True), (1, 5, "`", False)]
    leaves = spark.createDataFrame([(1, 0, 8, [(5, 3)]), (1, 9, 4, []), (3, 0, 0, [])], "doc_id long, start long, length long, excisions array<struct<start:long,length:long>>")
    assert sorted((r["token"], r["leaf_start"]) for r in tokens.run_tokens(got, leaves).collect()) == [("It's", 0), ("here", 9)]
    assert tokens.stream(df.limit(0)).count() == 0


def test_spans_keep_to_graphemes(spark):
    text = "aé👩‍🚀z"
    edges = tokens.boundaries(text)
    assert edges == [0, 1, 4, 15, 16]
    assert tokens.snap(edges, 2, 1) == (1, 3) and tokens.snap(edges, -5, 3) == (0, 0) and tokens.snap(edges, 5, 99) == (4, 12) and tokens.snap(edges, 9, -4) == (4, 11)
    assert tokens.resolve(text, 1, 3) == ("é", "") and tokens.resolve(text, 2, 1) == (None, "not-a-boundary") and tokens.resolve(text, 0, 99) == (None, "out-of-bounds")
    df = spark.createDataFrame([(1, text, [(2, 1), (0, 1)]), (2, None, [(0, 5)]), (3, "x", None)], "doc_id long, text string, spans array<struct<start:int,length:int>>")
    got = {(r["doc_id"], r["start"]): (r["snapped_start"], r["snapped_length"], r["widened"]) for r in tokens.snapped(df).collect()}
    assert got == {(1, 2): (1, 3, True), (1, 0): (0, 1, False), (2, 0): (0, 0, True)}


def test_bands_fall_to_drifting(spark):
    df = spark.createDataFrame([(0.5,), (0.8,), (1.2,), (None,)], "distance double")

    def bands(**kw):
        out = gates.calibrated_bands(df, 0.6, 1.0, **kw).select("distance", "band", "reason").collect()
        return {r["distance"]: (r["band"], r["reason"]) for r in out}

    assert bands(emitted={"not-you": False}) == {0.5: ("in-range", ""), 0.8: ("drifting", ""), 1.2: ("drifting", ""), None: (None, "undefined-distance")}
    assert bands(emitted={}, calibrated=False) == {0.5: (None, "uncalibrated"), 0.8: (None, "uncalibrated"), 1.2: (None, "uncalibrated"), None: (None, "undefined-distance")}
    with pytest.raises(ValueError):
        gates.calibrated_bands(df, 2.0, 1.0, {})


def test_manifests_members_and_bindings(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k long") for v in ([1, 2, 2, 3], [1, 2, 4]))
    assert sorted(tuple(r) for r in gates.mismatches(a, b, "k").collect()) == [(2, 2, 1), (3, 1, 0), (4, 0, 1)]
    assert sorted(r["k"] for r in gates.strangers(a, b, "k").collect()) == [3]
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "a", "x"), (2, "a", None), (3, "b", "y")], "k long, p string, q string")
    assert sorted((r["k"], r["alike"]) for r in gates.bound_alike(rows, "k", "p", "q").collect()) == [(1, True), (2, False), (3, True)]


def test_judged_needs_one_measured_segment_in_a_band(spark):
    df = spark.createDataFrame([(2, 0.1, "x"), (1, None, None), (1, 0.1, None), (1, 0.1, "x")], "n int, d double, b string")
    c = [F.col(x) for x in "ndb"]
    assert [r[0] for r in df.select(gates.judged_segment(*c, candidate=True)).collect()] == ["not-one-segment", "candidate-unscoreable", "uncalibrated", ""]
    assert [r[0] for r in df.select(gates.judged_segment(*c, candidate=False, allow_uncalibrated=True)).collect()] == ["not-one-segment", "unscoreable", "", ""]


def corpus_of(spark, seed, source, extra):
    r, rows = random.Random(seed), []
    for i in range(60):
        lines = []
        for _ in range(8):
            words = [r.choice(["the", "house", "which", "river", "of", "and", "stone", extra]) for _ in range(r.randint(14, 30))]
            lines.append(" ".join(w + (r.choice([",", ";", ":"]) if r.random() < 0.15 else "") for w in words) + ".")
        rows.append((seed * 1000 + i, f"{source}/{i:03}", "\n".join(lines), source))
    return spark.createDataFrame(rows, "doc_id long, path string, text string, source string")


def test_surface_tells_an_author_from_another(spark):
    own, other = surface.index(corpus_of(spark, 1, "a", "sea")), surface.index(corpus_of(spark, 2, "b", "incomprehensibilities"))
    fitted = surface.profile(own)
    result = surface.evaluate(fitted, own, other)
    assert result.auc > 0.6
    # a handful of test documents can't bound an error at 5 %
    assert set(result.bounds) == set(result.emitted) == {"in-range", "not-you"} and result.bounds["not-you"] > 0.05 and not result.emitted["not-you"]
    assert result.auc_lower is not None and result.auc_lower <= result.auc and not result.shippable and result.intervals["resamples"] == 2000
    claims = surface.Evaluation(0.7, 1.0, "separated", None, {"in-range": False, "not-you": True})
    withheld = {r["band"]: r["count"] for r in surface.score(fitted, surface.features(other), claims).groupBy("band").count().collect()}
    free = {r["band"]: r["count"] for r in surface.score(fitted, surface.features(other), surface.Evaluation(0.7, 1.0, "separated", None)).groupBy("band").count().collect()}
    assert "in-range" in free and "in-range" not in withheld and withheld["drifting"] == free["in-range"] + free.get("drifting", 0) and withheld.get("not-you") == free.get("not-you")
    scored = surface.score(fitted, surface.features(other), surface.Evaluation(0.7, 1.0, "separated", None))
    assert scored.count() == 480 and {r[0] for r in scored.select("band").distinct().collect()} <= {"in-range", "drifting", "not-you"}
    assert {r[0] for r in surface.score(fitted, surface.features(other)).select("reason").distinct().collect()} == {"uncalibrated"}
    paragraphs = other.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg", "line"))
    chosen = spark.createDataFrame([(2000, 0)], "doc_id long, seg int")
    published = paragraphs.where("doc_id = 2001").select(F.sha2(F.trim("line"), 256).alias("h"))
    plan = surface.plan_rewrite(scored, paragraphs, published, chosen).groupBy("disposition").count().collect()
    assert {r[0]: r[1] for r in plan} == {"target": 1, "not-selected": 479}
    plan = surface.plan_rewrite(scored, paragraphs, published).where("disposition = 'already-rewritten'")
    assert plan.count() == 8
    with pytest.raises(ValueError):
        surface.evaluate(fitted, own, own)
    with pytest.raises(surface.CorpusTooSmall):
        surface.profile(own.limit(2))
    found, verdicts = surface.tells(spark.createDataFrame([(1, "We delve  into it.")], "doc_id long, text string"))
    assert {r["rule"] for r in found.collect()} == {"double-space", "delve"} and verdicts.first()["screening"] == "indeterminate"


def test_surface_rewrites_and_checks_its_documents(spark):
    own = surface.index(corpus_of(spark, 1, "a", "sea"))
    fitted = surface.profile(own)
    r = random.Random(3)
    near = " ".join(r.choice(["the", "house", "which", "river", "of", "and", "stone", "sea"]) for _ in range(20)) + "."
    far = " ".join(["incomprehensibilities"] * 16) + "."
    documents = spark.createDataFrame([(1, f"{far}\n\n> Quoted.\n\n{near}\n"), (2, f"{far}\n")], "doc_id long, text string")
    leaves = {(x["doc_id"], x["start"]): x["length"] for x in structure.document_leaves(documents).where("included").collect()}
    targets = spark.createDataFrame([(d, s, n) for (d, s), n in leaves.items()], "doc_id long, start long, length long")
    closer = " ".join(["incomprehensibilities"] * 10 + ["the"] * 2 + ["which"] * 4) + "."
    later = max(s for d, s in leaves if d == 1)
    rows = [(1, 0, 0, closer + "\n\nTwo."), (1, 0, 1, "# " + closer), (1, 0, 2, closer), (1, later, 0, far), (1, later, 1, None), (2, 0, 0, far + " Alice"), (2, 0, 1, " ".join(["incomprehensibilities"] * 40))]
    outcome, made, checked = surface.execute(fitted, None, documents, targets, spark.createDataFrame(rows, "doc_id long, start long, index int, text string"), allow_uncalibrated=True)
    codes = {(x["target"], x["index"]): x["code"] for x in outcome.attempts.collect()}
    assert codes["1:0", 2] == "" and codes["1:0", 0] != "" and codes["1:0", 1] == "not-spliceable" and codes[f"1:{later}", 0] == "not-improved" and codes["2:0", 0] == "not-preserved" and codes["2:0", 1] == "expanded"
    done = {x["target"]: (x["terminal"], x["changed"]) for x in outcome.targets.collect()}
    assert done == {"1:0": ("attempts-exhausted", True), f"1:{later}": ("empty-provider-response", False), "2:0": ("empty-provider-response", False)}
    texts = {x["doc_id"]: x["text"] for x in made.collect()}
    assert texts == {1: f"{closer}\n\n> Quoted.\n\n{near}\n", 2: f"{far}\n"}
    assert {(x["doc_id"], x["outcome"]) for x in checked.collect()} == {(1, "ok"), (2, "ok")} and checked.count() == 3
