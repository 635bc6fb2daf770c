import math
from statistics import NormalDist, median

import numpy as np
import pandas as pd
import pytest
from penstroke.functions import constants as C
from penstroke.functions.scalars import content_id, contraction, lexical_tokens, possessive, probit
from penstroke.functions.tables import cumulative
from penstroke.operators import corpus, evaluate, exemplars, lint, preserve, rewrite, store, structure, style
from penstroke.sources.corpora import load_rules, walk
from penstroke.streaming.scoring import scored
from pyspark.sql import functions as F


def test_vocabularies_have_their_sizes():
    assert len(C.FUNCTION_WORDS) == 147 and len(C.CLAUSE_MARKERS) == 20 and len(C.LINT_RULES) == 22 and len(C.S_HOSTS) == 12 and len(preserve._NEGATIONS) == 41


def test_tokens_and_flags(spark):
    df = spark.createDataFrame([("It's the dogs' don't re-read 12 3rd naïve’s",)], "t string")
    assert df.select(lexical_tokens(F.col("t"))).first()[0] == ["It's", "the", "dogs'", "don't", "re-read", "3rd", "naïve’s"]
    w = spark.createDataFrame([(x,) for x in ("it's", "dog's", "dogs'", "don't", "We’ll", "plain", "let's")], "t string")
    got = {r[0]: (r[1], r[2]) for r in w.select("t", contraction(F.col("t")), possessive(F.col("t"))).collect()}
    assert got == {"it's": (True, False), "dog's": (False, True), "dogs'": (False, True), "don't": (True, False), "We’ll": (True, False), "plain": (False, False), "let's": (True, False)}


def test_probit_is_the_normal_quantile(spark):
    u = [i / 200 for i in range(1, 200)] + [1e-9, 1 - 1e-9]
    got = spark.createDataFrame([(x,) for x in u], "u double").select("u", probit("u").alias("q")).collect()
    assert all(abs(r["q"] - NormalDist().inv_cdf(r["u"])) < 1e-9 for r in got)


def test_ids_frame_byte_lengths(spark):
    import hashlib

    assert spark.range(1).select(content_id(F.lit("é"), F.lit("ab"))).first()[0] == hashlib.sha256("2:é2:ab".encode()).hexdigest()


def test_cumulative_counts(spark):
    r = np.random.default_rng(1)
    rows = [(int(g), float(v), int(n)) for g in range(3) for v, n in zip(r.permutation(50), r.integers(0, 5, 50))]
    got = cumulative(spark.createDataFrame(rows, "g int, v double, n long"), "g", "v", "n").collect()
    assert all(x["below"] == sum(n for g, v, n in rows if g == x["g"] and v < x["v"]) for x in got) and len(got) == 150


def test_admission_order(spark):
    rows = [(1, "b.md", "same words", "s"), (2, "a.md", "same words", "s"), (3, "c.md", "...", "s"), (4, "d.md", "...", "s"), (5, "e.md", "", "s")]
    got = {r["path"]: (r["admission"], r["duplicate_of"], r["split"] != "") for r in corpus.admitted(spark.createDataFrame(rows, "doc_id long, path string, text string, source string")).collect()}
    assert got == {"a.md": ("eligible", None, True), "b.md": ("rejected-duplicate", "a.md", False), "c.md": ("rejected-too-short", None, False), "d.md": ("rejected-duplicate", "c.md", False), "e.md": ("rejected-too-short", None, False)}
    assert corpus.published_screen(spark.createDataFrame(rows, "doc_id long, path string, text string, source string"), None).where("tool_output is not null").count() == 0


def test_bytes_admission(spark):
    rows = [("a", b"\xef\xbb\xbf\xef\xbb\xbfx"), ("b", b"\xff\xfe"), ("c", "�".encode())]
    got = {r["path"]: (r["valid"], r["had_bom"], r["text"]) for r in corpus.admit_bytes(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a": (True, True, "﻿x"), "b": (False, False, None), "c": (True, False, "�")}


def test_features_of_a_sentence(spark):
    df = spark.createDataFrame([(1, 0, "The cat, which sat; ran: home."), (1, 1, "..."), (1, 2, "Word")], "doc_id long, seg int, line string")
    a, b, c = sorted(style.vectors(df).collect(), key=lambda r: r["seg"])
    assert a["lexical"] == 6 and a["word_length_mean"] == pytest.approx(21 / 6) and a["comma_density"] == a["semicolon_density"] == a["colon_density"] == pytest.approx(1 / 6)
    assert a["function_word_rate"] == pytest.approx(2 / 6) and a["clause_marker_rate"] == pytest.approx(1 / 6) and a["sv_clause_marker_rate"] == pytest.approx(1 / 6 * 5 / 6 / 6) and a["sv_comma_density"] == pytest.approx(1 / 36)
    assert a["sv_word_length_mean"] == pytest.approx(np.var([3, 3, 5, 3, 3, 4], ddof=1) / 6)
    assert b["word_length_mean"] is None and c["word_length_mean"] == 4 and c["sv_word_length_mean"] is None


def test_standardisation_and_its_reasons(spark):
    long = spark.createDataFrame([(1, "f", 0.5, 0.01), (2, "f", 0.5, 0.0025), (3, "f", None, None), (4, "f", 1.0, None), (5, "g", 1.0, 0.0), (6, "h", 1.0, 0.0), (7, "k", 1.0, 0.0)], "id int, feature string, value double, sv double")
    stats = spark.createDataFrame([("f", 0.4, 0.01), ("g", None, None), ("h", 1.0, None), ("k", 1.0, 0.0)], "feature string, mean double, variance double")
    got = {r["id"]: (r["z"], r["reason"]) for r in style.standardized(long, stats).collect()}
    assert got[1][0] == pytest.approx(0.7071067811865476) and got[2][0] == pytest.approx(0.894427190999916)
    assert [got[i][1] for i in (3, 4, 5, 6, 7)] == ["feature-undefined", "sampling-variance-undefined", "profile-undefined", "profile-variance-undefined", "zero-variance"]


def test_rank_transform_against_a_reference(spark):
    ref = spark.createDataFrame([(i, "f", float(i // 2), None) for i in range(40)], "id int, feature string, z double, reason string")
    q = spark.createDataFrame([(1, "f", 3.0, None), (2, "f", -1.0, None), (3, "f", 99.0, None), (4, "f", None, "feature-undefined"), (5, "g", 1.0, None)], "id int, feature string, z double, reason string")
    got = {r["id"]: r for r in style.deviations(q, ref).collect()}
    assert got[1]["u"] == pytest.approx((6 + 1 + 0.5) / 41) and got[2]["u"] == pytest.approx(0.5 / 41) and got[3]["dev"] == pytest.approx(NormalDist().inv_cdf(40.5 / 41))
    assert got[4]["reason"] == "feature-undefined" and got[5]["reason"] == "reference-too-small"


def test_mad_trimming(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    long = spark.createDataFrame([("f", v) for v in values], "feature string, value double")
    mad = median(abs(v - 3) for v in values)
    assert sorted(r["value"] for r in style.mad_trimmed(long, 3.0).collect()) == [v for v in values if abs(v - 3) <= 3 * 1.4826 * mad]
    assert style.mad_trimmed(long, 0.0).count() == 5


#: The seed of the intervals stated below.
GOLDEN_SEED = 0x68617061785F7631


def population(spark, authors, distractors):
    rows = [("author", f"a{i % authors[2]:02d}", float(v)) for i, v in enumerate(range(authors[0], authors[1] + 1))] + [("distractor", f"d{i % distractors[2]:02d}", float(v)) for i, v in enumerate(range(distractors[0], distractors[1] + 1))]
    return spark.createDataFrame(rows, "class string, document string, distance double")


def test_thresholds_and_bootstrap_of_a_comfortable_population(spark):
    d = population(spark, (1, 100, 20), (201, 250, 10))
    t = evaluate.thresholds(d).first()
    assert (t["low"], t["high"], t["verdict"]) == (96.0, 205.0, "separated")
    draws = evaluate.resampled(d, t["low"], t["high"], seed=GOLDEN_SEED).cache()
    i = evaluate.intervals(draws).first()
    assert (i["low_lower"], i["low_upper"], i["high_lower"], i["high_upper"], i["qualified"], i["shippable"]) == (93.0, 99.0, 202.0, 207.0, 1997, True)
    b = {r["band"]: r for r in evaluate.error_bounds(draws, 20, 10).collect()}
    assert b["not-you"]["bound"] == pytest.approx(0.15) and not b["not-you"]["emitted"] and b["in-range"]["reason"] == "error-bound-exceeds-target"
    assert evaluate.auc(d).first()["auc"] == 1.0 and evaluate.auc_bound(draws, 10).first()["auc_lower"] == pytest.approx(0.7)
    occupied = {r["band"]: (r["author"], r["distractor"]) for r in evaluate.occupancy(evaluate.banded(d, evaluate.thresholds(d))).collect()}
    assert occupied == {"in-range": (96, 0), "drifting": (4, 4), "not-you": (0, 46)}


def test_too_small_populations_are_uncalibrated(spark):
    assert evaluate.thresholds(population(spark, (1, 19, 19), (30, 60, 5))).first()["verdict"] == "uncalibrated"


def test_resamples_are_those_of_a_loop(spark, monkeypatch):
    """Clusters of several sizes, ties within and between classes, a distance that a third of all rows has, and draws in blocks."""
    monkeypatch.setattr(evaluate, "DRAWS", 7)
    r = np.random.default_rng(9)
    rows = [(c, f"{c[0]}{int(r.integers(0, n)):03d}", float(x)) for c, n, m in (("author", 12, 300), ("distractor", 9, 200)) for x in np.where(r.random(m) < 0.33, 1.5, np.round(r.normal(1 if c == "author" else 2, 1, m), 1))]
    rows += [("author", "a999", None)]
    low, high, n = 1.5, 2.1, 60
    got = {x["resample"]: x for x in evaluate.resampled(spark.createDataFrame(rows, "class string, document string, distance double"), low, high, n, seed=5, author_target=0.1, distractor_target=0.1).collect()}
    side = {c: [(d, x) for k, d, x in rows if k == c and x is not None] for c in ("author", "distractor")}
    names = {c: sorted({d for d, _ in v}) for c, v in side.items()}
    assert sorted(got) == list(range(n))
    for k in range(n):
        times = {c: dict(zip(names[c], evaluate.draws(5 + i, len(names[c]), k).tolist(), strict=True)) for i, c in ((1, "author"), (2, "distractor"))}
        a, d = ([x for name, x in side[c] for _ in range(times[c][name])] for c in ("author", "distractor"))
        lows, highs = [x for x in set(a) if sum(y >= x for y in a) / len(a) <= 0.1], [x for x in set(d) if sum(y <= x for y in d) / len(d) <= 0.1]
        assert (got[k]["low"], got[k]["high"]) == ((min(lows), max(highs)) if lows and highs else (None, None))
        assert got[k]["auc"] == pytest.approx(np.mean([(y > x) + (y == x) / 2 for x in a for y in d]))
        assert got[k]["author_error"] == pytest.approx(np.mean([x >= high for x in a])) and got[k]["distractor_error"] == pytest.approx(np.mean([x <= low for x in d]))
    none = evaluate.resampled(spark.createDataFrame(rows[:5], "class string, document string, distance double"), low, high, 3).collect()
    assert [(x["resample"], x["auc"]) for x in none] == [(0, None), (1, None), (2, None)]


def test_draws_are_a_counter():
    one = [evaluate.draws(7, 5, r) for r in range(20)]
    assert all(x.sum() == 5 for x in one) and len({tuple(x) for x in one}) > 5


def test_lint_rules_and_overlaps(spark):
    rules = lint.default_rules()
    text = "é  Let us circle back. At the end of the day, we delve in.\nFurthermore, this is a robust and comprehensive plan"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {(r["rule"], r["start"]) for r in lint.findings(docs, rules).collect()}
    assert got == {("double-space", 2), ("circle-back", 11), ("at-the-end-of-the-day", 24), ("delve", 50), ("robust-comprehensive", 83)}
    hidden = '<!-- lint:allow circle-back reason="quoted" -->\ncircle back\ncircle back'
    f = lint.findings(spark.createDataFrame([(1, hidden)], "doc_id long, text string"), rules, honour=True).collect()
    assert sorted((r["start"], r["suppressed"]) for r in f if r["rule"] == "circle-back") == [(48, True), (60, False)]
    found = spark.createDataFrame([(1, "a", 0, 5, False), (1, "b", 2, 1, False), (1, "c", 2, 9, False), (1, "d", 7, 1, False)], "doc_id long, rule string, start long, length long, suppressed boolean")
    assert sorted((r["start"], r["length"]) for r in lint.without_overlaps(found).collect()) == [(0, 5), (2, 9)]
    with pytest.raises(ValueError):
        lint.Rule("x", "warn", "a*")
    with pytest.raises(ValueError):
        load_rules('version = "1"\n[[rule]]\nid = "x"\nmatcher = "structural"\nunit = "document"\npattern = "a"\nseverity = "warn"\nprovenance = "unvalidated"\ncategory = "formatting"\n')


def test_preserve_both_directions(spark):
    p = spark.createDataFrame([(1, 'Alice paid 1,200 and said "no" at http://x.org/a).', "alice paid 1200 and said nothing to Bob"), (2, "same 5", "same 5")], "pair_id long, current string, candidate string")
    got = {(r["class"], r["item"], r["direction"]) for r in preserve.differences(p).collect()}
    assert got == {("number", "1,200", "lost"), ("number", "1200", "invented"), ("negation", "no", "lost"), ("negation", "nothing", "invented"), ("quote", '"no"', "lost"), ("url", "http://x.org/a", "lost"), ("entity", "bob", "invented")}


def test_scripts(spark):
    def counts(rows):
        return spark.createDataFrame(rows, "k int, script string, letters long")

    old = counts([(1, "Latin", 96), (1, "Greek", 4), (2, "Latin", 80), (2, "Greek", 20), (3, "Latin", 10), (3, "Greek", 1), (4, "Latin", 96), (4, "Greek", 4)])
    new = counts([(1, "Latin", 74), (1, "Greek", 4), (2, "Latin", 60), (2, "Greek", 20), (3, "Latin", 23), (3, "Greek", 2), (4, "Latin", 113), (4, "Greek", 6)])
    assert {(r["k"], r["script"]) for r in preserve.overgrown(old, new, "k").collect()} == {(2, "Greek"), (4, "Greek")}


def test_attempts_only_advance_strictly(spark):
    rows = [(1, 0, 5.0, 4.0, ""), (1, 1, 5.0, 3.0, "expanded"), (1, 2, 5.0, 4.0, ""), (1, 3, 5.0, 1.0, ""), (2, 0, 5.0, 5.0, "")]
    got = {r["target"]: (r["accepted"], r["distance"]) for r in preserve.accepted(spark.createDataFrame(rows, "target long, index int, start double, distance double, code string")).collect()}
    assert got == {1: (0, 4.0), 2: (-1, 5.0)}


def test_exemplars_by_hand(spark):
    r = np.random.default_rng(5)
    rows = [(i, f, float(r.integers(0, 12))) for i in range(40) for f in C.FEATURES]
    ranked = exemplars.self_ranked(spark.createDataFrame(rows, "id long, feature string, value double")).cache()
    u = {(x["id"], x["feature"]): x["u"] for x in ranked.collect()}
    values = {f: [v for _, g, v in rows if g == f] for f in C.FEATURES}
    assert all(u[i, f] == pytest.approx((sum(w < v for w in values[f]) + values[f].count(v) / 2 + 0.5) / 41) for i, f, v in rows)
    q = np.asarray([[NormalDist().inv_cdf(u[i, f]) for f in C.FEATURES] for i in range(40)])
    d = np.abs(q[:, None] - q[None]).mean(2)
    want = [np.sort(np.delete(d[i], i))[:6].mean() for i in range(40)]
    got = {x["id"]: x["density"] for x in exemplars.densities(ranked).collect()}
    assert all(got[i] == pytest.approx(want[i]) for i in range(40))
    kept = exemplars.eligible(spark.createDataFrame(sorted(got.items()), "id long, density double")).withColumn("stratum", F.lit("s"))
    assert kept.count() == 30
    picks, _ = exemplars.medoids(ranked, kept, 3)
    ids = [x["id"] for x in kept.collect()]
    for round_, (_, _, pick, total) in enumerate(picks):
        sums = {i: d[i][ids].sum() for i in ids}
        assert pick == min(ids, key=lambda i: (round(sums[i], 6), i)) and total == pytest.approx(sums[pick], abs=1e-6) and round_ < 3
        ids.remove(pick)


MARKDOWN = """---
title: x
---
# A heading

First paragraph with `code` and ![pic](a.png) here, long enough to count.
Second line of it.

> Quoted words that make a whole sentence here.

- short item
- An item that is a full sentence, as it ends so.

```
code
```

| a | b |
|---|---|
| c | d |

Note[^n] here is some text for a reader.

[^n]: The note itself says some words too.

<figure><figcaption>A caption of words that is quite long enough.</figcaption></figure>
"""


def test_markdown_leaves():
    got = [(x.role, x.containers[1:], x.exclusion, MARKDOWN[x.start : x.end][:12]) for x in structure.leaves(MARKDOWN)]
    assert ("front-matter", (), "excluded-by-role", "title: x") in got and ("heading", (), "excluded-by-role", "A heading") in got and ("paragraph", ("block-quote",), "excluded-by-block-quote-policy", "Quoted words") in got
    assert ("paragraph", ("list", "list-item"), "excluded-not-sentential", "short item") in got and ("paragraph", ("list", "list-item"), "", "An item that") in got
    assert ("code-block", (), "excluded-by-role", "code") in got and ("table-cell", ("table",), "excluded-by-role", "c") in got and ("footnote", ("footnote-section", "footnote"), "", "The note its") in got
    assert any(x[0] == "caption" and not x[2] for x in got) and {x[0] for x in got} <= set(structure.ROLES) and {x[2] for x in got} <= set(structure.EXCLUSIONS)
    p = next(x for x in structure.leaves(MARKDOWN) if MARKDOWN.startswith("First", x.start))
    assert structure.run_text(MARKDOWN, p) == "First paragraph with  and  here, long enough to count.\nSecond line of it."
    assert structure.merged([(3, 8), (0, 5), (8, 9)]) == [(0, 8), (8, 9)]


def test_splice_and_assemble():
    text = "One whole sentence is here now.\n\nAnother sentence follows it here.\n"
    a, b = structure.leaves(text)
    assert structure.spliceable(text, a.start, a.end, "A new sentence is put here.") and not structure.spliceable(text, a.start, a.end, "Two paragraphs are here.\n\nAnd the second one too.")
    assert structure.assembled(text, [(b.start, b.end, "B."), (a.start, a.end, "A.")]) == "A.\n\nB.\n"
    with pytest.raises(ValueError):
        structure.assembled(text, [(a.start, a.end - 1, "A.")])


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert s.put("t", rows, "id") == 2 and s.put("t", rows, "id") == 0 and s.load("t").count() == 2
    with pytest.raises(store.Conflict):
        s.put("t", spark.createDataFrame([(1, "z")], "id long, v string"), "id")
    kids = spark.createDataFrame([("p", 0), ("p", 1), ("q", 0), ("q", 2), ("r", 0), ("r", 0)], "parent string, ordinal int")
    assert sorted(r[0] for r in store.gaps(kids, "parent").collect()) == ["q", "r"]


def test_reachability_is_a_closure(spark):
    edges = spark.createDataFrame([("k", i, "k", i + 1) for i in range(6)] + [("k", 3, "k", 0), ("k", 50, "k", 51)], "from_kind string, from_id long, to_kind string, to_id long")
    seeds = spark.createDataFrame([("k", 2)], "kind string, id long")
    assert sorted(r["id"] for r in store.reachable(seeds, edges).collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_publication_check_and_shift(spark):
    old = spark.createDataFrame([(1, 0, 5, 8), (1, 10, 4, 2), (1, 20, 3, 3)], "doc_id long, start long, length long, new_length long")
    assert [r["new_start"] for r in rewrite.shifted(old).orderBy("start").collect()] == [0, 13, 21]
    leaf = "doc_id long, start long, length long, role string, containers array<string>"
    want, got = spark.createDataFrame([(1, 0, 5, "paragraph", []), (1, 9, 2, "paragraph", []), (1, 20, 2, "paragraph", [])], leaf), spark.createDataFrame([(1, 0, 5, "paragraph", []), (1, 9, 2, "heading", [])], leaf)
    assert [r["outcome"] for r in rewrite.publication_check(want, got).orderBy("start").collect()] == ["ok", "changed", "missing"]


def test_walk(spark, tmp_path):
    for name in ("a.md", "b/c.txt", ".hidden/d.md", "b/.e.md", "f.rst"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r["path"] for r in walk(spark, f"file://{tmp_path}").collect()) == ["a.md", "b/c.txt"]


def test_streaming_scores_equal_batch_scores(spark, tmp_path):
    r = np.random.default_rng(7)
    words = ["the", "which", "house", "a", "garden;", "and,", "blue:", "runs", "where", "evening"]
    lines = [(int(i), 0, " ".join(r.choice(words, 14))) for i in range(120)]
    df = spark.createDataFrame(lines, "doc_id long, seg int, line string")
    long = style.long_form(style.vectors(df).drop("line")).cache()
    stats = style.profile(long.where("doc_id < 60"))
    z = style.standardized(long, stats).cache()
    reference = z.where("doc_id between 60 and 99")
    batch = {x["doc_id"]: x["distance"] for x in style.distances(style.deviations(z.where("doc_id >= 100"), reference), ["doc_id", "seg"]).collect()}
    df.where("doc_id >= 100").write.parquet(f"{tmp_path}/in")
    q = scored(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), stats, reference).writeStream.format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    live = {x["doc_id"]: x["distance"] for x in spark.table("scores").collect()}
    assert set(live) == set(batch) and all(live[k] == pytest.approx(batch[k]) if batch[k] is not None else live[k] is None for k in batch)
    assert math.isfinite(pd.Series(list(batch.values())).dropna().mean())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("3..14", ["3", "14"]), ("1,,000", ["1", "000"]), (".5", ["5"]), ("12,34", ["12", "34"]), ("1.2.3", ["1", "2", "3"]), ("1,234.", ["1,234"]), ("1234,567", ["1234", "567"]),
        ("1,2345", ["1", "2345"]), ("1,000.00", ["1,000.00"]), ("1,234,567.89", ["1,234,567.89"]), ("12.5", ["12.5"]), ("3rd abc123 v1", []), ("a 7 b", ["7"]), ("1,234,56", ["1", "234", "56"]),
    ],
)
def test_numbers_by_their_grammar(spark, text, want):
    from penstroke.functions.scalars import numbers

    assert spark.range(1).select(numbers(F.lit(text))).first()[0] == want


def test_quotes_addresses_and_scripts(spark):
    row = spark.range(1).select(preserve.quotes(F.lit('a "b" “c” “d "e"')).alias("q"), preserve.urls(F.lit("see https://a.b/c\u00a0next, www.x.y).")).alias("u")).first()
    assert row["q"] == ['"b"', "“c”"] and row["u"] == ["https://a.b/c", "www.x.y"]
    df = spark.createDataFrame([(1, "abc где ابت คน 漢字 1!"), (2, ""), (3, None)], "k long, t string")
    got = {(r["script"], r["letters"]) for r in preserve.script_counts(df, "k", "t").collect()}
    assert got == {("Latin", 3), ("Cyrillic", 3), ("Arabic", 3), ("Thai", 2), ("Han", 2)}


@pytest.mark.parametrize("pattern", ["(?=x)", "(?<=q)", "a*", "\\b", "x|"])
def test_rules_that_match_nothing_are_refused(pattern):
    with pytest.raises(ValueError):
        lint.Rule("r", "warn", pattern)
