"""Queries at sizes and on inputs at which they failed once."""

import math
import random
import re
import statistics
from collections import Counter

import pytest
import regex
from penstroke.functions import scalars
from penstroke.operators import evaluate, lint, preserve, style, tokens
from penstroke.plans import texts
from pyspark.sql import functions as F


def test_orphans_have_no_order_at_all(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1), (5, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r[0] for r in texts.orphan_rows(spark, str(tmp_path)).collect()] == [3]


def test_draws_of_resamples_are_never_broadcast(spark):
    """Drawn tables come from few rows of work, by which the plan would take them for small."""
    plans, frame = [], type(spark.range(0))
    real = frame.mapInArrow

    def kept(self, *a, **k):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return real(self, *a, **k)

    rows = [(c, f"{c}{i}", i / 100 + (c == "distractor")) for c in ("author", "distractor") for i in range(60)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(frame, "mapInArrow", kept)
        got = evaluate.resampled(spark.createDataFrame(rows, "class string, document string, distance double"), resamples=20).collect()
    met = [p for p in plans if "times#" in p and "Join" in p]
    assert len(got) == 20 and met and not any("BroadcastHashJoin [class" in p for p in met)


def test_common_texts_are_cut_by_the_faster_pattern_into_the_same_tokens():
    r = random.Random(7)
    every = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    plain = ["".join(r.choice(every[: 0x250 if k % 2 else None]) if r.random() < 0.5 else r.choice("aé1,.-'’2 ½€\n") for _ in range(200)) for k in range(400)]
    for text in plain:
        fast = tokens.pattern_of(text)
        assert fast is not tokens._TOKEN
        assert [(*m.span(), m.lastgroup) for m in fast.finditer(text)] == [(*m.span(), m.lastgroup) for m in tokens._TOKEN.finditer(text)]
    assert tokens.pattern_of("a 😀") is tokens._TOKEN


def test_scripts_are_counted_without_a_list_of_all_letters(spark):
    text = "Aé ß9 Ωя漢字 ひカ 𐐷 ﬁ ª µ ー"
    df = spark.createDataFrame([(1, text), (2, None), (3, "12 ."), (4, "abc")], "k long, t string")
    got = preserve.script_counts(df, "k", "t")
    names = preserve.scripts(spark)
    want = {(1, s, n) for s in names if (n := len(regex.findall(rf"[\p{{L}}&&\p{{Script={s}}}]", text, regex.V1)))} | {(4, "Latin", 3)}
    assert {tuple(r) for r in got.collect()} == want
    assert "regexp_extract_all(t#" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_meet_their_leaf_and_not_all_leaves_of_the_document(spark):
    text = "one two\n\nthree 4\n" * 3
    docs = spark.createDataFrame([(1, text), (2, "alone")], "doc_id long, text string")
    at, rows = 0, []
    for line in text.split("\n"):
        rows.append((1, at, len(line), [(at, 1)] if line.startswith("three") else []))
        at += len(line) + 1
    leaves = spark.createDataFrame(rows, "doc_id long, start long, length long, excisions array<struct<start:long,length:long>>")
    got = tokens.run_tokens(tokens.stream(docs), leaves)
    assert sorted((r["token"], r["leaf_start"]) for r in got.collect()) == sorted((t, a) for a in (0, 17, 34) for t, a in (("one", a), ("two", a), ("4", a + 9)))
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_words_like_a_language_are_no_attribution(spark, tmp_path):
    """Titles and bodies of the letters of a language, and a language without a name."""
    rows = [(1, "DE\nFR\nEN", "fr"), (2, "one\ntwo", "fi"), (3, "EN", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = texts.edition_papers(spark, str(tmp_path)).select("doc_id", "title", "attribution", "text").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "DE", "French", "FR\n\n  EN"), (2, "one", None, "two"), (3, "EN", "English", "")]


def test_words_are_the_lexical_tokens_and_features_pass_over_them_few_times(spark):
    r = random.Random(3)
    texts_ = ["".join(r.choice("aé1²٣.-'’‑, ́ǅ\U0001d400Ω") for _ in range(r.randrange(40))) for _ in range(4000)] + ["7" * 100_000, "", "1" * 5000 + "a"]
    both = spark.createDataFrame([(t,) for t in texts_], "t string").select(scalars.words(F.col("t")).alias("a"), scalars.lexical_tokens(F.col("t")).alias("b"))
    assert both.where("a <> b").count() == 0 and both.where("size(a) > 0").count() > 1000
    plan = style.vectors(spark.createDataFrame([("x",)], "line string"), floor=10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("regexp_replace") == 0 and plan.count("lambdafunction") <= 6, plan


def test_texts_without_a_rules_literals_are_not_searched_and_nothing_is_lost(spark):
    rules = [*lint.default_rules(), lint.Rule("ski", "warn", "(?i)(s?ki|tha[nt] +x)"), lint.Rule("any", "warn", "[a-c]x"), lint.Rule("cased", "warn", "Not(?! a)")]
    assert lint.needed("(?i)(s?ki|tha[nt] +x)") == ("ki", "tha") and lint.needed("[a-c]?(x|[yz])") == () and all(lint.needed(r.pattern) for r in lint.default_rules())
    r, parts = random.Random(5), ["delve", "DELVING", "Unpack  THIS", "not just a b c d, but", "ſKİ", "ſkı", "Not", "not", "bx", "\n", "é", "that x", "At the end of the day,", "driving value", "x at scale"]
    docs = [(i, " ".join(r.choice(parts) for _ in range(r.randrange(9)))) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((i, x.id, len(re.findall(x.pattern, t))) for i, t in docs for x in rules if re.search(x.pattern, t))
    assert sorted((a, b, n) for (a, b), n in Counter((x["doc_id"], x["rule"]) for x in lint.findings(frame, rules).collect()).items()) == want
    ascii_only = frame.where("text rlike '^[\\\\x00-\\\\x7f]*$'")
    got = sorted(map(tuple, lint.counts(ascii_only, rules).collect()))
    kept = {x["doc_id"] for x in ascii_only.collect()}
    assert got == [x for x in want if x[0] in kept] and got


def test_findings_meet_directives_without_a_join(spark):
    allow = '<!-- lint:allow delve reason="{}" -->'
    text = f"{allow.format('a')}{allow.format('b')}\nwe delve\ndelve\n{allow.format('c')}\n\ndelve {allow.format('d')}"
    found = lint.findings(spark.createDataFrame([(1, text)], "doc_id long, text string"), lint.default_rules(), honour=True)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(x["suppressed"], x["reason"]) for x in found.where("rule = 'delve'").orderBy("start").collect()] == [(False, None)] * 2 + [(True, "a")] + [(False, None)] * 4


def test_rows_without_a_value_are_not_joined_to_ranks(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 7) if i % 2 and i % 5 else None, None if i % 2 and i % 5 else "feature-undefined") for i in range(200)]
    query = spark.createDataFrame(rows, "doc_id long, feature string, z double, reason string")
    got = style.deviations(query, query.where("doc_id < 100"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    rows_ = {r["doc_id"]: (r["u"], r["reason"]) for r in got.collect()}
    values = [z for i, _, z, _ in rows if i < 100 and z is not None]
    want = {i: ((sum(v < z for v in values) + values.count(z) / 2 + 0.5) / (len(values) + 1) if z is not None else None, why) for i, _, z, why in rows}
    assert {k: (u and round(u, 12), why) for k, (u, why) in rows_.items()} == {k: (u and round(u, 12), why) for k, (u, why) in want.items()}


def test_profiles_have_the_same_bits_however_rows_are_dealt(spark):
    r = random.Random(11)
    rows = [(f, v) for f, values in {"a": [r.choice((r.random() * 9, r.randint(0, 9) / 7, 1e-6 * r.random())) for _ in range(3000)], "b": [0.1] * 300, "c": [None] * 9 + [2.5] * 9}.items() for v in values]
    found = set()
    for parts in (1, 3, 7):
        r.shuffle(rows)
        got = style.profile(spark.createDataFrame(rows, "feature string, value double").repartition(parts), 10).collect()
        found.add(tuple(sorted(tuple(x) for x in got)))
    (one,) = found
    a = [v for f, v in rows if f == "a"]
    assert one[1:] == (("b", 300, 0, 0.1, 0.0), ("c", 9, 9, None, None)) and one[0][:3] == ("a", 3000, 0)
    assert one[0][3] == pytest.approx(math.fsum(a) / 3000, rel=4e-16) and one[0][4] == pytest.approx(statistics.variance(a), rel=1e-14)
