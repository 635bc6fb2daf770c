"""Findings with directives, widened spans and limits; papers cut at headings; running sums."""

import random
import re

import pytest
from penstroke.functions.tables import running
from penstroke.operators import lint, papers

RULES = [lint.Rule("a-mark", "warn", "e"), lint.Rule("word", "error", "(?i)delve", "derived")]


def test_directives_and_what_they_suppress(spark):
    lines = ["é <!-- lint:allow word reason=\"quoted\" --> delve", "é delve, Delve", "delve", "<!-- lint:allow word -->", "delve", '<!-- lint:allow none reason="x" -->', "delve", '<!-- lint:allow word reason="last" -->']
    text = "\n".join(lines)
    raw = text.encode()
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = lint.directives(docs, RULES).orderBy("start").collect()
    assert [(r["rule"], r["reason"], r["state"]) for r in got] == [("word", "quoted", "applied"), ("word", "", "malformed"), ("none", "x", "unknown"), ("word", "last", "dangling")]
    assert raw[got[0]["scope_start"] : got[0]["scope_end"]].decode() == lines[1] and all(raw[r["start"] : r["start"] + r["length"]].startswith(b"<!--") for r in got)
    found = [r for r in lint.findings(docs, RULES, honour=True).orderBy("start").collect() if r["rule"] == "word"]
    assert [raw[r["start"] : r["start"] + r["length"]].decode().lower() for r in found] == ["delve"] * len(found)
    assert [(r["suppressed"], r["reason"]) for r in found] == [(False, None), (True, "quoted"), (True, "quoted")] + [(False, None)] * (len(found) - 3) and len(found) == 6
    assert not lint.findings(docs, RULES).where("suppressed").count()


def test_spans_widen_to_graphemes_and_limits_are_told(spark):
    text = "cafe\u0301 e e\u0301"
    docs = spark.createDataFrame([(1, text), (2, "e e e")], "doc_id long, text string")
    raw = text.encode()
    found = [r for r in lint.findings(docs, RULES).orderBy("start").collect() if r["doc_id"] == 1]
    assert [(raw[r["start"] : r["start"] + r["length"]].decode(), r["widened"], r["truncated"]) for r in found] == [("e\u0301", True, False), ("e", False, False), ("e\u0301", True, False)]
    limited = lint.findings(docs, RULES, limit=3)
    assert {r["truncated"] for r in limited.collect()} == {False} and limited.count() == 6
    limited = lint.findings(docs, RULES, limit=2)
    assert {r["truncated"] for r in limited.collect()} == {True} and limited.count() == 4


def test_reports_compare_only_if_whole_and_by_the_same_rules(spark):
    kind, one, two = "doc_id long, errors int, warns int, infos int, truncated boolean, rules string", lint.rule_set_id(RULES), lint.rule_set_id(RULES[:1])
    assert one == lint.rule_set_id(RULES[::-1]) != two
    a = spark.createDataFrame([(1, 0, 1, 0, False, one), (2, 0, 1, 0, True, one), (3, 0, 1, 0, False, one), (4, 1, 0, 0, False, one)], kind)
    b = spark.createDataFrame([(1, 0, 2, 0, False, one), (2, 0, 0, 0, False, one), (3, 0, 1, 0, False, two), (4, 0, 9, 9, False, one)], kind)
    assert {r["doc_id"]: (r["comparable"], r["comparison"]) for r in lint.comparable(a, b).collect()} == {1: (True, 1), 2: (False, None), 3: (False, None), 4: (True, -1)}


@pytest.mark.parametrize("keys", [1, 3, 40])
def test_running_sums(spark, keys):
    r = random.Random(keys)
    rows = [(r.randrange(keys), i, r.randrange(3)) for i in range(300)]
    got = {(x["k"], x["i"]): x["upto"] for x in running(spark.createDataFrame(rows, "k long, i long, v long"), "k", ["i"], "v").collect()}
    assert got == {(k, i): sum(v for q, j, v in rows if q == k and j <= i) for k, i, v in rows}
    assert running(spark.createDataFrame([], "k long, i long, v long"), "k", ["i"], "v").count() == 0


def papers_by_hand(lines, edition, said):
    heads = [i for i in range(1, len(lines)) if re.match(papers.NUMERAL, lines[i].strip()) and lines[i - 1].strip() == edition]
    out = []
    for n, h in enumerate(heads):
        stop = heads[n + 1] - 1 if n + 1 < len(heads) else len(lines)
        own = lines[h + 1 : stop]
        at = next((i for i, x in enumerate(own) if x.strip() in said), None)
        body = own[at + 1 :] if at is not None else []
        while body and body[-1].strip() in ("", edition):
            body.pop()
        out.append((n, re.match(papers.NUMERAL, lines[h].strip())[1], " ".join(x.strip() for x in own[:at] if x.strip()) if at is not None else "", said[own[at].strip()] if at is not None else None, "\n".join(body).strip()))
    return out


def test_papers_are_those_of_a_loop(spark):
    r, said = random.Random(2), {"HAMILTON": "h", "JAY": "j"}
    texts = {d: [r.choice(["THE EDITION.", "No. IV.", " No. XC ", "HAMILTON", "JAY", "A title", "body line", "  indented", ""]) for _ in range(n)] for d, n in enumerate([0, 1, 60, 200, 5])}
    texts[9] = ["THE EDITION.", "No. I", "On unity", "", "JAY", "first", "", "  second", "THE EDITION.", "", "THE EDITION.", "No. II.", "Nobody wrote this", "THE EDITION.", "No. I.", "Again", "HAMILTON"]
    lines = spark.createDataFrame([(d, i, x) for d, ls in texts.items() for i, x in enumerate(ls)], "doc_id long, seg int, line string")
    got = {}
    for x in papers.papers(lines, "THE EDITION.", said).collect():
        got.setdefault(x["doc_id"], []).append(x)
    for d, ls in texts.items():
        own = sorted(got.get(d, []), key=lambda x: x["index"])
        assert [(x["index"], x["roman"], x["title"], x["attribution"], x["text"]) for x in own] == papers_by_hand(ls, "THE EDITION.", said)
    assert [(x["number"], x["duplicate"], x["first"]) for x in sorted(got[9], key=lambda x: x["index"])] == [(1, True, True), (2, False, True), (1, True, False)]
    assert papers.papers(lines.where("doc_id = 0"), "THE EDITION.", said).count() == 0
