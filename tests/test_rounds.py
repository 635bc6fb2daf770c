"""Rounds of rewriting against a loop over one target, and pruning by its rules."""

import random

import pytest
from penstroke.functions import constants as C
from penstroke.operators import rounds, store
from pyspark.sql import functions as F

MEASURED = "segments int, distance double, banded boolean, features array<string>, lexical int, scripts array<string>, errors int, warns int, infos int, comparable boolean"
TARGETS, CANDIDATES = f"target long, {MEASURED}", f"target long, index int, {MEASURED}, empty boolean, preserved boolean, overgrown boolean, intact boolean"
PLAIN = {"segments": 1, "distance": 5.0, "banded": True, "features": ["a", "b"], "lexical": 20, "scripts": ["Latin"], "errors": 1, "warns": 0, "infos": 0, "comparable": True}
FINE = {"empty": False, "preserved": True, "overgrown": False, "intact": True}


def loop(target, candidates, attempts=3):
    """One target by hand."""
    now = original = target
    first = "not-one-segment" if now["segments"] != 1 else "unscoreable" if now["distance"] is None else "uncalibrated" if not now["banded"] else ""
    if first:
        return ("not-entered", first, -1, now["distance"]), []
    at, codes = -1, []
    for i in range(attempts):
        c = candidates.get(i)
        if c is None or c["empty"]:
            return ("empty-provider-response", "", at, now["distance"]), codes
        tells = [(x["errors"], x["warns"], x["infos"]) for x in (c, now)]
        code = next(
            (name for name, bad in [
                ("not-one-segment", c["segments"] != 1), ("candidate-unscoreable", c["distance"] is None), ("uncalibrated", not c["banded"]), ("different-features", sorted(c["features"]) != sorted(now["features"])),
                ("not-preserved", not c["preserved"]), ("expanded", c["lexical"] > C.EXPANSION * original["lexical"]), ("language", bool(set(c["scripts"]) - set(now["scripts"]))), ("language-growth", c["overgrown"]),
                ("tells-incomparable", not (c["comparable"] and now["comparable"])), ("tells-worse", tells[0] > tells[1]), ("not-improved", c["distance"] is not None and c["distance"] > now["distance"] - C.EPSILON), ("not-spliceable", not c["intact"]),
            ] if bad), "")
        codes.append((i, code))
        if not code:
            now, at = c, i
    return ("attempts-exhausted", "", at, now["distance"]), codes


def frames(spark, targets, candidates):
    a = spark.createDataFrame([{"target": t, **v} for t, v in targets.items()], TARGETS)
    b = spark.createDataFrame([{"target": t, "index": i, **v} for (t, i), v in candidates.items()], CANDIDATES)
    return a, b


def test_every_code_comes_in_its_order(spark):
    worse = [
        ("not-one-segment", {"segments": 2}), ("candidate-unscoreable", {"distance": None}), ("uncalibrated", {"banded": False}), ("different-features", {"features": ["a"]}), ("not-preserved", {"preserved": False}), ("expanded", {"lexical": 31}),
        ("language", {"scripts": ["Latin", "Greek"]}), ("language-growth", {"overgrown": True}), ("tells-incomparable", {"comparable": False}), ("tells-worse", {"warns": 1}), ("not-improved", {"distance": 5.0}), ("not-spliceable", {"intact": False}),
    ]
    targets, candidates = {}, {}
    for t in range(len(worse)):  # a candidate that fails this guard and all after it
        targets[t] = PLAIN
        candidates[t, 0] = {**PLAIN, **FINE, "distance": 4.0, **{k: v for _, d in reversed(worse[t:]) for k, v in d.items()}}
    targets[90] = {**PLAIN, "distance": None}
    a, b = frames(spark, targets, candidates)
    out = rounds.run(a, b, 1)
    assert [r["code"] for r in out.attempts.orderBy("target").collect()] == [name for name, _ in worse]
    assert {r["reason"] for r in out.targets.collect()} == {"", "unscoreable"}


def test_rounds_are_those_of_a_loop(spark):
    r = random.Random(6)
    def one():
        x = {**PLAIN, **FINE, "distance": round(r.uniform(0, 6), 2)}
        for key, values in (("segments", [0, 2]), ("distance", [None]), ("banded", [False, None]), ("features", [["b", "a"], ["a"], None]), ("preserved", [False, None]), ("lexical", [29, 30, 31]), ("scripts", [["Greek", "Latin"], []]), ("overgrown", [True]), ("comparable", [False]), ("errors", [0, 2]), ("intact", [False]), ("empty", [True])):
            if r.random() < 0.07:
                x[key] = r.choice(values)
        return x

    targets = {t: {k: v for k, v in one().items() if k in PLAIN} for t in range(300)}
    candidates = {(t, i): one() for t in targets for i in range(5) if r.random() < 0.95}
    a, b = frames(spark, targets, candidates)
    out = rounds.run(a, b, 4)
    got = {x["target"]: (x["terminal"], x["reason"], x["accepted"], x["distance"]) for x in out.targets.collect()}
    tried = {}
    for x in out.attempts.collect():
        tried.setdefault(x["target"], []).append((x["index"], x["code"]))

    def filled(x):
        return {k: (v if v is not None or k == "distance" else {"features": [], "scripts": [], "banded": False, "preserved": False}.get(k)) for k, v in x.items()}

    for t, x in targets.items():
        want, codes = loop(filled(x), {i: filled(c) for (k, i), c in candidates.items() if k == t}, 4)
        assert got[t] == want and sorted(tried.get(t, [])) == codes
    assert sum(x["changed"] for x in out.targets.collect()) > 50
    with pytest.raises(ValueError):
        rounds.run(a, b, 0)


def test_texts_are_held_against_the_original(spark):
    rows = [(1, 0, "Alice paid 5 coins.", "Alice gave 5 coins."), (1, 1, "Alice paid 5 coins.", "Alice gave coins."), (1, 2, "Alice paid 5 coins.", "Alice απλα paid 5 coins"), (2, 0, "Latin text", None)]
    got = {(r["target"], r["index"]): r for r in rounds.against(spark.createDataFrame(rows, "target long, index int, original string, text string"), spark.createDataFrame([(1, 1, 2, 0, 1)], "target long, index int, errors int, warns int, infos int")).collect()}
    assert got[1, 0]["preserved"] and got[1, 0]["scripts"] == ["Latin"] and got[1, 0]["lexical"] == 3 and not got[1, 1]["preserved"] and got[1, 1]["errors"] == 2
    assert got[1, 2]["scripts"] == ["Greek", "Latin"] and got[1, 2]["overgrown"] and got[2, 0]["empty"]
    assert not rounds.against(spark.createDataFrame(rows, "target long, index int, original string, text string")).where("comparable").count()


def artifacts(spark):
    rows = {
        "snapshot": [("s1",), ("s2",), ("s3",), ("s4",)], "document": [("d1", "s1"), ("d2", "s2"), ("d3", "s3"), ("d4", "s4"), ("d5", "s4")], "node": [("n1", "d1"), ("n2", "d2"), ("n3", "d3"), ("n4", "d4"), ("n5", "d5")],
        "profile": [("p1", "s1"), ("p2", "s2"), ("p3", "s3")], "reference": [("r1", "p1"), ("r3", "p3")], "selection": [("x1", "p1"), ("x2", "p2")], "selection_member": [("x1", "n4"), ("x2", "n2")],
        "evaluation": [], "attempt": [], "head": [("en", "p1"), ("de", "p3")], "threshold": [("t3", "p3")],
    }
    return {k: spark.createDataFrame(rows[k], ", ".join(f"{c} string" for c in columns)) for k, columns in store.ARTIFACTS.items()}


def test_prune_keeps_what_is_led_to(spark):
    t = artifacts(spark)
    left, removed = store.prune_artifacts(t, spark.createDataFrame([("p1",)], "id string"))
    # the member of x1 is a node of another snapshot, which stays whole
    assert {k: sorted(r[0] for r in v.collect()) for k, v in left.items() if k in ("snapshot", "node", "profile", "reference", "selection", "head")} == {"snapshot": ["s1", "s4"], "node": ["n1", "n4", "n5"], "profile": ["p1"], "reference": ["r1"], "selection": ["x1"], "head": ["en"]}
    assert {r["kind"]: r["removed"] for r in removed.collect()} == {"snapshot": 2, "document": 2, "node": 2, "profile": 2, "reference": 1, "selection": 1, "selection_member": 1, "head": 1, "threshold": 1}
    again, nothing = store.prune_artifacts(left, spark.createDataFrame([("p1",)], "id string"))
    assert nothing.count() == 0 and again["node"].count() == 3
    with pytest.raises(LookupError):
        store.prune_artifacts(t, spark.createDataFrame([("p9",)], "id string"))


def test_audit_rows_are_roots(spark):
    t = artifacts(spark)
    t["evaluation"] = spark.createDataFrame([("p3",)], "profile_id string")
    t["attempt"] = spark.createDataFrame([(None, "n2")], "profile_id string, node_id string")
    left, _ = store.prune_artifacts(t, spark.createDataFrame([], "id string"))
    assert sorted(r["id"] for r in left["profile"].collect()) == ["p3"] and sorted(r["id"] for r in left["node"].collect()) == ["n2", "n3"] and left["attempt"].count() == 1
    assert sorted(r["id"] for r in left["threshold"].collect()) == ["t3"]
    none, _ = store.prune_artifacts(artifacts(spark), spark.createDataFrame([], "id string"))
    assert all(v.count() == 0 for v in none.values())


def test_parents_and_selections_are_consistent(spark):
    t = artifacts(spark)
    assert [r["node_id"] for r in store.strangers_of_selection(t["selection_member"], t["node"], t["document"], "s2").collect()] == ["n4"]
    kids = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", None, 3)], "k string, v string, w int")
    parents = spark.createDataFrame([("a", "x", 1), ("b", "z", 2)], "k string, v string, w int")
    assert sorted((r["k"], r["column"]) for r in store.inconsistent_parents(kids, parents, "k", "v", "w").collect()) == [("b", "v"), ("c", "w")]
