"""Exact neighbours by blocks, sums without pairs, and the record of a selection, against all pairs."""

import numpy as np
import pytest
from penstroke.functions import constants as C
from penstroke.operators import exemplars
from pyspark.sql import functions as F

NAMES = list(C.FEATURES)


def vectors(n, seed, gaps=0.0, copies=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 6)) * [1, 1, 0.3, 2, 1, 1], 2)
    x[:, 2] = np.where(r.random(n) < 0.7, 0.0, x[:, 2])
    x[r.random((n, 6)) < gaps] = np.nan
    if copies:
        x[:copies] = x[0]
    return x


def ranked_of(spark, x):
    rows = [(i, f, None if np.isnan(v) else float(v)) for i, row in enumerate(x) for f, v in zip(NAMES, row, strict=True)]
    return spark.createDataFrame(rows, "id long, feature string, q double")


@pytest.mark.parametrize(("gaps", "copies", "block"), [(0.0, 0, 16), (0.25, 0, 8), (0.0, 120, 16), (0.4, 40, 4), (0.0, 0, 10_000)])
def test_densities_are_those_of_all_pairs(spark, gaps, copies, block):
    x = vectors(300, 3, gaps, copies)
    d = exemplars.pair_distances(x, x)
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, 1)[:, :15]
    want = [v.mean() if np.isfinite(v).all() else None for v in near]
    got = {r["id"]: r["density"] for r in exemplars.densities(ranked_of(spark, x), block, 100).collect()}
    assert len(got) == 300 and all(got[i] == (pytest.approx(w) if w is not None else None) for i, w in enumerate(want))


def test_few_points_and_none(spark):
    assert [r["density"] for r in exemplars.densities(ranked_of(spark, vectors(3, 1))).collect()] == [None] * 3
    assert exemplars.densities(ranked_of(spark, vectors(3, 1)).limit(0)).count() == 0


@pytest.mark.parametrize("gaps", [0.0, 0.4])
def test_sums_and_picks_are_those_of_all_pairs(spark, gaps):
    x = vectors(90, 8, gaps, 4)
    ranked = ranked_of(spark, x).cache()
    strata = [("a", "b", "c")[min(i % 5, 2)] for i in range(90)]
    chosen = spark.createDataFrame(list(enumerate(strata)), "id long, stratum string")
    d = exemplars.pair_distances(x, x)
    np.fill_diagonal(d, np.inf)
    members = exemplars.wide(ranked).join(chosen, "id")
    for r in exemplars.distance_sums(members).collect():
        own = [d[r["id"], j] for j in range(90) if strata[j] == r["stratum"] and np.isfinite(d[r["id"], j])]
        assert r["total"] == pytest.approx(sum(own)) and r["partners"] == len(own)
    picks, ties = exemplars.medoids(ranked, chosen, 7)
    left = {s: [i for i in range(90) if strata[i] == s] for s in "abc"}
    want = []
    for n in range(7):
        s = "cab"[n % 3]  # by size
        sums = {i: [d[i, j] for j in left[s] if np.isfinite(d[i, j])] for i in left[s]}
        best = min((i for i in left[s] if sums[i]), key=lambda i: (round(sum(sums[i]), 6), i))
        want.append((n // 3 + 1, s, best, pytest.approx(sum(sums[best]), abs=2e-6)))
        left[s].remove(best)
    assert picks == want and ("stratum-order", 0, "a") in ties


def test_a_selection_records_its_ties(spark):
    x = vectors(60, 5)
    x[1] = x[0]
    ranked, stratum = ranked_of(spark, x).cache(), spark.range(60).select("id", F.lit("s").alias("stratum"))
    s = exemplars.select(ranked, stratum, 3)
    assert s.k == 7 and s.density.where("eligible").count() == 45 and s.medoids.count() == 3 and len(s.selection_id) == 64
    same = ranked_of(spark, np.ones((40, 6)))
    s = exemplars.select(same, stratum, 2)
    assert sorted((r["tie"], r["round"], r["what"]) for r in s.ties.collect()) == [("eligibility", 0, "29"), ("medoid", 1, "0"), ("medoid", 2, "1")]
    with pytest.raises(ValueError, match="population-too-small"):
        exemplars.select(ranked_of(spark, x[:29]), stratum, 2)
