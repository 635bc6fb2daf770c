import hashlib
import random
import re
import struct

import pytest
from penstroke.operators import identity
from pyspark.sql import functions as F


def shown(v):
    """The shortest digits by hand."""
    if v == 0:
        return "0"
    mantissa, exponent = f"{abs(v):.17e}", None
    for n in range(17):
        mantissa = f"{abs(v):.{n}e}"
        if float(mantissa) == abs(v):
            break
    digits, exponent = mantissa.split("e")[0].replace(".", "").rstrip("0"), int(mantissa.split("e")[1])
    sign = "-" if v < 0 else ""
    if exponent < -4 or exponent >= 6:
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    return sign + (digits + "0" * (exponent + 1 - len(digits)) if len(digits) <= exponent + 1 else f"{digits[: exponent + 1]}.{digits[exponent + 1 :]}")


def test_numbers_read_back_to_the_same_bits(spark):
    r = random.Random(1)
    values = [0.0, -0.0, 1.0, 1e6, 999999.0, 123456.7, 1e-4, 1e-5, 0.1, -2.5, 1 / 3, 1e22, 5e-324, 1.7976931348623157e308, 100.0, 2e23]
    values += [x for x in (struct.unpack("<d", r.randbytes(8))[0] for _ in range(400)) if x == x and abs(x) != float("inf")] + [r.uniform(-10, 10) for _ in range(200)]
    got = [(x["v"], x["s"]) for x in spark.createDataFrame([(v,) for v in values], "v double").select("v", identity.canonical(F.col("v")).alias("s")).collect()]
    assert [s for _, s in got] == [shown(v) for v in values] and all(float(s) == v for v, s in got)
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(identity.canonical(F.col("v")).alias("s"))
    assert [x["s"] for x in bad.collect()] == [None] * 3


def test_fields_have_no_order_and_nulls_are_not_empty(spark):
    one = spark.range(1)
    a, b = F.lit("x"), F.lit("y")
    assert one.select(identity.named_id(p=a, q=b)).first()[0] == one.select(identity.named_id(q=b, p=a)).first()[0] == hashlib.sha256(b"1:p2:+x1:q2:+y").hexdigest()
    ids = {one.select(identity.named_id(p=v)).first()[0] for v in (F.lit(""), F.lit(None).cast("string"), F.lit("-"))}
    assert len(ids) == 3


def tree_by_hand(digests):
    groups = [("", d) for d in digests]
    for i, n in enumerate(identity.PREFIXES):
        held = {}
        for prefix, d in groups:
            held.setdefault((d if i == 0 else prefix)[:n], []).append(d)
        groups = [(p, hashlib.sha256("".join(sorted(v)).encode()).hexdigest()) for p, v in held.items()]
    return groups[0][1] if groups else hashlib.sha256(b"").hexdigest()


def test_the_tree_is_that_of_a_loop_in_any_order(spark):
    digests = [hashlib.sha256(str(i % 290).encode()).hexdigest() for i in range(300)]
    df = spark.createDataFrame([(d,) for d in digests], "digest string")
    assert identity.tree_id(df) == identity.tree_id(df.repartition(7)) == tree_by_hand(digests) != identity.tree_id(df.distinct())
    assert identity.tree_id(df.limit(0)) == tree_by_hand([])


DOCS = "path string, content_hash string, admission string, duplicate_of string"


def test_a_changed_member_changes_the_snapshot_and_is_named(spark):
    rows = [(f"p{i:03d}", hashlib.sha256(str(i).encode()).hexdigest(), "eligible", None) for i in range(200)]
    new = [*rows[1:50], (*rows[50][:2], "rejected-duplicate", "p003"), ("p051", "f" * 64, *rows[51][2:]), *rows[52:], ("q", "0" * 64, "eligible", None)]
    old_df, new_df = (spark.createDataFrame(r, DOCS) for r in (rows, new))
    policy = identity.policy_id(spark, seed="s", weights="8/1/1")
    name = identity.snapshot_id(old_df, policy)
    assert name == identity.snapshot_id(old_df.repartition(5), policy) and identity.verified_snapshot(old_df, policy, name).count() == 200
    with pytest.raises(identity.Mismatch):
        identity.verified_snapshot(new_df, policy, name)
    with pytest.raises(ValueError, match="paths repeat"):
        identity.snapshot_id(old_df.union(old_df.limit(1)), policy)
    assert identity.snapshot_id(old_df, identity.policy_id(spark, seed="t", weights="8/1/1")) != name
    got = {(r["path"], r["change"], r["before"], r["after"]) for r in identity.changes(old_df, new_df).collect()}
    assert got == {("p000", "removed", None, None), ("q", "added", None, None), ("p050", "admission", "eligible", "rejected-duplicate"), ("p051", "content_hash", rows[51][1], "f" * 64)}
    assert identity.changes(old_df, old_df).count() == 0


def test_artifacts_come_back_to_the_bit_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.1 + 0.2, 1), ("b", None, 2), ("c", -1e-300, 3)], "feature string, mean double, n int")
    name = identity.put_artifact(rows, f"file://{tmp_path}", "profile", snapshot="s")
    assert re.fullmatch("[0-9a-f]{64}", name) and name == identity.put_artifact(rows.select("n", "mean", "feature").repartition(3), f"file://{tmp_path}", "profile", snapshot="s")
    back = identity.load_artifact(spark, f"file://{tmp_path}", "profile", name, snapshot="s")
    assert {(r["feature"], r["mean"]) for r in back.collect()} == {("a", 0.1 + 0.2), ("b", None), ("c", -1e-300)}
    with pytest.raises(identity.Mismatch):
        identity.load_artifact(spark, f"file://{tmp_path}", "profile", name, snapshot="other")
    rows.withColumn("mean", F.col("mean") + 1e-16).write.mode("overwrite").parquet(f"{tmp_path}/profile/{name}")
    with pytest.raises(identity.Mismatch):
        identity.load_artifact(spark, f"file://{tmp_path}", "profile", name, snapshot="s")


def test_bindings(spark):
    rows = [("reference", "r", "p", "s"), ("threshold", "t", "p", "s"), ("reference", "r", "q", "s"), ("threshold", "t", "q", "u"), ("reference", "r", "o", None)]
    got = {r["profile_id"]: (r["artifacts"], r["bound"]) for r in identity.same_binding(spark.createDataFrame(rows, "kind string, id string, profile_id string, snapshot_id string")).collect()}
    assert got == {"p": (2, True), "q": (2, False), "o": (1, False)}
