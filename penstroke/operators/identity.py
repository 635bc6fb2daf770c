"""Identities from content: canonical numbers, named and framed fields, and a hash tree over any number of members.

A snapshot's members are hashed one by one and then by falling prefixes of their digests, so that no task puts more than a bounded number of digests
together however many members there are, and two snapshots are compared by descending only where their digests differ. Identities are derived again on read: a
stored one is never believed.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import content_id
from ..functions.tables import materialize

#: Digits of a digest that members and then their groups are put together by; each step has 256 parts at most.
PREFIXES = (6, 4, 2, 0)
ALGORITHM = "digest-tree-v1"


class Mismatch(ValueError):
    """What was read isn't what its identity says."""


def shortest(x: float | None) -> str | None:
    """A double's shortest digits that read back to the same bits: plain from 1e-4 up to below 1e6, with an exponent of two digits or more
    beyond; no trailing zeros, and one zero for both signs. Nothing for what isn't finite."""
    if x is None or not math.isfinite(x):
        return None
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    point = len(text) + exponent  # the value is 0.text times 10 to the power of this
    text = text.rstrip("0")
    if not text:
        return "0"
    if point - 1 < -4 or point - 1 >= 6:
        out = f"{text[0]}{'.' * (len(text) > 1)}{text[1:]}e{'-' if point < 1 else '+'}{abs(point - 1):02d}"
    elif point <= 0:
        out = f"0.{'0' * -point}{text}"
    else:
        out = text.ljust(point, "0")
        out = f"{out[:point]}.{out[point:]}" if len(out) > point else out
    return f"-{out}" if sign else out


def canonical(x: Column) -> Column:
    """The shortest digits of a double. The engine's own text of a double isn't always the shortest, which depends on its runtime."""
    return F.udf(shortest, "string", useArrow=True)(x)


def named_id(**fields: Column) -> Column:
    """A hash of named fields, in the order of their names. A null field and an empty one differ."""
    parts = []
    for name in sorted(fields):
        parts += [F.lit(name), F.when(fields[name].isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), fields[name].cast("string")))]
    return content_id(*parts)


def _joined(of: DataFrame, digits: int) -> DataFrame:
    listed = F.array_join(F.array_sort(F.collect_list("digest")), "")
    return of.groupBy(F.left("digest" if digits == PREFIXES[0] else "prefix", F.lit(digits)).alias("prefix")).agg(F.sha2(listed, 256).alias("digest"))


def levels(members: DataFrame) -> list[DataFrame]:
    """(prefix, digest) of each level of the tree over members (digest), the last of which has one row, or none."""
    out, at = [], members
    for digits in PREFIXES:
        at = materialize(_joined(at, digits), f"level{digits}")
        out.append(at)
    return out


def tree_id(members: DataFrame) -> str:
    """One identity for any number of members (digest), equal ones counted; that of no members is the hash of nothing."""
    top = levels(members)[-1].first()
    return top["digest"] if top else members.sparkSession.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def document_members(documents: DataFrame) -> DataFrame:
    """(path, digest) of documents (path, content_hash, admission, duplicate_of)."""
    return documents.select("path", named_id(path=F.col("path"), content=F.col("content_hash"), admission=F.col("admission"), duplicate=F.col("duplicate_of")).alias("digest"))


def policy_id(spark, **policy: str | int | float) -> str:
    return spark.range(1).select(named_id(**{k: F.lit(str(v)) for k, v in policy.items()}).alias("id")).first()["id"]


def snapshot_id(documents: DataFrame, policy: str) -> str:
    """The identity of a corpus under a policy. Paths must be distinct."""
    if not documents.groupBy("path").count().where("count > 1").isEmpty():
        raise ValueError("paths repeat")
    members = tree_id(document_members(documents).select("digest"))
    return documents.sparkSession.range(1).select(named_id(algorithm=F.lit(ALGORITHM), policy=F.lit(policy), documents=F.lit(members)).alias("id")).first()["id"]


def verified_snapshot(documents: DataFrame, policy: str, stored: str) -> DataFrame:
    """The documents, if their identity is the stored one."""
    found = snapshot_id(documents, policy)
    if found != stored:
        raise Mismatch(f"snapshot {stored} reads as {found}")
    return documents


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, before, after) between two corpora: added, removed, or the first field that differs.

    Members meet only in those parts of the two trees whose digests differ.
    """
    sides = [materialize(d.join(document_members(d), "path").withColumn("prefix", F.left("digest", F.lit(PREFIXES[0]))), "side") for d in (old, new)]
    trees = [_joined(s.select("digest"), PREFIXES[0]).withColumnRenamed("digest", name) for s, name in zip(sides, ("a", "b"), strict=True)]
    differ = materialize(trees[0].join(trees[1], "prefix", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix"), "differ")
    fields = ["content_hash", "admission", "duplicate_of"]
    parts = [s.join(differ, "prefix", "left_semi").select("path", "digest", F.struct(*fields).alias(name)) for s, name in zip(sides, ("old", "new"), strict=True)]
    j = parts[0].alias("o").join(parts[1].alias("n"), "path", "full").where(~F.col("o.digest").eqNullSafe(F.col("n.digest")))
    # a path whose member moved to another part of the tree is in both, as both parts differ
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
    before = after = None
    for f in fields:
        unlike = ~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}"))
        change = change.when(unlike, f)
        before = F.when(unlike, F.col(f"old.{f}")) if before is None else before.when(unlike, F.col(f"old.{f}"))
        after = F.when(unlike, F.col(f"new.{f}")) if after is None else after.when(unlike, F.col(f"new.{f}"))
    there = F.col("old").isNotNull() & F.col("new").isNotNull()
    return j.select("path", change.alias("change"), F.when(there, before).alias("before"), F.when(there, after).alias("after"))


def canonical_row(df: DataFrame, *columns: str) -> Column:
    """An identity of a row's columns by name, whatever their order; doubles are canonical, other values their text."""
    kinds = dict(df.dtypes)
    return named_id(**{c: canonical(F.col(c)) if kinds[c] == "double" else F.col(c).cast("string") for c in columns or df.columns})


def artifact_id(rows: DataFrame, kind: str, **header: str) -> str:
    """The identity of an artifact: its kind, its header and its rows in any order, such as a profile's features or the values of a reference."""
    members = tree_id(rows.select(canonical_row(rows).alias("digest")))
    return rows.sparkSession.range(1).select(named_id(kind=F.lit(kind), rows=F.lit(members), **{f"header {k}": F.lit(v) for k, v in header.items()}).alias("id")).first()["id"]


def put_artifact(rows: DataFrame, folder: str, kind: str, **header: str) -> str:
    """Writes an artifact under its identity, if it isn't there, and gives the identity. What is written again is the same."""
    name = artifact_id(rows, kind, **header)
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{kind}/{name}")
    return name


def load_artifact(spark, folder: str, kind: str, name: str, **header: str) -> DataFrame:
    """The artifact of an identity, derived again from what was read: any other content raises."""
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{kind}/{name}")
    found = artifact_id(rows, kind, **header)
    if found != name:
        raise Mismatch(f"{kind} {name} reads as {found}")
    return rows


def rebound(reference: DataFrame, profile: str, snapshot: str) -> DataFrame:
    """A reference's rows bound to a profile and the snapshot it was measured on."""
    return reference.withColumns({"profile_id": F.lit(profile), "snapshot_id": F.lit(snapshot)})


def same_binding(artifacts: DataFrame) -> DataFrame:
    """(profile_id, artifacts, bound) of artifacts (kind, id, profile_id, snapshot_id): whether all of a profile's are of one snapshot."""
    return artifacts.groupBy("profile_id").agg(F.count("*").alias("artifacts"), (F.min("snapshot_id").eqNullSafe(F.max("snapshot_id")) & (F.count("snapshot_id") == F.count("*"))).alias("bound"))
