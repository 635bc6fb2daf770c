"""Artifacts as tables: immutable puts, heads, verified reads, rehydration and reachability pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import materialize

VERSION = 1
HEX = "^[0-9a-f]{64}$"


class Conflict(ValueError):
    """A put of an id that is stored with other content."""


class Store:
    """Named tables under one folder, a row per artifact or child; a newer or foreign folder is refused."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        if self._has("_version"):
            version = self.load("_version").first()["version"]
            if version > VERSION:
                raise ValueError(f"store of version {version}; this is {VERSION}")
        else:
            spark.createDataFrame([(VERSION,)], "version int").write.parquet(f"{self.folder}/_version")

    def _has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def put(self, name: str, rows: DataFrame, key: str) -> int:
        """Adds the rows whose key is new; equal rows are left, different ones conflict."""
        rows = rows.withColumn("_content", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256))
        if self._has(name):
            old = self.load(name)
            clash = rows.select(key, "_content").join(old.select(key, F.col("_content").alias("_stored")), key).where("_content <> _stored")
            if not clash.isEmpty():
                raise Conflict(f"{name}: an id is stored with other content")
            rows = rows.join(old.select(key), key, "left_anti").select(*old.columns)
        rows = materialize(rows, name)
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(f"{self.folder}/{name}")
        return n


def heads(events: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """The last value of each key; ties by value."""
    return events.groupBy(key).agg(F.max(F.struct(at, value)).alias("m")).select(key, F.col(f"m.{value}").alias(value))


def sole(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, state): the value if a key has one, else none or ambiguous."""
    s = df.groupBy(key).agg(F.countDistinct(value).alias("n"), F.min(value).alias("v"))
    return s.select(key, F.when(F.col("n") == 1, F.col("v")).alias(value), F.when(F.col("n") == 1, "sole").when(F.col("n") == 0, "none").otherwise("ambiguous").alias("state"))


def bad_ids(df: DataFrame, *columns: str) -> DataFrame:
    wrong = None
    for c in columns:
        w = ~F.coalesce(F.col(c).rlike(HEX), F.lit(False))
        wrong = w if wrong is None else wrong | w
    return df.where(wrong)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def gaps(children: DataFrame, parent: str, ordinal: str = "ordinal") -> DataFrame:
    """Parents whose ordinals aren't 0, 1, 2, ... once each, from sums alone."""
    s = children.groupBy(parent).agg(F.count("*").alias("n"), F.countDistinct(ordinal).alias("d"), F.min(ordinal).alias("low"), F.max(ordinal).alias("high"))
    return s.where("low <> 0 or d <> n or high <> n - 1").select(parent)


def verified(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(path, outcome, content): ok, missing, or content-changed against the expected content_hash."""
    j = expected.select("path", "content_hash").join(files.select("path", "content"), "path", "left")
    outcome = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) == F.col("content_hash"), "ok").otherwise("content-changed")
    return j.withColumn("outcome", outcome).select("path", "outcome", F.when(F.col("outcome") == "ok", F.col("content")).alias("content"))


def rehydrated(nodes: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, outcome, text) of nodes (node_id, path, start, length), cut from verified bytes."""
    j = nodes.join(verified(expected, files), "path", "left").withColumn("outcome", F.coalesce("outcome", F.lit("missing")))
    return j.select("node_id", "outcome", F.expr("cast(substring(content, cast(start + 1 as int), cast(length as int)) as string)").alias("text"))


def positional(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """A full join of two ordered lists by place within the key; `matched` is false where one has no partner."""
    w = Window.partitionBy(key).orderBy(order)
    a = left.select(key, F.struct(*left.columns).alias("left"), F.row_number().over(w).alias("place"))
    b = right.select(key, F.struct(*right.columns).alias("right"), F.row_number().over(w).alias("place"))
    return a.join(b, [key, "place"], "full").withColumn("matched", F.col("left").isNotNull() & F.col("right").isNotNull())


def reachable(seeds: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(kind, id) that edges (from_kind, from_id, to_kind, to_id) lead to from the seeds, themselves included.

    Each round follows the edges of the last round's finds only, and writes them.
    """
    reached = frontier = materialize(seeds.select("kind", "id").distinct(), "reached")
    for _ in range(rounds):
        step = edges.join(frontier, (F.col("from_kind") == F.col("kind")) & (F.col("from_id") == F.col("id"))).select(F.col("to_kind").alias("kind"), F.col("to_id").alias("id")).distinct()
        frontier = materialize(step.join(reached, ["kind", "id"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def pruned(objects: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The objects (kind, id) that nothing kept leads to."""
    return objects.join(reachable(seeds, edges), ["kind", "id"], "left_anti")


#: The columns of each kind of artifact that pruning reads.
ARTIFACTS = {
    "snapshot": ["id"], "document": ["id", "snapshot_id"], "node": ["id", "document_id"], "profile": ["id", "snapshot_id"], "reference": ["id", "profile_id"], "selection": ["id", "profile_id"],
    "selection_member": ["selection_id", "node_id"], "evaluation": ["profile_id"], "attempt": ["profile_id", "node_id"], "head": ["register", "profile_id"], "threshold": ["id", "profile_id"],
}
#: (table, the kind and column it is reached by, the kind and column it leads to): the eight rules by which what is kept keeps others.
RULES = (
    ("profile", "profile", "id", "snapshot", "snapshot_id"), ("reference", "profile", "profile_id", "reference", "id"), ("selection", "profile", "profile_id", "selection", "id"),
    ("document", "snapshot", "snapshot_id", "document", "id"), ("node", "document", "document_id", "node", "id"), ("node", "node", "id", "document", "document_id"),
    ("document", "document", "id", "snapshot", "snapshot_id"), ("selection_member", "selection", "selection_id", "node", "node_id"),
)
#: Rows that stay with what they belong to.
DEPENDENT = {"head": ("profile", "profile_id"), "threshold": ("profile", "profile_id"), "selection_member": ("selection", "selection_id")}


def kept_artifacts(tables: dict[str, DataFrame], profiles: DataFrame) -> DataFrame:
    """(kind, id) of all that the profiles to keep (id) and the audit rows lead to. A profile that isn't there raises.

    Audit rows (evaluations and attempts) are never pruned, so that the profiles and nodes that they name are seeds too.
    """
    missing = profiles.select("id").join(tables["profile"].select("id"), "id", "left_anti").first()
    if missing is not None:
        raise LookupError(f"no profile {missing['id']}")
    seeds = profiles.select(F.lit("profile").alias("kind"), "id")
    for table, kind, column in (("evaluation", "profile", "profile_id"), ("attempt", "profile", "profile_id"), ("attempt", "node", "node_id")):
        seeds = seeds.unionByName(tables[table].where(F.col(column).isNotNull()).select(F.lit(kind).alias("kind"), F.col(column).alias("id")))
    edges = None
    for table, kind, column, to, target in RULES:
        own = tables[table].select(F.lit(kind).alias("from_kind"), F.col(column).alias("from_id"), F.lit(to).alias("to_kind"), F.col(target).alias("to_id")).where("from_id is not null and to_id is not null")
        edges = own if edges is None else edges.unionByName(own)
    return reachable(seeds, edges)


def prune_artifacts(tables: dict[str, DataFrame], profiles: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without what nothing kept leads to, (kind, removed) of each table that loses rows)."""
    kept = materialize(kept_artifacts(tables, profiles), "kept")
    left, removed = {}, None
    for name, df in tables.items():
        kind, column = DEPENDENT.get(name, (name, "id"))
        if name in ("evaluation", "attempt"):
            left[name] = df
            continue
        own = kept.where(F.col("kind") == kind).select(F.col("id").alias(column))
        left[name] = df.join(own, column, "left_semi").select(*df.columns)
        gone = df.join(own, column, "left_anti").agg(F.lit(name).alias("kind"), F.count("*").alias("removed"))
        removed = gone if removed is None else removed.unionByName(gone)
    return left, removed.where("removed > 0")


def strangers_of_selection(members: DataFrame, nodes: DataFrame, documents: DataFrame, snapshot: str) -> DataFrame:
    """Members (selection_id, node_id) whose node isn't one of the snapshot's (nodes (id, document_id), documents (id, snapshot_id))."""
    own = nodes.join(documents.where(F.col("snapshot_id") == snapshot).select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("node_id"))
    return members.join(own, "node_id", "left_anti")


def inconsistent_parents(children: DataFrame, parents: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, column, child, parent) where a child's copy of its parent's value differs from the parent's, or the parent is missing."""
    j = children.alias("c").join(parents.alias("p"), key, "left")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c.{c}").cast("string").alias("child"), F.col(f"p.{c}").cast("string").alias("parent")) for c in columns])
    return j.select(key, F.explode(each).alias("x")).select(key, "x.*").where(~F.col("child").eqNullSafe(F.col("parent")))
