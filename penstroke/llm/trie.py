"""Prefix trie of conversations, rolled up by pointer jumping.

A conversation's turns are numbered from 1 by a range sort, so that a conversation of any length spreads over
many tasks. Prefix digests come from doubling: after round j a turn's digest stands for the last 2^(j+1) turns up to it, and the next
round joins it with the digest 2^(j+1) turns before. The shape of what is hashed depends on the turn's number alone, so equal prefixes,
and only these, have equal digests. A node is a digest; its parent edge leads to the digest one turn before.

The rollup doubles in the same way. After round j a node holds the sums over descendants at a distance below 2^(j+1) and its ancestor at
that distance; the next round adds the sums of all nodes that name it as their ancestor. Depth costs a logarithm of rounds. An
ancestor is looked up on the path of the node's smallest member, where each place is one row: no key of a join is frequent, though
a third of all nodes may share a parent.

Defined results: a null role or text is empty; a null turn comes first; turns of equal number go by role and text (by the first 64
characters of the two, then by digest); repeated rows are turns of their own. Rows without a conv_id belong to no conversation.
An empty table has no nodes, not even a root. Extra columns are ignored. c % 5 has the sign of c.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize, table

ROOT = "00"
#: A parent with more than this share of all nodes as children is broadcast: there are fewer than SHARE of them.
SHARE = 1000
#: Positions of a conversation that stand under one key of a join.
BLOCK = 1024


def _hash(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes): each conversation's turns numbered from 1. A written table."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = _hash(F.char_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.left(F.concat(role, F.lit("\0"), text), F.lit(64)).alias("tie"), own.alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    spark = rows.sparkSession
    order = ["conv_id", F.col("turn").asc_nulls_first(), "tie", "digest"]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = materialize(ranged.select("conv_id", "digest", "bytes", F.monotonically_increasing_id().alias("place")), "placed").withColumn("part", F.shiftrightunsigned("place", 33))
    # only the first conversation of a part can have turns in parts before: one row for each part
    parts = placed.groupBy("part", "conv_id").count().groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by("count", "conv_id").alias("n"))
    starts, open_, before = [], None, 0
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        if r["first"] == open_:
            starts.append((r["part"], r["first"], before))
        before = r["n"] + (before if r["first"] == open_ == r["last"] else 0)
        open_ = r["last"]
    start = spark.createDataFrame(starts, "part long, conv_id long, before long")
    within = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("place"))
    met = placed.withColumn("within", within).join(F.broadcast(start), ["part", "conv_id"], "left")
    return materialize(met.select("conv_id", (F.col("within") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "digest", "bytes"), "turns")


def rebuilt(turns: DataFrame, heads: Column | None = None, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """((conv_id, length), (conv_id, pos, length, digest, bytes)): each conversation with its first turns taken from the first of its family.

    heads: how many turns those are, from conv_id, at most 8.
    """
    h = heads if heads is not None else F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "n", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    first = turns.where((F.col("pos") <= 8) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    head = convs.where("taken > 0").join(first, "base").where("pos <= taken").select("conv_id", "pos", "length", "digest", "bytes")
    # a conversation's row stands once for each block of its turns, so that no key holds more than a block
    blocks = convs.where("n > h").select("conv_id", "h", "taken", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK))).alias("block"))
    own = turns.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(blocks, ["conv_id", "block"]).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "length", "digest", "bytes")
    return convs.select("conv_id", "length"), materialize(head.unionByName(own), "rebuilt")


def prefixed(rows: DataFrame, longest: int) -> DataFrame:
    """The rows with the digest of all turns up to theirs in place of their own turn's."""
    done, active, s = [], rows, 1
    while s < longest:
        done.append(active.where(F.col("length") <= s))
        open_ = active.where(F.col("length") > s)
        before = open_.where(F.col("pos") + s <= F.col("length")).select("conv_id", (F.col("pos") + s).alias("pos"), F.col("digest").alias("before"))
        both = F.when(F.col("before").isNull(), F.col("digest")).otherwise(_hash(F.lit("+").cast("binary"), F.col("before"), F.col("digest")))
        active = materialize(open_.join(before, ["conv_id", "pos"], "left").select("conv_id", "pos", "length", both.alias("digest"), "bytes"), "doubled")
        s *= 2
    for part in done:
        active = active.unionByName(part)
    return active


def listed_digests(members: DataFrame) -> DataFrame:
    """(digest, ends_sha256) from (digest, conv_id): a hash of all conv_ids of a digest in order, in decimal with commas between.

    Ids are sorted by range, so that a digest of many members spreads over tasks, which join their runs into strings; one task a digest
    hashes these strings as they pass and holds no more than one of them.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [i for i in range(len(ids)) if not i or digest[i] != digest[i - 1]]
            runs = list(zip(cuts, [*cuts[1:], len(ids)], strict=True))
            columns = [[digest[a] for a, _ in runs], [ids[a] for a, _ in runs], [",".join(map(str, ids[a:b])) for a, b in runs]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["digest", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = digest, hashlib.sha256(ids.encode())
            yield _hashes(out)
        if now is not None:
            yield _hashes([(now, sha.hexdigest())])

    runs = members.repartitionByRange(n, "digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(lean(joined), "digest binary, first long, ids string")
    return runs.repartition(n, "digest").sortWithinPartitions("digest", "first").mapInArrow(lean(hashed), "digest binary, ends_sha256 string")


def _hashes(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["digest", "ends_sha256"])


def rolled_up(nodes: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """(digest, leaves, saved) over whole subtrees, from nodes (digest, conv_id, depth, parent, leaves, saved) and their members' paths."""
    places = paths.select("conv_id", F.col("pos").alias("place"), F.col("digest").alias("ancestor"), (F.col("length") - F.col("pos")).alias("room"))
    state, s = nodes.select("digest", "conv_id", "depth", F.col("parent").alias("ancestor"), "leaves", "saved"), 1
    while s <= longest:
        sums = state.where("ancestor is not null").groupBy(F.col("ancestor").alias("digest")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        state = state.drop("ancestor").join(sums, "digest", "left")
        state = state.select("digest", "conv_id", "depth", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")], (F.col("depth") - 2 * s).alias("place"))
        columns = ["digest", "conv_id", "depth", "ancestor", "leaves", "saved"]
        # only nodes deep enough for an ancestor below the root look it up
        found = state.where("place > 0").join(places.where(F.col("room") >= 2 * s).drop("room"), ["conv_id", "place"], "left").select(columns)
        rest = state.where("place <= 0").withColumn("ancestor", F.when(F.col("place") == 0, F.unhex(F.lit(ROOT)))).select(columns)
        state = materialize(found.unionByName(rest), "jumped")
        s *= 2
    return state.select("digest", "leaves", "saved")


def prefix_trie(conversations: DataFrame, heads: Column | None = None, family: int = 5) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    convs, rows = rebuilt(numbered_turns(conversations), heads, family)
    longest = convs.agg(F.max("length")).first()[0] or 0
    paths, root = materialize(prefixed(rows, longest), "paths"), F.unhex(F.lit(ROOT))
    nodes = paths.groupBy("digest", F.col("pos").alias("depth")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = materialize(nodes.unionByName(top.select(root.alias("digest"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"))), "nodes")
    # parent edges: the digest one turn before on the smallest member's path
    above = paths.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("digest").alias("above"))
    parent = F.when(F.col("depth") == 1, root).otherwise(F.col("above"))
    edges = materialize(nodes.join(above, ["conv_id", "depth"], "left").select("digest", "depth", "conv_id", "n_convs", "bytes", parent.alias("parent")), "edges")
    children = edges.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    known = edges.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = materialize(known.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "known")
    total = rolled_up(known, paths, longest)
    ends = paths.where("pos = length").select("digest", "conv_id").unionByName(convs.where("length = 0").select(root.alias("digest"), "conv_id"))
    # a parent of many children is broadcast, the others are met by key
    most = known.count() // SHARE
    parents = known.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = parents.where(F.col("n_children") > most).drop("n_children").withColumnRenamed("parent_conv_id", "hot_conv_id")
    marked = known.drop("leaves", "saved", "bytes").join(F.broadcast(hot), "parent", "left")
    rest = parents.where((F.col("n_children") <= most) & (F.col("n_children") > 0)).drop("n_children")
    cold = marked.where("hot_conv_id is null and parent is not null").join(rest, "parent", "left")
    warm = marked.where("hot_conv_id is not null or parent is null").withColumn("parent_conv_id", F.col("hot_conv_id"))
    out = cold.unionByName(warm).join(total, "digest").join(listed_digests(ends), "digest", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# crc32 bit by bit; subtrees by listing every node under each of its prefixes
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT conv_id, count(*) AS n, conv_id::VARCHAR AS s FROM t GROUP BY conv_id),
digits AS (
  SELECT conv_id, s, n, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i::INT, 1))::BIGINT) AS codes FROM n
), hashed AS (
  SELECT conv_id, n, xor(list_reduce(list_prepend(4294967295::BIGINT, codes), lambda acc, b:
    list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda z: z::BIGINT)), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 9 AS h
  FROM digits
), c AS (
  SELECT a.conv_id, a.conv_id - a.conv_id % 5 AS base, a.h, least(a.h, coalesce(b.n, 0)) AS taken FROM hashed a LEFT JOIN hashed b ON b.conv_id = a.conv_id - a.conv_id % 5
), r AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + c.taken, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), p AS (
  SELECT conv_id, pos, strlen(text) AS bytes, string_agg(sha256(length(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), last AS (SELECT conv_id, max_by(path, pos) AS path FROM p GROUP BY conv_id),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e FROM last GROUP BY path),
nodes AS (SELECT path, pos AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY path, pos),
kids AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(k.k, 0) AS k FROM nodes n LEFT JOIN kids k ON k.path = n.path),
under AS (
  SELECT left(path, 64 * d) AS path, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM own) GROUP BY 1
)
SELECT own.conv_id::BIGINT AS conv_id, own.depth::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, own.n_convs::BIGINT AS n_convs, own.k::BIGINT AS n_children,
  under.leaves::BIGINT AS n_leaves, under.saved::BIGINT AS saved_tokens, coalesce(ends.e, sha256('')) AS ends_sha256
FROM own JOIN under ON under.path = own.path LEFT JOIN nodes up ON own.depth > 0 AND up.path = left(own.path, 64 * (own.depth - 1)) LEFT JOIN ends ON ends.path = own.path
"""
