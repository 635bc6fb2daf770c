"""Near-duplicate detection by b-bit MinHash, confirmed on full shingle sets.

A document's set holds its distinct word shingles (`width` words each; a shorter document's whole sequence
counts as one), words being runs of other than ASCII white space after lower-casing A-Z. Two documents are
linked if their sets' Jaccard similarity is at least `percent` / 100; a document's component holds all that
links reach. Steps:

1. One pass over the texts makes each set's 128-bit digest, MINIMA hash minima, and of each minimum its low
   BITS bits, packed. Documents of equal sets form a class, which its smallest doc_id stands for.
2. Sets of 8 and more shingles meet in BANDS bands of ROWS minima: a pair at 0.8 shares no band with a
   probability of (1 - 0.8^8)^64 = 8e-6. Linked sets whose union is below 10 differ in one shingle, so small
   sets meet, exactly, under the keys of themselves and of themselves less one shingle.
3. Each bucket has one hub. One order picks the hubs of all buckets: the class that shares most buckets of the
   first CENTRAL bands with others comes first, so that a group of copies names the few that lie in its middle.
   A class is paired with its buckets' hubs only, which makes a few pairs a class however large its group is.
   Pairs whose estimated similarity (bit counts, corrected for chance agreement) is below the threshold by over
   six standard errors go; the rest are confirmed on full sets, each class's most similar pair first, the
   others only if their ends are still in different components.
4. What is left are classes that met a hub but aren't in its component ("far" ones). Let D be a set's
   difference from the hub's (what it adds and what it lacks). Two sets x, y are linked just if
   |x ^ y| <= c (|x| + |y|), c = (1 - J) / (1 + J), and |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|, so that a link
   asks for an overlap of t = (|Dx| + |Dy| - c (|x| + |y|)) / 2. As a far x has |Dx| > c (|x| + |hub|), that
   is over half of Dy, about. So classes that share a hub are joined on the rarest elements of D alone (a
   prefix filter, whose length follows from t, with t checked by position): no link is lost, and copies that
   differ from the hub in ways of their own are not paired with each other.

Hot buckets, classes and components meet in joins of written tables, whose partitions adaptive execution
splits. Nothing about documents is collected.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with
nothing; rows that share a doc_id are one node, linked if any of its texts is; rows without a doc_id get a
null component and are kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, lean, materialize, table, text_of

BANDS, ROWS, MINIMA, BITS = 64, 8, 512, 2
#: An estimate this far below the threshold rules a pair out: over six standard errors.
MARGIN = 0.14
#: Bands whose bucket sizes say how central a class is.
CENTRAL = 8
SMALL = 8
#: Ranks of a key: a small set's own, a small set's less one shingle, a band's.
WHOLE, LESS_ONE, BAND = 0, 1, 2
_draw = np.random.default_rng(20240229)
_A = (_draw.integers(0, 1 << 31, MINIMA, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _draw.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = []


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, after lower-casing A-Z, and where each text's words end."""
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    ends_of = np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws)))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers_of(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return _mix((total[end] - total[start]) * down[start]), np.searchsorted(start, ends_of)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; all words of the texts are hashed in one go."""
    word, upto = hashed_words(texts)
    out, low = [], 0
    for high in upto.tolist():
        n, w = high - low, word[low:high]
        low = high
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        k = min(width, n)
        s = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            s = _mix(s + w[j : n - k + 1 + j] * np.uint64(2 * j + 3) + np.uint64(k))
        out.append(np.unique(s))
    return out


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (x[at : at + 512, None] * _A + _B).min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima as BITS planes of MINIMA / 64 words each."""
    mixed = _mix(low.astype(np.uint64) + (np.arange(MINIMA, dtype=np.uint64) << np.uint64(32)))
    return np.concatenate([np.packbits(((mixed >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for b in range(BITS)])


def keys_of(s: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ranks), bands first."""
    keys, ranks = [], []
    n = len(s)
    if n >= SMALL:
        rows = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        k = np.arange(BANDS, dtype=np.uint64)
        for j in range(ROWS):
            k = _mix(k * np.uint64(_BASE) + rows[:, j])
        keys.append(k)
        ranks.append(np.full(BANDS, BAND, np.int32))
    if 4 <= n <= 9:
        whole = s.sum(dtype=np.uint64)
        if n <= 8:
            keys.append(_mix(np.asarray([whole + np.uint64(n)])))
            ranks.append(np.full(1, WHOLE, np.int32))
        if n >= 5:
            keys.append(_mix(whole - s + np.uint64(n - 1)))
            ranks.append(np.full(n, LESS_ONE, np.int32))
    return (np.concatenate(keys).view(np.int64), np.concatenate(ranks)) if keys else (np.empty(0, np.int64), np.empty(0, np.int32))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _digest(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)


def slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // size, prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, da, db, keys, ranks, planes) of each row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            lows = [minima(s) for s in sets]
            keys, ranks = zip(*map(keys_of, sets, lows), strict=True)
            digests = np.stack([_digest(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), _lists(list(keys), pa.int64()), _lists(list(ranks), pa.int32()), _lists([packed(x) for x in lows], pa.int64())],
                names=["doc_id", "n", "da", "db", "keys", "ranks", "planes"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(lean(signed), "doc_id long, n long, da long, db long, keys array<long>, ranks array<int>, planes array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the rows whose doc_id is an id."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets, pa.int64())], names=["id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).join(ids, "id", "left_semi")
    return rows.mapInArrow(lean(made), "id long, shingles array<long>")


def _estimate(a: str, b: str) -> Column:
    """Similarity from the share of minima whose kept bits agree, less what chance makes agree."""
    words = MINIMA // 64
    agree = F.lit(0)
    for w in range(words):
        differ = F.lit(0).cast("long")
        for bit in range(BITS):
            i = bit * words + w
            differ = differ.bitwiseOR(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
        agree = agree + (64 - F.bit_count(differ))
    chance = 2.0**-BITS
    return (agree / float(MINIMA) - chance) / (1 - chance)


def _classes(signed: DataFrame) -> DataFrame:
    """(da, db, id, n, keys, ranks, planes, order) of each distinct set; hubs are the least by order, id."""
    named = signed.where("n > 0 and doc_id is not null")
    some = named.where(F.col("n") >= SMALL).select("da", "db", F.explode(F.slice("keys", 1, CENTRAL)).alias("key"))
    sizes = some.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    central = some.join(sizes, "key").groupBy("da", "db").agg((-F.sum("size")).alias("order"))
    classes = named.groupBy("da", "db").agg(F.min(F.struct("doc_id", "n", "keys", "ranks", "planes")).alias("c"))
    classes = classes.join(central, ["da", "db"], "left")
    return classes.select("da", "db", F.col("c.doc_id").alias("id"), "c.n", "c.keys", "c.ranks", "c.planes", F.coalesce("order", F.lit(0)).alias("order"))


def _stars(classes: DataFrame) -> DataFrame:
    """(hub, id, band) of every class that meets a hub; band: in a band's bucket."""
    zipped = F.explode(F.arrays_zip("keys", "ranks")).alias("k")
    buckets = classes.select("id", "order", zipped).select(F.col("k.keys").alias("key"), F.col("k.ranks").alias("rank"), "order", "id")
    # a small set's bucket without the set itself has no links
    hubs = buckets.groupBy("key").agg(F.min(F.struct("rank", "order", "id")).alias("f"), F.count("*").alias("size"))
    hubs = hubs.where(f"size > 1 and f.rank <> {LESS_ONE}").select("key", F.col("f.id").alias("hub"))
    met = buckets.select("key", "id", (F.col("rank") == BAND).alias("band")).join(hubs, "key").where("id <> hub")
    return met.groupBy("hub", "id").agg(F.max("band").alias("band"))


def _differences(far: DataFrame, near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, element, id, n, root, far, d, at, own) of the rarest elements of each set's difference from its hub's.

    at: the element's place by rarity; own: it is in the prefix that any link with a far set must meet."""
    p = percent / 100
    c = (1 - p) / (1 + p)
    rows = far.withColumn("far", F.lit(True)).unionByName(near.withColumn("far", F.lit(False)))
    both = rows.join(sets.select("id", F.col("shingles").alias("s")), "id").join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("h")), "hub")
    both = both.select("hub", "id", "root", "far", F.size("s").alias("n"), F.size("h").alias("m"), F.concat(F.array_except("s", "h"), F.array_except("h", "s")).alias("es"))
    each = materialize(both.select("hub", "id", "root", "far", "n", "m", F.size("es").alias("d"), F.explode("es").alias("e")), "differences")
    often = each.groupBy("hub", "e").agg(F.count("*").alias("often")).where("often > 1")
    by_rarity = Window.partitionBy("hub", "id").orderBy(F.coalesce("often", F.lit(1)), "e")
    placed = each.join(often, ["hub", "e"], "left").withColumn("at", F.row_number().over(by_rarity) - 1).where("often > 1")
    least = F.greatest(F.lit(1), F.floor((F.col("d") + c * (F.col("m") - F.col("n"))) / 2 - 1e-9) + 1)
    wide = F.greatest(F.lit(1), F.ceil(F.col("d") - c * (1 + 1 / p) * F.col("n") - 1e-9))
    placed = placed.withColumn("own", F.col("at") <= F.col("d") - least)
    kept = placed.where(F.col("own") | (F.col("far") & (F.col("at") <= F.col("d") - wide)))
    return materialize(kept.select("hub", "e", "id", "n", "root", "far", "d", "at", "own"), "prefixes")


def _overlapping(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets in different components whose differences from a hub's may overlap as much as a link asks for."""
    p = percent / 100
    c = (1 - p) / (1 + p)
    x = placed.where("far")
    y = placed.where("own").select("hub", "e", *[F.col(k).alias(f"{k}2") for k in ("id", "n", "root", "far", "d", "at")])
    asked = (F.col("d") + F.col("d2") - c * (F.col("n") + F.col("n2"))) / 2 - 1e-9
    fits = (F.least(F.col("d") - F.col("at"), F.col("d2") - F.col("at2")) >= asked) & _sized("n", "n2", percent) & (F.col("root") != F.col("root2"))
    apart = x.where("own").join(y.where("far2"), ["hub", "e"]).where(fits & (F.col("id") < F.col("id2")))
    mixed = x.join(y.where("not far2"), ["hub", "e"]).where(fits)
    pairs = apart.select("id", "id2").unionByName(mixed.select("id", "id2"))
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _sized(x: str, y: str, percent: int) -> Column:
    return F.expr(f"100L * least({x}, {y}) >= {percent}L * greatest({x}, {y})")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    with_b = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    with_a = with_b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    common = with_a.select("a", "b", (F.size("sa") + F.size("sb")).alias("both"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return common.where(f"100L * common >= {percent}L * (both - common)").select("a", "b")


def _across(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs, with ra and rb, whose ends are in different components so far."""
    if roots is None:
        return pairs.withColumns({"ra": F.col("a"), "rb": F.col("b")})
    named = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    return named.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")


def _joined(roots: DataFrame | None, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after the links, which are among the pairs."""
    met = links.join(pairs.select("a", "b", "ra", "rb"), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")) if roots is not None else links
    grown = materialize(connected_components(met), "grown")
    if roots is None:
        return grown
    kept = roots.join(grown.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = grown.join(roots, "node", "left_anti")
    return materialize(kept.unionByName(fresh), "roots")


def _confirmed(pairs: DataFrame, sets: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame | None:
    """Components after the pairs: each b's most similar pair first, then all that still join two components."""
    if pairs.isEmpty():
        return roots
    best = pairs.groupBy("b").agg(F.max(F.struct("estimate", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    best = materialize(_across(best, roots), "best")
    roots = _joined(roots, best, _linked(best, sets, percent))
    rest = materialize(_across(pairs.join(best, ["a", "b"], "left_anti"), roots), "rest")
    return roots if rest.isEmpty() else _joined(roots, rest, _linked(rest, sets, percent))


def _near(pairs: DataFrame, planes: DataFrame, percent: int) -> DataFrame:
    """(a, b, estimate) of the pairs with an estimate that doesn't rule a link out."""
    other = planes.select(F.col("id").alias("a"), F.col("planes").alias("pa"))
    both = pairs.join(planes.select(F.col("id").alias("b"), F.col("planes").alias("pb")), "b").join(other, "a")
    return both.select("a", "b", _estimate("pa", "pb").alias("estimate")).where(F.col("estimate") >= percent / 100 - MARGIN)


def _ids(rows: DataFrame) -> DataFrame:
    """The ids that the rows' hub and id columns name, in a written table: small ones are broadcast, large ones aren't."""
    return materialize(rows.select("id").unionByName(rows.select(F.col("hub").alias("id"))).distinct(), "ids")


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row. The keys by which rows meet lose no link from 80 percent up; less is refused."""
    if percent < 80:
        raise ValueError(f"percent: {percent}, at least 80")
    signed = materialize(signatures(docs, width), "signatures")
    classes = materialize(_classes(signed), "classes")
    planes, size = classes.select("id", "planes"), classes.select("id", "n")
    stars = materialize(_stars(classes), "stars")
    sets = materialize(full_sets(docs, _ids(stars), width), "sets", "none")

    sides = stars.join(size, "id").join(size.select(F.col("id").alias("hub"), F.col("n").alias("m")), "hub").where(_sized("n", "m", percent))
    pairs = materialize(_near(sides.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct(), planes, percent), "pairs")
    roots = _confirmed(pairs, sets, None, percent)

    # classes that aren't in their hub's component
    met = stars.where("band").select("hub", "id")
    if roots is not None:
        met = met.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
        met = met.select("hub", "id", F.coalesce("root", "id").alias("root"), F.coalesce("hub_root", "hub").alias("hub_root"))
    else:
        met = met.select("hub", "id", F.col("id").alias("root"), F.col("hub").alias("hub_root"))
    met = materialize(met, "met")
    far, near = met.where("root <> hub_root").select("hub", "id", "root"), met.where("root = hub_root").select("hub", "id", "root")
    placed = _differences(far, near.join(far.select("hub").distinct(), "hub", "left_semi"), sets, percent)
    crossing = materialize(_overlapping(placed, percent), "crossing")
    roots = _confirmed(materialize(_near(crossing, planes, percent), "near"), sets, roots, percent)

    of_class = classes.select("da", "db", "id")
    if roots is not None:
        of_class = of_class.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("da", "db", F.coalesce("root", "id").alias("component"))
        of_class = materialize(of_class.groupBy("da", "db").agg(F.min("component").alias("component")), "components")
    else:
        of_class = of_class.withColumnRenamed("id", "component")
    out = signed.select("doc_id", "n", "da", "db").join(of_class, ["da", "db"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), width=2, percent=80)


OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM t),
s AS (SELECT doc_id, unnest(s) AS sh FROM d),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN d a ON a.doc_id = x JOIN d b ON b.doc_id = y WHERE 100 * c >= 80 * (len(a.s) + len(b.s) - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS src, doc_id AS dst FROM d UNION SELECT src, y FROM r JOIN e ON dst = x),
m AS (SELECT src, min(dst) AS component_id FROM r GROUP BY src)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m ON src = doc_id
"""
