"""Best-fit packing of token sequences by bin completion.

Documents are cut into pieces of at most `capacity` tokens. How many pieces there are of each length is a
table of at most `capacity` counts, whatever the input's size; the driver plans over that table alone. Around
the longest length left it lists the fillings that no other dominates, takes the one of least waste as often
as the counts allow, and branches over the next best ones as long as the lower bound on sequences leaves
something to gain; a best-fit solution is the first incumbent. A dive down a branch always ends in a solution,
unless the bound shows that it gains nothing: where the budget of steps is spent, best fit packs what is left.
The plan then deals ranks of pieces within
their length to places in sequences. Ranks are made by length and one of `spread` shares, so that a length
that a third of all pieces have is ranked by many tasks.

Defined results: a null text is empty (only the end id); rows that share a doc_id, null ones too, are packed
each on its own; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize, table, text_of
from .neardup import slices
from .tokens import encoder, sound

CAPACITY, SPREAD = 2048, 64
#: Branches that the search may dive down and fillings that a node may try; steps of all dives together. A dive takes about
#: a step for each length that occurs.
NODES, BRANCHES, STEPS = 500, 3, 2 * CAPACITY


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: for every k, the pieces over half, and what pieces from k to half can't put beside those of up to capacity - k."""
    size = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * size)
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2
    n1, n2 = number[-1] - number[capacity - k], number[capacity - k] - number[half]
    room = n2 * capacity - (total[capacity - k] - total[half])
    small = total[half] - total[np.maximum(k - 1, 0)]
    return int((n1 + n2 + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Steps (lengths of a sequence, times): around the longest length left, always the longest that still fits."""
    left, steps = counts.astype(np.int64).copy(), []
    present = [n for n in range(1, capacity + 1) if left[n]]
    while present:
        items, room, used = [], capacity, {}
        while room:
            k = bisect_right(present, room) - 1
            while k >= 0 and left[present[k]] - used.get(present[k], 0) <= 0:
                k -= 1
            if k < 0:
                break
            n = present[k]
            items.append(n)
            used[n] = used.get(n, 0) + 1
            room -= n
        times = min(int(left[n]) // q for n, q in used.items())
        for n, q in used.items():
            left[n] -= q * times
        present = [n for n in present if left[n]]
        steps.append((tuple(items), times))
    return steps


def fillings(left: np.ndarray, largest: int, capacity: int, limit: int = BRANCHES) -> list[tuple[int, ...]]:
    """Undominated fillings (of up to three more pieces, then best fit) around the largest length, least waste first."""
    room = capacity - largest
    have = left.copy()
    have[largest] -= 1
    lengths = np.flatnonzero(have[: room + 1])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return [()]
    if have[room] > 0:
        return [(room,)]  # one piece that fills all: every other filling can be packed into its place
    one = int(lengths[-1])
    found = {(one,): room - one}
    # pairs: with each x the largest y that still fits; a pair no larger than the single piece is dominated by it
    x = lengths[::-1][:512]
    y = lengths[np.maximum(np.searchsorted(lengths, np.minimum(room - x, x), "right") - 1, 0)]
    fits = (x + y <= room) & ((x != y) | (have[x] > 1)) & (x + y > one)
    for a, b in zip(x[fits].tolist(), y[fits].tolist(), strict=True):
        found[(a, b)] = room - a - b
    pairs = sorted((k for k in found if len(k) == 2), key=lambda k: (found[k], -k[0]))[:16]
    if not pairs or found[pairs[0]]:
        for a in x[:48].tolist():
            rest = room - a
            ys = lengths[lengths <= min(rest, a)][::-1][:48]
            if not len(ys):
                continue
            zs = lengths[np.maximum(np.searchsorted(lengths, np.minimum(rest - ys, ys), "right") - 1, 0)]
            for b, c in zip(ys.tolist(), zs.tolist(), strict=True):
                k = (a, b, c)
                if a + b + c <= room and all(have[n] >= k.count(n) for n in k) and a + b + c > one:
                    found[k] = room - a - b - c
    ranked = sorted(found, key=lambda k: (found[k], len(k), tuple(-n for n in k)))[: limit * 4]
    out, best = [], found[ranked[0]]
    for k in ranked:
        # a filling is dominated if it has as many pieces as one before it and none of them is longer
        if len(out) < limit and found[k] <= best + 8 and not any(len(o) == len(k) and all(p >= q for p, q in zip(o, k, strict=True)) for o in out):
            used = have.copy()
            for n in k:
                used[n] -= 1
            full, space = list(k), found[k]
            while space:
                more = np.flatnonzero(used[: space + 1])
                more = more[more > 0]
                if not len(more):
                    break
                full.append(int(more[-1]))
                used[more[-1]] -= 1
                space -= int(more[-1])
            out.append(tuple(full))
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Steps (lengths of a sequence, times) that use all counts in as few sequences as the search finds."""
    counts = np.asarray(counts, np.int64)
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    most = sum(t for _, t in best)
    if most == least:
        return best
    stack, dives, visited = [(counts.copy(), 0, ())], 0, 0
    # a chain of (step, times, chain before) keeps a branch's steps without copying them
    while stack and dives < nodes and visited < steps and most > least:
        left, used, chain = stack.pop()
        dives += 1
        while used + lower_bound(left, capacity) < most:
            present = np.flatnonzero(left)
            if not len(present) or visited >= steps:
                rest = best_fit(left, capacity)
                used += sum(t for _, t in rest)
                if used < most:
                    most, best = used, rest
                    while chain:
                        step, times, chain = chain
                        best.append((step, times))
                break
            visited += 1
            largest = int(present[-1])
            ways = fillings(left, largest, capacity)
            for other in ways[:0:-1]:
                if len(stack) < 64:
                    after, times = _taken(left, (largest, *other))
                    stack.append((after, used + times, ((largest, *other), times, chain)))
            step = (largest, *ways[0])
            left, times = _taken(left, step)
            used, chain = used + times, (step, times, chain)
    return best


def _taken(left: np.ndarray, step: tuple[int, ...]) -> tuple[np.ndarray, int]:
    uses = np.bincount(step, minlength=len(left))
    at = np.flatnonzero(uses)
    times = int((left[at] // uses[at]).min())
    return left - uses * times, times


def places(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the first ranks of its runs, and each run's first sequence and offset, as arrays."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for items, times in steps:
        offset = 0
        for n in items:
            runs.setdefault(n, []).append((used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        base += times
    return {n: tuple(np.asarray(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, spread: int = SPREAD) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity. The rows should be those of a written table."""
    dealt = pieces.withColumn("_share", F.pmod(F.xxhash64(*[c for c in pieces.columns if c in ("doc_id", "piece", "start", "ids_crc32")]), F.lit(spread)).cast("int"))
    counts = np.zeros((capacity + 1, spread), np.int64)
    for row in dealt.groupBy("length", "_share").count().toLocalIterator():  # at most capacity * spread rows
        counts[row[0], row[1]] = row[2]
    where, before = places(plan(counts.sum(1), capacity)), np.cumsum(counts, 1) - counts
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_share").orderBy(*order)))
    names = list(pieces.columns)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, share, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_share", "_rank"))
            rank = before[length, share] + rank - 1
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                of = length == n
                first, base, at = where[int(n)]
                k = np.searchsorted(first, rank[of], "right") - 1
                sequence[of], offset[of] = base[k] + rank[of] - first[k], at[k]
            columns = [batch.column(f) for f in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(lean(placed), schema)


def cut(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, in pieces of which the first may be shorter."""

    fast = sound(path)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        by, end = encoder(path, fast), np.asarray([end_id], "<u4")
        for batch in slices(batches):
            ids, per = by.encode(batch.column(1).to_pylist())
            ids = ids.astype("<u4")
            out: list[tuple[int, int, int, int, int]] = []
            at = 0
            for i, n in enumerate(per.tolist()):
                own = np.concatenate([ids[at : at + n], end])
                at += n
                cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                out += [(i, k, a, b - a, zlib.crc32(own[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            rows, piece, start, length, crc = zip(*out, strict=True) if out else ([],) * 5
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(lean(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(cut(docs, path, capacity=capacity), "pieces"), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
