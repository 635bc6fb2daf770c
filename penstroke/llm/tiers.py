"""Packing into context sizes of several tiers.

Documents go to the tier of the smallest context size that holds them whole; longer ones than the largest size are cut into
full windows first. Tiers are packed from the largest down: a window opens with the longest document left in its tier, and its gap is filled with
the longest documents that fit, those of shorter tiers. What gap remains takes the head of another document, of a shorter tier if there is one,
and the document's rest goes to the tier of its new length. So every window is full. A task packs its documents in
portions of a bounded number of tokens as it reads them; what stays open at a portion's end is packed with the next one, and at the task's end its
tokens fill windows of falling powers of two. Nothing is shuffled but a short row for each piece and sequence.

Step groups have sequences of one size and the same number of tokens, one sequence more or less. Sequences of a size are ranked by the
attention that they cost (squares of the pieces' lengths) and dealt to groups to and fro, which balances that cost too.

Defined results: a null or empty text has the end id alone; rows that share a doc_id, null ones too, are packed each on its own; an
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, table, text_of
from .neardup import slices
from .tokens import encoder, sound

TIERS = (2048, 1024, 512, 256)
#: Tokens that a task packs at once, and tokens of a step group.
PORTION, STEP = 4 << 20, 64 << 10
ROW = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cost long"
Part = tuple[int, int, int]


class Shelves:
    """Documents by their length; longest(n) is the greatest length up to n, 0 if there is none."""

    def __init__(self, most: int):
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
        self.present = 0

    def put(self, document: int, at: int, length: int) -> None:
        if length:
            self.by_length[length].append((document, at))
            self.present |= 1 << length

    def longest(self, n: int) -> int:
        return max((self.present & ((2 << n) - 1)).bit_length() - 1, 0)

    def take(self, length: int) -> tuple[int, int]:
        shelf = self.by_length[length]
        out = shelf.pop()
        if not shelf:
            self.present &= ~(1 << length)
        return out


def packed_tiers(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Part]]], list[Part]]:
    """(full windows (size, parts), parts that fill none) of documents of up to the largest size. A part is (document, place in it, length)."""
    shelves, windows = Shelves(tiers[0]), []
    for i in range(len(lengths) - 1, -1, -1):
        shelves.put(i, 0, lengths[i])
    for size, shorter in zip(tiers, (*tiers[1:], 0), strict=True):
        while (n := shelves.longest(size)) > shorter:
            window, room = [(*shelves.take(n), n)], size - n
            while room:
                if k := shelves.longest(room):
                    window.append((*shelves.take(k), k))
                    room -= k
                elif k := shelves.longest(shorter) or shelves.longest(size):
                    document, at = shelves.take(k)
                    window.append((document, at, room))
                    shelves.put(document, at + room, k - room)
                    room = 0
                else:
                    return windows, window
            windows.append((size, window))
    return windows, []


def falling_powers(parts: list[Part]) -> list[tuple[int, list[Part]]]:
    """Windows of falling powers of two that hold all tokens of the parts."""
    left, windows, queue = sum(n for *_, n in parts), [], list(reversed(parts))
    while left:
        size = 1 << (left.bit_length() - 1)
        window, room = [], size
        while room:
            document, at, n = queue.pop()
            if n > room:
                queue.append((document, at + room, n - room))
                n = room
            window.append((document, at, n))
            room -= n
        windows.append((size, window))
        left -= size
    return windows


def tiered(docs: DataFrame, path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, portion: int = PORTION) -> DataFrame:
    """A row for each piece, with its sequence, the tokens of that sequence and the attention that it costs."""
    fast, top = sound(path), tiers[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        by, end = encoder(path, fast), np.asarray([end_id], "<u4")
        number = TaskContext.get().partitionId() << 33
        # documents or their parts: doc_id, tokens of the whole document, place in it, ids
        held: list[tuple[int | None, int, int, np.ndarray]] = []

        def rows(windows: list[tuple[int, list[Part]]]) -> pa.RecordBatch:
            nonlocal number
            out = []
            for size, parts in windows:
                offset, cost = 0, sum(n * n for *_, n in parts)
                for i, at, n in parts:
                    doc_id, tokens, start, ids = held[i]
                    out.append((doc_id, start + at, n, zlib.crc32(ids[at : at + n]), tokens, number, offset, size, cost))
                    offset += n
                number += 1
            columns = zip(*out, strict=True) if out else ([] for _ in range(9))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[f.split()[0] for f in ROW.split(", ")])

        def packed() -> pa.RecordBatch:
            windows, rest = packed_tiers([len(ids) for *_, ids in held], tiers)
            out = rows(windows)
            held[:] = [(held[i][0], held[i][1], held[i][2] + at, held[i][3][at : at + n].copy()) for i, at, n in rest]
            return out

        waiting = 0
        for batch in slices(batches):
            ids, per = by.encode(batch.column(1).to_pylist())
            ids, stop = ids.astype("<u4"), np.cumsum(per)
            whole = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), (stop - per).tolist(), stop.tolist(), strict=True):
                own = np.concatenate([ids[a:b], end])
                cut = len(own) - len(own) % top
                whole += [(doc_id, len(own), at, own[at : at + top]) for at in range(0, cut, top)]
                if cut < len(own):
                    held.append((doc_id, len(own), cut, own[cut:]))
                    waiting += len(own) - cut
            if whole:
                before, held[:] = held[:], whole
                out = rows([(top, [(i, 0, top)]) for i in range(len(whole))])
                held[:] = before
                yield out
            if waiting >= portion:
                yield packed()
                waiting = sum(len(ids) for *_, ids in held)
        yield packed()
        yield rows(falling_powers([(i, 0, len(ids)) for i, (*_, ids) in enumerate(held)]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(lean(run), ROW)


def step_groups(pieces: DataFrame, step: int = STEP) -> DataFrame:
    """Adds step_group to a written table of pieces."""
    spark, order = pieces.sparkSession, ["sequence_tokens", "cost", "sequence_id"]
    ranged = pieces.where("offset = 0").select(*order).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("place", F.monotonically_increasing_id()), "sequences").withColumn("part", F.shiftrightunsigned("place", 33))
    # a row for each part and size
    parts = sorted(placed.groupBy("part", "sequence_tokens").agg(F.count("*"), F.min("place")).collect())
    total: dict[int, int] = {}
    ranks = []
    for part, size, n, first in parts:
        ranks.append((part, size, total.get(size, 0) - first))
        total[size] = total.get(size, 0) + n
    groups, base = {}, 0
    for size in sorted(total, reverse=True):
        groups[size] = (base, -(-total[size] * size // step))
        base += groups[size][1]
    starts = spark.createDataFrame([(p, s, r, *groups[s]) for p, s, r in ranks], "part long, sequence_tokens long, shift long, base long, groups long")
    rank = F.col("place") + F.col("shift")
    lap, at = F.floor(rank / F.col("groups")), rank % F.col("groups")
    dealt = placed.join(F.broadcast(starts), ["part", "sequence_tokens"])
    dealt = dealt.select("sequence_id", (F.col("base") + F.when(lap % 2 == 0, at).otherwise(F.col("groups") - 1 - at)).cast("long").alias("step_group"))
    return pieces.join(dealt, "sequence_id").select(*pieces.columns, "step_group")


def op12_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return step_groups(materialize(tiered(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "pieces"))
