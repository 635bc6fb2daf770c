"""SentencePiece encoding and decoding by suffix-array matching.

Only the vocabulary and the normaliser are taken from the model file. A batch's normalised texts are cut where two
characters meet that no piece holds side by side, so that no merge crosses such a place; the units between are looked up
in a table. The new ones are joined into one string, whose suffixes are sorted by as many characters as the longest
piece has. A binary search finds every piece's range of suffixes, and so all its occurrences. These edges are
sorted by position and relaxed from left to right, all units side by side: a piece may end a prefix if the prefix before it
ends in a piece with which merging would stop at exactly this pair. By that rule each prefix has one last piece, and the path back
from a unit's end is what merging the whole unit gives. Whether merging stops at a pair follows from how the two
pieces were merged themselves (`fits`). Characters that no piece covers fall back to bytes.

Defined results: a null text is empty and has no ids; rows are encoded each on its own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .neardup import slices
from .tokens import PieceTable, ragged

SPACE = "▁"


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` codes (by doubling: each round sorts by twice as many)."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        k *= 2
        if k < depth:
            step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty_like(rank)
            rank[order] = step
    return order


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, piece) of every occurrence of every piece (rows of codes, padded)."""
    n = len(codes)
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
    padded = np.concatenate([codes, np.zeros(pieces.shape[1] + 1, codes.dtype)])
    for j in range(pieces.shape[1]):
        live = np.flatnonzero((lengths > j) & (low < high))
        want = pieces[live, j]
        ends = []
        for side in (0, 1):  # the first suffix not below, then the first above
            a, b = low[live].copy(), high[live].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) // 2
                c = padded[order[np.minimum(mid, n - 1)] + j]
                right = (c < want) if side == 0 else (c <= want)
                a = np.where(open_ & right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            ends.append(a)
        low[live], high[live] = ends
    count = np.maximum(high - low, 0)
    piece = np.repeat(np.arange(len(pieces)), count)
    at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return order[at], piece


class Pieces:
    """encode(texts) -> list of id arrays; decode(ids) -> text."""

    def __init__(self, path: str, units: int = 1_000_000):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.names = [self.model.id_to_piece(i) for i in range(size)]
        self.byte = {i: int(self.names[i][3:5], 16) for i in range(size) if self.model.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        plain = [i for i in range(size) if not (i in self.byte or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        # single characters first, then pieces in the order in which they are merged
        plain.sort(key=lambda i: (len(self.names[i]) > 1, -self.model.get_score(i), i))
        self.plain = np.asarray(plain)
        self.rank = {self.names[i]: k for k, i in enumerate(plain)}
        self.lengths = np.asarray([len(self.names[i]) for i in plain])
        self.codes = np.zeros((len(plain), int(self.lengths.max())), np.int32)
        for k, i in enumerate(plain):
            self.codes[k, : self.lengths[k]] = [ord(c) for c in self.names[i]]
        self._relate()
        self.table = PieceTable(self._learn, units)

    def merged(self, text: str, to: int = 1) -> list[str]:
        """The text's parts after merging the best pair, the leftmost of equal ones, until none is left or there are `to` parts."""
        parts = list(text)
        while len(parts) > to:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.rank.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s < best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _relate(self) -> None:
        """How each piece was merged, which pairs make a piece, and which characters stand side by side in pieces."""
        n = len(self.plain)
        self.left, self.right, self.own = np.arange(n), np.arange(n), self.lengths == 1
        keys, made, pairs = [], [], set()
        for k, i in enumerate(self.plain.tolist()):
            name = self.names[i]
            pairs.update(zip(name, name[1:], strict=False))
            if len(name) == 1:
                continue
            parts = self.merged(name, 2)
            if len(parts) == 2 and all(x in self.rank for x in parts):
                self.left[k], self.right[k], self.own[k] = self.rank[parts[0]], self.rank[parts[1]], True
            for c in range(1, len(name)):
                a, b = self.rank.get(name[:c]), self.rank.get(name[c:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    made.append(k)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = np.asarray(keys, np.int64)[order], np.asarray(made, np.int64)[order]
        # characters of longer pieces get small numbers; 0 stands for all others
        inside = sorted({c for pair in pairs for c in pair})
        self.small = np.zeros(0x110000, np.int16 if len(inside) < 32000 else np.int32)
        self.small[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.joins = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        for a, b in pairs:
            self.joins[self.small[ord(a)], self.small[ord(b)]] = True
        self.single = np.full(0x110000, -1, np.int32)
        for k in np.flatnonzero(self.lengths == 1).tolist():
            self.single[self.codes[k, 0]] = k

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the string of both pieces leaves them as they are, for each pair.

        Merging goes by rank, so the string passes through states in which the pieces are still in parts. It would leave the
        pair if, in any of these states, the parts that meet in the middle made a piece that ranks before what is merged next."""
        n, result = len(self.plain), np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), n + 1)
        while len(live):
            key = a * n + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == key) & (self.pair_made[at] < limit)
            result[live[crossed]] = False
            # undo the later of the two merges; of equal ones the right one, which comes second
            undo_a = a > b
            can_a, can_b = self.lengths[a] > 1, self.lengths[b] > 1
            first = np.where(undo_a, can_a, ~can_b & can_a)
            second = np.where(undo_a, ~can_a & can_b, can_b)
            limit = np.where(first, a, np.where(second, b + 1, limit))
            a, b = np.where(first, self.right[a], a), np.where(second, self.left[b], b)
            keep = ~crossed & (first | second)
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return result

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units of the text `data`, one after another, and how many each has."""
        size = end - start
        out_unit, out_step, out_id = [], [], []
        lone = np.flatnonzero((size == 1) & (self.single[data[start]] < 0))
        if len(lone):
            for u, c in zip(lone.tolist(), data[start[lone]].tolist(), strict=True):
                got = [self.of_byte[b] for b in chr(c).encode("utf-8", "replace")] if self.of_byte else [self.model.unk_id()]
                out_unit += [u] * len(got)
                out_step += range(-len(got), 0)
                out_id += got
        rest = np.flatnonzero((size > 1) | (self.single[data[start]] >= 0))
        n = size[rest]
        # units end in a zero, which no piece has
        codes = np.zeros(int((n + 1).sum()), np.int32)
        base = np.cumsum(n + 1) - (n + 1)
        codes[np.repeat(base - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = ragged(data, start[rest], n)
        unit, step, ids = [np.asarray(out_unit, np.int64)], [np.asarray(out_step, np.int64)], [np.asarray(out_id, np.int64)]
        if len(rest):
            at, piece = occurrences(codes, suffix_order(codes, self.codes.shape[1]), self.codes, self.lengths)
            use = self.own[piece]
            at, piece = at[use], piece[use]
            stop = at + self.lengths[piece]
            of = np.searchsorted(base, at, "right") - 1
            reach = stop - base[of]
            order = np.argsort(reach, kind="stable")
            at, piece, stop = at[order], piece[order], stop[order]
            last = np.full(len(codes) + 1, -1)
            last[base] = len(self.plain)  # nothing before
            cuts = np.flatnonzero(np.diff(reach[order], prepend=0))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(at)).tolist(), strict=True):
                before, p = last[at[a:b]], piece[a:b]
                ok = before >= 0
                check = np.flatnonzero(ok & (before < len(self.plain)))
                ok[check] = self.fits(before[check], p[check])
                last[stop[a:b][ok]] = p[ok]
            pos, live, k = base + n, np.arange(len(rest)), 0
            while len(live):
                p = last[pos]
                unit.append(rest[live])
                step.append(np.full(len(live), -k))
                ids.append(self.plain[p])
                pos = pos - self.lengths[p]
                more = pos > base[live]
                live, pos, k = live[more], pos[more], k + 1
        unit, step, ids = np.concatenate(unit), np.concatenate(step), np.concatenate(ids)
        order = np.lexsort((step, unit))
        return ids[order].astype(np.uint32), np.bincount(unit, minlength=len(start))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        normal = [self.model.normalize(t) if t else "" for t in texts]
        # each text is followed by a zero that belongs to no unit
        data = np.frombuffer("".join(x + "\0" for x in normal).encode("utf-32-le", "surrogatepass"), np.int32)
        if not len(data):
            return []
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in normal), np.int64, len(normal))) - 1
        kind = self.small[data]
        kind[ends] = 0
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ~self.joins[kind[:-1], kind[1:]]
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        inside = np.ones(len(start), bool)
        inside[np.searchsorted(start, ends)] = False
        ids, per, bad = self.table.find(data, start[inside], end[inside], ends)
        out = np.split(ids, np.cumsum(per)[:-1])
        for i in bad.tolist():
            low = 0 if i == 0 else ends[i - 1] + 1
            own = inside & (start >= low) & (start < ends[i])
            out[i] = self._learn(data, start[own], end[own])[0]
        return out

    def decode(self, ids: np.ndarray) -> str:
        out, run = [], bytearray()
        if not self.byte or not np.isin(ids, list(self.byte)).any():
            out = [self.names[i] for i in ids.tolist()]
        else:
            for i in ids.tolist():
                if i in self.byte:
                    run.append(self.byte[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(self.names[i])
            if run:
                out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


_open: dict[str, Pieces] = {}


def opened(path: str) -> Pieces:
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def encoded(docs: DataFrame, path: str, batch: int = 2 << 20) -> DataFrame:
    """(doc_id, ids, decoded) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        by = opened(path)
        for part in slices(batches, batch):
            ids = by.encode(part.column(1).to_pylist())
            columns = [part.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([by.decode(x) for x in ids])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digested(docs: DataFrame, path: str, batch: int = 2 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, same): same says whether decoding gives the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        by = opened(path)
        for part in slices(batches, batch):
            texts = part.column(1).to_pylist()
            ids = by.encode(texts)
            back = [by.decode(x) for x in ids]
            same = [b == by.model.normalize(t).replace(SPACE, " ")[1:] if t else b == "" for b, t in zip(back, texts, strict=True)]
            columns = [
                pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()), pa.array(same, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "same"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, same boolean")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digested(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
