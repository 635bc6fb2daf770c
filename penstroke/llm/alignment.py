"""Alignment of two tokenizers by the bytes at which their tokens end.

Each byte of a text has a label: no token ends there, one of A does, one of B does, or both do. A regular expression scans the
labels of all texts of a slice; each match runs up to a byte where both end, and its labels say how many tokens of A and of B make
up a group. Every labelled byte is also one link: there the token of A and the token of B that cover it overlap, and each
overlapping pair has one such byte, its last. Links are counted by pair of ids within a row, then over all rows.

Rows meet the counts of their pairs in two ways. Pairs that hold more than 1/HEAVY of all links are fewer than HEAVY and
are broadcast; the rest, none of them frequent, are joined by pair.

Texts are encoded with a space before them and special tokens' strings as plain text. Defined results: a null or empty
text has no tokens, nor has one whose tokens' bytes, of A or of B, aren't those of the space and the text (such as one with
U+2581, which B takes for a space). Repeated rows and null doc_ids are rows of their own; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, table, text_of
from .neardup import slices
from .pieces import SPACE, opened
from .tokens import encoder, ragged, sound

#: More links than one in so many make a pair a heavy one.
HEAVY = 1 << 16
#: No token ends, one of A, one of B, one of both.
NAMES = b".abx"
GROUP = re.compile(rb"[^x]*x")
ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair:long,times:int>>"
#: Most distinct groups of labels that a process remembers.
SPANS = 1 << 16


class Bytes:
    """The bytes of each id, laid out one after another."""

    def __init__(self, each: list[bytes]):
        self.size = np.fromiter(map(len, each), np.int64, len(each))
        self.at = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(each), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.pool, self.at[ids], self.size[ids])


@lru_cache(maxsize=4)
def byte_level(path: str) -> Bytes:
    """Ids of a byte-level vocabulary; special tokens stand for their own strings."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    each = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t, i in model["model"]["vocab"].items()}
    each |= {x["id"]: x["content"].encode() for x in model["added_tokens"]}
    return Bytes([each.get(i, b"") for i in range(max(each) + 1)])


@lru_cache(maxsize=4)
def piece_level(path: str) -> Bytes:
    by = opened(path)
    return Bytes([bytes([by.byte[i]]) if i in by.byte else n.replace(SPACE, " ").encode() for i, n in enumerate(by.names)])


class Aligner:
    """align(texts) -> columns of a row each: n_a, n_b, n_groups, n_links, groups, (pair, times) of its links."""

    def __init__(self, path_a: str, path_b: str, fast: bool):
        self.a, self.b = encoder(path_a, fast, plain=True), opened(path_b)
        self.bytes_a, self.bytes_b = byte_level(path_a), piece_level(path_b)
        self.spans: dict[bytes, tuple[int, int]] = {}
        ids = np.arange(max(len(self.bytes_a.size), len(self.bytes_b.size)))
        self.width = np.asarray([len(str(i)) for i in ids.tolist()], np.uint8)
        self.digit = np.stack([48 + ids // 10**k % 10 for k in range(int(self.width.max()))]).astype(np.uint8)

    def group_sizes(self, labels: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A and of B in each group."""
        if len(self.spans) > SPANS:
            self.spans.clear()
        known, out = self.spans, []
        for span in GROUP.findall(labels):
            sizes = known.get(span)
            if sizes is None:
                sizes = known[span] = (span.count(b"a") + 1, span.count(b"b") + 1)
            out.append(sizes)
        both = np.asarray(out, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def _written(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, last: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows' groups, where each row's end): a1,a2|b1;a3|b2,b3. last: each row's last group; ends: tokens up to each row's end."""
        upto_a, upto_b = np.cumsum(na), np.cumsum(nb)
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.repeat(upto_b - nb, na)] = a
        ids[np.arange(len(b)) + np.repeat(upto_a, nb)] = b
        mark[upto_a + upto_b - nb - 1] = ord("|")
        mark[upto_a + upto_b - 1] = ord(";")
        size = self.width[ids].astype(np.int64) + 1
        final = upto_a[last] + upto_b[last] - 1
        size[final] -= 1  # nothing after a row's last id
        stop = np.cumsum(size)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
        out[stop - 1] = mark
        digits_end = stop - 1
        digits_end[final] += 1
        for k in range(len(self.digit)):
            has = np.flatnonzero(self.width[ids] > k)
            out[digits_end[has] - 1 - k] = self.digit[k][ids[has]]
        return out, np.concatenate([[0], stop])[ends]

    def align(self, texts: list[str | None]) -> list[pa.Array]:
        rows = len(texts)
        whole = [" " + t if t else "" for t in texts]
        raw = [t.encode() for t in whole]
        size = np.fromiter(map(len, raw), np.int64, rows)
        full = [i for i in range(rows) if size[i]]
        ids_a, n_a, ids_b, n_b = np.empty(0, np.int64), np.zeros(rows, np.int64), np.empty(0, np.int64), np.zeros(rows, np.int64)
        if full:
            ids_a, per = self.a.encode([whole[i] for i in full])
            n_a[full] = per
            each = self.b.encode([texts[i] for i in full])
            n_b[full] = [len(x) for x in each]
            ids_b = np.concatenate(each).astype(np.int64)
            ids_a = ids_a.astype(np.int64)
        # rows whose tokens aren't the text's bytes lose them
        data, stop = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size)
        good = size > 0
        for ids, n, by in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            got, own = by.of(ids), np.repeat(np.arange(rows), n)
            length = np.bincount(own, by.size[ids], rows).astype(np.int64)
            same = good & (length == size)
            mine, theirs = ragged(got, (np.cumsum(length) - length)[same], length[same]), ragged(data, (stop - size)[same], size[same])
            wrong = np.flatnonzero(mine != theirs)
            same[np.flatnonzero(same)[np.searchsorted(np.cumsum(size[same]), wrong, "right")]] = False
            good &= same
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        n_a, n_b, size = n_a * good, n_b * good, size * good
        stop = np.cumsum(size)
        kind = np.zeros(int(size.sum()), np.uint8)
        kind[np.cumsum(self.bytes_a.size[ids_a]) - 1] |= 1
        kind[np.cumsum(self.bytes_b.size[ids_b]) - 1] |= 2
        na, nb = self.group_sizes(np.frombuffer(NAMES, np.uint8)[kind].tobytes())
        labelled = np.flatnonzero(kind)
        own = np.searchsorted(stop, labelled, "right")
        n_links, n_groups = np.bincount(own, minlength=rows), np.bincount(own, kind[labelled] == 3, rows).astype(np.int64)
        groups, edges = self._written(ids_a, ids_b, na, nb, np.cumsum(n_groups)[n_groups > 0] - 1, np.cumsum(n_a + n_b))
        ends_a, ends_b = (kind[labelled] & 1).astype(np.int64), (kind[labelled] >> 1).astype(np.int64)
        a, b = ids_a[np.cumsum(ends_a) - ends_a], ids_b[np.cumsum(ends_b) - ends_b]
        many = len(self.bytes_a.size) * len(self.bytes_b.size)
        kinds, times = np.unique(own * many + a * len(self.bytes_b.size) + b, return_counts=True)
        row, pair = kinds // many, kinds % many
        pair = (pair // len(self.bytes_b.size) << 32) | pair % len(self.bytes_b.size)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
        links = pa.StructArray.from_arrays([pa.array(pair), pa.array(times.astype(np.int32))], names=["pair", "times"])
        text = pa.StringArray.from_buffers(rows, pa.py_buffer(np.concatenate([[0], edges]).astype(np.int32)), pa.py_buffer(groups))
        counts = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links)]
        return [*counts, text, pa.ListArray.from_arrays(pa.array(offsets), links)]


_aligners: dict[tuple[str, str, bool], Aligner] = {}


def aligned(docs: DataFrame, path_a: str, path_b: str, size: int = 1 << 20) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, links) of each row: the groups as text, the links by pair of ids (A's << 32 | B's)."""
    fast = sound(path_a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        if (path_a, path_b, fast) not in _aligners:
            _aligners[path_a, path_b, fast] = Aligner(path_a, path_b, fast)
        by = _aligners[path_a, path_b, fast]
        for batch in slices(batches, size):
            columns = [batch.column(0), *by.align(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(lean(run), ROW)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): links of each pair of ids over all rows, and whether it is its B id's highest. A written table."""
    counts = materialize(rows.select(F.inline("links")).groupBy("pair").agg(F.sum("times").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # a row for each id of B's vocabulary at most
    return materialize(counts.withColumn("b", b).join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "ranked")


def link_scores(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Adds n_best and count_sum to rows of `aligned` and drops their links. The rows should be those of a written table."""
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    counts = pair_counts(numbered)
    total = counts.agg(F.sum("count")).first()[0] or 0
    frequent = counts.where(F.col("count") * heavy > total)  # fewer than `heavy` pairs
    links = numbered.select("_row", F.inline("links")).join(F.broadcast(frequent), "pair", "left")
    of_link = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    often = links.where("count is not null").groupBy("_row").agg(*of_link)
    rare = links.where("count is null").select("_row", "pair", "times").join(counts.where(F.col("count") * heavy <= total), "pair").groupBy("_row").agg(*of_link)
    sums = often.unionByName(rare).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return numbered.drop("links").join(sums, "_row", "left").select(*[c for c in rows.columns if c != "links"], *zero)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    out = link_scores(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
