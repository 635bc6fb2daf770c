"""Token-id files: an adaptive context-mixing range coder in independent blocks.

An image holds the ids of whole documents, one after another, in blocks of BLOCK ids. A block starts from a clean
state and has a checksum. For each id the last two ids (order 2) and the last one (order 1) each predict the id that
followed them last time in the block, and tell whether their last two predictions held. From these states three models,
order 2's, order 1's and one of both together, predict whether order 2 is right, order 1 is, or neither; their
predictions are mixed, the joint model's weight growing with what it has seen, and the outcome is coded. The models adapt
every CHUNK ids. An id that neither predicts is coded by order 0: its frequency in the image, which the header
states. The coder keeps a range of 48 bits and puts out 16 bits at a time; an image's blocks are coded side by
side, one numpy lane each. All arithmetic is on integers, so that reading repeats writing's steps exactly.

Layout of an image: MAGIC, the header's size as u32, the header (zlib of JSON: shard, first id's place in the shard,
documents' ids and lengths, id counts, and tokens, bytes and crc32 of each block), the blocks, END. Each image of about IMAGE ids is a
file of its own in the shared folder (a longer document makes a longer one); Spark's commit makes a task's files appear whole or not at all.

Defined results: a null text is empty (only the end id); rows without a doc_id come first; rows that share a
doc_id stand in the order of their texts; an empty table makes no image. Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, text_of
from .neardup import slices
from .tokens import encoder, sound

MAGIC, END, BLOCK, CHUNK, LANES, SLOTS, IMAGE = b"IDBLOCKS2\n", "IDEND\n", 4096, 256, 2048, 4096, 4_000_000
_U = np.uint64
_LITERAL = 20
#: Lanes whose predictions are found at once.
ROWS = 16
#: A predictor's state: 0 nothing seen, else 1 + (last prediction held) + 2 * (the one before held); _NEXT by state * 2 + held.
_NEXT = np.asarray([1, 2, 1, 2, 3, 4, 1, 2, 3, 4], np.int32)
_STATES = 50
#: Multipliers and shift of the hashes that pick a slot.
_ONE, _TWO, _BEFORE, _TOP = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(20)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2^20, from counts."""
    total, share = int(counts.sum()), (1 << _LITERAL) - len(counts)
    f = 1 + counts.astype(np.int64) * share // max(total, 1)
    f[int(np.argmax(counts))] += (1 << _LITERAL) - int(f.sum())
    return f


class _Mixer:
    """Adaptive counts of outcomes (order 2 right, order 1, neither) by lane and states, and their mixed frequencies of 2^16."""

    def __init__(self, n: int):
        self.n, self.counts = n, np.zeros((n, _STATES, 3), np.int32)

    def frequencies(self) -> np.ndarray:
        """Cumulated frequencies 0, order 2's, and order 1's, 2^16 of each lane and state, one after another."""
        joint = self.counts.reshape(self.n, 5, 5, 2, 3)
        two, one = joint.sum((2, 3), dtype=np.int32) + 8, joint.sum(1, dtype=np.int32) + 8
        two, one = (two << 12) // two.sum(-1, keepdims=True), (one << 12) // one.sum(-1, keepdims=True)
        mixed = (joint << 3) + ((two[:, :, None, None] + one[:, None]) >> 4)
        scale = mixed.sum(-1)
        upto = np.empty((self.n * _STATES, 4), np.int64)
        upto[:, 0], upto[:, 3] = 0, 1 << 16
        upto[:, 1] = ((mixed[..., 0] << 8) * 250 // scale + 16).ravel()
        upto[:, 2] = upto[:, 1] + ((mixed[..., 1] << 8) * 250 // scale + 16).ravel()
        return upto.ravel()

    def learn(self, cells: np.ndarray) -> None:
        """cells: (lane * states + state) * 3 + outcome of a chunk's ids."""
        seen = np.bincount(cells, minlength=self.counts.size).reshape(self.counts.shape)
        self.counts += (seen << 4).astype(np.int32) - (self.counts >> 4)


def _slot_one(last: np.ndarray) -> np.ndarray:
    return last * _ONE >> _TOP


def _slot_two(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (last * _TWO ^ before * _BEFORE) * _ONE >> _TOP


def _predicted(slot: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prediction or -1, state) at each id, from what stood in the same slot before in the block (rows)."""
    rows, steps = slot.shape
    order = np.argsort(slot.astype(np.uint16), axis=1, kind="stable")
    order += (np.arange(rows) * steps)[:, None]
    slots, own = slot.ravel()[order], ids.ravel()[order]
    same = np.zeros(slot.shape, bool)
    np.equal(slots[:, 1:], slots[:, :-1], out=same[:, 1:])
    guess = np.full(slot.shape, -1, np.int32)
    guess[:, 1:] = np.where(same[:, 1:], own[:, :-1], -1)
    held = guess == own
    state = same.astype(np.int32)
    state[:, 1:] += held[:, :-1] & same[:, 1:]
    state[:, 2:] += (held[:, :-2] & same[:, 2:] & same[:, 1:-1]) * np.int32(2)
    both = np.empty(rows * steps, np.int32)
    both[order.ravel()] = ((guess + 1) << 3 | state).ravel()
    both = both.reshape(slot.shape)
    return (both >> 3) - 1, both & 7


def encode_blocks(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low_of: np.ndarray, f_of: np.ndarray) -> list[bytes]:
    """The bytes of each block, longest block first; only the last may be shorter. low_of, f_of: order 0 by id."""
    n, steps = len(starts), int(lengths[0])
    rows = np.zeros((n, steps), np.int32)
    for i, (a, m) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        rows[i, :m] = ids[a : a + m]
    outcome, cell = np.empty((steps, n), np.int8), np.empty((steps, n), np.int32)
    # few rows at a time, which the processor's cache holds
    for i in range(0, n, ROWS):
        own = rows[i : i + ROWS]
        last, before = np.zeros(own.shape, np.uint32), np.zeros(own.shape, np.uint32)
        last[:, 1:], before[:, 2:] = own[:, :-1], own[:, :-2]
        p2, c2 = _predicted(_slot_two(last, before), own)
        p1, c1 = _predicted(_slot_one(last), own)
        outcome[:, i : i + ROWS] = np.where(p2 == own, np.int8(0), np.where(p1 == own, np.int8(1), np.int8(2))).T
        c2 *= np.int32(10)
        c2 += c1 * np.int32(2)
        c2 += p1 == p2
        c2 += (np.arange(i, i + len(own), dtype=np.int32) * np.int32(_STATES))[:, None]
        cell[:, i : i + ROWS] = c2.T
    rows = rows.T.copy()
    mixer = _Mixer(n)
    low, size = np.zeros(n, _U), np.full(n, 1 << 48, _U)
    words, width = np.zeros((n, steps), np.uint32).ravel(), steps
    at = np.arange(n) * width
    mask, floor = _U(0xFFFFFFFF), _U(1 << 32)

    def put(which: np.ndarray) -> None:
        x = low[which]
        words[at[which]] = x >> _U(32)
        at[which] += 1
        low[which] = (x & mask) << _U(16)
        size[which] <<= _U(16)

    for t0 in range(0, steps, CHUNK):
        t1 = min(t0 + CHUNK, steps)
        used = int((at - np.arange(n) * width).max())
        if used + 3 * CHUNK + 4 > width:
            wide = np.zeros((n, 2 * width + 4 * CHUNK), np.uint32)
            wide[:, :width] = words.reshape(n, width)
            at = at + np.arange(n) * (wide.shape[1] - width)
            words, width = wide.ravel(), wide.shape[1]
        upto, out = mixer.frequencies().view(_U), outcome[t0:t1]
        place = cell[t0:t1] * 4 + out
        from_ = upto[place]
        freq = upto[place + 1] - from_
        own = rows[t0:t1]
        low0, f0 = np.where(out == 2, low_of[own], _U(0)), np.where(out == 2, f_of[own], _U(1 << _LITERAL))
        for t in range(t1 - t0):
            m = n if t + t0 < lengths[-1] else n - 1
            r = size[:m] >> _U(16)
            add = r * from_[t, :m]
            r *= freq[t, :m]
            r >>= _U(_LITERAL)
            add += r * low0[t, :m]
            low[:m] += add
            r *= f0[t, :m]
            size[:m] = r
            short = np.flatnonzero(r < floor)
            while len(short):
                put(short)
                short = short[size[short] < floor]
        cells = cell[t0:t1] * 3 + out
        if lengths[-1] < t1:
            cells = np.concatenate([cells[:, :-1].ravel(), cells[: max(int(lengths[-1]) - t0, 0), -1]])
        mixer.learn(cells.ravel())
    if n and width - int((at - np.arange(n) * width).max()) < 4:
        wide = np.zeros((n, width + 8), np.uint32)
        wide[:, :width] = words.reshape(n, width)
        at = at + np.arange(n) * 8
        words, width = wide.ravel(), width + 8
    for _ in range(3):
        put(np.arange(n))
    # words hold 17 bits: carries go to the words before
    words, used = words.reshape(n, width), at - np.arange(n) * width
    carry = np.zeros(n, np.uint32)
    for k in range(int(used.max()) - 1, -1, -1):
        words[:, k] += carry
        carry = words[:, k] >> np.uint32(16)
    small = words[:, : int(used.max())].astype(">u2")
    return [small[i, : used[i]].tobytes() for i in range(n)]


def decode_blocks(blocks: list[bytes], lengths: np.ndarray, orders: list[tuple[np.ndarray, np.ndarray]], order_of: np.ndarray) -> list[np.ndarray]:
    """The ids of each block, longest block first. orders: order 0's cumulated frequencies and their ids, of each image; order_of: each block's image."""
    n, steps = len(blocks), int(lengths[0])
    words = np.zeros((n, max(map(len, blocks)) // 2 + 8), _U)
    for i, b in enumerate(blocks):
        words[i, : len(b) // 2] = np.frombuffer(b, ">u2")
    words, width = words.ravel(), words.shape[1]
    at = np.arange(n) * width
    code, size = np.zeros(n, _U), np.full(n, 1 << 48, _U)
    for _ in range(3):
        code = code << _U(16) | words[at]
        at += 1
    out = np.zeros((steps, n), np.int32)
    mixer, lanes = _Mixer(n), np.arange(n) * _STATES
    two, one, base = np.zeros(n * SLOTS, np.int32), np.zeros(n * SLOTS, np.int32), np.arange(n) * SLOTS
    last, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    floor, whole = _U(1 << 32), _U(1 << _LITERAL)
    f_of, low_of = np.concatenate([np.diff(cum) for cum, _ in orders]).astype(_U), np.concatenate([cum[:-1] for cum, _ in orders]).astype(_U)
    # the images' tables stand one after another; each sums to 2^20
    place, more_of = np.repeat(np.arange(len(f_of), dtype=np.int32), f_of.astype(np.int64)), np.concatenate([ids_of for _, ids_of in orders]) + 1
    first, longer = order_of.astype(np.int64) << _LITERAL, np.searchsorted(-lengths, -np.arange(steps), "left").tolist()

    def take(which: np.ndarray) -> None:
        code[which] = code[which] << _U(16) | words[at[which]]
        at[which] += 1
        size[which] <<= _U(16)

    for t0 in range(0, steps, CHUNK):
        upto = mixer.frequencies()
        upto_u, seen = upto.view(_U), []
        for t in range(t0, min(t0 + CHUNK, steps)):
            m = longer[t]
            own = last[:m]
            at2, at1 = base[:m] + ((own * _TWO ^ mixed[:m]) * _ONE >> _TOP), base[:m] + (own * _ONE >> _TOP)
            e2, e1 = two[at2], one[at1]
            c2, c1 = e2 & 7, e1 & 7
            cell = (c2 * 10 + c1 * 2 + ((e1 ^ e2) < 8) + lanes[:m]) * 4
            r = size[:m] >> _U(16)
            # what was coded lies inside the range, so that no quotient is too large
            v = (code[:m] // r).view(np.int64)
            neither = v >= upto[cell + 2]
            cell += v >= upto[cell + 1]
            cell += neither
            from_ = upto_u[cell]
            rest = code[:m] - r * from_
            r *= upto_u[cell + 1] - from_
            r >>= _U(_LITERAL)
            k = place[(rest // r).view(np.int64) + first[:m]]
            code[:m] = np.where(neither, rest - r * low_of[k], rest)
            r *= np.where(neither, f_of[k], whole)
            size[:m] = r
            short = np.flatnonzero(r < floor)
            while len(short):
                take(short)
                short = short[size[short] < floor]
            # ids plus 1, as the slots have them
            sym = np.where(neither, more_of[k], np.where(cell & 3, e1, e2) >> 3)
            seen.append(cell)
            high = sym << 3
            two[at2] = high | _NEXT[c2 * 2 + ((e2 ^ high) < 8)]
            one[at1] = high | _NEXT[c1 * 2 + ((e1 ^ high) < 8)]
            mixed[:m] = own * _BEFORE
            sym -= 1
            out[t, :m] = sym
            last[:m] = sym
        if seen:
            cells = np.concatenate(seen)
            mixer.learn((cells >> 2) * 3 + (cells & 3))
    return [out[: lengths[i], i].copy() for i in range(n)]


def write_image(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, shard: int = 0, first: int = 0) -> bytes:
    ids = ids.astype(np.int32)
    present, counts = np.unique(ids, return_counts=True)
    f = frequencies(counts)
    low_of, f_of = np.zeros(int(present[-1]) + 1, _U), np.zeros(int(present[-1]) + 1, _U)
    f_of[present], low_of[present] = f, np.cumsum(f) - f
    starts = np.arange(0, len(ids), BLOCK)
    sizes = np.minimum(BLOCK, len(ids) - starts)
    blocks: list[bytes] = []
    for k in range(0, len(starts), LANES):
        blocks += encode_blocks(ids, starts[k : k + LANES], sizes[k : k + LANES], low_of, f_of)
    table_ = [[int(n), len(b), zlib.crc32(b)] for n, b in zip(sizes, blocks, strict=True)]
    head = {"shard": shard, "first": first, "tokens": len(ids), "doc_ids": doc_ids, "lengths": lengths.tolist(), "ids": np.diff(present, prepend=0).tolist(), "counts": counts.tolist(), "blocks": table_}
    packed = zlib.compress(json.dumps(head, separators=(",", ":")).encode(), 6)
    return b"".join([MAGIC, struct.pack("<I", len(packed)), packed, *blocks])


def read_header(image: bytes) -> tuple[dict, int]:
    """(header, where the blocks start)."""
    if image[: len(MAGIC)] != MAGIC:
        raise ValueError("not an id file")
    at = len(MAGIC) + 4
    (size,) = struct.unpack("<I", image[len(MAGIC) : at])
    return json.loads(zlib.decompress(image[at : at + size])), at + size


def read_images(images: list[bytes]) -> list[tuple[dict, np.ndarray, np.ndarray]]:
    """(header, documents' lengths, ids) of each file, their blocks decoded side by side; a checksum that doesn't hold raises."""
    heads, blocks, orders = [], [], []
    for image in images:
        head, at = read_header(image)
        for _, n, crc in head["blocks"]:
            blocks.append(image[at : at + n])
            at += n
            if zlib.crc32(blocks[-1]) != crc:
                raise ValueError("a block's checksum doesn't hold")
        heads.append(head)
        orders.append((np.concatenate([[0], np.cumsum(frequencies(np.asarray(head["counts"])))]), np.cumsum(head["ids"]).astype(np.int32)))
    sizes = np.asarray([b[0] for head in heads for b in head["blocks"]], np.int64)
    order_of = np.repeat(np.arange(len(heads)), [len(head["blocks"]) for head in heads])
    parts: list[np.ndarray] = [np.empty(0, np.int32)] * len(blocks)
    by_size = np.argsort(-sizes, kind="stable")
    for k in range(0, len(blocks), LANES):
        own = by_size[k : k + LANES]
        for i, ids in zip(own.tolist(), decode_blocks([blocks[i] for i in own.tolist()], sizes[own], orders, order_of[own]), strict=True):
            parts[i] = ids
    ends = np.cumsum([len(head["blocks"]) for head in heads]).tolist()
    return [(head, np.asarray(head["lengths"], np.int64), np.concatenate(parts[e - len(head["blocks"]) : e])) for head, e in zip(heads, ends, strict=True)]


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file."""
    head, lengths, ids = read_images([image])[0]
    return head["doc_ids"], lengths, ids


def write_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, image: int = IMAGE) -> None:
    """Write the documents' ids in ascending doc_id order to files in the folder, which driver and executors share."""
    fast = sound(path)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        by, shard, first = encoder(path, fast), TaskContext.get().partitionId(), 0
        doc_ids, parts, lengths, held = [], [], [], 0
        small = np.uint16 if by.library.get_vocab_size() <= 65536 else np.uint32

        def closed() -> pa.RecordBatch:
            nonlocal doc_ids, parts, lengths, held, first
            made_ = write_image(doc_ids, np.concatenate(lengths), np.concatenate(parts), shard, first)
            doc_ids, parts, lengths, held, first = [], [], [], 0, first + held
            return pa.RecordBatch.from_arrays([pa.array([made_], pa.binary())], names=["value"])

        for part in slices(batches, 4 << 20):
            ids, per = by.encode(part.column(1).to_pylist())
            parts.append(np.insert(ids.astype(small), np.cumsum(per), end_id))
            lengths.append(per + 1)
            doc_ids += part.column(0).to_pylist()
            held += len(parts[-1])
            if held >= image:
                yield closed()
        if doc_ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    # the text writer puts a value's bytes out as they are, then the end mark
    images = dealt.mapInArrow(made, "value binary").select(F.col("value").cast("string").alias("value"))
    images.write.option("lineSep", END).option("maxRecordsPerFile", 1).text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the folder's files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_header(x.as_py())[0] for x in batch.column(0) if len(x.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in found], pa.int64()) for k in ("shard", "tokens")], names=["shard", "tokens"])

    before, total = {}, 0
    for shard, tokens in sorted(files.mapInArrow(headers, "shard long, tokens long").groupBy("shard").agg(F.sum("tokens")).collect()):  # a row a shard
        before[shard] = total
        total += tokens

    def rows(images: list[bytes]) -> Iterator[pa.RecordBatch]:
        for head, lengths, ids in read_images(images):
            data, ends = ids.astype("<u4"), np.cumsum(lengths)
            crc = [zlib.crc32(data[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            start = ends - lengths + before[head["shard"]] + head["first"]
            yield pa.RecordBatch.from_arrays([pa.array(head["doc_ids"], pa.int64()), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lanes = [], 0
        for batch in batches:
            for content in batch.column(0):
                image = content.as_py()
                if not image:
                    continue
                if not image.endswith(END.encode()):
                    raise ValueError("a file was cut off")
                more = len(read_header(image)[0]["blocks"])
                if held and lanes + more > LANES:
                    yield from rows(held)
                    held, lanes = [], 0
                held.append(image)
                lanes += more
        if held:
            yield from rows(held)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/penstroke/{uuid.uuid4().hex}/idfiles"
    write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_files(spark, folder)
