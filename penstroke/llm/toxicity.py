"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents. Of a bounded sample of labelled documents, features of words (the word without
punctuation at its ends, and its prefixes of 4 to 7 letters) are counted by document; those that toxic
documents have far more often tag the words that carry them as toxic, in toxic documents. From these tagged
words the field learns a weight for each such feature, a bias and transitions. Forward and backward passes
give each word's marginal probability of being toxic; their sum, their largest, and the number over 1/2 make
a document's score by a logistic regression that is fitted to the same documents' labels. Words over 1/2 are
the offending spans. Whole texts are scored; nothing but the text enters a score.

Defined results: a null or empty text has no words and gets the score of a document without any marginals;
without labels of both kinds every score is the share of toxic labels (0 without any); rows that share a
doc_id are scored each on its own, and the least of their texts is learnt from; a null doc_id is held out of nothing. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, table, text_of

#: The most labelled documents that are learnt from, the first by a hash of doc_id.
SAMPLE = 6000
#: Words of a training window, and the most windows of them, half around tagged words and half from anywhere.
WINDOW, WINDOWS = 64, 12000
#: Texts of about so many code points are split into words at a time.
PART = 1 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ENDS = re.compile(r"^\W+|\W+$")
_WORDS = re.compile(r"\S+")


def features(word: str) -> list[str]:
    w = _ENDS.sub("", word.lower())
    return ["=" + w, *["^" + w[:n] for n in range(4, 8) if len(w) > n]] if w else []


@dataclass
class Field:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    #: Potentials from state (0 clean, 1 toxic) to state.
    moves: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    #: Intercept and coefficients of the score.
    scale: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def word(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def passes(weight: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of the toxic state at each word: by all up to it, by the word alone, by all after it. Words stand one after another; chains run side by side, longest first."""
    odds = np.exp(np.clip(weight, -30, 30))
    order = np.argsort(-lengths, kind="stable")
    size, start = lengths[order], (np.cumsum(lengths) - lengths)[order]
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), "left")  # chains longer than t
    (m00, m01), (m10, m11) = moves.tolist()
    ahead, back = odds.copy(), np.ones_like(odds)
    for t in range(1, steps):
        at = start[: alive[t]] + t
        r = ahead[at - 1]
        ahead[at] *= np.clip((m01 + r * m11) / (m00 + r * m10), 1e-12, 1e12)
    for t in range(steps - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        r = odds[at + 1] * back[at + 1]
        back[at] = np.clip((m10 + r * m11) / (m00 + r * m01), 1e-12, 1e12)
    return ahead, odds, back


def marginals(weight: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Each word's probability of the toxic state."""
    ahead, _, back = passes(weight, lengths, moves)
    both = np.minimum(ahead, 1e100) * back
    return both / (1 + both)


def expected(weight: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' marginals, and the expected number of moves from state to state, from the marginals of neighbouring pairs."""
    ahead, odds, back = passes(weight, lengths, moves)
    both = ahead * back
    later = following(lengths)
    a, b = ahead[later - 1], odds[later] * back[later]
    share = 1 / (moves[0, 0] + moves[0, 1] * b + a * (moves[1, 0] + moves[1, 1] * b))
    pairs = np.asarray([[share.sum(), b @ share], [a @ share, (a * b) @ share]])
    return both / (1 + both), moves * pairs


def following(lengths: np.ndarray) -> np.ndarray:
    """The words that follow another of their chain."""
    follows = np.ones(int(lengths.sum()), bool)
    follows[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    return np.flatnonzero(follows)


def aggregates(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row per document: log(1 + sum), largest, log(1 + number over 1/2)."""
    out = np.zeros((len(lengths), 3))
    has = lengths > 0
    at = (np.cumsum(lengths) - lengths)[has]
    if len(at):
        out[has, 0] = np.log1p(np.add.reduceat(p, at))
        out[has, 1] = np.maximum.reduceat(p, at)
        out[has, 2] = np.log1p(np.add.reduceat((p > 0.5).astype(float), at))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        pull = np.full(len(w), ridge)
        pull[0] = 1e-6
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit(texts: list[str], toxic: list[int], most: int = WINDOWS) -> Field:
    """A field from at most `most` windows of the texts, half around tagged words and half from anywhere, drawn by a fixed seed; features and the score are of whole texts."""
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Field(scale=(math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0, 0.0))
    split = [[sys.intern(w) for w in t.split()] for t in texts]
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    toxic_in = Counter(f for ws, label in zip(split, toxic, strict=True) if label for f in {f for w in set(ws) for f in features(w)})
    often = {f for f, k in toxic_in.items() if k >= 4}
    carried: dict[str, tuple[str, ...]] = {}  # only what the toxic documents' frequent features need is kept of a word
    clean_in: Counter = Counter()
    for ws, label in zip(split, toxic, strict=True):
        own = set(ws)
        for w in own.difference(carried):
            carried[w] = tuple(f for f in features(w) if f in often)
        if not label:
            clean_in.update({f for w in own for f in carried[w]})
    strong = {f: math.log((toxic_in[f] + 0.5) / (n1 + 1)) - math.log((clean_in[f] + 0.5) / (n0 + 1)) for f in often}
    names = sorted(f for f, v in strong.items() if v >= 2.5)
    number = {f: i for i, f in enumerate(names)}
    hit = {w: [number[f] for f in fs if f in number] for w, fs in carried.items() if fs}
    hit = {w: v for w, v in hit.items() if v}
    del toxic_in, clean_in, carried
    # windows around tagged words, and as many without
    tagged = [(d, t) for d, ws in enumerate(split) if toxic[d] for t, w in enumerate(ws) if w in hit]
    near = sorted({(d, t // WINDOW) for d, t in tagged})
    draw = np.random.default_rng(7)
    near = [near[i] for i in draw.permutation(len(near))[: most // 2]]
    rest = [(d, k) for d, ws in enumerate(split) for k in range(-(-len(ws) // WINDOW))]
    rest = [rest[i] for i in draw.permutation(len(rest))[: most // 2]]
    windows = sorted({*near, *rest})
    words, lengths, labels = [], [], []
    for d, k in windows:
        own = split[d][k * WINDOW : (k + 1) * WINDOW]
        words += own
        lengths.append(len(own))
        labels += [float(toxic[d] == 1 and w in hit) for w in own]
    size, tag = np.asarray(lengths), np.asarray(labels)
    pairs = [(i, f) for i, w in enumerate(words) for f in hit.get(w, ())]
    row, col = (np.asarray(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    w, bias, moves = np.zeros(len(names)), -4.0, np.zeros((2, 2))
    later = following(size)
    seen = np.asarray([[np.sum((tag[later - 1] == a) & (tag[later] == b)) for b in (0, 1)] for a in (0, 1)], float)
    grown_w, grown_b, grown_m = np.full(len(names), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(40):
        e = bias + np.bincount(row, w[col], len(tag))
        p, moved = expected(e, size, np.exp(moves))
        off = tag - p
        gw, gb = np.bincount(col, off[row], len(names)) - 0.05 * w, off.sum()
        gm = seen - moved - 0.5 * moves
        gm[0, 0] = 0.0
        grown_w += gw * gw
        grown_b += gb * gb
        grown_m += gm * gm
        w += 0.7 * gw / np.sqrt(grown_w)
        bias += 0.4 * gb / math.sqrt(grown_b)
        moves += 0.1 * gm / np.sqrt(grown_m)
    out = Field({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-3}, float(bias), np.exp(moves))
    every = {x: out.word(x) for x in hit}
    per = np.asarray([len(ws) for ws in split])
    flat = np.fromiter((every.get(x, out.bias) for ws in split for x in ws), float, int(per.sum()))
    out.scale = logistic(aggregates(marginals(flat, per, out.moves), per), y)
    return out


class Scorer:
    """score(texts) -> (scores, spans): spans are (start, end) code points of the words over 1/2."""

    def __init__(self, model: Field, words: int = 400_000):
        self.model, self.words, self.table = model, words, {}

    def _weighed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The weights of all words, one text after another, and each text's number of words; only a part's words are held as strings."""
        weights, per = [np.empty(0)], np.zeros(len(texts), np.int64)
        part = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // PART
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if len(self.table) > self.words:
                self.table.clear()
            split = [t.split() for t in texts[low:high]]
            flat = [w for ws in split for w in ws]
            for w in set(flat).difference(self.table):
                self.table[w] = self.model.word(w)
            per[low:high] = list(map(len, split))
            weights.append(np.fromiter(map(self.table.__getitem__, flat), float, len(flat)))
        return np.concatenate(weights), per

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        weight, per = self._weighed(texts)
        p = marginals(weight, per, self.model.moves)
        z = self.model.scale[0] + aggregates(p, per) @ np.asarray(self.model.scale[1:])
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        starts = np.cumsum(per) - per
        over = np.flatnonzero(p > 0.5)
        of = np.searchsorted(starts, over, "right") - 1
        for d in np.unique(of).tolist():
            where = list(_WORDS.finditer(texts[d]))
            spans[d] = [where[k].span() for k in (over[of == d] - starts[d]).tolist()]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = WINDOWS) -> Field:
    """A field from at most `sample` labelled rows whose crc32 of doc_id isn't a multiple of 5, and at most `most` of their windows."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(rows), "doc_id")  # `sample` rows at most
    got = sorted(taken.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())  # `sample` rows at most
    return fit([r["text"] for r in got], [r["toxic"] for r in got], most)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, model: Field, batch: int = 2048) -> DataFrame:
    """The rows with score (double) and spans (offending words' code points) added."""
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    at, names = docs.columns.index("text"), [*docs.columns, "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for low in range(0, whole.num_rows, batch):
                part = whole.slice(low, batch)
                score, spans = by.score([t or "" for t in part.column(at).to_pylist()])
                listed = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), listed], names=names)

    return docs.mapInArrow(lean(run), schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
