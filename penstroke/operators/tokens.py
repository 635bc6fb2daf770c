"""The token stream with byte offsets and classes, grapheme boundaries, and spans that keep to them.

Offsets are bytes of the text in UTF-8. Texts go through Python in Arrow batches, each in one pass. A null text is empty.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NUMBER, contraction, possessive

_RUNE = r"[\p{L}\p{M}\p{Nd}]"
_CORE = rf"{_RUNE}+(?:[-‑'’]{_RUNE}+)*"
#: A number unless a word goes on at its end, a word, another number sign, a symbol, any other single character.
_TOKEN = regex.compile(rf"(?>(?P<number>{NUMBER}))(?!{_RUNE})|(?P<word>(?<!['’]){_CORE}['’]?|{_CORE})|(?P<other>\p{{No}})|(?P<symbol>[\p{{So}}\p{{Sc}}])|(?P<punctuation>\P{{White_Space}})")
#: The plane of characters that the faster pattern knows.
_PLANE = 0x10000
_GRAPHEME = regex.compile(r"\X")
STREAM = "doc_id long, ordinal int, start long, length long, token string, class string"


def _class(*names: str) -> str:
    """What stands inside the brackets of a character class of the first plane, from this library's own table of characters."""
    every = "".join(map(chr, range(_PLANE)))
    return "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer("[" + "".join(rf"\p{{{n}}}" for n in names) + "]+", every))


@cache
def _fast() -> re.Pattern:
    """_TOKEN for texts of the first plane, by the standard library's faster engine; the last group is the class as there."""
    rune = f"[{_class('L', 'M', 'Nd')}]"
    core = rf"{rune}+(?:[-‑'’]{rune}+)*"
    other, symbol, space = _class("No"), _class("So", "Sc"), _class("White_Space")
    return re.compile(rf"(?>(?P<number>{NUMBER}))(?!{rune})|(?P<word>(?<!['’]){core}['’]?|{core})|(?P<other>[{other}])|(?P<symbol>[{symbol}])|(?P<punctuation>[^{space}])")


def pattern_of(text: str) -> re.Pattern:
    """The pattern whose matches are the text's tokens."""
    return _fast() if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else _TOKEN


def scan(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, length, token in NFC, class) of each token."""
    found = pattern_of(text).finditer(text)
    if text.isascii():  # a byte a character, in NFC as it is
        for m in found:
            at, upto = m.span()
            yield at, upto - at, m[0], "number" if m.lastgroup == "other" else m.lastgroup
        return
    at = seen = 0
    for m in found:
        own, start = m[0], m.start()
        if start > seen:
            at += start - seen if (gap := text[seen:start]).isascii() else len(gap.encode())
        if own.isascii():
            size = len(own)
        else:
            size, own = len(own.encode()), unicodedata.normalize("NFC", own)
        yield at, size, own, "number" if m.lastgroup == "other" else m.lastgroup
        at, seen = at + size, m.end()


def stream(corpus: DataFrame) -> DataFrame:
    """(doc_id, ordinal, start, length, token, class, lexical, contraction, possessive) of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "ordinal", "start", "length", "token", "class"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for whole in batches:
            rows = []
            for doc_id, text in zip(whole.column(0), whole.column(1), strict=True):
                key = doc_id.as_py()
                for i, token in enumerate(scan(text.as_py() or "")):
                    rows.append((key, i, *token))
                    if len(rows) >= 20_000:
                        yield batch(rows)
                        rows = []
            yield batch(rows)

    t, word = F.col("token"), F.col("class") == "word"
    out = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STREAM)
    return out.withColumns({"lexical": word, "contraction": word & contraction(t), "possessive": word & possessive(t)})


def run_tokens(tokens: DataFrame, leaves: DataFrame) -> DataFrame:
    """Tokens within a leaf (doc_id, start, length, excisions) and clear of its excisions, with the leaf's start.

    Leaves don't overlap, so that a token belongs to the last one that starts before it. Tokens and leaves are dealt out by document, and sorted together,
    so that no token is held against all leaves of its document.
    """
    end = F.col("start") + F.col("length")
    leaf = F.struct("start", end.alias("end"), "excisions")
    starts = leaves.select("doc_id", "start", "length", leaf.alias("_leaf"))
    # at one place leaves stand before tokens, the longest of them last
    both = tokens.withColumn("_token", F.lit(True)).unionByName(starts.withColumn("_token", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy("doc_id").orderBy("start", "_token", "length").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_leaf", F.last("_leaf", ignorenulls=True).over(upto)).where("_token and doc_id is not null and _leaf.end >= start + length")
    clear = ~F.exists("_leaf.excisions", lambda e: (e["start"] < end) & (e["start"] + e["length"] > F.col("start")))
    return held.where(clear).select(*tokens.columns, F.col("_leaf.start").alias("leaf_start"))


def boundaries(text: str) -> list[int]:
    """Bytes at which graphemes begin, and the end."""
    out = [0]
    for m in _GRAPHEME.finditer(text):
        out.append(out[-1] + len(m[0].encode()))
    return out


def edge(text: str, at: int, step: int) -> int:
    """The nearest edge of a grapheme at a code point or beyond it, backwards or forwards; only the line around it is looked at, and only where it must be."""
    if at <= 0 or at >= len(text) or (ord(text[at - 1]) < 0x300 and ord(text[at]) < 0x300 and not (text[at - 1] == "\r" and text[at] == "\n")):
        return at
    for m in _GRAPHEME.finditer(text, text.rfind("\n", 0, at - 1) + 1):
        if m.end() >= at:
            return m.start() if step < 0 and m.end() > at else m.end()
    return at


class ByteOffsets:
    """Bytes before code points of a text, found in one pass for all that are asked."""

    def __init__(self, text: str, wanted: set[int]):
        self.at, self.plain = sorted(wanted), text.isascii()
        self.bytes, before, size = [], 0, 0
        for i in [] if self.plain else self.at:
            size += len(text[before:i].encode("utf-8", "surrogatepass"))
            self.bytes.append(size)
            before = i

    def __call__(self, i: int) -> int:
        return i if self.plain else self.bytes[bisect_left(self.at, i)]


def snap(edges: list[int], start: int, length: int) -> tuple[int, int]:
    """The least span of whole graphemes around a span that is first clamped to the text."""
    low = min(max(start, 0), edges[-1])
    high = min(max(start + length, low), edges[-1])
    first, last = edges[bisect_right(edges, low) - 1], edges[bisect_left(edges, high)]
    return first, last - first


def resolve(text: str, start: int, length: int) -> tuple[str | None, str]:
    """(text in NFC, "") of a span that keeps to graphemes, or (None, why not)."""
    raw, edges = text.encode(), set(boundaries(text))
    if start < 0 or length < 0 or start + length > len(raw):
        return None, "out-of-bounds"
    if start not in edges or start + length not in edges:
        return None, "not-a-boundary"
    return unicodedata.normalize("NFC", raw[start : start + length].decode()), ""


def snapped(texts: DataFrame) -> DataFrame:
    """(doc_id, start, length, snapped_start, snapped_length, widened) of texts (doc_id, text, spans); boundaries are found once a text."""
    kind = "array<struct<start:bigint,length:bigint,snapped_start:bigint,snapped_length:bigint>>"

    @F.udf(kind, useArrow=True)
    def by_graphemes(text, spans):
        edges = boundaries(text or "")
        return [(s["start"], s["length"], *snap(edges, s["start"], s["length"])) for s in spans or []]

    s = texts.select("doc_id", F.explode(by_graphemes("text", F.col("spans").cast("array<struct<start:bigint,length:bigint>>"))).alias("s")).select("doc_id", "s.*")
    return s.withColumn("widened", (F.col("snapped_start") != F.col("start")) | (F.col("snapped_length") != F.col("length")))
