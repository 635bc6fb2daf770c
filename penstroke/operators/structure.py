"""Structure of Markdown texts: leaves with roles, container nodes, spans and excisions, in bytes of the raw text.

A line parser of its own: front matter, headings of both kinds, fences, indented code, quotes, lists, tables, HTML blocks,
definition lists, footnotes, reference definitions and paragraphs. A footnote that nothing refers to is left out; all others stand in one
section of the document, wherever they are defined. Code spans, images and footnote references inside a leaf are excised, and so is what
containers put before a leaf's further lines. Spans keep to graphemes. Parsing gives evidence (words, final punctuation); whether a leaf
is included follows from that evidence by columns (`classified`), so that a policy can change without parsing again.

Emphasis, links and entities inside a leaf don't matter, as only blocks are queried. A null text is empty: it has a root and no leaves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.tables import materialize
from .tokens import ByteOffsets, edge, pattern_of

#: Roles that are never part of the feature population.
ROLE_SKIPPED = ("heading", "code-block", "front-matter", "table-cell", "image", "html-block", "definition-term")
ROLES = ("paragraph", "heading", "code-block", "front-matter", "table-cell", "footnote", "caption", "image", "html-block", "definition-term", "definition-description")
CONTAINERS = ("document", "block-quote", "list", "list-item", "table", "footnote-section", "footnote", "definition-list")
EXCLUSIONS = ("", "excluded-by-role", "excluded-not-sentential", "excluded-by-block-quote-policy")

_FENCE = re.compile(r"^( {0,3})(`{3,}(?!.*`)|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+|$)")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_BREAK = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_QUOTE = re.compile(r"^ {0,3}> ?")
_NOTE = re.compile(r"^ {0,3}\[\^([^\]]+)\]:[ \t]*")
_REFERENCE = re.compile(r"^\[([^\]^][^\]]*)\]:[ \t]*\S+")
_RULE_ROW = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DESCRIPTION = re.compile(r"^:([ \t]+)(?=\S)")
_TERMINAL = re.compile(r"[.!?][\"'”’)\]}*_]*\s*$")
_CAPTION = re.compile(r"<figcaption>(.*?)</figcaption>", re.I | re.S)
# fixed values of the CommonMark grammar: how HTML blocks begin, and how those end that don't end at an empty line
_BLOCK_TAGS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|"
    "h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_ATTRIBUTE = r"(?:[ \t]+[A-Za-z_:][\w.:-]*(?:[ \t]*=[ \t]*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
_HTML = [
    (re.compile(r"^ {0,3}<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"^ {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r"^ {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r"^ {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r"^ {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(rf"^ {{0,3}}</?(?:{_BLOCK_TAGS})(?=[\s>]|/>|$)", re.I), None),
    (re.compile(rf"^ {{0,3}}(?:<[A-Za-z][\w-]*{_ATTRIBUTE}*[ \t]*/?>|</[A-Za-z][\w-]*[ \t]*>)[ \t]*$"), None),
]

#: Quotes and lists within more containers than this are text.
DEEPEST = 100
Row = tuple[int, int]


@dataclass
class Leaf:
    role: str
    start: int
    end: int
    path: tuple[int, ...] = (0,)
    containers: tuple[str, ...] = ("document",)
    excisions: list[Row] = field(default_factory=list)
    lines: list[Row] = field(default_factory=list)
    words: int = 0
    terminal: bool = False
    exclusion: str = ""


def front_matter(text: str) -> tuple[int, int, int]:
    """(start and end of what stands between the fences, where the rest begins)."""
    m = re.match(r"---[ \t]*\r?\n(.*?)^---[ \t]*\r?(?:\n|\Z)", text, re.S | re.M)
    return (m.start(1), m.end(1), m.end()) if m else (0, 0, 0)


def merged(spans: list[Row]) -> list[Row]:
    """Overlapping spans joined; touching ones stay apart."""
    out: list[Row] = []
    for a, b in sorted(s for s in spans if s[1] > s[0]):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _label(name: str) -> str:
    return " ".join(name.split()).casefold()


class Parser:
    """One text's leaves; `kinds` and `parents` describe its containers by number, 0 being the document."""

    def __init__(self, text: str):
        self.text, self.leaves, self.tokens = text, [], pattern_of(text)
        self.kinds, self.parents = ["document"], [-1]
        self.notes: dict[str, tuple[int, list[Row]]] = {}
        self.references: set[str] = set()
        self.used: set[str] = set()
        start, end, at = front_matter(text)
        if end > start:
            self._leaf("front-matter", start, end, 0)
        rows = []
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            rows.append((at, stop - (stop > at and text[stop - 1] == "\r")))
            at = stop + 1
        self._blocks(rows, 0, "paragraph")
        if self.notes:
            section = self._container("footnote-section", 0)
            for label, (_, body) in list(self.notes.items()):
                number = self._container("footnote", section)
                self.notes[label] = (number, body)
                self._blocks(body, number, "footnote")
        for leaf in self.leaves:
            self._inline(leaf)
        dropped = {number for label, (number, _) in self.notes.items() if label not in self.used}
        self.leaves = sorted((x for x in self.leaves if not dropped & set(x.path)), key=lambda x: (x.start, x.end))

    def _container(self, kind: str, parent: int) -> int:
        self.kinds.append(kind)
        self.parents.append(parent)
        return len(self.kinds) - 1

    def _path(self, number: int) -> tuple[int, ...]:
        out = []
        while number >= 0:
            out.append(number)
            number = self.parents[number]
        return tuple(reversed(out))

    def _leaf(self, role: str, start: int, end: int, number: int, lines: list[Row] | None = None) -> Leaf | None:
        while end > start and self.text[end - 1] in "\r\n":
            end -= 1
        if end == start:
            return None
        path = self._path(number)
        leaf = Leaf(role, edge(self.text, start, -1), edge(self.text, end, 1), path, tuple(self.kinds[i] for i in path), lines=lines or [])
        for (_, a), (b, _) in zip(leaf.lines, leaf.lines[1:], strict=False):
            gap = self.text[a:b]
            leaf.excisions += [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\r\n]+", gap)]
        self.leaves.append(leaf)
        return leaf

    def _line(self, row: Row) -> str:
        return self.text[row[0] : row[1]]

    def _starts_block(self, line: str, item: bool = True) -> bool:
        """Whether a line ends an open paragraph."""
        return bool(
            _HEADING.match(line) or _FENCE.match(line) or _QUOTE.match(line) or _BREAK.match(line) or _NOTE.match(line) or any(begin.match(line) for begin, _ in _HTML[:6])
            or (item and (m := _ITEM.match(line)) and line[m.end() :].strip() and (not m[2][0].isdigit() or m[2][:-1] == "1"))
        )

    def _lazy(self, last: Row, line: str) -> bool:
        """Whether a line without its container's prefix goes on with the paragraph of the container's last line."""
        before = self._line(last)
        return bool(before.strip()) and not (_HEADING.match(before) or _FENCE.match(before) or _BREAK.match(before)) and bool(line.strip()) and not self._starts_block(line) and not _ITEM.match(line)

    def _indented(self, rows: list[Row], i: int, width: int, first: Row, stop: re.Pattern | None = None) -> tuple[list[Row], int]:
        """(rows of a container whose further lines are indented by width, the row after them). stop: a line that starts the next one."""
        inner, j = [first], i + 1
        while j < len(rows):
            a, b = rows[j]
            own = self._line(rows[j])
            indent = len(own) - len(own.lstrip(" "))
            if not own.strip():
                inner.append((b, b))
            elif indent >= width:
                inner.append((a + width, b))
            elif own.startswith("\t"):
                inner.append((a + 1, b))
            elif self._lazy(inner[-1], own) and not (stop and stop.match(own)):
                inner.append((a + indent, b))
            else:
                break
            j += 1
        while not self._line(inner[-1]).strip() and len(inner) > 1:
            inner.pop()
        return inner, j

    def _blocks(self, rows: list[Row], number: int, role: str) -> None:
        text, open_, shallow = self.text, [], len(self._path(number)) <= DEEPEST
        # the last two blocks of this container: what a description may belong to
        said: list[tuple[str, object]] = [("", None), ("", None)]

        def close(as_role: str | None = None) -> None:
            if not open_:
                return
            lines = open_[:]
            open_.clear()
            while lines and as_role is None and (m := _REFERENCE.match(self._line(lines[0]))):
                self.references.add(_label(m[1]))
                lines.pop(0)
            if not lines:
                return
            lines[-1] = (lines[-1][0], lines[-1][0] + len(self._line(lines[-1]).rstrip()))
            if as_role is None:
                at = next((i for i in range(1, len(lines)) if _RULE_ROW.match(self._line(lines[i])) and len(self._cells(lines[i])) == len(self._cells(lines[i - 1]))), None)
                if at is not None:
                    if at > 1:
                        self._leaf(role, lines[0][0], lines[at - 2][1], number, lines[: at - 1])
                    table, columns = self._container("table", number), len(self._cells(lines[at]))
                    for i, line in enumerate(lines[at - 1 :]):
                        if i != 1:
                            for a, b in self._cells(line)[:columns]:
                                self._leaf("table-cell", a, b, table)
                    said.append(("table", None))
                    return
            leaf = self._leaf(as_role or role, lines[0][0], lines[-1][1], number, lines)
            said.append(("heading" if as_role else "paragraph", leaf))

        i = 0
        while i < len(rows):
            a, b = rows[i]
            line = text[a:b]
            if not line.strip():
                close()
                i += 1
            elif m := _FENCE.match(line):
                close()
                j, end = i + 1, re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
                while j < len(rows) and not end.match(self._line(rows[j])):
                    j += 1
                inner = rows[i + 1 : j]
                if inner:
                    own = self._line(inner[0])
                    self._leaf("code-block", inner[0][0] + min(len(m[1]), len(own) - len(own.lstrip(" "))), inner[-1][1], number)
                said.append(("code", None))
                i = j + 1
            elif m := _HEADING.match(line):
                close()
                body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", line[m.end() :]).rstrip()
                self._leaf("heading", a + m.end(), a + m.end() + len(body), number)
                said.append(("heading", None))
                i += 1
            elif open_ and _UNDERLINE.match(line):
                close("heading")
                i += 1
            elif _BREAK.match(line):
                close()
                said.append(("break", None))
                i += 1
            elif shallow and _QUOTE.match(line):
                close()
                j, inner = i, []
                while j < len(rows):
                    own = self._line(rows[j])
                    if q := _QUOTE.match(own):
                        inner.append((rows[j][0] + q.end(), rows[j][1]))
                    elif inner and self._lazy(inner[-1], own):
                        inner.append((rows[j][0] + len(own) - len(own.lstrip(" ")), rows[j][1]))
                    else:
                        break
                    j += 1
                self._blocks(inner, self._container("block-quote", number), "paragraph")
                said.append(("quote", None))
                i = j
            elif shallow and (m := _ITEM.match(line)) and not (open_ and (not line[m.end() :].strip() or (m[2][0].isdigit() and m[2][:-1] != "1"))):
                close()
                kind, list_ = m[2][-1], self._container("list", number)
                while i < len(rows) and (m := _ITEM.match(self._line(rows[i]))) and m[2][-1] == kind and not _BREAK.match(self._line(rows[i])):
                    a, b = rows[i]
                    width = m.end() if m[3] and len(m[3]) <= 4 and b > a + m.end() else m.end(2) + 1
                    inner, i = self._indented(rows, i, width, (min(a + width, b), b))
                    self._blocks(inner, self._container("list-item", list_), "paragraph")
                said.append(("list", None))
            elif m := _NOTE.match(line):
                close()
                inner, i = self._indented(rows, i, 4, (a + m.end(), b))
                self.notes.setdefault(m[1], (-1, inner))
            elif (m := _DESCRIPTION.match(line)) and (open_ or said[-1][0] in ("paragraph", "definitions")):
                close()
                kind, leaf = said[-1]
                if leaf is None:  # all that was open were reference definitions, or it was a table
                    open_.append((a, b))
                    i += 1
                    continue
                if kind == "definitions":
                    list_ = leaf
                else:
                    list_ = said[-2][1] if said[-2][0] == "definitions" else self._container("definition-list", number)
                    self.leaves.pop()  # the paragraph, which was the last leaf, is the terms
                    for x, y in leaf.lines:
                        self._leaf("definition-term", x, x + len(text[x:y].rstrip()), list_)
                width = 1 + (len(m[1]) if len(m[1]) < 8 else 5)
                inner, i = self._indented(rows, i, width, (a + width, b), _DESCRIPTION)
                self._blocks(inner, list_, "definition-description")
                said.append(("definitions", list_))
            elif not open_ and line.startswith(("    ", "\t")):
                j = i
                while j + 1 < len(rows) and (self._line(rows[j + 1]).startswith(("    ", "\t")) or not self._line(rows[j + 1]).strip()):
                    j += 1
                while not self._line(rows[j]).strip():
                    j -= 1
                self._leaf("code-block", a + (4 if line.startswith(" ") else 1), rows[j][1], number)
                said.append(("code", None))
                i = j + 1
            elif (k := next((k for k, (begin, _) in enumerate(_HTML) if begin.match(line)), None)) is not None and not (open_ and k == 6):
                close()
                j, end = i, _HTML[k][1]
                if end is None:
                    while j + 1 < len(rows) and self._line(rows[j + 1]).strip():
                        j += 1
                    last, i = j, j + 1
                elif end.search(line):
                    last, i = j, j + 1
                else:
                    while j + 1 < len(rows) and not end.search(self._line(rows[j + 1])):
                        j += 1
                    last, i = j, j + 2  # the closing line is not part of the block's own lines
                self._html(a, rows[last][1], number)
                said.append(("html", None))
            else:
                open_.append((a + len(line) - len(line.lstrip(" \t")), b))
                i += 1
        close()

    def _html(self, start: int, end: int, number: int) -> None:
        if m := _CAPTION.search(self.text, start, end):
            parts = [("html-block", start, m.start(1))] if m.start() > start else []
            parts += [("caption", *m.span(1)), ("html-block", m.end(1), end)]
        else:
            parts = [("html-block", start, end)]
        for part in parts:
            self._leaf(*part, number)

    def _cells(self, row: Row) -> list[Row]:
        """A table row's cells, trimmed; empty ones too."""
        a, b = row
        own = self.text[a:b].rstrip()
        low = len(own) - len(own.lstrip())
        low += own[low : low + 1] == "|"
        high = len(own) - (own.endswith("|") and not own.endswith("\\|") and len(own) > low)
        out, at = [], low
        for m in re.finditer(r"(?<!\\)\||$", own[:high]):
            if m.start() < low:
                continue
            cell = own[at : m.start()]
            left = at + len(cell) - len(cell.lstrip())
            out.append((a + left, a + max(left, at + len(cell.rstrip()))))
            at = m.end()
        return out

    def _inline(self, leaf: Leaf) -> None:
        if leaf.role not in ("code-block", "html-block", "front-matter", "caption"):
            own = self.text[leaf.start : leaf.end]
            if "`" in own or "[" in own:
                leaf.excisions += self._marks(leaf.start, leaf.end)
            images = [x for x in leaf.excisions if self.text.startswith("![", x[0])]
            leaf.excisions = merged(leaf.excisions)
            if leaf.role == "paragraph" and images and not run_text(self.text, leaf).strip() and not any(self.text[a] == "`" for a, _ in leaf.excisions):
                leaf.role = "image"
        leaf.words, at = 0, 0
        for m in self.tokens.finditer(self.text, leaf.start, leaf.end):
            if m.lastgroup == "word":
                while at < len(leaf.excisions) and leaf.excisions[at][1] <= m.start():
                    at += 1
                leaf.words += at == len(leaf.excisions) or leaf.excisions[at][0] >= m.end()
        leaf.terminal = bool(_TERMINAL.search(run_text(self.text, leaf)))

    def _marks(self, start: int, end: int) -> list[Row]:
        """Code spans, images and footnote references, in this order of strength."""
        text, out, at = self.text, [], start
        while at < end:
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                width = at
                while width < end and text[width] == "`":
                    width += 1
                close = re.compile(f"(?<!`){text[at:width]}(?!`)").search(text, width, end)
                if close:
                    out.append((at, close.end()))
                at = close.end() if close else width
            elif text.startswith("![", at) and (stop := self._image(at, end)):
                out.append((at, stop))
                at = stop
            elif text.startswith("[^", at) and (m := re.compile(r"\[\^([^\]]+)\]").match(text, at, end)) and m[1] in self.notes:
                out.append(m.span())
                self.used.add(m[1])
                at = m.end()
            else:
                at += 1
        return out

    def _image(self, at: int, end: int) -> int:
        """The end of an image that resolves: inline, or by a reference; 0 if there is none."""
        alt = self._bracket(at + 1, end, "[", "]")
        if not alt:
            return 0
        name = self.text[at + 2 : alt - 1]
        if self.text[alt : alt + 1] == "(" and alt < end and (stop := self._bracket(alt, end, "(", ")")):
            return stop
        if self.text[alt : alt + 1] == "[" and alt < end and (stop := self._bracket(alt, end, "[", "]")):
            label = self.text[alt + 1 : stop - 1] or name
            return stop if _label(label) in self.references else 0
        return alt if _label(name) in self.references else 0

    def _bracket(self, at: int, end: int, opening: str, closing: str) -> int:
        depth = 0
        while at < end:
            c = self.text[at]
            if c == "\\":
                at += 1
            elif c == opening:
                depth += 1
            elif c == closing:
                depth -= 1
                if not depth:
                    return at + 1
            at += 1
        return 0


def leaves(text: str, quotes_included: bool = False) -> list[Leaf]:
    """Leaves in the order of the text, spans in code points, with the exclusions of the default thresholds."""
    out = Parser(text).leaves
    for x in out:
        x.exclusion = exclusion(x.role, x.words, x.terminal, x.containers, quotes_included)
    return out


def exclusion(role: str, words: int, terminal: bool, containers: tuple[str, ...], quotes_included: bool) -> str:
    """The first reason that holds: the role, no words, a list item that is no sentence, the policy on quotes."""
    if role in ROLE_SKIPPED:
        return "excluded-by-role"
    if not words or ("list-item" in containers and not sentential(words, terminal)):
        return "excluded-not-sentential"
    return "excluded-by-block-quote-policy" if "block-quote" in containers and not quotes_included else ""


def sentential(words: int, terminal: bool) -> bool:
    return (terminal and words >= C.MIN_SENTENTIAL) or words >= C.MIN_UNPUNCTUATED


def run_text(text: str, leaf: Leaf) -> str:
    out, at = [], leaf.start
    for a, b in leaf.excisions:
        out.append(text[at : max(at, a)])
        at = max(at, b)
    return unicodedata.normalize("NFC", "".join([*out, text[at : leaf.end]]))


def assembled(text: str, replacements: list[tuple[int, int, str]]) -> str:
    """The text with whole, excision-free included leaves replaced, all or none."""
    known = {(x.start, x.end): x for x in leaves(text)}
    at, out = 0, []
    for a, b, new in sorted(replacements):
        leaf = known.get((a, b))
        if leaf is None or leaf.exclusion or leaf.excisions or a < at:
            raise ValueError(f"{a}:{b} isn't a leaf that can be replaced")
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def spliceable(text: str, start: int, end: int, candidate: str) -> bool:
    """Whether the candidate, put in the leaf's place, is again exactly one included leaf with the same containers."""
    old = {(x.start, x.end): x for x in leaves(text)}.get((start, end))
    if old is None or old.exclusion:
        return False
    after = [x for x in leaves(text[:start] + candidate + text[end:]) if not x.exclusion and x.start < start + len(candidate) and start < x.end]
    return len(after) == 1 and (after[0].start, after[0].end) == (start, start + len(candidate)) and after[0].containers == old.containers


SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_FIELDS = [
    ("doc_id", pa.int64(), "long"), ("ordinal", pa.int32(), "int"), ("role", pa.string(), "string"), ("containers", pa.list_(pa.string()), "array<string>"), ("path", pa.list_(pa.int32()), "array<int>"),
    ("start", pa.int64(), "long"), ("length", pa.int64(), "long"), ("excisions", pa.list_(SPAN), "array<struct<start:long,length:long>>"), ("words", pa.int32(), "int"), ("terminal", pa.bool_(), "boolean"), ("text", pa.string(), "string"),
]
SCHEMA = ", ".join(f"{n} {s}" for n, _, s in _FIELDS)


def parsed(corpus: DataFrame) -> DataFrame:
    """A row per leaf with its evidence; path numbers its containers within the document, from the root (0) down. Spans are bytes."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(columns, _FIELDS, strict=True)], names=[n for n, _, _ in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for whole in batches:
            for key, value in zip(whole.column(0).to_pylist(), whole.column(1), strict=True):
                text = value.as_py() or ""
                found = Parser(text).leaves
                at = ByteOffsets(text, {i for x in found for i in (x.start, x.end, *(i for s in x.excisions for i in s))})
                for k, x in enumerate(found):
                    cut = [{"start": at(a), "length": at(b) - at(a)} for a, b in x.excisions]
                    rows.append((key, k, x.role, list(x.containers), list(x.path), at(x.start), at(x.end) - at(x.start), cut, x.words, x.terminal, run_text(text, x)))
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    return corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def classified(leaves_: DataFrame, quotes_included: bool = False, min_sentential: int = C.MIN_SENTENTIAL, min_unpunctuated: int = C.MIN_UNPUNCTUATED) -> DataFrame:
    """Adds sentential, included and exclusion from the evidence on each leaf; they are replaced where they are there already."""
    words, inside = F.col("words"), lambda kind: F.array_contains("containers", kind)
    whole = (words > 0) & ((F.col("terminal") & (words >= min_sentential)) | (words >= min_unpunctuated))
    quoted: Column = inside("block-quote") & F.lit(not quotes_included)
    reason = (
        F.when(F.col("role").isin(*ROLE_SKIPPED), "excluded-by-role")
        .when((words == 0) | (inside("list-item") & ~whole), "excluded-not-sentential")
        .when(quoted, "excluded-by-block-quote-policy")
        .otherwise("")
    )
    return leaves_.withColumns({"sentential": whole, "exclusion": reason, "included": reason == ""})


def document_leaves(corpus: DataFrame, quotes_included: bool = False, min_sentential: int = C.MIN_SENTENTIAL, min_unpunctuated: int = C.MIN_UNPUNCTUATED) -> DataFrame:
    """Leaves with their inclusion under a policy."""
    return classified(parsed(corpus), quotes_included, min_sentential, min_unpunctuated)


def nodes(corpus: DataFrame, leaves_: DataFrame) -> DataFrame:
    """(doc_id, kind, node, parent, name, start, length): every document's tree.

    A container is numbered as in its leaves' paths and encloses them; the document (0) holds all its bytes, even without leaves, and has no
    parent. Leaves are numbered in order. name: the container's kind or the leaf's role. A container without leaves isn't there.
    """
    step = F.posexplode("path").alias("depth", "node")
    at = leaves_.select("doc_id", "path", "containers", "start", (F.col("start") + F.col("length")).alias("end"), step).where("depth > 0")
    each = at.select("doc_id", "node", F.get("path", F.col("depth") - 1).alias("parent"), F.get("containers", F.col("depth")).alias("name"), "start", "end")
    inner = each.groupBy("doc_id", "node").agg(F.first("parent").alias("parent"), F.first("name").alias("name"), F.min("start").alias("start"), F.max("end").alias("end"))
    inner = inner.select("doc_id", F.lit("container").alias("kind"), "node", "parent", "name", "start", (F.col("end") - F.col("start")).alias("length"))
    zero = F.lit(0).cast("long")
    root = corpus.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit("container").alias("kind"), F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit("document").alias("name"),
        zero.alias("start"), F.coalesce(F.octet_length("text").cast("long"), zero).alias("length"),
    )
    own = leaves_.select("doc_id", F.lit("leaf").alias("kind"), F.col("ordinal").alias("node"), F.element_at("path", -1).alias("parent"), F.col("role").alias("name"), "start", "length")
    return root.unionByName(inner).unionByName(own)


def enclosure(nodes_: DataFrame, rounds: int = 64) -> DataFrame:
    """(doc_id, nodes, reached, outside): nodes of a written table, those that lead up to the root, and those whose span leaves their parent's.

    Paths are followed for all nodes at once, each round going twice as far up.
    """
    up = nodes_.select("doc_id", F.col("node").alias("parent"), F.col("start").alias("up_start"), (F.col("start") + F.col("length")).alias("up_end")).where("kind = 'container'")
    met = nodes_.join(up, ["doc_id", "parent"], "left")
    inside = (F.col("start") >= F.col("up_start")) & (F.col("start") + F.col("length") <= F.col("up_end"))
    out = met.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("parent").isNotNull() & ~F.coalesce(inside, F.lit(False))).alias("outside"))
    state = nodes_.where("parent is not null").select("doc_id", "kind", "node", "parent")
    container = nodes_.where("kind = 'container'").select("doc_id", F.col("node").alias("parent"), F.col("parent").alias("next"))
    for _ in range(rounds):
        if state.where("parent <> 0").isEmpty():
            break
        # who stands above whom, twice as far
        state = state.join(container, ["doc_id", "parent"], "left").select("doc_id", "kind", "node", F.when(F.col("parent") == 0, 0).otherwise(F.col("next")).alias("parent"))
        container = container.alias("a").join(container.select("doc_id", F.col("parent").alias("next"), F.col("next").alias("beyond")).alias("b"), ["doc_id", "next"], "left")
        container = materialize(container.select("doc_id", "parent", F.when(F.col("next") == 0, 0).otherwise(F.col("beyond")).alias("next")), "above")
    reached = state.where("parent = 0").groupBy("doc_id").agg((F.count("*") + 1).alias("reached"))
    return out.join(reached, "doc_id", "left").select("doc_id", "nodes", F.coalesce("reached", F.lit(1)).cast("long").alias("reached"), "outside")


def uniquely_contained(spans: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Adds `candidate` to spans (key, id, start, end): the one candidate (key, id, start, end) that holds a span with room on both sides;
    null if there is none, or more than one.

    Candidates are laid out on bins as long as they are, or up to twice, so that each lies on at most two; a span asks one bin of each size that
    occurs, the one in which it starts. Both sides are dealt out by key, size and bin.
    """
    length = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    level = F.ceil(F.log2(length.cast("double"))).cast("int")
    own = candidates.select(key, F.col("id").alias("candidate"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), level.alias("level"))
    sizes = sorted(r[0] for r in own.select("level").distinct().collect())  # at most 63
    bin_ = lambda x: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    own = own.withColumn("bin", F.explode(F.sequence(bin_("c_start"), bin_("c_end"))))
    asked = spans.select(key, "id", "start", "end", F.explode(F.array(*[F.lit(x) for x in sizes]).cast("array<int>")).alias("level"))
    asked = asked.withColumn("bin", bin_("start"))
    held = asked.join(own, [key, "level", "bin"]).where("c_start < start and end < c_end")
    one = held.groupBy(key, "id").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate")).where("n = 1").drop("n")
    return spans.join(one, [key, "id"], "left")
