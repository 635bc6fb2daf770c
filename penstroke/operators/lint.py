"""Regex lint rules over whole texts: findings, suppressions, overlap filter, verdicts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .tokens import ByteOffsets, edge


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    pattern: str
    provenance: str = "unvalidated"
    category: str = "author-deviation"
    registers: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.severity not in ("info", "warn", "error") or self.provenance not in ("derived", "unvalidated", "user-defined") or self.category not in ("formatting", "author-deviation", "source-contamination"):
            raise ValueError(f"rule {self.id}: a value outside its vocabulary")
        if self.category == "source-contamination" and self.provenance == "unvalidated":
            raise ValueError(f"rule {self.id}: an unvalidated rule can't claim contamination")
        if re._parser.parse(self.pattern).getwidth()[0] == 0:
            raise ValueError(f"rule {self.id}: it matches the empty text")

    def in_scope(self, register: str | None, author: str | None) -> bool:
        return (not self.registers or register in self.registers) and (not self.authors or author in self.authors)


def default_rules() -> list[Rule]:
    return [Rule(i, s, p, category="formatting" if i == "double-space" else "author-deviation") for i, s, p in C.LINT_RULES]


def _fewest(parsed) -> tuple[str, ...]:
    """Lower-case ASCII literals of which every match of a parsed pattern holds one; none if no such literals are known."""
    options, run = [], ""
    for op, value in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        if run:
            options.append((run,))
        run = ""
        if name == "SUBPATTERN":
            options.append(_fewest(value[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            options.append(_fewest(value[2]))
        elif name == "BRANCH":
            each = [_fewest(x) for x in value[1]]
            options.append(tuple(dict.fromkeys(x for e in each for x in e)) if all(each) else ())
    # the least literal decides; then fewer of them are better
    return max((o for o in options if o), key=lambda o: (min(map(len, o)), -len(o)), default=())


def needed(pattern: str) -> tuple[str, ...]:
    """Literals of which a text, in lower case, holds one wherever the pattern matches; none: they are not known."""
    return _fewest(re._parser.parse(pattern))


#: Letters beyond ASCII that match ASCII ones where case is ignored.
_FOLDED = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")


def lowered(text: str) -> str:
    """Lower case in which literals of `needed` can be looked up."""
    return (text if text.isascii() else text.translate(_FOLDED)).lower()


def _spans(corpus: DataFrame, one: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """(doc_id, start, length, ...) of what `one` finds in each text; it gives spans in code points, which become bytes in one pass a text."""
    key = "string" if dict(corpus.dtypes)["doc_id"] == "string" else "long"
    schema = schema.replace("doc_id long", f"doc_id {key}")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for whole in batches:
            for key, value in zip(whole.column(0).to_pylist(), whole.column(1), strict=True):
                text = value.as_py() or ""
                found = one(text)
                at = ByteOffsets(text, {i for x in found for i in x[:2]})
                for x in found:
                    rows.append((key, at(x[0]), at(x[1]) - at(x[0]), *x[2:]))
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    return corpus.select(F.col("doc_id").cast(key).alias("doc_id"), "text").mapInArrow(run, schema)


def _applied(rules: list[Rule], tag: str) -> Callable[[str], Iterator[tuple]]:
    """(match, state, start and end of the scope in code points) of a text's directives, in order."""
    allow = re.compile(rf'<!--\s*{re.escape(tag)}:allow\s+([^\s>]+)(?:\s+reason="([^"]*)")?\s*-->')
    known = {r.id for r in rules}

    def each(text: str) -> Iterator[tuple]:
        for m in allow.finditer(text):
            low = text.find("\n", m.end()) + 1
            state = "malformed" if not m[2] else "unknown" if m[1] not in known else "applied" if low else "dangling"
            high = text.find("\n", low) if low else -1
            low, high = (low, len(text) if high < 0 else high) if state == "applied" else (m.end(), m.end())
            yield m, state, low, high

    return each


def directives(corpus: DataFrame, rules: list[Rule], tag: str = "lint") -> DataFrame:
    """(doc_id, start, length, rule, reason, state, scope_start, scope_end) of comments `<!-- TAG:allow RULE reason="..." -->`, in bytes.

    state: malformed without a reason, unknown for a rule that isn't there, dangling without a next line, else applied to the next line.
    """
    applied_to = _applied(rules, tag)

    def one(text: str) -> list[tuple]:
        out = []
        for m, state, low, high in applied_to(text):
            # the scope in bytes from the directive's end, as no offset inside it is asked elsewhere
            gap = len(text[m.end() : low].encode("utf-8", "surrogatepass"))
            out.append((m.start(), m.end(), m[1], m[2] or "", state, gap, gap + len(text[low:high].encode("utf-8", "surrogatepass"))))
        return out

    found = _spans(corpus, one, "doc_id long, start long, length long, rule string, reason string, state string, after long, upto long")
    end, applied = F.col("start") + F.col("length"), F.col("state") == "applied"
    return found.withColumns({"scope_start": F.when(applied, end + F.col("after")), "scope_end": F.when(applied, end + F.col("upto"))}).drop("after", "upto")


def findings(corpus: DataFrame, rules: list[Rule], register: str | None = None, author: str | None = None, limit: int = 0, tag: str = "lint", honour: bool = False) -> DataFrame:
    """(doc_id, rule, start, length, severity, provenance, category, widened, truncated, suppressed, reason) in bytes, each rule leftmost without overlaps.

    Spans are widened to whole graphemes. A limit counts a document's findings, suppressed ones too, in the order of rules; truncated says of each
    finding whether its document has more. With `honour` a directive suppresses its rule where it begins on the next line.
    """
    active = [r for r in rules if r.in_scope(register, author)]
    compiled = [(r, re.compile(r.pattern), needed(r.pattern)) for r in active]
    applied_to = _applied(rules, tag)

    def one(text: str) -> list[tuple]:
        out, low_case = [], lowered(text)
        # a directive's scope is a line, so that a finding meets it by where its line begins; the first of several counts
        scopes: dict[tuple[str, int], str] = {}
        for m, state, low, high in applied_to(text) if honour else ():
            if state == "applied" and low < high:
                scopes.setdefault((m[1], low), m[2])
        for rule, pattern, literals in compiled:
            if literals and not any(x in low_case for x in literals):
                continue
            for m in pattern.finditer(text):
                low, high = edge(text, m.start(), -1), edge(text, m.end(), 1)
                reason = scopes.get((rule.id, text.rfind("\n", 0, m.start()) + 1)) if scopes and text[m.start()] != "\n" else None
                out.append((low, high, rule.id, rule.severity, rule.provenance, rule.category, (low, high) != m.span(), reason is not None, reason))
                if limit and len(out) > limit:
                    return [(*x, True) for x in out[:limit]]
        return [(*x, False) for x in out]

    schema = "doc_id long, start long, length long, rule string, severity string, provenance string, category string, widened boolean, suppressed boolean, reason string, truncated boolean"
    return _spans(corpus, one, schema).select("doc_id", "rule", "start", "length", "severity", "provenance", "category", "widened", "truncated", "suppressed", "reason")


def without_overlaps(found: DataFrame) -> DataFrame:
    """Findings kept: when the start changes, one that starts before the end of those kept goes; others at that start stay."""
    listed = found.where("not suppressed").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "rule"))).alias("fs"))
    kind = "struct<at:bigint,upto:bigint,kept:array<struct<start:bigint,length:bigint,rule:string>>>"
    zero = F.expr(f"cast(struct(-1, -1, array()) as {kind})")

    def step(a: Column, f: Column) -> Column:
        dropped = (f["start"] != a["at"]) & (f["start"] < a["upto"])
        return F.when(dropped, F.struct(f["start"].alias("at"), a["upto"].alias("upto"), a["kept"].alias("kept"))).otherwise(
            F.struct(f["start"].alias("at"), F.greatest(a["upto"], f["start"] + f["length"]).alias("upto"), F.concat(a["kept"], F.array(f)).alias("kept"))
        ).cast(kind)

    kept = F.aggregate("fs", zero, step)["kept"]
    return listed.select("doc_id", F.explode(kept).alias("f")).select("doc_id", "f.start", "f.length", "f.rule")


def counts(corpus: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rule, n) for rules that match, counted in the engine without Python."""
    # as a generator's output lower case is made once a text
    texts = corpus.select("doc_id", "text", F.explode(F.array(F.lower("text"))).alias("_low"))

    def count(r: Rule) -> Column:
        n = F.regexp_count("text", F.lit(r.pattern))
        literals = needed(r.pattern)
        return F.when(reduce(or_, [F.contains("_low", F.lit(x)) for x in literals]), n).otherwise(0) if literals else n

    each = F.array(*[F.struct(F.lit(r.id).alias("rule"), count(r).alias("n")) for r in rules])
    return texts.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.rule", "x.n").where("n > 0")


def severity_vector(found: DataFrame) -> DataFrame:
    """(doc_id, errors, warns, infos, screening): only derived rules on deviation or contamination count; it never says clean."""
    fit = (F.col("provenance") == "derived") & F.col("category").isin("author-deviation", "source-contamination")
    v = found.groupBy("doc_id").agg(*[F.count_if(fit & (F.col("severity") == s)).alias(f"{s}s") for s in ("error", "warn", "info")])
    return v.withColumn("screening", F.when(F.col("errors") + F.col("warns") + F.col("infos") > 0, "flagged").otherwise("indeterminate"))


def no_worse(a: str = "a", b: str = "b") -> Column:
    """Whether severity vector a is lexicographically at most b."""
    return F.struct(*[F.col(f"{a}.{c}") for c in ("errors", "warns", "infos")]) <= F.struct(*[F.col(f"{b}.{c}") for c in ("errors", "warns", "infos")])


def comparable(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, comparable, comparison) of two sides' reports (doc_id, errors, warns, infos, truncated, rules): only whole reports by the same rules can be
    compared; comparison is 1 if b has more than a, in the order of severities, -1 if it has less."""
    j = a.alias("a").join(b.alias("b"), "doc_id")
    can = ~F.col("a.truncated") & ~F.col("b.truncated") & F.col("a.rules").eqNullSafe(F.col("b.rules"))
    old, new = (F.struct(*[F.col(f"{x}.{c}") for c in ("errors", "warns", "infos")]) for x in "ab")
    return j.select("doc_id", can.alias("comparable"), F.when(can, F.when(new > old, 1).when(new < old, -1).otherwise(0)).alias("comparison"))


def rule_set_id(rules: list[Rule]) -> str:
    """A digest of a set of rules that doesn't depend on their order."""
    rows = sorted(json.dumps([r.id, r.severity, r.pattern, r.provenance, r.category, sorted(r.registers), sorted(r.authors)], ensure_ascii=False) for r in rules)
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()
