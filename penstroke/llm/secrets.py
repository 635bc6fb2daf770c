"""Secret scans: three exact patterns, and a character convolutional network over all other candidates.

The patterns give the base spans. Candidates are what base spans leave of runs of [A-Za-z0-9+/_.=-], where 12
characters and more are left. The network sees a candidate and the characters around it (in windows of 48, of which
a long candidate's highest counts): an embedding, a convolution over 5 characters, the largest and the mean
activation of each filter, and a logistic output. It is trained in numpy on the windows of labelled findings. Its logits
are calibrated on a part of the findings of its own; on another one, neither learnt from nor calibrated on, the
threshold is chosen as candidates are judged, by their highest windows: the highest one, at most `THRESHOLD`, that finds a
wanted share (`recall`) of that part's secrets. Candidates over it become spans of the kind `model`.

Without a table of labelled findings of one's own, findings are generated by rule: random keys of many alphabets, lengths
and prefixes, against words and names built from syllables, constants, UUIDs, short hex ids, numbers, addresses, paths,
dates, versions and file names.

Defined results: null and empty texts have no spans; rows are scanned each on its own, whatever their ids.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, text_of

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of the shortest candidate.
SHORTEST = 12
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
WORDS = ("passw", "secret", "token", "apikey", "api_key")

LEFT, BODY, RIGHT = 24, 48, 8
WIDTH, DIMS, FILTERS = 5, 8, 40
RECALL, THRESHOLD = 0.98, 0.9


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), of each kind leftmost and without overlaps."""
    out, low = [], text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for run in RUN.finditer(text):
        if run.end() - run.start() >= 24:
            out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What the taken spans leave of each run, where it is long enough."""
    out, edges, i = [], [], 0
    for s, e in sorted(t[:2] for t in taken):
        if edges and s <= edges[-1][1]:
            edges[-1] = (edges[-1][0], max(e, edges[-1][1]))
        else:
            edges.append((s, e))
    for run in RUN.finditer(text):
        at, end = run.span()
        while i < len(edges) and edges[i][1] <= at:
            i += 1
        for s, e in takewhile(lambda t: t[0] < end, islice(edges, i, None)):
            if s - at >= SHORTEST:
                out.append((at, s))
            at = e
        if end - at >= SHORTEST:
            out.append((at, end))
    return out


def windows(text: str, a: int, b: int) -> list[np.ndarray]:
    """Codes of a candidate's windows: 0 pads, 1 stands for other than ASCII, 2 and more for printable ASCII; + 100 inside the candidate."""
    low = max(0, a - LEFT)
    point = np.frombuffer(text[low : b + RIGHT].encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where((point >= 32) & (point < 127), point - 30, 1)
    code[a - low : b - low] += 100
    out = []
    for at in [*range(a, b - BODY, BODY // 2), max(b - BODY, a)]:  # the last one ends with the candidate
        whole, end = np.zeros(LEFT + BODY + RIGHT, np.int64), min(at + BODY, b)
        before, body, after = (code[max(x, low) - low : y - low] for x, y in ((at - LEFT, at), (at, end), (end, end + RIGHT)))
        whole[LEFT - len(before) : LEFT], whole[LEFT : LEFT + len(body)] = before % 100, body
        whole[LEFT + BODY : LEFT + BODY + len(after)] = after % 100
        out.append(whole)
    return out


@dataclass
class Net:
    table: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def forward(self, codes: np.ndarray):
        x = self.table[codes]
        n = codes.shape[1] - WIDTH + 1
        cols = np.concatenate([x[:, i : i + n] for i in range(WIDTH)], axis=2)
        h = np.maximum(cols @ self.filters + self.shift, 0)
        pooled = np.concatenate([h.max(1), h.mean(1)], axis=1)
        return pooled @ self.out + self.bias, (cols, h, pooled)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)])
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40)))


def generated_findings(size: int = 16000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): labelled findings by rule."""
    r = random.Random(seed)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = upper + lower + digit
    onsets = ["", *"bcdfghjklmnprstvwz", "st", "tr", "ch", "th", "sh", "br", "pr", "sch", "gr", "pl", "qu", "wh"]
    codas = ["", "", "", *"nrstldmxy", "nt", "st", "ng", "ch", "rs", "ck", "nd", "th", "ble", "ment", "heit"]

    def some(letters: str, low: int, high: int) -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(low, high)))

    def word(low: int = 2, high: int = 9) -> str:
        n, w = r.randint(low, high), ""
        while len(w) < n:
            w += r.choice(onsets) + r.choice(("a", "e", "i", "o", "u", "e", "i", "ie", "ou", "io", "au", "y")) + r.choice(codas)
        return w.capitalize() if r.random() < 0.2 else w

    def words(low: int, high: int, with_what: str) -> str:
        return with_what.join(word(3) for _ in range(r.randint(low, high)))

    def number(low: int, high: int) -> str:
        return some(digit, low, high)

    def name() -> str:
        return r.choice((word(3), word(3).upper(), word(3) + number(1, 4), number(1, 5)))

    def letters() -> str:
        # letters of one case are words, however odd
        of = r.choice((lower, "aeinrstdhulcgmobwfkzpv", "eeeennniiissrratttdhhuulcgmobwfkzpfschtz"))
        w = some(of, 10, 24) + r.choice(("", "tion", "schaft", "lich", "erer"))
        return r.choice((w, w, w.capitalize(), w.upper()))

    def uuid() -> str:
        letters = r.choice(("0123456789abcdef", "0123456789ABCDEF"))
        return "-".join(some(letters, n, n) for n in (8, 4, 4, 4, 12))

    secret = [
        lambda: some(mixed, 20, 44),
        lambda: some(mixed, 20, 64),
        lambda: some(upper + lower, 24, 64),
        lambda: some(mixed, 14, 20),
        lambda: some(mixed, 14, 18),
        lambda: some(mixed + "+/", 38, 88) + "=" * r.randint(0, 2),
        lambda: some(mixed + "_-", 24, 64),
        lambda: some("0123456789ABCDEF", 28, 64),
        lambda: some(upper + digit, 24, 60),
        lambda: some(lower + digit, 24, 40),
        lambda: r.choice(("sk_live_", "sk-", "ghp_", "gho_", "pk_test_", "rk_live_", "glpat-", "xoxb-", "AIza")) + some(mixed, 20, 40),
        lambda: r.choice((some(lower, 2, 5), some(upper, 2, 5), some(upper + lower, 2, 4) + number(1, 2))) + r.choice("_-.") + some(mixed + r.choice(("", "_-")), 20, 44),
        lambda: (r.choice(("", "/", "//")) + words(1, 5, "/").lower())[: r.randint(4, 24)] + r.choice(("", "/", "=")) + some(mixed, 20, 23),
        lambda: "eyJ" + some(mixed, 16, 30) + "." + some(mixed + "_-", 20, 40) + "." + some(mixed + "_-", 20, 40),
    ]
    harmless = [
        lambda: f"{r.choice(('mail', word(), ''))}{number(1, 2)}.{r.choice((word(), 'example'))}.{r.choice(('com', 'org', 'net'))}",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(("", ".", "/" + number(2, 2))),
        lambda: number(12, 30),
        lambda: r.choice("-.").join(number(2, 5) for _ in range(r.randint(3, 6))),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}" + r.choice(("T" + number(2, 2) + "." + number(2, 2) + "Z", "-" + word(4), "_" + number(4, 6))),
        lambda: r.choice(("", "/", "./", "../")) + "/".join(name() for _ in range(r.randint(3, 7))) + r.choice(("", "/", ".txt", ".py", ".html")),
        lambda: f"{word(5)}-{words(1, 2, '-')}-v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
        lambda: word(12, 30) + r.choice(("", ".", "...", number(1, 2))),
        lambda: word(12, 24).upper() + r.choice(("", ".", number(1, 2))),
        lambda: word(12, 24) + "." + word(1, 6),
        lambda: letters() + r.choice(("", "", ".", ".", "...", number(1, 1))),
        lambda: letters() + r.choice(("", ".")),
        lambda: letters() + r.choice(("", ".")),
        lambda: words(2, 4, r.choice("-_./+=")),
        lambda: "_".join(name() for _ in range(r.randint(3, 5))),
        lambda: words(2, 5, "_").upper() + r.choice(("", "_" + number(1, 4))),
        lambda: "_".join(some(upper, 3, 8) for _ in range(r.randint(2, 4))) + r.choice(("", "_" + number(1, 4))),
        uuid,
        uuid,
        lambda: some("0123456789ABCDEF", 12, 22),
        lambda: some("0123456789ABCDEF", 12, 22),
        lambda: some("0123456789ABCDEF", 16, 22),
        lambda: number(13, 19),
        lambda: number(13, 19),
        lambda: number(14, 16),
        lambda: some("0123456789abcdef", 12, 23),
        lambda: "-".join(r.choice((some(upper, 2, 4), number(2, 6))) for _ in range(r.randint(3, 5))),
        lambda: r.choice(("IMG", "DSC", "Screenshot", "report", "scan")) + r.choice("_-") + number(8, 8) + r.choice("_-") + number(4, 6) + r.choice((".jpg", ".png", ".pdf")),
        lambda: r.choice("=-_.+/") * r.randint(12, 60),
        lambda: "...".join(word() + str(r.randint(0, 9)) for _ in range(4)),
        lambda: "".join(word(2, 6).capitalize() + number(1, 2) * (r.random() < 0.2) for _ in range(r.randint(3, 6))),
        lambda: words(2, 4, "").title() if r.random() < 0.3 else "".join(word(3, 9).capitalize() for _ in range(r.randint(2, 4))),
        lambda: word(3).lower() + "".join(word(2, 6).capitalize() for _ in range(r.randint(2, 4))) + r.choice(("", number(1, 2), "." + word(4).lower())),
    ]
    lead = ["key ", "Authorization: Bearer ", "credential -> ", "export KEY=", "private ", "auth ", "access key id ", "the value is ", "set ", '"']
    out = []
    while len(out) < size:
        label = int(len(out) % 2 == 0)
        found = r.choice(secret if label else harmless)()
        before = " ".join(word() for _ in range(r.randint(0, 6)))
        if r.random() < (0.5 if label else 0.2):
            before += " " + r.choice(lead)
        elif before:
            before += r.choice((" ", " ", "\n", "(", "@" if not label else " "))
        after = r.choice((" ", '"', "\n", " . ", ")", ",", "!! ", ",!! ")) + " ".join(word() for _ in range(r.randint(0, 4)))
        style = r.random()
        if style < 0.3:
            before, after = before.replace(" ", r.choice((" ", "!! ", ", ", "\u00fc ", ".\n"))), after.replace("e", r.choice("e\u00e9"))
        if style < 0.15:
            before, after = before.upper(), after.upper()
        text, at = before + found + after, len(before)
        if len(found) >= SHORTEST:
            out.append((text, at, at + len(found), label))
    return out


def train(findings: list[tuple[str, int, int, int]], recall: float = RECALL, epochs: int = 10, seed: int = 5) -> Net:
    """Adam over shuffled batches of the windows of three fifths of the findings; slope and offset from the fourth, the threshold from the last."""
    draw = np.random.default_rng(seed)
    cut = [windows(t, a, b) for t, a, b, _ in findings]
    owner = np.repeat(np.arange(len(findings)), [len(c) for c in cut])
    codes = np.stack([w for c in cut for w in c])
    label = np.asarray([y for *_, y in findings], float)[owner]
    fit, tune, hold = owner % 5 < 3, owner % 5 == 3, owner % 5 == 4
    net = Net(draw.normal(0, 0.3, (200, DIMS)), draw.normal(0, (WIDTH * DIMS) ** -0.5, (WIDTH * DIMS, FILTERS)), np.zeros(FILTERS), draw.normal(0, 0.1, 2 * FILTERS), 0.0)
    net.table[0] = 0
    parts = ["table", "filters", "shift", "out"]
    m, v, step = {p: 0.0 for p in parts}, {p: 0.0 for p in parts}, 0
    learn = np.flatnonzero(fit)
    for epoch in range(epochs):
        pace = 0.01 * (1 - epoch / epochs)
        for at in np.array_split(draw.permutation(learn), max(1, len(learn) // 64)):
            z, (cols, h, pooled) = net.forward(codes[at])
            dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[at]) / len(at)
            dp = dz[:, None] * net.out
            dh = np.repeat(dp[:, None, FILTERS:] / h.shape[1], h.shape[1], axis=1)
            top = h.argmax(1)
            i, j = np.indices(top.shape)
            dh[i, top, j] += dp[:, :FILTERS]
            dh *= h > 0
            dcols = dh @ net.filters.T
            grad = {"filters": np.tensordot(cols, dh, ([0, 1], [0, 1])), "shift": dh.sum((0, 1)), "out": pooled.T @ dz, "table": np.zeros_like(net.table)}
            n = h.shape[1]
            dx = np.zeros((*codes[at].shape, DIMS))
            for k in range(WIDTH):
                dx[:, k : k + n] += dcols[:, :, k * DIMS : (k + 1) * DIMS]
            np.add.at(grad["table"], codes[at], dx)
            grad["table"][0] = 0
            net.bias -= pace * float(dz.sum())
            step += 1
            for p in parts:
                m[p] = 0.9 * m[p] + 0.1 * grad[p]
                v[p] = 0.999 * v[p] + 0.001 * grad[p] ** 2
                setattr(net, p, getattr(net, p) - pace * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.999**step)) + 1e-8))
    z, y = net.forward(codes[tune])[0], label[tune]
    for _ in range(200):  # slope and offset by gradient steps
        off = y - 1 / (1 + np.exp(-np.clip(net.slope * z + net.offset, -40, 40)))
        net.slope += 0.05 * float((off * z).mean()) - 0.0005 * net.slope
        net.offset += 0.5 * float(off.mean())
    highest = np.zeros(len(findings))
    np.maximum.at(highest, owner[hold], net.probability(codes[hold]))
    p = np.sort([highest[i] for i in range(4, len(findings), 5) if findings[i][3] == 1])
    net.threshold = min(THRESHOLD, float(p[int((1 - recall) * len(p))])) if len(p) else THRESHOLD
    return net


@lru_cache(maxsize=1)
def default_net() -> Net:
    return train(generated_findings())


def scan(texts: list[str], net: Net) -> list[list[tuple[int, int, str]]]:
    """All spans (start, end, kind) of each text, by start, then kind."""
    spans = [base_spans(t) for t in texts]
    codes, owner = [], []
    for i, t in enumerate(texts):
        for a, b in candidates(t, spans[i]):
            w = windows(t, a, b)
            codes += w
            owner += [(i, a, b)] * len(w)
    if codes:
        over = net.probability(np.stack(codes)) >= net.threshold
        found = {o for o, x in zip(owner, over.tolist(), strict=True) if x}
        for i, a, b in found:
            spans[i].append((a, b, "model"))
        for i in {i for i, *_ in found}:
            spans[i].sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "<secret>") -> str:
    """The text with every span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, net: Net, batch: int = 512) -> DataFrame:
    """(doc_id, text, spans array) of each row."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, batch):
                part = whole.slice(low, batch)
                spans = scan(part.column(1).to_pylist(), net)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans], kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,kind:string>>")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"), default_net())
    base = F.filter("spans", lambda s: s["kind"] != "model")

    def said(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), counts[3])


def redacted_documents(docs: DataFrame, net: Net, batch: int = 512) -> DataFrame:
    """The rows of documents with their secrets replaced, and n_chars as it then is."""
    at, chars, names = docs.columns.index("text"), docs.columns.index("n_chars"), list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, batch):
                part = whole.slice(low, batch)
                texts = part.column(at).to_pylist()
                spans = scan([t or "" for t in texts], net)
                texts = [redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                counts = [len(t) if s else n for t, s, n in zip(texts, spans, part.column(chars).to_pylist(), strict=True)]
                columns = list(part.columns)
                columns[at], columns[chars] = pa.array(texts, columns[at].type), pa.array(counts, columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(lean(run), docs.schema)
