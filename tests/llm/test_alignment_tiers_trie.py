"""Alignment, tiered packing and the prefix trie against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from penstroke.llm import alignment, tiers, trie
from tests.llm.test_operators import BYTES, PIECES, documents, prose


# alignment
def aligned_by_hand(rows):
    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in seen)}

    def tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(to_byte[c] for c in a.id_to_token(i))) for i in ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])

    each, count = [], Counter()
    for doc_id, text in rows:
        left, right = tokens(text) if text else ([], [])
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        links = [(x, y) for x, s, e in spans[0] for y, s2, e2 in spans[1] if s < e2 and s2 < e]
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= c) for side in spans))
            low = c
        each.append((doc_id, len(left), len(right), groups, links))
        count.update(links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(
        (
            (d if d is not None else -1, na, nb, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, na, nb, g, x in each
        )
    )


ODD = [None, "", " ", "a", "▁x", "x ▁ y", "<s> </s> <unk> <|endoftext|> <0x41>", "tabs\tand\n\nlines  ", "Ünï 日本語 \U0001f600 é", "\x00nul", "don't  stop!!! 1234567", "word " * 300, "¬" * 50]


@pytest.mark.parametrize("heavy", [1, 8, alignment.HEAVY])
def test_alignment_by_hand(spark, heavy):
    rows = list(enumerate([*prose(12, 4, 1, 40), *ODD])) + [(3, "a"), (None, "a"), (3, "a")]
    found = alignment.aligned(documents(spark, rows), BYTES, PIECES, 500)
    out = alignment.link_scores(found, heavy).collect()
    got = sorted(
        (r["doc_id"] if r["doc_id"] is not None else -1, *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
        for r in out
    )
    assert got == aligned_by_hand(rows)


def test_alignment_of_nothing(spark):
    assert alignment.link_scores(alignment.aligned(documents(spark, []), BYTES, PIECES)).count() == 0
    only = alignment.link_scores(alignment.aligned(documents(spark, [(1, None), (2, "▁")]), BYTES, PIECES)).collect()
    assert [(r["n_a"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in only] == [(0, 0, 0, 0, "")] * 2


def test_a_long_text_aligns_as_its_words_do(spark):
    text = " ".join(prose(40, 6, 100, 200))
    (r,) = alignment.aligned(documents(spark, [(1, text)]), BYTES, PIECES).collect()
    a = Tokenizer.from_file(BYTES).encode(" " + text, add_special_tokens=False).ids
    b = SentencePieceProcessor(model_file=PIECES).encode(text)
    sides = [x.split("|") for x in r["groups"].split(";")]
    assert ",".join(x for x, _ in sides) == ",".join(map(str, a)) and ",".join(y for _, y in sides) == ",".join(map(str, b))
    assert sum(x["times"] for x in r["links"]) == r["n_links"] == len(a) + len(b) - r["n_groups"]


# tiers
def check_pieces(rows, got):
    """Every id in one piece, sequences gapless and of a power of two. (sequence: pieces)."""
    library = Tokenizer.from_file(BYTES)
    want, seen = Counter(), defaultdict(list)
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, len(ids), zlib.crc32(np.asarray(ids, "<u4"))] += 1
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        seen[r["doc_id"]].append(r)
    for of in sequences.values():
        of.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in of] == np.cumsum([0, *[r["length"] for r in of]])[:-1].tolist()
        n = sum(r["length"] for r in of)
        assert n <= 2048 and n & (n - 1) == 0 and {r["sequence_tokens"] for r in of} == {n} and {r["cost"] for r in of} == {sum(r["length"] ** 2 for r in of)}
    by_id = defaultdict(list)
    for d, t in rows:
        by_id[d].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    for d, of in seen.items():
        if len(by_id[d]) == 1:
            ids, at = by_id[d][0], 0
            for r in sorted(of, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.asarray(ids[at : at + r["length"]], "<u4"))
                at += r["length"]
            assert at == len(ids)
        else:
            assert sum(r["length"] for r in of) == sum(map(len, by_id[d]))
    assert set(seen) == set(by_id)
    return sequences


@pytest.mark.parametrize("portion", [700, 5000, tiers.PORTION])
def test_tiers_hold_every_id_once(spark, tmp_path, portion):
    rows = list(enumerate([*prose(60, 8, 1, 700), "word " * 9000, "x" * 30000, "", "<|endoftext|> a"])) + [(None, None), (None, "a b"), (7, "again"), (500, "w " * 2047)]
    found = tiers.tiered(documents(spark, rows).repartition(3), BYTES, portion=portion)
    found.write.parquet(f"{tmp_path}/pieces")
    got = tiers.step_groups(spark.read.parquet(f"{tmp_path}/pieces"), 8192).collect()
    sequences = check_pieces(rows, got)
    steps = defaultdict(Counter)
    for of in sequences.values():
        assert len({r["step_group"] for r in of}) == 1
        steps[of[0]["sequence_tokens"]][of[0]["step_group"]] += 1
    assert len({g for s in steps.values() for g in s}) == sum(map(len, steps.values()))  # a group has one size
    for size, of in steps.items():
        assert max(of.values()) <= 8192 // size and max(of.values()) - min(of.values()) <= 1


def test_costs_of_step_groups_are_balanced(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, 0, n, 0, n, i, 0, 2048, n * n) for i, n in enumerate(r.sample(range(1, 2048), 640))]
    spark.createDataFrame(rows, tiers.ROW).write.parquet(f"{tmp_path}/pieces")
    cost = Counter()
    for x in tiers.step_groups(spark.read.parquet(f"{tmp_path}/pieces")).collect():
        cost[x["step_group"]] += x["cost"]
    assert len(cost) == 20 and max(cost.values()) < 1.05 * min(cost.values())


def test_windows_fill_from_shorter_tiers():
    windows, rest = tiers.packed_tiers([1500, 548, 300, 724, 200, 56, 2048], (2048, 1024, 256))
    assert rest == [] and [(s, [p[0] for p in w]) for s, w in windows] == [(2048, [6]), (2048, [0, 1]), (1024, [3, 2])] + [(256, [4, 5])]
    # nothing shorter: another long document gives its head
    windows, rest = tiers.packed_tiers([1500, 1500], (2048, 1024))
    assert windows == [(2048, [(0, 0, 1500), (1, 0, 548)])] and rest == [(1, 548, 952)]
    r = random.Random(4)
    for _ in range(50):
        lengths = [r.randint(1, 2048) for _ in range(r.randrange(200))]
        windows, rest = tiers.packed_tiers(lengths)
        tail = tiers.falling_powers(rest)
        held = Counter()
        for size, parts in windows + tail:
            assert sum(n for *_, n in parts) == size
            for i, at, n in parts:
                held.update((i, x) for x in (at, at + n))
        assert sum(n for _, parts in windows + tail for *_, n in parts) == sum(lengths)
        for i, n in enumerate(lengths):
            assert held[i, 0] == held[i, n] == 1 and all(c == 2 for (j, x), c in held.items() if j == i and 0 < x < n)
        assert len({s for s, _ in tail}) == len(tail)


def test_tiers_of_nothing(spark):
    empty = tiers.tiered(documents(spark, []), BYTES)
    assert empty.count() == 0 and tiers.step_groups(empty).count() == 0


# trie
def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    new = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        leaves = [q for q in under if not any(len(o) == len(q) + 1 and o[: len(q)] == q for o in nodes)]
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in under)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(members) if len(new[c]) == len(p)).encode()).hexdigest()
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, ends))
    return sorted(out, key=repr)


def trie_rows():
    r = random.Random(7)
    said, rows = ["", "a", "é", "long text " * 20, None], []
    for c in r.sample(range(200), 60):
        for t in range(r.randrange(1, 12)):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", "assistant", None]), r.choice(said)))
    rows += [(300, t, "user", "same") for t in range(70)] + [(305, t, "user", "same") for t in range(65)] + [(301, 0, "user", "x"), (301, 0, "user", "x"), (None, 0, "user", "lost")]
    return rows


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_by_hand_and_by_sql(spark):
    rows = trie_rows()
    df = spark.createDataFrame([(*x, "b", 1) for x in rows], "conv_id long, turn long, role string, text string, digest string, pos int")
    got = sorted((tuple(x[c] for c in NAMES) for x in trie.prefix_trie(df).collect()), key=repr)
    assert got == trie_by_hand(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted((tuple(x) for x in con.execute(f"SELECT {', '.join(NAMES)} FROM ({trie.OP13_SQL})").fetchall()), key=repr) == got


def test_trie_of_copies_and_turnless_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARE", 2)
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = [(c, t, "user", f"{t}") for c in range(0, 300, 5) for t in range(3)] + [(c, t, "user", "z") for c in range(1, 60, 5) for t in range(2)] + [(7001, 0, "u", "only"), (9999, 9, "u", "x")]
    rows += [(40000, t, "user", f"{t}") for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(x[c] for c in NAMES) for x in trie.prefix_trie(df).collect()), key=repr) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).count() == 0 and trie.prefix_trie(df.limit(0)).count() == 0
