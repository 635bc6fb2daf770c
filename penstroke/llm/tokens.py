"""Token ids of whole texts by a public byte-level BPE file, each distinct piece of a text encoded once.

The two kinds of files read here cut a text into pieces (runs of letters, numbers and other characters, with the
space before them or not) and encode each piece on its own. Texts of Latin-1 characters are cut by numpy, all
texts of a batch at once; pieces are looked up in a bounded table by a hash, and the bytes of every piece found are
compared with the table's, so that a chance agreement of hashes changes nothing. New pieces are encoded together by `tiktoken` from
the file's own merges, if `sound` holds; otherwise, and for all texts with other characters, control characters or
the string of a special token, the `tokenizers` library encodes the whole text, with add_special_tokens=False and nothing else set.

tiktoken merges any neighbours whose joint string is a token, the library only listed pairs. Both agree if every
token, merged by listed pairs alone, comes out whole: until the first unlisted pair c, d would be merged to T, no
merge crosses the edges of this stretch, so it went as T goes on its own, which passes T's listed pair first and so never
leaves c and d side by side. `sound` checks this for the whole vocabulary, on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Characters that no piece of the fast way may hold: what the libraries might take for white space or not.
_CONTROL = bytes([*range(9), *range(14, 32), *range(127, 160)])
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _classes() -> np.ndarray:
    """The class of each Latin-1 character as in \\p{L}, \\p{N} and \\s."""
    of = np.full(256, OTHER, np.uint8)
    for c in range(256):
        if chr(c) in "\t\n\v\f\r \x85\xa0":
            of[c] = SPACE
        elif chr(c).isalpha():
            of[c] = LETTER
        elif chr(c).isnumeric():
            of[c] = NUMBER
    return of


_CLASS = _classes()


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[s:s+n] for each start and length, one after another."""
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return pool[shift + np.arange(len(shift))]


def _parts(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], bool, list[str]]:
    """(bytes of each token: id, merges, whether pieces end in a mark, special strings). The mark is the byte 0."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    end = model["model"].get("end_of_word_suffix") or ""
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(letters)]
    to_byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {x["content"] for x in model["added_tokens"]}

    def raw(token: str) -> bytes:
        last = bool(end) and token.endswith(end)
        return bytes(to_byte[c] for c in (token[: -len(end)] if last else token)) + b"\x00" * last

    vocab = model["model"]["vocab"]
    nil = {c for c, b in to_byte.items() if b == 0}
    # where pieces end in a mark, tokens with a byte 0 of their own are left out: texts with one aren't encoded by this table
    ranks = {raw(t): i for t, i in vocab.items() if t not in special and not (end and nil & set(t))}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
    return ranks, [(raw(a), raw(b)) for a, b in pairs], bool(end), sorted(special)


@lru_cache(maxsize=8)
def sound(path: str) -> bool:
    """Whether merging by ranks alone gives what the listed merges give, by the argument above, for all tokens."""
    try:
        ranks, merges, marked, _ = _parts(path)
    except (KeyError, ValueError):
        return False
    ids = [ranks.get(a + b) for a, b in merges]
    if None in ids or ids != sorted(ids) or len(set(ids)) != len(ids):
        return False
    order = {m: i for m, i in zip(merges, ids, strict=True)}
    # a piece's last byte is one symbol with the mark, if there are marks
    if marked and any(b"\x00" in t[:-1] for t in ranks):
        return False
    for token in ranks:
        marks = marked and len(token) > 1 and token[-1] == 0
        body = token[:-1] if marks else token
        parts = [bytes([b]) for b in body]
        if marks:
            parts[-1] += b"\x00"
        while len(parts) > 1:
            at, best = -1, None
            for i in range(len(parts) - 1):
                r = order.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    at, best = i, r
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) > 1:
            return False
    return True


class PieceTable:
    """Ids of pieces by a hash of their characters, every piece found being compared with the table's. learn(data, start, end)
    gives the ids of pieces of the codes `data`, one after another, and how many each has; pieces: the most that the table holds."""

    def __init__(self, learn: Callable, pieces: int = 1_000_000):
        self.learn, self.pieces = learn, pieces
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.id_at, self.id_n = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.codes, self.code_at, self.code_n = None, np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        ids, n = self.learn(data, start, end)
        size = end - start
        slot = len(self.id_at) + np.arange(len(start))
        self.id_at, self.id_n = np.append(self.id_at, len(self.ids) + np.cumsum(n) - n), np.append(self.id_n, n)
        codes = self.codes if self.codes is not None else np.empty(0, data.dtype)
        self.code_at, self.code_n = np.append(self.code_at, len(codes) + np.cumsum(size) - size), np.append(self.code_n, size)
        self.ids, self.codes = np.append(self.ids, ids), np.append(codes, ragged(data, start, size))
        hashes, slot = np.append(self.hashes, hashes), np.append(self.slot, slot)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.slot = hashes[order], slot[order]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per text, texts of which a piece's hash was another piece's). The texts' pieces stand before `ends`."""
        size = end - start
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        own = total[1:]
        own[:] = data
        own += np.uint64(1)
        own *= up[: len(data)]
        np.cumsum(own, out=own)
        h = total[end]
        h -= total[start]
        h *= down[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h += size.astype(np.uint64)
        if len(self.slot) > self.pieces:
            self._clear()
        # np.unique would sort stably, at twice the time; any place of a hash will do
        order = np.argsort(h)
        sorted_ = h[order]
        starts = np.ones(len(h), bool)
        np.not_equal(sorted_[1:], sorted_[:-1], out=starts[1:])
        kinds, first, which = sorted_[starts], order[starts], np.empty(len(h), np.int64)
        which[order] = np.cumsum(starts) - 1
        at = np.searchsorted(self.hashes, kinds)
        new = np.ones(len(kinds), bool) if not len(self.hashes) else self.hashes[np.minimum(at, len(self.hashes) - 1)] != kinds
        if new.any():
            self._add(kinds[new], data, start[first[new]], end[first[new]])
            at = np.searchsorted(self.hashes, kinds)
        slot = self.slot[at][which]
        bad = np.flatnonzero(self.code_n[slot] != size)
        if not len(bad) and len(slot):
            differ = ragged(self.codes, self.code_at[slot], size) != ragged(data, start, size)
            bad = np.searchsorted(np.cumsum(size), np.flatnonzero(differ), "right")
        n = self.id_n[slot]
        ids, upto = ragged(self.ids, self.id_at[slot], n), np.concatenate([[0], np.cumsum(n)])
        per = np.diff(upto[np.searchsorted(start, ends)], prepend=0)
        return ids, per, np.unique(np.searchsorted(ends, start[bad]))


class WordEncoder:
    """encode(texts) -> (flat uint32 ids, ids per text). pieces: the most pieces that the table holds; plain: special strings are plain text."""

    def __init__(self, path: str, fast: bool, pieces: int = 1_000_000, plain: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        ranks, _, self.marked, special = _parts(path)
        self.special, self.core = [] if plain else special, None
        if fast:
            import tiktoken

            self.core = tiktoken.Encoding("pieces", pat_str=r"[^\x00]*\x00", mergeable_ranks=self._single(ranks), special_tokens={})._core_bpe
        self.table = PieceTable(self._learn, pieces)

    def _single(self, ranks: dict[bytes, int]) -> dict[bytes, int]:
        if self.marked:
            # the mark alone is a symbol of tiktoken's, never left over, as each byte with its mark is a token before all merges
            return ranks | {b"\x00": ranks.get(b"\x00", max(ranks.values()) + 1)}
        return ranks

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths

    def cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the pieces of Latin-1 codes; texts end at `ends`, each with a zero after it that belongs to no piece."""
        kind = _CLASS[data]
        kind[ends] = 9
        edge = np.empty(len(data), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        if self.marked:
            edge |= kind == NUMBER
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(data))
        own = kind[start]
        # contractions: an apostrophe that starts a run, and the letters that belong to it
        tick = np.flatnonzero((own == OTHER) & (data[start] == 39) & (end - start == 1))
        if not self.marked:
            before = start[tick] - 1
            tick = tick[(before < 0) | (data[before] != 32)]
        tick = tick[tick + 1 < len(start)]
        tick = tick[own[tick + 1] == LETTER]
        if len(tick):
            padded = np.append(data, np.zeros(2, data.dtype))
            a, b = padded[end[tick]], padded[end[tick] + 1]
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            take = np.where(one, 1, np.where(two & (end[tick] + 1 < end[tick + 1]), 2, 0))
            tick, take = tick[take > 0], take[take > 0]
            end[tick] += take
            start[tick + 1] += take
        if self.marked:
            keep = (own != SPACE) & (own != 9) & (start < end)
            return start[keep], end[keep]
        # white space: before a run its last character is the run's if it is a space, else a piece; the rest is one piece
        space = np.flatnonzero(own == SPACE)
        follows = np.append(own, 9)[space + 1] != 9
        last = end[space] - 1
        joins = follows & (data[last] == 32)
        start[space[joins] + 1] -= 1
        rest_end = np.where(follows, last, end[space])
        end[space] = rest_end
        alone = last[follows & ~joins]
        keep = (own != 9) & (start < end)
        start, end = np.append(start[keep], alone), np.append(end[keep], alone + 1)
        order = np.argsort(start, kind="stable")
        return start[order], end[order]

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.marked:
            raw = data.tobytes().decode("latin-1")
            each = [self.core.encode_single_piece(raw[a:b].encode()) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            n = np.fromiter(map(len, each), np.int64, len(each))
            return np.fromiter((i for x in each for i in x), np.uint32, int(n.sum())), n
        size = end - start
        upto = np.cumsum(size + 1)
        codes, own = np.zeros(int(upto[-1]), np.uint8), np.ones(int(upto[-1]), bool)
        own[upto - 1] = False
        codes[own] = ragged(data, start, size)
        ids = np.frombuffer(self.core.encode_to_tiktoken_buffer(codes.tobytes().decode("latin-1"), set()), np.uint32)
        # codes above 127 are two bytes
        wanted = upto + np.cumsum(codes > 127)[upto - 1]
        return ids, np.diff(np.searchsorted(np.cumsum(self._sizes[ids]), wanted, "right"), prepend=0)

    @property
    def _sizes(self) -> np.ndarray:
        if not hasattr(self, "_sizes_of"):
            self._sizes_of = np.zeros(1 << 17, np.int64)
            for raw in self.core.token_byte_values():
                self._sizes_of[self.core.encode_single_token(raw)] = len(raw)
        return self._sizes_of

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per text, texts of which a hash was another piece's)."""
        data = np.frombuffer("\x00".join([*texts, ""]).encode("latin-1"), np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        return self.table.find(data, *self.cut(data, ends), ends)

    def _plain(self, text: str) -> bool:
        """Latin-1 without control characters and strings of special tokens."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return len(raw.translate(None, _CONTROL)) == len(raw) and not any(x in text for x in self.special)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole, fast = [], []
        for i, t in enumerate(texts):
            (fast if self.core is not None and self._plain(t) else whole).append(i)
        per, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        pool = np.empty(0, np.uint32)
        if fast:
            chosen = [texts[i].lower() for i in fast] if self.marked else [texts[i] for i in fast]
            pool, n, bad = self._fast(chosen)
            per[fast], start[fast] = n, np.cumsum(n) - n
            whole += [fast[i] for i in bad.tolist()]
        if whole:
            ids, n = self._by_library([texts[i] for i in whole])
            per[whole], start[whole] = n, len(pool) + np.cumsum(n) - n
            pool = np.append(pool, ids)
            return ragged(pool, start, per), per
        return pool, per


_powers_: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers_ or len(_powers_[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _powers_[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers_[0], _powers_[1]


_encoders: dict[tuple[str, bool, bool], WordEncoder] = {}


def encoder(path: str, fast: bool, plain: bool = False) -> WordEncoder:
    """One for each file in each process; its table lasts from task to task. fast: what `sound` says of the file."""
    if (path, fast, plain) not in _encoders:
        _encoders[path, fast, plain] = WordEncoder(path, fast, plain=plain)
    return _encoders[path, fast, plain]
