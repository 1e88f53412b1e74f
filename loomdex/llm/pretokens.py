"""The byte-level pre-tokens of many texts at once, and their encoding once per distinct pre-token.

The pattern of the vocabulary (contractions; letters, digits or other characters after at most one space;
white space) is followed on the UTF-8 bytes of an Arrow column: every byte gets the class of its
character, and pre-tokens begin where the class changes, so nothing is looped over per character or per
pre-token in Python. Pre-tokens are told apart by two 64-bit hashes. Only distinct ones are encoded, and
a process remembers them from one batch to the next.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import regex
import tiktoken
from pyspark import SparkFiles

from loomdex.llm.common import release
from loomdex.llm.shingles import U64, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLOTS = 1 << 19  # places for pre-tokens that a process remembers
TEXT_BYTES = 1 << 20  # bytes of text whose pre-tokens are compared together; a longer text is one such part
HASH_BYTES = 1 << 18  # bytes that are hashed together

LETTER, DIGIT, SPACE, OTHER = range(4)
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a file that every executor sees (or that was added with addFile), read once a process."""
    if path not in _ENCODINGS:
        try:
            lines = open(path, "rb").read()
        except FileNotFoundError:
            lines = open(SparkFiles.get(path.rpartition("/")[2]), "rb").read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point."""
    if not _CLASSES:
        out = np.full(0x110000, OTHER, np.uint8)
        points = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT)):
            for m in regex.finditer(pattern, points):
                out[m.start() : m.end()] = kind
        out[_SPACES] = SPACE
        _CLASSES.append(out)
    return _CLASSES[0]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 texts belongs to."""
    classes = _classes()
    out = classes[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.uint32)
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        for size, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0x100, 0x07)):
            own = (first >= low) & (first < high)
            at = lead[own]
            if len(at):
                point = first[own] & bits
                for k in range(1, size):
                    point = (point << 6) | (padded[at + k] & 0x3F)
                kind = classes[np.minimum(point, 0x10FFFF)]
                for k in range(size):
                    out[np.minimum(at + k, len(data) - 1)] = kind
    return out


def pretoken_starts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the pre-tokens of texts that lie side by side begin, the class of each byte). offsets: where the
    texts begin, the first at 0, and their end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    kind = byte_classes(data)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # where a text begins, and the end
    new |= first[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    kinds = kind[start]
    begins = first[start]  # the run is its text's first
    ends = first[end]
    space = kinds == SPACE
    # a run of white space: its last character is for what follows, if that is a space
    before = np.zeros(len(start), bool)
    before[1:] = space[:-1] & ~begins[1:]
    given = before & ~space & (data[np.maximum(start - 1, 0)] == 32)
    mark = np.zeros(n + 1, bool)
    mark[(start - given)[~space]] = True
    gives = np.zeros(len(start), bool)
    gives[:-1] = given[1:]
    mark[start[space & ~(gives & (end - start == 1))]] = True
    # another last character stands alone, if something follows
    alone = np.flatnonzero(space & ~gives & ~ends)
    if len(alone):
        last = end[alone] - 1
        for _ in range(3):
            last -= (data[last] & 0xC0) == 0x80
        mark[last] = True
    # contractions: an apostrophe that is a run of its own, and the first letters of the next run
    alone = np.flatnonzero((kinds == OTHER) & (end - start == 1) & (data[start] == 39) & ~given & ~ends)
    if len(alone):
        at = alone[kinds[alone + 1] == LETTER]
        a, size = start[at + 1], end[at + 1] - start[at + 1]
        x, y = data[a], data[np.minimum(a + 1, n - 1)]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = (size > 1) & (((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108)))
        hit = one | two
        taken = np.where(two, 2, 1)
        mark[a[hit]] = False
        rest = hit & (size > taken)
        mark[(a + taken)[rest]] = True
    return np.flatnonzero(mark[:n]), kind


class _Powers:
    """Powers of two odd bases and of their inverses modulo 2**64, grown on demand."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self) -> None:
        self.up = [np.ones(1, U64) for _ in self.BASES]
        self.down = [np.ones(1, U64) for _ in self.BASES]

    def get(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        base = self.BASES[which]
        inverse = pow(base, -1, 1 << 64)
        while len(self.up[which]) < n:
            k = len(self.up[which])
            self.up[which] = np.concatenate([self.up[which], self.up[which] * U64(pow(base, k, 1 << 64))])
            self.down[which] = np.concatenate([self.down[which], self.down[which] * U64(pow(inverse, k, 1 << 64))])
        return self.up[which], self.down[which]


_POWERS = _Powers()


def range_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the bytes from each start to the next, the last to the end of data."""
    out = np.empty((2, len(starts)), U64)
    ends = np.append(starts[1:], len(data))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + HASH_BYTES, side="left")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = data[lo:hi].astype(U64) + U64(1)
        a, b = starts[i:j] - lo, ends[i:j] - lo
        for which in (0, 1):
            up, down = _POWERS.get(which, hi - lo + 1)
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum(part * up[: hi - lo], out=sums[1:])
            out[which, i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    # texts of one byte differ in few bits; the lengths tell apart what the sums may not
    size = (ends - starts).astype(U64)
    return out[0] ^ (size << U64(56)), out[1]


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run of a size, one run after another."""
    upto = np.cumsum(size)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begin - (upto - size), size)


class Pieces:
    """Encodes distinct pre-tokens and remembers them: how many ids each has and, if asked, which.

    A table of SLOTS places holds them by hash; what finds its two places taken is encoded anew by each batch."""

    def __init__(self, path: str, keep_ids: bool) -> None:
        self.encode, self.keep = encoding(path).encode_ordinary, keep_ids
        (self.line_end,) = self.encode("\n")
        self.clear()

    def clear(self) -> None:
        self.h1, self.h2 = np.zeros(SLOTS, U64), np.zeros(SLOTS, U64)
        self.size, self.at = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.ids, self.n_ids, self.n = np.zeros(1 << 16, np.uint32), 0, 0

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each pre-token, the ids one after another)."""
        size, ids = np.zeros(len(starts), np.int64), [np.zeros(0, np.uint32)] * len(starts) if blank.any() else []
        words = np.flatnonzero(~blank)
        # words are encoded as lines of one text: a line end is a pre-token and an id of its own
        n = ends[words] - starts[words] + 1
        text = data[np.minimum(_runs(starts[words], n), len(data) - 1)]
        text[np.cumsum(n) - 1] = 10
        got = np.array(self.encode(text.tobytes().decode("utf-8", "replace")), np.uint32)
        line = np.flatnonzero(got == self.line_end)
        size[words] = np.diff(line, prepend=-1) - 1
        flat = got[got != self.line_end]
        if not blank.any():
            return size, flat
        cut = np.cumsum(size[words])[:-1]
        for i, part in zip(words.tolist(), np.split(flat, cut) if len(words) else []):
            ids[i] = part
        for i in np.flatnonzero(blank).tolist():
            ids[i] = np.array(self.encode(data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")), np.uint32)
            size[i] = len(ids[i])
        return size, np.concatenate(ids)

    def _store(self, ids: np.ndarray) -> int:
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        first = self.n_ids
        self.ids[first : first + len(ids)] = ids
        self.n_ids += len(ids)
        return first

    def found(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each pre-token, where they lie in self.ids, number of pre-tokens of each text)."""
        if self.n > SLOTS // 2 or self.n_ids > 8 * SLOTS:
            self.clear()
        starts, kind = pretoken_starts(offsets, data)
        ends = np.append(starts[1:], len(data))
        h1, h2 = range_hashes(data, starts)
        size, at = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
        left = None
        for shift in (0, 40):
            a, b = (h1, h2) if left is None else (h1[left], h2[left])
            slot = ((a >> U64(shift)) & U64(SLOTS - 1)).astype(np.int64)
            hit = (self.h1[slot] == a) & (self.h2[slot] == b) & (self.size[slot] > 0)
            where = np.flatnonzero(hit) if left is None else left[hit]
            size[where], at[where] = self.size[slot[hit]], self.at[slot[hit]]
            left = np.flatnonzero(~hit) if left is None else left[~hit]
        if len(left):
            a, b = h1[left], h2[left]
            order = np.argsort(a)
            if (np.diff(b[order]) != 0)[np.diff(a[order]) == 0].any():  # two pre-tokens with one first hash
                order = np.lexsort((b, a))
            x, y = a[order], b[order]
            new = np.ones(len(order), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            head = left[order[new]]
            blank = kind[ends[head] - 1] == SPACE
            n, ids = self._encoded(data, starts[head], ends[head], blank)
            place = (self._store(ids) if self.keep else 0) + np.cumsum(n) - n
            number = np.cumsum(new) - 1
            size[left[order]], at[left[order]] = n[number], place[number] if self.keep else 0
            self._remember(h1[head], h2[head], n, place)
        return size, at, np.diff(np.searchsorted(starts, offsets))

    def _remember(self, h1: np.ndarray, h2: np.ndarray, size: np.ndarray, at: np.ndarray) -> None:
        todo = np.arange(len(h1))
        for shift in (0, 40):
            slot = ((h1[todo] >> U64(shift)) & U64(SLOTS - 1)).astype(np.int64)
            free = np.flatnonzero(self.size[slot] == 0)
            slots, pick = np.unique(slot[free], return_index=True)
            own = todo[free[pick]]
            self.h1[slots], self.h2[slots], self.size[slots] = h1[own], h2[own], size[own]
            if self.keep:
                self.at[slots] = at[own]
            self.n += len(own)
            rest = np.ones(len(todo), bool)
            rest[free[pick]] = False
            todo = todo[rest]

    def parts(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """found() of runs of texts of about TEXT_BYTES, in order."""
        for a, b in slices(offsets, TEXT_BYTES):
            lo, hi = int(offsets[a]), int(offsets[b])
            yield self.found(offsets[a : b + 1] - lo, data[lo:hi])
        release()


_KEPT: dict[tuple[str, bool], Pieces] = {}


def _pieces(path: str, keep_ids: bool) -> Pieces:
    if (path, keep_ids) not in _KEPT:
        _KEPT[path, keep_ids] = Pieces(path, keep_ids)
    return _KEPT[path, keep_ids]


def _by_text(size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return np.diff(sums[np.concatenate([[0], np.cumsum(per_text)])])


def piece_counts(path: str, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """How many ids each text has: pieces are counted once for each distinct pre-token and added up over the
    pre-tokens of each text. No id is kept."""
    out = [_by_text(size, per_text) for size, _, per_text in _pieces(path, False).parts(offsets, data)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def text_ids(path: str, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of texts one after another, number of ids of each text), by runs of texts in order."""
    pieces = _pieces(path, True)
    for size, at, per_text in pieces.parts(offsets, data):
        yield pieces.ids[_runs(at.astype(np.int64), size.astype(np.int64))], _by_text(size, per_text)


_BYTES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the bytes of all tokens, where each id's begin, how many they are)."""
    if path not in _BYTES:
        enc = encoding(path)
        tokens = [b""] * enc.n_vocab
        for t in enc.token_byte_values():
            tokens[enc.encode_single_token(t)] = t
        size = np.array([len(t) for t in tokens], np.int64)
        _BYTES[path] = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size
    return _BYTES[path]


def decoded(path: str, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of which ids has so many ids each."""
    data, begin, size = _token_bytes(path)
    return data[_runs(begin[ids], size[ids])], np.concatenate([[0], np.cumsum(_by_text(size[ids], counts))])
