"""Quality rule: repetition inside a document, measured with a suffix array.

The suffixes of a text are sorted by prefix doubling; the longest common prefixes of neighbours in
that order bound the LCP intervals, whose members are the occurrences of the maximal repeated
substrings. The deepest interval that holds a suffix is as long as the larger of its two neighbouring
LCPs, and every shallower interval's span at that suffix lies inside it, so the union over all
intervals is the union of one span per suffix.

Only suffixes whose first min_repeat characters occur twice can be in an interval of that depth.
A rolling hash finds them first (equal strings have equal hashes, so none is missed); the doubling
then compares exact ranks, so a hash collision adds work but never a repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import fresh_name, quoted, release, text_batches

MIN_REPEAT = 50  # characters; shorter repeats are ordinary language
MAX_COVERED = 0.40  # fraction of a document's characters inside repeats
MAX_LONGEST = 1000  # characters of the longest repeated substring

_U = np.uint64
_FACTOR = 0xD6E8FEB86659FD93
_SPREAD = _U(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    """One number per character, as small as the text allows."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every window of `length` characters, built from windows of powers of two."""
    level = (codes.astype(_U) + _U(1)) * _SPREAD
    out, done, factor, k = None, 0, _FACTOR, 1
    n = len(codes) - length + 1
    while True:
        if length & k:
            part = level[done : done + n]
            out = part.copy() if out is None else out * _U(factor) + part
            done += k
        if 2 * k > length:
            return out
        level = level[:-k] * _U(factor) + level[k:]
        factor = factor * factor % (1 << 64)
        k *= 2


def _first_ranks(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each suffix by its first k characters, and k: as many as fit in 64 bits."""
    n = len(codes)
    if codes.dtype == np.uint8:
        bits, packed = 8, codes.astype(_U)
    else:
        _, inverse = np.unique(codes, return_inverse=True)
        bits = max(1, int(inverse.max() + 1).bit_length())
        packed = inverse.astype(_U) + _U(1)
    k = 1
    while 2 * k * bits <= 64 and 2 * k <= n:
        after = np.zeros(n, _U)
        after[: n - k] = packed[k:]
        packed = (packed << _U(k * bits)) | after
        k *= 2
    return _ranked(packed), k


def _ranked(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), bool)
    new[:1] = True
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    first = np.flatnonzero(new)
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.repeat(first, np.diff(np.append(first, len(keys))))
    return ranks


def suffix_lcp(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP of each suffix with the one before it; the first is 0)."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks, k = _first_ranks(codes)
    levels = [(k, ranks.astype(np.int32 if n < 2**31 else np.int64))]
    while k < n:
        order = np.argsort(ranks, kind="stable")
        sorted_ranks = ranks[order]
        same = np.zeros(n + 1, bool)
        same[1:n] = sorted_ranks[1:] == sorted_ranks[:-1]
        open_ = order[same[:-1] | same[1:]]  # suffixes still tied with another
        if not len(open_):
            break
        after = np.full(len(open_), -1, np.int64)
        inside = open_ + k < n
        after[inside] = ranks[open_[inside] + k]
        by = np.lexsort((after, ranks[open_])) if n >= 2**31 else np.argsort(ranks[open_] * (n + 1) + after + 1, kind="stable")
        o, base, next_ = open_[by], ranks[open_][by], after[by]
        group = np.empty(len(o), bool)
        group[0] = True
        group[1:] = base[1:] != base[:-1]
        at = np.arange(len(o))
        start = np.maximum.accumulate(np.where(group, at, 0))
        tied = np.zeros(len(o), bool)
        tied[1:] = ~group[1:] & (next_[1:] == next_[:-1])
        ranks = ranks.copy()
        ranks[o] = base + np.maximum.accumulate(np.where(tied, 0, at)) - start
        k *= 2
        levels.append((k, ranks.astype(levels[0][1].dtype)))
    order = np.argsort(ranks, kind="stable")
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for step, rank in reversed(levels):
        live = np.flatnonzero((a < n) & (b < n))
        hit = live[rank[a[live]] == rank[b[live]]]
        common[hit] += step
        a[hit] += step
        b[hit] += step
    step = levels[0][0] // 2
    while step:  # below the first packed length, compare characters
        live = np.flatnonzero((a + step <= n) & (b + step <= n))
        equal = np.ones(len(live), bool)
        for j in range(step):
            equal &= codes[a[live] + j] == codes[b[live] + j]
        hit = live[equal]
        common[hit] += step
        a[hit] += step
        b[hit] += step
        step //= 2
    lcp[1:] = common
    return order, lcp


def repeats(text: str | None, min_repeat: int = MIN_REPEAT) -> tuple[int, int, int]:
    """(characters, characters covered by repeated substrings of min_repeat or more, longest of them)."""
    if not text:
        return 0, 0, 0
    codes = _codes(text)
    n = len(codes)
    if n <= min_repeat:
        return n, 0, 0
    hashes = np.sort(_window_hashes(codes, min_repeat))
    if not (hashes[1:] == hashes[:-1]).any():
        return n, 0, 0
    order, lcp = suffix_lcp(codes)
    deepest = lcp.copy()
    deepest[:-1] = np.maximum(deepest[:-1], lcp[1:])
    hit = deepest >= min_repeat
    if not hit.any():
        return n, 0, 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, order[hit], 1)
    np.add.at(edge, order[hit] + deepest[hit], -1)
    return n, int((np.cumsum(edge[:-1]) > 0).sum()), int(deepest.max())


def repetition(text: Column, min_repeat: int = MIN_REPEAT) -> Column:
    """struct<chars, covered, longest> of a text column; a null or empty text gives zeros."""

    def measure(texts: pa.Array) -> pa.Array:
        rows = [repeats(t.as_py(), min_repeat) for t in texts]
        release()
        parts = zip(*rows) if rows else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], ["chars", "covered", "longest"])

    return F.arrow_udf(measure, "struct<chars:bigint,covered:bigint,longest:bigint>")(text)


def with_repetition(docs: DataFrame, min_repeat: int = MIN_REPEAT) -> tuple[DataFrame, str]:
    text_batches(docs.sparkSession)
    name = fresh_name(docs, "repetition")
    return docs.withColumn(name, repetition(quoted("text"), min_repeat)), name


def passes(measured: Column, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> Column:
    """Whether a measured document keeps both limits; a document without characters does."""
    return (measured["covered"] <= F.lit(max_covered) * measured["chars"]) & (measured["longest"] <= F.lit(max_longest))


def keep_unrepetitive(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of docs, with all their columns, whose text keeps both limits.

    Null and empty texts have no repeats and stay. Repeated rows are judged each by itself, so all of
    them stay or go. Other columns are passed on whatever their names; the only one read is text.
    """
    measured, name = with_repetition(docs, min_repeat)
    return measured.where(passes(F.col(name), max_covered, max_longest)).drop(name)


def repetition_report(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """(doc_id, chars, covered, covered_fraction, longest) of the rows that keep_unrepetitive keeps."""
    text_batches(docs.sparkSession)
    measured = docs.select("doc_id", repetition(quoted("text"), min_repeat).alias("m"))
    m = F.col("m")
    fraction = F.when(m["chars"] > 0, m["covered"] / m["chars"]).otherwise(F.lit(0.0))
    return measured.where(passes(m, max_covered, max_longest)).select("doc_id", m["chars"].alias("chars"), m["covered"].alias("covered"), fraction.alias("covered_fraction"), m["longest"].alias("longest"))
