"""Hierarchical packing of documents' token ids into context windows of several lengths.

A document goes to the shortest tier whose window holds it; one longer than the longest window is cut
into whole windows and a rest. From the longest tier to the shortest, each document, longest first,
takes the smallest gap that holds it: among the windows of longer tiers, else among its own tier's,
else it opens a window. The windows of each tier are then dealt to steps of equal token budget, so that
the steps of a tier carry nearly the same number of real tokens.

The texts are encoded where they lie and the ids written; they move once, to the group of about GROUP_TOKENS that packs
them. Rows go to groups by a hash of a number of their own, so that neither copies nor a document that is many
rows make a group large: the groups grow in number, not in size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import materialize, quoted, text_batches
from loomdex.llm.pretokens import VOCABULARY
from loomdex.llm.tokens import id_bytes, token_ids

WINDOWS = (2048, 8192, 32768)  # tokens
STEP_TOKENS = 1 << 19
GROUP_TOKENS = 1 << 22
SCHEMA = "pack_group int, window int, window_tokens int, step int, n_tokens int, pieces array<struct<doc_id:bigint,start:bigint,offset:int,n_tokens:int>>, ids binary"


def pack(lengths: Sequence[int], windows: Sequence[int] = WINDOWS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(window of each length, its offset there, the windows' sizes); lengths come longest first and
    none is longer than the longest window."""
    windows = sorted(windows)
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sizes: list[int] = []
    used: list[int] = []
    longer: list[tuple[int, int]] = []  # (gap, window) of the tiers before
    i = 0
    for size, below in zip(reversed(windows), [*reversed(windows[:-1]), 0]):
        own: list[tuple[int, int]] = []
        while i < len(lengths) and lengths[i] > below:
            n = int(lengths[i])
            for gaps in (longer, own):
                k = bisect_left(gaps, (n, -1))
                if k < len(gaps):
                    gap, w = gaps.pop(k)
                    break
            else:
                gaps, gap, w = own, size, len(sizes)
                sizes.append(size)
                used.append(0)
            at[i], offset[i] = w, used[w]
            used[w] += n
            if gap > n:
                insort(gaps, (gap - n, w))
            i += 1
        longer = sorted(longer + own)
    return at, offset, sizes


def steps(sizes: np.ndarray, used: np.ndarray, step_tokens: int = STEP_TOKENS) -> np.ndarray:
    """The step of each window: windows of one size only, at most step_tokens of them together, the
    fullest dealt first, to and fro over the steps."""
    out, first = np.zeros(len(sizes), np.int64), 0
    for size in np.unique(sizes)[::-1]:
        own = np.flatnonzero(sizes == size)
        own = own[np.argsort(-used[own], kind="stable")]
        n = -(-len(own) // max(1, step_tokens // int(size)))
        k = np.arange(len(own))
        turn, place = k // n, k % n
        out[own] = first + np.where(turn % 2 == 0, place, n - 1 - place)
        first += n
    return out


def _packed(windows: Sequence[int], step_tokens: int, width: int):
    def run(rows: pa.Table) -> pa.Table:
        column = {c: rows[c].to_numpy() for c in ("key", "start", "pack_group")}
        data = rows["ids"].combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        raw = np.frombuffer(data.buffers()[2], np.uint8)
        n = np.diff(ends) // width
        # longest first; a null doc_id comes last among equals
        id_, none = rows["doc_id"].fill_null(0).to_numpy(), rows["doc_id"].is_null().to_numpy()
        order = np.lexsort((column["start"], column["key"], id_, none, -n))
        at, offset, sizes = pack(n[order], windows)
        sizes = np.array(sizes, np.int64)
        used = np.bincount(at, weights=n[order], minlength=len(sizes)).astype(np.int64)
        step = steps(sizes, used, step_tokens)
        place = np.lexsort((offset, at))
        own = order[place]  # the rows, window by window
        count = np.bincount(at, minlength=len(sizes))
        flat = np.concatenate([raw[ends[i] : ends[i + 1]] for i in own.tolist()])
        pieces = pa.StructArray.from_arrays([rows["doc_id"].combine_chunks().take(pa.array(own)), pa.array(column["start"][own]), pa.array(offset[place].astype(np.int32)), pa.array(n[own].astype(np.int32))], ["doc_id", "start", "offset", "n_tokens"])
        group = np.full(len(sizes), column["pack_group"][0], np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(used) * width]).astype(np.int32)), pa.py_buffer(flat)])
        columns = [pa.array(group), pa.array(np.arange(len(sizes), dtype=np.int32)), pa.array(sizes.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pieces), ids]
        return pa.table(columns, names=["pack_group", "window", "window_tokens", "step", "n_tokens", "pieces", "ids"])

    return run


def pack_documents(docs: DataFrame, windows: Sequence[int] = WINDOWS, step_tokens: int = STEP_TOKENS, group_tokens: int = GROUP_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(pack_group, window, window_tokens, step, n_tokens, pieces, ids): a row for each window.

    ids has the n_tokens token ids of the window as bytes (see tokens.id_bytes), the rest of window_tokens being
    padding. Each text ends with the id tokens.end_id. pieces says what lies where: n_tokens of the row of doc_id, from
    its token `start` on, at `offset` of the window. Windows and steps are numbered within their pack_group.

    Rows whose text is null or empty have no tokens and are left out. Repeated rows, and rows with one or no
    doc_id, are packed each by itself. Documents of equal length are ordered by doc_id. A very long text is cut at
    whole windows, which are packed wherever. Columns other than doc_id and text are not read. An empty table
    gives an empty one.
    """
    if not windows or min(windows) < 1:
        raise ValueError("windows must be positive")
    if step_tokens < max(windows):
        raise ValueError("a step must hold a window")
    text_batches(docs.sparkSession)
    width, longest = id_bytes(vocabulary), max(windows)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("key"), token_ids(quoted("text"), vocabulary, end=True).alias("ids"))
    rows = materialize(rows.select("*", (F.octet_length("ids") / width).cast("bigint").alias("n")), "ids").where("n > 0")
    groups = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // group_tokens))
    cut = rows.select("doc_id", "key", "ids", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / longest))).alias("k"))
    part = F.substring("ids", (F.col("k") * (longest * width) + 1).cast("int"), F.lit(longest * width))
    placed = cut.select("doc_id", "key", (F.col("k") * longest).alias("start"), part.alias("ids"), F.pmod(F.xxhash64("key", "k"), F.lit(groups)).cast("int").alias("pack_group"))
    return placed.groupBy("pack_group").applyInArrow(_packed(tuple(windows), step_tokens, width), SCHEMA)
