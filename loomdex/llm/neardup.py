"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its lower-cased word 3-grams. A first permutation (the mixed 64-bit gram
hash, cut to LOG_UNIVERSE bits) places each gram on a circle of 2**LOG_UNIVERSE slots; a second, one
fixed permutation of the circle, is read circularly shifted by k for coordinate k, so the whole
signature of a gram is one contiguous slice of that permutation and a document's signature is the
minimum over its slices. BANDS bands of ROWS coordinates give the buckets.

Documents with equal sets are joined first, by a 128-bit key of the set. Each bucket of the rest is
then compared with its least document (as many pairs as members, not their square); whatever pairs of
a bucket are not connected by then are all compared. So the groups are exactly the connected
components of "shares a bucket and has Jaccard >= threshold", however large a bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import discard, materialize, one_row_per_id, quoted, release, small_side, text_batches, with_aggregates
from loomdex.llm.components import components
from loomdex.llm.shingles import U64, grams, mix64, slices, string_buffers, words

GRAM = 3  # words in a shingle
BANDS = 32
ROWS = 4
THRESHOLD = 0.6
LOG_UNIVERSE = 22
SEED = 20240229
SALT_MEMBERS = 4096  # members compared with one bucket's least document in one task, about
_SLICE = 1 << 16  # bytes of text hashed at once

_CIRCLE: dict[tuple[int, int], np.ndarray] = {}


def circle(n_coordinates: int) -> np.ndarray:
    """Row s holds the second permutation's values at slots s, s+1, ... around the circle."""
    key = (SEED, n_coordinates)
    if key not in _CIRCLE:
        pi = np.random.default_rng(SEED).permutation(1 << LOG_UNIVERSE).astype(np.int32)
        _CIRCLE[key] = sliding_window_view(np.concatenate([pi, pi[:n_coordinates]]), n_coordinates)
    return _CIRCLE[key]


def gram_sets(column: pa.Array, n: int = GRAM) -> Iterator[np.ndarray]:
    """The sorted distinct gram hashes of each text; empty for a null text or one without words."""
    offsets, data = string_buffers(column)
    for a, b in slices(offsets, _SLICE):
        hashes, counts = grams(*words(offsets[a : b + 1], data), n)
        end = 0
        for c in counts.tolist():
            start, end = end, end + c
            yield np.unique(hashes[start:end])


def signature(grams_: np.ndarray, n_coordinates: int = BANDS * ROWS) -> np.ndarray:
    """All coordinates of one non-empty set."""
    slots = (grams_ >> U64(64 - LOG_UNIVERSE)).astype(np.int64)
    rows, out = circle(n_coordinates), None
    for k in range(0, len(slots), 1 << 15):  # a very long text in parts, as each gram takes a whole row
        part = rows[slots[k : k + (1 << 15)]].min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band of each signature; the band's number is part of it."""
    rows = signatures.shape[1] // bands
    values = signatures.astype(U64).reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0xA24BAED4963EE407), values.shape[:2]).copy()
    for j in range(rows):
        keys = mix64(keys ^ (values[:, :, j] + U64(0x9E3779B97F4A7C15)))
    return keys.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes = [], []
        k1, k2, sigs = [], [], []
        all_ids = batch.column(0)
        for i, s in enumerate(gram_sets(batch.column(1))):
            if not len(s):
                continue
            ids.append(i)
            sizes.append(len(s))
            k1.append(int(np.bitwise_xor.reduce(mix64(s + U64(1))).view(np.int64)))
            k2.append(int(np.add.reduce(mix64(s ^ U64(0x5851F42D4C957F2D))).view(np.int64)))
            sigs.append(signature(s))
        release()
        if not ids:
            continue
        keys = band_keys(np.stack(sigs))
        flat = pa.array(keys.reshape(-1))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([all_ids.take(pa.array(ids)), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int64()), bands], ["doc_id", "k1", "k2", "n_grams", "bands"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))


def equal_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, same, copied, n_grams, bands), written: `same` is the least document with an equal set of grams, copied
    whether there is another; bands only where `same` is the document itself."""
    signed = materialize(_texts(docs).mapInArrow(_signed, "doc_id bigint, k1 bigint, k2 bigint, n_grams bigint, bands array<bigint>"), "signed")
    ids = with_aggregates(signed.select("doc_id", "k1", "k2", "n_grams", "bands"), "k1", ["k1", "k2"], same=("min", "doc_id"), most=("max", "doc_id"))
    out = ids.select("doc_id", "same", (F.col("same") != F.col("most")).alias("copied"), "n_grams", F.when(F.col("doc_id") == F.col("same"), F.col("bands")).alias("bands"))
    out = materialize(out, "signatures")
    discard(signed)
    return out


def buckets(signed: DataFrame) -> DataFrame:
    """(bucket, doc, n_grams, least, least_grams) of every bucket with at least two documents, written."""
    rows = signed.where(F.col("bands").isNotNull()).select(F.col("doc_id").alias("doc"), "n_grams", F.explode("bands").alias("bucket"))
    rows = with_aggregates(rows.withColumn("own", F.struct("doc", "n_grams")), "bucket", ["bucket"], first=("min", "own"), most=("max", "doc"))
    return materialize(rows.where("first.doc <> most").select("bucket", "doc", "n_grams", F.col("first.doc").alias("least"), F.col("first.n_grams").alias("least_grams")), "buckets")


def comparable(n: Column, other: Column, threshold: float) -> Column:
    """Whether sets of these sizes can have a Jaccard of threshold: it is at most the lesser over the greater."""
    return F.least(n, other) >= F.lit(threshold) * F.greatest(n, other)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            salts = batch.column(2).to_pylist()
            found_a, found_b = [], []
            for i, s in enumerate(gram_sets(batch.column(3))):
                if a[i] == b[i]:
                    key, pivot = (a[i], salts[i]), s
                elif key == (a[i], salts[i]):
                    both = len(s) + len(pivot)
                    most = min(len(s), len(pivot))
                    if both and most >= threshold * (both - most):
                        common = len(np.intersect1d(s, pivot, assume_unique=True))
                        if common >= threshold * (both - common):
                            found_a.append(a[i])
                            found_b.append(b[i])
            release()
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The rows of pairs(a, b), distinct and written, whose documents have Jaccard >= threshold; written.

    Each document's text is sent to its partners' tasks; a document with many partners is spread over
    several tasks, each of which gets its text."""
    n = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / SALT_MEMBERS).cast("int").alias("parts"))
    salted = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    heads = n.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    ask = materialize(salted.union(heads), "compare")
    need = materialize(ask.select(F.col("b").alias("doc_id")).distinct(), "compare-docs")
    texts = _texts(docs).join(small_side(need), "doc_id", "left_semi").withColumnRenamed("doc_id", "b")
    rows = ask.join(texts, "b").select("a", "b", "salt", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b"))
    return materialize(rows.mapInArrow(_verify(threshold), "a bigint, b bigint").distinct(), "verified")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id) of every document that has a near-duplicate, group_id being the least doc_id
    of its group, whose own row is among them.

    Null and empty texts, and texts of white space only, are compared with nothing. A null doc_id is
    left out. Rows that repeat a doc_id count as one document, that of the greatest text. Texts of fewer words than a shingle are compared as a
    whole, and so is a text of any length, by one task each time. Words end at white space of any kind; in scripts
    without spaces a character is a word. Groups of copies and buckets of any size are dealt with without being
    gathered in a task. Columns other than doc_id and text are not read. An empty table gives an empty one.
    """
    return _groups(one_row_per_id(docs.where(F.col("doc_id").isNotNull()).select("doc_id", quoted("text").alias("text"))), threshold)


def _groups(docs: DataFrame, threshold: float) -> DataFrame:
    """near_duplicates of rows that do not repeat a doc_id."""
    text_batches(docs.sparkSession)
    signed = equal_sets(docs)
    spread = buckets(signed)
    star = materialize(spread.where("doc <> least").where(comparable(F.col("n_grams"), F.col("least_grams"), threshold)).select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct(), "pairs")
    edges = verified(docs, star, threshold)
    labels = components(edges)
    # what the stars left apart: every pair of a bucket whose components still differ
    named = spread.join(labels, F.col("doc") == F.col("node"), "left").select("bucket", "doc", "n_grams", F.coalesce("label", "doc").alias("label"))
    named = materialize(named, "named")
    open_ = materialize(with_aggregates(named, "bucket", ["bucket"], lo=("min", "label"), hi=("max", "label")).where("lo <> hi").select("bucket", "doc", "n_grams", "label"), "open")
    left, right = open_.alias("x"), open_.alias("y")
    both = left.join(right, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") < F.col("y.label")) & comparable(F.col("x.n_grams"), F.col("y.n_grams"), threshold))
    rest = both.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
    rest = materialize(rest.join(star, ["a", "b"], "left_anti"), "pairs")
    edges = edges.union(verified(docs, rest, threshold))
    labels = components(edges).withColumnRenamed("node", "same")
    # copies take the label of their set's least document
    found = signed.select("doc_id", "same", "copied").join(labels, "same", "left").where("copied or label is not null")
    found = materialize(found.select("doc_id", F.coalesce("label", "same").alias("group_id")).distinct(), "groups")
    discard(spread, star, named, open_, rest)
    return found


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each group: that with the least
    doc_id. Of rows that repeat a doc_id, one stays (they count as one document), that of the greatest text if
    they differ. Rows with a null doc_id, and null or empty texts, have no group and stay. Otherwise as in
    near_duplicates; an empty table gives an empty one."""
    once = one_row_per_id(docs)
    drop = materialize(_groups(once, threshold).where("doc_id <> group_id").select("doc_id"), "dropped")
    return once.join(small_side(drop), "doc_id", "left_anti").select(*map(quoted, docs.columns))
