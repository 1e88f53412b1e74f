"""Mixing sources to target weights, by blocks of token ids.

The texts are encoded once, where they lie. The tokens of each source, its documents one after another as they
are stored, are cut into blocks of BLOCK ids. Each output shard of SLOTS slots draws how many come from each
source (multinomial, by the target weights) and shuffles them over its slots. The k-th slot of a source in
the whole output takes block permutation(k mod n) of its n blocks; each pass over a source has another
permutation, a Feistel network, so no list of blocks is ever shuffled. Slots and blocks are joined by
(source, block); the ids move once, to their block, whatever source or document they are of.

Where a document lies in its source is a running count: within a task as it reads, and over tasks by a table
with a row for each task and source.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.llm.common import materialize, quoted, small_side, text_batches
from loomdex.llm.pretokens import VOCABULARY, decoded
from loomdex.llm.shingles import U64, mix64
from loomdex.llm.tokens import id_bytes, ids_array

BLOCK = 2048  # tokens
SLOTS = 512  # blocks in an output shard
TEMPERATURE = 0.7  # default target weights: token counts to this power
SEED = 1234
TASK_SHARDS = 64  # output shards that one task draws
CHUNK_SHARDS = 4096  # output shards whose running slot counts one task keeps
PASSES = 16  # passes over a source whose slots meet a copy of its blocks; a source that is repeated more has more copies


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n), chosen by key, at each index: a four-round Feistel
    network over the least even number of bits that hold n, walked until it falls below n."""
    index, n, key = index.astype(U64), n.astype(U64), key.astype(U64)
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, U64(2)).astype(float))).astype(np.int64) + 1) // 2).astype(U64)
    mask = (U64(1) << bits) - U64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> bits[todo], out[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (mix64(right + key[todo] * U64(0x9E3779B97F4A7C15) + U64((r + 1) * 0xD1B54A32D192ED03 % (1 << 64))) & mask[todo])
        out[todo] = (left << bits[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _name(docs: DataFrame) -> Column:
    return F.coalesce(quoted("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def _placed(vocabulary: str):
    """Encodes texts, and counts on for each source over the batches of a task."""

    def run(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        width, reached = id_bytes(vocabulary), {}
        part = TaskContext.get().partitionId()
        for names, texts in batches:
            ids = ids_array(texts, vocabulary)
            n = np.diff(np.frombuffer(ids.buffers()[1], np.int32)) // width
            first = np.zeros(len(n), np.int64)
            coded = names.dictionary_encode()
            of = coded.indices.to_numpy(zero_copy_only=False)
            for k, name in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(of == k)
                upto = np.cumsum(n[own]) + reached.get(name, 0)
                first[own] = upto - n[own]
                reached[name] = int(upto[-1])
            yield pa.StructArray.from_arrays([ids, pa.array(n, pa.int64()), pa.array(first), pa.array([part] * len(n), pa.int32())], ["ids", "n", "first", "part"])

    return run


def positions(docs: DataFrame, carried: Column, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(rows of carried, name, ids, n, first for each row of docs with tokens; name, total for each source): `first` is
    where its tokens begin in its source's. The rows are written; no text moves."""
    t = F.arrow_udf(_placed(vocabulary), "struct<ids:binary,n:bigint,first:bigint,part:int>")(_name(docs), quoted("text"))
    placed = materialize(docs.select(carried.alias("carried"), _name(docs).alias("name"), t.alias("t")).select("carried", "name", "t.*"), "ids").where("n > 0")
    tasks = placed.groupBy("name", "part").agg(F.max(F.col("first") + F.col("n")).alias("upto"))
    tasks = materialize(tasks, "tasks")  # a row a task and source
    before = tasks.select("name", "part", (F.sum("upto").over(W.partitionBy("name").orderBy("part")) - F.col("upto")).alias("before"))
    where = placed.join(small_side(materialize(before, "before")), ["name", "part"])
    return where.select("carried", "name", "ids", "n", (F.col("before") + F.col("first")).alias("first")), tasks.groupBy("name").agg(F.sum("upto").alias("total"))


def target_weights(totals: dict[str, int], weights: dict[str, float] | None) -> dict[str, float]:
    """Weights of the sources that have tokens, adding up to 1. Sources that weights leaves out get 0."""
    if weights is None:
        raw = {s: float(t) ** TEMPERATURE for s, t in totals.items()}
    else:
        if any(not w >= 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        raw = {s: float(weights.get(s, 0.0)) for s in totals}
    whole = sum(raw.values())
    if totals and not whole > 0:
        raise ValueError("no source with tokens has a weight")
    return {s: w / whole for s, w in raw.items()}


def slot_plan(totals: dict[str, int], spark, weights: dict[str, float] | None = None, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, dict[str, int]]:
    """((shard, slot, name, pass, block) for every slot of the output, which has as many slots as the sources of
    totals, their numbers of tokens, have blocks; how often each source is passed over)."""
    names = sorted(totals)
    number = {s: i for i, s in enumerate(names)}
    blocks = {s: -(-totals[s] // block) for s in names}
    n_slots = sum(blocks.values())
    p = target_weights(totals, weights)
    p = np.array([p[s] for s in names])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                rng = np.random.default_rng([seed, int(shard)])
                k = min(slots, n_slots - int(shard) * slots)
                counts = rng.multinomial(k, p)
                order = rng.permutation(np.repeat(np.arange(len(names)), counts))
                for i in np.flatnonzero(counts):
                    yield pd.DataFrame({"shard": [shard], "name": [names[i]], "count": [counts[i]], "at": [np.flatnonzero(order == i).astype(np.int32)]})

    n_shards = -(-n_slots // slots)
    shards = spark.range(0, n_shards, 1, max(1, -(-n_shards // TASK_SHARDS)))
    drawn = shards.mapInPandas(draw, "shard bigint, name string, count bigint, at array<int>")
    counts = shards.mapInPandas(lambda batches: (b[["shard", "name", "count"]] for b in draw(batches)), "shard bigint, name string, count bigint")
    counts = counts.withColumn("chunk", F.floor(F.col("shard") / CHUNK_SHARDS))
    chunks = materialize(counts.groupBy("name", "chunk").agg(F.sum("count").alias("whole")), "chunks")
    passes = {r["name"]: -(-r["n"] // blocks[r["name"]]) for r in chunks.groupBy("name").agg(F.sum("whole").alias("n")).collect()}  # a row a source
    chunks = chunks.select("name", "chunk", (F.sum("whole").over(W.partitionBy("name").orderBy("chunk")) - F.col("whole")).alias("passed"))
    inner = F.sum("count").over(W.partitionBy("name", "chunk").orderBy("shard")) - F.col("count")
    before = counts.withColumn("inner", inner).join(chunks, ["name", "chunk"]).select("shard", "name", (F.col("passed") + F.col("inner")).alias("before"))
    rows = drawn.join(before, ["shard", "name"]).select("shard", "name", "before", F.posexplode("at").alias("i", "slot"))

    def look_up(name: pa.Array, k: pa.Array) -> pa.Array:
        name, k = name.to_pylist(), k.to_numpy(zero_copy_only=False)
        n = np.array([blocks[s] for s in name], np.int64)
        turn = k // np.maximum(n, 1)
        key = np.array([number[s] for s in name], np.int64) * 1_000_003 + turn * 7919 + seed
        at = permute(k - turn * n, n, key)
        return pa.StructArray.from_arrays([pa.array(turn), pa.array(at)], ["pass", "block"])

    found = F.arrow_udf(look_up, "struct<pass:bigint,block:bigint>")(F.col("name"), F.col("before") + F.col("i"))
    return rows.select("shard", "slot", "name", found.alias("b")).select("shard", "slot", "name", "b.pass", "b.block"), passes


def pieces(where: DataFrame, block: int = BLOCK, width: int = 2) -> DataFrame:
    """(carried, name, block, at, inner, part, tail): of positions' rows, the ids of each document that lie in
    each block, from its token `at` on; inner: the piece does not begin its document; tail: the three ids after it."""
    first, last = F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("n") - 1) / block)
    rows = where.select("*", F.explode(F.sequence(first, last)).alias("block"))
    start = F.col("block") * block
    lo = F.greatest(start - F.col("first"), F.lit(0).cast("bigint"))
    hi = F.least(start + block - F.col("first"), F.col("n"))

    def cut(a: Column, n: Column | int) -> Column:
        return F.substring(F.col("ids"), (a * width + 1).cast("int"), (n * width).cast("int"))

    return rows.select("carried", "name", "block", (F.col("first") + lo - start).alias("at"), (lo > 0).alias("inner"), cut(lo, hi - lo).alias("part"), cut(hi, F.lit(3)).alias("tail"))


def _salted(rows: DataFrame, passes: dict[str, int]) -> DataFrame:
    """rows(name, block, ...) with `copy`: as many copies of a source's blocks as its slots are dealt to, by their pass, so
    that a source that is repeated without end is many tasks' work."""
    copies = rows.sparkSession.createDataFrame([(s, -(-n // PASSES)) for s, n in sorted(passes.items())], "name string, copies int")  # a row a source
    return rows.join(small_side(copies), "name").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")


def _drawn(salted: DataFrame, plan: DataFrame) -> DataFrame:
    """_salted's rows joined to the slots of plan. Rows that are grouped by (name, block, copy) lie right for it."""
    return salted.join(plan.withColumn("copy", F.floor(F.col("pass") / PASSES).cast("int")), ["name", "block", "copy"]).drop("copy")


def _texts(vocabulary: str):
    """The texts of pieces: a character that a block's border divides belongs to the piece that it begins in."""

    def run(part: pa.Array, tail: pa.Array, inner: pa.Array) -> pa.Array:
        width = id_bytes(vocabulary)

        def parts(column: pa.Array) -> tuple[bytes, np.ndarray]:
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            data, offsets = decoded(vocabulary, raw.view(f"<u{width}") if at[0] % width == 0 else np.frombuffer(raw.tobytes(), f"<u{width}"), np.diff(at) // width)
            return data.tobytes(), offsets

        (own, a), (after, b) = parts(part), parts(tail)
        out = []
        for i, within in enumerate(inner.to_pylist()):
            lo, end = int(a[i]), int(a[i + 1])
            while within and lo < end and own[lo] & 0xC0 == 0x80:
                lo += 1
            more, stop = int(b[i]), int(b[i + 1])
            while more < stop and after[more] & 0xC0 == 0x80:
                more += 1
            out.append((own[lo:end] + after[int(b[i]) : more] if lo < end else b"").decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return run


def _planned(docs: DataFrame, carried: Column, weights, block: int, slots: int, seed: int, vocabulary: str):
    text_batches(docs.sparkSession)
    where, totals = positions(docs, carried, vocabulary)
    totals = {r["name"]: int(r["total"]) for r in totals.collect()}  # a row a source
    plan, passes = slot_plan(totals, docs.sparkSession, weights, block, slots, seed)
    return pieces(where, block, id_bytes(vocabulary)), plan, passes


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mixture as rows with the columns of docs: a row for each piece of a document in a drawn
    block, its text (and n_chars) cut to the piece.

    A source that is weighted up repeats its blocks, one that is weighted down leaves some out; the
    output has as many blocks as the input. A null source counts as the source of the empty name. Rows
    whose text is null or empty hold no tokens and are left out; rows with a null doc_id, and each of rows
    that repeat one another, are documents like any. A very long text is cut into its blocks by one task,
    but each of them goes its own way. Where a block's border divides a character, the character goes to the
    piece that it begins in (and a piece that is left with nothing is left out). Columns of any name are
    passed on. An empty table gives an empty one.
    """
    carried = F.struct(*[quoted(c) for c in docs.columns if c != "text"], F.lit(0).alias(_spare(docs)))
    rows, plan, passes = _planned(docs, carried, weights, block, slots, seed, vocabulary)
    drawn = _drawn(_salted(rows.select("carried", "name", "block", "inner", "part", "tail"), passes), plan)
    text = F.arrow_udf(_texts(vocabulary), "string").asNondeterministic()  # else it is evaluated before the join too, to filter
    rows = drawn.select("carried", text(F.col("part"), F.col("tail"), F.col("inner")).alias("cut")).where("cut <> ''")
    return rows.select(*[F.col("cut").alias("text") if c == "text" else F.length("cut").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("carried").getField(c).alias(c) for c in docs.columns])


def _spare(docs: DataFrame) -> str:
    """A field that keeps the struct of carried columns from being empty."""
    return "spare" + "_" * max(len(c) for c in docs.columns)


def mixed_blocks(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """(shard, slot, source, pass, block, n_tokens, doc_ids, ids): the mixture, a row a slot. ids are the block's token
    ids as bytes (see tokens.id_bytes), of the documents of doc_ids one after another. Every block has `block` ids, but
    for the last of each source. Cases as in mix_documents, but nothing is cut at characters."""
    width = id_bytes(vocabulary)
    rows, plan, passes = _planned(docs, quoted("doc_id"), weights, block, slots, seed, vocabulary)
    whole = _salted(rows.drop("tail", "inner"), passes).groupBy("name", "block", "copy").agg(F.sort_array(F.collect_list(F.struct("at", F.col("carried").alias("doc_id"), "part"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["part"]))
    whole = whole.select("name", "block", "copy", F.col("parts.doc_id").alias("doc_ids"), ids.alias("ids"))
    out = _drawn(whole, plan)
    return out.select("shard", "slot", F.col("name").alias("source"), "pass", "block", (F.octet_length("ids") / width).cast("int").alias("n_tokens"), "doc_ids", "ids")
