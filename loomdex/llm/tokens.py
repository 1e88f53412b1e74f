"""Token counts without token ids, and token ids packed to the vocabulary's width.

The vocabulary is a file of ranks (base64 token, rank) read with the byte-level pre-token pattern; its
path is a parameter. Texts are encoded where they lie: nothing here is shuffled.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import quoted, text_batches
from loomdex.llm.pretokens import VOCABULARY, encoding, piece_counts, text_ids
from loomdex.llm.shingles import string_buffers

ID_BLOCK = 4096  # ids between two offsets of a packed document


# --- counts


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): the number of ids that the vocabulary's encoding of each text would have.

    The pieces of each distinct pre-token are counted once (by each process, for as long as it remembers
    the pre-token), joined to the pre-tokens that each text has and how often, and added up. No id is kept,
    and no row leaves its task.

    Null and empty texts have 0 tokens. A text of any length is one row's work, in about 30 bytes of memory
    for each of its own. Every row of docs gives one row, repeated and null doc_ids too, so an empty table
    gives an empty one. Columns other than doc_id and text are not read.
    """
    text_batches(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(piece_counts(vocabulary, *string_buffers(texts)), pa.int64())

    return docs.select("doc_id", F.arrow_udf(run, "bigint")(quoted("text")).alias("n_tokens"))


# --- ids of fixed width


def id_bytes(vocabulary: str = VOCABULARY) -> int:
    """Bytes of an id in token_ids' column: the fewest of 2 and 4 that also hold one id more, which ends a text."""
    return 2 if encoding(vocabulary).n_vocab < 1 << 16 else 4


def end_id(vocabulary: str = VOCABULARY) -> int:
    """The id that ends a text: the first that the vocabulary leaves free."""
    return encoding(vocabulary).n_vocab


def ids_array(texts: pa.Array, vocabulary: str = VOCABULARY, end: bool = False) -> pa.Array:
    """The ids of each text as bytes, id_bytes each, low byte first; end: and the id that ends it, unless the text is
    null or empty."""
    width = id_bytes(vocabulary)
    runs = list(text_ids(vocabulary, *string_buffers(texts)))
    ids = np.concatenate([np.zeros(0, np.uint32), *(i for i, _ in runs)])
    n = np.concatenate([np.zeros(0, np.int64), *(k for _, k in runs)])
    if end:
        ids = np.insert(ids, np.cumsum(n)[n > 0], end_id(vocabulary))
        n += n > 0
    offsets = np.concatenate([[0], np.cumsum(n) * width])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of texts has too many ids")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))])


def token_ids(text: Column, vocabulary: str = VOCABULARY, end: bool = False) -> Column:
    """ids_array of a text column."""

    def run(texts: pa.Array) -> pa.Array:
        return ids_array(texts, vocabulary, end)

    return F.arrow_udf(run, "binary")(text)


# --- packed ids


def id_bits(n_vocabulary: int) -> int:
    """Least number of bits that holds the ids 0 .. n_vocabulary - 1."""
    if n_vocabulary < 1:
        raise ValueError("a vocabulary has at least one id")
    return max(1, (n_vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids of `bits` bits each, one after another, low bits first; the last byte is filled with zeros."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.max()) >> bits or int(ids.min()) < 0):
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_ids(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of pack_ids' bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.int64)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return planes @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def pack_blocks(ids: np.ndarray, bits: int, block: int = ID_BLOCK) -> tuple[bytes, list[int]]:
    """(bytes, offsets): every block ids start at a byte of their own; offsets has where, and the end."""
    parts = [pack_ids(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    return b"".join(parts), [0, *accumulate(map(len, parts))]


def read_ids(data: bytes, offsets: list[int], bits: int, n: int, lo: int, hi: int, block: int = ID_BLOCK) -> np.ndarray:
    """Ids lo to hi of a document of n, from the blocks that hold them only."""
    lo, hi = max(lo, 0), min(hi, n)
    if lo >= hi:
        return np.zeros(0, np.int64)
    parts = [unpack_ids(data[offsets[k] : offsets[k + 1]], bits, min(block, n - k * block)) for k in range(lo // block, (hi - 1) // block + 1)]
    return np.concatenate(parts)[lo - lo // block * block :][: hi - lo]


def _packed(path: str, block: int):
    def run(texts: pa.Array) -> pa.Array:
        bits, rows = id_bits(encoding(path).n_vocab), []
        for ids, counts in text_ids(path, *string_buffers(texts)):
            rows += [(*pack_blocks(x, bits, block), len(x)) for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
        data, offsets, sizes = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array([bits] * len(rows), pa.int32()), pa.array(offsets, pa.list_(pa.int64())), pa.array(data, pa.binary())], ["n_tokens", "bits", "offsets", "packed"])

    return run


def packed_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = ID_BLOCK) -> DataFrame:
    """(doc_id, n_tokens, bits, offsets, packed): the ids of each text in `bits` bits each, the fewest
    that hold the vocabulary; offsets has the byte at which every `block` ids start, and the end.

    read_ids unpacks any range. Null and empty texts have no ids and offsets [0]. A very long text is one
    row; it may have no more than 2**31 packed bytes. Every row of docs gives one row, repeated or null
    doc_ids too, so an empty table gives an empty one. Columns other than doc_id and text are not read.
    """
    text_batches(docs.sparkSession)
    packed = F.arrow_udf(_packed(vocabulary, block), "struct<n_tokens:bigint,bits:int,offsets:array<bigint>,packed:binary>")(quoted("text"))
    return docs.select("doc_id", packed.alias("p")).select("doc_id", "p.*")
