"""Column expressions of the retrieval model: terms, access tokens, routing, BM25, rank fusion, MaxSim."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ACL_PREFIX = "_acl_read:"
K1, B = 1.2, 0.75
RRF_K = 60


def terms(text: Column) -> Column:
    """White-space separated terms as they stand; a null text has none."""
    return F.coalesce(F.filter(F.split(text, r"\s+"), lambda t: t != ""), F.array().cast("array<string>"))


def counted(terms: Column) -> Column:
    """array<struct<term, tf>>: the distinct terms of an array, each with the times that it is there."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~F.equal_null(F.get(s, i), F.get(s, i - 1)))
        return _let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("tf"))))

    return F.when(F.size(terms) > 0, _let(F.sort_array(terms), runs))


def acl_terms(tokens: Column) -> Column:
    """The index terms that grant reading to each token."""
    return F.transform(tokens, lambda t: F.concat(F.lit(ACL_PREFIX), t))


def is_acl_term(term: Column) -> Column:
    return F.startswith(term, F.lit(ACL_PREFIX))


def principal_tokens(user_id: Column, tokens: Column) -> Column:
    """A principal's tokens: its own user token and those it was given, each once."""
    return F.array_distinct(F.array_union(F.array(F.concat(F.lit("user_"), user_id)), F.coalesce(tokens, F.array().cast("array<string>"))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: written out, each step of a mix would double the expression, and with it
    the optimizer's work."""
    return F.transform(F.array(value), use)[0]


def _times_u32(h: Column, factor: int) -> Column:
    # the low 32 bits of a product, in halves that stay below 2**63
    low, high = factor & 0xFFFF, factor >> 16
    return (h * F.lit(low) + (h * F.lit(high)).bitwiseAND(0xFFFF) * F.lit(65536)).bitwiseAND(F.lit(0xFFFFFFFF))


def _fold(h: Column, shift: int) -> Column:
    return _let(h, lambda x: x.bitwiseXOR(F.shiftright(x, shift)))


def fmix32(value: Column) -> Column:
    """The 32-bit finaliser of MurmurHash3, as an unsigned bigint."""
    h = _fold(value.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), 16)
    h = _fold(_let(h, lambda x: _times_u32(x, 0x85EBCA6B)), 13)
    return _fold(_let(h, lambda x: _times_u32(x, 0xC2B2AE35)), 16)


def shard_of(doc_id: Column, shards: int) -> Column:
    """The shard that a document belongs to: the signed finaliser modulo the number of shards."""
    if shards < 1:
        raise ValueError("there must be a shard")
    signed = _let(fmix32(doc_id), lambda h: F.when(h >= 2**31, h - 2**32).otherwise(h))
    return F.pmod(signed, F.lit(shards)).cast("int")


def idf(n_docs: Column, df: Column) -> Column:
    n, d = n_docs.cast("double"), df.cast("double")
    return F.ln((n - d + 0.5) / (d + 0.5) + 1.0)


def bm25(n_docs: Column, df: Column, tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """One term's part of a document's score, as the float that an index stores."""
    if not k1 > 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b between 0 and 1")
    t = tf.cast("double")
    norm = F.lit(1.0 - b) + F.lit(b) * length.cast("double") / average
    return (idf(n_docs, df) * (t * F.lit(k1 + 1.0) / (t + F.lit(k1) * norm))).cast("float")


def float_sum(values: Column) -> Column:
    """The elements of a float array added in order, in single precision."""
    return F.aggregate(values, F.lit(0.0).cast("float"), lambda a, x: (a + x).cast("float"))


def rrf(ranks: Column, k: int = RRF_K) -> Column:
    """Reciprocal rank fusion of an array of ranks, added in order."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return F.aggregate(ranks, F.lit(0.0), lambda a, r: a + F.lit(1.0) / (F.lit(k) + r))


def dot(a: Column, b: Column) -> Column:
    """Products in single precision, added in double. Vectors of different lengths fail the query."""
    added = F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("float").cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.when(F.size(a) == F.size(b), added).otherwise(F.raise_error(F.lit("token vectors differ in length")).cast("double"))


def max_sim(query_tokens: Column, doc_tokens: Column) -> Column:
    """For each query vector the best dot product with a document vector, summed; NaN products are
    passed over; 0 for a document without vectors."""
    least = F.lit(float("-inf"))
    best = F.transform(query_tokens, lambda q: F.aggregate(F.transform(doc_tokens, lambda d: dot(q, d)), least, lambda m, s: F.when(F.isnan(s), m).otherwise(F.greatest(m, s))))
    total = F.aggregate(best, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(doc_tokens), F.lit(0)) > 0, total).otherwise(F.lit(0.0))


def bit_width(gap: Column) -> Column:
    """Bits of a gap: 1 for 0."""
    return F.when(gap == 0, F.lit(1)).otherwise(F.length(F.bin(gap)))


def tier(top_k: Column, n_terms: Column, deep_k: int = 50, many_terms: int = 4) -> Column:
    """Which index tiers a query needs: both if it asks for many results or has many terms."""
    if deep_k < 1 or many_terms < 1:
        raise ValueError("thresholds must be positive")
    return F.when((top_k >= deep_k) | (n_terms >= many_terms), F.lit("BOTH")).otherwise(F.lit("TIER1_ONLY"))
