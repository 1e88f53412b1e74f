"""The composed plans: search of every shard, and of the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions import expressions as X
from loomdex.operators import fusion, lexical, segments, sets, vectors
from loomdex.plans.settings import FIRST_STAGE, SHARDS
from loomdex.sources import corpus
from loomdex.sources.index import StoredIndex


def wanted_terms(queries: DataFrame) -> list[str]:
    """The distinct terms that a batch of queries, which are checked, reads: its own, and its readers' access terms."""
    asked = queries.select("lexical_terms", "top_k", X.acl_terms(X.principal_tokens(F.col("user_id"), F.col("acl_tokens"))).alias("grants")).collect()  # a batch of queries
    lexical.check_queries([r["lexical_terms"] for r in asked], [r["top_k"] for r in asked])
    return sorted({t for r in asked for t in [*r["lexical_terms"], *r["grants"]]})


def search_tables(posted: DataFrame, codes: DataFrame, tokens: DataFrame, queries: DataFrame, book, first_stage: int = FIRST_STAGE) -> DataFrame:
    """(query_id, segment, doc_id, score, rank) for every query and segment of an index: the best of
    conjunctive BM25 and of the vectors among what the query may read, fused, cut, reranked by late
    interaction, cut at top_k. posted has the access terms too, codes have acl_tokens."""
    by = ("query_id", "segment")
    asked = corpus.readers(queries)
    words = lexical.search_and(posted, asked, by, first_stage)
    tables = asked.select("query_id", "top_k", "tokens", vectors.distance_table(F.col("dense_vector"), book).alias("lut"))
    near = vectors.search(codes, tables, by, first_stage)
    return fusion.rerank(fusion.fuse([words, near], list(by), first_stage), queries, tokens, list(by))


def numbered(best: DataFrame) -> DataFrame:
    """best(query_id, segment, doc_id, score) with ranks that count what is left of it. Documents that were deleted
    after the cut are not replaced."""
    return lexical.top_k(best.drop("rank"), ["query_id", "segment"])


def merged(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank, partial): lists of segments, each a channel of rank fusion, so that the
    best of every segment come first; cut at top_k. A document that several segments hold adds up."""
    ranks = found.join(F.broadcast(queries.select("query_id", "top_k")), "query_id").groupBy("query_id", "top_k", "doc_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    scored = ranks.select("query_id", "top_k", "doc_id", X.rrf(F.col("ranks")).alias("score"))
    return lexical.top_k(scored, ["query_id"], F.col("top_k")).select("query_id", "doc_id", "score", "rank", F.lit(False).alias("partial"))


def shard_search(docs: DataFrame, queries: DataFrame, deleted: DataFrame, book, shards: int = SHARDS, first_stage: int = FIRST_STAGE) -> DataFrame:
    """search_tables over document events, each shard a segment, without deleted documents."""
    own = X.shard_of(F.col("doc_id"), shards)
    index = corpus.indexed(docs, own)
    codes = docs.select(own.alias("segment"), "doc_id", vectors.encode(F.col("embedding"), book).alias("code"), "acl_tokens")
    best = search_tables(lexical.postings(index, wanted_terms(queries)), codes, docs, queries, book, first_stage)
    return numbered(sets.live(best, deleted))


def stored_search(index: StoredIndex, queries: DataFrame, visibility: str = "all", first_stage: int = FIRST_STAGE) -> DataFrame:
    """cluster_search over a stored index, each visible segment a channel. Only the postings of the queries'
    terms and of their access tokens are read."""
    posted = index.visible("postings", visibility).where(F.col("term").isin(wanted_terms(queries)))
    best = search_tables(posted, index.visible("codes", visibility), index.visible("documents", visibility), queries, index.book, first_stage)
    return merged(numbered(index.without_deleted(best, visibility)), queries)


def cluster_search(docs: DataFrame, queries: DataFrame, deleted: DataFrame, book, shards: int = SHARDS, first_stage: int = FIRST_STAGE) -> DataFrame:
    """(query_id, doc_id, score, rank, partial): the shards' lists, each a channel of rank fusion, so that
    the best of every shard come first; cut at top_k."""
    return merged(shard_search(docs, queries, deleted, book, shards, first_stage), queries)


def search_with_deadline(spark, docs: DataFrame, queries: DataFrame, deleted: DataFrame, book, timeout_s: float, shards: int = SHARDS) -> tuple[list, bool]:
    """(rows of cluster_search, partial): each shard is a job of its own, and those that have not ended by the
    shared deadline, or failed, are cancelled and left out; partial tells whether any was."""
    import threading
    import time
    import uuid

    own, tag, got, lock = X.shard_of(F.col("doc_id"), shards), f"search-{uuid.uuid4().hex}", {}, threading.Lock()

    def one(shard: int) -> None:
        spark.addTag(tag)
        try:
            rows = shard_search(docs.where(own == shard), queries, deleted, book, shards).collect()  # top_k a query
            with lock:
                got[shard] = rows
        except Exception:  # a shard that fails is a shard that is missing
            pass

    threads = [threading.Thread(target=one, args=(s,), daemon=True) for s in range(shards)]
    until = time.monotonic() + timeout_s
    for t in threads:
        t.start()
    for t in threads:
        t.join(max(0.0, until - time.monotonic()))
    partial = len(got) < shards
    if partial:
        spark.interruptTag(tag)
    limit = {r["query_id"]: r["top_k"] for r in queries.select("query_id", "top_k").collect()}
    out = []
    for q in sorted(limit):
        hits = sorted((-1.0 / (X.RRF_K + r["rank"]), r["doc_id"]) for rows in list(got.values()) for r in rows if r["query_id"] == q)
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(hits[: limit[q]])]
    return out, partial


def segment_documents(docs: DataFrame, shards: int, flush_at: int) -> DataFrame:
    """docs with shard and segment_no, in the order of their ids."""
    return segments.assign(docs, shards, flush_at)
