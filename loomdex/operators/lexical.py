"""The inverted index as tables: postings, statistics, blocks; seeks, prefix scans and conjunctive top-k.

An index is built from (segment, doc_id, terms). Statistics are of each segment and come before any
access filter, so that what a reader may see does not change the scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions import expressions as X
from loomdex.sources.storage import small_side, tasks

BLOCK = 128


def checked(docs: DataFrame) -> DataFrame:
    """docs(segment, doc_id, terms) with bad rows raised at run time: a negative or null id, an empty term."""
    ok = F.coalesce(F.col("doc_id") >= 0, F.lit(False)) & ~F.coalesce(F.exists("terms", lambda t: t == ""), F.lit(False))
    return docs.withColumn("doc_id", F.when(ok, F.col("doc_id")).otherwise(F.raise_error(F.lit("a document needs an id of 0 or more and terms that are not empty")).cast("bigint")))


def term_frequency(docs: DataFrame) -> DataFrame:
    """(segment, term, doc_id, tf)."""
    return docs.select("segment", "doc_id", F.explode("terms").alias("term")).groupBy("segment", "term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(segment, doc_id, doc_len): repeated terms and access terms count."""
    return docs.select("segment", "doc_id", F.size("terms").alias("doc_len"))


def segment_stats(docs: DataFrame) -> DataFrame:
    """(segment, n_docs, avg_len), a row a segment. A segment whose documents are all empty has avg_len 0."""
    return docs.groupBy("segment").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms")).alias("avg_len"))


def term_stats(tf: DataFrame) -> DataFrame:
    """(segment, term, df)."""
    return tf.groupBy("segment", "term").agg(F.count(F.lit(1)).alias("df"))


def document_frequency(docs: DataFrame, repeated: bool | None = None) -> DataFrame:
    """term_stats of docs(segment, doc_id, terms), without moving their postings: each task adds up the terms of its
    documents first. repeated: whether an id is there twice, if it is known; such ids are counted once."""
    if repeated is None:
        repeated = not docs.groupBy("segment", "doc_id").count().where("count > 1").isEmpty()
    if repeated:
        return term_stats(term_frequency(docs))
    return term_stats(docs.select("segment", F.explode(F.array_distinct("terms")).alias("term")))


HOT = 1 << 22  # documents of a segment from which the posting list of a term may be too long for one task


def postings(docs: DataFrame, only: list[str] | None = None, k1: float = X.K1, b: float = X.B) -> DataFrame:
    """(segment, term, doc_id, tf, doc_len, df, impact), sorted by (term, segment, doc_id) within partitions. only: build the
    postings of these terms alone, with the statistics of the whole segment. A document without a proper id or with an
    empty term fails the query.

    Terms are counted where the document lies, so that an entry moves once, to the task that has its list and counts the
    list's length. Where a segment has more than HOT documents, lists that are longer than that are counted first, and
    dealt to tasks by ranges of ids."""
    spark = docs.sparkSession
    own = docs["terms"] if only is None else F.filter("terms", lambda t: t.isin(only))
    ids = docs.groupBy("segment", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("terms")).alias("len"), F.count(F.size("terms")).alias("known"), F.sum(F.size(own)).alias("own"))
    table = ids.groupBy("segment").agg(F.sum("rows").alias("n_docs"), F.try_divide(F.sum("len"), F.sum("known")).alias("avg_len"), F.max("rows").alias("rows"), F.sum("own").alias("own")).toArrow()  # a row a segment
    n_docs, rows, entries = (table[c].to_pylist() for c in ("n_docs", "rows", "own"))
    stats = F.broadcast(spark.createDataFrame(table.select(["segment", "n_docs", "avg_len"])))
    #: of one segment the number may be a literal, by which a shuffle does not count as one by (term, segment)
    keys = ["term"] if len(n_docs) < 2 else ["term", "segment"]
    parts = tasks(spark, sum(n or 0 for n in entries))
    tf = checked(docs.withColumn("doc_len", F.size("terms")).withColumn("terms", own)).select("segment", "doc_id", "doc_len", F.inline(X.counted(F.col("terms"))))
    repeated = max(rows, default=0) > 1
    if max(n_docs, default=0) <= HOT:
        tf, part = tf.repartition(parts, *keys), keys
    else:
        found = document_frequency(docs.withColumn("terms", own), repeated).where(F.col("df") > HOT).select("segment", "term", F.col("df").alias("long"))
        tf = tf.join(F.broadcast(found), ["segment", "term"], "left")  # a row for each HOT entries at most
        tf = tf.withColumn("part", F.when(F.col("long").isNotNull(), F.floor(F.col("doc_id") / CHUNK_IDS)).otherwise(F.lit(0)))
        part = [*keys, "part"]
        tf = tf.repartition(parts, *part)
    if repeated:
        extra = [c for c in ("long", "part") if c in tf.columns]
        tf = tf.groupBy("segment", "term", "doc_id", *extra).agg(F.sum("tf").cast("int").alias("tf"), F.first("doc_len").alias("doc_len"))
    length = F.count(F.lit(1)).over(W.partitionBy(*part))
    tf = tf.sortWithinPartitions(*part, "doc_id").withColumn("df", F.coalesce("long", length) if "long" in tf.columns else length)
    joined = tf.join(stats, "segment")
    return joined.select("segment", "term", "doc_id", "tf", "doc_len", "df", X.bm25(F.col("n_docs"), F.col("df"), F.col("tf"), F.col("doc_len"), F.col("avg_len"), k1, b).alias("impact"))


CHUNK_IDS = 1 << 16  # ids of a long posting list that one task numbers


def blocks(posted: DataFrame, size: int = BLOCK, hot: int = HOT, largest: int | None = None) -> DataFrame:
    """(segment, term, block_no, n, first_doc, max_doc_id, max_impact, bit_width): the posting lists in
    blocks of `size`, by ascending id. Lists of more than `hot` entries are numbered by chunks of ids; largest:
    a number of entries that none exceeds, if it is known. Postings in the order of postings() are not sorted again."""
    if (largest is not None and largest <= hot) or posted.where(F.col("df") > hot).isEmpty():
        at = posted.withColumn("place", F.row_number().over(W.partitionBy("term", "segment").orderBy("doc_id")))
    else:
        numbered = posted.withColumn("chunk", F.when(F.col("df") > hot, F.floor(F.col("doc_id") / CHUNK_IDS)).otherwise(F.lit(0)))
        counts = numbered.where(F.col("df") > hot).groupBy("segment", "term", "chunk").agg(F.count(F.lit(1)).alias("own"))
        before = counts.select("segment", "term", "chunk", (F.sum("own").over(W.partitionBy("segment", "term").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("own")).alias("before"))
        at = numbered.withColumn("place", F.row_number().over(W.partitionBy("segment", "term", "chunk").orderBy("doc_id")))
        at = at.join(small_side(before), ["segment", "term", "chunk"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    grouped = at.withColumn("block_no", F.floor((F.col("place") - 1) / size).cast("int")).groupBy("segment", "term", "block_no")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("max_doc_id"), F.greatest(F.max("impact"), F.lit(0.0).cast("float")).alias("max_impact"))
    return out.withColumn("bit_width", X.bit_width(F.col("max_doc_id") - F.col("first_doc")))


def can_contribute(posted_blocks: DataFrame, floor: float) -> DataFrame:
    """The blocks whose best impact exceeds a threshold."""
    return posted_blocks.where(F.col("max_impact") > F.lit(floor).cast("float"))


def total_size(posted_blocks: DataFrame) -> DataFrame:
    """(segment, term, blocks, size): the blocks and the entries of each posting list."""
    return posted_blocks.groupBy("segment", "term").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("size"))


def seek(posted: DataFrame, targets: DataFrame) -> DataFrame:
    """(term, target, doc_id): for each targets(term, target) the first posting at or after it; null past
    the end."""
    hits = targets.join(posted, (targets["term"] == posted["term"]) & (posted["doc_id"] >= targets["target"]), "left")
    return hits.groupBy(targets["term"], targets["target"]).agg(F.min(posted["doc_id"]).alias("doc_id"))


def past_block(posted: DataFrame, targets: DataFrame, size: int = BLOCK) -> DataFrame:
    """(term, target, doc_id): the first posting after the block that holds, or ends after, the target."""
    b = blocks(posted, size)
    held = targets.join(b, "term").where(F.col("max_doc_id") >= F.col("target")).groupBy("term", "target").agg(F.min("max_doc_id").alias("last"))
    hits = held.join(posted.select("term", "doc_id"), "term", "left")
    return hits.groupBy("term", "target").agg(F.min(F.when(F.col("doc_id") > F.col("last"), F.col("doc_id"))).alias("doc_id"))


DICTIONARY_CHUNK = 1 << 16


def dictionary(docs: DataFrame) -> DataFrame:
    """(term, ordinal): distinct terms numbered from 0 in the order of their first document, then of the
    term. Each run of DICTIONARY_CHUNK ids numbers the terms that it is first to have, and the runs' counts,
    a row a run, are added up."""
    first = docs.select("doc_id", F.explode("terms").alias("term")).groupBy("term").agg(F.min("doc_id").alias("doc_id"))
    first = first.withColumn("chunk", F.floor(F.col("doc_id") / DICTIONARY_CHUNK))
    own = F.row_number().over(W.partitionBy("chunk").orderBy("doc_id", "term")) - 1
    totals = first.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select("chunk", (F.sum("n").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("before"))
    return first.withColumn("own", own).join(before, "chunk").select("term", (F.col("before") + F.col("own")).alias("ordinal"))


def with_prefix(term_table: DataFrame, prefix: str) -> DataFrame:
    """The rows whose term starts with a prefix that is not empty, in order."""
    if not prefix:
        raise ValueError("a prefix must not be empty")
    return term_table.where(F.startswith("term", F.lit(prefix))).orderBy("term")


def most_wanted(queries: DataFrame) -> int:
    """The largest top_k of a batch of queries."""
    return queries.agg(F.max("top_k")).first()[0] or 1


def top_k(scored: DataFrame, by: list[str], k: Column | int = None, most: int | None = None) -> DataFrame:
    """scored(*by, doc_id, score, ...) with a 1-based rank by score (best first, ties by id), cut at k.

    most: a number that k does not exceed in any row; with it each task keeps only so many rows of a
    group before they are shuffled (up to spark.sql.optimizer.windowGroupLimitThreshold)."""
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc("doc_id"))))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def floors(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, floor): the score that a further document has to exceed: that of rank top_k in
    ranked(query_id, score, rank), or minus infinity where there are fewer."""
    full = ranked.select("query_id", "score", "rank").join(F.broadcast(queries.select("query_id", "top_k")), "query_id").where(F.col("rank") == F.col("top_k")).select("query_id", "score")  # a batch of queries
    return queries.select("query_id").join(full, "query_id", "left").select("query_id", F.coalesce("score", F.lit(float("-inf"))).alias("floor"))


def search_and(posted: DataFrame, queries: DataFrame, by: tuple[str, ...] = ("query_id",), k: int | None = None) -> DataFrame:
    """(*by, doc_id, score, rank): the documents that hold every term of queries(query_id, lexical_terms,
    top_k), scored by the single-precision sum of impacts in the order of the terms. A term given twice
    counts twice.

    If queries has tokens, a document must also hold the access term of one of them: posted has these like any
    other term, and they meet the others of the document in the one shuffle there is.

    by: ("query_id",) or ("query_id", "segment") for a list of each segment. k: overrides top_k.
    """
    asked = queries.select("query_id", "top_k", F.size("lexical_terms").alias("n_terms"), F.posexplode("lexical_terms").alias("pos", "term"))
    readable = F.lit(True)
    if "tokens" in queries.columns:
        grants = queries.select("query_id", "top_k", F.size("lexical_terms").alias("n_terms"), F.explode(F.array_distinct(X.acl_terms(F.col("tokens")))).alias("term"))
        asked = asked.unionByName(grants.withColumn("pos", F.lit(-1)))
        readable = F.col("grants") > 0
    hits = posted.join(F.broadcast(asked), "term")  # a batch of queries: a few terms each
    word = F.when(F.col("pos") >= 0, F.struct("pos", "impact"))
    hits = hits.groupBy("query_id", "top_k", "n_terms", "segment", "doc_id").agg(F.array_sort(F.collect_list(word)).alias("hit"), F.count(F.when(F.col("pos") < 0, 1)).alias("grants"))
    hits = hits.where((F.size("hit") == F.col("n_terms")) & readable)
    scored = hits.select("query_id", "top_k", "segment", "doc_id", X.float_sum(F.col("hit.impact")).cast("double").alias("score"))
    best = top_k(scored, list(by), F.col("top_k"), most_wanted(queries)) if k is None else top_k(scored, list(by), k)
    return best.select(*by, "doc_id", "score", "rank")


RANGE_IDS = 1 << 10  # ids of a range that is read or passed over as a whole


def search_pruned(posted: DataFrame, posted_blocks: DataFrame, queries: DataFrame, range_ids: int = RANGE_IDS) -> DataFrame:
    """search_and by ("query_id",), reading only what the blocks leave open.

    The blocks tell the most that a document of each range of ids can score for each query. The most promising
    ranges, as many as hold top_k entries of the query's rarest term, are scored first; the score at top_k is a floor,
    and only ranges that can reach it (a tie counts: the lesser id wins) are read besides."""
    asked = queries.select("query_id", "top_k", F.size("lexical_terms").alias("n_terms"), F.posexplode("lexical_terms").alias("pos", "term"))
    ranges = posted_blocks.join(F.broadcast(asked), "term")  # a batch of queries
    ranges = ranges.select("query_id", "top_k", "n_terms", "segment", "pos", "max_impact", "n", F.explode(F.sequence(F.floor(F.col("first_doc") / range_ids), F.floor(F.col("max_doc_id") / range_ids))).alias("range"))
    ranges = ranges.groupBy("query_id", "top_k", "n_terms", "segment", "range", "pos").agg(F.max("max_impact").alias("most"), F.sum("n").alias("n"))
    # single precision may round a sum of impacts up, but never beyond that of the bounds, added in the same order
    bounds = ranges.groupBy("query_id", "top_k", "n_terms", "segment", "range").agg(F.array_sort(F.collect_list(F.struct("pos", "most"))).alias("terms"), F.min("n").alias("n"))
    bounds = bounds.where(F.size("terms") == F.col("n_terms")).withColumn("most", X.float_sum(F.col("terms.most")).cast("double")).select("query_id", "top_k", "segment", "range", "most", "n")
    w = W.partitionBy("query_id").orderBy(F.desc("most"), "segment", "range")
    first = bounds.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most_wanted(queries)).drop("place")  # each has an entry at least
    first = first.withColumn("upto", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).where(F.col("upto") - F.col("n") < F.col("top_k"))

    def read(ranges: DataFrame) -> DataFrame:
        own = posted.withColumn("range", F.floor(F.col("doc_id") / range_ids))
        hits = own.join(F.broadcast(asked), "term").join(small_side(ranges.select("query_id", "segment", "range")), ["query_id", "segment", "range"], "left_semi")
        hits = hits.groupBy("query_id", "top_k", "n_terms", "segment", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "impact"))).alias("hit")).where(F.size("hit") == F.col("n_terms"))
        return hits.select("query_id", "top_k", "segment", "doc_id", X.float_sum(F.col("hit.impact")).cast("double").alias("score"))

    most = most_wanted(queries)
    floor = floors(top_k(read(first), ["query_id"], F.col("top_k"), most), queries)
    left = bounds.join(F.broadcast(floor), "query_id").where(F.col("most") >= F.col("floor"))  # a row a query
    return top_k(read(left), ["query_id"], F.col("top_k"), most).select("query_id", "doc_id", "score", "rank")


def check_queries(lexical_terms: list[list[str]], top_ks: list[int]) -> None:
    """Raise for a query without terms, with an empty term, or that asks for no result."""
    for terms, k in zip(lexical_terms, top_ks, strict=True):
        if not terms or any(not t for t in terms):
            raise ValueError("a query needs terms, none of them empty")
        if k < 1:
            raise ValueError("top_k must be at least 1")
