"""DuckDB SQL for the engine's queries, over the tables of a data folder as views."""

from __future__ import annotations

from loomdex.operators.segments import MERGE_FACTOR
from loomdex.plans.settings import FLUSH_AT, FOREIGN, MERGE_RATIO, SEEKS, SHARDS
from loomdex.sources.corpus import QUERIES

M, K, PART = 8, 16, 8
TOKENS, TOKEN_DIM = 4, 16


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_TERMS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0B]+'), lambda t: t <> '')"
_ASKED = "asked(query_id, lexical_terms, user_id, acl_tokens, top_k) AS (VALUES " + ", ".join(f"({q}, {_list(t)}, '{u}', {_list(a)}, {k})" for q, t, u, a, k in QUERIES) + ")"
_DEAD = "dead AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"

#: the signed 32-bit mix of an id, modulo the shards
_MIX = (
    "{id} & 4294967295 AS h0, xor(h0, h0 >> 16) AS h1, ((h1::HUGEINT * 2246822507) % 4294967296)::BIGINT AS h2, xor(h2, h2 >> 13) AS h3, "
    "((h3::HUGEINT * 3266489909) % 4294967296)::BIGINT AS h4, xor(h4, h4 >> 16) AS h5, CASE WHEN h5 >= 2147483648 THEN h5 - 4294967296 ELSE h5 END AS h6, ((h6 % {n}) + {n}) % {n} AS shard"
)


def _routed(table: str, n: int, name: str = "routed") -> str:
    return f"{name} AS (SELECT doc_id, shard::INT AS shard FROM (SELECT doc_id, {_MIX.format(id='doc_id', n=n)} FROM {table}))"


_TEXTS = f"docs AS (SELECT 0 AS segment, doc_id, {_TERMS} AS terms FROM documents)"
_EVENTS = f"ev AS (SELECT doc_id, {_TERMS} AS content, ['group_' || source, 'lang_' || lang, 'user_' || (doc_id % 7)] AS acl, embedding FROM documents JOIN embeddings ON doc_id = vec_id)"
_INDEXED = "list_concat(content, list_transform(acl, lambda a: '_acl_read:' || a))"
_CAN = "can AS (SELECT DISTINCT query_id, doc_id FROM ev, asked WHERE list_has_any(acl, list_append(acl_tokens, 'user_' || user_id)))"

#: postings of docs(segment, doc_id, terms)
_POSTINGS = (
    "tf AS (SELECT segment, term, doc_id, count(*)::INT AS tf FROM (SELECT segment, doc_id, unnest(terms) AS term FROM docs) GROUP BY ALL), "
    "df AS (SELECT segment, term, count(*) AS df FROM tf GROUP BY ALL), "
    "lengths AS (SELECT segment, doc_id, len(terms)::INT AS doc_len FROM docs), "
    "stats AS (SELECT segment, count(*) AS n_docs, sum(len(terms))::DOUBLE / count(*) AS avg_len FROM docs GROUP BY segment), "
    "posted AS (SELECT segment, term, doc_id, tf, doc_len, (ln((n_docs::DOUBLE - df + 5e-1) / (df + 5e-1) + 1e0) * (tf::DOUBLE * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * doc_len / avg_len))))::FLOAT AS impact "
    "FROM tf JOIN df USING (segment, term) JOIN stats USING (segment) JOIN lengths USING (segment, doc_id))"
)


def _words(by: str, limit: str, allowed: bool) -> str:
    """lexical(query_id, segment, doc_id, score, rank) over posted."""
    return (
        "wanted AS (SELECT query_id, top_k, len(lexical_terms) AS n_terms, unnest(lexical_terms) AS term, generate_subscripts(lexical_terms, 1) AS pos FROM asked), "
        "hits AS (SELECT query_id, top_k, n_terms, segment, doc_id, list(impact ORDER BY pos) AS impacts FROM posted JOIN wanted USING (term) GROUP BY ALL), "
        "scores AS (SELECT query_id, top_k, segment, doc_id, list_reduce(impacts, lambda a, x: (a + x)::FLOAT)::DOUBLE AS score FROM hits " + ("JOIN can USING (query_id, doc_id) " if allowed else "") + "WHERE len(impacts) = n_terms), "
        f"lexical AS (SELECT query_id, segment, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id)::INT AS rank FROM scores) WHERE rank <= {limit})"
    )


_DISTANCE = " + ".join(f"(v[m * {PART} + {j}] - c[{j}])::DOUBLE * (v[m * {PART} + {j}] - c[{j}])::DOUBLE" for j in range(1, PART + 1))
_BOOK = (
    f"pick AS (SELECT m::INT AS m, k::INT AS k, vec_id FROM (SELECT m, vec_id, row_number() OVER (PARTITION BY m ORDER BY h5, vec_id) - 1 AS k FROM (SELECT m, vec_id, {_MIX.format(id=f'(vec_id * {M} + m)', n=1)} FROM embeddings, range({M}) r(m))) WHERE k < {K}), "
    f"book AS (SELECT m, k, embedding[m * {PART} + 1 : m * {PART} + {PART}] AS c FROM pick JOIN embeddings USING (vec_id))"
)
_LUT = f"lut AS (SELECT query_id, m, k, ({_DISTANCE})::FLOAT AS d FROM (SELECT query_id, embedding AS v FROM asked JOIN embeddings ON vec_id = query_id) CROSS JOIN book)"


def _codes(source: str) -> str:
    """codes(segment, doc_id, m, k) of source(segment, doc_id, v)."""
    return f"codes AS (SELECT segment, doc_id, m, arg_min(k, {{'d': d, 'k': k}}) AS k FROM (SELECT segment, doc_id, m, k, {_DISTANCE} AS d FROM {source} CROSS JOIN book) GROUP BY segment, doc_id, m)"


def _near(by: str, limit: str, allowed: bool) -> str:
    """near(query_id, segment, doc_id, score, rank) over codes and lut."""
    return (
        "cells AS (SELECT query_id, segment, doc_id, list(d ORDER BY m) AS ds FROM codes JOIN lut USING (m, k) " + ("JOIN can USING (query_id, doc_id) " if allowed else "") + "GROUP BY ALL), "
        "adc AS (SELECT query_id, top_k, segment, doc_id, (-list_reduce(ds, lambda a, x: (a + x)::FLOAT))::DOUBLE AS score FROM cells JOIN asked USING (query_id)), "
        f"near AS (SELECT query_id, segment, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id)::INT AS rank FROM adc) WHERE rank <= {limit})"
    )


def _fused(by: str, limit: int) -> str:
    return (
        f"channels AS (SELECT {by}, doc_id, 0 AS channel, rank FROM lexical UNION ALL SELECT {by}, doc_id, 1, rank FROM near), "
        f"summed AS (SELECT {by}, doc_id, list_reduce(list(1e0 / (60 + rank) ORDER BY channel), lambda a, x: a + x) AS score FROM channels GROUP BY ALL), "
        f"fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id)::INT AS rank FROM summed) WHERE rank <= {limit})"
    )


_DOT = " + ".join(f"(q[i * {TOKEN_DIM} + {x}] * v[j * {TOKEN_DIM} + {x}])::DOUBLE" for x in range(1, TOKEN_DIM + 1))


def _reranked(by: str) -> str:
    """best(by, doc_id, score, rank) over fused."""
    return (
        f"pairs AS (SELECT {by}, f.doc_id, top_k, a.embedding AS q, b.embedding AS v FROM fused f JOIN asked USING (query_id) JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = f.doc_id), "
        f"tops AS (SELECT {by}, doc_id, top_k, i, max({_DOT}) AS top FROM pairs, range({TOKENS}) x(i), range({TOKENS}) y(j) GROUP BY {by}, doc_id, top_k, i), "
        f"sims AS (SELECT {by}, doc_id, top_k, list_reduce(list(top ORDER BY i), lambda a, x: a + x) AS score FROM tops GROUP BY ALL), "
        f"best AS (SELECT {by}, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id)::INT AS rank FROM sims) WHERE rank <= top_k)"
    )


def _with(*parts: str, select: str) -> str:
    return "WITH " + ", ".join(parts) + " " + select


_ACL_INDEX = f"docs AS (SELECT 0 AS segment, doc_id, {_INDEXED} AS terms FROM ev)"
_ACL_WORDS = (_EVENTS, _ASKED, _CAN, _ACL_INDEX, _POSTINGS, _words("query_id", "top_k", True))
_ALL_VECTORS = "vs AS (SELECT 0 AS segment, vec_id AS doc_id, embedding AS v FROM embeddings)"
_ACL_NEAR = (_BOOK, _LUT, _ALL_VECTORS, _codes("vs"), _near("query_id", "top_k", True))

_BY = "query_id, segment"


def _sharded(placed: str) -> tuple[str, ...]:
    """found(query_id, segment, doc_id, score, rank), documents being in the segments of placed(doc_id, segment)."""
    return (
        _EVENTS, _ASKED, _CAN, _DEAD, _routed("ev", SHARDS), f"placed AS ({placed})", f"docs AS (SELECT segment, doc_id, {_INDEXED} AS terms FROM ev JOIN placed USING (doc_id))", _POSTINGS, _words(_BY, "1000", True),
        _BOOK, _LUT, "vs AS (SELECT segment, doc_id, embedding AS v FROM ev JOIN placed USING (doc_id))", _codes("vs"), _near(_BY, "1000", True), _fused(_BY, 1000), _reranked(_BY),
        "found AS (SELECT query_id, segment, doc_id, score, row_number() OVER (PARTITION BY query_id, segment ORDER BY score DESC, doc_id)::INT AS rank FROM best ANTI JOIN dead USING (doc_id))",
    )


def _cluster(placed: str) -> str:
    return _with(
        *_sharded(placed), "merged AS (SELECT query_id, doc_id, top_k, 1e0 / (60 + rank) AS score FROM found JOIN asked USING (query_id))",
        "final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM merged)",
        select="SELECT query_id, doc_id, round(score, 6) AS score, rank, false AS partial FROM final WHERE rank <= top_k",
    )


_BY_SHARD = "SELECT doc_id, shard AS segment FROM routed"
_BY_FLUSH = f"SELECT doc_id, shard * 1000000 + (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1) // {FLUSH_AT} AS segment FROM routed"
_LATEST = f"SELECT doc_id, segment FROM ({_BY_FLUSH}) QUALIFY segment = max(segment) OVER (PARTITION BY segment // 1000000)"

_BLOCKS = (
    f"texts AS (SELECT doc_id, {_TERMS} AS terms FROM documents)", _routed("texts", SHARDS), "docs AS (SELECT shard AS segment, doc_id, terms FROM texts JOIN routed USING (doc_id))", _POSTINGS,
    "numbered AS (SELECT *, ((row_number() OVER (PARTITION BY segment, term ORDER BY doc_id) - 1) // 128)::INT AS block_no FROM posted)",
    "blocks AS (SELECT segment, term, block_no, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS max_doc_id, greatest(max(impact), 0) AS max_impact FROM numbered GROUP BY segment, term, block_no)",
)
_SEEKS = "seeks(term, target) AS (VALUES " + ", ".join(f"('{t}', {n}::BIGINT)" for t, n in SEEKS) + ")"

_SEGMENTS = (
    _DEAD, _routed("documents", SHARDS), "numbered AS (SELECT doc_id, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id)::INT AS seq FROM routed)",
    f"assigned AS (SELECT *, ((seq - 1) // {FLUSH_AT})::INT AS segment_no FROM numbered)",
)
def _marked(ids: str, assigned: str) -> str:
    """placed_marks(shard, segment_no, doc_id): ids, a query, in the segment of assigned(shard, segment_no, doc_id) that holds each or the shard's last."""
    return (
        f"marks AS ({ids}), {_routed('marks', SHARDS, 'marks_routed')}, last AS (SELECT shard, max(segment_no) AS last FROM {assigned} GROUP BY shard), "
        f"placed_marks AS (SELECT DISTINCT r.shard, coalesce(a.segment_no, last) AS segment_no, r.doc_id FROM marks_routed r JOIN last USING (shard) LEFT JOIN {assigned} a USING (doc_id))"
    )


def _stats(assigned: str) -> str:
    """segs: tombstones count whether the segment holds their ids or not; live documents are those that it was built with."""
    return (
        f"sizes AS (SELECT shard, segment_no, count(*) AS n_docs FROM {assigned} GROUP BY ALL), tombs AS (SELECT shard, segment_no, count(*) AS n FROM placed_marks GROUP BY ALL), "
        "segs AS (SELECT shard, segment_no, n_docs, coalesce(n, 0) AS n_tombstones, coalesce(n, 0)::DOUBLE / n_docs AS tombstone_ratio, n_docs AS live_docs FROM sizes LEFT JOIN tombs USING (shard, segment_no))"
    )


_SEGMENT_STATS = _marked(f"SELECT doc_id FROM dead UNION SELECT doc_id + {FOREIGN} FROM dead", "assigned") + ", " + _stats("assigned")
_PICKED = (
    f"marked AS (SELECT *, min(CASE WHEN tombstone_ratio >= {MERGE_RATIO} THEN segment_no END) OVER (PARTITION BY shard) AS forced, count(*) OVER (PARTITION BY shard) AS n FROM segs), "
    "ordered AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY CASE WHEN segment_no = forced THEN 0 ELSE 1 END, live_docs, segment_no)::INT AS pick FROM marked), "
    f"picked AS (SELECT * FROM ordered WHERE pick <= {MERGE_FACTOR} AND (forced IS NOT NULL OR n >= {MERGE_FACTOR}))"
)

_MERGED = (
    f"WITH based AS (SELECT doc_id, shard, ((row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1) // {FLUSH_AT})::INT AS segment_no FROM routed), "
    + _marked("SELECT doc_id FROM dead", "based") + ", " + _stats("based") + ", " + _PICKED
    + " SELECT doc_id, CASE WHEN pick IS NULL THEN shard * 1000000 + segment_no ELSE shard * 1000000 + 500000 END AS segment FROM based LEFT JOIN picked USING (shard, segment_no) WHERE pick IS NULL OR doc_id NOT IN (SELECT doc_id FROM dead)"
)

_SETS = ("a AS (SELECT doc_id FROM documents WHERE lang = 'en')", "b AS (SELECT doc_id FROM labels WHERE toxic = 1)")
_PS = "0.0, 0.5, 0.9, 0.99, 1.0"
_HITS = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM "

ORACLE_SQL: dict[str, str] = {
    "bm25_and_topk": _with(_TEXTS, _ASKED, _POSTINGS, _words("query_id", "top_k", False), select=_HITS + "lexical"),
    "term_frequency": _with(_TEXTS, select="SELECT term, doc_id, count(*)::INT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY ALL"),
    "doc_stats": _with(_TEXTS, select="SELECT doc_id, len(terms)::INT AS doc_len FROM docs"),
    "term_stats": _with(_TEXTS, select="SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY term"),
    "index_stats": _with(_TEXTS, select="SELECT count(*) AS n_docs, round(avg(len(terms)), 6) AS avg_len FROM docs"),
    "term_dictionary": _with(_TEXTS, select="SELECT term, row_number() OVER (ORDER BY first, term) - 1 AS ordinal FROM (SELECT term, min(doc_id) AS first FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY term)"),
    "term_prefix": _with(_TEXTS, select="SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(terms) AS term FROM docs) WHERE starts_with(term, 'th') GROUP BY term"),
    "bm25_impacts": _with(_TEXTS, _POSTINGS, select="SELECT term, doc_id, tf, doc_len, round(impact::DOUBLE, 6) AS impact FROM posted"),
    "posting_blocks": _with(*_BLOCKS, select="SELECT segment, term, block_no, n, first_doc, max_doc_id, round(max_impact::DOUBLE, 6) AS max_impact, CASE WHEN max_doc_id = first_doc THEN 1 ELSE length(bin(max_doc_id - first_doc)) END::INT AS bit_width FROM blocks"),
    "posting_sizes": _with(*_BLOCKS, select="SELECT segment, term, count(*) AS blocks, sum(n)::BIGINT AS size FROM blocks GROUP BY segment, term"),
    "bm25_block_pruned": _with(_TEXTS, _ASKED, _POSTINGS, _words("query_id", "top_k", False), select=_HITS + "lexical"),
    "topk_floor": _with(
        _TEXTS, _ASKED, _POSTINGS, _words("query_id", "top_k", False),
        select="SELECT a.query_id, coalesce(round(max(score) FILTER (WHERE rank = top_k), 6), '-inf'::DOUBLE) AS floor FROM asked a LEFT JOIN lexical l ON l.query_id = a.query_id GROUP BY a.query_id",
    ),
    "contributing_blocks": _with(*_BLOCKS, select="SELECT segment, term, block_no FROM blocks WHERE max_impact > 15e-1::FLOAT"),
    "posting_seek": _with(_TEXTS, _SEEKS, select="SELECT s.term, target, (SELECT min(doc_id) FROM docs WHERE doc_id >= target AND list_contains(terms, s.term)) AS doc_id FROM seeks s"),
    "posting_past_block": _with(
        _TEXTS, _SEEKS, "held AS (SELECT DISTINCT term, doc_id FROM (SELECT doc_id, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM seeks))",
        "numbered AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS block_no FROM held)",
        "here AS (SELECT term, target, min(block_no) AS block_no FROM seeks JOIN (SELECT term, block_no, max(doc_id) AS last FROM numbered GROUP BY ALL) USING (term) WHERE last >= target GROUP BY ALL)",
        select="SELECT h.term, target, min(n.doc_id) AS doc_id FROM here h LEFT JOIN numbered n ON n.term = h.term AND n.block_no > h.block_no GROUP BY h.term, target",
    ),
    "acl_filter": _with(_EVENTS, _ASKED, _CAN, select="SELECT query_id, doc_id FROM can"),
    "acl_bm25": _with(*_ACL_WORDS, select=_HITS + "lexical"),
    "bitset_or": _with(*_SETS, select="SELECT doc_id FROM a UNION SELECT doc_id FROM b"),
    "bitset_and": _with(*_SETS, select="SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b"),
    "bitset_andnot": _with(*_SETS, select="SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b"),
    "bitset_add": "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT vec_id FROM embeddings",
    "bitset_ascending": "SELECT DISTINCT l_orderkey AS doc_id, l_orderkey >> 16 AS chunk_key, l_orderkey & 65535 AS \"offset\" FROM lineitem",
    "bitset_contains": _with(*_SETS, select="SELECT doc_id, doc_id IN (SELECT doc_id FROM a) AS present FROM (SELECT DISTINCT doc_id FROM b)"),
    "bitset_chunks": "SELECT l_orderkey >> 16 AS chunk_key, count(DISTINCT l_orderkey) AS cardinality FROM lineitem GROUP BY 1",
    "bitset_cardinality": "SELECT count(DISTINCT l_orderkey) AS cardinality FROM lineitem",
    "tombstone_live": _with(_DEAD, select="SELECT doc_id FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id NOT IN (SELECT doc_id FROM dead)"),
    "forward_fetch": _with(_TEXTS, _ASKED, _POSTINGS, _words("query_id", "top_k", False), select="SELECT query_id, doc_id, md5(text) AS payload_md5 FROM lexical JOIN documents USING (doc_id)"),
    "pq_codebook": _with(_BOOK, select=f"SELECT m, k, j::INT AS j, round(c[j + 1]::DOUBLE, 6) AS x FROM book, range({PART}) r(j)"),
    "pq_encode": _with(_BOOK, _ALL_VECTORS, _codes("vs"), select="SELECT doc_id, m, k AS code FROM codes"),
    "adc_lut": _with(_ASKED, _BOOK, _LUT, select="SELECT query_id, m, k, round(d::DOUBLE, 6) AS d FROM lut"),
    "adc_topk": _with(_ASKED, _BOOK, _LUT, _ALL_VECTORS, _codes("vs"), _near("query_id", "top_k", False), select=_HITS + "near"),
    "adc_topk_acl": _with(_EVENTS, _ASKED, _CAN, *_ACL_NEAR, select=_HITS + "near"),
    "rrf_fuse": _with(*_ACL_WORDS, *_ACL_NEAR, _fused("query_id", 10), select=_HITS + "fused"),
    "maxsim_rerank": _with(*_ACL_WORDS, *_ACL_NEAR, _fused("query_id", 1000), _reranked("query_id"), select=_HITS + "best"),
    "shard_route": _with(_routed("documents", 8), select="SELECT doc_id, shard FROM routed"),
    "shard_search": _with(*_sharded(_BY_SHARD), select="SELECT query_id, segment, doc_id, round(score, 6) AS score, rank FROM found"),
    "cluster_search": _cluster(_BY_SHARD),
    "deadline_search": _cluster(_BY_SHARD),
    "stream_lifecycle": _cluster(_MERGED),
    "stored_search": _cluster(_BY_FLUSH),
    "latest_segment_search": _cluster(_LATEST),
    "segment_assignment": _with(*_SEGMENTS, select="SELECT doc_id, shard, seq, segment_no FROM assigned"),
    "segment_stats": _with(*_SEGMENTS, _SEGMENT_STATS, select="SELECT shard, segment_no, n_docs, live_docs FROM segs"),
    "tombstone_ratio": _with(*_SEGMENTS, _SEGMENT_STATS, select="SELECT shard, segment_no, n_tombstones, round(tombstone_ratio, 6) AS tombstone_ratio FROM segs"),
    "live_segment_count": _with(*_SEGMENTS, select="SELECT count(DISTINCT shard) AS live_shards, count(DISTINCT (shard, segment_no)) AS segments FROM assigned"),
    "merge_pick": _with(*_SEGMENTS, _SEGMENT_STATS, _PICKED, select="SELECT shard, segment_no, live_docs, pick FROM picked"),
    "merge_compact": _with(
        *_SEGMENTS, _SEGMENT_STATS, _PICKED, "goal AS (SELECT shard, segment_no, min(segment_no) OVER (PARTITION BY shard) AS goal FROM picked)",
        select="SELECT shard, coalesce(goal, segment_no)::INT AS segment_no, doc_id FROM assigned LEFT JOIN goal USING (shard, segment_no) WHERE goal IS NULL OR doc_id NOT IN (SELECT doc_id FROM dead)",
    ),
    "tier_classify": "SELECT o_orderkey, CASE WHEN o_orderkey % 97 + 1 >= 50 OR o_custkey % 6 >= 4 THEN 'BOTH' ELSE 'TIER1_ONLY' END AS tier FROM orders",
    "metrics_counters": "SELECT event_type AS name, count(*) AS value FROM events GROUP BY 1",
    "metrics_gauges": "SELECT event_type AS name, round(arg_max(value, {'ts': ts, 'id': event_id}), 6) AS value FROM events GROUP BY 1",
    "metrics_percentiles": (
        "WITH s AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) "
        f"SELECT name, p::DOUBLE AS p, round(value, 6) AS value FROM s, unnest([{_PS}]) AS t(p) WHERE place = floor(p::DOUBLE * (n - 1))"
    ),
    "metrics_histogram_counts": "SELECT event_type AS name, count(value) AS n FROM events GROUP BY 1",
    "commit_stream": _with(
        _routed("documents", SHARDS), "halves AS (SELECT shard, count(*) FILTER (doc_id % 2 = 0) AS e, count(*) FILTER (doc_id % 2 = 1) AS o FROM routed GROUP BY shard)",
        select=f"SELECT shard, e + o AS accepted, (e + {FLUSH_AT - 1}) // {FLUSH_AT} + o // {FLUSH_AT} AS segments, o % {FLUSH_AT} AS pending FROM halves",
    ),
    "ingest_stream": _with(_routed("documents", SHARDS), select=f"SELECT shard, count(*) AS accepted, count(*) // {FLUSH_AT} AS segments, count(*) % {FLUSH_AT} AS pending FROM routed GROUP BY shard"),
}
