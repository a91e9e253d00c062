"""Queries over vectors and words: top-k, similarity joins, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import vectors as U
from corpusloom.jobs import tables as t
from corpusloom.operators import embed
from corpusloom.operators import evaluate as E
from corpusloom.operators import postings_index as P
from corpusloom.operators import retrieval as V
from corpusloom.operators import vector_index as X
from corpusloom.sources.scratch import scratch_dir

COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
TOP = f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""
CHUNKS = "c AS (SELECT vec_id AS chunk_id, 'n' || (vec_id // 3) AS note_path, embedding, label FROM embeddings)"
PAIRS = f"""WITH {CHUNKS}, p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, a.note_path AS na, b.note_path AS nb, a.label AS la, b.label AS lb, {COS} AS score FROM c a JOIN c b ON a.chunk_id < b.chunk_id AND a.note_path <> b.note_path),
f AS (SELECT a, b, round(score, 6) AS score, la IS DISTINCT FROM lb AS cross_community, (CAST(substr(na, 2) AS INT) // 2 = CAST(substr(nb, 2) AS INT) // 2) AS linked, score AS s FROM p WHERE score >= 0.3)"""
BM25 = f"""WITH tok AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), st AS (SELECT count(*) AS total, avg(len(w)) AS a FROM tok),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) GROUP BY item_id, term),
x AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY term, doc_id, dl),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
s AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(times * CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY item_id, doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""


def _round(df, score="score"):
    df = df.withColumn(score, F.round(score, 6))
    return df.withColumn("rank", F.col("rank").cast("long")) if "rank" in df.columns else df


def _flags(s, d):
    chunks = t.chunks(s, d)
    notes = chunks.select("note_path", F.substring("note_path", 2, 20).cast("int").alias("n")).distinct()
    pairs = notes.where("n % 2 = 0").join(notes.select(F.col("note_path").alias("other"), (F.col("n") - 1).alias("n")), "n")
    linked = pairs.select(F.least("note_path", "other").alias("a"), F.greatest("note_path", "other").alias("b"))
    return chunks, linked


def _bridges(s, d, cross, top_n=50):
    """Labels stand for communities: here each chunk has one of its own."""
    chunks, linked = _flags(s, d)
    best = V.similar_pairs(chunks, 0.3, best=top_n, apart="label" if cross else None)
    pairs = V.bridges(chunks, chunks.select("note_path").distinct().withColumn("community", F.lit(0)), linked, None, 0.3, pairs=best)
    of = chunks.select("chunk_id", "label")
    named = pairs.drop("cross_community").join(of.select(F.col("chunk_id").alias("a"), F.col("label").alias("la")), "a").join(of.select(F.col("chunk_id").alias("b"), F.col("label").alias("lb")), "b")
    flagged = named.select("a", "b", "score", (~F.col("la").eqNullSafe(F.col("lb"))).alias("cross_community"), "linked")
    flagged = flagged.where("cross_community") if cross else flagged
    return _round(flagged.orderBy(F.desc("score"), "a", "b").limit(top_n))


def _by_community(s, d):
    """Every fifth note is of the same community."""
    chunks, linked = _flags(s, d)
    groups = chunks.select("note_path").distinct().withColumn("community", F.substring("note_path", 2, 20).cast("int") % 5)
    return _round(V.bridges(chunks, groups, linked, 50, 0.3))


def _lists(s, d):
    """Two ranked lists a query: nearest vectors, and the same vectors by label and id."""
    top = V.dense_topk(t.chunks(s, d), t.asked(s, d), 20)
    one = top.select("query_id", F.lit(0).alias("list_idx"), (F.col("rank") - 1).alias("rank"), F.col("chunk_id").alias("id"))
    return one.unionByName(one.select("query_id", F.lit(1).alias("list_idx"), (19 - F.col("rank")).alias("rank"), "id").where("rank < 12"))


def _benchmark_queries(s, d):
    return t.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25(s, d):
    chunks = t.text_chunks(s, d)
    return V.bm25(*V.index_terms(chunks), _benchmark_queries(s, d), 10)


def _bm25_index(s, d):
    """The chunks as stored postings in two segments; the second also replaces texts of the first that are out of date."""
    chunks, index = t.text_chunks(s, d), P.PostingsIndex(s, scratch_dir(s))
    stale = F.when(F.col("chunk_id") % 10 == 1, F.concat(F.lit("old "), F.substring("text", 3, 40))).otherwise(F.col("text"))
    index.add(chunks.where("chunk_id % 3 <> 0").withColumn("text", stale))
    index.add(chunks.where("chunk_id % 3 = 0 or chunk_id % 10 = 1"))
    return index.search(_benchmark_queries(s, d), 10)


def _gold(s, d):
    """Relevant vectors: those of the query's label and parity."""
    q = t.table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    e = t.table(s, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").cast("string").alias("note_path"), "label")
    return q.join(e, "label").select("query_id", "note_path")


def _metrics(s, d):
    hits = V.dense_topk(t.chunks(s, d), t.asked(s, d), 40).select("query_id", F.col("chunk_id").cast("string").alias("note_path"), "score", "rank")
    return E.metrics(E.ranked_notes(hits), _gold(s, d)).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "rr", "ndcg")])


def _asked_notes(s, d):
    """The notes of the stated query set."""
    return t.chunks(s, d).where("chunk_id % 100 = 0").select("note_path").distinct()


def _hybrid(s, d):
    """Vectors with the documents of the same number; queries are the whole texts of the query vectors."""
    docs = t.table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    chunks = t.chunks(s, d).drop("text").join(docs, "chunk_id")
    asked = t.asked(s, d).join(docs.select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return _round(V.hybrid(chunks, asked, 10, router=True))


def _diverse(s, d):
    top = V.dense_topk(t.chunks(s, d), t.asked(s, d), 40)
    return V.diversify(top.select("query_id", F.col("chunk_id").alias("id"), "score").join(t.chunks(s, d).select(F.col("chunk_id").alias("id"), "vec"), "id"), 10, 0.7)


def _recall(s, d):
    return E.truth_recall(V.coarse_rescore(t.chunks(s, d), t.asked(s, d)), V.dense_topk(t.chunks(s, d), t.asked(s, d)))


def _index(s, d):
    """The vectors, stored by cell; so many cells are probed as a bounded sample of them says."""
    folder = scratch_dir(s)
    X.write_index(t.chunks(s, d), folder)
    return X.VectorIndex(s, folder)


def _index_topk(s, d):
    index = _index(s, d)
    return _round(index.search(t.asked(s, d), 10, index.calibrate(10, 0.95)))


def _with_copies(s, d):
    """All vectors, and for every fifth one a copy that is moved a little."""
    chunks = t.chunks(s, d).select((F.col("chunk_id") * 2).alias("chunk_id"), "note_path", "vec")
    moved = F.transform("vec", lambda x, i: F.when(i == 0, x + F.lit(0.05).cast("float")).otherwise(x))
    copies = chunks.where("chunk_id % 10 = 0").select((F.col("chunk_id") + 1).alias("chunk_id"), F.concat(F.lit("m"), (F.col("chunk_id") % 30).cast("string")).alias("note_path"), moved.alias("vec"))
    return chunks.unionByName(copies)


def _near_bridges(s, d):
    """Notes of one first letter are one community; even and odd ones are linked."""
    chunks = _with_copies(s, d)
    groups = chunks.select("note_path").distinct().withColumn("community", F.substring("note_path", 2, 20).cast("long") % 3)
    linked = chunks.where("chunk_id % 20 = 1").select(F.col("note_path").alias("x"), F.concat(F.lit("n"), F.expr("(chunk_id div 2) div 3").cast("string")).alias("y"))
    linked = linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return _round(V.bridges(chunks, groups, linked, 50, 0.92, pairs=X.near_pairs(chunks, 0.92)))


def _misses(s, d):
    """The cache holds the texts of even ids."""
    docs = t.table(s, d, "documents")
    cache = docs.where("doc_id % 2 = 0").select(embed.cache_key("m", "text").alias("key")).distinct()
    return embed.cache_misses(docs, cache, "m").select("key", F.char_length("text").cast("long").alias("chars"))


QUERIES = {
    "dense_topk": lambda s, d: _round(V.dense_topk(t.chunks(s, d), t.asked(s, d))),
    "quantize_scale": lambda s, d: V.quantize_scale(t.chunks(s, d)).select(F.round("scale", 9).alias("scale")),
    "coarse_rescore": lambda s, d: _round(V.coarse_rescore(t.chunks(s, d), t.asked(s, d))),
    "coarse_recall": _recall,
    "neighbors": lambda s, d: _round(V.neighbors(t.chunks(s, d), ["n0", "n50", "n100"])),
    "neighbors_asked": lambda s, d: _round(V.neighbors(t.chunks(s, d), _asked_notes(s, d))),
    "search_in_note": lambda s, d: _round(V.search_in_note(t.chunks(s, d), t.asked(s, d), "n33")),
    "similar_pairs": lambda s, d: _round(V.similar_pairs(t.chunks(s, d), 0.3)),
    "bridges": lambda s, d: _bridges(s, d, False),
    "bridges_cross_only": lambda s, d: _bridges(s, d, True),
    "bridges_by_community": _by_community,
    "dedupe_candidates": lambda s, d: _round(V.similar_pairs(t.chunks(s, d), 0.92)),
    "near_pairs": lambda s, d: _round(X.near_pairs(_with_copies(s, d), 0.92)),
    "bridges_near": _near_bridges,
    "vector_classes": lambda s, d: X.vector_classes(t.chunks(s, d)),
    "index_topk": _index_topk,
    "index_topk_exact": lambda s, d: _round(_index(s, d).search_exact(t.asked(s, d))),
    "l2_normalize": lambda s, d: t.table(s, d, "embeddings").select("vec_id", F.round(U.dot(U.l2_normalize(F.transform("embedding", lambda x: x * 3)), U.l2_normalize(F.col("embedding"))), 5).alias("cosine")),
    "diversity_rerank": _diverse,
    "bm25_topk": lambda s, d: _round(_bm25(s, d)),
    "bm25_index": lambda s, d: _round(_bm25_index(s, d)),
    "rrf_fusion": lambda s, d: _round(V.rrf(_lists(s, d))),
    "rrf_weighted": lambda s, d: _round(V.rrf(_lists(s, d), {0: 1.0, 1: 0.4})),
    "router_intent": lambda s, d: t.table(s, d, "conversations").select("conv_id", "turn", V.intent(F.col("text")).alias("intent")),
    "hybrid_search": _hybrid,
    "retrieval_metrics": _metrics,
    "cache_misses": _misses,
}

COPIES = f"""WITH c AS (SELECT 2 * vec_id AS chunk_id, 'n' || (vec_id // 3) AS note_path, embedding FROM embeddings
  UNION ALL SELECT 2 * vec_id + 1, 'm' || (2 * vec_id % 30), list_concat([embedding[1] + CAST(0.05 AS FLOAT)], embedding[2:]) FROM embeddings WHERE vec_id % 5 = 0),
k AS (SELECT embedding, min(chunk_id) AS chunk_id, min(note_path) AS lo, max(note_path) AS hi FROM c GROUP BY embedding),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, {COS} AS score FROM k a JOIN k b ON a.chunk_id < b.chunk_id AND NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo))"""
RRF = """t AS (SELECT query_id, chunk_id AS id, rank - 1 AS rank FROM r WHERE rank <= 20), l AS (SELECT query_id, 0 AS li, rank, id, 1.0 AS w FROM t UNION ALL SELECT query_id, 1, 19 - rank, id, {w} FROM t WHERE 19 - rank < 12),
f AS (SELECT query_id, id, round(sum(w / (60 + rank + 1)), 12) AS score, min(rank * 10 + li) AS best FROM l GROUP BY query_id, id)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, id) AS rank FROM f"""
ORACLES = {
    "dense_topk": f"{TOP} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "quantize_scale": "SELECT round(max(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))) / 127, 9) AS scale FROM embeddings",
    "coarse_rescore": f"""WITH sc AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))) / 127 AS s FROM embeddings),
z AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: greatest(least(floor(CAST(x AS DOUBLE) / s + 0.5), 127), -127)) AS code FROM embeddings, sc),
m AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_dot_product(CAST(a.code AS DOUBLE[]), CAST(b.code AS DOUBLE[])) AS dot, {COS} AS score FROM z a, z b WHERE a.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, chunk_id) AS c FROM m)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dot DESC, chunk_id) AS rank FROM k WHERE c <= 80 QUALIFY rank <= 10""",
    "neighbors": f"""WITH {CHUNKS}, x AS (SELECT *, repeat('x', CAST(chunk_id % 7 AS BIGINT)) AS text FROM c),
seed AS (SELECT *, row_number() OVER (PARTITION BY note_path ORDER BY length(text) DESC, chunk_id) AS n FROM x WHERE note_path IN ('n0', 'n50', 'n100')),
m AS (SELECT a.note_path, b.chunk_id, b.note_path AS other, {COS} AS score FROM seed a, x b WHERE a.n = 1), k AS (SELECT *, row_number() OVER (PARTITION BY note_path ORDER BY score DESC, chunk_id) AS c FROM m)
SELECT note_path, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY note_path ORDER BY score DESC, chunk_id) AS rank FROM k WHERE c <= 20 AND other <> note_path QUALIFY rank <= 10""",
    "neighbors_asked": f"""WITH {CHUNKS}, x AS (SELECT *, repeat('x', CAST(chunk_id % 7 AS BIGINT)) AS text FROM c),
seed AS (SELECT *, row_number() OVER (PARTITION BY note_path ORDER BY length(text) DESC, chunk_id) AS n FROM x WHERE note_path IN (SELECT note_path FROM c WHERE chunk_id % 100 = 0)),
m AS (SELECT a.note_path, b.chunk_id, b.note_path AS other, {COS} AS score FROM seed a, x b WHERE a.n = 1), k AS (SELECT *, row_number() OVER (PARTITION BY note_path ORDER BY score DESC, chunk_id) AS c FROM m)
SELECT note_path, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY note_path ORDER BY score DESC, chunk_id) AS rank FROM k WHERE c <= 20 AND other <> note_path QUALIFY rank <= 10""",
    "search_in_note": f"{TOP} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM r WHERE rank <= 20 AND chunk_id // 3 = 33 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5",
    "similar_pairs": f"{PAIRS} SELECT a, b, score FROM f",
    "bridges": f"{PAIRS} SELECT a, b, score, cross_community, linked FROM f ORDER BY s DESC, a, b LIMIT 50",
    "bridges_cross_only": f"{PAIRS} SELECT a, b, score, cross_community, linked FROM f WHERE cross_community ORDER BY s DESC, a, b LIMIT 50",
    "bridges_by_community": f"{PAIRS} SELECT a, b, round(score, 6) AS score, (CAST(substr(na, 2) AS INT) % 5 <> CAST(substr(nb, 2) AS INT) % 5) AS cross_community, (CAST(substr(na, 2) AS INT) // 2 = CAST(substr(nb, 2) AS INT) // 2) AS linked FROM p WHERE score >= 0.3 ORDER BY p.score DESC, a, b LIMIT 50",
    "dedupe_candidates": f"{PAIRS} SELECT a, b, score FROM f WHERE s >= 0.92",
    "near_pairs": f"{COPIES} SELECT a, b, round(score, 6) AS score FROM p WHERE score >= 0.92",
    "bridges_near": f"""{COPIES}, l AS (SELECT DISTINCT least('m' || (2 * vec_id % 30), 'n' || (vec_id // 3)) AS lo, greatest('m' || (2 * vec_id % 30), 'n' || (vec_id // 3)) AS hi FROM embeddings WHERE vec_id % 10 = 0)
SELECT p.a, p.b, round(score, 6) AS score, CAST(substr(x.note_path, 2) AS BIGINT) % 3 <> CAST(substr(y.note_path, 2) AS BIGINT) % 3 AS cross_community, l.lo IS NOT NULL AS linked
FROM p JOIN c x ON x.chunk_id = p.a JOIN c y ON y.chunk_id = p.b LEFT JOIN l ON l.lo = least(x.note_path, y.note_path) AND l.hi = greatest(x.note_path, y.note_path)
WHERE score >= 0.92 ORDER BY p.score DESC, p.a, p.b LIMIT 50""",
    "vector_classes": f"WITH {CHUNKS} SELECT c.chunk_id, k.class_id FROM c JOIN (SELECT embedding, min(chunk_id) AS class_id FROM c GROUP BY embedding) k USING (embedding)",
    "index_topk_exact": f"{TOP} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "l2_normalize": "SELECT vec_id, 1.0::DOUBLE AS cosine FROM embeddings",
    "bm25_topk": f"{BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM b WHERE rank <= 10",
    "bm25_index": f"{BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM b WHERE rank <= 10",
    "rrf_fusion": f"{TOP}, {RRF.format(w='1.0')}",
    "rrf_weighted": f"{TOP}, {RRF.format(w='0.4')}",
    "router_intent": r"""SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'mixed' WHEN regexp_matches(text, '"[^"]+"|“[^”]+”') OR regexp_matches(text, '\b[A-Z]{3,}\b') OR regexp_matches(text, '\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b')
  OR len(regexp_extract_all(text, '[\p{L}\p{N}]+')) <= 3 THEN 'specific' WHEN len(regexp_extract_all(text, '[\p{L}\p{N}]+')) >= 8 THEN 'broad' ELSE 'mixed' END AS intent FROM conversations""",
    "retrieval_metrics": f"""{TOP}, k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE rank <= 40 AND score > 0),
g AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 2 = 0 WHERE a.vec_id % 100 = 0),
m AS (SELECT g.query_id, count(*) AS n, count(*) FILTER (WHERE rank <= 10) AS hits, min(rank) AS f, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS dcg FROM g LEFT JOIN k USING (query_id, chunk_id) GROUP BY g.query_id)
SELECT query_id, round(hits / n, 6) AS recall, round(coalesce(1 / f, 0), 6) AS rr, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(n, 10) + 1 AS BIGINT)) x(i)), 6) AS ndcg FROM m""",
    "cache_misses": "SELECT DISTINCT sha256(sha256('m') || text) AS key, length(text) AS chars FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
}
