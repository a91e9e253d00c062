"""Queries over the link graph, citations and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.jobs import tables as t
from corpusloom.jobs.corpus_queries import WITH
from corpusloom.operators import links as L
from corpusloom.operators import reasoning as G
from corpusloom.operators import retrieval as V

LINKS = rf"""{WITH}, raw AS (SELECT note_path, regexp_extract_all(text, '!?\[\[([^\]]+?)\]\]', 1) AS r FROM notes),
each AS (SELECT note_path AS src, i AS pos, trim(split_part(split_part(r[i], '|', 1), '#', 1)) AS target FROM raw, unnest(range(1, len(r) + 1)) u(i)),
links AS (SELECT src, target, min(pos) AS pos FROM each WHERE target <> '' GROUP BY src, target),
keys AS (SELECT key, min(note_path) AS dst FROM (SELECT note_path, lower(regexp_replace(split_part(note_path, '/', 2), '\.md$', '')) AS key FROM notes UNION SELECT note_path, lower(note_path) FROM notes UNION SELECT note_path, regexp_replace(lower(note_path), '\.md$', '') FROM notes) GROUP BY key),
res AS (SELECT src, target, dst FROM links LEFT JOIN keys ON lower(target) = key)"""


def _links(s, d):
    return L.outbound(t.notes(s, d))


def _titles(s, d):
    """The notes' own titles, and benchmark texts as whole titles."""
    return t.notes(s, d).select(T.basename("note_path").alias("title")).unionByName(t.table(s, d, "benchmark").select(F.col("text").alias("title")))


def _answers(s, d):
    """Conversation turns with two citations made from their own numbers."""
    c = t.table(s, d, "conversations")
    ref = lambda a, b: F.concat(F.lit("[ref:src"), a.cast("string"), F.lit("/"), b.cast("string"), F.lit(".md:"), F.col("turn").cast("string"), F.lit("-"), (F.col("turn") + b).cast("string"), F.lit("]"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat("text", F.lit(" "), ref(F.col("conv_id") % 20, F.col("conv_id")), F.lit(" and "), ref(F.col("turn"), F.col("conv_id"))).alias("text"))


def _hops(s, d):
    docs = t.table(s, d, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("note_path"), F.lit(2).cast("long").alias("byte_start"), (F.col("doc_id") + 2).alias("byte_end"))


def _trace(s, d):
    chunks = t.chunks(s, d)
    notes = chunks.select("note_path").distinct().withColumn("targets", F.array(F.concat(F.lit("n"), F.expr("string(int(substring(note_path, 2)) + 1)"))))
    seeds = V.dense_topk(chunks, t.asked(s, d), 3).select(F.col("query_id").alias("question_id"), "chunk_id", "score", "rank")
    return G.trace(chunks, notes, notes.select("note_path"), seeds).select("question_id", "step", "from_id", "to_id", "edge", F.round("score", 6).alias("score"), "ord")


def _prompts(s, d):
    """For each conversation's first turn, its later turns as hops."""
    c = t.table(s, d, "conversations")
    hops = c.where("turn > 0").select(F.col("conv_id").alias("question_id"), (F.col("turn") - 1).alias("ord"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("note_path"), F.col("turn").alias("byte_start"), F.char_length("text").cast("long").alias("byte_end"), F.col("role").alias("heading"), "text")
    return G.compose_prompts(c.where("turn = 0").select(F.col("conv_id").alias("question_id"), F.col("text").alias("question")), hops).select("question_id", F.sha2("prompt", 256).alias("sha256"))


QUERIES = {
    "link_edges": lambda s, d: L.edges(_links(s, d), t.notes(s, d)),
    "orphans": lambda s, d: L.orphans(_links(s, d), t.notes(s, d)),
    "inbound_ranking": lambda s, d: L.inbound_ranking(_links(s, d), t.notes(s, d)),
    "link_counts": lambda s, d: L.link_counts(_links(s, d)),
    "broken_links": lambda s, d: L.broken_links(_links(s, d), t.notes(s, d)),
    "link_audit": lambda s, d: L.link_audit(_links(s, d), t.notes(s, d)),
    "mutual_links": lambda s, d: L.mutual_links(_links(s, d), t.notes(s, d)),
    "link_completions": lambda s, d: L.completions(t.notes(s, d), "12"),
    "link_graph": lambda s, d: L.link_graph(_links(s, d), t.notes(s, d), "src10/10.md"),
    "unlinked_mentions": lambda s, d: L.unlinked_mentions(t.notes(s, d), _titles(s, d), keep_code=True),
    "communities": lambda s, d: L.communities(_links(s, d), t.notes(s, d)),
    "trace": _trace,
    "extract_citations": lambda s, d: G.extract_citations(_answers(s, d)),
    "validate_citations": lambda s, d: G.validate_citations(G.extract_citations(_answers(s, d)), _hops(s, d)).select("answer_id", "pos", "valid"),
    "prompt_build": _prompts,
}

CITED = """WITH a AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn FROM conversations), c AS (
  SELECT answer_id, CAST(0 AS BIGINT) AS pos, 'src' || (conv_id % 20) || '/' || conv_id || '.md' AS note_path, turn AS byte_start, turn + conv_id AS byte_end FROM a
  UNION ALL SELECT answer_id, 1, 'src' || turn || '/' || conv_id || '.md', turn, turn + conv_id FROM a)"""
ORACLES = {
    "link_edges": f"{LINKS} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM res WHERE dst <> src",
    "orphans": f"{LINKS} SELECT note_path FROM notes WHERE note_path NOT IN (SELECT dst FROM res WHERE dst IS NOT NULL)",
    "inbound_ranking": f"{LINKS} SELECT note_path, count(dst) AS inbound FROM notes LEFT JOIN res ON dst = note_path GROUP BY note_path",
    "link_counts": f"{LINKS} SELECT note_path, count(target) AS outbound FROM notes LEFT JOIN links ON src = note_path GROUP BY note_path",
    "broken_links": f"{LINKS} SELECT src, target FROM res WHERE dst IS NULL",
    "link_audit": f"{LINKS} SELECT target, count(*) AS n, bool_or(dst IS NOT NULL) AS resolved FROM res GROUP BY target",
    "mutual_links": f"{LINKS}, p AS (SELECT DISTINCT src, dst FROM res WHERE dst <> src) SELECT x.src AS a, x.dst AS b FROM p x JOIN p y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst",
    "link_completions": f"{WITH} SELECT note_path FROM notes WHERE starts_with(split_part(note_path, '/', 2), '12') OR starts_with(note_path, '12') ORDER BY note_path LIMIT 20",
    "link_graph": f"{LINKS} SELECT 'out' AS direction, target AS other FROM links WHERE src = 'src10/10.md' UNION ALL SELECT DISTINCT 'in', src FROM links WHERE lower(target) IN ('10', 'src10/10.md')",
    "extract_citations": f"{CITED} SELECT * FROM c",
    "validate_citations": f"{CITED} SELECT answer_id, pos, (note_path, byte_start, byte_end) IN (SELECT (source || '/' || doc_id || '.md', 2, doc_id + 2) FROM documents) AS valid FROM c",
    "prompt_build": """WITH h AS (SELECT conv_id, turn - 1 AS ord, '#' || turn || ' [ref:c' || conv_id || ':' || turn || '-' || length(text) || '] heading: ' || role || chr(10) || '   text: ' || CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS item FROM conversations WHERE turn > 0),
g AS (SELECT conv_id, string_agg(item, chr(10) ORDER BY ord) AS items FROM h GROUP BY conv_id)
SELECT conv_id AS question_id, sha256('Question: ' || text || chr(10) || chr(10) || CASE WHEN items IS NULL THEN 'Available citations: (none)' ELSE 'Available citations:' || chr(10) || items END) AS sha256 FROM conversations LEFT JOIN g USING (conv_id) WHERE turn = 0""",
}
