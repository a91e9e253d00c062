"""Queries opN_<name>: each applies one operator to its whole table; with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import audio, bpe, common, divergence, linededup, mixing, neardup, pii, ppm, quality, runs, sharding, tokencount, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    left_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    scored = ppm.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), ~left_out)
    return scored.withColumn("held_out", ~F.col("train")).drop("train")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    return bpe.digests(encoded, vocabulary)


def _is_kind(kind: int):
    return lambda x: x["kind"] == kind


def op4_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(F.encode(pii.span_text("base"), "UTF-8"), 256).alias("base_sha256"), pii.span_text("spans").alias("spans"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("source", "queue_pos")


def op6_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return judged.drop("text")


def op7_pack_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack_shards(_table(spark, sf_dir, "documents"))
    return packed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_dir(spark)
    index = warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_bytes", common.text_bytes().cast("long"))
    media = common.materialise(audio.store_text_media(docs).drop("text"))
    return audio.audio_features(media).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        audio.feature_digest().alias("feature"),
    )


def repeating_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in the documents that op11 makes periodic the first p words from word a on come again and again.

    Words, a and p are columns of their own, as a lambda would work them out again for every word.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)))
    cut = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g"))
    cut = cut.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    made = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeating_texts(_table(spark, sf_dir, "documents"))
    found = runs.find_runs(docs).withColumn("best", runs.longest())
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode(runs.run_lines(), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", common.text_bytes().cast("long").alias("n_bytes"))
    counted = tokencount.count_tokens(docs, tokencount.Rules.load(public_tokenizers.path("byte_bpe_50k.json")), keep=("doc_id", "n_bytes"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


QUERIES = [op1_ppm_score, op2_jaccard_join, op3_byte_bpe, op4_private_spans, op5_mix_sources, op6_quality_llr, op7_pack_shards, op8_warc_bundles, op9_line_dedup, op10_audio_features, op11_word_runs, op12_token_counts, op13_source_audit]

#: DuckDB can read these as they stand; others have tests against brute force.
ORACLES = {
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n, sh FROM s),
x AS (SELECT doc_id, n, unnest(sh) AS t FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(d, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d WHERE r.c < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n""",
    "op5_mix_sources": r"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END) AS w FROM base GROUP BY source),
fill AS (SELECT *, 2 * source_size AS cap,
  ((SELECT sum(source_size) FROM s) * 150 / 100.0 - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
lev AS (SELECT min_by(level, cap / w) FILTER (WHERE level * w < cap) AS level FROM fill),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(CAST((SELECT level FROM lev) AS DOUBLE) * w, cap)) AS target FROM fill),
copies AS (SELECT base.*, epoch, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(epoch AS VARCHAR))) AS key FROM base, (VALUES (0), (1)) e(epoch)),
timed AS (SELECT c.*, t.target, sum(size) OVER (PARTITION BY c.source ORDER BY epoch, key, doc_id, size, r ROWS UNBOUNDED PRECEDING) / t.target AS finish
  FROM copies c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE size > 0),
cut AS (SELECT *, sum(size) OVER (ORDER BY finish, source, epoch, key, doc_id, r ROWS UNBOUNDED PRECEDING) AS upto FROM timed),
took AS (SELECT r, sum(size) AS taken FROM cut WHERE upto <= floor((SELECT sum(target) FROM t) + 1e-6) GROUP BY r)
SELECT b.doc_id, b.size, t.source_size, t.target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN took USING (r)""",
    "op8_warc_bundles": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
bits AS (SELECT DISTINCT h, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    1 + (CAST(('0x' || substr(h, CAST(1 + (i * 5) // 4 AS BIGINT), 1)) AS BIGINT) * 16 + CAST(('0x' || coalesce(nullif(substr(h, CAST(2 + (i * 5) // 4 AS BIGINT), 1), ''), '0')) AS BIGINT)) // CAST(pow(2, 3 - (i * 5) % 4) AS BIGINT) % 32 AS BIGINT), 1)), 'string_agg', '') AS d FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h) JOIN bits USING (h)""",
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, u.pos, u.line, translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_zip(range(len(string_split(coalesce(text, ''), chr(10)))), string_split(coalesce(text, ''), chr(10)))) AS z FROM documents) q, LATERAL (SELECT z[1] AS pos, z[2] AS line) u),
k AS (SELECT key, max(doc_id) AS owner FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, k.owner IS NOT NULL AND k.owner <> l.doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op13_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
x AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY lang),
o AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang, source),
g AS (SELECT lang, source, coalesce(o.n, 0) + coalesce(v.v, 0) AS w, v.n + v.v AS lang_w
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang) LEFT JOIN o USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // g.w AS p, c.n, 1 + (1000000000::HUGEINT * (k.n + 1)) // g.lang_w AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rank <= 200""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
