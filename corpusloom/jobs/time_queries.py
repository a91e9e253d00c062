"""Queries over time: changes, revisions, drift, forecasts, sessions, incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.jobs import tables as t
from corpusloom.operators import corpus as C
from corpusloom.operators import rewrite as R
from corpusloom.operators import temporal as D
from corpusloom.sources import snapshot
from corpusloom.streaming import changes

AS_OF = "2024-01-31 00:00:00"
FILES = "WITH f AS (SELECT 'u' || user_id || '/' || event_id || '.md' AS note_path, ts AS modified FROM events)"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _micros(df):
    return df.withColumn("modified", F.unix_micros("modified"))


def _text_revisions(s, d):
    """Documents of a source as revisions of one note, a day apart, in order of doc_id."""
    docs = t.table(s, d, "documents")
    day = F.timestamp_micros(F.col("doc_id") * F.lit(86_400_000_000))
    return docs.select(F.concat("source", F.lit("-"), (F.expr("doc_id div 20") % 10).cast("string")).alias("note_path"), day.alias("commit_ts"), F.col("text").alias("content"))


def _resolved(s, d):
    return t.table(s, d, "labels").select(((F.col("doc_id") % 101) / 100).alias("probability"), (F.col("quality") == 1).alias("outcome"))


def _forecast_notes(s, d):
    """Labelled documents as notes with nested frontmatter."""
    line = lambda k, v: F.concat(F.lit(f"  {k}: "), v, F.lit("\n"))
    body = [F.lit("---\nforecast:\n"), line("claim", F.concat(F.lit("claim "), F.col("doc_id").cast("string"))), line("by", F.lit("2027-12-31")), line("marked_at", F.lit("2024-01-01")), line("probability", ((F.col("doc_id") % 130) / 100).cast("string"))]
    end = F.concat(F.lit("resolved:\n"), line("outcome", F.when(F.col("quality") == 1, "true").when(F.col("toxic") == 1, "false").otherwise("maybe")), line("resolved_at", F.lit("2025-01-01")), F.lit("---\nbody\n"))
    return t.table(s, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("note_path"), F.concat(*body, end).alias("text"))


def _diff(s, d):
    """The stored state: documents of ids not divisible by 10, every seventh with another text, and some that are gone."""
    docs = t.plain(s, d)
    prior = docs.where("doc_id % 10 <> 0").select("note_path", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    gone = docs.where("doc_id % 50 = 1").select(F.concat(F.lit("gone/"), "note_path").alias("note_path"), "text")
    return snapshot.restore_diff(snapshot.content_sha(docs), snapshot.content_sha(prior.unionByName(gone)))


def _slopes(df):
    return df.select("note_path", "n", F.round("conviction_slope", 6).alias("conviction_slope"), F.round("supporting_slope", 6).alias("supporting_slope"))


QUERIES = {
    "recent": lambda s, d: _micros(C.recent(t.files(s, d))),
    "changed_since": lambda s, d: _micros(C.changed_since(t.files(s, d), F.lit("2024-01-30 12:00:00").cast("timestamp"))),
    "stale": lambda s, d: C.stale(t.files(s, d), _as_of(), 20.5).select("note_path", F.round("age_days", 6).alias("age_days")),
    "date_range": lambda s, d: _micros(C.date_range(t.files(s, d), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-11").cast("timestamp"))),
    "today": lambda s, d: _micros(C.today(t.files(s, d), F.lit("2024-01-30 10:00:00").cast("timestamp"))),
    "freshness": lambda s, d: C.freshness(t.files(s, d), _as_of()).select("note_path", "kind"),
    "periodic_stems": lambda s, d: t.table(s, d, "events").select("event_id", *[R.periodic_stem(F.to_date("ts"), p).alias(p) for p in ("daily", "weekly", "monthly", "yearly")]),
    "revisions_topn": lambda s, d: D.revisions_top(t.revisions(s, d), 5).select("note_path", "sha", F.col("rank").cast("long").alias("rank")),
    "conviction": lambda s, d: t.plain(s, d).select("note_path", F.round(T.conviction("text"), 9).alias("conviction")),
    "drift_slopes": lambda s, d: _slopes(D.drift_slopes(t.revisions(s, d))),
    "drift_flags": lambda s, d: _slopes(D.drift_flags(t.revisions(s, d), 0.0003, 0.005)),
    "lexicon_stability": lambda s, d: D.lexicon_stability(_text_revisions(s, d)),
    "forecasts": lambda s, d: D.forecasts(_forecast_notes(s, d)),
    "brier": lambda s, d: D.brier(_resolved(s, d)).select("n", F.round("brier", 9).alias("brier")),
    "restore_diff": _diff,
    "debounce_sessions": lambda s, d: changes.debounce(t.table(s, d, "events").select(F.col("user_id").cast("string").alias("note_path"), F.col("ts").cast("timestamp").alias("ts")), "6 hours").select("note_path", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "edits"),
}

DAYS = "epoch_us(ts) / 86400000000.0"
SLOPES = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS note_path, {DAYS} AS x, value / 100 AS c, CAST(json_extract_string(props, '$.k') AS BIGINT) AS s FROM events),
z AS (SELECT note_path, x - min(x) OVER (PARTITION BY note_path) AS x, c, s FROM e), g AS (SELECT note_path, count(*) AS n, coalesce(regr_slope(c, x), 0) AS cs, coalesce(regr_slope(s, x), 0) AS ss FROM z GROUP BY note_path)
SELECT note_path, n, round(cs, 6) AS conviction_slope, round(ss, 6) AS supporting_slope FROM g"""
COUNT = lambda words: " + ".join(f"len(regexp_extract_all(lower(text), '\\b{w}\\b'))" for w in words)
ORACLES = {
    "recent": f"{FILES} SELECT note_path, epoch_us(modified) AS modified FROM f ORDER BY modified DESC, note_path LIMIT 20",
    "changed_since": f"{FILES} SELECT note_path, epoch_us(modified) AS modified FROM f WHERE modified >= TIMESTAMP '2024-01-30 12:00:00' ORDER BY f.modified DESC, note_path LIMIT 50",
    "stale": f"{FILES} SELECT note_path, round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(modified)) / 86400000000, 6) AS age_days FROM f WHERE (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(modified)) / 86400000000 > 20.5 ORDER BY modified, note_path LIMIT 50",
    "date_range": f"{FILES} SELECT note_path, epoch_us(modified) AS modified FROM f WHERE modified BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11' ORDER BY f.modified DESC, note_path LIMIT 100",
    "today": f"{FILES} SELECT note_path, epoch_us(modified) AS modified FROM f WHERE modified >= TIMESTAMP '2024-01-30' ORDER BY f.modified DESC, note_path LIMIT 200",
    "freshness": f"""{FILES} (SELECT note_path, 'recent' AS kind FROM f ORDER BY modified DESC, note_path LIMIT 10) UNION ALL (SELECT note_path, 'stale' FROM f WHERE modified < TIMESTAMP '{AS_OF}' ORDER BY modified, note_path LIMIT 10)""",
    "periodic_stems": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS daily, strftime(ts, '%G-W%V') AS weekly, strftime(ts, '%Y-%m') AS monthly, strftime(ts, '%Y') AS yearly FROM events",
    "revisions_topn": "SELECT CAST(user_id AS VARCHAR) AS note_path, sha1(CAST(event_id AS VARCHAR)) AS sha, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, sha1(CAST(event_id AS VARCHAR))) AS rank FROM events QUALIFY rank <= 5",
    "conviction": f"""SELECT source || '/' || doc_id || '.md' AS note_path, CASE WHEN len(regexp_extract_all(lower(text), '[a-z'']+')) = 0 THEN 0.0 ELSE
  round(({COUNT(T.ASSERTIONS)} - ({COUNT(T.HEDGES)})) / len(regexp_extract_all(lower(text), '[a-z'']+')), 9) END AS conviction FROM documents""",
    "drift_slopes": SLOPES,
    "drift_flags": SLOPES + " WHERE n >= 3 AND cs >= 0.0003 AND ss <= 0.005",
    "forecasts": """SELECT doc_id || '.md' AS note_path, 'claim ' || doc_id AS claim, '2027-12-31T00:00:00.000Z' AS by, '2024-01-01T00:00:00.000Z' AS marked_at,
  CASE WHEN doc_id % 130 <= 100 THEN (doc_id % 130) / 100 ELSE 0.5 END AS probability, CASE WHEN quality = 1 THEN true WHEN toxic = 1 THEN false END AS outcome, '2025-01-01T00:00:00.000Z' AS resolved_at FROM labels""",
    "brier": "SELECT count(*) AS n, round(avg(pow((doc_id % 101) / 100 - CAST(quality = 1 AS INT), 2)), 9) AS brier FROM labels",
    "restore_diff": """SELECT source || '/' || doc_id || '.md' AS note_path, CASE WHEN doc_id % 10 <> 0 AND doc_id % 7 <> 0 THEN 'restored' ELSE 'rebuilt' END AS action FROM documents
UNION ALL SELECT 'gone/' || source || '/' || doc_id || '.md', 'pruned' FROM documents WHERE doc_id % 50 = 1""",
    "debounce_sessions": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS note_path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY note_path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT note_path, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS edits FROM g GROUP BY note_path, k""",
}
