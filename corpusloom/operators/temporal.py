"""Revisions, conviction drift, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.retrieval import top_k

# What a perturbed lexicon swaps.
SYNONYMS = {"maybe": "mayhap", "perhaps": "conceivably", "definitely": "undoubtedly"}


def revisions_top(revisions: DataFrame, limit: int = 50, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The newest ``limit`` revisions of each note, with rank from 1, within a range of commit times."""
    found = revisions
    if since is not None:
        found = found.where(F.col("commit_ts") >= since)
    if until is not None:
        found = found.where(F.col("commit_ts") <= until)
    return top_k(found, limit, "note_path", "sha", score="commit_ts")


def content_at(revisions: DataFrame, contents: DataFrame) -> DataFrame:
    """Each revision with its content, null where there is none."""
    return revisions.join(contents.select("sha", "note_path", "content"), ["sha", "note_path"], "left")


def slope(y: Column | str, days: Column | str) -> Column:
    """Least-squares slope; fewer than two points or no spread in days give 0."""
    return F.coalesce(F.regr_slope(y, days), F.lit(0.0))


def drift_slopes(revisions: DataFrame) -> DataFrame:
    """(note_path, n, conviction_slope, supporting_slope) from (note_path, commit_ts, conviction, supporting)."""
    days = (F.unix_micros(F.col("commit_ts").cast("timestamp")) / 86_400_000_000.0).alias("days")
    shaped = revisions.select("note_path", days, F.col("conviction").cast("double").alias("c"), F.col("supporting").cast("double").alias("s"))
    first = shaped.groupBy("note_path").agg(F.min("days").alias("first"))
    shaped = shaped.join(first, "note_path").withColumn("days", F.col("days") - F.col("first"))
    return shaped.groupBy("note_path").agg(F.count("*").alias("n"), slope("c", "days").alias("conviction_slope"), slope("s", "days").alias("supporting_slope"))


def drift_flags(revisions: DataFrame, min_conviction: float = 0.0003, max_supporting: float = 0.005) -> DataFrame:
    """Notes of three revisions or more whose conviction rises while their supporting links do not."""
    return drift_slopes(revisions).where((F.col("n") >= 3) & (F.col("conviction_slope") >= min_conviction) & (F.col("supporting_slope") <= max_supporting))


def score_revisions(revisions: DataFrame, hedges: tuple[str, ...] = T.HEDGES, assertions: tuple[str, ...] = T.ASSERTIONS) -> DataFrame:
    """Adds conviction and supporting (distinct links) from content."""
    return revisions.withColumn("conviction", T.conviction("content", hedges, assertions)).withColumn("supporting", F.size(T.wikilinks("content")))


def perturbations(hedges: tuple[str, ...] = T.HEDGES, assertions: tuple[str, ...] = T.ASSERTIONS, n: int = 10) -> list[tuple[str, tuple[str, ...], tuple[str, ...]]]:
    """(id, hedges, assertions): the lexicons as they are, without each of the first three words, and with synonyms."""
    made = [("v1", hedges, assertions)]
    made += [(f"drop-hedge-{i}", hedges[:i] + hedges[i + 1 :], assertions) for i in range(min(3, len(hedges)))]
    made += [(f"drop-assertion-{i}", hedges, assertions[:i] + assertions[i + 1 :]) for i in range(min(3, len(assertions)))]
    swap = lambda words, old: tuple(SYNONYMS[w] if w == old else w for w in words)
    made += [(f"swap-hedge-{w}", swap(hedges, w), assertions) for w in ("maybe", "perhaps")]
    made += [("swap-assertion-definitely", hedges, swap(assertions, "definitely"))]
    return made[:n]


def lexicon_stability(revisions: DataFrame, n: int = 10) -> DataFrame:
    """(id, flagged, jaccard): how many notes drift under each perturbed lexicon, and the overlap with the first.

    All lexicons are scored in one pass over contents; counts of flags are the only thing that is grouped.
    """
    variants = perturbations(n=n)
    terms = sorted({w for _, h, a in variants for w in (*h, *a)})
    low = F.lower("content")
    counted = revisions.select("note_path", "commit_ts", F.size(T.wikilinks("content")).alias("supporting"), F.regexp_count(low, F.lit(r"[a-z']+")).alias("words"), T.terms_in(low, tuple(terms)).alias("found"))
    times = lambda w: F.size(F.filter("found", lambda x: x == w))
    counted = counted.withColumn("hits", F.array(*map(times, terms))).drop("found")
    # the sum of hits x (1 for assertions, -1 for hedges) over the terms, for each variant
    signs = F.array(*[F.struct(F.lit(name).alias("id"), F.array(*[F.lit((w in a) - (w in h)) for w in terms]).alias("sign")) for name, h, a in variants])
    spread = counted.withColumn("v", F.explode(signs))
    total = F.aggregate(F.zip_with("hits", "v.sign", lambda x, y: x * y), F.lit(0), lambda acc, x: acc + x)
    each = spread.select("note_path", "commit_ts", "supporting", F.struct("v.id", F.when(F.col("words") > 0, total / F.col("words")).otherwise(0.0).alias("conviction")).alias("v"))
    keyed = each.select(F.concat_ws("\u0001", "v.id", "note_path").alias("note_path"), "commit_ts", "supporting", F.col("v.conviction").alias("conviction"))
    fired = drift_flags(keyed).select(F.split_part("note_path", F.lit("\u0001"), F.lit(1)).alias("id"), F.split_part("note_path", F.lit("\u0001"), F.lit(2)).alias("note_path"))
    base = fired.where(F.col("id") == "v1").select("note_path", F.lit(True).alias("base"))
    marked = fired.join(base, "note_path", "left")
    counted = marked.groupBy("id").agg(F.count("*").alias("flagged"), F.count("base").alias("both"))
    size = fired.where(F.col("id") == "v1").agg(F.count("*").alias("whole"))
    names = revisions.sparkSession.createDataFrame([(v[0],) for v in variants], "id string")
    told = names.join(counted, "id", "left").crossJoin(size).select("id", F.coalesce("flagged", F.lit(0)).alias("flagged"), F.coalesce("both", F.lit(0)).alias("both"), "whole")
    union = F.col("flagged") + F.col("whole") - F.col("both")
    return told.select("id", F.col("flagged").cast("long").alias("flagged"), F.when(union > 0, F.col("both") / union).otherwise(1.0).alias("jaccard"))


def forecasts(notes: DataFrame) -> DataFrame:
    """(note_path, claim, by, marked_at, probability, outcome, resolved_at) from nested frontmatter of notes.

    A forecast needs claim, by and marked_at; a probability that is no number from 0 to 1 is 0.5; outcome is null
    unless it is true or false and resolved_at is there.
    """
    block = F.regexp_extract("text", r"^---\n([\s\S]*?)\n---(?:\n|\z)", 1)
    part = lambda name: F.regexp_extract(block, rf"(?:^|\n){name}:[ \t]*\n((?:[ \t]+[^\n]*(?:\n|\z))+)", 1)
    field = lambda src, name: F.nullif(F.regexp_replace(F.trim(F.regexp_extract(src, rf"(?:^|\n)[ \t]+{name}:[ \t]*([^\n]*)", 1)), r"^([\"'])(.*)\1\z", "$2"), F.lit(""))
    iso = lambda x: F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.concat(x, F.lit("T00:00:00.000Z"))).otherwise(x)
    told = notes.select("note_path", part("forecast").alias("f"), part("resolved").alias("r"))
    number = F.expr("try_cast(p AS double)")
    told = told.select("note_path", field(F.col("f"), "claim").alias("claim"), iso(field(F.col("f"), "by")).alias("by"), iso(field(F.col("f"), "marked_at")).alias("marked_at"), field(F.col("f"), "probability").alias("p"), field(F.col("r"), "outcome").alias("o"), iso(field(F.col("r"), "resolved_at")).alias("resolved_at"))
    outcome = F.when(F.col("o").isin("true", "false") & F.col("resolved_at").isNotNull(), F.col("o") == "true")
    shaped = told.select("note_path", "claim", "by", "marked_at", F.when(number.between(0, 1), number).otherwise(0.5).alias("probability"), outcome.alias("outcome"), "resolved_at")
    return shaped.where("claim is not null and by is not null and marked_at is not null")


def brier(resolved: DataFrame) -> DataFrame:
    """(n, brier) of (probability, outcome); no rows give null."""
    return resolved.where("outcome is not null").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("probability") - F.col("outcome").cast("int"), F.lit(2.0))).alias("brier"))

