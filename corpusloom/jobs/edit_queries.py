"""Queries over edits of notes, structure that plain documents lack, folders, trash, snapshots and citations.

Each works on the whole table of documents (or events, conversations), given the structure that its operator looks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.jobs import tables as t
from corpusloom.jobs.corpus_queries import LINES, PLAIN, WITH
from corpusloom.jobs.link_queries import LINKS
from corpusloom.jobs.retrieval_queries import ORACLES as RETRIEVED
from corpusloom.jobs.retrieval_queries import _gold
from corpusloom.jobs.time_queries import COUNT, _text_revisions
from corpusloom.operators import chunking
from corpusloom.operators import corpus as C
from corpusloom.operators import embed
from corpusloom.operators import evaluate as E
from corpusloom.operators import extract as X
from corpusloom.operators import links as L
from corpusloom.operators import reasoning as G
from corpusloom.operators import retrieval as V
from corpusloom.operators import rewrite as R
from corpusloom.operators import temporal as D
from corpusloom.sources import scratch, snapshot

SHAPE = ["# Top", "intro {doc_id}", "## Part", "body {doc_id}", "### Sub", "more {lang}", "## End", "{text}"]


def _line(line: str) -> Column:
    """A line with {column} in it."""
    head, _, name = line.partition("{")
    return F.concat(F.lit(head), F.col(name[:-1]).cast("string")) if name else F.lit(line)


def _filled(s, d, lines: list[str]) -> DataFrame:
    """(note_path, text): ``lines`` filled from each document."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t.table(s, d, "documents").select(path.alias("note_path"), F.concat_ws("\n", *map(_line, lines)).alias("text"))


def _sha(notes: DataFrame) -> DataFrame:
    return notes.select("note_path", F.sha2("text", 256).alias("sha256"))


def _shaped(s, d):
    return _filled(s, d, SHAPE)


def _files(s, d) -> DataFrame:
    """Documents as files of several kinds, in folders by language, some of them hidden."""
    docs = t.table(s, d, "documents")
    n = F.col("doc_id")
    end = F.when(n % 4 == 0, ".png").when(n % 4 == 1, ".PDF").when(n % 4 == 2, ".md").otherwise(".csv.gz")
    folder = F.when(n % 3 == 0, F.concat("lang", F.lit("/"), "source", F.lit("/"))).when(n % 3 == 1, F.concat("lang", F.lit("/"))).otherwise("")
    return docs.select(F.concat(folder, F.when(n % 11 == 0, ".").otherwise(""), n.cast("string"), end).alias("path"), F.octet_length("text").cast("long").alias("bytes"))


def _paths(s, d, every: int) -> DataFrame:
    """Paths of the documents whose id is divisible by ``every``."""
    return t.plain(s, d).where(F.col("doc_id") % every == 0).select("note_path")


def _new_notes(s, d):
    """Pages as notes: a third under the path of a document, the others under a new one."""
    pages, docs = t.table(s, d, "pages"), t.plain(s, d)
    named = pages.join(docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id"), "note_path"), "page_id", "left")
    return named.select(F.coalesce("note_path", F.concat(F.lit("new/"), F.col("page_id").cast("string"), F.lit(".md"))).alias("note_path"), F.col("html").alias("text"))


def _copies(s, d):
    docs = t.plain(s, d)
    target = F.when(F.col("doc_id") % 10 == 0, F.col("note_path")).otherwise(F.concat(F.lit("copy/"), F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.where("doc_id % 5 = 0").select("note_path", target.alias("target"))


def _renames(s, d):
    docs = t.plain(s, d)
    source = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("missing/"), "note_path")).otherwise(F.col("note_path"))
    target = F.when(F.col("doc_id") % 4 == 0, F.col("note_path")).otherwise(F.concat(F.lit("renamed/"), "note_path"))
    return docs.select(source.alias("note_path"), target.alias("target"))


def _trash(s, d):
    stay, gone = R.trash(t.plain(s, d).select("note_path", "text"), _paths(s, d, 7), "2024-01-01")
    return stay.select("note_path", F.lit("stays").alias("state")).unionByName(gone.select("note_path", F.col("stamp").alias("state")))


def _trashed(s, d):
    """Documents as trashed versions of fifty notes a source."""
    path = F.concat("source", F.lit("/"), F.expr("doc_id % 50").cast("string"), F.lit(".md"))
    return t.table(s, d, "documents").select(path.alias("note_path"), "text", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("stamp"))


def _folders(s, d):
    docs = t.table(s, d, "documents")
    return docs.select("source").distinct().select(F.explode(F.array("source", F.concat(F.lit("none/"), "source"))).alias("path"))


def _template(s, d):
    filled = R.fill_template(F.lit("# {{title}}\n{{ lang }} of {{source}}, {{unknown}}"), {"title": F.col("note_path"), "lang": F.col("lang"), "source": F.col("source")})
    return t.notes(s, d).select("note_path", filled.alias("text"))


def _sha_answers(s, d):
    """Each event cites a revision: its own by twelve characters, or one that is none."""
    e = t.table(s, d, "events")
    sha = F.when(F.col("event_id") % 3 == 0, F.lit("0123456789ab")).otherwise(F.substring(F.sha1(F.col("event_id").cast("string")), 1, 12))
    return e.select(F.col("event_id").alias("answer_id"), F.concat(F.lit("see [sha:"), sha, F.lit(" @ 2024-01-0"), (F.col("event_id") % 9 + 1).cast("string"), F.lit("] and so on")).alias("text"))


def _narrate(s, d):
    told = t.revisions(s, d).withColumn("content", F.when(F.col("supporting") % 2 == 0, F.repeat(F.col("message"), 60)))
    return G.narrate_prompts(told).select("note_path", F.sha2("prompt", 256).alias("sha256"))


def _drift(s, d):
    slopes = D.drift_slopes(D.score_revisions(_text_revisions(s, d)))
    flag = (F.col("n") >= 3) & (F.col("conviction_slope") >= 1e-6) & (F.col("supporting_slope") <= 0.005)
    return slopes.select("note_path", "n", F.round("conviction_slope", 9).alias("conviction_slope"), flag.alias("flagged"))


def _line_chunks(notes: DataFrame) -> DataFrame:
    return C.numbered_lines(notes).select("note_path", F.col("line").cast("long").alias("line"), F.col("content").alias("text"))


def _refreshed(s, d):
    """Chunks (lines) after a restore: the stored state lacks some notes, has others with another text, and some that are gone."""
    docs = t.plain(s, d).select("note_path", "doc_id", "text")
    prior = docs.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    prior = prior.unionByName(docs.where("doc_id % 50 = 1").withColumn("note_path", F.concat(F.lit("gone/"), "note_path")))
    diff = scratch.materialise(snapshot.restore_diff(snapshot.content_sha(docs), snapshot.content_sha(prior)))
    folder = scratch.scratch_dir(s)
    snapshot.write_buckets(_line_chunks(prior), folder)
    fresh = snapshot.refresh(docs, snapshot.read_buckets(s, folder), diff, _line_chunks)
    return fresh.select("note_path", "line", F.sha2("text", 256).alias("sha256"))


def _versions(s, d):
    """Lines of notes after three versions: an older state, a refresh to the tables' state, and notes moved to the trash."""
    docs = t.plain(s, d).select("note_path", "doc_id", "text")
    prior = docs.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    prior = prior.unionByName(docs.where("doc_id % 50 = 1").withColumn("note_path", F.concat(F.lit("gone/"), "note_path")))
    stored = snapshot.Snapshot(s, scratch.scratch_dir(s))
    stored.refresh(prior, _line_chunks)
    stored.refresh(docs, _line_chunks)
    moved = _line_chunks(docs.where("doc_id % 9 = 4").withColumn("note_path", F.concat(F.lit("trash/"), "note_path"))).withColumn("content_sha", F.lit("moved"))
    stored.replace(moved, docs.where("doc_id % 9 = 4"))
    return stored.read().select("note_path", "line", F.sha2("text", 256).alias("sha256"))


def _index_stored(s, d):
    """Notes through the parser and the cached embedder into versions of a snapshot, and what it holds then."""
    docs = t.notes(s, d).select("note_path", "doc_id", "text")

    def build(notes):
        chunks = chunking.chunk_notes(notes)
        none = s.createDataFrame([], "key string, vec array<float>")
        return embed.embed_cached(chunks, none, embed.HashEmbedder(8), "hash")[0]

    stored = snapshot.Snapshot(s, scratch.scratch_dir(s))
    stored.refresh(docs.where("doc_id % 10 <> 0"), build)
    stored.refresh(docs, build)
    return stored.read().select("note_path", "ord", "granularity", "byte_start", "byte_end", F.sha2("text", 256).alias("sha256"), F.sha2(F.array_join(F.col("vec").cast("array<string>"), ","), 256).alias("vec_sha256"))


def _index_build(s, d):
    """From documents to a stored index, end to end: paragraphs, cached vectors, buckets, and the same read back."""
    docs = t.plain(s, d)
    chunks = _line_chunks(docs.select("note_path", "text")).where("text <> ''")
    key = embed.cache_key("unit", "text")
    cache = chunks.where("line = 1").select(key.alias("key")).distinct().withColumn("vec", F.array(F.lit(0.5).cast("float")))
    told, _ = embed.embed_cached(chunks, cache, embed.ConstantEmbedder(1), "unit")
    folder = scratch.scratch_dir(s)
    snapshot.write_buckets(told, folder)
    stored = snapshot.read_buckets(s, folder)
    return stored.select("note_path", "line", F.sha2("text", 256).alias("sha256"), (F.col("vec")[0] == 0.5).alias("cached"))


def _meta(s, d):
    return L.note_meta(t.notes(s, d)).select("note_path", "words", "chars", "n_lines", "bytes", "headings", F.size("tags").cast("long").alias("tags"), F.col("frontmatter")["lang"].alias("lang"), "outbound", "inbound")


def _revision_contents(s, d):
    known = t.revisions(s, d).where("supporting % 2 = 0").select("sha", "note_path", F.concat("message", F.lit("!")).alias("content"))
    return D.content_at(t.revisions(s, d), known).select("note_path", "sha", "content")


def _eval(s, d):
    hits = V.dense_topk(t.chunks(s, d), t.asked(s, d), 40).select("query_id", F.col("chunk_id").cast("string").alias("note_path"), "score", "rank")
    told = E.summary(E.metrics(E.ranked_notes(hits), _gold(s, d)))
    return told.select("queries", *[F.round(c, 4).alias(c) for c in ("recall", "mrr", "ndcg")])


def _dated(s, d):
    """Labelled documents with a date in their frontmatter, some with none and some with what is no date."""
    n = F.col("doc_id")
    date = F.when(n % 3 == 0, F.concat(F.lit("date: 2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("\n"))).when(n % 3 == 1, F.lit("date: soon\n")).otherwise("")
    return t.table(s, d, "labels").select(n.cast("string").alias("note_path"), F.concat(F.lit("---\nkind: x\n"), date, F.lit("---\nbody")).alias("text"))


def _deleted(s, d):
    """What stays and what goes when one source's folder is deleted."""
    stays, goes = R.delete_folder(t.notes(s, d), "src1", "s")
    return stays.withColumn("stamp", F.lit(None).cast("string")).unionByName(goes).select("note_path", F.sha2("text", 256).alias("sha256"), "stamp")


QUERIES = {
    "create_notes": lambda s, d: _sha(R.create(t.plain(s, d).select("note_path", "text"), _new_notes(s, d))),
    "create_notes_over": lambda s, d: _sha(R.create(t.plain(s, d).select("note_path", "text"), _new_notes(s, d), overwrite=True)),
    "append_text": lambda s, d: _sha(R.append(t.plain(s, d), None, "\nlast line")),
    "prepend_text": lambda s, d: _sha(R.prepend(t.plain(s, d), None, "first line\n")),
    "insert_after_heading": lambda s, d: _sha(R.insert_after_heading(_shaped(s, d), None, "Part", "put in")),
    "rename_heading": lambda s, d: _sha(R.rename_heading(_shaped(s, d), "Sub", "Other")),
    "patch_section": lambda s, d: _sha(R.patch_section(_shaped(s, d), None, "Part", "all new")),
    "replace_lines": lambda s, d: _sha(R.replace_lines(_shaped(s, d), None, 2, 4, "one line")),
    "partial_note": lambda s, d: X.partial(_shaped(s, d), "Part"),
    "md_to_wiki": lambda s, d: _sha(R.md_to_wiki(_filled(s, d, ["see [name]({source}", ".md) and [name](name.md)", "{text}"]).withColumn("text", F.regexp_replace("text", r"\n\.md\)", ".md)")))),
    "copy_notes": lambda s, d: _sha(R.copy_notes(t.plain(s, d).select("note_path", "text"), _copies(s, d))),
    "rename_many": lambda s, d: R.rename_many(t.plain(s, d), _renames(s, d)),
    "archive_notes": lambda s, d: _sha(R.archive(t.notes(s, d).select("note_path", "text"), t.notes(s, d).where("doc_id % 6 = 0").select("note_path"), "2024-02-03")),
    "trash_notes": _trash,
    "restore_trashed": lambda s, d: _sha(R.restore(_trashed(s, d))),
    "trash_summary": lambda s, d: R.trash_summary(_trashed(s, d)),
    "empty_folders": lambda s, d: R.empty_folders(_folders(s, d), t.plain(s, d).select(F.col("note_path").alias("path"))),
    "tag_some_notes": lambda s, d: _sha(R.tag_notes(t.notes(s, d).select("note_path", "text"), "t3", t.notes(s, d).where("doc_id % 2 = 0").select("note_path"))),
    "fill_template": lambda s, d: _sha(_template(s, d)),
    "delete_folder": lambda s, d: _deleted(s, d),
    "purge_trash": lambda s, d: R.purge(R.trash(t.notes(s, d), t.notes(s, d).select("note_path"), "x")[1].withColumn("stamp", F.concat(F.lit("2024-0"), (F.char_length("text") % 9 + 1).cast("string"))), "2024-05").select("note_path", "stamp"),
    "code_blocks": lambda s, d: X.code_blocks(_filled(s, d, ["start", "```py", "{text}", "```", "end", "```", "open {doc_id}"])).select("note_path", "line", "lang", F.sha2("code", 256).alias("sha256")),
    "dataview_blocks": lambda s, d: X.dataview_blocks(_filled(s, d, ["```Dataview", "list {lang}", "```", "text", "```dataview", "table {doc_id}", "```"])),
    "pipe_tables": lambda s, d: X.tables(_filled(s, d, ["before", "| a |b|", "|---|:-:|", "| {doc_id}", "|{lang}", "after"]).withColumn("text", F.regexp_replace("text", r"\n\|(?=[a-z][a-z]\n)", " | ")).withColumn("text", F.regexp_replace("text", r"\nafter", " |\nafter"))).select("note_path", "line", F.array_join(F.transform("cells", lambda r: F.array_join(r, ",")), ";").alias("cells")),
    "block_ids": lambda s, d: X.block_ids(_filled(s, d, ["a line ^x{doc_id}", "no id", "{text}", "last ^id-{lang}"])),
    "extract_shas": lambda s, d: G.extract_shas(_sha_answers(s, d)),
    "validate_shas": lambda s, d: G.validate_shas(G.extract_shas(_sha_answers(s, d)), t.revisions(s, d)).select("answer_id", "pos", "valid"),
    "narrate_prompts": _narrate,
    "drift_check": _drift,
    "snapshot_refresh": _refreshed,
    "snapshot_versions": _versions,
    "index_stored": _index_stored,
    "index_build": _index_build,
    "remove_notes": lambda s, d: snapshot.remove_notes(_line_chunks(t.plain(s, d)), _paths(s, d, 4)).groupBy("note_path").agg(F.count("*").alias("n")),
    "revision_contents": _revision_contents,
    "intent_weights": lambda s, d: t.table(s, d, "conversations").select("conv_id", "turn", *[w.alias(n) for w, n in zip(V.intent_weights(V.intent(F.col("text"))), ("vector", "lexical"), strict=True)]),
    "index_export": lambda s, d: L.index_export(t.notes(s, d)).select("note_path", F.array_join("targets", ",").alias("targets"), F.array_join("tags", ",").alias("tags")),
    "frontmatter_values": lambda s, d: t.notes(s, d).select("note_path", *[T.frontmatter("text")[k].alias(k) for k in ("lang", "source", "chars")]),
    "frontmatter_date": lambda s, d: _dated(s, d).select("note_path", C.frontmatter_date().alias("date")),
    "list_folder": lambda s, d: C.list_folder(_files(s, d)),
    "list_attachments": lambda s, d: C.list_attachments(_files(s, d)),
    "find_by_extension": lambda s, d: C.find_by_extension(_files(s, d), [".pdf", "GZ"], "en/"),
    "files_by_size": lambda s, d: C.find_by_size(_files(s, d), 1000, 5000),
    "bundle_parts": lambda s, d: C.bundle_parts(t.plain(s, d), 1_000_000).select("note_path", F.sha2("part", 256).alias("sha256")),
    "note_meta": _meta,
    "vault_doctor": lambda s, d: L.doctor(t.notes(s, d), C.numbered_lines(t.notes(s, d))),
    "eval_summary": _eval,
}


def _sql(lines: list[str]) -> str:
    """The SQL of _filled's text."""
    one = lambda x: " || ".join([f"'{x.partition('{')[0]}'"] + ([f"CAST({x.partition('{')[2][:-1]} AS VARCHAR)"] if "{" in x else []))
    return " || chr(10) || ".join(one(x) for x in lines)


PATH = "source || '/' || doc_id || '.md'"
made = lambda *lines: f"SELECT {PATH} AS note_path, sha256({_sql(list(lines))}) AS sha256 FROM documents"
NEW = f"n AS (SELECT coalesce(CASE WHEN page_id % 3 = 0 THEN {PATH} END, 'new/' || page_id || '.md') AS note_path, html AS text FROM pages LEFT JOIN documents ON page_id = doc_id)"
FILE = "f AS (SELECT CASE doc_id % 3 WHEN 0 THEN lang || '/' || source || '/' WHEN 1 THEN lang || '/' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || doc_id || CASE doc_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.PDF' WHEN 2 THEN '.md' ELSE '.csv.gz' END AS path, CAST(strlen(text) AS BIGINT) AS bytes, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'pdf' WHEN 2 THEN 'md' ELSE 'gz' END AS ext, lang, doc_id FROM documents)"
TAGS = r"regexp_extract_all(text, '(?m)(?:^|\s)#([A-Za-z0-9][\w/-]*)', 1)"
ROUTED = RETRIEVED["router_intent"]
METRICS = RETRIEVED["retrieval_metrics"].replace("round(hits / n, 6)", "hits / n").replace("round(coalesce(1 / f, 0), 6)", "coalesce(1 / f, 0)").replace("round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(n, 10) + 1 AS BIGINT)) x(i)), 6)", "dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(n, 10) + 1 AS BIGINT)) x(i))")
ORACLES = {
    "create_notes": f"{PLAIN}, {NEW} SELECT note_path, sha256(text) AS sha256 FROM plain UNION ALL SELECT note_path, sha256(text) FROM n WHERE note_path NOT IN (SELECT note_path FROM plain)",
    "create_notes_over": f"{PLAIN}, {NEW} SELECT note_path, sha256(text) AS sha256 FROM n UNION ALL SELECT note_path, sha256(text) FROM plain WHERE note_path NOT IN (SELECT note_path FROM n)",
    "append_text": f"{PLAIN} SELECT note_path, sha256(text || chr(10) || 'last line') AS sha256 FROM plain",
    "prepend_text": f"{PLAIN} SELECT note_path, sha256('first line' || chr(10) || text) AS sha256 FROM plain",
    "insert_after_heading": made(*SHAPE[:3], "", "put in", "", *SHAPE[3:]),
    "rename_heading": made(*SHAPE[:4], "### Other", *SHAPE[5:]),
    "patch_section": made(*SHAPE[:3], "all new", *SHAPE[6:]),
    "replace_lines": made(SHAPE[0], "one line", *SHAPE[4:]),
    "partial_note": f"SELECT {PATH} AS note_path, {_sql(SHAPE[2:6])} AS body FROM documents",
    "md_to_wiki": f"SELECT {PATH} AS note_path, sha256('see [[' || source || '|name]] and [[name]]' || chr(10) || text) AS sha256 FROM documents",
    "copy_notes": f"{PLAIN} SELECT note_path, sha256(text) AS sha256 FROM plain UNION ALL SELECT 'copy/' || doc_id || '.md', sha256(text) FROM plain WHERE doc_id % 10 = 5",
    "rename_many": f"{PLAIN} SELECT CASE WHEN doc_id % 3 = 0 THEN 'missing/' ELSE '' END || note_path AS note_path, CASE WHEN doc_id % 4 <> 0 THEN 'renamed/' ELSE '' END || note_path AS target, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS ok FROM plain",
    "archive_notes": f"{WITH} SELECT CASE WHEN doc_id % 6 = 0 THEN 'Archive/' || doc_id || '.md' ELSE note_path END AS note_path, sha256(CASE WHEN doc_id % 6 = 0 THEN regexp_replace(text, '^(---\\nlang: [^\\n]*\\nsource: [^\\n]*\\nchars: [^\\n]*\\n)', '\\1archived: 2024-02-03' || chr(10)) ELSE text END) AS sha256 FROM notes",
    "trash_notes": f"{PLAIN} SELECT note_path, CASE WHEN doc_id % 7 = 0 THEN '2024-01-01' ELSE 'stays' END AS state FROM plain",
    "restore_trashed": "SELECT source || '/' || (doc_id % 50) || '.md' AS note_path, sha256(arg_max(text, doc_id)) AS sha256 FROM documents GROUP BY 1",
    "trash_summary": "SELECT count(*) AS notes, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents",
    "empty_folders": "SELECT DISTINCT 'none/' || source AS path FROM documents",
    "tag_some_notes": rf"{WITH} SELECT note_path, sha256(text || chr(10) || chr(10) || '#t3' || chr(10)) AS sha256 FROM notes WHERE doc_id % 2 = 0 AND NOT regexp_matches(text, '(?m)(?:^|\s)#t3(?:\s|$)')",
    "delete_folder": f"{WITH} SELECT note_path, sha256(text) AS sha256, CASE WHEN starts_with(note_path, 'src1/') THEN 's' END AS stamp FROM notes",
    "purge_trash": f"{WITH} SELECT note_path, '2024-0' || (length(text) % 9 + 1) AS stamp FROM notes WHERE length(text) % 9 + 1 >= 5",
    "fill_template": f"{WITH} SELECT note_path, sha256('# ' || note_path || chr(10) || lang || ' of ' || source || ', {{{{unknown}}}}') AS sha256 FROM notes",
    "code_blocks": f"SELECT {PATH} AS note_path, CAST(2 AS BIGINT) AS line, 'py' AS lang, sha256(text) AS sha256 FROM documents UNION ALL SELECT {PATH}, 5 + len(string_split(text, chr(10))), '', sha256('open ' || doc_id) FROM documents",
    "dataview_blocks": f"SELECT {PATH} AS note_path, CAST(1 AS BIGINT) AS line, 'list ' || lang AS query FROM documents UNION ALL SELECT {PATH}, 5, 'table ' || doc_id FROM documents",
    "pipe_tables": f"SELECT {PATH} AS note_path, CAST(2 AS BIGINT) AS line, 'a,b;' || doc_id || ',' || lang AS cells FROM documents",
    "block_ids": rf"""SELECT {PATH} AS note_path, CAST(1 AS BIGINT) AS line, 'x' || doc_id AS id FROM documents UNION ALL SELECT {PATH}, 3 + len(string_split(text, chr(10))), 'id-' || lang FROM documents
UNION ALL SELECT note_path, line + 2, regexp_extract(content, '\s\^([A-Za-z0-9-]+)\s*$', 1) FROM (SELECT {PATH} AS note_path, i AS line, string_split(text, chr(10))[i] AS content FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)) WHERE regexp_matches(content, '\s\^[A-Za-z0-9-]+\s*$')""",
    "extract_shas": "SELECT event_id AS answer_id, CAST(0 AS BIGINT) AS pos, CASE WHEN event_id % 3 = 0 THEN '0123456789ab' ELSE substr(sha1(CAST(event_id AS VARCHAR)), 1, 12) END AS sha, '2024-01-0' || (event_id % 9 + 1) AS day FROM events",
    "validate_shas": "SELECT event_id AS answer_id, CAST(0 AS BIGINT) AS pos, event_id % 3 <> 0 AS valid FROM events",
    "narrate_prompts": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS p, sha1(CAST(event_id AS VARCHAR)) AS sha, ts, event_type AS m, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
i AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY ts, sha) AS n, sha, ts, m, CASE WHEN k % 2 <> 0 OR k IS NULL THEN '(content unavailable)' WHEN 60 * length(m) > 300 THEN substr(repeat(m, 60), 1, 300) || '…' ELSE repeat(m, 60) END AS body FROM e)
SELECT p AS note_path, sha256('Note: ' || p || chr(10) || chr(10) || 'Revisions (oldest first):' || chr(10) || string_agg('#' || n || ' [sha:' || substr(sha, 1, 7) || ' @ ' || strftime(ts, '%Y-%m-%d') || '] ' || m || chr(10) || '   body: ' || body, chr(10) ORDER BY n)) AS sha256 FROM i GROUP BY p""",
    "drift_check": f"""WITH r AS (SELECT source || '-' || ((doc_id // 20) % 10) AS note_path, CAST(doc_id AS DOUBLE) AS day, CASE WHEN len(regexp_extract_all(lower(text), '[a-z'']+')) = 0 THEN 0.0 ELSE ({COUNT(T.ASSERTIONS)} - ({COUNT(T.HEDGES)})) / len(regexp_extract_all(lower(text), '[a-z'']+')) END AS c,
  len(list_distinct(regexp_extract_all(text, '\\[\\[([^\\]]+?)\\]\\]', 1))) AS s FROM documents),
g AS (SELECT note_path, count(*) AS n, coalesce(regr_slope(c, day), 0) AS cs, coalesce(regr_slope(s, day), 0) AS ss FROM r GROUP BY note_path) SELECT note_path, n, round(cs, 9) AS conviction_slope, n >= 3 AND cs >= 0.000001 AND ss <= 0.005 AS flagged FROM g""",
    "snapshot_versions": f"SELECT CASE WHEN doc_id % 9 = 4 THEN 'trash/' ELSE '' END || note_path AS note_path, i AS line, sha256(ls[i]) AS sha256 FROM (SELECT doc_id, {PATH} AS note_path, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)",
    "snapshot_refresh": f"SELECT note_path, i AS line, sha256(ls[i]) AS sha256 FROM (SELECT {PATH} AS note_path, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)",
    "index_build": f"WITH c AS (SELECT note_path, i AS line, ls[i] AS x FROM (SELECT {PATH} AS note_path, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i) WHERE ls[i] <> '') SELECT note_path, line, sha256(x) AS sha256, x IN (SELECT x FROM c WHERE line = 1) AS cached FROM c",
    "remove_notes": f"SELECT {PATH} AS note_path, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 4 <> 0",
    "revision_contents": "SELECT CAST(user_id AS VARCHAR) AS note_path, sha1(CAST(event_id AS VARCHAR)) AS sha, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN event_type || '!' END AS content FROM events",
    "intent_weights": f"SELECT conv_id, turn, CAST(1 AS DOUBLE) AS vector, CASE intent WHEN 'specific' THEN CAST(0.4 AS DOUBLE) WHEN 'broad' THEN 0 ELSE 1 END AS lexical FROM ({ROUTED})",
    "index_export": rf"{LINKS}, o AS (SELECT src, string_agg(target, ',' ORDER BY pos) AS x FROM links GROUP BY src) SELECT note_path, coalesce(x, '') AS targets, array_to_string(list_sort(list_distinct({TAGS})), ',') AS tags FROM notes LEFT JOIN o ON src = note_path",
    "frontmatter_values": f"SELECT {PATH} AS note_path, lang, source, CAST(n_chars AS VARCHAR) AS chars FROM documents",
    "frontmatter_date": "SELECT CAST(doc_id AS VARCHAR) AS note_path, CASE WHEN doc_id % 3 = 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS date FROM labels",
    "list_folder": f"WITH {FILE} SELECT DISTINCT 'folder' AS kind, lang AS name FROM f WHERE doc_id % 3 < 2 UNION ALL SELECT 'note', path FROM f WHERE doc_id % 3 = 2 AND ext = 'md' AND doc_id % 11 <> 0",
    "list_attachments": f"WITH {FILE} SELECT path, bytes, ext FROM f WHERE ext <> 'md'",
    "find_by_extension": f"WITH {FILE} SELECT path, bytes, ext FROM f WHERE ext IN ('pdf', 'gz') AND lang = 'en' AND doc_id % 3 < 2",
    "files_by_size": f"WITH {FILE} SELECT path, bytes FROM f WHERE bytes BETWEEN 1000 AND 5000",
    "bundle_parts": f"""{PLAIN}, s AS (SELECT note_path, '# ' || note_path || chr(10) || chr(10) || text AS part FROM plain),
u AS (SELECT note_path, part, sum(strlen(part) + 7) OVER (ORDER BY split_part(note_path, '/', 1), note_path ROWS UNBOUNDED PRECEDING) AS upto FROM s) SELECT note_path, sha256(part) AS sha256 FROM u WHERE upto - 7 <= 1000000""",
    "note_meta": rf"""{LINKS}, i AS (SELECT dst, count(*) AS n FROM res WHERE dst IS NOT NULL GROUP BY dst), o AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT note_path, len(regexp_extract_all(text, '\S+')) AS words, length(text) AS chars, len(string_split(text, chr(10))) AS n_lines, CAST(strlen(text) AS BIGINT) AS bytes, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(#{{1,6}})\s+(.+?)\s*$'))) AS headings,
  len(list_distinct({TAGS})) AS tags, lang, coalesce(o.n, 0) AS outbound, coalesce(i.n, 0) AS inbound FROM notes LEFT JOIN i ON i.dst = note_path LEFT JOIN o ON o.src = note_path""",
    "vault_doctor": rf"""{LINKS}, tg AS (SELECT unnest({TAGS}) AS tag FROM notes)
SELECT (SELECT count(*) FROM notes) AS notes, (SELECT CAST(floor(avg(len(regexp_extract_all(text, '\S+'))) + 0.5) AS BIGINT) FROM notes) AS avg_words, (SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM notes) AS chunks,
  (SELECT count(*) FROM notes WHERE note_path NOT IN (SELECT dst FROM res WHERE dst IS NOT NULL)) AS orphans, (SELECT count(*) FROM res WHERE dst IS NULL) AS broken_links, (SELECT tag FROM tg GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 1) AS top_tag""",
    "eval_summary": f"SELECT count(*) AS queries, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM ({METRICS})",
    "unlinked_mentions": rf"""{LINES}, n AS (SELECT note_path, lower(regexp_replace(split_part(note_path, '/', 2), '\.md$', '')) AS title FROM notes),
tt AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+'), ' ') AS mention FROM (SELECT title FROM n UNION ALL SELECT text FROM benchmark) WHERE length(title) >= 4),
w AS (SELECT DISTINCT note_path AS src, line, array_to_string(regexp_extract_all(lower(regexp_replace(content, '```.*?```|\[\[[^\]]*\]\]|\[[^\]]*\]\([^)]*\)', '', 'g')), '[\p{{L}}\p{{N}}_]+'), ' ') AS j FROM l)
SELECT src, line, mention FROM w JOIN tt ON mention <> '' AND contains(' ' || j || ' ', ' ' || mention || ' ')""",
}
