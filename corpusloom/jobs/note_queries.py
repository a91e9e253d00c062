"""Queries over the structure of notes, and rewrites of notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.jobs import tables as t
from corpusloom.jobs.corpus_queries import LINES, PLAIN, WITH
from corpusloom.operators import chunking, extract as X, rewrite as R
from corpusloom.operators import corpus as C

# This and the patterns inside the SQL below are those of the operators, which results have to match.
HEAD = r"^(#{1,6})\s+(.+?)\s*$"


def _merge_sources(s, d):
    """Notes of a folder, by id, become one."""
    docs = t.notes(s, d)
    return docs.select(F.concat(F.lit("merged/"), "source", F.lit(".md")).alias("target"), F.col("doc_id").alias("pos"), "note_path")


def _entries(s, d):
    return t.table(s, d, "events").select(F.to_date("ts").alias("day"), F.col("event_id").alias("pos"), F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("entry"))


def _changed(s, d, rewritten):
    """Digests of the texts that a rewrite changed."""
    old = t.notes(s, d).select("note_path", F.col("text").alias("old"))
    return rewritten.select("note_path", "text").join(old, "note_path").where("text <> old").select("note_path", F.sha2("text", 256).alias("sha256"))


def _diff(s, d):
    docs = t.table(s, d, "documents")
    pick = lambda i: docs.where(F.col("doc_id") == i).select(F.col("doc_id").cast("string").alias("note_path"), "text")
    return X.line_set_diff(pick(0), pick(1))


def _diff_pairs(s, d):
    """Each document and the one of the next id."""
    docs = t.table(s, d, "documents")
    return X.line_set_diff(docs.select("doc_id", "text"), docs.select((F.col("doc_id") - 1).alias("doc_id"), "text"), "doc_id")


def _periodic(s, d):
    """All documents, and notes of the even weeks that have entries."""
    stem = R.periodic_stem(F.col("day"), "weekly")
    weeks = _entries(s, d).select(stem.alias("week")).distinct().where(F.substring("week", -1, 1).isin(*"02468"))
    kept = weeks.select(F.concat("week", F.lit(".md")).alias("note_path"), F.concat(F.lit("# "), "week").alias("text"))
    return R.append_periodic(t.plain(s, d).select("note_path", "text").unionByName(kept), _entries(s, d), "weekly")


QUERIES = {
    "line_offsets": lambda s, d: X.line_offsets(t.notes(s, d)).select("note_path", "line", "byte_start"),
    "outline": lambda s, d: X.outline(t.notes(s, d)),
    "sections": lambda s, d: X.sections(t.notes(s, d)),
    "table_of_contents": lambda s, d: X.table_of_contents(t.notes(s, d)),
    "note_status": lambda s, d: X.note_status(t.notes(s, d)),
    "excerpt": lambda s, d: X.excerpt(t.plain(s, d), 2, 100_000).select("note_path", "excerpt"),
    "first_paragraph": lambda s, d: X.first_paragraph(t.notes(s, d)),
    "inline_fields": lambda s, d: X.inline_fields(t.notes(s, d)),
    "image_refs": lambda s, d: X.image_refs(t.notes(s, d)).select("note_path", F.array_join("embeds", ",").alias("embeds")),
    "external_urls": lambda s, d: X.external_urls(t.notes(s, d)).select("note_path", F.array_join("urls", " ").alias("urls")),
    "all_links": lambda s, d: X.all_links(t.notes(s, d)).select("note_path", F.array_join("wikilinks", ",").alias("wikilinks"), F.array_join("embeds", ",").alias("embeds")),
    "quotes_islands": lambda s, d: X.quotes(t.notes(s, d)),
    "line_set_diff": _diff,
    "line_set_diff_pairs": _diff_pairs,
    "read_slice": lambda s, d: X.read_slice(t.notes(s, d), 0, 9),
    "chunk_notes": lambda s, d: chunking.chunk_notes(t.notes(s, d), 0).select("note_path", "ord", "granularity", "byte_start", "byte_end", F.array_join("heading_path", " > ").alias("path")),
    "replace_all": lambda s, d: R.replace_text(t.notes(s, d), "the ", "THE ").select("note_path", F.sha2("text", 256).alias("sha256"), "replacements"),
    "replace_first": lambda s, d: R.replace_text(t.notes(s, d), "the ", "THE ", first_only=True).select("note_path", F.sha2("text", 256).alias("sha256")),
    "rename_link_target": lambda s, d: R.rename_link_target(t.notes(s, d), "100", "hundred").select("note_path", F.sha2("text", 256).alias("sha256"), "links"),
    "toggle_tasks": lambda s, d: _changed(s, d, R.toggle_tasks(t.notes(s, d), C.find_tasks(t.notes(s, d), "open").select("note_path", "line"))),
    "set_property": lambda s, d: _changed(s, d, R.set_property(t.notes(s, d), "lang", "xx")),
    "add_property": lambda s, d: _changed(s, d, R.set_property(t.notes(s, d), "status", "new")),
    "unset_property": lambda s, d: _changed(s, d, R.unset_property(t.notes(s, d), "source")),
    "add_tag": lambda s, d: _changed(s, d, R.add_tag(t.notes(s, d), "t3")),
    "remove_tag": lambda s, d: _changed(s, d, R.remove_tag(t.notes(s, d), "t3")),
    "wiki_to_md": lambda s, d: _changed(s, d, R.wiki_to_md(t.notes(s, d))),
    "split_notes": lambda s, d: R.split_notes(t.notes(s, d), 2, "split/").select("note_path", F.sha2("text", 256).alias("sha256")),
    "merge_notes": lambda s, d: R.merge_notes(t.notes(s, d), _merge_sources(s, d)).select("note_path", F.sha2("text", 256).alias("sha256")),
    "append_periodic": lambda s, d: R.append_periodic(t.notes(s, d).select("note_path", "text").limit(0), _entries(s, d), "weekly").select("note_path", F.sha2("text", 256).alias("sha256")),
    "append_periodic_notes": lambda s, d: _periodic(s, d).select("note_path", F.sha2("text", 256).alias("sha256")),
    "move_folder": lambda s, d: R.move(t.notes(s, d), "src1", "moved/here").where("note_path like 'moved/%'").select("note_path"),
    "replace_first_line": lambda s, d: _changed(s, d, R.replace_first_line(t.notes(s, d), None, "+++")),
}

OLD = "SELECT note_path, sha256(new) AS sha256 FROM c WHERE new <> text"
ORACLES = {
    "line_offsets": f"""{LINES} SELECT note_path, line, CAST(coalesce(sum(strlen(content) + 1) OVER (PARTITION BY note_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM l""",
    "split_notes": rf"""{LINES}, h AS (SELECT *, regexp_matches(content, '^#{{2}}\s+(.+?)\s*$') AS head FROM l), g AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY note_path ORDER BY line) AS section FROM h),
s AS (SELECT note_path, section, min(line) AS line, min(content) FILTER (WHERE head) AS first, string_agg(content, chr(10) ORDER BY line) AS body FROM g WHERE section > 0 GROUP BY note_path, section),
n AS (SELECT *, coalesce(nullif(regexp_replace(left(regexp_replace(trim(regexp_replace(trim(regexp_extract(first, '^#{{2}}\s+(.+?)\s*$', 1)), '[^A-Za-z0-9_\s.-]', '', 'g')), '\s+', '-', 'g'), 80), '^\.+|\.+$', '', 'g'), ''), 'untitled') AS name FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY note_path, name ORDER BY line) AS nth FROM n)
SELECT 'split/' || regexp_replace(note_path, '\.md$', '') || '-split/' || name || CASE WHEN nth > 1 THEN ' (' || nth || ')' ELSE '' END || '.md' AS note_path, sha256(body) AS sha256 FROM k""",
    "outline": rf"""{LINES}, o AS (SELECT note_path, line, content, CAST(coalesce(sum(strlen(content) + 1) OVER (PARTITION BY note_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM l)
SELECT note_path, line, length(regexp_extract(content, '{HEAD}', 1)) AS depth, trim(regexp_extract(content, '{HEAD}', 2)) AS title, byte_start FROM o WHERE regexp_matches(content, '{HEAD}')""",
    "sections": rf"""{LINES}, h AS (SELECT note_path, line, content, regexp_matches(content, '{HEAD}') AS h FROM l),
s AS (SELECT *, CAST(sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY note_path ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM h)
SELECT note_path, section, coalesce(max(CASE WHEN h THEN trim(regexp_extract(content, '{HEAD}', 2)) END), '(preamble)') AS heading, CAST(coalesce(max(CASE WHEN h THEN length(regexp_extract(content, '{HEAD}', 1)) END), 0) AS BIGINT) AS depth,
  CAST(sum(CASE WHEN h THEN 0 ELSE len(regexp_extract_all(content, '\S+')) END) AS BIGINT) AS words FROM s GROUP BY note_path, section HAVING section > 0 OR words > 0""",
    "table_of_contents": rf"""{LINES}, h AS (SELECT note_path, line, length(regexp_extract(content, '{HEAD}', 1)) AS d, trim(regexp_extract(content, '{HEAD}', 2)) AS x FROM l WHERE regexp_matches(content, '{HEAD}'))
SELECT n.note_path, coalesce(string_agg(repeat('  ', d - 1) || '- [' || x || '](#' || regexp_replace(regexp_replace(lower(x), '[^\w\s-]', '', 'g'), '\s+', '-', 'g') || ')', chr(10) ORDER BY line), '') AS toc
FROM notes n LEFT JOIN h USING (note_path) GROUP BY n.note_path""",
    "note_status": rf"""{WITH} SELECT note_path, CAST(strlen(text) AS BIGINT) AS bytes, len(regexp_extract_all(text, '\S+')) AS words, len(string_split(text, chr(10))) AS n_lines,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}}\s+'))) AS headings, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*-\s+\[[ xX]\]\s+'))) AS tasks,
  len(list_distinct(regexp_extract_all(text, '(?m)(?:^|\s)#([A-Za-z0-9][\w/-]*)', 1))) AS tags, len(list_distinct(regexp_extract_all(text, '(?:^|[^!])\[\[([^\]|#]+)', 1))) AS links FROM notes""",
    "excerpt": f"{PLAIN} SELECT note_path, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS excerpt FROM plain",
    "first_paragraph": rf"""{WITH}, b AS (SELECT note_path, list_transform(regexp_split_to_array(regexp_replace(text, '^---\n[\s\S]*?\n---\n?', ''), '\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS b FROM notes)
SELECT note_path, coalesce(list_filter(b, lambda x: x <> '' AND NOT regexp_matches(x, '^#{{1,6}}\s+'))[1], '') AS paragraph FROM b""",
    "image_refs": rf"{WITH} SELECT note_path, CASE WHEN len(regexp_extract_all(text, '!\[\[fig')) = 0 THEN '' ELSE (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(regexp_extract_all(text, '(?i)!\[\[([^\]|#]+\.(?:png|jpe?g|gif|webp|svg|bmp))(?:[|#][^\]]*)?\]\]', 1)) AS x, generate_subscripts(regexp_extract_all(text, '(?i)!\[\[([^\]|#]+\.(?:png|jpe?g|gif|webp|svg|bmp))(?:[|#][^\]]*)?\]\]', 1), 1) AS i) GROUP BY x)) END AS embeds FROM notes",
    "external_urls": r"%s SELECT note_path, coalesce((SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(regexp_extract_all(text, '(?:^|[^(\"\[])\b(https?://[^\s)<>\"'']+)', 1)) AS x, generate_subscripts(regexp_extract_all(text, '(?:^|[^(\"\[])\b(https?://[^\s)<>\"'']+)', 1), 1) AS i) GROUP BY x)), '') AS urls FROM notes" % WITH,
    "inline_fields": rf"{LINES} SELECT note_path, line, regexp_extract(content, '(?:^|[\s\-*])([A-Za-z][\w-]*)::\s*([^\n]+?)\s*$', 1) AS key, trim(regexp_extract(content, '(?:^|[\s\-*])([A-Za-z][\w-]*)::\s*([^\n]+?)\s*$', 2)) AS value FROM l WHERE regexp_matches(content, '(?:^|[\s\-*])([A-Za-z][\w-]*)::\s*([^\n]+?)\s*$')",
    "all_links": rf"""{LINES}, e AS (SELECT note_path, line, regexp_extract(content, '[^!]\[\[([^\]|#]+)\]\]$', 1) AS w, regexp_extract(content, '!\[\[([^\]|#]+)\]\]$', 1) AS m FROM l),
w AS (SELECT note_path, string_agg(w, ',' ORDER BY f) AS w FROM (SELECT note_path, w, min(line) AS f FROM e WHERE w <> '' GROUP BY note_path, w) GROUP BY note_path), m AS (SELECT note_path, string_agg(m, ',' ORDER BY f) AS m FROM (SELECT note_path, m, min(line) AS f FROM e WHERE m <> '' GROUP BY note_path, m) GROUP BY note_path)
SELECT note_path, coalesce(w, '') AS wikilinks, coalesce(m, '') AS embeds FROM notes LEFT JOIN w USING (note_path) LEFT JOIN m USING (note_path)""",
    "quotes_islands": rf"""{LINES}, q AS (SELECT note_path, line, regexp_replace(content, '^\s*>\s?', '') AS x, line - row_number() OVER (PARTITION BY note_path ORDER BY line) AS g FROM l WHERE regexp_matches(content, '^\s*>'))
SELECT note_path, min(line) AS line, string_agg(x, chr(10) ORDER BY line) AS quote FROM q GROUP BY note_path, g""",
    "line_set_diff": """WITH a AS (SELECT unnest(string_split(text, chr(10))) AS content FROM documents WHERE doc_id = 0), b AS (SELECT unnest(string_split(text, chr(10))) AS content FROM documents WHERE doc_id = 1)
SELECT 'left' AS side, content FROM a WHERE content NOT IN (SELECT content FROM b) UNION ALL SELECT 'right', content FROM b WHERE content NOT IN (SELECT content FROM a)""",
    "line_set_diff_pairs": """WITH p AS (SELECT a.doc_id, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, 'left' AS side, unnest(list_filter(x, lambda l: NOT list_contains(y, l))) AS content FROM p UNION ALL SELECT doc_id, 'right', unnest(list_filter(y, lambda l: NOT list_contains(x, l))) FROM p""",
    "read_slice": f"{WITH} SELECT note_path, CAST(strlen(text) AS BIGINT) AS bytes, substr(text, 1, 9) AS part FROM notes",
    "replace_all": f"{WITH} SELECT note_path, sha256(replace(text, 'the ', 'THE ')) AS sha256, CAST((length(text) - length(replace(text, 'the ', ''))) // 4 AS BIGINT) AS replacements FROM notes WHERE contains(text, 'the ')",
    "replace_first": f"{WITH} SELECT note_path, sha256(substr(text, 1, instr(text, 'the ') - 1) || 'THE ' || substr(text, instr(text, 'the ') + 4)) AS sha256 FROM notes WHERE contains(text, 'the ')",
    "rename_link_target": f"{WITH} SELECT note_path, sha256(replace(text, '[[100]]', '[[hundred]]')) AS sha256, CAST((length(text) - length(replace(text, '[[100]]', ''))) // 7 AS BIGINT) AS links FROM notes WHERE contains(text, '[[100]]')",
    "toggle_tasks": rf"{WITH}, c AS (SELECT note_path, text, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\s*-\s+\[ \]\s+(.+?)\s*$') THEN regexp_replace(x, '^(\s*-\s+)\[ \]', '\1[x]') ELSE x END), chr(10)) AS new FROM notes) {OLD}",
    "set_property": f"{WITH}, c AS (SELECT note_path, text, '---' || chr(10) || 'lang: xx' || substr(text, 13) AS new FROM notes) {OLD}",
    "add_property": rf"{WITH}, c AS (SELECT note_path, text, regexp_replace(text, '^(---\nlang: [^\n]*\nsource: [^\n]*\nchars: [^\n]*\n)', '\1status: new' || chr(10)) AS new FROM notes) {OLD}",
    "unset_property": rf"{WITH}, c AS (SELECT note_path, text, regexp_replace(text, '^(---\nlang: [^\n]*\n)source: [^\n]*\n', '\1') AS new FROM notes) {OLD}",
    "add_tag": rf"{WITH} SELECT note_path, sha256(text || chr(10) || chr(10) || '#t3' || chr(10)) AS sha256 FROM notes WHERE NOT regexp_matches(text, '(?m)(?:^|\s)#t3(?:\s|$)')",
    "remove_tag": rf"{WITH}, c AS (SELECT note_path, text, array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '(^|\s)#t3$', '\1')), chr(10)) AS new FROM notes) {OLD}",
    "wiki_to_md": rf"{WITH}, c AS (SELECT note_path, text, regexp_replace(text, ' \[\[([0-9]+)\]\]', ' [\1](\1.md)', 'g') AS new FROM notes) {OLD}",
    "merge_notes": f"{WITH} SELECT 'merged/' || source || '.md' AS note_path, sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS sha256 FROM notes GROUP BY source",
    "append_periodic": "SELECT strftime(ts, '%G-W%V') || '.md' AS note_path, sha256(string_agg(event_type || ' ' || user_id, chr(10) ORDER BY event_id)) AS sha256 FROM events GROUP BY 1",
    "append_periodic_notes": f"""{PLAIN}, e AS (SELECT strftime(ts, '%G-W%V') AS week, string_agg(event_type || ' ' || user_id, chr(10) ORDER BY event_id) AS x FROM events GROUP BY 1)
SELECT note_path, sha256(text) AS sha256 FROM plain UNION ALL SELECT week || '.md', sha256(CASE WHEN CAST(right(week, 1) AS INT) % 2 = 0 THEN '# ' || week || chr(10) ELSE '' END || x) FROM e""",
    "move_folder": f"{PLAIN} SELECT 'moved/here' || substr(note_path, 5) AS note_path FROM plain WHERE starts_with(note_path, 'src1/')",
    "replace_first_line": f"{WITH}, c AS (SELECT note_path, text, '+++' || substr(text, 4) AS new FROM notes) {OLD}",
}
