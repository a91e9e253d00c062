"""Queries over whole notes: counts, rankings, properties, duplicates, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.jobs import tables as t
from corpusloom.operators import corpus as C
from corpusloom.sources.notes import NOTES_SQL

# Patterns and word lists inside the SQL below are those of the operators, which results have to match.
WITH = f"WITH {NOTES_SQL}"
PLAIN = "WITH plain AS (SELECT source || '/' || doc_id || '.md' AS note_path, doc_id, text FROM documents)"
LINES = f"""{WITH}, l AS (SELECT note_path, i AS line, ls[i] AS content, ls FROM (SELECT note_path, string_split(text, chr(10)) AS ls FROM notes), unnest(range(1, len(ls) + 1)) u(i))"""


def _attachments(spark, sf):
    name = F.concat(F.lit("assets/fig"), (F.col("doc_id") % 8).cast("string"), F.lit(".png"))
    return t.table(spark, sf, "documents").select(name.alias("path")).distinct()


QUERIES = {
    "tag_counts": lambda s, d: C.tag_counts(t.notes(s, d)),
    "find_by_tag": lambda s, d: C.notes_by_tag(t.notes(s, d), "T5"),
    "count_notes": lambda s, d: C.count_notes(t.notes(s, d), "src1"),
    "size_breakdown": lambda s, d: C.size_breakdown(t.notes(s, d)),
    "prefix_list": lambda s, d: C.prefix_list(t.plain(s, d), "/src1/"),
    "word_count": lambda s, d: C.word_count(t.notes(s, d)),
    "long_notes": lambda s, d: C.long_notes(t.plain(s, d)),
    "top_terms": lambda s, d: C.top_terms(t.plain(s, d)),
    "long_lines": lambda s, d: C.long_lines(t.plain(s, d), 300),
    "empty_notes": lambda s, d: C.empty_notes(t.notes(s, d), 20),
    "without_frontmatter": lambda s, d: C.without_frontmatter(t.plain(s, d)),
    "with_property": lambda s, d: C.with_property(t.notes(s, d), "chars"),
    "property_distribution": lambda s, d: C.property_distribution(t.notes(s, d), "lang"),
    "query_property": lambda s, d: C.query_property(t.notes(s, d), {"lang": ["fr", "de"], "source": "src3"}),
    "exact_duplicates": lambda s, d: C.exact_duplicates(t.plain(s, d)),
    "duplicate_members": lambda s, d: C.duplicate_members(t.plain(s, d)),
    "note_hash": lambda s, d: C.note_hash(t.plain(s, d)),
    "notes_with_attachments": lambda s, d: C.notes_with_attachments(t.notes(s, d)),
    "unreferenced_attachments": lambda s, d: C.unreferenced(t.notes(s, d), _attachments(s, d)),
    "find_tasks": lambda s, d: C.find_tasks(t.notes(s, d), "open"),
    "find_todos": lambda s, d: C.find_todos(t.notes(s, d)),
    "grep_context": lambda s, d: C.grep(t.notes(s, d), "clown", context=1),
    "grep_regex": lambda s, d: C.grep(t.notes(s, d), r"\bid[a-z]+t\b", regex=True, ignore_case=True),
    "find_by_size": lambda s, d: C.word_count(t.plain(s, d)).where("bytes between 1000 and 1200").select("note_path", "bytes"),
    "bundle_cap": lambda s, d: C.running_bundle(t.plain(s, d), 1_000_000),
    "stats": lambda s, d: C.stats(t.plain(s, d), C.numbered_lines(t.plain(s, d)).select(F.col("content").alias("text"))),
    "random_notes": lambda s, d: C.random_notes(t.plain(s, d), 10, 42),
}

ORACLES = {
    "tag_counts": rf"{WITH} SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?m)(?:^|\s)#([A-Za-z0-9][\w/-]*)', 1)) AS tag FROM notes) GROUP BY tag",
    "find_by_tag": rf"{WITH} SELECT note_path FROM notes WHERE list_contains(list_transform(regexp_extract_all(text, '(?m)(?:^|\s)#([A-Za-z0-9][\w/-]*)', 1), lambda x: lower(x)), 't5')",
    "count_notes": f"{WITH} SELECT count(*) AS notes, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM notes WHERE starts_with(note_path, 'src1')",
    "size_breakdown": f"{WITH} SELECT source AS folder, count(*) AS notes, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM notes GROUP BY source",
    "prefix_list": f"{PLAIN} SELECT note_path FROM plain WHERE starts_with(note_path, 'src1/') ORDER BY note_path LIMIT 200",
    "word_count": rf"{WITH} SELECT note_path, len(regexp_extract_all(text, '\S+')) AS words, length(text) AS chars, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS n_lines, CAST(strlen(text) AS BIGINT) AS bytes FROM notes",
    "long_notes": rf"{PLAIN} SELECT note_path, len(regexp_extract_all(text, '\S+')) AS words FROM plain WHERE len(regexp_extract_all(text, '\S+')) >= 1000 ORDER BY words DESC, note_path LIMIT 50",
    "top_terms": f"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term FROM documents)
WHERE term NOT IN (SELECT unnest(string_split('{" ".join(C.T.STOPWORDS)}', ' '))) GROUP BY term ORDER BY n DESC, term LIMIT 50""",
    "long_lines": f"""{PLAIN}, l AS (SELECT note_path, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS s FROM plain)
SELECT note_path, list_max(s) AS chars, CAST(list_position(s, list_max(s)) AS BIGINT) AS line FROM l WHERE list_max(s) >= 300 ORDER BY chars DESC, note_path LIMIT 50""",
    "empty_notes": rf"""{WITH}, b AS (SELECT note_path, len(regexp_extract_all(regexp_replace(regexp_replace(text, '^---\n[\s\S]*?\n---\n?', ''), '#{{1,6}}\s+.+', '', 'g'), '\S+')) AS body_words FROM notes)
SELECT note_path, body_words FROM b WHERE body_words <= 20""",
    "without_frontmatter": f"{PLAIN} SELECT note_path FROM plain WHERE NOT starts_with(text, '---' || chr(10))",
    "with_property": f"{WITH} SELECT note_path, CAST(n_chars AS VARCHAR) AS value FROM notes JOIN documents USING (doc_id)",
    "property_distribution": "SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang",
    "query_property": f"{WITH} SELECT note_path FROM notes WHERE lang IN ('fr', 'de') AND source = 'src3' ORDER BY note_path LIMIT 100",
    "exact_duplicates": f"{PLAIN} SELECT sha256(text) AS sha256, count(*) AS n, min(note_path) AS least_path, CAST(max(strlen(text)) AS BIGINT) AS bytes FROM plain GROUP BY text HAVING count(*) >= 2",
    "duplicate_members": f"{PLAIN} SELECT sha256(text) AS sha256, note_path FROM plain WHERE text IN (SELECT text FROM plain GROUP BY text HAVING count(*) >= 2)",
    "note_hash": f"{PLAIN} SELECT note_path, sha256(text) AS sha256 FROM plain",
    "notes_with_attachments": rf"{WITH} SELECT note_path, len(regexp_extract_all(text, '(?i)!\[\[[^\]|#]+\.(?:png|jpe?g|gif|webp|svg|bmp|pdf|mp3|mp4|mov|webm)')) AS attachments FROM notes WHERE attachments > 0",
    "unreferenced_attachments": rf"""{WITH}, named AS (SELECT DISTINCT unnest(regexp_extract_all(text, '!\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]', 1)) AS name FROM notes)
SELECT DISTINCT 'assets/fig' || (doc_id % 8) || '.png' AS path FROM documents WHERE 'fig' || (doc_id % 8) || '.png' NOT IN (SELECT name FROM named)""",
    "find_tasks": rf"{LINES} SELECT note_path, line, 'open' AS status, substr(regexp_extract(content, '^\s*-\s+\[(.)\]\s+(.+?)\s*$', 2), 1, 200) AS task FROM l WHERE regexp_matches(content, '^\s*-\s+\[[^xX]\]\s+(.+?)\s*$')",
    "find_todos": rf"{LINES} SELECT note_path, line, regexp_extract(content, '\b(TODO|FIXME|NOTE|HACK|XXX)\b', 1) AS marker, substr(content, 1, 200) AS content FROM l WHERE regexp_matches(content, '\b(TODO|FIXME|NOTE|HACK|XXX)\b')",
    "grep_context": f"{LINES} SELECT note_path, line, content, coalesce(CASE WHEN line > 1 THEN ls[line - 1] END, '') AS before, coalesce(ls[line + 1], '') AS after FROM l WHERE contains(content, 'clown')",
    "grep_regex": rf"{LINES} SELECT note_path, line, content, '' AS before, '' AS after FROM l WHERE regexp_matches(content, '(?i)\bid[a-z]+t\b')",
    "find_by_size": f"{PLAIN} SELECT note_path, CAST(strlen(text) AS BIGINT) AS bytes FROM plain WHERE strlen(text) BETWEEN 1000 AND 1200",
    "bundle_cap": f"""{PLAIN}, s AS (SELECT note_path, CAST(strlen(text) AS BIGINT) AS bytes FROM plain), u AS (SELECT note_path, bytes,
  CAST(sum(bytes) OVER (ORDER BY split_part(note_path, '/', 1), note_path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM s) SELECT * FROM u WHERE upto <= 1000000""",
    "stats": f"""{PLAIN}, c AS (SELECT unnest(string_split(text, chr(10))) AS x FROM plain)
SELECT (SELECT count(*) FROM plain) AS notes, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM plain) AS bytes, count(*) AS chunks, CAST(floor(avg(strlen(x)) + 0.5) AS BIGINT) AS avg_chunk_bytes FROM c""",
}
