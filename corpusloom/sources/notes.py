"""Notes as a table (note_path, text, ...), from folders of Markdown or from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _relative(root: str) -> Column:
    """Path of a scanned file below ``root``."""
    bare = root.rstrip("/").split("://")[-1].removeprefix("file:")
    return F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*(?=/)", "").substr(F.lit(len(bare) + 2), F.lit(1 << 20))


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, modified, bytes, content): all files below ``root`` that are not hidden, one row each.

    Filters on bytes and modified reach the scan, and content is read only where it is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    named = files.select(_relative(root).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")
    return named.where(~F.col("path").rlike(r"(^|/)\."))


def walk_notes(spark: SparkSession, root: str) -> DataFrame:
    """(note_path, text, modified, bytes) of all Markdown files below ``root``; hidden files and folders are left out."""
    files = read_files(spark, root, "*.[mM][dD]")
    return files.select(F.col("path").alias("note_path"), F.decode("content", "UTF-8").alias("text"), "modified", "bytes")


def document_notes(documents: DataFrame) -> DataFrame:
    """Plain documents as notes: source/doc_id.md."""
    return documents.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("note_path"), "doc_id", "text")


def _decorate(line: Column, doc_id: Column) -> Column:
    n = F.char_length(line)
    by = [
        F.concat(F.lit("## "), line),
        F.concat(F.lit("- [ ] "), line),
        F.concat(F.lit("- [x] "), line),
        F.concat(F.lit("> "), line),
        F.concat(line, F.lit(" #t"), (n % 13).cast("string")),
        F.concat(line, F.lit(" [["), ((doc_id * 7 + n) % 1500).cast("string"), F.lit("]]")),
        F.concat(line, F.lit(" status:: "), (n % 5).cast("string")),
        F.concat(line, F.lit(" TODO see https://example.org/"), n.cast("string")),
        F.concat(line, F.lit(" ![[fig"), (n % 4).cast("string"), F.lit(".png]]")),
    ]
    made = by[-1]
    for i in range(len(by) - 2, -1, -1):
        made = F.when(n % len(by) == i, by[i]).otherwise(made)
    return made


def markdown_notes(documents: DataFrame) -> DataFrame:
    """Documents as Markdown notes, so that operators on structure have whole tables to work on.

    Frontmatter holds language, source and length; a line becomes a heading, task, quote, or gets a tag, link, field,
    marker or embed by its own length. NOTES_SQL says the same for another engine.
    """
    head = F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\nsource: "), F.col("source"), F.lit("\nchars: "), F.col("n_chars").cast("string"), F.lit("\n---\n"))
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x: _decorate(x, F.col("doc_id"))), "\n")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return documents.select(path.alias("note_path"), "doc_id", "lang", "source", F.concat(head, text).alias("text"))


NOTES_SQL = """notes AS (SELECT source || '/' || doc_id || '.md' AS note_path, doc_id, lang, source,
  '---' || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || 'chars: ' || n_chars || chr(10) || '---' || chr(10) ||
  array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE length(x) % 9
    WHEN 0 THEN '## ' || x WHEN 1 THEN '- [ ] ' || x WHEN 2 THEN '- [x] ' || x WHEN 3 THEN '> ' || x WHEN 4 THEN x || ' #t' || (length(x) % 13)
    WHEN 5 THEN x || ' [[' || ((doc_id * 7 + length(x)) % 1500) || ']]' WHEN 6 THEN x || ' status:: ' || (length(x) % 5)
    WHEN 7 THEN x || ' TODO see https://example.org/' || length(x) ELSE x || ' ![[fig' || (length(x) % 4) || '.png]]' END), chr(10)) AS text
  FROM documents)"""
