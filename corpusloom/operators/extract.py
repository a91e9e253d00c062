"""What a note's structure holds: outlines, sections, links, quotes, fields, code, tables. One row in, rows or arrays out.

Lines of one note are handled as arrays inside its row wherever order matters, so nothing is shuffled to see a line's
neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from corpusloom.functions import text as T


# The patterns of headings, tasks, links, images, fields, tables and fences in this module, which results have to match.


def line_offsets(notes: DataFrame) -> DataFrame:
    """(note_path, line, byte_start, content): byte offset of each line; the width of line ends is taken once for a note."""
    width = F.when(F.contains("text", F.lit("\r\n")), 2).otherwise(1)
    zipped = notes.select("note_path", F.posexplode(T.lines("text")).alias("pos", "content"), width.alias("w"))
    before = Window.partitionBy("note_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("content").cast("long") + F.col("w")).over(before), F.lit(0))
    return zipped.select("note_path", (F.col("pos") + 1).cast("long").alias("line"), at.cast("long").alias("byte_start"), "content")


def outline(notes: DataFrame) -> DataFrame:
    """(note_path, line, depth, title, byte_start) of heading lines, those in code fences included."""
    found = line_offsets(notes).where(T.is_heading(F.col("content")))
    return found.select("note_path", "line", T.heading_depth(F.col("content")).cast("long").alias("depth"), T.heading_text(F.col("content")).alias("title"), "byte_start")


def sections(notes: DataFrame) -> DataFrame:
    """(note_path, section, heading, depth, words): words below each heading; 0 is the part before any, if it has words."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n", "\n")), r"\n(?=#{1,6}[ \t\f\x0b]+\S)")
    each = notes.select("note_path", F.posexplode(parts).alias("section", "part"))
    first = F.when(F.col("section") > 0, F.split_part("part", F.lit("\n"), F.lit(1)))
    rest = F.when(F.col("section") > 0, F.regexp_replace("part", r"^[^\n]*", "")).otherwise(F.col("part"))
    shaped = each.select("note_path", F.col("section").cast("long"), F.coalesce(T.heading_text(first), F.lit("(preamble)")).alias("heading"), F.coalesce(T.heading_depth(first), F.lit(0)).cast("long").alias("depth"), T.n_words(rest).cast("long").alias("words"))
    return shaped.where((F.col("section") > 0) | (F.col("words") > 0))


def partial(notes: DataFrame, heading: str) -> DataFrame:
    """(note_path, body): from the first heading of that text to the next one of the same depth or above."""
    rows = F.transform(T.lines("text"), lambda x: F.struct(x.alias("content"), F.when(T.is_heading(x), T.heading_depth(x)).alias("depth"), T.heading_text(x).alias("title")))
    told = notes.select("note_path", rows.alias("all"))
    first = F.array_position(F.transform("all", lambda x: x["depth"].isNotNull() & (x["title"] == heading)), True)
    told = told.withColumn("first", first.cast("int")).where("first > 0")
    tail = F.slice("all", F.col("first") + 1, F.size("all"))
    told = told.select("note_path", F.element_at("all", F.col("first"))["depth"].alias("d"), F.element_at("all", F.col("first"))["content"].alias("title"), tail.alias("tail"))
    stop = F.array_position(F.transform("tail", lambda x: F.coalesce(x["depth"] <= F.col("d"), F.lit(False))), True).cast("int")
    kept = F.when(stop > 0, F.slice("tail", F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(F.col("tail"))
    return told.select("note_path", F.array_join(F.concat(F.array("title"), F.transform(kept, lambda x: x["content"])), "\n").alias("body"))


def table_of_contents(notes: DataFrame, max_depth: int = 6) -> DataFrame:
    """(note_path, toc): an indented list of headings with their anchors."""
    heads = F.filter(T.lines("text"), lambda x: T.is_heading(x) & (T.heading_depth(x) <= max_depth))
    item = lambda x: F.concat(F.repeat(F.lit("  "), T.heading_depth(x) - 1), F.lit("- ["), T.heading_text(x), F.lit("](#"), T.slug(T.heading_text(x)), F.lit(")"))
    return notes.select("note_path", F.array_join(F.transform(heads, item), "\n").alias("toc"))


def note_status(notes: DataFrame) -> DataFrame:
    """(note_path, bytes, words, n_lines, headings, tasks, tags, links): one projection, no shuffle."""
    every = T.lines("text")
    count = lambda a: F.size(a).cast("long")
    return notes.select(
        "note_path",
        F.octet_length("text").cast("long").alias("bytes"),
        T.n_words("text").cast("long").alias("words"),
        count(every).alias("n_lines"),
        count(F.filter(every, lambda x: x.rlike(r"^#{1,6}\s+"))).alias("headings"),
        count(F.filter(every, lambda x: x.rlike(r"^\s*-\s+\[[ xX]\]\s+"))).alias("tasks"),
        count(F.array_distinct(T.tags("text"))).alias("tags"),
        count(F.array_distinct(T.all_groups("text", r"(?<!!)\[\[([^\]|#]+)"))).alias("links"),
    )


def excerpt(notes: DataFrame, n_lines: int = 50, n_bytes: int = 4096) -> DataFrame:
    """(note_path, excerpt, truncated): the first bytes, then their first lines."""
    head = F.decode(F.substring(F.encode("text", "UTF-8"), 1, n_bytes), "UTF-8")
    kept = F.split(head, r"\r?\n")
    cut = (F.size(kept) > n_lines) | (F.char_length(head) < F.octet_length("text"))
    return notes.select("note_path", F.array_join(F.slice(kept, 1, n_lines), "\n").alias("excerpt"), cut.alias("truncated"))


def first_paragraph(notes: DataFrame) -> DataFrame:
    """(note_path, paragraph): the first block between empty lines that is neither blank nor a heading; else empty."""
    blocks = F.transform(F.split(T.body("text"), r"\n\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))
    fit = F.filter(blocks, lambda x: (x != "") & ~x.rlike(r"^#{1,6}\s+"))
    return notes.select("note_path", F.coalesce(F.get(fit, F.lit(0)), F.lit("")).alias("paragraph"))


def inline_fields(notes: DataFrame, max_line: int | None = None) -> DataFrame:
    """(note_path, line, key, value) of ``key:: value`` in all lines, or in those of up to ``max_line`` characters."""
    lines = notes.select("note_path", F.posexplode(T.lines("text")).alias("pos", "content")).where(F.contains("content", F.lit("::")))
    lines = lines if max_line is None else lines.where(F.char_length("content") <= max_line)
    pairs = F.arrays_zip(T.all_groups("content", T.INLINE_FIELD, 1).alias("key"), T.all_groups("content", T.INLINE_FIELD, 2).alias("value"))
    found = lines.select("note_path", (F.col("pos") + 1).cast("long").alias("line"), F.explode(pairs).alias("p"))
    return found.select("note_path", "line", F.col("p.key").alias("key"), F.trim(F.col("p.value")).alias("value"))


def image_refs(notes: DataFrame) -> DataFrame:
    """(note_path, embeds, images): distinct embedded pictures, and all sources of Markdown pictures."""
    kinds = r"\.(?:png|jpe?g|gif|webp|svg|bmp)"
    return notes.select("note_path", F.array_distinct(T.all_groups("text", rf"(?i)!\[\[([^\]|#]+{kinds})(?:[|#][^\]]*)?\]\]")).alias("embeds"), T.all_groups("text", rf"(?i)!\[[^\]]*\]\(([^)]+{kinds})\)").alias("images"))


def external_urls(notes: DataFrame) -> DataFrame:
    """(note_path, urls): targets of Markdown links first, then bare addresses, each once."""
    return notes.select("note_path", F.array_distinct(F.concat(T.all_groups("text", r"\[[^\]]+\]\((https?://[^)]+)\)"), T.all_groups("text", r"""(?<![("\[])\b(https?://[^\s)<>"']+)"""))).alias("urls"))


def all_links(notes: DataFrame) -> DataFrame:
    """(note_path, wikilinks, md_links, embeds)."""
    return notes.select("note_path", F.array_distinct(T.all_groups("text", T.PLAIN_LINK)).alias("wikilinks"), T.all_groups("text", T.MD_LINK, 2).alias("md_links"), F.array_distinct(T.all_groups("text", T.EMBED)).alias("embeds"))


def block_ids(notes: DataFrame) -> DataFrame:
    """(note_path, line, id) of lines that end in ^id."""
    lines = notes.select("note_path", F.posexplode(T.lines("text")).alias("pos", "content")).where(F.col("content").rlike(r"\s\^[A-Za-z0-9-]+\s*\z"))
    return lines.select("note_path", (F.col("pos") + 1).cast("long").alias("line"), F.regexp_extract("content", r"\s\^([A-Za-z0-9-]+)\s*\z", 1).alias("id"))


def quotes(notes: DataFrame) -> DataFrame:
    """(note_path, line, quote): each stretch of quoted lines, marks taken off.

    Quoted lines in a row have the same distance between line number and rank among quoted lines.
    """
    rows = F.transform(T.lines("text"), lambda x, i: F.struct(i.alias("pos"), x.alias("content")))
    quoted = notes.select("note_path", F.filter(rows, lambda x: x["content"].rlike(r"^\s*>")).alias("q"))
    each = quoted.select("note_path", F.posexplode("q").alias("rank", "x")).select("note_path", F.col("x.pos").alias("pos"), (F.col("x.pos") - F.col("rank")).alias("island"), F.regexp_replace("x.content", r"^\s*>\s?", "").alias("content"))
    grouped = each.groupBy("note_path", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("all"))
    return grouped.select("note_path", (F.col("all")[0]["pos"] + 1).cast("long").alias("line"), F.array_join(F.transform("all", lambda x: x["content"]), "\n").alias("quote"))


#: Characters of notes that a task scans at a time (one note at least), and of results that it holds.
SCAN_CHARS = 1 << 20


def _per_note(notes: DataFrame, schema: str, scan) -> DataFrame:
    """Rows that ``scan(lines)`` yields for each note, in Arrow batches; for what needs a state machine over lines.

    Notes are taken from a batch one by one and rows sent on as soon as they are from SCAN_CHARS characters, so a task
    holds the lines of one note and not those of a batch.
    """
    kinds = [to_arrow_type(f.dataType) for f in DataType.fromDDL(schema).fields]
    names = DataType.fromDDL(schema).names

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, text in zip(batch.column("note_path"), batch.column("text"), strict=True):
                path, text = path.as_py(), text.as_py() or ""
                for r in scan(text.replace("\r\n", "\n").split("\n")):
                    rows.append((path, *r))
                held += len(text)
                if rows and held > SCAN_CHARS:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return notes.select("note_path", "text").mapInArrow(run, schema)


def _fences(lines: list[str], opens) -> Iterator[tuple[int, str, str]]:
    at = 0
    while at < len(lines):
        lang = opens(lines[at])
        if lang is None:
            at += 1
            continue
        end = next((i for i in range(at + 1, len(lines)) if lines[i].rstrip() == "```"), len(lines))
        yield at + 1, lang, "\n".join(lines[at + 1 : end])
        at = end + 1


def code_blocks(notes: DataFrame) -> DataFrame:
    """(note_path, line, lang, code) of fenced blocks; one that is not closed runs to the end."""
    import re

    def scan(lines):
        return _fences(lines, lambda x: m[1] if (m := re.match(r"```(\w*)\s*$", x)) else None)

    return _per_note(notes, "note_path string, line long, lang string, code string", scan)


def dataview_blocks(notes: DataFrame) -> DataFrame:
    """(note_path, line, query) of blocks fenced as dataview."""

    def scan(lines):
        return ((line, code) for line, _, code in _fences(lines, lambda x: "" if x.rstrip().lower() == "```dataview" else None))

    return _per_note(notes.where(F.contains(F.lower("text"), F.lit("```dataview"))), "note_path string, line long, query string", scan)


def tables(notes: DataFrame) -> DataFrame:
    """(note_path, line, cells) with cells array<array<string>>: pipe tables, delimiter rows left out."""
    import re

    row, rule = re.compile(r"\|.*\|\s*$"), re.compile(r"\|?[\s:|-]+\|?\s*$")

    def scan(lines):
        at = 0
        while at < len(lines):
            if row.match(lines[at]) and at + 1 < len(lines) and rule.match(lines[at + 1]):
                end = next((i for i in range(at, len(lines)) if not row.match(lines[i])), len(lines))
                bare = [re.sub(r"^\||\|$", "", x) for x in lines[at:end] if not rule.match(x)]
                yield at + 1, [[c.strip() for c in x.split("|")] for x in bare]
                at = max(end, at + 1)
            else:
                at += 1

    return _per_note(notes, "note_path string, line long, cells array<array<string>>", scan)


def line_set_diff(left: DataFrame, right: DataFrame, pair: str | None = None) -> DataFrame:
    """(side, content): lines of one note that the other lacks, repeats kept.

    With ``pair``, a column of both sides, each pair is one diff and its key is the first column; a pair that one side
    lacks has no diff. Without it each side is a table of notes of one row.
    """
    keys = [pair] if pair else []
    if pair:
        left, right = left.join(right.select(pair).distinct(), pair, "left_semi"), right.join(left.select(pair).distinct(), pair, "left_semi")
    a = left.select(*keys, F.explode(T.lines("text")).alias("content"))
    b = right.select(*keys, F.explode(T.lines("text")).alias("content"))
    only = lambda x, y, side: x.join(y.distinct(), [*keys, "content"], "left_anti").select(*keys, F.lit(side).alias("side"), "content")
    return only(a, b, "left").unionByName(only(b, a, "right"))


def read_slice(notes: DataFrame, start: int, end: int) -> DataFrame:
    """(note_path, bytes, part): bytes [start, end) of each text, decoded."""
    raw: Column = F.encode("text", "UTF-8")
    return notes.select("note_path", F.octet_length("text").cast("long").alias("bytes"), F.decode(F.substring(raw, start + 1, end - start), "UTF-8").alias("part"))
