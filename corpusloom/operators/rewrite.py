"""Changes to notes as rewrites of the table (note_path, text); nothing is changed in place.

Each function returns the whole new table, or the changed rows where it says so. Persist with sources.snapshot.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def _when(paths: list[str] | None, changed: Column) -> Column:
    return changed if paths is None else F.when(F.col("note_path").isin(paths), changed).otherwise(F.col("text"))


def create(notes: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """``new`` rows join the table; of paths that exist already the old row stays unless ``overwrite``."""
    if overwrite:
        return notes.join(new, "note_path", "left_anti").unionByName(new)
    return notes.unionByName(new.join(notes, "note_path", "left_anti"))


def append(notes: DataFrame, paths: list[str] | None, suffix: str) -> DataFrame:
    return notes.withColumn("text", _when(paths, F.concat("text", F.lit(suffix))))


def prepend(notes: DataFrame, paths: list[str] | None, prefix: str) -> DataFrame:
    return notes.withColumn("text", _when(paths, F.concat(F.lit(prefix), F.col("text"))))


def replace_text(notes: DataFrame, find: str, put: str, prefix: str = "", first_only: bool = False) -> DataFrame:
    """Changed rows (note_path, text, replacements): literal replacement, all or the first."""
    here = notes.where(F.startswith("note_path", F.lit(prefix)) & F.contains("text", F.lit(find)))
    if first_only:
        at = F.locate(find, F.col("text"))
        text = F.concat(F.substring("text", 1, at - 1), F.lit(put), F.substring("text", at + len(find), F.char_length("text")))
        return here.select("note_path", text.alias("text"), F.lit(1).cast("long").alias("replacements"))
    count = (F.char_length("text") - F.char_length(F.replace("text", F.lit(find), F.lit("")))) / len(find)
    return here.select("note_path", F.replace("text", F.lit(find), F.lit(put)).alias("text"), count.cast("long").alias("replacements"))


def replace_lines(notes: DataFrame, paths: list[str] | None, first: int, last: int, put: str) -> DataFrame:
    """Lines first to last (from 1) become ``put``."""
    every = T.lines("text")
    return notes.withColumn("text", _when(paths, F.array_join(F.concat(F.slice(every, 1, first - 1), F.array(F.lit(put)), F.slice(every, last + 1, F.size(every))), "\n")))


def replace_first_line(notes: DataFrame, paths: list[str] | None, line: str) -> DataFrame:
    return replace_lines(notes, paths, 1, 1, re.split(r"\r?\n", line)[0])


def insert_after_heading(notes: DataFrame, paths: list[str] | None, heading: str, content: str) -> DataFrame:
    """``content`` between blank lines below the first heading of that text; notes without it stay."""
    every = T.lines("text")
    at = F.array_position(F.transform(every, lambda x: T.is_heading(x) & (T.heading_text(x) == heading)), True).cast("int")
    made = F.concat(F.slice(every, F.lit(1), at), F.array(F.lit(""), F.lit(content), F.lit("")), F.slice(every, at + 1, F.size(every)))
    return notes.withColumn("text", _when(paths, F.when(at > 0, F.array_join(made, "\n")).otherwise(F.col("text"))))


def rename_heading(notes: DataFrame, old: str, new: str) -> DataFrame:
    """All headings of that exact text, depth kept."""
    swap = lambda x: F.when(T.is_heading(x) & (T.heading_text(x) == old), F.concat(F.regexp_extract(x, T.HEADING, 1), F.lit(" " + new))).otherwise(x)
    return notes.withColumn("text", F.array_join(F.transform(T.lines("text"), swap), "\n"))


def patch_section(notes: DataFrame, paths: list[str] | None, heading: str, body: str) -> DataFrame:
    """The lines between a heading and the next of its depth or above become ``body``."""
    shaped = F.transform(T.lines("text"), lambda x: F.struct(x.alias("x"), F.when(T.is_heading(x), T.heading_depth(x)).alias("d"), T.heading_text(x).alias("t")))
    at = F.array_position(F.transform(shaped, lambda r: r["d"].isNotNull() & (r["t"] == heading)), True).cast("int")
    told = notes.withColumn("_all", shaped).withColumn("_at", at).withColumn("_d", F.when(F.col("_at") > 0, F.element_at("_all", F.when(F.col("_at") > 0, F.col("_at")).otherwise(1))["d"]))
    tail = F.slice("_all", F.col("_at") + 1, F.size("_all"))
    told = told.withColumn("_tail", F.when(F.col("_at") > 0, tail))
    stop = F.array_position(F.transform("_tail", lambda r: F.coalesce(r["d"] <= F.col("_d"), F.lit(False))), True).cast("int")
    rest = F.when(stop > 0, F.slice("_tail", F.greatest(stop, F.lit(1)), F.size("_tail"))).otherwise(F.slice("_tail", 1, 0))
    made = F.array_join(F.concat(F.transform(F.slice("_all", F.lit(1), F.greatest("_at", F.lit(1))), lambda r: r["x"]), F.array(F.lit(body)), F.transform(rest, lambda r: r["x"])), "\n")
    return told.withColumn("text", _when(paths, F.when(F.col("_at") > 0, made).otherwise(F.col("text")))).drop("_all", "_at", "_d", "_tail")


def toggle_tasks(notes: DataFrame, at: DataFrame) -> DataFrame:
    """Changed rows: checkboxes flip at the lines of ``at`` (note_path, line); other lines are left."""
    asked = at.groupBy("note_path").agg(F.collect_set(F.col("line").cast("int")).alias("_lines"))
    flip = lambda x: F.when(x.rlike(r"^\s*-\s+\[ \]"), F.regexp_replace(x, r"^(\s*-\s+)\[ \]", "$1[x]")).when(x.rlike(r"^\s*-\s+\[[xX]\]"), F.regexp_replace(x, r"^(\s*-\s+)\[[xX]\]", "$1[ ]")).otherwise(x)
    text = F.array_join(F.transform(T.lines("text"), lambda x, i: F.when(F.array_contains("_lines", i + 1), flip(x)).otherwise(x)), "\n")
    return notes.join(asked, "note_path").withColumn("text", text).drop("_lines")


def wiki_to_md(notes: DataFrame) -> DataFrame:
    """[[X]] and [[X|label]] become Markdown links to X.md; embeds stay; leading slashes and dot runs leave the href."""
    once = lambda x: F.regexp_replace(x, r"(?<!!)\[\[(?:/+)?([^\]|#]+?)(?:\.md)?\]\]", "[$1]($1.md)")
    named = F.regexp_replace("text", r"(?<!!)\[\[(?:/+)?([^\]|#]+?)(?:\.md)?\|([^\]]+)\]\]", "[$2]($1.md)")
    return notes.withColumn("text", F.regexp_replace(once(named), r"\]\(([^)]*?)\.{2,}/?([^)]*)\)", "]($1$2)"))


def md_to_wiki(notes: DataFrame) -> DataFrame:
    same = F.regexp_replace("text", r"\[([^\]]+)\]\(\1\.md\)", "[[$1]]")
    return notes.withColumn("text", F.regexp_replace(same, r"\[([^\]]+)\]\(([^)]+)\.md\)", "[[$2|$1]]"))


def rename_link_target(notes: DataFrame, old: str, new: str) -> DataFrame:
    """Changed rows (note_path, text, links): links to ``old`` name ``new``; alias and anchor stay; each link counts once."""
    pattern = rf"\[\[{re.escape(old)}(?=[\]|#])"
    here = notes.where(F.contains("text", F.lit(f"[[{old}")))
    changed = here.select("note_path", F.regexp_replace("text", pattern, "[[" + new.replace("\\", r"\\").replace("$", r"\$")).alias("text"), F.regexp_count("text", F.lit(pattern)).cast("long").alias("links"))
    return changed.where("links > 0")


def set_property(notes: DataFrame, key: str, value: str, paths: list[str] | None = None) -> DataFrame:
    """Sets one frontmatter key: replaces its line, adds it to a block, or adds a block."""
    if not re.fullmatch(r"[A-Za-z_][\w-]*", key):
        raise ValueError(f"not a key: {key}")
    line = f"{key}: {value}".replace("\\", r"\\").replace("$", r"\$")
    has = T.has_frontmatter("text") & F.map_contains_key(T.frontmatter("text"), key)
    replaced = F.regexp_replace("text", rf"\A(---\n(?:(?!---\n)[^\n]*\n)*?){key}\s*:[^\n]*\n", f"$1{line}\n")
    added = F.regexp_replace("text", r"\A(---\n(?:(?!---)[^\n]*\n)*)---", f"$1{line}\n---")
    fresh = F.concat(F.lit(f"---\n{key}: {value}\n---\n"), F.col("text"))
    return notes.withColumn("text", _when(paths, F.when(has, replaced).when(T.has_frontmatter("text"), added).otherwise(fresh)))


def unset_property(notes: DataFrame, key: str, paths: list[str] | None = None) -> DataFrame:
    has = F.map_contains_key(T.frontmatter("text"), key)
    bare = F.regexp_replace("text", rf"\A(---\n(?:(?!---\n)[^\n]*\n)*?){key}\s*:[^\n]*\n", "$1")
    return notes.withColumn("text", _when(paths, F.when(has, bare).otherwise(F.col("text"))))


def add_tag(notes: DataFrame, tag: str, paths: list[str] | None = None) -> DataFrame:
    """Appends #tag to notes that lack it."""
    missing = ~F.col("text").rlike(rf"(?m)(?:^|\s)#{re.escape(tag)}(?=\s|$)")
    return notes.withColumn("text", _when(paths, F.when(missing, F.concat("text", F.lit(f"\n\n#{tag}\n"))).otherwise(F.col("text"))))


def remove_tag(notes: DataFrame, tag: str, paths: list[str] | None = None) -> DataFrame:
    return notes.withColumn("text", _when(paths, F.regexp_replace("text", rf"(?m)(^|\s)#{re.escape(tag)}(?=\s|$)", "$1")))


def split_notes(notes: DataFrame, depth: int = 2, folder: str = "") -> DataFrame:
    """(note_path, text): a note for each heading of that depth, up to the next one; text before the first is left out.

    Notes go below ``folder`` into a folder of the note that they come from (its path without .md, and ``-split``), named
    by the title: ASCII letters, digits, ``_``, ``.`` and ``-``, white space as ``-``, 80 characters at most, or ``untitled``.
    No section is lost: the second of a name within its note gets `` (2)``, which no title leaves in a name, and so on.
    Null texts and notes without such headings give none; repeated rows are split alike. Everything stays in its row, and
    a text is cut at all its headings by one pass.
    """
    heading = rf"^#{{{depth}}}\s+(.+?)\s*$"
    # the same inside a text of lines: without MULTILINE, . and $ know these line ends too
    line = r"#{%d}[ \t\x0B\f\r]+[^\n\r\x85\u2028\u2029]+?[ \t\x0B\f\r]*[\x85\u2028\u2029]?(?:\n|\z)" % depth
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n", "\n")), rf"\n(?={line})")
    found = notes.select("note_path", F.slice(parts, 2, (1 << 31) - 1).alias("texts"))
    title = lambda x: F.trim(F.regexp_extract(F.substring_index(x, "\n", 1), heading, 1))
    bare = lambda x: F.trim(F.regexp_replace(title(x), r"[^A-Za-z0-9_\s.-]", ""))
    name = lambda x: F.regexp_replace(F.substring(F.regexp_replace(bare(x), r"\s+", "-"), 1, 80), r"\A\.+|\.+\z", "")
    found = found.withColumn("names", F.transform("texts", lambda x: F.coalesce(F.nullif(name(x), F.lit("")), F.lit("untitled"))))
    before = F.transform("names", lambda x, i: F.size(F.filter(F.slice("names", F.lit(1), i + 1), lambda y: y == x)))
    found = found.withColumn("nth", F.when(F.size(F.array_distinct("names")) == F.size("names"), F.transform("names", lambda x: F.lit(1))).otherwise(before))
    # outer: a filter on the size of the arrays would be pushed down and work all of them out again for each line
    each = found.select("note_path", F.inline_outer(F.arrays_zip("texts", "names", "nth"))).where("nth is not null")
    number = F.when(F.col("nth") > 1, F.concat(F.lit(" ("), F.col("nth").cast("string"), F.lit(")"))).otherwise("")
    path = F.concat(F.lit(folder), F.regexp_replace("note_path", r"(?i)\.md\z", ""), F.lit("-split/"), "names", number, F.lit(".md"))
    return each.select(path.alias("note_path"), F.col("texts").alias("text"))


def merge_notes(notes: DataFrame, sources: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(note_path, text): texts of ``sources`` (target, pos, note_path) in order of pos, missing ones left out."""
    found = sources.join(notes, "note_path")
    joined = found.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("all"))
    return joined.select(F.col("target").alias("note_path"), F.array_join(F.transform("all", lambda x: x["text"]), separator).alias("text"))


def copy_notes(notes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The table with copies for ``pairs`` (note_path, target); targets that exist already are not touched."""
    made = notes.join(pairs, "note_path").withColumn("note_path", F.col("target")).drop("target")
    return notes.unionByName(made.join(notes.select("note_path"), "note_path", "left_anti"))


def move(notes: DataFrame, old: str, new: str) -> DataFrame:
    """A note, or all below a folder, under a new path."""
    below = F.startswith("note_path", F.lit(old.rstrip("/") + "/"))
    moved = F.when(F.col("note_path") == old, F.lit(new)).when(below, F.concat(F.lit(new.rstrip("/")), F.substring("note_path", len(old.rstrip("/")) + 1, 1 << 20))).otherwise(F.col("note_path"))
    return notes.withColumn("note_path", moved)


def rename_many(notes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(note_path, target, ok) of ``pairs``: whether the source exists and the target does not."""
    have = notes.select("note_path")
    asked = pairs.join(have.withColumn("_src", F.lit(True)), "note_path", "left").join(have.select(F.col("note_path").alias("target"), F.lit(True).alias("_dst")), "target", "left")
    return asked.select("note_path", "target", (F.coalesce("_src", F.lit(False)) & F.col("_dst").isNull()).alias("ok"))


def trash(notes: DataFrame, paths: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes to trash with ``stamp``)."""
    return notes.join(paths, "note_path", "left_anti"), notes.join(paths, "note_path", "left_semi").withColumn("stamp", F.lit(stamp))


def archive(notes: DataFrame, paths: DataFrame | list[str], day: str) -> DataFrame:
    """The table with ``paths`` (a table (note_path) of any size, or a short list) marked and moved below Archive/."""
    if not isinstance(paths, list):
        name = F.concat(F.lit("Archive/"), F.element_at(F.split("note_path", "/"), -1))
        moved = set_property(notes.join(paths, "note_path", "left_semi"), "archived", day).withColumn("note_path", name)
        return notes.join(paths, "note_path", "left_anti").unionByName(moved)
    marked = set_property(notes, "archived", day, paths)
    return marked.withColumn("note_path", F.when(F.col("note_path").isin(paths), F.concat(F.lit("Archive/"), F.element_at(F.split("note_path", "/"), -1))).otherwise(F.col("note_path")))


def restore(trashed: DataFrame) -> DataFrame:
    """(note_path, text): the latest trashed version of each path."""
    return trashed.groupBy("note_path").agg(F.max_by("text", "stamp").alias("text"))


def trash_summary(trashed: DataFrame) -> DataFrame:
    return trashed.agg(F.count("*").alias("notes"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"))


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders (path) without any file at or below them."""
    parts = F.split("path", "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path"))
    return folders.join(above.distinct(), "path", "left_anti")


def periodic_stem(day: Column, period: str) -> Column:
    """Name of the daily, weekly (ISO), monthly or yearly note of a day."""
    if period == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return F.date_format(day, {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}[period])


def append_periodic(notes: DataFrame, entries: DataFrame, period: str, folder: str = "") -> DataFrame:
    """The table after ``entries`` (day, pos, entry) went to the note of their period, created where it is missing."""
    named = entries.withColumn("note_path", F.concat(F.lit(folder), periodic_stem(F.col("day"), period), F.lit(".md")))
    added = named.groupBy("note_path").agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("all"))
    added = added.select("note_path", F.array_join(F.transform("all", lambda x: x["entry"]), "\n").alias("_new"))
    joined = notes.join(added, "note_path", "full")
    text = F.when(F.col("_new").isNull(), F.col("text")).when(F.col("text").isNull(), F.col("_new")).otherwise(F.concat("text", F.lit("\n"), F.col("_new")))
    return joined.select("note_path", text.alias("text"))


def fill_template(template: Column, variables: dict[str, Column]) -> Column:
    """{{name}} becomes its value, spaces inside the braces allowed; unknown names stay.

    All names are filled in one pass, so braces inside a value are text. A null value makes the text null.
    """
    if not variables:
        return template
    known = "|".join(map(re.escape, sorted(variables, key=len, reverse=True)))
    mark = rf"\{{\{{\s*({known})\s*\}}\}}"
    value = lambda name: F.coalesce(*[F.when(name == k, v) for k, v in variables.items()])
    texts = F.split(template, mark, -1)
    values = F.transform(F.regexp_extract_all(template, F.lit(mark), F.lit(1)), value)
    filled = F.flatten(F.zip_with(texts, values, lambda t, v: F.array(t, F.coalesce(v, F.lit("")))))
    return F.when(F.forall(values, lambda v: v.isNotNull()), F.array_join(filled, ""))


def delete_folder(notes: DataFrame, folder: str, stamp: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes to trash with ``stamp``): all below ``folder``, at any depth; notes without a path stay."""
    below = F.coalesce(F.startswith("note_path", F.lit(folder.strip("/") + "/")), F.lit(False))
    return notes.where(~below), notes.where(below).withColumn("stamp", F.lit(stamp))


def purge(trashed: DataFrame, before: str) -> DataFrame:
    """What is left of the trash when all with an older stamp than ``before`` is deleted for good; stamps sort by time, null ones stay."""
    return trashed.where(F.col("stamp").isNull() | (F.col("stamp") >= before))


def tag_notes(notes: DataFrame, tag: str, paths: DataFrame) -> DataFrame:
    """Changed rows: notes of ``paths`` that lacked the tag."""
    some = notes.join(paths, "note_path", "left_semi")
    return add_tag(some, tag).join(some.select("note_path", F.col("text").alias("_old")), "note_path").where("text <> _old").drop("_old")

