"""Counts, filters and rankings over a table of notes (note_path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def tag_counts(notes: DataFrame) -> DataFrame:
    """(tag, n): occurrences of each #tag, case kept."""
    return notes.select(F.explode(T.tags("text")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def notes_by_tag(notes: DataFrame, tag: str) -> DataFrame:
    """Paths of the notes with the tag, in any case; a plain substring test goes before the pattern."""
    maybe = notes.where(F.contains(F.lower("text"), F.lit("#" + tag.lower())))
    return maybe.where(F.exists(T.tags("text"), lambda t: F.lower(t) == tag.lower())).select("note_path")


def count_notes(notes: DataFrame, prefix: str = "") -> DataFrame:
    """(notes, bytes) of the paths that start with ``prefix``."""
    return notes.where(F.startswith("note_path", F.lit(prefix))).agg(F.count("*").alias("notes"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"))


def size_breakdown(notes: DataFrame) -> DataFrame:
    """(folder, notes, bytes) by first path part."""
    return notes.where(F.contains("note_path", F.lit("/"))).groupBy(F.split_part("note_path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count("*").alias("notes"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


def prefix_list(notes: DataFrame, prefix: str, limit: int = 200) -> DataFrame:
    return notes.where(F.startswith("note_path", F.lit(prefix.lstrip("/")))).select("note_path").orderBy("note_path").limit(limit)


def word_count(notes: DataFrame) -> DataFrame:
    """(note_path, words, chars, n_lines, bytes)."""
    return notes.select("note_path", T.n_words("text").cast("long").alias("words"), F.char_length("text").cast("long").alias("chars"), F.size(T.lines("text")).cast("long").alias("n_lines"), F.octet_length("text").cast("long").alias("bytes"))


def long_notes(notes: DataFrame, min_words: int = 1000, limit: int = 50) -> DataFrame:
    counted = notes.select("note_path", T.n_words("text").cast("long").alias("words"))
    return counted.where(F.col("words") >= min_words).orderBy(F.desc("words"), "note_path").limit(limit)


def top_terms(notes: DataFrame, limit: int = 50, max_bytes: int | None = None) -> DataFrame:
    """(term, n): most frequent runs of four or more a-z, stop words left out. Ties by term. Texts above ``max_bytes``, if set, do not count."""
    counted = notes if max_bytes is None else notes.where(F.octet_length("text") <= max_bytes)
    terms = counted.select(F.explode(T.all_groups(F.lower("text"), "[a-z]{4,}", 0)).alias("term")).where(~F.col("term").isin(T.STOPWORDS))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(limit)


def long_lines(notes: DataFrame, min_chars: int, limit: int = 50) -> DataFrame:
    """(note_path, chars, line): each note's longest line, the first of equals, if long enough. One pass, no shuffle of lines."""
    sizes = F.transform(T.lines("text"), lambda x: F.char_length(x))
    sized = notes.select("note_path", sizes.alias("sizes")).select("note_path", F.array_max("sizes").cast("long").alias("chars"), F.array_position("sizes", F.array_max("sizes")).alias("line"))
    return sized.where(F.col("chars") >= min_chars).orderBy(F.desc("chars"), "note_path").limit(limit)


def empty_notes(notes: DataFrame, max_words: int = 5) -> DataFrame:
    """(note_path, body_words) of notes with few words apart from frontmatter and headings."""
    bare = F.regexp_replace(T.body("text"), r"#{1,6}\s+.+", "")
    return notes.select("note_path", T.n_words(bare).cast("long").alias("body_words")).where(F.col("body_words") <= max_words)


def without_frontmatter(notes: DataFrame) -> DataFrame:
    return notes.where(~T.has_frontmatter("text")).select("note_path")


def with_property(notes: DataFrame, key: str) -> DataFrame:
    """(note_path, value) of notes whose frontmatter has the key."""
    return notes.select("note_path", T.frontmatter("text").alias("fm")).where(F.map_contains_key("fm", key)).select("note_path", F.col("fm")[key].alias("value"))


def property_distribution(notes: DataFrame, key: str) -> DataFrame:
    """(value, n) over all notes; an inline list counts each of its members."""
    value = T.frontmatter("text")[key]
    each = F.when(value.rlike(r"^\[.*\]\z"), F.transform(F.split(F.regexp_replace(value, r"^\[|\]\z", ""), ","), lambda x: F.trim(x))).otherwise(F.array(value))
    return notes.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def query_property(notes: DataFrame, wanted: dict[str, str | list[str]], limit: int = 100) -> DataFrame:
    """Notes whose frontmatter equals all of ``wanted``; a list means any of it."""
    found = notes.select("note_path", T.frontmatter("text").alias("fm"))
    for key, value in wanted.items():
        found = found.where(F.col("fm")[key].isin(value if isinstance(value, list) else [value]))
    return found.select("note_path").orderBy("note_path").limit(limit)


def exact_duplicates(notes: DataFrame) -> DataFrame:
    """(sha256, n, least_path, bytes) of contents that two or more notes have; members: duplicate_members.

    A group is its digest and size, never a list, so a text that a third of all notes share costs no more than another.
    """
    hashed = notes.select(F.sha2("text", 256).alias("sha256"), "note_path", F.octet_length("text").cast("long").alias("bytes"))
    return hashed.groupBy("sha256").agg(F.count("*").alias("n"), F.min("note_path").alias("least_path"), F.max("bytes").alias("bytes")).where("n >= 2")


def duplicate_members(notes: DataFrame) -> DataFrame:
    """(sha256, note_path) for every note in a group of exact_duplicates."""
    hashed = notes.select(F.sha2("text", 256).alias("sha256"), "note_path")
    return hashed.join(hashed.groupBy("sha256").count().where("count >= 2").select("sha256"), "sha256", "left_semi")


def note_hash(notes: DataFrame) -> DataFrame:
    return notes.select("note_path", F.sha2("text", 256).alias("sha256"))


def notes_with_attachments(notes: DataFrame) -> DataFrame:
    count = F.regexp_count("text", F.lit(T.ATTACHMENT_EMBED)) + F.regexp_count("text", F.lit(T.ATTACHMENT_IMAGE))
    return notes.select("note_path", count.cast("long").alias("attachments")).where("attachments > 0")


def unreferenced(notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """Attachments (path) that no note embeds or links, by path or by file name: an equi anti-join on what notes name."""
    named = notes.select(F.explode(F.concat(T.all_groups("text", T.EMBED), T.all_groups("text", T.MD_LINK, 2))).alias("name")).distinct()
    keyed = attachments.withColumn("_base", F.element_at(F.split("path", "/"), -1))
    return keyed.join(named, F.col("path") == F.col("name"), "left_anti").join(named, F.col("_base") == F.col("name"), "left_anti").select("path")


def numbered_lines(notes: DataFrame, *keep: str) -> DataFrame:
    """(note_path, line, content): every line, numbered from 1."""
    return notes.select("note_path", *keep, F.posexplode(T.lines("text")).alias("pos", "content")).select("note_path", *keep, (F.col("pos") + 1).alias("line"), "content")


def find_tasks(notes: DataFrame, status: str = "all", limit: int | None = None) -> DataFrame:
    """(note_path, line, status, task): checkbox lines; x or X is done, anything else open; 200 characters of text."""
    found = numbered_lines(notes).where(F.col("content").rlike(T.TASK))
    mark = F.lower(F.trim(F.regexp_extract("content", T.TASK, 1)))
    found = found.select("note_path", F.col("line").cast("long"), F.when(mark == "x", "done").otherwise("open").alias("status"), F.substring(F.regexp_extract("content", T.TASK, 2), 1, 200).alias("task"))
    found = found if status == "all" else found.where(F.col("status") == status)
    return found.orderBy("note_path", "line").limit(limit) if limit else found


def find_todos(notes: DataFrame, markers: tuple[str, ...] = ("TODO", "FIXME", "NOTE", "HACK", "XXX"), limit: int | None = None) -> DataFrame:
    """(note_path, line, marker, content): the first marker word of each line that has one."""
    pattern = rf"\b({'|'.join(markers)})\b"
    found = numbered_lines(notes).where(F.col("content").rlike(pattern))
    found = found.select("note_path", F.col("line").cast("long"), F.regexp_extract("content", pattern, 1).alias("marker"), F.substring("content", 1, 200).alias("content"))
    return found.orderBy("note_path", "line").limit(limit) if limit else found


def catastrophic(pattern: str) -> bool:
    """Whether a pattern repeats a repeated group, which can take exponential time."""
    import re

    return bool(re.search(r"\([^)]*[+*][^)]*\)[+*{]", pattern))


def grep(notes: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, context: int = 0, limit: int | None = None, max_chars: int | None = None) -> DataFrame:
    """(note_path, line, content, before, after): matching lines with up to five lines around, within the row's own text.

    Whole lines are read and returned, or their first ``max_chars`` characters, if set.
    """
    if len(pattern) > 256 or regex and catastrophic(pattern):
        raise ValueError("pattern is too long or repeats a repeated group")
    around = min(5, context)
    kept = notes.select("note_path", T.lines("text").alias("all"))
    if not regex:  # cheap test of the whole text first
        kept = notes.where(F.contains(F.lower("text") if ignore_case else F.col("text"), F.lit(pattern.lower() if ignore_case else pattern))).select("note_path", T.lines("text").alias("all"))
    hits = kept.select("note_path", "all", F.posexplode("all").alias("pos", "content"))
    content = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    test = content.rlike(("(?i)" if ignore_case else "") + pattern) if regex else F.contains(F.lower(content) if ignore_case else content, F.lit(pattern.lower() if ignore_case else pattern))
    before = F.slice("all", F.greatest(F.col("pos") + 1 - around, F.lit(1)), F.least(F.col("pos"), F.lit(around)))
    after = F.slice("all", F.col("pos") + 2, F.lit(around))
    found = hits.where(test).select("note_path", (F.col("pos") + 1).cast("long").alias("line"), content.alias("content"), F.array_join(before, "\n").alias("before"), F.array_join(after, "\n").alias("after"))
    return found.orderBy("note_path", "line").limit(limit) if limit else found


def recent(files: DataFrame, limit: int = 20, modified: str = "modified") -> DataFrame:
    return files.orderBy(F.desc(modified), "note_path").limit(limit)


def changed_since(files: DataFrame, since: Column, limit: int = 50, modified: str = "modified") -> DataFrame:
    return recent(files.where(F.col(modified) >= since), limit, modified)


def stale(files: DataFrame, as_of: Column, age_days: float, limit: int = 50, modified: str = "modified") -> DataFrame:
    """Oldest first of what was not touched for ``age_days`` days, with its age."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.col(modified).cast("timestamp"))) / 86_400_000_000
    return files.withColumn("age_days", age).where(F.col("age_days") > age_days).orderBy(modified, "note_path").limit(limit)


def date_range(files: DataFrame, first: Column, last: Column, limit: int = 100, modified: str = "modified") -> DataFrame:
    return recent(files.where(F.col(modified).between(first, last)), limit, modified)


def today(files: DataFrame, as_of: Column, limit: int = 200, modified: str = "modified") -> DataFrame:
    return recent(files.where(F.col(modified) >= F.date_trunc("day", as_of)), limit, modified)


def freshness(files: DataFrame, as_of: Column, limit: int = 10, modified: str = "modified") -> DataFrame:
    """The most recent and the longest untouched, with a column ``kind``."""
    old = stale(files, as_of, 0, limit, modified).drop("age_days")
    return recent(files, limit, modified).withColumn("kind", F.lit("recent")).unionByName(old.withColumn("kind", F.lit("stale")))


def random_notes(notes: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """A uniform sample without replacement, the same for a seed: the n least hashes of path and seed."""
    return notes.select("note_path").orderBy(F.xxhash64(F.lit(seed), "note_path"), "note_path").limit(n)


def stats(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: notes, bytes, chunks, mean chunk bytes (rounded half up)."""
    whole = notes.agg(F.count("*").alias("notes"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    parts = chunks.agg(F.count("*").alias("chunks"), F.floor(F.avg(F.octet_length("text").cast("long")) + 0.5).alias("avg_chunk_bytes"))
    return whole.crossJoin(parts)  # one row each


def running_bundle(notes: DataFrame, cap_bytes: int, per_note: int | None = None) -> DataFrame:
    """(note_path, bytes, upto): notes in path order while the bundle stays within ``cap_bytes``.

    A note counts with all its bytes, or with ``per_note`` at most, if set. Sums by first path part come first, so each
    window holds one folder.
    """
    sized = notes.select("note_path", F.split_part("note_path", F.lit("/"), F.lit(1)).alias("folder"), (F.octet_length("text") if per_note is None else F.least(F.octet_length("text"), F.lit(per_note))).cast("long").alias("bytes"))
    folders = sized.groupBy("folder").agg(F.sum("bytes").alias("b"))
    offsets = folders.select(F.col("folder").alias("_f"), F.coalesce(F.sum("b").over(Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("bytes").over(Window.partitionBy("folder").orderBy("note_path"))
    summed = sized.withColumn("within", within).join(offsets, F.col("folder") == F.col("_f"))
    return summed.select("note_path", "bytes", (F.col("before") + F.col("within")).alias("upto")).where(F.col("upto") <= cap_bytes)


def bundle_parts(notes: DataFrame, cap_bytes: int, separator: str = "\n\n---\n\n") -> DataFrame:
    """(note_path, part): the text of a bundle by notes, in path order while the whole stays within ``cap_bytes``.

    A part is the note under a heading of its path; parts joined by ``separator`` are the bundle. Sorted by path it can
    be written as one file or many without going through the driver. Null texts are left out.
    """
    parts = notes.where("text is not null").select("note_path", F.concat(F.lit("# "), "note_path", F.lit("\n\n"), "text").alias("part"))
    sized = running_bundle(parts.select("note_path", F.concat("part", F.lit(separator)).alias("text")), cap_bytes + len(separator.encode()))
    return parts.join(sized.select("note_path"), "note_path", "left_semi")


def list_folder(files: DataFrame, folder: str = "") -> DataFrame:
    """(kind, name): folders and Markdown notes directly below ``folder``, each once; hidden ones are left out."""
    start = folder.rstrip("/") + "/" if folder else ""
    below = files.where(F.startswith("path", F.lit(start))).select(F.substring("path", len(start) + 1, 1 << 20).alias("rest"))
    named = below.select(F.when(F.contains("rest", F.lit("/")), "folder").when(F.lower("rest").endswith(".md"), "note").alias("kind"), F.split_part("rest", F.lit("/"), F.lit(1)).alias("name"))
    return named.where(F.col("kind").isNotNull() & ~F.startswith("name", F.lit("."))).distinct()


def extension(path: str = "path") -> Column:
    """Lower-cased extension of a path's last part, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)\z", 1))


def find_by_extension(files: DataFrame, extensions: list[str], folder: str = "") -> DataFrame:
    """(path, bytes, ext) of files below ``folder`` with one of ``extensions``, dots and case aside."""
    wanted = [e.lower().removeprefix(".") for e in extensions]
    return files.where(F.startswith("path", F.lit(folder))).select("path", "bytes", extension().alias("ext")).where(F.col("ext").isin(wanted))


def list_attachments(files: DataFrame, folder: str = "") -> DataFrame:
    """(path, bytes, ext) of files below ``folder`` that are no Markdown."""
    return files.where(F.startswith("path", F.lit(folder))).select("path", "bytes", extension().alias("ext")).where("ext <> 'md'")


def find_by_size(files: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """(path, bytes) of files of ``low`` to ``high`` bytes, both included."""
    found = files.where(F.col("bytes") >= low)
    return (found if high is None else found.where(F.col("bytes") <= high)).select("path", "bytes")


def frontmatter_date(text: str = "text") -> Column:
    """The frontmatter's ``date`` as it stands, null where it is missing or no date."""
    raw = T.frontmatter(text)["date"]
    return F.when(F.try_to_timestamp(raw).isNotNull(), raw)
