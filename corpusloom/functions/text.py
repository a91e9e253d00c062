"""Column expressions over Markdown text; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results must agree on. \z, because $ would also match before a last newline.
HEADING = r"^(#{1,6})\s+(.+?)\s*\z"
TAG = r"(?m)(?:^|\s)#([A-Za-z0-9][\w/-]*)"
TASK = r"^\s*-\s+\[(.)\]\s+(.+?)\s*\z"
ANY_LINK = r"!?\[\[([^\]]+?)\]\]"
PLAIN_LINK = r"(?<!!)\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"
EMBED = r"!\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"
MD_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
FRONTMATTER = r"^---\n[\s\S]*?\n---\n?"
ATTACHMENT_EMBED = r"(?i)!\[\[[^\]|#]+\.(?:png|jpe?g|gif|webp|svg|bmp|pdf|mp3|mp4|mov|webm)"
ATTACHMENT_IMAGE = r"(?i)!\[[^\]]*\]\([^)]+\.(?:png|jpe?g|gif|webp|svg|bmp|pdf|mp3|mp4|mov|webm)\)"
INLINE_FIELD = r"(?:^|[\s\-*])([A-Za-z][\w-]*)::\s*([^\n]+?)(?=\s+[A-Za-z][\w-]*::|\z)"

# Words too common to rank.
STOPWORDS = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use "
    "that with from this they have were said been than them like into your time some more very what just take know come well may will"
).split()
# The two lexicons of the conviction score.
HEDGES = ("maybe", "perhaps", "might", "could", "seems", "appears", "possibly", "somewhat", "tentatively", "arguably", "roughly", "apparently", "probably", "kind of")
ASSERTIONS = ("definitely", "clearly", "obviously", "certainly", "must", "always", "never", "only", "every", "essential", "useless", "impossible")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines(text: Column | str) -> Column:
    """Lines without their ends; a text always has one at least."""
    return F.split(_c(text), r"\r?\n")


def words(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(r"\S+"))


def all_groups(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(group))


def tags(text: Column | str) -> Column:
    """All #tags in order, repeats included."""
    return all_groups(text, TAG)


def wikilinks(text: Column | str) -> Column:
    """Distinct trimmed targets of [[target|alias]], [[target#part]] and embeds, in order of first appearance."""
    bare = F.transform(all_groups(text, ANY_LINK), lambda x: F.trim(F.split_part(F.split_part(x, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1))))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def heading_depth(line: Column) -> Column:
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, HEADING, 2))


def has_frontmatter(text: Column | str) -> Column:
    return F.startswith(_c(text), F.lit("---\n"))


def body(text: Column | str) -> Column:
    """The text behind a leading frontmatter block."""
    return F.regexp_replace(_c(text), FRONTMATTER, "")


def frontmatter(text: Column | str) -> Column:
    """Flat ``key: value`` lines of a leading block, as a map of strings (the last of equal keys wins)."""
    block = F.regexp_extract(_c(text), r"^---\n([\s\S]*?)\n---(?:\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    # a later key replaces an earlier one: entries are kept when no later line has the same key
    key = lambda x: F.regexp_extract(x, r"^([A-Za-z_][\w-]*)\s*:", 1)
    keys = F.transform(pairs, key)
    last = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), key(x)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(key(x), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[A-Za-z_][\w-]*\s*:", "")), r"^([\"'])(.*)\1\z", "$2"))))


def conviction(text: Column | str, hedges: tuple[str, ...] = HEDGES, assertions: tuple[str, ...] = ASSERTIONS) -> Column:
    """(assertions - hedges) / words; words are runs of a-z and apostrophes; no words give 0."""
    low = F.lower(_c(text))
    total = F.regexp_count(low, F.lit(r"[a-z']+"))
    sign = lambda x: F.when(x.isin(*assertions), 1).otherwise(0) - F.when(x.isin(*hedges), 1).otherwise(0)
    balance = F.aggregate(terms_in(low, (*hedges, *assertions)), F.lit(0), lambda s, x: s + sign(x))
    return F.when(total > 0, balance / total).otherwise(F.lit(0.0))


def terms_in(low: Column, terms: tuple[str, ...]) -> Column:
    """All of the ``terms`` that stand in a lower-cased text as whole words, in one pass, repeats included."""
    return F.regexp_extract_all(low, F.lit(rf"(?<!\w)({'|'.join(sorted(set(terms)))})(?!\w)"), F.lit(1))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\w\s-]", ""), r"\s+", "-")


def basename(path: Column | str) -> Column:
    """Lower-cased last part of a path without .md."""
    return F.lower(F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"(?i)\.md\z", ""))
