"""Notes to chunks with byte offsets: one row for the whole body and one for each block."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "note_path string, ord int, granularity string, text string, byte_start int, byte_end int, heading_path array<string>"
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*(?:[ \t]#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
LIST = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]|$)")
HTML = re.compile(r" {0,3}<(?:/?[A-Za-z][\w-]*(?:[\s/>]|$)|!--|[?!])")
RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: Kinds that never share a chunk with others.
ALONE = frozenset(("code", "table", "break", "html"))


def body_start(text: str) -> int:
    """Where the body begins behind a leading frontmatter block."""
    m = re.match(r"---[ \t]*\r?\n(?:[\s\S]*?\r?\n)?---[ \t]*(?:\r?\n|$)", text)
    return m.end() if m else 0


def blocks(lines: list[str]) -> Iterator[tuple[str, int, int, str]]:
    """(kind, first line, end line, title) of top-level blocks; title is a heading's depth and text."""
    i, n = 0, len(lines)
    blank = lambda k: not lines[k].strip()
    while i < n:
        line, start = lines[i], i
        if blank(i):
            i += 1
        elif m := FENCE.match(line):
            i += 1
            while i < n and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[i]):
                i += 1
            i = min(n, i + 1)
            yield "code", start, i, ""
        elif m := ATX.match(line):
            i += 1
            yield "heading", start, i, f"{len(m[1])} {(m[2] or '').strip()}"
        elif BREAK.match(line):
            i += 1
            yield "break", start, i, ""
        elif re.match(r"(?: {4}|\t)", line):
            while i < n and (blank(i) or re.match(r"(?: {4}|\t)", lines[i])):
                i += 1
            while blank(i - 1):
                i -= 1
            yield "code", start, i, ""
        elif HTML.match(line):
            while i < n and not blank(i):
                i += 1
            yield "html", start, i, ""
        elif i + 1 < n and "|" in line and RULE.match(lines[i + 1]) and "-" in lines[i + 1]:
            while i < n and not blank(i) and ("|" in lines[i] or i < start + 2):
                i += 1
            yield "table", start, i, ""
        elif line.lstrip().startswith(">"):
            while i < n and not blank(i) and (lines[i].lstrip().startswith(">") or not _opens(lines, i)):
                i += 1
            yield "quote", start, i, ""
        elif LIST.match(line):
            i += 1
            while i < n and (not blank(i) and (not _opens(lines, i) or LIST.match(lines[i])) or blank(i) and i + 1 < n and (LIST.match(lines[i + 1]) or re.match(r" {2,}\S|\t", lines[i + 1]))):
                i += 1
            yield "list", start, i, ""
        else:
            i += 1
            while i < n and not blank(i) and not SETEXT.match(lines[i]) and not _opens(lines, i):
                i += 1
            if i < n and (m := SETEXT.match(lines[i])):
                i += 1
                yield "heading", start, i, f"{1 if m[1][0] == '=' else 2} {' '.join(x.strip() for x in lines[start : i - 1])}"
            else:
                yield "paragraph", start, i, ""


def _opens(lines: list[str], i: int) -> bool:
    """Whether a line ends a paragraph by starting another block."""
    x = lines[i]
    return bool(FENCE.match(x) or ATX.match(x) or BREAK.match(x) or x.lstrip().startswith(">") or LIST.match(x) or HTML.match(x))


def count_tokens(text: str) -> int:
    """Stand-in for a subword count: words and marks."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def chunk_note(text: str, budget: int = 512) -> list[tuple[str, str, int, int, list[str]]]:
    """(granularity, text, byte_start, byte_end, heading_path): the body, then its blocks, offsets in bytes of the note.

    Headings only set the path (depths that were skipped are empty). Code, tables, rules and HTML stand alone; other
    blocks of one path are joined while they hold ``budget`` tokens at most; 0 keeps every block apart.
    """
    begin = body_start(text)
    body = text[begin:]
    at = len(text[:begin].encode())
    raw = body.encode()
    out = [("note", body, at, at + len(raw), [])]
    lines = body.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.encode()) + 1)
    path: list[str] = []
    held: list | None = None  # [first byte, end byte, tokens, path]

    def flush() -> None:
        nonlocal held
        if held:
            out.append(("block", raw[held[0] : held[1]].decode(), held[0] + at, held[1] + at, list(held[3])))
        held = None

    for kind, first, end, title in blocks([x.removesuffix("\r") for x in lines]):
        if kind == "heading":
            flush()
            depth, name = title.split(" ", 1)
            path = [*path[: int(depth) - 1], *[""] * (int(depth) - 1 - len(path)), name]
            continue
        indent = 0 if kind in ("code", "html") else len(lines[first]) - len(lines[first].lstrip(" \t"))
        a = starts[first] + indent
        b = starts[end - 1] + len(lines[end - 1].removesuffix("\r").encode())
        n = count_tokens(raw[a:b].decode())
        if kind in ALONE or held is None or held[3] != path or held[2] + n > budget:
            flush()
            held = [a, b, n, list(path)]
            if kind in ALONE:
                flush()
        else:
            held[1], held[2] = b, held[2] + n
    flush()
    return out


def chunk_notes(notes: DataFrame, budget: int = 512) -> DataFrame:
    """SCHEMA rows for every note; null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [(p, i, *c) for p, t in zip(part.column("note_path").to_pylist(), part.column("text").to_pylist(), strict=True) for i, c in enumerate(chunk_note(t or "", budget))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])  # noqa: B905

    return notes.select("note_path", "text").mapInArrow(run, SCHEMA)
