"""Link graph: resolution, rankings, anti-joins, cycles, communities, mentions."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.scratch import materialise

#: Characters of titles that go to all tasks as an automaton, of less than 100 bytes a character.
MAX_TITLE_CHARS = 4_000_000
#: Rounds that have to add this much to modularity, or a level of communities ends.
SETTLED, SETTLED_GAIN = 4, 0.003
#: Starts of titles that go to all tasks; more meet the places in lines by a shuffle.
MAX_STARTS = 500_000


def outbound(notes: DataFrame) -> DataFrame:
    """(note_path, targets): each note's distinct link targets in order of first appearance."""
    return notes.select("note_path", T.wikilinks("text").alias("targets"))


def link_rows(links: DataFrame) -> DataFrame:
    """(src, pos, target) with pos from 0."""
    return links.select(F.col("note_path").alias("src"), F.posexplode("targets").alias("pos", "target"))


def keys(notes: DataFrame, paths: bool = True) -> DataFrame:
    """(key, note_path): what a lower-cased target may equal; of notes with the same key the first path in order.

    Keys are base names and, with ``paths``, whole paths and whole paths without .md.
    """
    path = F.lower("note_path")
    every = F.array(T.basename("note_path"), path, F.regexp_replace(path, r"\.md\z", "")) if paths else F.array(T.basename("note_path"))
    return notes.select(F.explode(F.array_distinct(every)).alias("key"), "note_path").groupBy("key").agg(F.min("note_path").alias("note_path"))


def resolve(links: DataFrame, notes: DataFrame, paths: bool = False) -> DataFrame:
    """(src, pos, target, dst): dst is null for targets that no note answers; targets are counted once before the join."""
    return link_rows(links).join(keys(notes, paths).withColumnRenamed("note_path", "dst"), F.lower("target") == F.col("key"), "left").drop("key")


def edges(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(a, b) with a < b: the undirected simple graph of resolved links between different notes."""
    found = resolve(links, notes).where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src")))
    return found.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def orphans(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes that no link reaches; a link to oneself reaches."""
    hit = resolve(links, notes, paths=True).where(F.col("dst").isNotNull()).select(F.col("dst").alias("note_path")).distinct()
    return notes.select("note_path").join(hit, "note_path", "left_anti")


def inbound_ranking(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(note_path, inbound) for all notes, 0 included."""
    hit = resolve(links, notes, paths=True).where(F.col("dst").isNotNull()).groupBy(F.col("dst").alias("note_path")).agg(F.count("*").alias("inbound"))
    return notes.select("note_path").join(hit, "note_path", "left").select("note_path", F.coalesce("inbound", F.lit(0)).cast("long").alias("inbound"))


def link_counts(links: DataFrame) -> DataFrame:
    return links.select("note_path", F.size("targets").cast("long").alias("outbound"))


def broken_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(src, target) of targets that no note answers."""
    return link_rows(links).join(keys(notes), F.lower("target") == F.col("key"), "left_anti").select("src", "target")


def link_graph(links: DataFrame, notes: DataFrame, note_path: str) -> DataFrame:
    """(direction, other): a note's own targets, and the notes that name it by base name or whole path."""
    own = links.where(F.col("note_path") == note_path).select(F.lit("out").alias("direction"), F.explode("targets").alias("other"))
    base, path = note_path.split("/")[-1].removesuffix(".md").lower(), note_path.lower()
    named = F.exists("targets", lambda t: F.lower(t).isin(base, path))
    return own.unionByName(links.where(named).select(F.lit("in").alias("direction"), F.col("note_path").alias("other")))


def mutual_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(a, b) with a < b that link to each other."""
    one = resolve(links, notes).where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))).select("src", "dst").distinct()
    pair = one.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pair.groupBy("a", "b").count().where("count = 2").select("a", "b")


def link_audit(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(target, n, resolved) for every target."""
    return resolve(links, notes, paths=True).groupBy("target").agg(F.count("*").alias("n"), F.max(F.col("dst").isNotNull()).alias("resolved"))


def completions(notes: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    low = prefix.lower()
    return notes.where(F.startswith(F.lower("note_path"), F.lit(low)) | F.startswith(T.basename("note_path"), F.lit(low))).select("note_path").orderBy("note_path").limit(limit)


def index_export(notes: DataFrame) -> DataFrame:
    """(note_path, targets, tags) with distinct sorted tags."""
    return notes.select("note_path", T.wikilinks("text").alias("targets"), F.array_sort(F.array_distinct(T.tags("text"))).alias("tags"))


def unlinked_mentions(notes: DataFrame, titles: DataFrame, min_chars: int = 4, keep_code: bool = False) -> DataFrame:
    """(src, line, mention): titles that stand as whole words in a line without being linked, each once a line.

    ``titles`` (title) may have any number of words. They are counted first: up to MAX_TITLE_CHARS characters go to all
    tasks as an automaton that finds all of them in one pass over a note, in its row and without a shuffle; more meet the
    lines by their first words. Titles are compared without case, as words divided by single spaces; wiki links, Markdown
    links and code between triple backticks are taken out first, and inline code unless ``keep_code``.
    Null texts have no lines; titles of more than 256 characters are titles as well; rows of one path are told apart.
    """
    words = T.all_groups(F.lower("title"), r"[\p{L}\p{N}_]+", 0)
    asked = titles.where(F.char_length("title") >= min_chars).select(words.alias("t")).where(F.size("t") > 0)
    asked = materialise(asked.select(F.array_join("t", " ").alias("mention"), F.array_join(F.slice("t", 1, 2), " ").alias("start"), F.size("t").alias("n")).distinct())
    if (asked.agg(F.sum(F.char_length("mention") + 2)).first()[0] or 0) > MAX_TITLE_CHARS:
        return _mentions_by_start(notes, asked, keep_code)
    shared = notes.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r.mention for r in asked.select("mention").collect()]))
    own = F.transform(T.lines("text"), lambda x: F.array_join(_line_words(x, keep_code), " "))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(*shared.value)
        for batch in batches:
            src, line, mention = [], [], []
            for at, lines in enumerate(batch.column("lines").to_pylist() if len(automaton) else ()):
                if not lines:
                    continue
                whole = " " + " \n ".join(lines) + " "
                ends = np.cumsum([len(x) + 3 for x in lines])  # of each line and what divides it from the next
                hits = {(int(np.searchsorted(ends, end, side="right")), title) for end, title in automaton.iter(whole)}
                for i, title in sorted(hits):
                    src.append(at)
                    line.append(i + 1)
                    mention.append(title)
            yield pa.RecordBatch.from_arrays([batch.column("src").take(pa.array(src, pa.int32())), pa.array(line, pa.int64()), pa.array(mention, pa.string())], names=["src", "line", "mention"])

    return notes.select(F.col("note_path").alias("src"), own.alias("lines")).mapInArrow(find, "src string, line long, mention string")


@lru_cache(maxsize=2)
def _built(key: str, titles: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for title in titles:
        automaton.add_word(f" {title} ", title)
    if titles:
        automaton.make_automaton()
    return automaton


def _automaton(key: str, titles: list[str]) -> ahocorasick.Automaton:
    """An automaton over titles with a blank on both sides; a worker builds it once."""
    return _built(key, tuple(titles))


def _line_words(line: Column, keep_code: bool) -> Column:
    """Lower-case words of a line without its links and code."""
    bare = F.regexp_replace(line, r"```.*?```|\[\[[^\]]*\]\]|\[[^\]]*\]\([^)]*\)", "")
    bare = bare if keep_code else F.regexp_replace(bare, r"`[^`]*`", " ")
    return T.all_groups(F.lower(bare), r"[\p{L}\p{N}_]+", 0)


def _mentions_by_start(notes: DataFrame, asked: DataFrame, keep_code: bool) -> DataFrame:
    """Mentions for any number of titles (mention, start, n).

    Lines meet the first two words of titles, or the only one, which tell the lengths that are worth a try at that
    place; word n-grams of these lengths meet whole titles by equality.
    """
    lines = notes.select(F.col("note_path").alias("src"), F.posexplode(T.lines("text")).alias("pos", "content"))
    # notes of the same path are told apart by their lines
    lines = lines.select("src", (F.col("pos") + 1).cast("long").alias("line"), F.xxhash64("content").alias("h"), "content")
    tokens = lines.select("src", "line", "h", _line_words(F.col("content"), keep_code).alias("w"))
    # hashes of starts only suggest a try
    starts = asked.groupBy(F.xxhash64("start").alias("start")).agg(F.collect_set("n").alias("ns"))
    starts = F.broadcast(starts) if starts.limit(MAX_STARTS + 1).count() <= MAX_STARTS else starts
    pairs = F.transform("w", lambda x, i: F.struct(i.alias("i"), F.array(F.xxhash64(x), F.xxhash64(F.concat(x, F.lit(" "), F.get("w", i + 1)))).alias("starts")))
    places = tokens.select("src", "line", "h", F.explode(pairs).alias("p")).select("src", "line", "h", F.col("p.i").alias("i"), F.explode("p.starts").alias("start"))
    tries = places.join(starts, "start").groupBy("src", "line", "h").agg(F.collect_set(F.struct("i", "ns")).alias("tries"))
    fit = F.transform("tries", lambda x: F.transform(F.filter(x["ns"], lambda n: x["i"] + n <= F.size("w")), lambda n: F.array_join(F.slice("w", x["i"] + 1, n), " ")))
    tries = tries.select(F.col("src").alias("_src"), F.col("line").alias("_line"), F.col("h").alias("_h"), "tries")
    lines = lines.join(tries, F.col("src").eqNullSafe(F.col("_src")) & (F.col("line") == F.col("_line")) & (F.col("h") == F.col("_h"))).withColumn("w", _line_words(F.col("content"), keep_code))  # words once more, of these lines alone
    grams = lines.select("src", "line", F.explode(F.array_distinct(F.flatten(fit))).alias("mention"))
    return grams.join(asked.select("mention"), "mention").select("src", "line", "mention")


def communities(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(note_path, community): groups of notes with more links inside than between, named by their least note.

    Levels of label moves by modularity gain: on each level nodes move until they have settled, then every group
    becomes one node, links between groups are summed, and the groups move in turn, until a level moves nothing. Notes
    without links stay alone. A round is one join and two aggregations over edges, and its labels are written.
    """
    pairs = edges(links, notes)
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    named = materialise(both.groupBy(F.col("a").alias("name")).agg(F.count("*").alias("d")).withColumn("n", F.monotonically_increasing_id()))
    of = lambda side: named.select(F.col("name").alias(side), F.col("n").alias(f"_{side}"))
    graph = materialise(both.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.lit(1).cast("long").alias("w")))
    nodes, group = named.select("n", "d"), named.select("name", F.col("n").alias("label"))
    total = nodes.agg(F.sum("d")).first()[0] or 1
    while (labels := _settled(graph, nodes, total)) is not None:
        told = labels.select(F.col("n").alias("_n"), F.col("label").alias("_label"))
        group = materialise(group.join(told, F.col("label") == F.col("_n")).select("name", F.col("_label").alias("label")))
        end = lambda side: labels.select(F.col("n").alias(side), F.col("label").alias(f"_{side}"))  # noqa: E731, B023
        between = graph.join(end("a"), "a").join(end("b"), "b").where("_a <> _b")
        graph = materialise(between.groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w")))
        nodes = materialise(labels.groupBy(F.col("label").alias("n")).agg(F.sum("d").alias("d")))
    least = group.join(group.groupBy("label").agg(F.min("name").alias("community")), "label")
    return notes.select("note_path").join(least.select(F.col("name").alias("note_path"), "community"), "note_path", "left").select("note_path", F.coalesce("community", "note_path").alias("community"))


def _settled(graph: DataFrame, nodes: DataFrame, total: int) -> DataFrame | None:
    """(n, label, d) when nodes of ``graph`` (a, b, w: both ways) have settled; None if none has moved.

    A node's gain is its links to a label's nodes minus what its degree and theirs let expect. All nodes look at the
    same labels, so in a round only half of them may move, and after two rounds nodes go from one label to another only
    if that comes later in the round's order of labels, by hash, so that labels do not swap nodes; of two nodes that are alone only the one with the greater label goes to the other. It
    ends when no node would gain by another label, or when SETTLED rounds together have added less than SETTLED_GAIN to
    modularity, as the last few nodes can be in each other's way for long; the next level moves them with their groups.
    """
    labels, moved, known = nodes.select("n", F.col("n").alias("label"), "d"), 0, []
    for r in count():
        groups = labels.groupBy("label").agg(F.sum("d").alias("whole"), F.count("*").alias("size"))
        near = graph.join(labels.select(F.col("n").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("w").alias("k"))
        own = labels.select(F.col("n").alias("a"), "label", F.lit(0).cast("long").alias("k"))
        choice = near.unionByName(own).groupBy("a", "label").agg(F.sum("k").alias("k")).join(groups, "label")
        choice = choice.join(labels.select(F.col("n").alias("a"), F.col("label").alias("own"), "d"), "a")
        mine = F.col("label") == F.col("own")
        gain = F.round(F.col("k") - F.col("d") * (F.col("whole") - F.when(mine, F.col("d")).otherwise(0)) / total, 9)
        best = choice.groupBy("a", "own", "d").agg(F.min(F.struct((-gain).alias("g"), "label", "size")).alias("best"), F.max(F.when(mine, gain)).alias("stay"), F.max(F.when(mine, F.col("size"))).alias("own_size"), F.max(F.when(mine, F.col("k"))).alias("own_k"))
        alone = (F.col("own_size") == 1) & (F.col("best.size") == 1) & (F.col("best.label") > F.col("own"))
        better = (-F.col("best.g") > F.col("stay")) & ~alone
        turn = lambda x: F.xxhash64(x, F.lit(r))  # noqa: E731, B023
        moves = better & (turn("a") % 2 == 0 if r < 2 else turn("own") > turn("best.label"))
        labels = materialise(best.select(F.col("a").alias("n"), F.when(moves, F.col("best.label")).otherwise(F.col("own")).alias("label"), "d", better.alias("better"), moves.alias("moves"), "own", "own_k"))
        told = labels.groupBy("own").agg(F.count_if("better").alias("better"), F.count_if("moves").alias("moves"), F.sum("own_k").alias("inside"), (F.sum("d") / total).alias("x"))
        told = told.agg(F.sum("better").alias("better"), F.sum("moves").alias("moves"), (F.sum("inside") / total - F.sum(F.col("x") * F.col("x"))).alias("q")).first()
        known.append(told["q"] or 0)
        moved += told["moves"] or 0
        if not told["better"] or (r > SETTLED and known[-1] - known[-1 - SETTLED] < SETTLED_GAIN):
            return labels.select("n", "label", "d") if moved else None


def note_meta(notes: DataFrame) -> DataFrame:
    """One row for each row: words, chars, n_lines, bytes, headings, tags (distinct), frontmatter, outbound, inbound.

    Everything about the note itself is one projection; only the inbound count is joined. A null text has null counts.
    Rows of one path each count their own text and have the path's inbound links; rows without a path have none.
    """
    every = T.lines("text")
    own = notes.select(
        "note_path",
        T.n_words("text").cast("long").alias("words"),
        F.char_length("text").cast("long").alias("chars"),
        F.size(every).cast("long").alias("n_lines"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.size(F.filter(every, T.is_heading)).cast("long").alias("headings"),
        F.array_distinct(T.tags("text")).alias("tags"),
        T.frontmatter("text").alias("frontmatter"),
        T.wikilinks("text").alias("targets"),
    )
    own = materialise(own)  # texts are read once
    hit = resolve(own, own, paths=True).where(F.col("dst").isNotNull()).groupBy(F.col("dst").alias("note_path")).agg(F.count("*").alias("inbound"))
    whole = own.join(hit, "note_path", "left")
    return whole.select(*own.columns[:-1], F.size("targets").cast("long").alias("outbound"), F.coalesce("inbound", F.lit(0)).cast("long").alias("inbound"))


def doctor(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row on the state of all notes: notes, chunks, orphans, broken_links, top_tag (ties by name), avg_words (rounded half up)."""
    links = outbound(notes)
    tags = notes.select(F.explode(T.tags("text")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    parts = [
        notes.agg(F.count("*").alias("notes"), F.floor(F.avg(T.n_words("text")) + 0.5).cast("long").alias("avg_words")),
        chunks.agg(F.count("*").alias("chunks")),
        orphans(links, notes).agg(F.count("*").alias("orphans")),
        broken_links(links, notes).agg(F.count("*").alias("broken_links")),
        tags.agg(F.min(F.struct((-F.col("n")).alias("n"), "tag"))["tag"].alias("top_tag")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.crossJoin(part)  # one row each
    return whole
