import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking
from corpusloom.operators import corpus as C
from corpusloom.operators import extract as X
from corpusloom.operators import links as L
from corpusloom.operators import rewrite as R
from corpusloom.sources import notes as S
from corpusloom.sources import snapshot

NOTE = """---
title: "A day"
tags: [x, y]
---
# Top #one
intro words here
## Sub
- [ ] open task
- [x] done task
> quote a
> quote b
text [[Other|alias]] and ![[pic.png]] and [md](b.md) #two/three
key:: value
```py
code()
```
| a | b |
|---|---|
| 1 | 2 |
see https://x.org/y and https://x.org/y ^blk1
"""


def _df(spark, *rows):
    return spark.createDataFrame(list(rows), "note_path string, text string")


@pytest.fixture(scope="module")
def one(spark):
    return _df(spark, ("f/a.md", NOTE))


def _text(df):
    return df.first().text


def test_extraction(one):
    fm = one.select(T.frontmatter("text").alias("f")).first().f
    assert fm == {"title": "A day", "tags": "[x, y]"}
    assert {(r.tag, r.n) for r in C.tag_counts(one).collect()} == {("one", 1), ("two/three", 1)}
    assert [(r.depth, r.title) for r in X.outline(one).orderBy("line").collect()] == [(1, "Top #one"), (2, "Sub")]
    for r in X.line_offsets(one).collect():
        assert NOTE.encode()[r.byte_start :].startswith(r.content.encode())
    assert X.quotes(one).first().quote == "quote a\nquote b"
    assert [(r.lang, r.code) for r in X.code_blocks(one).collect()] == [("py", "code()")]
    assert X.tables(one).first().cells == [["a", "b"], ["1", "2"]]
    assert X.external_urls(one).first().urls == ["https://x.org/y"]
    assert X.block_ids(one).first().id == "blk1"
    links = X.all_links(one).first()
    assert (links.wikilinks, links.md_links, links.embeds) == (["Other"], ["b.md"], ["pic.png"])
    assert one.select(T.wikilinks("text")).first()[0] == ["Other", "pic.png"]
    assert [(r.key, r.value) for r in X.inline_fields(one).collect()] == [("key", "value")]
    assert X.partial(one, "Sub").first().body.startswith("## Sub\n- [ ] open task")
    assert X.table_of_contents(one).first().toc == "- [Top #one](#top-one)\n  - [Sub](#sub)"
    assert X.first_paragraph(one).first().paragraph == ""
    assert {(r.status, r.task) for r in C.find_tasks(one).collect()} == {("open", "open task"), ("done", "done task")}
    s = X.note_status(one).first()
    assert (s.headings, s.tasks, s.tags, s.links) == (2, 2, 2, 1)
    assert X.excerpt(one, 2, 4096).first().truncated and X.read_slice(one, 0, 3).first().part == "---"
    assert X.sections(one).count() == 3


def test_grep_guards_and_dataview(spark, one):
    with pytest.raises(ValueError):
        C.grep(one, "(a+)+", regex=True)
    hit = C.grep(one, "QUOTE A", ignore_case=True, context=1).first()
    assert (hit.before, hit.after) == ("- [x] done task", "> quote b")
    d = _df(spark, ("a", "x\n```dataview\nLIST\nFROM y\n"))
    assert X.dataview_blocks(d).first().query == "LIST\nFROM y\n"


def test_rewrites(spark, one):
    assert "title: B\n" in _text(R.set_property(one, "title", "B")) and "new: 1\n---\n# Top" in _text(R.set_property(one, "new", "1"))
    assert _text(R.set_property(_df(spark, ("a", "x")), "k", "v")) == "---\nk: v\n---\nx"
    assert "title" not in _text(R.unset_property(one, "title"))
    assert "## Below" in _text(R.rename_heading(one, "Sub", "Below"))
    assert "- [x] open task" in _text(R.toggle_tasks(one, C.find_tasks(one, "open")))
    assert "[alias](Other.md)" in _text(R.wiki_to_md(one)) and "![[pic.png]]" in _text(R.wiki_to_md(one))
    assert "[[b|md]]" in _text(R.md_to_wiki(one))
    assert "[[New|alias]]" in _text(R.rename_link_target(one, "Other", "New"))
    assert _text(R.add_tag(one, "one")) == NOTE and _text(R.add_tag(one, "z")).endswith("\n\n#z\n")
    assert "#two/three" not in _text(R.remove_tag(one, "two/three"))
    assert _text(R.patch_section(one, None, "Sub", "BODY")).endswith("## Sub\nBODY")
    assert "## Sub\n\nIN\n\n- [ ]" in _text(R.insert_after_heading(one, None, "Sub", "IN"))
    assert _text(R.replace_lines(_df(spark, ("a", "1\n2\n3\n4")), None, 2, 3, "x")) == "1\nx\n4"
    assert [r.note_path.split("/")[-1] for r in R.split_notes(one, 2).collect()] == ["Sub.md"]
    two = _df(spark, ("f/a.md", "A"), ("f/b.md", "B"), ("g/c.md", "C"))
    pairs = spark.createDataFrame([("m.md", 1, "f/b.md"), ("m.md", 0, "f/a.md"), ("m.md", 2, "no.md")], "target string, pos int, note_path string")
    assert _text(R.merge_notes(two, pairs)) == "A\n\nB"
    assert {r.note_path for r in R.move(two, "f", "h").collect()} == {"h/a.md", "h/b.md", "g/c.md"}
    stay, gone = R.trash(two, two.where("note_path = 'f/a.md'").select("note_path"), "t1")
    assert stay.count() == 2 and _text(R.restore(gone.unionByName(gone.withColumn("stamp", F.lit("t2")).withColumn("text", F.lit("A2"))))) == "A2"
    assert tuple(R.trash_summary(gone).first()) == (1, 1)
    assert {r.note_path for r in R.archive(two, ["g/c.md"], "2024-01-01").collect()} == {"f/a.md", "f/b.md", "Archive/c.md"}
    copied = R.copy_notes(two, spark.createDataFrame([("f/a.md", "f/b.md"), ("f/a.md", "z.md")], "note_path string, target string"))
    assert {(r.note_path, r.text) for r in copied.collect()} == {("f/a.md", "A"), ("f/b.md", "B"), ("g/c.md", "C"), ("z.md", "A")}
    assert [r.ok for r in R.rename_many(two, spark.createDataFrame([("f/a.md", "n.md"), ("no", "q"), ("f/a.md", "f/b.md")], "note_path string, target string")).orderBy("target").collect()] == [False, True, False]
    folders = spark.createDataFrame([("f",), ("e",)], "path string")
    assert [r.path for r in R.empty_folders(folders, two.select(F.col("note_path").alias("path"))).collect()] == ["e"]
    assert R.create(two, _df(spark, ("f/a.md", "new"))).where("text = 'new'").count() == 0
    assert R.create(two, _df(spark, ("f/a.md", "new")), overwrite=True).where("text = 'new'").count() == 1
    assert R.tag_notes(two, "q", two.select("note_path").limit(2)).count() == 2
    row = spark.range(1).select(R.fill_template(F.lit("{{a}} {{ b }} {{c}}"), {"a": F.lit("1"), "b": F.lit("2")}).alias("t"), R.periodic_stem(F.lit("2024-12-30").cast("date"), "weekly").alias("w")).first()
    assert (row.t, row.w) == ("1 2 {{c}}", "2025-W01")
    assert _text(R.append_periodic(_df(spark), spark.createDataFrame([("2024-01-02", 2, "b"), ("2024-01-01", 1, "a")], "day string, pos int, entry string").withColumn("day", F.col("day").cast("date")), "monthly")) == "a\nb"
    assert _text(R.append(one, ["f/a.md"], "END")).endswith("END") and _text(R.prepend(one, None, "S")).startswith("S---")


SAMPLES = ["plain text\n\nsecond", "---\na: 1\n---\n# Ünï\n\nç日本😀 text\n\nmore\n", "# A\n```js\nx\n\n# no\n```\nend", "| a | b |\n|---|---|\n| 1 | 2 |\n\nafter", "### deep\n\np1\n\n# top\n\np2\n\n- l1\n- l2\n\n> q\nlazy\n", "😀\r\n\r\n日本\r\n", "Title\n=====\nbody\n***\n<div>\nx\n</div>\n\n    code"]


@pytest.mark.parametrize("text", SAMPLES)
@pytest.mark.parametrize("budget", [0, 512])
def test_offsets_hold_the_text(text, budget):
    raw = text.encode()
    for kind, part, a, b, _ in chunking.chunk_note(text, budget):
        assert raw[a:b].decode() == part and (kind == "note" or a < b)


def test_chunk_rules(spark):
    got = chunking.chunk_note("### deep\n\np1\n\n# top\n\np2\n\np3\n\n```\nx\n```\n\np4", 512)
    assert [(c[1], c[4]) for c in got[1:]] == [("p1", ["", "", "deep"]), ("p2\n\np3", ["top"]), ("```\nx\n```", ["top"]), ("p4", ["top"])]
    assert len(chunking.chunk_note("a\n\nb\n\nc", 0)) == 4
    assert chunking.chunk_notes(_df(spark, ("a", None), ("b", "x"))).count() == 3


def test_links(spark):
    notes = _df(spark, ("Habits.md", "[[Systems]] [[self]]"), ("sub/Systems.md", "[[habits]] [[Missing]]"), ("c.md", "[[sub/Systems]] [[c]]"), ("d.md", ""))
    links = L.outbound(notes)
    assert [(r.a, r.b) for r in L.edges(links, notes).collect()] == [("Habits.md", "sub/Systems.md")]
    assert [(r.a, r.b) for r in L.mutual_links(links, notes).collect()] == [("Habits.md", "sub/Systems.md")]
    assert {r.note_path for r in L.orphans(links, notes).collect()} == {"d.md"}
    assert {(r.src, r.target) for r in L.broken_links(links, notes).collect()} == {("Habits.md", "self"), ("sub/Systems.md", "Missing")}
    assert {r.note_path: r.inbound for r in L.inbound_ranking(links, notes).collect()} == {"Habits.md": 1, "sub/Systems.md": 2, "c.md": 1, "d.md": 0}
    titles = spark.createDataFrame([("big idea",), ("abc",)], "title string")
    text = _df(spark, ("x.md", "The Big Idea is here\n[[big idea]] linked\n`big idea`"))
    assert [(r.line, r.mention) for r in L.unlinked_mentions(text, titles).collect()] == [(1, "big idea")]
    ref = C.unreferenced(_df(spark, ("a", "![[p.png]] [x](img/q.png)")), spark.createDataFrame([("z/p.png",), ("img/q.png",), ("r.png",)], "path string"))
    assert [r.path for r in ref.collect()] == ["r.png"]


def test_communities(spark):
    notes = _df(spark, ("a.md", "[[b]] [[c]]"), ("b.md", "[[c]]"), ("c.md", ""), ("x.md", "[[y]]"), ("y.md", ""), ("z.md", ""))
    got = {r.note_path: r.community for r in L.communities(L.outbound(notes), notes).collect()}
    assert got["a.md"] == got["b.md"] == got["c.md"] != got["x.md"] == got["y.md"] != got["z.md"] and len(got) == 6
    alone = _df(spark, ("p.md", ""), ("q.md", ""))
    assert {r.community for r in L.communities(L.outbound(alone), alone).collect()} == {"p.md", "q.md"}


def test_files_and_snapshot(spark, tmp_path):
    (tmp_path / "v/sub/.hid").mkdir(parents=True)
    for name, text in (("v/a.md", "A"), ("v/sub/b.MD", "B"), ("v/sub/.hid/c.md", "C"), ("v/x.png", "P")):
        (tmp_path / name).write_text(text)
    got = S.walk_notes(spark, str(tmp_path / "v"))
    assert {(r.note_path, r.text) for r in got.collect()} == {("a.md", "A"), ("sub/b.MD", "B")}
    now = snapshot.content_sha(got.select("note_path", "text"))
    prior = snapshot.content_sha(_df(spark, ("a.md", "A"), ("gone.md", "G"), ("sub/b.MD", "old")))
    diff = snapshot.restore_diff(now, prior)
    assert {r.note_path: r.action for r in diff.collect()} == {"a.md": "restored", "gone.md": "pruned", "sub/b.MD": "rebuilt"}
    stored = chunking.chunk_notes(_df(spark, ("a.md", "A"), ("gone.md", "G"), ("sub/b.MD", "old")))
    fresh = snapshot.refresh(got, stored, diff, chunking.chunk_notes)
    assert {(r.note_path, r.text) for r in fresh.where("granularity = 'note'").collect()} == {("a.md", "A"), ("sub/b.MD", "B")}
    snapshot.write_buckets(fresh, str(tmp_path / "idx"))
    assert snapshot.read_buckets(spark, str(tmp_path / "idx"), "a.md").count() == 2
    assert snapshot.remove_notes(fresh, _df(spark, ("a.md", "")).select("note_path")).where("note_path = 'a.md'").count() == 0


def test_mentions_leave_out_links_but_not_code_if_asked(spark):
    titles = spark.createDataFrame([("alpha beta",)], "title string")
    text = _df(spark, ("x.md", "[alpha beta](b.md)\n`alpha beta`\n```alpha beta```\n[[alpha beta]]\nAlpha, beta"), ("y.md", None))
    assert [(r.line, r.mention) for r in L.unlinked_mentions(text, titles, keep_code=True).orderBy("line").collect()] == [(2, "alpha beta"), (5, "alpha beta")]
    assert [r.line for r in L.unlinked_mentions(text, titles).collect()] == [5]
    long = "word " * 100 + "end"
    assert L.unlinked_mentions(_df(spark, ("z.md", "see " + long)), spark.createDataFrame([(long,)], "title string")).count() == 1


def test_folders_attachments_and_bundles(spark):
    files = spark.createDataFrame([("a/b.md", 5), ("a/c/d.PNG", 9), ("a/.x/e.md", 1), ("f.MD", 2), ("g", 3), (None, 4)], "path string, bytes long")
    assert {tuple(r) for r in C.list_folder(files).collect()} == {("folder", "a"), ("note", "f.MD")}
    assert {tuple(r) for r in C.list_folder(files, "a").collect()} == {("note", "b.md"), ("folder", "c")}
    assert {r.path for r in C.list_attachments(files).collect()} == {"a/c/d.PNG", "g"}
    assert {r.path for r in C.find_by_extension(files, [".png"], "a/").collect()} == {"a/c/d.PNG"}
    assert {r.path for r in C.find_by_size(files, 3, 5).collect()} == {"a/b.md", "g", None}
    notes = _df(spark, ("a/1", "x" * 30), ("a/2", "y" * 30), ("b/1", "z"), ("c", None))
    parts = {r.note_path: r.part for r in C.bundle_parts(notes, 81).collect()}
    assert set(parts) == {"a/1", "a/2"} and len("\n\n---\n\n".join(parts.values())) == 81 and parts["a/1"].startswith("# a/1\n\nxxx")


def test_split_loses_no_section(spark):
    text = "intro\n## A b\none\r\n### in A\ntwo\n##  \n## A b\nthree\n## A b (2)\n##nothead\n## ../..\n## é!\n## .dots.\nlast"
    rows = [("x.md", text), ("f/x.MD", "## A b\nother"), ("f/x.MD", "## A b\nother"), ("n.md", None), ("e.md", "# only"), (None, "## lost"), ("long.md", "## " + "w " * 60)]
    got = R.split_notes(spark.createDataFrame(rows, "note_path string, text string"), 2).collect()
    of = {r.note_path: r.text for r in got if (r.note_path or "").startswith("x-split")}
    assert of == {"x-split/A-b.md": "## A b\none\n### in A\ntwo", "x-split/untitled.md": "##  ", "x-split/A-b (2).md": "## A b\nthree", "x-split/A-b-2.md": "## A b (2)\n##nothead", "x-split/untitled (2).md": "## ../..", "x-split/untitled (3).md": "## é!", "x-split/dots.md": "## .dots.\nlast"}
    assert sum(r.note_path == "f/x-split/A-b.md" for r in got) == 2 and len(got) == len(of) + 4
    assert max(len((r.note_path or "").split("/")[-1]) for r in got) == 83
    assert R.split_notes(spark.createDataFrame([], "note_path string, text string")).count() == 0


def test_note_meta_keeps_rows(spark):
    from corpusloom.operators import links as L

    rows = [("a.md", "# A\n[[b]] [[b]] and [[c]]"), ("b.md", "one two"), ("b.md", "[[a]] #tag"), (None, "[[b]] no path"), ("d.md", None)]
    got = L.note_meta(spark.createDataFrame(rows, "note_path string, text string")).collect()
    told = sorted(((r.note_path or "", r.words, r.outbound, r.inbound) for r in got), key=str)
    assert told == sorted([("a.md", 6, 2, 1), ("b.md", 2, 0, 2), ("b.md", 2, 1, 2), ("", 3, 1, 0), ("d.md", None, None, 0)], key=str)


def test_mentions_by_automaton_and_by_starts(spark, monkeypatch):
    from corpusloom.operators import links as L

    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "été", "x_1", "alpha", "İstanbul"]
    texts = ["\n".join(" ".join(rng.choice([*words, "[[alpha]]", "`beta gamma`", "!", "(delta)"]) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    notes = spark.createDataFrame([(f"n{i % 40}.md", x) for i, x in enumerate(texts)] + [("null.md", None), (None, "alpha beta"), ("e.md", "")], "note_path string, text string")
    titles = spark.createDataFrame([(x,) for x in ("Alpha", "alpha beta", "beta  gamma", "alpha-beta-gamma", "Delta Delta", "ÉTÉ", "x_1", "abc", None, "", "!!!!!", "alpha alpha alpha", "İstanbul")], "title string")
    plan = L.unlinked_mentions(notes, titles, 3)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "explode" not in plan.lower()
    for keep in (False, True):
        fast = sorted(map(tuple, L.unlinked_mentions(notes, titles, 3, keep).collect()), key=str)
        monkeypatch.setattr(L, "MAX_TITLE_CHARS", 0)
        slow = sorted(map(tuple, L.unlinked_mentions(notes, titles, 3, keep).collect()), key=str)
        monkeypatch.undo()
        assert fast == slow and len(fast) > 100
    none = spark.createDataFrame([], "title string")
    assert L.unlinked_mentions(notes, none).count() == 0 and L.unlinked_mentions(notes.where("false"), titles).count() == 0


def _modularity(pairs, group):
    inside, degree, m = {}, {}, len(pairs)
    for a, b in pairs:
        for x in (a, b):
            degree[group[x]] = degree.get(group[x], 0) + 1
        inside[group[a]] = inside.get(group[a], 0) + (group[a] == group[b])
    return sum(inside.get(g, 0) / m - (d / 2 / m) ** 2 for g, d in degree.items())


def _one_after_another(pairs):
    """Label moves of one node at a time, and groups as nodes, until nothing moves."""
    member = {x: x for p in pairs for x in p}
    weights = {}
    for a, b in pairs:
        weights[a, b] = weights[b, a] = 1
    degree = {}
    for (a, _), w in weights.items():
        degree[a] = degree.get(a, 0) + w
    total = sum(degree.values())
    while True:
        label, whole, near = {x: x for x in degree}, dict(degree), {}
        for (a, b), w in weights.items():
            near.setdefault(a, {})[b] = w
        changed, again = False, True
        while again:
            again = False
            for x in sorted(degree):
                links = {label[x]: 0}
                for y, w in near.get(x, {}).items():
                    links[label[y]] = links.get(label[y], 0) + w
                whole[label[x]] -= degree[x]
                gains = {g: k - degree[x] * whole[g] / total for g, k in links.items()}
                best = max(gains, key=lambda g: (round(gains[g], 9), g == label[x]))
                if round(gains[best], 9) > round(gains[label[x]], 9):
                    label[x], changed, again = best, True, True
                whole[label[x]] += degree[x]
        if not changed:
            return member
        member = {x: label[g] for x, g in member.items()}
        joined, new = {}, {}
        for (a, b), w in weights.items():
            if label[a] != label[b]:
                joined[label[a], label[b]] = joined.get((label[a], label[b]), 0) + w
        for x, d in degree.items():
            new[label[x]] = new.get(label[x], 0) + d
        weights, degree = joined, new


def test_communities_settle_as_well_as_one_after_another(spark):
    rng, pairs = random.Random(12), set()
    for _ in range(1500):
        a = rng.randrange(240)
        b = rng.randrange(240) if rng.random() < 0.15 else a // 20 * 20 + rng.randrange(20)
        pairs.add((min(a, b), max(a, b)))
    pairs |= {(0, i) for i in range(60, 240)}  # a hub
    pairs = sorted((f"n{a:03}.md", f"n{b:03}.md") for a, b in pairs if a != b)
    texts = {f"n{i:03}.md": "" for i in range(245)}
    for a, b in pairs:
        texts[a] += f"[[{b[:-3]}]] "
    notes = spark.createDataFrame(list(texts.items()), "note_path string, text string").repartition(3)
    got = {r.note_path: r.community for r in L.communities(L.outbound(notes), notes).collect()}
    assert len(got) == 245 and all(got[f"n{i}.md"] == f"n{i}.md" for i in range(240, 245))
    members = {}
    for x, g in got.items():
        members.setdefault(g, []).append(x)
    assert all(min(x) == g for g, x in members.items())
    assert _modularity(pairs, got) >= _modularity(pairs, _one_after_another(pairs)) - 0.01 > 0.3


def test_templates_fill_once_and_folders_go(spark):
    fill = lambda x, **v: spark.range(1).select(R.fill_template(F.lit(x), {k: F.lit(y) for k, y in v.items()}).alias("t")).first().t
    assert fill("{{a}} {{ b }}{{c}} {{a}}", a="{{b}}", b="{{a}}\x00$1") == "{{b}} {{a}}\x00$1{{c}} {{b}}"
    assert fill("{{ab}}{{a}}", a="1", ab="2") == "21" and fill("no names", a="1") == "no names" and fill("{{a}}", a=None) is None
    notes = spark.createDataFrame([("f/a.md", "1"), ("f/g/b.md", "2"), ("fa.md", "3"), (None, "4")], "note_path string, text string")
    stays, goes = R.delete_folder(notes, "/f/", "2024-01-01")
    assert {r.text for r in stays.collect()} == {"3", "4"} and {(r.text, r.stamp) for r in goes.collect()} == {("1", "2024-01-01"), ("2", "2024-01-01")}
    assert R.purge(goes, "2024-01-02").count() == 0 and R.purge(goes, "2024-01-01").count() == 2


def test_split_notes_cuts_a_text_once(spark):
    """No array of lines is worked out again for each line: a note of many lines takes no longer than many short ones."""
    import time

    lines = ["## Part one" if i % 40 == 0 else f"line {i}" for i in range(12_000)]
    notes = spark.createDataFrame([("long.md", "\r\n".join(lines))], "note_path string, text string")
    # a text that is an expression itself, as that of markdown_notes
    made = notes.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(x, F.lit(""))), "\n"))
    began = time.perf_counter()
    rows = {r.note_path: r.text for r in R.split_notes(made, 2).collect()}
    assert time.perf_counter() - began < 20
    assert len(rows) == 300 and rows["long-split/Part-one.md"] == "\n".join(lines[:40]) and rows["long-split/Part-one (300).md"] == "\n".join(lines[-40:])


def test_scans_hold_one_note_at_a_time(spark, monkeypatch):
    """Rows leave in batches of bounded size instead of one for all notes of an Arrow batch."""
    import pyarrow as pa

    from corpusloom.operators import extract as X

    got = {}
    none = spark.createDataFrame([], "note_path string, text string")
    monkeypatch.setattr(type(none), "mapInArrow", lambda self, run, schema: got.update(run=run) or self)
    X.code_blocks(none)
    texts = ["```py\n" + "x" * 300_000 + "\n```\n", None, "no block", "a\r\n```\r\nb\r\nc\r\n```"] * 10
    batch = pa.RecordBatch.from_pydict({"note_path": pa.array([f"n{i}" for i in range(40)]), "text": pa.array(texts)})
    made = list(got["run"](iter([batch])))
    assert len(made) >= 2 and max(b.nbytes for b in made) < 2 * X.SCAN_CHARS
    rows = [tuple(r.values()) for b in made for r in b.to_pylist()]
    assert rows == [x for i in range(0, 40, 4) for x in ((f"n{i}", 1, "py", "x" * 300_000), (f"n{i + 3}", 2, "", "b\nc"))]
