"""Registered queries that answer for whole tables, against their SQL on a given table or against a plain search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.jobs import registry, retrieval_queries
from corpusloom.operators import corpus as C
from corpusloom.operators import extract as X
from corpusloom.operators import links as L
from corpusloom.operators import retrieval as V

SF = "/root/testdata/sf0.001"


def _equal_to_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "events", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = registry.queries()[name](spark, SF)
    sql = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    tidy = lambda rows: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)
    got = tidy(map(tuple, df.collect()))
    assert got and got == tidy(sql)
    return got


def test_neighbors_of_all_asked_notes(spark):
    assert {r[0] for r in _equal_to_sql(spark, "neighbors_asked")} == {f"n{i // 3}" for i in range(0, 500, 100)}


def test_hybrid_search_asks_with_whole_texts(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(V, "hybrid", lambda chunks, queries, *a, real=V.hybrid, **b: asked.append(queries) or real(chunks, queries, *a, **b))
    retrieval_queries.QUERIES["hybrid_search"](spark, SF)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.query_id: r["query"] for r in asked[0].collect()} == {i: texts[i] for i in range(0, 500, 100) if i in texts}


def test_hybrid_equals_a_plain_search(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}x" for i in range(30)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(40)]
    m = rng.normal(size=(40, 8)).astype(np.float32)
    rare = "plain words " * 10 + "RAREWORD"  # behind 80 characters, and specific by its capitals
    texts[5] = "rareword alone"
    queries = {0: rare, 1: texts[7], 2: "w1x w2x"}
    weight = {0: 0.4, 1: 0.0, 2: 0.4}
    df = spark.createDataFrame([(i, f"n{i}", t, v.tolist()) for i, (t, v) in enumerate(zip(texts, m, strict=True))], "chunk_id long, note_path string, text string, vec array<float>")
    asked = spark.createDataFrame([(q, t, m[q].tolist()) for q, t in queries.items()], "query_id long, query string, vec array<float>")
    docs, avg = [t.split() for t in texts], sum(len(t.split()) for t in texts) / 40
    expected = {}
    for q, text in queries.items():
        dense = m.astype(float) @ m[q].astype(float)
        lists = [(1.0, np.lexsort((np.arange(40), -dense))[:16].tolist())]
        scores = {}
        for term in text.lower().split():
            n = sum(term in d for d in docs)
            for i, d in enumerate(docs):
                if term in d:
                    idf = max(np.log((40 - n + 0.5) / (n + 0.5)), 1e-6)
                    scores[i] = scores.get(i, 0) + idf * d.count(term) * 2.2 / (d.count(term) + 1.2 * (0.25 + 0.75 * len(d) / avg))
        if weight[q]:
            lists.append((weight[q], sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:16]))
        fused = {}
        for j, (w, ids) in enumerate(lists):
            for r, i in enumerate(ids):
                s, best = fused.get(i, (0, (99, 9)))
                fused[i] = (s + w / (61 + r), min(best, (r, j)))
        expected[q] = sorted(fused, key=lambda i: (-round(fused[i][0], 12), fused[i][1], i))[:2]
    got = {q: [] for q in queries}
    for r in V.hybrid(df, asked, 2, router=True).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    assert got == expected


def test_diff_of_all_pairs(spark):
    assert len({r[0] for r in _equal_to_sql(spark, "line_set_diff_pairs")}) > 100


def test_periodic_entries_go_to_notes_that_exist(spark):
    rows = dict(_equal_to_sql(spark, "append_periodic_notes"))
    assert len(rows) > 200 and "2024-W01.md" in rows and "2024-W02.md" in rows


def test_long_texts_are_read_whole(spark):
    line = "x " * 600_000 + "clown yes:: value"
    df = spark.createDataFrame([("a.md", line), ("b.md", "clown")], "note_path string, text string")
    assert [tuple(r) for r in C.top_terms(df).collect()] == [("clown", 2), ("value", 1)]
    assert {(r.note_path, len(r.content)) for r in C.grep(df, "clown").collect()} == {("a.md", len(line)), ("b.md", 5)}
    assert C.grep(df, r"\bclown\b", regex=True).count() == 2
    assert [tuple(r) for r in X.inline_fields(df).collect()] == [("a.md", 1, "yes", "value")]


@pytest.mark.parametrize("name", ["top_terms", "grep_context", "grep_regex", "inline_fields"])
def test_registered_queries_without_caps_agree_with_their_sql(spark, name):
    _equal_to_sql(spark, name)


def test_mentions_of_titles_of_any_length(spark):
    long = "one two three four five six seven eight nine ten"
    titles = ["solo", long, "One two three", "ONE two", "six seven eight nine", "absent words here", "abc", "x" * 257, "a b " * 30]
    texts = {"a.md": f"see {long.title()}, and solo solo\n[[one two]] one, two `three`", "b.md": "one two\nthree " + "a b " * 40, "c.md": None, "d.md": ""}
    rows = [(p, x) for p, x in texts.items()] + [("a.md", "of the same path: solo\nabsent words")]
    expected = []
    for path, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            w = " " + " ".join(re.findall(r"\w+", re.sub(r"`[^`]*`", " ", re.sub(r"!?\[\[[^\]]*\]\]", " ", line)).lower())) + " "
            expected += [(path, i + 1, t.lower().strip()) for t in titles if 4 <= len(t) <= 256 and f" {t.lower().strip()} " in w]
    got = L.unlinked_mentions(spark.createDataFrame(rows, "note_path string, text string"), spark.createDataFrame([(t,) for t in titles], "title string"))
    assert sorted(map(tuple, got.collect())) == sorted(expected) and ("a.md", 1, long) in expected and len(expected) > 8


def test_mentions_query_asks_for_whole_titles(spark):
    found = registry.queries()["unlinked_mentions"](spark, SF)
    assert found.where(F.size(F.split("mention", " ")) > 10).count() > 0
