from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import reasoning as G
from corpusloom.operators import temporal as D
from corpusloom.streaming import changes


def _series(spark, conviction, supporting, days=(0, 31, 60)):
    rows = [("n", datetime(2024, 1, 1) + timedelta(days=d), c, s) for d, c, s in zip(days, conviction, supporting)]  # noqa: B905
    return spark.createDataFrame(rows, "note_path string, commit_ts timestamp, conviction double, supporting double")


@pytest.mark.parametrize(
    "conviction,supporting,fires",
    [([0.01, 0.04, 0.08], [1.0, 1.0, 1.0], True), ([0.01, 0.04, 0.08], [1.0, 3.0, 5.0], False), ([0.02, 0.03, 0.02], [1.0, 1.0, 1.0], False), ([0.01, 0.08], [1.0, 1.0], False)],
)
def test_drift(spark, conviction, supporting, fires):
    assert (D.drift_flags(_series(spark, conviction, supporting)).count() == 1) == fires


def test_slope_without_spread(spark):
    assert D.drift_slopes(_series(spark, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], (0, 0, 0))).first().conviction_slope == 0


def test_conviction(spark):
    texts = ["", "kind of", "clearly it must work", "it is kind of maybe fine"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.conviction("t")).collect()]
    assert got == [0, -0.5, 0.5, pytest.approx(-2 / 6)]


def test_lexicon_stability(spark):
    rows = [("n", datetime(2024, 1, 1) + timedelta(days=d), "clearly " * k + "word " * 20) for d, k in ((0, 0), (50, 2), (100, 6))]
    got = {r.id: (r.flagged, r.jaccard) for r in D.lexicon_stability(spark.createDataFrame(rows, "note_path string, commit_ts timestamp, content string")).collect()}
    assert len(got) == 10 and got["v1"] == (1, 1.0) and got["drop-assertion-1"] == (0, 0.0) and got["drop-hedge-0"] == (1, 1.0)


def test_forecasts(spark):
    note = lambda body: f"---\n{body}---\ntext"
    rows = [
        ("a", note('forecast:\n  claim: "It rains"\n  by: 2027-12-31\n  marked_at: 2024-01-01\n  probability: 0.8\nresolved:\n  outcome: true\n  resolved_at: 2025-01-01\n')),
        ("b", note("forecast:\n  claim: x\n  by: soon\n  marked_at: 2024-01-01\n  probability: 1.7\nresolved:\n  outcome: yes\n  resolved_at: 2025-01-01\n")),
        ("c", note("forecast:\n  by: 2027-12-31\n  marked_at: 2024-01-01\n")),
        ("d", "no frontmatter"),
    ]
    got = {r.note_path: r for r in D.forecasts(spark.createDataFrame(rows, "note_path string, text string")).collect()}
    assert set(got) == {"a", "b"} and got["a"].by == "2027-12-31T00:00:00.000Z" and (got["a"].claim, got["a"].probability, got["a"].outcome) == ("It rains", 0.8, True)
    assert (got["b"].probability, got["b"].outcome, got["b"].by) == (0.5, None, "soon")


def test_brier(spark):
    of = lambda rows: D.brier(spark.createDataFrame(rows, "probability double, outcome boolean")).first().brier
    assert of([]) is None and of([(1.0, True)]) == 0 and of([(0.8, True)]) == pytest.approx(0.04) and of([(0.7, True), (0.3, False)]) == pytest.approx(0.09)


def test_revisions(spark):
    revs = spark.createDataFrame([("n", f"{i:040x}", datetime(2024, 1, 1 + i), "m", None if i else "c") for i in range(5)], "note_path string, sha string, commit_ts timestamp, message string, content string")
    assert [r.sha[-1] for r in D.revisions_top(revs, 2).orderBy("rank").collect()] == ["4", "3"]
    assert D.revisions_top(revs, 9, since=F.lit("2024-01-02").cast("timestamp"), until=F.lit("2024-01-03").cast("timestamp")).count() == 2
    assert D.content_at(revs.drop("content"), revs.where("content is not null")).where("content is null").count() == 4
    prompt = G.narrate_prompts(revs).first().prompt
    assert prompt.startswith("Note: n\n\nRevisions (oldest first):\n#1 [sha:0000000 @ 2024-01-01] m\n   body: c\n#2") and "(content unavailable)" in prompt


def test_citations(spark):
    answers = spark.createDataFrame([(1, "x [ref:a b/ü.md:0-5][ref:c.md:1-2] [ref:c.md:1-2] [ref:bad\n.md:1-2] [ref:c.md]")], "answer_id long, text string")
    cited = G.extract_citations(answers)
    assert [r.note_path for r in cited.orderBy("pos").collect()] == ["a b/ü.md", "c.md", "c.md"]
    hops = spark.createDataFrame([("c.md", 1, 2), ("a b/ü.md", 0, 6)], "note_path string, byte_start long, byte_end long")
    assert [r.valid for r in G.validate_citations(cited, hops).orderBy("pos").collect()] == [False, True, True]
    revs = spark.createDataFrame([("abcdef0123",), ("abcdef0999",), ("1234567aaa",)], "sha string")
    shas = G.validate_shas(G.extract_shas(spark.createDataFrame([(1, "[sha:abcdef0 @ 2024-01-01] [sha:1234567@2024] [sha:abcdef01 @ 2024] [sha:fffffff @ 2024] [sha:abc @ 2024]")], "answer_id long, text string")), revs)
    assert [r.valid for r in shas.orderBy("pos").collect()] == [False, True, True, False]


def test_prompts(spark):
    q = spark.createDataFrame([(1, "why"), (2, "how")], "question_id long, question string")
    hops = spark.createDataFrame([(1, 0, "a.md", 0, 5, "H > I", "t" * 400)], "question_id long, ord int, note_path string, byte_start long, byte_end long, heading string, text string")
    got = {r.question_id: r.prompt for r in G.compose_prompts(q, hops).collect()}
    assert got[1] == "Question: why\n\nAvailable citations:\n#1 [ref:a.md:0-5] heading: H > I\n   text: " + "t" * 300 + "…" and got[2].endswith("(none)")
    assert G.answer_stub(G.compose_prompts(q, hops)).count() == 2


def _trace(spark, links, **options):
    vec = {0: [1.0, 0.0], 1: [0.9, 0.4358899], 2: [0.0, 1.0], 3: [1.0, 0.0]}
    chunks = spark.createDataFrame([(i, f"{'ABCD'[i]}.md", v) for i, v in vec.items()], "chunk_id long, note_path string, vec array<float>")
    notes = chunks.select("note_path")
    table = spark.createDataFrame([(f"{p}.md", links.get(p, [])) for p in "ABCD"], "note_path string, targets array<string>")
    seeds = spark.createDataFrame([(7, 0, 1.0, 1)], "question_id long, chunk_id long, score double, rank int")
    return [(r.step, r.from_id, r.to_id, r.edge) for r in G.trace(chunks, table, notes, seeds, **options).orderBy("ord").collect()]


def test_trace(spark):
    assert _trace(spark, {}, max_depth=1) == [(0, None, 0, "seed"), (1, 0, 3, "knn"), (1, 0, 1, "knn")]
    assert _trace(spark, {"A": ["d", "c"]}, max_depth=1)[1:] == [(1, 0, 3, "wikilink"), (1, 0, 2, "wikilink"), (1, 0, 1, "knn")]
    assert len(_trace(spark, {"A": ["b", "c", "d"]}, max_hops=2)) == 2


def _plain_trace(vec, note, links, seeds, depth, knn, least, most):
    """The hops of one question, level by level."""
    hops, seen = [(0, None, c, "seed") for c in seeds[:most]], set(seeds[:most])
    dot = lambda a, b: sum((float(x) * float(y) for x, y in zip(vec[a], vec[b], strict=True)), 0.0)
    for level in range(1, depth + 1):
        front = [h[2] for h in hops if h[0] == level - 1]
        for edge in ("wikilink", "knn"):
            wanted = {}
            for place, f in enumerate(front):
                if edge == "wikilink":
                    found = [(pos, c) for pos, t in enumerate(links[note[f]]) if t != note[f] for c in vec if note[c] == t and c not in seen]
                else:
                    found = sorted((-dot(f, c), c) for c in vec if note[c] != note[f] and c not in seen and dot(f, c) >= least)[:knn]
                for x, c in found:
                    wanted[c] = min(wanted.get(c, ((9e9,), 0)), ((place, x, c), f))
            for c, (_, f) in sorted(wanted.items(), key=lambda x: x[1][0]):
                if len(hops) < most:
                    hops.append((level, f, c, edge))
                    seen.add(c)
    return hops


@pytest.mark.parametrize("frontier,part", [(1, 16_384), (2, 7), (100_000, 16_384)])
def test_trace_in_blocks_equals_a_plain_search(spark, monkeypatch, frontier, part):
    monkeypatch.setattr(G, "MAX_FRONTIER", frontier)
    monkeypatch.setattr(G, "MAX_CHUNKS", part, raising=False)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 4)).astype(np.float32)
    m[40:50] = m[3]  # equal scores
    vec, note = {i: v.tolist() for i, v in enumerate(m)}, {i: f"n{i // 2}" for i in range(60)}
    links = {f"n{i}": [f"n{int(x)}" for x in rng.permutation(30)[: i % 3]] for i in range(30)}
    seeds = {q: [int(x) for x in rng.permutation(60)[:3]] for q in range(5)}
    chunks = spark.createDataFrame([(i, note[i], v) for i, v in vec.items()], "chunk_id long, note_path string, vec array<float>").repartition(3)
    table = spark.createDataFrame(list(links.items()), "note_path string, targets array<string>")
    asked = spark.createDataFrame([(q, c, 1.0, r + 1) for q, cs in seeds.items() for r, c in enumerate(cs)], "question_id long, chunk_id long, score double, rank int")
    got = {q: [] for q in seeds}
    for r in G.trace(chunks, table, table.select("note_path"), asked, max_hops=20).orderBy("question_id", "ord").collect():
        got[r.question_id].append((r.step, r.from_id, r.to_id, r.edge))
    assert got == {q: _plain_trace(vec, note, links, cs, 2, 3, 0.5, 20) for q, cs in seeds.items()}


def test_debounce(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0), ("a", t0 + timedelta(milliseconds=200)), ("a", t0 + timedelta(milliseconds=600)), ("b", t0)]
    got = changes.debounce(spark.createDataFrame(rows, "note_path string, ts timestamp")).collect()
    assert sorted((r.note_path, r.edits) for r in got) == [("a", 1), ("a", 2), ("b", 1)]


def test_stream_follows_changes(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0), ("a", t0 + timedelta(milliseconds=200)), ("b", t0), ("end", t0 + timedelta(minutes=5)), ("end", t0 + timedelta(minutes=9))]
    spark.createDataFrame(rows, "note_path string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    source = spark.readStream.schema("note_path string, ts timestamp").parquet(str(tmp_path / "in"))
    query = changes.follow(source, lambda df, _: seen.extend((r.note_path, r.edits) for r in df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert ("a", 2) in seen and ("b", 1) in seen
