"""Versions of stored tables: the snapshot of notes and the postings of BM25."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import postings_index as P
from corpusloom.operators import retrieval as V
from corpusloom.sources import snapshot
from corpusloom.sources.versions import Conflict, Versions

LINES = "note_path string, text string"


def _notes(spark, rows):
    return spark.createDataFrame(rows, LINES)


def _build(notes):
    return notes.select("note_path", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))


def _rows(df):
    return sorted(((r.note_path, r.line) for r in df.collect()), key=str)


def test_second_writer_of_a_version_fails(spark, tmp_path):
    one, two = Versions(spark, f"{tmp_path}/t"), Versions(spark, f"{tmp_path}/t")
    assert one.manifest() == (0, {}) and one.commit(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        two.commit(0, {"a": 2})
    assert two.manifest() == (1, {"a": 1}) and two.commit(1, {"a": 3}) == 2 and one.manifest(1) == (1, {"a": 1})


def test_snapshot_refresh_touches_changed_buckets_only(spark, tmp_path):
    stored = snapshot.Snapshot(spark, f"{tmp_path}/s", bucket_bytes=1024, file_bytes=4096)
    state = [(f"n{i}.md", f"line {i}\nsecond {i}") for i in range(400)] + [(None, "no path"), ("empty.md", None), ("twice.md", "a"), ("twice.md", "b")]
    number, diff = stored.refresh(_notes(spark, state), _build)
    first = stored.versions.manifest()[1]
    assert number == 1 and first["buckets"] > 1 and {r.action for r in diff.collect()} == {"rebuilt"}
    assert _rows(stored.read()) == _rows(_build(_notes(spark, state)))
    after = [("n0.md", "line 0\nother")] + state[2:]  # one changed, one gone, and a path of two notes
    seen = []
    number, diff = stored.refresh(_notes(spark, after), lambda notes: seen.append({r.note_path for r in notes.collect()}) or _build(notes))
    actions = {r.note_path: r.action for r in diff.collect()}
    assert number == 2 and seen == [{"n0.md", "twice.md"}] and actions["n1.md"] == "pruned" and actions[None] == "restored"
    assert _rows(stored.read()) == _rows(_build(_notes(spark, after)))
    second = stored.versions.manifest()[1]
    kept = [b for b, w in second["current"].items() if first["current"].get(b) == w]
    assert len(kept) >= len(first["current"]) - 3
    assert _rows(stored.read(version=1)) == _rows(_build(_notes(spark, state)))
    assert _rows(stored.read("n7.md")) == [("n7.md", "line 7"), ("n7.md", "second 7")] and len(stored.read("n7.md").inputFiles()) <= 4
    assert stored.read("none.md").count() == 0
    # the same state again changes nothing but the path of two notes
    assert {r.note_path for r in stored.refresh(_notes(spark, after), _build)[1].where("action <> 'restored'").collect()} == {"twice.md"}


def test_failed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    stored = snapshot.Snapshot(spark, f"{tmp_path}/s")
    stored.write(_build(_notes(spark, [("a.md", "1\n2"), ("b.md", "3")])))
    reader, names = snapshot.Snapshot(spark, f"{tmp_path}/s"), stored.versions._names("data")
    before = _rows(reader.read())

    def fail(*_):
        assert len(stored.versions._names("data")) == 2 and _rows(reader.read()) == before  # written, not committed
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(stored.versions, "commit", fail)
        with pytest.raises(OSError):
            stored.replace(_build(_notes(spark, [("a.md", "new")])))
    assert _rows(reader.read()) == before and len(stored.vacuum()) == 1 and stored.versions._names("data") == names
    stored.replace(_build(_notes(spark, [("a.md", "new")])), _notes(spark, [("b.md", "")]))
    assert _rows(reader.read()) == [("a.md", "new")]
    stored.replace(_build(_notes(spark, [])), _notes(spark, [("a.md", "")]))
    assert _rows(reader.read()) == [] and stored.vacuum() and _rows(reader.read()) == []


def test_buckets_grow_with_the_table(spark, tmp_path):
    stored = snapshot.Snapshot(spark, f"{tmp_path}/s", bucket_bytes=2048, file_bytes=1024)
    some = [(f"n{i}", f"{i * 7919 % 1009} text {i}") for i in range(1500)]
    stored.write(_build(_notes(spark, some[:20])))
    assert stored.versions.manifest()[1]["buckets"] <= 2
    stored.replace(_build(_notes(spark, some[20:])))
    assert stored.versions.manifest()[1]["buckets"] >= 8 and _rows(stored.read()) == _rows(_build(_notes(spark, some)))


def _hits(df):
    return {(r.query_id, r["rank"], r.chunk_id, round(r.score, 7)) for r in df.collect()}


@pytest.fixture(scope="module")
def texts(spark):
    """Six topics with words of their own, a common word, long and empty texts, copies, and rows that share an id."""
    rows = [(i, f"common t{i % 6}w{i % 5} t{i % 6}w{i * 7 % 11} " + f"t{i % 6}x{i % 40} " * (1 + i % 9)) for i in range(1200)]
    rows += [(5000 + i, "common copied text") for i in range(300)] + [(6000, ""), (6001, None), (None, "common"), (6002, "far " * 5000), (6003, "Éclair déjà"), (7, "t1w2 again")]
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(0, "t1w2 t1x7"), (1, "common"), (2, "t3x9 t3x9 common t3w4"), (3, "nowhere"), (4, ""), (5, None), (6, "far eclair"), (7, "copied t5x11")], "query_id long, query string")


def test_postings_give_the_rows_of_bm25_from_fewer_blocks(spark, tmp_path, texts, asked):
    index = P.PostingsIndex(spark, f"{tmp_path}/p")
    assert index.search(asked).count() == 0
    index.add(texts)
    known = texts.where("chunk_id is not null")
    rows, visits = index.plan(asked, 5)
    assert _hits(rows) == _hits(V.bm25(*V.index_terms(known), asked, 5))
    blocks, read = visits.count(), visits.where("visited").count()
    assert 0 < read < 0.8 * blocks
    bound = {(r.query_id, r.segment, r.block): r.bound for r in visits.collect()}
    assert len(bound) == blocks and max(bound.values()) > 0


def test_segments_replace_remove_and_compact(spark, tmp_path, texts, asked):
    known = texts.where("chunk_id is not null and chunk_id <> 7")
    index = P.PostingsIndex(spark, f"{tmp_path}/p")
    index.add(known.where("chunk_id % 3 <> 0").withColumn("text", F.when(F.col("chunk_id") % 5 == 0, F.lit("common stale t1w2")).otherwise(F.col("text"))))
    index.add(known.where("chunk_id % 3 = 0 or chunk_id % 5 = 0"))
    want = lambda df: _hits(V.bm25(*V.index_terms(df), asked, 5))
    assert index.sizes()[0] == known.count()
    index.remove(known.where("chunk_id % 4 = 1").select("chunk_id").unionByName(spark.createDataFrame([(99999,)], "chunk_id long")))
    left = known.where("chunk_id % 4 <> 1")
    assert _hits(index.search(asked, 5, version=2)) == want(known)
    assert _hits(index.search(asked, 5)) == (living := want(left))
    index.compact()
    assert index.sizes()[0] == left.count() and len(index.versions.manifest()[1]["segments"]) == 1
    assert len(index.vacuum()) == 4 and _hits(index.search(asked, 5)) == living
    index.remove(known.select("chunk_id"))
    assert index.sizes() == (0, 0.0) and index.search(asked, 5).count() == 0


def test_refresh_stores_no_text_on_the_way_and_kept_rows_stay(spark, tmp_path, monkeypatch):
    stored = snapshot.Snapshot(spark, f"{tmp_path}/s", file_bytes=8192)  # one bucket, large enough to be left where it is
    state = [(f"n{i}.md", f"{i * 7919 % 1009} of {i}\nsecond {i}") for i in range(900)] + [(None, "no path"), ("twice.md", "a"), ("twice.md", "b")]
    seen, shuffled = [], []
    keep, deal = snapshot.materialise, type(spark.range(1)).repartition
    with monkeypatch.context() as m:
        m.setattr(snapshot, "materialise", lambda df: seen.append(df.columns) or keep(df))
        m.setattr(type(spark.range(1)), "repartition", lambda self, *a: shuffled.append(self.count()) or deal(self, *a))
        stored.refresh(_notes(spark, state), _build)
        after = [("n0.md", "other\ntext"), *state[1:-1], ("new.md", "1\n2\n3"), ("late.md", "x")]
        stored.refresh(_notes(spark, after), _build)
    assert not any({"text", "line"} & {*columns} for columns in seen)
    # the notes' lines and a mark for each note, and in the second change no row that was kept
    assert shuffled[0] <= 1803 + 902 and shuffled[1] < 60
    assert _rows(stored.read()) == _rows(_build(_notes(spark, after))) and stored.read().where("content_sha is null").count() == 0
    for n in range(8):  # many small changes don't leave ever more files
        stored.replace(_notes(spark, [(f"n{n}.md", f"v{n}")]).select("note_path", F.col("text").alias("line"), F.lit("s").alias("content_sha")))
    assert len(stored.read().inputFiles()) < 24
    want = {p: t for p, t in after if p} | {f"n{n}.md": f"v{n}" for n in range(8)}
    assert _rows(stored.read()) == sorted([(p, x) for p, t in [*want.items(), (None, "no path")] for x in t.split("\n")], key=str)
