"""Codes, candidate buckets and the stored index of cells, against exact ways."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as U
from corpusloom.operators import evaluate as E
from corpusloom.operators import retrieval as V
from corpusloom.operators import vector_index as X

SCHEMA = "chunk_id long, note_path string, vec array<float>"


def _unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors(spark):
    """Unlike vectors, a tight group of a third of all rows, exact copies, rows of one note, and a null."""
    rng = np.random.default_rng(11)
    m = _unit(rng.normal(size=(900, 64)))
    m[300:600] = _unit(m[0] + 0.02 * rng.normal(size=(300, 64)))
    m[700:720] = m[5]
    m[750] = _unit(m[[749]] + 0.01)[0]
    rows = [(i, f"n{i // 3}", v.tolist()) for i, v in enumerate(m)] + [(5000, "n5000", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), m.astype(np.float32).astype(float)


def test_codes_are_what_expressions_give(vectors):
    df, _ = vectors
    scale = X.code_scale(df)
    coded = X.encode(df, scale, ("chunk_id", "note_path")).join(df.select("chunk_id", U.quantize(F.col("vec"), F.lit(scale)).alias("q")), "chunk_id").collect()
    assert len(coded) == 900 and all(list(np.frombuffer(r.code, np.int8)) == list(r.q) for r in coded)
    assert dict(X.encode(df, scale).dtypes)["code"] == "binary" and all(len(r.code) == 64 for r in coded)


def test_stored_codes_give_the_same_rows(spark, vectors, tmp_path):
    df, _ = vectors
    scale, queries = X.code_scale(df), df.where("chunk_id % 30 = 0 and vec is not null").select(F.col("chunk_id").alias("query_id"), "vec")
    X.encode(df, scale).write.parquet(f"{tmp_path}/codes")
    codes = spark.read.parquet(f"{tmp_path}/codes")
    rows = lambda d: {(r.query_id, r["rank"], r.chunk_id) for r in d.collect()}
    kept = df.where("vec is not null")
    assert rows(X.coarse_topk(codes, kept, queries, scale)) == rows(V.coarse_rescore(kept, queries))
    some = X.score_codes(codes, queries, scale, 5, max_queries=7)
    assert X.score_codes(codes, queries.withColumn("vec", F.lit(None).cast("array<float>")), scale, 5).count() == 0
    assert rows(V.top_k(some, 5, "query_id", "chunk_id")) == rows(V.top_k(X.score_codes(codes, queries, scale, 5), 5, "query_id", "chunk_id"))


def _exact(m, least):
    one, first = np.unique(m, axis=0, return_inverse=True)
    rep = {c: i for i, c in reversed(list(enumerate(first.ravel())))}
    members = {}
    for i, c in enumerate(first.ravel()):
        members.setdefault(rep[c], set()).add(i // 3)
    ids = sorted(rep.values())
    score = m[ids] @ m[ids].T
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if score[i, j] >= least and not (len(members[ids[i]] | members[ids[j]]) == 1)}


@pytest.mark.parametrize("least,tile", [(0.92, 1024), (0.8, 50), (0.5, 1024)])
def test_near_pairs_recall(vectors, monkeypatch, least, tile):
    df, m = vectors
    monkeypatch.setattr(X, "TILE", tile)  # the tight group is cut into parts
    expected = _exact(m, least)
    rows = X.near_pairs(df, least).collect()
    got = {(r.a, r.b) for r in rows}
    assert len(got) == len(rows) and got <= expected
    assert len(got) >= 0.95 * len(expected) > 40_000 * 0.95
    assert all(r.score == pytest.approx(m[r.a] @ m[r.b], abs=1e-9) for r in rows[:500])


def test_classes_and_empty_tables(spark, vectors):
    df, _ = vectors
    classes = {r.chunk_id: r.class_id for r in X.vector_classes(df).collect()}
    assert len(classes) == 900 and all(classes[i] == 5 for i in (5, *range(700, 720))) and classes[7] == 7
    empty = spark.createDataFrame([], SCHEMA)
    assert X.near_pairs(empty).count() == 0 and X.vector_classes(empty).count() == 0
    assert X.near_pairs(df.where("chunk_id = 5000")).count() == 0


def test_tables_fit_the_threshold():
    few, many = X.SignTables.fit(1000, 0.9), X.SignTables.fit(10**9, 0.9)
    assert few.bits < many.bits <= 30 and few.tables < many.tables
    rng = np.random.default_rng(1)
    a = _unit(rng.normal(size=(4000, 64)))
    b = _unit(rng.normal(size=(4000, 64)))
    b = _unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    t = X.SignTables.fit(4000, 0.9)
    met = (t.keys(a) == t.keys(0.9 * a + np.sqrt(1 - 0.81) * b)).any(axis=1).mean()
    assert met >= 0.95


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('index')}/i"
    X.write_index(vectors[0], folder, cells=25, rows_a_file=100)
    return X.VectorIndex(spark, folder)


def test_index_recall_and_pruning(vectors, index):
    df, _ = vectors
    queries = df.where("chunk_id % 20 = 0 and vec is not null").select(F.col("chunk_id").alias("query_id"), "vec")
    truth = V.dense_topk(df.where("vec is not null"), queries)
    probes = index.calibrate(10, 0.95)
    assert 1 <= probes < len(index.cells)
    recall = E.truth_recall(index.search(queries, 10, probes), truth).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    one = queries.limit(1)
    assert index.vectors().count() == 900 and sum(index.rows) == 900
    plan = io.StringIO()
    scored, cells = index._probe(one, 10, 2, 100)
    with redirect_stdout(plan):
        scored.explain("formatted")
    filters = next(x for x in plan.getvalue().splitlines() if "PartitionFilters" in x)
    assert len(cells) == 2 and "cell" in filters and str(min(cells)) in filters and "vec" not in plan.getvalue().split("ReadSchema")[1].splitlines()[0]


def test_index_exact_and_blocks(vectors, index, monkeypatch):
    df, _ = vectors
    queries = df.where("chunk_id % 25 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    rows = lambda d: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in d.collect())
    assert rows(index.search_exact(queries, 5, probes=2)) == rows(V.dense_topk(df.where("vec is not null"), queries.where("vec is not null"), 5))
    assert rows(index.search(queries, 5, 4)) == rows(index.search(queries, 5, 4, max_queries=3))
    files = index.vectors().withColumn("file", F.input_file_name()).groupBy("cell").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n")).collect()
    assert max(r.n for r in files) > 140 and all(r.files > 1 for r in files if r.n > 140)


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    X.write_index(empty, f"file://{tmp_path}/i")
    index = X.VectorIndex(spark, f"file://{tmp_path}/i")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<float>")
    assert index.search(queries).count() == 0 and index.search_exact(queries).count() == 0 and index.calibrate() == 1
