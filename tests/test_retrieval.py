import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as U
from corpusloom.operators import embed
from corpusloom.operators import evaluate as E
from corpusloom.operators import retrieval as V


def _rrf(spark, lists, weights=None):
    rows = [(0, i, r, x) for i, ids in enumerate(lists) for r, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "query_id long, list_idx int, rank int, id long")
    return [r.id for r in V.rrf(df, weights).orderBy("rank").collect()]


@pytest.mark.parametrize(
    "lists,weights,check",
    [
        ([[1, 2, 3], [1, 4, 5]], None, lambda x: x[0] == 1),
        ([[9, 2, 3], [2, 7, 9]], None, lambda x: x.index(2) < x.index(9)),
        ([[5, 6, 7], [2, 8, 9]], None, lambda x: x[0] == 5),
        ([[10], [20]], {0: 2.0, 1: 1.0}, lambda x: x == [10, 20]),
        ([[11, 12, 13], [20, 21, 22]], {0: 1.0, 1: 0.0}, lambda x: x == [11, 12, 13]),
        ([[5], [6]], {0: 1.0, 1: 0.4}, lambda x: x[0] == 5),
        ([[], []], None, lambda x: x == []),
    ],
)
def test_fusion(spark, lists, weights, check):
    assert check(_rrf(spark, lists, weights))


@pytest.mark.parametrize(
    "query,kind",
    [('find "exact words" in all of the notes now please', "specific"), ("what is the GTD method about in general use", "specific"), ("a EU law for all of us in one two", "broad"), ("how does VaultIndex keep its data over time in files", "specific"), ("one two three", "specific"), ("one two three four", "mixed"), ("a b c d e f g", "mixed"), ("a b c d e f g h", "broad"), ("", "mixed"), ("   ", "mixed")],
)
def test_intent(spark, query, kind):
    assert spark.range(1).select(V.intent(F.lit(query))).first()[0] == kind


def test_quantize_and_normalize(spark):
    row = spark.range(1).select(
        U.quantize(F.array(*map(F.lit, [-2.5, 2.5, 0.5, -0.5, 900.0, -900.0])), F.lit(1.0)).alias("q"),
        U.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z"),
        U.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("n"),
        U.int_dot(F.array(*map(F.lit, [1, 2, 3, -4])), F.array(*map(F.lit, [5, 6, 7, 8]))).alias("d"),
    ).first()
    assert list(row.q) == [-2, 3, 1, 0, 127, -127] and list(row.z) == [0, 0] and row.n == pytest.approx([0.6, 0.8]) and row.d == 6


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(600, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[500] = m[3]
    rows = [(i, f"n{i // 2}", v.tolist(), "t") for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "chunk_id long, note_path string, vec array<float>, text string").repartition(3), m


def test_topk_and_coarse_recall(chunks):
    df, m = chunks
    queries = df.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in V.dense_topk(df, queries, 5).collect()}
    for q in range(0, 600, 20):
        order = np.lexsort((np.arange(600), -(m.astype(np.float32).astype(float) @ m[q].astype(np.float32).astype(float))))[:5]
        assert [got[(q, r)] for r in range(1, 6)] == order.tolist()
    recall = E.truth_recall(V.coarse_rescore(df, queries), V.dense_topk(df, queries)).agg(F.avg("recall")).first()[0]
    assert recall >= 0.95
    blocks = V.top_k(V.score_queries(df, queries, 5, max_queries=7), 5, "query_id", "chunk_id")
    assert {(r.query_id, r["rank"]): r.chunk_id for r in blocks.collect()} == got


def test_similar_pairs_equal_brute_force(chunks):
    df, m = chunks
    expected = {(i, j) for i in range(600) for j in range(i + 1, 600) if i // 2 != j // 2 and m[i] @ m[j] >= 0.3}
    for block in (4096, 100):
        assert {(r.a, r.b) for r in V.similar_pairs(df, 0.3, block).collect()} == expected
    flags = df.select("note_path").distinct().withColumn("community", F.substring("note_path", 2, 9).cast("int") % 2)
    linked = df.sparkSession.createDataFrame([("n1", "n250")], "a string, b string")
    top = V.bridges(df, flags, linked, 1, 0.5).first()
    assert (top.a, top.b, top.cross_community, top.linked) == (3, 500, True, True) and top.score == pytest.approx(1, abs=1e-5)


def test_diversity(spark):
    vectors = {1: [1.0, 0.0], 2: [1.0, 0.001], 3: [0.0, 1.0]}
    df = spark.createDataFrame([(0, i, s, vectors[i]) for i, s in ((1, 0.9), (2, 0.89), (3, 0.5))], "query_id long, id long, score double, vec array<float>")
    order = lambda lam: [r.id for r in V.diversify(df, 3, lam).orderBy("pick").collect()]
    assert order(1.0) == [1, 2, 3] and order(0.3) == [1, 3, 2]
    same = df.withColumn("score", F.lit(0.5)).withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    assert [r.id for r in V.diversify(same, 3, 0.5).orderBy("pick").collect()] == [1, 2, 3]


def test_bm25_equals_formula(spark):
    texts = ["the quick brown fox", "Café résumé the the", "fox fox jumps over", "", "nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    queries = spark.createDataFrame([(0, "fox cafe the the"), (1, "absent"), (2, "")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in V.bm25(V.postings(df), V.index_sizes(df), queries).collect()}
    docs = [x.lower().replace("é", "e").split() for x in texts]
    avg = sum(map(len, docs)) / len(docs)
    expected = {}
    for i, d in enumerate(docs):
        s = 0
        for t in ("fox", "cafe", "the", "the"):
            n = sum(t in x for x in docs)
            idf = max(np.log((5 - n + 0.5) / (n + 0.5)), 1e-6)
            s += idf * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / avg))
        if s:
            expected[(0, i)] = s
    assert got == pytest.approx(expected, abs=1e-8)


def test_hybrid_brings_the_rare_term_first(spark):
    emb = embed.HashEmbedder(32)
    texts = ["a note about zyzzyva beetles", "a plain note on other things", "more plain words"]
    df = embed.embed(spark.createDataFrame([(i, f"n{i}", x) for i, x in enumerate(texts)], "chunk_id long, note_path string, text string"), emb)
    q = embed.embed(spark.createDataFrame([(0, "zyzzyva")], "query_id long, text string"), emb).withColumnRenamed("text", "query")
    assert V.hybrid(df, q, 3, lexical_only=True).orderBy("rank").first().chunk_id == 0
    assert V.hybrid(df, q, 2, diversity=0.3).count() == 2 and V.hybrid(df, q, 3, router=True).count() == 3


def test_cache(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string")
    calls = embed.HashEmbedder(8)
    empty = spark.createDataFrame([], "key string, vec array<float>")
    first, fresh = embed.embed_cached(texts, empty, calls, "m")
    assert fresh.count() == 2 and len({tuple(r.vec) for r in first.collect()}) == 2
    assert embed.cache_misses(texts, fresh, "m").count() == 0 and embed.cache_misses(texts, fresh, "other").count() == 2
    assert np.linalg.norm(calls(["x"])[0]) == pytest.approx(1, abs=1e-6)


def test_cache_shuffles_texts_once_and_asks_for_each_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embed, "COPIES", 20)
    rows = [(i, f"text {i % 300}") for i in range(900)] + [(1000 + i, "often") for i in range(200)] + [(2000 + i, "often and known") for i in range(50)] + [(3000, None), (3001, None)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    held = spark.createDataFrame([(f"text {i}", [float(i)]) for i in range(0, 300, 2)] + [("often and known", [7.0]), ("of no row", [8.0])], "text string, vec array<float>").select(embed.cache_key("m", "text").alias("key"), "vec")
    log = f"{tmp_path}/calls"

    def provider(asked):
        with open(log, "a") as f:
            f.write("".join(x + "\n" for x in asked))
        return np.array([[-float(len(x))] for x in asked], np.float32)

    told, _ = embed.embed_cached(texts, held, provider, "m")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_key") == 1 and "SortMergeJoin" not in plan
    got = {r.id: r.vec for r in told.collect()}
    known = {f"text {i}": [float(i)] for i in range(0, 300, 2)} | {"often and known": [7.0]}
    assert got == {i: None if x is None else known.get(x, [-float(len(x))]) for i, x in rows} and told.columns == ["id", "text", "vec"]
    with open(log) as f:
        assert sorted(f.read().split("\n")[:-1]) == sorted({x for _, x in rows if x and x not in known})


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "x", 1), (1, "y", 2)], "query_id long, note_path string, rank long")
    gold = spark.createDataFrame([(0, "a"), (0, "b"), (1, "y"), (1, "z"), (2, "q")], "query_id long, note_path string")
    m = {r.query_id: r for r in E.metrics(ranked, gold, 10).collect()}
    assert (m[0].recall, m[0].rr, m[0].ndcg) == (1, 1, 1) and (m[1].recall, m[1].rr) == (0.5, 0.5) and (m[2].recall, m[2].rr, m[2].ndcg) == (0, 0, 0)
    assert {r.query_id: r.recall for r in E.metrics(ranked, gold, 10, any_of=True).collect()}[1] == 1
    s = E.summary(E.metrics(ranked, gold))
    assert tuple(E.check_router(s, s, s).first()) == (True, True)


def test_folding_covers_upper_case(spark):
    rows = spark.createDataFrame([(1, "Čech ŠKODA Žižka"), (2, "čech škoda"), (3, "cech"), (4, None), (5, "été ÉTÉ")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "čech"), (2, "SKODA"), (3, "Žižka"), (4, "été")], "query_id long, query string")
    found = {(r.query_id, r.chunk_id) for r in V.bm25(*V.index_terms(rows), asked).collect()}
    assert found == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (4, 5)}


def test_scores_in_small_batches_are_the_same(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    vecs = np.round(rng.normal(size=(300, 4)), 1)  # many ties
    chunks = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "chunk_id long, vec array<float>").repartition(3)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs[:7])], "query_id long, vec array<float>")
    v32 = vecs.astype(np.float32).astype(np.float64)
    expected = set()
    for q in range(7):
        s = v32 @ v32[q]
        expected |= {(q, int(c), k + 1) for k, c in enumerate(np.lexsort((np.arange(300), -s))[:5])}
    for size in (1, 40, 1 << 21):
        monkeypatch.setattr(V, "SCORES", size)
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in V.dense_topk(chunks, asked, 5).collect()} == expected


def test_bm25_in_blocks_is_the_same(spark):
    import collections
    import math
    import random

    rng = random.Random(11)
    words = [f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(4000)]  # a few words stand nearly everywhere
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(150)] + [None, "w0 " * 3000]
    texts += texts[:30]  # equal texts: ties
    asked = [" ".join(rng.choices(words, k=rng.randint(0, 15))) for _ in range(25)] + [None, "absent"]
    docs = [(x or "").split() for x in texts]
    avg, n = sum(map(len, docs)) / len(docs), collections.Counter(t for d in docs for t in set(d))
    expected = set()
    for q, text in enumerate(asked):
        found = []
        for c, d in enumerate(docs):
            tf, s = collections.Counter(d), 0.0
            for t in (text or "").split():
                if tf[t]:
                    idf = math.log((len(docs) - n[t] + 0.5) / (n[t] + 0.5))
                    s += (idf if idf > 0 else 1e-6) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / avg))
            if s:
                found.append((-round(s, 9), c))
        expected |= {(q, c, i + 1) for i, (_, c) in enumerate(sorted(found)[:5])}
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = V.index_terms(chunks)
    for most in (V.MAX_TERMS, 40):
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in V.bm25(*index, queries, 5, most).collect()} == expected
    none = chunks.where("false")
    assert V.bm25(*V.index_terms(none), queries).count() == 0 and V.bm25(*index, queries.where("false")).count() == 0


def test_scores_of_a_task_in_slices_of_any_size(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    lists = [[f"t{x}" for x in np.minimum(rng.geometric(0.15, rng.integers(0, 30)), 40)] for _ in range(120)]
    queries = [sorted({f"t{x}" for x in rng.geometric(0.15, 9)}) for _ in range(30)]
    weights = [[float(len(t) + i % 3) for i, t in enumerate(q)] for q in queries]
    table = pa.table({"query_id": pa.array(range(30)), "terms": pa.array(queries), "w": pa.array(weights)})
    length = np.array([len(x) / 12 for x in lists])
    expected = []
    for q, ws in zip(queries, weights, strict=True):
        s = [round(sum(w * x.count(t) / (x.count(t) + 1.2 * (0.25 + 0.75 * n)) for t, w in zip(q, ws, strict=True) if t in x), 9) for x, n in zip(lists, length, strict=True)]
        expected.append([c for c in sorted(range(120), key=lambda c: (-s[c], c)) if s[c] > 0][:4])
    for size in (1, 8, 100, 1 << 21):
        monkeypatch.setattr(V, "SCORES", size)
        best = V._Best(30, 4)
        V._weigh(best, list(V._asked_terms(table)), np.arange(120), length, pa.array(lists, pa.list_(pa.string())))
        q, _, c = best.rows()
        assert [list(c[q == i]) for i in range(30)] == expected


def test_memory_of_scores_does_not_follow_the_chunks():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(8)
    asked, vecs = rng.normal(size=(2000, 16)), rng.normal(size=(6000, 16))
    for dtype in (np.float64, np.float32):  # vectors, and codes
        asked, vecs = np.round(asked * (1 if dtype == np.float64 else 20)).astype(dtype), np.round(vecs * (1 if dtype == np.float64 else 20)).astype(dtype)
        best = V._Best(2000, 40)
        tracemalloc.start()
        for at in range(0, 6000, 1000):
            V._rank_all(best, asked, vecs[at : at + 1000], np.arange(at, at + 1000))
        q, s, c = best.rows()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64e6  # products of whole batches took 230 MB and more
        assert np.array_equal(np.bincount(q), np.full(2000, 40))
        for i in (0, 777, 1999):
            scores = vecs.astype(float) @ asked[i].astype(float)
            assert list(c[q == i]) == list(np.lexsort((np.arange(6000), -scores))[:40])


def test_equal_vectors_have_equal_scores(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    one = rng.normal(size=61)
    vecs = [one if i % 3 else rng.normal(size=61) for i in range(700)]
    chunks = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "chunk_id long, vec array<float>").repartition(3)
    asked = chunks.where("chunk_id < 23").select(F.col("chunk_id").alias("query_id"), "vec")
    for most in (V.MAX_QUERIES, 5):  # all at once, and in blocks
        rows = V.top_k(V.score_queries(chunks, asked, 300, most), 300, "query_id", "chunk_id").collect()
        assert len(rows) == 23 * 300
        for i in (1, 2, 22):
            same = sorted((r["rank"], r.chunk_id, r.score) for r in rows if r.query_id == i and r.chunk_id % 3)
            assert len({s for _, _, s in same}) == 1 and [c for _, c, _ in same] == sorted(c for _, c, _ in same) and len(same) > 250


def test_blocks_of_pairs_follow_the_number_of_vectors(spark, monkeypatch):
    """A vector is sent once for each block, so there are not more blocks with more vectors, and memory stays in slices."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=(900, 16))
    m[300:420] = m[7]  # equal vectors
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, f"n{i // 3}", v.tolist(), i % 5 or None) for i, v in enumerate(m)], "chunk_id long, note_path string, vec array<double>, kind int")
    monkeypatch.setattr(V, "BLOCK_ROWS", 10)
    monkeypatch.setattr(V, "BLOCKS", 5)
    plan = V.similar_pairs(df, 0.4)._jdf.queryExecution().toString()
    assert "explode(sequence(0, 4" in plan
    score = (m[:, None, :] * m[None, :, :]).sum(axis=2)
    every = [(-score[i, j], i, j) for i in range(900) for j in range(i + 1, 900) if i // 3 != j // 3 and score[i, j] >= 0.4]
    assert sorted((r.a, r.b) for r in V.similar_pairs(df, 0.4).collect()) == sorted((i, j) for _, i, j in every)
    monkeypatch.setattr(V, "PRODUCTS", 300)
    for apart in (None, "kind"):
        some = sorted(x for x in every if apart is None or x[1] % 5 != x[2] % 5)[:50]
        pairs = V.similar_pairs(df, 0.4, best=50, apart=apart)
        assert [(r.a, r.b) for r in pairs.orderBy(F.desc("score"), "a", "b").limit(50).collect()] == [(i, j) for _, i, j in some]
        assert pairs.count() <= 15 * 50 < len(every)
