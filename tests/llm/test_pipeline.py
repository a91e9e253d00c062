"""The pipeline's stages against brute force, each on what the stage before has kept."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest


import corpus_pipeline
from corpusloom.llm import quality
from tests.llm.test_operators import _sets, _text, _words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(i, "\n".join(_text(rng, 30, 3000) for _ in range(4)), "en", f"s{i % 3}") for i in range(60)]
    base = rows[5][1]
    rows += [(100 + i, base, "en", "s0") for i in range(5)]
    rows += [(120 + i, base + f" extra{i}", "en", "s1") for i in range(5)]
    rows += [(200 + i, "This line stands in a lot of documents here\n" + _text(rng, 90, 3000), "en", "s2") for i in range(6)]
    rows += [(300 + i, " ".join(f"w{rng.randrange(900)}x###&&&" for _ in range(80)), "en", "s0") for i in range(6)]
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, "too short", "en", "s1"), (None, _text(rng, 120, 3000), "en", "s1")]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(300, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def _rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_stages(spark, tables):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "jaccard_join", "mix_sources", "byte_bpe"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    one = stages["quality_rules"](spark, docs, tables).cache()
    judged = quality.score_quality(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    assert one.columns == docs.columns and _rows(one) == _rows(judged.where("kept"))
    kept = {r.doc_id for r in one.collect()}
    assert set(range(60)) <= kept and None in kept and not kept & {300, 305, 400, 401, 402}

    two = stages["line_dedup"](spark, one, tables).cache()
    header = "This line stands in a lot of documents here"
    texts = {r.doc_id: r for r in two.collect()}
    assert [i for i in range(200, 206) if header in texts[i].text] == [205]
    assert all(texts[i].n_chars == len(texts[i].text) for i in texts) and two.columns == docs.columns

    three = stages["jaccard_join"](spark, two, tables).cache()
    sets, parent = {r.doc_id: _sets(r.text, 5) for r in two.collect() if r.doc_id is not None}, {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert _rows(three) == Counter({k: n for k, n in _rows(two).items() if k[0] is None or find(k[0]) == k[0]})

    four = stages["mix_sources"](spark, three, tables).cache()
    copies, sizes = _rows(four), {k: len(_words(k[1])) for k in _rows(three)}
    assert set(copies) <= set(sizes) and max(copies.values()) <= 2 and four.columns == docs.columns
    total = sum(sizes.values())
    assert abs(sum(sizes[k] * n for k, n in copies.items()) - 1.5 * total) <= max(sizes.values())
    by = defaultdict(int)
    for k, n in copies.items():
        by[k[3]] += sizes[k] * n
    assert by["s0"] > by["s2"]

    five = stages["byte_bpe"](spark, four, tables)
    assert Counter((r.doc_id, r.decoded_sha256) for r in five.collect()) == sum((Counter({(k[0], hashlib.sha256(k[1].encode()).hexdigest()): n}) for k, n in copies.items()), Counter())
    got = corpus_pipeline.run(spark, tables)
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "source"]
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(map(tuple, five.select(columns).collect()))
    assert all(r.n_tokens == len(r.ids) for r in got.collect())


def test_empty_tables(spark, tables, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_one_id_with_different_texts_are_different_documents(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta"))
    rows = [(1, one), (1, two), (1, two), (2, one + " more"), (None, two), (None, "gamma " * 3), (3, ""), (3, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 4):
        kept = corpus_pipeline.jaccard_join(spark, docs.repartition(parts), "").collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, one), (1, two), (None, "gamma " * 3), (3, ""), (3, None)], key=str)
