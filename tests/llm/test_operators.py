"""Operators on small awkward tables, held against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from corpusloom.llm import audio, bpe, divergence, graphs, linededup, mixing, neardup, pii, ppm, quality, runs, sharding, tokencount, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, h string, ids string, size string, _row string"


def _text(rng, n, vocabulary=40):
    return " ".join(rng.choice(["the", "of"]) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def _rows():
    """Nulls in all columns, empty, one-word and long texts, exact copies, near copies, repeated rows, shared lines."""
    rng = random.Random(7)
    rows = [(0, None, "en", "a"), (1, "", "en", "a"), (2, "   \n\t", None, None), (3, "word", "en", "b"), (4, "two words", "en", "b"), (None, "text without an id at all here", "en", "c"), (None, None, None, None)]
    base = _text(rng, 120, 400)
    rows += [(10 + i, base, "en", "hot") for i in range(9)]
    rows += [(30 + i, base.replace("w3", f"y{i}") + f" tail{i}", "fr", "hot") for i in range(12)]
    rows += [(50 + i, _text(rng, rng.randrange(3, 300), 1000), "de", rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(100 + i, f"Shared header line of the site {i % 3}\n" + _text(rng, 30) + "\n\n  SHARED footer, with many words in it  \n" + _text(rng, 5), "es", "d") for i in range(12)]
    rows += [(200, _text(rng, 30_000, 5_000), "en", "long"), (201, "a" * 60_000, "en", "long"), (202, "é😀ﬁ   日本語 don't we'll  x\r\n\n y " * 900, "ja", "long")]
    rows += [(300, "same row twice is here", "en", "e")] * 2
    rows += [(301, "mail bob.x@example.com now, +1 (310) 555-4510 or 10.0.0.300 and 8.8.8.8.9; card 4111 1111 1111 1111. token = \"deadbeefdeadbeefdeadbeef12\"", "en", "e")]
    return [(i, t, lang, s, None if t is None else len(t), "n", "h", "i", "s", "r") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return WORD.findall(text or "")


def _logp(tries, context, symbol):
    excluded, q = set(), 1.0
    for o in range(ppm.ORDER, -1, -1):
        seen = {k: v for k, v in tries[o].get(context[ppm.ORDER - o :], {}).items() if k not in excluded}
        if seen:
            n = sum(seen.values())
            if symbol in seen:
                return math.log10(q * (seen[symbol] - 0.5) / n)
            q *= len(seen) / 2 / n
            excluded |= set(seen)
    return math.log10(q / max(1, ppm.SYMBOLS - len(excluded)))


def test_ppm_equals_a_plain_trie(docs, empty):
    some = docs.where("doc_id is null or doc_id < 200 or doc_id >= 300")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    got = defaultdict(list)
    for r in ppm.score_documents(some, ~held, segment=100).collect():
        got[r.doc_id].append(r)
    rows = [(r.doc_id, r.text or "") for r in some.collect()]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    tries, words = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)], Counter()
    coded = lambda t: ppm.BEFORE * ppm.ORDER + t.encode() + ppm.END
    for i, t in rows:
        if not out(i):
            words.update([*_words(t.translate(LOWER)), None])
            b = coded(t)
            for k in range(ppm.ORDER, len(b)):
                for o in range(ppm.ORDER + 1):
                    tries[o][b[k - o : k]][b[k]] += 1
    n, v = sum(words.values()), len(words)
    expected = defaultdict(list)
    for i, t in rows:
        b, tokens = coded(t), [*_words(t.translate(LOWER)), None]
        score = sum(_logp(tries, b[k - ppm.ORDER : k], b[k]) for k in range(ppm.ORDER, len(b)))
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        expected[i].append((len(tokens), sum(words[w] > 0 for w in tokens), n, base, score))
    assert set(got) == set(expected)
    for i, rows_ in expected.items():
        mine = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got[i])
        assert mine == [pytest.approx(x, rel=1e-6) for x in sorted(rows_)]
    assert ppm.score_documents(empty, F.lit(True)).count() == 0


def test_ppm_gives_a_distribution():
    rng = np.random.default_rng(1)
    gram = np.unique(rng.integers(97, 101, (400, 6)) @ (1 << 8 * np.arange(5, -1, -1)))
    gram = np.unique((gram[:, None] // 256 * 256 + np.arange(97, 101)).ravel()).astype(np.uint64)
    gram = gram[(gram >> np.uint64(8)) & np.uint64(0xFFFFFF) == 0x616263]
    n = rng.integers(0, 3, len(gram))
    low_of = lambda g, c: ppm.Low(np.array(sorted(set((g & np.uint64(0xFFFFFF)).tolist()))), np.array([c[(g & np.uint64(0xFFFFFF)) == x].sum() for x in sorted(set((g & np.uint64(0xFFFFFF)).tolist()))]))
    p = 10 ** ppm.gram_log_probs(gram, n, low_of(gram, n))
    for context in np.unique(gram >> np.uint64(8)):
        assert p[gram >> np.uint64(8) == context].sum() <= 1 + 1e-9


def _sets(text, k):
    w = _words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k,num,tile", [(4, 85, 1024), (5, 80, 4), (1, 50, 2)])
def test_near_duplicates_equal_brute_force(docs, empty, k, num, tile):
    rows = [(r.doc_id, _sets(r.text, k)) for r in docs.collect()]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    least = {i: min((rows[m][0] for m in g if rows[m][0] is not None), default=None) for g in groups.values() for i in g}
    expected = Counter((d, len(s), least[i]) for i, (d, s) in enumerate(rows))
    got = Counter(tuple(r) for r in neardup.near_duplicates(docs, k, num, 100, tile).collect())
    assert got == expected
    if k == 4:
        assert neardup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("num", [85, 60])
def test_parts_of_similar_sets_meet(num):
    rng, tried = np.random.default_rng(num), 0
    for _ in range(2000):
        n = int(rng.integers(1, 300))
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        lost, new = (int(rng.integers(0, n * (100 - num) // 100 + 2)) for _ in range(2))
        a, b = np.unique(pool[:n]), np.unique(np.concatenate((pool[lost:n], pool[n : n + new])))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= num * (len(a) + len(b) - both):
            tried += 1
            assert len(np.intersect1d(neardup.part_keys(a, num, 100), neardup.part_keys(b, num, 100)))
    assert tried > 500


def test_popular_blocks_and_boilerplate_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARERS", 6)
    monkeypatch.setattr(neardup, "PART_SHARERS", 9)
    rng, texts = random.Random(4), []
    blocks = [[" ".join(f"b{i}v{v}w{j}" for j in range(5)) for v in (0, 1)] for i in range(30)]
    for _ in range(70):
        pick = [rng.randrange(2) for _ in blocks]
        texts += [" ".join(b[v] for b, v in zip(blocks, pick, strict=True))] * rng.choice([1, 1, 2])
        if rng.random() < 0.5:  # a partner that is alike
            pick[rng.randrange(30)] ^= 1
            texts.append(" ".join(b[v] for b, v in zip(blocks, pick, strict=True)))
    page = " ".join(f"page{i}" for i in range(150))
    texts += [f"{page} " + " ".join(f"own{i}x{j}" for j in range(rng.randrange(0, 40))) for i in range(40)]
    texts += [page.replace("page7 ", f"v{i} ") for i in range(40)] + ["short one here now again"] * 3 + [f"short one here now v{i}" for i in range(9)]
    sets, parent = [_sets(x, 4) for x in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 85 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    expected = {i: (len(s), find(i)) for i, s in enumerate(sets)}
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(given).collect()} == expected
    assert 20 < len({c for _, c in expected.values()}) < len(texts) - 60


def test_count_tree_reaches_all_that_qualify():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 5, (700, neardup.GROUPS)).astype(np.int32)
    sizes = points.sum(axis=1)
    tree = neardup.CountTree(points, sizes)
    for i in range(0, 700, 50):
        bound = np.minimum(points, points[i]).sum(axis=1)
        need = 185 * bound >= 85 * (sizes + sizes[i])
        need &= (sizes * 85 <= sizes[i] * 100) & (sizes * 100 >= sizes[i] * 85)
        assert set(np.flatnonzero(need)) <= set(tree.reach(points[i], int(sizes[i]), 85, 100).tolist())


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)] + [(-5, 7)]
    got = {r.node: r.component for r in graphs.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    sets = graphs.UnionFind()
    for a, b in edges:
        sets.join(a, b)
    assert got == {x: sets.find(x) for e in edges if e[0] != e[1] for x in e}
    assert graphs.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("size,overlap", [(32_768, 1_024), (300, 40), (64, 30)])
def test_bpe_equals_tiktoken(docs, empty, vocabulary, size, overlap):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.ranks.splitlines())}
    reference = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode_documents(bpe.encode_documents(docs, vocabulary, size, overlap), vocabulary).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == Counter((r.doc_id, tuple(reference.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert bpe.encode_documents(empty, vocabulary).count() == 0


def test_stitch_any_cut(vocabulary):
    rng, find = random.Random(5), bpe.coder(vocabulary).find
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "1", "'re", "'", "!", "é", "z" * 50, " " * 40]) for _ in range(rng.randrange(1, 120)))
        size, overlap = rng.randrange(20, 60), rng.randrange(1, 40)
        chunks = bpe.cut_chunks(text, size, overlap)
        assert bpe.stitch([(c, find(c)) for c in chunks], size, find) == find(text)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def _base(text):
    return [(k, m.start(), m.end()) for k, (_, p, f) in enumerate(RULES) for m in re.finditer(p, text) if f(m[0])]


def test_base_spans_equal_plain_regexes():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "@", "b.c", ".", "1", "22", "255", "256", "1.2.3.4", "+1", " ", "-", "(5)", "4111111111111111", "x@y.z", "é"]) for _ in range(rng.randrange(1, 30)))
        assert pii.base_spans(text) == _base(text), text
    pii.base_spans("a" * 300_000 + "@" + "1" * 300_000 + "." + "+1" + "(" * 300_000)


def test_private_spans(docs, empty):
    found = {r.doc_id: r for r in pii.find_private(docs.where("doc_id is not null")).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, r in found.items():
        assert [tuple(x) for x in r.base] == _base(texts[i])
        assert [tuple(x) for x in r.base] == [tuple(x) for x in r.spans if tuple(x) in {tuple(y) for y in r.base}]
    assert [pii.KINDS[x.kind] for x in found[301].base] == ["email", "ip", "card", "phone"]
    assert "secret" in [pii.KINDS[x.kind] for x in found[301].spans]
    assert pii.find_private(empty).count() == 0


@pytest.mark.parametrize("size", [16, 256, 257, 1000, 100_000])
def test_secrets_of_any_length_are_whole_candidates(size):
    secret = ("aB3_+/-x" * size)[:size]
    text = f"the api token = '{secret}' and more"
    at = text.index(secret)
    assert pii.candidate_spans(text, pii.base_spans(text)) == [(4, at, at + size, False)]
    assert pii.votes_of(text, 4, at, at + size, False)[0][4] == 1  # nothing of it goes on behind its end


def test_em_finds_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.4
    votes = np.stack([np.where(rng.random(20_000) < right, truth, ~truth) * 2 - 1 for right in (0.95, 0.9, 0.8, 0.7, 0.55)], axis=1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, tables, prior = pii.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.4) < 0.03 and abs(tables[0, 1, 2] - 0.95) < 0.02 and abs(tables[4, 1, 2] - 0.55) < 0.03
    w = pii.fit_classifier(pii.features_of(patterns, np.zeros((len(patterns), 0))), post, counts.astype(float))
    called = (w[0] + pii.features_of(patterns, np.zeros((len(patterns), 0))) @ w[1:] > 0)[at.ravel()]
    assert (called == truth).mean() > 0.94


def test_mix(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(_words(r.text))
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1] * 9))  # noqa: B905
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], level * weight[s]) for s in sizes) < 1.5 * sum(sizes.values()) else (low, level)
    taken, largest = defaultdict(int), max(r.size for r in rows)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(_words(r.text))) for r in docs.collect())
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(min(2 * sizes[r.source], high * weight[r.source]), rel=1e-6)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        target = {r.source: r.target}
        assert target[r.source] <= 2 * r.source_size
    for r in rows:
        assert abs(taken[r.source] - r.target) <= largest
    mixed = Counter(r.doc_id for r in mixing.apply_mix(docs.where("doc_id < 200")).collect())
    again = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(docs.where("doc_id < 200")).collect() if r.taken}
    assert mixed == again and mixing.mix_sources(empty).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))


def _repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)})


def test_quality_rules(docs, empty, spark):
    labels = spark.createDataFrame([(10, 1, 0), (50, 1, 0), (60, 1, 0), (70, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    spread = lambda t: [(int.from_bytes(t[i : i + 4], "big") * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(t) - 3)]
    for r in docs.collect():
        for b in spread((r.text or "").encode()):
            raw[b] += 1
            target[b] += r.doc_id in (10, 50, 60)
    share = (raw + 1) / (raw.sum() + quality.BUCKETS)
    ratio = np.rint(np.log((target + quality.PRIOR * share) / (target.sum() + quality.PRIOR) / share) * quality.SCALE).astype(int)
    assert len(got) == docs.count()
    for r in got:
        t, words = r.text or "", _words(r.text)
        lines = [x for x in t.split("\n") if _words(x)]
        grams = spread(t.encode())
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), _repeats(words))
        assert r.llr == (sum(ratio[b] for b in grams) // len(grams) if grams else 0)
        assert r.base_failed == (len(words) < 50 or 100 * _repeats(words) > 50 * len(words)) and r.kept == (not r.base_failed and r.llr >= -350_000)
    assert quality.score_quality(empty, labels).count() == 0
    assert all(r.llr == 0 for r in quality.score_quality(docs, labels.limit(0)).collect())


@pytest.mark.parametrize("shards", [16, 3])
def test_shards(docs, empty, shards):
    rows = sharding.pack_shards(docs, shards, grain=8).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    total = sum(r.size for r in rows)
    together = defaultdict(set)
    for r in rows:
        together[r.text_crc32].add(r.shard)
    sizes = Counter()
    for r in rows:
        sizes[r.text_crc32] += r.size
    assert all(len(s) == 1 for c, s in together.items() if sizes[c] <= total // shards)
    assert set(by) <= set(range(shards)) and sharding.pack_shards(empty).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(60):
        items = [(rng.randrange(1, 40), i) for i in range(rng.randrange(1, 60))]
        placed = sharding.best_fit_decreasing(items, 50)
        room = []
        for size, name in sorted(items, key=lambda x: (-x[0], str(x[1]))):
            fits = [(r, b) for b, r in enumerate(room) if r >= size]
            if not fits:
                room.append(50)
                fits = [(50, len(room) - 1)]
            b = min(fits)[1]
            room[b] -= size
            assert placed[name] == b


PAGES = [(5, "http://a/é b", "same"), (3, None, "same"), (9, "http://c", None), (2, "u\nv", ""), (4, "u", "日本" * 5000), (None, "u", "same"), (7, "u", "same"), (11, "u", "x"), (11, "u", "x"), (None, "u", "only null ids")]


@pytest.mark.parametrize("frame", [1, 100, 1 << 18])
def test_warc_round_trip(spark, frame):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(2)
    folder = warc.common.scratch_dir(spark)
    index = warc.write_warc(pages, folder, frame_bytes=frame, archive_bytes=500)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, None if r.payload is None else bytes(r.payload)) for r in warc.read_warc(index, folder).collect())
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    expected = Counter()
    for p, _, h in PAGES:
        raw = (h or "").encode()
        again = (h or "") in first and p != first[h or ""]
        expected[(p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", None if again else raw)] += 1
    assert got == expected
    assert warc.read_warc(warc.write_warc(pages.limit(0)), folder).count() == 0


def test_line_dedup(docs, empty):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.dedup_lines(docs, batches=3).collect())
    key = lambda x: x.strip(linededup.STRIPPED).translate(LOWER)
    holders = defaultdict(set)
    for r in docs.collect():
        if r.doc_id is not None:
            for x in (r.text or "").split("\n"):
                holders[key(x)].add(r.doc_id)
    expected = Counter()
    for r in docs.collect():
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if r.doc_id is None or len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == r.doc_id]
        expected[(r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert got == expected and any(k[2] for k in got)
    assert linededup.dedup_lines(empty).count() == 0


def test_line_runs_compact(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(bytes([h]), 100 - b * 10) for h in range(b, b + 3)], "h binary, doc_id long"))
    got = {bytes(r.h)[0]: (r.n_docs, r.owner) for r in runs.entries().collect()}
    assert got == {h: (sum(b <= h < b + 3 for b in range(5)), 100 - 10 * max(0, h - 2)) for h in range(7)}
    assert len(runs.levels) > 1 and sum(map(len, runs.levels)) <= 3


def test_audio(docs, empty):
    media = audio.store_text_media(docs.select("doc_id", "text", "lang")).drop("text")
    got = audio.audio_features(media).withColumn("feature", audio.feature_digest()).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_payload = defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            assert bytes(r.payload) == padded and len(r.media) == len(padded) + 44
        table = audio.read_tensors(bytes(r.tensors))
        assert table["tensor"].type.shape == [audio.FRAMES, audio.MELS] and table["end_s"][-1].as_py() == pytest.approx(r.n_frames * audio.HOP / 8000)
        by_payload[bytes(r.payload)].add(r.feature)
    assert all(len(x) == 1 for x in by_payload.values()) and len(got) == docs.count()
    assert audio.audio_features(audio.store_text_media(empty)).count() == 0


@pytest.mark.parametrize("up,down", [(1, 2), (3, 2), (2, 3), (1, 1)])
def test_polyphase_equals_plain_resampling(up, down):
    x = np.random.default_rng(0).normal(size=301).astype(np.float32)
    h = audio.lowpass(up, down)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    plain = np.convolve(stuffed, h)[len(h) // 2 :][: len(stuffed)][::down]
    y = audio.resample(x, up, down)
    assert np.allclose(y, plain[: len(y)], atol=1e-4) and len(y) == -(-301 * up // down)


def test_hysteresis():
    db = np.array([0, 0, 0, 2, 0.5, 0.5, 2, -3, 0, 0, 0, 3, -3, 0.0])
    assert audio.active_segments(db).tolist() == [[3, 7], [11, 12]]


def test_line_runs_take_a_later_batch_in_stored_runs(spark):
    batches = [[(b"a", 9), (b"a", 8), (b"b", 9)], [(b"a", 7), (b"c", 7)], [(b"c", 5), (b"d", 5)], [(b"a", 20), (b"d", 20), (b"e", 20)]]
    runs = linededup.LineRuns(spark)
    for b in batches[:3]:
        runs.add(spark.createDataFrame(b, "h binary, doc_id long"))
    runs.close()
    later = linededup.LineRuns(spark, runs.root)
    assert later.levels == runs.levels and later.buckets == runs.buckets
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        later.add(spark.createDataFrame(batches[3], "h binary, doc_id long"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {bytes(r.h): (r.n_docs, r.owner) for r in linededup.LineRuns(spark, runs.root).entries().collect()}
    assert got == {b"a": (4, 9), b"b": (1, 9), b"c": (2, 7), b"d": (2, 5), b"e": (1, 20)}


def test_line_runs_are_merged_without_a_shuffle(spark):
    runs = linededup.LineRuns(spark, fanout=4)
    for b in range(3):
        runs.add(spark.createDataFrame([(bytes([h]), b) for h in range(b, b + 9)], "h binary, doc_id long"))
    with linededup._sorted_buckets(spark):
        plan = runs.entries()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_frequent_lines_meet_apart(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HEAVY", 4)
    line = "a line of twenty characters or more, number"
    rows = [(i, "\n".join([f"{line} {i % 7}", f"{line} hot", f"{line} own {i}"])) for i in range(40)]
    got = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i < 33) + (i < 39) for i in range(40)}


@pytest.mark.parametrize("page", [0, 1, -1, 2**62 - 1, 2**62, -(2**62) - 1, 2**63 - 1, -(2**63), None])
def test_record_ids_hold_page_ids(page):
    name = warc.record_name(page)
    assert warc.page_of(name) == page
    assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", name)


def test_revisits_without_a_broadcast_and_with_clashing_columns(spark):
    pages = spark.createDataFrame([(p, u, h, 1, "x", b"y", 2) for p, u, h in PAGES], "page_id long, url string, html string, _sha int, record_type string, payload binary, refers_to int")
    few, many = (Counter((r.page_id, bytes(r.payload), r.record_type, r.refers_to) for r in warc.mark_revisits(pages, max_broadcast_rows=n).collect()) for n in (100, 0))
    assert few == many and sum(few.values()) == len(PAGES)


@pytest.mark.parametrize("uri,path", [("file:///tmp/x", "/tmp/x"), ("dbfs:/a/b", "/dbfs/a/b")])
def test_folders_by_spark_names(uri, path):
    assert warc.open_folder(uri)[1] == path


def test_slices_follow_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 100, None, "b" * 1000, "c"]), pa.array([[1] * 400, None, [2] * 100, [2]], pa.list_(pa.int32()))], names=["text", "ids"])
    for column in ("text", "ids"):
        parts = list(warc.common.slices([batch], column, 200))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 1


def test_scratch_is_cleared(spark, tmp_path):
    import os

    folder = warc.common.scratch_dir(spark)
    spark.range(3).write.parquet(folder)
    assert os.path.isdir(folder.removeprefix("file://"))
    before, warc.common._FOLDERS[:] = warc.common._FOLDERS[:-1], [folder]
    warc.common.clear_scratch(spark)
    warc.common._FOLDERS[:] = before
    assert not os.path.exists(folder.removeprefix("file://"))


def _luhn_number(rng, start, size):
    body = start + "".join(rng.choice("0123456789") for _ in range(size - len(start) - 1))
    return next(body + c for c in "0123456789" if pii.luhn(body + c))


def _planted(rng, i):
    """(text, spans that are private, spans that look so)."""
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(3, 9)))
    filler = lambda n: " ".join(word() for _ in range(n))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    not_luhn = lambda n: next(x for x in iter(lambda: number(n), None) if not pii.luhn(x))
    key = "".join(rng.choice("ABCDEFabcdef0123456789xyzXYZ") for _ in range(32))
    good = [
        ("contact me by mail: ", f"{word()} at {word()} dot org"), ("please call my phone ", f"({rng.randrange(201, 989)}) {rng.randrange(201, 989)}-{number(4)}"),
        ("paid by credit card ", _luhn_number(rng, rng.choice(["34", "37"]), 15)), ("my api token = ", key), ("password: ", "hunter" + number(12) + "Ab"),
        ("login from host ", ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8))),
    ]
    bad = [("see order ", not_luhn(14)), ("isbn ", not_luhn(13)), ("the path: ", "/".join(["usr", word(), word(), word(), word()])), ("item serial ", not_luhn(15)), ("file=", "_".join([word(), word(), word(), word()]))]
    lead, span = rng.choice(good) if i % 2 else rng.choice(bad)
    text = filler(20) + " " + lead
    return text + span + " " + filler(10), (len(text), len(text) + len(span)), i % 2


def test_planted_spans_are_found_and_look_alikes_left(spark):
    rng = random.Random(12)
    made = [_planted(rng, i) for i in range(1200)]
    found = {r.doc_id: {(x.start, x.end) for x in r.spans} for r in pii.find_private(spark.createDataFrame([(i, m[0]) for i, m in enumerate(made)], "doc_id long, text string")).collect()}
    hits = sum(at in found[i] for i, (_, at, good) in enumerate(made) if good)
    wrong = sum(bool(found[i]) for i, (_, _, good) in enumerate(made) if not good)
    assert hits >= 0.9 * 600 and hits / (hits + wrong) >= 0.9, (hits, wrong)


def test_private_spans_of_rows_without_an_id(spark):
    rows = [(None, "mail a@b.cd"), (None, None), (None, "mail a@b.cd"), (1, "")]
    got = Counter((r.doc_id, tuple(tuple(x) for x in r.base)) for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(None, ((0, 5, 11),)): 2, (None, ()): 1, (1, ()): 1}


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(400):
        n, k = rng.randrange(80), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        p = rng.randrange(1, n) if n > 1 and rng.random() < 0.5 else n
        w = [w[i % p] if i >= n // 5 else w[i] for i in range(n)]
        found = {}
        for q in range(1, n // 2 + 1):
            i = 0
            while i + q < n:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                if j > i and j - i + q >= max(least, 2 * q):
                    found.setdefault((i, j - i + q), q)
                i = j + 1
        assert runs.periodic_runs(np.array(w, np.int64), least) == sorted(((a, m, q) for (a, m), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_keep_columns(spark, docs, empty):
    got = runs.find_runs(docs, keep=("source", "doc_id", "_row"))
    assert got.columns == ["source", "doc_id", "_row", "runs", "collapsed"] and got.count() == docs.count()
    assert runs.find_runs(empty).count() == 0
    repeated = runs.find_runs(spark.createDataFrame([("one two three " * 6 + "end",)], "body string"), "body", keep=()).first()
    assert [tuple(x) for x in repeated.runs] == [(0, 18, 3)] and repeated.collapsed == "one two three end"


def test_token_counts_equal_the_library(empty):
    rules = tokencount.Rules.load(public_tokenizers.path("byte_bpe_50k.json"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, counter = random.Random(3), tokencount.Counter(rules, max_states=400)  # forgets again and again
    parts = ["a", "b", " ", "  ", "\n", "\t", "1", "23", "'re", "'", "'s", "'ll", "'l", "'v", "!", "é", "z" * 9, "日本", "\u3000", "<|endoftext|>", "ing", "tion", "😀", "\x85", "²", "r", "e", "\r\n", "'e", "\U00031350", "\u0558"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    assert counter.counts(texts).tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert tokencount.count_tokens(empty, rules).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 7, 64])
def test_chunk_maps_compose(chunk):
    rng = np.random.default_rng(chunk)
    classes = rng.integers(0, 12, 5000).astype(np.uint8)
    assert (tokencount.borders(classes, chunk) == tokencount.borders(classes, 10_000)).all()


def _audit(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = Counter()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        part = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        parts, q = {s: part(counts[lang, s]) for s in sources}, part(whole)
        for s, p in parts.items():
            pairs = [(-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), x.encode()) for x, o in parts.items() if x != s]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for name, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out.update((lang, s, name, item.decode(), -value, i) for i, (value, item) in enumerate(found, 1))
    return out


@pytest.mark.parametrize("least,how", [(3, {}), (2, {"block_bytes": 2000, "fan_in": 4, "shards": 3}), (1000, {})])
def test_audit_equals_brute_force(spark, docs, empty, monkeypatch, least, how):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    rows += [("Aé a-a zz top ZZ", "xx", s) for s in ("a", "b", "b", None, "é", "\U0001f600")] + [("1 2 3", "none", "a"), ("", "none", "b"), ("only here", "one", "a")] * 2
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, item string, rank int").repartition(5)
    expected = _audit(rows, least, 5)
    assert Counter(map(tuple, divergence.audit_sources(given, least, 5, **how).collect())) == expected
    assert divergence.audit_sources(empty).count() == 0
    if how:  # many groups: totals are joined, and sums are handed on in pieces
        monkeypatch.setattr(divergence, "MAX_GROUPS", 2)
        monkeypatch.setattr(divergence, "MAX_PAIRS", 3)
        assert Counter(map(tuple, divergence.audit_sources(given, least, 5, **how).collect())) == expected


def test_runs_merge_through_the_heap(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 3)
    rng, runs_, expected = random.Random(9), [], Counter()
    for _ in range(7):
        rows = sorted({(rng.choice("ab"), f"t{rng.randrange(30)}é"[: rng.randrange(2, 5)], rng.choice("xyz")) for _ in range(rng.randrange(0, 60))})
        runs_.append(divergence._pack(pa.table([*map(list, zip(*rows)), [1] * len(rows), [2] * len(rows)] if rows else [[]] * 5, schema=divergence.POSTINGS)))  # noqa: B905
        expected.update(rows)
    tables = list(divergence._merged(runs_, rows=10))
    got = [tuple(r.values()) for t in tables for r in t.to_pylist()]
    assert [r[:3] for r in got] == sorted(expected) and all(r[3:] == (expected[r[:3]], 2 * expected[r[:3]]) for r in got) and len(tables) > 3
    ends = [(t["lang"][-1].as_py(), t["term"][-1].as_py()) for t in tables if t.num_rows]
    assert len(set(ends)) == len(ends)


def test_mix_shuffles_rows_without_ids(spark):
    rows = [(None, "big", " ".join(f"w{i}" for _ in range(3 if i % 2 else 40))) for i in range(1000)] + [(i, "small", "a b c") for i in range(50)]
    given = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = Counter((r.size, r.taken > 0) for r in mixing.mix_sources(given.repartition(3), share_pct=50).collect() if r.source == "big")
    shares = [taken[(n, True)] / 500 for n in (3, 40)]
    assert 0.3 < min(shares) and abs(shares[0] - shares[1]) < 0.12
    assert sorted(map(tuple, mixing.mix_sources(given, share_pct=50).drop("queue_pos").collect()), key=str) == sorted(map(tuple, mixing.mix_sources(given.repartition(7), share_pct=50).drop("queue_pos").collect()), key=str)


def test_accepted_spans_stand_apart(spark):
    assert pii.apart([(0, 5, 9)], [(0.9, 4, 10, 30), (0.8, 3, 12, 20), (0.95, 2, 8, 11), (0.7, 1, 30, 34), (0.7, 3, 32, 40)]) == [(0, 5, 9), (4, 10, 30), (3, 32, 40)]
    assert pii.apart([], [(0.6, 3, 0, 5), (0.7, 3, 3, 9), (0.5, 3, 9, 12)]) == [(3, 3, 9), (3, 9, 12)]
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [(i, f"key=2125{number(6)}-212-555-{number(4)}aa and call 212-555-{number(4)} or token: x{number(9)}abcDEF{number(4)}") for i in range(300)]
    for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = sorted((x.start, x.end) for x in r.spans)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize("before,kind", [("appelez le ", 3), ("téléphone: ", 3), ("Telefon ", 3), ("bitte anrufen ", 3), ("llame al ", 3), ("mi correo es ", 0), ("Kreditkarte ", 2), ("tarjeta ", 2), ("Rechner ", 1), ("contraseña=", 4)])
def test_context_words_of_four_languages(before, kind):
    span = {0: "a.b@c.de", 1: "10.20.30.40", 2: "4111111111111111", 3: "212-555-0100", 4: "abcd1234efgh5678"}[kind]
    assert pii.votes_of(before + span, kind, len(before), len(before) + len(span), False)[0][3] == 1
    assert pii.votes_of("Seriennummer " + span, kind, 13, 13 + len(span), False)[0][3] == -1
