"""The registered queries over whole awkward tables: every column of their contracts against brute force."""

import base64
import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from corpusloom.llm import audio, bpe, registry
from tests.llm.test_operators import LOWER, PAGES, RULES, SCHEMA, _base, _repeats, _rows, _words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [r for r in _rows() if r[0] != 201]  # a word of 60,000 letters takes the tokenizer long
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(10, 1, 0), (50, 1, 0), (70, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder), [(r[0], r[1] or "") for r in rows]


def _run(spark, tables, name):
    return registry.queries()[name](spark, tables[0]).collect()


def test_op1(spark, tables):
    rows = tables[1]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = Counter(w for i, x in rows if not held(i) for w in [*_words(x.translate(LOWER)), None])
    n, v = sum(words.values()), len(words)
    got, expected = defaultdict(list), defaultdict(list)
    for r in _run(spark, tables, "op1_ppm_score"):
        assert r.score < 0
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score))
    for i, x in rows:
        tokens = [*_words(x.translate(LOWER)), None]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        expected[i].append((held(i), len(tokens), sum(words[w] > 0 for w in tokens), n, base))
    assert set(got) == set(expected)
    for i in got:
        assert sorted(got[i]) == [pytest.approx(x, rel=1e-9) for x in sorted(expected[i])]


def test_op3(spark, tables):
    v = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, v.ranks.splitlines())}
    plain = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for i, x in tables[1]:
        ids = plain.encode_ordinary(x)
        expected[(i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(x.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in _run(spark, tables, "op3_byte_bpe")) == expected


def test_op4(spark, tables):
    names, expected = [r[0] for r in RULES], Counter()
    for i, x in tables[1]:
        spans = _base(x)
        told = ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)
        expected[(i, *[sum(k == j for k, _, _ in spans) for j in range(4)], hashlib.sha256(told.encode()).hexdigest())] += 1
    got = _run(spark, tables, "op4_private_spans")
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == expected
    for r in got:
        spans = [x for x in r.spans.split(",") if x]
        assert len(spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone and spans == sorted(spans, key=lambda x: ([*names, "secret"].index(x.split(":")[0]), int(x.split(":")[1])))


def test_op6(spark, tables):
    expected = Counter()
    for i, x in tables[1]:
        words, lines = _words(x), [y for y in x.split("\n") if _words(y)]
        failed = len(words) < 50 or 100 * _repeats(words) > 50 * len(words)
        expected[(i, len(words), sum(map(len, words)), sum(x.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), _repeats(words), failed)] += 1
    got = _run(spark, tables, "op6_quality_llr")
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_op7_by_bytes_whatever_the_files(spark, tables, tmp_path):
    got = _run(spark, tables, "op7_pack_shards")
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(x.encode()) + 1, zlib.crc32(x.encode())) for i, x in tables[1])
    by, of = defaultdict(list), defaultdict(set)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        by[r.shard].append(r.slot)
        of[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(s) == 1 for s in of.values())
    spark.read.parquet(f"{tables[0]}/documents.parquet").orderBy(F.desc("n_chars")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    again = registry.queries()["op7_pack_shards"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_op8(spark, tables):
    first, expected = {}, Counter()
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    for p, _, h in PAGES:
        raw, one = (h or "").encode(), first.get(h or "")
        again = one is not None and p != one
        expected[(p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", one if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in _run(spark, tables, "op8_warc_bundles")) == expected


def test_op10(spark, tables):
    expected, feature = Counter(), defaultdict(set)
    for i, x in tables[1]:
        raw = x.encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        media = audio.to_wav(padded)
        expected[(i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(media), hashlib.sha256(media).hexdigest())] += 1
    got = _run(spark, tables, "op10_audio_features")
    for r in got:
        feature[r.payload_sha256].add(r.feature)
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == expected
    assert all(len(f) == 1 for f in feature.values()) and len({next(iter(f)) for f in feature.values()}) == len(feature)


def _plain_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_op11(spark, tables, tmp_path):
    rows = [(i, x if len(x) < 5000 else x[:4000]) for i, x in tables[1]] + [(400 + i, f"a b c d e f g\tx y {i} " * 9 + "tail word \xa0 end") for i in range(60)]
    rows += [(500, "z " * 300), (501, "a b a c " * 40 + "q " + "b a c a " * 40), (502, " ".join(f"w{i}" for i in range(900))), (None, "x y " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    expected, periodic = Counter(), 0
    for i, x in rows:
        w, h = _words(x), zlib.crc32(("" if i is None else str(i)).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = _plain_runs(w)
        periodic += bool(found)
        gone = {j for s, m, q in found for j in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        kept = " ".join(y for j, y in enumerate(w) if j not in gone)
        expected[(i, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = registry.queries()["op11_word_runs"](spark, str(tmp_path)).collect()
    assert periodic > 60
    assert Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got) == expected


def test_op12(spark, tables, tmp_path):
    odd = ["<|endoftext|>", "a<|endoftext|> <|endoftext|>'s", "don't we'll 're 'tis  'v x", " \u3000 \x85\t\n", "ab" * 700 + " x" * 900]
    rows = [*tables[1], *((600 + i, x) for i, x in enumerate(odd))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = [len(x.ids) for x in library.encode_batch([x for _, x in rows], add_special_tokens=False)]
    expected = Counter((i, len(x.encode()), n, n > 1024) for (i, x), n in zip(rows, counts, strict=True))
    got = registry.queries()["op12_token_counts"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == expected


def test_whole_groups_above_a_fair_share(spark, tmp_path):
    rows = [(i, "the same long text " * 20) for i in range(60)] + [(100 + i, f"text {i} " * (10 + i % 7)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op7_pack_shards"](spark, str(tmp_path)).collect()
    hot = {r.shard for r in got if r.doc_id < 100}
    assert len(hot) == 1 and not any(r.shard in hot for r in got if r.doc_id >= 100)
    sizes = Counter()
    for r in got:
        if r.shard not in hot:
            sizes[r.shard] += r.size
    assert len(sizes) == 15 and max(sizes.values()) - min(sizes.values()) <= 130
