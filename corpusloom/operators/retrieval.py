"""Dense, lexical and hybrid retrieval for batches of queries, and similarity joins of vectors.

Queries are a table; every operator answers all of them at once. Chunks are (chunk_id, note_path, vec, ...).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.sources.scratch import materialise


def top_k(scored: DataFrame, k: int, by: str, *order: str, score: str = "score") -> DataFrame:
    """The k best rows of each ``by`` with rank from 1; Spark keeps k rows a task before it shuffles."""
    over = Window.partitionBy(by).orderBy(F.desc(score), *order)
    return scored.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


#: Queries that go to all tasks at once; more are met in blocks.
MAX_QUERIES = 10_000
#: Scores of words that a task works out at a time.
SCORES = 1 << 21
#: Products of vectors that a task works out at a time, and entries that it holds before it drops what is not among the best.
PRODUCTS = 1 << 18
#: Best entries of all queries that a task holds: with many a query, fewer queries go to all tasks at once.
MAX_BEST = 1 << 20
#: Vectors that are turned into a matrix at a time.
ROWS = 2048


class _Best:
    """The ``keep`` best (score, chunk) of each of n queries, ties to the lower chunk, from scores given in any order.

    Not more than twice n * keep entries are held, or n * keep and PRODUCTS if that is more, beside what one call of
    ``add`` brings; so the memory of a task follows the queries that it was given and not the chunks that it reads.
    """

    def __init__(self, n: int, keep: int):
        self.n, self.keep, self.size = n, keep, 0
        self.floor, self.held = np.full(n, -np.inf), []  # a query's keep-th best so far, and (query, score, chunk) above it
        self.last = np.full(n, np.iinfo(np.int64).max)  # the chunk of that keep-th best
        self.most = n * keep + max(PRODUCTS, n * keep)

    def add(self, q: np.ndarray, s: np.ndarray, c: np.ndarray) -> None:
        floor = self.floor[q]
        fit = (s > floor) | ((s == floor) & (c < self.last[q]))
        self.held.append((q[fit].astype(np.int32), s[fit], c[fit]))
        self.size += len(self.held[-1][0])
        if self.size > self.most:
            self.held = [self.rows()]
            self.size = len(self.held[0][0])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, s, c = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64))  # noqa: B905
        self.held = []
        order = np.lexsort((c, -s, q))
        start = np.concatenate(([0], np.cumsum(np.bincount(q, minlength=self.n))))  # of each query in that order
        order = order[np.arange(len(q)) - np.repeat(start[:-1], np.diff(start)) < self.keep]
        q, s, c = q[order], s[order], c[order]
        ends = np.cumsum(np.bincount(q, minlength=self.n))
        full = np.flatnonzero(np.diff(ends, prepend=0) == self.keep)
        self.floor[full], self.last[full] = s[ends[full] - 1], c[ends[full] - 1]
        return q, s, c


def _rank_all(best: _Best, asked: np.ndarray, rows: np.ndarray, chunk: np.ndarray, at: np.ndarray | None = None) -> None:
    """Offers ``best`` the products of all ``asked`` with all ``rows``, PRODUCTS of them at a time.

    ``at`` are the places of ``asked`` among the queries of ``best``, all of them if not given. A matrix product rounds by
    the shape of its operands; what may be among the best is worked out again in one fixed order, so that equal
    vectors have equal scores. Products of whole numbers (float32 codes too) are exact as they are.
    """
    at = np.arange(len(asked)) if at is None else at
    if not len(asked) or not len(rows):
        return
    exact = asked.dtype == np.float32
    length = np.linalg.norm(rows, axis=1)
    slack = np.zeros(len(asked)) if exact else 1e-11 * np.linalg.norm(asked, axis=1) * length[np.isfinite(length)].max(initial=0)
    tile, few = max(1, PRODUCTS // len(asked)), max(1, PRODUCTS // rows.shape[1])
    for i in range(0, len(rows), tile):
        part, ids = rows[i : i + tile], chunk[i : i + tile]
        scores = asked @ part.T
        q, c = np.nonzero(scores >= (best.floor[at] - slack)[:, None])
        if exact:
            best.add(at[q], scores[q, c].astype(np.float64), ids[c])
            continue
        for j in range(0, len(q), few):
            x, y = q[j : j + few], c[j : j + few]
            best.add(at[x], (asked[x] * part[y]).sum(axis=1), ids[y])


SCORED = "query_id long, chunk_id long, score double"


def queries_at_once(keep: int, most: int = MAX_QUERIES) -> int:
    """Queries that may go to a task that holds the ``keep`` best of each."""
    return max(1, min(most, MAX_BEST // max(1, keep)))


def _scored(ids: np.ndarray, best: _Best) -> pa.RecordBatch:
    q, s, c = best.rows()
    return pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "chunk_id", "score"])


def score_queries(chunks: DataFrame, queries: DataFrame, keep: int, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query_id, chunk_id, score): exact dot products; at least the ``keep`` best of each query, a few from each task.

    Queries are counted first. Up to ``max_queries`` they go to all tasks and each task sends its best; a larger set is
    dealt to blocks that meet blocks of chunks, so that a task holds one block of either.
    """
    max_queries = queries_at_once(keep, max_queries)
    asked = queries.select("query_id", "vec").limit(max_queries + 1).toArrow()
    if asked.num_rows > max_queries:
        return _score_blocks(chunks, queries, keep, max_queries)
    shared = queries.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), _matrix(asked["vec"].combine_chunks())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best = _Best(len(ids), keep)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                _rank_all(best, matrix, _matrix(part.column("vec")), part.column("chunk_id").to_numpy())
        yield _scored(ids, best)

    return chunks.select("chunk_id", "vec").mapInArrow(run, SCORED)


def _score_blocks(chunks: DataFrame, queries: DataFrame, keep: int, block: int) -> DataFrame:
    blocks = -(-queries.count() // block)
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("q"), F.col("query_id").alias("id"), "vec", F.lit(True).alias("asked"))
    parts = max(1, -(-chunks.count() // 16_384))
    rows = chunks.select(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("c"), F.col("chunk_id").alias("id"), "vec", F.lit(False).alias("asked"))
    met = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).unionByName(asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))

    def run(table: pa.Table) -> pa.Table:
        mine = np.asarray(table["asked"])
        ids, m = table["id"].to_numpy(), _matrix(table["vec"].combine_chunks())
        best = _Best(int(mine.sum()), keep)
        _rank_all(best, m[mine], m[~mine], ids[~mine])
        return pa.Table.from_batches([_scored(ids[mine], best)])

    return met.groupBy("c", "q").applyInArrow(run, SCORED)


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact cosine top-k, ties by chunk_id."""
    return top_k(score_queries(chunks, queries, k), k, "query_id", "chunk_id")


def quantize_scale(chunks: DataFrame) -> DataFrame:
    """(scale): the largest absolute component over 127, or 1."""
    largest = F.coalesce(F.max(V.largest(F.col("vec"))) / 127, F.lit(1.0))
    return chunks.agg(largest.alias("scale")).select(F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0)).alias("scale"))


def coarse_rescore(chunks: DataFrame, queries: DataFrame, k: int = 10, oversample: int = 8) -> DataFrame:
    """(query_id, chunk_id, score, rank): k * oversample by 8-bit dot product, then the k best of these by cosine."""
    from corpusloom.operators import vector_index as X  # which is built on this module

    scale = X.code_scale(chunks)
    return X.coarse_topk(X.encode(chunks, scale), chunks, queries, scale, k, oversample)


def neighbors(chunks: DataFrame, note_paths: DataFrame | list[str], k: int = 10) -> DataFrame:
    """(note_path, chunk_id, score, rank): nearest chunks of other notes to a note's longest chunk (the first of equals).

    ``note_paths``: the notes asked for, a table (note_path) of any size or a short list.
    """
    asked = F.col("note_path").isin(note_paths) if isinstance(note_paths, list) else None
    mine = chunks.join(note_paths.select("note_path").distinct(), "note_path", "left_semi") if asked is None else chunks.where(asked)
    seed = mine.groupBy("note_path").agg(F.max_by(F.struct("chunk_id", "vec"), F.struct(F.char_length("text"), -F.col("chunk_id"))).alias("s"))
    numbered = seed.select("note_path", F.col("s.chunk_id").alias("query_id"), F.col("s.vec").alias("vec"))
    found = dense_topk(chunks, numbered, 2 * k).select("query_id", "chunk_id", "score")
    named = found.join(numbered.select("query_id", "note_path"), "query_id").join(chunks.select("chunk_id", F.col("note_path").alias("other")), "chunk_id")
    return top_k(named.where("other <> note_path"), k, "note_path", "chunk_id").select("note_path", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def search_in_note(chunks: DataFrame, queries: DataFrame, note_path: str, k: int = 5) -> DataFrame:
    """The note's chunks among the 4k best of all; there can be fewer than k."""
    best = dense_topk(chunks, queries, 4 * k).join(chunks.where(F.col("note_path") == note_path).select("chunk_id"), "chunk_id", "left_semi")
    return top_k(best.drop("rank"), k, "query_id", "chunk_id")


#: Blocks of ``similar_pairs`` at most, unless a block would have more numbers than that; rows of a block at least.
BLOCKS, BLOCK_NUMBERS, BLOCK_ROWS = 24, 1 << 21, 1024


def similar_pairs(chunks: DataFrame, min_score: float = 0.5, block: int | None = None, best: int | None = None, apart: str | None = None) -> DataFrame:
    """(a, b, score) with a < b, of different notes: all pairs of unit vectors with cosine of at least ``min_score``.

    Vectors are dealt to blocks; each pair of blocks is one group that multiplies two matrices a few rows at a time, so a
    task holds two blocks whatever the number of vectors, and only qualifying pairs leave it. A row is sent once for
    each block: there are BLOCKS of them at most, so that what is shuffled follows the number of vectors, until blocks
    have BLOCK_NUMBERS components (786,432 vectors of 64); from there on it grows with the square, as the pairs do.
    ``block`` sets the rows of a block.

    With ``best`` a group sends no more than its so many best pairs (by score, then a, then b), and the best of the whole
    are among them. ``apart``: a column in which the two of a pair must differ, null being a value of its own.
    """
    n, dims = chunks.agg(F.count("*"), F.max(F.size("vec"))).first()
    most = max(BLOCK_ROWS, BLOCK_NUMBERS // max(1, dims or 1))
    blocks = max(1, -(-n // (block or min(most, max(BLOCK_ROWS, -(-n // BLOCKS))))))
    told = ["chunk_id", "note_path", "vec", *([F.col(apart).alias("apart")] if apart else [])]
    placed = chunks.select(*told, F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("x"))
    # block x is needed with every block y: as (x, y) for y >= x and as (y, x) for y < x
    spread = placed.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.select(*(c for c in placed.columns if c != "x"), F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") <= F.col("y")).alias("left"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids, notes, differ = table["chunk_id"].to_numpy(), _numbers(table["note_path"]), _numbers(table["apart"]) if apart else None
        m, left = _matrix(table["vec"].combine_chunks()), np.asarray(table["left"])
        same = table["i"][0].as_py() == table["j"][0].as_py()
        l, r = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        del table
        other, step, few = m[r], max(1, PRODUCTS // max(1, len(r))), max(1, PRODUCTS // m.shape[1])
        found, held, floor = [], 0, min_score
        for s in range(0, len(l), step):
            part = l[s : s + step]
            scores = m[part] @ other.T
            x, y = np.nonzero(scores >= (floor if best is None else floor - 1e-11))
            score, x, y = scores[x, y], part[x], r[y]
            keep = (ids[x] < ids[y] if same else np.ones(len(x), bool)) & (notes[x] != notes[y])
            keep = keep if differ is None else keep & (differ[x] != differ[y])
            score, x, y = score[keep], x[keep], y[keep]
            if best is not None:  # in one order of the sum, so that equal vectors have equal scores
                score = np.concatenate([np.zeros(0), *((m[x[t : t + few]] * m[y[t : t + few]]).sum(axis=1) for t in range(0, len(x), few))])
                score, x, y = score[score >= floor], x[score >= floor], y[score >= floor]
            found.append((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), score))
            held += len(x)
            if held > PRODUCTS:
                if best is None:
                    yield _pair_rows(found)
                found = [] if best is None else [_first(found, best)]
                held, floor = (0, floor) if best is None else (len(found[0][0]), found[0][2].min() if len(found[0][0]) == best else floor)
        yield _pair_rows(found if best is None or not found else [_first(found, best)])

    return spread.groupBy("i", "j").applyInArrow(pair, "a long, b long, score double")


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers; null is one of them."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy()


def _pair_rows(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, score = (np.concatenate(x) for x in zip(*found)) if found else ([], [], [])  # noqa: B905
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())], names=["a", "b", "score"])


def _first(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n first pairs by score from the highest, then a, then b."""
    a, b, score = (np.concatenate(x) for x in zip(*found))  # noqa: B905
    order = np.lexsort((b, a, -score))[:n]
    return a[order], b[order], score[order]


def bridges(chunks: DataFrame, communities: DataFrame, linked: DataFrame, top_n: int | None = 20, min_score: float = 0.5, cross_only: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, score, cross_community, linked): similar chunks of different notes, the best first.

    ``pairs`` (a, b, score) can come from an index (``vector_index.near_pairs``); all pairs are compared if not given, and
    of these only the ``top_n`` best of each group of blocks are joined with what flags them.
    ``communities`` (note_path, community) and ``linked`` (a, b: note paths with a < b) only flag, unless ``cross_only``.
    """
    if pairs is None:
        both = chunks.select("chunk_id", "note_path", "vec")
        both = both.join(communities.select("note_path", "community"), "note_path", "left") if cross_only else both
        pairs = similar_pairs(both, min_score, best=top_n, apart="community" if cross_only else None)
    of = chunks.select("chunk_id", "note_path").join(communities, "note_path", "left")
    named = pairs.join(of.select(F.col("chunk_id").alias("a"), F.col("note_path").alias("na"), F.col("community").alias("ca")), "a")
    named = named.join(of.select(F.col("chunk_id").alias("b"), F.col("note_path").alias("nb"), F.col("community").alias("cb")), "b")
    flagged = named.withColumn("lo", F.least("na", "nb")).withColumn("hi", F.greatest("na", "nb"))
    flagged = flagged.join(linked.select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.lit(True).alias("l")), ["lo", "hi"], "left")
    shown = flagged.select("a", "b", "score", (~F.col("ca").eqNullSafe(F.col("cb"))).alias("cross_community"), F.coalesce("l", F.lit(False)).alias("linked"))
    shown = shown.where("cross_community") if cross_only else shown
    return shown.orderBy(F.desc("score"), "a", "b").limit(top_n) if top_n else shown


# --- lexical


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, terms): each chunk's terms, repeats kept and counted in ``dl``; null texts have none."""
    terms = chunks.select("chunk_id", F.coalesce(terms_of(F.col("text")), F.array().cast("array<string>")).alias("t"))
    return terms.select("chunk_id", F.size("t").cast("long").alias("dl"), F.col("t").alias("terms"))


def _accented() -> tuple[str, str]:
    """Lower-case letters made of a-z and one mark, the plain letters, and marks that stand by themselves (which go)."""
    made = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    made = [(x, d[0]) for x, d in made if len(d) == 2 and "a" <= d[0] <= "z"]
    return "".join(x for x, _ in made) + "".join(map(chr, range(0x300, 0x370))), "".join(d for _, d in made)


def fold_accents(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), *_accented())


def terms_of(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return T.all_groups(fold_accents(text), r"[\p{L}\p{N}]+", 0)


#: Distinct terms of queries that go to all tasks as a filter.
MAX_ASKED = 500_000
#: (query, term) entries that go to all tasks at once, and terms of chunks in a part; more are met in blocks.
MAX_TERMS = 1 << 22


def bm25(index: DataFrame, sizes: DataFrame, queries: DataFrame, k: int = 10, max_terms: int = MAX_TERMS) -> DataFrame:
    """(query_id, chunk_id, score, rank) from postings, sizes (chunks, avg_dl) and queries (query_id, query).

    Terms of a query are joined by or and count as often as they stand in it; k1 is 1.2, b is 0.75; a term's weight
    log((N - n + 0.5) / (n + 0.5)) is 1e-6 where it is not positive. Scores have 9 decimals, ties go to the lower chunk.

    Weighted queries are stored and their entries counted: up to
    ``max_terms`` go to all tasks, each of which sends its k best chunks a query, so that a term which stands in most
    chunks makes no rows of its own; more entries are dealt to blocks that meet parts of the chunks.
    """
    asked = queries.select("query_id", F.explode(terms_of(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # frequencies of asked terms alone; combines before the shuffle
    wanted = asked.select("term").distinct()
    wanted = F.broadcast(wanted) if wanted.limit(MAX_ASKED + 1).count() <= MAX_ASKED else wanted
    spread = index.select(F.explode(F.array_distinct("terms")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    idf = F.ln((F.col("chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    weighed = asked.join(spread, "term").crossJoin(F.broadcast(sizes)).select("query_id", F.struct("term", (F.col("times") * idf * 2.2).alias("w")).alias("t"))  # sizes is one row
    weighed = materialise(weighed.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("query_id", F.col("t.term").alias("terms"), F.col("t.w").alias("w")))
    placed = index.crossJoin(F.broadcast(sizes)).select("chunk_id", (F.col("dl") / F.col("avg_dl")).alias("length"), "terms")
    entries = weighed.agg(F.sum(F.size("terms"))).first()[0] or 0
    if entries > max_terms:
        return top_k(_bm25_blocks(placed, weighed, k, entries, max_terms), k, "query_id", "chunk_id")
    table = weighed.toArrow()
    shared = index.sparkSession.sparkContext.broadcast((table["query_id"].to_numpy(), *_asked_terms(table)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *terms = shared.value
        best = _Best(len(ids), k)
        for batch in batches:
            _weigh(best, terms, batch.column("chunk_id").to_numpy(), batch.column("length").to_numpy(), batch.column("terms"))
        yield _scored(ids, best)

    return top_k(placed.mapInArrow(run, SCORED), k, "query_id", "chunk_id")


def _asked_terms(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of weighted queries, and for term i the queries and weights from start[i] to start[i + 1]."""
    lists = table["terms"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    code, query = coded.indices.to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    order = np.argsort(code, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))))
    return coded.dictionary, start, query[order], table["w"].combine_chunks().flatten().to_numpy()[order]


def _weigh(best: _Best, asked: list, chunk: np.ndarray, length: np.ndarray, lists: pa.Array) -> None:
    """Score chunks against all asked terms: terms of many queries by a matrix product, the others entry by entry."""
    vocabulary, start, query, weight = asked
    n, terms, counts = best.n, len(vocabulary), np.diff(start)
    if not n or not len(chunk):
        return
    common = np.argsort(-counts, kind="stable")[: 4 * SCORES // n]
    common = common[counts[common] * 8 >= n]
    column, matrix = np.full(terms, -1), np.zeros((len(common), n))
    column[common] = np.arange(len(common))
    entry = np.flatnonzero(column[np.repeat(np.arange(terms), counts)] >= 0)
    matrix[column[np.repeat(np.arange(terms), counts)[entry]], query[entry]] = weight[entry]
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy()
    rows = max(1, SCORES // max(n, len(common)))
    for at in range(0, len(chunk), rows):
        many = min(rows, len(chunk) - at)
        first = ends[at - 1] if at else 0
        code, row = codes[first : ends[at + many - 1]], np.repeat(np.arange(many), np.diff(ends[at : at + many], prepend=first))
        pair, tf = np.unique(row[code >= 0] * terms + code[code >= 0], return_counts=True)
        row, code = np.divmod(pair, terms)
        part = tf / (tf + 1.2 * (0.25 + 0.75 * length[at : at + many][row]))
        thick, found = column[code] >= 0, np.zeros((many, len(common)))
        found[row[thick], column[code[thick]]] = part[thick]
        scores = (found @ matrix).ravel()
        row, code, part = row[~thick], code[~thick], part[~thick]
        size = counts[code]
        steps = np.searchsorted(np.cumsum(size), np.arange(SCORES, size.sum() + SCORES, SCORES))
        for a, b in zip((0, *steps), (*steps, len(row))):  # noqa: B905
            r, c, p, m = row[a:b], code[a:b], part[a:b], size[a:b]
            here = np.arange(m.sum()) + np.repeat(start[c] - np.cumsum(m) + m, m)
            np.add.at(scores, np.repeat(r * n, m) + query[here], np.repeat(p, m) * weight[here])
        hit = scores > 0
        scores = np.round(scores, 9).reshape(many, n)
        r, q = np.nonzero(hit.reshape(many, n) & (scores >= best.floor))
        best.add(q, scores[r, q], chunk[at : at + many][r])


def _bm25_blocks(placed: DataFrame, weighed: DataFrame, keep: int, entries: int, most: int) -> DataFrame:
    blocks = -(-entries // most)
    parts = max(1, -(-(placed.agg(F.sum(F.size("terms"))).first()[0] or 0) // most))
    none = F.lit(None).cast("array<double>")
    asked = weighed.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("q"), F.col("query_id").alias("id"), F.lit(0.0).alias("length"), "terms", "w")
    rows = placed.select(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("c"), F.col("chunk_id").alias("id"), "length", "terms", none.alias("w"))
    met = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).unionByName(asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))

    def run(table: pa.Table) -> pa.Table:
        mine = table["w"].is_valid()
        asked, rows = table.filter(mine), table.filter(pc.invert(mine)).combine_chunks()
        ids, best = asked["id"].to_numpy(), _Best(asked.num_rows, keep)
        if asked.num_rows and rows.num_rows:
            _weigh(best, list(_asked_terms(asked)), rows["id"].to_numpy(), rows["length"].to_numpy(), rows["terms"].combine_chunks())
        return pa.Table.from_batches([_scored(ids, best)])

    return met.groupBy("c", "q").applyInArrow(run, SCORED)


def index_sizes(chunks: DataFrame) -> DataFrame:
    """(chunks, avg_dl) over all chunks, those without terms included."""
    return chunks.agg(F.count("*").alias("chunks"), F.avg(F.size(terms_of(F.col("text")))).alias("avg_dl"))


def index_terms(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, sizes) from one pass over the texts: postings are stored, and sizes taken from them."""
    stored = materialise(postings(chunks))
    return stored, stored.agg(F.count("*").alias("chunks"), F.avg("dl").alias("avg_dl"))


# --- fusion, routing, diversity


def rrf(lists: DataFrame, weights: dict[int, float] | None = None, k: int = 60) -> DataFrame:
    """(query_id, id, score, rank) from ranked lists (query_id, list_idx, rank from 0, id).

    score = sum of weight / (k + rank + 1); a list of weight 0 is out; ties by best rank, then its list, then id.
    """
    weight = F.lit(1.0)
    for i, w in (weights or {}).items():
        weight = F.when(F.col("list_idx") == i, F.lit(float(w))).otherwise(weight)
    weighed = lists.withColumn("_w", F.col("weight") if "weight" in lists.columns else weight).where("_w <> 0")
    summed = weighed.groupBy("query_id", "id").agg(F.round(F.sum(F.col("_w") / (k + F.col("rank") + 1)), 12).alias("score"), F.min(F.struct("rank", "list_idx")).alias("best"))
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "best", "id")
    return summed.withColumn("rank", F.row_number().over(over)).drop("best")


def intent(query: Column) -> Column:
    """specific, broad or mixed, by quotes, acronyms, inner capitals and length."""
    q, n = F.trim(query), F.regexp_count(F.trim(query), F.lit(r"[\p{L}\p{N}]+"))
    told = q.rlike("\"[^\"]+\"|“[^”]+”") | q.rlike(r"\b[A-Z]{3,}\b") | q.rlike(r"\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b") | (n <= 3)
    return F.when(q == "", "mixed").when(told, "specific").when(n >= 8, "broad").otherwise("mixed")


def intent_weights(kind: Column) -> tuple[Column, Column]:
    """(vector weight, lexical weight)."""
    return F.lit(1.0), F.when(kind == "specific", 0.4).when(kind == "broad", 0.0).otherwise(1.0)


def diversify(candidates: DataFrame, k: int, weight: float) -> DataFrame:
    """(query_id, id, pick) from (query_id, id, score, vec), at most a few thousand a query.

    Greedy: each pick has the greatest weight * relevance + (1 - weight) * distance to the nearest pick; relevance is
    the score over its query's range, distance is 1 - cosine, at least 0, and 1 before any pick; ties to the lower id.
    """

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        s, m, ids = table["score"].to_numpy(), _matrix(table["vec"].combine_chunks()), table["id"].to_numpy()
        span = s.max() - s.min()
        rel = (s - s.min()) / span if span > 0 else np.ones(len(s))
        near, free, out = np.ones(len(s)), np.ones(len(s), bool), []
        while free.any() and len(out) < k:
            best = int(np.argmax(np.where(free, weight * rel + (1 - weight) * near, -np.inf)))
            out.append(ids[best])
            free[best] = False
            near = np.minimum(near, np.maximum(0, 1 - m @ m[best]))
        return pa.table({"query_id": pa.array([table["query_id"][0].as_py()] * len(out), pa.int64()), "id": pa.array(out, pa.int64()), "pick": pa.array(range(1, len(out) + 1), pa.int64())})

    return candidates.select("query_id", "id", "score", "vec").groupBy("query_id").applyInArrow(pick, "query_id long, id long, pick long")


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 10, router: bool = False, diversity: float | None = None, lexical_only: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): dense and lexical lists of 8k fused; ``score`` is the cosine, order the fused rank.

    ``router`` sets the weights by each query's intent and wins over ``lexical_only``; ``diversity`` (0 to 1) picks the k
    from the first 4k. Queries are stored first, as five joins and scans use them.
    """
    want, queries = 8 * k, materialise(queries)
    dense = dense_topk(chunks, queries, want).select("query_id", F.lit(0).alias("list_idx"), (F.col("rank") - 1).alias("rank"), F.col("chunk_id").alias("id"))
    # lists of weight 0 are out, so their queries are not put
    put = queries.where(intent_weights(intent(F.col("query")))[1] != 0) if router else queries
    words = bm25(*index_terms(chunks), put, want).select("query_id", F.lit(1).alias("list_idx"), (F.col("rank") - 1).alias("rank"), F.col("chunk_id").alias("id"))
    lists, weights = dense.unionByName(words), None
    if router:
        vector, lexical = intent_weights(intent(F.col("query")))
        told = queries.select("query_id", vector.alias("wv"), lexical.alias("wl"))
        lists = lists.join(told, "query_id").withColumn("weight", F.when(F.col("list_idx") == 0, F.col("wv")).otherwise(F.col("wl"))).drop("wv", "wl")
    elif lexical_only:
        weights = {0: 0.0, 1: 1.0}
    fused = rrf(lists, weights)
    scored = fused.where(F.col("rank") <= (4 * k if diversity else k)).join(chunks.select(F.col("chunk_id").alias("id"), "vec"), "id").join(queries.select("query_id", F.col("vec").alias("qvec")), "query_id")
    scored = scored.select("query_id", "id", "rank", F.col("score").alias("fused"), "vec", V.dot(F.col("vec"), F.col("qvec")).alias("cosine"))
    if diversity:
        picked = diversify(scored.select("query_id", "id", F.col("fused").alias("score"), "vec"), k, 1 - min(1.0, max(0.0, diversity)))
        scored = scored.drop("rank").join(picked.withColumnRenamed("pick", "rank"), ["query_id", "id"])
    return scored.select("query_id", F.col("id").alias("chunk_id"), F.col("cosine").alias("score"), F.col("rank").cast("long").alias("rank"))
