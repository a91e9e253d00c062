"""Periodic runs of words, found as maximal pairs in the tree of LCP intervals.

A stretch of period q and at least 2q words is a pair of equal stretches, q words apart and at least q long. If no
neighbouring word extends the period, the words to the left of the pair differ and so do those to the right: the pair is
maximal. So the maximal pairs (i, j, length l) with j - i <= l are just the runs [i, j + l), and none has to be
extended. Pairs come from the intervals of suffixes that share l words, from the bottom up: children of an interval
differ in the next word, and each keeps its suffixes in a sorted list for each word to their left. Where children meet,
the smaller one's suffixes look only at lists of other left words and only up to l words away, which a text's
periodicity keeps to a few hits, however often a word stands in it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common

RUN = "struct<start: long, length: long, period: long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def sorted_suffixes(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lcp): suffixes that share ``least`` codes or more with another, sorted, and what each shares with the one before.

    Prefix doubling that only takes up again whose order is still open, so texts without long repeats cost few rounds.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.full(n + 1, -1, np.int32)  # of the k codes from a place on; one more place for the end
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, n), bool), codes[order][1:] != codes[order][:-1])))
    sizes = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, sizes)
    open_ = order[np.repeat(sizes, sizes) > 1]
    levels, k, wanted = [(1, rank.copy())], 1, open_
    while len(open_):
        first = rank[open_].astype(np.int64)
        key = first * (n + 1) + rank[np.minimum(open_ + k, n)] + 1
        o = np.argsort(key, kind="stable")
        open_, key, first = open_[o], key[o], first[o]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.concatenate(([True], first[1:] != first[:-1]))
        at = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = first + start - np.maximum.accumulate(np.where(group, at, 0))
        sizes = np.diff(np.append(np.flatnonzero(new), len(open_)))
        open_ = open_[np.repeat(sizes, sizes) > 1]
        k *= 2
        if k <= least:
            wanted = open_  # who shares k codes with another
        if len(open_):
            levels.append((k, rank.copy()))
    wanted = wanted[np.argsort(rank[wanted], kind="stable")].astype(np.int64)
    lcp = np.zeros(len(wanted), np.int64)
    a, b = wanted[:-1], wanted[1:]
    for k, ranks in reversed(levels):
        x, y = np.minimum(a + lcp[1:], n), np.minimum(b + lcp[1:], n)
        lcp[1:] += np.where(ranks[x] == ranks[y], k, 0)
    return wanted, lcp


def _promising(places: np.ndarray, lcp: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Slices of suffixes that share ``least`` words or more, where two of them are as near as the longest shared stretch."""
    if not len(places):
        return
    block = np.cumsum(lcp < least)
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    by = np.lexsort((places, block))
    gaps = np.append(np.where(block[1:] == block[:-1], np.diff(places[by]), np.iinfo(np.int64).max), np.iinfo(np.int64).max)
    inner = lcp.copy()
    inner[starts] = 0
    ends = np.append(starts[1:], len(places))
    some = np.minimum.reduceat(gaps, starts) <= np.maximum.reduceat(inner, starts)
    yield from zip(starts[some].tolist(), ends[some].tolist(), strict=True)


class _Node:
    """Suffixes below an interval: all in order, and in order for each word to their left."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: int):
        self.all, self.by_left = [place], {left: [place]}


def _meet(one: _Node, two: _Node, depth: int, least: int, left: list[int], found: dict[tuple[int, int], int]) -> _Node:
    """Put two children of an interval of ``depth`` shared words together; their maximal pairs go to ``found``."""
    big, small = (one, two) if len(one.all) >= len(two.all) else (two, one)
    for place in small.all:
        mine = left[place]
        low, high = bisect_left(big.all, place - depth), bisect_right(big.all, place + depth)
        if high - low <= len(big.by_left):
            others = [x for x in big.all[low:high] if left[x] != mine]
        else:
            others = [x for c, xs in big.by_left.items() if c != mine for x in xs[bisect_left(xs, place - depth) : bisect_right(xs, place + depth)]]
        for x in others:
            i, q = min(x, place), abs(x - place)
            if q + depth >= least:
                run = (i, i + q + depth)
                found[run] = min(q, found.get(run, q))  # multiples of the period give the same stretch
    for c, xs in small.by_left.items():
        if c in big.by_left:
            for x in xs:
                insort(big.by_left[c], x)
        else:
            big.by_left[c] = xs
    for x in small.all:
        insort(big.all, x)
    return big


def periodic_runs(codes: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of ``codes``, by start, then period: at least ``least`` long and twice their period.

    The period is the smallest of the stretch, and no run can be extended. Texts may stand one after another if they
    have no code in common: no run then goes over a border.
    """
    half = max(1, -(-least // 2))  # a period is no longer than the pair, so the pair has half of the run at least
    places, lcp = sorted_suffixes(codes, half)
    found: dict[tuple[int, int], int] = {}
    left = None
    for a, b in _promising(places, lcp, half):
        left = np.concatenate(([-1], codes[:-1])).tolist() if left is None else left
        own, shared = places[a:b].tolist(), [*lcp[a + 1 : b].tolist(), 0]
        node, open_ = _Node(own[0], left[own[0]]), []
        for x, depth in enumerate(shared, 1):
            while open_ and open_[-1][0] > depth:
                deeper, before = open_.pop()
                node = _meet(before, node, deeper, least, left, found)
            if not depth:
                break
            if open_ and open_[-1][0] == depth:
                node = _meet(open_.pop()[1], node, depth, least, left, found)
            open_.append((depth, node))
            node = _Node(own[x], left[own[x]])
    return sorted(((i, j - i, q) for (i, j), q in found.items()), key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, text: str = "text", least: int = 12, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``runs``, an array of (start, length, period) in words, and ``collapsed``.

    Words are what ASCII white space separates; a run is as in ``periodic_runs``. ``collapsed`` holds the words, joined
    by one space, without those that stand in a run after its first period. A row for each row: texts are whole and
    never meet, so there is no shuffle; null, empty and white texts have no runs and are empty; repeated rows and rows
    without ids are rows like others; an empty table gives an empty result. Columns other than ``keep`` are ignored;
    ``keep`` must not name ``runs`` or ``collapsed``. A task holds, for about 1 MB of text or one longer text, four
    bytes for each word and doubling of its longest repeat.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*(given.schema[n] for n in names), *T.StructType.fromDDL(f"runs array<{RUN}>, collapsed string").fields])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            owner, codes, words = common.words_of(common.texts_of(batch))
            n = batch.num_rows
            _, own = np.unique(owner * max(1, len(words)) + codes, return_inverse=True)
            runs = np.array(periodic_runs(own, least), np.int64).reshape(-1, 3)
            gone = np.zeros(len(codes) + 1, np.int64)
            np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
            np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
            stays = np.cumsum(gone)[:-1] == 0
            first = np.searchsorted(owner, np.arange(n + 1))
            whose = owner[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
            structs = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[whose]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(_RUN))
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(n + 1)), pa.int32()), structs)
            cuts = np.searchsorted(owner[stays], np.arange(n + 1))
            kept = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.take(pa.array(codes[stays])).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), listed, pc.binary_join(kept, " ")], names=[*names, "runs", "collapsed"])

    found = given.mapInArrow(find, schema)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "runs", "collapsed")


def longest(runs: str = "runs") -> Column:
    """The longest run as (length, -start, -period), null without one; of equally long ones the first, then the least period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def run_lines(runs: str = "runs") -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
