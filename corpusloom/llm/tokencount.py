"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer is compiled into a cascade of two deterministic transducers.

The splitter reads classes of characters and writes where pre-tokens end, up to one character late. It has 13 states, so
a chunk of text is a whole map from the state before it to the state after it. All chunks are run for all states side
by side; a parallel prefix scan composes the maps, which gives the true state before every chunk, and a second run from
there writes the borders.

The counter reads the bytes of a pre-token, and each of its transitions carries how many tokens the BPE result grows or
shrinks by. Its states are finite because BPE is: the last token of a prefix is the one suffix whose neighbour, the
last token before it, leaves it alone when the two are merged, so a state only needs, for each open start (where the
bytes since then still begin some token), the last token before it and the tokens since. States and transitions are
compiled when first met, and forgotten together where there are too many.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common

# classes of characters; letters that a contraction can have are apart
LETTER, SHORT, R, V, L, E, NUMBER, OTHER, QUOTE, BLANK, SPACE, END = range(12)
# states: what the open pre-token is. BIT and the three after it: a quote, then 's and others or the first of 're, 've, 'll
(START, WORD, DIGITS, MARKS, BIT, BIT_R, BIT_V, BIT_L, DONE, BLANK_1, SPACE_1, BLANK_N, SPACE_N) = range(13)
STATES = 13
#: Characters of a chunk.
CHUNK = 64
#: Compiled states that a worker keeps; beyond, it starts anew.
MAX_STATES = 1 << 18
_NEVER, _SINGLE = (1 << 62, -1), (-1, -1, -1)


@cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, borders) by state and class; borders: 1 before this character, 2 before the one before it."""
    opens = {LETTER: WORD, SHORT: WORD, R: WORD, V: WORD, L: WORD, E: WORD, NUMBER: DIGITS, OTHER: MARKS, QUOTE: BIT, BLANK: BLANK_1, SPACE: SPACE_1, END: START}
    to, cut = np.zeros((STATES, 12), np.uint8), np.zeros((STATES, 12), np.uint8)
    joins = {WORD: range(LETTER, E + 1), DIGITS: (NUMBER,), MARKS: (OTHER, QUOTE)}
    after_blank = {**opens, QUOTE: MARKS}  # with a blank before it a quote is a mark like others
    for c in range(12):
        to[:, c], cut[:, c] = opens[c], 1
        cut[START, c] = 0
        for state, joined in joins.items():
            if c in joined:
                to[state, c], cut[state, c] = state, 0
        # a quote: contractions, or a run of marks
        if c in (OTHER, QUOTE):
            to[BIT, c], cut[BIT, c] = MARKS, 0
        if c in (SHORT, R, V, L):
            to[BIT, c], cut[BIT, c] = {SHORT: DONE, R: BIT_R, V: BIT_V, L: BIT_L}[c], 0
        for state, ends in ((BIT_R, E), (BIT_V, E), (BIT_L, L)):
            if c == ends:
                to[state, c], cut[state, c] = DONE, 0
            elif c <= E:
                to[state, c], cut[state, c] = WORD, 2  # no contraction: its letter began a word
            else:
                cut[state, c] = 3
        # white space: the last one goes to what follows if it is a blank, and stands alone if it isn't
        for state in (BLANK_1, SPACE_1, BLANK_N, SPACE_N):
            if c in (BLANK, SPACE):
                to[state, c], cut[state, c] = (BLANK_N if c == BLANK else SPACE_N), 0
        if c < BLANK:
            to[BLANK_1, c] = to[BLANK_N, c] = after_blank[c]
            cut[BLANK_1, c], cut[BLANK_N, c], cut[SPACE_N, c] = 0, 2, 3
    return to, cut


def compose(maps: np.ndarray) -> np.ndarray:
    """Parallel prefix scan of maps (one a row, from state to state): row i becomes rows 0 to i in turn."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def chunk_maps(steps: np.ndarray) -> np.ndarray:
    """The whole map of each chunk; ``steps`` holds the chunks' first characters, then their second ones, and so on.

    After a few characters most chunks are in one state whatever they began in, and go on as one lane.
    """
    to = splitter()[0].ravel()
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (steps.shape[1], STATES)).copy()
    for c in steps[:4]:
        maps = to[maps * np.uint8(12) + c[:, None]]
    same = (maps == maps[:, :1]).all(axis=1)
    for rows, lanes in ((np.flatnonzero(same), 1), (np.flatnonzero(~same), STATES)):
        state = maps[rows, :lanes]
        for c in steps[4:]:
            state = to[state * np.uint8(12) + c[rows, None]]
        maps[rows] = state
    return maps


def borders(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pre-tokens begin: True at each first character. Texts end with END and begin new."""
    to, cut = (x.ravel() for x in splitter())
    n = len(classes)
    rows = max(1, -(-n // chunk))
    padded = np.full(rows * chunk, END, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    before = np.concatenate((np.full(1, START, np.uint8), compose(chunk_maps(steps))[:-1, START]))
    written = np.empty((chunk, rows), np.uint8)
    for i, c in enumerate(steps):
        at = before * np.uint8(12) + c
        written[i], before = cut[at], to[at]
    written = written.T.ravel()[:n]
    first = (written & 1).astype(bool)
    first[:-1] |= (written[1:] & 2) > 0
    if n:
        first[0] = True
        first[1:] |= classes[:-1] == END
    return first


def library_classes(split) -> np.ndarray:
    """The class of each code point, told by the library's own pre-tokenizer.

    It cuts a text of all code points into runs of letters, numbers, marks or single white spaces, and what a run's
    first character joins says which it is.
    """
    every = [c for c in range(0x110000) if c != 32 and not 0xD800 <= c < 0xE000]
    table = np.full(0x110000, OTHER, np.uint8)
    for _, (a, b) in split.pre_tokenize_str("".join(map(chr, every))):
        first, last = every[a], every[b - 1]
        joined = {kind: len(split.pre_tokenize_str(x + chr(first))) == 1 for kind, x in ((LETTER, "x"), (NUMBER, "1"), (OTHER, "!"))}
        table[first : last + 1] = next((kind for kind, one in joined.items() if one), SPACE)
    table[0xD800:0xE000] = OTHER
    for letters, kind in (("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE), (" ", BLANK)):
        for x in letters:
            table[ord(x)] = kind
    return table


@dataclass(frozen=True)
class Rules:
    """A byte-level BPE tokenizer in the JSON form of the tokenizers library."""

    text: str
    classes: bytes  # of all code points, deflated

    @classmethod
    def load(cls, path: str) -> Rules:
        """Read and check a file; anything else than plain byte-level BPE with the usual split is an error."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        told = json.loads(text)
        model, split = told["model"], told["pre_tokenizer"] or {}
        odd = [told["normalizer"], model.get("dropout"), model.get("byte_fallback"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges"), split.get("add_prefix_space")]
        odd += [a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in told["added_tokens"]]
        if model.get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or any(odd):
            raise ValueError("not a plain byte-level BPE tokenizer")
        split = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
        return cls(text, zlib.compress(library_classes(split).tobytes()))


def _letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The counting transducer of ``Rules``, compiled as bytes come."""

    def __init__(self, rules: Rules, max_states: int = MAX_STATES):
        told = json.loads(rules.text)
        self.specials = sorted((a["content"] for a in told["added_tokens"]), key=len, reverse=True)
        self.classes = np.frombuffer(zlib.decompress(rules.classes), np.uint8)
        self.max_states, byte = max_states, _letters()
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        vocab = {k: i for k, i in told["model"]["vocab"].items() if all(c in byte for c in k)}
        self.bytes_of = {i: bytes(byte[c] for c in k) for k, i in vocab.items()}
        self.single = {raw[0]: i for i, raw in self.bytes_of.items() if len(raw) == 1}
        if len(self.single) != 256:
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        self.merge = {(vocab[a], vocab[b]): (n, vocab[a + b]) for n, (a, b) in enumerate(pairs)}
        self.made = {t: (n, a, b) for (a, b), (n, t) in reversed(self.merge.items())}
        # a trie of all tokens that merging can make: children of each node by byte, and the token that ends there or -1
        self.child, self.token = [{}], [-1]
        for t in {*self.single.values(), *(t for _, t in self.merge.values())}:
            node = 0
            for x in self.bytes_of[t]:
                if x not in self.child[node]:
                    self.child[node][x] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][x]
            self.token[node] = t
        self.forget()

    def forget(self) -> None:
        """Back to the one state that every pre-token begins in."""
        self.states, self.keys, self.table = {(0, -1, 0): 0}, [(0, -1, 0)], [{}]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the tokens a and b, one after the other, are what BPE makes of their bytes.

        Goes back through the merges that made the two, the latest first. What stood at the border until such a merge
        must not have had an earlier merge of its own; of equal ones the left one would have come first.
        """
        if a == -1:
            return True
        limit = 1 << 62
        while True:
            if self.merge.get((a, b), _NEVER)[0] < limit:
                return False
            (rank_a, _, right), (rank_b, left, _) = self.made.get(a, _SINGLE), self.made.get(b, _SINGLE)
            if rank_a == rank_b == -1:
                return True
            if rank_a > rank_b:
                limit, a = rank_a, right
            else:
                limit, b = rank_b + 1, left

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from ``state`` on ``byte``: (state, tokens more or fewer)."""
        moved, last, more = [], -1, 0
        child, tokens, key = self.child, self.token, self.keys[state]
        for node, before, since in zip(key[::3], key[1::3], key[2::3], strict=True):  # the longest first
            node = child[node].get(byte)
            if node is None:
                continue
            if last == -1 and tokens[node] != -1 and self.neighbours(before, tokens[node]):
                last, more = tokens[node], 1 - since
            if child[node]:
                moved.append((node, before, since))
        new = []
        for node, before, since in moved:
            new += (node, before, since + more)
        new = (*new, 0, last, 0)  # each byte is a token, so some suffix always is the last one
        to = self.states.setdefault(new, len(self.keys))
        if to == len(self.keys):
            self.keys.append(new)
            self.table.append({})
        self.table[state][byte] = (to, more)
        return to, more

    def count(self, raw: bytes) -> int:
        """Tokens of one pre-token."""
        n = self.known.get(raw, self.older.get(raw))
        if n is None:
            n = self.run(raw)
        if len(raw) < 64:
            if len(self.known) >= self.max_states:
                self.known, self.older = {}, self.known
            self.known[raw] = n
        return n

    def run(self, raw: bytes) -> int:
        """The sum of what the transitions along ``raw`` carry."""
        if len(self.keys) > self.max_states:
            self.forget()
        table, state, n = self.table, 0, 0
        for b in raw:
            step = table[state].get(b)
            state, more = step if step else self.compile(state, b)
            n += more
        return n

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. An added token inside a text is one token, and what stands beside it is split apart."""
        n = np.zeros(len(texts), np.int64)
        owner, pieces = [], []
        finder = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        for i, text in enumerate(texts):
            parts = finder.split(text) if finder and any(s in text for s in self.specials) else [text]
            n[i] += len(parts) - 1
            for part in parts:
                if part:
                    owner.append(i)
                    pieces.append(part)
        if not pieces:
            return n
        text = "".join(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        stops = ends + np.arange(len(ends))  # an END after each piece
        classes, inside = np.full(stops[-1] + 1, END, np.uint8), np.ones(stops[-1] + 1, bool)
        inside[stops] = False
        raw = text.encode()
        if len(raw) == len(text):
            classes[inside] = self.classes[:128][np.frombuffer(raw, np.uint8)]
        else:
            classes[inside] = self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        first = np.flatnonzero(borders(classes)[inside])
        offsets = first if len(raw) == len(text) else np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[first]
        offsets = np.append(offsets, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        pieces = words.dictionary.to_pylist()
        each = list(map(self.known.get, pieces))
        for i, known in enumerate(each):
            if known is None:
                each[i] = self.count(pieces[i])
        each = np.array(each, np.int64)[np.asarray(words.indices)]
        n += np.bincount(owner, np.add.reduceat(each, np.searchsorted(first, ends - np.diff(ends, prepend=0))), len(texts)).astype(np.int64)
        return n


@cache
def compiled(rules: Rules) -> Counter:
    """A worker compiles a tokenizer once."""
    return Counter(rules)


def count_tokens(docs: DataFrame, rules: Rules, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``n_tokens`` (long), the tokens that the library would give for the whole text.

    No tokens are added at the ends; strings of added tokens inside a text are such tokens, the library's default.
    A row for each row, without a shuffle; null and empty texts have 0 tokens; repeated rows and rows without ids are
    rows like others; an empty table gives an empty result. Columns other than ``keep`` are ignored; ``keep`` must not
    name ``n_tokens``.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*(given.schema[n] for n in names), T.StructField("n_tokens", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(rules)  # the vocabulary file

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(shared.value)
        for batch in common.slices(batches):
            counts = counter.counts(common.texts_of(batch).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counts)], names=[*names, "n_tokens"])

    return given.mapInArrow(count, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "n_tokens")
