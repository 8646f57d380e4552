"""Byte-level BPE by pre-token: a proven table of strings that are one token alone, merges for the rest.

A byte-level BPE text splits into pre-tokens that never merge with each other, so a text's ids are its
pre-tokens' ids in order. ``proven_tokens`` shows once, with the library itself, which vocabulary strings
come out as that one token when they are encoded alone; those are looked up and never merged. Each other
pre-token that a worker meets goes through the library's merge model once and joins the worker's table,
which starts anew at a bounded size. Pre-tokens are found and looked up in numpy, by 64-bit hashes.
"""

from __future__ import annotations

import functools
import os
import pickle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import SparkSession

from gramlake.llm.common import U64, ranges, span_hashes

#: Pre-tokens that a worker's table holds besides the proven ones before it starts anew.
MEMO_ROWS = 900_000
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3


def load(path: str):
    """The library's tokenizer, without threads of its own; only workers need it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def proven_tokens(path: str) -> dict[bytes, int]:
    """Vocabulary strings that, encoded alone by the library, are exactly their own single token."""
    library = load(path)
    back = {c: b for b, c in byte_letters().items()}
    added = {t.content for t in library.get_added_tokens_decoder().values()}
    candidates = []
    for string, token in library.get_vocab().items():
        if string not in added and all(c in back for c in string):
            raw = bytes(back[c] for c in string)
            try:
                candidates.append((raw, raw.decode("utf-8"), token))
            except UnicodeDecodeError:
                continue
    out = {}
    for at in range(0, len(candidates), 1000):  # a bounded number of encodings at once
        part = candidates[at : at + 1000]
        encoded = library.encode_batch([s for _, s, _ in part], add_special_tokens=False)
        out |= {raw: token for (raw, _, token), e in zip(part, encoded, strict=True) if e.ids == [token]}
    return out


@functools.cache
def char_classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    for value, name in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for m in regex.finditer(name, text):
            out[points[m.start() : m.end()]] = value
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte where each starts (one more at the end)."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        lead, place = points[wide], at[wide]
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & (0xFF >> (size + 1))
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        for j in (1, 2, 3):
            more = size > j
            value = np.where(more, (value << 6) | (padded[place + j] & 0x3F), value)
        points[wide] = value
    return points, np.append(at, len(data))


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens of many texts at once, with an end bound, and each text's first one (n + 1).

    The split is the one of byte-level vocabularies: contractions, then runs of letters, of numbers and of
    other characters, each with one space before it if there is one, then white space.
    """
    points, at = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    kind = char_classes()[points]
    fresh = np.zeros(n + 1, bool)  # a text starts here
    fresh[np.searchsorted(at, offsets)] = True
    edge = fresh.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    edge[n] = True
    begin = edge[:n].copy()
    is_space = kind == SPACE
    last_space = is_space & edge[1:] & ~fresh[1:]  # last of a run of white space that something follows
    begin |= last_space
    glued = last_space & (points == 32)
    after = np.flatnonzero(glued) + 1
    begin[after] = False
    # contractions: an apostrophe that starts a pre-token, and letters of the same text right after it
    quote = np.flatnonzero((points == 39) & begin)
    if len(quote):
        padded = np.concatenate([points, [-1, -1, -1]])
        border = np.concatenate([fresh, [True, True, True]])
        one, two = padded[quote + 1], padded[quote + 2]
        in_one = ~border[quote + 1]
        in_two = in_one & ~border[quote + 2]
        pair = in_two & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        single = in_one & ((one == 115) | (one == 116) | (one == 109) | (one == 100))
        for hit, size in ((single, 2), (pair, 3)):
            where = quote[hit]
            begin[where + 1] = False
            rest = where + size
            rest = rest[rest < n]
            begin[rest[kind[rest] == LETTER]] = True
    starts = at[:-1][begin]
    return np.append(starts, len(data)), np.searchsorted(starts, offsets)


class Table:
    """Open-addressing table from 64-bit hashes to runs of ids, all in numpy."""

    def __init__(self, rows: int):
        self.bits = max(10, int(np.ceil(np.log2(rows * 2 + 1))))
        self.keys = np.zeros(1 << self.bits, U64)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.first = np.zeros(rows + 1, np.int64)  # run i is pool[first[i]:first[i + 1]]
        self.pool = np.zeros(2 * rows, np.uint32)
        self.rows, self.used = rows, 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it isn't there."""
        mask = U64((1 << self.bits) - 1)
        slot = (hashes & mask).astype(np.int64)
        row = self.slots[slot]
        open_ = np.flatnonzero((row >= 0) & (self.keys[slot] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            row[open_] = self.slots[slot[open_]]
            open_ = open_[(row[open_] >= 0) & (self.keys[slot[open_]] != hashes[open_])]
        return row

    def add(self, hashes: np.ndarray, runs: list[list[int]]) -> None:
        """Different hashes that aren't there yet."""
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        flat = np.fromiter((i for run in runs for i in run), np.uint32, int(sizes.sum()))
        start = int(self.first[self.used])
        if start + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[start : start + len(flat)] = flat
        rows = np.arange(self.used, self.used + len(runs))
        self.first[rows + 1] = start + np.cumsum(sizes)
        self.used += len(runs)
        mask = (1 << self.bits) - 1
        slot = (hashes & U64(mask)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            _, pick = np.unique(slot[free], return_index=True)
            won = free[pick]
            self.slots[slot[won]], self.keys[slot[won]] = rows[won], hashes[won]
            lost = np.ones(len(hashes), bool)
            lost[won] = False
            left = left[lost[left]]
            slot[left] = (slot[left] + 1) & mask


class Encoder:
    """Ids of whole texts, equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, proven: Proven):
        library = load(proven.path)
        self.merge, self.letters = library.model.tokenize, byte_letters()
        special = {t.content.encode("utf-8"): i for i, t in library.get_added_tokens_decoder().items()}
        self.special = special
        self.split = regex.compile(b"|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.proven = proven.table
        self._start()

    def _start(self) -> None:
        """The proven strings alone."""
        self.table = Table(len(self.proven) + len(self.special) + MEMO_ROWS)
        known = [*self.proven.items()]
        self.table.add(self._hash([s for s, _ in known]), [[i] for _, i in known])

    @staticmethod
    def _hash(strings: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(s) for s in strings])
        return span_hashes(np.frombuffer(b"".join(strings), np.uint8), np.append(0, ends[:-1]), ends)

    def _merged(self, raw: bytes) -> list[int]:
        letters = self.letters
        return [t.id for t in self.merge("".join([letters[b] for b in raw]))]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where special strings lie (start, end, id), found in the raw bytes and inside one text."""
        raw = data.tobytes()
        if self.split is None or not any(s in raw for s in self.special):
            return (np.zeros(0, np.int64),) * 3
        found = [(m.start(), m.end(), self.special[m[0]]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.split.finditer(raw, a, b)]
        return tuple(np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ([], [], [])))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table row of every pre-token, and each text's first one (n + 1). Special strings have row -2 - id."""
        begin, end, special = self._cuts(data, offsets)
        borders = np.unique(np.concatenate([offsets, begin, end])) if len(begin) else offsets
        bounds, _ = pre_tokens(data, borders)
        starts, ends = bounds[:-1], bounds[1:]
        hashes = span_hashes(data, starts, ends)
        row = self.table.find(hashes)
        inside = np.zeros(len(starts), bool)
        if len(begin):  # the pre-tokens of a special string give way to one
            which = np.searchsorted(begin, starts, side="right") - 1
            inside = (which >= 0) & (starts < end[which])
            row[inside] = 0
        missed = np.flatnonzero(row < 0)
        if len(missed):
            new, first = np.unique(hashes[missed], return_index=True)
            if self.table.used + len(new) > self.table.rows:
                self._start()
                if len(new) > MEMO_ROWS:  # one very long text
                    self.table = Table(len(self.proven) + len(new))
                    self.table.add(self._hash([*self.proven]), [[i] for i in self.proven.values()])
                row = self.table.find(hashes)
                row[inside] = 0
                missed = np.flatnonzero(row < 0)
                new, first = np.unique(hashes[missed], return_index=True)
            raw = data.tobytes()
            at = missed[first]
            self.table.add(new, [self._merged(raw[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            row[missed] = self.table.find(hashes[missed])
        if len(begin):
            row[inside] = -2 - special[which[inside]].astype(row.dtype)
            keep = ~inside | np.isin(starts, begin)
            row, starts = row[keep], starts[keep]
        return row, np.searchsorted(starts, offsets)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each text."""
        row, first = self.rows(data, offsets)
        size = np.where(row >= 0, self.table.first[row + 1] - self.table.first[row], 1)
        total = np.concatenate([[0], np.cumsum(size)])
        return total[first[1:]] - total[first[:-1]]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and each text's first one (n + 1)."""
        row, first = self.rows(data, offsets)
        begin = np.where(row >= 0, self.table.first[row], 0)
        size = np.where(row >= 0, self.table.first[row + 1] - begin, 1)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.table.pool[ranges(begin, size)]
        special = np.flatnonzero(row < 0)
        ids[total[special]] = (-2 - row[special]).astype(np.uint32)
        return ids, total[first]


class Proven:
    """A vocabulary's path and its proven table, packed; hashable, so that a worker builds its encoder once."""

    def __init__(self, path: str, packed: bytes):
        self.path, self.packed = path, packed

    @property
    def table(self) -> dict[bytes, int]:
        return pickle.loads(self.packed)

    def __hash__(self):
        return hash(self.path)

    def __eq__(self, other):
        return self.path == other.path


def prove(spark: SparkSession, path: str) -> Proven:
    """The proven table of a vocabulary, made by one task: the driver gets its bytes (of at most the vocabulary's size) alone."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(proven_tokens(path))] * batch.num_rows, pa.binary())], ["table"])

    return Proven(path, bytes(spark.range(0, 1, 1, 1).mapInArrow(work, "table binary").first().table))


@functools.lru_cache(maxsize=1)
def encoder(proven: Proven) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(proven)
