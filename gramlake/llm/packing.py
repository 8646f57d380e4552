"""Packing of whole documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from gramlake.llm.bpe import encoder, prove
from gramlake.llm.common import read, text_slices

#: Partly filled windows that a task keeps before it closes them all; bounds its memory.
OPEN_WINDOWS = 4096
#: Sequence ids are a task's number times this, plus the sequence's number in the task.
TASK_IDS = 1 << 36


class SumOfSquares:
    """Online packing: each tail goes where the sum of squared counts of partly filled windows stays least.

    ``level[h]`` counts the open windows filled to h. Putting a piece of size r on a window at h changes
    the sum by 2 * (level[h + r] - level[h]) + 2 (a full window leaves the count, a new one joins it), so
    the best level is one vector step over the array.
    """

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id = size, first_id
        self.level = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # fill level -> windows, each a list of pieces
        self.n_open = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.rows.append((key, start, len(ids), zlib.crc32(ids), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, key, ids: np.ndarray) -> None:
        """A whole document's ids: full windows stand alone, the tail is placed."""
        whole = len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            self._emit([(key, start, ids[start : start + self.size], len(ids))])
        tail = ids[whole:]
        if len(tail):
            self._place((key, whole, tail.copy(), len(ids)))
        if self.n_open > OPEN_WINDOWS:
            self.close()

    def _place(self, piece: tuple) -> None:
        r, top = len(piece[2]), self.size
        change = 2 * (self.level[r:top] - self.level[: top - r]) + 2  # onto h = 0 .. top - r - 1
        change[self.level[: top - r] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.level[r] + 1  # a new window
        at = int(np.argmin(change))
        if self.level[top - r] and 1 - 2 * self.level[top - r] <= change[at]:
            at = top - r  # fills a window
        if at:
            window = self.open[at].pop()
            self.level[at] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if at + r == top:
            self._emit(window)
        else:
            self.open.setdefault(at + r, []).append(window)
            self.level[at + r] += 1
            self.n_open += 1

    def close(self) -> None:
        """Cut what lies in open windows into full ones, and the rest at powers of two, which need no padding."""
        pieces = [p for h in sorted(self.open) for window in self.open[h] for p in window]
        left = sum(len(p[2]) for p in pieces)
        goals = [self.size] * (left // self.size) + [1 << b for b in range(self.size.bit_length(), -1, -1) if left % self.size >> b & 1]
        queue, at = iter(pieces), 0
        piece = next(queue, None)
        for goal in goals:
            window, room = [], goal
            while room:
                key, start, ids, total = piece
                part = ids[at : at + room]
                window.append((key, start + at, part, total))
                room -= len(part)
                at += len(part)
                if at == len(ids):
                    piece, at = next(queue, None), 0
            self._emit(window)
        self.open, self.n_open = {}, 0
        self.level[:] = 0


def pack(df: DataFrame, path: str, size: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its whole text's ids (no added special tokens) and ``end_id``; each id lies in
    exactly one piece and a sequence holds at most ``size``. No shuffle: a task packs its own partition
    online, so that documents need no global order; what its last partly filled windows hold is cut into
    full windows and powers of two. The same split of the input gives the same rows when a task runs again.
    Null and empty texts are ``end_id`` alone; repeated rows are packed each; a null key is kept; other
    columns are not read; an empty table gives no rows.
    """
    proven = df.sparkSession.sparkContext.broadcast(prove(df.sparkSession, path))
    kind = df.schema[key].dataType

    def work(batches):
        own = encoder(proven.value)
        packer = SumOfSquares(size, TaskContext.get().partitionId() * TASK_IDS)

        def flush():
            columns = list(zip(*packer.rows, strict=True))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        names, key_type = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], None
        for batch, data, offsets in text_slices(batches, "t"):
            key_type = batch.column(0).type
            ids, first = own.ids(data, offsets)
            for k, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                packer.add(k, np.append(ids[a:b], np.uint32(end_id)).astype("<u4"))
            if packer.rows:
                yield flush()
        packer.close()
        if packer.rows:
            yield flush()

    out = df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(work, f"k {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("k", key)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_pack": op10_pack}
