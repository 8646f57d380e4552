"""What the text operators share: lineage cuts, Arrow text buffers, vectorized word spans and hashes.

Texts are handled as UTF-8 bytes in numpy: ``text_slices`` hands out bounded runs of rows, so that a
task's memory follows ``SLICE_BYTES`` and its longest single text, not the size of its partition.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on (a longer single text is a step of its own).
SLICE_BYTES = 2_000_000

U64 = np.uint64


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir; where none is set, in one of our own in local mode, and nowhere on a cluster."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gramlake-"))
    out = df.checkpoint()
    if _cuts:
        _cuts[-1].append(out._jdf.logicalPlan().rdd().getCheckpointFile().get())
    return out


_cuts: list[list[str]] = []


@contextmanager
def cuts_within(spark: SparkSession) -> Iterator[list[str]]:
    """The folders of the cuts made inside, in order; those still in the list at the end are removed."""
    made: list[str] = []
    _cuts.append(made)
    try:
        yield made
    finally:
        _cuts.pop()
        remove(spark, made)


def remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``most`` text bytes (or one row): batch, bytes, and n + 1 offsets. Null counts as empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, dtype=np.uint8) if whole is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte, the same in every process.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of an odd base, or of its inverse modulo 2**64."""
    have = _powers[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, SLICE_BYTES // 2), base, U64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=U64)
    return have


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with inside[byte], never across rows: starts, ends, and each row's first run (n + 1)."""
    is_in = inside[data]
    first = is_in.copy()
    first[1:] &= ~is_in[:-1]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = is_in[edges]
    last[edges - 1] = is_in[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial sum."""
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUES[data] * _power("up", n)[:n], dtype=U64, out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power("down", n + 1)[starts]
    return mix(value + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (len - k + 1 of them), across row edges too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(0xC6BC279692B5C323)
        out += hashes[j : j + n]
    return mix(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated start, start + 1, ... for each start and count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift


def to_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def map_texts(df: DataFrame, work, columns: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns of each row next to what ``work(data, offsets)`` makes of bounded runs of texts.

    ``work`` returns one Arrow array for each of ``columns`` (a DDL list), a value for each row. No shuffle.
    """
    fields = [df.schema[c] for c in carry]
    names = [f"c{i}" for i in range(len(carry))]
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True)] + [columns])
    new = [c.split()[0] for c in columns.split(",")]

    def each(batches):
        run = work()
        for batch, data, offsets in text_slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + list(run(data, offsets)), names + new)

    out = df.select(*[df[c].alias(n) for c, n in zip(carry, names, strict=True)], df[text].alias("t")).mapInArrow(each, schema)
    return out.select(*[out[n].alias(c) for c, n in zip(carry, names, strict=True)], *new)
