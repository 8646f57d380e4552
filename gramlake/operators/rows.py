"""The one way row data becomes small: vectorized kernels whose sums over rows meet by index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one kernel call; bounds the dense block of a design.
BLOCK_ROWS = 4096
#: Numbers of one piece of a sum.
PIECE = 8192


def numpy_columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns as arrays: numbers as doubles (null is NaN), lists of equal length as matrices, others as objects."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        kind = column.type
        if pa.types.is_list(kind) and (column.null_count or batch.num_rows and np.ptp(column.value_lengths().to_numpy(zero_copy_only=False))):
            out[name] = column.to_numpy(zero_copy_only=False)  # of several lengths: an array for each row
        elif pa.types.is_list(kind):
            out[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
        elif pa.types.is_floating(kind) or pa.types.is_integer(kind) or pa.types.is_boolean(kind):
            out[name] = column.cast(pa.float64()).to_numpy(zero_copy_only=False) if not pa.types.is_int64(kind) or column.null_count else column.to_numpy(zero_copy_only=False)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def sum_rows(df: DataFrame, kernel: Callable[[dict[str, np.ndarray]], np.ndarray]) -> np.ndarray:
    """Sum of ``kernel(columns)`` over blocks of rows; the kernel returns a flat array of fixed length.

    One pass: a task adds up its blocks and emits the sum as binary pieces of PIECE numbers, which are added up
    piece by piece as they stream by (one shuffle of a few rows a task). What reaches the driver is one array, a row
    for each piece. An empty table gives an empty array.
    """

    def partial(batches):
        total = None
        for whole in batches:
            for batch in (whole.slice(i, BLOCK_ROWS) for i in range(0, whole.num_rows, BLOCK_ROWS)):
                value = np.asarray(kernel(numpy_columns(batch)), float).ravel()
                total = value if total is None else total + value
        if total is not None:
            yield pieces_of(enumerate(total[i : i + PIECE] for i in range(0, len(total), PIECE)))

    return add_pieces(df, partial)


def sum_columns(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """Sums of a few Columns as one built-in aggregate: rows of plain numbers needn't leave the JVM, which a kernel's must. 0 of an empty table."""
    return np.array([v or 0.0 for v in df.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()], float)


def add_rows(df: DataFrame, length: int, kernel: Callable[[dict[str, np.ndarray], np.ndarray], None]) -> np.ndarray:
    """The same for long sums of which a batch touches few numbers: ``kernel(columns, total)`` adds to its task's total in place.

    Pieces that are all 0 stay where they are. An empty table gives zeros.
    """

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                total = np.zeros(length) if total is None else total
                kernel(numpy_columns(batch), total)
        if total is not None:
            pieces = [(i, total[a : a + PIECE]) for i, a in enumerate(range(0, length, PIECE))]
            pieces = [(i, p) for i, p in pieces if p.any()]
            if pieces:
                yield pieces_of(pieces)

    out = np.zeros(length)
    for i, p in add_pieces(df, partial, whole=False):
        out[i * PIECE : i * PIECE + len(p)] = p
    return out


def add_pieces(df: DataFrame, partial: Callable, whole: bool = True):
    """What the tasks' pieces add up to: one array, or with their places."""

    def add(batches):
        sums = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = np.frombuffer(raw)
                sums[i] = sums[i] + value if i in sums else value
        if sums:
            yield pieces_of(sums.items())

    got = df.mapInArrow(partial, "i int, b binary").repartition("i").mapInArrow(add, "i int, b binary").collect()
    if not whole:
        return [(r.i, np.frombuffer(r.b)) for r in got]
    return np.concatenate([np.zeros(0), *(np.frombuffer(r.b) for r in sorted(got, key=lambda r: r.i))])


def pieces_of(items) -> pa.RecordBatch:
    index, raw = zip(*((i, v.tobytes()) for i, v in items), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array(raw, pa.binary())], ["i", "b"])


def sum_rows_by(df: DataFrame, keys: list[str], kernel: Callable[[dict[str, np.ndarray]], np.ndarray], length: int) -> DataFrame:
    """The same for each key: keys and an array ``v``. The kernel returns one row of ``length`` numbers for each input row.

    Rows of a key that lie in one task's block are added up before the shuffle on the keys; the sums of
    ``length`` indices meet as columns, so that no group is ever held whole.
    """
    fields = [df.schema[k] for k in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"v{i} double" for i in range(length)])

    def partial(batches):
        for whole in batches:
            for batch in (whole.slice(i, BLOCK_ROWS) for i in range(0, whole.num_rows, BLOCK_ROWS)):
                value = np.asarray(kernel(numpy_columns(batch)), float).reshape(batch.num_rows, length)
                table = pa.Table.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), *(pa.array(value[:, i]) for i in range(length))], [*keys, *(f"v{i}" for i in range(length))])
                small = table.group_by(keys, use_threads=False).aggregate([(f"v{i}", "sum") for i in range(length)])
                yield from small.rename_columns([c[:-4] if c.endswith("_sum") and c[:-4].startswith("v") else c for c in small.column_names]).select([*keys, *(f"v{i}" for i in range(length))]).combine_chunks().to_batches()

    summed = df.mapInArrow(partial, schema).groupBy(*keys).agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(length)])
    return summed.select(*keys, F.array(*[f"v{i}" for i in range(length)]).alias("v"))
