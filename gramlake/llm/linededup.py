"""Line dedup by content-defined chunks: rolling hashes over line hashes choose the boundaries."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm.common import SLICE_BYTES, U64, cut, mix, ranges, read, span_hashes, text_slices, to_signed

#: Lines that the rolling hash sees, and one boundary in how many lines.
ROLL, MEAN_LINES = 2, 3
#: A line of at least this many words is a chunk of its own; a run of lines of as many is a passage.
LONG_WORDS = 50
#: Words that the first or last lines of a chunk have at least to be looked up on their own, as ends of a passage.
EDGE_WORDS = 16
#: A chunk's name in its text: its first line times this, plus its number of lines.
NAME = 1 << 31
#: Stands for a null key while texts meet lists of chunks; null keys have no chunks.
NO_KEY = -(1 << 63)
_STEP = U64(0xC6BC279692B5C323)


def text_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines of many texts, which end at line feeds: byte starts and ends, each line's text, and each text's first line (n + 1)."""
    rows = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    # line starts: text starts and after feeds; every text has at least one line
    owner_feed = np.searchsorted(offsets, feeds, side="right") - 1
    starts = np.concatenate([offsets[:-1], feeds + 1])
    owner = np.concatenate([np.arange(rows), owner_feed])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    last = np.ones(len(starts), bool)
    last[:-1] = owner[1:] != owner[:-1]
    ends = np.where(last, offsets[owner + 1], np.append(starts[1:], 0) - 1)
    return starts, ends, owner, np.searchsorted(owner, np.arange(rows + 1))


def windows(words: np.ndarray, owner: np.ndarray, first_line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end lines of the shortest runs of LONG_WORDS words or more from each line on, and up to each line.

    They begin and end at lines with a word and depend on their own lines alone, so two places share all windows of a
    shared run, and the windows of a run of LONG_WORDS words or more cover it, whatever its lines are.
    """
    sums = np.concatenate([[0], np.cumsum(words)])
    full = np.flatnonzero(words)
    on = np.searchsorted(sums, sums[full] + LONG_WORDS, side="left")
    inside = on <= first_line[owner[full] + 1]
    back = np.searchsorted(sums, sums[full + 1] - LONG_WORDS, side="right") - 1
    within = back >= first_line[owner[full]]
    return np.concatenate([full[inside], back[within]]), np.concatenate([on[inside], full[within] + 1])


def chunks(data: np.ndarray, offsets: np.ndarray, passages: bool = False) -> tuple[np.ndarray, ...]:
    """Chunks of many texts: first line and end line (of all lines), two hashes, and each text's first chunk and first line (n + 1).

    A boundary follows a line where the rolling hash of it and the line before
    falls on one residue, and lies on both sides of a long line, so that it depends on the text near by
    alone and shared passages are cut alike wherever they stand. Only chunks of two lines or more, or of
    one long line, with anything but white space count; the others are not returned. Where a passage begins
    or ends inside a chunk, only the chunk's last or first lines are the passage's: so the first and the last
    two or more lines of a chunk, of EDGE_WORDS words or more, are returned as chunks too. With ``passages``, so
    are all windows, which need no boundary, and no edges of LONG_WORDS words or more, which windows cover.
    """
    rows = len(offsets) - 1
    starts, ends, owner, first_line = text_lines(data, offsets)
    last = np.ones(len(starts), bool)
    last[:-1] = owner[1:] != owner[:-1]
    h = span_hashes(data, starts, ends)
    # words of each line
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begin = ~blank
    begin[1:] &= blank[:-1]
    edge = starts[starts < len(data)]
    begin[edge] = ~blank[edge]
    total = np.concatenate([[0], np.cumsum(begin)])
    words = total[ends] - total[starts]
    long_ = words >= LONG_WORDS
    same = np.zeros(len(h), bool)
    same[1:] = owner[1:] == owner[:-1]
    before = np.concatenate([np.zeros(1, U64), h[:-1]])
    roll = mix(np.where(same, before, U64(0)) * _STEP + h)
    boundary = (roll % U64(MEAN_LINES) == 0) | long_ | last
    boundary[:-1] |= long_[1:]
    head = np.ones(len(h), bool)
    head[1:] = boundary[:-1]
    a = np.flatnonzero(head)
    b = np.append(a[1:], len(h))
    more = np.maximum(b - a - 2, 0)
    at = ranges(np.zeros(len(a), np.int64), more) + 2  # lines of an edge, from 2 to all but one
    base_a, base_b = np.repeat(a, more), np.repeat(b, more)
    edges_a, edges_b = np.concatenate([base_a, base_b - at]), np.concatenate([base_a + at, base_b])
    sums = np.concatenate([[0], np.cumsum(words)])
    size = sums[edges_b] - sums[edges_a]
    keep = (size >= EDGE_WORDS) & ~(passages & (size >= LONG_WORDS))
    counts = ((b - a >= 2) | long_[a]) & (sums[b] - sums[a] > 0)
    more_a, more_b = windows(words, owner, first_line) if passages else (a[:0], b[:0])
    a, b = np.concatenate([a[counts], edges_a[keep], more_a]), np.concatenate([b[counts], edges_b[keep], more_b])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[once], b[once]
    one = span_hashes(data, starts[a], ends[b - 1])
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(0x51ED270B)) * (np.arange(len(h)).astype(U64) * U64(2) + U64(1)), dtype=U64)])
    lines = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(0x51ED270B)), dtype=U64)])
    two = (sums[b] - sums[a]) - (lines[b] - lines[a]) * a.astype(U64) * U64(2)  # the same wherever the chunk stands
    return a, b, one, mix(two), np.searchsorted(owner[a], np.arange(rows + 1)), first_line


def _find(passages: bool):
    """Hashes of every chunk: k, c (its name in the text), h1, h2."""

    def find(batches):
        for batch, data, offsets in text_slices(batches, "t"):
            a, b, one, two, first, first_line = chunks(data, offsets, passages)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array((a - first_line[row]) * NAME + b - a), pa.array(to_signed(one)), pa.array(to_signed(two))], ["k", "c", "h1", "h2"])

    return find


def _listed(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each listed value, and the values; a null list is empty."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()


def _heads(new: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The greatest end before each place of its group, -1 for a group's first place; ``new`` marks first places."""
    group = np.cumsum(new) - 1
    wide = int(b.max(initial=0)) + 1
    top = np.maximum.accumulate(b + group * wide)
    return np.where(new, -1, np.concatenate([[0], top[:-1]]) - group * wide)


def _runs(batches):
    """Repeated chunks of a document as runs of lines to compare: k, c, fk, fc.

    Chunks that meet or overlap and have their first places in one document, equally far off, are one run; runs inside
    others go. A line is in a bounded number of windows and in the longest edges of its chunk alone, so the
    bytes to compare follow the text's, also where its lines are all equal.
    """
    for batch in batches:
        row, listed = _listed(batch.column(1))
        if not len(row):
            continue
        c, fk, fc = (listed.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        a, n, d = c // NAME, c % NAME, c // NAME - fc // NAME
        order = np.lexsort((a, d, fk, row))
        row, a, b, d, fk = row[order], a[order], (a + n)[order], d[order], fk[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (fk[1:] != fk[:-1]) | (d[1:] != d[:-1])
        begin = np.flatnonzero(a > _heads(new, b))
        row, a, b, d, fk = row[begin], a[begin], np.maximum.reduceat(b, begin), d[begin], fk[begin]
        order = np.lexsort((-b, a, row))
        row, a, b, d, fk = row[order], a[order], b[order], d[order], fk[order]
        new = np.ones(len(row), bool)
        new[1:] = row[1:] != row[:-1]
        keep = b > _heads(new, b)
        row, a, b, d, fk = row[keep], a[keep], b[keep], d[keep], fk[keep]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(a * NAME + b - a), pa.array(fk), pa.array((a - d) * NAME + b - a)], ["k", "c", "fk", "fc"])


def _named(batch: pa.RecordBatch, first_line: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, name, first and end line (of all lines) of the runs that the rows' lists name; runs past a text's end are left out."""
    row, c = _listed(batch.column(2))
    c = c.to_numpy(zero_copy_only=False)
    a = first_line[row] + c // NAME
    b = a + c % NAME
    fits = b <= first_line[row + 1]
    return row[fits], c[fits], a[fits], b[fits]


def _texts(batches):
    """Bytes of the runs that a row's list names, in batches of bounded size: k, c, u."""
    for batch, data, offsets in text_slices(batches, "t"):
        starts, ends, _, first_line = text_lines(data, offsets)
        row, c, a, b = _named(batch, first_line)
        x, y = starts[a], ends[b - 1]
        raw = data.tobytes()
        piece = np.cumsum(y - x) // SLICE_BYTES
        for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(row)]):
            texts = [raw[u:v].decode("utf-8") for u, v in zip(x[i:j].tolist(), y[i:j].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[i:j])), pa.array(c[i:j]), pa.array(texts, pa.string())], ["k", "c", "u"])


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), passages: bool = False) -> DataFrame:
    """``key``, ``carry``, text without repeated chunks, n_lines (before) and n_removed of every row.

    A chunk that occurs again, in the same document or another, goes; its first place (least key, then
    least line) stays, so that every line stays somewhere. With ``passages``, every run of lines of LONG_WORDS words or
    more that occurs again goes too, wherever boundaries fall (blank lines at its ends may stay); without, a run of short
    lines is found by its chunks alone. Chunks meet by a 128-bit hash (a shuffle of hashes alone); those that repeat are joined
    to runs, whose bytes are compared with the first place's before anything goes (a shuffle of repeated runs), and
    lists of removed chunks meet the texts (one shuffle of the table, used for both). Lines that remain keep their order
    and bytes. A null text stays null; texts that were repeated whole become empty; rows with a null key
    stay as they are; rows with equal keys are one document, whose later rows lose what its first place
    doesn't cover. An empty table gives no rows.
    """
    names = [f"c{i}" for i in range(len(carry))]
    others = [docs[c].alias(n) for c, n in zip(carry, names, strict=True)]
    own = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"))
    found = cut(own.where("k is not null and t is not null").mapInArrow(_find(passages), "k long, c long, h1 long, h2 long"))
    counted = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("k").alias("fk")).where("n > 1")
    places = found.join(counted, ["h1", "h2"])
    firsts = places.where("k = fk").groupBy("h1", "h2", "fk").agg(F.min("c").alias("fc"))
    again = found.join(firsts, ["h1", "h2"]).where("k <> fk or c <> fc").groupBy("k").agg(F.collect_list(F.struct("c", "fk", "fc")).alias("cs"))
    later = cut(again.mapInArrow(_runs, "k long, c long, fk long, fc long"))
    need = later.select("k", "c").union(later.select("fk", "fc").distinct()).distinct().groupBy("k").agg(F.collect_list("c").alias("cs"))
    # the same rows, dealt by the same key, meet both lists: the texts are shuffled once
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_KEY)).alias("k"), docs[text].alias("t"), docs[key].alias("k0"), *others)
    bodies = rows.join(need, "k").select("k", "t", "cs", "k0", *names).mapInArrow(_texts, "k long, c long, u string")
    first_bodies = bodies.select(F.col("k").alias("fk"), F.col("c").alias("fc"), F.col("u").alias("fu"))
    same = later.join(bodies, ["k", "c"]).join(first_bodies, ["fk", "fc"]).where("u = fu")
    gone = same.select("k", "c").distinct().groupBy("k").agg(F.collect_list("c").alias("cs"))
    rows = rows.join(gone, "k", "left").select("k0", "t", "cs", *names)
    kinds = [docs.schema[c].dataType.simpleString() for c in (key, *carry)]

    def remove(batches):
        for batch, data, offsets in text_slices(batches, "t"):
            starts, ends, _, first_line = text_lines(data, offsets)
            _, _, a, b = _named(batch, first_line)
            depth = np.bincount(a, minlength=len(starts) + 1) - np.bincount(b, minlength=len(starts) + 1)
            keep_line = np.cumsum(depth)[:-1] == 0
            raw, texts, removed = data.tobytes(), batch.column(1).to_pylist(), []
            for i, (u, v) in enumerate(zip(first_line[:-1].tolist(), first_line[1:].tolist(), strict=True)):
                lines = np.flatnonzero(keep_line[u:v]) + u
                removed.append(v - u - len(lines))
                if removed[-1]:
                    texts[i] = b"\n".join([raw[starts[j] : ends[j]] for j in lines.tolist()]).decode("utf-8")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(3 + i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array(np.diff(first_line)), pa.array(removed, pa.int64())], ["k0", *names, "t", "n_lines", "n_removed"])

    schema = ", ".join([f"{n} {kind}" for n, kind in zip(["k0", *names], kinds, strict=True)] + ["t string, n_lines long, n_removed long"])
    out = rows.mapInArrow(remove, schema)
    return out.select(F.col("k0").alias(key), *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], F.col("t").alias("text"), "n_lines", "n_removed")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"), passages=True)


QUERIES = {"op8_line_dedup": op8_line_dedup}
