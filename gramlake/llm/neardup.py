"""Near-duplicate documents: fast similarity sketches, banding, and exact comparison of full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm.common import LOWER, U64, cut, grams, mix, ranges, read, span_hashes, spans, text_slices, to_signed
from gramlake.llm.components import components, forest

#: Words of a shingle, and the least percentage of the union that the intersection of linked sets has where none is given.
SHINGLE, PERCENT = 5, 85
#: Coordinates of a sketch.
SKETCH = 128
#: Most probability that a pair at the threshold misses all bands, and that too few of its coordinates agree.
MISS, DISAGREE = 5e-7, 1.1e-6
#: Documents, and text bytes, of one piece of a large group; two pieces meet in one comparison.
PIECE_ROWS, PIECE_BYTES = 1500, 16_000_000

IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def banding(percent: int) -> tuple[int, int, int]:
    """Bands, rows of a band, and coordinates that must agree before full sets are compared, for links at ``percent``.

    The most rows and then the least bands with which a pair at the threshold misses all with probability MISS at most:
    25 of 5 and 88 for 85, 28 of 4 and 79 for 80. Low thresholds, which no banding of SKETCH coordinates meets, are refused.
    """
    s = percent / 100
    for rows in range(SKETCH, 0, -1):
        hit = s**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(MISS) / math.log1p(-hit))
        if bands * rows <= SKETCH:
            break
    else:
        raise ValueError(f"no banding finds links at {percent} %")
    below, agree = 0.0, 0
    while agree < SKETCH and below + (p := math.comb(SKETCH, agree) * s**agree * (1 - s) ** (SKETCH - agree)) < DISAGREE:
        below, agree = below + p, agree + 1
    return bands, rows, agree


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each text, side by side, and each text's first one (n + 1)."""
    starts, ends, first = spans(data, offsets, IS_WORD)
    words = span_hashes(LOWER[data], starts, ends)
    n = np.diff(first)
    full = n >= SHINGLE
    g = grams(words, SHINGLE)
    count = np.where(full, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(bounds[-1]), U64)
    out[ranges(bounds[:-1][full], count[full])] = g[ranges(first[:-1][full], count[full])]
    for i in np.flatnonzero((n > 0) & ~full).tolist():
        out[bounds[i]] = grams(words[first[i] : first[i + 1]], int(n[i]))[0] ^ U64(int(n[i]))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][count > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def sketches(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of each set, SKETCH numbers; an empty set's are all ones.

    In round i every element is placed in a hashed bin, keeping the least hash of the earliest round; a
    set that has a number in every bin stops. Round SKETCH + b places all elements in bin b, so that no
    bin stays empty. Two sets agree in a bin with the probability of their similarity.
    """
    n = len(first) - 1
    out = np.full(n * SKETCH, _TOP, U64)
    size = np.diff(first)
    active = np.flatnonzero(size)
    for i in range(2 * SKETCH):
        if not len(active):
            break
        counts = size[active]
        h = mix(elements[ranges(first[active], counts)] ^ U64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = U64(i << 56) | (h & U64((1 << 56) - 1))
        if i < SKETCH:
            np.minimum.at(out, np.repeat(active * SKETCH, counts) + (h >> U64(57)).astype(np.int64), value)
        else:
            at = active * SKETCH + (i - SKETCH)
            out[at] = np.minimum(out[at], np.minimum.reduceat(value, np.concatenate([[0], np.cumsum(counts)[:-1]])))
        active = active[(out.reshape(n, SKETCH)[active] == _TOP).any(axis=1)]
    return out.reshape(n, SKETCH)


def _sketch_batches(n_bands: int, rows: int):
    def sketch(batches):
        names = ["k", "n", "f1", "f2", "sketch", "bands"]
        for batch, data, offsets in text_slices(batches, "t"):
            sets, first = shingle_sets(data, offsets)
            n = np.diff(first)
            s = sketches(sets, first)
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ U64(c)), dtype=U64)]) for c in (0x1234567, 0x89ABCDEF01)]
            prints = [x[first[1:]] - x[first[:-1]] for x in sums]
            bands = np.stack([grams(s[:, b * rows : (b + 1) * rows].ravel(), rows)[::rows] + U64(b) if len(s) else np.zeros(0, U64) for b in range(n_bands)], 1)
            low = np.ascontiguousarray((s & U64(255)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), *(pa.array(to_signed(p)) for p in prints), pa.array([r.tobytes() for r in low], pa.binary()), pa.ListArray.from_arrays(np.arange(0, (len(n) + 1) * n_bands, n_bands, dtype=np.int32), to_signed(mix(bands).ravel()))],
                names,
            )

    return sketch


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, each run as one table; the caller bounds the runs."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _tiles(rows: DataFrame, group: str, pieces) -> DataFrame:
    """Rows of each group cut into ``pieces`` parts by hash, one copy for each two parts that meet: ti, tj, side.

    A group of one part stays together; otherwise every two rows meet in some tile of bounded size.
    """
    cut_up = rows.withColumn("_q", pieces).withColumn("_x", F.when(F.col("_q") > 1, F.pmod(F.xxhash64("k", F.lit(5)), F.col("_q"))).otherwise(F.lit(0)))
    met = cut_up.withColumn("_y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_q") - 1)))
    met = met.select("*", F.least("_x", "_y").alias("ti"), F.greatest("_x", "_y").alias("tj")).drop("_q", "_x", "_y")
    return met.repartition(group, "ti", "tj").sortWithinPartitions(group, "ti", "tj")


def _alike(agree: int):
    """Links of sketches that agree in ``agree`` coordinates, as the least star edges of each tile."""

    def alike(batches):
        for t in runs(batches, ["g", "ti", "tj"]):
            keys = t["k"].to_numpy()
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            m = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(keys), SKETCH)[order]
            left, right = [], []
            label = np.arange(len(keys))
            for i in range(len(keys) - 1):
                hit = np.flatnonzero((m[i + 1 :] == m[i]).sum(axis=1) >= agree) + i + 1
                hit = hit[label[hit] != label[i]]
                if len(hit):
                    left.append(np.full(len(hit), i))
                    right.append(hit)
                    label[hit] = label[i]  # a shortcut only: forest() below has the last word
            label = forest(len(keys), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(keys))
            moved = np.flatnonzero(keys[label] != keys)
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(keys[label[moved]]), pa.array(keys[moved])], ["a", "b"])

    return alike


def _linked(percent: int):
    """Links of full shingle sets, as the least star edges of each tile: intersections come from inverted lists."""

    def linked(batches):
        for t in runs(batches, ["g", "ti", "tj"]):
            t = t.sort_by("k")
            keys = t["k"].to_numpy()
            raw = [x.encode("utf-8") for x in t["t"].to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
            parts, sizes = [], []
            at = 0
            while at < len(raw):  # bounded numpy steps
                end = at + 1
                while end < len(raw) and offsets[end + 1] - offsets[at] < 2_000_000:
                    end += 1
                sets, first = shingle_sets(np.frombuffer(b"".join(raw[at:end]), np.uint8), offsets[at : end + 1] - offsets[at])
                parts.append(sets)
                sizes.append(np.diff(first))
                at = end
            sets, size = np.concatenate(parts), np.concatenate(sizes)
            first = np.concatenate([[0], np.cumsum(size)])
            n = len(keys)
            _, word = np.unique(sets, return_inverse=True)
            order = np.argsort(word, kind="stable")
            owner = np.repeat(np.arange(n), size)[order]  # of each shingle, the texts that have it, in order
            begin = np.concatenate([[0], np.cumsum(np.bincount(word))])
            left, right = [], []
            for i in range(n):
                w = word[first[i] : first[i + 1]]
                common = np.bincount(owner[ranges(begin[w], begin[w + 1] - begin[w])], minlength=n)
                hit = np.flatnonzero((100 * common >= percent * (size[i] + size - common)) & (size > 0))
                hit = hit[hit > i]
                left.append(np.full(len(hit), i))
                right.append(hit)
            label = forest(n, np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(keys[label] != keys)
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(keys[label[moved]]), pa.array(keys[moved])], ["a", "b"])

    return linked


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``key``, n_shingles, component_id and kept (key = component_id) for every row.

    Sets link whose intersection is at least ``percent`` % of their union; bands and the sketches' least agreement follow from it.
    Equal sets are one class from the start, by a 128-bit sum over the set. Class representatives meet
    in bands; buckets with the same members count once; sketches are compared inside tiles of a bounded
    number of rows, which yields candidate groups; inside these, full sets are compared exactly, again in
    tiles, and links between representatives give the components. Shuffles: the sketch table and its
    bands (a key and a hash a row), then texts of candidates once. No pairs are made into rows, and no
    group is held whole.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. A null key
    keeps its row with a null component_id and kept true. Rows with equal keys are one document. Other
    columns are not read; an empty table gives no rows.
    """
    bands, rows, agree = banding(percent)
    own = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"))
    sketched = cut(own.mapInArrow(_sketch_batches(bands, rows), "k long, n long, f1 long, f2 long, sketch binary, bands array<long>"))
    filled = sketched.where("n > 0 and k is not null")
    classes = cut(filled.groupBy("n", "f1", "f2").agg(F.min("k").alias("rep")))
    heads = filled.join(classes.withColumnRenamed("rep", "k"), ["n", "f1", "f2", "k"], "left_semi")
    banded = heads.select("k", F.explode("bands").alias("g")).distinct()
    buckets = banded.groupBy("g").agg(F.count("*").alias("c"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("s"), F.min("k").alias("m")).where("c > 1")
    once = buckets.groupBy("c", "s", "m").agg(F.min("g").alias("g")).select("g", "c")
    members = banded.join(once, "g").join(heads.select("k", "sketch"), "k")
    alike = _tiles(members.select("g", "k", "sketch", "c"), "g", F.ceil(F.col("c") / PIECE_ROWS)).select("g", "ti", "tj", "k", "sketch").mapInArrow(_alike(agree), "a long, b long")
    groups = components(alike).select(F.col("node").alias("k"), F.col("component").alias("g"))
    candidates = own.join(groups, "k").select("g", "k", "t", F.octet_length("t").alias("z"))
    weight = candidates.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / PIECE_ROWS), F.ceil(F.sum("z") / PIECE_BYTES)).alias("q"))
    linked = _tiles(candidates.join(weight, "g"), "g", F.col("q")).select("g", "ti", "tj", "k", "t").mapInArrow(_linked(percent), "a long, b long")
    joined = components(linked).select(F.col("node").alias("rep"), "component")
    named = sketched.select("k", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left").join(joined, "rep", "left")
    component = F.when(F.col("k").isNotNull(), F.coalesce("component", "rep", "k"))
    return named.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(True)).alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)


SHINGLE_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select doc_id, list_distinct(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w
), x as (select doc_id, len(sh) as n, unnest(sh) as g from s),
c as (select a.doc_id as p, b.doc_id as q, any_value(a.n) as np, any_value(b.n) as nq, count(*) as k from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as materialized (select p, q from c where 100 * k >= 85 * (np + nq - k)),
r as (select doc_id as u, doc_id as v from s union select r.u, l.q from r join l on r.v = l.p)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, m.component_id, s.doc_id = m.component_id as kept
from s join (select u, min(v) as component_id from r group by u) m on s.doc_id = m.u
"""

QUERIES = {"op5_near_duplicates": op5_near_duplicates}
ORACLES = {"op5_near_duplicates": SHINGLE_SQL}
