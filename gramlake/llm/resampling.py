"""Importance resampling towards a target: hashed feature weights in an array, and the draw by distributed quickselect."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm.common import LOWER, U64, cut, map_texts, mix, read, spans, text_slices
from gramlake.operators.windows import global_index

#: Hashed buckets of words.
BUCKETS = 10_000
#: Seed of the noise, percentage that is drawn, and the least words of a document that may be.
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: Pivots of a round of the quickselect; a round leaves about one of PIVOTS + 1 parts of the rows.
PIVOTS = 15
#: Bytes up to which the hashes of words are made side by side, byte by byte; longer words are hashed one by one.
SIDE_BY_SIDE = 48

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of every byte span: all spans advance by a byte at a time, longest first."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    start, length = starts[order], length[order]
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    n_long = int(np.searchsorted(-length, -SIDE_BY_SIDE, side="left"))
    for j in range(SIDE_BY_SIDE):
        live = int(np.searchsorted(-length, -j, side="left"))  # those longer than j
        if live <= n_long:
            break
        part = slice(n_long, live)
        crc[part] = _CRC[(crc[part] ^ data[start[part] + j]) & 0xFF] ^ (crc[part] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(n_long):
        crc[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes())
    out = np.empty(len(crc), np.uint32)
    out[order] = crc
    return out


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word of the lower-cased texts, and each text's first word (n + 1)."""
    lower = LOWER[data]
    starts, ends, first = spans(lower, offsets, IS_WORD)
    return (crc_spans(lower, starts, ends) % np.uint32(BUCKETS)).astype(np.int64), first


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Words in each bucket over all rows. A task sends its counts once; the driver gets BUCKETS numbers."""

    def each(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, data, offsets in text_slices(batches, "t"):
            total += np.bincount(word_buckets(data, offsets)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in df.select(df[text].alias("t")).mapInArrow(each, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: 1000 times the smoothed log ratio of its target and source shares, rounded down."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(df: DataFrame, gain: np.ndarray, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, n_features and weight of every row: an array lookup for each word, added up by row. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def work():
        own = shared.value

        def run(data, offsets):
            bucket, first = word_buckets(data, offsets)
            sums = np.concatenate(([0], np.cumsum(own[bucket])))
            return pa.array(np.diff(first).astype(np.int64)), pa.array(sums[first[1:]] - sums[first[:-1]])

        return run

    return map_texts(df, work, "n_features long, weight long", text, carry)


def noise(key: str, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), with u from the first 8 hex digits of sha256(``seed:key``); a null key counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def _compare(columns: list[np.ndarray], key: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Which rows lie above a key, and which are equal to it."""
    above, equal = np.zeros(len(columns[0]), bool), np.ones(len(columns[0]), bool)
    for c, x in zip(columns, key, strict=True):
        above |= equal & (c > x)
        equal &= c == x
    return above, equal


def _round(rows: DataFrame, low: tuple | None, high: tuple | None, drawn: list[tuple], share: float, seed: int) -> list:
    """For rows between low and high: how many lie below, at and above each of the pivots, and some random keys of each part."""
    width = len(rows.columns)
    limit = U64(min(int(share * 2**64), 2**64 - 1))

    def each(batches):
        total, sample = np.zeros(2 * len(drawn) + 1, np.int64), []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keep = np.ones(batch.num_rows, bool)
            if low is not None:
                keep &= _compare(columns, low)[0]
            if high is not None:
                above, equal = _compare(columns, high)
                keep &= ~above & ~equal
            columns = [c[keep] for c in columns]
            part = np.zeros(len(columns[0]), np.int64)
            for p in drawn:
                above, equal = _compare(columns, p)
                part += 2 * above + equal
            total += np.bincount(part, minlength=len(total))
            h = np.full(len(part), seed, U64)
            for c in columns:
                h = mix(h ^ c.view(U64))
            at = np.flatnonzero(h <= limit)
            sample.append(np.stack([part[at], *[c[at] for c in columns]]))
        sample = np.concatenate(sample, axis=1) if sample else np.zeros((width + 1, 0), np.int64)
        at = np.flatnonzero(total)
        none = [None] * len(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, sample[0]])), pa.array([*total[at].tolist(), *[0] * sample.shape[1]], pa.int64())] + [pa.array([*none, *c.tolist()], pa.int64()) for c in sample[1:]], ["part", "n", *[f"c{i}" for i in range(width)]])

    key = F.struct(*[f"c{i}" for i in range(width)])
    out = rows.mapInArrow(each, ", ".join(["part long", "n long", *[f"c{i} long" for i in range(width)]]))
    return out.groupBy("part").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("c0").isNotNull(), key)).alias("keys")).orderBy("part").collect()


def kth(rows: DataFrame, keys: list[str], k: int, n: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th least (from 1) of the ``n`` keys ``keys``, longs without nulls; None beyond the rows. Equal keys count each.

    Random pivots split the rows that are left into those below, at and above each. A round is one scan, in which a task counts every part
    and offers random keys of it as the next pivots, about 64 of a part in all; the driver gets these few. The rows
    left shrink to about 1 / (pivots + 1) a round, and none is sorted or moved.
    """
    if k > n or k < 1:
        return None
    rows = rows.select(*keys)
    low = high = None
    drawn: list[tuple] = []
    share = 64 / n
    for turn in range(10_000):
        for r in _round(rows, low, high, drawn, share, turn):  # at most 2 * pivots + 1
            if k > r.n:
                k -= r.n
                continue
            place = r.part // 2
            if r.part % 2:
                return drawn[place]
            low, high = drawn[place - 1] if place else low, drawn[place] if place < len(drawn) else high
            found = sorted({tuple(x) for x in r["keys"]})
            drawn = [found[(2 * i + 1) * len(found) // (2 * pivots)] for i in range(pivots)] if len(found) > pivots else found
            share = 64 * (pivots + 1) / r.n if drawn else share * 64
            break
        else:
            return None
    raise RuntimeError("no key found")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, seed: int = SEED, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document.

    Two passes over the documents, one for the counts of buckets and one for weights; what is written then is a few numbers a
    row, on which the draw works. Only drawn rows are sorted and numbered. Repeated rows are documents of their own; among equal
    scores smaller keys come first, null keys last, then smaller n_features and weight. Null texts have no words; an empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    own = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    gain = gains(bucket_counts(own), bucket_counts(target.select(target[text].alias("text"))))
    scored = weigh(own, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = cut(scored.select("*", (-F.col("score")).alias("k0"), F.col("doc_id").isNull().cast("long").alias("k1"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("k2"), F.monotonically_increasing_id().alias("k3")))
    keys = ["k0", "k1", "k2", "n_features", "weight", "k3"]
    may = F.col("n_features") >= least
    n = scored.where(may).count()
    last = kth(scored.where(may), keys, percent * n // 100, n)
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = may & (F.struct(*keys) <= F.struct(*[F.lit(int(x)).cast("long").alias(c) for c, x in zip(keys, last, strict=True)]))
    ranked = global_index(scored.where(drawn), keys, "rank").select(*out, (F.col("rank") + 1).alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: crc32 of a string's UTF-8 bytes, in SQL.
def crc_sql(text: str) -> str:
    step = "lambda c, _: xor(c >> 1, (c & 1) * 3988292384)"
    byte = "cast('0x' || substr(hx, 2 * j + 1, 2) as bigint)"
    one = f"list_reduce(range(8), {step}, xor(c, {byte}))"
    return f"(select xor(list_reduce(range(length(hx) // 2), lambda c, j: {one}, cast(4294967295 as bigint)), 4294967295) from (select hex(encode({text})) as hx))"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
RESAMPLE_SQL = f"""
with d as (select doc_id, {_WORDS} as ws from documents), w as (select doc_id, unnest(ws) as w from d), b as (select unnest({_WORDS}) as w from benchmark),
h as (select w, {crc_sql("w")} % {BUCKETS} as k from (select w from w union select w from b)),
s as (select k, count(*) as s from w join h using (w) group by k), t as (select k, count(*) as t from b join h using (w) group by k),
g as (select k, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from w) + {BUCKETS})::double / ((coalesce(s, 0) + 1)::double * ((select count(*) from b) + {BUCKETS})::double))) as bigint) as gain from s full join t using (k)),
x as (select doc_id, cast(sum(gain) as bigint) as weight from w join h using (w) join g using (k) group by doc_id),
y as (select doc_id, cast(len(ws) as bigint) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) as bigint) + 0.5) / 4294967296))) as bigint) as score from d left join x using (doc_id)),
z as (select doc_id, row_number() over (order by score desc, doc_id) as r from y where n_features >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when r <= {PERCENT} * (select count(*) from z) // 100 then r end as rank from y left join z using (doc_id)
"""

QUERIES = {"op12_resample": op12_resample}
ORACLES = {"op12_resample": RESAMPLE_SQL}
