"""Benchmark decontamination by winnowing: k-gram fingerprints, a join, and extension of the hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm.common import LOWER, U64, cut, grams, map_texts, ranges, read, span_hashes, spans, text_slices, to_signed

#: Words of a window that counts as a hit, of a k-gram, and k-grams that a winnowing window spans:
#: WINDOW = GRAM + SPAN - 1, so that every shared window shares its least k-gram.
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Bytes of benchmark text up to which its fingerprints are broadcast; beyond it they are joined.
BROADCAST_BYTES = 24_000_000

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, lower-cased in ASCII, and each text's first word (n + 1)."""
    starts, ends, first = spans(data, offsets, IS_WORD)
    return span_hashes(LOWER[data], starts, ends), first


def winnow(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are the last least one in a window of SPAN k-grams of one text."""
    g = grams(words, GRAM)
    n = len(g) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    least, at = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, SPAN):
        lower = g[j : j + n] <= least
        np.copyto(least, g[j : j + n], where=lower)
        at[lower] = j
    inside = np.zeros(len(words) + 1, bool)  # windows that lie in one text
    lengths = np.diff(first)
    long_ = lengths >= WINDOW
    inside[ranges(first[:-1][long_], lengths[long_] - WINDOW + 1)] = True
    chosen = np.zeros(len(g), bool)
    chosen[(np.arange(n) + at)[inside[:n]]] = True
    position = np.flatnonzero(chosen)
    return position, g[position]


def _places(start: np.ndarray, size: int, first: np.ndarray) -> np.ndarray:
    """Which starts (ordered or not, none negative) have ``size`` words of one text ahead of them."""
    text = np.searchsorted(first, start, side="right") - 1
    return (text < len(first) - 1) & (start + size <= first[np.minimum(text + 1, len(first) - 1)])


def around(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the windows, each once and inside one text, that hold the k-grams at ``at``: what a hit is extended to."""
    start = np.unique((at[:, None] - np.arange(SPAN)).ravel())
    start = start[start >= 0]
    ends = start + WINDOW
    text = np.searchsorted(first, start, side="right") - 1
    return start[ends <= first[text + 1]] if len(start) else start


def windows(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and hash of the windows of items: WINDOW words, or all of them where there are fewer."""
    lengths = np.diff(first)
    starts, sizes, hashes = [], [], []
    for size in (*sorted({int(n) for n in lengths if 0 < n < WINDOW}), WINDOW):
        some = lengths >= WINDOW if size == WINDOW else lengths == size
        start = ranges(first[:-1][some], lengths[some] - size + 1)
        starts.append(start)
        sizes.append(np.full(len(start), size))
        hashes.append(window_hash(words, size)[start])
    return tuple(map(np.concatenate, (starts, sizes, hashes)))


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words; windows of different sizes don't meet."""
    return grams(words, size) ^ U64(size * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


class Items:
    """A bounded set of benchmark items: their fingerprints, and each different window with the items that have it.

    A document's fingerprint that is one of the benchmark's is extended to the windows around it, which are looked up
    once each: how often a k-gram or a window occurs in the benchmark doesn't matter.
    """

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        raw = [t.encode("utf-8") for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
        words, first = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.prints = np.unique(winnow(words, first)[1])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.prints & U64((1 << 20) - 1)).astype(np.int64)] = True
        start, size, hashes = windows(words, first)
        self.sizes = sorted(set(size[size < WINDOW].tolist()))
        self.windows, which = np.unique(hashes, return_inverse=True)
        item = np.searchsorted(first, start, side="right") - 1
        pairs = np.unique(np.stack([which, item], 1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
        self.item, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words lie in a window that occurs, and the different (text, item) pairs of such windows, as an n x 2 array."""
        change = np.zeros(len(words) + 1, np.int32)
        at, prints = winnow(words, first)
        likely = self.maybe[(prints & U64((1 << 20) - 1)).astype(np.int64)]
        at = at[likely][np.isin(prints[likely], self.prints)]
        found = [(around(at, first), WINDOW)] + [(np.arange(max(0, len(words) - size + 1)), size) for size in self.sizes]
        pairs = []
        for start, size in found:
            start = start[_places(start, size, first)] if size < WINDOW else start
            if not len(start) or not len(self.windows):
                continue
            hashes = window_hash(words, size)[start]
            row = np.minimum(np.searchsorted(self.windows, hashes), len(self.windows) - 1)
            same = self.windows[row] == hashes
            start, row = start[same], row[same]
            np.add.at(change, start, 1)
            np.add.at(change, start + size, -1)
            pairs.append(np.stack([np.searchsorted(first, start, side="right") - 1, row], 1))
        both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        n = self.first[both[:, 1] + 1] - self.first[both[:, 1]] if len(both) else np.zeros(0, np.int64)
        out = np.stack([np.repeat(both[:, 0], n), self.item[ranges(self.first[both[:, 1]], n)]], 1) if len(both) else both
        return np.cumsum(change[:-1]) > 0, np.unique(out, axis=0)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``carry``, n_words, n_hit, n_items, items (sorted as strings) for every document.

    A window is WINDOW consecutive item words (a shorter item is one window); a document word in any
    occurrence of a window is hit. While the benchmark's texts stay within ``broadcast_bytes`` its
    fingerprints are broadcast and documents are matched in one pass without a shuffle; beyond that the documents'
    fingerprints meet the benchmark's different ones, and the windows around those that are there meet the different
    windows (``_joined``). Both give the same results. Null texts have no words
    and items without words or id match nothing; equal items each count; repeated rows each get their
    result; empty tables on either side give no hits.
    """
    items = benchmark.select(benchmark[item_id].alias("i"), benchmark[item_text].alias("t")).where("i is not null and t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t")), F.count("*")).first()
    if (size[0] or 0) + 100 * size[1] > broadcast_bytes:
        return _joined(docs, items, text, carry)
    rows = items.orderBy("i", "t").collect()  # bounded by broadcast_bytes
    shared = docs.sparkSession.sparkContext.broadcast(Items([str(r.i) for r in rows], [r.t for r in rows]))

    def work():
        own = shared.value
        names = np.array(own.ids, dtype=object)

        def run(data, offsets):
            words, first = word_hashes(data, offsets)
            hit, pairs = own.hits(words, first)
            total = np.concatenate([[0], np.cumsum(hit)])
            lists = [[] for _ in range(len(offsets) - 1)]
            for row, item in pairs.tolist():
                lists[row].append(names[item])
            lists = [sorted(set(x)) for x in lists]
            return pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]]), pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, pa.list_(pa.string()))

        return run

    return map_texts(docs, work, "n_words long, n_hit long, n_items long, items array<string>", text, carry)


def _rows(df: DataFrame, kind: str, work, columns: str) -> DataFrame:
    """Rows that ``work(words, first, hits)`` makes of each run of texts: key k, and its columns. Column p, if there is one, is a list for each text."""
    names = ["k", *(c.split()[0] for c in columns.split(","))]

    def run(batches):
        for batch, data, offsets in text_slices(batches, "t"):
            words, first = word_hashes(data, offsets)
            lists = batch.column(batch.schema.get_field_index("p")) if "p" in batch.schema.names else None
            row, *values = work(words, first, lists)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(v) for v in values)], names)

    return df.mapInArrow(run, f"k {kind}, {columns}")


def _prints(words, first, _):
    """Different fingerprints of each text."""
    at, prints = winnow(words, first)
    both = np.unique(np.stack([(np.searchsorted(first, at, side="right") - 1).astype(U64), prints], 1), axis=0)
    return both[:, 0].astype(np.int64), to_signed(both[:, 1].copy())


def _windows(words, first, _):
    """Different windows of each item."""
    start, _, hashes = windows(words, first)
    both = np.unique(np.stack([(np.searchsorted(first, start, side="right") - 1).astype(U64), hashes], 1), axis=0)
    return both[:, 0].astype(np.int64), to_signed(both[:, 1].copy())


def _extended(sizes: list[int]):
    """Windows around the fingerprints listed for each text, and those of short items' sizes: start, size, hash."""

    def work(words, first, lists):
        at, prints = winnow(words, first)
        owner = np.searchsorted(first, at, side="right") - 1
        count = np.array([0 if x is None else len(x) for x in lists.to_pylist()], np.int64)
        listed = np.stack([np.repeat(np.arange(len(count)), count).astype(U64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)], 1)
        own = np.stack([owner.astype(U64), prints], 1)
        _, which = np.unique(np.concatenate([listed, own]), axis=0, return_inverse=True)
        at = at[np.isin(which.ravel()[len(listed) :], which.ravel()[: len(listed)])]
        parts = [(around(at, first), WINDOW)]
        for size in sizes:
            start = np.arange(max(0, len(words) - size + 1))
            parts.append((start[_places(start, size, first)], size))
        start = np.concatenate([p for p, _ in parts])
        hashes = np.concatenate([window_hash(words, size)[p] for p, size in parts])
        text = np.searchsorted(first, start, side="right") - 1
        return text, start - first[text], np.repeat([size for _, size in parts], [len(p) for p, _ in parts]), to_signed(hashes)

    return work


def _count_words():
    return lambda data, offsets: (pa.array(np.diff(word_hashes(data, offsets)[1])),)


def _joined(docs: DataFrame, items: DataFrame, text: str, carry: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark of any size; equal texts are one, and nothing is compared pair by pair.

    Shuffles: fingerprints, which meet the benchmark's different ones; the texts, with those found; and the windows around
    them, which meet the benchmark's different windows. A boilerplate k-gram or window is one row of the benchmark's side, so
    that a hot one costs its own rows alone; the skewed side of a join can be split.
    """
    keyed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(docs[text], F.lit("")).alias("t")).withColumn("d", F.sha2("t", 256))
    texts = keyed.select(F.col("d").alias("k"), "t").dropDuplicates(["k"])
    named = items.select(F.col("i").cast("string").alias("k"), "t")
    of_items = cut(_rows(named, "string", _windows, "w long").distinct())
    lengths = map_texts(named, _count_words, "n long", "t", ("k",)).where(F.col("n").between(1, WINDOW - 1)).select("n").distinct()
    sizes = sorted(r.n for r in lengths.collect())  # fewer than WINDOW values
    known = _rows(named, "string", _prints, "p long").select("p").distinct()
    found = _rows(texts, "string", _prints, "p long").join(known, "p", "left_semi").groupBy("k").agg(F.collect_list("p").alias("p"))
    near = texts.join(found, "k", "left" if sizes else "inner").select("k", "t", "p")
    hits = cut(_rows(near, "string", _extended(sizes), "s long, z long, w long").join(of_items.select("w").distinct(), "w", "left_semi"))
    grow = lambda a, x: F.struct(F.greatest(a["end"], x["s"] + x["z"]).alias("end"), (a["n"] + F.greatest(x["s"] + x["z"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n"))
    places = hits.select("k", "s", "z").distinct().groupBy("k").agg(F.sort_array(F.collect_list(F.struct("s", "z"))).alias("a"))
    n_hit = places.select(F.col("k").alias("d"), F.aggregate("a", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), grow, lambda a: a["n"]).alias("n_hit"))
    pairs = hits.select(F.col("k").alias("d"), "w").distinct().join(of_items.withColumnRenamed("k", "i"), "w").groupBy("d").agg(F.sort_array(F.collect_set("i")).alias("items"))
    n_words = map_texts(keyed, _count_words, "n_words long", "t", (*[f"c{i}" for i in range(len(carry))], "d"))
    out = n_words.join(n_hit, "d", "left").join(pairs, "d", "left")
    none = F.array().cast("array<string>")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws"
WINDOW_SQL = f"""
with d as (select doc_id, {_WORDS} from documents), b as (select item_id, {_WORDS} from benchmark where item_id is not null),
i as (select item_id, least(len(ws), 10) as n, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda j: array_to_string(ws[j:j + least(len(ws), 10) - 1], ' '))) as g from b where len(ws) > 0),
w as (select distinct n from i),
o as (select doc_id, n, unnest(range(1, len(ws) - n + 2)) as j, unnest(list_transform(range(1, len(ws) - n + 2), lambda j: array_to_string(ws[j:j + n - 1], ' '))) as g from d, w where len(ws) >= n),
h as (select distinct doc_id, j, o.n, item_id from o join i on o.n = i.n and o.g = i.g),
x as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(j, j + n)) as pos from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from h) group by 1)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join x using (doc_id) left join t using (doc_id)
"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {"op7_decontaminate": WINDOW_SQL}
