"""Quality classifier: hashed word and character n-gram vectors, averaged, with a softmax, by stochastic gradient descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm.bpe import code_points
from gramlake.llm.common import U64, crc_mod, grams, map_texts, mix, read, span_hashes, spans

#: Hashed buckets of each kind of feature, vector length, passes and first learning rate.
BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 8, 6, 1.5
#: Character n-grams, in code points.
SIZES = (3, 4)
#: The bucket of doubled words, after those of words, of pairs of neighbouring words, and of each n-gram size; and the number of buckets.
DOUBLED = (2 + len(SIZES)) * BUCKETS
ALL = DOUBLED + 1
#: Most labelled rows that training looks at, a sample by hash of the id, and most bytes of their texts: they meet on the driver.
TRAIN_ROWS, TRAIN_BYTES = 5000, 32_000_000

IS_VISIBLE = np.ones(256, bool)
IS_VISIBLE[[32, 9, 10, 11, 12, 13]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature and the text it is of: white-space words, pairs of neighbouring words, and n-grams of code points, inside one text.

    A pair of a word and itself counts twice: as that pair, and as a doubled word, whichever it is: what repeats differs from text
    to text, that it repeats doesn't.
    """
    starts, ends, first = spans(data, offsets, IS_VISIBLE)
    words = span_hashes(data, starts, ends)
    texts = np.arange(len(offsets) - 1, dtype=np.int32)
    row = np.repeat(texts, np.diff(first))
    together = row[1:] == row[:-1]
    codes = [(words & U64(BUCKETS - 1)).astype(np.int32), (grams(words, 2)[together] & U64(BUCKETS - 1)).astype(np.int32) + np.int32(BUCKETS)]
    rows = [row, row[1:][together]]
    twice = np.flatnonzero(together & (words[1:] == words[:-1]))
    codes.append(np.full(len(twice), DOUBLED, np.int32))
    rows.append(row[1:][twice])
    points, at = (data, None) if not len(data) or data.max() < 128 else code_points(data)
    row = np.repeat(texts, np.diff(offsets if at is None else np.searchsorted(at, offsets)))
    wide = points.astype(U64)
    for j, size in enumerate(SIZES, 2):
        n = len(points) - size + 1
        if n <= 0:
            continue
        code = np.full(n, size, U64)
        for i in range(size):
            code = (code << U64(21)) ^ (code >> U64(43)) ^ wide[i : i + n]
        keep = row[:n] == row[size - 1 :]
        codes.append((mix(code[keep]) & U64(BUCKETS - 1)).astype(np.int32) + np.int32(j * BUCKETS))
        rows.append(row[:n][keep])
    return np.concatenate(codes), np.concatenate(rows)


class Model:
    """Each bucket's part of the difference of the two logits, and the bias: what remains of vectors and softmax weights."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value.astype(np.float32), bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        code, row = features(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(row, weights=self.value[code], minlength=n)
        count = np.bincount(row, minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(1, count), -30, 30)))


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Plain stochastic gradient descent on the cross-entropy, one text at a time, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((ALL, DIM)) - 0.5) / DIM).astype(np.float32)
    weights, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    rows = []
    for text in texts:
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        code, _ = features(raw, np.array([0, len(raw)]))
        ids, counts = np.unique(code, return_counts=True)
        rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ vectors[ids]
            logit = weights @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ weights
            weights -= rate * np.outer(p, hidden)
            bias -= rate * p
            vectors[ids] -= (rate * len(ids) ** 0.5) * share[:, None] * back
    return Model(vectors @ (weights[1] - weights[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``rows`` labelled texts of at most ``size`` bytes in all, a repeatable sample by hash.

    Both bounds are on what reaches the driver: different (key, label, text) rows in the order of hashes, so that keys with many
    texts count as many; a text that would pass ``size`` is left out. Labels other than 0
    and 1 and null texts are left out; with none left, or one class, every score is that class's share (one half without labels).
    """
    place = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 62))
    known = labels.where(labels[label].isin(0, 1) & labels[key].isNotNull()).select(labels[key].alias("k"), labels[label].cast("int").alias("y")).distinct()
    n = known.count()
    if n > rows:  # a little more than is wanted, by hash; the rest goes in order
        known = known.where(place < int((1 << 62) * min(1.0, (rows + 5 * rows**0.5) / n)))
    known = known.withColumn("h", place).orderBy("h", "k", "y").limit(rows)
    texts = docs.select(docs[key].alias("k"), docs[text].alias("t")).where("t is not null")
    sample = texts.join(F.broadcast(known), "k").select("h", "k", "y", "t", F.octet_length("t").alias("z"), F.xxhash64("t").alias("x"))  # labels are bounded by rows; texts aren't, where ids repeat
    sizes = sample.select("h", "k", "y", "x", "z").distinct().orderBy(F.xxhash64("h", "x"), "k", "y", "x").limit(rows).collect()
    taken, total = [], 0
    for r in sizes:
        if total + r.z <= size:
            total += r.z
            taken.append((r.k, r.y, r.x, r.z))
    if not taken:
        return Model(np.zeros(ALL), 0.0)
    wanted = docs.sparkSession.createDataFrame(taken, sample.select("k", "y", "x", "z").schema)
    table = sample.join(F.broadcast(wanted), ["k", "y", "x", "z"], "left_semi").dropDuplicates(["k", "y", "x", "z"]).toPandas().sort_values(["h", "k", "y", "t"])
    y = table["y"].to_numpy(int)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(ALL), 0.0 if not len(y) else 30.0 * (2 * y[0] - 1))
    return fit(table["t"].tolist(), y)


def score(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, score (0 to 1) and predicted (1 from 0.5 on) of every whole text.

    One pass, no shuffle; the model (4 x BUCKETS numbers) is broadcast. Null and empty texts get the
    score of the bias alone; repeated rows each get theirs; other columns are not read; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        own = shared.value

        def run(data, offsets):
            s = own.scores(data, offsets)
            return pa.array(s), pa.array((s >= 0.5).astype(np.int32))

        return run

    return map_texts(docs, work, "score double, predicted int", text, carry)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 3) == 1
    model = train(docs.where(~held_out), labels.where(~held_out))
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality": op6_quality}
