"""Language identification: script ranges narrow the languages, Viterbi labels the words, spans decide."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm.bpe import LETTER, char_classes, code_points
from gramlake.llm.common import LOWER, U64, crc_mod, map_texts, mix, ranges, read, span_hashes, spans, text_slices

#: Buckets for each n-gram size (hashed), the sizes, the smoothing and the cost of switching language, in nats.
BUCKETS, SIZES, SMOOTH, SWITCH = 1 << 16, (2, 3, 4), 0.5, 6.0
#: How near sums of scores may come to each other before their order is left to the steps themselves.
TIE = 1e-3
#: A script belongs to a language from this share of its letters.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

# First code points of Unicode script ranges, and the script from there on.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0x4DC0, "other"), (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
LATIN = SCRIPTS.index("latin")

IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


class Words:
    """Letter runs of a slice of texts: where they are, which of the different ones each is, and those ones' n-gram codes and script.

    Words recur, so n-grams are hashed once for each different word (by its 64-bit hash).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, ends, self.first = spans(data, offsets, IS_LETTER)
        self.lengths = ends - self.starts
        _, place, self.which = np.unique(span_hashes(LOWER[data], self.starts, ends), return_index=True, return_inverse=True)
        starts, self.sizes = self.starts[place], self.lengths[place]
        # different words side by side with blanks between them: n-grams see word edges and nothing of their neighbours
        self.at = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if len(place) else np.zeros(0, np.int64)
        total = int(self.sizes.sum())
        blanks = max(SIZES) - 2
        text = np.full(total + blanks * len(place) + 4, 32, U64)
        letter = np.arange(total) + blanks * np.repeat(np.arange(len(place)), self.sizes) + 1
        text[letter] = LOWER[data[ranges(starts, self.sizes)]]
        self.codes = []
        for size in SIZES:
            code = np.full(total, size, U64)
            for j in range(size):
                code = code * U64(0x100000001B3) + text[letter - 1 + j]
            self.codes.append((mix(code) & U64(BUCKETS - 1)).astype(np.int32))
        self.script = np.full(len(place), LATIN, np.int8)
        wide = np.flatnonzero(data >= 128)
        if len(wide):
            points, byte = code_points(data)
            foreign = np.flatnonzero(points >= 0x370)
            kind = _SCRIPT[np.searchsorted(_STARTS, points[foreign], side="right") - 1]
            is_letter = char_classes()[points[foreign]] == LETTER
            word = np.searchsorted(self.starts, byte[foreign[is_letter]], side="right") - 1
            self.script[self.which[word[::-1]]] = kind[is_letter][::-1]  # a word's first letter outside Latin decides


#: Bytes from which on a single text is labelled in pieces, and of a piece.
LONG_BYTES, PIECE_BYTES = 4_000_000, 250_000


class Model:
    """Log-probabilities of n-grams for each language, and each language's scripts."""

    def __init__(self, languages: list[str], logs: np.ndarray, scripts: np.ndarray):
        self.languages, self.logs = languages, logs  # language, size, bucket
        self.allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))  # language, script
        self.allowed[:, ~self.allowed.any(axis=0)] = True

    @staticmethod
    def weigh(counts: np.ndarray) -> np.ndarray:
        """Smoothed log-probabilities of n-grams (size, bucket), each size with its share."""
        smooth = counts + SMOOTH
        return (np.log(smooth / smooth.sum(axis=-1, keepdims=True)) / len(SIZES)).astype(np.float32)

    def scores(self, words: Words) -> np.ndarray:
        """Words by languages."""
        out = np.empty((len(words.at), len(self.languages)), np.float32)
        for i in range(len(self.languages)):
            total = sum(self.logs[i, j][code] for j, code in enumerate(words.codes))
            out[:, i] = np.add.reduceat(total, words.at) if len(words.at) else 0
        out[~self.allowed.T[words.script]] -= 1000
        return out[words.which]

    def steady(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The language in which each text stays best throughout, -1 where no such language is certain.

        Leaving the language of the largest sum for a run of words gains at most the sum of the others' lead over it and
        costs two switches, or one at an end of the text, or none for the whole text. Where no run gains that much, staying
        is what Viterbi finds.
        """
        n, counts = len(first) - 1, np.diff(first)
        out = np.full(n, -1)
        some = np.flatnonzero(counts)
        if not len(some) or scores.shape[1] < 2:
            out[some] = 0
            return out
        begin, wide = first[some], np.repeat(np.arange(len(some)), counts[some])
        best = np.add.reduceat(scores, begin, axis=0, dtype=np.float64).argmax(axis=1)
        rest = scores.astype(np.float64)
        own = rest[np.arange(len(rest)), best[wide]].copy()
        rest[np.arange(len(rest)), best[wide]] = -np.inf
        lead = rest.max(axis=1) - own
        sums = np.cumsum(lead)
        before = np.concatenate([[0.0], sums])[begin]  # of each text's words from 1 on
        sums -= before[wide]
        head = np.maximum.reduceat(sums, begin)
        # the largest sum of a run that ends at each word: sums less the least one before it, in the same text
        shift = wide * (2 * np.abs(sums).max() + 1.0)
        previous = np.concatenate([[0.0], sums[:-1]])
        previous[begin] = 0.0
        least = np.minimum.accumulate(previous - shift) + shift
        inner = np.maximum.reduceat(sums - least, begin)
        total = sums[np.append(begin[1:], len(sums)) - 1]
        tail = total - np.minimum.reduceat(previous, begin)
        sure = (inner < 2 * SWITCH - TIE) & (head < SWITCH - TIE) & (tail < SWITCH - TIE) & (total < -TIE)
        out[some[sure]] = best[sure]
        return out

    def labels(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi over each text's words; staying is free, switching costs SWITCH. Steady texts need no steps."""
        steady, counts = self.steady(scores, first), np.diff(first)
        kind = np.int8 if scores.shape[1] <= 128 else np.int32  # of a language's index
        label = np.repeat(steady, counts).astype(kind)
        mixed = np.flatnonzero(steady < 0)
        if counts[mixed].sum():
            at = ranges(first[mixed], counts[mixed])
            label[at] = self._steps(scores[at], np.concatenate([[0], np.cumsum(counts[mixed])]), kind)
        return label

    def shares(self, data: np.ndarray, piece: int | None = None) -> tuple[bool, np.ndarray]:
        """Whether a long text holds a letter, and the letters of each language in it, without ever scoring it whole.

        A first run over its pieces keeps the best values at each piece's start; a second one goes back from the last piece to
        the first, takes the steps of one piece again and follows them. Labels are those of ``labels``; memory is a piece's.
        """
        cuts, k = piece_ends(data, piece or PIECE_BYTES), len(self.languages)
        value, starts, letters = np.zeros(k), [], False
        for a, b in itertools.pairwise(cuts):
            whole = np.array([0, b - a])
            letters = letters or bool(has_letter(data[a:b], whole)[0])
            starts.append(value)
            value = self._forward(self.scores(Words(data[a:b], whole)), value)[0] if k else value
        share = np.zeros(k + 1)
        if k:
            now = int(value.argmax())
            for (a, b), value in zip(reversed([*itertools.pairwise(cuts)]), reversed(starts), strict=True):
                words = Words(data[a:b], np.array([0, b - a]))
                _, stay, best = self._forward(self.scores(words), value)
                label = np.empty(len(best), np.int64)
                for i in range(len(best) - 1, -1, -1):
                    label[i] = now
                    now = now if stay[i, now] else int(best[i])
                share += np.bincount(label, words.lengths, k + 1)
        return letters, share

    @staticmethod
    def _forward(scores: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best values after some words, and for each word where staying is as good as switching, and what to switch from."""
        v, stay, best = value.copy(), np.empty(scores.shape, bool), np.empty(len(scores), np.int32)
        for i, s in enumerate(scores):
            best[i] = at = v.argmax()
            top = v[at] - SWITCH
            np.greater_equal(v, top, out=stay[i])
            np.maximum(v, top, out=v)
            v += s
        return v, stay, best

    @staticmethod
    def _steps(scores: np.ndarray, first: np.ndarray, kind: type) -> np.ndarray:
        """All texts in step, word by word, the longest texts first, so that a step's words lie side by side."""
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = np.lexsort((np.repeat(rank, counts), ranges(np.zeros(len(counts), np.int64), counts)))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(ranges(np.zeros(len(counts), np.int64), counts)))]).tolist()
        by_step = scores[place].astype(np.float64)
        stay, best = np.empty(scores.shape, bool), np.empty(len(scores), kind)
        value = np.zeros((len(counts), scores.shape[1]))
        for a, b in itertools.pairwise(bounds):
            v = value[: b - a]
            best[a:b] = v.argmax(axis=1)
            top = v.max(axis=1, keepdims=True) - SWITCH
            np.greater_equal(v, top, out=stay[a:b])
            np.maximum(v, top, out=v)
            v += by_step[a:b]
        label, now, rows = np.empty(len(scores), kind), value.argmax(axis=1), np.arange(len(counts))
        for a, b in itertools.pairwise(bounds[::-1]):
            some = now[: a - b]
            label[b:a] = some
            some[:] = np.where(stay[b:a][rows[: a - b], some], some, best[b:a])
        out = np.empty(len(scores), kind)
        out[place] = label
        return out


def train(docs: DataFrame, text: str = "text", language: str = "lang") -> Model:
    """Count n-grams and scripts of each language over all given rows with a language; sums meet by (language, code).

    What reaches the driver is at most languages x (sizes x BUCKETS + scripts) counts.
    """
    named = docs.where(docs[language].isNotNull() & docs[text].isNotNull()).select(docs[language].cast("string").alias("l"), docs[text].alias("t"))
    width = len(SIZES) * BUCKETS + len(SCRIPTS)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        pieces = ((batch, data[a:b], np.array([0, b - a])) if len(offsets) == 2 else (batch, data, offsets) for batch, data, offsets in text_slices(batches, "t") for a, b in itertools.pairwise(piece_ends(data, LONG_BYTES) if len(offsets) == 2 else [0, len(data)]))
        for batch, data, offsets in pieces:
            words = Words(data, offsets)
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            row = np.searchsorted(words.first, np.arange(len(words.which)), side="right") - 1
            for name in set(names.tolist()):
                times = np.bincount(words.which[(names == name)[row]], minlength=len(words.at))
                by_letter = np.repeat(times, words.sizes)
                own = sums.setdefault(name, np.zeros(width, np.int64))
                for j, code in enumerate(words.codes):
                    own[j * BUCKETS : (j + 1) * BUCKETS] += np.bincount(code, by_letter, BUCKETS).astype(np.int64)
                own[len(SIZES) * BUCKETS :] += np.bincount(words.script, times * words.sizes, len(SCRIPTS)).astype(np.int64)
        for name, own in sums.items():
            code = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(own[code])], ["l", "c", "n"])

    table = named.mapInArrow(count, "l string, c int, n long").groupBy("l", "c").agg(F.sum("n").alias("n")).groupBy("l").agg(F.collect_list("c").alias("c"), F.collect_list("n").alias("n"))
    arrow = table.toArrow().sort_by("l")  # one row a language, of at most width numbers
    languages, grams = arrow["l"].to_pylist(), len(SIZES) * BUCKETS
    logs, scripts = np.empty((len(languages), len(SIZES), BUCKETS), np.float32), np.zeros((len(languages), len(SCRIPTS)))
    for i in range(len(languages)):
        counts = np.zeros(width)
        counts[arrow["c"][i].values.to_numpy()] = arrow["n"][i].values.to_numpy()
        logs[i], scripts[i] = Model.weigh(counts[:grams].reshape(len(SIZES), BUCKETS)), counts[grams:]
    return Model(languages, logs, scripts)


def piece_ends(data: np.ndarray, size: int) -> list[int]:
    """Places that cut bytes into pieces of at least ``size``, each behind white space, so that no word is cut."""
    ends, n = [0], len(data)
    while ends[-1] < n:
        at = ends[-1] + size
        while at < n:
            white = np.flatnonzero(data[at : at + size] <= 32)
            if len(white):
                at += int(white[0]) + 1
                break
            at += size
        ends.append(min(at, n))
    return ends


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    points, at = code_points(data)
    total = np.concatenate([[0], np.cumsum(char_classes()[points] == LETTER)])
    first = np.searchsorted(at, offsets)
    return total[first[1:]] > total[first[:-1]]


def identify(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, lang_pred and score of every row: the language of most letters, and its share of them.

    One pass, no shuffle; the model (languages x SIZES x BUCKETS numbers) is broadcast. ``und`` with score
    0 where the text is null, empty or without a letter, or where the model knows no language. Equal
    shares go to the language that sorts first; repeated rows each get their result; other columns are
    not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], dtype=object)

        def run(data, offsets):
            n, k = len(offsets) - 1, len(own.languages)
            if len(data) > LONG_BYTES and n == 1:
                letters, share = own.shares(data)
                known, share = np.array([letters]), share[None, :]
            else:
                known = has_letter(data, offsets)
                share = np.zeros((n, k + 1))
                if k:
                    words = Words(data, offsets)
                    label = own.labels(own.scores(words), words.first)
                    row = np.searchsorted(words.first, np.arange(len(label)), side="right") - 1
                    share = np.bincount(row * (k + 1) + label, weights=words.lengths, minlength=n * (k + 1)).reshape(n, k + 1)
            known &= share.sum(axis=1) > 0
            best = np.where(known, share.argmax(axis=1), k)
            score = np.where(known, share.max(axis=1) / np.maximum(1, share.sum(axis=1)), 0.0)
            return pa.array(names[best].tolist(), pa.string()), pa.array(score)

        return run

    return map_texts(docs, work, "lang_pred string, score double", text, carry)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = train(docs.where(~held_out))
    return identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language": op9_language}
