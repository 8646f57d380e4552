"""Edge cases and brute-force checks of the text operators."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gramlake.llm import decontamination, language, linededup, neardup, packing, pii, quality, tokens, webtext

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, t string, k string, w long, c0 string"


def table(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", "y", 7, "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id here at all"), (5, "é" * 3000 + " " + "x" * 200_000), (6, "a b\r\nc\x00d <|endoftext|> 's 're don't  　 x")]


def test_token_counts(spark, empty):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = [*map(chr, range(32, 0x250)), " ", "٠", "\U0001f600", "'ll", "<|endoftext|>", "  ", "\n"] + ["a", " ", "'s"] * 60
    rows = ODD + [(100 + i, "".join(rng.choices(letters, k=rng.randint(0, 30)))) for i in range(300)]
    got = tokens.count_tokens(table(spark, rows), PATH).collect()
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.count_tokens(empty, PATH).count() == 0


def test_packing_round_trip(spark, empty):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    rows = ODD + [(100 + i, " ".join(rng.choices(["alpha", "beta", "gamma", "x1"], k=rng.randint(0, 5000)))) for i in range(60)]
    rows = [r for r in rows if r[0] != 4] + [(4, "word")]
    got = packing.pack(table(spark, rows), PATH).collect()
    import zlib

    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack(empty, PATH).count() == 0


def test_sum_of_squares_rule():
    p = packing.SumOfSquares(10, 0)
    for size in (6, 6, 4, 3):
        p._place(("d", 0, np.zeros(size, "<u4"), size))
    # the 4 fills one 6; the 3 joins the other one, which leaves the sum of squares as it is, rather than opening a level
    assert p.level.sum() == 1 and p.level[9] == 1 and len(p.rows) == 2


def test_packing_places_as_the_rule_says():
    """Every placement has the least sum of squared counts of partly filled windows among all that are possible."""
    rng = random.Random(21)
    p = packing.SumOfSquares(12, 0)
    for i in range(300):
        level = p.level.copy()
        size = rng.randint(1, 11)
        squares = lambda lv: int((lv[1:12] ** 2).sum())
        sums = {}
        for h in [0, *np.flatnonzero(level[1:12]) + 1]:
            if h + size <= 12:
                new = level.copy()
                new[h] -= h > 0
                new[h + size] += h + size < 12
                sums[h] = squares(new)
        p._place((i, 0, np.zeros(size, "<u4"), size))
        assert squares(p.level) == min(sums.values())
    placed = sum(r[2] for r in p.rows) + sum(len(x[2]) for windows in p.open.values() for w in windows for x in w)
    assert p.n_open == p.level.sum() == sum(map(len, p.open.values())) and placed > 0
    p.close()
    assert not p.n_open and sum(r[2] for r in p.rows) == placed


def test_packing_with_few_open_windows(spark, monkeypatch):
    """Closing all windows early changes placements and loses nothing."""
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 3)
    p = packing.SumOfSquares(2048, 0)
    rng = random.Random(22)
    sizes = [rng.randint(1, 5000) for _ in range(200)]
    for i, n in enumerate(sizes):
        p.add(i, np.full(n, i, "<u4"))
    p.close()
    got = {}
    for key, start, length, *_ in p.rows:
        got.setdefault(key, []).append((start, length))
    for i, n in enumerate(sizes):
        parts = sorted(got[i])
        assert [a for a, _ in parts] == [sum(b for _, b in parts[:j]) for j in range(len(parts))] and sum(b for _, b in parts) == n


WINDOW_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    lower = lambda t: WINDOW_WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, ids = lower(text), set(), set()
    for i, t in items:
        w = lower(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            for a in range(len(words) - n + 1):
                if words[a : a + n] == w[s : s + n]:
                    hit |= set(range(a, a + n))
                    ids.add(str(i))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_decontamination(spark, empty, limit):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünder", "über"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, "w1 w2"), (52, "w1 w2")]
    rows = [r for r in ODD if r[0] != 5]
    for i in range(40):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 2:
            own = rng.choice(items)[1] or ""
            words[5:5] = [w.upper() for w in own.split()]
        rows.append((100 + i, " ".join(words)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(table(spark, rows), benchmark, broadcast_bytes=limit).collect()
    want = [(i, *brute_hits(t, items)) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r.n_items == len(r["items"]) for r in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(table(spark, rows), none, broadcast_bytes=limit).where("n_hit > 0").count() == 0
    assert decontamination.find_contamination(empty, benchmark, broadcast_bytes=limit).count() == 0


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_decontamination_of_boilerplate(spark, limit):
    """One k-gram at thousands of places of the benchmark, and one line in all documents and items."""
    line = "this one line stands in every item and in every text of all"
    items = [(i, f"{line} item {i} " + "la " * 300) for i in range(40)] + [(99, "la la la")]
    rows = [(i, f"{line} own {i} " + "la " * (i % 9)) for i in range(60)] + [(100, "la " * 5000), (101, "nothing of it")]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.find_contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=limit).collect()}
    for i in range(60):
        n = i % 9
        assert got[i] == (13 + (n if n >= 3 else 0), 40 + (n >= 3))
    assert got[100] == (5000, 41) and got[101] == (0, 0)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in keys}


@pytest.mark.parametrize("piece", [neardup.PIECE_ROWS, 7])
def test_near_duplicates(spark, empty, piece, monkeypatch):
    monkeypatch.setattr(neardup, "PIECE_ROWS", piece)
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word"), (6, "Word "), (7, "a b c d e f")]
    base = [rng.choice("abcdefghij") * rng.randint(1, 5) + str(rng.randint(0, 99)) for _ in range(150)]
    for i in range(60):  # near copies that drift, copies, and texts that share a half
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(150)] = f"z{rng.randint(0, 10_000)}"
        rows.append((100 + i, " ".join(words)))
    for i in range(20):
        rows.append((300 + i, " ".join(base[:70] + [f"q{rng.randint(0, 10_000)}" for _ in range(80)])))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in brute_components(rows).items()}
    assert got == want
    odd = neardup.near_duplicates(table(spark, [(None, "a b c d e f"), (8, "a b c d e f"), (8, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in odd) == [(0, 0, True), (8, 8, True), (8, 8, True)]
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_the_pipeline_link_at_80(spark):
    rng = random.Random(11)
    rows = []
    for i in range(30):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(150)]
        rows.append((2 * i, " ".join(words)))
        for at in (30, 75, 120):  # 15 of 146 shingles differ: 131 / 161 = 0.81
            words[at] = f"z{rng.randint(0, 10**9)}"
        rows.append((2 * i + 1, " ".join(words)))
    left = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), "")
    assert sorted(r.doc_id for r in left.collect()) == [2 * i for i in range(30)]
    assert neardup.near_duplicates(table(spark, rows)).where("kept").count() == 60
    assert neardup.banding(85) == (25, 5, 88)
    for percent in (60, 80, 85, 95):
        bands, n, _ = neardup.banding(percent)
        assert bands * n <= neardup.SKETCH and (1 - (percent / 100) ** n) ** bands <= 5e-7


def test_near_duplicates_of_the_pipeline_keep_one_row(spark, tmp_path):
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    rows = [(8, texts[0]), (8, texts[0]), (8, texts[1]), (None, texts[0]), (None, texts[2]), (None, texts[2]), (3, texts[1]), (None, ""), (None, ""), (5, None)]
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/docs")
    left = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()
    want = [(8, texts[0]), (3, texts[1]), (None, texts[2]), (None, ""), (None, ""), (5, None)]
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted((i or 0, t or "") for i, t in want)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 2000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: max(1, n // 2)], rng.integers(0, 1 << 63, n - max(1, n // 2)).astype(np.uint64)])
        s = neardup.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((s[0] == s[1]).mean() - true) < 0.2


def brute_lines(rows):
    """The chunk rule line by line, with texts instead of hashes."""
    from gramlake.llm.common import U64, mix, span_hashes

    def hashed(raw):
        return span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]

    seen, out = set(), {}
    for k, t in sorted(rows):
        lines = t.encode().split(b"\n")
        h, words = [hashed(x) for x in lines], [len(x.split()) for x in lines]
        start, drop = 0, set()
        for i in range(len(lines)):
            with np.errstate(over="ignore"):
                roll = mix(np.array([(h[i - 1] if i else U64(0)) * linededup._STEP + h[i]], dtype=np.uint64))[0]
            last = i + 1 == len(lines)
            if last or roll % U64(linededup.MEAN_LINES) == 0 or words[i] >= linededup.LONG_WORDS or words[i + 1] >= linededup.LONG_WORDS:
                found = [(start, i + 1)] if (i + 1 - start >= 2 or words[start] >= linededup.LONG_WORDS) and sum(words[start : i + 1]) else []
                edges = [(start, start + n) for n in range(2, i + 1 - start)] + [(i + 1 - n, i + 1) for n in range(2, i + 1 - start)]
                found += [(a, b) for a, b in edges if sum(words[a:b]) >= linededup.EDGE_WORDS]
                for a, b in sorted(found):
                    chunk = b"\n".join(lines[a:b])
                    if chunk in seen:
                        drop |= set(range(a, b))
                    seen.add(chunk)
                start = i + 1
        out[k] = (b"\n".join(x for i, x in enumerate(lines) if i not in drop).decode() if drop else t, len(drop))
    return out


def test_line_dedup(spark, empty):
    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.choice([1, 4, 12, 60]))) for _ in range(30)]
    rows = [(1, ""), (2, "\n\n"), (3, "one"), (4, "\n" + "\n".join(pool[:9])), (5, "\n".join(pool[:9]) + "\n")]
    for i in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 12))]
        at = rng.randrange(20)
        rows.append((100 + i, "\n".join(lines[:3] + pool[at : at + 8] + lines[3:])))
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(table(spark, rows), carry=("t", "k")).collect()}
    assert got == brute_lines(rows)
    assert sum(n for _, n in got.values()) > 50
    # a passage of short lines goes but for a line at either end
    passage = [" ".join(f"p{rng.randint(0, 10**6)}" for _ in range(9)) for _ in range(12)]
    fresh = lambda n: [" ".join(f"f{rng.randint(0, 10**6)}" for _ in range(9)) for _ in range(n)]
    twice = [(1, "\n".join(fresh(5) + passage + fresh(4))), (2, "\n".join(fresh(7) + passage + fresh(3)))]
    out = {r.doc_id: r for r in linededup.dedup_lines(table(spark, twice)).collect()}
    assert out[1].n_removed == 0 and 10 <= out[2].n_removed <= 12 and "f" in out[2].text
    odd = linededup.dedup_lines(table(spark, [(None, "a\nb\n" * 9), (None, "a\nb\n" * 9), (7, None), (8, "x" * 100_000)])).collect()
    assert sorted((r.n_removed, r.text is None) for r in odd) == [(0, False), (0, False), (0, False), (0, True)]
    assert linededup.dedup_lines(empty).count() == 0


def brute_passages(rows, words=linededup.LONG_WORDS):
    """Lines in a run of ``words`` words or more, from a line with a word to one, that occurs at an earlier place."""
    seen, gone = set(), {}
    for k, t in sorted(rows):
        lines, drop = t.split("\n"), set()
        size = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if size[a] and size[b - 1] and sum(size[a:b]) >= words:
                    run = "\n".join(lines[a:b])
                    if run in seen:
                        drop |= set(range(a, b))
                    seen.add(run)
        gone[k] = drop
    return gone


@pytest.mark.parametrize(("n", "size"), [(2, 30), (3, 20), (4, 15), (6, 10), (20, 4)])
def test_line_dedup_passages(spark, n, size):
    rng = random.Random(n)
    fresh = lambda n, size: [" ".join(f"f{rng.randint(0, 10**9)}" for _ in range(size)) for _ in range(n)]
    rows = []
    for i in range(25):  # one passage in two texts, at any place; a blank line inside some
        passage = fresh(n, size)
        passage[1:1] = [""] * (i % 3)
        rows += [(2 * i + x, "\n".join(fresh(rng.randint(0, 6), 9) + passage + fresh(rng.randint(0, 6), 9))) for x in (0, 1)]
    got = {r.doc_id: r for r in linededup.dedup_lines(table(spark, rows), passages=True).collect()}
    want = brute_passages(rows)
    for i, t in rows:  # fresh lines are never repeated, so nothing but the passages goes
        assert got[i].text == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[i])
        assert got[i].n_removed == len(want[i]) == (i % 2) * (n + i // 2 % 3)


def test_line_dedup_removes_all_that_brute_force_removes(spark):
    rng = random.Random(9)
    pool = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.choice([0, 1, 4, 12, 25, 60]))) for _ in range(25)]
    rows = []
    for i in range(40):
        at = rng.randrange(20)
        rows.append((i, "\n".join([rng.choice(pool) + f" {rng.randint(0, 9)}" for _ in range(4)] + pool[at : at + rng.randint(2, 8)] + [rng.choice(pool)] * rng.randint(0, 9))))
    got = {r.doc_id: r for r in linededup.dedup_lines(table(spark, rows), passages=True).collect()}
    want, stays = brute_passages(rows), set()
    for i, t in rows:
        left = got[i].text.split("\n")
        stays |= set(left)
        most = [x for j, x in enumerate(t.split("\n")) if j not in want[i]]
        rest = iter(most)
        assert all(x in rest for x in left if x) and got[i].n_removed >= len(want[i])
    assert sum(map(len, want.values())) > 50
    assert {x for _, t in rows for x in t.split("\n") if x} <= stays  # every line stays somewhere


@pytest.mark.parametrize("passages", [False, True])
def test_line_dedup_of_equal_lines_moves_no_more_than_the_text(spark, passages):
    line = " ".join(["same"] * 10)
    texts = {1: [line] * 20_000, 2: ["own"] + [line] * 20_000, 3: [f"{line} {i % 3}" for i in range(20_000)], 4: ["a"] + [""] * 20_000 + ["b " * 60]}
    for lines in texts.values():
        data = np.frombuffer("\n".join(lines).encode(), np.uint8)
        a, b, _, _, _, _ = linededup.chunks(data, np.array([0, len(data)]), passages)
        assert len(a) <= 4 * len(lines)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(table(spark, [(i, "\n".join(x)) for i, x in texts.items()]), passages=passages).collect()}
    assert all(set(got[i].split("\n")) <= set(texts[i]) for i in texts)
    assert {x for t in got.values() for x in t.split("\n")} == {x for lines in texts.values() for x in lines}
    if passages:
        assert got[1] == line and got[2] == "own" and len(got[3].split("\n")) == 3
    # what is compared follows the text: places of each run and its first place
    n = 20_000
    named = [(a, m, a % 3) for a in range(1, n) for m in (5, n - a)]
    lists = pa.array([[{"c": a * linededup.NAME + m, "fk": 1, "fc": f * linededup.NAME + m} for a, m, f in named]])
    runs = next(linededup._runs([pa.RecordBatch.from_arrays([pa.array([1]), lists], ["k", "cs"])]))
    assert (runs["c"].to_numpy() % linededup.NAME).sum() <= 8 * n


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            c = int(c) * (1 + i % 2)
            total += c - 9 if c > 9 else c
        return total % 10 == 0

    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii_base(spark, empty):
    rng = random.Random(6)
    parts = ["a", "Z", "0", " ", "1", "23", ".", ".", "@", "-", "+", "(", ")", "_", "%", "é", "\U0001f600", "\n", "4539578763621486", "4539 5787-6362 1486", "1.2.3.4", "255.256.1.1", "x@y.z", "+1 (555) 123-4567"]
    rows = ODD + [(100 + i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(400)] + [(9, "1 " * 20_000), (10, "a@" * 20_000), (11, "1." * 20_000), (12, "x9" * 40_000)]
    texts = dict(rows)
    for r in pii.find_pii(table(spark, rows)).collect():
        assert [(x.s, x.r, x.e, x.kind) for x in r.base] == brute_pii(texts[r.doc_id])
        assert all(texts[r.doc_id][x.s : x.e] == x.m for x in [*r.base, *r.added])
    assert pii.find_pii(empty).count() == 0


def test_pii_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"filler words here token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" more") for i in range(6)]
    rows += [(50, 'the token = "ZX-99817-QQ" end'), (51, "chapter number 123456 of the book"), (52, "GNU License, version 300100 is clean")]
    got = {r.doc_id: [x.m for x in r.added] for r in pii.find_pii(table(spark, rows)).collect()}
    assert got[50] == ["ZX-99817-QQ"] and not got[51] and not got[52]
    assert all(len(got[i]) == 1 for i in range(6))


def test_pii_contexts_of_any_length(spark):
    """Long tokens, long words before them, and words after them alone."""
    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    word = "w" * 300
    rows = [(i, f"{word} key: {digest(i)} and more") for i in range(5)] + [(20, f"{word} key: {'A1-' * 200}7 x")]
    rows += [(30 + i, f"x{i} {digest(30 + i)} expires tomorrow") for i in range(9)] + [(60, "something else entirely QQ-5512-77 expires tomorrow")]
    got = {r.doc_id: [x.m for x in r.added] for r in pii.find_pii(table(spark, rows)).collect()}
    assert got[20] == ["A1-" * 200 + "7"] and got[60] == ["QQ-5512-77"]


def brute_scores(edges):
    """Patterns' and instances' scores until nothing changes, from sets."""
    patterns, seeds = {}, {}
    for p, v, seed in edges:
        patterns.setdefault(p, set()).add(v)
        seeds[v] = max(seeds.get(v, 0), seed)
    score, before = dict.fromkeys(patterns, 0.0), None
    others = lambda v, p: 1.0 if seeds[v] else 1 - np.prod([1 - 0.999 * score[q] for q in patterns if q != p and v in patterns[q]])
    for _ in range(pii.MOST_ROUNDS):
        new = {}
        for p, vs in patterns.items():
            own = [others(v, p) for v in vs]
            new[p] = np.mean(own) if sum(x >= pii.INSTANCE_SCORE for x in own) >= pii.SUPPORT else 0.0
        before, score = score, new
        if before != dict.fromkeys(patterns, 0.0) and max(abs(score[p] - before[p]) for p in patterns) <= pii.SETTLED:
            break
    return {(p, v): (score[p], others(v, None)) for p, vs in patterns.items() for v in vs}


def test_pii_scores_equal_brute_force(spark):
    rng = random.Random(13)
    seeds = {f"v{i}": int(rng.random() < 0.4) for i in range(60)}
    edges = sorted({(f"p{rng.randint(0, 14)}", f"v{rng.randint(0, 59)}") for _ in range(260)})
    edges += [("own", f"u{i}") for i in range(9)] + [("chain", f"v{i}") for i in range(4)]  # a pattern without any seed stays 0
    edges = [(p, v, seeds.get(v, 0)) for p, v in sorted(set(edges))]
    got = {(r.p, r.v): (r.ps, r.vs) for r in pii._score(spark.createDataFrame(edges + edges[:40], "p string, v string, seed int")).collect()}
    want = brute_scores(edges)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert got["own", "u0"] == (0.0, 0.0)


SPACE = " \t\n\x0b\f\r"
NUMBER_MARKS = "0123456789()./-"


def brute_candidates(text):
    """Start, core and patterns of what may be an identifier, by walking over the white-space tokens of a text."""
    tokens_of = [(m.start(), m[0]) for m in re.finditer(rf"[^{SPACE}]+", text)]
    bare = lambda t: t.rstrip("".join(c for c in set(t) if not c.isalnum()))

    def first_of_number(t):
        t = bare(t).lstrip("".join(c for c in set(t) if not c.isalnum()))
        letters = len(t) - len(t.lstrip("".join(c for c in set(t) if c.isalpha())))
        return letters <= 4 and t[letters : letters + 1].isdigit() and all(c in NUMBER_MARKS + "+" for c in t[letters:])

    def goes_on(t):
        return t[0] in "0123456789(" and bool(bare(t)) and all(c in NUMBER_MARKS for c in bare(t))

    groups, i = [], 0
    while i < len(tokens_of):
        at, t = tokens_of[i]
        end = i + 1
        if any(c.isdigit() for c in t) and first_of_number(t):
            closed = lambda u: all(c in NUMBER_MARKS + "+" for c in u[len(bare(u)) :])
            while end < len(tokens_of) and end - i < 8 and closed(tokens_of[end - 1][1]) and text[tokens_of[end][0] - 1 : tokens_of[end][0]] == " " and tokens_of[end][0] == tokens_of[end - 1][0] + len(tokens_of[end - 1][1]) + 1 and goes_on(tokens_of[end][1]):
                end += 1
        elif not (any(c.isdigit() for c in t) or "@" in t[1:-1]):
            end = None
        if end is None:
            i += 1
            continue
        groups.append((i, end))
        i = end
    out = []
    for n, (i, end) in enumerate(groups):
        since, until = (groups[n - 1][1] if n else 0), (groups[n + 1][0] if n + 1 < len(groups) else len(tokens_of))
        at = tokens_of[i][0]
        m = text[at : tokens_of[end - 1][0] + len(tokens_of[end - 1][1])]
        k = next((j for j, c in enumerate(m) if c.isalnum()), len(m))
        k -= k > 0 and m[k - 1 : k] == "+"
        core = bare(m[k:])
        left = " ".join([*[x.lower() for _, x in tokens_of[max(since, i - 2) : i]]] + [m[:k]])
        right = " ".join([m[k + len(core) :]] + [x.lower() for _, x in tokens_of[end : min(until, end + 2)]])
        if len(core) >= 6:
            out.append((at + k, core, [p for p in ("<" + left.rstrip(" ") + (" " if left.endswith(" ") else ""), ">" + right) if p[1:].strip()]))
    return out


def brute_added(texts):
    """What contexts add to each text, from lists of all edges."""
    found = {}
    for i, text in texts.items():
        base = brute_pii(text)
        covered = lambda s, v: any(b[0] < s + len(v) and b[2] > s for b in base)  # noqa: E731, B023
        found[i] = [(s, v, ps, covered(s, v)) for s, v, ps in brute_candidates(text) if covered(s, v) or sum(c.isdigit() for c in v) >= 3]
    edges = {}
    for rows in found.values():
        for _, v, ps, covered in rows:
            for p in ps:
                edges[p, v] = max(edges.get((p, v), 0), int(covered or re.match(pii.SEED_SHAPE, v) is not None))
    scores = brute_scores([(p, v, seed) for (p, v), seed in edges.items()])
    high = {k for k, (ps, vs) in scores.items() if ps >= pii.PATTERN_SCORE and vs >= pii.INSTANCE_SCORE}
    return {i: sorted((s, v) for s, v, ps, covered in rows if not covered and any((p, v) in high for p in ps)) for i, rows in found.items()}


def planted(rng, n):
    """Sentences with identifiers: those of base patterns, and ones of the same kinds that no base pattern knows; and where the latter stand."""
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    name = lambda: rng.choice(["anna", "omar", "li", "zoe"]) + d(3)

    def luhn(digits):
        total = sum(c * 2 - 9 if c > 4 else c * 2 for c in digits[::-2]) + sum(digits[-2::-2])
        return [*digits, -total % 10]

    def card():
        x = "".join(map(str, luhn([4, *map(int, d(14))])))
        return " ".join(x[k : k + 4] for k in (0, 4, 8, 12))

    kinds = {
        "phone": (["please call {} after nine", "my number is {}, thanks", "fax to ({}) today"], lambda: f"+49 170 {d(7)}", lambda: rng.choice([f"0170/{d(7)}", f"0170 {d(7)}", f"(0170) {d(7)}"])),
        "card": (["paid with card {} last week", "billed to {} by mistake"], card, lambda: f"{d(5)} {d(5)} {d(4)}"[:11]),
        "email": (["write to {} for details", "mail from <{}> arrived"], lambda: f"{name()}@example.org", lambda: f"{name()}(at)example.org"),
        "key": (['token = "{}" in the file', "the key is {} and works"], lambda: hashlib.md5(d(9).encode()).hexdigest(), lambda: f"AK-{d(5)}-{rng.choice('XYZ')}{d(2)}"),
    }
    texts, want = {}, {}
    for i in range(n):
        kind = list(kinds)[i % len(kinds)]
        sentences, seed, unseen = kinds[kind]
        hidden = rng.random() < 0.3
        text = "Some words. " + rng.choice(sentences).format(value := unseen() if hidden else seed()) + " More words."
        texts[i] = text
        if hidden:
            s = text.index(value)
            want[i] = (kind, s + (value[0] == "("), s + len(value))
    return texts, want


def test_pii_added_spans_equal_brute_force_and_recall(spark):
    texts, want = planted(random.Random(21), 400)
    texts |= {900: "on 12 May 2024 0170 1234567 rang", 901: "rows 1 22 333 4444 55555 666666 7 88 999 1010 and", 902: "DE89 3704 0044 0532 0130 00 is the account", 903: "flat12b 0170 555 12x (03) 5550, 123456 . @ a@b 12@ anna.b@example.org;", 904: "@@@ +++ ((("}
    got = {r.doc_id: sorted((x.s, x.m) for x in r.added) for r in pii.find_pii(table(spark, list(texts.items()))).collect()}
    assert got == brute_added(texts)
    hits, of = {}, {}
    for i, (kind, s, e) in want.items():
        of[kind] = of.get(kind, 0) + 1
        hits[kind] = hits.get(kind, 0) + any(a < e and a + len(m) > s for a, m in got[i])
    print({k: (hits[k], of[k]) for k in of})
    assert all(hits[k] >= 0.9 * of[k] for k in of)
    assert not any(got[i] for i in (901, 904))


def test_pii_of_many_matches_is_not_quadratic(spark):
    text = "a@b.cc 1.2.3.4 " * 40_000
    found = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(found.base) == 80_000 and found.base[-1].e == len(text) - 1


def test_language(spark, empty):
    words = {"en": "the and of with this that there house", "de": "der und nicht schön über haus straße ist", "ru": "это не только потому что было дом", "el": "και δεν είναι στο σπίτι με την"}
    rng = random.Random(7)
    say = lambda lang, n: " ".join(rng.choices(words[lang].split(), k=n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(list(words) * 10)] + [(900, None, "en"), (901, "text", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(train)
    assert model.languages == sorted(words)
    tests = [(1, say("de", 12), "de"), (2, say("ru", 3), "ru"), (3, "дом", "ru"), (4, say("en", 40) + " " + say("el", 9), "en"), (5, None, "und"), (6, "123 !? 。", "und"), (7, "", "und"), (7, "", "und")]
    got = language.identify(table(spark, [x[:2] for x in tests]), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == sorted((i, lang) for i, _, lang in tests)
    assert all(0 <= r.score <= 1 for r in got)
    mixed = next(r for r in got if r.doc_id == 4)
    assert 0.5 < mixed.score < 0.95
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(table(spark, ODD), language.train(train.limit(0))).collect()} == {"und"}


def test_long_texts_in_pieces():
    """A text labelled piece by piece has the shares of the same text labelled whole; memory is a piece's."""
    import tracemalloc

    rng = np.random.default_rng(12)
    for k in (1, 2, 5):
        model = language.Model([f"l{i}" for i in range(k)], rng.normal(-8, 1.5, (k, len(language.SIZES), language.BUCKETS)).astype(np.float32), np.ones((k, len(language.SCRIPTS))))
        for text in ["", "1 2", " ".join("".join(rng.choice(list("abcdé日я"), rng.integers(1, 7))) for _ in range(700)), "x" * 3000 + " yz " * 50]:
            data = np.frombuffer(text.encode(), np.uint8)
            words = language.Words(data, np.array([0, len(data)]))
            label = model.labels(model.scores(words), words.first)
            want = np.bincount(label, words.lengths, k + 1)
            for piece in (1, 50, 10**6):
                letters, share = model.shares(data, piece)
                assert letters == any(c.isalpha() for c in text) and share.tolist() == want.tolist()
    many = language.Model([f"l{i}" for i in range(200)], rng.normal(-8, 1, (200, len(language.SIZES), language.BUCKETS)).astype(np.float32), np.ones((200, len(language.SCRIPTS))))
    data = np.frombuffer(b"some words of a text that goes on and on " * 30_000, np.uint8)  # 270,000 words: 430 MB of scores if whole
    tracemalloc.start()
    _, share = many.shares(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert share.sum() == sum(map(len, b"some words of a text that goes on and on".split())) * 30_000 and peak < 250_000_000


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], np.zeros((3, 3, language.BUCKETS), np.float32), np.ones((3, len(language.SCRIPTS))))
    import itertools

    steady = 0
    for scale in (1, 2, 5, 9):
        for _ in range(30):
            first = np.concatenate([[0], np.cumsum(rng.integers(0, 7, 5))])
            scores = rng.normal(0, scale, (first[-1], 3)) + rng.normal(0, scale, 3)
            got = model.labels(scores, first)
            steady += (model.steady(scores, first) >= 0).sum()
            assert (got == model._steps(scores, first, np.int8)).all()
            for a, b in itertools.pairwise(first.tolist()):
                if b > a:
                    best = max(itertools.product(range(3), repeat=b - a), key=lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - language.SWITCH * sum(x != y for x, y in zip(p, p[1:], strict=False)))
                    assert list(got[a:b]) == list(best)
    assert 100 < steady < 500
    one = language.Model(["a"], np.zeros((1, 3, language.BUCKETS), np.float32), np.ones((1, len(language.SCRIPTS))))
    assert list(one.labels(rng.normal(0, 5, (7, 1)), np.array([0, 4, 4, 7]))) == [0] * 7


def test_language_scores_equal_brute_force(spark):
    """Counts and scores of words by plain dictionaries: n-grams of the bytes of a word between blanks, each size a third."""
    rows = [("Straße über den Fluß der", "de"), ("the house over the river", "en"), ("το σπίτι και το ποτάμι", "el"), ("das Haus und der Fluß", "de")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    def gram_list(word, size):
        raw = b" " + word.encode() + b" " * 4
        return [raw[i : i + size] for i in range(len(word.encode()))]

    counts = {}
    for text, lang in rows:
        for word in text.translate({i: i + 32 for i in range(65, 91)}).split():
            for size in language.SIZES:
                for g in gram_list(word, size):
                    counts.setdefault((lang, size), {}).setdefault(g, 0)
                    counts[lang, size][g] += 1
    data = np.frombuffer("der fluß house der das".encode(), np.uint8)
    words = language.Words(data, np.array([0, len(data)]))
    got = model.scores(words)
    for i, lang in enumerate(model.languages):
        for j, word in enumerate("der fluß house der das".split()):
            want = 0.0
            for size in language.SIZES:
                own = counts[lang, size]
                total = sum(own.values()) + language.SMOOTH * language.BUCKETS
                want += sum(np.log((own.get(g, 0) + language.SMOOTH) / total) for g in gram_list(word, size)) / 3
            assert got[j, i] == pytest.approx(want - (1000 if lang == "el" else 0), rel=1e-4)


def test_language_of_200_values(spark):
    names = [f"l{i:03}" for i in range(200)]
    words = {x: [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "abcdefgh"] for i, x in enumerate(names)}
    train = spark.createDataFrame([(x, " ".join(w * 5)) for x, w in words.items()], "lang string, text string")
    model = language.train(train)
    assert model.languages == names
    got = language.identify(table(spark, [(i, " ".join(words[x])) for i, x in enumerate(names)]), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == dict(enumerate(names))


def test_quality(spark, empty):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choices("a clear sentence about rivers and stones in the valley".split(), k=40))
    bad = lambda: " ".join(w + "$$$" for w in rng.choices("buy now cheap deal click".split(), k=40))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(None, 1, 0), (5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(table(spark, rows), labels)
    got = quality.score(table(spark, rows + ODD), model).collect()
    assert len(got) == len(rows) + len(ODD)
    held = [r for r in got if r.doc_id is not None and 120 <= r.doc_id < 200]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_quality_features_equal_brute_force():
    texts = ["a b b  c\nétat", "", "x", "日本語 日本語", "ab"]
    raw = [t.encode() for t in texts]
    code, row = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for i, t in enumerate(texts):
        words = t.split()
        want = [words, list(zip(words, words[1:], strict=False)), *([t[j : j + n] for j in range(len(t) - n + 1)] for n in quality.SIZES)]
        own = code[row == i]
        for kind, items in enumerate(want):
            buckets = own[own // quality.BUCKETS == kind]
            assert len(buckets) == len(items) and len(set(buckets.tolist())) == len(set(items))  # equal ones meet, and nothing else
        assert (own == quality.DOUBLED).sum() == sum(a == b for a, b in want[1])


def test_quality_sample_is_bounded(spark):
    rows = [(i, ("good stone river " if i % 2 else "buy$ now$ cheap$ ") * 30) for i in range(600)] + [(9999, "x " * 200_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(9999, 1)], "doc_id long, quality int")
    sizes = []
    fit = quality.fit
    try:
        quality.fit = lambda texts, y: sizes.append((len(texts), sum(map(len, texts)))) or fit(texts, y)
        models = [quality.train(table(spark, rows), labels, rows=100), quality.train(table(spark, rows), labels, size=20_000), quality.train(table(spark, rows), labels, size=20_000)]
    finally:
        quality.fit = fit
    assert sizes[0][0] == 100 and 15_000 < sizes[1][1] <= 20_000 and sizes[1] == sizes[2]
    assert (models[1].value == models[2].value).all()
    for model in models:
        got = quality.score(table(spark, rows[:-1]), model).collect()
        assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95


def test_quality_sample_is_bounded_where_ids_repeat(spark):
    """One id with very many texts: no more different rows than asked for reach the driver."""
    rows = spark.range(60_000).selectExpr("id % 2 as doc_id", "concat('text number ', id % 30000, if(id % 2 = 0, ' fine words', ' $$$ junk')) as text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (0, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda texts, y: seen.append((len(texts), len(set(texts)))) or fit(texts, y)
        model = quality.train(rows, labels, rows=100)
        again = quality.train(rows.repartition(7), labels, rows=100)
    finally:
        quality.fit = fit
    assert seen and all(n <= 100 and n == different for n, different in seen)
    assert (model.value == again.value).all()


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body class="has-sidebar">
<nav><ul><li><a href=/>Home</a></ul></nav><div id="cookie-notice">We use cookies, a lot of cookies on this site.</div>
<main><h1>Head &amp; line</h1><p>First   paragraph with <b>bold</b> text,\n enough of it to count.<p>Second&nbsp;one follows <a href="x">a link</a> and goes on for a while.
<div class="advert">Buy things now, buy more things, they are cheap today.</div><p>Third one is here as well, with its own words.</p></main>
<aside>Side</aside><section class="comments"><p>I think this is a long reader comment, longer than you would like it to be.</p></section><footer>&copy; all</footer></body></html>"""


ARTICLE = ["A heading of it", *(f"Paragraph {i} of the article says something at some length, as paragraphs do, and then it says a little more of it." for i in range(5))]
BODY = "<h1>" + ARTICLE[0] + "</h1>" + "".join(f"<p>{x}</p>" for x in ARTICLE[1:])
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Another story {i}</a></li>" for i in range(30)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div>{LINKS}</div><div>{BODY}</div><div>All rights reserved by us.</div></body>",
        f'<body><div class="layout with-sidebar"><div>{BODY}</div><div>{LINKS}</div></div></body>',
        f'<body><section class="market share">{BODY}</section><div>{LINKS}</div></body>',
        f"<body><div><div>{LINKS}</div>{BODY}</div></body>",  # an unlabelled box of links inside the article's element
        f"<body><div><div>{BODY}</div><div>" + "".join(f"<div><span><a href=/u{i}>user{i}</a></span> <i>{i} hours ago</i><p>I like it {i}.</p><a href=#>reply</a> <a href=#>report</a></div>" for i in range(6)) + "</div></div></body>",  # unlabelled comments
        f"<body><form action=/x><div>{LINKS}</div><div>{BODY}</div><input value=no><button>Go</button></form></body>",
        f"<body><main><div>{BODY}</div></main><article>Teaser</article><article>Other teaser</article><footer>{LINKS}</footer></body>",
        f'<body><div>{BODY}<div class="ad">Buy this.</div><aside>Read that.</aside></div></body>',
        f"<body><div hidden>{BODY}{BODY}</div><script>{BODY}</script><div style='display: none'>{BODY}{BODY}</div><div>{BODY}</div></body>",
    ],
)
def test_main_text_goes_by_density(page):
    assert webtext.extract_text(page).split("\n") == ARTICLE


def test_main_text_of_two_parts_beside_each_other():
    page = f"<body><div>{LINKS}</div><div><div>{BODY}</div><div>An advert.</div><div>{BODY}</div></div></body>"
    assert webtext.extract_text(page).split("\n") == ARTICLE * 2


def brute_density(tree, whole, share):
    """Density and sum of densities of (tag, children) with text leaves, from their definition; rows in page order."""
    tag, children = tree
    rows = []

    def measure(node, linked):
        """Characters, linked characters, tags, linked tags below a node."""
        if isinstance(node, str):
            return (len(node), len(node) * linked, 0, 0)
        linked = linked or node[0] == "a"
        parts = [measure(x, linked) for x in node[1]]
        tags = sum(1 for x in node[1] if not isinstance(x, str) and x[0] not in ("b", "span"))
        links = sum(1 for x in node[1] if not isinstance(x, str) and x[0] == "a")
        return tuple(sum(p[i] for p in parts) + (0, 0, tags, links)[i] for i in range(4))

    def density(node, linked):
        c, lc, t, lt = measure(node, linked)
        if not c:
            return 0.0
        if linked or node[0] == "a":
            lc = c
        return c / (t + 1) * max(0.0, np.log(c / max(lc, 1) * (t + 1) / max(lt, 1))) / np.log(1 + np.log(c / max(1, c - lc) * lc + share(c) + np.e))

    def walk(node, linked):
        linked = linked or node[0] == "a"
        inner = [x for x in node[1] if not isinstance(x, str)]
        own = density(node, linked)
        total = sum(density(x, linked) for x in inner) if any(x[0] in webtext.BLOCK for x in inner) else own / 2
        rows.append((node[0], own, total))
        for x in inner:
            walk(x, linked)

    linked_whole = measure(tree, False)[1]
    share = lambda c, s=linked_whole / max(1, measure(tree, False)[0]): s * c
    walk(tree, False)
    return rows


def test_densities_equal_brute_force():
    rng = random.Random(12)

    def grow(depth):
        tag = rng.choice(["div", "div", "section", "ul", "b", "a", "span"]) if depth else "body"
        children = []
        for _ in range(rng.randint(0, 4)):
            children.append("x" * rng.randint(1, 90) if rng.random() < 0.5 or depth > 4 else grow(depth + 1))
        return (tag, [x for i, x in enumerate(children) if not (i and isinstance(x, str) and isinstance(children[i - 1], str))])

    def text(node):
        return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(text, node[1])) + f"</{node[0]}>"

    for _ in range(200):
        tree = grow(0)
        root = webtext.parse(text(tree))
        webtext.weigh(root)
        got, todo = [], [next(x for x in root.children if type(x) is webtext.Node)]
        while todo:
            node = todo.pop()
            got.append((node.tag, node.density, node.total))
            todo += reversed([x for x in node.children if type(x) is webtext.Node])
        want = brute_density(tree, None, None)
        assert [x[0] for x in got] == [x[0] for x in want]
        assert np.allclose([x[1:] for x in got], [x[1:] for x in want])


def test_main_text_of_given_pages(sf):
    """Element and class names away, all but a few pages keep their text, and those that don't lose nothing of it."""
    import pyarrow.parquet as pq

    same = n = 0
    for page in pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist():
        if not page:
            continue
        article = re.search("<article>(.*)</article>", page, re.S)[1]
        want = webtext.extract_text(f"<body><article>{article}</article></body>")
        assert webtext.extract_text(page) == want
        bare = webtext.extract_text(re.sub(r"<(/?)(article|nav|header|footer|aside)\b", r"<\1div", re.sub(' class="[^"]*"', "", page)))
        same, n = same + (bare == want), n + 1
        assert want in bare
    assert same >= 0.9 * n


def _words(i, n=60):
    return "<p>" + " ".join(f"word{i}x{j}" for j in range(n)) + ".</p>"


_STORY = "<h1>Title here</h1>" + "".join(_words(i) for i in range(3))
_TALK = "".join(f"<div class=comment><p>{' '.join(f'reply{i}y{j}' for j in range(50))}</p></div>" for i in range(30))
_MENU = "<nav><ul><li><a href=/>Home</a></ul></nav>"


@pytest.mark.parametrize("outer", ["div class=post", "article", "div class='post comments-open'"])
@pytest.mark.parametrize("inside", [True, False])
def test_comments_never_win(outer, inside):
    talk, end = f"<div class='comments-area'>{_TALK}</div>", f"</{outer.split()[0]}>"
    page = f"<body>{_MENU}<{outer}>{_STORY}{talk + end if inside else end + talk}</body>"
    got = webtext.extract_text(page)
    assert "word0x1" in got and "word2x59" in got and "reply" not in got


def test_forms_around_pages_are_wrappers():
    side = "<div id=side>" + "".join(f"<p><a href=/{i}>link number {i} of the list</a> and some words</p>" for i in range(20)) + "</div>"
    page = f"<body><form action=/x><input type=hidden name=v><div class=content>{_STORY}</div></form>{side}</body>"
    assert "word0x1" in webtext.extract_text(page) and "link number" not in webtext.extract_text(page)
    signup = "<form><label>Name</label><input><p>Leave your name to get our letters every week.</p><button>Send</button></form>"
    assert "letters" not in webtext.extract_text(f"<body><article>{_STORY}{signup}</article></body>")
    assert webtext.extract_text(f"<body><div class=comments>{_STORY}</div></body>").startswith("Title here")  # a hint on all that there is


def test_a_list_is_an_article():
    items = "".join(f"<li>item {i} of the list here" for i in range(30))
    advert = "<div><p>" + " ".join(f"buy{j}" for j in range(200)) + "</p></div>"
    got = webtext.extract_text(f"<body><article><h1>The list</h1><ul>{items}</ul></article>{advert}</body>")
    assert got.count("\n") == 30 and "buy" not in got


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "text", "<b>" * 100_000 + "</i>" * 100_000 + "text", "<p>a" * 100_000, "<table><tr><td>" * 60_000 + "x", "<ul>" * 50_000 + "<li>x" * 50_000, "<a " * 100_000, "<!-- " * 100_000])
def test_time_grows_with_the_page(page):
    began = time.process_time()
    webtext.extract_text(page)
    assert time.process_time() - began < 15  # the quadratic way took over half an hour


def _choice(tree, linked=False):
    """Nodes with their sums by definition, for the choice below: (sum, node) of all."""
    out = []

    def visit(node):
        out.append(node)
        for x in node.seen():
            visit(x)

    visit(tree)
    return out


def test_choice_of_nodes_equals_brute_force():
    """Of all subtrees that don't lie apart, the one of the largest sum, a named one counting NAMED times."""
    rng = random.Random(11)

    def make(depth):
        tag = rng.choice(["div", "div", "p", "section", "ul", "li", "article", "nav", "span", "a", "div class=comments", "div class=ad-slot", "footer"])
        inner = [" ".join(["w"] * rng.randint(0, 30)) if depth > 3 or rng.random() < 0.4 else make(depth + 1) for _ in range(rng.randint(1, 4))]
        return f"<{tag}>{''.join(inner)}</{tag.split()[0]}>"

    for _ in range(200):
        root = webtext.parse(f"<body>{make(0)}{make(0)}</body>")
        found, _, _ = webtext.main_nodes(root)
        nodes = _choice(root)
        apart = lambda x: any(y.aside or y.hinted for y in webtext._ways_up(x))
        mains = [x for x in nodes if x.main and not apart(x) and x.chars and not any(y.main for y in webtext._ways_up(x.parent))]
        free = [x for x in nodes if not apart(x) and x.total > 0]
        if not found:
            assert not free
            continue
        value = lambda x: x.total * (webtext.NAMED if len(mains) == 1 and any(y is mains[0] for y in webtext._ways_up(x)) else 1.0)
        best = max(map(value, free))
        assert any(abs(value(x) - best) < 1e-9 for x in found) and not any(apart(x) for x in found)


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "plain text &lt;here&gt;"), (5, "u", "<p>unclosed <i>tag"), (5, "u", "<p>unclosed <i>tag"), (6, "u", "<html><body><nav>only menu</nav></body></html>"), (7, None, "<div>" * 3000 + "deep" + "</div>" * 10), (8, "u", "<!-- open comment <p>x</p>"), (9, "u", "<p>a</p><p>b &amp"), (10, "u", "<article><h2>x</h2><form><p>sign up</p></form><p>kept</p></article>")]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = webtext.extract_main_text(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == "Head & line\nFirst paragraph with bold text, enough of it to count.\nSecond one follows a link and goes on for a while.\nThird one is here as well, with its own words."
    assert (texts[2], texts[3], texts[4], texts[5], texts[6], texts[7], texts[8], texts[9]) == ("", "", "plain text <here>", "unclosed tag", "", "deep", "", "a\nb &")
    assert texts[10] == "x\nkept"
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert webtext.extract_main_text(pages.limit(0)).count() == 0
