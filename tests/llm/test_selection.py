"""Quality rules, resampling and conversation repair against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gramlake.llm import conversations, resampling, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "é" * 3000 + " " + "x" * 200_000 + "\n" + "w " * 100_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id here at all"), (5, LONG), (6, "a b\r\nc\x00d # & <tag>\n\na b\r\na b\r\n")]


def documents(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, source, "x", 7, "z") for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, t string, n long, c0 string")


def measures(text):
    """The statistics as their definition says them."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(lines)


def test_statistics(spark):
    rng = random.Random(1)
    rows = ODD + [(100 + i, "".join(rng.choices(["a", "b", "é", " ", " ", "\n", "#", "|", "\x0b", "\U0001f600"], k=rng.randint(0, 120)))) for i in range(400)]
    got = rules.text_statistics(documents(spark, [(i, t, "l", "s") for i, t in rows])).collect()
    want = Counter((i, *measures(t)) for i, t in rows)
    assert Counter((r.doc_id, *[r[s] for s in rules.STATISTICS]) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)


def plain(n, rng, mark=""):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) + mark for _ in range(n))


def test_thresholds_follow_groups(spark):
    """What is usual in one source is unusual in another; small sources take their language's thresholds; null is a group."""
    rng = random.Random(2)
    rows = [(i, plain(60, rng), "en", "prose") for i in range(150)] + [(1000 + i, plain(60, rng, "#"), "en", "code") for i in range(150)]
    rows += [(2000, plain(60, rng, "#"), "en", "prose"), (2001, plain(60, rng), "en", "few"), (2002, plain(60, rng, "#"), "xx", None), (2003, None, None, None), (2004, plain(10, rng), "en", "prose")]
    rows += [(2005, "\n".join(["one same line of words here"] * 4 + [plain(80, rng)] * 1), "en", "prose")]
    docs = documents(spark, rows)
    for most in ((10**6, 10**6), (0, 0)):  # broadcast, and salted
        got = {r.doc_id: r for r in rules.filter_quality(docs, most=most).collect()}
        assert len(got) == len(rows)
        assert all(got[i].kept for i in range(150)) and all(got[1000 + i].kept for i in range(150))
        assert got[2000].failed == ["symbols"] and got[2001].kept and not got[2003].kept and got[2003].failed == []
        assert got[2004].base_failed and not got[2004].kept and got[2005].failed == ["dup_lines"]
    assert rules.filter_quality(documents(spark, [])).count() == 0


def test_sketches_merge_and_hold_their_error(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(1, 2, 4000), np.zeros(500)])
    rows = spark.createDataFrame([(i % 7, float(v)) for i, v in enumerate(values)], "g long, v double")
    rows = rows.selectExpr("g", "1 as n_words", "v as word_chars", "0 as n_symbols", "0 as n_dup_lines", "0 as n_repeat_words", "1 as n_lines")
    whole = rules.sketches(rows, [])
    merged = rules.merge(rules.sketches(rows, ["g"]), [])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    r = rules.quartiles(whole, []).where("rule = 'word_length'").first()
    exact = np.sort(values)
    for share, got in ((0.25, r.low), (0.75, r.high)):
        want = exact[math.floor(share * (len(values) - 1))]
        assert r.n == len(values) and abs(got - want) <= 0.0101 * want


def test_bucket_hashes():
    rng = random.Random(4)
    parts = ["".join(rng.choices("abcé0", k=rng.choice([1, 2, 5, 47, 48, 49, 300]))).encode() for _ in range(500)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    assert resampling.crc_spans(data, ends - np.array([len(p) for p in parts]), ends).tolist() == [zlib.crc32(p) for p in parts]
    assert len(resampling.crc_spans(data[:0], ends[:0], ends[:0])) == 0


def brute_resample(rows, target):
    split = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]
    bucket = lambda w: zlib.crc32(w) % 10000
    s, t = Counter(bucket(w) for _, x in rows for w in split(x)), Counter(bucket(w) for x in target for w in split(x))
    n, m = s.total(), t.total()
    out = []
    for i, x in rows:
        words = split(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in map(bucket, words))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = Counter()
    ranks = Counter((*r, j + 1) for j, r in enumerate(may[: len(may) * 10 // 100]))
    for r in ranks:
        drawn[r[:4]] += 1
    return ranks + Counter((*r, None) for r, c in (Counter(out) - drawn).items() for _ in range(c))


def test_resample(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices(["Alpha", "beta", "gamma1", "ÉTÉ", "x-y", "delta"], [5, 3, 2, 1, 1, 1], k=rng.randint(0, 60)))
    rows = ODD + [(100 + i, text()) for i in range(300)] + [(7, "one text of many copies " * 8)] * 150 + [(None, text())] * 3
    target = ["alpha alpha beta", None, "", "été x y"]
    docs = documents(spark, [(i, t, "l", "s") for i, t in rows]).repartition(7)
    items = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    got = resampling.resample(docs, items).collect()
    assert Counter(tuple(r) for r in got) == brute_resample(rows, target)
    assert resampling.resample(docs.limit(0), items).count() == 0
    assert Counter(tuple(r) for r in resampling.resample(docs, items.limit(0)).collect()) == brute_resample(rows, [])


def test_quickselect(spark):
    rng = random.Random(6)
    values = [(rng.randint(-3, 3), rng.randint(0, 5), rng.randint(-(2**60), 2**60)) for _ in range(1500)] + [(0, 0, 0)] * 600
    rows = spark.createDataFrame(values, "a long, b long, c long").repartition(5)
    for keys in (["a", "b", "c"], ["b", "a"], ["b"]):
        order = sorted(tuple(v["abc".index(k)] for k in keys) for v in values)
        for k in (1, 2, 700, 1050, 2100):
            assert resampling.kth(rows, keys, k, 2100, pivots=3) == order[k - 1]
    assert resampling.kth(rows, ["a"], 2101, 2100) is None and resampling.kth(rows, ["a"], 0, 2100) is None
    assert resampling.kth(rows.limit(0), ["a"], 1, 0) is None


def enumerate_edits(rows):
    """Every edit sequence of short conversations: the least cost, and of its audits the ASCII-least."""
    best = None
    whole = re.compile(r"(s?(ua)+)?")
    for ways in itertools.product("KRD", repeat=len(rows)):
        if any(must and w != "D" for w, (_, must, _) in zip(ways, rows, strict=True)):
            continue
        left = [i for i, w in enumerate(ways) if w != "D"]
        base = sum({"K": 0, "R": 2, "D": 3}[w] for w in ways) + sum(rows[i][2] for i in left)
        for holes in itertools.product(range(3), repeat=len(rows) + 1):
            cost = base + 2 * sum(holes)
            if best and cost > best[0]:
                continue
            slots = [x for i in range(len(rows) + 1) for x in ["I"] * holes[i] + ([ways[i]] if i < len(rows) else [])]
            audit = "".join(slots)
            if best and (cost, audit) >= best:
                continue
            fixed, j = [], 0
            for w in slots:
                if w != "I":
                    j += 1
                if w in "IR":
                    fixed.append("ua")
                elif w == "K":
                    fixed.append(rows[j - 1][0])
            if any(whole.fullmatch("".join(x)) for x in itertools.product(*fixed)):
                best = (cost, audit)
    return best


def test_cheapest_edits():
    rng = random.Random(7)
    for _ in range(150):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        want = enumerate_edits(rows)
        ((_, (cost, _, codes, _)),) = conversations.cheapest(rows, {0: (0, 0)}, True).items()
        assert (cost, "".join(conversations.LETTERS[c] for c in codes)) == want


def test_runs_join(monkeypatch):
    """A conversation cut into runs of any length gives what one run gives."""
    rng = random.Random(8)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(["Yes.", "no", "", "Well then", "so!"]) + str(i) * rng.randint(0, 1)) for i in range(rng.randint(0, 40))]
        found = set()
        for n in (1, 2, 3, 7, 64):
            monkeypatch.setattr(conversations, "RUN_ROWS", n)
            one = conversations._Conversation()
            for i, (role, text) in enumerate(rows):
                one.row(i, role, text, hash((role, text, i)))
            found.add(tuple(one.result().items()))
        assert len(found) == 1


def brute_repair(rows):
    """Counts, and the line-up of edits by a table over rows, states and whole audit strings."""
    space = lambda x: " " if x is None else x
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text, f = space(role), space(text), zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            if f:
                text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
                kept += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in kept if t is not None]
        seen, faults = set(), []
        for _, role, text in kept:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:], strict=False)]
        best = {0: (0, "", ())}
        for (_, role, text), fault in zip(kept, faults, strict=True):
            ways = []
            for s, (cost, audit, lines) in best.items():
                ways.append((s, (cost + 3, audit + "D", lines)))
                if fault not in ("blank", "duplicate"):
                    for extra in range(3):
                        c, a, x, t = cost + 2 * extra + (fault == "truncated"), audit + "I" * extra, lines, s
                        for _ in range(extra):
                            t = 3 if t == 2 else 2
                            x += (("user" if t == 2 else "assistant") + ":",)
                        n = 3 if t == 2 else 2
                        ways.append((n, (c + 2, a + "R", (*x, ("user" if n == 2 else "assistant") + ":" + text))))
                        if role[:1] == ("a" if t == 2 else "u"):
                            ways.append((n, (c, a + "K", (*x, f"{role}:{text}"))))
                        if role[:1] == "s" and t == 0:
                            ways.append((1, (c, a + "K", (*x, f"{role}:{text}"))))
            best = {}
            for t, w in ways:
                if t not in best or w[:2] < best[t][:2]:
                    best[t] = w
        ends = [best[s] for s in (0, 3) if s in best]
        if 2 in best:
            ends.append((best[2][0] + 2, best[2][1] + "I", (*best[2][2], "assistant:")))
        if 1 in best:
            ends.append((best[1][0] + 4, best[1][1] + "II", (*best[1][2], "user:", "assistant:")))
        cost, audit, lines = min(ends, key=lambda x: x[:2])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repair(spark):
    rng = random.Random(9)
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", ""]
    rows = [(c, rng.choice([t, t, t, t, None, t // 2]), rng.choice(roles), rng.choice([None, "", "Same words.", f"Turn {t}", f"Is it {t}?  \n", "\x0b ", "é…"])) for c in [*range(60), None] for t in range(rng.randint(1, 12))]
    rows += [(900, t, ("user", "assistant")[t % 2], rng.choice(["Again.", "Again!", "cut"]) + str(t % 50)) for t in range(700)]  # one long conversation over many runs
    rows += [(901, 3, "user", "x" * 300_000), (901, 4, "assistant", "y. " * 100_000), (902, None, None, None)]
    rows += [(i, 0, "user", "gone") for i in range(1000, 1040)]  # some lose their only row
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "conv_id long, turn long, role string, text string, h string, kind long").repartition(6)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(conversations.damage(df)).collect()}
    assert got == brute_repair(rows)
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for k, v in got.items() if k and k >= 1000)
    assert conversations.repair(conversations.damage(df.limit(0))).count() == 0


@pytest.mark.parametrize("rows", [[(1, 5, "user", "Hi.")] * 40, [(1, None, "user", "Hi.")] * 7 + [(1, 2, "user", "Hi.")] * 3])
def test_equal_rows_are_duplicates(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: tuple(r)[1:] for r in conversations.repair(conversations.damage(df)).collect()} == brute_repair(rows)
