"""The pipeline on planted copies, near copies, passages, benchmark windows and mixed texts."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline

WINDOW = 2048


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    rng = random.Random(13)
    sounds = {"aa": ["ba", "do", "ki", "mu"], "bb": ["xe", "qi", "zo", "vy"]}
    word = lambda lang: "".join(rng.choices(sounds[lang], k=rng.randint(2, 4)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n)).capitalize() + "."
    text = lambda lang: "\n".join(line(lang, rng.randint(12, 30)) for _ in range(rng.randint(3, 8)))
    docs = {i: (text("ab"[i % 2] * 2), "ab"[i % 2] * 2) for i in range(120)}
    passage = "\n".join(line("aa", 20) for _ in range(4))  # 80 words that five documents share
    for i in range(200, 205):
        docs[i] = (f"{text('aa')}\n{passage}\n{text('aa')}", "aa")
    for i in range(300, 303):
        docs[i] = (docs[0][0].replace("\n", " "), "aa")  # equal words on one line: the lines differ, the words don't
    longest = max((i for i in range(120) if i % 2), key=lambda i: len(docs[i][0]))
    near = docs[longest][0].replace("\n", " ").split()
    near[len(near) // 2] = "changedword"
    docs[310] = (" ".join(near), "bb")
    leak = [line("aa", 15) for _ in range(6)]
    for i, item in enumerate(leak[:3]):
        docs[320 + i] = (f"{line('aa', 40)} {item} {line('aa', 40)}", "aa")
    docs[330], docs[331], docs[332] = ("12 34 !?", "aa"), ("", None), (None, None)
    folder = str(tmp_path_factory.mktemp("planted"))
    keys = list(docs)
    pq.write_table(pa.table({"doc_id": pa.array(keys, pa.int64()), "text": [docs[k][0] for k in keys], "lang": [docs[k][1] for k in keys], "source": ["s"] * len(keys), "n_chars": pa.array([len(docs[k][0] or "") for k in keys], pa.int64())}), f"{folder}/documents.parquet", row_group_size=40)
    pq.write_table(pa.table({"item_id": pa.array(range(len(leak)), pa.int64()), "text": leak}), f"{folder}/benchmark.parquet")
    return folder, docs, passage


def kept_by(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage{i}.parquet"
        stage(spark, docs, folder).write.mode("overwrite").parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_planted_cases(spark, planted):
    folder, docs, passage = planted
    out = kept_by(spark, folder)
    clean = set(range(120))
    ids = lambda name: {r.doc_id for r in out[name].select("doc_id").distinct().collect()}
    assert ids("language") == set(docs) - {330, 331, 332}
    lines = {r.doc_id: r.text for r in out["line_dedup"].collect()}
    holders = [i for i in range(200, 205) if passage in lines[i]]
    assert len(holders) <= 1 and all(lines[i] == docs[i][0] for i in clean)
    assert sum(all(x not in lines[i] for x in passage.split("\n")) for i in range(200, 205)) >= 4
    near = ids("near_duplicates")
    assert clean <= near and not near & {300, 310} and lines[301] == lines[302] == ""  # a repeated long line goes with the lines
    left = ids("decontamination")
    assert not left & {320, 321, 322} and clean <= left
    pieces = out["packing"].collect()
    assert {r.doc_id for r in pieces} == left
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in by_doc.values():
        rows.sort()
        assert [a for a, _, _ in rows] == [sum(n for _, n, _ in rows[:i]) for i in range(len(rows))] and sum(n for _, n, _ in rows) == rows[0][2]
    for rows in by_sequence.values():
        rows.sort()
        assert [a for a, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(len(rows))] and sum(n for _, n in rows) <= WINDOW


def test_run_equals_its_stages_and_leaves_one_folder(spark, planted):
    folder, _, _ = planted
    want = sorted(map(tuple, kept_by(spark, folder)["packing"].select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    place = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(place))
    got = corpus_pipeline.run(spark, folder)
    assert len(set(os.listdir(place)) - before) == 1  # what the last stage reads
    total = lambda rows: sorted((r[0], r[4]) for r in rows if r[1] == 0)
    assert total(map(tuple, got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) == total(want)
