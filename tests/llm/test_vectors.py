"""The embedding join against brute force, components, the pipeline and the registered queries."""

import math
import random

import numpy as np
import pytest

from gramlake.llm import embeddings
from gramlake.llm.components import components, forest


def brute(rows, threshold=0.95):
    """Sorted (key, n_links, component, kept) of every row, over different (key, vector) pairs."""
    ok = {(i, tuple(v)): np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {x: set() for x in ok}
    for a, x in ok.items():
        for b, y in ok.items():
            if a != b and len(x) == len(y) and x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= threshold:
                links[a].add(b)
    found = {}
    for x in links:
        seen, todo = {x}, [x]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        found[x] = (len(links[x]), min(k for k, _ in seen))
    out = []
    for i, v in rows:
        n, c = found.get((i, tuple(v or ())), (0, i))
        out.append((-1 if i is None else i, n, -1 if c is None else c, i == c))
    return sorted(out)


def joined(df, **more):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in embeddings.similarity_join(df, **more).collect())


@pytest.mark.parametrize(("part", "pivots"), [(embeddings.PART_ROWS, 8), (5, 8), (3, 1)])
def test_join_equals_brute_force(spark, part, pivots, monkeypatch):
    monkeypatch.setattr(embeddings, "PART_ROWS", part)
    monkeypatch.setattr(embeddings, "FEWEST_PIVOTS", pivots)
    if pivots == 1:  # one cell: rings and slots alone
        monkeypatch.setattr(embeddings, "PIVOT_BYTES", 0)
    rng = np.random.default_rng(0)
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [1.0, None] + [0.0] * 6), (5, [math.nan] + [1.0] * 7), (6, [math.inf] + [1.0] * 7), (7, [1.0, 2.0]), (8, [2.0, 4.0])]
    for c in range(6):
        centre = rng.normal(size=8)
        rows += [(100 * (c + 1) + i, (centre + rng.normal(scale=0.25, size=8)).tolist()) for i in range(20)]
    rows += [(900 + i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(2000 + i, rows[20][1]) for i in range(4)] + [(2100, [2 * x for x in rows[20][1]])]
    rows += [(3000 + i, np.eye(8)[i % 8].tolist()) for i in range(16)]
    # repeated rows, one key with vectors that link and with some that don't, and no key
    rows += [rows[30], rows[30], (105, rows[22][1]), (105, rows[23][1]), (105, rows[50][1]), (900, rows[8][1]), (None, rows[20][1])]
    df = spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, label int, k string, w double")
    assert joined(df) == brute(rows)
    assert joined(df, threshold=0.6) == brute(rows, 0.6)


def test_join_of_many_close_vectors(spark, monkeypatch):
    """A group of near copies, none equal, over many parts: all links are counted, none is a row."""
    monkeypatch.setattr(embeddings, "PART_ROWS", 60)
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(scale=0.05, size=64)).tolist()) for i in range(400)] + [(1000 + i, rng.normal(size=64).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert joined(df) == sorted([(i, 399, 0, i == 0) for i in range(400)] + [(1000 + i, 0, 1000 + i, True) for i in range(200)])


def test_parts_that_many_pass_lie_in_several_tasks(spark, monkeypatch):
    """Held rows are copied to tasks by the rows that pass; links are still counted once."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = joined(df)
    monkeypatch.setattr(embeddings, "PART_ROWS", 40)
    monkeypatch.setattr(embeddings, "PASSING_ROWS", 30)
    monkeypatch.setattr(embeddings, "COPY_BYTES", 1000)
    assert joined(df) == want and sum(r[1] for r in want) > 100


def test_wide_vectors_with_many_visits(spark):
    """768 dimensions and 120 parts: copies are cut by bytes, and pivots meet one another only as homes."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 768))
    rows = [(i, (base[i % 40] + rng.normal(scale=0.05 * (i % 3), size=768)).astype(np.float32).tolist()) for i in range(600)]
    old, embeddings.PART_ROWS = embeddings.PART_ROWS, 5
    try:
        got = embeddings.similarity_join(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    finally:
        embeddings.PART_ROWS = old
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = (u @ u.T >= 0.95).sum(1) - 1
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(links.tolist()))


def test_layout_holds_no_table_of_pivot_pairs():
    rng = np.random.default_rng(8)
    pivots = embeddings._units(rng.normal(size=(3000, 16)))
    own = embeddings.Layout(pivots, np.eye(16)[:, :4], 0.95)
    assert sum(v.nbytes for v in vars(own).values() if isinstance(v, np.ndarray)) < 2 * pivots.nbytes
    assert own.slice_rows * len(pivots) <= embeddings.SLICE_NUMBERS


def test_join_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert joined(spark.createDataFrame([], schema)) == []
    assert joined(spark.createDataFrame([(1, None), (2, [0.0])], schema)) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert joined(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [1.0, 0.0])], schema)) == [(-1, 0, -1, True), (4, 1, 4, True), (9, 1, 4, False)]
    assert joined(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0])], schema)) == [(1, 0, 1, True), (1, 0, 1, True)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(5, 5), (1, 0), (0, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    index = {v: i for i, v in enumerate(nodes)}
    pairs = [(index[a], index[b]) for a, b in edges if a != b]
    label = forest(len(nodes), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert got == {v: nodes[label[i]] for v, i in index.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows = docs.count()
        if name != "packing":
            assert docs.columns == columns and rows <= before
            assert docs.where("text is not null and n_chars <> length(text)").count() == 0
            before = rows
    assert rows >= before and corpus_pipeline.run(spark, sf).count() == rows


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
