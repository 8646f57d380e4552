"""Exact similarity join of embeddings: pivots partition the vectors, the triangle inequality replicates, cells join alone."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm.common import cut, ranges, read
from gramlake.llm.components import components, forest

#: Most rows and bytes of a part, whose vectors a task holds while others stream by.
PART_ROWS, PART_BYTES = 8192, 32_000_000
#: Rings of a cell, by angle to its pivot, that its parts are made of.
RINGS = 16
#: Fewest pivots and most bytes of them (they are broadcast); vectors that directions are taken from (they meet on the driver).
FEWEST_PIVOTS, PIVOT_BYTES, DIRECTION_ROWS = 8, 16_000_000, 512
#: Directions in which cosines are bounded before whole vectors are compared.
DIRECTIONS = 24
#: Slack on angles and chords, far above their rounding error: it only adds replicas.
SLACK = 1e-6
#: Rows a part's held rows are copied to another task after.
PASSING_ROWS = 16 * PART_ROWS
#: Numbers of a slice of vectors by pivots, and bytes of one batch of copies.
SLICE_NUMBERS, COPY_BYTES = 2_000_000, 16_000_000
#: Roles of rows in a task.
HELD, PASSING = 0, 1


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _valid(vector) -> F.Column:
    """Not null, without null, NaN or infinite components, and not zero."""
    d = vector.cast("array<double>")
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(d, lambda x: x != 0), F.lit(False))


class Layout:
    """Where vectors of one length live: pivots, what cells and rings reach, and which parts they are cut into.

    Part ``first[cell] + ring group * slots[cell] + slot`` holds the vectors of a cell in some neighbouring
    rings; where even one ring is too large, they are dealt to slots by hash.
    """

    def __init__(self, pivots: np.ndarray, directions: np.ndarray, threshold: float):
        self.pivots, self.directions = pivots, directions
        self.theta, self.chord = math.acos(max(-1.0, min(1.0, threshold))), math.sqrt(max(0.0, 2 - 2 * threshold))
        self.slice_rows = max(1, SLICE_NUMBERS // len(pivots))

    def measure(self, units: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cosines to all pivots, the nearest one, the angle to it, and that angle with equal ones told apart by hash."""
        cosine = np.clip(units @ self.pivots.T, -1.0, 1.0)
        home = cosine.argmax(axis=1)
        angle = np.arccos(cosine[np.arange(len(home)), home])
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        return cosine, home, angle, angle + mixed * (0.1 * SLACK / (1 << 24))

    def divide(self, cells: list, rows: int) -> None:
        """Parts of at most about ``rows`` vectors from each cell's count, radius and RINGS + 1 quantiles of its angles."""
        k = len(self.pivots)
        self.radius, groups, self.slots = np.full(k, -1.0), np.zeros(k, np.int64), np.ones(k, np.int64)
        self.cuts = np.zeros((k, RINGS + 1))
        for r in cells:
            wanted = -(-r.n // rows)
            groups[r.home], self.slots[r.home] = min(RINGS, wanted), -(-wanted // RINGS)
            self.radius[r.home], self.cuts[r.home] = r.radius, r.cuts
        self.groups, self.parts = groups, groups * self.slots
        self.first = np.concatenate([[0], np.cumsum(self.parts)])
        self.n_parts = int(self.first[-1])
        cell = np.repeat(np.arange(k), self.parts)
        group = (np.arange(self.n_parts) - self.first[cell]) // self.slots[cell]
        low, high = -(-group * RINGS // groups[cell]), -(-(group + 1) * RINGS // groups[cell])
        self.cell, self.low, self.high = cell, self.cuts[cell, low], self.cuts[cell, high]
        self.low[low == 0], self.high[high == RINGS] = 0.0, math.pi
        self.high = np.minimum(self.high, self.radius[cell] + SLACK)

    def own_part(self, home: np.ndarray, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
        ring = (place[:, None] > self.cuts[home][:, 1:RINGS]).sum(axis=1)
        slot = ((ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64) % self.slots[home]
        return self.first[home] + ring * self.groups[home] // RINGS * self.slots[home] + slot

    def share(self, passing: dict[int, int], most: int) -> None:
        """Tasks of each part: one for every ``most`` rows that pass it by."""
        n = np.array([passing.get(i, 0) for i in range(self.n_parts)], np.int64)
        self.tasks = np.maximum(1, -(-n // most))
        self.first_task = np.concatenate([[0], np.cumsum(self.tasks)[:-1]]).astype(np.int64)
        self.first_tasks = set(self.first_task.tolist())

    def place(self, m: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The part of each vector, and rows and parts of its visits."""
        cosine, home, _, place = self.measure(_units(m), ids)
        part = self.own_part(home, place, ids)
        return part, *self.visits(cosine, home, part)

    def visits(self, cosine: np.ndarray, home: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the other parts that may hold a vector which they link with, each two parts in one order only.

        x can link with a member y of cell i only if angle(x, i) <= radius(i) + theta, angle(x, i) <=
        angle(x, home) + 2 theta, x's distance to the plane between the two pivots is at most the chord of theta, and
        angle(x, i) is within theta of the part's ring. All follow from the triangle inequality for x, y and pivots.
        """
        rows = np.arange(len(home))
        used, at = np.unique(home, return_inverse=True)  # chords between the homes' pivots and all: no table of all pairs
        between = np.sqrt(np.maximum(0.0, 2 - 2 * self.pivots[used] @ self.pivots.T))
        between = np.where(between > 0, between, np.inf)[at]
        angle, best = np.arccos(cosine), cosine[rows, home]
        near = (self.parts > 0) & (angle <= self.radius + self.theta + SLACK) & (angle <= np.arccos(best)[:, None] + 2 * self.theta + SLACK)
        near &= best[:, None] - cosine <= (self.chord + SLACK) * between
        near[rows, home] = True
        row, cell = np.nonzero(near)
        counts = self.parts[cell]
        part = np.repeat(self.first[cell] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
        row = np.repeat(row, counts)
        at = angle[row, self.cell[part]]
        keep = (at >= self.low[part] - self.theta - SLACK) & (at <= self.high[part] + self.theta + SLACK)
        ahead = (part - own[row]) % self.n_parts  # half of the others follow on a circle: every two parts meet at one of them
        keep &= (ahead > 0) & ((2 * ahead < self.n_parts) | ((2 * ahead == self.n_parts) & (own[row] < part)))
        return row[keep], part[keep]


class _Part:
    """The held rows of one part: counts of links and links between classes, as other rows stream by."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, units: np.ndarray, directions: np.ndarray, threshold: float):
        self.ids, self.weights, self.units, self.threshold = ids, weights, units, threshold
        self.directions, self.short = directions, self._shorten(units, directions)
        self.links, self.label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _shorten(units: np.ndarray, directions: np.ndarray) -> np.ndarray:
        """Coordinates in some directions and the length of what is left: their dot product bounds the cosine from above."""
        p = units @ directions
        return np.concatenate([p, np.sqrt(np.maximum(0.0, 1 - (p * p).sum(axis=1, keepdims=True)))], axis=1).astype(np.float32)

    def _pairs(self, units: np.ndarray, short: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of the first ``upto`` held rows with these rows: those that the bound leaves are compared in double precision."""
        likely = self.short[:upto] @ short.T >= np.float32(self.threshold - 2e-5)
        if not likely.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, column = np.nonzero(likely)
        some, there = np.unique(row), np.unique(column)
        if 8 * len(row) >= len(some) * len(there):  # a dense corner
            a, b = np.nonzero(self.units[some] @ units[there].T >= self.threshold)
            return some[a], there[b]
        keep = [np.einsum("ij,ij->i", self.units[row[i : i + 8192]], units[column[i : i + 8192]]) >= self.threshold for i in range(0, len(row), 8192)]
        keep = np.concatenate(keep)
        return row[keep], column[keep]

    def _join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Held rows left[i] and right[i] are in one component."""
        pairs = np.unique(np.stack([left, right], 1)[left != right], axis=0)
        if len(pairs):
            n = len(self.ids)
            self.label = forest(n, np.concatenate([np.arange(n), pairs[:, 0]]), np.concatenate([self.label, pairs[:, 1]]))

    def meet_itself(self) -> None:
        for at in range(0, len(self.ids), 256):
            block = slice(at, at + 256)
            row, column = self._pairs(self.units[block], self.short[block], at + 256)
            column = column + at
            once = row < column
            row, column = row[once], column[once]
            self.links += np.bincount(row, self.weights[column], len(self.ids)).astype(np.int64) + np.bincount(column, self.weights[row], len(self.ids)).astype(np.int64)
            self._join(self.label[row], self.label[column])

    def meet(self, ids: np.ndarray, weights: np.ndarray, units: np.ndarray) -> None:
        for at in range(0, len(ids), 256):
            block = slice(at, at + 256)
            row, column = self._pairs(units[block], self._shorten(units[block], self.directions), len(self.ids))
            if not len(row):
                continue
            other = ids[block]
            self.links += np.bincount(row, weights[block][column], len(self.ids)).astype(np.int64)
            seen = np.flatnonzero(np.bincount(column, minlength=len(other)))
            count = np.bincount(column, self.weights[row], len(other)).astype(np.int64)[seen]
            first = np.full(len(other), len(self.ids))
            np.minimum.at(first, column, self.label[row])
            self._join(self.label[row], first[column])
            self.out.append((other[seen], other[seen], count))
            self.out.append((self.ids[first[seen]], other[seen], np.full(len(seen), -1)))

    def rows(self) -> pa.RecordBatch:
        """Counts of links as (class, class, count), and a spanning set of links as (class, class, -1)."""
        some, moved = np.flatnonzero(self.links), np.flatnonzero(self.label != np.arange(len(self.ids)))
        parts = [*self.out, (self.ids[some], self.ids[some], self.links[some]), (self.ids[self.label[moved]], self.ids[moved], np.full(len(moved), -1))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in range(3)], ["a", "b", "links"])


def similarity_join(vectors: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key``, n_links, component_id and kept for every row: who has a cosine of at least ``threshold`` with whom.

    What links are different vectors and different (key, vector) pairs: equal vectors are one class, whose weight is the
    number of different keys that have it. Pivots (a hashed sample) partition the classes by least angle; cells are cut
    into parts of neighbouring rings around their pivot; a class is copied to those parts of other cells that the
    triangle inequality cannot exclude (``Layout.visits``), of every two parts to one. Each part meets the rows that
    stream by: cosines are bounded from above in a few directions that hold most of the vectors' lengths, and the whole
    vectors are compared in double precision where the bound leaves a link possible. Links are counted and never made
    into rows; what leaves a part is the counts that aren't 0 and a spanning set of links. Shuffles: the copies once,
    and the components. On vectors without any structure nothing excludes cells, and the work is quadratic.

    Vectors that are null, empty or zero or hold null or non-finite components have n_links 0 and
    themselves as component; vectors of different lengths don't link. Repeated rows (equal keys and vectors) are one
    vector, of which each row gets the result; rows with equal keys and different vectors are different vectors, which may
    link. component_id is the least key in reach. A null key keeps its row, with a null component_id, kept true, and links
    with nothing. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    every = vectors.select(vectors[key].cast("long").alias("k"), vectors[vector].alias("v"))
    known = _valid(F.col("v")) & F.col("k").isNotNull()
    valid = every.where(known)
    classes = cut(valid.groupBy("v").agg(F.min("k").alias("rep"), F.count_distinct("k").alias("w")).withColumn("c", F.monotonically_increasing_id()))
    lengths = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # lengths, not rows
    found = None
    for r in lengths:
        one = _join_length(spark, classes.where(F.size("v") == r.d), r.d, r.n, threshold)
        found = one if found is None else found.union(one)
    alone = every.where(~known).select("k", F.lit(0).cast("long").alias("links"), F.col("k").alias("component"))
    if found is None:
        out = alone
    else:
        found = cut(found)
        counts = found.where("links >= 0").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("more"))
        joined = components(found.where("links < 0").select("a", "b")).select(F.col("node").alias("c"), "component")
        least = joined.join(classes.select("c", "rep"), "c").groupBy("component").agg(F.min("rep").alias("least"))
        named = joined.join(least, "component").select("c", "least")
        by_class = classes.join(counts, "c", "left").join(named, "c", "left")
        by_class = by_class.select("v", (F.col("w") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("least", "rep").alias("component"))
        out = valid.join(by_class, "v").select("k", "links", "component").union(alone)
    return out.select(F.col("k").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("k") == F.col("component"), F.lit(True)).alias("kept"))


def _layout(classes: DataFrame, dim: int, n: int, threshold: float, rows: int) -> Layout:
    """Pivots and directions from bounded samples by hash."""
    wanted = min(max(FEWEST_PIVOTS, PIVOT_BYTES // (8 * dim)), max(FEWEST_PIVOTS, math.ceil(n / rows)))
    most = max(wanted, DIRECTION_ROWS)
    share = min(1 << 30, math.ceil((most + 4 * most**0.5 + 8) / n * (1 << 30)))
    order = F.xxhash64("c", F.lit(3))
    sample = classes.select("c", "v").where(F.pmod(order, F.lit(1 << 30)) < share).orderBy(order, "c").limit(most).collect()
    units = _units(np.array([r.v for r in sample or classes.select("v").limit(1).collect()], np.float64))
    _, _, directions = np.linalg.svd(units, full_matrices=False)
    return Layout(np.unique(units[:wanted], axis=0), directions[:DIRECTIONS].T.copy(), threshold)


def _slices(batches, rows: int):
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            yield whole.slice(i, rows)


def _join_length(spark: SparkSession, classes: DataFrame, dim: int, n: int, threshold: float) -> DataFrame:
    """Counts and spanning links between the ``n`` different vectors of one length: a, b, links (-1 for a link).

    The rows that pass each part are counted first, and parts that many pass are held by several tasks.
    """
    part_rows = max(1, min(PART_ROWS, PART_BYTES // (8 * dim)))
    layout = _layout(classes, dim, n, threshold, part_rows)
    sent = spark.sparkContext.broadcast(layout)

    def places(batches):
        own = sent.value
        for batch in _slices(batches, own.slice_rows):
            _, home, angle, place = own.measure(_units(_matrix(batch.column(1), dim)), batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(angle), pa.array(place)], ["home", "angle", "place"])

    placed = classes.select("c", "v").mapInArrow(places, "home int, angle double, place double").groupBy("home")
    steps = F.array(*[F.lit(i / RINGS) for i in range(RINGS + 1)])
    cells = placed.agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.percentile_approx("place", steps, 10_000).alias("cuts")).collect()  # one row a pivot
    layout.divide(cells, part_rows)
    counted = spark.sparkContext.broadcast(layout)

    def passing(batches):
        own, total = counted.value, np.zeros(counted.value.n_parts, np.int64)
        for batch in _slices(batches, own.slice_rows):
            total += np.bincount(own.place(_matrix(batch.column(1), dim), batch.column(0).to_numpy())[2], minlength=own.n_parts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["part", "n"])

    visitors = classes.select("c", "v").mapInArrow(passing, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row a part
    layout.share({r.part: r.n for r in visitors}, PASSING_ROWS)
    dealt = spark.sparkContext.broadcast(layout)
    wide = np.float32 if classes.schema["v"].dataType.elementType.simpleString() == "float" else np.float64

    def copies(batches):
        """Each vector as a held row of its own part, and as a passing row of the parts that may link with it."""
        own, size = dealt.value, dim * wide().itemsize
        step = max(1, COPY_BYTES // size)
        for batch in _slices(batches, own.slice_rows):
            m, c = _matrix(batch.column(2), dim), batch.column(0).to_numpy()
            part, row, other = own.place(m, c)
            raw, w = m.astype(wide), batch.column(1).to_numpy()
            again = np.repeat(np.arange(len(c)), own.tasks[part])  # held rows go to every task of their part
            taken = np.concatenate([again, row])
            task = np.concatenate([own.first_task[part][again] + ranges(np.zeros(len(c), np.int64), own.tasks[part]), own.first_task[other] + ((c[row].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % own.tasks[other]])
            role = np.repeat(np.array([HELD, PASSING], np.int8), [len(again), len(row)])
            for a in range(0, len(taken), step):
                some = taken[a : a + step]
                data = pa.Array.from_buffers(pa.binary(size), len(some), [None, pa.py_buffer(raw[some].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(task[a : a + step]), pa.array(role[a : a + step]), pa.array(c[some]), pa.array(w[some]), data], ["part", "role", "c", "w", "b"])

    def join(batches):
        now, held, part = None, [], None
        for whole in batches:
            for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                number, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                edges = np.flatnonzero(np.diff(number) | np.diff(role)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)], strict=True):
                    if a == b:
                        continue
                    if number[a] != now:
                        if held:
                            part = part or begin(held, now)
                            yield part.rows()
                        now, held, part = number[a], [], None
                    m = np.frombuffer(b"".join(batch.column(4).slice(a, b - a).to_pylist()), wide).reshape(b - a, dim).astype(np.float64)
                    rows = (batch.column(2).to_numpy()[a:b], batch.column(3).to_numpy()[a:b], _units(m))
                    if role[a] == HELD:
                        held.append(rows)
                    elif held:
                        part = part or begin(held, now)
                        part.meet(*rows)
        if held:
            yield (part or begin(held, now)).rows()

    def begin(held, task):
        part = _Part(*(np.concatenate([h[i] for h in held]) for i in range(3)), dealt.value.directions, threshold)
        held[1:] = []  # the part has its own copy
        if task in dealt.value.first_tasks:  # once for each part
            part.meet_itself()
        return part

    spread = classes.select("c", "w", "v").mapInArrow(copies, "part long, role byte, c long, w long, b binary")
    return spread.repartition("part").sortWithinPartitions("part", "role").mapInArrow(join, "a long, b long, links long")


def op1_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(read(spark, sf_dir, "embeddings"))


LINK_SQL = """
with recursive e as (select vec_id, cast(embedding as double[]) as v, row_number() over (order by vec_id) as r from embeddings),
u as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as s from e where v is not null and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0),
l as materialized (select a.vec_id as p, b.vec_id as q from u a join u b on a.vec_id <> b.vec_id and a.s > 0 and b.s > 0 and list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.95),
r as (select vec_id as x, vec_id as y from e union select r.x, l.q from r join l on r.y = l.p)
select e.vec_id, (select count(*) from l where l.p = e.vec_id) as n_links, m.component_id, e.vec_id = m.component_id as kept
from e join (select x, min(y) as component_id from r group by x) m on e.vec_id = m.x
"""

QUERIES = {"op1_embedding_join": op1_embedding_join}
ORACLES = {"op1_embedding_join": LINK_SQL}
