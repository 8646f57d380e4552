"""Repair of conversation structure: the cheapest edits of each conversation, as least big integers along its rows."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm.common import read
from gramlake.llm.resampling import crc_sql

#: Costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Codes of the edits' initials in a weight's low digits, in ASCII order; 0 is the padding behind the last.
BITS, LETTERS = 3, " DIKR"
D, I, K, R = 1, 2, 3, 4
#: Rows and bytes of text that one run of weights spans: longer conversations go on from the ranks of the run before.
RUN_ROWS, RUN_BYTES = 64, 8_000_000
#: States: nothing yet, a system row, a user row last, an assistant row last; and the state after an initial that may follow.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The state after an inserted or re-roled row, which can only be the initial that may follow.
TURN = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"


def _insert(best: dict, width: int) -> None:
    """Let every state go on by one or two inserted rows."""
    for _ in range(2):
        for s, (w, n, at) in list(best.items()):
            new = (w + (INSERT << BITS * width) + (I << BITS * (width - 1 - n)), n + 1, at)
            t = TURN[s]
            if t not in best or new < best[t]:
                best[t] = new


def cheapest(rows: list[tuple[str, bool, bool]], starts: dict[int, tuple[int, int]], last: bool) -> dict[int, tuple[int, int, bytes, int]]:
    """The cheapest way through some rows to each state: cost, the rank of its audit, its letters as codes, and the start.

    ``rows`` hold a role's initial, whether the row must go, and whether it is truncated; ``starts`` the cost so far of each
    state and the rank of its audit among them. A weight is one integer: the cost in its high digits; below them a digit for the start's rank and one for
    each letter, at fixed places from the left, 0 where there is none. The least sum along the DAG is the cheapest way and, among those,
    the one of the ASCII-least audit: two ways to one state never continue each other, so places on the left decide as they do in the text.
    ``last``: rows may be inserted behind the last one, and only whole conversations count.
    """
    width = 3 * len(rows) + 3
    cost_at = BITS * width
    best = {s: ((cost << cost_at) + (rank << BITS * (width - 1)), 1, s) for s, (cost, rank) in starts.items()}
    for initial, must_go, truncated in rows:
        _insert(best, width)
        new: dict[int, tuple[int, int, int]] = {}
        for s, (w, n, at) in best.items():
            place = BITS * (width - 1 - n)
            ways = [(s, DELETE, D)]
            if not must_go:
                ways.append((TURN[s], REROLE + TRUNCATED * truncated, R))
                if (s, initial) in NEXT:
                    ways.append((NEXT[s, initial], KEEP + TRUNCATED * truncated, K))
            for t, cost, code in ways:
                way = (w + (cost << cost_at) + (code << place), n + 1, at)
                if t not in new or way < new[t]:
                    new[t] = way
        best = new
    if last:
        _insert(best, width)
        best = {s: best[s] for s in (0, 3) if s in best}
        best = dict([min(best.items(), key=lambda x: x[1])])
    low = (1 << cost_at) - 1
    rank = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][0] & low))}
    return {s: (w >> cost_at, rank[s], bytes(w >> BITS * (width - 1 - i) & 7 for i in range(1, n)), at) for s, (w, n, at) in best.items()}


class _Conversation:
    """One conversation as its rows stream by: a run of rows at a time, and of each state what was decided before it."""

    def __init__(self):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.turn = self.previous = None
        self.turns = 0
        self.known: set[tuple[int, int]] = set()
        self.before: tuple | None = None
        self.rows: list[tuple[str, bool, bool]] = []
        self.lines: list[tuple[str, str]] = []
        self.size = 0
        self.states = {0: (0, 0)}
        self.done = {0: (hashlib.sha256(), False, None)}  # digest so far, whether it has a line, and the letters as a chain of runs

    def marker(self, turn, h) -> None:
        """Rows of this turn with this role and text were seen at an earlier turn."""
        self._at(turn)
        self.known.add(h)

    def _at(self, turn) -> None:
        if turn != self.turn:
            self.turn, self.before = turn, None
            self.known.clear()

    def row(self, turn, role: str, text: str, h) -> None:
        self._at(turn)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        initial = role[:1]
        self.counts["illegal"] += self.previous is not None and self.previous + initial not in LEGAL
        self.previous = initial
        shown = text.rstrip(WHITE)
        blank = not shown
        duplicate = not blank and (h in self.known or (role, h) == self.before)
        truncated = not blank and not duplicate and shown[-1] not in ".!?"
        self.before = (role, h)
        for name, is_it in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            self.counts[name] += is_it
        self.rows.append((initial, blank or duplicate, truncated))
        self.lines.append((role, "" if blank or duplicate else text))
        self.size += len(text)
        if len(self.rows) == RUN_ROWS or self.size > RUN_BYTES:
            self._run(False)

    def _run(self, last: bool) -> None:
        ways = cheapest(self.rows, self.states, last)
        done = {}
        for s, (_, _, codes, start) in ways.items():
            digest, begun, chain = self.done[start]
            digest = digest.copy()
            state, place = start, 0
            for code in codes:
                line = None
                if code == I:
                    state = TURN[state]
                    line = ROLE[state] + ":"
                else:
                    role, text = self.lines[place]
                    if code == R:
                        state = TURN[state]
                        line = f"{ROLE[state]}:{text}"
                    elif code == K:
                        state = NEXT[state, role[:1]]
                        line = f"{role}:{text}"
                    place += 1
                if line is not None:
                    digest.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
                    begun = True
            done[s] = (digest, begun, (chain, codes))
        self.states = {s: (cost, rank) for s, (cost, rank, _, _) in ways.items()}
        self.done = done
        self.rows, self.lines, self.size = [], [], 0

    def result(self) -> dict:
        self._run(True)
        ((state, (cost, _)),) = self.states.items()
        digest, _, chain = self.done[state]
        runs = []
        while chain is not None:
            chain, codes = chain
            runs.append("".join(LETTERS[c] for c in codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": "".join(reversed(runs)), "repaired_sha256": digest.hexdigest()}


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``dropped`` after damage by crc32(``conv_id:turn``) % 20; null parts count as one space.

    0 drops a row (it stays here, marked, so that its conversation is known), 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("f"))
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("f") == 0).alias("dropped"), F.expr("array_repeat(0, if(f = 3, 2, 1))").alias("copies"))
    return out.withColumn("copies", F.explode("copies")).drop("copies")


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, and ``dropped``, which marks rows that only name their conversation).

    Rows go by turn, nulls first, equal turns by role and text. Null is a conversation, a role or text of null one space. Texts move
    once, to the task of their conversation, and stream through it sorted; which texts came at an earlier turn is told by markers in the stream, from a
    join of 128-bit hashes by conversation and text whose groups are added up before they move. A task holds a run of RUN_ROWS
    rows (or RUN_BYTES), four digests, and a byte for each letter of the audit. A conversation of any length stays in one task because its
    sha256 can only be taken in order. Repeated rows are rows (and duplicates); an empty table gives no rows; other columns are not read.
    """
    kind = dict(rows.dtypes)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "dropped")
    rows = rows.withColumn("h", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "text", "role"))
    order = F.struct(F.col("turn").isNotNull().alias("a"), "turn")
    seen = rows.where(~F.col("dropped")).groupBy("conv_id", "h", "h2", "turn").agg(F.lit(1).alias("one"))
    least = seen.groupBy("conv_id", "h", "h2").agg(F.min(order).alias("m"), F.max(order).alias("x")).where("m < x")
    least = least.select(F.col("conv_id").alias("_c"), F.col("h").alias("_h"), F.col("h2").alias("_h2"), "m")
    later = seen.join(least, seen["conv_id"].eqNullSafe(F.col("_c")) & (seen["h"] == F.col("_h")) & (seen["h2"] == F.col("_h2"))).where(order > F.col("m"))
    none = F.lit(None).cast("string")
    stream = rows.select("conv_id", "turn", F.when(F.col("dropped"), 0).otherwise(2).alias("kind"), F.when(~F.col("dropped"), F.col("role")).alias("role"), F.when(~F.col("dropped"), F.col("text")).alias("text"), "h", "h2")
    stream = stream.unionByName(later.select("conv_id", "turn", F.lit(1).alias("kind"), none.alias("role"), none.alias("text"), "h", "h2"))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "kind", "role", "text")

    def each(batches):
        names = [c.split()[0] for c in _OUT.split(", ")]
        current, one, out = None, None, []

        def ready():
            columns = [pa.array([c for c, _ in out])] + [pa.array([r[n] for _, r in out], pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names]
            return pa.RecordBatch.from_arrays([columns[0].cast(key), *columns[1:]], ["conv_id", *names])

        key = None
        for batch in batches:
            key = batch.schema.field("conv_id").type
            for conv, turn, what, role, text, h, h2 in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if one is None or conv != current:
                    if one is not None:
                        out.append((current, one.result()))
                    current, one = conv, _Conversation()
                if what == 1:
                    one.marker(turn, (h, h2))
                elif what == 2:
                    one.row(turn, role, text, (h, h2))
            if out:
                yield ready()
                out.clear()
        if one is not None:
            out.append((current, one.result()))
            yield ready()

    return stream.mapInArrow(each, f"conv_id {kind['conv_id']}, {_OUT}")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(read(spark, sf_dir, "conversations")))


_PATHS = """(0, 'K', 's', '', 1, 0, 0), (0, 'K', 'u', '', 2, 0, 0), (1, 'K', 'u', '', 2, 0, 0), (3, 'K', 'u', '', 2, 0, 0), (2, 'K', 'a', '', 3, 0, 0),
  (0, 'IK', 'a', '', 3, 2, 0), (1, 'IK', 'a', '', 3, 2, 0), (3, 'IK', 'a', '', 3, 2, 0), (2, 'IK', 'u', '', 2, 2, 0),
  (0, 'R', '', 'user', 2, 2, 0), (1, 'R', '', 'user', 2, 2, 0), (3, 'R', '', 'user', 2, 2, 0), (2, 'R', '', 'assistant', 3, 2, 0),
  (0, 'IR', '', 'assistant', 3, 4, 0), (1, 'IR', '', 'assistant', 3, 4, 0), (3, 'IR', '', 'assistant', 3, 4, 0), (2, 'IR', '', 'user', 2, 4, 0),
  (0, 'D', '', '', 0, 3, 1), (1, 'D', '', '', 1, 3, 1), (2, 'D', '', '', 2, 3, 1), (3, 'D', '', '', 3, 3, 1)"""
REPAIR_SQL = rf"""
with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
f as (select k, {crc_sql("k")} % 20 as f from (select distinct k from c)),
d as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when f = 3 then 2 else 1 end)) from c join f using (k) where f <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
e as (select *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as shown, row_number() over (partition by conv_id, role, text order by i) as nth, lag(role[1]) over (partition by conv_id order by i) || role[1] as pair from o),
r as (select *, shown = '' as blank, shown <> '' and nth > 1 as duplicate, shown <> '' and nth = 1 and right(shown, 1) not in ('.', '!', '?') as truncated from e),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate, count(*) filter (where truncated) as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal, max(i) as rows from r group by conv_id),
t as (select * from (values {_PATHS}) t(s, letters, initial, role, t, cost, gone)),
p as (select conv_id, cast(0 as bigint) as i, 0 as s, {{'cost': cast(0 as bigint), 'audit': '', 'repaired': ''}} as v from n
  union all
  select conv_id, i, t, min({{'cost': v.cost + cost, 'audit': v.audit || letters, 'repaired': v.repaired || line}}) as v from (
    select r.conv_id, r.i, t.t, p.v, t.letters, t.cost + case when t.gone = 0 and r.truncated then 1 else 0 end as cost,
      case when t.gone = 1 then '' else (case when t.letters like 'I%' then case when t.s = 2 then chr(10) || 'assistant:' else chr(10) || 'user:' end else '' end) || chr(10) || case when t.role = '' then r.role else t.role end || ':' || r.text end as line
    from p join r on r.conv_id = p.conv_id and r.i = p.i + 1 join t on t.s = p.s and (t.initial = '' or t.initial = r.role[1]) and (t.gone = 1 or not (r.blank or r.duplicate))) group by conv_id, i, t),
z as (select conv_id, min({{'cost': v.cost + case s when 1 then 4 when 2 then 2 else 0 end, 'audit': v.audit || case s when 1 then 'II' when 2 then 'I' else '' end, 'repaired': v.repaired || case s when 1 then chr(10) || 'user:' || chr(10) || 'assistant:' when 2 then chr(10) || 'assistant:' else '' end}}) as v from p join n using (conv_id) where p.i = n.rows group by conv_id)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(v.cost, 0) as cost, coalesce(v.audit, '') as audit, sha256(coalesce(v.repaired[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join n using (conv_id) left join z using (conv_id)
"""

QUERIES = {"op13_repair": op13_repair}
ORACLES = {"op13_repair": REPAIR_SQL}
