"""Quality rules with thresholds that follow each language and source: statistics of texts, mergeable quantile sketches, a joined filter."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm.common import cut, grams, map_texts, read, span_hashes, spans
from gramlake.llm.quality import IS_VISIBLE

#: Words below which a text fails, and the percentage of repeated words above which it does.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words of a window whose second place is a repetition.
WINDOW = 3
#: Width of a sketch's bins: a quantile is right to 1 % of itself. Values of TINY and less share bin LOWEST.
GAMMA, TINY = 1.02, 1e-6
LOWEST = math.floor(math.log(TINY) / math.log(GAMMA))
#: The least texts that make a threshold of their own; with fewer, a source takes its language's, or everybody's.
GROUP_ROWS = 100
#: Quartiles, and how many times their distance (or a rule's least distance) a value may lie beyond them.
LOW, HIGH, REACH = 0.25, 0.75, 3.0
#: The rules: value of a text, the least distance of quartiles that counts, and whether too little is as bad as too much.
RULES = {
    "word_length": ("word_chars / n_words", 0.75, True),
    "symbols": ("n_symbols / n_words", 0.02, False),
    "dup_lines": ("n_dup_lines / n_lines", 0.15, False),
    "repeat_words": ("n_repeat_words / n_words", 0.10, False),
}
#: Bytes of group names and number of groups up to which thresholds are broadcast; beyond, they are joined in SALTS parts.
BROADCAST_BYTES, BROADCAST_GROUPS, SALTS = 16_000_000, 100_000, 32

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_IN_LINE = np.ones(256, bool)
_IN_LINE[10] = False


def _by_row(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` between every two neighbouring edges."""
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[edges]
    return np.diff(sums)


def _again(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of (row, value), and which of them equal the one before."""
    order = np.lexsort((value, row))
    same = np.zeros(len(order), bool)
    same[1:] = (row[order[1:]] == row[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    return order, same


def statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of each text."""
    rows = len(offsets) - 1
    starts, ends, first = spans(data, offsets, IS_VISIBLE)
    n_words = np.diff(first)
    chars = _by_row(IS_VISIBLE[data] & ((data & 0xC0) != 0x80), offsets)
    symbols = _by_row(_SYMBOL[data], offsets)

    line_start, line_end, line_first = spans(data, offsets, _IN_LINE)
    full = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    line_row = np.repeat(np.arange(rows), np.diff(line_first))[full]
    order, same = _again(line_row, span_hashes(data, line_start[full], line_end[full]))
    n_lines = np.bincount(line_row, minlength=rows)
    dup_lines = np.bincount(line_row[order[same]], minlength=rows)

    row = np.repeat(np.arange(rows), n_words)
    window = grams(span_hashes(data, starts, ends), WINDOW)
    inside = np.flatnonzero(row[: len(window)] == row[len(row) - len(window) :])
    order, same = _again(row[inside], window[inside])
    twice = same.copy()
    twice[:-1] |= same[1:]
    at = inside[order[twice]]
    depth = np.bincount(at, minlength=len(row) + 1)[: len(row) + 1] - np.bincount(at + WINDOW, minlength=len(row) + 1)[: len(row) + 1]
    repeat = _by_row(np.cumsum(depth[: len(row)]) > 0, first)
    return [n_words, chars, symbols, dup_lines, repeat, n_lines]


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_statistics(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, STATISTICS and base_failed of every whole text. One pass, no shuffle; null and empty texts have zeros and fail."""
    out = map_texts(docs, lambda: lambda data, offsets: [pa.array(x.astype(np.int64)) for x in statistics(data, offsets)], ", ".join(f"{s} long" for s in STATISTICS), text, carry)
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _bin(value: Column) -> Column:
    return F.when(value > TINY, F.ceil(F.log(value) / math.log(GAMMA))).otherwise(F.lit(LOWEST)).cast("long")


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """``groups``, rule, bin, n: how many values of a rule fall into each bin of a group.

    A sketch is its counts, so that sketches merge by adding them up, in any order and with the same result: tasks add up
    before the shuffle, and a group of any size sends no more than its bins.
    """
    values = F.array(*[F.struct(F.lit(name).alias("rule"), _bin(F.expr(value)).alias("bin")) for name, (value, _, _) in RULES.items()])
    return rows.select(*groups, F.inline(values)).groupBy(*groups, "rule", "bin").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Coarser sketches from finer ones."""
    return sketch.groupBy(*groups, "rule", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """``groups``, rule, n, low and high: the values at the ranks floor(share (n - 1)), to the middle of their bins.

    A group's bins, of which there are a few hundred, are ordered in a window.
    """
    from pyspark.sql import Window

    keys = [*groups, "rule"]
    placed = sketch.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    value = lambda b: F.when(b > LOWEST, 2 * F.pow(F.lit(GAMMA), b) / (GAMMA + 1)).otherwise(F.lit(0.0))
    at = lambda share: value(F.min(F.when(F.col("upto") > F.floor(F.lit(share) * (F.col("all") - 1)), F.col("bin"))))
    return placed.groupBy(*keys).agg(F.max("all").alias("n"), at(LOW).alias("low"), at(HIGH).alias("high"))


def thresholds(rows: DataFrame, lang: str = "lang", source: str = "source", least: int = GROUP_ROWS) -> DataFrame:
    """lang, source and for each rule its least and greatest allowed value, ``<rule>_from`` and ``<rule>_to``.

    Of the sketches of the source in the language, of the language, and of all rows, the first with ``least`` rows counts.
    Null is a language or source of its own.
    """
    fine = sketches(rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), *STATISTICS), ["lang", "source"])
    fine = cut(fine)
    by_lang = quartiles(merge(fine, ["lang"]), ["lang"])
    whole = quartiles(merge(fine, []), [])
    own = quartiles(fine, ["lang", "source"])
    named = [q.select(*[F.col(c).alias(f"{c}_{i}") for c in q.columns]) for i, q in enumerate((by_lang, whole))]
    every = own.join(named[0], (own["lang"].eqNullSafe(F.col("lang_0"))) & (own["rule"] == F.col("rule_0"))).join(F.broadcast(named[1]), own["rule"] == F.col("rule_1"))
    pick = lambda c: F.when(F.col("n") >= least, F.col(c)).when(F.col("n_0") >= least, F.col(f"{c}_0")).otherwise(F.col(f"{c}_1"))
    every = every.select("lang", "source", "rule", pick("low").alias("low"), pick("high").alias("high"))
    of = lambda rule, c: F.max(F.when(F.col("rule") == rule, F.col(c)))
    columns = []
    for rule, (_, least_width, both) in RULES.items():
        low, high = of(rule, "low"), of(rule, "high")
        width = REACH * F.greatest(high - low, F.lit(least_width))
        columns += [((low - width) if both else F.lit(-1.0)).alias(f"{rule}_from"), (high + width).alias(f"{rule}_to")]
    return every.groupBy("lang", "source").agg(*columns)


def judge(rows: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", most: tuple[int, int] = (BROADCAST_BYTES, BROADCAST_GROUPS)) -> DataFrame:
    """``rows`` with ``failed``, the rules that a text that passes the base rules breaks, and ``kept``.

    Thresholds are broadcast within ``most`` bytes of names and groups, which are counted; else rows get one of SALTS salts and
    meet a copy of the thresholds with it, so that a source that holds a third of all rows lies in many tasks.
    """
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    size = limits.agg(F.sum(F.octet_length(F.concat_ws("", "_lang", "_source"))).alias("bytes"), F.count("*").alias("n")).first()
    on = F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source"))
    if (size.bytes or 0) <= most[0] and size.n <= most[1]:
        joined = rows.join(F.broadcast(limits), on, "left")
    else:
        salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        joined = salted.join(limits.withColumn("_salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), on & (F.col("_salt") == F.col("_salt2")), "left")
    breaks = [F.when((F.expr(value) > F.col(f"{rule}_to")) | (F.expr(value) < F.col(f"{rule}_from")), F.lit(rule)) for rule, (value, _, _) in RULES.items()]
    failed = F.when(~F.col("base_failed"), F.array_compact(F.array(*breaks))).otherwise(F.array().cast("array<string>"))
    return joined.select(*rows.columns, failed.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def filter_quality(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", least: int = GROUP_ROWS, most: tuple[int, int] = (BROADCAST_BYTES, BROADCAST_GROUPS)) -> DataFrame:
    """doc_id, STATISTICS, base_failed, failed and kept of every document.

    Thresholds come from all documents that pass the base rules. Texts are read once: their statistics, a few numbers a row, are
    written and used by the sketches and by the filter. Every row is judged for itself, repeated ones and null keys too; an empty
    table gives none; other columns, whatever their names, are not read.
    """
    rows = cut(text_statistics(docs.select(docs[key].alias("doc_id"), docs[lang].alias("lang"), docs[source].alias("source"), docs[text].alias("text")), carry=("doc_id", "lang", "source")))
    return judge(rows, thresholds(rows.where(~F.col("base_failed")), least=least), most=most).drop("lang", "source")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_quality(read(spark, sf_dir, "documents")).drop("n_lines", "failed")


_WORD = r"[^\x20\x09-\x0D]"
_CLEAR = {rule: value.replace(" / ", "::double / ") for rule, (value, _, _) in RULES.items()}
_SHARES = "\n".join(f"union all select lang, source, '{rule}', {value} from s where not base_failed" for rule, value in _CLEAR.items()).removeprefix("union all ")
_WIDTHS = ", ".join(f"('{rule}', {width}, {str(both).lower()})" for rule, (_, width, both) in RULES.items())
_BROKEN = " or ".join(f"(t.rule = '{rule}' and ({value} > t.most or {value} < t.least))" for rule, value in _CLEAR.items())
RULES_SQL = rf"""
with w as (select rowid_ as r, doc_id, lang, source, regexp_extract_all(t, '{_WORD}+') as ws, t, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) as ls
  from (select row_number() over () as rowid_, doc_id, lang, source, coalesce(text, '') as t from documents)),
g as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
m as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1) group by r),
s as (select doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(coalesce(length(array_to_string(ws, '')), 0) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, len(ls) as n_lines, len(ws) < {LEAST_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MOST_REPEATED} * len(ws) as base_failed
  from w left join m using (r)),
v as ({_SHARES}),
b as (select lang, source, rule, case when v > {TINY} then cast(ceil(ln(v) / {math.log(GAMMA)!r}) as bigint) else {LOWEST} end as bin, count(*) as n from v t(lang, source, rule, v) group by all),
l as (select 0 as level, lang, source, rule, bin, n from b union all select 1, lang, null, rule, bin, sum(n) from b group by lang, rule, bin union all select 2, null, null, rule, bin, sum(n) from b group by rule, bin),
c as (select *, sum(n) over (partition by level, lang, source, rule order by bin) as upto, sum(n) over (partition by level, lang, source, rule) as total from l),
q as (select level, lang, source, rule, max(total) as n, min(bin) filter (where upto > floor({LOW} * (total - 1))) as lo, min(bin) filter (where upto > floor({HIGH} * (total - 1))) as hi from c group by all),
p as (select o.lang, o.source, o.rule, case when o.n >= {GROUP_ROWS} then o.lo when x.n >= {GROUP_ROWS} then x.lo else y.lo end as lo, case when o.n >= {GROUP_ROWS} then o.hi when x.n >= {GROUP_ROWS} then x.hi else y.hi end as hi
  from q o join q x on x.level = 1 and x.rule = o.rule and x.lang is not distinct from o.lang join q y on y.level = 2 and y.rule = o.rule where o.level = 0),
f as (select lang, source, rule, case when lo > {LOWEST} then 2 * pow({GAMMA}, lo) / ({GAMMA} + 1) else 0 end as low, case when hi > {LOWEST} then 2 * pow({GAMMA}, hi) / ({GAMMA} + 1) else 0 end as high from p),
t as (select lang, source, rule, case when both_ then low - {REACH} * greatest(high - low, width) else -1 end as least, high + {REACH} * greatest(high - low, width) as most from f join (values {_WIDTHS}) k(rule, width, both_) using (rule))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from t where t.lang is not distinct from s.lang and t.source is not distinct from s.source and ({_BROKEN})) as kept from s
"""

QUERIES = {"op11_quality_rules": op11_quality_rules}
ORACLES = {"op11_quality_rules": RULES_SQL}
