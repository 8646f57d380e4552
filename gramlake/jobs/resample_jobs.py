"""Bootstraps and permutations of lineitem, and the same in SQL from the same hashes of row numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gramlake.jobs.solve_sql import least_squares
from gramlake.operators import irls, resample
from gramlake.operators.terms import Design, num
from gramlake.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _line(spark, d):
    df = table(spark, d, "lineitem")
    return df.withColumns({"returned": (F.col("l_returnflag") == "R").cast("double"), "q": F.col("l_quantity") / 10.0})


KEY = "l_orderkey * 8 + l_linenumber"
PRICE = Design(["l_extendedprice"], [num("l_quantity")])
_LINES = f"select {KEY} as k, l_suppkey as g, l_extendedprice as y, l_quantity::double as x, (l_returnflag = 'R')::double as t from lineitem"

# Odd constants of the 64-bit hash, as in operators.resample.
_STEP, _SEED, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _modulo(x: str) -> str:
    return f"(({x}) % 18446744073709551616::uhugeint)::ubigint"


def hashes(source: str, key: str, n: int, seed: int = 0) -> str:
    """A query: the rows of ``source`` times b = 1..n, with h, the 64-bit hash of ``key`` and b."""
    salted = f"select *, xor({key}::ubigint, {_modulo(f'b::uhugeint * {_STEP}::uhugeint + {seed * _SEED % 2**64}::uhugeint')}) as h1 from {source} cross join (select range + 1 as b from range({n}))"
    first = f"select *, {_modulo(f'xor(h1, h1 >> 30)::uhugeint * {_FIRST}::uhugeint')} as h2 from ({salted})"
    second = f"select *, {_modulo(f'xor(h2, h2 >> 27)::uhugeint * {_SECOND}::uhugeint')} as h3 from ({first})"
    return f"select * exclude (h1, h2, h3), xor(h3, h3 >> 31) as h from ({second})"


def weighted(source: str, key: str, n: int, kind: str = "bayesian", seed: int = 0) -> str:
    """The same with u in (0, 1) and the replicate's weight w."""
    u = f"select *, ((h >> 11)::double + 0.5) / 9007199254740992.0 as u from ({hashes(source, key, n, seed)})"
    cumulated, p = [], np.exp(-1.0)
    for i in range(20):
        cumulated.append(p + (cumulated[-1] if cumulated else 0.0))
        p /= i + 1
    w = "-ln(u)" if kind == "bayesian" else " + ".join(f"(u > {float(c)!r})::int" for c in cumulated)
    return f"select * exclude (h), {w} as w from ({u})"


#: Draws of a weighted fit of y on x: b, b0, b1; and the fit itself.
_DRAW = "r as (select b, (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) + my - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * mx as b0, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) as b1 from s cross join m)"


def _draws(n: int, kind: str = "bayesian", y: str = "y") -> str:
    lines = _LINES if y == "y" else _LINES.replace("l_extendedprice as y", f"{y} as y")
    return f"""with l as ({lines}), m as (select avg(y) as my, avg(x) as mx, regr_intercept(y, x) as a0, regr_slope(y, x) as a1 from l), c as (select k, g, y - my as y, x - mx as x from l cross join m),
s as (select b, sum(w) as sw, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy from ({weighted("c", "k", n, kind)}) group by b), {_DRAW}"""


_TABLE = " select t.term, round(t.coef, 3) as coef, round(t.se, 3) as std_err from (select any_value(a0) as a0, any_value(a1) as a1, stddev_samp(b0) as s0, stddev_samp(b1) as s1 from r cross join m), lateral (values ('Intercept', a0, s0), ('l_quantity', a1, s1)) as t(term, coef, se)"


@query("r1_bayesian_bootstrap_lineitem", _draws(250) + _TABLE)
def bayesian(spark, d):
    fit, _ = resample.bootstrap(_line(spark, d), PRICE, KEY, 250)
    return fit.table(spark, digits=3).select("term", "coef", "std_err")


@query("r2_classical_bootstrap_lineitem", _draws(250, "classical") + " select cast(b - 1 as int) as replicate, t.term, round(t.v, 3) as value from r, lateral (values ('Intercept', b0), ('l_quantity', b1)) as t(term, v)")
def classical(spark, d):
    fit, draws = resample.bootstrap(_line(spark, d), PRICE, KEY, 250, "classical")
    return resample.draws_table(spark, fit.names, draws).withColumn("value", F.round("value", 3))


@query(
    "r3_r4_block_bootstrap_lineitem",
    f"""with l as ({_LINES}), m as (select avg(y) as my, avg(x) as mx, regr_intercept(y, x) as a0, regr_slope(y, x) as a1 from l),
c as (select g, count(*)::double as n, sum(x - mx) as x, sum(y - my) as y, sum((x - mx) ** 2) as xx, sum((x - mx) * (y - my)) as xy from l cross join m group by g),
s as (select b, sum(w * n) as sw, sum(w * x) as sx, sum(w * y) as sy, sum(w * xx) as sxx, sum(w * xy) as sxy from ({weighted("c", "g", 250)}) group by b), {_DRAW}"""
    + _TABLE,
)
def block(spark, d):
    fit, _ = resample.bootstrap(_line(spark, d), PRICE, [], 250, cluster="l_suppkey")
    return fit.table(spark, digits=3).select("term", "coef", "std_err")


_JOINT = f"""with price as (select * from ({_draws(100)} select b, b0, b1 from r)), tax as (select * from ({_draws(100, y="l_tax")} select b, b0, b1 from r)),
v as (select p.b, t.term, t.v from (select price.b, price.b0, price.b1, tax.b0 as c0, tax.b1 as c1 from price join tax using (b)) p, lateral (values ('price.Intercept', b0), ('price.l_quantity', b1), ('tax.Intercept', c0), ('tax.l_quantity', c1)) as t(term, v))
select x.term as "row", y.term as col, round(covar_samp(x.v, y.v) * 1e6 / greatest(1.0, abs(covar_samp(x.v, y.v)) * 1e3), 1) as value from v x join v y using (b) group by all"""


@query("r5_joint_bootstrap_lineitem", _JOINT)
def joint(spark, d):
    df = _line(spark, d)
    tables = {n: resample.draws_table(spark, ["Intercept", "l_quantity"], resample.bootstrap(df, Design([y], [num("l_quantity")]), KEY, 100)[1]) for n, y in (("price", "l_extendedprice"), ("tax", "l_tax"))}
    v = F.col("value")
    return resample.joint_covariance(tables).withColumn("value", F.round(v * 1e6 / F.greatest(F.lit(1.0), F.abs(v) * 1e3), 1))


@query("r6_bootstrap_ratio_lineitem", f"with l as ({_LINES}) select cast(b - 1 as int) as replicate, round(sum(w * y) / sum(w * x), 6) as ratio from ({weighted('l', 'k', 100)}) group by b")
def ratio(spark, d):
    rows = _line(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    _, s = resample.replicate_sums(rows, KEY, lambda c: np.stack([c["l_extendedprice"], c["l_quantity"]], 1), 100)
    return spark.createDataFrame([(i, round(float(a / b), 6)) for i, (a, b) in enumerate(s)], "replicate int, ratio double")


@query("r7_test_from_bootstrap_lineitem", _draws(200) + ", v as (select t.term, t.v from r, lateral (values ('Intercept', b0), ('l_quantity', b1)) as t(term, v)) select term, round(quantile_cont(v, 0.025), 3) as lo, round(quantile_cont(v, 0.975), 3) as hi, round(least(1.0, 2 * least(avg((v <= 0)::int), avg((v >= 0)::int))), 6) as p from v group by term")
def tested(spark, d):
    fit, draws = resample.bootstrap(_line(spark, d), PRICE, KEY, 200)
    out = resample.test_from_draws(resample.draws_table(spark, fit.names, draws))
    return out.select("term", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), F.round("p", 6).alias("p"))


def _shuffled(n: int) -> str:
    """Rows times b = 0..n with the treatment s of permutation b: of every group as many rows as are treated, those of the least hashes; equal ones share what is left."""
    ranked = f"select *, row_number() over (partition by g, b order by h) as r, sum(t) over (partition by g, b) as m from ({hashes('l', 'k', n)})"
    tied = f"select b, x, y, m, min(r) over (partition by g, b, h) as first, count(*) over (partition by g, b, h) as ties from ({ranked})"
    return f"select 0 as b, x, y, t as s from l union all select b, x, y, greatest(0.0, least(1.0, (m - first + 1) / ties)) as s from ({tied})"


@query("r8_permutation_observed_lineitem", "select round(avg(l_extendedprice) filter (where l_returnflag = 'R') - avg(l_extendedprice) filter (where l_returnflag <> 'R'), 4) as effect from lineitem")
def observed(spark, d):
    return resample.permutation_test(_line(spark, d), "l_extendedprice", "returned", KEY, "l_suppkey", 0).select(F.round("effect", 4).alias("effect"))


@query("r8_permutation_draws_lineitem", f"with l as ({_LINES}), v as ({_shuffled(20)}) select cast(b as int) as permutation, round(regr_slope(y, s), 4) as effect from v group by b")
def permutations(spark, d):
    out = resample.permutation_test(_line(spark, d), "l_extendedprice", "returned", KEY, "l_suppkey", 20)
    return out.withColumn("effect", F.round("effect", 4))


@query("r8_permutation_refit_lineitem", f"with l as ({_LINES}), v as ({_shuffled(20)}), {least_squares('v', 'y', ['x', 's'], ['b'])} select cast(b as int) as permutation, round(b2, 4) as coef from fit")
def refits(spark, d):
    out = resample.permute_coefficient(_line(spark, d), PRICE, "returned", KEY, "l_suppkey", 20)
    return out.withColumn("coef", F.round("coef", 4))


_ROUNDS = 8
_NEWTON = ", ".join(
    f"b{i + 1} as materialized (select b0 + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) as b0, b1 + (haa * gb - hab * ga) / (haa * hbb - hab * hab) as b1 from (select any_value(b0) as b0, any_value(b1) as b1, sum(t - mu) as ga, sum((t - mu) * x) as gb, sum(mu * (1 - mu)) as haa, sum(mu * (1 - mu) * x) as hab, sum(mu * (1 - mu) * x * x) as hbb from (select l.*, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) as mu from l cross join b{i})))"
    for i in range(_ROUNDS)
)
_GLM = f"""with l as (select k, t, x / 10 as x from ({_LINES})), b0 as (select 0.0::double as b0, 0.0::double as b1), {_NEWTON}, f as (select l.*, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) as mu from l cross join b{_ROUNDS}),
s as (select b, any_value(b0) as b0, any_value(b1) as b1, sum(w * (t - mu)) as ga, sum(w * (t - mu) * x) as gb, sum(w * mu * (1 - mu)) as haa, sum(w * mu * (1 - mu) * x) as hab, sum(w * mu * (1 - mu) * x * x) as hbb from ({weighted("f", "k", 200)}) group by b),
r as (select b0 as a0, b1 as a1, b0 + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) as b0, b1 + (haa * gb - hab * ga) / (haa * hbb - hab * hab) as b1 from s)
select t.term, round(t.coef, 6) as coef, round(t.se, 6) as std_err from (select any_value(a0) as a0, any_value(a1) as a1, stddev_samp(b0) as s0, stddev_samp(b1) as s1 from r), lateral (values ('Intercept', a0, s0), ('q', a1, s1)) as t(term, coef, se)"""


@query("g8_glm_bootstrap_lineitem", _GLM)
def glm_draws(spark, d):
    df = _line(spark, d)
    fit, _ = irls.glm_bootstrap(irls.glm(df, Design(["returned"], [num("q")]), "binomial"), df, KEY, 200)
    return fit.table(spark, digits=6).select("term", "coef", "std_err")
