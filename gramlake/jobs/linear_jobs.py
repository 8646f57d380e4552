"""Designs and linear models on lineitem, and the same in SQL by closed forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gramlake.jobs.solve_sql import basis, least_squares, t_quantile, two_sided_p
from gramlake.operators import covariance, linear
from gramlake.operators.terms import Design, bs, cat, cheb, monomials, null_report, num, poly, seasonal, standardize, trend
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
    return table(spark, d, "lineitem")


PRICE = Design(["l_extendedprice"], [num("l_quantity"), num("l_discount")])

# slopes of y on two regressors, from deviations; b: slopes and the inverse of the sums
_TWO = """
with v as (select l_extendedprice as y, l_quantity as a, l_discount as b, {w} as w, * from lineitem where l_extendedprice is not null and l_quantity is not null and l_discount is not null and {w} > 0),
m as (select sum(w) as sw, count(*) as n, sum(w * y) / sum(w) as my, sum(w * a) / sum(w) as ma, sum(w * b) / sum(w) as mb from v),
c as (select v.*, y - my as dy, a - ma as da, b - mb as db, n, my, ma, mb, sw from v cross join m),
s as (select sum(w * da * da) as aa, sum(w * da * db) as ab, sum(w * db * db) as bb, sum(w * da * dy) as ay, sum(w * db * dy) as byy, sum(w * dy * dy) as yy, any_value(n) as n, any_value(my) as my, any_value(ma) as ma, any_value(mb) as mb, any_value(sw) as sw from c),
b as (select *, (bb * ay - ab * byy) / (aa * bb - ab * ab) as b1, (aa * byy - ab * ay) / (aa * bb - ab * ab) as b2, bb / (aa * bb - ab * ab) as i11, aa / (aa * bb - ab * ab) as i22, -ab / (aa * bb - ab * ab) as i12 from s),
f as (select *, my - b1 * ma - b2 * mb as b0, yy - b1 * ay - b2 * byy as ssr from b),
e as (select c.*, dy - b1 * da - b2 * db as r from c cross join b)
"""


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("a1_ols_lineitem", _TWO.format(w="1.0") + " select t.term, round(t.coef, 3) as coef, round(t.se, 3) as std_err from f, lateral (values ('Intercept', b0, sqrt(ssr / (n - 3) * (1 / sw + ma * ma * i11 + 2 * ma * mb * i12 + mb * mb * i22))), ('l_quantity', b1, sqrt(ssr / (n - 3) * i11)), ('l_discount', b2, sqrt(ssr / (n - 3) * i22))) as t(term, coef, se)")
def ols_lineitem(spark, d):
    return linear.ols(_line(spark, d), PRICE).table(spark, digits=3).select("term", "coef", "std_err")


@query("l1_wls_lineitem", _TWO.format(w="l_tax + 0.01") + " select t.term, round(t.coef, 3) as coef from f, lateral (values ('Intercept', b0), ('l_quantity', b1), ('l_discount', b2)) as t(term, coef)")
def wls_lineitem(spark, d):
    df = _line(spark, d).withColumn("wt", F.col("l_tax") + 0.01)
    return linear.ols(df, Design(PRICE.y, PRICE.x, weights="wt")).table(spark, digits=3).select("term", "coef")


def _meat(kind):
    scale = {"HC0": "1.0", "HC1": "n / (n - 3.0)"}.get(kind, "1.0")
    r = {"HC2": "r * r / (1 - h)", "HC3": "r * r / ((1 - h) * (1 - h))"}.get(kind, "r * r")
    return (
        _TWO.format(w="1.0")
        + f""", h as (select e.*, 1.0 / e.n + da * da * i11 + 2 * da * db * i12 + db * db * i22 as h from e cross join b),
k as (select sum({r} * da * da) as maa, sum({r} * da * db) as mab, sum({r} * db * db) as mbb from h)
select t.term, round(t.coef, 3) as coef, round(sqrt(t.v), 3) as std_err from (select b1, b2, {scale} * (i11 * i11 * maa + 2 * i11 * i12 * mab + i12 * i12 * mbb) as v1, {scale} * (i12 * i12 * maa + 2 * i12 * i22 * mab + i22 * i22 * mbb) as v2 from b cross join k) x, lateral (values ('l_quantity', b1, v1), ('l_discount', b2, v2)) as t(term, coef, v)"""
    )


def _hc(kind):
    @query(f"c4_{kind.lower()}_lineitem", _meat(kind))
    def robust(spark, d):
        return linear.ols(_line(spark, d), PRICE, kind).table(spark, digits=3).where("term <> 'Intercept'").select("term", "coef", "std_err")

    return robust


for _k in ("HC0", "HC1", "HC2", "HC3"):
    _hc(_k)


def flagship(spark, d):
    """Weighted least squares with dummies and HC1 errors."""
    design = Design(["l_extendedprice"], [num("l_quantity"), num("l_discount"), cat("l_returnflag")], weights="wt")
    return linear.ols(_line(spark, d).withColumn("wt", F.col("l_tax") + 0.01), design, "HC1").table(spark)


def _clustered(groups):
    sql, names = _TWO.format(w="1.0"), []
    for i, (g, sign) in enumerate(groups):
        sql += f""", s{i} as (select {g}, sum(r * da) as ga, sum(r * db) as gb, any_value(n) as n from e group by {g}),
q{i} as (select {sign} * (any_value(n) - 1) / (any_value(n) - 3) * count(*) / (count(*) - 1.0) as f, sum(ga * ga) as maa, sum(ga * gb) as mab, sum(gb * gb) as mbb from s{i})"""
        names.append(f"select f * maa as maa, f * mab as mab, f * mbb as mbb from q{i}")
    sql += ", k as (select sum(maa) as maa, sum(mab) as mab, sum(mbb) as mbb from (" + " union all ".join(names) + "))"
    return sql + " select t.term, round(t.coef, 3) as coef, round(sqrt(t.v), 3) as std_err from (select b1, b2, i11 * i11 * maa + 2 * i11 * i12 * mab + i12 * i12 * mbb as v1, i12 * i12 * maa + 2 * i12 * i22 * mab + i22 * i22 * mbb as v2 from b cross join k) x, lateral (values ('l_quantity', b1, v1), ('l_discount', b2, v2)) as t(term, coef, v)"


@query("c2_cluster_lineitem", _clustered([("l_orderkey", 1)]))
def cluster_lineitem(spark, d):
    return linear.ols(_line(spark, d), PRICE, "CLUSTER", ["l_orderkey"]).table(spark, digits=3).where("term <> 'Intercept'").select("term", "coef", "std_err")


@query("c3_two_way_cluster_lineitem", _clustered([("l_suppkey", 1), ("l_partkey", 1), ("l_suppkey, l_partkey", -1)]))
def two_way_lineitem(spark, d):
    return linear.ols(_line(spark, d), PRICE, "CLUSTER", ["l_suppkey", "l_partkey"]).table(spark, digits=3).where("term <> 'Intercept'").select("term", "coef", "std_err")


@query("c1_nonrobust_lineitem", _TWO.format(w="1.0") + " select t.term, round(sqrt(t.v), 3) as std_err from f, lateral (values ('l_quantity', ssr / n * i11), ('l_discount', ssr / n * i22)) as t(term, v)")
def nonrobust_lineitem(spark, d):
    return linear.ols(_line(spark, d), PRICE, "NONROBUST").table(spark, digits=3).where("term <> 'Intercept'").select("term", "std_err")


@query("l2_multi_outcome_lineitem", "select 'l_extendedprice' as outcome, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from lineitem union all select 'l_tax', round(regr_intercept(l_tax, l_quantity), 3), round(regr_slope(l_tax, l_quantity), 4) from lineitem")
def multi_lineitem(spark, d):
    fits = linear.multi_outcome(_line(spark, d), Design(["l_extendedprice", "l_tax"], [num("l_quantity")]))
    return _rows(spark, [(n, round(float(f.params[0]), 3) + 0.0, round(float(f.params[1]), 4) + 0.0) for n, f in zip(("l_extendedprice", "l_tax"), fits, strict=True)], "outcome string, intercept double, slope double")


@query("l3_fit_statistics_lineitem", _TWO.format(w="1.0") + " select round(1 - ssr / yy, 6) as r2, round(1 - (ssr / yy) * (n - 1) / (n - 3), 6) as r2_adj, round(((yy - ssr) / 2) / (ssr / (n - 3)), 2) as f, round(-n / 2.0 * (ln(2 * pi() / n) + 1 + ln(ssr)), 2) as llf, round(n * (ln(2 * pi() / n) + 1 + ln(ssr)) + 6, 2) as aic from f")
def statistics_lineitem(spark, d):
    s = linear.ols(_line(spark, d), PRICE).stats
    return _rows(spark, [tuple(round(float(s[k]), n) for k, n in (("r2", 6), ("r2_adj", 6), ("f", 2), ("llf", 2), ("aic", 2)))], "r2 double, r2_adj double, f double, llf double, aic double")


_ABSORB = """
with g as (select l_suppkey, avg(l_extendedprice) as my, avg(l_quantity) as ma, avg(l_discount) as mb, count(*) as n from lineitem group by 1),
c as (select l.*, l_extendedprice - my as dy, l_quantity - ma as da, l_discount - mb as db from lineitem l join g using (l_suppkey)),
s as (select count(*) as n, sum(da * da) as aa, sum(da * db) as ab, sum(db * db) as bb, sum(da * dy) as ay, sum(db * dy) as byy, sum(dy * dy) as yy from c),
b as (select *, (bb * ay - ab * byy) / (aa * bb - ab * ab) as b1, (aa * byy - ab * ay) / (aa * bb - ab * ab) as b2, bb / (aa * bb - ab * ab) as i11, aa / (aa * bb - ab * ab) as i22, -ab / (aa * bb - ab * ab) as i12 from s)
"""


@query("l4_absorb_lineitem", _ABSORB + ", x as (select *, (yy - b1 * ay - b2 * byy) / (n - 2 - (select count(*) from g)) as s2 from b) select t.term, round(t.coef, 3) as coef, round(sqrt(t.v), 3) as std_err from x, lateral (values ('l_quantity', b1, s2 * i11), ('l_discount', b2, s2 * i22)) as t(term, coef, v)")
def absorb_lineitem(spark, d):
    return linear.absorb_ols(_line(spark, d), PRICE, ["l_suppkey"]).table(spark, digits=3).select("term", "coef", "std_err")


@query("a1_ols_supplier_dummies_lineitem", _ABSORB + ", x as (select *, (yy - b1 * ay - b2 * byy) / (n - 2 - (select count(*) from g)) as s2 from b), f as (select my - b1 * ma - b2 * mb as first from g cross join b where cast(l_suppkey as varchar) = (select min(cast(l_suppkey as varchar)) from g)) select t.term, round(t.coef, 3) as coef, round(sqrt(t.v), 3) as std_err from x, lateral (values ('l_quantity', b1, s2 * i11), ('l_discount', b2, s2 * i22)) as t(term, coef, v) union all select 'Intercept', round(first, 3), null from f")
def supplier_dummies(spark, d):
    """Levels stay where they lie, however many: the constant is that of the first one by name."""
    fit, levels = linear.level_ols(_line(spark, d), "l_extendedprice", ["l_suppkey"], x=["l_quantity", "l_discount"])
    first = levels.agg(F.min_by(F.col("coef")[0], F.col("l_suppkey").cast("string"))).first()[0]
    rows = [("Intercept", round(first, 3) + 0.0, None), *((n, round(float(b), 3) + 0.0, round(float(s), 3) + 0.0) for n, b, s in zip(fit.names, fit.params, fit.bse, strict=True))]
    return _rows(spark, rows, "term string, coef double, std_err double")


@query("l4_absorb_cluster_lineitem", _ABSORB + ", e as (select c.*, dy - b1 * da - b2 * db as r from c cross join b), u as (select l_orderkey, sum(r * da) as ga, sum(r * db) as gb from e group by 1), k as (select count(*) as g, sum(ga * ga) as maa, sum(ga * gb) as mab, sum(gb * gb) as mbb from u), x as (select *, (n - 1.0) / (n - 2 - (select count(*) from g)) * k.g / (k.g - 1.0) as f from b cross join k) select t.term, round(sqrt(t.v), 3) as std_err from x, lateral (values ('l_quantity', f * (i11 * i11 * maa + 2 * i11 * i12 * mab + i12 * i12 * mbb)), ('l_discount', f * (i12 * i12 * maa + 2 * i12 * i22 * mab + i22 * i22 * mbb))) as t(term, v)")
def absorb_cluster_lineitem(spark, d):
    return linear.absorb_ols(_line(spark, d), PRICE, ["l_suppkey"], cluster=["l_orderkey"]).table(spark, digits=3).select("term", "std_err")


def _absorb_clustered(groups):
    sql, names = _ABSORB + ", e as (select c.*, dy - b1 * da - b2 * db as r from c cross join b)", []
    for i, (g, sign) in enumerate(groups):
        sql += f", u{i} as (select {g}, sum(r * da) as ga, sum(r * db) as gb from e group by all), k{i} as (select {sign} * (select (n - 1.0) / (n - 2 - (select count(*) from g)) from b) * count(*) / (count(*) - 1.0) as f, sum(ga * ga) as maa, sum(ga * gb) as mab, sum(gb * gb) as mbb from u{i})"
        names.append(f"select f * maa as maa, f * mab as mab, f * mbb as mbb from k{i}")
    return sql + ", k as (select sum(maa) as maa, sum(mab) as mab, sum(mbb) as mbb from (" + " union all ".join(names) + ")) select t.term, round(sqrt(t.v), 3) as std_err from b cross join k, lateral (values ('l_quantity', i11 * i11 * maa + 2 * i11 * i12 * mab + i12 * i12 * mbb), ('l_discount', i12 * i12 * maa + 2 * i12 * i22 * mab + i22 * i22 * mbb)) as t(term, v)"


@query("l4_absorb_two_way_cluster_lineitem", _absorb_clustered([("l_orderkey", 1), ("l_partkey", 1), ("l_orderkey, l_partkey", -1)]))
def absorb_two_way_lineitem(spark, d):
    return linear.absorb_ols(_line(spark, d), PRICE, ["l_suppkey"], cluster=["l_orderkey", "l_partkey"]).table(spark, digits=3).select("term", "std_err")


@query(
    "p7_wide_slopes_lineitem",
    """with g as (select l_suppkey, count(*) as n, avg(l_quantity) as mx, avg(l_extendedprice) as my, var_pop(l_quantity) * count(*) as xx, covar_pop(l_quantity, l_extendedprice) * count(*) as xy, var_pop(l_extendedprice) * count(*) as yy from lineitem group by 1),
s as (select sum(yy - xy * xy / xx) / (sum(n) - 2 * count(*)) as s2 from g)
select l_suppkey, n, round(my - xy / xx * mx, 3) as level, round(xy / xx, 4) as slope, round(sqrt(s2 * (1.0 / n + mx * mx / xx)), 3) as level_se, round(sqrt(s2 / xx), 4) as slope_se from g cross join s""",
)
def wide_slopes(spark, d):
    _, levels = linear.level_ols(_line(spark, d), "l_extendedprice", ["l_suppkey"], slopes=["l_quantity"])
    return levels.select("l_suppkey", "n", *[F.round(F.col(c)[i], 3 + i).alias(f"{name}{end}") for c, end in (("coef", ""), ("std_err", "_se")) for i, name in enumerate(("level", "slope"))])


@query(
    "p6_wide_dummies_lineitem",
    """with g as (select l_partkey, count(*) as n, avg(l_quantity) as mx, avg(l_extendedprice) as my from lineitem group by 1),
c as (select l_quantity - mx as x, l_extendedprice - my as y from lineitem join g using (l_partkey)), b as (select sum(x * y) / sum(x * x) as b, sum(x * x) as xx, sum(y * y) - sum(x * y) ** 2 / sum(x * x) as ssr, count(*) - 1 - (select count(*) from g) as free from c)
select l_partkey, g.n, round(my - b * mx, 3) as level, round(sqrt(ssr / free * (1.0 / g.n + mx * mx / xx)), 3) as level_se, round(b, 4) as slope, round(sqrt(ssr / free / xx), 5) as slope_se from g cross join b""",
)
def wide_dummies(spark, d):
    fit, levels = linear.level_ols(_line(spark, d), "l_extendedprice", ["l_partkey"], x=["l_quantity"])
    return levels.select("l_partkey", "n", F.round(F.col("coef")[0], 3).alias("level"), F.round(F.col("std_err")[0], 3).alias("level_se"), F.lit(round(float(fit.params[0]), 4)).alias("slope"), F.lit(round(float(fit.bse[0]), 5)).alias("slope_se"))


_OTHER = ["x", "f1", "f2", "o1"]
_TWO_TERMS = f"""with l as (select l_partkey as g, l_extendedprice::double as y, l_quantity::double as x, (l_returnflag = 'N')::double as f1, (l_returnflag = 'R')::double as f2, (l_linestatus = 'O')::double as o1 from lineitem),
g as (select g, count(*) as n, avg(y) as y, {", ".join(f"avg({c}) as {c}" for c in _OTHER)} from l group by g), c as (select l.g, l.y - g.y as y, {", ".join(f"l.{c} - g.{c} as {c}" for c in _OTHER)} from l join g using (g)),
{least_squares("c", "y", _OTHER, intercept=False)}, k as (select *, count(*) over () as groups from g)
select g as l_partkey, n, round(y - {" - ".join(f"b{i} * {c}" for i, c in enumerate(_OTHER))}, 3) as level, round(b0, 4) as slope, round(b1, 3) as flag_n, round(s0 * sqrt((fit_n - 4.0) / (fit_n - 4 - groups)), 5) as slope_se from k cross join (select n as fit_n, * exclude (n) from fit)"""


@query("p6_two_wide_terms_lineitem", _TWO_TERMS)
def two_terms(spark, d):
    fit, levels = linear.level_ols(_line(spark, d), "l_extendedprice", ["l_partkey"], x=["l_quantity"], also=["l_returnflag", "l_linestatus"])
    b = dict(zip(fit.names, fit.params, strict=True))
    return levels.select("l_partkey", "n", F.round(F.col("coef")[0], 3).alias("level"), F.lit(round(float(b["l_quantity"]), 4)).alias("slope"), F.lit(round(float(b["C(l_returnflag)[N]"]), 3)).alias("flag_n"), F.lit(round(float(fit.bse[0]), 5)).alias("slope_se"))


@query("j3_absorbed_effects_lineitem", _ABSORB + " select l_suppkey, g.n, round(my - b1 * ma - b2 * mb, 2) as effect from g cross join b")
def effects_lineitem(spark, d):
    df = _line(spark, d)
    fit = linear.absorb_ols(df, PRICE, ["l_suppkey"])
    return linear.absorbed_effects(df, PRICE, ["l_suppkey"], fit).withColumn("effect", F.round("effect", 2))


@query("j2_absorb_rows_lineitem", "with g as (select l_suppkey, avg(l_extendedprice) as my, avg(l_quantity) as ma from lineitem group by 1) select l_orderkey, l_linenumber, l_suppkey, round(l_extendedprice - my, 2) as y, round(l_quantity - ma, 4) as x from lineitem join g using (l_suppkey)")
def demean_lineitem(spark, d):
    out = linear.demean(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")]), ["l_suppkey"], keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", F.round("y0", 2).alias("y"), F.round("x0", 4).alias("x"))


@query("l5_iv_2sls_lineitem", "with m as (select avg(l_extendedprice) as my, avg(l_quantity) as mx, avg(l_partkey) as mz from lineitem) select 'l_quantity' as term, round(sum((l_partkey - mz) * (l_extendedprice - my)) / sum((l_partkey - mz) * (l_quantity - mx)), 2) as coef from lineitem cross join m")
def iv_lineitem(spark, d):
    design = Design(["l_extendedprice"], [num("l_quantity")], instruments=[num("l_partkey")])
    return linear.iv_2sls(_line(spark, d), design).table(spark, digits=2).where("term <> 'Intercept'").select("term", "coef")


@query(
    "l5_iv_absorb_lineitem",
    """with g as (select l_suppkey, avg(l_extendedprice) as my, avg(l_quantity) as mx, avg(l_partkey) as mz from lineitem group by 1),
c as (select l_extendedprice - my as y, l_quantity - mx as x, l_partkey - mz as z from lineitem join g using (l_suppkey)),
s as (select sum(z * y) / sum(z * x) as b, sum(z * z) / (sum(z * x) ** 2) as v, count(*) - 1 - (select count(*) from g) as free from c)
select 'l_quantity' as term, round(any_value(b), 2) as coef, round(sqrt(sum((y - b * x) ** 2) / any_value(free) * any_value(v)), 2) as std_err from c cross join s""",
)
def iv_absorb_lineitem(spark, d):
    design = Design(["l_extendedprice"], [num("l_quantity")], instruments=[num("l_partkey")])
    return linear.iv_absorb(_line(spark, d), design, ["l_suppkey"]).table(spark, digits=2).select("term", "coef", "std_err")


@query("l6_first_stage_lineitem", "select 'l_quantity' as term, round(regr_r2(l_quantity, l_partkey), 8) as r2, round(regr_r2(l_quantity, l_partkey) / (1 - regr_r2(l_quantity, l_partkey)) * (count(*) - 2), 4) as f from lineitem")
def first_stage_lineitem(spark, d):
    s = linear.iv_2sls(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")], instruments=[num("l_partkey")])).stats["first_stage"]
    return _rows(spark, [(k, round(float(v["r2"]), 8), round(float(v["f"]), 4)) for k, v in s.items()], "term string, r2 double, f double")


@query("c7_iv_hc1_lineitem", "with m as (select count(*) as n, avg(l_extendedprice) as my, avg(l_quantity) as mx, avg(l_partkey) as mz from lineitem), c as (select l_extendedprice - my as y, l_quantity - mx as x, l_partkey - mz as z, n from lineitem cross join m), s as (select sum(z * y) / sum(z * x) as b, sum(z * x) as zx, any_value(n) as n from c) select 'l_quantity' as term, round(sqrt(any_value(s.n) / (any_value(s.n) - 2.0) * sum(z * z * (y - b * x) * (y - b * x))) / abs(any_value(zx)), 2) as std_err from c cross join s")
def iv_hc_lineitem(spark, d):
    design = Design(["l_extendedprice"], [num("l_quantity")], instruments=[num("l_partkey")])
    return linear.iv_2sls(_line(spark, d), design, "HC1").table(spark, digits=2).where("term <> 'Intercept'").select("term", "std_err")


@query("l7_ridge_lineitem", "with m as (select avg(l_extendedprice) as my, avg(l_quantity) as mx from lineitem), s as (select sum((l_quantity - mx) * (l_extendedprice - my)) as xy, sum((l_quantity - mx) * (l_quantity - mx)) as xx from lineitem cross join m) select 'l_quantity' as term, round(xy / (xx + 1000.0), 4) as coef from s")
def ridge_lineitem(spark, d):
    return linear.ridge(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")]), 1000.0).table(spark, digits=4).where("term <> 'Intercept'").select("term", "coef")


@query("l11_lm_fast_lineitem", "select round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from lineitem")
def fast_lineitem(spark, d):
    b = linear.lm_fast(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")]))
    return _rows(spark, [(round(float(b[0]), 3), round(float(b[1]), 4))], "intercept double, slope double")


@query("l12_fit_many_lineitem", "select l_suppkey, count(*) as n, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_slope(l_extendedprice, l_quantity), 3) as slope from lineitem group by 1 having count(*) > 2")
def many_lineitem(spark, d):
    out = linear.fit_many(_line(spark, d), ["l_suppkey"], "l_extendedprice", ["l_quantity"]).where("n > 2")
    return out.select("l_suppkey", "n", F.round("r2", 6).alias("r2"), F.round(F.col("coef")[0], 2).alias("intercept"), F.round(F.col("coef")[1], 3).alias("slope"))


@query("l13_shapley_lineitem", _TWO.format(w="1.0") + ", p as (select ay * ay / (aa * yy) as r1, byy * byy / (bb * yy) as r2, 1 - ssr / yy as r12 from f) select t.term, round(v, 6) as value from p, lateral (values ('l_quantity', (r1 + r12 - r2) / 2), ('l_discount', (r2 + r12 - r1) / 2)) as t(term, v)")
def shapley_lineitem(spark, d):
    return linear.shapley_r2(_line(spark, d), "l_extendedprice", ["l_quantity", "l_discount"]).select("term", F.round("value", 6).alias("value"))


@query("l14_ssr_at_lineitem", "select cast(i as bigint) as i, round(sum((l_extendedprice - 1000.0 * i * l_quantity) * (l_extendedprice - 1000.0 * i * l_quantity)) / 1e9, 3) as ssr from lineitem cross join range(5) t(i) group by 1")
def ssr_lineitem(spark, d):
    df = _line(spark, d)
    plan = Design(["l_extendedprice"], [num("l_quantity")], intercept=False).fit(df)
    g = linear.gram(plan.rows(df), plan)
    betas = spark.range(5).select(F.col("id").alias("i"), F.array(F.col("id") * 1000.0).alias("beta"))
    return linear.ssr_at(g, betas).select("i", F.round(F.col("ssr") / 1e9, 3).alias("ssr"))


@query(
    "l8_fgls_lineitem",
    """with v as (select l_extendedprice as y, l_quantity as x from lineitem), b as (select regr_slope(y, x) as b1, regr_intercept(y, x) as b0 from v),
e as (select y, x, ln(greatest((y - b0 - b1 * x) ** 2, 1e-300)) as z from v cross join b), g as (select regr_slope(z, x) as g1, regr_intercept(z, x) as g0 from e),
w as (select y, x, exp(-0.5 * (g0 + g1 * x)) as w from e cross join g), m as (select sum(w * y) / sum(w) as my, sum(w * x) / sum(w) as mx from w)
select 'l_quantity' as term, round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)), 3) as coef from w cross join m""",
)
def fgls_lineitem(spark, d):
    return linear.fgls(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")])).table(spark, digits=3).where("term = 'l_quantity'").select("term", "coef")


@query("l10_sure_lineitem", "select 'a.l_quantity' as term, round(regr_slope(l_extendedprice, l_quantity), 3) as coef from lineitem union all select 'b.l_discount', round(regr_slope(l_tax, l_discount), 3) from lineitem")
def sure_lineitem(spark, d):
    fit = linear.sure(_line(spark, d), {"a": Design(["l_extendedprice"], [num("l_quantity")]), "b": Design(["l_tax"], [num("l_discount")])}, "l_suppkey")
    return fit.table(spark, digits=3).where("term in ('a.l_quantity', 'b.l_discount')").select("term", "coef")


@query("a2_gram_by_lineitem", "select l_returnflag, count(*) as n, round(sum(l_quantity * l_quantity), 2) as xx, round(sum(l_quantity * l_extendedprice) / 1e6, 4) as xy from lineitem group by 1")
def gram_by_lineitem(spark, d):
    from gramlake.operators.rows import sum_rows_by

    df = _line(spark, d)
    plan = Design(["l_extendedprice"], [num("l_quantity")], intercept=False).fit(df)

    def kernel(c):
        x, y = plan.matrix(c)[:, 0], plan.outcomes(c)[:, 0]
        return np.stack([np.ones(len(x)), x * x, x * y], 1)

    v = sum_rows_by(plan.rows(df, keep=["l_returnflag"]), ["l_returnflag"], kernel, 3)
    return v.select("l_returnflag", F.col("v")[0].cast("long").alias("n"), F.round(F.col("v")[1], 2).alias("xx"), F.round(F.col("v")[2] / 1e6, 4).alias("xy"))


@query("p1_valid_rows_customer", "select count(*) as n from (select nullif(o_totalprice, -1) as y, c_acctbal from customer left join orders on c_custkey = o_custkey) where y is not null")
def valid_rows(spark, d):
    df = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return df.where(Design(["o_totalprice"], [num("c_acctbal")]).valid(df)).agg(F.count("*").alias("n"))


@query("p2_null_report_customer", "select count(*) as n_rows, cast(count(*) filter (where o_totalprice is null) as bigint) as invalid_y, cast(0 as bigint) as invalid_x, cast(count(*) filter (where c_acctbal <= 0) as bigint) as invalid_weights, cast(count(*) filter (where o_totalprice is null or c_acctbal <= 0) as bigint) as invalid_any from customer left join orders on c_custkey = o_custkey")
def nulls(spark, d):
    df = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return null_report(df, Design(["o_totalprice"], [num("c_nationkey")], weights="c_acctbal")).drop("invalid_instruments")


def _design_rows(spark, d, terms, digits=6, key=("l_orderkey", "l_linenumber")):
    df = _line(spark, d)
    plan = Design([], terms, intercept=False).fit(df)
    out = plan.rows(df, keep=list(key))
    values = [c for c in out.columns if c.startswith("x")]
    return out.select(*key, *[F.round(c, digits).alias(f"v{i}") for i, c in enumerate(values)])


@query("p4_poly_lineitem", "select l_orderkey, l_linenumber, round(l_quantity, 6) as v0, round(l_quantity ** 2, 6) as v1, round(l_quantity ** 3, 6) as v2 from lineitem")
def poly_rows(spark, d):
    return _design_rows(spark, d, [poly("l_quantity", 3)])


@query("p5_cheb_lineitem", "with m as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem), z as (select *, (2 * l_quantity - lo - hi) / (hi - lo) as z from lineitem cross join m) select l_orderkey, l_linenumber, round(z, 6) as v0, round(2 * z * z - 1, 6) as v1, round(4 * z * z * z - 3 * z, 6) as v2 from z")
def cheb_rows(spark, d):
    return _design_rows(spark, d, [cheb("l_quantity", 3)])


@query("p5_monomials_lineitem", "select l_orderkey, l_linenumber, round(l_quantity, 6) as v0, round(l_tax, 6) as v1, round(l_quantity * l_quantity, 6) as v2, round(l_quantity * l_tax, 6) as v3, round(l_tax * l_tax, 6) as v4 from lineitem")
def monomial_rows(spark, d):
    return _design_rows(spark, d, [monomials("l_quantity", "l_tax", 2)])


@query("p8_standardize_lineitem", "select l_orderkey, l_linenumber, round((l_quantity - (select avg(l_quantity) from lineitem)) / (select stddev_pop(l_quantity) from lineitem), 6) as v0 from lineitem")
def standardized_rows(spark, d):
    return _design_rows(spark, d, [standardize("l_quantity")])


@query("p6_dummies_lineitem", "select count(*) as n, round(avg(l_extendedprice) filter (where l_returnflag = 'A'), 3) as base from lineitem")
def dummies(spark, d):
    df = _line(spark, d)
    fit = linear.ols(df, Design(["l_extendedprice"], [cat("l_returnflag")]))
    return _rows(spark, [(int(fit.stats["n"]), round(float(fit.params[0]), 3))], "n long, base double")


@query("p7_interactions_lineitem", "select l_returnflag, l_linestatus, round(avg(l_extendedprice), 3) as mean from lineitem group by 1, 2")
def crossed(spark, d):
    df = _line(spark, d)
    plan = Design(["l_extendedprice"], [cat("l_returnflag", "l_linestatus")], intercept=False).fit(df)
    g = linear.gram(plan.rows(df), plan)
    b, _ = linear.solve_scaled(g.xx, g.xy[:, 0])
    (_, levels, _), = [p for p in plan._parts("x")]
    return _rows(spark, [(*lv, round(float(v), 3)) for lv, v in zip(levels, b, strict=True)], "l_returnflag string, l_linestatus string, mean double")


@query("p7_slopes_by_group_lineitem", "select l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 3) as slope from lineitem group by 1")
def slopes(spark, d):
    df = _line(spark, d)
    plan = Design(["l_extendedprice"], [num("l_quantity") * cat("l_returnflag")], intercept=False).fit(df)
    g = linear.gram(plan.rows(df), plan)
    b, _ = linear.solve_scaled(g.xx, g.xy[:, 0])
    (_, levels, _), = [p for p in plan._parts("x")]
    return _rows(spark, [(lv[0], round(float(v), 3)) for lv, v in zip(levels, b, strict=True)], "l_returnflag string, slope double")


_KNOTS = ["(q0 - 1e-6)"] * 4 + ["q1", "q2"] + ["(q3 + 1e-6)"] * 4


@query("p9_bspline_lineitem", "with q as (select min(l_quantity) as q0, quantile_cont(l_quantity, 1 / 3.0) as q1, quantile_cont(l_quantity, 2 / 3.0) as q2, max(l_quantity) as q3 from lineitem) select l_orderkey, l_linenumber, " + ", ".join(f"round({b}, 6) as v{i}" for i, b in enumerate(basis("l_quantity", _KNOTS, 3)[1:])) + " from lineitem cross join q")
def bspline_rows(spark, d):
    return _design_rows(spark, d, [bs("l_quantity", 5)])


@query("p10_trend_seasonal_events", "with e as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as t from events) select event_id, cast(t as double) as v0, cast(pow(t, 2) as double) as v1, cast((t % 4 = 1) as double) as v2, cast((t % 4 = 2) as double) as v3, cast((t % 4 = 3) as double) as v4 from e")
def time_terms(spark, d):
    from gramlake.operators.windows import time_index

    df = time_index(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "t")
    plan = Design([], [trend("t", [1, 2]), seasonal("t", [2, 4])], intercept=False).fit(df)
    out = plan.rows(df, keep=["event_id"])
    return out.select("event_id", *[F.col(c).alias(f"v{i}") for i, c in enumerate(c for c in out.columns if c.startswith("x"))])


@query("p11_constant_columns_lineitem", "select 'k' as column_name, true as is_constant union all select 'l_quantity', false union all select 'z', true")
def constants(spark, d):
    from gramlake.operators.terms import expr

    df = _line(spark, d)
    plan = Design([], [expr("5.0", "k"), num("l_quantity"), expr("0.0", "z")], intercept=False).fit(df)
    g = linear.gram(plan.rows(df), Design([], plan.design.x).fit(df))
    sd = np.sqrt(np.clip(np.diag(g.xx)[1:] / g.n - (g.xx[0, 1:] / g.n) ** 2, 0, None))
    return _rows(spark, [(n, bool(s < 1e-6)) for n, s in zip(plan.names, sd, strict=True)], "column_name string, is_constant boolean")


@query("p12_p13_design_matrix_lineitem", "select l_orderkey, l_linenumber, round(l_extendedprice, 2) as y, 1.0::double as f0, cast(l_quantity as double) as f1, cast(l_returnflag = 'N' as double) as f2, cast(l_returnflag = 'R' as double) as f3 from lineitem")
def design_matrix(spark, d):
    df = _line(spark, d)
    plan = Design(["l_extendedprice"], [num("l_quantity"), cat("l_returnflag")]).fit(df)
    rows = plan.rows(df, keep=["l_orderkey", "l_linenumber"])
    one_hot = [(F.col("x1_l") == i).cast("double") for i in range(1, len(plan.blocks["x"][1][1]))]
    return rows.select("l_orderkey", "l_linenumber", F.round("y0", 2).alias("y"), *[c.alias(f"f{i}") for i, c in enumerate([F.lit(1.0), F.col("x0_0"), *one_hot])])


@query("h6_h7_predict_lineitem", _TWO.format(w="1.0") + " select l_orderkey, l_linenumber, round(b0 + b1 * l_quantity + b2 * l_discount, 2) as fitted, round(l_extendedprice - b0 - b1 * l_quantity - b2 * l_discount, 2) as residual from lineitem cross join f")
def predictions(spark, d):
    df = _line(spark, d)
    fit = linear.ols(df, PRICE)
    out = fit.plan.predictions(df, fit.params)
    return out.select("l_orderkey", "l_linenumber", F.round("fitted", 2).alias("fitted"), F.round(F.col("l_extendedprice") - F.col("fitted"), 2).alias("residual"))


@query("h1_wald_lineitem", _TWO.format(w="1.0") + " select round(((yy - ssr) / 2) / (ssr / (n - 3)), 2) as statistic from f")
def wald_lineitem(spark, d):
    w = linear.wald(linear.ols(_line(spark, d), PRICE), np.array([[0, 1, 0], [0, 0, 1.0]]))
    return _rows(spark, [(round(w["statistic"], 2),)], "statistic double")


@query("h2_delta_method_lineitem", _TWO.format(w="1.0") + " select round(b1 / b2, 5) as value, round(sqrt(ssr / (n - 3) * (i11 / (b2 * b2) + b1 * b1 * i22 / (b2 * b2 * b2 * b2) - 2 * b1 * i12 / (b2 * b2 * b2))), 4) as std_err from f")
def delta_lineitem(spark, d):
    r = linear.delta_method(linear.ols(_line(spark, d), PRICE), lambda b: b[1] / b[2])
    return _rows(spark, [(round(r["value"], 5), round(r["std_err"], 4))], "value double, std_err double")


_TABLE = _TWO.format(w="1.0") + ", s2 as (select *, ssr / (n - 3) as s2, ma * i11 + mb * i12 as ra, ma * i12 + mb * i22 as rb from f), se as (select *, s2 * (1 / sw + ma * ra + mb * rb) as v0, -s2 * ra as c01 from s2)"
_TABLE_T = _TABLE + f", tt as (select t.term, t.coef, sqrt(t.v) as std_err, t.coef / sqrt(t.v) as t, n - 3.0 as free from se, lateral (values ('Intercept', b0, v0), ('l_quantity', b1, s2 * i11), ('l_discount', b2, s2 * i22)) as t(term, coef, v)), pp as (select *, {two_sided_p('t', 'free')} as p, {t_quantile('free')} as q from tt)"


@query("h4_fieller_lineitem", _TABLE + f", a as (select b0, b1, {t_quantile('(n - 3.0)')} as t, v0, s2 * i11 as v1, c01 from se), k as (select *, b0 * b0 - t * t * v0 as aa, b1 * b0 - t * t * c01 as bb, b1 * b1 - t * t * v1 as cc from a) select round(b1 / b0, 6) as ratio, round((bb - sqrt(bb * bb - aa * cc)) / aa, 6) as lo, round((bb + sqrt(bb * bb - aa * cc)) / aa, 6) as hi from k")
def fieller_lineitem(spark, d):
    r = linear.fieller(linear.ols(_line(spark, d), PRICE), 1, 0)
    return _rows(spark, [tuple(round(float(r[k]), 6) for k in ("ratio", "lo", "hi"))], "ratio double, lo double, hi double")


@query("h5_conf_int_lineitem", _TABLE_T + " select term, " + ", ".join(f"round({c}, 3) as {c}" for c in ("coef", "std_err", "t", "p")) + ", round(coef - q * std_err, 3) as ci_lo, round(coef + q * std_err, 3) as ci_hi from pp")
def intervals_lineitem(spark, d):
    return linear.ols(_line(spark, d), PRICE).table(spark, digits=3)


@query("c6_hac_panel_events", """
with v as (select user_id, ts, event_id, value as y, cast(event_id % 7 as double) as x from events where value is not null), m as (select avg(y) as my, avg(x) as mx, count(*) as n from v),
b as (select sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) as b, sum((x - mx) * (x - mx)) as xx, any_value(my) as my, any_value(mx) as mx from v cross join m),
s as (select user_id, ts, event_id, (x - mx) * ((y - my) - b * (x - mx)) as s from v cross join b), l as (select *, lag(s) over w as s1, lag(s, 2) over w as s2 from s window w as (partition by user_id order by ts, event_id))
select 'x' as term, round(sqrt(sum(s * s + 2 * 2 / 3.0 * coalesce(s * s1, 0) + 2 * 1 / 3.0 * coalesce(s * s2, 0))) / (select xx from b), 6) as std_err from l""")
def hac_events(spark, d):
    df = table(spark, d, "events").select("user_id", "ts", "event_id", "value", (F.col("event_id") % 7).cast("double").alias("x"))
    fit = linear.ols(df, Design(["value"], [num("x")]))
    cov = covariance.hac_panel(df, fit, ["user_id"], ["ts", "event_id"], ["x"], "value", lags=2)
    return _rows(spark, [("x", round(float(np.sqrt(cov[1, 1])), 6))], "term string, std_err double")
