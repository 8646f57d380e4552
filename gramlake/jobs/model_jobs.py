"""Iterative models, resampling, series, smoothers, draws and streams over the given tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from gramlake.jobs.solve_sql import ROBUST_SUMS, least_squares, newton, quantile_line, robust
from gramlake.operators import draws as D
from gramlake.operators import effects, irls, linear, mle, moments_fits, penalized, series, smooth
from gramlake.operators.state import folder
from gramlake.operators.terms import Design, num
from gramlake.sources.tables import table
from gramlake.streaming import fits as streams

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _out(spark, rows, schema):
    """Numbers rounded to what both sides agree on."""
    return spark.createDataFrame([tuple(round(float(v), 4) + 0.0 if isinstance(v, (float, np.floating)) else v for v in r) for r in rows], schema)


def _line(spark, d):
    df = table(spark, d, "lineitem")
    return df.withColumns({"returned": (F.col("l_returnflag") == "R").cast("double"), "q": F.col("l_quantity") / 10.0})


def _orders_per_customer(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") / 1000.0).alias("bal"), F.coalesce("n", F.lit(0)).cast("double").alias("n"))


_NEWTON = """b{i} as (select b0 + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) as b0, b1 + (haa * gb - hab * ga) / (haa * hbb - hab * hab) as b1 from (select any_value(b0) as b0, any_value(b1) as b1, sum(y - mu) as ga, sum((y - mu) * x) as gb, sum(v) as haa, sum(v * x) as hab, sum(v * x * x) as hbb from (select *, {v} as v from (select y, x, b0, b1, {mu} as mu from d cross join b{j}))))"""


def _steps(source, start, mu, v, rounds=8):
    """Unrolled Newton steps as a chain of CTEs, then f: every row with the converged mu and v."""
    return f"with d as ({source}), b0 as ({start}), " + ", ".join(_NEWTON.format(i=i + 1, j=i, mu=mu, v=v) for i in range(rounds)) + f", f as (select *, {v} as v from (select d.*, b0, b1, {mu} as mu from d cross join b{rounds}))"


def _newton(source, start, mu, v, rounds=8):
    return _steps(source, start, mu, v, rounds) + f" select t.term, round(t.coef, 4) as coef from b{rounds}, lateral (values ('Intercept', b0), ('x', b1)) as t(term, coef)"


_LOGIT = "1 / (1 + exp(-(b0 + b1 * x)))"


@query("g1_logit_lineitem", _newton("select cast(l_returnflag = 'R' as double) as y, l_quantity / 10.0 as x from lineitem", "select 0.0::double as b0, 0.0::double as b1", _LOGIT, "mu * (1 - mu)"))
def logit(spark, d):
    fit = irls.glm(_line(spark, d), Design(["returned"], [num("q")]), "binomial")
    return _out(spark, zip(["Intercept", "x"], fit.params, strict=True), "term string, coef double")


_COUNTS = "select coalesce(n, 0)::double as y, c_acctbal / 1000.0 as x from customer left join (select o_custkey, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1) on c_custkey = o_custkey"


@query("g1_poisson_customer", _newton(_COUNTS, f"select ln(avg(y)) as b0, 0.0::double as b1 from ({_COUNTS})", "exp(b0 + b1 * x)", "mu"))
def poisson(spark, d):
    fit = irls.glm(_orders_per_customer(spark, d), Design(["n"], [num("bal")]), "poisson")
    return _out(spark, zip(["Intercept", "x"], fit.params, strict=True), "term string, coef double")


@query("d1_poisson_mle_customer", _newton(_COUNTS, f"select ln(avg(y)) as b0, 0.0::double as b1 from ({_COUNTS})", "exp(b0 + b1 * x)", "mu"))
def poisson_mle(spark, d):
    fit = mle.fit_mle(_orders_per_customer(spark, d), Design(["n"], [num("bal")]), "poisson")
    return _out(spark, zip(["Intercept", "x"], fit.params, strict=True), "term string, coef double")


@query("g1_gaussian_identity_lineitem", "select 'Intercept' as term, round(regr_intercept(l_extendedprice, l_quantity / 10.0), 4) as coef from lineitem union all select 'q', round(regr_slope(l_extendedprice, l_quantity / 10.0), 4) from lineitem")
def gaussian(spark, d):
    fit = irls.glm(_line(spark, d), Design(["l_extendedprice"], [num("q")]), "gaussian")
    return _out(spark, zip(fit.names, fit.params, strict=True), "term string, coef double")


_LOGIT_ROWS = _steps("select cast(l_returnflag = 'R' as double) as y, l_quantity / 10.0 as x, l_orderkey, l_linenumber from lineitem", "select 0.0::double as b0, 0.0::double as b1", _LOGIT, "mu * (1 - mu)")


@query("g2_glm_statistics_lineitem", _LOGIT_ROWS + ", s as (select sum(y * ln(mu) + (1 - y) * ln(1 - mu)) as llf, sum((y - mu) * (y - mu) / v) as chi, avg(y) as p, count(*) as n from f), z as (select *, n * (p * ln(p) + (1 - p) * ln(1 - p)) as llf0 from s) select t.name, round(t.value, 4) as value from z, lateral (values ('deviance', -2 * llf), ('pearson_chi2', chi), ('llf', llf), ('llf_null', llf0), ('pseudo_r2', 1 - llf / llf0)) as t(name, value)")
def glm_stats(spark, d):
    s = irls.glm(_line(spark, d), Design(["returned"], [num("q")]), "binomial").stats
    return _out(spark, [(k, float(s[k])) for k in ("deviance", "pearson_chi2", "llf", "llf_null", "pseudo_r2")], "name string, value double")


@query("g3_glm_hc1_lineitem", _LOGIT_ROWS + ", s as (select count(*) as n, sum(v) as haa, sum(v * x) as hab, sum(v * x * x) as hbb, sum((y - mu) ** 2) as maa, sum((y - mu) ** 2 * x) as mab, sum((y - mu) ** 2 * x * x) as mbb from f), i as (select *, hbb / (haa * hbb - hab * hab) as iaa, -hab / (haa * hbb - hab * hab) as iab, haa / (haa * hbb - hab * hab) as ibb from s) select t.term, round(sqrt(n / (n - 2.0) * t.v), 6) as std_err from i, lateral (values ('Intercept', iaa * iaa * maa + 2 * iaa * iab * mab + iab * iab * mbb), ('q', iab * iab * maa + 2 * iab * ibb * mab + ibb * ibb * mbb)) as t(term, v)")
def glm_hc1(spark, d):
    return irls.glm(_line(spark, d), Design(["returned"], [num("q")]), "binomial", cov_type="HC1").table(spark, digits=6).select("term", "std_err")


_GAMMA = "with d as (select o_totalprice as y, (o_custkey % 10) / 10.0 as x from orders), " + newton("d", ["x"], ["(select ln(avg(y)) from d)", "0.0::double"], "exp(eta)", "(y - mu) / mu", "1.0")


@query("g1_gamma_log_orders", _GAMMA + ", e as (select x, y / exp(b0 + b1 * x) - 1 as r from d cross join n10), q as (select count(*) as n, sum(r * r) / (count(*) - 2) as phi, avg(x) as mx, var_pop(x) * count(*) as xx from e) select t.term, round(t.coef, 6) as coef, round(t.se, 6) as std_err from q cross join n10, lateral (values ('Intercept', b0, sqrt(phi * (1.0 / n + mx * mx / xx))), ('x', b1, sqrt(phi / xx))) as t(term, coef, se)")
def gamma_log(spark, d):
    df = table(spark, d, "orders").withColumn("x", (F.col("o_custkey") % 10) / 10.0)
    return irls.glm(df, Design(["o_totalprice"], [num("x")]), "gamma", "log").table(spark, digits=6).select("term", "coef", "std_err")


@query("g4_glm_elastic_net_lineitem")
def glm_net(spark, d):
    return irls.glm(_line(spark, d), Design(["returned"], [num("q"), num("l_discount")]), "binomial", penalty=(0.01, 0.5)).table(spark)


@query("g5_residual_inclusion_lineitem", "with f as (select regr_slope(l_quantity / 10.0, l_partkey) as a1, regr_intercept(l_quantity / 10.0, l_partkey) as a0 from lineitem), d as (select cast(l_returnflag = 'R' as double) as y, a0 + a1 * l_partkey as h, l_quantity / 10.0 - a0 - a1 * l_partkey as r from lineitem cross join f), " + newton("d", ["h", "r"], ["0.0::double"] * 3, "1 / (1 + exp(-eta))", "y - mu", "mu * (1 - mu)", 8) + " select t.term, round(t.coef, 4) as coef from n8, lateral (values ('q', b1), ('_resid', b2 - b1)) as t(term, coef)")
def two_sri(spark, d):
    fit = irls.residual_inclusion(_line(spark, d), Design(["returned"], [num("q")], instruments=[num("l_partkey")]), "q", "binomial", tol=1e-12)
    return fit.table(spark, digits=4).where("term <> 'Intercept'").select("term", "coef")


_LOGIT_COV = ", i as (select *, haa * hbb - hab * hab as det from (select sum(v) as haa, sum(v * x) as hab, sum(v * x * x) as hbb from f))"


@query("g6_marginal_effects_lineitem", _LOGIT_ROWS + _LOGIT_COV + ", j as (select avg(v * b1) as effect, avg(v * (1 - 2 * mu) * b1) as j0, avg(v * (1 - 2 * mu) * x * b1 + v) as j1 from f) select 'q' as term, round(effect, 8) as effect, round(sqrt((j0 * j0 * hbb - 2 * j0 * j1 * hab + j1 * j1 * haa) / det), 8) as std_err from j cross join i")
def margins(spark, d):
    df = _line(spark, d)
    fit = irls.glm(df, Design(["returned"], [num("q")]), "binomial")
    return spark.createDataFrame([(k, round(v[0], 8), round(v[1], 8)) for k, v in irls.marginal_effects(fit, df, ["q"]).items()], "term string, effect double, std_err double")


for _at, _middle in (("mean", "avg(x)"), ("median", "quantile_cont(x, 0.5)")):

    def _margins_at(spark, d, at=_at):
        df = _line(spark, d)
        fit = irls.glm(df, Design(["returned"], [num("q")]), "binomial")
        return spark.createDataFrame([(k, round(v[0], 8), round(v[1], 8)) for k, v in irls.marginal_effects(fit, df, ["q"], at=at).items()], "term string, effect double, std_err double")

    query(f"g6_effect_at_{_at}_lineitem", _LOGIT_ROWS + _LOGIT_COV + f", m as (select any_value(b0) as b0, any_value(b1) as b1, {_middle} as x from f), w as (select *, 1 / (1 + exp(-(b0 + b1 * x))) as mu from m), j as (select mu * (1 - mu) * b1 as effect, mu * (1 - mu) * (1 - 2 * mu) * b1 as j0, mu * (1 - mu) * ((1 - 2 * mu) * x * b1 + 1) as j1 from w) select 'q' as term, round(effect, 8) as effect, round(sqrt((j0 * j0 * hbb - 2 * j0 * j1 * hab + j1 * j1 * haa) / det), 8) as std_err from j cross join i")(_margins_at)


@query("g7_gam_orders")
def gam(spark, d):
    df = table(spark, d, "orders").withColumn("u", F.col("o_custkey") % 100 / 10.0).withColumn("p", F.col("o_totalprice") / 1e5)
    return irls.gam(df, "p", {"u": 8}, "gaussian").table(spark)


@query("g8_glm_predict_lineitem", _LOGIT_ROWS + " select l_orderkey, l_linenumber, round(mu, 6) as mu from f")
def glm_predict(spark, d):
    df = _line(spark, d)
    fit = irls.glm(df, Design(["returned"], [num("q")]), "binomial")
    return irls.predict(fit, df).select("l_orderkey", "l_linenumber", F.round("mu", 6).alias("mu"))


_PRICE_ROWS = "select l_extendedprice as y, l_quantity::double as x, l_orderkey, l_linenumber from lineitem"

for _n in ("HuberT", "TukeyBiweight", "TrimmedMean", "AndrewWave", "RamsayE"):

    def _robust(spark, d, n=_n):
        return irls.rlm(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")]), n, tol=1e-11, max_iter=80).table(spark, digits=3).select("term", "coef", "std_err")

    query(f"b1_rlm_{_n.lower()}_lineitem", f"with {robust(_PRICE_ROWS, _n)}{ROBUST_SUMS} select t.term, round(t.coef, 3) as coef, round(kk * sqrt(p2 * t.i) / abs(m), 3) as std_err from v, lateral (values ('Intercept', b0, i00), ('l_quantity', b1, i11)) as t(term, coef, i)")(_robust)


@query("b2_rlm_covariances_lineitem", f"""with {robust(_PRICE_ROWS, "HuberT")}{ROBUST_SUMS},
h as (select *, n * w01 * w01 + 2 * sx * w01 * w11 + sxx * w11 * w11 as h11, n * w00 * w00 + 2 * sx * w00 * w01 + sxx * w01 * w01 as h00, pp * w01 * w01 + 2 * mx * w01 * w11 + mxx * w11 * w11 as q11, pp * w00 * w00 + 2 * mx * w00 * w01 + mxx * w01 * w01 as q00 from v)
select t.cov, round(sqrt(t.a), 4) as se0, round(sqrt(t.b), 4) as se1 from h, lateral (values ('H1', kk * kk * p2 / (m * m) * i00, kk * kk * p2 / (m * m) * i11), ('H2', kk * p2 / m * w00, kk * p2 / m * w11), ('H3', p2 / kk * h00, p2 / kk * h11), ('SANDWICH', q00 * s * s * n / (n - 2), q11 * s * s * n / (n - 2))) as t(cov, a, b)""")
def rlm_cov(spark, d):
    df, design = _line(spark, d), Design(["l_extendedprice"], [num("l_quantity")])
    fit = irls.rlm(df, design, "HuberT", tol=1e-11, max_iter=80)  # one fit has them all
    return _out(spark, [(c, *map(float, np.sqrt(np.diag(fit.covariances[c])))) for c in ("H1", "H2", "H3", "SANDWICH")], "cov string, se0 double, se1 double")


_TAUS = {"a": 0.1, "b": 0.5, "c": 0.9}
_PRICES = "select l_quantity::double as x, l_extendedprice::double as y from lineitem"


@query("q1_quantile_regression_orders", "with q as (select unnest([0.25, 0.5, 0.75])::double as tau), b as (select 0.25::double as tau, quantile_disc(o_totalprice::double, 0.25) as b from orders union all select 0.5, quantile_disc(o_totalprice::double, 0.5) from orders union all select 0.75, quantile_disc(o_totalprice::double, 0.75) from orders) select tau, true as best, round(sum((o_totalprice - b) * (tau - (o_totalprice < b)::int)) / count(*), 4) as cost from orders cross join b group by tau")
def quantiles(spark, d):
    """Where a share falls between two rows, every value between them is a minimum: ``best`` says that the fit's is one."""
    df = table(spark, d, "orders")
    fits = irls.quantile_regression(df, Design(["o_totalprice"], []), [0.25, 0.5, 0.75])
    below = df.agg(*[F.count(F.when(F.col("o_totalprice") < float(f.params[0]) - 1e-6, 1)) for f in fits.values()], *[F.count(F.when(F.col("o_totalprice") <= float(f.params[0]) + 1e-6, 1)) for f in fits.values()], F.count("*")).first()
    best = [bool(below[i] <= t * below[-1] <= below[i + len(fits)]) for i, t in enumerate(fits)]
    return _out(spark, [(float(t), b, float(f.stats["cost"] / f.stats["n"])) for (t, f), b in zip(fits.items(), best, strict=True)], "tau double, best boolean, cost double")


_SPARSITY = """, r as (select * from ra union all select * from rb union all select * from rc), h as (select tau, any_value(b0) as b0, any_value(b1) as b1, 0.9 * quantile_cont(abs(r), 0.5) / 0.6744897501960817 * count(*) ** -0.2 as h from r group by tau),
s as (select tau, any_value(b0) as b0, any_value(b1) as b1, sum(f) as f0, sum(f * x) as f1, sum(f * x * x) as f2, sum(w) as w0, sum(w * x) as w1, sum(w * x * x) as w2 from (select r.tau, h.b0, h.b1, x, exp(-0.5 * (r / h) ** 2) / (h * sqrt(2 * pi())) as f, case when r >= 0 then r.tau else 1 - r.tau end as w from r join h using (tau)) group by tau),
v as (select *, f0 * f2 - f1 * f1 as det from s), c as (select tau, b0, b1, sqrt((f2 * f2 * w0 - 2 * f1 * f2 * w1 + f1 * f1 * w2)) / det as s0, sqrt(f1 * f1 * w0 - 2 * f0 * f1 * w1 + f0 * f0 * w2) / det as s1 from v)
select tau, 'Intercept' as term, round(b0, 2) as coef, round(s0, 2) as std_err from c union all select tau, 'l_quantity', round(b1, 2), round(s1, 2) from c"""


@query("q2_quantile_slopes_lineitem", "with " + ", ".join(quantile_line(_PRICES, t, k) for k, t in _TAUS.items()) + _SPARSITY)
def quantile_slopes(spark, d):
    fits = irls.quantile_regression(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")]), [0.1, 0.5, 0.9], "ROBUST")
    rows = [(float(t), n, float(b), float(s)) for t, f in fits.items() for n, b, s in zip(f.names, f.params, f.bse, strict=True)]
    return _out(spark, rows, "tau double, term string, coef double, std_err double").select("tau", "term", F.round("coef", 2).alias("coef"), F.round("std_err", 2).alias("std_err"))


@query("q3_pseudo_r1_lineitem", "with " + quantile_line(_PRICES, 0.5, "b") + ", u as (select sum(abs(y - m)) as whole from db cross join (select quantile_disc(y, 0.5) as m from db)) select tau, round(1 - sum(abs(r)) / any_value(whole), 4) as r1, round(avg((r < 0)::int), 4) as share_below from rb cross join u group by tau")
def pseudo(spark, d):
    df = _line(spark, d)
    f = irls.quantile_regression(df, Design(["l_extendedprice"], [num("l_quantity")]), [0.5], None)[0.5]
    return _out(spark, [(0.5, irls.pseudo_r1(df, "l_extendedprice", 0.5, f.stats["cost"]), float(f.stats["share_below"]))], "tau double, r1 double, share_below double")


@query(
    "n1_shrink_to_targets_lineitem",
    """with m as (select count(*) as n, avg(l_extendedprice) as my, avg(l_quantity) as ma, avg(l_discount) as mb from lineitem),
s as (select avg((l_quantity - ma) ** 2) as aa, avg((l_quantity - ma) * (l_discount - mb)) as ab, avg((l_discount - mb) ** 2) as bb, avg((l_quantity - ma) * (l_extendedprice - my)) as ay, avg((l_discount - mb) * (l_extendedprice - my)) as byy from lineitem cross join m),
r as (select aa + 20.0 as p, ab as q, bb + 0.002 as r, ay - ab * 500.0 - aa * 1000.0 as u, byy - bb * 500.0 - ab * 1000.0 as v from s)
select t.term, round(t.coef, 4) as coef from r, lateral (values ('l_quantity', 1000.0 + (r * u - q * v) / (p * r - q * q)), ('l_discount', 500.0 + (p * v - q * u) / (p * r - q * q))) as t(term, coef)""",
)
def shrink(spark, d):
    design = Design(["l_extendedprice"], [num("l_quantity"), num("l_discount")])
    fit = penalized.elastic_net(_line(spark, d), design, {"l_quantity": 20.0, "l_discount": 0.002}, 0.0, targets={"l_quantity": 1000.0, "l_discount": 500.0})
    return fit.table(spark, digits=4).where("term <> 'Intercept'").select("term", "coef")


@query("n1_lasso_to_target_lineitem", "with m as (select avg(l_extendedprice) as my, avg(l_quantity) as mx from lineitem), s as (select avg((l_quantity - mx) * (l_extendedprice - my)) as xy, avg((l_quantity - mx) ** 2) as xx from lineitem cross join m) select 'l_quantity' as term, round(900.0 + sign(xy - 900.0 * xx) * greatest(abs(xy - 900.0 * xx) - 5000.0, 0) / xx, 4) as coef from s")
def lasso_target(spark, d):
    fit = penalized.elastic_net(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")]), 5000.0, targets={"l_quantity": 900.0})
    return fit.table(spark, digits=4).where("term <> 'Intercept'").select("term", "coef")


@query("n1_lasso_lineitem", "with m as (select count(*) as n, avg(l_extendedprice) as my, avg(l_quantity) as mx from lineitem), s as (select sum((l_quantity - mx) * (l_extendedprice - my)) / any_value(n) as xy, sum((l_quantity - mx) * (l_quantity - mx)) / any_value(n) as xx from lineitem cross join m) select 'l_quantity' as term, round(sign(xy) * greatest(abs(xy) - 50.0, 0) / xx, 4) as coef from s")
def lasso(spark, d):
    fit = penalized.elastic_net(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")]), 50.0)
    return _out(spark, [("l_quantity", float(fit.params[1]))], "term string, coef double")


@query("n1_elastic_net_lineitem", "with m as (select count(*) as n, avg(l_extendedprice) as my, avg(l_quantity) as mx from lineitem), s as (select sum((l_quantity - mx) * (l_extendedprice - my)) / any_value(n) as xy, sum((l_quantity - mx) * (l_quantity - mx)) / any_value(n) as xx from lineitem cross join m) select 'l_quantity' as term, round(sign(xy) * greatest(abs(xy) - 25.0, 0) / (xx + 25.0), 4) as coef from s")
def net(spark, d):
    fit = penalized.elastic_net(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")]), 50.0, 0.5)
    return _out(spark, [("l_quantity", float(fit.params[1]))], "term string, coef double")


@query("n2_n3_elastic_net_refit_lineitem")
def net_refit(spark, d):
    fit = penalized.elastic_net(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity"), num("l_discount"), num("l_tax")]), 50.0, refit=True)
    return fit.refit.table(spark)


@query("n4_cross_validation_lineitem")
def cv(spark, d):
    return penalized.cross_validate(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity"), num("l_discount")]), [0.1, 10.0, 100.0], 5, ["l_orderkey", "l_linenumber"])


@query("m1_gmm_iv_linear_lineitem", "with m as (select avg(l_extendedprice) as my, avg(l_quantity) as mx, avg(l_partkey) as mz from lineitem) select 'l_quantity' as term, round(sum((l_partkey - mz) * (l_extendedprice - my)) / sum((l_partkey - mz) * (l_quantity - mx)), 2) as coef from lineitem cross join m")
def gmm_linear(spark, d):
    fit = moments_fits.gmm_iv_linear(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")], instruments=[num("l_partkey")]))
    return spark.createDataFrame([("l_quantity", round(float(fit.params[1]), 2))], "term string, coef double")


@query("m2_gmm_mean_variance_events", "select round(avg(value), 4) as mean, round(var_pop(value), 4) as variance from events")
def gmm_moments(spark, d):
    fit = moments_fits.gmm(table(spark, d, "events"), ["value"], lambda c, t: np.stack([c["value"] - t[0], (c["value"] - t[0]) ** 2 - t[1]], 1), np.array([0.0, 1.0]))
    return _out(spark, [tuple(map(float, fit.params))], "mean double, variance double")


@query("m4_gmm_mle_poisson_customer", _newton(_COUNTS, f"select ln(avg(y)) as b0, 0.0::double as b1 from ({_COUNTS})", "exp(b0 + b1 * x)", "mu"))
def gmm_mle(spark, d):
    def score(c, t):
        r = c["n"] - np.exp(np.clip(t[0] + t[1] * c["bal"], -30, 30))
        return np.stack([r, r * c["bal"]], 1)

    fit = moments_fits.gmm(_orders_per_customer(spark, d), ["n", "bal"], score, np.array([2.0, 0.0]))
    return _out(spark, zip(["Intercept", "x"], map(float, fit.params), strict=True), "term string, coef double")


@query("v1_nlls_linear_lineitem", "select 'a' as term, round(regr_intercept(l_extendedprice, l_quantity), 1) as coef from lineitem union all select 'b', round(regr_slope(l_extendedprice, l_quantity), 1) from lineitem")
def nlls_linear(spark, d):
    fit = moments_fits.nlls(_line(spark, d), "l_extendedprice", ["l_quantity"], lambda c, t: t[0] + t[1] * c["l_quantity"], np.array([1.0, 1.0]), ["a", "b"])
    return spark.createDataFrame([(n, round(float(b), 1)) for n, b in zip(fit.names, fit.params, strict=True)], "term string, coef double")


@query("v2_nlls_exponential_customer", f"with d as ({_COUNTS}), " + newton("d", ["x"], ["(select ln(avg(y)) from d)", "0.0::double"], "exp(eta)", "(y - mu) * mu", "mu * mu", 25) + ", e as (select x, y - exp(b0 + b1 * x) as r, exp(b0 + b1 * x) as mu from d cross join n25), q as (select count(*) as n, sum(mu * mu) as a, sum(mu * mu * x) as b, sum(mu * mu * x * x) as c, sum(mu * mu * r * r) as ma, sum(mu * mu * r * r * x) as mb, sum(mu * mu * r * r * x * x) as mc from e) select t.term, round(t.coef, 4) as coef, round(sqrt(n / (n - 2.0) * t.v) / abs(a * c - b * b), 4) as std_err from q cross join n25, lateral (values ('b0', b0, c * c * ma - 2 * b * c * mb + b * b * mc), ('b1', b1, b * b * ma - 2 * a * b * mb + a * a * mc)) as t(term, coef, v)")
def nlls_exp(spark, d):
    fit = moments_fits.nlls(_orders_per_customer(spark, d), "n", ["bal"], lambda c, t: np.exp(np.clip(t[0] + t[1] * c["bal"], -30, 30)), np.array([1.0, 0.0]), ["b0", "b1"], cov_type="HC1")
    return fit.table(spark, digits=4).select("term", "coef", "std_err")


@query("v3_nlls_elastic_net_lineitem")
def nlls_net(spark, d):
    fit = moments_fits.nlls(_line(spark, d), "q", ["l_discount", "l_tax"], lambda c, t: t[0] + t[1] * c["l_discount"] + t[2] * c["l_tax"], np.array([1.0, 0.0, 0.0]), penalty=(0.01, 0.5))
    return _out(spark, zip(fit.names, map(float, fit.params), strict=True), "term string, coef double")


@query("k1_pls1_lineitem", "with m as (select avg(l_extendedprice) as my, avg(l_quantity) as ma, avg(l_tax) as mb from lineitem), s as (select sum((l_quantity - ma) * (l_extendedprice - my)) as ay, sum((l_tax - mb) * (l_extendedprice - my)) as by_, sum((l_quantity - ma) ** 2) as aa, sum((l_quantity - ma) * (l_tax - mb)) as ab, sum((l_tax - mb) ** 2) as bb from lineitem cross join m), c as (select *, (ay * ay + by_ * by_) / (ay * ay * aa + 2 * ay * by_ * ab + by_ * by_ * bb) as f from s) select t.term, round(t.coef, 3) as coef from c, lateral (values ('l_quantity', f * ay), ('l_tax', f * by_)) as t(term, coef)")
def pls1(spark, d):
    m = moments_fits.pls(_line(spark, d), ["l_extendedprice"], ["l_quantity", "l_tax"], 1)
    return spark.createDataFrame([(n, round(float(b), 3)) for n, b in zip(("l_quantity", "l_tax"), m["coef"][:, 0], strict=True)], "term string, coef double")


@query("k2_k3_pls2_scores_lineitem")
def pls2(spark, d):
    df = _line(spark, d)
    m = moments_fits.pls(df, ["l_extendedprice", "returned"], ["l_quantity", "l_discount", "l_tax"], 2)
    return moments_fits.pls_scores(df, m, ["l_quantity", "l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "t0", "t1")


for _m in ("nb2", "nb1", "gp1", "zip", "zinb"):

    def _count_model(spark, d, m=_m):
        return mle.fit_mle(_orders_per_customer(spark, d), Design(["n"], [num("bal")]), m).table(spark)

    query(f"d{2 if _m.startswith('z') else 1}_{_m}_customer")(_count_model)


@query("d1_gamma_mle_orders")
def gamma_mle(spark, d):
    df = table(spark, d, "orders").withColumn("x", (F.col("o_custkey") % 10) / 10.0).withColumn("p", F.col("o_totalprice") / 1e5)
    return mle.fit_mle(df, Design(["p"], [num("x")]), "gamma").table(spark)


@query("d3_hurdle_customer", _newton(f"select (y > 0)::double as y, x from ({_COUNTS})", "select 0.0::double as b0, 0.0::double as b1", _LOGIT, "mu * (1 - mu)"))
def hurdle(spark, d):
    fits = mle.hurdle(_orders_per_customer(spark, d), "n", [num("bal")], "zt_poisson")
    return _out(spark, zip(["Intercept", "x"], map(float, fits["zero"].params), strict=True), "term string, coef double")


_POSITIVE = f"with c as ({_COUNTS.replace('as y,', 'as y, c_custkey,')}), d as (select * from c where y > 0), z as (select *, (y > 0)::double as u from c), " + newton("d", ["x"], ["(select ln(avg(y)) from d)", "0.0::double"], "exp(eta)", "y - mu / (1 - exp(-mu))", "mu / (1 - exp(-mu)) * (1 + mu - mu / (1 - exp(-mu)))", 12)


@query("d3_hurdle_positive_customer", _POSITIVE + " select t.term, round(t.coef, 4) as coef from n12, lateral (values ('Intercept', b0), ('x', b1)) as t(term, coef)")
def hurdle_positive(spark, d):
    fits = mle.hurdle(_orders_per_customer(spark, d), "n", [num("bal")], "zt_poisson")
    return _out(spark, zip(["Intercept", "x"], map(float, fits["positive"].params[:2]), strict=True), "term string, coef double")


@query("d5_hurdle_mean_customer", _POSITIVE + ", " + newton("z", ["x"], ["0.0::double", "0.0::double"], "1 / (1 + exp(-eta))", "u - mu", "mu * (1 - mu)", 10, "l") + ", m as (select c_custkey, 1 / (1 + exp(-(l10.b0 + l10.b1 * x))) as p, exp(n12.b0 + n12.b1 * x) as mu from c cross join n12 cross join l10) select c_custkey, round(p * mu / (1 - exp(-mu)), 4) as mean from m")
def hurdle_mean(spark, d):
    df = _orders_per_customer(spark, d)
    return mle.hurdle_mean(mle.hurdle(df, "n", [num("bal")], "zt_poisson"), df).select("c_custkey", F.round("mean", 4).alias("mean"))


@query("d6_average_effect_customer")
def effect(spark, d):
    df = _orders_per_customer(spark, d)
    return _out(spark, [("bal", mle.average_effect(mle.fit_mle(df, Design(["n"], [num("bal")]), "nb2"), df, "bal")[0])], "term string, effect double")


_EFFECT = """, h as (select sum(mu) as haa, sum(mu * x) as hab, sum(mu * x * x) as hbb, avg(mu) as m0, avg(mu * x) as m1, any_value(b1) as b1 from f),
g as (select *, m0 * b1 as effect, m0 * b1 as ja, m0 + m1 * b1 as jb, haa * hbb - hab * hab as det from h)"""


@query("d6_effect_errors_customer", _steps(_COUNTS, f"select ln(avg(y)) as b0, 0.0::double as b1 from ({_COUNTS})", "exp(b0 + b1 * x)", "mu") + _EFFECT + " select 'bal' as term, round(effect, 6) as effect, round(sqrt((ja * ja * hbb - 2 * ja * jb * hab + jb * jb * haa) / det), 6) as std_err from g")
def effect_errors(spark, d):
    df = _orders_per_customer(spark, d)
    effect, error = mle.average_effect(mle.fit_mle(df, Design(["n"], [num("bal")]), "poisson", cov_type="NONROBUST"), df, "bal")
    return spark.createDataFrame([("bal", round(effect, 6), round(error, 6))], "term string, effect double, std_err double")


@query(
    "g6_row_effects_lineitem",
    _LOGIT_ROWS
    + """, h as (select sum(v) as haa, sum(v * x) as hab, sum(v * x * x) as hbb from f),
r as (select l_orderkey, l_linenumber, v * b1 as effect, v * (1 - 2 * mu) * b1 as ja, v + x * v * (1 - 2 * mu) * b1 as jb, haa, hab, hbb from f cross join h)
select l_orderkey, l_linenumber, round(effect, 5) as effect, round(sqrt((ja * ja * hbb - 2 * ja * jb * hab + jb * jb * haa) / (haa * hbb - hab * hab)), 5) as std_err from r""",
)
def row_effects(spark, d):
    df = _line(spark, d)
    fit = irls.glm(df, Design(["returned"], [num("q")]), "binomial")
    out = effects.row_effects(fit, df, "q", irls.predict)
    return out.select("l_orderkey", "l_linenumber", F.round("effect", 5).alias("effect"), F.round("std_err", 5).alias("std_err"))


@query("d5_poisson_mean_customer", _steps(_COUNTS.replace("as y,", "as y, c_custkey,"), f"select ln(avg(y)) as b0, 0.0::double as b1 from ({_COUNTS})", "exp(b0 + b1 * x)", "mu") + " select c_custkey, round(mu, 6) as mean from f")
def poisson_mean(spark, d):
    df = _orders_per_customer(spark, d)
    return mle.predict_mean(mle.fit_mle(df, Design(["n"], [num("bal")]), "poisson"), df).select("c_custkey", F.round("mean", 6).alias("mean"))


_SERIES = "with e as (select user_id, ts, event_id, value - avg(value) over (partition by user_id) as c from events where value is not null), l as (select *, lag(c, 1) over w as l1, lag(c, 2) over w as l2, lag(c, 3) over w as l3 from e window w as (partition by user_id order by ts, event_id)), a as (select user_id, count(*) as n, sum(c * c) / count(*) as a0, coalesce(sum(c * l1), 0) / count(*) as a1, coalesce(sum(c * l2), 0) / count(*) as a2, coalesce(sum(c * l3), 0) / count(*) as a3 from l group by 1)"
_BY = (["user_id"], ["ts", "event_id"])


@query("t1_acf_events", _SERIES + " select user_id, round(case when a0 > 0 then a1 / a0 else 0 end, 6) as r1, round(case when a0 > 0 then a2 / a0 else 0 end, 6) as r2, round(case when a0 > 0 then a3 / a0 else 0 end, 6) as r3 from a")
def acf(spark, d):
    a = series.acf(table(spark, d, "events"), "value", *_BY, 3)
    return a.select("user_id", *[F.round(F.col("acf")[k], 6).alias(f"r{k}") for k in (1, 2, 3)])


@query("t2_autocovariance_events", _SERIES + " select user_id, n, round(a0, 6) as a0, round(a1, 6) as a1 from a")
def acov(spark, d):
    a = series.autocovariance(table(spark, d, "events"), "value", *_BY, 1)
    return a.select("user_id", "n", *[F.round(F.col("acov")[k], 6).alias(f"a{k}") for k in (0, 1)])


@query("t3_pacf_events", _SERIES + " select user_id, round(a1 / a0, 6) as p1, round((a2 / a0 - (a1 / a0) ** 2) / (1 - (a1 / a0) ** 2), 6) as p2 from a where a0 > 0 and n > 5")
def pacf(spark, d):
    n = table(spark, d, "events").where("value is not null").groupBy("user_id").agg(F.count("*").alias("n"), F.var_pop("value").alias("v")).where("n > 5 and v > 0").select("user_id")
    a = series.pacf(table(spark, d, "events"), "value", *_BY, 2).join(n, "user_id")
    return a.select("user_id", *[F.round(F.col("pacf")[k], 6).alias(f"p{k + 1}") for k in (0, 1)])


@query("t4_yule_walker_events", _SERIES + " select user_id, round((a1 * a0 - a1 * a2) / (a0 * a0 - a1 * a1), 6) as ar1, round((a0 * a2 - a1 * a1) / (a0 * a0 - a1 * a1), 6) as ar2 from a where n > 5 and a0 > 0")
def yule_walker(spark, d):
    a = series.ar_yule_walker(table(spark, d, "events"), "value", *_BY, 2).where("n > 5 and sigma2 > 0")
    return a.select("user_id", *[F.round(F.col("ar")[k], 6).alias(f"ar{k + 1}") for k in (0, 1)])


@query("t5_ar_css_events", "with l as (select user_id, value as y, lag(value) over (partition by user_id order by ts, event_id) as x from events where value is not null) select user_id, count(*) as n, round(regr_intercept(y, x), 6) as intercept, round(regr_slope(y, x), 6) as ar1 from l where x is not null group by 1 having count(*) > 2")
def css(spark, d):
    a = series.ar_css(table(spark, d, "events"), "value", *_BY, 1).where("n > 2")
    return a.select("user_id", "n", F.round(F.col("coef")[0], 6).alias("intercept"), F.round(F.col("coef")[1], 6).alias("ar1"))


def _daily(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("value"))


_HOURLY = "h as (select event_type, date_trunc('hour', ts) as hour, avg(value) as value from events group by 1, 2), c as (select *, value - avg(value) over (partition by event_type) as c, row_number() over w - 1 as t, lag(value) over w as l1, lag(value, 2) over w as l2 from h where value is not null window w as (partition by event_type order by hour))"
_BURG = f"""with {_HOURLY}, p1 as (select *, lag(c) over (partition by event_type order by t) as v from c), k1 as (select event_type, 2 * sum(c * v) / sum(c * c + v * v) as k1 from p1 where v is not null group by 1),
p2 as (select event_type, t, c - k1 * v as f, v - k1 * c as b, k1 from p1 join k1 using (event_type)), p3 as (select *, lag(b) over (partition by event_type order by t) as v from p2), k2 as (select event_type, 2 * sum(f * v) / sum(f * f + v * v) as k2 from p3 where t >= 2 group by 1),
a as (select event_type, count(*) + 2 as n, any_value(k1 - k2 * k1) as a1, any_value(k2) as a2, sum((f - k2 * v) ** 2) / count(*) as s2 from p3 join k2 using (event_type) where t >= 2 group by 1)"""


@query("t6_burg_events", _BURG + " select event_type, n, round(a1, 6) as ar1, round(a2, 6) as ar2, round(s2, 6) as sigma2 from a")
def burg(spark, d):
    a = series.ar_burg(_daily(spark, d), "value", ["event_type"], ["hour"], 2)
    return a.select("event_type", "n", *[F.round(F.col("ar")[k], 6).alias(f"ar{k + 1}") for k in (0, 1)], F.round("sigma2", 6).alias("sigma2"))


@query("t7_ar_mle_events")
def ar_mle(spark, d):
    return series.ar_mle(_daily(spark, d), "value", ["event_type"], ["hour"], 1)


def _fits(out, n):
    """Coefficients and errors of ``fit_many`` as columns."""
    return out.where("coef is not null").select("event_type", "n", *[F.round(F.col(c)[i], 6).alias(f"{short}{i}") for c, short in (("coef", "b"), ("std_err", "s")) for i in range(n)])


def _fits_sql(n, tag=""):
    return f" select event_type, n, {', '.join(f'round({c}{i}, 6) as {c}{i}' for c in 'bs' for i in range(n))} from fit{tag}"


for _trend, _more in (("n", []), ("c", []), ("t", ["(t + 1.0)"]), ("ct", ["(t + 1.0)"]), ("ctt", ["(t + 1.0)", "((t + 1.0) ** 2)"])):

    def _autoreg(spark, d, trend=_trend, n=2 + len(_more) + _trend.startswith("c")):
        return _fits(series.autoreg(_daily(spark, d), "value", ["event_type"], ["hour"], [1, 2], trend), n)

    query(f"t8_autoreg_{_trend}_events", f"with {_HOURLY}, " + least_squares("c", "value", ["l1", "l2", *_more], ["event_type"], _trend.startswith("c")) + _fits_sql(2 + len(_more) + _trend.startswith("c")))(_autoreg)


@query("t8_autoreg_seasonal_events", f"with {_HOURLY}, " + least_squares("c", "value", ["l1", *[f"(t % 4 = {k})::double" for k in (1, 2, 3)]], ["event_type"]) + _fits_sql(5))
def autoreg_seasonal(spark, d):
    return _fits(series.autoreg(_daily(spark, d), "value", ["event_type"], ["hour"], [1], "c", (2, 4)), 5)


@query("t9_ardl_events", f"with {_HOURLY}, x as (select *, hour(hour)::double as x, lag(hour(hour)::double) over (partition by event_type order by hour) as x1 from c), " + least_squares("x", "value", ["l1", "x", "x1"], ["event_type"]) + _fits_sql(4))
def ardl(spark, d):
    e = _daily(spark, d).withColumn("x", F.hour("hour").cast("double"))
    return _fits(series.ardl(e, "value", ["event_type"], ["hour"], [1], {"x": 1}), 4)


_ARMA_FIT = f"""{{hourly}}, x as (select event_type, hour, value, {', '.join(f'lag(value, {k}) over w as v{k}' for k in range(1, 7))} from c window w as (partition by event_type order by hour)), """ + least_squares("x", "value", [f"v{k}" for k in range(1, 7)], ["event_type"], tag="1") + f", r as (select x.*, value - b0 - {' - '.join(f'b{k} * v{k}' for k in range(1, 7))} as e from x join fit1 using (event_type)), q as (select *, lag(e) over (partition by event_type order by hour) as e1 from r), " + least_squares("q", "value", ["v1", "e1"], ["event_type"])


def _ahead(spark, d, hours: int):
    """The hours that follow each series' last one."""
    last = _daily(spark, d).groupBy("event_type").agg(F.max("hour").alias("last"))
    return last.select("event_type", F.explode(F.expr(f"sequence(last + interval 1 hour, last + interval {hours} hours, interval 1 hour)")).alias("hour")).withColumn("x", F.hour("hour").cast("double"))


@query(
    "t10_arma_forecast_events",
    "with recursive " + _ARMA_FIT.replace("{hourly}", _HOURLY)
    + """, z as (select event_type, arg_max(value, hour) as v, arg_max(e, hour) as e from q group by 1),
ahead as (select event_type, 1 as step, b0 + b1 * v + b2 * e as mean, 1.0::double as total, b1 + b2 as psi, b0, b1, ssr / (n - 3) as s2 from z join fit using (event_type)
  union all select event_type, step + 1, b0 + b1 * mean, total + psi * psi, psi * b1, b0, b1, s2 from ahead where step < 6)
select event_type, cast(step as bigint) as step, round(mean, 4) as mean, round(s2 * total, 2) as variance from ahead""",
)
def arma_ahead(spark, d):
    out = series.arma_forecast(_daily(spark, d), "value", ["event_type"], ["hour"], 1, 1, _ahead(spark, d, 6))
    return out.select("event_type", "step", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"))


@query(
    "t9_ardl_forecast_events",
    f"with recursive {_HOURLY}, x as (select event_type, hour, value, lag(value) over (partition by event_type order by hour) as l1, hour(hour)::double as x from c), "
    + least_squares("x", "value", ["l1", "x"], ["event_type"])
    + """, z as (select event_type, arg_max(value, hour) as v, max(hour) as last from x group by 1),
ahead as (select event_type, 1 as step, last, b0 + b1 * v + b2 * hour(last + interval 1 hour) as mean, b0, b1, b2 from z join fit using (event_type)
  union all select event_type, step + 1, last, b0 + b1 * mean + b2 * hour(last + (step + 1) * interval 1 hour), b0, b1, b2 from ahead where step < 24)
select event_type, cast(step as bigint) as step, round(mean, 4) as mean from ahead""",
)
def ardl_ahead(spark, d):
    e = _daily(spark, d).withColumn("x", F.hour("hour").cast("double"))
    out = series.arma_forecast(e, "value", ["event_type"], ["hour"], 1, 0, _ahead(spark, d, 24), ("x",))
    return out.select("event_type", "step", F.round("mean", 4).alias("mean"))


@query("t10_arma_events", f"with {_HOURLY}, x as (select event_type, hour, value, {', '.join(f'lag(value, {k}) over w as v{k}' for k in range(1, 7))} from c window w as (partition by event_type order by hour)), " + least_squares("x", "value", [f"v{k}" for k in range(1, 7)], ["event_type"], tag="1") + f", r as (select x.*, value - b0 - {' - '.join(f'b{k} * v{k}' for k in range(1, 7))} as e from x join fit1 using (event_type)), q as (select *, lag(e) over (partition by event_type order by hour) as e1 from r), " + least_squares("q", "value", ["v1", "e1"], ["event_type"]) + _fits_sql(3))
def arma(spark, d):
    return _fits(series.arma(_daily(spark, d), "value", ["event_type"], ["hour"], 1, 1), 3)


@query("t11_forecast_events", _BURG + """, w as (select event_type, avg(value) as mu, arg_max(c, t) as c1, arg_max(l1, t) - avg(value) as c2 from c group by 1), s as (select *, 1.0 as p0, a1 as p1, a1 * c1 + a2 * c2 as f1 from a join w using (event_type)), s2_ as (select *, a1 * f1 + a2 * c1 as f2, a1 * p1 + a2 as p2 from s), s3 as (select *, a1 * f2 + a2 * f1 as f3, a1 * p2 + a2 * p1 as p3 from s2_), s4 as (select *, a1 * f3 + a2 * f2 as f4, a1 * p3 + a2 * p2 as p4 from s3), s5 as (select *, a1 * f4 + a2 * f3 as f5 from s4)
select event_type, t.step, round(mu + t.f, 6) as mean, round(s2 * t.v, 6) as variance from s5, lateral (values (1, f1, 1.0), (2, f2, 1 + p1 ** 2), (3, f3, 1 + p1 ** 2 + p2 ** 2), (4, f4, 1 + p1 ** 2 + p2 ** 2 + p3 ** 2), (5, f5, 1 + p1 ** 2 + p2 ** 2 + p3 ** 2 + p4 ** 2)) as t(step, f, v)""")
def forecast(spark, d):
    return series.forecast(_daily(spark, d), "value", ["event_type"], ["hour"], 2, 5).select("event_type", F.col("step").cast("int").alias("step"), F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def _stl_sql(period: int, window: int, rounds: int) -> str:
    """Two outer passes of ``rounds`` inner ones, each a LOWESS trend and medians of phases."""
    out, half = [_HOURLY, "s0 as materialized (select event_type, hour, t, value as y, 0.0::double as season, 0.0::double as trend, 1.0::double as w, count(*) over (partition by event_type) as n from c)"], window // 2
    for k in range(1, 2 * rounds + 1):
        out.append(f"a{k} as (select *, least(n, {window}) as q, least(greatest(t - {half}, 0), n - least(n, {window})) as a from s{k - 1})")
        out.append(f"p{k} as (select i.event_type, i.t, j.t - i.t as u, j.y - j.season as z, pow(1 - pow(abs(j.t - i.t) / (greatest(i.t - i.a, i.a + i.q - i.t) * 1.005), 3), 3) * j.w + 1e-6 as w from a{k} i join s{k - 1} j on i.event_type = j.event_type and j.t >= i.a and j.t < i.a + i.q)")
        out.append(f"m{k} as (select event_type, t, sum(w) as m0, sum(w * u) as m1, sum(w * u * u) as m2, sum(w * z) as t0, sum(w * u * z) as t1 from p{k} group by 1, 2)")
        out.append(f"l{k} as materialized (select s.* exclude (trend), case when m0 * m2 - m1 * m1 > 1e-12 * m0 * m2 then (m2 * t0 - m1 * t1) / (m0 * m2 - m1 * m1) else t0 / m0 end as trend from s{k - 1} s join m{k} using (event_type, t))")
        out.append(f"v{k} as materialized (select * exclude (season), median(y - trend) over (partition by event_type, t % {period}) as season from l{k})")
        if k == rounds:
            out.append(f"r{k} as materialized (select event_type, 6 * median(abs(y - trend - season)) as m from v{k} group by 1)")
            out.append(f"s{k} as materialized (select v.* exclude (w), case when m > 6e-6 then pow(greatest(1 - pow((y - trend - season) / m, 2), 0), 2) else 1.0 end as w from v{k} v join r{k} using (event_type))")
        else:
            out.append(f"s{k} as (select * from v{k})")
    return "with " + ", ".join(out) + f" select event_type, hour, round(y, 6) as value, round(trend, 6) as trend, round(season, 6) as seasonal_{period}, round(y - trend - season, 6) as resid from s{2 * rounds}"


@query("t12_stl_events", _stl_sql(24, 51, 2))
def stl(spark, d):
    out = series.stl(_daily(spark, d), "value", ["event_type"], ["hour"], [24], twindow=51, rounds=2)
    return out.select("event_type", "hour", *[F.round(c, 6).alias(c) for c in ("value", "trend", "seasonal_24", "resid")])


_PRAIS = """s{i} as materialized (select sum(o * o) as aa, sum(o * x_) as ab, sum(x_ * x_) as bb, sum(o * y_) as ay, sum(x_ * y_) as by_ from (select case when t >= 1 then 1 - rho else sqrt(1 - rho * rho) end as o, case when t >= 1 then x - rho * xl else sqrt(1 - rho * rho) * x end as x_, case when t >= 1 then y - rho * yl else sqrt(1 - rho * rho) * y end as y_ from d cross join k{j})), b{i} as materialized (select (bb * ay - ab * by_) / (aa * bb - ab * ab) as b0, (aa * by_ - ab * ay) / (aa * bb - ab * ab) as b1 from s{i}), k{i} as materialized (select sum((y - b0 - b1 * x) * (yl - b0 - b1 * xl)) / sum((yl - b0 - b1 * xl) ** 2) as rho from d cross join b{i} where t >= 1)"""


@query("l9_glsar_events", "with v as (select user_id, ts, event_id, value as y, (event_id % 7)::double as x from events where value is not null), d as materialized (select *, row_number() over w - 1 as t, lag(y) over w as yl, lag(x) over w as xl from v window w as (partition by user_id order by ts, event_id)), k0 as (select 0.0::double as rho), " + ", ".join(_PRAIS.format(i=i + 1, j=i) for i in range(4)) + " select t.term, round(t.value, 4) as value from k4 cross join b4, lateral (values ('rho', rho), ('x', b1)) as t(term, value)")
def glsar(spark, d):
    e = table(spark, d, "events").withColumn("x", (F.col("event_id") % 7).cast("double"))
    r = series.glsar(e, "value", ["x"], ["user_id"], ["ts", "event_id"], 1, 4)
    return _out(spark, [("rho", float(r["rho"][0])), ("x", float(r["fit"].params[1]))], "term string, value double")


@query("c5_hac_series_events", """
with v as (select ts, event_id, value as y, cast(event_id % 7 as double) as x from events where value is not null), m as (select avg(y) as my, avg(x) as mx from v),
b as (select sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) as b, sum((x - mx) * (x - mx)) as xx, any_value(my) as my, any_value(mx) as mx from v cross join m),
s as (select ts, event_id, (x - mx) * ((y - my) - b * (x - mx)) as s from v cross join b), l as (select *, lag(s) over w as s1, lag(s, 2) over w as s2 from s window w as (order by ts, event_id))
select 'x' as term, round(sqrt(sum(s * s + 2 * 2 / 3.0 * coalesce(s * s1, 0) + 2 * 1 / 3.0 * coalesce(s * s2, 0))) / (select xx from b), 6) as std_err from l""")
def hac_series(spark, d):
    from gramlake.operators import covariance

    df = table(spark, d, "events").select("ts", "event_id", "value", (F.col("event_id") % 7).cast("double").alias("x"))
    fit = linear.ols(df, Design(["value"], [num("x")]))
    cov = covariance.hac_series(df, fit, ["ts", "event_id"], ["x"], "value", lags=2, block=1000)
    return spark.createDataFrame([("x", round(float(np.sqrt(cov[1, 1])), 6))], "term string, std_err double")


@query("b3_robust_weights_lineitem", f"with {robust(_PRICE_ROWS, 'HuberT')} select l_orderkey, l_linenumber, round(w, 6) as weight from e")
def robust_rows(spark, d):
    df = _line(spark, d)
    fit = irls.rlm(df, Design(["l_extendedprice"], [num("l_quantity")]), tol=1e-11, max_iter=80)
    return irls.row_weights(fit, df, "HuberT").select("l_orderkey", "l_linenumber", F.round("weight", 6).alias("weight"))


@query("q4_quantile_control_function_lineitem")
def quantile_iv(spark, d):
    fits = irls.quantile_control_function(_line(spark, d), Design(["l_extendedprice"], [num("q")], instruments=[num("l_partkey")]), "q", [0.5])
    return fits[0.5].table(spark)


@query("d5_zero_probability_customer", _steps(_COUNTS.replace("as y,", "as y, c_custkey,"), f"select ln(avg(y)) as b0, 0.0::double as b1 from ({_COUNTS})", "exp(b0 + b1 * x)", "mu") + " select c_custkey, round(exp(-mu), 6) as p_zero from f")
def zero_probability(spark, d):
    df = _orders_per_customer(spark, d)
    return mle.predict_zero(mle.fit_mle(df, Design(["n"], [num("bal")]), "poisson"), df).select("c_custkey", F.round("p_zero", 6).alias("p_zero"))


@query("m3_gmm_iv_nonlinear_lineitem", "with m as (select avg(l_extendedprice) as my, avg(l_quantity / 10.0) as mx, avg(l_partkey) as mz from lineitem) select 'q' as term, round(sum((l_partkey - mz) * (l_extendedprice - my)) / sum((l_partkey - mz) * (l_quantity / 10.0 - mx)), 0) as coef from lineitem cross join m")
def gmm_nonlinear(spark, d):
    df = _line(spark, d).withColumn("z", F.col("l_partkey") / 1000.0)
    fit = moments_fits.gmm_iv_nonlinear(df, "l_extendedprice", ["q"], lambda c, t: t[0] + t[1] * c["q"], ["z"], np.array([1.0, 1.0]))
    return spark.createDataFrame([("q", round(float(fit.params[1]), 0) + 0.0)], "term string, coef double")


@query("h7_leverage_lineitem", "with m as (select count(*) as n, avg(l_quantity) as mx, var_pop(l_quantity) * count(*) as ss from lineitem) select l_orderkey, l_linenumber, round((1.0 / n + (l_quantity - mx) * (l_quantity - mx) / ss) * 1e4, 6) as leverage_e4 from lineitem cross join m")
def leverages(spark, d):
    df = _line(spark, d)
    fit = linear.ols(df, Design(["l_extendedprice"], [num("l_quantity")]))
    return linear.leverage(fit, df).select("l_orderkey", "l_linenumber", F.round(F.col("leverage") * 1e4, 6).alias("leverage_e4"))


@query("h4_lift_lineitem", "with g as (select avg(l_extendedprice) filter (where l_returnflag = 'R') as a, avg(l_extendedprice) filter (where l_returnflag <> 'R') as b from lineitem) select round((a - b) / b, 6) as value from g")
def lifts(spark, d):
    r = linear.lift(linear.ols(_line(spark, d), Design(["l_extendedprice"], [num("returned")])), "returned", {})
    return spark.createDataFrame([(round(r["value"], 6),)], "value double")


@query("f9_links_lineitem", "with e as (select l_orderkey, l_linenumber, l_tax * 10 as e from lineitem) select l_orderkey, l_linenumber, round(exp(e), 6) as log, round(1 / (1 + exp(-e)), 6) as logit, round(0.5 + atan(e) / pi(), 6) as cauchy, round(1 - exp(-exp(e)), 6) as cloglog, round(e * e, 6) as sqrt from e")
def links(spark, d):
    e = F.col("l_tax") * 10
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(irls.Link(k).column(e), 6).alias(k) for k in ("log", "logit", "cauchy", "cloglog", "sqrt")])


@query("s2_saved_fit_lineitem", "select 'Intercept' as term, round(regr_intercept(l_extendedprice, l_quantity), 3) as coef from lineitem union all select 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) from lineitem")
def saved(spark, d):
    base = folder(spark)
    path = f"{base.rstrip('/')}/fit-{uuid.uuid4().hex}"
    linear.ols(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")])).save(path, spark)
    return linear.Fit.load(path, spark).table(spark, digits=3).select("term", "coef")


def _kde_sql(source: str, x: str, n: int, by: str = "") -> str:
    """Counts in a group's bins, and the sum of kernels at each other bin."""
    k = f"{by}, " if by else ""
    same = f"a.{by} = b.{by}" if by else "true"
    return f"""with v as (select {k}{x}::double as v from {source} where {x} is not null),
m as (select {k}1.05922384 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * pow(count(*), -0.2) as h, min(v) as lo, max(v) as hi from v group by all),
g as (select {k}h, lo - 4 * h as lo, (hi - lo + 8 * h) / {n} as width from m where h > 0),
c as (select {', '.join(f'b.{x}' for x in ([by] if by else []) + ['h', 'lo', 'width'])}, least(greatest(floor((v - lo) / width), 0), {n - 1}) as j, count(*) as c from v a join g b on {same} group by all),
d as (select {k}i, any_value(lo) + (i + 0.5) * any_value(width) as x, any_value(width) as width, sum(c * exp(-0.5 * ((i - j) * width / h) ** 2)) as d from c cross join range({n}) r(i) group by {k}i)
select {k}round(x, 6) as x, round(d / (sum(d) over ({f'partition by {by}' if by else ''}) * width) * 1e6, 6) as density from d"""


def _density(out):
    return out.withColumn("x", F.round("x", 6)).withColumn("density", F.round(F.col("density") * 1e6, 6))


@query("e1_kde_orders", _kde_sql("orders", "o_totalprice", 256))
def kde(spark, d):
    return _density(smooth.kde(table(spark, d, "orders"), "o_totalprice", gridsize=256))


@query("e1_kde_by_type_events", _kde_sql("events", "value", 128, "event_type"))
def kde_by(spark, d):
    return _density(smooth.kde(table(spark, d, "events"), "value", gridsize=128, by=["event_type"]))


@query("e2_kernel_smooth_lineitem", "with m as (select 1.069 * stddev_pop(l_quantity) * pow(count(*), -0.2) as h, min(l_quantity) as lo, (max(l_quantity) - min(l_quantity)) / 64 as width from lineitem), b as (select least(floor((l_quantity - lo) / width), 63) as j, count(*) as n, sum(l_extendedprice) as s, any_value(h) as h, any_value(lo) as lo, any_value(width) as width from lineitem cross join m group by 1), g as (select i, any_value(lo) + (i + 0.5) * any_value(width) as x, sum(n * exp(-0.5 * pow((i - j) * width / h, 2))) as p, sum(s * exp(-0.5 * pow((i - j) * width / h, 2))) as q from range(64) r(i) cross join b group by 1) select round(x, 6) as x, round(q / p, 3) as y from g")
def smooth_binned(spark, d):
    return smooth.kernel_smooth(_line(spark, d), "l_quantity", "l_extendedprice", 64).select(F.round("x", 6).alias("x"), F.round("y", 3).alias("y"))


@query("e3_kernel_smooth_direct_lineitem", "with g as (select i * 10.0 as x from range(1, 5) t(i)), s as (select g.x, sum(exp(-0.5 * ((l_quantity - g.x) / 2.0) ** 2) * l_extendedprice) / sum(exp(-0.5 * ((l_quantity - g.x) / 2.0) ** 2)) as y from lineitem cross join g group by 1) select cast(x as double) as x, round(y, 3) as y from s")
def smooth_direct(spark, d):
    return smooth.kernel_smooth_direct(_line(spark, d), "l_quantity", "l_extendedprice", [10.0, 20.0, 30.0, 40.0], 2.0).withColumn("y", F.round("y", 3))


@query("e4_lowess_lineitem", "with g as (select unnest([5.0, 15.0, 25.0, 35.0, 45.0])::double as g), d as (select g, l_quantity - g as u, l_extendedprice as y, row_number() over (partition by g order by abs(l_quantity - g)) as r, floor(0.3 * count(*) over (partition by g)) as k from lineitem cross join g), h as (select g, max(abs(u)) filter (where r = k) * 1.005 as h from d group by 1), w as (select d.*, (1 - abs(u / h) ** 3) ** 3 as w from d join h using (g) where abs(u) < h), s as (select g, sum(w) as s0, sum(w * u) as s1, sum(w * u * u) as s2, sum(w * y) as t0, sum(w * u * y) as t1 from w group by 1) select g as x, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 2) as y from s")
def lowess(spark, d):
    return smooth.lowess(_line(spark, d), "l_quantity", "l_extendedprice", [5.0, 15.0, 25.0, 35.0, 45.0], 0.3).withColumn("y", F.round("y", 2))


@query("y1_y2_blm_lineitem", "select t.term, round(t.m, 3) as mean from (select regr_intercept(l_extendedprice, l_quantity) as a, regr_slope(l_extendedprice, l_quantity) as b from lineitem), lateral (values ('Intercept', a), ('l_quantity', b)) as t(term, m)")
def blm(spark, d):
    df = _line(spark, d)
    plan = Design(["l_extendedprice"], [num("l_quantity")]).fit(df)
    post = D.blm(linear.gram(plan.rows(df), plan), plan.names)
    return D.posterior_table(spark, post).select("term", F.round("mean", 3).alias("mean"))


def _draws(spark, d):
    """Values of events as draws: users are chains, types are parameters, so that chains grow in number with the table."""
    from pyspark.sql import Window

    e = table(spark, d, "events").where("value is not null").withColumn("chain", F.col("user_id"))
    w = Window.partitionBy("chain", "event_type").orderBy("event_id")
    return e.select("chain", (F.row_number().over(w) - 1).cast("long").alias("draw"), F.col("event_type").alias("param"), "value")


_DRAWS = "with d as (select user_id as chain, row_number() over (partition by user_id, event_type order by event_id) - 1 as draw, event_type as param, value from events where value is not null)"


@query("y3_rhat_events", _DRAWS + ", p as (select *, floor(count(*) over (partition by param, chain) / 2) as s from d), q as (select *, floor(draw / s) as seg from p where draw < 2 * s), g as (select param, chain, seg, count(*) as n, avg(value) as m, var_samp(value) as v from q group by 1, 2, 3), a as (select param, avg(n) as n, count(*) as k, avg(v) as w, var_samp(m) * avg(n) as b from g group by 1) select param, round(sqrt(((n - 1) / n * w + b / n) / w), 6) as rhat from a")
def rhat(spark, d):
    return D.rhat(_draws(spark, d)).select("param", F.round("rhat", 6).alias("rhat"))


@query("y4_ess_batch_means_events", _DRAWS + ", t as (select unnest([0.3, 0.5, 0.7])::double as tau), p as (select d.*, tau, count(*) over (partition by param, chain, tau) as n from d cross join t), q as (select *, floor(pow(n, tau)) as b from p), m as (select param, chain, tau, floor(draw / b) as batch, avg(value) as m from q where draw < floor(n / b) * b group by all), v as (select param, tau, var_samp(m) / count(*) as v from m group by all), w as (select param, max(v) as v from v group by 1) select param, round(var_samp(value) / any_value(w.v), 4) as ess from d join w using (param) group by 1")
def ess(spark, d):
    return D.ess_batch_means(_draws(spark, d), [0.3, 0.5, 0.7]).withColumn("ess", F.round("ess", 4))


@query(
    "y4_joint_ess_events",
    _DRAWS
    + """, j as (select chain, draw, max(value) filter (where param = 'click') as a, max(value) filter (where param = 'view') as b from d group by 1, 2), k as (select * from j where a is not null and b is not null),
p as (select chain, a, b, row_number() over (partition by chain order by draw) - 1 as p, count(*) over (partition by chain) as n from k), t as (select unnest([0.3, 0.5])::double as tau), q as (select *, floor(pow(n, tau)) as size from p cross join t),
m as (select tau, chain, avg(a) as a, avg(b) as b from q where p < floor(n / size) * size group by tau, chain, floor(p / size)),
v as (select tau, (var_samp(a) * var_samp(b) - covar_samp(a, b) ** 2) / count(*) ** 2 as v from m group by tau)
select round(sqrt((var_samp(a) * var_samp(b) - covar_samp(a, b) ** 2) / (select max(v) from v)), 4) as ess from k""",
)
def joint_ess(spark, d):
    return spark.createDataFrame([(round(D.joint_ess(_draws(spark, d), ["click", "view"], [0.3, 0.5]), 4),)], "ess double")


@query("y5_geweke_events", _DRAWS + ", q as (select *, draw / count(*) over (partition by param, chain) as q from d), g as (select param, chain, avg(value) filter (where q < 0.1) as a, avg(value) filter (where q >= 0.5) as b, var_samp(value) filter (where q < 0.1) / count(*) filter (where q < 0.1) as va, var_samp(value) filter (where q >= 0.5) / count(*) filter (where q >= 0.5) as vb from q group by 1, 2) select param, chain, round((a - b) / sqrt(va + vb), 5) as z from g")
def geweke(spark, d):
    return D.geweke(_draws(spark, d)).withColumn("z", F.round("z", 5))


@query("y6_draws_summary_events", _DRAWS + " select param, count(*) as n, round(avg(value), 8) as mean, round(stddev_samp(value), 8) as sd, round(quantile_cont(value, 0.5), 6) as median from d where draw >= 10 and (draw - 10) % 2 = 0 group by 1")
def summary(spark, d):
    return D.draws_summary(_draws(spark, d), 10, 2).select("param", "n", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), F.round("median", 6).alias("median"))


@query("y7_transform_draws_events", _DRAWS + ", w as (select chain, draw, max(value) filter (where param = 'click') as a, max(value) filter (where param = 'view') as b from d group by 1, 2) select chain, draw, 'difference' as param, round(a - b, 6) as value from w")
def transformed(spark, d):
    return D.transform_draws(_draws(spark, d), ["click", "view"], "click - view", "difference").withColumn("value", F.round("value", 6))


@query("h3_simulation_test_lineitem")
def simulated(spark, d):
    fit = linear.ols(_line(spark, d), Design(["l_extendedprice"], [num("l_quantity")]))
    r = D.simulate_test(spark, fit.params, fit.cov, lambda b: b[1], 2000)
    return spark.createDataFrame([(r["value"], r["lo"], r["hi"], r["p"])], "value double, lo double, hi double, p double")


@query("x1_streaming_gram_events", "select round(regr_intercept(value, event_id % 7), 4) as intercept, round(regr_slope(value, event_id % 7), 4) as slope from events where value is not null")
def stream_gram(spark, d):
    source = table(spark, d, "events")
    base = folder(spark)
    root = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    state = stream.withColumn("x", (F.col("event_id") % 7).cast("double"))
    streams.streaming_gram(state, "value", ["x"], f"{root}/state", f"{root}/log").awaitTermination()
    b = streams.running_fit(spark, f"{root}/state", 2)
    return _out(spark, [tuple(map(float, b))], "intercept double, slope double")


@query("x2_windowed_fit_events", "with w as (select date_trunc('day', ts) as window_start, event_type, value as y, event_id % 7 as x from events where value is not null) select window_start, event_type, count(*) as n, round(regr_slope(y, x), 5) as slope from w group by 1, 2 having count(distinct x) > 1")
def windowed(spark, d):
    e = table(spark, d, "events").withColumn("x", (F.col("event_id") % 7).cast("double"))
    return streams.windowed_fit(e, "ts", "value", "x", ["event_type"], "1 day").where("slope is not null").select("window_start", "event_type", "n", F.round("slope", 5).alias("slope"))

