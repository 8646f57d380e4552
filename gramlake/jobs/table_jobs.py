"""Aggregates, joins, windows, functions and result tables over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramlake.functions import columns as C
from gramlake.jobs.solve_sql import least_squares, spline_sql, t_quantile, two_sided_p
from gramlake.operators import aggregates, joins, linear, splines, tables, windows
from gramlake.operators.terms import Design, num
from gramlake.sources.tables import read_table, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("s1_read_orders", "select o_orderkey, o_custkey, o_totalprice from orders")
def read_orders(spark, d):
    return read_table(spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_totalprice"])


@query("a3_merge_moments_orders", "select count(*) as n, round(avg(o_totalprice), 4) as mean, round(var_pop(o_totalprice) * count(*) / 1e9, 3) as m2 from orders")
def merged(spark, d):
    v = F.col("o_totalprice")
    batches = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 16).alias("batch")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("m2"))
    return aggregates.merge_moments(batches).select("n", F.round("mean", 4).alias("mean"), F.round(F.col("m2") / 1e9, 3).alias("m2"))


@query("a4_weighted_moments_lineitem", "select l_returnflag, count(*) as n, round(sum(l_quantity), 4) as sw, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) as mean, round(sum(l_quantity * l_discount * l_discount), 4) as raw_ss from lineitem where l_quantity > 0 group by 1")
def moments(spark, d):
    return aggregates.weighted_moments(table(spark, d, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"]).select("l_returnflag", "n", F.round("sw", 4).alias("sw"), F.round("mean", 8).alias("mean"), F.round("raw_ss", 4).alias("raw_ss"))


@query("a5_histogram_orders", "with c as (select greatest(least(cast(floor((o_totalprice - 0.0) / 20000) as int), 19), 0) as bin, count(*) as n from orders group by 1) select cast(i as int) as bin, cast(i * 20000.0 as double) as \"left\", coalesce(n, 0) as count from range(20) t(i) left join c on i = bin")
def hist(spark, d):
    return aggregates.histogram(table(spark, d, "orders"), "o_totalprice", 0.0, 400000.0, 20)


@query("a6_mad_scale_orders", "select round(quantile_cont(abs(o_totalprice - 150000), 0.5) / 0.6744897501960817, 4) as scale from orders")
def mad(spark, d):
    return spark.createDataFrame([(round(aggregates.mad_scale(table(spark, d, "orders"), F.col("o_totalprice") - 150000), 4),)], "scale double")


@query("a7_fit_norm_events", "select event_type, round(avg(value), 6) as loc, round(stddev_pop(value), 6) as scale from events where value is not null group by 1")
def fit_norm(spark, d):
    return aggregates.fit_distribution(table(spark, d, "events"), "value", "norm", ["event_type"]).select("event_type", F.round("loc", 6).alias("loc"), F.round("scale", 6).alias("scale"))


@query("a7_fit_expon_events", "select event_type, round(min(value), 6) as loc, round(avg(value) - min(value), 6) as scale from events where value is not null group by 1")
def fit_expon(spark, d):
    return aggregates.fit_distribution(table(spark, d, "events"), "value", "expon", ["event_type"]).select("event_type", F.round("loc", 6).alias("loc"), F.round("scale", 6).alias("scale"))


@query("a7_fit_lognorm_orders", "select o_orderpriority, round(stddev_pop(ln(o_totalprice)), 6) as s, round(exp(avg(ln(o_totalprice))), 3) as scale from orders where o_totalprice > 0 group by 1")
def fit_lognorm(spark, d):
    return aggregates.fit_distribution(table(spark, d, "orders"), "o_totalprice", "lognorm", ["o_orderpriority"]).select("o_orderpriority", F.round("s", 6).alias("s"), F.round("scale", 3).alias("scale"))


@query("a7_fit_t_events")
def fit_t(spark, d):
    r = aggregates.fit_t(table(spark, d, "events"), "value", iterations=25)
    return spark.createDataFrame([(float(r["df"]), float(r["loc"]), float(r["scale"]))], "df double, loc double, scale double")


@query("a8_distribution_curve_orders", "with p as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders) select round(i * 4000.0::double, 4) as x, round(exp(-0.5 * ((i * 4000.0 - m) / s) ** 2) / (s * sqrt(2 * pi())) * 1e6, 6) as pdf_e6 from range(101) t(i) cross join p")
def curve(spark, d):
    p = aggregates.fit_distribution(table(spark, d, "orders"), "o_totalprice", "norm").first()
    return aggregates.distribution_curve(spark, "norm", 0.0, 400000.0, 101, loc=p.loc, scale=p["scale"]).select(F.round("x", 4).alias("x"), F.round(F.col("pdf") * 1e6, 6).alias("pdf_e6"))


@query("a9_hdi_events", "with q as (select event_type, quantile_cont(value, [" + ", ".join(repr(i / 100) for i in range(101)) + "]) as q from events where value is not null group by 1), w as (select event_type, i, q[i + 90] - q[i] as w, q[i] as lo, q[i + 90] as hi from q, range(1, 12) t(i)), r as (select *, row_number() over (partition by event_type order by w, lo) as k from w) select event_type, round(lo, 6) as lo, round(hi, 6) as hi from r where k = 1")
def intervals(spark, d):
    return aggregates.hdi(table(spark, d, "events"), "value", 0.9, ["event_type"], points=101).select("event_type", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("a10_within_between_r2_lineitem", "with g as (select l_suppkey, avg(l_extendedprice) as my, avg(l_quantity) as mx from lineitem group by 1), c as (select l_extendedprice - my as y, l_quantity - mx as x from lineitem join g using (l_suppkey)) select round((select power(sum(x * y), 2) / (sum(x * x) * sum(y * y)) from c), 8) as r2_within, round((select power(corr(my, mx), 2) from g), 8) as r2_between")
def r2_parts(spark, d):
    out = aggregates.within_between_r2(table(spark, d, "lineitem"), "l_extendedprice", ["l_suppkey"], "l_quantity")
    return out.select(F.round("r2_within", 8).alias("r2_within"), F.round("r2_between", 8).alias("r2_between"))


@query("j1_merge_tables_nations", "select n_nationkey as k, count_c, count_s from (select n_nationkey from nation) left join (select c_nationkey as n_nationkey, count(*) as count_c from customer group by 1) using (n_nationkey) left join (select s_nationkey as n_nationkey, count(*) as count_s from supplier group by 1) using (n_nationkey)")
def merge_nations(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("count_c"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("count_s"))
    return joins.merge_tables([n, c, s], ["k"], "left")


_KNOTS = "with p as (select p_partkey, p_partkey + 0.5::double as v from part), k as (select cast(l_partkey as double) as x, avg(l_extendedprice) as y from lineitem group by 1)"


def _halves(spark, d):
    """Places between the knots, one for each part."""
    return table(spark, d, "part").select("p_partkey", (F.col("p_partkey") + 0.5).alias("v"))


def _knots(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("double").alias("x")).agg(F.avg("l_extendedprice").alias("y"))


@query("j4_interpolate_previous_part", _KNOTS + " select p_partkey, round(y / 7, 4) as y from p asof left join k on v >= k.x")
def previous(spark, d):
    return joins.interpolate(_halves(spark, d), "v", _knots(spark, d), "x", "y", "previous").select("p_partkey", F.round(F.col("y") / 7, 4).alias("y"))


@query("j4_interpolate_linear_part", _KNOTS + ", a as (select p_partkey, v, k.x as x0, k.y as y0 from p asof left join k on v >= k.x), b as (select p_partkey, k.x as x1, k.y as y1 from p asof left join k on v <= k.x) select p_partkey, round(case when x0 = x1 then y0 else y0 + (y1 - y0) * (v - x0) / (x1 - x0) end / 7, 4) as y from a join b using (p_partkey)")
def linear_knots(spark, d):
    return joins.interpolate(_halves(spark, d), "v", _knots(spark, d), "x", "y", "linear").select("p_partkey", F.round(F.col("y") / 7, 4).alias("y"))


@query("j5_spline_part", spline_sql(_KNOTS, "cubic", "not-a-knot"))
def spline(spark, d):
    return _scaled(joins.spline_eval(_halves(spark, d), "v", _knots(spark, d), "x", "y"))


@query("j5_natural_slope_part", spline_sql(_KNOTS, "cubic", "natural", 1))
def natural_slope(spark, d):
    return _scaled(joins.spline_eval(_halves(spark, d), "v", _knots(spark, d), "x", "y", "natural", 1))


@query("j5_quadratic_part", spline_sql(_KNOTS, "quadratic"))
def quadratic(spark, d):
    return _scaled(joins.spline_eval(_halves(spark, d), "v", _knots(spark, d), "x", "y", kind="quadratic"))


@query("j5_clamped_blocks_part", spline_sql(_KNOTS, "cubic", "clamped", 2))
def clamped_blocks(spark, d):
    """The second derivative by blocks, as for tables of knots beyond the broadcast."""
    pieces = splines.pieces(_knots(spark, d), "cubic", "clamped", 1000)
    return _scaled(splines.evaluate(_halves(spark, d), "v", pieces, 2))


def _scaled(df):
    return df.select("p_partkey", F.round(F.col("y") / 7, 4).alias("y"))


_THREE = "with " + least_squares("lineitem", "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]) + ", t as (select t.term, t.b as coef, t.s as std_err, t.b / t.s as t, n - 4.0 as free from fit, lateral (values ('Intercept', b0, s0), ('l_quantity', b1, s1), ('l_discount', b2, s2), ('l_tax', b3, s3)) as t(term, b, s))"


@query("o1_coef_table_lineitem", _THREE + f", p as (select *, {two_sided_p('t', 'free')} as p, {t_quantile('free')} as q from t) select term, round(coef, 3) as coef, round(std_err, 3) as std_err, round(t, 3) as t, round(p, 3) as p, round(coef - q * std_err, 3) as ci_lo, round(coef + q * std_err, 3) as ci_hi from p order by p.p, term limit 3")
def coefs(spark, d):
    fit = linear.ols(table(spark, d, "lineitem"), Design(["l_extendedprice"], [num("l_quantity"), num("l_discount"), num("l_tax")]))
    return tables.coef_table(fit.table(spark), "p", top=3).select("term", *[F.round(c, 3).alias(c) for c in ("coef", "std_err", "t", "p", "ci_lo", "ci_hi")])


@query("o2_benjamini_hochberg_lineitem", "with p as (select l_suppkey, (l_suppkey * 7919 % 1009) / 100900.0 as p from (select distinct l_suppkey from lineitem)), r as (select *, row_number() over (order by p) as bh_rank, count(*) over () as m from p) select l_suppkey, bh_rank, p <= 0.05 * bh_rank / m as bh_flag, bh_rank <= (select coalesce(max(bh_rank), 0) from r where p <= 0.05 * bh_rank / m) as bh_reject from r")
def bh(spark, d):
    p = table(spark, d, "lineitem").select("l_suppkey").distinct().withColumn("p", (F.col("l_suppkey") * 7919 % 1009) / 100900.0)
    return tables.benjamini_hochberg(p, "p").select("l_suppkey", "bh_rank", "bh_flag", "bh_reject")


@query("o3_sample_rows_orders")
def sample(spark, d):
    return tables.sample_rows(table(spark, d, "orders"), 1000, ["o_orderkey"])


@query("u1_stack_equations_nations", "select n_nationkey as k, 'a' as equation, n_name as a_name, cast(null as varchar) as b_name from nation union all select r_regionkey, 'b', null, r_name from region")
def stacked(spark, d):
    return tables.stack_equations({"a": table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), "b": table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))}, ["k"])


@query("u2_compare_fits_lineitem", "select 'l_quantity' as term, round(regr_slope(l_extendedprice, l_quantity), 3) as price, round(regr_slope(l_tax, l_quantity) * 1e6, 3) as tax from lineitem")
def compared(spark, d):
    df = table(spark, d, "lineitem").withColumn("tax_e6", F.col("l_tax") * 1e6)
    fits = {n: linear.ols(df, Design([y], [num("l_quantity")])).table(spark) for n, y in (("price", "l_extendedprice"), ("tax", "tax_e6"))}
    return tables.compare_fits(fits).where("term = 'l_quantity'").select("term", F.round("price", 3).alias("price"), F.round("tax", 3).alias("tax"))


@query("w1_lags_events", "select event_id, lag(value) over w as value_l1, lag(value, 2) over w as value_l2, lead(value) over w as value_lf1 from events window w as (partition by user_id order by ts, event_id)")
def lagged(spark, d):
    return windows.lags(table(spark, d, "events"), "value", [1, 2, -1], ["user_id"], ["ts", "event_id"]).select("event_id", "value_l1", "value_l2", "value_lf1")


@query("w2_difference_events", "with e as (select *, row_number() over w as t, value - lag(value) over w as v from events window w as (partition by user_id order by ts, event_id)), f as (select *, v - lag(v, 3) over (partition by user_id order by ts, event_id) as u from e) select event_id, round(u, 8) as value from f where t > 4")
def differenced(spark, d):
    return windows.difference(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], 1, 1, 3).select("event_id", F.round("value", 8).alias("value"))


@query("w3_time_index_events", "select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as t from events")
def indexed(spark, d):
    return windows.time_index(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", F.col("t").cast("long").alias("t"))


@query("w3_global_index_events", "select event_id, row_number() over (order by ts, event_id) - 1 as t from events")
def global_indexed(spark, d):
    return windows.global_index(table(spark, d, "events"), ["ts", "event_id"]).select("event_id", "t")


@query("f1_logit_functions_lineitem", "select l_orderkey, l_linenumber, round(ln((l_discount + 0.01) / (1 - l_discount - 0.01)), 8) as logit, round(1 / (1 + exp(-l_tax * 10)), 8) as expit, round(exp(-l_tax * 10) / power(1 + exp(-l_tax * 10), 2), 8) as d_expit, round(ln(exp(-l_tax * 10) / power(1 + exp(-l_tax * 10), 2)), 8) as log_d_expit from lineitem")
def logits(spark, d):
    x = F.col("l_tax") * 10
    values = {"logit": C.logit(F.col("l_discount") + 0.01), "expit": C.expit(x), "d_expit": C.d_expit(x), "log_d_expit": C.log_d_expit(x)}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(v, 8).alias(k) for k, v in values.items()])


@query("f2_special_functions_lineitem", "select l_orderkey, l_linenumber, round(lgamma(l_quantity), 6) as gammaln, round(gamma(l_discount + 1), 6) as gamma from lineitem")
def specials(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.special_function("gammaln", F.col("l_quantity")), 6).alias("gammaln"), F.round(C.special_function("gamma", F.col("l_discount") + 1), 6).alias("gamma"))


@query("f3_normal_functions_events", "select event_id, round(exp(-0.5 * value * value) / sqrt(2 * pi()), 8) as pdf, round(-0.5 * value * value - 0.5 * ln(2 * pi()), 6) as logpdf from events")
def normals(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(C.pdf("norm", v), 8).alias("pdf"), F.round(C.logpdf("norm", v), 6).alias("logpdf"))


_X = "(l_quantity / 10.0)"


@query("f4_densities_lineitem", f"select l_orderkey, l_linenumber, round(exp(-{_X}), 8) as expon, round(0.5 * exp(-{_X}), 8) as laplace, round(1 / (pi() * (1 + {_X} ** 2)), 8) as cauchy, round({_X} ** 2 * exp(-{_X}) / 2, 8) as gamma3, round({_X} * exp(-({_X} ** 2) / 2), 8) as rayleigh, round(2 / (pi() * (1 + {_X} ** 2)), 8) as halfcauchy, round({_X} * exp(-{_X} / 2) / 4, 8) as chi2_4, round(gamma(3) / (sqrt(5 * pi()) * gamma(2.5)) * (1 + {_X} ** 2 / 5) ** -3, 8) as t5 from lineitem")
def densities(spark, d):
    x = F.col("l_quantity") / 10.0
    values = {"expon": C.pdf("expon", x), "laplace": C.pdf("laplace", x), "cauchy": C.pdf("cauchy", x), "gamma3": C.pdf("gamma", x, a=3), "rayleigh": C.pdf("weibull_min", x, scale=F.lit(2**0.5), c=2), "halfcauchy": C.pdf("halfcauchy", x), "chi2_4": C.pdf("chi2", x, df=4), "t5": C.pdf("t", x, df=5)}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(v, 8).alias(k) for k, v in values.items()])


@query("f5_mvn_logpdf_lineitem", "select l_orderkey, l_linenumber, round(-ln(2 * pi()) - 0.5 * ln(0.75) - 0.5 * (power(l_tax, 2) - l_tax * l_discount + power(l_discount, 2)) / 0.75, 8) as logpdf from lineitem")
def mvn(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.mvn_logpdf(F.array("l_tax", "l_discount"), [0, 0], [[1, 0.5], [0.5, 1]]), 8).alias("logpdf"))


@query("f6_kernels_lineitem", "with u as (select l_orderkey, l_linenumber, l_quantity / 25.0 - 1 as u from lineitem) select l_orderkey, l_linenumber, round(0.75 * (1 - u * u), 8) as epanechnikov, round(exp(-u * u / 2) / sqrt(2 * pi()), 8) as gaussian, round(15 / 16.0 * (1 - u * u) ** 2, 8) as biweight, round(35 / 32.0 * (1 - u * u) ** 3, 8) as triweight, round(1 - abs(u), 8) as triangular, round(70 / 81.0 * (1 - abs(u) ** 3) ** 3, 8) as tricube, round(pi() / 4 * cos(pi() / 2 * u), 8) as cosine from u")
def kernels(spark, d):
    u = F.col("l_quantity") / 25.0 - 1
    names = ["epanechnikov", "gaussian", "biweight", "triweight", "triangular", "tricube", "cosine"]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(C.kernel(k, u), 8).alias(k) for k in names])


@query("f7_robust_norms_lineitem", "with z as (select l_orderkey, l_linenumber, l_quantity / 5.0 - 5 as z from lineitem) select l_orderkey, l_linenumber, round(case when abs(z) <= 1.345 then 1 else 1.345 / abs(z) end, 8) as \"HuberT\", round(case when abs(z) <= 4.685 then (1 - (z / 4.685) ** 2) ** 2 else 0 end, 8) as \"TukeyBiweight\", round(case when abs(z) <= 2 then 1.0 else 0.0 end::double, 8) as \"TrimmedMean\", round(exp(-0.3 * abs(z)), 8) as \"RamsayE\", round(case when z = 0 then 1 when abs(z) < 1.339 * pi() then sin(z / 1.339) / (z / 1.339) else 0 end, 8) as \"AndrewWave\" from z")
def norms(spark, d):
    z = F.col("l_quantity") / 5.0 - 5
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(C.robust_weight(k, z), 8).alias(k) for k in ("HuberT", "TukeyBiweight", "TrimmedMean", "RamsayE", "AndrewWave")])
