"""SQL for the oracles: least squares, Newton steps, robust fits and splines, written out step by step."""

from __future__ import annotations


def gauss_jordan(source: str, k: int, keep: list[str], tag: str = "g") -> tuple[str, str]:
    """CTEs that turn columns a{i}_{j} (symmetric, k x k) and c{i} of ``source`` into the inverse v{i}_{j} and the solution z{i}; and the last one's name."""
    carried = ", ".join(keep) + (", " if keep else "")
    rows = ", ".join([f"a{min(i, j)}_{max(i, j)} as m{i}_{j}" for i in range(k) for j in range(k)] + [f"{float(i == j)}::double as v{i}_{j}" for i in range(k) for j in range(k)] + [f"c{i} as z{i}" for i in range(k)])
    out = [f"{tag}0 as (select {carried}{rows} from {source})"]
    wide = [f"m{{i}}_{j}" for j in range(k)] + [f"v{{i}}_{j}" for j in range(k)] + ["z{i}"]
    for p in range(k):
        part = []
        for i in range(k):
            for w in wide:
                own, top = w.format(i=i), w.format(i=p)
                part.append(f"{own} / m{p}_{p} as {own}" if i == p else f"{own} - m{i}_{p} * {top} / m{p}_{p} as {own}")
        out.append(f"{tag}{p + 1} as (select {carried}{', '.join(part)} from {tag}{p})")
    return ", ".join(out), f"{tag}{k}"


def least_squares(source: str, y: str, x: list[str], keys: list[str] = (), intercept: bool = True, tag: str = "") -> str:
    """CTEs that end in fit{tag}: keys, n, r2, b0.. and s0.. (coefficients and errors), the constant first."""
    k, group = len(x), f" group by {', '.join(keys)}" if keys else ""
    keyed = ", ".join(keys) + (", " if keys else "")
    some = " and ".join(f"{c} is not null" for c in (y, *x))
    cross = (lambda a, b: f"covar_pop({a}, {b}) * count(*)") if intercept else (lambda a, b: f"sum({a} * {b})")
    sums = [f"{cross(x[i], x[j])} as a{i}_{j}" for i in range(k) for j in range(i, k)] + [f"{cross(y, x[i])} as c{i}" for i in range(k)] + [f"avg({x[i]}) as x{i}" for i in range(k)]
    kept = [*keys, "n", "my", "yy", *(f"x{i}" for i in range(k)), *(f"c{i}" for i in range(k))]
    steps, last = gauss_jordan(f"sums{tag}", k, kept, f"g{tag}_")
    free = f"(n - {k + intercept})"
    slopes = [f"z{i} as b{i + intercept}" for i in range(k)]
    errors = [f"sqrt(ssr / {free} * v{i}_{i}) as s{i + intercept}" for i in range(k)]
    if intercept:
        slopes.insert(0, " - ".join(["my", *(f"z{i} * x{i}" for i in range(k))]) + " as b0")
        spread = " + ".join(f"x{i} * x{j} * v{i}_{j}" for i in range(k) for j in range(k))
        errors.insert(0, f"sqrt(ssr / {free} * (1.0 / n + {spread})) as s0")
    return (
        f"sums{tag} as (select {keyed}count(*) as n, avg({y}) as my, {cross(y, y)} as yy, {', '.join(sums)} from {source} where {some}{group}), {steps}, "
        f"rest{tag} as (select *, yy - {' - '.join(f'c{i} * z{i}' for i in range(k))} as ssr from {last}), "
        f"fit{tag} as (select {keyed}n, 1 - ssr / yy as r2, ssr, {', '.join(slopes + errors)} from rest{tag} where n > {k + intercept})"
    )


def newton(source: str, x: list[str], start: list[str], mu: str, score: str, hessian: str, rounds: int = 10, tag: str = "n") -> str:
    """CTEs that end in {tag}{rounds}: one row of b0.. after so many steps on rows ``source`` (columns y, x); eta, mu, y in the formulas."""
    columns, k = ["1.0", *x], len(x) + 1
    eta = " + ".join(f"b{i} * {c}" for i, c in enumerate(columns))
    out = [f"{tag}0 as (select {', '.join(f'{s} as b{i}' for i, s in enumerate(start))})"]
    for r in range(rounds):
        inner = f"select *, {score} as s_, {hessian} as h_ from (select *, {mu} as mu from (select *, {eta} as eta from {source} cross join {tag}{r}))"
        sums = [f"sum(h_ * {columns[i]} * {columns[j]}) as a{i}_{j}" for i in range(k) for j in range(i, k)] + [f"sum(s_ * {columns[i]}) as c{i}" for i in range(k)] + [f"any_value(b{i}) as b{i}" for i in range(k)]
        out.append(f"{tag}{r}s as materialized (select {', '.join(sums)} from ({inner}))")
        steps, last = gauss_jordan(f"{tag}{r}s", k, [f"b{i}" for i in range(k)], f"{tag}{r}g")
        out.append(steps)
        out.append(f"{tag}{r + 1} as materialized (select {', '.join(f'b{i} + z{i} as b{i}' for i in range(k))} from {last})")
    return ", ".join(out)


# Tuning constants of the robust norms, and the weights psi(z) / z and psi'(z) they give.
ROBUST = {
    "HuberT": ("case when abs(z) <= 1.345 then 1.0 else 1.345 / abs(z) end", "(abs(z) <= 1.345)::double"),
    "TukeyBiweight": ("case when abs(z) <= 4.685 then (1 - (z / 4.685) ** 2) ** 2 else 0.0 end", "case when abs(z) <= 4.685 then (1 - (z / 4.685) ** 2) * (1 - 5 * (z / 4.685) ** 2) else 0.0 end"),
    "TrimmedMean": ("(abs(z) <= 2.0)::double", "(abs(z) <= 2.0)::double"),
    "AndrewWave": ("case when abs(z) < 1.339 * pi() then case when z = 0 then 1.0 else sin(z / 1.339) / (z / 1.339) end else 0.0 end", "case when abs(z) < 1.339 * pi() then cos(z / 1.339) else 0.0 end"),
    "RamsayE": ("exp(-0.3 * abs(z))", "exp(-0.3 * abs(z)) * (1 - 0.3 * abs(z))"),
}


def robust(source: str, norm: str, rounds: int = 60) -> str:
    """CTEs that end in r: one row of b0, b1, s (scale), and e: rows with z, w, d (psi') and x. ``source`` has y and x."""
    weight, slope = ROBUST[norm]
    out = [f"d as materialized ({source})"]
    for i in range(rounds):
        w = f"(select *, {weight} as w from (select d.*, (y - b0 - b1 * x) / s as z from d cross join r{i - 1}))" if i else "(select *, 1.0 as w from d)"
        out.append(f"p{i} as materialized (select (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) as b0, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) as b1 from (select sum(w) as sw, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy from {w}))")
        out.append(f"r{i} as materialized (select any_value(b0) as b0, any_value(b1) as b1, quantile_cont(abs(y - b0 - b1 * x), 0.5) / 0.6744897501960817 as s from d cross join p{i})")
    out.append(f"r as (select * from r{rounds - 1})")
    out.append(f"e as (select *, {weight} as w, {slope} as d from (select d.*, s, b0, b1, (y - b0 - b1 * x) / s as z from d cross join r))")
    return ", ".join(out)


ROBUST_SUMS = """, t as (select count(*) as n, any_value(s) as s, any_value(b0) as b0, any_value(b1) as b1, sum(w * w * z * z) as pp, sum(d) as sd, sum(d * d) as sdd, sum(x) as sx, sum(x * x) as sxx, sum(d * x) as dx, sum(d * x * x) as dxx, sum(w * w * z * z * x) as mx, sum(w * w * z * z * x * x) as mxx from e),
u as (select *, sd / n as m, sdd / n - (sd / n) ** 2 as va, pp * s * s / (n - 2) as p2, n * sxx - sx * sx as det, sd * dxx - dx * dx as ded from t),
v as (select *, 1 + 2.0 / n * va / (m * m) as kk, sxx / det as i00, -sx / det as i01, n / det as i11, dxx / ded as w00, -dx / ded as w01, sd / ded as w11 from u)"""


def basis(x: str, knots: list[str], degree: int) -> list[str]:
    """Expressions of the B-spline basis of ``x`` on columns ``knots``, by its recurrence."""
    n = len(knots) - 1
    out = [f"(case when {x} >= {knots[i]} and {x} < {knots[i + 1]} then 1.0 else 0.0 end)" for i in range(n)]
    for d in range(1, degree + 1):
        part = []
        for i in range(n - d):
            left = f"coalesce(({x} - {knots[i]}) / nullif({knots[i + d]} - {knots[i]}, 0), 0) * {out[i]}"
            right = f"coalesce(({knots[i + d + 1]} - {x}) / nullif({knots[i + d + 1]} - {knots[i + 1]}, 0), 0) * {out[i + 1]}"
            part.append(f"({left} + {right})")
        out = part
    return out


def two_sided_p(t: str, free: str) -> str:
    """Two-sided p of Student's t with many degrees of freedom: the normal tail of an adjusted t, by its series."""
    z = f"(abs({t}) * (1 - 1 / (4.0 * {free})) / sqrt(1 + {t} * {t} / (2.0 * {free})))"
    return f"case when {z} > 8 then 0.0 else 1 - 2 / sqrt(2 * pi()) * exp(-{z} * {z} / 2) * list_sum(list_transform(range(0, 120), lambda i_: exp(i_ * ln(2) + lgamma(i_ + 1) - lgamma(2 * i_ + 2) + (2 * i_ + 1) * ln(greatest({z}, 1e-300))))) end"


def t_quantile(free: str, z: float = 1.959963984540054) -> str:
    """The 97.5 % quantile of Student's t with many degrees of freedom, by its expansion around the normal one."""
    return f"({z} + {(z**3 + z) / 4!r} / {free} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96!r} / ({free} * {free}))"


def spline_sql(knots: str, kind: str, bc: str = "", derivative: int = 0) -> str:
    """p_partkey, y: the spline through k (x, y) at each v of p, from CTEs ``knots``: its tridiagonal system by one recursion down and one up."""
    gaps = "s as (select row_number() over (order by x) - 1 as t, count(*) over () as n, x, y, lag(x) over o as x0, lag(y) over o as y0, lead(x) over o as x1, lead(y) over o as y1, lead(x, 2) over o as x2 from k window o as (order by x)), g as (select *, x - x0 as p, x1 - x as h, x2 - x1 as q, (y - y0) / (x - x0) as e, (y1 - y) / (x1 - x) as d from s)"
    if kind == "quadratic":
        ends, inner = "t = 0 or t >= n - 2", ("h / (p + h)", "2 + p / (p + h) + q / (h + q)", "h / (h + q)", "4 * d")
        outer = ("0", "1", "0", "case when t = n - 1 then 0 else d end")
    else:
        ends, inner, outer = "t = 0 or t = n - 1", ("p", "2 * (p + h)", "h", "3 * (d - e)"), ("0", "1", "0", "0")
        if bc == "clamped":
            outer = ("case when t = 0 then 0 else p end", "2 * case when t = 0 then h else p end", "case when t = 0 then h else 0 end", "case when t = 0 then 3 * d else -3 * e end")
        elif bc == "not-a-knot":
            inner = ("case when t = 1 then 0 when t = n - 2 then p - h * h / p else p end", "2 * (p + h) + case when t = 1 then p * (p + h) / h when t = n - 2 then h * (p + h) / p else 0 end", "case when t = n - 2 then 0 when t = 1 then h - p * p / h else h end", "3 * (d - e)")
    lines = ", ".join(f"(case when {ends} then {a} else {b} end)::double as {name}" for name, a, b in zip(("lo", "di", "hi", "r"), outer, inner, strict=True))
    sweep = f"""a as materialized (select t, n, {lines} from g),
down as (select t, di, hi, r from a where t = 0 union all select a.t, a.di - a.lo / b.di * b.hi, a.hi, a.r - a.lo / b.di * b.r from down b join a on a.t = b.t + 1),
dm as materialized (select * from down), up as (select t, r / di as z from dm where t = (select max(t) from dm) union all select b.t, (b.r - b.hi * u.z) / b.di from up u join dm b on b.t = u.t - 1), um as materialized (select * from up)"""
    if kind == "quadratic":
        pieces = "w as (select g.*, z, lag(z) over (order by t) as zb from g join um using (t)), pc as (select case when t = 1 then x0 else (x0 + x) / 2 end as start, x as at, y as a, (zb * h + z * p) / (p + h) as b, (z - zb) / (p + h) as c, 0.0 as d from w where t between 1 and n - 2)"
    else:
        ends = "z"
        if bc == "not-a-knot":
            ends = "case when t = 0 then ((h + q) * lead(z) over o - h * lead(z, 2) over o) / q when t = n - 1 then ((p + p0) * lag(z) over o - p * lag(z, 2) over o) / p0 else z end"
        pieces = f"v as (select g.*, z as z0, lag(p) over (order by t) as p0 from g join um using (t)), m as (select * exclude (z0), z0 as z from v), w0 as (select *, {ends} as c from m window o as (order by t)), w as (select *, lead(c) over (order by t) as cn from w0), pc as (select x as start, x as at, y as a, d - h * (2 * c + cn) / 3 as b, c, (cn - c) / (3 * h) as d from w where t < n - 1)"
    value = ["a + u * (b + u * (c + u * d))", "b + u * (2 * c + 3 * u * d)", "2 * c + 6 * u * d", "6 * d"][derivative]
    return knots.replace("with ", "with recursive ", 1) + f", {gaps}, {sweep}, {pieces}, f as (select * from pc order by start limit 1), j as (select p_partkey, v - coalesce(pc.at, f.at) as u, coalesce(pc.a, f.a) as a, coalesce(pc.b, f.b) as b, coalesce(pc.c, f.c) as c, coalesce(pc.d, f.d) as d from p asof left join pc on v >= pc.start cross join f) select p_partkey, round(({value}) / 7, 4) as y from j"


def quantile_line(source: str, tau: float, tag: str, rounds: int = 20) -> str:
    """CTEs that end in z<tag>: one row of b0, b1, the line of least check loss through ``source`` (x, y).

    The loss with the best intercept is convex in the slope: nine slopes in each of ``rounds`` intervals, every one a quarter of the last; the
    line through the two rows nearest the end is the vertex.
    """
    out = [f"d{tag} as materialized ({source})", f"s{tag}0 as (select -10000.0::double as lo, 10000.0::double as hi)"]
    for i in range(1, rounds + 1):
        out.append(f"q{tag}{i} as materialized (select b1, any_value(width) as width, quantile_disc(y - b1 * x, {tau}) as b0 from d{tag} cross join (select lo + (hi - lo) * j / 8 as b1, (hi - lo) / 8 as width from s{tag}{i - 1} cross join range(9) r(j)) group by b1)")
        out.append(f"s{tag}{i} as materialized (select arg_min(b1, cost) - any_value(width) as lo, arg_min(b1, cost) + any_value(width) as hi from (select b1, any_value(width) as width, sum((y - b0 - b1 * x) * ({tau} - (y - b0 - b1 * x < 0)::int)) as cost from d{tag} cross join q{tag}{i} group by b1))")
    out.append(f"m{tag} as materialized (select b1, (select quantile_disc(y - b1 * x, {tau}) from d{tag} cross join (select (lo + hi) / 2 as b1 from s{tag}{rounds})) as b0 from (select (lo + hi) / 2 as b1 from s{tag}{rounds}))")
    near = f"(select x, arg_min(y, r) as y, min(r) as r from (select x, y, abs(y - b0 - b1 * x) as r from d{tag} cross join m{tag}) group by x order by r limit 2)"
    out.append(f"z{tag} as materialized (select min_by(y, x) - min(x) * (max_by(y, x) - min_by(y, x)) / (max(x) - min(x)) as b0, (max_by(y, x) - min_by(y, x)) / (max(x) - min(x)) as b1 from {near})")
    out.append(f"r{tag} as materialized (select x, {tau}::double as tau, b0, b1, case when abs(y - b0 - b1 * x) < 1e-6 then 0.0 else y - b0 - b1 * x end as r from d{tag} cross join z{tag})")
    return ", ".join(out)
