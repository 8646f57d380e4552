"""The exact minimum of the check loss from a near one: rows far from the fit count by their side alone, those near it are few.

Outside a band around the fit, a row's loss changes by its side times its columns, which adds up to one vector a quantile. The
band's rows and that vector are a small linear program; its solution holds for all rows if none outside changed sides, which
another pass counts. If some did, the band is laid around the new fit.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gramlake.operators.linear import solve_scaled
from gramlake.operators.rows import numpy_columns, sum_rows

#: Rows of a band and numbers in it that the driver holds; rounds of bands.
BAND_ROWS, BAND_NUMBERS, ROUNDS = 20_000, 2_000_000, 6
#: Bins of the residuals' sizes, this many to a factor of ten, from the least size on.
_BINS, _TEN, _LEAST = 240, 20, 1e-9


def vertex(x: np.ndarray, r: np.ndarray, w: np.ndarray, g: np.ndarray, tau: float) -> tuple[np.ndarray, bool]:
    """The d that minimises the sum of w check(r - x d) less g d, by descent along edges; rows that have met the fit stay until their prices say otherwise.

    Also whether prices prove it: if the band can't stop a descent, that ends at the band's last row on the way.
    """
    n, p = x.shape
    scale = np.maximum(np.abs(x).max(axis=0), 1e-300)
    x, g = x / scale, g / scale
    d, e, below, held = np.zeros(p), r.copy(), r < 0, []
    free = np.ones(n, bool)
    small, proven = 1e-9 * w.max() + 1e-13 * np.abs(g).max(), False
    for _ in range(200 * p + 2000):
        c = -(x[free] * (w * (tau - below))[free, None]).sum(0) - g
        v, slope, leave = None, 0.0, None
        if held:
            a = x[held]
            inner = np.linalg.pinv(a)
            v = -(c - inner @ (a @ c))
        else:
            v = -c
        slope = c @ v
        if len(held) == p or np.abs(v).max() <= 1e-9 * max(np.abs(c).max(), 1e-300):
            price = c @ inner if held else np.zeros(0)
            sides = np.concatenate([price + w[held] * (1 - tau), -price + w[held] * tau]) if held else np.zeros(1)
            j = int(sides.argmin())
            if not held or sides[j] >= -small:
                proven = True
                break
            leave, slope = j % len(held), sides[j]
            v = inner[:, leave] * (1 if j < len(held) else -1)
        go = x @ v
        if leave is not None:
            out = held.pop(leave)
            free[out], below[out], e[out] = True, j < len(held) + 1, 0.0
        meets = np.flatnonzero(free & np.where(below, go < -1e-14, go > 1e-14))
        if leave is not None:
            meets = meets[meets != out]
        if not len(meets):
            break
        at = np.maximum(e[meets] / go[meets], 0.0)
        order = np.argsort(at, kind="stable")
        rise = slope + np.cumsum((w[meets] * np.abs(go[meets]))[order])
        stop = min(int(np.searchsorted(rise, 0.0)), len(order) - 1)
        k = meets[order[stop]]
        passed = meets[order[:stop]]
        below[passed] = ~below[passed]
        d, e = d + at[order[stop]] * v, e - at[order[stop]] * go
        free[k], e[k] = False, 0.0
        held.append(k)
    return d / scale, proven


def band_rows(p: int, q: int) -> int:
    """Rows of a band at most, for ``q`` quantiles of ``p`` columns."""
    return int(max(min(BAND_ROWS, BAND_NUMBERS // max(p * q, 1)), 4 * p))


def nearer(rows: DataFrame, plan, beta: np.ndarray, taus: np.ndarray, used: np.ndarray, n: float, gram: np.ndarray, h: np.ndarray, most: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Newton's steps over all rows from a sample's fits, one pass each, until what they may still lie off is far within a band; and
    half the width of a band of about half its rows, 0 where that isn't known.

    A sample's error stays the same however many rows there are, while a band narrows with them. The slope of the check loss is
    exact, its curvature that of a kernel of width ``h``, so a step leaves a small part of the error. Steps that go further than the kernel sees or that
    don't shrink by half aren't taken.
    """
    beta, q, p = beta.copy(), len(taus), beta.shape[1]
    open_, last, half = np.ones(q, bool), np.full(q, np.inf), np.zeros(q)
    use = np.ix_(used, used)
    for _ in range(most):
        at = np.flatnonzero(open_)

        def slopes(c, now=beta[at], at=at):
            x, y, w = plan.matrix(c), plan.outcomes(c)[:, 0], c["w"]
            out = []
            for b, t, one in zip(now, taus[at], h[at], strict=True):
                r = y - x @ b
                f = np.exp(-0.5 * (r / one) ** 2)
                out += [[f.sum()], w * (t - (r < 0)) @ x, (x.T @ (x * (w * f)[:, None])).ravel()]
            return np.concatenate(out)

        s = sum_rows(rows, slopes).reshape(len(at), -1)
        for i, v in zip(at, s, strict=True):
            norm = h[i] * np.sqrt(2 * np.pi)
            half[i] = band_rows(p, q) * norm / (4 * max(v[0], 1e-300))
            d = np.zeros(p)
            d[used] = norm * solve_scaled(v[1 + p :].reshape(p, p)[use], v[1 : 1 + p][used])[0]
            size = np.sqrt(max(d @ gram @ d, 0.0) / n)  # the fitted values' move
            if not size <= min(2 * h[i], last[i] / 2):
                open_[i], half[i] = False, 0.0
                continue
            beta[i] += d
            left = size * min(size / last[i] if np.isfinite(last[i]) else 0.05, 0.05)
            open_[i], last[i] = 20 * left > half[i], size
        if not open_.any():
            break
    return beta, half


def settle(rows: DataFrame, plan, beta: np.ndarray, taus: np.ndarray, used: np.ndarray, n: float, rounds: int = ROUNDS, half: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The exact fits from near ones, a row of ``beta`` for each of ``taus``, and which are proven: prices say so, and no row outside
    the last band changed sides. Four passes a round, for all quantiles that aren't proven yet together; the first round takes three where
    the bands' widths are known (``half``) and hold no more rows than they may."""
    beta, p, proven = beta.copy(), beta.shape[1], np.zeros(len(taus), bool)
    keep = band_rows(p, len(taus))

    def resid(c, beta):
        x, y = plan.matrix(c), plan.outcomes(c)[:, 0]
        return x, y[:, None] - x @ beta.T

    for turn in range(rounds):
        open_ = np.flatnonzero(~proven)
        now, tau = beta[open_], taus[open_]
        m = len(open_)
        band, g = np.full(m, np.inf), None

        def outside(c, now=now, tau=tau, band=None):
            x, r = resid(c, now)
            far = np.abs(r) >= band
            return np.concatenate([(~far).sum(0), ((far * c["w"][:, None] * (tau - (r < 0))).T @ x).ravel()])

        if n > keep and turn == 0 and half is not None and (half > 0).all():
            s = sum_rows(rows, functools.partial(outside, band=half))
            if (s[:m] <= keep).all() and (s[:m] > 4 * p).all():
                band, g = half, s[m:].reshape(m, p)
        if n > keep and g is None:

            def sizes(c, now=now, m=m):
                b = np.clip(np.floor(np.log10(np.maximum(np.abs(resid(c, now)[1]), 1e-300) / _LEAST) * _TEN), -1, _BINS * 2 - 1).astype(int) + 1
                return np.stack([np.bincount(b[:, i], minlength=_BINS * 2 + 1) for i in range(m)]).ravel()

            upto = np.cumsum(sum_rows(rows, sizes).reshape(m, -1), axis=1)
            k = (upto <= keep).sum(axis=1)  # the first bin that is too many; 0: too many rows lie on the fit, and its band is empty
            band = np.where(k > 0, _LEAST * 10 ** ((k - 1) / _TEN), 0.0)

        def near(batches, now=now, band=band):
            for batch in batches:
                if batch.num_rows:
                    c = numpy_columns(batch)
                    x, r = resid(c, now)
                    row, which = np.nonzero(np.abs(r) < band)
                    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(r[row, which]), pa.array(c["w"][row]), pa.array(list(x[row]), pa.list_(pa.float64()))], ["i", "r", "w", "x"])

        if g is None:
            g = sum_rows(rows, functools.partial(outside, band=band))[m:].reshape(m, p)
        few = rows.mapInArrow(near, "i int, r double, w double, x array<double>").toArrow().combine_chunks()  # keep rows a quantile at most
        which, r, w = (few.column(c).to_numpy() for c in ("i", "r", "w"))
        x = few.column("x").combine_chunks().flatten().to_numpy().reshape(-1, p) if few.num_rows else np.zeros((0, p))
        priced, moves = np.zeros(m, bool), np.zeros((m, p))
        for i in range(m):
            at = np.flatnonzero(which == i)
            if len(at) > p:
                at = at[np.lexsort([*x[at].T, w[at], r[at]])]  # the same order whatever the partitions
                moves[i, used], priced[i] = vertex(x[at][:, used], r[at], w[at], g[i][used], tau[i])

        def crossed(c, now=now, band=band, moves=moves):
            x, r = resid(c, now)
            return ((np.abs(r) >= band) & ((r < 0) != (r - x @ moves.T < 0))).sum(0)

        beta[open_] += moves
        proven[open_] = priced & (np.isinf(band) | (np.asarray(sum_rows(rows, crossed)) == 0))
        if proven.all() or not moves.any():
            break
    return beta, proven
