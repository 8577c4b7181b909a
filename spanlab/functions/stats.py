"""Tail probabilities and exact tests without SciPy, as plain functions and as column functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_sf2(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    if math.isnan(t) or df <= 0:
        return math.nan
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def chi2_sf1(x: float) -> float:
    return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0


def paired_t(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(statistic, two-sided p); NaN where the differences do not vary."""
    d = np.asarray(x, float) - np.asarray(y, float)
    n = len(d)
    if n < 2 or (s := d.std(ddof=1)) == 0:
        return math.nan, math.nan
    t = d.mean() / (s / math.sqrt(n))
    return float(t), t_sf2(float(t), n - 1)


def paired_t_of(d: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """The paired t test of differences d that occur n times each."""
    total = int(n.sum())
    mean = float((d * n).sum() / total)
    spread = float((n * (d - mean) ** 2).sum())
    if total < 2 or spread == 0:
        return math.nan, math.nan
    t = mean / math.sqrt(spread / (total - 1) / total)
    return t, t_sf2(t, total - 1)


def wilcoxon_of(d: np.ndarray, n: np.ndarray, exact_up_to: int = 50) -> tuple[float, float]:
    """The signed-rank test of differences d that occur n times each; as wilcoxon."""
    some = d != 0
    d, n = np.asarray(d, float)[some], np.asarray(n, np.int64)[some]
    total = int(n.sum())
    if total <= exact_up_to:
        return wilcoxon(np.repeat(d, n), np.zeros(total), exact_up_to)
    size, at = np.unique(np.abs(d), return_inverse=True)
    up, down = (np.bincount(at, np.where(keep, n, 0), len(size)) for keep in (d > 0, d < 0))
    ties = up + down
    rank = np.cumsum(ties) - (ties - 1) / 2
    w = min(float((up * rank).sum()), float((down * rank).sum()))
    mean = total * (total + 1) / 4
    var = total * (total + 1) * (2 * total + 1) / 24 - float((ties**3 - ties).sum()) / 48
    return w, float(min(1.0, 2 * normal_sf(abs(w - mean) / math.sqrt(var)))) if var > 0 else 1.0


def average_ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    s = np.asarray(x)[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(s)))
    out = np.empty(len(s))
    out[order] = (first + (size + 1) / 2)[group] if len(s) else []
    return out


def wilcoxon(x: np.ndarray, y: np.ndarray, exact_up_to: int = 50) -> tuple[float, float]:
    """Signed ranks, zeros dropped: exact without ties and up to ``exact_up_to`` pairs, else the normal form with tie correction."""
    d = np.asarray(x, float) - np.asarray(y, float)
    d = d[d != 0]
    n = len(d)
    if n == 0:
        return 0.0, 1.0
    r = average_ranks(np.abs(d))
    plus, minus = float(r[d > 0].sum()), float(r[d < 0].sum())
    w = min(plus, minus)
    _, ties = np.unique(np.abs(d), return_counts=True)
    if n <= exact_up_to and ties.max() == 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return w, float(min(1.0, 2 * ways[: int(w) + 1].sum() / ways.sum()))
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - float((ties.astype(float) ** 3 - ties).sum()) / 48
    return w, float(min(1.0, 2 * normal_sf(abs(w - mean) / math.sqrt(var)))) if var > 0 else 1.0


#: Polynomial coefficients of the W test's weights and of its p-value (AS R94), ascending powers.
W_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
W_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
W_MEAN_SMALL = (0.5440, -0.39978, 0.025054, -6.714e-4)
W_SD_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
W_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
W_SD = (-0.4803, -0.082676, 0.0030302)
W_GAMMA = (-2.273, 0.459)


def _poly(c, x: float) -> float:
    return sum(k * x**i for i, k in enumerate(c))


#: Above so many values the W test's weights, but for EDGE at either end, are summed by integrals instead of one by one.
WHOLE, EDGE = 5000, 64


def _ends_apart(x: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted runs with the EDGE outer ranks as runs of their own, and the ranks before and after the inner runs."""
    cum = np.cumsum(counts)
    inner = np.clip(np.concatenate([[0], cum]), EDGE, n - EDGE)
    outer = [x[np.searchsorted(cum, np.arange(EDGE) + s, side="right")] for s in (0, n - EDGE)]
    one = np.ones(EDGE, np.int64)
    return np.concatenate([outer[0], x, outer[1]]), np.concatenate([one, np.diff(inner), one]), inner


def shapiro(x: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """(W, p) of the Shapiro-Wilk test by Royston's approximation, for 3 values or more; NaN for less or no spread.

    ``counts`` says how often each value occurs.  Above WHOLE values, the weights of a run of equal values are summed by
    the integral over its ranks, so the work is that of the distinct values.  The approximation of p was fitted for up
    to 5000 values and is carried on above them.
    """
    x = np.asarray(x, float)
    counts = np.ones(len(x), np.int64) if counts is None else np.asarray(counts, np.int64)
    order = np.argsort(x, kind="stable")
    x, counts = x[order], counts[order]
    n = int(counts.sum())
    if n < 3 or x[0] == x[-1]:
        return math.nan, math.nan
    at = lambda i: normal_ppf((i - 0.375) / (n + 0.25))
    if n <= WHOLE:
        x, counts = np.repeat(x, counts), np.ones(n, np.int64)
        m = np.array([at(i) for i in range(1, n + 1)])
        ssq = float(m @ m)
    else:
        x, counts, inner = _ends_apart(x, counts, n)
        z = np.array([at(i + 0.5) for i in inner.tolist()])
        density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        ends = np.array([at(i) for i in range(n - EDGE + 1, n + 1)])
        m = np.concatenate([-ends[::-1], -(n + 0.25) * np.diff(density), ends])
        ssq = float(2 * (ends @ ends) + (n - 2 * EDGE) - (n + 0.25) * (z[-1] * density[-1] - z[0] * density[0]))
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        u = 1 / math.sqrt(n)
        last = _poly(W_LAST, u) + m[-1] / math.sqrt(ssq)
        if n > 5:
            second = _poly(W_NEXT, u) + m[-2] / math.sqrt(ssq)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
        a[-1], a[0] = last, -last
    mean = float((x * counts).sum() / n)
    w = min(float((a @ x) ** 2 / (counts * (x - mean) ** 2).sum()), 1.0)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = _poly(W_GAMMA, n)
        if y >= gamma:
            return w, 0.0
        y, mean, sd = -math.log(gamma - y), _poly(W_MEAN_SMALL, n), math.exp(_poly(W_SD_SMALL, n))
    else:
        k = math.log(n)
        mean, sd = _poly(W_MEAN, k), math.exp(_poly(W_SD, k))
    return w, normal_sf((y - mean) / sd)


def mcnemar_p(b: int, c: int) -> float:
    """1 without discordant pairs, exact below 25, else chi-square with continuity correction."""
    n = b + c
    if n == 0:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    return chi2_sf1((abs(b - c) - 1) ** 2 / n)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """The exact two-sided p for up to 60 discordant pairs, as a native expression; 1 without any."""
    n, k = (b + c).cast("double"), F.least(b, c)
    row = F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))
    step = lambda s, i: F.struct((s["term"] * (n - i + 1) / i).alias("term"), (s["sum"] + s["term"] * (n - i + 1) / i).alias("sum"))
    total = F.aggregate(row, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step)["sum"]
    total = F.when(k == 0, 1.0).otherwise(total)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total / F.pow(F.lit(2.0), n)))


def mcnemar(b: Column, c: Column) -> Column:
    """mcnemar_p over columns, as a native expression."""
    n = (b + c).cast("double")
    return F.when(n < 25, mcnemar_exact(b, c)).otherwise(chi2_sf(F.pow(F.abs(b - c) - 1, 2) / n, 1))


#: Steps of the series and of the continued fraction of gamma_q; the fraction's substitute for 0.
GAMMA_STEPS, TINY = 400, 1e-300


def gamma_q(a: float, x: Column) -> Column:
    """The regularized upper incomplete gamma function Q(a, x) as a native expression; 1 for x up to 0, null for null.

    Below a + 1 one less the power series, above it the continued fraction by modified Lentz steps; both stop to change
    after a number of steps in proportion to the root of a, so GAMMA_STEPS do for a up to 1,000.
    """
    x = x.cast("double")
    steps = F.sequence(F.lit(1), F.lit(GAMMA_STEPS))
    front = F.exp(-x + a * F.log(x) - math.lgamma(a))
    term = lambda s, i: s["term"] * x / (a + i)
    series = F.aggregate(steps, F.struct(F.lit(1 / a).alias("term"), F.lit(1 / a).alias("sum")), lambda s, i: F.struct(term(s, i).alias("term"), (s["sum"] + term(s, i)).alias("sum")))["sum"]
    some = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)

    def step(s, i):
        num, b = -i * (i - a), x + 2 * i + 1 - a
        d, c = 1 / some(num * s["d"] + b), some(b + num / s["c"])
        return F.struct(d.alias("d"), c.alias("c"), (s["h"] * d * c).alias("h"))

    begin = 1 / (x + 1 - a)
    fraction = F.aggregate(steps, F.struct(begin.alias("d"), F.lit(1 / TINY).alias("c"), begin.alias("h")), step)["h"]
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(1 - front * series, F.lit(0.0))).when(x.isNotNull(), front * fraction)


def chi2_sf(x: Column, df: int) -> Column:
    """The tail of chi-square with any number of degrees of freedom: exact sums for even ones."""
    if df < 1:
        raise ValueError("chi-square needs a degree of freedom")
    return chi2_sf_even(x, df) if df % 2 == 0 else gamma_q(df / 2, x / 2)


def chi2_sf_even(x: Column, df: int) -> Column:
    """The tail of chi-square with an even number of degrees of freedom, exact."""
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * x / (2 * i)
        total = total + term
    return F.exp(-x / 2) * total
