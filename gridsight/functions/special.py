"""Tail probabilities for small tables of test statistics (published series and continued fractions)."""
import math

import pandas as pd
from pyspark.sql import functions as F

_TINY = 1e-300


def _lentz(step, limit=400):
    """Modified Lentz evaluation; ``step(i)`` yields the i-th (a, b) pair."""
    f, c, d = _TINY, _TINY, 0.0
    for i in range(limit):
        a, b = step(i)
        d = b + a * d or _TINY
        c = b + a / c or _TINY
        d = 1.0 / d
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return f


def beta_inc(a, b, x):
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)

    def step(i):
        if i == 0:
            return 1.0, 1.0 - 0.0
        m, odd = divmod(i, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _lentz(step) / a


def gamma_upper(a, x):
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - scale * total)
    return scale * _lentz(lambda i: (1.0, x + 1 - a) if i == 0 else (-i * (i - a), x + 1 - a + 2 * i))


def f_tail(f, d1, d2):
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_tail(t, df):
    """Two-sided."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def chi2_tail(x, df):
    return gamma_upper(df / 2, x / 2)


def kolmogorov_tail(d, n):
    """Asymptotic, with Stephens' small-sample factor."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


_TAILS = {"f": f_tail, "t": t_tail, "chi2": chi2_tail, "ks": kolmogorov_tail}


def p_value(test, *args):
    """A column with the p-value of a statistic; meant for result tables, not for raw rows."""
    tail = _TAILS[test]

    @F.pandas_udf("double")
    def evaluate(*parts: pd.Series) -> pd.Series:
        rows = zip(*[p.astype("float64") for p in parts])
        return pd.Series([tail(*r) if all(v == v and abs(v) != math.inf for v in r) else None for r in rows], dtype="float64")

    return evaluate(*[a.cast("double") for a in args])
