"""ARIMA with multiplicative seasonal terms and regressors by exact likelihood: a state-space form and a Kalman filter.

The model is y = X b + u, where u differenced (d times, and D times at the season) is an ARMA process. The filter runs over y
and all columns of X with the same gains, so coefficients follow by least squares on the standardised innovations, and the
scale from their squares; only the ARMA parameters are searched for. The unknown levels that differencing leaves open
are columns of X with a flat prior, so the likelihood of a series without gaps is that of its differences. Missing values
(NaN) are steps without an update. One call fits one resampled series; Spark deals out the series.
"""
import math

import numpy as np


def _polynomial(short, long, season, sign):
    """Coefficients from lag 1 of (1 + sign * short)(1 + sign * long at multiples of the season), times sign."""
    a, b = np.concatenate(([1.0], sign * short)), np.zeros(len(long) * season + 1)
    b[0] = 1.0
    b[season::season] = sign * long
    return sign * np.convolve(a, b)[1:]


def _stable(x):
    """Any real numbers to lag coefficients whose polynomial has all roots outside the unit circle, by way of partial correlations."""
    out = np.zeros(0)
    for r in x / np.sqrt(1 + x * x):
        out = np.append(out - r * out[::-1], r)
    return out


def _stationary_variance(t, q):
    """P with P = T P T' + Q, by doubling."""
    p, a = q.copy(), t.copy()
    for _ in range(60):
        more = a @ p @ a.T
        p, a = p + more, a @ a
        if np.abs(more).max() <= 1e-13 * np.abs(p).max():
            break
    return p


class Sarimax:
    """A model for one series ``y`` (NaN where nothing was observed) and regressors ``x`` of the same length."""

    def __init__(self, y, order=(1, 0, 0), seasonal=(0, 0, 0), season=0, x=None, constant=None):
        (self.p, self.d, self.q), (self.sp, self.sd, self.sq), self.season = order, seasonal, max(1, season)
        self.y = np.asarray(y, dtype=float)
        n = len(self.y)
        step = np.array([1.0])
        for lag, times in ((1, self.d), (self.season, self.sd)):
            for _ in range(times):
                step = np.convolve(step, np.concatenate(([1.0], np.zeros(lag - 1), [-1.0])))
        self.back = -step[1:]
        given = np.zeros((n, 0)) if x is None else np.asarray(x, dtype=float).reshape(n, -1)
        constant = not len(self.back) if constant is None else constant
        # A regressor that does not change cannot be told from the levels.
        fixed = [np.ones(n)] * bool(constant)
        self.used = [j for j in range(given.shape[1]) if np.ptp(given[:, j]) > 0]
        self.x = np.column_stack([self._levels(n), *fixed, given[:, self.used]])
        self.n_levels, self.constant = len(self.back), bool(constant)
        self.size = max(self.p + self.season * self.sp, self.q + self.season * self.sq + 1)

    def _levels(self, n):
        """What each unknown value before the first contributes later on: solutions of the difference equation."""
        k = len(self.back)
        out = np.zeros((n + k, k))
        out[:k] = np.eye(k)
        for t in range(k, n + k):
            out[t] = self.back @ out[t - k:t][::-1]
        return out[k:]

    def coefficients(self, theta):
        """(AR, MA) lag coefficients of the product polynomials."""
        cut = np.split(theta, np.cumsum([self.p, self.q, self.sp]))
        return _polynomial(_stable(cut[0]), _stable(cut[2]), self.season, -1.0), _polynomial(-_stable(cut[1]), -_stable(cut[3]), self.season, 1.0)

    def _system(self, theta):
        ar, ma = self.coefficients(theta)
        r, k = self.size, len(self.back)
        t = np.zeros((r + k, r + k))
        t[:len(ar), 0] = ar
        t[:r - 1, 1:r] += np.eye(r - 1)
        z = np.zeros(r + k)
        z[0], z[r:] = 1.0, self.back
        if k:
            t[r] = z
            t[r + 1:, r:-1] += np.eye(k - 1)
        shock = np.zeros(r + k)
        shock[0], shock[1:1 + len(ma)] = 1.0, ma
        q = np.outer(shock, shock)
        p = np.zeros_like(q)
        p[:r, :r] = _stationary_variance(t[:r, :r], q[:r, :r])
        return t, z, q, p

    def filter(self, theta):
        """(innovations of y and X, their variances, last state, its variance, T, Z, Q); rows without a value have variance NaN."""
        t, z, q, p = self._system(theta)
        data = np.column_stack([self.y, self.x])
        a = np.zeros((len(z), data.shape[1]))
        v, f = np.full(data.shape, np.nan), np.full(len(data), np.nan)
        gain, steady = None, False
        for i, row in enumerate(data):
            if np.isnan(row[0]):
                a, p, steady = t @ a, t @ p @ t.T + q, False
                continue
            if not steady:
                pz = p @ z
                f[i], gain = z @ pz, t @ pz / (z @ pz)
                after = t @ p @ t.T + q - np.outer(gain, gain) * f[i]
                steady, p = np.abs(after - p).max() < 1e-12 * max(1.0, f[i]), after
            else:
                f[i] = f[i - 1]
            v[i] = row - z @ a
            a = t @ a + np.outer(gain, v[i])
        return v, f, a, p, t, z, q

    def evaluate(self, theta):
        """Log-likelihood, scale and coefficients at ARMA parameters ``theta`` (unbounded)."""
        run = self.filter(theta)
        seen = ~np.isnan(run[1])
        root = np.sqrt(run[1][seen])[:, None]
        each = run[0][seen] / root
        e, g = each[:, 0], each[:, 1:]
        beta = np.linalg.lstsq(g, e, rcond=None)[0] if g.shape[1] else np.zeros(0)
        rest = e - g @ beta
        m = max(int(seen.sum()) - self.n_levels, 1)
        scale = max(float(rest @ rest) / m, 1e-300)
        levels = g[:, :self.n_levels]
        flat = np.linalg.slogdet(levels.T @ levels)[1] if self.n_levels else 0.0
        loglik = -0.5 * (m * (math.log(2 * math.pi * scale) + 1) + 2 * float(np.log(root).sum()) + flat)
        return {"loglik": loglik, "scale": scale, "beta": beta, "run": run, "m": m}

    def starts(self):
        """Points to search from: partial correlations of the differenced values, and two plain ones."""
        w = np.where(np.isnan(self.y), np.nanmean(self.y), self.y)
        for lag, times in ((1, self.d), (self.season, self.sd)):
            for _ in range(times):
                w = w[lag:] - w[:-lag]
        w = w - w.mean() if len(w) else w
        c = lambda k: float(w[k:] @ w[:len(w) - k]) / max(float(w @ w), 1e-300) if k < len(w) else 0.0
        r, partial = [1.0] + [c(k) for k in range(1, self.p + 1)], []
        phi = np.zeros(0)
        for k in range(1, self.p + 1):
            last = (r[k] - sum(phi[j] * r[k - 1 - j] for j in range(k - 1))) / max(1 - sum(phi[j] * r[j + 1] for j in range(k - 1)), 1e-6)
            last = min(0.9, max(-0.9, last))
            phi = np.append(phi - last * phi[::-1], last)
            partial.append(last)
        once = [min(0.9, max(-0.9, c(self.season * (j + 1)))) for j in range(self.sp)]
        real = lambda some: [x / math.sqrt(1 - x * x) for x in some]
        yield np.array(real(partial) + [0.0] * self.q + real(once) + [0.0] * self.sq)
        if self.q + self.sq:
            yield np.array([0.1] * self.p + [-0.2] * self.q + real(once) + [0.3] * self.sq)
            yield np.array([0.5] * self.p + [0.3] * self.q + [0.5] * self.sp + [0.3] * self.sq)

    def fit(self, rounds=40):
        """Search the best parameters; keeps them and what ``evaluate`` says about them."""
        def loss(theta):
            with np.errstate(all="ignore"):
                try:
                    value = -self.evaluate(theta)["loglik"] / max(len(self.y), 1)
                except np.linalg.LinAlgError:
                    return 1e10
            return value if math.isfinite(value) else 1e10

        found = [minimise(loss, start, rounds) for start in sorted(self.starts(), key=loss)[:2]]
        self.theta = min(found, key=lambda f: f[1])[0]
        self.at = self.evaluate(self.theta)
        return self

    def summary(self):
        """(aic, bic, mae, mse) of the fit; errors are one-step errors after the levels are known."""
        at = self.at
        k = len(self.theta) + len(at["beta"]) - self.n_levels + 1
        v = at["run"][0]
        e = v[:, 0] - v[:, 1:] @ at["beta"]
        e = e[~np.isnan(e)][self.n_levels:]
        return 2 * k - 2 * at["loglik"], k * math.log(at["m"]) - 2 * at["loglik"], float(np.abs(e).mean()) if len(e) else 0.0, float((e * e).mean()) if len(e) else 0.0

    def forecast(self, h, x=None):
        """(means, variances) of the next ``h`` values; ``x`` has a row of regressors for each."""
        at = self.at
        _, _, a, p, t, z, q = at["run"]
        given = np.zeros((h, 0)) if x is None else np.asarray(x, dtype=float).reshape(h, -1)[:, self.used]
        ahead = np.column_stack([self._levels(len(self.y) + h)[len(self.y):], np.ones((h, int(self.constant))), given])
        state = a[:, 0] - a[:, 1:] @ at["beta"]
        mean, variance = np.zeros(h), np.zeros(h)
        for i in range(h):
            mean[i], variance[i] = z @ state + ahead[i] @ at["beta"], at["scale"] * (z @ p @ z)
            state, p = t @ state, t @ p @ t.T + q
        return mean, variance


def minimise(f, start, rounds=40, least=1e-8):
    """Quasi-Newton descent (BFGS) with numeric slopes and step halving: (place, value)."""
    x, fx = start.copy(), f(start)
    if not len(x):
        return x, fx

    def slope(x, fx):
        out = np.zeros(len(x))
        for i in range(len(x)):
            step = np.zeros(len(x))
            step[i] = 1e-6 * max(1.0, abs(x[i]))
            out[i] = (f(x + step) - fx) / step[i]
        return out

    g, inverse = slope(x, fx), np.eye(len(x))
    for _ in range(rounds):
        way = -inverse @ g
        if way @ g >= 0:
            inverse, way = np.eye(len(x)), -g
        way *= min(1.0, 2.0 / max(np.abs(way).max(), 1e-12))
        size = 1.0
        while size > 1e-8 and f(x + size * way) > fx + 1e-4 * size * (g @ way):
            size /= 2
        moved = size * way
        fnew = f(x + moved)
        if fnew >= fx - least:
            return (x + moved, fnew) if fnew < fx else (x, fx)
        gnew = slope(x + moved, fnew)
        dg = gnew - g
        s = moved @ dg
        if s > 1e-12:
            left = np.eye(len(x)) - np.outer(moved, dg) / s
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / s
        x, fx, g = x + moved, fnew, gnew
    return x, fx
