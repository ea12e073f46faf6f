"""Seasonal ARIMA by the exact likelihood of its state-space form, and the augmented Dickey-Fuller test. For short series: one group's is a task's."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def polynomial(phi: float, seasonal: float, season: int) -> np.ndarray:
    """AR coefficients by lag, from lag 1, of (1 - phi B)(1 - seasonal B^season)."""
    whole = np.convolve([1.0, -phi], np.eye(1, season + 1)[0] - seasonal * np.eye(1, season + 1, season)[0])
    return -whole[1:]


def differenced(y: np.ndarray, season: int) -> np.ndarray:
    w = np.diff(y)
    return w[season:] - w[:-season]


def kalman(z: np.ndarray, ar: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Innovations and their variances (in units of the noise's) of a stationary ARMA series with one MA term, from the stationary initial state."""
    size = max(len(ar), 2)
    move = np.zeros((size, size))
    move[: len(ar), 0] = ar
    move[:-1, 1:] += np.eye(size - 1)
    noise = np.zeros(size)
    noise[:2] = 1.0, theta
    noise = np.outer(noise, noise)
    cover = np.linalg.solve(np.eye(size * size) - np.kron(move, move), noise.ravel()).reshape(size, size)
    state, gaps, spread = np.zeros(size), np.empty(len(z)), np.empty(len(z))
    for t, value in enumerate(z):
        gaps[t], spread[t] = value - state[0], cover[0, 0]
        gain = move @ cover[:, 0] / spread[t]
        state = move @ state + gain * gaps[t]
        cover = move @ cover @ move.T + noise - np.outer(gain, gain) * spread[t]
    return gaps, spread


def log_likelihood(z: np.ndarray, ar: np.ndarray, theta: float) -> tuple[float, float]:
    """The Gaussian log-likelihood at the best noise variance, and that variance."""
    gaps, spread = kalman(z, ar, theta)
    variance = max(float(np.mean(gaps**2 / spread)), 1e-300)
    return -0.5 * (len(z) * (math.log(2 * math.pi * variance) + 1) + float(np.log(spread).sum())), variance


def searched(f, at: np.ndarray, step: float = 0.5, least: float = 1e-4) -> np.ndarray:
    """A minimum near ``at`` by the simplex method of Nelder and Mead."""
    corners = [at, *(at + step * e for e in np.eye(len(at)))]
    points = sorted(((f(c), tuple(c)) for c in corners))
    for _ in range(400):
        best, worst = points[0], points[-1]
        if max(np.abs(np.subtract(p[1], best[1])).max() for p in points) < least:
            break
        centre = np.mean([p[1] for p in points[:-1]], 0)
        along = lambda k: (f(c := centre + k * (centre - np.array(worst[1]))), tuple(c))
        new = along(1.0)
        if new[0] < best[0]:
            new = min(new, along(2.0))
        elif new[0] >= points[-2][0]:
            new = min(new, along(0.5), along(-0.5))
            if new[0] >= worst[0]:
                points = sorted([best, *((f(c := (np.array(p[1]) + best[1]) / 2), tuple(c)) for p in points[1:])])
                continue
        points = sorted([*points[:-1], new])
    return np.array(points[0][1])


@dataclass
class Fit:
    """Of order (1, 1, 1) with a seasonal part (1, 1, 0)."""

    phi: float
    seasonal: float
    theta: float
    variance: float
    likelihood: float
    season: int
    y: np.ndarray

    @property
    def _n(self) -> int:
        return len(self.y) - self.season - 1

    @property
    def aic(self) -> float:
        return 2 * 4 - 2 * self.likelihood

    @property
    def bic(self) -> float:
        return 4 * math.log(self._n) - 2 * self.likelihood

    def fitted(self) -> np.ndarray:
        """One-step predictions of the observed values; NaN where differences don't reach."""
        gaps, _ = kalman(differenced(self.y, self.season), polynomial(self.phi, self.seasonal, self.season), self.theta)
        return np.concatenate((np.full(self.season + 1, np.nan), self.y[self.season + 1 :] - gaps))

    def forecast(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and standard errors; errors grow by the weights that past noise has in the series itself."""
        ar = polynomial(self.phi, self.seasonal, self.season)
        z = differenced(self.y, self.season)
        gaps, spread = kalman(z, ar, self.theta)
        known, ahead = list(z), list(self.y)
        for h in range(1, steps + 1):
            last = self.theta * gaps[-1] / spread[-1] if h == 1 else 0.0
            known.append(float(sum(a * known[-k] for k, a in enumerate(ar, 1) if k <= len(known))) + last)
            ahead.append(ahead[-1] + ahead[-self.season] - ahead[-self.season - 1] + known[-1])
        whole = np.convolve(np.convolve(np.concatenate(([1.0], -ar)), [1.0, -1.0]), np.eye(1, self.season + 1)[0] - np.eye(1, self.season + 1, self.season)[0])
        psi = [1.0]
        for j in range(1, steps):
            psi.append((self.theta if j == 1 else 0.0) - sum(whole[k] * psi[j - k] for k in range(1, min(j, len(whole) - 1) + 1)))
        return np.array(ahead[len(self.y) :]), np.sqrt(self.variance * np.cumsum(np.square(psi)))


def fit(y: np.ndarray, season: int = 4) -> Fit:
    """The most likely parameters, from several starts; each stays inside (-1, 1), so the series of differences is stationary and invertible."""
    y = np.asarray(y, float)
    z = differenced(y, season)
    scale = float(np.sqrt(np.mean(z**2))) or 1.0

    def loss(at: np.ndarray) -> float:
        phi, seasonal, theta = 0.995 * np.tanh(at)
        return -log_likelihood(z / scale, polynomial(phi, seasonal, season), theta)[0]

    starts = ([0.0, 0.0, 0.0], [0.5, -0.5, -0.8], [-0.5, -0.5, 0.5])
    best = min((searched(loss, np.array(s)) for s in starts), key=loss)
    phi, seasonal, theta = (float(v) for v in 0.995 * np.tanh(best))
    likelihood, variance = log_likelihood(z, polynomial(phi, seasonal, season), theta)
    return Fit(phi, seasonal, theta, variance, likelihood, season, y)


#: MacKinnon's surface for a regression with a constant (fixed values): below -1.61 and above, by powers of the statistic.
_SMALL, _LARGE, _TURN, _FLOOR, _CEILING = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61, -18.83, 2.74


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    found = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = float(((y - x @ found) ** 2).sum())
    return found, rest, np.linalg.pinv(x.T @ x)


def dickey_fuller(y: np.ndarray) -> tuple[float, float]:
    """The augmented Dickey-Fuller statistic of a series with a constant, and its approximate p; NaN where the series is too short or constant. Lags are chosen by AIC on a common sample."""
    y = np.asarray(y, float)
    n = len(y)
    most = min(int(12 * (n / 100) ** 0.25), n // 2 - 3)
    if most < 0 or np.ptp(y) == 0:
        return math.nan, math.nan
    step = np.diff(y)

    def regression(lags: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
        target = step[drop:]
        return np.column_stack([y[drop:-1], *(step[drop - k : len(step) - k] for k in range(1, lags + 1)), np.ones(len(target))]), target

    def aic(lags: int) -> float:
        x, target = regression(lags, most)
        return len(target) * math.log(max(_least_squares(x, target)[1], 1e-300) / len(target)) + 2 * x.shape[1]

    x, target = regression(lags := min(range(most + 1), key=aic), lags)
    found, rest, inverse = _least_squares(x, target)
    error = math.sqrt(max(rest / max(len(target) - x.shape[1], 1) * inverse[0, 0], 1e-300))
    tau = float(found[0] / error)
    if tau > _CEILING or tau < _FLOOR:
        return tau, float(tau > _CEILING)
    z = sum(c * tau**k for k, c in enumerate(_SMALL if tau <= _TURN else _LARGE))
    return tau, 0.5 * math.erfc(-z / math.sqrt(2))
