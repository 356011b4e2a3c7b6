"""Exact Gaussian likelihood of autoregressions, for many series at once (the model part of J5).

An AR(p) of the differences is a state-space model: the state is the last p values, its transition the companion matrix, its start the stationary
distribution. The Kalman filter gives every value's one-step forecast and variance, so the likelihood is exact from the first day on, and missing days
are simply not used. After p days without a gap the variance has settled, and the rest of the likelihood follows from the products of lagged
values, so an evaluation costs nothing per day.

Coefficients are searched as partial autocorrelations, which keeps every step of the search stationary. All arrays have the series in front.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 200


def from_partial(partial: np.ndarray) -> np.ndarray:
    """AR coefficients of partial autocorrelations (Durbin and Levinson)."""
    phi = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        r = partial[:, k : k + 1]
        phi[:, :k] = phi[:, :k] - r * phi[:, :k][:, ::-1]
        phi[:, k] = r[:, 0]
    return phi


def stationary_covariance(phi: np.ndarray) -> np.ndarray:
    """Covariance of p values in a row, for innovations of variance 1: P = T P T' + e1 e1'."""
    s, p = phi.shape
    t = companion(phi)
    both = np.einsum("sij,skl->sikjl", t, t).reshape(s, p * p, p * p)
    noise = np.zeros(p * p)
    noise[0] = 1.0
    return np.linalg.solve(np.eye(p * p) - both, np.broadcast_to(noise, (s, p * p))[..., None])[..., 0].reshape(s, p, p)


def companion(phi: np.ndarray) -> np.ndarray:
    s, p = phi.shape
    t = np.zeros((s, p, p))
    t[:, 0] = phi
    t[:, 1:, :-1] = np.eye(p - 1)
    return t


def kalman(phi: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the days of squared errors by variance and of log variances, the number of days seen, and the last state with its covariance, for innovations
    of variance 1. Missing days are NaN."""
    s, p = phi.shape
    t, state, cov = companion(phi), np.zeros((s, p)), stationary_covariance(phi)
    squares, logs, seen = np.zeros(s), np.zeros(s), np.zeros(s)
    for day in range(values.shape[1]):
        if day:
            state, cov = np.einsum("sij,sj->si", t, state), t @ cov @ t.transpose(0, 2, 1)
            cov[:, 0, 0] += 1.0
        y = values[:, day]
        here = ~np.isnan(y)
        f = cov[:, 0, 0]
        v = np.where(here, y - state[:, 0], 0.0)
        gain = np.where(here[:, None], cov[:, :, 0] / f[:, None], 0.0)
        squares += v * v / f
        logs += np.where(here, np.log(f), 0.0)
        seen += here
        state = state + gain * v[:, None]
        cov = cov - gain[:, :, None] * cov[:, None, 0, :]
    return squares, logs, seen, state, cov


class Likelihood:
    """Log likelihood of a batch of series, with the innovations' variance at its best value."""

    def __init__(self, values: np.ndarray, p: int):
        self.values, self.p = values, p
        self.whole = not np.isnan(values).any()
        n = values.shape[1]
        if self.whole:
            lagged = np.stack([values[:, p - k : n - k] for k in range(p + 1)], 1)
            self.products = lagged @ lagged.transpose(0, 2, 1)

    def parts(self, phi: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.whole:
            return kalman(phi, self.values[own])[:3]
        squares, logs, _seen, _state, _cov = kalman(phi, self.values[own, : self.p])
        weights = np.concatenate([np.ones((len(phi), 1)), -phi], 1)
        squares = squares + np.einsum("si,sij,sj->s", weights, self.products[own], weights)
        return squares, logs, np.full(len(phi), float(self.values.shape[1]))

    def __call__(self, phi: np.ndarray, own: np.ndarray) -> np.ndarray:
        squares, logs, n = self.parts(phi, own)
        return -0.5 * (n * (np.log(2 * np.pi * np.maximum(squares, 1e-300) / n) + 1) + logs)


def fit(values: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, innovation variance and log likelihood at the maximum, by a quasi-Newton search (BFGS) for all series at once.

    ``values`` are series of equal length; each must have more than p + 1 days. Constant series get zeros and a variance of 0."""
    s = len(values)
    like = Likelihood(values, p)
    # The start: partial autocorrelations of the sample autocovariances.
    known = np.nan_to_num(values)
    cov = np.stack([(known[:, k:] * known[:, : known.shape[1] - k]).sum(1) for k in range(p + 1)], 1)
    partial, phi, left = np.zeros((s, p)), np.zeros((s, p)), np.maximum(cov[:, 0], 1e-300)
    for k in range(p):
        r = (cov[:, k + 1] - (phi[:, :k] * cov[:, 1 : k + 1][:, ::-1]).sum(1)) / left
        partial[:, k] = np.clip(r, -0.95, 0.95)
        phi = from_partial(partial)
        left = left * (1 - partial[:, k] ** 2)
    x = np.arctanh(partial)
    every = np.arange(s)
    cost = lambda x, own: -like(from_partial(np.tanh(x)), own)

    def slope(x, own):
        step = 1e-5
        out = np.empty_like(x)
        for k in range(p):
            e = np.zeros(p)
            e[k] = step
            out[:, k] = (cost(x + e, own) - cost(x - e, own)) / (2 * step)
        return out

    live = every[cov[:, 0] > 0]
    value, grad = cost(x[live], live), slope(x[live], live)
    inverse = np.broadcast_to(np.eye(p) / max(values.shape[1], 1), (len(live), p, p)).copy()
    for _ in range(ROUNDS):
        if not len(live):
            break
        move = -np.einsum("sij,sj->si", inverse, grad)
        uphill = (move * grad).sum(1) >= 0
        move[uphill] = -grad[uphill] / values.shape[1]
        size, new, new_value = np.ones(len(live)), x[live].copy(), value.copy()
        open_ = np.ones(len(live), bool)
        for _try in range(30):
            trial = x[live] + size[:, None] * np.clip(move, -2, 2)
            got = cost(trial[open_], live[open_])
            good = got <= value[open_] + 1e-4 * size[open_] * (move * grad).sum(1)[open_]
            at = np.flatnonzero(open_)[good]
            new[at], new_value[at] = trial[at], got[good]
            open_[at] = False
            if not open_.any():
                break
            size[open_] /= 2
        new_grad = slope(new, live)
        d, g = new - x[live], new_grad - grad
        curve = (d * g).sum(1)
        ok = curve > 1e-12
        rho = 1 / np.where(ok, curve, 1.0)
        turn = np.eye(p) - rho[:, None, None] * d[:, :, None] * g[:, None, :]
        inverse = np.where(ok[:, None, None], turn @ inverse @ turn.transpose(0, 2, 1) + rho[:, None, None] * d[:, :, None] * d[:, None, :], inverse)
        done = (np.abs(new_grad).max(1) < 1e-5 * (1 + np.abs(new_value))) | (np.abs(d).max(1) < 1e-10)
        x[live] = new
        live, value, grad, inverse = live[~done], new_value[~done], new_grad[~done], inverse[~done]
    phi = from_partial(np.tanh(x))
    squares, _logs, n = like.parts(phi, every)
    constant = cov[:, 0] <= 0
    phi[constant] = 0.0
    return phi, np.where(constant, 0.0, squares / n), np.where(constant, np.nan, like(phi, every))


def interval_weights(phi: np.ndarray, steps: int) -> np.ndarray:
    """Weights of the innovations in the undifferenced series' forecasts, one step ahead of the next."""
    s, p = phi.shape
    a = np.zeros((s, p + 1))  # (1 - phi(B)) (1 - B)
    a[:, 0] = 1 + phi[:, 0]
    a[:, 1:p] = phi[:, 1:] - phi[:, :-1]
    a[:, p] = -phi[:, p - 1]
    psi = np.zeros((s, steps))
    if steps:
        psi[:, 0] = 1.0
    for j in range(1, steps):
        m = min(j, p + 1)
        psi[:, j] = (a[:, :m] * psi[:, j - m : j][:, ::-1]).sum(1)
    return psi
