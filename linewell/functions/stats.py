"""Probability helpers: column expressions, and numpy kernels for the vectorised UDFs."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 coefficients, lowest power of t first.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
MARGIN_LO, MARGIN_HI = -80, 80
TOTAL_LO, TOTAL_HI = 0, 130


def erf(x: Column) -> Column:
    z = F.abs(x)
    t = 1 / (1 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-z * z))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / F.lit(float(np.sqrt(2)))))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss(p: Column, y: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def squared_error(p: Column, y: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return (q - y) * (q - y)


# ---------------------------------------------------------------- numpy kernels (inside tasks only)

def np_normal_cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x) / np.sqrt(2.0)
    t = 1 / (1 + ERF_P * z)
    poly = np.zeros_like(z)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return 0.5 * (1 + np.sign(x) * (1 - poly * np.exp(-z * z)))


def np_outcome_pmf(mu: np.ndarray, sd: np.ndarray, weights: np.ndarray, lo: int) -> np.ndarray:
    """Row-wise pmf over the integers ``lo ..``: normal mass per integer, re-weighted, normalised."""
    edges = lo - 0.5 + np.arange(weights.shape[1] + 1)
    mass = np.diff(np_normal_cdf((edges[None, :] - mu[:, None]) / sd[:, None]), axis=1) * weights
    return mass / mass.sum(axis=1, keepdims=True)


def np_over_push(mu, sd, weights, line, lo: int) -> tuple[np.ndarray, np.ndarray]:
    """(P(over | no push), P(push)) per row."""
    pmf = np_outcome_pmf(mu, sd, weights, lo)
    k = lo + np.arange(weights.shape[1])
    over = np.where(k[None, :] > line[:, None], pmf, 0.0).sum(axis=1)
    under = np.where(k[None, :] < line[:, None], pmf, 0.0).sum(axis=1)
    push = np.where(k[None, :] == line[:, None], pmf, 0.0).sum(axis=1)
    return over / (over + under), push


def np_implied_mean(line, p, sd, weights, is_total) -> np.ndarray:
    """Mean at which P(over the line | no push) equals ``p``: 50 halvings of a fixed bracket."""
    out = np.full(len(line), np.nan)
    for flag, lo_k, lo, hi in ((False, MARGIN_LO, -60.0, 60.0), (True, TOTAL_LO, 5.0, 125.0)):
        m = (is_total == flag) & ~np.isnan(line) & ~np.isnan(p)
        if not m.any():
            continue
        w = np.stack([np.asarray(x, float) for x in weights[m]])
        target, ln, s = np.clip(p[m], 1e-4, 1 - 1e-4), line[m], sd[m]
        a, b = np.full(m.sum(), lo), np.full(m.sum(), hi)
        for _ in range(50):
            mid = (a + b) / 2
            low = np_over_push(mid, s, w, ln, lo_k)[0] < target
            a, b = np.where(low, mid, a), np.where(low, b, mid)
        out[m] = (a + b) / 2
    return out


# ---------------------------------------------------------------- kernels for rows of one distribution

SLICE_ROWS = 256      # rows whose outcome masses stay in a processor's cache


def _cdf_in_place(x: np.ndarray) -> np.ndarray:
    """``np_normal_cdf`` with few temporaries."""
    z = np.abs(x)
    z /= np.sqrt(2.0)
    t = z * ERF_P
    t += 1
    np.divide(1, t, out=t)
    poly = np.zeros_like(z)
    for a in reversed(ERF_A):
        poly += a
        poly *= t
    np.multiply(z, z, out=z)
    np.negative(z, out=z)
    poly *= np.exp(z, out=z)
    np.subtract(1, poly, out=poly)
    poly *= np.sign(x, out=x)
    poly += 1
    poly *= 0.5
    return poly


def over_push_of(mu: np.ndarray, line: np.ndarray, sd: float, weights: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray]:
    """``np_over_push`` for rows of one distribution: a slice at a time, and both sides of the line from one running sum."""
    n = len(weights)
    edges = (lo - 0.5 + np.arange(n + 1))[:, None]
    first, last = ((np.clip(f(line), lo - 1, lo + n) - lo).astype(np.int64) for f in (np.ceil, np.floor))
    first, last = np.clip(first, 0, n), np.clip(last + 1, 0, n)     # outcomes below the line, and up to it
    cond, push = np.empty(len(mu)), np.empty(len(mu))
    for i in range(0, len(mu), SLICE_ROWS):
        s = slice(i, i + SLICE_ROWS)
        x = edges - mu[s]
        x /= sd
        c = _cdf_in_place(x)
        mass = c[1:] - c[:-1]
        mass *= weights[:, None]
        upto = np.zeros_like(c)
        np.cumsum(mass, axis=0, out=upto[1:])
        at = np.arange(upto.shape[1])
        under, below, total = upto[first[s], at], upto[last[s], at], upto[-1]
        with np.errstate(invalid="ignore", divide="ignore"):
            cond[s], push[s] = (total - below) / (total - below + under), (below - under) / total
    return cond, push


def implied_mean_of(line: np.ndarray, p: np.ndarray, sd: float, weights: np.ndarray, is_total: bool) -> np.ndarray:
    """``np_implied_mean`` for rows of one distribution, to 1e-8.

    Log odds are nearly linear in the mean, so a secant inside the same bracket takes some five steps where halving takes 50. A row
    that it has not settled (no mean in the bracket gives ``p``, or a flat end) goes on by halving what is left of its bracket.
    """
    lo_k, lo, hi = (TOTAL_LO, 5.0, 125.0) if is_total else (MARGIN_LO, -60.0, 60.0)
    target = np.clip(p, 1e-4, 1 - 1e-4)
    want = np.log(target / (1 - target))
    out, a, b = np.full(len(line), np.nan), np.full(len(line), lo), np.full(len(line), hi)
    slope = np.full(len(line), 1.7 / sd)
    x = np.clip(line + want / slope, lo, hi)
    old_x, old_g = np.full(len(line), np.nan), np.full(len(line), np.nan)
    live = np.flatnonzero(~np.isnan(line) & ~np.isnan(p))
    for step in range(64):
        if not len(live):
            break
        now = x[live]
        f = over_push_of(now, line[live], sd, weights, lo_k)[0]
        low = f < target[live]
        a[live], b[live] = np.where(low, now, a[live]), np.where(low, b[live], now)
        if step < 12:
            with np.errstate(invalid="ignore", divide="ignore"):
                g = np.log(f / (1 - f)) - want[live]
                steep = (g - old_g[live]) / (now - old_x[live])
                slope[live] = np.where(np.isfinite(steep) & (steep > 0), steep, slope[live])
                ahead = now - g / slope[live]
            old_x[live], old_g[live] = now, g
            settled = np.abs(ahead - now) <= 1e-9
            out[live[settled]] = np.clip(ahead, a[live], b[live])[settled]
            inside = (ahead > a[live]) & (ahead < b[live])
            x[live] = np.where(inside, ahead, (a[live] + b[live]) / 2)
            live = live[~settled]
        else:
            x[live] = (a[live] + b[live]) / 2
    out[live] = (a[live] + b[live]) / 2
    return out


def distinct_rows(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one index of each distinct row, the number of every row's distinct row) over columns without NaN."""
    order = np.lexsort(cols)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        sorted_c = c[order]
        new[1:] |= sorted_c[1:] != sorted_c[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number
