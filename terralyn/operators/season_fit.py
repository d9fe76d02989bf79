"""Least-squares fits of the periodic double logistic to a curve of at most a few hundred days.

The fit is a bounded Levenberg-Marquardt search with the model's own derivatives. It works on heights, rates, the day of
the rise, the length up to the fall and the share of it at which one turns into the other, each within a box, and goes on
from a grid of starts, all of them as one batch of arrays.
"""

from __future__ import annotations

import itertools

import numpy as np

from terralyn.functions.curves import BLEND, LEAST, YEAR

PARAMETERS = ["high", "rise", "up", "fall", "down", "between"]
#: Rates of a rise and of a fall, greatest height, days beyond the data that a fit may use.
RISES, FALLS, MOST_HIGH, BEYOND = (0.03, 0.40), (0.03, 1.20), 1.2, 120
#: Share of the peak at a season's feet, observations for a shape, least R2 and range of a good fit.
FOOT, SHAPE_POINTS, GOOD, LEAST_RANGE = 0.2, 6, 0.9, 0.05
#: Shares of a rate's range, on a scale of factors, that starts take; rounds of the search; bisections of a foot.
RATES, ROUNDS, HALVINGS = (0.2, 0.5, 0.8), 80, 40
FITTED = [*PARAMETERS, "r2", "rmse", "sos", "eos", "max_residual"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _named(box: np.ndarray) -> np.ndarray:
    """PARAMETERS from what the search works on: (high, rise, up, fall, length, turn), one row each."""
    high, rise, up, fall, length, turn = box.T
    return np.stack([high, rise, up, fall, up + length, up + turn * length], axis=1)


def season_curves(t: np.ndarray, p: np.ndarray, slopes: bool = False):
    """Values of each row of parameters at days t, and their derivatives by what the search works on where slopes are asked for.

    Equals functions.curves.double_logistic: a season is seen in its own year, the one before and the one after.
    """
    day = (np.asarray(t, float)[None, :] + np.array([-YEAR, 0.0, YEAR])[:, None])[None]
    high, rise, up, fall, down, between = (c[:, None, None] for c in np.atleast_2d(p).T)
    late, grown, green = _sigmoid((day - between) / BLEND), _sigmoid(rise * (day - up)), _sigmoid(fall * (down - day))
    shape = (1 - late) * grown + late * green
    total = (high * shape).sum(axis=1)
    value = np.clip(total, LEAST, 1 - LEAST)
    if not slopes:
        return value
    by_rise, by_fall = high * (1 - late) * grown * (1 - grown), high * late * green * (1 - green)
    by_turn = high * (grown - green) * late * (1 - late) / BLEND
    length, turn = down - up, (between - up) / (down - up)
    out = np.stack([shape, by_rise * (day - up), by_fall * fall - by_rise * rise + by_turn, by_fall * (down - day), by_fall * fall + turn * by_turn, length * by_turn], axis=-1).sum(axis=1)
    return value, np.where((total == value)[..., None], out, 0.0)


def season_curve(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    return season_curves(t, p)[0]


def search(t: np.ndarray, y: np.ndarray, box: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared errors) that the search comes to from each start, within the box low .. high."""
    box = np.clip(box, low, high)
    damp = np.full(len(box), 1e-2)
    value, slope = season_curves(t, _named(box), True)
    miss = value - y
    cost = (miss**2).sum(axis=1)
    for _ in range(ROUNDS):
        pull = np.einsum("sni,sn->si", slope, miss)
        held = ((box <= low) & (pull > 0)) | ((box >= high) & (pull < 0))
        free = ~held
        square = np.einsum("sni,snj->sij", slope, slope) * free[:, :, None] * free[:, None, :]
        scale = np.maximum(np.einsum("sii->si", square), 1e-9)
        square[:, np.arange(6), np.arange(6)] += damp[:, None] * scale + held
        step = -np.linalg.solve(square, (pull * free)[..., None])[..., 0]
        there = np.clip(box + step, low, high)
        new, slopes = season_curves(t, _named(there), True)
        lower = ((new - y) ** 2).sum(axis=1)
        better = lower < cost
        gain = np.where(better, cost - lower, 0.0)
        box[better], miss[better], slope[better] = there[better], (new - y)[better], slopes[better]
        cost = np.where(better, lower, cost)
        damp = np.clip(np.where(better, damp / 4, damp * 5), 1e-9, 1e9)
        if (gain <= 1e-12 * cost).all() and (damp > 1e6).all():
            break
    return box, cost


def _halfway(t: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The days around the peak at which the data pass the middle of their range, between observations in a line."""
    top, half = int(y.argmax()), (y.min() + y.max()) / 2
    before, after = np.flatnonzero(y[: top + 1] < half), np.flatnonzero(y[top:] < half) + top
    cross = lambda a, b: t[a] + (t[b] - t[a]) * (half - y[a]) / (y[b] - y[a])
    return (float(cross(before[-1], before[-1] + 1)) if len(before) else float(t[0]), float(cross(after[0] - 1, after[0])) if len(after) else float(t[-1]))


def starts(t: np.ndarray, y: np.ndarray, window: tuple[float, float, float]) -> np.ndarray:
    """A grid of starts: rises and falls where the window and where the data have them, at three rates each."""
    start, peak, end = window
    rise, fall = _halfway(t, y)
    rates = [[lo * (hi / lo) ** share for share in RATES] for lo, hi in (RISES, FALLS)]
    rows = itertools.product({rise, (start + peak) / 2}, {fall, (peak + end) / 2}, *rates)
    return np.array([[max(y.max(), 0.05), up_rate, up, down_rate, max(down - up, 5.0), 0.5] for up, down, up_rate, down_rate in rows])


def feet(p: np.ndarray, first: float, last: float) -> tuple[float, float]:
    """The days before and after its peak at which a season passes FOOT of it, halved down to far under a second."""
    days = np.arange(np.floor(first - BEYOND), last + BEYOND + 1)
    value = season_curve(days, p)
    top = int(value.argmax())
    foot = FOOT * value[top]

    def halved(inside: float, outside: float) -> float:
        for _ in range(HALVINGS):
            middle = (inside + outside) / 2
            if season_curve(np.array([middle]), p)[0] < foot:
                outside = middle
            else:
                inside = middle
        return float(inside)

    before, after = np.flatnonzero(value[:top] < foot), np.flatnonzero(value[top:] < foot) + top
    own = np.log((1 - FOOT) / FOOT)  # a lone logistic's way from its middle to the foot
    sos = halved(days[before[-1] + 1], days[before[-1]]) if len(before) else p[2] - own / p[1]
    eos = halved(days[after[0] - 1], days[after[0]]) if len(after) else p[4] + own / p[3]
    return float(sos), float(eos)


def fit_curve(t: np.ndarray, y: np.ndarray, window: tuple[float, float, float] | None = None) -> dict:
    """The season that fits best around a window (start, peak, end), and how far to trust it.

    Without a window it is the span of the data. Under SHAPE_POINTS observations the window itself is the season, as a poor fit.
    """
    known = np.isfinite(t) & np.isfinite(y)
    t, y = t[known].astype(float), y[known].astype(float)
    n = len(t)
    if window is None:
        window = (t.min(), t[y.argmax()], t.max()) if n else (0.0, 0.0, 0.0)
    start, peak, end = map(float, window)
    peak = peak if start < peak < end else (start + end) / 2
    out = {"n": n, "dof": n - len(PARAMETERS), "confidence": "low", "poor_fit": True}
    if n < SHAPE_POINTS:
        p = np.array([max(y.max(initial=0.0), 0.05), 0.1, (start + peak) / 2, 0.1, (peak + end) / 2, peak])
        return dict.fromkeys(FITTED) | dict(zip(PARAMETERS, p.tolist(), strict=True)) | out | {"sos": start, "eos": end}
    low = np.array([0.02, RISES[0], t.min() - BEYOND, FALLS[0], 1.0, 0.02])
    high = np.array([MOST_HIGH, RISES[1], t.max() + BEYOND, FALLS[1], t.max() - t.min() + BEYOND, 0.98])
    found, cost = search(t, y, starts(t, y, (start, peak, end)), low, high)
    p = _named(found[[int(cost.argmin())]])[0]
    miss = season_curve(t, p) - y
    error = float(miss @ miss)
    out |= {"r2": 1 - error / max(float(((y - y.mean()) ** 2).sum()), 1e-12), "rmse": float(np.sqrt(error / n)), "max_residual": float(np.abs(miss).max())}
    out["poor_fit"] = bool(out["r2"] < GOOD or np.ptp(y) < LEAST_RANGE)
    if not out["poor_fit"] and out["dof"] >= 2:
        out["confidence"] = "high" if out["rmse"] < 0.03 else "medium"
    sos, eos = feet(p, t.min(), t.max())
    return dict(zip(PARAMETERS, p.tolist(), strict=True)) | out | {"sos": sos, "eos": eos}
