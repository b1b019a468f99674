"""Numbers of tables of dishes in a Pitman-Yor restaurant, drawn from their posterior.

A dish with c customers has t tables with a weight of S(c, t), the generalised Stirling
number of the discount, times base (strength + discount (others + i)) for each table i
beyond the first. Up to EXACT customers the ratios S(c, t + 1) / S(c, t) are those of the
recurrence, and the draw is exact. Beyond, they are those of the saddle point
approximation of c! / (t! discount^t) [x^c] (1 - (1 - x)^discount)^t, corrected by its
error at the last exact row: where tables are few, that error depends on their number
and hardly on c, and where they are many it vanishes.
"""

from __future__ import annotations

import numpy as np

from skein.llm.common import kept

#: Customers up to which ratios are computed by recurrence.
EXACT = 1024
#: Places at which the weights of many customers are computed, coarse and fine.
COARSE, FINE, KNOTS = 129, 1025, 33
#: Logs of weights so far below the largest are nothing.
NOTHING = 40.0


def log_stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers: weights of c customers at t tables, up to EXACT."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = s[1, 1] = 0.0
    for c in range(1, EXACT):
        stay = s[c, 1 : c + 1] + np.log(c - np.arange(1, c + 1) * discount)
        s[c + 1, 1 : c + 1] = np.logaddexp(s[c, :c], stay)
        s[c + 1, c + 1] = s[c, c]
    return s


def saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Log of [x^c] (1 - (1 - x)^discount)^t by saddle point, for t < c."""
    target, low, high = np.log(c / t), np.full(np.broadcast(c, t).shape, -700.0), np.full(np.broadcast(c, t).shape, -1e-9)
    for _ in range(60):  # y = log(1 - x) where x f'(x) / f(x) is c / t
        y = (low + high) / 2
        above = np.log(-np.expm1(y)) + np.log(discount) + (discount - 1) * y - np.log(-np.expm1(discount * y)) > target
        low, high = np.where(above, y, low), np.where(above, high, y)
    y = (low + high) / 2
    spread = c * (1 - c / t + (1 - discount) * np.expm1(-y))
    return t * np.log(-np.expm1(discount * y)) - c * np.log(-np.expm1(y)) - 0.5 * np.log(np.maximum(spread, 1e-9))


def rough_ratios(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    return saddle(c, t + 1, discount) - saddle(c, t, discount) - np.log((t + 1) * discount)


class Restaurant:
    """What draws with one discount share."""

    def __init__(self, discount: float, strength: float):
        self.discount, self.strength = discount, strength
        stirling = log_stirling(discount)
        #: For each c up to EXACT the logs of S(c, t + 1) / S(c, t), t from 1 to c - 1.
        self.ratios = [np.diff(stirling[c, 1 : c + 1]) for c in range(EXACT + 1)]
        at = np.arange(1.0, EXACT // 2)
        self.error = self.ratios[EXACT][: EXACT // 2 - 1] - rough_ratios(np.full(len(at), float(EXACT)), at, discount)
        self.error_at = np.log(at)

    def gains(self, c: np.ndarray, t: np.ndarray, others: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Log of the weight of t + 1 tables over that of t, beyond EXACT customers."""
        t = np.minimum(np.maximum(t, 1.0), c - 2.0)
        ratio = rough_ratios(c, t, self.discount) + np.interp(np.log(t), self.error_at, self.error, right=0.0)
        return ratio + np.log(self.strength + self.discount * (others + t)) + np.log(base)

    def draw(self, count: np.ndarray, others: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of each dish given its customers, the other tables of its restaurant and the parent's probability."""
        tables = np.minimum(count, 1)
        order = np.argsort(count, kind="stable")
        order = order[np.searchsorted(count[order], 2) :]
        sizes, starts = np.unique(count[order], return_index=True)
        for c, start, stop in zip(sizes.tolist(), starts, [*starts[1:], len(order)], strict=False):
            at = order[start:stop]
            if c > EXACT:
                break
            for part in np.array_split(at, len(at) * c // 1_000_000 + 1):
                gain = self.ratios[c] + np.log(self.strength + self.discount * (others[part, None] + np.arange(1, c))) + np.log(base[part, None])
                p = np.concatenate((np.zeros((len(part), 1)), np.cumsum(gain, axis=1)), axis=1)
                p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
                tables[part] = 1 + (rng.random(len(part))[:, None] * p[:, -1:] > p).sum(axis=1)
        large = order[np.searchsorted(count[order], EXACT, side="right") :]
        for part in np.array_split(large, len(large) // 256 + 1):
            if len(part):
                tables[part] = self._draw_many(*(x[part].astype(float)[:, None] for x in (count, others, base)), rng)
        return tables

    def _draw_many(self, c: np.ndarray, others: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The same for dishes of many customers (columns): weights are computed where they matter."""
        low, high = np.ones_like(c), c - 1
        for _ in range(2):  # the whole range by powers, then what is left of it
            power = np.linspace(0, 1, COARSE)[None, :]
            t = low * (high / low) ** power
            gain = self.gains(c, t, others, base)
            weight = np.concatenate((np.zeros_like(c), np.cumsum((gain[:, 1:] + gain[:, :-1]) / 2 * np.diff(t, axis=1), axis=1)), axis=1)
            near = weight > weight.max(axis=1, keepdims=True) - NOTHING
            first, last = near.argmax(axis=1), COARSE - 1 - near[:, ::-1].argmax(axis=1)
            row = np.arange(len(c))
            low, high = np.floor(t[row, np.maximum(first - 1, 0)])[:, None], np.minimum(np.ceil(t[row, np.minimum(last + 1, COARSE - 1)])[:, None] + 1, c)
        # Gains change smoothly: they are taken at a few knots and carried to every place between.
        step = np.maximum(1.0, np.ceil((high - low) / (FINE - 1)))
        t = np.minimum(low + step * np.arange(FINE)[None, :], high)
        knots = low + (high - low) * np.linspace(0, 1, KNOTS)[None, :]
        known = self.gains(c, knots, others, base)
        out = np.empty(len(c), np.int64)
        for i in range(len(c)):
            at, stride = t[i][: int((high[i, 0] - low[i, 0]) // step[i, 0]) + 1], step[i, 0]
            middle = np.interp(at[:-1] + (stride - 1) / 2, knots[i], known[i])
            p = np.concatenate(([0.0], np.cumsum(middle * stride)))
            p = np.cumsum(np.exp(p - p.max()))
            drawn = at[int((rng.random() * p[-1] > p).sum())]
            out[i] = min(drawn + rng.integers(int(stride)), c[i, 0])
        return out


def draw_tables(count: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish given its customers, the other tables of its restaurant and the parent's probability."""
    return kept(f"restaurant-{discount}-{strength}", lambda: Restaurant(discount, strength)).draw(count, others, base, rng)
