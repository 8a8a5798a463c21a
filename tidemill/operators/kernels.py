"""Kernels: recurrences and moving windows over one key's rows, a run of rows at a time as numpy arrays.

A kernel has a state and `run(*inputs)`, which takes the next rows' inputs and gives their outputs as a tuple of arrays; how
rows are cut into runs changes nothing but the last bits. Linear recurrences are scans of affine maps, moving sums and
extremes are prefixes and suffixes of blocks of one period, so that their time doesn't grow with the period and no value is
ever taken out of a sum. What branches on its own last result goes row by row (`Machine`, `Rows`)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NAN = float("nan")
#: Runs shorter than this aren't worth the numpy calls.
SHORT, BLOCK = 64, 32
#: Values of windows that are looked at together.
SHEET = 1 << 20


class Rows:
    """A kernel of a function that takes one row's inputs and returns one row's outputs."""

    def __init__(self, step: Callable[..., tuple]):
        self.step = step

    def run(self, *inputs: np.ndarray) -> tuple[np.ndarray, ...]:
        step = self.step
        rows = [step(*x) for x in zip(*[i.tolist() for i in inputs], strict=True)]
        return tuple(np.array(x, np.float64) for x in zip(*rows, strict=True))


class Machine:
    """A kernel of a function that takes its state, a list of numbers that it may change, and one row's inputs. All that a
    machine keeps is in the list, so that it can stop in one task and go on in another."""

    def __init__(self, step: Callable[..., tuple], begin: list[float]):
        self.step, self.held = step, [float(v) for v in begin]

    def run(self, *inputs: np.ndarray) -> tuple[np.ndarray, ...]:
        step, held = self.step, self.held
        rows = [step(held, *x) for x in zip(*[i.tolist() for i in inputs], strict=True)]
        return tuple(np.array(x, np.float64) for x in zip(*rows, strict=True))

    def state(self) -> list[float]:
        return [float(v) for v in self.held]

    def restore(self, state: list[float]) -> None:
        self.held = list(state)


# Affine recurrences


def fixed_scan(x: np.ndarray, a: float, value: float) -> np.ndarray:
    """y = a * x + (1 - a) * y for each row, from y = value."""
    n, keep = len(x), 1 - a
    whole = n // BLOCK if n >= SHORT and value - value == 0 and np.isfinite(x).all() else 0
    out = np.empty(n)
    if whole:
        powers = keep ** np.arange(BLOCK + 1)
        back = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
        weights = np.where(back >= 0, a * powers[np.maximum(back, 0)], 0.0)
        own = x[: whole * BLOCK].reshape(whole, BLOCK) @ weights.T
        came, step = np.empty(whole), float(powers[BLOCK])
        for k, end in enumerate(own[:, -1].tolist()):
            came[k] = value
            value = step * value + end
        out[: whole * BLOCK] = (own + came[:, None] * powers[1:]).ravel()
    for i, v in enumerate(x[whole * BLOCK :].tolist(), whole * BLOCK):
        value = a * v + keep * value
        out[i] = value
        if value != value:
            out[i:] = NAN
            break
    return out


def affine_scan(keep: np.ndarray, add: np.ndarray, value: float) -> np.ndarray:
    """y = keep * y + add for each row, from y = value: maps of 1, 2, 4, ... rows are joined."""
    keep, out = keep.astype(np.float64), add.astype(np.float64)
    far = 1
    while far < len(out):
        out[far:] = out[far:] + keep[far:] * out[:-far]
        keep[far:] = keep[far:] * keep[:-far]
        far *= 2
    return out + keep * value


class Smoother:
    """Exponential smoothing seeded with the mean of n values from row `start` on, or from the first valid value (None). A NaN
    in the seed or later stays. The seed is summed with compensation."""

    def __init__(self, alpha: float, n: int, start: int | None = 0):
        self.alpha, self.n = alpha, n
        self.wait = start  # rows to come before the first, None: up to a valid value
        self.seen, self.total, self.lost, self.value = 0, 0.0, 0.0, NAN

    def run(self, x: np.ndarray) -> tuple[np.ndarray]:
        out, at = np.full(len(x), NAN), 0
        if self.wait is None:
            valid = np.flatnonzero(x == x)
            at = int(valid[0]) if len(valid) else len(x)
            self.wait = 0 if len(valid) else None
        elif self.wait:
            at = min(self.wait, len(x))
            self.wait -= at
        while self.seen < self.n and at < len(x):
            v = float(x[at])
            new = self.total + v
            self.lost += (self.total - new) + v if abs(self.total) >= abs(v) else (v - new) + self.total
            self.total, self.seen, at = new, self.seen + 1, at + 1
            if self.seen == self.n:
                self.value = out[at - 1] = (self.total + self.lost) / self.n
        if at < len(x):
            out[at:] = fixed_scan(x[at:], self.alpha, self.value)
            self.value = float(out[-1])
        return (out,)


class Chain:
    """Smoothers of smoothers, each seeded at the first valid value of the one before; an output for each."""

    def __init__(self, alpha: float, n: int, times: int):
        self.each = [Smoother(alpha, n, 0 if k == 0 else None) for k in range(times)]

    def run(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        out = []
        for one in self.each:
            (x,) = one.run(x)
            out.append(x)
        return tuple(out)


class Strength:
    """Relative strength: smoothed gains against smoothed losses, from the first valid value on. No moves: 50, no falls: 100,
    no rises: 0."""

    def __init__(self, n: int):
        self.before: float | None = None
        self.up, self.down = Smoother(1 / n, n), Smoother(1 / n, n)

    def run(self, x: np.ndarray) -> tuple[np.ndarray]:
        out, at = np.full(len(x), NAN), 0
        if self.before is None:
            valid = np.flatnonzero(x == x)
            if not len(valid):
                return (out,)
            at, self.before = int(valid[0]) + 1, float(x[valid[0]])
        if at == len(x):
            return (out,)
        with np.errstate(invalid="ignore", divide="ignore"):
            moves = np.diff(x[at:], prepend=self.before)
            self.before = float(x[-1])
            none = moves * 0
            (up,), (down,) = self.up.run(np.where(moves > 0, moves, none)), self.down.run(np.where(moves < 0, -moves, none))
            value = np.where(up > 0, 100 - 100 / (1 + up / down), 0.0)
        value = np.where(down == 0, np.where(up > 0, 100.0, 50.0), value)
        out[at:] = np.where(np.isnan(up) | np.isnan(down), NAN, value)
        return (out,)


class FromMarker:
    """Smoothers of several inputs that begin together: at the first valid marker, but not before the second row."""

    def __init__(self, alpha: float, n: int, outputs: int):
        self.rows, self.begun = 0, False
        self.each = [Smoother(alpha, n) for _ in range(outputs)]

    def run(self, marker: np.ndarray, *inputs: np.ndarray) -> tuple[np.ndarray, ...]:
        at = 0
        if not self.begun:
            valid = np.flatnonzero(marker == marker)
            at = int(valid[0]) if len(valid) else len(marker)
            self.begun = bool(len(valid))
        at = max(at, 1 - self.rows)
        self.rows += len(marker)
        return tuple(np.concatenate([np.full(min(at, len(x)), NAN), one.run(x[at:])[0]]) for one, x in zip(self.each, inputs, strict=True))


class Adaptive:
    """y = gain * x + (1 - gain) * y with a gain for each row; y is x at the first row that `begins`, NaN before."""

    def __init__(self, gain: Callable[..., tuple[np.ndarray, np.ndarray]]):
        """gain(row numbers, *inputs): where the series may begin, and the gains (NaN: from there on NaN)."""
        self.gain, self.rows, self.value, self.begun = gain, 0, NAN, False

    def run(self, x: np.ndarray, *inputs: np.ndarray) -> tuple[np.ndarray]:
        begins, gain = self.gain(self.rows + np.arange(len(x)), x, *inputs)
        self.rows += len(x)
        out, at = np.full(len(x), NAN), 0
        if not self.begun:
            first = np.flatnonzero(begins)
            if not len(first):
                return (out,)
            at, self.begun = int(first[0]) + 1, True
            self.value = out[at - 1] = float(x[at - 1])
        if at < len(x):
            out[at:] = affine_scan(1 - gain[at:], gain[at:] * x[at:], self.value)
            self.value = float(out[-1])
        return (out,)


class Streak:
    """Rows in a row that rose (positive) or fell (negative); 0 for an equal one, NaN beside a NaN."""

    def __init__(self) -> None:
        self.before = self.length = NAN

    def run(self, x: np.ndarray) -> tuple[np.ndarray]:
        before = np.concatenate([[self.before], x[:-1]])
        way = np.where(np.isnan(x) | np.isnan(before), NAN, np.where(x > before, 1.0, np.where(x < before, -1.0, 0.0)))
        same = way == np.concatenate([[np.sign(self.length)], way[:-1]])
        out = way * affine_scan(same, np.ones(len(x)), abs(self.length) if self.length == self.length else 0.0)
        self.before, self.length = float(x[-1]), float(out[-1])
        return (out,)


class VolumeForce:
    """Klinger's volume force: the range of bars accumulates while the direction of high + low + close holds, and begins anew
    with the last two bars where it turns. A bar beside a NaN has none and changes nothing."""

    def __init__(self) -> None:
        self.price = self.width = NAN
        self.way, self.total = 0.0, 0.0

    def state(self) -> list[float]:
        return [self.price, self.width, self.way, self.total]

    def restore(self, state: list[float]) -> None:
        self.price, self.width, self.way, self.total = state

    def run(self, high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> tuple[np.ndarray]:
        price, width = high + low + close, high - low
        last, old = np.concatenate([[self.price], price[:-1]]), np.concatenate([[self.width], width[:-1]])
        self.price, self.width = float(price[-1]), float(width[-1])
        out = np.full(len(price), NAN)
        at = np.flatnonzero(~np.isnan(price + last + volume + width + old))
        if not len(at):
            return (out,)
        way = np.where(price[at] < last[at], -1.0, 1.0)
        same = way == np.concatenate([[self.way], way[:-1]])
        add = width[at] + np.where(same, 0.0, old[at])
        if not self.way:
            add[0] = width[at[0]]
        total = affine_scan(same, add, self.total)
        self.way, self.total = float(way[-1]), float(total[-1])
        share = np.divide(width[at], total, out=np.ones(len(at)), where=total != 0)
        out[at] = np.where(total != 0, volume[at] * np.abs(2 * (share - 1)) * way * 100, 0.0)
        return (out,)


# Moving windows


class Window:
    """value(*rows, n) over the last n rows: gets the rows that a run's windows cover and gives one value for each whole
    window. Keeps n - 1 rows."""

    def __init__(self, n: int, value: Callable[..., np.ndarray], inputs: int = 1):
        self.n, self.value = n, value
        self.kept = [np.zeros(0) for _ in range(inputs)]

    def run(self, *inputs: np.ndarray) -> tuple[np.ndarray]:
        rows = [np.concatenate([k, x]) for k, x in zip(self.kept, inputs, strict=True)]
        self.kept = [r[max(0, len(r) - self.n + 1) :].copy() if self.n > 1 else r[:0] for r in rows]
        whole = len(rows[0]) - self.n + 1
        out = np.full(len(inputs[0]), NAN)
        if whole > 0:
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                out[len(out) - whole :] = self.value(*rows, self.n)
        return (out,)


def _blocks(x: np.ndarray, n: int, fill: float) -> np.ndarray:
    """Rows of n values."""
    return np.concatenate([x, np.full(-len(x) % n, fill)]).reshape(-1, n)


def _both_sides(op: np.ufunc, before: np.ndarray, after: np.ndarray, count: int) -> np.ndarray:
    """For each window, op over its part of a block (from `before`) and of the next block (from `after`): a window that
    begins in column j of its block ends in column j - 1 of the next one. One that is a block comes from `before` alone."""
    tails = op.accumulate(before[:, ::-1], axis=1)[:, ::-1]
    heads = op.accumulate(after, axis=1)
    joined = tails.copy()
    joined[:-1, 1:] = op(tails[:-1, 1:], heads[1:, :-1])
    return joined.ravel()[:count]


def moving_sum(x: np.ndarray, n: int) -> np.ndarray:
    rows = _blocks(x, n, 0.0)
    return _both_sides(np.add, rows, rows, len(x) - n + 1)


def moving_max(x: np.ndarray, n: int) -> np.ndarray:
    """NaN while one is in the window."""
    rows = _blocks(x, n, -np.inf)
    return _both_sides(np.maximum, rows, rows, len(x) - n + 1)


def moving_min(x: np.ndarray, n: int) -> np.ndarray:
    return -moving_max(-x, n)


def moving_moments(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The sum of products of deviations from the windows' means. Values are taken relative to the first one of the window's
    later block, which every window holds, so equal values give 0 and a value outside the window has no part in it."""
    a, b = _blocks(x, n, 0.0), _blocks(y, n, 0.0)
    u, v = a[:, :1], b[:, :1]  # of a block itself
    u1, v1 = np.append(u[1:], u[-1:], axis=0), np.append(v[1:], v[-1:], axis=0)  # of the next block
    count = len(x) - n + 1

    def sums(before: np.ndarray, after: np.ndarray, own: np.ndarray) -> np.ndarray:
        found = _both_sides(np.add, before, after, count)
        found[::n] = own.sum(axis=1)[: len(found[::n])]  # a window that is a block is taken relative to its own first value
        return found

    sx, sy, sxy = sums(a - u1, a - u, a - u), sums(b - v1, b - v, b - v), sums((a - u1) * (b - v1), (a - u) * (b - v), (a - u) * (b - v))
    return sxy - sx * sy / n


def moving_covariance(x: np.ndarray, y: np.ndarray, n: int, less: int = 0) -> np.ndarray:
    return moving_moments(x, y, n) / (n - less) if n > less else np.full(len(x) - n + 1, NAN)


def moving_variance(x: np.ndarray, n: int, less: int = 0) -> np.ndarray:
    return np.maximum(moving_covariance(x, x, n, less), 0.0)


def moving_correlation(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """NaN without spread on either side."""
    flat = (moving_max(x, n) == moving_min(x, n)) | (moving_max(y, n) == moving_min(y, n))
    spread = np.sqrt(moving_variance(x, n)) * np.sqrt(moving_variance(y, n))
    return np.where(flat | ~(spread != 0), NAN, moving_covariance(x, y, n) / np.where(spread != 0, spread, 1.0))


def moving_weighted(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the window's values by weight, oldest first."""
    return np.convolve(x, weights[::-1], "valid")


def _sheets(n: int, value: Callable[..., np.ndarray], *rows: np.ndarray) -> np.ndarray:
    """value(windows of each), some rows at a time."""
    windows = [np.lib.stride_tricks.sliding_window_view(x, n) for x in rows]
    step = max(1, SHEET // n)
    return np.concatenate([value(*[w[i : i + step] for w in windows]) for i in range(0, len(windows[0]), step)])


class Ranked:
    """Rows by the ranks of their values, bit by bit (a wavelet matrix): each level has the rows in order of the bits above it, and
    how many of those before a place have a 0 here. A question about a window takes a step for each bit, whatever its length, and is
    asked for all windows at once. Sums are differences of prefix sums."""

    def __init__(self, x: np.ndarray, sums: bool = False):
        self.values, codes = np.unique(x, return_inverse=True)
        self.codes = codes = codes.astype(np.int64)
        self.levels: list[tuple[int, np.ndarray, np.ndarray | None]] = []
        for bit in reversed(range(len(self.values).bit_length())):
            zero = (codes >> bit) & 1 == 0
            order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            codes, x = codes[order], x[order]
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero)]), np.concatenate([[0.0], np.cumsum(x)]) if sums else None))

    def kth(self, first: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        """The k-th smallest value (from 0) of the rows from `first` to before `end`."""
        left, code = np.full(len(first), k), np.zeros(len(first), np.int64)
        for bit, zeros, _ in self.levels:
            a, b = zeros[first], zeros[end]
            one = left >= b - a
            left = left - np.where(one, b - a, 0)
            code |= one.astype(np.int64) << bit
            first, end = np.where(one, zeros[-1] + first - a, a), np.where(one, zeros[-1] + end - b, b)
        return self.values[code]

    def below(self, first: np.ndarray, end: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the rows from `first` to before `end` have a rank below `code`, and their sum."""
        count, total = np.zeros(len(first), np.int64), np.zeros(len(first))
        for bit, zeros, sums in self.levels:
            a, b = zeros[first], zeros[end]
            one = (code >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            if sums is not None:
                total += np.where(one, sums[b] - sums[a], 0.0)
            first, end = np.where(one, zeros[-1] + first - a, a), np.where(one, zeros[-1] + end - b, b)
        return count, total


def _spans(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.arange(len(x) - n + 1)
    return first, first + n


def _any(bad: np.ndarray, n: int) -> np.ndarray:
    count = np.concatenate([[0], np.cumsum(bad)])
    return count[n:] > count[:-n]


def moving_quantile(x: np.ndarray, n: int, q: float, by_ranks: bool = False) -> np.ndarray:
    """By linear interpolation; each window is sorted, or all are asked by ranks, which pays for long ones."""
    at = (n - 1) * q
    low, part = int(at), at - int(at)
    if by_ranks:
        ranked, spans = Ranked(x), _spans(x, n)
        found = ranked.kth(*spans, low)
        found = found + (part * (ranked.kth(*spans, low + 1) - found) if part else 0.0)
        return np.where(_any(np.isnan(x), n), NAN, found)

    def value(windows: np.ndarray) -> np.ndarray:
        ordered = np.sort(windows, axis=1)
        found = ordered[:, low] + (part * (ordered[:, low + 1] - ordered[:, low]) if part else 0.0)
        return np.where(np.isnan(ordered[:, -1]), NAN, found)

    return _sheets(n, value, x)


def moving_percent_rank(x: np.ndarray, n: int, by_ranks: bool = False) -> np.ndarray:
    """100 * share of the window's n values below the newest."""
    if by_ranks:
        ranked = Ranked(x)
        return np.where(_any(np.isnan(x), n), NAN, 100 * ranked.below(*_spans(x, n), ranked.codes[n - 1 :])[0] / n)
    return _sheets(n, lambda w: np.where(np.isnan(w).any(axis=1), NAN, 100 * (w < w[:, -1:]).sum(axis=1) / n), x)


def moving_abs_deviation(x: np.ndarray, n: int, by_ranks: bool = False) -> np.ndarray:
    """The mean distance from the window's mean: 0 for equal values, NaN beside one that isn't finite. Those below the mean are
    as far from it, together, as those above; by ranks their sum comes from prefix sums over a batch, around its median."""
    bad = ~np.isfinite(x)
    if by_ranks:
        fine = np.where(bad, 0.0, x - np.median(x[~bad])) if not bad.all() else np.zeros(len(x))
        ranked, mean = Ranked(fine, sums=True), moving_sum(fine, n) / n
        count, total = ranked.below(*_spans(x, n), np.searchsorted(ranked.values, mean))
        found = np.maximum(2 * (mean * count - total) / n, 0.0)
    else:
        fine = np.where(bad, 0.0, x)
        found = _sheets(n, lambda w: np.abs(w - w.mean(axis=1, keepdims=True)).mean(axis=1), fine)
    found = np.where(moving_max(fine, n) == moving_min(fine, n), 0.0, found)
    return np.where(_any(bad, n), NAN, found)


def _mean_ranks(windows: np.ndarray) -> np.ndarray:
    """The rank of each value in its row, from 0; equal values share the mean of theirs."""
    order = np.argsort(windows, axis=1)
    ordered = np.take_along_axis(windows, order, axis=1)
    place = np.broadcast_to(np.arange(windows.shape[1]), windows.shape)
    new = np.ones(windows.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    ends = np.roll(new, -1, axis=1)  # column 0 is new, so the last one ends
    last = np.minimum.accumulate(np.where(ends, place, windows.shape[1])[:, ::-1], axis=1)[:, ::-1]
    ranks = np.empty(windows.shape)
    np.put_along_axis(ranks, order, (first + last) / 2, axis=1)
    return ranks


def moving_rank_correlation(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Of mean ranks; NaN without spread on either side, or beside a NaN."""

    def value(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        a, b = _mean_ranks(v) - (n - 1) / 2, _mean_ranks(w) - (n - 1) / 2
        spread = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        return np.where(spread != 0, (a * b).sum(axis=1) / np.where(spread != 0, spread, 1.0), NAN)

    return np.where(_any(np.isnan(x) | np.isnan(y), n), NAN, _sheets(n, value, x, y))
