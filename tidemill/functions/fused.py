"""x * y + z with one rounding, for arrays: by transformations that keep what each operation rounds away."""

from __future__ import annotations

import numpy as np

#: Beyond this many bits above the product, z is the result; below it, only the sign of z matters.
ABOVE, BELOW = 130, -220


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and what is missing from it."""
    total = a + b
    part = total - a
    return total, (a - (total - part)) + (b - part)


def _two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = x * 134217729.0 - (x * 134217729.0 - x)  # 2^27 + 1
        return high, x - high

    product, (a1, a2), (b1, b2) = a * b, halves(a), halves(b)
    return product, ((a1 * b1 - product) + a1 * b2 + a2 * b1) + a2 * b2


def fma(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Factors are scaled to near 1, so that nothing overflows or underflows on the way. The sum of four parts becomes r and two
    that are ever smaller. Where r and the second are just a half of a last place apart, the third tells the side; the same
    holds for results below the normal range, whose last place is a fixed one."""
    with np.errstate(all="ignore"):
        plain = np.where((z == 0) & (x != 0) & (y != 0), x * y, x * y + z)
        simple = ~(np.isfinite(x) & np.isfinite(y) & np.isfinite(z)) | (x == 0) | (y == 0) | (z == 0)
        x, y, z = (np.where(simple, 1.0, v) for v in (x, y, z))
        (a, ea), (b, eb), (c, ec) = np.frexp(x), np.frexp(y), np.frexp(z)
        scale = ea + eb
        c = np.ldexp(c, np.clip(ec - scale, BELOW, ABOVE))
        product, lost = _two_product(a, b)
        t, t_low = _two_sum(c, lost)
        v, v_low = _two_sum(product, t)
        s, third = _two_sum(t_low, v_low)
        r, second = _two_sum(v, s)

        over = r + 2 * second
        beyond = (second * third > 0) & (over - r == 2 * second)  # a tie, but for the third part
        found = np.ldexp(np.where(beyond, over, r), scale)

        unit = np.ldexp(1.0, np.minimum(-1074 - scale, 900))
        base = np.copysign(unit * 2.0**52, r)  # its last place is the unit
        w, rest = _two_sum(base, r)
        tail = np.where(second != 0, second, third)
        w = np.where((np.abs(rest) == unit / 2) & (np.sign(rest) == np.sign(tail)), w + 2 * rest, w)
        small = np.copysign(np.ldexp(w - base, scale), r)

        found = np.where((r != 0) & (np.frexp(r)[1] + scale < -1021), small, found)
        return np.where(simple, plain, np.where(ec - scale > ABOVE, z, found))
