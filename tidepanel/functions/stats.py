"""Distribution functions, from the standard library alone."""

from __future__ import annotations

import math
from statistics import NormalDist

_STD = NormalDist()


def normal_two_sided(z: float) -> float:
    """P(|N(0,1)| > |z|)."""
    return math.nan if math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _STD.inv_cdf(p)


def normal_pdf(x: float) -> float:
    return _STD.pdf(x)


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail of the chi-squared distribution: the regularised upper incomplete gamma function."""
    if math.isnan(x) or dof <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    a, x = dof / 2, x / 2
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        # series of the lower function
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    # continued fraction of the upper one (modified Lentz)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h * scale
