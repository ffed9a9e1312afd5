"""Special functions Spark SQL lacks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8


def lgamma(x: Column) -> Column:
    """Log gamma for x > 0, as a plain expression: recurrence up to x + 8, then the
    Stirling series, whose next term is below 1e-13 there."""
    z = x + float(_SHIFT)
    product = x
    for k in range(1, _SHIFT):
        product = product * (x + float(k))
    inv = 1.0 / z
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


# Rational approximations of erf and erfc, numerators and denominators from the
# highest power down (Cody 1969), for |x| <= 0.46875, up to 4, and beyond.
_ERF_P = [1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3]
_ERF_Q = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
_ERFC_P = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
           8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
_ERFC_Q = [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
           3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3]
_TAIL_P = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
           1.60837851487422766e-2, 6.58749161529837803e-4]
_TAIL_Q = [1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(z: Column | str) -> Column:
    """Standard normal distribution function, as a plain expression."""
    z = F.col(z) if isinstance(z, str) else z
    x = z / math.sqrt(2.0)
    size = F.abs(x)
    near = x * _polynomial(_ERF_P, x * x) / _polynomial(_ERF_Q, x * x)
    middle = F.exp(-x * x) * _polynomial(_ERFC_P, size) / _polynomial(_ERFC_Q, size)
    inverse = 1.0 / (x * x)
    ratio = inverse * _polynomial(_TAIL_P, inverse) / _polynomial(_TAIL_Q, inverse)
    far = F.exp(-x * x) / size * (1 / math.sqrt(math.pi) - ratio)
    erfc = F.when(size <= 4.0, middle).otherwise(far)
    return F.when(size <= 0.46875, 0.5 * (1.0 + near)).when(x > 0, 1.0 - 0.5 * erfc).otherwise(0.5 * erfc)
