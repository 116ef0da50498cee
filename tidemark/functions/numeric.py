"""Numeric column expressions: inverse normal, normal tail, Yeo-Johnson."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _poly(x: Column, coefficients: list[float]) -> Column:
    """Horner form, highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


# Wichura's rational approximation AS 241 (1988), highest power first.
_CENTRAL = (
    [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
    [5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0],
)
_MIDDLE = (
    [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
     3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
    [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
     0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0],
)
_FAR = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
     0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772],
    [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
     0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0],
)


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile; NULL outside (0, 1)."""
    q = p - 0.5
    central = q * _poly(0.180625 - q * q, _CENTRAL[0]) / _poly(0.180625 - q * q, _CENTRAL[1])
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    middle = _poly(tail - 1.6, _MIDDLE[0]) / _poly(tail - 1.6, _MIDDLE[1])
    far = _poly(tail - 5.0, _FAR[0]) / _poly(tail - 5.0, _FAR[1])
    outer = F.when(tail <= 5, middle).otherwise(far)
    signed = F.when(q < 0, -outer).otherwise(outer)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, central).otherwise(signed))


# Cody-style rational fit of erfc (W. J. Cody 1969), highest power first.
_ERF_SMALL = (
    [1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3],
    [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3],
)
_ERFC_MIDDLE = (
    [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
     8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
    [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
     3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3],
)
_ERFC_FAR = (
    [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
     1.60837851487422766e-2, 6.58749161529837803e-4],
    [1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2,
     2.33520497626869185e-3],
)


def complementary_error(x: Column) -> Column:
    """erfc for x >= 0."""
    small = 1 - x * _poly(x * x, _ERF_SMALL[0]) / _poly(x * x, _ERF_SMALL[1])
    middle = F.exp(-x * x) * _poly(x, _ERFC_MIDDLE[0]) / _poly(x, _ERFC_MIDDLE[1])
    inv = 1 / (x * x)
    ratio = inv * _poly(inv, _ERFC_FAR[0]) / _poly(inv, _ERFC_FAR[1])
    far = F.exp(-x * x) / x * (F.lit(0.5641895835477563) - ratio)
    return F.when(x <= 0.46875, small).when(x <= 4, middle).otherwise(far)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value of a z statistic."""
    return complementary_error(F.abs(z) / F.lit(2.0**0.5))


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson power transform for any lambda."""
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)
