"""Numeric Column functions: finite values, complementary error function, tails and stars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_ERX = 8.45062911510467529297e-01
_PP = (1.28379167095512558561e-01, -3.25042107247001499370e-01, -2.84817495755985104766e-02, -5.77027029648944159157e-03, -2.37630166566501626084e-05)
_QQ = (1.0, 3.97917223959155352819e-01, 6.50222499887672944485e-02, 5.08130628187576562776e-03, 1.32494738004321644526e-04, -3.96022827877536812320e-06)
_PA = (-2.36211856075265944077e-03, 4.14856118683748331666e-01, -3.72207876035701323847e-01, 3.18346619901161753674e-01, -1.10894694282396677476e-01, 3.54783043256182359371e-02, -2.16637559486879084300e-03)
_QA = (1.0, 1.06420880400844228286e-01, 5.40397917702171048937e-01, 7.18286544141962662868e-02, 1.26171219808761642112e-01, 1.36370839120290507362e-02, 1.19844998467991074170e-02)
_RA = (-9.86494403484714822705e-03, -6.93858572707181764372e-01, -1.05586262253232909814e01, -6.23753324503260060396e01, -1.62396669462573470355e02, -1.84605092906711035994e02, -8.12874355063065934246e01, -9.81432934416914548592e00)
_SA = (1.0, 1.96512716674392571292e01, 1.37657754143519042600e02, 4.34565877475229228821e02, 6.45387271733267880336e02, 4.29008140027567833386e02, 1.08635005541779435134e02, 6.57024977031928170135e00, -6.04244152148580987438e-02)
_RB = (-9.86494292470009928597e-03, -7.99283237680523006574e-01, -1.77579549177547519889e01, -1.60636384855821916062e02, -6.37566443368389627722e02, -1.02509513161107724954e03, -4.83519191608651397019e02)
_SB = (1.0, 3.03380607434824582924e01, 3.25792512996573918826e02, 1.53672958608443695994e03, 3.19985821950859553908e03, 2.55305040643316442583e03, 4.74528541206955367215e02, -2.24409524465858183362e01)


def _poly(x: str, c: tuple[float, ...]) -> str:
    out = f"{c[-1]:e}" if c[-1] == float(f"{c[-1]:e}") else f"{c[-1]:.17e}"
    for a in reversed(c[:-1]):
        out = f"({a:.17e} + {x} * {out})"
    return out


def erfc_sql(x: str) -> str:
    """SQL text of erfc(x) for x >= 0, to double precision, far into the tail. It is plain
    arithmetic with double literals, so any engine with exp and double can evaluate it."""
    z, s, i = f"({x} * {x})", f"({x} - 1e0)", f"(1e0 / ({x} * {x}))"
    tail = lambda r, q: f"exp(-{z} - 5.625e-1 + {_poly(i, r)} / {_poly(i, q)}) / {x}"
    return (
        f"CASE WHEN {x} < 8.4375e-1 THEN 1e0 - ({x} + {x} * {_poly(z, _PP)} / {_poly(z, _QQ)}) "
        f"WHEN {x} < 1.25e0 THEN {1 - _ERX:.17e} - {_poly(s, _PA)} / {_poly(s, _QA)} "
        f"WHEN {x} < 2.857142857142857e0 THEN {tail(_RA, _SA)} WHEN {x} < 2.7e1 THEN {tail(_RB, _SB)} ELSE 0e0 END"
    )


def erfc(x: Column) -> Column:
    """erfc of a non-negative double; null stays null."""
    z = x * x
    poly = lambda v, c: _horner(v, c)
    inverse = F.try_divide(F.lit(1.0), z)
    tail = lambda r, q: F.exp(-z - F.lit(0.5625) + poly(inverse, r) / poly(inverse, q)) / x
    s = x - F.lit(1.0)
    return (
        F.when(x < 0.84375, F.lit(1.0) - (x + x * poly(z, _PP) / poly(z, _QQ)))
        .when(x < 1.25, F.lit(1 - _ERX) - poly(s, _PA) / poly(s, _QA))
        .when(x < 1 / 0.35, tail(_RA, _SA))
        .when(x < 27, tail(_RB, _SB))
        .when(x.isNotNull(), F.lit(0.0))
    )


def _horner(x: Column, c: tuple[float, ...]) -> Column:
    out = F.lit(float(c[-1]))
    for a in reversed(c[:-1]):
        out = F.lit(float(a)) + x * out
    return out


def two_sided(z: Column) -> Column:
    """2 (1 - Phi(|z|)), without cancellation."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi2_tail3(x: Column) -> Column:
    """Upper tail of chi-square with 3 degrees of freedom."""
    return erfc(F.sqrt(x / F.lit(2.0))) + F.sqrt(F.lit(2.0) * x / F.lit(math.pi)) * F.exp(-x / F.lit(2.0))


def chi2_tail2(x: Column) -> Column:
    return F.exp(-x / F.lit(2.0))


def chi2_tail1(x: Column) -> Column:
    return erfc(F.sqrt(x / F.lit(2.0)))


def finite(x: Column) -> Column:
    """The double where it is finite, else null."""
    d = x.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(math.inf)), d)


def number(x: Column) -> Column:
    """The double that a string says, null where it says none; Java's suffixes (``1d``) are no number."""
    return F.when(~x.cast("string").rlike(r"[dDfF]\s*$"), finite(x.try_cast("double")))


def rounded(x: Column, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, places) + F.lit(0.0)


def stars(p: Column) -> Column:
    """``***`` below 0.001, ``**`` below 0.01, ``*`` below 0.05, else empty; null and NaN: empty."""
    p = finite(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
