"""Special functions as SQL text, inside whole-stage code generation.

Every generator takes the name of a column (or any short SQL text) and returns SQL that Spark and DuckDB both read. They
follow W. J. Cody's rational Chebyshev approximations of the error function (1969) and M. J. Wichura's AS241 (1988).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients as published, numerators and denominators from the highest power down.
_ERF_SMALL = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_ERFC_LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
_NORMAL_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_NORMAL_MIDDLE = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
_NORMAL_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _number(x: float) -> str:
    return f"({x:.17e})" if x < 0 else f"{x:.17e}"


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def _ratio(pair: tuple[tuple[float, ...], tuple[float, ...]], x: str) -> str:
    return f"({_horner(pair[0], x)} / {_horner(pair[1], x)})"


def log_sf_sql(z: str) -> str:
    """ln of the normal survival function at z >= 0, finite far beyond where the function underflows."""
    x = f"({z} * {_number(math.sqrt(0.5))})"
    half = _number(math.log(2))
    small = f"ln(1e0 - {x} * {_ratio(_ERF_SMALL, f'({x} * {x})')}) - {half}"
    middle = f"ln({_ratio(_ERFC_MIDDLE, x)}) - {x} * {x} - {half}"
    over = f"(1e0 / ({x} * {x}))"
    large = f"ln(({_number(1 / math.sqrt(math.pi))} - {over} * {_ratio(_ERFC_LARGE, over)}) / {x}) - {x} * {x} - {half}"
    return f"(case when {x} <= 0.46875e0 then {small} when {x} <= 4e0 then {middle} else {large} end)"


def isf_sql(q: str, root: str | None = None) -> str:
    """The z at which the normal survival function is q, for 0 < q <= 0.5. root: a column that holds sqrt(-ln(q))."""
    d = f"(0.5e0 - {q})"
    root = root or f"sqrt(-ln({q}))"
    centre = f"{d} * {_ratio(_NORMAL_CENTRE, f'(0.180625e0 - {d} * {d})')}"
    middle = _ratio(_NORMAL_MIDDLE, f"({root} - 1.6e0)")
    tail = _ratio(_NORMAL_TAIL, f"({root} - 5e0)")
    return f"(case when {q} >= 0.075e0 then {centre} when {root} <= 5e0 then {middle} else {tail} end)"


def round6_sql(x: str, digits: int = 6, even: str = "rint") -> str:
    """Rounding of the scaled double, halves to even. even: the function's name (rint in Spark, round_even in DuckDB)."""
    scaled = f"({x}) * 1e{digits}"
    return f"(rint({scaled}) / 1e{digits})" if even == "rint" else f"(round_even({scaled}, 0) / 1e{digits})"


def log_sf(z: str) -> Column:
    return F.expr(log_sf_sql(z))


def isf(q: str, root: str | None = None) -> Column:
    return F.expr(isf_sql(q, root))


def rounded(x: Column, digits: int = 6) -> Column:
    """Halves go to even on the scaled double; -0 becomes 0."""
    return F.rint(x * 10.0**digits) / 10.0**digits + F.lit(0.0)


def log_factorials(n: int) -> list[float]:
    return [math.lgamma(k + 1) for k in range(n + 1)]


def log_beta_cdf(x: Column, k: Column, n: int) -> Column:
    """ln of the Beta(k, n - k + 1) distribution at x in (0, 1]: the chance that k or more of n uniforms lie below x.

    The binomial tail is summed in logs from its largest term, which stands at the mode or at k, so it doesn't underflow.
    What the sum's terms share is bound by a lambda: inside one, Spark computes an expression anew for each element.
    """
    facts = F.array(*map(F.lit, log_factorials(n)))
    at = lambda j: F.element_at(facts, j.cast("int") + 1)
    # At x = 1 ly is minus infinity; that case is taken out below.
    term = lambda j, lx, ly: at(F.lit(n)) - at(j) - at(F.lit(n) - j) + j * lx + F.when(j == n, 0.0).otherwise((F.lit(n) - j) * ly)
    mode = F.least(F.lit(n), F.greatest(k.cast("int"), F.floor((n + 1) * x).cast("int")))
    logs = F.array(F.struct(F.log(x).alias("lx"), F.log1p(-x).alias("ly"), mode.alias("mode")))
    tops = F.transform(logs, lambda v: F.struct(v["lx"].alias("lx"), v["ly"].alias("ly"), term(v["mode"], v["lx"], v["ly"]).alias("top")))
    tail = F.sequence(k.cast("int"), F.lit(n))
    sums = F.transform(tops, lambda v: v["top"] + F.log(F.aggregate(tail, F.lit(0.0), lambda s, j: s + F.exp(term(j, v["lx"], v["ly"]) - v["top"]))))
    return F.when(x >= 1, F.lit(0.0)).otherwise(F.least(F.lit(0.0), F.element_at(sums, 1)))


@lru_cache(maxsize=4096)
def t_quantile(df: int, p: float = 0.975) -> float:
    """Student's t quantile for whole degrees of freedom, by bisection on the closed-form distribution (A&S 26.7.3-4)."""

    def cdf(t: float) -> float:
        theta, c, total = math.atan(t / math.sqrt(df)), math.cos(math.atan(t / math.sqrt(df))), 0.0
        if df % 2:
            term = c
            for k in range(1, (df - 1) // 2 + 1):
                total += term
                term *= c * c * 2 * k / (2 * k + 1)
            return 0.5 + (theta + math.sin(theta) * total) / math.pi
        term = 1.0
        for k in range(1, df // 2 + 1):
            total += term
            term *= c * c * (2 * k - 1) / (2 * k)
        return 0.5 + math.sin(theta) * total / 2

    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5 (Lanczos, g = 7, nine terms)."""
    total = _LANCZOS[0] + sum(c / (x + k) for k, c in enumerate(_LANCZOS[1:], 0))
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * np.log(t) - t + np.log(total)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of arrays, 0 < x < 1, by Lentz's continued fraction, all at once."""
    turned = x > (a + 1) / (a + b + 2)
    a, b, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    tiny = 1e-300
    fixed = lambda v: np.where(v == 0, tiny, v)
    c = np.ones_like(y)
    d = 1 / fixed(1 - (a + b) * y / (a + 1))
    h = d.copy()
    for m in range(1, 1000):
        even = m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))
        for num in (even, odd):
            d = 1 / fixed(1 + num * d)
            c = fixed(1 + num / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(y) + b * np.log1p(-y))
    part = front * h / a
    return np.where(turned, 1 - part, part)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Student's t with real degrees of freedom; 1 where t or df isn't usable, or t is 0."""
    good = np.isfinite(t) & np.isfinite(df) & (df > 0) & (t != 0)
    out = np.ones(len(t))
    t, df = t[good].astype(float), df[good].astype(float)
    x = df / (df + t * t)
    inside = x > 0
    p = np.zeros(len(t))
    p[inside] = np.where(x[inside] >= 1, 1.0, incomplete_beta(df[inside] / 2, np.full(inside.sum(), 0.5), np.minimum(x[inside], 1 - 1e-16)))
    out[good] = p
    return out
