"""Distributions as expressions: texts that Spark and other SQL engines read alike, and the studentised range."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import ERF_A, ERF_P

#: Rational approximation of the normal quantile, relative error below 1.2e-9, fixed values: centre (numerator, denominator), tails.
CENTRE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
TAIL_FROM = 0.02425
#: Shapiro-Wilk weights and p (Royston 1995), fixed values, constant term first.
W_FIRST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
W_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
W_FEW = ((0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322))
W_MANY = ((-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302))
W_GAMMA = (-2.273, 0.459)
#: Nodes over the logarithm of the scale and over the normal: first, step, number.
SCALE_NODES, NORMAL_NODES = (-20.0, 0.25, 113), (-8.0, 0.25, 65)


def polynomial(coefficients: tuple[float, ...], x: str) -> str:
    """Text of a polynomial, constant term first, by Horner's rule."""
    plain = lambda c: f"cast({c!r} AS DOUBLE)"
    out = plain(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = f"({plain(c)} + {x}*{out})"
    return out


def _falling(coefficients: tuple[float, ...], x: str) -> str:
    return polynomial(coefficients[::-1], x)


def normal_quantile(p: str) -> str:
    """Text of the normal quantile of an expression in (0, 1)."""
    q, r = f"({p}-0.5)", f"(({p}-0.5)*({p}-0.5))"
    low, high = f"sqrt(-2.0*ln({p}))", f"sqrt(-2.0*ln(1.0-({p})))"
    tail = lambda x: f"{_falling(TAIL[0], x)}/{_falling(TAIL[1], x)}"
    return f"(CASE WHEN {p}<{TAIL_FROM} THEN {tail(low)} WHEN {p}>{1 - TAIL_FROM} THEN -({tail(high)}) ELSE {q}*{_falling(CENTRE[0], r)}/{_falling(CENTRE[1], r)} END)"


def upper_tail(z: str) -> str:
    """Text of P(Z > z), by the polynomial of all p-values."""
    x = f"(abs({z})/sqrt(2.0))"
    t = f"(1.0/(1.0+{ERF_P}*{x}))"
    a1, a2, a3, a4, a5 = ERF_A
    half = f"(0.5*((((({a5}*{t}+({a4}))*{t}+{a3})*{t}+({a2}))*{t}+{a1})*{t})*exp(-{x}*{x}))"
    return f"(CASE WHEN {z}<0 THEN 1.0-{half} ELSE {half} END)"


def shapiro_w(n: str = "n") -> dict[str, str]:
    """Texts over n and the sums of a sample in order: its first weights and W.

    Sums: m1, m2 (first normal scores), mm (their squares, all of them), mid (scores times values but for the ends), x1, x2, y2, y1 (the
    two smallest and the two largest values), ss (squares about the mean).
    """
    rsn = f"(1.0/sqrt({n}))"
    return {
        "a1": f"CASE WHEN {n}=3 THEN sqrt(0.5) ELSE {polynomial(W_FIRST, rsn)}-m1/sqrt(mm) END", "a2": f"{polynomial(W_SECOND, rsn)}-m2/sqrt(mm)",
        "fac": f"CASE WHEN {n}>5 THEN sqrt((mm-2*m1*m1-2*m2*m2)/(1-2*a1*a1-2*a2*a2)) WHEN {n}>3 THEN sqrt((mm-2*m1*m1)/(1-2*a1*a1)) ELSE 1.0 END",
        "b": f"a1*(y1-x1)+CASE WHEN {n}>5 THEN a2*(y2-x2) ELSE 0.0 END+CASE WHEN {n}>3 THEN mid/fac ELSE 0.0 END", "w": "CASE WHEN ss>0 THEN least(1.0, b*b/ss) END",
    }


def shapiro_p(n: str = "n", w: str = "w") -> str:
    """Text of the p of W: of three values in closed form, else by a transformed 1 - W that is near to normal."""
    y, ln_n = f"ln(greatest(1.0-{w},1e-19))", f"ln({n})"
    gamma = polynomial(W_GAMMA, n)
    few = f"((-ln({gamma}-{y}))-{polynomial(W_FEW[0], n)})/exp({polynomial(W_FEW[1], n)})"
    many = f"({y}-{polynomial(W_MANY[0], ln_n)})/exp({polynomial(W_MANY[1], ln_n)})"
    three = f"greatest(0.0, 1.90985931710274*(asin(sqrt({w}))-1.04719755119660))"
    return f"CASE WHEN {w} IS NULL THEN NULL WHEN {n}=3 THEN {three} WHEN {n}<=11 THEN CASE WHEN {y}>={gamma} THEN 0.0 ELSE {upper_tail(f'({few})')} END ELSE {upper_tail(f'({many})')} END"


def _cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + ERF_P * x)
    a1, a2, a3, a4, a5 = ERF_A
    half = 0.5 * ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return F.when(z < 0, half).otherwise(1.0 - half)


def studentised_range_p(q: Column, k: Column, df: Column) -> Column:
    """P(Q > q) of k means and df degrees of freedom; null for fewer than two means or one degree.

    The scale's distribution is taken at fixed nodes of its logarithm, that of the range of k normals at fixed nodes of the smallest one;
    both integrands fall off fast on either side, where equal steps are as good as any.
    """
    (s0, ds, ns), (z0, dz, nz) = SCALE_NODES, NORMAL_NODES

    def of_range(width):
        term = lambda z: F.exp(-z * z / 2) * F.pow(F.greatest(_cdf(z) - _cdf(z - width), F.lit(0.0)), k - 1)
        return k * dz / math.sqrt(2 * math.pi) * F.aggregate(F.sequence(F.lit(0), F.lit(nz - 1)), F.lit(0.0), lambda s, i: s + term(z0 + dz * i))

    def at(total, j):
        log = (s0 + ds * j) / F.sqrt(2 * df)
        scale = F.exp(log)
        weight = F.exp(df * (log - scale * scale / 2 + 0.5))
        return F.struct((total["w"] + weight).alias("w"), (total["p"] + weight * of_range(q * scale)).alias("p"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("p"))
    share = F.aggregate(F.sequence(F.lit(0), F.lit(ns - 1)), zero, at, lambda t: t["p"] / t["w"])
    return F.when((k >= 2) & (df >= 1) & q.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - share)))
