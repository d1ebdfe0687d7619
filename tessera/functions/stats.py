"""Distribution functions as Spark column expressions (and DuckDB text twins).

Spark SQL has no gamma or error function, so p-values are built from closed
forms evaluated with ``aggregate(sequence(...))``: the asymptotic Kolmogorov
series for KS, and the chi-square survival function for integer degrees of
freedom (even: Poisson tail; odd: erfc plus a finite series).  The DuckDB twins
produce the same numbers, so p-values can be checked by the oracle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

KS_TERMS = 100
KS_SMALL_LAMBDA = 0.2  # below this the truncated series is unstable; p = 1
PSI_EPS = 1e-4

# Coefficients of the erfc approximation (fractional error < 1.2e-7).
ERFC_COEFFS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample KS p-value: Q(λ) = 2 Σ (−1)^(k−1) exp(−2k²λ²), λ = D·sqrt(nm/(n+m))."""
    lam = d * F.sqrt(F.try_divide(n * m, n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    p = F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0))
    return F.when(lam.isNull(), F.lit(None)).when(lam < KS_SMALL_LAMBDA, F.lit(1.0)).otherwise(p)


def ks_pvalue_sql(d: str, n: str, m: str) -> str:
    lam = f"({d}) * sqrt(({n}) * ({m}) / (({n}) + ({m})))"
    series = (f"list_sum(list_transform(range(1, {KS_TERMS + 1}), lambda k: "
              f"(case when k % 2 = 1 then 1.0 else -1.0 end) * exp(-2.0 * k * k * {lam} * {lam})))")
    return (f"(case when {lam} < {KS_SMALL_LAMBDA} then 1.0 "
            f"else least(greatest(2.0 * {series}, 0.0), 1.0) end)")


#: Rows of the larger side up to which the automatic choice takes the exact p-value.
KS_EXACT_ROWS = 10_000


#: Cells (tests x width of the widest band) that are carried on at a time.
KS_CELLS = 1 << 15


def ks_exact(d: float, n: int, m: int) -> float:
    """P(D >= d) for two samples of n and m distinct values in random order."""
    return float(ks_exact_all(np.array([d]), np.array([n]), np.array([m]))[0])


def ks_exact_all(d: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """P(D >= d) for each two samples of n and m (> 0) distinct values in random order.

    Such an order is a lattice path from (0, 0) to (n, m); D >= d if the path leaves the band
    |i m - j n| < d n m.  Step by step the chance of being at (i, j) is carried on inside the
    band, and what steps out is added up, so that small p-values lose no digits.  Tests of
    about one size go together, a row each, so that a step's cost is shared.
    """
    n, m = np.asarray(n, dtype=np.int64), np.asarray(m, dtype=np.int64)
    out = np.array([int(round(x * a * b)) for x, a, b in zip(d.tolist(), n.tolist(), m.tolist(), strict=True)], dtype=np.int64)
    p = np.ones(len(n))
    # places i inside the band at i + j = k lie less than 2 * out / (n + m) apart
    width = np.minimum(np.minimum(n, m), 2 * out // (n + m) + 1) + 2
    todo = np.flatnonzero(out > 0)
    todo = todo[np.lexsort(((n + m)[todo], np.log2(width[todo]).astype(int)))]
    while len(todo):
        w = np.maximum.accumulate(width[todo])
        k = max(1, int(np.searchsorted(w * np.arange(1, len(w) + 1), KS_CELLS, side="right")))
        own, todo = todo[:k], todo[k:]
        p[own] = _walk(out[own], n[own], m[own], int(w[k - 1]))
    return p


def _walk(out: np.ndarray, n: np.ndarray, m: np.ndarray, width: int) -> np.ndarray:
    """The chances of leaving the bands; a row for each test, column c is i = a + c, a the least i inside the band."""
    order = np.argsort(-(n + m), kind="stable")
    out, n, m = out[order], n[order], m[order]
    size, gone = n + m, np.zeros(len(n))
    chance = np.zeros((len(n), width + 1))
    chance[:, 0] = 1.0
    a, c = np.zeros(len(n), dtype=np.int64), np.arange(width + 1)
    live = len(n)
    for k in range(int(size[0])):
        live = int(np.searchsorted(-size[:live], -k, side="left"))  # longest first: the others are done
        o, x, y, s = out[:live], n[:live], m[:live], size[:live]
        i = a[:live, None] + c
        each = chance[:live] / (s - k)[:, None]
        step = each * np.maximum(y[:, None] - k + i, 0)
        step[:, 1:] += (each * np.maximum(x[:, None] - i, 0))[:, :-1]
        lo = np.maximum(np.maximum(0, k + 1 - y), ((k + 1) * x - o) // s + 1)
        hi = np.minimum(np.minimum(x, k + 1), -((-(k + 1) * x - o) // s) - 1)
        outside = (i < lo[:, None]) | (i > hi[:, None])
        gone[:live] += np.where(outside, step, 0.0).sum(axis=1)
        step[outside] = 0.0
        shift = lo > a[:live]  # by 1 at most
        step[shift, :-1] = step[shift, 1:]
        step[shift, -1] = 0.0
        chance[:live], a[:live] = step, lo
    p = np.empty(len(n))
    p[order] = np.clip(gone, 0.0, 1.0)
    return p


@F.pandas_udf(DoubleType())
def _ks_exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    there = (d.notna() & (n > 0) & (m > 0)).to_numpy()
    p = np.full(len(d), np.nan)
    p[there] = ks_exact_all(d.to_numpy()[there], n.to_numpy()[there], m.to_numpy()[there])
    return pd.Series(p)


def ks_pvalue_by(method: str, d: Column, n: Column, m: Column) -> Column:
    """The two-sample KS p-value: 'asymptotic', 'exact', or 'auto' -- exact where the larger side has at most
    ``KS_EXACT_ROWS`` values."""
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError(f"unknown method {method!r}: auto, exact or asymptotic")
    if method == "asymptotic":
        return ks_pvalue(d, n, m)
    small = F.lit(True) if method == "exact" else F.greatest(n, m) <= KS_EXACT_ROWS
    # large sides don't enter the function, whose work grows with their size
    own = _ks_exact(F.when(small, d), F.when(small, n).otherwise(0.0), F.when(small, m).otherwise(0.0))
    return own if method == "exact" else F.when(small, own).otherwise(ks_pvalue(d, n, m))


def ks_exact_sql(tests: str, keys: str) -> str:
    """CTEs of a recursive query ending with ``exact``(keys, p_value), for a table with the keys, statistic, n_ref and
    n_cur."""
    return f"""walk as (
  select {keys}, cast(n_ref as bigint) n, cast(n_cur as bigint) m, cast(round(statistic * n_ref * n_cur) as bigint) h,
         0::bigint k, 0::bigint i, 1.0::double p, false as gone from {tests} where n_ref > 0 and n_cur > 0 and round(statistic * n_ref * n_cur) > 0
  union all
  select {keys}, n, m, h, k, i, sum(p), abs(i * m - (k - i) * n) >= h
  from (select {keys}, n, m, h, k + 1 as k, i + s.up as i, p * case when s.up = 1 then n - i else m - (k - i) end / (n + m - k) as p
        from walk, (values (0), (1)) s(up)
        where not gone and k < n + m and case when s.up = 1 then i < n else k - i < m end)
  group by {keys}, n, m, h, k, i
), exact as (select {keys}, sum(p) p_value from walk where gone group by {keys})"""


def _erfc_poly(t):
    acc = ERFC_COEFFS[-1]
    for c in reversed(ERFC_COEFFS[1:-1]):
        acc = c + t * acc
    return acc


def erfc(z: Column) -> Column:
    """erfc(z) for z >= 0."""
    t = 1.0 / (1.0 + 0.5 * z)
    return t * F.exp(-z * z + ERFC_COEFFS[0] + t * _erfc_poly(t))


def erfc_sql(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * ({z})))"
    acc = str(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[1:-1]):
        acc = f"({c} + {t} * {acc})"
    return f"({t} * exp(-({z}) * ({z}) + ({ERFC_COEFFS[0]}) + {t} * {acc}))"


# Above this many degrees of freedom the finite series (dof / 2 terms) gives way to Temme's
# uniform expansion, whose size does not depend on the degrees of freedom (error below 1e-7 there).
CHI2_SERIES_DOF = 200
# The series is 0 to double precision beyond this statistic, for every dof it serves.
CHI2_SERIES_X = 1400.0

# Taylor coefficients at 0 of the first two functions of Temme's expansion.
TEMME_C0 = (-1 / 3, 1 / 12, -2 / 135, 1 / 864)
TEMME_C1 = (-1 / 540, -1 / 288, 1 / 378)


def _poly(coeffs, x):
    acc = coeffs[-1]
    for c in reversed(coeffs[:-1]):
        acc = c + x * acc
    return acc


def _chi2_series(x: Column, dof: Column) -> Column:
    """Poisson tail (even dof) or erfc plus a finite series (odd dof); at most CHI2_SERIES_DOF / 2 terms."""
    x = F.least(x, F.lit(CHI2_SERIES_X))
    dof = F.least(dof, F.lit(CHI2_SERIES_DOF))
    half = x / 2.0
    # even dof: e^{-x/2} Σ_{i=0}^{dof/2-1} (x/2)^i / i!
    h_even = (dof / 2).cast("int")
    even = F.aggregate(F.sequence(F.lit(1), F.greatest(h_even - 1, F.lit(1))),
                       F.struct(F.exp(-half).alias("t"), F.exp(-half).alias("s")),
                       lambda acc, i: F.when(i <= h_even - 1, F.struct(
                           (acc["t"] * half / i).alias("t"), (acc["s"] + acc["t"] * half / i).alias("s")))
                       .otherwise(acc))["s"]
    # odd dof: erfc(sqrt(x/2)) + sqrt(2/π) e^{-x/2} Σ_{i=1}^{(dof-1)/2} x^{(2i-1)/2} / (1·3···(2i-1))
    h_odd = ((dof - 1) / 2).cast("int")
    series = F.aggregate(F.sequence(F.lit(1), F.greatest(h_odd, F.lit(1))),
                         F.struct(F.lit(1.0).alias("u"), F.lit(0.0).alias("s")),
                         lambda acc, i: F.when(i <= h_odd, F.struct(
                             F.when(i == 1, F.sqrt(x)).otherwise(acc["u"] * x / (2 * i - 1)).alias("u"),
                             (acc["s"] + F.when(i == 1, F.sqrt(x)).otherwise(acc["u"] * x / (2 * i - 1)))
                             .alias("s"))).otherwise(acc))["s"]
    odd = erfc(F.sqrt(half)) + math.sqrt(2 / math.pi) * F.exp(-half) * series
    return F.when(dof % 2 == 0, even).otherwise(odd)


def _chi2_uniform(x: Column, dof: Column) -> Column:
    """Temme's expansion of Q(a, x/2), a = dof/2: erfc(η sqrt(a/2))/2 + e^{-aη²/2}/sqrt(2πa) (c0 + c1/a)."""
    a = dof.cast("double") / 2.0
    lam = x / 2.0 / a
    mu = lam - 1.0
    half_eta2 = F.greatest(mu - F.log(lam), F.lit(0.0))
    eta = F.signum(mu) * F.sqrt(2.0 * half_eta2)
    near = F.abs(mu) < 0.05
    c0 = F.when(near, _poly(TEMME_C0, eta)).otherwise(1.0 / mu - 1.0 / eta)
    c1 = F.when(near, _poly(TEMME_C1, eta)).otherwise(
        1.0 / (eta * eta * eta) - 1.0 / (mu * mu * mu) - 1.0 / (mu * mu) - 1.0 / (12.0 * mu))
    half_tail = erfc(F.sqrt(a * half_eta2)) / 2.0
    rest = F.exp(-a * half_eta2) / F.sqrt(2.0 * math.pi * a) * (c0 + c1 / a)
    return F.when(mu >= 0, half_tail).otherwise(1.0 - half_tail) + rest


def chi2_sf(x: Column, dof: Column) -> Column:
    """P(χ²_dof > x) for integer dof >= 1; x = +inf → 0; x <= 0 → 1.

    The expression has a fixed size for any dof: a series of at most
    CHI2_SERIES_DOF / 2 terms, or the uniform expansion above that.
    """
    x = x.cast("double")
    dof = dof.cast("long")
    inside = F.when(x.isNull() | (x <= 0) | (x == float("inf")), F.lit(1.0)).otherwise(x)
    series = F.when(inside > CHI2_SERIES_X, F.lit(0.0)).otherwise(_chi2_series(inside, dof))
    p = F.when(dof <= CHI2_SERIES_DOF, series).otherwise(_chi2_uniform(inside, dof))
    return (F.when(x.isNull() | dof.isNull() | (dof < 1), F.lit(None))
            .when(x == float("inf"), F.lit(0.0))
            .when(x <= 0, F.lit(1.0))
            .otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))


def chi2_sf_sql(x: str, dof: str) -> str:
    """The exact finite sums in log space, whatever the dof: independent of the expansion."""
    half = f"(({x}) / 2.0)"
    # even: Σ_{i=0}^{h-1} exp(-x/2) (x/2)^i / i!  computed as exp(i*ln(x/2) - lgamma(i+1) - x/2)
    even = (f"list_sum(list_transform(range(0, ({dof}) // 2), "
            f"lambda i: exp(i * ln({half}) - lgamma(i + 1) - {half})))")
    # odd: erfc + Σ exp((i-1/2) ln(x/2) - x/2 - lgamma(i+1/2))
    odd_series = (f"coalesce(list_sum(list_transform(range(1, (({dof}) - 1) // 2 + 1), "
                  f"lambda i: exp((i - 0.5) * ln({half}) - {half} - lgamma(i + 0.5)))), 0.0)")
    odd = f"({erfc_sql(f'sqrt({half})')} + {odd_series})"
    return (f"(case when ({x}) = 'inf'::double then 0.0 when ({x}) <= 0 then 1.0 "
            f"else least(greatest(case when ({dof}) % 2 = 0 then {even} else {odd} end, 0.0), 1.0) end)")


def psi_term(cur_share: Column, ref_share: Column, eps: float = PSI_EPS) -> Column:
    """(c − r)·ln(c/r) with both shares floored at eps."""
    c = F.greatest(cur_share, F.lit(eps))
    r = F.greatest(ref_share, F.lit(eps))
    return (c - r) * F.log(c / r)
