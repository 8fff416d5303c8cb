"""Probability distributions as column functions: pmf or pdf, cdf, and moments."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colvane.functions.mathx import beta_regularised, combinations_count, gamma_ln, gamma_p, rbeta

#: Coefficients of the rational approximation of erf (Abramowitz and Stegun 7.1.28, error at most 3e-7).
ERF = (0.0705230784, 0.0422820123, 0.0092705272, 0.0001520143, 0.0002765672, 0.0000430638)


def erf(x: Column) -> Column:
    z, total = F.abs(x.cast("double")), F.lit(0.0)
    for c in reversed(ERF):
        total = (total + c) * z
    return F.signum(x.cast("double")) * (1 - 1 / F.pow(1 + total, F.lit(16.0)))


def normal_pdf(x: Column, mu=0.0, variance=1.0) -> Column:
    return F.exp(-F.pow(x - mu, F.lit(2.0)) / (2 * variance)) / math.sqrt(2 * math.pi * variance)


def normal_cdf(x: Column, mu=0.0, variance=1.0) -> Column:
    return (1 + erf((x - mu) / math.sqrt(2 * variance))) / 2


def _inverse(cdf, low: float, high: float):
    """A quantile function by halving on numpy arrays."""

    def f(p: np.ndarray) -> np.ndarray:
        a, b = np.full(len(p), low), np.full(len(p), high)
        for _ in range(200):
            m = (a + b) / 2
            left = cdf(m) < p
            a, b = np.where(left, m, a), np.where(left, b, m)
        return (a + b) / 2

    return f


@F.pandas_udf(T.DoubleType())
def standard_normal_qf(p: pd.Series) -> pd.Series:
    cdf = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), otypes=[float])
    return pd.Series(_inverse(cdf, -40, 40)(p.to_numpy()))


def normal_qf(p: Column, mu=0.0, variance=1.0) -> Column:
    return mu + math.sqrt(variance) * standard_normal_qf(p)


normal_mu = normal_median = lambda mu, variance: mu
normal_mode = lambda mu, variance: F.array(F.lit(mu))
normal_var = lambda mu, variance: variance
normal_skew = lambda mu, variance: 0.0


def uniform_pmf(x, a, b):
    return F.when((x < a) | (x > b), 0.0).otherwise(1.0 / (b - a + 1))


def uniform_cdf(x, a, b):
    return F.when(x < a, 0.0).when(x > b, 1.0).otherwise((F.floor(x) - a + 1) / (b - a + 1.0))


def uniform_moments(a, b) -> dict:
    return {"mu": (a + b) / 2, "median": (a + b) / 2, "var": ((b - a + 1) ** 2 - 1) / 12, "skew": 0.0}


def real_uniform_pdf(x, a, b):
    return F.when((x < a) | (x > b), 0.0).otherwise(1.0 / (b - a))


def real_uniform_cdf(x, a, b):
    return F.when(x < a, 0.0).when(x > b, 1.0).otherwise((x - a) / (b - a))


def real_uniform_moments(a, b) -> dict:
    return {"mu": (a + b) / 2, "median": (a + b) / 2, "mode": (a + b) / 2, "var": (b - a) ** 2 / 12, "skew": 0.0}


def geometric_pmf(x, p):
    """The first success comes at trial x = 1, 2, ..."""
    return F.when(x < 1, 0.0).otherwise(F.pow(F.lit(1.0 - p), x - 1) * p)


def geometric_cdf(x, p):
    return F.when(x < 1, 0.0).otherwise(1 - F.pow(F.lit(1.0 - p), F.floor(x)))


def geometric_moments(p) -> dict:
    return {"mu": 1 / p, "median": math.ceil(-1 / math.log2(1 - p)), "mode": 1, "var": (1 - p) / p**2, "skew": (2 - p) / math.sqrt(1 - p)}


def binomial_pmf(x, n, p):
    return combinations_count(x, F.lit(n)) * F.pow(F.lit(float(p)), x) * F.pow(F.lit(1.0 - p), n - x)


def _summed(pmf, x):
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor(x), F.lit(0)).cast("long")), F.lit(0.0), lambda acc, k: acc + pmf(k))


def binomial_cdf(x, n, p):
    """Sum over 0 .. x, x included."""
    return F.when(x < 0, 0.0).otherwise(_summed(lambda k: binomial_pmf(k, n, p), x))


def binomial_moments(n, p) -> dict:
    return {"mu": n * p, "median": math.floor(n * p), "mode": math.floor((n + 1) * p), "var": n * p * (1 - p), "skew": (1 - 2 * p) / math.sqrt(n * p * (1 - p))}


def hypergeometric_pmf(x, total, good, drawn):
    return combinations_count(x, F.lit(good)) * combinations_count(drawn - x, F.lit(total - good)) / combinations_count(F.lit(drawn), F.lit(total))


def hypergeometric_cdf(x, total, good, drawn):
    return F.when(x < 0, 0.0).otherwise(_summed(lambda k: hypergeometric_pmf(k, total, good, drawn), x))


def hypergeometric_moments(total, good, drawn) -> dict:
    return {"mu": drawn * good / total, "mode": math.floor((drawn + 1) * (good + 1) / (total + 2)), "var": drawn * good / total * (total - good) / total * (total - drawn) / (total - 1)}


def poisson_pmf(x, mean):
    return F.exp(x * math.log(mean) - mean - gamma_ln(x + 1))


def poisson_cdf(x, mean):
    """Sum over 0 .. x, x included."""
    return F.when(x < 0, 0.0).otherwise(_summed(lambda k: poisson_pmf(k, mean), x))


def poisson_moments(mean) -> dict:
    return {"mu": mean, "median": math.floor(mean + 1 / 3 - 0.02 / mean), "mode": math.floor(mean), "var": mean, "skew": 1 / math.sqrt(mean)}


def lognormal_pdf(x, mu, variance):
    return F.when(x <= 0, 0.0).otherwise(normal_pdf(F.ln(x), mu, variance) / x)


def lognormal_cdf(x, mu, variance):
    return F.when(x <= 0, 0.0).otherwise(normal_cdf(F.ln(x), mu, variance))


def lognormal_qf(p, mu, variance):
    return F.exp(normal_qf(p, mu, variance))


def lognormal_moments(mu, variance) -> dict:
    e = math.exp(variance)
    return {"mu": math.exp(mu + variance / 2), "median": math.exp(mu), "mode": math.exp(mu - variance), "var": (e - 1) * math.exp(2 * mu + variance), "skew": (e + 2) * math.sqrt(e - 1)}


def chi_square_pdf(x, r):
    return F.when(x <= 0, 0.0).otherwise(F.exp((r / 2 - 1) * F.ln(F.greatest(x, F.lit(1e-300))) - x / 2 - (r / 2) * math.log(2) - math.lgamma(r / 2)))


def chi_square_cdf(x, r):
    return gamma_p(F.lit(r / 2), x / 2)


def chi_square_moments(r) -> dict:
    return {"mu": r, "median": r * (1 - 2 / (9 * r)) ** 3, "mode": max(0, r - 2), "var": 2 * r, "skew": math.sqrt(8 / r)}


def chi_square_qf(p: Column, r: float) -> Column:
    """By halving on the cdf's series, 80 times."""
    from colvane.functions.mathx import bisect

    return bisect(lambda x: chi_square_cdf(x, r) - p, F.lit(0.0), F.lit(20.0 * r + 100), 80)


def student_pdf(x, v):
    return F.pow(1 + x * x / v, F.lit(-(v + 1) / 2)) * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)


def student_cdf(x, v):
    tail = rbeta(v / (v + x * x), F.lit(v / 2), F.lit(0.5)) / 2
    return F.when(x > 0, 1 - tail).otherwise(tail)


def student_qf(v: float):
    def cdf(x):
        tail = beta_regularised(v / (v + x * x), v / 2, 0.5) / 2
        return np.where(x > 0, 1 - tail, tail)

    @F.pandas_udf(T.DoubleType())
    def q(p: pd.Series) -> pd.Series:
        return pd.Series(_inverse(cdf, -1e6, 1e6)(p.to_numpy()))

    return q


def student_moments(v) -> dict:
    return {"mu": 0.0 if v > 1 else None, "median": 0.0, "mode": 0.0, "var": v / (v - 2) if v > 2 else None, "skew": 0.0 if v > 3 else None}


def fisher_pdf(x, m, n):
    scale = math.lgamma((m + n) / 2) - math.lgamma(m / 2) - math.lgamma(n / 2) + (m / 2) * math.log(m / n)
    return F.when(x <= 0, 0.0).otherwise(F.exp(scale + (m / 2 - 1) * F.ln(F.greatest(x, F.lit(1e-300))) - ((m + n) / 2) * F.ln(1 + x * m / n)))


def fisher_cdf(x, m, n):
    return rbeta(m * x / (m * x + n), F.lit(m / 2), F.lit(n / 2))


def fisher_qf(m: float, n: float):
    @F.pandas_udf(T.DoubleType())
    def q(p: pd.Series) -> pd.Series:
        return pd.Series(_inverse(lambda x: beta_regularised(m * x / (m * x + n), m / 2, n / 2), 0, 1e6)(p.to_numpy()))

    return q


def fisher_moments(m, n) -> dict:
    out = {"mu": n / (n - 2) if n > 2 else None, "mode": (m - 2) / m * n / (n + 2) if m > 2 else None}
    out["var"] = 2 * n**2 * (m + n - 2) / (m * (n - 2) ** 2 * (n - 4)) if n > 4 else None
    out["skew"] = (2 * m + n - 2) * math.sqrt(8 * (n - 4)) / ((n - 6) * math.sqrt(m * (m + n - 2))) if n > 6 else None
    return out


def zscore(x, mu, sd):
    return (x - mu) / sd


def tscore(mean, mu, sd, n):
    return (mean - mu) / (sd / F.sqrt(n))


def fscore(var1, var2):
    return var1 / var2


def bayes(p_a, p_b_given_a, p_not_b_given_not_a):
    """P(A | B) from P(A), P(B | A) and P(not B | not A)."""
    hit = p_a * p_b_given_a
    return hit / (hit + (1 - p_a) * (1 - p_not_b_given_not_a))
