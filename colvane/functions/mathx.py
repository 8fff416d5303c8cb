"""Mathematical functions that Spark lacks, as column functions; matrices and transforms as Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(n: int, start: Column, step) -> Column:
    """Applies step(state) n times."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda acc, _: step(acc))


def rnd(x: Column, digits: int = 0) -> Column:
    """Rounds halves away from zero."""
    return F.round(x, digits)


def thousands(x: Column) -> Column:
    return F.format_number(F.floor(x), 0)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm, at most 92 steps for 64-bit numbers."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["x"], s["y"])).alias("y"))
    return fold(92, start, step)["x"]


def lcm(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(F.abs(a.cast("long") * b.cast("long")), gcd(a, b))).cast("long")


def root(n: Column, x: Column) -> Column:
    return F.pow(x.cast("double"), F.lit(1.0) / n)


def angle(x: Column, y: Column) -> Column:
    """The angle of the complex number x + yi."""
    return F.atan2(y, x)


def cnum(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def cadd(a, b):
    return cnum(a["re"] + b["re"], a["im"] + b["im"])


def csub(a, b):
    return cnum(a["re"] - b["re"], a["im"] - b["im"])


def cmul(a, b):
    return cnum(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def cdiv(a, b):
    d = b["re"] * b["re"] + b["im"] * b["im"]
    return cnum(F.try_divide(a["re"] * b["re"] + a["im"] * b["im"], d), F.try_divide(a["im"] * b["re"] - a["re"] * b["im"], d))


def cexp(a):
    return cnum(F.exp(a["re"]) * F.cos(a["im"]), F.exp(a["re"]) * F.sin(a["im"]))


def cabs(a):
    return F.hypot(a["re"], a["im"])


def gamma_ln(x: Column) -> Column:
    """ln of the gamma function for x > 0: eight steps up, then Stirling's series (errors near 1e-13)."""
    x = x.cast("double")
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda acc, k: acc + F.ln(x + k))
    z = x + 8
    series = F.lit(1 / 12) / z - F.lit(1 / 360) / F.pow(z, F.lit(3)) + F.lit(1 / 1260) / F.pow(z, F.lit(5)) - F.lit(1 / 1680) / F.pow(z, F.lit(7))
    return (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - shift


def gamma(x: Column) -> Column:
    return F.exp(gamma_ln(x))


def beta(a: Column, b: Column) -> Column:
    return F.exp(gamma_ln(a) + gamma_ln(b) - gamma_ln(a + b))


def gamma_p(a: Column, x: Column, terms: int = 200) -> Column:
    """Regularised lower incomplete gamma function: up to x = a + 1 its series x^a e^-x sum x^n / (a ... (a + n)), beyond
    it one less the continued fraction of the upper one, read from its end."""
    a, x = a.cast("double"), x.cast("double")
    scale = F.exp(-x + a * F.ln(F.greatest(x, F.lit(1e-300))) - gamma_ln(a))
    tail = lambda acc, k: x + (2 * k + 1) - a - (k + 1) * (k + 1 - a) / acc
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(0)), x + (2.0 * terms + 3) - a, tail)
    start = F.struct((F.lit(1.0) / a).alias("d"), (F.lit(1.0) / a).alias("s"))
    step = lambda acc, k: F.struct((acc["d"] * x / (a + k)).alias("d"), (acc["s"] + acc["d"] * x / (a + k)).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step)["s"]
    return F.when(x <= 0, 0.0).when(x > a + 1, 1 - scale / fraction).otherwise(F.least(F.lit(1.0), total * scale))


def gamma_q(a: Column, x: Column) -> Column:
    return 1 - gamma_p(a, x)


def lower_gamma(a, x):
    return gamma_p(a, x) * gamma(a)


def upper_gamma(a, x):
    return gamma_q(a, x) * gamma(a)


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + num * d) < tiny, tiny, 1 + num * d)
            c = np.where(np.abs(1 + num / c) < tiny, tiny, 1 + num / c)
            h = h * d * c
    return h


def beta_regularised(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, a, b = (np.asarray(v, np.float64) for v in np.broadcast_arrays(x, a, b))
    ln = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(ln(a + b) - ln(a) - ln(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        out = np.where(low, front * _beta_fraction(np.where(low, x, 0.5), a, b) / a, 1 - front * _beta_fraction(np.where(low, 0.5, 1 - x), b, a) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(T.DoubleType())
def rbeta(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Regularised incomplete beta function."""
    return pd.Series(beta_regularised(x.to_numpy(), a.to_numpy(), b.to_numpy()))


def ibeta(x, a, b):
    return rbeta(x, a, b) * beta(a, b)


def matmul(a: Column, b: Column) -> Column:
    """Product of nested matrices."""
    columns = F.transform(F.sequence(F.lit(0), F.size(b[0]) - 1), lambda j: F.transform(b, lambda r: F.get(r, j)))
    dot = lambda r, c: F.aggregate(F.zip_with(r, c, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    return F.transform(a, lambda r: F.transform(columns, lambda c: dot(r, c)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve(m: pd.Series) -> pd.Series:
    """Solutions of augmented systems given row by row in one flat list of n * (n + 1) numbers."""

    def one(x):
        n = int((math.isqrt(4 * len(x) + 1) - 1) // 2)
        a = np.asarray(x, float).reshape(n, n + 1)
        return np.linalg.solve(a[:, :n], a[:, n])

    return m.map(one)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def eigenvalues(m: pd.Series) -> pd.Series:
    """Eigenvalues, ascending, of symmetric matrices given as flat lists."""
    return m.map(lambda x: np.linalg.eigvalsh(np.asarray(x, float).reshape(math.isqrt(len(x)), -1)))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def eigenvectors(m: pd.Series) -> pd.Series:
    """Unit eigenvectors in the order of `eigenvalues`, the first component that isn't 0 positive."""

    def one(x):
        v = np.linalg.eigh(np.asarray(x, float).reshape(math.isqrt(len(x)), -1))[1].T
        lead = v[np.arange(len(v)), (np.abs(v) > 1e-12).argmax(axis=1)]
        return (v * np.sign(lead)[:, None]).tolist()

    return m.map(one)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])))
def fft(v: pd.Series) -> pd.Series:
    """Discrete Fourier transform of real vectors, zero-padded to a power of two and cut back to their length."""

    def one(x):
        n = len(x)
        f = np.fft.fft(np.asarray(x, float), 1 << max(n - 1, 0).bit_length())[:n] if n else np.zeros(0)
        return [{"re": float(z.real), "im": float(z.imag)} for z in f]

    return v.map(one)


def random_real(seed: int, high: float = 1.0) -> Column:
    """Chance numbers of at least 0 and less than `high`."""
    return F.rand(seed) * high


def random_int(seed: int, high: int) -> Column:
    return F.floor(F.rand(seed) * high).cast("long")


def is_prime(n: Column) -> Column:
    """Trial division up to the root."""
    tests = F.sequence(F.lit(2).cast("long"), F.greatest(F.floor(F.sqrt(n.cast("double"))), F.lit(2)).cast("long"))
    return (n >= 2) & ~F.exists(tests, lambda d: (d < n) & (n % d == 0))


def bisect(f, low: Column, high: Column, steps: int = 60) -> Column:
    """A root of column function f between low and high, where it changes sign."""
    rising = F.signum(f(high) - f(low))

    def step(s):
        mid = (s["a"] + s["b"]) / 2
        left = f(mid) * rising > 0
        return F.struct(F.when(left, s["a"]).otherwise(mid).alias("a"), F.when(left, mid).otherwise(s["b"]).alias("b"))

    out = fold(steps, F.struct(low.cast("double").alias("a"), high.cast("double").alias("b")), step)
    return (out["a"] + out["b"]) / 2


def regula_falsi(f, low: Column, high: Column, steps: int = 40) -> Column:
    """A root by the Illinois variant of false position."""

    def step(s):
        cut = s["b"] - F.coalesce(F.try_divide(s["fb"] * (s["b"] - s["a"]), s["fb"] - s["fa"]), F.lit(0.0))
        fc = f(cut)
        flip = fc * s["fb"] < 0
        return F.struct(F.when(flip, s["b"]).otherwise(s["a"]).alias("a"), F.when(flip, s["fb"]).otherwise(s["fa"] / 2).alias("fa"), cut.alias("b"), fc.alias("fb"))

    a, b = low.cast("double"), high.cast("double")
    return fold(steps, F.struct(a.alias("a"), f(a).alias("fa"), b.alias("b"), f(b).alias("fb")), step)["b"]


def permutations_count(k: Column, n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), F.lit(1.0), lambda acc, i: acc * (n - i)) if k is not None else None


def combinations_count(k: Column, n: Column) -> Column:
    """n over k; exact while it fits a double."""
    product = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k.cast("long"), F.lit(1).cast("long"))), F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)
    return F.when(k == 0, 1.0).when((k < 0) | (k > n), 0.0).otherwise(F.round(product))


def spline(x: Column, knots: list[tuple[float, float]], clamp: bool = False) -> Column:
    """The natural cubic spline through the knots at x; beyond them null, or with `clamp` the nearest knot's value."""
    xs, ys = (np.array(v, float) for v in zip(*sorted(knots), strict=True))
    h, n = np.diff(xs), len(xs)
    bend = np.zeros(n)  # second derivatives; none at the ends
    if n > 2:
        a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        bend[1:-1] = np.linalg.solve(a, 6 * np.diff(np.diff(ys) / h))
    at = [F.array(*map(F.lit, v.tolist())) for v in (xs, ys, bend)]
    x = x.cast("double")
    x = F.least(F.greatest(x, F.lit(float(xs[0]))), F.lit(float(xs[-1]))) + x * 0 if clamp else x
    left = F.least(F.greatest(F.size(F.filter(at[0], lambda k: k <= x)), F.lit(1)), F.lit(n - 1))
    (x0, y0, b0), (x1, y1, b1) = ([F.element_at(v, left + i) for v in at] for i in (0, 1))
    t, u = (x - x0) / (x1 - x0), (x1 - x) / (x1 - x0)
    y = u * y0 + t * y1 + (x1 - x0) * (x1 - x0) / 6 * ((u * u * u - u) * b0 + (t * t * t - t) * b1)
    return F.when((x >= float(xs[0])) & (x <= float(xs[-1])), y)
