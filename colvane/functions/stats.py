"""Statistics of table columns. Order statistics go by dense positions, so no list of all values is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colvane.functions.mathx import spline
from colvane.operators.vector import dense_index, running


def in_order(df: DataFrame, value: str) -> DataFrame:
    """(value, i): dense positions; equal values are told by chance numbers, so a frequent one spreads over partitions."""
    return dense_index(df.select(value, F.rand(7).alias("_tie")), value, "_tie").select(value, "i")


def quantiles(df: DataFrame, value: str, ps: list[float]) -> DataFrame:
    """(p, q): with x = p * n, the value at floor(x) of the sorted values, averaged with the one before if x is whole."""
    ranked = in_order(df.where(F.col(value).isNotNull()), value)
    n = ranked.count()
    asked = []
    for p in ps:
        x = p * n
        whole = abs(x - round(x)) < 1e-9
        k = round(x) if whole else int(x)
        for j in [k, k - 1] if whole else [k]:
            asked.append((float(p), max(0, min(n - 1, j))))
    places = df.sparkSession.createDataFrame(asked, "p double, i long")
    return ranked.join(F.broadcast(places), "i").groupBy("p").agg(F.avg(value).alias("q"))


def modes(df: DataFrame, value: str) -> DataFrame:
    """All values of largest count."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(top), "n").select(value, "n")


def moments(x: str):
    """Population variance by mean of squares, as one aggregate each."""
    return {"mean": F.avg(x), "var": F.var_pop(x), "sd": F.stddev_pop(x)}


def svar_as_coded(x: str):
    """Sum of squares over n - 1, less the squared mean; not the unbiased variance."""
    return F.sum(F.col(x) * F.col(x)) / (F.count(x) - 1) - F.avg(x) * F.avg(x)


def regression(x: str, y: str):
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def fit_statistics(df: DataFrame, x: str, y: str) -> DataFrame:
    """rss, tss, r2, mse and rse of the least-squares line, from sums alone."""
    s = df.agg(F.count("*").alias("n"), F.regr_syy(y, x).alias("syy"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"))
    rss = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    return s.select(rss.alias("rss"), F.col("syy").alias("tss"), (1 - rss / F.col("syy")).alias("r2"), (rss / F.col("n")).alias("mse"), F.sqrt(rss / (F.col("n") - 2)).alias("rse"))


def leave_one_out_error(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean squared error of lines fitted without each point, by its leverage: no fit is repeated."""
    m = df.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"))
    j = df.crossJoin(F.broadcast(m))
    dx = F.col(x) - F.col("mx")
    residual = F.col(y) - F.col("my") - F.col("sxy") / F.col("sxx") * dx
    leverage = 1 / F.col("n") + dx * dx / F.col("sxx")
    return j.select(F.pow(residual / (1 - leverage), F.lit(2.0)).alias("e")).agg(F.avg("e").alias("cve"))


def segment_ends(df: DataFrame, value: str, k: int) -> DataFrame:
    """k + 1 ends of k segments of equal width."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return r.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) / k * j)).alias("j", "x"))


def quantile_segment_means(df: DataFrame, value: str, k: int) -> DataFrame:
    """Means of k runs of equal length of the values in order, each value counted ten times so that runs come out even."""
    ranked = in_order(df, value)
    n = ranked.count()
    size = max(1, -(-10 * n // k))
    first, last = F.col("i") * 10, F.col("i") * 10 + 9
    a, b = F.floor(first / size), F.floor(last / size)
    parts = F.transform(F.sequence(a, b), lambda s: F.struct(s.alias("seg"), (F.least(last, (s + 1) * size - 1) - F.greatest(first, s * size) + 1).alias("w")))
    e = ranked.select(value, F.explode(parts).alias("p"))
    return e.groupBy(F.col("p.seg").alias("seg")).agg((F.sum(F.col(value) * F.col("p.w")) / F.sum("p.w")).alias("mean"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, expected, part of chi-square) over all cells, empty ones too: categories are grouped first."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy(a).agg(F.sum("n").alias("ra")), cells.groupBy(b).agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("t"))
    grid = rows.crossJoin(F.broadcast(columns)).crossJoin(F.broadcast(total)).join(cells, [a, b], "left").fillna(0, ["n"])
    e = F.col("ra") * F.col("cb") / F.col("t")
    return grid.select(a, b, "n", e.alias("expected"), (F.pow(F.col("n") - e, F.lit(2.0)) / e).alias("part"))


def frequency_moments(df: DataFrame, value: str, weight: str) -> DataFrame:
    v, w = F.col(value), F.col(weight)
    mu = F.sum(v * w) / F.sum(w)
    return df.agg(mu.alias("mu"), (F.sum(v * v * w) / F.sum(w) - mu * mu).alias("var"), F.max_by(value, F.struct(weight, -v)).alias("mode"))


def frequency_pmf(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Adds each value's share of all weights."""
    total = df.agg(F.sum(weight).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn("pmf", F.col(weight) / F.col("_total")).drop("_total")


def frequency_cdf(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Adds the share of all weights at values up to each one's; sums run in two steps, so a long table is no single task."""
    total = df.agg(F.sum(weight).alias("_total"))
    run = running(df.withColumn("_one", F.lit(0)), "_one", value, weight, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b, "_run")
    return run.crossJoin(F.broadcast(total)).withColumn("cdf", F.col("_run") / F.col("_total")).drop("_one", "_run", "_total")


def frequency_median(df: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: the first value up to which more than half of the weight lies; where exactly half lies up to a value, the
    mean of that and the next."""
    c = frequency_cdf(df, value, weight)
    half = c.agg(F.max(F.when(F.col("cdf") == 0.5, F.col(value))).alias("even"), F.min(F.when(F.col("cdf") > 0.5, F.col(value))).alias("above"))
    return half.select(F.when(F.col("even").isNull(), F.col("above").cast("double")).otherwise((F.col("even") + F.col("above")) / 2).alias("median"))


def frequency_add(df: DataFrame, more: DataFrame, value: str, weight: str) -> DataFrame:
    """Two frequency tables as one."""
    return df.select(value, weight).unionByName(more.select(value, weight)).groupBy(value).agg(F.sum(weight).alias(weight))


def sampled(spark: SparkSession, density, n: int, low: float, high: float, scale: float | None = None) -> DataFrame:
    """(j, x, v): a density at n points from low to high; with `scale` the values are made to sum to it."""
    x = F.lit(low) + F.col("id") * ((high - low) / (n - 1))
    at = spark.range(n).select(F.col("id").alias("j"), x.alias("x")).withColumn("v", density(F.col("x")))
    if scale is None:
        return at
    return at.crossJoin(F.broadcast(at.agg(F.sum("v").alias("_total")))).withColumn("v", F.col("v") * scale / F.col("_total")).drop("_total")


def noisy(df: DataFrame, value: str, size: float, seed: int) -> DataFrame:
    """Adds normal errors, cut at three standard deviations; `size` is the largest error."""
    error = F.least(F.greatest(F.randn(seed), F.lit(-3.0)), F.lit(3.0)) * (size / 3)
    return df.withColumn(value, F.col(value) + error)


def histogram(df: DataFrame, value: str, k: int) -> DataFrame:
    """(j, x, n): counts in k ranges of equal width, with each range's middle; empty ranges count 0."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    j = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) * k), F.lit(k - 1))
    counts = df.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(j, F.lit(0)).alias("j")).agg(F.count("*").alias("n"))
    middles = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("j"), "lo", "hi")
    return middles.join(counts, "j", "left").select("j", (F.col("lo") + (F.col("j") + 0.5) * (F.col("hi") - F.col("lo")) / k).alias("x"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram_spline(df: DataFrame, value: str, k: int):
    """A column function: the natural spline through the k middles and counts of a histogram."""
    knots = [(r["x"], float(r["n"])) for r in histogram(df, value, k).collect()]  # k rows
    return lambda x: spline(x, knots, clamp=True)


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))
