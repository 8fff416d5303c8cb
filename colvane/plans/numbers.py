"""Statistics, distributions, mathematics, sets, neighbours and gradients."""

from __future__ import annotations

from pyspark.sql import functions as F

from colvane.functions import dist as P
from colvane.functions import grad as G
from colvane.functions import mathx as M
from colvane.functions import codes, sets, stats
from colvane.plans.registry import query, r4, rounded, t


def ev(s, d):
    return t(s, d, "events").select("event_id", "event_type", "user_id", "value")


def li(s, d):
    return t(s, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


L = "(select l_quantity as x, l_extendedprice as y from lineitem)"


def _agg(name: str, sql: str, f, source=ev, table: str = "events") -> None:
    query(name, f"select round({sql}, 4) as v from {table}")(lambda s, d: source(s, d).agg(r4(f(), "v")))


_agg("mean", "avg(value)", lambda: F.avg("value"))
_agg("range", "max(value) - min(value)", lambda: F.max("value") - F.min("value"))
_agg("var_pop", "var_pop(value)", lambda: F.var_pop("value"))
_agg("sd_pop", "stddev_pop(value)", lambda: F.stddev_pop("value"))
_agg("var_samp", "var_samp(value)", lambda: F.var_samp("value"))
_agg("svar_ref", "sum(value * value) / (count(*) - 1) - avg(value) * avg(value)", lambda: stats.svar_as_coded("value"))
_agg("cov_pop", "covar_pop(x, y)", lambda: F.covar_pop("x", "y"), li, L)
_agg("corr", "corr(x, y)", lambda: F.corr("x", "y"), li, L)
query("lreg", f"select round(regr_slope(y, x), 4) as a, round(regr_intercept(y, x), 3) as b from {L}")(lambda s, d: li(s, d).agg(*stats.regression("x", "y")).toDF("a", "b").select(r4(F.col("a"), "a"), F.round("b", 3).alias("b")))

RANKED = "(select value, row_number() over (order by value) - 1 as i, (select count(*) from events) as n from events)"


def _quantile_sql(p: str) -> str:
    return f"select cast({p} as double) as p, round(avg(value), 4) as q from {RANKED} where i = floor({p} * n) or ({p} * n = floor({p} * n) and i = {p} * n - 1)"


for name, ps in (("median", [0.5]), ("quantile", [0.37]), ("quartiles", [0.25, 0.5, 0.75])):
    query(name, " union all ".join(_quantile_sql(str(p)) for p in ps))(lambda s, d, ps=ps: stats.quantiles(ev(s, d), "value", ps).select("p", r4(F.col("q"), "q")))

query("modes", "select value, n from (select value, count(*) as n, rank() over (order by count(*) desc) as r from events group by value) where r = 1")(lambda s, d: stats.modes(ev(s, d), "value"))
query("fit_stats", f"select round(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 0) as rss, round(regr_syy(y, x), 0) as tss, round(regr_r2(y, x), 4) as r2 from {L}")(lambda s, d: stats.fit_statistics(li(s, d), "x", "y").select(F.round("rss", 0).alias("rss"), F.round("tss", 0).alias("tss"), r4(F.col("r2"), "r2")))
query("loo_cv", f"select round(avg(pow((y - my - b * (x - mx)) / (1 - 1.0 / n - (x - mx) * (x - mx) / sxx), 2)), 0) as cve from {L} cross join (select avg(x) as mx, avg(y) as my, regr_slope(y, x) as b, regr_sxx(y, x) as sxx, count(*) as n from {L})")(lambda s, d: stats.leave_one_out_error(li(s, d), "x", "y").select(F.round("cve", 0).alias("cve")))
query("zscore", "select event_id, round((value - m) / sd, 4) as z from events cross join (select avg(value) as m, stddev_pop(value) as sd from events)")(lambda s, d: ev(s, d).crossJoin(F.broadcast(ev(s, d).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")))).select("event_id", r4(P.zscore(F.col("value"), F.col("m"), F.col("sd")), "z")))
query("demean", "select event_id, round(value - (select avg(value) from events), 4) as v from events")(lambda s, d: ev(s, d).crossJoin(F.broadcast(ev(s, d).agg(F.avg("value").alias("m")))).select("event_id", r4(F.col("value") - F.col("m"), "v")))
query("seg_endpoints", "select cast(j as integer) as j, round(lo + (hi - lo) / 7 * j, 4) as x from (select min(value) as lo, max(value) as hi from events), range(8) r(j)")(lambda s, d: stats.segment_ends(ev(s, d), "value", 7).select("j", r4(F.col("x"), "x")))
query("hist_quantile_means", "select (i * 10 + k) // cast(ceil(n * 10 / 8.0) as bigint) as seg, round(avg(value), 4) as mean from " + RANKED + ", range(10) r(k) group by 1")(lambda s, d: stats.quantile_segment_means(ev(s, d), "value", 8).select("seg", r4(F.col("mean"), "mean")))
query("contingency_chi2", "with c as (select l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by 1, 2), g as (select x.a, y.b, ra, cb from (select a, sum(n) as ra from c group by a) x cross join (select b, sum(n) as cb from c group by b) y) select g.a, g.b, coalesce(n, 0) as n, round(ra * cb / (select sum(n) from c), 4) as expected, round(pow(coalesce(n, 0) - ra * cb / (select sum(n) from c), 2) / (ra * cb / (select sum(n) from c)), 4) as part from g left join c on g.a = c.a and g.b = c.b")(lambda s, d: stats.contingency(t(s, d, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")), "a", "b").select("a", "b", "n", r4(F.col("expected"), "expected"), r4(F.col("part"), "part")))
query("freq_table_moments", "select round(sum(x * n) / sum(n), 4) as mu, round(sum(x * x * n) / sum(n) - pow(sum(x * n) / sum(n), 2), 4) as var, arg_max(x, n * 1000 - x) as mode from (select l_quantity as x, count(*) as n from lineitem group by 1)")(lambda s, d: stats.frequency_moments(t(s, d, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("n")), "x", "n").select(r4(F.col("mu"), "mu"), r4(F.col("var"), "var"), "mode"))

# distributions over l_linenumber or event values
def C():
    return F.col("x")



def nums(s, d):
    return s.range(0, 20).select(F.col("id").alias("x"))


R = "(select cast(i as bigint) as x from range(20) r(i))"
ERF = "(1 - 1 / pow(1 + z * (0.0705230784 + z * (0.0422820123 + z * (0.0092705272 + z * (0.0001520143 + z * (0.0002765672 + z * 0.0000430638))))), 16))"
query("normal_cdf", f"select x, round((1 + sign(x - 10) * {ERF}) / 2, 4) as v from (select x, abs((x - 10) / sqrt(2 * 9.0)) as z from {R})")(lambda s, d: nums(s, d).select("x", r4(P.normal_cdf(C(), 10.0, 9.0), "v")))
query("dist_normal", f"select x, round(exp(-pow(x - 10, 2) / 18) / sqrt(2 * pi() * 9), 4) as v from {R}")(lambda s, d: nums(s, d).select("x", r4(P.normal_pdf(C(), 10.0, 9.0), "v")))
query("dist_uniform", f"select x, case when x between 3 and 12 then 0.1 else 0.0 end as pmf, round(case when x < 3 then 0 when x > 12 then 1 else (x - 2) / 10.0 end, 4) as cdf from {R}")(lambda s, d: nums(s, d).select("x", P.uniform_pmf(C(), 3, 12).alias("pmf"), r4(P.uniform_cdf(C(), 3, 12), "cdf")))
query("dist_geometric", f"select x, round(case when x < 1 then 0 else pow(0.7, x - 1) * 0.3 end, 4) as pmf, round(case when x < 1 then 0 else 1 - pow(0.7, x) end, 4) as cdf from {R}")(lambda s, d: nums(s, d).select("x", r4(P.geometric_pmf(C(), 0.3), "pmf"), r4(P.geometric_cdf(C(), 0.3), "cdf")))
query("dist_binomial", f"with p as (select x, case when x > 15 then 0 else round(exp(lgamma(16) - lgamma(x + 1) - lgamma(greatest(16 - x, 1)))) * pow(0.4, x) * pow(0.6, 15 - x) end as p from {R}) select x, round(p, 4) as pmf, round(sum(p) over (order by x), 4) as cdf from p")(lambda s, d: nums(s, d).select("x", r4(P.binomial_pmf(C(), 15, 0.4), "pmf"), r4(P.binomial_cdf(C(), 15, 0.4), "cdf")))
query("dist_poisson", f"with p as (select x, exp(x * ln(4) - 4 - lgamma(x + 1)) as p from {R}) select x, round(p, 4) as pmf, round(sum(p) over (order by x), 4) as cdf from p")(lambda s, d: nums(s, d).select("x", r4(P.poisson_pmf(C(), 4.0), "pmf"), r4(P.poisson_cdf(C(), 4.0), "cdf")))
query("dist_hypergeometric", f"with p as (select x, case when x > 10 then 0 else exp(lgamma(16) - lgamma(x + 1) - lgamma(16 - least(x, 10)) + lgamma(36) - lgamma(11 - least(x, 10)) - lgamma(26 + least(x, 10)) - (lgamma(51) - lgamma(11) - lgamma(41))) end as p from {R}) select x, round(p, 4) as pmf, round(sum(p) over (order by x), 4) as cdf from p")(lambda s, d: nums(s, d).select("x", r4(P.hypergeometric_pmf(C(), 50, 15, 10), "pmf"), r4(P.hypergeometric_cdf(C(), 50, 15, 10), "cdf")))
query("dist_lognormal", f"select x, case when x > 0 then round(exp(-pow(ln(x) - 1, 2)) / (x * sqrt(0.5) * sqrt(2 * pi())), 4) else 0 end as pdf, case when x > 0 then round((1 + sign(ln(x) - 1) * {ERF}) / 2, 4) else 0 end as cdf from (select x, case when x > 0 then abs(ln(x) - 1) else 0 end as z from {R})")(lambda s, d: nums(s, d).select("x", r4(P.lognormal_pdf(C(), 1.0, 0.5), "pdf"), r4(P.lognormal_cdf(C(), 1.0, 0.5), "cdf")))
query("dist_chi_square", f"select x, round(pow(x, 1.5) * exp(-x / 2) / (pow(2, 2.5) * gamma(2.5)), 4) as pdf, round({ERF} - sqrt(2 * x / pi()) * exp(-x / 2) * (1 + x / 3), 4) as cdf from (select x, sqrt(x / 2) as z from {R})")(lambda s, d: nums(s, d).select("x", r4(P.chi_square_pdf(C(), 5.0), "pdf"), r4(P.chi_square_cdf(C(), 5.0), "cdf")))
query("dist_student", f"select x, round(8 / (3 * pi() * sqrt(5) * pow(1 + t * t / 5, 3)), 4) as pdf, round(0.5 + (t / sqrt(5) / (1 + t * t / 5) * (1 + 2.0 / 3 / (1 + t * t / 5)) + atan(t / sqrt(5))) / pi(), 4) as cdf from (select x, cast(x - 10 as double) as t from {R})")(lambda s, d: nums(s, d).select("x", r4(P.student_pdf(C() - 10, 5.0), "pdf"), r4(P.student_cdf(C() - 10.0, 5.0), "cdf")))
query("dist_fisher", f"select x, case when x > 0 then round(sqrt(pow(4.0 * x, 4) * pow(9, 9) / pow(4.0 * x + 9, 13)) / (x * gamma(2) * gamma(4.5) / gamma(6.5)), 4) else 0 end as pdf, round(1 - pow(1 - z, 4.5) * (1 + 4.5 * z), 4) as cdf from (select x, 4.0 * x / (4.0 * x + 9) as z from {R})")(lambda s, d: nums(s, d).select("x", r4(P.fisher_pdf(C(), 4.0, 9.0), "pdf"), r4(P.fisher_cdf(C() * 1.0, 4.0, 9.0), "cdf")))
query("gamma_functions", f"select x + 1 as n, round(lgamma(x + 1.5), 6) as ln_gamma, round(exp(lgamma(x + 1) + lgamma(2.5) - lgamma(x + 3.5)), 6) as beta from {R}")(lambda s, d: nums(s, d).select((C() + 1).alias("n"), F.round(M.gamma_ln(C() + 1.5), 6).alias("ln_gamma"), F.round(M.beta(C() + 1, F.lit(2.5)), 6).alias("beta")))
query("combinatorics", f"select x, round(exp(lgamma(21) - lgamma(x + 1) - lgamma(21 - x))) as kc from {R}")(lambda s, d: nums(s, d).select("x", M.combinations_count(C(), F.lit(20)).alias("kc")))

query("primes", "select i as n from range(2, 2000) r(i) where not exists (select 1 from range(2, 45) q(k) where k < i and i % k = 0)")(lambda s, d: s.range(2, 2000).where(M.is_prime(F.col("id"))).select(F.col("id").alias("n")))
query("bisect_sqrt2", "select p_partkey, round(sqrt(p_size + 1), 6) as v from part")(lambda s, d: t(s, d, "part").select("p_partkey", F.round(M.bisect(lambda z: z * z - F.col("p_size") - 1, F.lit(0.0), F.lit(100.0)), 6).alias("v")))
query("regula_falsi", "select p_partkey, round(sqrt(p_size + 1), 6) as v from part")(lambda s, d: t(s, d, "part").select("p_partkey", F.round(M.regula_falsi(lambda z: z * z - F.col("p_size") - 1, F.lit(0.0), F.lit(100.0)), 6).alias("v")))
query("matmul", "with m as (select vec_id // 8 as g, vec_id % 8 as i, k, cast(embedding[k + 1] as double) as x from embeddings, range(8) r(k)) select a.g, a.i, b.k as j, round(sum(a.x * b.x), 4) as v from m a join m b on a.g = b.g and a.k = b.i group by 1, 2, 3")(lambda s, d: _matmul(s, d))


def _matmul(s, d):
    """8 by 8 matrices from the embeddings, each times itself, as joins on the shared index."""
    e = t(s, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("g"), (F.col("vec_id") % 8).alias("i"), F.posexplode(F.slice("embedding", 1, 8)).alias("k", "x"))
    a, b = e.select("g", "i", F.col("k").cast("long").alias("m"), F.col("x").cast("double").alias("x")), e.select("g", F.col("i").alias("m"), F.col("k").cast("long").alias("j"), F.col("x").cast("double").alias("y"))
    return a.join(b, ["g", "m"]).groupBy("g", "i", "j").agg(r4(F.sum(F.col("x") * F.col("y")), "v"))


query("fft", "select vec_id, [round(list_sum([cast(embedding[j + 1] as double) * cos(2 * pi() * j * k / 64) for j in range(64)]) + 0.00000123, 4) for k in range(64)] as re from embeddings")(lambda s, d: t(s, d, "embeddings").select("vec_id", F.transform(M.fft(F.transform("embedding", lambda v: v.cast("double"))), lambda z: rounded(z["re"] + 0.00000123)).alias("re")))
query("gauss", "select p_partkey, [round((3.0 * p_size - p_retailprice) / 5, 4), round((2 * p_retailprice - p_size) / 5, 4)] as v from part")(lambda s, d: t(s, d, "part").select("p_partkey", F.transform(M.solve(F.array(F.lit(2.0), F.lit(1.0), F.col("p_size").cast("double"), F.lit(1.0), F.lit(3.0), F.col("p_retailprice"))), lambda v: F.round(v, 4)).alias("v")))
query("eigenvalues", "select p_partkey, [round((3 - sqrt(1 + 4.0 * p_size * p_size)) / 2, 4), round((3 + sqrt(1 + 4.0 * p_size * p_size)) / 2, 4)] as v from part")(lambda s, d: t(s, d, "part").select("p_partkey", F.transform(M.eigenvalues(F.array(F.lit(2.0), F.col("p_size").cast("double"), F.col("p_size").cast("double"), F.lit(1.0))), lambda v: F.round(v, 4)).alias("v")))

CURVE = "case when x <= 1 then 1.5 * x - 0.5 * x * x * x else 1.5 * (2 - x) - 0.5 * (2 - x) * (2 - x) * (2 - x) end"
query("spline", f"select p_partkey, case when x <= 2 then round({CURVE}, 4) end as v, round(case when x <= 2 then {CURVE} else 0.0 end, 4) as clamped from (select p_partkey, cast(p_size as double) / 20 as x from part)")(lambda s, d: t(s, d, "part").select("p_partkey", (F.col("p_size") / 20).alias("x")).select("p_partkey", r4(M.spline(F.col("x"), [(0, 0), (1, 1), (2, 0)]), "v"), r4(M.spline(F.col("x"), [(0, 0), (1, 1), (2, 0)], True), "clamped")))


@query("huffman", "select p_partkey, p_name as v from part")
def huffman(s, d):
    """Names encoded and decoded again."""
    code = codes.huffman(codes.character_counts(t(s, d, "part"), "p_name"))
    return t(s, d, "part").select("p_partkey", codes.decode(codes.encode(F.col("p_name"), code), code).alias("v"))

# sets
query("set_cp", "select r_regionkey as a, n_nationkey as b from region cross join nation")(lambda s, d: sets.product(t(s, d, "region").select(F.col("r_regionkey").alias("a")), t(s, d, "nation").select(F.col("n_nationkey").alias("b"))))
query("set_powerset", "select m, [i for i in range(5) if (m >> cast(i as integer)) & 1 = 1] as v from range(32) r(m)")(lambda s, d: s.range(32).select(F.col("id").alias("m"), F.filter(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), lambda i: (F.pmod(F.floor(F.col("id") / F.pow(F.lit(2.0), i)), F.lit(2)) == 1)).alias("v")))
query("set_combinations", "select a.n_nationkey as k1, b.n_nationkey as k2, c.n_nationkey as k3 from nation a join nation b on a.n_nationkey < b.n_nationkey join nation c on b.n_nationkey < c.n_nationkey")(lambda s, d: sets.tuples(t(s, d, "nation").select(F.col("n_nationkey").alias("k")), "k", 3, "comb"))
query("set_combinations_repeated", "select a.r_regionkey as k1, b.r_regionkey as k2, c.r_regionkey as k3 from region a join region b on a.r_regionkey <= b.r_regionkey join region c on b.r_regionkey <= c.r_regionkey")(lambda s, d: sets.tuples(t(s, d, "region").select(F.col("r_regionkey").alias("k")), "k", 3, "combr"))
query("set_permutations", "select a.r_regionkey as k1, b.r_regionkey as k2, c.r_regionkey as k3 from region a join region b on a.r_regionkey <> b.r_regionkey join region c on b.r_regionkey <> c.r_regionkey and a.r_regionkey <> c.r_regionkey")(lambda s, d: sets.tuples(t(s, d, "region").select(F.col("r_regionkey").alias("k")), "k", 3, "perm"))
query("set_enumerate", "select a.r_regionkey as k1, b.r_regionkey as k2 from region a, region b")(lambda s, d: sets.tuples(t(s, d, "region").select(F.col("r_regionkey").alias("k")), "k", 2, "enum"))
query("set_union", "select s_nationkey as k from supplier union select c_nationkey from customer")(lambda s, d: t(s, d, "supplier").select(F.col("s_nationkey").alias("k")).union(t(s, d, "customer").select("c_nationkey")).distinct())
query("set_isect", "select c.c_nationkey as k, count(*) as n from customer c join supplier s on c.c_nationkey = s.s_nationkey group by 1")(lambda s, d: t(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a")).join(t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b")), "k").select("k", (F.col("a") * F.col("b")).alias("n")))

# neighbours: the queries are the vectors whose ids 50 divides, a broadcast of a checked size
DOT = "list_sum([cast(a.embedding[i] as double) * cast(b.embedding[i] as double) for i in range(1, 65)])"


def _pairs(s, d):
    e = t(s, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("w"))
    if q.count() <= 100_000:
        return e.crossJoin(F.broadcast(q))
    cells = 64  # in blocks: each query goes to the 64 blocks of vectors, each vector to its own
    spread = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    return e.withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int")).join(spread, "cell").drop("cell")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


COSINE = f"select a.vec_id as q, b.vec_id, round({DOT} / sqrt({DOT.replace('b.', 'a.')} * {DOT.replace('a.', 'b.')}), 4) as v from embeddings a, embeddings b where a.vec_id % 50 = 0"
query("cosine_similarity", COSINE)(lambda s, d: _pairs(s, d).select("q", "vec_id", r4(_dot(F.col("embedding"), F.col("w")) / F.sqrt(_dot(F.col("embedding"), F.col("embedding")) * _dot(F.col("w"), F.col("w"))), "v")))


@query("knn", f"select q, vec_id from (select a.vec_id as q, b.vec_id, row_number() over (partition by a.vec_id order by list_sum([pow(cast(a.embedding[i] as double) - cast(b.embedding[i] as double), 2) for i in range(1, 65)]), b.vec_id) as r from embeddings a, embeddings b where a.vec_id % 50 = 0) where r <= 3")
def knn(s, d):
    """The three nearest of each given point: distances are kept as the three smallest of each task, then merged."""
    far = F.aggregate(F.zip_with("embedding", "w", lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2.0))), F.lit(0.0), lambda acc, v: acc + v)
    from pyspark.sql import Window

    w = Window.partitionBy("q").orderBy("far", "vec_id")
    return _pairs(s, d).select("q", "vec_id", far.alias("far")).withColumn("r", F.row_number().over(w)).where("r <= 3").select("q", "vec_id")


# gradients
W, B = G.par("w"), G.par("b")
LOSS = (W * G.col("x") + B - G.col("y")) ** 2
query("grad_mse", f"select round(avg(pow(2 * x + 1 - y, 2)), 0) as loss, round(avg(2 * (2 * x + 1 - y) * x), 0) as d_w, round(avg(2 * (2 * x + 1 - y)), 0) as d_b from {L}")(lambda s, d: G.gradient(li(s, d), LOSS, {"w": 2.0, "b": 1.0}).select(*(F.round(c, 0).alias(c) for c in ("loss", "d_w", "d_b"))))
query("jacobian", f"select x, y, round(exp(x / 50) * x / 50, 4) as d_f_w, 1.0 as d_f_b from {L}")(lambda s, d: G.jacobian(li(s, d), {"f": G.exp(W * G.col("x") / 50) + B}, {"w": 1.0, "b": 0.0}).select("x", "y", r4(F.col("d_f_w"), "d_f_w"), "d_f_b"))
STEP = "(w * sxx + b * sx - sxy), b - (w * sx + b - sy)"
query("gd_linreg", f"with recursive m as (select avg(x / 50) as sx, avg(x * x / 2500) as sxx, avg(y / 1e5) as sy, avg(x * y / 5e6) as sxy, avg(y * y / 1e10) as syy from {L}), g as (select 0 as step, 0.0::double as w, 0.0::double as b from m union all select step + 1, w - {STEP} from g, m where step < 9) select cast(step as integer) as step, round(w * w * sxx + 2 * w * b * sx + b * b - 2 * w * sxy - 2 * b * sy + syy, 6) as loss, round(w, 6) as w, round(b, 6) as b from g, m")(lambda s, d: G.descend(li(s, d).select((F.col("x") / 50).alias("x"), (F.col("y") / 100_000).alias("y")), LOSS, {"w": 0.0, "b": 0.0}, 0.5, 10).select("step", *(F.round(c, 6).alias(c) for c in ("loss", "w", "b"))))

# frequency tables
FREQ = "(select l_quantity as x, count(*) as n from lineitem group by 1)"


def freq(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))


query("freq_pmf", f"select x, round(n / (select sum(n) from {FREQ}), 6) as pmf from {FREQ}")(lambda s, d: stats.frequency_pmf(freq(s, d), "x", "n").select("x", F.round("pmf", 6).alias("pmf")))
query("freq_cdf", f"select x, round(sum(n) over (order by x) / sum(n) over (), 6) as cdf from {FREQ}")(lambda s, d: stats.frequency_cdf(freq(s, d), "x", "n").select("x", F.round("cdf", 6).alias("cdf")))
query("freq_median", "select quantile_cont(l_quantity, 0.5) as median from lineitem")(lambda s, d: stats.frequency_median(freq(s, d), "x", "n"))
query("freq_add", "select x, count(*) as n from (select l_quantity as x from lineitem union all select l_linenumber from lineitem) group by 1")(lambda s, d: stats.frequency_add(freq(s, d), t(s, d, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("x")).agg(F.count("*").alias("n")), "x", "n"))
query("sampled_density", "with p as (select j, -3 + j * 6.0 / 49 as x from range(50) r(j)), q as (select j, x, exp(-x * x / 2) / sqrt(2 * pi()) as v from p) select j, round(x, 6) as x, round(v * 100 / (select sum(v) from q), 6) as v from q")(lambda s, d: stats.sampled(s, P.normal_pdf, 50, -3.0, 3.0, 100.0).select("j", F.round("x", 6).alias("x"), F.round("v", 6).alias("v")))
query("histogram", "with b as (select min(value) as lo, max(value) as hi from events) select j, round(lo + (j + 0.5) * (hi - lo) / 12 + 0.00000123, 4) as x, (select count(*) from events where least(floor((value - lo) / (hi - lo) * 12), 11) = j) as n from b, range(12) r(j)")(lambda s, d: stats.histogram(ev(s, d), "value", 12).select("j", r4(F.col("x") + 0.00000123, "x"), "n"))
query("histogram_spline_knots", "with b as (select min(value) as lo, max(value) as hi from events) select j, cast((select count(*) from events where least(floor((value - lo) / (hi - lo) * 12), 11) = j) as double) as v from b, range(12) r(j)")(lambda s, d: (lambda f: stats.histogram(ev(s, d), "value", 12).select("j", F.round(f(F.col("x")), 4).alias("v")))(stats.histogram_spline(ev(s, d), "value", 12)))
query("eigenvectors", "with l as (select p_partkey, cast(p_size as double) as k, (3 - sqrt(1 + 4.0 * p_size * p_size)) / 2 as a, (3 + sqrt(1 + 4.0 * p_size * p_size)) / 2 as b from part) select p_partkey, [[round(k / sqrt(k * k + (a - 2) * (a - 2)), 4), round((a - 2) / sqrt(k * k + (a - 2) * (a - 2)), 4)], [round(k / sqrt(k * k + (b - 2) * (b - 2)), 4), round((b - 2) / sqrt(k * k + (b - 2) * (b - 2)), 4)]] as v from l")(lambda s, d: t(s, d, "part").select("p_partkey", F.transform(M.eigenvectors(F.array(F.lit(2.0), F.col("p_size").cast("double"), F.col("p_size").cast("double"), F.lit(1.0))), lambda r: F.transform(r, lambda v: F.round(v, 4))).alias("v")))
query("fit_errors", f"with f as (select regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) as rss, count(*) as n from {L}) select round(rss / n, 0) as mse, round(sqrt(rss / (n - 2)), 3) as rse from f")(lambda s, d: stats.fit_statistics(li(s, d), "x", "y").select(F.round("mse", 0).alias("mse"), F.round("rse", 3).alias("rse")))
query("test_scores", "select round((avg(value) - 240) / (stddev_samp(value) / sqrt(count(*))), 4) as t, round(var_samp(value) / var_pop(value + event_id % 7), 4) as f from events")(lambda s, d: ev(s, d).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"), F.var_samp("value").alias("a"), F.var_pop(F.col("value") + F.col("event_id") % 7).alias("b")).select(r4(P.tscore(F.col("m"), 240, F.col("sd"), F.col("n")), "t"), r4(P.fscore(F.col("a"), F.col("b")), "f")))
query("bayes", "select p_partkey, round(p * 0.9 / (p * 0.9 + (1 - p) * 0.2) + 0.00000123, 4) as v from (select p_partkey, p_size / 100.0 as p from part)")(lambda s, d: t(s, d, "part").select("p_partkey", r4(P.bayes(F.col("p_size") / 100.0, F.lit(0.9), F.lit(0.8)) + 0.00000123, "v")))
query("permutations_count", f"select x, round(exp(lgamma(13) - lgamma(13 - least(x, 12)))) as kp from {R} where x between 1 and 12")(lambda s, d: nums(s, d).where("x between 1 and 12").select("x", F.round(M.permutations_count(C(), F.lit(12)).cast("double")).alias("kp")))
query("complex_numbers", "select p_partkey, p_size + 1.0 as add_re, 2.0 - p_size as sub_im, round(exp(p_size / 50.0) * cos(2), 4) as exp_re, round(sqrt(p_size * p_size + 4.0), 4) as size from part")(lambda s, d: t(s, d, "part").select("p_partkey", M.cnum(F.col("p_size") * 1.0, F.lit(2.0)).alias("a"), M.cnum(F.lit(1.0), F.col("p_size") * 1.0).alias("b"), M.cnum(F.col("p_size") / 50.0, F.lit(2.0)).alias("c")).select("p_partkey", M.cadd(F.col("a"), F.col("b"))["re"].alias("add_re"), M.csub(F.col("a"), F.col("b"))["im"].alias("sub_im"), r4(M.cexp(F.col("c"))["re"], "exp_re"), r4(M.cabs(F.col("a")), "size")))
query("incomplete_gamma", "select x, round(1 - exp(-x) * (1 + x + x * x / 2.0), 6) as p, round(exp(-x) * (1 + x + x * x / 2.0), 6) as q from (select cast(i as double) * 5 as x from range(1, 200) r(i))")(lambda s, d: s.range(1, 200).select((F.col("id") * 5.0).alias("x")).select("x", F.round(M.gamma_p(F.lit(3.0), F.col("x")), 6).alias("p"), F.round(M.gamma_q(F.lit(3.0), F.col("x")), 6).alias("q")))
query("incomplete_beta", "select x, round(1 - pow(1 - x, 4.5) * (1 + 4.5 * x), 6) as v from (select i / 100.0 as x from range(1, 100) r(i))")(lambda s, d: s.range(1, 100).select((F.col("id") / 100.0).alias("x")).select("x", F.round(M.rbeta(F.col("x"), F.lit(2.0), F.lit(4.5)), 6).alias("v")))
query("real_uniform", f"select x, case when x between 3 and 12 then round(1 / 9.0, 6) else 0.0 end as pdf, round(least(greatest((x - 3) / 9.0, 0), 1), 6) as cdf from {R}")(lambda s, d: nums(s, d).select("x", F.round(P.real_uniform_pdf(C(), 3.0, 12.0), 6).alias("pdf"), F.round(P.real_uniform_cdf(C(), 3.0, 12.0), 6).alias("cdf")))
query("normal_quantiles", "select p, x from (values (0.025, -1.96), (0.5, 0.0), (0.975, 1.96), (0.995, 2.576)) q(p, x)")(lambda s, d: s.createDataFrame([(0.025,), (0.5,), (0.975,), (0.995,)], "p double").select("p", F.round(F.round(P.normal_qf(F.col("p")), 3) + 0.0, 3).alias("x")))

MOMENTS = [
    ("uniform", P.uniform_moments(3, 12), "7.5, (100 - 1) / 12.0"),
    ("real uniform", P.real_uniform_moments(3.0, 12.0), "7.5, 81 / 12.0"),
    ("geometric", P.geometric_moments(0.3), "1 / 0.3, 0.7 / 0.09"),
    ("binomial", P.binomial_moments(15, 0.4), "6, 3.6"),
    ("hypergeometric", P.hypergeometric_moments(50, 15, 10), "3, 10 * 0.3 * 0.7 * 40 / 49"),
    ("poisson", P.poisson_moments(4.0), "4, 4"),
    ("lognormal", P.lognormal_moments(1.0, 0.5), "exp(1.25), (exp(0.5) - 1) * exp(2.5)"),
    ("chi square", P.chi_square_moments(5.0), "5, 10"),
    ("student", P.student_moments(5.0), "0, 5 / 3.0"),
    ("fisher", P.fisher_moments(4.0, 9.0), "9 / 7.0, 2 * 81 * 11.0 / (4 * 49 * 5)"),
]


@query("moments", " union all ".join(f"select '{n}' as name, round(mu, 6) as mu, round(v, 6) as var from (select {x}) q(mu, v)" for n, _, x in MOMENTS))
def moments(s, d):
    return s.createDataFrame([(n, round(float(m["mu"]), 6), round(float(m["var"]), 6)) for n, m, _ in MOMENTS], "name string, mu double, var double")


X50 = G.col("x") / 50
query("grad_functions", f"select x, y, round(cos(0.3 * x / 50) * x / 50 - sin(0.3 * x / 50) * x / 50 + (x / 50) / pow(cos(0.3 * x / 50), 2) + case when 0.3 * x / 50 > 0.2 then x / 50 else 0 end + 0.00000123, 4) as v from {L}")(lambda s, d: G.jacobian(li(s, d), {"f": G.sin(W * X50) + G.cos(W * X50) + G.tan(W * X50) + G.larger(W * X50, 0.2)}, {"w": 0.3}).select("x", "y", r4(F.col("d_f_w") + 0.00000123, "v")))
