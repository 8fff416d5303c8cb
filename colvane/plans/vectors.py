"""Positional operators, folds and scans over the vector of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from colvane.language import Language
from colvane.operators import nested as A
from colvane.operators.vector import Vector, dense_index, running
from colvane.plans.registry import E, N, ev, events_vector, iv, query, r4, rounded, t

V = "round(v, 4) as v"
query("enumerate", "select cast(i as bigint) as i, cast(i as bigint) as v from range(10000) r(i)")(lambda s, d: Vector.enumerate(s, 10_000).df)
query("first", f"select v from {E} where i = 0")(lambda s, d: ev(s, d).first())
query("reverse", f"select {N} - 1 - i as i, {V} from {E}")(lambda s, d: iv(ev(s, d).reverse()))
query("rotate", f"select (i + 100) % {N} as i, {V} from {E}")(lambda s, d: iv(ev(s, d).rotate(100)))
query("take", f"select i, {V} from {E} where i < 50")(lambda s, d: iv(ev(s, d).take(50)))
query("take_cyclic", f"with e as (select * from {E} where i < 7) select r.i, {V.replace('v,', 'e.v,')} from range(20) r(i) join e on r.i % 7 = e.i")(lambda s, d: iv(ev(s, d).take(7).take(20)))
query("drop", f"select i - 9000 as i, {V} from {E} where i >= 9000")(lambda s, d: iv(ev(s, d).drop(9000)))
query("at_index", f"select r.i, {V.replace('v,', 'e.v,')} from range(1000) r(i) join {E} e on e.i = (r.i * 37) % {N}")(lambda s, d: iv(ev(s, d).at(Vector.enumerate(s, 1000).map(lambda v: (v * 37) % ev(s, d).n))))
query("amend", f"select i, case when i in (1, 5, 70) then -1.0 else round(v, 4) end as v from {E}")(lambda s, d: iv(ev(s, d).amend(-1.0, [1, 5, 70])))
query("find", f"select i from {E} where v = (select v from {E} where i = 10)")(lambda s, d: ev(s, d).df.join(F.broadcast(ev(s, d).df.where("i = 10").select("v")), "v").select("i"))
query("where", f"select i from {E} where v > 250")(lambda s, d: ev(s, d).map(lambda v: (v > 250).cast("long")).where())
query("expand", f"select i, cast(c as integer) as copy from {E}, lateral (select unnest(range(1, 1 + cast(floor(v) as bigint) % 4)) as c) where cast(floor(v) as bigint) % 4 > 0")(lambda s, d: ev(s, d).map(lambda v: F.floor(v) % 4).expand())
query("grade_up", f"select row_number() over (order by v, i) - 1 as i, i as v from {E}")(lambda s, d: ev(s, d).grade_up().df)
query("grade_down", f"select row_number() over (order by v desc, i desc) - 1 as i, i as v from {E}")(lambda s, d: ev(s, d).grade_down().df)
query("sort", f"select row_number() over (order by v, i) - 1 as i, {V} from {E}")(lambda s, d: iv(ev(s, d).sort()))
query("topk", f"select i, {V} from {E} order by v desc, i desc limit 10")(lambda s, d: iv(Vector(ev(s, d).top(10))))
query("rank_grade_grade", f"select i, row_number() over (order by v, i) - 1 as r from {E}")(lambda s, d: ev(s, d).grade_up().df.select(F.col("v").alias("i"), F.col("i").alias("r")))
query("group", f"select event_type as v, list(i order by i) as places from {E} group by event_type")(lambda s, d: Vector(events_vector(s, d).select("i", F.col("event_type").alias("v"))).group())
query("unique", f"select v, min(i) as i from {E} group by v")(lambda s, d: ev(s, d).unique())
query("fdist", f"select v, count(*) as n from {E} group by v")(lambda s, d: ev(s, d).df.groupBy("v").agg(F.count("*").alias("n")))
query("cut", f"select (case when i >= 10 then 1 else 0 end + case when i >= 500 then 2 else 0 end) as seg, count(*) as n, round(sum(v), 4) as total from {E} group by 1")(lambda s, d: ev(s, d).cut([10, 500, 500]).groupBy("seg").agg(F.count("*").alias("n"), r4(F.sum("v"), "total")))
query("split", f"select i // 64 as seg, i % 64 as j, {V} from {E}")(lambda s, d: ev(s, d).split(64).select("seg", "j", r4(F.col("v"), "v")))
query("split_cyclic", f"select i // 6 * 3 + case when i % 6 < 1 then 0 when i % 6 < 3 then 1 else 2 end as seg, case when i % 6 < 1 then 0 when i % 6 < 3 then i % 6 - 1 else i % 6 - 3 end as j, {V} from {E}")(lambda s, d: ev(s, d).split([1, 2, 3]).select("seg", F.col("j").cast("long").alias("j"), r4(F.col("v"), "v")))
query("reshape", f"select i // 20 as r, i % 20 as c, {V} from {E} where i < {N} // 20 * 20")(lambda s, d: (lambda x: x.reshape(x.n // 20, 20))(ev(s, d)).select("r", "c", r4(F.col("v"), "v")))
query("transpose", f"select i % 20 as r, i // 20 as c, {V} from {E} where i < {N} // 20 * 20")(lambda s, d: (lambda x: x.reshape(x.n // 20, 20))(ev(s, d)).select(F.col("c").alias("r"), F.col("r").alias("c"), r4(F.col("v"), "v")))
query("shaped", f"select i // 40 as d0, i // 10 % 4 as d1, i % 10 as d2, {V} from {E} where i < {N} // 40 * 40")(lambda s, d: (lambda x: x.take(x.n // 40 * 40).shaped(-1, 4, 10))(ev(s, d)).select("d0", "d1", "d2", r4(F.col("v"), "v")))
query("shape", "select vec_id, [2, 32] as v from embeddings")(lambda s, d: t(s, d, "embeddings").select("vec_id", A.shape(A.split(F.col("embedding"), 32)).alias("v")))
query("match", f"with e as (select * from {E}) select cast(min(case when a.v = b.v then 1 else 0 end) as bigint) as v, cast(min(case when a.v = (case when b.i = 3 then -1.0 else b.v end) then 1 else 0 end) as bigint) as w from e a full join e b on a.i = b.i")(lambda s, d: ev(s, d).matches(ev(s, d)).crossJoin(ev(s, d).matches(ev(s, d).amend(-1.0, [3])).select(F.col("v").alias("w"))))
query("join_concat", f"select i, {V} from {E} union all select i + {N}, round(-v, 4) from {E} where i < 100")(lambda s, d: iv(ev(s, d).concat(ev(s, d).take(100).map(lambda v: -v))))
query("index_in_depth", "select vec_id, round(cast(embedding[36] as double), 4) as v from embeddings")(lambda s, d: t(s, d, "embeddings").select("vec_id", r4(A.at_depth(A.split(F.col("embedding"), 32), 1, 3).cast("double"), "v")))
query("amend_in_depth", "select vec_id, round(list_sum([cast(x as double) for x in embedding]) - cast(embedding[36] as double) + 9, 4) as v from embeddings")(lambda s, d: t(s, d, "embeddings").select("vec_id", r4(F.aggregate(F.flatten(A.amend_depth(A.split(F.col("embedding"), 32), F.lit(9).cast("float"), 1, 3)), F.lit(0.0), lambda a, x: a + x), "v")))
query("each", f"select i, round(v * v + 1, 4) as v from {E}")(lambda s, d: iv(ev(s, d).map(lambda v: v * v + 1)))
query("each2", f"select a.i, round(a.v - b.v, 4) as v from {E} a join {E} b on b.i = a.i + 500")(lambda s, d: iv(ev(s, d).zip(ev(s, d).drop(500), lambda a, b: a - b)))
query("each_left", f"select i, round(100 - v, 4) as v from {E}")(lambda s, d: iv(ev(s, d).each_left(F.lit(100), lambda a, b: a - b)))
query("each_right", f"select i, round(v - 100, 4) as v from {E}")(lambda s, d: iv(ev(s, d).each_right(F.lit(100), lambda a, b: a - b)))
query("each_left_vector", f"select i, [round(0 - v, 4), round(1 - v, 4), round(2 - v, 4)] as r from {E}")(lambda s, d: ev(s, d).each_left(Vector.enumerate(s, 3), lambda a, b: F.round(a - b, 4)))
query("each_right_vector", f"select i, [round(v - 0, 4), round(v - 1, 4), round(v - 2, 4)] as r from {E}")(lambda s, d: ev(s, d).each_right(Vector.enumerate(s, 3), lambda a, b: F.round(a - b, 4)))
query("each_pair", f"select i - 1 as i, round(p - v, 4) as v from (select i, v, lag(v) over (order by i) as p from {E}) where i > 0")(lambda s, d: iv(ev(s, d).each_pair(lambda a, b: a - b)))
query("each_index", f"select i, round(i * 2 + v, 4) as v from {E}")(lambda s, d: iv(ev(s, d).map_index(lambda i, v: i * 2 + v)))

for name, op, sql in (
    ("over_sum", "+", "round(sum(v), 2)"),
    ("over_min", "&", "min(v)"),
    ("over_max", "|", "max(v)"),
    ("over_minus", "-", f"round(2 * (select v from {E} where i = 0) - sum(v), 2)"),
):
    query(name, f"select {sql} as v from {E}")(lambda s, d, op=op: ev(s, d).over(op).select(F.round("v", 2).alias("v")))
query("over_product", f"select g, round(product(1 + v / 1000), 4) as v from (select i // 10 as g, v from {E}) group by g")(lambda s, d: ev(s, d).df.groupBy(F.floor(F.col("i") / 10).alias("g")).agg(r4(F.product(1 + F.col("v") / 1000), "v")))
query("over_divide", f"select round(pow((select 1 + v / 1e8 from {E} where i = 0), 2) / product(1 + v / 1e8), 6) as v from {E}")(lambda s, d: ev(s, d).map(lambda v: 1 + v / 1e8).over("%").select(F.round("v", 6).alias("v")))
query("over_join", "select vec_id, [round(cast(x as double), 4) for x in embedding] as v from embeddings")(lambda s, d: t(s, d, "embeddings").select("vec_id", F.transform(A.over_join(A.split(F.col("embedding"), 7)), lambda x: rounded(x.cast("double"))).alias("v")))
query("over_neutral", f"select round(1000 + coalesce(sum(v), 0), 2) as v from {E}")(lambda s, d: ev(s, d).over("+", 1000).select(F.round("v", 2).alias("v")))
query("over_each", "select vec_id, [round(list_sum([cast(x as double) for x in embedding[1:32]]), 4), round(list_sum([cast(x as double) for x in embedding[33:64]]), 4)] as v from embeddings")(lambda s, d: t(s, d, "embeddings").select("vec_id", F.transform(F.transform(A.split(F.col("embedding"), 32), lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x)), rounded).alias("v")))
FRAME = "over (order by i rows unbounded preceding)"
query("scan_sum", f"select i, round(sum(v) {FRAME}, 2) as v from {E}")(lambda s, d: ev(s, d).scan("+").df.select("i", F.round("v", 2).alias("v")))
query("scan_max", f"select i, max(v) {FRAME} as v from {E}")(lambda s, d: ev(s, d).scan("|").df)
query("scan_min", f"select i, min(v) {FRAME} as v from {E}")(lambda s, d: ev(s, d).scan("&").df)
query("scan_product", f"select i, round(product(1 + v / 1e8) {FRAME}, 4) as v from {E}")(lambda s, d: iv(ev(s, d).map(lambda v: 1 + v / 1e8).scan("*")))
query("scan_minus", f"select i, round(2 * (select v from {E} where i = 0) - sum(v) {FRAME}, 2) as v from {E}")(lambda s, d: ev(s, d).scan("-").df.select("i", F.round("v", 2).alias("v")))
query("scan_divide", f"select i, round(pow((select 1 + v / 1e8 from {E} where i = 0), 2) / product(1 + v / 1e8) {FRAME}, 4) as v from {E}")(lambda s, d: iv(ev(s, d).map(lambda v: 1 + v / 1e8).scan("%")))
query("scan_neutral", f"select cast(0 as bigint) as i, 5.0 as v union all select i + 1, round(5 + sum(v) {FRAME}, 2) from {E}")(lambda s, d: ev(s, d).scan("+", 5.0).df.select("i", F.round("v", 2).alias("v")))


def X():
    return F.col("x")


def _part(name: str, sql: str, f) -> None:
    """General iterations on part.p_retailprice, row by row inside Catalyst."""
    query(name, sql)(lambda s, d: t(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("x")).select("p_partkey", f().alias("v")))


_part("converge_sqrt", "select p_partkey, round(sqrt(p_retailprice), 4) as v from part", lambda: F.round(A.converge(X(), lambda g: (g + X() / g) / 2), 4))
_part("while_double", "select p_partkey, round(p_retailprice * pow(2, greatest(0, ceil(log2(5000 / p_retailprice)))), 4) as v from part", lambda: F.round(A.while_(X(), lambda v: v < 5000, lambda v: v * 2, 20), 4))
_part("iterate", "select p_partkey, round(((p_retailprice / 2 + 1) / 2 + 1) / 2 + 1, 4) as v from part", lambda: F.round(A.iterate(3, X(), lambda v: v / 2 + 1), 4))
_part("scan_iterate", "select p_partkey, [round(p_retailprice, 4), round(p_retailprice / 2, 4), round(p_retailprice / 4, 4)] as v from part", lambda: F.transform(A.scan_iterate(2, X(), lambda v: v / 2), lambda v: F.round(v, 4)))
_part("scan_while", "with recursive w as (select p_partkey, p_retailprice as x, 0 as k from part union all select p_partkey, x * 2, k + 1 from w where x * 2 < 5000) select p_partkey, list(round(x, 4) order by k) as v from w group by p_partkey", lambda: F.transform(A.scan_while(X(), lambda v: v < 5000, lambda v: v * 2, 20), lambda v: F.round(v, 4)))
_part("scan_converge", "with recursive w as (select p_partkey, cast(floor(p_retailprice) as bigint) as x, 0 as k from part union all select p_partkey, x // 2, k + 1 from w where x > 0) select p_partkey, list(x order by k) as v from w group by p_partkey", lambda: A.scan_converge(F.floor(X()).cast("long"), lambda v: F.floor(v / 2).cast("long"), 40))


@query("max_drawdown", "select event_type, round(max(run - v), 4) as drawdown from (select event_type, value as v, max(value) over (partition by event_type order by event_id rows unbounded preceding) as run from events) group by event_type")
def max_drawdown(spark, d):
    e = running(t(spark, d, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "value")
    return e.groupBy("event_type").agg(r4(F.max(F.col("run") - F.col("value")), "drawdown"))


@query("vwap", "select l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as vwap from lineitem group by l_returnflag")
def vwap(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(r4(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), "vwap"))


@query("sliding_windows", f"select i, v from (select i, round(avg(v) over (order by i rows between 19 preceding and current row), 4) as v from {E}) where i >= 19")
def sliding_windows(spark, d):
    return ev(spark, d).sliding(20, F.avg).select("i", r4(F.col("v"), "v"))


@query("dense_index_orders", "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as i from orders")
def dense_index_orders(spark, d):
    return dense_index(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "i")


def _expression(name: str, sql: str, text: str) -> None:
    """An expression of the array language over the embeddings, row by row inside Catalyst."""

    def run(s, d):
        lang = Language(t(s, d, "embeddings")).define("r", lambda c: rounded(c + 0.00000123), 1)
        return lang.select("vec_id", "v", text, "embedding is e", "vec_id is i")

    query(name, f"with e as (select vec_id, [cast(x as double) for x in embedding] as e, list_sum([cast(x as double) for x in embedding]) as total from embeddings) select vec_id, {sql} as v from e")(run)


_expression("language_norm", "round(sqrt(list_sum([x * x for x in e])) + 0.00000123, 4)", "r((+/e*e)^0.5)")
_expression("language_demean", "[round(x - total / 64 + 0.00000123, 4) for x in e]", 'm::{(+/x)%#x}; :"mean"; r(e-m(e))')
_expression("language_largest", "[round(x + 0.00000123, 4) for x in list_reverse_sort(e)[1:3]]", "r(3#e@>e)")
_expression("language_choice", "case when vec_id % 3 = 0 then vec_id * 2 when vec_id % 3 = 1 then -vec_id else 0 end", ":[0=i!3;i*2:|1=i!3;-i;0]")
_expression("language_running", "[round(list_max([e[j + 1] for j in range(k + 1)]) - e[k + 1] + 0.00000123, 4) for k in range(64)]", "r((|\\e)-e)")
