"""Atomic operators over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from colvane.functions import scalars as S
from colvane.plans.registry import query, r4, t

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ID = KEYS.split(", ")


def _line(name: str, f, sql: str, kind: str = "double") -> None:
    """A projection of lineitem under its four-column key."""

    def run(spark, d):
        li = t(spark, d, "lineitem")
        v = f(li)
        return li.select(*ID, r4(v, "v") if kind == "double" else v.cast("long").alias("v"))

    query(name, f"select {KEYS}, {'round(' + sql + ', 4)' if kind == 'double' else 'cast(' + sql + ' as bigint)'} as v from lineitem")(run)


P, Q, D = "l_extendedprice", "l_quantity", "l_discount"
_line("plus", lambda x: S.plus(x[P], x[Q]), f"{P} + {Q}")
_line("minus", lambda x: S.minus(x[P], x[Q]), f"{P} - {Q}")
_line("times", lambda x: S.times(x[Q], x[D]), f"{Q} * {D}")
_line("divide", lambda x: S.divide(x[Q], x["l_linenumber"] - 1), f"{Q} / nullif(l_linenumber - 1, 0)")
_line("int_divide", lambda x: S.int_divide(x["l_partkey"] - 100, x["l_linenumber"] - 3), "(l_partkey - 100) // nullif(l_linenumber - 3, 0)", "int")
_line("remainder", lambda x: S.remainder(x["l_partkey"] - 100, F.lit(7).cast("long")), "(l_partkey - 100) % 7", "int")
_line("power", lambda x: S.power(x[Q], F.lit(2)), f"pow({Q}, 2)")
_line("max_or", lambda x: S.max_or(x[Q], x[P] / 700), f"greatest({Q}, {P} / 700)")
_line("min_and", lambda x: S.min_and(x[Q], x[P] / 700), f"least({Q}, {P} / 700)")
_line("equal", lambda x: S.equal(x["l_returnflag"], F.lit("R")), "l_returnflag = 'R'", "int")
_line("less", lambda x: S.less(x[Q], F.lit(25)), f"{Q} < 25", "int")
_line("more", lambda x: S.more(x["l_returnflag"], x["l_linestatus"]), "l_returnflag > l_linestatus", "int")
_line("negate", lambda x: S.negate(x[P]), f"-{P}")
_line("floor", lambda x: S.floor(-x[P] / 7), f"floor(-{P} / 7)", "int")
_line("reciprocal", lambda x: S.reciprocal(x["l_linenumber"] - 1), "1.0 / nullif(l_linenumber - 1, 0)")
_line("not", lambda x: S.not_(x["l_linenumber"] - 1), "l_linenumber - 1 = 0", "int")
_line("undefined", lambda x: S.undefined(S.divide(x[Q], x["l_linenumber"] - 1)), "(l_linenumber - 1 = 0)", "int")
_line("math_round", lambda x: F.round(-x[P] / 7 + 0.00123, 1), f"round(-{P} / 7 + 0.00123, 1)")
_line("conditional", lambda x: S.conditional(x[Q] < 10, F.lit(1), x[Q] < 30, F.lit(2), F.lit(3)), f"case when {Q} < 10 then 1 when {Q} < 30 then 2 else 3 end", "int")
_line("math_exp_ln", lambda x: F.exp(x[D]) + F.ln(x[Q]) + F.sqrt(x[Q]) + F.pow(x[Q], F.lit(1 / 3)), f"exp({D}) + ln({Q}) + sqrt({Q}) + pow({Q}, 1.0 / 3)")
_line("math_trig", lambda x: F.sin(x[Q]) + F.cos(x[Q]) + F.tan(x[D]) + F.asin(x[D]) + F.acos(x[D]) + F.atan(x[Q]) + F.atan2(x[Q], x[D]), f"sin({Q}) + cos({Q}) + tan({D}) + asin({D}) + acos({D}) + atan({Q}) + atan2({Q}, {D})")


@query("char", "select p_partkey, chr(cast(945 + p_size as integer)) as v from part")
def char(spark, d):
    return t(spark, d, "part").select("p_partkey", S.char(F.col("p_size") + 945).alias("v"))


@query("format", "select p_partkey, cast(p_size as varchar) as v, concat(':', p_brand) as symbol from part")
def format_(spark, d):
    return t(spark, d, "part").select("p_partkey", S.format_(F.col("p_size")).alias("v"), S.format_(F.col("p_brand"), True).alias("symbol"))


@query("format2", "select p_partkey, rpad(p_brand, cast(greatest(12, length(p_brand)) as integer), ' ') as wide, lpad(p_brand, cast(greatest(12, length(p_brand)) as integer), ' ') as right_side, rpad(p_brand, cast(greatest(3, length(p_brand)) as integer), ' ') as narrow, lpad(printf('%.2f', p_retailprice), 12, ' ') as price from part")
def format2(spark, d):
    b = F.col("p_brand")
    return t(spark, d, "part").select("p_partkey", S.pad(b, 12).alias("wide"), S.pad(b, -12).alias("right_side"), S.pad(b, 3).alias("narrow"), S.fixed(F.col("p_retailprice"), 12, 2).alias("price"))


@query("form", r"with s as (select p_partkey, case when p_partkey % 3 = 0 then cast(p_size as varchar) when p_partkey % 3 = 1 then cast(p_size as varchar) || '.5' else p_brand end as s from part) select p_partkey, case when regexp_full_match(s, '\s*-?\d+\s*') then try_cast(s as bigint) end as n, try_cast(s as double) as x from s")
def form(spark, d):
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    s = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".5"))).otherwise(F.col("p_brand"))
    return t(spark, d, "part").select("p_partkey", S.form_int(s).alias("n"), S.form_real(s).alias("x"))


@query("size", "select p_partkey, cast(length(p_name) as bigint) as n, cast(ascii(p_name) as bigint) as code, abs(p_size - 25) as a from part")
def size(spark, d):
    return t(spark, d, "part").select("p_partkey", F.length("p_name").cast("long").alias("n"), S.code_point(F.col("p_name")).alias("code"), F.abs(F.col("p_size") - 25).alias("a"))


@query("atom", "select vec_id, cast(len(embedding) = 0 as bigint) as whole, 1 as none from embeddings")
def atom(spark, d):
    e = F.col("embedding")
    return t(spark, d, "embeddings").select("vec_id", S.atom_list(e).alias("whole"), S.atom_list(F.slice(e, 1, 0)).cast("int").alias("none"))


@query("math_thousands", "select o_orderkey, format('{:,}', cast(floor(o_totalprice) as bigint)) as v from orders")
def thousands(spark, d):
    from colvane.functions.mathx import thousands as th

    return t(spark, d, "orders").select("o_orderkey", th(F.col("o_totalprice")).alias("v"))


@query("math_gcd", "select o_orderkey, cast(gcd(o_orderkey, o_custkey) as bigint) as g, cast(lcm(o_orderkey, o_custkey) as bigint) as l from orders")
def gcd(spark, d):
    from colvane.functions import mathx as M

    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return t(spark, d, "orders").select("o_orderkey", M.gcd(a, b).alias("g"), M.lcm(a, b).alias("l"))


@query("complex_mul", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * l_tax - l_discount * l_linenumber, 4) as re, round(l_quantity * l_linenumber + l_discount * l_tax, 4) as im, round((l_quantity * l_tax + l_discount * l_linenumber) / (l_tax * l_tax + l_linenumber * l_linenumber), 4) as qre from lineitem")
def complex_mul(spark, d):
    from colvane.functions import mathx as M

    a, b = M.cnum(F.col("l_quantity"), F.col("l_discount")), M.cnum(F.col("l_tax"), F.col("l_linenumber"))
    m = M.cmul(a, b)
    return t(spark, d, "lineitem").select(*ID, r4(m["re"], "re"), r4(m["im"], "im"), r4(M.cdiv(a, b)["re"], "qre"))


def _part(name: str, sql: str, **cols) -> None:
    query(name, f"select p_partkey, {sql} from part")(lambda spark, d: t(spark, d, "part").select("p_partkey", *(f(F.col("p_name")).alias(k) for k, f in cols.items())))


_part("str_reverse", "reverse(p_name) as v", v=F.reverse)
_part("str_rotate", "right(p_name, 2) || left(p_name, length(p_name) - 2) as r, substr(p_name, 3) || left(p_name, 2) as l", r=lambda s: S.rotate_text(s, 2), l=lambda s: S.rotate_text(s, -2))
_part("str_take_drop", "left(p_name, 4) as a, right(p_name, 4) as b, substr(p_name, 5) as c, left(p_name, length(p_name) - 4) as e", a=lambda s: S.take_text(s, 4), b=lambda s: S.take_text(s, -4), c=lambda s: S.drop_text(s, 4), e=lambda s: S.drop_text(s, -4))
_part("str_split_fixed", "[substr(p_name, cast(g * 3 + 1 as bigint), 3) for g in range(cast(ceil(length(p_name) / 3.0) as bigint))] as v", v=lambda s: S.split_text(s, 3))
_part("str_overwrite", "left(p_name, 2) || 'XYZ' || substr(p_name, 6) as v", v=lambda s: S.overwrite_text(s, "XYZ", 2))
_part("str_find_overlap", "[cast(g as bigint) for g in range(greatest(length(p_name) - 1, 0) + 0) if substr(p_name, cast(g + 1 as bigint), 2) = 'ar'] as v", v=lambda s: S.find_text(s, "ar"))
_part("find_substring", "[cast(g as bigint) for g in range(length(p_name)) if substr(p_name, cast(g + 1 as bigint), 1) = 'e'] as v", v=lambda s: S.find_text(s, "e"))
_part("str_codepoints", "[cast(ascii(substr(p_name, cast(g + 1 as bigint), 1)) as bigint) for g in range(length(p_name))] as v", v=S.code_points)
query("str_unique_chars", "select p_partkey, string_agg(c, '' order by i) as v from (select p_partkey, c, min(i) as i from (select p_partkey, substr(p_name, cast(i as bigint), 1) as c, i from part, lateral (select unnest(range(1, length(p_name) + 1)) as i)) group by p_partkey, c) group by p_partkey")(lambda spark, d: t(spark, d, "part").select("p_partkey", S.unique_chars(F.col("p_name")).alias("v")))


@query("char_freq", "select c, count(*) as n from (select substr(p_name, cast(i as bigint), 1) as c from part, lateral (select unnest(range(1, length(p_name) + 1)) as i)) group by c")
def char_freq(spark, d):
    return t(spark, d, "part").select(F.explode(F.split("p_name", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@query("eval_array", "select p_partkey, [p_size + 1, p_size * 2] as v from part")
def eval_array(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array(F.col("p_size") + 1, F.col("p_size") * 2).alias("v"))


@query("list", "select p_partkey, [p_size] as v from part")
def list_(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array("p_size").alias("v"))


@query("dict_build", "select p_partkey, cast(p_size as bigint) as a, length(p_brand) as b from part")
def dict_build(spark, d):
    from colvane.operators import nested as A

    m = A.dict_put(F.create_map(F.lit("a"), F.lit(0).cast("long"), F.lit("b"), F.length("p_brand").cast("long")), F.lit("a"), F.col("p_size").cast("long"))
    return t(spark, d, "part").select("p_partkey", A.dict_get(m, F.lit("a")).alias("a"), A.dict_get(m, F.lit("b")).alias("b"))


@query("dict_get", "select o_orderkey, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 end as v from orders")
def dict_get(spark, d):
    m = F.create_map(F.lit("1-URGENT"), F.lit(1), F.lit("2-HIGH"), F.lit(2))
    return t(spark, d, "orders").select("o_orderkey", F.try_element_at(m, F.col("o_orderpriority")).alias("v"))


@query("each_dict", "select p_partkey, [p_size + 10, length(p_brand) + 20] as v from part")
def each_dict(spark, d):
    from colvane.operators import nested as A

    m = F.create_map(F.lit(10).cast("long"), F.col("p_size").cast("long"), F.lit(20).cast("long"), F.length("p_brand").cast("long"))
    return t(spark, d, "part").select("p_partkey", A.each_dict(m, lambda k, v: k + v).alias("v"))


@query("project_cols", "select o_orderkey, o_totalprice from orders")
def project_cols(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice")


@query("filter_mask", "select o_orderkey, o_totalprice from orders where o_totalprice > 200000")
def filter_mask(spark, d):
    """Mask, positions and gather, fused into a filter that reaches the scan."""
    return t(spark, d, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("filter_fn", "select o_orderkey from orders where o_orderkey % 7 = 3")
def filter_fn(spark, d):
    return t(spark, d, "orders").where(S.equal(F.col("o_orderkey") % 7, F.lit(3)) == 1).select("o_orderkey")


@query("table_add_col", "select o_orderkey, o_totalprice, round(o_totalprice * 1.1, 4) as with_tax from orders")
def table_add_col(spark, d):
    from colvane.operators.table import Table

    x = Table(t(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    return x.with_column("with_tax", F.round(F.col("o_totalprice") * 1.1, 4)).df


@query("parse_props", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def parse_props(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
