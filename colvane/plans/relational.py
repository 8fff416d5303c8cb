"""Tables, keys, joins, SQL text, windows, and event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from colvane.operators import table as T
from colvane.plans.registry import E, TABLES, events_vector, query, r4, sql_query, t
from colvane.session import shared_dir
from colvane.sources import store as S
from colvane.streaming import events as X


@query("schema", "select table_name, column_name from information_schema.columns where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')")
def schema(spark, d):
    db = T.Database.of_folder(spark, d, TABLES[:7])
    return spark.createDataFrame([(k, c) for k, cols in db.schema.items() for c in cols], "table_name string, column_name string")


NEW = "select o_orderkey + 10000000 as o_orderkey, o_custkey, round(o_totalprice, 2) as o_totalprice from orders where o_orderkey % 10 = 0"
OLD = "select o_orderkey, o_custkey, round(o_totalprice, 2) as o_totalprice from orders"


def _orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("insert_append", f"{OLD} union all select 99999999, 1, 1.5")
def insert_append(spark, d):
    return T.Table(_orders(spark, d)).insert((99999999, 1, 1.5)).df


@query("insert_bulk", f"{OLD} union all {NEW}")
def insert_bulk(spark, d):
    o = _orders(spark, d)
    return T.Table(o).insert(o.where("o_orderkey % 10 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)).df


@query("index_create", f"select distinct * from ({OLD} union all {OLD})")
def index_create(spark, d):
    o = _orders(spark, d)
    return T.Table(o.unionByName(o)).index("o_orderkey").df


@query("upsert_single_key", "select o_orderkey, o_custkey, case when o_orderkey % 5 = 0 then 0.0 else round(o_totalprice, 2) end as o_totalprice from orders")
def upsert_single_key(spark, d):
    o = _orders(spark, d)
    return T.Table(o).index("o_orderkey").insert(o.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.lit(0.0))).df


@query("upsert_multi_key", f"select o_orderkey, o_custkey, case when o_orderkey % 10 = 0 then 0.0 else o_totalprice end as o_totalprice from ({OLD}) union all select o_orderkey, o_custkey + 100000, 0.0 from ({OLD}) where o_orderkey % 10 = 5")
def upsert_multi_key(spark, d):
    o = _orders(spark, d)
    new = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 5, F.col("o_custkey") + 100_000).otherwise(F.col("o_custkey")).alias("o_custkey"), F.lit(0.0).alias("o_totalprice"))
    return T.Table(o).index("o_orderkey", "o_custkey").insert(new).df


@query("upsert_latest", "select user_id, max_by(event_id, event_id) as event_id, max_by(round(value, 2), event_id) as value from events group by user_id")
def upsert_latest(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.round("value", 2).alias("value"))
    return T.latest(e, ["user_id"], ["event_id"])


@query("table_count", "select count(*) as n from lineitem")
def table_count(spark, d):
    return t(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("store_merge", f"{OLD} union all {NEW}")
def store_merge(spark, d):
    """Existing rows win: the new batch repeats old keys with other values, and adds some."""
    o = _orders(spark, d)
    new = o.withColumn("o_totalprice", F.lit(-1.0)).unionByName(o.where("o_orderkey % 10 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    return S.merge(o, new, ["o_orderkey"])


@query("range_scan_ts", "select event_id from events where ts between (select min(ts) + interval 1 hour from events) and (select min(ts) + interval 20 hour from events)")
def range_scan_ts(spark, d):
    e = t(spark, d, "events")
    low = e.agg(F.min("ts")).first()[0]
    from datetime import timedelta

    return S.time_range(e, "ts", low + timedelta(hours=1), low + timedelta(hours=20)).select("event_id")


query("range_open", f"select i, event_id from {E} where i >= (select count(*) from events) - 50 and ts <= (select max(ts) from events)")(lambda s, d: S.time_range(S.position_range(events_vector(s, d), t(s, d, "events").count() - 50), "ts", None, t(s, d, "events").agg(F.max("ts")).first()[0]).select("i", "event_id"))
query("range_scan_pos", f"select i, event_id from {E} where i >= 100 and i < 200")(lambda s, d: S.position_range(events_vector(s, d), 100, 200).select("i", "event_id"))
@query("csv_roundtrip", "select p_partkey, p_name, p_size from part")
def csv_roundtrip(spark, d):
    """Written to CSV files in the shared folder and read back."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    S.write_csv(t(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return S.read_csv(spark, path, "p_partkey long, p_name string, p_size int")



@query("station_stats", "select event_type as station, min(value) as low, round(avg(value), 4) as mean, max(value) as high, count(*) as n from events group by event_type")
def station_stats(spark, d):
    """Lines of station;value, written to text files in the shared folder and read back."""
    path = f"{shared_dir(spark)}/measurements-{uuid.uuid4().hex}"
    S.write_lines(t(spark, d, "events").select(F.concat_ws(";", "event_type", F.col("value").cast("string"))), path)
    s = S.station_stats(S.read_measurements(spark, path), "station", "temp")
    return s.withColumn("mean", F.round("mean", 4))


sql_query("sql_join_inner", "select c_custkey, o_orderkey, round(o_totalprice, 2) as price from customer join orders on c_custkey = o_custkey", "customer orders")
sql_query("sql_join_left", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000", "customer orders")
sql_query("sql_join_right", "select s_suppkey, n_nationkey from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 0", "supplier nation")
sql_query("sql_join_lateral", "select n_nationkey, best from nation, lateral (select round(max(s_acctbal), 2) as best from supplier where s_nationkey = n_nationkey)", "supplier nation")
sql_query("sql_join_full", "select n.n_nationkey as a, s.s_suppkey as b from (select * from nation where n_nationkey < 20) n full join (select * from supplier where s_nationkey > 10) s on n_nationkey = s_nationkey", "nation supplier")
sql_query("group_agg", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty, round(avg(l_extendedprice), 2) as price, count(*) as n from lineitem group by l_returnflag, l_linestatus", "lineitem")
sql_query("sql_distinct", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as supps from lineitem group by l_returnflag", "lineitem")
sql_query("sql_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)", "lineitem")
sql_query("sql_cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)", "lineitem")
sql_query("sql_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())", "lineitem")
sql_query("sql_window", "select o_orderkey, cast(rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as r, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as s from orders", "orders")
sql_query("sql_cte", "with big as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey) select c_mktsegment, count(*) as n, round(avg(total), 2) as mean from big join customer on c_custkey = o_custkey group by c_mktsegment", "orders customer")
sql_query("sql_subquery", "select c_custkey from customer where c_acctbal > (select avg(c_acctbal) from customer) and exists (select 1 from orders where o_custkey = c_custkey)", "orders customer")
sql_query("sql_except", "select c_custkey as k from customer except select o_custkey from orders", "orders customer")
sql_query("sql_union", "select c_nationkey as k from customer union select s_nationkey from supplier", "customer supplier")
sql_query("sql_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier", "customer supplier")
sql_query("sql_filter", "select o_orderkey from orders where o_totalprice > 100000 and o_orderstatus = 'O'", "orders")
sql_query("sql_pivot", "select l_returnflag, sum(case when l_linestatus = 'O' then 1 else 0 end) as o, sum(case when l_linestatus = 'F' then 1 else 0 end) as f from lineitem group by l_returnflag", "lineitem", "select l_returnflag, cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as bigint) as o, cast(sum(case when l_linestatus = 'F' then 1 else 0 end) as bigint) as f from lineitem group by l_returnflag")
query("join_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")(lambda s, d: t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"))
query("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")(lambda s, d: t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"))
query("join_cross", "select r_name, n_name from region cross join nation")(lambda s, d: t(s, d, "region").select("r_name").crossJoin(t(s, d, "nation").select("n_name")))


@query("join_range", "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on b.s_acctbal > a.s_acctbal and b.s_acctbal <= a.s_acctbal + 100")
def join_range(spark, d):
    """A band join: values fall into cells as wide as the band, and only a cell and the next meet."""
    s = t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    cell = F.floor(F.col("s_acctbal") / 100)
    a = s.select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    b = s.select(F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("y"), cell.alias("cell"))
    return a.join(b, "cell").where("y > x and y <= x + 100").select("a", "b")


@query("join_asof", "select l.event_id, round(r.value, 2) as last from (select * from events where event_type = (select min(event_type) from events)) l asof left join (select * from events where event_type = (select max(event_type) from events)) r on l.user_id = r.user_id and l.ts >= r.ts")
def join_asof(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    kinds = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    left, right = e.where(F.col("event_type") == kinds["a"]), e.where(F.col("event_type") == kinds["b"])
    return T.asof(left.select("event_id", "user_id", "ts"), right, "user_id", "ts", "value", "last").select("event_id", F.round("last", 2).alias("last"))


query("join_lookup", "select s_suppkey, n_name from supplier left join nation on s_nationkey = n_nationkey")(lambda s, d: t(s, d, "supplier").join(F.broadcast(t(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name"))


@query("bollinger", "select event_id, round(m + 0.00000123, 4) as mid, round(m - 2 * sd + 0.00000123, 3) as low, round(m + 2 * sd + 0.00000123, 3) as high from (select event_id, avg(value) over w as m, stddev_pop(value) over w as sd from events window w as (partition by event_type order by event_id rows between 19 preceding and current row))")
def bollinger(spark, d):
    e = X.bollinger(t(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "event_id", "value")
    return e.select("event_id", r4(F.col("mid") + 0.00000123, "mid"), F.round(F.col("low") + 0.00000123, 3).alias("low"), F.round(F.col("high") + 0.00000123, 3).alias("high"))


@query("subscription_match", "select event_id, client from events join (values (1, 'c*'), (2, 'purchase'), (3, '*')) s(client, pattern) on case when pattern like '%*' then starts_with(event_type, left(pattern, length(pattern) - 1)) else event_type = pattern end")
def subscription_match(spark, d):
    subs = spark.createDataFrame([(1, "c*"), (2, "purchase"), (3, "*")], "client int, pattern string")
    return X.fan_out(t(spark, d, "events").select("event_id", "event_type"), subs, "event_type").select("event_id", "client")


@query("tumbling_count", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def tumbling_count(spark, d):
    return X.tumbling(t(spark, d, "events"), "ts", "1 hour", "event_type").withColumn("total", F.round("total", 2))


@query("sliding_avg", "select start, event_type, round(avg(value) + 0.00000123, 4) as mean, count(*) as n from (select *, unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as start from events) group by start, event_type")
def sliding_avg(spark, d):
    return X.sliding(t(spark, d, "events"), "ts", "2 hours", "1 hour", "event_type").withColumn("mean", F.round(F.col("mean") + 0.00000123, 4))


@query("session_count", "select user_id, min(ts) as start, count(*) as n from (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events)) group by user_id, g")
def session_count(spark, d):
    return X.sessions(t(spark, d, "events"), "ts", "30 minutes", "user_id")


@query("lag_window", "select event_id, round(value - lag(value) over (partition by user_id order by event_id), 4) as v from events")
def lag_window(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t(spark, d, "events").select("event_id", r4(F.col("value") - F.lag("value").over(w), "v"))

