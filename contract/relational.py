"""Filters, joins, reshaping and grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.base import case, load, sql_with_p
from regdata.functions import clean, nulls
from regdata.operators import aggregate, quality, relate, series
from regdata.sources import catalog, readers

import datetime as dt


@case("year_counts", "select year(o_orderdate) as year, count(*) as n from orders group by 1")
def year_counts(spark, d):
    o = load(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    return aggregate.count_rows(o, ["year"])


@case("year_totals", "select year(o_orderdate) as year, round(sum(o_totalprice), 2) as total from orders group by 1")
def year_totals(spark, d):
    o = load(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("total"))
    return aggregate.sum_by(o, ["year"], ["total"]).withColumn("total", F.round("total", 2))


@case("distinct_years", """
    select min(y) as first, max(y) as last, count(distinct y) as n from (select year(o_orderdate) as y from orders)
""")
def distinct_years(spark, d):
    y = load(spark, d, "orders").select(F.year("o_orderdate").alias("y"))
    return y.distinct().agg(F.min("y").alias("first"), F.max("y").alias("last"), F.count("y").alias("n"))


@case("state_filter", """
    select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'
""")
def state_filter(spark, d):
    o = load(spark, d, "orders")
    return o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_totalprice")


@case("null_group_sum", """
    with c as (select c_custkey, nullif(c_mktsegment, 'BUILDING') as seg from customer),
         o as (select o_custkey, case when o_orderstatus = 'F' then null else o_totalprice end as v from orders)
    select seg, round(coalesce(sum(v), 0), 2) as total from c full outer join o on c_custkey = o_custkey
    where seg is not null group by seg
""")
def null_group_sum(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    o = load(spark, d, "orders").select(
        "o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("total")
    )
    return relate.facts_on_dimension(o, c, "o_custkey", "c_custkey", "seg", ["total"]).withColumn("total", F.round("total", 2))


@case("null_safe_outer", """
    with a as (select nullif(c_mktsegment, 'BUILDING') as seg, count(*) as customers from customer group by 1),
         b as (select nullif(nullif(c_mktsegment, 'BUILDING'), 'FURNITURE') as seg2, count(*) as orders from orders join customer on o_custkey = c_custkey group by 1)
    select coalesce(seg, seg2) as seg, customers, orders from a full outer join b on seg is not distinct from seg2
""")
def null_safe_outer(spark, d):
    c = load(spark, d, "customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))
    o = load(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    a = c.groupBy("seg").agg(F.count(F.lit(1)).alias("customers"))
    b = o.groupBy(F.nullif("seg", F.lit("FURNITURE")).alias("seg2")).agg(F.count(F.lit(1)).alias("orders"))
    return relate.full_outer_coalesced(a, b, [("seg", "seg2")])


_VINTAGE = """
    with e as (select o_custkey, year(o_orderdate) as y, o_totalprice from orders),
         a as (select o_custkey, y, max(o_totalprice) as v, 0 as ed from e where y <= 1998 group by 1, 2),
         b as (select o_custkey, y, min(o_totalprice) as v, 1 as ed from e where y >= 1997 group by 1, 2),
         u as (select * from a union all select * from b)
    select o_custkey, y, v from (select *, row_number() over (partition by o_custkey, y order by ed {dir}) as rn from u) where rn = 1
"""


def _vintages(spark, d):
    e = load(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice")
    a = e.where("y <= 1998").groupBy("o_custkey", "y").agg(F.max("o_totalprice").alias("v"))
    b = e.where("y >= 1997").groupBy("o_custkey", "y").agg(F.min("o_totalprice").alias("v"))
    return [a, b]


@case("vintage_latest", _VINTAGE.format(dir="desc"))
def vintage_latest(spark, d):
    return relate.merge_vintages(_vintages(spark, d), ["o_custkey", "y"], "v")


@case("vintage_earliest", _VINTAGE.format(dir="asc"))
def vintage_earliest(spark, d):
    return relate.merge_vintages(_vintages(spark, d), ["o_custkey", "y"], "v", prefer="earlier")


@case("lookup_fill", """
    with o as (select o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') as label from orders)
    select o_orderkey, coalesce(label, c_mktsegment) as label from o left join customer on o_custkey = c_custkey
""")
def lookup_fill(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("label"))
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    c = c.unionByName(c)  # repeated list entries must not multiply rows
    return relate.lookup_fill(o, c, "o_custkey", {"label": "c_mktsegment"}, "c_custkey").select("o_orderkey", "label")


@case("spine_months", """
    with m as (select unnest(generate_series(date '1994-11-01', date '2001-12-01', interval 1 month))::date as month),
         p as (select distinct o_orderpriority as priority from orders),
         g as (select date_trunc('month', o_orderdate)::date as month, o_orderpriority as priority, count(*) as n from orders group by 1, 2)
    select m.month::varchar as month, p.priority, coalesce(n, 0) as n from m cross join p left join g using (month, priority)
""")
def spine_months(spark, d):
    o = load(spark, d, "orders").select(clean.month_floor("o_orderdate").alias("month"), F.col("o_orderpriority").alias("priority"))
    spine = relate.spine_of(
        series.month_spine(spark, "1994-10-15", "2001-12-31"), {"priority": relate.distinct_values(o, "priority")}
    )
    out = relate.align_to_spine(aggregate.count_rows(o, ["month", "priority"]), spine, ["month", "priority"], {"n": 0})
    return out.select(F.col("month").cast("string").alias("month"), "priority", "n")


@case("spine_days", """
    with m as (select unnest(generate_series(date '2023-12-25', date '2024-02-05', interval 1 day))::date as day),
         p as (select distinct event_type from events),
         g as (select ts::date as day, event_type, count(*) as n, sum(value) as v from events group by 1, 2)
    select m.day::varchar as day, p.event_type, coalesce(n, 0) as n, round(coalesce(v, 0), 2) as v
    from m cross join p left join g using (day, event_type)
""")
def spine_days(spark, d):
    e = load(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    g = nulls.known_keys(e, "day", "event_type").groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), nulls.sum0("value").alias("v"))
    spine = relate.spine_of(series.day_spine(spark, "2023-12-25", "2024-02-05"), {"event_type": relate.distinct_values(e, "event_type")})
    out = relate.align_to_spine(g, spine, ["day", "event_type"], {"n": 0, "v": 0.0})
    return out.select(F.col("day").cast("string").alias("day"), "event_type", "n", F.round("v", 2).alias("v"))


@case("anti_new", """
    select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 49)
""")
def anti_new(spark, d):
    stored = load(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return relate.only_new(load(spark, d, "part").select("p_partkey", "p_name"), stored, ["p_partkey"])


@case("semi_known", """
    select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)
""")
def semi_known(spark, d):
    members = load(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return relate.known_members(load(spark, d, "customer").select("c_custkey", "c_name"), members, ["c_custkey"])


@case("missing_members", """
    select distinct o_custkey as k from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')
""")
def missing_members(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return relate.missing_members(o, o.where("o_orderstatus = 'F'"), "k")


@case("joins_basic", """
    select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey
    left join (select * from nation where n_regionkey <> 2) n on c_nationkey = n_nationkey
""")
def joins_basic(spark, d):
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    n = load(spark, d, "nation").where("n_regionkey <> 2")
    joined = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return joined.join(n, joined.c_nationkey == n.n_nationkey, "left").select("o_orderkey", "c_name", "n_name")


@case("right_join_kept", """
    select n_name, count(c_custkey) as n from (select * from customer where c_acctbal > 9000) c
    right join nation on c_nationkey = n_nationkey group by n_name
""")
def right_join_kept(spark, d):
    c = load(spark, d, "customer").where("c_acctbal > 9000")
    n = load(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "right").groupBy("n_name").agg(F.count("c_custkey").alias("n"))


@case("strict_lookup", "select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def strict_lookup(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return relate.strict_lookup(o, load(spark, d, "customer"), ["c_custkey"], "c_mktsegment").select("o_orderkey", "c_mktsegment")


_WIDE = [f"y{y}" for y in range(1995, 2002)]  # all years of the orders


@case("wide_long", "with w as (select o_custkey, " + ", ".join(
    f"sum(case when year(o_orderdate) = {c[1:]} then o_totalprice end) as {c}" for c in _WIDE
) + " from orders group by 1) " + " union all ".join(f"select o_custkey, '{c}' as year, round({c}, 2) as value from w" for c in _WIDE))
def wide_long(spark, d):
    o = load(spark, d, "orders").withColumn("year", F.concat(F.lit("y"), F.year("o_orderdate")))
    wide = relate.long_to_wide(o, ["o_custkey"], "year", _WIDE, F.round(F.sum("o_totalprice"), 2))
    return relate.wide_to_long(wide, ["o_custkey"], _WIDE, "year", "value")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@case("pivot_types", "select user_id, " + ", ".join(f"count(case when event_type = '{t}' then 1 end) as {t}" for t in _TYPES) + " from events group by 1")
def pivot_types(spark, d):
    e = load(spark, d, "events")
    return relate.long_to_wide(e, ["user_id"], "event_type", _TYPES, F.count(F.lit(1)), fill=0)


@case("union_differing", """
    select c_custkey as key, c_name as name, c_mktsegment as segment, null::double as price from customer union all
    select p_partkey, p_name, null, p_retailprice from part
""")
def union_differing(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    p = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return relate.union_all([c, p])


@case("derived_union", """
    select o_orderkey, 'price' as detail, o_totalprice as value from orders union all
    select o_orderkey, 'thousands', round(o_totalprice / 1000, 6) from orders where o_orderstatus = 'O'
""")
def derived_union(spark, d):
    o = load(spark, d, "orders")
    rows = o.select("o_orderkey", F.lit("price").alias("detail"), F.col("o_totalprice").alias("value"))
    extra = o.where("o_orderstatus = 'O'").select("o_orderkey", F.lit("thousands").alias("detail"), F.round(F.col("o_totalprice") / 1000, 6).alias("value"))
    return relate.union_all([rows, extra])


@case("setdiff", "select p_type, p_size from part except all select p_type, p_size from part where p_brand = 'Brand#2'")
def setdiff(spark, d):
    p = load(spark, d, "part")
    return relate.value_difference(p.select("p_type", "p_size"), p.where("p_brand = 'Brand#2'").select("p_type", "p_size"))


_FISCAL = [f"FY{y % 100:02d}" for y in range(1995, 2002)]  # all years of the line items


@case("line_item_series", """
    with y as (select distinct 'FY' || right(cast(year(l_shipdate) as varchar), 2) as label from lineitem),
    s as (select 'FY' || right(cast(year(l_shipdate) as varchar), 2) as label, sum(l_quantity) as amount from lineitem where l_returnflag = 'R' group by 1)
    select label, amount from y left join s using (label)
""")
def line_item_series(spark, d):
    li = load(spark, d, "lineitem").withColumn("fy", F.concat(F.lit("FY"), F.right(F.year("l_shipdate").cast("string"), F.lit(2))))
    items = relate.long_to_wide(li.withColumnRenamed("l_returnflag", "item"), ["item"], "fy", _FISCAL, F.sum("l_quantity"))
    labels = li.select(F.col("fy").alias("label")).distinct()
    return labels.join(relate.line_item_series(items, "item", "R", _FISCAL, "label", "amount"), "label", "left")


@case("mixed_agg", """
    select l_suppkey, round(sum(l_extendedprice), 2) as l_extendedprice, count(*) as rows_n, min(l_returnflag) as l_returnflag, min(l_linestatus) as l_linestatus
    from lineitem group by 1
""")
def mixed_agg(spark, d):
    li = load(spark, d, "lineitem")
    out = aggregate.rollup_mixed(li, ["l_suppkey"], ["l_extendedprice"], {"l_orderkey": "rows_n"}, ["l_returnflag", "l_linestatus"])
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@case("collapse_non_null", "select o_custkey, min(nullif(o_orderpriority, '1-URGENT')) as label from orders group by 1")
def collapse_non_null(spark, d):
    o = load(spark, d, "orders").withColumn("label", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return o.groupBy("o_custkey").agg(aggregate.pick_non_null("label").alias("label"))


@case("share_flagged", """
    select l_returnflag, round(100 * avg(case when q > 25 then 1.0 else 0.0 end), 6) as above, round(100 * avg(case when q % 10 = 0 then 1.0 else 0.0 end), 6) as rounded
    from (select l_returnflag, nullif(l_quantity, 30) as q from lineitem) group by 1
""")
def share_flagged(spark, d):
    li = load(spark, d, "lineitem").select("l_returnflag", F.nullif("l_quantity", F.lit(30.0)).alias("q"))
    return li.groupBy("l_returnflag").agg(
        aggregate.share_of(F.col("q") > 25, 6).alias("above"), aggregate.share_of(F.col("q") % 10 == 0, 6).alias("rounded")
    )


_WMEAN = """
    with li as (select l_suppkey, l_quantity as w, nullif(l_discount, 0.05) as a, l_tax as b from lineitem)
    select l_suppkey, round(sum(w * a) / sum({base}), 8) as a, round(sum(w * b) / sum(w), 8) as b from li group by 1
"""


def _wmean(spark, d, policy):
    li = load(spark, d, "lineitem").select(
        "l_suppkey", F.col("l_quantity").alias("w"), F.nullif("l_discount", F.lit(0.05)).alias("a"), F.col("l_tax").alias("b")
    )
    out = aggregate.weighted_mean(li, ["l_suppkey"], ["a", "b"], "w", policy)
    return out.withColumns({"a": F.round("a", 8), "b": F.round("b", 8)})


@case("weighted_mean", _WMEAN.format(base="w"))
def weighted_mean(spark, d):
    return _wmean(spark, d, "match")


@case("weighted_mean_strict", _WMEAN.format(base="case when a is not null then w end"))
def weighted_mean_strict(spark, d):
    return _wmean(spark, d, "strict")


@case("correlation", sql_with_p("""
    select count(*) as n, corr(l_quantity, l_extendedprice) as r from lineitem where l_quantity is not null and l_extendedprice is not null
"""))
def correlation(spark, d):
    out = aggregate.pearson(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", F.round("r", 8).alias("r"), F.round("p", 6).alias("p"))


@case("correlation_weak", sql_with_p("select count(*) as n, corr(c_acctbal, c_custkey) as r from customer"))
def correlation_weak(spark, d):
    out = aggregate.pearson(load(spark, d, "customer"), "c_acctbal", "c_custkey")
    return out.select("n", F.round("r", 8).alias("r"), F.round("p", 6).alias("p"))


@case("annual_nonnull", """
    select year(l_shipdate) as year, l_returnflag, l_linestatus, l_suppkey, count(nullif(l_discount, 0.05)) as n from lineitem group by 1, 2, 3, 4
""")
def annual_nonnull(spark, d):
    li = load(spark, d, "lineitem").withColumn("year", F.year("l_shipdate")).withColumn("v", F.nullif("l_discount", F.lit(0.05)))
    return aggregate.count_known(li, ["year", "l_returnflag", "l_linestatus", "l_suppkey"], "v")


@case("ratio_of_sums", """
    select l_returnflag, round(sum(l_extendedprice) / count(nullif(l_discount, 0.05)), 6) as ratio from lineitem group by 1
""")
def ratio_of_sums(spark, d):
    li = load(spark, d, "lineitem").withColumn("v", F.nullif("l_discount", F.lit(0.05)))
    return li.groupBy("l_returnflag").agg(F.round(aggregate.mean_of("l_extendedprice", "v"), 6).alias("ratio"))


@case("row_max", "select l_orderkey, year(l_shipdate) as year, max(l_extendedprice) as value from lineitem group by 1, 2")
def row_max(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("value"))
    return aggregate.row_max(li, ["l_orderkey", "year"], "value")


@case("three_key_sum", "select l_returnflag, l_linestatus, l_suppkey, round(sum(l_extendedprice), 2) as v from lineitem group by 1, 2, 3")
def three_key_sum(spark, d):
    li = load(spark, d, "lineitem").withColumn("v", F.col("l_extendedprice"))
    return aggregate.sum_by(li, ["l_returnflag", "l_linestatus", "l_suppkey"], ["v"]).withColumn("v", F.round("v", 2))


@case("member_average", """
    with m as (select o_orderkey, o_custkey as k from orders union all select l_orderkey, l_suppkey from lineitem)
    select m.o_orderkey, round(avg(c_acctbal), 6) as c_acctbal from m join customer on k = c_custkey group by 1
""")
def member_average(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.array("o_custkey").alias("own"))
    li = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("others"))
    o = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    listed = o.select("o_orderkey", F.concat("own", F.coalesce("others", F.array().cast("array<bigint>"))).alias("members"))
    c = load(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    return relate.average_over_members(listed, "o_orderkey", "members", c, "k", "c_acctbal").withColumn("c_acctbal", F.round("c_acctbal", 6))


@case("date_filters", """
    with o as (select o_orderkey, o_orderdate + (o_orderkey % 24) * interval 1 hour as ts, nullif(o_orderpriority, '2-HIGH') as p from orders)
    select o_orderkey, case when ts <= timestamp '1998-12-31' then 1 else 0 end as midnight, p from o
    where ts >= timestamp '1997-06-01' and ts < timestamp '1999-01-01' and p is not null
""")
def date_filters(spark, d):
    o = load(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("ts"),
        F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("p"),
    )
    start, end = dt.date(1997, 6, 1), dt.date(1998, 12, 31)
    kept = o.where(clean.date_between("ts", start, end, end_inclusive_day=True)).na.drop(subset=["p"])
    return kept.select("o_orderkey", clean.date_between("ts", start, end).cast("int").alias("midnight"), "p")


@case("population_split", """
    select n_name, count(*) * 500 as population, case when count(*) * 500 >= 30000 then 'large' else 'small' end as size
    from customer join nation on c_nationkey = n_nationkey group by 1
""")
def population_split(spark, d):
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    pop = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg((F.count(F.lit(1)) * 500).alias("population"))
    return pop.withColumn("size", F.when(F.col("population") >= 30000, "large").otherwise("small"))


@case("full_periods", """
    select year(o_orderdate) as year, count(*) as n from orders group by 1 having year(o_orderdate) < (select max(year(o_orderdate)) from orders)
""")
def full_periods(spark, d):
    o = load(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    return series.without_last_period(aggregate.count_rows(o, ["year"]), "year")


@case("null_audit", """
    select count(*) - count(nullif(c_mktsegment, 'BUILDING')) as seg, count(*) - count(case when c_acctbal >= 0 then 1 end) as bal, 0 as c_name from customer
""")
def null_audit(spark, d):
    c = load(spark, d, "customer").select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.when(F.col("c_acctbal") >= 0, 1).alias("bal"), "c_name"
    )
    return quality.null_audit(c, ["seg", "bal", "c_name"])


@case("conform_types", """
    select o_orderkey as id, cast(o_custkey as varchar) as customer, o_totalprice as price,
           case when o_orderstatus = 'F' then null else year(o_orderdate) end::double as year, null::double as extra from orders
""")
def conform_types(spark, d):
    from pyspark.sql.types import StructType

    o = load(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("Order Id"), F.col("o_custkey").alias("Customer"),
        F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("PRICE"),
        F.when(F.col("o_orderstatus") == "F", "unknown").otherwise(F.year("o_orderdate").cast("string")).alias("Fiscal Year (old)"),
        F.lit(1).alias("Junk"),
    )
    o = readers.coalesce_columns(o, "year", ["Year", "Fiscal Year"], prefix=True)
    o = readers.drop_column(readers.snake_columns(o), "JUNK").withColumnRenamed("Order_Id", "id")
    return readers.conform(o, StructType.fromDDL("id long, customer string, price double, year double, extra double"))


@case("quality_checks", """
    select 'orders' as dataset, (select count(*) from orders) as rows, 1 as columns_ok, 1 as floor_ok, 1 as growth_ok, 1 as ok union all
    select 'part', (select count(*) from part), 1, 1, 0, 0 union all
    select 'nation', (select count(*) from nation), 0, 0, 1, 0
""")
def quality_checks(spark, d):
    tables = {n: quality.load_or_none(spark, f"{d}/{n}.parquet") for n in ("orders", "part", "nation")}
    grown = quality.count_datasets({"part": tables["part"]}).select("dataset", (F.col("rows") + 1).alias("rows"))
    checks = quality.check_datasets(
        tables, {"orders": ["o_orderkey"], "nation": ["n_population"]}, {"nation": 1000}, grown
    )
    flags = ["columns_ok", "floor_ok", "growth_ok", "ok"]
    return checks.select("dataset", "rows", *[F.col(c).cast("int").alias(c) for c in flags])


@case("user_sql", """
    select s.year, count_orders, count_items from
      (select year(o_orderdate) as year, count(*) as count_orders from orders group by year(o_orderdate)) o
      join (select year(l_shipdate) as year, count(*) as count_items from lineitem group by year(l_shipdate)) s on s.year = o.year
""")
def user_sql(spark, d):
    catalog.register({"orders_v": load(spark, d, "orders"), "lineitem_v": load(spark, d, "lineitem")})
    return catalog.run_sql(spark, """
        select s.year, count_orders, count_items from
          (select year(o_orderdate) as year, count(*) as count_orders from orders_v group by year) o
          join (select year(l_shipdate) as year, count(*) as count_items from lineitem_v group by year) s on s.year = o.year
    """)


@case("ordered_export", "select p_partkey, row_number() over (order by p_type, p_size desc, p_partkey) as pos from part")
def ordered_export(spark, d):
    """Global order made visible; positions come from value pieces, not from one sorted task."""
    from regdata.operators.ordered import row_numbers, value_pieces, with_value_piece

    p = load(spark, d, "part").withColumn("size_down", -F.col("p_size"))
    p = with_value_piece(p, "p_partkey", value_pieces(p, "p_partkey", 16), "key_piece")
    return row_numbers(p, [], ["p_type", "size_down", "key_piece"], ["p_partkey"], "pos").select("p_partkey", "pos")
