"""Registry of (name, Spark query, DuckDB SQL) and the inputs the queries derive."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@dataclass
class Case:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None):
    """Register a query; ``sql`` is None where plain SQL cannot say the same."""

    def keep(fn):
        if name in CASES:
            raise ValueError(f"{name} is registered twice")
        CASES[name] = Case(fn, sql)
        return fn

    return keep


def sql_with_p(source: str, scale: int = 1, r: str = "r", digits: int = 8, p: str = "p") -> str:
    """Rows of n and r with the two-sided p, from the finite series of the t distribution for whole degrees of freedom."""
    even = "list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + k * ln(c))))"
    odd = "coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + k * ln(c)))), 0)"
    inside = f"case when n % 2 = 0 then abs(r) * {even} else 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(c) * {odd}) end"
    return f"""
        select n, round(r * {scale}, {digits}) as {r},
               round({scale} * case when n < 3 or r is null then null when c <= 0 then 0.0 else greatest(0, 1 - {inside}) end, 6) as {p}
        from (select n, r, 1 - r * r as c from ({source}))"""


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def derived(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One of the :data:`DERIVED` tables."""
    words = set(re.findall(r"[a-z]+", DERIVED[name]))
    for t in words & set(TABLES):
        load(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(DERIVED[name])


# Civic tables made out of the driver tables, all rows, in SQL both engines read alike.
DERIVED = {
    # enforcement actions: one per order
    "enforcement": """
        select o_orderkey as id, o_custkey as unit, year(o_orderdate) as year, n_name as town, r_name as county,
               case when o_orderstatus = 'F' then null else o_totalprice end as fine,
               case o_orderpriority
                    when '1-URGENT' then 'Consent Order with a Penalty for Asbestos'
                    when '2-HIGH' then 'Notice of Noncompliance: Wetlands and Stormwater'
                    when '3-MEDIUM' then 'Penalty Assessment Notice, Hazardous Waste'
                    when '4-NOT SPECIFIED' then 'Consent Order on NPDES wastewater'
                    else 'Demand Notice under Chapter 91' end as text
        from orders join customer on o_custkey = c_custkey
             join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    """,
    # yearly funding
    "funding": """
        select year(o_orderdate) as year, cast(sum(l_extendedprice) as double) as admin_budget
        from lineitem join orders on l_orderkey = o_orderkey group by year(o_orderdate)
    """,
    # towns with population and income
    "census": """
        select n_name as town, cast(count(*) * 500 as double) as population, round(avg(c_acctbal) * 10, 2) as income
        from customer join nation on c_nationkey = n_nationkey group by n_name
    """,
    # staff records: one per order
    "staff": """
        select o_orderkey as id, year(o_orderdate) as calendar_year, 'Customer ' || cast(o_custkey as varchar(20)) as name_first,
               'Order ' || cast(o_orderkey as varchar(20)) as name_last, o_custkey as person,
               case when o_orderstatus = 'P' then null else o_totalprice end as earnings,
               case o_orderpriority
                    when '1-URGENT' then 'Environmental Analyst IV'
                    when '2-HIGH' then 'Supervising Environmental Engineer II'
                    when '3-MEDIUM' then 'Dir of Planners'
                    when '4-NOT SPECIFIED' then 'Counsel VI'
                    else 'Custodian' end as job_title
        from orders
    """,
    # payroll records: one per order that has line items
    "payroll": """
        select min(year(o_orderdate)) as year, 'Customer ' || cast(min(o_custkey) as varchar(20)) as name_first,
               'Order ' || cast(o_orderkey as varchar(20)) as name_last,
               round(sum(l_extendedprice), 2) as pay_total,
               round(sum(case when l_returnflag = 'R' then l_extendedprice else 0 end), 2) as pay_buyout,
               case when max(l_linestatus) = 'O' then 'Full Time Employee' else 'Contractor' end as position_type
        from lineitem join orders on l_orderkey = o_orderkey group by o_orderkey
    """,
    # wage index per year
    "wages": """
        select year(o_orderdate) as year, round(avg(o_totalprice), 4) as awi from orders group by year(o_orderdate)
    """,
    # overflow incidents: one per event
    "incidents": """
        select event_id as incident_id, ts as incident_date, event_type,
               case when value < 5 then 'Public Notification Report' else 'Verified Data Report' end as reporter_class,
               'Operator ' || cast(user_id as varchar(20)) as operator, 'out-' || cast(user_id as varchar(20)) as outfall_id,
               case when event_type = 'error' then null else 42 + user_id * 0.001 end as latitude,
               case when event_type = 'error' then null else -71 - user_id * 0.002 end as longitude,
               'Water ' || substr(cast(user_id as varchar(20)), 1, 2) as water_body,
               case when event_type = 'signup' and value > 100 then null else round(value * 100) * 10 end as volume
        from events
    """,
    # outfall reference list, with a repeated entry per outfall
    "outfalls": """
        select distinct 'out-' || cast(user_id as varchar(20)) as outfall_id, 42 + user_id * 0.001 as lat, -71 - user_id * 0.002 as long, event_type as remark
        from events
    """,
    # census areas: one per customer, with town and watershed
    "areas": """
        select c_custkey as area, n_name as town, r_name as watershed,
               case when c_acctbal < 0 then 0 else round(c_acctbal) end as pop,
               case when c_mktsegment = 'BUILDING' then null else (c_acctbal + 1000) / 11000 end as minority,
               (c_acctbal + 1500) / (c_acctbal + 9000) as lowincome, (c_acctbal + 1100) / (c_acctbal + 20000) as isolation
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    """,
    # discharge per outfall, assigned to an area; some areas are unknown
    "discharge": """
        select o_orderkey as outfall, o_custkey as area, o_totalprice / 1000 as volume, 1.0 as n from orders
    """,
    # state budget rows in the three report layouts
    "state_budget": """
        select n_name as state, y as year, detail, v as value from (
            select n_name, year(o_orderdate) as y, 'Environmental Agency Budget' as detail,
                   cast(cast(round(sum(o_totalprice)) as bigint) as varchar(30)) as v, min(n_regionkey) as rk
            from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name, year(o_orderdate)
            union all
            select n_name, year(o_orderdate), 'Amount of Reported SRF', cast(cast(round(sum(o_totalprice) / 7) as bigint) as varchar(30)), 1
            from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
            where n_regionkey = 1 group by n_name, year(o_orderdate)
            union all
            select n_name, year(o_orderdate), 'Budget includes SRF/ARRA funds (Yes/No)?', case when count(*) > 85 then 'Yes' else 'No' end, 2
            from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
            where n_regionkey = 2 group by n_name, year(o_orderdate)
            union all
            select n_name, year(o_orderdate), 'Environmental Agency Budget (SRF Added)', cast(cast(round(sum(o_totalprice) * 1.5) as bigint) as varchar(30)), 3
            from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
            where n_regionkey = 3 group by n_name, year(o_orderdate)
            union all
            select n_name, year(o_orderdate), 'Amount of Budget from SRF', case when count(*) > 90 then 'n/a' else cast(count(*) * 1000 as varchar(30)) end, 3
            from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
            where n_regionkey = 3 group by n_name, year(o_orderdate)
            union all
            select n_name, year(o_orderdate), 'Percent from Federal Government', cast(count(*) % 50 + 10 as varchar(30)), 4
            from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
            where n_regionkey in (0, 3, 4) group by n_name, year(o_orderdate)
            union all
            select n_name, year(o_orderdate), 'Amount from Fees', cast(count(*) * 12345 as varchar(30)), 4
            from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
            where n_regionkey in (1, 2, 4) group by n_name, year(o_orderdate)
        ) s
    """,
}


def with_derived(*names: str, body: str) -> str:
    """SQL with the named derived tables in front, then ``body``."""
    return "with " + ",\n".join(f"{n} as ({DERIVED[n]})" for n in names) + "\n" + body
