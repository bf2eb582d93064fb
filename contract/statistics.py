"""Quantiles, bins, ranks, series, resampling and the dose-response fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.base import case, derived, load, with_derived
from regdata.operators import aggregate, doseresponse, quantile, relate, resample, series
from regdata.sources import sinks

# --- SQL forms of the hash draws -------------------------------------------------------

def sql_keys(src: str, *parts) -> str:
    """The rows of ``src`` with two keys ``k1``, ``k2`` from a digest of the parts."""
    text = ", ".join(f"coalesce(cast({p} as varchar), '~')" for p in parts)
    half = "('0x' || substr(_h, {}, 8))::bigint & 2147483647"
    return f"select * exclude (_h), {half.format(1)} as k1, {half.format(9)} as k2 from (select *, md5(concat_ws('|', {text})) as _h from {src})"


def sql_uniform(src: str, counter: str, out: str = "u") -> str:
    """The rows of ``src``, which have ``k1`` and ``k2``, with a number inside (0, 1)."""
    steps = f"select *, xor(({counter})::bigint, k1) as _a, xor(({counter})::bigint, k2) as _b from ({src})"
    for shift, factor in ((16, 73244475), (15, 739982445)):
        mixed = "(xor({0}, {0} >> {1}) * {2}) & 2147483647"
        steps = f"select * replace ({mixed.format('_a', shift, factor)} as _a, {mixed.format('_b', shift, factor)} as _b) from ({steps})"
    wide = "xor(_a, _a >> 14) * 2147483648 + xor(_b, _b >> 14)"
    return f"select * exclude (_a, _b), least((({wide})::double + 0.5::double) / 4611686018427387904::double, '0.99999999999999988898'::double) as {out} from ({steps})"


def sql_poisson(u: str) -> str:
    import math

    out, cumulative, term = [], 0.0, math.exp(-1)
    for k in range(1, 21):
        cumulative += term
        term /= k
        out.append(f"case when {u} >= '{cumulative!r}'::double then 1 else 0 end")
    return "(" + " + ".join(out) + ")"


def sql_drawn(src: str, g: str, reps: int, seed: int, piece: int = 4096) -> str:
    """Table ``st`` (g, rep, stat): weighted means of rows (g, k, x, w) of the table ``src`` drawn with replacement, one level of pieces.

    ``g`` is one column or several, separated by commas.
    """
    by = g.split(", ")
    same = " and ".join(f"b.{c} = d.{c}" for c in by)
    known = " and ".join(f"{c} is not null" for c in [*by, "x", "w"])
    return f"""
    numbered as (select {g}, x, w, row_number() over (partition by {g} order by k) - 1 as i, count(*) over (partition by {g}) as n from {src} where {known}),
    starts as (select distinct {g}, n, rep from numbered, range({reps}) t(rep)),
    dealt as ({sql_uniform(f"select * from ({sql_keys('starts', f"'{seed}'", *by, 'rep', 1, 0, 0)}), lateral (select unnest(range(n)) as q)", 'q')}),
    pieces as (select {g}, rep, n, case when n <= {piece} then 0 else least(floor(u * n), n - 1)::bigint // {piece} end as node, count(*) as m from dealt group by all),
    picks as ({sql_uniform(f"select *, least({piece}, n - node * {piece}) as s from ({sql_keys('pieces', f"'{seed}'", *by, 'rep', 0, 'node', 0)}), lateral (select unnest(range(m)) as q)", 'q')}),
    drawn as (select {g}, rep, node * {piece} + least(floor(u * s), s - 1)::bigint as i, count(*) as c from picks group by all),
    st as (select {', '.join(f'd.{c}' for c in by)}, rep, sum(c * w * x) / nullif(sum(c * w), 0) as stat from drawn d join numbered b on {same} and b.i = d.i group by all)"""


def sql_binomial(g: str, rows: str, u: str) -> str:
    """Tables ``law`` and ``hits`` (g, rep, hits): ``rows`` holds g, size, k, and one number ``u`` per rep."""
    return f"""
    bound as (select {g}, size, k, greatest(floor(k - reach), 0)::bigint as lo, least(ceil(k + reach), size)::bigint as hi
              from (select *, sqrt(k * (1 - k / size)) * 12 + 12 as reach from (select distinct {g}, size, k from {rows}))),
    step as (select {g}, size, k, lo, unnest(range(lo, hi + 1)) as j from bound),
    lg as (select *, sum(case when j = lo or k = 0 or k = size then 0.0::double else ln((size - j + 1)::double / j) + ln(k::double / (size - k)) end)
                     over (partition by {g} order by j rows unbounded preceding) as l from step),
    ms as (select *, exp(l - max(l) over (partition by {g})) as mass from lg),
    law as (select {g}, lo, j, sum(mass) over (partition by {g} order by j rows unbounded preceding) / sum(mass) over (partition by {g}) as cum from ms),
    hits as (select r.{g}, r.rep, case when any_value(r.k) = 0 then 0 when any_value(r.k) = any_value(r.size) then any_value(r.size)
                    else least(any_value(b.lo) + count(law.j), any_value(r.size)) end as hits
             from {rows} r join bound b on b.{g} = r.{g} left join law on law.{g} = r.{g} and law.cum < {u} group by 1, 2)"""


def sql_boot_share(src: str, g: str, reps: int, seed: int, probs: dict[str, float], nd: int = 6) -> str:
    """``src`` gives columns (g, hit)."""
    return f"""
    src as ({src}),
    c as (select {g}, count(*) as size, count(case when hit then 1 end) as k from src where {g} is not null group by 1),
    rr as ({sql_uniform(f"select * from ({sql_keys('c', f"'{seed}'", g)}), range({reps}) t(rep)", 'rep * 1024')}),
    {sql_binomial(g, 'rr', 'r.u')}
    select {g}, {', '.join(f"round(100 * quantile_cont(hits::double / size, {p}), {nd}) as {c}" for c, p in probs.items())} from hits join c using ({g}) group by {g}
    """


def sql_boot_median(src: str, g: str, reps: int, seed: int, probs: dict[str, float], nd: int = 6, nulls: bool = False) -> str:
    """``src`` gives columns (g, v); groups have at least three values. With ``nulls`` missing rows are drawn too."""
    sizes = f"""
    rr as ({sql_uniform("select * from keyed, range(" + str(reps) + ") t(rep)", 'rep * 1024')}),
    {sql_binomial(g, 'rr', 'r.u')},
    r as (select rr.{g}, k as n, hits as m, rr.rep, k1, k2 from rr join hits on hits.{g} = rr.{g} and hits.rep = rr.rep where hits > 0),""" if nulls else f"""
    r as (select {g}, k as n, k as m, rep, k1, k2 from keyed, range({reps}) t(rep)),"""
    tries = "select *, m // 2 + 1 as a, m - m // 2 as b from r, range(64) q(tr)"
    return f"""
    with src as ({src}),
    s as (select {g}, v, row_number() over (partition by {g} order by v) - 1 as rk from src where v is not null),
    sized as (select {g}, count(v) as k, count(*) as size from src where {g} is not null group by 1),
    keyed as ({sql_keys('sized', f"'{seed}'", g)}),{sizes}
    u as (select *, least(a, b)::double as p, greatest(a, b)::double as q from ({sql_uniform(sql_uniform(tries, 'rep * 1024 + 2 + 2 * tr', 'u1'), 'rep * 1024 + 3 + 2 * tr', 'u2')})),
    w as (select *, sqrt((p + q - 2) / (p * q * 2 - (p + q))) as slope from u),
    x as (select *, slope * ln(u1::double / (1 - u1)) as vv from w),
    y as (select *, p * exp(vv) as ww from x),
    k as (select {g}, rep, arg_min(case when a <= b then ww / (q + ww) else q / (q + ww) end, tr) as place from y
          where (p + 1 / slope) * vv - ln(4.0::double) + (p + q) * ln((p + q) / (q + ww)) >= ln((u1 * u1 * u2)::double) group by 1, 2),
    o as ({sql_uniform('select * from r', 'rep * 1024 + 1', 'other')}),
    mm as (select o.{g}, o.rep, n, place as hi, case when m % 2 = 1 then place else place * pow(other, 1.0::double / (m // 2)) end as lo
           from o join k on o.{g} = k.{g} and o.rep = k.rep),
    z as (select {g}, rep, least(floor(unnest([lo, hi]) * n), n - 1)::bigint as rk from mm),
    e as (select z.{g}, z.rep, avg(v) as stat from z join s on s.{g} = z.{g} and s.rk = z.rk group by 1, 2)
    select {g}, {', '.join(f"round(quantile_cont(stat, {p}), {nd}) as {c}" for c, p in probs.items())} from e group by {g}
    """


# --- quantiles and bins ----------------------------------------------------------------

@case("quantiles_by_group", """
    select o_orderpriority, round(quantile_cont(v, 0.1), 6) as q10, round(quantile_cont(v, 0.5), 6) as q50, round(quantile_cont(v, 0.95), 6) as q95
    from (select o_orderpriority, case when o_orderstatus = 'F' then null else o_totalprice end as v from orders) group by 1
""")
def quantiles_by_group(spark, d):
    o = load(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("v"))
    q = quantile.quantiles(o, ["o_orderpriority"], "v", [0.1, 0.5, 0.95])
    return q.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("q10", "q50", "q95")])


@case("class_breaks_positive", """
    select round(quantile_cont(v, 0.2), 6) as q20, round(quantile_cont(v, 0.8), 6) as q80, round(quantile_cont(v, 1), 6) as q100
    from (select sum(case when l_returnflag = 'R' then l_quantity else 0 end) as v from lineitem group by l_orderkey) where v > 0
""")
def class_breaks_positive(spark, d):
    v = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("v"))
    q = quantile.quantiles(v.where("v > 0"), [], "v", [0.2, 0.8, 1.0])
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


_BIN = """
    with e as (select quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1]) as e from orders),
    b as (select o_orderkey, o_totalprice as x, len(list_filter(e, lambda v: v < o_totalprice)) - 1 as b, e from orders, e)
    select o_orderkey, (case when b >= 0 then b {lowest} end)::double as bin, round(case when b >= 0 then (e[b + 1] + e[b + 2]) / 2 {centre} end, 6) as centre from b
"""


@case("quantile_bins", _BIN.format(lowest="", centre=""))
def quantile_bins(spark, d):
    o = load(spark, d, "orders")
    b = quantile.quantile_bin(o, "o_totalprice", 4, centre="centre")
    return b.select("o_orderkey", F.col("bin").cast("double").alias("bin"), F.round("centre", 6).alias("centre"))


@case("quantile_bins_lowest", _BIN.format(lowest="when x = e[1] then 0", centre="when x = e[1] then (e[1] + e[2]) / 2"))
def quantile_bins_lowest(spark, d):
    b = quantile.quantile_bin(load(spark, d, "orders"), "o_totalprice", 4, include_lowest=True, centre="centre")
    return b.select("o_orderkey", F.col("bin").cast("double").alias("bin"), F.round("centre", 6).alias("centre"))


@case("price_histogram", """
    with e(bin, low, high) as (values (0, 2000.0, 50000.0), (1, 50000.0, 100000.0), (2, 100000.0, 300000.0), (3, 300000.0, 499000.0), (4, 499000.0, 499500.0))
    select bin, low::double as low, high::double as high, count(o_orderkey) as n from e
    left join orders on o_totalprice >= low and (o_totalprice < high or (bin = 4 and o_totalprice = high)) group by all
""")
def price_histogram(spark, d):
    return quantile.histogram(load(spark, d, "orders"), "o_totalprice", [2000, 50000, 100000, 300000, 499000, 499500])


# --- ranks and series --------------------------------------------------------------------

@case("seniority", """
    select o_orderkey, row_number() over (partition by o_custkey order by year(o_orderdate), o_orderkey) - 1 as seniority from orders
""")
def seniority(spark, d):
    o = load(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return series.seniority(o, "o_custkey", "year", "o_orderkey").select("o_orderkey", "seniority")


@case("rank_by_value", """
    select event_id, event_type, row_number() over (partition by event_type order by round(value) desc, event_id) - 1 as rank from events
""")
def rank_by_value(spark, d):
    e = load(spark, d, "events").withColumn("v", F.round("value"))
    return series.rank_by_value(e, ["event_type"], "v", "event_id").select("event_id", "event_type", "rank")


@case("ranked_values", """
    with r as (select o_orderpriority, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) - 1 as k, o_totalprice as value from orders),
    m as (select max(k) as m from r), p as (select distinct o_orderpriority from orders)
    select p.o_orderpriority, g.k, coalesce(value, 0) as value from p cross join (select unnest(range(0, (select m + 1 from m))) as k) g left join r on r.o_orderpriority = p.o_orderpriority and r.k = g.k
""")
def ranked_values(spark, d):
    return series.ranked_values(load(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey")


@case("top3_per_customer", """
    select o_custkey, o_orderkey, v, rn from (select o_custkey, o_orderkey, v, row_number() over (partition by o_custkey order by v desc nulls last, o_orderkey) as rn
      from (select o_custkey, o_orderkey, case when o_orderstatus = 'F' then null else o_totalprice end as v from orders)) where rn <= 3
""")
def top3_per_customer(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("v"))
    return series.top_per_group(o, "o_custkey", [F.desc_nulls_last("v"), F.asc("o_orderkey")], 3)


@case("index_first_100", """
    with g as (select o_orderpriority as p, year(o_orderdate) as year, count(*) as n from orders where not (o_orderpriority = '5-LOW' and year(o_orderdate) = 1995) group by 1, 2),
    s as (select p, year from (select distinct o_orderpriority as p from orders), (select distinct year(o_orderdate) as year from orders))
    select s.p, s.year, round(100.0 * n / first_value(n) over (partition by s.p order by s.year), 6) as idx from s left join g on g.p = s.p and g.year = s.year
""")
def index_first_100(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("year"))
    counts = aggregate.count_rows(o.where(~((F.col("p") == "5-LOW") & (F.col("year") == 1995))), ["p", "year"])
    out = series.index_to_first(counts, "p", "year", "n", o.select("year").distinct(), relate.distinct_values(o, "p"))
    return out.select("p", "year", F.round("idx", 6).alias("idx"))


@case("excess_over_elapsed", """
    select o_orderpriority, year(o_orderdate) as year, round(avg(o_totalprice) / 1000 - (year(o_orderdate) - (select min(year(o_orderdate)) from orders)), 6) as excess from orders group by 1, 2
""")
def excess_over_elapsed(spark, d):
    o = load(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg((F.avg("o_totalprice") / 1000).alias("v"))
    return series.excess_over_elapsed(o, "year", "v").select("o_orderpriority", "year", F.round("excess", 6).alias("excess"))


@case("carry_forward", """
    with w as (select year(o_orderdate) as year, round(avg(o_totalprice), 4) as awi, count(*) as growth from orders group by 1),
    l as (select * from w order by year desc limit 1)
    select * from w union all select y, awi, 0 from l, (select unnest(range(2002, 2007)) as y)
""")
def carry_forward(spark, d):
    w = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("awi"), F.count(F.lit(1)).alias("growth"))
    last = load(spark, d, "orders").agg(F.max(F.year("o_orderdate")) + 5).scalar()
    return series.extend_yearly(w, "year", last, ["awi"], ["growth"])


@case("deflated_totals", """
    with w as (select year(o_orderdate) as year, avg(o_totalprice) as awi from orders where year(o_orderdate) <> 1999 group by 1),
    t as (select year(o_orderdate) as year, sum(o_totalprice) as v from orders group by 1), b as (select awi as base from w where year = 1998)
    select year, round(v * base / awi, 2) as divided, round(v * awi / base, 2) as multiplied from t left join w using (year), b
""")
def deflated_totals(spark, d):
    o = load(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    w = o.where("year <> 1999").groupBy("year").agg(F.avg("o_totalprice").alias("awi"))
    t = o.groupBy("year").agg(F.sum("o_totalprice").alias("divided"))
    t = t.withColumn("multiplied", F.col("divided"))
    t = series.deflate(t, w, "year", "awi", 1998, ["divided"])
    t = series.deflate(t, w, "year", "awi", 1998, ["multiplied"], "multiply")
    return t.select("year", F.round("divided", 2).alias("divided"), F.round("multiplied", 2).alias("multiplied"))


@case("top_keys_detail", """
    with t as (select l_partkey, sum(l_extendedprice) as v from lineitem group by 1 order by v desc, l_partkey limit 20)
    select l_partkey, l_returnflag, round(sum(l_extendedprice), 2) as v from lineitem where l_partkey in (select l_partkey from t) group by 1, 2
""")
def top_keys_detail(spark, d):
    li = load(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.col("l_extendedprice").alias("v"))
    return series.top_keys_detail(li, "l_partkey", ["l_returnflag"], "v", 20).withColumn("v", F.round("v", 2))


@case("top_rows", """
    select c_custkey, c_mktsegment, c_acctbal from customer where c_acctbal > 5000 and c_mktsegment <> 'BUILDING' order by c_acctbal desc, c_custkey limit 5
""")
def top_rows(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), "c_acctbal")
    return series.top_rows(c, F.col("c_acctbal") > 5000, [F.desc("c_acctbal"), F.asc("c_custkey")], 5)


@case("sample_rows", "select o_orderkey, o_custkey from orders order by md5('17:' || o_orderkey), o_orderkey limit 10")
def sample_rows(spark, d):
    return sinks.sample_rows(load(spark, d, "orders"), 10, 17, "o_orderkey").select("o_orderkey", "o_custkey")


# --- resampling --------------------------------------------------------------------------

@case("boot_median", sql_boot_median(
    "select o_orderpriority, case when o_orderstatus = 'F' then null else o_totalprice end as v from orders",
    "o_orderpriority", 1000, 11, {"p05": 0.05, "p50": 0.5, "p95": 0.95},
))
def boot_median(spark, d):
    o = load(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("v"))
    ci = resample.bootstrap_ci(o, ["o_orderpriority"], "v", "median", reps=1000, seed=11, drop_null_first=True)
    return ci.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")])


@case("boot_median_with_nulls", sql_boot_median(
    "select o_orderpriority, case when o_orderstatus = 'F' then null else o_totalprice end as v from orders",
    "o_orderpriority", 1000, 11, {"p05": 0.05, "p50": 0.5, "p95": 0.95}, nulls=True,
))
def boot_median_with_nulls(spark, d):
    o = load(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("v"))
    ci = resample.bootstrap_ci(o, ["o_orderpriority"], "v", "median", reps=1000, seed=11)
    return ci.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")])


@case("boot_share", "with " + sql_boot_share(
    "select year(o_orderdate) as year, o_orderstatus = 'F' as hit from orders where o_orderpriority <> '5-LOW'",
    "year", 1000, 3, {"p05": 0.05, "p50": 0.5, "p95": 0.95},
))
def boot_share(spark, d):
    o = load(spark, d, "orders").where("o_orderpriority <> '5-LOW'").withColumn("year", F.year("o_orderdate"))
    ci = resample.bootstrap_ci(o, ["year"], F.col("o_orderstatus") == "F", "share", reps=1000, seed=3, scale=100.0)
    return ci.select("year", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")])


_WBOOT = """
    select {g}, round(avg(stat), 6) as mean, round(stddev_pop(stat), 6) as sd, round(avg(stat) - 1.65 * stddev_pop(stat), 6) as low, round(avg(stat) + 1.65 * stddev_pop(stat), 6) as high from st group by 1
"""


@case("boot_wmean_draws", f"""
    with c as (select c_nationkey as g, c_custkey as k, c_acctbal as x, c_nationkey + c_custkey % 7 + 1.0 as w from customer),
    {sql_drawn('c', 'g', 1000, 5, 16)}
    {_WBOOT.format(g='g')}
""")
def boot_wmean_draws(spark, d):
    c = load(spark, d, "customer").select(
        F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"),
        (F.col("c_nationkey") + F.col("c_custkey") % 7 + 1.0).alias("w"),
    )
    b = resample.wmean_bootstrap(c, ["g"], "x", "w", "k", reps=1000, seed=5, piece=16)
    return b.select("g", *[F.round(m, 6).alias(m) for m in ("mean", "sd", "low", "high")])


@case("boot_wmean_poisson", f"""
    with o as (select o_orderpriority as g, o_orderkey as k, o_totalprice as x, 1.0 + o_custkey % 5 as w from orders),
    dr as ({sql_uniform(f"select * from ({sql_keys('o', "'9'", 'k')}), range(1000) t(rep)", 'rep')}),
    st as (select g, rep, sum({sql_poisson('u')} * w * x) / sum({sql_poisson('u')} * w) as stat from dr group by 1, 2)
    {_WBOOT.format(g='g').replace(', 6)', ', 4)')}
""")
def boot_wmean_poisson(spark, d):
    o = load(spark, d, "orders").select(
        F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 5 + 1.0).alias("w")
    )
    b = resample.wmean_bootstrap(o, ["g"], "x", "w", "k", reps=1000, seed=9, method="poisson")
    return b.select("g", *[F.round(m, 4).alias(m) for m in ("mean", "sd", "low", "high")])


# --- dose-response -----------------------------------------------------------------------

_UNITS = """
    select c_mktsegment as grp, c_nationkey as unit, cast(count(*) as double) as pop, round(avg(c_acctbal + 1000) / 11000, 9) as x,
           case when c_nationkey = 3 then null else round(sum(v), 2) / 1e6 end as y
    from customer join (select o_custkey, sum(o_totalprice) as v from orders group by 1) o on o_custkey = c_custkey group by 1, 2
"""
_SUMS = f"""
    with u as ({_UNITS}), s as (select grp, count(*) as j, stddev_samp(coalesce(y, 0)) as s, avg(pop) as m from u group by 1),
    b as (select unnest(range(0, 241)) as i),
    q as (select u.grp, i, -4.0::double + i * 0.05::double as beta, j, s, pop / m as p, coalesce(y, 0) as y, pow(x, -4.0::double + i * 0.05::double) as q from u join s using (grp), b),
    w as (select grp, i, beta, j, s, sum(p * y * y) as syy, sum(p * y * q) as sxy, sum(p * q * q) as sxx from q group by all)
"""


def _units(spark, d):
    load(spark, d, "customer").createOrReplaceTempView("customer")
    load(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(_UNITS)


@case("powerlaw_sums", _SUMS + """
    select grp, i, j, round(beta, 6) as beta, round(s, 6) as s, round(syy, 5) as syy, round(sxy / sqrt(sxx), 5) as fit, round(ln(sxx), 5) as log_sxx from w
""")
def powerlaw_sums(spark, d):
    w = doseresponse.powerlaw_sums(_units(spark, d), ["grp"], "x", "y", "pop")
    return w.select(
        "grp", "i", "j", F.round("beta", 6).alias("beta"), F.round("s", 6).alias("s"), F.round("syy", 5).alias("syy"),
        F.round(F.col("sxy") / F.sqrt("sxx"), 5).alias("fit"), F.round(F.ln("sxx"), 5).alias("log_sxx"),
    )


@case("powerlaw_fit", _SUMS + """,
    a as (select 0.001::double * exp(unnest(range(0, 200)) * (ln(60000.0::double) / 199)) as a), g as (select 0.02::double * exp(unnest(range(0, 40)) * (ln(600.0::double) / 39)) as g),
    c as (select grp, i, beta, -j * ln(g * s) - (syy - 2 * a * s * sxy + a * a * s * s * sxx) / (2 * g * g * s * s) - a * a / 200 - g * g / 32 - beta * beta / 32 + ln(a * s) + ln(g) as lp from w, a, g),
    t as (select grp, max(lp) as top from c group by 1),
    ma as (select grp, i, beta, sum(exp(lp - top)) as w from c join t using (grp) group by 1, 2, 3),
    cd as (select grp, i, beta, sum(w) over (partition by grp order by i) / sum(w) over (partition by grp) as c from ma),
    la as (select *, coalesce(lag(c) over (partition by grp order by i), 0) as c0, coalesce(lag(beta) over (partition by grp order by i), beta) as b0 from cd)
    select grp, """ + ", ".join(
    f"round(pow(2, min(case when c0 < {p} and c >= {p} then b0 + (beta - b0) * ({p} - c0) / (c - c0) end)), 4) as {n}" for n, p in (("median", 0.5), ("low", 0.05), ("high", 0.95))
) + " from la group by 1")
def powerlaw_fit(spark, d):
    fit = doseresponse.powerlaw_posterior(_units(spark, d), ["grp"], "x", "y", "pop", [0.5, 0.05, 0.95], ["median", "low", "high"])
    return fit.select("grp", *[F.round(c, 4).alias(c) for c in ("median", "low", "high")])


@case("fit_guard", f"""
    with u as ({_UNITS}) select grp, count(*) filter (where pop < 60) as units, count(*) filter (where pop < 60 and y > 0) as units_with_outcome,
      round(coalesce(sum(case when pop < 60 then y end), 0), 4) as outcome from u group by 1
""")
def fit_guard(spark, d):
    out = doseresponse.excluded_report(_units(spark, d), ["grp"], "y", "pop", floor=60)
    return out.withColumn("outcome", F.round("outcome", 4))


@case("fit_inputs", f"""
    with u as ({_UNITS}) select grp, unit, x, round(pop / avg(pop) over (partition by grp), 8) as p from u where pop >= 5
""")
def fit_inputs(spark, d):
    u = doseresponse.require_known(doseresponse.populated(_units(spark, d), "pop", 5), ["x"])
    return doseresponse.normalised_weights(u, ["grp"], "pop").select("grp", "unit", "x", F.round("p", 8).alias("p"))


_BUDGET = with_derived("state_budget", body="""
    , b as (select state, year,
        max(case when detail = 'Environmental Agency Budget (SRF Added)' then value end) as added, max(case when detail = 'Amount of Budget from SRF' then value end) as fund,
        max(case when detail = 'Environmental Agency Budget' then value end) as plain, max(case when detail = 'Amount of Reported SRF' then value end) as reported,
        max(case when detail = 'Budget includes SRF/ARRA funds (Yes/No)?' then value end) as answer from state_budget group by 1, 2),
    c as (select *, case when added is not null then try_cast(added as double) else try_cast(plain as double) end as budget from b),
    rows_ as (
      select state, year, detail, try_cast(value as double) as number, value as label from state_budget
      union all select state, year, 'Environmental Agency Budget (No SRF)', case when added is not null then budget - try_cast(fund as double)
        when reported is not null then budget - try_cast(reported as double) when answer <> 'Yes' then budget end, null from c where added is not null or reported is not null or answer is not null
      union all select state, year, 'Environmental Agency Budget', case when added is not null or reported is not null then budget when answer = 'Yes' then budget end, null
        from c where added is not null or reported is not null or answer is not null
      union all select s.state, s.year, replace(detail, 'Percent from ', 'Amount from '), round(try_cast(value as double) / 100 * budget, 2), null from state_budget s join c on s.state = c.state and s.year = c.year where detail like 'Percent from %'
      union all select s.state, s.year, replace(detail, 'Amount from ', 'Percent from '), round(try_cast(value as double) / budget * 100, 2), null from state_budget s join c on s.state = c.state and s.year = c.year where detail like 'Amount from %')
    select state, year, detail, number, case when number is null then label end as label from rows_
""")


@case("budget_rows", _BUDGET)
def budget_rows(spark, d):
    rows = aggregate.derive_budget_rows(derived(spark, d, "state_budget"))
    number = F.col("value").try_cast("double")
    return rows.select("state", "year", "detail", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("label"))
