"""The composed reports over civic tables derived from the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from contract.base import case, derived, load, sql_with_p, with_derived
from contract.statistics import sql_boot_median, sql_boot_share, sql_drawn
from contract.texts import all_flags
from regdata.functions.text import keyword_flags
from regdata.operators import relate, series
from regdata.plans import budget, discharge, enforcement, events, staffing
from regdata.vocab import HEADCOUNT_CLASSES, WAGE_CLASSES


def rounded(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def actions(spark, d):
    return derived(spark, d, "enforcement").withColumn("municipality", F.array("town"))


# --- enforcement -------------------------------------------------------------------------

@case("report_actions_per_year", with_derived("enforcement", body="select year, count(*) as n from enforcement group by 1"))
def report_actions_per_year(spark, d):
    return enforcement.actions_per_year(actions(spark, d))


@case("report_penalties_per_year", with_derived("enforcement", body="select year, round(coalesce(sum(fine), 0) / 1e6, 8) as penalties_m from enforcement group by 1"))
def report_penalties_per_year(spark, d):
    return rounded(enforcement.penalties_per_year(actions(spark, d)), 8, "penalties_m")


@case("report_ranked_penalties", with_derived("enforcement", body="""
    , r as (select year, row_number() over (partition by year order by fine desc, id) - 1 as k, fine from enforcement where fine is not null),
    g as (select y.year, k.k from (select distinct year from r) y, (select unnest(range(0, (select max(k) + 1 from r))) as k) k)
    select g.year, g.k, round(coalesce(fine, 0) / 1e6, 8) as penalty_m from g left join r on r.year = g.year and r.k = g.k
"""))
def report_ranked_penalties(spark, d):
    return rounded(enforcement.ranked_penalties(actions(spark, d)), 8, "penalty_m")


@case("report_actions_and_funding", with_derived("enforcement", "funding", body="""
    select e.year, n, round(admin_budget / 1e6, 8) as budget_m from (select year, count(*) as n from enforcement group by 1) e left join funding f on f.year = e.year
"""))
def report_actions_and_funding(spark, d):
    return rounded(enforcement.actions_and_funding(actions(spark, d), derived(spark, d, "funding")), 8, "budget_m")


@case("report_funding_correlation", with_derived("enforcement", "funding", body=sql_with_p("""
    select count(*) as n, corr(n, admin_budget) as r from (select year, count(*) as n from enforcement group by 1) e join funding f on f.year = e.year
""")))
def report_funding_correlation(spark, d):
    fact = enforcement.funding_correlation(actions(spark, d), derived(spark, d, "funding"))
    return fact.select("n", F.round("r", 8).alias("r"), F.round("p", 6).alias("p"))


def _flagged(spark, d):
    return keyword_flags(actions(spark, d), "text", all_flags())


_TOPICS = all_flags()


def _told(terms: list[str]) -> str:
    return " or ".join(f"contains(lower(text), '{t.lower()}')" for t in terms)


_TOPIC_ROWS = " union all ".join(
    f"select year, '{flag}' as flag, sum(case when {_told(terms)} then 1 else 0 end) as hits, count(*) as n from enforcement group by 1" for flag, terms in _TOPICS.items()
)


@case("report_topic_shares", with_derived("enforcement", body=f"""
    select year, flag, upper(substr(trim(split_part(flag, '_', 2)), 1, 1)) || substr(trim(split_part(flag, '_', 2)), 2) as t, hits::bigint as hits, round(100.0 * hits / n, 6) as pct from ({_TOPIC_ROWS})
"""))
def report_topic_shares(spark, d):
    shares = enforcement.topic_shares(_flagged(spark, d), list(_TOPICS))
    # SQL has no title case; compare the first letter only
    t = F.concat(F.left("topic", F.lit(1)), F.lower(F.substr("topic", F.lit(2))))
    return rounded(shares.select("year", "flag", t.alias("t"), "hits", "pct"), 6, "pct")


@case("report_topic_facts", with_derived("enforcement", body=f"""
    , s as (select *, 100.0::double * hits / n as pct from ({_TOPIC_ROWS}))
    select flag, round(avg(case when year < (select max(year) from s) then hits end), 6) as yearly_hits, round(avg(case when year < (select max(year) from s) then pct end), 6) as yearly_pct,
      round(max(case when year = 1996 then pct end), 6) as first_pct, round(max(case when year = 2000 then pct end), 6) as last_pct,
      round((1 - max(case when year = 2000 then pct end) / nullif(max(pct), 0)) * 100, 6) as drop_from_peak_pct from s group by 1
"""))
def report_topic_facts(spark, d):
    facts = enforcement.topic_facts(_flagged(spark, d), list(_TOPICS), 1996, 2000)
    return rounded(facts, 6, "yearly_hits", "yearly_pct", "first_pct", "last_pct", "drop_from_peak_pct")


@case("report_penalty_histogram", with_derived("enforcement", body="""
    , k as (select unnest(range(0, 19)) as k), v as (select k, 200.0 * pow(2, k) as v from k),
    e as (select k, round(v / pow(10, floor(log10(v)))) * pow(10, floor(log10(v))) as e from v),
    b as (select a.k as bin, a.e as low, b.e as high from e a join e b on b.k = a.k + 1)
    select bin, '$' || format('{:,}', low::bigint) || ' - ' || format('{:,}', high::bigint) as label, count(id) as n
    from b left join enforcement on fine >= low and (fine < high or (bin = 17 and fine = high)) group by 1, 2
"""))
def report_penalty_histogram(spark, d):
    return enforcement.penalty_histogram(actions(spark, d))


@case("report_median_penalty", sql_boot_median(
    "select o_y as year, v from (select year(o_orderdate) as o_y, case when o_orderstatus = 'F' then null else o_totalprice end as v from orders) where o_y < (select max(year(o_orderdate)) from orders)",
    "year", 1000, 4, {"low": 0.05, "median": 0.5, "high": 0.95}, nulls=True,
))
def report_median_penalty(spark, d):
    return rounded(enforcement.median_penalty(actions(spark, d), 1000, 4), 6, "low", "median", "high")


@case("report_orders_with_penalty", with_derived("enforcement", body=", " + sql_boot_share(
    "select year, fine > 0 as hit from enforcement where contains(lower(text), 'consent order')", "year", 1000, 2, {"low": 0.05, "pct": 0.5, "high": 0.95},
)))
def report_orders_with_penalty(spark, d):
    return rounded(enforcement.orders_with_penalty(_flagged(spark, d), "order_consent order", 1000, 2), 6, "low", "pct", "high")


@case("report_orders_with_penalty_counts", with_derived("enforcement", body="""
    select year, count(*) as orders, count(fine) as with_penalty, round(100.0 * count(fine) / count(*), 6) as pct from enforcement where contains(lower(text), 'consent order') group by 1
"""))
def report_orders_with_penalty_counts(spark, d):
    return rounded(enforcement.orders_with_penalty_counts(_flagged(spark, d), "order_consent order"), 6, "pct")


_TOWNS = """
    , t as (select c.town, population, income / 1000 as income_k, count(id) as n, coalesce(sum(fine), 0) / 1000 as penalties_k,
       count(id) * 1e5 / population as actions_per_100k, coalesce(sum(fine), 0) / 1e6 * 1e5 / population as penalties_m_per_100k
       from census c left join enforcement e on e.town = c.town group by c.town, population, income)
"""


def _summary(spark, d):
    return enforcement.town_summary(actions(spark, d), derived(spark, d, "census"))


@case("report_town_summary", with_derived("enforcement", "census", body=_TOWNS + """
    select town, population, round(income_k, 6) as income_k, n, round(penalties_k, 5) as penalties_k, round(actions_per_100k, 6) as actions_per_100k, round(penalties_m_per_100k, 6) as penalties_m_per_100k from t
"""))
def report_town_summary(spark, d):
    s = rounded(_summary(spark, d), 6, "income_k", "actions_per_100k", "penalties_m_per_100k")
    return rounded(s, 5, "penalties_k")


@case("report_top_actions_per_town", with_derived("enforcement", body="""
    select town, place, id, fine from (select town, id, fine, row_number() over (partition by town order by fine desc nulls last, id) as place from enforcement) where place <= 3
"""))
def report_top_actions_per_town(spark, d):
    return enforcement.top_actions_per_town(actions(spark, d)).select("town", "place", "id", "fine")


@case("report_top_towns", with_derived("enforcement", "census", body=_TOWNS + """
    select town, round(penalties_m_per_100k, 6) as penalties_m_per_100k from t where population > 25000 order by t.penalties_m_per_100k desc, town limit 5
"""))
def report_top_towns(spark, d):
    return rounded(enforcement.top_towns(_summary(spark, d), "penalties_m_per_100k").select("town", "penalties_m_per_100k"), 6, "penalties_m_per_100k")


def _binned_boot(seed: int, centre: str, reps: int = 1000) -> str:
    """Resampled means per bin of the table ``b`` (key, y, w, bin, centre)."""
    return f"""
    known as (select bin, key as k, y as x, w from b where bin >= 0),
    {sql_drawn('known', 'bin', reps, seed)}
    select bin, round(any_value(centre), 6) as {centre}, round(avg(stat), 5) as mean, round(stddev_pop(stat), 5) as sd, round(avg(stat) - 1.65 * stddev_pop(stat), 5) as low, round(avg(stat) + 1.65 * stddev_pop(stat), 5) as high
    from st join (select distinct bin, centre from b) using (bin) group by 1
"""


@case("report_rate_by_income", with_derived("enforcement", "census", body=_TOWNS + """
    , e as (select quantile_cont(income_k, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) as e from t),
    b as (select n_nationkey as key, actions_per_100k as y, population as w, len(list_filter(e, lambda v: v < income_k)) - 1 as bin, (e[bin + 1] + e[bin + 2]) / 2 as centre from t join nation on n_name = town, e),
""" + _binned_boot(6, "income_centre")))
def report_rate_by_income(spark, d):
    keys = load(spark, d, "nation").select(F.col("n_name").alias("town"), F.col("n_nationkey").cast("long").alias("key"))
    out = enforcement.rate_by_income(_summary(spark, d).join(keys, "town"), seed=6)
    return rounded(rounded(out, 6, "income_centre"), 5, "mean", "sd", "low", "high")


# --- staff -------------------------------------------------------------------------------

def _both(spark, d):
    return staffing.combined(derived(spark, d, "staff"), derived(spark, d, "payroll"))


_STAFF = """
    , j as (select coalesce(s.calendar_year, p.year) as year, coalesce(earnings, pay_total) as earnings, position_type, pay_buyout from staff s
       full outer join payroll p on s.calendar_year = p.year and s.name_first = p.name_first and s.name_last = p.name_last)
"""


@case("report_staff_per_year", with_derived("staff", "payroll", body=_STAFF + """
    select year, count(earnings) as staff, count(case when position_type = 'Full Time Employee' then earnings end) as full_time from j group by 1
"""))
def report_staff_per_year(spark, d):
    return staffing.staff_per_year(_both(spark, d))


@case("report_staff_correlation", with_derived("staff", "payroll", "funding", body=_STAFF + sql_with_p("""
    select count(*) as n, corr(s, admin_budget) as r from (select year, count(earnings) as s from j group by 1) k join funding f on f.year = k.year
""", 100, "r_pct", 6, "p_pct")))
def report_staff_correlation(spark, d):
    return rounded(staffing.staff_correlation(_both(spark, d), derived(spark, d, "funding")).select("n", "r_pct", "p_pct"), 6, "r_pct", "p_pct")


@case("report_staff_and_funding", with_derived("staff", "payroll", "funding", body=_STAFF + """
    select k.year, s as staff, round(admin_budget / 1e6, 8) as budget_m from (select year, count(earnings) as s from j group by 1) k left join funding f on f.year = k.year
"""))
def report_staff_and_funding(spark, d):
    return rounded(staffing.staff_and_funding(_both(spark, d), derived(spark, d, "funding")), 8, "budget_m")


@case("report_buyouts", with_derived("staff", "payroll", "wages", body=_STAFF + """
    , g as (select year, coalesce(sum(pay_buyout), 0) / 1e6 as cost, count(case when pay_buyout > 0 then 1 end) as people from j group by 1)
    select g.year, round(cost * (select awi from wages where year = 1998) / awi, 8) as cost_m, people from g left join wages w on w.year = g.year
"""))
def report_buyouts(spark, d):
    return rounded(staffing.buyouts(_both(spark, d), derived(spark, d, "wages"), 1998), 8, "cost_m")


def _classes(names) -> str:
    return ", ".join(f"('{n}')" for n in names)


_CLASS = """
    , c as (select *, case when contains(lower(job_title), 'environmental analyst') then 'Environmental Analyst' when contains(lower(job_title), 'environmental engineer') then 'Environmental Engineer'
        when contains(lower(job_title), 'planners') then 'Regional Planner' when contains(lower(job_title), 'counsel') then 'Counsel' else 'OTHER' end as job_class from staff),
    y as (select distinct calendar_year as year from staff)
"""


def _staff_years(spark, d):
    s = staffing.with_job_class(derived(spark, d, "staff"))
    return s, s.select(F.col("calendar_year").alias("year")).distinct()


@case("report_mean_wages", with_derived("staff", "wages", body=_CLASS + f"""
    , k as (select * from (values {_classes(WAGE_CLASSES)}) v(job_class)), g as (select job_class, calendar_year as year, sum(earnings) / count(earnings) / 1000 as v from c group by 1, 2)
    select k.job_class, y.year, round(v, 6) as nominal_k, round(v * (select awi from wages where year = 1998) / awi, 6) as real_k
    from k cross join y left join g on g.job_class = k.job_class and g.year = y.year left join wages w on w.year = y.year
"""))
def report_mean_wages(spark, d):
    s, years = _staff_years(spark, d)
    return rounded(staffing.mean_wages(s, years, derived(spark, d, "wages"), 1998).select("job_class", "year", "nominal_k", "real_k"), 6, "nominal_k", "real_k")


@case("report_seniority_gain", with_derived("staff", body=_CLASS + f"""
    , s as (select *, row_number() over (partition by person order by calendar_year, id) - 1 as seniority from c),
    k as (select * from (values {_classes(WAGE_CLASSES)}) v(job_class)), g as (select job_class, calendar_year as year, sum(seniority) * 1.0::double / count(earnings) as v from s group by 1, 2)
    select k.job_class, y.year, round(v - (y.year - (select min(year) from y)), 6) as gain from k cross join y left join g on g.job_class = k.job_class and g.year = y.year
"""))
def report_seniority_gain(spark, d):
    s, years = _staff_years(spark, d)
    s = series.seniority(s, "person", "calendar_year", "id")
    return rounded(staffing.seniority_gain(s, years).select("job_class", "year", "gain"), 6, "gain")


@case("report_headcount_index", with_derived("staff", body=_CLASS + f"""
    , k as (select * from (values {_classes(HEADCOUNT_CLASSES)}) v(job_class)), g as (select job_class, calendar_year as year, count(earnings) as n from c group by 1, 2)
    select k.job_class, y.year, round(100.0 * n / first_value(n) over (partition by k.job_class order by y.year), 6) as idx from k cross join y left join g on g.job_class = k.job_class and g.year = y.year
"""))
def report_headcount_index(spark, d):
    s, years = _staff_years(spark, d)
    return rounded(staffing.headcount_index(s, years).select("job_class", "year", "idx"), 6, "idx")


# --- budgets -----------------------------------------------------------------------------

_STATE_YEARS = """
    , h as (select state, year, max(try_cast(value as double)) as v from state_budget where detail = '{detail}' group by 1, 2),
    k as (select s.state, y.year from (select distinct state from h) s, (select distinct year from state_budget) y)
"""


@case("report_state_budgets", with_derived("state_budget", "wages", body=_STATE_YEARS.format(detail="Environmental Agency Budget") + """
    select k.state, k.year, round(v * (select awi from wages where year = 1998) / awi / 1e6, 6) as budget_m from k left join h on h.state = k.state and h.year = k.year left join wages w on w.year = k.year
"""))
def report_state_budgets(spark, d):
    return rounded(budget.state_budgets(derived(spark, d, "state_budget"), derived(spark, d, "wages"), 1998), 6, "budget_m")


@case("report_state_budgets_per_capita", with_derived("state_budget", "wages", "census", body=_STATE_YEARS.format(detail="Environmental Agency Budget") + """
    select k.state, k.year, round(v * (select awi from wages where year = 1998) / awi / 1e3 / population, 9) as budget_k_per_head from k left join h on h.state = k.state and h.year = k.year
    left join wages w on w.year = k.year left join census c on c.town = k.state
"""))
def report_state_budgets_per_capita(spark, d):
    history = derived(spark, d, "state_budget")
    census = derived(spark, d, "census").select(F.col("town").alias("state"), F.col("population").alias("people"))
    pop = relate.spine_of(census, {"year": relate.distinct_values(history, "year")})
    return rounded(budget.state_budgets_per_capita(history, derived(spark, d, "wages"), pop, 1998), 9, "budget_k_per_head")


@case("report_federal_share", with_derived("state_budget", body=_STATE_YEARS.format(detail="Percent from Federal Government") + """
    select k.state, k.year, v as federal_pct from k left join h on h.state = k.state and h.year = k.year
"""))
def report_federal_share(spark, d):
    return budget.federal_share(derived(spark, d, "state_budget"))


@case("report_budget_summary", """
    with y as (select year(o_orderdate) as y, o_orderstatus as st, round(sum(o_totalprice)) as total, count(*) as n from orders group by 1, 2)
    select 'FY' || right(y::varchar, 2) || case st when 'F' then ' Gov' when 'O' then ' Sen' else '' end as label, 2000 + y % 100 as year, case when st = 'F' then 1 else 0 end as governor, round(total / 1e6, 6) as total_m,
      case when st = 'P' then n end::double as admin from y
""")
def report_budget_summary(spark, d):
    o = load(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    short = F.concat(F.lit("FY"), F.right(F.col("y").cast("string"), F.lit(2)))
    label = F.concat(short, F.when(F.col("o_orderstatus") == "F", " Gov").when(F.col("o_orderstatus") == "O", " Sen").otherwise(""))
    labels = o.groupBy(label.alias("label")).agg(F.format_number(F.round(F.sum("o_totalprice")).cast("long"), 0).alias("total"))
    years = [f"FY{y}" for y in ("95", "96", "97", "98", "99", "00", "01")]
    plain = o.where("o_orderstatus = 'P'").withColumn("item", F.lit("Administration")).withColumn("fy", short)
    items = relate.long_to_wide(plain, ["item"], "fy", years, F.format_number(F.count(F.lit(1)), 0))
    return rounded(budget.line_item_summary(labels, items, "Administration", years), 6, "total_m")


@case("report_wage_series", with_derived("wages", body="""
    , l as (select max(year) as y, arg_max(awi, year) as awi from wages)
    select year, awi, 1.5::double as growth from wages union all select unnest(range(2002, 2001 + 4)), awi, 0 from l
"""))
def report_wage_series(spark, d):
    w = derived(spark, d, "wages").withColumn("growth", F.lit(1.5))
    last = derived(spark, d, "wages").agg(F.max("year") + 3).scalar()
    return budget.wage_series(w, last, ["awi"], ["growth"])


@case("report_unified_history", """
    with o as (select n_name as state, year(o_orderdate) as y, count(*) as n, round(sum(o_totalprice))::bigint as v from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2),
    m as (select state, y as year, case when y >= 1997 then v else v + 1 end as budget, n as federal from o),
    r as (select state, year, 'Environmental Agency Budget' as detail, budget::double as value from m union all
          select state, year, 'Percent from Federal Government', federal from m where year < 1999 union all
          select state, year, 'Amount from Federal Government', round(federal / 100.0::double * budget, 2) from m where year < 1999)
    select * from r
""")
def report_unified_history(spark, d):
    """Two editions that overlap in 1997 and 1998; the newer one has the right budget."""
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = o.groupBy(F.col("n_name").alias("unit"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice")).cast("long").alias("v"))
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    old, new = g.where("y < 1999"), g.where("y >= 1997")
    first = relate.union_all([
        old.select("unit", F.lit("Env. Agency\nBudget").alias("detail"), F.concat(F.lit("FY "), F.col("y") - 1, F.lit("-"), "y").alias("column"), money(F.col("v") + 1).alias("value")),
        old.select("unit", F.lit("Env. Agency\nBudget").alias("detail"), F.concat(F.lit("FY "), "y").alias("column"), money(F.col("v")).alias("value")),
        old.select("unit", F.lit("% from Federal Government (e.g., EPA)").alias("detail"), F.concat(F.lit("FY "), "y").alias("column"), F.concat("n", F.lit("%")).alias("value")),
    ])
    second = new.select("unit", F.lit("Environmental Agency Budget").alias("detail"), F.concat(F.lit("FY"), "y").alias("column"), money(F.col("v")).alias("value"))
    out = budget.unified_history([first, second])
    return out.select("state", "year", "detail", F.col("value").cast("double").alias("value"))


@case("report_state_population", """
    select n_name as state, y as year, count(*) * 1000.0::double as people from customer join nation on c_nationkey = n_nationkey, (values (2000), (2001), (2010)) v(y) where n_regionkey <> 4 group by 1, 2
""")
def report_state_population(spark, d):
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.groupBy(F.col("n_name").alias("state"), "n_regionkey").agg(F.format_number(F.count(F.lit(1)) * 1000, 0).alias("p"))
    decade = g.select("state", F.col("p").alias("2000"), F.col("p").alias("2001"))
    recent = g.where("n_regionkey <> 4").select("state", F.col("p").alias("2010"))
    return budget.state_population(decade, recent, ["2000", "2001"], ["2010"])


# --- incidents ---------------------------------------------------------------------------

START, END = "2024-01-03", "2024-01-28"
_REPORTS = f"""
    , r as (select * from incidents where incident_date >= timestamp '{START}' and incident_date <= timestamp '{END}' and reporter_class = 'Verified Data Report'),
    t as (select distinct event_type from r)
"""


def _reports(spark, d):
    return events.verified(derived(spark, d, "incidents"), dt.date(2024, 1, 3), dt.date(2024, 1, 28))


@case("report_events_per_month", with_derived("incidents", body=_REPORTS + """
    , m as (select unnest(generate_series(date '2023-12-01', date '2024-03-01', interval 1 month))::date as month), g as (select date_trunc('month', incident_date)::date as month, event_type, count(*) as n from r group by 1, 2)
    select m.month::varchar as month, t.event_type, coalesce(n, 0) as n from m cross join t left join g on g.month = m.month and g.event_type = t.event_type
"""))
def report_events_per_month(spark, d):
    return events.events_per_month(_reports(spark, d), "2023-12-01", "2024-03-02").withColumn("month", F.col("month").cast("string"))


@case("report_volume_per_month", with_derived("incidents", body=_REPORTS + """
    , m as (select unnest(generate_series(date '2023-12-01', date '2024-03-01', interval 1 month))::date as month), g as (select date_trunc('month', incident_date)::date as month, event_type, sum(volume) / 1e6 as v from r group by 1, 2)
    select m.month::varchar as month, t.event_type, round(coalesce(v, 0), 6) as volume_m from m cross join t left join g on g.month = m.month and g.event_type = t.event_type
"""))
def report_volume_per_month(spark, d):
    out = events.volume_per_month(_reports(spark, d), "2023-12-01", "2024-03-02").withColumn("month", F.col("month").cast("string"))
    return rounded(out, 6, "volume_m")


@case("report_volume_per_operator", with_derived("incidents", body=_REPORTS + """
    , o as (select distinct operator from r), g as (select operator, event_type, sum(volume) / 1e6 as v from r group by 1, 2)
    select o.operator, t.event_type, round(coalesce(v, 0), 6) as volume_m from o cross join t left join g on g.operator = o.operator and g.event_type = t.event_type
"""))
def report_volume_per_operator(spark, d):
    return rounded(events.volume_per_operator(_reports(spark, d)), 6, "volume_m")


@case("report_volume_per_water_body", with_derived("incidents", body=_REPORTS + """
    , o as (select water_body from r group by 1 order by sum(volume) desc, 1 limit 20), g as (select water_body, event_type, sum(volume) / 1e6 as v from r group by 1, 2)
    select o.water_body, t.event_type, round(coalesce(v, 0), 6) as volume_m from o cross join t left join g on g.water_body = o.water_body and g.event_type = t.event_type
"""))
def report_volume_per_water_body(spark, d):
    return rounded(events.volume_per_water_body(_reports(spark, d)), 6, "volume_m")


@case("report_reporting_rates", with_derived("incidents", body=_REPORTS + """
    select event_type, round(100.0 * avg(case when volume > 0 then 1.0 else 0 end), 6) as nonzero_pct, round(100.0 * avg(case when volume % 1000 = 0 then 1.0 else 0 end), 6) as modelled_pct from r group by 1
"""))
def report_reporting_rates(spark, d):
    return rounded(events.reporting_rates(_reports(spark, d)), 6, "nonzero_pct", "modelled_pct")


@case("report_outfall_rollup", with_derived("incidents", body=_REPORTS + """
    , f as (select reporter_class, outfall_id, coalesce(latitude, 42 + substr(outfall_id, 5)::int * 0.001) as latitude, coalesce(longitude, -71 - substr(outfall_id, 5)::int * 0.002) as longitude, volume, operator, water_body from r)
    select reporter_class, outfall_id, round(latitude, 6)::double as latitude, round(longitude, 6)::double as longitude, round(coalesce(sum(volume), 0) / 1e6, 6) as volume, count(*) as n, min(operator) as operator, min(water_body) as water_body from f group by 1, 2, 3, 4
"""))
def report_outfall_rollup(spark, d):
    out = events.outfall_rollup(_reports(spark, d), derived(spark, d, "outfalls"))
    return out.withColumns({
        "latitude": F.round("latitude", 6).cast("double"), "longitude": F.round("longitude", 6).cast("double"), "volume": F.round("volume", 6),
    })


@case("report_inspections_per_town", """
    select n_name as town, count(o_orderkey) as n from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1
""")
def report_inspections_per_town(spark, d):
    n = load(spark, d, "nation").withColumnRenamed("n_name", "town")
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return events.inspections_per_town(o.join(n, F.col("c_nationkey") == F.col("n_nationkey")), n)


@case("report_class_breaks", with_derived("areas", "discharge", body="""
    select round(quantile_cont(v, 0.2), 8) as q20, round(quantile_cont(v, 0.4), 8) as q40, round(quantile_cont(v, 0.99), 8) as q99 from (select area, sum(volume) as v from discharge group by 1) where v > 0
"""))
def report_class_breaks(spark, d):
    per_area = discharge.discharge_by_area(derived(spark, d, "discharge"))
    return rounded(events.class_breaks(per_area, "volume", [0.2, 0.4, 0.99], positive=True), 8, "q20", "q40", "q99")


@case("report_tests_per_year", """
    select year(l_shipdate) as year, l_returnflag as contaminant_group, l_linestatus as raw_or_finished, l_suppkey as system, count(nullif(l_quantity, 1)) as n from lineitem group by 1, 2, 3, 4
""")
def report_tests_per_year(spark, d):
    t = load(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("collected"), F.col("l_returnflag").alias("contaminant_group"), F.col("l_linestatus").alias("raw_or_finished"),
        F.col("l_suppkey").alias("system"), F.nullif("l_quantity", F.lit(1.0)).alias("result"),
    )
    return events.tests_per_year(t)


# --- discharge ---------------------------------------------------------------------------

INDICATORS = ["minority", "lowincome", "isolation"]
LEVELS = ["area", "town", "watershed"]


@case("report_discharge_by_town", with_derived("areas", "discharge", body="""
    select town, round(coalesce(sum(volume), 0), 5) as volume, coalesce(sum(n), 0)::double as n from areas a full outer join discharge s on s.area = a.area where town is not null group by 1
"""))
def report_discharge_by_town(spark, d):
    return rounded(discharge.discharge_by(derived(spark, d, "discharge"), derived(spark, d, "areas"), "town").withColumn("n", F.col("n").cast("double")), 5, "volume")


@case("report_discharge_by_area", with_derived("discharge", body="select area, round(sum(volume), 5) as volume, sum(n)::double as n from discharge group by 1"))
def report_discharge_by_area(spark, d):
    return rounded(discharge.discharge_by_area(derived(spark, d, "discharge")).withColumn("n", F.col("n").cast("double")), 5, "volume")


@case("report_discharge_per_water_body", with_derived("areas", "discharge", body="""
    select watershed, 'Water ' || substr(s.area::varchar, 1, 1) as water_body, outfall, round(sum(volume), 5) as volume from discharge s join areas a on a.area = s.area group by 1, 2, 3
"""))
def report_discharge_per_water_body(spark, d):
    s = derived(spark, d, "discharge").withColumn("water_body", F.concat(F.lit("Water "), F.left(F.col("area").cast("string"), F.lit(1))))
    return rounded(discharge.discharge_per_water_body(s, derived(spark, d, "areas")), 5, "volume")


@case("report_demographics", with_derived("areas", body="""
    select watershed, round(sum(pop * minority) / sum(pop), 8) as minority, round(sum(pop * lowincome) / sum(pop), 8) as lowincome, round(sum(pop * isolation) / sum(pop), 8) as isolation from areas group by 1
"""))
def report_demographics(spark, d):
    return rounded(discharge.demographics_by(derived(spark, d, "areas"), "watershed", INDICATORS), 8, *INDICATORS)


def _units(level: str, fill: str) -> str:
    """Units of a level, once per indicator; a unit without known weights has no indicator."""
    mean = lambda c: f"sum(pop * {c}) / nullif(sum(pop), 0)"
    one = f"(select a.{level} as unit, {', '.join(f'{mean(c)} as {c}' for c in INDICATORS)}, sum(pop) as pop from areas a group by 1)"
    volume = f"(select a.{level} as unit, sum(volume) as volume from discharge s join areas a on a.area = s.area group by 1)"
    return " union all ".join(
        f"select '{level}' as level, '{c}' as indicator, cast(unit as varchar) as key, {c} as x, pop as w, {fill.format('v.volume')} as y from {one} u left join {volume} v using (unit)" for c in INDICATORS
    )


_PANELS = " union all ".join(_units(level, "{}" if level == "area" else "coalesce({}, 0)") for level in LEVELS)
_FITTED = " union all ".join(_units(level, "coalesce({}, 0)") for level in LEVELS)


def _level_tables(spark, d, fill_areas: float | None):
    found, areas = derived(spark, d, "discharge"), derived(spark, d, "areas")
    return {v: discharge.level_table(found, areas, v, INDICATORS, fill_areas if v == "area" else 0.0) for v in LEVELS}


@case("report_discharge_vs_indicator", with_derived("areas", "discharge", body=f"""
    , l as ({_PANELS}),
    e as (select level, indicator, list_sort(list_distinct(quantile_cont(x, [0, 0.25, 0.5, 0.75, 1]))) as e from l group by 1, 2),
    b as (select level, indicator, key as k, y as x, w, len(list_filter(e, lambda v: v < l.x)) - 1 as bin, (e[bin + 1] + e[bin + 2]) / 2 as centre from l join e using (level, indicator)),
    known as (select * from b where bin >= 0),
    {sql_drawn('known', 'level, indicator, bin', 1000, 8)}
    select level, indicator, bin, round(any_value(centre), 6) as centre, round(avg(stat), 5) as mean, round(stddev_pop(stat), 5) as sd, round(avg(stat) - 1.65 * stddev_pop(stat), 5) as low, round(avg(stat) + 1.65 * stddev_pop(stat), 5) as high
    from st join (select distinct level, indicator, bin, centre from b) using (level, indicator, bin) group by 1, 2, 3
"""))
def report_discharge_vs_indicator(spark, d):
    out = discharge.discharge_panels(_level_tables(spark, d, None), INDICATORS, seed=8)
    return rounded(rounded(out, 6, "centre"), 5, "mean", "sd", "low", "high")


@case("report_dependence", with_derived("areas", "discharge", body=f"""
    , u0 as (select level, indicator, x, y, w as pop from ({_FITTED}) where w >= 50 and x is not null),
    """ + """
    u as (select *, pop / avg(pop) over (partition by level, indicator) as p from u0), s as (select level, indicator, count(*) as j, stddev_samp(y) as s from u group by 1, 2),
    q as (select u.level, u.indicator, i, -4.0::double + i * 0.05::double as beta, j, s, p, y, pow(x, -4.0::double + i * 0.05::double) as q from u join s using (level, indicator), range(0, 241) b(i)),
    w as (select level, indicator, i, beta, j, s, sum(p * y * y) as syy, sum(p * y * q) as sxy, sum(p * q * q) as sxx from q group by all),
    a as (select 0.001::double * exp(unnest(range(0, 200)) * (ln(60000.0::double) / 199)) as a), g as (select 0.02::double * exp(unnest(range(0, 40)) * (ln(600.0::double) / 39)) as g),
    c as (select level, indicator, i, beta, -j * ln(g * s) - (syy - 2 * a * s * sxy + a * a * s * s * sxx) / (2 * g * g * s * s) - a * a / 200 - g * g / 32 - beta * beta / 32 + ln(a * s) + ln(g) as lp from w, a, g),
    t as (select level, indicator, max(lp) as top from c group by 1, 2),
    ma as (select level, indicator, i, beta, sum(exp(lp - top)) as w from c join t using (level, indicator) group by 1, 2, 3, 4),
    cd as (select level, indicator, i, beta, sum(w) over (partition by level, indicator order by i) / sum(w) over (partition by level, indicator) as c from ma),
    la as (select *, coalesce(lag(c) over (partition by level, indicator order by i), 0) as c0, coalesce(lag(beta) over (partition by level, indicator order by i), beta) as b0 from cd)
    select level, indicator, """ + ", ".join(
    f"round(pow(2, min(case when c0 < {p} and c >= {p} then b0 + (beta - b0) * ({p} - c0) / (c - c0) end)), 3) as {n}" for n, p in (("median", 0.5), ("low", 0.05), ("high", 0.95))
) + " from la group by 1, 2"))
def report_dependence(spark, d):
    return rounded(discharge.dependence_facts(_level_tables(spark, d, 0.0), INDICATORS, skip_unknown=True), 3, "median", "low", "high")
