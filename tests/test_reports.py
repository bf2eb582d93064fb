"""Reports against published numbers (small literal copies) and conservation rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regdata.operators import aggregate, doseresponse, quality
from regdata.plans import budget, discharge, enforcement

# yearly enforcement counts and administrative budget, 2004-2017. Fixed values.
COUNTS = [335, 357, 374, 487, 363, 354, 331, 255, 197, 327, 330, 277, 239, 122]
BUDGET = [47196107, 47665327, 47319588, 52423300, 51300608, 49001215, 40831932, 36308230, 33856790, 34566861, 36374514, 38297401, 38624265, 31390973]
# share of minority population, discharge and population of 32 watersheds. Fixed values.
WATERSHEDS = [
    (0.2091016668, 379.66, 463937), (0.1594848028, 124.0, 92780), (0.1924139696, 366.5, 234510), (0.2501304730, 48.52, 471362),
    (0.3468945763, 360.87, 429410), (0.1965266270, 7.69, 123108), (0.3404820238, 650.28, 438775), (0.1744861080, 132.03, 177080),
    (0.3529925338, 149.1, 521147), (0.3514477547, 525.74, 1107957), (0.1924326912, 29.37, 208925), (0.2643756426, 0.0, 365688),
    (0.0897557758, 0.0, 206204), (0.0605055668, 0.0, 193288), (0.1144943924, 0.0, 86668), (0.0842471715, 0.0, 34470),
    (0.0891709909, 0.0, 32376), (0.1282894374, 0.0, 90631), (0.0491314266, 0.0, 5699), (0.0316804408, 0.0, 726),
    (0.1228003784, 0.0, 68705), (0.0357490788, 0.0, 23609), (0.1379510216, 0.0, 27604), (0.1392064560, 0.0, 1487),
    (0.1073063568, 0.0, 135649), (0.0391382811, 0.0, 35464), (0.0731786804, 0.0, 67506), (0.1641068128, 0.0, 47073),
    (0.2309741697, 0.0, 432399), (0.4072891056, 0.0, 285522), (0.2612764765, 0.0, 242762), (0.1018750589, 0.0, 53065),
]


def test_published_correlation(spark):
    actions = spark.createDataFrame([(y, y) for y, n in zip(range(2004, 2018), COUNTS) for _ in range(n)], "year int, id int")
    funding = spark.createDataFrame([(y, float(b)) for y, b in zip(range(2004, 2018), BUDGET)], "year int, admin_budget double")
    fact = enforcement.funding_correlation(actions, funding).first()
    assert fact.n == 14 and round(100 * fact.r) == 82
    assert fact.p == pytest.approx(2.9e-4, rel=0.05)


@pytest.mark.parametrize("pairs, p", [([(1, 2), (2, 1), (3, 4), (4, 3)], 0.4), ([(1, 1), (2, 2), (3, 3)], 0.0), ([(1, 5), (2, 5)], None)])
def test_correlation_p(spark, pairs, p):
    got = aggregate.pearson(spark.createDataFrame(pairs, "x int, y int"), "x", "y").first().p
    assert got == p or (got is not None and p is not None and got == pytest.approx(p, abs=1e-6))


def test_published_dose_response(spark):
    df = spark.createDataFrame([("w", *r) for r in WATERSHEDS], "g string, x double, y double, pop int")
    fit = doseresponse.powerlaw_posterior(df, ["g"], "x", "y", "pop", [0.5, 0.05, 0.95], ["m", "lo", "hi"]).first()
    # published: 3.0 (1.8 to 4.8)
    assert fit.m == pytest.approx(3.0, abs=0.15) and fit.lo == pytest.approx(1.8, abs=0.15) and fit.hi == pytest.approx(4.8, abs=0.25)


def test_fit_with_zero_indicator_has_no_negative_exponents(spark):
    df = spark.createDataFrame([("g", 0.0, 1.0, 60.0), ("g", 0.5, 2.0, 80.0), ("g", 0.9, 4.0, 90.0)], "g string, x double, y double, pop double")
    sums = doseresponse.powerlaw_sums(df, ["g"], "x", "y", "pop")
    assert sums.agg(F.min("beta")).first()[0] >= 0
    assert doseresponse.powerlaw_posterior(df, ["g"], "x", "y", "pop").first().p50 > 0


def test_fit_refuses_missing_input(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(Exception, match="missing value"):
        doseresponse.require_known(df, ["x"]).collect()


def test_published_top_towns(spark):
    towns = [("Fitchburg", 40419.0, 22720.0, 51), ("Pittsfield", 44226.0, 26913.0, 47), ("Small", 900.0, 10000.0, 9), ("Empty", 50000.0, 1.0, 0)]
    census = spark.createDataFrame([t[:3] for t in towns], "town string, population double, income double")
    actions = spark.createDataFrame([([t[0]], 100.0) for t in towns for _ in range(t[3])] or [], "municipality array<string>, fine double")
    summary = enforcement.town_summary(actions, census)
    top = [(r.town, r.actions_per_100k) for r in enforcement.top_towns(summary, "actions_per_100k").collect()]
    assert [t[0] for t in top] == ["Fitchburg", "Pittsfield", "Empty"]
    assert top[0][1] == pytest.approx(126.17828249090773) and top[1][1] == pytest.approx(106.2723284945507) and top[2][1] == 0.0


def test_published_state_population(spark, rows):
    decade = spark.createDataFrame([("Alabama", "4,452,173", "4,467,634"), (None, "1", "2")], "state string, `2000` string, `2001` string")
    recent = spark.createDataFrame([("Alabama", "4,785,437"), ("Guam", "1")], "state string, `2010` string")
    assert rows(budget.state_population(decade, recent, ["2000", "2001"], ["2010"])) == [
        ("Alabama", 2000, 4452173.0), ("Alabama", 2001, 4467634.0), ("Alabama", 2010, 4785437.0)
    ]


def test_totals_are_conserved_and_means_stay_inside(spark):
    rng = np.random.default_rng(1)
    sources = spark.createDataFrame([(i, int(rng.integers(0, 20)), float(rng.random()), 1.0) for i in range(300)], "outfall int, area int, volume double, n double")
    areas = spark.createDataFrame([(a, f"t{a % 4}", float(rng.integers(0, 90)), float(rng.random())) for a in range(25)], "area int, town string, pop double, ind double")
    by_area, by_town = discharge.discharge_by_area(sources), discharge.discharge_by(sources, areas, "town")
    total = sources.agg(F.sum("volume")).first()[0]
    assert by_area.agg(F.sum("volume")).first()[0] == pytest.approx(total)
    assert by_town.agg(F.sum("volume")).first()[0] == pytest.approx(total)
    ranges = {r.town: (r.lo, r.hi) for r in areas.groupBy("town").agg(F.min("ind").alias("lo"), F.max("ind").alias("hi")).collect()}
    for r in discharge.demographics_by(areas, "town", ["ind"]).collect():
        assert ranges[r.town][0] <= r.ind <= ranges[r.town][1]


def test_level_table_fill(spark):
    sources = spark.createDataFrame([(1, 1, 2.0, 1.0)], "outfall int, area int, volume double, n double")
    areas = spark.createDataFrame([(1, "a", 60.0, 0.1), (2, "b", 70.0, 0.2)], "area int, town string, pop double, ind double")
    filled = {r.town: r.volume for r in discharge.level_table(sources, areas, "town", ["ind"]).collect()}
    kept = {r.area: r.volume for r in discharge.level_table(sources, areas, "area", ["ind"], fill=None).collect()}
    assert filled == {"a": 2.0, "b": 0.0} and kept == {1: 2.0, 2: None}


def test_quality_counts_are_kept_only_when_all_pass(spark, tmp_path):
    t = spark.range(5).toDF("id")
    none = spark.createDataFrame([], "dataset string, rows long")
    good = quality.check_datasets({"t": t}, {"t": ["id"]}, {}, none)
    assert quality.accept(good, str(tmp_path / "stats"))
    previous = spark.read.parquet(str(tmp_path / "stats"))
    assert [(r.dataset, r.rows) for r in previous.collect()] == [("t", 5)]
    shrunk = quality.check_datasets({"t": t.limit(4), "gone": None}, {"t": ["id"]}, {}, previous)
    assert not quality.accept(shrunk, str(tmp_path / "other")) and not (tmp_path / "other").exists()
    state = {r.dataset: (r.readable, r.growth_ok, r.ok) for r in shrunk.collect()}
    assert state == {"t": (True, False, False), "gone": (False, False, False)}
    assert quality.load_or_none(spark, str(tmp_path / "nothing")) is None
