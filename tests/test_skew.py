"""Ranks, sums, joins and quantiles on groups where one key holds most rows, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regdata.operators import ordered, quantile, relate, series, skew


@pytest.fixture(scope="module")
def hot():
    """2,000 rows: one key has half, one value within it a third of these; some nulls."""
    rng = np.random.default_rng(3)
    n = 2000
    key = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcdefgh"), n))
    value = np.where(rng.random(n) < 0.35, 250.0, np.round(rng.exponential(500, n), 1))
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "v": value, "year": rng.integers(2000, 2006, n)})
    pdf.loc[pdf.id % 17 == 0, "v"] = np.nan
    return pdf


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_rank_by_value(spark, hot):
    got = series.rank_by_value(frame(spark, hot), ["k"], "v", "id").toPandas().set_index("id")["rank"]
    want = hot.dropna().sort_values(["k", "v", "id"], ascending=[True, False, True])
    want = want.assign(rank=want.groupby("k").cumcount()).set_index("id")["rank"]
    assert got.sort_index().tolist() == want.sort_index().tolist()


def test_seniority_counts_each_earlier_year(spark, hot):
    got = series.seniority(frame(spark, hot), "k", "year", "id").toPandas()
    for _, g in got.groupby("k"):
        assert sorted(g.seniority) == list(range(len(g)))
        g = g.sort_values("seniority")
        assert g.year.is_monotonic_increasing


def test_ranked_values_are_padded(spark, hot):
    got = series.ranked_values(frame(spark, hot).withColumnRenamed("k", "g"), "g", "v", "id").toDF("k", "rank", "value").toPandas()
    longest = hot.dropna().groupby("k").size().max()
    for k, g in got.groupby("k"):
        values = hot[(hot.k == k)].v.dropna().sort_values(ascending=False).tolist()
        assert g.sort_values("rank").value.tolist() == values + [0.0] * (longest - len(values))


@pytest.mark.parametrize("pieces", [1, 2, 7, 200])
def test_quantiles_match_numpy(spark, hot, pieces):
    df = frame(spark, hot)
    ranks = quantile.value_ranks(df, ["k"], "v", pieces).toPandas()
    for k, g in ranks.groupby("k"):
        values = np.sort(hot[hot.k == k].v.dropna())
        rebuilt = np.repeat(g.sort_values("start").value, (g.end - g.start).loc[g.sort_values("start").index])
        assert np.array_equal(values, rebuilt)


def test_quantile_interpolation(spark, hot):
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = quantile.quantiles(frame(spark, hot), ["k"], "v", probs, list("abcde")).toPandas().set_index("k")
    for k, g in hot.groupby("k"):
        assert np.allclose(got.loc[k, list("abcde")].astype(float), np.nanpercentile(g.v, [100 * p for p in probs]))


def test_selection_on_awkward_values(spark):
    """Huge, tiny, tied, narrow, negative and single values; missing ones do not count."""
    rng = np.random.default_rng(0)
    values = {
        "normal": rng.normal(size=1000), "ties": np.r_[np.zeros(500), rng.normal(size=3) * 1e300], "one": np.array([5.0]), "narrow": 1e9 + rng.random(2000) * 1e-3,
        "tiny": rng.exponential(1e-9, 777), "few": np.array([-1.5, -1.5, 2.0]), "ends": np.array([-1.7e308, 1.7e308, 0.0]), "none": np.array([np.nan]),
    }
    df = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v] + [("few", None)], "g string, v double")
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    found = {r.g: r for r in quantile.selected(df, ["g"], "v", probs).collect()}
    assert set(found) == set(values) - {"none"}
    for g, r in found.items():
        v = np.sort(values[g])
        places = np.array(probs) * (len(v) - 1)
        assert (r.n, r.low, r.high) == (len(v), v[np.floor(places).astype(int)].tolist(), v[np.ceil(places).astype(int)].tolist())
    assert quantile.quantiles(df.limit(0), [], "v", [0.5]).collect()[0].q50 is None
    assert quantile.quantiles(df.where("g = 'few'"), [], "v", [0.5]).collect()[0].q50 == -1.5


def test_positions_over_ranges(spark, hot):
    """Groups spread over several ranges, with and without keys, nulls as a group of their own."""
    df = frame(spark, hot).withColumn("k", F.when(F.col("k") != "a", F.col("k"))).repartition(5)
    for by in (["k"], []):
        got = ordered.positions(df, by, [F.desc("year"), "id"], "at").toPandas()
        got["k"] = got.k.fillna("-")
        want = got.sort_values([*by, "year", "id"], ascending=[True] * len(by) + [False, True])
        assert want["at"].tolist() == (want.groupby("k").cumcount() if by else pd.Series(range(len(want)))).tolist()
    assert ordered.positions(df.limit(0), ["k"], ["id"]).count() == 0


def test_quantile_bins_leave_out_the_minimum(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)] + [(None,)], "x double")
    got = {r.x: r.bin for r in quantile.quantile_bin(df, "x", 4).collect()}
    want = pd.cut(pd.Series(range(9)), np.percentile(range(9), [0, 25, 50, 75, 100]), labels=False)
    assert got[0.0] is None and got[None] is None
    assert [got[float(i)] for i in range(1, 9)] == want[1:].astype(int).tolist()
    assert quantile.quantile_bin(df, "x", 4, include_lowest=True).where("x = 0").first().bin == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(200.0,), (399.99,), (400.0,), (2e7,), (5e7,), (50.0,), (None,)], "v double")
    edges = quantile.doubling_edges()
    assert edges[:8] == [200, 400, 800, 2000, 3000, 6000, 10000, 30000] and edges[-1] == 50000000 and len(edges) == 19
    counts = [r.n for r in quantile.histogram(df, "v", edges).orderBy("bin").collect()]
    assert counts == np.histogram([200.0, 399.99, 400.0, 2e7, 5e7, 50.0], edges)[0].tolist()


def test_prefix_sums_and_fill_forward_over_pieces(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"f": np.repeat(["x", "y"], 300), "pos": np.tile(np.arange(300), 2), "v": rng.integers(0, 5, 600)})
    pdf["piece"] = pdf.pos // 37
    pdf["t"] = [f"t{i}" if u < 0.02 else None for i, u in enumerate(rng.random(600))]
    df = spark.createDataFrame(pdf.astype({"t": object}))
    sums = ordered.prefix_sums(df, ["f"], ["piece"], ["pos"], {"s": "v"}).toPandas().sort_values(["f", "pos"])
    assert sums.s.tolist() == pdf.groupby("f").v.cumsum().tolist()
    filled = ordered.fill_forward(df, ["f"], ["piece"], ["pos"], ["t"]).toPandas().sort_values(["f", "pos"])
    want = pdf.groupby("f").t.ffill()
    assert [a if isinstance(a, str) else None for a in filled.t] == [b if isinstance(b, str) else None for b in want]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_plain_join(spark, hot, how):
    left = frame(spark, hot)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3)], "k string, w int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = skew.skew_join(left, right, ["k"], how)
        got = sorted(map(tuple, salted.select("id", "k", "w").collect()), key=repr)
        assert skew.hot_keys(left, ["k"], 0.3).collect()[0].k == "hot"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = sorted(map(tuple, left.join(right, "k", how).select("id", "k", "w").collect()), key=repr)
    assert got == want


def test_member_totals_count_full_value_once(spark, rows):
    df = spark.createDataFrame([(["A", "B", "A"], 10.0), (["A"], None), ([], 5.0), (None, 5.0)], "m array<string>, fine double")
    gaz = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    assert rows(relate.member_totals(df, "m", gaz, "name", "fine"), "name", "n", "fine") == [("A", 2, 10.0), ("B", 1, 10.0), ("C", 0, 0.0)]
