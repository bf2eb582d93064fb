"""The resampling laws against plain resampling, and against their own definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regdata.operators import resample


def plain_medians(values, reps, rng, with_nulls=False):
    draws = rng.choice(values, (reps, len(values)))
    return np.nanmedian(draws, axis=1) if with_nulls else np.median(draws, axis=1)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 25, 200])
def test_median_replicates_have_the_bootstrap_law(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.exponential(100, n), 2)
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = np.array([r.stat for r in resample.median_replicates(df, ["g"], "v", 4000, 1).collect()])
    want = plain_medians(values, 40000, rng)
    assert len(got) == 4000 and not np.isnan(got).any()
    probs = [5, 25, 50, 75, 95]
    # a percentile of the replicates may miss by the error of 4,000 draws: look up the ranks instead
    for p in probs:
        q = np.percentile(want, p)
        below, upto = np.mean(got < q - 1e-9), np.mean(got <= q + 1e-9)
        assert below - 0.03 <= np.mean(want < q - 1e-9) <= below + 0.03
        assert upto - 0.03 <= np.mean(want <= q + 1e-9) <= upto + 0.03


def test_median_with_missing_rows(spark):
    rng = np.random.default_rng(0)
    values = np.where(rng.random(60) < 0.4, np.nan, rng.normal(50, 10, 60))
    df = spark.createDataFrame([("g", None if np.isnan(v) else float(v)) for v in values], "g string, v double")
    ci = resample.bootstrap_ci(df, ["g"], "v", "median", 4000, [0.05, 0.5, 0.95], ["a", "b", "c"], 3).first()
    want = np.percentile(plain_medians(values, 40000, rng, with_nulls=True), [5, 50, 95])
    assert np.allclose([ci.a, ci.b, ci.c], want, atol=0.8)


def test_interval_contains_the_statistic_and_repeats(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), (F.col("id") * 1.5).alias("v"))
    one = resample.bootstrap_ci(df, ["g"], "v", "median", 300, seed=5, drop_null_first=True).first()
    assert one.p05 <= 374.25 <= one.p95
    assert one == resample.bootstrap_ci(df.repartition(7), ["g"], "v", "median", 300, seed=5, drop_null_first=True).first()
    assert one != resample.bootstrap_ci(df, ["g"], "v", "median", 300, seed=6, drop_null_first=True).first()


def test_share_has_the_binomial_law(spark):
    df = spark.range(80).select(F.lit("g").alias("g"), (F.col("id") < 20).alias("hit"))
    stats = [r.stat for r in resample.share_replicates(df, ["g"], F.col("hit"), 4000, 2).collect()]
    assert abs(np.mean(stats) - 0.25) < 0.005
    assert abs(np.std(stats) - np.sqrt(0.25 * 0.75 / 80)) < 0.003


@pytest.mark.parametrize("method", ["draws", "poisson"])
def test_weighted_mean_resampling(spark, method):
    rng = np.random.default_rng(4)
    x, w = rng.normal(10, 3, 120), rng.uniform(1, 5, 120)
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, w))], "g string, k long, x double, w double")
    df = df.unionByName(spark.createDataFrame([("g", 900, None, 1.0), ("g", 901, 1.0, None)], df.schema))
    out = resample.wmean_bootstrap(df, ["g"], "x", "w", "k", 2000, 1, method).first()
    picks = rng.integers(0, 120, (20000, 120))
    want = (x[picks] * w[picks]).sum(1) / w[picks].sum(1)
    assert abs(out.mean - want.mean()) < 0.03
    assert abs(out.sd - want.std()) < 0.03
    assert out.low == pytest.approx(out.mean - 1.65 * out.sd)


def test_numbers_are_even_and_all_used():
    u = resample.uniform(123, 456, np.arange(200_000))
    assert abs(u.mean() - 0.5) < 0.003 and abs(u.var() - 1 / 12) < 0.002 and 0 < u.min() and u.max() < 1
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.01 and len(np.unique(u)) == len(u)
    assert abs(np.corrcoef(u, resample.uniform(124, 456, np.arange(200_000)))[0, 1]) < 0.01
    h = np.arange(1 << 16)
    assert len(np.unique(resample.scrambled(h))) == len(h)


def test_poisson_counts_have_mean_and_variance_one():
    counts = resample.poisson_counts(resample.uniform(3, 4, np.arange(400_000)))
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.02
    assert resample.poisson_counts(np.array([0.3, 0.5, 1 - 1e-12, 1 - 2.0**-53])).tolist()[:2] == [0, 1]
    assert resample.poisson_counts(np.array([1 - 1e-12]))[0] > 12


def test_draws_reach_all_of_a_huge_group():
    """Places among 2**34 rows fall evenly, past the 31 bits of either key."""
    n = 1 << 34
    u = resample.uniform(5, 6, np.arange(100_000))
    rows = np.minimum(np.floor(u * n), n - 1)
    assert rows.max() > 0.9999 * n and abs((rows > 2**31).mean() - 7 / 8) < 0.005


@pytest.mark.parametrize("piece, fan", [(4096, 1024), (8, 1024), (4, 3)])
def test_split_draws_are_multinomial(spark, piece, fan):
    """Counts add up to n in every replicate, with the mean and variance of the law, whatever the levels."""
    sizes = spark.createDataFrame([("a", 100), ("b", 37), ("c", 1)], "g string, _n long")
    found = {}
    for r in resample.split_draws(sizes, ["g"], 3000, 4, piece, fan).collect():
        found.setdefault((r.g, r.rep), {})[r["_piece"]] = r["_m"]
    for g, n in (("a", 100), ("b", 37), ("c", 1)):
        pieces = -(-n // piece)
        table = np.array([[found[g, k].get(p, 0) for p in range(pieces)] for k in range(3000)])
        assert (table.sum(axis=1) == n).all() and all(max(found[g, k]) < pieces for k in range(3000))
        share = np.minimum(piece, n - piece * np.arange(pieces)) / n
        assert np.abs(table.mean(axis=0) - n * share).max() < 0.25
        assert pieces == 1 or np.abs(table.var(axis=0) / (n * share * (1 - share)) - 1).max() < 0.15


@pytest.mark.parametrize("method", ["draws", "poisson"])
def test_groups_and_keys_have_draws_of_their_own(spark, method):
    """Equal rows in two groups, and keys beyond 31 bits."""
    rows = spark.range(60).select((F.col("id") + (1 << 40)).alias("id"), (F.col("id") * 1.5).alias("x"), F.lit(1.0).alias("w"))
    both = rows.withColumn("g", F.lit("a")).unionByName(rows.select((F.col("id") + resample.MASK).alias("id"), "x", "w", F.lit("b").alias("g")))
    found = {(r.g, r.rep): r.stat for r in resample.wmean_replicates(both, ["g"], "x", "w", "id", 50, 3, method, piece=16).collect()}
    assert len(found) == 100 and sum(found["a", k] == found["b", k] for k in range(50)) < 5
    again = {(r.g, r.rep): r.stat for r in resample.wmean_replicates(both.repartition(5), ["g"], "x", "w", "id", 50, 3, method, piece=16).collect()}
    assert all(again[k] == pytest.approx(v, rel=1e-12) for k, v in found.items())


def test_pieces_do_not_change_the_law(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(10, 3, 120), rng.uniform(1, 5, 120)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, w))], "k long, x double, w double")
    picks = rng.integers(0, 120, (20000, 120))
    want = (x[picks] * w[picks]).sum(1) / w[picks].sum(1)
    for piece in (7, 50):
        stats = np.array([r.stat for r in resample.wmean_replicates(df, [], "x", "w", "k", 2000, 1, piece=piece).collect()])
        assert len(stats) == 2000 and abs(stats.mean() - want.mean()) < 0.03 and abs(stats.std() - want.std()) < 0.03


def test_beta_and_binomial_draws_have_their_laws():
    rng = np.random.default_rng(1)
    a, b = np.full(40_000, 3), np.full(40_000, 7)
    got = resample.beta(a, b, 11, 12, np.arange(40_000) * resample.TRIES)
    assert np.abs(np.quantile(got, [0.05, 0.5, 0.95]) - np.quantile(rng.beta(3, 7, 200_000), [0.05, 0.5, 0.95])).max() < 0.01
    u = resample.uniform(7, 8, np.arange(40_000))
    for n, k in ((10, 3), (5000, 1), (10**9, 4 * 10**8)):
        hits = resample.binomial(n, k, u)
        assert abs(hits.mean() - k) < 0.03 * np.sqrt(k * (1 - k / n)) + 1e-9 and abs(hits.std() / np.sqrt(k * (1 - k / n)) - 1) < 0.02
    assert resample.binomial(5, 0, u[:3]).tolist() == [0, 0, 0] and resample.binomial(5, 5, u[:3]).tolist() == [5, 5, 5]


def test_one_hot_value_and_global_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 5.0).otherwise(F.col("id")).alias("v"))
    got = resample.median_replicates(df, [], "v", 50, 1).select("stat").distinct().collect()
    assert [r.stat for r in got] == [5.0]
