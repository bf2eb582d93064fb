"""Missing-value rules and column expressions on edge cases."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from regdata.functions import clean, nulls, text
from regdata.operators import aggregate, relate, series
from regdata.vocab import JOB_CLASSES, LAW_TERMS


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr.alias("v")).first().v


def test_null_keys_form_no_group_and_empty_sum_is_zero(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), (None, 5.0)], "k string, v double")
    assert rows(aggregate.sum_by(df, ["k"], ["v"])) == [("a", 0.0), ("b", 1.0)]
    assert rows(aggregate.count_rows(df, ["k"])) == [("a", 2), ("b", 1)]
    assert rows(aggregate.sum_by(df.limit(0), ["k"], ["v"])) == []


def test_nan_becomes_null_at_the_scan(spark, rows):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, i int")
    assert rows(nulls.nans_to_nulls(df)) == [(2.0, 2), (None, 1)]


def test_outer_join_matches_missing_keys(spark, rows):
    a = spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20), ("z", 30)], "k2 string, b int")
    out = relate.full_outer_coalesced(a, b, [("k", "k2")])
    assert rows(out, "k", "a", "b") == sorted([("x", 1, 10), (None, 2, 20), ("y", 3, None), ("z", None, 30)], key=repr)


def test_outer_join_splits_hot_keys(spark, monkeypatch):
    """Hot on one side, on both, alone on a side, and missing keys: the same rows as a plain full join."""
    def table(name, sizes):
        rows = [(k, f"{name}{i}") for k, n in sizes.items() for i in range(n)]
        return spark.createDataFrame(rows, f"{'k' if name == 'a' else 'k2'} string, {name} string")

    a = table("a", {"x": 60, None: 40, "left": 50, "few": 2, "one": 1})
    b = table("b", {"x": 30, None: 2, "right": 45, "few": 40, "two": 1})
    want = sorted((tuple(r) for r in a.join(b, a.k.eqNullSafe(b.k2), "full").selectExpr("coalesce(k, k2)", "a", "b").collect()), key=repr)
    monkeypatch.setattr(relate, "HOT_ROWS", 7)
    out = relate.full_outer_coalesced(a, b, [("k", "k2")])
    assert out.columns == ["k", "a", "b"] and sorted((tuple(r) for r in out.collect()), key=repr) == want


def test_references_of_all_kinds(spark):
    assert one(spark, text.decode_references("t"), t="a&amp;lt; &#8212;&#x1F600; &#0; &bogus; &lt;b&gt; & &#xD800; &#169") == "a&lt; \u2014\U0001f600 &#0; &bogus; <b> & &#xD800; \u00a9"
    assert one(spark, text.decode_references("t"), t="plain") == "plain"


def test_cells_as_a_parser_reads_them(spark):
    from regdata.operators import markup

    html = (
        "</table></tr><table><tr><th>A<th>B<tr><td>1<td>N1 <table><tr><th>X</th></tr><tr><td>deep</td></table> after<tr><td>2</td>junk<td>N2</td></tr>"
        "<td>3<td>N3</table><p>between</p><script>var t = '<table><tr><td>no';</script><table><TR><TH>C</TH></TR><TR><TD>z</table>"
    )
    df = spark.createDataFrame([(1, html), (2, None), (3, "no table <td>x</td>")], "id int, html string")
    rows = sorted((r.table_no, r.row_no, r.cells) for r in markup.table_rows(df, ["id"], "html").collect())
    assert rows == [(0, 1, {"A": "1", "B": "N1  after"}), (0, 2, {"A": "2", "B": "N2"}), (0, 3, {"A": "3", "B": "N3"}), (1, 1, {"X": "deep"}), (2, 1, {"C": "z"})]
    assert markup.malformed_rows(df, ["id"], "html").first().rows == 5


def test_division_by_zero_is_null(spark):
    assert one(spark, clean.rate("a", "b", 100), a=1.0, b=0.0) is None
    df = spark.createDataFrame([("g", 1.0, 0.0)], "k string, x double, w double")
    assert aggregate.weighted_mean(df, ["k"], ["x"], "w").first().x is None


def test_weighted_mean_policies(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", None, 3.0)], "k string, x double, w double")
    assert aggregate.weighted_mean(df, ["k"], ["x"], "w").first().x == 0.25
    assert aggregate.weighted_mean(df, ["k"], ["x"], "w", "strict").first().x == 1.0


def test_strict_lookup_fails_on_unknown_key(spark):
    df = spark.createDataFrame([(1,), (2,)], "year int")
    known = spark.createDataFrame([(1, 2.0)], "year int, v double")
    assert relate.strict_lookup(df.where("year = 1"), known, ["year"], "v").first().v == 2.0
    with pytest.raises(PySparkException, match="no row for 2"):
        relate.strict_lookup(df, known, ["year"], "v").collect()


def test_lookup_duplicates_do_not_multiply(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", 1.0), (None, None)], "k string, lat double")
    ref = spark.createDataFrame([("a", 5.0), ("a", 5.0), (None, 9.0)], "k string, l double")
    assert rows(relate.lookup_fill(df, ref, "k", {"lat": "l"}), "k", "lat") == sorted([("a", 5.0), ("b", 1.0), (None, None)], key=repr)


def test_date_range_end_is_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2022, 12, 31, 0, 0),), (dt.datetime(2022, 12, 31, 7, 0),)], "t timestamp_ntz")
    start, end = dt.date(2022, 6, 1), dt.date(2022, 12, 31)
    assert df.where(clean.date_between("t", start, end)).count() == 1
    assert df.where(clean.date_between("t", start, end, end_inclusive_day=True)).count() == 2


@pytest.mark.parametrize("given, plain, compat", [
    ("a $1,250 Penalty", 1250.0, 1250.0),
    ("a $3 million Penalty", 3e6, 3e6),
    ("a $2.25 million Penalty", 2.25e6, 2.25),
    ("$5,000 now and $1 million later", 5000.0, 5000.0),
    ("$12,500.50 due", 12500.5, 12500.5),
    ("no amount", None, None),
])
def test_money(spark, given, plain, compat):
    assert one(spark, text.extract_money("t"), t=given) == plain
    assert one(spark, text.extract_money("t", compat=True), t=given) == compat


def test_flags_lower_case_their_terms(spark):
    df = spark.createDataFrame([("under the National Pollution Discharge Elimination System",)], "t string")
    flags = {"law_npdes": LAW_TERMS["npdes"]}
    assert text.keyword_flags(df, "t", flags).first().law_npdes is True
    assert text.keyword_flags(df, "t", flags, compat=True).first().law_npdes is False


@pytest.mark.parametrize("title, job_class, level", [
    ("Environmental Analyst IV", "Environmental Analyst", "IV"),
    ("Dir of Planners", "Regional Planner", "NONE"),
    ("SENIOR CLERK VI", "Clerk", "VI"),
    ("Driver", "OTHER", "NONE"),
])
def test_job_class_and_level(spark, title, job_class, level):
    assert one(spark, text.classify("t", JOB_CLASSES, "OTHER"), t=title) == job_class
    assert one(spark, text.roman_level("t"), t=title) == level


def test_names_and_places(spark):
    assert tuple(one(spark, clean.split_name("t"), t="Doe, Jane Q.")) == ("Jane", "Q", "Doe")
    assert tuple(one(spark, clean.split_name("t"), t="Doe, Jane")) == ("Jane", None, "Doe")
    assert tuple(one(spark, clean.city_and_watershed("t"), t="Salem (North Coastal)")) == ("Salem", "North Coastal")
    assert tuple(one(spark, clean.city_and_watershed("t"), t="Salem")) == ("Salem", None)
    assert one(spark, clean.municipality_name("t"), t="Amherst town, Hampshire County") == "Amherst"
    assert tuple(one(spark, clean.comment_period("t"), t="1/2/17 - 2/3/17 (Extended to 3/4/17)")) == ("1/2/17", "2/3/17", "3/4/17")
    assert one(spark, clean.budget_label("t"), t="Env. Agency\nBudget ") == "Environmental Agency Budget"
    assert one(spark, text.to_ascii("t"), t="Café Łódź €") == "Cafe Lodz EUR"
    assert one(spark, text.extract_money(text.to_ascii("t")), t="Joe’s Shop of Salem – $2\u00a0million ½") == 2_000_000


def test_proper_nouns_are_whole_runs(spark):
    found = one(spark, text.proper_nouns("t"), t="Revere Copper Products of New Bedford and Salem")
    assert found == ["Revere Copper Products", "New Bedford", "Salem"]


def test_fiscal_labels(spark, rows):
    # label, year, proposal flag and cleaned number of published budget rows
    given = [("FY24 Sen", "155,162,329", 2024, 0, 155162329.0), ("FY23 Current", "655,230,777", 2023, 0, 655230777.0),
             ("FY09", "128,306,719", 2009, 0, 128306719.0), ("FY01", "172,447,690", 2001, 0, 172447690.0)]
    df = spark.createDataFrame([g[:2] for g in given], "label string, n string")
    out = df.select("label", "n", clean.fiscal_year("label"), clean.governor_flag("label"), clean.clean_number("n"))
    assert rows(out) == sorted(given, key=repr)
    assert one(spark, clean.report_year("t"), t="FY 2010-2011") == 2011


def test_vintages(spark, rows):
    old = spark.createDataFrame([("MA", 1.0), ("NH", 2.0)], "s string, v double")
    new = spark.createDataFrame([("MA", 9.0), ("NH", None)], "s string, v double")
    assert rows(relate.merge_vintages([old, new], ["s"], "v")) == [("MA", 9.0), ("NH", 2.0)]
    assert rows(relate.merge_vintages([old, new], ["s"], "v", "earlier")) == [("MA", 1.0), ("NH", 2.0)]


def test_carry_forward_and_single_rows(spark, rows):
    w = spark.createDataFrame([(2020, 5.0, 3), (2021, 6.0, 4)], "year int, awi double, g int")
    assert rows(series.extend_yearly(w, "year", 2023, ["awi"], ["g"])) == [
        (2020, 5.0, 3), (2021, 6.0, 4), (2022, 6.0, 0), (2023, 6.0, 0)
    ]
    assert series.extend_yearly(w, "year", 2021, ["awi"], ["g"]).count() == 2


def test_index_base_missing_gives_null(spark, rows):
    df = spark.createDataFrame([("a", 2001, 4), ("b", 2000, 2), ("b", 2001, 3)], "k string, year int, n int")
    years = df.select("year")
    out = series.index_to_first(df, "k", "year", "n", years, ["a", "b"])
    assert rows(out, "k", "year", "idx") == [("a", 2000, None), ("a", 2001, None), ("b", 2000, 100.0), ("b", 2001, 150.0)]


def test_corrections(spark, rows):
    df = spark.createDataFrame([("a $9.250 fine",), ("other",), (None,)], "t string")
    out = relate.corrections(df, "t", {"a $9.250 fine": "a $9,250 fine"})
    assert rows(out) == sorted([("a $9,250 fine",), ("other",), (None,)], key=repr)


def test_expression_rates(spark):
    # published rate: 51 actions among 40,419 people
    assert abs(one(spark, clean.rate("n", "p", 1e5), n=51.0, p=40419.0) - 126.17828249090773) < 1e-12
    assert one(spark, clean.one_significant_digit("v"), v=819200.0) == 800000.0
    assert F.lit(1) is not None


def test_spine_takes_any_number_of_categories(spark):
    cats = spark.range(20_001).select(F.concat(F.lit("c"), "id").alias("c"))
    spine = relate.spine_of(spark.range(2).withColumnRenamed("id", "k"), {"c": relate.distinct_values(cats, "c")})
    assert spine.count() == 40_002 and spine.where("c is null").count() == 0


def test_links_references_and_headers(spark):
    html = """<a href='x.pdf?a=1&amp;b'>x</a><A HREF=y.pdf>y</A> nohref="no" <a class="k" href = "z">"""
    assert one(spark, text.links("t"), t=html) == ["x.pdf?a=1&b", "y.pdf", "z"]
    assert one(spark, text.facility_label("t"), t="<a>opens in new window.'>Mill &amp; Co (PDF 1)</a>\nrest") == "Mill & Co"
    assert one(spark, text.to_ascii("t"), t="Москва Щука Ёлка Αθήνα Ψυχή ﬁx ½ Ǆ Ệ") == "Moskva Shchuka Elka Athena Psukhe x  1/2 DZ E"
    assert one(spark, text.unspelled("t"), t="\u4e2d\u6587 \u2013 \u00e9") == 2
