"""The refresh job from landed files to tables."""

import pytest
from pyspark.sql import functions as F

from regdata.plans import refresh
from regdata.schemas import DDL, schema_of
from regdata.sources import sinks


def land(tmp_path, payroll_years):
    (tmp_path / "wages.csv").write_text("Year,AWI,Increase,Prior year average amount,Average amount,Number of workers,Aggregate wages\n"
                                        '2014,46481.52,3.55%,"43,041.39",44569.20,158186,7050259\n2015,48098.63,3.48%,44569.20,46119.78,160000,7300000\n')
    lines = [f'"Unit, A",{y},Ann,Doe,{1000 + y}' for y in payroll_years]
    (tmp_path / "payroll.csv").write_text("department_division,year,name_first,name_last,pay_total_actual\n" + "\n".join(lines) + "\n")
    return {"wage_index": str(tmp_path / "wages.csv"), "payroll": str(tmp_path / "payroll.csv")}


def test_refresh_publishes_only_good_runs(spark, tmp_path):
    root = str(tmp_path / "published")
    spark.sql("drop database if exists regdata_refresh cascade")
    try:
        checks = refresh.refresh(spark, land(tmp_path, [2015, 2016, 2017]), root, database="regdata_refresh")
        assert all(r.ok for r in checks.collect())
        wages = spark.table("regdata_refresh.wage_index").orderBy("Year").collect()
        assert [(r.Year, r.AWI, r.Number_of_workers) for r in wages] == [
            (2014, 46481.52, 158186), (2015, 48098.63, 160000), (2016, 48098.63, 0), (2017, 48098.63, 0)
        ]
        tables = sinks.published(spark, root)
        assert set(tables) == {"wage_index", "payroll", "metadata", "last_updated", "accepted_counts"}
        assert [r.pay_total_actual for r in tables["payroll"].orderBy("year").collect()] == [3015.0, 3016.0, 3017.0]
        assert {r.dataset: r.rows for r in tables["accepted_counts"].collect()} == {"wage_index": 2, "payroll": 3}

        checks = refresh.refresh(spark, land(tmp_path, [2015]), root)  # fewer rows than before
        assert {r.dataset: r.ok for r in checks.collect()} == {"wage_index": True, "payroll": False}
        assert sinks.published(spark, root)["payroll"].count() == 3

        checks = refresh.refresh(spark, land(tmp_path, [2015, 2016, 2017, 2018]), root)
        assert all(r.ok for r in checks.collect()) and sinks.published(spark, root)["payroll"].count() == 4

        paths = {**land(tmp_path, [2015, 2016, 2017, 2018]), "permit": str(tmp_path / "nothing.csv")}
        checks = refresh.refresh(spark, paths, root)
        assert {r.dataset: r.readable for r in checks.collect()}["permit"] is False
    finally:
        spark.sql("drop database if exists regdata_refresh cascade")


def test_a_failure_between_tables_leaves_the_old_set(spark, tmp_path):
    root = str(tmp_path / "set")
    assert sinks.published(spark, root) == {}
    first = sinks.publish(spark, {"a": spark.range(3), "b": spark.range(4)}, root)
    broken = spark.range(2).select(F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(spark, {"a": spark.range(30), "b": broken}, root)
    assert {n: t.count() for n, t in sinks.published(spark, root).items()} == {"a": 3, "b": 4}
    sinks.publish(spark, {"a": spark.range(5)}, root)
    assert {n: t.count() for n, t in sinks.published(spark, root).items()} == {"a": 5}
    assert {n: t.count() for n, t in sinks.published(spark, root, first).items()} == {"a": 3, "b": 4}


def test_schemas_are_typed(spark):
    assert {f.name: f.dataType.typeName() for f in schema_of("block_group")}["ID"] == "string"
    assert all(len(schema_of(name)) > 2 for name in DDL)
