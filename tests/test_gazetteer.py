"""A gazetteer over texts that Spark does not broadcast."""

import pytest

from regdata.functions import text
from regdata.operators import relate


@pytest.mark.parametrize("most", [relate.NAMES, 1])
def test_texts_are_searched_once(spark, monkeypatch, most):
    """Counts of hot runs and the join searched all texts several times; few and many names agree."""
    monkeypatch.setattr(relate, "NAMES", most)
    docs = spark.createDataFrame([(1, "in Salem, at Café Łódź; Salem"), (2, "Salem"), (3, "none"), (4, None), (5, "New Bedford and Lynn")], "k long, t string")
    docs = docs.select("k", text.to_ascii("t").alias("t"))
    names = spark.createDataFrame([("Salem",), ("Salem",), ("Cafe Lodz",), ("Bedford",), ("New Bedford",), (None,)], "name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = relate.gazetteer_tags(docs, "k", "t", names, "name")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        got = {r.k: r.places for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Generate explode(array_distinct") <= 1
    assert got == {1: ["Cafe Lodz", "Salem"], 2: ["Salem"], 3: [], 4: [], 5: ["New Bedford"]}
