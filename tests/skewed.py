"""A copy of the driver tables in which single keys, values and places hold a third of the rows."""

from __future__ import annotations

import os


def skewed_copy(source: str, target: str) -> str:
    import duckdb

    con = duckdb.connect()
    change = {
        "orders": "* replace (case when o_orderkey % 3 = 0 then 7 else o_custkey end as o_custkey, case when o_orderkey % 3 = 1 then 1000.5 else o_totalprice end as o_totalprice)",
        "lineitem": "* replace (case when l_orderkey % 3 = 0 then 5 else l_partkey end as l_partkey, case when l_orderkey % 3 = 0 then 3 else l_suppkey end as l_suppkey, case when l_orderkey % 3 = 1 then 10.0 else l_quantity end as l_quantity)",
        "customer": "* replace (case when c_custkey % 3 = 0 then 2 else c_nationkey end as c_nationkey)",
        "events": "* replace (case when event_id % 3 = 0 then 1 else user_id end as user_id, case when event_id % 3 = 1 then 50.0 else value end as value)",
        "embeddings": "* replace (case when vec_id % 3 = 0 then list_transform(embedding, lambda v: 0.1::float) else embedding end as embedding)",
        "part": "* replace (case when p_partkey % 3 = 0 then 'red plate' else p_name end as p_name)",
    }
    for file in sorted(os.listdir(source)):
        name = file.removesuffix(".parquet")
        con.execute(f"copy (select {change.get(name, '*')} from read_parquet('{source}/{file}')) to '{target}/{file}' (format parquet)")
    return target
