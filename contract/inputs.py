"""Reading back raw layouts written from the driver tables, and the sinks.

Each query writes a layout below :func:`scratch_dir` as a distributed job, reads it with
the library's reader and must return the table it came from.
"""

from __future__ import annotations

from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contract.base import case, load
from regdata.operators import quality
from regdata.operators.relate import union_all
from regdata.sources import catalog, readers, sinks


@case("csv_round_trip", """
    select p_partkey, p_name || chr(233) || ', "' || p_brand || '"' || chr(10) || p_type as label, p_size, p_retailprice from part
""")
def csv_round_trip(spark, d):
    path = f"{sinks.scratch_dir(spark)}/csv"
    label = F.concat("p_name", F.lit("é, \""), "p_brand", F.lit('"\n'), "p_type")
    sinks.write_csv(load(spark, d, "part").select("p_partkey", label.alias("label"), "p_size", "p_retailprice"), path, compress=True, encoding="ISO-8859-1")
    schema = StructType.fromDDL("p_partkey long, label string, p_size int, p_retailprice double")
    return readers.read_table(spark, path, schema, encoding="ISO-8859-1", multiline=True)


@case("csv_title_rows", "select o_orderkey, o_totalprice as price, o_orderpriority from orders")
def csv_title_rows(spark, d):
    """Title and footnote rows around the numbers are dropped by what they hold."""
    path = f"{sinks.scratch_dir(spark)}/titles"
    o = load(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.format_number("o_totalprice", 2).alias("price"), "o_orderpriority"
    )
    regions = load(spark, d, "region")
    titles = regions.select(F.concat(F.lit("Table of "), "r_name").alias("o_orderkey"), F.lit("Note").alias("price"), F.lit("(2) see note").alias("o_orderpriority"))
    sinks.write_csv(union_all([o, titles]), path)
    schema = StructType.fromDDL("o_orderkey long, price double, o_orderpriority string")
    return readers.read_table(spark, path, schema, numeric=["o_orderkey", "price"])


def _filed(df, key: str, rows: int, line):
    """Groups of about ``rows`` rows by a hash of the key, each with its lines in order of the key: ``file``, ``lines``."""
    files = F.ceil(df.agg(F.count(F.lit(1))).scalar() / rows)
    return df.groupBy(F.pmod(F.xxhash64(key), files).alias("file")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("v")))).alias("lines"))


@case("sectioned_file", """
    select 1 as section, c_custkey as key, c_name as name from customer union all select 2, p_partkey, p_name from part
""")
def sectioned_file(spark, d):
    """Files of title, customers, parts; some hundred rows each, written by many tasks."""
    path = f"{sinks.scratch_dir(spark)}/sections"
    listed = lambda c: F.array_join(F.transform(c, lambda x: x["v"]), "\n")
    customers = _filed(load(spark, d, "customer"), "c_custkey", 200, F.concat_ws(",", "c_custkey", "c_name")).withColumnRenamed("lines", "a")
    parts = _filed(load(spark, d, "part"), "p_partkey", 200, F.concat_ws(",", "p_partkey", "p_name")).withColumnRenamed("lines", "b")
    text = F.concat(
        F.lit("All tables\n\nCustomers\nkey,name\n"), F.coalesce(listed("a"), F.lit("")), F.lit("\n\nParts\nkey,name\n"), F.coalesce(listed("b"), F.lit(""))
    )
    customers.join(parts, "file", "full").select("file", text.alias("value")).repartition("file").write.partitionBy("file").text(path)
    sections = readers.read_sections(spark, path)
    tables = [
        readers.section_rows(sections, s, "key long, name string", skip=2).select(F.lit(s).alias("section"), "key", "name") for s in (1, 2)
    ]
    return union_all(tables)


_REPORT_YEARS = list(range(1995, 2002))  # all years of the orders


@case("block_report", """
    select n_name as unit, 'Environmental Agency Budget' as detail, 'FY' || y as "column", '$' || format('{:,}', cast(round(sum(o_totalprice)) as bigint)) as value
    from (select *, year(o_orderdate) as y from orders) o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, y
    union all select n_name, 'Amount from Federal Government', 'FY' || y, '$' || format('{:,}', count(*))
    from (select *, year(o_orderdate) as y from orders) o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, y
""")
def block_report(spark, d):
    """A report file per region: state blocks separated by empty rows."""
    path = f"{sinks.scratch_dir(spark)}/blocks"
    o = load(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    o = o.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    money = lambda y: F.concat(F.lit("$"), F.format_number(F.round(F.sum(F.when(F.col("y") == y, F.col("o_totalprice")))).cast("long"), 0))
    # a year without orders has an empty cell
    count = lambda y: F.concat(F.lit("$"), F.format_number(F.nullif(F.count(F.when(F.col("y") == y, 1)), F.lit(0)), 0))
    s = o.groupBy("n_regionkey", "n_name").agg(*[money(y).alias(f"m{y}") for y in _REPORT_YEARS], *[count(y).alias(f"c{y}") for y in _REPORT_YEARS])
    names = [f"k{i}" for i in range(len(_REPORT_YEARS) + 1)]
    cells = lambda *c: F.struct(*[(x if not isinstance(x, str) else F.lit(x)).alias(n) for n, x in zip(names, [*c, *[""] * len(names)])])
    rows = F.array(
        cells(""), cells(F.col("n_name")), cells("", *[f"FY{y}" for y in _REPORT_YEARS]),
        cells("Environmental Agency Budget", *[F.coalesce(f"m{y}", F.lit("")) for y in _REPORT_YEARS]),
        cells("Amount from Federal Government", *[F.coalesce(f"c{y}", F.lit("")) for y in _REPORT_YEARS]),
        cells("Footnote", "see", "page", "2"),
    )
    s.repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name").select(F.inline(rows)).write.option("emptyValue", "").csv(path)
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("multiLine", True).csv(path)
    raw = raw.withColumns({
        "file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "seq": F.monotonically_increasing_id(),
    })
    return readers.parse_blocks(raw, names, "file", ["block"], ["seq"]).select("unit", "detail", "column", "value")


@case("geojson_features", """
    select c_name as name, c_custkey::double as x, case when c_nationkey % 5 = 0 then 2 else 1 end as parts, case when c_nationkey % 5 = 0 then 8 else 4 end as points from customer
""")
def geojson_features(spark, d):
    """One document per file, of some hundred features each."""
    path = f"{sinks.scratch_dir(spark)}/geo"
    k = F.col("c_custkey").cast("string")
    ring = F.concat(F.lit("[["), k, F.lit(", 0.0], [1.0, 2.5], [3.0, "), k, F.lit("], ["), k, F.lit(", 0.0]]"))
    many = F.concat(F.lit('{"type": "MultiPolygon", "coordinates": [['), ring, F.lit("], ["), ring, F.lit("]]}"))
    one = F.concat(F.lit('{"type": "Polygon", "coordinates": ['), ring, F.lit("]}"))
    feature = F.concat(
        F.lit('{"type": "Feature", "properties": {"NAME": "'), F.col("c_name"), F.lit('", "AREA": 1.5}, "geometry": '),
        F.when(F.col("c_nationkey") % 5 == 0, many).otherwise(one), F.lit("}"),
    )
    files = _filed(load(spark, d, "customer"), "c_custkey", 200, feature)
    doc = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.transform("lines", lambda x: x["v"]), ",\n"), F.lit("]}"))
    files.select("file", doc.alias("value")).write.partitionBy("file").text(path)
    g = readers.read_geojson(spark, path, "NAME")
    return g.select(
        "name", F.col("rings")[0][0][0]["x"].alias("x"), F.size("rings").alias("parts"), F.size(F.flatten(F.flatten("rings"))).alias("points")
    )


@case("geojson_lines", "select c_name as name, c_custkey::double as x from customer")
def geojson_lines(spark, d):
    path = f"{sinks.scratch_dir(spark)}/geolines"
    k = F.col("c_custkey").cast("string")
    line = F.concat(
        F.lit('{"properties": {"TOWN": "'), F.col("c_name"), F.lit('"}, "geometry": {"type": "Polygon", "coordinates": [[['), k, F.lit(", 0], [1, 1], [2, 0]]]}}"),
    )
    load(spark, d, "customer").select(line.alias("value")).write.text(path)
    return readers.read_geojson(spark, path, "TOWN", by_line=True).select("name", F.col("rings")[0][0][0]["x"].alias("x"))


@case("paged_json", """
    select o_orderkey, o_orderpriority, o_totalprice, (select count(*) from orders) as expected, 1 as complete from orders
""")
def paged_json(spark, d):
    path = f"{sinks.scratch_dir(spark)}/pages"
    o = load(spark, d, "orders")
    total = o.agg(F.count(F.lit(1))).scalar()
    item = F.struct("o_orderkey", "o_orderpriority", "o_totalprice")
    # pages of 1,000 items
    pages = o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("page")).agg(F.collect_list(item).alias("Items")).withColumn("TotalCount", total)
    pages.repartition("page").drop("page").write.json(path)
    schema = "o_orderkey long, o_orderpriority string, o_totalprice double"
    items = readers.read_paged_json(spark, path, schema, lines=True)
    check = readers.paged_completeness(spark, path, schema, lines=True)
    return items.withColumns({
        "expected": check.select("expected").scalar(), "complete": check.select(F.col("complete").cast("int")).scalar(),
    })


@case("two_layouts", "select c_custkey as key, c_name as name from customer")
def two_layouts(spark, d):
    """Documents of some hundred rows, one per line, in either layout."""
    path = f"{sinks.scratch_dir(spark)}/layouts"
    record = F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))
    row = F.concat(F.lit("["), F.col("c_custkey").cast("string"), F.lit(', "'), F.col("c_name"), F.lit('"]'))
    groups = _filed(load(spark, d, "customer"), "c_custkey", 200, F.struct(record.alias("record"), row.alias("row")))
    listed = lambda kind: F.array_join(F.transform("lines", lambda x: x["v"][kind]), ",")
    doc = F.when(F.col("file") % 2 == 0, F.concat(F.lit('{"data": ['), listed("record"), F.lit("]}"))).otherwise(
        F.concat(F.lit('{"columns": ["key", "name"], "index": [0], "data": ['), listed("row"), F.lit("]}"))
    )
    for kind in (0, 1):  # the two layouts, as separate landings of one document per line
        groups.where(F.col("file") % 2 == kind).select(doc.alias("value")).write.mode("append").text(path)
    schema = StructType.fromDDL("key long, name string")
    return readers.conform(readers.read_two_layouts(spark, path, ["key", "name"], by_line=True), schema)


@case("assembled_tables", """
    select 'nation' as name, count(*)::double as value from nation union all select 'region', count(*)::double from region union all
    select 'max_price', round(max(o_totalprice), 2) from orders union all select 'metadata_rows', 2.0
""")
def assembled_tables(spark, d):
    """Tables written as parquet and read back by name, then reported as facts."""
    path = sinks.scratch_dir(spark)
    meta = sinks.metadata(spark, {"Title": "regulatory data"})
    tables = {"nation_t": load(spark, d, "nation"), "region_t": load(spark, d, "region"), "meta_t": meta}
    for name, df in tables.items():
        sinks.write_parquet(df, f"{path}/{name}")
    catalog.register({name: spark.read.parquet(f"{path}/{name}") for name in tables})
    listed = {r.name for r in catalog.list_tables(spark).where(F.col("name").isin(list(tables))).collect()}
    if listed != set(tables):
        raise ValueError(f"tables listed: {sorted(listed)}")
    count = lambda name: catalog.table(spark, name).agg(F.count(F.lit(1)).alias("n"))
    return sinks.facts(
        ("nation", count("nation_t")), ("region", count("region_t")),
        ("max_price", load(spark, d, "orders").agg(F.round(F.max("o_totalprice"), 2).alias("v"))), ("metadata_rows", count("meta_t")),
    )


@case("published_tables", """
    select 'orders' as name, o_orderpriority as key, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 2
    union all select 'customer', c_mktsegment, count(*), round(sum(c_acctbal), 2) from customer group by 2
""")
def published_tables(spark, d):
    """Two published runs and one that fails in its second table: readers see the second."""
    root = f"{sinks.scratch_dir(spark)}/published"
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    sinks.publish(spark, {"orders": o.limit(1)}, root)
    good = {"orders": o.select("o_orderpriority", "o_totalprice"), "customer": c.select("c_mktsegment", "c_acctbal")}
    sinks.publish(spark, good, root)
    lost = c.select(F.raise_error(F.lit("lost on the way")).alias("c_mktsegment"))
    try:
        sinks.publish(spark, {"orders": o.limit(2), "customer": lost}, root)
    except SparkRuntimeException:
        pass
    found = sinks.published(spark, root)
    rows = [t.groupBy(F.lit(n).alias("name"), F.col(k).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 2).alias("total"))
            for (n, t), k, v in zip(sorted(found.items()), ("c_mktsegment", "o_orderpriority"), ("c_acctbal", "o_totalprice"))]
    return union_all(rows)


@case("catalog_tables", "select o_orderkey, round(o_totalprice, 2) as price, c_name from orders join customer on c_custkey = o_custkey")
def catalog_tables(spark, d):
    """Tables of a catalog database, read back by name."""
    place = sinks.scratch_dir(spark)
    name = f"regdata_{place[-12:]}"
    spark.sql(f"create database {name} location '{place}/warehouse'")
    sinks.assemble(spark, {t: load(spark, d, t) for t in ("orders", "customer")}, name)
    return spark.sql(f"select o_orderkey, round(o_totalprice, 2) as price, c_name from {name}.orders join {name}.customer on c_custkey = o_custkey")


@case("metadata_entries", """
    select 'orders' as key, cast(count(*) as varchar) as value, true as stamped from orders union all
    select 'first order', cast(min(o_orderdate)::date as varchar), true from orders union all select 'db_generated', null, true
""")
def metadata_entries(spark, d):
    """Keys and values of the metadata table, and whether its datasets carry the time of this run."""
    found = load(spark, d, "orders").agg(F.count(F.lit(1)).cast("string").alias("orders"), F.min("o_orderdate").cast("date").cast("string").alias("first order")).first()
    meta, stamps = sinks.metadata(spark, found.asDict()), sinks.last_updated(spark, sorted(found.asDict()))
    fresh = stamps.agg(F.min(F.col("updated").between(F.current_timestamp() - F.expr("interval 1 hour"), F.current_timestamp()))).scalar()
    generated = F.col("key") == "db_generated"
    own = F.when(generated, F.col("value").try_cast("timestamp") > F.current_timestamp() - F.expr("interval 1 hour")).otherwise(True)
    return meta.select("key", F.when(~generated, F.col("value")).alias("value"), (own & fresh).alias("stamped"))


@case("accepted_counts", """
    select 'customer' as dataset, count(*) as rows, true as accepted, false as again from customer union all select 'orders', count(*), true, false from orders
""")
def accepted_counts(spark, d):
    """Counts are accepted if all checks pass; fewer rows in a later run leave the accepted ones."""
    path = f"{sinks.scratch_dir(spark)}/counts"
    tables = {"customer": load(spark, d, "customer"), "orders": load(spark, d, "orders")}
    required, floors = {"customer": ["c_custkey"], "orders": ["o_orderkey", "o_totalprice"]}, {"customer": 1, "orders": 1}
    none = spark.createDataFrame([], "dataset string, rows long")
    first = quality.accept(quality.check_datasets(tables, required, floors, none), path)
    before = spark.read.parquet(path)
    fewer = {**tables, "orders": tables["orders"].where("o_orderstatus <> 'F'")}
    again = quality.accept(quality.check_datasets(fewer, required, floors, before), path)
    return spark.read.parquet(path).select("dataset", "rows", F.lit(first).alias("accepted"), F.lit(again).alias("again"))
