"""Readers on small hand-written files."""

import gzip

import pytest
from pyspark.sql.types import StructType

from regdata.sources import catalog, readers, sinks


def test_csv_cells_with_line_breaks(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('id,note,amount\n1,"two\nlines, ""quoted""","$1,000"\n2,,x\n')
    out = readers.read_table(spark, str(tmp_path / "a.csv"), StructType.fromDDL("id int, note string, amount double"), multiline=True)
    assert rows(out) == [(1, 'two\nlines, "quoted"', 1000.0), (2, None, None)]


def test_csv_title_rows(spark, tmp_path, rows):
    text = 'table with row headers,,\n"Table 1. Population",,\nArea,"April 1",2000\n.Alabama,"4,447,207","4,452,173"\nNote: dots,,\n'
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write(text)
    schema = StructType.fromDDL("area string, april double, y2000 double")
    out = readers.read_table(spark, str(tmp_path / "p.csv.gz"), schema, header=False, numeric=["april", "y2000"])
    assert rows(out) == [(".Alabama", 4447207.0, 4452173.0)]


def test_sections_across_blocks_and_blank_runs(spark, tmp_path):
    lines = ["title", "", "Nations", "key,name"] + [f"{i},n{i}" for i in range(400)] + ["", "", "Regions", "key,name"] + [f"{i},r{i}" for i in range(300)]
    (tmp_path / "s.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        assert readers.read_lines(spark, str(tmp_path / "s.txt")).select("block").distinct().count() > 3
        sections = readers.read_sections(spark, str(tmp_path / "s.txt"))
        a = readers.section_rows(sections, 1, "key int, name string", skip=2).orderBy("key").collect()
        b = readers.section_rows(sections, 2, "key int, name string", skip=2).orderBy("key").collect()
        order = [r.value for r in sections.where("section = 2").orderBy("line").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert [tuple(r) for r in a] == [(i, f"n{i}") for i in range(400)]
    assert [tuple(r) for r in b] == [(i, f"r{i}") for i in range(300)]
    assert order == lines[406:]


def test_block_report(spark, rows):
    grid = [
        ("", "", "", ""), ("Alabama", "", "", ""), ("", "FY2013", "FY2014", "FY2015"),
        ("Environmental Agency Budget", "$51,352,605", "$51,412,720", "$54,963,601"), ("Status of Budget", "Actual", "Actual", ""),
        ("Amount of Reported SRF", "", "", ""), ("Footnote", "see", "page", "9"), ("", "", "", ""),
        ("Alaska", "", "", ""), ("Amount from Fees", "", "1", "2"),
    ]
    df = spark.createDataFrame([("f", i // 3, i, *g) for i, g in enumerate(grid)], "file string, block int, seq int, a string, b string, c string, d string")
    out = readers.parse_blocks(df, ["a", "b", "c", "d"], "file", ["block"], ["seq"])
    assert rows(out, "unit", "detail", "column", "value") == sorted([
        ("Alabama", "Environmental Agency Budget", "FY2013", "$51,352,605"), ("Alabama", "Environmental Agency Budget", "FY2014", "$51,412,720"),
        ("Alabama", "Environmental Agency Budget", "FY2015", "$54,963,601"), ("Alabama", "Status of Budget", "FY2013", "Actual"),
        ("Alabama", "Status of Budget", "FY2014", "Actual"), ("Alaska", "Amount from Fees", "FY2014", "1"), ("Alaska", "Amount from Fees", "FY2015", "2"),
    ], key=repr)


def test_paged_json_completeness(spark, tmp_path, rows):
    (tmp_path / "1.json").write_text('{"TotalCount": 3,\n "Items": [{"id": 1}, {"id": 2}]}')
    short = readers.read_paged_json(spark, str(tmp_path), "id long")
    with pytest.raises(Exception, match="2 items landed, 3 reported"):
        short.collect()
    assert rows(readers.read_paged_json(spark, str(tmp_path), "id long", strict=False)) == [(1,), (2,)]
    (tmp_path / "2.json").write_text('{"TotalCount": 3, "Items": [{"id": 3}]}')
    assert rows(readers.read_paged_json(spark, str(tmp_path), "id long")) == [(1,), (2,), (3,)]
    assert readers.paged_completeness(spark, str(tmp_path), "id long").first().complete


def test_two_json_layouts(spark, tmp_path, rows):
    (tmp_path / "a.json").write_text('{"data": [{"Permit": "x", "n": 1}]}')
    (tmp_path / "b.json").write_text('{"columns": ["n", "Permit"], "index": [0, 1], "data": [[2, "y"], [3, "z"]]}')
    assert rows(readers.read_two_layouts(spark, str(tmp_path), ["Permit", "n"])) == [("x", "1"), ("y", "2"), ("z", "3")]


def test_standard_names(spark):
    df = spark.createDataFrame([(1, 2)], "`City / Town (old)` int, `Applicant / Facility Name` int")
    df = readers.coalesce_columns(df, "Facility Name", ["Facility Name", "Applicant / Facility Name"])
    df = readers.coalesce_columns(df, "City", ["City / Town"], prefix=True)
    assert readers.snake_columns(df).columns == ["City", "Facility_Name"]
    with pytest.raises(ValueError):
        readers.coalesce_columns(df, "x", ["y"])
    assert readers.drop_column(df, "CITY").columns == ["Facility Name"]


def test_sample_is_exact_and_repeats(spark):
    df = spark.range(1000)
    a = sinks.sample_rows(df, 10, 1, "id").collect()
    assert len(a) == 10 and a == sinks.sample_rows(df.repartition(5), 10, 1, "id").collect()
    assert a != sinks.sample_rows(df, 10, 2, "id").collect()


def test_assemble_and_list(spark, tmp_path):
    spark.sql("drop table if exists regdata_test_t")
    sinks.assemble(spark, {"regdata_test_t": spark.range(3)})
    try:
        assert catalog.table(spark, "regdata_test_t").count() == 3
        assert "regdata_test_t" in [r.name for r in catalog.list_tables(spark).collect()]
    finally:
        spark.sql("drop table regdata_test_t")
    assert sinks.last_updated(spark, ["a", "b"]).count() == 2
