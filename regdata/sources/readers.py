"""Readers for the raw layouts: tables, sectioned text, GeoJSON, paged and two-layout JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.functions.geo import POLYGON
from regdata.functions.nulls import nans_to_nulls
from regdata.operators.ordered import fill_forward, prefix_sums, row_numbers


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    fmt: str = "csv",
    header: bool = True,
    encoding: str = "UTF-8",
    multiline: bool = False,
    numeric: list[str] | None = None,
) -> DataFrame:
    """Typed table from CSV (plain, gzip, bz2, zstd) or parquet; cells that do not parse are null.

    ``multiline`` allows quoted cells that hold line breaks; such files cannot be split,
    so leave it off when the data has none. ``numeric`` names columns that must hold
    numbers: title and footnote rows around the table fail that test and are dropped.
    """
    if fmt != "csv":
        return nans_to_nulls(conform(spark.read.format(fmt).load(path), schema))
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = (
        spark.read.schema(text)
        .option("header", header)
        .option("encoding", encoding)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("enforceSchema", True)
        .csv(path)
    )
    if numeric:
        parsed = [F.regexp_replace(F.trim(c), "[,$%]", "").try_cast("double").isNotNull() for c in numeric]
        raw = raw.where(reduce(lambda a, b: a & b, parsed))
    return nans_to_nulls(conform(raw, schema))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Enforce names and types: one ``try_cast`` per field, absent columns become null."""
    present = {c.lower(): c for c in df.columns}
    columns = []
    for field in schema:
        source = present.get(field.name.lower())
        value = F.lit(None) if source is None else F.col(f"`{source}`")
        if isinstance(field.dataType, T.NumericType) and source is not None and df.schema[source].dataType == T.StringType():
            value = F.regexp_replace(F.trim(value), "[,$%]", "")
        columns.append(value.try_cast(field.dataType).alias(field.name))
    return df.select(columns)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: ``file``, ``block`` (start offset of the input split), ``seq``, ``value``.

    ``seq`` grows along a block and ``block`` along a file, so the pair orders a file
    without reading it in one task.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("value"),
    )


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that hold several tables separated by blank lines.

    Columns: ``file``, ``section`` (0-based), ``line`` (0-based in the section), ``value``.
    """
    lines = read_lines(spark, path).withColumn("blank", (F.trim("value") == "").cast("long"))
    numbered = prefix_sums(lines, ["file"], ["block"], ["seq"], {"gap": "blank"}).where("blank = 0")
    numbered = row_numbers(numbered, ["file"], ["block"], ["seq"], "pos")
    starts = numbered.groupBy("file", "gap").agg(F.min("pos").alias("first"))
    order = Window.partitionBy("file").orderBy("gap")
    starts = starts.withColumn("section", F.row_number().over(order) - 1)
    return numbered.join(starts, ["file", "gap"]).select(
        "file", "section", (F.col("pos") - F.col("first")).cast("int").alias("line"), "value"
    )


def section_rows(sections: DataFrame, section: int, schema: str, skip: int = 0) -> DataFrame:
    """One section as a table: CSV lines after ``skip`` title and header lines."""
    body = sections.where((F.col("section") == section) & (F.col("line") >= skip))
    return body.select(F.from_csv("value", schema, {"escape": '"'}).alias("r")).select("r.*")


def read_geojson(spark: SparkSession, path: str, name_prop: str, *, by_line: bool = False) -> DataFrame:
    """Features as ``name`` and ``rings``; polygons and multi-polygons get one shape.

    ``by_line`` reads one feature per line, which splits; a single collection document
    is one input record by nature and is exploded at once.
    """
    feature = T.StructType([
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("coordinates", T.StringType()),
        ])),
    ])
    if by_line:
        features = spark.read.schema(feature).json(path)
    else:
        collection = T.StructType([T.StructField("features", T.ArrayType(feature))])
        features = spark.read.schema(collection).option("multiLine", True).json(path).select(F.inline("features"))
    one = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("geometry.type") == "MultiPolygon", many).otherwise(F.array(one))
    rings = F.transform(
        parts,
        lambda part: F.transform(
            part,
            lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))),
        ),
    )
    return features.select(F.col("properties")[name_prop].alias("name"), rings.cast(POLYGON).alias("rings"))


def read_paged_json(
    spark: SparkSession,
    path: str,
    item_schema: str | T.StructType,
    items_field: str = "Items",
    total_field: str | None = "TotalCount",
    strict: bool = True,
    lines: bool = False,
) -> DataFrame:
    """Items of landed page files as one table.

    With ``strict`` the plan itself compares the number of items to the largest reported total: nothing
    is read before the table is, and an incomplete landing raises then. ``lines`` reads one page per line, which
    splits; otherwise each file is one page.
    """
    items = _pages(spark, path, item_schema, items_field, total_field, lines).select(F.inline(items_field))
    if not (strict and total_field):
        return items
    found = paged_completeness(spark, path, item_schema, items_field, total_field, lines)
    text = F.concat(F.lit(f"{path}: "), F.col("got").cast("string"), F.lit(" items landed, "), F.col("expected").cast("string"), F.lit(" reported"))
    whole = found.select(F.when(F.coalesce("complete", F.lit(False)), True).otherwise(F.raise_error(F.coalesce(text, F.lit(f"{path}: no pages"))).cast("boolean")))
    return items.where(whole.scalar())


def paged_completeness(
    spark, path, item_schema, items_field="Items", total_field="TotalCount", lines: bool = False
) -> DataFrame:
    """One row: items landed, items reported, complete or not."""
    pages = _pages(spark, path, item_schema, items_field, total_field, lines)
    return pages.agg(
        F.sum(F.size(items_field)).cast("long").alias("got"), F.max(total_field).alias("expected")
    ).withColumn("complete", F.col("got") == F.col("expected"))


def _pages(spark, path, item_schema, items_field, total_field, lines) -> DataFrame:
    item = T.StructType.fromDDL(item_schema) if isinstance(item_schema, str) else item_schema
    fields = [T.StructField(items_field, T.ArrayType(item))]
    if total_field:
        fields.append(T.StructField(total_field, T.LongType()))
    return spark.read.schema(T.StructType(fields)).option("multiLine", not lines).json(path)


def read_two_layouts(spark: SparkSession, path: str, columns: list[str], by_line: bool = False) -> DataFrame:
    """JSON documents in either layout: ``{"data": [records]}`` or ``{"columns": .., "data": [[..]]}``.

    Every value is read as text; use :func:`conform` for types.
    """
    docs = spark.read.text(path, wholetext=not by_line)
    head = docs.select(
        F.from_json("value", "columns array<string>").alias("h"),
        F.from_json("value", "data array<map<string,string>>").alias("records"),
        F.from_json("value", "data array<array<string>>").alias("split"),
    )
    split_rows = F.transform(
        F.col("split.data"), lambda row: F.map_from_arrays(F.col("h.columns"), row)
    )
    rows = head.select(
        F.explode(F.when(F.col("h.columns").isNotNull(), split_rows).otherwise(F.col("records.data"))).alias("row")
    )
    return rows.select([F.col("row")[c].alias(c) for c in columns])


def coalesce_columns(df: DataFrame, out: str, candidates: list[str], prefix: bool = False) -> DataFrame:
    """Give the one present of several source names (or prefixes of names) its standard name."""
    for candidate in candidates:
        for name in df.columns:
            if name == candidate or (prefix and name.startswith(candidate)):
                return df.withColumnRenamed(name, out)
    raise ValueError(f"none of {candidates} among {df.columns}")


def snake_columns(df: DataFrame, repl: str = "_") -> DataFrame:
    """Replace spaces in column names."""
    return df.toDF(*[c.replace(" ", repl) for c in df.columns])


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """Drop every column with this name, whatever its case."""
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()])


def parse_blocks(rows: DataFrame, cells: list[str], by: str, pieces: list[str], order: list[str]) -> DataFrame:
    """Long rows (unit, detail, column, value) of a block-layout report.

    A row with only its first cell filled names the unit, a row with ``FY`` cells names
    the columns, an empty row ends the unit, and rows with a known detail name hold
    values. State moves down each file by :func:`fill_forward`, so a file is worked on
    in as many pieces as it has.
    """
    from regdata.vocab import BLOCK_DETAIL_MARKS, BLOCK_NOT_TITLES

    cell = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in cells])
    df = rows.withColumn("_cells", cell)
    rest = F.slice("_cells", 2, len(cells) - 1)
    first = F.col("_cells")[0]
    rest_empty = ~F.exists(rest, lambda c: c != "")
    empty = (first == "") & rest_empty
    not_title = reduce(lambda a, b: a | b, [first.startswith(p) for p in BLOCK_NOT_TITLES])
    title = (F.length(first) > 2) & rest_empty & ~not_title
    is_year = F.exists("_cells", lambda c: c.startswith("FY"))
    start = F.array_position(F.transform("_cells", lambda c: c.startswith("FY")), True).cast("int")
    header = F.struct(
        F.greatest(start, F.lit(2)).alias("start"),
        F.slice("_cells", start, F.lit(len(cells))).alias("names"),
    )
    # an empty row sets the unit to "", which ends it
    df = df.withColumn("_unit", F.when(empty, "").when(title, first)).withColumn("_head", F.when(is_year, header))
    df = fill_forward(df, [by], pieces, order, ["_unit", "_head"])
    marked = reduce(lambda a, b: a | b, [F.contains(first, F.lit(m)) for m in BLOCK_DETAIL_MARKS])
    data = df.where(marked & ~rest_empty & ~is_year & F.col("_head").isNotNull() & (F.col("_unit") != ""))
    values = F.slice("_cells", F.col("_head.start"), F.size("_head.names"))
    pairs = F.arrays_zip(F.col("_head.names").alias("column"), values.alias("value"))
    return data.select(
        by, F.col("_unit").alias("unit"), first.alias("detail"), F.inline(pairs)
    ).where("value != '' and column != ''")
