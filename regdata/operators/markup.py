"""Jobs over tables of pages: links and table rows out of HTML cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regdata.functions.text import is_pdf, links, strip_tags

# comments and script as wholes, then tags, then what is between them
TOKEN = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>|[^<]+|<"
TAG = r"^<(/?)([A-Za-z][A-Za-z0-9]*)"


def extract_links(pages: DataFrame, keys: list[str], html: str, pdf_only: bool = True) -> DataFrame:
    """One row per link target; with ``pdf_only`` those whose path ends in .pdf."""
    out = pages.select(*keys, F.explode(links(html)).alias("href"))
    return out.where(is_pdf("href")) if pdf_only else out


def table_cells(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Every cell of every table: ``keys``, ``table_no``, ``row_no``, ``cell_no`` (from 0), ``head`` and ``cell``, its markup.

    Pages are read as streams of tags, as a parser does: a cell ends with its end tag, or where the next cell or row
    begins or its table ends; a row may begin without its tag; end tags of nothing are ignored. A table
    inside a cell is a table of its own and no part of that cell. Counts and levels run along
    the tokens of a page, which a task holds one page at a time.
    """
    marked = pages.select(*keys, F.monotonically_increasing_id().alias("_page"), F.col(html).alias("_html"))
    tokens = marked.select(*keys, "_page", F.posexplode(F.regexp_extract_all("_html", F.lit(TOKEN), F.lit(0))).alias("_at", "_token"))
    tokens = tokens.where(~F.col("_token").rlike(r"(?i)^<(!--|script\b|style\b)"))
    tag = F.lower(F.concat(F.regexp_extract("_token", TAG, 1), F.regexp_extract("_token", TAG, 2)))
    tokens = tokens.withColumn("_tag", F.when(tag.isin("table", "/table", "tr", "/tr", "td", "/td", "th", "/th"), tag))
    page = Window.partitionBy("_page").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    # an end of a table that was not begun would lower the level below 0: levels count from the lowest so far
    step = F.when(F.col("_tag") == "table", 1).when(F.col("_tag") == "/table", -1).otherwise(0)
    tokens = tokens.withColumn("_sum", F.sum(step).over(page))
    tokens = tokens.withColumn("_level", F.col("_sum") - F.least(F.min("_sum").over(page), F.lit(0)) + (F.col("_tag").eqNullSafe("/table")).cast("int"))
    level = Window.partitionBy("_page", "_level").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    tokens = tokens.where("_level > 0").withColumn("_table", F.max(F.when(F.col("_tag") == "table", F.col("_at"))).over(level)).where("_table is not null")
    table = Window.partitionBy("_page", "_level", "_table").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    tokens = tokens.withColumn("_tag", F.when(F.col("_at") == F.col("_table"), None).otherwise(F.col("_tag")))
    # a cell outside any row begins one: the last of row marks before it is an end, or there is none
    cell = F.coalesce(F.col("_tag").isin("td", "th"), F.lit(False))
    mark = F.when(F.col("_tag").isin("tr", "/tr"), F.col("_tag")).when(cell, F.lit("cell"))
    before = F.last(mark, ignorenulls=True).over(table.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("_tag").eqNullSafe("tr") | (cell & F.coalesce(before == "/tr", F.lit(True)))
    tokens = tokens.withColumn("_row", F.sum(starts.cast("int")).over(table))
    tokens = tokens.withColumn("_cell", F.sum(cell.cast("int")).over(table))
    bound = F.when(cell, True).when(F.col("_tag").isin("/td", "/th", "tr", "/tr", "/table"), False)
    tokens = tokens.withColumn("_open", F.coalesce(F.last(bound, ignorenulls=True).over(table), F.lit(False))).where("_open")
    found = tokens.groupBy(*keys, "_page", "_table", "_row", "_cell").agg(
        F.max(F.col("_tag").eqNullSafe("th")).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("_tag").isNull() | ~F.col("_tag").isin("td", "th"), F.struct("_at", "_token")))).alias("_parts"),
    )
    rank = lambda over, c: (F.dense_rank().over(Window.partitionBy("_page", *over).orderBy(c)) - 1).alias(f"{c[1:]}_no")
    return found.select(
        *keys, rank([], "_table"), rank(["_table"], "_row"), rank(["_table", "_row"], "_cell"), "head",
        F.array_join(F.transform("_parts", lambda p: p["_token"]), "").alias("cell"), "_page",
    )


def table_rows(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Every table row below the header as a map of header text to cell markup.

    The first row with cells is the header; a row whose first cell reads like the first header is one again and is left out. Columns:
    ``keys``, ``table_no``, ``row_no``, ``cells``, ``headers``, ``well_formed`` (as many cells as headers).
    """
    cells = table_cells(pages, keys, html)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "cell"))), lambda c: c["cell"])
    rows = cells.groupBy(*keys, "_page", "table_no", "row_no").agg(listed.alias("_values"))
    top = Window.partitionBy("_page", "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_names", F.transform(F.first("_values").over(top), strip_tags)).where("row_no > 0")
    rows = rows.where(strip_tags(F.get("_values", 0)) != F.get("_names", 0))
    # of equal header texts the first counts
    places = F.filter(F.sequence(F.lit(0), F.least(F.size("_names"), F.size("_values")) - 1), lambda i: F.array_position("_names", F.get("_names", i)) == i + 1)
    entries = F.transform(places, lambda i: F.struct(F.get("_names", i), F.get("_values", i)))
    return rows.select(*keys, "table_no", "row_no", F.map_from_entries(entries).alias("cells"), F.col("_names").alias("headers"), (F.size("_names") == F.size("_values")).alias("well_formed"))


def extract_table_rows(pages: DataFrame, keys: list[str], html: str, columns: list[str]) -> DataFrame:
    """Named cells as text columns, from the tables that have all these headers; ``N/A`` and missing cells give nulls."""
    rows = table_rows(pages, keys, html).where(F.size(F.array_except(F.array(*map(F.lit, columns)), "headers")) == 0)
    return rows.select(*keys, *[F.nullif(strip_tags(F.col("cells")[c]), F.lit("N/A")).alias(c) for c in columns])


def malformed_rows(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """How many rows had fewer or more cells than headers."""
    return table_rows(pages, keys, html).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("well_formed")).alias("malformed")
    )
