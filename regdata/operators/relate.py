"""Joins, spines, vintages and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regdata.functions.nulls import known_keys, sum0
from regdata.functions.text import proper_nouns
from regdata.operators.skew import HOT_SHARE, skew_join
from regdata.session import materialise


NAMES = 200_000  # names of a gazetteer that are broadcast
HOT_ROWS = 20_000  # a key needs more rows than this, and more than its share, to be split


def _same(a: str, b: str, left: list[str], right: list[str]) -> Column:
    """Whether the keys of two aliased tables are equal, missing ones included."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{r}")) for k, r in zip(left, right)])


def _with_parts(df: DataFrame, keys: list[str], out: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the part of their key that they are in, by their content; and the parts in use of each hot key, at most ``1 / HOT_SHARE`` rows."""
    limit = F.greatest(df.agg(F.count(F.lit(1))).scalar() * F.lit(HOT_SHARE), F.lit(HOT_ROWS))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_limit", limit)
    hot = counts.where("_rows > _limit").select(*keys, F.ceil(F.col("_rows") / F.col("_limit")).alias("_parts"))
    content = F.xxhash64(*[F.col(f"l.`{c}`") for c in df.columns])
    dealt = df.alias("l").join(F.broadcast(hot).alias("h"), _same("l", "h", keys, keys), "left")
    dealt = dealt.select("l.*", "_parts", F.coalesce(F.pmod(content, F.col("_parts")), F.lit(0)).alias(out))
    used = dealt.where("_parts is not null").groupBy(*keys).agg(F.collect_set(out).alias("_used"))
    return dealt.drop("_parts"), used


def full_outer_coalesced(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Full outer join on differently named keys; missing keys match each other.

    Each key pair becomes one column under its left name. It is one full join, so each side moves once. Adaptive
    execution can't split a hot key in it, so rows of one are dealt to parts by their content, and
    rows of the other side repeated once for each part in use. As every such part has rows, a
    repeated row always finds a partner, and none comes out alone more than once.
    """
    keys, theirs = [a for a, _ in pairs], [f"_r_{b}" for _, b in pairs]
    renamed = right.withColumnsRenamed({b: f"_r_{b}" for _, b in pairs})
    mine, used_mine = _with_parts(left, keys, "_sl")
    other, used_other = _with_parts(renamed, theirs, "_sr")
    every = lambda c: F.explode(F.coalesce(F.col("_used"), F.array(F.lit(0).cast("long")))).alias(c)
    mine = mine.alias("l").join(F.broadcast(used_other).alias("u"), _same("l", "u", keys, theirs), "left").select("l.*", every("_sr"))
    other = other.alias("l").join(F.broadcast(used_mine).alias("u"), _same("l", "u", theirs, keys), "left").select("l.*", every("_sl"))
    cond = _same("a", "b", keys, theirs) & (F.col("a._sl") == F.col("b._sl")) & (F.col("a._sr") == F.col("b._sr"))
    joined = mine.alias("a").join(other.alias("b"), cond, "full")
    found = F.col("a._sl").isNotNull()
    merged = [F.when(found, F.col(f"a.{k}")).otherwise(F.col(f"b.{r}")).alias(k) for k, r in zip(keys, theirs)]
    rest = [F.col(f"b.`{c}`") for c in renamed.columns if c not in theirs]
    kept = dict(zip(keys, merged))
    return joined.select(*[kept.get(c, F.col(f"a.`{c}`")) for c in left.columns], *rest)


def facts_on_dimension(facts: DataFrame, dims: DataFrame, fact_key: str, dim_key: str, by: str, sums: list[str]) -> DataFrame:
    """Totals of facts per dimension attribute; attributes without facts stay, with 0.

    Facts are added up per key before the join, so a busy key is one row when it
    reaches the shuffle; facts without a dimension row carry no attribute and drop out.
    """
    per_key = known_keys(facts, fact_key).groupBy(F.col(fact_key).alias("_key")).agg(*[sum0(c).alias(c) for c in sums])
    places = known_keys(dims, by).select(F.col(dim_key).alias("_key"), by)
    joined = places.join(per_key, "_key", "left")
    return joined.groupBy(by).agg(*[sum0(c).alias(c) for c in sums])


def merge_vintages(vintages: list[DataFrame], keys: list[str], value: str, prefer: str = "later") -> DataFrame:
    """One row per key out of overlapping editions, given in chronological order.

    ``later`` keeps the newest edition that has a value (what the documentation of the
    published table says), ``earlier`` the oldest (what its code does).
    """
    rows = None
    for i, df in enumerate(vintages):
        part = df.select(*keys, value).withColumn("_vintage", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(F.col(value).isNotNull())
    pick = F.max_by if prefer == "later" else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(value), F.struct("_vintage", value)).alias("_p")).select(*keys, f"_p.{value}")


def lookup_fill(df: DataFrame, lookup: DataFrame, on: str, fills: dict[str, str], lookup_key: str | None = None) -> DataFrame:
    """Fill missing columns from a reference list. Duplicate list keys collapse first, so rows never multiply."""
    key = lookup_key or on
    unique = lookup.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(on)).agg(
        *[F.min(src).alias(f"_f_{dst}") for dst, src in fills.items()]
    )
    out = skew_join(df, unique, [on], "left")
    return out.withColumns({d: F.coalesce(F.col(d), F.col(f"_f_{d}")) for d in fills}).drop(*[f"_f_{d}" for d in fills])


def align_to_spine(df: DataFrame, spine: DataFrame, on: list[str], fill: dict[str, object] | None = None) -> DataFrame:
    """Every spine key once, with its values or the fill."""
    out = spine.join(df, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (fill or {}).items()})


def distinct_values(df: DataFrame, col: str) -> Column:
    """Sorted distinct values of a category column as one lazy array, worked out when the plan runs."""
    return df.where(F.col(col).isNotNull()).agg(F.array_sort(F.collect_set(col))).scalar()


def spine_of(keys: DataFrame, categories: dict[str, Column | list]) -> DataFrame:
    """Keys combined with every category, given as literal values or as an array column."""
    for name, values in categories.items():
        if not isinstance(values, Column):
            values = F.array(*[F.lit(v) for v in values])
        keys = keys.withColumn("_values", values).withColumn(name, F.explode("_values")).drop("_values")
    return keys


def strict_lookup(df: DataFrame, lookup: DataFrame, on: list[str], value: str) -> DataFrame:
    """Left join that fails at run time on a key the lookup does not have."""
    out = df.join(lookup.select(*on, value), on, "left")
    message = F.concat(F.lit("no row for "), F.concat_ws(",", *[F.col(c).cast("string") for c in on]))
    checked = F.when(F.col(value).isNull(), F.raise_error(message).cast(lookup.schema[value].dataType)).otherwise(F.col(value))
    return out.withColumn(value, checked)


def only_new(found: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return found.join(stored, on, "left_anti")


def known_members(df: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in another table."""
    return df.join(members, on, "left_semi")


def missing_members(expected: DataFrame, present: DataFrame, col: str) -> DataFrame:
    return expected.select(col).distinct().join(present.select(col), col, "left_anti")


def corrections(df: DataFrame, col: str, table: dict[str, str]) -> DataFrame:
    """Replace texts that equal an entry of a correction list given in code.

    The list is matched on a digest, so long texts are not compared in the join; its
    size is that of the literal, which makes it safe to broadcast.
    """
    entries = df.sparkSession.createDataFrame(list(table.items()), "_find string, _replace string")
    entries = F.broadcast(entries.select(F.sha2("_find", 256).alias("_digest"), "_find", "_replace"))
    hit = (F.sha2(df[col], 256) == entries["_digest"]) & (df[col] == entries["_find"])
    out = df.join(entries, hit, "left")
    return out.withColumn(col, F.coalesce("_replace", col)).drop("_digest", "_find", "_replace")


def member_totals(df: DataFrame, members: str, gazetteer: DataFrame, name: str, value: str) -> DataFrame:
    """Rows and full value per listed member; every gazetteer name appears, with 0 if unused.

    Members are exploded once and added up before they meet the gazetteer, so a member
    named by a third of the rows is a single row in the join.
    """
    per_member = (
        df.select(F.explode(F.array_distinct(members)).alias(name), value)
        .groupBy(name).agg(F.count(F.lit(1)).alias("n"), sum0(value).alias(value))
    )
    return align_to_spine(per_member, gazetteer.select(name).distinct(), [name], {"n": 0, value: 0.0})


def gazetteer_tags(df: DataFrame, key: str, text: str, gazetteer: DataFrame, name: str, out: str = "places") -> DataFrame:
    """Sorted names that equal a whole run of capitalised words of the text; rows without any get an empty array.

    Texts are searched once: up to ``NAMES`` names, by count, go to the runs; with more, the runs are kept for the join,
    which reads them several times.
    """
    runs = df.select(key, F.explode(F.array_distinct(proper_nouns(text))).alias("_run"))
    names = materialise(gazetteer.select(F.col(name).alias("_run")).distinct())
    if names.limit(NAMES + 1).count() <= NAMES:
        found = runs.join(F.broadcast(names), "_run")
    else:
        found = skew_join(materialise(runs), names, ["_run"])
    per_row = found.groupBy(key).agg(F.array_sort(F.collect_set("_run")).alias(out))
    return df.join(per_row, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def average_over_members(df: DataFrame, key: str, members: str, dimension: DataFrame, name: str, value: str) -> DataFrame:
    """Mean of a dimension's value over each row's list of keys."""
    listed = df.select(key, F.explode(members).alias(name))
    return skew_join(listed, dimension.select(name, value), [name]).groupBy(key).agg(F.avg(value).alias(value))


def wide_to_long(df: DataFrame, ids: list[str], columns: list[str], variable: str, value: str, dtype: str | None = None) -> DataFrame:
    """Year columns to rows."""
    src = df.select(*ids, *[F.col(f"`{c}`").cast(dtype) if dtype else F.col(f"`{c}`") for c in columns])
    src = src.toDF(*ids, *columns)
    return src.unpivot(ids, columns, variable, value)


def long_to_wide(df: DataFrame, by: list[str], category: str, values: list, agg: Column, fill=None) -> DataFrame:
    """One column per category value; values are given, so Spark need not look for them."""
    out = known_keys(df, *by).groupBy(*by).pivot(category, values).agg(agg)
    return out.na.fill(fill, [str(v) for v in values]) if fill is not None else out


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def column_difference(a: DataFrame, b: DataFrame) -> list[str]:
    return sorted(set(a.columns) - set(b.columns))


def value_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` (with repeats) that ``b`` does not account for."""
    return a.exceptAll(b)


def line_item_series(items: DataFrame, item_col: str, item: str, years: list[str], label: str, value: str) -> DataFrame:
    """Year columns of one line item as (label, value) rows, ready to join on the label."""
    return wide_to_long(items.where(F.col(item_col) == item), [], years, label, value)
