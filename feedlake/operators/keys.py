"""Keys: dense increasing ids, duplicate and orphan reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive order values numbered by one task.
BLOCK_ROWS = 1 << 20


def assign_ids(
    rows: DataFrame, order: str, start: Column | int = 0, name: str = "id", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``start + 1, start + 2, ...`` following a unique long column.

    The order values are cut into blocks of fixed width.  A block holds at
    most ``block_rows`` rows because its values are unique, so no task sorts
    more than that, and only counts are summed across blocks.  The result depends on the data alone, not on partitions, so
    a task that is run again gives the same ids.
    """
    # A row without an order value has no place; an error, so that none is lost.
    value = F.coalesce(F.col(order), F.raise_error(F.lit(f"{order} is null")).cast("long"))
    # The filter keeps both uses of the ranks below alike, so they are computed once.
    blocked = rows.withColumn("_block", block_of(value, block_rows)).filter("_block is not null")
    ranked = blocked.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_block").orderBy(order))
    )
    sizes = ranked.groupBy("_block").agg(F.max("_rank").cast("long").alias("_size"))
    offsets = totals_before(sizes, "_block", "_size", block_rows)
    first = start if isinstance(start, Column) else F.lit(start).cast("long")
    return (
        ranked.join(offsets, "_block")
        .withColumn(name, first + F.col("before") + F.col("_rank"))
        .drop("_block", "_rank", "before")
    )


def block_of(value: Column, width: int) -> Column:
    """Start of the aligned block of ``width`` values a long falls into."""
    return value - F.pmod(value, F.lit(width).cast("long"))


def totals_before(sizes: DataFrame, block: str, size: str, width: int, descending: bool = False) -> DataFrame:
    """``(block, before)``: summed sizes of all blocks in front of each.

    Blocks are summed in groups of ``width`` blocks and the groups once more,
    so even sparse values, of which every block is nearly empty, put only a
    ``width``-th of the blocks into the one task that sees all groups.
    """
    group = block_of(F.col(block), width * width)
    grouped = sizes.select(block, size, group.alias("_group"))
    sums = grouped.groupBy("_group").agg(F.sum(size).alias("_sum"))
    front = (Window.unboundedPreceding, -1)

    def order(column: str) -> Column:
        return F.desc(column) if descending else F.asc(column)

    def total(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(*front)), F.lit(0).cast("long"))

    groups = sums.select("_group", total("_sum", Window.orderBy(order("_group"))).alias("_groups_before"))
    inside = Window.partitionBy("_group").orderBy(order(block))
    return (
        grouped.select(block, "_group", total(size, inside).alias("_inside"))
        .join(groups, "_group")
        .select(block, (F.col("_inside") + F.col("_groups_before")).alias("before"))
    )


def max_id(table: DataFrame, column: str = "id") -> Column:
    """Largest id of a table as a scalar subquery, 0 when it is empty."""
    return table.agg(F.coalesce(F.max(column), F.lit(0).cast("long"))).scalar()


def key_violations(items: DataFrame, details: DataFrame, feeds: DataFrame) -> DataFrame:
    """Rows that a store with unique and foreign keys would have refused.

    One row per offending key: which rule, the key, how many rows carry it.
    """

    def report(rows: DataFrame, rule: str, key: Column) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), key.alias("key"), "row_count")

    def repeated(table: DataFrame, columns: list[str], rule: str) -> DataFrame:
        counts = table.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))
        text = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
        return report(counts.filter("row_count > 1"), rule, text)

    def orphans(table: DataFrame, column: str, parent: DataFrame, rule: str) -> DataFrame:
        counts = table.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
        lost = counts.join(parent.select(F.col("id").alias(column)), column, "left_anti")
        return report(lost, rule, F.col(column).cast("string"))

    return (
        repeated(items, ["feed_id", "external_id"], "duplicate item")
        .unionByName(repeated(details, ["feed_item_id"], "duplicate detail"))
        .unionByName(repeated(feeds, ["url"], "duplicate feed"))
        .unionByName(orphans(items, "feed_id", feeds, "item without feed"))
        .unionByName(orphans(details, "feed_item_id", items, "detail without item"))
    )


def require_unique(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Strict insert: the rows unchanged, or an error at run time on a repeated key."""
    counts = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    text = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    message = F.concat(F.lit("duplicate key "), text)
    checked = counts.select(
        *columns, F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.lit(True)).alias("_ok")
    ).filter("_ok")
    return rows.join(checked.drop("_ok"), columns, "left_semi")
