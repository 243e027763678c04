"""Medians, limits and geometric means (A1-A5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.sources.work import written


def lower_median(column: str) -> Column:
    """The lower of the two middle values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})")


def quantile(column: str, share: float) -> Column:
    return F.expr(f"percentile_disc({share}D) WITHIN GROUP (ORDER BY {column})")


def median(column: str) -> Column:
    """The mean of the two middle values; null without values."""
    return F.expr(f"percentile({column}, 0.5)")


def geometric_mean(column: str) -> Column:
    return F.exp(F.avg(F.log(column)))


def product(column: str) -> Column:
    return F.exp(F.sum(F.log(column)))


def money(amount: Column) -> Column:
    """The sum of amounts to the cent, the same in whatever order they come."""
    return F.round(F.sum(amount.cast("decimal(24,6)")), 2).cast("double")


def ranked_slices(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows, written in ranges of (keys, order) with the number of each row's range as `_slice`. A group spans as many
    ranges as its size asks for, so no task ever holds a whole group; a null in `order` has no rank and leaves."""
    for c in order:
        rows = rows.filter(F.col(c).isNotNull())
    return written(rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "ranked")


def select_ranks(sliced: DataFrame, keys: list[str], order: list[str], ranks: dict[str, Callable[[Column], Column]], weight: str | None = None) -> DataFrame:
    """Of each group of ranked_slices the rows at some ranks, each as a struct of `order`: keys and one column per rank.

    ranks: from a group's size to a rank, 1 being the first; weight: how many rows a row stands for. Sizes of slices give
    their offsets in the group; only the slices that hold a wanted rank are ordered within themselves.
    """
    n = F.lit(1).cast("long") if weight is None else F.col(weight)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.sum(n).alias("_here"))
    group = Window.partitionBy(*keys)
    placed = sizes.withColumns({"_upto": F.sum("_here").over(group.orderBy("_slice")), "_total": F.sum("_here").over(group)})
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("_total")).cast("long").alias("rank")) for name, rank in ranks.items())))
    targets = placed.select(*keys, "_slice", "_upto", (F.col("_upto") - F.col("_here")).alias("_before"), wanted.alias("_wanted")).filter("_wanted.rank > _before AND _wanted.rank <= _upto")
    here = Window.partitionBy(*keys, "_slice", "_wanted.name").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = sliced.join(targets, [*keys, "_slice"]).withColumn("_at", F.col("_before") + F.sum(n).over(here)).filter("_at >= _wanted.rank")
    return reached.groupBy(*keys).agg(*(F.min(F.when(F.col("_wanted.name") == name, F.struct(*order))).alias(name) for name in ranks))


def group_limits(rows: DataFrame, keys: list[str], column: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """keys, low and high quantiles (discrete) of a column. Few groups may hold all rows: equal values are counted first, in
    the map tasks, and the counted values are selected by rank over ranges."""
    counted = ranked_slices(rows.groupBy(*keys, column).agg(F.count("*").alias("n")), keys, [column])
    share = lambda s: lambda total: F.ceil(F.lit(s) * total)
    found = select_ranks(counted, keys, [column], {"low": share(low), "high": share(high)}, "n")
    return found.select(*keys, F.col(f"low.{column}").alias("low"), F.col(f"high.{column}").alias("high"))
