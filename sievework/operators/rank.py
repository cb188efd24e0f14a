"""Sorting with a split into kept and rejected rows, and the registry of sort methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, geometry, paths
from ..storage import written


def sort_by(
    df: DataFrame,
    score: Column,
    ties: list[str],
    descending: bool = True,
    reject: Column | None = None,
    path: str | None = None,
) -> DataFrame:
    """Adds score, is_trash, rank and, with a path column, new_name.

    Kept rows are numbered from 0 by score, ties by the given columns; rejected rows have a null
    rank. A null score is rejected. A rank over everything needs a total order, so rows are ranged
    by key first: the rank within a range is added to the rows before it, and no task sees all.
    """
    bad = score.isNull() if reject is None else score.isNull() | F.coalesce(reject, F.lit(True))
    key = (-score if descending else score).cast("double")
    scored = df.withColumn("score", score).withColumn("is_trash", bad).withColumn("_key", F.when(~bad, key))
    ranked = global_rank(scored, ["is_trash", "_key", *ties], "_at").drop("_key")
    rank = F.when(~F.col("is_trash"), F.col("_at"))
    ranked = ranked.withColumn("rank", rank).drop("_at")
    if path is None:
        return ranked
    name = F.when(~F.col("is_trash"), paths.numbered(F.col("rank"), F.col(path)))
    return ranked.withColumn("new_name", name)


def _asc(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _range: rows are dealt to ranges of this order, one after the other; equal keys share one.

    Range bounds come from a sample that differs from run to run, so the ranged rows are written
    once and what follows reads the same ranges, also after an executor is lost. That table is what the
    result reads, so it stays until the shared folder is cleaned."""
    dealt = df.repartitionByRange(*_asc(order))
    return written(dealt.withColumn("_range", F.spark_partition_id()), "ranged")


def _before(sums: DataFrame, *columns: Column) -> DataFrame:
    """One row per range (one per partition, which is why these are broadcast): sums over those before."""
    return F.broadcast(sums.select("_range", *columns))


UP_TO_HERE = (Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of a column up to and with each row, without gathering rows in one task: sums
    inside ranges are shifted by the sums of the ranges before."""
    marked = ranged(df, order)
    within = Window.partitionBy("_range").orderBy(*_asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    sums = marked.groupBy("_range").agg(F.sum(value).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(*UP_TO_HERE)), F.lit(0)).alias("_offset")
    joined = marked.withColumn("_within", F.sum(value).over(within)).join(_before(sums, offset), "_range")
    return joined.withColumn(name, F.col("_within") + F.col("_offset")).drop("_range", "_within", "_offset")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers all rows from 0 in this order without gathering them in one task."""
    marked = ranged(df, order)
    within = Window.partitionBy("_range").orderBy(*_asc(order))
    sizes = marked.groupBy("_range").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(*UP_TO_HERE)), F.lit(0)).alias("_offset")
    joined = marked.withColumn("_within", F.row_number().over(within) - 1).join(_before(sizes, offset), "_range")
    return joined.withColumn(name, F.col("_within") + F.col("_offset")).drop("_range", "_within", "_offset")


def nearest_known(df: DataFrame, order: list[str], value: str, below: str, above: str) -> DataFrame:
    """Adds the last value that is not null up to and with each row, and the first from it on. Ranges
    without one pass on what their neighbours have."""
    marked = ranged(df, order)
    inside = Window.partitionBy("_range").orderBy(*_asc(order))
    known = marked.where(F.col(value).isNotNull()).groupBy("_range")
    place = F.struct(*order)
    ends = known.agg(F.max_by(value, place).alias("_last"), F.min_by(value, place).alias("_first"))
    ends = marked.select("_range").distinct().join(ends, "_range", "left")
    by_range = Window.orderBy("_range")
    found = ends.select(
        "_range",
        F.last("_last", True).over(by_range.rowsBetween(*UP_TO_HERE)).alias("_before"),
        F.first("_first", True).over(by_range.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    own = marked.withColumn("_low", F.last(value, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("_high", F.first(value, True).over(inside.rowsBetween(0, Window.unboundedFollowing)))
    joined = own.join(F.broadcast(found), "_range")  # one row per partition
    joined = joined.withColumn(below, F.coalesce("_low", "_before")).withColumn(above, F.coalesce("_high", "_after"))
    return joined.drop("_range", "_low", "_high", "_before", "_after")


def by_sharpness(df: DataFrame, sharpness: str, ties: list[str]) -> DataFrame:
    """blur: sharpest first; a score of exactly 0 is rejected."""
    return sort_by(df, F.col(sharpness).cast("double"), ties, reject=F.col(sharpness) == 0)


def by_number(df: DataFrame, column: str, ties: list[str], descending: bool = True) -> DataFrame:
    """face-yaw, face-pitch, motion-blur, brightness, hue: by a column, rows without it rejected."""
    return sort_by(df, F.col(column).cast("double"), ties, descending)


def by_rect_size(df: DataFrame, rect: tuple[str, str, str, str], ties: list[str]) -> DataFrame:
    """face-source-rect-size: by the area of the source rectangle."""
    return sort_by(df, geometry.rect_area(*map(F.col, rect)), ties)


def by_black(df: DataFrame, values: str, ties: list[str]) -> DataFrame:
    """black: fewest zero values first."""
    zeros = F.size(F.filter(values, lambda x: x == 0)).cast("double")
    return sort_by(df, zeros, ties, descending=False)


def by_mean(df: DataFrame, values: str, ties: list[str]) -> DataFrame:
    """brightness and hue from channel values: greatest mean first."""
    return sort_by(df, arrays.mean(F.transform(values, lambda x: x.cast("double"))), ties)


def by_original_name(df: DataFrame, source: str, ties: list[str]) -> DataFrame:
    """origname: by the source's file name; rows without one are rejected."""
    named = df.withColumn("is_trash", F.col(source).isNull())
    ranked = global_rank(named, ["is_trash", source, *ties], "rank")
    return ranked.withColumn("rank", F.when(~F.col("is_trash"), F.col("rank")))


METHODS = {
    "blur": by_sharpness,
    "motion-blur": by_number,
    "face-yaw": by_number,
    "face-pitch": by_number,
    "face-source-rect-size": by_rect_size,
    "brightness": by_mean,
    "hue": by_mean,
    "black": by_black,
    "origname": by_original_name,
}
#: Both spellings of the stratified selections (select.best_n).
BEST_N_NAMES = {"final": False, "final-by-blur": False, "final-fast": True, "final-by-size": True}
