"""Filters that split or drop rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_valid(df: DataFrame, valid: Column) -> DataFrame:
    """Adds is_trash: rows without readable metadata are rejected, not dropped."""
    return df.withColumn("is_trash", ~F.coalesce(valid, F.lit(False)))


def one_face(df: DataFrame, frame: str, face: str) -> DataFrame:
    """Adds is_trash: all rows of a frame that has a face beyond the first one. An aggregate and a
    join, so that a frame with many rows is combined before it is shuffled."""
    several = df.groupBy(F.col(frame).alias("_frame")).agg((F.max(face) > 0).alias("is_trash"))
    joined = df.join(several, df[frame].eqNullSafe(F.col("_frame"))).drop("_frame")
    return joined.withColumn("is_trash", F.coalesce("is_trash", F.lit(False)))


def large_enough(df: DataFrame, width: str, height: str, least: float = 128) -> DataFrame:
    return df.where(F.least(width, height) >= least)


def groups_of_size(df: DataFrame, group: str, low: int, high: int) -> DataFrame:
    """(group, n) of the groups with low to high rows."""
    return df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n").between(low, high))


def plausible(df: DataFrame, area: Column, rect: Column, manual: Column, level: Column, most_level: int) -> DataFrame:
    """Drops faces whose landmarks span over four times their rectangle, unless set by hand or of a
    type beyond most_level."""
    return df.where(manual | (level > most_level) | (area <= 4 * rect))


def first_faces(faces: Column, most: int) -> Column:
    """At most so many faces of a frame, in their order; 0 means all."""
    return F.slice(faces, 1, most) if most > 0 else faces


def first_rows(df: DataFrame, frame: str, order: list, most: int) -> DataFrame:
    """first_faces for rows that are not grouped yet: Spark cuts each task's rows of a frame before the
    shuffle, so that a frame with many rows is never gathered. 0 means all."""
    if most <= 0:
        return df
    place = F.row_number().over(Window.partitionBy(frame).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def cleared(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """df without what the column held, and one row with how many rows changed."""
    changed = df.agg(F.coalesce(F.sum(F.col(column).isNotNull().cast("long")), F.lit(0)).alias("changed"))
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType)), changed


def first_that_holds(df: DataFrame, *choices: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first choice with any rows; an error if none has."""
    for choose in choices:
        found = choose(df)
        if not found.isEmpty():
            return found
    raise ValueError("no row passes any of the filters")


def next_labelled(df: DataFrame, position: str, flag: str, at: int, step: int = 1) -> DataFrame:
    """The step-th row after a position whose flag is set."""
    return df.where(F.col(flag) & (F.col(position) > at)).orderBy(position).offset(step - 1).limit(1)
