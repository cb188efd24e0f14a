"""Windows over rows in time order. Each takes a key to partition by; rows of one key are one series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_first() for c in order])


def motion(df: DataFrame, by: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """Adds motion_power and motion_deg from the row before to the row after, ends standing in for
    what lies beyond; both 0 where nothing moves, null where a position is missing."""
    w = _over(by, order)
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    before = lambda c: F.when(first, F.col(c)).otherwise(F.lag(c).over(w))
    after = lambda c: F.when(last, F.col(c)).otherwise(F.lead(c).over(w))
    dx, dy = after(x) - before(x) + F.col(x) * 0, after(y) - before(y) + F.col(y) * 0
    power = F.sqrt(dx * dx + dy * dy)
    return df.withColumn("motion_power", power).withColumn(
        "motion_deg", F.when(power == 0, 0.0).otherwise(-F.degrees(F.atan2(dy, dx)))
    )


def sliding(df: DataFrame, by: list[str], order: list[str], value: str, length: int) -> DataFrame:
    """(by, order, members): every run of so many rows, at its first one."""
    frame = _over(by, order).rowsBetween(0, length - 1)
    members = F.collect_list(F.struct(F.col(value))).over(frame)
    found = df.withColumn("members", F.transform(members, lambda m: m[value])).where(F.size("members") == length)
    return found.select(*by, *order, "members")


def strided(df: DataFrame, by: list[str], order: list[str], value: str, length: int, stride: Column, most: int = 4) -> DataFrame:
    """(by, order, members): length rows a stride of 1 to most apart; starts are those from which
    even the longest stride fits."""
    w = _over(by, order)
    reach = lambda k: F.coalesce(*[F.when(stride == m, F.lead(value, k * m).over(w)) for m in range(1, most + 1)])
    members = F.array(*[F.col(value) if k == 0 else reach(k) for k in range(length)])
    fits = F.lead(F.lit(1), most * (length - 1)).over(w).isNotNull()
    return df.withColumn("_fits", fits).withColumn("members", members).where("_fits").select(*by, *order, "members")


def neighbours(df: DataFrame, by: list[str], order: list[str], value: str, reach: int) -> DataFrame:
    """Adds members: the values from reach rows before to reach rows after, ends repeated."""
    w = _over(by, order)
    low = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.last(value).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = [F.coalesce(F.lag(value, k).over(w), low) for k in range(reach, 0, -1)]
    after = [F.coalesce(F.lead(value, k).over(w), high) for k in range(1, reach + 1)]
    return df.withColumn("members", F.array(*before, F.col(value), *after))


def smoothed(df: DataFrame, by: list[str], order: list[str], value: str, reach: int = 1) -> DataFrame:
    """Adds smooth: the mean of the row and its neighbours."""
    return df.withColumn("smooth", F.avg(value).over(_over(by, order).rowsBetween(-reach, reach)))


def recovered_names(df: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Adds original: the source's stem and the row's number among those of the source."""
    from ..functions.paths import stem, suffix

    number = F.row_number().over(_over([source], order)) - 1
    return df.withColumn("original", F.concat(stem(F.col(source)), F.lit("_"), number.cast("string"), suffix(F.col(source))))
