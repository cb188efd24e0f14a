"""Stratified best-N selection and seeded sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays

YAW_BUCKETS = 128


def quota(df: DataFrame, group: str, target: int, buckets: int = YAW_BUCKETS) -> DataFrame:
    """One row with q: the share of a bucket, raised by what small buckets leave over."""
    base = round(target / buckets)
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    short = F.coalesce(F.sum(F.greatest(F.lit(base) - F.col("n"), F.lit(0))), F.lit(0))
    empty = (F.lit(buckets) - F.count("*")) * base
    return counts.agg((F.lit(base) + F.floor((short + empty) / buckets)).cast("int").alias("q"))


def best_n(
    df: DataFrame, id_col: str, sharpness: str, yaw: str, pitch: str, histogram: str, target: int = 2000
) -> DataFrame:
    """The best target rows spread over yaw and pitch: id, yaw_bucket, pitch_bucket, is_trash, rank.

    Rows fall in 128 yaw buckets by -yaw; each keeps its ten times q sharpest. Those fall in q pitch
    buckets; in each cell the rows least like the others (greatest sum of histogram distances) come
    first, ties by sharpness. Buckets then take q rows in rounds over their cells. Rows that lack a
    score are rejected. rank numbers the kept rows by (yaw bucket, round, pitch bucket).

    A cell holds at most 10 q rows, a bound set by the target, so comparing a cell's rows pairwise
    is bounded; the rows before that are only ranked within yaw buckets.
    """
    whole = F.col(sharpness).isNotNull() & F.col(yaw).isNotNull() & F.col(pitch).isNotNull() & F.col(histogram).isNotNull()
    rows = df.where(whole).select(
        F.col(id_col).alias("id"),
        F.col(sharpness).cast("double").alias("sharp"),
        F.col(pitch).cast("double").alias("pitch"),
        F.col(histogram).alias("hist"),
        arrays.bucket(-F.col(yaw), arrays.YAW_EDGES).alias("g"),
    )
    q = quota(rows, "g", target).first()["q"]
    best = Window.partitionBy("g").orderBy(F.desc("sharp"), "id")
    top = rows.withColumn("r1", F.row_number().over(best)).where(F.col("r1") <= 10 * q).drop("r1")
    top = top.withColumn("pg", arrays.bucket(F.col("pitch"), arrays.pitch_edges(q)) if q > 0 else F.lit(0))
    scores = unlikeness(top, "id", "hist", ["g", "pg"])
    cell = Window.partitionBy("g", "pg").orderBy(F.desc("apart"), F.desc("sharp"), "id")
    rounds = Window.partitionBy("g").orderBy("r2", "pg")
    taken = top.join(scores, "id").withColumn("r2", F.row_number().over(cell))
    taken = taken.withColumn("k", F.row_number().over(rounds)).where(F.col("k") <= q)
    # at most target rows and one bucket's share are ranked together
    order = Window.orderBy("g", "k")
    kept = taken.select("id", "pg", (F.row_number().over(order) - 1).cast("long").alias("rank"))
    out = df.select(F.col(id_col).alias("id"), arrays.bucket(-F.col(yaw), arrays.YAW_EDGES).alias("yaw_bucket"))
    out = out.join(kept, "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        "yaw_bucket",
        F.col("pg").alias("pitch_bucket"),
        F.col("rank").isNull().alias("is_trash"),
        "rank",
    )


def unlikeness(df: DataFrame, id_col: str, histogram: str, groups: list[str] = [], digits: int = 9, side: int = 2048) -> DataFrame:  # noqa: B006
    """(id, apart): the sum of the histogram distances to all others of the group, without groups to
    all others of the table.

    Groups are cut into blocks of a bounded number of rows; a task compares two blocks with matrix
    products and gives one partial sum a row, so pairs are never rows. Sums are rounded, so that
    equal sums compare equal however they were added up.
    """
    import numpy as np
    import pandas as pd

    rows = df.select(F.col(id_col).alias("id"), F.col(histogram).cast("array<double>").alias("hist"), *groups)
    counts = rows.groupBy(*groups).agg(F.ceil(F.count("*") / side).cast("int").alias("parts"))
    if groups:
        both = reduce(lambda x, y: x & y, [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups])
        met = rows.alias("a").join(counts.alias("b"), both).select("a.*", "b.parts")
    else:
        met = rows.crossJoin(F.broadcast(counts))  # a single row
    met = met.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    keys = [*groups, "i", "j"]

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        hist = np.stack(block["hist"].to_numpy())
        sums = hist.sum(1)
        unit = np.sqrt(np.divide(hist, sums[:, None], out=np.zeros_like(hist), where=sums[:, None] > 0))
        unit[sums <= 0] = np.nan  # an empty histogram is at no distance from any
        part, i, j = block["part"].to_numpy(), block["i"].iloc[0], block["j"].iloc[0]
        one, two = unit[part == i], unit[part == j]
        apart = np.sqrt(np.maximum(0.0, 1.0 - np.nan_to_num(one @ two.T, nan=1.0)))
        if i == j:
            np.fill_diagonal(apart, 0.0)
        found = np.empty(len(block))
        found[part == j] = apart.sum(0)
        found[part == i] = apart.sum(1)
        return pd.DataFrame({"id": block["id"], "apart": found})

    kind = rows.schema["id"].dataType.simpleString()
    partial = met.groupBy(*keys).applyInPandas(compare, f"id {kind}, apart double")
    return partial.groupBy("id").agg(F.round(F.sum("apart"), digits).alias("apart"))


def draw(seed: int, *columns: str | Column) -> Column:
    """A draw that depends on the row alone, so that a task that runs again draws the same: the MD5 of
    the seed and the columns' texts, as hexadecimal digits."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def uniform(drawn: Column) -> Column:
    """A draw as a number in [0, 1): its first 48 bits."""
    return F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") / float(1 << 48)


def truncated_normal(seed: int, *columns: str, most: float = 2.5, attempts: int = 12) -> Column:
    """A normal draw by rejection, from -most to most, divided by most: the first of the attempts that
    lies inside (all but one row in 10^22 have one; that one has 0)."""
    found = []
    for k in range(attempts):
        a, b = (uniform(draw(seed, F.lit(k), F.lit(side), *columns)) for side in (0, 1))
        x = F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * F.pi() * b)
        found.append(F.when(F.abs(x) <= most, x / most))
    return F.coalesce(*found, F.lit(0.0))


def epoch_shuffle(df: DataFrame, id_col: str, seed: int, epochs: int = 1) -> DataFrame:
    """(id, epoch, position): every epoch has all rows once, each in an order of its own."""
    from .rank import global_rank

    rows = df.select(F.col(id_col).alias("id"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("_draw", draw(seed, "epoch", "id"))
    ranked = global_rank(rows, ["epoch", "_draw", "id"], "_at")
    first = ranked.groupBy("epoch").agg(F.min("_at").alias("_first"))
    placed = ranked.join(F.broadcast(first), "epoch")  # one row per epoch
    return placed.select(F.col("id").alias(id_col), "epoch", (F.col("_at") - F.col("_first")).alias("position"))


def stratified(df: DataFrame, id_col: str, stratum: str, seed: int, salts: int = 64) -> DataFrame:
    """(id, stratum, turn, position): strata take turns; each gives its rows in a shuffled order.

    turn is the row's place in its stratum. Strata are ranked in salted parts first, by ranges of
    the draw, so that one large stratum is not one task.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(stratum).alias("stratum"))
    rows = rows.withColumn("_draw", draw(seed, "id"))
    rows = rows.withColumn("_part", F.floor(uniform(F.col("_draw")) * salts).cast("int"))
    inner = Window.partitionBy("stratum", "_part").orderBy("_draw", "id")
    sizes = rows.groupBy("stratum", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("stratum").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("stratum").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")
    )
    ranked = rows.withColumn("_w", F.row_number().over(inner) - 1)
    ranked = ranked.join(offsets, F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return ranked.select(F.col("id").alias(id_col), "stratum", (F.col("_w") + F.col("_o")).cast("long").alias("turn"))


def batches(df: DataFrame, position: str, size: int, value: str) -> DataFrame:
    """(batch, members): whole batches of consecutive positions, in order."""
    numbered = df.withColumn("batch", F.floor(F.col(position) / size))
    grouped = numbered.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(position, value))).alias("m"))
    return grouped.where(F.size("m") == size).select("batch", F.transform("m", lambda x: x[value]).alias("members"))


def dealt(df: DataFrame, position: str, workers: int) -> DataFrame:
    """Adds worker and turn: positions go round the workers."""
    at = F.col(position)
    return df.withColumn("worker", F.pmod(at, F.lit(workers)).cast("int")).withColumn("turn", F.floor(at / workers))


def partners(first: DataFrame, second: DataFrame, first_id: str, second_id: str, seed: int) -> DataFrame:
    """(first_id, partner): rows of one set with rows of another, both in orders of their own. The
    second set starts anew, in another order, whenever it is used up, so that no row of it is used more
    than once oftener than another."""
    many, others = first.count(), second.count()
    own = epoch_shuffle(first, first_id, seed).select(first_id, "position")
    rounds = -(-many // others) if others else 0
    again = epoch_shuffle(second.select(F.col(second_id).alias("_other")), "_other", seed + 1, max(1, rounds))
    again = again.select(F.col("_other").alias("partner"), (F.col("epoch") * others + F.col("position")).alias("position"))
    return own.join(again, "position", "left").select(first_id, "partner")


def index_lists(df: DataFrame, group: str, id_col: str) -> DataFrame:
    """(group, place, id): the members of each group numbered in order of their ids, a row each, so
    that no group is gathered."""
    from .rank import global_rank

    ranked = global_rank(df.select(F.col(group).alias("_g"), F.col(id_col).alias("_id")), ["_g", "_id"], "_at")
    first = ranked.groupBy(F.col("_g").alias("_first_of")).agg(F.min("_at").alias("_first"))
    placed = ranked.join(first, F.col("_g").eqNullSafe(F.col("_first_of")))
    return placed.select(F.col("_g").alias(group), (F.col("_at") - F.col("_first")).alias("place"), F.col("_id").alias(id_col))
