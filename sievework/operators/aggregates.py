"""Aggregates and their finishing steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import nearest_known, running_sum


def persons(df: DataFrame, column: str) -> DataFrame:
    """persons: how many different names there are; none at all is one of them."""
    named = F.countDistinct(column)
    nameless = F.max(F.when(F.col(column).isNull(), 1).otherwise(0))
    return df.agg((named + F.coalesce(nameless, F.lit(0))).alias("persons"))


def masks_by_id(df: DataFrame, id_col: str, kind: str, path: str) -> DataFrame:
    """(id, masks): a map from mask type to path for each id; of repeated types the last path."""
    last = df.groupBy(id_col, kind).agg(F.max(path).alias("_path"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(kind), F.col("_path"))))
    return last.groupBy(id_col).agg(F.map_from_entries(entries).alias("masks"))


def colour_stats(df: DataFrame, by: list[str], channels: list[str], mask: Column | None = None) -> DataFrame:
    """Mean and population deviation of each channel: where fewer than 10 rows pass the mask both
    are null, and below 100 they are fixed at 0 and 1."""
    inside = F.lit(True) if mask is None else mask
    n = F.count(F.when(inside, 1))
    out = [n.alias("n")]
    for c in channels:
        value = F.when(inside, F.col(c))
        for name, found, fixed in ((f"{c}_mean", F.avg(value), 0.0), (f"{c}_std", F.stddev_pop(value), 1.0)):
            out.append(F.when(n < 10, F.lit(None)).when(n < 100, F.lit(fixed)).otherwise(found).alias(name))
    return df.groupBy(*by).agg(*out)


def covariances(df: DataFrame, by: list[str], channels: list[str], eps: float = 0.0) -> DataFrame:
    """The upper triangle of the channels' covariance matrix, eps added on the diagonal."""
    pairs = [(a, b) for k, a in enumerate(channels) for b in channels[k:]]
    found = [(F.covar_pop(a, b) + (eps if a == b else 0.0)).alias(f"cov_{a}_{b}") for a, b in pairs]
    return df.groupBy(*by).agg(*found)


def cumulative_share(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, share): the share of rows at or below each distinct value. Distinct values are summed
    up in ranges (rank.running_sum), so that those of one group need not be in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_count"))
    summed = running_sum(counts, [*by, value], "_count", "_up")
    groups = summed.groupBy(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)])
    groups = groups.agg(F.min(F.col("_up") - F.col("_count")).alias("_from"), F.sum("_count").alias("_all"))
    if by:
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by)])
        joined = summed.join(groups, same)
    else:
        joined = summed.crossJoin(F.broadcast(groups))  # one row
    return joined.select(*by, value, ((F.col("_up") - F.col("_from")) / F.col("_all")).alias("share"))


def matched(source: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """(value, matched): each distinct source value with the target value at the same share,
    linearly interpolated between target steps and constant beyond them. Both tables hold one row
    per distinct value; the target steps around a share are found in ranges of the shares of both."""
    a = cumulative_share(source, [], value).select(F.col(value).cast("double").alias("value"), "share")
    b = cumulative_share(target, [], value).select(F.col(value).cast("double").alias("to"), "share")
    both = a.withColumn("to", F.lit(None).cast("double")).unionByName(b.withColumn("value", F.lit(None).cast("double")))
    both = both.withColumn("_later", F.col("to").isNull()).withColumn("_step", F.when(F.col("to").isNotNull(), F.struct("share", "to")))
    found = nearest_known(both, ["share", "_later", "to", "value"], "_step", "_a", "_b").where(F.col("to").isNull())
    x, low, high = F.col("share"), F.col("_a"), F.col("_b")
    between = low["to"] + (high["to"] - low["to"]) * (x - low["share"]) / (high["share"] - low["share"])
    value_of = F.when(low.isNull(), high["to"]).when(high.isNull(), low["to"]).when(high["share"] == x, high["to"]).otherwise(between)
    return found.select(F.col("value").alias(value), value_of.alias("matched"))


def every_kth(df: DataFrame, position: str, most: int = 100_000, aim: int = 50_000) -> DataFrame:
    """Thins a long series: with more than most rows, every k-th one, k = rows // aim."""
    k = df.agg(F.when(F.count("*") > most, F.floor(F.count("*") / aim)).otherwise(1).alias("_k"))
    return df.crossJoin(F.broadcast(k)).where(F.pmod(F.col(position), F.col("_k")) == 0).drop("_k")  # one row


def columns_of(df: DataFrame, position: str, value: str, width: int) -> DataFrame:
    """(column, low, high): least and greatest value of each of width equal stretches of positions."""
    n = df.agg((F.max(position) + 1).alias("_n"))
    column = F.floor(F.col(position) * width / F.col("_n")).alias("column")
    placed = df.crossJoin(F.broadcast(n)).select(column, value)  # one row
    return placed.groupBy("column").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def bounding_box(df: DataFrame, by: list[str], x: str, y: str, value: str, least: float = 0.1) -> DataFrame:
    """The box around the positions with a value of at least this; ids with under 4 have none."""
    inside = df.where(F.col(value) >= least).groupBy(*by)
    found = inside.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in (x, y) for k, f in (("min", F.min), ("max", F.max))])
    return found.where("n >= 4")


def value_counts(df: DataFrame, by: list[str], values: str) -> DataFrame:
    """(by, value, n): how often each value is in the arrays, as the bars of a histogram that has them.
    Values are counted where they are before anything is shuffled."""
    return df.select(*by, F.explode(values).alias("value")).groupBy(*by, "value").agg(F.count("*").alias("n"))


def scale_of(df: DataFrame, position: str, value: str) -> DataFrame:
    """One row with scale: twice the mean of all but the first fifth of the series."""
    n = df.agg((F.max(position) + 1).alias("_n"))
    late = df.crossJoin(F.broadcast(n)).where(F.col(position) >= F.floor(F.col("_n") / 5))  # one row
    return late.agg((F.avg(value) * 2).alias("scale"))


def mean_of_shifted(df: DataFrame, by: list[str], x: str, y: str, dx: str, dy: str) -> DataFrame:
    """The mean of positions that were found on shifted pictures, each put back by its shift."""
    return df.groupBy(*by).agg(F.avg(F.col(x) + F.col(dx)).alias(x), F.avg(F.col(y) + F.col(dy)).alias(y))


def moments(df: DataFrame, channels: list[str]) -> tuple[list[float], list[list[float]]]:
    """Means and the sample covariance matrix of a few channels: a bounded number of sums."""
    means = [F.avg(c) for c in channels]
    both = [F.covar_samp(a, b) for a in channels for b in channels]
    row = list(df.agg(*[x.alias(f"c{k}") for k, x in enumerate([*means, *both])]).first())
    size = len(channels)
    return row[:size], [row[size + size * k : 2 * size + size * k] for k in range(size)]


def recoloured(source: DataFrame, target: DataFrame, channels: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """source with its channels mapped linearly so that they have target's means and covariances, by the
    map that moves them least, then clipped. Two small sets of sums reach the driver; the map itself is a
    column expression."""
    import numpy as np

    def root(matrix, power):
        values, vectors = np.linalg.eigh(matrix)
        return vectors @ np.diag(np.maximum(values, np.finfo(float).eps) ** power) @ vectors.T

    (mean, a), (aim, b) = moments(source, channels), moments(target, channels)
    half, back = root(np.array(a, float), 0.5), root(np.array(a, float), -0.5)
    moved = back @ root(half @ np.array(b, float) @ half, 0.5) @ back
    new = {
        c: F.least(F.lit(high), F.greatest(F.lit(low), sum(((F.col(d) - mean[k]) * float(moved[k, j]) for k, d in enumerate(channels)), F.lit(aim[j]))))
        for j, c in enumerate(channels)
    }
    return source.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in source.columns])


def dominant_cluster(df: DataFrame, channels: list[str], k: int = 3, seed: int = 7) -> DataFrame:
    """One row: n, and mean and population deviation of each channel in the largest of k clusters; of
    equally large ones the first. With under 100 rows fixed values: 50, then 0; 20, then 10."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in channels]).na.drop()
    if rows.limit(100).count() < 100:
        fixed = [(f"{c}_{kind}", first if j == 0 else rest) for kind, first, rest in (("mean", 50.0, 0.0), ("std", 20.0, 10.0)) for j, c in enumerate(channels)]
        return df.agg(F.count("*").alias("n")).select("n", *[F.lit(value).alias(name) for name, value in fixed])
    points = rows.withColumn("_point", array_to_vector(F.array(*channels)))
    model = KMeans(k=k, seed=seed, featuresCol="_point", predictionCol="_cluster", maxIter=20).fit(points)
    sums = model.transform(points).groupBy("_cluster").agg(
        F.count("*").alias("n"), *[f(c).alias(f"{c}_{kind}") for kind, f in (("mean", F.avg), ("std", F.stddev_pop)) for c in channels]
    )
    return sums.orderBy(F.desc("n"), "_cluster").limit(1).drop("_cluster")
