"""Whole plans: from scored records to a selection, with names for what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import rank, select


def final(faces: DataFrame, method: str, target: int = 2000) -> DataFrame:
    """The stratified selection under any of its names: by sharpness, or, faster, by the size of
    the source rectangle. faces hold path, sharpness, rect_area, yaw, pitch and histogram."""
    score = "rect_area" if rank.BEST_N_NAMES[method] else "sharpness"
    chosen = select.best_n(faces, "path", score, "yaw", "pitch", "histogram", target)
    name = F.when(~F.col("is_trash"), paths.numbered(F.col("rank"), F.col("path")))
    return chosen.withColumn("new_name", name)


def sort(faces: DataFrame, method: str, *arguments, **options) -> DataFrame:
    """A sort by its name on the command line."""
    return rank.METHODS[method](faces, *arguments, **options)
