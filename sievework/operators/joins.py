"""Joins of frames, faces, masks and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frames_with_faces(frames: DataFrame, faces: DataFrame, frame_key: str, face_key: str, fields: list[str]) -> DataFrame:
    """Every frame with the array of its faces, sorted by the fields, empty where there is none, and
    whether it has several. Faces without a source are left out."""
    face = F.struct(*fields)
    grouped = faces.where(F.col(face_key).isNotNull()).groupBy(F.col(face_key).alias("_key"))
    grouped = grouped.agg(F.array_sort(F.collect_list(face)).alias("faces"))
    joined = frames.join(grouped, frames[frame_key] == F.col("_key"), "left").drop("_key")
    kind = grouped.schema["faces"].dataType
    faces_or_none = F.coalesce(F.col("faces"), F.array().cast(kind))
    return joined.withColumn("faces", faces_or_none).withColumn("multiple", F.size("faces") > 1)


def missing(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left without a partner: deleted frames, images without masks or annotations."""
    keys = right.select(F.col(right_key).alias("_key"))
    return left.join(keys, left[left_key] == F.col("_key"), "left_anti")


def annotated(images: DataFrame, boxes: DataFrame, key: str, least: int = 128) -> DataFrame:
    """Images with their boxes, boxes with a side below least left out."""
    return images.join(boxes.where(F.least("w", "h") >= least), key)


def restored(files: DataFrame, saved: DataFrame, key: str, shape: str) -> DataFrame:
    """Files with their saved metadata, and whether the picture has to be resized for it."""
    held = saved.withColumnRenamed(shape, "saved_shape")
    return files.join(held, key).withColumn("needs_resize", ~F.col(shape).eqNullSafe(F.col("saved_shape")))


def pending_frames(frames: DataFrame, done: DataFrame, outputs: DataFrame, position: str) -> DataFrame:
    """What a resumed run has to do: frames without output, and, from one before the first done
    frame whose output is missing, all frames."""
    lost = done.join(outputs, position, "left_anti").agg((F.min(position) - 1).alias("_rewind"))
    state = frames.join(done.select(position, F.lit(True).alias("_done")), position, "left")
    state = state.crossJoin(F.broadcast(lost))  # one row
    again = F.coalesce(F.col(position) > F.col("_rewind"), F.lit(False))
    return state.where(F.col("_done").isNull() | again).drop("_done", "_rewind")


def from_last(outputs: DataFrame, frames: DataFrame, key: str, back: int = 128) -> DataFrame:
    """The frames from the one of the back-th last output on; all, if there are fewer outputs."""
    tail = outputs.orderBy(F.desc(key)).limit(back).agg(F.count("*").alias("_n"), F.min(key).alias("_from"))
    start = F.when(F.col("_n") == back, F.col("_from"))
    joined = frames.crossJoin(F.broadcast(tail.select(start.alias("_from"))))  # one row
    return joined.where(F.col("_from").isNull() | (F.col(key) >= F.col("_from"))).drop("_from")
