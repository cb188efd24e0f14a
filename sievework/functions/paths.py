"""Path expressions: pure string functions, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffixes of pictures.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".tif", ".tiff")


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """The last part without its suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(name(path), r".(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)/+[^/]*/*$", 1)


def parent_name(path: Column) -> Column:
    return name(parent(path))


def is_image(path: Column, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> Column:
    return F.lower(suffix(path)).isin(*suffixes)


def numbered(number: Column, path: Column) -> Column:
    """The name %05d with the path's suffix: five digits, or as many as the number has."""
    return F.concat(F.format_string("%05d", number.cast("long")), suffix(path))


def frame_and_face(path: Column) -> Column:
    """(frame, face) of names such as 00012_1.jpg; null where a name has another form."""
    parts = F.regexp_extract(stem(path), r"^(\d+)_(\d+)$", 0)
    split = F.split(parts, "_")
    both = F.struct(split[0].cast("long").alias("frame"), F.try_element_at(split, F.lit(2)).cast("long").alias("face"))
    return F.when(parts != "", both)


def id_and_mask(path: Column) -> Column:
    """(id, mask type) of stems such as 00012_left_eye, split at the first underscore."""
    split = F.split(stem(path), "_", 2)
    return F.when(F.size(split) == 2, F.struct(split[0].alias("id"), split[1].alias("mask_type")))
