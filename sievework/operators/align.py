"""Alignment of faces: the similarity that maps landmarks onto a mean face, and what follows from it.

In the complex plane a similarity is z -> a z + t, so its least-squares fit is one division, and the
picture's square is a centre and half a side in the mean face's own coordinates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import scale_points

# The mean face's landmarks 17 to 48 and 54.
MEAN_FACE = (
    (0.000213256, 0.106454), (0.0752622, 0.038915), (0.18113, 0.0187482),
    (0.29077, 0.0344891), (0.393397, 0.0773906), (0.586856, 0.0773906),
    (0.689483, 0.0344891), (0.799124, 0.0187482), (0.904991, 0.038915),
    (0.98004, 0.106454), (0.490127, 0.203352), (0.490127, 0.307009),
    (0.490127, 0.409805), (0.490127, 0.515625), (0.36688, 0.587326),
    (0.426036, 0.609345), (0.490127, 0.628106), (0.554217, 0.609345),
    (0.613373, 0.587326), (0.121737, 0.216423), (0.187122, 0.178758),
    (0.265825, 0.179852), (0.334606, 0.231733), (0.260918, 0.245099),
    (0.182743, 0.244077), (0.645647, 0.231733), (0.714428, 0.179852),
    (0.793132, 0.178758), (0.858516, 0.216423), (0.79751, 0.244077),
    (0.719335, 0.245099), (0.254149, 0.780233), (0.726104, 0.780233),
)
#: Which of 68 landmarks those are.
USED = [*range(17, 49), 54]
#: How much is added around the face, and whether the picture stays upright.
FACE_TYPES = {
    "half_face": (0.0, False),
    "midfull_face": (0.0675, False),
    "full_face": (0.2109375, False),
    "full_face_no_align": (0.2109375, True),
    "whole_face": (0.40, False),
    "head": (0.70, False),
    "head_no_align": (0.70, True),
}


def similarity(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, t) of the best a z + t from each row of source onto target; nan where all points agree."""
    z, w = source - source.mean(-1, keepdims=True), target - target.mean(-1, keepdims=True)
    size = (np.abs(z) ** 2).sum(-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        a = np.where(size > 0, (np.conj(z) * w).sum(-1) / size, np.nan)
    return a, target.mean(-1) - a * source.mean(-1)


def matrices(landmarks: np.ndarray, size: float, face_type: str, scale: float = 1.0) -> np.ndarray:
    """(n, 2, 3): from each face's picture, given 68 landmarks, to its square picture of this size."""
    padding, upright = FACE_TYPES[face_type]
    z = landmarks[..., 0] + 1j * landmarks[..., 1]
    mean = np.array([complex(*p) for p in MEAN_FACE])
    a, t = similarity(z[:, USED], mean)
    half = (padding * np.sqrt(2.0) + 0.5) / scale  # half a side, the mean face being 1 wide
    centre = np.full(len(z), 0.5 + 0.5j)
    if face_type == "whole_face":
        centre = centre - 0.07j
    elif face_type == "head":
        x = (a[:, None] * z + t[:, None]).real
        bridge = x[:, [27, 28, 29]]
        yaw = (x[:, [16, 15, 14]] - bridge).mean(1) - (bridge - x[:, [0, 1, 2]]).mean(1)
        centre = centre + yaw * np.abs(np.tanh(2 * yaw)) / 2 - 0.5j
    corner = half * (1 + 1j)
    if upright:  # the same square, unturned, around the same point of the picture
        grow = size * np.abs(a) / (2 * half) + 0j
        shift = size * (corner / (2 * half)) - grow * (centre - t) / a
    else:
        grow = size * a / (2 * half)
        shift = size * (t - centre + corner) / (2 * half)
    return np.stack([np.stack([grow.real, -grow.imag, shift.real], 1), np.stack([grow.imag, grow.real, shift.imag], 1)], 1)


def align_matrix(landmarks: Column, size: float, face_type: str, scale: float = 1.0) -> Column:
    """The 2x3 matrix of a column of landmarks; null where there are not 68."""

    @F.pandas_udf("array<array<double>>")
    def run(batch: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
        good = [k for k, x in enumerate(batch) if x is not None and len(x) == 68]
        if good:
            points = np.stack([np.stack(batch.iloc[k]) for k in good]).astype(float)
            for k, matrix in zip(good, matrices(points, size, face_type, scale), strict=True):
                out.iloc[k] = matrix.tolist()
        return out

    return run(landmarks)


def rect_of(landmarks: Column) -> Column:
    """(l, t, r, b): the face's upright square in the picture."""
    m = align_matrix(landmarks, 256, "full_face_no_align")
    x = lambda p: ((p - m[0][2]) / m[0][0])  # noqa: E731  an upright matrix has no turn
    y = lambda p: ((p - m[1][2]) / m[1][1])
    return F.struct(x(0.0).alias("l"), y(0.0).alias("t"), x(255.0).alias("r"), y(255.0).alias("b"))


def resized(faces: DataFrame, size: int, face_type: str | None = None) -> DataFrame:
    """The annotations of faces for pictures of another size, or, with a type, aligned anew.

    faces hold shape, landmarks, source_landmarks, seg_ie_polys, image_to_face_mat and face_type.
    Pictures that are not square are an error. Pixels are not touched.
    """
    width = F.col("shape")["w"]
    square = F.when(F.col("shape")["h"] == width, width).otherwise(F.raise_error(F.lit("w != h")).cast("int"))
    out = faces.withColumn("_w", square)
    if face_type is None:
        factor = F.lit(float(size)) / F.col("_w")
        move = lambda points: scale_points(points, factor)
        kinds = list(FACE_TYPES)
    else:
        out = out.withColumn("_m", align_matrix(F.col("landmarks"), size, face_type))
        row = lambda p, k: F.col("_m")[k][0] * p[0] + F.col("_m")[k][1] * p[1] + F.col("_m")[k][2]
        move = lambda points: F.transform(points, lambda p: F.array(row(p, 0), row(p, 1)))
        kinds = [face_type]
        out = out.withColumn("face_type", F.lit(face_type))
    polygon = lambda p: F.struct(p["type"].alias("type"), move(p["pts"]).cast("array<array<float>>").alias("pts"))
    out = out.withColumn("landmarks", move(F.col("landmarks"))).withColumn("seg_ie_polys", F.transform("seg_ie_polys", polygon))
    anew = F.lit(None).cast("array<array<double>>")
    for kind in kinds:
        anew = F.when(F.col("face_type") == kind, align_matrix(F.col("source_landmarks"), size, kind)).otherwise(anew)
    side = F.lit(size)
    return (
        out.withColumn("image_to_face_mat", F.when(F.col("image_to_face_mat").isNotNull(), anew))
        .withColumn("shape", F.struct(side.alias("h"), side.alias("w"), F.col("shape")["c"].alias("c")))
        .drop("_w", "_m")
    )
