"""Geometry of rectangles, polygons, landmarks and 2x3 affine matrices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import total


def polygon_area(xs: Column, ys: Column) -> Column:
    """The shoelace area of the polygon with these corner coordinates."""
    turned = lambda a: F.concat(F.slice(a, F.size(a), 1), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
    cross = F.zip_with(xs, turned(ys), lambda x, y: x * y)
    back = F.zip_with(ys, turned(xs), lambda y, x: x * y)
    return F.abs(total(cross) - total(back)) * 0.5


def rect_area(l: Column, t: Column, r: Column, b: Column) -> Column:  # noqa: E741
    return polygon_area(F.array(l, r, r, l).cast("array<double>"), F.array(t, t, b, b).cast("array<double>"))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap over union of two (left, top, right, bottom) boxes whose ends are inclusive pixels."""
    side = lambda low, high: F.greatest(F.lit(0.0), high - low + 1)
    both = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    area = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    return both / (area(a) + area(b) - both)


def rescale_rect(rect: tuple[Column, ...], scale: Column) -> tuple[Column, ...]:
    """A detection on the full picture, its bottom lowered by a tenth of its height, in whole pixels."""
    l, t, r, b = (x * scale for x in rect)  # noqa: E741
    return tuple(x.cast("long") for x in (l, t, r, b + (b - t) * 0.1))


def scale_to(longest: Column) -> Column:
    """The side that a picture is shrunk to before detection."""
    return F.greatest(F.lit(64.0), F.when(longest >= 1280, 640.0).otherwise(longest / 2))


def rotate(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    angle = F.radians(degrees)
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def affine(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under the matrix with rows m[0:3] and m[3:6]."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def inverse_affine(m: list[Column]) -> list[Column]:
    """The matrix that undoes m; all zero where m is singular."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    scale = F.when(det != 0, 1 / F.when(det != 0, det)).otherwise(0.0)
    p, q, r, s = e * scale, -b * scale, -d * scale, a * scale
    return [p, q, -(p * c + q * f), r, s, -(r * c + s * f)]


def euler(r: list[list[Column]]) -> tuple[Column, Column, Column]:
    """The angles of a 3x3 rotation matrix; in gimbal lock the third is 0."""
    level = F.sqrt(r[0][0] * r[0][0] + r[1][0] * r[1][0])
    lock = level < 1e-6
    x = F.when(lock, F.atan2(-r[1][2], r[1][1])).otherwise(F.atan2(r[2][1], r[2][2]))
    z = F.when(lock, F.lit(0.0)).otherwise(F.atan2(r[1][0], r[0][0]))
    return x, F.atan2(-r[2][0], level), z


def _x(landmarks: Column, k: int) -> Column:
    return landmarks[k][0]


def averaged_yaw(landmarks: Column) -> Column:
    """How much farther the nose bridge (27 to 29) is from the right jaw than from the left one, on
    average over three heights."""
    bridge, left, right = ([_x(landmarks, k) for k in some] for some in ((27, 28, 29), (0, 1, 2), (16, 15, 14)))
    away = lambda a, b: sum(p - q for p, q in zip(a, b, strict=True)) / 3.0
    return away(right, bridge) - away(bridge, left)


def simple_pitch(landmarks: Column) -> Column:
    """The chin's height less the mean height of the jaw beside it above the chin."""
    chin = landmarks[8][1]
    return chin - ((landmarks[6][1] - chin) + (landmarks[10][1] - chin)) / 2.0


#: Where each of the 68 landmarks goes in a mirrored face.
MIRROR = [
    16, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0,  # jaw
    26, 25, 24, 23, 22, 21, 20, 19, 18, 17,  # brows
    27, 28, 29, 30, 35, 34, 33, 32, 31,  # nose
    45, 44, 43, 42, 47, 46, 39, 38, 37, 36, 41, 40,  # eyes
    54, 53, 52, 51, 50, 49, 48, 59, 58, 57, 56, 55, 64, 63, 62, 61, 60, 67, 66, 65,  # mouth
]


def mirror(landmarks: Column, width: Column) -> Column:
    points = F.transform(F.array(*map(F.lit, MIRROR)), lambda k: F.element_at(landmarks, k + 1))
    return F.transform(points, lambda p: F.array(width - p[0] - 1, p[1]))


def unrotate(x: Column, y: Column, degrees: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """A point found on a picture turned by 90, 180 or 270 degrees, on the picture itself, which is w
    wide and h high."""
    return (
        F.when(degrees == 90, y).when(degrees == 180, w - x).when(degrees == 270, w - y).otherwise(x),
        F.when(degrees == 90, h - x).when(degrees == 180, h - y).when(degrees == 270, x).otherwise(y),
    )


def expand_brows(landmarks: Column, factor: Column) -> Column:
    """Moves each brow point away from the eye by half its distance times the factor. Coordinates
    are whole numbers: cut on the way in and out, rounded down in the middle of two points."""
    whole = F.transform(landmarks, lambda p: F.transform(p, lambda v: v.cast("long")))
    middle = lambda a, b: F.zip_with(a, b, lambda x, y: F.floor((x + y) / 2))
    quarter = lambda eye, jaw: middle(whole[eye], middle(whole[eye], whole[jaw]))
    eyes = F.array(quarter(36, 0), *(whole[k] for k in (36, 37, 38, 39, 42, 43, 44, 45)), quarter(45, 16))
    away = lambda v, eye: (v + factor * 0.5 * (v - eye)).cast("long")
    moved = F.zip_with(F.slice(whole, 18, 10), eyes, lambda p, eye: F.zip_with(p, eye, away))
    return F.concat(F.slice(whole, 1, 17), moved, F.slice(whole, 28, F.size(whole) - 27))


#: The pairs of 98 landmarks whose middles are the inner brow points.
BROW_PAIRS = ((34, 41), (35, 40), (36, 39), (37, 38), (42, 50), (43, 49), (44, 48), (45, 47))
#: The jaw and the landmarks that are taken as they are, of 98.
JAW_98 = (0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 26, 28, 30, 32)
SAME_98 = (
    51, 52, 53, 54, 55, 56, 57, 58, 59,  # nose
    60, 61, 63, 64, 65, 67, 68, 69, 71, 72, 73, 75,  # eyes
    76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89, 90, 91, 92, 93, 94, 95,  # mouth
)


def from_98(points: Column) -> Column:
    """The 68 landmarks of a set of 98: the jaw thinned and smoothed, brows averaged, pupils and
    inner lids' middles left out."""
    mix = lambda weights: F.array(
        *(sum(points[k][c] * w for k, w in weights) for c in (0, 1))
    )
    jaw = [
        mix([(k, 1.0)]) if k % 16 == 0 else mix([(k, 0.5), (k - 1, 0.25), (k + 1, 0.25)]) for k in JAW_98
    ]
    halves = [mix([(a, 0.5), (b, 0.5)]) for a, b in BROW_PAIRS]
    brows = [mix([(33, 1.0)]), *halves, mix([(46, 1.0)])]
    return F.array(*jaw, *brows, *(mix([(k, 1.0)]) for k in SAME_98))


def scale_points(points: Column, factor: Column) -> Column:
    return F.transform(points, lambda p: F.transform(p, lambda v: v * factor))


def with_point(points: Column, n: Column, point: Column) -> Column:
    """The points with one more at place n; an error beyond the last one."""
    count = F.size(points)
    put = F.concat(F.slice(points, 1, n), F.array(point), F.slice(points, n + 1, F.greatest(count - n, F.lit(0))))
    outside = F.raise_error(F.concat(F.lit("no place "), n.cast("string")))
    return F.when((n >= 0) & (n <= count), put).otherwise(outside.cast("array<array<double>>"))


def without_point(points: Column, n: Column) -> Column:
    """The points without the one at place n; an error where there is none."""
    count = F.size(points)
    left = F.concat(F.slice(points, 1, n), F.slice(points, n + 2, F.greatest(count - n - 1, F.lit(0))))
    outside = F.raise_error(F.concat(F.lit("no point "), n.cast("string")))
    return F.when((n >= 0) & (n < count), left).otherwise(outside.cast("array<array<double>>"))


def shown_points(points: Column, undone: Column) -> Column:
    """The points of a polygon whose last ones are undone; as many as there are, at most. Redoing is
    undoing fewer."""
    return F.slice(points, 1, F.greatest(F.size(points) - undone, F.lit(0)))


def identical(a: Column, b: Column) -> Column:
    """Whether two arrays of polygons have equal points in equal order, whatever their types."""
    return F.transform(a, lambda p: p["pts"]) == F.transform(b, lambda p: p["pts"])


def points_count(polygons: Column) -> Column:
    return F.aggregate(polygons, F.lit(0).cast("long"), lambda n, p: n + F.size(p["pts"]))


def include_first(polygons: Column) -> Column:
    """Polygons with those that include (type 1) before those that exclude, else in their order."""
    return F.concat(F.filter(polygons, lambda p: p["type"] == 1), F.filter(polygons, lambda p: p["type"] != 1))
