"""Scores that are computed from decoded pictures, and the pose of a head from its landmarks.

A picture is (height, width, channels, data) with eight-bit rows of blue, green, red, as sources.files.decoded
gives it. Every score is one narrow pass over rows, with no shuffle. A picture is as large as it is: where
many meet in one Arrow batch, spark.sql.execution.arrow.maxBytesPerBatch bounds what a worker holds. Pictures
without pixels, with sizes that do not fit their data, or with a null part score null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of the hull, as landmarks of 68; each part is filled as its convex hull.
HULL_PARTS = (
    (*range(0, 9), 17),
    (*range(8, 17), 26),
    (17, 18, 19, 8),
    (24, 25, 26, 8),
    (*range(19, 25), 8),
    (*range(17, 22), 27, *range(31, 36), 8),
    (*range(22, 27), 27, *range(31, 36), 8),
    (*range(27, 31), *range(31, 36)),
)

# The head's landmarks 0 to 26 and 30 to 35 in three dimensions.
HEAD = (
    (-73.393523, -29.801432, 47.667532), (-72.775014, -10.949766, 45.909403), (-70.533638, 7.929818, 44.842580),
    (-66.850058, 26.074280, 43.141114), (-59.790187, 42.564390, 38.635298), (-48.368973, 56.481080, 30.750622),
    (-34.121101, 67.246992, 18.456453), (-17.875411, 75.056892, 3.609035), (0.098749, 77.061286, -0.881698),
    (17.477031, 74.758448, 5.181201), (32.648966, 66.929021, 19.176563), (46.372358, 56.311389, 30.770570),
    (57.343480, 42.419126, 37.628629), (64.388482, 25.455880, 40.886309), (68.212038, 6.990805, 42.281449),
    (70.486405, -11.666193, 44.142567), (71.375822, -30.365191, 47.140426), (-61.119406, -49.361602, 14.254422),
    (-51.287588, -58.769795, 7.268147), (-37.804800, -61.996155, 0.442051), (-24.022754, -61.033399, -6.606501),
    (-11.635713, -56.686759, -11.967398), (12.056636, -57.391033, -12.051204), (25.106256, -61.902186, -7.315098),
    (38.338588, -62.777713, -1.022953), (51.191007, -59.302347, 5.349435), (60.053851, -50.190255, 11.615746),
    (1.226783, -8.414541, -36.948060), (-14.772472, 2.598255, -20.132003), (-7.180239, 4.751589, -23.536684),
    (0.555920, 6.562900, -25.944448), (8.272499, 4.661005, -23.695741), (15.214351, 2.643046, -20.858157),
)
#: Which of 68 landmarks those are.
HEAD_USED = [*range(27), *range(30, 36)]


def pixels_of(picture) -> np.ndarray | None:
    """(height, width, channels) bytes of a picture's struct, or None where they do not fit."""
    h, w, c, data = picture["height"], picture["width"], picture["channels"], picture["data"]
    if any(x is None or pd.isna(x) for x in (h, w, c)) or data is None or min(h, w, c) < 1 or len(data) != h * w * c:
        return None
    return np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c))


# Colours


def hue_of(image: np.ndarray) -> np.ndarray:
    """Hue in steps of two degrees (0 to 179) of blue, green, red bytes.

    The scale of a spread is rounded to 1/4096 first, as eight-bit conversions do."""
    b, g, r = (image[..., k].astype(np.int64) for k in range(3))
    top = np.maximum(np.maximum(b, g), r)
    spread = top - np.minimum(np.minimum(b, g), r)
    part = np.where(top == r, g - b, np.where(top == g, b - r + 2 * spread, r - g + 4 * spread))
    scale = np.rint(30 * 4096 / np.maximum(spread, 1)).astype(np.int64)
    hue = np.where(spread > 0, (part * scale + 2048) >> 12, 0)
    return np.where(hue < 0, hue + 180, hue)


def colour_scores(picture: Column) -> Column:
    """(brightness, hue, black): the means of HSV's value and hue, and how many bytes are 0.

    Pictures of one channel are grey: hue 0. A fourth channel counts for black alone."""

    @F.pandas_udf("brightness double, hue double, black long")
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in batch.to_dict("records"):
            image = pixels_of(row)
            if image is None:
                out.append((None, None, None))
                continue
            three = image[..., :3] if image.shape[2] >= 3 else np.repeat(image[..., :1], 3, 2)
            out.append((float(three.max(2).mean()), float(hue_of(three).mean()), int((image == 0).sum())))
        made = pd.DataFrame(out, columns=["brightness", "hue", "black"])
        return made.astype({"brightness": "float64", "hue": "float64", "black": "Int64"})

    return run(picture)


def channel_histograms(picture: Column) -> Column:
    """An array of 256 counts for each channel."""

    @F.pandas_udf("array<array<long>>")
    def run(batch: pd.DataFrame) -> pd.Series:
        out = []
        for row in batch.to_dict("records"):
            image = pixels_of(row)
            out.append(None if image is None else [np.bincount(image[..., k].ravel(), minlength=256).tolist() for k in range(image.shape[2])])
        return pd.Series(out, dtype=object)

    return run(picture)


# Blur


def _mirrored(size: int, beyond: int) -> np.ndarray:
    """The positions from -beyond to size + beyond, mirrored at the first and the last one."""
    place = np.arange(-beyond, size + beyond)
    if size == 1:
        return np.zeros_like(place)
    place = np.mod(place, 2 * (size - 1))
    return np.minimum(place, 2 * (size - 1) - place)


def laplacian(image: np.ndarray, side: int = 11) -> np.ndarray:
    """The sum of the second derivatives of each channel, smoothed by binomials of this odd side."""
    smooth, bend = np.ones(1), np.array([1.0, -2.0, 1.0])
    for k in range(side - 1):
        smooth = np.convolve(smooth, [1.0, 1.0])
        if k < side - 3:
            bend = np.convolve(bend, [1.0, 1.0])
    wide = image.astype(np.float64)[_mirrored(image.shape[0], side // 2)][:, _mirrored(image.shape[1], side // 2)]

    def along(rows, weights, axis):
        return np.lib.stride_tricks.sliding_window_view(rows, side, axis) @ weights

    return along(along(wide, bend, 0), smooth, 1) + along(along(wide, smooth, 0), bend, 1)


def _hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of whole-numbered points, in order."""
    rows = np.unique(points, axis=0)
    if len(rows) < 3:
        return rows
    sides = []
    for ordered in (rows, rows[::-1]):
        chain: list[np.ndarray] = []
        for p in ordered:
            while len(chain) > 1 and np.linalg.det(np.stack([chain[-1] - chain[-2], p - chain[-1]]).astype(float)) <= 0.5:
                chain.pop()
            chain.append(p)
        sides += chain[:-1]
    return np.array(sides)


def fill_hull(mask: np.ndarray, points: np.ndarray) -> None:
    """Sets the pixels of the convex hull of these points: those within and those on its outline."""
    corners = _hull(points)
    height, width = mask.shape
    following = np.roll(corners, -1, 0)
    for p, q in zip(corners, following, strict=True):
        n = max(1, int(np.abs(q - p).max()))
        line = np.floor(p + np.arange(n + 1)[:, None] * ((q - p) / n) + 0.5).astype(np.int64)
        line = line[(line >= 0).all(1) & (line[:, 0] < width) & (line[:, 1] < height)]
        mask[line[:, 1], line[:, 0]] = True
    if len(corners) < 3:
        return
    low, high = np.maximum(corners.min(0), 0), np.minimum(corners.max(0) + 1, [width, height])
    if (low >= high).any():
        return
    y, x = np.mgrid[low[1] : high[1], low[0] : high[0]]
    within = np.ones(x.shape, bool)
    for p, q in zip(corners, following, strict=True):
        within &= (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= 0
    mask[low[1] : high[1], low[0] : high[0]] |= within


def hull_mask(height: int, width: int, landmarks: np.ndarray) -> np.ndarray:
    """Which pixels the face covers, from 68 landmarks whose brows are already expanded."""
    mask = np.zeros((height, width), bool)
    whole = np.trunc(landmarks).astype(np.int64)
    for part in HULL_PARTS:
        fill_hull(mask, whole[list(part)])
    return mask


def _given(points) -> np.ndarray | None:
    """68 landmarks as (68, 2) finite numbers, or None."""
    if points is None or len(points) != 68 or any(p is None or len(p) != 2 for p in points):
        return None
    held = np.array([list(p) for p in points], np.float64)
    return held if np.isfinite(held).all() and np.abs(held).max() < 1e6 else None


def _scored(measure, picture: Column, landmarks: Column | None) -> Column:
    """What a function of (height, width, channels) bytes gives for each picture, cut out by its landmarks."""

    def score(row, points, masked):
        image = pixels_of(row)
        if image is None:
            return None
        if masked:
            held = _given(points)
            if held is None:
                return 0.0
            image = image * hull_mask(*image.shape[:2], held)[..., None]
        return float(measure(image))

    @F.pandas_udf("double")
    def plain(batch: pd.DataFrame) -> pd.Series:
        return pd.Series([score(row, None, False) for row in batch.to_dict("records")], dtype="float64")

    @F.pandas_udf("double")
    def within(batch: pd.DataFrame, points: pd.Series) -> pd.Series:
        return pd.Series([score(row, p, True) for row, p in zip(batch.to_dict("records"), points, strict=True)], dtype="float64")

    return plain(picture) if landmarks is None else within(picture, landmarks)


def laplacian_variance(picture: Column, landmarks: Column | None = None, side: int = 11) -> Column:
    """The population variance of the Laplacian over all pixels and channels: low where a picture is
    blurred. With landmarks (brows expanded by geometry.expand_brows) what lies outside the face is black
    before that; a picture without 68 of them scores 0, as a picture that holds no face."""
    return _scored(lambda image: laplacian(image, side).var(), picture, landmarks)


# Sharpness

# The side of a block, the share of edges that makes it count, the widths that are just
# noticed at a contrast up to 50 and beyond, the exponent, and the percent below which blur is not seen.
BLOCK, EDGES, WIDTHS, EXPONENT, UNSEEN = 64, 0.002, (5.0, 3.0), 3.6, 64
#: The longest slope that is followed to each side of an edge.
SLOPE = 100


def grey_of(image: np.ndarray) -> np.ndarray:
    """The luma of blue, green, red bytes, weighed in parts of 32768; of fewer channels the first."""
    if image.shape[2] < 3:
        return image[..., 0].astype(np.float64)
    weighed = image[..., :3].astype(np.int64) @ np.array([3735, 19235, 9798])
    return ((weighed + 16384) >> 15).astype(np.float64)


def _run(step: np.ndarray) -> np.ndarray:
    """How many steps in a row hold up to each place, along rows; one place more than steps, as the first has none."""
    holds = np.pad(step, ((0, 0), (1, 0)))
    place = np.arange(holds.shape[1])
    return place - np.maximum.accumulate(np.where(holds, 0, place), 1)


def upright_edges(grey: np.ndarray) -> np.ndarray:
    """Where the sideways derivative is strong and greater than beside or above it."""
    wide = np.pad(grey, 1, mode="symmetric")
    down = wide[:-2] + 2 * wide[1:-1] + wide[2:]
    strong = ((down[:, 2:] - down[:, :-2]) / 8) ** 2
    strong[strong <= 2 * np.sqrt(strong.mean())] = 0
    around = np.pad(strong, 1)
    peak = lambda a, b: (strong > a) & (strong > b)
    return peak(around[1:-1, :-2], around[1:-1, 2:]) | peak(around[:-2, 1:-1], around[2:, 1:-1])


def edge_widths(grey: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The length of the slope through each edge that rises or falls along its row; elsewhere 0."""
    widths = np.zeros(grey.shape)
    if min(grey.shape) < 3:
        return widths
    up, aside = np.gradient(grey)
    angle = np.where(aside != 0, np.arctan2(up, aside), 0.0)
    if not angle.any():
        return widths
    eighth = np.abs(np.rint(np.degrees(angle) / 45))
    step = np.diff(grey, axis=1)

    def both(rising):
        """The slope from the pixels beside each one outwards, each way."""
        left = np.minimum(_run(rising), SLOPE)[:, :-2]
        right = np.minimum(_run(rising[:, ::-1])[:, ::-1], SLOPE)[:, 2:]
        return (left + right + 2)[1:-1]

    inner = slice(1, -1)
    kind = np.where(edges[inner, inner], eighth[inner, inner], -1)
    widths[inner, inner] = np.where(kind == 0, both(step > 0), np.where(kind == 4, both(step < 0), 0))
    return widths


def traced_edges(grey: np.ndarray, low: float = 0.1, high: float = 0.2) -> np.ndarray:
    """Ridges of the gradient of the smoothed picture that reach high, with all that is linked to them
    and reaches low. The picture is smoothed by a Gaussian of deviation 1 that knows nothing beyond the
    borders, and pixels on the border are none."""
    bell = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    bell /= bell.sum()

    def smoothed(x):
        for axis in (0, 1):
            around = np.pad(x, [(4, 4) if k == axis else (0, 0) for k in (0, 1)])
            x = np.lib.stride_tricks.sliding_window_view(around, 9, axis) @ bell
        return x

    soft = smoothed(grey) / (smoothed(np.ones(grey.shape)) + np.finfo(float).eps)
    soft = np.pad(soft, 1, mode="symmetric")
    across, along = soft[:-2] + 2 * soft[1:-1] + soft[2:], soft[:, :-2] + 2 * soft[:, 1:-1] + soft[:, 2:]
    gx, gy = across[:, 2:] - across[:, :-2], along[2:] - along[:-2]
    size = np.hypot(gx, gy)
    y, x = np.nonzero(size[1:-1, 1:-1] >= low)
    y, x = y + 1, x + 1
    gx, gy, own = gx[y, x], gy[y, x], size[y, x]
    flat = np.abs(gx) >= np.abs(gy)
    share = np.minimum(np.abs(gx), np.abs(gy)) / np.maximum(np.abs(gx), np.abs(gy))
    sx, sy = np.where(gx < 0, -1, 1), np.where(gy < 0, -1, 1)
    ridge = np.ones(len(y), bool)
    for way in (1, -1):
        straight = size[y + np.where(flat, 0, way * sy), x + np.where(flat, way * sx, 0)]
        ridge &= own >= share * size[y + way * sy, x + way * sx] + (1 - share) * straight
    wide = grey.shape[1]
    place = y * wide + x
    weak = np.zeros(grey.size, bool)
    weak[place[ridge]] = True
    front = place[ridge & (own >= high)]
    weak[front] = False  # what is left of the weak ones is not found yet
    found = np.zeros(grey.size, bool)
    around = np.array([i * wide + j for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while len(front):  # ridges never touch the border, so a neighbour is always inside
        found[front] = True
        near = (front[:, None] + around).ravel()
        front = np.unique(near[weak[near]])
        weak[front] = False
    return found.reshape(grey.shape)


def sharpness_of(image: np.ndarray) -> float:
    """The share of edges whose blur is seen with a chance below UNSEEN percent, over whole blocks that hold
    edges enough; 0 where there is none. Chances are rounded to a percent, a half to the even one."""
    grey = grey_of(image)
    rows, columns = (n // BLOCK for n in grey.shape)
    if not rows or not columns:
        return 0.0
    blocks = lambda x: x[: rows * BLOCK, : columns * BLOCK].reshape(rows, BLOCK, columns, BLOCK).swapaxes(1, 2).reshape(rows * columns, -1)
    widths = blocks(edge_widths(grey, upright_edges(grey)))
    levels = blocks(grey)
    noticed = np.where(levels.max(1) - levels.min(1) <= 50, *WIDTHS)[:, None]
    counted = (widths > 0) & (blocks(traced_edges(grey)).sum(1) > BLOCK**2 * EDGES)[:, None]
    chance = 1 - np.exp(-((widths / noticed) ** EXPONENT))
    unseen = counted & (np.rint(chance * 100) < UNSEEN)
    return float(unseen.sum() / max(1, counted.sum()))


def sharpness(picture: Column, landmarks: Column | None = None) -> Column:
    """How sharp a picture is, from 0 to 1: sharpness_of its grey levels, cut out as in laplacian_variance."""
    return _scored(sharpness_of, picture, landmarks)


# Pose


def _turns(w: np.ndarray) -> np.ndarray:
    """The rotation matrices of vectors that are axis times angle."""
    angle = np.linalg.norm(w, axis=1)[:, None, None]
    k = np.zeros((len(w), 3, 3))
    k[:, 2, 1], k[:, 0, 2], k[:, 1, 0] = w.T
    k -= k.transpose(0, 2, 1)
    first, second = np.sinc(angle / np.pi), 0.5 * np.sinc(angle / (2 * np.pi)) ** 2
    return np.eye(3) + first * k + second * (k @ k)


def poses(points: np.ndarray, size: float = 256.0, rounds: int = 60) -> np.ndarray:
    """(n, 3): pitch, yaw, roll of heads whose landmarks HEAD_USED are points (n, 33, 2).

    The camera stands before the middle of a square picture of this size, its focal length being the
    size. Turn and shift with the least squared distance in the picture are found by damped Gauss-Newton
    steps, all heads at once, from a head that faces the camera at its apparent size. A head whose steps
    no longer help stands still, so a result does not depend on the other heads. Pitch is negated, and
    angles are cut to a quarter turn. Points that are all one place give nan.
    """
    head = np.array(HEAD)
    n = len(points)
    seen = (points - size / 2) / size
    middle = seen.mean(1)
    spread = np.sqrt(((seen - middle[:, None]) ** 2).mean((1, 2)))
    bad = ~(spread > 1e-9)
    depth = np.sqrt(head[:, :2].var(0).mean()) / np.where(bad, 1, spread)
    turn = np.broadcast_to(np.eye(3), (n, 3, 3)).copy()
    shift = np.stack([middle[:, 0] * depth, middle[:, 1] * depth, depth], 1)
    shift[:, :2] -= head.mean(0)[:2]
    damping = np.full(n, 1e-3)

    def apart(turn, shift):
        placed = head @ turn.transpose(0, 2, 1) + shift[:, None]
        z = np.maximum(placed[..., 2:], 1.0)
        return placed, z, placed[..., :2] / z - seen

    placed, z, off = apart(turn, shift)
    cost = (off**2).sum((1, 2))
    for _ in range(rounds):
        # derivatives by a turn about the camera's axes and by a shift
        arm = placed - shift[:, None]
        move = np.zeros((*placed.shape, 6))  # (n, 33, 3, 6)
        move[..., 1, 0], move[..., 2, 0] = -arm[..., 2], arm[..., 1]
        move[..., 0, 1], move[..., 2, 1] = arm[..., 2], -arm[..., 0]
        move[..., 0, 2], move[..., 1, 2] = -arm[..., 1], arm[..., 0]
        move[..., [0, 1, 2], [3, 4, 5]] = 1
        slope = (move[..., :2, :] - (placed[..., :2] / z)[..., None] * move[..., 2:, :]) / z[..., None]
        slope = slope.reshape(n, -1, 6)
        square = slope.transpose(0, 2, 1) @ slope
        pull = (slope.transpose(0, 2, 1) @ off.reshape(n, -1, 1))[..., 0]
        weight = damping[:, None] * np.einsum("nii->ni", square) + 1e-15
        step = -np.linalg.solve(square + weight[:, None] * np.eye(6), pull[..., None])[..., 0]
        tried = _turns(step[:, :3]) @ turn, shift + step[:, 3:]
        next_placed, next_z, next_off = apart(*tried)
        next_cost = (next_off**2).sum((1, 2))
        better = next_cost < cost
        pick = better[:, None, None]
        turn, shift = np.where(pick, tried[0], turn), np.where(better[:, None], tried[1], shift)
        placed, z, off = np.where(pick, next_placed, placed), np.where(pick, next_z, z), np.where(pick, next_off, off)
        cost = np.where(better, next_cost, cost)
        damping = np.clip(np.where(better, damping / 10, damping * 10), 1e-12, 1e12)
    level = np.hypot(turn[:, 0, 0], turn[:, 1, 0])
    flat = level < 1e-6
    x = np.where(flat, np.arctan2(-turn[:, 1, 2], turn[:, 1, 1]), np.arctan2(turn[:, 2, 1], turn[:, 2, 2]))
    y = np.arctan2(-turn[:, 2, 0], level)
    roll = np.where(flat, 0.0, np.arctan2(turn[:, 1, 0], turn[:, 0, 0]))
    angles = np.clip(np.stack([x, y, roll], 1), -math.pi / 2, math.pi / 2) * [-1, 1, 1]
    angles[bad] = np.nan
    return angles


def head_pose(landmarks: Column, size: float = 256.0) -> Column:
    """(pitch, yaw, roll) in radians from 68 landmarks in a square picture of this size; null where there
    are not 68 finite ones, or where all are one place."""

    @F.pandas_udf("pitch double, yaw double, roll double")
    def run(batch: pd.Series) -> pd.DataFrame:
        out = np.full((len(batch), 3), np.nan)
        held = [_given(points) for points in batch]
        good = [k for k, x in enumerate(held) if x is not None]
        for low in range(0, len(good), 1024):
            some = good[low : low + 1024]
            out[some] = poses(np.stack([held[k][HEAD_USED] for k in some]), size)
        return pd.DataFrame(out, columns=["pitch", "yaw", "roll"])

    made = run(landmarks)
    known = lambda x: F.nanvl(x, F.lit(None).cast("double"))
    return F.struct(*(known(made[k]).alias(k) for k in ("pitch", "yaw", "roll")))
