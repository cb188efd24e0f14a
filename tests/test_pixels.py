"""Scores from pixels and poses, on odd pictures and against slow definitions."""

import colorsys
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import pixels

KIND = "path string, picture struct<height:int,width:int,channels:int,data:binary>, points array<array<double>>"


def test_odd_pictures(spark):
    noise = np.random.default_rng(3).integers(0, 256, (9, 7, 3), dtype=np.uint8)
    face = [[float(3 + k % 3), float(4 + k % 2)] for k in range(68)]
    rows = [
        ("good", (9, 7, 3, noise.tobytes()), face), ("even", (4, 5, 3, bytes([9]) * 60), face), ("grey", (2, 2, 1, b"\0\1\2\3"), face),
        ("dot", (1, 1, 4, b"\0\1\2\0"), None), ("null", None, face), ("nodata", (2, 2, 1, None), face), ("nosize", (None, 2, 1, b"\0\0"), face),
        ("empty", (0, 0, 3, b""), face), ("short", (2, 2, 3, b"abc"), face), ("noface", (9, 7, 3, noise.tobytes()), face[:5]),
        ("nan", (9, 7, 3, noise.tobytes()), [[float("nan"), 1.0], *face[1:]]), ("outside", (9, 7, 3, noise.tobytes()), [[500.0, -70.0]] * 68),
    ]
    df = spark.createDataFrame([*rows, rows[0]], KIND)
    p = F.col("picture")
    got = df.select(
        "path", pixels.colour_scores(p).alias("c"), pixels.channel_histograms(p).alias("h"), pixels.laplacian_variance(p).alias("all"),
        pixels.laplacian_variance(p, F.col("points")).alias("face"), pixels.head_pose(F.col("points")).alias("pose"),
    ).collect()
    found = {r.path: r for r in got}
    assert len(got) == 13 and len(found) == 12
    for bad in ("null", "nodata", "nosize", "empty", "short"):
        assert found[bad].h is None and found[bad]["all"] is None and found[bad].face is None and found[bad].c.brightness is None
    assert found["even"]["all"] == 0 and found["even"].c.brightness == 9 and found["even"].c.hue == 0
    assert (found["grey"].c.brightness, found["grey"].c.black, len(found["grey"].h)) == (1.5, 1, 1)
    assert found["dot"].c.black == 2 and len(found["dot"].h) == 4
    assert [sum(x) for x in found["good"].h] == [63] * 3
    assert found["good"].face > 0 and found["noface"].face == 0 and found["nan"].face == 0 and found["outside"].face == 0
    assert found["nan"].pose.yaw is None and found["noface"].pose.yaw is None and found["outside"].pose.yaw is None
    assert df.limit(0).select(pixels.colour_scores(p).alias("c"), pixels.laplacian_variance(p).alias("l")).count() == 0


def test_hue_is_that_of_the_colour():
    every = np.random.default_rng(5).integers(0, 256, (1, 4000, 3), dtype=np.uint8)
    got = pixels.hue_of(every)[0]
    for (b, g, r), hue in zip(every[0].tolist(), got.tolist(), strict=True):
        exact = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)[0] * 180
        # half a step, and half of 1/4096 for each of up to 5 * 255 parts
        assert min(abs(hue - exact), 180 - abs(hue - exact)) <= 0.5 + 1275 / 8192 and 0 <= hue <= 180


def test_laplacian_by_definition():
    image = np.random.default_rng(7).integers(0, 256, (3, 6, 2), dtype=np.uint8)
    got = pixels.laplacian(image, 5)
    smooth, bend = [1, 4, 6, 4, 1], [1, 0, -2, 0, 1]  # binomials, and [1, 2, 1] over [1, -2, 1]

    def at(y, x, c):
        y, x = ((lambda v, n: min(v % (2 * n - 2), 2 * n - 2 - v % (2 * n - 2)))(v, n) for v, n in ((y, 3), (x, 6)))
        return int(image[y, x, c])

    for y, x, c in np.ndindex(3, 6, 2):
        steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
        assert got[y, x, c] == sum((bend[i + 2] * smooth[j + 2] + smooth[i + 2] * bend[j + 2]) * at(y + i, x + j, c) for i, j in steps)


@pytest.mark.parametrize("seed", range(6))
def test_hull_holds_every_triangle(seed):
    random = np.random.default_rng(seed)
    points = random.integers(-4, 24, (7, 2)) if seed else np.array([[3, 3]] * 4 + [[9, 3]] * 3)
    mask = np.zeros((20, 20), bool)
    pixels.fill_hull(mask, points)

    def apart(x, y):
        """How far a place is outside the hull: the widest gap over many directions."""
        turn = np.linspace(0, 2 * np.pi, 721)
        ways = np.stack([np.cos(turn), np.sin(turn)])
        return (np.array([x, y]) @ ways - (points @ ways).max(0)).max()

    def in_triangle(x, y):
        for a, b, c in combinations(points.tolist(), 3):
            sides = [(q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) for p, q in ((a, b), (b, c), (c, a))]
            if any(sides) and (min(sides) >= 0 or max(sides) <= 0):
                return True
        return False

    for y, x in np.ndindex(20, 20):
        gap = apart(x, y)
        assert mask[y, x] or not in_triangle(x, y) or gap > -1e-9
        assert not mask[y, x] or gap <= 0.75


def test_a_pose_does_not_depend_on_other_heads():
    random = np.random.default_rng(11)
    turns = pixels._turns(random.uniform(-0.5, 0.5, (40, 3)))
    placed = np.array(pixels.HEAD) @ turns.transpose(0, 2, 1) + [4, -6, 310]
    points = placed[..., :2] / placed[..., 2:] * 256 + 128
    points[20:] += random.normal(size=(20, 33, 2))
    together = pixels.poses(points)
    assert np.isfinite(together).all()
    yaw = np.arcsin(-turns[:20, 2, 0])
    assert np.allclose(together[:20, 1], yaw, atol=1e-9)
    for k in range(40):
        assert np.abs(pixels.poses(points[k : k + 1])[0] - together[k]).max() < 1e-6
    assert np.isnan(pixels.poses(np.full((1, 33, 2), 5.0))).all()


def slow_width(grey, y, x):
    """The slope through one edge, followed pixel by pixel."""
    g = np.gradient(grey)
    angle = np.degrees(np.arctan2(g[0][y, x], g[1][y, x])) if g[1][y, x] else 0.0
    sign = {0: 1, 4: -1}.get(abs(round(angle / 45)))
    if sign is None:
        return 0
    width = 0
    for way in (-1, 1):
        at, taken = x + way, 0
        while taken < 100 and 0 <= at + way < grey.shape[1] and sign * way * (grey[y, at + way] - grey[y, at]) > 0:
            at, taken = at + way, taken + 1
        width += taken + 1
    return width


@pytest.mark.parametrize("seed", range(4))
def test_edge_widths_are_slopes(seed):
    random = np.random.default_rng(seed)
    grey = random.integers(0, 4 + 60 * seed, (9, 130)).astype(float).cumsum(1) * random.choice([-1, 1], (9, 1))
    grey[4:] += random.integers(-2, 3, (5, 130))
    edges = random.random(grey.shape) < 0.5
    got = pixels.edge_widths(grey, edges)
    for y, x in np.ndindex(*grey.shape):
        inside = 0 < y < 8 and 0 < x < 129
        assert got[y, x] == (slow_width(grey, y, x) if inside and edges[y, x] else 0)


def test_traced_edges_of_a_square():
    grey = np.zeros((40, 40))
    grey[10:30, 10:30] = 90.0
    found = pixels.traced_edges(grey)
    assert not found[:8].any() and not found[13:27, 13:27].any() and not found[:, 32:].any()
    assert (found[13:27, 8:12].sum(1) >= 1).all() and (found[8:12, 13:27].sum(0) >= 1).all()
    assert not pixels.traced_edges(np.full((40, 40), 7.0)).any()
    faint = pixels.traced_edges(np.where(np.arange(40) < 20, 0.0, 0.03) * np.ones((40, 1)))
    assert not faint.any()


def test_blurred_pictures_are_less_sharp(spark):
    """Boxes on a ground, then the same ever more blurred; and what has no block or no edge."""
    random = np.random.default_rng(2)
    sharp = np.full((128, 192), 40.0)
    for top, left in random.integers(4, 100, (12, 2)):
        sharp[top : top + 20, left : left + 25] = random.integers(60, 250)
    made = [sharp]
    for _ in range(3):
        x = made[-1]
        for axis in (0, 1):
            x = np.lib.stride_tricks.sliding_window_view(np.pad(x, [(3, 3) if k == axis else (0, 0) for k in (0, 1)], mode="edge"), 7, axis).mean(-1)
        made.append(x)
    scores = [pixels.sharpness_of(x.astype(np.uint8)[..., None]) for x in made]
    assert scores[0] > 0.9 and scores[-1] < 0.3 and scores == sorted(scores, reverse=True)
    whole = made[0].astype(np.uint8)
    three = np.repeat(whole[..., None], 3, 2)
    face = [[20.0 + 10 * (k % 9), 20.0 + 12 * (k // 9)] for k in range(68)]
    rows = [("grey", (128, 192, 1, whole.tobytes()), face), ("three", (128, 192, 3, three.tobytes()), None), ("flat", (64, 64, 1, bytes(4096)), face),
            ("small", (63, 64, 1, bytes(range(64)) * 63), face), ("thin", (1, 300, 1, bytes(300)), face), ("null", None, None)]
    df = spark.createDataFrame(rows, KIND)
    got = {r.path: r for r in df.select("path", pixels.sharpness(F.col("picture")).alias("all"), pixels.sharpness(F.col("picture"), F.col("points")).alias("face")).collect()}
    assert got["grey"]["all"] == got["three"]["all"] == scores[0] and 0 < got["grey"].face <= 1 and got["three"].face == 0
    assert [got[k]["all"] for k in ("flat", "small", "thin", "null")] == [0, 0, 0, None]
