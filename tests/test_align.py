"""Properties of the alignment: where landmarks of known faces come to lie in the square picture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import align

MEAN = np.array(align.MEAN_FACE)
SIZE = 256


def turned(points, angle, size, shift):
    z = (points[..., 0] + 1j * points[..., 1]) * size * np.exp(1j * angle)
    return np.stack([z.real, z.imag], -1) + shift


def straight():
    """A face that is the mean face itself, its jaw as far from the nose bridge on both sides."""
    out = np.full((68, 2), 0.5)
    out[align.USED] = MEAN
    out[[0, 1, 2]], out[[16, 15, 14]] = out[27] - [0.45, 0], out[27] + [0.45, 0]
    return out


def moved(matrix, points):
    return points @ matrix[:, :2].T + matrix[:, 2]


PLAIN = {"half_face": 0.5, "midfull_face": 0.5, "full_face": 0.5, "whole_face": 0.43}


@pytest.mark.parametrize("face_type", PLAIN)
@pytest.mark.parametrize("angle", [0.0, 0.7, -2.5])
def test_a_mean_face_comes_to_lie_on_the_mean_face(face_type, angle):
    """The unit square around the mean face fills the picture but for its padding, however the face is
    turned, sized and placed in its own picture."""
    face = np.zeros((68, 2))
    face[align.USED] = MEAN
    points = turned(face, angle, 130.0, (40.0, 75.0))
    (matrix,) = align.matrices(points[None], SIZE, face_type)
    wide = 1 + 2 * np.sqrt(2) * align.FACE_TYPES[face_type][0]
    want = ((MEAN - (0.5, PLAIN[face_type])) / wide + 0.5) * SIZE
    assert np.allclose(moved(matrix, points)[align.USED], want, atol=1e-6)


def test_worked_numbers():
    """A mean face 100 pixels wide at (10, 20): half_face is cut at 10 to 110 and 20 to 120."""
    points = straight() * 100 + (10, 20)
    (half,) = align.matrices(points[None], 100, "half_face")
    assert np.allclose(half, [[1, 0, -10], [0, 1, -20]], atol=1e-9)
    (twice,) = align.matrices(points[None], 200, "half_face")
    assert np.allclose(twice, 2 * half)
    (head,) = align.matrices(points[None], 100, "head")
    side = 100 * (1 + 1.4 * np.sqrt(2))  # around (60, 20): half a face higher than the mean face's centre
    assert np.allclose(head, 100 / side * np.array([[1, 0, side / 2 - 60], [0, 1, side / 2 - 20]]))
    (close,) = align.matrices(points[None], 100, "half_face", scale=2.0)
    assert np.allclose(moved(close, np.array([[60.0, 70.0], [35.0, 45.0]])), [[50, 50], [0, 0]])


@pytest.mark.parametrize("face_type", align.FACE_TYPES)
def test_turning_and_scaling_change_nothing(face_type):
    r = np.random.default_rng(1)
    face = straight() + r.normal(0, 0.02, (68, 2))
    one, two = turned(face, 0.4, 90.0, (5, 6)), turned(face, 0.4, 180.0, (-70, 12))
    a, b = align.matrices(np.stack([one, two]), SIZE, face_type)
    assert np.allclose(moved(a, one), moved(b, two), atol=1e-6)
    if not align.FACE_TYPES[face_type][1]:
        three = turned(face, -1.9, 33.0, (1, 2))
        (c,) = align.matrices(three[None], SIZE, face_type)
        assert np.allclose(moved(c, three), moved(a, one), atol=1e-6)


@pytest.mark.parametrize("face_type", ["full_face", "head"])
def test_upright_squares(face_type):
    """Unturned, as large as the turned square, and around the middle of the mean face."""
    points, middle = (turned(x, 0.6, 120.0, (30, 40)) for x in (straight(), np.array([0.5, 0.5])))
    (own,) = align.matrices(points[None], SIZE, face_type)
    (upright,) = align.matrices(points[None], SIZE, f"{face_type}_no_align")
    assert upright[0, 1] == upright[1, 0] == 0 and upright[0, 0] == pytest.approx(upright[1, 1])
    assert upright[0, 0] == pytest.approx(np.sqrt(abs(np.linalg.det(own[:, :2]))))
    assert np.allclose(moved(upright, middle), SIZE / 2)


def test_a_face_to_the_side_is_followed():
    """head goes towards the side that the jaw shows, and not at all for a face that looks ahead."""
    face = straight()
    aside = face.copy()
    aside[[16, 15, 14], 0] += 0.2
    a, b = (align.matrices(100 * x[None], SIZE, "head")[0] for x in (face, aside))
    yaw = 0.2
    shift = b[0, 2] - a[0, 2]
    assert shift == pytest.approx(-100 * a[0, 0] * yaw * np.tanh(2 * yaw) / 2) and a[1, 2] == pytest.approx(b[1, 2])


def test_the_fit_is_the_best_one():
    """No similarity near by maps noisy landmarks closer onto the mean face."""
    r = np.random.default_rng(2)
    mean = MEAN[:, 0] + 1j * MEAN[:, 1]
    z = (mean * 80 * np.exp(0.9j) + 7 - 3j) + r.normal(0, 2, 33) + 1j * r.normal(0, 2, 33)
    a, t = (x[0] for x in align.similarity(z[None], mean))
    apart = lambda a, t: (np.abs(a * z + t - mean) ** 2).sum()
    for _ in range(200):
        da, dt = (complex(*r.normal(0, 1, 2)) for _ in range(2))
        assert apart(a + 1e-4 * da, t + 1e-3 * dt) > apart(a, t)
    none, _ = align.similarity(np.zeros((1, 33), complex), mean)
    assert np.isnan(none).all()


def test_resized(spark):
    r = np.random.default_rng(0)
    points = np.stack([turned(straight() + r.normal(0, 0.01, (68, 2)), a, 100.0, (50, 60)) for a in (0.1, -0.4, 2.0)])
    kinds = "filename string, shape struct<h:int,w:int,c:int>, landmarks array<array<double>>, source_landmarks array<array<double>>, seg_ie_polys array<struct<type:int,pts:array<array<float>>>>, image_to_face_mat array<array<double>>, face_type string"
    rows = [(str(k), (400, 400, 3), p.tolist(), p.tolist(), [(1, [[4.0, 8.0]])], [[0.0] * 3] * 2 if k else None, "full_face") for k, p in enumerate(points)]
    df = spark.createDataFrame(rows, kinds)
    got = align.resized(df, 100).orderBy("filename").collect()
    assert np.allclose(got[1].landmarks, points[1] / 4) and got[1].seg_ie_polys[0].pts == [[1.0, 2.0]] and got[0].image_to_face_mat is None
    assert np.allclose(got[1].image_to_face_mat, align.matrices(points, 100, "full_face")[1]) and got[2]["shape"].w == 100
    anew = align.resized(df, 100, "whole_face").orderBy("filename").first()
    assert np.allclose(anew.landmarks, moved(align.matrices(points, 100, "whole_face")[0], points[0])) and anew.face_type == "whole_face"
    rect = df.select(align.rect_of(F.col("landmarks")).alias("r")).first().r
    assert rect.r > rect.l and rect.b - rect.t == pytest.approx(rect.r - rect.l)
    assert df.select(align.align_matrix(F.slice("landmarks", 1, 5), 100, "full_face").alias("m")).where("m IS NOT NULL").count() == 0
