import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework import queries
from sievework.functions import arrays, geometry, options, paths
from sievework.operators import chain, filters, joins, rank, select, windows
from sievework.plans import curate
from sievework.sources import faceset, files
from sievework.streaming import ingest


def first(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_paths(spark):
    rows = [("a/b/00012_1.jpg", "00012_1", ".jpg", "b"), (".x", ".x", "", ""), ("p/q.tar.gz", "q.tar", ".gz", "p"), ("q", "q", "", "")]
    df = spark.createDataFrame(rows, "p string, stem string, suffix string, above string")
    p = F.col("p")
    assert df.where((paths.stem(p) != F.col("stem")) | (paths.suffix(p) != F.col("suffix")) | (paths.parent_name(p) != F.col("above"))).count() == 0
    found = [r[0] for r in df.select(paths.frame_and_face(p)).collect()]
    assert found[0] == (12, 1) and found[1:] == [None] * 3


def test_bucket_on_edges(spark):
    edges = np.linspace(-1.2, 1.2, 128)
    values = [*edges.tolist(), -9.0, 9.0, *np.random.default_rng(0).uniform(-1.3, 1.3, 200).tolist()]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r[0] for r in df.select(arrays.bucket(F.col("v"), arrays.YAW_EDGES)).collect()]
    assert got == [max(0, int(np.searchsorted(edges, v, side="right")) - 1) for v in values]


def test_bhattacharyya_and_interpolation(spark):
    a, b = [1.0, 2.0, 0.0], [2.0, 2.0, 1.0]
    want = math.sqrt(1 - sum(math.sqrt(x * y) for x, y in zip(a, b)) / math.sqrt(sum(a) * sum(b)))
    assert first(spark, arrays.bhattacharyya(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)
    xs, ys = [0.0, 1.0, 3.0], [0.0, 10.0, 0.0]
    for x in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 4.0):
        got = first(spark, arrays.interpolate(F.lit(x), F.col("xs"), F.col("ys")), xs=xs, ys=ys)
        assert got == pytest.approx(np.interp(x, xs, ys))


def test_polygon_area(spark):
    assert first(spark, geometry.polygon_area(F.col("x"), F.col("y")), x=[0.0, 4.0, 4.0, 0.0], y=[0.0, 0.0, 3.0, 3.0]) == 12.0
    assert first(spark, geometry.polygon_area(F.col("x"), F.col("y")), x=[1.0], y=[1.0]) == 0.0


def test_landmarks(spark):
    points = np.random.default_rng(1).uniform(0, 100, (68, 2))
    df = spark.createDataFrame([(points.tolist(),)], "l array<array<double>>")
    left = np.mean([points[27, 0] - points[0, 0], points[28, 0] - points[1, 0], points[29, 0] - points[2, 0]])
    right = np.mean([points[16, 0] - points[27, 0], points[15, 0] - points[28, 0], points[14, 0] - points[29, 0]])
    assert df.select(geometry.averaged_yaw(F.col("l"))).first()[0] == pytest.approx(right - left)
    twice = geometry.mirror(geometry.mirror(F.col("l"), F.lit(100)), F.lit(100))
    assert np.allclose(df.select(twice).first()[0], points)
    wide = np.random.default_rng(2).uniform(0, 100, (98, 2))
    df = spark.createDataFrame([(wide.tolist(),)], "l array<array<double>>")
    got = np.array(df.select(geometry.from_98(F.col("l"))).first()[0])
    assert got.shape == (68, 2) and np.allclose(got[0], wide[0]) and np.allclose(got[36], wide[60])
    assert np.allclose(got[18], (wide[34] + wide[41]) / 2) and np.allclose(got[1], (wide[2] + (wide[1] + wide[3]) / 2) / 2)


def test_inverse_affine(spark):
    m = [F.lit(float(v)) for v in (2, 1, 5, -1, 3, 7)]
    x, y = geometry.affine(geometry.inverse_affine(m), *geometry.affine(m, F.lit(3.0), F.lit(4.0)))
    assert first(spark, F.array(x, y)) == pytest.approx([3.0, 4.0])


def test_rank_is_a_bijection_and_rejects(spark):
    random.seed(0)
    rows = [(k, random.choice([0.0, 1.0, 2.5, None]), f"in/{k}.png") for k in range(500)]
    got = rank.sort_by(spark.createDataFrame(rows, "id int, s double, path string"), F.col("s"), ["id"], reject=F.col("s") == 0, path="path").collect()
    kept = sorted((r for r in got if not r.is_trash), key=lambda r: r["rank"])
    want = sorted((r for r in rows if r[1]), key=lambda r: (-r[1], r[0]))
    assert [r.id for r in kept] == [r[0] for r in want] and [r["rank"] for r in kept] == list(range(len(want)))
    assert len(got) == 500 and kept[3].new_name == "00003.png"


def simulated_best_n(rows, target):
    """The rules of the selection, written as loops. rows: (id, sharp, yaw, pitch, hist)."""
    edges = np.linspace(-1.2, 1.2, 128)
    place = lambda v, e: max(0, int(np.searchsorted(e, v, side="right")) - 1)
    groups = [[] for _ in range(128)]
    for row in rows:
        groups[place(-row[2], edges)].append(row)
    q = round(target / 128)
    q += sum(max(q - len(g), 0) for g in groups) // 128
    pitches = np.linspace(-math.pi / 2, math.pi / 2, q)
    apart = lambda a, b: math.sqrt(max(0.0, 1 - np.sqrt(np.multiply(a, b)).sum() / math.sqrt(sum(a) * sum(b))))
    order = []
    for group in groups:
        group = sorted(group, key=lambda r: (-r[1], r[0]))[: 10 * q]
        cells = {}
        for row in group:
            cells.setdefault(place(row[3], pitches), []).append(row)
        for key, cell in cells.items():
            sums = {r[0]: round(sum(apart(r[4], o[4]) for o in cell if o is not r), 9) for r in cell}
            cells[key] = sorted(cell, key=lambda r: (-sums[r[0]], -r[1], r[0]))
        taken = []
        while len(taken) < q and any(cells.values()):
            for key in sorted(cells):
                if cells[key] and len(taken) < q:
                    taken.append(cells[key].pop(0)[0])
        order += taken
    return order


def test_best_n_against_a_simulation(spark):
    r = np.random.default_rng(4)
    rows = [(k, float(r.integers(0, 50)), float(r.normal(0, 0.6)), float(r.normal(0, 0.8)), r.integers(1, 9, 6).astype(float).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, "path string, sharpness double, yaw double, pitch double, histogram array<double>".replace("path string", "id int"))
    got = select.best_n(df, "id", "sharpness", "yaw", "pitch", "histogram", 400).where("rank IS NOT NULL").orderBy("rank")
    assert [x.id for x in got.collect()] == simulated_best_n(rows, 400)
    named = df.select(F.concat(F.lit("d/"), F.lpad("id", 4, "0"), F.lit(".jpg")).alias("path"), "sharpness", "yaw", "pitch", "histogram", F.col("sharpness").alias("rect_area"))
    assert curate.final(named, "final-by-size", 200).where("NOT is_trash").count() == len(simulated_best_n(rows, 200))


def test_unlikeness_in_blocks(spark):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(k, k % 2, r.uniform(0, 1, 8).tolist()) for k in range(60)], "id int, g int, h array<double>")
    one = {x.id: x.apart for x in select.unlikeness(df, "id", "h", ["g"]).collect()}
    many = {x.id: x.apart for x in select.unlikeness(df, "id", "h", ["g"], side=7).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in one)


def test_unlikeness_of_a_whole_table(spark, tmp_path):
    r = np.random.default_rng(7)
    hists = r.uniform(-1, 1, (50, 8))
    hists[[3, 4]], hists[6] = hists[5], 0
    rows = [(k, h.tolist(), None if k % 5 == 0 else k % 3) for k, h in enumerate(hists)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    h = np.abs(hists)

    def apart(a, b):
        scale = math.sqrt(a.sum() * b.sum())
        return math.sqrt(max(0, 1 - np.sqrt(a * b).sum() / scale)) if scale else 0

    want = {k: sum(apart(h[k], h[j]) for j in range(50) if j != k) for k in range(50)}
    for side in (2048, 7):
        got = {x.id: x.apart for x in select.unlikeness(df.withColumn("h", F.transform("embedding", F.abs)), "vec_id", "h", side=side).collect()}
        assert got == pytest.approx(want, abs=1e-6)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.vec_id: x.apart for x in queries.QUERIES["o7_hist_dissimilarity_all"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    assert select.unlikeness(df.where("false"), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("metric", ["l1", "l2", "bhattacharyya"])
def test_chain_goes_to_the_closest(metric):
    v = np.random.default_rng(6).uniform(0, 1, (40, 5))
    order = chain.chain(v, metric)
    assert sorted(order) == list(range(40)) and order[0] == 0
    for k in range(39):
        rest = np.array(sorted(order[k + 1 :]))
        assert order[k + 1] == rest[chain.distances(v, order[k], rest, metric).argmin()]


def test_chain_chunks(spark):
    df = spark.createDataFrame([(k, [float(k % 7), float(k)]) for k in range(25)], "id int, v array<double>")
    got = chain.greedy_chain(df, "id", "v", "l2", most=10).collect()
    assert sorted((r.chunk, r.position) for r in got) == [(c, p) for c in range(3) for p in range(10 if c < 2 else 5)]
    assert chain.chunk_size(100_000) == 20_000 and chain.chunk_size(400_000) == int(400_000 / 11.9)


def test_chunks_are_the_references(spark):
    assert chain.chunk_size(259_999) == 20_000 and chain.chunk_size(260_000) == int(260_000 / 11.9)
    df = spark.createDataFrame([(k, [float(k)]) for k in range(45)], "id int, v array<double>")
    for n in (38, 39, 45):  # of 3 rows: 12 whole chunks at most
        size = chain.chunk_size(n, 3)
        got = chain.greedy_chain(df.where(f"id < {n}"), "id", "v", "l2", most=3).collect()
        assert {r.id: (r.chunk, r.position) for r in got} == {k: (k // size, k % size) for k in range(n)}


@pytest.mark.parametrize("similar", [True, False])
def test_absdiff_chain_of_a_whole_table(spark, tmp_path, monkeypatch, similar):
    """All labels in one chain from the first id, also with many equal items."""
    monkeypatch.setattr(chain, "AT_ONCE", 7)
    v = np.random.default_rng(8).integers(0, 4, (60, 3)).astype(float)
    want, rest = [0], list(range(1, 60))
    while rest:
        apart = [np.abs(v[want[-1]] - v[k]).sum() for k in rest]
        want.append(rest.pop(apart.index((min if similar else max)(apart))))
    assert chain.chain(v, "l1", similar) == want
    if similar:
        rows = [(k, x.tolist(), k % 4) for k, x in enumerate(v)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
        got = queries.QUERIES["o12_absdiff_chain"](spark, str(tmp_path)).orderBy("chunk", "position").collect()
        assert [r.vec_id for r in got] == want and {r.chunk for r in got} == {0}


@pytest.mark.parametrize("similar", [True, False])
@pytest.mark.parametrize("kind", ["plain", "equal", "outlier", "large", "endless"])
def test_few_distances_of_a_chain_are_exact(monkeypatch, similar, kind):
    """Coarse sums leave few items to compare, whatever the values; never one too few."""
    v = np.random.default_rng(12).normal(0, 0.1, (500, 24)).astype(np.float32).astype(float)
    if kind == "equal":
        v = v[np.random.default_rng(13).integers(0, 90, 500)]
    elif kind == "outlier":
        v[7, 3] = 5e3
    elif kind == "large":
        v = np.random.default_rng(14).uniform(0, 1, (500, 24)) * 1e300
    elif kind == "endless":
        v[9] = np.inf
    want, rest = [0], np.arange(1, 500)
    while len(rest):
        apart = np.abs(v[rest] - v[want[-1]]).sum(1)
        at = apart.argmin() if similar else apart.argmax()
        want.append(int(rest[at]))
        rest = np.delete(rest, at)
    rows, exact = [], chain._from
    monkeypatch.setattr(chain, "_from", lambda a, b, metric: rows.append(len(b)) or exact(a, b, metric))
    assert chain.chain(v, "l1", similar) == want
    assert kind != "plain" or sum(rows) < 500 * 500 // 8


def test_suppression(spark):
    rows = [(1, 0.0, 0.0, 9.0, 9.0, 0.9, 0), (1, 1.0, 1.0, 9.0, 9.0, 0.8, 1), (1, 30.0, 30.0, 39.0, 39.0, 0.7, 2), (1, 60.0, 60.0, 69.0, 69.0, 0.2, 3), (2, 0.0, 0.0, 9.0, 9.0, 0.6, 4)]
    df = spark.createDataFrame(rows, "f int, l double, t double, r double, b double, s double, k int")
    got = chain.non_max_suppression(df, "f", ("l", "t", "r", "b"), "s", ["k"])
    assert sorted(x.k for x in got.collect()) == [0, 2, 4]


def test_sampling(spark):
    df = spark.createDataFrame([(k, k % 3 if k < 90 else 9) for k in range(100)], "id int, s int")
    got = select.epoch_shuffle(df, "id", 1, 3).collect()
    for epoch in range(3):
        own = sorted((r.position, r.id) for r in got if r.epoch == epoch)
        assert [p for p, _ in own] == list(range(100)) and sorted(i for _, i in own) == list(range(100))
    turns = {}
    for r in select.stratified(df, "id", "s", 1).collect():
        turns.setdefault(r.stratum, []).append(r.turn)
    assert all(sorted(t) == list(range(len(t))) for t in turns.values())


def test_frames_without_faces_and_null_sources(spark):
    frames = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    faces = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), ("b", 4)], "src string, k int")
    got = {r.stem: ([f.k for f in r.faces], r.multiple) for r in joins.frames_with_faces(frames, faces, "stem", "src", ["k"]).collect()}
    assert got == {"a": ([1, 2], True), "b": ([4], False), "c": ([], False)}


def test_fallback_filter(spark):
    df = spark.range(5)
    assert filters.first_that_holds(df, lambda d: d.where("id > 9"), lambda d: d.where("id > 3")).count() == 1
    with pytest.raises(ValueError):
        filters.first_that_holds(df, lambda d: d.where("id > 9"))


def test_motion_ends(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 3.0, 4.0)], "k int, x double, y double").withColumn("g", F.lit(1))
    got = [r.motion_power for r in windows.motion(df, ["g"], ["k"], "x", "y").orderBy("k").collect()]
    assert got == [5.0, 5.0, 0.0]


def test_options():
    defaults = {"batch_size": 4, "resolution": 128, "lr_dropout": "n", "random_warp": True}
    given = {"batch_size": "16", "resolution": 256, "lr_dropout": True, "random_warp": "false", "gan_power": "0.1"}
    assert options.merged(defaults, given, False) == {"batch_size": 16, "resolution": 128, "lr_dropout": "y", "random_warp": False, "gan_power": 0.1}
    assert options.merged(defaults, given, True)["resolution"] == 256
    off = {"training": {"fast": False}}
    assert options.flags(off, {"training": {"fast": "true", "other": 1}})[0] == {"training": {"fast": True}}
    found, warned = options.flags(off, {"schema_version": 2, "training": {"fast": True}})
    assert found == off and warned


def png(path, side=8, value=7):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes([value] * 3 * side) for _ in range(side))
    header = struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scan_pack_unpack(spark, tmp_path):
    folder = tmp_path / "脸图"
    (folder / "anna").mkdir(parents=True)
    png(folder / "a.PNG")
    png(folder / "anna" / "a.jpg")
    (folder / "b.txt").write_text("x")
    assert files.scan(spark, str(folder)).count() == 1
    assert files.scan(spark, str(folder), recursive=True).count() == 2
    assert files.scan(spark, str(tmp_path / "none")).count() == 0
    assert files.unique_stems(files.scan(spark, str(folder), True), "path").count() == 1
    packed = faceset.pack(spark, str(folder), str(tmp_path / "packed"), persons=True)
    assert {(r.filename, r.person_name) for r in packed.collect()} >= {("a.jpg", "anna")}
    assert faceset.unpack(packed, str(tmp_path / "out")) == 2
    assert (tmp_path / "out" / "anna" / "a.jpg").read_bytes() == (folder / "anna" / "a.jpg").read_bytes()
    assert files.decoded(spark, str(folder)).first().height == 8


def test_text_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text("FILE,FACE_X,FACE_Y,FACE_WIDTH,FACE_HEIGHT\na.jpg,1,2,3,4\nbad\n")
    assert [tuple(r) for r in files.face_table(spark, str(tmp_path / "f.csv")).collect()] == [("a.jpg", 1, 2, 4, 6)]
    (tmp_path / "pts").mkdir()
    (tmp_path / "pts" / "good.pts").write_text("version: 1\n{\n" + "\n".join(f"{k} {k}.5" for k in range(68)) + "\n}\n")
    (tmp_path / "pts" / "short.pts").write_text("{\n" + "\n".join(f"{k} {k}" for k in range(67)) + "\n}\n")
    got = {r.path.rsplit("/", 1)[1]: r.landmarks for r in files.landmark_files(spark, str(tmp_path / "pts")).collect()}
    assert len(got["good.pts"]) == 68 and got["good.pts"][3] == [3.0, 3.5] and got["short.pts"] is None
    masks = spark.createDataFrame([("m/00001_left_eye.png",), ("m/x.png",)], "path string")
    assert [tuple(r)[:2] for r in files.mask_files(masks, "path").collect()] == [("00001", "left_eye")]


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.sql("SELECT timestamp_ntz'2024-01-01 00:01:00' AS ts, 'a' AS k UNION ALL SELECT timestamp_ntz'2024-01-01 00:02:00', 'a'").write.parquet(str(tmp_path / "in" / "x"))
    stream = ingest.arriving(spark, str(tmp_path / "in" / "x"), "ts timestamp_ntz, k string")
    out = ingest.windowed_counts(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("arrived")
    running = out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination()
    assert [r.n for r in spark.table("arrived").collect()] == [2]
