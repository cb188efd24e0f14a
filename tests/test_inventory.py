"""Operators of the inventory that no query holds to SQL."""

import json
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework import storage
from sievework.functions import arrays, geometry, options, paths
from sievework.operators import aggregates, filters, select
from sievework.sources import faceset, files, jpeg

JFIF = b"\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0"
SOF = b"\xff\xc0\x00\x0b\x08\x00\x40\x01\x00\x01\x01\x11\x00"
SCAN = b"\xff\xda\x00\x08\1\1\0\0\x3f\0\xaa\xff\0\xbb\xff\xd9"


def own(payload):
    return b"\xff\xef" + (len(payload) + 2).to_bytes(2, "big") + payload


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_segments_of_pictures(spark):
    record = {"face_type": "head", "landmarks": np.arange(4.0).reshape(2, 2), "mask": b"\x01", "none": None, "n": np.int64(3)}
    whole = {
        "plain": b"\xff\xd8" + JFIF + SOF + SCAN,
        "json": b"\xff\xd8" + JFIF + own(b'{"a": 1}') + SOF + SCAN,
        "pickle": b"\xff\xd8" + own(pickle.dumps(record)) + SOF + SCAN,
        "evil": b"\xff\xd8" + own(b"cos\nsystem\n(S'true'\ntR.") + SCAN,
        "list": b"\xff\xd8" + own(pickle.dumps([1])) + SCAN,
        "empty": b"", "text": b"no picture", "short": b"\xff\xd8\xff\xe0\x00", "open": b"\xff\xd8" + SOF + SCAN[:-2],
    }
    df = spark.createDataFrame([*whole.items(), ("null", None)], "path string, content binary")
    got = {r.path: r for r in jpeg.read_metadata(df).collect()}
    assert len(got) == len(whole) + 1
    assert (got["plain"].height, got["plain"].width, got["plain"].record, got["plain"].error) == (64, 256, None, None)
    assert json.loads(got["json"].record) == {"a": 1} and got["open"].height == 64
    assert json.loads(got["pickle"].record) == {"face_type": "head", "landmarks": [[0, 1], [2, 3]], "mask": "AQ==", "none": None, "n": 3}
    assert got["empty"].error is None
    for bad in ("evil", "list", "text", "short", "null"):
        assert got[bad].error and got[bad].height is None and got[bad].record is None
    parts = jpeg.read_segments(df).where("path = 'json'").orderBy("number").collect()
    assert [r.name for r in parts] == ["SOI", "APP0", "APP15", "SOF0", "SOS", "EOI"] and sum(r["size"] for r in parts) == len(whole["json"])
    face = jpeg.read_metadata(df.where("path = 'pickle'")).select(F.from_json("record", faceset.FACES).alias("f"))
    assert face.select("f.face_type", "f.landmarks").first() == ("head", [[0.0, 1.0], [2.0, 3.0]])


def test_records_are_put_behind_the_last_application_segment(spark):
    content = b"\xff\xd8" + JFIF + own(b'{"old": 1}') + SOF + SCAN
    rows = [("a", content, '{"new": 2, "none": null}'), ("b", content, None), ("c", b"\xff\xd8" + SOF + SCAN, '{"x": 1}'), ("d", b"?", "{}"), ("e", content, "{"), ("f", content, json.dumps({"x": "y" * 70_000}))]
    got = {r.path: r for r in jpeg.write_metadata(spark.createDataFrame(rows, "path string, content binary, record string")).collect()}
    assert got["a"].content == b"\xff\xd8" + JFIF + own(b'{"new": 2}') + SOF + SCAN
    assert got["b"].content == b"\xff\xd8" + JFIF + SOF + SCAN
    assert got["c"].content == b"\xff\xd8" + own(b'{"x": 1}') + SOF + SCAN
    assert all(got[x].error and got[x].content is None for x in "def")


def test_recolouring_gives_the_targets_moments(spark):
    r = np.random.default_rng(0)
    mix = lambda n, m: r.normal(size=(n, 3)) @ m + 0.5
    a, b = mix(500, np.diag([0.1, 0.2, 0.05])), mix(300, r.normal(0, 0.1, (3, 3)))
    frames = [spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(v)], "id long, x double, y double, z double") for v in (a, b)]
    got = aggregates.recoloured(*frames, ["x", "y", "z"], -9, 9)
    out = np.array([(p.x, p.y, p.z) for p in got.collect()])
    assert got.columns == ["id", "x", "y", "z"] and np.allclose(out.mean(0), b.mean(0)) and np.allclose(np.cov(out.T), np.cov(b.T))
    clipped = aggregates.recoloured(*frames, ["x", "y", "z"]).agg(F.min("x"), F.max("y")).first()
    assert clipped[0] >= 0 and clipped[1] <= 1


def test_dominant_cluster(spark):
    r = np.random.default_rng(1)
    points = np.vstack([r.normal(c, 1, (n, 2)) for c, n in (((0, 0), 80), ((50, 50), 300), ((90, 0), 60))])
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "a double, b double")
    row = aggregates.dominant_cluster(df, ["a", "b"]).first()
    assert row.n == 300 and row.a_mean == pytest.approx(50, abs=0.5) and row.b_std == pytest.approx(1, abs=0.2)
    assert tuple(aggregates.dominant_cluster(df.limit(99), ["a", "b"]).first()) == (99, 50.0, 0.0, 20.0, 10.0)


def test_options_protect_what_is_structural():
    """The reference's own cases: types from a JSON text, and what only a first run may set."""
    defaults = {"resolution": 128, "archi": "df-hd", "lr_dropout": "n", "face_type": "f", "head_name": "a"}
    given = {"resolution": "256", "masked_training": "true", "face_type": "wf", "head_name": "b", "lr_dropout": True, "gan_power": 0.1, "batch_size": "16"}
    later, first = options.merged(defaults, given, False), options.merged(defaults, given, True)
    assert (later["resolution"], later["head_name"], later["masked_training"], later["face_type"]) == (128, "a", True, "wf")
    assert (first["resolution"], first["head_name"], first["lr_dropout"], first["batch_size"], first["gan_power"]) == (256, "b", "y", 16, 0.1)


def test_options_of_many_rows_equal_those_of_one(spark):
    texts = ["true", "False", "12", "-7", "+3", "1.50", "2e3", "1E-2", ".5", "adabelief", "", " 4 ", "1e", "٣"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for x, got in zip(texts, [r[0] for r in df.select(options.typed(F.col("x"))).collect()], strict=True):
        value = options.coerced(x)
        kind = {bool: "boolean", int: "int", float: "double", str: "string"}[type(value)]
        if x == "٣":  # digits of other scripts are texts in columns
            continue
        assert got.kind == kind
        assert got.value == x if kind == "string" else type(value)(got.value == "true" if kind == "boolean" else got.value) == value
    assert spark.createDataFrame([(None,)], "x string").select(options.typed(F.col("x"))).first()[0] is None
    maps = spark.createDataFrame([({"a": "1"}, {"b": "2"}), ({"a": "1", "b": "3"}, None)], "o map<string,string>, d map<string,string>")
    assert [r[0] for r in maps.select(options.option(F.col("o"), F.col("d"), "b", "9")).collect()] == ["2", "3"]


def test_small_helpers(spark):
    df = spark.range(1)
    assert one(df, arrays.histogram(F.array(*map(F.lit, [0.0, 0.5, 1.0, 1.0])), 0, 1, 2)) == [1, 3]
    assert one(df, arrays.clip(F.lit(5.0), 0, 2)) == 2.0 and one(df, arrays.first_known(F.lit(None), F.lit(3), F.lit(4))) == 3
    assert one(df, arrays.var_pop(F.array(*map(F.lit, [1.0, 3.0])))) == 1.0 and arrays.linspace(2.0, 3.0, 1) == [2.0]
    assert [one(df, geometry.scale_to(F.lit(x))) for x in (2000, 1000, 50)] == [640.0, 500.0, 64.0]
    names = spark.createDataFrame([(7,), (99_999,), (123_456,), (123_457,)], "n long")
    assert [r[0] for r in names.select(paths.numbered(F.col("n"), F.lit("a/b.jpg"))).collect()] == ["00007.jpg", "99999.jpg", "123456.jpg", "123457.jpg"]
    points = F.array(*[F.array(F.lit(float(k)), F.lit(0.0)) for k in range(3)])
    for bad in (geometry.with_point(points, F.lit(4), points[0]), geometry.without_point(points, F.lit(3)), geometry.without_point(points, F.lit(-1))):
        with pytest.raises(Exception, match="no p"):
            one(df, bad)


def test_listings(spark, tmp_path):
    for name in ("b/one.jpg", "b/two.png", "a/c/one_1.jpg", "one.jpg", "one.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert files.folders(spark, str(tmp_path)) == ["a", "b"] and files.folders(spark, str(tmp_path / "none")) == []
    assert [x.removeprefix(str(tmp_path)) for x in files.folders(spark, str(tmp_path), True)] == ["/a", "/a/c", "/b"]
    found = files.scan(spark, str(tmp_path), True)
    assert files.starting_with(found, "path", "one").count() == 4
    assert files.first_by_stem(files.scan(spark, str(tmp_path)), "path", "one").first()[0].endswith("/one.jpg")
    assert sorted(r.age for r in files.newest_first(found).collect()) == list(range(5))
    (tmp_path / "boxes.csv").write_text('name,l,t,w,h\n"a, b.jpg",1,2,3,4\nbad,x,2,3,4\n')
    assert [tuple(r) for r in files.box_table(spark, str(tmp_path / "boxes.csv")).collect()] == [("a, b.jpg", 1, 2, 3, 4)]


def test_facesets(spark, tmp_path):
    faces = spark.createDataFrame([("a.jpg", None, None, b"m", None), ("b.jpg", "head", 2.0, None, [(1, [[0.0, 1.0]])]), ("b_mask.jpg", None, None, None, None), ("c.jpg", None, None, None, None)],
        "filename string, face_type string, eyebrows_expand_mod double, xseg_mask binary, seg_ie_polys array<struct<type:int,pts:array<array<float>>>>")
    assert [(r.face_type, r.eyebrows_expand_mod) for r in faceset.with_defaults(faces).collect()][:2] == [("full_face", 1.0), ("head", 2.0)]
    assert [r.mask_source for r in faceset.mask_source(faces.where("filename <> 'c.jpg'")).collect()] == ["mask", "polygons"]
    with pytest.raises(Exception, match="neither mask nor polygons"):
        faceset.mask_source(faces).collect()
    target = str(tmp_path / "packed")
    assert faceset.load(spark, target, faces).count() == 4
    faces.limit(1).write.parquet(target)
    assert faceset.load(spark, target, faces).count() == 1
    twice = spark.createDataFrame([("x/a.jpg", b"1", None), ("y/a.jpg", b"2", None)], "filename string, content binary, person_name string")
    with pytest.raises(ValueError):
        faceset.unpack(twice, str(tmp_path / "out"))
    faceset.save_metadata(faces.withColumn("shape", F.lit(1)), str(tmp_path / "saved"))
    assert "xseg_mask" not in spark.read.parquet(str(tmp_path / "saved")).columns


def test_empty_null_and_repeated_rows(spark):
    rows = [(1, 5.0), (1, 5.0), (2, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    for some, many in ((df, 4), (df.limit(0), 0)):
        assert select.index_lists(some, "g", "v").count() == many and select.stratified(some, "v", "g", 1).count() == many
        assert select.epoch_shuffle(some, "v", 1, 2).count() == 2 * many
        assert select.partners(some, spark.range(3), "v", "id", 1).count() == many
        assert filters.first_rows(some, "g", ["v"], 1).count() == min(many, 3) and filters.first_rows(some, "g", ["v"], 0).count() == many
        assert aggregates.scale_of(some.withColumn("p", F.lit(0)), "p", "v").count() == 1
    assert select.partners(df, spark.range(0), "v", "id", 1).where("partner IS NULL").count() == 4
    x = spark.range(2000).select(select.truncated_normal(3, "id").alias("x"))
    low, high, mean, spread = x.agg(F.min("x"), F.max("x"), F.avg("x"), F.stddev("x")).first()
    assert -1 <= low < -0.9 and 0.9 < high <= 1 and abs(mean) < 0.03 and abs(spread * 2.5 - 0.955) < 0.05


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        _jsc = spark.sparkContext._jsc

    class Session:
        sparkContext = Context()
        conf = {}

    held = type("None_", (), {"isDefined": lambda self: False})()
    monkeypatch.setattr(Context, "_jsc", type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: held})()})())
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_sums_and_neighbours_over_ranges(spark):
    from sievework.operators import rank

    r = np.random.default_rng(5)
    rows = [(k, int(r.integers(0, 9)), float(x) if r.random() < 0.05 else None) for k, x in enumerate(r.normal(size=400))]
    df = spark.createDataFrame(rows, "k long, n long, v double").repartition(7)
    got = rank.nearest_known(rank.running_sum(df, ["k"], "n", "up"), ["k"], "v", "low", "high").orderBy("k").collect()
    up, low = 0, None
    for k, n, v in rows:
        up, low = up + n, v if v is not None else low
        high = next((x for _, _, x in rows[k:] if x is not None), None)
        assert (got[k].up, got[k].low, got[k].high) == (up, low, high)
    assert rank.nearest_known(df.limit(0), ["k"], "v", "low", "high").count() == 0 == rank.running_sum(df.limit(0), ["k"], "n", "up").count()
    assert aggregates.matched(df.limit(0), df, "n").count() == 0
