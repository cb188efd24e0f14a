"""Further registered queries: operators of the inventory on their own, each with its SQL where SQL can
express it. Seeded draws are MD5 digests, which both engines have."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import arrays, geometry, options, paths
from .operators import aggregates, joins, pixels, rank, select
from .queries import _ABS, _BOXES, _LEVELS, _levels, _t, query
from .sources import jpeg

_BUCKETS = """e AS (SELECT [-1.2 + k * (2.4 / 127) for k in range(127)] || [1.2] AS e),
    b AS (SELECT vec_id, greatest(len(list_filter(e, lambda x: x <= embedding[1]::DOUBLE * 4)) - 1, 0) AS stratum FROM embeddings, e)"""


# Sampling


def _place(key: str, by: str = "", seed: str = "7") -> str:
    """A row's number in the order of its draw."""
    return f"row_number() OVER ({by} ORDER BY md5('{seed}:' || {key}), {key.rsplit(' || ', 1)[-1]}) - 1"


@query("p1_epoch_shuffle", f"""
    SELECT c_custkey, epoch, {_place("epoch || ':' || c_custkey", "PARTITION BY epoch")} AS position FROM customer, (SELECT unnest([0, 1]) AS epoch)""")
def p1_epoch_shuffle(spark, sf_dir):
    return select.epoch_shuffle(_t(spark, sf_dir, "customer"), "c_custkey", 7, 2)


@query("p2_stratified", f"""
    SELECT c_custkey, c_nationkey AS stratum, {_place("c_custkey", "PARTITION BY c_nationkey")} AS turn FROM customer""")
def p2_stratified(spark, sf_dir):
    return select.stratified(_t(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", 7)


@query("p3_uniform_yaw_strata", f"""
    WITH {_BUCKETS} SELECT vec_id, stratum, {_place("vec_id", "PARTITION BY stratum")} AS turn FROM b""")
def p3_uniform_yaw_strata(spark, sf_dir):
    yaw = F.col("embedding")[0].cast("double") * 4
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", arrays.bucket(yaw, arrays.YAW_EDGES).alias("bucket"))
    return select.stratified(rows, "vec_id", "bucket", 7)


def _batches_sql(table: str, key: str, size: int) -> str:
    return f"""
    WITH s AS (SELECT {key}, {_place(f"0 || ':' || {key}")} AS position FROM {table})
    SELECT position // {size} AS batch, string_agg({key}, ',' ORDER BY position) AS members FROM s GROUP BY 1 HAVING count(*) = {size}"""


def _batches(rows, key, size):
    one = select.epoch_shuffle(rows, key, 7).select(key, "position")
    found = select.batches(one, "position", size, key)
    return found.select("batch", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("p4_batches", _batches_sql("customer", "c_custkey", 16))
def p4_batches(spark, sf_dir):
    return _batches(_t(spark, sf_dir, "customer"), "c_custkey", 16)


@query("p5_round_robin", f"""
    WITH s AS (SELECT c_custkey, {_place("0 || ':' || c_custkey")} AS position FROM customer)
    SELECT c_custkey, (position % 6)::INTEGER AS worker, position // 6 AS turn FROM s""")
def p5_round_robin(spark, sf_dir):
    one = select.epoch_shuffle(_t(spark, sf_dir, "customer"), "c_custkey", 7)
    return select.dealt(one, "position", 6).select("c_custkey", "worker", "turn")


@query("p8_partners", f"""
    WITH f AS (SELECT c_custkey, {_place("0 || ':' || c_custkey")} AS position FROM customer), n AS (SELECT count(*) AS n FROM supplier),
    e AS (SELECT unnest(range((SELECT count(*) FROM customer) // (SELECT n FROM n) + 1)) AS epoch),
    s AS (SELECT s_suppkey, epoch * n + {_place("epoch || ':' || s_suppkey", "PARTITION BY epoch", "8")} AS position FROM supplier, e, n)
    SELECT c_custkey, s_suppkey AS partner FROM f JOIN s USING (position)""")
def p8_partners(spark, sf_dir):
    return select.partners(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier"), "c_custkey", "s_suppkey", 7)


def _uniform_sql(k: int, side: int) -> str:
    return f"(('0x' || substr(md5('7:{k}:{side}:' || c_custkey), 1, 12))::BIGINT::DOUBLE / 281474976710656)"


_NORMAL = ", ".join(f"sqrt(-2 * ln(1 - {_uniform_sql(k, 0)})) * cos(2 * pi() * {_uniform_sql(k, 1)})" for k in range(12))


@query("p10_truncated_normal", f"""
    SELECT c_custkey, round(coalesce(list_filter([{_NORMAL}], lambda x: abs(x) <= 2.5)[1] / 2.5, 0), 9) AS x FROM customer""")
def p10_truncated_normal(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", F.round(select.truncated_normal(7, "c_custkey"), 9).alias("x"))


@query("p11_image_batches", _batches_sql("pages", "page_id", 4))
def p11_image_batches(spark, sf_dir):
    return _batches(_t(spark, sf_dir, "pages"), "page_id", 4)


@query("a3_person_lists", "SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, c_custkey FROM customer")
def a3_person_lists(spark, sf_dir):
    return select.index_lists(_t(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")


# Sorts, joins, names


@query("o2_sort_motion_blur", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def o2_sort_motion_blur(spark, sf_dir):
    return rank.by_number(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"]).select("o_orderkey", "rank")


@query("o4_sort_pitch", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM customer")
def o4_sort_pitch(spark, sf_dir):
    return rank.by_number(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"]).select("c_custkey", "rank")


@query("j4_masks_without_images", "SELECT doc_id FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) USING (doc_id)")
def j4_masks_without_images(spark, sf_dir):
    images = _t(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    return joins.missing(_t(spark, sf_dir, "labels").select("doc_id"), images, "doc_id", "doc_id")


@query("j5_images_without_annotation", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def j5_images_without_annotation(spark, sf_dir):
    return joins.missing(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("k6_new_names", "SELECT event_id, printf('%05d.png', event_id * 37) AS new_name FROM events")
def k6_new_names(spark, sf_dir):
    name = paths.numbered(F.col("event_id") * 37, F.lit("in/x.png"))
    return _t(spark, sf_dir, "events").select("event_id", name.alias("new_name"))


# Aggregates


@query("a6_histogram", f"SELECT label, unnest({_LEVELS}) AS value, count(*) AS n FROM embeddings GROUP BY 1, 2")
def a6_histogram(spark, sf_dir):
    return aggregates.value_counts(_levels(spark, sf_dir), ["label"], "levels")


@query("a16_scale", "SELECT round(2 * avg(value), 6) AS scale FROM events WHERE event_id >= (SELECT (max(event_id) + 1) // 5 FROM events)")
def a16_scale(spark, sf_dir):
    return aggregates.scale_of(_t(spark, sf_dir, "events"), "event_id", "value").select(F.round("scale", 6).alias("scale"))


@query("a22_mean_of_shifted", """
    SELECT user_id, round(avg(value + event_id % 3 - 1), 6) AS x, round(avg(event_id % 89 + event_id % 5 - 2), 6) AS y FROM events GROUP BY 1""")
def a22_mean_of_shifted(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(
        "user_id", F.col("value").alias("x"), (F.col("event_id") % 89).alias("y"), (F.col("event_id") % 3 - 1).alias("dx"), (F.col("event_id") % 5 - 2).alias("dy")
    )
    found = aggregates.mean_of_shifted(rows, ["user_id"], "x", "y", "dx", "dy")
    return found.select("user_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("a12_recoloured")
def a12_recoloured(spark, sf_dir):
    """Two numbers of line items, mapped to the means and covariances of two numbers of parts."""
    source = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"))
    target = _t(spark, sf_dir, "part").select(F.col("p_size").alias("a"), (F.col("p_retailprice") / 100).alias("b"))
    return aggregates.recoloured(source, target, ["a", "b"], -1e9, 1e9)


@query("a13_dominant_cluster")
def a13_dominant_cluster(spark, sf_dir):
    return aggregates.dominant_cluster(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


# Geometry

#: Points from a vector: k has these two places of it.
_X, _Y = (lambda k: k % 64), (lambda k: (7 * k + 3) % 64)


def _points(spark, sf_dir, many, factor=1.0):
    """A table with landmarks, as a column of its own that is computed once."""
    at = lambda k: F.get("embedding", k).cast("double") * factor
    made = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: F.array(at(_X(k)), at(_Y(k))))
    return _t(spark, sf_dir, "embeddings").select("vec_id", made.alias("points"))


def _x(k):
    return f"embedding[{_X(k) + 1}]::DOUBLE"


def _y(k):
    return f"embedding[{_Y(k) + 1}]::DOUBLE"


def _shown(rows, made):
    """A row for each point of what is made of the landmarks."""
    rows = rows.select("vec_id", F.posexplode(made).alias("k", "p"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


def _shown_sql(xs: list[str], ys: list[str]) -> str:
    return f"""WITH p AS (SELECT vec_id, [{", ".join(xs)}] AS xs, [{", ".join(ys)}] AS ys, unnest(range({len(xs)})) AS k FROM embeddings)
        SELECT vec_id, k, round(xs[k + 1], 6) AS x, round(ys[k + 1], 6) AS y FROM p"""


@query("g2_euler", """
    WITH m AS (SELECT event_id, event_id % 5 AS r00, event_id % 3 AS r10, event_id % 11 AS r12, event_id % 13 + 1 AS r11, event_id % 17 AS r21, event_id % 19 + 1 AS r22, event_id % 23 - 11 AS r20 FROM events),
    l AS (SELECT *, sqrt(r00 * r00 + r10 * r10) AS level FROM m)
    SELECT event_id, round(CASE WHEN level < 1e-6 THEN atan2(-r12, r11) ELSE atan2(r21, r22) END, 9) AS x, round(atan2(-r20, level), 9) AS y,
           round(CASE WHEN level < 1e-6 THEN 0 ELSE atan2(r10, r00) END, 9) AS z FROM l""")
def g2_euler(spark, sf_dir):
    e = F.col("event_id")
    zero = F.lit(0)
    r = [[e % 5, zero, zero], [e % 3, e % 13 + 1, e % 11], [e % 23 - 11, e % 17, e % 19 + 1]]
    names = zip(geometry.euler(r), "xyz", strict=True)
    return _t(spark, sf_dir, "events").select("event_id", *[F.round(angle, 9).alias(name) for angle, name in names])


@query("g7_yaw_g8_pitch", f"""
    SELECT vec_id, round((({_x(16)} - {_x(27)}) + ({_x(15)} - {_x(28)}) + ({_x(14)} - {_x(29)})) / 3 - (({_x(27)} - {_x(0)}) + ({_x(28)} - {_x(1)}) + ({_x(29)} - {_x(2)})) / 3, 6) AS yaw,
           round({_y(8)} - (({_y(6)} - {_y(8)}) + ({_y(10)} - {_y(8)})) / 2, 6) AS pitch FROM embeddings""")
def g7_yaw_g8_pitch(spark, sf_dir):
    yaw, pitch = geometry.averaged_yaw(F.col("points")), geometry.simple_pitch(F.col("points"))
    return _points(spark, sf_dir, 68).select("vec_id", F.round(yaw, 6).alias("yaw"), F.round(pitch, 6).alias("pitch"))


def _from_98_sql(c) -> list[str]:
    ends = {0, 16, 32}
    jaw = [c(k) if k in ends else f"({c(k)} / 2 + ({c(k - 1)} + {c(k + 1)}) / 4)" for k in range(0, 33, 2)]
    brows = [c(33), *[f"(({c(a)} + {c(b)}) / 2)" for a, b in ((34, 41), (35, 40), (36, 39), (37, 38), (42, 50), (43, 49), (44, 48), (45, 47))], c(46)]
    left_out = {62, 66, 70, 74}
    return jaw + brows + [c(k) for k in range(51, 96) if k not in left_out]


@query("g10_from_98", _shown_sql(_from_98_sql(_x), _from_98_sql(_y)))
def g10_from_98(spark, sf_dir):
    return _shown(_points(spark, sf_dir, 98), geometry.from_98(F.col("points")))


@query("g11_mirror", _shown_sql([f"(255 - {_x(k)})" for k in geometry.MIRROR], [_y(k) for k in geometry.MIRROR]))
def g11_mirror(spark, sf_dir):
    return _shown(_points(spark, sf_dir, 68), geometry.mirror(F.col("points"), F.lit(256)))


def _brows_sql(c) -> list[str]:
    whole = lambda k: f"trunc({c(k)} * 100)::BIGINT"
    middle = lambda a, b: f"floor(({a} + {b}) / 2)::BIGINT"
    eyes = {17: middle(whole(36), middle(whole(36), whole(0))), 26: middle(whole(45), middle(whole(45), whole(16)))}
    eyes |= {k: whole(k + 18) for k in range(18, 22)} | {k: whole(k + 20) for k in range(22, 26)}
    return [f"trunc({whole(k)} + 0.5::DOUBLE * ({whole(k)} - {eyes[k]}))::BIGINT::DOUBLE" if k in eyes else f"{whole(k)}::DOUBLE" for k in range(68)]


@query("g12_expanded_brows", _shown_sql(_brows_sql(_x), _brows_sql(_y)))
def g12_expanded_brows(spark, sf_dir):
    return _shown(_points(spark, sf_dir, 68, 100.0), geometry.expand_brows(F.col("points"), F.lit(1.0)).cast("array<array<double>>"))


@query("g16_unrotated", """
    SELECT event_id, CASE event_id % 4 WHEN 1 THEN user_id WHEN 2 THEN 1000 - value WHEN 3 THEN 1000 - user_id ELSE value END::DOUBLE AS x,
           CASE event_id % 4 WHEN 1 THEN 500 - value WHEN 2 THEN 500 - user_id WHEN 3 THEN value ELSE user_id END::DOUBLE AS y FROM events""")
def g16_unrotated(spark, sf_dir):
    degrees = F.col("event_id") % 4 * 90
    x, y = geometry.unrotate(F.col("value"), F.col("user_id").cast("double"), degrees, F.lit(1000.0), F.lit(500.0))
    return _t(spark, sf_dir, "events").select("event_id", x.cast("double").alias("x"), y.cast("double").alias("y"))


_PARTS = "list_transform(range(1, 6), lambda k: embedding[k]::DOUBLE)"


@query("g22_polygon_editing", f"""
    WITH p AS (SELECT vec_id, {_PARTS} AS p FROM embeddings),
    w AS (SELECT vec_id, p, p[1:vec_id % 6] || [9.0::DOUBLE] || p[vec_id % 6 + 1:] AS more, p[1:vec_id % 5] || p[vec_id % 5 + 2:] AS fewer, p[1:greatest(0, 5 - vec_id % 7)] AS shown FROM p)
    SELECT vec_id, round(list_sum(list_transform(list_zip(more, range(1, 7)), lambda x: x[1] * x[2])), 6) AS more,
           round(list_sum(list_transform(list_zip(fewer, range(1, 5)), lambda x: x[1] * x[2])), 6) AS fewer, len(shown) AS shown, len(shown) + 4 AS points, len(shown) = 5 AS same FROM w""")
def g22_polygon_editing(spark, sf_dir):
    at = lambda k: F.col("embedding")[k].cast("double")
    points = F.array(*(F.array(at(k), F.lit(0.0)) for k in range(5)))
    n = F.col("vec_id").cast("int")
    more = geometry.with_point(points, n % 6, F.array(F.lit(9.0), F.lit(0.0)))
    fewer, shown = geometry.without_point(points, n % 5), geometry.shown_points(points, n % 7)
    weighed = lambda p: F.round(arrays.total(F.zip_with(p, F.sequence(F.lit(1), F.size(p)), lambda x, k: x[0] * k)), 6)
    polygon = lambda p: F.struct(F.lit(1).alias("type"), p.alias("pts"))
    return _t(spark, sf_dir, "embeddings").select(
        "vec_id", weighed(more).alias("more"), weighed(fewer).alias("fewer"), F.size(shown).cast("long").alias("shown"),
        geometry.points_count(F.array(polygon(shown), polygon(fewer))).alias("points"), geometry.identical(F.array(polygon(shown)), F.array(polygon(points))).alias("same"),
    )


@query("f10_channels", """
    SELECT vec_id, round(embedding[1]::DOUBLE * 3, 6) AS repeated, round(embedding[1]::DOUBLE + embedding[2]::DOUBLE, 6) AS cut, 2 AS height, 4 AS width FROM embeddings""")
def f10_channels(spark, sf_dir):
    at = lambda k: F.col("embedding")[k].cast("double")
    one = arrays.channels_of(F.array(F.array(at(0))), 3)[0]
    two = arrays.channels_of(F.array(F.array(at(0), at(1), at(2))), 2)[0]
    even = arrays.even_sides(F.array(*[F.array(*[at(k) for k in range(5)])] * 3))
    return _t(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(arrays.total(one), 6).alias("repeated"), F.round(arrays.total(two), 6).alias("cut"),
        F.size(even).alias("height"), F.size(even[0]).alias("width"),
    )


# Options and metadata of pictures


@query("s14_typed_options", r"""
    WITH o AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN event_id::VARCHAR WHEN 3 THEN '-' || event_id WHEN 4 THEN event_id || '.5'
                      WHEN 5 THEN '2e3' WHEN 6 THEN 'adabelief' END AS raw FROM events)
    SELECT event_id, CASE WHEN raw IS NULL THEN NULL WHEN lower(raw) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(raw, '[+-]?\d+') THEN 'int'
                          WHEN raw = 'adabelief' THEN 'string' ELSE 'double' END AS kind,
           CASE WHEN lower(raw) IN ('true', 'false') THEN lower(raw) WHEN raw = '2e3' THEN '2000.0' ELSE raw END AS value,
           CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS archi, CASE WHEN event_id % 8 = 0 THEN 'y' WHEN event_id % 8 = 1 THEN 'n' ELSE 'cpu' END AS lr_dropout FROM o""")
def s14_typed_options(spark, sf_dir):
    e = F.col("event_id")
    text, k = e.cast("string"), e % 8
    raw = F.when(k == 0, "True").when(k == 1, "false").when(k == 2, text).when(k == 3, F.concat(F.lit("-"), text))
    raw = raw.when(k == 4, F.concat(text, F.lit(".5"))).when(k == 5, "2e3").when(k == 6, "adabelief")
    kind = options.typed(raw)
    defaults = F.create_map(F.lit("archi"), F.lit("old"), F.lit("lr_dropout"), F.lit("cpu"))
    given = F.when(k < 2, F.create_map(F.lit("archi"), F.lit("new"), F.lit("lr_dropout"), raw)).otherwise(F.create_map(F.lit("archi"), F.lit("new")))
    used = options.overlaid(defaults, given, e % 2 == 0)
    return _t(spark, sf_dir, "events").select("event_id", kind["kind"].alias("kind"), kind["value"].alias("value"), used["archi"].alias("archi"), used["lr_dropout"].alias("lr_dropout"))


def _pictures(spark, sf_dir):
    """A small JPEG for each document, with its language and length as the own record of every other."""
    digits = lambda n, size: F.unhex(F.lpad(F.hex(n), size, "0"))
    record = F.to_json(F.struct("lang", F.col("n_chars").alias("size"), F.lit(None).cast("string").alias("none"))).cast("binary")
    own = F.concat(F.unhex(F.lit("FFEF")), digits(F.octet_length(record) + 2, 4), record)
    sof = F.concat(F.unhex(F.lit("FFC0000B08")), digits(F.col("doc_id") % 4000, 4), digits(F.col("n_chars") % 3000, 4), F.unhex(F.lit("01011100")))
    head, scan = F.unhex(F.lit("FFD8FFE000104A46494600010100000100010000")), F.unhex(F.lit("FFDA0008010100003F00AABBFF00CCFFD9"))
    content = F.concat(head, F.when(F.col("doc_id") % 2 == 0, own).otherwise(F.unhex(F.lit(""))), sof, scan)
    content = F.when(F.col("doc_id") % 50 == 7, F.unhex(F.lit("00FF"))).otherwise(content)
    return _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), content.alias("content"), "lang")


@query("s7_metadata", """
    SELECT doc_id, CASE WHEN doc_id % 50 <> 7 THEN (doc_id % 4000)::INTEGER END AS height, CASE WHEN doc_id % 50 <> 7 THEN (n_chars % 3000)::INTEGER END AS width,
           CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, doc_id % 50 = 7 AS corrupted FROM documents""")
def s7_metadata(spark, sf_dir):
    found = jpeg.read_metadata(_pictures(spark, sf_dir))
    return found.select(
        F.col("path").cast("long").alias("doc_id"), "height", "width", F.get_json_object("record", "$.lang").alias("lang"), F.col("error").isNotNull().alias("corrupted")
    )


@query("s6_segments", """
    SELECT coalesce(name, 'none') AS name, count(*) AS n FROM (SELECT unnest(CASE WHEN doc_id % 50 = 7 THEN [NULL] WHEN doc_id % 2 = 0
        THEN ['SOI', 'APP0', 'APP15', 'SOF0', 'SOS', 'EOI'] ELSE ['SOI', 'APP0', 'SOF0', 'SOS', 'EOI'] END) AS name FROM documents) GROUP BY 1""")
def s6_segments(spark, sf_dir):
    found = jpeg.read_segments(_pictures(spark, sf_dir))
    return found.groupBy(F.coalesce("name", F.lit("none")).alias("name")).agg(F.count("*").alias("n"))


@query("k1_rewritten_metadata", """
    SELECT doc_id, CASE WHEN doc_id % 50 <> 7 AND doc_id % 3 <> 0 THEN lang || '!' END AS lang, doc_id % 50 = 7 AS corrupted,
           CASE WHEN doc_id % 50 <> 7 THEN (doc_id % 4000)::INTEGER END AS height FROM documents""")
def k1_rewritten_metadata(spark, sf_dir):
    record = F.when(F.col("doc_id") % 3 != 0, F.to_json(F.struct(F.concat("lang", F.lit("!")).alias("lang"))))
    found = jpeg.read_metadata(jpeg.write_metadata(_pictures(spark, sf_dir).withColumn("record", record)))
    return found.select(
        F.col("path").cast("long").alias("doc_id"), F.get_json_object("record", "$.lang").alias("lang"), F.col("error").isNotNull().alias("corrupted"), "height"
    )


# Pixels and poses


def _shots(spark, sf_dir):
    """A picture of 4 by 4 pixels from the first 48 numbers of each vector."""
    level = F.transform(F.slice("embedding", 1, 48), lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256)
    data = F.unhex(F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    shape = [F.lit(n).alias(k) for k, n in (("height", 4), ("width", 4), ("channels", 3))]
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.struct(*shape, data.alias("data")).alias("picture"))


_BYTES = """b AS (SELECT vec_id, list_transform(embedding[1:48], lambda x: floor(abs(x::DOUBLE) * 1000)::BIGINT % 256) AS v FROM embeddings)"""


@query("a7_colour_scores", f"""
    WITH {_BYTES}, p AS (SELECT vec_id, unnest(list_transform(range(16), lambda k: struct_pack(b := v[3 * k + 1], g := v[3 * k + 2], r := v[3 * k + 3])), recursive := true) FROM b),
    s AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS spread FROM p),
    h AS (SELECT *, CASE WHEN top = r THEN g - b WHEN top = g THEN b - r + 2 * spread ELSE r - g + 4 * spread END AS part FROM s),
    u AS (SELECT *, CASE WHEN spread > 0 THEN floor((part * round_even(122880 / spread, 0) + 2048) / 4096) ELSE 0 END AS hue FROM h)
    SELECT vec_id, round(avg(top), 6) AS brightness, round(avg(CASE WHEN hue < 0 THEN hue + 180 ELSE hue END), 6) AS hue,
           sum((r = 0)::BIGINT + (g = 0)::BIGINT + (b = 0)::BIGINT)::BIGINT AS black FROM u GROUP BY 1""")
def a7_colour_scores(spark, sf_dir):
    made = _shots(spark, sf_dir).select("vec_id", pixels.colour_scores(F.col("picture")).alias("s"))
    return made.select("vec_id", F.round("s.brightness", 6).alias("brightness"), F.round("s.hue", 6).alias("hue"), "s.black")


@query("a6_channel_histograms", f"""
    WITH {_BYTES} SELECT vec_id, channel, v[3 * k + channel + 1] AS level, count(*) AS n FROM b, range(16) AS x(k), range(3) AS y(channel) GROUP BY ALL""")
def a6_channel_histograms(spark, sf_dir):
    made = _shots(spark, sf_dir).select("vec_id", F.posexplode(pixels.channel_histograms(F.col("picture"))).alias("channel", "counts"))
    made = made.select("vec_id", F.col("channel").cast("long").alias("channel"), F.posexplode("counts").alias("level", "n"))
    return made.where("n > 0").select("vec_id", "channel", F.col("level").cast("long").alias("level"), "n")


#: The smoothing binomials of side 11, and the second difference smoothed to the same side.
_SMOOTH = "[1, 10, 45, 120, 210, 252, 210, 120, 45, 10, 1]"
_BEND = "[1, 6, 13, 8, -14, -28, -14, 8, 13, 6, 1]"


@query("a9_laplacian_variance", f"""
    WITH {_BYTES}, o AS (SELECT d, {_SMOOTH}[d + 6]::DOUBLE AS s, {_BEND}[d + 6]::DOUBLE AS t FROM range(-5, 6) AS x(d)),
    m AS (SELECT i, least((i + d + 6) % 6, 6 - (i + d + 6) % 6) AS j, sum(s) AS s, sum(t) AS t FROM o, range(4) AS x(i) GROUP BY 1, 2),
    w AS (SELECT y.i AS y, x.i AS x, y.j AS v, x.j AS u, y.t * x.s + y.s * x.t AS weight FROM m y, m x),
    l AS (SELECT vec_id, y, x, c, sum(weight * b.v[(w.v * 4 + w.u) * 3 + c + 1]) AS value FROM b, w, range(3) AS z(c) GROUP BY ALL)
    SELECT vec_id, round(var_pop(value) / 1e6, 3) AS score FROM l GROUP BY 1""")
def a9_laplacian_variance(spark, sf_dir):
    score = pixels.laplacian_variance(F.col("picture"))
    return _shots(spark, sf_dir).select("vec_id", F.round(score / 1e6, 3).alias("score"))


@query("g18_sharpness")
def g18_sharpness(spark, sf_dir):
    """Pictures of 64 equal rows, each the numbers of a vector."""
    level = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256)
    data = F.unhex(F.repeat(F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), ""), F.size("embedding")))
    shape = [F.size("embedding").alias("height"), F.size("embedding").alias("width"), F.lit(1).alias("channels")]
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.struct(*shape, data.alias("data")).alias("picture"))
    return rows.select("vec_id", F.round(pixels.sharpness(F.col("picture")), 6).alias("score"))


def _angle(k: int):
    """Three angles of a row, none of them 0."""
    return (F.col("c_custkey") * (2 * k + 1) % 40 - 19.5) / 50


@query("g9_pose", """
    SELECT c_custkey, round(-(c_custkey % 40 - 19.5) / 50, 6) AS pitch, round((c_custkey * 3 % 40 - 19.5) / 50, 6) AS yaw,
           round((c_custkey * 5 % 40 - 19.5) / 50, 6) AS roll FROM customer""")
def g9_pose(spark, sf_dir):
    """Heads turned by known angles and seen in a picture, whose angles are then found again."""
    rows = _t(spark, sf_dir, "customer").select("c_custkey", *(_angle(k).cast("double").alias(a) for k, a in enumerate("xyz")))
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(a), F.sin(a)) for a in "xyz")
    turn = [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]
    rows = rows.select("c_custkey", F.array(*(F.array(*r) for r in turn)).alias("m"))
    places = {k: p for k, p in zip(pixels.HEAD_USED, pixels.HEAD, strict=True)}
    head = F.array(*(F.array(*map(F.lit, places.get(k, (0.0, 0.0, 0.0)))) for k in range(68)))

    def seen(p):
        x, y, z = (sum(F.col("m")[i][j] * p[j] for j in range(3)) for i in range(3))
        return F.array((x + 5) / (z + 330) * 256 + 128, (y - 3) / (z + 330) * 256 + 128)

    made = rows.select("c_custkey", F.transform(head, seen).alias("points"))
    made = made.select("c_custkey", pixels.head_pose(F.col("points")).alias("p"))
    return made.select("c_custkey", *(F.round(F.col("p")[k], 6).alias(k) for k in ("pitch", "yaw", "roll")))


# SQL of the sequential kernels, whose queries are registered with the operators


def _chain_sql(vectors: str, apart: str) -> str:
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, {vectors} AS h FROM embeddings),
    r AS (
        SELECT 0::BIGINT AS position, min(vec_id) AS vec_id, [min(vec_id)] AS seen FROM v
        UNION ALL
        SELECT position + 1, next, list_append(seen, next) FROM (
            SELECT r.position, r.seen, arg_min(b.vec_id, struct_pack(d := {apart}, id := b.vec_id)) AS next
            FROM r JOIN v a ON a.vec_id = r.vec_id JOIN v b ON NOT list_contains(r.seen, b.vec_id) GROUP BY 1, 2))
    SELECT vec_id, 0::BIGINT AS chunk, position FROM r"""


_SHARE = "list_sum(list_transform(list_zip(a.h, b.h), lambda p: sqrt(p[1] * p[2]))) / sqrt(list_sum(a.h) * list_sum(b.h))"
CHAINS = {
    "o6_hist_chain": _chain_sql(_ABS, f"round(sqrt(greatest(0, 1 - {_SHARE})), 12)"),
    "o12_absdiff_chain": _chain_sql("list_transform(embedding, lambda x: x::DOUBLE)", "round(list_sum(list_transform(list_zip(a.h, b.h), lambda p: abs(p[2] - p[1]))), 12)"),
}

SUPPRESSION = f"""
    WITH RECURSIVE s AS (SELECT *, (l_partkey * 7 + l_suppkey) % 1000 / 1000 AS score FROM {_BOXES}),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM s WHERE score > 0.05),
    r AS (
        SELECT l_orderkey, 0::BIGINT AS k, []::STRUCT(k BIGINT, l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE)[] AS kept FROM o GROUP BY 1
        UNION ALL
        SELECT r.l_orderkey, o.k, CASE WHEN len(list_filter(r.kept, lambda x: greatest(0, least(x.r, o.r) - greatest(x.l, o.l) + 1) * greatest(0, least(x.b, o.b) - greatest(x.t, o.t) + 1)
            / ((x.r - x.l + 1) * (x.b - x.t + 1) + (o.r - o.l + 1) * (o.b - o.t + 1) - greatest(0, least(x.r, o.r) - greatest(x.l, o.l) + 1) * greatest(0, least(x.b, o.b) - greatest(x.t, o.t) + 1)) > 0.3)) = 0
            THEN list_append(r.kept, struct_pack(k := o.k, l := o.l, t := o.t, r := o.r, b := o.b)) ELSE r.kept END
        FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.k = r.k + 1),
    z AS (SELECT l_orderkey, unnest(arg_max(kept, k)).k AS k FROM r GROUP BY 1)
    SELECT o.* EXCLUDE (k) FROM o JOIN z ON o.l_orderkey = z.l_orderkey AND o.k = z.k WHERE score >= 0.5"""
