"""The registered queries of the curation operators and the SQL that each is checked against.

frames: line items for the faces of orders, embeddings for histograms, events for rows in time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, geometry, options, paths
from .operators import aggregates, chain, filters, joins, rank, select, windows
from .sources import faceset, files

FLAGSHIP = "o13_best_n"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


# Sorts (O1 to O12), with the split into kept and rejected rows (M3) and new names (K6)


@query("o1_sort_blur", """
    WITH e AS (SELECT event_id, CASE WHEN value < 1 THEN 0 ELSE value END AS score FROM events),
    k AS (SELECT event_id, row_number() OVER (ORDER BY score DESC, event_id) - 1 AS rank FROM e WHERE score <> 0)
    SELECT event_id, e.score = 0 OR e.score IS NULL AS is_trash, coalesce(k.rank, -1) AS rank,
           CASE WHEN k.rank IS NOT NULL THEN (CASE WHEN k.rank < 100000 THEN lpad(k.rank::VARCHAR, 5, '0') ELSE k.rank::VARCHAR END) || '.jpg' END AS new_name
    FROM e LEFT JOIN k USING (event_id)""")
def o1_sort_blur(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("value") < 1, 0.0).otherwise(F.col("value")).alias("sharp"), F.lit("in/a.jpg").alias("path")
    )
    ranked = rank.sort_by(events, F.col("sharp"), ["event_id"], reject=F.col("sharp") == 0, path="path")
    return ranked.select("event_id", "is_trash", F.coalesce("rank", F.lit(-1)).alias("rank"), "new_name")


@query("o3_sort_yaw", """
    SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS rank FROM part""")
def o3_sort_yaw(spark, sf_dir):
    ranked = rank.by_number(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", ["p_partkey"])
    return ranked.select("p_partkey", "rank")


@query("o5_sort_rect_size", """
    WITH r AS (SELECT p_partkey, p_size AS w, floor(p_retailprice / 10) AS h FROM part)
    SELECT p_partkey, (w * h)::DOUBLE AS score, row_number() OVER (ORDER BY w * h DESC, p_partkey) - 1 AS rank FROM r""")
def o5_sort_rect_size(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select(
        "p_partkey", F.lit(0).alias("l"), F.lit(0).alias("t"), F.col("p_size").alias("r"), F.floor(F.col("p_retailprice") / 10).alias("b")
    )
    return rank.by_rect_size(part, ("l", "t", "r", "b"), ["p_partkey"]).select("p_partkey", "score", "rank")


_LEVELS = "list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 20)::BIGINT)"


def _levels(spark, sf_dir):
    level = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 20))
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", level.alias("levels"))


@query("o8_sort_brightness", f"""
    WITH v AS (SELECT vec_id, list_sum({_LEVELS}) AS s FROM embeddings)
    SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS rank FROM v""")
def o8_sort_brightness(spark, sf_dir):
    return rank.by_mean(_levels(spark, sf_dir), "levels", ["vec_id"]).select("vec_id", "rank")


@query("o9_sort_black", f"""
    WITH v AS (SELECT vec_id, len(list_filter({_LEVELS}, lambda x: x = 0)) AS zeros FROM embeddings)
    SELECT vec_id, zeros::DOUBLE AS score, row_number() OVER (ORDER BY zeros, vec_id) - 1 AS rank FROM v""")
def o9_sort_black(spark, sf_dir):
    return rank.by_black(_levels(spark, sf_dir), "levels", ["vec_id"]).select("vec_id", "score", "rank")


@query("o10_sort_origname", """
    WITH p AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN url END AS source FROM pages),
    k AS (SELECT page_id, row_number() OVER (ORDER BY source, page_id) - 1 AS rank FROM p WHERE source IS NOT NULL)
    SELECT page_id, source IS NULL AS is_trash, coalesce(rank, -1) AS rank FROM p LEFT JOIN k USING (page_id)""")
def o10_sort_origname(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("source"))
    return rank.by_original_name(pages, "source", ["page_id"]).select("page_id", "is_trash", F.coalesce("rank", F.lit(-1)).alias("rank"))


_ABS = "list_transform(embedding, lambda x: abs(x::DOUBLE))"


def _histograms(spark, sf_dir):
    hist = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", hist.alias("hist"))


_BHATTACHARYYA = """sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(a.h, b.h), lambda p: sqrt(p[1] * p[2]))) / sqrt(list_sum(a.h) * list_sum(b.h))))"""


@query("o7_hist_dissimilarity", f"""
    WITH v AS (SELECT vec_id, label, {_ABS} AS h FROM embeddings)
    SELECT a.vec_id, round(sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE {_BHATTACHARYYA} END), 6) AS apart
    FROM v a JOIN v b ON a.label IS NOT DISTINCT FROM b.label GROUP BY a.vec_id""")
def o7_hist_dissimilarity(spark, sf_dir):
    found = select.unlikeness(_histograms(spark, sf_dir), "vec_id", "hist", ["label"])
    return found.select(F.col("id").alias("vec_id"), F.round("apart", 6).alias("apart"))


@query("o7_hist_dissimilarity_all")
def o7_hist_dissimilarity_all(spark, sf_dir):
    """The reference's score: over the whole table. The SQL above has it inside a label."""
    found = select.unlikeness(_histograms(spark, sf_dir), "vec_id", "hist")
    return found.select(F.col("id").alias("vec_id"), F.round("apart", 6).alias("apart"))


@query("o6_hist_chain")
def o6_hist_chain(spark, sf_dir):
    return chain.greedy_chain(_histograms(spark, sf_dir), "vec_id", "hist")


@query("o12_absdiff_chain")
def o12_absdiff_chain(spark, sf_dir):
    return chain.greedy_chain(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", "l1", most=None)


_YAW, _PITCH = "embedding[1]::DOUBLE * 4", "embedding[2]::DOUBLE * 5"
_TARGET = 300


@query("o13_best_n", f"""
    WITH edges AS (SELECT [-1.2 + k * (2.4 / 127) for k in range(127)] || [1.2] AS e),
    r AS (SELECT vec_id AS id, embedding[3]::DOUBLE AS sharp, {_PITCH} AS pitch, {_ABS} AS h,
                 greatest(len(list_filter(e, lambda x: x <= -({_YAW}))) - 1, 0) AS g FROM embeddings, edges),
    n AS (SELECT g, count(*) AS n FROM r GROUP BY g),
    q AS (SELECT ({round(_TARGET / 128)} + floor((coalesce(sum(greatest({round(_TARGET / 128)} - n, 0)), 0) + (128 - count(*)) * {round(_TARGET / 128)}) / 128))::INTEGER AS q FROM n),
    t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY sharp DESC, id) AS r1 FROM r, q),
    pe AS (SELECT q, CASE WHEN q = 1 THEN [-pi() / 2] ELSE [-pi() / 2 + k * (pi() / (q - 1)) for k in range(q - 1)] || [pi() / 2] END AS e FROM q),
    c AS (SELECT t.*, greatest(len(list_filter(e, lambda x: x <= pitch)) - 1, 0) AS pg FROM t, pe WHERE r1 <= 10 * t.q),
    s AS (SELECT a.id, round(sum(CASE WHEN a.id = b.id THEN 0 ELSE {_BHATTACHARYYA} END), 9) AS apart FROM c a JOIN c b USING (g, pg) GROUP BY a.id),
    o AS (SELECT c.*, row_number() OVER (PARTITION BY g, pg ORDER BY apart DESC, sharp DESC, c.id) AS r2 FROM c JOIN s ON c.id = s.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r2, pg) AS k FROM o),
    z AS (SELECT id, pg, row_number() OVER (ORDER BY g, k) - 1 AS rank FROM k WHERE k <= q)
    SELECT r.id AS vec_id, r.g AS yaw_bucket, coalesce(z.pg, -1) AS pitch_bucket, z.id IS NULL AS is_trash, coalesce(z.rank, -1) AS rank FROM r LEFT JOIN z ON r.id = z.id""")
def o13_best_n(spark, sf_dir):
    d = lambda k: F.col("embedding")[k].cast("double")
    rows = _t(spark, sf_dir, "embeddings").select(
        "vec_id", d(2).alias("sharp"), (d(0) * 4).alias("yaw"), (d(1) * 5).alias("pitch"),
        F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("hist"),
    )
    chosen = select.best_n(rows, "vec_id", "sharp", "yaw", "pitch", "hist", _TARGET)
    return chosen.na.fill(-1, ["pitch_bucket", "rank"])


def _boxes(spark, sf_dir):
    """Boxes in the frames of orders, from numbers that give overlaps."""
    x = F.pmod(F.col("l_partkey"), F.lit(50)).cast("double")
    y = F.pmod(F.col("l_suppkey"), F.lit(20)).cast("double")
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("l"), y.alias("t"),
        (x + F.col("l_quantity")).alias("r"), (y + F.col("l_quantity")).alias("b"),
        (F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.lit(1000)) / 1000).alias("score"),
    )


@query("o16_non_max_suppression")
def o16_non_max_suppression(spark, sf_dir):
    ties = ["l_linenumber", "l_partkey", "l_suppkey"]
    return chain.non_max_suppression(_boxes(spark, sf_dir), "l_orderkey", ("l", "t", "r", "b"), "score", ties)


_BOXES = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 50)::DOUBLE AS l, (l_suppkey % 20)::DOUBLE AS t,
    (l_partkey % 50) + l_quantity AS r, (l_suppkey % 20) + l_quantity AS b FROM lineitem)"""


@query("j10_without_overlaps", f"""
    WITH w AS (SELECT *, lag(l) OVER o AS l0, lag(t) OVER o AS t0, lag(r) OVER o AS r0, lag(b) OVER o AS b0 FROM {_BOXES}
               WINDOW o AS (PARTITION BY l_orderkey ORDER BY (r - l) * (b - t) DESC, l_linenumber, l_partkey, l_suppkey))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM w
    WHERE NOT (l0 IS NOT NULL AND least(r, r0) - greatest(l, l0) >= 0 AND least(b, b0) - greatest(t, t0) >= 0)""")
def j10_without_overlaps(spark, sf_dir):
    ties = ["l_linenumber", "l_partkey", "l_suppkey"]
    found = chain.without_overlaps(_boxes(spark, sf_dir), "l_orderkey", ("l", "t", "r", "b"), ties)
    return found.select("l_orderkey", *ties)


@query("g15_iou", f"""
    WITH w AS (SELECT *, (l_partkey % 13)::DOUBLE AS l2, (l_partkey % 13) + 20.0 AS r2 FROM {_BOXES}),
    i AS (SELECT *, greatest(0, least(r, r2) - greatest(l, l2) + 1) * greatest(0, least(b, 20) - greatest(t, 0) + 1) AS both_ FROM w)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(both_ / ((r - l + 1) * (b - t + 1) + (r2 - l2 + 1) * 21 - both_), 6) AS iou FROM i""")
def g15_iou(spark, sf_dir):
    box = _boxes(spark, sf_dir)
    low = F.pmod(F.col("l_partkey"), F.lit(13)).cast("double")
    other = (low, F.lit(0.0), low + 20.0, F.lit(20.0))
    iou = geometry.iou(tuple(F.col(c) for c in "ltrb"), other)
    return box.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(iou, 6).alias("iou"))


# Filters


@query("f1_valid_rows", """
    SELECT doc_id, quality IS NULL AS is_trash FROM documents LEFT JOIN labels USING (doc_id)""")
def f1_valid_rows(spark, sf_dir):
    labelled = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return filters.split_valid(labelled, F.col("quality").isNotNull()).select("doc_id", "is_trash")


@query("f2_one_face", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_linenumber - 1) OVER (PARTITION BY l_orderkey) > 0 AS is_trash FROM lineitem""")
def f2_one_face(spark, sf_dir):
    faces = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    faces = faces.withColumn("face", F.col("l_linenumber") - 1)
    return filters.one_face(faces, "l_orderkey", "face").drop("face")


@query("f3_large_enough", "SELECT p_partkey FROM part WHERE least(p_size * 10.0, p_retailprice) >= 128")
def f3_large_enough(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("w"), "p_retailprice")
    return filters.large_enough(part, "w", "p_retailprice").select("p_partkey")


@query("f4_groups_of_size", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) BETWEEN 50 AND 65")
def f4_groups_of_size(spark, sf_dir):
    return filters.groups_of_size(_t(spark, sf_dir, "customer"), "c_nationkey", 50, 65)


@query("f5_plausible_faces", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_linenumber = 1 OR l_linenumber > 4 OR l_extendedprice <= 4 * (l_quantity * 100)""")
def f5_plausible_faces(spark, sf_dir):
    line = F.col("l_linenumber")
    rows = _t(spark, sf_dir, "lineitem")
    kept = filters.plausible(rows, F.col("l_extendedprice"), F.col("l_quantity") * 100, line == 1, line, 4)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("f7_cleared", "SELECT count(toxic) AS changed FROM labels")
def f7_cleared(spark, sf_dir):
    return filters.cleared(_t(spark, sf_dir, "labels"), "toxic")[1]


@query("f8_first_faces", """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
    SELECT l_orderkey, count(*) AS faces, round(sum(l_extendedprice), 2) AS area FROM n WHERE k <= 2 GROUP BY 1""")
def f8_first_faces(spark, sf_dir):
    faces = filters.first_rows(_t(spark, sf_dir, "lineitem"), "l_orderkey", [F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"], 2)
    return faces.groupBy("l_orderkey").agg(F.count("*").alias("faces"), F.round(F.sum("l_extendedprice"), 2).alias("area"))


@query("f12_next_labelled", "SELECT event_id FROM events WHERE event_type = 'click' AND event_id > 500 ORDER BY event_id OFFSET 4 LIMIT 1")
def f12_next_labelled(spark, sf_dir):
    flagged = _t(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "click").alias("flag"))
    return filters.next_labelled(flagged, "event_id", "flag", 500, 5).select("event_id")


# Joins


@query("j1_frames_with_faces", """
    SELECT o_orderkey, count(l_orderkey) AS n_faces, count(l_orderkey) > 1 AS multiple,
           coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS faces
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def j1_frames_with_faces(spark, sf_dir):
    frames = _t(spark, sf_dir, "orders").select("o_orderkey")
    fields = ["l_linenumber", "l_partkey", "l_suppkey"]
    joined = joins.frames_with_faces(frames, _t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", fields)
    shown = F.transform("faces", lambda f: F.concat_ws(":", *(f[c].cast("string") for c in fields)))
    return joined.select("o_orderkey", F.size("faces").cast("long").alias("n_faces"), "multiple", F.array_join(shown, ",").alias("faces"))


@query("j2_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j2_missing(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select("c_custkey")
    return joins.missing(customers, _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("j3_annotated", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size * 10 AS w FROM lineitem JOIN part ON l_partkey = p_partkey WHERE least(p_size * 10, p_retailprice) >= 128")
def j3_annotated(spark, sf_dir):
    images = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    boxes = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 10).alias("w"), F.col("p_retailprice").alias("h"))
    return joins.annotated(images, boxes, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "w")


@query("j6_pending_frames", """
    WITH d AS (SELECT event_id FROM events WHERE event_id % 3 <> 0), o AS (SELECT event_id FROM events WHERE event_id < 700 OR event_id % 7 <> 0),
    r AS (SELECT min(event_id) - 1 AS rewind FROM d WHERE event_id NOT IN (SELECT event_id FROM o))
    SELECT event_id FROM events, r WHERE event_id % 3 = 0 OR coalesce(event_id > rewind, false)""")
def j6_pending_frames(spark, sf_dir):
    frames, k = _t(spark, sf_dir, "events").select("event_id"), F.col("event_id")
    return joins.pending_frames(frames, frames.where(k % 3 != 0), frames.where((k < 700) | (k % 7 != 0)), "event_id")


@query("j7_restored", "SELECT l.doc_id, l.quality IS DISTINCT FROM coalesce(l.toxic, 1) AS needs_resize FROM labels l JOIN documents d USING (doc_id)")
def j7_restored(spark, sf_dir):
    saved = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("shape"))
    files = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id")
    files = files.select("doc_id", F.coalesce("toxic", F.lit(1)).alias("shape"))
    return joins.restored(files, saved, "doc_id", "shape").select("doc_id", "needs_resize")


@query("j11_from_last", "SELECT event_id FROM events WHERE event_id >= (SELECT min(event_id) FROM (SELECT event_id FROM events WHERE event_id % 2 = 0 ORDER BY event_id DESC LIMIT 128))")
def j11_from_last(spark, sf_dir):
    frames = _t(spark, sf_dir, "events").select("event_id")
    return joins.from_last(frames.where("event_id % 2 = 0"), frames, "event_id")


# Aggregates


@query("a1_counts", "SELECT count(*) AS images, (SELECT count(*) FROM lineitem) AS faces FROM orders")
def a1_counts(spark, sf_dir):
    faces = _t(spark, sf_dir, "lineitem").agg(F.count("*").alias("faces"))
    return _t(spark, sf_dir, "orders").agg(F.count("*").alias("images")).crossJoin(F.broadcast(faces))  # two single rows


@query("a2_persons", "SELECT count(DISTINCT coalesce(CASE WHEN c_nationkey > 3 THEN c_nationkey END, -1)) AS persons FROM customer")
def a2_persons(spark, sf_dir):
    person = F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("person")
    return aggregates.persons(_t(spark, sf_dir, "customer").select(person), "person")


@query("a5_masks_by_id", """
    WITH m AS (SELECT user_id, event_type, max(props) AS p FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type || '=' || p, ';' ORDER BY event_type) AS masks FROM m GROUP BY 1""")
def a5_masks_by_id(spark, sf_dir):
    found = aggregates.masks_by_id(_t(spark, sf_dir, "events"), "user_id", "event_type", "props")
    shown = F.transform(F.map_entries("masks"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("user_id", F.array_join(shown, ";").alias("masks"))


@query("a10_colour_stats", """
    WITH g AS (SELECT user_id, count(*) FILTER (event_id % 3 <> 0) AS n, avg(value) FILTER (event_id % 3 <> 0) AS m, stddev_pop(value) FILTER (event_id % 3 <> 0) AS s FROM events GROUP BY 1)
    SELECT user_id, n, round(CASE WHEN n < 10 THEN NULL WHEN n < 100 THEN 0 ELSE m END, 6) AS value_mean,
           round(CASE WHEN n < 10 THEN NULL WHEN n < 100 THEN 1 ELSE s END, 6) AS value_std FROM g""")
def a10_colour_stats(spark, sf_dir):
    found = aggregates.colour_stats(_t(spark, sf_dir, "events"), ["user_id"], ["value"], F.col("event_id") % 3 != 0)
    return found.select("user_id", "n", F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 6).alias("value_std"))


@query("a12_covariances", """
    SELECT l_returnflag, round(covar_pop(l_quantity, l_quantity) + 0.001, 4) AS cov_qq, round(covar_pop(l_quantity, l_discount), 6) AS cov_qd,
           round(covar_pop(l_discount, l_discount) + 0.001, 6) AS cov_dd FROM lineitem GROUP BY 1""")
def a12_covariances(spark, sf_dir):
    found = aggregates.covariances(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount"], 0.001)
    qq, qd, dd = (f"cov_{a}_{b}" for a, b in (("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_discount", "l_discount")))
    return found.select("l_returnflag", F.round(qq, 4).alias("cov_qq"), F.round(qd, 6).alias("cov_qd"), F.round(dd, 6).alias("cov_dd"))


@query("a14_cumulative_share", """
    SELECT DISTINCT l_returnflag, l_quantity, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 9) AS share FROM lineitem""")
def a14_cumulative_share(spark, sf_dir):
    found = aggregates.cumulative_share(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return found.withColumn("share", F.round("share", 9))


@query("a14_matched", """
    WITH s AS (SELECT DISTINCT l_quantity AS v, cume_dist() OVER (ORDER BY l_quantity) AS q FROM lineitem),
    d AS (SELECT DISTINCT p_size::DOUBLE AS w, cume_dist() OVER (ORDER BY p_size) AS q FROM part),
    m AS (SELECT v, s.q, (SELECT max(struct_pack(q := d.q, w := d.w)) FROM d WHERE d.q <= s.q) AS lo, (SELECT min(struct_pack(q := d.q, w := d.w)) FROM d WHERE d.q >= s.q) AS hi FROM s)
    SELECT v AS value, round(CASE WHEN lo IS NULL THEN hi.w WHEN hi IS NULL THEN lo.w WHEN hi.q = m.q THEN hi.w
                                  ELSE lo.w + (hi.w - lo.w) * (m.q - lo.q) / (hi.q - lo.q) END, 6) AS matched FROM m""")
def a14_matched(spark, sf_dir):
    source = _t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("value"))
    target = _t(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("value"))
    return aggregates.matched(source, target, "value").withColumn("matched", F.round("matched", 6))


@query("a15_every_kth", "SELECT event_id FROM events WHERE event_id % (SELECT CASE WHEN count(*) > 2000 THEN count(*) // 1000 ELSE 1 END FROM events) = 0")
def a15_every_kth(spark, sf_dir):
    return aggregates.every_kth(_t(spark, sf_dir, "events").select("event_id"), "event_id", 2000, 1000)


@query("a16_columns", """
    SELECT floor(event_id * 64 / (SELECT max(event_id) + 1 FROM events))::BIGINT AS "column", min(value) AS low, max(value) AS high FROM events GROUP BY 1""")
def a16_columns(spark, sf_dir):
    return aggregates.columns_of(_t(spark, sf_dir, "events"), "event_id", "value", 64)


@query("a17_report", "SELECT event_type, round(avg(value), 6) AS mean, max_by(value, event_id) AS latest FROM events GROUP BY 1")
def a17_report(spark, sf_dir):
    grouped = _t(spark, sf_dir, "events").groupBy("event_type")
    return grouped.agg(F.round(F.avg("value"), 6).alias("mean"), F.max_by("value", "event_id").alias("latest"))


@query("a20_peak", """
    WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_position(embedding, list_max(embedding)) - 1 AS k FROM embeddings)
    SELECT vec_id, (k + CASE WHEN k > 0 AND k < len(e) - 1 THEN sign(e[k + 2] - e[k]) * 0.25::DOUBLE ELSE 0 END)::DOUBLE AS peak FROM p""")
def a20_peak(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", arrays.peak(F.col("embedding").cast("array<double>")).alias("peak"))


@query("a21_bounding_box", """
    SELECT user_id, count(*) AS n, min(event_id) AS min_x, max(event_id) AS max_x, min(event_id % 97) AS min_y, max(event_id % 97) AS max_y
    FROM events WHERE value >= 40 GROUP BY 1 HAVING count(*) >= 4""")
def a21_bounding_box(spark, sf_dir):
    points = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), (F.col("event_id") % 97).alias("y"), "value")
    return aggregates.bounding_box(points, ["user_id"], "x", "y", "value", 40)


# Windows and names


@query("w1_motion", """
    WITH m AS (SELECT event_id, coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS dx,
                      coalesce(lead(event_id % 89) OVER w, event_id % 89) - coalesce(lag(event_id % 89) OVER w, event_id % 89) AS dy
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, round(sqrt(dx * dx + dy * dy), 6) AS motion_power,
           round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE -degrees(atan2(dy, dx)) END, 6) + 0.0 AS motion_deg FROM m""")
def w1_motion(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("value").alias("x"), (F.col("event_id") % 89).alias("y"))
    found = windows.motion(rows, ["user_id"], ["ts", "event_id"], "x", "y")
    return found.select("event_id", F.round("motion_power", 6).alias("motion_power"), (F.round("motion_deg", 6) + 0.0).alias("motion_deg"))


@query("w2_sliding", """
    WITH s AS (SELECT event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m FROM events)
    SELECT event_id, array_to_string(m, ',') AS members FROM s WHERE len(m) = 4""")
def w2_sliding(spark, sf_dir):
    found = windows.sliding(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id", 4)
    return found.select("event_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("w3_strided", """
    WITH s AS (SELECT event_id, 1 + event_id % 4 AS m, lead(event_id, 8) OVER w AS far, CASE 1 + event_id % 4
        WHEN 1 THEN [event_id, lead(event_id, 1) OVER w, lead(event_id, 2) OVER w] WHEN 2 THEN [event_id, lead(event_id, 2) OVER w, lead(event_id, 4) OVER w]
        WHEN 3 THEN [event_id, lead(event_id, 3) OVER w, lead(event_id, 6) OVER w] ELSE [event_id, lead(event_id, 4) OVER w, lead(event_id, 8) OVER w] END AS x
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, array_to_string(x, ',') AS members FROM s WHERE far IS NOT NULL""")
def w3_strided(spark, sf_dir):
    stride = (1 + F.col("event_id") % 4).cast("int")
    found = windows.strided(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id", 3, stride)
    return found.select("event_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("w4_neighbours", """
    SELECT event_id, concat_ws(',', coalesce(lag(event_id, 2) OVER w, first(event_id) OVER w), coalesce(lag(event_id) OVER w, first(event_id) OVER w), event_id,
           coalesce(lead(event_id) OVER w, last(event_id) OVER z), coalesce(lead(event_id, 2) OVER w, last(event_id) OVER z)) AS members
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
         z AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def w4_neighbours(spark, sf_dir):
    found = windows.neighbours(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id", 2)
    return found.select("event_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("w5_smoothed", """
    SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM events""")
def w5_smoothed(spark, sf_dir):
    found = windows.smoothed(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return found.select("event_id", F.round("smooth", 6).alias("smooth"))


@query("k7_recovered_names", """
    SELECT event_id, event_type || '_' || (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) || '.jpg' AS original FROM events""")
def k7_recovered_names(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(".jpg")).alias("source"))
    return windows.recovered_names(rows, "source", ["event_id"]).select("event_id", "original")


@query("s3_unique_stems", """
    SELECT min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)[.][^.]*$', '\\1') AS stem,
           row_number() OVER (PARTITION BY regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)[.][^.]*$', '\\1') ORDER BY url, page_id) AS k FROM pages) WHERE k = 1 GROUP BY stem""")
def s3_unique_stems(spark, sf_dir):
    return files.unique_stems(_t(spark, sf_dir, "pages").select("page_id", "url"), "url", ["page_id"]).select("page_id")


@query("s14_options", """
    SELECT event_id, props->>'$.k' AS raw FROM events""")
def s14_options(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", options.read(F.col("props"))["k"].alias("raw"))


# Sets, scalars, kernels


@query("u1_concat", "SELECT 'c' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier")
def u1_concat(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(_t(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation")))


@query("u2_unvisited", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem")
def u2_unvisited(spark, sf_dir):
    visited = _t(spark, sf_dir, "lineitem").select("l_partkey")
    return _t(spark, sf_dir, "part").select("p_partkey").subtract(visited)


@query("u3_distinct", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1")
def u3_distinct(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))


@query("u4_members", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def u4_members(spark, sf_dir):
    customers, orders = _t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_semi")


@query("m1_bucket", """
    WITH e AS (SELECT [-1.2 + k * (2.4 / 127) for k in range(127)] || [1.2] AS e)
    SELECT vec_id, greatest(len(list_filter(e, lambda x: x <= embedding[1]::DOUBLE * 4)) - 1, 0) AS bucket FROM embeddings, e""")
def m1_bucket(spark, sf_dir):
    yaw = F.col("embedding")[0].cast("double") * 4
    return _t(spark, sf_dir, "embeddings").select("vec_id", arrays.bucket(yaw, arrays.YAW_EDGES).alias("bucket"))


@query("g2_geometry", """
    SELECT event_id, round(value * cos(radians(event_id % 360)) - user_id * sin(radians(event_id % 360)), 6) AS x,
           round(value * sin(radians(event_id % 360)) + user_id * cos(radians(event_id % 360)), 6) AS y,
           ceil(log2(1 + event_id))::INTEGER AS power FROM events""")
def g2_geometry(spark, sf_dir):
    x, y = geometry.rotate(F.col("value"), F.col("user_id"), F.col("event_id") % 360)
    return _t(spark, sf_dir, "events").select(
        "event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), arrays.power_of_two(1 + F.col("event_id")).alias("power")
    )


# Further operators of the inventory


@query("f6_labelled_only", "SELECT vec_id FROM embeddings WHERE label > 1000 OR label >= 3")
def f6_labelled_only(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = filters.first_that_holds(rows, lambda d: d.where("label > 1000"), lambda d: d.where("label >= 3"))
    return found.select("vec_id")


@query("f9_passthrough", """
    SELECT c_custkey, coalesce(count(o_orderkey), 0) AS n, count(o_orderkey) = 0 AS is_empty FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def f9_passthrough(spark, sf_dir):
    faces = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    joined = joins.frames_with_faces(_t(spark, sf_dir, "customer").select("c_custkey"), faces, "c_custkey", "o_custkey", ["o_orderkey"])
    return joined.select("c_custkey", F.size("faces").cast("long").alias("n"), (F.size("faces") == 0).alias("is_empty"))


@query("f11_not_detected", """
    SELECT count(*) FILTER (n = 0) AS missed, bool_and(n > 0) AS all_detected
    FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""")
def f11_not_detected(spark, sf_dir):
    frames = _t(spark, sf_dir, "orders").select("o_orderkey")
    joined = joins.frames_with_faces(frames, _t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", ["l_linenumber"])
    n = F.size("faces")
    return joined.agg(F.sum((n == 0).cast("long")).alias("missed"), F.bool_and(n > 0).alias("all_detected"))


@query("k9_newest_versions", "SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 24")
def k9_newest_versions(spark, sf_dir):
    return faceset.newest_versions(_t(spark, sf_dir, "events").select("event_id"), "event_id")


@query("s13_mask_names", """
    SELECT p_partkey, split_part(p_name, ' ', 1) AS id, substr(p_name, length(split_part(p_name, ' ', 1)) + 2) AS mask_type FROM part WHERE p_name LIKE '% %'""")
def s13_mask_names(spark, sf_dir):
    named = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "_"), F.lit(".png")).alias("path"))
    found = named.select("p_partkey", paths.id_and_mask(F.col("path")).alias("m")).where("m IS NOT NULL")
    return found.select("p_partkey", "m.id", "m.mask_type")


@query("s17_streams", """
    SELECT user_id AS path, event_type AS codec_type, min(event_id) AS index, arg_min(props, event_id) AS r_frame_rate FROM events
    WHERE event_type IN ('click', 'error') GROUP BY 1, 2""")
def s17_streams(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "video").when(F.col("event_type") == "error", "audio").alias("codec_type")
    probe = _t(spark, sf_dir, "events").select(F.col("user_id").alias("path"), kind, F.col("event_id").alias("index"), F.col("props").alias("r_frame_rate"))
    found = files.streams(probe)
    return found.withColumn("codec_type", F.when(F.col("codec_type") == "video", "click").otherwise("error"))


@query("o15_area_descending", """
    SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS faces FROM lineitem GROUP BY 1""")
def o15_area_descending(spark, sf_dir):
    face = F.struct((-F.col("l_extendedprice")).alias("a"), "l_linenumber", "l_partkey", "l_suppkey")
    frames = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(face)).alias("f"))
    shown = F.transform("f", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    return frames.select("l_orderkey", F.array_join(shown, ",").alias("faces"))


@query("o18_include_first", """
    SELECT user_id, string_agg(event_id, ',' ORDER BY (event_type <> 'click')::INT, event_id) AS polygons FROM events GROUP BY 1""")
def o18_include_first(spark, sf_dir):
    polygon = F.struct(F.col("event_id").alias("at"), (F.col("event_type") == "click").cast("int").alias("type"))
    grouped = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(polygon)).alias("p"))
    ordered = F.transform(geometry.include_first(F.col("p")), lambda p: p["at"].cast("string"))
    return grouped.select("user_id", F.array_join(ordered, ",").alias("polygons"))


@query("a18_last_rows", "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 500")
def a18_last_rows(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("event_id")).limit(500)


@query("g14_histogram_distance", f"""
    WITH v AS (SELECT vec_id, {_ABS} AS h FROM embeddings)
    SELECT a.vec_id, round({_BHATTACHARYYA}, 6) AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def g14_histogram_distance(spark, sf_dir):
    a = _histograms(spark, sf_dir).select("vec_id", F.col("hist").alias("a"))
    b = _histograms(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("hist").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(arrays.bhattacharyya(F.col("a"), F.col("b")), 6).alias("distance"))


@query("g17_rescaled_boxes", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc(l * 1.5)::BIGINT AS l, trunc(t * 1.5)::BIGINT AS t, trunc(r * 1.5)::BIGINT AS r,
           trunc(b * 1.5 + (b * 1.5 - t * 1.5) * 0.1::DOUBLE)::BIGINT AS b FROM {_BOXES}""")
def g17_rescaled_boxes(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    l, t, r, b = geometry.rescale_rect(tuple(F.col(c) for c in "ltrb"), F.lit(1.5))  # noqa: E741
    return boxes.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b"))


from . import queries_more  # noqa: E402  (it registers its queries with the decorator above)

ORACLE_SQL |= queries_more.CHAINS | {"o16_non_max_suppression": queries_more.SUPPRESSION}
