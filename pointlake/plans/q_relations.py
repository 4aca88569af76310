"""Queries on joins, geometry and task synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import raster as RA
from ..functions import rng as RNG
from ..operators import tasks as T
from .registry import joined, query, table

#: Objects: vectors in images of 50, placed by their first two components on 1000 x 800 pixels.
_OBJECTS = """o AS (SELECT vec_id // 50 AS image_id, vec_id AS object_id, vec_id % 50 AS object_order, 'k' || label AS same_class_key,
 round((embedding[1]::DOUBLE + 1) / 2 * 1000, 3) AS center_x, round((embedding[2]::DOUBLE + 1) / 2 * 800, 3) AS center_y FROM embeddings)"""


def objects(spark, sf):
    e = table(spark, sf, "embeddings")
    at = lambda k, s: F.round((F.get("embedding", k).cast("double") + 1) / 2 * s, 3)
    image = F.expr("vec_id div 50")
    return e.select(
        image.alias("image_id"), F.col("vec_id").alias("object_id"), (F.col("vec_id") % 50).alias("object_order"), image.alias("image_order"), F.concat(F.lit("k"), "label").alias("same_class_key"),
        F.concat(F.lit("K "), "label").alias("label_display"), at(0, 1000).alias("center_x"), at(1, 800).alias("center_y"),
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def lookup_inner_n1(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return l.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'missing_sam_mask' END AS drop_reason FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey")
def lookup_left_miss(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("hit"))
    return o.join(c, "o_custkey", "left").select("o_orderkey", F.when(F.col("hit").isNull(), "missing_sam_mask").alias("drop_reason"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def semi_join_ids(spark, sf):
    ids = table(spark, sf, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice").join(ids, "o_custkey", "left_semi").drop("o_custkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN 'steerability' ELSE c_mktsegment END AS category FROM customer")
def category_override(spark, sf):
    hit = table(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("hit"))
    return table(spark, sf, "customer").join(hit, "c_nationkey", "left").select("c_custkey", F.when(F.col("hit"), "steerability").otherwise(F.col("c_mktsegment")).alias("category"))


@query(f"""
WITH {_OBJECTS}, a AS (SELECT *, center_x - 20 AS ax, center_y + 10 AS ay FROM o),
d AS (SELECT a.image_id, a.object_id, b.object_id AS other_id, b.object_order AS oo, sqrt((b.center_x - ax) ** 2 + (b.center_y - ay) ** 2) AS d FROM a JOIN o b ON a.image_id = b.image_id AND a.same_class_key = b.same_class_key),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, object_id ORDER BY d, oo) AS n FROM d),
t AS (SELECT image_id, object_id, max(other_id) FILTER (n = 1) AS closest_id, max(d) FILTER (n = 1) AS d1, max(d) FILTER (n = 2) AS d2 FROM r WHERE n <= 2 GROUP BY 1, 2)
SELECT image_id, object_id, closest_id, round(d1, 3) AS closest_dist, round(d2, 3) AS second_dist, closest_id = object_id AND coalesce(d2 - d1 >= greatest(12.0, d1 * 0.12), true) AS pass FROM t""")
def same_label_nearest(spark, sf):
    o = objects(spark, sf)
    a = o.select("image_id", "object_id", (F.col("center_x") - 20).alias("ax"), (F.col("center_y") + 10).alias("ay"))
    return T.same_class_nearest(o, a).drop("margin_px", "min_margin_px")


def _delta(x: str, y: str, name: str) -> str:
    bear = f"(degrees(atan2({y}, {x})) + 360)"
    turn = f"abs(({bear} - floor({bear} / 360) * 360) - {name})"
    return f"round(least({turn}, 360 - {turn}), 6)"


_BASE = "CASE WHEN a.object_id % 4 = 0 THEN 0.0 WHEN a.object_id % 4 = 1 THEN 90.0 WHEN a.object_id % 4 = 2 THEN 180.0 ELSE 270.0 END"


@query(f"""
WITH {_OBJECTS}, a AS (SELECT *, center_x - 30 AS ax, center_y AS ay FROM o), m AS (SELECT a.*, {_BASE} AS base FROM a),
d AS (SELECT m.image_id, m.object_id, {_delta("m.center_x - ax", "m.center_y - ay", "base")} AS delta, sqrt((m.center_x - ax) ** 2 + (m.center_y - ay) ** 2) AS d,
 b.object_id AS other, {_delta("b.center_x - ax", "b.center_y - ay", "base")} AS odelta, sqrt((b.center_x - ax) ** 2 + (b.center_y - ay) ** 2) AS od FROM m JOIN o b ON m.image_id = b.image_id AND m.same_class_key = b.same_class_key)
SELECT image_id, object_id, round(max(d), 3) AS distance_px, count(*) FILTER (other <> object_id AND odelta <= 45) AS n_sector, max(delta) <= 10 AND count(*) FILTER (other <> object_id AND odelta <= 45 AND od < d) = 0 AS pass FROM d GROUP BY 1, 2""")
def sector_nearest(spark, sf):
    o = objects(spark, sf)
    k = F.col("object_id") % 4
    name = F.when(k == 0, "right").when(k == 1, "down").when(k == 2, "left").otherwise("up")
    a = o.select("image_id", "object_id", (F.col("center_x") - 30).alias("ax"), F.col("center_y").alias("ay"), name.alias("direction"))
    return T.sector_nearest(o, a).select("image_id", "object_id", "distance_px", "n_sector", "pass")


@query(f"""
WITH {_OBJECTS}, u AS (SELECT * FROM o QUALIFY count(*) OVER (PARTITION BY image_id, same_class_key) = 1), dirs(direction, base) AS (VALUES ('right', 0.0), ('down-right', 45.0), ('down', 90.0), ('down-left', 135.0), ('left', 180.0), ('up-left', 225.0), ('up', 270.0), ('up-right', 315.0)),
j AS (SELECT o.image_id, o.object_id, u.object_id AS anchor_id, o.center_x - u.center_x AS dx, o.center_y - u.center_y AS dy FROM o JOIN u ON o.image_id = u.image_id AND o.same_class_key <> u.same_class_key)
SELECT image_id, object_id, anchor_id, direction, round(sqrt(dx * dx + dy * dy), 3) AS distance_px FROM j, dirs WHERE {_delta("dx", "dy", "base")} <= 10""")
def other_class_anchors(spark, sf):
    return T.other_class_anchors(objects(spark, sf)).drop("delta_deg")


@query(f"WITH {_OBJECTS} SELECT image_id, object_id, count(*) OVER (PARTITION BY image_id, same_class_key) AS same_count FROM o QUALIFY count(*) OVER (PARTITION BY image_id, same_class_key) BETWEEN 2 AND 4")
def instance_gate(spark, sf):
    return T.instance_gate(objects(spark, sf)).select("image_id", "object_id", "same_count")


@query("""
WITH p AS (SELECT vec_id // 50 AS image_id, 'r' || label AS row_id, least(1, greatest(0, embedding[1]::DOUBLE + 0.5)) AS x, least(1, greatest(0, embedding[2]::DOUBLE + 0.5)) AS y FROM embeddings),
g AS (SELECT image_id, row_id, count(*) AS point_count, round(avg(x) * 640, 3) AS center_x, round(avg(y) * 480, 3) AS center_y, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS spread FROM p GROUP BY 1, 2)
SELECT image_id, row_id, point_count, center_x, center_y, CASE WHEN point_count > 8 THEN 'too_many_points_for_single_instance' WHEN point_count >= 3 AND spread > 0.25 THEN 'multi_point_spread_too_large' END AS drop_reason FROM g""")
def group_points_agg(spark, sf):
    """Point records -> objects with centre, spread and the reason they are dropped for."""
    e = table(spark, sf, "embeddings")
    half = lambda k: F.get("embedding", k).cast("double") + 0.5
    r = e.select(F.expr("vec_id div 50").alias("image_id"), F.lit("a.png").alias("image_path"), F.lit(640).alias("image_width"), F.lit(480).alias("image_height"), F.concat(F.lit("r"), "label").alias("row_id"), F.lit("cup").alias("label_raw"), F.lit("cup").alias("label_clean"), F.col("vec_id").alias("pos"), half(0).alias("point_x_norm"), half(1).alias("point_y_norm"))
    return T.objects(r).select("image_id", "row_id", "point_count", "center_x", "center_y", "drop_reason")


@query(f"""
WITH {_OBJECTS} SELECT image_id, same_class_key, 'label_' || lpad((dense_rank() OVER (PARTITION BY image_id ORDER BY same_class_key) - 1)::VARCHAR, 3, '0') AS label_group_id, count(*) AS object_count, string_agg(object_id::VARCHAR, ',' ORDER BY object_order) AS object_ids FROM o GROUP BY image_id, same_class_key""")
def label_groups(spark, sf):
    o = objects(spark, sf).withColumn("points", F.array(F.struct(F.col("center_x").alias("x"), F.col("center_y").alias("y"))))
    return T.label_groups(o).drop("label_display", "points").withColumn("object_ids", joined(F.col("object_ids").cast("array<string>")))


@query("SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) <= CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 5 ELSE 0 END")
def task_quota(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("task_type"))
    return T.task_quota(o, {"1-URGENT": 30, "2-HIGH": 5, "3-MEDIUM": -4}, ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("task_type").alias("o_orderpriority"))


@query("""
SELECT l_orderkey AS candidate_id, l_partkey, l_suppkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) = 1""")
def candidate_dedup_sort(spark, sf):
    l = table(spark, sf, "lineitem")
    ins = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    c = l.select(F.col("l_orderkey").alias("candidate_id"), "l_partkey", "l_suppkey", "l_linenumber", ins.alias("ins"), F.col("l_partkey").alias("image_order"), F.col("l_suppkey").alias("object_order"), F.col("l_linenumber").alias("task_rank"), F.col("l_returnflag").alias("direction_text"))
    return T.dedup_sorted(c, "ins").select("candidate_id", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY f, o_custkey) - 1 + 100 AS new_order FROM (SELECT o_orderkey, o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders)")
def dense_renumber(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return T.renumber(o, "o_custkey", "o_orderkey", 100).select("o_orderkey", "new_order")


def _names(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _greedy_sql() -> str:
    """Task after task: the best candidate of each image that is still free, the first images up to the quota."""
    quota, out = T.targets_for(1000), []
    for k, t in enumerate(sorted(quota, key=lambda t: (T.P.TASK_SHARES[t], t))):
        free = "".join(f" AND image_id NOT IN (SELECT image_id FROM w{j})" for j in range(k))
        best = f"SELECT * FROM c WHERE task_type = '{t}'{free} QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY image_order, object_order, task_rank, candidate_id) = 1"
        out.append(f"w{k} AS (SELECT * FROM ({best}) ORDER BY image_order, image_id LIMIT {quota[t]})")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT image_id, candidate_id, task_type FROM w{k}" for k in range(len(out)))


@query(f"WITH {_OBJECTS}, c AS (SELECT *, image_id AS image_order, {_names(T.P.TASK_TYPES)}[object_id % 5 + 1] AS task_type, object_id % 5 AS task_rank, object_id AS candidate_id FROM o), {_greedy_sql()}")
def greedy_one_per_group(spark, sf):
    """One candidate for each image, scarce tasks first."""
    o = objects(spark, sf)
    k = F.col("object_id") % 5
    c = o.withColumns({"task_type": F.element_at(F.array(*map(F.lit, T.P.TASK_TYPES)), (k + 1).cast("int")), "task_rank": k, "candidate_id": F.col("object_id")})
    return T.one_per_image(c, T.targets_for(1000)).select("image_id", "candidate_id", "task_type")


@query()
def task_candidates(spark, sf):
    """Object x direction -> judged -> first accepted -> quota."""
    c = T.candidate_pool(objects(spark, sf), {"nearest_among_objects_axis_constrained": 10_000})
    return c.select("candidate_id", "image_id", "object_id", "direction_text", "task_type")


@query(f"""
WITH {_OBJECTS} SELECT object_id, greatest(0.0, least(99.0, center_x)) AS clipped, round(greatest(0, least(1, center_x / 999.0)), 3) AS norm, greatest(0.0, least(999.0, center_x / 1000 * 999)) AS pixel FROM o""")
def clip_and_scale(spark, sf):
    x = F.col("center_x")
    return objects(spark, sf).select("object_id", G.clip_pixel(x, F.lit(100)).alias("clipped"), G.pixel_to_norm(x, F.lit(1000)).alias("norm"), G.norm_to_pixel(x / 1000, F.lit(1000)).alias("pixel"))


@query(f"""
WITH {_OBJECTS} SELECT object_id, CASE WHEN center_x <= 1000 AND center_y <= 1000 THEN round_even(center_x / 1000 * 639, 0)::INT END AS x FROM o""")
def predicted_pixels(spark, sf):
    p = G.predicted_pixel(F.col("center_x"), F.col("center_y"), F.lit(640), F.lit(480), False)
    return objects(spark, sf).select("object_id", p["x"].alias("x"))


@query(f"""
WITH {_OBJECTS}, b AS (SELECT object_id, degrees(atan2(center_y - 400, center_x - 500)) AS d FROM o), c AS (SELECT object_id, d + 360 - floor((d + 360) / 360) * 360 AS deg FROM b)
SELECT object_id, round(deg, 6) AS bearing, ['right', 'down-right', 'down', 'down-left', 'left', 'up-left', 'up', 'up-right'][(floor((deg + 22.5) / 45)::INT % 8) + 1] AS compass FROM c""")
def bearings(spark, sf):
    a = (F.lit(500.0), F.lit(400.0), F.col("center_x"), F.col("center_y"))
    return objects(spark, sf).select("object_id", F.round(G.bearing(*a), 6).alias("bearing"), G.nearest_direction(*a).alias("compass"))


@query(f"WITH {_OBJECTS} SELECT object_id, round(greatest(exp(-((center_x - 500) ** 2 + (center_y - 400) ** 2) / 20000.0), exp(-((center_x - 300) ** 2 + (center_y - 300) ** 2) / 20000.0)), 9) AS peak FROM o")
def gaussian_map_peak(spark, sf):
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((500.0, 400.0), (300.0, 300.0))])
    return objects(spark, sf).select("object_id", F.round(G.gaussian_peak(pts, F.col("center_x"), F.col("center_y"), 100.0), 9).alias("peak"))


@query(f"""
WITH {_OBJECTS} SELECT object_id, CASE WHEN object_id % 2 = 0 THEN 500.0 ELSE center_x END::DOUBLE AS x, CASE WHEN object_id % 2 = 0 THEN center_y ELSE 400.0 END::DOUBLE AS y FROM o""")
def two_step_paths(spark, sf):
    axis = F.when(F.col("object_id") % 2 == 0, "up").otherwise("right")
    p = F.get(G.two_step_path(F.lit(500.0), F.lit(400.0), F.col("center_x"), F.col("center_y"), axis), 1)
    return objects(spark, sf).select("object_id", p["x"].alias("x"), p["y"].alias("y"))


@query("SELECT e.event_id, CASE WHEN e.event_id % 2 = 0 THEN least(300.0, round(15.0 * pow(1.7, e.event_id % 9), 6)) ELSE least(8.0, round(pow(1.6, e.event_id % 9), 6)) END AS seconds FROM events e")
def backoff_schedule(spark, sf):
    e = table(spark, sf, "events")
    s = G.backoff(F.col("event_id") % 9 + 1, F.when(F.col("event_id") % 2 == 0, 429).otherwise(503))
    return e.select("event_id", F.round(s, 6).alias("seconds"))


@query("SELECT event_id, round(CASE WHEN event_id < 100 THEN event_id / 100.0::DOUBLE ELSE 0.5 * (1 + cos(greatest(0, least(1, (event_id - 100) / 900.0::DOUBLE)) * pi())) END, 9) AS rate FROM events")
def learning_rates(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(G.learning_rate(F.col("event_id"), 100, 1000), 9).alias("rate"))


@query()
def seeded_anchor(spark, sf):
    o = objects(spark, sf)
    a = RNG.anchor(F.lit(7), F.col("image_id").cast("string"), F.col("object_id").cast("string"), F.lit("right"), "center_x", "center_y", F.lit(0.0), F.lit(1000.0), F.lit(800.0))
    return o.select("object_id", a.alias("a")).select("object_id", F.round("a.x", 3).alias("x"), F.round("a.y", 3).alias("y"), F.round("a.angle", 3).alias("angle"), F.round("a.radius", 3).alias("radius"))


@query()
def perturb_points(spark, sf):
    pts = F.array(F.struct(F.col("center_x").alias("x"), F.col("center_y").alias("y")))
    p = RNG.perturb(F.col("object_id").cast("string"), pts, F.lit(1000), F.lit(800))
    return objects(spark, sf).select("object_id", p.alias("p")).select("object_id", "p.corrected", F.size("p.points").alias("n"))


@query()
def mask_path_check(spark, sf):
    """A line to each object over a disc around it: parts and pixels outside the disc."""
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    o = objects(spark, sf).select("object_id", (F.col("center_x") / 10).alias("x"), (F.col("center_y") / 10).alias("y"))
    line = RA.line_mask(F.lit(80), F.lit(100), F.array(pt(F.lit(50.0), F.lit(40.0)), pt(F.col("x"), F.col("y"))), F.lit(2))
    dot = RA.dilated(RA.line_mask(F.lit(80), F.lit(100), F.array(pt(F.col("x"), F.col("y")), pt(F.col("x"), F.col("y"))), F.lit(1)), F.lit(5))
    m = o.withColumns({"line": line, "dot": dot})
    j = RA.path_judge("line", "dot", F.array(F.col("line")))
    return m.select("object_id", j.alias("j")).select("object_id", "j.components", "j.remainder_pixels", "j.path_pixels", "j.other_pixels", T.path_gate(F.col("j.components"), F.col("j.other_pixels")).alias("pass"))


@query("""
WITH p AS (SELECT vec_id AS path_id, vec_id // 50 AS image_id, 'k' || label AS key, unnest(range(0, 20)) AS x, vec_id % 30 AS y FROM embeddings),
m AS (SELECT DISTINCT vec_id // 50 AS image_id, 'k' || label AS mask_key, vec_id % 20 AS x, vec_id % 30 AS y FROM embeddings),
f AS (SELECT p.* FROM p LEFT JOIN m ON p.image_id = m.image_id AND p.key = m.mask_key AND p.x = m.x AND p.y = m.y WHERE m.x IS NULL)
SELECT path_id, count(DISTINCT (f.x, f.y)) AS hit_pixels, count(DISTINCT mask_key) AS hit_groups FROM f JOIN m ON f.image_id = m.image_id AND f.x = m.x AND f.y = m.y AND m.mask_key <> f.key GROUP BY path_id""")
def path_pixel_hits(spark, sf):
    """Pixels of paths on masks of other classes: equi-joins on pixels."""
    e = table(spark, sf, "embeddings").select("vec_id", F.expr("vec_id div 50").alias("image_id"), F.concat(F.lit("k"), "label").alias("key"), (F.col("vec_id") % 30).alias("y"))
    paths = e.select(F.col("vec_id").alias("path_id"), "image_id", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("x"), "y")
    masks = e.select("image_id", F.col("key").alias("mask_key"), (F.col("vec_id") % 20).alias("x"), "y").distinct()
    return T.path_hits(paths, masks)


@query("SELECT p_name, rn AS pos FROM (SELECT p_name, f, row_number() OVER (ORDER BY f) AS rn FROM (SELECT p_name, min(p_partkey) AS f FROM part GROUP BY p_name)) WHERE rn <= 10")
def first_images(spark, sf):
    """The first ten names in order of appearance."""
    from pyspark.sql import Window

    firsts = T.first_keys(table(spark, sf, "part").select("p_name", "p_partkey"), "p_name", [F.col("p_partkey")], 10)
    at = table(spark, sf, "part").select("p_name", "p_partkey").join(firsts, "p_name", "left_semi").groupBy("p_name").agg(F.min("p_partkey").alias("f"))
    return at.select("p_name", F.row_number().over(Window.orderBy("f")).cast("long").alias("pos"))


@query(f"WITH {_OBJECTS} SELECT image_id, min_by(object_id, (center_x, object_id)) AS object_id FROM o WHERE center_x > 400 GROUP BY image_id")
def first_accepted(spark, sf):
    o = objects(spark, sf).withColumn("position", F.struct("center_x", "object_id"))
    return T.first_accepted(o, ["image_id"], "position", F.col("center_x") > 400).select("image_id", "object_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 4 END, o_orderkey")
def group_ordered(spark, sf):
    from ..sources.sinks import group_ordered as order

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return order(o, F.col("o_orderstatus"), ["o_orderkey"], ("F", "O", "P"))




@query()
def task_families(spark, sf):
    """All five families of tasks with their quotas: seeded anchors, judged, first accepted."""
    from ..operators import families as FA

    o = objects(spark, sf).withColumns({"width": F.lit(1000), "height": F.lit(800)})
    return FA.all_families(o, T.targets_for(10_000)).select("candidate_id", "image_id", "object_id", "task_type", "direction_text")


@query(f"""
WITH {_OBJECTS}, n AS (SELECT image_id, object_id, count(*) OVER (PARTITION BY image_id, same_class_key) AS same_count FROM o) SELECT image_id, object_id, 'same_object_count_not_2_to_4' AS drop_reason, same_count FROM n WHERE same_count NOT BETWEEN 2 AND 4""")
def family_drops(spark, sf):
    from ..operators import families as FA

    return FA.drops(objects(spark, sf))
