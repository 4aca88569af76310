"""Synthesis of pointing tasks: objects from point records, label groups, relations, candidates, questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import text as X
from .ranking import first_rows, rank
from .rules import object_reasons
from .selection import first_per_group


def first_keys(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The n keys that appear first; ``order`` places the rows. Only the key is read besides."""
    return df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(F.struct(*order)).alias("_at")).orderBy("_at").limit(n).select(key)


def objects(records: DataFrame, most_objects: int = 60) -> DataFrame:
    """Point records with ``pos`` -> objects with drop_reason (null: kept), ids and centres.

    An image with too many objects gives one row. The object aggregate holds one object's points.
    """
    x, y = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"point_{a}_norm"))) for a in "xy")
    rows = records.select("image_id", "image_path", "image_width", "image_height", "row_id", "label_raw", "label_clean", "pos", x.alias("x"), y.alias("y"))
    g = rows.groupBy("image_id", "row_id").agg(
        F.min("pos").alias("first_pos"), F.min_by("label_raw", "pos").alias("label_raw"), F.min_by("label_clean", "pos").alias("label_clean"), F.min_by("image_path", "pos").alias("image_path"),
        F.max("image_width").alias("width"), F.max("image_height").alias("height"), F.array_sort(F.collect_list(F.struct("pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")))).alias("points"),
        F.count(F.lit(1)).alias("point_count"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("spread"),
    )
    crowd = g.groupBy("image_id").agg(F.count(F.lit(1)).alias("num_objects"), F.min("first_pos").alias("image_pos"))
    both = g.join(crowd, "image_id")
    label = F.coalesce(F.nullif(F.col("label_raw"), F.lit("")), F.col("label_clean"))
    reason = F.when(F.col("num_objects") > most_objects, "too_many_raw_objects_in_image").otherwise(object_reasons(label, F.col("point_count"), F.col("spread")))
    judged = both.withColumn("drop_reason", reason)
    many = judged.where(F.col("num_objects") > most_objects).withColumn("row_id", F.lit("")).dropDuplicates(["image_id"])
    rest = judged.where(F.col("num_objects") <= most_objects)
    clean = F.coalesce(F.nullif("label_clean", F.lit("")), X.clean_label(F.col("label_raw")))
    rest = rest.withColumns({"label_clean": clean, "label_display": F.coalesce(X.first_filled(F.col("label_raw")), clean), "same_class_key": X.class_key(clean), "head_noun": X.head_noun(clean), "center_x": F.round(F.col("cx") * F.col("width"), 3), "center_y": F.round(F.col("cy") * F.col("height"), 3)})
    nth = F.row_number().over(Window.partitionBy("image_id", F.col("drop_reason").isNull()).orderBy("first_pos")) - 1
    rest = rest.withColumn("object_order", F.when(F.col("drop_reason").isNull(), nth))
    return rest.unionByName(many, allowMissingColumns=True)


def label_groups(objs: DataFrame) -> DataFrame:
    """Objects of an image with the same class key, as one group with an ordinal id."""
    g = objs.groupBy("image_id", "same_class_key").agg(
        F.array_sort(F.collect_list(F.struct("object_order", "object_id", "points"))).alias("_o"), F.min_by("label_display", "object_order").alias("label_display"), F.count(F.lit(1)).alias("object_count"),
    )
    nth = F.dense_rank().over(Window.partitionBy("image_id").orderBy("same_class_key")) - 1
    return g.select("image_id", "same_class_key", F.format_string("label_%03d", nth).alias("label_group_id"), "label_display", "object_count", F.transform("_o", lambda o: o["object_id"]).alias("object_ids"), F.flatten(F.transform("_o", lambda o: o["points"])).alias("points"))


def pairs_within(left: DataFrame, right: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Equi-join on the keys with a condition that the join itself evaluates."""
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    both = left.alias("l").join(right.alias("r"), on[0] if len(on) == 1 else on[0] & on[1])
    return both.where(condition)


def other_class_anchors(objs: DataFrame, directions: Mapping[str, float] = P.DIRECTIONS, tolerance: float = 10.0) -> DataFrame:
    """For each object: objects of classes that are alone in the image, from which it lies in a direction."""
    alone = objs.join(objs.groupBy("image_id", "same_class_key").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("image_id", "same_class_key"), ["image_id", "same_class_key"], "left_semi")
    a = alone.select("image_id", F.col("object_id").alias("anchor_id"), F.col("same_class_key").alias("anchor_key"), F.col("center_x").alias("ax"), F.col("center_y").alias("ay"))
    both = objs.join(a, "image_id").where(F.col("same_class_key") != F.col("anchor_key"))
    deg = G.bearing(F.col("ax"), F.col("ay"), F.col("center_x"), F.col("center_y"))
    near = [F.when(G.angle_delta(deg, F.lit(v)) <= tolerance, F.struct(F.lit(k).alias("direction"), F.round(G.angle_delta(deg, F.lit(v)), 3).alias("delta"))) for k, v in directions.items()]
    hit = both.withColumn("_d", F.explode(F.array_compact(F.array(*near))))
    return hit.select("image_id", "object_id", "anchor_id", F.col("_d.direction").alias("direction"), F.round(G.distance(F.col("ax"), F.col("ay"), F.col("center_x"), F.col("center_y")), 3).alias("distance_px"), F.col("_d.delta").alias("delta_deg"))


def same_class_nearest(objs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(image_id, object_id, ax, ay) anchors: the nearest and second nearest of the object's class,
    and whether the object is nearest by the margin max(12, 0.12 d). Alone: no second, it passes."""
    mine = anchors.join(objs.select("image_id", "object_id", "same_class_key"), ["image_id", "object_id"])
    other = objs.select("image_id", "same_class_key", F.col("object_id").alias("other_id"), F.col("object_order").alias("other_order"), F.col("center_x").alias("ox"), F.col("center_y").alias("oy"))
    d = mine.join(other, ["image_id", "same_class_key"]).withColumn("d", G.distance(F.col("ox"), F.col("oy"), F.col("ax"), F.col("ay")))
    two = first_per_group(d.select("image_id", "object_id", "other_id", "other_order", "d"), ["image_id", "object_id"], ["d", "other_order"], 2)
    g = two.groupBy("image_id", "object_id").agg(F.array_sort(F.collect_list(F.struct("d", "other_order", "other_id"))).alias("t"))
    d1, d2 = F.get("t", 0)["d"], F.get("t", 1)["d"]
    least = F.greatest(F.lit(12.0), d1 * 0.12)
    ok = (F.get("t", 0)["other_id"] == F.col("object_id")) & F.coalesce(d2 - d1 >= least, F.lit(True))
    return g.select("image_id", "object_id", F.get("t", 0)["other_id"].alias("closest_id"), F.round(d1, 3).alias("closest_dist"), F.round(d2, 3).alias("second_dist"), F.round(d2 - d1, 3).alias("margin_px"), F.round(least, 3).alias("min_margin_px"), ok.alias("pass"))


def sector_nearest(objs: DataFrame, anchors: DataFrame, tolerance: float = 10.0, sector: float = 45.0) -> DataFrame:
    """(image_id, object_id, ax, ay, direction): passes if the target lies within the tolerance and no
    other of its class in the sector is strictly closer. Competitors are aggregated, not listed per pair."""
    mine = anchors.join(objs.select("image_id", "object_id", "same_class_key", "center_x", "center_y"), ["image_id", "object_id"])
    base, ax, ay = G.direction_angle(F.col("direction")), F.col("ax"), F.col("ay")
    mine = mine.withColumns({"d": G.distance(F.col("center_x"), F.col("center_y"), ax, ay), "delta": G.angle_delta(G.bearing(ax, ay, F.col("center_x"), F.col("center_y")), base)})
    other = objs.select("image_id", "same_class_key", F.col("object_id").alias("other_id"), F.col("center_x").alias("ox"), F.col("center_y").alias("oy"))
    both = mine.join(other, ["image_id", "same_class_key"])
    od, odelta = G.distance(F.col("ox"), F.col("oy"), ax, ay), G.angle_delta(G.bearing(ax, ay, F.col("ox"), F.col("oy")), base)
    inside = (F.col("other_id") != F.col("object_id")) & (odelta <= sector)
    item = F.struct(F.round(od, 3).alias("distance_px"), F.col("other_id").alias("object_id"), F.round(odelta, 3).alias("delta_deg"))
    g = both.groupBy("image_id", "object_id", "ax", "ay", "direction").agg(
        F.first("d").alias("d"), F.first("delta").alias("delta"), F.array_sort(F.collect_list(F.when(inside, item))).alias("sector_objects"), F.array_sort(F.collect_list(F.when(inside & (od < F.col("d")), item))).alias("blocking"),
    )
    return g.select("image_id", "object_id", "direction", F.round("d", 3).alias("distance_px"), F.round("delta", 3).alias("delta_deg"), F.size("sector_objects").cast("long").alias("n_sector"), F.transform("blocking", lambda b: b["object_id"]).alias("blocking_ids"), ((F.col("delta") <= tolerance) & (F.size("blocking") == 0)).alias("pass"))


def instance_gate(objs: DataFrame, least: int = 2, below: int = 5) -> DataFrame:
    """Objects whose class has from ``least`` to below ``below`` instances in the image."""
    n = objs.groupBy("image_id", "same_class_key").agg(F.count(F.lit(1)).alias("same_count"))
    return objs.join(n, ["image_id", "same_class_key"]).where((F.col("same_count") >= least) & (F.col("same_count") < below))


def with_masks(objs: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects with their group's mask, dropped objects with a reason)."""
    both = objs.join(masks, ["image_id", "same_class_key"], "left")
    return both.where("mask is not null"), both.where("mask is null").select("image_id", "object_id", F.lit("missing_sam_mask").alias("drop_reason"))


def coverage_gate(raw: Column, dilated: Column, centre: Column) -> Column:
    """Why a mask does not fit its object, or null."""
    return F.when(~centre, "target_center_not_in_sam_mask").when((raw < 0.5) | (dilated < 1.0), "sam_mask_does_not_cover_object_points")


def path_gate(components: Column, other_pixels: Column) -> Column:
    return (components <= 1) & (other_pixels <= 2)


def path_hits(paths: DataFrame, masks: DataFrame) -> DataFrame:
    """(path_id, image_id, key, x, y) and (image_id, mask_key, x, y): pixels of each path on masks of
    other keys, outside the target's own mask. Equi-joins on pixels."""
    own = masks.select("image_id", F.col("mask_key").alias("key"), "x", "y")
    free = paths.join(own, ["image_id", "key", "x", "y"], "left_anti")
    hit = free.join(masks, ["image_id", "x", "y"]).where("mask_key != key")
    return hit.groupBy("path_id").agg(F.count_distinct("x", "y").alias("hit_pixels"), F.count_distinct("mask_key").alias("hit_groups"))


def first_accepted(judged: DataFrame, by: Sequence[str], position: str, accepted: Column) -> DataFrame:
    """Of each object and task the first alternative that passes."""
    return first_per_group(judged.where(accepted), by, [position])


def task_quota(candidates: DataFrame, targets: Mapping[str, int], order: Sequence[str]) -> DataFrame:
    """The first rows of each task type up to its target; task types without one give none. ``order``
    names columns."""
    wanted = {k: int(v) for k, v in targets.items() if int(v) > 0}
    if not wanted:
        return candidates.limit(0)
    named = candidates.where(F.col("task_type").isin(*wanted))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("task_type"))
    return first_rows(named, ["task_type"], order, max(wanted.values())).where(F.col("_nth") <= limit).drop("_nth")


def targets_for(total: int) -> dict[str, int]:
    """A mix of ``total`` tasks; rounding goes to the most plentiful."""
    out = {k: total * v // 10_000 for k, v in P.TASK_SHARES.items()}
    plenty = max(P.TASK_SHARES, key=P.TASK_SHARES.get)
    out[plenty] += total - sum(out.values())
    return out


def dedup_sorted(candidates: DataFrame, inserted: str) -> DataFrame:
    """The first row of each candidate id, in the final order."""
    return first_per_group(candidates, ["candidate_id"], [inserted]).orderBy("image_order", "object_order", "task_rank", "direction_text", "candidate_id")


def one_per_image(candidates: DataFrame, remaining: Mapping[str, int]) -> DataFrame:
    """One candidate for each image, scarce tasks first, within what remains of each task.

    Greedy and order-dependent over tasks, not over rows. One aggregate gives each image its best
    candidate for each task. Then each task in turn finds the last image it takes; an image is taken
    by the first task whose mark it does not pass, which is a comparison in its row.
    """
    tasks = [t for t in sorted(remaining, key=lambda t: (P.TASK_SHARES.get(t, 0), t)) if int(remaining[t]) > 0]
    if not tasks:
        return candidates.limit(0)
    row, order = F.struct(*[F.col(c).alias(c) for c in candidates.columns]), F.struct("image_order", "object_order", "task_rank", "candidate_id")
    best = [F.min_by(row, F.when(F.col("task_type") == t, order)).alias(f"_{k}") for k, t in enumerate(tasks)]
    images = candidates.where(F.col("task_type").isin(*tasks)).groupBy("image_id").agg(*best)
    kinds = {c: candidates.schema[c].dataType for c in ("image_order", "image_id")}
    taken, won = F.lit(False), F.lit(None).cast("int")
    for k, t in enumerate(tasks):
        place = F.struct(F.col(f"_{k}.image_order").alias("image_order"), F.col("image_id").alias("image_id"))
        free = F.col(f"_{k}").isNotNull() & ~taken
        last = images.where(free).select(place.alias("at")).orderBy("at").limit(int(remaining[t])).agg(F.max("at").alias("at")).first()["at"]
        if last is not None:
            mark = F.struct(*[F.lit(last[c]).cast(v).alias(c) for c, v in kinds.items()])
            mine = free & (place <= mark)
            won = F.when(mine, F.lit(k)).otherwise(won)
            taken = taken | mine
    chosen = F.coalesce(*[F.when(won == k, F.col(f"_{k}")) for k in range(len(tasks))])
    return images.select(chosen.alias("_row")).where("_row is not null").select("_row.*")


def renumber(df: DataFrame, key: str, order: str, start: int = 0) -> DataFrame:
    """Dense new numbers of the keys by first appearance (``order`` is a number), from ``start`` on."""
    firsts = df.groupBy(key).agg(F.min(order).alias("_first"))
    numbers = rank(firsts, [], ["_first", key], "new_order")
    return df.join(numbers.select(key, (F.col("new_order") + start).alias("new_order")), key)


def phrases(spark, openings: Sequence[str], bodies: Sequence[str], extra: Sequence[str] = (), n: int = 100) -> DataFrame:
    """Exactly n distinct phrases: the given ones first, then every opening with every body, in order."""
    rows = [(k, p.strip()) for k, p in enumerate([*extra, *(f"{o} {b}" for o in openings for b in bodies)])]
    made = spark.createDataFrame(rows, "pos long, text string").groupBy("text").agg(F.min("pos").alias("pos"))
    out = made.orderBy("pos").limit(n)
    if out.count() < n:
        raise ValueError(f"fewer than {n} phrases")
    return out


def questions(candidates: DataFrame, templates: DataFrame, group: Column, values: Mapping[str, Column], k: int, seed: int = 0) -> DataFrame:
    """k templates of its group for each candidate, by hash; filled in; those left with a placeholder
    and repeats are dropped. One row for each question, with style_index."""
    lib = templates.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("lib")).withColumnRenamed("group", "_g")
    both = candidates.withColumn("_g", group).join(lib, "_g")
    shuffled = F.array_sort(F.transform("lib", lambda t: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("candidate_id").cast("string"), t["pos"].cast("string")).cast("binary")).alias("k"), t["pos"].alias("p"), t["text"].alias("t"))))
    filled = F.transform(F.slice(shuffled, 1, k), lambda t: X.fill(t["t"], values))
    good = F.array_distinct(F.filter(filled, lambda q: ~q.rlike(r"\{[a-z_]+\}")))
    return both.withColumn("_q", good).select(*candidates.columns, F.posexplode("_q").alias("style_index", "question"))


def candidate_pool(objs: DataFrame, targets: Mapping[str, int], task: str = "nearest_among_objects_axis_constrained", radius: float = 60.0, directions: Sequence[str] = P.AXIS_DIRECTIONS) -> DataFrame:
    """Object x direction -> judged -> first accepted for each object -> quota: one task family,
    declaratively. Anchors lie at ``radius`` against the direction; a seeded search for anchors is
    in ``functions.rng``."""
    gated = instance_gate(objs)
    d = F.posexplode(F.array(*map(F.lit, directions)))
    rows = gated.select("image_id", "object_id", "image_order", "object_order", "center_x", "center_y", d.alias("position", "direction"))
    at = G.anchor_at(F.col("center_x"), F.col("center_y"), G.direction_angle(F.col("direction")), F.lit(radius))
    placed = rows.withColumns({"ax": F.round(at["x"], 3), "ay": F.round(at["y"], 3)})
    judged = placed.drop("center_x", "center_y").join(sector_nearest(gated, placed.select("image_id", "object_id", "ax", "ay", "direction")), ["image_id", "object_id", "direction"])
    won = first_accepted(judged, ["image_id", "object_id"], "position", F.col("pass"))
    won = won.withColumns({"task_type": F.lit(task), "task_rank": F.lit(P.TASK_TYPES.index(task)), "direction_text": F.col("direction"), "candidate_id": F.concat_ws("::", F.lit(task), "image_id", "object_id", "direction")})
    return task_quota(won, targets, ["image_order", "object_order"])


def answers(df: DataFrame, responder, schema: str) -> DataFrame:
    """Call a model, or whatever ``responder`` is: a function from one pandas frame to another."""

    def batches(it):
        for b in it:
            yield responder(b if isinstance(b, pd.DataFrame) else pd.DataFrame(b))

    return df.mapInPandas(batches, schema)
