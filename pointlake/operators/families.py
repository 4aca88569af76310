"""The five families of pointing tasks: object x direction -> anchor -> judged -> first accepted -> quota.

Anchors are drawn by Python's seeded generator, one for each object and direction, in one vectorised
call; everything else is joins and expressions. Objects have image_id, object_id, image_order,
object_order, same_class_key, center_x, center_y, width, height. ``judge`` turns a table of paths
(ax, ay, tx, ty, first_axis) into a condition; without masks every path passes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import rng as RNG
from . import tasks as T

MOVE = ("right", "down-right", "down", "down-left", "left", "up-left", "up", "up-right")
KEEP = ("image_id", "object_id", "image_order", "object_order", "same_class_key")


def _always(row: DataFrame) -> Column:
    return F.lit(True)


def _directed(objs: DataFrame, directions: tuple[str, ...], seed: int, shuffle: str | None) -> DataFrame:
    """One row for each object and direction, in listed or seeded order, with its anchor."""
    text = lambda c: F.col(c).cast("string")
    names = F.array(*map(F.lit, directions))
    order = RNG.sample_order(F.lit(seed), F.concat_ws("/", F.lit(shuffle), text("image_id"), text("object_id")), F.lit(len(directions))) if shuffle else F.sequence(F.lit(0), F.lit(len(directions) - 1))
    rows = objs.withColumn("_order", order).select(*objs.columns, F.posexplode("_order").alias("position", "_k")).withColumn("direction", F.get(names, F.col("_k"))).drop("_k")
    at = RNG.anchor(F.lit(seed), text("image_id"), text("object_id"), F.col("direction"), F.col("center_x").cast("double"), F.col("center_y").cast("double"), G.direction_angle(F.col("direction")), F.col("width").cast("double"), F.col("height").cast("double"))
    return rows.withColumn("_a", at).withColumns({"ax": F.round("_a.x", 3), "ay": F.round("_a.y", 3), "angle": F.round("_a.angle", 3)}).drop("_a")


def _candidates(won: DataFrame, task: str, direction: Column, parts: list[Column]) -> DataFrame:
    ident = F.concat_ws("::", F.lit(task), F.col("image_id").cast("string"), F.col("object_id").cast("string"), *parts)
    cols = [c for c in (*KEEP, "ax", "ay") if c in won.columns]
    return won.select(*cols, ident.alias("candidate_id"), F.lit(task).alias("task_type"), F.lit(P.TASK_TYPES.index(task)).alias("task_rank"), direction.alias("direction_text"))


def moves(objs: DataFrame, seed: int, two_step: bool = False, judge: Callable[[DataFrame], Column] = _always) -> DataFrame:
    """From an anchor straight to the target, or in two steps along the axes of a diagonal."""
    task = "move_then_axis_limited_fixed" if two_step else "move_until_axis_fixed"
    rows = _directed(objs, P.DIAGONAL_DIRECTIONS if two_step else MOVE, seed, "move_then_order" if two_step else None).where("ax is not null")
    rows = rows.withColumns({"tx": F.col("center_x"), "ty": F.col("center_y"), "first_axis": F.element_at(F.split("direction", "-"), -1) if two_step else F.col("direction")})
    won = T.first_accepted(rows, ["image_id", "object_id"], "position", judge(rows))
    return _candidates(won, task, F.col("direction"), [F.col("direction")])


def from_other_objects(objs: DataFrame, seed: int) -> DataFrame:
    """From the centre of an object whose class is alone in the image; direction and anchor by hash."""
    found = T.other_class_anchors(objs).join(objs.select(*KEEP), ["image_id", "object_id"])
    key = F.struct(F.xxhash64(F.lit(seed), "object_id", "direction").alias("a"), F.xxhash64(F.lit(seed), "object_id", "anchor_id").alias("b"), F.col("anchor_id").alias("c"), F.col("direction").alias("d"))
    won = T.first_accepted(found.withColumn("position", key), ["image_id", "object_id"], "position", F.lit(True))
    return _candidates(won, "move_until_axis_from_other_object", F.col("direction"), [F.col("anchor_id").cast("string"), F.col("direction")])


def nearest(objs: DataFrame, seed: int) -> DataFrame:
    """The target is nearest of its class to an anchor, by a margin."""
    gated = T.instance_gate(objs).drop("same_count")
    placed = _directed(gated, MOVE, seed, "nearest_order").where("ax is not null")
    # One judgement for each direction: the direction goes into the key.
    keyed = placed.withColumn("image_key", F.concat_ws("/", F.col("image_id").cast("string"), "direction"))
    spread = gated.withColumn("image_key", F.explode(F.transform(F.array(*map(F.lit, MOVE)), lambda d: F.concat_ws("/", F.col("image_id").cast("string"), d))))
    judged = T.same_class_nearest(spread.drop("image_id").withColumnRenamed("image_key", "image_id"), keyed.select(F.col("image_key").alias("image_id"), "object_id", "ax", "ay"))
    both = keyed.join(judged.select(F.col("image_id").alias("image_key"), "object_id", "pass"), ["image_key", "object_id"])
    won = T.first_accepted(both, ["image_id", "object_id"], "position", F.col("pass"))
    return _candidates(won, "nearest_among_objects", F.lit("nearest"), [])


def nearest_in_sector(objs: DataFrame, seed: int) -> DataFrame:
    """The target lies in the direction and nothing of its class in the sector is closer."""
    gated = T.instance_gate(objs).drop("same_count")
    placed = _directed(gated, P.AXIS_DIRECTIONS, seed, "nearest_axis_order").where("ax is not null")
    judged = T.sector_nearest(gated, placed.select("image_id", "object_id", "ax", "ay", "direction")).select("image_id", "object_id", "direction", "pass")
    won = T.first_accepted(placed.join(judged, ["image_id", "object_id", "direction"]), ["image_id", "object_id"], "position", F.col("pass"))
    return _candidates(won, "nearest_among_objects_axis_constrained", F.col("direction"), [F.col("direction")])


def all_families(objs: DataFrame, targets: Mapping[str, int], seed: int = 42, judge: Callable[[DataFrame], Column] = _always) -> DataFrame:
    """Candidates of all families within their quotas, in image and object order."""
    out = moves(objs, seed, judge=judge)
    for more in (from_other_objects(objs, seed), moves(objs, seed, two_step=True, judge=judge), nearest(objs, seed), nearest_in_sector(objs, seed)):
        out = out.unionByName(more, allowMissingColumns=True)
    return T.task_quota(out, targets, ["image_order", "object_order", "candidate_id"])


def drops(objs: DataFrame, least: int = 2, below: int = 5) -> DataFrame:
    """Why objects cannot be of the nearest families. All are logged, also beyond full quotas."""
    n = objs.groupBy("image_id", "same_class_key").agg(F.count(F.lit(1)).alias("same_count"))
    out = objs.join(n, ["image_id", "same_class_key"]).where(~F.col("same_count").between(least, below - 1))
    return out.select("image_id", "object_id", F.lit("same_object_count_not_2_to_4").alias("drop_reason"), "same_count")
