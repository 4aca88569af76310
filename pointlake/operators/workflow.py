"""The four stages of curation over a table of model responses, and retries.

Responses are rows (sample_id, attempt, stage, turn, text, finish_reason). Models stay outside:
``operators.tasks.answers`` calls an injected responder to make such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import patterns as P
from ..functions import text as X


def chosen_turn(responses: DataFrame, keys: list[str], turn: str, valid: Column, value: Column, name: str = "value") -> DataFrame:
    """The value of the first valid turn, else of the last one; and whether it was valid. One
    aggregate with map-side combine."""
    rows = responses.select(*keys, F.col(turn).alias("_t"), F.coalesce(valid, F.lit(False)).alias("_ok"), value.alias("_v"))
    g = rows.groupBy(*keys).agg(F.min_by("_v", F.when(F.col("_ok"), F.col("_t"))).alias("_first"), F.max_by("_v", "_t").alias("_last"), F.bool_or("_ok").alias("valid"), F.count(F.lit(1)).alias("turns"))
    return g.select(*keys, F.when(F.col("valid"), F.col("_first")).otherwise(F.col("_last")).alias(name), "valid", "turns")


def repair_prompts(responses: DataFrame, keys: list[str], turn: str, stage: str, valid: Column, output: Column, build: Callable[[Column], Column], retries: int = 2, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """The next prompt of each session of a stage that no turn has settled and that may be tried again.

    Turns are numbered from 1. ``build`` makes the prompt from the last output (and from ``carry``, columns
    of the session's last row, by name): a template filled by ``functions.text.fill``, or any Column.
    Sessions after ``1 + retries`` turns are exhausted and give no row. One aggregate.
    """
    carry = dict(carry or {})
    rows = responses.select(*keys, F.col(turn).alias("_t"), F.coalesce(valid, F.lit(False)).alias("_ok"), F.struct(F.coalesce(output, F.lit("")).alias("_out"), *[c.alias(k) for k, c in carry.items()]).alias("_row"))
    g = rows.groupBy(*keys).agg(F.bool_or("_ok").alias("_ok"), F.max("_t").alias("_t"), F.max_by("_row", "_t").alias("_row"))
    again = g.where(~F.col("_ok") & (F.col("_t") <= retries)).select(*keys, "_t", "_row.*")
    name = F.concat(F.lit(f"{stage}_repair_"), F.col("_t").cast("string"))
    return again.select(*keys, (F.col("_t") + 1).alias(turn), name.alias("stage"), build(F.col("_out")).alias("prompt"))


def stage_columns(responses: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each sample: what each stage said in the end. A single pass over the responses."""
    parsers: dict[str, Callable[[Column], Column]] = {"cleaning": J.cleaning_output, "multipoint": J.multipoint_output, "classification": J.classifier_output, "rewrite": X.rewritten}
    rows = responses.withColumn("_whole", F.coalesce(F.col("finish_reason") != "length", F.lit(True)))
    for s, parse in parsers.items():
        here = F.when(F.col("stage") == s, parse(F.col("text")))
        ok = here.isNotNull() if s != "rewrite" else X.rewrite_is_valid(here)
        rows = rows.withColumns({f"_{s}": here, f"_{s}_t": F.when(ok & F.col("_whole"), F.col("turn"))})
    aggs = []
    for s in parsers:
        aggs += [F.min_by(f"_{s}", f"_{s}_t").alias(s), F.count_if(F.col("stage") == s).alias(f"{s}_turns"), (F.min(f"_{s}_t").isNotNull()).alias(f"{s}_ok")]
        if s == "rewrite":
            aggs.append(F.max_by("_rewrite", F.when(F.col("stage") == s, F.col("turn"))).alias("rewrite_last"))
    return rows.groupBy(*keys).agg(*aggs)


def statuses(samples: DataFrame, stages: DataFrame, keys: list[str], rule: Column | None = None, local: bool = False, counting_enabled: bool = True, query: Column | None = None) -> DataFrame:
    """Status, filter stage and category of each sample; later stages only count where earlier ones
    let the sample through.

    ``local``: several points filter a sample out unless counting is enabled, the category is
    refined by the query's cues, and a rewrite must keep them.
    """
    df = samples.join(stages, keys, "left")
    rule = F.lit(None).cast("string") if rule is None else rule
    query = F.lit("") if query is None else query
    ok = lambda s: F.coalesce(F.col(f"{s}_ok"), F.lit(False))
    asked = lambda s: F.coalesce(F.col(f"{s}_turns"), F.lit(0)) > 0
    several = F.coalesce(F.col("multipoint.multi_point"), F.lit(False))
    cat = X.refine_category(query, F.col("cleaning.core_target"), F.col("classification")) if local else F.col("classification")
    cat = F.when(several & F.lit(counting_enabled), "Counting").otherwise(cat)
    allowed = (*P.CATEGORIES_LOCAL, "Counting") if local else P.CATEGORIES
    failed = lambda s: F.when(asked(s), f"{s}_parse_failed").otherwise(f"{s}_request_failed")
    rewrite_ok = ok("rewrite") & (X.keeps_cues(cat, query, F.col("rewrite")) if local else F.lit(True))
    status = (
        F.when(rule.isNotNull(), "filtered_out")
        .when(~ok("cleaning"), failed("cleaning"))
        .when(~F.col("cleaning.keep"), "filtered_out")
        .when(~ok("multipoint"), failed("multipoint"))
        .when(several & F.lit(local and not counting_enabled), "filtered_out")
        .when(~several & ~ok("classification"), failed("classification"))
        .when(~F.coalesce(cat.isin(*allowed), F.lit(False)), "filtered_out")
        .when(~rewrite_ok, "rewrite_failed")
        .otherwise("completed")
    )
    stage = F.when(status == "filtered_out", F.when(rule.isNotNull() | ~F.coalesce(F.col("cleaning.keep"), F.lit(True)), "cleaning").when(several & F.lit(local and not counting_enabled), "multipoint").otherwise("classification"))
    return df.select(*samples.columns, status.alias("status"), stage.alias("filter_stage"), F.when(status.isin("completed", "rewrite_failed"), cat).alias("category"), F.when(status == "completed", F.col("rewrite")).alias("rewritten_query"), rule.alias("rule_filtered"))


def retry_pick(attempts: DataFrame, keys: list[str], attempt: str, reasons: Column) -> DataFrame:
    """Of each sample's attempts the first without reasons against it, else the last, as exhausted."""
    rows = attempts.withColumn("_row", F.struct(*attempts.columns)).withColumn("_good", F.size(reasons) == 0)
    g = rows.groupBy(*keys).agg(F.min_by("_row", F.when(F.col("_good"), F.col(attempt))).alias("_first"), F.max_by("_row", attempt).alias("_last"), F.bool_or("_good").alias("valid"))
    return g.select(F.when(F.col("valid"), F.col("_first")).otherwise(F.col("_last")).alias("r"), F.when(F.col("valid"), "valid").otherwise("invalid_sample_exhausted").alias("outcome")).select("r.*", "outcome")


def cache_first(requests: DataFrame, cache: DataFrame, uid: str, default: Column, order: str) -> DataFrame:
    """Responses from the cache where there are any; from_cache also for repeats of a uid."""
    keyed = requests.withColumn("cache_name", X.cache_name(F.col(uid).cast("string")))
    first = F.min(order).alias("_first")
    firsts = keyed.groupBy("cache_name").agg(first)
    both = keyed.join(firsts, "cache_name").join(cache.select("cache_name", F.col("response").alias("_cached")), "cache_name", "left")
    return both.withColumns({"response": F.coalesce("_cached", default), "from_cache": F.col("_cached").isNotNull() | (F.col(order) > F.col("_first"))}).drop("_cached", "_first")
