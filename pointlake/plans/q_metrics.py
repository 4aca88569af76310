"""Queries on counts, reports and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import text as X
from ..operators import metrics as M
from ..sources.sinks import fail_cases as lines_of_fails
from .registry import joined, query, table

_JUDGED = "SELECT d.doc_id, d.lang, l.quality AS truth, CASE WHEN d.n_chars > 20000 THEN NULL WHEN d.n_chars > 800 THEN 1 ELSE 0 END AS said FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def judged(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 20000, None).when(F.col("n_chars") > 800, 1).otherwise(0).alias("said"))
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("truth")), "doc_id")


@query("SELECT event_type AS source, (user_id % 3)::INT AS status, count(*) AS n, grouping(event_type, user_id % 3) AS level FROM events GROUP BY GROUPING SETS ((event_type, user_id % 3), (user_id % 3), ())")
def status_grouping_sets(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), (F.col("user_id") % 3).cast("int").alias("status"))
    return M.status_counts(e, "source", "status")


@query(f"SELECT truth, count(*) FILTER (said = 0) AS said_0, count(*) FILTER (said = 1) AS said_1, count(*) FILTER (said IS NULL) AS said_none FROM ({_JUDGED}) GROUP BY truth")
def confusion_pivot(spark, sf):
    return M.confusion(judged(spark, sf), "truth", "said", [0, 1])


_PRF = f"""
j AS ({_JUDGED}), c AS (SELECT k::VARCHAR AS label, (SELECT count(*) FROM j WHERE truth = k) AS t, (SELECT count(*) FROM j WHERE said = k) AS s, (SELECT count(*) FROM j WHERE truth = k AND said = k) AS h FROM (VALUES (0), (1)) v(k)),
p AS (SELECT label, coalesce(h / nullif(s, 0), 0)::DOUBLE AS precision, coalesce(h / nullif(t, 0), 0)::DOUBLE AS recall, t AS support FROM c),
r AS (SELECT label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM p)"""


@query(f"WITH {_PRF} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r")
def prf_report(spark, sf):
    r = M.precision_recall(judged(spark, sf), "truth", "said")
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_PRF} SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1, sum(support)::BIGINT AS support FROM r")
def prf_macro(spark, sf):
    m = M.macro(M.precision_recall(judged(spark, sf), "truth", "said"))
    return m.select(*[F.round(f"macro_{c}", 9).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], "support")


@query(f"SELECT lang AS label, count(*) AS n, count(*) FILTER (truth = 1) AS ok, grouping(lang) AS level, count(*) FILTER (truth = 1) / count(*) AS recall FROM ({_JUDGED}) GROUP BY ROLLUP (lang)")
def recall_rollup(spark, sf):
    return M.rate_rollup(judged(spark, sf), "lang", F.col("truth") == 1, "recall")


@query(f"SELECT lang AS category, count(*) AS n, count(*) FILTER (truth = said) AS ok, count(*) FILTER (said IS NULL) AS invalid, grouping(lang) AS level, round(100.0 * count(*) FILTER (truth = said) / count(*), 2) AS accuracy FROM ({_JUDGED}) GROUP BY ROLLUP (lang)")
def accuracy_rollup(spark, sf):
    j = judged(spark, sf)
    return M.accuracy(j, "lang", F.coalesce(F.col("truth") == F.col("said"), F.lit(False)), F.col("said").isNotNull())


@query("SELECT event_type AS k, count(*) AS n FROM events GROUP BY event_type")
def counter_merge(spark, sf):
    """Counts of two halves, merged."""
    e = table(spark, sf, "events")
    half = lambda r: e.where(F.col("event_id") % 2 == r).groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return M.merge_counts(half(0), half(1), "k")


@query("""
WITH g AS (SELECT d.source, count(*) AS t, count(*) FILTER (l.doc_id IS NOT NULL) AS w, count(*) FILTER (l.doc_id IS NULL) AS m, count(DISTINCT d.n_chars) AS di, avg(d.n_chars % 7) AS p FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source),
s AS (SELECT DISTINCT source FROM documents UNION SELECT 'none')
SELECT s.source, coalesce(t, 0) AS rows_total, coalesce(w, 0) AS rows_with_image, coalesce(m, 0) AS rows_missing_image, coalesce(di, 0) AS distinct_images, coalesce(p, 0) AS avg_points, coalesce(w, 0) = coalesce(t, 0) AS all_have_images FROM s LEFT JOIN g ON s.source = g.source""")
def dataset_audit(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("hit")), "doc_id", "left")
    sources = d.select("source").distinct().union(spark.range(1).select(F.lit("none")))
    return M.audit(d, "source", sources, F.coalesce("hit", F.lit(False)), F.col("n_chars"), F.col("n_chars") % 7)


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / greatest(sum(l_discount), 1), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark, sf):
    m = M.weighted_mean(table(spark, sf, "lineitem"), F.col("l_extendedprice"), F.col("l_discount"), ["l_returnflag"])
    return m.select("l_returnflag", F.round("mean", 6).alias("mean"))


@query("""
WITH a AS (SELECT o_orderkey AS id, o_totalprice AS overall, (o_custkey % 10)::DOUBLE AS reasoning, (o_custkey % 7)::DOUBLE AS steerability, o_orderkey AS step FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0
 UNION ALL SELECT o_orderkey, o_totalprice / 2, 0, 0, o_orderkey FROM orders WHERE o_orderkey % 10 = 0)
SELECT id, overall FROM a ORDER BY overall DESC, reasoning DESC, steerability DESC, step, id LIMIT 15""")
def leaderboard_topm(spark, sf):
    o = table(spark, sf, "orders")
    row = lambda price, r, s: (F.col("o_orderkey").alias("id"), price.alias("overall"), r.cast("double").alias("reasoning"), s.cast("double").alias("steerability"), F.col("o_orderkey").alias("step"))
    old = o.where("o_orderkey % 2 = 0").select(*row(F.col("o_totalprice"), F.col("o_custkey") % 10, F.col("o_custkey") % 7))
    new = o.where("o_orderkey % 10 = 0").select(*row(F.col("o_totalprice") / 2, F.lit(0), F.lit(0)))
    return M.leaderboard(old, new, "id", 15).select("id", "overall")


@query("""
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS rolling_mean, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM events""")
def rolling_mean_100(spark, sf):
    r = M.rolling_mean(table(spark, sf, "events").select("event_id", "user_id", "value"), "value", ["user_id"], ["event_id"])
    return r.select("event_id", F.round("rolling_mean", 9).alias("rolling_mean"), F.round("running_mean", 9).alias("running_mean"))


@query("SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio FROM events WHERE event_id <= 500 GROUP BY event_type")
def first_window_counts(spark, sf):
    from ..operators.balance import source_ratio

    return source_ratio(table(spark, sf, "events").where("event_id <= 500"), "event_type")


@query(f"SELECT concat_ws(chr(9), doc_id, coalesce(truth::VARCHAR, ''), coalesce(said::VARCHAR, ''), lang) AS value FROM ({_JUDGED}) WHERE truth IS DISTINCT FROM said OR lang = 'de'")
def fail_cases(spark, sf):
    j = judged(spark, sf).withColumn("status", F.when(F.col("lang") == "de", "error").otherwise("ok"))
    return lines_of_fails(j, "truth", "said", "status", ["doc_id", "truth", "said", "lang"])


@query("SELECT vec_id, CASE WHEN label = 3 THEN vec_id % 3 = 1 AND vec_id % 2 = 0 ELSE vec_id % 2 = 0 END AS ok FROM embeddings")
def scoring_rule(spark, sf):
    e = table(spark, sf, "embeddings")
    hit = F.col("vec_id") % 2 == 0
    n = (F.col("vec_id") % 3).cast("int")
    ok = M.score(F.array_repeat(F.lit(1), F.lit(1)), n, F.when(F.col("label") == 3, "counting").otherwise("other"), F.array(hit))
    return e.select("vec_id", ok.alias("ok"))


@query("SELECT doc_id, greatest(coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 5 - 2 END, 3), 0)::INT AS n FROM documents")
def expected_counts(spark, sf):
    c = F.when(F.col("doc_id") % 4 == 0, "x").otherwise((F.col("doc_id") % 5 - 2).cast("string"))
    return table(spark, sf, "documents").select("doc_id", J.expected_count(c, F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))


@query("""
WITH b AS (SELECT doc_id, source, range(doc_id % 4) AS v FROM documents), m AS (SELECT source, max(len(v)) AS k FROM b GROUP BY source)
SELECT doc_id, array_to_string(list_concat(v, [-1 for i in range(k - len(v))]), ',') AS padded FROM b JOIN m USING (source)""")
def padded_batches(spark, sf):
    """Ragged lists filled up to the longest of their batch (a source)."""
    v = F.when(F.col("doc_id") % 4 > 0, F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 4 - 1)).otherwise(F.array().cast("array<bigint>"))
    b = table(spark, sf, "documents").select("doc_id", "source", v.alias("v"))
    longest = b.groupBy("source").agg(F.max(F.size("v")).alias("k"))
    return b.join(longest, "source").select("doc_id", joined(J.padded(F.col("v"), F.col("k"), F.lit(-1).cast("long")).cast("array<string>")).alias("padded"))


@query("SELECT n_name, upper(left(n_name, 1)) || '.' AS short, printf('%.2f%%', 100.0 * n_regionkey / 7) AS share FROM nation")
def percent_format(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_name", F.concat(F.upper(F.substring("n_name", 1, 1)), F.lit(".")).alias("short"), X.percent(100.0 * F.col("n_regionkey") / 7).alias("share"))
