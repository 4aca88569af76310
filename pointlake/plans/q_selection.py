"""Queries on selection, sets, versions and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import balance as B
from ..operators import selection as S
from ..operators import sets as ST
from ..operators import versions as V
from .registry import joined, query, table


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS source_rank FROM documents WHERE n_chars >= 200),
q AS (SELECT * FROM r WHERE source_rank <= CASE source WHEN 'src1' THEN 5 WHEN 'src2' THEN 0 WHEN 'src3' THEN 12 ELSE 1000000000 END)
SELECT doc_id, source, source_rank::INT AS source_rank FROM q ORDER BY source, source_rank LIMIT 300""")
def select_quota_cap(spark, sf):
    """First k selected rows of each source by quota, then a cap over all."""
    d = table(spark, sf, "documents").where("n_chars >= 200").select("doc_id", "source")
    return S.quota_cap(d, {"src1": 5, "src2": 0, "src3": 12}, 300, order=["doc_id"])


@query("""
SELECT source, count(*) AS scanned, count(*) FILTER (n_chars % 4 = 1) AS selected, count(*) FILTER (n_chars % 4 <> 1) AS skipped FROM documents GROUP BY source""")
def select_stats(spark, sf):
    reason = F.when(F.col("n_chars") % 4 != 1, "points_abs_len_ne_1")
    return S.selection_stats(table(spark, sf, "documents"), F.col("source"), reason)


@query("""
WITH h AS (SELECT *, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS hits, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS hit FROM orders)
SELECT o_orderkey, o_orderpriority FROM h WHERE hits - hit < 500""")
def early_stop_prefix(spark, sf):
    """Orders by key up to the 500th of first priority."""
    return S.prefix_until(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), F.startswith("o_orderpriority", F.lit("1")), ["o_orderkey"], 500)


@query("""
WITH p AS (SELECT doc_id, (n_chars % 3)::INT AS k FROM documents WHERE doc_id > 50),
h AS (SELECT *, sum((k > 1)::INT) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS hits FROM p), s AS (SELECT * FROM h WHERE hits - (k > 1)::INT < 40)
SELECT count(*) FILTER (k > 1) AS selected, count(*) AS scanned, count(*) FILTER (k <= 0) AS skipped_no_points, count(*) FILTER (k = 1) AS skipped_single_point, 50 + count(*) AS end_rank, count(*) FILTER (k > 1)::DOUBLE / greatest(count(*), 1) AS rate FROM s""")
def direct_counting_summary(spark, sf):
    return S.prefix_summary(table(spark, sf, "documents").select("doc_id", "n_chars"), (F.col("n_chars") % 3).cast("int"), 40, "doc_id", 50)


_RANKED = "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events"


@query(f"""
WITH e AS ({_RANKED}), f AS (SELECT event_type, max(r) AS m FROM e WHERE event_id % 7 = 0 AND event_id < 500 GROUP BY event_type)
SELECT e.event_id FROM e LEFT JOIN f USING (event_type) WHERE r > coalesce(m, 0)""")
def forward_resume_scan(spark, sf):
    e = S.with_rank(table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["event_id"])
    done = S.frontier(e.where("event_id % 7 = 0 and event_id < 500"), "event_type")
    return S.resume_after(e, done, "event_type").select("event_id")


@query(f"""
WITH e AS ({_RANKED}), f AS (SELECT event_type, min(r) AS m FROM e WHERE event_id % 7 = 0 AND event_id > 300 GROUP BY event_type)
SELECT e.event_id FROM e LEFT JOIN f USING (event_type) WHERE coalesce(m, 0) = 0 OR r < m""")
def reverse_resume_scan(spark, sf):
    e = S.with_rank(table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["event_id"])
    done = S.frontier(e.where("event_id % 7 = 0 and event_id > 300"), "event_type", reverse=True)
    return S.resume_before(e, done, "event_type").select("event_id")


@query("""
SELECT doc_id FROM documents WHERE text IS NULL OR trim(text) = '' OR text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL AND trim(text) <> '')""")
def exclusion_anti_join(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return S.exclude(d.select("doc_id", "text"), b, F.col("text"), "text").select("doc_id")


@query("""
WITH f AS (SELECT user_id, min(event_type) AS root FROM events GROUP BY user_id), c AS (SELECT root, count(*) AS n FROM f GROUP BY root)
SELECT t.event_type, coalesce(c.n, 0) AS new_keys FROM (SELECT DISTINCT event_type FROM events) t LEFT JOIN c ON t.event_type = c.root""")
def new_key_contribution(spark, sf):
    return S.contributed(table(spark, sf, "events"), "event_type", F.col("event_type"), "user_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def idempotent_rerun(spark, sf):
    return S.unfinished(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"], F.col("quality") == 1)


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[0-9]') THEN 7 ELSE p_size END AS rank FROM part")
def rank_or_file_prefix(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.rank_or_prefix(F.when(~F.col("p_name").rlike("^[0-9]"), F.col("p_size").cast("string")), F.concat(F.lit("0007__"), "p_name")).alias("rank"))


# --- versions ---

_VERSION = "CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END"


def _versions(spark, sf):
    rank = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts", rank.alias("decision_rank"))


@query(f"""
SELECT user_id, event_id, event_type, decision_rank FROM (SELECT user_id, event_id, event_type, {_VERSION} AS decision_rank, ts FROM events) WHERE decision_rank > 0
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY decision_rank DESC, ts DESC, event_id DESC) = 1""")
def latest_version(spark, sf):
    """Of each key the judged row of the highest rank, then the latest."""
    return V.latest(_versions(spark, sf), "user_id", F.col("decision_rank") > 0, [F.col("decision_rank"), F.col("ts"), F.col("event_id")]).drop("ts")


@query("""
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids, count(*) AS history_count FROM events GROUP BY user_id""")
def version_history(spark, sf):
    h = V.history(_versions(spark, sf), "user_id", ["ts", "event_id"], ["event_type"])
    return h.select("user_id", joined(F.transform("history", lambda x: x["event_id"].cast("string"))).alias("ids"), "history_count")


@query(f"""
WITH l AS (SELECT user_id, event_type, {_VERSION} AS r FROM events QUALIFY {_VERSION} > 0 AND row_number() OVER (PARTITION BY user_id ORDER BY {_VERSION} DESC, ts DESC, event_id DESC) = 1)
SELECT 'status' AS what, event_type AS key, count(*) AS n FROM l GROUP BY event_type UNION ALL SELECT 'category', CASE WHEN event_type = 'purchase' THEN 'Counting' END, count(*) FROM l WHERE event_type = 'completed' GROUP BY 2
UNION ALL SELECT 'root', 'r' || user_id % 3, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'trainable', (r = 2)::VARCHAR, count(*) FROM l GROUP BY 2""")
def summary_counters(spark, sf):
    l = V.latest(_versions(spark, sf), "user_id", F.col("decision_rank") > 0, [F.col("decision_rank"), F.col("ts"), F.col("event_id")])
    return V.summary_counts(l.select(F.col("event_type").alias("status"), F.lit("Counting").alias("category"), F.concat(F.lit("r"), F.col("user_id") % 3).alias("root_name"), (F.col("decision_rank") == 2).alias("trainable")))


# --- sets ---


@query("""
SELECT 'event' AS kind, event_id AS id, value, NULL::VARCHAR AS status FROM events UNION ALL SELECT 'order', o_orderkey, NULL, o_orderstatus FROM orders""")
def union_by_name(spark, sf):
    e = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "value")
    return ST.rows_of_all(e, table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))


@query("""
SELECT count(*) AS n_whole, count(*) FILTER (o_totalprice > 1000) + count(*) FILTER (NOT coalesce(o_totalprice > 1000, false)) AS n_parts,
  count(*) = count(*) FILTER (o_totalprice > 1000) + count(*) FILTER (NOT coalesce(o_totalprice > 1000, false)) AS complete FROM orders""")
def complement_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ST.split_complete(o, ST.split(o, F.col("o_totalprice") > 1000))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def id_uniqueness(spark, sf):
    return ST.repeated_ids(table(spark, sf, "lineitem"), "l_orderkey")


@query("""
SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))), '\\.+$', ''), ' ' || chr(9) || chr(10) || chr(13)) ORDER BY doc_id) = 1""")
def normalized_dedup(spark, sf):
    return ST.dedup_queries(table(spark, sf, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query("SELECT user_id AS key FROM events WHERE value > 50 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def key_set_union(spark, sf):
    e, c = table(spark, sf, "events"), table(spark, sf, "customer")
    return ST.key_union(e.where("value > 50").select(F.col("user_id").alias("key")), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key")


# --- balance ---


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS pool_index, count(*) OVER (PARTITION BY p_brand) AS pool_size FROM part")
def category_pools(spark, sf):
    return B.pools(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", ["p_retailprice", "p_partkey"]).drop("p_retailprice")


@query("""
WITH w(t, weight) AS (SELECT DISTINCT p_type, CASE WHEN row_number() OVER (ORDER BY p_type) = 1 THEN 3 ELSE 2 END FROM (SELECT DISTINCT p_type FROM part)),
c AS (SELECT p_type AS t, count(*) AS available FROM part GROUP BY p_type), m AS (SELECT min(available // weight) AS k FROM w JOIN c USING (t))
SELECT t AS p_type, weight::BIGINT AS weight, available, (weight * k)::BIGINT AS quota FROM w JOIN c USING (t), m""")
def balance_quotas(spark, sf):
    p = table(spark, sf, "part")
    # The ratios of a run: one for each type there is, of which there are few.
    types = sorted(r[0] for r in p.select("p_type").distinct().collect())
    return B.quotas(p, "p_type", B.integer_weights({t: 1.5 if k == 0 else 1.0 for k, t in enumerate(types)}))


@query("""
WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, p_brand, CASE WHEN 30 >= n THEN true ELSE ((i - 25) % n + n) % n < 30 END AS active FROM p""")
def rotate_slice(spark, sf):
    p = B.pools(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"])
    return B.rotate(p, F.col("pool_index"), F.col("pool_size"), F.lit(30), F.lit(25)).select("p_partkey", "p_brand", "active")


@query("""
WITH p AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
a AS (SELECT p_brand, CASE WHEN 30 >= n THEN true ELSE ((i - 25) % n + n) % n < 30 END AS active FROM p)
SELECT p_brand, count(*) AS eligible, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS discarded FROM a GROUP BY p_brand""")
def balance_report(spark, sf):
    return B.report(rotate_slice(spark, sf), "p_brand")


@query("SELECT p_brand, count(*) AS n, CASE WHEN count(*) > 30 THEN (25 + 30) % count(*) ELSE 25 END AS next_offset FROM part GROUP BY p_brand")
def rotation_step(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return g.select("p_brand", "n", B.next_offset(F.lit(25), F.col("n"), F.lit(30)).cast("long").alias("next_offset"))


@query("SELECT source, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio FROM documents GROUP BY source")
def source_ratio(spark, sf):
    return B.source_ratio(table(spark, sf, "documents"), "source")


@query("""
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, n, round(n * pow(1.0::DOUBLE / n, 0.5) / sum(n * pow(1.0::DOUBLE / n, 0.5)) OVER (), 9) AS ratio FROM c""")
def expected_ratio(spark, sf):
    return B.expected_ratio(table(spark, sf, "documents"), "lang", 0.5).withColumn("ratio", F.round("ratio", 9))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id)) <= 25")
def hash_stratified_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return B.stratified(d, ["lang"], 25, F.md5(F.concat(F.lit("7:"), "doc_id").cast("binary")))


@query("""
WITH k AS (SELECT doc_id, lang, source, md5('7:' || doc_id) AS k FROM documents), a AS (SELECT doc_id FROM k QUALIFY row_number() OVER (PARTITION BY lang ORDER BY k) <= 6), b AS (SELECT doc_id FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY k) <= 3)
SELECT doc_id FROM a UNION SELECT doc_id FROM b""")
def sample_manifest(spark, sf):
    return B.manifest(table(spark, sf, "documents"), "doc_id", "lang", "source", 6, 3, F.md5(F.concat(F.lit("7:"), "doc_id").cast("binary")))


@query("SELECT doc_id, source, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents")
def seeded_shuffle(spark, sf):
    return B.shuffle_places(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 42)


@query("""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT *, n * pow(1.0::DOUBLE / n, 0.5) / sum(n * pow(1.0::DOUBLE / n, 0.5)) OVER () AS r FROM c),
h AS (SELECT *, sum(r) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS hi, row_number() OVER (ORDER BY source DESC) = 1 AS last FROM e),
d AS (SELECT range AS draw, ('0x' || substr(md5('3:1:' || range), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u, ('0x' || substr(md5('3:2:' || range), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS v FROM range(1000)),
s AS (SELECT draw, v, arg_min(source, hi) AS source, arg_min(n, hi) AS n FROM d JOIN h ON u < hi OR last GROUP BY draw, v),
k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
SELECT draw, doc_id, k.source FROM s JOIN k ON k.source = s.source AND k.i = floor(v * n)::BIGINT""")
def weighted_replacement_sample(spark, sf):
    return B.weighted_draws(table(spark, sf, "documents"), "doc_id", "source", 0.5, 1000, 3)


@query("""
WITH d AS (SELECT doc_id, CASE n_chars % 7 WHEN 0 THEN 'sam_clean_' || lang WHEN 1 THEN lang || '_three_types' WHEN 2 THEN 'run_3types_' || source WHEN 3 THEN 'mix4_' || source WHEN 4 THEN lang || '_pointsabs' WHEN 5 THEN NULL ELSE source || '_mix4' END AS root FROM documents)
SELECT doc_id, root, CASE WHEN starts_with(root, 'sam_clean') THEN 'sam_clean' WHEN contains(root, 'three_types') OR contains(root, '3types') THEN 'clean_3types_local' WHEN starts_with(root, 'mix4') OR contains(root, 'pointsabs') THEN 'benchmark_extract' ELSE 'unknown' END AS method FROM d""")
def cleaning_methods(spark, sf):
    k = F.col("n_chars") % 7
    root = F.when(k == 0, F.concat(F.lit("sam_clean_"), "lang")).when(k == 1, F.concat("lang", F.lit("_three_types"))).when(k == 2, F.concat(F.lit("run_3types_"), "source")).when(k == 3, F.concat(F.lit("mix4_"), "source")).when(k == 4, F.concat("lang", F.lit("_pointsabs"))).when(k == 6, F.concat("source", F.lit("_mix4")))
    d = table(spark, sf, "documents").withColumn("root", root)
    return d.select("doc_id", "root", X.cleaning_method(F.col("root")).alias("method"))
