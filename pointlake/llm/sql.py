"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL: dict[str, str] = {
    "op1_line_dedup": f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
k AS (SELECT *, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.least AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op2_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN least < page_id THEN least END AS refers_to
FROM p LEFT JOIN f USING (digest)""",
    "op8_mix": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
b AS (SELECT *, sum(w) OVER () AS all_w, sum(source_size) OVER () * 1.5::DOUBLE AS all_size,
        coalesce(sum(cap) OVER r, 0) AS full_cap, coalesce(sum(w) OVER r, 0) AS full_w
      FROM w WINDOW r AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap / w <= (all_size - full_cap) / (all_w - full_w) AS is_full FROM b),
r AS (SELECT *, all_size - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS rest, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS rest_w FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * (rest / nullif(rest_w, 0)) END AS target FROM r),
j AS (SELECT doc_id, size, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate,
        ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM j""",
    "op10_quality": f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x, {_STRIP})) > 0) AS lines FROM documents),
win AS (SELECT doc_id, p, array_to_string(words[p : p + 4], ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS p FROM d WHERE len(words) >= 5)),
twice AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cover AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM twice, range(5) AS t(o) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
      FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id),
x AS (SELECT *, coalesce(word_chars * 10 // nullif(n_words, 0), 0) AS v1, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS v2,
        coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS v3, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS v4 FROM m),
e AS (SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([v1, v2, v3, v4]) AS v FROM x),
h AS (SELECT lang, source, k, v - v % (10 ** greatest(length(v::VARCHAR) - 3, 0))::BIGINT AS bucket, count(*) AS n FROM e GROUP BY ALL),
hg AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, k ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, k) AS tot FROM h),
g AS (SELECT lang, source, k, max(tot) AS n, min(bucket) FILTER (upto * 4 >= tot) AS q1, min(bucket) FILTER (upto * 4 >= tot * 2) AS q2, min(bucket) FILTER (upto * 4 >= tot * 3) AS q3 FROM hg GROUP BY ALL),
ha AS (SELECT k, bucket, sum(n) AS n FROM h GROUP BY ALL),
hb AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY k) AS tot FROM ha),
a AS (SELECT k, min(bucket) FILTER (upto * 4 >= tot) AS a1, min(bucket) FILTER (upto * 4 >= tot * 2) AS a2, min(bucket) FILTER (upto * 4 >= tot * 3) AS a3 FROM hb GROUP BY k),
q AS (SELECT lang, source, k, (n * q1 + 200 * a1) // (n + 200) AS q1, (n * q2 + 200 * a2) // (n + 200) AS q2, (n * q3 + 200 * a3) // (n + 200) AS q3 FROM g JOIN a USING (k)),
f AS (SELECT lang, source,
        max(greatest(q3 + 4 * (q3 - q1), q2 + 60)) FILTER (k = 1) AS hi1, max(least(q1 - 4 * (q3 - q1), q2 - 15)) FILTER (k = 1) AS lo1,
        max(greatest(q3 + 4 * (q3 - q1), q2 + 100)) FILTER (k = 2) AS hi2, max(greatest(q3 + 4 * (q3 - q1), q2 + 300)) FILTER (k = 3) AS hi3,
        max(greatest(q3 + 4 * (q3 - q1), q2 + 150)) FILTER (k = 4) AS hi4 FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND v1 BETWEEN lo1 AND hi1 AND v2 <= hi2 AND v3 <= hi3 AND v4 <= hi4 AS kept
FROM x JOIN f ON x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source""",
}
