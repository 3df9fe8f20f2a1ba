"""The registered queries of the text operators, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, language, neardup, packing, pii, quality, recompression, suffixes, warc
from .tables import read


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85, bins=128)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_windows(read(spark, sf_dir, "documents"))


def op6_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(read(spark, sf_dir, "documents"))


def op7_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


def op8_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op9_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score_documents(read(spark, sf_dir, "documents"))


def op10_text_to_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_one_permutation": op3_one_permutation,
    "op4_host_rules": op4_host_rules,
    "op5_recompression": op5_recompression,
    "op6_anchor_pii": op6_anchor_pii,
    "op7_deep_shallow": op7_deep_shallow,
    "op8_tier_packing": op8_tier_packing,
    "op9_gated_recurrent": op9_gated_recurrent,
    "op10_text_to_tag": op10_text_to_tag,
}

WORD = r"[^\x20\x09-\x0D]+"

TOKEN = r"[0-9a-z\x{80}-\x{10FFFF}]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_spaced_seeds": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{TOKEN}') AS w FROM documents
), i AS (
  SELECT row_number() OVER () AS k, item_id, regexp_extract_all({LOWER}, '{TOKEN}') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)
), dw AS (
  SELECT r, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d
), iw AS (
  SELECT k, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM i
), hit AS (
  SELECT r, k, p - q AS diagonal, p, q, size, n FROM dw JOIN iw USING (word)
), much AS (
  SELECT r, k, diagonal FROM hit GROUP BY r, k, diagonal, n HAVING 100 * count(*) >= 80 * least(13, n)
), h AS (
  SELECT hit.* FROM hit JOIN much USING (r, k, diagonal)
), whole AS (
  SELECT r, k, diagonal, diagonal AS start_token, n AS n_aligned, count(*) AS n_agree FROM h
  WHERE n < 13 AND diagonal >= 0 AND diagonal + n <= size GROUP BY r, k, diagonal, n HAVING min(q) = 0 AND max(q) = n - 1 AND 100 * count(*) >= 80 * n
), cut AS (
  SELECT *, p - lag(p) OVER (PARTITION BY r, k, diagonal ORDER BY p) > 5 AS new FROM h WHERE n >= 13
), chain AS (
  SELECT *, sum(coalesce(new, false)::INT) OVER (PARTITION BY r, k, diagonal ORDER BY p) AS c, row_number() OVER (PARTITION BY r, k, diagonal ORDER BY p) AS x FROM cut
), stretch AS (
  SELECT a.r, a.k, a.diagonal, a.p AS start_token, b.p - a.p + 1 AS n_aligned, b.x - a.x + 1 AS n_agree
  FROM chain a JOIN chain b ON a.r = b.r AND a.k = b.k AND a.diagonal = b.diagonal AND a.c = b.c AND b.p >= a.p + 12
  WHERE 100 * (b.x - a.x + 1) >= 80 * (b.p - a.p + 1)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r, k ORDER BY n_agree DESC, start_token, diagonal) AS place FROM (SELECT * FROM whole UNION ALL SELECT * FROM stretch)
)
SELECT doc_id, item_id, CAST(start_token AS BIGINT) AS start_token, CAST(n_aligned AS BIGINT) AS n_aligned, CAST(n_agree AS BIGINT) AS n_agree
FROM best JOIN d USING (r) JOIN i USING (k) WHERE place = 1
""",
    "op3_one_permutation": f"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, {LOWER} AS text FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '{WORD}') AS words FROM t
), s AS (
  SELECT DISTINCT r, CASE WHEN len(words) < 3 THEN words ELSE words[i : i + 2] END AS shingle
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), own AS (
  SELECT r, md5(list(shingle ORDER BY shingle)::VARCHAR) AS class, count(*) AS n FROM s GROUP BY r
), one AS (
  SELECT class, min(r) AS r FROM own GROUP BY class
), both_ AS (
  SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN one ON a.r = one.r JOIN s b ON a.shingle = b.shingle AND a.r < b.r JOIN one o ON b.r = o.r GROUP BY a.r, b.r
), link AS (
  SELECT a, b FROM both_ JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT r AS a, r AS b FROM one UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), lowest AS (
  SELECT own.class, min(t.doc_id) AS doc_id FROM own JOIN t USING (r) GROUP BY own.class
), component AS (
  SELECT x.class, min(l.doc_id) AS component_id FROM one x JOIN reach ON reach.a = x.r JOIN one y ON reach.b = y.r JOIN lowest l ON l.class = y.class GROUP BY x.class
)
SELECT t.doc_id, CAST(coalesce(own.n, 0) AS BIGINT) AS n_shingles, CASE WHEN own.n IS NULL THEN t.doc_id ELSE component_id END AS component_id,
       t.doc_id IS NOT DISTINCT FROM CASE WHEN own.n IS NULL THEN t.doc_id ELSE component_id END AS kept
FROM t LEFT JOIN own USING (r) LEFT JOIN component USING (class)
""",
    "op7_deep_shallow": """
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), s AS (
  SELECT r, unnest(range(0, greatest(length(x) // 2 - 199, 0))) AS i, x FROM t
), h AS (
  SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM s
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1
), edge AS (
  SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 200 AS first FROM again
), part AS (
  SELECT r, i, sum(first::INT) OVER (PARTITION BY r ORDER BY i) AS part FROM edge
), gone AS (
  SELECT r, part, min(i) AS low, max(i) + 200 AS high FROM part GROUP BY r, part
), hole AS (
  SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM gone
), kept AS (
  SELECT r, count(*) AS n_spans, sum(high - low) AS n_removed, max(high) AS high, string_agg(substr(x, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS x FROM hole JOIN t USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(t.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.x, '') || substr(t.x, 2 * coalesce(kept.high, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
""",
    "op5_recompression": f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS word, generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) AS i FROM t
), g AS (
  SELECT r, doc_id, i, hash(list(word) OVER o) AS h, list(word) OVER o AS gram, count(*) OVER o AS n
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), later AS (
  SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY h, gram) AS least FROM g WHERE n = 13) WHERE doc_id > least
), gone AS (
  SELECT DISTINCT r, i + k AS i FROM later, range(13) AS x(k)
), s AS (
  SELECT w.r, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(w.word, ' ' ORDER BY w.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM w LEFT JOIN gone ON w.r = gone.r AND w.i = gone.i GROUP BY w.r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN s USING (r)
""",
    # What the operator finds on pages that mark their article and all boilerplate, as those of the test tables do.
    "op10_text_to_tag": r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article\b[^>]*>(.*)</article>', 1) AS x FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(x, '(?s)<!--.*?-->', '', 'g'),
         '(?s)<script\b.*?</script>|<style\b.*?</style>|<form\b.*?</form>|<nav\b.*?</nav>|<aside\b.*?</aside>|<footer\b.*?</footer>|<div\b[^>]*class="?ad"?[^>]*>.*?</div>', ' ', 'g') AS x FROM a
), c AS (
  SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|div|h[1-6]|ul|ol|li|section|blockquote|table|tr|td|br)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM b
), d AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS x FROM c
), e AS (
  SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM d
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM e
""",
    "op1_warc_revisits": """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, url, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last_id FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to,
       regexp_replace(url, '[\\x00-\\x20\\x7f]', '%20', 'g') AS url,
       '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '>' AS record_id
FROM (SELECT *, sha1(coalesce(CAST(page_id AS VARCHAR), '') || '/' || payload_digest) AS h FROM f)
""",
    "op4_host_rules": f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, unnest(regexp_extract_all(text, '{WORD}')) AS word, generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) AS i FROM t
), n AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r
), g AS (
  SELECT r, i, CASE WHEN lead(i, 4) OVER o IS NOT NULL
         THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS gram
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g WHERE gram IS NOT NULL) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range(5) AS x(k) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{WORD}') GROUP BY r
), m AS (
  SELECT t.doc_id, t.source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN n USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), v AS (
  SELECT *, base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines AS rule_failed FROM b
), h AS (
  SELECT source, count(*) AS n, sum(rule_failed::INT) AS failed FROM v GROUP BY source
), s AS (
  SELECT sum(failed) / sum(n) AS mean, greatest(sum(failed * failed / n) / sum(n) - (sum(failed) / sum(n)) ** 2, 0) AS spread FROM h
), p AS (
  SELECT mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE 1000 END, 2), 1000) AS strength FROM s
), hv AS (
  SELECT source, (failed + mean * strength) / (n + strength) > 0.5 AS host_failed FROM h, p
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, host_failed, NOT rule_failed AND NOT host_failed AS kept
FROM v JOIN hv ON v.source IS NOT DISTINCT FROM hv.source
""",
}
