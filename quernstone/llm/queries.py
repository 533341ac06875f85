"""The opN queries: thin, whole-table applications of the operators with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_scoring, media_flac, mixing, ngram_join, packing, phrase_dedup, quality, secrets, token_counts, warc_zip


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_docs(spark, sf_dir, "doc_id", "text"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir, "doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_flac.read_back(media_flac.stored(_docs(spark, sf_dir, "doc_id", "text")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = secrets.scan(_docs(spark, sf_dir, "doc_id", "text"))
    counts = [secrets.counted(F.col("base_spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.sha2(secrets.joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256")
    return x.select("doc_id", *counts, base, secrets.joined(F.col("all_spans")).alias("spans"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_docs(spark, sf_dir, "doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir, "text"), extra=1)


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_dedup.remove_repeats(_docs(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.with_verdict(_docs(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc_zip.round_trip(pages)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_packing, op3_mixing, op4_media, op5_secrets, op6_ngram_join, op7_token_counts, op8_phrase_dedup, op9_quality_rules, op10_warc)
}

_WS = r"[\x20\x09-\x0D]+"

OP3_SQL = """
WITH size AS (SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS size FROM documents GROUP BY source),
total AS (SELECT sum(size) AS all_size, sum(CASE WHEN size > 0 THEN pow(size::DOUBLE, 0.5) END) AS all_weight FROM size),
rate AS (
  SELECT source, CASE WHEN size > 0 THEN pow(size::DOUBLE, 0.5) / all_weight * all_size / size ELSE 1.0 END AS rate FROM size, total),
mean AS (SELECT source, greatest(1, ceil(rate / 200)::INT) AS parts, rate / greatest(1, ceil(rate / 200)::INT) AS mean FROM rate),
cdf AS (
  SELECT source, k, parts, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM mean, unnest(generate_series(0, ceil(mean + 12 * sqrt(mean) + 30)::INT)) AS g(k)),
tables AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, list_sum(list_transform(generate_series(1, t.parts), lambda j: len(list_filter(t.cdf, lambda c:
    c < (('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null:' || md5(coalesce(d.text, ''))) || ':' || j::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE))))::INT AS n
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, text, lang, source, n_chars, c::INT AS mix_copy,
  ('0x' || substr(md5('17:order:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':' || c::VARCHAR), 1, 15))::BIGINT AS mix_key
FROM drawn, unnest(generate_series(1, n)) AS g(c)
"""

_ANY = "[A-Za-z0-9+/_=-]"
_NOT_ALLOWED = " OR ".join([f"regexp_matches(hit, '{secrets.UUID}')", *(f"contains(lower(hit), '{p}')" for p in secrets.PLACEHOLDERS)])


def _places(name: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    ex = lambda g: f"regexp_extract_all(text, '(?s)(.*?)({quoted})', {g})"
    return f"""{name} AS (
  SELECT r, i, list_sum([length(g) for g in gaps[1:i]])::BIGINT + coalesce(list_sum([length(h) for h in hits[1:i - 1]]), 0)::BIGINT AS start, hits[i] AS hit, vals[i] AS val
  FROM (SELECT r, {ex(1)} AS gaps, {ex(2)} AS hits, {ex(3)} AS vals FROM d), unnest(generate_series(1, len(gaps))) AS s(i))"""


#: Entropy by definition: each window's characters are counted anew.
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{_places("assign", secrets.ASSIGN)},
{_places("access", secrets.ACCESS)},
{_places("hex", secrets.HEX)},
{_places("anys", secrets.CANDIDATE)},
cand AS (SELECT * FROM anys WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT ({_NOT_ALLOWED})),
wins AS (SELECT r, i, start, k, substr(hit, k, {secrets.WINDOW}) AS w, CASE WHEN regexp_full_match(hit, '[0-9a-f]+') THEN {secrets.ceiling(secrets.LIMITS["hex"], secrets.WINDOW)} ELSE {secrets.ceiling(secrets.LIMITS["any"], secrets.WINDOW)} END AS top
  FROM cand, unnest(generate_series(1, length(hit) - {secrets.WINDOW - 1})) AS s(k)),
chars AS (SELECT r, i, start, k, top, c, count(*) AS n FROM (SELECT *, unnest(string_split(w, '')) AS c FROM wins) GROUP BY ALL),
above AS (SELECT r, i, start, k FROM chars GROUP BY r, i, start, k, top HAVING sum(round(n * log2(n) * 1e6)) <= top),
runs AS (SELECT *, sum(CASE WHEN prev IS NULL OR k > prev + {secrets.WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY r, i ORDER BY k) AS g
  FROM (SELECT *, lag(k) OVER (PARTITION BY r, i ORDER BY k) AS prev FROM above)),
spans AS (
  SELECT r, 0 AS no, 'assign' AS kind, start, start + length(hit) AS e FROM assign WHERE length(val) >= 12
  UNION ALL SELECT r, 1, 'access', start, start + length(hit) FROM access
  UNION ALL SELECT r, 2, 'hex', start, start + length(hit) FROM hex
  UNION ALL SELECT r, 3, 'entropy', start + min(k) - 1, start + max(k) - 1 + {secrets.WINDOW} FROM runs GROUP BY r, i, g, start),
agg AS (SELECT r, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS b, count(*) FILTER (no = 2) AS c,
  string_agg(kind || ':' || start || ':' || e, ',' ORDER BY start, no, e) FILTER (no < 3) AS base,
  string_agg(kind || ':' || start || ':' || e, ',' ORDER BY start, no, e) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (r)
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS x FROM s), n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, any_value(n.n) AS n_shingles, min(b) AS component_id FROM reach JOIN n ON n.doc_id = a GROUP BY a
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 49)) AS g(i)),
o AS (SELECT h, min(doc_id) AS owner FROM s GROUP BY h),
p AS (SELECT DISTINCT s.doc_id, s.i + k AS spot FROM s JOIN o USING (h), unnest(generate_series(0, 49)) AS g(k) WHERE o.owner < s.doc_id),
gone AS (SELECT doc_id, list(spot) AS a FROM p GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(a), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN a IS NULL THEN w ELSE [x for x, i in w if NOT list_contains(a, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i:i+4] AS five FROM w, unnest(generate_series(1, len(ws) - 4)) AS s(i)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM t, unnest(generate_series(0, 4)) AS s(k)) GROUP BY r),
ln AS (SELECT r, source, text, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS y,
  len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw FROM w, unnest(ls) AS s(l)),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source),
found AS (SELECT source, y, count(DISTINCT text) AS n FROM ln GROUP BY source, y),
bad AS (SELECT f.source, f.y FROM found f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 10 AND f.n > h.texts * 0.005),
gone AS (SELECT s.r, sum(s.nw) AS n FROM ln s JOIN bad b ON s.source IS NOT DISTINCT FROM b.source AND s.y = b.y GROUP BY s.r),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_line_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - n_line_words AS n_left FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_left < 10 OR n_left < 0.3 * n_words) AS kept, n_line_words FROM v
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
hex AS (SELECT page_id, h, strlen(h)::BIGINT AS n, sha1(h) AS x, first FROM p JOIN f USING (h))
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM hex
"""

ORACLES: dict[str, str] = {"op3_mixing": OP3_SQL, "op5_secrets": OP5_SQL, "op6_ngram_join": OP6_SQL, "op8_phrase_dedup": OP8_SQL, "op9_quality_rules": OP9_SQL, "op10_warc": OP10_SQL}
