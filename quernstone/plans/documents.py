"""Queries on documents, pages, events and conversations: tokens, lines, audits, trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import association as a
from ..session import table

TEMPLATES = {"regex": [r"^Licensed under .*", r"[A-Z]{2,}!!"], "contains": ["All rights reserved", "|", "http"]}
PHRASES = ["Licensed under", "password", "the the", "AKIA"]


def _tokens(spark, sf):
    """(doc_id, token): lower-case runs of a-z, once per document and token."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(words)).alias("token"))


def tokens_df(spark, sf):
    return _tokens(spark, sf).groupBy("token").agg(F.count("*").alias("df")).filter("df >= 3")


def vocabulary_topn(spark, sf):
    x = tokens_df(spark, sf).filter(F.length("token") >= 4)
    return x.orderBy(F.desc("df"), "token").limit(200).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), "token")))


def doc_item_extract(spark, sf):
    v = vocabulary_topn(spark, sf).filter("rank <= 100").select("token")
    return _tokens(spark, sf).join(F.broadcast(v), "token").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("token")), "|").alias("items"), F.count("*").alias("n_items"))


def sentence_split(spark, sf):
    s = t.sentences(F.col("text"), ".!?")
    return table(spark, sf, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("first_sentence"), F.aggregate(s, F.lit(0), lambda acc, x: acc + F.length(x)).alias("sentence_chars"))


def sentence_pairs(spark, sf):
    """Tokens of the top 40 that share a sentence: counts of sentences and of documents."""
    v = [r["token"] for r in vocabulary_topn(spark, sf).filter("rank <= 40").select("token").collect()]
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(t.sentences(F.col("text"), ".!?")).alias("i", "sentence"))
    found = F.array_sort(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z]+"), F.lit(0))), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")))
    x = a.exploded_pairs(s.select("doc_id", found.alias("items")), "doc_id")
    return x.groupBy(*a.PAIR).agg(F.count("*").alias("n_sentences"), F.countDistinct("doc_id").alias("n_docs"))


def template_hits(spark, sf):
    hit = t.template_hit(F.col("line"), TEMPLATES["regex"], TEMPLATES["contains"])
    x = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return x.withColumn("pattern", hit).filter("pattern is not null").groupBy("pattern").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


PHRASE_WORDS = 8


def contamination_hits(spark, sf):
    """Documents that hold PHRASE_WORDS consecutive words of a benchmark item, from anywhere in it, or all words of a shorter item: the number
    of different phrases found, and the surroundings of the first. Documents and items meet by the phrases' hashes."""
    split = lambda c: F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    phrases = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    b = table(spark, sf, "benchmark").select("item_id", split("text").alias("w")).filter(F.size("w") > 0)
    b = b.withColumn("k", F.least(F.size("w"), F.lit(PHRASE_WORDS)))
    items = b.select("item_id", "k", F.explode(F.array_distinct(phrases(F.col("w"), F.col("k")))).alias("phrase"))
    docs = table(spark, sf, "documents").select("doc_id", "text", F.xxhash64("text").alias("h")).filter(F.col("text").isNotNull())
    found = None
    for k in sorted(r["k"] for r in items.select("k").distinct().collect()):  # PHRASE_WORDS rows at most
        own = items.filter(F.col("k") == k).select("item_id", "phrase", F.xxhash64("phrase").alias("key"))
        x = docs.select("doc_id", "h", split("text").alias("w")).filter(F.size("w") >= k)
        hashes = F.transform(phrases(F.col("w"), F.lit(k)), lambda p: F.xxhash64(p))
        met = x.select("doc_id", "h", F.posexplode(hashes).alias("at", "key")).join(own, "key").select("doc_id", "h", "item_id", "at", "phrase")
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = docs.limit(0).select("doc_id", "h", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("at"), "text").withColumnRenamed("text", "phrase")
    found = found.groupBy(F.col("doc_id").alias("of"), F.col("h").alias("of_text"), "item_id").agg(F.countDistinct("phrase").alias("n_phrases"), F.min_by("phrase", "at").alias("phrase"))
    hits = docs.dropDuplicates(["doc_id", "h"]).join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_text")))
    return hits.select("doc_id", "item_id", "n_phrases", t.snippet(F.array_join(split("text"), " "), F.col("phrase"), 20).alias("context"))


def phrase_hits(spark, sf):
    found = F.explode(t.found_terms(F.col("text"), PHRASES)).alias("phrase")
    return table(spark, sf, "documents").select("source", "doc_id", found).groupBy("source", "phrase").agg(F.count("*").alias("n"))


def length_outliers(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    m = d.agg(F.percentile("n_chars", 0.5).alias("median"))
    ends = {n: d.orderBy(*order).limit(5).select("doc_id", F.lit(True).alias(n)) for n, order in (("low", ["n_chars", "doc_id"]), ("high", [F.desc("n_chars"), "doc_id"]))}
    low, high = ends["low"], ends["high"]
    x = d.crossJoin(F.broadcast(m)).join(F.broadcast(low), "doc_id", "left").join(F.broadcast(high), "doc_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 500, "under_500"), F.when(F.col("n_chars") > 3 * F.col("median"), "over_3x_median"), F.when(F.col("low"), "bottom_5"), F.when(F.col("high"), "top_5")))
    return x.select("doc_id", "n_chars", F.array_join(reasons, "|").alias("reasons")).filter("reasons <> ''")


def length_quantiles(spark, sf):
    q = lambda p: F.percentile("n_chars", p)
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max("n_chars").alias("longest"))


def repeated_paragraphs(spark, sf):
    key = F.lower(F.regexp_replace("line", "[^A-Za-z0-9]+", ""))
    x = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", key.alias("key")).filter(F.length("key") >= 8)
    return x.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n")).filter("n_docs >= 2")


def doc_dedup_hash(spark, sf):
    """Exact copies by text hash; the smallest id stays, which needs no window over a hot hash."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("n_copies"))
    return d.join(first, "h").select("doc_id", "kept_id", "n_copies", (F.col("doc_id") != F.col("kept_id")).alias("is_duplicate"))


def parent_child_theta(spark, sf):
    v = vocabulary_topn(spark, sf).select("token")
    x = v.select(F.col("token").alias("child")).join(F.broadcast(v.select(F.col("token").alias("parent"))), F.contains(F.col("parent"), F.col("child")) & (F.col("parent") != F.col("child")))
    return x.select("child", "parent")


def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).alias("n_links"), F.regexp_count("html", F.lit("<p>")).alias("n_paragraphs"))


def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", t.url_domain(u).alias("domain"), t.url_slug(u).alias("slug"), t.url_plain(u).alias("plain"), F.sha2(u, 256).alias("url_sha256"))


def yearly_trend(spark, sf):
    x = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"))
    return x.agg(F.count("*").alias("n"), *[F.avg((F.col("o_orderpriority") == p).cast("double")).alias(n) for p, n in (("1-URGENT", "urgent"), ("5-LOW", "low"))])


def era_compare(spark, sf):
    """Share of each order's types in two eras, and its change in percent."""
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    x = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.withColumn("era", F.when(F.col("y") <= 1997, "early").otherwise("late"))
    n = x.groupBy("era").agg(F.countDistinct("l_orderkey").alias("orders"))
    g = x.groupBy("era", "p_type").agg(F.countDistinct("l_orderkey").alias("n")).join(n, "era").withColumn("share", F.col("n") / F.col("orders"))
    e, l = (g.filter(F.col("era") == v).select("p_type", F.col("share").alias(v)) for v in ("early", "late"))
    return e.join(l, "p_type", "full").select("p_type", F.coalesce("early", F.lit(0.0)).alias("early"), F.coalesce("late", F.lit(0.0)).alias("late")).withColumn("change_pct", F.try_divide(100 * (F.col("late") - F.col("early")), F.col("early")))


def event_era(spark, sf):
    x = table(spark, sf, "events").filter(F.dayofmonth("ts").between(1, 14) | F.dayofmonth("ts").between(18, 31))
    return x.groupBy("event_type", (F.dayofmonth("ts") <= 14).alias("first_half")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def json_props_stats(spark, sf):
    x = table(spark, sf, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return x.groupBy("event_type", "key").agg(F.count("*").alias("n"))


def conversation_context(spark, sf):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, sf, "conversations").withColumn("i", F.row_number().over(w)).filter("i <= 2").select("conv_id", "role", "turn", F.col("text").alias("context"))


def metadata_inconsistency(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rules = [("shipped_before_order", F.col("l_shipdate") < F.col("o_orderdate")), ("open_but_returned", (F.col("o_orderstatus") == "O") & (F.col("l_returnflag") == "R")), ("large_discount", F.col("l_discount") > F.col("l_tax") + 0.05), ("line_over_total", F.col("l_extendedprice") > F.col("o_totalprice"))]
    hit = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("rule")
    return x.select("l_orderkey", hit).groupBy("rule").agg(F.count("*").alias("n_lines"), F.countDistinct("l_orderkey").alias("n_orders"))


def alias_components(spark, sf):
    """Words of part names that agree but for case, symbols and plural: groups, and the label each takes (most frequent, longest, first)."""
    from ..operators import graph as g

    w = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    w = w.unionByName(w.select(F.concat(F.col("word"), F.lit("s")).alias("word")).distinct()).groupBy("word").agg(F.count("*").alias("n"))
    keyed = w.select("word", "n", F.regexp_replace(F.upper("word"), "S$", "").alias("k"))
    least = keyed.groupBy("k").agg(F.min("word").alias("item_a"))  # a group's words are linked through its first, not all with all
    edges = least.join(keyed.select(F.col("word").alias("item_b"), "k"), "k").filter("item_a < item_b").select("item_a", "item_b")
    c = g.components(edges).join(w, F.col("node") == F.col("word"))
    label = c.groupBy("component").agg(F.min_by("word", F.struct(-F.col("n"), F.length("word"), F.col("word"))).alias("canonical"))
    return c.join(label, "component").select("word", "n", "canonical")


def apply_alias_map(spark, sf):
    m = alias_components(spark, sf).select("word", "canonical")
    x = table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).join(m, "word", "left")
    x = x.groupBy("p_partkey").agg(F.sort_array(F.collect_set(F.coalesce("canonical", "word"))).alias("items"), F.bool_or(F.col("canonical") != F.col("word")).alias("changed"))
    return x.select("p_partkey", F.array_join("items", "|").alias("items"), "changed")


QUERIES = {
    f.__name__: f
    for f in (tokens_df, vocabulary_topn, doc_item_extract, sentence_split, sentence_pairs, template_hits, contamination_hits, phrase_hits, length_outliers, length_quantiles, repeated_paragraphs, doc_dedup_hash, parent_child_theta, html_title, url_parts, yearly_trend, era_compare, event_era, json_props_stats, conversation_context, metadata_inconsistency, alias_components, apply_alias_map)
}

_TOK = "tok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS token FROM documents), dfs AS (SELECT token, count(*) AS df FROM tok GROUP BY 1 HAVING count(*) >= 3), voc AS (SELECT token, df, row_number() OVER (ORDER BY df DESC, token)::INT AS rank FROM dfs WHERE length(token) >= 4 QUALIFY rank <= 200)"
_TRIM = r"regexp_replace(x, '^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$', '', 'g')"
_SENT = rf"sent AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([.!?])', '\1' || chr(10), 'g'), '\n+'), lambda x: {_TRIM}), lambda x: x <> '') AS s FROM documents)"
_ALIAS = """w0 AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part), w AS (SELECT word, count(*) AS n FROM (SELECT word FROM w0 UNION ALL SELECT DISTINCT word || 's' FROM w0) GROUP BY 1),
ky AS (SELECT *, regexp_replace(upper(word), 'S$', '') AS k FROM w), al AS (SELECT *, first_value(word) OVER (PARTITION BY k ORDER BY n DESC, length(word), word) AS canonical FROM ky WHERE k IN (SELECT k FROM ky GROUP BY k HAVING count(*) > 1))"""
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"

ORACLES = {
    "tokens_df": f"WITH {_TOK} SELECT * FROM dfs",
    "vocabulary_topn": f"WITH {_TOK} SELECT * FROM voc",
    "doc_item_extract": f"WITH {_TOK} SELECT doc_id, array_to_string(list_sort(list(token)), '|') AS items, count(*) AS n_items FROM tok JOIN voc USING (token) WHERE rank <= 100 GROUP BY doc_id",
    "sentence_split": f"WITH {_SENT} SELECT doc_id, len(s)::INT AS n_sentences, coalesce(s[1], '') AS first_sentence, coalesce(list_sum([length(x) for x in s]), 0)::INT AS sentence_chars FROM sent",
    "sentence_pairs": f"""WITH {_TOK}, {_SENT}, q AS (SELECT doc_id, i, unnest(list_distinct(regexp_extract_all(lower(s[i]), '[a-z]+'))) AS token FROM sent, unnest(generate_series(1, len(s))) AS g(i)), k AS (SELECT * FROM q WHERE token IN (SELECT token FROM voc WHERE rank <= 40))
SELECT x.token AS item_a, y.token AS item_b, count(*) AS n_sentences, count(DISTINCT x.doc_id) AS n_docs FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.i = y.i AND x.token < y.token GROUP BY 1, 2""",
    "template_hits": f"""WITH l AS ({_LINES}), h AS (SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(line, '{r}') THEN '{r}'" for r in TEMPLATES["regex"])} {" ".join(f"WHEN contains(line, '{c}') THEN '{c}'" for c in TEMPLATES["contains"])} END AS pattern FROM l)
SELECT pattern, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM h WHERE pattern IS NOT NULL GROUP BY 1""",
    "contamination_hits": rf"""WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), {PHRASE_WORDS}) AS k, array_to_string(w[j:j + least(len(w), {PHRASE_WORDS}) - 1], ' ') AS phrase FROM b, unnest(generate_series(1, greatest(len(w) - {PHRASE_WORDS - 1}, 1))) AS g(j) WHERE len(w) > 0),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT doc_id, k, spot, array_to_string(w[spot:spot + k - 1], ' ') AS phrase FROM d, (SELECT DISTINCT k FROM i), unnest(generate_series(1, len(w) - k + 1)) AS g(spot)),
f AS (SELECT doc_id, item_id, count(DISTINCT phrase) AS n_phrases, arg_min(phrase, spot) AS p FROM m JOIN i USING (k, phrase) GROUP BY 1, 2),
x AS (SELECT doc_id, item_id, n_phrases, p, array_to_string(w, ' ') AS t FROM f JOIN d USING (doc_id))
SELECT doc_id, item_id, n_phrases, substr(t, greatest(instr(t, p) - 20, 1), instr(t, p) - greatest(instr(t, p) - 20, 1) + length(p) + 20) AS context FROM x""",
    "phrase_hits": f"SELECT source, phrase, count(*) AS n FROM documents, unnest({PHRASES}) AS t(phrase) WHERE contains(text, phrase) GROUP BY 1, 2",
    "length_outliers": """WITH m AS (SELECT quantile_cont(n_chars, 0.5) AS med FROM documents), x AS (SELECT doc_id, n_chars, med, row_number() OVER (ORDER BY n_chars, doc_id) AS up, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS down FROM documents, m),
y AS (SELECT doc_id, n_chars, concat_ws('|', CASE WHEN n_chars < 500 THEN 'under_500' END, CASE WHEN n_chars > 3 * med THEN 'over_3x_median' END, CASE WHEN up <= 5 THEN 'bottom_5' END, CASE WHEN down <= 5 THEN 'top_5' END) AS reasons FROM x) SELECT * FROM y WHERE reasons <> ''""",
    "length_quantiles": "SELECT lang, count(*) AS n, avg(n_chars) AS mean, quantile_cont(n_chars, 0.05)::DOUBLE AS p05, quantile_cont(n_chars, 0.5)::DOUBLE AS p50, quantile_cont(n_chars, 0.95)::DOUBLE AS p95, max(n_chars) AS longest FROM documents GROUP BY 1",
    "repeated_paragraphs": f"WITH l AS ({_LINES}), k AS (SELECT doc_id, lower(regexp_replace(line, '[^A-Za-z0-9]+', '', 'g')) AS key FROM l) SELECT key, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM k WHERE length(key) >= 8 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2",
    "doc_dedup_hash": "WITH f AS (SELECT text, min(doc_id) AS kept_id, count(*) AS n_copies FROM documents GROUP BY 1) SELECT doc_id, kept_id, n_copies, doc_id <> kept_id AS is_duplicate FROM documents JOIN f USING (text)",
    "parent_child_theta": f"WITH {_TOK} SELECT c.token AS child, p.token AS parent FROM voc c JOIN voc p ON contains(p.token, c.token) AND p.token <> c.token",
    "html_title": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href='))::INT AS n_links, len(regexp_extract_all(html, '<p>'))::INT AS n_paragraphs FROM pages",
    "url_parts": r"SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS domain, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1) AS slug, rtrim(trim(url), '/') AS plain, sha256(url) AS url_sha256 FROM pages",
    "yearly_trend": "SELECT year(o_orderdate)::INT AS year, count(*) AS n, avg((o_orderpriority = '1-URGENT')::INT) AS urgent, avg((o_orderpriority = '5-LOW')::INT) AS low FROM orders GROUP BY 1",
    "era_compare": """WITH x AS (SELECT CASE WHEN year(o_orderdate) <= 1997 THEN 'early' ELSE 'late' END AS era, p_type, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
n AS (SELECT era, count(DISTINCT l_orderkey) AS o FROM x GROUP BY 1), g AS (SELECT era, p_type, count(DISTINCT l_orderkey) / any_value(o) AS share FROM x JOIN n USING (era) GROUP BY 1, 2),
s AS (SELECT p_type, coalesce(max(share) FILTER (era = 'early'), 0) AS early, coalesce(max(share) FILTER (era = 'late'), 0) AS late FROM g GROUP BY 1) SELECT *, CASE WHEN early <> 0 THEN 100 * (late - early) / early END AS change_pct FROM s""",
    "event_era": "SELECT event_type, day(ts) <= 14 AS first_half, count(*) AS n, avg(value) AS mean_value FROM events WHERE day(ts) BETWEEN 1 AND 14 OR day(ts) BETWEEN 18 AND 31 GROUP BY 1, 2",
    "json_props_stats": "SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2",
    "conversation_context": "SELECT conv_id, role, turn, text AS context FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) <= 2",
    "metadata_inconsistency": """WITH x AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), h AS (SELECT 'shipped_before_order' AS rule, l_orderkey FROM x WHERE l_shipdate < o_orderdate UNION ALL SELECT 'open_but_returned', l_orderkey FROM x WHERE o_orderstatus = 'O' AND l_returnflag = 'R'
UNION ALL SELECT 'large_discount', l_orderkey FROM x WHERE l_discount > l_tax + 0.05::DOUBLE UNION ALL SELECT 'line_over_total', l_orderkey FROM x WHERE l_extendedprice > o_totalprice) SELECT rule, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM h GROUP BY 1""",
    "alias_components": f"WITH {_ALIAS} SELECT word, n, canonical FROM al",
    "apply_alias_map": f"""WITH {_ALIAS}, x AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT p_partkey, array_to_string(list_sort(list(DISTINCT coalesce(canonical, x.word))), '|') AS items, bool_or(canonical <> x.word) AS changed FROM x LEFT JOIN al USING (word) GROUP BY 1""",
}
