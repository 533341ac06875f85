"""Queries from texts to pairs: names of a dictionary, sentences and what they say, evidence of pairs, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as x
from ..functions import text as t
from ..operators import association as a
from ..operators import evidence as e
from ..scratch import written
from ..session import table
from .documents import _SENT, _TOK, _tokens

#: Names as they are looked for and shown; the longer of two at one place wins.
NAMES = ["for", "for the", "from", "this", "was", "with"]
LEXICON = x.Lexicon({"time": ["then", "was"], "place": ["here"]}, positive=["ble", "tion"], negative=["worthless", "pathetic"])
TEMPLATES = ["^Licensed under "], ["All rights reserved"]
ROLES = ["by", "on"], ["ly"]
MARKS = ".!?"
LEAST = 5


def _dictionary() -> x.Dictionary:
    return x.Dictionary([(n, n) for n in NAMES], boundary="word")


def _found(spark, sf) -> DataFrame:
    """(doc_id, row, sentence_index, sentence, items): the sentences with a name, and each text's first. row: the text's own number.

    Python gets sentences, not texts, so that a batch of rows is small whatever the texts' lengths; each is sent once."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    s = e.named_sentences(docs, x.extractor(_dictionary()), "text", MARKS, "row")
    return s.filter((F.size("items") > 0) | (F.coalesce("sentence_index", F.lit(0)) == 0))


def _named(found: DataFrame) -> DataFrame:
    """(doc_id, items, title_items, summary_items): names in the text, in its first sentence and in its second. A text's names are those of its
    sentences, since no name holds an end mark or a line's end, or begins or ends with a blank."""
    own = lambda i: F.flatten(F.collect_list(F.when(F.col("sentence_index") == i, F.col("items"))))
    n = found.groupBy("row", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), own(0).alias("title_items"), own(1).alias("summary_items"))
    return n.drop("row")


def _pairs(named: DataFrame) -> DataFrame:
    return a.exploded_pairs(named).groupBy(*a.PAIR).agg(F.count("*").alias("pair_count")).filter(F.col("pair_count") >= LEAST)


def _chain(spark, sf) -> tuple[DataFrame, DataFrame]:
    """_named() and the sentences with a name, of one pass over the texts."""
    found = written(_found(spark, sf), "sentences")
    return written(_named(found), "named"), e.described(found, x.analyser(LEXICON), TEMPLATES, ROLES)


def dictionary_items(spark, sf):
    return _named(_found(spark, sf)).filter(F.size("items") > 0).select("doc_id", F.array_join("items", "|").alias("items"), F.size("items").alias("n_items"))


def sentence_lexicon(spark, sf):
    """Sentences with a name, by what they say: counts of sentences and documents."""
    s = e.sentence_table(table(spark, sf, "documents"), x.extractor(_dictionary()), x.analyser(LEXICON), TEMPLATES, ROLES, marks=MARKS)
    keys = [F.array_join(F.array_distinct("matched"), "|").alias("matched"), "has_positive", "has_negative", "role_rule", "is_template"]
    return s.groupBy(*keys).agg(F.count("*").alias("n_sentences"), F.countDistinct("doc_id").alias("n_docs"))


def pair_evidence(spark, sf):
    named, sentences = _chain(spark, sf)
    pairs = written(_pairs(named), "pairs")
    return e.pair_features(e.evidence_rows(named, sentences, pairs), pairs)


def pair_review_flags(spark, sf):
    named, sentences = _chain(spark, sf)
    pairs = written(_pairs(named), "pairs")
    return e.pair_flags(named, e.evidence_rows(named, sentences, pairs), pairs)


def evidence_deduplicated(spark, sf):
    """Rows of evidence without repeated sentences, counted by pair."""
    named, sentences = _chain(spark, sf)
    d = e.deduplicated(e.evidence_rows(named, sentences, _pairs(named)))
    return d.groupBy(*a.PAIR).agg(F.count("*").alias("n_rows"), F.count_if("same_sentence").alias("n_same"), F.count_if("has_role").alias("n_role"), F.countDistinct("doc_id").alias("n_docs"))


def dictionary_coverage(spark, sf):
    n = _named(_found(spark, sf)).withColumn("found", F.explode_outer("items"))
    x_ = n.agg(F.countDistinct("found").alias("names_found"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct(F.when(F.col("found").isNotNull(), F.col("doc_id"))).alias("docs_with_name"), F.count("found").alias("mentions"))
    return x_.select(F.lit(len(NAMES)).cast("long").alias("n_names"), "names_found", "n_docs", "docs_with_name", (F.col("docs_with_name") / F.col("n_docs")).alias("share"), (F.col("mentions") / F.col("n_docs")).alias("mean_names"))


def unmatched_tokens(spark, sf):
    """The 50 tokens in most documents that no name of the dictionary holds."""
    words = sorted({w for n in NAMES for w in n.split()})
    x_ = _tokens(spark, sf).filter(~F.col("token").isin(words)).groupBy("token").agg(F.count("*").alias("df"))
    return x_.orderBy(F.desc("df"), "token").limit(50)


def dataset_statistics(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("n_chars")
    return d.agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"), F.countDistinct(F.sha2("text", 256)).alias("n_texts"), F.count_if(F.length(t.utrim("text")) == 0).alias("n_blank"), F.sum(n).alias("total_chars"), F.avg(n).alias("mean_chars"), F.percentile(n, 0.5).alias("median_chars"), F.min(n).alias("least_chars"), F.max(n).alias("most_chars"))


QUERIES = {f.__name__: f for f in (dictionary_items, sentence_lexicon, pair_evidence, pair_review_flags, evidence_deduplicated, dictionary_coverage, unmatched_tokens, dataset_statistics)}


def _items_sql(text: str) -> str:
    """The names that stand alone in an SQL text, sorted. "FOR THE" is taken off (twice, since neighbours share a blank) before "FOR" is looked for."""
    off, edge = f"upper({text})", r"[^\p{L}\p{N}]"
    for _ in range(2):
        off = rf"regexp_replace({off}, '(^|{edge})FOR THE({edge}|$)', '\1#\2', 'g')"
    find = lambda n: f"CASE WHEN regexp_matches({off if n == 'for' else f'upper({text})'}, '(^|{edge}){n.upper()}({edge}|$)') THEN '{n}' END"
    return f"list_filter([{', '.join(map(find, NAMES))}], lambda y: y IS NOT NULL)"


def _any(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(s, '{w}')" for w in terms) + ")"


_KEYS = "item_a, item_b"
_MATCHED = "concat_ws('|', " + ", ".join(f"CASE WHEN contains(s, '{w}') THEN '{c}:{w}' END" for c, terms in LEXICON.categories.items() for w in terms) + ")"
_MIX = " OR ".join(f"regexp_matches(s, {p} || '\\s*[×✕xX+＋/／]\\s*' || {q})" for p, q in (("item_a", "item_b"), ("item_b", "item_a")))
_CHAIN = rf"""WITH {_SENT}, st0 AS (SELECT doc_id, i, s[i] AS s FROM sent, unnest(generate_series(1, len(s))) AS g(i)), st1 AS (SELECT *, {_items_sql("s")} AS items FROM st0),
st AS (SELECT *, {_any(LEXICON.positive)} AS has_positive, {_any(LEXICON.negative)} AS has_negative, {_any(ROLES[0])} AS act, {_any(ROLES[1])} AS eff, starts_with(s, 'Licensed under ') OR contains(s, 'All rights reserved') AS is_template FROM st1 WHERE len(items) > 0),
di AS (SELECT doc_id, {_items_sql("text")} AS items FROM documents), de AS (SELECT doc_id, unnest(items) AS item FROM di),
dp AS (SELECT x.doc_id, x.item AS item_a, y.item AS item_b FROM de x JOIN de y ON x.doc_id = y.doc_id AND x.item < y.item),
pc AS (SELECT {_KEYS}, count(*) AS pair_count FROM dp GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
ev0 AS (SELECT dp.doc_id, dp.item_a, dp.item_b, st.* EXCLUDE (doc_id), act OR eff AS has_role, list_contains(items, item_a) AND list_contains(items, item_b) AS same FROM dp JOIN pc USING ({_KEYS}) JOIN st USING (doc_id) WHERE list_contains(items, item_a) OR list_contains(items, item_b)),
ev AS (SELECT *, same AND contains(s, item_a) AND contains(s, item_b) AND ({_MIX}) AS has_explicit_mix FROM (SELECT *, bool_or(same) OVER (PARTITION BY doc_id, {_KEYS}) AS any_same FROM ev0) WHERE same OR NOT any_same)"""


def _features_sql() -> str:
    flags, good = e.FLAGS[:4], "NOT is_template"
    doc = ["bool_or(same) AS cooccurs", f"bool_or(same AND {good}) AS evidence", *[f"bool_or(same AND {good} AND {f}) AS same_{f}" for f in flags], *[f"bool_or({good} AND {f}) AS doc_{f}" for f in flags[:3]]]
    doc += [*[f"count(*) FILTER (same AND {good} AND {f}) AS rows_{f}" for f in flags], "count(*) FILTER (is_template) AS template_rows"]
    kept = ["cooccurs", "evidence", *[f"same_{f}" for f in flags], *[f"doc_{f}" for f in flags[:3]]]
    sums = [*[f"count(*) FILTER ({c}) AS {c}_docs" for c in kept], *[f"sum({c})::BIGINT AS {c}" for c in [*[f"rows_{f}" for f in flags], "template_rows"]]]
    names = [s.rsplit(" AS ", 1)[1] for s in sums]
    ratios = [*[f"coalesce(same_{f}_docs / nullif(evidence_docs, 0), 0) AS same_{f}_ratio" for f in flags[:3]], *[f"coalesce(doc_{f}_docs / pair_count, 0) AS doc_{f}_ratio" for f in flags[:3]]]
    return f"""{_CHAIN}, pd AS (SELECT {_KEYS}, doc_id, {", ".join(doc)} FROM ev GROUP BY 1, 2, 3), pf AS (SELECT {_KEYS}, {", ".join(sums)} FROM pd GROUP BY 1, 2),
z AS (SELECT pc.*, {", ".join(f"coalesce({n}, 0) AS {n}" for n in names)} FROM pc LEFT JOIN pf USING ({_KEYS})) SELECT *, {", ".join(ratios)} FROM z"""


ORACLES = {
    "dictionary_items": f"WITH di AS (SELECT doc_id, {_items_sql('text')} AS items FROM documents) SELECT doc_id, array_to_string(items, '|') AS items, len(items)::INT AS n_items FROM di WHERE len(items) > 0",
    "sentence_lexicon": f"""{_CHAIN}, z AS (SELECT doc_id, {_MATCHED} AS matched, has_positive, has_negative, concat_ws('+', CASE WHEN act THEN 'action' END, CASE WHEN eff THEN 'effect' END) AS role_rule, is_template FROM st)
SELECT matched, has_positive, has_negative, role_rule, is_template, count(*) AS n_sentences, count(DISTINCT doc_id) AS n_docs FROM z GROUP BY ALL""",
    "pair_evidence": _features_sql(),
    "pair_review_flags": f"""{_CHAIN}, ts AS (SELECT doc_id, list_concat({_items_sql("coalesce(s[1], '')")}, {_items_sql("coalesce(s[2], '')")}) AS named FROM sent),
na AS (SELECT {_KEYS}, bool_or(list_contains(named, item_a) AND list_contains(named, item_b)) AS d FROM dp JOIN ts USING (doc_id) GROUP BY 1, 2), ex AS (SELECT {_KEYS}, bool_or(has_explicit_mix AND NOT is_template) AS m FROM ev GROUP BY 1, 2)
SELECT pc.*, coalesce(d, false) AS product_name_derived, coalesce(m, false) AS has_explicit_mix, coalesce(d, false) AND NOT coalesce(m, false) AS excluded,
  contains(replace(item_a, ' ', ''), replace(item_b, ' ', '')) OR contains(replace(item_b, ' ', ''), replace(item_a, ' ', '')) AS parent_child_pair FROM pc LEFT JOIN na USING ({_KEYS}) LEFT JOIN ex USING ({_KEYS})""",
    "evidence_deduplicated": f"{_CHAIN}, z AS (SELECT DISTINCT {_KEYS}, doc_id, s, same, has_role FROM ev) SELECT {_KEYS}, count(*) AS n_rows, count(*) FILTER (same) AS n_same, count(*) FILTER (has_role) AS n_role, count(DISTINCT doc_id) AS n_docs FROM z GROUP BY 1, 2",
    "dictionary_coverage": f"""WITH di AS (SELECT doc_id, {_items_sql('text')} AS items FROM documents)
SELECT {len(NAMES)}::BIGINT AS n_names, (SELECT count(DISTINCT y) FROM (SELECT unnest(items) AS y FROM di)) AS names_found, count(*) AS n_docs, count(*) FILTER (len(items) > 0) AS docs_with_name, count(*) FILTER (len(items) > 0) / count(*) AS share, sum(len(items)) / count(*) AS mean_names FROM di""",
    "unmatched_tokens": f"WITH {_TOK} SELECT token, count(*) AS df FROM tok WHERE token NOT IN ({', '.join(repr(w) for w in sorted({w for n in NAMES for w in n.split()}))}) GROUP BY 1 ORDER BY df DESC, token LIMIT 50",
    "dataset_statistics": r"""SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, count(DISTINCT sha256(text)) AS n_texts, count(*) FILTER (regexp_full_match(text, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]*')) AS n_blank,
  sum(n_chars)::BIGINT AS total_chars, avg(n_chars) AS mean_chars, quantile_cont(n_chars, 0.5)::DOUBLE AS median_chars, min(n_chars) AS least_chars, max(n_chars) AS most_chars FROM documents""",
}
