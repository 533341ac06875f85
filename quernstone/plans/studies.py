"""Queries on studies of rankings: conditions, renamed items, candidates for review, settings and grids, scopes, a reference set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import association as a
from ..operators import evaluation as ev
from ..operators import graph as g
from ..operators import scoring as s
from ..scratch import written
from ..session import table
from .association import _FLAGGED, _LIMITED, _NORM, _ORDER, _TIER, GATE, _grid_sql, _score, baskets_sql, flagged_baskets, limited, order_baskets, pair_features
from .association import ORACLES as _ASSOCIATION
from .evaluation import _EXT, _LABELLED, _PAIR_AB, KS, _by_condition, _labelled, _rank_sql, _ranking, _top_labelled

MIN_COUNTS = (1, 10, 30)
BASE_GRID = "same_context_required|100|2"
FEATURES = ["pair_count", "support", "lift", "centrality_mean", "centrality_max", "centrality_geometric", "evidence", "positive", "role", "negative", "n_positive", "n_role", "n_negative"]


def condition_lift_lists(spark, sf):
    cuts = spark.createDataFrame([(n,) for n in MIN_COUNTS], "min_count int")
    return a.lift_lists(flagged_baskets(spark, sf), cuts, 20).select("condition", "min_count", *a.PAIR, "pair_count", "lift", "rank")


def condition_components(spark, sf):
    """Components of each condition's graph of pairs, and the largest one's nodes."""
    x = a.exploded_pairs(a.condition_table(flagged_baskets(spark, sf)), "condition").distinct()
    c = g.components(x.select(*[F.concat_ws("|", "condition", side).alias(side) for side in a.PAIR]))
    sizes = c.groupBy(F.substring_index("node", "|", 1).alias("condition"), "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("condition").agg(F.count("*").alias("components"), F.max("n").alias("largest"))


def pair_presence(spark, sf):
    return a.presence(flagged_baskets(spark, sf))


def itemset_contexts(spark, sf):
    """Orders that hold the brands of a 4-set found in at least two orders of up to five brands."""
    b = written(limited(spark, sf), "baskets")
    return a.itemset_baskets(b, 4, 2).select(F.array_join("items", "|").alias("items"), "basket_id")


def _brand_groups(spark, sf):
    """Brands under the first digit of their number."""
    return table(spark, sf, "part").select(F.col("p_brand").alias("item")).distinct().withColumn("canonical", F.concat(F.lit("Brand#"), F.substring("item", 7, 1)))


def raw_vs_normalised(spark, sf):
    raw = flagged_baskets(spark, sf)
    sides = {"raw": raw, "normalised": a.renamed(raw, _brand_groups(spark, sf), "flag")}
    stats = [a.condition_statistics(x) for x in sides.values()]
    one, two = (x.select("condition", *[F.col(c).alias(f"{c}_{n}") for c in x.columns if c != "condition"]) for n, x in zip(sides, stats, strict=True))
    return one.join(two, "condition")


def normalisation_impact(spark, sf):
    c = a.Condition("limited_2_5", 2, 5)
    after = written(a.in_condition(a.renamed(order_baskets(spark, sf), _brand_groups(spark, sf)), c), "baskets")
    return a.renaming_impact(written(limited(spark, sf), "baskets"), after)


def rank_drops(spark, sf):
    return ev.rank_drops(_by_condition(spark, sf, "all_multi"), _by_condition(spark, sf, "limited_2_5"), "pair_key", 20)


def review_candidates(spark, sf):
    lists = {n: f"rank_{n}" for n in ("overall", "support", "lift", "support_lift")}
    return ev.review_candidates(s.ranking_v2(pair_features(spark, sf), **GATE), lists, 20).select(*a.PAIR, *lists.values(), "ranking_source")


def _tiered(spark, sf) -> DataFrame:
    return s.tiers(s.normalised_v2(pair_features(spark, sf), **GATE), tier1_pairs=100, tier1_evidence=2, tier2_pairs=60)


def _threes(spark, sf) -> DataFrame:
    """The reference set: pairs in at least 20 orders of three brands."""
    return a.pair_statistics(a.in_condition(order_baskets(spark, sf), a.Condition("three", 3, 3))).filter("pair_count >= 20")


def tier_agreement(spark, sf):
    return ev.scope_agreement(_tiered(spark, sf).filter("tier <> 'Excluded'"), _threes(spark, sf), "pair_key", "tier")


def reference_statistics(spark, sf):
    return ev.reference_statistics(_threes(spark, sf), _ranking(spark, sf), "pair_key", KS)


def sensitivity_changes(spark, sf):
    x = written(_tiered(spark, sf).filter("tier <> 'Excluded'"), "tiered")
    label = F.when(F.col("pair_count") % 3 == 0, "valid").when(F.col("pair_count") % 3 == 1, "partially_valid")
    return s.setting_changes(s.scored_by_setting(x, s.weight_settings()), x.select(*a.PAIR, label.alias("label")))


def grid_stability(spark, sf):
    x = s.thresholds(pair_features(spark, sf), s.threshold_grid(spark, (60, 100, 140, 180), (1, 2, 3)))
    return s.grid_stability(written(x.select("setting", *a.PAIR, "setting_rank", "tier"), "grid"), BASE_GRID)


def tier_differences(spark, sf):
    return s.tier_differences(s.distributions(_tiered(spark, sf), "tier", FEATURES))


def ranking_metadata(spark, sf):
    return s.ranking_metadata(s.ranking_v2(pair_features(spark, sf), **GATE), "pair_key", "rank_overall", ["score", "pair_count", "lift"])


def _scoped(df: DataFrame, top: DataFrame) -> DataFrame:
    """df in all scopes; top: the ranked ids, as many as the largest k."""
    return ev.in_scopes(df.join(F.broadcast(top.select("doc_id", "rank")), "doc_id", "left"), KS)


def label_metrics_by_scope(spark, sf):
    return ev.label_metrics(_scoped(_labelled(spark, sf), _top_labelled(spark, sf)), ["quality", "toxic"])


def feature_relation(spark, sf):
    """Exclamation marks against the label of quality."""
    marks = table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("!")).alias("marks")).join(table(spark, sf, "labels"), "doc_id")
    return ev.feature_relation(_scoped(marks, _top_labelled(spark, sf)), "marks", "quality", ["1"])


def label_source(spark, sf):
    """The source that each of two orders picks: base labels are those of long documents, the second reviewer's those of none."""
    x = _labelled(spark, sf).select(F.when(F.col("n_chars") > 1000, F.col("quality")).alias("base"), F.col("quality").alias("reviewer1"), F.lit("").alias("reviewer2"))
    orders = {"base_first": ["base", "reviewer1", "reviewer2"], "reviewer_first": ["reviewer1", "base", "reviewer2"], "second_first": ["reviewer2", "base", "reviewer1"]}
    return reduce(DataFrame.unionByName, [ev.label_source(x, order).withColumn("choice", F.lit(name)) for name, order in orders.items()])


QUERIES = {
    f.__name__: f
    for f in (condition_lift_lists, condition_components, pair_presence, itemset_contexts, raw_vs_normalised, normalisation_impact, rank_drops, review_candidates, tier_agreement, reference_statistics, sensitivity_changes, grid_stability, tier_differences, ranking_metadata, label_metrics_by_scope, feature_relation, label_source)
}

_GROUPED = "'Brand#' || substr(p_brand, 7, 1)"
_STATS_COLUMNS = ("n_baskets", "mean_items", "median_items", "max_items", "nodes", "edges", "density")
_THREES = f"b3 AS (SELECT * FROM b WHERE len(items) = 3), {_rank_sql('x3', 'b3')}, three AS (SELECT pair_key FROM x3_stats WHERE pair_count >= 20)"
_RANKED = f"SELECT pair_key, row_number() OVER (ORDER BY support DESC, {_ORDER}) AS rs, row_number() OVER (ORDER BY lift DESC, pair_count DESC, item_a, item_b) AS rl FROM stats"
_LIMITED_GROUPED = _LIMITED.replace(baskets_sql(), baskets_sql(_GROUPED))
_SCOPES = f"{_LABELLED}, z AS (SELECT 'all' AS scope, * FROM x UNION ALL SELECT 'top_' || k, x.* FROM x, ks WHERE rank <= k)"
_CELLS = [(y, f) for y in (0, 1) for f in (0, 1)]
_META = {"rows": "count(*)", "distinct_keys": "count(DISTINCT pair_key)", "ranks_whole": "(count(DISTINCT rank_overall) = count(*) AND min(rank_overall) = 1 AND max(rank_overall) = count(*))::INT"} | {f"{v}_{e}": f"{e}({v})" for v in ("rank_overall", "score", "pair_count", "lift") for e in ("min", "max")}


def _jaccard(r: str) -> str:
    return f"(SELECT count(*) FILTER (x.{r} <= 10 AND y.{r} <= 10) / nullif(count(*) FILTER (x.{r} <= 10 OR y.{r} <= 10), 0) FROM x FULL JOIN y USING (pair_key))"


def _changes_sql() -> str:
    union = " UNION ALL ".join(f"SELECT '{n}' AS setting, item_a, item_b, pair_key, pair_count, lift, tier, {_score(w)} AS sc FROM tier WHERE tier <> 'Excluded'" for n, w in s.weight_settings().items())
    listed = lambda c: f"coalesce(array_to_string(list_sort(list(r.pair_key) FILTER ({c})), ' | '), '')"
    rate = lambda n, m: f"count(*) FILTER (r.rk <= {n} AND r.pair_count % 3 = {m}) / nullif(count(*) FILTER (r.rk <= {n} AND r.pair_count % 3 < 2), 0)"
    rates = ", ".join(f"{rate(n, m)} AS top{n}_{v}_rate" for n in (5, 10) for m, v in enumerate(("valid", "partially_valid")))
    return f"""{_NORM}, {_TIER}, sc AS ({union}), r AS (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY sc DESC, {_ORDER}) AS rk FROM sc)
SELECT r.setting, count(*) FILTER (r.tier = 'Tier1') AS tier1, count(*) FILTER (r.tier = 'Tier2') AS tier2, {listed("o.rk <= 10 AND r.rk > 10")} AS dropped, {listed("r.rk <= 10 AND o.rk > 10")} AS entered,
  first(r.pair_key ORDER BY abs(r.rk - o.rk) DESC, r.pair_key) AS max_shift_pair, {rates} FROM r JOIN r o ON o.setting = 'baseline' AND o.pair_key = r.pair_key GROUP BY 1"""


ORACLES = {
    "condition_lift_lists": f"""{_FLAGGED}, f AS (SELECT condition, item, count(*) AS f FROM e GROUP BY ALL), n AS (SELECT condition, count(*) AS n FROM c GROUP BY 1), cuts(min_count) AS (VALUES {", ".join(f"({n})" for n in MIN_COUNTS)}),
x AS (SELECT condition, min_count, item_a, item_b, pair_count, pair_count * n / (fa.f * fb.f) AS lift FROM p JOIN n USING (condition) JOIN f fa USING (condition) JOIN f fb USING (condition), cuts WHERE fa.item = item_a AND fb.item = item_b AND pair_count >= min_count)
SELECT *, row_number() OVER (PARTITION BY condition, min_count ORDER BY lift DESC, pair_count DESC, item_a, item_b)::INT AS rank FROM x QUALIFY rank <= 20""",
    "condition_components": f"""{_FLAGGED.replace('WITH b', 'WITH RECURSIVE b', 1)}, w AS (SELECT condition, item_a AS node, item_b AS other FROM p UNION SELECT condition, item_b, item_a FROM p),
reach AS (SELECT * FROM w UNION SELECT r.condition, r.node, w.other FROM reach r JOIN w ON w.condition = r.condition AND w.node = r.other),
k AS (SELECT condition, node, least(node, min(other)) AS k FROM reach GROUP BY 1, 2), z AS (SELECT condition, k, count(*) AS n FROM k GROUP BY 1, 2) SELECT condition, count(*) AS components, max(n) AS largest FROM z GROUP BY 1""",
    "pair_presence": f"{_FLAGGED} SELECT item_a, item_b, {', '.join(f"bool_or(condition = '{c.name}') AS {c.name}_present" for c in a.CONDITIONS)} FROM p GROUP BY 1, 2",
    "itemset_contexts": f"""WITH b AS ({baskets_sql()}), e AS (SELECT basket_id, unnest(items) AS item FROM b WHERE len(items) BETWEEN 2 AND 5)
SELECT x.item || '|' || y.item || '|' || z.item || '|' || w.item AS items, x.basket_id FROM e x JOIN e y ON y.basket_id = x.basket_id AND y.item > x.item JOIN e z ON z.basket_id = x.basket_id AND z.item > y.item JOIN e w ON w.basket_id = x.basket_id AND w.item > z.item
QUALIFY count(*) OVER (PARTITION BY x.item, y.item, z.item, w.item) >= 2""",
    "raw_vs_normalised": f"""SELECT r.condition, {", ".join(f"r.{c} AS {c}_raw, n.{c} AS {c}_normalised" for c in _STATS_COLUMNS)}
FROM ({_ASSOCIATION["condition_stats"]}) r JOIN ({_ASSOCIATION["condition_stats"].replace(baskets_sql(), baskets_sql(_GROUPED))}) n ON n.condition = r.condition""",
    "normalisation_impact": f"""WITH x AS ({_LIMITED} {_RANKED}), y AS ({_LIMITED_GROUPED} {_RANKED})
SELECT ({_LIMITED} SELECT count(*) FROM f) AS items_before, (SELECT count(*) FROM x) AS pairs_before, ({_LIMITED_GROUPED} SELECT count(*) FROM f) AS items_after, (SELECT count(*) FROM y) AS pairs_after,
  {_jaccard("rs")} AS jaccard_support, {_jaccard("rl")} AS jaccard_lift""",
    "rank_drops": f"""{_PAIR_AB}, {_rank_sql('ra', 'ba')}, {_rank_sql('rb', 'bl')}
SELECT pair_key, x.rank, coalesce(y.rank, 999)::INT AS after_rank, (coalesce(y.rank, 999) - x.rank)::INT AS rank_drop FROM ra x LEFT JOIN (SELECT pair_key, rank FROM rb WHERE rank <= 20) y USING (pair_key) WHERE x.rank <= 20 ORDER BY rank_drop DESC, after_rank DESC, x.rank LIMIT 5""",
    "review_candidates": f"""WITH q AS ({_ASSOCIATION["ranking_v2"]}), z AS (SELECT item_a, item_b, rank_overall, rank_support, rank_lift, rank_support_lift,
  concat_ws('|', CASE WHEN rank_lift <= 20 THEN 'lift' END, CASE WHEN rank_overall <= 20 THEN 'overall' END, CASE WHEN rank_support <= 20 THEN 'support' END, CASE WHEN rank_support_lift <= 20 THEN 'support_lift' END) AS ranking_source FROM q)
SELECT * FROM z WHERE ranking_source <> ''""",
    "tier_agreement": f"""{_NORM}, {_TIER}, {_THREES}, z AS (SELECT pair_key, tier AS scope FROM tier WHERE tier <> 'Excluded' UNION ALL SELECT pair_key, 'All' FROM tier WHERE tier <> 'Excluded')
SELECT scope, count(*) AS candidates, count(three.pair_key) AS common, count(three.pair_key) / count(*) AS common_rate, coalesce(array_to_string(list_sort(list(three.pair_key) FILTER (three.pair_key IS NOT NULL)), ' | '), '') AS common_keys FROM z LEFT JOIN three USING (pair_key) GROUP BY 1""",
    "reference_statistics": f"""{_EXT}, {_THREES}, z AS (SELECT three.pair_key IS NOT NULL AS t, r.pair_key IS NOT NULL AS o, rank FROM three FULL JOIN r ON r.pair_key = three.pair_key)
SELECT count(*) FILTER (t) AS reference_pairs, count(*) FILTER (o) AS ranking_pairs, count(*) FILTER (t AND o) AS common_pairs, count(*) FILTER (t AND NOT o) AS reference_only, count(*) FILTER (o AND NOT t) AS ranking_only,
  {", ".join(f"count(*) FILTER (t AND rank <= {k}) AS top{k}_common" for k in KS)} FROM z""",
    "sensitivity_changes": _changes_sql(),
    "grid_stability": f"""{_grid_sql().rsplit(chr(10) + "SELECT setting", 1)[0]}, base AS (SELECT item_a, item_b, rk AS base FROM r WHERE setting = '{BASE_GRID}'),
y2 AS (SELECT r.setting, eligible, rk, base FROM r LEFT JOIN base USING (item_a, item_b)),
z2 AS (SELECT *, row_number() OVER (PARTITION BY setting, base IS NOT NULL ORDER BY rk) - row_number() OVER (PARTITION BY setting, base IS NOT NULL ORDER BY base) AS d FROM y2)
SELECT setting, count(*) AS retained, count(*) FILTER (eligible) AS tier1, count(*) FILTER (NOT eligible) AS tier2, count(base) AS common,
  1 - 6 * sum((d * d)::DOUBLE) FILTER (base IS NOT NULL) / nullif(count(base) * count(base) * count(base) - count(base), 0) AS spearman, count(*) FILTER (rk <= 20 AND base <= 20) AS common_topk,
  count(*) FILTER (rk <= 20 AND base <= 20) / nullif(count(*) FILTER (rk <= 20) + (SELECT count(*) FROM base WHERE base <= 20) - count(*) FILTER (rk <= 20 AND base <= 20), 0) AS jaccard_topk FROM z2 GROUP BY 1""",
    "tier_differences": f"""{_NORM}, {_TIER}, u AS ({" UNION ALL ".join(f"SELECT tier, '{f}' AS feature, {f}::DOUBLE AS v FROM tier" for f in FEATURES)}), d AS (SELECT tier, feature, avg(v) AS mean, quantile_cont(v, 0.5) AS median FROM u GROUP BY 1, 2)
SELECT x.feature, x.mean - y.mean AS mean_difference, x.median - y.median AS median_difference FROM d x JOIN d y ON y.feature = x.feature AND x.tier = 'Tier1' AND y.tier = 'Tier2'""",
    "ranking_metadata": f"""{_NORM}, q AS (SELECT *, {_score(s.WEIGHTS_V2["A"])} AS score FROM v2), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, {_ORDER}) AS rank_overall FROM q)
{" UNION ALL ".join(f"SELECT '{m}' AS metric, ({x})::DOUBLE AS value FROM r" for m, x in _META.items())}""",
    "label_metrics_by_scope": f"""{_SCOPES}, u AS (SELECT scope, 'quality' AS label, quality AS v FROM z UNION ALL SELECT scope, 'toxic', toxic FROM z)
SELECT scope, label, count(*) AS n, count(v) AS labelled, count(*) FILTER (v = 1) / nullif(count(v), 0) AS rate FROM u GROUP BY 1, 2""",
    "feature_relation": f"""{_SCOPES}, q AS (SELECT scope, (quality = 1)::INT AS yes, (length(text) - length(replace(text, '!', '')))::DOUBLE AS v FROM z JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY scope ORDER BY v) + (count(*) OVER (PARTITION BY scope, v) - 1) / 2 AS rv, rank() OVER (PARTITION BY scope ORDER BY yes) + (count(*) OVER (PARTITION BY scope, yes) - 1) / 2 AS ry FROM q)
SELECT scope, 'feature_mean' AS metric, CASE yes WHEN 1 THEN 'manual_yes' ELSE 'manual_no' END AS label, count(*) AS n, avg(v) AS value FROM q GROUP BY scope, yes
UNION ALL SELECT scope, 'feature_median', CASE yes WHEN 1 THEN 'manual_yes' ELSE 'manual_no' END, count(*), quantile_cont(v, 0.5) FROM q GROUP BY scope, yes
UNION ALL SELECT scope, 'spearman', 'manual_binary', count(*), CASE WHEN min(rv) < max(rv) AND min(ry) < max(ry) THEN corr(rv, ry) END FROM r GROUP BY scope
{" ".join(f"UNION ALL SELECT scope, 'crosstab', '{('manual_no', 'manual_yes')[y]}|{('auto_zero', 'auto_positive')[f]}', count(*), count(*) FILTER (yes = {y} AND (v > 0)::INT = {f})::DOUBLE FROM q GROUP BY scope" for y, f in _CELLS)}""",
    "label_source": f"""{_LABELLED}, h AS (SELECT count(quality) FILTER (n_chars > 1000) > 0 AS base, count(quality) > 0 AS reviewer1 FROM x)
SELECT choice, CASE WHEN choice = 'reviewer_first' AND reviewer1 THEN 'reviewer1' WHEN base THEN 'base' WHEN reviewer1 THEN 'reviewer1' END AS label_source FROM h, (VALUES ('base_first'), ('reviewer_first'), ('second_first')) AS t(choice)""",
}
