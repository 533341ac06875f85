"""Queries on baskets: orders and the brands or types in them, user days and event types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import association as a
from ..operators import scoring as s
from ..scratch import written
from ..session import table


def order_baskets(spark: SparkSession, sf: str, item: str = "p_brand", *carried) -> DataFrame:
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", item)
    return a.baskets(lines.join(part, lines["l_partkey"] == part["p_partkey"]), "l_orderkey", item, *carried)


def flagged_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Order baskets; flag: the order is urgent."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("basket_id"), (F.col("o_orderpriority") == "1-URGENT").alias("flag"))
    return order_baskets(spark, sf).join(orders, "basket_id")


def limited(spark: SparkSession, sf: str) -> DataFrame:
    return a.in_condition(order_baskets(spark, sf), a.Condition("limited_2_5", 2, 5))


def pair_stats_all(spark, sf):
    return a.pair_statistics(a.in_condition(order_baskets(spark, sf), a.Condition("all_multi")))


def pair_stats_limited(spark, sf):
    return a.pair_statistics(limited(spark, sf))


def pair_stats_event(spark, sf):
    days = table(spark, sf, "events").withColumn("day", F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    return a.pair_statistics(a.baskets(days, "day", "event_type"))


def item_frequency(spark, sf):
    return a.item_counts(limited(spark, sf))


def pair_counts_docs(spark, sf):
    return a.pairs_with_baskets(a.in_condition(order_baskets(spark, sf, "p_type"), a.Condition("c", 2, 5)))


def pair_first_docs(spark, sf):
    return a.pairs_with_first_baskets(a.in_condition(order_baskets(spark, sf, "p_type"), a.Condition("c", 2, 5)))


def _lift_query(q: float):
    def query(spark, sf):
        x = a.at_least_quantile(pair_stats_limited(spark, sf), "pair_count", q)
        return a.stable_rank(x, "lift", "rank").select(*a.PAIR, "pair_count", "lift", "rank")

    return query


def support_topk(spark, sf):
    return a.top_pairs(pair_stats_limited(spark, sf), "support", 20)


def lift_topk(spark, sf):
    return a.top_pairs(pair_stats_limited(spark, sf), "lift", 20)


def hidden_gems(spark, sf):
    x = pair_stats_limited(spark, sf)
    ends = x.agg(F.percentile("pair_count", 0.1).alias("lo"), F.percentile("pair_count", 0.4).alias("hi"))
    x = x.crossJoin(F.broadcast(ends)).filter(F.col("pair_count").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    expected = F.col("frequency_a") * F.col("frequency_b") / F.col("n_baskets")
    return a.top_pairs(x, "lift", 15).select(*a.PAIR, "pair_count", "lift", "rank", expected.alias("expected_count"))


def condition_stats(spark, sf):
    return a.condition_statistics(flagged_baskets(spark, sf))


def condition_topk(spark, sf):
    x = a.pair_statistics(a.condition_table(flagged_baskets(spark, sf)).select("condition", "basket_id", "items"), "condition")
    return a.top_pairs(x, "support", 20, "condition").select("condition", *a.PAIR, "pair_count", "lift", "rank")


def _sets(k: int):
    def query(spark, sf):
        x = a.itemsets(order_baskets(spark, sf, "p_type"), k, 2)
        return x.select(F.array_join("items", "|").alias("items"), "n")

    return query


def multiway_lift(spark, sf):
    b = order_baskets(spark, sf, "p_type")
    x = a.multi_lift(a.itemsets(b, 3, 2), a.item_counts(b), b.agg(F.count("*").alias("n_baskets")))
    return x.select(F.array_join("items", "|").alias("items"), "n", "lift")


def basket_size_hist(spark, sf):
    return order_baskets(spark, sf).groupBy(F.size("items").alias("n_items")).agg(F.count("*").alias("n_baskets"))


def min_count_chooser(spark, sf):
    x = pair_stats_limited(spark, sf)
    cuts = spark.createDataFrame([(1,), (2,), (3,)], "min_count int")
    return a.choose_min_count(x.crossJoin(F.broadcast(cuts)).filter("pair_count >= min_count"))


EVIDENCE = {
    "same": "min(l_linestatus) = max(l_linestatus)",
    "positive": "bool_or(l_discount >= 0.09D)",
    "negative": "bool_or(l_returnflag = 'R')",
    "role": "bool_or(l_tax >= 0.07D)",
}


def pair_features(spark, sf):
    """Pair statistics with centrality (weighted degree over the largest) and evidence: baskets of one line status are same-context ones."""
    b = order_baskets(spark, sf, "p_brand", *[F.expr(v).alias(k) for k, v in EVIDENCE.items()])
    b = a.in_condition(b, a.Condition("limited_2_5", 2, 5))
    counts = {"evidence": F.col("same")} | {k: F.col("same") & F.col(k) for k in ("positive", "negative", "role")} | {f"doc_{k}": F.col(k) for k in ("positive", "negative", "role")}
    pairs = written(a.exploded_pairs(b, *EVIDENCE).groupBy(*a.PAIR).agg(F.count("*").alias("pair_count"), *[F.count_if(v).alias(k) for k, v in counts.items()]), "pairs")
    items = written(a.items_and_total(b), "items")  # two passes over the lines in all; what follows reads counted pairs alone
    stats = a.statistics_of(pairs.select(*a.PAIR, "pair_count"), items)
    evidence = pairs.drop("pair_count")
    degree = stats.select(F.col("item_a").alias("item"), "pair_count").unionByName(stats.select(F.col("item_b").alias("item"), "pair_count")).groupBy("item").agg(F.sum("pair_count").alias("w"))
    degree = degree.crossJoin(F.broadcast(degree.agg(F.max("w").alias("top")))).select("item", (F.col("w") / F.col("top")).alias("c"))
    x = stats.join(evidence, [*a.PAIR])
    for side in a.PAIR:
        x = x.join(degree.withColumnsRenamed({"item": side, "c": f"c_{side}"}), side)
    x = x.withColumns({"centrality_mean": (F.col("c_item_a") + F.col("c_item_b")) / 2, "centrality_max": F.greatest("c_item_a", "c_item_b"), "centrality_geometric": F.sqrt(F.col("c_item_a") * F.col("c_item_b"))})
    x = x.withColumn("parent_child_pair", F.right("item_a", F.lit(1)) == F.right("item_b", F.lit(1))).drop("c_item_a", "c_item_b")
    return written(x, "pair_features")


#: Gates for the test tables, where every pair occurs often.
GATE = {"min_pairs": 100, "min_evidence": 2}


def normalised_features(spark, sf):
    return s.normalised_v2(pair_features(spark, sf), **GATE).select(*a.PAIR, "n_support", "n_lift", "n_centrality", "n_positive", "n_role", "n_negative", "confidence", "adjusted_lift", "centrality_max", "centrality_geometric")


def ranking_v1(spark, sf):
    return s.ranking_v1(pair_features(spark, sf)).select(*a.PAIR, "score", "rank_overall", "rank_support", "rank_lift", "rank_support_lift")


def ranking_v2(spark, sf):
    return s.ranking_v2(pair_features(spark, sf), **GATE).select(*a.PAIR, "score", "rank_overall", "rank_support", "rank_lift", "rank_support_lift")


def tier_split(spark, sf):
    x = s.tiers(s.ranking_v2(pair_features(spark, sf), **GATE), tier1_pairs=100, tier1_evidence=2, tier2_pairs=60)
    return s.ranked(x, "score", "tier_rank", "tier").select(*a.PAIR, "tier", "exclusion_reason", "tier_rank")


def sensitivity_3(spark, sf):
    x = s.scored_by_setting(s.normalised_v2(pair_features(spark, sf), **GATE), s.WEIGHTS_V2)
    return s.against_baseline(x, 20, "A")


def sensitivity_21(spark, sf):
    x = s.scored_by_setting(s.normalised_v2(pair_features(spark, sf), **GATE), s.weight_settings())
    return s.against_baseline(x, 10)


def threshold_grid_36(spark, sf):
    x = s.thresholds(pair_features(spark, sf), s.threshold_grid(spark, (60, 100, 140, 180), (1, 2, 3)))
    return x.groupBy("setting").agg(F.count("*").alias("retained"), F.count_if(F.col("tier") == "Tier1").alias("tier1"), F.sum(F.when(F.col("setting_rank") <= 10, F.col("pair_count"))).alias("top10_pairs"))


def tier_distribution(spark, sf):
    x = s.tiers(s.normalised_v2(pair_features(spark, sf), **GATE), 100, 2, 60)
    return s.distributions(x, "tier", ["pair_count", "support", "lift", "centrality_mean", "evidence", "n_positive"])


QUERIES = {
    f.__name__: f
    for f in (pair_stats_all, pair_stats_limited, pair_stats_event, item_frequency, pair_counts_docs, pair_first_docs, support_topk, lift_topk, hidden_gems, condition_stats, condition_topk, multiway_lift, basket_size_hist, min_count_chooser, normalised_features, ranking_v1, ranking_v2, tier_split, sensitivity_3, sensitivity_21, threshold_grid_36, tier_distribution)
} | {"lift_min_q25": _lift_query(0.25), "lift_min_q50": _lift_query(0.5), "lift_min_q75": _lift_query(0.75), "itemsets_k3": _sets(3), "itemsets_k4": _sets(4), "itemsets_k5": _sets(5)}


def baskets_sql(item: str = "p_brand") -> str:
    return f"SELECT l_orderkey AS basket_id, list_sort(list(DISTINCT {item})) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


def stats_sql(source: str) -> str:
    """CTEs e, n, f, p, stats over a CTE `source` of baskets."""
    return f"""e AS (SELECT basket_id, unnest(items) AS item FROM {source}), n AS (SELECT count(*) AS n FROM {source}),
f AS (SELECT item, count(*) AS f FROM e GROUP BY item),
p AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS pair_count FROM e x JOIN e y ON x.basket_id = y.basket_id AND x.item < y.item GROUP BY ALL),
stats AS (SELECT item_a, item_b, item_a || '||' || item_b AS pair_key, pair_count, fa.f AS frequency_a, fb.f AS frequency_b, n AS n_baskets,
  pair_count / n AS support, pair_count * n / (fa.f * fb.f) AS lift FROM p JOIN f fa ON fa.item = item_a JOIN f fb ON fb.item = item_b, n)"""


_LIMITED = f"WITH b AS ({baskets_sql()}), l AS (SELECT * FROM b WHERE len(items) BETWEEN 2 AND 5), {stats_sql('l')}"
_ORDER = "pair_count DESC, lift DESC, item_a, item_b"
_FLAGGED = f"""WITH b AS (SELECT b.*, o_orderpriority = '1-URGENT' AS flag FROM ({baskets_sql()}) b JOIN orders ON o_orderkey = basket_id),
c AS (SELECT 'all_multi' AS condition, * FROM b WHERE len(items) >= 2 UNION ALL SELECT 'limited_2_5', * FROM b WHERE len(items) BETWEEN 2 AND 5
  UNION ALL SELECT 'flagged_2_5', * FROM b WHERE len(items) BETWEEN 2 AND 5 AND flag),
e AS (SELECT condition, basket_id, unnest(items) AS item FROM c),
p AS (SELECT x.condition, x.item AS item_a, y.item AS item_b, count(*) AS pair_count FROM e x JOIN e y ON x.condition = y.condition AND x.basket_id = y.basket_id AND x.item < y.item GROUP BY ALL)"""


def _sets_sql(k: int) -> str:
    joins = " ".join(f"JOIN e e{i} ON e{i}.basket_id = e1.basket_id AND e{i}.item > e{i - 1}.item" for i in range(2, k + 1))
    name = " || '|' || ".join(f"e{i}.item" for i in range(1, k + 1))
    return f"WITH b AS ({baskets_sql('p_type')}), e AS (SELECT basket_id, unnest(items) AS item FROM b) SELECT {name} AS items, count(*) AS n FROM e e1 {joins} GROUP BY 1 HAVING count(*) >= 2"


_FEATURES = f"""WITH b AS (SELECT l_orderkey AS basket_id, list_sort(list(DISTINCT p_brand)) AS items, count(DISTINCT l_linestatus) = 1 AS same,
  bool_or(l_discount >= 0.09) AS positive, bool_or(l_returnflag = 'R') AS negative, bool_or(l_tax >= 0.07) AS role FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
l AS (SELECT * FROM b WHERE len(items) BETWEEN 2 AND 5), {stats_sql('l')},
ev AS (SELECT x.item AS item_a, y.item AS item_b, count(*) FILTER (same) AS evidence, count(*) FILTER (same AND positive) AS positive, count(*) FILTER (same AND negative) AS negative,
  count(*) FILTER (same AND role) AS role, count(*) FILTER (positive) AS doc_positive, count(*) FILTER (negative) AS doc_negative, count(*) FILTER (role) AS doc_role
  FROM e x JOIN e y ON x.basket_id = y.basket_id AND x.item < y.item JOIN l ON l.basket_id = x.basket_id GROUP BY ALL),
w AS (SELECT item, sum(pair_count) AS w FROM (SELECT item_a AS item, pair_count FROM p UNION ALL SELECT item_b, pair_count FROM p) GROUP BY item),
c AS (SELECT item, w / (SELECT max(w) FROM w) AS c FROM w),
feat AS (SELECT stats.*, ev.* EXCLUDE (item_a, item_b), (ca.c + cb.c) / 2 AS centrality_mean, greatest(ca.c, cb.c) AS centrality_max, sqrt(ca.c * cb.c) AS centrality_geometric,
  right(item_a, 1) = right(item_b, 1) AS parent_child_pair FROM stats JOIN ev USING (item_a, item_b) JOIN c ca ON ca.item = item_a JOIN c cb ON cb.item = item_b)"""


def _mm(x: str, over: str = "") -> str:
    lo, hi = f"min({x}) OVER ({over})", f"max({x}) OVER ({over})"
    return f"CASE WHEN abs({hi} - {lo}) <= 1e-9 * greatest(abs({hi}), abs({lo})) THEN 0.0::DOUBLE ELSE ({x} - {lo}) / ({hi} - {lo}) END"


_KINDS = ("positive", "role", "negative")
_NORM = f"""{_FEATURES},
g AS (SELECT quantile_cont(lift, 0.99) AS p99, {", ".join(f"sum({k}) / sum(evidence) AS g_{k}" for k in _KINDS)} FROM feat),
raw AS (SELECT feat.*, ln(1 + support) AS s_support, least(lift, p99) AS s_lift,
  {", ".join(f"CASE WHEN pair_count >= 100 AND evidence >= 2 THEN ({k} + 3.0::DOUBLE * g_{k}) / (evidence + 3.0::DOUBLE) ELSE 0 END AS s_{k}" for k in _KINDS)} FROM feat, g),
norm AS (SELECT *, {_mm("s_support")} AS n_support, {_mm("s_lift")} AS n_lift, {_mm("centrality_mean")} AS n_centrality, {", ".join(f"{_mm(f's_{k}')} AS n_{k}" for k in _KINDS)},
  least(1.0::DOUBLE, pair_count / 5) AS confidence FROM raw),
v2 AS (SELECT *, n_lift * confidence AS adjusted_lift FROM norm)"""


def _score(w: tuple, features=s.FEATURES_V2) -> str:
    return " + ".join(f"{x}::DOUBLE * {f}" for x, f in zip(w, features, strict=True))


def _settings(settings: dict[str, tuple], base: str, k: int) -> str:
    union = " UNION ALL ".join(f"SELECT '{n}' AS setting, item_a, item_b, pair_count, lift, {_score(w)} AS sc FROM v2" for n, w in settings.items())
    return f"""{_NORM}, sc AS ({union}), r AS (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY sc DESC, {_ORDER}) AS rk FROM sc),
y AS (SELECT r.setting, r.rk, o.rk AS base, abs(r.rk - o.rk) AS d FROM r JOIN r o ON o.setting = '{base}' AND o.item_a = r.item_a AND o.item_b = r.item_b)
SELECT setting, count(*) FILTER (rk <= {k} AND base <= {k}) AS common_topk, count(*) FILTER (rk <= {k} AND base > {k}) AS new_topk,
  count(*) FILTER (rk <= {k} AND base <= {k}) / count(*) FILTER (rk <= {k} OR base <= {k}) AS jaccard_topk, max(d) AS max_shift, quantile_cont(d, 0.5)::DOUBLE AS median_shift,
  1 - 6 * sum((d * d)::DOUBLE) / (count(*) * count(*) * count(*) - count(*)) AS spearman FROM y GROUP BY setting"""


_RANKS = "row_number() OVER (ORDER BY support DESC, pair_count DESC, lift DESC, item_a, item_b)::INT AS rank_support, row_number() OVER (ORDER BY lift DESC, pair_count DESC, item_a, item_b)::INT AS rank_lift"
_TIER = """t AS (SELECT *, CASE WHEN parent_child_pair THEN 'parent_child_pair' WHEN evidence = 0 THEN 'no_same_context' END AS why FROM v2),
tier AS (SELECT * EXCLUDE (why), CASE WHEN why IS NULL AND pair_count >= 100 AND evidence >= 2 THEN 'Tier1' WHEN why IS NULL AND pair_count >= 60 THEN 'Tier2' ELSE 'Excluded' END AS tier,
  CASE WHEN why IS NULL AND pair_count >= 60 THEN NULL ELSE coalesce(why, 'other') END AS exclusion_reason FROM t)"""


def _grid_sql() -> str:
    rows = ", ".join(f"('{m}|{p}|{d}', '{m}', {p}, {d})" for m in s.MODES for p in (60, 100, 140, 180) for d in (1, 2, 3))
    by_doc = f"(mode = '{s.MODES[2]}' OR (mode = '{s.MODES[1]}' AND evidence < 1))"
    return f"""{_FEATURES}, grid(setting, mode, mp, me) AS (VALUES {rows}),
g AS (SELECT quantile_cont(lift, 0.99) AS p99, {", ".join(f"sum({k}) / sum(evidence) AS g_{k}, sum(doc_{k}) / sum(pair_count) AS h_{k}" for k in _KINDS)} FROM feat),
x AS (SELECT *, ln(1 + support) AS s_support, least(lift, p99) AS s_lift, mode = '{s.MODES[2]}' OR evidence >= 1 OR (mode = '{s.MODES[1]}' AND doc_positive + doc_negative + doc_role > 0) AS candidate FROM feat, g, grid),
y AS (SELECT *, candidate AND pair_count >= mp AND CASE WHEN {by_doc} THEN pair_count ELSE evidence END >= me AS eligible FROM x),
z AS (SELECT *, {", ".join(f"CASE WHEN NOT eligible THEN 0 WHEN {by_doc} THEN (doc_{k} + 3.0::DOUBLE * h_{k}) / (pair_count + 3.0::DOUBLE) ELSE ({k} + 3.0::DOUBLE * g_{k}) / (evidence + 3.0::DOUBLE) END AS s_{k}" for k in _KINDS)} FROM y),
m AS (SELECT *, {_mm("s_support", "PARTITION BY setting")} AS n_support, {_mm("s_lift", "PARTITION BY setting")} * least(1.0::DOUBLE, pair_count / 5) AS adjusted_lift, {_mm("centrality_mean", "PARTITION BY setting")} AS n_centrality, {", ".join(f"{_mm(f's_{k}', 'PARTITION BY setting')} AS n_{k}" for k in _KINDS)} FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY {_score(s.WEIGHTS_V2["A"])} DESC, {_ORDER}) AS rk FROM m WHERE candidate)
SELECT setting, count(*) AS retained, count(*) FILTER (eligible) AS tier1, sum(pair_count) FILTER (rk <= 10)::BIGINT AS top10_pairs FROM r GROUP BY setting"""


_DIST = ["pair_count", "support", "lift", "centrality_mean", "evidence", "n_positive"]
ORACLES = {
    "pair_stats_all": f"WITH b AS ({baskets_sql()}), l AS (SELECT * FROM b WHERE len(items) >= 2), {stats_sql('l')} SELECT * FROM stats",
    "pair_stats_limited": f"{_LIMITED} SELECT * FROM stats",
    "pair_stats_event": f"WITH l AS (SELECT user_id || '|' || ts::DATE AS basket_id, list_sort(list(DISTINCT event_type)) AS items FROM events GROUP BY 1), {stats_sql('l')} SELECT * FROM stats",
    "item_frequency": f"{_LIMITED} SELECT item, f AS frequency FROM f",
    "pair_counts_docs": f"""WITH b AS ({baskets_sql("p_type")}), e AS (SELECT basket_id, unnest(items) AS item FROM b WHERE len(items) BETWEEN 2 AND 5)
SELECT x.item AS item_a, y.item AS item_b, count(*) OVER (PARTITION BY x.item, y.item) AS pair_count, x.basket_id FROM e x JOIN e y ON x.basket_id = y.basket_id AND x.item < y.item""",
    "pair_first_docs": f"""WITH b AS ({baskets_sql("p_type")}), e AS (SELECT basket_id, unnest(items) AS item FROM b WHERE len(items) BETWEEN 2 AND 5)
SELECT x.item AS item_a, y.item AS item_b, count(*) AS pair_count, array_to_string(list_sort(list(x.basket_id))[1:5], '|') AS basket_ids FROM e x JOIN e y ON x.basket_id = y.basket_id AND x.item < y.item GROUP BY 1, 2""",
    "support_topk": f"{_LIMITED} SELECT *, row_number() OVER (ORDER BY support DESC, {_ORDER})::INT AS rank FROM stats QUALIFY rank <= 20",
    "lift_topk": f"{_LIMITED} SELECT *, row_number() OVER (ORDER BY lift DESC, pair_count DESC, item_a, item_b)::INT AS rank FROM stats QUALIFY rank <= 20",
    "hidden_gems": f"""{_LIMITED}, q AS (SELECT quantile_cont(pair_count, 0.1) AS lo, quantile_cont(pair_count, 0.4) AS hi FROM stats)
SELECT item_a, item_b, pair_count, lift, row_number() OVER (ORDER BY lift DESC, pair_count DESC, item_a, item_b)::INT AS rank, frequency_a * frequency_b / n_baskets AS expected_count FROM stats, q WHERE pair_count BETWEEN lo AND hi QUALIFY rank <= 15""",
    "condition_stats": f"""{_FLAGGED}, s AS (SELECT condition, count(*) AS n_baskets, avg(len(items)) AS mean_items, quantile_cont(len(items), 0.5)::DOUBLE AS median_items, max(len(items)) AS max_items FROM c GROUP BY 1),
n AS (SELECT condition, count(DISTINCT item) AS nodes FROM e GROUP BY 1), d AS (SELECT condition, count(*) AS edges FROM p GROUP BY 1)
SELECT *, 2 * edges / (nodes * (nodes - 1)) AS density FROM s JOIN n USING (condition) JOIN d USING (condition)""",
    "condition_topk": f"""{_FLAGGED}, f AS (SELECT condition, item, count(*) AS f FROM e GROUP BY ALL), n AS (SELECT condition, count(*) AS n FROM c GROUP BY 1),
x AS (SELECT p.*, pair_count * n / (fa.f * fb.f) AS lift FROM p JOIN n USING (condition) JOIN f fa ON fa.condition = p.condition AND fa.item = item_a JOIN f fb ON fb.condition = p.condition AND fb.item = item_b)
SELECT *, row_number() OVER (PARTITION BY condition ORDER BY {_ORDER})::INT AS rank FROM x QUALIFY rank <= 20""",
    "multiway_lift": f"""WITH b AS ({baskets_sql("p_type")}), e AS (SELECT basket_id, unnest(items) AS item FROM b), f AS (SELECT item, count(*) AS f FROM e GROUP BY 1), n AS (SELECT count(*) AS n FROM b),
s AS (SELECT a.item AS x, b.item AS y, c.item AS z, count(*) AS k FROM e a JOIN e b ON a.basket_id = b.basket_id AND b.item > a.item JOIN e c ON c.basket_id = a.basket_id AND c.item > b.item GROUP BY ALL HAVING count(*) >= 2)
SELECT x || '|' || y || '|' || z AS items, k AS n, k::DOUBLE * n * n / (fx.f * fy.f * fz.f) AS lift FROM s JOIN f fx ON fx.item = x JOIN f fy ON fy.item = y JOIN f fz ON fz.item = z, n""",
    "basket_size_hist": f"WITH b AS ({baskets_sql()}) SELECT len(items)::INT AS n_items, count(*) AS n_baskets FROM b GROUP BY 1",
    "min_count_chooser": f"""{_LIMITED}, g AS (SELECT m::INT AS min_count, quantile_cont(pair_count, 0.5)::DOUBLE AS median_count, avg((pair_count = 1)::INT::DOUBLE) AS single_ratio FROM stats, generate_series(1, 3) AS t(m) WHERE pair_count >= m GROUP BY 1)
SELECT *, CASE WHEN single_ratio = 0 THEN 'no single-count pair' ELSE 'best median' END AS reason FROM g
ORDER BY single_ratio = 0 DESC, CASE WHEN single_ratio = 0 THEN min_count END, median_count DESC, single_ratio, min_count DESC LIMIT 1""",
    "normalised_features": f"{_NORM} SELECT item_a, item_b, n_support, n_lift, n_centrality, n_positive, n_role, n_negative, confidence, adjusted_lift, centrality_max, centrality_geometric FROM v2",
    "ranking_v2": f"""{_NORM}, r AS (SELECT *, {_score(s.WEIGHTS_V2["A"])} AS score, 0.5::DOUBLE * n_support + 0.5::DOUBLE * adjusted_lift AS sl FROM v2)
SELECT item_a, item_b, score, row_number() OVER (ORDER BY score DESC, {_ORDER})::INT AS rank_overall, {_RANKS}, row_number() OVER (ORDER BY sl DESC, {_ORDER})::INT AS rank_support_lift FROM r""",
    "ranking_v1": f"""{_FEATURES}, g AS (SELECT quantile_cont(lift, 0.99) AS p99 FROM feat), raw AS (SELECT *, ln(1 + support) AS s_support, least(lift, p99) AS s_lift, positive / pair_count AS s_positive, role / pair_count AS s_role FROM feat, g),
norm AS (SELECT *, {_mm("s_support")} AS n_support, {_mm("s_lift")} AS n_lift, {_mm("centrality_mean")} AS n_centrality, {_mm("s_positive")} AS n_positive, {_mm("s_role")} AS n_role FROM raw),
r AS (SELECT *, {_score(s.WEIGHTS_V1["A"], s.FEATURES_V1)} AS score, 0.5::DOUBLE * n_support + 0.5::DOUBLE * n_lift AS sl FROM norm)
SELECT item_a, item_b, score, row_number() OVER (ORDER BY score DESC, {_ORDER})::INT AS rank_overall, {_RANKS}, row_number() OVER (ORDER BY sl DESC, {_ORDER})::INT AS rank_support_lift FROM r""",
    "tier_split": f"""{_NORM}, {_TIER} SELECT item_a, item_b, tier, exclusion_reason, row_number() OVER (PARTITION BY tier ORDER BY {_score(s.WEIGHTS_V2["A"])} DESC, {_ORDER})::INT AS tier_rank FROM tier""",
    "sensitivity_3": _settings(s.WEIGHTS_V2, "A", 20),
    "sensitivity_21": _settings(s.weight_settings(), "baseline", 10),
    "threshold_grid_36": _grid_sql(),
    "tier_distribution": f"""{_NORM}, {_TIER}, u AS ({" UNION ALL ".join(f"SELECT tier, '{f}' AS feature, {f}::DOUBLE AS v FROM tier" for f in _DIST)})
SELECT tier, feature, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, min(v) AS low, max(v) AS high FROM u GROUP BY 1, 2""",
    **{
        f"lift_min_q{round(q * 100)}": f"""{_LIMITED}, q AS (SELECT quantile_cont(pair_count, {q}) AS cut FROM stats)
SELECT item_a, item_b, pair_count, lift, row_number() OVER (ORDER BY lift DESC, pair_count DESC, item_a, item_b)::INT AS rank FROM stats, q WHERE pair_count >= cut"""
        for q in (0.25, 0.5, 0.75)
    },
    **{f"itemsets_k{k}": _sets_sql(k) for k in (3, 4, 5)},
}
