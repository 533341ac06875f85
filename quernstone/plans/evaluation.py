"""Queries that compare rankings, raters and graphs of brand pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import association as a
from ..operators import evaluation as ev
from ..operators import graph as g
from ..scratch import written
from ..session import table
from .association import _LIMITED, _ORDER, baskets_sql, flagged_baskets, order_baskets, pair_stats_limited, stats_sql

KS = (10, 20, 50)


def _ks(spark):
    return spark.createDataFrame([(k,) for k in KS], "k int")


def _by_condition(spark, sf, name):
    c = next(c for c in a.CONDITIONS if c.name == name)
    x = a.pair_statistics(a.in_condition(flagged_baskets(spark, sf), c))
    return written(a.stable_rank(x, "support", "rank").select("pair_key", "pair_count", "lift", "rank"), "ranking")


def _between(spark, sf, first, last):
    o = table(spark, sf, "orders").filter(F.year("o_orderdate").between(first, last)).select(F.col("o_orderkey").alias("basket_id"))
    x = order_baskets(spark, sf).join(o, "basket_id", "left_semi")
    return written(a.stable_rank(a.pair_statistics(a.in_condition(x, a.Condition("l", 2, 5))), "support", "rank").select("pair_key", "pair_count", "lift", "rank"), "ranking")


def ranking_compare_ab(spark, sf):
    return ev.compare_topk(_by_condition(spark, sf, "all_multi"), _by_condition(spark, sf, "limited_2_5"), "pair_key", 10)


def before_after(spark, sf):
    return ev.before_after(_between(spark, sf, 1995, 1997), _between(spark, sf, 1998, 2001), "pair_key", 20)


def _two(spark, sf):
    x, y = _between(spark, sf, 1995, 1997), _between(spark, sf, 1998, 2001)
    return x.select("pair_key", F.col("pair_count").alias("x")).join(y.select("pair_key", F.col("pair_count").alias("y")), "pair_key")


def rank_corr_spearman(spark, sf):
    return ev.spearman(_two(spark, sf), "x", "y")


def rank_corr_kendall(spark, sf):
    return ev.kendall(_two(spark, sf), "pair_key", "x", "y")


def _external(spark, sf):
    """Pairs in at least two orders of 9 or more brands: the reference set. Brand #1x items of it are foreign to the ranking's vocabulary."""
    x = a.in_condition(order_baskets(spark, sf), a.Condition("large", 9))
    return written(a.pair_statistics(x).filter("pair_count >= 2").select(*a.PAIR, "pair_key"), "external")


def _ranking(spark, sf):
    x = a.stable_rank(pair_stats_limited(spark, sf), "lift", "rank").select(*a.PAIR, "pair_key", "pair_count", "rank")
    return written(x.filter(F.col("pair_count") >= 10).filter("rank <= 200"), "ranking")


def agreement_at_k(spark, sf):
    return ev.at_k(_ranking(spark, sf), _external(spark, sf), "pair_key", _ks(spark))


def external_common(spark, sf):
    return _ranking(spark, sf).join(_external(spark, sf).select("pair_key"), "pair_key").select("pair_key", "rank")


def external_only(spark, sf):
    stats = pair_stats_limited(spark, sf).select("pair_key", F.col("pair_count").alias("known_count"))
    ext = _external(spark, sf).join(stats, "pair_key", "left")
    r = _ranking(spark, sf)
    items = r.select(F.col("item_a").alias("item")).unionByName(r.select(F.col("item_b").alias("item"))).distinct()
    reasons = [(F.col("known_count") < 10, "below_min_count"), (F.col("known_count").isNotNull(), "below_cut")]
    return ev.only_in_reference(ext, r, items, "pair_key", reasons).select("pair_key", "reason")


def ranking_only(spark, sf):
    """The reference set: pairs in at least two orders of three brands. Those of larger orders hold nearly every pair."""
    ext = a.pair_statistics(a.in_condition(order_baskets(spark, sf), a.Condition("three", 3, 3))).filter("pair_count >= 20")
    return _ranking(spark, sf).join(ext, "pair_key", "left_anti").select("pair_key", "rank")


def topk_audit(spark, sf):
    return ev.topk_audit(_ranking(spark, sf), _external(spark, sf), "pair_key", _ks(spark))


def union_dedup(spark, sf):
    one = _by_condition(spark, sf, "flagged_2_5").filter("rank <= 30").select("pair_key", "rank")
    two = _by_condition(spark, sf, "limited_2_5").filter("rank <= 30").select("pair_key", "lift")
    return ev.union_keep_first([one, two], "pair_key")


def _labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars", "source").join(table(spark, sf, "labels"), "doc_id", "left")


def _top_labelled(spark, sf):
    """The longest documents with their rank: as many as the largest k, picked before any window sees them."""
    x = _labelled(spark, sf).orderBy(F.desc("n_chars"), "doc_id").limit(max(KS))
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")))


def label_rates_at_k(spark, sf):
    return ev.label_rates_at_k(_top_labelled(spark, sf), ["quality", "toxic"], _ks(spark))


def label_rates_no_blanks(spark, sf):
    return ev.label_rates_at_k(_top_labelled(spark, sf), ["quality", "toxic"], _ks(spark), blanks_count=False)


def crosstab_tertile(spark, sf):
    x = _labelled(spark, sf).filter("quality is not null").withColumn("n_chars", F.col("n_chars").cast("double"))
    return ev.with_tertile(x, "n_chars").groupBy("tertile", "quality").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"), F.percentile("n_chars", 0.5).alias("median_chars"))


def _raters(spark, sf):
    x = _labelled(spark, sf)
    q = x.select("doc_id", F.lit("quality").alias("field"), F.col("quality").alias("one"), (F.col("n_chars") > 800).cast("int").alias("two"))
    return q.unionByName(x.select("doc_id", F.lit("toxic").alias("field"), F.col("toxic").alias("one"), (F.col("n_chars") % 7 == 0).cast("int").alias("two")))


def cohen_kappa(spark, sf):
    return ev.cohen_kappa(_raters(spark, sf), "field", "one", "two")


def rater_disagreements(spark, sf):
    x = _labelled(spark, sf).withColumns({"q2": (F.col("n_chars") > 800).cast("int"), "t2": (F.col("n_chars") % 7 == 0).cast("int")})
    return ev.disagreements(x, {"quality": ("quality", "q2"), "toxic": ("toxic", "t2")}).select("doc_id", "disagreements")


def final_label(spark, sf):
    x = _labelled(spark, sf).withColumn("auto", F.when(F.col("n_chars") > 300, 1).otherwise(0))
    label, source = ev.final_label("quality", "auto", F.col("n_chars").between(200, 500))
    x = x.select("doc_id", "source", label.alias("label"), source.alias("label_source"))
    return x.groupBy("source", "label_source").agg(F.count("*").alias("n"), F.bool_or(F.col("label") == "1").alias("any_good"), F.avg((F.col("label") == "1").cast("double")).alias("good_share"))


def label_summary(spark, sf):
    cats = spark.createDataFrame([(1, "0"), (2, "1"), (3, "unclear")], "position int, label string")
    return ev.label_counts(_labelled(spark, sf).withColumn("l", F.col("quality").cast("string")), "l", cats)


def _edges(spark, sf):
    x = a.at_least_quantile(pair_stats_limited(spark, sf), "pair_count", 0.75)
    return x.select(*a.PAIR, F.col("pair_count").alias("weight"))


def degree_weighted(spark, sf):
    return g.degrees(_edges(spark, sf))


def top_neighbours(spark, sf):
    return g.top_neighbours(_edges(spark, sf))


def density_components(spark, sf):
    return g.graph_statistics(_edges(spark, sf))


def betweenness_unweighted(spark, sf):
    return g.betweenness(_edges(spark, sf), weighted=False)


def betweenness_weighted(spark, sf):
    e = _edges(spark, sf)
    return g.betweenness(e, weighted=True)


def pair_centrality(spark, sf):
    e = _edges(spark, sf)
    return g.pair_centrality(e, g.betweenness(e), "betweenness")


def communities(spark, sf):
    return g.communities(_edges(spark, sf))


def _nations(spark, sf):
    """Nations that one customer's and one supplier's order lines join: edges by number of orders."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("x"))
    s = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("y"))
    x = o.join(s, F.col("o_orderkey") == F.col("l_orderkey")).filter("x <> y")
    return x.groupBy(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).agg(F.countDistinct("o_orderkey").alias("weight"))


def edge_metrics_cross(spark, sf):
    part = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return g.cross_community(g.edge_metrics(_nations(spark, sf), part))


QUERIES = {
    f.__name__: f
    for f in (ranking_compare_ab, before_after, rank_corr_spearman, rank_corr_kendall, agreement_at_k, external_common, external_only, ranking_only, topk_audit, union_dedup, label_rates_at_k, label_rates_no_blanks, crosstab_tertile, cohen_kappa, rater_disagreements, final_label, label_summary, degree_weighted, top_neighbours, density_components, betweenness_unweighted, betweenness_weighted, pair_centrality, communities, edge_metrics_cross)
}


def _rank_sql(name: str, source: str) -> str:
    """CTEs for the ranking of baskets in CTE `source`, ending in `name`(pair_key, pair_count, lift, rank)."""
    s = stats_sql(source)
    for cte in ("e", "n", "f", "p", "stats"):
        s = s.replace(f"{cte} AS (", f"{name}_{cte} AS (", 1)
    s = s.replace("FROM e x JOIN e y", f"FROM {name}_e x JOIN {name}_e y").replace("FROM e GROUP BY item", f"FROM {name}_e GROUP BY item").replace("FROM p JOIN f fa", f"FROM {name}_p p JOIN {name}_f fa").replace("JOIN f fb ON fb.item = item_b, n)", f"JOIN {name}_f fb ON fb.item = item_b, {name}_n)")
    return f"{s}, {name} AS (SELECT pair_key, pair_count, lift, row_number() OVER (ORDER BY support DESC, {_ORDER})::INT AS rank FROM {name}_stats)"


_PAIR_AB = f"""WITH b AS (SELECT b.*, o_orderpriority = '1-URGENT' AS flag, year(o_orderdate) AS y FROM ({baskets_sql()}) b JOIN orders ON o_orderkey = basket_id),
ba AS (SELECT * FROM b WHERE len(items) >= 2), bl AS (SELECT * FROM b WHERE len(items) BETWEEN 2 AND 5), bf AS (SELECT * FROM bl WHERE flag), b1 AS (SELECT * FROM bl WHERE y BETWEEN 1995 AND 1997), b2 AS (SELECT * FROM bl WHERE y BETWEEN 1998 AND 2001), b9 AS (SELECT * FROM b WHERE len(items) >= 9)"""
_TWO = f"{_PAIR_AB}, {_rank_sql('ra', 'b1')}, {_rank_sql('rb', 'b2')}, two AS (SELECT pair_key, a.pair_count AS x, b.pair_count AS y FROM ra a JOIN rb b USING (pair_key))"
_EXT = f"""{_PAIR_AB}, {_rank_sql('x9', 'b9')}, {_rank_sql('rl', 'bl')}, ext AS (SELECT * FROM x9_stats WHERE pair_count >= 2),
lifted AS (SELECT *, row_number() OVER (ORDER BY lift DESC, pair_count DESC, item_a, item_b)::INT AS rank FROM rl_stats), r AS (SELECT * FROM lifted WHERE pair_count >= 10 AND rank <= 200), ks(k) AS (VALUES (10), (20), (50))"""
_LABELLED = "WITH ks(k) AS (VALUES (10), (20), (50)), x AS (SELECT doc_id, n_chars, source, quality, toxic, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents LEFT JOIN labels USING (doc_id))"
_EDGES = f"{_LIMITED}, q AS (SELECT quantile_cont(pair_count, 0.75) AS cut FROM stats), g AS (SELECT item_a, item_b, pair_count AS weight FROM stats, q WHERE pair_count >= cut), w AS (SELECT item_a AS node, item_b AS other, weight FROM g UNION ALL SELECT item_b, item_a, weight FROM g)"

ORACLES = {
    "ranking_compare_ab": f"""{_PAIR_AB}, {_rank_sql('ra', 'ba')}, {_rank_sql('rb', 'bl')},
x AS (SELECT pair_key, a.rank AS left_rank, b.rank AS right_rank FROM (SELECT * FROM ra WHERE rank <= 10) a FULL JOIN (SELECT * FROM rb WHERE rank <= 10) b USING (pair_key))
SELECT *, CASE WHEN right_rank IS NULL THEN 'only_left' WHEN left_rank IS NULL THEN 'only_right' ELSE 'common' END AS membership, right_rank - left_rank AS rank_difference,
  count(*) FILTER (left_rank IS NOT NULL AND right_rank IS NOT NULL) OVER () / count(*) OVER () AS jaccard FROM x""",
    "before_after": f"""{_PAIR_AB}, {_rank_sql('ra', 'b1')}, {_rank_sql('rb', 'b2')}
SELECT pair_key, a.rank AS before_rank, b.rank AS after_rank, CASE WHEN b.rank IS NULL THEN 'removed' WHEN a.rank IS NULL THEN 'new' ELSE 'common' END AS status
FROM (SELECT * FROM ra WHERE rank <= 20) a FULL JOIN (SELECT * FROM rb WHERE rank <= 20) b USING (pair_key)""",
    "rank_corr_spearman": f"""{_TWO}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM two)
SELECT count(*) AS n, corr(rx, ry) AS spearman FROM r""",
    "rank_corr_kendall": f"{_TWO} SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / count(*) FILTER (a.x <> b.x AND a.y <> b.y) AS kendall FROM two a JOIN two b ON a.pair_key < b.pair_key",
    "agreement_at_k": f"""{_EXT}, t AS (SELECT k, count(*) AS n, count(*) FILTER (pair_key IN (SELECT pair_key FROM ext)) AS common FROM r, ks WHERE rank <= k GROUP BY k), m AS (SELECT count(*) AS m FROM ext)
SELECT k, common, common / k AS precision, common / m AS recall, common / (n + m - common) AS jaccard FROM t, m""",
    "external_common": f"{_EXT} SELECT pair_key, r.rank FROM r JOIN ext USING (pair_key)",
    "external_only": f"""{_EXT}, items AS (SELECT item_a AS i FROM r UNION SELECT item_b FROM r)
SELECT e.pair_key, CASE WHEN e.item_a NOT IN (SELECT i FROM items) OR e.item_b NOT IN (SELECT i FROM items) THEN 'unseen_item' WHEN s.pair_count < 10 THEN 'below_min_count' WHEN s.pair_count IS NOT NULL THEN 'below_cut' ELSE 'no_cooccurrence' END AS reason
FROM ext e LEFT JOIN rl_stats s USING (pair_key) WHERE e.pair_key NOT IN (SELECT pair_key FROM r)""",
    "ranking_only": f"{_EXT}, b3 AS (SELECT * FROM b WHERE len(items) = 3), {_rank_sql('x3', 'b3')} SELECT pair_key, rank FROM r WHERE pair_key NOT IN (SELECT pair_key FROM x3_stats WHERE pair_count >= 20)",
    "topk_audit": f"{_EXT} SELECT k, pair_key, rank, pair_key IN (SELECT pair_key FROM ext) AS in_reference FROM r, ks WHERE rank <= k",
    "union_dedup": f"""{_PAIR_AB}, {_rank_sql('ra', 'bf')}, {_rank_sql('rb', 'bl')}, one AS (SELECT pair_key, rank FROM ra WHERE rank <= 30), two AS (SELECT pair_key, lift FROM rb WHERE rank <= 30)
SELECT pair_key, rank, NULL::DOUBLE AS lift, 0 AS source_order FROM one UNION ALL SELECT pair_key, NULL, lift, 1 FROM two WHERE pair_key NOT IN (SELECT pair_key FROM one)""",
    "label_rates_at_k": f"{_LABELLED} SELECT k, count(*) AS n, count(*) FILTER (quality = 1) / count(*) AS quality_rate, count(*) FILTER (toxic = 1) / count(*) AS toxic_rate FROM x, ks WHERE rank <= k GROUP BY k",
    "label_rates_no_blanks": f"{_LABELLED} SELECT k, count(*) AS n, count(*) FILTER (quality = 1) / nullif(count(quality), 0) AS quality_rate, count(*) FILTER (toxic = 1) / nullif(count(toxic), 0) AS toxic_rate FROM x, ks WHERE rank <= k GROUP BY k",
    "crosstab_tertile": f"""{_LABELLED}, y AS (SELECT *, (rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2) / count(*) OVER () AS s FROM x WHERE quality IS NOT NULL)
SELECT CASE WHEN s <= 1 / 3 THEN 'low' WHEN s <= 2 / 3 THEN 'mid' ELSE 'high' END AS tertile, quality, count(*) AS n, avg(n_chars) AS mean_chars, quantile_cont(n_chars, 0.5)::DOUBLE AS median_chars FROM y GROUP BY 1, 2""",
    "cohen_kappa": f"""{_LABELLED}, y AS (SELECT 'quality' AS field, quality AS one, (n_chars > 800)::INT AS two FROM x UNION ALL SELECT 'toxic', toxic, (n_chars % 7 = 0)::INT FROM x), z AS (SELECT * FROM y WHERE one IS NOT NULL AND two IS NOT NULL),
s AS (SELECT field, count(*) AS n, avg((one = two)::INT) AS po, (count(*) FILTER (one = 1) * count(*) FILTER (two = 1) + count(*) FILTER (one = 0) * count(*) FILTER (two = 0)) / (count(*) * count(*)) AS pe FROM z GROUP BY 1)
SELECT field, n, po AS agreement, CASE WHEN abs(1 - pe) > 1e-12 THEN (po - pe) / (1 - pe) END AS kappa FROM s""",
    "rater_disagreements": f"""{_LABELLED}, y AS (SELECT doc_id, concat_ws('|', CASE WHEN quality <> (n_chars > 800)::INT THEN 'quality' END, CASE WHEN toxic <> (n_chars % 7 = 0)::INT THEN 'toxic' END) AS disagreements FROM x) SELECT * FROM y WHERE disagreements <> ''""",
    "final_label": f"""{_LABELLED}, y AS (SELECT source, CASE WHEN quality IS NOT NULL THEN quality::VARCHAR WHEN NOT n_chars BETWEEN 200 AND 500 THEN (n_chars > 300)::INT::VARCHAR END AS label,
  CASE WHEN quality IS NOT NULL THEN 'reviewer' WHEN NOT n_chars BETWEEN 200 AND 500 THEN 'auto' ELSE 'unresolved' END AS label_source FROM x)
SELECT source, label_source, count(*) AS n, bool_or(label = '1') AS any_good, avg((label = '1')::INT) AS good_share FROM y GROUP BY 1, 2""",
    "label_summary": f"{_LABELLED}, c(position, label) AS (VALUES (1, '0'), (2, '1'), (3, 'unclear')) SELECT position, label, (SELECT count(*) FROM x WHERE quality::VARCHAR = label) AS n FROM c",
    "degree_weighted": f"{_EDGES} SELECT node, count(*) AS degree, sum(weight)::BIGINT AS weighted_degree FROM w GROUP BY node",
    "top_neighbours": f"{_EDGES} SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other)::INT AS rank FROM w QUALIFY rank <= 3",
    "density_components": f"""{_EDGES.replace('WITH b', 'WITH RECURSIVE b', 1)}, reach AS (SELECT node, other FROM w UNION SELECT r.node, w.other FROM reach r JOIN w ON w.node = r.other),
c AS (SELECT node, least(node, min(other)) AS c FROM reach GROUP BY node), z AS (SELECT c, count(*) AS n FROM c GROUP BY c), t AS (SELECT count(*) AS components, max(n) AS largest, sum(n)::BIGINT AS nodes FROM z)
SELECT *, (SELECT count(*) FROM g) AS edges, 2 * (SELECT count(*) FROM g) / (nodes * (nodes - 1)) AS density FROM t""",
    "edge_metrics_cross": """WITH e AS (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(DISTINCT o_orderkey) AS weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
m AS (SELECT e.*, x.n_regionkey AS ca, y.n_regionkey AS cb FROM e JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b)
SELECT least(ca, cb) AS low, greatest(ca, cb) AS high, count(*) AS n_edges, sum(weight)::BIGINT AS weight FROM m WHERE ca <> cb GROUP BY 1, 2""",
}
