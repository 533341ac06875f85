"""Feature normalisation, weighted scores, tiers, sensitivity to weights and thresholds.

Settings are crossed with the counted pairs (tens of rows each), so every setting is scored in one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .association import PAIR, stable_order

# Weights of the two score versions, their alternatives, and the two presets.
WEIGHTS_V1 = {"A": (0.30, 0.25, 0.20, 0.15, 0.10), "B": (0.40, 0.35, 0.10, 0.10, 0.05), "C": (0.20, 0.15, 0.15, 0.30, 0.20)}
WEIGHTS_V2 = {"A": (0.30, 0.25, 0.15, 0.15, 0.10, -0.05), "B": (0.40, 0.30, 0.10, 0.10, 0.05, -0.05), "C": (0.20, 0.15, 0.15, 0.25, 0.20, -0.05)}
PRESETS = {"statistics_centered": (0.40, 0.30, 0.20, 0.05, 0.03, -0.02), "context_centered": (0.15, 0.10, 0.10, 0.30, 0.25, -0.10)}
FEATURES_V1 = ("n_support", "n_lift", "n_centrality", "n_positive", "n_role")
FEATURES_V2 = ("n_support", "adjusted_lift", "n_centrality", "n_positive", "n_role", "n_negative")
SHORT = ("support", "lift", "centrality", "positive", "role", "negative")
ALPHA = 3.0


def min_max(x: str, keys: list[str] | None = None) -> tuple[Column, Column]:
    return F.min(x).alias(f"{x}_lo"), F.max(x).alias(f"{x}_hi")


def scaled(x: str) -> Column:
    """Min-max; 0 where the column is constant to a relative 1e-9."""
    lo, hi = F.col(f"{x}_lo"), F.col(f"{x}_hi")
    flat = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
    return F.when(flat, F.lit(0.0)).otherwise((F.col(x) - lo) / (hi - lo))


def with_scaled(df: DataFrame, columns: dict[str, str], *keys: str) -> DataFrame:
    """Adds new = min-max of old over the frame, or over each group of keys."""
    ends = df.groupBy(*keys).agg(*[e for c in columns for e in min_max(c)])
    x = df.join(ends, [*keys]) if keys else df.crossJoin(F.broadcast(ends))
    x = x.withColumns({new: scaled(old) for old, new in columns.items()})
    return x.drop(*[f"{c}_{s}" for c in columns for s in ("lo", "hi")])


def ratio(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def normalised_v1(df: DataFrame) -> DataFrame:
    cut = df.agg(F.percentile("lift", 0.99).alias("p99"))
    x = df.crossJoin(F.broadcast(cut)).withColumns({"s_support": F.log1p("support"), "s_count": F.log1p("pair_count"), "s_lift": F.least("lift", "p99"), "s_positive": ratio("positive", "pair_count"), "s_role": ratio("role", "pair_count")})
    return with_scaled(x, {"s_support": "n_support", "s_count": "n_count", "s_lift": "n_lift", "centrality_mean": "n_centrality", "s_positive": "n_positive", "s_role": "n_role"}).drop("p99", "s_support", "s_count", "s_lift", "s_positive", "s_role")


def smoothed(df: DataFrame, kinds: dict[str, tuple[str, str]], alpha: float = ALPHA) -> DataFrame:
    """Adds name = (x + alpha * X / N) / (n + alpha), with the sums X and N of x and n over all pairs."""
    sums = df.agg(*[F.coalesce(F.try_divide(F.sum(x), F.sum(n)), F.lit(0.0)).alias(f"g_{k}") for k, (x, n) in kinds.items()])
    x = df.crossJoin(F.broadcast(sums))
    return x.withColumns({k: (F.col(a) + alpha * F.col(f"g_{k}")) / (F.col(n) + alpha) for k, (a, n) in kinds.items()}).drop(*[f"g_{k}" for k in kinds])


def normalised_v2(df: DataFrame, alpha: float = ALPHA, min_pairs: int = 3, min_evidence: int = 2) -> DataFrame:
    """Adds normalised features; context features are shrunk to the corpus rate, and 0 below the gate."""
    kinds = ("positive", "role", "negative")
    x = smoothed(df, {f"smoothed_{k}": (k, "evidence") for k in kinds}, alpha)
    gate = (F.col("pair_count") >= min_pairs) & (F.col("evidence") >= min_evidence)
    cut = df.agg(F.percentile("lift", 0.99).alias("p99"))
    x = x.crossJoin(F.broadcast(cut)).withColumns({"eligible": gate, "s_support": F.log1p("support"), "s_lift": F.least("lift", "p99")} | {f"s_{k}": F.when(gate, F.col(f"smoothed_{k}")).otherwise(0.0) for k in kinds})
    x = with_scaled(x, {"s_support": "n_support", "s_lift": "n_lift", "centrality_mean": "n_centrality"} | {f"s_{k}": f"n_{k}" for k in kinds})
    x = x.withColumn("confidence", F.least(F.lit(1.0), F.col("pair_count") / 5))
    return x.withColumn("adjusted_lift", F.col("n_lift") * F.col("confidence")).drop("p99", "s_support", "s_lift", *[f"s_{k}" for k in kinds])


def weighted(features: tuple[str, ...], weights: tuple) -> Column:
    parts = [F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in zip(features, weights, strict=True)]
    return reduce(lambda a, b: a + b, parts)


def ranked(df: DataFrame, score: str, name: str, *keys: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*stable_order(score))))


def ranking_v1(df: DataFrame) -> DataFrame:
    x = normalised_v1(df)
    x = x.withColumns({"score": weighted(FEATURES_V1, WEIGHTS_V1["A"]), "support_lift": 0.5 * F.col("n_support") + 0.5 * F.col("n_lift")})
    for score, name in (("support", "rank_support"), ("lift", "rank_lift"), ("support_lift", "rank_support_lift"), ("score", "rank_overall")):
        x = ranked(x, score, name)
    return x


def ranking_v2(df: DataFrame, **gate) -> DataFrame:
    x = normalised_v2(df, **gate).withColumn("score", weighted(FEATURES_V2, WEIGHTS_V2["A"]))
    x = x.withColumn("support_lift", 0.5 * F.col("n_support") + 0.5 * F.col("adjusted_lift"))
    for score, name in (("support", "rank_support"), ("lift", "rank_lift"), ("support_lift", "rank_support_lift"), ("score", "rank_overall")):
        x = ranked(x, score, name)
    return x


def tiers(df: DataFrame, tier1_pairs: int = 3, tier1_evidence: int = 2, tier2_pairs: int = 2) -> DataFrame:
    """Adds tier and exclusion_reason; reasons in order: product name, parent/child, self, no shared context, other."""
    f = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
    reason = (
        F.when(f("product_name_derived"), "product_name_derived")
        .when(f("parent_child_pair"), "parent_child_pair")
        .when(F.col("item_a") == F.col("item_b"), "self_loop")
        .when(F.col("evidence") == 0, "no_same_context")
    )
    x = df.withColumn("exclusion_reason", reason)
    two = F.col("exclusion_reason").isNull() & (F.col("pair_count") >= tier2_pairs)
    one = two & (F.col("pair_count") >= tier1_pairs) & (F.col("evidence") >= tier1_evidence)
    x = x.withColumn("tier", F.when(one, "Tier1").when(two, "Tier2").otherwise("Excluded"))
    return x.withColumn("exclusion_reason", F.when(F.col("tier") == "Excluded", F.coalesce("exclusion_reason", F.lit("other"))))


def weight_settings() -> dict[str, tuple]:
    """The base weights, each of them dropped, halved and doubled, and the presets: 21 settings."""
    base = WEIGHTS_V2["A"]
    out = {"baseline": base}
    for i, name in enumerate(SHORT):
        for kind, factor in (("drop", 0.0), ("half", 0.5), ("double", 2.0)):
            out[f"{kind}_{name}"] = tuple(w * factor if j == i else w for j, w in enumerate(base))
    return out | PRESETS


def scored_by_setting(df: DataFrame, settings: dict[str, tuple]) -> DataFrame:
    """Every pair under every setting, with score and rank of each."""
    spark = df.sparkSession
    cols = [f"w_{s}" for s in SHORT]
    grid = spark.createDataFrame([(k, *map(float, v)) for k, v in settings.items()], f"setting string, {', '.join(c + ' double' for c in cols)}")
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(0.0)) * F.col(w) for f, w in zip(FEATURES_V2, cols, strict=True)])
    x = df.crossJoin(F.broadcast(grid)).withColumn("setting_score", score).drop(*cols)
    return ranked(x, "setting_score", "setting_rank", "setting")


def against_baseline(x: DataFrame, k: int, base: str = "baseline") -> DataFrame:
    """Per setting against the base: shared and new of the top k, Jaccard, largest and median shift of ranks, Spearman.

    Ranks without ties over the same pairs, so Spearman is 1 - 6 * sum(d ** 2) / (n ** 3 - n)."""
    b = x.filter(F.col("setting") == base).select(*PAIR, F.col("setting_rank").alias("base_rank"))
    y = x.join(b, [*PAIR]).withColumn("d", F.abs(F.col("setting_rank") - F.col("base_rank")))
    n, ours, theirs = F.count("*"), F.col("setting_rank") <= k, F.col("base_rank") <= k
    g = y.groupBy("setting").agg(
        F.count_if(ours & theirs).alias("common_topk"),
        F.count_if(ours & ~theirs).alias("new_topk"),
        F.try_divide(F.count_if(ours & theirs), F.count_if(ours | theirs)).alias("jaccard_topk"),
        F.max("d").cast("long").alias("max_shift"),
        F.percentile("d", 0.5).alias("median_shift"),
        (1 - F.try_divide(6 * F.sum((F.col("d") * F.col("d")).cast("double")), (n * n * n - n).cast("double"))).alias("spearman"),
    )
    return g


MODES = ("same_context_required", "same_context_preferred", "document_only")


def threshold_grid(spark: SparkSession, pairs=(2, 3, 4, 5), evidence=(1, 2, 3)) -> DataFrame:
    rows = [(f"{m}|{p}|{d}", m, p, d) for m in MODES for p in pairs for d in evidence]
    return F.broadcast(spark.createDataFrame(rows, "setting string, mode string, min_pairs int, min_evidence int"))


def thresholds(df: DataFrame, grid: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Every pair under every (mode, min_pairs, min_evidence): candidate, eligible, score, rank and tier.

    Context features come from same-context counts, from document counts (doc_*), or from the latter where the former are missing;
    min-max runs over the whole pool of each setting before candidates are picked."""
    kinds = ("positive", "role", "negative")
    x = smoothed(df, {f"c_{k}": (k, "evidence") for k in kinds} | {f"d_{k}": (f"doc_{k}", "pair_count") for k in kinds}, alpha)
    cut = df.agg(F.percentile("lift", 0.99).alias("p99"))
    x = x.crossJoin(F.broadcast(cut)).withColumns({"s_support": F.log1p("support"), "s_lift": F.least("lift", "p99")}).crossJoin(grid)
    has = F.col("evidence") >= 1
    spare = (F.col("doc_positive") + F.col("doc_negative") + F.col("doc_role")) > 0
    by_doc = (F.col("mode") == MODES[2]) | ((F.col("mode") == MODES[1]) & ~has)
    x = x.withColumn("candidate", (F.col("mode") == MODES[2]) | has | ((F.col("mode") == MODES[1]) & spare))
    context = F.when(by_doc, F.col("pair_count")).otherwise(F.col("evidence"))
    x = x.withColumn("eligible", F.col("candidate") & (F.col("pair_count") >= F.col("min_pairs")) & (context >= F.col("min_evidence")))
    x = x.withColumns({f"s_{k}": F.when(F.col("eligible"), F.when(by_doc, F.col(f"d_{k}")).otherwise(F.col(f"c_{k}"))).otherwise(0.0) for k in kinds})
    x = with_scaled(x, {"s_support": "n_support", "s_lift": "n_lift", "centrality_mean": "n_centrality"} | {f"s_{k}": f"n_{k}" for k in kinds}, "setting")
    x = x.withColumn("adjusted_lift", F.col("n_lift") * F.least(F.lit(1.0), F.col("pair_count") / 5)).withColumn("setting_score", weighted(FEATURES_V2, WEIGHTS_V2["A"]))
    x = ranked(x.filter("candidate"), "setting_score", "setting_rank", "setting")
    return x.withColumn("tier", F.when(F.col("eligible"), "Tier1").otherwise("Tier2"))


def unpivoted(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.unpivot(keys, [F.col(f).cast("double").alias(f) for f in features], "feature", "value")


def distributions(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Per group and feature: count, mean, sample deviation, quartiles' range, median and ends."""
    x = unpivoted(df, [key], features)
    q = lambda p: F.percentile("value", p)
    return x.groupBy(key, "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def duplication_rate(before: str, after: str) -> Column:
    return ratio(F.col(before) - F.col(after), F.col(before))


def setting_changes(x: DataFrame, labels: DataFrame, base: str = "baseline", k: int = 10) -> DataFrame:
    """Per setting, from scored_by_setting() rows with tiers and labels (item_a, item_b, label): pairs of each tier, pairs that left and entered
    the top k, the pair that moved furthest, and rates of valid and partly valid among the labelled pairs of the top 5 and 10."""
    b = x.filter(F.col("setting") == base).select(*PAIR, F.col("setting_rank").alias("base_rank"))
    y = x.join(b, [*PAIR]).join(labels.select(*PAIR, "label"), [*PAIR], "left")
    ours, theirs, moved = F.col("setting_rank") <= k, F.col("base_rank") <= k, F.abs(F.col("setting_rank") - F.col("base_rank"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("pair_key")))), " | ")
    said = lambda n: (F.col("setting_rank") <= n) & F.col("label").isNotNull()
    rate = lambda n, v: F.try_divide(F.count_if(said(n) & (F.col("label") == v)), F.count_if(said(n)))
    return y.groupBy("setting").agg(
        F.count_if(F.col("tier") == "Tier1").alias("tier1"),
        F.count_if(F.col("tier") == "Tier2").alias("tier2"),
        listed(theirs & ~ours).alias("dropped"),
        listed(ours & ~theirs).alias("entered"),
        F.min_by("pair_key", F.struct(-moved, F.col("pair_key"))).alias("max_shift_pair"),
        *[rate(n, v).alias(f"top{n}_{v}_rate") for n in (5, 10) for v in ("valid", "partially_valid")],
    )


def grid_stability(x: DataFrame, base: str, k: int = 20) -> DataFrame:
    """Per setting, from thresholds() rows: retained pairs, tiers, and how its ranking agrees with the base setting's: Spearman over the pairs
    of both, ranked anew among them, and Jaccard of the top k."""
    b = x.filter(F.col("setting") == base).select(*PAIR, F.col("setting_rank").alias("base_rank"))
    y = x.join(b, [*PAIR], "left").withColumn("shared", F.col("base_rank").isNotNull())
    anew = lambda r: F.row_number().over(Window.partitionBy("setting", "shared").orderBy(r))
    y = y.withColumn("d", (anew("setting_rank") - anew("base_rank")).cast("double"))
    n, ours, theirs = F.count_if("shared"), F.col("setting_rank") <= k, F.col("base_rank") <= k
    total = b.agg(F.count_if(theirs).alias("base_top"))
    g = y.groupBy("setting").agg(
        F.count("*").alias("retained"),
        F.count_if(F.col("tier") == "Tier1").alias("tier1"),
        F.count_if(F.col("tier") == "Tier2").alias("tier2"),
        n.alias("common"),
        (1 - F.try_divide(6 * F.sum(F.when(F.col("shared"), F.col("d") * F.col("d"))), (n * n * n - n).cast("double"))).alias("spearman"),
        F.count_if(ours & theirs).alias("common_topk"),
        F.count_if(ours).alias("own_top"),
    )
    g = g.crossJoin(F.broadcast(total)).withColumn("jaccard_topk", F.try_divide(F.col("common_topk"), F.col("own_top") + F.col("base_top") - F.col("common_topk")))
    return g.drop("own_top", "base_top")


def tier_differences(summary: DataFrame, one: str = "Tier1", two: str = "Tier2") -> DataFrame:
    """Per feature of distributions(): the first tier's mean and median less the second's."""
    side = lambda v, s: summary.filter(F.col("tier") == v).select("feature", F.col("mean").alias(f"mean_{s}"), F.col("median").alias(f"median_{s}"))
    x = side(one, "one").join(side(two, "two"), "feature")
    return x.select("feature", *[(F.col(f"{m}_one") - F.col(f"{m}_two")).alias(f"{m}_difference") for m in ("mean", "median")])


def ranking_metadata(df: DataFrame, key: str, rank: str, values: list[str]) -> DataFrame:
    """(metric, value): rows, different keys, ends of the rank and of each value, and as 0 or 1 whether ranks are 1 to n without ties."""
    n, d = F.count("*").cast("double"), lambda c: c.cast("double")
    whole = (F.countDistinct(rank) == F.count("*")) & (F.min(rank) == 1) & (F.max(rank) == F.count("*"))
    cols = {"rows": n, "distinct_keys": d(F.countDistinct(key)), "ranks_whole": d(whole.cast("int"))} | {f"{v}_{e}": d(f(v)) for v in (rank, *values) for e, f in (("min", F.min), ("max", F.max))}
    return df.agg(*[c.alias(m) for m, c in cols.items()]).unpivot([], list(cols), "metric", "value")
