"""Comparing rankings and raters: overlap, rank correlations, agreement at k, label rates, kappa, label resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *keys: str, falling: bool = False) -> Column:
    """Rank with ties averaged."""
    order = F.col(value).desc() if falling else F.col(value).asc()
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def safe_corr(x: str, y: str) -> Column:
    """Pearson; null for fewer than two rows or a constant column."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    cov = n * F.sum(F.col(x) * F.col(y)) - sx * sy
    vx, vy = n * F.sum(F.col(x) * F.col(x)) - sx * sx, n * F.sum(F.col(y) * F.col(y)) - sy * sy
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, spearman. Values are ranked anew among the rows given, ties averaged."""
    r = df.select(average_rank(x).cast("double").alias("rx"), average_rank(y).cast("double").alias("ry"))
    return r.agg(F.count("*").alias("n"), safe_corr("rx", "ry").alias("spearman"))


def kendall(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row: kendall, over pairs of rows that are tied in neither (Goodman and Kruskal's gamma). For bounded rankings: it compares all pairs."""
    a = df.select(F.col(key).alias("k1"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    b = df.select(F.col(key).alias("k2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    sign = F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))
    return a.join(b, F.col("k1") < F.col("k2")).select(sign.alias("s")).agg(F.try_divide(F.sum("s"), F.count_if(F.col("s") != 0).cast("double")).alias("kendall"))


def compare_topk(left: DataFrame, right: DataFrame, key: str, k: int) -> DataFrame:
    """Full outer comparison of two rankings (key, rank) cut at k: membership, both ranks, their difference, Jaccard."""
    a = left.filter(F.col("rank") <= k).select(key, F.col("rank").alias("left_rank"))
    b = right.filter(F.col("rank") <= k).select(key, F.col("rank").alias("right_rank"))
    x = a.join(b, key, "full")
    has_a, has_b = F.col("left_rank").isNotNull(), F.col("right_rank").isNotNull()
    x = x.withColumn("membership", F.when(has_a & has_b, "common").when(has_a, "only_left").otherwise("only_right"))
    both = F.count_if(has_a & has_b).over(Window.partitionBy())
    return x.select(key, "left_rank", "right_rank", "membership", (F.col("right_rank") - F.col("left_rank")).alias("rank_difference"), (both / F.count("*").over(Window.partitionBy())).alias("jaccard"))


def before_after(before: DataFrame, after: DataFrame, key: str, k: int) -> DataFrame:
    x = compare_topk(before, after, key, k)
    status = F.when(F.col("membership") == "common", "common").when(F.col("membership") == "only_left", "removed").otherwise("new")
    return x.select(key, F.col("left_rank").alias("before_rank"), F.col("right_rank").alias("after_rank"), status.alias("status"))


def at_k(ranking: DataFrame, reference: DataFrame, key: str, ks: DataFrame) -> DataFrame:
    """Precision (over k, also if there are fewer rows), recall and Jaccard of each top k against a reference set."""
    ref = reference.select(key).distinct()
    total = ref.agg(F.count("*").alias("n_reference"))
    x = ranking.join(ref.withColumn("hit", F.lit(True)), key, "left").crossJoin(F.broadcast(ks)).filter(F.col("rank") <= F.col("k"))
    g = x.groupBy("k").agg(F.count("*").alias("n_top"), F.count_if("hit").alias("common")).crossJoin(F.broadcast(total))
    return g.select("k", "common", (F.col("common") / F.col("k")).alias("precision"), F.try_divide("common", "n_reference").alias("recall"), F.try_divide(F.col("common"), F.col("n_top") + F.col("n_reference") - F.col("common")).alias("jaccard"))


def only_in_reference(reference: DataFrame, ranking: DataFrame, items: DataFrame, key: str, reasons: list[tuple[Column, str]]) -> DataFrame:
    """Reference pairs that the ranking lacks, with the first reason that holds: an unseen item, then those given, then no co-occurrence."""
    x = reference.join(ranking.select(key), key, "left_anti")
    for side in ("item_a", "item_b"):
        x = x.join(items.select(F.col("item").alias(side), F.lit(True).alias(f"seen_{side}")), side, "left")
    out = F.when(F.col("seen_item_a").isNull() | F.col("seen_item_b").isNull(), "unseen_item")
    for condition, name in reasons:
        out = out.when(condition, name)
    return x.withColumn("reason", out.otherwise("no_cooccurrence")).drop("seen_item_a", "seen_item_b")


def topk_audit(ranking: DataFrame, reference: DataFrame, key: str, ks: DataFrame) -> DataFrame:
    ref = reference.select(key).distinct().withColumn("hit", F.lit(True))
    x = ranking.crossJoin(F.broadcast(ks)).filter(F.col("rank") <= F.col("k")).join(ref, key, "left")
    return x.select("k", key, "rank", F.coalesce("hit", F.lit(False)).alias("in_reference"))


def label_rates_at_k(df: DataFrame, labels: list[str], ks: DataFrame, blanks_count: bool = True) -> DataFrame:
    """Share of each 0/1 label in each top k; blanks are in the denominator or, if asked for, not."""
    x = df.crossJoin(F.broadcast(ks)).filter(F.col("rank") <= F.col("k"))
    rate = lambda c: F.try_divide(F.count_if(F.col(c) == 1), F.count("*") if blanks_count else F.count(c)).alias(f"{c}_rate")
    return x.groupBy("k").agg(F.count("*").alias("n"), *[rate(c) for c in labels])


def with_tertile(df: DataFrame, value: str, name: str = "tertile") -> DataFrame:
    """Adds low, mid or high by average rank over count; blank for fewer than three rows, null for a null value.
    Ranks come from counted values: a row for each different one."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("tertile_of")).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.orderBy("tertile_of")) - F.col("c")
    total = F.sum("c").over(Window.partitionBy())
    share = (before + (F.col("c") + 1) / 2) / total
    kind = F.when(total < 3, "").when(share <= 1 / 3, "low").when(share <= 2 / 3, "mid").otherwise("high")
    return df.join(counted.select("tertile_of", kind.alias(name)), F.col(value) == F.col("tertile_of"), "left").drop("tertile_of")


def cohen_kappa(df: DataFrame, field: str, first: str, second: str) -> DataFrame:
    """Per field, over rows where both raters gave a label: n, simple agreement, kappa (null where chance agreement is 1)."""
    x = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    n = x.groupBy(field).agg(F.count("*").alias("n"), F.count_if(F.col(first) == F.col(second)).alias("same"))
    a = x.groupBy(field, F.col(first).cast("string").alias("label")).agg(F.count("*").alias("na"))
    b = x.groupBy(field, F.col(second).cast("string").alias("label")).agg(F.count("*").alias("nb"))
    chance = a.join(b, [field, "label"]).groupBy(field).agg(F.sum(F.col("na") * F.col("nb")).alias("m"))
    y = n.join(chance, field, "left")
    po, pe = F.col("same") / F.col("n"), F.coalesce("m", F.lit(0)) / (F.col("n") * F.col("n"))
    return y.select(field, "n", po.alias("agreement"), F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe)).alias("kappa"))


def final_label(reviewer: str, auto: str, needs_review: Column) -> tuple[Column, Column]:
    """(label, source): the reviewer's, else the automatic one if it needs no review, else unresolved."""
    has = F.col(reviewer).isNotNull() & (F.trim(F.col(reviewer).cast("string")) != "")
    ok = F.col(auto).isNotNull() & ~F.coalesce(needs_review, F.lit(False))
    return F.when(has, F.col(reviewer).cast("string")).when(ok, F.col(auto).cast("string")), F.when(has, "reviewer").when(ok, "auto").otherwise("unresolved")


def label_counts(df: DataFrame, label: str, categories: DataFrame) -> DataFrame:
    """Counts in the fixed order of categories (position, label), zero-filled."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return categories.join(n, "label", "left").select("position", "label", F.coalesce("n", F.lit(0)).alias("n"))


def disagreements(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows where the raters differ in any field, with the fields' names."""
    names = F.array_compact(F.array(*[F.when(F.col(a) != F.col(b), F.lit(k)) for k, (a, b) in fields.items()]))
    return df.withColumn("disagreements", F.array_join(names, "|")).filter("disagreements <> ''")


def union_keep_first(frames: list[DataFrame], key: str) -> DataFrame:
    """UNION ALL of frames with different columns; of rows with one key, the one of the earliest frame stays."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("source_order", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("source_order"))).filter("i = 1").drop("i")


def review_candidates(ranking: DataFrame, lists: dict[str, str], k: int) -> DataFrame:
    """Rows in the top k of any list (name: its rank's column), with the lists' names. A row carries all of its ranks, so one pass is enough."""
    names = F.sort_array(F.array_compact(F.array(*[F.when(F.col(c) <= k, F.lit(n)) for n, c in lists.items()])))
    return ranking.withColumn("ranking_source", F.array_join(names, "|")).filter("ranking_source <> ''")


def scope_agreement(ranking: DataFrame, reference: DataFrame, key: str, scope: str) -> DataFrame:
    """Of all rows and of each value of scope: candidates, those in the reference set, their share and keys (bounded rankings)."""
    x = ranking.join(reference.select(key).distinct().withColumn("hit", F.lit(True)), key, "left")
    x = x.withColumn("in_scope", F.explode(F.array(F.lit("All"), F.col(scope))))
    listed = F.array_join(F.sort_array(F.collect_list(F.when(F.col("hit"), F.col(key)))), " | ")
    return x.groupBy(F.col("in_scope").alias("scope")).agg(F.count("*").alias("candidates"), F.count_if("hit").alias("common"), (F.count_if("hit") / F.count("*")).alias("common_rate"), listed.alias("common_keys"))


def reference_statistics(reference: DataFrame, ranking: DataFrame, key: str, ks: tuple[int, ...]) -> DataFrame:
    """One row: sizes of a reference set and a ranking, of what they share and of what only one has, and hits in each top k."""
    a = reference.select(key).distinct().withColumn("in_reference", F.lit(True))
    x = a.join(ranking.select(key, "rank"), key, "full").withColumns({"r": F.coalesce("in_reference", F.lit(False)), "o": F.col("rank").isNotNull()})
    both = F.col("r") & F.col("o")
    counts = {"reference_pairs": F.col("r"), "ranking_pairs": F.col("o"), "common_pairs": both, "reference_only": F.col("r") & ~F.col("o"), "ranking_only": F.col("o") & ~F.col("r")}
    return x.agg(*[F.count_if(c).alias(n) for n, c in counts.items()], *[F.count_if(both & (F.col("rank") <= k)).alias(f"top{k}_common") for k in ks])


def rank_drops(before: DataFrame, after: DataFrame, key: str, k: int, limit: int = 5, missing: int = 999) -> DataFrame:
    """The rows of the first top k that fall furthest in the second one; a row that it lacks counts as ranked `missing`."""
    later = after.filter(F.col("rank") <= k).select(key, F.col("rank").alias("after_rank"))
    x = before.filter(F.col("rank") <= k).select(key, "rank").join(later, key, "left").withColumn("after_rank", F.coalesce("after_rank", F.lit(missing)))
    return x.withColumn("rank_drop", F.col("after_rank") - F.col("rank")).orderBy(F.desc("rank_drop"), F.desc("after_rank"), "rank").limit(limit)


def label_source(df: DataFrame, sources: list[str]) -> DataFrame:
    """One row: the first of the columns, in order, that has any label; null if none has."""
    filled = lambda c: F.bool_or(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return df.agg(*[filled(c).alias(c) for c in sources]).select(F.coalesce(*[F.when(F.col(c), F.lit(c)) for c in sources]).alias("label_source"))


def in_scopes(df: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Each row once for each scope it is in: all, and the top k of each k by rank (null: in none of them)."""
    return df.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), *[F.when(F.col("rank") <= k, F.lit(f"top_{k}")) for k in ks]))))


def label_metrics(df: DataFrame, labels: list[str]) -> DataFrame:
    """(scope, label, n, labelled, rate): rate is the share of 1 among labelled rows."""
    x = df.unpivot(["scope"], [F.col(c).cast("int").alias(c) for c in labels], "label", "value")
    return x.groupBy("scope", "label").agg(F.count("*").alias("n"), F.count("value").alias("labelled"), F.try_divide(F.count_if(F.col("value") == 1), F.count("value")).alias("rate"))


def spearman_by(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """spearman() for each group of keys, from counted values: windows see a row for each different value, not for each row."""
    g = df.groupBy(*keys, x, y).agg(F.count("*").alias("c"))
    for value, name in ((x, "rx"), (y, "ry")):
        own = g.groupBy(*keys, value).agg(F.sum("c").alias("cv"))
        running = F.sum("cv").over(Window.partitionBy(*keys).orderBy(value))
        g = g.join(own.select(*keys, value, (running - (F.col("cv") - 1) / 2).alias(name)), [*keys, value])
    c, rx, ry = F.col("c"), F.col("rx"), F.col("ry")
    n, sx, sy = F.sum(c), F.sum(c * rx), F.sum(c * ry)
    vx, vy = n * F.sum(c * rx * rx) - sx * sx, n * F.sum(c * ry * ry) - sy * sy
    corr = F.when((vx > 0) & (vy > 0), (n * F.sum(c * rx * ry) - sx * sy) / (F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))))
    return g.groupBy(*keys).agg(n.alias("n"), corr.alias("spearman"))


def feature_relation(df: DataFrame, feature: str, label: str, positive: list[str]) -> DataFrame:
    """(scope, metric, label, n, value) of labelled rows with the feature: its mean and median where the label is positive and where it isn't,
    Spearman's correlation with that, and the counts of feature > 0 against it, zero-filled."""
    said = F.trim(F.coalesce(F.col(label).cast("string"), F.lit("")))
    x = df.select("scope", F.col(feature).cast("double").alias("feature"), said.alias("said")).filter("said <> '' and feature is not null")
    x = x.select("scope", "feature", F.col("said").isin(positive).cast("int").alias("yes"))
    name = lambda c, yes, no: F.when(c, yes).otherwise(no)
    yes, auto = F.col("yes") == 1, F.col("feature") > 0
    means = x.groupBy("scope", name(yes, "manual_yes", "manual_no").alias("label")).agg(F.count("*").alias("n"), F.avg("feature").alias("feature_mean"), F.percentile("feature", 0.5).alias("feature_median"))
    rows = means.unpivot(["scope", "label", "n"], ["feature_mean", "feature_median"], "metric", "value")
    corr = spearman_by(x, "feature", "yes", "scope").select("scope", F.lit("manual_binary").alias("label"), "n", F.lit("spearman").alias("metric"), F.col("spearman").alias("value"))
    cells = {f"{a}|{b}": (yes == (a == "manual_yes")) & (auto == (b == "auto_positive")) for a in ("manual_no", "manual_yes") for b in ("auto_zero", "auto_positive")}
    counted = x.groupBy("scope").agg(F.count("*").alias("n"), *[F.count_if(c).cast("double").alias(k) for k, c in cells.items()])
    table = counted.unpivot(["scope", "n"], list(cells), "label", "value").withColumn("metric", F.lit("crosstab"))
    return rows.unionByName(corr).unionByName(table)
