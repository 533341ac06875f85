"""Baskets, pairs, itemsets: counts, support, lift, conditions, stable ranks and top-k.

Pairs are built inside each row from the sorted basket, so the only shuffles are those of the counts, which sum within
tasks first. Normalisers are one-row aggregates; windows without a partition run over the counted vocabulary of pairs alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ("item_a", "item_b")


@dataclass(frozen=True)
class Condition:
    """Baskets of min_items to max_items (None: no upper limit), and only flagged ones if asked for."""

    name: str
    min_items: int = 2
    max_items: int | None = None
    require_flag: bool = False


CONDITIONS = [Condition("all_multi"), Condition("limited_2_5", 2, 5), Condition("flagged_2_5", 2, 5, True)]


def baskets(rows: DataFrame, basket: str, item: str, *carried: Column) -> DataFrame:
    """(basket_id, items): sorted distinct items; carried: further aggregates of the basket's rows."""
    return rows.filter(F.col(item).isNotNull()).groupBy(F.col(basket).alias("basket_id")).agg(F.sort_array(F.collect_set(item)).alias("items"), *carried)


def in_condition(df: DataFrame, c: Condition, flag: str = "flag") -> DataFrame:
    out = df.filter(F.size("items") >= c.min_items)
    if c.max_items is not None:
        out = out.filter(F.size("items") <= c.max_items)
    return out.filter(F.col(flag)) if c.require_flag else out


def item_pairs(items: str = "items") -> Column:
    """Unordered pairs (item_a < item_b) of a sorted basket, as an array; none for baskets of fewer than two."""
    return F.flatten(
        F.transform(
            items,
            lambda x, i: F.transform(F.slice(F.col(items), i + 2, F.size(items)), lambda y: F.struct(x.alias("item_a"), y.alias("item_b"))),
        )
    )


def exploded_pairs(df: DataFrame, *keep: str) -> DataFrame:
    return df.filter(F.size("items") >= 2).select(*keep, F.explode(item_pairs()).alias("p")).select(*keep, "p.item_a", "p.item_b")


def item_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode("items").alias("item")).groupBy(*keys, "item").agg(F.count("*").alias("frequency"))


def pair_key(a: Column | str = "item_a", b: Column | str = "item_b") -> Column:
    return F.concat_ws("||", a, b)


def pair_statistics(df: DataFrame, *keys: str) -> DataFrame:
    """Pair counts with both items' counts, support and lift, per group of keys (none: over all). N counts every basket."""
    pairs = exploded_pairs(df, *keys).groupBy(*keys, *PAIR).agg(F.count("*").alias("pair_count"))
    return statistics_of(pairs, items_and_total(df, *keys), *keys)


def items_and_total(df: DataFrame, *keys: str) -> DataFrame:
    """(item, frequency) of each group of keys, and the number of its baskets under a null item: one pass for both."""
    marked = F.concat("items", F.array(F.lit(None).cast("string")))
    return df.select(*keys, F.explode(marked).alias("item")).groupBy(*keys, "item").agg(F.count("*").alias("frequency"))


def statistics_of(pairs: DataFrame, items: DataFrame, *keys: str) -> DataFrame:
    """pair_statistics() from counted pairs (item_a, item_b, pair_count) and items_and_total()."""
    n = items.filter(F.col("item").isNull()).select(*keys, F.col("frequency").alias("n_baskets"))
    freq = items.filter(F.col("item").isNotNull())
    out = pairs.join(freq.withColumnsRenamed({"item": "item_a", "frequency": "frequency_a"}), [*keys, "item_a"])
    out = out.join(freq.withColumnsRenamed({"item": "item_b", "frequency": "frequency_b"}), [*keys, "item_b"])
    out = out.join(n, [*keys]) if keys else out.crossJoin(F.broadcast(n))
    return out.select(
        *keys,
        *PAIR,
        pair_key().alias("pair_key"),
        "pair_count",
        "frequency_a",
        "frequency_b",
        "n_baskets",
        (F.col("pair_count") / F.col("n_baskets")).alias("support"),
        (F.col("pair_count") * F.col("n_baskets") / (F.col("frequency_a") * F.col("frequency_b"))).alias("lift"),
    )


def stable_order(score: str = "support") -> list[Column]:
    """score, pair_count and lift falling, then names: a total order without ties."""
    cols = list(dict.fromkeys([score, "pair_count", "lift"]))
    return [F.col(c).desc() for c in cols] + [F.col(c).asc() for c in PAIR]


def stable_rank(df: DataFrame, score: str, name: str, *keys: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*stable_order(score))))


def top_pairs(df: DataFrame, score: str, k: int, *keys: str, name: str = "rank") -> DataFrame:
    return stable_rank(df, score, name, *keys).filter(F.col(name) <= k)


def pairs_with_baskets(df: DataFrame) -> DataFrame:
    """Each pair with its count and every basket that has it: a row for each, so that no pair's ids are held in one cell."""
    rows = exploded_pairs(df, "basket_id")
    return rows.join(rows.groupBy(*PAIR).agg(F.count("*").alias("pair_count")), [*PAIR]).select(*PAIR, "pair_count", "basket_id")


def pairs_with_first_baskets(df: DataFrame, limit: int = 5) -> DataFrame:
    """Pair counts with the first `limit` basket ids. Ids are reduced to the smallest by rank, not collected whole."""
    rows = exploded_pairs(df, "basket_id")
    w = Window.partitionBy(*PAIR).orderBy("basket_id")
    first = rows.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= limit)
    ids = first.groupBy(*PAIR).agg(F.array_join(F.sort_array(F.collect_list("basket_id")), "|").alias("basket_ids"))
    return rows.groupBy(*PAIR).agg(F.count("*").alias("pair_count")).join(ids, [*PAIR])


def at_least_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    cut = df.agg(F.percentile(column, q).alias("cut"))
    return df.crossJoin(F.broadcast(cut)).filter(F.col(column) >= F.col("cut")).drop("cut")


def _itemset_rows(df: DataFrame, k: int, min_count: int) -> DataFrame:
    """(basket_id, set) of the k-itemsets that a basket holds, without most of those in fewer than min_count baskets.

    Baskets keep their common items alone. A set is grown inside the row that holds the rest of its basket, and only if it is frequent itself
    among the baskets that have enough left to fill it up to k."""
    base = df.filter(F.size("items") >= k).select("basket_id", "items")
    common = item_counts(base).filter(F.col("frequency") >= min_count).select("item")
    rows = base.select("basket_id", F.explode("items").alias("item")).join(common, "item", "left_semi")
    if k == 1:
        return rows.select("basket_id", F.array("item").alias("set"))
    held = rows.filter(F.col("basket_id").isNotNull()).groupBy("basket_id").agg(F.sort_array(F.collect_set("item")).alias("rest")).filter(F.size("rest") >= k)
    sets = held.select("basket_id", F.array().cast("array<string>").alias("set"), "rest")
    for size in range(1, k + 1):
        more = F.transform("rest", lambda x, i: F.struct(F.concat(F.col("set"), F.array(x)).alias("set"), F.slice(F.col("rest"), i + 2, F.size("rest")).alias("rest")))
        fit = F.slice(more, 1, F.size("rest") - (k - size))
        grown = sets.select("basket_id", F.explode(fit).alias("g")).select("basket_id", "g.set", "g.rest")
        if 1 < size < k:
            frequent = grown.groupBy("set").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).select("set")
            grown = grown.join(frequent, "set", "left_semi")
        sets = grown
    return sets.select("basket_id", "set")


def itemsets(df: DataFrame, k: int, min_count: int) -> DataFrame:
    """(items, n) of k-itemsets in at least min_count baskets."""
    sets = _itemset_rows(df, k, min_count)
    return sets.groupBy(F.col("set").alias("items")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def multi_lift(sets: DataFrame, freq: DataFrame, n: DataFrame) -> DataFrame:
    """P(all) / product of P(item) for itemsets (items, n)."""
    x = sets.select("items", "n", F.posexplode("items").alias("i", "item")).join(freq, "item")
    x = x.groupBy("items", "n").agg(F.sort_array(F.collect_list(F.struct("i", "frequency"))).alias("f")).crossJoin(F.broadcast(n))
    total = F.col("n_baskets").cast("double")
    lift = F.aggregate("f", F.col("n") / total, lambda acc, f: acc * total / f["frequency"])
    return x.select("items", "n", lift.alias("lift"))


def condition_table(df: DataFrame, conditions: list[Condition] = CONDITIONS) -> DataFrame:
    """Every basket once for each condition it meets: one pass answers all conditions."""
    met = [F.when(reduce(lambda a, b: a & b, [F.size("items") >= c.min_items] + ([F.size("items") <= c.max_items] if c.max_items else []) + ([F.col("flag")] if c.require_flag else [])), F.lit(c.name)) for c in conditions]
    return df.withColumn("condition", F.explode(F.array_compact(F.array(*met))))


def condition_statistics(df: DataFrame) -> DataFrame:
    """Per condition: baskets, mean/median/max items, distinct items and pairs, density."""
    x = condition_table(df)
    size = F.size("items")
    sizes = x.groupBy("condition").agg(F.count("*").alias("n_baskets"), F.avg(size).alias("mean_items"), F.percentile(size, 0.5).alias("median_items"), F.max(size).cast("long").alias("max_items"))
    nodes = item_counts(x, "condition").groupBy("condition").agg(F.count("*").alias("nodes"))
    edges = exploded_pairs(x, "condition").distinct().groupBy("condition").agg(F.count("*").alias("edges"))
    out = sizes.join(nodes, "condition").join(edges, "condition", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return out.withColumn("density", F.coalesce(F.try_divide(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)))


def choose_min_count(lift_rows: DataFrame) -> DataFrame:
    """Of thresholds (min_count, pair_count) rows: the first without single-count pairs, else the best by (median, fewest singles, threshold)."""
    g = lift_rows.groupBy("min_count").agg(F.percentile("pair_count", 0.5).alias("median_count"), F.avg((F.col("pair_count") == 1).cast("double")).alias("single_ratio"))
    clean = F.col("single_ratio") == 0
    order = [clean.cast("int").desc(), F.when(clean, F.col("min_count")).asc(), F.col("median_count").desc(), F.col("single_ratio").asc(), F.col("min_count").desc()]
    return g.orderBy(*order).limit(1).withColumn("reason", F.when(clean, "no single-count pair").otherwise("best median"))


def lift_lists(df: DataFrame, min_counts: DataFrame, k: int) -> DataFrame:
    """Per condition and least count (min_count): the k pairs of the highest lift."""
    x = pair_statistics(condition_table(df).select("condition", "basket_id", "items"), "condition")
    x = x.crossJoin(F.broadcast(min_counts)).filter("pair_count >= min_count")
    return top_pairs(x, "lift", k, "condition", "min_count")


def presence(df: DataFrame, conditions: list[Condition] = CONDITIONS) -> DataFrame:
    """Per pair: in which conditions it occurs."""
    x = exploded_pairs(condition_table(df, conditions), "condition")
    return x.groupBy(*PAIR).agg(*[F.bool_or(F.col("condition") == c.name).alias(f"{c.name}_present") for c in conditions])


def itemset_baskets(df: DataFrame, k: int, min_count: int) -> DataFrame:
    """(items, basket_id) of the baskets that hold a whole k-itemset found in at least min_count baskets: the rows that were counted, so that no
    set meets a basket without it."""
    sets = _itemset_rows(df, k, min_count)
    kept = sets.groupBy("set").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    return sets.join(kept, "set", "left_semi").select(F.col("set").alias("items"), "basket_id")


def renamed(df: DataFrame, names: DataFrame, *keep: str) -> DataFrame:
    """Baskets with their items under canonical names (item, canonical); items without one stay."""
    x = df.select("basket_id", *keep, F.explode("items").alias("item")).join(names, "item", "left")
    return x.groupBy("basket_id", *keep).agg(F.sort_array(F.collect_set(F.coalesce("canonical", "item"))).alias("items"))


def renaming_impact(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """One row: distinct items and pairs of both sets of baskets, and what their top k by support and by lift share."""
    tops, out = [], None
    for side, df in (("before", before), ("after", after)):
        pairs = exploded_pairs(df).groupBy(*PAIR).agg(F.count("*").alias("pair_count"))
        stats = statistics_of(pairs, items_and_total(df))
        tops += [top_pairs(stats, score, k).select(F.lit(score).alias("score"), "pair_key", F.lit(side).alias("side")) for score in ("support", "lift")]
        row = item_counts(df).agg(F.count("*").alias(f"items_{side}")).crossJoin(F.broadcast(pairs.agg(F.count("*").alias(f"pairs_{side}"))))
        out = row if out is None else out.crossJoin(F.broadcast(row))
    sides = reduce(DataFrame.unionByName, tops).groupBy("score", "pair_key").agg(F.count("*").alias("n"))
    of = lambda s: F.try_divide(F.count_if((F.col("score") == s) & (F.col("n") == 2)), F.count_if(F.col("score") == s)).alias(f"jaccard_{s}")
    return out.crossJoin(F.broadcast(sides.agg(of("support"), of("lift"))))
