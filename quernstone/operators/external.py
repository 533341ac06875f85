"""Pairs from an external source's table cells: statuses, unique pairs, repetition, and what a larger dictionary would change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import text as t


def header_joined(cells: DataFrame) -> DataFrame:
    """Data cells with their column's header; the header is the row with the smallest index of a table."""
    x = cells.withColumn("head_row", F.min("row_index").over(Window.partitionBy("article_id", "table_index")))
    head = x.filter(F.col("row_index") == F.col("head_row")).select("article_id", "table_index", "cell_index", F.col("cell_text").alias("header"))
    return x.filter(F.col("row_index") > F.col("head_row")).drop("head_row").join(head, ["article_id", "table_index", "cell_index"], "left")


def extracted_pairs(articles: DataFrame, cells: DataFrame, normalise) -> DataFrame:
    """A row for each name in each recommended data cell, with status ok, unresolved or excluded and the first reason that holds.

    articles: (article_id, target_raw); cells: (article_id, table_index, row_index, cell_index, cell_text, is_recommended);
    normalise: a function of a column to the registered name, blank if there is none."""
    x = header_joined(cells).filter("is_recommended")
    token = F.explode_outer(F.when(t.utrim("cell_text").isin(k.NONE_MARKERS), F.array(t.utrim("cell_text"))).otherwise(t.cell_tokens(F.col("cell_text"))))
    x = x.select("article_id", "table_index", "row_index", "cell_index", "header", "cell_text", token.alias("raw")).join(articles.select("article_id", "target_raw"), "article_id", "left")
    x = x.withColumn("target", normalise(F.coalesce("target_raw", F.lit("")))).withColumn("recommended", normalise(F.coalesce("raw", F.lit(""))))
    reason = (
        F.when(F.coalesce("raw", F.lit("")) == "", "empty_cell")
        .when(F.col("raw").isin(k.NONE_MARKERS), "explicit_none_marker")
        .when(t.utrim(F.coalesce("target_raw", F.lit(""))) == "", "missing_target_flavor")
        .when(F.col("target") == "", "target_flavor_unregistered")
        .when(F.col("recommended") == "", "recommended_flavor_unregistered")
        .when(F.col("target") == F.col("recommended"), "self_pair")
        .when(t.parent_child(F.col("target"), F.col("recommended")), "parent_child_pair")
    )
    x = x.withColumn("exclusion_reason", F.coalesce(reason, F.lit("")))
    unresolved = F.col("exclusion_reason").isin("missing_target_flavor", "target_flavor_unregistered", "recommended_flavor_unregistered")
    x = x.withColumn("status", F.when(F.col("exclusion_reason") == "", "ok").when(unresolved, "unresolved").otherwise("excluded"))
    ok = F.col("status") == "ok"
    x = x.withColumn("pair_key", F.when(ok, t.ordered_key(F.col("target"), F.col("recommended"))).otherwise("")).withColumn("directed_key", F.when(ok, t.directed_key(F.col("target"), F.col("recommended"))).otherwise(""))
    w = Window.partitionBy("article_id", "directed_key").orderBy("table_index", "row_index", "cell_index", "raw")
    return x.withColumn("is_duplicate", ok & (F.row_number().over(w) > 1))


def unique_pairs(extracted: DataFrame) -> DataFrame:
    x = extracted.filter("status = 'ok'")
    return x.groupBy("pair_key").agg(F.countDistinct("article_id").alias("n_articles"), F.count("*").alias("n_rows"), F.array_join(F.sort_array(F.collect_set("article_id")), "|").alias("articles"))


def extraction_summary(extracted: DataFrame) -> DataFrame:
    s = lambda v: F.count_if(F.col("status") == v).alias(v)
    return extracted.agg(F.count("*").alias("rows"), s("ok"), s("unresolved"), s("excluded"), F.countDistinct(F.when(F.col("status") == "ok", F.col("pair_key"))).alias("unique_pairs"), F.count_if("is_duplicate").alias("duplicates"))


def repetition(extracted: DataFrame) -> DataFrame:
    """Per pair: rows, articles, repeats within an article."""
    per = extracted.filter("status = 'ok'").groupBy("pair_key", "article_id").agg(F.count("*").alias("n"))
    return per.groupBy("pair_key").agg(F.sum("n").alias("rows"), F.count("*").alias("articles"), F.sum(F.col("n") - 1).alias("repeats_within"), F.max("n").alias("most_within")).withColumn("multi_article", F.col("articles") > 1)


def what_if(extracted: DataFrame, ranking: DataFrame, scenarios: dict[str, dict[str, str]]) -> DataFrame:
    """Per scenario: valid rows, unique pairs and pairs shared with the ranking if its overrides named the unresolved names."""
    spark = extracted.sparkSession
    grid = spark.createDataFrame([(n, m) for n, m in scenarios.items()], "scenario string, names map<string,string>")
    x = extracted.crossJoin(F.broadcast(grid))
    fill = lambda cur, raw: F.coalesce(F.nullif(F.col(cur), F.lit("")), F.try_element_at("names", t.utrim(F.col(raw))), F.lit(""))
    x = x.withColumn("a", fill("target", "target_raw")).withColumn("b", fill("recommended", "raw"))
    fixed = ~F.col("exclusion_reason").isin("empty_cell", "explicit_none_marker", "missing_target_flavor")
    valid = fixed & (F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b")) & ~t.parent_child(F.col("a"), F.col("b"))
    x = x.withColumn("k", F.when(valid, t.ordered_key(F.col("a"), F.col("b"))))
    known = ranking.select(F.col("pair_key").alias("k")).distinct().withColumn("hit", F.lit(True))
    return x.join(known, "k", "left").groupBy("scenario").agg(F.count("k").alias("valid_rows"), F.countDistinct("k").alias("unique_pairs"), F.countDistinct(F.when(F.col("hit"), F.col("k"))).alias("common_pairs"))


def deduplicate_articles(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds kept_order: the first kept row that shares any key, in order; a removed row doesn't register its keys.

    Rows whose keys nobody shares stay without further work. Of the others, groups joined by any key are walked in order; a group is
    what shares keys transitively, and is small, since keys are URLs, titles and text digests."""
    import pandas as pd

    from .graph import components

    rows = df.select(F.col(order).alias("node"), *keys)
    long = rows.select("node", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(keys)])).alias("x")).select("node", "x.*").filter("coalesce(v, '') <> ''")
    first = long.groupBy("i", "v").agg(F.min("node").alias("item_a"), F.count("*").alias("n")).filter("n > 1")
    edges = long.join(first, ["i", "v"]).filter("node > item_a").select("item_a", F.col("node").alias("item_b")).distinct()
    grouped = rows.join(components(edges), "node")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict = {}
        out = []
        for r in pdf.sort_values("node").to_dict("records"):
            own = [(c, str(r[c])) for c in keys if r[c] is not None and str(r[c]) != ""]
            hit = next((known[x] for x in own if x in known), None)
            if hit is None:
                known |= {x: r["node"] for x in own if x not in known}
            out.append((r["node"], r["node"] if hit is None else hit))
        return pd.DataFrame(out, columns=["node", "kept_order"])

    walked = grouped.select("component", "node", *keys).groupBy("component").applyInPandas(walk, "node long, kept_order long")
    return df.join(walked.withColumnRenamed("node", order), order, "left").withColumn("kept_order", F.coalesce("kept_order", F.col(order)))
