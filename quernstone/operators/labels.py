"""A rule cascade that labels whether a text suggests two items together, and alias candidates between item names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


@dataclass(frozen=True)
class Rules:
    """Keyword lists of the cascade."""

    explicit: list[str] = field(default_factory=lambda: ["ミックス", "ブレンド", "組み合わせ", "合わせ", "混ぜ"])
    session: list[str] = field(default_factory=lambda: ["吸った", "吸いました", "作った", "試した"])
    listing: list[str] = field(default_factory=lambda: ["ラインナップ", "種類", "など", "一覧"])
    product: list[str] = field(default_factory=lambda: ["商品名", "フレーバー名", "という名前"])
    least: int = 18


def classified(df: DataFrame, title: str = "title", context: str = "context", a: str = "item_a", b: str = "item_b", rules: Rules | None = None) -> DataFrame:
    """Adds auto_label, auto_confidence, matched_rule and needs_review. Rules are tried in order; the first that holds decides."""
    r = rules or Rules()
    x, y, text = F.col(a), F.col(b), F.coalesce(F.col(context), F.lit(""))
    df = df.withColumn("_segments", t.segments(F.coalesce(F.col(title), F.lit("")), text))
    df = df.withColumn("_shared", F.filter("_segments", lambda s: F.contains(s, x) & F.contains(s, y)))
    whole = F.concat_ws("\n", F.col(title), text)
    has = lambda terms: t.any_term(whole, terms)
    shared = F.array_join("_shared", "\n")
    some = F.size("_shared") > 0
    q = lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))
    between = lambda gap: F.regexp_like(shared, F.concat(q(x), F.lit(gap), q(y))) | F.regexp_like(shared, F.concat(q(y), F.lit(gap), q(x)))
    separated = between(r"[ 　]*[×xX+＋/／&＆・、とに][ 　]*")
    compound = F.contains(whole, F.concat(x, y)) | F.contains(whole, F.concat(y, x))
    only_compound = compound & ~separated
    proportion = F.regexp_like(shared, F.lit(r"[0-9０-９]+\s*(?:[:：対]\s*[0-9０-９]+|割|%|％)"))
    sign = F.regexp_like(shared, F.lit("[×+＋/／]"))
    cases = [
        (t.utrim(text) == "", "unclear", "low", "title_only", True),
        (~(F.contains(whole, x) & F.contains(whole, y)), "unclear", "low", "missing_target_item", True),
        ((F.length(text) < r.least) & ~some, "unclear", "low", "context_too_short", True),
        (some & t.any_term(shared, r.explicit) & (separated | sign) & ~only_compound & t.any_term(shared, r.listing), "explicit_mix", "medium", "explicit_keyword_in_list", True),
        (some & t.any_term(shared, r.explicit) & (separated | sign) & ~only_compound, "explicit_mix", "high", "explicit_keyword", False),
        (some & proportion & ~only_compound, "probable_mix", "medium", "ratio", True),
        (some & has(r.session) & separated & ~only_compound & ~t.any_term(shared, r.product), "probable_mix", "medium", "session_separator", True),
        (has(r.listing), "co_mention_only", "high", "list_keyword", False),
        (some & t.any_term(shared, r.product), "co_mention_only", "medium", "product_keyword", False),
        (~some & only_compound, "unclear", "low", "product_name_ambiguity", True),
        (~some, "co_mention_only", "medium", "separate_context_mentions", False),
    ]
    found: Column | None = None
    for condition, *out in cases:
        label = F.struct(*[F.lit(v).alias(n) for n, v in zip(("auto_label", "auto_confidence", "matched_rule", "needs_review"), out, strict=True)])
        found = F.when(condition, label) if found is None else found.when(condition, label)
    rest = F.struct(F.lit("unclear").alias("auto_label"), F.lit("low").alias("auto_confidence"), F.lit("conflicting_rules").alias("matched_rule"), F.lit(True).alias("needs_review"))
    return df.withColumn("_found", found.otherwise(rest)).select(*[c for c in df.columns if not c.startswith("_")], "_found.*")


MATCHES = [("format", "high", t.format_key), ("symbol", "high", t.symbol_key), ("singular", "medium", t.singular_key), ("katakana", "medium", t.katakana_key)]


def alias_candidates(items: DataFrame) -> DataFrame:
    """(item_a, item_b, match, confidence) of item names (item, frequency) that agree in a key; the surest match of a pair stays.

    Joins are by equal keys, never all names with all."""
    out = None
    for order, (name, confidence, key) in enumerate(MATCHES):
        x = items.select("item", key(F.col("item")).alias("key")).filter("key <> ''")
        y = x.select(F.col("item").alias("item_a"), "key").join(x.select(F.col("item").alias("item_b"), "key"), "key").filter("item_a < item_b")
        y = y.select("item_a", "item_b", F.lit(order).alias("order"), F.lit(name).alias("match"), F.lit(confidence).alias("confidence"))
        out = y if out is None else out.unionByName(y)
    return out.groupBy("item_a", "item_b").agg(F.min_by("match", "order").alias("match"), F.min_by("confidence", "order").alias("confidence")).withColumn("manual", F.col("confidence") != "high")


def alias_map(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item, canonical) of names joined by sure candidates: Japanese before upper-case Latin before other names, then frequency, length, name."""
    from .graph import components

    sure = candidates.filter(~F.col("manual")).select("item_a", "item_b")
    c = components(sure).join(items, F.col("node") == F.col("item"))
    script = F.when(t.has_japanese(F.col("item")), 0).when(F.col("item") == F.upper("item"), 1).otherwise(2)
    best = c.groupBy("component").agg(F.min_by("item", F.struct(script, -F.col("frequency"), F.length("item"), F.col("item"))).alias("canonical"))
    return c.join(best, "component").select("item", "canonical")


def mapped_items(df: DataFrame, mapping: DataFrame, id_col: str) -> DataFrame:
    """(id, items, changed): baskets in canonical names, distinct and sorted."""
    x = df.select(id_col, F.explode_outer("items").alias("item")).join(mapping, "item", "left")
    return x.groupBy(id_col).agg(F.sort_array(F.collect_set(F.coalesce("canonical", "item"))).alias("items"), F.coalesce(F.bool_or(F.col("canonical") != F.col("item")), F.lit(False)).alias("changed"))
