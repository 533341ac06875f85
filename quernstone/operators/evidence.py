"""Sentence evidence for pairs: which documents mention both items in one sentence, and what the sentence says.

Items are extracted once per sentence; pairs of a document then meet its sentences by key, so cost follows the text and not
pairs x documents x sentences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .association import PAIR, exploded_pairs, item_pairs, pair_key

FLAGS = ("has_positive", "has_negative", "has_role", "has_explicit_mix", "is_template")


def named_sentences(docs: DataFrame, extract, text_col: str = "text", marks: str = "。！？!?", *keep: str) -> DataFrame:
    """(doc_id, keep, sentence_index, sentence, items) of each sentence, and one row without a sentence for a text that has none."""
    s = docs.select("doc_id", *keep, F.posexplode_outer(t.sentences(F.col(text_col), marks)).alias("sentence_index", "sentence"))
    return s.withColumn("items", extract("sentence"))


def described(s: DataFrame, analyse, templates: tuple[list[str], list[str]], roles: tuple[list[str], list[str]]) -> DataFrame:
    """Those of named_sentences() with an item, and what they say."""
    s = s.filter(F.size("items") > 0).withColumn("a", analyse("sentence"))
    role = t.role_rule(F.col("sentence"), *roles)
    return s.select("doc_id", "sentence_index", "sentence", "items", "a.matched", "a.negated", "a.has_positive", "a.has_negative", role.alias("role_rule"), (role != "").alias("has_role"), t.template_hit(F.col("sentence"), *templates).isNotNull().alias("is_template"))


def sentence_table(docs: DataFrame, extract, analyse, templates: tuple[list[str], list[str]], roles: tuple[list[str], list[str]], text_col: str = "text", marks: str = "。！？!?") -> DataFrame:
    """(doc_id, sentence_index, sentence, items, matched, negated, flags) of each sentence with an item."""
    return described(named_sentences(docs, extract, text_col, marks), analyse, templates, roles)


def evidence_rows(docs: DataFrame, sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each pair, document and sentence that has both items or, if the document has no such sentence, either.

    docs: (doc_id, items); pairs: the retained (item_a, item_b)."""
    own = docs.filter(F.size("items") >= 2).select("doc_id", F.explode(item_pairs()).alias("p")).select("doc_id", "p.*").join(pairs.select(*PAIR), [*PAIR], "left_semi")
    together = exploded_pairs(sentences, "doc_id").distinct().withColumn("doc_has_same", F.lit(True))
    x = own.join(together, ["doc_id", *PAIR], "left").fillna(False, ["doc_has_same"]).join(sentences, "doc_id")
    a, b = F.array_contains("items", F.col("item_a")), F.array_contains("items", F.col("item_b"))
    x = x.filter(F.when(F.col("doc_has_same"), a & b).otherwise(a | b)).withColumn("same_sentence", F.col("doc_has_same"))
    mix = t.explicit_mix(F.col("sentence"), F.col("item_a"), F.col("item_b"))
    return x.withColumn("explicit_text", mix).withColumn("has_explicit_mix", F.col("same_sentence") & mix.isNotNull()).withColumn("pair_key", pair_key())


def pair_features(rows: DataFrame, pair_counts: DataFrame) -> DataFrame:
    """Counts and ratios per pair. Documents' counts come from non-template same-sentence rows, or from the others where a document has no
    same-sentence row at all; sentences are counted before duplicates are removed."""
    good = ~F.col("is_template")
    same = F.col("same_sentence")
    per_doc = rows.groupBy(*PAIR, "doc_id").agg(
        F.bool_or(same).alias("cooccurs"),
        F.bool_or(same & good).alias("evidence"),
        *[F.bool_or(same & good & F.col(f)).alias(f"same_{f}") for f in FLAGS[:4]],
        *[F.bool_or(good & F.col(f)).alias(f"doc_{f}") for f in FLAGS[:3]],
        *[F.count_if(same & good & F.col(f)).alias(f"rows_{f}") for f in FLAGS[:4]],
        F.count_if(F.col("is_template")).alias("template_rows"),
    )
    flags = ["cooccurs", "evidence", *[f"same_{f}" for f in FLAGS[:4]], *[f"doc_{f}" for f in FLAGS[:3]]]
    x = per_doc.groupBy(*PAIR).agg(*[F.count_if(c).alias(f"{c}_docs") for c in flags], *[F.sum(c).alias(c) for c in [*[f"rows_{f}" for f in FLAGS[:4]], "template_rows"]])
    x = pair_counts.join(x, [*PAIR], "left")
    x = x.fillna(0, [c for c in x.columns if c not in pair_counts.columns])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return x.withColumns({f"same_{f}_ratio": ratio(f"same_{f}_docs", "evidence_docs") for f in FLAGS[:3]} | {f"doc_{f}_ratio": ratio(f"doc_{f}_docs", "pair_count") for f in FLAGS[:3]})


def pair_flags(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: product_name_derived (both items in title or summary of a shared document), has_explicit_mix, excluded, parent_child_pair.
    docs: (doc_id, items, title_items, summary_items)."""
    own = docs.filter(F.size("items") >= 2).select("doc_id", F.array_union("title_items", "summary_items").alias("named"), F.explode(item_pairs()).alias("p")).select("named", "p.*")
    named = own.groupBy(*PAIR).agg(F.bool_or(F.array_contains("named", F.col("item_a")) & F.array_contains("named", F.col("item_b"))).alias("product_name_derived"))
    explicit = rows.groupBy(*PAIR).agg(F.bool_or(F.col("has_explicit_mix") & ~F.col("is_template")).alias("has_explicit_mix"))
    x = pairs.join(named, [*PAIR], "left").join(explicit, [*PAIR], "left").fillna(False, ["product_name_derived", "has_explicit_mix"])
    return x.withColumn("excluded", F.col("product_name_derived") & ~F.col("has_explicit_mix")).withColumn("parent_child_pair", t.parent_child(F.col("item_a"), F.col("item_b")))


def deduplicated(rows: DataFrame) -> DataFrame:
    """Equal sentences of a pair and document once: flags are joined by or, texts merged."""
    keys = [*PAIR, "pair_key", "doc_id", "sentence", "same_sentence"]
    return rows.groupBy(*keys).agg(F.min("sentence_index").alias("sentence_index"), *[F.bool_or(f).alias(f) for f in FLAGS], t.merged(F.flatten(F.collect_list("matched"))).alias("matched"), t.merged(F.flatten(F.collect_list("negated"))).alias("negated"))


def representative_contexts(rows: DataFrame, k: int = 3) -> DataFrame:
    """Up to k sentences per pair, greedily in order: first rows whose sentence and document are both new, then rows whose sentence is new.

    Order: same sentence, not template, explicit, role, positive, then document and place. A row that is taken has fewer than k other
    sentences of its document and fewer than k other documents of its sentence before it, and with both ranks at most k only
    k + 2 * k * k rows can come before the last one taken; so each pair's list is short whatever the number of its rows."""
    order = [F.desc("same_sentence"), F.asc("is_template"), F.desc("has_explicit_mix"), F.desc("has_role"), F.desc("has_positive"), F.asc("doc_id"), F.asc("sentence_index")]
    w = lambda *keys: Window.partitionBy(*PAIR, *keys).orderBy(*order)
    x = rows.withColumn("r", F.row_number().over(w("sentence", "doc_id"))).filter("r = 1")
    x = x.withColumns({"r": F.row_number().over(w("sentence")), "of_doc": F.row_number().over(w("doc_id"))}).filter((F.col("r") <= k) & (F.col("of_doc") <= k))
    x = x.withColumn("r", F.row_number().over(w())).filter(F.col("r") <= k + 2 * k * k).drop("of_doc")
    short = F.array_sort(F.collect_list(F.struct("r", "sentence", "doc_id")))
    none = F.array().cast(f"array<struct<r:int,sentence:string,doc_id:{rows.schema['doc_id'].dataType.simpleString()}>>")

    def taking(new):
        return lambda acc, y: F.when((F.size(acc) < k) & new(acc, y), F.concat(acc, F.array(y))).otherwise(acc)

    new_sentence = lambda acc, y: ~F.exists(acc, lambda z: z["sentence"] == y["sentence"])
    new_both = lambda acc, y: ~F.exists(acc, lambda z: (z["sentence"] == y["sentence"]) | (z["doc_id"] == y["doc_id"]))
    picks = x.groupBy(*PAIR).agg(short.alias("all")).withColumn("first", F.aggregate("all", none, taking(new_both)))
    picks = picks.select(*PAIR, F.posexplode(F.aggregate("all", F.col("first"), taking(new_sentence))).alias("i", "pick"))
    return x.join(picks.select(*PAIR, F.col("pick.r").alias("r"), (F.col("i") + 1).alias("rank")), [*PAIR, "r"]).drop("r")
