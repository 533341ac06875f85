"""Quality rules with cross-document line frequency. DataFrame functions only.

Base rules look at one document (too few words, or too many words in repeated 5-word windows). The cross-document rule
hashes normalised lines, counts the distinct texts of a host that hold each, takes lines above the host's limit off every
document, and rejects a document that is depleted by it.

A host's limit is the larger of `min_texts` and `share` of its texts. Lines of any length count, and exact copies count as one text, so
copies of a clean document don't turn its lines into furniture; near copies do so only beyond the limit. A document is depleted if under `min_words` words
or under `min_left` of its words are left.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; repeated rows get the same
answer each; an empty table gives no rows; other columns stay, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import shielded
from .scratch import written

WS = r"[\x20\x09-\x0D]+"
#: Furniture lines up to which they are broadcast (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_LINES = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, WS, F.lit(" ")), F.lit(" ")))


def with_base_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Repeated windows: the document's window hashes are sorted with their places only if any occurs twice; each
    place then covers the words up to the next one, five at most. Nothing leaves the row.
    """
    x = df.withColumn("q_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("q_words", words(F.col("q_text")))
    x = x.withColumn("q_lines", lines_with_words(F.col("q_text")))
    at = lambda i, k: F.get(F.col("q_words"), i + k)
    five = F.transform(
        F.slice("q_words", F.lit(1), F.greatest(F.size("q_words") - 4, F.lit(0))),
        lambda w, i: F.xxhash64(w, at(i, 1), at(i, 2), at(i, 3), at(i, 4)),
    )
    x = x.withColumn("q_five", five)
    placed = F.array_sort(F.transform("q_five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    x = x.withColumn("q_placed", F.when(F.size(F.array_distinct("q_five")) < F.size("q_five"), placed).otherwise(none))
    near = lambda p, k, d: F.coalesce(F.get(F.col("q_placed"), k + d)["h"] == p["h"], F.lit(False))
    twice = F.filter("q_placed", lambda p, k: near(p, k, -1) | near(p, k, 1))
    x = x.withColumn("q_at", F.sort_array(F.transform(twice, lambda p: p["i"])))
    cover = F.transform("q_at", lambda i, k: F.least(F.lit(5), F.coalesce(F.get(F.col("q_at"), k + 1) - i, F.lit(5))))
    x = x.withColumns(
        {
            "n_words": F.size("q_words").cast("long"),
            "word_chars": F.length(F.array_join("q_words", "")).cast("long"),
            "n_symbols": F.regexp_count("q_text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(cover, F.lit(0), lambda a, b: a + b).cast("long"),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return x.withColumn("base_failed", failed).drop("q_five", "q_placed", "q_at")


def text_lines(df: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """(host, text hash, line hash) of each line, once per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(host_col).alias("q_host"), F.xxhash64(text).alias("q_copy"), lines_with_words(text).alias("q_lines"))


def furniture(df: DataFrame, text_col: str = "text", host_col: str = "source", share: float = 0.005, min_texts: int = 10) -> DataFrame:
    """(host, line hash) of the lines above their host's limit.

    (host, line, text) is made distinct and then counted; both steps sum within tasks first, and the key of a host that
    holds a third of the rows is spread by its lines.
    """
    x = text_lines(df, text_col, host_col)
    rows = x.select("q_host", "q_copy", F.explode(F.array_distinct(F.transform("q_lines", lambda y: F.xxhash64(normalised(y))))).alias("q_line")).distinct()
    found = rows.groupBy("q_host", "q_line").agg(F.count("*").alias("n")).filter(F.col("n") > min_texts)
    hosts = x.select("q_host", "q_copy").distinct().groupBy("q_host").agg(F.count("*").alias("texts"))
    over = found.join(hosts, found["q_host"].eqNullSafe(hosts["q_host"])).filter(F.col("n") > F.col("texts") * share)
    return over.select(found["q_host"], "q_line")


def with_verdict(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = 0.005, min_texts: int = 10, min_words: int = 10, min_left: float = 0.3) -> DataFrame:
    """Adds the base rules' columns, n_line_words (words in furniture lines), left_text (the text without those lines), n_left and kept."""
    df, back = shielded(df, "q_", id_col, text_col, host_col)
    bad = written(furniture(df, text_col, host_col, share, min_texts), "furniture")
    base = with_base_rules(df, text_col)
    if bad.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        by_host = bad.groupBy("q_host").agg(F.collect_set("q_line").alias("q_bad"))
        base = base.join(F.broadcast(by_host.withColumnRenamed("q_host", "q_of")), F.col(host_col).eqNullSafe(F.col("q_of")), "left").drop("q_of")
    else:
        hashes = F.array_distinct(F.transform("q_lines", lambda y: F.xxhash64(normalised(y))))
        rows = base.select(F.col(id_col).alias("q_i"), F.col(host_col).alias("q_h"), F.xxhash64("q_text").alias("q_c"), F.explode(hashes).alias("q_line"))
        hits = rows.join(bad, rows["q_h"].eqNullSafe(bad["q_host"]) & (rows["q_line"] == bad["q_line"]), "left_semi")
        per = hits.groupBy("q_i", "q_h", "q_c").agg(F.collect_set("q_line").alias("q_bad"))
        base = base.join(per, F.col(id_col).eqNullSafe(F.col("q_i")) & F.col(host_col).eqNullSafe(F.col("q_h")) & (F.xxhash64("q_text") == F.col("q_c")), "left").drop("q_i", "q_h", "q_c")
    hit = lambda y: F.coalesce(F.array_contains(F.col("q_bad"), F.xxhash64(normalised(y))), F.lit(False))
    gone = F.when(F.col("q_bad").isNull(), F.lit(0)).otherwise(F.aggregate("q_lines", F.lit(0), lambda a, y: a + F.when(hit(y), F.size(words(y))).otherwise(F.lit(0))))
    base = base.withColumn("n_line_words", gone.cast("long"))
    rest = F.array_join(F.filter(F.split("q_text", "\n"), lambda y: ~hit(y)), "\n")
    base = base.withColumn("left_text", F.when(F.col("n_line_words") > 0, rest).otherwise(F.col(text_col))).drop("q_bad")
    base = base.withColumn("n_left", F.col("n_words") - F.col("n_line_words")).drop("q_text", "q_words", "q_lines")
    depleted = (F.col("n_left") < min_words) | (F.col("n_left") < min_left * F.col("n_words"))
    return base.withColumn("kept", ~F.col("base_failed") & ~depleted).withColumnsRenamed(back)


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "left_text", "n_left", "kept"]


def kept_documents(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The rows of df that pass, with its columns; furniture lines are taken off their texts, and chars_col, where there is one, follows.
    The judged table is written and reread: a filter over the projections would be moved below them, where each name is replaced by
    its whole expression again and again."""
    own = {c: f"own_{c}" if c in RESULTS else c for c in df.columns}
    out = with_verdict(df.withColumnsRenamed({c: o for c, o in own.items() if o != c}), text_col=own[text_col], **options)
    chars = F.when(F.col("n_line_words") > 0, F.length("left_text")).otherwise(F.col(own[chars_col])) if chars_col in own else None
    new = {text_col: F.col("left_text"), chars_col: chars}
    judged = written(out.select(*[(new[c].cast(df.schema[c].dataType) if c in new else F.col(o)).alias(o) for c, o in own.items()], F.col("kept").alias("q_kept")), "judged")
    return judged.filter("q_kept").select(*[F.col(o).alias(c) for c, o in own.items()])
