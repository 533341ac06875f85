"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source of size S with weight w gets the mean repetition rate w * total / S. Each document draws its number of copies by
inverting the Poisson distribution of that mean at a uniform number hashed from (seed, doc_id, part); it is exploded by
that count, and the copies are dealt out and sorted by a hash of (seed, doc_id, copy), which is a global shuffle.
The draw needs no state: any task, also one that runs again, gives the same copies.

Defined results: a null source is a source of its own; null or empty texts have size 0, and a source of size 0 keeps the
rate 1; repeated rows draw the same count and keys; an empty table gives no rows; a row without an id draws by its text's hash;
all columns are kept, those that begin like the operator's own (mix_) under names that begin with own_. Means over `part` are split
into independent draws, since exp(-mean) would vanish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import shielded
from .scratch import written

#: Sources up to which their rates are broadcast (about 1 KB each); beyond it they are joined by a salted shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 32


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of md5 over the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def shuffle_key(*parts: Column) -> Column:
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sizes(df: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, size): characters of each source; a row for each source and task before the shuffle."""
    return df.groupBy(df[source_col].alias("mix_source")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("size"))


def rates(size: DataFrame, weights: dict | None = None, temperature: float = 0.5, budget: float = 1.0) -> DataFrame:
    """(mix_source, mix_rate). weights: target share by source, those left out get none; None: size ** temperature, made to sum to 1.
    budget: the mixture's expected size, as a multiple of the corpus."""
    if weights is None:
        w = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("mix_source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(w)
    x = size.withColumn("weight", w)
    total = x.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.lit(budget) * F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")
    return x.crossJoin(F.broadcast(total)).select("mix_source", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)).alias("mix_rate"))


def poisson_table(rate: DataFrame, part: float = 200.0) -> DataFrame:
    """Adds mix_parts (draws to add up) and mix_cdf (of one part's mean, until what is left is under 2 ** -53 of it)."""
    mean = F.col("mix_rate") / F.col("mix_parts")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    x = rate.withColumn("mix_parts", F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / part).cast("int"))).withColumn("mean", mean).withColumn("last", last)
    cdf = F.aggregate(F.sequence(F.lit(1), F.col("last")), start, step)["cdf"]
    return x.select("mix_source", "mix_rate", "mix_parts", cdf.alias("mix_cdf"))


def draw_name(id_col: Column, text: Column) -> Column:
    """What a row draws by: its id, else its text."""
    return F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))


def replicate(df: DataFrame, table: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """Each row as often as its draw says, with mix_copy (from 1) and mix_key."""
    names = df.columns
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        x = df.join(F.broadcast(table), df[source_col].eqNullSafe(table["mix_source"]))
    else:
        salted = table.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = df.withColumn("mix_salt", F.pmod(F.xxhash64(draw_name(df[id_col], df[text_col])), F.lit(SALTS)).cast("int"))
        x = left.join(salted, left[source_col].eqNullSafe(salted["mix_source"]) & (left["mix_salt"] == salted["mix_salt"]))
        x = x.select(*[left[c] for c in names], "mix_rate", "mix_parts", "mix_cdf")
    name = draw_name(F.col(id_col), F.col(text_col))
    draw = lambda j: F.get(F.transform(F.array(uniform(F.lit(seed), name, j)), lambda u: F.size(F.filter(F.col("mix_cdf"), lambda c: c < u))), F.lit(0))
    # The number is bound as a lambda's argument: named as a column, it would be hashed again for each entry of the table.
    one = F.transform(F.array(uniform(F.lit(seed), name, F.lit(1))), lambda u: F.size(F.filter(F.col("mix_cdf"), lambda c: c < u)))
    x = x.withColumn(
        "mix_n",
        F.when(F.col("mix_parts") == 1, F.get(one, F.lit(0))).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.col("mix_parts")), F.lit(0), lambda acc, j: acc + draw(j))
        ),
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_n"))).alias("mix_copy")
    x = x.filter("mix_n > 0").select(*names, copies)
    return x.withColumn("mix_key", shuffle_key(F.lit(seed), F.lit("order"), draw_name(F.col(id_col), F.col(text_col)), F.col("mix_copy")))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict | None = None, temperature: float = 0.5, budget: float = 1.0, seed: int = 17) -> DataFrame:
    """The mixture, shuffled globally: mix_key is uniform over 60 bits, so its range is cut into equal stretches, a partition each, and
    sorted within them. The order of all rows is that of mix_key."""
    inner, _ = shielded(df, "mix_", id_col, source_col, text_col)
    size = written(sizes(inner, source_col, text_col), "sizes")  # the texts are read once for it
    out = replicate(inner, written(poisson_table(rates(size, weights, temperature, budget)), "rates"), id_col, source_col, text_col, seed)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(n, F.floor(F.col("mix_key") / float(1 << 60) * n).cast("int")).sortWithinPartitions("mix_key")


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The mixture with the columns of df alone."""
    back = shielded(df, "mix_", *[options.get(k, v) for k, v in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))])[1]
    return mix(df, **options).drop("mix_copy", "mix_key").withColumnsRenamed(back).select(*df.columns)
