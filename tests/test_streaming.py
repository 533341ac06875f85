from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.streaming import counts


def test_streamed_pairs_equal_the_batch_ones(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", u, t) for d in (1, 2) for h, u, t in ((1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "b"), (5, 2, "b"))]
    rows.append(("2024-02-01 00:00:00", 9, "z"))  # moves the watermark
    df = spark.createDataFrame(rows, "ts string, user long, kind string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = counts.basket_pairs(stream, time="ts", basket="user", item="kind").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.start.day, r.basket_id, r.item_a, r.item_b) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((d, 1, *p) for d in (1, 2) for p in (("a", "b"), ("a", "c"), ("b", "c")))
