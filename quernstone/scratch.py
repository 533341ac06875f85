"""Intermediate tables in the folder all executors share (spark.checkpoint.dir).

A lost executor's rows are reread from there instead of being computed again through a long lineage, and a small table that
many parts of a plan need is computed once.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local session gets a temporary folder, as in tests, and a cluster an error."""
    sc = spark.sparkContext
    path = spark.conf.get(KEY, None) or sc.getConf().get(KEY) or sc.getCheckpointDir()
    if not path:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError(f"set {KEY} to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, large: bool = False, group_bytes: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again. Its files stay until forget() or the folder's own cleaning.
    large: the step shuffled much, so its shuffle files are let go at once. group_bytes: of Parquet row groups, for tables of large cells,
    which are stored with a denser compression."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quernstone/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.size", str(group_bytes)).option("compression", "zstd") if group_bytes else df.write
    writer.parquet(path)
    if large:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps, which otherwise wait for the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*frames: DataFrame) -> None:
    """Deletes the tables that written() made of these frames."""
    for df in frames:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/quernstone/" in f}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
