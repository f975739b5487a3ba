"""Stored intermediate tables and dense row numbers, without a single-partition window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (tests) a local folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage, and rows that never change."""
    path = f"{shared_dir(df.sparkSession)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Remove a table made by :func:`stored` that nothing refers to any more."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def dense_index(df: DataFrame, order: list[str | Column], name: str = "id", start: int = 0) -> DataFrame:
    """Number rows from ``start`` in a total order.

    Rows are dealt out by range and numbered inside their range; ranges get offsets from a table of one row per
    task. Nothing passes through one task but that table.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").count()
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__inside", inside).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__inside") + (start - 1)).drop("__part", "__inside", "__before")
