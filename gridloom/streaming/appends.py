"""Appends to a layer, as Structured Streaming: ids are new or the batch is refused, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DuplicateId(ValueError):
    pass


def check_new(batch: DataFrame, held: DataFrame | None, key: str = "id") -> None:
    """Raise if an id repeats in the batch or is held already; nothing is written before."""
    twice = batch.groupBy(key).count().filter("count > 1").select(key)
    known = None
    if held is not None:  # ids ascend as a rule: files whose range the batch doesn't touch aren't read
        low, high = batch.agg(F.min(key), F.max(key)).first()
        if low is not None:
            known = batch.join(held.select(key).filter(F.col(key).between(low, high)), key, "left_semi").select(key)
    bad = (twice if known is None else twice.union(known)).limit(1).collect()
    if bad:
        raise DuplicateId(f"duplicate id {bad[0][0]}")


def appender(path: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends to a Parquet layer.

    A batch is written under its number, so that a batch that Spark repeats after a failure replaces itself.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            held = spark.read.parquet(path).filter(F.col("batch") != number)
        except Exception as e:  # no batch yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            held = None
        rows = batch.persist()
        try:
            check_new(rows, held, key)
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            rows.unpersist()

    return append


def append_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "id"):
    """Start the append query over all that is available."""
    return stream.writeStream.foreachBatch(appender(path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pass_through(stream: DataFrame, name: str, checkpoint: str | None = None):
    """Rows of each micro-batch to a memory table, nothing retained by the query itself."""
    w = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dedupe_append(held: DataFrame, batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """``held`` with the rows of ``batch`` whose id is new; of repeated ids the first by ``order``."""
    first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order or key).alias("r")).select("r.*")
    return held.unionByName(first.join(held.select(key), key, "left_anti"))
