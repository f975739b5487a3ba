"""Streaming queries: appends of the events table in micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.plans import fixtures as X
from gridloom.plans.catalog import query
from gridloom.plans.storage import shared_dir
from gridloom.streaming import appends as A


@query("SELECT event_id AS id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events")
def append_stream(spark, sf_dir):
    """The events, appended to a layer one file a micro-batch, and read back."""
    base = f"{shared_dir(spark)}/gridloom/stream-{uuid.uuid4().hex}"
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    e.repartitionByRange(4, "id").write.parquet(f"{base}/in")
    A.append_stream(A.read_files(spark, f"{base}/in", e.schema), f"{base}/layer", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/layer").select("id", "event_type", "cents")


@query("WITH f AS (SELECT 2 * event_id - event_id % 3 AS id, event_id, event_type FROM events), m AS (SELECT id, arg_min(event_type, event_id) AS event_type FROM f GROUP BY id) SELECT event_id AS id, event_type FROM events UNION ALL SELECT id, event_type FROM m WHERE id NOT IN (SELECT event_id FROM events)")
def append_dedupe(spark, sf_dir):
    """All events held, and a batch whose ids partly repeat and partly are held already."""
    e = X.table(spark, sf_dir, "events")
    held = e.select(F.col("event_id").alias("id"), "event_type")
    batch = e.select((2 * F.col("event_id") - F.col("event_id") % 3).alias("id"), "event_id", "event_type")
    first = batch.groupBy("id").agg(F.min_by("event_type", "event_id").alias("event_type"))
    return A.dedupe_append(held, first)
