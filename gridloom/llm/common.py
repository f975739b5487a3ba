"""Plumbing shared by the corpus operators: scratch tables, Arrow mapping, row identity.

Scratch tables replace lineage: a job that loses executors re-reads a committed Parquet table instead of
recomputing (or worse, re-randomising) what came before. They live under ``spark.checkpoint.dir``, the folder
that driver and executors share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a kernel at a time; bounds the Python objects alive per worker.
SLICE_ROWS = 256
BATCH_ROWS = 1000
#: ... and the UTF-8 bytes handed over at a time, so that very long texts come in slices of one row.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session that names none (tests) gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Shuffle partitions that one task takes up, where rows are few beside those that the partitions are made for.
PARTITIONS_A_FILE = 16


def gathered(df: DataFrame) -> DataFrame:
    """``df``, which comes out of a shuffle, in two tasks a core or one for PARTITIONS_A_FILE shuffle partitions,
    whichever are more: no rows are moved, and the number of files follows that of partitions, without tiny ones.

    Each file that a task writes starts three processes on a local path without Hadoop's native library.
    """
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_A_FILE))


def scratch(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it.

    ``narrow``: rows much smaller than what they were read from are gathered before they are written, so that each
    split of the corpus doesn't leave a tiny file.
    """
    spark = df.sparkSession
    df = gathered(df.hint("rebalance")) if narrow else df
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    if _collected:
        _collected[-1].append(out)
    return out


#: Scratch tables made since each :func:`only_result` that is running.
_collected: list[list[DataFrame]] = []


def only_result(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` plans, stored; every other scratch table made for it is removed."""
    _collected.append([])
    try:
        out = scratch(make(), name)
    finally:
        made = _collected.pop()
    for table in made:
        if table is not out:
            drop_scratch(table)
    return out


def drop_scratch(df: DataFrame) -> None:
    """Remove a table made by :func:`scratch` that nothing lazy refers to any more."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables, once no result that reads them is needed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gridloom")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, text: str, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that no slice has over ``rows`` rows or (but for one row) SLICE_BYTES of text."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > SLICE_BYTES or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python in batches of BATCH_ROWS rows: Spark's default of 10,000 whole texts costs hundreds of MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_texts(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` with ``kernel`` applied to memory-bounded slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, rows):
                yield kernel(part)
            pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of documents that no model may learn from: crc32(doc_id as text) mod 4 is 2.

    A null doc_id has no checksum and counts as held out.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def text_hash():
    """With doc_id, what tells rows from one another; rows alike in both are the same document twice."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


#: Most rows of the bitmap that tells which rows need no join; 64 bits each.
BITMAP_WORDS = 1 << 20


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, flag: str = "__maybe") -> DataFrame:
    """``rows`` with ``flag``: false only where the long ``key`` is surely none of ``keys`` (one long column, k).

    A bitmap of hashes answers, some 16 bits a key and BITMAP_WORDS words at most, whatever the corpus: where it fills
    up more rows are let through, and the join that follows decides. Whole texts stay out of that join's shuffle.
    """
    n = keys.count()
    words = min(BITMAP_WORDS, max(64, 1 << (n // 4).bit_length()))
    bit = lambda k: F.pmod(k, F.lit(words * 64))
    at = lambda k: (bit(k) % 64).cast("int")
    k = F.col("k")
    bitmap = keys.groupBy(F.expr(f"pmod(k, {words * 64}L) div 64").alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at(k))).alias("__bits"))
    found = rows.withColumn("__k", key).join(F.broadcast(bitmap), F.floor(bit(F.col("__k")) / 64) == F.col("__word"), "left")  # BITMAP_WORDS rows at most
    held = F.call_function("shiftrightunsigned", F.col("__bits"), at(F.col("__k"))).bitwiseAND(1) == 1
    return found.withColumn(flag, F.coalesce(held, F.lit(False))).drop("__k", "__word", "__bits")


def row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with __id and __hash, which tell rows from one another."""
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__hash": text_hash()})


def keep_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found`` (doc_id, text_hash, kept; a row per row) keeps, alike ones once, with the
    columns of ``docs``.

    Only rows that may have to go, or that repeat, are shuffled.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    named = found.groupBy(number.alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("n"), F.max("kept").alias("__stays"))
    doubtful = scratch(gathered(named.filter("n > 1 or not __stays").drop("n")), "doubtful")
    rows = maybe_in(row_keys(docs), F.col("__hash"), doubtful.select(F.col("__hash").alias("k")))
    asked = rows.filter("__maybe").join(doubtful, ["__id", "__hash"], "left").filter("coalesce(__stays, true)")
    return rows.filter("not __maybe").select(*docs.columns).union(gathered(asked.dropDuplicates(["__id", "__hash"]).select(*docs.columns)))


def pick_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) once for each row that ``wanted`` (doc_id, text_hash) names."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    wanted = scratch(gathered(wanted.select(number.alias("__id"), F.col("text_hash").alias("__hash")).distinct()), "wanted")
    rows = maybe_in(row_keys(docs.select("doc_id", "text")), F.col("__hash"), wanted.select(F.col("__hash").alias("k")))
    named = rows.filter("__maybe").join(wanted, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__hash").alias("text_hash"), "text")


def hash_sample(rows: DataFrame, wanted: int, *keys: str) -> DataFrame:
    """``wanted`` rows of ``rows`` (all, if fewer), those that come first by a hash of the keys.

    Rows are counted first, so that a filter on the hash leaves half as many again: what each task sorts and sends
    doesn't grow with the corpus.
    """
    total = rows.count()
    h = F.xxhash64(*keys)
    if total > 2 * wanted:
        share = 1 << 30
        rows = rows.filter(F.pmod(h, F.lit(share)) < int(share * 1.5 * wanted / total) + 1)
    return rows.withColumn("__h", F.pmod(h, F.lit(1 << 30))).orderBy("__h", *keys).limit(wanted).drop("__h")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
