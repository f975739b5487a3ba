"""Narrow tables leave few files however many shuffle partitions there are, and lose no row."""

import os

import pytest

from gridloom.llm import exact_dedup, near_copies, packing
from gridloom.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
PARTITIONS = 96


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield max(2 * spark.sparkContext.defaultParallelism, PARTITIONS // 16)
    for k, v in before.items():
        spark.conf.set(k, v)


def files(folder):
    return sum(f.startswith("part-") for f in os.listdir(folder))


def tables(spark):
    top = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/gridloom"
    return {f"{top}/{t}" for t in os.listdir(top)} if os.path.isdir(top) else set()


def packed(docs):
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("plan", [packed, exact_dedup.exact_dedup, near_copies.near_copies])
def test_few_files_with_every_row(spark, many_partitions, tmp_path, plan):
    assert many_partitions < PARTITIONS
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(PARTITIONS)
    before = tables(spark)
    rows = plan(docs)
    rows.write.parquet(f"{tmp_path}/out")
    made = {t: files(t) for t in tables(spark) - before}
    assert made
    wide = "shingle-sets"  # as large as the texts they are made of
    assert {t: n for t, n in made.items() if n > many_partitions and wide not in t} == {}
    assert spark.read.parquet(f"{tmp_path}/out").select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    if plan is packed:
        assert files(f"{tmp_path}/out") <= many_partitions
