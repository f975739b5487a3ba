"""The pipeline's stages against plain versions of what they must keep, and the registry's names."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gridloom.llm import registry

SF = "/root/testdata/sf0.001"


def test_registry_has_one_query_each():
    names = registry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert [n for n, _ in P.STAGES] == ["toxicity", "language_id", "exact_dedup", "simhash_near_dedup", "pattern_packing"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs))
    return dict(out)


def test_all_but_the_last_keep_the_columns(stages):
    want = stages["documents"].columns
    for name in ("toxicity", "language_id", "exact_dedup", "simhash_near_dedup"):
        assert stages[name].columns == want
        assert stages[name].exceptAll(stages["documents"]).count() == 0


def test_exact_stage_keeps_one_of_each(stages):
    before, after = (stages[n].toPandas() for n in ("language_id", "exact_dedup"))
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    assert sorted(set(before.text.map(sha))) == sorted(after.text.map(sha))


def test_near_stage_keeps_the_first_of_each_component(stages):
    from test_near_copies import wanted

    rows = [(r["doc_id"], r["text"]) for r in stages["exact_dedup"].select("doc_id", "text").collect()]
    assert wanted(rows) == sorted(r["doc_id"] for r in stages["simhash_near_dedup"].collect())


def test_few_clean_documents_go(stages):
    n = stages["documents"].count()
    assert stages["toxicity"].count() > 0.8 * n
    assert stages["language_id"].count() > 0.98 * stages["toxicity"].count()


def test_packing_places_all_that_is_left(stages):
    p = stages["pattern_packing"]
    assert p.select("doc_id").distinct().count() == stages["simhash_near_dedup"].count()
    assert p.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_run_equals_the_stages(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert P.run(spark, SF).select(key).exceptAll(stages["pattern_packing"].select(key)).count() == 0


def test_queries_against_sql(spark, duck):
    from conftest import canonical

    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, SF).toPandas()
        assert canonical(got) == canonical(duck.execute(sql).df()), name
