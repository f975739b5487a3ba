"""From ``documents`` to packed training sequences: five stages, each over all that the stage before it kept.

Toxicity and language ID fit their models on the labelled rows they may learn from (see the operators) and drop
what they reject; exact and near duplicates leave one document of each group, near duplicates being texts whose
five-word shingles have a Jaccard similarity of 0.8 or more; packing turns the rest into sequences of at most 1024
tokens.

Edge cases, for every stage: a null text counts as empty (toxicity scores it as a text without words, language ID
drops it as it has no letter); a null doc_id is a row like others that no model learns from; rows that repeat in
doc_id and text are one after exact dedup; ties go to the smaller doc_id; an empty table stays empty; extra columns,
whatever their names, are carried through unchanged up to packing.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, langid, near_copies, packing, toxicity
from gridloom.llm.common import documents, drop_scratch, only_result


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score at or over their language's threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "__").filter("not __toxic_rejected").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or with a prediction below the calibrated score."""
    found = langid.identify(docs, langid.fit(docs), "__")
    return found.filter("not __lang_rejected").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the longest original, then the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component keep the smallest doc_id: SimHash candidates, exact similarities."""
    return near_copies.drop_near_copies(docs, words=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every token of what is left."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("pattern_packing", pack),
]

#: SQL can express neither the trained models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before = docs
        docs = only_result(lambda: stage(spark, before, sf_dir), name)  # noqa: B023  called at once
        drop_scratch(before)
    return STAGES[-1][1](spark, docs, sf_dir)
