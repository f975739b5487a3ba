"""Language ID and toxicity on the supplied tables (held-out accuracy) and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid, toxicity
from gridloom.llm.common import held_out


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_language_accuracy_on_held_out_rows(tables):
    docs, _ = tables
    found = langid.identify(docs.withColumn("score", F.lit("mine")), langid.fit(docs), "p_")
    rows = found.filter(held_out()).select("lang", "p_lang_pred", "p_score", "p_lang_rejected", "score").collect()
    assert np.mean([r["lang"] == r["p_lang_pred"] for r in rows]) > 0.97
    assert np.mean([r["p_lang_rejected"] for r in rows]) < 0.03
    assert all(0 <= r["p_score"] <= 1 and r["score"] == "mine" for r in rows)


def test_odd_texts_for_language(spark, tables):
    m = langid.fit(tables[0])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !!"), (4, "the of and"), (4, "the of and"), (5, "a" * 300_000), (None, "的是")], "doc_id long, text string")
    rows = langid.identify(df, m).collect()
    assert len(rows) == 7
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"], r["lang_rejected"]))
    assert by[1] == by[2] == by[3] == [("und", 0.0, True)]
    assert by[4][0] == by[4][1] and by[None][0][0] in m.langs
    assert langid.identify(df.limit(0), m).count() == 0


def test_no_labelled_language(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(df, langid.fit(df)).first()["lang_pred"] == "und"


def test_counts_cover_the_whole_text(monkeypatch):
    text = "lorem ipsum dolor " * 400
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "RUN", 97)
    assert np.array_equal(whole, langid.counts(text))


def test_words_cover_the_whole_text(monkeypatch):
    text = "Lorem ipsum, dolor! " * 300
    whole = toxicity.words(text)
    assert len(whole) == 900 and len(set(whole.tolist())) == 3
    monkeypatch.setattr(toxicity, "RUN", 101)
    monkeypatch.setattr(toxicity, "_POW", [])
    assert np.array_equal(whole, toxicity.words(text))


def planted(spark, n=600):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in rng.integers(0, 300, rng.integers(5, 80))]
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), ["vile", "rotten", "awful"][int(rng.integers(0, 3))])
        rows.append((i, " ".join(words), "en" if i % 3 else None))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_planted_words_in_held_out_rows(spark):
    docs, labels = planted(spark)
    m = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, m, "p_").filter(held_out()).collect()
    bad = [r for r in rows if r["doc_id"] % 8 == 0]
    good = [r for r in rows if r["doc_id"] % 8]
    assert np.mean([r["p_score"] >= 0.3 for r in bad]) > 0.9
    assert np.mean([r["p_score"] >= 0.3 for r in good]) < 0.05
    assert np.mean([r["p_toxic_rejected"] for r in bad]) > 0.9


def test_toxicity_of_odd_rows(spark):
    docs, labels = planted(spark, 200)
    m = toxicity.fit(docs, labels.union(labels.limit(3)).union(spark.createDataFrame([(1, None)], "doc_id long, toxic int")))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "vile"), (4, "vile"), (None, "x " * 200_000)], "doc_id long, text string")
    rows = toxicity.score(odd, m).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(odd.limit(0), m).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(odd, none).agg(F.max("score")).first()[0] == 0.0
    same = toxicity.fit(docs, labels.withColumn("toxic", F.lit(1)))
    assert toxicity.score(odd, same).agg(F.min("score")).first()[0] == 1.0


def test_scores_do_not_depend_on_the_batch(spark):
    docs, labels = planted(spark, 200)
    m = toxicity.fit(docs, labels)
    texts = [toxicity.words(r["text"]) for r in docs.limit(20).collect()]
    assert np.allclose(m.scores(texts), np.concatenate([m.scores([t]) for t in texts]))


def test_real_labels(tables):
    docs, labels = tables
    s = toxicity.score(docs, toxicity.fit(docs, labels), "p_")
    rows = s.filter(held_out()).join(labels, "doc_id").collect()
    hit = [r["p_score"] >= 0.3 for r in rows]
    right = sum(h and r["toxic"] == 1 for h, r in zip(hit, rows))
    assert right / max(1, sum(hit)) > 0.8 and right / sum(r["toxic"] for r in rows) > 0.5
