"""Texts in no learned language, and gibberish, are rejected, whatever the number of languages."""

import random

import pytest

from gridloom.llm import langid
from gridloom.llm.common import held_out

FOREIGN = [
    "Il governo ha annunciato ieri sera una nuova legge sulla scuola, che gli insegnanti giudicano insufficiente e troppo costosa per le famiglie",
    "De regering heeft gisteren een nieuwe wet aangekondigd die volgens de leraren onvoldoende is en veel te duur voor de gezinnen",
    "Hallitus ilmoitti eilen uudesta koululaista jota opettajat pitävät riittämättömänä ja perheille liian kalliina",
    "Правительство объявило вчера о новом законе о школе, который учителя считают недостаточным",
    "".join(random.Random(1).choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(200)),
    " ".join("".join(random.Random(i).choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for i in range(25)),
]


@pytest.mark.parametrize("langs", [("de", "en", "es", "fr"), ("en", "fr"), ("en",)])
def test_foreign_texts_and_gibberish_are_rejected(spark, langs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(f"lang in {langs}" if len(langs) > 1 else "lang = 'en'")
    m = langid.fit(docs)
    found = langid.identify(spark.createDataFrame([(t,) for t in FOREIGN], "text string"), m).collect()
    assert all(r["lang_rejected"] for r in found)
    own = [r["p_lang_rejected"] for r in langid.identify(docs, m, "p_").filter(held_out()).collect()]
    assert sum(own) < 0.03 * len(own)
