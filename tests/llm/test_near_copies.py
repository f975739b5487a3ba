"""Near copies by whole Jaccard similarities against brute force, and the pipeline's stage that drops them."""

import random

import pytest

import corpus_pipeline as P
from gridloom.llm import near_copies as J
from gridloom.llm import simhash as S


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    line = [f"every{i}" for i in range(12)]
    out = [(None, ""), (1, None), (2, "  "), (3, "One two"), (4, "one TWO"), (5, "one three")]
    for k in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(30, 300))] + line * (k % 3 == 0)
        out += [(100 + 10 * k + i, edited(r, base, i * len(base) // 150)) for i in range(4)]
    base = [f"v{i}" for i in range(200)]
    out += [(1000 + i, edited(r, base, r.randrange(5))) for i in range(150)]
    return out + [out[7]]


def wanted(rows):
    sets = [set(J.hashes(t)[:, 0].tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if (not x and not sets[j]) or 9 * both >= 4 * (len(x) + len(sets[j])) > 0:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), 1 << 60), 1 << 60 if d is None else d)
    return sorted(least.values())


def test_stage_keeps_one_of_each_group_of_similar_texts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = wanted(rows)
    assert sorted(r["doc_id"] for r in P.near(spark, docs, "").collect()) == want
    assert S.drop_near_duplicates(docs).count() > len(want)  # four bits miss similar texts


def test_no_rows(spark):
    assert J.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
