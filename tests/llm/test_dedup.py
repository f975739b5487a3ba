"""Exact and near duplicates against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup as E
from gridloom.llm import simhash as S
from gridloom.llm.components import components

SCHEMA = "doc_id long, text string, fp string, uid string, root string, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA)


def corpus(n, seed=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 120)))) for i in range(n)]
    for k in range(n // 4):
        i, t = rows[r.randrange(n)]
        parts = t.split()
        if k % 3:
            parts[r.randrange(len(parts))] = "changed"
        rows.append((1000 + k, (" " if k % 2 else "\n").join(parts)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "One Two"), (5003, "One Two"), (5004, "onetwo"), (None, rows[0][1]), (5005, "a b c"), (5006, "日本語 テキスト" * 3)]
    return rows


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("huge", [1 << 16, 50])
def test_exact_equals_brute_force(spark, huge):
    rows = corpus(120)
    got = E.exact_dedup(docs(spark, rows), huge_chars=huge).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = {}
    for i, t in rows:
        g = groups[plain(t)]
        want[i, hashlib.sha256(plain(t).encode()).hexdigest()] = (min(g)[3], len(g))
    assert {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in got} == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and len({r["text_sha256"] for r in kept}) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_fingerprints_compose():
    rng = random.Random(1)
    a, b = rng.randbytes(70_000), rng.randbytes(12_345)
    (h1, s1, h2, s2), (g1, t1, g2, t2), whole = E.fingerprint(a), E.fingerprint(b), E.fingerprint(a + b)
    assert whole == ((h1 * t1 + g1) % E.PRIMES[0], s1 * t1 % E.PRIMES[0], (h2 * t2 + g2) % E.PRIMES[1], s2 * t2 % E.PRIMES[1])


@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_collisions_are_found_chunk_by_chunk(spark, chunk):
    """Fingerprints that collide must not merge texts: the chunkwise comparison tells them apart."""
    d = docs(spark, [(1, "aaaa aaab"), (2, "aaaaaaaa"), (3, "aaaa aaab"), (4, "cc\ncc"), (5, "c ccc"), (6, "alone")]).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    group = F.when(F.col("doc_id") <= 3, 1).when(F.col("doc_id") <= 5, 2).otherwise(3).cast("long")
    digests = d.select("text_hash", group.alias("h1"), F.lit(1).cast("long").alias("h2"), F.lit(8).cast("long").alias("n_bytes"))
    assert [tuple(r) for r in E._collisions(d, digests, chunk).collect()] == [(1, 1, 8)]


def test_drop_keeps_columns_and_one_row_each(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "c"), (3, "c"), (4, None)]
    out = E.drop_exact_duplicates(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "fp", "uid", "root", "kept"]
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [S.BLOCK, 7])
def test_near_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(S.links, "__defaults__", (4, block))
    rows = corpus(150, 3)
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(3)]
    got = S.near_duplicates(docs(spark, rows)).withColumn("hex", S.fp_hex("fp")).collect()
    assert len(got) == len(rows) and base
    prints = {(i, t): fingerprint(t) for i, t in rows}
    assert sorted(f"{v:016x}" for v in (prints[k] for k in rows)) == sorted(x["hex"] for x in got)
    fps = np.array([prints[k] for k in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    label = np.array([1 << 60 if i is None else i for i, _ in rows])
    while True:
        new = np.where(near, label[None], 1 << 60).min(1)
        if (new == label).all():
            break
        label = new
    want = sorted((f"{int(f):016x}", int(c)) for f, c in zip(fps, label))
    assert sorted((x["hex"], x["component_id"]) for x in got) == want
    assert any(c == 5000 for _, c in want)  # nulls, empties and blanks link


def test_dense_cluster_gives_few_edges(spark):
    """Fingerprints within two bits of each other: a forest, not all pairs."""
    r = random.Random(4)
    base = r.getrandbits(63)
    cluster = {base ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for _ in range(5000)}
    fps = cluster | {r.getrandbits(63) for _ in range(500)}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = S.links(nodes, 4).persist()
    assert edges.count() < 20 * len(fps)
    roots = {x["node"]: x["root"] for x in components(edges).collect()}
    assert len(set(roots.values())) == 1 and set(roots) == cluster


def test_components_of_a_long_chain(spark):
    n = 60
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert components(e.limit(0)).count() == 0


def test_routes_cover_all_links():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    near = fps[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    every = np.unique(np.concatenate((fps, near)))
    tree = S.fit_tree(every[::3, None], 6)
    home, index, leaf = S.route(every[:, None], tree, 6, 4)
    seen = {(int(i), int(b)) for i, b in zip(index, leaf)}
    d = np.bitwise_count(every[:, None] ^ every[None]) <= 4
    for i, j in zip(*np.nonzero(np.triu(d, 1))):
        assert home[i] == home[j] or (int(i), int(home[j])) in seen or (int(j), int(home[i])) in seen


def test_empty_tables(spark):
    none = docs(spark, [])
    assert E.exact_dedup(none).count() == 0
    assert S.near_duplicates(none).count() == 0
    assert S.drop_near_duplicates(none).count() == 0


def test_near_drop_keeps_the_smallest_id(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(7, t), (3, t.upper()), (9, "else where entirely now"), (None, t), (3, t)]
    out = S.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in out) == [3, 9]
