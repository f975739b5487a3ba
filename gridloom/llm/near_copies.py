"""Near copies by word shingles: SimHash search for candidates, whole Jaccard similarities for the decision.

Two documents are linked if the sets of their five-word shingles have a Jaccard similarity of SIMILARITY or more.

1. Sketches: of a text's distinct shingles (XXH128, seed 42) the 128 majority bits, the number of shingles, and a hash
   of the set. Rows of equal sets are one node.
2. Candidates by :mod:`gridloom.llm.simhash`: vantage-point trees over the 128 bits, with bands of shingle counts
   (sets that are similar differ by less than a factor BAND in size). At similarity 0.8 two fingerprints differ in
   19.4 bits on average, with a deviation of 4.1, so that RADIUS = 32 bits miss one such pair in a thousand, and fewer of
   more similar ones; of unrelated pairs one in 10**8 passes.
3. Tiles tell which fingerprints have a candidate at all. Only their sets are made, and only in those tiles: a second
   search compares the sets of candidates exactly and returns a spanning forest of the links. Pairs never leave a
   task, and pairs whose ends are linked already need no look, so that thousands of copies, or of texts that are
   nearly similar enough, cost thousands of rows, not millions.
4. Components by alternating stars.

Similarities are counted in whole numbers over whole sets. At this radius triangle bounds prune next to nothing among
unrelated texts; bands do, to about a sixth of all pairs.

Edge cases: texts of fewer words than a shingle are one shingle; null texts and texts without a word are alike; a null
doc_id comes after the others; rows alike in doc_id and text count once; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column, drop_scratch, gathered, keep_rows, map_texts, pick_texts, scratch, text_hash
from gridloom.llm.components import components
from gridloom.llm.simhash import close, first_of_each, search, tiles

#: Similarity as a fraction, bits that may differ, and the ratio of a band's largest to its smallest set (over 5 / 4).
SIMILARITY, RADIUS, BAND = (4, 5), 32, 1.26
WORDS = ["hi", "lo"]
#: Shingles of a tile's side, at least so many counted for a set, and the fingerprints of a leaf before the tree gets
#: deeper: a tile holds some 2 * 2**21 shingles and compares 2**26 pairs at most.
BLOCK, LEAST, LEAF, DEPTH = 1 << 21, 256, 1 << 17, 2
#: Shingles whose bits are summed up at a time.
RUN = 1 << 15


def hashes(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of the text's word shingles, as two big-endian words each, ordered by the first."""
    from xxhash import xxh3_128_digest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros((0, 2), ">u8")
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined, n = b" ".join(w), max(1, len(w) - words + 1)
    last = ends[words - 1 :] if len(w) >= words else ends[-1:]
    found = b"".join([xxh3_128_digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())])
    rows = np.frombuffer(found, ">u8").reshape(-1, 2)
    return rows[np.unique(rows[:, 0], return_index=True)[1]]


def sketch(rows: np.ndarray) -> tuple[int, int, int, int]:
    """(hash of the set, its size, the fingerprint's two words), as signed longs."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(rows), RUN):
        ones += np.unpackbits(np.ascontiguousarray(rows[at : at + RUN]).view(np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.int64)
    hi, lo = np.packbits(ones * 2 > len(rows)).view(">i8").tolist()
    return int.from_bytes(hashlib.blake2b(np.ascontiguousarray(rows[:, 0]).tobytes(), digest_size=8).digest(), "big", signed=True), len(rows), hi, lo


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, set_id, n, hi, lo) of every row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([sketch(hashes(t, words)) for t in column(batch, "text").to_pylist()], np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text_hash"), *(pa.array(made[:, k]) for k in range(4))], ["doc_id", "text_hash", "set_id", "n", *WORDS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    return map_texts(rows, kernel, "doc_id long, text_hash long, set_id long, n long, hi long, lo long")


def shingle_sets(nodes: DataFrame, ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of those of ``nodes`` that ``ids`` names, from one text of each."""
    asked = nodes.join(ids, nodes["set_id"] == ids["id"], "left_semi").select("first.doc_id", "first.text_hash")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [hashes(t, words) for t in column(batch, "text").to_pylist()]
        firsts = [np.ascontiguousarray(s[:, 0]).astype("u8").view(np.int64) for s in sets]
        return pa.RecordBatch.from_arrays([pa.array([sketch(s)[0] for s in sets], pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], ["id", "shingles"])

    return scratch(map_texts(pick_texts(docs, asked), kernel, "id long, shingles array<long>"), "shingle-sets")


def flat(sets: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists behind one another, where each starts, and their lengths."""
    cells = sets.combine_chunks()
    n = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return cells.flatten().to_numpy(), np.cumsum(n) - n, n


def linked(left: pa.ChunkedArray, a: np.ndarray, right: pa.ChunkedArray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) that span the links between sets whose fingerprints are within the radius."""
    values, starts, sizes = flat(left)
    if same:
        its, its_starts, its_sizes = values, starts, sizes
    else:
        its, its_starts, its_sizes = flat(right)
    words, code = np.unique(np.concatenate((values, its)), return_inverse=True)
    mine, its = code[: len(values)], code[len(values) :]
    held, n = np.zeros(len(words), bool), 0 if same else len(a)
    label, out = np.arange(n + len(b)), [np.zeros((0, 2), np.int64)]
    p, q = SIMILARITY  # both / (sizes - both) >= p / q
    for rows, cols, d in close(a, b, radius):
        hit = d <= radius
        for k in np.flatnonzero(hit.any(1)):
            i = rows[k]
            js = cols[hit[k]]
            js = js[label[n + js] != label[i]]
            if not len(js):
                continue
            own, m = mine[starts[i] : starts[i] + sizes[i]], its_sizes[js]
            ends = np.cumsum(m)
            held[own] = True
            both = np.add.reduceat(held[its[np.repeat(its_starts[js] - (ends - m), m) + np.arange(ends[-1])]], ends - m, dtype=np.int64)
            held[own] = False
            js = js[(p + q) * both >= p * (sizes[i] + m)]
            if len(js):
                classes, first = np.unique(label[n + js], return_index=True)
                out.append(np.stack([np.full(len(first), i), js[first]], 1))
                label[np.isin(label, classes)] = label[i]
    pairs = np.concatenate(out)
    return pairs[:, 0], pairs[:, 1]


def near_copies(docs: DataFrame, words: int = 5, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, text_hash, set_id and root, the same for all of a component."""
    prints = scratch(sketches(docs, words), "sketches", narrow=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = scratch(gathered(prints.filter("n > 0").groupBy("set_id", "n", *WORDS).agg(first)), "sets")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
    weight = F.greatest(F.col("n"), F.lit(LEAST).cast("long"))
    dealt = tiles(nodes.select(F.col("set_id").alias("id"), *WORDS, band.alias("band"), weight.alias("weight")), WORDS, radius, BLOCK, LEAF, DEPTH)

    def candidates(left, a, right, b, same):
        near, its = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for rows, cols, d in close(a, b, radius):
            hit = d <= radius
            if same:
                hit &= rows[:, None] != cols[None, :]
            near[rows] |= hit.any(1)
            its[cols] |= hit.any(0)
        found = left.take(pa.array(np.flatnonzero(near | its if same else near)))
        return found if same else pa.concat_tables([found, right.take(pa.array(np.flatnonzero(its)))])

    def compared(left, a, right, b, same):
        i, j = linked(left["shingles"], a, right["shingles"], b, same, radius)
        return pa.table({"a": left["id"].to_numpy()[i], "b": right["id"].to_numpy()[j]})

    asked = scratch(search(dealt, WORDS, candidates, dealt.schema), "candidates", narrow=True)
    drop_scratch(dealt)
    sets = shingle_sets(nodes, asked.select("id").distinct(), docs, words)
    edges = search(asked.join(sets, "id"), WORDS, compared, "a long, b long")
    roots = components(edges).withColumnRenamed("node", "set_id")
    return prints.join(roots, "set_id", "left").select("doc_id", "text_hash", "set_id", F.coalesce("root", "set_id").alias("root"))


def drop_near_copies(docs: DataFrame, words: int = 5, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (of rows that share it, one)."""
    return keep_rows(docs, first_of_each(near_copies(docs, words, radius)))
