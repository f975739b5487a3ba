"""Exact deduplication by composable polynomial fingerprints.

A text's normal form (white space removed, UTF-8) is read as a polynomial over two 31-bit prime fields. The
fingerprint of a concatenation follows from its parts, ``H(ab) = H(a) * R**len(b) + H(b)``, so documents over
``huge_chars`` are cut into chunks that different tasks hash and an associative fold combines; all others are
hashed in one go by the same arithmetic. Texts with equal fingerprints are then compared chunk by chunk: the
smallest and the largest chunk at each position must be the same characters, a comparison that Spark combines on the
map side, so that a group holding a third of the corpus costs each task one row per chunk. Texts without a double
aren't read again. A group that fails it (a collision) is split by SHA-256.

Edge cases: null text counts as empty; empty texts equal each other; a null doc_id sorts last; where rows repeat
a doc_id one row of them stays; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column, gathered, keep_rows, map_texts, maybe_in, scratch, slices, text_hash

SPACES = b" \t\n\x0b\x0c\r"
PRIMES = (2147483647, 2147483629)
RADICES = (1000003, 998244353)
#: Bytes that one dot product takes: 255 * 2**31 * 2**16 stays far below 2**64.
BLOCK = 1 << 16
#: Characters per chunk of a huge document, and of the chunkwise comparison.
HUGE_CHARS = 1 << 16


def _powers() -> list[np.ndarray]:
    out = []
    for p, r in zip(PRIMES, RADICES):
        a = np.empty(BLOCK, np.uint64)
        x = 1
        for i in range(BLOCK - 1, -1, -1):
            a[i], x = x, x * r % p
        out.append(a)
    return out


_POWERS: list[np.ndarray] = []


def fingerprint(data: bytes) -> tuple[int, int, int, int]:
    """(h1, shift1, h2, shift2) of some bytes; shift is the radix to the power of their number."""
    if not _POWERS:
        _POWERS.extend(_powers())
    parts = []
    for p, r, powers in zip(PRIMES, RADICES, _POWERS):
        h = 0
        for i in range(0, len(data), BLOCK):
            a = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - i), i).astype(np.uint64)
            h = (h * pow(r, len(a), p) + int(a @ powers[BLOCK - len(a) :]) % p) % p
        parts += [h, pow(r, len(data), p)]
    return tuple(parts)


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACES)


DIGEST = "doc_id long, text_hash long, n_chars long, n_bytes long, h1 long, h2 long, sha string"


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
        data = normal(text)
        h1, _, h2, _ = fingerprint(data)
        rows.append((doc, len(text or ""), len(data), h1, h2, hashlib.sha256(data).hexdigest()))
    cols = list(zip(*rows)) if rows else [[]] * 6
    types = [pa.int64()] * 5 + [pa.string()]
    made = [pa.array(c, t) for c, t in zip(cols, types)]
    return pa.RecordBatch.from_arrays([made[0], column(batch, "text_hash"), *made[1:]], ["doc_id", "text_hash", "n_chars", "n_bytes", "h1", "h2", "sha"])


def _huge_digests(docs: DataFrame, huge_chars: int) -> DataFrame:
    """The same digest for huge documents: SHA-256 streams over the row, fingerprints come from chunks."""
    pieces = "uid long, doc_id long, text_hash long, n_chars long, sha string, no int, data binary"

    def cut(batches):
        for batch in (part for b in batches for part in slices(b, "text")):
            for uid, doc, h, text in zip(*(column(batch, c).to_pylist() for c in ("uid", "doc_id", "text_hash", "text"))):
                sha = hashlib.sha256()
                parts = [text[i : i + huge_chars] for i in range(0, len(text), huge_chars)]
                for part in parts:
                    sha.update(normal(part))
                for no, part in enumerate(parts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid], pa.int64()), pa.array([doc], pa.int64()), pa.array([h], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([sha.hexdigest()]), pa.array([no], pa.int32()), pa.array([normal(part)], pa.binary())],
                        ["uid", "doc_id", "text_hash", "n_chars", "sha", "no", "data"],
                    )

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(x) + (len(x),) for x in column(batch, "data").to_pylist()]
        keep = [column(batch, c) for c in ("uid", "doc_id", "text_hash", "n_chars", "sha", "no")]
        return pa.RecordBatch.from_arrays(keep + [pa.array([p[i] for p in prints], pa.int64()) for i in range(5)], ["uid", "doc_id", "text_hash", "n_chars", "sha", "no", "h1", "s1", "h2", "s2", "n_bytes"])

    chunks = docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(cut, pieces).repartition("uid", "no")
    chunks = map_texts(chunks, hashed, "uid long, doc_id long, text_hash long, n_chars long, sha string, no int, h1 long, s1 long, h2 long, s2 long, n_bytes long", "data")

    def fold(h: str, s: str, p: int) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("no", h, s)))
        return F.aggregate(ordered, F.lit(0).cast("long"), lambda acc, x: (acc * x[s] + x[h]) % F.lit(p))

    return chunks.groupBy("uid", "doc_id", "text_hash", "n_chars", "sha").agg(F.sum("n_bytes").alias("n_bytes"), fold("h1", "s1", PRIMES[0]).alias("h1"), fold("h2", "s2", PRIMES[1]).alias("h2")).select("doc_id", "text_hash", "n_chars", "n_bytes", "h1", "h2", "sha")


def _collisions(docs: DataFrame, digests: DataFrame, chunk_chars: int) -> DataFrame:
    """Fingerprints (h1, h2, n_bytes) whose texts are not all the same characters, found chunk by chunk.

    Only texts whose fingerprint comes twice are read again, and cut into chunks where they are.
    """
    key = ["h1", "h2", "n_bytes"]
    doubles = scratch(gathered(digests.groupBy(*key).count().filter("count > 1").select(*key)), "double-prints")
    asked = scratch(gathered(digests.select("text_hash", *key).distinct().join(doubles, key)), "asked")
    rows = maybe_in(docs.select("text", "text_hash"), F.col("text_hash"), asked.select(F.col("text_hash").alias("k")))
    body = F.translate("text", SPACES.decode(), "")
    parts = F.when(F.length(body) <= chunk_chars, F.array(body)).otherwise(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0)))
    chunks = rows.filter("__maybe").select("text_hash", F.posexplode(parts).alias("no", "chunk"))
    each = chunks.groupBy("text_hash", "no").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))  # copies meet on the map side
    return each.join(asked, "text_hash").groupBy(*key, "no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select(*key).distinct()


def exact_dedup(docs: DataFrame, huge_chars: int = HUGE_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars, text_hash.

    Of equal texts the row with the most code points stays, then the one with the smallest doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_hash().alias("text_hash"))
    small = map_texts(docs.filter(F.length("text") <= huge_chars), _digests, DIGEST)
    huge = _huge_digests(docs.filter(F.length("text") > huge_chars), huge_chars)
    digests = scratch(small.unionByName(huge).withColumn("uid", F.monotonically_increasing_id()), "digests", narrow=True)
    key = ["h1", "h2", "n_bytes"]
    bad = scratch(gathered(_collisions(docs, digests, huge_chars)), "collisions")
    rows = digests.join(bad.withColumn("bad", F.lit(True)), key, "left").withColumn("variant", F.when(F.col("bad"), F.col("sha")).otherwise(F.lit("")))
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("uid").alias("uid"))
    groups = rows.groupBy(*key, "variant").agg(F.min(order).alias("stays"), F.count("*").alias("group_size"))
    doubles = scratch(gathered(groups.filter("group_size > 1")), "doubles")  # stored, so that a hot group's join can be split
    alone = F.col("group_size").isNull()
    return rows.join(doubles, [*key, "variant"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("stays.uid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "n_chars",
        "text_hash",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with the row that stays of each group of equal texts."""
    return keep_rows(docs, exact_dedup(docs).select("doc_id", "text_hash", "kept"))
