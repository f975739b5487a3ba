"""Best-fit packing of token sequences by patterns fitted with non-negative least squares.

Pieces are placed by length alone, so the corpus enters the plan as a histogram of at most ``capacity`` bins. On
it the driver enumerates patterns of one to three lengths that fill a sequence (all pairs; triples over the
lengths that are common, most of the mass first), fits how often to repeat each by non-negative least squares
(projected coordinate steps on the sparse system), rounds to what the histogram holds, and packs the residual by
best fit, whole runs of equal lengths at a time; of several orders (pairs before triples, all at
once, ..., the residual alone) the plan with the fewest sequences is taken. The plan is a table of runs (length, first rank, last
rank -> first sequence, offset) whose size depends on the capacity only. Ranks within a length come from salted
groups, so that a length that a third of the pieces share is ranked by many tasks.

Edge cases: null or empty text is a piece of its end id alone; an empty table gives no rows; repeated rows are
packed each (and a null doc_id as well); extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import BATCH_ROWS, column, gathered, map_texts, scratch
from gridloom.llm.tokens import encoder

CAPACITY, SALTS = 1024, 256
#: Lengths that take part in triples, and sweeps of the least squares.
TRIPLE_LENGTHS, SWEEPS = 160, 60


def patterns(hist: np.ndarray) -> np.ndarray:
    """Rows of up to three lengths (0: none) that sum to the capacity, the longest first."""
    cap = len(hist) - 1
    have = np.flatnonzero(hist)
    if not len(have):
        return np.zeros((0, 3), np.int64)
    out = [np.array([[cap, 0, 0]])] if hist[cap] else []
    rest = cap - have
    pair = have[(have >= rest) & (rest > 0) & (hist[np.maximum(rest, 0)] > 0)]
    out.append(np.stack([pair, cap - pair, np.zeros_like(pair)], 1))
    some = np.sort(have[np.argsort(-hist[have], kind="stable")][:TRIPLE_LENGTHS])
    a, b = np.meshgrid(some, some, indexing="ij")
    c = cap - a - b
    ok = (a >= b) & (b >= c) & (c > 0) & (hist[np.maximum(c, 0)] > 0)
    out.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate(out).astype(np.int64)


def repeats(hist: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |A x - hist|**2, A[l, p] being how often pattern p has length l."""
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    short = hist.astype(np.float64).copy()
    short[0] = 0
    left = short.copy()
    groups = [np.flatnonzero(rows[:, 0] % 64 == g) for g in range(64)]  # blocks of patterns take turns
    norm = np.array([np.square(np.unique(r[r > 0], return_counts=True)[1]).sum() for r in rows], float)
    for sweep in range(SWEEPS):
        for at in groups if sweep % 2 else reversed(groups):
            if not len(at):
                continue
            r = rows[at]
            grad = (left[r] * (r > 0)).sum(1)
            step = np.maximum(grad / norm[at] * 0.5, -x[at])
            use = np.bincount(r.ravel(), np.repeat(np.abs(step), 3), len(hist))
            use[0] = 0
            share = np.minimum(1, np.maximum(np.abs(left), 1e-9) / np.maximum(use, 1e-9))  # patterns share what a length lacks
            share[0] = 1
            step *= np.where(step > 0, share[r].min(1), 0.5)
            x[at] += step
            moved = np.bincount(r.ravel(), np.repeat(step, 3), len(hist))
            moved[0] = 0
            left -= moved
    return x


@dataclass
class Plan:
    """Runs: pieces of a length with ranks first.. go to sequences base.. at an offset."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        big = np.int64(1) << 48
        at = np.searchsorted(self.length * big + self.first, length * big + rank, side="right") - 1
        return self.base[at] + rank - self.first[at], self.offset[at]


def plan(hist: np.ndarray) -> Plan:
    """hist[l]: pieces of length l, for l up to the capacity. Of several ways to round, the one with fewest sequences."""
    rows = patterns(hist)
    few, many = rows[rows[:, 2] == 0], rows[rows[:, 2] > 0]
    tries = [[(few, np.ceil), (many, np.floor)], [(few, np.ceil), (many, np.ceil)], [(rows, np.floor), (few, np.ceil), (many, np.floor)], [(rows, np.ceil)], [(few, np.ceil)], []]
    return min((rounded(hist, stages) for stages in tries), key=lambda p: p.sequences)


def rounded(hist: np.ndarray, stages: list) -> Plan:
    """Per stage: repeats of some patterns fitted to what is left and rounded; at last best fit for the residual."""
    left = hist.astype(np.int64).copy()
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int]] = []
    total = 0

    def take(length: int, n: int, base: int, offset: int) -> None:
        runs.append((length, int(used[length]), base, offset))
        used[length] += n
        left[length] -= n

    for rows, whole in stages:
        x = repeats(left, rows)
        want = whole(np.where(x > 0.02, x, 0))
        for p in np.argsort(-x, kind="stable"):
            if not want[p]:
                continue
            lengths = [int(v) for v in rows[p] if v]
            n = min(int(want[p]), *(int(left[v]) // lengths.count(v) for v in lengths))
            if n > 0:
                offset = 0
                for v in lengths:
                    take(v, n, total, offset)
                    offset += v
                total += n
    spaces: dict[int, list[list[int]]] = defaultdict(list)  # free room -> runs [first sequence, how many]
    cap = len(hist) - 1
    for v in range(cap, 0, -1):  # best fit, longest first: the least room that fits, else new sequences
        room = v
        while left[v]:
            while room <= cap and not spaces[room]:
                room += 1
            if room > cap:
                n = int(left[v])
                per = min(cap // v, n)  # equal lengths fill new sequences side by side
                whole = n // per
                for k in range(per):
                    take(v, whole, total, k * v)
                spaces[cap - per * v].append([total, whole])
                total += whole
                room = v
                if left[v]:  # fewer than a sequence's worth
                    n = int(left[v])
                    for k in range(n):
                        take(v, 1, total, k * v)
                    spaces[cap - n * v].append([total, 1])
                    total += 1
                break
            run = spaces[room][-1]
            n = min(int(left[v]), run[1])
            take(v, n, run[0], cap - room)
            spaces[room - v].append([run[0], n])
            run[0], run[1] = run[0] + n, run[1] - n
            if not run[1]:
                spaces[room].pop()
            room = v
    table = np.array(sorted(runs) or [(0, 0, 0, 0)], np.int64)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], total)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids with the end id, cut from the back into pieces of the capacity: only the first is shorter."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(vocabulary, spaced=True)
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        rows = []
        for doc, ids in zip(column(batch, "doc_id").to_pylist(), e.encode(texts)):
            data = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
            n = len(data) // 4
            start = 0
            for no in range(-(-n // capacity)):
                stop = start + capacity if no else (n - 1) % capacity + 1
                rows.append((doc, no, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                start = stop
        cols = list(zip(*rows)) if rows else [()] * 5
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, PIECES, rows=BATCH_ROWS)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``."""
    names = parts.columns
    table = scratch(parts.withColumn("salt", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id() * 7919, F.lit(SALTS)).cast("int")), "pieces", narrow=True)
    sizes = table.groupBy("length", "salt").count().toArrow()  # capacity x SALTS rows at most
    length, salt, count = (np.array(sizes[c].to_pylist(), np.int64) for c in ("length", "salt", "count"))
    order = np.lexsort((salt, length))
    before = np.zeros((capacity + 1, SALTS), np.int64)
    before[length[order], salt[order]] = count[order]
    hist = before.sum(1)
    before = np.cumsum(before, axis=1) - before
    made = table.sparkSession.sparkContext.broadcast((plan(hist), before))
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*(c for c in ("doc_id", "piece") if c in names))) - 1)
    from pyspark.sql import types as T

    def place(batches):
        the_plan, offsets = made.value
        for batch in batches:
            n = column(batch, "length").to_numpy().astype(np.int64)
            rank = column(batch, "rank").to_numpy() + offsets[n, column(batch, "salt").to_numpy()]
            seq, off = the_plan.place(n, rank)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*names, "sequence_id", "offset"])

    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return gathered(ranked).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(pieces(docs, vocabulary, end_id, capacity), capacity).withColumn("length", F.col("length").cast("long"))
