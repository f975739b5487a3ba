"""Exact top-k search by distributed histogram selection.

Queries and candidates are dealt out as blocks; a tile (a block of queries, a block of candidates) scores all its
pairs with one integer matrix product. Round by round, the tiles' score histograms are added up per query, the
bin that holds the query's k-th score is found, and the next round splits that bin, until bins are one score wide:
the k-th value is then known exactly. A last pass keeps scores above it and, of those equal to it, the smallest
ids. A tile only reports bins down to its own k-th score, and ties only up to k of its smallest ids: nothing below
can be among the k best, so each tile reports rows in proportion to its queries, never its pairs.

Vectors are rounded down to ``floor(scale * x)``. Products run in float64 while every sum stays below 2**53 and in
Python integers otherwise, so scores are exact; beyond 2**62 they are cut to it.

Edge cases: vectors that are null or hold a null or non-finite component, and rows of null id, take no part; short
vectors count as padded with zeros; a query is answered once however often its row repeats, repeated candidates
count each, and "own" means of the same id; extra columns are ignored; no row gives no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import drop_scratch, scratch

BINS = 512
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096
#: Scores are cut to this, so that sums of bounds stay in a long.
MOST = 1 << 62


def _clean(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    scaled = F.transform(F.col(vec_col), lambda x: scale * x.cast("double"))
    endless = F.lit(float("inf"))
    fits = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < endless))
    whole = F.transform("v", lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0))  # floor, as a double
    rows = rows.select(F.col(id_col).cast("long").alias("id"), scaled.alias("v")).filter(fits).select("id", whole.alias("v"))
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    most = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    return rows.select("id", "v", F.sqrt(size).alias("norm"), most.alias("most"), F.size("v").alias("dim"))


def _matrix(cells: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows, short ones padded with zeros."""
    cells = cells.combine_chunks()
    n = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(cells), dim))
    out[np.arange(dim) < n[:, None]] = cells.flatten().to_numpy()
    return out


def _scores(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return q @ c.T
    ints = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    s = ints(q) @ ints(c).T
    return np.minimum(np.maximum(s, -MOST), MOST)


def _tile(left: pa.Table, right: pa.Table, dim: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (own pairs masked), which are real, and the candidates' ids."""
    s = _scores(_matrix(left["v"], dim), _matrix(right["v"], dim), exact)
    cid = right["id"].to_numpy()
    return s, left["id"].to_numpy()[:, None] != cid[None, :], cid


def _kth(s: np.ndarray, real: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th highest real score, or its lowest if there are fewer."""
    low = np.where(real, s, -np.inf if s.dtype != object else -MOST)
    n = low.shape[1]
    return np.partition(low, n - min(k, n), axis=1)[:, n - min(k, n)] if s.dtype != object else np.sort(low, axis=1)[:, n - min(k, n)]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, ties to smaller ids."""
    cand = scratch(_clean(candidates, id_col, vec_col, scale).withColumn("uid", F.monotonically_increasing_id()), "candidates")
    asked = scratch(_clean(queries, id_col, vec_col, scale).dropDuplicates(["id", "v"]).withColumn("qid", F.monotonically_increasing_id()), "queries")
    facts = lambda d: d.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max("most").alias("most"), F.max("dim").alias("dim")).first()
    fc, fq = facts(cand), facts(asked)
    dim = max(fc["dim"] or 0, fq["dim"] or 0, 1)
    reach = min(int((fc["norm"] or 0) * (fq["norm"] or 0) * 1.0001) + 1, MOST)  # |score| by Cauchy and Schwarz
    exact = (fc["most"] or 0) * (fq["most"] or 0) * dim < 1 << 53
    nq, nc = -(-max(1, fq["n"]) // QUERY_BLOCK), -(-max(1, fc["n"]) // CANDIDATE_BLOCK)
    tile = ["qb", "cb"]

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = cand.select("id", "v", F.pmod(F.xxhash64("uid"), F.lit(nc)).cast("int").alias("cb"), every(nq).alias("qb"))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int"))

    def pairs(state: DataFrame):
        left = asked.join(state, "qid").select("qid", "id", "v", "lo", "qb", every(nc).alias("cb"))
        return left.groupBy(*tile).cogroup(dealt.groupBy(*tile))

    width = 2 * reach + 1
    state = scratch(asked.select("qid", F.lit(-reach).cast("long").alias("lo")), "bounds")
    while width > 1:
        wide, width = width, -(-width // BINS)

        def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"qid": pa.array([], pa.int64()), "bin": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
            s, real, _ = _tile(left, right, dim, exact)
            lo = left["lo"].to_numpy()[:, None]
            lo = lo.astype(object) if s.dtype == object else lo
            row, col = np.nonzero(real & (s >= np.maximum(_kth(s, real, k)[:, None], lo)))
            bins = np.minimum((s - lo)[row, col] // width, BINS).astype(np.int64)
            code, n = np.unique(row * (BINS + 1) + bins, return_counts=True)
            return pa.table({"qid": left["qid"].to_numpy()[code // (BINS + 1)], "bin": code % (BINS + 1), "n": n.astype(np.int64)})

        counts = pairs(state).applyInArrow(histogram, "qid long, bin long, n long").groupBy("qid", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("bin")))
        found = counts.withColumn("above", above).filter(F.col("above") >= k).groupBy("qid").agg(F.max("bin").alias("bin"))
        after = scratch(state.join(found, "qid", "left").select("qid", (F.col("lo") + F.coalesce("bin", F.lit(0)) * F.lit(width)).alias("lo")), "bounds")
        drop_scratch(state)
        state = after
        assert wide > width

    def winners(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"qid": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            s, real, cid = _tile(left, right, dim, exact)
            order = np.argsort(cid, kind="stable")
            s, real, cid = s[:, order], real[:, order], cid[order]
            lo = left["lo"].to_numpy()[:, None]
            ties = real & (s == lo)
            keep = real & (s > lo) | ties & (np.cumsum(ties, axis=1) <= k)
            row, col = np.nonzero(keep)
            out = {"qid": left["qid"].to_numpy()[row], "query_id": left["id"].to_numpy()[row], "vec_id": cid[col], "score": s[row, col].astype(np.int64)}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    best = pairs(state).applyInArrow(winners, "qid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
