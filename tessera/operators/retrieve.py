"""Exact vector retrieval: all queries against all rows, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of queries and of the corpus that meet in one task, fewer where vectors are wider than WIDE; rows of both that are
#: multiplied at once there; groups a core.
QUERY_BLOCK, CORPUS_BLOCK, WIDE, QUERY_STEP, STEP, GROUPS = 32_000, 64_000, 64, 2_000, 4_000, 3


def _sorted(ids: np.ndarray, mat: np.ndarray, own: np.ndarray, rows: np.ndarray, k: int, skip_self: bool) -> pd.DataFrame:
    """The k largest products of each query with some rows, ties to the smaller id, by sorting all; for values that are not
    finite or very large."""
    held = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
    for s in range(0, len(own), STEP):
        sims = mat @ rows[s : s + STEP].T
        if skip_self:
            sims[ids[:, None] == own[None, s : s + STEP]] = -np.inf
        sims = np.hstack([held[0], sims])
        items = np.hstack([held[1], np.broadcast_to(own[s : s + STEP], (len(ids), len(own[s : s + STEP])))])
        best = np.lexsort((items, -sims), axis=1)[:, :k]
        held = np.take_along_axis(sims, best, 1), np.take_along_axis(items, best, 1)
    out = pd.DataFrame({"query_id": np.repeat(ids, held[0].shape[1]), "item_id": held[1].ravel(), "sim": held[0].ravel()})
    return out[np.isfinite(out["sim"])]


def _products(left: np.ndarray, right: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of pairs of rows in double precision, equal ones for equal rows, a bounded number of values at a time."""
    step = max(1, 2_000_000 // max(1, left.shape[1]))
    return np.concatenate([np.einsum("ij,ij->i", left[r[s : s + step]], right[c[s : s + step]]) for s in range(0, len(r), step)] or [np.zeros(0)])


def _best(ids: np.ndarray, mat: np.ndarray, own: np.ndarray, rows: np.ndarray, k: int, skip_self: bool) -> pd.DataFrame:
    """The k largest products of each query with some rows, ties to the smaller id.

    Products in single precision tell which rows can be among the k, with room for their error; those few alone are
    multiplied in double precision and sorted.
    """
    if not (np.abs(mat).max(initial=0) < 1e15 and np.abs(rows).max(initial=0) < 1e15):  # nan is not less
        return _sorted(ids, mat, own, rows, k, skip_self)
    single, longest = rows.astype(np.float32), np.linalg.norm(rows, axis=1).max(initial=0)
    out = []
    for q in range(0, len(ids), QUERY_STEP):
        n, own_q = len(ids[q : q + QUERY_STEP]), mat[q : q + QUERY_STEP]
        off = (mat.shape[1] + 4) * 2.0**-23 * np.linalg.norm(own_q, axis=1) * longest + 1e-30
        hr, hi, hs, low = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(n, -np.inf)
        for s in range(0, len(own), STEP):
            sims = own_q.astype(np.float32) @ single[s : s + STEP].T
            least = low - off
            if not np.isfinite(low).all() and sims.shape[1] > k + 1:
                # one more than k, as the query itself may be among them
                least = np.maximum(least, np.partition(sims, -k - 1, axis=1)[:, -k - 1] - 2 * off)
            r, c = np.nonzero(sims >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
            if skip_self:
                other = ids[q + r] != own[s + c]
                r, c = r[other], c[other]
            hr, hi = np.concatenate([hr, r]), np.concatenate([hi, own[s + c]])
            hs = np.concatenate([hs, _products(own_q, rows, r, s + c)])
            order = np.lexsort((hi, -hs, hr))
            at = hr[order]
            order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
            hr, hi, hs = hr[order], hi[order], hs[order]
            count = np.bincount(hr, minlength=n)
            full = count == k
            low[full] = hs[np.cumsum(count)[full] - 1]
        out.append(pd.DataFrame({"query_id": ids[q + hr], "item_id": hi, "sim": hs}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "item_id": [], "sim": []})


def top_k(queries: DataFrame, corpus: DataFrame, k: int, q_id: str, q_vec: str, c_id: str, c_vec: str, skip_self: bool = False) -> DataFrame:
    """query_id, item_id, sim, rank: the k largest inner products of each query; ties go to the smaller item id.

    Both sides are dealt into blocks of bounded size, each block of queries meets each block of the corpus in one task,
    and what is left of a block, k rows a query, is ranked in the end. Nothing passes through the driver but two counts and
    the width of the vectors. Null ids and vectors match nothing.
    """
    spark = corpus.sparkSession

    def kept(df: DataFrame, own: str, vec: str) -> DataFrame:
        # single precision, if that is what is stored, takes half the room on the way and loses nothing
        v = F.col(vec) if df.schema[vec].dataType.simpleString() == "array<float>" else F.col(vec).cast("array<double>")
        return df.select(F.col(own).cast("long").alias("i"), v.alias("v")).where("i IS NOT NULL AND v IS NOT NULL")

    q, c = kept(queries, q_id, q_vec), kept(corpus, c_id, c_vec)
    n_q, (n_c, width) = q.count(), c.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    cores, width = spark.sparkContext.defaultParallelism, max(WIDE, width)
    across = max(1, -(-n_q * width // (QUERY_BLOCK * WIDE)))
    down = max(1, -(-n_c * width // (CORPUS_BLOCK * WIDE)), min(-(-GROUPS * cores // across), n_c // STEP))
    # the number of partitions is given, as their few bytes would have them put together again
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * across * down)

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other)
        return rows.select("i", "v", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias(own), every).repartition(tasks, "qb", "cb")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "item_id": [], "sim": []})
        left, right = left.sort_values("i"), right.sort_values("i")
        return _best(left["i"].to_numpy(np.int64), np.stack(left["v"]).astype(np.float64), right["i"].to_numpy(np.int64), np.stack(right["v"]).astype(np.float64), k, skip_self)

    a, b = dealt(q, "qb", across, "cb", down), dealt(c, "cb", down, "qb", across)
    found = a.groupBy("qb", "cb").cogroup(b.groupBy("qb", "cb")).applyInPandas(meet, "query_id long, item_id long, sim double")
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "item_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def max_pool(hits: DataFrame, group: str) -> DataFrame:
    """Best similarity of each (query, group); similarities of -1 or less never enter."""
    return hits.where("sim > -1").groupBy("query_id", group).agg(F.max("sim").alias("sim"))
