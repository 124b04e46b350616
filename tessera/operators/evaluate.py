"""Comparison of two rankings, near misses, samples for audit, and the sweep of axis weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import hierarchy_match
from tessera.operators import metrics
from tessera.plans.stage import materialize, release

#: What is tried for a weight, and the order in which axis pairs are.
GRID = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)
ORDER = ("nn", "ee", "ech", "ne", "ee", "nq", "np", "en", "eq", "ep")


def bootstrap_ci(per_query: DataFrame, a: str, b: str, n_boot: int = 1000, seed: int = 17) -> DataFrame:
    """One row: n, delta (mean of a less mean of b), ci_low, ci_high (2.5 and 97.5 percent), p_value (share of deltas <= 0).

    Resampling queries weighs each by a Poisson draw. Only differences matter, so equal ones are counted first and a
    count c draws Poisson(c); each task returns one partial sum a replicate, whatever it read. The draws are seeded by
    the difference, so results do not hang on the partitioning. Queries where a or b is null are left out; without any
    query all but n are null.
    """
    diff = per_query.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).where("d IS NOT NULL").groupBy("d").agg(F.count("*").alias("c"))

    def draw(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, total = np.zeros(n_boot), np.zeros(n_boot)
        for pdf in it:
            for d, c in zip(pdf["d"], pdf["c"], strict=True):
                w = np.random.default_rng([seed, int(np.float64(d + 0.0).view(np.uint64))]).poisson(c, n_boot)
                weight += w
                total += w * d
        yield pd.DataFrame({"rep": np.arange(n_boot), "w": weight, "t": total})

    reps = diff.mapInPandas(draw, "rep int, w double, t double").groupBy("rep").agg((F.sum("t") / F.nullif(F.sum("w"), F.lit(0.0))).alias("delta"))
    spread = reps.agg(F.percentile("delta", F.lit(0.025)).alias("ci_low"), F.percentile("delta", F.lit(0.975)).alias("ci_high"), F.avg((F.col("delta") <= 0).cast("double")).alias("p_value"))
    return diff.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), (F.sum(F.col("c") * F.col("d")) / F.sum("c")).alias("delta")).crossJoin(F.broadcast(spread))


def soft_hits(preds: DataFrame, gold: DataFrame, codes: DataFrame, k: int, least: float = 0.75) -> DataFrame:
    """query_id, soft_hit: 1 if one of the first k is gold, or its codes agree with a gold item's at ``least`` levels.

    ``codes``: item_id, ecs (array). Queries without gold are left out.
    """
    g = gold.select("query_id", "item_id").distinct()
    # codes of a query's gold, at most as many as there are codes
    own = g.join(codes, "item_id", "left").select("query_id", F.explode_outer("ecs").alias("e")).groupBy("query_id").agg(F.collect_set("e").alias("gold_ecs"))
    top = preds.where(F.col("rank") <= k).select("query_id", "item_id").join(g.withColumn("is_gold", F.lit(1)), ["query_id", "item_id"], "left")
    seen = own.join(top, "query_id", "left").join(codes, "item_id", "left")
    near = F.coalesce(hierarchy_match("ecs", "gold_ecs") >= least, F.lit(False))
    return seen.groupBy("query_id").agg(F.max((F.col("is_gold").isNotNull() | near).cast("int")).alias("soft_hit"))


def stratified_sample(per_query: DataFrame, size: int = 50, misses_only: bool = True, seed: int = 17, bucket: str = "gold_bucket") -> DataFrame:
    """Rows for audit: the same number from each bucket, buckets in order until ``size``; all rows if there are no more.

    ``misses_only``: p1 = 0 and hits_10 = 0 only. Rows are drawn by the md5 of seed and query_id.
    """
    rows = per_query.where("p1 = 0 AND hits_10 = 0") if misses_only else per_query
    rows = rows.withColumn("_b", F.coalesce(F.col(bucket).cast("string"), F.lit("?")))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("n"))
    found = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("k")).first()
    if found["n"] <= size:
        return rows.drop("_b")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string")).cast("binary"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "query_id"))
    picked = rows.withColumn("_h", draw).withColumn("_n", at).where(F.col("_n") <= max(1, size // found["k"]))
    return picked.orderBy("_b", "_n").limit(size).drop("_b", "_h", "_n")


def _first_hit(score) -> Column:
    """Rank of the best gold candidate of ``cands``, null without one; ties go to the earlier position."""
    keyed = F.transform("cands", lambda c: F.struct(score(c).alias("s"), (-c["pos"]).alias("p"), c["hit"].alias("hit")))
    ranked = F.transform(F.reverse(F.array_sort(keyed)), lambda c: c["hit"])
    return F.nullif(F.array_position(ranked, True), F.lit(0).cast("long"))


def sweep_weights(cands: DataFrame, initial: dict[str, float], metric: str = "hits_10", rounds: int = 2, grid: tuple[float, ...] = GRID, order: tuple[str, ...] = ORDER, depth: int = 100) -> tuple[dict[str, float], float]:
    """Coordinate descent over axis weights: (weights, score).

    ``cands``: query_id, pos (1 is first), hit (boolean) and a similarity column for each axis, for queries with gold.
    The first ``depth`` of each query are written once as an array in its row, so a trial needs no shuffle, and all
    values of one axis are tried in one pass. A value is taken if it gains more than 1e-4.
    """
    if metric not in ("hits_1", "hits_10", "mrr"):
        raise ValueError(f"unknown metric {metric}")
    axes = list(initial)
    row = F.struct("pos", "hit", *(F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in axes))
    held = materialize(cands.where(F.col("pos") <= depth).groupBy("query_id").agg(F.collect_list(row).alias("cands")), "sweep")

    def gain(rank: Column) -> Column:
        kept = F.when(rank <= (1 if metric == "hits_1" else 10), 1 / rank if metric == "mrr" else F.lit(1.0))
        return F.avg(F.coalesce(kept, F.lit(0.0)))

    def scores(trials: list[dict[str, float]]) -> list[float]:
        def total(w):
            return lambda c: sum((c[x] * v for x, v in w.items() if v), F.lit(0.0))

        got = held.agg(*(gain(_first_hit(total(w))).alias(f"t{i}") for i, w in enumerate(trials))).first()
        return [got[f"t{i}"] or 0.0 for i in range(len(trials))]

    # a step ranks all values of one axis against what is held, in one pass; a round that moves nothing ends the sweep
    held_, best = dict(initial), scores([dict(initial)])[0]
    steps = [x for x in order if x in held_]
    for _ in range(rounds):
        moved = False
        for axis in steps:
            ladder = [(v, held_ | {axis: v}) for v in grid if v != held_[axis]]
            for (v, trial), got in zip(ladder, scores([t for _, t in ladder]), strict=True):
                if got - best > 1e-4:
                    best, held_, moved = got, trial, True
        if not moved:
            break
    return held_, best


#: Metrics of a comparison.
COMPARED = ("hits_1", "hits_5", "hits_10", "hits_20", "mrr", "bpref", "ec_soft_10")


def per_query(preds: DataFrame, gold: DataFrame, codes: DataFrame) -> DataFrame:
    """query_id and the metrics of COMPARED for every query that has gold."""
    plain = metrics.score_queries(preds, gold).withColumnRenamed("rr", "mrr")
    soft = soft_hits(preds, gold, codes, 10).withColumnRenamed("soft_hit", "ec_soft_10")
    return plain.join(metrics.bpref(preds, gold), "query_id").join(soft, "query_id").select("query_id", *COMPARED)


def compare_runs(base: DataFrame, tuned: DataFrame, gold: DataFrame, codes: DataFrame, direction: str = "sso", split: str = "C", n_boot: int = 1000, seed: int = 17) -> DataFrame:
    """Two rows, baseline and tuned: means of the metrics, and for tuned the gain in hits at 10 with its interval.

    ``base``, ``tuned``: query_id, item_id, rank of the same queries; ``gold``: query_id, item_id of every fold.
    """
    # each ranking and the gold are read once for every metric: written once, what ranks them runs once
    base, tuned, gold = materialize(base, "base-ranks"), materialize(tuned, "tuned-ranks"), materialize(gold.select("query_id", "item_id").distinct(), "gold")
    b, t = materialize(per_query(base, gold, codes), "compared-base"), materialize(per_query(tuned, gold, codes), "compared-tuned")
    both = b.select("query_id", F.col("hits_10").alias("b")).join(t.select("query_id", F.col("hits_10").alias("t")), "query_id")
    gain = bootstrap_ci(both, "t", "b", n_boot, seed).select(F.round("delta", 4).alias("delta_hits10_vs_baseline"), *(F.round(c, 4).alias(c) for c in ("ci_low", "ci_high", "p_value")))
    none = both.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(c) for c in gain.columns))

    def row(df: DataFrame, model: str, extra: DataFrame) -> DataFrame:
        means = df.agg(F.count("*").alias("n_test"), *(F.round(F.avg(m), 4).alias(m) for m in COMPARED))
        return means.select(F.lit(direction).alias("direction"), F.lit(split).alias("split"), "n_test", F.lit(model).alias("model"), *COMPARED).crossJoin(F.broadcast(extra))

    release(base, tuned, gold)
    return row(b, "baseline", none).union(row(t, "tuned", gain))


def run_tiers(run: Callable[[DataFrame], DataFrame], pool: DataFrame, tiers: tuple[int, ...] = (10, 100, 1000), seed: int = 17) -> list[dict]:
    """Wall time and throughput of mapping ever larger samples; a larger one holds the smaller ones.

    ``pool``: query_id. The order is that of a seeded hash; tiers beyond the pool are left out. Latencies per query are
    the wall time dealt out, as queries are mapped together.
    """
    import time

    drawn = pool.select("query_id").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "query_id").cast("binary")), "query_id")
    size, out = pool.select("query_id").distinct().count(), []
    for n in sorted(tiers):
        if n > size:
            continue
        began = time.perf_counter()
        run(drawn.limit(n)).write.format("noop").mode("overwrite").save()
        wall = time.perf_counter() - began
        out.append({"N": n, "wall_clock_s": round(wall, 3), "queries_per_sec": round(n / max(wall, 1e-9), 3), "ms_per_query": round(1000 * wall / n, 3), "pool_size": size})
    return out
