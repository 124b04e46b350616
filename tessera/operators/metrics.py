"""Ranking metrics per query and over strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 5, 10, 20)


def score_queries(preds: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """query_id, hits_k, recall_k, p1, rr of every query that has gold; ``preds``: query_id, item_id, rank."""
    g = gold.select("query_id", "item_id").distinct()
    size = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hit = preds.join(g, ["query_id", "item_id"], "left_semi")
    aggs = []
    for k in ks:
        aggs += [F.max((F.col("rank") <= k).cast("int")).alias(f"hits_{k}"), F.count(F.when(F.col("rank") <= k, 1)).alias(f"found_{k}")]
    per = size.join(hit.groupBy("query_id").agg(*aggs, F.min("rank").alias("first")), "query_id", "left")
    cols = [F.coalesce(f"hits_{k}", F.lit(0)).alias(f"hits_{k}") for k in ks] + [(F.coalesce(f"found_{k}", F.lit(0)) / F.col("n_gold")).alias(f"recall_{k}") for k in ks]
    return per.select("query_id", "n_gold", *cols, F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("p1"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def bpref(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, bpref with every retrieved item outside the gold taken as not relevant."""
    g = gold.select("query_id", "item_id").distinct()
    size = g.groupBy("query_id").agg(F.count("*").alias("r"))
    marked = preds.join(g.withColumn("rel", F.lit(1)), ["query_id", "item_id"], "left")
    above = F.sum(F.when(F.col("rel").isNull(), 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    seen = marked.withColumn("above", F.coalesce(above, F.lit(0))).where("rel = 1").join(size, "query_id")
    part = seen.groupBy("query_id").agg(F.sum(1 - F.least("above", "r") / F.col("r")).alias("s"))
    return size.join(part, "query_id", "left").select("query_id", F.coalesce(F.col("s") / F.col("r"), F.lit(0.0)).alias("bpref"))
