"""Lookup of annotated features by their references: the first kind that hits decides, then a fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a hit by each kind of reference is worth.
CONFIDENCE = {"ko": 1.0, "ec": 0.85}


def anchor_first(features: DataFrame, maps: list[tuple[str, str, DataFrame]], fallback: DataFrame | None = None) -> DataFrame:
    """id, target_ids, method, confidence, anchor for every feature.

    ``maps``: kind, the array column of references, and a table (key, target_id); kinds are tried in their order, and of
    a feature's references of a kind the first one that is known decides. ``fallback``: id, target_id, score, for
    features that no reference hits; without it, or where it says nothing, the method is none and the confidence 0.
    """
    found = None
    for order, (kind, column, table) in enumerate(maps):
        each = features.select("id", F.posexplode(column).alias("pos", "key")).join(table.select("key", "target_id").distinct(), "key")
        one = each.select("id", F.lit(order).alias("order"), "pos", F.lit(kind).alias("method"), F.col("key").alias("anchor"), "target_id", F.lit(CONFIDENCE.get(kind, 0.85)).alias("confidence"))
        found = one if found is None else found.union(one)
    if fallback is not None:
        score = fallback.select("id", F.lit(len(maps)).alias("order"), F.lit(0).alias("pos"), F.lit("embedding").alias("method"), F.lit(None).cast("string").alias("anchor"), "target_id", F.col("score").alias("confidence"))
        found = score if found is None else found.union(score)
    first = F.min(F.struct("order", "pos")).over(Window.partitionBy("id"))
    kept = found.withColumn("first", first).where((F.col("order") == F.col("first.order")) & (F.col("pos") == F.col("first.pos")))
    per = kept.groupBy("id").agg(F.array_sort(F.collect_set("target_id")).alias("target_ids"), F.first("method").alias("method"), F.max("confidence").alias("confidence"), F.first("anchor").alias("anchor"))
    out = features.select("id").join(per, "id", "left")
    return out.select("id", F.coalesce("target_ids", F.array().cast("array<string>")).alias("target_ids"), F.coalesce("method", F.lit("none")).alias("method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "anchor")
