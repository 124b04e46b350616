"""Mixing sources to target weights: budgets flow down a domain-language-source tree, leaves fill them from seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import WORD
from tessera.plans.stage import materialize, release

LEVELS = ("domain", "lang", "source")


def token_counts(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id_col, the columns to keep, n_tokens: words of the whole text."""
    return docs.select(F.col(id_col).cast("long").alias(id_col), *keep, F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))


def fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Split each parent's ``budget`` over its children by ``weight``, none beyond its ``capacity``.

    Children short of their share give the rest to their siblings by weight; only what all of them cannot hold stays
    unused here, and a parent's capacity being its children's sum, the parent's own siblings have got that already.
    In order of capacity per weight, the first children are full and the others share what is left.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = left / weights
    ranked = children.withColumn("level", level).withColumn("full", F.col("capacity") <= F.col("level") * F.col("weight") * (1 + 1e-12))
    # the first child that is not full sets the level of all after it
    ranked = ranked.withColumn("at", F.row_number().over(order)).withColumn("first", F.when(~F.col("full"), F.col("at")))
    ranked = ranked.withColumn("cut", F.min("first").over(whole)).withColumn("share", F.max(F.when(F.col("at") == F.col("cut"), F.col("level"))).over(whole))
    return ranked.withColumn("given", F.when(F.col("cut").isNull() | (F.col("at") < F.col("cut")), F.col("capacity")).otherwise(F.greatest(F.lit(0.0), F.col("share") * F.col("weight"))))


def budgets(leaves: DataFrame, total: float, max_epochs: int, weight: Column | None = None) -> DataFrame:
    """Leaves (domain, lang, source, n_docs, n_tokens) with their ``budget`` in tokens.

    ``weight``: a leaf's weight, 1 if not given; a node weighs the mean of its children, so a level shares alike.
    """
    leaf = leaves.withColumn("capacity", F.col("n_tokens").cast("double") * max_epochs).withColumn("weight", (weight if weight is not None else F.lit(1.0)).cast("double"))
    langs = leaf.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.avg("weight").alias("weight"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.avg("weight").alias("weight"))
    top = fill(domains.withColumn("root", F.lit(0)).withColumn("budget", F.lit(float(total))), ["root"], "domain").select("domain", F.col("given").alias("budget"))
    mid = fill(langs.join(top, "domain"), ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    return fill(leaf.join(mid, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEVELS, "n_docs", "n_tokens", F.col("given").alias("budget"))


def mix(docs: DataFrame, domain: Column, total: float | None = None, max_epochs: int = 2, seed: int = 17, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, domain, lang, source, n_tokens, copies: how often each document is taken, zero included.

    ``total``: tokens to take, by default as many as there are. A leaf's epochs are its documents in the order of
    md5(seed, epoch, id); it takes whole epochs while its budget holds them, then the prefix of the next one whose
    running token count stays within the budget. Documents without words cost nothing: they are taken once for each
    epoch begun ahead of them. Null domain, lang and source are nodes of their own, named ''. Rows with a null or a
    repeated id are ordered by their id's hash together: equal ids of a leaf are taken or left as one. Null and empty
    texts have no tokens, whole texts are counted, an empty table gives no rows, and other columns are not read,
    whatever their names.

    Running counts are two-level sums: of (leaf, slice of the hash) first, then within a slice, so a leaf with most rows
    is spread over many tasks. Slices are about 2,000 documents of a leaf.
    """
    tagged = docs.select(F.coalesce(domain.cast("string"), F.lit("")).alias("domain"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS[1:]), F.col(id_col), F.col(text_col))
    counted = materialize(token_counts(tagged, id_col, text_col, list(LEVELS)), "token-counts")
    leaves = materialize(counted.groupBy(*LEVELS).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "leaves")
    if total is None:
        total = leaves.agg(F.sum("n_tokens")).first()[0] or 0
    plan = budgets(leaves, float(total), max_epochs, weight)
    # whole epochs, then what is left for a prefix of the next
    epochs = F.when(F.col("n_tokens") > 0, F.least(F.lit(max_epochs), F.floor(F.col("budget") / F.col("n_tokens") + 1e-9))).otherwise(1)
    plan = plan.withColumn("whole", epochs.cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("n_tokens"))
    plan = plan.select(*LEVELS, "whole", "rest", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / 2000)).alias("slices"))
    keyed = counted.join(plan, list(LEVELS)).withColumn("order", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")))
    keyed = keyed.withColumn("slice", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("slices")).cast("long"))
    keyed = materialize(keyed, "mix-order")
    release(counted, leaves)
    slices = keyed.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("in_slice"))
    ahead = slices.withColumn("ahead", F.coalesce(F.sum("in_slice").over(Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("in_slice")
    within = Window.partitionBy(*LEVELS, "slice").orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = keyed.withColumn("upto", F.sum("n_tokens").over(within))
    taken = summed.join(ahead, [*LEVELS, "slice"]).withColumn("extra", F.when((F.col("rest") > 1e-6) & (F.col("ahead") + F.col("upto") <= F.col("rest") + 1e-6) & (F.col("whole") < max_epochs), 1).otherwise(0))
    return taken.select(id_col, *LEVELS, "n_tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies"))
