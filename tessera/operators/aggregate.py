"""Deduplicate annotations of many sources, with what each came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import TRIVIAL, safe_short


def aggregate_annotations(rows: DataFrame, per_gene: bool = False, drop_trivial: bool = True, gene: str = "gene", source: str = "source", description: str = "description", term: str = "ontology_term", reactions: str = "reactions") -> DataFrame:
    """One row for each description (or gene and description): id, counts and sorted distinct provenance.

    Blank descriptions always go, trivial ones by default. Missing columns count as null. A gene that is null or blank
    is no gene of a description, but keeps its own rows per gene.
    """
    def col(name: str):
        return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in rows.columns else F.lit("")

    d = rows.select(col(gene).alias("gene"), col(source).alias("source"), col(description).alias("description"), col(term).alias("term"), F.filter(F.transform(F.split(col(reactions), ";"), lambda x: F.trim(x)), lambda x: x != "").alias("reactions"))
    d = d.where("description <> ''")
    if drop_trivial:
        d = d.where(~F.lower("description").isin(TRIVIAL))

    def members(name: str):
        return F.array_sort(F.collect_set(F.when(F.col(name) != "", F.col(name))))

    keys = ["gene", "description"] if per_gene else ["description"]
    aggs = [members("source").alias("sources"), members("term").alias("ontology_terms"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reactions")))).alias("existing_reactions")]
    if not per_gene:
        aggs.append(members("gene").alias("genes"))
    out = d.groupBy(*keys).agg(*aggs).withColumn("n_sources", F.size("sources")).withColumn("has_existing_reactions", F.size("existing_reactions") > 0)
    if per_gene:
        return out.withColumn("id", F.concat_ws("__", "gene", safe_short("description")))
    return out.withColumn("n_genes", F.size("genes")).withColumn("id", safe_short("description"))
