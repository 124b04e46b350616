"""Star tables of an annotated genome, with surrogate keys, and the views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import TRIVIAL
from tessera.operators.aggregate import aggregate_annotations
from tessera.operators.numbering import number_rows


def annotated_tables(rows: DataFrame, genome_id: str, name: str | None = None, origin: str = "", drop_trivial: bool = True) -> dict[str, DataFrame]:
    """genomes, genes, annotation_sources, descriptions, annotations, existing_reactions.

    ``rows``: gene, source, description, ontology_term, reactions; null is the empty string. Annotations without a gene
    or source are left out; one whose description is trivial stays without description_id. Keys number the sorted rows.
    """
    def col(c: str):
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in rows.columns else F.lit("")

    a = rows.select(col("gene").alias("gene_id"), col("source").alias("source_name"), col("description").alias("description"), F.nullif(col("ontology_term"), F.lit("")).alias("ontology_term"), F.nullif(col("reactions"), F.lit("")).alias("raw_reactions"))
    gone = F.col("description").isin("") if not drop_trivial else F.lower("description").isin(TRIVIAL)
    described = aggregate_annotations(rows, drop_trivial=drop_trivial)
    keyed = number_rows(described.select("description", "n_genes", "n_sources", "has_existing_reactions", "existing_reactions"), ["description"])
    keyed = keyed.withColumn("description_id", F.format_string("FREE:%08d", "n"))
    genes = a.where("gene_id <> ''").select("gene_id").distinct().withColumn("genome_id", F.lit(genome_id))
    sources = number_rows(a.where("source_name <> ''").select("source_name").distinct(), ["source_name"], "source_id").select("source_id", "source_name")
    kept = a.where("gene_id <> '' AND source_name <> ''").withColumn("key", F.when(~gone, F.col("description")))
    joined = kept.join(F.broadcast(sources) if sources.count() < 10_000 else sources, "source_name").join(keyed.select(F.col("description").alias("key"), "description_id"), "key", "left")
    order = ["gene_id", "source_id", "description_id", "ontology_term", "raw_reactions"]
    annotations = number_rows(joined.select(*order), order, "annotation_id").select("annotation_id", F.lit(genome_id).alias("genome_id"), "gene_id", "source_id", "ontology_term", "description_id", "raw_reactions")
    existing = keyed.select("description_id", F.explode("existing_reactions").alias("reaction_id")).distinct()
    counts = genes.agg(F.count("*").alias("n_genes")).crossJoin(keyed.agg(F.count("*").alias("n_descriptions"))).crossJoin(annotations.agg(F.count("*").alias("n_annotations")))
    genomes = counts.select(F.lit(genome_id).alias("genome_id"), F.lit(name or genome_id).alias("name"), F.lit(origin).alias("source_tsv"), "n_genes", "n_descriptions", "n_annotations")
    return {
        "genomes": genomes,
        "genes": genes.select("gene_id", "genome_id"),
        "annotation_sources": sources,
        "descriptions": keyed.select("description_id", "description", "n_genes", "n_sources", F.col("has_existing_reactions").cast("int").alias("has_existing_reactions")),
        "annotations": annotations,
        "existing_reactions": existing,
    }


def description_context(t: dict[str, DataFrame]) -> DataFrame:
    """Each description with the sorted distinct genes, sources, terms and reactions that stand with it, comma-joined."""
    def joined(c: str):
        return F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c)

    per = t["annotations"].join(t["annotation_sources"], "source_id").groupBy("description_id").agg(joined("gene_id"), joined("source_name"), joined("ontology_term"))
    known = t["existing_reactions"].groupBy("description_id").agg(joined("reaction_id"))
    out = t["descriptions"].join(per, "description_id", "left").join(known, "description_id", "left")
    names = {"gene_id": "genes", "source_name": "sources", "ontology_term": "ontology_terms", "reaction_id": "existing_reactions"}
    return out.select(*t["descriptions"].columns, *(F.nullif(F.col(c), F.lit("")).alias(n) for c, n in names.items()))
