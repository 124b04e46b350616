"""Command line: map, map-model, aggregate, annotate, cluster, describe, bench, info, texts, queries, version."""

from __future__ import annotations

import argparse
import json
import platform
import sys

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import __version__
from tessera.functions.facets import norm_key_unicode
from tessera.operators import evaluate, mapping, modelmap
from tessera.operators.aggregate import aggregate_annotations
from tessera.operators.cluster import cluster_results
from tessera.operators.refine import METHODS
from tessera.plans import catalog
from tessera.plans.session import local_session
from tessera.sources import catalogues, readers, star, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, text: str, files: bool = True) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, help=text)
        if files:
            v.add_argument("input")
            v.add_argument("output")
        return v

    v = verb("aggregate", "deduplicate annotations, with provenance")
    v.add_argument("--per-gene", action="store_true")
    v.add_argument("--keep-trivial", action="store_true")
    v = verb("annotate", "star tables of an annotated genome, as SQLite")
    v.add_argument("--genome", required=True)
    v = verb("cluster", "cluster queries by the overlap of their predictions")
    v.add_argument("--threshold", type=float, default=0.3)
    v.add_argument("--cap", type=int, default=5)
    v.add_argument("--topk", type=int, default=20)
    v.add_argument("--method", choices=METHODS, default="cc")
    def mapped(v: argparse.ArgumentParser) -> None:
        v.add_argument("--catalogue", help=f"folder of catalogue files; else the environment's {catalogues.VARIABLE}")
        v.add_argument("--direction", choices=sorted(mapping.SIGMA), default="sso")
        v.add_argument("--encoder", default="hashed")
        v.add_argument("--scorer", default="overlap")
        v.add_argument("--top-k", type=int, default=10)
        v.add_argument("--augment", action="store_true", help="add candidates that share a code")

    v = verb("map", "rank targets for descriptions, or for ids of a dictionary")
    mapped(v)
    v.add_argument("--text-column")
    v.add_argument("--id-column")
    v.add_argument("--dictionary", help="JSON dictionary; the input then holds ids")
    v = verb("map-model", "map a model's metabolites and reactions, as SQLite")
    v.add_argument("--catalogue")
    v.add_argument("--encoder", default="hashed")
    v.add_argument("--top-k", type=int, default=100)
    v.add_argument("--no-network", action="store_true")
    v = verb("describe", "rank targets for one text", files=False)
    mapped(v)
    v.add_argument("name")
    v.add_argument("--ec", default="")
    v.add_argument("--tags", default="", help="separated by semicolons")
    v.add_argument("--notes", default="")
    v = verb("bench", "time mapping over growing samples", files=False)
    mapped(v)
    v.add_argument("input")
    v.add_argument("--tiers", default="10,100,1000")
    verb("info", "versions and settings", files=False)
    v = verb("texts", "descriptions with ids and keys")
    v.add_argument("--text-column")
    v.add_argument("--id-column")
    verb("queries", "registered queries", files=False)
    verb("version", "the version", files=False)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if done, 2 if an argument or a file's form is wrong."""
    a = parser().parse_args(argv)
    if a.verb == "version":
        print(f"tessera {__version__}")
        return 0
    if a.verb == "queries":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = spark or SparkSession.getActiveSession() or local_session("tessera")
    try:
        run(a, spark)
    except (ValueError, FileNotFoundError) as e:
        print(f"tessera: {e}", file=sys.stderr)
        return 2
    return 0


def pipeline(a: argparse.Namespace, spark: SparkSession) -> mapping.Pipeline:
    corpus = catalogues.load_corpus(spark, catalogues.catalogue_dir(spark, a.catalogue))
    return mapping.Pipeline(corpus, mapping.Config(a.direction, a.encoder, a.scorer, top_k=a.top_k, augment=a.augment))


def map_input(a: argparse.Namespace, spark: SparkSession) -> DataFrame:
    pipe = pipeline(a, spark)
    if a.dictionary:
        return pipe.map_batch(readers.read_ids(spark, a.input, a.id_column), catalogues.load_dictionary(spark, a.dictionary))
    return pipe.map_descriptions(readers.read_descriptions(spark, a.input, a.text_column, a.id_column))


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.verb == "aggregate":
        out = aggregate_annotations(readers.read_table(spark, a.input), a.per_gene, not a.keep_trivial)
        lists = [c for c, t in out.dtypes if t.startswith("array")]
        flat = writers.output_format(a.output) in ("csv", "tsv")
        writers.write_results(out.drop(*lists) if flat else out, a.output)
        if flat:  # what each row came from, beside the table
            out.select("id", "description", *lists).write.mode("overwrite").json(a.output.rsplit(".", 1)[0] + ".provenance.jsonl")
    elif a.verb == "annotate":
        writers.write_sqlite(star.annotated_tables(readers.read_table(spark, a.input), a.genome, origin=a.input), a.output)
    elif a.verb == "cluster":
        rows = catalogues.load_prediction_rows(spark, a.input, a.topk)
        found = cluster_results(rows, a.threshold, a.cap, a.topk, method=a.method)
        if writers.output_format(a.output) == "sqlite":
            keep = {"queries": rows.select("query_id", F.lit(None).cast("string").alias("source_name")).distinct()}
            writers.write_sqlite(keep | writers.cluster_tables(found, a.method, a.threshold, a.cap), a.output, keys=writers.RESULT_KEYS, views=writers.CLUSTER_VIEWS)
        else:
            writers.write_results(found, a.output)
    elif a.verb == "map":
        writers.write_results(map_input(a, spark), a.output)
    elif a.verb == "map-model":
        model = catalogues.load_model(spark, a.input)
        compounds, reactions = catalogues.load_model_catalogue(spark, a.catalogue)
        found = modelmap.map_model(model, compounds, reactions, a.encoder, a.top_k, not a.no_network)
        writers.write_sqlite(modelmap.model_tables(model, found, compounds, reactions, {"version": __version__, "model": a.input}), a.output, keys=modelmap.MODEL_KEYS)
    elif a.verb == "describe":
        row = spark.createDataFrame([("FREE:00000001", a.name, a.ec, [t.strip() for t in a.tags.split(";") if t.strip()], a.notes)], "id string, name string, ec string, tags array<string>, notes string")
        for r in pipeline(a, spark).map_composed(row, "id", "name", "ec", "tags", "notes").orderBy("rank").collect():
            print(f"{r['rank']:>3}  {r['reaction_id']:<12}  {r['fused_score']:.4f}  {r['predicate']}  {r['reaction_name'] or ''}")
    elif a.verb == "bench":
        pipe = pipeline(a, spark)
        rows = readers.read_descriptions(spark, a.input)
        tiers = tuple(int(n) for n in a.tiers.split(","))
        for r in evaluate.run_tiers(lambda ids: pipe.map_descriptions(rows.join(ids.withColumnRenamed("query_id", "id"), "id")), rows.select(F.col("id").alias("query_id")), tiers):
            print(json.dumps(r))
    elif a.verb == "info":
        said = {"tessera": __version__, "pyspark": pyspark.__version__, "python": platform.python_version(), "master": spark.sparkContext.master, "catalogue": None}
        try:
            said["catalogue"] = catalogues.catalogue_dir(spark)
        except FileNotFoundError:
            pass
        print(json.dumps(said))
    else:
        d = readers.read_descriptions(spark, a.input, a.text_column, a.id_column)
        writers.write_results(d.withColumn("key", norm_key_unicode(d.columns[1])), a.output)


if __name__ == "__main__":
    sys.exit(main())
