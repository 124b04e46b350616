"""Catalogue files: dictionaries, alias tables, gold sets, corpus facets, cached vectors, ranked predictions."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import texts
from tessera.sources.readers import input_format, load_compounds, load_reactions

#: The folder of catalogue files where none is named.
VARIABLE = "TESSERA_CATALOGUE"
#: Files of a catalogue.
FILES = {
    "compounds": "compounds.tsv",
    "reactions": "reactions.tsv",
    "ecs": "Aliases/Unique_ModelSEED_Reaction_ECs.txt",
    "pathways": "Aliases/Unique_ModelSEED_Reaction_Pathways.txt",
    "aliases": "Aliases/Unique_ModelSEED_Reaction_Aliases.txt",
    "names": "Aliases/Unique_ModelSEED_Reaction_Names.txt",
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def catalogue_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The folder given, or the one that the environment names; FileNotFoundError if neither has a compound table."""
    for candidate in (folder, os.environ.get(VARIABLE)):
        if candidate and _exists(spark, f"{candidate}/{FILES['compounds']}"):
            return candidate.rstrip("/")
    raise FileNotFoundError(f"no catalogue: name a folder with {FILES['compounds']}, or set {VARIABLE}")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep="\t", quote="")


def raw_reactions(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of the reaction table as text."""
    return read_tsv(spark, f"{folder}/{FILES['reactions']}")


def alias_lists(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(id, values): what a table of ecs, pathways or names has for each reaction, in the order of the file."""
    rows = read_tsv(spark, f"{folder}/{FILES[kind]}").select(F.col("ModelSEED ID").alias("id"), F.col("External ID").alias("v"), F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("values"))


def alias_map(spark: SparkSession, folder: str) -> DataFrame:
    """(id, aliases): external ids of each reaction by their source."""
    rows = read_tsv(spark, f"{folder}/{FILES['aliases']}").select(F.col("ModelSEED ID").alias("id"), F.col("Source").alias("source"), F.col("External ID").alias("v"), F.monotonically_increasing_id().alias("at"))
    lists = rows.groupBy("id", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("vs"))
    return lists.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("source", "vs"))).alias("aliases"))


def with_aliases(reactions: DataFrame, ecs: DataFrame, pathways: DataFrame, names: DataFrame) -> DataFrame:
    """Reactions as a mapping corpus: item_id for id, and arrays ecs, pathways and alt_names (null where there are none)."""
    out = reactions.drop("pathways", "ecs", "alt_names").withColumnRenamed("id", "item_id")
    for table, name in ((ecs, "ecs"), (pathways, "pathways"), (names, "alt_names")):
        out = out.join(table.select(F.col("id").alias("item_id"), F.col("values").alias(name)), "item_id", "left")
    return out


def load_corpus(spark: SparkSession, folder: str, include_obsolete: bool = False) -> DataFrame:
    rows = raw_reactions(spark, folder)
    if not include_obsolete:
        rows = rows.where(~F.coalesce(F.col("is_obsolete"), F.lit("")).isin("1", "true", "True"))
    return with_aliases(rows, *(alias_lists(spark, folder, k) for k in ("ecs", "pathways", "names")))


def corpus_text(corpus: DataFrame) -> DataFrame:
    """item_id, name, ec, equation, pathway and ecs: the texts that a corpus is encoded by."""
    axes = corpus.select("item_id", texts.target_axes("item_id", "name", "ec_numbers", "definition", "ecs", "pathways", "alt_names").alias("a"))
    return axes.select("item_id", texts.corpus_axes(F.col("a"), F.col("item_id")).alias("c")).select("item_id", "c.*")


def corpus_ecs(corpus: DataFrame) -> DataFrame:
    """item_id, ecs: a reaction's own codes before those of its aliases."""
    return corpus.select("item_id", texts.inline_first_ecs("ec_numbers", "ecs").alias("ecs"))


def load_model_catalogue(spark: SparkSession, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Compounds and reactions for mapping models."""
    d = catalogue_dir(spark, folder)
    return load_compounds(spark, f"{d}/{FILES['compounds']}"), load_reactions(spark, f"{d}/{FILES['reactions']}")


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(id, entry) of a JSON dictionary, whole or under ``term_hash``; entry: name, def, synonym and xref (arrays).

    label, definition, description and synonyms are read where those are missing; a single synonym is a list of one.
    """
    kind = "struct<name:string,label:string,def:string,definition:string,description:string,synonym:string,synonyms:string,xref:string>"
    raw = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.term_hash"), F.col("value"))
    each = raw.select(F.explode(F.from_json(inner, f"map<string,{kind}>")).alias("id", "e"))

    def members(c):
        several = F.from_json(c, "array<string>")
        return F.when(c.isNull(), F.array().cast("array<string>")).when(c.startswith("["), several).otherwise(F.array(c))

    def first(*names):
        return F.coalesce(*(F.nullif(F.col(f"e.{n}"), F.lit("")) for n in names))

    entry = F.struct(first("name", "label").alias("name"), first("def", "definition", "description").alias("def"), members(first("synonym", "synonyms")).alias("synonym"), members(F.col("e.xref")).alias("xref"))
    return each.select("id", entry.alias("entry"))


def load_gold_json(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, item_id) of a JSON object of lists."""
    raw = spark.read.text(path, wholetext=True)
    lists = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("query_id", "items"))
    return lists.select("query_id", F.explode("items").alias("item_id"))


def load_gold_table(spark: SparkSession, path: str) -> DataFrame:
    """query_id, seed_ids, definition, kegg_ids of an orthology table."""
    def several(c: str):
        return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: x != "").alias(c)

    return read_tsv(spark, path).select(F.col("ko_id").alias("query_id"), several("seed_ids"), F.coalesce("definition", F.lit("")).alias("definition"), several("kegg_ids"))


def load_base_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached vectors: ids, name_emb, ec_emb, eq_emb, pw_emb, and ecs from the text ``ecs_raw``."""
    return spark.read.parquet(path).withColumn("ecs", F.filter(F.split(F.coalesce("ecs_raw", F.lit("")), ";"), lambda x: x != "")).drop("ecs_raw")


def save_artifact(vectors: DataFrame, path: str) -> None:
    """(id, vector) rows as Parquet."""
    vectors.select("id", F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").parquet(path)


def load_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_ranked_lists(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, item_id, score, rank) of JSON lines {id, topk: [{rxn, score}]}."""
    rows = spark.read.schema("id string, topk array<struct<rxn:string,score:double>>").json(path)
    return rows.select(F.col("id").alias("query_id"), F.posexplode("topk").alias("at", "p")).select("query_id", F.col("p.rxn").alias("item_id"), F.col("p.score").alias("score"), (F.col("at") + 1).alias("rank"))


def _sqlite_rows(path: str, topk: int) -> Iterator[tuple]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        names = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        if "predictions" not in names:
            raise ValueError(f"{path} has no table of predictions (query_id, rank, reaction_id)")
        yield from con.execute("SELECT query_id, rank, reaction_id FROM predictions WHERE rank <= ?", (topk,))


def load_prediction_rows(spark: SparkSession, path: str, topk: int = 20) -> DataFrame:
    """(query_id, rank, reaction_id) of the first ``topk``, from Parquet, JSON, JSON lines or an SQLite file.

    JSON objects are rich results (query.id, predictions) or compact (query_id, top_ids). An SQLite file is one file on
    the driver, by its nature. FileNotFoundError and ValueError say what is missing.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"no predictions at {path}")
    if path.lower().endswith((".sqlite", ".sqlite3", ".db")):
        return spark.createDataFrame([(str(q), int(r), str(x)) for q, r, x in _sqlite_rows(path, topk)], "query_id string, rank int, reaction_id string")
    fmt = input_format(path)
    if fmt == "parquet":
        rows = spark.read.parquet(path)
        missing = {"query_id", "rank", "reaction_id"} - set(rows.columns)
        if missing:
            raise ValueError(f"predictions lack columns {sorted(missing)}; there are {sorted(rows.columns)}")
        return rows.where(F.col("rank") <= topk).select(F.col("query_id").cast("string").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("reaction_id").cast("string").alias("reaction_id"))
    if fmt not in ("json", "jsonl"):
        raise ValueError(f"no predictions in a {fmt} file")
    shape = "query_id string, query struct<id:string>, top_ids array<string>, predictions array<struct<reaction_id:string>>"
    rows = spark.read.schema(shape).json(path, multiLine=fmt == "json")
    ids = F.slice(F.coalesce("top_ids", F.transform("predictions", lambda p: p["reaction_id"]), F.array().cast("array<string>")), 1, topk)
    named = rows.select(F.coalesce("query_id", "query.id").alias("query_id"), F.posexplode(ids).alias("at", "reaction_id")).where("query_id IS NOT NULL")
    return named.select("query_id", (F.col("at") + 1).alias("rank"), "reaction_id")


def load_pairs(spark: SparkSession, path: str, seed: int = 17) -> DataFrame:
    """(source_label, target_reaction_id, split) of training pairs; without a split column eight in ten train, one in ten
    each validates and tests, drawn by a seeded hash; unknown splits train."""
    rows = read_tsv(spark, path)
    if "split" in rows.columns:
        name = F.lower(F.trim(F.coalesce("split", F.lit(""))))
        split = F.when(name.isin("train", "val", "test"), name).otherwise("train")
    else:
        draw = F.pmod(F.xxhash64(F.lit(seed), "source_label", "target_reaction_id"), F.lit(10))
        split = F.when(draw < 8, "train").when(draw == 8, "val").otherwise("test")
    return rows.select("source_label", "target_reaction_id", split.alias("split"))


def load_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """metabolites (id, name, compartment), reactions (id, name) and members (reaction_id, metabolite_id) of a model's JSON."""
    shape = "metabolites array<struct<id:string,name:string,compartment:string>>, reactions array<struct<id:string,name:string,metabolites:map<string,double>>>"
    raw = spark.read.schema(shape).json(path, multiLine=True)
    reactions = raw.select(F.explode("reactions").alias("r")).select("r.*")
    members = reactions.select(F.col("id").alias("reaction_id"), F.explode(F.map_keys("metabolites")).alias("metabolite_id"))
    return {"metabolites": raw.select(F.explode("metabolites").alias("m")).select("m.*"), "reactions": reactions.select("id", "name"), "members": members}
