"""Readers: ids, descriptions, predictions, catalogues. Columns are found by name; formats by suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.numbering import number_rows

#: Suffixes and the column names that are tried, in this order.
INPUT_FORMATS = {".csv": "csv", ".tsv": "tsv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".parquet": "parquet", ".txt": "txt"}
ID_COLUMNS = ["id", "sso_id", "ko_id", "source_id", "query_id", "input_id"]
TEXT_COLUMNS = ["description", "desc", "text", "function", "function_name", "annotation", "label", "name", "product"]


def input_format(path: str) -> str:
    low = path.lower()
    for suffix, name in INPUT_FORMATS.items():
        if low.endswith(suffix):
            return name
    raise ValueError(f"no input format for {path}")


def pick_column(columns: list[str], known: list[str], requested: str | None = None, otherwise: str | None = None) -> str:
    """The column asked for, whatever its case; if none is, the first known name that there is, else ``otherwise``.

    ValueError, with the names there are, where that leaves nothing.
    """
    by_name = {c.lower(): c for c in reversed(columns)} | {c: c for c in columns}
    wanted = known if requested is None else [requested, requested.lower()]
    found = [by_name[w] for w in wanted if w in by_name] + ([otherwise] if requested is None and otherwise else [])
    if not found:
        raise ValueError(f"{'text column' if requested is None else repr(requested)} not found. Available columns: {columns}")
    return found[0]


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or input_format(path)
    if fmt in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="," if fmt == "csv" else "\t", multiLine=fmt == "csv", escape='"')
    if fmt == "jsonl":
        return spark.read.json(path)
    if fmt == "json":
        return spark.read.json(path, multiLine=True)
    if fmt == "parquet":
        return spark.read.parquet(path)
    rows = spark.read.text(path).select(F.trim("value").alias("value"))
    return rows.where("value <> '' AND NOT startswith(value, '#')")


def read_ids(spark: SparkSession, path: str, id_column: str | None = None, fmt: str | None = None) -> DataFrame:
    """One column, ``id``. A JSON file may be an array of strings or of objects; an empty one is an error."""
    fmt = fmt or input_format(path)
    if fmt == "json":
        raw = spark.read.text(path, wholetext=True)
        names = raw.select(F.explode(F.from_json("value", "array<string>")).alias("id")).where("id IS NOT NULL")
        if names.isEmpty():
            raise ValueError("expected a list of ids or of objects")
        if not names.where("startswith(id, '{')").isEmpty():
            df = read_table(spark, path, fmt)
            return df.select(F.col(pick_column(df.columns, ID_COLUMNS, id_column, df.columns[0])).cast("string").alias("id"))
        return names
    df = read_table(spark, path, fmt)
    column = "value" if fmt == "txt" else pick_column(df.columns, ID_COLUMNS, id_column, df.columns[0])
    return df.select(F.col(column).cast("string").alias("id"))


def read_descriptions(spark: SparkSession, path: str, text_column: str | None = None, id_column: str | None = None, fmt: str | None = None) -> DataFrame:
    """(id, description). Ids come from a named column alone; else, or where all are blank, they are FREE:00000001 on."""
    fmt = fmt or input_format(path)
    df = read_table(spark, path, fmt)
    text = "value" if fmt == "txt" else pick_column(df.columns, TEXT_COLUMNS, text_column)
    body = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("description"), (F.col(pick_column(df.columns, ID_COLUMNS, id_column, df.columns[0])).cast("string") if id_column else F.lit(None).cast("string")).alias("id"))
    if id_column and not body.where("coalesce(id, '') <> ''").isEmpty():
        return body.select("id", "description")
    # rows of a file scan stand in its order, and so do the ids that grow with place in it
    placed = body.select("description", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    return number_rows(placed, ["file", "at"]).select(F.format_string("FREE:%08d", F.col("n")).alias("id"), "description")


def parse_aliases(text: Column | str) -> tuple[Column, Column]:
    """``ns:v;v|ns:v``: the names, and a map of each other namespace to its ids; '' and 'null' are absent."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.split(F.coalesce(t, F.lit("")), r"\|"), lambda p: p.contains(":"))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.filter(F.transform(F.split(F.regexp_replace(p, "^[^:]*:", ""), ";"), lambda v: F.trim(v)), lambda v: ~v.isin("", "null")).alias("v")))
    names = F.flatten(F.transform(F.filter(pairs, lambda p: F.lower(p["k"]) == "name"), lambda p: p["v"]))
    keys = F.array_distinct(F.transform(F.filter(pairs, lambda p: F.lower(p["k"]) != "name"), lambda p: p["k"]))
    refs = F.map_from_arrays(keys, F.transform(keys, lambda k: F.flatten(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]))))
    return names, refs


def list_field(text: Column | str, separators: str) -> Column:
    """Trimmed, distinct members of a separated field; '' and 'null' are absent."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), separators), lambda v: F.trim(v)), lambda v: ~v.isin("", "null")))


def load_compounds(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.csv(path, header=True, sep="\t", quote="")
    names, refs = parse_aliases("aliases")
    synonyms = F.array_distinct(F.filter(F.concat(F.array("name", "abbreviation"), names), lambda v: v.isNotNull() & ~v.isin("", "null")))
    return d.select("id", "name", "formula", F.expr("try_cast(charge AS INT)").alias("charge"), "inchikey", F.substring_index("inchikey", "-", 1).alias("inchikey_skeleton"), (F.col("is_core") == "1").alias("is_core"), (F.col("is_obsolete") == "1").alias("is_obsolete"), synonyms.alias("synonyms"), refs.alias("db_refs"))


def load_reactions(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.csv(path, header=True, sep="\t", quote="")
    names, _ = parse_aliases("aliases")
    synonyms = F.array_distinct(F.filter(F.concat(F.array("name"), names), lambda v: v.isNotNull() & ~v.isin("", "null")))
    return d.select("id", "name", list_field("ec_numbers", "[|;]").alias("ecs"), list_field("pathways", ";").alias("pathways"), list_field("compound_ids", ";").alias("compound_ids"), "status", (F.col("is_obsolete") == "1").alias("is_obsolete"), synonyms.alias("synonyms"))


def apply_patches(reactions: DataFrame, patches: DataFrame) -> DataFrame:
    """Fill blank ec_numbers, and only those, from (reaction_id, proposed_ec)."""
    p = patches.groupBy(F.col("reaction_id").alias("id")).agg(F.max("proposed_ec").alias("__ec"))
    fill = F.when(F.trim(F.coalesce("ec_numbers", F.lit(""))) == "", F.coalesce("__ec", "ec_numbers")).otherwise(F.col("ec_numbers"))
    return reactions.join(p, "id", "left").withColumn("ec_numbers", fill).drop("__ec")


def load_predictions(df: DataFrame, topk: int = 20) -> DataFrame:
    """(query_id, items) in rank order from rows (query_id, rank, reaction_id)."""
    missing = {"query_id", "rank", "reaction_id"} - set(df.columns)
    if missing:
        raise ValueError(f"predictions lack columns {sorted(missing)}")
    kept = df.where(F.col("rank") <= topk)
    return kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "reaction_id"))), lambda s: s["reaction_id"]).alias("items"))


def parse_features(df: DataFrame) -> DataFrame:
    """Coding features of an annotation document: id, product, and its references by kind."""
    f = df.select(F.explode("features").alias("f")).where("f.type = 'cds'").select("f.*")
    place = F.concat_ws("", "contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string"))
    out = [F.coalesce("locus", "id", place).alias("id"), F.coalesce("product", F.lit("")).alias("product")]
    #: Prefixes of references, by kind.
    kinds = {"ec": ["EC:"], "ko": ["KEGG:", "KO:"], "pfam": ["PFAM:", "Pfam:"], "cog": ["COG:"], "refseq": ["RefSeq:"], "uniref100": ["UniRef100_"], "uniparc": ["UPI"]}
    for name, prefixes in kinds.items():
        pattern = "^(" + "|".join(prefixes) + ")"
        refs = F.filter("db_xrefs", lambda x, pattern=pattern: x.rlike(pattern))
        out.append((F.transform(refs, lambda x, pattern=pattern: F.regexp_replace(x, pattern, "")) if prefixes[0].endswith(":") else refs).alias(name))
    return f.select(*out)
