"""The ten registered queries. Each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, katz, language, line_dedup, mixing, projections, simhash, toxicity, url_rules, warc
from tessera.llm.text import hash_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, deleted lines, and the md5 of the text that is left."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


#: The rules of the URL query.
URL_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.host_path_rule(t, v) for t, v in URL_RULES] + [url_rules.pattern_rule(p) for p in url_rules.PATTERNS]
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = hash_mod("doc_id", 3) == 1
    model = language.fit(docs.where(~held))
    marked = docs.select("doc_id", held.alias("held_out"), "text")
    return language.identify(marked, model, keep=["held_out"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = hash_mod("doc_id", 7) == 2
    model = katz.train(docs.where(~F.coalesce(held, F.lit(False))))
    out = katz.evaluate(docs, model)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = hash_mod("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["held_out"])


#: No table has a domain column: sources are dealt into three.
DOMAIN_SQL = "concat('d', CAST(crc32(CAST(coalesce(source, '') AS BINARY)) % 3 AS STRING))"


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), F.expr(DOMAIN_SQL))


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_simhash, op3_url_filter, op4_language, op5_decontaminate, op6_warc, op7_vectors, op8_katz, op9_toxicity, op10_mixing)}


URL_SQL = """
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, rhost, rpath, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
    ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN r
      ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, b.rule, coalesce(b.verdict, CASE WHEN regexp_matches(lower(host || path), '(^|[./_-])(casino|porn|viagra|xxx|spam|ads|track)([./_-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b USING (page_id)"""

WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS low FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""


#: All pairs of a label, for tables of this size; the operator finds pairs at the threshold with probability 0.9995 each.
VECTORS_SQL = """
WITH RECURSIVE f AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
g AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.98),
r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM g UNION (SELECT g.b, min(r.component) FROM r JOIN g ON g.a = r.node JOIN recurring.r AS old ON old.node = g.b WHERE r.component < old.component GROUP BY g.b)),
n AS (SELECT a AS node, count(*) AS n FROM g GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(r.component, vec_id) AS component_id, vec_id = coalesce(r.component, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.node = vec_id LEFT JOIN r ON r.node = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": URL_SQL, "op5_decontaminate": decontaminate.oracle(), "op6_warc": WARC_SQL, "op7_vectors": VECTORS_SQL}
