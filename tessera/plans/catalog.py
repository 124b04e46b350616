"""Registered queries of the library and the SQL each is checked against.

Synthetic roles of the test tables: embeddings are corpus, queries and gold; orders' parts are reactions' compounds;
documents are descriptions; enzyme codes are made from keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import facets, scalar
from tessera.operators import anchors, evaluate, fuse, metrics, modelmap, retrieve
from tessera.operators.aggregate import aggregate_annotations
from tessera.operators.cluster import cluster_embeddings, cluster_sets, jaccard_components, jaccard_edges
from tessera.plans.stage import materialize
from tessera.sources import star, writers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- retrieval and metrics -------------------------------------------------------------------------------------------

TOPK_SQL = """s AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim, q.label AS ql, c.label AS cl
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id),
topk AS (SELECT query_id, item_id, round(sim, 6) AS sim, rank, ql, cl FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM s) WHERE rank <= 10)"""


def _topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieve.top_k(e, e, 10, "vec_id", "embedding", "vec_id", "embedding", skip_self=True).withColumn("sim", F.round("sim", 6))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), "label")
    t = _topk(spark, d).join(lab.select(F.col("i").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return t.join(lab.select(F.col("i").alias("item_id"), F.col("label").alias("cl")), "item_id")


@registered(f"WITH {TOPK_SQL} SELECT query_id, item_id, sim, rank FROM topk")
def ip_topk(spark, d):
    return _topk(spark, d)


@registered(f"WITH {TOPK_SQL} SELECT query_id, cl AS label, max(sim) AS sim FROM topk WHERE sim > -1 GROUP BY query_id, cl")
def topk_maxpool_label(spark, d):
    return retrieve.max_pool(_labelled(spark, d).withColumnRenamed("cl", "label"), "label")


GOLD_SQL = "gold AS (SELECT vec_id AS query_id, label, (SELECT count(*) FROM embeddings o WHERE o.label = e.label) - 1 AS n_gold FROM embeddings e)"
METRIC_SQL = f"""WITH {TOPK_SQL}, {GOLD_SQL},
m AS (SELECT query_id, max((rank <= 1)::INT) AS h1, max((rank <= 5)::INT) AS h5, max((rank <= 10)::INT) AS h10, count(*) FILTER (rank <= 10) AS f10, min(rank) AS first FROM topk WHERE ql = cl GROUP BY query_id),
per AS (SELECT g.query_id, label, coalesce(h1, 0) AS hits_1, coalesce(h5, 0) AS hits_5, coalesce(h10, 0) AS hits_10, coalesce(f10, 0) / n_gold::DOUBLE AS recall_10, coalesce((first = 1)::INT, 0) AS p1, coalesce(1.0::DOUBLE / first, 0) AS rr
  FROM gold g LEFT JOIN m USING (query_id) WHERE n_gold > 0)"""


def _label_gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per query: gold is every other vector of its label. The sizes come from label counts, so no pair is listed."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    size = e.groupBy("label").agg((F.count("*") - 1).alias("n_gold"))
    return e.join(size, "label").where("n_gold > 0"), _labelled(spark, d).where("ql = cl")


def _per_query(spark: SparkSession, d: str) -> DataFrame:
    gold, hit = _label_gold(spark, d)
    aggs = [F.max((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in (1, 5, 10)]
    m = hit.groupBy("query_id").agg(*aggs, F.count("*").alias("f10"), F.min("rank").alias("first"))
    per = gold.withColumnRenamed("vec_id", "query_id").join(m, "query_id", "left")
    return per.select("query_id", "label", *(F.coalesce(f"h{k}", F.lit(0)).alias(f"hits_{k}") for k in (1, 5, 10)), (F.coalesce("f10", F.lit(0)) / F.col("n_gold")).alias("recall_10"), F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("p1"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


@registered(METRIC_SQL + " SELECT query_id, hits_1, hits_5, hits_10, round(recall_10, 9) AS recall_10, p1, round(rr, 9) AS rr FROM per")
def hits_recall_mrr(spark, d):
    return _per_query(spark, d).select("query_id", "hits_1", "hits_5", "hits_10", F.round("recall_10", 9).alias("recall_10"), "p1", F.round("rr", 9).alias("rr"))


@registered(METRIC_SQL + " SELECT label, count(*) AS n, round(avg(hits_1), 9) AS hits_1, round(avg(hits_10), 9) AS hits_10, round(avg(recall_10), 9) AS recall_10, round(avg(rr), 9) AS mrr FROM per GROUP BY label")
def stratified_metrics(spark, d):
    avg = [F.round(F.avg(a), 9).alias(b) for a, b in (("hits_1", "hits_1"), ("hits_10", "hits_10"), ("recall_10", "recall_10"), ("rr", "mrr"))]
    return _per_query(spark, d).groupBy("label").agg(F.count("*").alias("n"), *avg)


@registered("""WITH p AS (SELECT l_orderkey AS query_id, l_partkey AS item_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2),
g AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS item_id FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT query_id, count(*) AS r FROM g GROUP BY 1),
m AS (SELECT p.*, g.item_id IS NOT NULL AS rel FROM p LEFT JOIN g USING (query_id, item_id)),
a AS (SELECT *, coalesce(sum((NOT rel)::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM m)
SELECT n.query_id, round(sum(1 - least(above, r) / r::DOUBLE) / any_value(r), 9) AS bpref FROM n JOIN a USING (query_id) WHERE rel GROUP BY 1""")
def bpref(spark, d):
    li = table(spark, d, "lineitem")
    best = li.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id")).agg(F.max("l_extendedprice").alias("v"))
    preds = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("v"), "item_id"))).drop("v")
    gold = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id"))
    return metrics.bpref(preds, gold).select("query_id", F.round("bpref", 9).alias("bpref"))


# ---- fusion ----------------------------------------------------------------------------------------------------------

AXES = {"nn": 0.75, "ne": 0.2, "nq": 0.5, "en": 0.0}


def _axes(spark: SparkSession, d: str) -> DataFrame:
    """Second signals of the top ten: inner products of quarters of the vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    t = _topk(spark, d).join(e.select(F.col("i").alias("query_id"), F.col("v").alias("a")), "query_id").join(e.select(F.col("i").alias("item_id"), F.col("v").alias("b")), "item_id")

    def part(x: int, y: int):
        return F.aggregate(F.zip_with(F.slice("a", x, 16), F.slice("b", y, 16), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return t.select("query_id", "item_id", "sim", part(1, 1).alias("nn"), part(1, 17).alias("ne"), part(1, 33).alias("nq"), part(17, 1).alias("en"))


AXES_SQL = f"""{TOPK_SQL},
ax AS (SELECT query_id, item_id, sim, list_inner_product(a[1:16], b[1:16]) AS nn, list_inner_product(a[1:16], b[17:32]) AS ne, list_inner_product(a[1:16], b[33:48]) AS nq
  FROM (SELECT t.*, q.embedding::DOUBLE[] AS a, c.embedding::DOUBLE[] AS b FROM topk t JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = item_id))"""


@registered(f"WITH {AXES_SQL} SELECT query_id, item_id, round(0.75 * nn + 0.2 * ne + 0.5 * nq, 6) AS score FROM ax")
def multi_axis_rerank(spark, d):
    return _axes(spark, d).select("query_id", "item_id", F.round(fuse.weighted_axes(None, AXES), 6).alias("score"))


FUSED_SQL = f"""{AXES_SQL},
mm AS (SELECT *, min(sim) OVER w AS a0, max(sim) OVER w AS a1, min(nn) OVER w AS b0, max(nn) OVER w AS b1 FROM ax WINDOW w AS (PARTITION BY query_id)),
fs AS (SELECT query_id, item_id, sim, 0.3 * CASE WHEN a1 - a0 < 1e-9 THEN 0 ELSE (sim - a0) / (a1 - a0) END + 0.7 * CASE WHEN b1 - b0 < 1e-9 THEN 0 ELSE (nn - b0) / (b1 - b0) END AS f FROM mm),
fused AS (SELECT query_id, item_id, round(f, 6) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, item_id) AS rank FROM fs)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fuse.sigma_fusion(_axes(spark, d), "sim", "nn", 0.3).select("query_id", "item_id", F.round("fused", 6).alias("fused"), "rank")


@registered(f"WITH {FUSED_SQL} SELECT * FROM fused")
def sigma_fusion(spark, d):
    return _fused(spark, d)


@registered(f"""WITH {FUSED_SQL}, m AS (SELECT *, round(fused - lead(fused, 1, 0.0) OVER (PARTITION BY query_id ORDER BY rank), 4) AS margin FROM fused)
SELECT query_id, item_id, fused, margin, CASE WHEN fused >= 0.9 AND margin >= 0.05 THEN 'high' WHEN fused >= 0.9 OR (fused >= 0.7 AND margin >= 0.05) THEN 'medium' ELSE 'low' END AS band FROM m WHERE rank = 1""")
def confidence_band(spark, d):
    return fuse.confidence_band(_fused(spark, d)).select("query_id", "item_id", "fused", "margin", "band")


@registered(f"WITH {FUSED_SQL} SELECT query_id, item_id, CASE WHEN fused >= 0.85 THEN 'skos:exactMatch' WHEN fused >= 0.65 THEN 'skos:closeMatch' ELSE 'skos:relatedMatch' END AS predicate FROM fused")
def predicate_bucket(spark, d):
    return _fused(spark, d).select("query_id", "item_id", scalar.predicate("fused").alias("predicate"))


@registered(f"""WITH {FUSED_SQL}, t AS (SELECT fused FROM fused WHERE rank = 1), n AS (SELECT count(*) AS n FROM t)
SELECT query_id, item_id, round((SELECT count(*) FROM t WHERE t.fused < f.fused) / (n - 1)::DOUBLE, 9) AS pct FROM fused f, n WHERE rank = 1""")
def percentile_confidence(spark, d):
    top = materialize(_fused(spark, d).where("rank = 1"), "first-ranks")  # read three times
    counts = top.groupBy("fused").agg(F.count("*").alias("c"))  # ties share a rank; scores are rounded, so they are few
    below = counts.select("fused", (F.sum("c").over(Window.orderBy("fused")) - F.col("c")).alias("low"))
    return top.join(below, "fused").select("query_id", "item_id", F.round(F.col("low") / F.lit(max(1, top.count() - 1)), 9).alias("pct"))


@registered(f"""WITH {FUSED_SQL} SELECT 'V:' || query_id AS subject_id, 'vector ' || query_id AS subject_label,
CASE WHEN fused >= 0.85 THEN 'skos:exactMatch' WHEN fused >= 0.65 THEN 'skos:closeMatch' ELSE 'skos:relatedMatch' END AS predicate_id, 'MSRXN:' || item_id AS object_id, 'vector ' || item_id AS object_label,
'semapv:SemanticSimilarityThresholdMatching' AS mapping_justification, rank FROM fused WHERE fused >= 0.5""")
def sssom_rows(spark, d):
    p = _fused(spark, d).select(F.concat(F.lit("V:"), F.col("query_id")).alias("query_id"), F.concat(F.lit("vector "), F.col("query_id")).alias("label"), F.col("item_id").cast("string").alias("item_id"), F.concat(F.lit("vector "), F.col("item_id")).alias("item_label"), F.col("fused").alias("score"), "rank")
    rows = writers.sssom_rows(p, 0.5).drop("confidence")
    ranks = p.select(F.col("query_id").alias("subject_id"), F.concat(F.lit("MSRXN:"), "item_id").alias("object_id"), "rank")
    return rows.join(ranks, ["subject_id", "object_id"])


@registered(f"WITH {FUSED_SQL} SELECT query_id, CAST(to_json({{'query_id': query_id, 'predictions': list({{'rank': rank, 'item_id': item_id, 'score': fused}} ORDER BY rank)}}) AS VARCHAR) AS json FROM fused GROUP BY query_id")
def rich_json(spark, d):
    return writers.rich_json(_fused(spark, d).withColumnRenamed("fused", "score"))


# ---- scalar functions ------------------------------------------------------------------------------------------------

CODES = "CASE WHEN p_partkey % 3 = 0 THEN p_name || ' (EC ' || p_size % 7 || '.' || p_partkey % 5 || '.' || p_size % 9 || '.' || p_partkey % 40 || ')' WHEN p_partkey % 3 = 1 THEN 'EC:' || p_size % 7 || '.2.' || p_partkey % 11 || '.- ' || p_name || ' (EC 4.2.1.17)' ELSE p_name || ' hypothetical' END"


def _coded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(CODES).alias("t"))


def _ec_query(name: str, spark_pattern: str, re2: str) -> None:
    def run(spark, d):
        return _coded(spark, d).select("p_partkey", F.array_join(scalar.extract_all("t", spark_pattern), "|").alias("ecs"))

    run.__name__ = name
    sql = f"""SELECT p_partkey, coalesce((SELECT string_agg(e, '|' ORDER BY pos) FROM (SELECT e, min(pos) AS pos FROM (SELECT unnest(l) AS e, unnest(range(len(l))) AS pos) GROUP BY e)), '') AS ecs
    FROM (SELECT p_partkey, regexp_extract_all({CODES}, '{re2}', 1) AS l FROM part)"""
    registered(sql)(run)


for _name, _pattern in (("ec_extract_any", scalar.EC_ANY), ("ec_extract_prefixed", scalar.EC_PREFIXED), ("ec_extract_bounded", scalar.EC_BOUNDED), ("ec_extract_open", scalar.EC_OPEN)):
    _ec_query(_name, _pattern, _pattern)


@registered("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' (+)-' || p_brand), '\\([+-]\\)', '', 'g'), '[^a-z0-9]+', '', 'g') AS key FROM part")
def norm_key_ascii(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.norm_key(F.concat("p_name", F.lit(" (+)-"), "p_brand")).alias("key"))


@registered("SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\-_.]', '_', 'g'), '_+', '_', 'g'), 1, 60) AS short FROM documents")
def safe_short(spark, d):
    return table(spark, d, "documents").select("doc_id", scalar.safe_short("text").alias("short"))


@registered(f"""SELECT p_partkey, CASE WHEN c = '' THEN t ELSE c END AS name FROM (SELECT p_partkey, t, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\[EC[^\\]]*\\]', '', 'gi'),
'\\s*\\(?EC[:\\s]*\\d+\\.\\d+\\.\\d+\\.[\\d\\-]+\\)?', '', 'gi'), '\\(\\s*\\)|\\[\\s*\\]', '', 'g'), '\\s{{2,}}', ' ', 'g')) AS c FROM (SELECT p_partkey, {CODES} AS t FROM part))""")
def clean_name(spark, d):
    return _coded(spark, d).select("p_partkey", scalar.clean_name("t").alias("name"))


EC1 = "concat(p_size % 7, '.', p_partkey % 5, '.', p_size % 9, '.', p_partkey % 4)"
EC2 = "concat(p_size % 7, '.', p_partkey % 3, '.', p_size % 6, '.', p_partkey % 2)"


@registered(f"SELECT p_partkey, 'EC ' || e || ' ' || split_part(e, '.', 1) || '.' || split_part(e, '.', 2) || '.' || split_part(e, '.', 3) || '.- ' || split_part(e, '.', 1) || '.' || split_part(e, '.', 2) || '.-.- ' || split_part(e, '.', 1) || '.-.-.-' AS text FROM (SELECT p_partkey, {EC1} AS e FROM part)")
def expand_ec_text(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.expand_ec(F.expr(EC1)).alias("text"))


@registered(f"""SELECT p_partkey, CASE WHEN split_part(a, '.', 1) <> split_part(b, '.', 1) THEN 0 WHEN split_part(a, '.', 2) <> split_part(b, '.', 2) THEN 0.25 WHEN split_part(a, '.', 3) <> split_part(b, '.', 3) THEN 0.5
WHEN split_part(a, '.', 4) <> split_part(b, '.', 4) THEN 0.75 ELSE 1.0 END::DOUBLE AS match, CASE WHEN a = b THEN 2 WHEN contains(a, b) OR contains(b, a) THEN 1 ELSE 0 END AS level FROM (SELECT p_partkey, {EC1} AS a, {EC2} AS b FROM part)""")
def ec_hierarchy_match(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.array(F.expr(EC1)).alias("a"), F.array(F.expr(EC2)).alias("b"))
    return x.select("p_partkey", scalar.hierarchy_match("a", "b").alias("match"), scalar.match_level("a", "b").alias("level"))


@registered(f"SELECT p_partkey, CASE WHEN contains(a, b) OR contains(b, a) THEN 0.15 ELSE 0 END::DOUBLE AS bonus FROM (SELECT p_partkey, {EC1} AS a, split_part({EC2}, '.', 1) || '.' || split_part({EC2}, '.', 2) AS b FROM part)")
def ec_bonus_level(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.array(F.expr(EC1)).alias("a"), F.array(F.substring_index(F.expr(EC2), ".", 2)).alias("b"))
    return x.select("p_partkey", F.when(scalar.match_level("a", "b") > 0, 0.15).otherwise(0.0).alias("bonus"))


@registered("""WITH q AS (SELECT p_partkey AS query_id, (p_size % 7) || '.' || (p_partkey % 5) AS ec FROM part WHERE p_partkey % 100 = 0),
c AS (SELECT p_partkey AS item_id, (p_size % 7) || '.' || (p_partkey % 5) || '.' || (p_size % 9) AS ec FROM part)
SELECT query_id, item_id, n FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS n FROM q JOIN c ON starts_with(c.ec, q.ec || '.') WHERE item_id <> query_id) WHERE n <= 20""")
def ec_augment_union(spark, d):
    """At most 20 more candidates a query, in corpus order, whose code continues the query's: all queries of a code have the
    same ones but for themselves, so the first 21 of each code meet them."""
    p = table(spark, d, "part")
    two = F.expr("concat(p_size % 7, '.', p_partkey % 5)")
    q = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), two.alias("ec"))
    at = F.row_number().over(Window.partitionBy("ec").orderBy("item_id"))
    c = p.select(F.col("p_partkey").alias("item_id"), two.alias("ec")).withColumn("at", at).where("at <= 21").drop("at")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("item_id"))
    return q.join(c, "ec").where("item_id <> query_id").withColumn("n", n).where("n <= 20").select("query_id", "item_id", "n")


@registered("""SELECT conv_id, turn, CASE WHEN n IS NULL AND e IS NULL THEN NULL ELSE concat_ws(' ', coalesce(n || ' (EC ' || e || ')', n, 'EC ' || e), '[' || r || ']', '(' || o || ')') END AS composed FROM (SELECT conv_id, turn, nullif(trim(text), '') AS n,
CASE WHEN turn % 2 = 0 THEN '1.2.3.' || turn END AS e, role || '; turn' AS r, CASE WHEN turn % 3 = 0 THEN role END AS o FROM conversations)""")
def compose_text(spark, d):
    c = table(spark, d, "conversations")
    out = scalar.compose(F.col("text"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("1.2.3."), F.col("turn"))), F.array("role", F.lit("turn")), F.when(F.col("turn") % 3 == 0, F.col("role")))
    return c.select("conv_id", "turn", out.alias("composed"))


@registered("""SELECT p_partkey, CASE WHEN regexp_matches(t, 'hypothetical', 'i') AND NOT regexp_matches(t, 'EC\\s*\\d+\\.|ligase|oxidase|kinase', 'i') THEN 0.55 * s ELSE s END AS v2_raw FROM
(SELECT p_partkey, t, p_size / 50.0::DOUBLE AS s FROM (SELECT p_partkey, p_size, """ + CODES + """ AS t FROM part))""")
def enzyme_guard(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.expr(CODES).alias("t"), (F.col("p_size") / 50.0).alias("s"))
    return x.select("p_partkey", fuse.enzyme_guard(F.col("t"), F.col("s")).alias("v2_raw"))


@registered("""WITH x AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS a, CASE WHEN p_partkey % 4 > 0 THEN p_size / 50.0::DOUBLE - (p_partkey % 10) / 100.0::DOUBLE END AS b, p_partkey % 3 = 2 AS off, """ + EC1 + " AS e1, " + EC2 + """ AS e2 FROM part),
y AS (SELECT *, (CASE WHEN off THEN a * 0.55 ELSE a END) - CASE WHEN b IS NOT NULL AND a - b < 0.04 THEN 0.10 ELSE 0 END AS s,
  split_part(e1, '.', 1) = split_part(e2, '.', 1) AND split_part(e1, '.', 2) = split_part(e2, '.', 2) AND split_part(e1, '.', 3) = split_part(e2, '.', 3) AS near FROM x),
z AS (SELECT p_partkey, greatest(0.0, least(1.0, CASE WHEN near THEN least(1.0, s + 0.05) ELSE s END)) AS v FROM y)
SELECT p_partkey, round(v, 6) AS v2_score, CASE WHEN v >= 0.85 THEN 'skos:exactMatch' WHEN v >= 0.65 THEN 'skos:closeMatch' ELSE 'skos:relatedMatch' END AS v2_predicate FROM z""")
def recalibrate_v2(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 2, "hypothetical protein").otherwise("plain").alias("desc"), F.expr(EC1).alias("q"), F.array(F.expr(EC2)).alias("c"), (F.col("p_size") / 50.0).alias("a"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size") / 50.0 - (F.col("p_partkey") % 10) / 100.0).alias("b"))
    return fuse.recalibrate(x, "desc", "q", "a", "b", "c").select("p_partkey", F.round("v2_score", 6).alias("v2_score"), "v2_predicate")


@registered("SELECT p_partkey, CASE WHEN p_size <= 1 THEN '1' WHEN p_size <= 5 THEN '2-5' WHEN p_size <= 10 THEN '6-10' ELSE '11+' END AS bucket, contains(lower(p_name), 'transport') AS transporter FROM part")
def gold_strata(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.gold_bucket("p_size").alias("bucket"), F.contains(F.lower("p_name"), F.lit("transport")).alias("transporter"))


# ---- aggregation -----------------------------------------------------------------------------------------------------


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("source"), F.when(F.col("p_partkey") % 50 == 0, " Unknown ").otherwise(F.col("p_name")).alias("description"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("T:"), F.col("p_size"))).alias("ontology_term"), F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("R1;R"), F.col("p_size"))).alias("reactions"))


ANN_SQL = """a AS (SELECT p_brand AS gene, p_type AS source, CASE WHEN p_partkey % 50 = 0 THEN 'Unknown' ELSE trim(p_name) END AS description, CASE WHEN p_partkey % 4 = 0 THEN 'T:' || p_size END AS term, CASE WHEN p_partkey % 6 = 0 THEN ['R1', 'R' || p_size] ELSE [] END AS rx FROM part),
k AS (SELECT * FROM a WHERE lower(description) NOT IN ('', 'hypothetical protein', 'putative protein', 'protein of unknown function', 'uncharacterized protein', 'unknown', 'unknown function', 'n/a', 'na', 'none'))"""


@registered(f"WITH {ANN_SQL} SELECT description, count(DISTINCT gene) AS n_genes, count(DISTINCT source) AS n_sources, count(DISTINCT term) AS n_terms, bool_or(len(rx) > 0) AS has_existing_reactions FROM k GROUP BY description")
def aggregate_global(spark, d):
    return aggregate_annotations(_annotations(spark, d)).select("description", F.col("n_genes").cast("long").alias("n_genes"), F.col("n_sources").cast("long").alias("n_sources"), F.size("ontology_terms").cast("long").alias("n_terms"), "has_existing_reactions")


@registered(f"WITH {ANN_SQL} SELECT gene, description, count(DISTINCT source) AS n_sources FROM k GROUP BY gene, description")
def aggregate_per_gene(spark, d):
    return aggregate_annotations(_annotations(spark, d), per_gene=True).select("gene", "description", F.col("n_sources").cast("long").alias("n_sources"))


@registered(f"WITH {ANN_SQL} SELECT description, string_agg(DISTINCT gene, '|' ORDER BY gene) AS genes, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, coalesce(string_agg(DISTINCT term, '|' ORDER BY term), '') AS terms FROM k GROUP BY description")
def provenance_sets(spark, d):
    return aggregate_annotations(_annotations(spark, d)).select("description", *(F.array_join(c, "|").alias(n) for c, n in (("genes", "genes"), ("sources", "sources"), ("ontology_terms", "terms"))))


@registered("SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0")
def trivial_filter(spark, d):
    t = F.when(F.col("p_partkey") % 50 == 0, " N/A ").otherwise(F.col("p_name"))
    return table(spark, d, "part").where(~F.lower(F.trim(t)).isin(scalar.TRIVIAL)).select("p_partkey")


@registered("SELECT event_type, count(*) AS n, list_sort(list(value))[floor(0.5 * count(*))::INT + 1] AS p50, list_sort(list(value))[floor(0.95 * count(*))::INT + 1] AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    """The value at index int(q n) of the sorted values, from counts by value: no group is gathered in one row."""
    v = table(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    n = v.groupBy("event_type").agg(F.sum("c").alias("n"))
    upto = F.sum("c").over(Window.partitionBy("event_type").orderBy("value"))
    w = v.withColumn("upto", upto).join(n, "event_type")
    at = [F.min(F.when(F.col("upto") > F.floor(F.lit(q) * F.col("n")), F.col("value"))).alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"))]
    return w.groupBy("event_type").agg(F.first("n").alias("n"), *at)


# ---- joins -----------------------------------------------------------------------------------------------------------


@registered("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def nongold_antijoin(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "n_chars")


@registered("SELECT lang, count(*) AS n_docs, count(l.doc_id) AS n_gold, round(count(l.doc_id) / count(*)::DOUBLE, 9) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang")
def gold_coverage(spark, d):
    g = table(spark, d, "labels").select("doc_id").distinct().withColumn("g", F.lit(1))
    out = table(spark, d, "documents").select("doc_id", "lang").join(g, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n_docs"), F.count("g").alias("n_gold"))
    return out.withColumn("coverage", F.round(F.col("n_gold") / F.col("n_docs"), 9))


@registered("""WITH q AS (SELECT c_custkey AS query_id, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS k FROM customer),
s AS (SELECT DISTINCT s_suppkey AS item_id, replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g'), 'supplier', 'customer') AS k FROM supplier) SELECT query_id, item_id FROM q JOIN s USING (k)""")
def exact_key_join(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), scalar.norm_key("c_name").alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("item_id"), F.replace(scalar.norm_key("s_name"), F.lit("supplier"), F.lit("customer")).alias("k")).distinct()
    return q.join(s, "k").select("query_id", "item_id")


def _bridge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as sets of parts: queries, targets, and the 14 parts that most orders hold (ties: the smaller key)."""
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target_id"), F.col("l_partkey").alias("member")).distinct()
    q = b.where("target_id % 100 = 0").withColumnRenamed("target_id", "query_id")
    top = b.groupBy("member").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "member").limit(14).select("member")
    return q, b, F.broadcast(top)


BRIDGE_SQL = """b AS (SELECT DISTINCT l_orderkey AS target_id, l_partkey AS member FROM lineitem), q AS (SELECT target_id AS query_id, member FROM b WHERE target_id % 100 = 0),
u AS (SELECT member FROM b GROUP BY member ORDER BY count(*) DESC, member LIMIT 14), nq AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
c AS (SELECT query_id, target_id, count(*) AS shared FROM q JOIN b USING (member) GROUP BY 1, 2), cand AS (SELECT query_id, target_id, shared FROM c JOIN nq USING (query_id) WHERE shared >= 2 OR shared = n)"""


@registered(f"WITH {BRIDGE_SQL} SELECT * FROM cand")
def overlap_candidates(spark, d):
    q, b, _ = _bridge(spark, d)
    return modelmap.overlap_candidates(q, b)


@registered(f"""WITH {BRIDGE_SQL}, q2 AS (SELECT * FROM q WHERE member NOT IN (FROM u)), b2 AS (SELECT * FROM b WHERE member NOT IN (FROM u)),
x AS (SELECT query_id, target_id, shared, (SELECT count(*) FROM q2 WHERE q2.query_id = cand.query_id) AS nq, (SELECT count(*) FROM b2 WHERE b2.target_id = cand.target_id) AS nt,
  (SELECT count(*) FROM q2 JOIN b2 USING (member) WHERE q2.query_id = cand.query_id AND b2.target_id = cand.target_id) AS cm FROM cand)
SELECT query_id, target_id, shared, round(cm / greatest(nq + nt - cm, 1)::DOUBLE, 9) AS core, (cm = nq AND cm = nt AND cm > 0)::INT AS exact FROM x""")
def core_jaccard(spark, d):
    q, b, u = _bridge(spark, d)
    out = modelmap.core_jaccard(modelmap.overlap_candidates(q, b), q, b, u)
    return out.withColumn("core", F.round("core", 9))


@registered("SELECT o_orderkey, CASE WHEN o_custkey % 17 = 0 THEN -1 WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'F' THEN 0 ELSE 0.3 END::DOUBLE AS prior FROM orders")
def canon_prior(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "OK").when(F.col("o_orderstatus") == "F", "MI:1").otherwise("other")
    return table(spark, d, "orders").select("o_orderkey", modelmap.canon_prior(status, F.col("o_custkey") % 17 == 0).alias("prior"))


@registered(f"WITH {BRIDGE_SQL}, k AS (SELECT * FROM b WHERE member NOT IN (FROM u)) SELECT x.member, count(DISTINCT y.member) AS degree FROM k x JOIN k y ON x.target_id = y.target_id AND x.member <> y.member GROUP BY 1")
def cooccurrence_degree(spark, d):
    _, b, u = _bridge(spark, d)
    return modelmap.cooccurrence(b, u).groupBy("member").agg(F.count("*").alias("degree"))


@registered(f"""WITH {BRIDGE_SQL}, k AS (SELECT * FROM b WHERE member NOT IN (FROM u)), co AS (SELECT DISTINCT x.member, y.member AS other FROM k x JOIN k y ON x.target_id = y.target_id AND x.member <> y.member),
nb AS (SELECT query_id, member FROM q WHERE member NOT IN (FROM u)), n AS (SELECT query_id, count(*) AS n FROM nb GROUP BY 1)
SELECT nb.query_id, cand.member AS candidate, round(count(co.other) / any_value(n)::DOUBLE, 9) AS net FROM (SELECT DISTINCT query_id, member FROM nb) cand JOIN nb USING (query_id) JOIN n USING (query_id)
LEFT JOIN co ON co.member = cand.member AND co.other = nb.member GROUP BY 1, 2""")
def network_net(spark, d):
    """Share of a set's members that a candidate stands with somewhere."""
    q, b, u = _bridge(spark, d)
    core = q.join(u, "member", "left_anti")
    n = core.groupBy("query_id").agg(F.count("*").alias("n"))
    co = modelmap.cooccurrence(b, u)
    cand = core.select("query_id", F.col("member").alias("candidate"))
    met = cand.join(core, "query_id").join(co.select(F.col("member").alias("candidate"), F.col("other").alias("member"), F.lit(1).alias("hit")), ["candidate", "member"], "left")
    return met.groupBy("query_id", "candidate").agg(F.count("hit").alias("h")).join(n, "query_id").select("query_id", "candidate", F.round(F.col("h") / F.col("n"), 9).alias("net"))


# ---- set join and clusters -------------------------------------------------------------------------------------------


def _sets(spark: SparkSession, d: str) -> DataFrame:
    """All orders as sets of part groups: few elements, large overlaps."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("idx"), (F.col("l_partkey") % 97).alias("element")).distinct()


SETS_SQL = """m AS (SELECT DISTINCT l_orderkey AS idx, l_partkey % 97 AS element FROM lineitem), z AS (SELECT idx, count(*) AS n FROM m GROUP BY 1),
p AS (SELECT a.idx AS a, b.idx AS b, count(*) AS shared FROM m a JOIN m b ON a.element = b.element AND a.idx < b.idx GROUP BY 1, 2),
e AS (SELECT a, b, shared, shared / (x.n + y.n - shared)::DOUBLE AS jaccard FROM p JOIN z x ON x.idx = a JOIN z y ON y.idx = b)"""


@registered(f"WITH {SETS_SQL} SELECT a, b, shared, round(jaccard, 9) AS jaccard FROM e WHERE jaccard >= 0.5")
def jaccard_edges_exact(spark, d):
    return jaccard_edges(_sets(spark, d), 0.5, "exact").withColumn("jaccard", F.round("jaccard", 9))


@registered(f"WITH {SETS_SQL}, k AS (SELECT ceil(2 * max(n) * 0.2 / 1.2 - 1e-9) AS f FROM z) SELECT a, b, shared, round(jaccard, 9) AS jaccard FROM e, k WHERE jaccard >= 0.2 AND shared >= f")
def jaccard_edges_compat(spark, d):
    return jaccard_edges(_sets(spark, d), 0.2, "compat").withColumn("jaccard", F.round("jaccard", 9))


@registered(f"""WITH RECURSIVE {SETS_SQL}, g AS (SELECT a, b FROM e WHERE jaccard >= 0.6 UNION ALL SELECT b, a FROM e WHERE jaccard >= 0.6),
r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM g UNION (SELECT g.b, min(r.component) FROM r JOIN g ON g.a = r.node JOIN recurring.r AS old ON old.node = g.b WHERE r.component < old.component GROUP BY g.b))
SELECT node, component FROM r""")
def components(spark, d):
    return jaccard_components(_sets(spark, d), 0.6)


def _clusters(spark: SparkSession, d: str, method: str = "cc") -> DataFrame:
    sets = _sets(spark, d).groupBy("idx").agg(F.array_sort(F.collect_list(F.col("element").cast("string"))).alias("items"))
    return cluster_sets(sets, "idx", "items", 0.5, 5, prefilter="exact", method=method)


@registered()
def capped_clusters(spark, d):
    return _clusters(spark, d)


@registered()
def cluster_overview(spark, d):
    return _clusters(spark, d).groupBy("cluster_id").agg(F.first("cluster_size").alias("cluster_size"), F.first("cohesion").alias("cohesion"), F.array_join(F.array_sort(F.collect_list("item")), "|").alias("members"))


@registered("""SELECT query_id, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities, max(n) AS top FROM
(SELECT o_custkey AS query_id, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def description_context(spark, d):
    """Star-table view: per customer the distinct priorities of its orders and the most frequent one's count."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("query_id"), "o_orderpriority").agg(F.count("*").alias("n"))
    return n.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), "|").alias("priorities"), F.max("n").alias("top"))


@registered("""SELECT * FROM (SELECT o_custkey AS query_id, o_orderkey AS item_id, c_name AS name, n_name AS nation, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) WHERE rank <= 3""")
def top_n_with_meta(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    best = o.withColumn("rank", rank).where("rank <= 3")
    return best.join(c, best.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"), "rank")


@registered("""WITH x AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id FROM events), ko AS (SELECT p_partkey AS k, min(p_name) AS target FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), ec AS (SELECT s_suppkey AS k, min(s_name) AS target FROM supplier GROUP BY 1)
SELECT event_id, coalesce(ko.target, ec.target) AS target, CASE WHEN ko.target IS NOT NULL THEN 'ko' WHEN ec.target IS NOT NULL THEN 'ec' ELSE 'none' END AS method, CASE WHEN ko.target IS NOT NULL THEN 1.0 WHEN ec.target IS NOT NULL THEN 0.85 ELSE 0 END::DOUBLE AS confidence
FROM x LEFT JOIN ko ON ko.k = x.k LEFT JOIN ec ON ec.k = x.k""")
def anchor_first(spark, d):
    """First anchor that hits: one kind of reference, then another, then none."""
    x = table(spark, d, "events").select(F.col("event_id").alias("id"), F.array(F.get_json_object("props", "$.k").cast("int")).alias("k"))
    ko = table(spark, d, "part").where("p_partkey % 3 = 0").groupBy(F.col("p_partkey").cast("int").alias("key")).agg(F.min("p_name").alias("target_id"))
    ec = table(spark, d, "supplier").groupBy(F.col("s_suppkey").cast("int").alias("key")).agg(F.min("s_name").alias("target_id"))
    hits = anchors.anchor_first(x, [("ko", "k", ko), ("ec", "k", ec)])
    return hits.select(F.col("id").alias("event_id"), F.get("target_ids", F.lit(0)).alias("target"), "method", "confidence")


@registered()
def clusters_louvain(spark, d):
    return _clusters(spark, d, "louvain")


@registered()
def clusters_label_prop(spark, d):
    return _clusters(spark, d, "label_prop")


@registered()
def clusters_agglomerative(spark, d):
    return _clusters(spark, d, "agglomerative")


@registered()
def clusters_hdbscan(spark, d):
    return _clusters(spark, d, "hdbscan")


@registered()
def embedding_kmeans(spark, d):
    return cluster_embeddings(table(spark, d, "embeddings"), "vec_id", "embedding")


# ---- facet texts, audit samples, comparison, star tables -------------------------------------------------------------


def _cases(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@registered(f"""SELECT p_partkey, concat_ws(' ', 'EC ' || e, a || '.' || b || '.' || c || '.-', a || '.' || b || '.-.-', {_cases(facets.SUBCLASS_HINTS, "a || '.' || b")}, a || '.-.-.-', {_cases(facets.CLASS_NAMES, "a")}) AS text
FROM (SELECT p_partkey, e, split_part(e, '.', 1) AS a, split_part(e, '.', 2) AS b, split_part(e, '.', 3) AS c FROM (SELECT p_partkey, {EC1} AS e FROM part))""")
def ec_text(spark, d):
    return table(spark, d, "part").select("p_partkey", facets.ec_text(F.expr(EC1)).alias("text"))


@registered("""SELECT p_partkey, trim(regexp_replace('alpha-' || p_name || '  betaomega ' || p_brand || '''', '\\s+', ' ', 'g')) AS name FROM part""")
def norm_display(spark, d):
    raw = F.concat(F.lit("α-"), "p_name", F.lit("　→βω \t "), "p_brand", F.lit("’ "))
    return table(spark, d, "part").select("p_partkey", facets.norm_display(raw).alias("name"))


ROLE = "CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, ' / ', p_brand) WHEN p_partkey % 5 = 1 THEN concat(p_name, ' @ ', p_brand, ' (EC 1.2.3.4)') WHEN p_partkey % 5 = 2 THEN '' WHEN p_partkey % 5 = 3 THEN concat(p_name, ' transporter') ELSE concat(p_name, ' hypothetical') END"


@registered(f"""SELECT p_partkey, concat_ws(chr(10), 'Name: ' || CASE WHEN n = '' THEN 'P' || p_partkey ELSE n END, CASE WHEN contains(n, '(EC 1.2.3.4)') THEN 'EC: 1.2.3.4' END, CASE WHEN contains(n, ' / ') THEN 'Component activities: ' || replace(n, ' / ', '; ') END,
CASE WHEN contains(n, ' @ ') THEN 'Moonlighting roles: ' || replace(n, ' @ ', '; ') END) AS text, CASE WHEN contains(n, 'hypothetical') THEN 'hypothetical' WHEN contains(n, 'transporter') THEN 'transporter' WHEN contains(n, ' / ') OR contains(n, ' @ ') THEN 'multifunction' ELSE 'single-function' END AS role_type
FROM (SELECT p_partkey, trim({ROLE}) AS n FROM part)""")
def role_facets(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(ROLE).alias("n"))
    return p.select("p_partkey", facets.role_text(F.concat(F.lit("P"), "p_partkey"), "n").alias("text"), facets.role_type("n").alias("role_type"))


@registered(f"""SELECT p_partkey, concat_ws(chr(10), 'Name: ' || trim(p_name), 'Synonyms: ' || p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'Equation: ' || trim(p_type) END,
'EC: ' || CASE WHEN {EC1} = {EC2} THEN {EC1} ELSE {EC1} || ', ' || {EC2} END, 'Pathway: ' || p_type, 'KEGG reactions: R1, R2') AS text FROM part""")
def reaction_facets(spark, d):
    p = table(spark, d, "part")
    definition = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("null")
    text = facets.reaction_text("p_partkey", "p_name", definition, F.expr(EC2), ecs=F.array(F.expr(EC1)), pathways=F.array("p_type", "p_type"), kegg=F.array(F.lit("R1"), F.lit("R2")), synonyms=F.array(F.upper(F.trim("p_name")), F.lit(""), "p_brand"))
    return p.select("p_partkey", text.alias("text"))


@registered("""WITH r AS (SELECT o_orderkey AS query_id, CASE WHEN o_custkey % 12 <= 1 THEN '1' WHEN o_custkey % 12 <= 5 THEN '2-5' WHEN o_custkey % 12 <= 10 THEN '6-10' ELSE '11+' END AS gold_bucket FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY gold_bucket ORDER BY md5('17:' || query_id), query_id) AS n FROM r) SELECT query_id, gold_bucket FROM k WHERE n <= 12""")
def audit_sample(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("p1"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("hits_10"), scalar.gold_bucket(F.col("o_custkey") % 12).alias("gold_bucket"))
    return evaluate.stratified_sample(o, 50).select("query_id", "gold_bucket")


@registered("""WITH p AS (SELECT l_orderkey AS query_id, l_partkey AS item_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2),
g AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS item_id FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT p_partkey AS item_id, concat(p_size % 7, '.', p_partkey % 5, '.', p_size % 9) AS three FROM part),
x AS (SELECT DISTINCT query_id, three FROM g JOIN c USING (item_id)), h AS (SELECT query_id FROM p JOIN g USING (query_id, item_id) WHERE rank <= 2 UNION SELECT query_id FROM p JOIN c USING (item_id) JOIN x USING (query_id, three) WHERE rank <= 2)
SELECT query_id, (query_id IN (FROM h))::INT AS soft_hit FROM (SELECT DISTINCT query_id FROM g)""")
def soft_hits(spark, d):
    li = table(spark, d, "lineitem")
    best = li.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id")).agg(F.max("l_extendedprice").alias("v"))
    preds = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("v"), "item_id")))
    gold = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id"))
    codes = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.array(F.expr(EC1)).alias("ecs"))
    return evaluate.soft_hits(preds, gold, codes, 2)


@registered()
def bootstrap_ci(spark, d):
    """Hits at 10 against the reciprocal rank of the same queries."""
    return evaluate.bootstrap_ci(_per_query(spark, d), "hits_10", "rr")


@registered()
def weight_sweep(spark, d):
    lab = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").alias("l"))
    x = _axes(spark, d).join(lab.select(F.col("i").alias("query_id"), F.col("l").alias("ql")), "query_id").join(lab.select(F.col("i").alias("item_id"), F.col("l").alias("cl")), "item_id")
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "item_id"))
    cands = x.select("query_id", pos.alias("pos"), F.coalesce(F.col("ql") == F.col("cl"), F.lit(False)).alias("hit"), *AXES)
    weights, best = evaluate.sweep_weights(cands, AXES, "mrr")
    return spark.createDataFrame([(k, v, best) for k, v in weights.items()], "axis string, weight double, score double")


@registered(f"""WITH {ANN_SQL}, i AS (SELECT description, row_number() OVER (ORDER BY description) AS n FROM (SELECT DISTINCT description FROM k))
SELECT printf('FREE:%08d', n) AS description_id, description, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT term, ',' ORDER BY term) AS ontology_terms FROM k JOIN i USING (description) GROUP BY 1, 2""")
def annotated_context(spark, d):
    t = star.annotated_tables(_annotations(spark, d), "genome")
    return star.description_context(t).select("description_id", "description", "genes", "sources", "ontology_terms")


def _all() -> None:
    from tessera.plans import mapping_queries  # noqa: F401  registers the others


def queries() -> dict:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(ORACLE)
