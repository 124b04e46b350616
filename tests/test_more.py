"""Facet texts, cluster methods, comparison, sweep and star tables on small inputs."""

import itertools
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import ANNOTATIONS, clusters, one

from tessera import cli
from tessera.functions import facets
from tessera.operators import evaluate, refine
from tessera.operators.cluster import cluster_embeddings
from tessera.sources import readers, star, writers


def test_names_and_facets(spark):
    assert one(spark, facets.norm_display(F.lit("  α-D-Glucose→ﬁx \n x’ "))) == "alpha-D-Glucose fix x'"
    assert one(spark, facets.norm_display(F.lit(None).cast("string"))) == ""
    assert one(spark, facets.norm_key_unicode(F.lit("β-(+)-Ｄ-Glucose(-)"))) == "betadglucose"
    assert one(spark, facets.ec_text(F.lit("4.2.1.138"))) == "EC 4.2.1.138 4.2.1.- 4.2.-.- carbon-oxygen lyase, hydro-lyase, dehydratase 4.-.-.- Lyase"
    assert one(spark, facets.ec_text(F.lit("9"))) == "EC 9 9.-.-.-" and one(spark, facets.ec_text(F.lit(""))) == ""
    none = F.lit(None).cast("string")
    assert one(spark, facets.reaction_text(F.lit("r1"), none, F.lit("null"), none)) == "Name: r1"
    assert one(spark, facets.reaction_text(F.lit("r1"), F.lit(" x "), none, none, level="bare")) == "x"
    assert one(spark, facets.reaction_text(F.lit("r1"), F.lit("x"), none, none, facets=("ec",))) == "x"
    got = one(spark, facets.role_text(F.lit("s"), F.lit("A (EC 1.1.1.1) / B @ C")))
    assert got == "Name: A (EC 1.1.1.1) / B @ C\nEC: 1.1.1.1\nComponent activities: A (EC 1.1.1.1); B @ C\nMoonlighting roles: A (EC 1.1.1.1) / B; C"
    assert one(spark, facets.ortholog_text(F.lit("K1"), F.lit("a / b [EC:1.1.1.1]"))) == "Name: a / b [EC:1.1.1.1]\nEC: 1.1.1.1\nComponent activities: a; b"
    assert one(spark, facets.ortholog_text(F.lit("K1"), F.lit("a [EC:1.1.1.1]"), "bare")) == "a"
    assert one(spark, facets.strata(F.lit("ABC transporter permease"), F.lit(7))).asDict() == {"role_type": "transporter", "gold_bucket": "6-10", "ec_present": False}


def two_groups(seed=1):
    rng = random.Random(seed)
    out = {f"a{i}": rng.sample(range(10), 7) for i in range(8)} | {f"b{i}": rng.sample(range(20, 30), 7) for i in range(8)}
    out["a0"] = out["a0"] + [20, 21, 22, 23]
    return out


@pytest.mark.parametrize("method", refine.METHODS)
def test_cluster_methods(spark, method):
    got, rows = clusters(spark, two_groups(), threshold=0.2, cap=50, topk=50, method=method, prefilter="exact")
    if method in ("louvain", "label_prop", "agglomerative"):
        assert all(len({i[0] for i in c}) == 1 for c in got.values())


def test_cluster_method_cap_and_name(spark):
    assert max(map(len, clusters(spark, two_groups(2), threshold=0.2, cap=5, method="louvain")[0].values())) <= 5
    with pytest.raises(ValueError, match="unknown method"):
        clusters(spark, {"a": [1]}, method="kmodes")


def test_average_linkage_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        d = rng.random((9, 9))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        groups = [[i] for i in range(9)]
        while len(groups) > 1:
            far, x, y = min((np.mean([d[i, j] for i in p for j in q]), k, m) for (k, p), (m, q) in itertools.combinations(enumerate(groups), 2))
            if far > 0.45:
                break
            groups[x] += groups.pop(y)
        label = refine.average_linkage(d, 0.45)
        assert sorted(map(sorted, groups)) == sorted([i for i in range(9) if label[i] == x] for x in set(label))


def test_density_and_communities():
    pts = np.concatenate([np.linspace(0, 1, 12), np.linspace(10, 11, 12), [30.0]])
    label = refine.hdbscan(np.abs(pts[:, None] - pts[None, :]), 4)
    assert len(set(label[:12])) == 1 and len(set(label[12:24])) == 1 and label[0] != label[12] and label[24] == -1
    ring = [[] for _ in range(24)]
    adj = [{} for _ in ring]
    for c in range(4):
        for x, y in itertools.combinations(range(6 * c, 6 * c + 6), 2):
            adj[x][y] = adj[y][x] = 1.0
        x, y = 6 * c, (6 * c + 7) % 24
        adj[x][y] = adj[y][x] = 0.5
    found = refine.louvain(adj)
    assert [len(set(found[6 * c : 6 * c + 6])) for c in range(4)] == [1] * 4 and len(set(found)) == 4
    assert refine.louvain([{}, {}]) == [0, 1]


def test_embedding_clusters(spark):
    v = spark.createDataFrame([(i, [float(i // 8), 1.0 - i // 8]) for i in range(16)] + [(99, None)], "id int, v array<double>")
    got = {r["item"]: r["cluster_id"] for r in cluster_embeddings(v, "id", "v").collect()}
    assert len(got) == 16 and len({got[i] for i in range(8)}) == 1 and got[0] != got[15]
    assert cluster_embeddings(v.limit(0), "id", "v").count() == 0


def test_bootstrap(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random(400) < 0.6, rng.random(400) < 0.5
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)] + [(None, 1)], "a int, b int")
    r = evaluate.bootstrap_ci(df.repartition(5), "a", "b").first()
    d = a.astype(float) - b
    want = np.percentile([d[rng.integers(0, 400, 400)].mean() for _ in range(2000)], [2.5, 97.5])
    assert r["n"] == 400 and abs(r["delta"] - d.mean()) < 1e-12
    assert abs(r["ci_low"] - want[0]) < 0.015 and abs(r["ci_high"] - want[1]) < 0.015
    again = evaluate.bootstrap_ci(df.repartition(2), "a", "b").first()
    assert abs(again["ci_low"] - r["ci_low"]) < 1e-9
    assert evaluate.bootstrap_ci(df.limit(0), "a", "b").first()["delta"] is None


def test_soft_hits(spark):
    preds = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("p", "z", 1)], "query_id string, item_id string, rank int")
    gold = spark.createDataFrame([("q", "g"), ("p", "g"), ("r", "g")], "query_id string, item_id string")
    codes = spark.createDataFrame([("g", ["1.2.3.4"]), ("y", ["1.2.3.9"]), ("z", ["1.2.9.4"])], "item_id string, ecs array<string>")
    got = {k: {r[0]: r[1] for r in evaluate.soft_hits(preds, gold, codes, k).collect()} for k in (1, 2)}
    assert got[1] == {"q": 0, "p": 0, "r": 0} and got[2] == {"q": 1, "p": 0, "r": 0}


def test_sample(spark):
    rows = spark.createDataFrame([(i, i % 2, 0, "ab"[i % 7 == 0]) for i in range(200)], "query_id int, p1 int, hits_10 int, gold_bucket string")
    got = evaluate.stratified_sample(rows, 20).collect()
    assert sorted(r["gold_bucket"] for r in got) == ["a"] * 10 + ["b"] * 10 and all(r["p1"] == 0 for r in got)
    assert got == evaluate.stratified_sample(rows.repartition(7), 20).collect()
    assert evaluate.stratified_sample(rows, 100).count() == 100 and evaluate.stratified_sample(rows.limit(0), 5).count() == 0


def test_sweep_brute_force(spark):
    rng = random.Random(9)
    cands = [(q, p, rng.random() < 0.1, round(rng.random(), 2), round(rng.random(), 2)) for q in range(40) for p in range(1, 31)]
    df = spark.createDataFrame(cands, "query_id int, pos int, hit boolean, nn double, ne double")

    def score(w):
        total = 0
        for q in range(40):
            own = sorted((c for c in cands if c[0] == q), key=lambda c: (-(0.0 + c[3] * w["nn"] + c[4] * w["ne"]), c[1]))
            total += next((1 / k for k, c in enumerate(own[:10], 1) if c[2]), 0)
        return total / 40

    w = {"nn": 0.5, "ne": 0.2}
    best = score(w)
    for _ in range(2):
        before = best
        for axis in ("nn", "ne"):
            kept = w[axis]
            for v in evaluate.GRID:
                if v != w[axis] and (s := score(w | {axis: v})) > best + 1e-4:
                    best, kept = s, v
            w[axis] = kept
        if best == before:
            break
    got, value = evaluate.sweep_weights(df, {"nn": 0.5, "ne": 0.2}, "mrr")
    assert got == w and abs(value - best) < 1e-9
    with pytest.raises(ValueError):
        evaluate.sweep_weights(df, {"nn": 1.0}, "ndcg")


def test_star(spark, tmp_path):
    df = spark.createDataFrame([*ANNOTATIONS, ("", "RAST", None, "no gene", None), ("g9", None, None, "no source", None)], "gene string, source string, ontology_term string, description string, reactions string")
    t = star.annotated_tables(df, "gen1", origin="x.tsv")
    g = t["genomes"].first()
    assert (g["n_genes"], g["n_descriptions"], g["n_annotations"]) == (5, 5, 6)
    ctx = {r["description"]: r for r in star.description_context(t).collect()}
    assert ctx["AraC family transcriptional regulator"]["genes"] == "Ac3H11_1,Ac3H11_2" and ctx["no source"]["sources"] is None
    assert ctx["Enoyl-CoA hydratase (EC 4.2.1.17)"]["existing_reactions"] == "MSRXN:rxn02167,MSRXN:rxn03245"
    writers.write_sqlite(t, str(tmp_path / "o.db"))
    with sqlite3.connect(tmp_path / "o.db") as con:
        assert con.execute("SELECT count(*) FROM annotations a JOIN annotation_sources s USING (source_id) WHERE description_id IS NULL").fetchone() == (1,)


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.tsv").write_text("gene\tsource\tontology_term\tdescription\treactions\n" + "\n".join("\t".join(x or "" for x in r) for r in ANNOTATIONS) + "\n")
    assert cli.main(["aggregate", str(tmp_path / "a.tsv"), str(tmp_path / "out.parquet")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 3
    spark.createDataFrame([("a", 1, "r1"), ("a", 2, "r2"), ("b", 1, "r1"), ("b", 2, "r2"), ("c", 1, "r9")], "query_id string, rank int, reaction_id string").write.parquet(str(tmp_path / "p.parquet"))
    assert cli.main(["cluster", str(tmp_path / "p.parquet"), str(tmp_path / "c.parquet"), "--method", "louvain"], spark) == 0
    rows = spark.read.parquet(str(tmp_path / "c.parquet")).collect()
    assert sorted((r["item"], r["cluster_size"]) for r in rows) == [("a", 2), ("b", 2), ("c", 1)]
    assert cli.main(["version"], spark) == 0 and "tessera" in capsys.readouterr().out
    assert cli.main(["aggregate", str(tmp_path / "a.docx"), "x.csv"], spark) == 2
    assert readers.input_format("x.tsv") == "tsv"
