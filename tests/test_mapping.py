"""Catalogue files, the mapping pipeline, model mapping, result files and the verbs that use them."""

import json
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import one

from tessera import cli
from tessera.functions import texts
from tessera.operators import encode, evaluate, mapping, modelmap, retrieve
from tessera.operators.anchors import anchor_first
from tessera.sources import catalogues, readers, writers

REACTIONS = [
    ("rxn1", "alcohol dehydrogenase", "ethanol <=> acetaldehyde", "1.1.1.1", "0", "OK", "cpd1;cpd2;cpd00001"),
    ("rxn2", "citrate synthase", "null", "2.3.3.1|2.3.3.16", "0", "MI:1", "cpd3;cpd4"),
    ("rxn3", "old alcohol dehydrogenase", "x", "1.1.1.1", "1", "OK", "cpd1"),
    ("rxn4", "glucose transport", "", "", "0", "CPDFORMERROR", "cpd5"),
    ("rxn5", "", "", "1.1.1.100", "0", None, "cpd2;cpd6"),
]
COMPOUNDS = [("cpd1", "Ethanol", "EtOH", "1", "0"), ("cpd2", "Acetaldehyde", "null", "0", "0"), ("cpd3", "Citrate", "cit", "0", "0"), ("cpd4", "Oxaloacetate", "oaa", "0", "0"), ("cpd5", "D-Glucose", "glc", "1", "0"), ("cpd6", "Old thing", "old", "0", "1"), ("cpd00001", "Water", "H2O", "1", "0")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("catalogue")
    (d / "Aliases").mkdir()
    rows = ["id\tname\tdefinition\tec_numbers\tis_obsolete\tstatus\tcompound_ids\tpathways\taliases"]
    rows += ["\t".join([i, n, q, e, o, s or "", c, "", f"Name: {n} alt"]) for i, n, q, e, o, s, c in REACTIONS]
    (d / "reactions.tsv").write_text("\n".join(rows) + "\n")
    rows = ["id\tname\tabbreviation\tformula\tcharge\tinchikey\tis_core\tis_obsolete\taliases"]
    rows += ["\t".join([i, n, a, "", "", "", c, o, ""]) for i, n, a, c, o in COMPOUNDS]
    (d / "compounds.tsv").write_text("\n".join(rows) + "\n")
    head = "ModelSEED ID\tExternal ID\tSource\n"
    (d / catalogues.FILES["ecs"]).write_text(head + "rxn1\t1.1.1.2\tx\nrxn1\t1.1.1.1\tx\n")
    (d / catalogues.FILES["pathways"]).write_text(head + "rxn1\tp1\tKEGG\nrxn1\tp1\tMetaCyc\nrxn1\tp2\tKEGG\n")
    (d / catalogues.FILES["names"]).write_text(head + "rxn1\tALCOHOL dehydrogenase\tx\nrxn1\tADH\tx\n")
    (d / catalogues.FILES["aliases"]).write_text(head + "rxn1\tR1\tKEGG\nrxn1\tR2\tKEGG\nrxn1\tM1\tMetaCyc\n")
    return str(d)


def test_catalogue(spark, folder, monkeypatch):
    monkeypatch.delenv(catalogues.VARIABLE, raising=False)
    with pytest.raises(FileNotFoundError):
        catalogues.catalogue_dir(spark)
    monkeypatch.setenv(catalogues.VARIABLE, folder)
    assert catalogues.catalogue_dir(spark) == folder
    corpus = catalogues.load_corpus(spark, folder)
    assert {r["item_id"] for r in corpus.collect()} == {"rxn1", "rxn2", "rxn4", "rxn5"}
    t = {r["item_id"]: r for r in catalogues.corpus_text(corpus).collect()}
    assert t["rxn1"]["name"] == "alcohol dehydrogenase ; ADH" and t["rxn1"]["ecs"] == ["1.1.1.2", "1.1.1.1"] and t["rxn1"]["pathway"] == "p1 ; p2"
    assert t["rxn2"]["equation"] == "citrate synthase" and t["rxn5"]["name"] == "rxn5" and t["rxn4"]["ec"] == "glucose transport"
    assert {r["item_id"]: r["ecs"] for r in catalogues.corpus_ecs(corpus).collect()}["rxn1"] == ["1.1.1.1", "1.1.1.2"]
    assert catalogues.alias_map(spark, folder).first()["aliases"] == {"KEGG": ["R1", "R2"], "MetaCyc": ["M1"]}
    compounds, reactions = catalogues.load_model_catalogue(spark, folder)
    assert {r["id"]: r["synonyms"] for r in compounds.collect()}["cpd2"] == ["Acetaldehyde"]
    assert {r["id"]: r["compound_ids"] for r in reactions.collect()}["rxn2"] == ["cpd3", "cpd4"]


def test_dictionary_and_gold(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"term_hash": {"S:1": {"name": "kinase (EC 2.7.1.1)", "synonym": ["a", "EC 1.1.1.1"], "xref": ["EC:3.1.1.1", "X:2"]}, "2": {"label": "other", "synonyms": "one", "description": "d"}}}))
    d = catalogues.load_dictionary(spark, str(tmp_path / "d.json"))
    ids = spark.createDataFrame([("S:1",), ("NS:2",), ("S:3",)], "query_id string")
    rows = {r["query_id"]: r["m"] for r in mapping.lookup(ids, d).select("query_id", texts.entry_metadata("query_id", F.col("entry")).alias("m")).collect()}
    assert rows["S:1"]["ecs"] == ["2.7.1.1", "1.1.1.1", "3.1.1.1"] and rows["S:1"]["aliases"] == ["a", "EC 1.1.1.1"]
    assert (rows["NS:2"]["name"], rows["NS:2"]["definition"], rows["NS:2"]["aliases"]) == ("other", "d", ["one"])
    assert (rows["S:3"]["name"], rows["S:3"]["ecs"], rows["S:3"]["definition"]) == ("S:3", [], None)
    (tmp_path / "g.json").write_text(json.dumps({"S:1": ["rxn1", "rxn2"], "S:2": []}))
    assert {tuple(r) for r in catalogues.load_gold_json(spark, str(tmp_path / "g.json")).collect()} == {("S:1", "rxn1"), ("S:1", "rxn2")}
    (tmp_path / "k.tsv").write_text("ko_id\tseed_ids\tdefinition\tkegg_ids\nK1\trxn1;rxn2\tdef\t\n")
    assert tuple(catalogues.load_gold_table(spark, str(tmp_path / "k.tsv")).first()) == ("K1", ["rxn1", "rxn2"], "def", [])
    (tmp_path / "t.jsonl").write_text('{"id": "a", "topk": [{"rxn": "r1", "score": 0.5}, {"rxn": "r2", "score": 0.4}]}\n')
    assert [tuple(r) for r in catalogues.load_ranked_lists(spark, str(tmp_path / "t.jsonl")).collect()] == [("a", "r1", 0.5, 1), ("a", "r2", 0.4, 2)]
    (tmp_path / "p.tsv").write_text("source_label\ttarget_reaction_id\tsplit\na\tr1\tTrain\nb\tr2\tdev\nc\tr3\ttest\n")
    assert [r["split"] for r in catalogues.load_pairs(spark, str(tmp_path / "p.tsv")).collect()] == ["train", "train", "test"]
    (tmp_path / "q.tsv").write_text("source_label\ttarget_reaction_id\n" + "".join(f"a{i}\tr\n" for i in range(400)))
    n = {r["split"]: r["count"] for r in catalogues.load_pairs(spark, str(tmp_path / "q.tsv")).groupBy("split").count().collect()}
    assert n["train"] > 270 and n["val"] > 15 and n["test"] > 15


def test_prediction_files(spark, tmp_path):
    want = {("a", 1, "r1"), ("a", 2, "r2"), ("b", 1, "r9")}
    with sqlite3.connect(tmp_path / "p.sqlite") as con:
        con.execute("CREATE TABLE predictions (query_id TEXT, rank INT, reaction_id TEXT)")
        con.executemany("INSERT INTO predictions VALUES (?, ?, ?)", [*want, ("a", 3, "r3")])
    rich = [{"query": {"id": "a"}, "predictions": [{"reaction_id": "r1"}, {"reaction_id": "r2"}, {"reaction_id": "r3"}]}, {"query_id": "b", "top_ids": ["r9"]}]
    (tmp_path / "p.json").write_text(json.dumps(rich))
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rich)))
    for name in ("p.sqlite", "p.json", "p.jsonl"):
        assert {tuple(r) for r in catalogues.load_prediction_rows(spark, str(tmp_path / name), 2).collect()} == want
    with pytest.raises(FileNotFoundError):
        catalogues.load_prediction_rows(spark, str(tmp_path / "none.json"))
    with sqlite3.connect(tmp_path / "x.db") as con:
        con.execute("CREATE TABLE other (a)")
    with pytest.raises(ValueError):
        catalogues.load_prediction_rows(spark, str(tmp_path / "x.db"))


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 30)
    monkeypatch.setattr(retrieve, "CORPUS_BLOCK", 40)
    monkeypatch.setattr(retrieve, "STEP", 7)
    x = np.random.default_rng(1).integers(-3, 4, (100, 5)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 5), (200, None)], "id long, v array<double>")
    got = {}
    for r in retrieve.top_k(df, df, 6, "id", "v", "id", "v", skip_self=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["sim"]))
    sims = x @ x.T
    for i in range(100):
        best = sorted((j for j in range(100) if j != i), key=lambda j: (-sims[i, j], j))[:6]
        assert sorted(got[i]) == [(n + 1, j, sims[i, j]) for n, j in enumerate(best)]


def test_pipeline(spark, folder):
    pipe = mapping.Pipeline(catalogues.load_corpus(spark, folder), mapping.Config(top_k=3))
    rows = spark.createDataFrame([("q1", "Alcohol dehydrogenase (EC 1.1.1.1)"), ("q2", "citrate synthase"), ("q3", ""), ("q4", None), ("q5", "α-thing " * 300)], "id string, description string")
    got = pipe.map_descriptions(rows).collect()
    best = {r["query_id"]: r for r in got if r["rank"] == 1}
    assert set(best) == {"q1", "q2", "q3", "q4", "q5"} and all(len([r for r in got if r["query_id"] == q]) == 3 for q in best)
    assert (best["q1"]["reaction_id"], best["q1"]["ec_match_level"], best["q1"]["source_name"]) == ("rxn1", 2, "Alcohol dehydrogenase (EC 1.1.1.1)")
    assert best["q2"]["reaction_id"] == "rxn2" and best["q2"]["confidence_band"] in ("high", "medium", "low")
    assert all(r["confidence_band"] is None for r in got if r["rank"] > 1)
    assert mapping.top1(pipe.map_one("glucose transport")).first()["reaction_id"] == "rxn4"
    with pytest.raises(ValueError):
        pipe.map_one(" ")
    ids = spark.createDataFrame([("S:1",), ("S:9",)], "id string")
    none = F.array().cast("array<string>")
    d = spark.createDataFrame([("1", "citrate synthase")], "id string, name string").select("id", F.struct("name", F.lit("").alias("def"), none.alias("synonym"), none.alias("xref")).alias("entry"))
    assert {r["query_id"]: r["reaction_id"] for r in mapping.top1(pipe.map_batch(ids, d)).collect()}["S:1"] == "rxn2"
    with pytest.raises(ValueError):
        mapping.Config("other")


def test_augmented_candidates(spark):
    """Against all pairs: one code a part of the other, known ones left out, the first in order kept."""
    rng = random.Random(2)
    code = lambda n: ".".join(str(rng.randrange(1, 13)) for _ in range(n))
    qs = {i: [code(3), code(4)] for i in range(12)} | {50: []}
    ts = {i: [code(4), ""] if i % 3 else [qs[i % 12][0] + "." + str(i), " " + code(3)] for i in range(200)}
    known = [(q, t) for q in qs for t in ts if (q * 7 + t) % 13 == 0]
    q = spark.createDataFrame(list(qs.items()), "query_no long, ecs array<string>")
    t = spark.createDataFrame(list(ts.items()), "item_no long, ecs array<string>")
    got = {tuple(r) for r in mapping.code_candidates(q, t, spark.createDataFrame(known, "query_no long, item_no long"), 5).collect()}
    want = set()
    for a, qe in qs.items():
        hit = [b for b, te in ts.items() if (a, b) not in known and any(x in y.strip() or y.strip() in x for x in qe for y in te if y.strip())]
        want |= {(a, b) for b in sorted(hit)[:5]}
    assert got == want and len(want) > 20


def test_model_mapping(spark, folder, tmp_path):
    model = {"metabolites": [{"id": "m1", "name": "ethanol", "compartment": "c"}, {"id": "m2", "name": "acetaldehyde"}, {"id": "m3", "name": "CITRATE"}, {"id": "m4", "name": None}], "reactions": [{"id": "r1", "name": "ADH", "metabolites": {"m1": -1, "m2": 1}}, {"id": "r2", "name": "unknown", "metabolites": {}}]}
    (tmp_path / "m.json").write_text(json.dumps(model))
    m = catalogues.load_model(spark, str(tmp_path / "m.json"))
    compounds, reactions = catalogues.load_model_catalogue(spark, folder)
    out = modelmap.map_model(m, compounds, reactions, top_k=3)
    c = {(r["query_id"], r["rank"]): r for r in out["compounds"].collect()}
    assert [c[q, 1]["item_id"] for q in ("m1", "m2", "m3")] == ["cpd1", "cpd2", "cpd3"] and c["m1", 1]["exact"] == 1
    assert c["m1", 1]["net"] == 1.0 and c["m3", 1]["net"] == 0.0 and "cpd6" not in {r["item_id"] for r in c.values()}
    r = {x["query_id"]: x for x in out["reactions"].collect() if x["rank"] == 1}
    assert r["r1"]["item_id"] == "rxn1" and (r["r1"]["set_jac"], r["r1"]["exact_set"]) == (1.0, 1)
    t = modelmap.model_tables(m, out, compounds, reactions, {"version": "x"})
    counts = writers.write_sqlite(t, str(tmp_path / "o.db"), keys=modelmap.MODEL_KEYS)
    assert counts["compound_queries"] == 4 and counts["reaction_queries"] == 2
    assert writers.write_sqlite(t, str(tmp_path / "o.db"), keys=modelmap.MODEL_KEYS) == counts
    with sqlite3.connect(tmp_path / "o.db") as con:
        assert con.execute("SELECT count(*) FROM compound_predictions").fetchone()[0] == counts["compound_predictions"]
    assert "Kind: model" in writers.sqlite_readme(str(tmp_path / "o.db"))
    assert {x["cpd_name"] for x in modelmap.top_n(t, "compound").where("local_id = 'm1' AND rank = 1").collect()} == {"Ethanol"}
    assert modelmap.top_n(t, "reaction").count() == counts["reaction_predictions"]


def results(spark):
    rows = [("S:1", "sso", "one", 1, "rxn1", 0.91234567, "n1", ["1.1.1.1"], 2.0), ("S:1", "sso", "one", 2, "rxn2", 0.5, None, [], 2.0), ("K/2", "ko", "two", 1, "rxn1", 0.7, "n1", ["1.1.1.1"], 1.0)]
    return spark.createDataFrame(rows, "query_id string, direction string, source_name string, rank int, reaction_id string, fused_score double, reaction_name string, ec_list array<string>, latency_ms double")


def test_result_files(spark, tmp_path):
    df = results(spark)
    writers.write_results(df, str(tmp_path / "o.sssom.tsv"))
    lines = (tmp_path / "o.sssom.tsv").read_text().splitlines()
    head = next(i for i, x in enumerate(lines) if not x.startswith("#"))
    assert lines[0] == "# curie_map:" and lines[head].split("\t")[0] == "subject_id" and len(lines) == head + 4
    assert lines[head + 2].split("\t") == ["S:1", "one", "skos:exactMatch", "rxn1", "n1", "semapv:LexicalMatching", "0.9123", "1"]
    writers.write_results(df, str(tmp_path / "out"))
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["n_queries"] == 2 and manifest["directions"]["ko"]["files"] == [{"query_id": "K/2", "file": "ko/K_2.json", "n_predictions": 1}]
    said = json.loads((tmp_path / "out" / "sso" / "S_1.json").read_text())
    assert said["predictions"][0]["fused_score"] == 0.912346 and said["predictions"][1]["reaction"]["ec_list"] == [] and said["query"]["source_def"] is None and said["pipeline"]["top_k_returned"] == 2
    writers.write_results(df, str(tmp_path / "o.tsv"))
    flat = {(r["query_id"], r["rank"]): r for r in spark.read.csv(str(tmp_path / "o.tsv"), sep="\t", header=True).collect()}
    assert flat["S:1", "1"]["fused_score"] == "0.912346" and flat["S:1", "1"]["latency_ms"] == "2.000"
    writers.write_results(df, str(tmp_path / "o.db"))
    writers.write_results(df.where("rank = 1").withColumn("fused_score", F.lit(0.1)), str(tmp_path / "o.db"))
    with sqlite3.connect(tmp_path / "o.db") as con:
        assert con.execute("SELECT query_id, rank, fused_score FROM top_predictions ORDER BY 1, 2").fetchall() == [("K/2", 1, 0.1), ("S:1", 1, 0.1), ("S:1", 2, 0.5)]
    assert "Kind: core" in writers.sqlite_readme(str(tmp_path / "o.db")) and "Not readable" in writers.sqlite_readme(str(tmp_path / "no.db"))


def test_artifacts_and_encoder(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<double>")
    catalogues.save_artifact(v, str(tmp_path / "v"))
    assert catalogues.load_artifact(spark, str(tmp_path / "v")).first()["vector"] == [1.0, 2.0]
    v.select(F.col("id").alias("ids"), F.lit("1.1;2").alias("ecs_raw")).write.parquet(str(tmp_path / "c"))
    assert catalogues.load_base_cache(spark, str(tmp_path / "c")).first()["ecs"] == ["1.1", "2"]
    e = encode.encode(spark.createDataFrame([(1, "abc"), (2, None)], "i int, t string"), {"t": "v"}, "hashed").collect()
    assert all(abs(np.linalg.norm(r["v"]) - 1) < 1e-9 for r in e) and len(e[0]["v"]) == encode.WIDTH
    assert one(spark, encode.l2_normalized(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    with pytest.raises(ValueError):
        encode.plug_in("nothing")
    s = encode.score_pairs(spark.createDataFrame([("a b", "b c", [1]), (None, "x", None)], "a string, b string, keep array<int>"), "a", "b", "overlap").collect()
    assert [round(r["pair_score"], 3) for r in s] == [0.333, 0.0] and s[1]["keep"] is None


def test_texts_and_anchors(spark):
    assert one(spark, texts.orthology_id(F.lit("K00123"))) == "K00123" and one(spark, texts.orthology_id(F.lit("K0123"))) == "K00123" and one(spark, texts.orthology_id(F.lit("77"))) == "K00077"
    assert one(spark, texts.tags(F.lit(" a; ;b"))) == ["a", "b"]
    m = one(spark, texts.label_metadata(F.lit("Kinase (EC 2.7.1.1)")))
    assert (m["name"], m["ecs"]) == ("Kinase", ["2.7.1.1"]) and one(spark, texts.label_metadata(F.lit(None).cast("string")))["name"] == ""
    assert "id: x" in one(spark, texts.audit_prompt(*(F.lit("x") for _ in range(10))))
    f = spark.createDataFrame([("g1", ["K9", "K1"], ["1.1"]), ("g2", [], ["1.1"]), ("g3", None, None), ("g4", ["K9"], [])], "id string, kos array<string>, ecs array<string>")
    ko = spark.createDataFrame([("K1", "rxn1"), ("K1", "rxn2")], "key string, target_id string")
    ec = spark.createDataFrame([("1.1", "rxn7")], "key string, target_id string")
    near = spark.createDataFrame([("g3", "rxn8", 0.4), ("g1", "rxn8", 0.9)], "id string, target_id string, score double")
    got = {r["id"]: (r["target_ids"], r["method"], r["confidence"]) for r in anchor_first(f, [("ko", "kos", ko), ("ec", "ecs", ec)], near).collect()}
    assert got == {"g1": (["rxn1", "rxn2"], "ko", 1.0), "g2": (["rxn7"], "ec", 0.85), "g3": (["rxn8"], "embedding", 0.4), "g4": ([], "none", 0.0)}


def test_tiers(spark):
    pool = spark.createDataFrame([(f"q{i}",) for i in range(30)], "query_id string")
    got = evaluate.run_tiers(lambda ids: ids, pool, (5, 20, 100))
    assert [r["N"] for r in got] == [5, 20] and got[0]["pool_size"] == 30


def test_verbs(spark, folder, tmp_path, capsys):
    (tmp_path / "in.csv").write_text("id,description\nq1,alcohol dehydrogenase (EC 1.1.1.1)\nq2,citrate synthase\n")
    base = ["--catalogue", folder]
    assert cli.main(["map", str(tmp_path / "in.csv"), str(tmp_path / "o.parquet"), "--id-column", "id", "--augment", *base], spark) == 0
    assert {r["query_id"]: r["reaction_id"] for r in spark.read.parquet(str(tmp_path / "o.parquet")).where("rank = 1").collect()} == {"q1": "rxn1", "q2": "rxn2"}
    assert cli.main(["cluster", str(tmp_path / "o.parquet"), str(tmp_path / "c.db")], spark) == 0
    with sqlite3.connect(tmp_path / "c.db") as con:
        assert con.execute("SELECT sum(size) FROM cluster_overview").fetchone() == (2,)
    (tmp_path / "m.json").write_text(json.dumps({"metabolites": [{"id": "m1", "name": "ethanol"}], "reactions": [{"id": "r1", "name": "ADH", "metabolites": {"m1": 1}}]}))
    assert cli.main(["map-model", str(tmp_path / "m.json"), str(tmp_path / "m.db"), *base], spark) == 0
    capsys.readouterr()
    assert cli.main(["describe", "citrate synthase", "--ec", "2.3.3.1", *base], spark) == 0 and "rxn2" in capsys.readouterr().out
    assert cli.main(["bench", str(tmp_path / "in.csv"), "--tiers", "2", *base], spark) == 0 and '"N": 2' in capsys.readouterr().out
    assert cli.main(["info"], spark) == 0 and "pyspark" in capsys.readouterr().out
    assert cli.main(["map", str(tmp_path / "in.csv"), str(tmp_path / "x.json"), "--catalogue", str(tmp_path)], spark) == 2
    assert readers.pick_column(["A", "b"], readers.ID_COLUMNS, None, "A") == "A"
