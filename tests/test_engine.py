"""Reference behaviours of the library on small inputs."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import cluster, metrics, numbering
from tessera.operators.aggregate import aggregate_annotations
from tessera.operators.components import connected_components
from tessera.sources import readers, writers


def one(spark, expr, **cols):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def sets(spark, d):
    return spark.createDataFrame([(k, [str(x) for x in v]) for k, v in d.items()], "id string, items array<string>")


def clusters(spark, d, **kw):
    rows = cluster.cluster_sets(sets(spark, d), "id", "items", **kw).collect()
    out = {}
    for r in rows:
        out.setdefault(r["cluster_id"], set()).add(r["item"])
    assert sorted(r["item"] for r in rows) == sorted(d)
    return out, rows


def test_cluster_groups_and_ids(spark):
    got, _ = clusters(spark, {"a": [1, 2, 3], "b": [1, 2, 3], "c": [1, 2, 4], "z": [90, 91]})
    assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["z"]]
    got, _ = clusters(spark, {"a": [1, 2], "b": [1, 2]})
    assert list(got) == ["7df1cefb-be7c-53a7-a8ac-16f0ad007a39"]
    assert list(got)[0] == str(uuid.uuid5(uuid.UUID(scalar.CLUSTER_NAMESPACE), "a|b"))


def test_cluster_cap_topk_and_empty_sets(spark):
    got, rows = clusters(spark, {f"i{n:02d}": [1, 2, 3, 4] for n in range(12)})
    assert max(map(len, got.values())) <= 5 and {r["cohesion"] for r in rows} == {1.0}
    got, _ = clusters(spark, {"a": [1, 2, 9], "b": [1, 2, 8]}, topk=2, threshold=0.5)
    assert len(got) == 1
    got, _ = clusters(spark, {"a": [], "b": [], "c": [3]})
    assert len(got) == 3
    with pytest.raises(ValueError):
        cluster.cluster_sets(sets(spark, {"a": [1]}), "id", "items", cap=0)


def test_components_random(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(n, n + 1) for n in range(400, 440)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Aldehyde dehydrogenase (EC 1.2.1.3)", ["1.2.1.3"]),
        ("(EC 4.2.1.-)", ["4.2.1"]),
        ("1.2.1.3 dehydrogenase", ["1.2.1.3"]),
        ("Transpeptidase (EC 2.4.1.129) (EC 3.4.16.-)", ["2.4.1.129", "3.4.16"]),
        ("none", []),
        ("1.2.1.3 and 1.2.1.3", ["1.2.1.3"]),
    ],
)
def test_ec_extraction(spark, text, want):
    assert one(spark, scalar.extract_all(F.lit(text), scalar.EC_ANY)) == want


def test_scalars(spark):
    assert one(spark, scalar.extract_all(F.lit(None).cast("string"), scalar.EC_ANY)) == []
    assert one(spark, scalar.norm_key(F.lit("D-Glucose (+) 6/P"))) == "dglucose6p"
    assert one(spark, scalar.clean_name(F.lit("EC 1.2.1.3"))) == "EC 1.2.1.3"
    assert one(spark, scalar.clean_name(F.lit("Foo  bar (EC 1.2.1.3)"))) == "Foo bar"
    assert one(spark, scalar.shared_levels(F.lit("1.2.3.-"), F.lit("1.2.3.-"))) == 3
    assert one(spark, scalar.match_level(F.array(F.lit("1.10.3")), F.array(F.lit("1.10.3.10")))) == 1
    assert one(spark, scalar.compose(F.lit("x"), F.lit("EC 1.1.1.1"), F.array(F.lit("a"), F.lit("b")), F.lit(" n "))) == "x (EC 1.1.1.1) [a; b] (n)"
    empty = F.lit(None).cast("string")
    assert one(spark, scalar.compose(empty, empty, F.lit(None).cast("array<string>"), empty)) is None
    assert [one(spark, scalar.predicate(F.lit(s))) for s in (0.85, 0.65, 0.2)] == ["skos:exactMatch", "skos:closeMatch", "skos:relatedMatch"]


ANNOTATIONS = [
    ("Ac3H11_1", "RAST", "SSO:000023839", "AraC family transcriptional regulator", None),
    ("Ac3H11_1", "bakta", None, "AraC family transcriptional regulator", None),
    ("Ac3H11_1", "prokka", "", "HTH-type transcriptional activator RhaR", None),
    ("Ac3H11_2", "RAST", "SSO:000023839", "AraC family transcriptional regulator", ""),
    ("Ac3H11_3", "prokka", None, "hypothetical protein", None),
    ("Ac3H11_100", "glm4ec", "EC:4.2.1.17", "Enoyl-CoA hydratase (EC 4.2.1.17)", "MSRXN:rxn02167;MSRXN:rxn03245"),
]


def test_aggregate(spark):
    df = spark.createDataFrame(ANNOTATIONS, "gene string, source string, ontology_term string, description string, reactions string")
    rows = {r["description"]: r for r in aggregate_annotations(df).collect()}
    assert len(rows) == 3
    first = rows["AraC family transcriptional regulator"]
    assert (first["n_genes"], first["sources"], first["ontology_terms"]) == (2, ["RAST", "bakta"], ["SSO:000023839"])
    assert rows["Enoyl-CoA hydratase (EC 4.2.1.17)"]["existing_reactions"] == ["MSRXN:rxn02167", "MSRXN:rxn03245"]
    assert aggregate_annotations(df, per_gene=True).count() == 4
    assert aggregate_annotations(df, drop_trivial=False).count() == 4


def test_metrics(spark):
    preds = spark.createDataFrame([("q", f"r{i}", i) for i in range(1, 8)], "query_id string, item_id string, rank int")
    gold = spark.createDataFrame([("q", "r2"), ("q", "r4"), ("q", "zz"), ("other", "r1")], "query_id string, item_id string")
    m = {r["query_id"]: r for r in metrics.score_queries(preds, gold).collect()}
    assert (m["q"]["hits_1"], m["q"]["hits_5"], m["q"]["rr"], m["q"]["p1"]) == (0, 1, 0.5, 0) and abs(m["q"]["recall_5"] - 2 / 3) < 1e-12
    assert m["other"]["rr"] == 0
    b = {r["query_id"]: r["bpref"] for r in metrics.bpref(preds, gold).collect()}
    assert abs(b["q"] - (1 - 1 / 3 + 1 - 2 / 3) / 3) < 1e-12 and b["other"] == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# header comment\nSSO:1\n\nSSO:2\n")
    (tmp_path / "a.csv").write_text("sso_id,note\nSSO:1,a\nSSO:2,b\n")
    (tmp_path / "a.json").write_text(json.dumps(["K1", "K2"]))
    (tmp_path / "a.jsonl").write_text('{"ko_id":"K1"}\n{"ko_id":"K2"}\n')
    for f, want in (("a.txt", ["SSO:1", "SSO:2"]), ("a.csv", ["SSO:1", "SSO:2"]), ("a.json", ["K1", "K2"]), ("a.jsonl", ["K1", "K2"])):
        assert [r["id"] for r in readers.read_ids(spark, str(tmp_path / f)).collect()] == want
    (tmp_path / "d.csv").write_text("function,gene\nalpha,g1\nbeta,g2\n")
    assert [tuple(r) for r in readers.read_descriptions(spark, str(tmp_path / "d.csv")).collect()] == [("FREE:00000001", "alpha"), ("FREE:00000002", "beta")]
    assert [r["id"] for r in readers.read_descriptions(spark, str(tmp_path / "d.csv"), id_column="gene").collect()] == ["g1", "g2"]
    (tmp_path / "x.csv").write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="not found"):
        readers.read_descriptions(spark, str(tmp_path / "x.csv"), text_column="description")
    with pytest.raises(ValueError):
        readers.input_format("x.docx")
    names, refs = readers.parse_aliases(F.lit("Name:a;b|KEGG:C1;null|bad"))
    assert one(spark, names) == ["a", "b"] and one(spark, refs) == {"KEGG": ["C1"]}


def test_writers(spark, tmp_path):
    assert [writers.output_format(p) for p in ("x.sssom.tsv", "x.tsv", "x.db", "out")] == ["sssom", "tsv", "sqlite", "dir"]
    df = spark.createDataFrame([("a", 1, ["x"])], "id string, n int, tags array<string>")
    writers.write_results(df, str(tmp_path / "o.parquet"))
    assert spark.read.parquet(str(tmp_path / "o.parquet")).count() == 1
    assert writers.write_sqlite({"t": df}, str(tmp_path / "o.db")) == {"t": 1}
    assert "| id | string |" in writers.schema_readme({"t": df})


def test_predictions(spark):
    df = spark.createDataFrame([("a", 2, "rxn2"), ("a", 1, "rxn1"), ("b", 1, "rxn9"), ("b", 21, "no")], "query_id string, rank int, reaction_id string")
    assert {r[0]: r[1] for r in readers.load_predictions(df).collect()} == {"a": ["rxn1", "rxn2"], "b": ["rxn9"]}
    with pytest.raises(ValueError):
        readers.load_predictions(df.drop("rank"))


def test_number_rows(spark):
    rows = numbering.number_rows(spark.range(50).select((F.lit(49) - F.col("id")).alias("v")), ["v"]).collect()
    assert sorted((r["n"], r["v"]) for r in rows) == [(i + 1, i) for i in range(50)]
