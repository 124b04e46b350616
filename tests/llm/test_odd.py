"""Every operator and pipeline stage on rows that are odd in any way: none crashes, each case has its defined result."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, katz, language, line_dedup, mixing, projections, simhash, toxicity, url_rules, warc
from tessera.llm.text import hash_mod

#: Names that operators use inside, or return.
CLASHES = ["doc", "key", "i", "id", "y", "n", "t", "w", "s", "h", "rep", "row", "gone", "lines", "n_lines", "n_deleted", "line", "at", "rank", "label", "v", "c", "m", "fp", "text_", "host", "path", "rule", "verdict", "lang_pred", "score", "predicted", "component_id", "record", "page", "payload", "token", "domain", "budget", "copies", "n_tokens", "held_out", "__text", "__gone", "__doc", "item", "o", "lead", "src", "dst"]


def words(rng, n, vocab=5000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in each column, blanks, ties, repeated rows and ids, one long word, a long text, clashing names."""
    rng = random.Random(1)
    long = "\n".join(words(rng, 60) for _ in range(200))
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, long, "en", "a"), (4, long, "en", "a"), (5, "one", "de", "b"), (None, "null id here", "en", "b"), (None, None, None, None),
        (6, long, "de", "b"), (7, "x" * 200_000, "en", "a"), (8, long + "\nmore", "en", "b"), (8, words(rng, 80), "de", "a"), (9, "é ß Ж 漢字 \u00a0 \x00", "de", "c"),
    ]
    rows += [(100 + i, words(rng, 20, 50), ("en", "de")[i % 2], "abc"[i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHES))


N = 43


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    got = out.collect()
    assert len(got) == N and all(r["n_lines"] == 7 and r["gone"] == 7 for r in got)
    assert [r["text"] for r in got if r["doc_id"] is None and r["text"]] == ["null id here"]
    assert sorted(len(r["text"]) > 1000 for r in got if r["doc_id"] in (4, 6)) == [False, False, True]


def test_simhash(docs):
    assert simhash.simhash_components(docs).count() == N
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert near[4] == near[6] == near[8] == 4 and not {1, 2, 3, 5, 7} & set(near)


def test_language(docs):
    model = language.fit(docs)
    assert model.languages == ["de", "en"]
    got = language.identify(docs, model, keep=["held_out"]).collect()
    assert len(got) == N and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert language.fit(docs.limit(0)).languages == [] and language.fit(docs.withColumn("lang", F.lit(None).cast("string"))).languages == []


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, "one"), (1, "one"), (2, None), (None, "null id here"), (3, ""), (4, "é ß")], "item_id long, text string").select("*", *(F.lit(7).alias(c) for c in CLASHES))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(5, 1), (9, 4)}
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_katz(docs):
    held = F.coalesce(hash_mod("doc_id", 7) == 2, F.lit(False))
    got = katz.evaluate(docs, katz.train(docs.where(~held))).collect()
    assert len(got) == N and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1} and all(r["score"] <= 0 for r in got)
    assert katz.evaluate(docs.limit(0), katz.train(docs)).count() == 0


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (6, None), (900, 1), (100, 0)], "doc_id long, toxic int").select("*", *(F.lit(7).alias(c) for c in CLASHES))
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, keep=["held_out"]).collect()
    assert len(got) == N and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_mixing(docs):
    got = mixing.mix(docs.drop("domain", "copies", "n_tokens", "budget").withColumn("budget", F.lit(7)), F.lit("d")).collect()
    assert len(got) == N and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix(docs.limit(0), F.lit("d")).count() == 0


def test_pages(spark):
    rows = [(1, "http://casino.com/x", "a" * 150), (1, "http://casino.com/x", "a" * 150), (None, None, None), (2, "", ""), (3, "x://", "é" * 100), (4, "http://a/" + "b" * 100_000, "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(7).alias(c) for c in CLASHES))
    got = url_rules.judge(pages, [url_rules.pattern_rule(p) for p in url_rules.PATTERNS]).collect()
    assert len(got) == 6 and sum(r["verdict"] == "block" for r in got) == 2
    got = warc.archive(pages).collect()
    assert len(got) == 6 and sorted(r["payload_bytes"] for r in got) == [0, 0, 150, 150, 200, 3_000_000] and sum(r["record_type"] == "revisit" for r in got) == 1


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, 0.0], None), (6, [1e300, 1e297], 1), (7, [1.0], 1), (8, [None, 1.0], 1), (9, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *(F.lit(7).alias(c) for c in CLASHES if c != "label"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in projections.near_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (2, 1, False), 7: (0, 7, True), 8: (0, 8, True), 9: (0, 9, True)}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, docs, name, stage):
    spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs.select(*corpus_pipeline.COLUMNS, *(F.col(c) for c in CLASHES if c not in corpus_pipeline.COLUMNS))
    out = stage(spark, rows, str(tmp_path))
    assert out.count() <= 2 * N and (name == "mixing" or out.columns == corpus_pipeline.COLUMNS)
    assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0
