"""Katz model against a plain dictionary version, and its probabilities sum to one."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import katz

TEXTS = ["a b a b c", "a b c d", "b c a b", "", None, "x y x y x y z", "a b\nC d\t a", "q " * 30, "a b a b c", "lone words here", "b c d e f g a b"]


def brute(train, texts):
    def toks(t):
        return (t or "").encode().lower().split()

    uni, big = Counter(), Counter()
    for t in train:
        ws = [b" start", *toks(t), b" end"]
        uni.update(ws[1:])
        big.update(zip(ws, ws[1:]))
    hist = Counter(uni)
    hist[b" start"] = len(train)
    n = sum(uni.values())
    cc = [Counter(uni.values()), Counter(big.values())]
    d1, d2 = katz.discounts(cc[0], 1), katz.discounts(cc[1], katz.MIN_BIGRAM)
    p = {w: d1.get(c, 1.0) * c / n for w, c in uni.items()}
    unk = 1 - sum(p.values())
    kept = defaultdict(dict)
    for (h, w), c in big.items():
        if c >= katz.MIN_BIGRAM:
            kept[h][w] = d2.get(c, 1.0) * c / hist[h]
    alpha = {}
    for h, row in kept.items():
        if 1 - sum(row.values()) <= 1e-12:
            for w in row:
                row[w] *= hist[h] / (hist[h] + 1)
        alpha[h] = (1 - sum(row.values())) / (1 - sum(p[w] for w in row))

    def prob(h, w):
        return kept[h][w] if w in kept.get(h, {}) else alpha.get(h, 1.0) * p.get(w, unk)

    for h in list(hist):
        assert abs(sum(prob(h, w) for w in uni) + prob(h, b"unseen") - 1) < 1e-9
    out = []
    for t in texts:
        ws = [b" start", *toks(t), b" end"]
        out.append((len(ws) - 1, sum(w in uni for w in ws[1:]), sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in ws[1:]), sum(math.log10(prob(h, w)) for h, w in zip(ws, ws[1:]))))
    return out


def check(spark, head):
    rows = [(i if i != 6 else None, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = TEXTS[:8]
    model = katz.train(spark.createDataFrame([(t,) for t in train], "text string"))
    got = sorted((tuple(r) for r in katz.evaluate(docs, model).collect()), key=str)
    want = sorted(((i, *b) for (i, _), b in zip(rows, brute(train, [t for _, t in rows]))), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3]
        assert abs(g[3] - w[3]) < 1e-9 and abs(g[4] - w[4]) < 1e-9


def test_matches_brute_force(spark):
    check(spark, True)


def test_without_head(spark, monkeypatch):
    monkeypatch.setattr(katz, "HEAD", 0)
    check(spark, False)


def test_nothing_to_learn_from(spark):
    model = katz.train(spark.createDataFrame([], "text string"))
    rows = katz.evaluate(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()
    assert [tuple(r) for r in rows] == [(1, 3, 0, 0.0, 0.0)]
    assert katz.evaluate(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_bigrams_seen_once_are_in_the_model(spark):
    model = katz.train(spark.createDataFrame([(t,) for t in TEXTS[:8]], "text string"))
    seen = Counter()
    for t in TEXTS[:8]:
        ws = [" start", *(t or "").lower().split(), " end"]
        seen.update(zip(ws, ws[1:]))
    assert Counter(r["c"] for r in model.big.select("c").collect()) == Counter(seen.values())


@pytest.mark.parametrize("head", [1, 4, 12])
def test_part_of_the_words_in_the_head(spark, monkeypatch, head):
    monkeypatch.setattr(katz, "HEAD", head)
    check(spark, True)


def test_only_rows_of_rare_keys_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(katz, "HEAD", 3)
    rows = spark.range(100).select((F.col("id") % 5).alias("w"), "id")
    table = spark.createDataFrame([(w, w / 2, 10 - w) for w in range(4)], "w long, p double, often long")
    got = katz._meet(rows, table, "w")
    assert sorted(tuple(r) for r in got.select("id", "w", "p").collect()) == [(i, i % 5, i % 5 / 2) for i in range(100) if i % 5 < 4]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and plan.count("strategy=shuffle_hash") == 1


def test_tables_go_to_their_buckets_in_large_pieces(spark):
    n, buckets = 200_000, 64
    values = spark.range(0, n, 1, 1).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(1)).alias("w"), F.log10(F.col("id") + 2).alias("value"), F.lit(1).cast("long").alias("c"), F.lit(True).alias("big"))
    got = katz._table_pieces(values, 2, buckets, list(range(buckets))).select(F.length("payload").alias("b")).collect()
    assert len(got) == buckets and sum(r["b"] for r in got) < 15 * n


def test_documents_are_scored_a_part_at_a_time(spark, monkeypatch):
    written = []
    real = katz.materialize
    monkeypatch.setattr(katz, "materialize", lambda df, name, *a: written.append((name, real(df, name, *a))) or written[-1][1])
    rows = [(i, f"w{i % 7} w{i % 5} w{i}") for i in range(40)] + [(None, "w1 w2"), (None, "w1 w2"), (3, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = katz.evaluate(docs, katz.train(docs)).select("doc_id").collect()
    first = [df.count() for name, df in written if name == "scores"]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert len(first) == katz.SCORED_IN - 1 and 0 < sum(first) < len(rows)
