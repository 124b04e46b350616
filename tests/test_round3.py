"""Cases of the third round of findings."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.operators import mapping, modelmap, retrieve
from tessera.sources import writers


def test_rich_json_writes_numbers_as_its_sql_does(spark):
    scores = [0.000001, 0.00001, 0.000041, 0.00079, 0.0, 1.0, 0.5, 0.001, -0.00012, 9999999.5, 1e7, 12345678.123456, 1.25e14, None]
    rows = [(i // 5, i % 5 + 1, 100 + i, s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "query_id long, rank int, item_id long, score double")
    got = {r["query_id"]: r["json"] for r in writers.rich_json(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (query_id BIGINT, rank INT, item_id BIGINT, score DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [r for r in rows if r[3] is not None])
    want = dict(con.execute("SELECT query_id, CAST(to_json({'query_id': query_id, 'predictions': list({'rank': rank, 'item_id': item_id, 'score': score} ORDER BY rank)}) AS VARCHAR) FROM t GROUP BY query_id").fetchall())
    want[2] = want[2][:-2] + ',{"rank":4,"item_id":113}]}'  # a null score is left out, as it was
    assert got == want
    text = df.select(F.lit(None).cast("string").alias("query_id"), "rank", F.lit('a"}').alias("item_id"), F.lit(0.0001).alias("score")).limit(1)
    assert writers.rich_json(text).first()["json"] == '{"predictions":[{"rank":1,"item_id":"a\\"}","score":0.0001}]}'


def test_top_k_multiplies_few_rows_in_double_precision(monkeypatch):
    """Single precision picks, double precision ranks: equal to sorting all, also where values are close or equal."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(900, 24))
    rows[300:600] = rows[:300]  # equal rows: ties to the smaller id
    rows[600:] = rows[:300] * (1 + 1e-9)  # told apart in double precision alone
    ids, own = np.arange(0, 900, 7), np.arange(900)
    seen = []
    exact = retrieve._products
    monkeypatch.setattr(retrieve, "_products", lambda a, b, r, c: seen.append(len(r)) or exact(a, b, r, c))
    monkeypatch.setattr(retrieve, "STEP", 200)
    got = retrieve._best(ids, rows[ids], own, rows, 5, True)
    full = np.stack([exact(rows[i][None], rows, np.zeros(900, int), own) for i in ids])
    full[np.arange(len(ids)), ids] = -np.inf
    best = np.lexsort((np.broadcast_to(own, full.shape), -full), axis=1)[:, :5]
    assert list(got.itertuples(index=False, name=None)) == [(i, j, full[n, j]) for n, i in enumerate(ids) for j in best[n]]
    assert sum(seen) < 0.1 * full.size
    odd = rows.copy()
    odd[3, 0], odd[4, 1] = np.nan, np.inf
    left = retrieve._best(ids, rows[ids], own, odd, 5, True)
    assert len(left) >= 4 * len(ids) and not left["item_id"].isin([3, 4]).any()


def test_candidates_of_kinds_are_those_of_all_pairs(spark):
    """What a query knows by its kind, against the same listed pair by pair."""
    codes = ["1.2.3", "1.2.3.4", "2.3.4", "1.2"]
    q = spark.createDataFrame([(i, [codes[i % 3]], i % 3) for i in range(12)], "query_no long, ecs array<string>, kind int")
    t = spark.createDataFrame([(i, [codes[i % 4], codes[i // 4 % 4]], i % 3) for i in range(90)], "item_no long, ecs array<string>, kind int")
    known = q.select("query_no", "kind").join(t.select("item_no", "kind"), "kind").select("query_no", "item_no")
    want = {tuple(r) for r in mapping.code_candidates(q.drop("kind"), t.drop("kind"), known, 5).collect()}
    assert {tuple(r) for r in mapping.code_candidates(q, t, None, 5).collect()} == want and len(want) == 60
    i = F.col("item_no")
    scored = t.select("kind", "item_no", (i % 7 / 7.0).alias("first"), (i % 11 / 11.0).alias("second"))
    extra = spark.createDataFrame([(n, 1000 + n, 0.0, n / 9.0, True) for n in range(12)], "query_no long, item_no long, first double, second double, extra boolean")
    bonus = F.when(i % 4 == 0, 0.15).otherwise(0.0)

    def ranked(cands):
        plain = q.select("query_no", "kind").join(cands, "kind").select("query_no", "item_no", "first", "second", F.lit(False).alias("extra"))
        return sorted((r["query_no"], r["rank"], r["item_no"], round(r["fused"], 12)) for r in mapping.fuse_candidates(plain.union(extra), 0.3, bonus).where("rank <= 6").collect())

    few = mapping.of_kinds(scored, 0.3, bonus, 6)
    assert ranked(few) == ranked(scored) and few.count() <= 3 * 10


def test_votes_of_neighbours_without_their_pairs(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(int(s), int(q)) for s, q in zip(rng.integers(0, 12, 70), rng.integers(0, 30, 70), strict=True)})
    first = {q: q % 5 for q in range(0, 30) if q % 6}
    members = spark.createDataFrame(rows, "set_id long, query_id long")
    got = modelmap.neighbour_votes(members, spark.createDataFrame(list(first.items()), "query_id long, other long")).collect()
    pairs = {(tuple(r)) for r in modelmap.co_members(members).collect()}
    assert sorted(map(tuple, got)) == sorted({(q, first[n]) for q, n in pairs if n in first})
    # a set of n queries is one row of its items for each of them, not n (n - 1) pairs
    hub = spark.range(2000).select(F.lit(1).alias("set_id"), F.col("id").alias("query_id"))
    assert modelmap.neighbour_votes(hub, hub.select("query_id", (F.col("query_id") % 3).alias("other"))).count() == 6000
