"""Operators against plain versions of what they compute, and the pipeline on planted cases."""

import hashlib
import math
import random
import time
from functools import lru_cache
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language, mixing, projections, queries, simhash, toxicity

DOC = "doc_id long, text string"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


# ---- language


def all_cuts(word, pieces, p):
    @lru_cache(None)
    def rest(a):
        if a == len(word):
            return 1.0
        out = 0.0 if word[a] in pieces else language.FLOOR * rest(a + 1)
        return out + sum(p[pieces.index(word[a:b])] * rest(b) for b in range(a + 1, min(len(word), a + language.MAX_PIECE) + 1) if word[a:b] in pieces)

    return math.log(rest(0))


def test_all_segmentations(monkeypatch):
    rng = random.Random(1)
    pieces = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5))) for _ in range(120)} - {"c"})
    p = np.random.default_rng(0).random((3, len(pieces)))
    p /= p.sum(axis=1, keepdims=True)
    monkeypatch.setattr(language, "COMMON", 3)  # letters of both kinds of table
    m = language.PieceModel(["x", "y", "z"], pieces, p)
    ws = ["".join(rng.choice("abcdéf") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    for long in (256, 16):  # whole, and in parts of 16 letters
        monkeypatch.setattr(language, "LONG", long)
        got = m.words_logp(ws)
        for w, g in zip(ws, got, strict=True):
            assert all(abs(g[x] - all_cuts(w, pieces, p[x])) < 1e-9 for x in range(3))
    short, parts = np.zeros_like(p), np.zeros_like(p)
    monkeypatch.setattr(language, "LONG", 256)
    for w in ws:
        m.expected(w, 0, 1.0, short)
    monkeypatch.setattr(language, "LONG", 1)
    for w in ws:
        m.expected(w, 0, 1.0, parts)
    assert np.abs(short - parts).max() < 1e-9


def test_long_word_is_linear():
    m = language.PieceModel(["x", "y"], language.load_pieces(), np.full((2, len(language.load_pieces())), 1e-4))
    took = []
    for n in (100_000, 1_000_000):
        w = "".join(random.Random(2).choices("abcdefghijklmnop", k=n))
        began = time.time()
        assert all(math.isfinite(v) and v < 0 for v in m.word_logp(w))
        took.append(time.time() - began)
    assert took[1] < 30 * took[0] + 1


def test_fit_and_identify(spark):
    rng = random.Random(3)
    stems = {"en": ["the", "and", "with", "house", "water", "thing", "would"], "de": ["der", "und", "mit", "haus", "wasser", "nicht", "werden"], "fr": ["le", "avec", "maison", "eau", "chose", "dans", "pour"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) for _ in range(12)), lang) for i, lang in enumerate(rng.choices(list(stems), k=300))]
    df = spark.createDataFrame(rows, DOC + ", lang string")
    model = language.fit(df.where("doc_id < 200"), sample=20)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df.where("doc_id >= 200"), model).collect()}
    assert sum(got[i] != lang for i, _, lang in rows if i >= 200) <= 2


# ---- toxicity


def spelt(word):
    return [62, *(toxicity.symbol(c) for c in word), 63]


def features(word):
    """Every subsequence of three letters within SPAN, by plain enumeration, and the norm that the length gives."""
    out, norm = {}, 0.0
    s = spelt(word)
    for a, b, c in combinations(range(len(s)), 3):
        if c - a < toxicity.SPAN:
            v = toxicity.DECAY ** (c - a + 1)
            out[s[a], s[b], s[c]] = out.get((s[a], s[b], s[c]), 0.0) + v
            norm += v * v
    return out, math.sqrt(max(norm, 1e-12))


def test_kernel():
    rng = random.Random(4)
    ws = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 14))) for _ in range(40)] + ["idiot", "i", "idxiot", "b" * 40]
    marks = ws[:10] + ["idiot"]
    got = toxicity.kernel(ws, marks, step=7)
    for i, w in enumerate(ws):
        f, n = features(w)
        for j, m in enumerate(marks):
            g, k = features(m)
            assert abs(got[i, j] - sum(v * g.get(u, 0.0) for u, v in f.items()) / (n * k)) < 1e-5
    table = np.zeros(toxicity.SYMBOLS**3, np.float32)
    toxicity.fold("idiot", table, 1.0)
    assert np.allclose(toxicity.scores(ws, table), got[:, -1], atol=1e-5)


def test_svm():
    """The sums in steps give the machine of plain normal equations."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 6))
    y = np.where(x[:, 0] + 0.3 * rng.standard_normal(200) > 0.2, 1.0, -1.0)
    w, b = toxicity.train_svm(x, y, np.ones(200), c=2.0, step=17)
    at = y * (x @ w + b) < 1
    grad = w - 2.0 * (x[at] * (y[at] - x[at] @ w - b)[:, None]).sum(axis=0)
    assert np.abs(grad).max() < 1e-6 and (np.sign(x @ w + b) == y).mean() > 0.9


# ---- SimHash


def test_fingerprint():
    rng = random.Random(6)
    for text in [words(rng, n) for n in (1, 2, 3, 4, 50)] + ["A a\ta\n A a A", ""]:
        ws = text.lower().split()
        parts = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else ([" ".join(ws)] if ws else [])
        hs = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert simhash.fingerprint(text.encode(), 3) & (1 << 64) - 1 == want


def test_long_texts_in_parts(monkeypatch):
    ws = words(random.Random(11), 1000, 50).encode()
    whole, least = simhash.fingerprint(ws, 3), simhash._min_hashes(simhash.set_hashes(ws, 5), 9, 11)
    monkeypatch.setattr(simhash, "STEP", 64)
    parts = simhash.run_hashes(ws.split(), 3, 64)
    assert (parts == simhash.run_hashes(ws.split(), 3, 10**6)).all() and len(parts) == 998
    assert simhash.fingerprint(ws, 3) == whole and (simhash._min_hashes(simhash.set_hashes(ws, 5), 9, 11) == least).all()


def test_near_keys_are_needed(spark, monkeypatch):
    """Without its keys the search finds nothing, so what it finds it finds through them."""
    rng = random.Random(7)
    base = words(rng, 300, 9**6)
    df = spark.createDataFrame([(1, base), (2, base + " one more"), (3, words(rng, 300, 9**6))], DOC)
    assert {r["doc_id"] for r in simhash.near_duplicates(df).collect()} == {1, 2}
    none = lambda prints, mins: (np.zeros(0, np.int64), np.zeros(0, np.int64))
    monkeypatch.setattr(simhash, "_near_keys", lambda reps, make=none: reps.select(F.col("rep").alias("key"), "rep").where("false"))
    assert simhash.near_duplicates(df).count() == 0


# ---- vectors


def test_vector_recall(spark):
    """Pairs close to the threshold, where recall is least, in 64 dimensions."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.98, 0.985, (600, 1))
    x = np.vstack([base, c * base + np.sqrt(1 - c**2) * side])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links = {r["vec_id"]: r["n_links"] for r in projections.near_vectors(df).collect()}
    true = projections.cosines(x[:600], x[600:]) >= 0.98
    found = sum(links[i] > 0 for i in np.flatnonzero(true))
    assert found >= 0.995 * true.sum()


# ---- mixing


def water(capacity, weight, budget):
    """Shares by weight, refilled until nobody is over: the plain version."""
    given, open_ = dict.fromkeys(capacity, 0.0), set(capacity)
    left = budget
    while open_:
        whole = sum(weight[c] for c in open_)
        full = {c for c in open_ if capacity[c] <= left * weight[c] / whole * (1 + 1e-12)}
        if not full:
            for c in open_:
                given[c] = left * weight[c] / whole
            break
        for c in full:
            given[c] = capacity[c]
            left -= capacity[c]
        open_ -= full
    return given


def test_mix_whole(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(0, 90)), rng.choice(["en"] * 6 + ["de", "fr"]), f"s{min(rng.randrange(12), rng.randrange(12))}") for i in range(500)]
    df = spark.createDataFrame(rows, DOC + ", lang string, source string")
    for total, epochs in ((None, 2), (4000.0, 2), (60_000.0, 3)):
        got = {r["doc_id"]: r["copies"] for r in mixing.mix(df, F.concat(F.lit("d"), F.col("doc_id") % 2), total, epochs).collect()}
        n = {i: len(t.split()) for i, t, _, _ in rows}
        leaf = {i: (f"d{i % 2}", lang, src) for i, _, lang, src in rows}
        cap = {x: epochs * sum(n[i] for i in n if leaf[i] == x) for x in set(leaf.values())}

        def split(keys, budget, depth):
            kids = {k[: depth + 1] for k in keys}
            given = water({c: sum(v for k, v in cap.items() if k[: depth + 1] == c) for c in kids}, dict.fromkeys(kids, 1.0), budget)
            if depth == 2:
                return given
            return {k: v for c in kids for k, v in split([x for x in keys if x[: depth + 1] == c], given[c], depth + 1).items()}

        budget = split(list(cap), float(total or sum(n.values())), 0)
        want = {}
        for x, b in budget.items():
            own = [i for i in n if leaf[i] == x]
            size = sum(n[i] for i in own)
            whole = min(epochs, math.floor(b / size + 1e-9)) if size else 1
            upto = 0
            for i in sorted(own, key=lambda i: hashlib.md5(f"17|{whole}|{i}".encode()).hexdigest()):
                upto += n[i]
                want[i] = whole + int(whole < epochs and b - whole * size > 1e-6 and upto <= b - whole * size + 1e-6)
        assert got == want


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(10)
    vocab = ["".join(rng.choice(["th", "er", "on", "an", "in", "re", "ou", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(4000)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocab) + str(rng.randrange(40)) for _ in range(12)) for _ in range(n // 12))
    docs = {i: text(150) if i >= 10 else text(150).replace("\n", " ") for i in range(200)}  # near copies are of one line: runs of equal lines go before
    toxic = {}
    for i in range(300, 360):
        ws = text(120).split(" ")
        for _ in range(3):
            ws[rng.randrange(len(ws))] = rng.choice(["idiot", "moron", "pathetic", "scum"])
        toxic[i] = " ".join(ws)
    passage = text(72)
    repeated = {i: text(60) + "\n" + passage + "\n" + text(60) for i in range(400, 405)}
    item = text(24).replace("\n", " ")
    leaks = {500: text(120) + " " + item.upper() + " " + text(60)}
    near = {}
    for i in range(600, 610):
        ws = docs[i - 600].split(" ")
        ws[3] = "changed"
        near[i] = " ".join(ws)
    exact = {700 + i: docs[50 + i] for i in range(5)}
    every = docs | toxic | repeated | leaks | near | exact
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in every.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in every if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = queries.table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        left[name] = {r["doc_id"]: r for r in now.collect()}
    clean = set(docs) | set(repeated) | set(leaks)
    assert sum(i in left["toxicity"] for i in toxic) <= 3 and len(clean - set(left["toxicity"])) <= 2
    kept = [left["line_dedup"][i]["text"] for i in repeated if i in left["line_dedup"]]
    assert sum(passage in t for t in kept) == 1 and all(r["n_chars"] == len(r["text"]) for r in left["line_dedup"].values())
    after = set(left["simhash_near_dedup"])
    assert not after & (set(near) | set(exact)) and len(set(docs) & set(left["toxicity"]) - after) == 0
    assert set(left["simhash_near_dedup"]) - set(left["decontamination"]) == set(leaks)
    assert set(left["mixing"]) <= set(left["decontamination"]) and all(r["copies"] in (1, 2) for r in left["mixing"].values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(left["mixing"])
