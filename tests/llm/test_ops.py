"""Corpus operators against brute force and planted cases, and their behaviour on odd rows."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, line_dedup, mixing, projections, simhash, text, toxicity, url_rules, warc

DOC = "doc_id long, text string"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def odd(spark, schema=DOC + ", doc string, key int"):
    """Nulls, blanks, ties, repeated rows, long texts and columns with names used inside."""
    rng = random.Random(1)
    long = "\n".join(words(rng, 60, 5000) for _ in range(300))
    return spark.createDataFrame([(1, None, "x", 1), (2, "", None, 2), (3, " \n\t ", "x", None), (4, long, "x", 1), (4, long, "x", 1), (5, "one", "y", 2), (None, "null id here", "y", 2), (6, long, "z", 3)], schema)


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


# ---- line dedup


def brute_lines(docs, min_words):
    """All maximal repeated runs by comparing every pair of starts."""
    seqs = []
    for d, t in docs:
        lines = [(i, x) for i, x in enumerate((t or "").split("\n")) if x.split()]
        seqs += [(d, k, lines) for k in range(len(lines))]
    gone = set()
    for n, (d, k, a) in enumerate(seqs):
        best = 0
        for e, m, b in seqs[:n]:
            size = 0
            while k + size < len(a) and m + size < len(b) and a[k + size][1] == b[m + size][1]:
                size += 1
            best = max(best, size)
        if best and sum(len(x.split()) for _, x in a[k : k + best]) >= min_words:
            gone |= {(d, a[k + i][0]) for i in range(best)}
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = [words(rng, rng.randrange(1, 9)) for _ in range(12)]
    docs = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.8 else ("" if rng.random() < 0.3 else words(rng, 4, 9**6)) for _ in range(rng.randrange(1, 25)))) for d in range(40)]
    docs += [(40, docs[3][1]), (41, docs[3][1])]
    got = {tuple(r) for r in line_dedup.repeated_runs(spark.createDataFrame(docs, DOC), 12).collect()}
    assert got == brute_lines(docs, 12)


def test_line_dedup_odd(spark):
    rows = line_dedup.dedup_lines(odd(spark)).collect()
    assert len(rows) == 8 and sorted(len(r["text"]) > 9 for r in rows if r["doc_id"] in (4, 6)) == [False, False, True]
    assert [r["text"] for r in rows if r["doc_id"] in (1, 2, 3)].count(None) == 1
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0


def test_line_dedup_repeated_ids(spark):
    """Rows that share an id lose only lines that they themselves repeat."""
    rng = random.Random(4)
    run, own, other = ("\n".join(words(rng, 30, 9**6) for _ in range(3)) for _ in range(3))
    df = spark.createDataFrame([(1, run), (2, run + "\n" + own), (2, other), (2, other + "\n" + own)], DOC)
    got = Counter(r["text"] for r in line_dedup.dedup_lines(df).collect())
    assert got in (Counter([run, own, other, ""]), Counter([run, other + "\n" + own, "", ""]))


def test_line_dedup_clashing_names(spark):
    df = spark.createDataFrame([(1, "a\nb", 9, "x", 3, 4, 5)], "doc_id long, text string, n_lines int, gone string, row int, doc int, lines int")
    got = line_dedup.dedup_lines(df).collect()[0].asDict()
    assert got == {"doc_id": 1, "text": "a\nb", "n_lines": 9, "gone": "x", "row": 3, "doc": 4, "lines": 5, "n_lines_": 2, "n_deleted": 0}


# ---- SimHash


def test_simhash_components(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 60)
    fps = [int(b) for b in base]
    for b in base[:30]:  # crowds around some
        fps += [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 62, (5, 2))]
    fps += [int(base[0]) ^ (1 << i) for i in range(60)]
    fps = sorted(set(fps))
    want = brute_components(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    for crowd in (2, 1000):
        edges = simhash.link_within_two(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd).collect()
        assert all(bin(r["src"] ^ r["dst"]).count("1") <= 2 for r in edges)
        near = {(min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in edges}
        assert brute_components(fps, lambda a, b: (min(a, b), max(a, b)) in near) == want


def test_simhash_odd(spark):
    rows = simhash.simhash_components(odd(spark)).collect()
    assert len(rows) == 8
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 6)} == {4}
    assert simhash.simhash_components(spark.createDataFrame([], DOC)).count() == 0


def test_shingles():
    ws = b"a bb c d".split()
    assert text.shingles(ws, 3) == [b"a bb c", b"bb c d"]
    assert text.shingles(ws[:2], 3) == [b"a bb"] and text.shingles([], 3) == [] and text.shingles(ws[:3], 3) == [b"a bb c"]


def test_near_duplicates(spark):
    rng = random.Random(8)
    docs = [(i, words(rng, 200, 4000)) for i in range(30)]
    copies = []
    for i in range(20):
        ws = docs[i][1].split()
        for _ in range(3):
            ws[rng.randrange(len(ws))] = "edited"
        copies.append((100 + i, " ".join(ws)))
    copies += [(200 + i, docs[29][1]) for i in range(5)]
    for i in range(60):  # one large group
        ws = docs[28][1].split()
        ws[rng.randrange(len(ws))] = f"e{i}"
        copies.append((300 + i, " ".join(ws)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs + copies + [(900, None), (901, "")], DOC)).collect()}
    assert all(got.get(100 + i) == i for i in range(20)) and all(got[200 + i] == 29 for i in range(5))
    assert all(got[300 + i] == 28 for i in range(60))
    assert 25 not in got and 900 not in got
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def brute_near(docs):
    """Component of each id by comparing all pairs of shingle sets."""
    sets = {i: set(text.shingles(text.words(t.encode()), 5)) for i, t in docs}
    return brute_components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)


def near_wanted(spark, docs):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, DOC)).collect()}
    want = brute_near(docs)
    assert {i: got.get(i, i) for i in want} == want
    return want


def test_near_crowd_of_unlike_texts(spark):
    """Texts around a common passage crowd its keys; most pairs are not similar, and pairs without the leader are linked."""
    rng = random.Random(11)
    common = words(rng, 160, 10**6)
    docs = []
    for i in range(60):
        docs.append((i, common + " " + words(rng, 24, 10**6)))
    for i in range(20):
        docs.append((100 + i, docs[20 + i][1] + " " + words(rng, 8 + i, 10**6)))
    want = near_wanted(spark, docs)
    assert 10 < len(set(want.values())) < 75


def test_near_appended_and_cut_copies(spark):
    """Every pair at 0.8 or more is found, close to it as well."""
    rng = random.Random(12)
    docs = []
    for i in range(120):
        n = rng.randrange(100, 900)
        docs.append((i, words(rng, n, 10**5)))
        more = int(n * rng.uniform(0.02, 0.27))
        docs.append((1000 + i, docs[-1][1] + " " + words(rng, more, 10**5) if i % 2 else docs[-1][1].rsplit(" ", int(more * 0.8))[0]))
    want = near_wanted(spark, docs)
    assert 80 < sum(want[1000 + i] == i for i in range(120)) < 120


# ---- URL rules


def test_url_rules(spark):
    rules = [url_rules.host_path_rule(t, v) for t, v in [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block")]] + [url_rules.pattern_rule(p) for p in url_rules.PATTERNS]
    cases = {
        "http://a.EXAMPLE.com/en/75?x": ("a.example.com", "/en/75", "example.com/en/7", "allow"),
        "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "http://badexample.com/en/7": ("badexample.com", "/en/7", "com/en/", "block"),
        "https://x.net/de": ("x.net", "/de", None, "allow"),
        "https://casino.org/q": ("casino.org", "/q", None, "block"),
        "https://x.net?/de/": ("x.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a://b://c/d#e": ("b:", "//c/d", None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*cases, None, "https://casino.org/q"])], "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(df, rules).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert got[len(cases)] == ("", "", None, "allow") and got[len(cases) + 1][3] == "block" and len(got) == len(cases) + 2
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_url_literals():
    assert url_rules.literal_tokens(r"(^|[./_-])casino([./_-]|$)") == ["casino"]
    assert url_rules.literal_tokens(r"bet365") == ["*bet", "*et3", "*t36", "*365"]
    assert url_rules.literal_tokens(r"/(wp-)?login\.php") == ["login", *url_rules.grams("php")] or url_rules.literal_tokens(r"/(wp-)?login\.php") == ["*log", "*ogi", "*gin", "*php"]
    assert url_rules.literal_tokens(r"a|b") == [] and url_rules.literal_tokens(r"(?i)casino") == [] and url_rules.literal_tokens("(") == []
    assert url_rules.literal_tokens(r"/(ad){2,}x+/") == []


def test_url_patterns_by_token(spark):
    """Any pattern is found through its tokens; an index without them finds nothing."""
    patterns = [r"bet365", r"/(wp-)?login\.php", r"(^|[./_-])casino([./_-]|$)", r"[0-9]{6}", r"pill(s|z)?store", r"x+y+z"]
    urls = [f"http://{h}.com/{p}" for h in ("mybet365x", "bet365", "shop", "casino", "casinos") for p in ("wp-login.php", "login.php", "login", "q/123456", "pillzstore1", "axxyyzb", "pilstore")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_rules.pattern_rule(p) for p in patterns]
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(df, rules).collect()}
    want = {i: "block" if any(re.search(p, u.split("://")[1]) for p in patterns) else "allow" for i, u in enumerate(urls)}
    assert got == want and len(set(want.values())) == 2
    lost = [url_rules.Rule(r.rule, r.verdict, r.pattern, ("nosuchtoken",), False) for r in rules]
    assert url_rules.judge(df, lost).where("verdict = 'block'").count() == 0


# ---- language


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba"]
    p = np.array([[0.4, 0.3, 0.2, 0.1]])
    m = language.PieceModel(["x"], pieces, p)
    want = 0.4 * 0.2 * 0.4 + 0.3 * 0.4 + 0.4 * 0.1  # a|b|a, ab|a, a|ba
    assert abs(m.word_logp("aba")[0] - math.log(want)) < 1e-12
    n = np.zeros((1, 4))
    m.expected("aba", 0, 1.0, n)
    assert abs(n[0, 0] - (2 * 0.032 + 0.12 + 0.04) / want) < 1e-12
    assert math.isfinite(m.word_logp("ab" * 3000)[0]) and math.isfinite(m.word_logp("é")[0])


def test_language(spark):
    smp = {"en": Counter("the quick brown fox and the dog were running with them".split()), "de": Counter("der schnelle braune fuchs und das hund waren nicht mit ihnen".split())}
    model = language.train(smp, language.load_pieces())
    df = spark.createDataFrame([(1, "The dog and the fox"), (2, "Der Hund und das nicht"), (3, None), (4, "12 !"), (5, ""), (1, "The dog and the fox")], DOC)
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(df, model).collect())
    assert got == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert language.identify(spark.createDataFrame([], DOC), model).count() == 0
    assert language.identify(df, language.train({}, ["a"])).where("lang_pred <> 'und'").count() == 0


# ---- decontamination


def brute_contained(docs, items, k=5, t=0.8):
    def sh(s):
        ws = text.words((s or "").encode())
        return ws

    out = set()
    for i, b in items:
        ws = sh(b)
        own = set(text.shingles(ws, k))
        for d, x in docs:
            if own and d is not None:
                n = min(k, len(ws))
                have = {b" ".join(sh(x)[j : j + n]) for j in range(len(sh(x)) - n + 1)}
                if len(own & have) >= t * len(own) - 1e-12:
                    out.add((d, i, len(own & have)))
    return out


def test_decontaminate(spark):
    rng = random.Random(5)
    items = [(i, words(rng, rng.randrange(6, 40), 3000)) for i in range(40)] + [(50, "tiny one"), (51, ""), (52, None)]
    docs = [(d, words(rng, 300, 3000)) for d in range(30)]
    for i in range(20):
        ws = items[i][1].split()
        if i % 2 and len(ws) > 12:
            ws[len(ws) // 2] = "changed"
        docs.append((100 + i, words(rng, 100) + " " + " ".join(ws).upper() + "\t" + words(rng, 50)))
    docs += [(200, " ".join(x for _, x in items if x)), (201, None), (202, "a tiny one b"), (None, items[0][1])]
    got = {tuple(r)[:3] for r in decontaminate.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_contained(docs, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(odd(spark), none).count() == 0


# ---- WARC


def test_warc(spark):
    big = "é" * 5000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "x" * 50), (4, "u\r\nX: y", "x" * 50), (5, "u", None), (6, "u", ""), (-7, "u", "line\r\n\r\nWARC/1.1\r\n" * 20)]
    more = [(None, "u", "lost"), (2, "http://b", big), (2, "http://c", "z" * 300), (2, "http://c", "y" * 300), (None, "u", big)]
    schema = "page_id long, url string, html string"
    for extra in ([], more):
        df = spark.createDataFrame(rows + extra, schema)
        got = warc.archive(df, chunk=64).collect()
        want = Counter((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows + extra)
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
        types = {(i, r["record_type"], r["refers_to"]) for i in (1, 2, 3, 4) for r in got if r["page_id"] == i and r["payload_bytes"] != 300}
        assert types == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None)}
    assert sum(r["record_type"] == "revisit" for r in got) == 3  # of big: 2, 2 and null
    assert warc.archive(spark.createDataFrame([], schema)).count() == 0


def test_warc_files_are_standard(spark):
    df = spark.createDataFrame([(1, "http://a", "payload " * 40)], "page_id long, url string, html string")
    chunks = warc.chunk_table(df, "page_id", "html", 32, ("url",))
    planned = warc.plan_records(warc.digests(chunks))
    manifest = warc.write_archives(chunks, planned, "url").collect()
    data = gzip.decompress(open(manifest[0]["path"], "rb").read())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"payload \r\n\r\n")


# ---- vectors


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 32))
    rows, n = [], 0
    for v in base:
        for _ in range(int(rng.integers(1, 4))):
            w = v + rng.standard_normal(32) * 0.12
            rows.append((n, [float(x) for x in w], int(n % 2)))
            n += 1
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, None, 0), (n + 2, [0.0] * 32, 0), (n + 3, [float("nan")] * 32, 0), (n + 4, rows[0][1], None), (n + 5, [1.0, None], 1), (n + 6, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in projections.near_vectors(df).collect()}
    good = {i: (v, y) for i, v, y in rows if v and y is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {(a, b) for a in good for b in good if a != b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and projections.cosine(good[a][0], good[b][0]) >= 0.98}
    degree = Counter(a for a, _ in links)
    want = brute_components([i for i, _, _ in rows], lambda a, b: (a, b) in links)
    wrong = sum(got[i]["n_links"] != degree[i] or got[i]["component_id"] != want[i] for i in got)
    assert len(got) == len(rows) and wrong <= 0.02 * len(rows) and len(links) > 50
    assert projections.near_vectors(spark.createDataFrame([], df.schema)).count() == 0


# ---- toxicity


def test_toxicity(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice(["th", "er", "on", "an", "in", "re", "ou", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    bad = ["idiot", "moron", "pathetic", "scum", "clown"]

    def doc(toxic):
        ws = [rng.choice(vocab) for _ in range(80)]
        if toxic:
            for _ in range(3):
                ws[rng.randrange(80)] = rng.choice(bad)
        return " ".join(ws) + "."

    rows = [(doc(y), y) for y in [1, 0, 0, 0] * 80]
    model = toxicity.learn(rows)
    tests = [(i, doc(i % 2)) for i in range(100)] + [(1001, "th er on i.d.i.o.t an in"), (1003, "th er on i d i o t an in on"), (1000, None), (1002, "")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(tests, DOC), model).collect()}
    assert sum(got[i] != i % 2 for i, _ in tests) <= 2
    assert toxicity.score(odd(spark), model).count() == 8
    assert toxicity.score(odd(spark), toxicity.learn([])).where("predicted = 1").count() == 0
    assert toxicity.score(spark.createDataFrame([], DOC), model).count() == 0


# ---- mixing


def test_fill(spark):
    rows = [("p", "a", 10.0, 1.0, 90.0), ("p", "b", 100.0, 1.0, 90.0), ("p", "c", 30.0, 2.0, 90.0), ("q", "a", 5.0, 1.0, 50.0)]
    df = spark.createDataFrame(rows, "parent string, child string, capacity double, weight double, budget double")
    got = {(r["parent"], r["child"]): r["given"] for r in mixing.fill(df, ["parent"], "child").collect()}
    assert got == {("p", "a"): 10.0, ("p", "b"): 50.0, ("p", "c"): 30.0, ("q", "a"): 5.0}


def test_mixing(spark):
    rng = random.Random(3)
    docs = [(i, words(rng, rng.randrange(1, 60)), rng.choice(["en", "en", "en", "de"]), f"s{min(rng.randrange(9), 3)}") for i in range(400)]
    docs += [(400, None, None, None), (401, "", "en", "s0")]
    df = spark.createDataFrame(docs, DOC + ", lang string, source string")
    rows = mixing.mix(df, F.lit("d"), max_epochs=2).collect()
    assert len(rows) == len(docs) and max(r["copies"] for r in rows) <= 2
    total = sum(r["n_tokens"] for r in rows)
    taken = sum(r["n_tokens"] * r["copies"] for r in rows)
    leaves = len({(r["lang"], r["source"]) for r in rows})
    assert total - 60 * leaves <= taken <= total
    by = Counter()
    for r in rows:
        by[r["lang"]] += r["n_tokens"] * r["copies"]
    assert by["de"] > 0.3 * total  # upsampled to its share or its capacity
    # each leaf: whole epochs and a prefix in md5 order
    for leaf in {(r["lang"], r["source"]) for r in rows}:
        own = [r for r in rows if (r["lang"], r["source"]) == leaf and r["n_tokens"]]
        if own:
            whole = min(r["copies"] for r in own)
            own.sort(key=lambda r: hashlib.md5(f"17|{whole}|{r['doc_id']}".encode()).hexdigest())
            extra = [r["copies"] - whole for r in own]
            assert extra == sorted(extra, reverse=True)
    assert mixing.mix(spark.createDataFrame([], df.schema), F.lit("d")).count() == 0
