"""Toxicity by a subsequence string kernel, Nystrom landmarks and a linear support vector machine.

Two words are alike as far as they share letter subsequences of length three, each weighted by DECAY to the power of the
span it covers in both words, spans of SPAN letters at most: gaps and inserted characters lower the weight, no more. The
kernel is divided by what the words' lengths alone would give. Words are mapped to their kernel values against landmark
words, whitened by the landmarks' own kernel matrix, and a squared-hinge machine is trained on words of labelled
sentences. As every kernel value is a sum over subsequences, the trained machine is folded into one table with a weight
for each letter triple, so a word is scored by table look-ups. A text scores by its most toxic word.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import give_back, map_batches, raw_texts

DECAY, SPAN, SYMBOLS = 0.6, 7, 64
OFFSETS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
WEIGHTS = np.array([DECAY ** (k + 1) for _, k in OFFSETS], np.float32)
CACHE = 200_000
SENTENCE = re.compile(r"[.!?\n]+")


def symbol(c: str) -> int:
    """Letters a-z are 1 to 26, all others share 27 to 61 by code point; 62 and 63 are a word's ends, 0 is past them."""
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else 27 + o % 35


def clean_words(text: bytes) -> list[str]:
    """Lower-cased words without what is no letter; three or more single letters in a row are one word as well."""
    out: list[str] = []
    alone: list[str] = []
    for t in text.split():
        w = clean_word(t)
        if len(w) == 1:
            alone.append(w)
            continue
        if len(alone) > 2:
            out.append("".join(alone))
        alone = []
        out.append(w)
    if len(alone) > 2:
        out.append("".join(alone))
    return out


def clean_word(token: bytes) -> str:
    w = token.decode("utf-8", "replace").lower()
    return w if w.isalpha() else "".join(c for c in w if c.isalpha())


_SYMBOL = {c: symbol(c) for c in map(chr, range(97, 256))}


def encode(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, zero-padded by SPAN, and the length norm of each word."""
    longest = max(map(len, ws), default=0) + 2
    codes = np.zeros((len(ws), longest + SPAN), np.int64)
    codes[:, 0] = 62
    for i, w in enumerate(ws):
        codes[i, 1 : len(w) + 1] = [_SYMBOL.get(c) or symbol(c) for c in w]
        codes[i, len(w) + 1] = 63
    n = np.array([len(w) + 2 for w in ws], np.float64)
    norm = np.zeros(len(ws))
    for (_, k), wt in zip(OFFSETS, WEIGHTS, strict=True):
        norm += np.maximum(0, n - k) * float(wt) ** 2
    return codes, np.sqrt(np.maximum(norm, 1e-12))


def fold(word: str, into: np.ndarray, factor: float) -> None:
    """Add the word's weighted, normed subsequences to a table over letter triples."""
    codes, norm = encode([word])
    c, n = codes[0], len(word) + 2
    for (j, k), wt in zip(OFFSETS, WEIGHTS, strict=True):
        if n > k:
            a = np.arange(n - k)
            np.add.at(into, (c[a] * SYMBOLS + c[a + j]) * SYMBOLS + c[a + k], factor * wt / norm[0])


def scores(ws: list[str], table: np.ndarray) -> np.ndarray:
    """Sum over the words' subsequences of weight times table entry, normed; in groups of like length."""
    out = np.zeros(len(ws))
    order = sorted(range(len(ws)), key=lambda i: len(ws[i]))
    for _, grp in groupby(order, key=lambda i: len(ws[i]) if len(ws[i]) < 16 else len(ws[i]) // 16 * 16 + 1000):
        idx = list(grp)
        for s in range(0, len(idx), 4096):
            part = idx[s : s + 4096]
            codes, norm = encode([ws[i] for i in part])
            n = codes.shape[1] - SPAN
            total = np.zeros(len(part))
            first = codes[:, :n] * SYMBOLS
            for (j, k), wt in zip(OFFSETS, WEIGHTS, strict=True):
                third = codes[:, k : k + n]
                total += wt * (table[(first + codes[:, j : j + n]) * SYMBOLS + third] * (third > 0)).sum(axis=1)
            out[part] = total / norm
    return out


def kernel(ws: list[str], marks: list[str], step: int = 2048) -> np.ndarray:
    """Kernel values, words x landmarks, ``step`` words at a time. Only triples that some landmark has are listed."""
    held, place = [], np.full(SYMBOLS**3, -1, np.int32)
    for word in marks:
        t = np.zeros(SYMBOLS**3, np.float32)
        fold(word, t, 1.0)
        at = np.flatnonzero(t)
        held.append((at, t[at]))
    cells = np.unique(np.concatenate([at for at, _ in held])) if marks else np.zeros(0, np.int64)
    place[cells] = np.arange(len(cells))
    tables = np.zeros((len(marks), len(cells)), np.float32)
    for m, (at, v) in enumerate(held):
        tables[m, place[at]] = v
    out = np.zeros((len(ws), len(marks)))
    for s in range(0, len(ws), step):
        codes, norm = encode(ws[s : s + step])
        n = codes.shape[1] - SPAN
        rows, ids, weights = [], [], []
        for (j, k), wt in zip(OFFSETS, WEIGHTS, strict=True):
            r, a = np.nonzero(codes[:, k : k + n])
            i = place[(codes[r, a] * SYMBOLS + codes[r, a + j]) * SYMBOLS + codes[r, a + k]]
            hit = i >= 0
            rows.append(r[hit])
            ids.append(i[hit])
            weights.append(wt / norm[r[hit]])
        row, id_, weight = (np.concatenate(x) for x in (rows, ids, weights))
        for m in range(len(marks)):
            out[s : s + len(codes), m] = np.bincount(row, tables[m][id_] * weight, minlength=len(codes))
    return out


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 30, step: int = 2048) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the active rows, which are summed ``step`` at a time."""
    w, bias, d = np.zeros(x.shape[1]), 0.0, x.shape[1]
    ridge = np.eye(d + 1)
    ridge[-1, -1] = 1e-6
    active = None
    for _ in range(rounds):
        now = y * (x @ w + bias) < 1
        if active is not None and (now == active).all():
            break
        active = now
        at, left, right = np.flatnonzero(active), ridge.copy(), np.zeros(d + 1)
        for s in range(0, len(at), step):
            part = at[s : s + step]
            xa, wa = x[part], c * weight[part]
            heavy = xa * wa[:, None]
            left[:d, :d] += heavy.T @ xa
            left[:d, d] += heavy.sum(axis=0)
            left[d, d] += wa.sum()
            right[:d] += heavy.T @ y[part]
            right[d] += (wa * y[part]).sum()
        left[d, :d] = left[:d, d]
        w = np.linalg.solve(left, right)
        w, bias = w[:-1], float(w[-1])
    return w, bias


class Model:
    def __init__(self, table: np.ndarray, bias: float, slope: float, at: float) -> None:
        self.table, self.bias, self.slope, self.at = table, bias, slope, at

    def probability(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * (margin - self.at)))))


def distinct_bags(bags: list[tuple[tuple, int]], hashes: int = 12, same: int = 4) -> list[tuple[tuple, int]]:
    """Leaves out bags that share ``same`` of their MinHash values with one before them of the same label."""
    seen: dict[tuple, list[int]] = {}
    out = []
    for n, (bag, label) in enumerate(bags):
        if not bag:
            continue
        own = np.array([zlib.crc32(w.encode()) for w in bag], np.uint64)
        mins = [int(((own * np.uint64(2654435761 + 2 * i) + np.uint64(i * 40503)) & np.uint64(0xFFFFFFFF)).min()) for i in range(hashes)]
        keys = [(label, i, v) for i, v in enumerate(mins)]
        if max(Counter(m for k in keys for m in seen.get(k, [])).values(), default=0) < same:
            out.append((bag, label))
            for k in keys:
                seen.setdefault(k, []).append(n)
    return out


def learn(rows: Iterable[tuple[str, int]], **bounds: int) -> Model:
    """:func:`learn_bags` of texts with label 0 or 1."""
    return learn_bags(((bag_of(text), label) for text, label in rows), **bounds)


def bag_of(text: str | None) -> tuple[str, ...]:
    """Distinct words of three letters or more in the text's sentences; a tuple, as it takes an eighth of a set."""
    return tuple(map(sys.intern, sorted({w for s in SENTENCE.split(text or "") for w in clean_words(s.encode()) if len(w) >= 3})))


def learn_bags(rows: Iterable[tuple[tuple[str, ...], int]], landmarks: int = 240, seed: int = 5, frequent_words: int = 3000, other_words: int = 4000, hard_words: int = 2500) -> Model:
    """``rows``: distinct words of labelled texts.

    Labels are of texts, so a toxic text is a bag of sentences, and it is unknown which are toxic. First witnesses are
    the words of toxic texts' sentences whose share among them is far above that in clean texts; the machine trained on
    them rates all words of toxic texts that no clean text has, its best word of each text joins, and it is trained again.
    Bounds of the training rows: ``frequent_words`` and ``other_words`` (drawn by ``seed``) words of clean texts, and in
    each round the ``hard_words`` of them that score highest of all. Near copies of a text of the same label count once.
    """
    empty = Model(np.zeros(SYMBOLS**3, np.float32), -1.0, 1.0, 0.0)
    bags: list[tuple[tuple[str, ...], int]] = list(rows)
    # copies of one text would make all its words look like witnesses
    bags = distinct_bags(bags)
    toxic, clean = [b for b, y in bags if y == 1], [b for b, y in bags if y == 0]
    if not toxic or not clean:
        return empty if not toxic else Model(empty.table, 1.0, 1.0, 0.0)
    df1, df0 = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    share, size = len(toxic) / len(bags), len(df1)

    def chance(w: str) -> float:
        """Log of a bound on the chance that a word of as many texts has so many toxic ones among them."""
        n1, n0 = df1[w], df0[w]
        return math.lgamma(n1 + n0 + 1) - math.lgamma(n1 + 1) - math.lgamma(n0 + 1) + n1 * math.log(share)

    odds = {w: (n / len(toxic) + 1e-3) / (df0[w] / len(clean) + 1e-3) for w, n in df1.items()}
    witness = {w for w in df1 if chance(w) < -math.log(20 * size) and odds[w] > 8}
    if not witness:
        witness = {max(b, key=lambda w: (odds[w], w)) for b in toxic if b}
    rng = np.random.default_rng(seed)
    frequent = [w for w, _ in df0.most_common(frequent_words)]
    rest = sorted(set(df0) - set(frequent))
    others = frequent + [rest[i] for i in rng.permutation(len(rest))[:other_words]]
    pos, table, bias = sorted(witness), empty.table, 0.0
    every, own_words = sorted(df0), sorted({w for b in toxic for w in b if not df0[w]})
    for step in range(4):
        held = set(pos)
        neg = [w for w in others if w not in held]
        near = sorted(pos, key=lambda w: (-df1[w], w))[: landmarks // 2]
        marks = near + neg[: (landmarks - len(near)) // 2]
        marks += [neg[i] for i in rng.permutation(len(neg))[: landmarks - len(marks)]]
        k = kernel([*pos, *neg, *marks], marks)
        own = k[len(pos) + len(neg) :]
        vals, vecs = np.linalg.eigh((own + own.T) / 2)
        good = vals > max(vals.max(), 1e-9) * 1e-8
        whiten = vecs[:, good] / np.sqrt(vals[good])
        x = k[: len(pos) + len(neg)] @ whiten
        del k, own
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        weight = np.r_[np.full(len(pos), max(1.0, len(neg) / max(1, len(pos)) / 4)), np.ones(len(neg))]
        w, bias = train_svm(x, y, weight, c=100.0)
        del x
        beta = whiten @ w
        table = np.zeros(SYMBOLS**3, np.float32)
        for m, b in zip(marks, beta, strict=True):
            fold(m, table, float(b))
        if step < 3:
            grown = set(pos)
            rate = dict(zip(own_words, scores(own_words, table) + bias, strict=True))
            for b in toxic:
                cand = [w for w in b if w in rate]
                if step == 2 and cand and witness.isdisjoint(b):
                    best = max(cand, key=lambda w: (rate[w], w))
                    if rate[best] > 0.3:
                        grown.add(best)
            # clean words that the machine takes for toxic are the most telling ones to learn next
            rated = scores(every, table) + bias
            hard = [every[i] for i in np.argsort(-rated, kind="stable")[:hard_words]]
            others = list(dict.fromkeys(hard + others))
            pos = sorted(grown)
    uniq = sorted({w for b, _ in bags for w in b})
    rate = dict(zip(uniq, scores(uniq, table) + bias, strict=True))
    best = np.array([max((rate[w] for w in b), default=-2.0) for b, _ in bags])
    label = np.array([y for _, y in bags])
    # the cut that errs least, halfway between its neighbours
    order = np.sort(np.unique(best))
    cuts = np.r_[order[0] - 1, (order[1:] + order[:-1]) / 2, order[-1] + 1]
    errs = [((best >= c) != (label == 1)).sum() for c in cuts]
    low = np.flatnonzero(np.array(errs) == min(errs))
    return Model(table, bias, 6.0, float(cuts[low[len(low) // 2]]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 2000) -> Model:
    """Learn from the labelled rows, of each label ``sample`` at most (the documented bound).

    Ids are drawn by the least md5, then rows of those ids by the hash of their text, so that an id on many rows brings
    no more. A document with several labels counts as the largest; null labels and ids, and labels without a document,
    teach nothing; without any row nothing is toxic. Whole texts are learned; the driver gets their words, each once.
    """
    one = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("y IN (0, 1) AND i IS NOT NULL").groupBy("i").agg(F.max("y").alias("y"))
    order = F.md5(F.col("i").cast("string").cast("binary"))
    picked = [r for y in (0, 1) for r in one.where(F.col("y") == y).orderBy(order).limit(sample).collect()]
    if not picked:
        return learn([])
    ids = docs.sparkSession.createDataFrame([(r["i"], int(r["y"])) for r in picked], "i long, y int")
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(ids), "i").withColumn("o", F.xxhash64("t"))

    def bags(it: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in it:
            for i, y, o, t in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                yield pa.record_batch([pa.array([i]), pa.array([y], pa.int32()), pa.array([o]), pa.array([bag_of(t)], pa.list_(pa.string()))], names=["i", "y", "o", "ws"])

    found = []
    for y in (0, 1):
        kept = rows.where(F.col("y") == y).select("i", "y", "o", "t").distinct().orderBy("o", "i").limit(sample)
        # one row at a time: only distinct words stay
        for r in kept.mapInArrow(bags, "i long, y int, o long, ws array<string>").toLocalIterator():
            found.append((r["i"], r["o"], r["y"], tuple(map(sys.intern, r["ws"]))))
    found.sort(key=lambda r: r[:2])
    model = learn_bags([(ws, y) for _, _, y, ws in found])
    del found
    give_back()
    return model


_MEMO: dict[str, tuple] = {}
#: Rates of a word of one letter, and of one that is too short to say anything.
SINGLE, NOTHING = -3.0, -2.0


def spelt_out(tokens: list[bytes], rates: list[float]) -> list[str]:
    """Words made of three or more one-letter words in a row."""
    out, at, n = [], 0, len(rates)
    while at < n:
        try:
            at = rates.index(SINGLE, at)
        except ValueError:
            break
        end = at + 1
        while end < n and rates[end] == SINGLE:
            end += 1
        if end - at > 2:
            out.append("".join(map(clean_word, tokens[at:end])))
        at = end
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """id_col, the columns to keep (and the text), score, predicted for every row, null and repeated ids included.

    A null or empty text, or one without words, has the score of no evidence. Texts of any length are scored whole, an
    empty table gives no rows, and other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key, keep = uuid.uuid4().hex, keep or []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _MEMO:
            _MEMO.clear()
            _MEMO[key] = (shared.value, {})
        m, known = _MEMO[key]
        texts = [t.split() if t else [] for t in raw_texts(batch.column(batch.num_columns - 1))]
        out: list[float] = []
        for a in range(0, len(texts), 512):  # new words of some texts are scored together
            part = texts[a : a + 512]
            if len(known) > CACHE:
                known.clear()
            new = {t: clean_word(t) for t in set().union(*part) - known.keys()}
            known.update((t, SINGLE if len(w) == 1 else NOTHING) for t, w in new.items() if len(w) < 3)
            new = {t: w for t, w in new.items() if len(w) > 2}
            known.update(zip(new, (scores(list(new.values()), m.table) + m.bias).tolist(), strict=True))
            for t in part:
                rates = list(map(known.__getitem__, t))
                best = max(rates, default=NOTHING)
                if rates.count(SINGLE) > 2:
                    joined = [w for w in spelt_out(t, rates)]
                    if joined:
                        best = max(best, float(scores(joined, m.table).max()) + m.bias)
                out.append(m.probability(max(best, NOTHING)))
        pred = [int(s >= 0.5) for s in out]
        head = batch.columns if with_text else batch.columns[:-1]
        names = [id_col, *keep, *([text_col] if with_text else [])]
        return pa.record_batch([*head, pa.array(out, pa.float64()), pa.array(pred, pa.int32())], names=[*names, "score", "predicted"])

    kept = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias(text_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: None if with_text else -1])
    return map_batches(kept, run, f"{schema}, score double, predicted int")
