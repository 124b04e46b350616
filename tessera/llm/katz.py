"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, recursive evaluation.

p(w | h) = scale(h) d(c(h,w)) c(h,w) / c(h) for a kept bigram, else alpha(h) p(w); p(w) = d(c(w)) c(w) / N for a known
word, else the mass that the discounts left. alpha(h) is the mass that h's kept bigrams leave over the unigram mass of
words outside them, so each history sums to one. Bigrams seen less than MIN_BIGRAM times back off.

The corpus is counted and scored as packed arrays: a task turns its documents into arrays of 64-bit word and bigram keys,
sorted and cut into buckets of the key space, and one compressed piece for each bucket goes through the shuffle. So a
bucket holds a share of the distinct keys, a task adds up its own repeats first, and a word or bigram with any share of
all tokens is one entry a task (counting) or one entry a document (scoring). Counts and model are tables partitioned by
order. A bounded head of the model (HEAD entries an order, chosen by a count threshold) is broadcast and evaluated at
once; all other entries meet their tokens in the buckets. Training broadcasts the HEAD most frequent words, then histories,
in the same way: most bigrams find theirs where they are stored, and only those of the rarer ones are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.text import give_back, parts, raw_texts
from tessera.plans.stage import forget, materialize, release

MIN_BIGRAM, GT_MAX, HEAD, CACHE = 1, 5, 300_000, 150_000
PIECES = "bucket long, kind int, payload binary"
#: Bytes of texts that are counted or scored together: the more, the more repeats are added up before the shuffle.
TEXTS = 4 << 20
#: Documents are scored in so many parts, one after the other: the model's pieces go through the shuffle once for each, but
#: never beside the tokens of all documents.
SCORED_IN = 2
#: Rows of a table that are cut into buckets together: the more, the closer their keys and the fewer pieces.
TABLE_ROWS = 1 << 18
#: Bytes of text a bucket is for: a task that merges one holds its share of distinct keys.
BUCKET_BYTES = 16 << 20
#: No word holds a space, so these are no word's keys.
START, END = xxhash.xxh64_intdigest(b" start"), xxhash.xxh64_intdigest(b" end")


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = v = xxhash.xxh64_intdigest(word)
        return v


_IDS = Ids()


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def bigram_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    k = h * np.uint64(0x9E3779B97F4A7C15) + w
    k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(32))


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories, words (both as keys) and the text number of every token, ends included."""
    if len(_IDS) > CACHE:
        _IDS.clear()
    flat, sizes = [START], []
    for t in texts:
        ws = t.lower().split() if t else []
        flat += map(_IDS.__getitem__, ws)
        flat.append(END)
        flat.append(START)
        sizes.append(len(ws) + 1)
    ids = np.array(flat, np.uint64)
    h, w = ids[:-1], ids[1:]
    real = w != np.uint64(START)
    return h[real], w[real], np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, their bytes by place and compressed; a sorted first array as differences."""
    out = []
    for n, a in enumerate(arrays):
        if n == 0 and a.dtype == np.uint64 and len(a):
            a = np.concatenate([a[:1], np.diff(a)])
        raw = zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes())
        out += [np.array([len(raw), len(a), ord(a.dtype.char)], np.int64).tobytes(), raw]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size, n, char = np.frombuffer(data, np.int64, 3, at)
        dtype = np.dtype(chr(char))
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + 24 : at + 24 + size], n * dtype.itemsize + 1), np.uint8)
        a = np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).ravel()
        out.append(np.cumsum(a, dtype=np.uint64) if not out and dtype == np.uint64 else a)
        at += 24 + int(size)
    return out


def bucket_labels(spark: SparkSession, n: int) -> list[int]:
    """n labels that a hash partitioning into n partitions deals out one to each."""
    rows = spark.range(n * 25).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    got = {r["p"]: r["id"] for r in rows}
    return [got.get(p, n * 25 + p) for p in range(n)]


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal parts of the key space begins in sorted keys."""
    bounds = (np.arange(n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def pieces(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, p = zip(*rows, strict=True)
    return pa.record_batch([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], names=["bucket", "kind", "payload"])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their sums, and where each came first."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(counts[order], first) if len(k) else counts[:0], order[first]


def bucket_count(texts: DataFrame, text_col: str) -> int:
    """Buckets for as much text as there is, and no fewer than the session's shuffle partitions."""
    size = texts.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def count_ngrams(texts: DataFrame, text_col: str, buckets: int, min_bigram: int = MIN_BIGRAM) -> DataFrame:
    """(ord, h, w, c): all unigrams (h 0), bigrams of ``min_bigram`` or more, and under ord 0 how many n-grams of order h
    have count w."""
    spark = texts.sparkSession
    labels = bucket_labels(spark, buckets)

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in it for x in parts(b, TEXTS)):
            h, w, _ = tokens(raw_texts(batch.column(0)))
            rows = []
            uk, uc, _ = summed(w, np.ones(len(w), np.uint32))
            at = cuts(uk, buckets)
            rows += [(labels[b], 1, pack(uk[s:e], uc[s:e])) for b, (s, e) in enumerate(zip(at, at[1:], strict=False)) if s < e]
            key = bigram_keys(h, w)
            bk, bc, first = summed(key, np.ones(len(w), np.uint32))
            at = cuts(bk, buckets)
            for b, (s, e) in enumerate(zip(at, at[1:], strict=False)):
                if s < e:
                    hh, ww = h[first[s:e]], w[first[s:e]]
                    vocab, idx = np.unique(np.concatenate([hh, ww]), return_inverse=True)
                    idx = idx.astype(np.uint32)
                    rows.append((labels[b], 2, pack(vocab, idx[: e - s], idx[e - s :], bc[s:e])))
            yield pieces(rows)
            del h, w, uk, uc, key, bk, bc, first, rows
            give_back()
        _IDS.clear()
        give_back()

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, big = [], []
        for batch in it:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == 1:
                    uni.append(unpack(payload))
                else:
                    vocab, hi, wi, c = unpack(payload)
                    big.append((vocab[hi], vocab[wi], c))
        out = []
        if uni:
            k, c, _ = summed(np.concatenate([u[0] for u in uni]), np.concatenate([u[1] for u in uni]).astype(np.int64))
            out.append((1, np.zeros(len(k), np.int64), k, c))
        if big:
            h, w = np.concatenate([b[0] for b in big]), np.concatenate([b[1] for b in big])
            cc = np.concatenate([b[2] for b in big]).astype(np.int64)
            big.clear()
            k, c, first = summed(bigram_keys(h, w), cc)
            order = first[np.argsort(h[first], kind="stable")]  # by history, which is stored in little then
            counts = np.empty(len(h), np.int64)
            counts[first] = c
            out.append((2, h[order], w[order], counts[order]))
        for n, h, w, c in out:
            r, times = np.unique(c[c <= GT_MAX + 1], return_counts=True)
            yield pa.record_batch([pa.array(np.zeros(len(r), np.int32)), pa.array(np.full(len(r), n, np.int64)), pa.array(r.astype(np.int64)), pa.array(times.astype(np.int64))], names=["ord", "h", "w", "c"])
            keep = c >= (1 if n == 1 else min_bigram)
            h, w, c = h[keep].view(np.int64), w[keep].view(np.int64), c[keep]
            for s in range(0, len(c), 65536):
                e = min(len(c), s + 65536)
                yield pa.record_batch([pa.array(np.full(e - s, n, np.int32)), pa.array(h[s:e]), pa.array(w[s:e]), pa.array(c[s:e])], names=["ord", "h", "w", "c"])
        del uni, big, out
        give_back()

    return texts.select(F.col(text_col).cast("string")).mapInArrow(split, PIECES).repartition(buckets, "bucket").mapInArrow(merge, "ord int, h long, w long, c long")


def discounts(n: dict[int, int], least: int) -> dict[int, float]:
    """Good-Turing d(r) for r up to GT_MAX; where counts of counts don't allow it, absolute discounting stands in."""
    out, n1 = {}, n.get(1, 0)
    tail = (GT_MAX + 1) * n.get(GT_MAX + 1, 0) / n1 if n1 else 1.0
    for r in range(1, GT_MAX + 1):
        a, b = n.get(r, 0), n.get(r + 1, 0)
        d = ((r + 1) * b / a / r - tail) / (1 - tail) if a and n1 and tail < 1 else 0.0
        if not 0 < d < 1:
            d = (r - (a / (a + 2 * b) if a and b else 0.5)) / r
        out[r] = d if r >= least else 0.0
    return out


def discounted(c: Column, d: dict[int, float]) -> Column:
    out = c.cast("double")
    for r, v in d.items():
        out = F.when(c == r, F.lit(v * r)).otherwise(out)
    return out


class Katz:
    """Tables ``uni`` (w, c, p, log_alpha) and ``big`` (h, w, c, gain), with N, V, the unknown word's mass and the number
    of learning texts. gain: log10 of p(w | h) over alpha(h) p(w)."""

    def __init__(self, uni: DataFrame, big: DataFrame, total: int, vocabulary: int, unknown: float, start_alpha: float) -> None:
        self.uni, self.big, self.total, self.vocabulary, self.unknown, self.start_alpha = uni, big, total, vocabulary, unknown, start_alpha


def train(texts: DataFrame, text_col: str = "text", buckets: int | None = None, min_bigram: int = MIN_BIGRAM) -> Katz:
    """Learn from all rows; a null text is an empty one, whole texts are read, repeated rows count each time, and other
    columns are not read, whatever their names. No rows: every word is unknown with probability 1. Bigrams seen less than
    ``min_bigram`` times back off; 1 keeps them all."""
    spark = texts.sparkSession
    buckets = buckets or bucket_count(texts, text_col)
    grams = materialize(count_ngrams(texts, text_col, buckets, min_bigram), "ngrams", ["ord"])
    forget(spark)
    of = {1: {}, 2: {}}
    for r in grams.where("ord = 0").groupBy("h", "w").agg(F.sum("c").alias("n")).collect():
        of[r["h"]][r["w"]] = r["n"]
    d1, d2 = discounts(of[1], 1), discounts(of[2], min_bigram)
    uni = materialize(grams.where("ord = 1").select("w", "c"), "unigrams")
    big = grams.where("ord = 2").select("h", "w", "c")
    row = uni.agg(F.sum("c"), F.count("*"), F.sum(discounted(F.col("c"), d1)), F.sum(F.when(F.col("w") == signed(END), F.col("c")))).first()
    total, vocabulary, mass, starts = row[0] or 0, row[1], float(row[2] or 0), row[3] or 0
    unknown = 1 - mass / total if total else 1.0
    scale = 1.0
    if total and unknown <= 1e-12:  # no discount left anything
        scale, unknown = total / (total + 1), 1 / (total + 1)
    p = discounted(F.col("c"), d1) * F.lit(scale / total if total else 0.0)
    probs = uni.select("w", "c", p.alias("p"))
    with_p = materialize(_meet(big, probs.select("w", "p", F.col("c").alias("often")), "w").select("h", "w", "c", "p"), "bigram-p")
    release(grams)
    del big
    forget(spark)
    sums = with_p.groupBy("h").agg(F.sum(discounted(F.col("c"), d2)).alias("m"), F.sum("p").alias("q"))
    start = spark.createDataFrame([(signed(START), int(starts))], "w long, c long")
    hist = sums.join(uni.union(start).select(F.col("w").alias("h"), F.col("c").alias("ch")), "h")
    left = 1 - F.col("m") / F.col("ch")
    hist = hist.withColumn("scale", F.when(left > 1e-12, 1.0).otherwise(F.col("ch") / (F.col("ch") + 1)))
    hist = materialize(hist.select("h", "ch", "scale", F.log10((1 - F.col("scale") * F.col("m") / F.col("ch")) / (1 - F.col("q"))).alias("log_alpha")), "histories")
    del sums
    forget(spark)
    gain = F.log10(F.col("scale") * discounted(F.col("c"), d2) / F.col("ch")) - F.col("log_alpha") - F.log10("p")
    out_big = materialize(_meet(with_p, hist.withColumn("often", F.col("ch")), "h").select("h", "w", "c", gain.alias("gain")), "katz-bigrams")
    release(with_p)
    del with_p
    forget(spark)
    joined = probs.join(hist.select(F.col("h").alias("w"), "log_alpha"), "w", "left").select("w", "c", "p", F.coalesce("log_alpha", F.lit(0.0)).alias("log_alpha"))
    out_uni = materialize(joined, "katz-unigrams")
    first = hist.where(F.col("h") == signed(START)).select("log_alpha").first()
    release(hist, uni)
    del hist, joined, probs, uni
    forget(spark)
    return Katz(out_uni, out_big, total, vocabulary, unknown, first[0] if first else 0.0)


def _head_floor(counts: DataFrame) -> int:
    """Least count so that at most HEAD rows have it."""
    n = counts.groupBy(F.least(F.col("c"), F.lit(100_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()
    have, floor = 0, 100_001
    for r in n:
        have += r["n"]
        if have > HEAD:
            break
        floor = r["c"]
    return floor


def _meet(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``table``, which has each key once and in ``often`` how frequent it is. The most frequent keys go to
    the rows; only rows of other keys are shuffled, and those keys hashed a bucket at a time, so the rows are never sorted."""
    floor = _head_floor(table.select(F.col("often").alias("c")))
    head = F.broadcast(table.where(F.col("often") >= floor).drop("often"))
    tail = table.where(F.col("often") < floor).drop("often")
    rest = rows.join(head, key, "left_anti").join(tail.hint("shuffle_hash"), key)
    return rows.join(head, key).unionByName(rest)


def _keyed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values, counts of a batch of :func:`_values`."""
    h, w = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
    big = b.column(4).to_numpy(zero_copy_only=False)
    return np.where(big, bigram_keys(h, w), w), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)


def _values(df: DataFrame, big: bool) -> DataFrame:
    """h, w, value, c, big: what a unigram (alpha + p) or bigram (gain) adds to a text's log10 score."""
    h, value = (F.col("h"), F.col("gain")) if big else (F.lit(0).cast("long"), F.col("log_alpha") + F.log10("p"))
    return df.select(h.alias("h"), "w", value.alias("value"), "c", F.lit(big).alias("big"))


def _table_pieces(values: DataFrame, kind: int, buckets: int, labels: list[int]) -> DataFrame:
    def cut(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        k, v, c = (np.concatenate(x) for x in zip(*held, strict=True))
        if kind == 2:  # nothing asks how often a bigram was seen
            c = np.zeros(len(k), np.uint8)
        o = np.argsort(k)
        k, v, c = k[o], v[o], c[o]
        at = cuts(k, buckets)
        return pieces([(labels[i], kind, pack(k[s:e], v[s:e], c[s:e])) for i, (s, e) in enumerate(zip(at, at[1:], strict=False)) if s < e])

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            if b.num_rows:
                held.append(_keyed(b))
                n += b.num_rows
            if n >= TABLE_ROWS:
                yield cut(held)
                held, n = [], 0
        if held:
            yield cut(held)
        give_back()

    return values.mapInArrow(split, PIECES)


def _head(values: DataFrame, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = [_keyed(b) for b in values.where(F.col("c") >= floor).toArrow().to_batches()]
    k, v, c = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, t) for i, t in enumerate((np.uint64, float, np.int64)))
    o = np.argsort(k)
    return k[o], v[o], c[o]


def look_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys stand in a sorted table, and which of them are in it."""
    if not len(table[0]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return at, table[0][at] == keys


def evaluate(docs: DataFrame, model: Katz, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """id_col, n_tokens, n_known, base_score, score for every row; repeated rows keep their number, null ids are kept.

    A null or empty text is its end alone, whole texts are scored, an empty table gives no rows, and other columns are not
    read, whatever their names.

    A text's score is the sum over its tokens of alpha(h) p(w), plus a gain for each kept bigram, which is the recursion
    p(w | h) -> p(w) -> unknown written as sums that are gathered by key. What a bucket adds to the texts of a slice goes
    back to that slice as one piece, and there is one row out for each row in. Documents are dealt by id into SCORED_IN
    parts; all but the last are scored and written here.
    """
    spark = docs.sparkSession
    buckets = buckets or bucket_count(docs, text_col)
    labels = bucket_labels(spark, buckets)
    uni, big = _values(model.uni, False), _values(model.big, True)
    floors = [_head_floor(model.uni), _head_floor(model.big)]
    heads = spark.sparkContext.broadcast([_head(v, f) for v, f in zip((uni, big), floors, strict=True)])
    logn = math.log10(model.total + model.vocabulary + 1)
    unk = math.log10(model.unknown)
    alpha0 = model.start_alpha

    def events(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a slice of texts is named by its place, which a repeated task finds again
        origin, slices = TaskContext.get().partitionId() << 32, 0
        for batch in it:
            for part in parts(batch, TEXTS):
                texts = raw_texts(part.column(1))
                h, w, doc = tokens(texts)
                n = len(texts)
                name = np.array([origin + slices], np.int64)
                slices += 1
                rows, sums = [], np.zeros((3, n))
                for kind, key, head in ((1, w, heads.value[0]), (2, bigram_keys(h, w), heads.value[1])):
                    order = np.argsort(key)
                    k, d = key[order], doc[order]
                    at, found = look_up(k, head)
                    add(sums, kind, d[found], head[1][at[found]], head[2][at[found]])
                    k, d = k[~found], d[~found]
                    del order, at, found
                    edge = cuts(k, buckets)
                    rows += [(labels[b], kind + 3, pack(k[x:y], d[x:y].astype(np.uint32), name)) for b, (x, y) in enumerate(zip(edge, edge[1:], strict=False)) if x < y]
                ids = np.array([0 if i is None else i for i in part.column(0).to_pylist()], np.int64)
                null = part.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                # START is a history once in every text
                sums[2] += alpha0
                rows.append((labels[slices % buckets], 3, pack(name, ids, null, np.bincount(doc, minlength=n), *sums)))
                yield pieces(rows)
                del texts, h, w, doc, key, k, d, rows
                give_back()
        _IDS.clear()
        give_back()

    def add(sums: np.ndarray, kind: int, d: np.ndarray, value: np.ndarray, c: np.ndarray) -> None:
        n = sums.shape[1]
        sums[2] += np.bincount(d, value, n)
        if kind == 1:
            sums[0] += np.bincount(d, minlength=n)
            sums[1] += np.bincount(d, np.log10(c + 1.0) - logn, n)

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}
        tables: dict[int, tuple] = {}
        for batch in it:
            out = []
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind < 3:
                    held[kind].append(unpack(payload))
                    continue
                if kind == 3:
                    out.append((int(unpack(payload)[0][0]), 0, payload))
                    continue
                if not tables:
                    for t, got in held.items():
                        cat = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.uint64 if i == 0 else float) for i in range(3)]
                        o = np.argsort(cat[0])
                        tables[t] = tuple(c[o] for c in cat)
                        got.clear()
                k, d, name = unpack(payload)
                t = tables[kind - 3]
                at, found = look_up(k, t)
                own, d = np.unique(d, return_inverse=True)
                sums = np.zeros((3, len(own)))
                add(sums, kind - 3, d[found], t[1][at[found]], t[2][at[found]])
                if kind == 4:  # unknown words
                    n = np.bincount(d[~found], minlength=len(own))
                    sums[1] -= n * logn
                    sums[2] += n * unk
                used = sums.any(axis=0)
                if used.any():
                    out.append((int(name[0]), 1, pack(own[used], *sums[:, used])))
            if out:
                yield pieces(out)
        held.clear()
        tables.clear()
        give_back()

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, null, size, sums = None, None, None, None, None

        def full() -> pa.RecordBatch:
            return pa.record_batch([pa.array(ids, mask=null.astype(bool)), pa.array(size), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc", "n_tokens", "n_known", "base_score", "score"])

        for batch in it:
            for name, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if now is not None:
                        yield full()
                    now = name
                    _, ids, null, size, *three = unpack(payload)
                    sums = np.array(three)
                else:
                    own, *more = unpack(payload)
                    sums[:, own] += np.array(more)
        if now is not None:
            yield full()

    def scored(part: int) -> DataFrame:
        told = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(SCORED_IN)) == part).mapInArrow(events, PIECES)
        tail = _table_pieces(uni.where(F.col("c") < floors[0]), 1, buckets, labels).union(_table_pieces(big.where(F.col("c") < floors[1]), 2, buckets, labels))
        met = tail.union(told).repartition(buckets, "bucket").sortWithinPartitions("kind")
        back = met.mapInArrow(gather, PIECES).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
        return back.mapInArrow(finish, "doc long, n_tokens long, n_known long, base_score double, score double")

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = None
    for part in range(SCORED_IN):
        done = scored(part)
        if part < SCORED_IN - 1:
            done = materialize(done, "scores")
            forget(spark)
        out = done if out is None else out.unionByName(done)
    return out.withColumnRenamed("doc", id_col)
