"""SimHash near-duplicates found with Golay-code keys.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits. Golay decoding turns a segment into the few
codeword indices that its neighbours decode to; segments that differ in two bits or fewer always share one.

* :func:`link_within_two` — all fingerprints that differ in two bits or fewer. Two errors leave one of three segments
  untouched (pigeonhole), so a key is one exact segment and one index of the next segment. Fingerprints that share a key
  are compared. A key that many fingerprints hold emits no pairs: there each fingerprint joins the words one bit around
  it, and fingerprints that meet at a word are at most two bits apart, so a star per word links exactly the same ones.
* :func:`near_duplicates` — texts of a given Jaccard similarity. At 0.8 a bit differs with probability 0.15, so a segment
  has three errors and shares an index two times in three. An index alone has 4,096 values, which any corpus crowds;
  each segment's indices are therefore split by a min-hash of the text's shingles, which texts agree on as often as they
  are similar. NINE segments of three fingerprints, each with a min-hash of its own, miss a pair at 0.8 with probability
  (1 - 0.8 * 0.64)^9 = 0.002, and unlike texts seldom meet however many there are. Pairs are verified on the texts.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.golay import near_indices
from tessera.llm.text import map_batches, raw_texts, shingles, words
from tessera.operators.components import connected_components
from tessera.plans.stage import materialize, release

SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
#: Shingles of a text that are worked on together.
STEP = 1 << 16
#: Near texts: fingerprints, bits of them that may differ (at 0.8: 29 expected, deviation 5), and words of the sketch that crowds are compared by.
PRINTS, BITS, SKETCH = 3, 64, 32
NINE = PRINTS * len(SEGMENTS)
#: A mask that gives ids another order.
ORDER = 0x2545F4914F6CDD1D


def run_hashes(ws: list[bytes], k: int, step: int = STEP) -> np.ndarray:
    """XXH64 of each k-word shingle in order, repeats included, of which ``step`` are held as texts at a time."""
    out = []
    for a in range(0, max(1, len(ws) - k + 1), step):
        part = shingles(ws[a : a + step + k - 1], k)
        out.append(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), part), np.uint64, len(part)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def _vote(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[a : a + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, k: int) -> int:
    """Signed 64-bit SimHash of the k-word shingles; a text without words has zero."""
    return _vote(run_hashes(words(text), k))


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and fp for every row, repeated rows and null ids included."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, k) for t in raw_texts(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)), run, f"{id_col} long, fp long")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]


def _keys_exact_and_near(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: segment i as it is, with each index of segment i+1."""
    seg = _segments(fp)
    rows, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        near = near_indices(seg[j], SEGMENTS[j][1])
        key = (i << 40) | (seg[i][:, None] << 12) | near
        at = np.nonzero(near >= 0)
        rows.append(at[0])
        keys.append(key[at])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(df: DataFrame, make, id_col: str, extra: str = "") -> DataFrame:
    """Rows (key, id_col, fp, ...) of a table whose columns are id_col, fp and maybe more longs."""
    names = [id_col, "fp", *([extra] if extra else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        rows, keys = make(fp)
        return pa.record_batch([pa.array(keys, pa.int64()), *(batch.column(n).take(pa.array(rows)) for n in names)], names=["key", *names])

    return map_batches(df.select(*names), run, "key long, " + ", ".join(f"{n} long" for n in names))


def link_within_two(fps: DataFrame, crowd: int = 24) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (column fp): their components are those of "two bits or fewer".

    A key held by up to ``crowd`` fingerprints compares them all; beyond that the words-between star takes over, which
    is exact too and stays linear.
    """
    keyed = materialize(_keyed(fps.select(F.col("fp").alias("id"), "fp"), _keys_exact_and_near, "id").select("key", "fp"), "golay-keys")
    held = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(held, "key"), "golay-shared")
    few = shared.where(F.col("n") <= crowd).select("key", "fp")
    pairs = few.alias("a").join(few.alias("b"), "key").where("a.fp < b.fp AND bit_count(a.fp ^ b.fp) <= 2").select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    flips = [0, *(1 << b for b in range(63)), -(1 << 63)]
    around = many.select("fp", F.explode(F.array(*(F.lit(x).cast("long") for x in flips))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    star = around.groupBy("word").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    met = around.join(star, "word").where("fp <> low").select(F.col("low").alias("src"), F.col("fp").alias("dst"))
    edges = materialize(pairs.union(met).distinct(), "simhash-edges")
    release(keyed, shared)
    return edges


def simhash_components(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id: smallest id reachable over links of two bits or fewer.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id get a fingerprint and their
    component, but never name one; where all ids of a component are null, component_id is null.
    """
    fps = materialize(fingerprints(docs, k, id_col, text_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("low")), "distinct-fps")
    edges = link_within_two(distinct)
    comp = materialize(connected_components(edges), "simhash-components")
    named = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = named.join(lows, "root").select("fp", "component_id")
    release(edges)
    return fps.join(of_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 of each distinct k-word shingle, in order."""
    return np.unique(run_hashes(words(text), k))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _min_hashes(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n min-hashes of a set: the least of each of n remixings."""
    mix, least = _odd(n, seed)[None, :], np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), STEP):  # a long text in parts
        part = h[a : a + STEP]
        mixed = (part ^ (part >> np.uint64(29)))[:, None] * mix
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return least


PRINT_COLUMNS, MIN_COLUMNS = [f"f{i}" for i in range(PRINTS)], [f"m{i}" for i in range(NINE)]


def set_prints(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id; n, the size of the text's shingle set; h1, h2: 128 bits of its word sequence; fingerprints and min-hashes of the set."""
    mix = _odd(PRINTS, 7)
    names = ["id", "n", "h1", "h2", *PRINT_COLUMNS, *MIN_COLUMNS]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((len(names) - 1, batch.num_rows), np.int64)
        for r, t in enumerate(raw_texts(batch.column(1))):
            h = set_hashes(t, k)
            if len(h):
                line = xxhash.xxh3_128_digest(b" ".join(words(t)))
                out[:3, r] = len(h), *np.frombuffer(line, np.int64)
                for i in range(PRINTS):
                    x = h * mix[i]
                    out[3 + i, r] = _vote(x ^ (x >> np.uint64(31)))
                out[3 + PRINTS :, r] = _min_hashes(h, NINE, 11).view(np.int64)
        return pa.record_batch([batch.column(0), *map(pa.array, out)], names=names)

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_batches(rows, run, ", ".join(f"{n} long" for n in names)).where("n > 0")


def _keys_near_split(prints: np.ndarray, mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: each index of each segment with the min-hash of that segment's number."""
    rows, keys = [], []
    for f in range(PRINTS):
        for i, seg in enumerate(_segments(prints[f])):
            s = f * len(SEGMENTS) + i
            near = near_indices(seg, SEGMENTS[i][1])
            at = np.nonzero(near >= 0)
            key = mins[s][:, None].view(np.uint64) + (near + (s << 12)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            rows.append(at[0])
            keys.append((key ^ (key >> np.uint64(32)))[at].view(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _near_keys(reps: DataFrame) -> DataFrame:
    """(key, rep)"""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(1, 1 + PRINTS + NINE)]
        rows, keys = _keys_near_split(cols[:PRINTS], cols[PRINTS:])
        return pa.record_batch([pa.array(keys), batch.column(0).take(pa.array(rows))], names=["key", "rep"])

    return map_batches(reps.select("rep", *PRINT_COLUMNS, *MIN_COLUMNS), run, "key long, rep long")


def _sized(similarity: float, a: str, b: str) -> Column:
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9


def _may_be_near(similarity: float, a: str, b: str) -> Column:
    apart = sum((F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in PRINT_COLUMNS), F.lit(0))
    return _sized(similarity, a, b) & (apart <= BITS)


def _pairs(joined: DataFrame, a: str = "a.rep", b: str = "b.rep") -> DataFrame:
    return joined.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, t) of some ids, one row each."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.join(ids, "i", "left_semi").groupBy("i").agg(F.min("t").alias("t"))


def verified(pairs: DataFrame, docs: DataFrame, k: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Those pairs (src, dst) of ids whose shingle sets are at least that similar; only the texts of paired ids move."""
    ids = pairs.select(F.col("src").alias("i")).union(pairs.select(F.col("dst"))).distinct()
    texts = materialize(_texts(docs, ids, id_col, text_col), "paired-texts")
    both = pairs.join(texts.select(F.col("i").alias("src"), F.col("t").alias("a")), "src").join(texts.select(F.col("i").alias("dst"), F.col("t").alias("b")), "dst")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = []
        of = lru_cache(8)(lambda t: set(shingles(words(t), k)))
        for a, b in zip(raw_texts(batch.column(2)), raw_texts(batch.column(3)), strict=True):
            x, y = of(a), of(b)
            both_ = len(x & y)
            near.append(both_ >= similarity * (len(x) + len(y) - both_) - 1e-9)
        return pa.record_batch([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(near, pa.bool_()))

    out = materialize(map_batches(both.select("src", "dst", "a", "b"), run, "src long, dst long"), "verified-pairs")
    release(texts)
    return out


def _sketches(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """rep, s0 ...: one bit of each of 64 * SKETCH min-hashes. Bits of two texts differ half as often as (1 - J) says."""
    names = [f"s{i}" for i in range(SKETCH)]
    mix = _odd(64 * SKETCH, 13).astype(np.uint32)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((batch.num_rows, SKETCH), np.int64)
        for r, t in enumerate(raw_texts(batch.column(1))):
            h, least = set_hashes(t, k).astype(np.uint32), None
            for a in range(0, len(h), 1024):  # a long text in parts
                part = (h[a : a + 1024, None] * mix).min(axis=0)
                least = part if least is None else np.minimum(least, part)
            out[r] = np.packbits(np.bitwise_count(least) & 1).view(np.int64)
        return pa.record_batch([batch.column(0), *map(pa.array, np.ascontiguousarray(out.T))], names=["rep", *names])

    return map_batches(_texts(docs, ids, id_col, text_col), run, ", ".join(f"{n} long" for n in ["rep", *names]))


def _open_keys(shared: DataFrame, near: DataFrame) -> DataFrame:
    """``shared`` with c and c_lead, the components so far of rep and lead; only keys whose members are in two or more."""
    comp = materialize(connected_components(near), "near-components-so-far")
    out = shared
    for name, column in (("rep", "c"), ("lead", "c_lead")):
        out = out.join(comp.select(F.col("node").alias(name), F.col("component").alias(column)), name, "left").withColumn(column, F.coalesce(column, name))
    open_ = out.where("c <> c_lead").select("key").distinct()
    out = materialize(out.join(open_, "key", "left_semi"), "open-keys")
    release(comp)
    return out


def _alike(similarity: float) -> Column:
    """Sketches of a and b leave the similarity open: at the threshold (1 - similarity) / 2 of their bits differ, and five
    standard deviations are allowed on top."""
    bits, p = 64 * SKETCH, (1 - similarity) / 2
    apart = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(SKETCH)), F.lit(0))
    return apart <= int(bits * p + 5 * np.sqrt(bits * p * (1 - p)))


def _stars(shared: DataFrame, reps: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Pairs (src, dst) of members and their leader."""
    spokes = shared.where("rep <> lead").select("rep", "lead", "n", *PRINT_COLUMNS).distinct()
    near = spokes.alias("a").join(reps.alias("b"), (F.col("a.lead") == F.col("b.rep")) & _may_be_near(similarity, "a", "b")).select("a.rep", "a.lead")
    both = near.join(marks, "rep").alias("a").join(marks.alias("b"), (F.col("a.lead") == F.col("b.rep")) & _alike(similarity))
    return _pairs(both)


def _unsettled(rows: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Pairs (src, dst) of open keys that can still join two components: members outside their leader's component meet
    all members of other components."""
    # a pair is made at the least of its keys alone; a text has at most 6 * NINE
    keys = rows.groupBy("rep").agg(F.collect_set("key").alias("keys"))
    marked = materialize(rows.select("key", "rep", "n", "c", "c_lead").join(marks.join(keys, "rep"), "rep"), "open-rows")
    once = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")
    met = marked.where("c <> c_lead").alias("a").join(marked.alias("b"), F.col("a.key") == F.col("b.key")).where((F.col("a.c") != F.col("b.c")) & _sized(similarity, "a", "b") & _alike(similarity) & once)
    out = materialize(_pairs(met), "unsettled-pairs")
    release(marked)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id) of every id in a group of two or more texts that are linked, exact copies included.

    Texts of equal word sequences are one. Different ones are linked if their sets of k-word shingles (repeats and order
    aside) are at least that similar; the groups are those of all links, named by their smallest id. All that hold a key
    are compared with one of them first, which settles most of a group of copies in time linear in its size; what is in
    several components then (:func:`_unsettled`) is compared pair by pair, first by sketches of some machine words each.
    Null and empty texts, those without words, and null ids link with nothing; a repeated id stands with each of its
    texts, and the least of them is compared. Texts of any length are taken whole. An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    prints = materialize(set_prints(docs, k, id_col, text_col), "set-prints")
    attrs = ["n", *PRINT_COLUMNS]
    reps = materialize(prints.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("c"), *(F.first(x).alias(x) for x in (*attrs, *MIN_COLUMNS))), "set-reps")
    keyed = _near_keys(reps)
    # a leader for each key: the least id in an order that all keys share, so that few texts lead a group
    held = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min(F.col("rep").bitwiseXOR(F.lit(ORDER))).alias("lead")).where("m > 1")
    held = held.select("key", F.col("lead").bitwiseXOR(F.lit(ORDER)).alias("lead"))
    shared = materialize(keyed.join(held, "key").join(reps.select("rep", *attrs), "rep"), "shared-keys")
    marks = materialize(_sketches(docs, shared.select(F.col("rep").alias("i")).distinct(), k, id_col, text_col), "sketches")
    pairs = materialize(_stars(shared, reps, marks, similarity), "star-pairs")
    near = verified(pairs, docs, k, similarity, id_col, text_col)
    rows, more, late = _open_keys(shared, near), None, None
    if not rows.isEmpty():
        more = _unsettled(rows, marks, similarity)
        late = verified(more.join(pairs, ["src", "dst"], "left_anti"), docs, k, similarity, id_col, text_col)
    copies = prints.select("id", "h1", "h2").join(reps.where("c > 1").select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    out = connected_components(near.union(copies) if late is None else near.union(late).union(copies))
    release(prints, reps, shared, marks, pairs, near, rows, more, late)
    return out.select(F.col("node").alias(id_col), F.col("component").alias("component_id"))
