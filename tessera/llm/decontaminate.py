"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Everything here is DataFrame functions. A text's set is its distinct five-word shingles as 64-bit hashes. Documents are
partitioned by the size of that set, in powers of two. A document's signature is its one-permutation MinHash: the hashes
are dealt into as many bins as its partition asks for, and the least of each bin stays. Items are the queries: each looks
up all its shingles, so an item of q shingles that a document holds to a share t meets it if one of the t q shared
shingles is the least of its bin. In a set of u with k bins a shingle is that with probability s = k/u (1 - exp(-u/k)),
and the bins of a partition are the fewest for which (1 - s)^(t q) is at most ``miss`` for its largest set and the
smallest item. So short items in long documents get signatures close to the whole set, which is the limit and misses
nothing, and long items small ones. Pairs that meet are verified on the shingles themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import words_column
from tessera.plans.stage import materialize, release

#: A document's partition is the bits of its size; larger sets share the last.
PARTITIONS = 40


def shingle_column(words: Column, k: int) -> Column:
    """Distinct k-word shingles of an array of words, space-joined; fewer words give none."""
    return F.when(F.size(words) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(hashes: Column, k: int) -> Column:
    """Distinct 64-bit hashes of all runs of k among an array of word hashes."""
    run = F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), lambda i: F.xxhash64(*(F.element_at(hashes, i + j) for j in range(k))))
    return F.when(F.size(hashes) >= k, F.array_distinct(run)).otherwise(F.array().cast("array<bigint>"))


def survival(size: int, bins: float) -> float:
    """Chance that an element of a set of ``size`` is the least of its bin."""
    load = size / bins
    return -math.expm1(-load) / load


def bin_bits(size: int, shared: int, miss: float) -> int:
    """Bits of the least power of two of bins so that none of ``shared`` elements survives with probability ``miss`` at
    most; 64 (every element is alone) where no fewer than 16 bins an element do."""
    for bits in range(0, math.ceil(math.log2(max(1, size))) + 5):
        if (1 - survival(size, 2.0**bits)) ** shared <= miss:
            return bits
    return 64


def signature(ordered: Column, bits: Column) -> Column:
    """The least of each bin of sorted hashes; a bin is the first ``bits`` of a hash, so bins follow each other."""

    def bin_(h: Column) -> Column:
        return F.when(bits >= 64, h).when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", h, (F.lit(64) - bits).cast("int")))

    return F.filter(ordered, lambda h, i: (i == 0) | (bin_(h) != bin_(F.element_at(ordered, F.greatest(i, F.lit(1))))))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """id_col, item_col, n_shared, n_item, containment of each pair with containment >= threshold.

    Items of fewer than k words (but one at least) are one shingle of their own length. Null and empty texts and items
    and rows with a null id match nothing; rows that repeat an id are one set together, and so are items. Texts of any
    length are taken whole. Empty tables give no rows; other columns are not read, whatever their names. The items' hashes
    are broadcast only if they are counted and no more than ``broadcast_rows``.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words_column(F.col(item_text).cast("string")).alias("w")).where("item IS NOT NULL AND size(w) > 0")
    own = F.when(F.size("w") >= k, shingle_column(F.col("w"), k)).otherwise(F.array(F.array_join("w", " ")))
    item_rows = materialize(items.select("item", F.least(F.size("w"), F.lit(k)).alias("len"), F.explode(own).alias("s")).distinct(), "item-shingles")
    lengths = sorted(r["len"] for r in item_rows.select("len").distinct().collect())  # of 1 to k
    counted = item_rows.groupBy("item").agg(F.count("*").alias("n_item"))
    least = counted.agg(F.min("n_item")).first()[0] or 1
    shared = max(1, math.ceil(threshold * least - 1e-9))

    # the search: signatures of documents against the items' hashes
    hashed = F.xxhash64(*(F.xxhash64(F.element_at(F.split("s", " "), j + 1)) for j in range(k)))
    for n in range(1, k):
        hashed = F.when(F.col("len") == n, F.xxhash64(*(F.xxhash64(F.element_at(F.split("s", " "), j + 1)) for j in range(n)))).otherwise(hashed)
    keys = materialize(item_rows.select("item", "len", hashed.alias("h")), "item-keys")
    asked = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t"))
    sets = texts.select("doc", F.transform(words_column("t"), lambda x: F.xxhash64(x)).alias("wh"))
    found = None
    for n in lengths or [k]:
        part = F.least(F.lit(PARTITIONS), F.ceil(F.log2(F.size("set").cast("double"))).cast("int"))
        bits = F.element_at(F.array(*(F.lit(bin_bits(1 << p, shared, miss)) for p in range(PARTITIONS))), F.least(F.col("part") + 1, F.lit(PARTITIONS)))
        # no filter here: it would be pushed down with the expressions in it, which are dear
        one = sets.select("doc", F.sort_array(shingle_hashes(F.col("wh"), n)).alias("set")).withColumn("part", part).withColumn("bits", bits)
        sign = one.select("doc", F.explode(signature(F.col("set"), F.col("bits"))).alias("h"))
        met = sign.join(asked.where(F.col("len") == n).drop("len"), "h").select("doc", "item")
        found = met if found is None else found.union(met)
    candidates = materialize(found.distinct(), "candidates")

    # verification: all shingles of candidate documents, against those of their candidate items
    named = texts.join(candidates.select("doc").distinct(), "doc", "left_semi").select("doc", words_column("t").alias("w"))
    every = F.concat(*(shingle_column(F.col("w"), n) for n in (lengths or [k])))
    wanted = candidates.join(item_rows.select("item", "s"), "item")
    hits = named.select("doc", F.explode(every).alias("s")).join(item_rows.select("s").distinct(), "s", "left_semi").distinct()
    both = wanted.join(hits, ["doc", "s"]).groupBy("doc", "item").agg(F.count("*").alias("n_shared"))
    ratio = F.col("n_shared") / F.col("n_item")
    out = materialize(both.join(counted, "item").where(ratio >= threshold - 1e-12).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_item", ratio.alias("containment")), "contaminated")
    release(item_rows, keys, candidates)
    return out


def oracle(k: int = 5, threshold: float = 0.8) -> str:
    """DuckDB SQL: exact containment of every item, those of fewer than k words as one shingle of their own length."""
    word = r"[^\x20\x09-\x0D]+"
    low = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}')"

    def runs(n: int) -> str:
        return f"CASE WHEN len(w) >= {n} THEN list_distinct([array_to_string(w[i:i+{n - 1}], ' ') for i in range(1, len(w) - {n - 2})]) ELSE [] END"

    lists = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, unnest({runs(n)}) AS s FROM dw WHERE {n} IN (SELECT n FROM i)" for n in range(1, k + 1))
    return f"""
    WITH dw AS (SELECT doc_id, {low} AS w FROM documents WHERE doc_id IS NOT NULL),
    iw AS (SELECT item_id, {low} AS w FROM benchmark WHERE item_id IS NOT NULL),
    i AS (SELECT DISTINCT item_id, least(len(w), {k}) AS n, unnest(CASE WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE {runs(k)} END) AS s FROM iw WHERE len(w) > 0),
    d AS (SELECT DISTINCT doc_id, n, s FROM ({lists})),
    c AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
    SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item)::DOUBLE AS containment
    FROM d JOIN i USING (n, s) JOIN c USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= {threshold} * any_value(n_item) - 1e-9"""
