"""Line dedup by a suffix array over line-ID sequences.

A document is its sequence of lines that have words. Prefix doubling ranks every suffix by its first 1, 2, 4, ... lines:
round j sorts pairs (rank here, rank 2^(j-1) lines on) by range over the whole corpus and numbers them in that order, so
ranks are those of the suffix array cut at 2^j lines. A suffix whose pair occurs once has no equal beyond that depth and
leaves the rounds; they end when none is left, after log2 of the longest repeated run.

All suffixes that share a run of n lines form one interval of the suffix array whose longest common prefix is n or more,
and two ranks name it: those of its first and last 2^j lines, 2^j <= n. The intervals that matter are found from each
start with the shortest run of ``min_words`` words, plus longer ones up to where the next start's shortest run ends:
as both ends only move on, these are two a line at most, and their union is that of all maximal repeated runs (see
tests). In each interval the first copy (by document, then line) stays; the lines of later copies are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import free_name
from tessera.plans.stage import materialize, release


def sequence_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, line (number in the text), at (number among lines with words), words, h1, h2: the line's 128-bit ID."""
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")
    each = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    worded = F.filter(each, lambda s: s["text"].rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.posexplode(worded).alias("at", "s"))
    words = F.size(F.split(F.trim(F.translate("s.text", "\t\x0b\x0c\r", "    ")), " +"))
    return rows.select("doc", F.col("s.line").alias("line"), "at", words.alias("words"), F.xxhash64("s.text").alias("h1"), F.xxhash64(F.lit(1), "s.text").alias("h2"))


def _ranked(keys: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Distinct keys that occur twice or more, numbered in their order: range sort, then partition and row numbers."""
    often = keys.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return materialize(often.repartitionByRange(*cols).sortWithinPartitions(*cols).select(*cols, F.monotonically_increasing_id().alias("rank")), name)


def suffix_ranks(lines: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Per depth j a table (doc, at, rank): suffixes whose first 2^j lines occur elsewhere too; and the words of lines."""
    names = _ranked(lines, ["h1", "h2"], "line-ranks")
    first = materialize(lines.join(names, ["h1", "h2"]).select("doc", "at", "line", "words", "rank"), "suffixes-0")
    levels, now = [], first.select("doc", "at", "rank")
    while not now.isEmpty():
        levels.append(now)
        h = 1 << (len(levels) - 1)
        on = F.first("rank").over(Window.partitionBy("doc").orderBy("at").rangeBetween(h, h))
        pairs = materialize(now.select("doc", "at", F.col("rank").alias("r1"), on.alias("r2")).where("r2 IS NOT NULL"), "pairs")
        ranked = _ranked(pairs, ["r1", "r2"], "ranks")
        now = materialize(pairs.join(ranked, ["r1", "r2"]).select("doc", "at", "rank"), f"suffixes-{len(levels)}")
        release(pairs, ranked)
    release(names)
    return levels, first


def _runs(at: list[int], words: list[int], ranks: list[dict], min_words: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, lines, rank of the first 2^j, rank of the last 2^j) of each run to look up, for one document."""
    n = len(at)
    end_of = []  # the last index of the shortest run with min_words from each start, or n
    j, have, seg_end = 0, 0, 0
    for i in range(n):
        if i >= seg_end:  # lines that are unique to the corpus end a segment
            seg_end = i + 1
            while seg_end < n and at[seg_end] == at[seg_end - 1] + 1:
                seg_end += 1
            j, have = i, 0
        while have < min_words and j < seg_end:
            have += words[j]
            j += 1
        end_of.append((j - 1 if have >= min_words else n, seg_end))
        have -= words[i]
    for i, (end, seg_end) in enumerate(end_of):
        if end == n:
            continue
        stop = end_of[i + 1][0] if i + 1 < seg_end else n
        for x in range(end, max(end + 1, min(stop, seg_end))):
            size = x - i + 1
            k = size.bit_length() - 1
            if k >= len(ranks):
                break
            a, b = ranks[k].get(at[i]), ranks[k].get(at[x] - (1 << k) + 1)
            if a is None or b is None:
                break  # no longer run from here repeats either
            yield at[i], size, a, b


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line) of every line to delete, each once."""
    levels, first = suffix_ranks(sequence_lines(docs, id_col, text_col))
    depth = first.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("lines"))
    if not levels:
        return first.select("doc", "line")
    tagged = levels[0].withColumn("k", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        tagged = tagged.union(level.withColumn("k", F.lit(k)))
    per_doc = tagged.groupBy("doc").agg(F.collect_list(F.struct("k", "at", "rank")).alias("ranks"))
    n_levels = len(levels)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[tuple] = []
            docs_, lines_, ranks_ = (batch.column(c) for c in range(3))
            for r in range(batch.num_rows):
                got = lines_[r].values
                levels_: list[dict] = [{} for _ in range(n_levels)]
                flat = ranks_[r].values
                for k, at, rank in zip(flat.field("k").to_pylist(), flat.field("at").to_pylist(), flat.field("rank").to_pylist(), strict=True):
                    levels_[k][at] = rank
                d = docs_[r].as_py()
                out += [(d, *x) for x in _runs(got.field("at").to_pylist(), got.field("words").to_pylist(), levels_, min_words)]
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["doc", "at", "n", "a", "b"])

    runs = materialize(depth.join(per_doc, "doc").select("doc", "lines", "ranks").mapInArrow(run, "doc long, at long, n long, a long, b long"), "runs")
    # written, so that the join below has an exchange of its own on both sides, which AQE splits where an interval is hot
    intervals = materialize(runs.groupBy("n", "a", "b").agg(F.min(F.struct("doc", "at")).alias("low"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "intervals")
    later = runs.join(intervals, ["n", "a", "b"]).where(F.struct("doc", "at") != F.col("low"))
    gone = later.select("doc", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).distinct()
    out = materialize(gone.join(first, ["doc", "at"]).select("doc", "line"), "deleted-lines")
    release(*levels[1:], first, runs, intervals)
    return out


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text cut, and n_lines, n_deleted (with underscores after them where ``docs`` has such columns).

    A run of lines with ``min_words`` words or more that occurs before (in an earlier document, or earlier in the same
    one) is deleted, overlaps included; lines without words are never compared nor deleted. Documents stand in the order
    of their ids; rows that repeat an id are documents of their own, in an order of their texts. Null and empty texts and
    rows with a null id pass unchanged. A text whose lines all go becomes ''. Texts of any length are taken whole, an
    empty table gives no rows, and other columns are carried along, whatever their names.
    """
    own = [free_name(docs.columns, n) for n in ("row", "gone", "doc", "lines")]
    row, gone_col, doc, split_col = own
    ids = docs.select(F.col(id_col).cast("long").alias(row)).where(F.col(row).isNotNull())
    if ids.groupBy(row).count().where("count > 1").isEmpty():
        rows = docs.withColumn(row, F.col(id_col).cast("long"))
    else:  # number the rows, by id first, and keep the numbers
        order = [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))]
        numbered = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id()))
        rows = materialize(numbered, "numbered-documents")
    gone = repeated_runs(rows.select(row, text_col), min_words, row, text_col).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line").alias(gone_col))
    lines = F.col(split_col)
    # used twice, so that the split is a column of its own and not done anew for each line
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_col).cast("array<int>"))
    cut = F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))
    # a merge join at any size: what is deleted grows with the documents
    joined = rows.join(gone.hint("merge"), F.col(row) == F.col(doc), "left").withColumn(split_col, F.split(F.col(text_col), "\n"))
    n_lines, n_deleted = (free_name(docs.columns, n) for n in ("n_lines", "n_deleted"))
    joined = joined.withColumn(n_lines, F.coalesce(F.size(lines), F.lit(0))).withColumn(n_deleted, F.coalesce(F.size(gone_col), F.lit(0)))
    return joined.withColumn(text_col, cut).drop(*own)
