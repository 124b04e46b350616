"""Words as every operator here takes them: runs of bytes other than space and \\t \\n \\v \\f \\r, A-Z lower-cased."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java's \\s without Unicode classes is exactly space, \\t, \\n, \\v, \\f, \\r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of texts that a Python worker looks at together: their words take ten times as much, in each worker of an executor.
PART = 2 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column | str) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_column(c: Column | str) -> Column:
    """Array of words; null and empty texts give an empty array."""
    spaced = F.trim(F.translate(lower_ascii(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), "\t\n\x0b\x0c\r", "     "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def words(text: bytes | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII alone, which is the definition above."""
    return text.lower().split() if text else []


def shingles(ws: list[bytes], k: int) -> list[bytes]:
    """Every run of k words, repeats included; fewer words give the whole sequence, none give nothing."""
    if len(ws) <= k:
        return [b" ".join(ws)] if ws else []
    line = b" ".join(ws)
    ends = list(accumulate(len(w) + 1 for w in ws))
    return [line[a : b - 1] for a, b in zip([0, *ends[:-k]], ends[k - 1 :], strict=True)]


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """Arrow strings as bytes: no text is decoded."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def parts(batch: pa.RecordBatch, most: int = PART) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes, a row at least; no slice has no rows."""
    n = max(1, -(-batch.nbytes // most))
    step = max(1, -(-batch.num_rows // n))
    for s in range(0, batch.num_rows, step):
        yield batch.slice(s, step)


def give_back() -> None:
    """Hand freed memory of this worker back to the system: idle workers live on after their task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to be no other column's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn``: one Arrow batch to one; batches stream in parts of about PART bytes, so a task holds one at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in parts(batch):
                yield fn(part)
        give_back()

    return df.mapInArrow(run, schema)


def hash_mod(column: str, divisor: int) -> Column:
    """crc32 of a number as text, modulo ``divisor``: how documents are dealt into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)
