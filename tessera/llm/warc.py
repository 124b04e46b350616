"""WARC archives from and to a chunked record table.

The table has a row for each chunk of a payload: record id, chunk number, bytes. Payloads are hashed, written and read
chunk by chunk, so no task holds a whole record: a record of any size passes through buffers of one chunk. Archives are
gzip members, one for each record, in files that each writing task names for itself; only files in the manifest that
Spark's own commit makes visible are read back, so files of lost or repeated task attempts are never seen.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.stage import fresh_path, materialize, release

CHUNK = 1 << 20
MIN_REVISIT = 100
MANIFEST = "path string, records long"


def chunk_table(records: DataFrame, id_col: str, payload_col: str, chunk: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """record_id, chunk_no, n_chunks, data, in order within a record. A null or empty payload is one empty chunk."""
    data = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = records.select(F.col(id_col).cast("long").alias("record_id"), *keep, data.alias("payload"))
    n = F.greatest(F.lit(1), F.ceil(F.length("payload") / chunk)).cast("int")
    # numbers are exploded, not chunks: a row's chunks are cut one after the other and never stand together
    numbered = rows.select("record_id", *keep, "payload", n.alias("n_chunks"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return numbered.select("record_id", *keep, "n_chunks", "chunk_no", F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"))


def digests(chunks: DataFrame) -> DataFrame:
    """record_id, payload_bytes, payload_digest; the chunks of a record stand together and in order in a partition."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = hashlib.sha256(), 0
        for batch in it:
            out = []
            for rid, no, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if no == 0:
                    state, size = hashlib.sha256(), 0
                piece = data.as_buffer()
                state.update(piece)
                size += len(piece)
                if no == n - 1:
                    out.append((rid, size, state.hexdigest()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["record_id", "payload_bytes", "payload_digest"])

    return chunks.select("record_id", "chunk_no", "n_chunks", "data").mapInArrow(run, "record_id long, payload_bytes long, payload_digest string")


def plan_records(digested: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Adds record_type and refers_to: among equal payloads of min_revisit bytes or more, the smallest record is the response."""
    firsts = digested.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("record_id").alias("low"))
    joined = digested.join(firsts, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_revisit) & (F.col("record_id") != F.col("low"))
    return joined.select("record_id", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("low")).alias("refers_to"))


def _uri(record_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=record_id & (1 << 64) - 1)}>"


def _record_id(uri: str) -> int:
    n = uuid.UUID(uri[10:-1]).int
    return n - (1 << 64) if n >> 63 else n


def _head(rid: int, kind: str, url: str | None, size: int, digest: str, refers: int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(rid)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers is not None:
        lines += [f"WARC-Refers-To: {_uri(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {0 if kind == 'revisit' else size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(chunks: DataFrame, planned: DataFrame, url_col: str | None = None, records_per_file: int = 20_000) -> DataFrame:
    """Write records as .warc.gz files below the shared folder; returns the manifest (path, records).

    Payloads are shuffled once, to bring chunks to their record's plan. Files hold about ``records_per_file`` records.
    """
    spark = chunks.sparkSession
    base = fresh_path(spark, "warc")
    urls = [F.col(url_col).alias("url")] if url_col else [F.lit(None).cast("string").alias("url")]
    # a revisit carries no payload, so its chunks need not move
    slim = chunks.select("record_id", *urls, "chunk_no", "n_chunks", "data")
    joined = slim.join(planned, "record_id").where("record_type = 'response' OR chunk_no = 0")
    joined = joined.withColumn("data", F.when(F.col("record_type") == "response", F.col("data")).otherwise(F.lit(b"")))
    ordered = joined.sortWithinPartitions("record_id", "chunk_no").select("record_id", "chunk_no", "n_chunks", "data", "url", "record_type", "payload_bytes", "payload_digest", "refers_to")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        done, out, path, n, zipped = [], None, "", 0, None
        for batch in it:
            cols = [batch.column(c) for c in range(9)]
            for r in range(batch.num_rows):
                rid, no, last = cols[0][r].as_py(), cols[1][r].as_py(), cols[2][r].as_py()
                kind = cols[5][r].as_py()
                if no == 0:
                    if out is not None and n >= records_per_file:
                        out.close()
                        done.append((path, n))
                        out = None
                    if out is None:
                        path, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(path, compression=None)
                    zipped = zlib.compressobj(3, zlib.DEFLATED, 31)
                    out.write(zipped.compress(_head(rid, kind, cols[4][r].as_py(), cols[6][r].as_py(), cols[7][r].as_py(), cols[8][r].as_py())))
                    n += 1
                if kind == "response":
                    out.write(zipped.compress(cols[3][r].as_buffer()))
                if no == last - 1 or kind == "revisit":
                    out.write(zipped.compress(b"\r\n\r\n") + zipped.flush())
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records"])

    manifest = materialize(ordered.mapInArrow(run, MANIFEST), "warc-manifest")
    scheme = base.split(":", 1)[0] if ":" in base else ""
    return manifest.withColumn("scheme", F.lit(scheme))


class _Members:
    """Inflates a file of gzip members; hands out lines and bounded pieces."""

    def __init__(self, raw, step: int) -> None:
        self.raw, self.step, self.buf, self.z, self.rest = raw, step, bytearray(), None, b""

    def _more(self) -> bool:
        if not self.rest:
            self.rest = self.raw.read(self.step)
            if not self.rest:
                return False
        if self.z is None:
            self.z = zlib.decompressobj(31)
        self.buf += self.z.decompress(self.rest, self.step)
        self.rest = self.z.unconsumed_tail
        if self.z.eof:
            self.rest, self.z = self.z.unused_data, None
        return True

    def line(self) -> bytes | None:
        while (at := self.buf.find(b"\r\n")) < 0:
            if not self._more():
                return None
        got = bytes(self.buf[:at])
        del self.buf[: at + 2]
        return got

    def piece(self, most: int) -> bytes:
        while len(self.buf) < most and self._more():
            pass
        got = bytes(self.buf[:most])
        del self.buf[:most]
        return got


def read_chunks(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The archives as a chunked record table again: record_id, record_type, refers_to, declared digest, url, chunks."""
    schema = "record_id long, chunk_no int, n_chunks int, data binary, record_type string, refers_to long, declared string, url string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("record_id", pa.int64()), ("chunk_no", pa.int32()), ("n_chunks", pa.int32()), ("data", pa.binary()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared", pa.string()), ("url", pa.string())]

        def flush(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

        for batch in it:
            for path, scheme in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, root = pafs.FileSystem.from_uri(f"{scheme}://{path}" if scheme else path)
                rows, held = [], 0
                with fs.open_input_stream(root, compression=None) as raw:
                    src = _Members(raw, 1 << 18)
                    while (first := src.line()) is not None:
                        if first != b"WARC/1.1":
                            raise ValueError(f"{path}: no record where one is due")
                        head = {}
                        while line := src.line():
                            k, _, v = line.decode().partition(": ")
                            head[k] = v
                        size = int(head["Content-Length"])
                        n = max(1, -(-size // chunk))
                        rid, refers = _record_id(head["WARC-Record-ID"]), head.get("WARC-Refers-To")
                        for no in range(n):
                            data = src.piece(min(chunk, size - no * chunk))
                            rows.append((rid, no, n, data, head["WARC-Type"], _record_id(refers) if refers else None, head["WARC-Payload-Digest"].removeprefix("sha256:"), head.get("WARC-Target-URI")))
                            held += len(data)
                            if held >= 4 << 20:
                                yield flush(rows)
                                rows, held = [], 0
                        if src.piece(4) != b"\r\n\r\n":
                            raise ValueError(f"{path}: a record has no end")
                if rows:
                    yield flush(rows)

    # a file is a unit of work: deal files out evenly
    return manifest.select("path", "scheme").repartition(max(1, manifest.count())).mapInArrow(run, schema)


def archive(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", chunk: int = CHUNK) -> DataFrame:
    """Write a record for each row, then report what the archives hold: one row for each record, so one for each row.

    Records are numbered by the page id. Where ids repeat or are null, rows are numbered in the order of their ids instead
    (nulls last, rows of one id in an order of their payloads), and the numbered table is kept for the second reading; each
    such row has its own record. Of equal payloads the least number is the response: ties go to the smallest id. Null and
    empty payloads are empty records; payloads of any size pass in chunks. An empty table gives no rows; other columns are
    not read, whatever their names. ValueError: a payload read back does not have its declared digest.
    """
    url = [F.col(url_col).cast("string").alias("url")] if url_col else []
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(payload_col).cast("string").alias("payload"), *url)
    keep = ("url",) if url_col else ()
    odd = rows.groupBy("page").count().where("page IS NULL OR count > 1")
    if odd.isEmpty():
        named = None
        rows = rows.withColumn("record", F.col("page"))
    else:
        order = [F.col("page").asc_nulls_last(), F.xxhash64("payload")]
        named = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("record", F.monotonically_increasing_id()), "numbered-pages")
        rows = named
    chunks = chunk_table(rows, "record", "payload", chunk, keep)
    planned = materialize(plan_records(digests(chunks)), "warc-plan")
    manifest = write_archives(chunks, planned, "url" if url_col else None)
    back = read_chunks(manifest, chunk)
    sums = digests(back)
    heads = back.where("chunk_no = 0").select("record_id", "record_type", "refers_to", "declared")
    found = materialize(heads.join(sums, "record_id"), "warc-read")
    bad = found.where("record_type = 'response' AND declared <> payload_digest").limit(1).count()
    if bad:
        raise ValueError("a payload does not have its declared digest")
    responses = found.where("record_type = 'response'").select(F.col("record_id").alias("rid"), F.col("payload_bytes").alias("of_response"))
    out = found.join(responses, found.refers_to == responses.rid, "left").select(
        "record_id", F.coalesce("of_response", "payload_bytes").alias("payload_bytes"),
        F.col("declared").alias("payload_digest"), "record_type", "refers_to",
    )
    release(planned)
    if named is None:
        return out.withColumnRenamed("record_id", id_col)
    ids = named.select(F.col("record").alias("record_id"), F.col("page").alias(id_col))
    of = named.select(F.col("record").alias("refers_to"), F.col("page").alias("of"))
    return out.join(ids, "record_id").join(of, "refers_to", "left").select(id_col, "payload_bytes", "payload_digest", "record_type", F.col("of").alias("refers_to"))
