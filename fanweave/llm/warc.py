"""WARC archives as a chunked record table.

An archive is a table of rows (record_id, chunk_no, n_chunks, data, running_digest). Putting the
``data`` of a record's rows together in chunk order gives its WARC/1.1 record, so the ``data`` of a
whole part file is a valid WARC file. A payload is cut in the JVM into chunks of ``chunk_bytes``;
writer and reader see one chunk at a time, carry the SHA-256 on from chunk to chunk, and never
build a whole record. Records of one chunk are read where they lie; only the chunks of oversized
records are shuffled by record and put in order.

Defined results: null payload is the empty payload; a null id stays null, sorts after every other
id and is written without an id field; rows that share both the payload and the smallest id are
all responses; a null URL is written as ``about:blank``; line ends inside a URL are percent-coded.
A record whose bytes do not match its digest, length or running digests raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.llm.common import materialize, scratch_path

CHUNK_BYTES = 64 * 1024
MIN_REVISIT_BYTES = 100
BROADCAST_REPEATS = 100_000          # digests that repeat, of some 100 bytes each, sent to all tasks

ARCHIVE = "record_id long, chunk_no int, n_chunks int, data binary, running_digest string"
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long")
END = b"\r\n\r\n"


def _header(page_id, url, kind, refers, digest, size) -> bytes:
    """WARC header (and, for a response, the HTTP header that opens its block)."""
    http = b"" if kind == "revisit" else (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}"
        "\r\n\r\n").encode()
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {target}",
             "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        lines.insert(2, f"WARC-Record-ID: <urn:page:{page_id}>")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers}>", "Content-Length: 0"]
    else:
        lines.append(f"Content-Length: {len(http) + size}")
    return "\r\n".join(lines).encode() + END + http


def _write_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive row per incoming chunk row; the hash lives on from chunk to chunk."""
    running = hashlib.sha256()
    for b in batches:
        ids, nos, counts, chunks, running_col = [], [], [], [], []
        cols = [b.column(n).to_pylist() for n in
                ("record_id", "chunk_no", "n_chunks", "page_id", "url", "kind", "refers",
                 "digest", "size", "chunk")]
        for rec, no, count, page, url, kind, refers, digest, size, chunk in zip(*cols):
            if no == 0:
                running = hashlib.sha256()
            running.update(chunk)
            head = _header(page, url, kind, refers, digest, size) if no == 0 else b""
            ids.append(rec)
            nos.append(no)
            counts.append(count)
            chunks.append(b"".join((head, chunk, END if no == count - 1 else b"")))
            running_col.append(running.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(counts, pa.int32()),
             pa.array(chunks, pa.binary()), pa.array(running_col, pa.string())],
            names=["record_id", "chunk_no", "n_chunks", "data", "running_digest"])


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES,
                  min_revisit_bytes: int = MIN_REVISIT_BYTES,
                  broadcast_repeats: int = BROADCAST_REPEATS) -> None:
    """Write one WARC record per row of ``pages`` into the archive table at ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = (rows.withColumn("size", F.octet_length("payload").cast("long"))
            .withColumn("digest", F.sha2("payload", 256)))
    # Pre-aggregated before the shuffle; only payloads that repeat come back, as small rows.
    firsts = (rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
              .where("copies > 1").select("digest", "first_id"))
    firsts = materialize(firsts, "repeated_payloads")
    small = firsts.count() <= broadcast_repeats
    rows = rows.join(F.broadcast(firsts) if small else firsts.hint("merge"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("record_id"), "page_id", "url", "digest", "size",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first_id")).alias("refers"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / F.lit(chunk_bytes))).cast("int")
    # Chunk numbers are multiplied out first and the bytes cut per number: one chunk at a time.
    rows = rows.withColumn("n_chunks", n).withColumn(
        "chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    rows = rows.select("record_id", "page_id", "url", "digest", "size", "kind", "refers", "n_chunks",
                       "chunk_no", F.substring("payload", F.col("chunk_no") * chunk_bytes + 1,
                                               F.lit(chunk_bytes)).alias("chunk"))
    rows.mapInArrow(_write_chunks, ARCHIVE).write.parquet(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    return dict(line.split(": ", 1) for line in lines[1:])


def _page_of(urn: str | None) -> int | None:
    return None if urn is None else int(urn.removeprefix("<urn:page:").removesuffix(">"))


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse records from chunk rows that come in (record, chunk) order."""
    rec = fields = None
    hashed, left, expect = hashlib.sha256(), 0, 0
    for b in batches:
        out = []
        cols = [b.column(n).to_pylist() for n in
                ("record_id", "chunk_no", "n_chunks", "data", "running_digest")]
        for record_id, no, count, data, running in zip(*cols):
            if no == 0:
                head, _, body = data.partition(END)
                fields, rec, expect = _fields(head), record_id, 0
                left = int(fields["Content-Length"])
                if fields["WARC-Type"] == "response":
                    http, _, rest = body.partition(END)
                    left -= len(http) + len(END)
                    body = rest
                hashed = hashlib.sha256()
            else:
                body = data
            if record_id != rec or no != expect:
                raise ValueError(f"record {record_id}: chunk {no} where {expect} was due")
            expect += 1
            body = memoryview(body)[:left]
            left -= len(body)
            hashed.update(body)
            if hashed.hexdigest() != running:
                raise ValueError(f"record {record_id}: chunk {no} does not match its digest")
            if no == count - 1:
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"][7:]
                if left or (kind == "response" and hashed.hexdigest() != digest):
                    raise ValueError(f"record {record_id}: payload does not match its header")
                out.append((_page_of(fields.get("WARC-Record-ID")), int(fields["X-Payload-Length"]),
                            digest, kind, _page_of(fields.get("WARC-Refers-To"))))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)


def read_archive(spark, path: str) -> DataFrame:
    """One row per record of the archive table at ``path``, every payload verified."""
    rows = spark.read.schema(ARCHIVE).parquet(path)
    whole = rows.where("n_chunks = 1")
    cut = rows.where("n_chunks > 1").repartition("record_id").sortWithinPartitions(
        "record_id", "chunk_no")
    return whole.mapInArrow(_read_chunks, RECORDS).unionByName(cut.mapInArrow(_read_chunks, RECORDS))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh archive in the shared folder and read it back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark, path)
