"""WARC archives of pages, written and read by Spark's own readers and writers.

Writing: the parts of a record (its header, the HTTP header, the payload) are rows of a text file whose
line separator is the blank line that the format puts after each part anyway. Archives are
compressed, so each is read by one task, from its first byte to its last.

Reading: the archive arrives as a stream of short pieces (the reader's separator is ``>``, which no
page lacks for long; joined again, the pieces are the bytes of the file). A reader in the Python
worker follows the lengths in the headers and hands out each payload as rows of (record, chunk
number, data) of a bounded size, with the SHA-1 of all bytes up to the chunk's end. A record is
never held as a whole, nor is a file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import fresh_path
from .common import stage

BLANK = "\r\n\r\n"
PIECE = ">"
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 1 << 24
REVISIT_BYTES = 1000
RECORDS_IN_FILE = 50_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8"
ID = "urn:page:"

CHUNKS = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("header_digest", pa.string()), ("chunk_no", pa.int64()), ("at", pa.int64()), ("n_bytes", pa.int64()),
    ("data", pa.binary()), ("digest", pa.string()), ("last", pa.bool_()),
])
CHUNKS_SQL = (
    "record_id string, record_type string, target_uri string, refers_to string, header_digest string, chunk_no bigint,"
    " at bigint, n_bytes bigint, data binary, digest string, last boolean"
)


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """``pages`` as (page_id, url, payload, digest, n_bytes, refers_to): equal payloads refer to that with the largest id."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "n_bytes": F.octet_length("payload").cast("bigint")})
    long = rows.filter(F.col("n_bytes") >= least_bytes)
    copies = stage(
        long.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n"))
        .filter("n > 1 AND kept_id IS NOT NULL").drop("n"), "copies",
    )
    joined = rows.join(copies, ["digest", "n_bytes"], "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("kept_id")), None).otherwise(F.col("kept_id"))
    return joined.select("page_id", "url", "payload", "digest", "n_bytes", refers.alias("refers_to"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = REVISIT_BYTES
) -> None:
    """Write a record per row to compressed archives at ``path``; one archive per task, or more if it has many records.

    A payload of at least ``least_bytes`` that another row has too is written once, by the row with the largest
    id (all rows with that id, if ids repeat); the others become revisit records. A null payload is an empty one. A
    null id gives a record without a number, a null url the record's own name as target. Control characters
    and spaces in a url are percent-encoded.
    """
    rows = with_revisits(pages, id_col, payload_col, least_bytes)
    name = F.concat(F.lit(ID), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    revisit = F.col("refers_to").isNotNull()
    http = len(HTTP) + len(BLANK)
    length = F.when(revisit, F.lit(http)).otherwise(F.col("n_bytes") + http)
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <"), name, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.coalesce(url, name),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest",
        F.when(revisit, F.concat(
            F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{ID}"), F.col("refers_to").cast("string"), F.lit(">"),
        )).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"),
    )
    payload = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    parts = rows.select(F.explode(F.array(header, F.lit(HTTP), payload)).alias("value"))
    parts.write.option("lineSep", BLANK).option("compression", "gzip").option("maxRecordsPerFile", 3 * RECORDS_IN_FILE).text(path)


class ArchiveReader:
    """Follows one archive as its bytes come in; :meth:`feed` returns the chunk rows that got complete."""

    def __init__(self, path: str, chunk_bytes: int, with_data: bool):
        self.path, self.chunk_bytes, self.with_data = path, chunk_bytes, with_data
        self.held = bytearray()
        self.state = "header"
        self.left = 0

    def feed(self, data: bytes) -> list[tuple]:
        rows: list[tuple] = []
        view, at = memoryview(data), 0
        while at < len(view):
            if self.state == "payload":
                n = min(len(view) - at, self.left, self.chunk_bytes - self.filled)
                self._take(view[at : at + n])
                at += n
                if not self.left:
                    rows.append(self._chunk(True))
                    self.state = "tail"
                elif self.filled == self.chunk_bytes:
                    rows.append(self._chunk(False))
                continue
            size = len(self.held)
            self.held += view[at:]
            at = len(view)
            end = 0 if self.state == "tail" and size + len(view) < 4 else self.held.find(BLANK.encode())
            if self.state == "tail":
                if len(self.held) < 4:
                    continue
                if self.held[:4] != BLANK.encode():
                    raise ValueError(f"{self.path}: no blank line after {self.record[0]}")
                rest = bytes(self.held[4:])
                self.state = "header"
            elif end < 0:
                continue
            else:
                head, rest = bytes(self.held[:end]).decode(), bytes(self.held[end + 4 :])
                rows += self._begin(head)
            self.held.clear()
            if rest:
                view, at = memoryview(rest), 0
        return rows

    def _begin(self, head: str) -> list[tuple]:
        if self.state == "header":
            first, *lines = head.split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"{self.path}: not a record: {first[:40]!r}")
            fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            self.left = int(fields["content-length"])
            self.record = (
                fields["warc-record-id"].strip("<>"), fields["warc-type"], fields.get("warc-target-uri"),
                fields.get("warc-refers-to", "").strip("<>") or None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            )
            self.state = "http"
            return []
        self.left -= len(head.encode()) + 4
        self.number = self.start = self.filled = 0
        self.sum, self.parts = hashlib.sha1(), []
        if self.left:
            self.state = "payload"
            return []
        self.state = "tail"
        return [self._chunk(True)]

    def _take(self, data: memoryview) -> None:
        self.sum.update(data)
        if self.with_data:
            self.parts.append(bytes(data))
        self.filled += len(data)
        self.left -= len(data)

    def _chunk(self, last: bool) -> tuple:
        data = b"".join(self.parts) if self.with_data else None
        row = (*self.record, self.number, self.start, self.filled, data, self.sum.hexdigest(), last)
        self.number, self.start, self.filled, self.parts = self.number + 1, self.start + self.filled, 0, []
        return row

    def close(self) -> None:
        if self.state != "header" or self.held.strip():
            raise ValueError(f"{self.path}: the archive ends within a record")


def _read(chunk_bytes: int, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        rows: list[tuple] = []
        for batch in batches:
            paths = batch.column(0).to_pylist()
            pieces = batch.column(1).to_pylist()
            start = 0
            while start < len(paths):
                end = len(paths) if paths[-1] == paths[start] else next(i for i in range(start, len(paths)) if paths[i] != paths[start])
                joined = PIECE.encode().join(pieces[start:end])
                if reader is None or reader.path != paths[start]:
                    if reader is not None:
                        reader.close()
                    reader = ArchiveReader(paths[start], chunk_bytes, with_data)
                else:
                    joined = PIECE.encode() + joined
                rows += reader.feed(joined)
                start = end
            while rows:
                n = max(1, BATCH_BYTES // chunk_bytes) if with_data else len(rows)
                part, rows = rows[:n], rows[n:]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), CHUNKS)], schema=CHUNKS)
        if reader is not None:
            reader.close()

    return run


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The payloads of archives as rows of (record_id, ..., chunk_no, at, n_bytes, data, digest, last).

    ``digest`` is the SHA-1 of the payload up to the end of the chunk; in the last chunk it is that of the
    whole payload. An empty payload is one empty chunk. A revisit record has an empty payload; its ``refers_to`` and
    ``header_digest`` tell what it stands for. Archives that end within a record, or whose records do not fit their
    lengths, are an error.
    """
    pieces = spark.read.option("lineSep", PIECE).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value")
    )
    return pieces.mapInArrow(_read(chunk_bytes, with_data), CHUNKS_SQL)


def read_records(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives.

    Both the size and the digest are of the full payload: those of a response are computed from its chunks, a
    revisit takes the size from the response that it refers to.
    """
    number = lambda c: F.regexp_extract(c, f"^{ID}(-?[0-9]+)$", 1).try_cast("bigint")
    last = read_chunks(spark, path, chunk_bytes, with_data=False).filter("last")
    records = stage(last.select(
        number("record_id").alias("page_id"), F.col("target_uri").alias("url"), "record_type", number("refers_to").alias("refers_to"),
        (F.col("at") + F.col("n_bytes")).alias("own_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("header_digest")).otherwise(F.col("digest")).alias("payload_digest"),
    ), "records")
    full = records.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("own_bytes").alias("full_bytes")
    ).distinct()
    revisits = records.filter("record_type = 'revisit'").join(full, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.filter("record_type = 'response'").withColumnRenamed("own_bytes", "payload_bytes").select(*columns).union(
        revisits.withColumnRenamed("full_bytes", "payload_bytes").select(*columns)
    )


def archive_and_read(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Write a WARC record per row of ``pages`` to the workspace, then read the archives back.

    Returns what :func:`read_records` does. Nulls as in :func:`write_archives`; repeated rows give repeated
    records; an empty table gives no record; other columns are not read.
    """
    path = fresh_path(pages.sparkSession, "archives")
    write_archives(pages, path, id_col, payload_col)
    return read_records(pages.sparkSession, path)
