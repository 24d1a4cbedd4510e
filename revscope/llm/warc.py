"""WARC archives written and read as chunked record tables.

Writing: every payload is cut into chunks of bounded size; a chunk is a row
(record identifier, chunk number) that carries the digest of the payload up to
its end, so the last chunk has the payload's digest and nothing ever holds a
payload and its record at once. Rows with equal digests elect the response,
the others become revisits without a payload. Each chunk row is then one WARC
1.1 record: a payload of several chunks is a segmented record (first segment
and continuations), and whole archives are gzipped text files, so a plain text
sink of Spark writes them.

Reading: an archive is a stream of lines. One pass with a fixed-size state
follows Content-Length from record to record, feeds the digest piece by piece
and checks it against the header. Lines of a payload longer than a chunk do
not exist, as chunks bound them. Revisits find their response by record id.

Defined cases: null payload counts as empty; a row that repeats another's id
and payload is a revisit of it; null ids order last; header values have line
ends replaced by a space; extra columns are ignored; an empty table gives an
empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.llm.common import shuffle_partitions, stored
from revscope.session import scratch_path, table_path

#: Characters of a payload in one chunk.
CHUNK_CHARS = 1 << 18
WARC_DATE = "2024-01-01T00:00:00Z"
_HEAD = "WARC/1.1\r\n"
_CHUNKS = "row_key long, page_id long, url string, chunk_no int, last boolean, chunk string, chunk_bytes long, payload_bytes long, digest string"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def chunk_table(pages: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Payloads (row_key, page_id, url, payload) as chunk rows.

    ``payload_bytes`` and ``digest`` (SHA-1, base32) cover the payload up to
    the end of the chunk.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            waiting = 0
            for i in range(batch.num_rows):
                key, page, url = (batch.column(c)[i].as_py() for c in ("row_key", "page_id", "url"))
                payload = batch.column("payload")[i].as_py() or ""
                sha, size = hashlib.sha1(), 0
                for no, at in enumerate(range(0, max(1, len(payload)), chunk_chars)):
                    chunk = payload[at:at + chunk_chars]
                    raw = chunk.encode("utf-8")
                    sha.update(raw)
                    size += len(raw)
                    rows.append((key, page, url, no, at + chunk_chars >= len(payload), chunk, len(raw), size, _base32(sha.digest())))
                    waiting += len(raw)
                    if waiting >= 4 << 20:
                        yield _rows(rows)
                        rows, waiting = [], 0
            if rows:
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in _CHUNKS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return pages.mapInArrow(cut, _CHUNKS)


def _record_id(row_key: Column) -> Column:
    h = F.md5(F.concat(F.lit("record:"), row_key.cast("string")))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4),
                    F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_revisit_bytes: int = 0, chunk_chars: int = CHUNK_CHARS) -> None:
    """Write one record for every row to a folder of gzipped WARC files.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the
    one with the smallest id is the response, the others revisit it.
    """
    spark = pages.sparkSession
    # a row's number is fixed by storing it: later stages may run again
    chunks = stored(chunk_table(pages.select(
        F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload")), chunk_chars), "chunks")
    ends = chunks.filter("last").select("row_key", "page_id", "url", "digest", "payload_bytes")
    first = (ends.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest")
             .agg(F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "row_key", "url")).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("digest", F.col("first.row_key").alias("response_key"), F.col("first.url").alias("response_url")))
    kinds = (ends.join(first, "digest", "left")
             .select("row_key", F.col("digest").alias("payload_digest"), F.col("payload_bytes").alias("total_bytes"),
                     F.when(F.col("response_key") != F.col("row_key"), F.col("response_key")).alias("refers_key"), "response_url"))

    files = shuffle_partitions(spark)
    rows = (chunks.repartition(files, "row_key").join(kinds, "row_key")
            .filter("refers_key IS NULL OR chunk_no = 0").sortWithinPartitions("row_key", "chunk_no"))
    clean = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    revisit, later, whole = F.col("refers_key").isNotNull(), F.col("chunk_no") > 0, F.col("last") & (F.col("chunk_no") == 0)
    kind = F.when(revisit, F.lit("revisit")).when(later, F.lit("continuation")).otherwise(F.lit("response"))
    own_id = F.when(later, F.concat(_record_id(F.col("row_key")), F.lit("-"), F.col("chunk_no").cast("string"))).otherwise(_record_id(F.col("row_key")))
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    segment = F.when(~revisit & ~whole, (F.col("chunk_no") + 1).cast("string"))
    record = F.concat(
        F.lit(_HEAD), _line("WARC-Type", kind), _line("WARC-Record-ID", angle(own_id)), _line("WARC-Date", F.lit(WARC_DATE)),
        _line("WARC-Target-URI", F.when(~later, clean(F.col("url")))),
        _line("WARC-Payload-Digest", F.when(~later, F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        _line("WARC-Refers-To", angle(_record_id(F.col("refers_key")))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, clean(F.col("response_url")))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Segment-Number", segment),
        _line("WARC-Segment-Origin-ID", F.when(later, angle(_record_id(F.col("row_key"))))),
        _line("WARC-Segment-Total-Length", F.when(later & F.col("last"), F.col("total_bytes").cast("string"))),
        _line("X-Page-ID", F.when(~later, F.col("page_id").cast("string"))),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("chunk_bytes").cast("string"))),
        F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("chunk")), F.lit("\r\n\r"))  # the sink ends it with \n
    rows.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


_RECORD = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_id string, intact boolean"


class _Reader:
    """Follows a stream of lines from record to record; ``done`` gathers finished ones."""

    def __init__(self) -> None:
        self.done: list[tuple] = []
        self.open: tuple | None = None  # a segmented record that may go on: its row without size, digest
        self.sha, self.size = hashlib.sha1(), 0
        self.head: dict[str, str] | None = None
        self.left = -1  # bytes of the block to come; -1: in a header, or between records
        self.tail = 0  # line ends to come after a block

    def feed(self, line: bytes) -> None:
        """One line with its line feed."""
        if self.left >= 0:
            taken = line[:self.left]
            self.sha.update(taken)
            self.size += len(taken)
            self.left -= len(taken)
            rest = line[len(taken):]
            if self.left == 0 and rest:
                self._block_over(rest)
            return
        if self.tail:
            self.tail -= 1
            return
        text = line.decode("utf-8").rstrip("\r\n")
        if self.head is None:
            if text.startswith("WARC/"):
                self.head = {}
            elif text:
                raise ValueError(f"not a WARC record: {text[:80]!r}")
            return
        if text:
            name, _, value = text.partition(":")
            self.head[name.strip().lower()] = value.strip()
            return
        if self.head["warc-type"] != "continuation":
            self.flush()
            self.sha, self.size = hashlib.sha1(), 0
        self.left = int(self.head["content-length"])

    def _block_over(self, rest: bytes) -> None:
        # after the block come two line ends, the first in this very line
        if rest.strip(b"\r\n"):
            raise ValueError("a record is longer than its Content-Length")
        self.left, self.tail = -1, 1
        head, self.head = self.head, None
        bare = lambda s: s.strip("<>") if s else None
        if head["warc-type"] != "continuation":
            page = head.get("x-page-id")
            self.open = (bare(head["warc-record-id"]), head["warc-type"], int(page) if page else None, head.get("warc-target-uri"),
                         head.get("warc-payload-digest", "").removeprefix("sha1:") or None, bare(head.get("warc-refers-to")))
        elif not self.open or bare(head.get("warc-segment-origin-id")) != self.open[0]:
            raise ValueError("a continuation without its record")

    def flush(self) -> None:
        if self.open:
            ident, kind, page, url, said, refers = self.open
            digest = _base32(self.sha.digest())
            self.done.append((ident, kind, page, url, said or digest, self.size, refers, kind == "revisit" or said in (None, digest)))
            self.open = None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in a folder, segments joined."""
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            for value in batch.column("value"):
                reader.feed(value.as_py() + b"\n")
            if reader.done:
                yield out(reader.done)
                reader.done = []
        reader.flush()
        if reader.done:
            yield out(reader.done)

    # gzipped files are never split, so that a task sees whole archives, line by line
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(parse, _RECORD)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per record: payload size and digest of the full payload, and the page a revisit refers to."""
    target = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    return records.join(target, "refers_id", "left").select(
        "page_id", F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "intact")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    write_archive(spark.read.parquet(table_path(sf_dir, "pages")), path)
    return resolve_revisits(stored(read_records(spark, path), "records")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH raw AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
digested AS (
  SELECT page_id, payload_bytes, hex,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest
  FROM raw),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id) AS turn, first_value(page_id) OVER (PARTITION BY hex ORDER BY page_id) AS response FROM digested)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN turn > 1 THEN response END AS refers_to
FROM ranked
"""
