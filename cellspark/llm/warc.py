"""WARC archives from pages, and back, as a chunked record table.

A payload travels as rows (record, chunk number, bytes) of bounded size, both on its way into an archive and out of
it, and the SHA-1 is carried along. Python workers never hold a whole record; the page's own row in the input table is
the only place that does. Archives are gzip members, one a record.
Payloads that occur again are written once; later records are revisits that refer to the first."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import slices
from .store import new_path, stored, with_facts

CHUNK_BYTES = 1 << 20
#: An archive is closed when it has grown to this.
ARCHIVE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, header_digest string, chunk int, data binary, digest string, last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def typed(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary; null for revisits), payload_bytes, digest, record_type, refers_to: which pages repeat an earlier payload.

    Only digests that occur twice are joined back; rows with an equal payload and the smallest id are all responses."""
    html = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", html.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    repeats = stored(rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeats")
    joined = with_facts(rows, repeats, "digest", "page_id", pages.count())
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def chunked(records: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of size bytes of each record's payload, in order: chunk, last, data; an empty payload and a revisit have one.

    The payload is cut as its row passes: a task sends Python a chunk at a time."""
    last = F.greatest(F.ceil(F.coalesce(F.octet_length("payload"), F.lit(0)) / size) - 1, F.lit(0)).cast("int")
    rows = records.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    common = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "digest", "chunk")
    return rows.select(*common, (F.col("chunk") == last).alias("last"), F.substring("payload", F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def _urn(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _header(row: dict) -> bytes:
    """What stands before a record's payload."""
    n, digest = row["payload_bytes"], base32(bytes.fromhex(row["digest"]))
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {n}\r\n\r\n".encode()
    url = "".join(c for c in row["url"] or "" if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['page_id'])}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else n)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_warc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives below path, a folder all executors reach; returns the list of archives (file, records).

    Each task attempt writes files of its own; only those of attempts that succeeded are in the list. A payload is
    written chunk by chunk, and its SHA-1, carried from chunk to chunk, must end as the digest in its header."""

    def run(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        sink, name, count, files, member, sha = None, None, 0, [], None, None
        for batch in batches:
            for part in slices(batch, "data"):
                for row in part.to_pylist():
                    if sink is None:
                        name, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        sink = system.open_output_stream(name)
                    if not row["chunk"]:
                        member, sha = zlib.compressobj(1, wbits=31), hashlib.sha1()
                        sink.write(member.compress(_header(row)))
                    data = row["data"] or b""
                    sha.update(data)
                    sink.write(member.compress(data))
                    if row["last"]:
                        if row["record_type"] == "response" and sha.hexdigest() != row["digest"]:
                            raise ValueError(f"page {row['page_id']}: the chunks are not the payload")
                        sink.write(member.compress(b"\r\n\r\n") + member.flush())
                        count += 1
                        if sink.tell() >= archive_bytes:
                            sink.close()
                            files.append((name, count))
                            sink = None
        if sink is not None:
            sink.close()
            files.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([n for _, n in files], pa.int64())], ["file", "records"])

    return stored(chunked(typed(pages), chunk_bytes).mapInArrow(run, "file string, records long"), "archives")


def _records(stream, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of CHUNKS from an archive, reading a chunk at a time."""
    while first := stream.readline():
        if first.strip() == b"":
            continue
        headers = {}
        while line := stream.readline().strip():
            key, _, value = line.partition(b": ")
            headers[key.lower()] = value.decode("utf-8", "replace")
        rest = int(headers[b"content-length"])
        while rest and (line := stream.readline()):  # the HTTP header
            rest -= len(line)
            if not line.strip():
                break
        number = lambda v: int(v[len("<urn:x-page:") : -1]) if v and v != "<urn:x-page:>" else None
        told = headers.get(b"warc-payload-digest", "").removeprefix("sha1:")
        revisit = headers[b"warc-type"] == "revisit"
        common = (number(headers[b"warc-record-id"]), headers.get(b"warc-target-uri"), headers[b"warc-type"], number(headers.get(b"warc-refers-to")), int(headers[b"x-payload-length"]), told)
        sha, k = hashlib.sha1(), 0
        while rest or not k:
            data = stream.read(min(rest, chunk_bytes))
            if rest and not data:
                raise EOFError("an archive ends within a record")
            rest -= len(data)
            sha.update(data)
            yield (*common, k, data, told if revisit else base32(sha.digest()), not rest)
            k += 1


def read_warc(spark: SparkSession, archives: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table (CHUNKS) of archives written by write_warc(); digest is that of the payload up to the chunk's end."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for name in batch.column("file").to_pylist():
                system, _ = fs.FileSystem.from_uri(name if "://" in name else f"file://{name}")
                rows, size = [], 0
                with system.open_input_stream(name) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in _records(stream, chunk_bytes):
                        rows.append(row)
                        size += len(row[7])
                        if size >= 4 * chunk_bytes or len(rows) >= 2000:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    # an archive is read by one task: as many partitions as archives
    files = archives.select("file")
    return files.repartition(max(1, files.count()), "file").mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.bool_())
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from archives written and read back.

    Null html is an empty payload; pages without id are written without one and are revisits where others share their
    payload; rows that repeat the smallest id of a payload are all responses; other columns are ignored."""
    spark = pages.sparkSession
    archives = write_warc(pages, new_path(spark, "warc"))
    rows = read_warc(spark, archives).where("last")
    wrong = F.col("digest") != F.col("header_digest")
    return rows.select("page_id", "payload_bytes", F.when(wrong, F.raise_error(F.lit("a payload differs from its digest"))).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")
