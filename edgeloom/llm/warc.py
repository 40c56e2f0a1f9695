"""WARC archives written and read as a table of chunks.

Payloads are tables of chunks, rows (record id, chunk number), both ways. The writer takes them one by one into a gzip member, as WARC asks for, and carries a
digest that must be the declared one at the end; the reader gives each with the digest of the payload up to its end. So Python never holds a record's payload
as a whole. Archives go to the folder that all executors share; a file gets its name only when it is complete, and only
files that a finished task reports are read, so tasks can be lost and run again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, remember, shared_folder, stored

#: Payload bytes of a chunk.
CHUNK = 1 << 20
#: An archive is closed when it has so many bytes, so that a reader's task stays small.
ARCHIVE = 256 << 20
#: Digests that occur more than once are broadcast up to this number (about 100 bytes each), else joined by a shuffle.
MOST_BROADCAST = 100_000
SALTS = 32
LINE = 1 << 16

CHUNKS = (
    "record_id string, chunk_no int, offset long, data binary, digest_so_far string, is_last boolean, record_type string, "
    "refers_to string, target_uri string, payload_bytes long, declared_digest string, archive string"
)


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _uri_safe(text: str) -> str:
    """A header's value: without what would end its line."""
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) if b < 127 else f"%{b:02X}" for b in text.encode("utf-8", "surrogatepass"))


class _Place:
    """Files below a folder: a shared mount (file: or a plain path) or any file system that Arrow knows by its URI."""

    def __init__(self, folder: str):
        self.folder, self.fs = folder, None
        if folder.startswith("file:"):
            self.folder = "/" + folder[5:].lstrip("/")
        elif "://" in folder:
            from pyarrow import fs

            self.fs, self.folder = fs.FileSystem.from_uri(folder)

    def writer(self, name: str):
        path = f"{self.folder}/{name}"
        if self.fs:
            self.fs.create_dir(self.folder, recursive=True)
            return self.fs.open_output_stream(path, compression=None)
        os.makedirs(self.folder, exist_ok=True)
        return open(path, "wb")  # noqa: SIM115

    def rename(self, old: str, new: str) -> None:
        old, new = f"{self.folder}/{old}", f"{self.folder}/{new}"
        self.fs.move(old, new) if self.fs else os.replace(old, new)

    def reader(self, name: str):
        path = f"{self.folder}/{name}"
        return self.fs.open_input_stream(path, compression=None) if self.fs else open(path, "rb")  # noqa: SIM115


class _Counted(io.RawIOBase):
    """Counts the bytes that go to a stream."""

    def __init__(self, out):
        self.out, self.n = out, 0

    def writable(self):
        return True

    def write(self, data):
        self.n += len(data)
        self.out.write(data)
        return len(data)


class _Record:
    """One record as a gzip member, written chunk by chunk. kind: response or revisit; a revisit has no payload, but its length and digest."""

    def __init__(self, out, record_id: str, kind: str, url: str | None, digest: str, n_bytes: int, refers_to: str | None, date: str):
        self.out, self.record_id, self.kind, self.digest, self.left = out, record_id, kind, digest, n_bytes if kind == "response" else 0
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response"]
        if url is not None:
            head.append(f"WARC-Target-URI: {_uri_safe(url)}")
        head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {n_bytes}"]
        if kind == "revisit":
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
        head += [f"Content-Length: {len(http) + self.left}", "", ""]
        # Not a GzipFile: each is part of a reference cycle, and so keeps its buffers until the collector happens to run.
        self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.running = hashlib.sha1(usedforsecurity=False)
        out.write(self.member.compress("\r\n".join(head).encode() + http))

    def add(self, data) -> None:
        self.left -= len(data)
        self.running.update(data)
        self.out.write(self.member.compress(data))

    def close(self) -> None:
        if self.left or (self.kind == "response" and _base32(self.running.digest()) != self.digest):
            raise ValueError(f"{self.record_id}: its chunks aren't its declared payload")
        self.out.write(self.member.compress(b"\r\n\r\n") + self.member.flush())


def chunked(records: DataFrame) -> DataFrame:
    """records: record_id, url, payload (binary), sha1 (hex of the payload), refers_to (null: a response). A row for each chunk of a response, one without data for an empty one
    and for a revisit; the rows of a record follow each other in order."""
    n = F.octet_length("payload").cast("long")
    last = F.when(F.col("refers_to").isNull(), F.greatest(F.lit(0), F.ceil(n / CHUNK) - 1)).otherwise(0).cast("int")
    data = lambda k: F.when(F.col("refers_to").isNull(), F.substring("payload", k * CHUNK + 1, F.lit(CHUNK)))
    rows = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("chunk_no"), (k == last).alias("is_last"), data(k).alias("data")))
    return records.select("record_id", "url", "sha1", "refers_to", n.alias("n_bytes"), F.inline(rows))


def write(chunks: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """chunks: what chunked() gives. Writes archives into folder and returns a stored table: archive, n_records. Each task writes its own archives; none is shared.
    A record whose chunks don't have its declared digest raises an error."""

    def run(batches):
        place = _Place(folder)
        name = out = record = None
        n = 0

        def close():
            out.out.close()
            place.rename(f"{name}.open", name)
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            ids, urls, digests, refers, sizes, numbers, lasts, datas = batch.columns
            for k in range(len(batch)):
                if out is None:
                    name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = _Counted(place.writer(f"{name}.open"))
                if not numbers[k].as_py():
                    to = refers[k].as_py()
                    record = _Record(out, ids[k].as_py(), "revisit" if to else "response", urls[k].as_py(), _base32(bytes.fromhex(digests[k].as_py())), sizes[k].as_py(), to, date)
                data = datas[k].as_buffer()
                if data is not None:
                    record.add(memoryview(data))
                if lasts[k].as_py():
                    record.close()
                    n += 1
                    if out.n >= ARCHIVE:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return stored(chunks.select("record_id", "url", "sha1", "refers_to", "n_bytes", "chunk_no", "is_last", "data").mapInArrow(run, "archive string, n_records long"), "manifest")


def _headers(stream) -> dict[str, str]:
    """Lines up to an empty one, by lower-case name."""
    out = {}
    while (line := stream.readline(LINE)) not in (b"\r\n", b"\n", b""):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def chunks_of(stream, archive: str, with_data: bool = True):
    """The rows of CHUNKS, as tuples, of a stream of WARC bytes. It holds one chunk at a time."""
    while line := stream.readline(LINE):
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"{archive}: no record where one should start")
            continue
        head = _headers(stream)
        left = int(head["content-length"])
        kind = head.get("warc-type", "")
        if kind in ("response", "revisit") and head.get("content-type", "").startswith("application/http"):
            # The HTTP header is part of the block, not of the payload.
            while left > 0:
                line = stream.readline(min(LINE, left))
                left -= len(line)
                if line in (b"\r\n", b"\n", b""):
                    break
        n_bytes = int(head.get("warc-payload-length", left))
        declared = head.get("warc-payload-digest", "").rpartition(":")[2] or None
        base = (kind, (head.get("warc-refers-to") or "").strip("<>") or None, head.get("warc-target-uri"), n_bytes, declared, archive)
        record_id = head.get("warc-record-id", "").strip("<>")
        running, offset, no = hashlib.sha1(usedforsecurity=False), 0, 0
        if kind == "revisit" or not left:
            yield (record_id, 0, 0, b"", declared if kind == "revisit" else _base32(running.digest()), True, *base)
        while left > 0:
            data = stream.read(min(CHUNK, left))
            if not data:
                raise EOFError(f"{archive}: {record_id} ends too early")
            running.update(data)
            left -= len(data)
            yield (record_id, no, offset, data if with_data else None, _base32(running.copy().digest()), not left, *base)
            offset += len(data)
            no += 1


def read(spark: SparkSession, manifest: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives that manifest names. with_data: False leaves the bytes out, digests and lengths stay."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        place = _Place(folder)
        rows: list[tuple] = []
        held = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with place.reader(name) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as stream:
                    for row in chunks_of(stream, name, with_data):
                        rows.append(row)
                        held += len(row[3] or b"")
                        if len(rows) >= 1024 or held >= 4 * CHUNK:
                            yield out()
                            rows.clear()
                            held = 0
        if rows:
            yield out()

    return manifest.select("archive").repartition(partitions(spark)).mapInArrow(run, CHUNKS)


def records_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """What chunked() takes. Of records with equal payloads of least_bytes or more the one with the largest id is a response and
    the others refer to it; a row with a null id, or one that repeats the largest id, is a response. A record's id is made of the page's id and the row's place, so that
    repeated rows and null ids have ids of their own."""
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), F.monotonically_increasing_id().alias("row"))
    slim = base.select("id", "sha1", "row", F.octet_length("payload").alias("n"))
    # Of rows with the largest id the first is referred to.
    best = F.max_by(F.struct("id", "row"), F.struct("id", (-F.col("row")).alias("up")))
    same = slim.filter((F.col("n") >= least_bytes) & F.col("id").isNotNull()).groupBy("sha1").agg(best.alias("to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = stored(same.select("sha1", F.col("to.id").alias("to_id"), F.col("to.row").alias("to_row")), "same")
    if same.count() <= MOST_BROADCAST:
        joined = base.join(F.broadcast(same), "sha1", "left")
    else:
        # A payload can be that of a third of all pages, so its rows are dealt to several tasks.
        spread = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
        joined = base.withColumn("salt", salt).join(spread, ["sha1", "salt"], "left").drop("salt")
    urn = lambda page, row: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"))
    refers = F.when(F.col("id") != F.col("to_id"), urn(F.col("to_id"), F.col("to_row")))
    if least_bytes:
        refers = F.when(F.octet_length("payload") >= least_bytes, refers)
    return joined.select(urn(F.col("id"), F.col("row")).alias("record_id"), "url", "payload", "sha1", refers.alias("refers_to"))


def _wrong(rows: DataFrame) -> str | None:
    """An id that one of these records gets wrong: it is not the only record of this id, its payload hasn't the declared digest, or it is a revisit of a record that isn't a
    response with its digest and length. rows: the last chunks. Partial sums come first, so a record that very many revisit is no hot key."""
    key = F.coalesce("refers_to", "record_id").alias("key")
    responses = F.sum((F.col("record_type") == "response").cast("int"))
    differ = lambda c: F.min(c) != F.max(c)
    broken = F.max((F.col("record_type") == "response") & ~F.col("digest_so_far").eqNullSafe(F.col("declared_digest")))
    bad = rows.groupBy(key).agg((differ("declared_digest") | differ("payload_bytes") | (responses != 1) | broken).alias("bad")).filter(F.coalesce("bad", F.lit(True)))
    found = bad.first()
    return found.key if found else None


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages to archives in folder (one of its own in the shared folder, if none is given), reads them back, and gives per record page_id,
    payload_bytes, payload_digest, record_type, refers_to, url.

    Null html is an empty payload, null urls have no header, null ids stay null, repeated rows have a record each, no pages
    give no rows; further columns are ignored. A payload that doesn't have its declared digest, and a revisit that doesn't have the digest and length of the response
    that it names, raise an error.
    """
    spark = pages.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
        remember(folder)
    rows = stored(read(spark, write(chunked(records_of_pages(pages)), folder), folder, with_data=False).filter("is_last").drop("data"), "records")
    if wrong := _wrong(rows):
        raise ValueError(f"{wrong} or a revisit of it was not read back as it was written")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+):\d+$", 1).try_cast("long")
    return rows.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.col("declared_digest").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
