"""WARC archives with a Zstandard dictionary: records compressed one by one, the dictionary in front.

Writing: a dictionary is built from a bounded sample of the records.  Each archive file begins with
a skippable frame (magic 0x184D2A5D) that holds it, followed by one Zstandard frame per record, so
that a record can be read alone.  Records with equal payloads of at least `least` bytes are written
once, for the smallest page id, as a response; the others are revisits that refer to it.

Each task writes files of its own under names that no other attempt uses and reports them in a
manifest, which is written as a table: what a lost or repeated attempt left is in no manifest and never
read.  Files are written with pyarrow's file systems at the cluster's shared folder.

Reading streams every file of the manifest record by record.

Null html is an empty payload; a null url is written as empty.  Rows with a null page id are written
like others and read back with a null id; they can revisit but not be revisited.  Rows that share the
smallest id of a payload are all responses.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.graph import saved, shared_folder

MAGIC = 0x184D2A5D
#: Bytes of the dictionary, of the sample that it is built from, and of records in one archive.
DICTIONARY, SAMPLE, ARCHIVE = 64 << 10, 6 << 20, 256 << 20
LEVEL = 6
#: Bytes of a record that the sample takes; repeated payloads that are broadcast (more are joined by shuffle, salted `SALT` ways).
HEAD, FEW_PAYLOADS, SALT = 64 << 10, 1_000_000, 64
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
MANIFEST = "path string, records long, bytes long"


def _block(kind: str, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return head + payload if kind == "response" else head


def _name(page_id: int | None, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}").urn


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record."""
    kind = "response" if refers_to is None else "revisit"
    block = _block(kind, payload)
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{_name(page_id, digest)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", "".join((url or "").splitlines())), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))), ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        head[2:2] = [("WARC-Refers-To", f"<{_name(refers_to, digest)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a decompressed stream."""
    lines = io.BufferedReader(stream, 1 << 18)
    while first := lines.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {first[:40]!r}")
        head = {}
        while (line := lines.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        block = lines.read(int(head["Content-Length"]))
        if lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def train(samples: list[bytes]) -> bytes:
    """A dictionary of at most a tenth of the sample; where that is too little to train on, the sample's end as it is."""
    total = sum(map(len, samples))
    size = min(DICTIONARY, max(256, total // 10))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


class Archive:
    """A file being written."""

    def __init__(self, files: pafs.FileSystem, path: str, dictionary: bytes):
        self.path, self.records, self.raw = path, 0, 0
        self.out = files.open_output_stream(path, compression=None)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        if dictionary:
            self.out.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)

    def add(self, record: bytes) -> None:
        self.out.write(self.compressor.compress(record))
        self.records += 1
        self.raw += len(record)

    def close(self) -> tuple[str, int, int]:
        size = self.out.tell()
        self.out.close()
        return self.path, self.records, size


def open_archive(files: pafs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one file."""
    with files.open_input_stream(path, compression=None) as raw:
        head, known = raw.read(8), None
        if len(head) == 8 and struct.unpack("<II", head)[0] == MAGIC:
            known, head = zstandard.ZstdCompressionDict(raw.read(struct.unpack("<II", head)[1])), b""
        body = raw if not head else _Chain(head, raw)
        with zstandard.ZstdDecompressor(dict_data=known).stream_reader(body, read_across_frames=True) as stream:
            yield from read_records(stream)


class _Chain:
    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def read(self, n: int = -1) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out
        return self.rest.read(n)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 100, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives; returns their manifest: path, records, bytes."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/leafmill/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    again = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = saved(again.select("digest", "first"), "payloads")
    total = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    share = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    head = rows.withColumn("payload", F.expr(f"substring(payload, 1, {HEAD})")).withColumn("url", F.expr(f"substring(url, 1, {HEAD})"))
    sample = head.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(1 << 30)) < share).select("page_id", "url", "payload", "digest").collect()
    dictionary = train([encode_record(r.page_id, r.url, bytes(r.payload), r.digest, None, date) for r in sample])
    if again.count() <= FEW_PAYLOADS:
        joined = rows.join(F.broadcast(again), "digest", "left")
    else:
        # The commonest page may be a third of all: its rows are spread by a salt.
        salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["digest", "salt"], "left")
    joined = joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, done = TaskContext.get(), None, []
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
            for page_id, url, digest, refers_to, payload in zip(*columns, batch["payload"], strict=True):
                if archive is None:
                    archive = Archive(files, f"{base}/part-{task.partitionId():05d}-{len(done):03d}-{uuid.uuid4().hex[:8]}.warc.zst", dictionary)
                archive.add(encode_record(page_id, url, payload.as_py(), digest, refers_to, date))
                if archive.raw >= ARCHIVE:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        columns = list(zip(*done, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "records", "bytes"])

    named = F.concat(F.lit(f"{folder}/"), F.substring_index("path", "/", -1))
    return saved(joined.mapInArrow(run, MANIFEST).withColumn("path", named), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """For each record: page_id, payload_bytes, payload_digest, record_type, refers_to (a revisit's response)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                files, at = pafs.FileSystem.from_uri(path)
                out: list[tuple] = []
                for head, block in open_archive(files, at):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"the payload of page {head['X-Page-ID']} is not what was written")
                    out.append((int(head["X-Page-ID"]) if head["X-Page-ID"] else None, size, digest, kind, int(head["X-Refers-To-Page"]) if kind == "revisit" else None))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # One archive, of a bounded size, a task.
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, RECORD)


def unresolved(records: DataFrame) -> DataFrame:
    """Revisits whose response, with the same payload digest, is not among the records."""
    there = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return records.where("record_type = 'revisit'").join(there, ["refers_to", "payload_digest"], "left_anti")
