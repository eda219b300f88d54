"""Deterministic sharded WARC writer and its reader.

Pages are sorted into ranges of their id, a range is one task, and a task rolls to a new
file when the compressed bytes of the current one pass a limit.  Ranges are cut from a
histogram of bytes over the ids, dates and record ids are derived from the records, so the
same pages give the same files byte for byte however often tasks are run again.  A file is
written under a temporary name of its attempt and renamed when it is whole; one manifest
per range, renamed last, names the files that count.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import arrow_slices
from genoloom.session import cut_lineage, qualified

HISTOGRAM = 4096
CRLF = "\r\n"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs


@dataclass(frozen=True)
class Settings:
    shard_bytes: int = 64 << 20  # payload of a range, about
    file_bytes: int = 16 << 20   # compressed; a file ends with the record that passes it
    revisit_bytes: int = 1000    # equal payloads from this size on are written once
    date: str = "2020-01-01T00:00:00Z"


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def record_plan(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(page_id, url, size, digest, refers_to): what each record refers to, null if nothing.

    Works on ids, URLs, sizes and digests alone.  Of equal payloads the largest page_id is the
    response.
    """
    raw = _payload(F.col("html"))
    thin = cut_lineage(pages.select("page_id", "url", F.sha1(raw).alias("digest"), F.octet_length(raw).cast("long").alias("size")))
    first = cut_lineage(thin.where(F.col("size") >= s.revisit_bytes).groupBy("digest", "size").agg(
        F.max("page_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("digest", "size", "first"))
    return thin.join(first, ["digest", "size"], "left").select(
        "page_id", "url", "size", "digest",
        F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def _shard(plan: DataFrame, s: Settings) -> tuple[Column, int]:
    """The range of a record, from a histogram of bytes over the page ids, and their number.

    A cell that holds more bytes than a range is dealt by a hash of page and payload.
    """
    low, high = plan.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    width = (high - low) // HISTOGRAM + 1
    # Cell 0 holds the null ids.
    cell = F.coalesce(F.call_function("div", F.col("page_id") - low, F.lit(width)).cast("int") + 1, F.lit(0))
    sizes = dict(plan.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes")).collect())
    first, parts, held, last = [], [], 0, 0
    for k in range(HISTOGRAM + 1):
        size = sizes.get(k, 0)
        if held and held + size > s.shard_bytes:
            last, held = last + 1, 0
        n = max(1, -(-size // s.shard_bytes))
        first.append(last)
        parts.append(n)
        last, held = last + n - 1, held + size if n == 1 else s.shard_bytes
    start, many = (F.element_at(F.array(*map(F.lit, v)), cell + 1) for v in (first, parts))
    return start + F.pmod(F.xxhash64("page_id", "digest", "url"), many).cast("int"), last + 1


def _record(page: int | None, url: str, kind: str, date: str, payload: bytes, sha: str, refers: int | None) -> bytes:
    """One record as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page} {url} {sha}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-Page-ID": "" if page is None else str(page),
        "WARC-Payload-Digest": f"sha1:{sha}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 "WARC-Refers-To-Page": str(refers)}
    text = CRLF.join(["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), "", ""])
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _one_line(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


class _Roller:
    """Writes records of one range to files that are renamed when they are whole."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.shard, self.limit, self.files, self.out = shard, limit, [], None
        self.attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"

    def write(self, raw: bytes) -> None:
        if self.out is None:
            self.name, self.size, self.records = f"part-{self.shard:05d}-{len(self.files):05d}.warc.gz", 0, 0
            self.sha = hashlib.sha1()
            self.temporary = f"{self.base}/.{self.name}.{self.attempt}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.out.write(raw)
        self.sha.update(raw)
        self.size, self.records = self.size + len(raw), self.records + 1
        if self.size >= self.limit:
            self.roll()

    def roll(self) -> None:
        if self.out is not None:
            self.out.close()
            self._rename(self.temporary, f"{self.base}/{self.name}")
            self.files.append({"file": self.name, "bytes": self.size, "records": self.records, "sha1": self.sha.hexdigest()})
            self.out = None

    def commit(self) -> None:
        self.roll()
        name = f"{self.base}/manifest-{self.shard:05d}.json"
        with self.fs.open_output_stream(f"{name}.{self.attempt}", compression=None) as f:
            f.write(json.dumps(self.files).encode())
        self._rename(f"{name}.{self.attempt}", name)

    def _rename(self, temporary: str, name: str) -> None:
        """Some file systems rename onto no file that is there: one of an earlier attempt,
        which holds the same bytes."""
        if self.fs.get_file_info(name).type != pafs.FileType.NotFound:
            self.fs.delete_file(name)
        self.fs.move(temporary, name)


def write(pages: DataFrame, folder: str, s: Settings = Settings()) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``folder``, a URI all
    executors reach, and returns its manifests: (file, bytes, records, sha1).

    A null html is an empty payload, a null url an empty target; a null page_id sorts first.
    Repeated rows give repeated records: of rows that repeat both page_id and payload all
    are alike.  Spaces and control characters of a URL are percent-encoded.  Other columns
    are not read.  An empty table gives no files.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    plan = cut_lineage(record_plan(pages, s))
    shard, shards = _shard(plan, s)
    raw = _payload(F.col("html"))
    rows = pages.select("page_id", "url", F.lit(1).alias("turn"), F.sha1(raw).alias("digest"),
                        raw.alias("payload"), F.lit(None).cast("bigint").alias("refers_to"))
    # What a record refers to comes as a row ahead of it: one shuffle moves both.
    refers = plan.where("refers_to is not null").select(
        "page_id", "url", F.lit(0).alias("turn"), "digest", F.lit(None).cast("binary").alias("payload"), "refers_to")
    full = refers.unionByName(rows).withColumn("shard", shard)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, ahead = None, (None, None)
        for part in arrow_slices(batches, "payload"):
            for k, page, digest, turn, url, payload, refers_to in zip(*(part.column(c).to_pylist() for c in (
                    "shard", "page_id", "digest", "turn", "url", "payload", "refers_to")), strict=True):
                if not turn:
                    ahead = ((page, digest), refers_to)
                    continue
                if roller is None or roller.shard != k:
                    if roller:
                        roller.commit()
                    roller = _Roller(folder, k, s.file_bytes)
                to = ahead[1] if ahead[0] == (page, digest) else None
                roller.write(_record(page, _one_line(url), "response" if to is None else "revisit", s.date, payload, digest, to))
        if roller:
            roller.commit()
        yield pa.RecordBatch.from_pydict({"done": pa.array([0], pa.int32())})

    full.repartitionById(shards, "shard").sortWithinPartitions(
        "shard", "page_id", "digest", "url", "turn").select(
        "shard", "page_id", "digest", "turn", "url", "payload", "refers_to").mapInArrow(work, "done int").agg(F.count(F.lit(1))).first()
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files that the ranges' manifests name, one row each: (file, bytes, records, sha1)."""
    listed = spark.read.schema("value string").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "manifest-*.json").text(folder, wholetext=True)
    one = "array<struct<file: string, bytes: bigint, records: bigint, sha1: string>>"
    return listed.select(F.inline(F.from_json("value", one)))


def _members(fs: pafs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, read as a stream."""
    with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(_Readable(raw), 1 << 20)) as f:
        while line := f.readline():
            if line.rstrip() != b"WARC/1.1":
                raise ValueError(f"{os.path.basename(path)}: no record where one should start")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                k, _, v = line.decode().partition(": ")
                head[k] = v
            block = f.read(int(head["Content-Length"]))
            if f.read(4) != b"\r\n\r\n" or f"sha1:{hashlib.sha1(block).hexdigest()}" != head["WARC-Block-Digest"]:
                raise ValueError(f"{os.path.basename(path)}: damaged record {head['WARC-Record-ID']}")
            yield head, block


class _Readable(io.RawIOBase):
    """An Arrow stream as a Python one."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        got = self.stream.read(len(b))
        b[:len(got)] = got
        return len(got)


def read(files: DataFrame, folder: str) -> DataFrame:
    """The records of the files a manifest lists: (page_id, url, record_type, payload,
    payload_bytes, payload_digest, refers_to).

    ``payload`` is null for revisits; sizes and digests of responses are taken from the
    bytes read.  A damaged or cut record is an error.
    """
    n, folder = max(1, files.count()), qualified(files.sparkSession, folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        names = ("page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to")
        types = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out, held = [], 0
                for head, block in _members(fs, f"{base}/{name}"):
                    kind = head["WARC-Type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    page, refers = head["WARC-Page-ID"], head.get("WARC-Refers-To-Page")
                    out.append((
                        int(page) if page else None, head["WARC-Target-URI"], kind, payload,
                        int(head["WARC-Payload-Length"]) if payload is None else len(payload),
                        head["WARC-Payload-Digest"].removeprefix("sha1:") if payload is None else hashlib.sha1(payload).hexdigest(),
                        int(refers) if refers else None))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)

    return files.select("file").repartition(n, "file").mapInArrow(
        work, "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, "
              "payload_digest string, refers_to bigint")
