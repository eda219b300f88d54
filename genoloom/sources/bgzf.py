"""Block-gzipped text, read in parallel and by region.

Such a file is a chain of gzip members of at most 64 KB that name their own size, so it
can be cut anywhere: a task looks for the first block from its place on.  A position is a
virtual offset, the block's place in the file (upper 48 bits) and the byte within the
block (lower 16).  An index beside the file (``.tbi``) lists, by contig and bin of a
hierarchy of bins, the stretches of virtual offsets that hold the bin's records.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import cut_lineage, qualified

FORMAT = "genoloom-bgzf"
SPLIT_BYTES = 16 << 20
# Fixed values of the formats: start of a block, the empty block that ends a file, the index's
# first bytes, its columns for variant files, smallest bin and number of levels above it.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
INDEX_MAGIC = b"TBI\x01"
INDEX_HEAD = (2, 1, 2, 0, ord("#"), 0)
BIN_SHIFT, BIN_LEVELS = 14, 5
BLOCK_TEXT = 0xFF00  # bytes of text that go into a block

LINES = "file string, block bigint, line string"


# -- blocks ------------------------------------------------------------------------

def block_size(head: bytes) -> int | None:
    """The size of the block that starts with ``head``, None if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 6 <= min(end, len(head)):
        name, n = head[at:at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def packed_block(text: bytes, level: int = 6) -> bytes:
    """One block of at most 64 KB of text."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    size = 18 + len(body) + 8
    return (MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, size - 1) + body
            + struct.pack("<II", zlib.crc32(text), len(text)))


class Blocks:
    """The blocks of a file from a place on."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(self.path)
        self.size = self.file.size()

    def at(self, start: int) -> Iterator[tuple[int, bytes]]:
        """(place, text) of each block from exactly ``start`` on."""
        buffer, base = b"", start
        while True:
            size = block_size(buffer)
            while (size is None or len(buffer) < size) and base + len(buffer) < self.size:
                more = self.file.read_at(min(1 << 20, self.size - base - len(buffer)), base + len(buffer))
                buffer += more
                size = block_size(buffer)
            if not buffer:
                return
            if size is None or len(buffer) < size:
                raise ValueError(f"{self.path}: no whole block at {base}")
            text = zlib.decompress(buffer[12 + struct.unpack_from("<H", buffer, 10)[0]:size - 8], -15)
            if (zlib.crc32(text), len(text)) != struct.unpack_from("<II", buffer, size - 8):
                raise ValueError(f"{self.path}: damaged block at {base}")
            yield base, text
            buffer, base = buffer[size:], base + size

    def first_from(self, place: int) -> int:
        """Where the first block at or after a place starts; the file's size if none does.

        Bytes that look like a start by chance are told by what follows the block.
        """
        window = 1 << 17
        while place < self.size:
            raw = self.file.read_at(min(window, self.size - place), place)
            at = raw.find(MAGIC)
            while at >= 0:
                size = block_size(raw[at:at + 64])
                if size is not None:
                    after = place + at + size
                    if after == self.size or block_size(self.file.read_at(64, after)) is not None:
                        return place + at
                at = raw.find(MAGIC, at + 1)
            place += max(1, len(raw) - len(MAGIC) + 1) if len(raw) == window else len(raw)
        return self.size


def is_blocked(uri: str) -> bool:
    """Whether a file starts with a block; others, and those out of Arrow's reach, are not."""
    try:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_stream(path, compression=None) as f:
            return block_size(f.read(64)) is not None
    except (OSError, ValueError, pa.ArrowException):
        return False


# -- the index ---------------------------------------------------------------------

def bins_of(x: int, y: int) -> list[int]:
    """All bins that records of positions [x, y), counted from 1, may be in."""
    first, last, out = max(0, x - 1), max(0, y - 2), []
    for level in range(BIN_LEVELS + 1):
        shift = BIN_SHIFT + 3 * (BIN_LEVELS - level)
        base = ((1 << 3 * level) - 1) // 7
        out += range(base + (first >> shift), base + (last >> shift) + 1)
    return out


def bin_of(first: int, last: int) -> int:
    """The smallest bin that holds positions ``first`` to ``last``, counted from 1."""
    for level in range(BIN_LEVELS, -1, -1):
        shift = BIN_SHIFT + 3 * (BIN_LEVELS - level)
        if (first - 1) >> shift == (last - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + ((first - 1) >> shift)
    return 0


@dataclass
class Index:
    """By contig: stretches of virtual offsets of each bin, and for each 16 kb window where
    the first record that touches it starts."""

    bins: dict[str, dict[int, list[list[int]]]] = field(default_factory=dict)
    windows: dict[str, list[int]] = field(default_factory=dict)

    def add(self, chrom: str, first: int, last: int, begin: int, end: int) -> None:
        """Count in a record of positions ``first`` to ``last`` at virtual offsets [begin, end)."""
        chunks = self.bins.setdefault(chrom, {}).setdefault(bin_of(first, last), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        windows = self.windows.setdefault(chrom, [])
        while len(windows) <= (last - 1) >> BIN_SHIFT:
            windows.append(0)
        for k in range((first - 1) >> BIN_SHIFT, ((last - 1) >> BIN_SHIFT) + 1):
            windows[k] = windows[k] or begin + 1  # 0 is none so far

    def dumped(self) -> bytes:
        names = b"".join(c.encode() + b"\0" for c in self.bins)
        out = [INDEX_MAGIC, struct.pack("<i6ii", len(self.bins), *INDEX_HEAD, len(names)), names]
        for chrom, bins in self.bins.items():
            out.append(struct.pack("<i", len(bins)))
            for b, chunks in sorted(bins.items()):
                out += [struct.pack("<Ii", b, len(chunks)), *(struct.pack("<QQ", *c) for c in chunks)]
            last, windows = 0, []
            for v in self.windows[chrom]:  # a window without records starts where the one before does
                last = v - 1 if v else last
                windows.append(last)
            out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
        text = b"".join(out)
        return b"".join(packed_block(text[i:i + BLOCK_TEXT]) for i in range(0, len(text), BLOCK_TEXT)) + END

    @staticmethod
    def read(uri: str) -> Index:
        text = b"".join(t for _, t in Blocks(uri).at(0))
        if text[:4] != INDEX_MAGIC:
            raise ValueError(f"{uri}: no index")
        n, *_, size = struct.unpack_from("<i6ii", text, 4)
        at = 36 + size
        names, out = text[36:at].split(b"\0")[:n], Index()
        for name in names:
            bins, n_bins = {}, struct.unpack_from("<i", text, at)[0]
            at += 4
            for _ in range(n_bins):
                b, chunks = struct.unpack_from("<Ii", text, at)
                bins[b] = [list(struct.unpack_from("<QQ", text, at + 8 + 16 * k)) for k in range(chunks)]
                at += 8 + 16 * chunks
            windows = struct.unpack_from("<i", text, at)[0]
            out.bins[name.decode()] = bins
            out.windows[name.decode()] = list(struct.unpack_from(f"<{windows}Q", text, at + 4))
            at += 4 + 8 * windows
        return out

    def chunks(self, chrom: str, x: int, y: int) -> list[tuple[int, int]]:
        """Stretches of virtual offsets that hold all records touching [x, y)."""
        bins, windows = self.bins.get(chrom, {}), self.windows.get(chrom, [])
        if x >= y or not windows:
            return []
        k = (max(1, x) - 1) >> BIN_SHIFT
        least = windows[k] if k < len(windows) else windows[-1]
        return [(a, b) for n in bins_of(x, y) for a, b in bins.get(n, ()) if b > least]


def merged(chunks: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks in order, those that touch or share a block as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


# -- the source --------------------------------------------------------------------

@dataclass
class Split(InputPartition):
    """A stretch of a file: by raw offsets to be cut at blocks, by virtual ones, or its header."""

    kind: str
    uri: str
    start: int
    end: int
    regions: tuple[tuple[str, int, int], ...] = ()


class BgzfSource(DataSource):
    """Lines of block-gzipped files.  Options: ``files``, a JSON list of [uri, bytes];
    ``split_bytes``; ``regions``, a JSON list of [contig, x, y], with which only header lines
    and records touching one of them are read, by the index beside each file."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> BgzfReader:
        return BgzfReader(self.options)


class BgzfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.regions = json.loads(options["regions"]) if "regions" in options else None

    def partitions(self) -> Sequence[InputPartition]:
        out: list[Split] = []
        for uri, size in self.files:
            if self.regions is None:
                out += [Split("raw", uri, a, min(a + self.split, size)) for a in range(0, size, self.split)]
                continue
            index, asked = Index.read(f"{uri}.tbi"), {}
            for chrom, x, y in self.regions:
                for chunk in index.chunks(chrom, x, y):
                    asked.setdefault(chunk, set()).add((chrom, x, y))
            out.append(Split("header", uri, 0, size))
            for a, b in merged(list(asked)):
                on = {r for (c, d), rs in asked.items() if c < b and d > a for r in rs}
                out.append(Split("virtual", uri, a, b, tuple(sorted(on))))
        return out or [Split("none", "", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        lines = {"raw": _raw_lines, "virtual": _region_lines, "header": _header_lines, "none": lambda _: ()}[split.kind]
        held: list[bytes] = []
        size = 0
        for line in lines(split):
            held.append(line[:-1] if line.endswith(b"\r") else line)
            size += len(line)
            if size > 4 << 20:
                yield _batch(split, held)
                held, size = [], 0
        if held:
            yield _batch(split, held)


def _batch(split: Split, lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([split.uri] * len(lines), pa.string()), pa.array([split.start] * len(lines), pa.int64()),
        pa.array(lines, pa.binary()).cast(pa.string())], names=["file", "block", "line"])


def _raw_lines(split: Split) -> Iterator[bytes]:
    """The lines behind a line end within the blocks that start in the stretch, and the
    first line of a file: each line of a file is in one stretch."""
    blocks = Blocks(split.uri)
    start = blocks.first_from(split.start)
    if start >= split.end:
        return
    rest, begun = b"", split.start == 0
    for at, text in blocks.at(start):
        mine = at < split.end
        if not begun:
            if not mine:
                return
            cut = text.find(b"\n")
            if cut < 0:
                continue
            begun, text = True, text[cut + 1:]
        if mine:
            *whole, rest = (rest + text).split(b"\n")
            yield from whole
        elif not text:
            continue
        else:
            cut = text.find(b"\n")
            if cut >= 0:
                yield rest + text[:cut]
                return
            rest += text
    if rest:
        yield rest


def _header_lines(split: Split) -> Iterator[bytes]:
    rest = b""
    for _, text in Blocks(split.uri).at(0):
        *whole, rest = (rest + text).split(b"\n")
        for line in whole:
            if not line.startswith(b"#"):
                return
            yield line
    if rest.startswith(b"#"):
        yield rest


def _region_lines(split: Split) -> Iterator[bytes]:
    """Records in a stretch of virtual offsets that touch one of its regions."""
    by: dict[bytes, list[tuple[int, int]]] = {}
    for chrom, x, y in split.regions:
        by.setdefault(chrom.encode(), []).append((x, y))
    rest, skip = b"", split.start & 0xFFFF
    for at, text in Blocks(split.uri).at(split.start >> 16):
        if at << 16 >= split.end:
            break
        text = text[:split.end & 0xFFFF] if at == split.end >> 16 else text
        *whole, rest = (rest + text[skip:]).split(b"\n")
        skip = 0
        for line in whole:
            chrom, pos, _, ref = line.split(b"\t", 4)[:4]
            first = int(pos)
            if any(first < y and first + len(ref) > x for x, y in by.get(chrom, ())):
                yield line


# -- for Spark ---------------------------------------------------------------------

def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files at a path, a glob or below a folder, as Spark names them;
    hidden files and indexes are left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for found in fs.globStatus(where) or []:
        inside = [found] if found.isFile() else [s for s in fs.listStatus(found.getPath()) if s.isFile()]
        out += [(s.getPath(), s.getLen()) for s in inside if s.getPath().getName()[0] not in "._"]
    return sorted((qualified(spark, p.toString()), n) for p, n in out if not p.getName().endswith((".tbi", ".csi")))


def read_blocked_lines(spark: SparkSession, files: Sequence[tuple[str, int]], *, regions: Sequence[tuple[str, int, int]] | None = None,
                       split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, block, line_no, line) of block-gzipped files, a task per stretch of a file.

    With ``regions`` of (contig, x, y), half open and counted from 1, the index beside each
    file tells which blocks are read, and only header lines and the records that touch a
    region come out, each once.  Lines of a file keep their order along ``line_no``.
    """
    spark.dataSource.register(BgzfSource)
    reader = spark.read.format(FORMAT).option("files", json.dumps(list(files))).option("split_bytes", split_bytes)
    if regions is not None:
        reader = reader.option("regions", json.dumps([list(r) for r in regions]))
    return reader.load().select("file", "block", F.monotonically_increasing_id().alias("line_no"), "line")


# -- writing -----------------------------------------------------------------------

def write_blocked(lines: DataFrame, folder: str, header: Sequence[str] = ()) -> DataFrame:
    """Writes sorted record lines, column ``line``, as one block-gzipped file and index per
    partition below ``folder``, a URI all executors reach; returns (uri, bytes).

    A file is renamed when it is whole, so an attempt that is repeated replaces it.
    Partitions without rows give no file.
    """
    head = "".join(f"{h}\n" for h in header).encode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.vcf.gz"
        temporary = f"{base}/.{name}.{task.taskAttemptId()}"
        index, place, buffer, rows = Index(), 0, head, 0
        with fs.open_output_stream(temporary, compression=None) as out:
            def flush(all_: bool) -> None:
                nonlocal buffer, place
                while len(buffer) >= BLOCK_TEXT or (all_ and buffer):
                    raw = packed_block(buffer[:BLOCK_TEXT])
                    out.write(raw)
                    place, buffer = place + len(raw), buffer[BLOCK_TEXT:]

            for batch in batches:
                for line in batch.column("line").to_pylist():
                    flush(False)
                    begin, rows = place << 16 | len(buffer), rows + 1
                    chrom, pos, _, ref = line.split("\t", 4)[:4]
                    buffer += line.encode() + b"\n"
                    flush(False)
                    index.add(chrom, int(pos), int(pos) + len(ref) - 1, begin, place << 16 | len(buffer))
            flush(True)
            out.write(END)
        if rows:
            with fs.open_output_stream(f"{base}/.{name}.tbi.{task.taskAttemptId()}", compression=None) as out:
                out.write(index.dumped())
            for at, to in ((f"{base}/.{name}.tbi.{task.taskAttemptId()}", f"{base}/{name}.tbi"), (temporary, f"{base}/{name}")):
                if fs.get_file_info(to).type != pafs.FileType.NotFound:
                    fs.delete_file(to)
                fs.move(at, to)
            yield pa.RecordBatch.from_pydict({"uri": [f"{folder}/{name}"], "bytes": [place + len(END)]})
        else:
            fs.delete_file(temporary)

    return cut_lineage(lines.select("line").mapInArrow(work, "uri string, bytes bigint"))
