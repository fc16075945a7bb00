"""Block gzip as a data source and sink: lines of ``.bgz`` files, split by ranges of compressed bytes.

A block-gzip file is a row of small gzip members, each of which names its own length. A task takes the blocks that start
in its range of bytes and the lines that start in those blocks: it skips to the first line end unless it has the start of
the file, and reads on past its range to the end of its last line. Files are opened by Arrow (local paths, s3, gs, hdfs).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the format: start of a member with extra fields, its name for the length field, largest content, last block.
MAGIC = b"\x1f\x8b\x08\x04"
CONTENT = 65280
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

RANGE_BYTES = 32 << 20
_READ = 1 << 20
_BATCH = 20_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path or address and the path inside it."""
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", unquote(path))
    return fs.FileSystem.from_uri(path)


def block_length(head: bytes) -> int | None:
    """Length of the block whose first bytes are ``head``; None where no block starts."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def header_line(path: str, preamble: str = "##") -> str | None:
    """First line that does not start with ``preamble``, "" if there is none; None if Arrow can't open the file or no block starts it."""
    try:
        system, inside = opened(path)
        with system.open_input_file(inside) as file:
            if block_length(file.read(1 << 17)) is None:
                return None
            lines = (x.removesuffix(b"\r").decode() for x in range_lines(file, 0, file.size()))
            return next((x for x in lines if not x.startswith(preamble)), "")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def header_lines(paths: list[str]) -> dict[str, str | None]:
    with ThreadPoolExecutor(16) as pool:
        return dict(zip(paths, pool.map(header_line, paths), strict=True))


class _Bytes:
    """A window over a file that moves on."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.held = file, at, b""
        file.seek(at)

    def have(self, n: int) -> bool:
        while len(self.held) < n and (more := self.file.read(max(_READ, n - len(self.held)))):
            self.held += more
        return len(self.held) >= n

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _first_block(window: _Bytes, end: int) -> bool:
    """Move to the first block that starts before ``end``: its length must lead to another block or the end of the file."""
    while window.at < end:
        window.have(1 << 18)  # more than two blocks and a header
        spot = window.held.find(MAGIC)
        if spot < 0:
            window.drop(max(1, len(window.held) - 3))
            continue
        window.drop(spot)
        window.have(1 << 18)
        if (length := block_length(window.held)) is not None:
            rest = window.held[length:]
            if (not rest and len(window.held) == length) or block_length(rest) is not None:
                return window.at < end
        window.drop(1)
    return False


def _blocks(window: _Bytes) -> Iterator[tuple[int, bytes]]:
    """(start, content) of the blocks from the window on."""
    while window.have(1):
        window.have(1 << 17)
        length = block_length(window.held)
        if length is None or not window.have(length):
            raise ValueError(f"no whole block at byte {window.at}")
        content = zlib.decompress(window.held[:length], 31)
        start = window.at
        window.drop(length)
        yield start, content


def range_lines(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """Lines that start in the blocks which start in [start, end)."""
    window = _Bytes(file, start)
    if start and not _first_block(window, end):
        return
    tail, skipping = b"", bool(start)
    for at, content in _blocks(window):
        if at >= end:
            if skipping:
                return  # no line starts in this range
            line, found, _ = content.partition(b"\n")
            tail += line
            if found:
                yield tail
                return
            continue
        if skipping:
            _, found, content = content.partition(b"\n")
            if not found:
                continue
            skipping = False
        first, *more = content.split(b"\n")
        if not more:
            tail += first
            continue
        yield tail + first
        yield from more[:-1]
        tail = more[-1]
    if tail:
        yield tail


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.step = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[_Range]:
        ranges = []
        for path in self.paths:
            system, inside = opened(path)
            size = system.get_file_info(inside).size
            ranges += [_Range(path, at, min(at + self.step, size)) for at in range(0, size, self.step)]
        return ranges or [_Range(self.paths[0], 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, inside = opened(partition.path)
        with system.open_input_file(inside) as file:
            lines: list[str] = []
            for line in range_lines(file, partition.start, partition.end):
                lines.append(line.removesuffix(b"\r").decode())
                if len(lines) == _BATCH:
                    yield pa.RecordBatch.from_pydict({"value": lines})
                    lines = []
            if lines:
                yield pa.RecordBatch.from_pydict({"value": lines})


@dataclass
class _Written(WriterCommitMessage):
    hidden: str | None


class _Writer(DataSourceArrowWriter):
    """One file per task below a hidden name, made visible when all tasks are done."""

    def __init__(self, options: dict[str, str]):
        self.path, self.header = options["path"], options.get("header")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        iterator = iter(iterator)
        batch = next((b for b in iterator if b.num_rows), None)
        if batch is None:
            return _Written(None)
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        name = f"_{uuid.uuid4().hex}.bgz"
        pending = (self.header + "\n").encode() if self.header else b""
        with system.open_output_stream(f"{folder}/{name}") as out:
            for b in chain([batch], iterator):
                pending += "".join(f"{line or ''}\n" for line in b.column(0).to_pylist()).encode()
                full = len(pending) // CONTENT * CONTENT
                for i in range(0, full, CONTENT):
                    out.write(block(pending[i : i + CONTENT]))
                pending = pending[full:]
            if pending:
                out.write(block(pending))
            out.write(LAST)
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = opened(self.path)
        for m in messages:
            if m and m.hidden:
                system.move(f"{folder}/{m.hidden}", f"{folder}/part-{m.hidden[1:]}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = opened(self.path)
        for m in messages:
            if m and m.hidden:
                system.delete_file(f"{folder}/{m.hidden}")


def block(content: bytes) -> bytes:
    """One block of at most ``CONTENT`` bytes of content."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    head = MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(content), len(content))


class BlockGzip(DataSource):
    """``spark.read.format("blockgzip").load(path)``: the lines of a file as ``value``; options ``range_bytes``, ``header``."""

    @classmethod
    def name(cls) -> str:
        return "blockgzip"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def read_lines(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of all files in one scan."""
    spark.dataSource.register(BlockGzip)
    return spark.read.format("blockgzip").option("range_bytes", range_bytes).option("paths", json.dumps(paths)).load()


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """One block-gzip file per partition of ``lines(value)`` that has rows; each starts with ``header``."""
    lines.sparkSession.dataSource.register(BlockGzip)
    out = lines.select("value").write.format("blockgzip").mode("append")
    (out.option("header", header) if header else out).save(path)
