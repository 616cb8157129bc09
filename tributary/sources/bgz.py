"""Block-compressed text (.bgz) as a data source: parts of a file are tasks, and no cell holds a file.

A block is a gzip member of up to 64 KB whose header says how long it is, so a task finds the first block of its part of a
file by looking for a header whose length leads to another header. As with other split text, a task leaves out what
comes before the first line end of its part, if it isn't a file's first, and reads on to the end of the line that goes
over the part's end. A file whose members don't say their lengths is one task, read in pieces.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Compressed bytes a task; lines a batch; bytes of a block's text when written.
PART_BYTES, BATCH_LINES, BLOCK_BYTES = 16 << 20, 1 << 14, 0xFF00
#: How a member with extra fields begins, and the empty block that ends a file.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Line numbers of a task.
TASK_LINES = 1 << 33


def block_size(header: bytes) -> int | None:
    """How many bytes the member takes, by its extra field; None if it doesn't say."""
    if len(header) < 18 or not header.startswith(MAGIC):
        return None
    at, end = 12, 12 + struct.unpack_from("<H", header, 10)[0]
    while at + 4 <= min(end, len(header)):
        kind, size = header[at : at + 2], struct.unpack_from("<H", header, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(header):
            return struct.unpack_from("<H", header, at + 4)[0] + 1
        at += 4 + size
    return None


def compressed_block(text: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(text) + z.flush()
    return MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


class Blocks:
    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def header(self, at: int) -> int | None:
        self.file.seek(at)
        return block_size(self.file.read(64))

    def first(self, start: int) -> int | None:
        """Where the first block at or after a place begins."""
        self.file.seek(start)
        window = self.file.read(1 << 17)  # two blocks at least
        at = window.find(MAGIC)
        while at >= 0:
            size = block_size(window[at : at + 64])
            if size and (start + at + size == self.size or (start + at + size < self.size and self.header(start + at + size))):
                return start + at
            at = window.find(MAGIC, at + 1)
        return None

    def texts(self, start: int) -> Iterator[tuple[int, bytes]]:
        """(place, text) of the blocks from a place on."""
        while start < self.size:
            self.file.seek(start)
            piece = self.file.read(1 << 16)
            size = block_size(piece)
            if size is None:
                raise ValueError(f"no block at {start}")
            yield start, zlib.decompress(piece[:size], 31)
            start += size


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The text of gzip members, one after another, from pieces of the file; each byte is looked at a bounded number of times."""
    z = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            if z.eof:
                z = zlib.decompressobj(31)
            yield z.decompress(piece)
            piece = z.unused_data


def whole_lines(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Lines of texts that go on in each other; the last one need not end."""
    held: list[bytes] = []
    for text in texts:
        first, *rest = text.split(b"\n")
        held.append(first)
        if rest:
            yield [b"".join(held), *rest[:-1]]
            held = [rest[-1]]
    if last := b"".join(held):
        yield [last]


def batches(lines: Iterator[list[bytes]], number: int) -> Iterator[pa.RecordBatch]:
    """(line_no, line) of a task's lines."""
    at, held = number * TASK_LINES, []

    def batch() -> pa.RecordBatch:
        own = [x.removesuffix(b"\r").decode(errors="replace") for x in held]
        return pa.RecordBatch.from_arrays([pa.array(range(at, at + len(own)), pa.int64()), pa.array(own, pa.string())], names=["line_no", "line"])

    for some in lines:
        held += some
        if len(held) >= BATCH_LINES:
            yield batch()
            at, held = at + len(held), []
    if held:
        yield batch()


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int | None
    number: int


def part_texts(blocks: Blocks, start: int, stop: int) -> Iterator[bytes]:
    """The text of the lines that are a part's."""
    at = start if start == 0 else blocks.first(start)
    if at is None or at >= stop:
        return
    skipping = start > 0
    for place, text in blocks.texts(at):
        if place >= stop:
            if skipping:  # no line begins in this part
                return
            if (end := text.find(b"\n")) >= 0:
                yield text[:end]
                return
        if skipping:
            if (end := text.find(b"\n")) < 0:
                continue
            text, skipping = text[end + 1 :], False
        yield text


class BgzReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Part]:
        store, place = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(place)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else [f for f in store.get_file_info(fs.FileSelector(place, recursive=True)) if f.is_file and f.path.endswith(".bgz")]
        out: list[Part] = []
        for f in sorted(files, key=lambda f: f.path):
            with store.open_input_file(f.path) as file:
                told = block_size(file.read(64)) is not None
            cuts = range(0, f.size, self.part_bytes) if told else [0]
            out += [Part(f.path, start, min(f.size, start + self.part_bytes) if told else None, len(out) + n) for n, start in enumerate(cuts)]
        return out or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as file:
            if partition.stop is None:
                texts = members(iter(lambda: file.read(1 << 18), b""))
            else:
                texts = part_texts(Blocks(file), partition.start, partition.stop)
            yield from batches(whole_lines(texts), partition.number)


@dataclass
class Written(WriterCommitMessage):
    kept: str
    held: str


class BgzWriter(DataSourceArrowWriter):
    """Files of blocks; they get their names when all tasks are done, so one that ran twice leaves one file."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, place = fs.FileSystem.from_uri(self.path)
        store.create_dir(place)
        number, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        held = f"{place}/.part-{number:05d}-{name}"
        with store.open_output_stream(held) as out:
            rest = b""
            for batch in iterator:
                rest += "".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode()
                whole = len(rest) // BLOCK_BYTES * BLOCK_BYTES
                for at in range(0, whole, BLOCK_BYTES):
                    out.write(compressed_block(rest[at : at + BLOCK_BYTES]))
                rest = rest[whole:]
            if rest:
                out.write(compressed_block(rest))
            out.write(END)
        return Written(f"{place}/part-{number:05d}-{name}.bgz", held)

    def commit(self, messages: list[Written | None]) -> None:
        store, place = fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                if f.is_file and f.path.endswith(".bgz"):
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(m.held, m.kept)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.held)


class BgzSource(DataSource):
    """format("bgz"): lines of a file or of a folder's files; option part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "bgz"

    def schema(self) -> str:
        return "line_no bigint, line string"

    def reader(self, schema: StructType) -> BgzReader:
        return BgzReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> BgzWriter:
        return BgzWriter(self.options["path"], overwrite)
