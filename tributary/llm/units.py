"""Arrow-side text cutting shared by the Python operators: chunks of documents, space-separated units, codes.

A chunk is a run of documents of one input partition of about a given number of bytes. Inside a chunk the texts are
cut into units and dictionary-coded by Arrow, so Python looks at each distinct unit once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes of the contracts' white space, [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"

#: Maps white space to a blank and A-Z to a-z, byte by byte; other bytes stay, so UTF-8 stays valid.
LOWER_BLANK = np.arange(256, dtype=np.uint8)
LOWER_BLANK[list(SPACES)] = 32
LOWER_BLANK[65:91] += 32


#: Rows an Arrow batch, where the session has not chosen another number than Spark's: texts are long.
BATCH_ROWS, SPARK_ROWS = 1000, "10000"


def small_batches(df: DataFrame) -> None:
    """Lets executors hand texts to Python in batches of BATCH_ROWS."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name, SPARK_ROWS) == SPARK_ROWS:
        conf.set(name, str(BATCH_ROWS))


def chunks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(chunk number, doc_id, text with nulls as empty) for runs of about most_bytes; a longer text stands alone.

    The number holds the input partition, so it is the same each time that the partition is read.
    """
    number = TaskContext.get().partitionId() << 24
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> tuple[int, pa.Array, pa.Array]:
        ids, texts = (pa.concat_arrays([part.column(i) if i == 0 else part.column(i).cast(pa.large_string()) for part in held]) for i in range(2))
        return number, ids, pc.fill_null(texts, "")

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            below = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, below + most_bytes - size, "right"))
            if stop == start and not held:
                stop += 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - below
                start = stop
            if start < batch.num_rows:  # the next text doesn't fit
                yield joined()
                number, held, size = number + 1, [], 0
    if held:
        yield joined()
    pa.default_memory_pool().release_unused()


def mapped(text: pa.LargeStringArray, table: np.ndarray) -> pa.LargeStringArray:
    """The texts with every byte replaced by the table's; the table must keep UTF-8 valid."""
    if not len(text):
        return text
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(table[data]))


def coded(parts: pa.LargeListArray | pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each document's pieces, their codes, and the distinct pieces that the codes stand for."""
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    return offsets - offsets[0], flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary


def words(text: pa.LargeStringArray, table: np.ndarray = LOWER_BLANK) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words between blanks of the mapped text, by default lower-cased (A-Z) ones between white space: document offsets, codes, distinct words."""
    offsets, codes, distinct = coded(pc.split_pattern(mapped(text, table), " "))
    names = distinct.cast(pa.large_binary()).to_pylist()
    if b"" in names:  # what stands between two blanks
        empty = names.index(b"")
        keep = codes != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
        codes -= codes > empty
        names.pop(empty)
    return offsets, codes, names


def gathered(values: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[starts[c]:starts[c + 1]] one after another for c in codes, and where each begins."""
    lengths = (starts[1:] - starts[:-1])[codes]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    index = np.repeat(starts[:-1][codes] - ends[:-1], lengths) + np.arange(ends[-1])
    return values[index], ends


def crc32_text(number: int | None) -> int:
    """CRC-32 of an integer's decimal text; 0 for none."""
    return zlib.crc32(b"" if number is None else str(number).encode())
