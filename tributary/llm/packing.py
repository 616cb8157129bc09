"""Bounded-space online packing of token ids into fixed windows.

Method. Each input partition keeps a fixed number of open windows. A document first fills whole windows; what remains
goes where it fits best, that is into the open window with the least room that still holds it. When none fits, the
fullest window is emitted, topped up with a cut of the remainder if its room is worth a cut. At a partition's end its
open windows are merged into full ones and at most one leftover; leftovers of different partitions are merged by
best fit decreasing, in groups of partitions, so that no task sees more than a group's leftovers.

A task holds one document, HELD finished pieces and its open windows only.

Cases. A null text counts as empty and still has its end id. Repeated rows are packed as documents of their own. An
empty table gives no pieces. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.bpe import encoding
from tributary.session import materialize

WINDOW = 1024
OPEN_WINDOWS = 32
#: Room below which the fullest window is emitted as it is, with padding.
WORTH_A_CUT = 8
#: Partitions whose leftovers are merged together.
MERGED = 64
#: Pieces that a task holds before it hands them on.
HELD = 4096

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
KINDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> tuple[str, ...]:
    """The strings that the tokenizer file keeps whole."""
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


class Tokens:
    """Ids of whole texts as the tokenizer file gives them.

    A text is encoded by the same vocabulary's rank file where there is one; the tokenizer itself is loaded only for a
    text with a special token's string.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str, specials: tuple[str, ...]):
        self.path, self.specials = json_path, specials
        self.fast = encoding(ranks_path, pattern).encode_ordinary if ranks_path else None

    def ids(self, text: str) -> list[int]:
        if self.fast and not any(s in text for s in self.specials):
            return self.fast(text)
        return tokenizer(self.path).encode(text, add_special_tokens=False).ids


class Packer:
    """The open windows of one partition; rows() takes what is ready: full windows' pieces."""

    def __init__(self, first_sequence: int, size: int = WINDOW, windows: int = OPEN_WINDOWS):
        self.size, self.windows, self.next = size, windows, first_sequence
        self.open: list[list] = []  # [used, [(doc_id, start, ids, doc_tokens), ...]]
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self.emit([(doc, start, ids[start : start + self.size], total)])
            start += self.size
        while start < total:
            start = self.place(doc, start, ids, total)

    def place(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> int:
        need = total - start
        fits = [w for w in self.open if self.size - w[0] >= need]
        if fits:
            best = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.windows:
            best = [0, []]
            self.open.append(best)
        else:
            best = max(self.open, key=lambda w: w[0])
            room = self.size - best[0]
            if room >= WORTH_A_CUT:
                need = room
            else:
                self.open.remove(best)
                self.emit(best[1])
                return start
        best[0] += need
        best[1].append((doc, start, ids[start : start + need], total))
        if best[0] == self.size:
            self.open.remove(best)
            self.emit(best[1])
        return start + need

    def merge(self) -> list[tuple]:
        """The open windows merged into full ones; the pieces of the one that is left."""
        used, pieces = 0, []
        for _, own in sorted(self.open, key=lambda w: -w[0]):
            for doc, start, ids, total in own:
                while len(ids) >= self.size - used:
                    room = self.size - used
                    self.emit([*pieces, (doc, start, ids[:room], total)])
                    used, pieces, start, ids = 0, [], start + room, ids[room:]
                if len(ids):
                    pieces.append((doc, start, ids, total))
                    used += len(ids)
        self.open = []
        return pieces


def pack(df: DataFrame, json_path: str, ranks_path: str | None, pattern: str, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: PIECES. Each id of each document lies in exactly one piece."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    specials = special_strings(json_path)

    def batch(rows: list[tuple], part: int, left: bool) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(KINDS)
        arrays = [pa.array(c, k) for c, (_, k) in zip(columns, KINDS)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int32()), pa.array([left] * len(rows), pa.bool_())],
                                          names=[n for n, _ in KINDS] + ["part", "is_left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = Tokens(json_path, ranks_path, pattern, specials), TaskContext.get().partitionId()
        packer = Packer(part << 36)
        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                ids = tokens.ids(text.as_py() or "")
                ids.append(end_id)
                packer.add(doc, np.array(ids, "<u4"))
                if len(packer.out) >= HELD:
                    yield batch(packer.out, part, False)
                    packer.out = []
        left = packer.merge()
        yield batch(packer.out, part, False)
        yield batch([(d, s, len(x), zlib.crc32(x.tobytes()), t, 0, 0) for d, s, x, t in left], part, True)

    def merge(group: pa.Table) -> pa.Table:
        """Best fit decreasing over the leftovers' pieces."""
        rows = sorted(group.to_pylist(), key=lambda r: (-r["length"], r["part"], r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
        room: list[int] = []
        first = (1 << 62) + (rows[0]["part"] // MERGED << 20)
        for row in rows:
            fits = [w for w, r in enumerate(room) if r >= row["length"]]
            w = min(fits, key=room.__getitem__) if fits else len(room)
            if not fits:
                room.append(WINDOW)
            row |= {"sequence_id": first + w, "offset": WINDOW - room[w]}
            room[w] -= row["length"]
        return pa.table([pa.array([r[n] for r in rows], k) for n, k in KINDS], names=[n for n, _ in KINDS])

    pieces = materialize(docs.mapInArrow(run, f"{PIECES}, part int, is_left boolean"), "pieces")
    left = pieces.where("is_left").groupBy(F.expr(f"part div {MERGED}").alias("merged")).applyInArrow(merge, PIECES)
    return pieces.where("not is_left").drop("part", "is_left").unionByName(left)
