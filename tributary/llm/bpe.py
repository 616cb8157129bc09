"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Method. Each chunk of documents explodes its texts into pre-tokens with positions and keeps the positions as codes
into its own list of distinct pre-tokens. The distinct pre-tokens of all chunks are shuffled by their hash, so that
every distinct one in the corpus meets in one place and is encoded once. The ids are joined back to the chunks, which
reassemble their documents by position. Decoding joins the ids with the token-byte table.

What is shuffled is a cell for each chunk and shard, not a row for each position: a word that fills a third of the
corpus is one entry in a chunk's list. A shard holds the distinct words of its hash range only; the number of shards
follows the input's size.

Cases. A null text counts as empty: no ids. Repeated rows give repeated results. An empty table gives an empty result.
Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.blobs import joined_bytes, packed, split_bytes, unpacked
from tributary.llm.units import chunks, gathered, small_batches
from tributary.session import parts_for

CHUNK_BYTES = 4 << 20
SHARD_BYTES = 8 << 20


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: its size is that of the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    return {v: k for k, v in ranks(path).items()}


def _pretokens(text: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each document's number of pre-tokens, the pre-tokens' codes, and the distinct pre-tokens in the order of their codes."""
    import regex

    find = regex.compile(pattern).findall
    names: dict[str, int] = {}
    counts, codes = [], []
    for t in text:
        own = [names.setdefault(p, len(names)) for p in find(t.as_py())]
        counts.append(len(own))
        codes.append(np.array(own, np.uint32))
    return np.array(counts, np.uint32), np.concatenate(codes) if codes else np.zeros(0, np.uint32), [p.encode() for p in names]


def _distinct(text: pa.Array, pattern: str) -> list[bytes]:
    """The distinct pre-tokens alone, in the same order."""
    import regex

    find = regex.compile(pattern).findall
    names: dict[str, None] = {}
    for t in text:
        names.update(dict.fromkeys(find(t.as_py())))
    return [p.encode() for p in names]


def _shards(pretokens: list[bytes], shards: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(p) for p in pretokens), np.int64, len(pretokens)) % shards


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if kept, ids and decoded text bytes."""
    small_batches(df)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = parts_for(docs, SHARD_BYTES, 24)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, text in chunks(batches, CHUNK_BYTES):
            pretokens = _distinct(text, pattern)
            shard = _shards(pretokens, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            groups = [g for g in np.split(order, cuts) if len(g)]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(shard[g[0]]) for g in groups], pa.int32()), pa.array([number] * len(groups), pa.int64()),
                pa.array([packed(*joined_bytes([pretokens[i] for i in g])) for g in groups], pa.binary())],
                names=["shard", "chunk", "asked"])

    def answer(table: pa.Table) -> pa.Table:
        encode, known, out = encoding(ranks_path, pattern)._encode_single_piece, {}, []
        for blob in table.column("asked"):
            ids: list[list[int]] = []
            for word in split_bytes(*unpacked(blob.as_py())):
                got = known.get(word)
                if got is None:
                    got = known[word] = encode(word)
                ids.append(got)
            flat = np.fromiter((i for x in ids for i in x), np.uint32)
            out.append(packed(np.fromiter(map(len, ids), np.uint32, len(ids)), flat.astype(np.uint16) if flat.max(initial=0) < 65536 else flat))
        return pa.table([table.column("shard"), table.column("chunk"), pa.array(out, pa.binary())], names=["shard", "chunk", "answer"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, text in chunks(batches, CHUNK_BYTES):
            counts, codes, pretokens = _pretokens(text, pattern)
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            blob = packed(ids.fill_null(0).to_numpy(zero_copy_only=False), there, counts,
                          codes.astype(np.uint16), (codes >> 16).astype(np.uint16), _shards(pretokens, shards).astype(np.uint32))  # codes in two parts, as most of the high ones are 0
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "held"])

    def assemble(held: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for blob in held.column("held"):
            ids, there, counts, low, high, shard = unpacked(blob.as_py())
            codes = (high.astype(np.int64) << 16) | low
            said = {int(s): unpacked(a.as_py()) for s, a in zip(answers.column("shard").to_pylist(), answers.column("answer"))}
            lengths, flats = np.zeros(len(shard), np.int64), []
            order = np.argsort(shard, kind="stable")
            at = 0
            for s in np.unique(shard).tolist():
                n, flat = said[s]
                lengths[order[at : at + len(n)]] = n
                flats.append(flat.astype(np.uint32))
                at += len(n)
            if at != len(order):
                raise ValueError("a chunk was cut differently when it was read again")
            flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
            in_order = np.concatenate(([0], np.cumsum(lengths[order])))
            first = np.empty(len(order) + 1, np.int64)
            first[order], first[-1] = in_order[:-1], in_order[-1]
            starts = np.concatenate(([0], np.cumsum(lengths)))
            words = gathered(flat, in_order, np.argsort(order))[0]  # ids by pre-token, in the chunk's order
            table = token_bytes(ranks_path)
            every, e = words.tolist(), starts.tolist()
            listed_ids = [",".join(map(str, every[a:b])) for a, b in zip(e, e[1:])]
            raws = [b"".join([table[i] for i in every[a:b]]) for a, b in zip(e, e[1:])]
            at = 0
            for doc, known, n in zip(ids.tolist(), there.tolist(), counts.tolist()):
                own = codes[at : at + n]
                at += n
                listed = own.tolist()
                raw = b"".join([raws[c] for c in listed])
                row = (doc if known else None, int(lengths[own].sum()),
                       hashlib.sha256(",".join([listed_ids[c] for c in listed]).encode()).hexdigest(),
                       hashlib.sha256(raw).hexdigest())
                rows.append((*row, gathered(words, starts, own)[0].astype(np.int32), raw) if keep_ids else row)
        columns = list(zip(*rows)) or [()] * (6 if keep_ids else 4)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[: len(columns)])

    asked = docs.mapInArrow(ask, "shard int, chunk long, asked binary")
    answers = asked.groupBy("shard").applyInArrow(answer, "shard int, chunk long, answer binary")
    held = docs.mapInArrow(hold, "chunk long, held binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids
    return held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, schema)
