"""Importance resampling of documents towards a target distribution, by a vectorised byte automaton.

Method. The bytes of a run of texts' Arrow buffer are classed by a lookup table, and words lie between the differences of
that class. The CRC-32s of all words are advanced together, a byte of each at a step, by the table of the CRC; those of
pairs go on from the first word's state over a blank and the second word. A feature's bucket is its CRC modulo BUCKETS.
Counts of the buckets in all documents and in the target give each bucket a gain, a document's weight is the floored mean
gain of its features, and the documents with the highest sums of weight and Gumbel noise are drawn.

Texts are read twice, for the counts and for the weights, and never shuffled: a task sends BUCKETS sums at most, the driver
gets BUCKETS sums, and the drawn rows' places come from ranges of the scores (ranks.py).

Cases. A null or empty text has no words, no features and weight 0. Words are runs of a-z (A-Z lower-cased), 0-9 and bytes
of characters beyond ASCII; a word of any length is one word. Repeated rows are rows each, and count and may be drawn each.
A null id has the noise of an empty id and comes last among ties. Without a target the gains are those of a target without
features. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.ranks import placed
from tributary.llm.units import chunks, mapped, small_batches
from tributary.session import materialize

BUCKETS = 10_000
CHUNK_BYTES = 4 << 20
#: Steps that all words take together; what is left of longer words goes on by itself.
STEPS = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words in lower-cased text: 0-9, a-z, and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def crc_table() -> np.ndarray:
    """What a byte does to a CRC-32's state."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = crc_table()


def cut(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' lower-cased bytes, where their words begin and end in them, and each text's first word's number (and an end)."""
    lowered = mapped(text, LOWER)
    if not len(lowered):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    offsets = np.frombuffer(lowered.buffers()[1], np.int64)[: len(lowered) + 1]
    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    inside = WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first, last = offsets[:-1], offsets[1:]
    first, last = first[first < len(data)], last[last > 0] - 1
    begins[first] = inside[first]  # a word ends with its text
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC states after the bytes from starts on, all of them a byte at a step."""
    order = np.argsort(np.minimum(lengths, STEPS).astype(np.uint16), kind="stable")[::-1]
    at, length, out = starts[order], lengths[order], state[order]
    counts = np.bincount(np.minimum(length, STEPS), minlength=STEPS + 1)
    active = len(length) - np.cumsum(counts)  # how many are longer than j
    for j in range(STEPS):
        n = int(active[j])
        if not n:
            break
        own = out[:n]
        out[:n] = CRC[(own ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
    for i in np.flatnonzero(length[: int(counts[STEPS])] > STEPS).tolist():
        rest = data[at[i] + STEPS : at[i] + length[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(text: pa.LargeStringArray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, of all pairs of neighbours, the text that each pair lies in, and each text's first word's number."""
    data, starts, ends, first = cut(text)
    lengths = ends - starts
    one = advanced(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, lengths)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    paired = np.flatnonzero(of[1:] == of[:-1])
    blank = CRC[(one[paired] ^ np.uint32(32)) & np.uint32(0xFF)] ^ (one[paired] >> np.uint32(8))
    two = advanced(blank, data, starts[paired + 1], lengths[paired + 1])
    return (~one % np.uint32(buckets)).astype(np.int64), (~two % np.uint32(buckets)).astype(np.int64), of[paired], first


def counted(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket; texts: (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for _, _, text in chunks(batches, CHUNK_BYTES):
            one, two, _, _ = features(text, buckets)
            sums += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], names=["bucket", "n"])

    found = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to raw by bucket, with one feature more in each, rounded down."""
    n = len(raw)
    all_raw, all_target = float(int(raw.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(1000 * math.log((t + 1) * all_raw / ((s + 1) * all_target))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, text in chunks(batches, CHUNK_BYTES):
            one, two, of, first = features(text, len(gain))
            n = np.diff(first)
            sums = np.diff(np.concatenate(([0], np.cumsum(gain[one])))[first])
            np.add.at(sums, of, gain[two])
            n_features = n + np.maximum(n - 1, 0)
            weight = np.where(n_features > 0, sums // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(df: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS,
             id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank, null where a document isn't drawn.

    Drawn are percent of the documents of least_words words or more, rounded down.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs)
    wanted = target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col).cast("string").alias("text"))
    rows = weighed(docs, gains(counted(docs, buckets), counted(wanted, buckets)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    rows = materialize(rows.withColumn("score", F.col("weight") + noise), "weighed")
    able = F.col("n_words") >= least_words
    in_order = placed(rows.where(able), [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    drawn = F.when(F.col("rank") <= rows.where(able).count() * percent // 100, F.col("rank"))
    none = rows.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return in_order.withColumn("rank", drawn.cast("long")).unionByName(none)
