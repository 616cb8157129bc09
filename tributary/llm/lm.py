"""N-gram language-model scores from a sharded Elias-Fano trie with quantised smoothed probabilities.

Method. Each chunk of documents sends its distinct contexts and n-grams of each order from two on, with the n-grams'
counts in training documents, to the shard of their context. A shard adds up what all chunks send, smooths by absolute
discounting, quantises probabilities to one byte and builds a trie level for each order: contexts, monotone pointers,
and children's keys in Elias-Fano form in a mapped buffer (anonymous: files of one machine would not do on a cluster).
It answers the distinct n-grams of all chunks' lists by successor search on the compact form, within the context's
pointers and the places with the n-gram's high bits; each chunk gets its own list's answers and scores its documents.
No task holds the whole model; shards follow the input's size, so what is gathered grows with it.

Hot contexts (a frequent word or pair, the end of text) are found first, by the chunks' counts; their n-grams are dealt
by the last word too, so they are spread over all shards. Their totals are added up across shards, at most HOTTEST rows
an order, and go to all tasks; a shard answers their n-grams with counts, from a trie of its part.

Words are known by 60-bit hashes and their continuations by 40 bits of theirs; longer contexts by 48 bits and theirs by
28, as they are most of what is sent (a chance of about 1e-5 that one meets another's counts at 30 GB). A document's
context before its first word is the end of text; a longer context begins there at the earliest.

P(w | v) = max(c(v, w) - D, 0) / c(v) + D * T(v) / c(v) * P(w), with T(v) the distinct continuations of v, D = 0.75,
and P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)); after a context without counts, P(w). P(w | u v) is the
same with the counts of u v and P(w | v) in place of P(w), and so on for higher orders. The first term and the weight
of the lower order are quantised: log10 in steps of 1/30.

Cases. A null text counts as empty: one token, the end. A null doc_id counts as held out (the CRC of no text is 0).
Repeated rows count each. An empty table gives an empty result; without training documents N = V = 0 and every token
has probability 1. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.blobs import packed, unpacked
from tributary.llm.eliasfano import KEY_BITS, Trie
from tributary.llm.units import chunks, crc32_text, small_batches, words
from tributary.session import materialize, parts_for

CHUNK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
DISCOUNT = 0.75
#: Added to each unigram count.
ADDED = 0.1
#: Steps of the quantised log10 a unit; code 0 means none, code c a probability of 10 ** -((c - 1) / STEPS).
STEPS = 30
HASH_BITS, LONGER_BITS = 60, 48
HASH_MASK = (1 << HASH_BITS) - 1
#: Bits of a word's key as a longer context's continuation.
LONGER_KEY_BITS = 28
#: Hot contexts of an order at most: each has a share of the tokens of one in as many at least.
HOTTEST = 1 << 16
#: No word, as a word has no blank.
END = b" "


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log10(p) * STEPS) + 1
    return np.where(p > 0, np.clip(code, 1, 255), 0).astype(np.uint8)


LEVELS = np.concatenate(([0.0], 10.0 ** (-np.arange(255) / STEPS)))


def _child_keys(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)) & np.uint64((1 << KEY_BITS) - 1)


def _context_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts that are a word longer than those before."""
    x = before * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - LONGER_BITS)


def _spread(hashes: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Shards in the order of the hashes; below 2 ** 26 of them."""
    return (((hashes >> np.uint64(bits - 38)) * np.uint64(shards)) >> np.uint64(38)).astype(np.int32)


class Level:
    """The distinct n-grams of one order, in the order of their contexts' hashes, which is that of the shards too.

    Those of hot contexts stand apart, in the order of their own shards.
    """

    def __init__(self, hashes: np.ndarray, rank: np.ndarray, places: np.ndarray, before: np.ndarray, words: np.ndarray, by_key: tuple[np.ndarray, np.ndarray], shards: int, bits: int, keys: np.ndarray, hot: np.ndarray):
        """hashes: of the contexts, sorted; before: the context's rank at each of the places; words: the last word there.

        keys: of the words as continuations; hot: sorted hashes of hot contexts.
        """
        key_order, key_rank = by_key
        self.contexts, self.places = hashes, places.astype(np.int32)
        grams, gram_of = np.unique(rank[before] * len(key_rank) + key_rank[words], return_inverse=True)
        self.gram_of = gram_of.astype(np.int32)
        self.first, self.last = (grams // len(key_rank)).astype(np.int32), key_order[grams % len(key_rank)].astype(np.int32)
        at = np.searchsorted(hot, hashes)
        self.hot_at = np.where(np.append(hot, ~np.uint64(0))[at] == hashes, at, -1).astype(np.int32)
        is_hot = self.hot_at[self.first] >= 0
        self.cold_contexts, self.cold = np.flatnonzero(self.hot_at < 0), np.flatnonzero(~is_hot)
        self.shard = _spread(hashes[self.cold_contexts], bits, shards)
        self.keys = keys[self.last]
        own = np.flatnonzero(is_hot)
        to = _spread(_context_hashes(hashes[self.first[own]], self.keys[own]), LONGER_BITS, shards)
        order = np.argsort(to, kind="stable")
        self.hot, self.hot_shard = own[order], to[order]

    def present(self) -> np.ndarray:
        return np.union1d(self.shard, self.hot_shard)


class Chunk:
    """A chunk's tokens as codes, and its levels of n-grams from bigrams to the highest order."""

    def __init__(self, offsets: np.ndarray, codes: np.ndarray, hashes: np.ndarray, shards: int, highest: int, hot: list[np.ndarray]):
        """hashes: of the distinct words, the end last; codes: a document's words without the end; hot: of each order."""
        self.hashes, end = hashes, len(hashes) - 1
        n_docs = len(offsets) - 1
        places = np.arange(len(codes)) + np.repeat(np.arange(n_docs), np.diff(offsets))
        self.tokens = np.full(len(codes) + n_docs, end, np.int64)
        self.tokens[places] = codes
        self.offsets = offsets + np.arange(n_docs + 1)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.offsets[:-1]] = end
        key_order = np.argsort(_child_keys(hashes), kind="stable")
        by_key = key_order, _inverse(key_order)
        self.order = np.argsort(hashes, kind="stable")
        level = Level(hashes[self.order], _inverse(self.order), np.arange(len(self.tokens)), before, self.tokens, by_key, shards, HASH_BITS, _child_keys(hashes), hot[0])
        self.levels = [level]
        longer_keys = _child_keys(hashes) & np.uint64((1 << LONGER_KEY_BITS) - 1)
        key_order = np.argsort(longer_keys, kind="stable")
        by_key = key_order, _inverse(key_order)
        for n in range(highest - 2):
            # the n-grams that a word follows are the next order's contexts
            goes_on = self.tokens[level.places] != end
            longer = np.flatnonzero(level.last != end)
            own = _context_hashes(level.contexts[level.first[longer]], hashes[level.last[longer]])
            order = np.argsort(own, kind="stable")
            rank = np.zeros(len(level.last), np.int64)
            rank[longer[order]] = np.arange(len(order))
            places = level.places[goes_on] + 1
            level = Level(own[order], rank, places, level.gram_of[goes_on], self.tokens[places], by_key, shards, LONGER_BITS, longer_keys, hot[n + 1])
            self.levels.append(level)


def _inverse(order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _wide(numbers: np.ndarray) -> list[np.ndarray]:
    """High and low parts go apart, as most of the high ones are alike."""
    return [(numbers >> 8).astype(np.uint32), numbers.astype(np.uint8)]


def _keys_apart(keys: np.ndarray) -> list[np.ndarray]:
    return [(keys >> np.uint64(32)).astype(np.uint8), keys.astype(np.uint32)]


def _cells(level: Level, shards: np.ndarray, counts: np.ndarray) -> list[list[np.ndarray]]:
    """What each of the shards is sent of a level: the contexts' hashes as steps, their numbers of n-grams, keys, counts;
    then of hot contexts' n-grams the context's place among the hot ones, keys, counts.
    """
    sizes = np.bincount(level.first, minlength=len(level.contexts))[level.cold_contexts]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    keys, count, contexts = level.keys[level.cold], counts[level.cold], level.contexts[level.cold_contexts]
    hot_at, hot_keys, hot_count = level.hot_at[level.first[level.hot]], level.keys[level.hot], counts[level.hot]
    out = []
    for a, b, u, v in zip(*(np.searchsorted(where, shards, side) for where in (level.shard, level.hot_shard) for side in ("left", "right"))):
        step, own = np.diff(contexts[a:b], prepend=np.uint64(0)), slice(ends[a], ends[b])
        out.append([(step >> np.uint64(32)).astype(np.uint32), step.astype(np.uint32), *_wide(sizes[a:b]), *_keys_apart(keys[own]), *_wide(count[own]),
                    hot_at[u:v].astype(np.uint16), *_keys_apart(hot_keys[u:v]), *_wide(hot_count[u:v])])
    return out


#: Arrays of a level in a cell, those of contexts that are not hot first.
CELL, COLD = 13, 8


def _joined(asked: list[list[np.ndarray]], n: int) -> np.ndarray:
    return (np.concatenate([a[n] for a in asked]).astype(np.int64) << 8) | np.concatenate([a[n + 1] for a in asked])


def _joined_keys(asked: list[list[np.ndarray]], n: int) -> np.ndarray:
    return (np.concatenate([a[n] for a in asked]).astype(np.uint64) << np.uint64(32)) | np.concatenate([a[n + 1] for a in asked])


def _distinct(of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts' ranks, keys and counts of the distinct n-grams, in this order, and which of them each one is."""
    grams, which = np.unique((of.astype(np.uint64) << np.uint64(KEY_BITS)) | keys, return_inverse=True)
    n = np.bincount(which, counts, len(grams)).astype(np.int64)
    return (grams >> np.uint64(KEY_BITS)).astype(np.int64), grams & np.uint64((1 << KEY_BITS) - 1), n, which


def _answers(asked: list[list[np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Counts and codes of the contexts and codes of the n-grams for each chunk's list of one level, and all counts."""
    u64 = np.uint64
    hashes = [np.cumsum((a[0].astype(u64) << u64(32)) | a[1], dtype=u64) for a in asked]
    contexts, at = np.unique(np.concatenate(hashes), return_inverse=True)
    cuts = np.cumsum([0, *map(len, hashes)])
    every, keys, n_every, which = _distinct(np.repeat(at, _joined(asked, 2)), _joined_keys(asked, 4), _joined(asked, 6))
    trained = n_every > 0
    of, own_keys, n_gram = every[trained], keys[trained], n_every[trained]
    count, types = np.bincount(of, n_gram, len(contexts)), np.bincount(of, minlength=len(contexts))
    with np.errstate(divide="ignore", invalid="ignore"):
        backoff = quantised(np.where(types > 0, DISCOUNT * types / count, 0))
    trie = Trie.build(contexts, types, own_keys, backoff, quantised((n_gram - DISCOUNT) / count[of]))
    own = trie.find_contexts(contexts)
    place = trie.find_children(own, keys, every)  # once for all chunks that ask
    said = np.where(place >= 0, trie.probability[place] if trie.children.n else 0, 0).astype(np.uint8)[which]
    ends = np.cumsum([0, *(len(a[5]) for a in asked)])
    return [(count[at[x:y]].astype(np.int64), trie.backoff[own[at[x:y]]], said[u:v]) for x, y, u, v in zip(cuts, cuts[1:], ends, ends[1:])], count


def _hot_answers(asked: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[tuple[int, int, int]]]:
    """Counts of each chunk's n-grams of hot contexts, and (place, count, continuations) of the contexts in this shard."""
    every, keys, n_every, which = _distinct(np.concatenate([a[8] for a in asked]), _joined_keys(asked, 9), _joined(asked, 11))
    trained = n_every > 0
    of, own_keys, n_gram = every[trained], keys[trained], n_every[trained]
    contexts, rank = np.unique(of, return_inverse=True)
    types = np.bincount(rank, minlength=len(contexts))
    trie = Trie.build(contexts.astype(np.uint64), types, own_keys, np.zeros(len(contexts)), np.zeros(len(own_keys)))
    named, of_named = np.unique(every, return_inverse=True)
    place = trie.find_children(trie.find_contexts(named), keys, of_named)
    said = np.where(place >= 0, n_gram[place] if len(n_gram) else 0, 0).astype(np.int64)[which]
    ends = np.cumsum([0, *(len(a[8]) for a in asked)])
    totals = zip(contexts.tolist(), np.bincount(rank, n_gram, len(contexts)).astype(np.int64).tolist(), types.tolist())
    return [said[u:v] for u, v in zip(ends, ends[1:])], list(totals)


def hot_contexts(docs: DataFrame, order: int, shards: int) -> list[np.ndarray]:
    """Sorted hashes of each order's contexts with half a shard's share of the tokens, HOTTEST at most.

    A chunk tells of contexts with half that share of its own tokens; so one with the share of all is told of for half
    of its tokens at least, and none is missed.
    """
    share = max(0.5 / shards, 2 / HOTTEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, text in chunks(batches, CHUNK_BYTES):
            offsets, codes, names = words(text)
            n_docs, names = len(offsets) - 1, [*names, END]
            n_tokens = len(codes) + n_docs
            least = max(1.0, share * n_tokens / 2)
            many = np.flatnonzero(np.append(np.bincount(codes, minlength=len(names) - 1), n_docs) >= least)
            number = np.full(len(names), -1, np.int64)
            number[many] = np.arange(len(many))
            own = np.array([xxhash.xxh3_64_intdigest(names[i]) & HASH_MASK for i in many.tolist()], np.uint64)
            tokens = np.full(n_tokens, number[-1])
            tokens[np.arange(len(codes)) + np.repeat(np.arange(n_docs), np.diff(offsets))] = number[codes]
            before = np.concatenate(([number[-1]], tokens[:-1]))
            levels, hashes = [-1], [0]
            counts, context = [n_tokens], own
            at = np.flatnonzero(before >= 0)
            rank = before[at]  # of the contexts that are frequent here, at the places that they come before
            for n in range(order - 1):
                sums = np.bincount(rank, minlength=len(context))
                kept = np.flatnonzero(sums >= least)
                levels += [n] * len(kept)
                hashes += context[kept].tolist()
                counts += sums[kept].tolist()
                goes = (tokens[at] >= 0) & (tokens[at] != number[-1]) & (at + 1 < n_tokens)
                pair, where = np.unique(rank[goes] * max(1, len(many)) + tokens[at[goes]], return_inverse=True)
                at, rank = at[goes] + 1, where
                context = _context_hashes(context[pair // max(1, len(many))], own[pair % max(1, len(many))]) if len(pair) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array(hashes, pa.int64()), pa.array(counts, pa.int64())], names=["level", "hash", "n"])

    sums = docs.mapInArrow(run, "level int, hash long, n long").groupBy("level", "hash").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "lm-frequent")
    total = sums.where("level = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sums.where((F.col("level") >= 0) & (F.col("n") >= share / 2 * total)).select("level", "hash").toArrow()
    level, hashes = hot.column("level").to_numpy(), hot.column("hash").to_numpy().astype(np.uint64)
    return [np.sort(hashes[level == n]) for n in range(order - 1)]


HOT = pa.list_(pa.struct([("level", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("types", pa.int64())]))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_of: int = 10, order: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score by n-grams of the order."""
    small_batches(df)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = parts_for(docs, SHARD_BYTES, 24)
    hot = hot_contexts(docs, order, shards)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray]]:
        for number, ids, text in chunks(batches, CHUNK_BYTES):
            offsets, codes, names = words(text)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) & HASH_MASK for w in [*names, END]), np.uint64, len(names) + 1)
            yield number, ids.to_pylist(), offsets, codes, hashes

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, offsets, codes, hashes in cut(batches):
            c = Chunk(offsets, codes, hashes, shards, order, hot)
            trains = np.array([crc32_text(i) % held_out_of != 0 for i in ids])
            weight = np.repeat(trains, np.diff(c.offsets)).astype(np.int64)
            present = np.unique(np.concatenate([level.present() for level in c.levels]))
            cells = [_cells(level, present, np.bincount(level.gram_of, weight[level.places], len(level.last)).astype(np.int64)) for level in c.levels]
            del c
            blobs = [packed(*sum(cell, [])) for cell in zip(*cells)]
            yield pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array([number] * len(present), pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "chunk", "asked"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition, which is one shard."""
        held = [b for b in batches if b.num_rows]
        if held:
            yield from of_shard(pa.Table.from_batches(held)).to_batches()

    def of_shard(table: pa.Table) -> pa.Table:
        asked = [unpacked(b.as_py()) for b in table.column("asked")]
        own = [[a[n : n + CELL] for a in asked] for n in range(0, CELL * (order - 1), CELL)]
        cold, hot_ones = zip(*((_answers(level), _hot_answers(level)) for level in own))
        count = cold[0][1]
        # counts of contexts go back for words only
        out = [packed(*said[0], *(x for level in said[1:] for x in level[1:]), *hot_said) for *said, hot_said in zip(*(level for level, _ in cold), zip(*(level for level, _ in hot_ones)))]
        first = np.arange(len(out)) == 0
        totals = [{"level": n, "at": at, "n": c, "types": t} for n, (_, rows) in enumerate(hot_ones) for at, c, t in rows]
        return pa.table([table.column("shard"), table.column("chunk"), pa.array(out, pa.binary()), pa.array(np.where(first, int(count.sum()), 0)), pa.array(np.where(first, int((count > 0).sum()), 0)),
                         pa.array([totals if x else [] for x in first.tolist()], HOT)], names=["shard", "chunk", "answer", "trained", "known", "hot"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, offsets, codes, hashes in cut(batches):
            there = np.array([i is not None for i in ids])
            blob = packed(np.array([i or 0 for i in ids], np.int64), there, np.diff(offsets).astype(np.uint32), codes.astype(np.uint32), hashes)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "held"])

    answers = materialize(docs.mapInArrow(ask, "shard int, chunk long, asked binary").repartitionById(shards, F.col("shard")).mapInArrow(
        answer, "shard int, chunk long, answer binary, trained long, known long, hot array<struct<level: int, at: int, n: long, types: long>>"), "lm-answers")
    total = answers.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    sums = answers.select(F.explode("hot").alias("h")).select("h.*").groupBy("level", "at").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).toArrow()
    hot_n, hot_types = ([np.zeros(len(h), np.int64) for h in hot] for _ in range(2))
    for level, at, n, types in zip(*(sums.column(i).to_pylist() for i in range(4))):
        hot_n[level][at], hot_types[level][at] = n, types
    n_all, n_distinct = int(total[0]) + int(hot_n[0].sum()), int(total[1]) + int((hot_n[0] > 0).sum())
    floor = n_all + ADDED * (n_distinct + 1)

    def assemble(held: pa.Table, said: pa.Table) -> pa.Table:
        out = []
        by_shard = dict(zip(said.column("shard").to_pylist(), said.column("answer")))
        for blob in held.column("held"):
            ids, there, lengths, codes, hashes = unpacked(blob.as_py())
            c = Chunk(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), codes.astype(np.int64), hashes, shards, order, hot)
            present = np.unique(np.concatenate([level.present() for level in c.levels])).tolist()
            count, *codes_of = (np.concatenate(x) for x in zip(*(unpacked(by_shard[s].as_py()) for s in present)))
            hot_said = codes_of[len(codes_of) - len(c.levels) :]
            told = list(zip(c.levels, codes_of[::2], codes_of[1::2], hot_said, hot_n, hot_types))
            if any(len(b) != len(v.cold_contexts) or len(p) != len(v.cold) or len(h) != len(v.hot) for v, b, p, h, _, _ in told):
                raise ValueError("a chunk was cut differently when it was read again")
            words_level = c.levels[0]
            by_rank = np.empty(len(hashes), np.int64)
            by_rank[words_level.cold_contexts] = count
            by_rank[words_level.hot_at >= 0] = hot_n[0][words_level.hot_at[words_level.hot_at >= 0]]
            by_word = np.empty(len(hashes), np.int64)
            by_word[c.order] = by_rank
            base = (by_word + ADDED) / floor
            likely = base[c.tokens]
            for level, cold_backoff, cold_said, counted, all_n, all_types in told:
                backoff, probability = np.zeros(len(level.contexts), np.uint8), np.zeros(len(level.last), np.uint8)
                backoff[level.cold_contexts], probability[level.cold] = cold_backoff, cold_said
                is_hot = np.flatnonzero(level.hot_at >= 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    backoff[is_hot] = quantised(np.where(all_n > 0, DISCOUNT * all_types / all_n, 0))[level.hot_at[is_hot]]
                    probability[level.hot] = quantised(np.where(counted > 0, (counted - DISCOUNT) / all_n[level.hot_at[level.first[level.hot]]], 0))
                now = likely[level.places]
                now *= np.where(backoff > 0, LEVELS[backoff], 1.0)[level.first][level.gram_of]
                now += LEVELS[probability][level.gram_of]
                likely[level.places] = np.minimum(1.0, now)
            smooth = np.log10(likely)
            n = np.diff(c.offsets)
            plain, starts = np.log10(base)[c.tokens], c.offsets[:-1]
            out.append(pa.table([
                pa.array(ids, pa.int64(), mask=~there), pa.array([crc32_text(i if t else None) % held_out_of == 0 for i, t in zip(ids.tolist(), there.tolist())], pa.bool_()),
                pa.array(n, pa.int64()), pa.array(np.add.reduceat((by_word > 0)[c.tokens].astype(np.int64), starts), pa.int64()),
                pa.array(np.full(len(n), n_all), pa.int64()), pa.array(np.add.reduceat(plain, starts)), pa.array(np.add.reduceat(smooth, starts))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    held = docs.mapInArrow(hold, "chunk long, held binary")
    return held.groupBy("chunk").cogroup(answers.select("shard", "chunk", "answer").groupBy("chunk")).applyInArrow(
        assemble, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
