"""Near-duplicate documents by MinHash and an LSH forest, with links confirmed on full shingle sets.

Method. Documents with equal shingle sets are one class. A class's signature is read in TREES orders; in each tree
classes with a common prefix of DEPTH values are neighbours. Where a region of a tree holds more than REGION classes,
its classes are sorted anew by ORDERS other orders of the signature's values, whose prefixes grow through DEEPER until
the regions are small enough; one that never is (nearly equal signatures) is cut into runs, and every run holds the
region's smallest class. All classes of a crowded region also are candidates with its hubs, the smallest class and that
with most copies, where they agree, as near copies are mostly those of one text. Within a region the candidates are the edges of a spanning forest of the best signature
agreement, of at least AGREES. Each class's best edge is confirmed on full sets first, then those that lie between the
components that the first ones give.

A second pass makes up for what the forests left out: in every region, classes of different components that agree are
compared on full sets in the region's task; what leaves it is links between components. So no agreeing pair that
shares a region stays unconfirmed between two components. A class takes part in a stated number of regions of bounded
size, so both passes are linear in the classes.

A third pass makes up for crowded regions, exactly: the classes of those that still lie in several components are joined
by prefixes of their full sets. With the shingles of all sets in one order, rare ones first, two similar sets share one
so early that enough may follow it in both (the larger set's share 1 - PERCENT of it, the smaller one's less). Pairs of
different components that share such a shingle, and whose sizes and places let them be similar, are confirmed on full
sets. The order comes from counts of a sample, which bear on the number of candidates and not on what is found.

The chance that a pair of similarity 0.8 shares no region in any tree is (1 - 0.8 ** DEPTH) ** TREES < 1e-6, and that
its agreement over VALUES values falls below AGREES about 1e-6. A pair that shares a crowded region is found for certain.

Shuffled are a key of 8 bytes and a signature of VALUES bytes for each class and tree, and the sets of classes with
candidates or in crowded regions. The documents' texts are never shuffled: those are told by a bitmap of at most MOST_BITS.

Cases. Empty sets (null text, no words) link with nothing. A null doc_id takes part in nothing: its component is null
and it is kept. Rows that repeat a doc_id count as one document with several texts. Repeated rows give repeated
results; an empty table gives none. Columns other than the id and the text are ignored by `find`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.components import components
from tributary.llm.units import chunks, words
from tributary.session import materialize

TREES, DEPTH = 20, 3
VALUES = TREES * DEPTH
REGION = 1024
#: Other orders of a crowded region, and the lengths of their prefixes.
ORDERS, DEEPER = 8, (6, 12, 18, 30)
AGREES = 0.55
PERCENT = 80
CHUNK_BYTES = 4 << 20
#: Bits of the bitmap of documents whose sets are wanted: 16 MB.
MOST_BITS = 1 << 27
#: Crowded keys that are broadcast; with more, the join is left to the optimizer.
BROADCAST_KEYS = 1 << 18
#: Sets whose shingles are counted for their order, and the shingles that go by their counts.
COUNTED_SETS, COUNTED = 1 << 14, 1 << 17
#: Rows of one frequent shingle that go to one task, about.
SPLIT_ROWS = 1 << 18
#: Pairs that a task holds before it hands them on.
PAIRS_AT_ONCE = 1 << 20

_rng = np.random.default_rng(20240229)
_LOW, _HIGH, _ADD = (_rng.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1) for _ in range(3))
_ORDERS = [_rng.permutation(VALUES) for _ in range(ORDERS)]
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M3
    return h ^ (h >> np.uint64(29))


def shingles(offsets: np.ndarray, codes: np.ndarray, hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The set of each document: sorted distinct hashes of its runs of `size` words, or of all its words if fewer."""
    out = []
    word = hashes[codes]
    n_all = len(word)
    whole = np.zeros(max(0, n_all - size + 1), np.uint64)
    for k in range(size):
        whole = _mixed(whole * _M1 + word[k : k + len(whole)] * _M2 + np.uint64(k + 1))
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(a, b):
                short = _mixed(short * _M1 + word[k : k + 1] * _M2 + np.uint64(1000 + k - a))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """VALUES minima of linear hashes of both halves of each shingle."""
    low, high = s.astype(np.uint32)[:, None], (s >> np.uint64(32)).astype(np.uint32)[:, None]
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 4096):
        best = np.minimum(best, (low[at : at + 4096] * _LOW + high[at : at + 4096] * _HIGH + _ADD).min(axis=0))
    return best


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for _, ids, text in chunks(batches, CHUNK_BYTES):
        offsets, codes, names = words(text)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        yield ids, shingles(offsets, codes, hashes, size)


def _keys(signatures: np.ndarray) -> np.ndarray:
    """A 63-bit key of each tree's prefix of DEPTH values, a row a signature."""
    out = np.empty((len(signatures), TREES), np.int64)
    for tree in range(TREES):
        key = np.full(len(signatures), tree, np.uint64)
        for i in range(tree * DEPTH, (tree + 1) * DEPTH):
            key = _mixed(key * _M1 + signatures[:, i].astype(np.uint64))
        out[:, tree] = key >> np.uint64(1)
    return out


def _short(signatures: np.ndarray) -> np.ndarray:
    """One byte of each value: unlike values have the same one in 256."""
    return ((signatures * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Signatures of a byte a value."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches sorted by the key; several runs a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1]))  # where the last run begins
        if cut == 0 and (not held or held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == k[-1]):
            held.append(batch)
            continue
        if cut or held:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(keys)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]))


def forest(signatures: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the best agreement, of at least AGREES."""
    n = len(signatures)
    best, link, out = np.full(n, -1.0), np.zeros(n, np.int64), []
    todo = np.ones(n, bool)
    now = 0
    for _ in range(n - 1):
        todo[now] = False
        agree = (signatures == signatures[now]).mean(axis=1)
        better = todo & (agree > best)
        best[better], link[better] = agree[better], now
        best[now] = -2.0
        now = int(np.argmax(best))
        if best[now] >= AGREES:
            out.append((int(link[now]), now))
    return out


def _keyed(classes: DataFrame) -> DataFrame:
    """(rid, sig, copies, turn, key) of the first depth, for every class and tree."""
    none = F.lit(0).cast("byte").alias("turn")
    return classes.select("rid", "sig", "copies", none, F.explode("keys").alias("key"))


def _deeper(rows: DataFrame, level: int) -> DataFrame:
    """The rows of crowded regions with keys of longer prefixes: at first of all ORDERS, then of the row's own."""
    start, stop = (0, *DEEPER)[level], DEEPER[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig, own, key = _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(np.uint64)
                for turn in range(1, ORDERS + 1):
                    at = np.arange(batch.num_rows) if level == 0 else np.flatnonzero(own == turn)
                    deep = _mixed(key[at] * _M2 + np.uint64(turn))
                    for i in _ORDERS[turn - 1][start:stop].tolist():
                        deep = _mixed(deep * _M1 + sig[at, i].astype(np.uint64))
                    kept = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*kept.columns[:2], pa.array(np.full(len(at), turn, np.int8)), pa.array((deep >> np.uint64(1)).astype(np.int64))], names=batch.schema.names)

    return rows.select("rid", "sig", "turn", "key").mapInArrow(run, "rid long, sig binary, turn byte, key long")


def _hub_pairs(rows: DataFrame, hubs: DataFrame, few: bool) -> DataFrame:
    """The candidates of crowded regions' rows with their hubs, where they agree: a < b and their agreement."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1).astype(np.int8)
            one = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(agree)], names=["a", "b", "agree"])
            yield one.filter(pa.array(agree >= AGREES * VALUES))

    met = rows.select("rid", "sig", "key").join(F.broadcast(hubs) if few else hubs, "key").withColumn("hub", F.explode(F.array("first", "most"))).where("hub.rid <> rid")
    return met.select(F.least("rid", "hub.rid").alias("a"), F.greatest("rid", "hub.rid").alias("b"), "sig", F.col("hub.sig").alias("of")).mapInArrow(run, "a long, b long, agree byte")


class Forest:
    """The regions of all classes; what is found of crowded ones is a small table a level."""

    def __init__(self, classes: DataFrame):
        self.levels: list[tuple[DataFrame, bool]] = []
        rows = _keyed(classes)
        for level in range(len(DEEPER) + 1):
            crowded = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > REGION), "crowded")
            n = crowded.count()
            if not n:
                break
            self.levels.append((crowded, n <= BROADCAST_KEYS))
            rows = self._split(rows, level)[1]
            if level == 0:
                own = F.struct("rid", "sig")
                hubs = materialize(rows.groupBy("key").agg(F.min_by(own, "rid").alias("first"), F.max_by(own, F.struct("copies", -F.col("rid"))).alias("most")), "hubs")
                self.hub_pairs = _hub_pairs(rows, hubs, n <= BROADCAST_KEYS >> 3)
            if level < len(DEEPER):
                rows = _deeper(rows, level)
            else:
                self.hubs = materialize(rows.groupBy("key").agg(F.min_by(F.struct("rid", "sig"), "rid").alias("hub")), "hubs")

    def _split(self, rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        crowded, few = self.levels[level]
        marked = rows.join(F.broadcast(crowded) if few else crowded, "key", "left")
        return marked.where("n is null").drop("n"), marked.where("n is not null")

    def crowded(self, classes: DataFrame) -> DataFrame:
        """(rid, key) of the classes in crowded regions of the first depth."""
        return self._split(_keyed(classes).select("rid", "key"), 0)[1].select("rid", "key")

    def regions(self, classes: DataFrame) -> DataFrame:
        """(rid, sig, key) of the classes: rows of one key are a region, of REGION classes at most."""
        columns = ("rid", "sig", "key")
        rows, out = _keyed(classes), []
        for level in range(len(self.levels)):
            small, rows = self._split(rows, level)
            out.append(small.select(*columns))
            if level < len(DEEPER):
                rows = _deeper(rows, level)
            else:  # runs that share the smallest class
                runs = F.ceil(F.col("n") / (REGION / 2)).cast("long")
                cut = rows.select("rid", "sig", F.xxhash64("key", F.pmod(F.xxhash64("rid"), runs)).alias("key"))
                each = self.levels[level][0].join(self.hubs, "key").select("hub", "key", F.explode(F.sequence(F.lit(0).cast("long"), runs - 1)).alias("run"))
                rows = cut.unionByName(each.select("hub.rid", "hub.sig", F.xxhash64("key", "run").alias("key")))
        out.append(rows.select(*columns))
        every = out[0]
        for one in out[1:]:
            every = every.unionByName(one)
        return every


def _in_tasks(rows: DataFrame, run, schema: str) -> DataFrame:
    """run gets tables of whole regions."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "key"):
            yield run(table)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(each, schema)


def _agreeing(sig: np.ndarray, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs in which a pair agrees; short ones are looked at many at a time."""
    out, by_size = [], {}
    for x, y in runs:
        if 1 < y - x <= 24:
            by_size.setdefault(y - x, []).append(x)
        elif y - x > 24:
            out.append((x, y))
    for n, starts in by_size.items():
        for at in range(0, len(starts), max(1, 200_000 // (n * VALUES))):
            x = np.array(starts[at : at + max(1, 200_000 // (n * VALUES))])
            own = sig[x[:, None] + np.arange(n)]
            any_agrees = np.zeros(len(x), bool)
            for k in range(1, n):
                any_agrees |= ((own[:, k:] == own[:, :-k]).sum(axis=2, dtype=np.int32) >= AGREES * VALUES).any(axis=1)
            out += [(i, i + n) for i in x[any_agrees].tolist()]
    return out


def _forest_pairs(regions: DataFrame) -> DataFrame:
    """Candidates of all regions: a < b and their agreement."""
    def run(table: pa.Table) -> pa.RecordBatch:
        ids, sig = table.column("rid").to_numpy(), _matrix(table.column("sig"))
        a, b = [], []
        for x, y in _agreeing(sig, _runs(table.column("key").to_numpy())):
            for i, j in forest(sig[x:y]):
                a.append(x + i)
                b.append(x + j)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        agree = (sig[a] == sig[b]).sum(axis=1).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b])), pa.array(agree)], names=["a", "b", "agree"])

    return _in_tasks(regions.select("rid", "key", "sig"), run, "a long, b long, agree byte").where("a <> b")


def _others(i: int, start: int, stop: int, sig: np.ndarray, component: np.ndarray) -> np.ndarray:
    """The rows of other components that agree with row i."""
    other = np.flatnonzero(component[start:stop] != component[i]) + start
    return other[(sig[other] == sig[i]).sum(axis=1) >= AGREES * VALUES]


def _open_rows(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows to compare it with) of a table of regions; each pair of components' rows once or more.

    A pair is looked at in each region that it shares: values of a byte don't tell whether it has met in an earlier tree.
    """
    sig, component = _matrix(table.column("sig")), table.column("component").to_numpy()
    for x, y in _runs(table.column("key").to_numpy()):
        own = component[x:y]
        if y - x > 1 and (own != own[0]).any():
            names, counts = np.unique(own, return_counts=True)
            for i in (np.flatnonzero(own != names[np.argmax(counts)]) + x).tolist():
                if len(other := _others(i, x, y, sig, component)):
                    yield i, other


def _needed(rows: DataFrame) -> DataFrame:
    """The rows that have a partner to be compared with: those need their sets."""
    def run(table: pa.Table) -> pa.RecordBatch:
        need = np.zeros(table.num_rows, bool)
        for i, other in _open_rows(table):
            need[i] = need[other] = True
        return table.filter(pa.array(need)).combine_chunks().to_batches(max_chunksize=None)[0] if need.any() else pa.RecordBatch.from_pylist([], table.schema)

    rows = rows.select("rid", "key", "sig", "component")
    return _in_tasks(rows, run, "rid long, key long, sig binary, component long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of sorted distinct hashes."""
    if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)) or not len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that a pair of a region links; pairs of components that are linked already are passed over."""
    def run(table: pa.Table) -> pa.RecordBatch:
        component, up, links = table.column("component").to_numpy(), {}, []
        sets = [np.frombuffer(h.as_py(), np.uint64) for h in table.column("hashes")]

        def top(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c]
            return c

        for i, other in _open_rows(table):
            for j in other.tolist():
                a, b = top(int(component[i])), top(int(component[j]))
                if a != b and _similar(sets[i], sets[j], percent):
                    up[max(a, b)] = min(a, b)
                    links.append((int(component[i]), int(component[j])))
        a, b = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _in_tasks(rows.select("key", "sig", "component", "hashes"), run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough; sets: (rid, hashes binary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("rid").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("rid").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _frequent(sets: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that occur twice or more in a sample of the n sets, and about how many of all sets each has."""
    part = min(1 << 20, max(1, (COUNTED_SETS << 20) // max(1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h, times = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times.astype(np.int64))], names=["shingle", "n"])

    some = sets.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < part).select("hashes")
    told = some.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(COUNTED).toArrow()
    h, times = told.column("shingle").to_numpy().view(np.uint64), told.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], times[order] * (1 << 20) // part


def _prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of a set at which a similar set may meet it first, the largest size of such a set, and their counts.

    Sets of n and m shingles are similar if they share percent / (100 + percent) * (n + m) of them. All that are shared
    lie from the first shared one on, so at place i that is no more than n - i; it bounds m.
    """
    names, counts = frequent
    often = np.zeros(len(s), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
        often = np.where(names[at] == s, counts[at], 0)
    order = np.argsort(often, kind="stable")
    n = len(s)
    largest = (100 + percent) * (n - np.arange(n, dtype=np.int64)) // percent - n
    order = order[: int(np.count_nonzero(100 * largest >= percent * n))]
    return s[order], largest[: len(order)], often[order]


def _prefix_rows(sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """A row for each shingle of the sets' prefixes; those of a very frequent one are dealt to several keys.

    There a set stands under one key of its own, as the larger one of a pair, and under all as the smaller one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, hashes, component in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(hashes, np.uint64)
                key, largest, often = _prefix(s, frequent, percent)
                parts = (often // SPLIT_ROWS + 1).astype(np.uint64)
                own = np.uint64(rid & 0xFFFFFFFF) % parts
                one = np.full(len(key), rid), np.full(len(key), component), np.full(len(key), len(s), np.int32), largest.astype(np.int32), np.ones(len(key), bool)
                out.append((_mixed(key + own * _M1), *one))
                for i in np.flatnonzero((parts > 1) & (largest >= len(s))).tolist():
                    others = np.delete(np.arange(int(parts[i]), dtype=np.uint64), int(own[i]))
                    out.append((_mixed(key[i] + others * _M1), *(np.full(len(others), c[i], c.dtype) for c in one[:4]), np.zeros(len(others), bool)))
            if out:
                key, *rest = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, rest)], names=["key", "rid", "component", "n", "largest", "own"])

    return sets.select("rid", "hashes", "component").mapInArrow(run, "key long, rid long, component long, n int, largest int, own boolean")


def _prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the candidates of one shingle, of different components."""
    def of_table(table: pa.Table) -> Iterator[np.ndarray]:
        key = table.column("key").to_numpy()
        many = np.zeros(len(key), bool)
        many[1:] = key[1:] == key[:-1]
        many[:-1] |= many[1:]
        key, rid, component, n, largest, own = (table.column(c).to_numpy()[many] for c in ("key", "rid", "component", "n", "largest", "own"))
        n, largest = n.astype(np.int64), largest.astype(np.int64)

        def fit(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether i may be the larger and j the smaller one of a similar pair, or the other way."""
            apart = (component[i] != component[j]) & (n[i] <= largest[j]) & (n[j] <= largest[i])
            i_larger = (n[i] >= n[j]) & own[i] & (100 * n[j] >= percent * n[i])
            return apart & (i_larger | ((n[j] >= n[i]) & own[j] & (100 * n[i] >= percent * n[j])))

        short = np.zeros(len(key), bool)
        for x, y in _runs(key) if len(key) else []:
            if y - x <= 64:
                short[x:y] = True
                continue
            names, counts = np.unique(component[x:y], return_counts=True)
            most = names[np.argmax(counts)]
            for i in (np.flatnonzero(component[x:y] != most) + x).tolist():
                j = np.arange(x, y)
                j = j[(component[x:y] == most) | (j > i)]
                j = j[fit(np.full(len(j), i), j)]
                yield np.stack([np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])])
        at = np.flatnonzero(short)
        for k in range(1, 64):
            at = at[at + k < len(key)]
            at = at[key[at + k] == key[at]]
            if not len(at):
                break
            i = at[fit(at, at + k)]
            yield np.stack([np.minimum(rid[i], rid[i + k]), np.maximum(rid[i], rid[i + k])])

    def batch(pairs: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, np.unique(np.concatenate(pairs, axis=1), axis=1))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "key"):
            held, size = [], 0
            for pairs in of_table(table):
                held.append(pairs)
                size += pairs.shape[1]
                if size >= PAIRS_AT_ONCE:
                    yield batch(held)
                    held, size = [], 0
            if size:
                yield batch(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _crowded_links(crowded: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(a, b): components that a pair of classes of a crowded region links; crowded: (rid, key), known: (rid, component)."""
    placed = crowded.join(known, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    placed = materialize(placed, "crowded-rows")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    own = materialize(placed.join(several, "key", "left_semi").select("rid", "component").distinct(), "apart")
    n = own.count()
    if not n:
        return None
    own_sets = materialize(sets.join(F.broadcast(own) if n <= BROADCAST_KEYS else own, "rid"), "apart-sets")
    pairs = materialize(_prefix_pairs(_prefix_rows(own_sets, _frequent(own_sets, n), percent), percent), "crowded-pairs")
    found = confirmed(pairs, own_sets.select("rid", "hashes"), percent).select("a", "b")
    for end in "ab":
        found = found.join(own.select(F.col("rid").alias(end), F.col("component").alias(f"of_{end}")), end)
    return materialize(found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "crowded-links")


def _merged(first: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after the links between components."""
    joined = components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = first.unionByName(ends.join(first.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return known.join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the ids modulo their number: about 16 bits an id, MOST_BITS at most."""
    size = min(MOST_BITS, max(1 << 16, 1 << (16 * ids.count()).bit_length())) - 1
    words = ids.select(F.expr(f"shiftrightunsigned(pmod(rid, {size}L), 6)").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(rid, {size}L) & 63 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64 + 1, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return np.append(out.view(np.uint64), np.uint64(size))


def _in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = np.mod(ids, np.int64(bitmap[-1]))
    return (bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


def _of_components(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs between different components; of: (node, component), a node that isn't there is its own."""
    for end in "ab":
        pairs = pairs.join(of.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    return pairs.where("of_a <> of_b").select("a", "b")


def find(df: DataFrame, size: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; percent must be at least 80, for which the forest is made."""
    if percent < 80:
        raise ValueError("the forest's depth and trees are made for a similarity of 0.8 or more")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, size):
            there = np.array([len(s) > 0 for s in sets])
            sig = np.stack([signature(s) if len(s) else np.zeros(VALUES, np.uint32) for s in sets])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TREES), pa.array(_keys(sig).ravel()), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([x.tobytes() if t else None for x, t in zip(_short(sig), there.tolist())], pa.binary()),
                keys], names=["doc_id", "n_shingles", "class", "sig", "keys"])

    signed = materialize(docs.mapInArrow(sign, "doc_id long, n_shingles long, class binary, sig binary, keys array<long>"), "signed")
    able = signed.where("doc_id is not null and sig is not null")
    classes = materialize(able.groupBy("class").agg(F.min("doc_id").alias("rid"), F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.count("*").alias("copies")), "classes")
    own = Forest(classes)
    found = _forest_pairs(own.regions(classes))
    if own.levels:
        found = found.unionByName(own.hub_pairs)
    pairs = materialize(found.groupBy("a", "b").agg(F.max("agree").alias("agree")), "pairs")

    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("rid"), F.col("b").alias("to"), "agree"), F.struct(F.col("b").alias("rid"), F.col("a").alias("to"), "agree"))).alias("e")).select("e.*")
    best = materialize(ends.groupBy("rid").agg(F.max_by("to", F.struct("agree", -F.col("to"))).alias("to")), "best")
    spelled = best.select("rid")
    if own.levels:
        crowded = materialize(own.crowded(classes), "crowded-classes")
        spelled = spelled.unionByName(crowded.select("rid")).distinct()
    bits = _bitmap(spelled)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = (b.filter(pa.array(_in_bitmap(bits, b.column(0).to_numpy()))) for b in batches)
        for ids, sets in _sets((b for b in asked if b.num_rows), size):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "hashes"])

    sets = materialize(docs.where("doc_id is not null").mapInArrow(spell, "rid long, hashes binary").where("length(hashes) > 0"), "sets")
    closest = best.select(F.least("rid", "to").alias("a"), F.greatest("rid", "to").alias("b")).distinct()
    edges = materialize(confirmed(closest, sets, percent), "best-links")
    between = materialize(_of_components(pairs.join(closest, ["a", "b"], "left_anti"), components(edges)), "between")
    if not between.isEmpty():
        wanted = materialize(between.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "wanted")
        own_sets = sets.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "rid", "left_semi")
        edges = materialize(edges.unionByName(confirmed(between, own_sets, percent)), "links")
    first = materialize(components(edges), "components")

    # what the forests left out
    asked = classes.join(best.select("rid"), "rid", "left_semi")  # without an agreeing partner there is no pair
    known = first.withColumnRenamed("node", "rid")
    rows = own.regions(asked).join(known, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    needed = materialize(_needed(rows), "needed")
    final = first
    if not needed.isEmpty():
        links = materialize(_links(needed.join(sets, "rid"), percent).distinct(), "left-links")
        final = _merged(first, links)
    if own.levels:  # what the orders of crowded regions left out
        final = materialize(final, "components")
        links = _crowded_links(crowded, final.withColumnRenamed("node", "rid"), sets, percent)
        if links is not None:
            final = _merged(final, links)
    of_class = classes.select("class", "rid").join(final.withColumnRenamed("node", "rid"), "rid", "left").select("class", F.coalesce("component", "rid").alias("component"))
    out = signed.select("doc_id", "n_shingles", "class", F.col("sig").isNotNull().alias("able")).join(of_class, "class", "left")
    component = F.when(F.col("able") & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without near-duplicates of rows with a smaller id."""
    gone = find(df, size, PERCENT, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
