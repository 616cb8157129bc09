"""Large batches of requests: patterns walk the prefix tree of the requests' sets.

Sets that begin alike are nodes of one path. A pattern that holds a node's items is a match of the node; the matches of its
children are those of them that hold one item more, so a pattern is narrowed from a request to the next longer one and never
met anew, and the work is that of the matches of prefixes. What a match adds to its node's counts, an item's support each,
is read in the same step.

Sets and patterns meet by the sets' first items. The sets of an item are dealt to blocks, and so are its patterns; each
pair of blocks is one task's, of bounded size, and sends sums of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.model import BROADCAST_ITEMS, Model
from tributary.operators.recommend import popularity

#: Sets and patterns of one item that meet in a task.
SET_BLOCK, PATTERN_BLOCK = 1 << 16, 1 << 15
#: Sets whose sums meet in a task.
SUM_SETS = 1 << 14
#: Items of matches that are looked at together.
STEP_ROWS = 1 << 21


def _gathered(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of the rows, one after another, and their lengths."""
    lengths = (starts[1:] - starts[:-1])[rows]
    ends = np.cumsum(lengths)
    at = np.repeat(starts[:-1][rows] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    return values[at], lengths


class Tree:
    """The prefix tree of lists of items: sorted keys (parent, item) of each level's nodes, and the list that ends at a node."""

    def __init__(self, starts: np.ndarray, items: np.ndarray, width: int):
        self.width, self.levels = width, []
        lengths, node, n = np.diff(starts), np.zeros(len(starts) - 1, np.int64), 1
        level = 0
        while (on := np.flatnonzero(lengths > level)).size:
            keys, own = np.unique(node[on] * width + items[starts[on] + level], return_inverse=True)
            self.levels.append((keys, n))
            node[on] = own + n
            n, level = n + len(keys), level + 1
        self.list_at = np.full(n, -1)
        self.list_at[node] = np.arange(len(node))

    def children(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are nodes below the level, and those nodes."""
        if level == len(self.levels):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known, first = self.levels[level]
        at = np.searchsorted(known, keys)
        there = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == keys)
        return there, at[there] + first


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(values, starts) if len(keys) else values


def walk(tree: Tree, starts: np.ndarray, items: np.ndarray, support: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of support by key (list, item) over the patterns that hold a list, of its own items too; and how many matches there were."""
    width = tree.width
    todo = [(0, np.zeros(len(support), np.int64), np.arange(len(support)))]
    out, held, n_matches = [], 0, 0
    while todo:
        level, nodes, patterns = todo.pop()
        sizes = np.cumsum((starts[1:] - starts[:-1])[patterns])
        if len(patterns) > 1 and sizes[-1] > STEP_ROWS:
            cut = max(1, int(np.searchsorted(sizes, STEP_ROWS)))
            todo.append((level, nodes[cut:], patterns[cut:]))
            nodes, patterns = nodes[:cut], patterns[:cut]
        n_matches += len(patterns) if level else 0
        own, lengths = _gathered(items, starts, patterns)
        node, pattern = np.repeat(nodes, lengths), np.repeat(patterns, lengths)
        ended = tree.list_at[node]
        asked = ended >= 0
        if asked.any():
            out.append(summed(ended[asked] * width + own[asked], support[pattern[asked]]))
            held += len(out[-1][0])
            if held > 2 * STEP_ROWS:
                out = [summed(*(np.concatenate(x) for x in zip(*out)))]
                held = len(out[0][0])
        there, below = tree.children(level, node * width + own)
        if len(there):
            todo.append((level + 1, below, pattern[there]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_matches
    return *summed(*(np.concatenate(x) for x in zip(*out))), n_matches


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def counts(model: Model, sets: DataFrame) -> DataFrame:
    """(qid, item, n) for sets (qid long, path array<int>, not empty): the support of the set with each item; of its own items, the set's."""
    asked = sets.select("qid", "path", F.col("path")[0].alias("root"))
    met = model.patterns.select("items", "support", F.explode("items").alias("root"))
    blocks = asked.groupBy("root").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("set_blocks"), F.count("*").alias("n_sets"))
    sizes = met.groupBy("root").agg(F.ceil(F.count("*") / PATTERN_BLOCK).cast("int").alias("pattern_blocks"))
    many = blocks.join(sizes, "root").persist()  # an entry an item that sets begin with
    n_roots, n_sets = many.agg(F.count("*"), F.coalesce(F.sum("n_sets"), F.lit(0))).first()
    dealt = F.broadcast(many) if n_roots <= BROADCAST_ITEMS else many

    def numbers(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = asked.join(dealt, "root").withColumn("sets_of", F.pmod(F.hash("path"), F.col("set_blocks"))).withColumn("patterns_of", numbers("pattern_blocks"))
    right = met.join(dealt, "root").withColumn("patterns_of", F.pmod(F.hash("items"), F.col("pattern_blocks"))).withColumn("sets_of", numbers("set_blocks"))
    keys = ("root", "sets_of", "patterns_of")

    def meet(own: pa.Table, patterns: pa.Table) -> pa.Table:
        ids = own.column("qid").to_numpy()
        starts, items = _lists(own.column("path"))
        pattern_starts, pattern_items = _lists(patterns.column("items"))
        width = int(max(items.max(initial=0), pattern_items.max(initial=0))) + 1
        key, n, _ = walk(Tree(starts, items, width), pattern_starts, pattern_items, patterns.column("support").to_numpy())
        return pa.table([pa.array(ids[key // width]), pa.array((key % width).astype(np.int32)), pa.array(n)], names=["qid", "item", "n"])

    left, right = left.select(*keys, "qid", "path").groupBy(*keys), right.select(*keys, "items", "support").groupBy(*keys)
    parts = left.cogroup(right).applyInArrow(meet, "qid long, item int, n long")
    # by set, as what follows is; before any sum, as a task of several blocks would keep all their sets' sums
    return parts.repartition(max(8, -(-n_sets // SUM_SETS)), "qid").groupBy("qid", "item").agg(F.sum("n").alias("n"))


def candidates(model: Model, sets: DataFrame, include_types: bool = False) -> DataFrame:
    """(qid, item, probability) of all candidates of sets (qid long, path array<int>), in any order and distinct; as recommend.candidates."""
    own = sets.select("qid", "path").where(F.size("path") > 0)
    rows = counts(model, own).join(own, "qid")
    total = F.max(F.when(F.col("item") == F.col("path")[0], F.col("n"))).over(Window.partitionBy("qid"))
    found = rows.select("qid", "item", "path", (F.col("n") / total).alias("probability")).where(~F.array_contains("path", F.col("item")))
    if not include_types:
        found = found.join(model.items.where("is_type").select("item"), "item", "left_anti")
    empty = sets.where(F.size("path") == 0).select("qid", F.col("path").alias("s"))
    return found.select("qid", "item", "probability").unionByName(popularity(model, empty))

