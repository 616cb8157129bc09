"""Exact top-k by inner product with no random access (NRA) to the sorted lists.

Method. In each block of candidates every dimension is a sorted list. A query reads the lists in step: those of its
positive weights from the top, those of its negative weights from the bottom. What it has read gives each candidate a
lower bound (unread entries at their list's worst end) and an upper bound (unread entries at the frontier). Candidates
whose upper bound is below the k-th best lower bound are out; a query stops when what is left is no more than it must
return, or when its lists are read: then both bounds are the score. Scores of candidates that are left when it stops
early are resolved by reading their remaining entries. The bounds of a block of queries are matrix products, over the
candidates that one of them still needs; the lists are read on in DEPTHS.

The k-th best score is carried on: a query first meets one block of candidates, and starts in all others with the k-th
score that it found there as a bound. The queries are a stated set, met with all rows in blocks: a task holds one block
of queries and one of candidates, and sends on k rows a query at most. The blocks' results merge by a window over each query.

Cases. Rows with a null id, a null vector or a vector with null or non-finite components take no part. A shorter
vector counts as filled with zeros. Rows that repeat an id are candidates each, and none of them is one for a query
of that id; queries that repeat an id and its vector are one query. Ties go to the smaller id. Fewer candidates than
k give fewer rows; an empty table gives none. Scores beyond a long are held at its ends. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.session import materialize

BLOCK = 4096
QUERY_BLOCK = 8192
#: Queries whose bounds are held at once.
STEP = 512
#: Shares of the lists that are read, in turn; at the last one both bounds are the scores.
DEPTHS = (0.25, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0)

_LONG = np.iinfo(np.int64)


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector takes no part."""
    x = embedding.cast("array<double>")
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(fine, F.transform(x, lambda c: F.floor(c * float(scale)).cast("long")))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = vectors.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _exact_type(q: np.ndarray, x: np.ndarray):
    """A type in which all sums of products are exact."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if top < 1 << 23 else np.float64 if top < 1 << 52 else object


def _bounds(q: np.ndarray, x: np.ndarray, lists: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores after reading each list to the depth."""
    high, low = lists[len(lists) - depth], lists[depth - 1]
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    upper = plus @ np.maximum(x, high).T + minus @ np.minimum(x, low).T
    lower = plus @ np.where(x >= high, x, lists[0]).T + minus @ np.where(x <= low, x, lists[-1]).T
    return lower, upper


def _exact(own: np.ndarray, x: np.ndarray) -> np.ndarray:
    score = own @ x.T
    if score.dtype == object:
        score = np.array([[max(_LONG.min, min(_LONG.max, s)) for s in row] for row in score.tolist()], np.int64).reshape(score.shape)
    return score.astype(np.int64)


def nra(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, candidate row, score, share of the lists read) of each query's k best, ties to smaller ids; not those of its id.

    least: a score for each query that its k best of all blocks reach; what is below it isn't returned.
    """
    order = np.argsort(ids, kind="stable")
    ids, x, out = ids[order], x[order], []
    kind = _exact_type(q, x)
    q, x = q.astype(kind), x.astype(kind)
    lists = np.sort(x, axis=0)
    floor = np.full(len(q), _LONG.min) if least is None else least
    for at in range(0, len(q), STEP):
        own, own_ids, own_floor = q[at : at + STEP], query_ids[at : at + STEP], floor[at : at + STEP]
        alive, read, open_ = own_ids[:, None] != ids[None, :], np.ones(len(own)), np.ones(len(own), bool)
        for share in () if kind is object else DEPTHS[:-1]:
            depth = int(len(ids) * share)
            if depth < 4 * k or not open_.any():
                continue
            rows, left = np.flatnonzero(open_), np.flatnonzero(alive[open_].any(axis=0))
            lower, upper = _bounds(own[rows], x[left], lists, depth)
            lower[~alive[np.ix_(rows, left)]] = -np.inf
            kth = np.maximum(np.partition(lower, max(0, len(left) - k), axis=1)[:, max(0, len(left) - k)] if len(left) >= k else -np.inf, own_floor[rows])
            alive[np.ix_(rows, left)] &= upper >= kth[:, None]
            stops = alive[rows].sum(axis=1) <= 2 * k
            read[rows[stops]] = share
            open_[rows[stops]] = False
        # the entries of what is left are read to the end
        left = np.flatnonzero(alive.any(axis=0))
        score = _exact(own, x[left]) if len(left) else np.zeros((len(own), 0), np.int64)
        for i in range(len(own)):
            mine = np.flatnonzero(alive[i, left])
            mine = mine[score[i, mine] >= own_floor[i]]
            s = score[i, mine]
            if len(s) > k:
                kth = np.partition(s, len(s) - k)[len(s) - k]
                sure = np.flatnonzero(s > kth)
                ties = np.flatnonzero(s == kth)[: k - len(sure)]  # the rows are in the ids' order
                pick = np.concatenate([sure, ties])
            else:
                pick = np.arange(len(s))
            out.append((np.full(len(pick), at + i), order[left[mine[pick]]], s[pick], np.full(len(pick), read[i])))
    return out


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best of all rows but its own; lists_read: the largest share
    of the lists of a block that the query read before it stopped."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("vec_id is not null and v is not null")
    n, n_queries, width = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    none = F.lit(_LONG.min).alias("least")
    spread = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    candidates = rows.select("vec_id", "v", F.lit(False).alias("asks"), spread.cast("int").alias("block"), none)
    queries = rows.where("asks").select("vec_id", "v").distinct()
    own_block = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block")

    def meet(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy().astype(bool)
        ids, vectors, least = table.column("vec_id").to_numpy(), _matrix(table.column("v"), width), table.column("least").to_numpy()
        found = nra(ids[asks], vectors[asks], ids[~asks], vectors[~asks], k, least[asks])
        query, row, score, read = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
        # queries that share an id but not the vector keep apart by the vector's digest
        digest = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) >> 1 for v in vectors[asks]], np.int64)
        query = query.astype(np.int64)
        return pa.table([pa.array(ids[asks][query]), pa.array(digest[query]), pa.array(ids[~asks][row.astype(np.int64)]), pa.array(score, pa.int64()), pa.array(read.astype(float), pa.float64())],
                        names=["query_id", "of", "vec_id", "score", "read"])

    def met(asked: DataFrame, others: DataFrame) -> DataFrame:
        every = others.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).unionByName(asked)
        return every.groupBy("query_block", "block").applyInArrow(meet, "query_id long, of long, vec_id long, score long, read double")

    best = Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    ask = F.lit(True).alias("asks")
    first = met(queries.select("vec_id", "v", ask, F.lit(0).alias("block"), none, own_block), candidates.where("block = 0"))
    if blocks > 1:
        # the digest of a query's vector isn't known here: the smallest bound of the queries of one id holds for all of them
        first = materialize(first, "top-k-first")
        kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("with_k"))
        each = queries.groupBy("vec_id").agg(F.count("*").alias("n")).join(kth, F.col("query_id") == F.col("vec_id"), "left").select("vec_id", F.when(F.col("with_k") == F.col("n"), F.col("bound")).alias("bound"))
        bounded = queries.join(each, "vec_id").withColumn("least", F.coalesce("bound", none))
        rest = bounded.select("vec_id", "v", ask, F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))).alias("block"), "least", own_block)
        first = first.unionByName(met(rest, candidates.where("block > 0")))
    ranked = first.withColumns({"rank": F.row_number().over(best), "lists_read": F.max("read").over(Window.partitionBy("query_id", "of"))})
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "lists_read")
