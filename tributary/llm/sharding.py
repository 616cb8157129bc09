"""Shards of near-equal bytes by histogram sort.

Method. The splitters between shards are found by counting: each round counts the exact bytes of all rows between
candidate boundaries, in every partition with a map-side sum, and keeps for each splitter the stretch between two
candidates in which its target lies, until a candidate meets the tolerance or one row is left in the stretch. Rows of
one key, which may be a third of the table, are split further by a second key of the row. Shards are split into ranges of
about PART_BYTES in the same counting. Then rows are exchanged once, each to the task of its range, sorted and numbered.

Rounds read a narrow table in the shared folder; each brings at most CANDIDATES sums a splitter to the driver. The
exchange is dealt by the counted ranges, not by shard, so a shard is as many tasks as it needs; slots add a
partition's first slot to the row's place in it.

Cases. A null key counts as the smallest long, a null size as 0. Repeated rows are rows each. An empty table gives an
empty result; with fewer rows than shards some shards are empty. Columns named shard or slot in the input are
replaced; names beginning with __ are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.session import materialize, parts_for

CANDIDATES = 128
#: Of a shard's bytes.
TOLERANCE = 0.0005
#: Of a range's bytes; and ranges, that is tasks, a shard at most: beyond that they grow and sort by spilling.
RANGE_TOLERANCE, MOST_RANGES = 0.1, 64
PART_BYTES = 32 << 20
KEYS = ("__high", "__low")
TOPS = (1 << 63, 1 << 62)


@dataclass
class Splitter:
    """Where one boundary may lie: in key `level`, from low to high; below: bytes of all rows before low."""

    target: float
    tolerance: float
    below: int = 0
    level: int = 0
    low: int = 0
    high: int = TOPS[0]
    key: int = 0  # of level 0, once level 1 is searched
    found: tuple[int, int] | None = None

    def stretch(self) -> tuple:
        return (self.level, self.low, self.high, self.key)

    def at(self, x: int) -> tuple[int, int]:
        return (x, 0) if self.level == 0 else (self.key, x)

    def narrow(self, width: int, sums: dict[int, tuple[int, int]]) -> None:
        below = self.below
        for i in range(-(-(self.high - self.low) // width)):
            size, rows = sums.get(i, (0, 0))
            if below + size > self.target:
                break
            below += size
        start, stop = self.low + i * width, min(self.high, self.low + (i + 1) * width)
        after = below + size
        if self.target - below <= self.tolerance:
            self.found = self.at(start)
        elif after - self.target <= self.tolerance:
            self.found = self.at(stop)
        elif stop - start == 1 and self.level == 0 and rows > 1:
            self.below, self.level, self.key, self.low, self.high = below, 1, start, 0, TOPS[1]
        elif rows <= 1 or stop - start == 1:
            self.found = self.at(start if self.target - below <= after - self.target else stop)
        else:
            self.below, self.low, self.high = below, start, stop


def splitters(rows: DataFrame, shards: int, size_col: str, ranges: int = 1) -> list[tuple[int, int]]:
    """The smallest key pairs of all ranges after the first, a number of ranges a shard; the ranges-th of them begins the second shard, and so on."""
    total = rows.agg(F.coalesce(F.sum(size_col), F.lit(0))).first()[0]
    n = shards * ranges
    own = [Splitter(total * i / n, TOLERANCE * total / shards if i % ranges == 0 else RANGE_TOLERANCE * total / n) for i in range(1, n)]
    while active := [s for s in own if s.found is None]:
        stretches = list(dict.fromkeys(s.stretch() for s in active))
        slot, widths = F.lit(None).cast("long"), []
        for n, (level, low, high, key) in enumerate(stretches):
            width = -(-(high - low) // CANDIDATES)
            widths.append(width)
            column = F.col(KEYS[level])
            inside = (column >= low) & (column <= high - 1)
            if level:
                inside &= F.col(KEYS[0]) == key
            slot = F.when(inside, F.expr(f"{n * CANDIDATES}L + ({KEYS[level]} - {low}L) div {width}L")).otherwise(slot)
        sums = rows.groupBy(slot.alias("slot")).agg(F.sum(size_col).alias("size"), F.count("*").alias("n")).where("slot is not null").collect()
        by_slot: dict[int, dict[int, tuple[int, int]]] = {}
        for r in sums:
            by_slot.setdefault(r["slot"] // CANDIDATES, {})[r["slot"] % CANDIDATES] = (r["size"], r["n"])
        for n, stretch in enumerate(stretches):
            mine = by_slot.get(n, {})
            for s in active:
                if s.stretch() == stretch and s.found is None:
                    s.narrow(widths[n], mine)
    return [s.found for s in own]


def shard_by_bytes(df: DataFrame, key: Column, size: Column, shards: int = 8) -> DataFrame:
    """The input's columns with shard int and slot long, in the order of key; shards differ by about TOLERANCE."""
    long = F.coalesce(key.cast("long"), F.lit(-(1 << 63)))
    rows = df.drop("shard", "slot").withColumns({
        "__high": F.shiftrightunsigned(long.bitwiseXOR(F.lit(-(1 << 63))), 1),
        "__low": F.shiftleft(long.bitwiseAND(F.lit(1)), 61).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 3)),
        "__size": F.coalesce(size.cast("long"), F.lit(0))})
    rows = materialize(rows, "shard-rows")  # from here on a row's second key is fixed
    ranges = min(MOST_RANGES, -(-parts_for(rows, PART_BYTES, shards) // shards))
    found = splitters(rows, shards, "__size", ranges)
    here = F.struct(F.col("__high").alias("h"), F.col("__low").alias("l"))

    def reached(boundaries: list[tuple[int, int]]) -> Column:
        """How many of the boundaries are at or before the row; one past the last key is reached by none."""
        own = [F.struct(F.lit(h).cast("long").alias("h"), F.lit(low).cast("long").alias("l")) for h, low in boundaries if h < TOPS[0]]
        return F.size(F.filter(F.array(*own), lambda b: b <= here)) if own else F.lit(0)

    rows = rows.withColumn("shard", reached(found[ranges - 1 :: ranges]))
    within = F.lit(0)
    for n in range(shards if ranges > 1 else 0):
        within = F.when(F.col("shard") == n, reached(found[n * ranges : (n + 1) * ranges - 1])).otherwise(within)
    dealt = rows.repartitionById(shards * ranges, F.col("shard") * ranges + within).sortWithinPartitions("shard", *KEYS)
    dealt = materialize(dealt.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "shard-slots")
    firsts, filled = [], {}
    for r in sorted(dealt.groupBy("__part", "shard").agg(F.min("__row").alias("row"), F.count("*").alias("n")).collect()):  # one row a partition and shard
        firsts.append((r["__part"], r["shard"], filled.get(r["shard"], 0) - r["row"]))
        filled[r["shard"]] = filled.get(r["shard"], 0) + r["n"]
    first = df.sparkSession.createDataFrame(firsts, "__part int, shard int, __first long")
    return dealt.join(F.broadcast(first), ["__part", "shard"]).withColumn("slot", F.col("__row") + F.col("__first")).drop("__part", "__row", "__first", "__size", *KEYS)
