"""Places of rows in one order of a whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.session import materialize, parts_for

PART_BYTES = 32 << 20


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The input with its row's place in the order, from 1, in a column of that name.

    The rows are dealt to ranges of the order and sorted there. Rows that the order leaves equal lie by a number of
    their own, so any number of them can be cut between ranges. The driver gets a count a range, and a row's place is
    that of its range's first row and its own in the range. The ranges are written to the shared folder, so a task that
    runs again gives the same places. Columns that begin with __ are reserved.
    """
    rows = materialize(df.withColumn("__tie", F.monotonically_increasing_id()), "to-place")
    ranges = parts_for(rows, PART_BYTES, df.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartitionByRange(ranges, *order, "__tie").sortWithinPartitions(*order, "__tie")
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = materialize(dealt.withColumns({"__part": F.spark_partition_id(), "__row": own}), "placed")
    firsts, filled = [], 1
    for part, n in sorted(dealt.groupBy("__part").count().collect()):  # one row a range
        firsts.append((part, filled))
        filled += n
    first = df.sparkSession.createDataFrame(firsts, "__part int, __first long")
    return dealt.join(F.broadcast(first), "__part").withColumn(name, F.col("__row") + F.col("__first")).drop("__part", "__row", "__first", "__tie")
