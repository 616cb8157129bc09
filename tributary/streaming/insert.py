"""A model kept up to date from a stream of transactions.

Each micro-batch is reduced to patterns by iri and written under its batch number, so a batch that is replayed replaces
itself. Every FOLD batches all patterns so far are folded into one table, a base; a reader takes the last base that is whole
and the batches after it, so what it reads does not grow with the number of batches. A fold leaves the base before it and
the batches since, so a replay of its batch folds the same again, and readers that have begun go on; the next fold removes
them. Ranks are made when the model is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.operators.model import Model
from tributary.session import exists, folders, remove

SCHEMA = "items array<string>, support long"
#: Batches between two bases.
FOLD = 16


def batch_patterns(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy(F.array_sort(F.array_distinct("items")).alias("items")).agg(F.count("*").alias("support"))


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of whole tables of a kind."""
    found = [int(name.partition("=")[2]) for name in folders(spark, path) if name.startswith(f"{kind}=")]
    return sorted(n for n in found if exists(spark, f"{path}/{kind}={n}/_SUCCESS"))


def parts(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    """The folders that make up the model: the last base and the batches after it, up to a batch or, below, before its own base."""
    last = max((n for n in _numbers(spark, path, "base") if upto is None or n < upto), default=None)
    batches = [n for n in _numbers(spark, path, "batch") if (last is None or n > last) and (upto is None or n <= upto)]
    return ([f"{path}/base={last}"] if last is not None else []) + [f"{path}/batch={n}" for n in batches]


def _merged(spark: SparkSession, places: list[str]) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(*places) if places else spark.createDataFrame([], SCHEMA)
    return rows.groupBy("items").agg(F.sum("support").alias("support"))


def writer(path: str, fold: int = FOLD) -> Callable[[DataFrame, int], None]:
    """What is done with each micro-batch."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch_patterns(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % fold != fold - 1:
            return
        own = parts(spark, path, number)
        bases = [n for n in _numbers(spark, path, "base") if n < number]
        _merged(spark, own).write.mode("overwrite").parquet(f"{path}/base={number}")
        if bases:
            for kind, numbers in (("base", bases[:-1]), ("batch", [n for n in _numbers(spark, path, "batch") if n <= bases[-1]])):
                for n in numbers:
                    remove(spark, f"{path}/{kind}={n}")

    return write


def start(stream: DataFrame, path: str, checkpoint: str, fold: int = FOLD, **trigger) -> StreamingQuery:
    """stream: (subject, items array<string>), one row a transaction."""
    return stream.writeStream.foreachBatch(writer(path, fold)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str, always: tuple[str, ...] = ()) -> Model:
    """The model of all batches; always: entries that are there even if unseen."""
    return Model.of_patterns(_merged(spark, parts(spark, path)), always)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """All batches' patterns as one batch in another folder."""
    _merged(spark, parts(spark, path)).write.mode("overwrite").parquet(f"{to}/batch=0")
