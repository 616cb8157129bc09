"""Back-offs for rare combinations: drop the rarest items, or split the set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.model import Model
from tributary.operators.recommend import candidates, rank, top10_average


def step_linear(size: Column, k: Column, parallel: int) -> Column:
    """k, but never all items and never less than none."""
    return F.greatest(F.when(k < size, k).otherwise(size - 1), F.lit(0))


def step_proportional(size: Column, k: Column, parallel: int) -> Column:
    """Up to four tenths of the items, halves rounded up."""
    return F.least(F.round(F.lit(0.4) * k / parallel * size).cast("int"), size)


@dataclass(frozen=True)
class MoreThan:
    """Sub-requests with more recommendations than the threshold: (qid)."""

    threshold: int

    def __call__(self, asked: DataFrame, found: DataFrame) -> DataFrame:
        return found.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") > self.threshold).select("qid")

    def holds(self, n: Column, top10: Column) -> Column:
        return n > self.threshold


@dataclass(frozen=True)
class MoreLikelyThan:
    """Sub-requests whose ten best average above the threshold: (qid)."""

    threshold: float

    def __call__(self, asked: DataFrame, found: DataFrame) -> DataFrame:
        return top10_average(asked, rank(found)).where(F.col("top10") > F.lit(self.threshold).cast("float")).select("qid")

    def holds(self, n: Column, top10: Column) -> Column:
        return top10 > F.lit(self.threshold).cast("float")


more_than, more_likely_than = MoreThan, MoreLikelyThan


def _answers(model: Model, subs: DataFrame) -> DataFrame:
    """(sub, item, probability) of sub-requests (sub, s, gone), without what was taken out; equal sets are asked once."""
    asked = subs.select(F.col("s").alias("qid"), "s").distinct()
    found = candidates(model, asked).withColumnRenamed("qid", "s")
    return subs.join(found, "s").where(~F.array_contains("gone", F.col("item"))).select("sub", "item", "probability")


def delete_low_frequency(model: Model, queries: DataFrame, parallel: int = 4, step: Callable = step_linear, passes: Callable = more_than(4)) -> DataFrame:
    """(qid, item, probability): the first of `parallel` reductions whose answers pass, or else the last."""
    n = F.size("s")
    subs = queries.select("qid", "s", F.explode(F.sequence(F.lit(1), F.lit(parallel))).alias("k")).withColumn("drop", step(n, F.col("k"), parallel))
    subs = subs.select(F.struct("qid", "k").alias("sub"), F.slice("s", F.lit(1), F.greatest(n - F.col("drop"), F.lit(0))).alias("left"), "s")
    subs = subs.select("sub", F.col("left").alias("s"), F.array_except("s", "left").alias("gone"))
    found = _answers(model, subs)
    good = passes(subs.select(F.col("sub").alias("qid")), found.withColumnRenamed("sub", "qid")).select(F.col("qid.qid").alias("qid"), F.col("qid.k").alias("k"))
    chosen = queries.select("qid").join(good.groupBy("qid").agg(F.min("k").alias("k")), "qid", "left").select(F.struct("qid", F.coalesce("k", F.lit(parallel)).alias("k")).alias("sub"))
    return found.join(chosen, "sub").select(F.col("sub.qid").alias("qid"), "item", "probability")


def split_every_second(s: Column) -> list[Column]:
    return [F.filter(s, lambda _, i: i % 2 == 0), F.filter(s, lambda _, i: i % 2 == 1)]


def split_two_ranges(s: Column) -> list[Column]:
    """The rarer half first."""
    mid = F.floor(F.size(s) / 2).cast("int")
    return [F.slice(s, mid + 1, F.size(s) - mid), F.slice(s, F.lit(1), mid)]


def merge_max(found: DataFrame, parts: int) -> DataFrame:
    return found.groupBy("qid", "item").agg(F.max("probability").alias("probability")).where("probability > 0")


def merge_average(found: DataFrame, parts: int) -> DataFrame:
    """Over all parts: one without the item counts as 0."""
    return found.groupBy("qid", "item").agg((F.sum("probability") / parts).alias("probability"))


def merge_first(found: DataFrame, parts: int) -> DataFrame:
    return found.where("part = 0").select("qid", "item", "probability")


def split_property_set(model: Model, queries: DataFrame, splitter: Callable = split_every_second, merger: Callable = merge_max) -> DataFrame:
    """(qid, item, probability): the parts' answers, merged; a part's answers leave out the other parts' items."""
    parts = splitter(F.col("s"))
    subs = queries.select("qid", "s", F.posexplode(F.array(*parts)).alias("part", "own"))
    subs = subs.select(F.struct("qid", "part").alias("sub"), F.col("own").alias("s"), F.array_except("s", "own").alias("gone"))
    found = _answers(model, subs).select(F.col("sub.qid").alias("qid"), F.col("sub.part").alias("part"), "item", "probability")
    return merger(found, len(parts))
