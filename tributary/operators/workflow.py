"""Workflows: the first layer whose condition holds for a request answers it. Batches branch by request, in one plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators import backoff
from tributary.operators.model import Model
from tributary.operators.recommend import LIMIT, candidates, rank, top10_average
from tributary.session import materialize, read_text


@dataclass(frozen=True)
class Layer:
    """condition: a column over size, n_direct and top10; procedure: of (model, requests), None for the direct one."""

    condition: Callable[[], Column]
    procedure: Callable[[Model, DataFrame], DataFrame] | None
    description: str = ""


def _always() -> Column:
    return F.lit(True)


def always() -> Callable[[], Column]:
    return _always


def above(threshold: int) -> Callable[[], Column]:
    return lambda: F.col("size") > threshold


def below(threshold: int) -> Callable[[], Column]:
    return lambda: F.col("size") < threshold


def too_many(threshold: int) -> Callable[[], Column]:
    return lambda: F.col("n_direct") > threshold


def too_few(threshold: int) -> Callable[[], Column]:
    return lambda: F.col("n_direct") < threshold


def too_unlikely(threshold: float) -> Callable[[], Column]:
    return lambda: F.col("top10") < F.lit(threshold).cast("float")


def facts(queries: DataFrame, direct: DataFrame) -> DataFrame:
    """(qid, s, size, n_direct, top10) of each request and its direct answers."""
    ranked = rank(direct)
    counts = direct.groupBy("qid").agg(F.count("*").alias("n_direct"))
    top = top10_average(queries, ranked)
    return queries.join(counts, "qid", "left").join(top, "qid").select("qid", "s", F.size("s").alias("size"), F.coalesce("n_direct", F.lit(0)).alias("n_direct"), "top10")


def run(model: Model, queries: DataFrame, layers: list[Layer], limit: int | None = LIMIT) -> DataFrame:
    """(qid, item, probability, rank, layer); a request for which no condition holds has no rows.

    The direct answers are written once to the shared folder: conditions and layers read them there.
    """
    direct = materialize(candidates(model, queries), "direct")
    choice = F.lit(None).cast("int")
    for n, layer in reversed(list(enumerate(layers))):
        choice = F.when(layer.condition(), n).otherwise(choice)
    chosen = facts(queries, direct).select("qid", "s", choice.alias("layer"))
    out = []
    for n, layer in enumerate(layers):
        own = chosen.where(F.col("layer") == n).select("qid", "s")
        found = direct.join(own.select("qid"), "qid", "left_semi") if layer.procedure is None else layer.procedure(model, own)
        out.append(found.select("qid", "item", "probability", F.lit(n).alias("layer")))
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    return rank(every, limit)


@dataclass(frozen=True)
class Drop:
    """The procedure that drops the rarest items, in steps."""

    parallel: int
    step: Callable
    passes: Callable

    def __call__(self, model: Model, queries: DataFrame) -> DataFrame:
        return backoff.delete_low_frequency(model, queries, self.parallel, self.step, self.passes)


@dataclass(frozen=True)
class Split:
    """The procedure that splits a set and merges its parts' answers."""

    splitter: Callable
    merger: Callable

    def __call__(self, model: Model, queries: DataFrame) -> DataFrame:
        return backoff.split_property_set(model, queries, self.splitter, self.merger)


dlf, split = Drop, Split


def preset(name: str, suggester: Callable[[Model, DataFrame], DataFrame] | None = None) -> list[Layer]:
    """The named workflows; those of the rule suggester need one."""
    few = dlf(4, backoff.step_proportional, backoff.more_than(10))
    direct = Layer(always(), None, "direct")
    if name.startswith("wikidata-"):
        if name not in ("wikidata-property", "wikidata-type", "wikidata-type-property") or suggester is None:
            raise ValueError(f"no workflow {name}, or no suggester for it")
        return [Layer(always(), suggester, name)]
    known = {
        "direct": [direct],
        "best": [Layer(too_few(1), dlf(4, backoff.step_linear, backoff.more_than(4)), "few"), direct],
        "deletelowfrequency": [Layer(always(), few, "drop the rarest")],
        "splitproperty": [Layer(above(2), split(backoff.split_every_second, backoff.merge_max), "split"), direct],
        "toofewrecommendations": [Layer(too_few(10), few, "few"), direct],
    }
    if name not in known:
        raise ValueError(f"no workflow {name}")
    return known[name]


#: The names that configuration files use.
STEPS = {"stepsizeLinear": backoff.step_linear, "stepsizeProportional": backoff.step_proportional}
SPLITTERS = {"everySecondItem": backoff.split_every_second, "twoSupportRanges": backoff.split_two_ranges}
CONDITIONS = ("aboveThreshold", "tooUnlikelyRecommendationsCondition", "tooFewRecommendations", "always")
MERGERS = {"max": backoff.merge_max, "avg": backoff.merge_average}


@dataclass
class LayerConfig:
    Condition: str = ""
    Backoff: str = ""
    Threshold: int = 0
    ThresholdFloat: float = 0.0
    Merger: str = ""
    Splitter: str = ""
    Stepsize: str = ""
    ParallelExecutions: int = 0


@dataclass
class Configuration:
    Testset: str = ""
    Layers: list[LayerConfig] = field(default_factory=list)

    @classmethod
    def of(cls, data: dict) -> Configuration:
        """Field names in any case; unknown fields are ignored."""
        def fill(kind, values: dict):
            names = {f.lower(): f for f in kind.__dataclass_fields__}
            return {names[k.lower()]: v for k, v in values.items() if k.lower() in names}

        own = fill(cls, data)
        own["Layers"] = [LayerConfig(**fill(LayerConfig, x)) for x in own.get("Layers") or []]
        return cls(**own)

    @classmethod
    def read(cls, path: str) -> Configuration:
        return cls.of(json.loads(read_text(path)))

    def test(self) -> None:
        """Raises for what cannot become a workflow."""
        if not self.Layers:
            raise ValueError("a configuration needs layers")
        for layer in self.Layers:
            if layer.Backoff == "splitProperty" and (layer.Splitter not in SPLITTERS or layer.Merger not in MERGERS):
                raise ValueError("splitProperty needs a known Splitter and Merger")
            if layer.Backoff == "deleteLowFrequency" and (layer.Stepsize not in STEPS or layer.ParallelExecutions < 1):
                raise ValueError("deleteLowFrequency needs a known Stepsize and ParallelExecutions")
            if layer.Backoff not in ("splitProperty", "deleteLowFrequency", "standard"):
                raise ValueError(f"unknown back-off {layer.Backoff!r}")
            if layer.Condition not in CONDITIONS:
                raise ValueError(f"unknown condition {layer.Condition!r}")

    def workflow(self) -> list[Layer]:
        self.test()
        out = []
        for x in self.Layers:
            condition = {"aboveThreshold": lambda x=x: above(x.Threshold), "tooUnlikelyRecommendationsCondition": lambda x=x: too_unlikely(x.ThresholdFloat),
                         "tooFewRecommendations": lambda x=x: too_few(x.Threshold), "always": lambda x=x: always()}[x.Condition]()
            if x.Backoff == "standard":
                procedure = None
            elif x.Backoff == "splitProperty":
                procedure = split(SPLITTERS[x.Splitter], MERGERS[x.Merger])
            else:
                procedure = dlf(x.ParallelExecutions, STEPS[x.Stepsize], backoff.more_than(x.Threshold))
            out.append(Layer(condition, procedure, f"{x.Condition}/{x.Backoff}"))
        return out


@dataclass
class Grid:
    """What a grid of configurations is made of."""

    Conds: list[str] = field(default_factory=list)
    Merger: list[str] = field(default_factory=list)
    Splitter: list[str] = field(default_factory=list)
    Steps: list[str] = field(default_factory=list)
    MaxThreshold: int = 1
    MaxParallel: int = 1
    MaxFloat: float = 1.0

    def configurations(self) -> list[Configuration]:
        """Each threshold, condition and back-off, with the direct answer as the last layer."""
        ways = [{"Backoff": "splitProperty", "Merger": m, "Splitter": s} for m, s in product(self.Merger, self.Splitter)]
        ways += [{"Backoff": "deleteLowFrequency", "ParallelExecutions": p, "Stepsize": s} for p, s in product(range(1, self.MaxParallel + 1), self.Steps)]
        out = []
        for threshold, condition, way in product(range(1, self.MaxThreshold + 1), self.Conds, ways):
            first = LayerConfig(Condition=condition, Threshold=threshold, **way)
            if condition == "tooUnlikelyRecommendationsCondition":
                first.ThresholdFloat = threshold / self.MaxThreshold * self.MaxFloat
            out.append(Configuration(Layers=[first, LayerConfig(Condition="always", Backoff="standard")]))
        return out
