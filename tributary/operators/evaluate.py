"""Leave-out evaluation: handlers make requests from test subjects, all are answered in one job, statistics follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import prefixes
from tributary.operators.model import Model
from tributary.operators.recommend import LIMIT, rank
from tributary.operators.workflow import Drop, Layer, Split
from tributary.session import materialize

#: Rank of a hit that never came, by handler where it differs.
MISSED = 500
MISSED_BY_HANDLER = {"historicTakeButType": 10_000}
#: Requests whose sets meet in a task, about.
REQUEST_ROWS = 1 << 18


def subjects(model: Model, transactions: DataFrame, unknown: str = "drop") -> DataFrame:
    """(subject, types, properties): a test subject's items as ranks, sorted.

    An item that the model lacks is dropped, or ('rare') stands as one rarer than all, so that sets with it have no
    answers; unknown types and properties are told by their names. A row of transactions with times stands for so many
    subjects with that set; then requests and results have times, and statistics count by them.
    """
    last = (1 << 31) - 1
    rows = transactions.select("subject", *_times(transactions), F.explode("items").alias("iri")).join(model.items.select("iri", "item", "is_type"), "iri", "left")
    if unknown == "drop":
        rows = rows.where("item is not null")
    own = F.struct(F.coalesce("item", F.lit(last)).alias("item"), "iri")
    is_type = F.coalesce("is_type", F.col("iri").startswith("t#"))

    def sorted_items(kind: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(kind, own))), lambda x: x["item"])

    return rows.groupBy("subject", *_times(rows)).agg(sorted_items(is_type).alias("types"), sorted_items(~is_type).alias("properties"))


def _times(rows: DataFrame) -> list[str]:
    return [c for c in ("times",) if c in rows.columns]


def _request(rows: DataFrame, s: Column, left: Column, number: Column) -> list[Column | str]:
    """path: the items in the handler's order, in which a subject's requests begin alike."""
    return ["subject", *_times(rows), number.alias("number"), F.array_sort(s).alias("s"), s.alias("path"), left.alias("left_out")]


def take_one_but_type(rows: DataFrame) -> DataFrame:
    """Each property once; the rest, with the types, asks."""
    every = rows.where(F.size("types") + F.size("properties") >= 2).select("*", F.explode("properties").alias("one"))
    return every.select(*_request(rows, F.array_remove(F.concat("types", "properties"), F.col("one")), F.array("one"), F.col("one")), F.size("types").alias("num_types"))


def take_all_but_best(rows: DataFrame) -> DataFrame:
    """Types and as many of the most frequent properties as there are types ask for the rest."""
    n = F.size("properties")
    best = F.least(F.size("types"), n - 1)
    some = rows.where((best > 0) & (best < F.size("types") + n))
    return some.select(*_request(rows, F.slice(F.concat("types", "properties"), F.lit(1), F.greatest(best, F.lit(0))), F.slice(F.concat("types", "properties"), F.greatest(best, F.lit(0)) + 1, F.size("types") + n), F.lit(0)), F.size("types").alias("num_types"))


def take_more_but_common(rows: DataFrame) -> DataFrame:
    """Types and the first one, two, ... properties ask for the rest."""
    every = rows.where(F.size("properties") > 1).select("*", F.explode(F.sequence(F.lit(1), F.size("properties") - 1)).alias("k"))
    return every.select(*_request(rows, F.concat("types", F.slice("properties", F.lit(1), F.col("k"))), F.slice("properties", F.col("k") + 1, F.size("properties")), F.col("k")), F.size("types").alias("num_types"))


def take_but_type(rows: DataFrame) -> DataFrame:
    """The types ask for the properties."""
    some = rows.where((F.size("types") > 0) & (F.size("properties") > 0))
    return some.select(*_request(rows, F.col("types"), F.col("properties"), F.lit(0)), F.size("types").alias("num_types"))


def historic_take_but_type(rows: DataFrame) -> DataFrame:
    """The types ask for each property by itself."""
    every = rows.where(F.size("types") > 0).select("*", F.explode("properties").alias("one"))
    return every.select(*_request(rows, F.col("types"), F.array("one"), F.col("one")), F.size("types").alias("num_types"))


HANDLERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "takeOneButType": take_one_but_type, "takeAllButBest": take_all_but_best, "takeMoreButCommon": take_more_but_common,
    "handlerTakeButType": take_but_type, "historicTakeButType": historic_take_but_type,
}


def direct(model: Model, asked: DataFrame) -> DataFrame:
    """Of sets (qid long, s, and path where there is one)."""
    path = "path" if "path" in asked.columns else "s"
    return rank(prefixes.candidates(model, asked.select("qid", F.col(path).alias("path"))), LIMIT)


#: Columns of evaluate().
RESULTS = ("subject string, number long, set_size int, num_left_out int, num_types int, rank int, tp long, tp_at_l long, num_found long, "
           "fn long, fp long, tn long, num_non_types int")


def _sets(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requests with items, each with its set's number, and the distinct sets (qid long, s, path), written once."""
    requests = requests.where(F.size("s") > 0)
    if "path" not in requests.columns:
        requests = requests.withColumn("path", F.col("s"))
    requests = materialize(requests, "asked")  # read for the sets, and again to compare
    # the least of arrays is found by a sort: equal ones meet in a hash table before it, and the parts follow the requests
    paths = requests.select("s", "path").distinct().repartition(max(8, -(-requests.count() // REQUEST_ROWS)), "s")
    sets = paths.groupBy("s").agg(F.min("path").alias("path"))
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("qid"), "s", "path"), "sets")
    return requests.drop("path").join(sets.select("qid", "s"), "s"), sets


def _ranks(found: DataFrame, *keys: str) -> DataFrame:
    """The ranks of a set's answers, LIMIT at most, as a map."""
    return found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("item", "rank"))).alias("ranks"))


def _compared(rows: DataFrame, model: Model, missed: int, *more: str) -> DataFrame:
    """One row a request with ranks: rank of the first hit and counts."""
    size = model.items.agg(F.count("*").alias("dictionary")).withColumn("one", F.lit(1))
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(size), "one")
    rows = rows.withColumn("hits", F.coalesce(F.filter(F.transform("left_out", lambda x: F.try_element_at("ranks", x)), lambda r: r.isNotNull()), F.array().cast("array<int>")))
    at_l = F.filter("hits", lambda r: r <= F.size("left_out"))
    rows = rows.select("subject", "number", F.size("s").alias("set_size"), F.size("left_out").alias("num_left_out"), "num_types", F.coalesce(F.array_min("hits"), F.lit(missed)).alias("rank"), F.size("hits").cast("long").alias("tp"),
                       F.size(at_l).cast("long").alias("tp_at_l"), F.coalesce(F.size("ranks"), F.lit(0)).cast("long").alias("num_found"), "dictionary", *_times(rows), *more)
    rows = rows.withColumns({"fn": F.col("num_left_out") - F.col("tp"), "fp": F.col("num_found") - F.col("tp")})
    return rows.withColumn("tn", F.col("dictionary") - F.col("tp") - F.col("fp") - F.col("fn")).withColumn("num_non_types", F.col("set_size") + F.col("num_left_out") - F.col("num_types")).drop("dictionary")


def evaluate(model: Model, requests: DataFrame, answer: Callable[[Model, DataFrame], DataFrame] = direct, missed: int = MISSED) -> DataFrame:
    """One row a request (with times where the requests have it): rank of the first hit and counts. Equal sets are answered once, in one batch.

    answer gets (qid long, s, path), path the set's items in an order in which sets begin alike. Requests without items
    are left out. tn is the dictionary's size without what is counted elsewhere.
    """
    asked, sets = _sets(requests)
    return _compared(asked.join(_ranks(answer(model, sets), "qid"), "qid", "left"), model, missed)


GROUPS = {"numTypes": "num_types", "numNonTypes": "num_non_types", "setSize": "set_size", "numLeftOut": "num_left_out"}


def _with_shares(results: DataFrame) -> DataFrame:
    nan = F.lit(float("nan"))
    share = lambda a, b: F.when(b == 0, nan).otherwise(a / F.when(b != 0, b))
    tp, left = F.col("tp"), F.col("num_left_out")
    return results.withColumns({"recall": share(tp, left), "precision": share(tp, F.col("num_found")), "precision_at_l": share(F.col("tp_at_l"), left)})


def _measures(results: DataFrame) -> list[Column]:
    """Over requests, each as often as its times say."""
    times, rank = F.col("times") if _times(results) else F.lit(1).cast("long"), F.col("rank").cast("long")
    every = F.sum(times)

    def mean(value: Column, of: Column | None = None) -> Column:
        own = times if of is None else F.when(of, times)
        return F.sum(own * value) / F.sum(own)

    def top(n) -> Column:
        return mean((F.col("rank") <= n).cast("long"))

    return [
        every.alias("subjects"), mean(rank).alias("mean"), F.coalesce(mean(rank, rank < MISSED), F.lit(float(MISSED))).alias("mean_of_hits"), F.percentile("rank", F.lit(0.5), times).alias("median"),
        ((F.sum(times * rank * rank) - F.sum(times * rank) * (F.sum(times * rank) / every)) / every).alias("variance"),
        top(1).alias("top1"), top(5).alias("top5"), top(10).alias("top10"), top(F.col("num_left_out")).alias("topl"), mean(F.col("recall")).alias("recall"), mean(F.col("precision")).alias("precision"),
        mean(F.col("precision_at_l")).alias("precision_at_l"), mean(F.col("precision"), F.col("num_found") > 0).alias("precision_defined")]


def statistics(results: DataFrame, group_by: str = "numNonTypes") -> DataFrame:
    """One row a group and one of group -1 for all, by grouping sets. Precision is NaN where a request of the group found nothing."""
    own = F.col("group")
    sets = _with_shares(results).withColumn("group", F.col(GROUPS[group_by])).groupingSets([[own], []], own)
    return sets.agg(F.grouping("group").alias("all"), *_measures(results)).withColumn("group", F.when(F.col("all") == 1, -1).otherwise(own)).drop("all")


def derived(stats: DataFrame) -> DataFrame:
    """With f1 and the reciprocal of the mean rank."""
    both = F.col("precision_at_l") + F.col("recall")
    return stats.withColumns({"f1": F.when(both > 0, 2 * F.col("precision_at_l") * F.col("recall") / both), "reciprocal_rank": F.when(F.col("mean") > 0, 1 / F.col("mean"))})


def set_sizes(transactions: DataFrame) -> DataFrame:
    """numNonTypes and count: distribution of non-type predicates a subject."""
    own = F.col("num_predicates") - F.col("num_type_predicates")
    return transactions.groupBy(own.alias("num_non_types")).agg(F.count("*").alias("count"))


def _drops(layers: list[Layer]) -> list[tuple]:
    """(parallel, step) of what the layers may drop, once each."""
    return list(dict.fromkeys((x.procedure.parallel, x.procedure.step) for x in layers if isinstance(x.procedure, Drop)))


def _dropped(step: Callable, k: int, parallel: int) -> Column:
    """How many items the k-th step drops, at most all."""
    n = F.size("s")
    return F.least(F.greatest(step(n, F.lit(k), parallel), F.lit(0)), n).cast("int")


def _shared_answers(model: Model, sets: DataFrame, layers: list[Layer]) -> DataFrame:
    """(qid, kind, part, item, probability) of all sub-requests of the layers, each distinct set answered once, in one batch.

    kind -1: the set without its `part` rarest items; kind 0, 1, ...: part 0 or 1 of the n-th splitter. Answers leave out
    the items of the whole set.
    """
    numbers = [F.lit(0)] + [_dropped(step, k, parallel) for parallel, step in _drops(layers) for k in range(1, parallel + 1)]
    dropped = F.transform(F.array_distinct(F.array(*numbers)), lambda d: F.struct(F.lit(-1).alias("kind"), d.alias("part"), F.slice("s", F.lit(1), F.size("s") - d).alias("own")))
    parts = [F.struct(F.lit(n).alias("kind"), F.lit(part).alias("part"), own.alias("own")) for n, splitter in enumerate(_splitters(layers)) for part, own in enumerate(splitter(F.col("s")))]
    every = F.concat(dropped, F.array(*parts)) if parts else dropped
    subs = sets.select("qid", "s", F.explode(every).alias("sub")).select("qid", "s", "sub.*")
    distinct = materialize(subs.select("own").distinct().select(F.monotonically_increasing_id().alias("sub"), "own"), "sub-requests")
    found = prefixes.candidates(model, distinct.select(F.col("sub").alias("qid"), F.col("own").alias("path"))).withColumnRenamed("qid", "sub")
    rows = subs.join(distinct, "own").join(found, "sub").where(~F.array_contains("s", F.col("item")))
    return materialize(rows.select("qid", "kind", "part", "item", "probability"), "sub-answers")


def _splitters(layers: list[Layer]) -> list[Callable]:
    return list(dict.fromkeys(x.procedure.splitter for x in layers if isinstance(x.procedure, Split)))


def _ways(sets: DataFrame, ranked: DataFrame, workflows: dict[int, list[Layer]], layers: list[Layer]) -> DataFrame:
    """(config, qid, way): what answers a set in each workflow, by the counts of the set's reductions; none where no condition holds."""
    counts = ranked.groupBy("qid", "part").agg(F.count("*").alias("n"), (F.sum(F.when(F.col("rank") <= 10, F.col("probability"))) / 10).cast("float").alias("top10"))
    by_part = counts.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("part", F.struct("n", "top10")))).alias("of"))
    facts = sets.join(by_part, "qid", "left")

    def of(part: Column, name: str) -> Column:
        value = F.try_element_at("of", part)[name]
        return F.coalesce(value, F.lit(0).cast("long" if name == "n" else "float"))

    facts = facts.withColumns({"size": F.size("s"), "n_direct": of(F.lit(0), "n"), "top10": of(F.lit(0), "top10")})
    splitters = _splitters(layers)

    def way(layer: Layer) -> Column:
        p = layer.procedure
        if p is None:
            return F.lit("drop 0")
        if isinstance(p, Drop):
            steps = [_dropped(p.step, k, p.parallel) for k in range(1, p.parallel + 1)]
            first = F.coalesce(*(F.when(p.passes.holds(of(d, "n"), of(d, "top10")), d) for d in steps), steps[-1])
            return F.format_string("drop %d", first)
        if isinstance(p, Split):
            return F.lit(f"split {splitters.index(p.splitter)} {p.merger.__name__}")
        return F.lit(f"other {layers.index(layer)}")

    chosen = []
    for number, own in workflows.items():
        one = F.lit(None).cast("string")
        for layer in reversed(own):
            one = F.when(layer.condition(), way(layer)).otherwise(one)
        chosen.append(F.struct(F.lit(number).alias("config"), one.alias("way")))
    return facts.select("qid", F.explode(F.array(*chosen)).alias("c")).select("qid", "c.config", "c.way")


def batch(model: Model, requests: DataFrame, workflows: dict[int, list[Layer]], missed: int = MISSED) -> DataFrame:
    """The overall statistics of several workflows over the same requests, with config.

    All workflows' sub-requests are one table, each distinct one is answered once, and each workflow chooses among the
    answers; what several choose is compared with the left-out items once. So the plan's reads don't grow with the number
    of workflows. A back-off's test must be one of backoff's; procedures of another kind are answered for themselves.
    """
    layers = list(dict.fromkeys(x for own in workflows.values() for x in own))
    asked, sets = _sets(requests)
    shared = _shared_answers(model, sets, layers)
    dropped = shared.where("kind = -1").select(F.struct("qid", "part").alias("qid"), "item", "probability")
    ranked = rank(dropped).select("qid.qid", "qid.part", "item", "probability", "rank")
    ways = materialize(_ways(sets, ranked, workflows, layers), "ways")
    found = ranked.where(F.col("rank") <= LIMIT).select("qid", F.format_string("drop %d", "part").alias("way"), "item", "rank")
    for n, splitter in enumerate(_splitters(layers)):
        parts = shared.where(F.col("kind") == n)
        for merger in dict.fromkeys(x.procedure.merger for x in layers if isinstance(x.procedure, Split) and x.procedure.splitter is splitter):
            merged = rank(merger(parts, len(splitter(F.col("s")))), LIMIT)
            found = found.unionByName(merged.select("qid", F.lit(f"split {n} {merger.__name__}").alias("way"), "item", "rank"))
    for n, layer in enumerate(layers):
        if layer.procedure is not None and not isinstance(layer.procedure, (Drop, Split)):
            own = ways.where(F.col("way") == f"other {n}").select("qid").distinct()
            answers = rank(layer.procedure(model, sets.join(own, "qid", "left_semi")).select("qid", "item", "probability"), LIMIT)
            found = found.unionByName(answers.select("qid", F.lit(f"other {n}").alias("way"), "item", "rank"))
    wanted = ways.groupBy("qid", F.coalesce("way", F.lit("none")).alias("way")).agg(F.collect_list("config").alias("configs"))
    ranks = wanted.join(_ranks(found, "qid", "way"), ["qid", "way"], "left")
    compared = _compared(asked.join(ranks, "qid"), model, missed, "configs")
    each = _with_shares(compared).withColumn("config", F.explode("configs"))
    return each.groupBy("config").agg(*_measures(each)).withColumn("group", F.lit(-1))


def write_statistics(stats: DataFrame, path: str, group_by: str) -> None:
    """The statistics as CSV: rates in percent, deviation instead of variance."""
    rates = [(F.col(c) * 100).alias(c) for c in ("top1", "top5", "top10", "topl", "recall", "precision", "precision_at_l")]
    stats.select(F.col("group").alias(group_by), "subjects", "mean", "mean_of_hits", "median", F.sqrt("variance").alias("stddev"), *rates).orderBy(group_by).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("compression", "gzip").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What write_results wrote."""
    return spark.read.schema(RESULTS).json(path)
