"""Support and recommendation for whole tables of requests.

A request is (qid, s): s its items' ranks, sorted and distinct. Requests meet the patterns that hold their rarest item
by an equi-join and keep those that contain the rest, so a frequent item is a join key only where a request holds
nothing rarer. With a written model they meet its postings there, which are bucketed by that item and not shuffled, and
requests of one item meet its pairs. `one` answers a request whose items the driver knows: it reads one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.model import MOST_PLACES, Model, place

LIMIT = 500
#: Tasks over which the requests without items are spread.
SPREAD = 64


def requests(model: Model, named: DataFrame, unknown: str = "drop") -> DataFrame:
    """(qid, s) from (qid, items array<string>). An unknown item is dropped, or ('empty') makes the request answerless.

    Repeated items count once. A request whose items are all dropped has an empty s.
    """
    if unknown not in ("drop", "empty"):
        raise ValueError("unknown must be 'drop' or 'empty'")
    rows = named.select("qid", F.explode_outer(F.array_distinct("items")).alias("iri")).join(model.items.select("iri", "item"), "iri", "left")
    missing = F.count_if(F.col("iri").isNotNull() & F.col("item").isNull())
    out = rows.groupBy("qid").agg(F.sort_array(F.collect_list("item")).alias("s"), missing.alias("missing"))
    if unknown == "empty":
        out = out.where("missing = 0")
    return out.select("qid", "s")


def matches(model: Model, queries: DataFrame) -> DataFrame:
    """(qid, s, items, support) for each request with items and each pattern that contains them."""
    asked = queries.where(F.size("s") > 0).select("qid", "s")
    asked = asked.withColumn("pivot", F.element_at("s", -1))
    if model.postings is not None:
        if model.n_placed:
            asked = asked.join(model.places.select(F.col("item").alias("pivot"), "places"), "pivot", "left")
        parts = F.coalesce("places", F.lit(1)) if model.n_placed else F.lit(1)
        asked = asked.select("qid", "s", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda n: place("pivot", n))).alias("place"))
        met = model.postings.join(asked, "place")
    else:
        postings = model.patterns.select("items", "support", F.explode("items").alias("pivot"))
        met = postings.join(asked, "pivot")
    return met.where((F.size("items") >= F.size("s")) & (F.size(F.array_except("s", "items")) == 0)).select("qid", "s", "items", "support")


def one(model: Model, names: list[str], include_types: bool = False, limit: int | None = LIMIT, unknown: str = "drop") -> DataFrame:
    """(item, property, probability, rank): the answer to one request by names, from a written model.

    The dictionary's entries of the names are looked up by the driver, so the places to read are constants of the plan.
    Unknown names as in `requests`.
    """
    names = list(dict.fromkeys(names))
    known = model.entries(names)
    items, found = sorted(e[0] for e in known.values()), None
    if unknown == "empty" and len(known) < len(names):
        found = model.items.where("false").select("item", F.col("iri").alias("property"), F.lit(0.0).alias("probability"))
    elif not items:
        all_ = model.n_transactions().first()[0]
        share = F.col("total_count") / F.lit(all_) if all_ else F.lit(None).cast("double")
        found = model.items.select("item", F.col("iri").alias("property"), share.alias("probability"))
    elif len(items) == 1 and model.pairs is not None:
        count = next(iter(known.values()))[2]
        rows = model.pairs.where(F.col("item") == items[0])
        if not include_types:
            rows = rows.where("not other_is_type")
        found = rows.select(F.col("other").alias("item"), F.col("other_iri").alias("property"), (F.col("support") / F.lit(count)).alias("probability"))
    else:
        held = F.lit(True)
        for item in items[:-1]:
            held &= F.array_contains("items", item)
        if model.postings is None:
            rows = model.patterns.where(held & F.array_contains("items", items[-1]))
        else:
            parts = model.places.where(F.col("item") == items[-1]).first() if model.n_placed else None
            rows = model.postings.where(F.col("place").isin([items[-1] * MOST_PLACES + n for n in range(parts["places"] if parts else 1)]) & held)
        counts = rows.select(F.explode("items").alias("item"), "support").groupBy("item").agg(F.sum("support").alias("n"))
        # each match holds the pivot; a row an item at most
        counts = counts.withColumn("all", F.max(F.when(F.col("item") == items[-1], F.col("n"))).over(Window.partitionBy()))
        own = model.items.select("item", F.col("iri").alias("property"), "is_type")
        found = counts.where(~F.col("item").isin(items)).join(own if include_types else own.where("not is_type"), "item")
        found = found.select("item", "property", (F.col("n") / F.col("all")).alias("probability"))
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("probability"), "item")))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def support(model: Model, queries: DataFrame) -> DataFrame:
    """(qid, support, fraction): transactions that contain the request; all of them for an empty one."""
    total = model.n_transactions().withColumn("one", F.lit(1))
    counted = matches(model, queries).groupBy("qid").agg(F.sum("support").alias("found"))
    rows = queries.select("qid", "s").join(counted, "qid", "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    found = F.when(F.size("s") == 0, F.col("n")).otherwise(F.coalesce("found", F.lit(0)))
    return rows.select("qid", found.alias("support"), F.when(F.col("n") > 0, found / F.col("n")).alias("fraction"))


def popularity(model: Model, queries: DataFrame) -> DataFrame:
    """(qid, item, probability) of every dictionary entry, types and unseen ones too, for requests without items."""
    total = model.n_transactions().withColumn("one", F.lit(1))
    asked = queries.where(F.size("s") == 0).select("qid", F.pmod(F.xxhash64("qid"), F.lit(SPREAD)).alias("part"))
    shares = model.items.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("item", F.when(F.col("n") > 0, F.col("total_count") / F.col("n")).alias("probability"))
    parts = shares.select("item", "probability", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("part"))
    return asked.join(parts, "part").select("qid", "item", "probability")


def candidates(model: Model, queries: DataFrame, include_types: bool = False) -> DataFrame:
    """(qid, item, probability) of all candidates, without ranks; one pass over the matches gives totals and counts."""
    if model.pairs is not None:
        single = queries.where(F.size("s") == 1).select("qid", F.col("s")[0].alias("item"))
        counts = model.items.select("item", "total_count")
        pairs = model.pairs if include_types else model.pairs.where("not other_is_type")
        paired = pairs.join(single, "item").join(counts, "item").select("qid", F.col("other").alias("item"), (F.col("support") / F.col("total_count")).alias("probability"))
        rest = candidates(Model(model.items, model.patterns, model.postings, None, model.places, model.n_placed, model.total), queries.where(F.size("s") != 1), include_types)
        return rest.unionByName(paired)
    rows = matches(model, queries).select("qid", F.explode(F.concat(F.array(F.lit(-1)), F.array_except("items", "s"))).alias("item"), "support")
    counts = rows.groupBy("qid", "item").agg(F.sum("support").alias("n"))
    total = F.max(F.when(F.col("item") == -1, F.col("n"))).over(Window.partitionBy("qid"))
    found = counts.select("qid", "item", (F.col("n") / total).alias("probability")).where("item >= 0")
    if not include_types:
        found = found.join(model.items.where("is_type").select("item"), "item", "left_anti").select("qid", "item", "probability")
    return found.unionByName(popularity(model, queries))


def rank(found: DataFrame, limit: int | None = None) -> DataFrame:
    """With rank from 1: by probability, ties by the item's rank; cut at the limit."""
    w = Window.partitionBy("qid").orderBy(F.desc("probability"), "item")
    out = found.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.where(F.col("rank") <= limit)


def recommend(model: Model, queries: DataFrame, include_types: bool = False, limit: int | None = LIMIT) -> DataFrame:
    """(qid, item, probability, rank)."""
    return rank(candidates(model, queries, include_types), limit)


def named(model: Model, ranked: DataFrame) -> DataFrame:
    """With property, the item's iri."""
    return ranked.join(model.items.select("item", F.col("iri").alias("property")), "item")


def top10_average(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, top10): the first ten probabilities' sum over ten, as float; missing ones count as 0."""
    sums = ranked.where("rank <= 10").groupBy("qid").agg(F.sum("probability").alias("total"))
    return queries.select("qid").join(sums, "qid", "left").select("qid", (F.coalesce("total", F.lit(0.0)) / 10).cast("float").alias("top10"))


def rendered_items(items: DataFrame) -> DataFrame:
    """text: each item's count, iri and rank."""
    return items.select(F.format_string("%dx\t%s (%d)", "total_count", "iri", "item").alias("text"))


def _in_order(named_rows: DataFrame, text: Column) -> DataFrame:
    rows = named_rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))).alias("rows"))
    return rows.select("qid", F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("text"))


def rendered_list(named_rows: DataFrame) -> DataFrame:
    """(qid, text): a request's properties between square brackets."""
    return _in_order(named_rows, F.concat("property", F.lit(" "))).select("qid", F.concat(F.lit("[ "), "text", F.lit("]")).alias("text"))


def rendered(named_rows: DataFrame) -> DataFrame:
    """(qid, text): a line a property with its probability, of answers cut at a limit."""
    return _in_order(named_rows, F.concat("property", F.lit(": "), F.col("probability").cast("string"), F.lit("\n")))
