"""The association-rule baseline: mining property pairs, and suggesting by their probabilities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.model import Model
from tributary.operators.recommend import SPREAD, rank

#: Properties whose value classifies an entity, and the least probability of a rule.
CLASSIFYING = (31, 279)
LEAST_PROBABILITY = 0.01
DIRECT = "http://www.wikidata.org/prop/direct/"
COLUMNS = ("pid1", "qid1", "pid2", "count", "probability", "context")
SCHEMA = "pid1 int, qid1 int, pid2 int, count bigint, probability double, context string"


#: Pairs of an entity that are made in one task; entities with more are cut into parts of about so many.
PAIRS_AT_ONCE = 1 << 22
CONTEXTS = ("item", "qualifier", "reference")


def _sources(entities: DataFrame, classifying: tuple[int, ...], contexts: tuple[str, ...], without: Column | None = None) -> DataFrame:
    """(own, sources): an entity's distinct properties, and what stands on the left of its pairs.

    A source is (the context's number, pid1, qid1, times, others): others are the properties that go with it, null where those are
    own. Classifying properties count with their value, once a claim; other ones of the item once. An entity for which
    `without` holds has no sources.
    """
    kind = "array<struct<context: int, pid1: int, qid1: int, times: bigint, others: array<int>>>"
    own = F.array_distinct(F.transform("claims", lambda c: c["mainsnak"]["property_id"]))
    number = lambda s: F.when(F.substring(s["value"], 2, 1 << 30).rlike("^[0-9]+$"), F.substring(s["value"], 2, 1 << 30).try_cast("int"))
    valued = F.transform("claims", lambda c: F.when(c["mainsnak"]["property_id"].isin(*classifying) & number(c["mainsnak"]).isNotNull(), F.struct(c["mainsnak"]["property_id"].alias("pid"), number(c["mainsnak"]).alias("qid"))))
    rows = entities.select("claims", own.alias("own"), F.array_compact(valued).alias("valued"), (F.lit(False) if without is None else without).alias("without"))
    none = F.lit(None).cast("array<int>")

    def source(context: str, pid: Column, qid: Column, times: Column, others: Column) -> Column:
        return F.struct(F.lit(CONTEXTS.index(context)).alias("context"), pid.alias("pid1"), qid.alias("qid1"), times.cast("long").alias("times"), others.alias("others"))

    parts = []
    if "item" in contexts:
        counted = F.transform("valued", lambda t: source("item", t["pid"], t["qid"], F.lit(1), none))
        plain = F.transform(F.filter("own", lambda p: ~p.isin(*classifying)), lambda p: source("item", p, F.lit(-1), F.lit(1), none))
        parts += [plain.cast(kind), counted.cast(kind)]
    def attached(context: str) -> Column:
        every = F.transform("claims", lambda c: source(context, c["mainsnak"]["property_id"], F.lit(-1), F.lit(1), F.array_distinct(F.transform(c[f"{context}s"], lambda s: s["property_id"]))))
        return F.filter(every, lambda x: F.size(x["others"]) > 0).cast(kind)

    parts += [attached(context) for context in contexts if context != "item"]
    return rows.select("own", F.when(~F.col("without"), F.concat(*parts)).otherwise(F.array().cast(kind)).alias("sources"))


def mined(entities: DataFrame, classifying: tuple[int, ...] = CLASSIFYING, contexts: tuple[str, ...] = CONTEXTS) -> DataFrame:
    """The rules of the contexts. All pairs of an entity are made from its one row, so only counts are shuffled.

    Sources of an entity with more than PAIRS_AT_ONCE pairs are cut into parts, which are dealt anew. A source's total is
    counted in the same step, as its pair with no property. qid1 is null for rules of properties that don't classify.
    """
    # an entity of n claims has at most 4n sources and n properties; the others are looked at by themselves
    n = F.size("claims").cast("long")
    large = 4 * n * n > PAIRS_AT_ONCE
    light = _sources(entities, classifying, contexts, large)
    rows = _sources(entities.where(large), classifying, contexts)
    each = F.greatest(F.lit(1), (F.lit(PAIRS_AT_ONCE) / F.greatest(F.size("own"), F.lit(1))).cast("int"))
    cut = rows.select("own", "sources", each.alias("each"), F.explode(F.sequence(F.lit(0), F.floor((F.size("sources") - 1) / each).cast("int"))).alias("part"))
    heavy = cut.select("own", F.slice("sources", F.col("part") * F.col("each") + 1, F.col("each")).alias("sources")).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    # the outer forms of explode have no filters of their own, which would make the arrays anew
    single = light.unionByName(heavy).select("own", F.posexplode_outer("sources").alias("n", "source")).where("n is not null").select("own", "source.*")
    others = F.coalesce("others", F.array_remove("own", F.col("pid1")))
    counts = single.select("context", "pid1", "qid1", "times", F.explode_outer(F.concat(F.array(F.lit(-1)), others)).alias("pid2"))
    counts = counts.groupBy("context", "pid1", "qid1", "pid2").agg(F.sum("times").alias("count"))
    total = F.max(F.when(F.col("pid2") == -1, F.col("count"))).over(Window.partitionBy("context", "pid1", "qid1"))
    found = counts.withColumn("total", total).where("pid2 >= 0")
    return found.select("pid1", F.when(F.col("qid1") >= 0, F.col("qid1")).alias("qid1"), "pid2", "count", (F.col("count") / F.col("total")).alias("probability"), F.get(F.array(*map(F.lit, CONTEXTS)), F.col("context")).alias("context"))


def item_rules(entities: DataFrame, classifying: tuple[int, ...] = CLASSIFYING) -> DataFrame:
    """Pairs within an entity. A classifying property counts with its value, once a claim; others once an entity."""
    return mined(entities, classifying, ("item",))


def attached_rules(entities: DataFrame, context: str) -> DataFrame:
    """Pairs of a claim's property and the distinct properties of its qualifiers or references."""
    return mined(entities, contexts=(context,))


def compute(entities: DataFrame, least: float = LEAST_PROBABILITY, classifying: tuple[int, ...] = CLASSIFYING) -> DataFrame:
    """All rules of more than the least probability, from one pass over the entities."""
    return mined(entities, classifying).where(F.col("probability") > least)


def suggest(rules: DataFrame, asked: DataFrame, context: str = "item", least: float = 0.0, limit: int | None = None, include: str = "new",
            deprecated: tuple[int, ...] = (), initial: tuple[int, ...] = ()) -> DataFrame:
    """(qid, pid2, probability, rank) for asked (qid, properties array<int>, tuples array<struct<pid: int, qid: int>>).

    The score is the sum of the probabilities of the rules that apply over the number of properties and tuples asked.
    With tuples, only rules of the tuples apply (a property that does not classify asks as a tuple of qid 0); else
    those of the properties, whatever their qid1. With include 'new', asked and deprecated properties are not suggested;
    with 'all' they may be. A request of nothing gets the initial suggestions.
    """
    if include not in ("all", "new"):
        raise ValueError("include must be 'all' or 'new'")
    n = F.size("properties")
    given = asked.select("qid", "properties", "tuples", n.alias("n"))
    by_tuple = given.where(F.size("tuples") > 0).select("qid", F.explode("tuples").alias("t")).select("qid", F.col("t.pid").alias("pid1"), F.col("t.qid").alias("qid1"))
    by_property = given.where(F.size("tuples") == 0).select("qid", F.explode(F.array_distinct("properties")).alias("pid1"))
    own = rules.where(F.col("context") == context).select("pid1", F.coalesce("qid1", F.lit(0)).alias("qid1"), "pid2", "probability")
    hits = by_property.join(own, "pid1").select("qid", "pid2", "probability").unionByName(by_tuple.distinct().join(own, ["pid1", "qid1"]).select("qid", "pid2", "probability"))
    sums = hits.groupBy("qid", "pid2").agg(F.sum("probability").alias("total")).join(given.select("qid", "properties", "n"), "qid")
    if include == "new":
        sums = sums.where(~F.array_contains("properties", F.col("pid2")))
        if deprecated:
            sums = sums.where(~F.col("pid2").isin(*deprecated))
    scored = sums.select("qid", "pid2", (F.col("total") / F.col("n")).alias("probability")).where(F.col("probability") > least)
    if initial:
        first = F.explode(F.array(*map(F.lit, initial)))
        scored = scored.unionByName(given.where("n = 0").select("qid", first.alias("pid2"), F.lit(1.0).alias("probability")))
    ranked = rank(scored.withColumnRenamed("pid2", "item"), limit)
    return ranked.withColumnRenamed("item", "pid2")


def of_entities(entities: DataFrame, classifying: tuple[int, ...] = CLASSIFYING) -> DataFrame:
    """Requests from whole entities: every statement counts, classifying ones with their value as tuples."""
    number = lambda s: F.substring(s["value"], 2, 1 << 30)
    main = F.col("claims.mainsnak")
    tuples = F.transform(main, lambda s: F.struct(s["property_id"].alias("pid"), F.when(s["property_id"].isin(*classifying), number(s).try_cast("int")).otherwise(0).alias("qid")))
    tuples = F.filter(tuples, lambda t: t["qid"].isNotNull())
    return entities.select(F.col("title").alias("qid"), F.transform(main, lambda s: s["property_id"]).alias("properties"), tuples.alias("tuples"))


def suggester(rules: DataFrame, use_types: bool = False, use_properties: bool = True) -> Callable[[Model, DataFrame], DataFrame]:
    """The rules as a procedure of a workflow: (qid, item, probability, rank) by the numbers of direct properties and type items."""
    def answer(model: Model, queries: DataFrame) -> DataFrame:
        number = lambda pattern: F.regexp_extract("iri", pattern, 1).try_cast("int")
        own = queries.select("qid", F.explode("s").alias("item")).join(model.items.select("item", "iri", "is_type"), "item")
        own = own.select("qid", F.when(~F.col("is_type"), number(f"^{DIRECT}P([0-9]+)$")).alias("pid"), F.when(F.col("is_type"), number("/Q([0-9]+)$")).alias("type"))
        asked = own.groupBy("qid").agg(F.collect_list("pid").alias("pids"), F.collect_list("type").alias("types"))
        none, no_tuple = F.array().cast("array<int>"), F.array().cast("array<struct<pid: int, qid: int>>")
        pids, types = F.col("pids") if use_properties else none, F.col("types") if use_types else none
        classes = F.transform(types, lambda _: F.lit(CLASSIFYING[0]))
        tuples = F.concat(F.transform(types, lambda t: F.struct(F.lit(CLASSIFYING[0]).alias("pid"), t.alias("qid"))), F.transform(pids, lambda p: F.struct(p.alias("pid"), F.lit(0).alias("qid"))))
        found = suggest(rules, asked.select("qid", F.concat(pids, classes).alias("properties"), (tuples if use_types else no_tuple).alias("tuples")))
        items = model.items.where("not is_type").select("item", "iri")
        return rank(found.withColumn("iri", F.concat(F.lit(f"{DIRECT}P"), "pid2")).join(items, "iri").select("qid", "item", "probability"))

    return answer


def of_lists(lists: DataFrame) -> DataFrame:
    """Requests from (qid, ids array<string>): P ids ask as properties, others as values of the first classifying one."""
    is_property = lambda i: i.startswith("P")
    number = lambda i: F.substring(i, 2, 1 << 30).cast("int")
    properties = F.transform("ids", lambda i: F.when(is_property(i), number(i)).otherwise(CLASSIFYING[0]))
    tuples = F.transform(F.filter("ids", lambda i: ~is_property(i)), lambda i: F.struct(F.lit(CLASSIFYING[0]).alias("pid"), number(i).alias("qid")))
    return lists.select("qid", properties.alias("properties"), tuples.alias("tuples"))


@dataclass(frozen=True)
class Asked:
    """The checked parameters of a page of suggestions: of an entity or of a list of ids, not of both."""

    entity: str | None
    properties: tuple[str, ...]
    search: str
    offset: int
    size: int
    limit: int
    least: float

    @classmethod
    def of(cls, entity: str | None = None, properties: tuple[str, ...] = (), search: str = "", offset: str | int | None = None, limit: int = 500, least: float = 0.0) -> Asked:
        """search '*' asks for all; with a search all suggestions are looked through, whatever their probability."""
        if bool(entity) == bool(properties):
            raise ValueError("give either an entity or a list of properties")
        if not (offset is None or str(offset).isdigit()):
            raise ValueError("the offset must be a number")
        start, text = int(offset or 0), "" if search == "*" else search.strip()
        size = min(limit + start, limit)
        return cls(entity, tuple(properties), text, start, size, limit if text else size, 0.0 if text else least)


def suggest_page(rules: DataFrame, terms: DataFrame, language: str, asked: Asked, entities: DataFrame | None = None, **options) -> DataFrame:
    """The page of suggestions that the parameters ask for; entities: (title, claims), of which one is asked by its title."""
    spark = rules.sparkSession
    if asked.entity:
        if entities is None:
            raise ValueError("an entity needs entities")
        requests = of_entities(entities.where(F.col("title") == asked.entity))
    else:
        requests = of_lists(spark.createDataFrame([(0, list(asked.properties))], "qid long, ids array<string>"))
    found = suggest(rules, requests, least=asked.least, limit=asked.limit, **options)
    return search(found, terms, asked.search, language, asked.size, asked.offset)


def made_terms(glossary: DataFrame) -> DataFrame:
    """(lang, term, pid, nth, label, description, alias): labels (nth 0) and aliases (from 1) in lower case, for `search`.

    glossary: (pid int, lang, label), and description string and aliases array<string> where there are any.
    """
    own = {"description": F.lit(None).cast("string"), "aliases": F.array().cast("array<string>")}
    extra = [F.col(c) if c in glossary.columns else x.alias(c) for c, x in own.items()]
    rows = glossary.select("pid", "lang", "label", *extra)
    names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = rows.select("pid", "lang", "label", "description", F.posexplode(names).alias("nth", "name"))
    rows = rows.where(F.col("name").isNotNull() | (F.col("nth") == 0))
    return rows.select("lang", F.lower("name").alias("term"), "pid", "nth", "label", "description", F.when(F.col("nth") > 0, F.col("name")).alias("alias"))


def write_terms(glossary: DataFrame, path: str) -> DataFrame:
    """The terms in the order of language and term, so that a prefix is a range of few row groups."""
    made_terms(glossary).repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").write.mode("overwrite").parquet(path)
    return glossary.sparkSession.read.parquet(path)


def after(prefix: str) -> str | None:
    """The smallest string above all that begin with the prefix; None if there is none."""
    while prefix:
        last = ord(prefix[-1]) + 1
        if last <= 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if last == 0xD800 else last)
        prefix = prefix[:-1]
    return None


def search(suggested: DataFrame, terms: DataFrame, prefix: str, language: str, size: int, offset: int = 0) -> DataFrame:
    """A page of the suggestions whose label or an alias begins with the prefix in any case, best first, then of other hits.

    terms: of made_terms or write_terms. Adds label (else the id), description, the first alias that matches where the
    label doesn't, place (from 1, of all pages), and next, the offset of the next page where this one is full. An empty
    prefix leaves every suggestion in. Other hits go by their ids; a request needs no more of them than twice its pages'
    length, as it has fewer suggestions than that among them where it needs any.
    """
    own, low = terms.where(F.col("lang") == language), prefix.lower()
    shown, end = ("label", "description", "alias"), offset + size
    if prefix:
        inside = F.col("term") >= low
        if (high := after(low)) is not None:
            inside &= F.col("term") < high
        best = own.where(inside).groupBy("pid").agg(F.min_by(F.struct(*shown), "nth").alias("of"))
        hits = best.select(F.col("pid").alias("pid2"), "of.*")
        found = suggested.join(hits, "pid2")
    else:
        found = suggested.join(own.where("nth = 0").select(F.col("pid").alias("pid2"), "label", "description", "alias"), "pid2", "left")
    found = found.select("qid", "pid2", *shown, F.lit(0).alias("part"), "rank")
    if prefix:
        first = hits.orderBy("pid2").limit(2 * end).select("pid2", *shown, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
        asked = suggested.select("qid").distinct().withColumn("spread", F.pmod(F.xxhash64("qid"), F.lit(SPREAD)).cast("int"))
        every = asked.join(first, "spread").select("qid", "pid2", *shown, F.lit(1).alias("part"), F.col("pid2").alias("rank"))
        found = found.unionByName(every.join(found.select("qid", "pid2"), ["qid", "pid2"], "left_anti").select(*found.columns))
    w = Window.partitionBy("qid")
    placed = found.withColumn("place", F.row_number().over(w.orderBy("part", "rank"))).where(F.col("place") <= end)
    placed = placed.withColumn("next", F.when(F.max("place").over(w) == end, end)).where(F.col("place") > offset)
    return placed.select("qid", "pid2", F.coalesce("label", F.concat(F.lit("P"), "pid2")).alias("label"), "description", "alias", "place", "next")
