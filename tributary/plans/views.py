"""The test tables as subjects with items, as triples and as entities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import prepare, rules
from tributary.operators.model import Model
from tributary.operators.transactions import MOST_WORDS, TYPE_MARK, WORD, coded, distinct_sets, from_pairs, sets_of_bits
from tributary.session import exists, file_state, shared_dir, table


def order_pairs(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    """(subject, item): orders with the brands of their parts; typed, also with their priority as a type."""
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(brand, "l_partkey").select(F.col("l_orderkey").alias("subject"), "item")
    if typed:
        types = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject"), F.concat(F.lit(TYPE_MARK), "o_orderpriority").alias("item"))
        pairs = pairs.unionByName(types)
    return pairs


def transactions(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    return from_pairs(order_pairs(spark, sf_dir, typed))


#: Parts with more rows than this are not left to a broadcast.
BROADCAST_PARTS = 1 << 21


def made_sets(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    """(subject, items, times): the distinct item sets of transactions; each with its smallest subject and how many have it.

    Brands and priorities become bits before the join, so it and the shuffle by order move numbers.
    """
    part, orders, lines = (table(spark, sf_dir, name) for name in ("part", "orders", "lineitem"))
    kinds = part.select(F.col("p_brand").alias("item"))
    if typed:
        types = orders.select(F.col("o_orderkey").alias("subject"), F.concat(F.lit(TYPE_MARK), "o_orderpriority").alias("item"))
        kinds = kinds.unionByName(types.select("item"))
    most = WORD * MOST_WORDS
    names = sorted(r[0] for r in kinds.where("item is not null").distinct().limit(most + 1).collect())
    if len(names) > most:
        return distinct_sets(transactions(spark, sf_dir, typed))
    bits = part.select(F.col("p_partkey").alias("l_partkey"), *coded("p_brand", names))
    if part.count() > BROADCAST_PARTS:
        bits = bits.hint("shuffle_hash")
    pairs, n = lines.select("l_orderkey", "l_partkey").join(bits, "l_partkey").select(F.col("l_orderkey").alias("subject"), "word", "bit"), lines.count()
    if typed:
        pairs, n = pairs.unionByName(types.select("subject", *coded("item", names))), n + orders.count()
    return sets_of_bits(pairs, names, n)


_sets: dict[tuple, str] = {}


def sets(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    """made_sets, made once for the state of the tables and read from the shared folder by the models and the evaluations."""
    state = tuple(file_state(spark, f"{sf_dir}/{name}.parquet") for name in ("lineitem", "part", "orders"))
    key = (spark.sparkContext.applicationId, sf_dir, state, typed)
    if key not in _sets or not exists(spark, _sets[key]):
        path = f"{shared_dir(spark)}/sets/{uuid.uuid4().hex}"
        made_sets(spark, sf_dir, typed).write.parquet(path)
        _sets[key] = path
    return spark.read.parquet(_sets[key])


def built_model(spark: SparkSession, sf_dir: str, typed: bool = False) -> Model:
    return Model.of_patterns(sets(spark, sf_dir, typed).select("items", F.col("times").alias("support")))


#: Written models: by application, tables with the state of their files, and kind.
_written: dict[tuple, tuple[str, Model]] = {}


def model(spark: SparkSession, sf_dir: str, typed: bool = False) -> Model:
    """A model that is built once for the state of its tables, written to the shared folder, and read from there by all queries."""
    state = tuple(file_state(spark, f"{sf_dir}/{name}.parquet") for name in ("lineitem", "part", "orders"))
    key = (spark.sparkContext.applicationId, sf_dir, state, typed)
    if key not in _written or not exists(spark, _written[key][0]):
        path = f"{shared_dir(spark)}/models/{uuid.uuid4().hex}"
        built_model(spark, sf_dir, typed).save(path)
        _written[key] = path, Model.load(spark, path)
    return _written[key][1]


_mined: dict[tuple, str] = {}


def mined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the entities, mined once for the state of their tables and read from the shared folder."""
    state = tuple(file_state(spark, f"{sf_dir}/{name}.parquet") for name in ("lineitem", "part", "orders"))
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _mined or not exists(spark, _mined[key]):
        path = f"{shared_dir(spark)}/rules/{uuid.uuid4().hex}"
        rules.compute(entities(spark, sf_dir)).write.partitionBy("context").parquet(path)
        _mined[key] = path
    return spark.read.schema(rules.SCHEMA).parquet(_mined[key])


def event_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of N-Triples text from events, in the order of event_id: literals with blanks and escapes, comments."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 10
    subject = F.format_string("<http://www.wikidata.org/entity/%s%d>", F.when(kind < 8, F.lit("Q")).otherwise(F.lit("P")), "user_id")
    iri = F.format_string('%s <http://www.wikidata.org/prop/direct/P%d> "a \\"%s\\" b"@en .', subject, "user_id", "event_type")
    other = F.format_string("%s <http://schema.org/name> <http://e.org/%s> .", subject, "event_type")
    label = F.format_string('%s <http://www.w3.org/2000/01/rdf-schema#label> "%s" .', subject, "event_type")
    prop = F.format_string("%s <http://www.wikidata.org/prop/P%d> <http://e.org/%s> .", subject, "user_id", "event_type")
    comment = F.format_string("# %s", "event_type")
    line = F.when(kind < 4, iri).when(kind < 6, other).when(kind == 6, label).when(kind == 7, prop).when(kind == 8, comment).otherwise(iri)
    return e.select(F.col("event_id").alias("line_no"), line.alias("line"))


def order_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, s, p, o): orders by key, an rdf:type line whose class is by priority and status lines around it."""
    o = table(spark, sf_dir, "orders")
    cls = F.when(F.col("o_orderpriority").startswith("1"), prepare.ITEM_CLASSES[0]).when(F.col("o_orderpriority").startswith("2"), prepare.PROPERTY_CLASSES[0]).otherwise("<http://e.org/other>")
    s = F.format_string("<http://e.org/c%d>", "o_custkey")
    lines = o.select("o_orderkey", F.explode(F.array(
        F.struct((F.col("o_orderkey") * 2).alias("line_no"), s.alias("s"), F.lit(prepare.RDF_TYPE).alias("p"), cls.alias("o")),
        F.struct((F.col("o_orderkey") * 2 + 1).alias("line_no"), s.alias("s"), F.lit("<http://e.org/status>").alias("p"), F.format_string('"%s"', "o_orderstatus").alias("o")))).alias("t"))
    return lines.select("t.*")


def label_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, s, p, o): names and descriptions of sources in the documents' languages, whole texts with escapes."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    escaped = F.coalesce("text", F.lit(""))
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(written))
    text = F.concat(F.lit('"'), escaped, F.lit('"@'), F.col("lang"))
    predicate = F.when(F.col("doc_id") % 2 == 0, prepare.NAME).otherwise(prepare.DESCRIPTION)
    return d.select(F.col("doc_id").alias("line_no"), F.format_string("<http://e.org/%s>", "source").alias("s"), predicate.alias("p"), text.alias("o"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities: a classifying claim 31 of the priority, a claim a line of the part's brand and size."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("brand"), "p_size")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").join(part, "l_partkey")

    def snak(pid, value):
        return F.struct(pid.cast("int").alias("property_id"), F.lit("string").alias("datatype"), value.alias("value"))

    # a line's few numbers are shuffled; the claims are made of them afterwards
    nothing = F.array().cast("array<struct<property_id: int, datatype: string, value: string>>")
    lines = line.select(F.col("l_orderkey").alias("key"), F.struct(F.col("l_linenumber").alias("n"), (F.col("brand") + 100).alias("pid"), F.col("p_size").alias("size"), (F.col("l_returnflag") == "R").alias("returned"), F.lit(True).alias("of_line"), F.lit(None).cast("string").alias("class")).alias("x"))
    first = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.struct(F.lit(0).alias("n"), F.lit(31).alias("pid"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("boolean").alias("returned"), F.lit(False).alias("of_line"), F.substring("o_orderpriority", 1, 1).alias("class")).alias("x"))

    def claim(x):
        is_line = x["of_line"]
        main = snak(x["pid"], F.when(is_line, x["size"].cast("string")).otherwise(F.concat(F.lit("Q"), x["class"])))
        references = F.when(F.coalesce(x["returned"], F.lit(False)), F.array(snak(F.lit(300), F.lit("r")), snak(F.lit(300), F.lit("s")))).otherwise(F.array(snak(F.lit(301), F.lit("r"))))
        return F.struct(main.alias("mainsnak"), F.when(is_line, F.array(snak(x["size"] % 7 + 200, F.lit("q")))).otherwise(nothing).alias("qualifiers"), F.when(is_line, references).otherwise(nothing).alias("references"))

    grouped = lines.unionByName(first).groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("lines"))
    return grouped.select(F.col("key").cast("string").alias("title"), F.transform("lines", claim).alias("claims"))


def dump_texts(spark: SparkSession, sf_dir: str, listed: bool) -> DataFrame:
    """(title, value): orders as JSON of entities, claims as a map by property or, in the older form, as a list.

    A claim a line with the part's brand, its size as a quantity qualifier, its return flag as an item of the reference.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") + 100).alias("pid"), (F.col("p_size") % 7 + 200).alias("qual"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "R", 300).otherwise(301).alias("ref")).join(part, "l_partkey")
    # a line's three numbers are shuffled, once; the texts are made of them afterwards
    rows = line.groupBy("l_orderkey").agg(F.collect_list(F.struct("pid", "qual", "ref")).alias("lines"))
    pid, qual, ref = (lambda x: x["pid"]), (lambda x: x["qual"]), (lambda x: x["ref"])
    if listed:
        form = '{"m":["value",%d,"string","v\\"%d"],"q":[["value",%d,"quantity",{"amount":"+%d"}]],"refs":[[["value",%d,"wikibase-entityid",{"entity-type":"item","numeric-id":%d}]]]}'
        claims = F.transform("lines", lambda x: F.format_string(form, pid(x), pid(x), qual(x), pid(x), ref(x), ref(x)))
    else:
        snak = '{"snaktype":"value","property":"P%d","datatype":"'
        form = ('{"mainsnak":' + snak + 'string","datavalue":{"value":"v\\"%d","type":"string"}},"qualifiers":{"P%d":[' + snak + 'quantity","datavalue":{"value":{"amount":"+%d","unit":"1"},"type":"quantity"}}]},"references":[{"snaks":{"P%d":[' + snak + 'wikibase-item","datavalue":{"value":{"id":"Q%d"},"type":"wikibase-entityid"}}]}}]}')
        text = lambda x: F.format_string(form, pid(x), pid(x), qual(x), qual(x), pid(x), ref(x), ref(x), ref(x))
        own = lambda p: F.array_join(F.transform(F.filter("lines", lambda x: pid(x).eqNullSafe(p)), text), ",")
        claims = F.transform(F.array_distinct("lines.pid"), lambda p: F.format_string('"P%d":[%s]', p, own(p)))
    whole = rows.select(F.format_string("Q%d", "l_orderkey").alias("title"), F.array_join(claims, ",").alias("claims"))
    form = '{"claims":[%s]}' if listed else '{"type":"item","id":"%s","claims":{%s}}'
    return whole.select("title", F.format_string(form, *(["claims"] if listed else ["title", "claims"])).alias("value"))
