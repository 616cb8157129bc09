"""Queries over files, presets, configurations, serving, search and streams, each with SQL for the same rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.operators import backoff, evaluate, glossary, prepare, recommend, rules, serve, sql, workflow
from tributary.operators.model import ALWAYS, Model
from tributary.operators.transactions import TYPE_MARK, from_pairs, to_transactions
from tributary.plans import views
from tributary.plans.queries import (
    _ASKED, _STATISTICS, _SUMMARY, CLAIMS, EVALUATION, EVENTS, ITEMS, LABELS, ORDER_BLOCKS, PAIRS, RARE, SETS, TAKE_MORE, TAKE_TYPE, TYPED,
    _evaluated, _evaluated_sets, _sql_backoff, _sql_evaluate, _sql_recommend, _sql_split, _summary, _triples, ask, query, requests_of_sets,
)
from tributary.session import shared_dir, table
from tributary.sources import entities
from tributary.sources.triples import parse, read_ntriples, write_lines
from tributary.streaming import insert


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


# --- many items

PARTS = "pairs as (select distinct l_orderkey as subject, 'part' || l_partkey as item from lineitem union select o_orderkey, 't#' || o_orderpriority from orders)"


def _part_model(spark, sf_dir) -> Model:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("item"))
    types = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject"), F.concat(F.lit(TYPE_MARK), "o_orderpriority").alias("item"))
    return Model.build(from_pairs(items.unionByName(types)))


@query(_sql_recommend(("t#1-URGENT",), True, False).replace(TYPED, PARTS))
def recommend_limit(spark, sf_dir):
    """A type that goes with more items than the limit lets through."""
    model = _part_model(spark, sf_dir)
    return recommend.named(model, recommend.recommend(model, ask(spark, model, ("t#1-URGENT",)))).select("property", "probability", "rank")


@query(f"with {PARTS}, {ITEMS} select item as iri, item like 't#%' as is_type, total as total_count, cast(pos as integer) as item from items")
def item_rank_of_parts(spark, sf_dir):
    """Thousands of items with many ties."""
    return _part_model(spark, sf_dir).items.select("iri", "is_type", "total_count", "item")


# --- transactions of lines in their order

@query(f"with {ORDER_BLOCKS} select s[2:-2] as subject, count(*) as num_predicates, count(*) filter (line_no % 2 = 0) as num_type_predicates, 2::bigint as items from b where block <= 100 group by block, s")
def first_n_subjects(spark, sf_dir):
    tx = to_transactions(views.order_triples(spark, sf_dir), first_n=100)
    return tx.select("subject", "num_predicates", "num_type_predicates", F.size("items").cast("long").alias("items"))


@query(f"with {ORDER_BLOCKS}, r as (select block, s, count(*) as n, count(distinct case when line_no % 2 = 0 then line_no end) as t from b group by block, s) select s[2:-2] as subject, n as num_predicates, t as num_type_predicates, count(*) as runs from r group by 1, 2, 3")
def transactions_of_runs(spark, sf_dir):
    """The default way: one transaction a run of a subject's lines."""
    return to_transactions(views.order_triples(spark, sf_dir), typed=True).groupBy("subject", "num_predicates", "num_type_predicates").agg(F.count("*").alias("runs"))


# --- files

@query(f"with {EVENTS} select s, p, o, count(*) as lines from triples group by 1, 2, 3")
def ntriples_file(spark, sf_dir):
    """Written as compressed text and read back."""
    path = _folder(spark, "nt")
    write_lines(_triples(spark, sf_dir), path)
    return read_ntriples(spark, path).groupBy("s", "p", "o").agg(F.count("*").alias("lines"))


@query(f"with {EVENTS} select s, p, o, count(*) as lines from triples group by 1, 2, 3")
def ntriples_blocks(spark, sf_dir):
    """Written as block-compressed text and read by parts of its files."""
    path = _folder(spark, "bgz")
    write_lines(_triples(spark, sf_dir), path, "bgz")
    return read_ntriples(spark, path, block=True).groupBy("s", "p", "o").agg(F.count("*").alias("lines"))


@query(f"with {EVENTS} select count(*) as triples, count(distinct s) as subjects from triples")
def over_long_lines(spark, sf_dir):
    """Two lines of more bytes than are taken, among the events' lines."""
    long = spark.range(2).select(F.col("id").alias("line_no"), F.concat(F.format_string("<l:%d> <l:p> \"", "id"), F.repeat(F.lit("x"), 5 << 20), F.lit('" .')).alias("line"))
    return parse(views.event_triples(spark, sf_dir).unionByName(long)).agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"))


@query(f"with {TYPED}, {ITEMS}, {SETS} select 'item' as kind, item as name, total as n from items union all select 'set', list_aggregate(s, 'string_agg', ','), count(*) from sets group by s")
def model_file(spark, sf_dir):
    """A saved model, loaded."""
    path = _folder(spark, "models")
    views.model(spark, sf_dir, True).save(path)
    model = Model.load(spark, path)
    items = model.items.select(F.lit("item").alias("kind"), F.col("iri").alias("name"), F.col("total_count").alias("n"))
    return items.unionByName(model.patterns.select(F.lit("set").alias("kind"), F.array_join("items", ",").alias("name"), F.col("support").alias("n")))


@query(f"with {PAIRS} select item as \"URI\", count(*) as \"Frequency\" from pairs group by item")
def frequency_file(spark, sf_dir):
    path = _folder(spark, "frequencies")
    views.model(spark, sf_dir).write_frequencies(path, False)
    return spark.read.option("header", True).option("sep", ";").schema("URI string, Frequency long").csv(path)


@query(f"with {LABELS} select * from g")
def glossary_file(spark, sf_dir):
    """Labels as text in files in their order, the glossary made of them written and read."""
    path = _folder(spark, "glossary")
    lines = views.label_triples(spark, sf_dir).orderBy("line_no").select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))
    lines.write.text(f"{path}/nt")
    glossary.build(read_ntriples(spark, f"{path}/nt")).write.parquet(f"{path}/built")
    return spark.read.parquet(f"{path}/built")


DUMPED = f"""with {CLAIMS}, rows as (select 'Q' || title as title, 'claim' as typ, pid as property_id, 'string' as datatype, 'v"' || pid as value from line
    union all select 'Q' || title, 'qualifier', qual, 'quantity', '+' || pid from line union all select 'Q' || title, 'reference', ref, 'wikibase-item', 'Q' || ref from line)
    select typ, property_id, datatype, value, count(*) as n, count(distinct title) as titles from rows group by 1, 2, 3, 4"""


def _counted(found: DataFrame) -> DataFrame:
    return entities.to_rows(found).groupBy("typ", "property_id", "datatype", "value").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"))


@query(DUMPED)
def entities_json(spark, sf_dir):
    """Orders as lines of a JSON dump."""
    path = _folder(spark, "dump")
    dump = views.dump_texts(spark, sf_dir, listed=False)
    lines = dump.select(F.concat(F.col("value"), F.lit(",")).alias("value"))
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", entities.FILE_ROWS).text(path)
    return _counted(entities.read_json(spark, path))


@query(DUMPED)
def entities_xml(spark, sf_dir):
    """Orders as pages of a MediaWiki export, with claims as lists."""
    path = _folder(spark, "dump")
    entities.write_xml(views.dump_texts(spark, sf_dir, listed=True), path)
    return _counted(entities.read_xml(spark, path))


@query(DUMPED)
def entities_csv(spark, sf_dir):
    """The dump's entities written as CSV and read back."""
    path = _folder(spark, "csv")
    entities.write_csv(entities.from_json(views.dump_texts(spark, sf_dir, listed=False)), path, compression="gzip")
    return _counted(entities.read_csv(spark, path))


@query(f"with {CLAIMS} select pid1, coalesce(qid1, 0) as qid1, pid2, count, probability, context from rules")
def pairs_csv(spark, sf_dir):
    path = _folder(spark, "pairs")
    entities.write_pairs(rules.compute(views.entities(spark, sf_dir)), path)
    return entities.read_pairs(spark, path)


@query(_sql_evaluate(TAKE_TYPE) + _SUMMARY)
def results_file(spark, sf_dir):
    path = _folder(spark, "results")
    evaluate.write_results(_evaluated(spark, sf_dir, "handlerTakeButType"), path)
    return _summary(evaluate.read_results(spark, path))


@query(_sql_evaluate(TAKE_TYPE) + """select cast(coalesce(s, -1) as integer) as "setSize", count(*) as subjects, round(avg(rank), 6) as mean, round(stddev_pop(rank), 6) as stddev, round(100 * avg((rank <= 1)::integer), 6) as top1, round(100 * avg(tp / num_left_out), 6) as recall
    from (select *, set_size as s from res union all select *, null from res) group by s""")
def statistics_file(spark, sf_dir):
    path = _folder(spark, "statistics")
    evaluate.write_statistics(evaluate.statistics(_evaluated_sets(spark, sf_dir, "handlerTakeButType"), "setSize"), path, "setSize")
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return rows.select(F.col("setSize").cast("int").alias("setSize"), F.col("subjects").cast("long").alias("subjects"), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("mean", "stddev", "top1", "recall")))


# --- presets and configurations

def _two(spark, sf_dir, layers):
    """A request with direct answers, and RARE."""
    model = views.model(spark, sf_dir, True)
    found = workflow.run(model, ask(spark, model, ("Brand#1",), RARE), layers)
    return recommend.named(model, found).select("qid", "layer", "property", F.round("probability", 9).alias("probability"))


_ONE = _sql_recommend(("Brand#1",), True, False)


@query(f"with a as ({_ONE}), b as ({_sql_split('k % 2 = 1', 'k % 2 = 0', 'max(p)')}) select 0::bigint as qid, 1 as layer, property, round(probability, 9) as probability from a union all select 1, 0, property, probability from b")
def workflow_split(spark, sf_dir):
    """The preset that splits sets of more than two items."""
    return _two(spark, sf_dir, workflow.preset("splitproperty"))


@query(f"with a as ({_ONE}), b as ({_sql_backoff(['1', '1', '2', '2'], 10)}) select 0::bigint as qid, 1 as layer, property, round(probability, 9) as probability from a union all select 1, 0, property, round(probability, 9) from b")
def workflow_few(spark, sf_dir):
    """The preset that drops the rarest items where fewer than ten are found."""
    return _two(spark, sf_dir, workflow.preset("toofewrecommendations"))


@query(f"with a as ({_ONE}), b as ({_sql_backoff(['1', '2', '3'], 1)}) select 0::bigint as qid, 1 as layer, property, round(probability, 9) as probability from a union all select 1, 0, property, round(probability, 9) from b")
def workflow_configured(spark, sf_dir):
    """A workflow from a configuration's text."""
    text = json.dumps({"Testset": "x", "layers": [{"condition": "aboveThreshold", "backoff": "deleteLowFrequency", "threshold": 1, "stepsize": "stepsizeLinear", "parallelExecutions": 3}, {"Condition": "always", "Backoff": "standard"}]})
    return _two(spark, sf_dir, workflow.Configuration.of(json.loads(text)).workflow())


_HALF = _sql_evaluate(TAKE_MORE) + "select 0 as config, count(*) as subjects, round(avg(rank), 6) as mean, round(avg(tp / num_left_out), 6) as recall from res union all select 1, count(*), round(avg(case when set_size > 2 then 500 else rank end), 6), round(avg(case when set_size > 2 then 0 else tp / num_left_out end), 6) from res"


@query(_HALF)
def config_batch(spark, sf_dir):
    """Two workflows over the same requests: all direct, and direct for sets of up to two items only."""
    model, requests = requests_of_sets(spark, sf_dir, "takeMoreButCommon")
    workflows = {0: workflow.preset("direct"), 1: [workflow.Layer(workflow.below(3), None)]}
    return evaluate.batch(model, requests, workflows).select("config", "subjects", F.round("mean", 6).alias("mean"), F.round("recall", 6).alias("recall"))


@query(f"""with {TYPED}, {ITEMS}, {_ASKED}, {", ".join(f"q{i}_s as (select item from asked where k <= n - {i}), q{i}_m as (select subject from pairs where item in (select item from q{i}_s) group by subject having count(*) = (select count(*) from q{i}_s)), q{i} as (select item, count(*) / (select count(*) from q{i}_m) as p from pairs where subject in (select subject from q{i}_m) and item not like 't#%' and item not in (select item from asked) group by item)" for i in range(1, 5))},
    every as ({" union all ".join(f"select {i} as sub, item, p, row_number() over (order by p desc) as r from q{i}" for i in range(1, 5))}),
    pick as (select coalesce(min(sub), 4) as sub from (select sub from every where r <= 10 group by sub having cast(sum(p) / 10 as float) > cast(0.15 as float)))
    select item as property, round(p, 9) as probability from every where sub = (select sub from pick)""")
def backoff_likely(spark, sf_dir):
    """The first reduction whose ten best average above a threshold."""
    model = views.model(spark, sf_dir, True)
    found = backoff.delete_low_frequency(model, ask(spark, model, RARE), 4, backoff.step_linear, backoff.more_likely_than(0.15))
    return recommend.named(model, found).select("property", F.round("probability", 9).alias("probability"))


# --- statistics

@query(" union all ".join(f"(select '{name}' as grouped, cast(g as bigint) as \"group\", count(*) as subjects, round(avg(rank), 6) as mean from ({{res}}) cross join lateral (select {column} as g union all select -1) group by g)" for name, column in (("numTypes", "num_types"), ("setSize", "set_size"), ("numLeftOut", "num_left_out"))).replace("{res}", _sql_evaluate(TAKE_TYPE) + "select * from res"))
def eval_groups(spark, sf_dir):
    results = _evaluated_sets(spark, sf_dir, "handlerTakeButType")
    every = [evaluate.statistics(results, g).select(F.lit(g).alias("grouped"), F.col("group").cast("long").alias("group"), "subjects", F.round("mean", 6).alias("mean")) for g in ("numTypes", "setSize", "numLeftOut")]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query(f"with s as ({_sql_evaluate(TAKE_TYPE)} select avg(tp_at_l / num_left_out) as p, avg(tp / num_left_out) as r, avg(rank) as mean from res) select round(2 * p * r / (p + r), 6) as f1, round(1 / mean, 6) as reciprocal_rank from s")
def eval_derived(spark, sf_dir):
    stats = evaluate.derived(evaluate.statistics(_evaluated_sets(spark, sf_dir, "handlerTakeButType"))).where(F.col("group") == -1)
    return stats.select(F.round("f1", 6).alias("f1"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


# --- serving

#: The brands' names: labels in English, and in German for every third.
NAMES = "names as (select distinct p_brand as property, 'en' as lang, 'brand ' || p_brand[7:] as label, 'a brand' as description from part union all select distinct p_brand, 'de', 'Marke ' || p_brand[7:], '' from part where cast(p_brand[7:] as integer) % 3 = 0)"


def _names(spark, sf_dir):
    number = F.substring("p_brand", 7, 9)
    brands = table(spark, sf_dir, "part").select("p_brand", number.alias("n")).distinct()
    english = brands.select(F.col("p_brand").alias("property"), F.lit("en").alias("lang"), F.concat(F.lit("brand "), "n").alias("label"), F.lit("a brand").alias("description"))
    german = brands.where(F.col("n").cast("int") % 3 == 0).select(F.col("p_brand").alias("property"), F.lit("de").alias("lang"), F.concat(F.lit("Marke "), "n").alias("label"), F.lit("").alias("description"))
    return english.unionByName(german)


def _engine(spark, sf_dir) -> serve.Engine:
    return serve.Engine(views.model(spark, sf_dir, True), workflow.preset("direct"), _names(spark, sf_dir))


def _requests(spark):
    rows = [(0, "de", ["2-HIGH"], ["Brand#3"]), (1, None, None, ["Brand#1", "no such brand"])]
    return spark.createDataFrame(rows, "qid long, lang string, types array<string>, properties array<string>")


_SERVED = f"a as (select 0::bigint as qid, * from ({_sql_recommend(('Brand#3', 't#2-HIGH'), True, False)}) union all select 1, * from ({_ONE}))"


@query(f"""with {_SERVED}, {NAMES}, l as (select *, case when qid = 0 then 'de' else 'en' end as lang from a)
    select qid, l.property as property, coalesce(o.label, e.label) as label, coalesce(o.description, e.description) as description, probability, rank
    from l left join names o on o.property = l.property and o.lang = l.lang left join names e on e.property = l.property and e.lang = 'en'""")
def serve_recommender(spark, sf_dir):
    return _engine(spark, sf_dir).recommend(_requests(spark))


@query(f"with {_SERVED}, {TYPED}, {ITEMS} select qid, property, total as total_count, cast(pos as integer) as item, probability, rank from a join items on items.item = property")
def serve_lean(spark, sf_dir):
    return _engine(spark, sf_dir).lean(_requests(spark))


#: A model of direct properties: the brands' numbers from 101 on.
DIRECT_PAIRS = "pairs as (select distinct l_orderkey as subject, 'http://www.wikidata.org/prop/direct/P' || (cast(p_brand[7:] as integer) + 100) as item from lineitem join part on p_partkey = l_partkey)"


def _direct_model(spark, sf_dir) -> Model:
    pairs = views.order_pairs(spark, sf_dir)
    return Model.build(from_pairs(pairs.select("subject", F.concat(F.lit(f"{rules.DIRECT}P"), (F.substring("item", 7, 9).cast("int") + 100).cast("string")).alias("item"))), ALWAYS)


@query(f"with r as ({_sql_recommend((f'{rules.DIRECT}P101',), False, False).replace(PAIRS, DIRECT_PAIRS)}) select 0::bigint as qid, replace(property, '{rules.DIRECT}', '') as property, probability, rank from r")
def serve_short_ids(spark, sf_dir):
    engine = serve.Engine(_direct_model(spark, sf_dir), workflow.preset("direct"))
    return engine.short_ids(spark.createDataFrame([(0, ["P101", "P9"])], "qid long, properties array<string>"))


@query(f"with {CLAIMS}, f as (select pid2, sum(probability) / 2 as p from rules where context = 'item' and pid1 in (101, 102) and pid2 not in (101, 102) group by pid2) select '{rules.DIRECT}P' || pid2 as property, round(p, 9) as probability from f")
def suggester_workflow(spark, sf_dir):
    """The rules as a preset's procedure: the model's items go to property numbers and back."""
    model = _direct_model(spark, sf_dir)
    layers = workflow.preset("wikidata-property", rules.suggester(views.mined_rules(spark, sf_dir)))
    found = workflow.run(model, ask(spark, model, (f"{rules.DIRECT}P101", f"{rules.DIRECT}P102")), layers)
    return recommend.named(model, found).select("property", F.round("probability", 9).alias("probability"))


SUGGESTED = f"""with {CLAIMS}, f as (select pid2, sum(probability) as p from rules where context = 'item' and pid1 in (101, 102) and pid2 not in (101, 102) group by pid2),
    g as (select cast(pid2 as integer) as pid2, cast(row_number() over (order by round(p / 2, 12) desc, pid2) as integer) as rank from f),
    terms as (select cast(cast(p_brand[7:] as integer) + 100 as integer) as pid2, p_brand as label, 'a brand' as description, ['no' || p_brand[7:], 'kind ' || (cast(p_brand[7:] as integer) % 4)] as aliases from (select distinct p_brand from part))"""


def _search(spark, sf_dir, prefix, size, offset):
    asked = spark.createDataFrame([(0, [101, 102], [])], "qid long, properties array<int>, tuples array<struct<pid: int, qid: int>>")
    found = rules.suggest(views.mined_rules(spark, sf_dir), asked)
    found = recommend.rank(found.select("qid", F.col("pid2").alias("item"), F.round("probability", 12).alias("probability"))).withColumnRenamed("item", "pid2")
    n = F.substring("p_brand", 7, 9)
    names = table(spark, sf_dir, "part").select("p_brand").distinct().select(
        (n.cast("int") + 100).alias("pid"), F.lit("en").alias("lang"), F.col("p_brand").alias("label"), F.lit("a brand").alias("description"), F.array(F.concat(F.lit("no"), n), F.concat(F.lit("kind "), (n.cast("int") % 4).cast("string"))).alias("aliases"))
    terms = rules.write_terms(names, _folder(spark, "terms"))
    return rules.search(found, terms, prefix, "en", size, offset)


def _sql_search(hit: str, alias: str, size: int, offset: int) -> str:
    return f"""{SUGGESTED}, hits as (select *, {alias} as alias from terms where {hit}),
    every as (select h.*, 0 as part, rank as r from hits h join g using (pid2) union all select h.*, 1, pid2 from hits h where pid2 not in (select pid2 from g)),
    placed as (select *, cast(row_number() over (order by part, r) as integer) as place, count(*) over () as n from every)
    select 0::bigint as qid, pid2, label, description, alias, place, case when n >= {offset + size} then {offset + size} end as next from placed where place > {offset} and place <= {offset + size}"""


@query(_sql_search("label like 'Brand#1%'", "cast(null as varchar)", 5, 2))
def search_page(spark, sf_dir):
    """The second part of the suggestions whose label begins with a prefix, then other hits."""
    return _search(spark, sf_dir, "bRAND#1", 5, 2)


@query(_sql_search("aliases[2] like 'kind 3%'", "aliases[2]", 20, 0))
def search_by_alias(spark, sf_dir):
    return _search(spark, sf_dir, "Kind 3", 20, 0)


@query(f"with {CLAIMS} select pid2, round(sum(probability) / 4, 9) as probability from rules where context = 'item' and ((pid1 = 31 and qid1 = 1) or (pid1 in (101, 102) and coalesce(qid1, 0) = 0)) and pid2 not in (31, 101, 102) group by pid2")
def suggest_by_entity(spark, sf_dir):
    """The claims of a whole entity ask, one of them twice."""
    snak = "struct<property_id: int, datatype: string, value: string>"
    claims = [((p, "string", v), [], []) for p, v in ((31, "Q1"), (101, "x"), (101, "y"), (102, "z"))]
    entity = spark.createDataFrame([("Q5", claims)], f"title string, claims array<struct<mainsnak: {snak}, qualifiers: array<{snak}>, `references`: array<{snak}>>>")
    found = rules.suggest(views.mined_rules(spark, sf_dir), rules.of_entities(entity))
    return found.select("pid2", F.round("probability", 9).alias("probability"))


@query(f"with {CLAIMS} select 0::bigint as qid, 42 as pid2, 1.0::double as probability, 1 as place union all select 0, 43, 1.0, 2 union all select 1, pid2, round(probability, 9), cast(row_number() over (order by round(probability, 12) desc, pid2) as integer) from rules where context = 'item' and pid1 = 101 and pid2 <> 101")
def suggest_initial(spark, sf_dir):
    """A request of nothing, which gets the initial suggestions, beside one of a property."""
    asked = spark.createDataFrame([(0, [], []), (1, [101], [])], "qid long, properties array<int>, tuples array<struct<pid: int, qid: int>>")
    found = rules.suggest(views.mined_rules(spark, sf_dir), asked, initial=(43, 42))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("probability", 12)), "pid2"))
    return found.select("qid", "pid2", F.round("probability", 9).alias("probability"), place.alias("place"))


@query(f"with {CLAIMS} select pid2, round(sum(probability) / 2, 9) as probability from rules where context = 'item' and pid1 = 31 and qid1 in (1, 2) and pid2 <> 31 group by pid2")
def suggest_by_list(spark, sf_dir):
    """Ids of items ask as values of the classifying property."""
    lists = spark.createDataFrame([(0, ["Q1", "Q2"])], "qid long, ids array<string>")
    found = rules.suggest(views.mined_rules(spark, sf_dir), rules.of_lists(lists))
    return found.select("pid2", F.round("probability", 9).alias("probability"))


# --- SQL

_TOLD = " union all ".join(f"select {n}::bigint as asked, property, probability, rank from ({_sql_recommend(names, True, types)})" for n, (names, types) in enumerate(((("Brand#1", "Brand#2"), False), (("Brand#3", "t#2-HIGH"), False), (("Brand#3",), True))))


@query(_TOLD)
def recommend_in_sql(spark, sf_dir):
    """Requests as calls of table functions."""
    sql.register(views.model(spark, sf_dir, True), "orders_model")
    return spark.sql("""select 0L as asked, * from orders_model_recommend(array('Brand#1', 'Brand#2', 'no such'))
        union all select 1L, * from orders_model_recommend(array('Brand#3', 't#2-HIGH'))
        union all select 2L, * from orders_model_recommend_with_types(array('Brand#3'))""")


# --- renderers, streams

@query(f"with {TYPED}, {ITEMS} select total || 'x' || chr(9) || item || ' (' || pos || ')' as text from items")
def render_items(spark, sf_dir):
    return recommend.rendered_items(views.model(spark, sf_dir, True).items)


@query(f"with r as ({_ONE}) select '[ ' || string_agg(property || ' ', '' order by rank) || ']' as text, 0::bigint as qid from r")
def render_list(spark, sf_dir):
    model = views.model(spark, sf_dir, True)
    return recommend.rendered_list(recommend.named(model, recommend.recommend(model, ask(spark, model, ("Brand#1",)))))


@query(f"with {PAIRS}, {ITEMS}, {SETS} select list_aggregate(s, 'string_agg', ',') as items, count(*) as support from sets group by s")
def stream_insert(spark, sf_dir):
    """The orders as a stream of two batches, each of what was written since the one before."""
    path = _folder(spark, "stream")
    tx = views.transactions(spark, sf_dir)
    for part in range(2):
        tx.where(F.coalesce(F.abs(F.col("subject") % 2), F.lit(0)) == part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(tx.schema).parquet(f"{path}/in")
        insert.start(stream, f"{path}/model", f"{path}/checkpoint").awaitTermination()
    return insert.read(spark, f"{path}/model").patterns.select(F.array_join("items", ",").alias("items"), "support")


@query(f"with {PAIRS}, {ITEMS} select item as iri, total as total_count, cast(pos as integer) as item from items union all select item, 0, cast((select count(*) from items) + row_number() over (order by item) - 1 as integer) from (select unnest(['{ALWAYS[0]}', '{ALWAYS[1]}', '{ALWAYS[2]}', '{ALWAYS[3]}']) as item)")
def insert_keeps_entries(spark, sf_dir):
    """Entries that no transaction has stay in the dictionary after an insert."""
    tx = views.transactions(spark, sf_dir)
    model = Model.build(tx.where("subject % 2 = 0"), ALWAYS).insert(tx.where("subject % 2 = 1"))
    return model.items.select("iri", "total_count", "item")
