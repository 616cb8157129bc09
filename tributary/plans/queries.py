"""The queries over the test tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import ntriples as nt
from tributary.operators import backoff, evaluate, glossary, prepare, recommend, rules, workflow
from tributary.operators.model import Model
from tributary.operators.transactions import blocks, to_transactions
from tributary.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PAIRS = "pairs as (select distinct l_orderkey as subject, p_brand as item from lineitem join part on p_partkey = l_partkey)"
TYPED = PAIRS[:-1] + " union select o_orderkey, 't#' || o_orderpriority from orders)"
ITEMS = "counts as (select item, count(*) as total from pairs group by item), items as (select item, total, row_number() over (order by total desc, item) - 1 as pos from counts)"
SETS = "sets as (select subject, list(pos order by pos) as s from pairs join items using (item) group by subject)"


def _sql_set(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _sql_recommend(names: tuple[str, ...], typed: bool, types_too: bool, limit: int = 500) -> str:
    kind = "" if types_too else " and item not like 't#%'"
    return f"""with {TYPED if typed else PAIRS}, {ITEMS},
    met as (select subject from pairs where item in ({_sql_set(names)}) group by subject having count(*) = {len(names)}),
    found as (select item, count(*) as n from pairs where subject in (select subject from met) and item not in ({_sql_set(names)}){kind} group by item),
    ranked as (select item as property, n / (select count(*) from met) as probability, cast(row_number() over (order by n desc, pos) as integer) as rank from found join items using (item))
    select * from ranked where rank <= {limit}"""


def ask(spark: SparkSession, model: Model, *sets: tuple[str, ...], unknown: str = "drop") -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(map(list, sets))), "qid long, items array<string>")
    return recommend.requests(model, rows, unknown)


def _recommended(spark: SparkSession, sf_dir: str, names: tuple[str, ...], typed: bool = False, types_too: bool = False) -> DataFrame:
    return recommend.one(views.model(spark, sf_dir, typed), list(names), types_too).select("property", "probability", "rank")


@query(f"with {TYPED}, {ITEMS} select item as iri, item like 't#%' as is_type, total as total_count, cast(pos as integer) as item from items")
def item_rank(spark, sf_dir):
    return views.built_model(spark, sf_dir, True).items.select("iri", "is_type", "total_count", "item")


@query(f"with {TYPED} select count(distinct item) filter (item not like 't#%') as properties, count(distinct item) filter (item like 't#%') as types from pairs")
def dictionary_counts(spark, sf_dir):
    return views.model(spark, sf_dir, True).items.agg(F.count_if(~F.col("is_type")).alias("properties"), F.count_if("is_type").alias("types"))


@query(f"with {TYPED}, {ITEMS}, {SETS} select subject, list_aggregate(s, 'string_agg', ',') as items from sets")
def transactions(spark, sf_dir):
    tx, items = views.transactions(spark, sf_dir, True), views.model(spark, sf_dir, True).items
    rows = tx.select("subject", F.explode("items").alias("iri")).join(items.select("iri", "item"), "iri")
    return rows.groupBy("subject").agg(F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))


@query(f"with {PAIRS}, {ITEMS}, {SETS} select list_aggregate(s, 'string_agg', ',') as items, count(*) as support from sets group by s")
def patterns(spark, sf_dir):
    return views.built_model(spark, sf_dir).patterns.select(F.array_join("items", ",").alias("items"), "support")


@query(f"""with {PAIRS}, {ITEMS}, {SETS}, paths as (select s[1:n] as path, len(s[1:n]) as depth from (select s, unnest(range(0, len(s) + 1)) as n from sets))
    select coalesce(list_aggregate(path, 'string_agg', ','), '') as path, cast(depth as integer) as depth, count(*) as support from paths group by path, depth""")
def trie_nodes(spark, sf_dir):
    return views.model(spark, sf_dir).nodes().select(F.array_join("path", ",").alias("path"), "depth", "support")


@query(f"with {PAIRS} select item as iri, count(*) as by_nodes, count(*) as by_items from pairs group by item")
def trie_node_support_check(spark, sf_dir):
    model = views.model(spark, sf_dir)
    nodes = model.nodes().where("depth > 0").groupBy("item").agg(F.sum("support").alias("by_nodes"))
    return nodes.join(model.items, "item").select("iri", "by_nodes", F.col("total_count").alias("by_items"))


@query(f"""with {TYPED}, asked as (select * from (values (0, ['Brand#1']), (1, ['Brand#1', 'Brand#2']), (2, ['Brand#1', 't#1-URGENT']), (3, cast([] as varchar[]))) as v(qid, names)),
    got as (select qid, subject from asked join pairs on list_contains(names, item) group by qid, subject, len(names) having count(*) = len(names)),
    n as (select qid, count(*) as support from got group by qid), total as (select count(distinct subject) as all_subjects from pairs)
    select cast(asked.qid as bigint) as qid, case when len(names) = 0 then all_subjects else coalesce(support, 0) end as support,
    case when len(names) = 0 then 1.0::double else coalesce(support, 0) / all_subjects end as fraction from asked left join n on n.qid = asked.qid, total""")
def support_set(spark, sf_dir):
    model = views.model(spark, sf_dir, True)
    return recommend.support(model, ask(spark, model, ("Brand#1",), ("Brand#1", "Brand#2"), ("Brand#1", "t#1-URGENT"), ()))


@query(_sql_recommend(("Brand#1",), False, False))
def recommend_one(spark, sf_dir):
    return _recommended(spark, sf_dir, ("Brand#1",))


@query(_sql_recommend(("Brand#1", "Brand#2"), False, False))
def recommend_two(spark, sf_dir):
    return _recommended(spark, sf_dir, ("Brand#1", "Brand#2"))


@query(_sql_recommend(("Brand#3", "t#2-HIGH"), True, False))
def recommend_with_type(spark, sf_dir):
    return _recommended(spark, sf_dir, ("Brand#3", "t#2-HIGH"), True)


@query(_sql_recommend(("Brand#3",), True, True))
def recommend_props_and_types(spark, sf_dir):
    return _recommended(spark, sf_dir, ("Brand#3",), True, True)


@query(_sql_recommend(("Brand#1",), True, False))
def recommend_unknown_dropped(spark, sf_dir):
    return _recommended(spark, sf_dir, ("Brand#1", "no such brand", "Brand#1"), True)


@query(f"with {TYPED}, {ITEMS} select item as property, total / (select count(distinct subject) from pairs) as probability, cast(pos + 1 as integer) as rank from items")
def recommend_empty(spark, sf_dir):
    return _recommended(spark, sf_dir, (), True)


@query("select 0 as answers")
def recommend_unknown_empty(spark, sf_dir):
    model = views.model(spark, sf_dir)
    return recommend.recommend(model, ask(spark, model, ("Brand#1", "no such brand"), unknown="empty")).agg(F.count("*").cast("int").alias("answers"))


#: All brands' answers in one batch: the request of each is the brand itself.
BATCH = f"""with {TYPED}, {ITEMS},
    met as (select a.item as asked, b.item as found, count(*) as n from pairs a join pairs b on a.subject = b.subject and a.item <> b.item where a.item not like 't#%' and b.item not like 't#%' group by 1, 2),
    ranked as (select asked, found, n / t.total as probability, cast(row_number() over (partition by asked order by n desc, i.pos) as integer) as rank from met join items t on t.item = asked join items i on i.item = found)"""


def _batch(spark, sf_dir):
    model = views.model(spark, sf_dir, True)
    brands = model.items.where("not is_type")
    asked = brands.select(F.col("iri").alias("qid"), F.array("item").alias("s"))
    return model, asked, recommend.recommend(model, asked)


@query(BATCH + " select asked, found as property, probability, rank from ranked where rank <= 500")
def recommend_batch(spark, sf_dir):
    model, _, found = _batch(spark, sf_dir)
    return recommend.named(model, found).select(F.col("qid").alias("asked"), "property", "probability", "rank")


@query(BATCH + " select asked, round(sum(probability) filter (rank <= 10) / 10, 5) as top10 from ranked group by asked")
def top10_avg(spark, sf_dir):
    _, asked, found = _batch(spark, sf_dir)
    return recommend.top10_average(asked, found).select(F.col("qid").alias("asked"), F.round(F.col("top10").cast("double"), 5).alias("top10"))


@query(BATCH + ", f as (select asked, count(*) as n, sum(probability) filter (rank <= 10) / 10 as top10 from ranked group by asked) select asked, true as always, false as above, true as below, n < 24 as too_few, n > 23 as too_many, cast(top10 as float) < cast(0.16 as float) as too_unlikely from f")
def conditions(spark, sf_dir):
    _, asked, found = _batch(spark, sf_dir)
    facts = workflow.facts(asked, found.select("qid", "item", "probability"))
    named = {"always": workflow.always(), "above": workflow.above(1), "below": workflow.below(2), "too_few": workflow.too_few(24), "too_many": workflow.too_many(23), "too_unlikely": workflow.too_unlikely(0.16)}
    return facts.select(F.col("qid").alias("asked"), *(c().alias(n) for n, c in named.items()))


#: A set of six items for back-offs: too many for the orders to hold often.
RARE = ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6")


def _sql_sub(name: str, keep: str, order: str = "pos") -> str:
    """A sub-request's answers: its own items by a condition on the place k among n; without the full set's items."""
    return f"""{name}_s as (select item from asked where {keep}),
    {name}_m as (select subject from pairs where item in (select item from {name}_s) group by subject having count(*) = (select count(*) from {name}_s)),
    {name} as (select item, count(*) / (select count(*) from {name}_m) as p, count(*) as c from pairs where subject in (select subject from {name}_m) and item not like 't#%' and item not in (select item from asked) group by item)"""


_ASKED = f"asked as (select item, row_number() over (order by pos) as k, count(*) over () as n from items where item in ({_sql_set(RARE)}))"


def _sql_backoff(drops: list[str], least: int) -> str:
    subs = ", ".join(_sql_sub(f"q{i}", f"k <= n - ({d})") for i, d in enumerate(drops))
    union = " union all ".join(f"select {i} as sub, item, p from q{i}" for i in range(len(drops)))
    return f"""with {TYPED}, {ITEMS}, {_ASKED}, {subs}, every as ({union}),
    pick as (select coalesce(min(sub), {len(drops) - 1}) as sub from (select sub from every group by sub having count(*) > {least}))
    select item as property, p as probability, cast(row_number() over (order by p desc, pos) as integer) as rank from every join items using (item) where sub = (select sub from pick)"""


def _backed_off(spark, sf_dir, run):
    model = views.model(spark, sf_dir, True)
    found = recommend.rank(run(model, ask(spark, model, RARE)))
    return recommend.named(model, found).select("property", "probability", "rank")


@query(_sql_backoff(["1", "2", "3", "4"], 4))
def backoff_dlf_linear(spark, sf_dir):
    return _backed_off(spark, sf_dir, lambda m, q: backoff.delete_low_frequency(m, q, 4, backoff.step_linear, backoff.more_than(4)))


@query(_sql_backoff(["1", "1", "2", "2"], 10))
def backoff_dlf_proportional(spark, sf_dir):
    return _backed_off(spark, sf_dir, lambda m, q: backoff.delete_low_frequency(m, q, 4, backoff.step_proportional, backoff.more_than(10)))


def _sql_split(one: str, two: str, merge: str) -> str:
    return f"""with {TYPED}, {ITEMS}, {_ASKED}, {_sql_sub("q0", one)}, {_sql_sub("q1", two)},
    every as (select item, p from q0 union all select item, p from q1), merged as (select item, {merge} as p from every group by item)
    select item as property, round(p, 9) as probability from merged where p > 0"""


def _split(spark, sf_dir, splitter, merger):
    found = _backed_off(spark, sf_dir, lambda m, q: backoff.split_property_set(m, q, splitter, merger))
    return found.select("property", F.round("probability", 9).alias("probability"))


@query(_sql_split("k % 2 = 1", "k % 2 = 0", "max(p)"))
def backoff_split_even_max(spark, sf_dir):
    return _split(spark, sf_dir, backoff.split_every_second, backoff.merge_max)


@query(_sql_split("k % 2 = 1", "k % 2 = 0", "sum(p) / 2"))
def backoff_split_even_avg(spark, sf_dir):
    return _split(spark, sf_dir, backoff.split_every_second, backoff.merge_average)


@query(_sql_split("k > n // 2", "k <= n // 2", "max(p)"))
def backoff_split_ranges_max(spark, sf_dir):
    return _split(spark, sf_dir, backoff.split_two_ranges, backoff.merge_max)


@query(_sql_split("k > n // 2", "k <= n // 2", "sum(p) / 2"))
def backoff_split_ranges_avg(spark, sf_dir):
    return _split(spark, sf_dir, backoff.split_two_ranges, backoff.merge_average)


#: More brands than any order has.
TOO_MANY = tuple(f"Brand#{n}" for n in range(1, 11))
_REDUCED = _sql_backoff(["1", "2", "3", "4"], 4).replace(_sql_set(RARE), _sql_set(TOO_MANY))


@query(f"with a as ({_sql_recommend(('Brand#1',), True, False)}), b as ({_REDUCED}) select 0::bigint as qid, 1 as layer, property, probability, rank from a union all select 1, 0, property, probability, rank from b")
def workflow_best(spark, sf_dir):
    """The preset: the first request has direct answers; the second, of TOO_MANY, none."""
    model = views.model(spark, sf_dir, True)
    found = workflow.run(model, ask(spark, model, ("Brand#1",), TOO_MANY), workflow.preset("best"))
    return recommend.named(model, found).select("qid", "layer", "property", "probability", "rank")


@query("with t as (select unnest(range(1, 4)) as threshold), c as (select unnest(['aboveThreshold', 'tooUnlikelyRecommendationsCondition']) as condition), b as (select unnest(['splitProperty/max', 'splitProperty/avg', 'deleteLowFrequency/1', 'deleteLowFrequency/2']) as way) "
       "select cast(threshold as integer) as threshold, condition, case when condition like 'tooUnl%' then round(threshold / 3 * 0.5, 9) else 0.0 end as threshold_float, way from t, c, b")
def config_grid(spark, sf_dir):
    grid = workflow.Grid(["aboveThreshold", "tooUnlikelyRecommendationsCondition"], ["max", "avg"], ["everySecondItem"], ["stepsizeLinear"], 3, 2, 0.5)
    rows = [(x.Layers[0].Threshold, x.Layers[0].Condition, round(x.Layers[0].ThresholdFloat, 9), f"{x.Layers[0].Backoff}/{x.Layers[0].Merger or x.Layers[0].ParallelExecutions}") for x in grid.configurations()]
    return spark.createDataFrame(rows, "threshold int, condition string, threshold_float double, way string")


# --- triples

#: The parts that views.event_triples writes, from the events themselves.
EVENTS = """e as (select event_id as line_no, event_id % 10 as kind, event_type as t, user_id as u,
    '<http://www.wikidata.org/entity/' || case when event_id % 10 < 8 then 'Q' else 'P' end || user_id || '>' as s from events),
    triples as (select line_no, kind, t, u, s,
    case when kind < 4 or kind = 9 then '<http://www.wikidata.org/prop/direct/P' || u || '>' when kind < 6 then '<http://schema.org/name>' when kind = 6 then '<http://www.w3.org/2000/01/rdf-schema#label>' else '<http://www.wikidata.org/prop/P' || u || '>' end as p,
    case when kind < 4 or kind = 9 then '"a \\"' || t || '\\" b"@en' when kind in (4, 5, 7) then '<http://e.org/' || t || '>' else '"' || t || '"' end as o from e where kind <> 8)"""


def _triples(spark, sf_dir):
    from tributary.sources.triples import parse

    return parse(views.event_triples(spark, sf_dir))


@query(f"with {EVENTS} select line_no, s, p, o from triples")
def nt_tokens(spark, sf_dir):
    return _triples(spark, sf_dir).select("line_no", "s", "p", "o")


@query(f"""with {EVENTS} select line_no, case when kind < 4 or kind = 9 then 'a \\"' || t || '\\" b' when kind = 6 then t else '' end as text, case when kind < 4 or kind = 9 then 'en' else '' end as lang from triples""")
def nt_lang_literal(spark, sf_dir):
    return _triples(spark, sf_dir).select("line_no", nt.lang_literal(F.col("o"))["text"].alias("text"), nt.lang_literal(F.col("o"))["lang"].alias("lang"))


@query(f"with {EVENTS} select line_no, s[2:-2] as word, s[2:-2] as subject, case when s like '%/P%' then replace(s, '/entity/P', '/prop/direct/P')[2:-2] else s[2:-2] end as as_property, replace(s[2:-2], 'http://www.wikidata.org/entity/', '') as short from triples")
def first_word(spark, sf_dir):
    s = nt.iri(F.col("s"))
    return _triples(spark, sf_dir).select("line_no", nt.nth(nt.words(F.col("line")), 0).alias("word"), s.alias("subject"), nt.entity_to_property(s).alias("as_property"), nt.short_id(s).alias("short"))


@query(f"with {EVENTS} select line_no from triples where kind not in (4, 5, 6)")
def filter_model(spark, sf_dir):
    return prepare.filter_predicates(_triples(spark, sf_dir), prepare.FOR_MODEL).select("line_no")


@query(f"with {EVENTS} select line_no from triples where kind <> 6")
def filter_glossary(spark, sf_dir):
    return prepare.filter_predicates(_triples(spark, sf_dir), prepare.FOR_GLOSSARY).select("line_no")


@query(f"with {EVENTS} select count(*) filter (kind not in (4, 5, 6)) as kept, count(*) filter (kind in (4, 5, 6)) as lost from triples")
def filter_stats(spark, sf_dir):
    return prepare.filter_stats(_triples(spark, sf_dir), prepare.FOR_EVALUATION)


@query(f"with {EVENTS} select case when s like '%/Q%' then 'item' else 'prop' end as kind, count(*) as triples from triples group by 1")
def split_by_prefix(spark, sf_dir):
    return prepare.kind_stats(prepare.split_by_prefix(_triples(spark, sf_dir)))


ORDER_TRIPLES = """t as (select o_orderkey * 2 as line_no, '<http://e.org/c' || o_custkey || '>' as s, case when o_orderpriority like '1%' then 'item' when o_orderpriority like '2%' then 'prop' end as k from orders
    union all select o_orderkey * 2 + 1, '<http://e.org/c' || o_custkey || '>', null from orders)"""
ORDER_BLOCKS = ORDER_TRIPLES + """, f as (select *, case when lag(s) over (order by line_no) = s then 0 else 1 end as fresh from t),
    b as (select *, sum(fresh) over (order by line_no) as block from f)"""


@query(f"with {ORDER_TRIPLES}, k as (select s, arg_max(k, line_no) as kind from t where k is not null group by s) select line_no, t.s as s, coalesce(kind, 'misc') as kind from t left join k on k.s = t.s")
def split_by_type(spark, sf_dir):
    return prepare.split_by_type(views.order_triples(spark, sf_dir)).select("line_no", "s", "kind")


@query(f"with {ORDER_BLOCKS}, k as (select block, arg_min(k, line_no) as kind from b where k is not null group by block) select line_no, s, coalesce(kind, 'misc') as kind from b left join k using (block)")
def split_by_type_blocks(spark, sf_dir):
    return prepare.split_by_type_in_blocks(views.order_triples(spark, sf_dir)).select("line_no", "s", "kind")


@query(f"with {ORDER_BLOCKS} select line_no, s, block % 7 = 0 as is_test from b")
def sample_1_in_n(spark, sf_dir):
    return prepare.sample_1_in_n(views.order_triples(spark, sf_dir), 7).select("line_no", "s", "is_test")


@query(f"with {ORDER_BLOCKS} select cast(block as bigint) as block, any_value(s) as s, count(*) as lines from b group by block")
def subject_blocks(spark, sf_dir):
    return blocks(views.order_triples(spark, sf_dir)).groupBy("block").agg(F.any_value("s").alias("s"), F.count("*").alias("lines"))


@query(f"with {EVENTS} select s[2:-2] as subject, count(*) filter (kind <> 7) as num_predicates, count(distinct p) filter (kind <> 7) as items from triples group by s")
def transactions_of_triples(spark, sf_dir):
    tx = to_transactions(_triples(spark, sf_dir), contiguous=False)
    return tx.select("subject", "num_predicates", F.size("items").cast("long").alias("items"))


@query(f"with {EVENTS}, n as (select s, count(*) filter (kind <> 7 and not (u = 31 and (kind < 4 or kind = 9))) as num_non_types from triples group by s) select num_non_types, count(*) as count from n group by 1")
def set_size_histogram(spark, sf_dir):
    return evaluate.set_sizes(to_transactions(_triples(spark, sf_dir), contiguous=False))


# --- glossary

LABELS = """l as (select doc_id as line_no, 'http://e.org/' || source as property, lang, doc_id % 2 = 0 as is_label,
    replace(replace(replace(replace(coalesce(text, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r') as word from documents where doc_id is not null),
    n as (select * from l where word <> '' and lang <> ''),
    g as (select property, lang, coalesce(arg_max(word, line_no) filter (is_label), '') as label, coalesce(arg_max(word, line_no) filter (not is_label), '') as description from n group by 1, 2)"""


@query(f"with {LABELS} select * from g")
def glossary_build(spark, sf_dir):
    return glossary.build(views.label_triples(spark, sf_dir))


@query(f"with {LABELS} select (select count(*) from g) as n_keys, count(*) filter (is_label) as n_labels, count(*) filter (not is_label) as n_descriptions from n")
def glossary_stats(spark, sf_dir):
    return glossary.stats(views.label_triples(spark, sf_dir))


@query(f"with {LABELS} select lang, count(*) as properties from g group by lang")
def glossary_languages(spark, sf_dir):
    return glossary.languages(views.label_triples(spark, sf_dir))


@query(f"""with {LABELS}, asked as (select distinct 'http://e.org/' || source as property, w as lang from documents, (select unnest(['en', 'de', 'xx']) as w) union all select 'http://e.org/none', 'en'),
    j as (select asked.property, asked.lang, g.label, g.description, e.label as el, e.description as ed from asked left join g using (property, lang) left join g e on e.property = asked.property and e.lang = 'en'),
    c as (select property, lang, case when label is not null then label else coalesce(el, '') end as label, case when label is not null then description else coalesce(ed, '') end as description from j)
    select property, lang, case when label = '' then property else label end as label, description from c""")
def glossary_translate(spark, sf_dir):
    from tributary.session import table

    names = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.format_string("http://e.org/%s", "source").alias("property")).distinct()
    asked = names.select("property", F.explode(F.array(F.lit("en"), F.lit("de"), F.lit("xx"))).alias("lang"))
    asked = asked.unionByName(spark.createDataFrame([("http://e.org/none", "en")], "property string, lang string"))
    return glossary.translate(asked, glossary.build(views.label_triples(spark, sf_dir)))


# --- rules

CLAIMS = """line as (select l_orderkey as title, l_linenumber, cast(regexp_extract(p_brand, '(\\d+)', 1) as integer) + 100 as pid, p_size % 7 + 200 as qual, case when l_returnflag = 'R' then 300 else 301 end as ref from lineitem join part on p_partkey = l_partkey),
    claims as (select title, pid, null as value from line union all select o_orderkey, 31, cast(substr(o_orderpriority, 1, 1) as integer) from orders),
    d as (select distinct title, pid as pid2 from claims),
    keys as (select title, pid2 as pid1, -1 as qid1 from d where pid2 <> 31 union all select title, 31, value from claims where pid = 31),
    tuples as (select pid1, qid1, count(*) as total from keys group by 1, 2),
    item_rules as (select pid1, qid1, pid2, count(*) as count from keys join d using (title) where pid1 <> pid2 group by 1, 2, 3),
    item as (select pid1, case when qid1 >= 0 then qid1 end as qid1, pid2, count, count / total as probability, 'item' as context from item_rules join tuples using (pid1, qid1)),
    per as (select pid as pid1, count(*) as total from line group by 1),
    qualifier as (select pid as pid1, null::integer as qid1, qual as pid2, count(*) as count, count(*) / any_value(total) as probability, 'qualifier' as context from line join per on pid1 = pid group by pid, qual),
    reference as (select pid as pid1, null::integer as qid1, ref as pid2, count(*) as count, count(*) / any_value(total) as probability, 'reference' as context from line join per on pid1 = pid group by pid, ref),
    rules as (select * from (select * from item union all select * from qualifier union all select * from reference) where probability > 0.01)"""


@query(f"with {CLAIMS} select pid1, qid1, pid2, count, probability, context from item")
def rules_item(spark, sf_dir):
    return rules.item_rules(views.entities(spark, sf_dir))


@query(f"with {CLAIMS} select pid1, qid1, pid2, count, probability, context from qualifier")
def rules_qualifier(spark, sf_dir):
    return rules.attached_rules(views.entities(spark, sf_dir), "qualifier")


@query(f"with {CLAIMS} select pid1, qid1, pid2, count, probability, context from reference")
def rules_reference(spark, sf_dir):
    return rules.attached_rules(views.entities(spark, sf_dir), "reference")


@query(f"with {CLAIMS} select pid1, qid1, pid2, count, probability, context from rules")
def rules_all(spark, sf_dir):
    return rules.compute(views.entities(spark, sf_dir))


def _suggest(spark, sf_dir, properties, tuples, **options):
    asked = spark.createDataFrame([(0, properties, tuples)], "qid long, properties array<int>, tuples array<struct<pid: int, qid: int>>")
    found = rules.suggest(views.mined_rules(spark, sf_dir), asked, **options)
    return found.select("pid2", F.round("probability", 9).alias("probability"))


@query(f"with {CLAIMS} select pid2, round(sum(probability) / 2, 9) as probability from rules where context = 'item' and pid1 in (101, 102) and pid2 not in (101, 102) group by pid2")
def suggest_by_properties(spark, sf_dir):
    return _suggest(spark, sf_dir, [101, 102], [])


@query(f"with {CLAIMS} select pid2, round(sum(probability) / 2, 9) as probability from rules where context = 'item' and ((pid1 = 31 and qid1 = 1) or (pid1 = 103 and coalesce(qid1, 0) = 0)) and pid2 not in (31, 103, 104) group by pid2 having sum(probability) / 2 > 0.1")
def suggest_by_types(spark, sf_dir):
    return _suggest(spark, sf_dir, [31, 103], [(31, 1), (103, 0)], least=0.1, deprecated=(104,))


@query(f"with {CLAIMS} select pid2, round(sum(probability) / 2, 9) as probability from rules where context = 'item' and pid1 in (101, 31) group by pid2")
def suggest_include_all(spark, sf_dir):
    return _suggest(spark, sf_dir, [101, 31], [], include="all")


# --- evaluation

EVALUATION = f"""with {TYPED}, {ITEMS},
    subs as (select subject, list(pos order by pos) filter (item like 't#%') as types, coalesce(list(pos order by pos) filter (item not like 't#%'), []) as props from pairs join items using (item) group by subject)"""


def _sql_evaluate(requests: str, missed: int = 500) -> str:
    return f"""{EVALUATION}, raw as ({requests}), req as (select row_number() over () as id, subject, list_sort(s) as s, left_out, num_types from raw where len(s) > 0),
    sets as (select row_number() over () as set_id, s from (select distinct s from req)), ranked_pairs as (select subject, pos from pairs join items using (item)),
    u as (select set_id, len(s) as n, unnest(s) as pos from sets),
    met as (select set_id, subject from u join ranked_pairs using (pos) group by set_id, subject, n having count(*) = n),
    found as (select set_id, pos, count(*) as c from met join ranked_pairs using (subject) join sets using (set_id) join items using (pos) where not list_contains(s, pos) and item not like 't#%' group by set_id, pos),
    ranked as (select set_id, pos, row_number() over (partition by set_id order by c desc, pos) as rank from found), cut as (select * from ranked where rank <= 500),
    sizes as (select set_id, count(*) as n_found from cut group by 1),
    l as (select id, set_id, len(left_out) as n_left, unnest(left_out) as pos from req join sets using (s)),
    hits as (select id, min(rank) as first, count(*) as tp, count(*) filter (rank <= n_left) as tp_at_l from l join cut using (set_id, pos) group by id),
    res as (select id, len(s) as set_size, len(left_out) as num_left_out, num_types, coalesce(first, {missed}) as rank, coalesce(tp, 0) as tp, coalesce(tp_at_l, 0) as tp_at_l, coalesce(n_found, 0) as num_found, len(s) + len(left_out) - num_types as num_non_types
    from req join sets using (s) left join sizes using (set_id) left join hits using (id))"""


_SUMMARY = """select count(*) as requests, cast(sum(rank) as bigint) as ranks, cast(sum(tp) as bigint) as tp, cast(sum(tp_at_l) as bigint) as tp_at_l, cast(sum(num_found) as bigint) as found, cast(sum(num_left_out) as bigint) as left_out, num_non_types from res group by num_non_types"""
TAKE_ONE = "select subject, list_filter(types || props, lambda x: x <> one) as s, [one] as left_out, len(types) as num_types from (select *, unnest(props) as one from subs where len(types) + len(props) >= 2)"
TAKE_MORE = "select subject, types || props[1:k] as s, props[k + 1:] as left_out, len(types) as num_types from (select *, unnest(range(1, len(props))) as k from subs where len(props) > 1)"
TAKE_BEST = "select subject, (types || props)[1:least(len(types), len(props) - 1)] as s, (types || props)[least(len(types), len(props) - 1) + 1:] as left_out, len(types) as num_types from subs where least(len(types), len(props) - 1) > 0"
TAKE_TYPE = "select subject, types as s, props as left_out, len(types) as num_types from subs where len(types) > 0 and len(props) > 0"
TAKE_HISTORIC = "select subject, types as s, [one] as left_out, len(types) as num_types from (select *, unnest(props) as one from subs where len(types) > 0)"


def requests_of_sets(spark, sf_dir, handler):
    """The model and a handler's requests of all orders, those of orders with one set once, with times."""
    model = views.model(spark, sf_dir, True)
    return model, evaluate.HANDLERS[handler](evaluate.subjects(model, views.sets(spark, sf_dir, True)))


def _evaluated(spark, sf_dir, handler):
    """A row a request of an order."""
    model = views.model(spark, sf_dir, True)
    requests = evaluate.HANDLERS[handler](evaluate.subjects(model, views.transactions(spark, sf_dir, True)))
    return evaluate.evaluate(model, requests)


def _evaluated_sets(spark, sf_dir, handler):
    """A row a request of a set, with times."""
    return evaluate.evaluate(*requests_of_sets(spark, sf_dir, handler))


def _summary(results):
    times = F.col("times") if "times" in results.columns else F.lit(1)
    sums = {"requests": F.lit(1), "ranks": F.col("rank"), "tp": F.col("tp"), "tp_at_l": F.col("tp_at_l"), "found": F.col("num_found"), "left_out": F.col("num_left_out")}
    return results.groupBy(F.col("num_non_types").cast("long").alias("num_non_types")).agg(*(F.sum(times * value.cast("long")).alias(name) for name, value in sums.items()))


@query(_sql_evaluate(TAKE_ONE) + _SUMMARY)
def eval_take_one(spark, sf_dir):
    return _summary(_evaluated_sets(spark, sf_dir, "takeOneButType"))


@query(_sql_evaluate(TAKE_MORE) + _SUMMARY)
def eval_take_more(spark, sf_dir):
    return _summary(_evaluated_sets(spark, sf_dir, "takeMoreButCommon"))


@query(_sql_evaluate(TAKE_BEST) + _SUMMARY)
def eval_take_all_but_best(spark, sf_dir):
    return _summary(_evaluated_sets(spark, sf_dir, "takeAllButBest"))


@query(_sql_evaluate(TAKE_TYPE) + _SUMMARY)
def eval_take_but_type(spark, sf_dir):
    return _summary(_evaluated_sets(spark, sf_dir, "handlerTakeButType"))


#: With each 500th customer's orders of a priority of their own, of which no other order tells.
UNSEEN = EVALUATION.replace("from pairs join items using (item) group by subject", "from (select subject, case when item like 't#%' and subject % 500 = 0 then (select max(pos) + 1 from items) else pos end as pos, item from pairs join items using (item)) group by subject")


@query(_sql_evaluate(TAKE_HISTORIC, 10_000).replace(EVALUATION, UNSEEN) + _SUMMARY)
def eval_historic(spark, sf_dir):
    """Types ask for each property; orders whose type the model lacks miss, at a rank of their own."""
    model, missed = views.model(spark, sf_dir, True), evaluate.MISSED_BY_HANDLER["historicTakeButType"]
    strange = F.when(F.col("subject") % 500 == 0, F.transform("items", lambda i: F.when(i.startswith("t#"), "t#none").otherwise(i))).otherwise(F.col("items"))
    tx = views.transactions(spark, sf_dir, True).withColumn("items", strange)
    return _summary(evaluate.evaluate(model, evaluate.HANDLERS["historicTakeButType"](evaluate.subjects(model, tx, "rare")), missed=missed))


_SHARE = "case when num_left_out = 0 then 'nan'::double else {} / num_left_out end"
_STATISTICS = f"""select -1::bigint as "group", count(*) as subjects, round(avg(rank), 6) as mean, round(coalesce(avg(rank) filter (rank < 500), 500), 6) as mean_of_hits, quantile_cont(rank, 0.5) as median, round(var_pop(rank), 6) as variance,
    round(avg((rank <= 1)::integer), 6) as top1, round(avg((rank <= 5)::integer), 6) as top5, round(avg((rank <= 10)::integer), 6) as top10, round(avg((rank <= num_left_out)::integer), 6) as topl,
    round(avg({_SHARE.format("tp")}), 6) as recall, round(avg(case when num_found = 0 then null else tp / num_found end), 6) as precision_defined, round(avg({_SHARE.format("tp_at_l")}), 6) as precision_at_l from res"""


@query(_sql_evaluate(TAKE_MORE) + _STATISTICS.replace("-1::bigint", "num_non_types::bigint") + " group by num_non_types union all " + _STATISTICS)
def eval_statistics(spark, sf_dir):
    stats = evaluate.statistics(_evaluated_sets(spark, sf_dir, "takeMoreButCommon"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "mean_of_hits", "variance", "top1", "top5", "top10", "topl", "recall", "precision_defined", "precision_at_l")]
    return stats.select(F.col("group").cast("long").alias("group"), "subjects", "median", *rounded)


# --- model output and change

@query(f"""with {PAIRS}, {ITEMS}, {SETS}, paths as (select s[1:n] as path from (select s, unnest(range(1, len(s) + 1)) as n from sets)), nodes as (select path, path[-1] as pos, count(*) as support from paths group by path)
    select 'n' || coalesce(list_aggregate(path[1:-2], 'string_agg', '_'), '') as parent, 'n' || list_aggregate(path, 'string_agg', '_') as child, item as label, support, total as weight from nodes join items using (pos) where support >= 20""")
def dot_edges(spark, sf_dir):
    return views.model(spark, sf_dir).dot_edges(20)


@query(f"with {TYPED} select item as \"URI\", count(*) as \"Frequency\", 'property' as kind from pairs where item not like 't#%' group by item union all select substr(item, 3), count(*), 'type' from pairs where item like 't#%' group by item")
def freq_export(spark, sf_dir):
    model = views.model(spark, sf_dir, True)
    return model.frequencies(False).withColumn("kind", F.lit("property")).unionByName(model.frequencies(True).withColumn("kind", F.lit("type")))


@query(f"with {PAIRS}, {ITEMS}, {SETS} select list_aggregate(s, 'string_agg', ',') as items, count(*) as support from sets group by s")
def incremental_insert(spark, sf_dir):
    """A model of the first half of the orders, then the second half inserted: the same patterns as in one go."""
    tx = views.transactions(spark, sf_dir)
    first = Model.build(tx.where("subject % 2 = 0"))
    return first.insert(tx.where("subject % 2 = 1")).patterns.select(F.array_join("items", ",").alias("items"), "support")
