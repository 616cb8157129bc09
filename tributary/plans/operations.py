"""Queries over commands, configuration files and routes, each with SQL for the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import cli
from tributary.functions.ntriples import trim_extensions
from tributary.operators import evaluate, serve, workflow
from tributary.operators.model import Model
from tributary.plans import views
from tributary.plans.queries import CLAIMS, ORDER_BLOCKS, TAKE_MORE, _sql_evaluate, _sql_recommend, query, requests_of_sets
from tributary.plans.surface import _engine, _folder
from tributary.session import write_text
from tributary.sources import entities
from tributary.sources.triples import write_lines


def _dropping(least: int) -> str:
    """The evaluation where sets of more than `least` items ask without their rarest."""
    all_items, fewer = "u as (select set_id, len(s) as n, unnest(s) as pos from sets)", f"u as (select set_id, case when len(s) > {least} then len(s) - 1 else len(s) end as n, unnest(case when len(s) > {least} then s[:-2] else s end) as pos from sets)"
    return _sql_evaluate(TAKE_MORE).replace(all_items, fewer)


_RATES = "count(*) as subjects, round(avg(rank), 6) as mean, round(avg(tp / num_left_out), 6) as recall from res"


@query(" union all ".join(f"(select {n} as config, * from ({_dropping(n + 1)} select {_RATES}))" for n in range(2)) + f" union all (select 2, * from ({_sql_evaluate(TAKE_MORE)} select {_RATES}))")
def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid's file makes configuration files; these are read, tested and compared, beside the direct answer."""
    folder = _folder(spark, "configs")
    write_text(f"{folder}/grid.json", json.dumps({"Conds": ["aboveThreshold"], "Steps": ["stepsizeLinear"], "MaxThreshold": 2, "MaxParallel": 1}))
    cli.main(["create-configs", f"{folder}/grid.json"], spark)
    made = [workflow.Configuration.read(f"{folder}/grid.json-{n}.json") for n in range(2)]
    for config in made:
        config.test()
    model, requests = requests_of_sets(spark, sf_dir, "takeMoreButCommon")
    compared = evaluate.batch(model, requests, {0: made[0].workflow(), 1: made[1].workflow(), 2: workflow.preset("direct")})
    return compared.select("config", "subjects", F.round("mean", 6).alias("mean"), F.round("recall", 6).alias("recall"))


@query(f"""with asked as ({_sql_recommend(("Brand#3", "t#2-HIGH"), True, False)}), typed as ({_sql_recommend(("Brand#3", "t#2-HIGH"), True, True)})
    select 'recommender' as endpoint, count(*) as rows, round(sum(probability), 6) as total from asked union all select 'lean-recommender', count(*), round(sum(probability), 6) from asked
    union all select 'propType', count(*), round(sum(probability), 6) from typed""")
def serve_routes(spark, sf_dir):
    """A single request at each endpoint that recommends, as the router calls it."""
    engine, request = _engine(spark, sf_dir), {"lang": "de", "types": ["2-HIGH"], "properties": ["Brand#3"]}
    told = [(name, rows) for name in serve.DIRECT_ENDPOINTS for rows in [engine.one(name, request)]]
    listed = spark.createDataFrame([(name, float(r["probability"])) for name, rows in told for r in rows], "endpoint string, probability double")
    return listed.groupBy("endpoint").agg(F.count("*").alias("rows"), F.round(F.sum("probability"), 6).alias("total"))


_RUNS = f"{ORDER_BLOCKS}, r as (select block, max(case when k = 'item' then 1 when k = 'prop' then 2 else 0 end) as top, bool_or(k = 'item') as item, bool_or(k = 'prop') as prop, bool_or(line_no % 2 = 0 and k is null) as other from b group by block)"


@query(f"""with {_RUNS} select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as iri, count(*) as total_count from r union all select 'http://e.org/status', count(*) from r
    union all select 't#http://wikiba.se/ontology#Item', count(*) from r where item having count(*) > 0 union all select 't#http://wikiba.se/ontology#Property', count(*) from r where prop having count(*) > 0
    union all select 't#http://e.org/other', count(*) from r where other having count(*) > 0""")
def command_build_tree(spark, sf_dir):
    """A typed model that the command makes of a file of lines."""
    path = _folder(spark, "command")
    t = views.order_triples(spark, sf_dir).orderBy("line_no")  # the files' names are in the order of their lines
    write_lines(t.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("line")), f"{path}/orders.nt")
    cli.main(["build-tree-typed", f"{path}/orders.nt"], spark)
    items = Model.load(spark, f"{path}/orders.nt.model.typed").items
    return items.where("total_count > 0").select("iri", "total_count")


@query(f"with {CLAIMS} select pid1, coalesce(qid1, 0) as qid1, pid2, count, probability, context from rules")
def command_mine_rules(spark, sf_dir):
    """The rules that the command mines from a CSV of entities."""
    path = _folder(spark, "mine")
    entities.write_csv(views.entities(spark, sf_dir), f"{path}/csv", compression="gzip")
    cli.main(["mine-rules", f"{path}/csv", f"{path}/pairs"], spark)
    return entities.read_pairs(spark, f"{path}/pairs")


_ENDINGS = ("", ".nt", ".nt.gz", ".nt.bz2", ".nt.bgz", ".gz", ".nt.gz.gz")


@query("select source || e as name, source || case e when '' then '' when '.nt' then '' when '.gz' then '' when '.nt.gz.gz' then '.nt.gz' else '' end as trimmed from (select distinct source from documents where source is not null), (select unnest(["
       + ", ".join(f"'{e}'" for e in _ENDINGS) + "]) as e)")
def trimmed_names(spark, sf_dir):
    """Names of files, one for each source and extension; a command's own files are few."""
    from tributary.session import table

    sources = table(spark, sf_dir, "documents").where("source is not null").select("source").distinct()
    rows = sources.select("source", F.explode(F.array(*map(F.lit, _ENDINGS))).alias("e")).select(F.concat("source", "e").alias("name"), "e")
    trimmed = {e: trim_extensions(f"x{e}")[1:] for e in _ENDINGS}
    kept = F.create_map(*(F.lit(x) for pair in trimmed.items() for x in pair))
    return rows.select("name", F.concat(F.expr("substring(name, 1, length(name) - length(e))"), kept[F.col("e")]).alias("trimmed"))
