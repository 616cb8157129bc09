"""Command line: python -m tributary.cli COMMAND ... Outputs are folders named after the input."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tributary.functions.ntriples import trim_extensions
from tributary.operators import evaluate, glossary, prepare, rules, serve, workflow
from tributary.operators.model import ALWAYS, Model
from tributary.operators.transactions import to_transactions
from tributary.session import read_text, write_text
from tributary.sources import entities
from tributary.sources.triples import read_ntriples, write_lines


def _layers(spark: SparkSession, args: argparse.Namespace) -> list[workflow.Layer]:
    if args.workflow:
        return workflow.Configuration.read(args.workflow).workflow()
    mined = rules.suggester(entities.read_pairs(spark, args.rules), "type" in args.preset, "property" in args.preset) if args.rules else None
    return workflow.preset(args.preset, mined)


def build_tree(spark: SparkSession, args: argparse.Namespace) -> None:
    typed = args.command == "build-tree-typed"
    tx = to_transactions(read_ntriples(spark, args.file), typed, args.first)
    Model.build(tx, ALWAYS).save(f"{args.file}.model{'.typed' if typed else ''}")


def build_glossary(spark: SparkSession, args: argparse.Namespace) -> None:
    glossary.build(read_ntriples(spark, args.file)).write.mode("overwrite").parquet(f"{args.file}.glossary")
    glossary.stats(read_ntriples(spark, args.file)).show()


def build_dot(spark: SparkSession, args: argparse.Namespace) -> None:
    Model.load(spark, args.file).dot(args.least).coalesce(1).write.mode("overwrite").text(f"{args.file}.dot")


def split_dataset(spark: SparkSession, args: argparse.Namespace) -> None:
    triples, base = read_ntriples(spark, args.file), trim_extensions(args.file)
    if args.way == "1-in-n":
        sampled = prepare.sample_1_in_n(triples, args.nth)
        write_lines(sampled.where("is_test"), f"{base}-1in{args.nth}-test")
        write_lines(sampled.where("not is_test"), f"{base}-1in{args.nth}-train")
        return
    split = {"by-type": prepare.split_by_type, "by-type-in-blocks": prepare.split_by_type_in_blocks, "by-prefix": prepare.split_by_prefix}[args.way](triples)
    prepare.write_split(split, f"{base}-{args.way}")
    prepare.kind_stats(split).show()


def filter_dataset(spark: SparkSession, args: argparse.Namespace) -> None:
    removed = {"for-model": prepare.FOR_MODEL, "for-glossary": prepare.FOR_GLOSSARY, "for-evaluation": prepare.FOR_EVALUATION}[args.purpose]
    triples = read_ntriples(spark, args.file)
    write_lines(prepare.filter_predicates(triples, removed), f"{trim_extensions(args.file)}-filtered")
    prepare.filter_stats(triples, removed).show()


def ask(spark: SparkSession, args: argparse.Namespace) -> None:
    names = spark.read.parquet(args.glossary) if args.glossary else None
    engine = serve.Engine(Model.load(spark, args.model), _layers(spark, args), names)
    with open(args.requests) as lines:
        for line in lines:
            print(json.dumps(engine.one(args.endpoint, json.loads(line))))


def evaluation(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.wikiEvaluation:
        args.preset = "wikidata-type-property" if args.typed else "wikidata-property"
    base = f"{trim_extensions(args.testSet)}-{args.name or args.handler}"
    if args.loadResults:
        results = evaluate.read_results(spark, f"{base}-results")
        evaluate.write_statistics(evaluate.statistics(results, args.groupBy), f"{base}-{args.groupBy}-stats", args.groupBy)
        return
    model = Model.load(spark, args.model).persist()
    tx = to_transactions(read_ntriples(spark, args.testSet), args.typed)
    requests, missed = evaluate.HANDLERS[args.handler](evaluate.subjects(model, tx, "rare")), evaluate.MISSED_BY_HANDLER.get(args.handler, evaluate.MISSED)
    if args.batchTest or args.creater:
        made = [workflow.Configuration.read(path) for path in args.batchTest or []]
        if args.creater:
            made += workflow.Grid(**json.loads(read_text(args.creater))).configurations()
        chosen = {n: config.workflow() for n, config in enumerate(made) if args.numberConfigs is None or n < args.numberConfigs}
        batch = evaluate.batch(model, requests, chosen, missed)
        batch.drop("group").orderBy("config").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}-batch-stats")
        return
    layers = _layers(spark, args)
    results = evaluate.evaluate(model, requests, lambda m, q: workflow.run(m, q, layers), missed)
    evaluate.write_results(results, f"{base}-results")
    evaluate.write_statistics(evaluate.statistics(results, args.groupBy), f"{base}-{args.groupBy}-stats", args.groupBy)


def create_configs(spark: SparkSession, args: argparse.Namespace) -> None:
    for n, config in enumerate(workflow.Grid(**json.loads(read_text(args.creater))).configurations()):
        write_text(f"{args.creater}-{n}.json", json.dumps(config, default=vars))


def mine_rules(spark: SparkSession, args: argparse.Namespace) -> None:
    read = {"csv": entities.read_csv, "json": entities.read_json, "xml": entities.read_xml}[args.format]
    entities.write_pairs(rules.compute(read(spark, args.file), args.least), args.out)


def convert_dump(spark: SparkSession, args: argparse.Namespace) -> None:
    read = {"json": entities.read_json, "xml": entities.read_xml}[args.format]
    entities.write_csv(read(spark, args.file), args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tributary")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *positional: str) -> argparse.ArgumentParser:
        own = sub.add_parser(name)
        own.set_defaults(run=run)
        for p in positional:
            own.add_argument(p)
        return own

    for name in ("build-tree", "build-tree-typed"):
        add(name, build_tree, "file").add_argument("--first", type=int)
    add("build-glossary", build_glossary, "file")
    add("build-dot", build_dot, "file").add_argument("--least", type=int, default=100_000)
    own = add("split-dataset", split_dataset)
    own.add_argument("way", choices=["by-type", "by-type-in-blocks", "by-prefix", "1-in-n"])
    own.add_argument("file")
    own.add_argument("--nth", type=int, default=1000)
    own = add("filter-dataset", filter_dataset)
    own.add_argument("purpose", choices=["for-model", "for-glossary", "for-evaluation"])
    own.add_argument("file")
    own = add("serve", ask, "model", "requests")
    own.add_argument("--glossary")
    own.add_argument("--endpoint", choices=list(serve.ENDPOINTS), default="lean-recommender")
    other = add("evaluation", evaluation, "model", "testSet")
    other.add_argument("--typed", action="store_true")
    other.add_argument("--handler", choices=list(evaluate.HANDLERS), default="takeOneButType")
    other.add_argument("--groupBy", choices=list(evaluate.GROUPS), default="setSize")
    other.add_argument("--name")
    other.add_argument("--batchTest", nargs="+", metavar="WORKFLOW", help="compare these workflow files instead")
    other.add_argument("--creater", help="compare the configurations of this grid")
    other.add_argument("--numberConfigs", type=int, help="how many of the configurations are compared, the first ones")
    other.add_argument("--loadResults", action="store_true", help="take the results that an earlier run wrote")
    other.add_argument("--wikiEvaluation", action="store_true", help="evaluate the suggester of --rules")
    for p in (own, other):
        p.add_argument("--workflow")
        p.add_argument("--preset", default="best")
        p.add_argument("--rules", help="the CSV of mine-rules, for the wikidata presets")
    add("create-configs", create_configs, "creater")
    own = add("mine-rules", mine_rules, "file", "out")
    own.add_argument("--format", choices=["csv", "json", "xml"], default="csv")
    own.add_argument("--least", type=float, default=rules.LEAST_PROBABILITY)
    add("convert-dump", convert_dump, "file", "out").add_argument("--format", choices=["json", "xml"], default="json")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    args.run(spark or SparkSession.builder.appName("tributary").getOrCreate(), args)


if __name__ == "__main__":
    main()
