import bz2
import gzip
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tributary import cli
from tributary.functions import ntriples as nt
from tributary.operators import backoff, evaluate, glossary, prepare, recommend, rules, serve, workflow
from tributary.operators.model import ALWAYS, Model
from tributary.operators.transactions import blocks, to_transactions
from tributary.plans.queries import ask
from tributary.sources import entities
from tributary.sources.triples import parse, read_ntriples
from tributary.streaming import insert

P31, TYPE = "http://www.wikidata.org/prop/direct/P31", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
NT = f"""# an orchestra
<m:cello> <{P31}> <m:Strings> .
<m:cello> <m:maker> <m:anna> .
<m:cello> <m:strings> "4" .
<m:viola> <m:maker> "shop \\"two\\" > left"@en .
<m:viola> <m:strings> "4"^^<xsd:integer>

<m:viola> <{P31}> <m:Strings> .
<m:viola> <m:length> "41" .
<m:flute> <{P31}> <m:Winds> .
<m:flute> <{P31}> <m:Solo> .
<m:flute> <m:length> "67" .
<m:flute> <m:maker> <m:otto> .
<m:drum> <m:length> "90" .
<m:drum> <http://www.wikidata.org/prop/P9> <m:x> .
"""


@pytest.fixture(scope="module")
def nt_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("nt") / "small.nt"
    path.write_text(NT)
    return str(path)


@pytest.fixture(scope="module")
def model(spark, nt_file):
    return Model.build(to_transactions(read_ntriples(spark, nt_file), typed=True), ALWAYS).persist()


def answers(model, *items, types=False, unknown="drop"):
    spark = model.items.sparkSession
    rows = recommend.named(model, recommend.recommend(model, ask(spark, model, items, unknown=unknown), types)).orderBy("rank").collect()
    return [(r.property, r.probability) for r in rows]


def test_parse(spark, nt_file):
    rows = read_ntriples(spark, nt_file).collect()
    assert len(rows) == 13 and rows[3].o == '"shop \\"two\\" > left"@en' and rows[0].s == "<m:cello>"
    literal = spark.createDataFrame([(rows[3].o,), ('"x"',), ("<i>",)], "o string").select(nt.lang_literal(F.col("o")).alias("l"), nt.iri(F.col("o")).alias("i")).collect()
    assert [tuple(r.l) for r in literal] == [('shop \\"two\\" > left', "en"), ("x", ""), ("", "")] and literal[2].i == "i"
    assert parse(spark.createDataFrame([(1, "#c"), (2, " "), (3, None)], "line_no long, line string")).count() == 0


@pytest.mark.parametrize("ending, pack", [(".gz", gzip.compress), (".bz2", bz2.compress), (".bgz", lambda b: gzip.compress(b[:200]) + gzip.compress(b[200:]))])
def test_compressed(spark, tmp_path, ending, pack):
    path = tmp_path / f"x.nt{ending}"
    path.write_bytes(pack(NT.encode()))
    assert [r.o for r in read_ntriples(spark, str(path)).orderBy("line_no").collect()] == [r.o for r in parse(spark.createDataFrame(list(enumerate(NT.split("\n"))), "line_no long, line string")).orderBy("line_no").collect()]
    assert nt.trim_extensions(f"a/x.nt{ending}") == "a/x"


def test_standard_input_and_long_literals(spark, monkeypatch):
    long = 'x' * 200_000 + '\\"' * 3000
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(f'<m:a> <m:p> "{long}"@en .\n<m:b> <m:p> <m:c> .\n'.encode())))
    rows = read_ntriples(spark, "-").withColumn("l", nt.lang_literal(F.col("o"))).orderBy("line_no").collect()
    assert [r.s for r in rows] == ["<m:a>", "<m:b>"] and rows[0].l.text == long and rows[0].l.lang == "en" and rows[1].o == "<m:c>"


def test_runs_over_stretches(spark):
    """Runs are numbered alike, however the lines are cut into stretches; line numbers may have gaps."""
    pick = random.Random(4)
    subjects = [f"<s{pick.randrange(3)}>" for _ in range(300)]
    lines = spark.createDataFrame([(3 * n, s) for n, s in enumerate(subjects)], "line_no long, s string").repartition(5)
    want, number = {}, 0
    for n, s in enumerate(subjects):
        number += n == 0 or s != subjects[n - 1]
        want[3 * n] = number
    for stretch in (1, 2, 7, 64, 1 << 20):
        assert {r.line_no: r.block for r in blocks(lines, stretch=stretch).collect()} == want
        assert {r.line_no: r.block for r in blocks(lines, first_n=5, stretch=stretch).collect()} == {n: b for n, b in want.items() if b <= 5}
    assert blocks(lines.limit(0)).collect() == [] and "SinglePartition" not in blocks(lines)._jdf.queryExecution().toString()


def test_transactions(spark, nt_file):
    rows = {r.subject: r for r in to_transactions(read_ntriples(spark, nt_file), typed=True).collect()}
    assert sorted(rows["m:flute"]["items"]) == sorted([P31, "m:length", "m:maker", "t#m:Solo", "t#m:Winds"])
    assert (rows["m:flute"].num_predicates, rows["m:flute"].num_type_predicates) == (4, 2) and rows["m:drum"].num_predicates == 1
    assert to_transactions(read_ntriples(spark, nt_file), first_n=2).count() == 2
    again = spark.createDataFrame([(1, "<a>", "<p>", "x"), (2, "<b>", "<http://www.wikidata.org/prop/P1>", "x"), (3, "<a>", "<q>", "x")], "line_no long, s string, p string, o string")
    assert sorted((r.subject, len(r["items"])) for r in to_transactions(again).collect()) == [("a", 1), ("a", 1), ("b", 0)]
    assert Model.build(to_transactions(again)).n_transactions().first().n == 3


def test_model(model):
    rank = [(r.iri, r.total_count) for r in model.items.orderBy("item").collect()]
    assert rank == [(P31, 3), ("m:length", 3), ("m:maker", 3), ("m:strings", 2), ("t#m:Strings", 2), ("t#m:Solo", 1), ("t#m:Winds", 1), ("http://dbpedia.org/ontology/type", 0), (TYPE, 0), ("root", 0)]
    assert model.nodes().where("depth > 0").count() == 11
    assert {(r.URI, r.Frequency) for r in model.frequencies(True).collect()} == {("m:Strings", 2), ("m:Winds", 1), ("m:Solo", 1)}
    assert [r.value for r in model.dot(2).collect()][0] == "digraph schema {"


def test_recommend(model, spark):
    assert answers(model, "m:strings") == [(P31, 1.0), ("m:maker", 1.0), ("m:length", 0.5)]
    assert answers(model, P31) == [("m:maker", 1.0), ("m:length", pytest.approx(2 / 3)), ("m:strings", pytest.approx(2 / 3))]
    assert len(answers(model, P31, types=True)) == 6
    assert answers(model, "t#m:Winds") == [(P31, 1.0), ("m:length", 1.0), ("m:maker", 1.0)]
    assert answers(model, "m:strings", "m:strings", "none") == answers(model, "m:strings")
    assert answers(model, "m:strings", "none", unknown="empty") == []
    popular = answers(model)
    assert popular[0] == (P31, 0.75) and popular[-1] == ("root", 0.0) and len(popular) == 10
    assert answers(model, "m:strings", "t#m:Winds") == []
    assert [r.support for r in recommend.support(model, ask(spark, model, ("m:strings",), (), ("m:strings", "t#m:Winds"))).orderBy("qid").collect()] == [2, 4, 0]


def test_containment_by_nodes(spark):
    """Random sets: sums over patterns are counts over transactions, and node supports add up to totals."""
    pick = random.Random(7)
    sets = [{f"p{pick.randrange(7)}" for _ in range(pick.randrange(6))} for _ in range(120)]
    own = Model.build(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "subject long, items array<string>")).persist()
    queries = [sorted(pick.sample([f"p{i}" for i in range(7)], pick.randrange(1, 4))) for _ in range(12)]
    found = recommend.named(own, recommend.recommend(own, ask(spark, own, *queries))).collect()
    got = {(r.qid, r.property): r.probability for r in found}
    want = {}
    for n, q in enumerate(queries):
        holding = [s for s in sets if s >= set(q)]
        for p in {x for s in holding for x in s} - set(q):
            want[n, p] = sum(p in s for s in holding) / len(holding)
    assert got == want
    nodes = {r.item: r.n for r in own.nodes().where("depth > 0").groupBy("item").agg(F.sum("support").alias("n")).collect()}
    assert nodes == {r.item: r.total_count for r in own.items.collect()}


def test_insert(spark):
    rows = [(i, [f"p{j}" for j in range(6) if i % (j + 2) == 0]) for i in range(60)]
    frame = spark.createDataFrame(rows, "subject long, items array<string>")
    both = Model.build(frame.where("subject < 30")).insert(frame.where("subject >= 30"))
    whole = Model.build(frame)
    show = lambda m: (sorted(map(tuple, m.items.select("item", "iri", "total_count").collect())), sorted((tuple(r["items"]), r.support) for r in m.patterns.collect()))
    assert show(both) == show(whole)


def test_stream(spark, tmp_path):
    rows = [(i, [f"p{j}" for j in range(5) if i % (j + 2) == 0]) for i in range(40)]
    frame = spark.createDataFrame(rows, "subject long, items array<string>")
    for part in range(2):
        frame.where(F.col("subject") % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    insert.start(stream, f"{tmp_path}/model", f"{tmp_path}/checkpoint").awaitTermination()
    insert.compact(spark, f"{tmp_path}/model", f"{tmp_path}/one")
    want = sorted((r.iri, r.total_count) for r in Model.build(frame).items.collect())
    for path in ("model", "one"):
        assert sorted((r.iri, r.total_count) for r in insert.read(spark, f"{tmp_path}/{path}").items.collect()) == want


def test_steps(spark):
    rows = spark.createDataFrame([(5, 1), (5, 7), (0, 1), (3, 4)], "n int, k int")
    got = rows.select(backoff.step_linear(F.col("n"), F.col("k"), 4).alias("l"), backoff.step_proportional(F.col("n"), F.col("k"), 4).alias("p")).collect()
    assert [(r.l, r.p) for r in got] == [(1, 1), (4, 4), (0, 0), (2, 1)]


def test_mergers(spark):
    found = spark.createDataFrame([(0, 0, 5, 0.6), (0, 0, 9, 0.3), (0, 1, 5, 0.1), (0, 1, 2, 0.72), (0, 1, 7, 0.0), (0, 2, 9, 0.9)], "qid long, part int, item int, probability double")
    assert {r.item: round(r.probability, 9) for r in backoff.merge_average(found, 4).collect()} == {5: 0.175, 9: 0.3, 2: 0.18, 7: 0.0}
    assert {r.item: r.probability for r in backoff.merge_max(found, 4).collect()} == {5: 0.6, 9: 0.9, 2: 0.72}
    assert {r.item for r in backoff.merge_first(found, 4).collect()} == {5, 9}


def test_workflow(model, spark):
    asked = ask(spark, model, ("m:strings", "t#m:Winds"), ("m:strings",))
    rows = workflow.run(model, asked, workflow.preset("best")).collect()
    layers = {r.qid: r.layer for r in rows}
    assert layers == {0: 0, 1: 1}
    nothing = workflow.run(model, asked, [workflow.Layer(workflow.above(9), None)])
    assert nothing.count() == 0
    for name in ("direct", "deletelowfrequency", "splitproperty", "toofewrecommendations"):
        assert workflow.run(model, asked, workflow.preset(name)).count() > 0
    with pytest.raises(ValueError):
        workflow.preset("none")


def test_configuration():
    good = {"Testset": "x", "layers": [{"condition": "tooFewRecommendations", "backoff": "deleteLowFrequency", "threshold": 1, "stepsize": "stepsizeLinear", "parallelExecutions": 5}, {"Condition": "always", "Backoff": "standard"}]}
    assert len(workflow.Configuration.of(good).workflow()) == 2
    for change in ({"condition": "tooFewRecommendation"}, {"stepsize": ""}, {"backoff": "tooFewRecommendations"}, {"backoff": "splitProperty"}):
        bad = {"layers": [good["layers"][0] | change]}
        with pytest.raises(ValueError):
            workflow.Configuration.of(bad).test()
    with pytest.raises(ValueError):
        workflow.Configuration.of({}).test()
    grid = workflow.Grid(["a", "b"], ["max", "avg"], ["x", "y"], ["s", "t"], 3, 6)
    assert len(grid.configurations()) == 3 * 2 * (4 + 12)


def test_glossary_and_engine(spark, model):
    lines = [f'<m:maker> {prepare.NAME} "maker"@en .', f'<m:maker> {prepare.NAME} "luthier"@fr .', f'<m:length> {prepare.DESCRIPTION} "in centimetres"@en .', f'<m:maker> {prepare.NAME} "Maker"@en .', f'<m:x> {prepare.NAME} "no language" .']
    triples = parse(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"))
    names = glossary.build(triples)
    assert {tuple(r) for r in names.collect()} == {("m:maker", "en", "Maker", ""), ("m:maker", "fr", "luthier", ""), ("m:length", "en", "", "in centimetres")}
    assert tuple(glossary.stats(triples).first()) == (3, 3, 1)
    engine = serve.Engine(model, workflow.preset("direct"), names)
    got = engine.one("recommender", {"lang": "fr", "properties": ["m:strings"]})
    assert [(r["property"], r["label"], r["description"]) for r in got] == [(P31, P31, ""), ("m:maker", "luthier", ""), ("m:length", "m:length", "in centimetres")]
    assert engine.one("support", {"types": ["m:Strings"]})[0]["support"] == 2
    assert len(engine.one("propType", {"properties": [P31]})) == 6
    assert engine.one("lean-recommender", {"properties": ["m:strings"]})[0]["total_count"] == 3


def test_prepare(spark):
    item, prop = prepare.ITEM_CLASSES[0], prepare.PROPERTY_CLASSES[0]
    rows = [(0, "<a>", prepare.RDF_TYPE, item), (1, "<a>", prepare.RDF_TYPE, prop), (2, "<b>", "<p>", "x"), (3, "<a>", "<p>", "x"), (4, "<http://www.wikidata.org/entity/Q1>", prepare.RDFS_LABEL, "y")]
    t = spark.createDataFrame([(*r, " ".join(r[1:])) for r in rows], "line_no long, s string, p string, o string, line string")
    kinds = lambda df: [r.kind for r in df.orderBy("line_no").collect()]
    assert kinds(prepare.split_by_type(t)) == ["prop", "prop", "misc", "prop", "misc"]
    assert kinds(prepare.split_by_type_in_blocks(t)) == ["item", "item", "misc", "misc", "misc"]
    assert kinds(prepare.split_by_prefix(t)) == ["misc"] * 4 + ["item"]
    assert [r.is_test for r in prepare.sample_1_in_n(t, 2).orderBy("line_no").collect()] == [False, False, True, False, True]
    assert tuple(prepare.filter_stats(t, prepare.FOR_GLOSSARY).first()) == (2, 3)


RULE_ROWS = [
    (1, "Q80", "claim", 31, "Q7"), (2, "Q80", "claim", 17, "x"), (3, "Q80", "claim", 36, "y"), (4, "Q81", "claim", 31, "Q7"), (5, "Q81", "claim", 17, "x"),
    (6, "Q82", "claim", 31, "Q9"), (7, "Q82", "claim", 17, "z"), (8, "Q83", "claim", 17, "x"), (9, "Q83", "claim", 36, "w"),
]


def test_rules(spark):
    def mined(rows):
        frame = spark.createDataFrame([(n, t, typ, str(p), "string", v) for n, t, typ, p, v in rows], "line_no long, title string, typ string, property_id string, datatype string, value string")
        return {tuple(r) for r in rules.compute(entities.from_rows(frame)).collect()}

    item = [(17, None, 31, 3, 0.75), (17, None, 36, 2, 0.5), (36, None, 17, 2, 1.0), (36, None, 31, 1, 0.5), (31, 7, 17, 2, 1.0), (31, 7, 36, 1, 0.5), (31, 9, 17, 1, 1.0)]
    assert mined(RULE_ROWS) == {(*r, "item") for r in item}
    twice = mined([*RULE_ROWS[:3], (4, "Q80", "claim", 36, "v")])
    assert twice == {(a, q, b, 1, 1.0, "item") for a, q in ((17, None), (36, None), (31, 7)) for b in (17, 31, 36) if a != b}
    attached = [(1, "Q90", "claim", 17, "x"), (2, "Q90", "qualifier", 580, "a"), (3, "Q90", "qualifier", 582, "b"), (4, "Q90", "qualifier", 580, "c"), (5, "Q90", "reference", 248, "d"), (6, "Q90", "odd", 1, "e"),
                (7, "Q90", "claim", 17, "y"), (8, "Q90", "qualifier", 580, "f"), (9, "Q90", "claim", 17, "z")]
    assert mined(attached) == {(17, None, 580, 2, 1.0, "qualifier"), (17, None, 582, 1, 0.5, "qualifier"), (17, None, 248, 1, 1.0, "reference")}


def test_suggest(spark, tmp_path):
    pairs = [(7, 0, 11, 40, 0.4), (7, 0, 12, 20, 0.2), (8, 0, 12, 6, 0.6), (8, 0, 13, 1, 0.1), (11, 0, 7, 9, 0.25), (8, 0, 7, 2, 0.05)]
    table = spark.createDataFrame([(*p, "item") for p in pairs], "pid1 int, qid1 int, pid2 int, count long, probability double, context string")
    entities.write_pairs(table.withColumn("qid1", F.lit(None).cast("int")), f"{tmp_path}/pairs")
    assert {tuple(r) for r in entities.read_pairs(spark, f"{tmp_path}/pairs").collect()} == {tuple(r) for r in table.collect()}

    def suggested(properties, **options):
        asked = spark.createDataFrame([(0, properties, [])], "qid long, properties array<int>, tuples array<struct<pid: int, qid: int>>")
        return [(r.pid2, round(r.probability, 9)) for r in rules.suggest(table, asked, **options).orderBy("rank").collect()]

    assert suggested([7]) == [(11, 0.4), (12, 0.2)]
    assert suggested([7, 8]) == [(12, 0.4), (11, 0.2), (13, 0.05)]
    assert suggested([7, 8], include="all") == [(12, 0.4), (11, 0.2), (13, 0.05), (7, 0.025)]
    assert suggested([7], deprecated=(11,)) == [(12, 0.2)] and suggested([7], least=0.3) == [(11, 0.4)]
    assert suggested([]) == [] and suggested([], initial=(99,)) == [(99, 1.0)]
    ranked = spark.createDataFrame([(0, p, 1.0, n + 1) for n, p in enumerate([31, 5, 22])], "qid long, pid2 int, probability double, rank int")
    names = spark.createDataFrame([(p, "en", f"Name {p}") for p in (5, 9, 22, 31, 40, 41)], "pid int, lang string, label string")
    assert [r.pid2 for r in rules.search(ranked, rules.made_terms(names), "name", "en", 5).orderBy("place").collect()] == [31, 5, 22, 9, 40]


def test_search_by_alias_in_pages(spark):
    ranked = spark.createDataFrame([(0, p, 1.0, n + 1) for n, p in enumerate([8, 14, 20, 30])], "qid long, pid2 int, probability double, rank int")
    terms = [(8, "en", "Name 8", "eight", ["name again"]), (14, "en", "other", None, ["x", "Named", "names"]), (20, "en", "none", None, []), (7, "en", "thing", "seven", ["NAME it"]), (9, "en", None, None, ["name 9"]), (9, "de", "Name", None, None), (5, "en", "Name 5", None, None)]
    names = spark.createDataFrame(terms, "pid int, lang string, label string, description string, aliases array<string>")

    def page(prefix, size, offset=0):
        return [tuple(r)[1:] for r in rules.search(ranked, rules.made_terms(names), prefix, "en", size, offset).orderBy("place").collect()]

    first = [(8, "Name 8", "eight", None, 1, 3), (14, "other", None, "Named", 2, 3), (5, "Name 5", None, None, 3, 3)]
    assert page("name", 3) == first
    assert page("name", 3, 3) == [(7, "thing", "seven", "NAME it", 4, None), (9, "P9", None, "name 9", 5, None)]
    assert page("name", 3, 5) == [] and page("zzz", 3) == []
    assert [r[0] for r in page("", 9)] == [8, 14, 20, 30]


def _claim(pid, kind, value, snaktype="value", **more):
    snak = {"snaktype": snaktype, "property": pid, "datatype": kind}
    return {"mainsnak": snak | ({"datavalue": {"value": value, "type": "x"}} if value is not None else {}), **more}


def test_dumps(spark, tmp_path):
    entity = {"type": "item", "id": "Q1", "claims": {
        "P9": [_claim("P9", "quantity", {"amount": "+3", "unit": "1"})],
        "P10": [_claim("P10", "wikibase-item", {"id": "Q7"}, qualifiers={"P5": [_claim("P5", "monolingualtext", {"text": "hi", "language": "en"})["mainsnak"]]},
                       references=[{"snaks": {"P6": [_claim("P6", "globe-coordinate", {"latitude": 1.5, "longitude": 2})["mainsnak"]]}}])],
        "P11": [_claim("P11", "string", None, "somevalue"), _claim("P11", "strange", "x")]}}
    (tmp_path / "d.json").write_text("[\n" + json.dumps(entity) + ",\n" + json.dumps({"type": "property", "id": "P1"}) + "\n]\n")
    got = entities.read_json(spark, f"{tmp_path}/d.json")
    rows = [tuple(r) for r in entities.to_rows(got).collect()]
    assert rows == [("Q1", "claim", 10, "wikibase-item", "Q7"), ("Q1", "qualifier", 5, "monolingualtext", "hi (en)"), ("Q1", "reference", 6, "globe-coordinate", "N1.5, E2"), ("Q1", "claim", 11, "unknown", "somevalue"), ("Q1", "claim", 9, "quantity", "+3")]
    entities.write_csv(got, f"{tmp_path}/csv")
    assert sorted(tuple(r) for r in entities.to_rows(entities.read_csv(spark, f"{tmp_path}/csv")).collect()) == sorted(rows)
    page = f"<mediawiki><page><title>Q1</title><revision><model>wikibase-item</model><text bytes='1'>{json.dumps(entity).replace('&', '&amp;').replace('<', '&lt;')}</text></revision></page></mediawiki>"
    (tmp_path / "d.xml").write_text(page)
    assert [tuple(r) for r in entities.to_rows(entities.read_xml(spark, f"{tmp_path}/d.xml")).collect()] == rows


def test_pages_of_listed_claims(spark, tmp_path):
    item = {"entity-type": "item", "numeric-id": 64}
    texts = {
        "Q1": {"label": {"en": "harbour"}, "claims": [
            {"m": ["value", 47, "string", "Pier \"A & <B>\""], "q": [], "refs": [[["value", 52, "wikibase-entityid", item], ["value", 58, "time", {"time": "+2013"}]], [["novalue", 5]]], "g": "Q1$1"},
            {"m": ["value", 88, "wikibase-entityid", item], "q": [["value", 31, "quantity", {"amount": "+25"}], ["value", 6, "bad", "x"]], "refs": []},
            {"m": ["somevalue", 40], "q": [], "refs": []},
            {"m": ["value", 625, "globecoordinate", {"latitude": 1.5, "longitude": 2}], "q": [], "refs": []}]},
        "Q2": {}, "Q3": {"claims": []}, "Q4": {"claims": [{"m": ["value", "", "bad"], "refs": [], "q": []}]}, "Q5": {"claims": [{"m": ["value", "", "unknown"], "refs": [], "q": []}]},
        "Q6": {"entity": "Q6", "redirect": "Q1"}}

    def page(title, text, model="wikibase-item"):
        text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
        return f'<page><title>{title}</title><ns>0</ns><id>1</id><revision><id>2</id><contributor><username>x</username><id>3</id></contributor><model>{model}</model><format>application/json</format><text xml:space="preserve">{text}</text></revision></page>'

    pages = [*(page(title, json.dumps(text)) for title, text in texts.items()), page("Talk:Q1", "{}", "wikitext"), page("Q7", "no JSON")]
    newer = json.dumps({"type": "item", "id": "Q8", "claims": {"P9": [_claim("P9", "string", "x")]}})
    (tmp_path / "d.xml").write_text('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.8/" version="0.8">\n' + "\n".join([*pages, page("Q8", newer)]) + "\n</mediawiki>")
    got = entities.read_xml(spark, f"{tmp_path}/d.xml")
    assert {r.title: len(r.claims) for r in got.collect()} == {"Q1": 4, "Q2": 0, "Q3": 0, "Q4": 0, "Q5": 0, "Q6": 0, "Q8": 1}
    assert [tuple(r) for r in entities.to_rows(got).collect()] == [
        ("Q1", "claim", 47, "string", 'Pier "A & <B>"'), ("Q1", "reference", 52, "wikibase-item", "Q64"), ("Q1", "reference", 58, "time", "+2013"), ("Q1", "reference", 5, "unknown", "novalue"),
        ("Q1", "claim", 88, "wikibase-item", "Q64"), ("Q1", "qualifier", 31, "quantity", "+25"), ("Q1", "claim", 40, "unknown", "somevalue"),
        ("Q1", "claim", 625, "globecoordinate", "N1.5, E2"), ("Q8", "claim", 9, "string", "x")]


def test_evaluation(spark, model, nt_file):
    subjects = evaluate.subjects(model, to_transactions(read_ntriples(spark, nt_file), typed=True))
    counts = {name: handler(subjects).count() for name, handler in evaluate.HANDLERS.items()}
    assert counts == {"takeOneButType": 10, "takeAllButBest": 3, "takeMoreButCommon": 7, "handlerTakeButType": 3, "historicTakeButType": 10}
    results = evaluate.evaluate(model, evaluate.take_one_but_type(subjects))
    rows = results.collect()
    assert all(r.tp + r.fp + r.fn + r.tn == 10 for r in rows)
    assert sum(r["rank"] == 1 for r in rows) == sum(r.tp for r in rows) == 10
    stats = {r["group"]: r for r in evaluate.derived(evaluate.statistics(results)).collect()}
    assert stats[-1].subjects == 10 and stats[-1].recall == 1.0 and stats[-1].f1 == 1.0 and stats[-1]["mean"] == 1.0
    unseen = spark.createDataFrame([("x", ["m:strings", "never seen"])], "subject string, items array<string>")
    both = [evaluate.evaluate(model, evaluate.take_one_but_type(evaluate.subjects(model, unseen, mode))).collect() for mode in ("drop", "rare")]
    assert len(both[0]) == 0 and len(both[1]) == 2 and {r.num_found for r in both[1]} == {0, 3}
    direct = workflow.preset("direct")
    assert evaluate.batch(model, evaluate.take_but_type(subjects), {0: direct, 1: direct}).count() == 2


def test_rules_in_workflows_and_batches(spark, tmp_path, capsys):
    direct = "http://www.wikidata.org/prop/direct/"
    lines = [f"<l:{i}> <{direct}P{p}> <http://www.wikidata.org/entity/Q5> ." for i, own in enumerate([(31, 1, 2, 3), (31, 1, 2), (1, 3), (1, 2)]) for p in own]
    (tmp_path / "w.nt").write_text("\n".join([*lines, "<l:0> <l:x> <l:y> ."]) + "\n")
    path, rows = f"{tmp_path}/w.nt", [(1, None, 2, 3, 0.75, "item"), (1, None, 3, 2, 0.5, "item"), (31, 5, 3, 1, 0.5, "item"), (1, None, 99, 1, 0.25, "item")]
    entities.write_pairs(spark.createDataFrame(rows, "pid1 int, qid1 int, pid2 int, count long, probability double, context string"), f"{tmp_path}/pairs")
    cli.main(["build-tree-typed", path], spark)
    model = Model.load(spark, f"{path}.model.typed")

    def said(request, *more):
        (tmp_path / "r.jsonl").write_text(json.dumps(request) + "\n")
        cli.main(["serve", f"{path}.model.typed", str(tmp_path / "r.jsonl"), *more], spark)
        return [(r["property"].removeprefix(direct), round(r["probability"], 9)) for r in json.loads(capsys.readouterr().out.strip().split("\n")[-1])]

    mined = ["--rules", f"{tmp_path}/pairs", "--preset"]
    assert said({"properties": [f"{direct}P1"]}, *mined, "wikidata-property") == [("P2", 0.75), ("P3", 0.5)]
    asked = {"properties": [f"{direct}P1"], "types": ["http://www.wikidata.org/entity/Q5"]}
    assert said(asked, *mined, "wikidata-type") == [("P3", 0.5)]
    assert said(asked, *mined, "wikidata-type-property") == [("P3", 0.5), ("P2", 0.375)]
    short = said({"properties": ["P3", "P777"]}, "--endpoint", "wikiRecommender")
    assert short[0] == ("P1", 1.0) and {p for p, _ in short} == {"P1", "P2", "P31"}
    common = ["evaluation", f"{path}.model.typed", path, "--typed"]
    cli.main([*common, "--wikiEvaluation", "--rules", f"{tmp_path}/pairs"], spark)
    base = f"{tmp_path}/w-takeOneButType"
    before = sorted(map(str, spark.read.csv(f"{base}-setSize-stats").collect()))
    cli.main([*common, "--loadResults"], spark)
    assert sorted(map(str, spark.read.csv(f"{base}-setSize-stats").collect())) == before and len(before) > 2
    results = evaluate.evaluate(model, evaluate.take_one_but_type(evaluate.subjects(model, to_transactions(read_ntriples(spark, path), typed=True))))
    assert [f.name for f in spark.read.schema(evaluate.RESULTS).json(f"{base}-results").schema] == results.columns
    evaluate.write_results(results, f"{tmp_path}/again")
    assert sorted(map(str, evaluate.read_results(spark, f"{tmp_path}/again").collect())) == sorted(map(str, results.collect()))
    for n in range(2):
        (tmp_path / f"c{n}.json").write_text(json.dumps({"testset": "", "layers": [{"condition": "always", "backoff": "standard"}]}))
    cli.main([*common, "--batchTest", f"{tmp_path}/c0.json", f"{tmp_path}/c1.json"], spark)
    assert sorted(r.config for r in spark.read.option("header", True).csv(f"{base}-batch-stats").collect()) == ["0", "1"]
    (tmp_path / "grid.json").write_text(json.dumps({"Conds": ["aboveThreshold"], "Steps": ["stepsizeLinear"], "MaxThreshold": 3, "MaxParallel": 2}))
    cli.main([*common, "--creater", f"{tmp_path}/grid.json", "--numberConfigs", "4"], spark)
    assert sorted(r.config for r in spark.read.option("header", True).csv(f"{base}-batch-stats").collect()) == ["0", "1", "2", "3"]


def test_command_line(spark, nt_file, tmp_path, capsys):
    cli.main(["build-tree-typed", nt_file], spark)
    (tmp_path / "r.jsonl").write_text(json.dumps({"properties": ["m:strings"]}) + "\n")
    cli.main(["serve", f"{nt_file}.model.typed", str(tmp_path / "r.jsonl"), "--preset", "direct"], spark)
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])[0]["property"] == P31
    cli.main(["split-dataset", "1-in-n", nt_file, "--nth", "2"], spark)
    assert spark.read.text(nt_file.removesuffix(".nt") + "-1in2-test").count() == 5
    cli.main(["filter-dataset", "for-model", nt_file], spark)
    cli.main(["evaluation", f"{nt_file}.model.typed", nt_file, "--typed", "--preset", "direct"], spark)
    assert spark.read.option("header", True).csv(nt_file.removesuffix(".nt") + "-takeOneButType-setSize-stats").count() > 1


def test_exports_are_bounded_files(spark, tmp_path):
    values = [(f"Q{n}", json.dumps({"claims": [{"m": ["value", n, "string", '<a & "b">'], "q": [], "refs": []}]})) for n in range(25)]
    entities.write_xml(spark.createDataFrame(values, "title string, value string").coalesce(1), f"{tmp_path}/xml", 10)
    assert len(list((tmp_path / "xml").glob("part-*"))) == 3
    rows = [tuple(r) for r in entities.to_rows(entities.read_xml(spark, f"{tmp_path}/xml")).collect()]
    assert sorted(rows) == sorted((f"Q{n}", "claim", n, "string", '<a & "b">') for n in range(25))


def test_a_text_is_parsed_once(spark):
    lines = spark.createDataFrame([("{}",)], "value string")
    text = entities.to_rows(entities.from_json(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json") == 1


def test_claims_of_rows_in_one_shuffle(spark):
    rows = [(n, t, typ, p, "string", f"{n}") for n, (t, typ, p) in enumerate([("Q1", "qualifier", "9"), ("Q1", "claim", "1"), ("Q2", "qualifier", "3"), ("Q1", "reference", "2"), ("Q1", "qualifier", "4"), ("Q1", "claim", "1"), ("Q1", "claim", "x"), ("Q1", "qualifier", "5")])]
    got = entities.from_rows(spark.createDataFrame(rows, "line_no long, title string, typ string, property_id string, datatype string, value string"))
    snaks = lambda xs: [(x.property_id, x.value) for x in xs]
    assert [(r.title, [((c.mainsnak.property_id, c.mainsnak.value), snaks(c.qualifiers), snaks(c["references"])) for c in r.claims]) for r in got.collect()] == [
        ("Q1", [((1, "1"), [(4, "4")], [(2, "3")]), ((1, "5"), [(5, "7")], [])])]
    text = got._jdf.queryExecution().sparkPlan().toString()
    assert text.count("Aggregate") == 2 and "Window" not in text


def test_lines_of_files_in_order(spark, tmp_path):
    """Spark packs large files into tasks before small ones; line numbers go by path all the same."""
    sizes = {"a": 3, "b": 4000, "c": 1, "d": 9000, "e": 50}
    for name, n in sizes.items():
        (tmp_path / f"part-{name}.nt").write_text("".join(f"<{name}> <{i}> <o> .\n" for i in range(n)))
    got = [tuple(r) for r in read_ntriples(spark, str(tmp_path)).orderBy("line_no").select("s", "p").collect()]
    assert got == [(f"<{name}>", f"<{i}>") for name, n in sizes.items() for i in range(n)]


def test_ordered_files_have_no_single_task(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).selectExpr("id as line_no", "concat('<s', id div 3, '> <p> <o', id, '> .') as line")
    path = f"{tmp_path}/o.nt"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows.repartition(8).orderBy("line_no").select("line").write.option("compression", "gzip").text(path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = read_ntriples(spark, path)
    assert lines.rdd.getNumPartitions() > 1
    assert [r.o for r in lines.orderBy("line_no").collect()] == [f"<o{n}>" for n in range(20_000)]
    assert to_transactions(lines).count() == 6667


def test_mining_makes_an_entitys_arrays_once(spark):
    """No filter before a generator repeats the arrays' making."""
    snak = "struct<property_id: int, datatype: string, value: string>"
    frame = spark.createDataFrame([("Q1", [((1, "string", "x"), [], [])])], f"title string, claims array<struct<mainsnak: {snak}, qualifiers: array<{snak}>, `references`: array<{snak}>>>")
    text = rules.compute(frame)._jdf.queryExecution().optimizedPlan().toString()
    light = text[: text.index("RepartitionByExpression")] if "RepartitionByExpression" in text else text.split("Repartition")[0]
    assert not [line for line in light.splitlines() if "Filter" in line and ("array_remove" in line or "array_distinct" in line)]


def test_a_models_transactions_are_read_once(spark):
    tx = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "subject long, items array<string>")
    built = Model.build(tx)
    assert not any("ExistingRDD" in df._jdf.queryExecution().sparkPlan().toString() for df in (built.items, built.patterns))
    assert sorted((r.items, r.support) for r in built.patterns.collect()) == [([0], 1), ([0, 1], 1)]
