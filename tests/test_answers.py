"""Written models: what their requests read; large batches, shared configurations, mining, search, blocks."""

import gzip
import io
import random
import re
import time
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import backoff, evaluate, model as models, prefixes, recommend, rules, serve, sql, workflow
from tributary.operators.model import Model
from tributary.operators.transactions import coded, distinct_sets, from_pairs, sets_of_bits
from tributary.plans import views
from tributary.session import clean, file_state, materialize, shared_dir
from tributary.sources import bgz, entities
from tributary.sources.triples import read_lines, read_ntriples, write_lines
from tributary.streaming import insert


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def made(spark, seed, n=300, n_items=12):
    rng = random.Random(seed)
    rows = [(i, sorted({f"i{int(rng.paretovariate(0.7)) % n_items}" for _ in range(rng.randint(0, 7))} | ({f"t#{rng.randint(0, 2)}"} if rng.random() < 0.7 else set()))) for i in range(n)]
    return spark.createDataFrame(rows, "subject long, items array<string>")


@pytest.fixture(scope="module")
def tx(spark):
    return made(spark, 5)


@pytest.fixture(scope="module")
def written(spark, tx, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('model')}/m"
    Model.build(tx, models.ALWAYS).save(path)
    return Model.load(spark, path)


REQUESTS = [[], ["i1"], ["i2", "i1"], ["t#1"], ["i1", "t#0"], ["i1", "i2", "i3", "i4", "i5"], ["i1", "no such"], ["i3", "i1", "i3", "t#2"]]


def rows_of(df):
    return sorted((r.property, round(r.probability, 12), r["rank"]) for r in df.collect())


def test_one_request_of_a_written_model(spark, tx, written):
    plain = Model(written.items, written.patterns)
    for names in REQUESTS:
        for types in (False, True):
            asked = recommend.requests(plain, spark.createDataFrame([(0, names)], "qid long, items array<string>"))
            want = rows_of(recommend.named(plain, recommend.recommend(plain, asked, types)))
            assert rows_of(recommend.one(written, names, types)) == want, names
            assert rows_of(recommend.one(plain, names, types)) == want
            assert rows_of(recommend.named(written, recommend.recommend(written, asked, types))) == want
    assert recommend.one(written, ["i1", "no such"], unknown="empty").collect() == []
    assert len(recommend.one(written, ["i1"], limit=3).collect()) == 3


def test_a_request_reads_one_bucket(spark, written):
    for names, exchanges in ((["i1"], 0), (["i2", "i1"], 1)):
        text = plan(recommend.one(written, names))
        assert re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", text) == [("1", "16")]
        assert text.count("hashpartitioning") == exchanges and "patterns" not in text  # of sums by item, not of postings
    asked = recommend.requests(written, spark.createDataFrame([(0, ["i2", "i1"])], "qid long, items array<string>"))
    text = plan(recommend.matches(written, asked))
    assert "patterns" not in text and "place" not in " ".join(re.findall(r"hashpartitioning\(([^)]*)\)", text))


def test_places_of_frequent_items(spark, tx, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "PLACE_ROWS", 7)
    monkeypatch.setattr(models, "KEPT_ENTRIES", 3)
    Model.build(tx).save(f"{tmp_path}/m")
    own = Model.load(spark, f"{tmp_path}/m")
    assert own.n_placed > 3 and own.places.agg(F.max("places")).first()[0] > 2
    plain = Model(own.items, own.patterns)
    for names in REQUESTS:
        asked = recommend.requests(plain, spark.createDataFrame([(0, names)], "qid long, items array<string>"))
        want = rows_of(recommend.named(plain, recommend.recommend(plain, asked)))
        assert rows_of(recommend.one(own, names)) == want == rows_of(recommend.named(own, recommend.recommend(own, asked)))


def test_pairs_of_inserts(spark, tx, written, tmp_path):
    more = made(spark, 9, 80, 15)
    both = written.insert(more)
    whole = Model.build(tx.unionByName(more), models.ALWAYS)
    columns = ("item", "iri", "other", "other_iri", "other_is_type", "support")
    want = sorted(map(tuple, whole.made_pairs().select(*columns).collect()))
    assert sorted(map(tuple, both.pairs.select(*columns).collect())) == want
    both.save(f"{tmp_path}/m")
    assert sorted(map(tuple, Model.load(spark, f"{tmp_path}/m").pairs.select(*columns).collect())) == want


def test_serving_single_requests(spark, written):
    engine = serve.Engine(written, workflow.preset("direct"))
    for request in ({"properties": ["i1"]}, {"properties": ["i1"], "types": ["0"]}, {}):
        frame = spark.createDataFrame([(0, request.get("types") or [], request.get("properties") or [])], "qid long, types array<string>, properties array<string>")
        got = [(r["property"], r["total_count"], r["rank"]) for r in engine.one("lean-recommender", request)]
        assert got == [(r.property, r.total_count, r["rank"]) for r in engine.lean(frame).orderBy("rank").collect()]
        both = [(r["property"], r["rank"]) for r in engine.one("propType", request)]
        assert both == [(r.property, r["rank"]) for r in engine.properties_and_types(frame).orderBy("rank").collect()]


def test_prefix_walk(monkeypatch):
    rng = random.Random(2)
    patterns = [sorted(rng.sample(range(14), rng.randint(0, 8))) for _ in range(200)]
    lists = list({tuple(rng.sample(range(14), rng.randint(1, 5))) for _ in range(150)} | {(3, 1), (3, 1, 2), (3,)})
    support = np.array([rng.randint(1, 9) for _ in patterns])

    def flat(x):
        return np.concatenate(([0], np.cumsum([len(a) for a in x]))), np.array([i for a in x for i in a], np.int64)

    want = {(n, i): sum(int(s) for p, s in zip(patterns, support) if {*a, i} <= set(p)) for n, a in enumerate(lists) for i in range(14)}
    prefixes_ = {a[:k] for a in lists for k in range(1, len(a) + 1)}
    for rows in (1 << 21, 50):
        monkeypatch.setattr(prefixes, "STEP_ROWS", rows)
        key, n, _ = prefixes.walk(prefixes.Tree(*flat(lists), 14), *flat(patterns), support)
        assert dict(zip(zip((key // 14).tolist(), (key % 14).tolist()), n.tolist())) == {k: v for k, v in want.items() if v}
    monkeypatch.setattr(prefixes, "STEP_ROWS", 1 << 21)
    met = prefixes.walk(prefixes.Tree(*flat(lists), 14), *flat(patterns), support)[2]
    assert met == sum(set(a) <= set(p) for a in prefixes_ for p in patterns)  # each pattern meets each prefix that it holds, and nothing else


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_batches_walk_prefixes(spark, written, monkeypatch, block):
    monkeypatch.setattr(prefixes, "SET_BLOCK", block)
    monkeypatch.setattr(prefixes, "PATTERN_BLOCK", block)
    plain = Model(written.items, written.patterns)
    sets = written.patterns.where(F.size("items") < 5).select(F.reverse("items").alias("path")).distinct().unionByName(spark.createDataFrame([([2**31 - 1],), ([0, 2**31 - 1],)], "path array<int>"))
    sets = sets.select(F.xxhash64("path").alias("qid"), "path")
    got = sorted((r.qid, r.item, round(r.probability, 12)) for r in prefixes.candidates(plain, sets).collect())
    want = recommend.candidates(plain, sets.select("qid", F.array_sort("path").alias("s"))).collect()
    assert got == sorted((r.qid, r.item, round(r.probability, 12)) for r in want)


def configurations():
    linear, share = backoff.step_linear, backoff.step_proportional
    drop, split = workflow.dlf, workflow.split
    return {
        0: workflow.preset("direct"), 1: [workflow.Layer(workflow.below(3), None)],
        2: [workflow.Layer(workflow.too_few(6), drop(3, linear, backoff.more_than(4))), *workflow.preset("direct")],
        3: [workflow.Layer(workflow.too_unlikely(0.2), drop(2, share, backoff.more_likely_than(0.15))), *workflow.preset("direct")],
        4: [workflow.Layer(workflow.above(2), split(backoff.split_every_second, backoff.merge_max)), *workflow.preset("direct")],
        5: [workflow.Layer(workflow.above(1), split(backoff.split_two_ranges, backoff.merge_average)), workflow.Layer(workflow.too_few(3), drop(4, linear, backoff.more_than(1)))],
        6: [workflow.Layer(workflow.too_many(5), lambda m, q: recommend.rank(recommend.candidates(m, q))), *workflow.preset("direct")],
    }


def test_configurations_share_their_requests(spark, tx, written):
    requests = evaluate.take_more_but_common(evaluate.subjects(written, tx))
    every = configurations()
    got = {r.config: r for r in evaluate.batch(written, requests, every).collect()}
    for n, layers in every.items():
        one = evaluate.statistics(evaluate.evaluate(written, requests, lambda m, q, own=layers: workflow.run(m, q.select("qid", "s"), own))).where(F.col("group") == -1).first()
        for c in ("subjects", "mean", "median", "top1", "top5", "recall", "precision_defined", "precision_at_l"):
            assert got[n][c] == pytest.approx(one[c], rel=1e-9), (n, c)


def test_plans_do_not_grow_with_configurations(spark, tx, written):
    requests = evaluate.take_more_but_common(evaluate.subjects(written, tx))

    def scans(df):
        return len(re.findall(r"^\(\d+\) Scan", plan(df), re.M))

    two, grid = workflow.preset("direct"), workflow.Grid(["aboveThreshold", "tooUnlikelyRecommendationsCondition"], ["max", "avg"], ["everySecondItem"], ["stepsizeLinear", "stepsizeProportional"], 4, 5, 0.5)
    many = {n: c.workflow() for n, c in enumerate(grid.configurations())}
    assert len(many) == 96
    assert scans(evaluate.batch(written, requests, {0: two, 1: workflow.preset("best")})) <= 30
    assert scans(evaluate.batch(written, requests, many)) <= 30
    results = evaluate.evaluate(written, requests)
    assert scans(evaluate.statistics(results)) == scans(results)


def test_mining_of_heavy_entities(spark, monkeypatch):
    rng = random.Random(6)
    claims = {"Q1": [(rng.randint(1, 60), "x") for _ in range(50_000)] + [(31, f"Q{rng.randint(1, 20)}") for _ in range(3000)], "Q2": [(1, "x"), (2, "y"), (31, "Q3"), (31, "Q3"), (31, "bad"), (31, "Q99999999999")]}
    snak = "struct<property_id: int, datatype: string, value: string>"
    rows = [(t, [((p, "string", v), [], []) for p, v in own]) for t, own in claims.items()]
    frame = spark.createDataFrame(rows, f"title string, claims array<struct<mainsnak: {snak}, qualifiers: array<{snak}>, `references`: array<{snak}>>>")
    want, total = {}, {}
    for own in claims.values():
        props = {p for p, _ in own}
        keys = [(p, None) for p in props if p not in rules.CLASSIFYING] + [(p, int(v[1:])) for p, v in own if p in rules.CLASSIFYING and v[1:].isdigit() and int(v[1:]) < 2**31]
        for k in keys:
            total[k] = total.get(k, 0) + 1
            for p in props - {k[0]}:
                want[(*k, p)] = want.get((*k, p), 0) + 1
    for at_once in (1 << 22, 500):
        monkeypatch.setattr(rules, "PAIRS_AT_ONCE", at_once)
        got = {(r.pid1, r.qid1, r.pid2): (r["count"], round(r.probability, 9)) for r in rules.item_rules(frame).collect()}
        assert got == {k: (n, round(n / total[k[:2]], 9)) for k, n in want.items()}
    text = plan(rules.compute(frame))
    assert len(re.findall(r"hashpartitioning", text)) == 2 and "title" not in " ".join(re.findall(r"hashpartitioning\(([^)]*)\)", text))  # of counts, not of claims


def test_search_reads_a_range(spark, tmp_path):
    names = spark.createDataFrame([(p, "en", f"Name {p}", None, [f"alias {p}"]) for p in range(200)] + [(7, "de", "Name x", None, None)], "pid int, lang string, label string, description string, aliases array<string>")
    terms = rules.write_terms(names, f"{tmp_path}/terms")
    ranked = spark.createDataFrame([(q, p, 1.0, n + 1) for q in range(3) for n, p in enumerate([31, 5, 22])], "qid long, pid2 int, probability double, rank int")
    found = rules.search(ranked, terms, "NAME 2", "en", 4, 1)
    assert [(r.qid, r.pid2) for r in found.orderBy("qid", "place").collect()] == [(q, p) for q in range(3) for p in (2, 20, 21, 23)]
    text = plan(found)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(term,name 2\)[^\]]*LessThan\(term,name 3\)", text)
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert rules.after("ab") == "ac" and rules.after("a" + chr(0x10FFFF)) == "b" and rules.after("퟿") == "" and rules.after(chr(0x10FFFF)) is None


def test_parameters_of_a_page(spark):
    for bad in ({}, {"entity": "Q1", "properties": ("P1",)}, {"entity": "Q1", "offset": "x"}):
        with pytest.raises(ValueError):
            rules.Asked.of(**bad)
    assert rules.Asked.of("Q1", search="*", offset="7").search == "" and rules.Asked.of("Q1", search=" a ").least == 0.0
    table = spark.createDataFrame([(7, None, 11, 40, 0.4, "item"), (31, 5, 12, 6, 0.6, "item")], rules.SCHEMA)
    terms = rules.made_terms(spark.createDataFrame([(11, "en", "eleven"), (12, "en", "twelve")], "pid int, lang string, label string"))
    page = lambda *ids: [(r.pid2, r.label) for r in rules.suggest_page(table, terms, "en", rules.Asked.of(properties=ids)).orderBy("place").collect()]
    assert page("P7") == [(11, "eleven")] and page("Q5") == [(12, "twelve")]
    snak = "struct<property_id: int, datatype: string, value: string>"
    own = spark.createDataFrame([("Q1", [((31, "string", "Q5"), [], [])])], f"title string, claims array<struct<mainsnak: {snak}, qualifiers: array<{snak}>, `references`: array<{snak}>>>")
    assert [r.pid2 for r in rules.suggest_page(table, terms, "en", rules.Asked.of("Q1"), own).collect()] == [12]


def bgz_file(path, text, block):
    with open(path, "wb") as f:
        f.write(b"".join(bgz.compressed_block(text[at : at + block]) for at in range(0, len(text), block)) + bgz.END)


@pytest.mark.parametrize(("block", "part"), [(40, 60), (1000, 300), (60_000, 16 << 20)])
def test_blocks_in_parts(spark, tmp_path, block, part):
    rng = random.Random(block)
    files = []
    for n in range(2):
        lines = [f"{n} {i} " + "é" * rng.choice([0, 3, 30, 400]) for i in range(400 if part > 100 else 25)]
        text = "\n".join(lines).encode() + (b"\n" if n else b"")
        bgz_file(f"{tmp_path}/{n}.bgz", text, block)
        assert gzip.open(f"{tmp_path}/{n}.bgz").read() == text
        files += lines
    spark.dataSource.register(bgz.BgzSource)
    got = spark.read.format("bgz").option("part_bytes", part).load(str(tmp_path))
    rows = got.orderBy("line_no").collect()
    assert [r.line for r in rows] == files and len({r.line_no for r in rows}) == len(rows)
    assert part > 1000 or got.rdd.getNumPartitions() > 10
    with pytest.raises(Exception, match="not.?found|No such|NotFound"):
        spark.read.format("bgz").load(f"{tmp_path}/none").collect()


def test_blocks_written_and_odd_files(spark, tmp_path):
    lines = spark.range(30_000).select(F.format_string("<a:%d> <b:c> \"%s\" .", "id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("line")).repartition(3)
    for _ in range(2):  # the second time in place of the first
        write_lines(lines, f"{tmp_path}/out", "bgz")
    assert sorted(r.line for r in read_ntriples(spark, f"{tmp_path}/out", block=True).collect()) == sorted(r.line for r in lines.collect())
    (tmp_path / "plain.bgz").write_bytes(gzip.compress(b"a\nb") + gzip.compress(b"c\r\n\nd"))
    (tmp_path / "empty.bgz").write_bytes(bgz.END)
    assert [r.line for r in read_lines(spark, f"{tmp_path}/plain.bgz").orderBy("line_no").collect()] == ["a", "bc", "", "d"]
    assert read_lines(spark, f"{tmp_path}/empty.bgz").collect() == []


def test_many_members_take_linear_time(tmp_path):
    member = gzip.compress(b"some line of text\n" * 50)
    seconds = []
    for n in (20_000, 80_000):
        data = io.BytesIO(member * n)
        began = time.perf_counter()
        assert sum(map(len, bgz.members(iter(lambda data=data: data.read(1 << 18), b"")))) == n * 900
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * seconds[0]


def test_state_of_files(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    before = file_state(spark, f"{tmp_path}/t")
    assert before == file_state(spark, f"{tmp_path}/t")
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/t")
    assert before != file_state(spark, f"{tmp_path}/t")


def test_stream_is_read_by_its_last_base(spark, tmp_path):
    path, write = f"{tmp_path}/model", insert.writer(f"{tmp_path}/model", fold=3)
    rows = [(i, [f"i{i % 3}", f"i{i % 2}"]) for i in range(20)]

    def batch(n):
        return spark.createDataFrame(rows[2 * n : 2 * n + 2], "subject long, items array<string>")

    def read():
        return {(tuple(r["items"]), r["support"]) for r in insert.read(spark, path).patterns.collect()}

    def want(n):
        return {(tuple(r["items"]), r["support"]) for r in Model.build(spark.createDataFrame([(i, sorted(set(x))) for i, x in rows[: 2 * n]], "subject long, items array<string>")).patterns.collect()}

    most = 0
    for n in range(10):
        write(batch(n), n)
        most = max(most, len(insert.parts(spark, path)))
        if n in (2, 5, 6, 8):
            assert read() == want(n + 1), n
            write(batch(n), n)  # replayed, a fold too
            assert read() == want(n + 1), n
    assert read() == want(10) and most <= 3
    assert [p.rpartition("/")[2] for p in insert.parts(spark, path)] == ["base=8", "batch=9"]
    insert.compact(spark, path, f"{tmp_path}/one")
    assert {(tuple(r["items"]), r["support"]) for r in insert.read(spark, f"{tmp_path}/one").patterns.collect()} == want(10)


def test_functions_of_sql(spark, written):
    assert sql.register(written, "small") == ["small_recommend", "small_recommend_with_types", "small_support"]
    for names in REQUESTS:
        listed = ", ".join(f"'{n}'" for n in names)
        for name, types in (("recommend", False), ("recommend_with_types", True)):
            got = spark.sql(f"select * from small_{name}(cast(array({listed}) as array<string>))")
            assert rows_of(got) == rows_of(recommend.one(written, names, types)), (names, types)
            assert "Python" not in plan(got)
        asked = recommend.requests(written, spark.createDataFrame([(0, names)], "qid long, items array<string>"))
        want = recommend.support(written, asked).first()
        got = spark.sql(f"select * from small_support(cast(array({listed}) as array<string>))").first()
        assert got.support == want.support and got.fraction == pytest.approx(want.fraction)
    with pytest.raises(ValueError):
        sql.register(written, "a b")


def test_clean_up(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    views.model(spark, sf)
    materialize(spark.range(3), "x")
    from tributary import session

    assert session.exists(spark, shared_dir(spark))
    clean(spark)
    assert not session.exists(spark, shared_dir(spark))
    assert recommend.one(views.model(spark, sf), ["Brand#1"]).count() > 5  # built anew


def set_rows(df):
    return sorted((str(r.subject), r["items"], r.times) for r in df.collect())


@pytest.mark.parametrize("n_names", [0, 5, 63, 64, 150])
def test_sets_of_bits(spark, n_names):
    rng, names = random.Random(n_names), sorted(f"i{n}" for n in range(n_names))
    rows = [(rng.randint(0, 80), rng.choice(names[-3:] + names[:2] + [None])) for _ in range(300)] + [(900, None), (None, None), (None, names[0] if names else None)] + [(901, n) for n in names]
    pairs = spark.createDataFrame(rows, "subject long, item string")
    got = sets_of_bits(pairs.select("subject", *coded("item", names)), names, 300)
    assert set_rows(got) == set_rows(distinct_sets(from_pairs(pairs))) and sum(r.times for r in got.collect()) == len({r[0] for r in rows})
    assert not re.search("ObjectHashAggregate|SortAggregate", got._jdf.queryExecution().sparkPlan().toString())  # both sort what they group
    assert set_rows(sets_of_bits(pairs.where("false").select("subject", *coded("item", names)), names, 0)) == []


@pytest.mark.parametrize("n_brands", [7, 70, 300])
def test_sets_of_tables(spark, tmp_path, n_brands):
    """With more brands than the words hold, they are collected; orders without lines and lines without a part."""
    part = [(n, f"Brand#{n}" if n % 5 else None) for n in range(n_brands)]
    lines = [(n % 50, n * 7 % (n_brands + 2)) for n in range(200)] + [(777, None)]
    spark.createDataFrame(part, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(n, f"{n % 3}-X" if n % 4 else None) for n in range(60)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    for typed in (False, True):
        wanted = set_rows(distinct_sets(views.transactions(spark, str(tmp_path), typed)))
        assert set_rows(views.sets(spark, str(tmp_path), typed)) == wanted
        assert sum(r.support for r in views.model(spark, str(tmp_path), typed).patterns.collect()) == sum(w[2] for w in wanted)


def test_equal_requests_meet_before_they_are_sorted(spark, tx, written, monkeypatch):
    plans = {}

    def kept(df, hint):
        plans[hint] = df._jdf.queryExecution().sparkPlan().toString()
        return materialize(df, hint)

    monkeypatch.setattr(evaluate, "materialize", kept)
    evaluate.evaluate(written, evaluate.take_one_but_type(evaluate.subjects(written, tx)))
    assert plans["sets"].rindex("SortAggregate") < plans["sets"].index("HashAggregate")  # the lower of a plan's lines run first


def test_sums_of_sets_are_made_by_set(spark, written):
    sets = spark.createDataFrame([(n, [n % 3]) for n in range(40)], "qid long, path array<int>")
    text = prefixes.counts(written, sets)._jdf.queryExecution().sparkPlan().toString()
    assert text.rindex("HashAggregate(keys=[qid") < text.index("REPARTITION_BY_NUM") < text.index("FlatMapCoGroupsInArrow")


@pytest.mark.parametrize("handler", list(evaluate.HANDLERS))
def test_subjects_of_one_set_are_counted(spark, written, handler):
    """A row a set with times gives the statistics of a row a subject."""
    many = made(spark, 5).unionByName(made(spark, 5).select((F.col("subject") + 1000).alias("subject"), "items")).unionByName(made(spark, 6, 40).select((F.col("subject") + 5000).alias("subject"), "items"))
    sets = distinct_sets(many)
    assert sets.count() < many.count() and sets.agg(F.sum("times")).first()[0] == many.count()
    every, few = (evaluate.HANDLERS[handler](evaluate.subjects(written, rows, "rare")) for rows in (many, sets))
    workflows = {0: workflow.preset("direct"), 1: [workflow.Layer(workflow.below(3), None)]}
    for of in (lambda r: evaluate.statistics(evaluate.evaluate(written, r)), lambda r: evaluate.batch(written, r, workflows)):
        one, other = ({(r.asDict().get("config"), r.group): r for r in of(requests).collect()} for requests in (every, few))
        assert one.keys() == other.keys() and one
        for key, row in one.items():
            for c in row.asDict():
                assert other[key][c] == pytest.approx(row[c], rel=1e-9, nan_ok=True), (key, c)


def test_measures_of_rows(spark):
    """The measures against Spark's own averages, with a group without hits."""
    rows = [("a", 1, 2, 1, 1, 3, 1, 1, 4, 0, 3, 5, 2), ("b", 1, 2, 2, 1, 7, 1, 0, 4, 1, 3, 5, 2), ("c", 1, 2, 2, 1, 500, 0, 0, 0, 2, 0, 5, 3)]
    results = spark.createDataFrame(rows, evaluate.RESULTS)
    got = {r.group: r for r in evaluate.statistics(results).collect()}
    assert [got[-1][c] for c in ("subjects", "mean", "median", "mean_of_hits")] == pytest.approx([3, 170, 7, 5]) and got[-1].variance == pytest.approx(results.agg(F.var_pop("rank")).first()[0])
    assert got[3].mean_of_hits == 500 and got[3].precision_defined is None and np.isnan(got[3].precision) and got[2].precision_defined == 0.25
