import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import TEXTS
from tributary.llm import lexical, mixing, ranks, registry, resample, secrets

SF = "/root/testdata/sf0.001"
GOALS = [None, "", "The quick brown fox", "one two three", "é😀 same line"]


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one two three " * 9), (-5, "x" * 1000 + " é" * 300 + " y" * 30), (99, "ÀB\0C[d]e@f`g{h~i " * 7)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(i, t, 1, 2, "x", None) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, rank int, score int, term string, bucket double").repartition(3)


@pytest.fixture(scope="module")
def goals(spark):
    return spark.createDataFrame(list(enumerate(GOALS)), "item_id long, text string")


def test_places_of_ties(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 5).otherwise(F.col("id")).alias("x"), F.lit("t").alias("__other")).repartition(7)
    got = ranks.placed(rows, [F.desc("x")], "place").collect()
    assert sorted(r.place for r in got) == list(range(1, 1001)) and {r.place for r in got if r.x == 5} == set(range(101, 1001))
    assert ranks.placed(rows.limit(0), [F.desc("x")], "place").collect() == []


def test_crc_of_bytes():
    rng = random.Random(3)
    texts = ["", "a", "A b", "é" * 3000 + " b" * 5, *("".join(rng.choice("aZ9 é.😀-") for _ in range(rng.choice([3, 50, 900]))) for _ in range(60))]
    whole = pa.array(["left out", *texts], pa.large_string())[1:]  # with an offset
    one, two, of, first = resample.features(whole, 1 << 32 - 1)
    got = defaultdict(list)
    for d in range(len(texts)):
        got[d] = sorted([*one[first[d] : first[d + 1]].tolist(), *two[of == d].tolist()])
    import re
    import zlib
    for d, t in enumerate(texts):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().translate(brute.LOWER))
        assert got[d] == sorted(zlib.crc32(f) % (1 << 32 - 1) for f in w + [a + b" " + b for a, b in zip(w, w[1:])]), d


@pytest.mark.parametrize("chunk", [64, 4 << 20])
def test_resample(spark, docs, rows, goals, monkeypatch, chunk):
    monkeypatch.setattr(resample, "CHUNK_BYTES", chunk)
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(docs, goals, percent=40, buckets=997).collect()}
    assert got == brute.resampled(rows, GOALS, 40, 20, 7, 997)


def test_resample_cases(spark, docs, rows, goals):
    assert resample.resample(docs.limit(0), goals).collect() == []
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(docs, goals.limit(0)).collect()}
    assert got == brute.resampled(rows, [], 25, 20, 7, 10_000)
    text = "one two three four five " * 5
    again = spark.createDataFrame([(1, text)] * 8, "doc_id long, text string").repartition(3)
    got = resample.resample(again, goals).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len({r.score for r in got}) == 1
    sample = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    aims = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in registry.op11_importance_resampling(spark, SF).collect()}
    assert got == brute.resampled(list(sample.items()), aims, 25, 20, 7, 10_000)


SOURCES = [None, "", "a", "b", "B", "é", "big"]


def mix_rows(seed, n=1500):
    rng = random.Random(seed)
    out = [(i, rng.choice(SOURCES + ["big"] * 5), int(rng.paretovariate(0.8) * 20) % 30_000) for i in range(n)]
    return out + [(None, "a", 7), (3, "b", 12), (3, "b", 40), (n + 1, "big", 0), (n + 2, "none", 0), (n + 3, "one", 50_000)]


@pytest.mark.parametrize("broadcast", [0, 1 << 17])
def test_mixing(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    rows = mix_rows(broadcast % 7)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, size long, class string, copies int")
    got = mixing.mix(df.repartition(5)).select("doc_id", "size", "source_size", "target", "copies").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute.mixed(rows, (3, 1, 2), 1.5, 2, 12), key=key)
    assert all(0 <= r.copies <= 2 for r in got)
    if broadcast:
        assert sorted(map(tuple, mixing.mix(df.repartition(2)).select("doc_id", "size", "source_size", "target", "copies").collect()), key=key) == sorted(map(tuple, got), key=key)
        assert mixing.repeated(mixing.mix(df)).count() == sum(r.copies for r in got)


def test_mixing_is_near_its_targets(spark):
    got = registry.op12_pareto_mixing(spark, "/root/testdata/sf0.01").collect()
    source = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert not {s: (taken[s], t) for s, t in target.items() if abs(taken[s] - t) > 0.01 * t + 2}
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in got)) < 1e-3 * sum(target.values())


def test_mixing_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(empty).collect() == []
    nothing = spark.createDataFrame([(1, "a", 0), (2, None, None)], empty.schema)
    assert [(r.target, r.copies) for r in mixing.mix(nothing).collect()] == [(0.0, 0)] * 2
    # favoured documents are drawn as often as they are favoured, whole numbers stay fixed
    even = spark.createDataFrame([(i, "a" if i % 2 else "b", 10) for i in range(4000)], empty.schema)
    got = mixing.mix(even, weights=(1, 3), share=0.4, favour=F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0)).where("copies > 0").collect()
    by = Counter((r.source, r.doc_id % 4 < 2) for r in got)
    assert by["a", True] + by["a", False] in (399, 400, 401) and by["b", True] + by["b", False] in (1199, 1200, 1201)
    assert 2.2 < by["a", True] / by["a", False] < 4.2


def test_words_are_counted(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").select("text", mixing.n_words(F.col("text")).alias("n"))
    assert all(r.n == len(brute.lower_words(r.text)) for r in df.collect())


@pytest.mark.parametrize(("chunk", "step", "terms"), [(8 << 20, 1 << 12, 1 << 18), (200, 1, 1 << 18), (1 << 12, 3, 4)])
def test_search(spark, docs, rows, goals, monkeypatch, chunk, step, terms):
    monkeypatch.setattr(lexical, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lexical, "FIRST_STEP", step)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", terms)
    asked = [*enumerate(GOALS), (2, "jumps over"), (None, "one"), (7, "0 token é x"), (7, "0")]
    queries = spark.createDataFrame(asked, "item_id long, text string")
    got = sorted(map(tuple, lexical.search(docs, queries, k=3).collect()))
    assert got == brute.searched(rows, asked, 3)


def test_search_cases(spark, docs, goals):
    assert lexical.search(docs.limit(0), goals).collect() == [] and lexical.search(docs, goals.limit(0)).collect() == []
    again = spark.createDataFrame([(5, "fox one"), (4, "fox one"), (5, "fox one"), (6, "no")], "doc_id long, text string")
    got = lexical.search(again, goals, k=2).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [(2, 1, 4), (2, 2, 5), (3, 1, 4), (3, 2, 5)]
    sample = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    asked = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, registry.op13_impact_ordered_search(spark, SF).collect())) == brute.searched(sample, asked, 10)


def test_search_stops_before_all_groups(monkeypatch):
    """Where bounds prove the best documents, the rest of the postings isn't added up."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(20, 60, 4000)
    terms = np.where(rng.random(lengths.sum()) < 0.9, rng.integers(0, 20, lengths.sum()), rng.integers(20, 400, lengths.sum()))
    index = lexical.Index(np.concatenate(([0], np.cumsum(lengths))), terms, 400, 4000, int(lengths.sum()))
    weight = np.array([50 if t < 20 else 8000 for t in range(400)], np.int64)
    completed = []
    full = lexical.Index.full
    monkeypatch.setattr(lexical.Index, "full", lambda self, docs, *rest: completed.append(len(docs)) or full(self, docs, *rest))
    for asked in ([1, 2, 3, 150, 300], [2, 5, 8, 11, 399, 200, 350], [390, 391]):
        doc, score = index.search(np.array(asked), weight, 10, 1)
        every = np.bincount(index.doc, weights=np.where(np.isin(index.term, asked), weight[index.term], 0) * index.impact, minlength=4000).astype(np.int64)
        best = np.sort(every)[-10:]
        assert np.sort(score)[-10:].tolist() == best.tolist() and set(np.flatnonzero(every >= best[0])) <= set(doc.tolist()) and (every[doc] == score).all()
    assert completed and max(completed) < 400


@pytest.mark.parametrize("line", ["secret_{0} = name_{0}", "{{ key_{0} = other_{0}"])
def test_names_of_long_texts_take_linear_time(line):
    def seconds(n):
        text = "\n".join(line.format(i) for i in range(n)) + '\npassword = "qX7vB2nM9kLw4"'
        began = time.perf_counter()
        assert [text[a:b] for a, b in secrets.literals(text)][-1] == "qX7vB2nM9kLw4"
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 12 * seconds(4000)
