import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm import brute
from tributary.llm import packing, quality

LABELS = "doc_id long, quality int, toxic int"


def _rows(spark):
    """Documents of the sample with nulls, copies, near copies, ties, personal data and poor texts."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    pick, top = random.Random(5), max(i for i, _ in rows)
    own = " ".join(f"word{pick.randrange(10**6)}" for _ in range(120))
    near = own.replace(" ", " changed ", 1)
    rows += [(top + 1, None), (top + 2, ""), (top + 3, "too short"), (top + 4, "again and again and " * 40), (None, own + " for a row without an id, mail x.y@z.example"), (None, None)]
    rows += [(top + 9, own), (top + 7, own), (top + 8, near), (top + 8, near)]  # the smallest id stays
    rows += [(top + 10, f"{' '.join(own.split()[::-1])} write to a.b@c.example or 10.0.0.1, card 4111 1111 1111 1111 call +49 (0)30 1234567-8")]
    return rows, top


def _run(spark, folder, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", "x", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


@pytest.mark.parametrize("labelled", [False, True])
def test_pipeline(spark, tmp_path, labelled):
    rows, top = _rows(spark)
    trusted = {i for i, _ in rows[:30:2]} | {top + 7, top + 8, top + 9, top + 10} if labelled else set()
    labels = [(i, 1, 0) for i in sorted(trusted)] + [(top + 3, 0, 0), (None, 1, 0)]
    want = brute.pipeline(rows, trusted, quality.BUCKETS, quality.THRESHOLD)
    kept = dict(want)
    assert len(kept) == len(want) < len(rows) and top + 7 in kept and None in kept and not kept.keys() & {top + 1, top + 2, top + 3, top + 4, top + 8, top + 9}
    assert "[EMAIL]" in kept[top + 10] and "[CARD]" in kept[top + 10] and "4111" not in kept[top + 10]
    tokenizer = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in kept.items()}
    got = _run(spark, tmp_path, rows, labels)
    assert Counter(r.doc_id for r in got).keys() == ids.keys()
    assert brute.packing_faults(got, {i: len(x) for i, x in ids.items()}) == []
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in got)


def test_pipeline_of_nothing(spark, tmp_path):
    assert _run(spark, tmp_path, [], []) == []
