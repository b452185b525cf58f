"""The pipeline on the smallest tables, each stage against a plain version of what it is to do."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from test_duplicates import near_expected, repeat_expected
from test_rules_chat_contamination import contaminated

from tracewright.llm import quality_classifier

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_quality(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_classifier.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality_classifier.score(docs, spark.sparkContext.broadcast(model)).collect()
    assert rows(stages[0]).keys() == {r.doc_id for r in scored if r.score >= quality_classifier.THRESHOLD}


def test_near_duplicates(stages):
    before = sorted(rows(stages[0]).items())
    assert rows(stages[1]) == {d: t for d, t in before if d in {x for x, _, c in near_expected(before, 5, 80) if x == c}}


def test_substrings(stages):
    before = sorted(rows(stages[1]).items())
    want = {}
    for (d, t), (_, n, gone, kept) in zip(before, repeat_expected(before, 50), strict=True):
        if not gone:
            want[d] = t
        elif gone < n:
            want[d] = kept
    assert rows(stages[2]) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(stages[2]), rows(stages[3])
    hits = {d: (n, k) for d, n, k, _ in contaminated(sorted(before.items()), items)}
    assert after.keys() == {d for d, (n, k) in hits.items() if not k or k < n}
    assert all(after[d] == before[d] for d in after if not hits[d][1])
    left = contaminated([(d, t) for d, t in after.items() if hits[d][1]], items)
    assert sum(k for _, _, k, _ in left) == 0
    count = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t))
    assert all(count(after[d]) == hits[d][0] - hits[d][1] for d in after)


def test_encoding(stages):
    before, done = rows(stages[3]), stages[4].collect()
    assert {r.doc_id for r in done} == before.keys() and all(r.lossless for r in done)


def test_run_is_the_stages(spark, stages):
    ran = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert ran == {r.doc_id: bytes(r.ids) for r in stages[4].collect()}
