"""What a Python worker holds beside its rows: bounded batches, and one operator's tables at a time."""

import gc
import sys
import weakref
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline

from tracewright.llm import near_dedup, sentencepiece_bpe, substring_dedup

SF = "/root/testdata/sf0.001"
BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def bound(spark):
    before = spark.conf.get(BOUND)
    yield
    spark.conf.set(BOUND, before)


def test_batches_of_a_stage_are_bounded(spark, bound):
    """Before, a batch had 10,000 rows or 64 MB, whatever the texts' lengths."""
    wide = spark.range(300, numPartitions=1).selectExpr("id as doc_id", "repeat('long text ', 10000) as text")

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    def sizes(spark, docs, sf_dir):
        return docs.mapInArrow(measure, "n long, bytes long")

    found = corpus_pipeline._stage(sizes)(spark, wide, SF).collect()
    assert sum(r.n for r in found) == 300
    assert max(r.bytes for r in found) < 4_200_000  # the last row may pass the bound


def test_a_smaller_bound_stays(spark, bound):
    spark.conf.set(BOUND, "1m")

    def kept(spark, docs, sf_dir):
        return docs

    corpus_pipeline._stage(kept)(spark, spark.range(1), SF)
    assert spark.conf.get(BOUND) == "1m"


class _Model:
    value = Path(sentencepiece_bpe.MODEL).read_bytes()


@pytest.mark.parametrize("other", [substring_dedup._features(50, 5), near_dedup._features(5)])
def test_a_worker_lets_go_of_the_encoder(other):
    """Before, an encoder of some 100 MB stayed in each worker through the stages of a next run."""
    texts, ids = pa.array(["some words of a text", None]), pa.array([1, 2])
    encode = sentencepiece_bpe._runner(_Model, 0.1, 7)
    rows = pa.RecordBatch.from_arrays([ids, ids, texts], ["row", "draw", "text"])
    docs = pa.RecordBatch.from_arrays([ids, ids, texts], ["doc_id", "row_key", "text"])
    want = [b.to_pydict() for b in encode(iter([rows]))]
    kept = weakref.ref(sentencepiece_bpe._encoder(_Model, 0.1, 7))
    assert [b.to_pydict() for b in encode(iter([rows]))] == want
    assert sentencepiece_bpe._encoder(_Model, 0.1, 7) is kept()  # between the stage's own tasks it stays
    assert sum(b.num_rows for b in other(iter([docs]))) == 2
    gc.collect()
    assert kept() is None
