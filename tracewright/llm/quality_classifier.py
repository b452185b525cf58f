"""Quality classifier: random-indexing word vectors pooled a document, then a two-layer network with calibrated output.

Terms of a text are, for each word, the word itself (hashed to ``WORDS`` places), its shape (case, digits, last character if no
letter, length) and, where it equals one of the two words before, a repetition mark. Every term has a sparse random index vector; a
word's vector is the sum of the index vectors of the words near it over all documents, plus its own. A document is the mean
of its words' vectors beside the mean of its shapes' and marks' index vectors, with its logarithmic length.

The network (hidden tanh layer, one output) is fitted with numpy on the driver, on at most ``SAMPLE`` labelled documents, those
with the smallest hash of doc_id; a fifth of them is left out to fit the temperature. Word vectors need no labels: every task sums
those of its documents, in whole numbers, and a combining aggregate of one row a word adds the tasks' sums up. Scoring covers every whole text, in one scan without a shuffle; the model (about 2 MB) is broadcast.

Nulls: a null or empty text is scored as a text without words; rows of labels without doc_id or label are ignored, as are
documents whose labels contradict each other. Without usable labels of both kinds every score is the share of label 1 (0.5
without any). Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

SAMPLE = 6000
WORDS, DIM, SHAPE_DIM, HIDDEN = 1 << 13, 32, 48, 24
SHAPES = 1 << 10
THRESHOLD = 0.7
SEED = 11


@functools.cache
def index_vectors(n: int, dim: int, seed: int) -> np.ndarray:
    """Ternary vectors with four entries that are not 0."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), dtype=np.float32)
    for _ in range(4):
        out[np.arange(n), rng.integers(0, dim, n)] = rng.choice(np.array([-1, 1], dtype=np.float32), n)
    return out


def terms(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each word, its shape, and 0, 1 or 2 for a repetition mark (equal to the word before, or before that)."""
    hashes = W.hash_words(words)
    word = (hashes % np.uint64(WORDS)).astype(np.int64)
    sums = lambda low, high: np.concatenate([[0], np.cumsum((words.data >= low) & (words.data <= high))])
    has = lambda low, high: (s := sums(low, high))[words.end] > s[words.start]
    last = words.data[words.end - 1].astype(np.int64)
    letter = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128)
    length = np.minimum((words.end - words.start) // 6, 3)
    case = has(65, 90) + 2 * has(97, 122) + 4 * has(48, 57)
    shape = W.mix((np.where(letter, 0, last) * 64 + case * 4 + length).astype(np.uint64)) % np.uint64(SHAPES - 3)
    owner = words.text_of_word()
    mark = np.zeros(len(hashes), dtype=np.int64)
    for back in (2, 1):
        same = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
        mark[back:][same] = back
    return word, shape.astype(np.int64), mark


def _means(vectors: np.ndarray, places: np.ndarray, words: W.Words) -> np.ndarray:
    out = np.zeros((words.n_texts, vectors.shape[1]), dtype=np.float32)
    full = np.flatnonzero(words.counts)
    if len(full):
        out[full] = np.add.reduceat(vectors[places], words.first[:-1][full], axis=0) / words.counts[full][:, None]
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.spread
        return _sigmoid((np.tanh(x @ self.hidden + self.hidden_bias) @ self.out + self.out_bias) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@functools.cache
def _entries() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each word's index vector; a sign of 0 where entries fell together."""
    index = index_vectors(WORDS, DIM, SEED)
    at = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :4]
    return at, np.take_along_axis(index, at, axis=1).astype(np.float64)


def context_sums(texts: pa.Array) -> np.ndarray:
    """Sums of the index vectors of the two words on either side, for each word place, over a slice; in whole numbers."""
    at, sign = _entries()
    words = W.scan(texts, W.SPACED)
    word, _, _ = terms(words)
    owner = words.text_of_word()
    sums = np.zeros(WORDS * DIM)
    for gap in (1, 2):
        same = owner[gap:] == owner[:-gap]
        left, right = word[:-gap][same], word[gap:][same]
        for k in range(4):
            sums += np.bincount(left * DIM + at[right, k], sign[right, k], WORDS * DIM)
            sums += np.bincount(right * DIM + at[left, k], sign[left, k], WORDS * DIM)
    return sums.astype(np.int64).reshape(WORDS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    scale = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.maximum(scale, 1) + 0.5 * index_vectors(WORDS, DIM, SEED)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    words = W.scan(texts, W.SPACED)
    word, shape, mark = terms(words)
    shapes = index_vectors(SHAPES, SHAPE_DIM, SEED + 1)
    marks = np.eye(3, dtype=np.float32)[:, 1:]
    return np.hstack([_means(vectors, word, words), _means(shapes, shape, words), _means(marks, mark, words), np.log1p(words.counts)[:, None].astype(np.float32)])


def train(features: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Model:
    """Full-batch Adam on the cross-entropy, then the temperature, 1 or more, of the least cross-entropy on the fifth left out."""
    rng = np.random.default_rng(SEED)
    y = labels.astype(np.float64)
    rate = float(y.mean()) if len(y) else 0.5
    width = features.shape[1]
    if len(y) < 10 or y.min() == y.max():
        bias = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
        return Model(vectors, np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), bias, 1.0)
    mean, spread = features.mean(axis=0).astype(np.float64), features.std(axis=0).astype(np.float64) + 1e-3
    x = (features - mean) / spread
    held = np.arange(len(y)) % 5 == 4
    xt, yt = x[~held], y[~held]
    p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array([np.log((rate + 1e-3) / (1 - rate + 1e-3))])]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, 401):
        h = np.tanh(xt @ p[0] + p[1])
        d = (_sigmoid(h @ p[2] + p[3]) - yt) / len(yt)
        back = np.outer(d, p[2]) * (1 - h * h)
        grads = [xt.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    logits = np.tanh(x[held] @ p[0] + p[1]) @ p[2] + p[3]
    loss = lambda t: -np.mean(y[held] * np.log(_sigmoid(logits / t) + 1e-12) + (1 - y[held]) * np.log(1 - _sigmoid(logits / t) + 1e-12))
    temperature = min(np.geomspace(1, 8, 60), key=loss)
    return Model(vectors, mean, spread, p[0], p[1], p[2], float(p[3][0]), float(temperature))


def fold(doc_id: str = "doc_id", of: int = 4) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(of))


_SUMS = [f"s{k}" for k in range(DIM)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums, a row for each word that it has."""
    total = np.zeros((WORDS, DIM), dtype=np.int64)
    for batch in batches:
        texts = W.texts_of(batch.column("text"))
        for i, j in W.slices(texts):
            total += context_sums(texts.slice(i, j - i))
    some = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(total[some, k]) for k in range(DIM))], ["word", *_SUMS])


def corpus_sums(docs: DataFrame) -> np.ndarray:
    """context_sums of all documents."""
    part = docs.select("text").mapInArrow(W.tidy(_sums), ", ".join(f"{c} long" for c in ["word", *_SUMS]))
    rows = part.groupBy("word").agg(*(F.sum(c).alias(c) for c in _SUMS)).collect()  # at most WORDS rows
    out = np.zeros((WORDS, DIM))
    for r in rows:
        out[r[0]] = r[1:]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int | None = 2) -> Model:
    """Fit on at most `sample` labelled documents. held_out: the fold that is not learned from."""
    spark = docs.sparkSession
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most and label in (0, 1)")
    if held_out is not None:
        known = known.where(fold() != held_out)
    present = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = [(r[0], r[1]) for r in present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "label").collect()]
    parts = 8
    wanted = F.broadcast(spark.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int"))  # at most `sample` rows
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").repartition(parts, "doc_id")
    vectors = word_vectors(corpus_sums(docs)).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = W.texts_of(batch.column("text"))
            for i, j in W.slices(column):
                x = pooled(column.slice(i, j - i), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(W.tidy(featured), f"doc_id {kind}, label int, x binary").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows]).reshape(len(rows), DIM + SHAPE_DIM + 3)
    return train(x, np.array([r[1] for r in rows]), vectors)


def _score_only(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.texts_of(batch.column("text"))
            for i, j in W.slices(texts):
                scores = model.value.scores(pooled(texts.slice(i, j - i), model.value.vectors))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(scores.astype(np.float64))], ["row", "score"])

    return run


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row. model: a broadcast Model."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.struct("doc_id").alias("row"), "text")
    return rows.mapInArrow(_score_only(model), f"row struct<doc_id: {kind}>, score double").select("row.doc_id", "score")


def _accepts(model, threshold: float):
    """An Arrow UDF on the text alone: the other columns, and the text of what is kept, never leave the JVM."""

    @F.arrow_udf("boolean")
    def accepts(column: pa.Array) -> pa.Array:
        W.let_go()
        texts = W.texts_of(column)
        return pa.array([bool(ok) for i, j in W.slices(texts) for ok in model.value.scores(pooled(texts.slice(i, j - i), model.value.vectors)) >= threshold], pa.bool_())

    return accepts


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts; docs' columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels))
    return docs.where(_accepts(model, threshold)("text"))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = spark.sparkContext.broadcast(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
