"""Language identification by rank-order profiles of character n-grams.

N-grams are runs of one to three characters of the lower-cased text in which each run of other characters than letters is one
boundary mark; those without a letter do not count. A language's profile is its ``PROFILE`` most frequent n-grams over all training
documents, in order. A document's own ``DOCUMENT`` most frequent n-grams are compared to each profile: an n-gram costs the
difference of its two ranks, or ``PROFILE`` if the profile lacks it (out-of-place distance). The least sum wins; equal sums
go to the language that sorts first, equal counts to the smaller n-gram code.

Counting is one scan with per-task sums, then one shuffle of (language, n-gram, count); scoring is one scan with the profiles broadcast
(PROFILE numbers for each language; more than ``MOST_LANGUAGES`` languages are refused). The score is the winner's lead over the
next language, on 0 to 1: 1 - least / second (1 where there is one language only and it shares an n-gram, 0 for `und`).

Nulls: a null text, or one without letters, is `und` with score 0; documents without text or language teach nothing. Without any
training document everything is `und`. Repeated rows count as often as they occur; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W

PROFILE, DOCUMENT = 400, 300
MOST_LANGUAGES = 10_000
MARK = 1
_lower: list[np.ndarray] = []


def _table() -> np.ndarray:
    """The lower case of each letter's code point; MARK for other characters."""
    if not _lower:
        table = np.full(0x110000, MARK, dtype=np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                small = s.lower()
                table[c] = ord(small) if len(small) == 1 and small.isalpha() else c
        _lower.append(table)
    return _lower[0]


@dataclass
class Grams:
    """N-grams of a slice of texts: for each, its text and its place in `codes`."""

    texts: np.ndarray
    grams: np.ndarray
    places: int
    alphabet: np.ndarray

    def codes(self, places: np.ndarray) -> np.ndarray:
        """Exact codes (21 bits a character) of places."""
        size = np.int64(len(self.alphabet) + 1)
        code = np.zeros(len(places), dtype=np.int64)
        letters = np.concatenate([[0], self.alphabet]).astype(np.int64)
        for k, power in enumerate((size * size, size, np.int64(1))):
            code |= letters[places // power % size] << np.int64(21 * k)
        return code

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Places of codes; -1 where a character is not in this slice."""
        size = np.int64(len(self.alphabet) + 1)
        out = np.zeros(len(codes), dtype=np.int64)
        gone = np.zeros(len(codes), dtype=bool)
        for k in range(3):
            c = codes >> np.int64(21 * k) & np.int64((1 << 21) - 1)
            at = np.searchsorted(self.alphabet, c)
            known = (at < len(self.alphabet)) & (self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == c)
            gone |= (c != 0) & ~known
            out = out * size + np.where(c != 0, at + 1, 0)
        return np.where(gone, -1, out)


def grams_of(texts: pa.Array) -> Grams:
    """Places are numbers in base (alphabet of the slice + 1), first character highest, shorter n-grams ending in 0."""
    listed = texts.to_pylist()
    raw = np.frombuffer(("\n" + "\n".join(listed) + "\n").encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in listed], dtype=np.int64) + 1
    owner = np.concatenate([[0], np.repeat(np.arange(len(listed)), lengths)])
    letters = _table()[raw]
    kept = np.concatenate([[True], (letters[1:] != MARK) | (letters[:-1] != MARK)])
    letters, owner = letters[kept], owner[kept]
    seen = np.unique(letters)
    at = np.searchsorted(seen, letters).astype(np.int64) + 1
    size = np.int64(len(seen) + 1)
    mark = letters == MARK
    found = [(owner[~mark], at[~mark] * size * size)]
    for n in (2, 3):
        m = len(at) - n + 1
        if m <= 0:
            continue
        gram = np.zeros(m, dtype=np.int64)
        for k in range(3):
            gram = gram * size + (at[k : k + m] if k < n else 0)
        last = owner[n - 1 :]
        inside = (owner[:m] == last) | mark[:m]
        inside &= ~mark[1 : m + 1] if n == 3 else inside  # a mark in the middle parts two words
        found.append((last[inside], gram[inside]))
    return Grams(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), int(size**3), seen.astype(np.int64))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, n-gram) of a task."""
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str, codes: np.ndarray, counts: np.ndarray) -> None:
        if lang in totals:
            codes, inverse = np.unique(np.concatenate([totals[lang][0], codes]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([totals[lang][1], counts])).astype(np.int64)
        totals[lang] = (codes, counts)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])
        totals.clear()

    for batch in batches:
        texts = W.texts_of(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for i, j in W.slices(texts):
            found = grams_of(texts.slice(i, j - i))
            names, which = np.unique(langs[i:j].astype(str), return_inverse=True)
            key = np.sort(which[found.texts] * np.int64(found.places) + found.grams)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            count, key = np.diff(np.append(begin, len(key))), key[begin]
            for k, name in enumerate(names):
                a, b = np.searchsorted(key, [k * found.places, (k + 1) * found.places])
                add(str(name), found.codes(key[a:b] - k * np.int64(found.places)), count[a:b])
        if sum(len(c) for c, _ in totals.values()) > 1_000_000:
            yield from rows()
    yield from rows()


def fit(docs: DataFrame, profile: int = PROFILE) -> list[tuple[str, np.ndarray]]:
    """Languages in order, each with its profile: n-gram codes from the most frequent on."""
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= profile).select("lang", "rank", "gram")
    profiles: dict[str, list[int]] = {}
    for lang, _, gram in top.orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(lang, []).append(gram)
        if len(profiles) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return [(lang, np.array(profiles[lang], dtype=np.int64)) for lang in sorted(profiles)]


def distances(texts: pa.Array, profiles: list[tuple[str, np.ndarray]], profile: int = PROFILE, document: int = DOCUMENT) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a slice: the out-of-place distance to each language, and how many n-grams were compared."""
    n = len(texts)
    found = grams_of(texts)
    out, compared = np.zeros((n, len(profiles)), dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not len(found.grams) or not profiles:
        return out, compared
    places = np.int64(found.places)
    key = np.sort(found.texts * places + found.grams)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count, key = np.diff(np.append(begin, len(key))), key[begin]
    owner, gram = key // places, key % places
    code = found.codes(gram)
    order = np.lexsort((code, -count, owner))
    owner, gram = owner[order], gram[order]
    first = np.searchsorted(owner, np.arange(n + 1))
    rank = np.arange(len(owner)) - first[owner]
    top = rank < document
    owner, gram, rank = owner[top], gram[top], rank[top]
    compared = np.bincount(owner, minlength=n)
    for k, (_, codes) in enumerate(profiles):
        at = found.place(codes)
        there = np.flatnonzero(at >= 0)
        sort = np.argsort(at[there])
        known, known_rank = at[there][sort], there[sort]
        cost = np.full(len(gram), profile, dtype=np.int64)
        if len(known):
            near = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            same = known[near] == gram
            cost[same] = np.abs(known_rank[near[same]] - rank[same])
        out[:, k] = np.bincount(owner, cost, minlength=n).astype(np.int64)
    return out, compared


def _scorer(profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [lang for lang, _ in profiles.value]
        for batch in batches:
            texts = W.texts_of(batch.column("text"))
            for i, j in W.slices(texts):
                far, compared = distances(texts.slice(i, j - i), profiles.value)
                if names:
                    best = far.argmin(axis=1)
                    least = far[np.arange(len(far)), best]
                    second = np.partition(far, 1, axis=1)[:, 1] if len(names) > 1 else compared * PROFILE
                    score = np.where(second > 0, 1 - least / np.maximum(second, 1), 0.0)
                lang = [names[best[d]] if names and compared[d] else "und" for d in range(len(far))]
                sure = [float(score[d]) if names and compared[d] else 0.0 for d in range(len(far))]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], ["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: list[tuple[str, np.ndarray]]) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.struct("doc_id").alias("row"), "text")
    return rows.mapInArrow(_scorer(shared), f"row struct<doc_id: {kind}>, lang_pred string, score double").select("row.doc_id", "lang_pred", "score")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3))
    profiles = fit(docs.where(fold != 1))
    return predict(docs, profiles).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")
