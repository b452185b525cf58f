"""Rule bitmask ledger: every rule is evaluated once a document; policies and ablations only read the bits.

``ledger`` scans each text once and stores its measurements and one bit for each rule that the text fails. A ``Policy``
is a version and a set of rules, applied as ``fail_bits & mask``. ``ablation`` groups the masked bits (at most 2**rules
patterns, whatever the number of documents) and reads from those what each rule alone decides.

Nulls: a null text has no words, lines or symbols; a null doc_id stays null. Repeated rows are judged one by one, an
empty table gives an empty ledger, and columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")


@dataclass(frozen=True)
class Rule:
    """fails: of the measurements, as columns. Integers only, so that every engine decides alike."""

    name: str
    bit: int
    fails: Callable[[], Column]

    @property
    def mask(self) -> int:
        return 1 << self.bit


def _share(part: str, whole: str, percent: int) -> Callable[[], Column]:
    return lambda: F.col(part) * 100 > F.col(whole) * percent


RULES = (
    Rule("few_words", 0, lambda: F.col("n_words") < 50),
    Rule("repeated_words", 1, _share("n_repeat_words", "n_words", 50)),
    Rule("symbols", 2, _share("n_symbols", "n_words", 10)),
    Rule("duplicate_lines", 3, _share("n_dup_lines", "n_lines", 30)),
    Rule("short_words", 4, lambda: F.col("word_chars") < F.col("n_words") * 2),
    Rule("long_words", 5, lambda: F.col("word_chars") > F.col("n_words") * 15),
    Rule("shouting", 6, _share("n_upper_words", "n_words", 50)),
)
BASE_MASK = 0b11


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        known = {r.name: r.mask for r in RULES}
        return sum(known[name] for name in set(self.rules))


#: Versions are never edited; a change is a new version.
POLICIES = {
    p.version: p
    for p in (
        Policy("2024-1", ("few_words", "repeated_words")),
        Policy("2024-2", ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "shouting")),
    )
}
CURRENT = "2024-2"

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _distinct(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A key for each (text, hash)."""
    return W.mix(hashes ^ W.mix(owner.astype(np.uint64) + np.uint64(1)))


def _lines(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line, for each text."""
    n = words.n_texts
    breaks = np.flatnonzero(words.data == 10)
    begin = np.concatenate([words.offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(words.offsets, breaks, side="right") - 1])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    end = np.where(last, words.offsets[1:][owner], np.append(begin[1:], 0) - 1)
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end, owner = begin[filled], end[filled], owner[filled]
    spans = W.Words(words.data, words.offsets, begin, end, words.first, words.is_word)
    _, at = np.unique(_distinct(owner, W.hash_words(spans)), return_index=True)
    lines = np.bincount(owner, minlength=n)
    return lines, lines - np.bincount(owner[at], minlength=n)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of a slice of texts without nulls."""
    words = W.scan(texts, W.SPACED)
    n, data = words.n_texts, words.data
    point = (data & 0xC0) != 0x80
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    shouted = (upper[words.end] > upper[words.start]) & (lower[words.end] == lower[words.start])
    owner = words.text_of_word()
    at = words.window_starts(3)
    _, inverse, counts = np.unique(_distinct(owner[at], W.hash_windows(W.hash_words(words), 3, at)), return_inverse=True, return_counts=True)
    repeated = W.cover(len(words.start), at[counts[inverse] > 1], 3)
    lines, duplicates = _lines(words)
    return {
        "n_words": words.counts,
        "word_chars": _per_text(words.is_word & point, words.offsets),
        "n_symbols": _per_text(_SYMBOL[data], words.offsets),
        "n_dup_lines": duplicates,
        "n_repeat_words": np.bincount(owner[repeated], minlength=n),
        "n_lines": lines,
        "n_upper_words": np.bincount(owner[shouted], minlength=n),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = W.texts_of(batch.column("text"))
        for i, j in W.slices(texts):
            found = measure(texts.slice(i, j - i))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and fail_bits: the bit of each rule that the document fails."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select("doc_id", "text").mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(rule.mask)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def passes(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with kept and the policy's version. No rule is evaluated again."""
    return ledger.withColumn("kept", passes(policy.mask)).withColumn("policy", F.lit(policy.version))


def ablation(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone (so would come back without it), and what is kept without it."""
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    patterns = ledger.groupBy(masked.alias("pattern")).agg(F.count(F.lit(1)).alias("docs"))
    rules = [r for r in RULES if r.name in policy.rules]
    exploded = patterns.select("pattern", "docs", F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("bit")) for r in rules))).alias("r"))
    with_bit = F.col("pattern").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("pattern") == F.col("r.bit")
    free = F.col("pattern").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("docs"))), F.lit(0)).alias
    return exploded.groupBy("r.rule").agg(count(with_bit)("fails"), count(alone)("fails_alone"), count(free)("kept_without"), F.bit_or("pattern").alias("seen_bits"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = apply_policy(ledger(docs), POLICIES[CURRENT])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE_MASK)).alias("base_failed"), "kept", "n_lines", "n_upper_words", "fail_bits", "policy")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), p AS (
  SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p
), c AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, range(0, 3) AS t(k) WHERE n > 1 GROUP BY r
), l AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), dl AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_upper_words
  FROM w LEFT JOIN c USING (r) LEFT JOIN dl USING (r)
), b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (n_repeat_words * 100 > n_words * 50)::BIGINT + 4 * (n_symbols * 100 > n_words * 10)::BIGINT
    + 8 * (n_dup_lines * 100 > n_lines * 30)::BIGINT + 16 * (word_chars < n_words * 2)::BIGINT + 32 * (word_chars > n_words * 15)::BIGINT
    + 64 * (n_upper_words * 100 > n_words * 50)::BIGINT)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
  n_lines, n_upper_words, fail_bits, '2024-2' AS policy
FROM b
"""
