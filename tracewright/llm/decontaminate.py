"""Benchmark decontamination: a broadcast set of normalised test n-grams, looked up for every window of the training texts.

Words are maximal runs of 0-9, a-z and characters from U+0080 on, after lower-casing A-Z. A window is ``ngram``
consecutive words of a benchmark text; a text of fewer words, but not none, is one window. Texts are scanned as byte
arrays; a window whose 64-bit hash is in the set is then compared word by word with the benchmark's window.

The set is broadcast in blocks of about ``BLOCK_BYTES`` of benchmark text: usually one. A block is a few flat arrays (sorted window
hashes, where each window stands in the block's bytes, the items of each), about six bytes for each byte of text. The texts pass over
``AT_ONCE`` blocks at a time; then the rows are kept, the blocks are let go and the next ones are made. So neither the driver nor a
worker holds more of a larger benchmark.

Nulls: a null text has no words. A benchmark row with a null item_id still marks words, but is not among the items.
Repeated benchmark rows count once as items; repeated documents are scanned one by one. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import words as W

NGRAM = 10
BLOCK_BYTES, AT_ONCE = 4_000_000, 2


@dataclass
class Windows:
    """The distinct windows of n words: sorted hashes, the first word of each, and its items, items[begin[k]:begin[k + 1]]."""

    hashes: np.ndarray
    at: np.ndarray
    begin: np.ndarray
    items: np.ndarray


@dataclass
class Block:
    """Benchmark texts: their bytes, where each word stands in them, the items' names, and the windows by their number of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    names: list[str]
    windows: dict[int, Windows]

    def spelled(self, word: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[k] : self.end[k]].tobytes() for k in range(word, word + n))

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.data, self.start, self.end, *(x for w in self.windows.values() for x in (w.hashes, w.at, w.begin, w.items))))


def build_block(items: list[tuple[object, str | None]], ngram: int) -> Block:
    words = W.scan(pa.array([text or "" for _, text in items], pa.string()), W.ALNUM, lower=True)
    names = sorted({str(item) for item, _ in items if item is not None})
    number = {name: k for k, name in enumerate(names)}
    of_text = np.array([-1 if item is None else number[str(item)] for item, _ in items], dtype=np.int32)
    block = Block(words.data.copy(), words.start.astype(np.int32), words.end.astype(np.int32), names, {})
    hashes, counts, owner = W.hash_words(words), words.counts, words.text_of_word()
    for n in np.unique(np.minimum(counts, ngram)).tolist():
        if n:
            at = words.window_starts(n) if n == ngram else words.first[:-1][counts == n]
            block.windows[n] = _distinct(block, n, at, W.hash_windows(hashes, n, at), of_text[owner[at]])
    return block


def _distinct(block: Block, n: int, at: np.ndarray, hashes: np.ndarray, items: np.ndarray) -> Windows:
    """Equal windows as one, with their items; windows that only have the same hash stay apart."""
    order = np.lexsort((items, hashes))
    at, hashes, items = at[order].astype(np.int32), hashes[order], items[order]
    group = np.cumsum(np.concatenate([[0], (hashes[1:] != hashes[:-1]).astype(np.int64)]))
    for g in np.flatnonzero(np.bincount(group) > 1)[::-1].tolist():  # from the end, as later numbers move
        a, b = np.searchsorted(group, [g, g + 1])
        words = [block.spelled(w, n) for w in at[a:b].tolist()]
        if len(different := sorted(set(words))) > 1:
            inner = np.argsort([different.index(w) for w in words], kind="stable")
            at[a:b], items[a:b] = at[a:b][inner], items[a:b][inner]
            group[a:b] += np.array([different.index(words[k]) for k in inner])
            group[b:] += len(different) - 1
    once = np.concatenate([[True], (group[1:] != group[:-1]) | (items[1:] != items[:-1])])
    at, hashes, items, group = at[once], hashes[once], items[once], group[once]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return Windows(hashes[first], at[first], np.append(first, len(group)).astype(np.int32), items)


def hits(words: W.Words, block: Block) -> tuple[np.ndarray, list[set[str]]]:
    """Which words are hit, and the items found in each text."""
    hit = np.zeros(len(words.start), dtype=bool)
    items: list[set[str]] = [set() for _ in range(words.n_texts)]
    hashes = W.hash_words(words)
    for n, known in block.windows.items():
        at = words.window_starts(n)
        h = W.hash_windows(hashes, n, at)
        place = np.minimum(np.searchsorted(known.hashes, h), len(known.hashes) - 1)
        same = np.flatnonzero(known.hashes[place] == h)
        sure = []
        for i, p in zip(at[same].tolist(), place[same].tolist(), strict=True):
            own, mine = b" ".join(words.word(k) for k in range(i, i + n)), known.hashes[p]
            while p < len(known.hashes) and known.hashes[p] == mine:
                if block.spelled(int(known.at[p]), n) == own:
                    sure.append(i)
                    who = known.items[known.begin[p] : known.begin[p + 1]].tolist()
                    items[int(np.searchsorted(words.first, i, side="right")) - 1].update(block.names[k] for k in who if k >= 0)
                    break
                p += 1
        hit |= W.cover(len(hit), np.array(sure, dtype=np.int64), n)
    return hit, items


def _spans(hit: np.ndarray) -> np.ndarray:
    """Runs of hit words, as [from, to)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


HITS = "struct<n_words: bigint, spans: array<struct<`from`: int, `to`: int>>, items: array<string>, cut: string>"
_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _cut(raw: bytes, words: W.Words, first: int, spans: list[dict], offset: int) -> str:
    """The text without its hit words and what stands between the words of one run."""
    parts, at = [], 0
    for x in spans:
        parts.append(raw[at : int(words.start[first + x["from"]]) - offset])
        at = int(words.end[first + x["to"] - 1]) - offset
    return b"".join([*parts, raw[at:]]).decode()


def _scanner(windows, cut: bool):
    """An Arrow UDF on the text and what earlier blocks found; texts stay in the JVM. cut: also give the cut text, where anything is hit."""

    @F.arrow_udf(HITS)
    def scan(column: pa.Array, earlier: pa.Array) -> pa.Array:
        W.let_go()
        texts, before = W.texts_of(column), earlier.to_pylist()
        counts, spans, items, cuts = [], [], [], []
        for i, j in W.slices(texts):
            part = texts.slice(i, j - i)
            words = W.scan(part, W.ALNUM, lower=True)
            hit, found = hits(words, windows.value)
            for d, old in enumerate(before[i:j]):
                own = hit[words.first[d] : words.first[d + 1]]
                for x in old["spans"]:
                    own[x["from"] : x["to"]] = True
                spans.append([{"from": x, "to": y} for x, y in _spans(own).tolist()] if own.any() else [])
                items.append(sorted(found[d].union(old["items"])))
                cuts.append(_cut(part[d].as_py().encode(), words, int(words.first[d]), spans[-1], int(words.offsets[d])) if cut and spans[-1] else None)
            counts += words.counts.tolist()
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(cuts, pa.string())], ["n_words", "spans", "items", "cut"])

    return scan.asNondeterministic()  # one evaluation a row, whatever is filtered by it


def find(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, block_bytes: int = BLOCK_BYTES, cut: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """docs' columns and a struct _hits: n_words, spans (runs of hit words, [from, to)), items (sorted as strings), cut (on request: the
    text without the spans, where there are any)."""
    spark = docs.sparkSession
    rows = benchmark.select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(total / block_bytes))
    none = F.struct(F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<`from`: int, `to`: int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(None).cast("string").alias("cut"))
    out, shared = docs.withColumn("_hits", none), []
    for k in range(blocks):
        if len(shared) == at_once:
            out = scratch.keep(out, "benchmark-hits")
            for old in shared:
                old.destroy()
            shared = []
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared.append(spark.sparkContext.broadcast(build_block([(r[0], r[1]) for r in block.toLocalIterator()], ngram)))
        out = out.withColumn("_hits", _scanner(shared[-1], cut and k + 1 == blocks)("text", "_hits"))
    return out


def _n_hit() -> Column:
    return F.aggregate("_hits.spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", ngram: int = NGRAM) -> DataFrame:
    """docs without their contamination; docs' columns, n_chars (if any) following the text. A text without a hit is returned as it is.

    mode "documents": drop each contaminated document. mode "spans": cut the hit words, with what stands between the
    words of one run, and drop a document that has no other word.
    """
    found = find(docs, benchmark, ngram, cut=mode == "spans")
    if mode == "documents":
        return found.where(F.size("_hits.spans") == 0).select(docs.columns)
    left = found.where((_n_hit() == 0) | (_n_hit() < F.col("_hits.n_words")))
    text = F.coalesce("_hits.cut", "text")
    values = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("_hits.cut").isNull(), F.col("n_chars")).otherwise(F.length("_hits.cut")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return left.select(*(values.get(c, F.col(f"`{c}`")) for c in docs.columns))


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = _n_hit()
    return found.select("doc_id", F.col("_hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_hits.items").cast("long").alias("n_items"), F.sha2(F.array_join("_hits.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bl AS (
  SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM bl)
), dw AS (
  SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), h AS (
  SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), hw AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r
), hi AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
