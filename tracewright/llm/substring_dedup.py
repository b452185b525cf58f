"""Exact removal of repeated word sequences, by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. A word is removed when a window that covers it also starts in a
document with a smaller doc_id; windows are judged on the input.

1. One scan gives every window its minimiser, the least hash of its runs of ``RUN`` words. Consecutive windows with one
   minimiser are a super-k-mer: (document, first word, number of windows). Windows of equal words have equal minimisers.
2. A minimiser that only one document has cannot belong to a shared window. For the others, the super-k-mers' words
   travel as one packed string to the minimiser's bucket. Equal strings of one scan slice travel once, with the smallest
   doc_id that has them.
3. A bucket sorts its windows exactly (ranks of runs of 1, 2, 4, ... 32, 50 words, from exact word ids), and finds the
   smallest doc_id of each. It answers for each string; the answer is joined to the string's occurrences, which never
   meet in one task.
4. A minimiser of more than ``HEAVY`` strings, as around a passage of very many documents, has no bucket. Its equal strings are merged over
   the whole table; what differs is mostly what stands around the passage, in windows that only one string has. So each string is
   cut down to the windows whose hash several documents have, equal remainders are merged again, and their windows are grouped one
   by one, as words, by a combining aggregate. Every answer leads back along the merges to the strings.

doc_ids may be of any ordered type. Nulls: a null text has no words; a document without doc_id neither loses words nor takes them from
others. Repeated rows of one doc_id and text are judged alike. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from . import words as W

WINDOW, RUN = 50, 5
BUCKET_BYTES = 2_000_000
HEAVY = 1000


def super_kmers(words: W.Words, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first word, number of windows and text of each super-k-mer of a slice."""
    hashes = W.hash_words(words)
    at = words.window_starts(window)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = W.hash_windows(hashes, run, np.arange(len(hashes) - run + 1))
    width, wanted = 1, window - run + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    minimiser = least[at]
    owner = np.searchsorted(words.first, at, side="right") - 1
    new = np.concatenate([[True], (minimiser[1:] != minimiser[:-1]) | (owner[1:] != owner[:-1])])
    begin = np.flatnonzero(new)
    return minimiser[begin].view(np.int64), at[begin], np.diff(np.append(begin, len(at))), owner[begin]


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _hexes(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _features(window: int, run: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.texts_of(batch.column("text"))
            for i, j in W.slices(texts):
                words = W.scan(texts.slice(i, j - i), W.SPACED)
                minimiser, first, count, owner = super_kmers(words, window, run)
                n = words.n_texts
                columns = {
                    "doc_id": batch.column("doc_id").slice(i, j - i),
                    "row_key": batch.column("row_key").slice(i, j - i),
                    "n_words": pa.array(words.counts.astype(np.int64)),
                    "whole_sha256": pa.array(_hexes(*words.joined()), pa.string()),
                    "minimiser": _lists(minimiser, owner, n, pa.int64()),
                    "first": _lists((first - words.first[owner]).astype(np.int32), owner, n, pa.int32()),
                    "windows": _lists(count.astype(np.int32), owner, n, pa.int32()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return W.tidy(scan)


def _packer(window: int):
    """The packed strings of a slice's wanted super-k-mers, equal ones once, with their occurrences."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.texts_of(batch.column("text"))
            for i, j in W.slices(texts):
                words = W.scan(texts.slice(i, j - i), W.SPACED)
                raw, _ = words.joined()
                raw = raw.tobytes()
                length = words.end - words.start + 1
                filled = np.repeat(np.cumsum(words.counts > 0) - 1, words.counts)
                at = np.cumsum(length) - length - filled  # no space stands between texts
                found: dict[tuple[int, bytes], list] = {}
                docs, keys = batch.column("doc_id").slice(i, j - i).to_pylist(), batch.column("row_key").slice(i, j - i).to_pylist()
                for d, wanted in enumerate(batch.column("wanted").slice(i, j - i).to_pylist()):
                    base = int(words.first[d])
                    for x in wanted:
                        a, n = base + x["first"], x["windows"] + window - 1
                        b = a + n - 1
                        text = raw[at[a] : at[b] + length[b] - 1]
                        found.setdefault((x["minimiser"], text), []).append((docs[d], keys[d], x["first"]))
                rows = [{"minimiser": m, "packed": text, "least": min(o[0] for o in own), "most": max(o[0] for o in own), "places": [{"doc_id": o[0], "row_key": o[1], "first": o[2]} for o in own]} for (m, text), own in found.items()]
                yield pa.RecordBatch.from_pylist(rows, schema=_PACKED(batch.schema.field("doc_id").type))

    return W.tidy(pack)


def _PACKED(doc: pa.DataType) -> pa.Schema:
    return pa.schema([("minimiser", pa.int64()), ("packed", pa.binary()), ("least", doc), ("most", doc), ("places", pa.list_(pa.struct([("doc_id", doc), ("row_key", pa.int64()), ("first", pa.int32())])))])


def window_ranks(strings: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the packed strings, exactly: its string, its place in it, and a number that equal windows share."""
    words = W.scan(strings.cast(pa.string()), W.SPACED)
    lengths = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int32)
    kept = words.data[words.is_word].tobytes()
    alone = pa.Array.from_buffers(pa.binary(), len(words.start), [None, pa.py_buffer(lengths.tobytes()), pa.py_buffer(kept)])
    rank, width = pc.dictionary_encode(alone).indices.to_numpy().astype(np.int64), 1

    def joined(by: int) -> np.ndarray:
        a, b = rank[: len(rank) - by], rank[by:]
        return np.unique(a * (int(rank.max()) + 1) + b, return_inverse=True)[1] if len(a) else np.zeros(0, np.int64)

    while 2 * width <= window:
        rank, width = joined(width), 2 * width
    if width < window:
        rank = joined(window - width)
    at = words.window_starts(window)
    owner = np.searchsorted(words.first, at, side="right") - 1
    return owner, at - words.first[owner], rank[at]


def _bucket(window: int):
    def answer(rows: pa.Table) -> pa.RecordBatch:
        names, codes = np.unique(np.concatenate([rows.column(c).to_numpy() for c in ("least", "most")]), return_inverse=True)
        least, most = codes[: len(rows)], codes[len(rows) :]
        owner, place, rank = window_ranks(rows.column("packed").combine_chunks(), window)
        first = np.full(int(rank.max()) + 1 if len(rank) else 0, np.iinfo(np.int64).max)
        np.minimum.at(first, rank, least[owner])
        first = first[rank]
        hit = first < most[owner]
        owner, place, first = owner[hit], place[hit], first[hit]
        follows = np.concatenate([[False], (owner[1:] == owner[:-1]) & (place[1:] == place[:-1] + 1) & (first[1:] == first[:-1])]) if len(owner) else np.zeros(0, bool)
        begin = np.flatnonzero(~follows)
        count = np.diff(np.append(begin, len(owner)))
        return pa.RecordBatch.from_arrays([rows.column("rid").combine_chunks().take(pa.array(owner[begin])), pa.array(place[begin].astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(names[first[begin]], rows.schema.field("least").type)], ["rid", "offset", "windows", "smallest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("packed").nbytes
            if size > BUCKET_BYTES:
                rows = pa.Table.from_batches(held)
                buckets = rows.column("minimiser").to_numpy()
                cut = int(np.searchsorted(buckets, buckets[-1]))  # the last bucket may go on
                if cut:
                    yield from _parts(rows.slice(0, cut), answer)
                    held = rows.slice(cut).to_batches()
                size = sum(b.column("packed").nbytes for b in held)
        if held:
            yield from _parts(pa.Table.from_batches(held), answer)

    return W.tidy(run)


def _parts(rows: pa.Table, answer) -> Iterator[pa.RecordBatch]:
    """Whole buckets of about BUCKET_BYTES at a time."""
    buckets = rows.column("minimiser").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    bytes_before = np.concatenate([[0], np.cumsum(pc.binary_length(rows.column("packed")).to_numpy())])
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        to = max(at + 1, int(np.searchsorted(bytes_before[starts], bytes_before[begin] + BUCKET_BYTES)))
        end = int(starts[to]) if to < len(starts) else len(rows)
        yield answer(rows.slice(begin, end - begin))
        at = to


def _window_hashes(window: int):
    """Of each string: the hashes of its windows, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("packed").cast(pa.string())
            for i, j in W.slices(texts):
                words = W.scan(texts.slice(i, j - i), W.SPACED)
                at = words.window_starts(window)
                hashes = W.hash_windows(W.hash_words(words), window, at).view(np.int64)
                owner = np.searchsorted(words.first, at, side="right") - 1
                columns = {c: batch.column(c).slice(i, j - i) for c in ("minimiser", "string", "least", "most")}
                columns["hashes"] = _lists(hashes, owner, words.n_texts, pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return W.tidy(run)


def _cut_out(window: int, single: bool):
    """The words of each run of the wanted windows of a string, or of each wanted window, with its place (offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.schema.field("least").type
            shape = pa.schema([("minimiser", pa.int64()), ("string", pa.int64()), ("offset", pa.int32()), ("part", pa.binary()), ("least", doc), ("most", doc)])
            owner, offsets, parts, size = [], [], [], 0

            def made() -> pa.RecordBatch:
                of = lambda c: batch.column(c).take(pa.array(owner, pa.int64()))  # noqa: B023, E731
                return pa.RecordBatch.from_arrays([of("minimiser"), of("string"), pa.array(offsets, pa.int32()), pa.array(parts, pa.binary()), of("least"), of("most")], schema=shape)  # noqa: B023

            for k, (packed, every) in enumerate(zip(batch.column("packed"), batch.column("wanted"), strict=True)):
                words, wanted = packed.as_py().split(b" "), sorted(set(every.as_py()))
                begin = [i for i, w in enumerate(wanted) if single or not i or wanted[i - 1] != w - 1]
                for a, b in zip(begin, [*begin[1:], len(wanted)], strict=True):
                    owner.append(k)
                    offsets.append(wanted[a])
                    parts.append(b" ".join(words[wanted[a] : wanted[b - 1] + window]))
                    size += len(parts[-1])
                    if size > W.SLICE_BYTES:
                        yield made()
                        owner, offsets, parts, size = [], [], [], 0
            if owner:
                yield made()

    return W.tidy(run)


def _heavy_answers(strings: DataFrame, kind: str, window: int) -> DataFrame:
    """What the buckets would answer for the strings (rid, minimiser, packed, least, most) of heavy minimisers."""
    own, shape = ["minimiser", "string"], f"minimiser long, string long, offset int, part binary, least {kind}, most {kind}"
    one = (F.min("least").alias("least"), F.max("most").alias("most"))
    keyed = strings.withColumn("string", F.xxhash64("packed"))
    merged = scratch.keep(keyed.groupBy(*own, "packed").agg(*one), "sub-merged")
    windows = scratch.keep(merged.mapInArrow(_window_hashes(window), f"minimiser long, string long, least {kind}, most {kind}, hashes array<long>").select(*own, "least", "most", F.posexplode("hashes").alias("at", "hash")), "sub-windows")
    shared = scratch.keep(windows.groupBy("hash").agg(*one).where("least < most").select("hash"), "sub-shared-windows")
    wanted = windows.join(shared, "hash").groupBy(*own).agg(F.collect_set("at").alias("wanted"))
    runs = scratch.keep(merged.join(wanted, own).mapInArrow(_cut_out(window, False), shape).withColumn("remainder", F.xxhash64("part")), "sub-runs")
    remainders = runs.groupBy("minimiser", "remainder", "part").agg(*one)
    every = F.sequence(F.lit(0), F.length(F.regexp_replace(F.col("part").cast("string"), "[^ ]", "")) + 1 - window)
    singles = scratch.keep(remainders.select("minimiser", F.col("remainder").alias("string"), F.col("part").alias("packed"), "least", "most", every.alias("wanted")).mapInArrow(_cut_out(window, True), shape), "sub-singles")
    first = singles.groupBy("part").agg(F.min("least").alias("smallest"))
    judged = singles.join(first, "part").where("smallest < most").select("minimiser", F.col("string").alias("remainder"), "offset", "smallest")
    alike = Window.partitionBy("minimiser", "remainder", "smallest").orderBy("offset")  # the windows of one remainder
    gap = judged.withColumn("run", F.col("offset") - F.row_number().over(alike))
    judged = scratch.keep(gap.groupBy("minimiser", "remainder", "smallest", "run").agg(F.min("offset").alias("inner"), F.count(F.lit(1)).cast("int").alias("windows")).drop("run"), "sub-judged")
    placed = runs.select(*own, "remainder", "offset").join(judged, ["minimiser", "remainder"]).select(*own, (F.col("offset") + F.col("inner")).alias("offset"), "windows", "smallest")
    return keyed.select("rid", *own).join(placed, own).select("rid", "offset", "windows", "smallest")


def _removed(words: W.Words, ranges: list[list[dict]]) -> np.ndarray:
    starts = np.array([words.first[d] + x["from"] for d, own in enumerate(ranges) for x in own], dtype=np.int64)
    lengths = np.array([x["to"] - x["from"] for own in ranges for x in own], dtype=np.int64)
    return W.cover(len(words.start), starts, lengths)


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = W.texts_of(batch.column("text"))
        for i, j in W.slices(texts):
            words = W.scan(texts.slice(i, j - i), W.SPACED)
            gone = _removed(words, batch.column("ranges").slice(i, j - i).to_pylist())
            n = np.bincount(words.text_of_word()[gone], minlength=words.n_texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("row_key").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(_hexes(*words.joined(~gone)), pa.string())], ["doc_id", "row_key", "n_removed", "sha256"])


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = W.texts_of(batch.column("text"))
        for i, j in W.slices(texts):
            words = W.scan(texts.slice(i, j - i), W.SPACED)
            gone = _removed(words, batch.column("ranges").slice(i, j - i).to_pylist())
            data, offsets = words.joined(~gone)
            raw = data.tobytes()
            out = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("row_key").slice(i, j - i), pa.array(out, pa.string())], ["doc_id", "row_key", "new_text"])


def find(docs: DataFrame, window: int = WINDOW, run: int = RUN, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Of all rows: doc_id, row_key (a hash of the text), n_words, whole_sha256. Of the documents that lose words: doc_id,
    row_key, text, ranges of words to remove as [from, to)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("text"))
    features = scratch.keep(keyed.mapInArrow(_features(window, run), f"doc_id {kind}, row_key long, n_words long, whole_sha256 string, minimiser array<long>, first array<int>, windows array<int>"), "sub-features")

    owned = features.where("doc_id is not null")
    shared = scratch.keep(owned.select("doc_id", F.explode("minimiser").alias("minimiser")).groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("minimiser"), "sub-shared")
    spans = owned.select("doc_id", "row_key", F.inline(F.arrays_zip("minimiser", "first", "windows")))
    wanted = spans.join(shared, "minimiser").groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("minimiser", "first", "windows")).alias("wanted"))
    some = scratch.keep(keyed.join(wanted, ["doc_id", "row_key"]).dropDuplicates(["doc_id", "row_key"]), "sub-some")

    packed = some.mapInArrow(_packer(window), f"minimiser long, packed binary, least {kind}, most {kind}, places array<struct<doc_id: {kind}, row_key: long, first: int>>")
    strings = scratch.keep(packed.withColumn("rid", F.monotonically_increasing_id()), "sub-strings")
    bare = strings.select("rid", "minimiser", "packed", "least", "most")
    crowded = scratch.keep(strings.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select("minimiser"), "sub-crowded")
    dealt = bare.join(crowded, "minimiser", "left_anti").select("rid", "minimiser", "packed", "least", "most").repartition("minimiser").sortWithinPartitions("minimiser")
    shape = f"rid long, offset int, windows int, smallest {kind}"
    answers = scratch.keep(dealt.mapInArrow(_bucket(window), shape), "sub-answers")
    if not crowded.isEmpty():
        answers = answers.unionByName(scratch.keep(_heavy_answers(bare.join(crowded, "minimiser", "left_semi"), kind, window), "sub-answers"))

    hits = answers.join(strings.select("rid", "places"), "rid").select("offset", "windows", "smallest", F.inline("places")).where(F.col("smallest") < F.col("doc_id"))
    ranges = hits.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct((F.col("first") + F.col("offset")).alias("from"), (F.col("first") + F.col("offset") + F.col("windows") + window - 1).alias("to"))).alias("ranges"))
    return features.select("doc_id", "row_key", "n_words", "whole_sha256"), some.select("doc_id", "row_key", "text").join(ranges, ["doc_id", "row_key"])


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words taken out; docs' columns, n_chars (if any) following the text. A text that loses words keeps
    the others, joined by one space; a document that loses all its words goes; any other text stays as it is."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    _, losing = find(docs, window)
    cut = scratch.keep(losing.mapInArrow(W.tidy(_cutter), f"doc_id {kind}, row_key long, new_text string"), "sub-cut")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("row_key"))
    joined = rows.join(cut, ["doc_id", "row_key"], "left").where("new_text is null or new_text <> ''")
    text = F.coalesce("new_text", "row.text")
    values = {"text": text, "n_chars": F.when(F.col("new_text").isNull(), F.col("row.n_chars")).otherwise(F.length("new_text")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return joined.select(*(values[c].alias(c) if values.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, losing = find(docs)
    removed = losing.mapInArrow(W.tidy(_digester), f"doc_id {kind}, row_key long, n_removed long, sha256 string")
    joined = rows.join(removed, ["doc_id", "row_key"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha256", "whole_sha256").alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT r, doc_id, i, array_to_string(ws[i : i + 49], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)
), m AS (
  SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS dup FROM w
), x AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM m WHERE dup
), k AS (
  SELECT d.r, ws[j] AS word, j FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS j FROM d) d ANTI JOIN x USING (r, j)
), s AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM k GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""
