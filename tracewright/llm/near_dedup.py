"""MinHash near-duplicates: circulant signatures, banding, exact verification, components.

A document's set is its distinct ``shingle``-word shingles (A-Z lower-cased); with fewer words the whole sequence is one
shingle; without words the set is empty and linked with nothing. Two documents are linked when the Jaccard similarity of
their full sets is at least ``percent`` / 100.

1. One scan of the texts gives each document its set's size, a key of the set, and ``BANDS`` band keys. Signatures are
   circulant: a first permutation places every shingle in [0, SPACE), a second one is a fixed random permutation of
   SPACE, and coordinate k is the shingle with the least value of the second, shifted by k. So the values of one shingle for all
   coordinates are consecutive entries of one table. Shingles of one place are told apart by their whole hash, so sets far larger
   than SPACE still have signatures of their own. A pair at similarity 0.8 shares a band with probability 1 - 1.4e-7.
2. Documents with equal sets are one class. Classes are compared only if they share a band key (a bucket), and exactly, by their full sets.
   First every member of a bucket with the bucket's head: one comparison a member, whatever the size of the bucket.
3. Where members of a bucket are then not all connected, those outside its largest part are compared with all others of the bucket:
   blocks of ``BLOCK`` sets by matrix products over the shingles that two of them have. A pair of blocks is one unit of work, so
   no task holds a bucket; pairs are never rows. Buckets of equal members are compared once.
4. Components of the links, with the smallest doc_id of each.

Nulls: a null text has an empty set; a document without a doc_id links like any other, but its id is never the smallest: the
component_id of a group without any id is null. Repeated rows fall in one class. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, scratch
from . import words as W

SHINGLE, PERCENT = 4, 80
ROWS, BANDS = 6, 52
SPACE_BITS = 20
BLOCK = 128
STAR = 512  # members of a bucket's head that one task compares with it
_table: list[np.ndarray] = []


def _coordinates() -> tuple[np.ndarray, np.ndarray]:
    """Row s: the values of place s for all coordinates, a window of the second permutation; and that permutation's inverse."""
    if not _table:
        k = ROWS * BANDS
        second = np.random.default_rng(20240229).permutation(1 << SPACE_BITS).astype(np.uint32)
        inverse = np.empty(1 << SPACE_BITS, dtype=np.int64)
        inverse[second] = np.arange(1 << SPACE_BITS)
        _table.extend([np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: k - 1]]), k), inverse])
    return _table[0], _table[1]


def signature(shingles: np.ndarray) -> np.ndarray:
    """ROWS * BANDS circulant MinHash coordinates of a sorted set of 64-bit shingle hashes: the shingles that win."""
    (table, inverse), best = _coordinates(), None
    shift = np.uint64(64 - SPACE_BITS)
    places = shingles >> shift
    for i in range(0, len(places), 2048):
        least = table[places[i : i + 2048]].min(axis=0)
        best = least if best is None else np.minimum(best, least)
    won = (inverse[best] - np.arange(len(best))) & ((1 << SPACE_BITS) - 1)
    return shingles[np.searchsorted(shingles, won.astype(np.uint64) << shift)]


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = W.mix(key ^ rows[:, r]) * np.uint64(0xD1342543DE82EF95)
    return key.view(np.int64)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    words = W.scan(texts, W.SPACED, lower=True)
    hashes = W.hash_words(words)
    at = words.window_starts(n)
    whole = W.hash_windows(hashes, n, at)
    cut = np.searchsorted(at, words.first)
    for d in range(words.n_texts):
        if cut[d + 1] > cut[d]:
            yield np.unique(whole[cut[d] : cut[d + 1]])
        elif k := int(words.first[d + 1] - words.first[d]):
            yield W.hash_windows(hashes, k, words.first[d : d + 1]) ^ np.uint64(k)
        else:
            yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes(), usedforsecurity=False).digest()


def _features(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.texts_of(batch.column("text"))
            for i, j in W.slices(texts):
                sizes, keys, bands, known = [], [], [], {}
                for own in shingle_sets(texts.slice(i, j - i), n):
                    sizes.append(len(own))
                    keys.append(key := set_key(own) if len(own) else None)
                    if key is not None and key not in known:
                        known[key] = band_keys(signature(own))
                    bands.append(known.get(key))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("row_key").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "row_key", "n_shingles", "set_key", "bands"])

    return W.tidy(run)


def _sets(n: int):
    """Sets made from texts; a text whose set is not the wanted one is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.texts_of(batch.column("text"))
            for i, j in W.slices(texts):
                wanted = batch.column("set_key").slice(i, j - i).to_pylist()
                rows, shingles = [], []
                for d, own in enumerate(shingle_sets(texts.slice(i, j - i), n)):
                    if len(own) and set_key(own) == wanted[d]:
                        rows.append(i + d)
                        shingles.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows, pa.int64())), pa.array(shingles, pa.binary())], ["node", "shingles"])

    return W.tidy(run)


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _stars(percent: int):
    """Rows in the order of head, chunk and whether they are the head's own: each member is compared with its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for h, node, raw in zip(*(batch.column(c).to_pylist() for c in ("head", "node", "shingles")), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if node == h:
                    head, base = h, own
                elif head == h and _near(base, own, percent):
                    a.append(h)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return W.tidy(run)


def linked_groups(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """Components, of two or more, of the graph of pairs with 100 * |a & b| >= percent * |a | b|.

    Intersections are counted for all pairs at once, over shingles that two sets or more have, a bounded number of
    shingles at a time."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    df = np.bincount(column)
    shared = df[column] > 1
    owner, column = owner[shared], column[shared]
    both = np.zeros((m, m), dtype=np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], (column[1:] != column[:-1]).astype(np.int64)]))
        step = min(max(256, 4_000_000 // m), int(column[-1]) + 1)
        bounds = np.searchsorted(column, np.arange(0, column[-1] + 1 + step, step))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b > a:
                part = np.zeros((m, step), dtype=np.float32)
                part[owner[a:b], column[a:b] - column[a]] = 1
                both += part @ part.T
    inside = both.astype(np.int64)
    near = 100 * inside >= percent * (sizes[:, None] + sizes[None, :] - inside)
    near[sizes == 0] = False
    label = np.arange(m)
    while True:  # least label of the neighbours, until nothing changes
        least = np.where(near, label[None, :], m).min(axis=1)
        least = np.minimum(label, least)
        least = least[least]
        if (least == label).all():
            break
        label = least
    groups: dict[int, list[int]] = {}
    for i, root in enumerate(label.tolist()):
        groups.setdefault(root, []).append(i)
    return [g for g in groups.values() if len(g) > 1]


def _verify(percent: int):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("band", "unit", "node", "shingles")), strict=True))
        for _, own in groupby(rows, key=lambda r: r[:2]):
            yield list({key: shingles for _, _, key, shingles in own}.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for members in units(batches):
            keys = [k for k, _ in members]
            for group in linked_groups([np.frombuffer(s, np.uint64) for _, s in members], percent) if len(members) > 1 else ():
                least = min(keys[i] for i in group)
                others = [keys[i] for i in group if keys[i] != least]
                a += [least] * len(others)
                b += others
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return W.tidy(run)


def _star_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """stars: head, node. The pairs that are linked, as a, b. A head of many members goes to several tasks."""
    many = scratch.keep(stars.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("chunks")).where("chunks > 1"), "near-many")
    chunks = F.coalesce("chunks", F.lit(1))
    members = stars.join(many, "head", "left").select("head", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"), "node")
    heads = stars.select("head").distinct().join(many, "head", "left").select("head", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.col("head").alias("node"))
    dealt = members.unionByName(heads).join(sets, "node").repartition("head", "chunk").sortWithinPartitions("head", "chunk", F.col("node") != F.col("head"))
    return dealt.select("head", "node", "shingles").mapInArrow(_stars(percent), "a long, b long")


def _left_open(members: DataFrame, joined: DataFrame, block: int) -> DataFrame:
    """Of buckets whose members (band, node) are not all connected: band, unit, node. A member outside the bucket's largest part meets every
    other one in some unit, a block of the former with a block of all."""
    labelled = scratch.keep(members.join(joined, "node", "left").select("band", "node", F.coalesce("component", "node").alias("part")), "near-labelled")
    parts = labelled.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    buckets = parts.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("most"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("most.n < n")
    once = scratch.keep(buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "most")).alias("b")).select("b.band", F.col("b.most.part").alias("most"), F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("b.most.n")) / block).cast("int").alias("others")), "near-open")
    rows = labelled.join(once, "band")
    place = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    unit = lambda i, j: (i.cast("long") * (1 << 31) + j).alias("unit")
    every = rows.select("band", "node", place(2, F.col("blocks")).alias("j"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"))
    outside = rows.where("part <> most").select("band", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), place(3, F.col("others")).alias("i"))
    return every.unionByName(outside).select("band", unit(F.col("i"), F.col("j")), "node").distinct()


def find_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, row_key (a hash of the text), n_shingles, set_key, component_id, part (one number for each group; null for an empty set):
    a row for each row of docs."""
    keyed = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = scratch.keep(keyed.mapInArrow(_features(shingle), f"doc_id {kind}, row_key long, n_shingles long, set_key binary, bands array<long>"), "near-features")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("one")
    classes = scratch.keep(features.where("set_key is not null").groupBy("set_key").agg(one, F.first("bands").alias("bands")).select("set_key", F.col("one.doc_id").alias("first_id"), F.col("one.row_key").alias("row_key"), "bands", F.monotonically_increasing_id().alias("node")), "near-classes")

    banded = classes.select("node", F.explode("bands").alias("band"))
    heads = scratch.keep(banded.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-heads")
    members = scratch.keep(banded.join(heads, "band").where("node <> head").select("band", "head", "node", "n"), "near-members")
    stars = scratch.keep(members.select("head", "node").distinct(), "near-stars")
    wanted = stars.select("node").unionByName(stars.select(F.col("head").alias("node"))).distinct()
    wanted = scratch.keep(wanted.join(classes.select("node", "set_key", F.col("first_id").alias("w_id"), F.col("row_key").alias("w_key")), "node"), "near-wanted")

    # Texts meet the wanted rows by a merge join at every size: they grow with the documents, so they are never broadcast.
    texts = keyed.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row_key") == F.col("w_key"))).select("node", "set_key", "text")
    sets = scratch.keep(texts.mapInArrow(_sets(shingle), "node long, shingles binary"), "near-sets")
    if sets.count() > wanted.count():  # rows that occur more than once
        sets = scratch.keep(sets.dropDuplicates(["node"]), "near-sets")
    links = scratch.keep(_star_links(stars, sets, percent), "near-links")
    joined = components.connected(links, "near-parts")
    rest = scratch.keep(_left_open(members.where("n > 2").select("band", "node"), joined, block), "near-rest")
    if not rest.isEmpty():
        dealt = rest.join(sets, "node").select("band", "unit", "node", "shingles").repartition("band", "unit").sortWithinPartitions("band", "unit")
        more = scratch.keep(dealt.mapInArrow(_verify(percent), "a long, b long"), "near-links")
        if not more.isEmpty():
            joined = components.connected(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "near-parts")

    grouped = scratch.keep(classes.select("node", "set_key", "first_id").join(joined, "node", "left").withColumn("part", F.coalesce("component", "node")), "near-grouped")
    least = grouped.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "part").select("set_key", "component_id", "part")
    found = features.select("doc_id", "row_key", "n_shingles", "set_key").join(named, "set_key", "left")
    return found.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id (in a group without ids, of the least hash of the text); docs'
    columns. Of repeated rows of one doc_id and one text, one stays. Documents without words are in no group."""
    found = scratch.keep(find_groups(docs, shingle, percent).where("set_key is not null").select("doc_id", "row_key", "component_id", "part"), "near-found")
    unnamed = scratch.keep(found.where("component_id is null").groupBy("part").agg(F.min("row_key").alias("least")), "near-unnamed")
    first = found.join(unnamed, "part", "left").withColumn("first", F.when(F.col("component_id").isNull(), F.col("row_key") == F.col("least")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))))
    first = scratch.keep(first.select(F.col("doc_id").alias("f_id"), F.col("row_key").alias("f_key"), "first"), "near-first")
    gone = first.where(~F.col("first")).select("f_id", "f_key").distinct()
    again = first.where("first").groupBy("f_id", "f_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f_id", "f_key")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("row_key") == F.col("f_key"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("row_key"))
    left = keyed.join(gone, same, "left_anti")
    if not again.isEmpty():
        repeated = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "row_key"])
        left = left.join(again, same, "left_anti").unionByName(repeated)
    return left.select("row.*")


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = find_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT l.b, r.reach FROM r JOIN l ON l.a = r.node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach) AS component_id, d.doc_id = min(reach) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""
