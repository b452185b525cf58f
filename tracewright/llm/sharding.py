"""Balanced label propagation: documents into shards, linked ones together, sizes even.

Documents are linked by what they share (a text, a host, a cluster: any columns) and by an edge table of pairs. A link of many is one
group, a pair is a group of two, so no pairs are made. Every document starts in the shard that its place in a fixed order gives, so the
counts are even at once. Then, in rounds, linked documents are joined with the shards of their neighbours: each group counts its
members by shard and points to its fullest shard with room, and a document moves where its groups together have more neighbours for it
than its own shard, as far as that shard's quota goes. Documents without a link give way and fill what is left; where fewer than
``SLACK`` of all are without, quotas are wider by the difference meanwhile, and in the end the documents with the fewest links inside
leave a shard that is too full. Rounds go on until nobody wants to move, or the number of cut links has not fallen for ``PATIENCE``
rounds; the best round counts. The law is ``rows``: shard counts differ by one at most, exactly.

State is a row for each linked document, and a count for each (group, shard). The driver sees sums for each shard and turn only.
Places in a shard come from range partitions with per-partition offsets, so no task holds a group or a shard.

Nulls: a null text has size 16 and no link; a null link column links nothing; a null doc_id sorts first and is in no edge. Repeated
rows are rows of their own (of equal texts, so linked); an edge of a repeated doc_id links all its rows. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

SHARDS, PATIENCE, SLACK = 40, 4, 0.1
LEVELS, JITTERS, PARTS = 16, 64, 1024


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _by_shard(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _accepted(wishes: DataFrame, room: list[int]) -> tuple[DataFrame, set[int], set[int]]:
    """The wishes (node, target, turn, part) that fit: turn by turn up to each shard's room, of the turn that fills it some parts. And
    the shards that were asked, and that took any."""
    shards = len(room)
    full: dict[int, tuple[int, int]] = {}  # the turn that fills a shard, and what is left for it
    asked = wishes.groupBy("target", "turn").count().orderBy("target", "turn").collect()  # at most shards * LEVELS * JITTERS rows
    room = list(room)
    for t, turn, n in asked:
        if t not in full:
            if n <= room[t]:
                room[t] -= n
            else:
                full[t] = (turn, room[t])
    by = lambda values: F.element_at(_by_shard(values), F.col("target") + 1)
    last = by([full[s][0] if s in full else LEVELS * JITTERS for s in range(shards)])
    upto = [0] * shards
    if full:
        left = {t: n for t, (_, n) in full.items()}
        for t, part, n in wishes.where(F.col("turn") == last).groupBy("target", "part").count().orderBy("target", "part").collect():  # shards * PARTS
            if left.get(t, -1) >= n:
                left[t] -= n
                upto[t] = part + 1
            else:
                left[t] = -1
    moves = wishes.where((F.col("turn") < last) | ((F.col("turn") == last) & (F.col("part") < by(upto)))).select("node", "target")
    took = {t for t, turn, _ in asked if t not in full or turn < full[t][0] or upto[t]}
    return moves, {t for t, _, _ in asked}, took


def propagate(links: DataFrame, start: DataFrame, quotas: list[int], patience: int = PATIENCE) -> DataFrame:
    """links: node, grp. start: node, shard, within the quotas. Returns node, shard, still within the quotas, with fewer links cut."""
    closed: set[int] = set()
    labels = best = scratch.keep(start, "shard-labels")
    fewest, waited = None, 0  # of cut links, a group's members being linked with each other
    while True:
        at = links.join(labels, "node")
        cells = scratch.keep(at.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")), "shard-cells")
        rows = F.col("n").cast("double")
        cut = cells.groupBy("grp").agg((F.sum(rows) * F.sum(rows) - F.sum(rows * rows)).alias("cut")).agg(F.coalesce(F.sum("cut"), F.lit(0.0))).first()[0]
        if fewest is None or cut < fewest:
            fewest, best, waited = cut, labels, 0
        else:
            waited += 1
        if not cut or waited > patience:
            return best
        load = {r[0]: r[1] for r in labels.groupBy("shard").count().collect()}
        room = [0 if s in closed else q - load.get(s, 0) for s, q in enumerate(quotas)]
        open_ = cells.where(F.element_at(_by_shard(room), F.col("shard") + 1) > 0)
        targets = open_.groupBy("grp").agg(F.max(F.struct("n", F.xxhash64("grp", "shard").alias("tie"), F.col("shard").alias("target"))).alias("to"))
        known = scratch.keep(cells.join(targets.select("grp", "to.target", F.col("to.n").alias("there")), "grp", "left"), "shard-targets")
        votes = at.join(known, ["grp", "shard"]).groupBy("node", "shard", "target").agg(F.sum("there").alias("there"), F.sum(F.col("n") - 1).alias("here"), F.max(F.struct("there", F.xxhash64("grp").alias("lead"))).alias("lead"))
        choice = F.max(F.when(F.col("target") != F.col("shard"), F.struct("there", F.col("lead.lead").alias("lead"), "target"))).alias("to")
        wants = votes.groupBy("node", "shard").agg(F.sum("here").alias("here"), choice).where("to.there > here")
        level = F.greatest(F.lit(0), LEVELS - 1 - F.floor(F.log2(F.col("to.there").cast("double")))).cast("int")
        turn = level * JITTERS + F.pmod(F.col("to.lead"), F.lit(JITTERS))
        wishes = scratch.keep(wants.select("node", "to.target", turn.cast("int").alias("turn"), F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int").alias("part")), "shard-wishes")
        moves, asked, took = _accepted(wishes, room)
        if not asked:
            return best
        closed |= asked - took
        if took:
            labels = scratch.keep(labels.join(moves, "node", "left").select("node", F.coalesce("target", "shard").alias("shard")), "shard-labels")


def _links(placed: DataFrame, groups: tuple[str, ...], edges: DataFrame | None) -> DataFrame:
    """node, grp: for each group of two rows or more, its members."""
    spelled = lambda kind, value: F.concat(F.lit(kind.encode() + b":"), value.cast("binary"))
    found = None
    for g in groups:
        own = placed.where(F.col(f"row.`{g}`").isNotNull()).select(F.col("pos").alias("node"), spelled(g, F.col(f"row.`{g}`")).alias("grp"))
        found = own if found is None else found.unionByName(own)
    if edges is not None:
        pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("grp", spelled("edge", F.concat_ws(":", "a", "b")))
        ends = pairs.select(F.col("a").alias("doc_id"), "grp").unionByName(pairs.select(F.col("b").alias("doc_id"), "grp"))
        own = placed.select("pos", F.col("row.doc_id").alias("doc_id")).join(ends, "doc_id").select(F.col("pos").alias("node"), "grp")
        found = own if found is None else found.unionByName(own)
    shared = scratch.keep(found.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp"), "shard-shared")
    return found.join(shared, "grp").select("node", "grp")


def assign(rows: DataFrame, shards: int = SHARDS, groups: tuple[str, ...] = ("grp",), edges: DataFrame | None = None, patience: int = PATIENCE) -> DataFrame:
    """rows: doc_id, columns of `groups` (equal values link rows) and columns to carry. edges: a, b, pairs of doc_ids. Returns the rows without
    the groups' columns, with shard, slot (gapless from 0 in a shard), n_links and n_cut: the row's links, and those to other shards."""
    carried = [c for c in rows.columns if c not in groups]
    named = rows.select("doc_id", F.struct(*rows.columns).alias("row")).withColumn("tie", F.xxhash64("row"))
    placed = scratch.keep(scratch.numbered(named, ["doc_id", "tie"], "pos", "shard-order"), "shard-placed")
    n = placed.count()
    quotas = _quotas(n, shards)
    links = scratch.keep(_links(placed, groups, edges), "shard-links")
    start = scratch.keep(links.select("node").distinct().withColumn("shard", F.pmod("node", F.lit(shards)).cast("int")), "shard-start")
    spare = (n - start.count()) // shards
    slack = [max(0, int(SLACK * q) - spare) for q in quotas]
    labels = propagate(links, start, [q + more for q, more in zip(quotas, slack, strict=True)], patience)
    if any(slack):
        labels = _within(links, labels, quotas)

    both = scratch.keep(placed.select("row", "pos").join(labels.withColumnRenamed("node", "pos"), "pos", "left"), "shard-linked")
    load = {r[0]: r[1] for r in both.where("shard is not null").groupBy("shard").count().collect()}
    free, upto = [q - load.get(s, 0) for s, q in enumerate(quotas)], []
    for f in free:
        upto.append((upto[-1] if upto else 0) + f)
    alone = scratch.numbered(both.where("shard is null").drop("shard"), ["pos"], "single", "shard-single")
    filled = alone.select("row", "pos", sum(((F.col("single") >= u).cast("int") for u in upto), F.lit(0)).alias("shard"))
    ordered = scratch.keep(scratch.numbered(both.where("shard is not null").select(filled.columns).unionByName(filled), ["shard", "pos"], "at", "shard-slots"), "shard-slots")
    counted = _own_links(links, ordered.select(F.col("pos").alias("node"), "shard"))
    first = [sum(quotas[:s]) for s in range(shards)]
    none = F.lit(0).cast("long")
    out = ordered.join(counted.select(F.col("node").alias("pos"), "n_links", "n_cut"), "pos", "left")
    return out.select(*(F.col(f"row.`{c}`") for c in carried), "shard", (F.col("at") - F.element_at(_by_shard(first), F.col("shard") + 1)).alias("slot"), F.coalesce("n_links", none).alias("n_links"), F.coalesce("n_cut", none).alias("n_cut"))


def _own_links(links: DataFrame, labels: DataFrame) -> DataFrame:
    """node, shard, n_links, n_cut: of each linked row its links, and those to other shards."""
    at = scratch.keep(links.join(labels, "node"), "shard-at")
    cells = at.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
    sizes = scratch.keep(cells.join(cells.groupBy("grp").agg(F.sum("n").alias("size")), "grp"), "shard-cells")
    return at.join(sizes, ["grp", "shard"]).groupBy("node", "shard").agg(F.sum(F.col("size") - 1).alias("n_links"), F.sum(F.col("size") - F.col("n")).alias("n_cut"))


def _within(links: DataFrame, labels: DataFrame, quotas: list[int]) -> DataFrame:
    """The labels but for what is beyond a shard's quota: of each shard the rows with the fewest links inside it lose theirs."""
    ranked = scratch.numbered(_own_links(links, labels).withColumn("few", F.col("n_cut") - F.col("n_links")), ["shard", "few", "node"], "at", "shard-ranked")
    load = {r[0]: r[1] for r in labels.groupBy("shard").count().collect()}
    first = [sum(load.get(k, 0) for k in range(s)) for s in range(len(quotas))]
    at = lambda values: F.element_at(_by_shard(values), F.col("shard") + 1)
    return scratch.keep(ranked.where(F.col("at") - at(first) < at(quotas)).select("node", "shard"), "shard-labels")


def op3_balanced_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("grp"))
    done = assign(rows)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "n_links", "n_cut")
