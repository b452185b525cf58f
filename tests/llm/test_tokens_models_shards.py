"""Encoding, token shards, sharding and the two classifiers."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import language_id, quality_classifier, scratch, sentencepiece_bpe, sharding, token_shards

ODD = ["", None, " ", "  a\tb\n\n ▁x▁▁ y 中文 🙂 \x00 end  ", "ab" * 40_000, "Straße", "the cat sat on the mat. " * 50]


@pytest.fixture(scope="module")
def pieces():
    with open(sentencepiece_bpe.MODEL, "rb") as f:
        return sentencepiece_bpe.Pieces(f.read())


def plain_merge(pieces, chunk, dropout, key):
    """The agenda as it is told: of all candidates not yet skipped, the best score, then the leftmost."""
    symbols, skipped = [(i, c) for i, c in enumerate(chunk)], set()
    while True:
        best = None
        for k in range(len(symbols) - 1):
            rank = pieces.ranks.get(symbols[k][1] + symbols[k + 1][1])
            if rank is not None and (symbols[k][0], symbols[k + 1][0], rank, symbols[k][1]) not in skipped and (best is None or rank < best[0]):
                best = (rank, k)
        if best is None:
            return [x for _, s in symbols for x in pieces.spell(s)]
        rank, k = best
        if dropout and sentencepiece_bpe._skips(key, symbols[k][0], rank, int(dropout * 2**64)):
            skipped.add((symbols[k][0], symbols[k + 1][0], rank, symbols[k][1]))
        else:
            symbols[k : k + 2] = [(symbols[k][0], symbols[k][1] + symbols[k + 1][1])]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_merges(pieces, dropout):
    rng = random.Random(3)
    chunks = ["".join(rng.choice("▁atheniosr中é") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    keys = np.array([rng.getrandbits(64) for _ in chunks], dtype=np.uint64)
    many = [np.frombuffer(b, np.uint16).tolist() for b in pieces.merge_many(chunks, dropout, keys)]
    for c, k, found in zip(chunks, keys.tolist(), many, strict=True):
        assert found == pieces.merge(c, dropout, k) == plain_merge(pieces, c, dropout, k)
        assert pieces._merge_long(list(c), int(dropout * 2**64), k) == pieces._merge_short(list(c), int(dropout * 2**64), k)


def test_encoding_without_dropout_is_the_librarys(pieces):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    encoder = sentencepiece_bpe.Encoder(pieces, 0.0)
    for text in ["Hello world", "  two  spaces ", "a\nb", "über straße 12345", "x" * 500, ""]:
        assert encoder.encode(text).tolist() == library.encode(text)


def test_every_occurrence_is_merged_for_itself(pieces, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "PART", 700, raising=False)
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", 60)
    rng = random.Random(4)
    words = ["international", "segmentation", "the", "🙂é", "x▁y", "unbelievable", "n" * 60] + ["".join(rng.choice("athenios") for _ in range(9)) for _ in range(90)]
    texts = ["", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(12)), "international " * 3000]
    encoder = sentencepiece_bpe.Encoder(pieces, 0.1, seed=5)
    for _ in range(2):
        for doc, (text, found) in enumerate(zip(texts, encoder.encode_many(texts, list(range(len(texts)))), strict=True)):
            start = int(sentencepiece_bpe.W.mix(np.array([(doc * 0x9E3779B97F4A7C15 + 5) % 2**64], dtype=np.uint64))[0])
            keys = sentencepiece_bpe.W.mix(np.array([(start + k) % 2**64 for k in range(len(text) + 1)], dtype=np.uint64)).tolist()
            want = [plain_merge(pieces, c, 0.1, k) if c else [pieces.byte_ids[b] for b in "▁".encode()] for c, k in zip(pieces.chunks(text) if text else [], keys)]
            assert found.tolist() == [x for ids in want for x in ids], doc
    kinds = {tuple(encoder.encode("international", doc).tolist()) for doc in range(2000)}
    assert len(kinds) > 4  # the whole word and many that skip a merge


def test_encoding_is_lossless_varied_and_repeatable(spark, pieces):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (6, ODD[6], "x")], "doc_id long, text string, ids string")
    once = sentencepiece_bpe.encode(docs).select("doc_id", "ids", F.col("_encoded").alias("e")).collect()
    again = sentencepiece_bpe.encode(docs.repartition(3)).select("doc_id", F.col("_encoded").alias("e")).collect()
    assert all(r.e.lossless for r in once)
    bytes_of = lambda rows: sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.e.ids)) for r in rows)
    assert bytes_of(once) == bytes_of(again)
    other = sentencepiece_bpe.Encoder(pieces, 0.1, seed=8).encode(ODD[6], 6)
    assert bytes(next(r for r in once if r.doc_id == 6).e.ids) != other.tobytes()
    assert pieces.decode(other.tolist()).decode() == ODD[6]
    assert sentencepiece_bpe.encode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation(n):
    slots = token_shards.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert token_shards.permute(slots, n, backwards=True).tolist() == list(range(n))
    assert n < 100 or (token_shards.permute(np.arange(n), n, key=5) != slots).any()


def test_token_shards(spark):
    import base64

    import tiktoken

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "ü", "12"]) for _ in range(rng.randint(0, 300))) for _ in range(200)] + ODD
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, slot int").repartition(5)
    out = scratch.folder(spark, "test-shards")
    rows = token_shards.write_shards(docs, out, length=64, per_shard=100).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == sorted(r.sequence for r in rows) == list(range(n))
    by_slot = list(token_shards.read_sequences(out))
    assert len(by_slot) == n and all((a == b).all() for a, b in zip(token_shards.read_sequences(out, 137), by_slot[137:], strict=True))
    ids = []
    for r in sorted(rows, key=lambda r: r.sequence):
        assert r.shard == r.slot // 100 and r.byte_offset == r.slot % 100 * 128
        ids += by_slot[r.slot][: r.n_tokens].tolist()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_shards.VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("v", pat_str=token_shards.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found, own = [], []
    for i in ids:
        if i == token_shards.END:
            found.append(encoding.decode(own))
            own = []
        else:
            own.append(i)
    assert not own and sorted(found) == sorted(t or "" for t in texts)
    assert token_shards.write_shards(docs.limit(0), scratch.folder(spark, "test-none")).count() == 0


def test_balanced_shards(spark):
    rng = random.Random(9)
    texts = ["hot"] * 260 + [f"pair{i // 2}" for i in range(80)] + [f"five{i // 5}" for i in range(100)] + [f"one{i}" for i in range(170)] + [None, None, "", ""]
    rng.shuffle(texts)
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, pos int")
    keyed = rows.select("doc_id", "pos", F.unhex(F.sha2("text", 256)).alias("grp"), F.coalesce("text", F.lit("")).alias("t"))
    done = sharding.assign(keyed, shards=7).collect()
    assert len(done) == len(texts)
    sizes = [sum(r.shard == s for r in done) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r.slot for r in done if r.shard == s) == list(range(sizes[s]))
    spread = {}
    for r in done:
        spread.setdefault(r.t, set()).add(r.shard)
    assert len(spread["hot"]) <= 5  # of 7; its 260 rows fill three shards
    assert sum(len(v) > 1 for k, v in spread.items() if k[:4] in ("pair", "five")) <= 6  # of 60; nearly all at the start
    assert sharding.assign(keyed.limit(0), shards=7).count() == 0
    few = sharding.assign(keyed.limit(3), shards=7).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]


def test_sharding_of_an_edge_table(spark):
    """Overlapping communities by pairs and by a column: cut links are counted right, and few are left."""
    rng = random.Random(8)
    rows = [(i, f"h{i // 20}" if i % 3 else None, float(i)) for i in range(240)]
    edges = [(i, j) for c in range(12) for i, j in (rng.sample(range(c * 20, c * 20 + 20), 2) for _ in range(60))] + [(rng.randrange(240), rng.randrange(240)) for _ in range(20)] + [(5, 5), (None, 3), (7, 9999)]
    df = spark.createDataFrame(rows, "doc_id long, host string, slot_ double").repartition(3)
    done = {r.doc_id: r for r in sharding.assign(df, 6, ("host",), spark.createDataFrame(edges, "a long, b long")).collect()}
    sizes = [sum(r.shard == s for r in done.values()) for s in range(6)]
    assert len(done) == 240 and max(sizes) - min(sizes) <= 1
    pairs = {(min(e), max(e)) for e in edges if None not in e and e[0] != e[1] and max(e) < 9999}
    groups = [list(p) for p in pairs] + [[i for i, h, _ in rows if h == f"h{k}"] for k in range(12)]
    for i, r in done.items():
        mates = [j for g in groups if i in g for j in g if j != i]
        assert (r.n_links, r.n_cut) == (len(mates), sum(done[j].shard != r.shard for j in mates))
    assert sum(r.n_cut for r in done.values()) < 0.35 * sum(r.n_links for r in done.values())  # 5 of 6 at the start


def quality_rows(n=260):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["river", "house", "walks", "the", "of", "green"]) + rng.choice(["", "", ".", ","]) for _ in range(60))
    bad = lambda: rng.choice([" ".join(w.upper() + "!!" for w in good().split()), " ".join(w + "$$$" for w in good().split()), " ".join([rng.choice(["a", "b"])] * 60)])
    return [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(n)]


def test_quality_classifier(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(9000, None, 1.0), (9001, "", 1.0), (None, "x", 1.0), (1, rows[1][1], 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (9000, None, 0), (9001, 0, 0), (9001, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs.select("doc_id", "text"), labels)
    scored = quality_classifier.score(docs, spark.sparkContext.broadcast(model)).collect()
    assert len(scored) == len(rows) + 4 and all(0 <= r.score <= 1 for r in scored)
    held = {i: q for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [(r.score >= 0.7) == bool(held[r.doc_id]) for r in scored if r.doc_id in held]
    assert len(right) > 40 and np.mean(right) > 0.9
    assert model.temperature >= 1
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.5 < kept.count() / len(rows) < 0.8


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.fit(docs, none)
    assert [round(r.score, 6) for r in quality_classifier.score(docs, spark.sparkContext.broadcast(model)).collect()] == [0.5, 0.5]
    assert quality_classifier.keep_good(docs.limit(0), none).count() == 0


def plain_grams(text):
    s = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else "_") for c in text)
    while "__" in s:
        s = s.replace("__", "_")
    s = "_" + s.strip("_") + "_" if s.strip("_") else ""
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            if (g := s[i : i + n]).strip("_") and "_" not in g[1:-1]:
                counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum((1 if c == "_" else ord(c)) << (21 * k) for k, c in enumerate(g))
    return {code(g): n for g, n in counts.items()}


def test_language_profiles(spark):
    rng = random.Random(6)
    words = {"en": ["the", "and", "Of", "that's", "with"], "de": ["der", "und", "für", "nicht", "Straße"], "ру": ["и", "что", "это", "Не"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 60))), lang, 0.5) for i in range(120) for lang in [rng.choice(sorted(words))]]
    rows += [(900, None, "en", 0.0), (901, "123 !!", "en", 0.0), (902, "the and", None, 0.0), (None, "und der", "de", 0.0), (903, "日本語 テキスト", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    profiles = language_id.fit(docs)
    totals = {}
    for _, text, lang, _ in rows:
        if text is not None and lang is not None:
            for g, n in plain_grams(text).items():
                totals.setdefault(lang, {})[g] = totals.setdefault(lang, {}).get(g, 0) + n
    want = {lang: sorted(c, key=lambda g: (-c[g], g))[: language_id.PROFILE] for lang, c in totals.items()}
    assert {lang: codes.tolist() for lang, codes in profiles} == want
    found = {r.doc_id: r for r in language_id.predict(docs, profiles).collect()}
    for doc, text, lang, _ in rows:
        own = plain_grams(text or "")
        top = sorted(own, key=lambda g: (-own[g], g))[: language_id.DOCUMENT]
        far = {name: sum(abs(want[name].index(g) - k) if g in want[name] else language_id.PROFILE for k, g in enumerate(top)) for name in want}
        best = min(sorted(far), key=far.get)
        assert found[doc].lang_pred == (best if top else "und"), doc
        assert 0 <= found[doc].score <= 1
    assert found[900].score == found[901].score == 0
    assert language_id.fit(docs.limit(0)) == []
    assert {r.lang_pred for r in language_id.predict(docs, []).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), profiles).count() == 0
