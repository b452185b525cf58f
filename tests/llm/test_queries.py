"""The registered queries on written tables: contract columns, folds and nulls."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracewright.llm import queries, sentencepiece_bpe

BASE = "the river walks under a green house and the old bridge of stone while rain falls on slow boats near a mill".split()
ANDERE = "der fluss geht unter dem alten haus und die straße liegt im regen bei den booten neben einer kleinen mühle".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("queries"))
    rng = random.Random(6)
    docs = []
    for i in range(240):
        words = [rng.choice(ANDERE if i % 2 else BASE) for _ in range(rng.randint(60, 120))]
        text = " ".join(w.upper() + "!!$" for w in words) if i % 3 == 0 else " ".join(words) + "."
        docs.append((i, text, "de" if i % 2 else "en", "s", len(text)))
    docs += [(i, docs[i % 7][1], "en", "s", 1) for i in range(240, 250)]
    docs += [(250, None, None, None, None), (251, "", "en", "s", 0), (252, "12 34 !?", "en", "s", 8), (None, "a text without an id " * 20, "en", "s", 1), (253, "long " * 60_000, "en", "s", 1), (3, docs[3][1], "de", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, docs[4][1][:200])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    turns = [(1, 0, "user", "Hi"), (1, 1, "assistant", "[INST] x </s>"), (2, 0, "user", None), (3, 0, "assistant", "alone"), (3, 1, "user", "b" * 50_000), (3, 2, "assistant", "c")] + [(4, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(120)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d, docs, turns


def number(doc):
    return -1 if doc is None else doc


def held(doc, n, rest):
    return doc is not None and zlib.crc32(str(doc).encode()) % n == rest


def test_rules(spark, tables):
    d, docs, _ = tables
    rows = queries.QUERIES["op1_quality_rules"](spark, d)
    assert rows.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = {r.doc_id: r for r in rows.collect()}
    assert len(found) == len({x[0] for x in docs}) and found[250].n_words == 0 and found[250].base_failed and not found[250].kept
    assert found[253].n_words == 60_000 and found[253].n_repeat_words == 60_000 and found[253].base_failed
    assert found[0].n_symbols == docs[0][1].count("$")


def test_chats(spark, tables):
    d, _, turns = tables
    rows = {r.conv_id: r for r in queries.QUERIES["op2_chat_formatting"](spark, d).collect()}
    assert set(rows) == {1, 2, 3, 4, -7}
    for conv in (1, 2, 3, 4):
        own = [(r, t or "") for c, _, r, t in sorted(turns, key=lambda x: x[:2]) if c == conv]
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (rows[conv].n_turns, rows[conv].turns_sha256, rows[conv].loss_chars, rows[conv].loss_sha256) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len("</s>[INST] ok [/INST]")


def test_shards(spark, tables):
    d, docs, _ = tables
    rows = queries.QUERIES["op3_balanced_sharding"](spark, d).collect()
    raw = lambda t: (t or "").encode()
    assert sorted((number(r.doc_id), r["size"], r.text_crc32) for r in rows) == sorted((number(i), len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t, *_ in docs)
    sizes = [sum(r.shard == s for r in rows) for s in range(40)]
    assert {r.law for r in rows} == {"rows"} and max(sizes) - min(sizes) <= 1 and all(r.grown_shard is None for r in rows)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in range(40))


def test_token_shards(spark, tables):
    d, docs, _ = tables
    rows = queries.QUERIES["op4_token_shards"](spark, d).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and sorted(r.sequence for r in rows) == list(range(len(rows)))


def test_encoding(spark, tables):
    d, docs, _ = tables
    rows = queries.QUERIES["op6_sentencepiece"](spark, d).collect()
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in docs)
    assert sorted(r.decoded_sha256 for r in rows) == want and all(r.lossless for r in rows)


def test_decoding(spark, tables):
    d, docs, _ = tables
    encoded = sentencepiece_bpe.encode(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "lang", "_encoded.ids")
    back = sentencepiece_bpe.decode(encoded)
    assert back.columns == ["doc_id", "lang", "text"]
    assert sorted((number(r.doc_id), r.text) for r in back.collect()) == sorted((number(i), t or "") for i, t, *_ in docs)
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"\xff\xff"))], "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in sentencepiece_bpe.decode(odd).collect()} == {1: None, 2: "", 3: None}


@pytest.mark.parametrize("name", ["op9_quality_classifier", "op10_language_id"])
def test_folds(spark, tables, name):
    d, docs, _ = tables
    rows = queries.QUERIES[name](spark, d).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(bool(r.held_out) == (held(r.doc_id, 4, 2) if name.startswith("op9") else held(r.doc_id, 3, 1)) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id < 240]
    if name.startswith("op9"):
        assert all(r.predicted == int(r.score >= 0.7) for r in rows)
        assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in out) >= 0.9 * len(out)
    else:
        assert sum(r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in out) >= 0.95 * len(out)
        assert {r.lang_pred for r in rows if r.doc_id in (250, 251, 252)} == {"und"}


def test_labels_of_the_held_out_fold_change_nothing(spark, tables, tmp_path):
    d, docs, _ = tables
    other = str(tmp_path)
    spark.read.parquet(f"{d}/documents.parquet").withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang"))).write.parquet(f"{other}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{other}/labels.parquet")
    for name, columns in (("op9_quality_classifier", ("doc_id", "predicted")), ("op10_language_id", ("doc_id", "lang_pred"))):
        run = lambda where: sorted(map(str, queries.QUERIES[name](spark, where).select(*columns).collect()))  # noqa: E731, B023
        assert run(d) == run(other)


@pytest.mark.parametrize("name", ["op5_substring_dedup", "op7_benchmark_decontamination", "op8_minhash_near_dedup"])
def test_columns_of_the_contracts(spark, tables, name):
    d, docs, _ = tables
    want = {
        "op5_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op7_benchmark_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op8_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    }[name]
    rows = queries.QUERIES[name](spark, d)
    assert rows.columns == want and rows.count() == len(docs)
    if name.startswith("op8"):
        found = {r.doc_id: r for r in rows.collect()}
        assert found[240].component_id == 240 % 7 and not found[240].kept and found[250].n_shingles == 0 and found[250].kept


def test_links_over_a_document_without_an_id(spark):
    """1 and 2 are linked with a document without an id, but not with each other."""
    from tracewright.llm import near_dedup

    w = [f"w{i}" for i in range(40)]
    texts = [(1, " ".join(w[:32])), (None, " ".join(w[2:36])), (2, " ".join(w[4:40])), (9, "else " * 9)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.find_groups(df).collect()} == {(1, 1), (2, 1), (None, 1), (9, 9)}
    assert sorted(r.doc_id for r in near_dedup.keep_one(df, 4).collect()) == [1, 9]


def test_huge_sets_have_signatures_of_their_own():
    import numpy as np

    from tracewright.llm import near_dedup

    rng = np.random.default_rng(5)
    a, b = (near_dedup.band_keys(near_dedup.signature(np.unique(rng.integers(0, 2**64, 4_000_000, dtype=np.uint64)))) for _ in range(2))
    assert not (a == b).any()


def test_token_shards_of_string_ids(spark, tmp_path):
    from tracewright.llm import token_shards

    docs = spark.createDataFrame([("a", "some words " * 40), (None, "no id " * 40), ("c", None)], "doc_id string, text string").coalesce(1)
    rows = token_shards.write_shards(docs, f"file://{tmp_path}/out", length=32).orderBy("sequence").collect()
    assert rows[0].first_doc_id == "a" and {r.first_doc_id for r in rows} <= {"a", None, "c"} and any(r.first_doc_id is None for r in rows)
