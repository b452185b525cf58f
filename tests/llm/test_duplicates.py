"""Near duplicates, repeated substrings and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import components, near_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, minimiser string, bands string, cluster string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "m", "b", "c") for d, t in docs], SCHEMA).repartition(3)


def near_corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        docs.append(" ".join(words))
        for _ in range(rng.randint(0, 8)):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append((" " if rng.random() < 0.5 else "\n").join(own).upper())
    docs += ["", None, "  ", "one", "One", "one two", "é" * 200_000, "a b c d " * 3000]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return [*zip(ids, docs, strict=True), (ids[0], docs[0]), (ids[1], docs[1])]


def near_expected(docs, n, percent):
    sets = []
    for _, text in docs:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize(("n", "block"), [(4, 128), (4, 3), (5, 128)])
def test_near_groups(spark, n, block):
    docs = near_corpus()
    found = near_dedup.find_groups(frame(spark, docs), n, 80, block)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == near_expected(docs, n, 80)


def test_one_of_each_group_stays(spark):
    docs = near_corpus()
    kept = near_dedup.keep_one(frame(spark, docs), 5, 80)
    assert kept.columns == ["doc_id", "text", "minimiser", "bands", "cluster"]
    want = {d for d, _, c in near_expected(docs, 5, 80) if d == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_near_threshold_is_exact():
    base = np.arange(80, dtype=np.uint64) * np.uint64(977)
    more = np.concatenate([base, np.arange(20, dtype=np.uint64) + np.uint64(10**9)])
    assert near_dedup.linked_groups([base, more], 80) == [[0, 1]]
    assert near_dedup.linked_groups([base, np.append(more, np.uint64(5))], 80) == []


def test_circulant_signatures_estimate():
    rng = np.random.default_rng(1)
    hit, n = 0, 40
    for _ in range(n):
        both = rng.integers(0, 2**63, 160).astype(np.uint64)
        a, b = np.unique(both[:140]), np.unique(both[20:])
        hit += (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(hit / n - 120 / 160) < 0.03


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = {r.node: r.component for r in components.connected(spark.createDataFrame(pairs, "a long, b long"), "test").collect()}
    assert found == {x: find(x) for x in root}


def repeat_corpus():
    rng = random.Random(11)
    passages = [[f"p{k}x{i}" for i in range(rng.randint(50, 90))] for k in range(4)]
    docs = []
    for i in range(40):
        words = [rng.choice(["a", "b", f"u{i}n{k}", "é"]) for k in range(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = p[rng.randint(0, 8) : len(p) - rng.randint(0, 8)]
        docs.append((i * 3 % 41, rng.choice([" ", "\n", "\t "]).join(words)))
    same = " ".join(passages[0] + passages[1])
    return [*docs, (50, same), (51, same), (51, same), (52, None), (53, ""), (54, "x " * 400), (55, "x " * 300), (None, same), (12, "a second text " * 30)]


def repeat_expected(docs, w):
    first = {}
    listed = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, words in listed:
        for i in range(len(words) - w + 1):
            g = tuple(words[i : i + w])
            if d is not None:
                first[g] = min(d, first.get(g, d))
    out = []
    for d, words in listed:
        gone = set()
        for i in range(len(words) - w + 1):
            if d is not None and first[tuple(words[i : i + w])] < d:
                gone.update(range(i, i + w))
        kept = " ".join(x for i, x in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), kept))
    return out


@pytest.mark.parametrize("window", [50, 13])
def test_repeated_words(spark, window):
    docs = repeat_corpus()
    rows, losing = substring_dedup.find(frame(spark, docs), window)
    removed = losing.mapInArrow(substring_dedup._digester, "doc_id long, row_key long, n_removed long, sha256 string")
    found = rows.join(removed, ["doc_id", "row_key"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)), F.coalesce("sha256", "whole_sha256"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in repeat_expected(docs, window)]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("heavy", [0, 3])
def test_repeated_words_of_heavy_minimisers(spark, heavy):
    docs = repeat_corpus()
    rows, losing = substring_dedup.find(frame(spark, docs), 13, heavy=heavy)
    removed = losing.mapInArrow(substring_dedup._digester, "doc_id long, row_key long, n_removed long, sha256 string")
    found = rows.join(removed, ["doc_id", "row_key"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)), F.coalesce("sha256", "whole_sha256"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in repeat_expected(docs, 13)]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("heavy", [0, 512])
def test_repeated_words_of_string_ids(spark, heavy):
    docs = [(None if d is None else f"d{d:03}", t) for d, t in repeat_corpus()]
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    _, losing = substring_dedup.find(df, heavy=heavy)
    removed = losing.mapInArrow(substring_dedup._digester, "doc_id string, row_key long, n_removed long, sha256 string")
    want = {(d, g) for d, _, g, _ in repeat_expected(docs, 50) if g}
    assert {(r.doc_id, r.n_removed) for r in removed.collect()} == want


def test_removed_texts(spark):
    docs = repeat_corpus()
    found = sorted((r.doc_id or -1, r.text or "") for r in substring_dedup.remove(frame(spark, docs)).collect())
    want = [(d or -1, (t or "") if not g else k) for (d, t), (_, n, g, k) in zip(docs, repeat_expected(docs, 50), strict=True) if not (g and g == n)]
    assert found == sorted(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dedup.find_groups(empty).count() == 0
    assert near_dedup.keep_one(empty).count() == 0
    rows, losing = substring_dedup.find(empty)
    assert rows.count() == losing.count() == 0
    assert substring_dedup.remove(empty).columns == empty.columns
