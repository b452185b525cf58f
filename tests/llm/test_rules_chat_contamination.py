"""Quality rules, chat formatting and decontamination against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat_format, decontaminate, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, kept string, row string"


def texts():
    rng = random.Random(4)
    words = ["the", "Straße", "日本", "a", "of", "x&y", "OK!!", " ", "é"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    lines = ["same line\nsame line\n\nother\n same line\nsame line", "a\r\nb\tc\x0bd", "", None, "\n \n", "x" * 300_000, "a b c " * 300]
    return [(i, t, "n", "k", "r") for i, t in enumerate([*made, *lines])] + [(None, "no id", "", "", ""), (3, "same id", "", "", ""), (3, "same id", "", "", "")]


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_measures(spark):
    rows = texts()
    found = quality_rules.ledger(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((r[0], *measured(r[1])) for r in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found), key=key) == want


def test_policies_and_ablation(spark):
    ledger = quality_rules.ledger(spark.createDataFrame(texts(), SCHEMA)).cache()
    policy = quality_rules.POLICIES[quality_rules.CURRENT]
    rows = ledger.collect()
    kept = quality_rules.apply_policy(ledger, policy).where("kept").count()
    assert kept == sum(r.fail_bits & policy.mask == 0 for r in rows)
    for r in quality_rules.ablation(ledger, policy).collect():
        bit = next(x.mask for x in quality_rules.RULES if x.name == r.rule)
        assert r.fails == sum(x.fail_bits & bit != 0 for x in rows)
        assert r.fails_alone == sum(x.fail_bits & policy.mask == bit for x in rows)
        assert r.kept_without == kept + r.fails_alone


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality_rules.ledger(empty).count() == 0
    assert decontaminate.find(empty.select("doc_id", "text"), bench).count() == 0
    assert decontaminate.remove(empty, bench).columns == empty.columns
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


CONVERSATIONS = [(1, 0, "user", "hi <b> [INST] \\l x"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "<|end|>\n"), (2, 0, "assistant", "<|end|>\n"), (None, None, None, None), (3, 0, "system", "é\n" * 2000)]


def test_round_trip(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1))
    found = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    for conv in (1, 2, 3, None):
        own = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in CONVERSATIONS if c == conv])
        row = found[conv]
        assert chat_format.parse(row.formatted) == [(r, x) for _, r, x in own]
        learned = [chat_format.unescape(row.formatted[s["from"] : s["to"]]) for s in row.loss]
        assert learned == [x for _, r, x in own if r == "assistant"]
        assert row.rewritten_at == -1
        assert "".join(row.formatted[s["from"] : s["to"]] for s in row.spans) == row.formatted
    assert not any(c in chat_format.escape("</s>[INST] <|end|>") for c in "<[")


def test_rewriting_templates_are_found():
    def only_last_answer(turns):
        return "".join(f"{r}:{'' if r == 'assistant' and i < len(turns) - 1 else t};" for i, (r, t) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "long answer"), ("user", "b")]
    assert chat_format.render_spans(turns, only_last_answer)[3] == 2
    plain = lambda ts: "".join(f"[{r}]{t}|" for r, t in ts)
    out, spans, loss, rewritten = chat_format.render_spans(turns, plain)
    assert rewritten == -1 and [out[a:b] for a, b in loss] == ["long answer"] and len(spans) == 3


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, items):
    windows = {}
    for item, text in items:
        words = lowered(text)
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        words, hit, found = lowered(text), set(), set()
        for n in range(1, 11):
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= {x for x in windows[w] if x is not None}
        out.append((doc, len(words), len(hit), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [10**7, 60])
def test_hits(spark, block_bytes):
    rng = random.Random(2)
    passage = [f"w{i}é" for i in range(24)]
    items = [(2, " ".join(passage)), (10, "Short, ITEM"), (10, "Short, ITEM"), (None, "null item words here"), (4, None), (5, "!!"), (7, " ".join(passage[5:20]))]
    docs = [(i, " ".join(rng.choice(["foo", "short item", "Null-item words? here", " ".join(passage[k : k + rng.randint(5, 15)])]) for k in rng.sample(range(12), 3))) for i in range(30)]
    docs += [(99, None), (98, ""), (97, "x " * 50_000 + " ".join(passage)), (97, "again")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string")
    found = decontaminate.find(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    n_hit = F.aggregate("_hits.spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    rows = [tuple(r) for r in found.select("doc_id", "_hits.n_words", n_hit, F.sha2(F.array_join("_hits.items", ","), 256)).collect()]
    assert sorted(rows) == sorted(contaminated(docs, items))


def test_removal(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    dirty = "Keep this. One two, three four five six seven eight nine TEN! And this."
    docs = spark.createDataFrame([(1, dirty, 70), (2, "clean text", 10), (3, "one two three four five six seven eight nine ten", 48), (4, None, None)], "doc_id long, text string, n_chars long")
    spans = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.remove(docs, items).collect()}
    assert spans == {1: ("Keep this. ! And this.", 22), 2: ("clean text", 10), 4: (None, None)}
    assert {r.doc_id for r in decontaminate.remove(docs, items, mode="documents").collect()} == {2, 4}


def test_a_block_is_small_and_lets_go(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(200))) for i in range(800)]
    size = sum(len(t) for _, t in items)
    assert decontaminate.build_block(items, 10).nbytes < 8 * size
    docs = [(d, f"before {' '.join(t.split()[20:45])} behind") for d, t in items[::40]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(df, bench, block_bytes=size // 6, at_once=2, cut=True)
    got = {r.doc_id: (r._hits["items"], r._hits.cut) for r in found.collect()}
    assert got == {d: ([str(d)], "before  behind") for d, _ in docs}


def test_windows_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(decontaminate.W, "hash_windows", lambda hashes, n, at: hashes[at] % np.uint64(3))
    passage = [f"w{i}" for i in range(14)]
    items = [(1, " ".join(passage)), (2, " ".join(passage[2:13])), (3, "short item"), (4, "short thing"), (2, " ".join(passage[2:13]))]
    docs = [(1, "x " + " ".join(passage[1:13]) + " short thing"), (2, "short item short"), (3, "w1 w2")]
    words = decontaminate.W.scan(pa.array([t for _, t in docs]), decontaminate.W.ALNUM, lower=True)
    hit, found = decontaminate.hits(words, decontaminate.build_block(items, 10))
    got = [(d, int(words.counts[k]), int(hit[words.first[k] : words.first[k + 1]].sum()), hashlib.sha256(",".join(sorted(found[k])).encode()).hexdigest()) for k, (d, _) in enumerate(docs)]
    assert got == contaminated(docs, items)


def test_a_rewriting_template_keeps_the_loss_spans():
    """One that shows all answers but the last as dots, and one that moves the first turn to the end."""
    turns = [("user", "hi"), ("assistant", "first"), ("user", "more"), ("assistant", "second")]
    last_only = lambda ts: "".join(f"[{r}]{t if r == 'user' or k == len(ts) - 1 else '...'}|" for k, (r, t) in enumerate(ts))
    out, _, loss, rewritten = chat_format.render_spans(turns, last_only)
    assert rewritten == 2 and [out[a:b] for a, b in loss] == ["second"]
    moved = lambda ts: "".join(f"<{r}>{t}" for r, t in [*ts[1:], *ts[:1]])
    out, _, loss, rewritten = chat_format.render_spans(turns, moved)
    assert rewritten == 1 and [out[a:b] for a, b in loss] == ["first", "second"]
