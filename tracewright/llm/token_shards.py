"""Training-order materialisation: token ids of all texts, in a keyed random order, as binary shards of fixed stride.

1. Texts are tokenised once (byte-level BPE, an end mark after each document) and packed into sequences of ``LENGTH`` ids. The
   sequences of an input partition are numbered as they come; compressed blocks of them are kept in the shared folder.
2. A count for each input partition gives every sequence a number from 0 to n - 1, and a keyed Feistel network with
   cycle-walking permutes these numbers: sequence number to global slot, one to one, computed where the sequence is.
3. Slots are dealt by range, ``PER_SHARD`` to a shard. The task of a shard puts each sequence at its place in one buffer and writes
   it under a temporary name, then renames it: a repeated task writes the same bytes. Slot s is at byte
   (s mod PER_SHARD) * LENGTH * 2 of shard s div PER_SHARD, so a reader resumes anywhere by a seek.

Nulls: a null or empty text is one end mark; a null doc_id is carried. Repeated rows are tokenised as often as they occur; other
columns are ignored; an empty table gives no shard. Ids are little-endian 16-bit; the last sequence of an input partition is
filled with end marks, which are not counted in n_tokens. Sequences follow how the input is split, so a run is reproducible for one
layout of the input.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import scratch
from . import words as W

LENGTH, PER_SHARD = 2048, 8192
BLOCK = 256
ROUNDS = 6
KEY = 20240229
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of this vocabulary: its pre-tokenisation pattern and its free id.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, key: int, backwards: bool) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for r in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) & (1 << 64) - 1)
        if backwards:
            left, right = right ^ (W.mix(left ^ salt) & low), left
        else:
            left, right = right, left ^ (W.mix(right ^ salt) & low)
    return left << np.uint64(half) | right


def permute(numbers: np.ndarray, n: int, key: int = KEY, backwards: bool = False) -> np.ndarray:
    """A keyed permutation of 0 to n - 1; backwards: its inverse. A value outside walks on until it is inside."""
    half = _half_bits(n)
    out = _feistel(np.asarray(numbers, dtype=np.uint64), half, key, backwards)
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = _feistel(out[outside], half, key, backwards)
    return out.astype(np.int64)


_encodings: dict[bytes, object] = {}


def _encoding(vocabulary):
    """The tokeniser of a broadcast vocabulary file, once a worker."""
    data = vocabulary.value
    name = hashlib.md5(data, usedforsecurity=False).digest()
    if name not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
        _encodings.clear()
        _encodings[name] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def _packer(vocabulary, length: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part = _encoding(vocabulary), TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(3).compress
        full, block = length * BLOCK, 0
        ids = np.zeros(0, np.uint16)
        marks: list[tuple[int, object]] = []  # where in ids a document begins, and its doc_id

        def emit(n: int, tokens: int) -> pa.RecordBatch:
            nonlocal ids, marks, block
            begins = np.array([m for m, _ in marks])
            firsts = [marks[k][1] for k in np.searchsorted(begins, np.arange(n) * length, side="right") - 1]
            row = {"part": part, "block": block, "n": n, "tokens": tokens, "firsts": firsts, "ids": pack(ids[: n * length].tobytes())}
            at = max(0, int(np.searchsorted(begins, n * length, side="right")) - 1)
            marks = [(max(0, m - n * length), d) for m, d in marks[at:]]
            ids, block = ids[n * length :], block + 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            held, size = [ids], len(ids)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = np.array([*encoding.encode_ordinary(text.as_py() or ""), END], dtype=np.uint16)
                marks.append((size, doc))
                held.append(own)
                size += len(own)
                if size >= full:
                    ids = np.concatenate(held)
                    while len(ids) >= full:
                        yield emit(BLOCK, full)
                    held, size = [ids], len(ids)
            ids = np.concatenate(held)
        if len(ids):
            tokens, n = len(ids), -(-len(ids) // length)
            ids = np.concatenate([ids, np.full(n * length - tokens, END, np.uint16)])
            yield emit(n, tokens)

    return run


def _dealer(bases, n: int, key: int, length: int, per_shard: int, doc: pa.DataType):
    """Sequences to their shards: one compressed row for each shard and few megabytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(3).compress
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list]] = []

        def flush() -> pa.RecordBatch:
            numbers, ids, used = (np.concatenate([h[k] for h in held]) for k in range(3))
            firsts = [f for h in held for f in h[3]]
            held.clear()
            slots = permute(numbers, n, key)
            order = np.argsort(slots)
            shard = slots[order] // per_shard
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                o = order[a:b]
                rows.append({"shard": int(shard[a]), "slots": slots[o].tolist(), "numbers": numbers[o].tolist(), "used": used[o].tolist(), "firsts": [firsts[k] for k in o], "ids": pack(ids[o].tobytes())})
            return pa.RecordBatch.from_pylist(rows, _DEALT(doc))

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(unpack(row["ids"]), np.uint16).reshape(row["n"], length)
                base, of_block = bases.value[row["part"]], row["block"] * BLOCK
                used = np.clip(row["tokens"] - np.arange(row["n"]) * length, 0, length)
                held.append((base + of_block + np.arange(row["n"]), ids, used, row["firsts"]))
                if sum(len(h[0]) for h in held) * length >= 8_000_000:
                    yield flush()
        if held:
            yield flush()

    return run


def _DEALT(doc: pa.DataType) -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("slots", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64())), ("used", pa.list_(pa.int32())), ("firsts", pa.list_(doc)), ("ids", pa.binary())])


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it. Plain paths and file:/... mean the local one."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _writer(out: str, n: int, length: int, per_shard: int, doc: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        buffers: dict[int, np.ndarray] = {}
        rows: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                s = row["shard"]
                if s not in buffers:
                    buffers[s], rows[s] = np.zeros((min(per_shard, n - s * per_shard), length), np.uint16), []
                ids = np.frombuffer(unpack(row["ids"]), np.uint16).reshape(-1, length)
                buffers[s][np.array(row["slots"]) - s * per_shard] = ids
                rows[s] += [(slot, number, used, first, hashlib.sha256(i.tobytes()).hexdigest()) for slot, number, used, first, i in zip(row["slots"], row["numbers"], row["used"], row["firsts"], ids, strict=True)]
        for s, buffer in buffers.items():
            store, path = _store(out)
            store.create_dir(path, recursive=True)
            name, temporary = f"{path}/{shard_name(s)}", f"{path}/.{shard_name(s)}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as stream:
                stream.write(buffer.tobytes())
            store.move(temporary, name)
            slots, numbers, used, firsts, digests = zip(*sorted(rows[s]), strict=True)
            at = (np.array(slots) - s * per_shard) * length * 2
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(numbers, pa.int64()), pa.array([s] * len(slots), pa.int32()), pa.array(at, pa.int64()), pa.array(used, pa.int32()), pa.array(firsts, doc), pa.array(digests, pa.string())], ["slot", "sequence", "shard", "byte_offset", "n_tokens", "first_doc_id", "ids_sha256"])

    return run


def shard_name(s: int) -> str:
    return f"shard-{s:07d}.bin"


def write_shards(docs: DataFrame, out: str, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Write the shards and order.json to the folder `out`, which driver and executors share. Returns a row for each
    sequence: slot, sequence, shard, byte_offset, n_tokens, first_doc_id (of the document of its first token), ids_sha256."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        vocab = spark.sparkContext.broadcast(f.read())  # a vocabulary file, about 1 MB
    kind, doc = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    block = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("tokens", pa.int32()), ("firsts", pa.list_(doc)), ("ids", pa.binary())])
    rows = docs.select("doc_id", "text")
    blocks = scratch.keep(rows.mapInArrow(_packer(vocab, length, block), f"part int, block int, n int, tokens int, firsts array<{kind}>, ids binary"), "token-blocks")
    bases, n = {}, 0
    for part, count in blocks.groupBy("part").agg(F.sum("n")).orderBy("part").collect():  # a row for each input partition
        bases[part] = n
        n += count
    shards = -(-n // per_shard)
    dealt = blocks.mapInArrow(_dealer(spark.sparkContext.broadcast(bases), n, key, length, per_shard, doc), f"shard int, slots array<long>, numbers array<long>, used array<int>, firsts array<{kind}>, ids binary")
    written = dealt.repartitionById(max(1, shards), F.col("shard")).mapInArrow(_writer(out, n, length, per_shard, doc), f"slot long, sequence long, shard int, byte_offset long, n_tokens int, first_doc_id {kind}, ids_sha256 string")
    manifest = scratch.keep(written, "token-manifest")
    store, path = _store(out)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/order.json") as stream:
        stream.write(json.dumps({"sequences": n, "length": length, "per_shard": per_shard, "key": key, "dtype": "<u2", "end": END}).encode())
    return manifest


def read_sequences(out: str, slot: int = 0, end: int | None = None) -> Iterator[np.ndarray]:
    """The sequences from `slot` on, in slot order: sequential reads, resumable at any slot."""
    store, path = _store(out)
    with store.open_input_stream(f"{path}/order.json") as stream:
        order = json.loads(stream.read())
    stride, end = order["length"] * 2, order["sequences"] if end is None else min(end, order["sequences"])
    while slot < end:
        shard, at = divmod(slot, order["per_shard"])
        with store.open_input_file(f"{path}/{shard_name(shard)}") as stream:
            stream.seek(at * stride)
            for _ in range(min(end, (shard + 1) * order["per_shard"]) - slot):
                yield np.frombuffer(stream.read(stride), "<u2")
                slot += 1


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return write_shards(docs, scratch.folder(spark, "token-shards"))
