"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges are done on an agenda (best score first, then leftmost), as the model's own encoder does. With dropout, a candidate merge
taken from the agenda is skipped when a keyed hash of (seed, document, place of the chunk in the text, place in the chunk, merged
piece) falls below the rate; a later merge beside it may bring it back. So every occurrence of a word is segmented for itself,
always into pieces that merges can make, and the same on every machine.

Pieces never run from a word into the next space, so a text falls apart into chunks (spaces, then a word) that are encoded
alone. A worker remembers, for about ``REMEMBERED`` chunks, the candidates that come up when none is skipped and when one is, with the
ids they lead to; an occurrence whose own hash skips more is merged by itself. That saves merging and changes no result. Without
dropout the ids are those of the sentencepiece library.

Lossless: characters without a piece, and U+2581 itself (which stands for the space), are spelled in byte pieces; decoding gives
back the exact text. A null text is encoded as an empty one, without pieces; a null doc_id draws as 0. Repeated rows are encoded
alike; texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 7
REMEMBERED = 250_000
SPACE = "▁"
SHORT = 48
PART = 50_000
SLICE_BYTES = 250_000  # a chunk is an object here, so a slice takes many times its bytes
NONE = 1 << 30
UNSEEN, ALONE = -1, -2  # instead of a state: not yet remembered; to be merged by itself
_M = (1 << 64) - 1


def _skips(key: int, place: int, rank: int, most: int) -> bool:
    """Whether the keyed hash drops the candidate of this rank at this place."""
    x = ((key ^ (place * 0x9E3779B97F4A7C15 + rank)) * 0xBF58476D1CE4E5B9) & _M
    return ((x ^ (x >> 29)) * 0x94D049BB133111EB) & _M < most


def _skips_many(keys: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """The same for many candidates, given as place * 0x9E3779B97F4A7C15 + rank."""
    x = (keys ^ candidates) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) < np.uint64(most)


class Pieces:
    """A BPE model with byte pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.bytes: list[bytes] = []
        byte_ids = {}
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.bytes.append(b"")
            else:
                self.ids[piece], scores[piece] = i, m.get_score(i)
                self.bytes.append(piece.replace(SPACE, " ").encode())
        self.byte_ids = [byte_ids[b] for b in range(256)]
        if len(self.bytes) > 1 << 16:
            raise ValueError(f"a model of {len(self.bytes)} pieces: ids are 16 bits wide")
        order = {score: r for r, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: order[score] for piece, score in scores.items()}  # the best score first
        inside = sorted({c for p in self.ids if len(p) > 1 for c in p} - {SPACE})
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece of this model runs into the next space")
        self.chunk = re.compile(f"{SPACE}*[{re.escape(''.join(inside))}]+|{SPACE}+|[^{SPACE}]", re.S)

        self.singles = np.full(0x110000, -1, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.singles[ord(piece)] = i
        joins = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    joins[a << 32 | b] = (self.ranks[piece], i)
        self._tabulate(joins)

    def spell(self, symbol: str) -> list[int]:
        known = self.ids.get(symbol)
        return [known] if known is not None else [self.byte_ids[b] for b in symbol.encode()]

    def merge(self, chunk: str, dropout: float = 0.0, key: int = 0) -> list[int]:
        """The ids of a chunk. key: of the hash that skips merges."""
        symbols = list(chunk)
        if len(symbols) > 1:
            most = int(dropout * (1 << 64))
            symbols = (self._merge_short if len(symbols) <= SHORT else self._merge_long)(symbols, most, key)
        ids = self.ids
        return [ids[s] for s in symbols] if all(map(ids.__contains__, symbols)) else [x for s in symbols for x in self.spell(s)]

    def _merge_short(self, symbols: list[str], most: int, key: int) -> list[str]:
        """The agenda as a list beside the symbols: its least rank is the next candidate."""
        ranks = self.ranks
        agenda = [ranks.get(a + b, NONE) for a, b in pairwise(symbols)]
        place = list(range(len(symbols)))
        while agenda and (rank := min(agenda)) < NONE:
            i = agenda.index(rank)
            if most and _skips(key, place[i], rank, most):
                agenda[i] = NONE
                continue
            both = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i], place[i + 1]
            if i < len(agenda):
                agenda[i] = ranks.get(both + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = ranks.get(symbols[i - 1] + both, NONE)
        return symbols

    def _merge_long(self, symbols: list[str], most: int, key: int) -> list[str]:
        """The agenda as a heap, for chunks of any length."""
        ranks, n = self.ranks, len(symbols)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [ranks.get(a + b, NONE) for a, b in pairwise(symbols)] + [NONE]  # the candidate that stands at each place
        agenda = [(r, i) for i, r in enumerate(now) if r < NONE]
        heapify(agenda)
        while agenda:
            rank, i = heappop(agenda)
            if now[i] != rank:
                continue
            if most and _skips(key, i, rank, most):
                now[i] = NONE
                continue
            j = right[i]
            both = symbols[i] = symbols[i] + symbols[j]
            symbols[j], now[j], now[i] = "", NONE, NONE
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(both + symbols[k], NONE)) < NONE:
                    now[i] = r
                    heappush(agenda, (r, i))
            if (h := left[i]) >= 0:
                now[h] = ranks.get(symbols[h] + both, NONE)
                if now[h] < NONE:
                    heappush(agenda, (now[h], h))
        return [s for s in symbols if s]

    def _tabulate(self, joins: dict[int, tuple[int, int]]) -> None:
        """The pairs that make a piece, as an open-addressed table, at most a quarter full."""
        self.table_bits = max(4, (4 * len(joins)).bit_length())
        self.table_keys = np.full(1 << self.table_bits, -1, dtype=np.int64)
        self.table_values = np.full(1 << self.table_bits, NONE << 32, dtype=np.int64)  # rank, then id
        for key, (rank, i) in joins.items():
            at = (key * 0x9E3779B97F4A7C15 & _M) >> (64 - self.table_bits)
            while self.table_keys[at] >= 0:
                at = (at + 1) & (len(self.table_keys) - 1)
            self.table_keys[at], self.table_values[at] = key, rank << 32 | i

    def _joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the pieces that pairs of ids make; NONE where they make none."""
        key = a << 32 | b
        at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.table_bits)).astype(np.int64)
        there = self.table_keys[at]
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.table_keys) - 1)
            there = self.table_keys[at[open_]]
            open_ = open_[(there != key[open_]) & (there >= 0)]
        value = np.where(self.table_keys[at] == key, self.table_values[at], NONE << 32)
        return value >> 32, value & 0xFFFFFFFF

    def merge_many(self, chunks: list[str], dropout: float, keys: np.ndarray) -> list[bytes]:
        """What `merge` gives for each chunk and its key, as 16-bit ids, for all chunks side by side."""
        most = int(dropout * (1 << 64))
        ids, counts, odd = self._rounds(chunks, (lambda _, active, candidates: _skips_many(keys[active], candidates, most)) if most else None)
        flat = ids.tobytes()
        ends = np.concatenate([[0], np.cumsum(counts)]) * 2
        out = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for c in odd.tolist():
            out[c] = np.array(self.merge(chunks[c], dropout, int(keys[c])), np.uint16).tobytes()
        return out

    def _rounds(self, chunks: list[str], skip) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all chunks one after the other, how many each has, and the chunks for which they do not hold. A round takes
        the next candidate of every chunk's agenda; skip: of (round, chunks, candidates), which of them are skipped."""
        raw = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(c) for c in chunks], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        ids = self.singles[raw]
        n = len(ids)
        word = np.repeat(np.arange(len(chunks)), size)
        odd = np.unique(word[ids < 0])  # chunks with a character that has no piece of its own
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[begin[1:] - 1], left[begin[:-1]] = n, -1
        rank, alive = np.full(n, NONE, dtype=np.int64), np.ones(n, dtype=bool)
        inner = np.flatnonzero((right < n) & (ids >= 0))
        inner = inner[ids[right[inner]] >= 0]
        rank[inner], _ = self._joined(ids[inner], ids[right[inner]])
        active = np.arange(len(chunks))
        held, starts = np.arange(n), begin[:-1]  # the places of the active chunks, and where each begins among them
        turn = 0
        while len(active):
            least = np.minimum.reduceat(rank[held] << 32 | held, starts)
            going = least >> 32 < NONE
            if not going.all():
                active, least = active[going], least[going]
                sizes = size[active]
                starts = np.cumsum(sizes) - sizes
                held = np.repeat(begin[active] - starts, sizes) + np.arange(sizes.sum())
            i, r = least & 0xFFFFFFFF, least >> 32
            if not len(i):
                break
            if skip:
                skipped = skip(turn, active, (i - begin[active]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + r.astype(np.uint64))
                turn += 1
                rank[i[skipped]] = NONE
                i = i[~skipped]
            j = right[i]
            _, made = self._joined(ids[i], ids[j])
            ids[i], alive[j], rank[j] = made, False, NONE
            k = right[j]
            right[i] = k
            more = k < n
            rank[i] = NONE
            left[k[more]] = i[more]
            rank[i[more]], _ = self._joined(ids[i[more]], ids[k[more]])
            h = left[i]
            some = h >= 0
            rank[h[some]], _ = self._joined(ids[h[some]], ids[i[some]])
        counts = np.add.reduceat(alive.astype(np.int64), begin[:-1]) if n else np.zeros(0, np.int64)
        return ids[alive].astype(np.uint16), counts, odd

    def trace_many(self, chunks: list[str], stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What `_rounds` gives when each chunk skips only the candidate of its stop (none, if below 0), and the candidates after
        that one: how many each chunk has, and all of them."""
        seen, taken = [], []

        def skip(turn: int, active: np.ndarray, candidates: np.ndarray) -> np.ndarray:
            after = stops[active] < turn
            seen.append(active[after])
            taken.append(candidates[after])
            return stops[active] == turn

        ids, counts, odd = self._rounds(chunks, skip)
        seen, taken = np.concatenate([*seen, np.zeros(0, np.int64)]), np.concatenate([*taken, np.zeros(0, np.uint64)])
        return ids, counts, odd, np.bincount(seen, minlength=len(chunks)), taken[np.argsort(seen, kind="stable")]

    def chunks(self, text: str) -> list[tuple[str, bool]] | list[str]:
        """The chunks of a text; one that is U+2581 in the text itself is given as "" and spelled in bytes."""
        if SPACE not in text:
            return self.chunk.findall(SPACE + text.replace(" ", SPACE))
        out = self.chunk.findall(SPACE + text.split(SPACE, 1)[0].replace(" ", SPACE))
        for part in text.split(SPACE)[1:]:
            out += ["", *self.chunk.findall(part.replace(" ", SPACE))]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text's bytes. What ``encode`` made of any text gives that text back."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        to = self.n + len(values)
        if to > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(len(self.held), to - len(self.held)), self.held.dtype)])
        self.held[self.n : to] = values
        self.n = to

    @property
    def now(self) -> np.ndarray:
        return self.held[: self.n]


class Encoder:
    """Encodes texts. Remembers states of chunks: candidates yet to come, and the ids if none of them is skipped."""

    def __init__(self, pieces: Pieces, dropout: float = DROPOUT, seed: int = SEED):
        self.pieces, self.dropout, self.seed = pieces, dropout, seed
        self.most = int(dropout * (1 << 64))
        self._forget()

    def _forget(self) -> None:
        """begin and ids_begin: by state. candidates and after (the state when this one is skipped): by place among all candidates."""
        self.roots: dict[str, int] = {}
        self.begin, self.ids_begin, self.candidates, self.after, self.ids = Grown(np.int64), Grown(np.int64), Grown(np.uint64), Grown(np.int32), Grown(np.uint16)
        self.begin.add([0])
        self.ids_begin.add([0])
        self._add(np.array([self.pieces.byte_ids[b] for b in SPACE.encode()]), [3], np.zeros(0, np.uint64), [0], ALONE)
        self.roots[""] = 0

    def _add(self, ids: np.ndarray, counts: np.ndarray, candidates: np.ndarray, n: np.ndarray, after: int) -> np.ndarray:
        """New states, one for each count."""
        first = self.begin.n - 1
        self.begin.add(len(self.candidates.now) + np.cumsum(n))
        self.ids_begin.add(len(self.ids.now) + np.cumsum(counts))
        self.candidates.add(candidates)
        self.after.add(np.full(len(candidates), after, np.int32))
        self.ids.add(ids)
        return np.arange(first, self.begin.n - 1)

    def _learn(self, missing: list[str]) -> None:
        """The first states of chunks that no text before had, side by side. A character without a piece has its bytes."""
        for c in (c for c in missing if len(c) == 1):
            ids = self.pieces.spell(c)
            self.roots[c] = int(self._add(np.array(ids), [len(ids)], np.zeros(0, np.uint64), [0], ALONE)[0])
        more = [c for c in missing if len(c) > 1]
        for at in range(0, len(more), 20_000):
            part = more[at : at + 20_000]
            ids, counts, odd, n, candidates = self.pieces.trace_many(part, np.full(len(part), -1))
            states = self._add(ids, counts, candidates, n, UNSEEN)
            states[odd] = ALONE
            self.roots.update(zip(part, states.tolist(), strict=True))

    def _states(self, chunks: list[str], keys: np.ndarray) -> np.ndarray:
        """The state whose ids each occurrence has, or ALONE."""
        got = list(map(self.roots.get, chunks))
        if None in got:
            gaps = [k for k, g in enumerate(got) if g is None]
            self._learn([c for c in {chunks[k] for k in gaps} if len(c) <= SHORT])
            for k in gaps:
                got[k] = self.roots.get(chunks[k], ALONE)
        states = np.array(got, dtype=np.int64)
        going = np.flatnonzero(states >= 0) if self.most else states[:0]
        while len(going):
            first = self.begin.now[states[going]]
            n = self.begin.now[states[going] + 1] - first
            ends = np.cumsum(n)
            held = np.arange(ends[-1]) + np.repeat(first - ends + n, n)
            skipped = np.flatnonzero(_skips_many(np.repeat(keys[going], n), self.candidates.now[held], self.most))
            whose = np.searchsorted(ends, skipped, side="right")
            lead = np.flatnonzero(np.diff(whose, prepend=-1))  # the first that each skips
            going, slot = going[whose[lead]], held[skipped[lead]]
            unseen = np.flatnonzero(self.after.now[slot] == UNSEEN)
            new, one = np.unique(slot[unseen], return_index=True)
            one = going[unseen[one]]
            for at in range(0, len(new), 20_000):
                part = one[at : at + 20_000]
                ids, counts, _, n, candidates = self.pieces.trace_many([chunks[k] for k in part.tolist()], new[at : at + 20_000] - self.begin.now[states[part]])
                self.after.now[new[at : at + 20_000]] = self._add(ids, counts, candidates, n, ALONE)
            states[going] = self.after.now[slot]
            going = going[states[going] >= 0]
        return states

    def _part(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all occurrences one after the other, and how many each has."""
        states = self._states(chunks, keys)
        alone = np.flatnonzero(states < 0)
        states[alone] = 0
        first = self.ids_begin.now[states]
        counts = self.ids_begin.now[states + 1] - first
        own: list[bytes] = [b""] * len(alone)
        short = [k for k, c in enumerate(alone.tolist()) if len(chunks[c]) <= SHORT]
        for k, ids in zip(short, self.pieces.merge_many([chunks[c] for c in alone[short].tolist()], self.dropout, keys[alone[short]]) if short else [], strict=True):
            own[k] = ids
        for k, c in enumerate(alone.tolist()):
            if len(chunks[c]) > SHORT:
                own[k] = np.array(self.pieces.merge(chunks[c], self.dropout, int(keys[c])), np.uint16).tobytes()
        counts[alone] = [len(ids) // 2 for ids in own]
        ends = np.cumsum(counts)
        source = np.arange(ends[-1]) + np.repeat(first - ends + counts, counts)
        mine = np.zeros(len(chunks), dtype=bool)
        mine[alone] = True
        mine = np.repeat(mine, counts)
        source[mine] = 0
        out = self.ids.now[source]
        out[mine] = np.frombuffer(b"".join(own), np.uint16)
        return out, counts

    def encode_many(self, texts: list[str], doc_ids: list[int]) -> list[np.ndarray]:
        """Ids of texts (16 bits; a model of more pieces needs more)."""
        chunks, sizes = [], []
        for text in texts:
            own = self.pieces.chunks(text) if text else []
            chunks += own
            sizes.append(len(own))
        sizes = np.array(sizes, dtype=np.int64)
        starts = W.mix(np.array([(doc * 0x9E3779B97F4A7C15 + self.seed) & _M for doc in doc_ids], dtype=np.uint64))
        ends = np.cumsum(sizes)
        keys = W.mix(np.repeat(starts, sizes) + (np.arange(len(chunks)) - np.repeat(ends - sizes, sizes)).astype(np.uint64))
        ids, counts = [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)]
        for at in range(0, len(chunks), PART):
            if len(self.roots) >= REMEMBERED or self.begin.n >= 4 * REMEMBERED:
                self._forget()
            done, n = self._part(chunks[at : at + PART], keys[at : at + PART])
            ids.append(done)
            counts.append(n)
        ids, to = np.concatenate(ids), np.cumsum(np.concatenate(counts))[np.concatenate([[0], ends])].tolist()
        return [ids[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]

    def encode(self, text: str, doc_id: int = 0) -> np.ndarray:
        return self.encode_many([text], [doc_id])[0]


def _encoder(model, dropout: float, seed: int) -> Encoder:
    name = (hashlib.md5(model.value, usedforsecurity=False).digest(), dropout, seed)
    return W.kept(name, lambda: Encoder(Pieces(model.value), dropout, seed))


def _runner(model, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, dropout, seed)
        for batch in batches:
            texts = W.texts_of(batch.column("text"))
            for i, j in W.slices(texts, SLICE_BYTES):
                ids, counts, digests, same = [], [], [], []
                listed = texts.slice(i, j - i).to_pylist()
                for text, own in zip(listed, encoder.encode_many(listed, batch.column("draw").slice(i, j - i).to_pylist()), strict=True):
                    back = encoder.pieces.decode(own.tolist())
                    ids.append(own.tobytes())
                    counts.append(len(own))
                    digests.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text.encode())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["row", "ids", "n_pieces", "decoded_sha256", "lossless"])

    return W.tidy(run, forget=False)


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs' columns but text, and a struct _encoded: ids (16-bit little-endian), n_pieces, decoded_sha256, lossless (decoding
    gave back the text)."""
    spark = docs.sparkSession
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a model file, below 1 MB
    others = [c for c in docs.columns if c != "text"]
    draw = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), draw.alias("draw"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    done = rows.mapInArrow(_runner(shared, dropout, seed), f"row {kind}, ids binary, n_pieces long, decoded_sha256 string, lossless boolean")
    return done.select(*(F.col(f"row.`{c}`") for c in others), F.struct("ids", "n_pieces", "decoded_sha256", "lossless").alias("_encoded"))


def _decoder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(model, 0.0, 0).pieces
        for batch in batches:
            texts = []
            for raw in batch.column("ids"):
                own = np.frombuffer(raw.as_py() or b"", "<u2").tolist()
                bad = max(own, default=0) >= len(pieces.bytes)
                texts.append(None if raw.as_py() is None or bad else pieces.decode(own).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded's columns (ids as `encode` gives them, and others) with `text` in place of ids. Null ids, and ids that the model does not
    have, give a null text; no ids an empty one."""
    with open(model, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())  # a model file, below 1 MB
    others = [c for c in encoded.columns if c not in ("ids", "text")]
    rows = encoded.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), "ids")
    done = rows.mapInArrow(_decoder(shared), f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return done.select(*(F.col(f"row.`{c}`") for c in others), "text")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode(docs)
    return done.select("doc_id", F.col("_encoded.n_pieces").alias("n_pieces"), F.sha2("_encoded.ids", 256).alias("ids_sha256"), F.col("_encoded.decoded_sha256").alias("decoded_sha256"), F.col("_encoded.lossless").alias("lossless"))
