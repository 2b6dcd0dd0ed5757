"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

All pre-tokens that need encoding lie in one linked list of symbols (numpy arrays; no link crosses a pre-token). For
each merge rank a bucket holds the list positions whose pair has that rank; a three-level bitmap of 64-bit words marks
the ranks whose bucket is not empty, and find-first-set gives the next rank. An entry whose pair has changed since is
stale and skipped. The positions of a rank are merged together, left to right where they overlap. A rank whose merge can
give rise to a pair of a lower rank is merged at the leftmost position of each pre-token only before the queue is asked
again, so the order of merges in a pre-token is that of the sequential algorithm. Work is linear in symbols and merges,
also in a pre-token of a million bytes.

Results of distinct pre-tokens are kept in a bounded cache. Null texts count as empty (no tokens, digests of the empty
string); repeated rows and null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import short_batches, table
from .words import WordCache, by_bytes, ragged

NONE = np.int32(2**31 - 1)
#: Bytes of text that are encoded together: more share the steps of the queue, fewer need less memory.
CHUNK_BYTES = 12_000_000


class Bitmap:
    """A set of small integers with find-first-set over three levels of 64-bit words."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, i: int) -> None:
        self.low[i >> 6] |= 1 << (i & 63)
        self.mid[i >> 12] |= 1 << ((i >> 6) & 63)
        self.top |= 1 << (i >> 12)

    def remove(self, i: int) -> None:
        self.low[i >> 6] &= ~(1 << (i & 63))
        if not self.low[i >> 6]:
            self.mid[i >> 12] &= ~(1 << ((i >> 6) & 63))
            if not self.mid[i >> 12]:
                self.top &= ~(1 << (i >> 12))

    def first(self) -> int:
        """The smallest member, -1 if there is none."""
        if not self.top:
            return -1
        k = (self.top & -self.top).bit_length() - 1
        k = (k << 6) | ((self.mid[k] & -self.mid[k]).bit_length() - 1)
        return (k << 6) | ((self.low[k] & -self.low[k]).bit_length() - 1)


class ByteBPE:
    """Vocabulary of ranked byte strings and the pattern that cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.token = [b""] * self.size
        for t, r in ranks.items():
            self.token[r] = t
        keys, ids = [], []
        for t, r in ranks.items():
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    keys.append((a << 32) | b)
                    ids.append(r)
        keys, ids = np.array(keys, np.int64), np.array(ids, np.int32)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def __reduce__(self):
        return ByteBPE, (self.ranks, self.find.__self__.pattern)

    @cached_property
    def unsafe(self) -> np.ndarray:
        """By rank: whether the token's merge can make a pair of a lower or its own rank."""
        out = np.zeros(self.size, bool)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            out[side[self.ids <= side]] = True
        return out

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NONE, np.int32)
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and the number of each."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum())
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        sym = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        known = np.flatnonzero((whole >= 0) & (sizes > 0))
        gone = np.zeros(n, bool)  # the symbol was merged into an earlier one, or its piece is a token as a whole
        gone[ragged(starts[known], sizes[known])] = True
        gone[starts[known]] = False
        sym[starts[known]] = whole[known]
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        self._merge(sym, piece, gone)
        keep = ~gone
        return sym[keep].astype(np.uint32), np.bincount(piece[keep], minlength=len(pieces))

    def _merge(self, sym: np.ndarray, piece: np.ndarray, gone: np.ndarray) -> None:
        n = len(sym)
        if n < 2:
            return
        nxt = np.arange(1, n + 1, dtype=np.int64)
        nxt[:-1][piece[1:] != piece[:-1]] = n
        prv = np.arange(-1, n - 1, dtype=np.int64)
        prv[1:][piece[1:] != piece[:-1]] = -1
        rank = np.full(n + 1, NONE, np.int32)  # of the pair that starts at the position; one more for "no position"
        live = np.flatnonzero((nxt[:-1] < n) & ~gone[1:])  # pieces that are one token have no second symbol left
        rank[live] = self.pair_ranks(sym[live], sym[live + 1])
        buckets: dict[int, list] = {}
        marks = Bitmap(self.size)

        def put(at: np.ndarray) -> None:
            r = rank[at]
            at = at[r != NONE]
            r = r[r != NONE]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            heads = [0, *cut.tolist(), len(at)]
            for k, x in enumerate(r[heads[:-1]].tolist()):
                part = at[heads[k] : heads[k + 1]]
                if x in buckets:
                    buckets[x].append(part)
                else:
                    buckets[x] = [part]
                    marks.add(x)

        put(live)
        unsafe = self.unsafe
        while (r := marks.first()) >= 0:
            parts = buckets.pop(r)
            marks.remove(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank[at] == r]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                if unsafe[r]:
                    first = np.ones(len(at), bool)
                    first[1:] = piece[at[1:]] != piece[at[:-1]]
                    if not first.all():
                        buckets[r] = [at[~first]]
                        marks.add(r)
                        at = at[first]
                else:
                    touch = nxt[at[:-1]] == at[1:]
                    if touch.any():  # a run of overlapping pairs: every other one, from the left
                        i = np.arange(len(at))
                        head = np.concatenate([[True], ~touch])
                        at = at[(i - np.maximum.accumulate(np.where(head, i, 0))) % 2 == 0]
            right = nxt[at]
            after = nxt[right]
            sym[at] = r
            gone[right] = True
            rank[right] = NONE
            nxt[at] = after
            inner = after < n
            prv[after[inner]] = at[inner]
            rank[at] = NONE
            x = at[inner]
            rank[x] = self.pair_ranks(sym[x], sym[after[inner]])
            before = prv[at]
            y = before[before >= 0]
            if len(y):
                rank[y] = self.pair_ranks(sym[y], sym[nxt[y]])
                put(np.unique(np.concatenate([x, y])))
            else:
                put(x)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Encoder:
    """Encodes texts through a cache of distinct pre-tokens."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.cache = WordCache(self._compute)
        self.flat: list[np.ndarray] = [np.zeros(0, np.uint32)]

    def _compute(self, pieces: list[str]) -> np.ndarray:
        ids, lengths = self.bpe.encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces])
        if not self.cache.done:
            self.flat = [ids[:0]]
        held = len(self.flat[0])
        self.flat = [np.concatenate([self.flat[0], ids])]
        return np.stack([held + np.cumsum(lengths) - lengths, lengths], 1)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, uint32."""
        numbers = self.cache.number(map(self.bpe.find, texts))
        spans = self.cache.results()
        for x in numbers:
            yield self.flat[0][ragged(*spans[x].T)] if len(x) else self.flat[0][:0]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(ByteBPE.load(path, pattern))
    return _ENCODERS[path, pattern]


def texts_of(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of up to `most` bytes of text; null texts come as empty."""
    rows = ((i, t or "") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    for group in by_bytes(rows, lambda x: len(x[1]), most):
        ids, texts = zip(*group, strict=True)
        yield list(ids), list(texts)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, ids (array<int>)."""
    short_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for ids, texts in texts_of(batches):
            found = [x.astype(np.int32) for x in encoder(path, pattern).encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded: doc_id, ids. Returns doc_id, content (binary); null ids give empty content."""

    def run(batches):
        for b in batches:
            bpe = encoder(path, pattern).bpe
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes each text, decodes the ids, and returns sizes and digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    short_batches(docs.sparkSession)

    def run(batches):
        for doc_ids, texts in texts_of(batches):
            enc = encoder(path, pattern)
            n, a, b = [], [], []
            for ids in enc.encode(texts):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(enc.bpe.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": a, "decoded_sha256": b})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
