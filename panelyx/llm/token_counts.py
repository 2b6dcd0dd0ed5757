"""Token counts of a piece model (BPE with byte fallback) by rank-synchronous merging of ragged arrays.

A text is cut where no merge can cross: before a run of spaces, and between two characters that no piece holds side by
side. The distinct units of a batch lie in one ragged numpy array, whatever their lengths; in each round every unit
applies its own lowest rank, at all places that have it, at the same time as all the others; units without a mergeable
pair leave the array. So a unit's rounds are its different ranks, not its merges. Where one of these merges would make a
pair of the same or a lower rank, which the sequential order takes next, the unit walks its places of this round from
the left and merges such pairs as they come. What is left counts: one token for a symbol that is a piece, its UTF-8
bytes for a character that is none (byte fallback). Counts of units are cached in bounded memory.

The model's rules are read from its file: whether a space is put before a text that is not empty, and byte fallback;
spaces are written as U+2581. A file whose rules are not these (another model type, a normaliser, user-defined pieces,
white space as a suffix) is refused. Control strings inside a text are plain text. Null texts count as empty (0 bytes,
0 tokens); null ids and repeated rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import texts_of
from .common import short_batches, table
from .words import WordCache

SPACE = "▁"
BIG = np.int64(2**62)


class PieceModel:
    """pieces: text -> score of the mergeable pieces. Ranks: 0 is the best score, equal scores share a rank."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True, prefix: bool = True):
        self.pieces, self.byte_fallback, self.prefix = pieces, byte_fallback, prefix
        chars = sorted({c for p in pieces for c in p})
        self.text = [*chars, *sorted(p for p in pieces if len(p) > 1)]
        self.ids = {t: i for i, t in enumerate(self.text)}
        self.cost = np.array([1 if t in pieces else self._fallback(t) for t in self.text], np.int64)
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        keys, made, ranks = [], [], []
        for p, s in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in self.ids and p[k:] in self.ids:
                    keys.append((self.ids[p[:k]] << 32) | self.ids[p[k:]])
                    made.append(self.ids[p])
                    ranks.append(order[s])
        by = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
        self.keys, self.made, self.ranks = (np.array(x, np.int64)[by] for x in (keys, made, ranks))
        self.pairs = {a + b for p in pieces for a, b in zip(p, p[1:], strict=False)}
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        lone = "\n" not in "".join(pieces)
        self.units = (lambda s: [s]) if inner else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def __reduce__(self):
        return PieceModel, (self.pieces, self.byte_fallback, self.prefix)

    def _fallback(self, c: str) -> int:
        return len(c.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kind, norm, spec = m.SentencePiece, m.normalizer_spec, m.trainer_spec
        rules = {
            "model type": spec.model_type == spec.BPE,
            "normaliser": not (norm.precompiled_charsmap or norm.normalization_rule_tsv or norm.remove_extra_whitespaces) and norm.escape_whitespaces,
            "white space as a suffix": not spec.treat_whitespace_as_suffix,
            "user-defined pieces": all(p.type != kind.USER_DEFINED for p in m.pieces),
        }
        if unknown := [k for k, ok in rules.items() if not ok]:
            raise ValueError(f"{path}: not supported: {', '.join(unknown)}")
        return cls({p.piece: p.score for p in m.pieces if p.type == kind.NORMAL}, spec.byte_fallback, norm.add_dummy_prefix)

    def cut(self, unit: str) -> list[str]:
        """Parts that no merge joins."""
        at = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.pairs]
        return [unit[a:b] for a, b in zip([0, *at], [*at, len(unit)], strict=True)] if at else [unit]

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (BIG: none) and result of pairs."""
        if not len(self.keys):
            return np.full(len(a), BIG), np.zeros(len(a), np.int64)
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], BIG), self.made[at]

    def count(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit."""
        out = np.zeros(len(units), np.int64)
        parts, owner = [], []
        for i, u in enumerate(units):
            for p in self.cut(u):
                if len(p) == 1:
                    out[i] += self.cost[self.ids[p]] if p in self.ids else self._fallback(p)
                else:
                    parts.append(p)
                    owner.append(i)
        if parts:
            np.add.at(out, owner, self._count_together(parts))
        return out

    def _count_together(self, parts: list[str]) -> np.ndarray:
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        sym = np.fromiter((self.ids.get(c, -self._fallback(c)) for p in parts for c in p), np.int64, int(size.sum()))
        who = np.repeat(np.arange(len(parts)), size)
        total = np.zeros(len(parts), np.int64)
        rank = np.full(len(sym), BIG)
        made = np.zeros(len(sym), np.int64)
        same = np.flatnonzero(who[1:] == who[:-1])
        rank[same], made[same] = self.lookup(sym[same], sym[same + 1])
        while len(sym):
            heads = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            span = np.diff(np.append(heads, len(sym)))
            over = np.repeat(best == BIG, span)
            if over.any():  # these are through
                np.add.at(total, who[over], np.where(sym[over] >= 0, self.cost[np.maximum(sym[over], 0)], -sym[over]))
                sym, who, rank, made, best, span = sym[~over], who[~over], rank[~over], made[~over], best[best != BIG], span[best != BIG]
                if not len(sym):
                    break
            hit, stuck = self._hits(np.flatnonzero(rank == np.repeat(best, span)), sym, who, rank, made)
            new = made[hit]
            sym[hit] = new
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            anew = [hit, hit - 1]
            for u in stuck.tolist():
                a, b = np.searchsorted(who, [u, u + 1])
                left = self._walk(sym[a:b], rank[a:b])
                keep[a:b] = False
                at = a + np.array([i for i, _ in left])
                keep[at] = True
                sym[at] = [x for _, x in left]
                anew.append(at)
            touched = np.concatenate(anew)
            touched = (np.cumsum(keep) - 1)[touched[touched >= 0]]
            sym, who, rank, made = sym[keep], who[keep], rank[keep], made[keep]
            rank[touched] = BIG
            touched = touched[touched + 1 < len(sym)]
            touched = touched[who[touched] == who[touched + 1]]
            rank[touched], made[touched] = self.lookup(sym[touched], sym[touched + 1])
        return total

    def _hits(self, hit: np.ndarray, sym: np.ndarray, who: np.ndarray, rank: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places to merge, of those that have their unit's lowest rank, and the units that have to walk instead."""
        i = np.arange(len(hit))
        head = np.append(True, hit[1:] != hit[:-1] + 1)
        hit = hit[(i - np.maximum.accumulate(np.where(head, i, 0))) % 2 == 0]  # of overlapping places every other one
        unit = who[hit]
        first = np.append(True, unit[1:] != unit[:-1])
        if first.all():
            return hit, unit[:0]
        # Pairs as they are when the places before are merged and those behind are not.
        new, n = made[hit], len(sym)
        left = sym[hit - 1]
        near = np.flatnonzero(~first & (np.append(-2, hit[:-1]) == hit - 2))
        left[near] = new[near - 1]
        right = np.minimum(hit + 2, n - 1)
        last = np.append(first[1:], True)  # after the last place the next round goes on
        low = np.zeros(len(hit), bool)
        for ok, a, b in (((hit > 0) & (who[hit - 1] == unit) & ~last, left, new), ((hit + 2 < n) & (who[right] == unit) & ~last, new, sym[right])):
            k = np.flatnonzero(ok)
            low[k] |= self.lookup(a[k], b[k])[0] <= rank[hit[k]]
        stuck = np.unique(unit[low])
        return (hit[~np.isin(unit, stuck)], stuck) if len(stuck) else (hit, stuck)

    def _walk(self, symbols: np.ndarray, ranks: np.ndarray) -> list[tuple[int, int]]:
        """One unit's places of the lowest rank in sequential order, with what they give rise to: (place, symbol) of all that is left."""
        table = getattr(self, "_table", None)
        if table is None:
            table = self._table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        sym, n, most = symbols.tolist(), len(symbols), int(ranks.min())
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(most, i, sym[i], sym[i + 1]) for i in np.flatnonzero(ranks == most).tolist()]  # ascending, so a heap

        def push(i: int, j: int) -> None:
            if sym[i] >= 0 and sym[j] >= 0 and (x := table.get((sym[i] << 32) | sym[j])) and x[0] <= most:
                heapq.heappush(queue, (x[0], i, sym[i], sym[j]))

        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # the pair has changed since
            sym[i] = table[(a << 32) | b][1]
            sym[j] = None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                push(i, nxt[i])
            if prv[i] >= 0:
                push(prv[i], i)
        return [(i, x) for i, x in enumerate(sym) if x is not None]

    def split(self, text: str) -> list[str]:
        return self.units((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else []


_CACHES: dict[str, tuple[PieceModel, WordCache]] = {}


def _cached(path: str) -> tuple[PieceModel, WordCache]:
    if path not in _CACHES:
        model = PieceModel.load(path)
        _CACHES[path] = model, WordCache(model.count)
    return _CACHES[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes, n_tokens, over_limit."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = _cached(path)
        for ids, texts in texts_of(batches):
            numbers = cache.number(map(model.split, texts))
            counts = cache.results()
            n = [int(counts[x].sum()) if len(x) else 0 for x in numbers]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": [x > limit for x in n]})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
