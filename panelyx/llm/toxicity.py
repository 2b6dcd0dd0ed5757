"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are the word and its character n-grams of 3 to 5 (padded with "<" and ">"), hashed into BUCKETS rows
of an embedding table; a misspelt or unseen word thus shares n-gram vectors with known ones. A word's vector is the mean
of its features', a text's vector the mean of its words' times SCALE (a constant that the softmax would have to learn
otherwise); a softmax over two classes follows. Embeddings and softmax are trained together by full-batch Adam on a
bounded sample of labelled rows, those with the smallest hashes of their id: at most TRAIN_DOCS rows and TRAIN_CHARS
characters of class 1 (of texts that are too long together the longest are learned from their beginnings, so that none
displaces others), and NEGATIVES times that of class 0; the bias is then set to the odds of all labels. The sample is
read by one task, which trains; the driver gets the model only. As the model is linear in the mean, a text's score needs
one number a word, which is cached.

Results: a score for every row; a null or wordless text scores what the bias gives; a model without rows of both classes
scores the share of class 1 (0.0 without labels). Null labels are not learned from. Null ids and repeated rows are kept;
an empty table gives an empty result; other columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import crc32_of_id, short_batches, table
from .language import cached, first_ids, fit_in_task, sample, words_of
from .words import WordCache

#: Rows and characters of class 1, and how many times that of class 0.
TRAIN_DOCS, TRAIN_CHARS, NEGATIVES = 1_200, 4_000_000, 2
BUCKETS, DIM, SCALE, STEPS, RATE, DECAY = 1 << 17, 8, 200.0, 120, 0.05, 3e-5
#: Entries of a sparse matrix that are gathered at a time.
PORTION = 200_000


def features(word: str) -> list[int]:
    w = f"<{word}>"
    out = [crc32(w.encode("utf-8", "surrogatepass"))]
    for n in (3, 4, 5):
        for i in range(len(w) - n + 1):
            if n < len(w):
                out.append(crc32(w[i : i + n].encode("utf-8", "surrogatepass")))
    return [x % BUCKETS for x in out]


class _Mean:
    """A sparse matrix of weighted means, applied forwards and backwards by gathers and ordered sums, some entries at a time."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, n_rows: int):
        """rows ascend; every row and column that occurs has entries."""
        self.n_rows = n_rows
        self.ahead = self._ordered(rows, cols, weight)
        back = np.argsort(cols, kind="stable").astype(np.int32)
        self.behind = self._ordered(cols[back], rows[back], weight[back])
        self.used = self.behind[0]

    @staticmethod
    def _ordered(of: np.ndarray, take: np.ndarray, weight: np.ndarray) -> tuple:
        """(what occurs in `of`, where its entries begin, what they take, their weights, limits of the portions)."""
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        limits = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(of), PORTION)), len(starts)))
        return of[starts], np.append(starts, len(of)), take, weight[:, None], limits

    @staticmethod
    def _sums(x: np.ndarray, ordered: tuple) -> np.ndarray:
        of, starts, take, weight, limits = ordered
        out = np.empty((len(of), x.shape[1]), np.float32)
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
            lo, hi = starts[a], starts[b]
            out[a:b] = np.add.reduceat(x[take[lo:hi]] * weight[lo:hi], starts[a:b] - lo, axis=0)
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_rows, x.shape[1]), np.float32)
        out[self.ahead[0]] = self._sums(x, self.ahead)
        return out

    def backward(self, g: np.ndarray) -> np.ndarray:
        """Gradients of the used columns."""
        return self._sums(g, self.behind)


class SubwordModel:
    def __init__(self, embedding: np.ndarray, weight: np.ndarray, bias: float):
        self.embedding, self.weight, self.bias = embedding, weight, bias
        self.score_of = embedding @ weight * SCALE  # of each bucket, for class 1 against class 0

    def __reduce__(self):
        return SubwordModel, (self.embedding, self.weight, self.bias)

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], odds: float | None = None, seed: int = 0) -> SubwordModel:
        """odds: of class 1 among all labels, of which rows are a sample with other odds (None: the same)."""
        number: dict[str, int] = {}
        cols, share_of, n, labels = array("i"), array("f"), [], []
        for t, y in rows:
            if c := Counter(words_of(t.lower())):
                cols.extend(number.setdefault(w, len(number)) for w in c)
                total = sum(c.values())
                share_of.extend(SCALE * v / total for v in c.values())
                n.append(len(c))
                labels.append(y)
        share = sum(labels) / len(labels) if labels else 0.0
        if not 0 < share < 1:
            return cls(np.zeros((BUCKETS, DIM), np.float32), np.zeros(DIM, np.float32), 40.0 if share else -40.0)
        flat, size = array("i"), array("i")
        for w in number:
            f = features(w)
            flat.extend(f)
            size.append(len(f))
        m = len(number)
        cols, share_of, flat, size = (np.array(x) for x in (cols, share_of, flat, size))
        number.clear()
        words = _Mean(np.repeat(np.arange(m, dtype=np.int32), size), flat, np.repeat((1 / size).astype(np.float32), size), m)
        del flat
        texts = _Mean(np.repeat(np.arange(len(n), dtype=np.int32), n), cols, share_of, len(n))
        y = np.array(labels)

        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        emb[np.setdiff1d(np.arange(BUCKETS), words.used)] = 0
        out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
        bias = np.zeros(2, np.float32)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, bias)]
        hit = np.eye(2, dtype=np.float32)[y]
        for step in range(1, STEPS + 1):
            vec = texts.forward(words.forward(emb))
            z = vec @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - hit) / len(y)
            g_word = np.zeros((m, DIM), np.float32)
            g_word[texts.used] = texts.backward(g @ out.T)
            g_emb = DECAY * emb
            g_emb[words.used] += words.backward(g_word)
            for p_, (mean, v), d in zip((emb, out, bias), state, (g_emb, vec.T @ g + DECAY * out, g.sum(0)), strict=True):
                mean += 0.1 * (d - mean)
                v += 0.01 * (d * d - v)
                p_ -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        shift = np.log(odds / (share / (1 - share))) if odds else 0.0
        return cls(emb, out[:, 1] - out[:, 0], float(bias[1] - bias[0] + shift))

    def score_words(self, words: list[str]) -> np.ndarray:
        feats = [features(w) for w in words]
        size = np.fromiter(map(len, feats), np.int64, len(feats))
        flat = self.score_of[np.fromiter((x for f in feats for x in f), np.int64, int(size.sum()))]
        return np.add.reduceat(flat, np.cumsum(size) - size) / size if len(words) else np.zeros(0)

    def score(self, texts: list[str | None], cache: WordCache) -> list[float]:
        numbers = cache.number(words_of((t or "").lower()) for t in texts)
        s = cache.results()
        z = [self.bias + (float(s[x].mean()) if len(x) else 0.0) for x in numbers]
        return [float(1 / (1 + np.exp(-np.clip(v, -700, 700)))) for v in z]


def learn(docs: DataFrame, labels: DataFrame, chosen: Column) -> SubwordModel:
    """docs: doc_id, text; labels: doc_id, toxic. Learns from the chosen labelled rows."""
    known = labels.filter(chosen).select("doc_id", F.col("toxic").alias("label")).filter("label in (0, 1)")
    most = {0: TRAIN_DOCS * NEGATIVES, 1: TRAIN_DOCS}
    ids = [first_ids(known.filter(F.col("label") == y), n) for y, n in most.items()]
    rows = sample(docs, ids[0].unionByName(ids[1]), {y: (n, TRAIN_CHARS * n // TRAIN_DOCS) for y, n in most.items()})
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    odds = counts[1] / counts[0] if len(counts) == 2 else None
    return fit_in_task(rows, lambda x: SubwordModel.fit(x, odds)) or SubwordModel.fit([])


def held_out(doc_id: str = "doc_id") -> Column:
    return crc32_of_id(doc_id) % 5 == 0


def score_toxicity(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, score, predicted."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x DIM floats
    key = f"toxicity-{uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in texts_of(batches):
            s = shared.value.score(texts, cached(key, shared.value))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in s], pa.int32())})
        cached(key, shared.value).release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: SubwordModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs (all its columns) whose text scores below the threshold."""
    spark = docs.sparkSession
    short_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")
    key = f"toxicity-{uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = shared.value.score(b.column(at).to_pylist(), cached(key, shared.value))
            yield b.filter(pa.array([x < threshold for x in scores], pa.bool_()))
        cached(key, shared.value).release()

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score_toxicity(docs, learn(docs, labels, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
