"""Language identification: word-first backoff.

Fitting counts words and character n-grams (1 to 4, of words padded with "_") per language in a bounded sample of
labelled rows: those with the smallest hashes of their id, at most TRAIN_DOCS rows and TRAIN_CHARS characters, both
shared evenly by the languages (what rare languages leave of the rows goes to the others; one row each at least). Of
texts that are too long together the longest are learned from their beginnings, so that none displaces others. The model
keeps every word and n-gram that the sample holds more than once; one task reads the sample and fits. A word of the
model scores its log frequency in each language (add-one smoothed). An unseen word falls back to its 4-grams; a place
where the 4-gram is unknown falls to the 3-gram, then the 2-gram, then the single character; the word scores the mean
over places. A text scores the sum over its words, and the probabilities follow by Bayes with equal priors.

The probability says which of the learned languages, not whether it is one of them: some language always fits best. So
keep_known also asks for evidence: the share of the text's words that are known, where an unseen word counts by the
share of its places at which a 3- or 4-gram is known.

Results: `und` with score 0 for a null text, a text without a letter, or when nothing was learned; else the most likely
language (of equals the first in order) and its probability. Rows of null language are never learned from; null ids and
repeated rows are kept; an empty table gives an empty result; other columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import texts_of
from .common import crc32_of_id, materialise, short_batches, table, trim
from .words import WordCache

TRAIN_DOCS, TRAIN_CHARS = 6_000, 20_000_000
#: Least evidence of a text in a learned language.
EVIDENCE = 0.5
UNKNOWN = "und"
words_of = re.compile(r"[^\W\d_]+").findall


def first_ids(rows: DataFrame, most: int) -> DataFrame:
    """rows: doc_id, label. The ids of the smallest hashes, at most so many; no text is read for it."""
    return rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)


def share(sizes: list[int], most: int) -> int:
    """The largest bound for which min(size, bound) sums to at most `most` (1 at least; the largest size if all fits)."""
    left = most
    for k, n in enumerate(x := sorted(sizes)):
        if n * (len(x) - k) > left:
            return max(left // (len(x) - k), 1)
        left -= n
    return max([1, *x[-1:]])


def first_ids_of_each(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """rows: doc_id, label. (ids of the smallest hashes of each label, at most so many in all, number of labels)."""
    rows = rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "label").distinct().withColumn("h", F.xxhash64("doc_id"))
    counts = rows.groupBy("label").count().collect()
    quota = share([r["count"] for r in counts], most)
    # Hashes are even over the longs: those below `upto` are few, and enough but for a chance of less than 1e-9.
    want = quota + 8 * quota**0.5 + 40
    upto = [(r.label, int(min(want / r["count"], 1.0) * (2**64 - 2**12)) - 2**63 if want < r["count"] else 2**63 - 1) for r in counts]
    bound = rows.sparkSession.createDataFrame(upto, T.StructType([T.StructField("label", rows.schema["label"].dataType), T.StructField("upto", T.LongType())]))
    near = rows.join(F.broadcast(bound), "label").filter("h <= upto")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= quota).select("doc_id", "label"), len(counts)


def sample(docs: DataFrame, ids: DataFrame, most: dict) -> DataFrame:
    """(text, label) of the ids' rows: per label at most `rows` of them and `chars` characters (but one a row), of longer
    texts the beginning. most: label (None: any other) -> (rows, chars).

    ids: doc_id, label, a bounded number; of an id with many rows only so many are taken. The documents are scanned once;
    their rows go to a table in the shared folder, of which the driver sees the lengths.
    """
    limit = lambda label, at: most.get(label, most.get(None, (0, 0)))[at]
    found = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= max(n for n, _ in most.values()))
    found = materialise(found.withColumn("n", F.char_length("text")), "sample")
    sizes: dict = {}
    for r in found.select("label", "n", "rank").collect():
        if r.rank <= limit(r.label, 0):
            sizes.setdefault(r.label, []).append(r.n)
    bounds = [(label, len(n), share(n, limit(label, 1))) for label, n in sizes.items()]
    if not bounds:
        return found.select("text", "label").limit(0)
    rows, chars = (F.create_map(*(F.lit(x) for b in bounds for x in (b[0], b[i])))[F.col("label")] for i in (1, 2))
    return found.filter(F.col("rank") <= rows).select(F.expr("text").substr(F.lit(1), chars).alias("text"), "label")


def fit_in_task(rows: DataFrame, fit: Callable[[list[tuple]], object]):
    """The model that one task fits to all rows (a bounded number), in an order of its own; None where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]:
            model = pickle.dumps(fit(sorted(got)))
            del got
            trim()
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    short_batches(rows.sparkSession)
    got = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else None


class BackoffModel:
    """languages; words and grams: text -> row of `table`, which holds log frequencies per language; floor: of unknown grams."""

    def __init__(self, languages: list, words: dict, grams: dict, table_: np.ndarray, floor: np.ndarray):
        self.languages, self.words, self.grams, self.table, self.floor = languages, words, grams, table_, floor

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> BackoffModel:
        languages = sorted({label for _, label in rows})
        by = {x: Counter() for x in languages}
        for text, label in rows:
            by[label].update(words_of(text.lower()))
        parts = {x: Counter() for x in languages}
        for x, c in by.items():
            for w, n in c.items():
                for g in cls.grams_of(w):
                    parts[x][g] += n

        def table_of(counts: dict) -> tuple[list, np.ndarray, np.ndarray]:
            kept = sorted(k for k, n in sum(counts.values(), Counter()).items() if n > 1)
            totals = np.array([sum(counts[x].values()) + len(kept) + 1 for x in languages], float)
            seen = np.array([[counts[x][k] for x in languages] for k in kept], float).reshape(len(kept), len(languages))
            return kept, np.log((seen + 1) / totals), -np.log(totals)

        w, of_words, _ = table_of(by)
        g, of_grams, floor = table_of(parts)
        return cls(languages, {k: i for i, k in enumerate(w)}, {k: i + len(w) for i, k in enumerate(g)}, np.concatenate([of_words, of_grams]).astype(np.float32), floor)

    @staticmethod
    def grams_of(word: str) -> Iterator[str]:
        p = f"_{word}_"
        for n in (1, 2, 3, 4):
            for i in range(len(p) - n + 1):
                yield p[i : i + n]

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row for each word: its score in each language, and the evidence for it (0 to 1)."""
        out = np.empty((len(words), len(self.languages) + 1))
        known, grams, rows = self.words.get, self.grams.get, self.table
        for k, w in enumerate(words):
            i = known(w)
            if i is not None:
                out[k, :-1], out[k, -1] = rows[i], 1.0
                continue
            p = f"_{w}_"
            found, missed, long = [], 0, 0
            for i in range(len(p) - 1):
                for n in (4, 3, 2, 1):
                    g = grams(p[i : i + n]) if i + n <= len(p) else None
                    if g is not None:
                        found.append(g)
                        long += n > 2
                        break
                else:
                    missed += 1
            out[k, :-1] = (rows[found].sum(0) + missed * self.floor) / (len(p) - 1)
            out[k, -1] = long / max(len(p) - 2, 1)  # the last place holds no 3-gram
        return out

    def judge(self, texts: list[str | None], cache: WordCache) -> Iterator[tuple[str, float, float]]:
        """(language, probability, evidence) of each text."""
        if not self.languages:
            yield from [(UNKNOWN, 0.0, 0.0)] * len(texts)
            return
        numbers = cache.number(words_of((t or "").lower()) for t in texts)
        table_ = cache.results()
        for t, x in zip(texts, numbers, strict=True):
            if not len(x) or not any(map(str.isalpha, t)):
                yield UNKNOWN, 0.0, 0.0
                continue
            s = table_[x].sum(0)
            s, evidence = s[:-1], float(s[-1]) / len(x)
            best = int(s.argmax())
            yield self.languages[best], float(1 / np.exp(s - s[best]).sum()), evidence

    def predict(self, texts: list[str | None], cache: WordCache) -> tuple[list, list]:
        langs, scores, _ = map(list, zip(*self.judge(texts, cache), strict=True)) if texts else ([], [], [])
        return langs, scores


_CACHES: dict = {}


def cached(key: str, model) -> WordCache:
    """One cache for each model and worker process."""
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = WordCache(model.score_words)
    return _CACHES[key]


def learn(docs: DataFrame, chosen: Column) -> BackoffModel:
    """docs: doc_id, text, lang; learns from the chosen rows of known language."""
    rows = docs.filter(chosen & F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("label"))
    ids, languages = first_ids_of_each(rows, TRAIN_DOCS)
    rows = sample(docs, ids, {None: (max(TRAIN_DOCS // max(languages, 1), 1) * 2, TRAIN_CHARS // max(languages, 1))})
    return fit_in_task(rows, BackoffModel.fit) or BackoffModel.fit([])


def held_out(doc_id: str = "doc_id") -> Column:
    return crc32_of_id(doc_id) % 3 == 1


def predict_language(docs: DataFrame, model: BackoffModel) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, lang_pred, score."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most the different words and n-grams of TRAIN_CHARS characters
    key = f"language-{uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in texts_of(batches):
            langs, scores = shared.value.predict(texts, cached(key, shared.value))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})
        cached(key, shared.value).release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: BackoffModel, least: float = 0.5, evidence: float = EVIDENCE) -> DataFrame:
    """The rows of docs (all its columns) in a learned language: found with at least this probability, on this evidence."""
    spark = docs.sparkSession
    short_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")
    key = f"language-{uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.judge(b.column(at).to_pylist(), cached(key, shared.value))
            yield b.filter(pa.array([x != UNKNOWN and s >= least and e >= evidence for x, s, e in found], pa.bool_()))
        cached(key, shared.value).release()

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs, learn(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
