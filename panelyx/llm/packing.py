"""Packing documents into token sequences: cutting-stock column generation.

A document's ids, with the separator id after them, are cut into pieces of SEQUENCE = 1024 and one remainder. Full pieces
are sequences of their own; remainders are packed. The histogram of remainder lengths (at most 1023 rows, the only thing
the driver sees) is a cutting-stock problem. Its linear program over patterns starts from patterns of a single length;
in each round the program's dual prices go into a knapsack by dynamic programming over 0..1024, whose solution is the
pattern of least reduced cost, and enters the basis. Rounds end when no pattern prices out, when the bound that the
knapsack's value gives is within GAP of the program's value, or after ROUNDS. Pattern counts are rounded down, patterns
of large fractions are taken once more, and the program is solved again for the pieces that are left until none is. So
every sequence is a pattern of a program's basis; best-fit patterns only start a program.

Patterns meet documents through ranks: within a length documents are ranked by id, pattern j takes a range of ranks of
each of its lengths, and sequence and offset follow from the rank by arithmetic. Ranks come in two steps, so that a
length that a third of the rows have is not one task's work, nor an id that they share: a rank inside (bucket of id and
content, length), plus the length's count in the buckets before.

Null texts count as empty (the separator only); null ids and repeated rows are packed each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import materialise, parallelism, short_batches, table, trim

SEQUENCE, SEPARATOR = 1024, 0
GAP, ROUNDS, SHRUNK = 0.001, 6_000, 5_000
#: The share of the fractions' sum that is taken by rounding up before the program is solved again.
ROUND_UP = 0.3


# ---- tokens


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write bytes as characters: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_tokenizer(path: str, pattern: str | None) -> Callable[[str], np.ndarray]:
    """Text -> ids, as the tokenizers library gives them for the file without added special tokens.

    A byte-level BPE file whose ids are its merge order is run by tiktoken, several times faster and with equal ids;
    any other file, and any text that fails there, by tokenizers.
    """
    held: list = []  # the library's own tokenizer takes much memory and is only made where it is used

    def slow(text: str) -> np.ndarray:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return np.array(held[0].encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    if model.get("type", "BPE") != "BPE" or not pattern or spec.get("normalizer") or any(x.get(k) for x in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        return slow
    at = byte_of_char()
    try:
        ranks = {bytes(map(at.__getitem__, t)): i for t, i in model["vocab"].items() if t not in added}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [model["vocab"][m] for m in merged]
    except KeyError:
        return slow
    if order != sorted(order) or len(ranks) != 256 + len(merged):
        return slow
    import tiktoken

    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # its pattern engine gives up on some very long runs
            return slow(text)

    return encode


_TOKENIZERS: dict = {}


def tokenizer(path: str, pattern: str | None) -> Callable[[str], np.ndarray]:
    """One for each worker process."""
    if (path, pattern) not in _TOKENIZERS:
        _TOKENIZERS[path, pattern] = load_tokenizer(path, pattern)
    return _TOKENIZERS[path, pattern]


def with_separator(ids: np.ndarray) -> np.ndarray:
    return np.append(ids, SEPARATOR).astype("<u4")


def measure(docs: DataFrame, path: str, pattern: str | None) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, doc_tokens, crcs (of each piece's ids as little-endian unsigned 32-bit numbers)."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in texts_of(batches):
            sizes, crcs = [], []
            for t in texts:
                ids = with_separator(tokenizer(path, pattern)(t)).tobytes()
                sizes.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[a : a + 4 * SEQUENCE]) for a in range(0, len(ids), 4 * SEQUENCE)])
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


# ---- the cutting-stock program


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int, most: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Best value of a pattern, and how often it takes each length: at most `most` times (None: as often as it fits)."""
    fit = capacity // lengths if most is None else np.minimum(capacity // lengths, most)
    items = []  # (length's place, how many of it): doublings that add up to any number up to the most
    for i in np.flatnonzero((prices > 1e-12) & (fit > 0)).tolist():
        n, step = int(fit[i]), 1
        while n > 0:
            items.append((i, min(step, n)))
            n -= step
            step *= 2
    best = np.zeros(capacity + 1)
    took = np.zeros((len(items), capacity + 1), bool)
    for k, (i, n) in enumerate(items):
        w = int(lengths[i]) * n
        with_it = best[:-w] + prices[i] * n
        np.greater(with_it, best[w:], out=took[k, w:])
        np.maximum(with_it, best[w:], out=with_it)
        best[w:] = with_it
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    for k in range(len(items) - 1, -1, -1):
        if took[k, c]:
            i, n = items[k]
            pattern[i] += n
            c -= int(lengths[i]) * n
    return float(best[capacity]), pattern


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, known: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """Patterns of the linear program's last basis with their values: least sum of values that covers the demand.

    No pattern takes more of a length than there is. known: patterns that are priced first; the knapsack makes a new
    one, which joins them, once none of them prices out.
    """
    m = len(lengths)
    most = np.minimum(capacity // lengths, demand)
    columns = np.diag(most).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    pool = np.array(known, float).reshape(-1, m)
    # A slight shake of the demand keeps ties, and with them cycles, away; the true demand gives the values at the end.
    shaken = demand + 1e-3 * np.random.default_rng(0).random(m)
    x = inverse @ shaken
    prices = inverse.sum(0)
    least = float(lengths @ shaken) / capacity  # no packing needs less
    for _ in range(ROUNDS):
        if x.sum() <= (1 + GAP) * least:
            break
        values = pool @ prices
        i = int(values.argmax()) if len(pool) else -1
        if i >= 0 and values[i] > 1 + 1e-7:
            pattern = pool[i]
        else:
            value, taken = knapsack(lengths, np.maximum(prices, 0), capacity, most)
            if value <= 1 + 1e-9 or x.sum() <= (1 + GAP) * (prices @ shaken) / value:
                break
            pattern = taken.astype(float)
            known.append(taken)
            pool = np.vstack([pool, pattern])
        some = np.flatnonzero(pattern)
        u = inverse[:, some] @ pattern[some]
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        row = inverse[out] / u[out]
        prices = prices + (1 - prices @ pattern) * row
        u[out] -= 1
        rows, cols = np.flatnonzero(np.abs(u) > 1e-12), np.flatnonzero(np.abs(row) > 1e-12)
        if 2 * len(rows) * len(cols) < m * m:  # the basis is sparse at first
            inverse[np.ix_(rows, cols)] -= np.outer(u[rows], row[cols])
        else:
            inverse -= np.outer(u, row)
        x -= u * ratio[out]
        columns[:, out] = pattern
    x = np.maximum(inverse @ demand, 0)
    return [(columns[:, j].astype(np.int64), float(x[j])) for j in range(m)]


def best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Longest first, each into the fullest bin it fits. Returns patterns (sorted tuples) with counts."""
    room: dict[int, list[list[int]]] = {}
    for n in sorted(left, reverse=True):
        for _ in range(left[n]):
            r = next((r for r in range(n, capacity) if room.get(r)), capacity)
            bin_ = room[r].pop() if r < capacity else []
            bin_.append(n)
            room.setdefault(r - n, []).append(bin_)
    return Counter(tuple(sorted(b, reverse=True)) for bins in room.values() for b in bins)


def plan(histogram: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[dict[int, int], int]]:
    """(pattern: length -> pieces, how many sequences) for each pattern; together exactly the histogram.

    The program's values are rounded down; then its patterns are taken once more each, from the largest fraction on, as
    long as all their pieces are left. The program is solved again for what is left, until nothing is.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if n > 0 and c > 0), np.int64)
    left = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    out: Counter = Counter()
    known: list[np.ndarray] = []
    while len(lengths):
        # A heuristic's patterns for the same proportions, of at most SHRUNK pieces, start the program.
        small = np.maximum(left * min(1.0, SHRUNK / left.sum()), 1).astype(int)
        at = {int(n): i for i, n in enumerate(lengths)}
        for p in best_fit(dict(zip(lengths.tolist(), small.tolist(), strict=True)), capacity):
            known.append(np.bincount([at[n] for n in p], minlength=len(lengths)))
        found = column_generation(lengths, left, capacity, known)

        def use(pattern: np.ndarray, times: int) -> bool:
            taken = np.flatnonzero(pattern)
            times = min(times, int((left[taken] // pattern[taken]).min())) if len(taken) else 0
            if times > 0:
                out[tuple((int(lengths[i]), int(pattern[i])) for i in taken[::-1])] += times
                left[taken] -= pattern[taken] * times
            return times > 0

        for pattern, x in found:
            use(pattern, int(x + 1e-6))
        # The largest fractions come next; rounding up all would use up the small pieces that the large ones need.
        parts = sorted(((f[1] + 1e-6) % 1, j) for j, f in enumerate(found) if f[1] > 1e-6)[::-1]
        more = max(1, int(ROUND_UP * sum(f for f, _ in parts)))
        for _, j in parts:
            more -= more > 0 and use(found[j][0], 1)
        rest = left > 0
        known = [p[rest] for p in known if not p[~rest].any() and (p[rest] <= left[rest]).all()]
        lengths, left = lengths[rest], left[rest]
    return [(dict(p), c) for p, c in sorted(out.items(), reverse=True)]


def rank_ranges(patterns: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple]]:
    """length -> (first rank, past the last, pieces per sequence, first sequence, first offset) of each pattern that has it."""
    out: dict[int, list[tuple]] = {}
    taken: Counter = Counter()
    base = 0
    for used, times in patterns:
        offset = 0
        for n in sorted(used, reverse=True):
            a = used[n]
            out.setdefault(n, []).append((taken[n], taken[n] + a * times, a, base, offset))
            taken[n] += a * times
            offset += a * n
        base += times
    return out


# ---- documents


def pack(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, one row a piece."""
    spark = docs.sparkSession
    m = materialise(measure(docs, path, pattern), "pieces").withColumn("rest", (F.col("doc_tokens") % SEQUENCE).cast("int")).withColumn("full", F.col("doc_tokens").cast("long") - F.col("rest"))
    m = m.withColumn("full", (F.col("full") / SEQUENCE).cast("long")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(4 * parallelism(spark))).cast("int"))
    counts = m.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
    histogram = {r.rest: (r.n, r.f) for r in counts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).collect()}  # at most SEQUENCE rows
    patterns = plan({n: c[0] for n, c in histogram.items()})
    next_id = sum(t for _, t in patterns)
    ranges = rank_ranges(patterns)
    rows = []
    for n, (_, f) in sorted(histogram.items()):
        rows.append((n, next_id, ranges.get(n, [])))
        next_id += f
    spec = "rest int, full_base long, ranges array<struct<lo: long, hi: long, per: long, base: long, offset: long>>"
    plan_ = spark.createDataFrame(rows, spec)  # at most SEQUENCE rows; ranges as many as the patterns' different lengths

    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("rest", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"))
    own = Window.partitionBy("rest", "bucket").orderBy("doc_id", "doc_tokens", "crcs")
    ranked = (
        m.withColumn("rank", F.row_number().over(own) - 1)
        .withColumn("f1", F.coalesce(F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(starts, ["rest", "bucket"])
        .join(F.broadcast(plan_), "rest")
        .withColumn("rank", F.col("rank") + F.col("n0"))
        .withColumn("at", F.expr("get(filter(ranges, x -> x.lo <= rank and rank < x.hi), 0)"))
        .withColumn("full_base", F.col("full_base") + F.col("f0") + F.col("f1"))
    )
    pieces = ranked.select("doc_id", "doc_tokens", "rest", "full", "full_base", "rank", "at", F.posexplode("crcs").alias("k", "ids_crc32"))
    whole = F.col("k") < F.col("full")
    t = F.col("rank") - F.col("at.lo")
    return pieces.select(
        "doc_id",
        (F.col("k") * SEQUENCE).cast("long").alias("start"),
        F.when(whole, F.lit(SEQUENCE)).otherwise(F.col("rest")).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(whole, F.col("full_base") + F.col("k")).otherwise(F.col("at.base") + F.floor(t / F.nullif(F.col("at.per"), F.lit(0)))).cast("long").alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("at.offset") + F.pmod(t, F.nullif(F.col("at.per"), F.lit(0))) * F.col("rest")).cast("long").alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
