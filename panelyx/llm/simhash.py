"""SimHash near-duplicates with a generalised pigeonhole index.

Fingerprint. A-Z are lower-cased, words are runs of [^\\x20\\x09-\\x0D], shingles are 3 consecutive words joined by single
spaces, repeats included (fewer words: the whole sequence; none: fingerprint 0). h is XXH64 of the shingle's UTF-8 bytes
with seed 42; a bit is set if it is set in over half of the h.

Links join fingerprints that differ in at most tau bits (TAU = 3 unless said otherwise). The index works on distinct fingerprints only (a group of
equal texts is one row). Bits are grouped into parts so that correlated bits, measured on a bounded sample, share a part:
such bits carry little selectivity apart. Two fingerprints within tau must, for some part i, differ there in at most t_i
bits whenever sum(t_i + 1) = tau + 1 (t_i = -1 skips a part). The t_i come from dynamic programming over candidate
counts that are estimated from the sample's distance distribution in each part, scaled to the whole table, plus the
signatures that a part's radius needs. Each fingerprint is put into the buckets of its part values within t_i
(enumerated), and candidates of a bucket are verified on all 64 bits in numpy. A bucket is cut into blocks of BLOCK rows
and pairs of blocks are tasks of their own, so no bucket lands in one task; what leaves a task is a spanning forest of
the links found in all its buckets, not all of them, and of the links between two blocks only those that join what the
blocks' own links leave apart: a bucket of copies gives about a link a row and one a pair of blocks. Comparing all pairs of a bucket is quadratic, so fingerprints of a bucket of over
DENSE rows are linked in another way, which is linear and as exact: each goes to all 64-bit values within b bits, and at
each value all that have come are linked to the smallest of those within a bits, where a + b = tau and a is half of it.
Such links span at most tau bits, and two fingerprints within tau bits have a value between them that is within a bits of
the one and b of the other; a value has at most as many visitors as there are values within b bits (2,081 for tau = 3),
whatever the table's size.
Components follow from links (graph.components), whose vertices are numbered by
fingerprint; a component's id is its smallest doc_id.

Null texts count as empty; null ids link like others and are kept with a null component only if no row of it has an id,
else its id; repeated rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, short_batches, shuffled, table, trim
from .graph import components

TAU, SHINGLE, SEED = 3, 3, 42
SAMPLE, BLOCK, PARTS = 4_000, 2_048, (2, 3, 4)
#: Rows of a bucket beyond which 2,081 values a row cost less than comparing all pairs.
DENSE = 256 * BLOCK
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    words = _words((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end + 1 - size
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(start[: len(start) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 100_000):
        ones += np.unpackbits(h[lo : lo + 100_000].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, fp (the 64 bits as a signed long), row (the long of that column, if one is named)."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(1)], names=["doc_id", "fp", "row"])
        trim()

    number = F.col(row) if row else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long"), number, "text").mapInArrow(run, "doc_id long, fp long, row long")


# ---- the index: parts and thresholds


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), bitorder="little").reshape(-1, 64)


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of equal size: each is seeded with the free bit of most variance and takes the bits most correlated with it."""
    x = bits.astype(float)
    x -= x.mean(0)
    sd = x.std(0)
    corr = np.abs(x.T @ x / max(len(x), 1)) / np.maximum(np.outer(sd, sd), 1e-9)
    free, out = list(range(64)), []
    for p in range(parts):
        take = len(free) // (parts - p)
        head = max(free, key=lambda b: (sd[b], -b))
        part = [head]
        while len(part) < take:
            rest = [b for b in free if b not in part]
            part.append(max(rest, key=lambda b: (corr[b, part].sum(), -b)))
        out.append(sorted(part))
        free = [b for b in free if b not in part]
    return out


def ball(width: int, radius: int) -> int:
    total, c = 0, 1
    for r in range(radius + 1):
        total += c
        c = c * (width - r) // (r + 1)
    return total


def allocate(bits: np.ndarray, parts: list[list[int]], n: int, tau: int = TAU) -> tuple[float, list[int]]:
    """(estimated cost, threshold of each part): least cost with sum(t + 1) = tau + 1, by dynamic programming."""
    cost = np.full((len(parts), tau + 2), np.inf)
    half = len(bits) // 2
    for i, part in enumerate(parts):
        cost[i, 0] = 0.0  # skipped
        d = (bits[:half, part] != bits[half : 2 * half, part]).sum(1) if half else np.zeros(0)
        for t in range(tau + 1):
            near = ((d <= t).sum() + 1) / (half + 2)  # share of pairs that become candidates
            random = max(ball(len(part), t) / 2.0 ** len(part), 0.0)
            share = max(random, near - 3 * np.sqrt(near / (half + 2)), 0.0)
            cost[i, t + 1] = share * n * n / 2 + 20.0 * n * ball(len(part), t)
    best = {0: (0.0, [])}
    for i in range(len(parts)):
        step: dict = {}
        for used, (c, ts) in best.items():
            for t in range(tau + 2 - used):
                got = (c + cost[i, t], [*ts, t - 1])
                if used + t not in step or got < step[used + t]:
                    step[used + t] = got
        best = step
    return best[tau + 1]


def plan_index(fps: np.ndarray, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts that are probed, for n fingerprints of which fps is a sample."""
    bits = bits_of(fps)
    plans = []
    for m in PARTS:
        parts = group_bits(bits, m)
        c, ts = allocate(bits, parts, n, tau)
        plans.append((c, [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def signatures(fps: np.ndarray, plan: list[tuple[list[int], int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(part, values within half the part's threshold of each fingerprint's): two fingerprints within t share a value.

    Radius ceil(t/2) on both sides covers distance t: from either end, walk half of the differing bits.
    """
    fps = fps.view(np.uint64)
    for k, (part, t) in enumerate(plan):
        base = fps & np.uint64(sum(1 << b for b in part))
        for r in range((t + 1) // 2 + 1):
            for flip in combinations(part, r):
                yield k, base ^ np.uint64(sum(1 << b for b in flip))


def join(root: dict[int, int], u: int, v: int) -> bool:
    """Joins the trees of u and v; whether they were two."""
    ends = []
    for x in (u, v):
        while (p := root.setdefault(x, x)) != x:
            root[x] = root[p]
            x = root[x]
        ends.append(x)
    root[max(ends)] = min(ends)
    return ends[0] != ends[1]


def find(root: dict[int, int], v: int) -> int:
    while (p := root.get(v, v)) != v:
        v = p
    return v


def forest(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, tau: int = TAU, root: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Links within tau between ids a (bits x) and ids b (bits y), reduced to a spanning forest; root: trees that are there already."""
    root = {} if root is None else root
    out, lo, step = [], 0, 16
    while lo < len(a):
        i, j = np.nonzero(np.bitwise_count(x[lo : lo + step, None] ^ y[None, :]) <= tau)
        i += lo
        if len(i) > 4 * (len(a) + len(b)):  # pairs of one tree need no walk each
            i_, j_ = (np.array([find(root, v) for v in ids.tolist()]) for ids in (a, b))
            apart = i_[i] != j_[j]
            i, j = i[apart], j[apart]
        out += [(u, v) for u, v in zip(a[i].tolist(), b[j].tolist(), strict=True) if join(root, u, v)]
        lo, step = lo + step, min(2 * step, 256)
    return out


def link_by_values(rows: DataFrame, tau: int = TAU) -> DataFrame:
    """rows: (v, fp), distinct fp. Returns links (a, b) that join all within tau bits, of rows no matter how dense."""
    masks = [[sum(1 << b for b in flip) for flip in combinations(range(64), r)] for r in range(tau - tau // 2 + 1)]
    near = np.repeat([r <= tau // 2 for r in range(len(masks))], [len(m) for m in masks])
    flips = np.array(sum(masks, []), np.uint64)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = (f.fp.to_numpy(np.int64).view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
            yield pd.DataFrame({"value": values.ravel(), "v": np.repeat(f.v.to_numpy(), len(flips)), "near": np.tile(near, len(f))})

    visits = rows.select("v", "fp").mapInPandas(visit, "value long, v long, near boolean")
    hub = F.min(F.when(F.col("near"), F.col("v"))).over(Window.partitionBy("value"))
    return visits.select(hub.alias("a"), F.col("v").alias("b")).filter("a is not null and a <> b").distinct()


def link(classes: DataFrame, tau: int = TAU) -> DataFrame:
    """classes: (v, fp), distinct fp. Returns links (a, b): enough of them to join all that are within tau."""
    n = classes.count()
    got = np.array([r.fp for r in classes.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").collect()], np.int64)
    if n < 2:
        return classes.select(F.col("v").alias("a"), F.col("v").alias("b")).limit(0)
    plan = plan_index(got, n, tau)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f.fp.to_numpy(np.int64)
            for k, value in signatures(fp, plan):
                yield pd.DataFrame({"part": np.int32(k), "value": value.view(np.int64), "v": f.v.to_numpy(), "fp": fp})

    signed = classes.mapInPandas(sign, "part int, value long, v long, fp long")
    size = signed.groupBy("part", "value").agg(F.count("*").alias("n")).filter("n > 1")
    shared = signed.join(shuffled(size), ["part", "value"])
    held = shared.filter(F.col("n") <= DENSE).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    # A row of block i goes to the pairs (i, j) and (j, i), written low-high; a bucket of one block has the pair (0, 0).
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("part", "value", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "v", "fp")
    # Small buckets are gathered many to a group: a bucket's pair of blocks goes to one of GROUPS groups.
    groups = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4, n // 20_000)
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("part", "value", "p", "q"), F.lit(groups)).cast("int"))

    def verify(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["part", "value", "p", "q"], kind="stable")
        keys = f[["part", "value", "p", "q"]].to_numpy()
        heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(f) else []
        v, bits, mine = f.v.to_numpy(), f.fp.to_numpy(np.int64).view(np.uint64), f.mine.to_numpy()
        out, sent = [], {}  # sent: the trees of all links that leave this task, whatever their bucket
        for s, e in zip(heads, [*heads[1:], len(f)], strict=True):
            if keys[s, 2] == keys[s, 3]:
                out += forest(v[s:e], v[s:e], bits[s:e], bits[s:e], tau, sent)
            else:
                # Links inside a block leave the task of that block; here they only tell which links between blocks are needed.
                l, r = np.flatnonzero(mine[s:e] == keys[s, 2]) + s, np.flatnonzero(mine[s:e] == keys[s, 3]) + s
                own: dict[int, int] = {}
                for k in (l, r):
                    forest(v[k], v[k], bits[k], bits[k], tau, own)
                out += [x for x in forest(v[l], v[r], bits[l], bits[r], tau, own) if join(sent, *x)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = dealt.groupBy("g").applyInPandas(verify, "a long, b long")
    if n <= DENSE:
        return links
    return links.unionByName(link_by_values(shared.filter(F.col("n") > DENSE).select("v", "fp").distinct(), tau))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, fp, component_id, one row for each row of docs."""
    marked = materialise(fingerprints(docs).drop("row"), "fingerprints")
    # Classes of equal fingerprints. Vertices are numbered by fingerprint, so that classes of null ids only are vertices too.
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("v")), "classes")
    linked = components(link(classes.select(F.col("fp").alias("v"), "fp"))).withColumnRenamed("v", "fp")
    least = linked.join(shuffled(classes), "fp").groupBy("root").agg(F.min("v").alias("least"))
    linked = linked.join(shuffled(least), "root").select("fp", "least")
    named = classes.join(shuffled(linked), "fp", "left").select("fp", F.coalesce("least", "v").alias("component_id"))
    return marked.join(shuffled(named), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row of each class: that of the smallest id, null ids last. Rows are judged each, whatever ids they share."""
    row = "row"
    while row in (c.lower() for c in docs.columns):
        row += "_"
    # Numbers of rows hold only once they are written.
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    marked = materialise(fingerprints(numbered, row), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "row")).alias("first")
    classes = materialise(marked.groupBy("fp").agg(first), "classes")
    roots = components(link(classes.select(F.col("fp").alias("v"), "fp"), tau))
    named = classes.join(shuffled(roots), classes["fp"] == roots["v"], "left").select(F.coalesce("root", "fp").alias("root"), "first")
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(shuffled(kept), row, "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
