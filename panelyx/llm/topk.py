"""Exact top-k inner-product search over a pivot-distance index.

Vectors are quantised to floor(256 x). A vector whose own length is s is seen as the point (v, sqrt(M - s^2)), M the
largest squared length, so all points have the same length and the nearest point is the one of the largest inner product:
|q' - v'|^2 = |q|^2 + M - 2 <q, v>.

Index. Rows of equal vectors are one point that holds their k + 1 smallest ids (with how often each occurs, up to k):
more can never be among the k best of a query, whatever its own id is. A point's key is its nearest pivot and the
distance to it; PIVOTS pivots are taken from a bounded sample, each the sample's point farthest from those before. Points
are written in order of their keys, and there they stay: a search reads them, and never shuffles them.

Search. Queries go round in blocks of QUERIES, which are broadcast (QUERIES vectors at most, a job for each block). First
each query looks into the annulus where its own key lies, which gives it a k-th best score. Then every task cuts its
points into annuli of at most CHUNK points of one pivot. By the triangle inequality an annulus [lo, hi] of pivot p has no
point closer to q than max(d(q, p) - hi, lo - d(q, p)); the plane between two pivots bounds whole cells in the same way.
Each query takes the task's annuli in ascending order of that bound and stops at the first beyond its k-th best distance,
which shrinks as it goes. Products are exact (integers below 2^53 in float64). A task returns at most k points a query,
and only such as reach the k-th best score that was known, so what is shuffled is a few rows a query, and the index once.

Vectors that are null or hold null or non-finite components take no part, nor do those of another length than most
vectors have (of lengths that are equally frequent the longest counts). Null ids are kept as candidates and sort last
among ties; repeated rows are candidates each; a query's own rows (same id) never are; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, parallelism, short_batches, table

PIVOTS, SAMPLE = 16, 2_000
#: Points of an annulus and annuli that a task holds; queries of a block, and of one matrix product.
CHUNK, SPAN, QUERIES, PRODUCT = 4_096, 16, 16_384, 1_024
#: Points of the annulus that a query sees first, and how many annuli of a pivot the driver knows at most.
BAND, BANDS = 16_384, 1_024
NO_ID = 2**63 - 1


def quantised(vec: Column) -> Column:
    """floor(256 x) of finite components; null where the vector takes no part."""
    v = F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vec.isNotNull() & ~F.coalesce(bad, F.lit(True)), v)


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each pivot is the sample's point farthest from the pivots before."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(most, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Points of equal length sqrt(most)."""
    return np.hstack([v, np.sqrt(np.maximum(most - (v * v).sum(1), 0))[:, None]])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(sq, 0))


class Block:
    """The queries of one block, and the k best points that a task has found for each: lists of (-score, id, point's ids)."""

    def __init__(self, ids: list, x: np.ndarray, kth: np.ndarray, pivots: np.ndarray, most: float, edges: list[np.ndarray], k: int):
        self.ids, self.x, self.kth, self.k = ids, x, kth.copy(), k
        self.asked = kth
        self.best: list[list[tuple]] = [[] for _ in ids]
        self.own = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.sq = (x * x).sum(1) + most
        # The query is the point (x, 0). A point of a cell is nearer to its pivot than to the query's nearest one, so it
        # lies beyond the plane between them.
        self.d = distances(np.hstack([x, np.zeros((len(x), 1))]), pivots)
        near = self.d.argmin(1)
        apart = np.sqrt(((pivots[None, :, :] - pivots[near][:, None, :]) ** 2).sum(2))
        self.plane = np.where(apart > 0, (self.d**2 - self.d.min(1)[:, None] ** 2) / np.maximum(2 * apart, 1e-9), 0)
        self.slack = 1e-6 * (1 + np.sqrt(self.sq))
        bands = np.array([np.searchsorted(edges[p], self.d[i, p]) for i, p in enumerate(near)], np.int64)
        self.home = near * (BANDS + 1) + bands

    def radius(self, q: np.ndarray) -> np.ndarray:
        """The distance within which the k best lie (infinite while there are none)."""
        return np.sqrt(np.maximum(self.sq[q] - 2 * self.kth[q], 0)) + self.slack[q]

    def look(self, q: np.ndarray, v: np.ndarray, first: np.ndarray, second: np.ndarray, ids: pa.Array) -> None:
        """Queries q look at the points v, which are in order of their first ids."""
        for at in range(0, len(q), PRODUCT):
            some = q[at : at + PRODUCT]
            scores = self.x[some] @ v.T
            lo, hi = np.searchsorted(first, self.own[some]), np.searchsorted(first, self.own[some], side="right")
            mine = {}
            for r in np.flatnonzero(lo < hi).tolist():
                own = self.ids[some[r]]
                mine[r] = [j for j in range(lo[r], hi[r]) if own is not None and (own != NO_ID or ids[j][0]["id"].as_py() == own)]
                scores[r, [j for j in mine[r] if len(ids[j]) == 1]] = -np.inf
            for r in np.flatnonzero(scores.max(1) >= self.kth[some]).tolist():
                row, i = scores[r], int(some[r])
                least = max(self.kth[i], np.partition(row, -self.k)[-self.k]) if len(row) > self.k else self.kth[i]
                c = np.flatnonzero((row >= least) & (row > -np.inf))
                order = first[c].copy()
                for j in mine.get(r, ()):
                    order[c == j] = second[j]
                by = np.lexsort((order, -row[c]))[: self.k]
                self.best[i] = sorted([*self.best[i], *((-float(row[c[b]]), int(order[b]), ids[int(c[b])].as_py()) for b in by)], key=lambda b: b[:2])[: self.k]
                if len(self.best[i]) == self.k:
                    self.kth[i] = max(self.kth[i], -self.best[i][-1][0])

    def expand(self, v: np.ndarray, first: np.ndarray, second: np.ndarray, ids: pa.Array, pivot: np.ndarray, dist: np.ndarray, annulus: np.ndarray, at_home: bool) -> None:
        """Looks at points (those of the queries' home annuli, or all others), in annuli by their least distance."""
        by = np.lexsort((dist, annulus))
        cuts = np.flatnonzero(np.append(True, annulus[by][1:] != annulus[by][:-1]))
        parts = [part[i : i + CHUNK] for part in np.split(by, cuts[1:]) for i in range(0, len(part), CHUNK)]
        parts = [p[np.argsort(first[p], kind="stable")] for p in parts]
        of = np.array([annulus[p[0]] for p in parts])
        own = self.d[:, [pivot[p[0]] for p in parts]]
        lo, hi = (np.array([f(dist[p]) for p in parts]) for f in (np.min, np.max))
        reach = np.maximum.reduce([own - hi[None, :], lo[None, :] - own, self.plane[:, [pivot[p[0]] for p in parts]]])
        reach[(self.home[:, None] == of[None, :]) != at_home] = np.inf
        order = np.argsort(reach, axis=1, kind="stable")
        q = np.arange(len(self.x))
        for step in range(len(parts)):
            bound = reach[q, order[q, step]]
            q = q[np.isfinite(bound) & (bound <= self.radius(q))]
            if not len(q):
                break
            for c in np.unique(order[q, step]).tolist():
                p = parts[c]
                self.look(q[order[q, step] == c], v[p], first[p], second[p], ids.take(pa.array(p)))

    def found(self) -> Iterator[tuple]:
        """(query, score, id, how often) of what reaches the k-th best score that was known before."""
        for own, kth, best in zip(self.ids, self.asked, self.best, strict=True):
            for minus, _, ids in best:
                if -minus >= kth:
                    for x in ids:
                        if own is None or x["id"] != own:
                            yield own, int(-minus), x["id"], x["n"]


def index(v: DataFrame, dim: int, most: float, pivots: np.ndarray, k: int) -> DataFrame:
    """v: vec_id, v. Returns the points (v, ids, first, second, pivot, dist) in order of pivot and distance."""
    rows = v.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last()))
    few = rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    points = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "n"))).alias("ids"))
    order = [F.coalesce(F.get(F.col("ids"), F.lit(i))["id"], F.lit(NO_ID)).alias(n) for i, n in enumerate(("first", "second"))]
    points = points.select("v", F.transform("ids", lambda x: F.struct(x["id"].alias("id"), x["n"].alias("n"))).alias("ids"), *order)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(lifted(b.column(0).flatten().to_numpy().reshape(-1, dim), most), pivots)
                p = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.int32()), pa.array(d[np.arange(len(p)), p])], names=[*b.schema.names, "pivot", "dist"])

    schema = "v array<double>, ids array<struct<id:long,n:long>>, first long, second long, pivot int, dist double"
    keyed = materialise(points.mapInArrow(key, schema), "keyed")
    return materialise(keyed.repartitionByRange(parallelism(v.sparkSession), "pivot", "dist").sortWithinPartitions("pivot", "dist"), "points")


def annuli(points: DataFrame, pivots: int) -> list[np.ndarray]:
    """For each pivot the distances at which the annuli of about BAND points end, but the last; at most BANDS - 1."""
    counts = {r.pivot: r["count"] for r in points.groupBy("pivot").count().collect()}
    bands = min(BANDS, max(1, -(-max(counts.values()) // BAND)))
    if bands == 1:
        return [np.zeros(0)] * pivots
    share = [i / bands for i in range(1, bands)]
    cuts = {r.pivot: r.cut for r in points.groupBy("pivot").agg(F.percentile_approx("dist", share, 10_000).alias("cut")).collect()}
    return [np.unique(np.array(cuts.get(p, []), float)) for p in range(pivots)]


def top_k(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """vectors: vec_id, embedding; queries: which rows are queries. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    short_batches(spark)
    v = vectors.select("vec_id", quantised(F.col("embedding")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter("v is not null")
    length = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = length.dim if length else 0
    asking = v.filter("asks").filter(F.size("v") == dim).select("vec_id", "v").distinct()
    n_queries = asking.count()
    if not n_queries or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    v = v.filter(F.size("v") == dim)
    most = float(v.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    sample = np.array([r.v for r in v.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect()], float).reshape(-1, dim)
    pivots = choose_pivots(lifted(sample, most))
    points = index(v, dim, most, pivots, k)
    edges = annuli(points, len(pivots))
    blocks = -(-n_queries // QUERIES)
    asking = materialise(asking.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")), "queries")
    result = "query_id long, score long, vec_id long, n long"

    def probe(block: tuple[list, np.ndarray], kth: np.ndarray, at_home: bool) -> DataFrame:
        """What the points have for a block of queries; of these the k-th best scores that are known."""
        shared = spark.sparkContext.broadcast((*block, kth))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, held = None, []

            def flush() -> None:
                t = pa.Table.from_batches(held).combine_chunks()
                x = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
                first, second, pivot, dist = (t.column(n).to_numpy() for n in ("first", "second", "pivot", "dist"))
                annulus = np.zeros(len(x), np.int64)
                for p in np.unique(pivot).tolist():
                    at = pivot == p
                    annulus[at] = p * (BANDS + 1) + np.searchsorted(edges[p], dist[at])
                state.expand(x, first, second, t.column("ids").combine_chunks(), pivot, dist, annulus, at_home)
                held.clear()

            for b in batches:
                state = state or Block(*shared.value, pivots, most, edges, k)
                held.append(b)
                if sum(h.num_rows for h in held) >= CHUNK * SPAN:
                    flush()
            if held:
                flush()
            if state and (rows := list(state.found())):
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 10_000], strict=True)], names=["query_id", "score", "vec_id", "n"])

        return points.mapInArrow(run, result)

    found = []
    for b in range(blocks):
        rows = asking.filter(F.col("block") == b).collect()  # about QUERIES rows
        if not rows:
            continue
        block = [r.vec_id for r in rows], np.array([r.v for r in rows], float).reshape(-1, dim)
        home = materialise(probe(block, np.full(len(rows), -np.inf), True), "home")
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        known = {r.query_id: float(r.score) for r in home.withColumn("at", order).filter(F.col("at") == k).collect()}
        times = Counter(block[0])  # the bound of an id with several vectors is none of either
        kth = np.array([known.get(i, -np.inf) if times[i] == 1 else -np.inf for i in block[0]])
        found += [home, materialise(probe(block, kth, False), "found")]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = every.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return every.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
