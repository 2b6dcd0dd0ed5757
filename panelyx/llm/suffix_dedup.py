"""Suffix-array dedup: removes every byte covered by a 50-byte string that also starts in a document of a smaller id.

The method is bucket-pointer refinement: suffixes are first bucketed by a q-gram, then buckets are refined by sorting on
the bucket identifiers of later offsets, and refined identifiers are used in the refinements that follow. It runs at two
levels.

Across the cluster a bucket identifier is a 64-bit code of the Q = 24 bytes at a position. Sorting all positions of a
corpus is out of the question, so one bucket stands for many: of each 50-byte window the position with the least code is
its anchor (leftmost of ties; equal windows have equal anchors), and consecutive windows with the same anchor make a
block. Blocks meet in the bucket of their anchor's q-gram and are refined there on the identifiers of the q-grams at
four later offsets that cover the block. Equal blocks are equal in every window: all but those of the smallest id go.
In a bucket with more than one distinct block windows can agree in part (at the edges of a passage); only those blocks'
bytes are fetched, and bucket-pointer refinement of all their suffixes to depth 50 in numpy (refine) tells which windows
are equal. A q-gram with over HOT distinct blocks would be one task's burden: its windows meet across the cluster
instead, grouped by their 50 bytes, with the least id of each aggregated before the shuffle. Both ways compare bytes and
give the same; HOT only says where the work is done.

Equality of whole blocks is by code: 48 bits of the anchor's q-gram and 64 bits of the block, all else by bytes. With n
different blocks the chance that any two are taken for equal is at most n^2 / 2^113: 5e-9 for the 7e12 blocks of 100 TB.

What moves: about 7 % of positions as records of some 20 bytes, packed in columns per bucket and task, after a task has
dropped its own copies; the texts once, by id, for both joins.

Rows of one id are told apart by a 128-bit digest of the text, which joins the id in every grouping and join (rows that
share no id do without); equal rows get equal results.

Null texts are empty; null ids count as larger than any id and not smaller than each other; rows with the same id are
judged each, never against each other; an empty table gives an empty result; other columns are ignored. Texts are
UTF-8 bytes; a removal may cut a character.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, parallelism, short_batches, table, trim
from .words import by_bytes

DEPTH, Q = 50, 24
WINDOW = DEPTH - Q + 1
CHUNK_BYTES, FLUSH_BYTES, REFINE_BYTES = 500_000, 8_000_000, 1_000_000
#: Blocks (of at most DEPTH + WINDOW - 1 bytes) that REFINE_BYTES hold.
HOT = REFINE_BYTES // (DEPTH + WINDOW)
NO_ID = 2**63 - 1
#: What rows are told apart by: the id, and the digest of the text in two halves.
KEY = ("doc_id", "t1", "t2")
#: Fixed odd multipliers of the code.
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
LOW_POSITION = np.uint64((1 << 23) - 1)


def words8(buf: bytes) -> np.ndarray:
    """The eight bytes from each position on as one number; buf is padded with eight zeros."""
    padded = buf + bytes(16)
    out = np.empty(len(buf) + 8, np.uint64)
    for o in range(8):
        part = np.frombuffer(padded, "<u8", (len(padded) - o) // 8, o)
        out[o::8] = part[: len(out[o::8])]
    return out[: len(buf)]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b + M3)) * M1
    x ^= x >> np.uint64(29)
    x *= M2
    x ^= x >> np.uint64(32)
    return x


def codes(buf: bytes) -> np.ndarray:
    """64-bit identifiers of the Q-grams at positions 0 .. len - Q."""
    w = words8(buf)
    n = max(len(buf) - Q + 1, 0)
    x = w[:n] * M1
    x ^= x >> np.uint64(32)
    x += w[8 : 8 + n]
    x *= M2
    x ^= x >> np.uint64(29)
    x += w[16 : 16 + n]
    x *= M3
    x ^= x >> np.uint64(32)
    return x


def blocks(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Blocks of all texts: which text, first window s, last window e (offsets in the text), key and block identifiers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    none = {k: np.zeros(0, np.int32) for k in ("text", "s", "e")} | {k: np.zeros(0, np.uint64) for k in ("key", "block")}
    parts = []
    buf = b"".join(texts)
    if len(buf) < DEPTH:
        return none
    h = codes(buf)
    # Tasks see a long text in stretches: the position takes the low bits of the ordered value.
    step = int(LOW_POSITION) + 1 - DEPTH
    for lo in range(0, len(buf) - DEPTH + 1, step):
        hi = min(lo + step, len(buf) - DEPTH + 1)  # windows lo .. hi - 1
        v = (h[lo : hi + WINDOW - 1] & ~LOW_POSITION) | np.arange(hi + WINDOW - 1 - lo, dtype=np.uint64)
        m, span = v, 1
        while span * 2 <= WINDOW:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < WINDOW:
            m = np.minimum(m[: span - WINDOW or None], m[WINDOW - span :])
        parts.append((m & LOW_POSITION).astype(np.int64) + lo)
    anchor = np.concatenate(parts)
    ok = np.zeros(len(anchor) + 1, bool)  # windows that lie in one text
    lots = np.flatnonzero(sizes >= DEPTH)
    delta = np.zeros(len(anchor) + 2, np.int32)
    np.add.at(delta, starts[lots], 1)
    np.add.at(delta, ends[lots] - DEPTH + 1, -1)
    ok = np.cumsum(delta[:-2]) > 0
    change = np.append(True, anchor[1:] != anchor[:-1])
    change[starts[lots]] = True
    heads = np.flatnonzero(ok & change)
    last = np.flatnonzero(ok & np.append(change[1:] | ~ok[1:], True))
    a = anchor[heads]
    # An anchor's code is the least of its window, so small codes abound: mixed once more they are even over the buckets.
    key = h[a] * M2
    key ^= key >> np.uint64(31)
    key *= M1
    key ^= key >> np.uint64(29)
    block = mix(mix(h[heads], h[heads + Q]), mix(h[last + 2], h[last + DEPTH - Q]) + (a - heads).astype(np.uint64) * np.uint64(32) + (last - heads).astype(np.uint64))
    text = np.searchsorted(ends, heads, side="right")
    return {"text": text.astype(np.int32), "s": (heads - starts[text]).astype(np.int32), "e": (last - starts[text]).astype(np.int32), "key": key, "block": block}


def refine(buf: bytes, depth: int = DEPTH) -> np.ndarray:
    """Bucket pointers: equal for two positions iff the next `depth` bytes are equal, in suffix order.

    Initial buckets hold the 8-grams; a pointer is the place of its bucket's first suffix in the order. Each round sorts
    the members of buckets with more than one suffix on the pointers at a later offset, and the new pointers serve the
    next round's offsets. Positions closer than depth to the end are compared with the zeros that follow.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    padded = buf + bytes(depth)
    first = words8(padded).byteswap()
    order = np.argsort(first, kind="stable")
    pointer = np.empty(len(padded), np.int64)

    def point(order: np.ndarray, base: np.ndarray, new: np.ndarray) -> None:
        """order: positions sorted; new: where a bucket begins; base: the place of each in the whole order."""
        pointer[order] = base[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]

    v = first[order]
    point(order, np.arange(len(order)), np.append(True, v[1:] != v[:-1]))
    have = min(8, depth)
    while have < depth:
        off = min(have, depth - have)
        p = pointer[order]
        alone = np.append(True, p[1:] != p[:-1]) & np.append(p[1:] != p[:-1], True)
        order = order[~alone]
        if not len(order):
            break
        order = order[order + off < len(padded)]
        own, later = pointer[order], pointer[order + off]
        by = np.lexsort((later, own))
        order, own, later = order[by], own[by], later[by]
        bucket = np.append(True, own[1:] != own[:-1])
        place = own + np.arange(len(order)) - np.maximum.accumulate(np.where(bucket, np.arange(len(order)), 0))
        point(order, place, bucket | np.append(True, later[1:] != later[:-1]))
        have += off
    return pointer[:n]


def six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def deltas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of ascending numbers, and the steps to the others."""
    return x[:1], small(np.diff(x))


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a group begins) of rows sorted by keys, the first one foremost."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def keyed(docs: DataFrame) -> list[Column]:
    """docs: doc_id, text. The key of a row as three longs: its id, and the digest of its text where other rows may have the id."""
    shared = F.lit(True) if not docs.groupBy("doc_id").count().filter("doc_id is not null and count > 1").isEmpty() else F.col("doc_id").isNull()
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    halves = [F.when(shared, F.conv(F.substring(digest, at, 16), 16, -10).cast("long")).otherwise(F.lit(0).cast("long")) for at in (1, 17)]
    return [F.coalesce("doc_id", F.lit(NO_ID)), *halves]


def packed(tags: np.ndarray) -> np.ndarray | int:
    return tags if tags.any() else len(tags)


def unpacked(tags: np.ndarray | int) -> np.ndarray:
    return np.zeros((tags, 2), np.int64) if isinstance(tags, int) else tags


def locate(docs: DataFrame, buckets: int) -> DataFrame:
    """docs: doc_id, t1, t2 (as keyed), text. Returns (bucket, blob): packed records for buckets; ranges that a task settles alone."""
    short_batches(docs.sparkSession)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        at, tags, chunks = [], [], []
        for ids, tag, b in held:
            chunks.append(b | {"text": b["text"] + np.int32(len(at))})
            at += ids
            tags += tag
        ids, tags = np.array(at, np.int64), np.array(tags, np.int64).reshape(-1, 2)
        text, s, e, key, block = (np.concatenate([c[k] for c in chunks]) for k in ("text", "s", "e", "key", "block"))
        doc = ids[text]
        order, new = grouped(key, block)
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else doc
        settled = doc[order] > least[group]
        out = []
        for k in np.array_split(order[settled], 16) if settled.any() else ():  # anywhere will do; evenly is better
            used, local = np.unique(text[k], return_inverse=True)
            out.append((len(out) * 7919 + int(key[order[0]] >> np.uint64(3)) % 7919, pickle.dumps(("settled", (ids[:0], ids[used]), packed(tags[used]), small(local), s[k], e[k]))))
        out = [(b % buckets, blob) for b, blob in out]
        keep = order[~settled]  # sorted by key
        of = (key[keep] >> np.uint64(32)).astype(np.int64) * buckets >> 32
        cut = np.searchsorted(of, np.arange(buckets + 1))
        id_order = np.argsort(ids, kind="stable")
        by_id = np.empty(len(ids), np.int64)
        by_id[id_order] = np.arange(len(ids))
        for b in range(buckets):
            k = keep[cut[b] : cut[b + 1]]
            if len(k):
                used, local = np.unique(by_id[text[k]], return_inverse=True)
                used = id_order[used]
                out.append((b, pickle.dumps(("records", deltas(ids[used]), packed(tags[used]), small(local), small(s[k]), small(e[k] - s[k]), six(key[k]), block[k].tobytes()))))
        if out:
            where, blobs = zip(*out, strict=True)
            for lo in range(0, len(where), 64):
                yield pa.RecordBatch.from_arrays([pa.array(where[lo : lo + 64], pa.int32()), pa.array(blobs[lo : lo + 64], pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, got = [], 0
        rows = ((i, (t1, t2), (t or "").encode("utf-8", "surrogatepass")) for b in batches for i, t1, t2, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for group in by_bytes(rows, lambda x: len(x[2]), CHUNK_BYTES):
            ids, tags, raw = map(list, zip(*group, strict=True))
            held.append((ids, tags, blocks(raw)))
            got += sum(map(len, raw))
            if got >= FLUSH_BYTES:
                yield from flush(held)
                held, got = [], 0
                trim()
        if held:
            yield from flush(held)
        del held
        trim()

    return docs.select(*KEY, "text").mapInArrow(run, "bucket int, blob binary")


def meet(located: DataFrame) -> DataFrame:
    """Returns (doc_id, t1, t2, s, e, key, kind): windows s..e are settled (kind 0), or to be compared (1), or hot (2)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out, rows = [], []
        for blob in f.blob:
            kind, ids, tags, local, s, x, *codes_ = pickle.loads(blob)
            ids = np.concatenate([ids[0], ids[0][-1:] + np.cumsum(ids[1], dtype=np.int64)]) if len(ids[0]) else ids[1]
            tags = unpacked(tags)
            if kind == "settled":
                out.append((ids[local], tags[local], s, x, np.zeros(len(s), np.uint64), np.zeros(len(s), np.int8)))
            else:
                rows.append((ids[local], tags[local], s.astype(np.int64), s.astype(np.int64) + x, unsix(codes_[0]), np.frombuffer(codes_[1], np.uint64)))
        if rows:
            doc, tag, s, e, key, block = (np.concatenate([r[i] for r in rows]) for i in range(6))
            if tag.any():  # equal rows have equal records: one of each is enough
                order, new = grouped(doc, tag[:, 0], tag[:, 1], s)
                doc, tag, s, e, key, block = (x[order[new]] for x in (doc, tag, s, e, key, block))
            order, new = grouped(key, block)
            heads = np.flatnonzero(new)
            least = np.minimum.reduceat(doc[order], heads)
            group = np.cumsum(new) - 1
            copy = doc[order] > least[group]
            g_key = key[order[heads]]
            # Per key: distinct blocks, and whether they come from more than one document.
            k_new = np.append(True, g_key[1:] != g_key[:-1])
            k_heads, k_of = np.flatnonzero(k_new), np.cumsum(k_new) - 1
            n = np.diff(np.append(k_heads, len(g_key)))
            differ = np.minimum.reduceat(least, k_heads) < np.maximum.reduceat(least, k_heads)
            kind = np.where(differ, np.where(n > HOT, 2, 1), 3).astype(np.int8)[k_of][group]
            kind[copy] = 0
            keep = order[kind != 3]
            out.append((doc[keep], tag[keep], s[keep], e[keep], key[keep], kind[kind != 3]))
        cols = [np.concatenate([o[i] for o in out]) for i in range(6)] if out else [[]] * 6
        del rows, out
        trim()
        tag = np.asarray(cols[1], np.int64).reshape(-1, 2)
        return pd.DataFrame({"doc_id": np.asarray(cols[0], np.int64), "t1": tag[:, 0], "t2": tag[:, 1], "s": np.asarray(cols[2], np.int32), "e": np.asarray(cols[3], np.int32), "key": np.asarray(cols[4], np.uint64).view(np.int64), "kind": np.asarray(cols[5], np.int8)})

    return located.groupBy("bucket").applyInPandas(run, "doc_id long, t1 long, t2 long, s int, e int, key long, kind byte")


def compare(keys: np.ndarray, doc: np.ndarray, raw: list[bytes]) -> list[tuple[int, int, int]]:
    """(row, first, last) runs of windows of a row's block that a smaller document has too, within rows of the same key."""
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes) - sizes
    pointer = refine(b"".join(raw))
    windows = sizes - DEPTH + 1
    row = np.repeat(np.arange(len(raw)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    p = pointer[starts[row] + at]
    order, new = grouped(p, keys[row])
    least = np.minimum.reduceat(doc[row[order]], np.flatnonzero(new))
    gone = np.zeros(len(row), bool)
    gone[order] = doc[row[order]] > least[np.cumsum(new) - 1]
    edge = np.append(True, row[1:] != row[:-1])
    begin = gone & (edge | ~np.append(False, gone[:-1]))
    end = gone & (np.append(edge[1:], True) | ~np.append(gone[1:], False))
    return list(zip(row[begin].tolist(), at[begin].tolist(), at[end].tolist(), strict=True))


def duplicate_windows(docs: DataFrame) -> DataFrame:
    """docs: doc_id, t1, t2 (as keyed), text. Returns (doc_id, t1, t2, s, e): runs of windows that start in a smaller document too."""
    spark = docs.sparkSession
    met = materialise(meet(locate(docs, min(4 * parallelism(spark), 1 << 24))), "windows")
    asked = met.filter("kind > 0").groupBy(*KEY).agg(F.collect_set(F.struct("s", "e", "key", "kind")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out: dict[str, list] = {k: [] for k in (*KEY, "s", "key", "kind", "raw")}
            for d, t1, t2, t, asks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last == (d, t1, t2):  # an equal row; others of them may lie elsewhere, which does no harm
                    continue
                last = (d, t1, t2)
                raw = (t or "").encode("utf-8", "surrogatepass")
                for a in asks:
                    for k, v in (("doc_id", d), ("t1", t1), ("t2", t2), ("s", a["s"]), ("key", a["key"]), ("kind", a["kind"]), ("raw", raw[a["s"] : a["e"] + DEPTH])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], t) for k, t in (("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("s", pa.int32()), ("key", pa.int64()), ("kind", pa.int8()), ("raw", pa.binary()))],
                names=[*KEY, "s", "key", "kind", "raw"],
            )
            del out
        trim()

    fetched = materialise(docs.join(asked, [*KEY]).select(*KEY, "text", "asked").mapInArrow(fetch, "doc_id long, t1 long, t2 long, s int, key long, kind byte, raw binary"), "blocks")

    def refined(f: pd.DataFrame) -> pd.DataFrame:
        if f.t1.any():
            f = f.drop_duplicates([*KEY, "s", "key"])
        f = f.sort_values("key", kind="stable")
        keys, doc, t1, t2, s, raw = f["key"].to_numpy(), f.doc_id.to_numpy(), f.t1.to_numpy(), f.t2.to_numpy(), f.s.to_numpy(), [bytes(x) for x in f.raw]
        out, lo = [], 0
        size = np.cumsum([len(r) for r in raw])
        while lo < len(f):  # whole keys, about REFINE_BYTES at a time
            hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + REFINE_BYTES, side="right"))
            hi = int(np.searchsorted(keys, keys[max(hi - 1, lo)], side="right"))
            for r, a, b in compare(keys[lo:hi], doc[lo:hi], raw[lo:hi]):
                out.append((doc[lo + r], t1[lo + r], t2[lo + r], s[lo + r] + a, s[lo + r] + b))
            lo = hi
        del f, raw
        trim()
        return pd.DataFrame(out, columns=[*KEY, "s", "e"]).astype({k: "int64" for k in KEY} | {"s": "int32", "e": "int32"})

    groups = 4 * parallelism(spark)
    edges = fetched.filter("kind = 1").withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).groupBy("g").applyInPandas(refined, "doc_id long, t1 long, t2 long, s int, e int")
    hot = fetched.filter("kind = 2").withColumn("o", F.explode(F.sequence(F.lit(0), F.length("raw") - DEPTH)))
    hot = hot.select(*KEY, (F.col("s") + F.col("o")).alias("s"), F.substring("raw", F.col("o") + 1, F.lit(DEPTH)).alias("raw"))
    least = hot.groupBy("raw").agg(F.min("doc_id").alias("least"))
    hot = hot.join(least, "raw").filter("doc_id > least").select(*KEY, "s", F.col("s").alias("e"))
    return met.filter("kind = 0").select(*KEY, "s", "e").unionByName(edges).unionByName(hot)


def removed_runs(n: int, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed byte ranges [from, to) of a text of n bytes."""
    if not runs:
        return []
    x = np.array(runs, np.int64)
    delta = np.zeros(n + 2, np.int32)
    np.add.at(delta, x[:, 0], 1)
    np.add.at(delta, x[:, 1] + DEPTH, -1)
    inside = np.append(False, np.cumsum(delta)[:n] > 0)
    inside = np.append(inside, False)
    at = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(at[::2].tolist(), at[1::2].tolist(), strict=True))


def with_runs(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text and any others. Adds `runs` (array of struct<s, e>; null: none)."""
    key, name = keyed(docs), "runs"
    runs = duplicate_windows(docs.select(*(k.alias(n) for k, n in zip(key, KEY, strict=True)), "text")).groupBy(*KEY).agg(F.collect_set(F.struct("s", "e")).alias(name))
    runs = runs.toDF(*(of := [f"run_{n}" for n in KEY]), name)
    same = [k == runs[n] for k, n in zip(key, of, strict=True)]
    return docs.join(runs, same[0] & same[1] & same[2], "left").select(*[docs[c] for c in docs.columns], runs[name])


def cut(text: str | None, runs: list | None) -> tuple[bytes, list[tuple[int, int]], bytes]:
    """(bytes, removed ranges, kept bytes)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not runs:
        return raw, [], raw
    gone = removed_runs(len(raw), [(r["s"], r["e"]) for r in runs])
    kept = b"".join(raw[a:b] for a, b in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(raw)], strict=True))
    return raw, gone, kept


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes, spans (array of struct<from, to>), kept (binary)."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("from", pa.int64()), ("to", pa.int64())])
        for b in batches:
            got = [cut(t, r) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            spans = pa.array([[{"from": f, "to": t} for f, t in x[1]] for x in got], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x[0]) for x in got], pa.int64()), spans, pa.array([x[2] for x in got], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
        trim()

    return with_runs(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept binary")


def strip_repeats(docs: DataFrame, size_col: str | None = None) -> DataFrame:
    """The same columns, text without what is removed (and without characters that a removal cut), size_col its new length.

    A document of which nothing is left goes; one that was empty before stays.
    """
    short_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for t, r in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                raw, gone, kept = cut(t, r)
                texts.append(kept.decode("utf-8", "ignore") if gone else t)
                keep.append(bool(kept) or not raw)
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            if size_col in names:
                n = names.index(size_col)
                cols[n] = pa.array([None if t is None else len(t) for t in texts], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    # By place, as the columns may have any names.
    return with_runs(docs).toDF(*(f"c{i}" for i in range(len(names) + 1))).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
