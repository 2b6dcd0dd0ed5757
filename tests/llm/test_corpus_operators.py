"""Operators that compare documents or vectors, against brute force; the pipeline's stages."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from panelyx.llm import graph, simhash, suffix_dedup, topk

from .helpers import frame, odd_texts, prose

# ---- suffix-array dedup


def slow_removed(texts, ids, depth=suffix_dedup.DEPTH):
    """Per row (bytes, kept mask): windows that also start in a document of a smaller id."""
    raw = [(t or "").encode() for t in texts]
    key = [2**63 - 1 if i is None else i for i in ids]
    first = {}
    for r, i in zip(raw, key):
        for k in range(len(r) - depth + 1):
            w = r[k : k + depth]
            first[w] = min(first.get(w, i), i)
    out = []
    for r, i in zip(raw, key):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - depth + 1):
            if first[r[k : k + depth]] < i:
                gone[k : k + depth] = True
        out.append((r, gone))
    return out


def check_dedup(spark, texts, ids):
    got = suffix_dedup.remove_repeats(frame(spark, texts, ids)).collect()
    want = []
    for i, (r, gone) in zip(ids, slow_removed(texts, ids)):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        want.append((i, len(r), [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])], bytes(np.frombuffer(r, np.uint8)[~gone])))
    norm = lambda rows: sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[3], str(x[2])))
    assert norm([(r.doc_id, r.n_bytes, [(s["from"], s["to"]) for s in r.spans], bytes(r.kept)) for r in got]) == norm(want)


@pytest.mark.parametrize("seed", range(20))
def test_refine_orders_prefixes(seed):
    rng = np.random.default_rng(seed)
    b = bytes(rng.integers(0, 2 + seed % 3, 300).astype(np.uint8) + 97)
    if seed % 4 == 0:
        b = b[:40] * 7
    pointer, padded = suffix_dedup.refine(b), b + bytes(suffix_dedup.DEPTH)
    keys = [padded[i : i + suffix_dedup.DEPTH] for i in range(len(b))]
    for i in range(0, len(b), 3):
        for j in range(len(b)):
            assert (pointer[i] == pointer[j]) == (keys[i] == keys[j])
            if keys[i] < keys[j]:
                assert pointer[i] < pointer[j]


def test_dedup_against_brute_force(spark):
    rng = random.Random(11)
    passage, other = prose(rng, 30), prose(rng, 14)
    texts = [t for t in odd_texts() if t is None or len(t) < 30_000]
    for _ in range(60):
        t = prose(rng, rng.randint(0, 60))
        for p in (passage, other):
            if rng.random() < 0.6:
                a, b = sorted(rng.choices(range(len(p)), k=2)) if rng.random() < 0.5 else (0, len(p))
                t += " " + p[a:b] + " " + prose(rng, rng.randint(0, 20))
        texts.append(t)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    check_dedup(spark, texts, ids)


def test_dedup_null_and_repeated_ids(spark):
    rng = random.Random(12)
    a, b = prose(rng, 25), prose(rng, 25)
    check_dedup(spark, [a, a + " " + b, b, a, a, b + a, None, "x" * 200, "y" + "x" * 120, "x" * 49, "x" * 50], [None, 4, 4, None, 9, 9, 2, 1, 3, 5, 6])


@pytest.mark.parametrize("some_id", [None, 7])
def test_dedup_many_rows_of_one_id(spark, some_id):
    """Two texts of one id whose 16-bit digests (by which they were once told apart) agree, and equal rows."""
    rng = random.Random(15)
    a, met = prose(rng, 30), {}
    for k in range(5000):
        n = 1 + k % 2 * 60
        t = (a if k % 2 else "") + f" {k} " + (prose(rng, n) if k % 2 else "")
        other = met.setdefault(hashlib.blake2b(t.encode(), digest_size=2).digest(), t)
        if (len(other) < 50) != (len(t) < 50):
            break
    else:
        raise AssertionError("no two texts of equal digests")
    check_dedup(spark, [a, t, other, t, t, a + " end"], [1, some_id, some_id, some_id, some_id, None])


def test_dedup_a_thousand_rows_of_one_id_and_none(spark):
    """Rows that share an id, or have none, are judged each; one of them fails nothing and displaces nothing."""
    rng = random.Random(16)
    passages = [prose(rng, 25) for _ in range(8)]
    text = lambda k: " ".join([f"{k}", *rng.sample(passages, k % 3), prose(rng, k % 17)])
    texts = [text(k) for k in range(2040)]
    check_dedup(spark, texts, [*range(40), *([None] * 1000), *([20] * 1000)])


def test_dedup_empty_table_and_very_long_text(spark):
    empty = frame(spark, ["x"]).limit(0)
    assert suffix_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.strip_repeats(empty, "n_chars").count() == 0
    rng = random.Random(17)
    long = prose(rng, 12_000)
    check_dedup(spark, [prose(rng, 20) + long[20_000:21_000], long, long[:30_000] + "X" + long[30_000:], "ab" * 20_000, "a" * 40_000, "a" * 100], [0, 5, 9, 3, 4, 1])


def test_dedup_hot_passages(spark, monkeypatch):
    """A q-gram with more than HOT distinct blocks is compared window by window across the cluster."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    rng = random.Random(13)
    passage = prose(rng, 20)
    check_dedup(spark, [prose(rng, 10) + " " + passage[rng.randint(0, 30) :] + " " + prose(rng, 10) for _ in range(60)], list(range(60)))


def test_strip_repeats_keeps_columns_and_drops_what_is_gone(spark):
    rng = random.Random(14)
    a = prose(rng, 40)
    df = frame(spark, [a, a, "", None, "é" + a + "é"], [0, 1, 2, 3, 4])
    got = suffix_dedup.strip_repeats(df, "n_chars").orderBy("doc_id").collect()
    assert suffix_dedup.strip_repeats(df).columns == df.columns
    assert [(r.doc_id, r.text, r.n_chars) for r in got] == [(0, a, len(a)), (2, "", 0), (3, None, None), (4, "éé", 2)]


# ---- SimHash


def slow_simhash(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def slow_components(fps, ids, tau=simhash.TAU):
    root = list(range(len(fps)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                root[find(i)] = find(j)
    best = {}
    for k in range(len(fps)):
        if ids[k] is not None:
            best[find(k)] = min(best.get(find(k), ids[k]), ids[k])
    return [best.get(find(k)) for k in range(len(fps))]


def test_simhash_documents(spark):
    rng = random.Random(21)
    base = prose(rng, 400).split()
    texts = odd_texts()
    for _ in range(80):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(base)
        texts.append(" ".join(t))
    ids = [None, None, *range(len(texts) - 3), 0]
    got = simhash.near_duplicates(frame(spark, texts, ids)).collect()
    fps = [slow_simhash(t) for t in texts]
    want = slow_components(fps, ids)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got], key=key) == sorted(zip(ids, fps, want), key=key)


def test_simhash_null_ids_link_others(spark):
    """A chain of fingerprints of which only the ends have ids, and one of null ids only."""
    rng = random.Random(25)
    seen, ends = {}, None
    base = prose(rng, 300).split()
    for _ in range(400):
        t = list(base)
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice(base)
        seen.setdefault(slow_simhash(" ".join(t)), " ".join(t))
    for f in seen:
        near = [g for g in seen if g != f and (f ^ g).bit_count() <= simhash.TAU]
        ends = ends or next(((a, f, b) for a in near for b in near if (a ^ b).bit_count() > simhash.TAU), None)
    texts, ids = [*(seen[f] for f in ends), prose(rng, 100), prose(rng, 90)], [9, None, 5, None, 3]
    got = simhash.near_duplicates(frame(spark, texts, ids)).collect()
    fps = [slow_simhash(t) for t in texts]
    want = slow_components(fps, ids)
    assert want == [5, 5, 5, None, 3]
    assert {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got} == set(zip(ids, fps, want))


@pytest.mark.parametrize(("block", "dense", "tau"), [(4, 10**6, 3), (2048, 10**6, 3), (4, 20, 3), (4, 1, 3), (4, 10**6, 6), (4, 10**6, 2), (4, 1, 2)])
def test_simhash_index_finds_every_link(spark, monkeypatch, block, dense, tau):
    """Dense clusters, whose buckets are cut into blocks or linked by values; all plans of the index."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(22)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, tau + 2)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps) + [0]
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "v long, fp long")
    roots = {r.v: r.root for r in graph.components(simhash.link(df, tau)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == slow_components(fps, list(range(len(fps))), tau)


@pytest.mark.parametrize("n", [60, 240])
def test_links_of_a_large_group_grow_with_its_rows(spark, monkeypatch, n):
    """Near copies of one text: about a link a row and task, not all that the pairs of blocks hold."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "plan_index", lambda fps, n, tau: [(list(range(60, 64)), tau)])  # one bucket holds them all
    rng = random.Random(23)
    fps = sorted({sum(1 << b for b in rng.sample(range(60), 2)) for _ in range(2 * n)})[:n]
    links = simhash.link(spark.createDataFrame(list(enumerate(fps)), "v long, fp long"), 4)
    blocks = -(-n // 16)
    of_bucket = 16  # values that the one part's four bits can have: each is a bucket of all rows
    assert links.count() <= of_bucket * (n + blocks * blocks)
    assert {r.root for r in graph.components(links).collect()} == {0} and links.count() >= n - 1


def test_near_duplicates_broadcast_nothing(spark, monkeypatch):
    """What is joined grows with the documents, so it must not pass through the driver, whatever the size it has here."""
    plans = []

    def spy(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, label)

    materialise = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", spy)
    monkeypatch.setattr(graph, "materialise", spy)
    rng = random.Random(24)
    docs = frame(spark, [prose(rng, 40) for _ in range(30)] * 2, list(range(60)))
    spy(simhash.keep_one(docs.withColumn("n_chars", F.length("text")), 20), "kept")
    spy(simhash.near_duplicates(docs), "classes")
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]


def test_pigeonhole_thresholds_suffice():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2**63, 500).astype(np.int64)
    for n, tau in [(n, tau) for n in (1_000, 10**7, 10**10) for tau in (3, 6)]:
        plan = simhash.plan_index(sample, n, tau)
        assert sum(t + 1 for _, t in plan) == tau + 1 and len({b for p, _ in plan for b in p}) == sum(len(p) for p, _ in plan)
        for _ in range(50):
            x = int(rng.integers(0, 2**63))
            y = x
            for b in rng.choice(64, tau, replace=False):
                y ^= 1 << int(b)
            both = [{(k, int(v[0])) for k, v in simhash.signatures(np.array([z], np.uint64).view(np.int64), plan)} for z in (x, y)]
            assert both[0] & both[1]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 5), (300, 299)]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 140)} | {299: 299, 300: 299}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    rng = random.Random(23)
    a = prose(rng, 50)
    df = frame(spark, [a, a, prose(rng, 60), None, "", a], [5, 3, 4, 8, 9, 3])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 8]


def test_keep_one_of_a_thousand_rows_of_one_id_and_none(spark):
    rng = random.Random(26)
    texts = [prose(rng, 40) for _ in range(700)]
    rows = [(i, t) for i in (None, 7) for t in (*texts[:700], *texts[:300])]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()]
    assert len(kept) == len({slow_simhash(t) for t in texts}) and {i for i, _ in kept} == {7}
    assert simhash.keep_one(frame(spark, ["x"]).limit(0)).count() == 0 == simhash.near_duplicates(frame(spark, ["x"]).limit(0)).count()


def test_keep_one_judges_rows_not_ids(spark):
    rng = random.Random(24)
    a, b, c, d = (prose(rng, 50) for _ in range(4))
    df = frame(spark, [a, a, b, a, c, d, d, c], [3, 7, 7, None, None, None, None, 8]).selectExpr("*", "'x' as row")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a), (7, b), (8, c), (None, d)], key=str)


# ---- top-k search


def test_top_k_against_sql_and_odd_vectors(spark):
    rng = np.random.default_rng(31)
    centre = rng.normal(size=(5, 12))
    v = [(centre[i % 5] + 0.2 * rng.normal(size=12)).tolist() for i in range(700)]
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(700)]
    rows[50] = (50, [0.0] * 12)
    rows[3], rows[4], rows[6], rows[7] = (3, None), (4, [None, *v[4][1:]]), (6, [float("nan"), *v[6][1:]]), (7, [float("inf"), *v[7][1:]])
    rows += [(8000 + k, rows[100][1]) for k in range(8)]  # ties
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, annulus string").repartition(4)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).toPandas()
    con = duckdb.connect()
    frame_ = pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows]})  # noqa: F841
    con.sql("create table embeddings as select vec_id, embedding::FLOAT[] as embedding from frame_")
    want = con.sql(topk.SQL).df()
    cols = ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got[cols].to_numpy().tolist())) == sorted(map(tuple, want[cols].to_numpy().tolist()))


@pytest.mark.parametrize("block", [16_384, 5])
def test_top_k_of_many_copies_and_small_annuli(spark, monkeypatch, block):
    """A third of all rows have one vector; ids of several vectors; annuli of a few points; queries in many blocks."""
    for name, value in (("QUERIES", block), ("CHUNK", 16), ("SPAN", 3), ("BAND", 32), ("PRODUCT", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(33)
    v = rng.integers(-2, 3, size=(900, 4)) / 4.0 + (rng.random((900, 4)) < 0.02) / 8
    v[::3] = v[0]
    ids = [*range(880), *([100] * 6), *([101] * 7), *([None] * 7)]
    rows = [(i, x.tolist()) for i, x in zip(ids, v)] + [(9999, [1.0]), (50, [2.0, 1.0]), (9998, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 50 == 0).collect()
    q = np.floor(v * 256).astype(int)
    want = []
    for own in sorted({i for i in ids if i is not None and i % 50 == 0}):
        asks = {tuple(q[r]) for r, i in enumerate(ids) if i == own}
        near = sorted((-int(np.dot(x, q[r])), i is None, i or 0) for x in asks for r, i in enumerate(ids) if i != own)
        want += [(own, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(near[:5])]
    assert sorted(map(tuple, got)) == sorted(want, key=lambda w: w[:2])


def test_top_k_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [9.0, 9.0]), (50, None)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, None), (0, 2, 1), (0, 3, 1)]
    assert topk.top_k(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(few, F.col("vec_id") == 77).count() == 0


# ---- the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(41)
    bad = ["vilexa", "vilexon", "vilexim"]
    shared = prose(rng, 60)
    texts, toxic = [], []
    for k in range(200):
        y = int(k % 4 == 0)
        t = " ".join(rng.choice(bad) if y and rng.random() < 0.25 else prose(rng, 1) for _ in range(rng.randint(30, 200)))
        texts.append(t + (" " + shared + " end" if k % 7 == 0 else ""))
        toxic.append(y)
    texts += [texts[1], "12345 !!", None]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), f"test-{name}")
        seen[name] = docs
        assert name == "packing" or docs.columns == names
    ids = {k: {r.doc_id for r in v.select("doc_id").distinct().collect()} for k, v in seen.items()}
    clean = {i for i, y in enumerate(toxic) if not y}
    assert len(ids["toxicity"] & clean) > 0.95 * len(clean) and len(ids["toxicity"] - clean - {200, 201, 202}) < 5
    assert not {201, 202} & ids["language"] and ids["toxicity"] - ids["language"] <= {201, 202}
    assert 200 not in ids["near_duplicates"] and 1 in ids["near_duplicates"]
    before = {r.doc_id: r.text for r in seen["near_duplicates"].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in seen["repeated_passages"].collect()}
    order = sorted(before)
    for i, (r, gone) in zip(order, slow_removed([before[i] for i in order], order)):
        kept = bytes(np.frombuffer(r, np.uint8)[~gone]).decode("utf-8", "ignore")
        assert after.get(i, ("", 0)) == (kept, len(kept))
    assert ids["packing"] == ids["repeated_passages"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.count() == seen["packing"].count()


def run_stages(spark, folder, rows, labels):
    """Every stage's output, for documents with extra columns whose names operators use inside."""
    import corpus_pipeline

    extra = ("fp", "row", "runs", "key", "bucket", "rest", "label", "rank", "v")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'x' as {n}" for n in extra))
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(folder)), f"test-{name}")
        assert name == "packing" or docs.columns == df.columns
        out[name] = docs
    return {k: v.collect() for k, v in out.items()}


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, ties, repeated rows, nulls in every column, empty and very long texts, clashing columns."""
    import corpus_pipeline

    rng = random.Random(43)
    clean = [prose(rng, rng.randint(40, 120)) for _ in range(60)]
    rows = [(k, t, "en" if k % 3 else None, None, len(t)) for k, t in enumerate(clean[:40])]
    rows += [(None, t, "en", "s", None) for t in clean[40:50]] + [(7, t, None, "s", len(t)) for t in clean[50:]]
    rows += [rows[3], rows[3], (None, None, None, None, None), (99, "", "en", None, 0), (100, " ".join([prose(rng, 50)] * 2) + prose(rng, 30_000), "en", "s", 0), (101, clean[0], "en", "s", 5)]
    got = run_stages(spark, tmp_path, rows, [(k, None, k % 2 if k % 5 else None) for k in range(10)] + [(None, 1, 1)])
    texts = {k: [(r.doc_id, r.text) for r in v] for k, v in got.items() if k != "packing"}
    for before, after in (("documents", "toxicity"), ("toxicity", "language"), ("language", "near_duplicates")):
        left = list(texts[before])
        for x in texts[after]:
            left.remove(x)  # rows are kept as they are, never more often than they came
    # One row of each class of equal fingerprints and their links stays, whatever ids the rows share.
    kept = texts["near_duplicates"]
    fps = [slow_simhash(t) for _, t in texts["language"]]
    classes = slow_components(fps, list(range(len(fps))), corpus_pipeline.NEAR_BITS)
    assert len(kept) == len(set(classes)) and {t for _, t in kept} <= {t for _, t in texts["language"]}
    assert len(texts["repeated_passages"]) >= len(kept) - 1 and all(r.n_chars == len(r.text) for r in got["repeated_passages"] if r.text is not None)
    packed = {}
    for r in got["packing"]:
        packed[r.sequence_id] = packed.get(r.sequence_id, 0) + r.length
    assert max(packed.values()) <= 1024 and sum(r.start == 0 for r in got["packing"]) == len(texts["repeated_passages"])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert all(not v for v in run_stages(spark, tmp_path, [], []).values())


def test_queries_run_over_the_given_tables(spark):
    """Each query's columns and their types, over whole tables: one row a document (page, or query and rank)."""
    from panelyx.llm import queries

    n = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    want = {
        "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        "op2_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
        "op3_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op4_winnowing_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        "op5_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
        "op6_pivot_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
        "op7_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
        "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op9_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
        "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    }
    for name, f in queries.queries().items():
        df = f(spark, "/root/testdata/sf0.001")
        assert set(want[name].split(", ")) <= {f"{c.name} {c.dataType.simpleString()}" for c in df.schema}, name
        rows = df.count()
        assert rows == {"op6_pivot_top_k": 5 * -(-n["embeddings"] // 50), "op7_url_filters": n["pages"]}.get(name, n["documents"]) or name == "op1_packing" and rows >= n["documents"], name


def test_registry():
    from panelyx.llm import queries

    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))
    assert set(queries.oracle_sql()) == {"op6_pivot_top_k", "op7_url_filters"}
    assert hashlib.sha256(b"").hexdigest()
