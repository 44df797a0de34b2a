"""SimHash, embedding links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from volarium.llm.components import components
from volarium.llm.pivots import link_vectors
from volarium.llm.simhash import links, near_copies
from volarium.session import stage


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    want = roots(600, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(5000, None), (5001, ""), (5002, " \n"), (5003, "Two words"), (5004, "two  WORDS"), (None, "two words"), (5003, "two words")]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = roots(len(rows), edges)
    lowest = {}
    for (d, _), c in zip(rows, root):
        if d is not None:
            lowest[c] = min(lowest.get(c, d), d)
    assert got == {(d, f"{f:016x}", lowest[c]) for (d, _), f, c in zip(rows, fps, root)}


@pytest.mark.parametrize("hot", [1000, 1])
def test_links_join_the_same_classes(spark, hot):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & ((1 << 64) - 1) for s in seeds for _ in range(8)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 for r in got)
    at = {f: k for k, f in enumerate(signed)}
    assert roots(len(fps), [(at[r.a], at[r.b]) for r in got]) == roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])


def broadcasts(df):
    """What stands below each broadcast of the plan that ran, and of the one it began with."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [next((k for k, c in enumerate(x) if c.isalnum()), 0) for x in lines]
    tops = [k for k, x in enumerate(lines) if "BroadcastExchange" in x]
    return ["\n".join(lines[k:next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))]) for k in tops]


@pytest.mark.parametrize("hot", [1000, 1])
def test_links_broadcast_only_hot_segments(spark, hot):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 1 << 20  # the tables here are small enough for Spark
    classes = stage(spark.range(2000).select(F.expr("if(id < 40, id * 4294967296L + 7, xxhash64(id))").alias("fp")), "classes").table
    found = broadcasts(links(classes, hot))
    assert len(found) > 0 if hot == 1 else found == []
    assert all("Generate" not in x and "fp#" not in x for x in found)


def test_near_copies_broadcast_nothing(spark):
    rows = [(k, f"some {k % 60} words {k % 7} of {k % 90} text") for k in range(300)]
    assert broadcasts(near_copies(spark.createDataFrame(rows, "doc_id long, text string"))) == []


def test_near_copies_empty(spark):
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("cell", [4096, 40])
def test_vectors(spark, cell):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * rng.choice([0.01, 0.05, 0.5])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)] + [(1100, [2 * x for x in rows[7][1]])]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, [float("nan")] * 16), (2005, [float("inf")] * 16), (2006, [1.0] * 3), (2007, [1.0] * 3)]
    x = np.array([r[1] for r in rows], float)
    near = (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None]) >= 0.95
    root = roots(len(rows), zip(*np.nonzero(near)))
    want = {(rows[i][0], int(near[i].sum()) - 1, rows[root[i]][0], root[i] == i) for i in range(len(rows))}
    want |= {(i, 0, i, True) for i, _ in odd[:6]} | {(2006, 1, 2006, True), (2007, 1, 2006, False)}
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in link_vectors(frame, cell_classes=cell).collect()}
    assert got == want


def test_vectors_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert link_vectors(empty).count() == 0
    only = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in link_vectors(only).select("vec_id", "n_links", "component_id", "kept").collect()] == [(1, 0, 1, True)]
