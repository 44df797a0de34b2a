"""Orchard search, product codes and whitening against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
from volarium.llm.orchard import compress, nearest, neighbour_lists
from volarium.llm.whitening import BLOCK_BYTES, numbered, row_blocks, transpose_times, whiten
from volarium.session import stage


def plain_codes(vectors, parts, entries, rounds):
    """All distances to all entries, in plain integers."""
    width = len(vectors[0]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda c, p: min((apart(c[p], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        books = [[[sum(x) // len(own) for x in zip(*own)] if (own := [c[p] for c in cut if best(c, p)[1] == k]) else books[p][k] for k in range(len(books[p]))] for p in range(parts)]
    found = [[best(c, p) for p in range(parts)] for c in cut]
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


def test_nearest_entry_with_ties():
    rng = np.random.default_rng(3)
    for entries, spread in ((1, 5), (2, 2), (16, 3), (16, 400), (200, 6)):
        books = rng.integers(-spread, spread + 1, (3, entries, 4))
        points, part = rng.integers(-spread, spread + 1, (4000, 4)), rng.integers(0, 3, 4000)
        best, distance = nearest(points, part, books, *neighbour_lists(books))
        every = ((points[:, None, :] - books[part]) ** 2).sum(-1)
        assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()


def rows_of(n, seed, dims=16):
    rng = random.Random(seed)
    return [(k * 3 % 101, [rng.uniform(-1, 1) if rng.random() < 0.9 else rng.choice([0.0, 0.25, -0.25]) for _ in range(dims)], rng.choice([1, 2, None])) for k in range(n)]


@pytest.mark.parametrize("n", [3, 60])
def test_codes(spark, n):
    rows = rows_of(n, n) + ([(0, [0.5] * 16, 1)] * 3 + [(None, [-0.5] * 16, None), (None, [0.125] * 16, 9)] if n > 3 else [])
    bad = [(1, None, 1), (2, [], 1), (2, [float("nan")] + [0.0] * 15, 1), (4, [None] + [0.0] * 15, 1), (5, [float("-inf")] + [0.0] * 15, 2)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    whole = lambda v: [int(np.floor(4096 * x)) for x in v]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, whole(r[1])))
    codes, errors, books = plain_codes([whole(r[1]) for r in order], 8, 16, 6)
    got = compress(df.repartition(5))
    assert got.codebooks == books and got.rows.rows == len(rows)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in got.rows.table.collect()), key=repr) == sorted(((r[0], r[2], c, e) for r, c, e in zip(order, codes, errors)), key=repr)


def test_codes_of_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [0.5, 1.5], "a", 7), (2, [0.25, 3.0], "b", 8)], "vec_id long, embedding array<float>, code string, integers int")
    got = compress(df.selectExpr("*", "integers AS error", "vec_id AS part"), parts=2, entries=2)
    assert got.rows.table.columns == ["vec_id", "integers", "part", "code", "error"]
    assert {r.vec_id: (r.code, r.error, r.integers) for r in got.rows.table.collect()} == {1: ("0000", 0, 7), 2: ("0101", 0, 8)}
    none = compress(df.where("false"))
    assert none.rows.table.count() == 0 and none.codebooks == [[]] * 8 and none.rows.table.columns[-2:] == ["code", "error"]


@pytest.mark.parametrize("vectors,error", [([[1.0] * 8, [1.0] * 16], "components"), ([[1.0] * 9], "equal parts"), ([[1e30] * 8], "after scaling")])
def test_codes_refuse(spark, vectors, error):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match=error):
        compress(df)


def exact_covariance(x):
    """In fractions, so without any rounding but the last."""
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    return np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n)) for j in range(d)] for i in range(d)]), sums


def test_whitening_query(spark, sf):
    vectors = [(r.vec_id, [int(np.floor(1024.0 * c)) + 100000 for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    cov, sums = exact_covariance([x for _, x in vectors])
    value, axes = np.linalg.eigh(cov)
    value, axes, n = value[::-1][:8], axes[:, ::-1][:, :8], len(vectors)
    got = entry.queries()["op13_block_whitening"](spark, sf).collect()
    assert len(got) == 8 * n and len({(r.vec_id, r.component) for r in got}) == 8 * n
    mean = np.array([float(Fraction(s, n)) for s in sums])
    want = {v: ((np.array(x) - mean) @ axes / np.sqrt(value), sum((n * c - s) ** 2 for c, s in zip(x, sums))) for v, x in vectors}
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        w, dev = want[r.vec_id]
        sign = signs.setdefault(r.component, np.sign(r.whitened * w[r.component - 1]))
        assert abs(sign * r.whitened - w[r.component - 1]) < 1e-8 and r.deviation == dev and r.n == n
        assert abs(r.explained / (value[r.component - 1] / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-8


def test_whitening_of_many_blocks(spark, monkeypatch):
    """Several row blocks and splits give the same scatter as one product, rows numbered without gaps."""
    monkeypatch.setattr("volarium.llm.whitening.BLOCK_BYTES", 8 * 6 * 10)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6)) * [5, 4, 3, 2, 1, 0.5] + 1e8
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    kept = stage(df, "vectors")
    rows = numbered(kept, "index")
    assert sorted(r[0] for r in rows.select("index").collect()) == list(range(500))
    a = row_blocks(rows, "index", rows["embedding"], 6)
    assert a.rowsPerBlock == 10 < BLOCK_BYTES and np.allclose(transpose_times(a), x.T @ x)
    fit = whiten(df, 3)
    centred = x - x.mean(0)
    value, axes = np.linalg.eigh(centred.T @ centred / 500)
    got = np.array([r.whitened for r in fit.rows.orderBy("vec_id").collect()])
    want = centred @ axes[:, ::-1][:, :3] / np.sqrt(value[::-1][:3])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-5) and fit.identity_error < 1e-4 and np.allclose(fit.eigenvalues, value[::-1][:3], rtol=1e-6)


def test_whitening_without_variance_and_without_rows(spark):
    schema = "vec_id long, embedding array<double>, whitened int, index int, file string"
    df = spark.createDataFrame([(None, [1.0, 2.0], 1, 2, "f"), (4, [1.0, 2.0], 1, 2, None), (5, None, 1, 1, "g"), (6, [], 1, 1, "g"), (7, [float("nan"), 1.0], 1, 1, "g")], schema)
    fit = whiten(df)
    assert sorted((r.vec_id or 0, r.whitened, r["index"], r.file) for r in fit.rows.collect()) == [(0, [None, None], 2, "f"), (4, [None, None], 2, None)]
    assert fit.n == 2 and fit.explained == [0.0, 0.0] and fit.identity_error == 0
    line = whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(5)], "vec_id long, embedding array<double>"))
    assert all(r.whitened[1:] == [None, None] for r in line.rows.collect()) and line.identity_error < 1e-9 and abs(line.explained[0] - 1) < 1e-12
    assert whiten(df.where("false")).rows.count() == 0
    with pytest.raises(ValueError, match="components"):
        whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
