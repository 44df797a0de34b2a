"""Embedding near-dedup as an exact metric range join over pivots.

Equal vectors form a class first, so copies are compared once. Unit vectors link if their cosine is at least the
threshold, that is, if their Euclidean distance is at most r. Every class belongs to the cell of its nearest pivot. A
partner y of x that lives in cell j while x lives in cell i satisfies, by the triangle inequality, d(x, pj) - d(x, pi)
<= 2 r, and for unit vectors even (x.pi - x.pj) / |pi - pj| <= r, the distance of x from the border between the two
cells; x is replicated to every cell within that bound. So a cell sees all partners of its own vectors and cells
join independently. A large cell is cut into blocks of own vectors times blocks of replicas. A block counts its links
and returns a spanning forest of them, never the pairs.

In high dimensions with unclustered vectors the bound spares little and replication comes near to all cells; the result is exact anyway.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or whose id is null, links
with nothing; vectors of different lengths never link; equal ids in several rows are several vectors of one node; an empty table gives an
empty table; other columns pass through unless they are named like a result column, which replaces them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volarium.llm.components import components
from volarium.session import stage

RESULT = ("n_links", "component_id", "kept")
CELL_CLASSES = 4096      # classes of a cell and of a block of own vectors, on average
REPLICA_BLOCK = 32768
MAX_PIVOTS = 256
TILE = (512, 8192)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones padded with zeros, and their lengths."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    sizes = np.asarray(array.value_lengths().fill_null(0), np.int64)
    values = np.asarray(array.flatten(), float)
    out = np.zeros((len(array), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out, sizes


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def tile_forest(rows: np.ndarray, cols: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest id reached) that join what the links i - j between two id lists join."""
    label = np.concatenate((rows, cols))
    ids, j = label.copy(), j + len(rows)
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != ids)
    return ids[moved], label[moved]


def compare(block: pa.Table, threshold: float, width: int) -> pa.Table:
    """Own vectors of a block against its replicas: links of each own vector, and forest edges."""
    own = np.asarray(block.column("own"))
    vectors, sizes = matrix(block.column("vector"), width)
    ids, keys, times = (block.column(n).to_numpy() for n in ("id", "key", "times"))
    exact = unit(vectors)
    rough = exact.astype(np.float32)
    margin = 2e-7 * width + 1e-6
    at, other = np.flatnonzero(own), np.flatnonzero(~own)
    count, edges = np.zeros(len(at), np.int64), []
    for lo in range(0, len(at), TILE[0]):
        rows = at[lo:lo + TILE[0]]
        for left in range(0, len(other), TILE[1]):
            cols = other[left:left + TILE[1]]
            near = rough[rows] @ rough[cols].T
            i, j = np.nonzero(near >= threshold - margin)
            sure = near[i, j] >= threshold + margin
            for k in np.flatnonzero(~sure).tolist():
                x, y = vectors[rows[i[k]]], vectors[cols[j[k]]]
                sure[k] = float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= threshold
            sure &= sizes[rows[i]] == sizes[cols[j]]
            i, j = i[sure], j[sure]
            count[lo:lo + len(rows)] += np.bincount(i, weights=times[cols[j]], minlength=len(rows)).astype(np.int64)
            apart = ids[rows[i]] != ids[cols[j]]
            if apart.any():
                edges.append(tile_forest(ids[rows], ids[cols], i[apart], j[apart]))
    a = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, np.int64)
    b = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.int64)
    none = pa.nulls(len(a), pa.int64())
    return pa.table({"a": pa.concat_arrays([pa.array(ids[at]), pa.array(a)]), "key": pa.concat_arrays([pa.array(keys[at]), none]),
                     "n": pa.concat_arrays([pa.array(count), none]), "b": pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(b)])})


def link_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", max_pivots: int = MAX_PIVOTS,
                 cell_classes: int = CELL_CLASSES) -> DataFrame:
    """Every row without its vector, with n_links (other vectors linked directly), component_id (smallest id reachable) and kept."""
    vectors = vectors.drop(*RESULT)
    v = F.col(vector_col)
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = vectors.withColumn("sound__", F.coalesce(sound, F.lit(False)))
    good = rows.where("sound__").select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))
    classes = stage(good.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("times")).withColumn("key", F.xxhash64("vector")), "vector-classes")
    if not classes.rows:
        return _named(rows, id_col, vector_col).select("*", F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"), F.col(id_col).isNotNull().alias("kept"))
    width = classes.table.agg(F.max(F.size("vector"))).first()[0]
    wanted = min(max_pivots, max(2, -(-classes.rows // cell_classes)))
    chosen = classes.table.orderBy(F.xxhash64("id", "key"), "id", "key").limit(wanted).select("vector").toArrow()
    pivots = unit(matrix(chosen.column(0), width)[0])
    gaps = np.sqrt(np.maximum(0, 2 - 2 * np.clip(pivots @ pivots.T, -1, 1)))
    radius = math.sqrt(2 - 2 * threshold) + 1e-6

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = unit(matrix(batch.column("vector"), width)[0]) @ pivots.T
            home = cos.argmax(axis=1)
            gap = gaps[home]
            inside = (cos[np.arange(len(home)), home][:, None] - cos) <= radius * gap + 1e-9
            row, cell = np.nonzero(inside)
            keep = batch.select(["vector", "id", "times", "key"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(cell.astype(np.int64)), pa.array(cell == home[row])], names=[*keep.schema.names, "cell", "home"])

    schema = classes.table.select("vector", "id", "times", "key").withColumns({"cell": F.lit(0).cast("long"), "home": F.lit(True)}).schema
    dealt = stage(classes.table.repartition("id", "key").mapInArrow(deal, schema), "cells").table
    sizes = stage(dealt.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count_if("home") / cell_classes)).alias("own_blocks"),
                                            F.ceil(F.count("*") / REPLICA_BLOCK).alias("replica_blocks")), "cell-sizes").table
    placed = dealt.join(F.broadcast(sizes), "cell")  # a row for each of at most `max_pivots` cells
    of = {n: F.pmod(F.xxhash64("id", "key"), F.col(n)) for n in ("own_blocks", "replica_blocks")}
    every = {n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in of}
    keep = ["cell", "vector", "id", "times", "key"]
    own = placed.where("home").select(*keep, F.lit(True).alias("own"), of["own_blocks"].alias("x"), every["replica_blocks"].alias("y"))
    replicas = placed.select(*keep, F.lit(False).alias("own"), every["own_blocks"].alias("x"), of["replica_blocks"].alias("y"))
    found = stage(own.unionByName(replicas).groupBy("cell", "x", "y").applyInArrow(lambda t: compare(t, threshold, width), "a long, key long, n long, b long"), "links").table
    counts = found.where("b is null").groupBy(F.col("a").alias("id"), "key").agg(F.sum("n").alias("n"))
    reach = components(found.where("b is not null").select("a", "b"), "vector-components")
    named = classes.table.select("id", "key", "vector").join(counts, ["id", "key"]).join(reach, F.col("id") == F.col("node"), "left").select(
        "vector", (F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked = rows.where("sound__").join(named.withColumnRenamed("vector", vector_col), vector_col)
    single = rows.where("not sound__").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col(id_col).cast("long")})
    both = linked.unionByName(single)
    return _named(both, id_col, vector_col).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _named(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.drop("sound__", vector_col)
