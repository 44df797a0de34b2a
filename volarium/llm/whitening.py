"""Whitening with distributed block matrices (MLlib BlockMatrix).

The rows are written once and numbered by file and row of file; the centred vectors become an indexed row matrix, that a block matrix A. The
transpose times A is the scatter matrix; its size is that of one vector squared, so it is decomposed on the driver. A times the
whitening matrix (unit eigenvectors over the square roots of their eigenvalues) projects all rows, block by block.

Centring comes before any product: integers are summed exactly, and a mean is subtracted as its nearest integer (exact) and a rest below
one, so a large common offset costs no digits. The middle dimension of the transpose product, the rows, is cut into splits of
`BLOCKS_A_SPLIT` blocks, so that no task gathers all blocks of A; without the cut MLlib would send them to the single
result block. All work on rows is in the JVM; the driver holds sums, the scatter and the whitening matrix, whose sizes follow
the length of a vector, not the number of rows.

Defined cases: a row whose vector is null, empty or holds null or non-finite entries is dropped; vectors of different lengths raise an error; equal rows
count as often as they occur, also with null or equal ids; vectors shorter than `components` give as many components as they
have entries; a component without variance (all vectors equal, or fewer of them than components) has explained 0 and whitened null and
takes no part in identity_error; an empty table gives an empty table; other columns pass through unless they are
named like a result column, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volarium.llm.naming import free_names
from volarium.llm.orchard import common_length, sound
from volarium.session import Staged, attach, stage

RESULT = ("whitened",)
BLOCK_BYTES = 1 << 22
BLOCKS_A_SPLIT = 8


@dataclass(frozen=True)
class Whitening:
    """`rows` are all kept rows with `whitened` (an array, one number a component); the rest describes the fit."""

    rows: DataFrame
    n: int
    sums: list
    eigenvalues: list[float]
    explained: list[float]
    identity_error: float


def numbered(kept: Staged, index: str) -> DataFrame:
    """A 0-based number for every row of a written table: the rows of the files before, and its place in its own file."""
    file, place = free_names((*kept.table.columns, index), "file", "place")
    meta = kept.table.metadataColumn("_metadata")
    rows = kept.table.select("*", meta["file_name"].alias(file), meta["row_index"].alias(place))
    counts = rows.groupBy(file).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(F.lit(1)).orderBy(file).rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    offsets = stage(counts.select(file, F.coalesce(before, F.lit(0)).alias(index)), "file-offsets")
    return attach(rows, offsets, [file]).withColumn(index, F.col(index) + F.col(place)).select(*kept.table.columns, index)


def column_sums(table: DataFrame, vector_col: str, length: int) -> list:
    """The sum of every entry, exact (a whole number) for integer vectors."""
    whole = isinstance(table.schema[vector_col].dataType.elementType, T.IntegralType)
    entries = table.select(F.posexplode(vector_col).alias("pos", "value"))
    sums = {r["pos"]: r["total"] for r in entries.groupBy("pos").agg(F.sum(F.col("value").cast("decimal(38,0)" if whole else "double")).alias("total")).collect()}
    return [int(sums[i]) if isinstance(sums[i], Decimal) else float(sums[i]) for i in range(length)]


def centred(vector_col: str, sums: list, n: int):
    """The vector less the mean: first the integer next to the mean, then what is left of it."""
    shift = [round(Fraction(s) / n) for s in sums]
    rest = [float(Fraction(s) / n - t) for s, t in zip(sums, shift, strict=True)]
    steps = F.array(*[F.struct(F.lit(float(t)).alias("shift"), F.lit(r).alias("rest")) for t, r in zip(shift, rest, strict=True)])
    return F.zip_with(vector_col, steps, lambda x, s: (x.cast("double") - s["shift"]) - s["rest"])


def row_blocks(rows: DataFrame, index: str, values, length: int) -> BlockMatrix:
    """The block matrix of the rows; built from a DataFrame, so that no row passes through Python."""
    vectors = rows.select(F.col(index).alias("index"), array_to_vector(values).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector")).toBlockMatrix(max(1, BLOCK_BYTES // (8 * length)), length)


def transpose_times(a: BlockMatrix) -> np.ndarray:
    """A' A as a local matrix. PySpark's multiply does not pass on how often the middle dimension is split, so the JVM method is called."""
    blocks = -(-a.numRows() // a.rowsPerBlock)
    java = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, max(1, -(-blocks // BLOCKS_A_SPLIT)))
    return BlockMatrix(java, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def rows_times(a: BlockMatrix, right: np.ndarray) -> DataFrame:
    """(index, vector) of A times a local matrix, which becomes a block matrix of one block."""
    sc = a.blocks.context
    local = sc.parallelize([((0, 0), Matrices.dense(*right.shape, right.flatten("F").tolist()))], 1)
    product = a.multiply(BlockMatrix(local, right.shape[0], right.shape[1])).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)


def deviation_from_identity(rows: DataFrame, column: str, places: list[int]) -> float:
    """Largest absolute entry of the column's covariance (divisor n, centred first) minus the identity, over the given components."""
    if not places:
        return 0.0
    value = {i: F.get(column, F.lit(i)) for i in places}
    mean = rows.agg(*[F.avg(value[i]).alias(f"m{i}") for i in places]).first()
    pairs = [(i, j) for i in places for j in places if i <= j]
    cov = rows.agg(*[F.avg((value[i] - mean[f"m{i}"]) * (value[j] - mean[f"m{j}"])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = 8, vector_col: str = "embedding") -> Whitening:
    """Fit on all sound rows and project them on the leading components; signs make the largest entry of an eigenvector positive."""
    vectors = vectors.drop(*RESULT)
    kept = stage(vectors.where(sound(F.col(vector_col).cast("array<double>"))), "vectors")
    length, n = common_length(kept.table, vector_col), kept.rows
    if not n:
        return Whitening(kept.table.withColumn("whitened", F.array().cast("array<double>")), 0, [], [], [], 0.0)
    sums = column_sums(kept.table, vector_col, length)
    index, key, vector = free_names((*vectors.columns, *RESULT), "index", "key", "vector")
    rows = numbered(kept, index)
    a = row_blocks(rows, index, centred(vector_col, sums, n), length).persist(StorageLevel.MEMORY_AND_DISK)  # used three times; made again if lost
    scatter = transpose_times(a)
    value, axes = np.linalg.eigh((scatter + scatter.T) / 2 / n)
    value, axes = np.maximum(value[::-1], 0.0)[:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    varies = value > value[0] * length * np.finfo(float).eps
    projected = rows_times(a, axes / np.sqrt(np.where(varies, value, 1.0)))
    numbers = vector_to_array(F.col(vector))
    held = F.array(*[F.get(numbers, F.lit(i)) if ok else F.lit(None).cast("double") for i, ok in enumerate(varies.tolist())])
    found = projected.select(F.col("index").alias(key), F.col("vector").alias(vector)).select(key, held.alias("whitened"))
    out = stage(rows.join(found, F.col(index) == F.col(key)).select(*vectors.columns, "whitened"), "whitened").table
    a._java_matrix_wrapper.call("blocks").unpersist(False)
    total = float(np.trace(scatter)) / n
    explained = [float(v) / total if ok else 0.0 for v, ok in zip(value, varies, strict=True)]
    return Whitening(out, n, sums, value.tolist(), explained, deviation_from_identity(out, "whitened", np.flatnonzero(varies).tolist()))
