"""Vector codes by product quantisation, with Orchard's search for the nearest codebook entry.

A component x becomes the integer floor(`scale` * x); a vector is cut into `parts` equal consecutive parts, each with a codebook of at most `entries`
entries, which start as the parts of the smallest ids. A round assigns every part to its nearest entry (squared Euclidean distance, ties to
the lower index) and replaces each entry by the componentwise floor of its parts' mean; unused entries stay. All numbers are integers,
so the result does not depend on how the rows are dealt out.

Orchard's search: every entry has a list of all entries sorted by their distance from it. The search holds a current best entry and walks
down its list; an entry not visited before is marked and compared, and if it is closer to the point (or as close, with a lower index) the
search jumps to that entry's list. It stops where the list goes beyond twice the current distance: by the triangle inequality nothing
further can be as close. A batch of points walks together, one step of every open search at a time.

On Spark: the integer vectors are written once; a round is one pass over them in which a task returns the sums of its parts for each
entry, and Spark adds those up. The driver holds the codebooks alone (parts x entries x part length integers, with
their neighbour lists the only thing that tasks are sent), never vectors or codes.

Defined cases: a row whose vector is null, empty or holds null or non-finite components is dropped; a null id is larger than any other; rows with
equal ids are vectors of their own, in the order of their components; with fewer vectors than `entries` a codebook has one entry for each;
an empty table gives an empty table and empty codebooks; vectors of different lengths, a length that the parts do not divide, or
components too large for exact 64-bit distances raise an error; other columns pass through unless they are named like a
result column, which replaces them; the vector itself is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volarium.llm.naming import free_names
from volarium.session import Staged, stage

RESULT = ("code", "error")
BATCH = 4096       # vectors that are searched together
LARGEST = 1 << 26  # of a component; 4 times a squared distance over up to 512 components stays below 2^63


@dataclass(frozen=True)
class Codes:
    """`rows` with code and error, and the codebooks by part, entry and position within the part."""

    rows: Staged
    codebooks: list[list[list[int]]]


def sound(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def common_length(table: DataFrame, vector_col: str) -> int:
    """The length of all vectors, 0 without any; different lengths are an error."""
    least, most = table.agg(F.min(F.size(vector_col)), F.max(F.size(vector_col))).first()
    if least != most:
        raise ValueError(f"the vectors have between {least} and {most} components")
    return least or 0


def squared(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(-1)


def neighbour_lists(codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between the entries of each part, and for every entry all entries from the nearest to the furthest."""
    between = squared(codebooks[:, :, None, :] - codebooks[:, None, :, :])
    return between, np.argsort(between, axis=2, kind="stable")


def nearest(points: np.ndarray, part: np.ndarray, codebooks: np.ndarray, between: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each point in the codebook of its part."""
    entries = codebooks.shape[1]
    best, step = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    distance = squared(points - codebooks[part, 0])
    visited = np.zeros((len(points), entries), bool)
    visited[:, 0] = True
    open_ = np.arange(len(points))
    while len(open_):
        at, held = part[open_], best[open_]
        entry = lists[at, held, step[open_]]
        near = between[at, held, entry] <= 4 * distance[open_]  # squares of distances: not beyond twice the current one
        open_, entry = open_[near], entry[near]
        new = ~visited[open_, entry]
        who, what = open_[new], entry[new]
        visited[who, what] = True
        found = squared(points[who] - codebooks[part[who], what])
        closer = (found < distance[who]) | ((found == distance[who]) & (what < best[who]))
        step[open_] += 1
        who, what = who[closer], what[closer]
        best[who], distance[who], step[who] = what, found[closer], 0
        open_ = open_[step[open_] < entries]
    return best, distance


def assign(column: pa.Array, codebooks: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts (vector, part, position), their entries and squared distances, a batch of vectors at a time."""
    parts, _, width = codebooks.shape
    for lo in range(0, len(column), BATCH):
        some = column.slice(lo, BATCH)
        cut = np.asarray(some.flatten()).astype(np.int64).reshape(len(some), parts, width)
        part = np.tile(np.arange(parts), len(some))
        best, distance = nearest(cut.reshape(-1, width), part, codebooks, *lists)
        yield cut, best.reshape(-1, parts), distance.reshape(-1, parts)


def next_codebooks(table: DataFrame, vector_col: str, codebooks: np.ndarray) -> np.ndarray:
    """One round: assign all parts, and the floor of the mean of each entry's parts."""
    lists = neighbour_lists(codebooks)
    parts, entries, width = codebooks.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for cut, best, _ in assign(batch.column(0), codebooks, lists):
                for p in range(parts):
                    counts[p] += np.bincount(best[:, p], minlength=entries)
                    np.add.at(totals[p], best[:, p], cut[:, p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(totals[part, entry]), pa.list_(pa.int64()))],
                                         names=["part", "entry", "n", "totals"])

    sums = [F.sum(F.get("totals", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    rows = table.select(vector_col).mapInArrow(add_up, "part long, entry long, n long, totals array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()
    out = codebooks.copy()
    for r in rows:  # at most parts x entries
        out[r["part"], r["entry"]] = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
    return out


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> Codes:
    """Every row kept with code (two hexadecimal digits a part) and error (squared distances to the chosen entries, summed over the parts)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part, so a codebook holds 1 to 256 entries")
    vectors = vectors.drop(*RESULT)
    others = [c for c in vectors.columns if c != vector_col]
    (integers,) = free_names((*vectors.columns, *RESULT), "integers")
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    checked = F.when(F.exists(whole, lambda x: F.abs(x) > LARGEST), F.raise_error(F.lit(f"a component is over {LARGEST} after scaling")).cast("array<bigint>")).otherwise(whole)
    kept = stage(vectors.where(sound(F.col(vector_col))).select(*others, checked.alias(integers)), "integer-vectors")
    length = common_length(kept.table, integers)
    if length % parts or length > 512:
        raise ValueError(f"{length} components cannot be cut into {parts} equal parts of at most 512 in all")
    width = length // parts
    if not kept.rows:
        empty = kept.table.select(*others, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return Codes(Staged(empty, 0), [[] for _ in range(parts)])
    first = kept.table.orderBy(F.col(id_col).asc_nulls_last(), integers).select(integers).limit(entries).collect()
    codebooks = np.asarray([r[0] for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        codebooks = next_codebooks(kept.table, integers, codebooks)
    lists = neighbour_lists(codebooks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, best, distance in assign(batch.column(integers), codebooks, lists):
                codes.extend(row.tobytes().hex() for row in best.astype(np.uint8))
                errors.extend(distance.sum(1).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*others, *RESULT])

    schema = kept.table.select(*others, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    return Codes(stage(kept.table.mapInArrow(encode, schema), "codes"), codebooks.tolist())
