"""Finding equal windows between whole texts without comparing all texts: anchors, blocks and shards.

Both substring operators work in the same four steps; they differ in what a window is (words or bytes), in how
the anchors are indexed and in the structure that decides.

1. Every window chooses an anchor, the smallest hash among the grams inside it; equal windows choose equal anchors.
2. Anchors are matched over the corpus. A row is (hash, block), so an anchor that a third of all documents share has
   one row per block of documents, not one per document.
3. Each block of documents gets its repeated anchors and emits the passages around them, equal passages once, those of a
   shard as one row, so that rows follow blocks and shards and not the windows of very common anchors. Passages go to shards by anchor hash; the shard decides window by window. An anchor with very many
   occurrences is not gathered: its windows are sharded by their own hash, where equal ones have been merged.
4. The decisions go back to the blocks, which cut the texts.

The documents are shuffled once, by block; both passes over them read that exchange.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from volarium.llm.arrowtext import chunks, minimizer_runs, release, text_buffer
from volarium.operators.ordering import number_rows
from volarium.session import Staged, stage

BLOCK_ROWS = 2048          # documents of a block, on average, if they are short;
BLOCK_BYTES = 24 << 20     # bytes of a block, on average, if they are long
LONG_TEXT = 4 << 20        # bytes beyond which a text does not share the block of its neighbours
SHARD_PASSAGES = 6000      # passages of a shard, on average
HOT_OCCURRENCES = 4000     # occurrences of an anchor beyond which its windows are sharded one by one

HOT = -1                   # anchor of a passage that is a single window

PASSAGES = "shard long, block__ long, anchor array<long>, ctx array<binary>, lo array<long>, places array<binary>"
SPANS = "block__ long, spans binary"


@dataclass(frozen=True)
class Windows:
    """How one chunk of texts is cut into windows: for each run of windows with one anchor its row, hash and extent."""

    length: int                     # items of a window
    gram: int                       # items of an anchor
    items: Callable                 # (data, offsets) -> (gram hashes, bounds of the rows in items)
    cut: Callable                   # (bytes of a row) -> object that `passage` slices
    passage: Callable               # (cut, first, last) -> bytes of the windows first..last
    single: Callable                # (cut, first) -> bytes that stand for the one window, equal for equal windows only


def whole_ids(docs: DataFrame, id_col: str) -> bool:
    return isinstance(docs.schema[id_col].dataType, IntegralType)


def with_order(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """Adds a whole number that orders the rows as their ids do; null ids stay null. Ids of other types are numbered in their order."""
    if whole_ids(docs, id_col):
        return docs.withColumn(name, F.col(id_col).cast("long"))
    ids = docs.select(F.col(id_col).alias("id__")).where("id__ IS NOT NULL").distinct()
    ranks = number_rows(ids, "id__", name).table
    return docs.join(ranks, F.col(id_col) == F.col("id__"), "left").drop("id__")


def block_rows(docs: DataFrame, id_col: str, text_col: str, rows_per_block: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Adds block__ and row_key__; rows with neighbouring ids (whole numbers) share a block, so that equal anchors meet early.

    There are as many blocks as rows and bytes ask for, both counted, and very long texts are dealt one by one.
    """
    bytes_ = F.octet_length(text_col)
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(bytes_.cast("long"))).first()
    blocks = max(8, -(-rows // rows_per_block), -(-(size or 0) // BLOCK_BYTES))
    group = F.floor(F.col(id_col) / 256) if whole_ids(docs, id_col) else F.xxhash64(F.col(id_col))
    near = F.coalesce(F.when(F.col(id_col).isNotNull() & ~(bytes_ > LONG_TEXT), group), F.xxhash64(F.col(id_col), F.col(text_col)))
    return docs.withColumns({"block__": F.pmod(F.xxhash64(near), F.lit(blocks)),
                             "row_key__": F.xxhash64(F.col(id_col), F.col(text_col))}), blocks


def anchor_rows(windows: Windows, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each chunk: row, first window, last window (in the row's items) and anchor hash of every run."""
    for lo, hi in chunks(offsets):
        part = offsets[lo:hi + 1]
        bytes_, rel = data[part[0]:part[-1]], part - part[0]
        grams, bounds = windows.items(bytes_, rel)
        per_window = windows.length - windows.gram + 1
        total = len(grams) - per_window + 1
        if total <= 0:
            continue
        valid = np.zeros(total, bool)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            valid[a:max(a, b - windows.length + 1)] = True
        first, last, pos = minimizer_runs(grams, valid, per_window)
        row = np.searchsorted(bounds, first, "right") - 1
        yield row + lo, first - bounds[row], last - bounds[row], grams[pos]


def anchors(docs: DataFrame, windows: Windows, text_col: str, id_col: str) -> DataFrame:
    """(hash, block, lo, hi, n, windows): the anchors of each block with the smallest and largest id that hold them, their occurrences and the windows that chose these."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            ids, block = (np.asarray(batch.column(i).fill_null(0)) for i in (1, 2))
            for row, first, last, h in anchor_rows(windows, data, offsets):
                order = np.lexsort((ids[row], block[row], h))
                h, b, i, runs = h[order], block[row][order], ids[row][order], (last - first + 1)[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])))) if len(h) else np.zeros(0, np.int64)
                ends = np.concatenate((new[1:], [len(h)]))[:len(new)]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(b[new]), pa.array(i[new]), pa.array(i[ends - 1] if len(new) else i[:0]),
                                                  pa.array((ends - new).astype(np.int64)), pa.array(np.add.reduceat(runs, new) if len(new) else runs)],
                                                 names=["hash", "block", "lo", "hi", "n", "windows"])
        release()
    return docs.select(text_col, F.col(id_col).cast("long"), "block__").mapInArrow(scan, "hash long, block long, lo long, hi long, n long, windows long")


def matched(found: DataFrame, label: str) -> Staged:
    """(block, hash, hot, windows) of repeated anchors, the last being the windows of the block that chose the anchor."""
    total = F.sum("n").over(Window.partitionBy("hash"))
    marked = found.select("block", "hash", (total > HOT_OCCURRENCES).alias("hot"), "windows")
    return stage(marked.groupBy("block", "hash", "hot").agg(F.sum("windows").alias("windows")), label)


def passages(blocked: DataFrame, wanted: Staged, windows: Windows, text_col: str, id_col: str) -> DataFrame:
    """The distinct passages of each block around its wanted anchors, with the rows that hold them: one row per block and shard.

    `places` packs (row key, id, first window) of every occurrence. The rows of `blocked` are read as they are, so that the
    operator's second pass over the same table reads the same exchange. Of a very common anchor the windows that chose it are counted, not as
    many as might around each occurrence: in a text that repeats itself occurrences follow each other closely and have few windows each.
    """
    load = wanted.table.agg(F.sum(F.when(F.col("hot"), F.col("windows")).otherwise(1))).first()[0] or 0
    shards = max(8, -(-load // SHARD_PASSAGES))

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[tuple[int, bytes], list[int]] = {}
        keys, hot = right.column("hash").to_numpy().view(np.uint64), np.asarray(right.column("hot"))
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        data, offsets = text_buffer(left.column(text_col))
        ids = left.column(id_col).to_pylist()
        row_keys = left.column("row_key__").to_pylist()
        for row, first, last, h in anchor_rows(windows, data, offsets) if len(keys) else ():
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == h)
            held, cut = -1, None
            for r, a, b, key, split in zip(row[hit].tolist(), first[hit].tolist(), last[hit].tolist(), h[hit].view(np.int64).tolist(), hot[place[hit]].tolist(), strict=True):
                if ids[r] is None:
                    continue
                if r != held:
                    held, cut = r, windows.cut(data[offsets[r]:offsets[r + 1]].tobytes())
                if split:
                    for x in range(a, b + 1):
                        out.setdefault((HOT, windows.single(cut, x)), []).extend((row_keys[r], ids[r], x))
                else:
                    out.setdefault((key, windows.passage(cut, a, b)), []).extend((row_keys[r], ids[r], a))
        release()
        block = left.column("block__")[0].as_py() if left.num_rows else 0
        shard = np.asarray([(hash_bytes(c) if k == HOT else k) % shards for k, c in out], np.int64)
        found, order = list(out.items()), np.argsort(shard, kind="stable")
        numbers, starts = np.unique(shard[order], return_index=True)
        bounds = pa.array(np.concatenate((starts, [len(order)])), pa.int32())
        found = [found[i] for i in order.tolist()]
        by_shard = lambda values, kind: pa.ListArray.from_arrays(bounds, pa.array(values, kind))
        return pa.table({"shard": pa.array(numbers, pa.int64()), "block__": pa.array([block] * len(numbers), pa.int64()), "anchor": by_shard([k for (k, _), _ in found], pa.int64()),
                         "ctx": by_shard([c for (_, c), _ in found], pa.binary()), "lo": by_shard([min(v[1::3]) for _, v in found], pa.int64()),
                         "places": by_shard([np.asarray(v, np.int64).tobytes() for _, v in found], pa.binary())})

    return blocked.groupBy("block__").cogroup(wanted.table.withColumnRenamed("block", "block__").groupBy("block__")).applyInArrow(emit, PASSAGES)


def unpack_shard(shard: pa.Table) -> tuple[list[int], list[bytes], list[int], list[int], list[bytes]]:
    """Anchor, passage, block, smallest id and places of every passage of a shard."""
    lists = {c: shard.column(c).combine_chunks() for c in ("anchor", "ctx", "lo", "places")}
    anchor, ctx, lo, places = (x.flatten().to_pylist() for x in lists.values())
    sizes = np.asarray(lists["ctx"].value_lengths(), np.int64)
    return anchor, ctx, np.repeat(np.asarray(shard.column("block__"), np.int64), sizes).tolist(), lo, places


def unpack(places: bytes) -> list[list[int]]:
    """(row key, id, first window) of every occurrence of a passage."""
    return np.frombuffer(places, np.int64).reshape(-1, 3).tolist()


def hash_bytes(value: bytes) -> int:
    """A hash that is the same in every process."""
    return zlib.crc32(value)


def span_table(rows: list[tuple[int, int, int, int]]) -> pa.Table:
    """(block, row key, first, last) packed into one row per block, so that rows follow blocks and not spans."""
    spans = np.asarray(rows, np.int64).reshape(-1, 4)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    blocks, starts = np.unique(spans[:, 0], return_index=True)
    packed = [part.tobytes() for part in np.split(np.ascontiguousarray(spans[:, 1:]), starts[1:])] if len(blocks) else []
    return pa.table({"block__": pa.array(blocks), "spans": pa.array(packed, pa.binary())})


def spans_by_row(spans: pa.Table) -> dict[int, list[tuple[int, int]]]:
    """The spans of every row key, each once: rows that share id and text share a key, and each of them reports its spans."""
    by_row: dict[int, set[tuple[int, int]]] = {}
    for packed in spans.column("spans").to_pylist():
        for key, a, b in unpack(packed):
            by_row.setdefault(key, set()).add((a, b))
    return {key: sorted(found) for key, found in by_row.items()}
