"""Suffix-array dedup with a logarithmic index family.

A text is its UTF-8 bytes; a window is `length` consecutive bytes of one document. Every byte covered by a window that
also starts anywhere else, in the same document or another, is removed; windows are judged on the input. With `words`, so is every
passage of that many consecutive words that starts anywhere else, whatever white space stands between its words (words are the maximal runs of
bytes other than space and 0x09-0x0D); a word goes with the space behind it, the first one of a text also with the space before it.

`IndexFamily` holds sparse suffix arrays: the suffixes that start at the anchors of the texts, sorted by the hash of
their first bytes and written as tables. A new batch gets its array, is merge-scanned against every existing
level for suffixes that agree, and becomes a level of size one; two levels of equal size merge into one of
double size, so an entry is rewritten at most log2(batches) times. The passages around agreeing suffixes are dealt to
shards, where the ranks of suffixes up to `length` bytes (or `words` words) tell which windows occur again.

Defined cases: a null text is empty; texts shorter than `length` bytes lose nothing; a text of any length is one row of its block and is
scanned a piece at a time; equal windows in one text or in equal rows are occurrences of their own, also with equal or null ids, and all of them go;
ids may be of any type; an empty table gives an empty table; other columns pass
through unless they are named like a result column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volarium.llm.arrowtext import byte_gram_hashes, release, runs_of, word_spans
from volarium.llm.automaton import word_windows
from volarium.llm.repeats import HOT, SPANS, Windows, anchors, block_rows, matched, passages, span_table, spans_by_row, unpack, unpack_shard, whole_ids
from volarium.session import Staged, stage

RESULT = ("n_bytes", "n_removed", "n_spans", "kept")
ROW_ID = "row_id__"
RANKED_BYTES = 1 << 20  # bytes of passages that are ranked together
Items = Callable[[list[bytes]], list[np.ndarray]]  # passages -> the bytes or numbered words of each


@dataclass
class Level:
    size: int
    table: DataFrame


@dataclass
class IndexFamily:
    """Levels of sorted suffix tables (hash, block, n, windows) and the hashes that were met more than once so far."""

    levels: list[Level] = field(default_factory=list)
    repeated: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def _sorted(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange("hash").sortWithinPartitions("hash")

    def add(self, suffixes: DataFrame) -> None:
        """Index a batch: sort it, scan it against all levels, then merge levels of equal size."""
        batch = stage(self._sorted(suffixes), "suffixes").table
        within = batch.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
        across = [batch.join(level.table.select("hash"), "hash", "left_semi").select("hash") for level in self.levels]
        for more in across:
            within = within.unionByName(more)
        self.repeated.append(stage(within.distinct(), "agreeing").table)
        self.levels.append(Level(1, batch))
        while len(self.levels) > 1 and self.levels[-1].size == self.levels[-2].size:
            right, left = self.levels.pop(), self.levels.pop()
            merged = self._sorted(left.table.unionByName(right.table))
            self.levels.append(Level(left.size + right.size, stage(merged, "level").table))

    def agreeing(self) -> Staged:
        """(block, hash, hot, windows) of all suffixes that agree with another one."""
        hashes, rows = self.repeated[0], self.levels[0].table
        for more in self.repeated[1:]:
            hashes = hashes.unionByName(more)
        for level in self.levels[1:]:
            rows = rows.unionByName(level.table)
        return matched(rows.join(hashes.distinct(), "hash", "left_semi"), "suffix-matches")


def byte_windows(length: int, gram: int) -> Windows:
    def items(data, offsets):
        grams = byte_gram_hashes(data, gram)
        return np.concatenate((grams, np.zeros(len(data) - len(grams), np.uint64))), offsets
    return Windows(length, gram, items, lambda text: text, lambda text, a, b: text[a:b + length], lambda text, a: xxhash.xxh3_128_digest(text[a:a + length]))


def digested_words(length: int, gram: int) -> Windows:
    return replace(word_windows(length, gram), single=lambda words, a: xxhash.xxh3_128_digest(b" ".join(words[a:a + length])))


def byte_items(passages_: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint8) for c in passages_]


def word_items(passages_: list[bytes]) -> list[np.ndarray]:
    numbers: dict[bytes, int] = {}
    return [np.asarray([numbers.setdefault(w, len(numbers)) for w in c.split()], np.int64) for c in passages_]


def word_range(text: bytes, runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The bytes of runs of word windows: a word goes with the space behind it, the first also with the space before it."""
    starts = word_spans(np.frombuffer(text, np.uint8), np.asarray([0, len(text)]))[0]
    bounds = [0, *starts[1:].tolist(), len(text)]
    return [(bounds[a], bounds[b + length]) for a, b in runs]


def window_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every position's first `length` items among the suffixes of `data`: the order of a suffix array cut at
    `length` items, by tripling the compared prefix. Only positions whose window ends inside `data` have a rank."""
    have, rank = 1, data.astype(np.int64)
    while have < length:
        top = int(rank.max(initial=0)) + 1
        times = 3 if top < 1 << 21 and have * 2 < length else 2
        reach = min(have * times, length)
        steps = [0, have, reach - have] if times == 3 else [0, reach - have]
        count = max(0, len(rank) - (reach - have))
        value = rank[:count]
        for step in steps[1:]:
            value = value * top + rank[step:step + count]
        rank = np.unique(value, return_inverse=True)[1]
        have = reach
    return rank


def repeated_runs(passages_: list[np.ndarray], times: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each of several distinct passages the runs of windows that occur more than once among them, `times` counted."""
    sizes = np.asarray([len(c) for c in passages_])
    ends = np.cumsum(sizes)
    counts = sizes - length + 1
    rank = window_ranks(np.concatenate(passages_), length)
    at = np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    found = np.bincount(rank[at], weights=np.repeat(times, counts), minlength=int(rank.max()) + 1)
    again = np.split(found[rank[at]] > 1, np.cumsum(counts)[:-1])
    return [list(zip(*(x.tolist() for x in runs_of(f)), strict=True)) for f in again]


def decide(shard: pa.Table, length: int, items: Items) -> pa.Table:
    """Windows of the shard's passages that occur more than once, as runs per row.

    Windows of one passage differ, and equal windows share their anchor, so only anchors with several distinct passages
    need suffix ranks; a passage that is its anchor's only one is repeated as a whole or not at all.
    """
    anchor, ctx, blocks, _, places = unpack_shard(shard)
    times: dict[tuple[int, bytes], int] = {}
    for a, c, p in zip(anchor, ctx, places, strict=True):
        times[a, c] = times.get((a, c), 0) + len(p) // 24
    by_anchor: dict[int, list[bytes]] = {}
    for a, c in times:
        if a != HOT:
            by_anchor.setdefault(a, []).append(c)
    runs: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    batch: list[tuple[int, bytes]] = []
    held = 0
    several = [a for a, c in by_anchor.items() if len(c) > 1]
    for k, a in enumerate(several):
        batch.extend((a, c) for c in by_anchor[a])
        held += sum(map(len, by_anchor[a]))
        if held >= RANKED_BYTES or k == len(several) - 1:
            runs.update(zip(batch, repeated_runs(items([c for _, c in batch]), [times[x] for x in batch], length), strict=True))
            batch, held = [], 0
    out: list[tuple[int, int, int, int]] = []
    for a, c, block, p in zip(anchor, ctx, blocks, places, strict=True):
        found = runs.get((a, c))
        if found is None:
            found = [(0, 0 if a == HOT else len(items([c])[0]) - length)] if times[a, c] > 1 else []
        for key, _, start in unpack(p) if found else ():
            out.extend((block, key, start + x, start + y) for x, y in found)
    del runs, batch, by_anchor, times
    release()
    return span_table(out)


def drop_repeated_bytes(docs: DataFrame, length: int = 400, gram: int = 128, batches: int = 4, id_col: str = "doc_id", text_col: str = "text",
                        whole_characters: bool = False, words: int | None = None) -> DataFrame:
    """Every row with n_bytes, n_removed, n_spans (maximal removed runs) and kept, the remaining bytes.

    Passages of `length` bytes that occur again go, and, if `words` is given, those of so many words. A run may begin or end inside a character. With `whole_characters` the rest of such a character goes too (and counts as removed), so
    that what is kept of a text is a text again.
    """
    docs = docs.drop(*RESULT)
    rules: list[tuple[Windows, Items, int]] = [(byte_windows(length, gram), byte_items, batches)]
    if words:  # indexed in one batch, so that these suffixes are written once and not once a merge
        rules.append((digested_words(words, max(1, words // 3)), word_items, 1))
    blocked, _ = block_rows(docs, id_col, text_col)
    row_id = F.col(id_col).cast("long") if whole_ids(docs, id_col) else F.xxhash64(F.col(id_col))
    keyed = blocked.withColumn(ROW_ID, F.coalesce(row_id, F.lit(-1)))

    def repeated(rule: int) -> DataFrame:
        windows, items, parts = rules[rule]
        family = IndexFamily()
        for k in range(parts):
            family.add(anchors(keyed.where(F.pmod("block__", F.lit(parts)) == k), windows, text_col, ROW_ID).select("hash", "block", "n", "windows"))
        found = passages(keyed, family.agreeing(), windows, text_col, ROW_ID)
        return found.groupBy("shard").applyInArrow(lambda t: decide(t, windows.length, items), SPANS).withColumn("rule", F.lit(rule))

    spans = repeated(0)
    for k in range(1, len(rules)):
        spans = spans.unionByName(repeated(k))
    names = docs.columns

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        by_bytes, by_words = (spans_by_row(right.filter(pc.equal(right.column("rule"), k))) for k in (0, 1))
        sizes, removed, spans_, kept = [], [], [], []
        for key, text in zip(left.column("row_key__").to_pylist(), left.column(text_col).cast(pa.binary()).to_pylist(), strict=True):
            text = text or b""
            sizes.append(len(text))
            if key not in by_bytes and key not in by_words:
                removed.append(0), spans_.append(0), kept.append(text)
                continue
            parts, at, runs, reach = [], 0, 0, -1
            ranges = [(a, b + length) for a, b in by_bytes.get(key, ())]
            if key in by_words:
                ranges += word_range(text, by_words[key], words)
            for a, end in sorted(ranges):
                if a > reach:
                    runs += 1
                    parts.append(text[at:a])
                reach = at = max(reach, end)
            parts.append(text[at:])
            if whole_characters:
                parts = [p.decode("utf-8", "ignore").encode() for p in parts]
            kept.append(b"".join(parts))
            removed.append(len(text) - len(kept[-1])), spans_.append(runs)
        out = left.select(names)
        for name, values, kind in zip(RESULT, (sizes, removed, spans_, kept), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True):
            out = out.append_column(name, pa.array(values, kind))
        return out

    n = F.lit(0).cast("long")
    schema = blocked.select(*names).withColumns({"n_bytes": n, "n_removed": n, "n_spans": n, "kept": F.lit(b"")}).schema
    return keyed.groupBy("block__").cogroup(spans.groupBy("block__")).applyInArrow(cut, schema)
