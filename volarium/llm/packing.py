"""Best-fit packing by length patterns and non-negative least squares.

A document is its token ids and an end id, cut into pieces of at most `capacity` only if it is longer. What is packed is the
histogram of piece lengths, which has at most `capacity` entries however large the corpus is: patterns of one to four lengths
that nearly fill a sequence are enumerated, non-negative repeat counts are fitted to the histogram by projected
gradient steps, rounded down, and the residual pieces are packed best-fit, largest first, again as repeated patterns. Pieces
are numbered within their length by bounded windows and counted offsets, and a piece's number tells its sequence and place.

Defined cases: a null text is empty, and an empty text is the end id alone; repeated rows are packed as often as they
occur; an empty table gives an empty table; other columns pass through unless they are named like a result column,
which replaces them.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volarium.llm.arrowtext import release
from volarium.session import stage

RESULT = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")
CAPACITY = 4096
END_ID = 1
NUMBERED_ROWS = 50_000     # pieces of one length numbered in one task, on average
CACHED_WORDS = 150_000     # words that a worker keeps, also for its later tasks
RUN_BYTES = 2 << 20        # text encoded at a time
MARKS = frozenset(".,;:!?")
_word_ids: dict[str, WordIds] = {}  # kept by a worker


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _stem(word: str) -> tuple[str, str]:
    """A word without one sentence mark after a letter, which is always a token of its own, and the mark."""
    if word[-1:] in MARKS and len(word) > 1 and word[-2] < "\u0100" and word[-2].isalpha():
        return word[:-1], word[-1]
    return word, ""


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices (start, size) of `flat`, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordIds:
    """Ids of words: the tokenizer drops white space, never joins across it and ignores case, so a word has the same ids in
    every text and is encoded once while it is known."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(256)) if c.isalpha()}
        self.stems: dict[str, bytes] = {}
        self.words = pa.array([], pa.string())
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, stems: set[str]) -> None:
        """Stems of letters below U+0100 are one unit to the tokenizer and go to its model at once; others run through all its steps."""
        rest = []
        for s in stems:
            if s.isalpha() and max(s) < "\u0100":
                ids = [t.id for t in self.model.tokenize(s.lower().translate(self.bytes_of))]
                self.stems[s] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(s)
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for s, e in zip(rest, encode(rest, add_special_tokens=False) if rest else (), strict=True):
            self.stems[s] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: ids, and the start and size of each word's part of them."""
        at = pc.index_in(words, value_set=self.words)
        fresh = words.filter(pc.is_null(at))
        parts = [_stem(w) for w in fresh.to_pylist()]
        if len(self.stems) > CACHED_WORDS:
            self.stems.clear()
        stems = self.stems
        self._encode({x for p in parts for x in p if x not in stems})
        made = [stems[stem] + stems[mark] for stem, mark in parts]
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        place = at.to_numpy(zero_copy_only=False)
        new = np.isnan(place) if at.null_count else np.zeros(len(words), bool)
        place = np.where(new, len(self.words) + np.cumsum(new) - 1, place).astype(np.int64)
        self.words = pa.concat_arrays([self.words, fresh])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), "<u4")])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        found = self.flat, self.starts[place], self.sizes[place]
        if len(self.words) > CACHED_WORDS:  # only the words of the last texts stay known
            self.words, self.flat, self.sizes = words, _gather(*found), found[2]
            self.starts = np.cumsum(self.sizes) - self.sizes
        return found


def kept_word_ids(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def text_ids(texts: pa.Array, word_ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, each with the end id, and the place where each text starts (and the last ends)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))  # control tokens begin with <, and have a case
    for blank in "\n\t":
        texts = pc.replace_substring(texts, blank, " ")
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten().dictionary_encode()
    flat, starts, sizes = word_ids(words.dictionary)
    flat, starts, sizes = np.append(flat, np.uint32(END_ID)), np.append(starts, len(flat)), np.append(sizes, 1)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    order = np.insert(words.indices.to_numpy(), ends, len(words.dictionary))
    many = sizes[order]
    upto = np.cumsum(many)
    return _gather(flat, starts[order], many), np.concatenate(([0], upto[ends + np.arange(len(ends))]))


def _runs(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs (first row, number of rows) of about `limit` bytes; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi - lo
        lo = hi


def pieces(docs: DataFrame, tokenizer: str, capacity: int, text_col: str) -> DataFrame:
    """A row per piece, without the text."""
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = kept_word_ids(tokenizer)
        release()  # what the worker's earlier tasks left
        for batch in batches:
            keep = [i for i in range(batch.num_columns) if i != at]
            for lo, n in _runs(batch.column(at), RUN_BYTES):
                part = batch.slice(lo, n)
                ids, places = text_ids(part.column(at), word_ids)
                row, piece, start, length, crc = [], [], [], [], []
                for r, (first, end) in enumerate(pairwise(places.tolist())):
                    for k, a in enumerate(range(first, end, capacity)):
                        cut = ids[a:min(a + capacity, end)]
                        row.append(r), piece.append(k), start.append(a - first), length.append(len(cut)), crc.append(zlib.crc32(cut))
                rows = pa.RecordBatch.from_arrays([part.column(i) for i in keep], names=[batch.schema.names[i] for i in keep]).take(pa.array(row, pa.int64())) if keep else None
                yield pa.RecordBatch.from_arrays([*(rows.columns if rows is not None else ()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                                                 names=[*(batch.schema.names[i] for i in keep), *RESULT[:4]])
    n = F.lit(0).cast("long")
    return docs.mapInArrow(scan, docs.drop(text_col).withColumns({"piece": F.lit(0), "start": n, "length": n, "ids_crc32": n}).schema)


def enumerate_patterns(lengths: np.ndarray, capacity: int, spread: int = 6, most: int = 40_000) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths: after the first lengths the last one is the largest that still fits."""
    fit = np.zeros(capacity + 1, np.int64)
    fit[lengths] = lengths
    fit = np.maximum.accumulate(fit)
    found: dict[tuple[int, ...], None] = {}

    def close(head: tuple[int, ...], rest: int) -> None:
        last = int(fit[rest]) if rest > 0 else 0
        pattern = tuple(sorted((*head, last) if last else head, reverse=True))
        if sum(pattern) >= 0.97 * capacity or not last:
            found[pattern] = None

    for a in lengths[::-1].tolist():
        close((a,), capacity - a)
        for b in np.unique(fit[np.linspace(1, max(1, capacity - a - 1), spread).astype(int)]).tolist() if capacity - a > 1 else ():
            if not b:
                continue
            close((a, b), capacity - a - b)
            for c in np.unique(fit[np.linspace(1, max(1, capacity - a - b - 1), 3).astype(int)]).tolist() if capacity - a - b > 1 else ():
                if c:
                    close((a, b, c), capacity - a - b - c)
        if len(found) > most:
            break
    return list(found)


def fit_repeats(patterns: list[tuple[int, ...]], histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative repeats x with pattern counts close to the histogram in least squares (accelerated projected gradient)."""
    slots = max(map(len, patterns))
    index = np.zeros((len(patterns), slots), np.int64)  # slot 0 of the histogram is a dummy
    for k, p in enumerate(patterns):
        index[k, :len(p)] = p
    uses = np.bincount(index.ravel(), minlength=len(histogram))
    uses[0] = 0
    rate = 1.0 / (slots * max(1, int(uses.max())))
    x = np.zeros(len(patterns))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        made = np.bincount(index.ravel(), weights=np.repeat(y, slots), minlength=len(histogram))
        gap = histogram - made
        gap[0] = 0
        new = np.maximum(0, y + rate * gap[index].sum(axis=1))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def plan_sequences(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram of lengths exactly."""
    left = histogram.copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], repeats: int) -> None:
        if repeats > 0:
            plan.append((pattern, repeats))
            for p in pattern:
                left[p] -= repeats

    take((capacity,), int(left[capacity]))
    lengths = np.flatnonzero(left)
    patterns = [p for p in enumerate_patterns(lengths, capacity) if sum(p) >= 0.995 * capacity] if len(lengths) else []
    if patterns:
        repeats = np.floor(fit_repeats(patterns, left.astype(float)))
        for k in sorted(np.flatnonzero(repeats).tolist(), key=lambda k: (sum(patterns[k]), patterns[k]), reverse=True):
            often = {p: patterns[k].count(p) for p in patterns[k]}
            take(patterns[k], min(int(repeats[k]), *(int(left[p]) // n for p, n in often.items())))
    while left.any():  # each step uses up a length, so there are at most `capacity` of them
        pattern, room = [], capacity
        while room:
            fits = np.flatnonzero(left[:room + 1] > np.bincount(pattern, minlength=capacity + 1)[:room + 1])
            if not len(fits):
                break
            pattern.append(int(fits[-1]))
            room -= pattern[-1]
        take(tuple(pattern), min(int(left[p]) // pattern.count(p) for p in pattern))
    return plan


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Slots sorted by (length, first number): key, first sequence and offset of each run of numbers."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, repeats in plan:
        offset = 0
        for p in pattern:
            first = used.get(p, 0)
            rows.append((p, first, sequence, offset))
            used[p] = first + repeats
            offset += p
        sequence += repeats
    rows.sort()
    return tuple(np.asarray([r[k] for r in rows], np.int64) for k in range(4))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: the document's columns without its text, piece, start, length, ids_crc32, sequence_id and offset."""
    docs = docs.drop(*RESULT)
    cut = stage(pieces(docs, tokenizer or default_tokenizer(), capacity, text_col), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.table.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    length_, first, sequence, place = slots_of(plan_sequences(counts, capacity))
    buckets = max(1, -(-cut.rows // NUMBERED_ROWS))
    dealt = cut.table.withColumn("bucket__", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket__").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("length").alias("length__"), F.col("bucket__").alias("b__"), before.alias("before__"))
    number = F.row_number().over(Window.partitionBy("length", "bucket__").orderBy(id_col, "piece", "ids_crc32")) - 1
    numbered = dealt.withColumn("n__", number).join(starts, (F.col("length") == F.col("length__")) & (F.col("bucket__") == F.col("b__")))
    numbered = numbered.withColumn("n__", F.col("n__") + F.col("before__")).drop("bucket__", "length__", "b__", "before__")
    names = [c for c in numbered.columns if c != "n__"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, n = (np.asarray(batch.column(c), np.int64) for c in ("length", "n__"))
            slot = np.zeros(len(n), np.int64)
            for size in np.unique(length).tolist():
                lo, hi = np.searchsorted(length_, [size, size + 1])
                mine = length == size
                slot[mine] = lo + np.searchsorted(first[lo:hi], n[mine], "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[slot] + n - first[slot]), pa.array(place[slot])], names=[*names, "sequence_id", "offset"])

    zero = F.lit(0).cast("long")
    return numbered.mapInArrow(assign, cut.table.select(*names).withColumns({"sequence_id": zero, "offset": zero}).schema) if cut.rows else \
        cut.table.withColumns({"sequence_id": zero, "offset": zero})
