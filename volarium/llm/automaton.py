"""Substring dedup by suffix automata of reference shards.

Words are the maximal runs of bytes other than space and 0x09-0x0D; a window is `length` consecutive words of one
document. A word goes if a window over it also starts in a document with a smaller id; windows are judged on the input.

The reference of a corpus is the corpus itself, which has no size bound, so whole automata are not broadcast to all
documents. Passages around anchors that occur in more than one document are dealt to shards by anchor; a shard of
bounded size becomes one suffix automaton whose states carry the smallest id that holds their strings, and the
documents' passages that share an anchor with it are streamed through it. The matching statistics are capped at the
window length: the state that holds the last `length` words names the first document with that window.

Defined cases: a null text has no words; fewer than `length` words lose nothing; a row with a null id is neither
reference nor cut; rows with equal ids never cut each other, so of tied documents none is the first; ids of other types than whole numbers are
ordered as Spark orders them; a text of any length is one row of its block and is scanned a piece at a time; an empty table gives an empty table;
other columns pass through unless they are named like a result column, which replaces them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volarium.llm.arrowtext import item_gram_hashes, runs_of, span_hashes, word_spans
from volarium.llm.repeats import SPANS, Windows, anchors, block_rows, matched, passages, span_table, spans_by_row, unpack, unpack_shard, whole_ids, with_order

RESULT = ("n_words", "n_removed", "kept")


class SuffixAutomaton:
    """Suffix automaton of several word sequences; every state knows the smallest label of a sequence it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.low = [-1], [0], [float("inf")]

    def _state(self, size: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        self.low.append(float("inf"))
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = self._state(size[p] + 1, link[q], dict(nxt[q]))
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def add(self, words: list[int], label: int) -> None:
        nxt, link, size, low = self.next, self.link, self.size, self.low
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                cur = q if size[q] == size[last] + 1 else self._split(last, w, q)
            else:
                cur = len(size)
                nxt.append({})
                link.append(0)
                size.append(size[last] + 1)
                low.append(label)
                p = last
                while p >= 0:
                    moves = nxt[p]
                    q = moves.get(w)
                    if q is not None:
                        link[cur] = q if size[q] == size[p] + 1 else self._split(p, w, q)
                        break
                    moves[w] = cur
                    p = link[p]
            if label < low[cur]:
                low[cur] = label
            last = cur

    def close(self) -> None:
        """Pass the smallest labels down the suffix links, longest states first."""
        link, low = self.link, self.low
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if low[v] < low[link[v]]:
                low[link[v]] = low[v]

    def first_holders(self, words: list[int], length: int) -> list[float]:
        """Matching statistics capped at `length`: for each window of that length the smallest label that holds it."""
        nxt, link, size, low = self.next, self.link, self.size, self.low
        v, have, out = 0, 0, []
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                have = size[v]
            if w in nxt[v]:
                v = nxt[v][w]
                have += 1
            while size[link[v]] >= length if v else False:
                v = link[v]
                have = size[v]
            if i >= length - 1:
                out.append(low[v] if have >= length else float("inf"))
        return out


def word_windows(length: int, gram: int = 6) -> Windows:
    def items(data, offsets):
        starts, ends, bounds = word_spans(data, offsets)
        return item_gram_hashes(span_hashes(data, starts, ends), gram), bounds
    return Windows(length, gram, items, bytes.split, lambda words, a, b: b" ".join(words[a:b + length]),
                   lambda words, a: b" ".join(words[a:a + length]))


def decide(shard: pa.Table, length: int) -> pa.Table:
    """Windows of the shard's passages that an earlier document holds, as runs per row."""
    _, ctx, blocks, low_ids, all_places = unpack_shard(shard)
    lowest: dict[bytes, int] = {}
    for c, lo in zip(ctx, low_ids, strict=True):
        if lo < lowest.get(c, lo + 1):
            lowest[c] = lo
    numbers: dict[bytes, int] = {}
    coded = {c: [numbers.setdefault(w, len(numbers)) for w in c.split()] for c in lowest}
    automaton = SuffixAutomaton()
    for c, words in coded.items():
        automaton.add(words, lowest[c])
    automaton.close()
    holders = {c: automaton.first_holders(words, length) for c, words in coded.items()}
    out: list[tuple[int, int, int, int]] = []
    for c, block, places in zip(ctx, blocks, all_places, strict=True):
        first = holders[c]
        low, high = min(first), max(first)
        for key, doc, start in unpack(places):
            if low >= doc:
                continue
            runs = [(0, len(first) - 1)] if high < doc else zip(*(x.tolist() for x in runs_of(np.asarray(first) < doc)), strict=True)
            out.extend((block, key, start + a, start + b) for a, b in runs)
    return span_table(out)


def drop_earlier_passages(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with n_words, n_removed and kept, the remaining words joined by one space."""
    docs = docs.drop(*RESULT)
    windows = word_windows(length)
    names, order = docs.columns, id_col
    if not whole_ids(docs, id_col):
        order = "order__"
        docs = with_order(docs, id_col, order)
    blocked, _ = block_rows(docs, id_col, text_col)
    by_hash = Window.partitionBy("hash")
    found = (anchors(blocked.where(F.col(order).isNotNull()), windows, text_col, order)
             .withColumns({"first": F.min("lo").over(by_hash), "end": F.max("hi").over(by_hash)}).where("first < end"))
    wanted = matched(found, "word-anchors")
    spans = passages(blocked, wanted, windows, text_col, order).groupBy("shard").applyInArrow(lambda t: decide(t, length), SPANS)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        by_row = spans_by_row(right)
        n_words, n_removed, kept = [], [], []
        for key, text in zip(left.column("row_key__").to_pylist(), left.column(text_col).cast(pa.binary()).to_pylist(), strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            if key in by_row:
                gone = np.zeros(len(words), bool)
                for a, b in by_row[key]:
                    gone[a:b + length] = True
                n_removed.append(int(gone.sum()))
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words).decode())
        out = left.select(names)
        for name, values, kind in zip(RESULT, (n_words, n_removed, kept), (pa.int64(), pa.int64(), pa.string()), strict=True):
            out = out.append_column(name, pa.array(values, kind))
        return out

    schema = blocked.select(*names).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit("")}).schema
    return blocked.groupBy("block__").cogroup(spans.groupBy("block__")).applyInArrow(cut, schema)
