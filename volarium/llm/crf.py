"""Language identification by a linear-chain conditional random field over words.

Every word of a text is a position of a chain (texts are cut into chains of `CHAIN` consecutive words, so all words are
labelled and memory stays bounded). Emission scores add learned weights of the word itself if it is in the lexicon, of its
prefixes and suffixes of up to three bytes and of its byte trigrams; transition weights are learned with them.
Training chains are spliced from documents of different languages, so the field learns where a text switches.
Forward-backward gives each word a distribution over the languages; a document gets the language with the largest mean
probability over its words with letters, and that mean as score.

The field is fitted on the driver, on a bounded sample: about `per_language` distinct labelled texts of every language, drawn by a hash of
text; distinct texts are counted over all documents. The weights (a few MB, independent of the corpus) travel with the task.

Defined cases: null text, or a text without letters, is `und` with score 0; without any labelled text everything is
`und`; repeated rows are labelled alike; an empty table gives an empty table; other columns pass through unless they are
named like a result column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volarium.llm.arrowtext import chunks, release, span_hashes, text_buffer, word_spans

RESULT = ("lang_pred", "score", "sureness")
CHAIN = 64
CHUNK = 1 << 19
AFFIX_BITS = 14
TRIGRAM_BITS = 15
AFFIXES = 6                       # prefixes and suffixes of 1, 2, 3 bytes
LEXICON_AT = AFFIXES << AFFIX_BITS
MIN_LEXICON_COUNT = 3
PER_LANGUAGE = 150
MOST_LANGUAGES = 1000             # beyond that labels are taken for an error
UNKNOWN = "und"


@dataclass
class Field:
    labels: list[str]
    lexicon: np.ndarray           # sorted word hashes
    words: np.ndarray             # weights of affixes, then of the lexicon; the last row stands for words outside it
    trigrams: np.ndarray          # the last row is zero
    moves: np.ndarray             # transition scores


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower()
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word the weight rows of its affixes and itself; per byte its trigram row; word starts, row bounds and whether a word has a letter."""
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    n = len(data)
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    ids = np.empty((len(starts), AFFIXES + 1), np.int64)
    for side in range(2):
        code = np.zeros(len(starts), np.int64)
        for k in range(3):
            at = starts + k if side == 0 else ends - 1 - k
            inside = (at < ends) & (at >= starts)
            code = code * 257 + np.where(inside, padded[np.maximum(at, 0)] + 1, 0)
            ids[:, side * 3 + k] = ((code * 0x9E3779B1 >> 7) & ((1 << AFFIX_BITS) - 1)) + ((side * 3 + k) << AFFIX_BITS)
    hashes = span_hashes(data, starts, ends)
    place = np.minimum(np.searchsorted(lexicon, hashes), max(len(lexicon) - 1, 0))
    known = lexicon[place] == hashes if len(lexicon) else np.zeros(len(hashes), bool)
    ids[:, AFFIXES] = LEXICON_AT + np.where(known, place, len(lexicon))
    before = np.concatenate(([32], padded[:n - 1])) if n else padded[:0]
    tri = ((before * 66049 + padded[:n] * 257 + padded[1:n + 1]) * 0x9E3779B1 >> 9) & ((1 << TRIGRAM_BITS) - 1)
    count = np.zeros(n + 1, np.int64)
    np.cumsum(LETTER[data], out=count[1:])
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    tri[np.cumsum(inside[:n]) == 0] = 1 << TRIGRAM_BITS
    return ids, tri, starts, bounds, count[ends] > count[starts]


def emissions(field: Field, ids: np.ndarray, tri: np.ndarray, starts: np.ndarray) -> np.ndarray:
    scores = np.zeros((len(starts), len(field.labels)), np.float32)
    for k in range(ids.shape[1]):
        scores += field.words[ids[:, k]]
    if len(starts):
        scores += np.add.reduceat(field.trigrams[tri], starts, axis=0)
    return scores


def chains(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of every chain."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // CHAIN)
    row = np.repeat(np.arange(len(sizes)), pieces)
    k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return bounds[:-1][row] + k * CHAIN, np.minimum(CHAIN, sizes[row] - k * CHAIN)


def forward_backward(scores: np.ndarray, first: np.ndarray, size: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of every word, and with `pairs` the expected transitions, all chains side by side."""
    labels = scores.shape[1]
    out = np.zeros_like(scores)
    expected = np.zeros((labels, labels)) if pairs else None
    if not len(first):
        return out, expected
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0])
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # chains with more than t words
    step = np.exp(moves - moves.max()).astype(np.float32)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    ahead = []
    now = None
    for t in range(longest):
        n = int(alive[t])
        e = emit[first[:n] + t]
        now = e if t == 0 else (now[:n] @ step) * e
        now = now / now.sum(axis=1, keepdims=True)
        ahead.append(now)
    back = np.ones((int(alive[-1]), labels), np.float32)
    for t in range(longest - 1, -1, -1):
        n = int(alive[t])
        if len(back) < n:
            back = np.concatenate((back, np.ones((n - len(back), labels), np.float32)))
        both = ahead[t] * back
        out[first[:n] + t] = both / both.sum(axis=1, keepdims=True)
        pull = emit[first[:n] + t] * back
        if pairs and t:
            joint = ahead[t - 1][:n, :, None] * step[None] * pull[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = pull @ step.T
        back = back / back.sum(axis=1, keepdims=True)
    return out, expected


def spliced(texts: list[bytes], gold: list[int], rng: np.random.Generator) -> tuple[list[bytes], list[np.ndarray]]:
    """Training texts: each document as it is, half of them continued by the end of another, with a label for each word."""
    words = [t.split() for t in texts]
    other = rng.permutation(len(texts))
    out, labels = [], []
    for k, (w, g) in enumerate(zip(words, gold, strict=True)):
        o = int(other[k])
        if k % 2 and words[o]:
            cut = len(w) // 2
            tail = words[o][len(words[o]) // 2:]
            out.append(b" ".join(w[:cut] + tail))
            labels.append(np.concatenate((np.full(cut, g), np.full(len(tail), gold[o]))))
        else:
            out.append(b" ".join(w))
            labels.append(np.full(len(w), g))
    return out, labels


def fit(texts: list[bytes], langs: list[str], epochs: int = 6, batch_bytes: int = 1 << 18, rate: float = 0.2, seed: int = 5) -> Field:
    """Gradient steps with per-weight rates (Adagrad) on the conditional log-likelihood."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    texts, gold = spliced(texts, [labels.index(g) for g in langs], rng)
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends, _ = word_spans(LOWER[data], np.asarray([0, len(data)]))
    hashes, times = np.unique(span_hashes(LOWER[data], starts, ends), return_counts=True)
    lexicon = hashes[times >= MIN_LEXICON_COUNT]
    n = len(labels)
    field = Field(labels, lexicon, np.zeros((LEXICON_AT + len(lexicon) + 1, n), np.float32), np.zeros(((1 << TRIGRAM_BITS) + 1, n), np.float32), np.zeros((n, n)))
    speed = [np.full(w.shape, 1e-2) for w in (field.words, field.trigrams, field.moves)]
    sizes = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for _ in range(epochs):
        for lo, hi in chunks(sizes, batch_bytes):
            part = b"".join(texts[lo:hi])
            at = sizes[lo:hi + 1] - sizes[lo]
            ids, tri, begin, bounds, _ = features(np.frombuffer(part, np.uint8), at, lexicon)
            truth = np.concatenate(gold[lo:hi]).astype(np.int64) if hi > lo else np.zeros(0, np.int64)
            if not len(truth):
                continue
            first, size = chains(bounds)
            marginal, expected = forward_backward(emissions(field, ids, tri, begin), first, size, field.moves, pairs=True)
            push = -marginal.astype(float)
            push[np.arange(len(truth)), truth] += 1
            inner = np.ones(len(truth), bool)
            inner[first] = False
            here = np.flatnonzero(inner)
            seen = np.bincount(truth[here - 1] * n + truth[here], minlength=n * n).reshape(n, n)
            per_byte = np.repeat(push, np.diff(np.concatenate((begin, [len(part)]))), axis=0)
            gradients = (np.stack([np.bincount(ids.ravel(), weights=np.repeat(push[:, j], ids.shape[1]), minlength=len(field.words)) for j in range(n)], axis=1),
                         np.stack([np.bincount(tri[begin[0]:], weights=per_byte[:, j], minlength=len(field.trigrams)) for j in range(n)], axis=1), seen - expected)
            for k, (weights, g) in enumerate(zip((field.words, field.trigrams, field.moves), gradients, strict=True)):
                speed[k] += g * g
                weights += (rate * g / np.sqrt(speed[k])).astype(weights.dtype)
            field.trigrams[-1] = 0
    return field


def predict(field: Field, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean probability of each label over the words with letters, per row (zeros if there are none), and their number."""
    return judge_rows(field, data, offsets)[:2]


def judge_rows(field: Field, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean probability of each label over the words with letters, per row (zeros if there are none), their number, and the mean
    of each word's largest probability."""
    mean = np.zeros((len(offsets) - 1, len(field.labels)))
    counts, sure = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for lo, hi in chunks(offsets, CHUNK):
        at = offsets[lo:hi + 1]
        ids, tri, starts, bounds, lettered = features(data[at[0]:at[-1]], at - at[0], field.lexicon)
        if not len(starts):
            continue
        marginal, _ = forward_backward(emissions(field, ids, tri, starts), *chains(bounds), field.moves)
        row = np.repeat(np.arange(lo, hi), np.diff(bounds))[lettered]
        counts += np.bincount(row, minlength=len(counts))
        sure += np.bincount(row, weights=marginal[lettered].max(1), minlength=len(counts))
        for j in range(mean.shape[1]):
            mean[:, j] += np.bincount(row, weights=marginal[lettered, j], minlength=len(counts))
    return mean / np.maximum(counts, 1)[:, None], counts, sure / np.maximum(counts, 1)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field | None:
    """The field fitted on a sample of the distinct texts that are not held out, about `per_language` of each language, or all if there are fewer.

    The share of a language follows from its number of distinct texts, so copies neither crowd out other texts nor hide a language.
    """
    known = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.regexp_like("text", F.lit(r"\p{L}")))
    distinct = F.approx_count_distinct(F.xxhash64("text"), 0.02)
    counts = {r[0]: max(1, r[1]) for r in known.groupBy("lang").agg(distinct).limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))))
    place = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(place < F.try_element_at(share, F.col("lang"))).dropDuplicates(["text", "lang"])
    rows = drawn.orderBy(F.xxhash64("text"), "text", "lang").limit(4 * per_language * len(counts)).collect()
    return fit([r["text"].encode() for r in rows], [r["lang"] for r in rows]) if rows else None


def label_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every row with lang_pred, score (mean probability of that language over the words) and sureness (mean over the words of the
    probability of each word's own best language, which a text that switches surely between languages does not lose)."""
    docs = docs.drop(*RESULT)
    field = train(docs, per_language, id_col, text_col, lang_col)
    named = docs.withColumn("letters__", F.coalesce(F.regexp_like(F.col(text_col), F.lit(r"\p{L}")), F.lit(False)))
    if field is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "sureness": F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(field)
    names, at = docs.columns, docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field = model.value
            mean, counts, sure = judge_rows(field, *text_buffer(batch.column(at)))
            ok = np.asarray(batch.column(len(names))) & (counts > 0)
            best = mean.argmax(axis=1) if len(mean) else np.zeros(0, np.int64)
            pred = pa.array([field.labels[b] if o else UNKNOWN for b, o in zip(best.tolist(), ok.tolist(), strict=True)], pa.string())
            score = np.where(ok, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pred, pa.array(score), pa.array(np.where(ok, np.clip(sure, 0, 1), 0.0))], names=[*names, *RESULT])
        release()

    schema = docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "sureness": F.lit(0.0)}).schema
    return named.mapInArrow(scan, schema)
