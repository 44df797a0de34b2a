"""The two substring operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from volarium.llm import automaton, levels, repeats
from volarium.llm.automaton import SuffixAutomaton, drop_earlier_passages
from volarium.llm.backoff import backoff_scores
from volarium.llm.levels import drop_repeated_bytes, window_ranks

SCHEMA = "doc_id long, text string"


def passages(seed, rows=60, words=("a", "bb", "the", "ö", "x,", "lorem", "ipsum", "dolor")):
    rng = random.Random(seed)
    shared = [" ".join(rng.choices(words, k=40)) for _ in range(3)] + [" ".join(str(rng.random()) for _ in range(30))]
    out = []
    for i in range(rows):
        parts = [" ".join(str(rng.randrange(10_000)) for _ in range(rng.randrange(30))), rng.choice(shared), " ".join(rng.choices(words, k=rng.randrange(30)))]
        rng.shuffle(parts)
        out.append((i, rng.choice((" ", "\n", "\t  ")).join(parts)))
    return out + [(900, None), (901, ""), (902, "one"), (5, out[5][1]), (None, out[3][1]), (903, "z " * 700), (904, "z " * 700 + "y")]


def brute_words(rows, length):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        if d is not None:
            for i in range(len(w) - length + 1):
                k = tuple(w[i:i + length])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i:i + length])] < d:
                gone[i:i + length] = [True] * length
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


def brute_bytes(rows, length):
    seen = Counter(t[i:i + length] for _, x in rows for t in [(x or "").encode()] for i in range(len(t) - length + 1))
    out = []
    for d, x in rows:
        t = (x or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [4000, 3])
def test_word_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_OCCURRENCES", hot)
    rows = passages(1)
    got = drop_earlier_passages(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, got)) == brute_words(rows, 13)


@pytest.mark.parametrize("hot", [4000, 3])
def test_byte_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_OCCURRENCES", hot)
    monkeypatch.setattr(levels, "RANKED_BYTES", 2000)
    rows = passages(2)
    got = drop_repeated_bytes(spark.createDataFrame(rows, SCHEMA), length=100, gram=32).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 100)


def brute_both(rows, length, words):
    """Bytes covered by a repeated window of `length` bytes or of `words` words, which go with the space behind them."""
    texts = [(x or "").encode() for _, x in rows]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)] for t in texts]
    word_keys = [[tuple(t[a:b] for a, b in s[i:i + words]) for i in range(len(s) - words + 1)] for t, s in zip(texts, spans)]
    seen, seen_words = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1)), Counter(k for keys in word_keys for k in keys)
    out = []
    for (d, _), t, s, keys in zip(rows, texts, spans, word_keys):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        for i, key in enumerate(keys):
            if seen_words[key] > 1:
                a, b = s[i][0] if i else 0, s[i + words][0] if i + words < len(s) else len(t)
                gone[a:b] = b"\1" * (b - a)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [4000, 3])
def test_word_passages_beside_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_OCCURRENCES", hot)
    monkeypatch.setattr(levels, "RANKED_BYTES", 2000)
    rows = passages(4) + [(905, "  " + "\n".join(f"k{k}" for k in range(15)) + " \t"), (906, " ".join(f"k{k}" for k in range(15)) + " more"), (907, "é " + "  ".join(f"k{k}" for k in range(15)))]
    got = drop_repeated_bytes(spark.createDataFrame(rows, SCHEMA), length=100, gram=32, words=13).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = brute_both(rows, 100, 13)
    assert Counter(map(tuple, got)) == want != brute_bytes(rows, 100)


def test_whole_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = drop_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 400)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drop_earlier_passages(empty).count() == 0 and drop_repeated_bytes(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", 7), (2, "c", "y", 8)], "doc_id long, text string, kept string, hash long")
    out = drop_earlier_passages(clash)
    assert out.columns == ["doc_id", "text", "hash", "n_words", "n_removed", "kept"] and {tuple(r) for r in out.collect()} == {(1, "a b", 7, 2, 0, "a b"), (2, "c", 8, 1, 0, "c")}
    assert drop_repeated_bytes(clash).columns == ["doc_id", "text", "hash", "n_bytes", "n_removed", "n_spans", "kept"]


def test_ids_of_other_types(spark, sf):
    """Text ids in the order of the numbers give the same rows as the numbers."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    odd = spark.createDataFrame([(None, "a b c d e f g h i j k l m n o"), (None, None)], SCHEMA)
    docs = docs.unionByName(odd)
    named = docs.withColumn("doc_id", F.concat(F.lit("id-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")))
    for operator in (drop_earlier_passages, drop_repeated_bytes, backoff_scores):
        plain = sorted((("id-%06d" % r[0] if r[0] is not None else None, *r[1:]) for r in operator(docs).collect()), key=repr)
        assert sorted(map(tuple, operator(named).collect()), key=repr) == plain


def test_blocks_follow_bytes_and_copies_share_their_spans(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(repeats, "LONG_TEXT", 3000)
    rows = [(k, f"{k} " * 40) for k in range(100)] + [(5, "x" * 5000), (6, "y" * 5000)]
    blocked, blocks = repeats.block_rows(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    assert blocks == -(-sum(len(t) for _, t in rows) // 2000) and blocked.where("length(text) = 5000").select("block__").distinct().count() == 2
    passage = " ".join(f"word{k}" for k in range(80))
    copies = [(1, passage)] * 300 + [(2, "before " + passage)]
    got = drop_repeated_bytes(spark.createDataFrame(copies, SCHEMA)).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, got)) == [(1, len(passage), 1, 300), (2, len(passage), 1, 1)]
    got = drop_earlier_passages(spark.createDataFrame(copies, SCHEMA)).groupBy("doc_id", "n_removed", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1, 0, passage, 300), (2, 80, "before", 1)]


def test_automaton_against_search():
    rng = random.Random(3)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(25)]
    sam = SuffixAutomaton()
    for k, t in enumerate(texts):
        sam.add(t, 100 - k)
    sam.close()
    for t in texts:
        want = [min((100 - k for k, u in enumerate(texts) if any(u[j:j + 5] == t[i:i + 5] for j in range(len(u) - 4))), default=float("inf")) for i in range(len(t) - 4)]
        assert sam.first_holders(t, 5) == want


def test_ranks_order_suffixes():
    import numpy as np

    data = np.frombuffer(b"banana bandana banana band", np.uint8)
    for length in (2, 5, 7):
        rank = window_ranks(data, length)
        texts = [data.tobytes()[i:i + length] for i in range(len(data) - length + 1)]
        order = sorted(set(texts))
        assert [order.index(t) for t in texts] == rank[:len(texts)].tolist()


@pytest.mark.parametrize("operator,brute,length", [(drop_repeated_bytes, brute_bytes, {"length": 100, "gram": 32}), (drop_earlier_passages, brute_words, {"length": 13})])
def test_windows_of_common_anchors_leave_a_block_by_shard(spark, monkeypatch, operator, brute, length):
    """A passage in every text, in other surroundings each time: the rows follow blocks and shards, not the windows around it."""
    monkeypatch.setattr(repeats, "HOT_OCCURRENCES", 3)
    rng = random.Random(5)
    common = " ".join(f"common{k}" for k in range(9))
    rows = [(k, " ".join([*(str(rng.random()) for _ in range(8)), common, *(str(rng.random()) for _ in range(8))])) for k in range(150)]
    rows += [(200, rows[7][1]), (201, rows[9][1] + " end")]
    seen = []

    def passages_(*args):
        seen.append(repeats.passages(*args))
        return seen[-1]
    for module in (levels, automaton):
        monkeypatch.setattr(module, "passages", passages_)
    out = operator(spark.createDataFrame(rows, SCHEMA), **length)
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)) if operator is drop_repeated_bytes else out.select("doc_id", "n_words", "n_removed", "kept")
    assert Counter(map(tuple, got.collect())) == brute(rows, length["length"])
    made = seen[0].select(F.size("ctx").alias("n") if isinstance(seen[0].schema["ctx"].dataType, ArrayType) else F.lit(1).alias("n")).agg(F.count("n"), F.sum("n")).first()
    assert made[0] <= len(rows) < made[1]


@pytest.mark.parametrize("operator,brute,length,cycle", [(drop_repeated_bytes, brute_bytes, {"length": 100, "gram": 32}, "he. Is on"), (drop_earlier_passages, brute_words, {"length": 13}, "he is ")])
def test_shards_follow_the_windows_of_a_common_anchor(spark, monkeypatch, operator, brute, length, cycle):
    """In texts that repeat themselves an anchor's occurrences have few windows each, and no more shards than these fill are dealt to."""
    monkeypatch.setattr(repeats, "HOT_OCCURRENCES", 3)
    monkeypatch.setattr(repeats, "SHARD_PASSAGES", 50)
    rows = [(k, f"{k} " + cycle * 60 + f" {k}") for k in range(60)]
    seen = []

    def passages_(*args):
        seen.append(repeats.passages(*args))
        return seen[-1]
    for module in (levels, automaton):
        monkeypatch.setattr(module, "passages", passages_)
    out = operator(spark.createDataFrame(rows, SCHEMA), **length)
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)) if operator is drop_repeated_bytes else out.select("doc_id", "n_words", "n_removed", "kept")
    assert Counter(map(tuple, got.collect())) == brute(rows, length["length"])
    whole = sum(len(t if operator is drop_repeated_bytes else t.split()) - length["length"] + 1 for _, t in rows)
    assert seen[0].agg(F.max("shard")).first()[0] < -(-whole // 50)
