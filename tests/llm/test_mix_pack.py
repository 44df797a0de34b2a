"""Mixing, packing and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from volarium.llm.mixing import MOST_RANGES, bin_ranges, choose_bins, mix, route, source_order, targets
from volarium.llm.packing import CAPACITY, WordIds, default_tokenizer, pack, plan_sequences, text_ids


def test_targets():
    assert targets([100, 100, 100], [3, 1, 2], 450, 2) == pytest.approx([200, 83.3333333, 166.6666667])
    assert targets([10, 100], [1, 1], 100, 2) == pytest.approx([20, 80])
    assert targets([], [], 0, 2) == [] and targets([0, 5], [1, 1], 0, 2) == [0, 0]
    assert source_order(["b", None, "a", "B", "\U0001f600", "￿"]) == ["B", "a", "b", "￿", "\U0001f600", None]


def test_route_is_cheapest_maximal():
    rng = random.Random(1)
    for _ in range(40):
        s = rng.randrange(1, 4)
        patterns = [(sorted(rng.sample(range(s), rng.randrange(1, s + 1))), rng.randrange(0, 6)) for _ in range(rng.randrange(1, 4))]
        wanted = [rng.randrange(0, 8) for _ in range(s)]
        got = route(patterns, wanted, 2)
        flow = sum(w for r in got for _, _, w in r)
        cost = sum(c * w for r in got for c, _, w in r)
        best = cheapest(patterns, wanted)
        assert (round(flow, 6), round(cost, 6)) == best
        for (members, size), r in zip(patterns, got):
            assert all(j in members for _, j, _ in r) and all(sum(w for c, _, w in r if c == k) <= size + 1e-6 for k in range(2))
        for j, w in enumerate(wanted):
            assert sum(x for r in got for _, k, x in r if k == j) <= w + 1e-6


def cheapest(patterns, wanted):
    """Largest flow, and the least cost at it, over all whole-numbered flows."""
    best = {tuple(wanted): (0, 0)}
    for members, size in patterns:
        now = {}
        for left, (flow, cost) in best.items():
            options = [((), 0)]
            for j in members:
                options = [((*o, (j, x)), t + x) for o, t in options for x in range(min(left[j], 2 * size - t) + 1)]
            for o, t in options:
                rest = list(left)
                for j, x in o:
                    rest[j] -= x
                key, value = tuple(rest), (flow + t, cost + max(0, t - size))
                if key not in now or (value[0], -value[1]) > (now[key][0], -now[key][1]):
                    now[key] = value
        best = now
    top = max(f for f, _ in best.values())
    return top, min(c for f, c in best.values() if f == top)


def test_mix_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op1_source_mix"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(r.size == len((docs[r.doc_id].text or "").encode().split()) and r.taken in (0, r.size, 2 * r.size) for r in got)
    names = source_order([d.source for d in docs.values()])
    sizes = [sum(r.size for r in got if docs[r.doc_id].source == n) for n in names]
    want = dict(zip(names, targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes), 2)))
    for n, size in zip(names, sizes):
        mine = [r for r in got if docs[r.doc_id].source == n]
        assert all(r.source_size == size and r.target == pytest.approx(want[n]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[n]) <= max(0.05 * want[n], max(r.size for r in mine) / 2)
    assert {tuple(r) for r in got} == {tuple(r) for r in entry.queries()["op1_source_mix"](spark, sf).collect()}


def test_mix_overlapping_and_odd_rows(spark):
    rows = [(i, "w " * 5, ["a"] if i % 3 else ["b", "a"]) for i in range(60)] + [(70, None, ["a"]), (71, "", [None]), (72, "x y", [None]), (73, "x", []), (74, "x", None), (None, "z z", ["b"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, member array<string>")
    out, sources = mix(frame.withColumn("taken", F.lit("clash")), F.col("member"), lambda k: 1.0, budget_ratio=1.2)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "member", "size", "routes", "copies", "taken"]
    for r in got:
        assert r.copies == len(r.routes) <= 2 and len({x.copy for x in r.routes}) == len(r.routes) and all(x.source in (r.member or []) for x in r.routes)
    taken = Counter()
    for r in got:
        for x in r.routes:
            taken[x.source] += r.size
    for s in sources.collect():
        assert abs(taken[s.source] - s.target) <= 10
    empty, none = mix(frame.limit(0), F.col("member"), lambda k: 1.0)
    assert empty.count() == 0 and none.count() == 0


@pytest.mark.parametrize("share", [0.1, 0.3])
def test_choose_bins_passes_over_a_long_document(share):
    rng = np.random.default_rng(3)
    small = np.maximum(1, rng.lognormal(5, 1, 5000)).astype(np.int64)
    big = int(share / (1 - share) * small.sum())
    size = np.insert(small, 40, big)
    bins = pa.table({"members__": pa.array([["a"]] * len(size)), "bin__": pa.array(np.sort(rng.choice(65536, len(size), False)).astype(np.int32)), "size": pa.array(size)})
    target = 0.11 * float(size.sum())
    number = bins.column("bin__").to_numpy()
    plan = choose_bins([(0, "a", target)], bins).column("plan__")[0].as_py()
    taken = size[np.isin(number, sorted(planned(plan)))].sum()
    assert abs(taken - target) <= 0.001 * target


def planned(plan):
    out = set()
    for x in plan:
        bits = x["bits"]
        chosen = {b for b in range(x["first"], x["last"] + 1) if bits is None or bits[(b >> 6) - (x["first"] >> 6)] >> (b & 63) & 1}
        assert not out & chosen
        out |= chosen
    return out


def test_many_ranges_become_bits(spark):
    numbers = sorted(random.Random(2).sample(range(65536), 900))
    for few in (numbers, numbers[:MOST_RANGES], [63, 64, 65535]):
        ranges = bin_ranges(few, [2 * k for k in range(len(few))])
        assert planned(ranges) == set(few) and len(ranges) <= MOST_RANGES
    frame = spark.createDataFrame([(i, "w " * (1000 if i % 2 else 1), "a") for i in range(4000)], "doc_id long, text string, source string")
    out, sources = mix(frame, F.array("source"), lambda k: 1.0, budget_ratio=0.0009, max_copies=1)
    assert out.agg(F.sum("taken")).first()[0] == round(sources.first().target) and out.where("copies > 0").count() > MOST_RANGES


def check_pieces(rows, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_doc, by_sequence


def test_packing_query(spark, sf):
    from tokenizers import Tokenizer

    rows = entry.queries()["op4_pattern_packing"](spark, sf).collect()
    by_doc, by_sequence = check_pieces(rows, CAPACITY)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        want = [(k, a, len(ids[a:a + CAPACITY]), zlib.crc32(np.asarray(ids[a:a + CAPACITY], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), CAPACITY))]
        assert want == sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d.doc_id])
    assert len(by_sequence) <= 1.02 * -(-sum(r.length for r in rows) // CAPACITY) + 1


def test_packing_odd_rows(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "It's É x\x1fy  \n\n<|endoftext|>'LL 12", "a" * 300, "ab " * 9000, "ab " * 9000, "́x İİ Σ"]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "x", "c"), (3, "dup", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = pack(frame, capacity=64).collect()
    check_pieces(got, 64)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.update((i, k, zlib.crc32(np.asarray(ids[a:a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64)))
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in got) == want
    assert pack(frame.limit(0)).count() == 0


def test_plan_uses_the_histogram():
    rng = np.random.default_rng(3)
    for scale in (1, 50, 5000):
        h = np.zeros(513, np.int64)
        np.add.at(h, rng.integers(1, 513, 400), scale)
        used = np.zeros(513, np.int64)
        for pattern, repeats in plan_sequences(h, 512):
            assert sum(pattern) <= 512 and repeats > 0
            np.add.at(used, list(pattern), repeats)
        assert (used == h).all()
    skewed = np.zeros(513, np.int64)
    skewed[300] = 10 ** 9
    assert plan_sequences(skewed, 512) == [((300,), 10 ** 9)]


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).persist()
        kept[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == before.dtypes
    assert all(kept.values()) and kept["SimHash near-dedup"] < kept["language ID"]
    check_pieces(docs.collect(), CAPACITY)
    rows = entry.queries()["pipeline"](spark, sf).collect()
    assert Counter(r.ids_crc32 for r in rows) == Counter(r.ids_crc32 for r in docs.collect())


def test_pipeline_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "the of and", None, "s", 3), (90000, "", "en", None, 0), (90001, None, "en", "s", None)], docs.schema)
    for part in (docs.unionByName(odd), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            part = stage(spark, part, sf)
        assert corpus_pipeline.STAGES[-1][1](spark, part, sf).count() >= 0


def test_near_copy_stage_keeps_one_row_of_each_group(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c = "one two three four five six", "lorem ipsum dolor sit amet elit", "seven eight nine ten eleven twelve"
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (3, b, "en", "t", 1), (None, c, "en", "s", 1), (None, c, "de", "s", 1), (None, "quite another text", "en", "s", 1),
            (8, "x y", "en", "s", 1), (8, "x y", "en", "s", 1), (9, None, "en", "s", None), (9, "", "en", "s", 0), (None, "", "en", "s", 0)]
    got = corpus_pipeline.near_copy_stage(spark, spark.createDataFrame(rows, schema), sf).collect()
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter([(5, a), (3, b), (None, c), (None, "quite another text"), (8, "x y"), (9, "")])
    again = corpus_pipeline.near_copy_stage(spark, spark.createDataFrame(rows[::-1], schema), sf).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_near_copy_stage_takes_all_pairs_of_similarity_0_8(spark, sf):
    rng = random.Random(5)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows, shingles, up = [], {}, {}
    for k in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 120, 400]))]
        for c, edits in enumerate((0, 1, 2, rng.randrange(1, 12), 40)):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"x{rng.randrange(4000)}"
            rows.append((10 * k + c, " ".join(words), "en", "s", 1))
            shingles[10 * k + c] = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
            up[10 * k + c] = 10 * k + c
    for a in shingles:
        for b in shingles:
            if a < b and len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8:
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = {k: new if v == old else v for k, v in up.items()}
    got = {r.doc_id for r in corpus_pipeline.near_copy_stage(spark, spark.createDataFrame(rows, schema), sf).collect()}
    assert got == {k for k, v in up.items() if k == v} and len(got) < len(rows) - 60


def test_a_dense_family_of_near_copies(spark, sf):
    """Hundreds of copies of one text, each with its own edits, most pairs near 0.8 on either side: same groups as by all pairs."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(300):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(150)] = f"e{rng.randrange(3)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i:i + 5]) for i in range(146)} for w in map(str.split, texts)]
    up = list(range(300))
    for a in range(300):
        for b in range(a):
            if up[a] != up[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = [new if v == old else v for v in up]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    got = {r.doc_id for r in corpus_pipeline.near_copy_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf).collect()}
    assert got == set(up) and 5 < len(got) < 290


def test_repeat_stage_cuts_at_characters(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    passage = "".join(chr(0x430 + (k * k + k // 7) % 32) for k in range(260))
    rows = [(1, "д" + passage + "ж konec", "en", "s", 0), (2, "ф" + passage + "з drugoj", "en", "s", 0), (3, passage, "en", "s", 0), (4, "sam", "en", "s", 3)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeat_stage(spark, spark.createDataFrame(rows, schema), sf).collect()}
    assert got == {1: ("д konec", 7), 2: ("ф drugoj", 8), 4: ("sam", 3)}


def test_repeat_stage_cuts_passages_of_over_50_words(spark, sf):
    """Such a passage is often shorter than 400 bytes, and its lines may be broken elsewhere."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    passage, short = [f"w{k}é" for k in range(51)], [f"v{k}" for k in range(50)]
    rows = [(1, "one " + " ".join(passage) + " end", "en", "s", 0), (2, "two\n" + "\n".join(passage), "en", "s", 0), (3, " \n" + "  ".join(passage) + "\n", "en", "s", 0),
            (4, "four " + " ".join(short), "en", "s", 0), (5, "five " + " ".join(short), "en", "s", 0), (6, None, "en", "s", None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeat_stage(spark, spark.createDataFrame(rows, schema), sf).collect()}
    assert got == {1: ("one end", 7), 2: ("two\n", 4), 4: (rows[3][1], 0), 5: (rows[4][1], 0), 6: (None, None)}


def test_ids_equal_those_of_the_tokenizer():
    texts = [None, "", " ", "\n\n", "a  b", "İstanbul ŉx Ångström ÅNGSTRÖM ª º µ ß ẞ", "don't 12.5% x,y <|endoftext|> <|ENDOFTEXT|> Hello! hello,",
             "é ́a\xa0x y\rz\x0bq", "日本 語。 🎉🎉", "é,É. ñ! Ü?", "x" * 5000]
    word_ids, tokenizer = WordIds(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    for _ in range(2):  # the second time all words are known
        ids, places = text_ids(pa.array(texts, pa.string()), word_ids)
        assert [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:], strict=True)] == want
