"""Language field, quality table, chat format, back-off scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from volarium.llm import crf
from volarium.llm.backoff import backoff_scores, pack_numbers, pack_sorted, unpack_numbers, unpack_sorted
from volarium.llm.chat import format_chats, loss_text, read_back
from volarium.llm.quality import judge
from volarium.llm.queries import op5_backoff_score

ODD = [(None, None), (901, None), (902, ""), (903, " \n\t"), (904, "..."), (905, "word"), (905, "word")]


def test_a_language_of_few_copied_texts_is_learned(spark, sf):
    """A third language whose rows are copies of two texts is predicted for them, and sureness does not fall with an even mixture."""
    words = {"aa": "kolo dom strom reka pole", "bb": "the house tree river field", "cc": "zyx wvu tsr qpo nml"}
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choices(words[k].split(), k=30))
    rows = [(k, text(lang), lang) for k, lang in enumerate(["aa", "bb"] * 400)]
    rare = [text("cc"), text("cc")]
    rows += [(1000 + k, rare[k % 2], "cc") for k in range(900)]
    mixed = " ".join(x for k in ("aa", "bb", "cc") for x in [text(k)])
    got = {r.doc_id: r for r in crf.label_languages(spark.createDataFrame(rows + [(5000, mixed, None)], "doc_id long, text string, lang string")).where("doc_id >= 990").collect()}
    assert {got[1000 + k].lang_pred for k in range(900)} == {"cc"}
    assert got[5000].score < 0.6 < 0.8 < got[5000].sureness <= 1


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(5, 3)).astype(np.float32), rng.normal(size=(3, 3))
    want, pairs, total = np.zeros((5, 3)), np.zeros((3, 3)), 0.0
    for code in range(3 ** 5):
        path = [code // 3 ** t % 3 for t in range(5)]
        p = math.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, y in enumerate(path):
            want[t, y] += p
        for a, b in zip(path, path[1:]):
            pairs[a, b] += p
    got, expected = crf.forward_backward(scores, np.array([0]), np.array([5]), moves, pairs=True)
    assert np.allclose(got, want / total, atol=1e-4) and np.allclose(expected, pairs / total, atol=1e-3)


def test_language_held_out(spark, sf):
    rows = entry.queries()["op3_language_crf"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    both = docs.unionByName(spark.createDataFrame([(i, t, None) for i, t in ODD], "doc_id long, text string, lang string"))
    got = Counter((r.doc_id, r.lang_pred if r.text != "word" else "-") for r in crf.label_languages(both).where("doc_id is null or doc_id >= 900").collect())
    assert got == Counter({(None, "und"): 1, (901, "und"): 1, (902, "und"): 1, (903, "und"): 1, (904, "und"): 1, (905, "-"): 2})
    empty = docs.limit(0)
    assert crf.label_languages(empty).count() == 0


def test_switching_text_has_both_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 1500")
    field = crf.train(docs)
    texts = {lang: [r.text for r in docs.where(F.col("lang") == lang).limit(3).collect()] for lang in field.labels}
    a, b = [t for t in field.labels if texts[t]][:2]
    joined = (texts[a][0][:600] + " " + texts[b][0][:600]).encode()
    mean, _ = crf.predict(field, np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
    assert mean[0][field.labels.index(a)] > 0.3 and mean[0][field.labels.index(b)] > 0.3


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_quality_counts(spark, sf):
    rng = random.Random(5)
    rows = [(i, rng.choice((" ", "\n")).join(rng.choices("a b c d <é> \U0001f600x".split(), k=rng.randrange(60)))) for i in range(40)] + ODD + [(906, "the same line of it\n" * 30), (907, "x y\n\r\nx y\n")]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got.collect()) == Counter((i, *brute_quality(t)) for i, t in rows)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    judged = judge(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    assert judged.count() > 0 and judged.where("not kept").count() == 0


def test_quality_empty_and_clashes(spark):
    assert judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = judge(spark.createDataFrame([(1, "a", True, 3)], "doc_id long, text string, kept boolean, words long"))
    assert out.columns[:3] == ["doc_id", "text", "words"] and out.first().kept is False


def test_chats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\s\\b\\", "<<SYS>>", "<role:x>", None, "", "[", "é\n<"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to>ol[<", None]), rng.choice(nasty)) for c in range(30) for t in range(rng.randrange(1, 6))] + [(None, None, "user", "x"), (None, 0, "assistant", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = format_chats(frame).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("learned"), "segments").collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    assert {r.conv_id: r.learned for r in got} == {c: "".join(x for r, x in t if r == "assistant") for c, t in want.items()}
    assert all("".join(s.text for s in r.segments) == r.formatted for r in got)
    assert format_chats(frame.limit(0)).count() == 0


@pytest.mark.parametrize("roles, valid", [("user", True), ("user assistant", True), ("system user assistant user", True), ("assistant user", False), ("user user", False),
                                          ("system", False), ("user system", False), ("user tool", False)])
def test_turn_order(spark, roles, valid):
    frame = spark.createDataFrame([(1, k, r, "t") for k, r in enumerate(roles.split())], "conv_id long, turn long, role string, text string")
    assert format_chats(frame).first().valid is valid


def test_backoff_scores(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(30)], k=rng.randrange(25)))) for i in range(80)] + ODD
    uni, bi = Counter(), Counter()
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for w in texts:
        uni.update(w)
        bi.update(zip(w, w[1:]))
    n = sum(uni.values())

    def score(w):
        s = [math.log10(uni[w[0]] / n)] if w else []
        return sum(s + [math.log10(bi[a, b] / uni[a]) if bi[a, b] >= 2 else math.log10(0.4 * uni[b] / n) for a, b in zip(w, w[1:])])
    got = sorted((r.doc_id or -1, r.n_words, round(r.log_score, 6), None if r.mean_log_score is None else round(r.mean_log_score, 6)) for r in backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), min_count=2, order=2).collect())
    want = sorted((i or -1, len(w), round(score(w), 6), round(score(w) / len(w), 6) if w else None) for (i, _), w in zip(rows, texts))
    assert got == want
    assert backoff_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_backoff_query_backs_off_only_where_unseen(spark, sf):
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(tuple(w[i:i + n]) for w in texts.values() for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(map(len, texts.values()))

    def score(gram):  # every n-gram of the corpus itself is seen, so nothing backs off
        return math.log10(counts[gram] / (counts[gram[:-1]] if len(gram) > 1 else total))
    got = {r.doc_id: r.mean_log_score for r in op5_backoff_score(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, w in texts.items():
        assert got[i] == (pytest.approx(sum(score(tuple(w[max(0, k - 2):k + 1])) for k in range(len(w))) / len(w), abs=1e-6) if w else None)


@pytest.mark.parametrize("min_count", [1, 2, 3])
def test_backoff_trigrams(spark, min_count):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.randrange(12)))) for i in range(50)]
    counts = Counter(tuple(w[i:i + n]) for _, t in rows if (w := t.split()) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(len(t.split()) for _, t in rows)

    def score(gram):
        if len(gram) == 1:
            return math.log10(counts[gram] / total)
        return math.log10(counts[gram] / counts[gram[:-1]]) if counts[gram] >= min_count else math.log10(0.4) + score(gram[1:])
    got = {r.doc_id: r.log_score for r in backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), min_count=min_count, order=3).collect()}
    for i, t in rows:
        w = t.split()
        assert got[i] == pytest.approx(sum(score(tuple(w[max(0, k - 2):k + 1])) for k in range(len(w))), abs=1e-9)


def test_packed_numbers():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (unpack_sorted(pack_sorted(values)) == values).all() and (unpack_sorted(pack_sorted(values[:1])) == values[:1]).all()
    rng = np.random.default_rng(2)
    for large in (0, 1, 40):
        values = rng.integers(0, 200, 1000, dtype=np.uint64)
        values[rng.choice(1000, large, replace=False)] = rng.integers(1 << 40, 1 << 63, large, dtype=np.uint64)
        assert (unpack_numbers(pack_numbers(values)) == values).all() and len(pack_numbers(values)) <= 1013 + 12 * large
    assert len(unpack_numbers(pack_numbers(values[:0]))) == 0
