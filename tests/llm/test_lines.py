"""Line dedup against a brute-force version."""

import random

import pytest

from volarium.llm.lines import drop_shared_lines
from volarium.llm.naming import free_names

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least_documents=2, least_chars=10):
    last = float("inf")  # a null id
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(last if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least_chars or len(held[key(x)]) < least_documents or min(held[key(x)]) == (last if d is None else d)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in drop_shared_lines(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("least", [2, 3])
def test_random_texts(spark, least):
    rng = random.Random(least)
    pool = ["short", "", " ", "A line of words", "a Line of words  ", "\ta line of words\x0b", "Ünïcode Zeile", "ünïcode zeile", "Ünïcode Zeil", "nine char", "ten chars!", "x" * 5000,
            "no break space", " no break space", "carriage return\r"]
    rows = [(d, "\n".join(rng.choice(pool) + rng.choice(["", "", str(rng.randrange(40))]) for _ in range(rng.randrange(8)))) for d in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, None), (None, "A line of words"), (None, "A line of words\nA line of words"), (0, "ten chars!\nten chars!")]
    rows += [(200 + k, "one hot line everywhere\none hot line everywhere\nown line number %d" % k) for k in range(50)] + [rows[3]] * 3
    assert run(spark, rows, least_documents=least) == brute(rows, least)


def test_the_smallest_id_keeps_every_repetition_and_null_comes_last(spark):
    rows = [(7, "the same line\nthe same line"), (3, " THE SAME LINE\nother\nthe same line"), (None, "the same line"), (None, "only in rows without id")]
    assert run(spark, rows) == brute(rows)
    kept = {r[0]: r[3] for r in run(spark, rows) if r[0]}
    assert kept == {7: "", 3: " THE SAME LINE\nother\nthe same line"}
    assert run(spark, [(None, "one more line"), (None, "one more line")]) == [(None, 1, 0, "one more line")] * 2


def test_one_very_long_text(spark):
    long = "\n".join(f"line number {k % 90_000}" for k in range(200_000))
    got = run(spark, [(2, long), (1, "line number 5\nline number 89999"), (3, "x" * 3_000_000)])
    assert {r[0]: r[1:3] for r in got} == {1: (2, 0), 2: (200_000, 3 + 2), 3: (1, 0)}


def test_clashing_columns_string_ids_and_empty_table(spark):
    df = spark.createDataFrame([("b", "shared line", 1, 2, "x"), ("a", "shared line", 3, 4, "y")], "doc_id string, text string, doc int, gone int, kept string")
    df = df.selectExpr("*", "doc AS POS", "doc AS lines", "doc AS h1", "doc AS text_hash", "doc AS first", "doc AS line")
    got = {r.doc_id: r for r in drop_shared_lines(df).collect()}
    assert got["a"].kept == "shared line" and got["b"].kept == "" and got["b"].doc == 1 and got["a"].lines == 3
    empty = drop_shared_lines(df.where("false"))
    assert empty.count() == 0 and empty.columns[-3:] == ["n_lines", "n_dropped", "kept"]


def test_free_names():
    assert free_names(["a", "B", "b_"], "a", "b", "c", "c") == ["a_", "b__", "c", "c_"]
