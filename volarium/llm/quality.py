"""Quality rules: a threshold table compiled into one projection.

A measure is a column expression over the words and lines of a text; a rule is a row (measure, lower, upper) of the table.
`judge` compiles the table into one boolean over the counts of the text; counts and verdict are column expressions of one
projection without any user function, shuffle or aggregation, so a text never leaves its task.

Words are runs of characters other than space and 0x09-0x0D. Words in repeated windows: every window of 8 words has a
64-bit hash; only if two hashes of a text agree are the windows sorted to find which words they cover.

Defined cases: a null text has no words; a text of any length is one row of the projection, with arrays of its own words, lines and windows; of equal lines or windows
all but the first line, and all windows, count, so ties need no rule; division by zero words gives a ratio of zero; repeated rows are judged
alike; an empty table gives an empty table; other columns pass through unless they are named like a result column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = (*COUNTS, "base_failed", "kept")

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = ("the of and to in a is that it for was on are as with be at this by an or from not but have he his they "
              "der die das und ist nicht ein eine zu den von mit im sich auf dem des für als auch es an "
              "le la les et un une est que dans pour pas sur au du en il qui par ne se ce plus "
              "el los las y que una con para por del se su al lo como más pero sus").split()


@dataclass(frozen=True)
class Rule:
    """The measure must lie in [lower, upper]; None leaves a side open."""

    measure: str
    lower: float | None = None
    upper: float | None = None


DEFAULT_RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.005, None),
    Rule("dup_line_share", None, 0.5),
    Rule("blank_line_share", None, 0.8),
)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


MEASURES = {
    "mean_word_chars": lambda: _ratio(F.col("word_chars"), F.col("n_words")),
    "symbols_per_word": lambda: _ratio(F.col("n_symbols"), F.col("n_words")),
    "stop_word_share": lambda: _ratio(F.col("stop__"), F.col("n_words")),
    "dup_line_share": lambda: _ratio(F.col("n_dup_lines"), F.col("full_lines__")),
    "blank_line_share": lambda: _ratio(F.col("all_lines__") - F.col("full_lines__"), F.col("all_lines__")),
}


def compile_rules(rules: Sequence[Rule]) -> Column:
    """One boolean over the counts: all measures inside their limits."""
    verdict = F.lit(True)
    for r in rules:
        value = MEASURES[r.measure]()
        for limit, holds in ((r.lower, lambda v, x: v >= x), (r.upper, lambda v, x: v <= x)):
            if limit is not None:
                verdict = verdict & holds(value, F.lit(limit))
    return verdict


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(hashes: Column, window: int) -> Column:
    """Words that lie in windows which the text holds twice or more, from the hashes of its words."""
    def windows(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))
        return F.when(F.size(h) >= window, grams).otherwise(F.array().cast("array<bigint>"))

    def places(sorted_: Column) -> Column:
        agree = F.transform(sorted_, lambda s, j: F.when((s["h"] == F.get(sorted_, j - 1)["h"]) | (s["h"] == F.get(sorted_, j + 1)["h"]), s["i"]))
        return F.sort_array(F.filter(agree, lambda i: i.isNotNull()))

    def cover(p: Column) -> Column:
        parts = F.transform(p, lambda at, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - at, F.lit(window))))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda total, part: total + part)

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(ordered, lambda s: let(places(s), cover))).otherwise(F.lit(0).cast("long"))

    return let(hashes, lambda h: let(windows(h), covered))


def counts(text: Column, window: int) -> Column:
    """All counts of a text as one struct."""
    words = F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("stop"),
        repeated_words(F.transform(w, lambda x: F.xxhash64(x)), window).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("full"), F.size(F.array_distinct(x)).cast("long").alias("distinct")))
    return F.struct(of_words.alias("words"), of_lines.alias("lines"), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
                    (F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("all_lines"))


def judge(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text_col: str = "text", window: int = WINDOW, min_words: int = 20,
          max_repeat_percent: int = 30) -> DataFrame:
    """Every row with the base counts, base_failed and kept: false if the base fails, else the verdict of the table."""
    docs = docs.drop(*RESULT)
    counted = docs.withColumn("c__", counts(F.coalesce(F.col(text_col), F.lit("")), window)).select(
        *docs.columns, "c__.words.n_words", "c__.words.word_chars", "c__.n_symbols", (F.col("c__.lines.full") - F.col("c__.lines.distinct")).alias("n_dup_lines"),
        "c__.words.n_repeat_words", F.col("c__.words.stop").alias("stop__"), F.col("c__.lines.full").alias("full_lines__"), F.col("c__.all_lines").alias("all_lines__"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    return judged.select(*docs.columns, *RESULT)
