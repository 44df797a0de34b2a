"""Line dedup: lines that many documents share stay in the first of them only.

A text is split at newlines. A line's key is the line without white space (space, 0x09-0x0D) at its ends and with A-Z in lower case; keys of
fewer than `least_chars` code points are never dropped. A key found in at least `least_documents` documents loses all its
lines except those of the smallest id that holds it, which keeps every repetition.

On Spark: the normalised lines are exploded to rows (document, position, 128-bit hash of the key), written once. Distinct documents per
hash are counted in two steps, first one row for each (hash, document), then sums for each hash, both added up before they
are shuffled, so a line that a third of all documents hold costs one row per task in the second step. The rows whose
hash is over the threshold are found by an ordinary join (adaptive execution splits a hot hash), only they are gathered as
positions for each document, and the texts, shuffled once, are put together again from the positions that are left.
No text is compared with another one, and nothing reaches the driver. A task holds one text at a time, whatever its length,
with its lines and the positions that go.

Defined cases: a null or empty text is one empty line and stays (kept is empty); rows with equal ids are one document, whose lines are kept
or dropped alike; so are all rows with a null id, a document that comes after all others; an empty table gives an empty table; other
columns pass through unless they are named like a result column, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volarium.llm.naming import free_names
from volarium.session import stage

RESULT = ("n_lines", "n_dropped", "kept")
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_rows(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(doc, text_hash, pos, h1, h2): every line long enough, with its 0-based position and the hash of its key."""
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    keys = lines.select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keys.select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_lines(lines: DataFrame, least_documents: int) -> DataFrame:
    """(h1, h2, first, documents): keys held by enough documents, with the smallest id among them."""
    held = lines.select("h1", "h2", "doc").distinct()
    counted = held.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("documents"))
    return counted.where(F.col("documents") >= least_documents)


def drop_shared_lines(docs: DataFrame, least_documents: int = 2, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with n_lines (before), n_dropped and kept, the other lines in their order, joined by newlines."""
    docs = docs.drop(*RESULT)
    doc, text_hash, gone, all_lines = free_names((*docs.columns, *RESULT), "doc", "text_hash", "gone", "lines")
    lines = stage(line_rows(docs, id_col, text_col, least_chars), "lines").table
    over = lines.join(shared_lines(lines, least_documents), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    positions = over.groupBy(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash)).agg(F.collect_set("pos").alias(gone))
    joined = docs.join(positions, F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text_col) == F.col(text_hash)), "left")
    parts = joined.withColumn(all_lines, split_lines(F.col(text_col)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda p: F.get(F.col(all_lines), p)), "\n"))
    return parts.select(*docs.columns, F.size(all_lines).cast("long").alias("n_lines"),
                        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
