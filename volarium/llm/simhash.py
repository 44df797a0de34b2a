"""SimHash near-dedup by multi-index hashing.

The fingerprint of a text: A-Z lower-cased, words without white space, shingles of `words` consecutive words with
repeats, XXH64 of each; a bit is 1 if it is set in over half of the hashes. Fewer words make one shingle, no word makes
fingerprint zero, which links like any other.

Documents meet only through distinct fingerprints. A fingerprint has two segments of 32 bits; of two fingerprints that
differ in at most 2 bits one segment differs in at most 1. So every fingerprint enumerates the Hamming ball of radius
1 around each of its segments, fetches the fingerprints that the segment table lists there, and verifies the
whole distance. The ball is enumerated upwards only (0 to 1): the partner with the 0 finds the other one.

A segment value that very many distinct fingerprints share would pair all of them, so it takes another exact way:
members whose other half agrees once two of its bits (or one, if the segment itself differs in one) are masked are
linked directly, so each mask makes a star to its smallest member.

On Spark: whatever grows with the documents or their fingerprints is joined by merging. Spark sizes exploded rows, of which a fingerprint makes
over 30, as the file they come from, and files by their compressed bytes, and would send them through the driver. Only the hot
segment values are broadcast, while few by count.

Defined cases: null text as an empty one; null ids keep their row, and a class of null ids only has a null
component; repeated rows share a fingerprint, and of tied ids there is only one smallest; texts of any length are hashed whole; an empty table gives an empty table; other columns pass through
unless they are named like a result column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volarium.llm.arrowtext import chunks
from volarium.llm.components import components
from volarium.session import Staged, attach, stage

RESULT = ("fingerprint", "component_id", "component_fingerprint")
SEED = 42
HOT_SEGMENT = 1000  # distinct fingerprints of one segment value beyond which pairs are replaced by stars
SEGMENTS = 2
SEGMENT_BITS = 32


def shingle_hashes(text: bytes, words: int) -> list[int]:
    parts = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(b" ".join(parts), SEED)] if parts else []
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(parts) - words + 1].tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist(), strict=True)]


def fingerprints(texts: list[bytes | None], words: int) -> np.ndarray:
    """Fingerprints as signed 64-bit numbers."""
    out = np.zeros(len(texts), np.uint64)
    sizes = np.concatenate(([0], np.cumsum([len(t or b"") for t in texts])))
    for lo, hi in chunks(sizes, 1 << 19):
        hashes = [shingle_hashes(t or b"", words) for t in texts[lo:hi]]
        counts = np.asarray([len(h) for h in hashes])
        some = np.flatnonzero(counts)
        if not len(some):
            continue
        flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(counts.sum()))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(counts[some])[:-1])), axis=0, dtype=np.int32)
        out[lo + some] = np.packbits(sums * 2 > counts[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """Every row with fp__, its fingerprint as a signed long."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(fingerprints(texts, words))], names=[*(batch.schema.names[i] for i in keep), "fp__"])
    at = docs.columns.index(text_col)
    return docs.mapInArrow(scan, docs.drop(text_col).withColumn("fp__", F.lit(0).cast("long")).schema)


def _segment(k: int) -> Column:
    return F.expr(f"shiftrightunsigned(fp, {k * SEGMENT_BITS}) & 4294967295L")


def links(classes: DataFrame, hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at 1 or 2 differing bits: enough of them to join every class."""
    segments = F.explode(F.array(*(F.struct(F.lit(k).alias("segment"), _segment(k).alias("value"), _segment(1 - k).alias("rest")) for k in range(SEGMENTS))))
    entries = classes.select("fp", segments.alias("s")).select("fp", "s.*")
    hot = stage(entries.groupBy("segment", "value").count().where(F.col("count") > hot_segment).select("segment", "value"), "hot-segments")
    flips = F.expr(f"transform(filter(sequence(0, {SEGMENT_BITS - 1}), i -> (shiftrightunsigned(value, i) & 1L) = 0), i -> value | shiftleft(1L, i))")
    balls = entries.select("segment", "value", "rest", "fp", F.explode(F.concat(F.array("value"), flips)).alias("probe"))
    probes = balls.select("segment", F.col("probe").alias("value"), F.col("fp").alias("a"), (F.col("probe") == F.col("value")).alias("same"))
    tables = entries.select("segment", "value", F.col("fp").alias("b"))
    if hot.rows:
        tables = attach(tables, hot, ["segment", "value"], "left_anti")
    close = (F.expr("bit_count(a ^ b)") <= 2) & (F.col("a") != F.col("b")) & (~F.col("same") | (F.col("a") < F.col("b")))
    pairs = probes.join(tables.hint("merge"), ["segment", "value"]).where(close).select("a", "b")
    return pairs.unionByName(_stars(entries, balls, hot)) if hot.rows else pairs


def _stars(entries: DataFrame, balls: DataFrame, hot: Staged) -> DataFrame:
    """Links through hot segment values, at a fixed number of rows for each member and probe."""
    bits = SEGMENT_BITS - 1
    two = F.expr(f"flatten(transform(sequence(0, {bits - 1}), i -> transform(sequence(i + 1, {bits}), j -> struct(i as i, j as j, "
                 "rest & ~(shiftleft(1L, i) | shiftleft(1L, j)) as masked))))")
    one = F.expr(f"transform(sequence(0, {bits}), i -> struct(i as i, -1 as j, rest & ~shiftleft(1L, i) as masked))")
    key = ["segment", "value", "m.i", "m.j", "m.masked"]
    members = attach(entries, hot, ["segment", "value"])
    listed = members.select("segment", "value", "fp", F.lit(True).alias("member"), F.explode(F.concat(two, one)).alias("m"))
    near = (attach(balls.where("probe <> value").select("segment", F.col("probe").alias("value"), "rest", "fp"), hot, ["segment", "value"])
            .select("segment", "value", "fp", F.lit(False).alias("member"), F.explode(one).alias("m")))
    rows = listed.unionByName(near).select(*key, "fp", "member")
    names = ["segment", "value", "i", "j", "masked"]
    centre = rows.groupBy(*names).agg(F.min(F.when(F.col("member"), F.col("fp"))).alias("b"), F.count("*").alias("n")).where("n > 1 and b is not null")
    return rows.join(centre.hint("merge"), names).select(F.col("fp").alias("a"), "b").where("a <> b").distinct()


def near_copies(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """Every row without its text, with fingerprint (16 hexadecimal digits), component_id, the smallest id reachable by links, and
    component_fingerprint, which tells components apart where ids are null or occur in several rows."""
    docs = docs.drop(*RESULT)
    marked = stage(with_fingerprint(docs, words, text_col), "fingerprints").table
    classes = stage(marked.groupBy(F.col("fp__").alias("fp")).agg(F.min(id_col).alias("lowest")), "fingerprint-classes").table
    reach = components(links(classes, hot_segment), "fingerprint-components")
    rooted = classes.join(reach.hint("merge"), classes.fp == reach.node, "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = rooted.join(lowest.hint("merge"), "root").select(F.col("fp").alias("fp__"), "component_id", _digits("root").alias("component_fingerprint"))
    return marked.join(named.hint("merge"), "fp__").withColumn("fingerprint", _digits("fp__")).drop("fp__")


def _digits(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
