"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volarium.llm.automaton import drop_earlier_passages
from volarium.llm.backoff import backoff_scores
from volarium.llm.chat import format_chats, loss_text, read_back
from volarium.llm.crf import held_out, label_languages
from volarium.llm.levels import drop_repeated_bytes
from volarium.llm.lines import drop_shared_lines
from volarium.llm.mixing import mix
from volarium.llm.orchard import compress, sound
from volarium.llm.packing import pack
from volarium.llm.pivots import link_vectors
from volarium.llm.quality import judge
from volarium.llm.simhash import near_copies
from volarium.llm.whitening import whiten

SOURCE_WEIGHTS = (3.0, 1.0, 2.0)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def source_weight(k: int) -> float:
    return SOURCE_WEIGHTS[k % len(SOURCE_WEIGHTS)]


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has one source here, so a pattern is a source and the flow to it is its target."""
    mixed, sources = mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), F.array("source"), source_weight)
    out = mixed.join(F.broadcast(sources.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name")), "left")
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_earlier_passages(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = label_languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_backoff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff_scores(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"))


def op6_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


def op7_quality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    chats = format_chats(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(planted))
    read = chats.select("conv_id", "valid", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("learned"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op9_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op10_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    digits = ",".join(str(x) for part in codes.codebooks for entry in part for x in entry)
    by_label = codes.rows.table.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    rows = codes.rows.table.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(digits).cast("binary"), 256).alias("codebooks_sha256"))


def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding").where(sound(F.col("embedding")))
    shifted = F.transform("embedding", lambda c: F.floor(c.cast("double") * 1024) + 100000)
    fit = whiten(vectors.select("vec_id", shifted.alias("x")), 8, "x")
    sums = F.array(*map(F.lit, fit.sums)).cast("array<bigint>")
    apart = F.zip_with("x", sums, lambda x, s: x * fit.n - s)
    whole = F.aggregate(apart, F.lit(0).cast("long"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))  # null where 64 bits do not hold it
    deviation = F.when(whole.isNotNull(), whole).otherwise(F.raise_error(F.lit("a deviation is over 64 bits")).cast("long"))
    each = F.posexplode(F.arrays_zip("whitened", F.array(*map(F.lit, fit.explained)).cast("array<double>").alias("explained")))
    rows = fit.rows.select("vec_id", deviation.alias("deviation"), each.alias("place", "of"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", F.col("of.whitened").alias("whitened"),
                       F.col("of.explained").alias("explained"), F.lit(fit.identity_error).alias("identity_error"))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_substring_dedup, op3_language_crf, op4_pattern_packing, op5_backoff_score, op6_pivot_range_join,
                                   op7_quality_table, op8_chat_format, op9_simhash_index, op10_suffix_levels,
                                   op11_line_dedup, op12_orchard_codes, op13_block_whitening)}
