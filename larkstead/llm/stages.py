"""Stages of a corpus pipeline: documents in, documents out; the last gives packed pieces.

Each stage works on all rows of its predecessor and keeps every column of documents; n_chars
follows a text that changes. Rows with one doc_id share a fate. Null texts count as empty.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import jaccard, line_dedup, mixing, packing, quality
from .common import bit_set, bits_for, discard, fresh, in_bits, map_batches, saved, table

SEQUENCE = 4096


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in ``gone`` (column doc_id); only rows that may be are shuffled."""
    gone = saved(gone.select("doc_id").distinct())
    keys = saved(gone.select(F.xxhash64("doc_id").alias("k")))
    bits = bit_set(keys, "k", bits_for(keys.count()))
    discard(keys)
    keyed = docs.withColumn(*fresh(docs.columns, "_k"), F.xxhash64("doc_id"))

    def split(suspect: bool):
        def f(batches):
            for batch in batches:
                kept = batch.filter(pa.array(in_bits(bits, batch.column(batch.num_columns - 1).to_numpy()) == suspect))
                yield kept.select(list(range(kept.num_columns - 1)))

        return map_batches(keyed, f, docs.schema)

    return split(False).union(split(True).join(gone, "doc_id", "left_anti").select(docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    (score,) = fresh(docs.columns, "_score")
    return quality.score(docs, model, score_column=score).where(F.col(score) >= 0.5).drop(score)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeats of lines and runs out of texts; documents of which no word is left go."""
    (removed,) = fresh(docs.columns, "_removed")
    out = line_dedup.dedup(docs, removed_column=removed, least=line_dedup.LEAST)
    gone = (F.col(removed) > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chars = F.when(F.col(removed) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.where(~gone).withColumn("n_chars", chars).select(docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near duplicates: five words, similarity 0.8."""
    found = jaccard.join(docs, 5, 80, 100)
    fate = found.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"))
    return without(docs, fate.where("stays = 0"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come to their target weights.

    Rows with one id, source and size are told apart by their place among them.
    """
    names = fresh(docs.columns, "_size", "_place", "_copy")
    size, place, copy = names
    own = ["doc_id", "source", size]
    sized = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))
    mixed = mixing.mix(saved(sized.select("doc_id", "source", F.col(size).alias("size"))))
    mixed = mixed.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("copies").cast("int").alias("n"))
    mixed = mixed.withColumn("r", F.row_number().over(W.Window.partitionBy("i", "s", "z").orderBy(F.col("n").desc()))).where("n > 0")
    mixed = mixed.toDF(*fresh([*docs.columns, *names], "_i", "_s", "_z", "_n", "_r"))
    i, s, z, n, r = mixed.columns
    placed = sized.withColumn(place, F.row_number().over(W.Window.partitionBy(*own).orderBy(F.xxhash64("text"))))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(size) == F.col(z)) & (F.col(place) == F.col(r))
    return placed.join(mixed, same).withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences."""
    import public_tokenizers

    pieces = packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, keep_ids=False)
    return packing.pack(saved(pieces), SEQUENCE)
