"""Stages of a corpus pipeline: each takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, jaccard, pieces, quality, secrets

#: What takes the place of a secret.
REDACTED = "[SECRET]"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train_quality(docs, common.table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).filter("predicted = 1").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the row with the smallest id, nulls last, and of one id's texts the one with
    the smallest hash, once; the others go, and so do repeats of an id with the same text.

    Groups are of rows, not of ids: texts of one id that are no near copies all stay. Texts without words are copies of nothing;
    with a null id every one of them stays. Only rows whose id and text are among the dropped or repeated ones, or may be by a
    Bloom filter of fixed size, are shuffled; repeats are merged before the shuffle.
    """
    folder = common.shared_dir(spark)
    groups = common.saved(jaccard.jaccard_components(docs, k=5, percent=80, row_keys=True), f"{folder}/groups")
    rows = groups.filter("doc_id is not null or n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.count("*").alias("n"), F.min("first").alias("first"))
    special = rows.filter("n > 1 or not first").select("_id", "_key", (~F.col("first")).alias("_gone"))
    special = common.saved(special.withColumn("_h", F.xxhash64("_id", "_key")), f"{folder}/special")
    sent = spark.sparkContext.broadcast(common.bloom(special, "_h"))
    names = docs.columns

    def test(rb):
        import numpy as np
        import pyarrow as pa

        h = rb.column(rb.schema.get_field_index("_h")).to_numpy(zero_copy_only=False)
        return [pa.array(common.in_bloom(sent.value, h.astype(np.int64).view(np.uint64)))]

    keyed = docs.withColumn("_key", F.xxhash64("text")).withColumn("_h", F.xxhash64("doc_id", "_key"))
    marked = common.append_columns(keyed, test, [common.field("_maybe", "boolean")])
    free = F.col("doc_id").isNull() & F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z")
    through = marked.filter(~F.col("_maybe") | free).select(names)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    asked = marked.filter(F.col("_maybe") & ~free).select(F.col("doc_id").alias("_id"), "_key", row.alias("_row"), F.lit(None).cast("boolean").alias("_gone"))
    told = special.select("_id", "_key", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), "_gone")
    once = asked.union(told).groupBy("_id", "_key").agg(F.min("_row").alias("_row"), F.max("_gone").alias("_gone"))
    return through.union(once.filter("_row is not null and not coalesce(_gone, false)").select("_row.*"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.mark_contamination(docs, common.table(spark, sf_dir, "benchmark")).filter("not contaminated").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced; n_chars follows the text."""
    found = secrets.scan_secrets(docs, secrets.train_secret_models(docs), redact=REDACTED)
    changed = {"text": F.when(F.col("text").isNotNull(), F.col("redacted")), "n_chars": F.when(F.col("redacted") == F.col("text"), F.col("n_chars")).otherwise(F.length("redacted").cast("long"))}
    return found.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the decoded text, piece ids and the bytes of the source under each."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    keep = [c for c in docs.columns if c in ("doc_id", "lang", "source")]
    return pieces.encode_pieces(docs, path, keep=keep)
