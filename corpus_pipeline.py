"""A corpus pipeline: every stage works on all that the one before kept."""

from __future__ import annotations

from tsengine.llm import common, stages

STAGES: list = [
    ("quality", stages.keep_good),
    ("near_duplicates", stages.one_of_each_group),
    ("decontaminate", stages.keep_uncontaminated),
    ("secrets", stages.redact_secrets),
    ("pieces", stages.encode),
]
#: Hashed models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; what each stage returns is written to the shared folder and read again."""
    folder = common.shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = common.saved(stage(spark, docs, sf_dir), f"{folder}/{k}_{name}")
    return docs
