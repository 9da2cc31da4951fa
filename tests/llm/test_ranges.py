"""Ranges of the Merkle fingerprints' ids: whole ids and text hashes, so neither long prefixes nor hot ids stay in one range."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tsengine.llm import fingerprints


def ranges(df):
    rows = df.select("_id", "_text", F.xxhash64("_text").alias("_order")).withColumn("_key", fingerprints._key())
    n = max(1, rows.count() // fingerprints.RANGE_ROWS)
    sample = sorted((r["_key"] for r in rows.select("_key").collect()), key=lambda k: (k["known"], k["id"] if k["known"] else 0, k["order"]))
    edges = [sample[len(sample) * j // n] for j in range(1, n)]
    return collections.Counter(r["_range"] for r in fingerprints._with_range(rows, edges).collect())


def check_next(df):
    got = collections.defaultdict(list)
    rows = [(r["_id"], r["_text"], r["h"]) for r in df.withColumn("h", F.xxhash64("_text")).collect()]
    for r in fingerprints.with_next(df).collect():
        got[r["_id"], r["_text"]].append(r["_next"])
    rows.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[2]))
    want = collections.defaultdict(list)
    for (i, t, _), (_, following, _) in zip(rows, rows[1:] + rows[:1]):
        want[i, t].append(following)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("prefix", ["document-", "d"])
def test_long_prefixes(spark, monkeypatch, prefix):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 50)
    rows = [(f"{prefix}{i:06d}", f"text {i}") for i in range(1500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "_id string, _text string")
    found = ranges(df)
    assert len(found) == 30 and max(found.values()) == 50
    check_next(df)


def test_hot_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 50)
    rows = [(7, f"hot {i}") for i in range(800)] + [(None, f"nobody {i}") for i in range(400)] + [(i, f"own {i % 5}") for i in range(-100, 300)] + [(7, "same")] * 3
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "_id long, _text string")
    assert max(ranges(df).values()) < 60
    check_next(df)


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(None, "a"), (None, "a")]])
def test_few_rows(spark, rows):
    check_next(spark.createDataFrame(rows, "_id long, _text string"))
