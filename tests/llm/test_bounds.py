"""What operators bring to the driver or broadcast stays within their stated bounds, whatever repeats."""

import collections

import numpy as np

from tsengine.llm import backoff, quality


def fitted_rows(monkeypatch):
    seen = []

    def fit(f, x, at, labels):
        seen.append((len(labels), labels.tolist()))

    monkeypatch.setattr(quality, "fit", fit)
    return seen


def test_learnt_rows_are_bounded(spark, monkeypatch):
    seen = fitted_rows(monkeypatch)
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(i, f"own {i}") for i in range(2, 60)] + [(61, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 62)] + [(5, 0), (5, 1), (None, 1), (6, None)], "doc_id long, quality int")
    quality.train_quality(docs, labels, most_rows=10)
    quality.train_quality(docs, labels, most_rows=1000)
    quality.train_quality(docs, labels, most_rows=1000, most_bytes=100)
    quality.train_quality(docs, labels, most_rows=1000, most_bytes=0)
    counts = [n for n, _ in seen]
    assert counts[0] == 10 and 40 < counts[1] < 61 and 5 < counts[2] <= 20 and counts[3] == 0
    quality.train_quality(docs, labels, most_rows=1000)
    assert seen[-1] == seen[1]  # the same rows each time


def test_learning_from_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = quality.train_quality(empty, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.score_quality(spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string"), model).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 2
    assert quality.score_quality(empty, model).collect() == []


def test_every_common_ngram_has_a_slot(monkeypatch):
    monkeypatch.setattr(backoff, "SLOTS", 1 << 12)
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(1, 1 << 63, 20_000).astype(np.uint64))
    r.shuffle(keys)
    tables = backoff._slots(keys, np.arange(len(keys)) + 1.0)
    found, gain = backoff._held(tables, keys)
    assert found.all() and gain.tolist() == (np.arange(len(keys)) + 1.0).tolist()
    first = tables[0][0]
    assert len(np.intersect1d(first[first > 0], keys[:2000])) > 0.7 * 2000  # the commonest stand in the first table
    other = np.setdiff1d(r.integers(1, 1 << 63, 5000).astype(np.uint64), keys)
    found, gain = backoff._held(tables, other)
    assert not found.any() and not gain.any()
    assert backoff._held(backoff._slots(keys[:0], np.zeros(0)), keys)[0].sum() == 0


def shuffled_rows(spark, run):
    """What `run` returns, and how many rows its shuffles wrote."""

    def written():
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    return run(), written() - before


def test_ngrams_go_through_shuffles_in_packs(spark, monkeypatch):
    monkeypatch.setattr(backoff, "HELD", 3000)
    monkeypatch.setattr(backoff, "COMMON_SHARE", 50)
    r = np.random.default_rng(3)
    texts = [" ".join(map(str, r.integers(0, 60, 50))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2).cache()
    docs.count()
    got, moved = shuffled_rows(spark, lambda: backoff.backoff_scores(docs, order=2).collect())
    assert len(got) == 400 and {x["n_words"] for x in got} == {50}
    grams = collections.Counter((a, b) for t in texts for a, b in zip(t.split(), t.split()[1:]))
    counted = sum(n >= 2 for n in grams.values())
    # a few rows for each counted n-gram and each text in the joins of the tables, packs for the 39,600 n-grams
    assert moved < 8 * (counted + 60 + 400) + 3000 < 45_000, (moved, counted)


def test_orders_and_places_of_keys():
    r = np.random.default_rng(5)
    for bits, n in [(0, 0), (0, 1), (0, 5000), (7, 2), (7, 5000)]:
        key = r.integers(0, 1 << 63, n).astype(np.uint64) >> np.uint64(bits)
        key[n // 2 :] = key[: n - n // 2]
        if n > 10:
            key[:4] = key[4] ^ np.arange(4).astype(np.uint64)  # alike but for their last bits
        assert (key[backoff._rising(key, bits)] == np.sort(key)).all()
        have = np.unique(key[::3])
        at, known = backoff._places(have, key, bits), np.isin(key, have)
        assert ((at >= 0) == known).all() and (have[at[known]] == key[known]).all()
        found, times = np.unique(key, return_counts=True)
        added = backoff._added_up([(key, key, key, np.ones(n, np.int64))], 2, bits)
        assert added[0].tolist() == found[times >= 2].tolist() and added[3].tolist() == times[times >= 2].tolist()
