"""Stupid-backoff language-model scores of documents against the n-gram counts of the whole corpus, as joins of tables."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common, kernels

BACKOFF = 0.4
#: Counting (from three words on) and looking up go over the documents so many times, each time for one slice of the n-grams'
#: keys; this bounds the disk that shuffles take at once.
COUNT_SLICES, LOOKUP_SLICES = 2, 3
#: n-grams that a task of counting holds before it adds up equal ones.
HELD = 1 << 20
#: n-grams in a bucket, about: what a task adds up or looks up at once.
BUCKET = 1 << 21
#: n-grams that make up at least this share of all words go to the tasks as a broadcast: no more than so many for each length.
COMMON_SHARE = 1 << 19
#: Slots of the tasks' table of common n-grams; of those that fall into one slot, one is kept and the others stay in the join.
SLOTS = 1 << 21
#: Bytes of text whose n-grams are made at a time; longer texts are cut between words.
TEXT_BYTES = 512 << 10

_U = np.uint64
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lowered = kernels.BYTE_VALUES[kernels.LOWER]


def gram_keys(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The key of an n-gram."""
    return kernels.mix(context * _U(0x9E3779B185EBCA87) + last)  # odd


def grams(words: np.ndarray, rows: np.ndarray, order: int):
    """(k, context, last, key, row) for k = 1 ... order: the k-grams of all rows.

    A word has context 0 and its hash as last; a longer n-gram has the key of its first n - 1 words as context and that of its
    last n - 1 as last, so both parts of it can be looked up. rows: word offsets of the rows (rows + 1 values).
    """
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    key = gram_keys(np.zeros(1, _U), words)
    yield 1, np.zeros(len(words), _U), words, key, row
    for k in range(2, order + 1):
        context, last = key[:-1], key[1:]
        inside = row[1:] == row[:-1]
        context, last, row = context[inside], last[inside], row[1:][inside]
        key = gram_keys(context, last)
        yield k, context, last, key, row


def _pieces(rb: pa.RecordBatch, order: int):
    """(first row, words, word offsets, words before which nothing is new) of runs of rows, and of parts of long rows.

    A part of a long row begins with the last order - 1 words of the part before it: an n-gram is new if its last word is.
    """
    for first, _, data, offsets in common.text_chunks(rb, "_text", TEXT_BYTES):
        if len(data) <= 2 * TEXT_BYTES:
            start, end, rows = kernels.word_spans(data, offsets, _space)
            yield first, kernels.range_hashes(kernels.prefix_hashes(data, _lowered), start, end), rows, 0
            continue
        at, tail = 0, np.zeros(0, _U)  # one row
        while at < len(data):
            stop = min(at + TEXT_BYTES, len(data))
            while stop < len(data) and not _space[data[stop]]:
                stop += 1
            part = data[at:stop]
            start, end, _ = kernels.word_spans(part, np.array([0, len(part)]), _space)
            words = np.concatenate([tail, kernels.range_hashes(kernels.prefix_hashes(part, _lowered), start, end)])
            yield first, words, np.array([0, len(words)]), len(tail)
            tail = words[len(words) - min(order - 1, len(words)) :]
            at = stop


def _new(k: int, lead: int) -> int:
    """How many k-grams of a part lie within its first `lead` words."""
    return max(0, lead - k + 1)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def _rising(key: np.ndarray, bits: int = 0) -> np.ndarray:
    """The order of keys whose leading `bits` are the same. One sort of their next bits with their places, which is a few times faster
    than argsort, leaves few keys to be put right."""
    places = _U((1 << max(1, len(key).bit_length())) - 1)
    order = (np.sort(key << _U(bits) & ~places | np.arange(len(key), dtype=_U)) & places).astype(np.int64)
    sorted_key = key[order]
    return order if (sorted_key[1:] >= sorted_key[:-1]).all() else order[np.argsort(sorted_key, kind="stable")]


def _added_up(runs: list, least: int = 1, bits: int = 0) -> list[np.ndarray]:
    """(key, context, last, n) of runs of n-grams as one, each key once and its n added up, if that is at least `least`."""
    key, context, last, n = (np.concatenate(x) for x in zip(*runs))
    order = _rising(key, bits)
    key = key[order]
    first = _starts(key)
    n = np.add.reduceat(n[order], first) if len(first) else n
    if least > 1:
        often = n >= least
        first, n = first[often], n[often]
    at = order[first]
    return [key[first], context[at], last[at], n]


def _places(have: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """The place in `have` (rising, each once) of each key, -1 if it has none; all have the same leading `bits`.

    The next bits of a key say where the few keys that share them stand.
    """
    out = np.full(len(keys), -1)
    size = min(len(have).bit_length() + 1, 63 - bits)
    near = lambda x: (x << _U(bits) >> _U(64 - size)).astype(np.int64)
    start = np.zeros((1 << size) + 1, np.int32)
    np.cumsum(np.bincount(near(have), minlength=1 << size), out=start[1:])
    slot = near(keys)
    at, stop = start[slot], start[slot + 1]
    left = np.flatnonzero(at < stop)
    at, stop, key = at[left], stop[left], keys[left]
    while len(left):
        hit = have[at] == key
        out[left[hit]] = at[hit]
        at = at + 1
        more = np.flatnonzero(~hit & (at < stop))
        left, at, stop, key = left[more], at[more], stop[more], key[more]
    return out


def _gains(digest: np.ndarray, gain: np.ndarray, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each digest once, rising, and the sum of its gains."""
    order = _rising(digest, bits)
    digest = digest[order]
    first = _starts(digest)
    return digest[first], np.add.reduceat(gain[order], first) if len(first) else gain


def _bits(spark, n: int) -> int:
    """The keys' leading bits that make up a bucket: buckets of about BUCKET of n n-grams, at least one for each shuffle partition."""
    return max(1, (max(common.partitions(spark), -(-n // BUCKET)) - 1).bit_length())


def _bucket(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> _U(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)


def _packed(bucket: np.ndarray, names: list[str], columns: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row for each bucket (each once): the bucket and, of each (values, offsets), its own values end to end."""
    cols = [pa.Array.from_buffers(pa.binary(), len(bucket), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x, at in columns]
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *cols], names=["bucket", *names])


def _unpacked(t: pa.Table, name: str, kind) -> np.ndarray:
    return common.utf8(t.column(name))[0].view(kind)


def count_table(texts: DataFrame, k: int, part: int, parts: int, least: int, bits: int) -> DataFrame:
    """(key, context, last, n): how often each k-gram of one slice of keys occurs in all of `texts` (_text), if at least `least` times.

    Tasks add up within bounded runs of texts. A run's n-grams are sorted by key, so those of a bucket (the key's leading `bits`)
    stand together and are one row of the shuffle; Spark groups the rows by bucket, and each bucket is added up.
    """

    def packed(key, context, last, n):
        bucket = _bucket(key, bits)
        first = _starts(bucket)
        at = np.append(first, len(key))
        return _packed(bucket[first], ["context", "last", "n"], [(context, at), (last, at), (n.astype(np.int32), at)])

    def count(batches):
        held, size = [], 0
        for rb in batches:
            for _, words, rows, lead in _pieces(rb, k):
                *_, (_, context, last, key, _) = grams(words, rows, k)
                at = np.flatnonzero(key[_new(k, lead) :] % _U(parts) == _U(part)) + _new(k, lead)
                held.append((key[at], context[at], last[at], np.ones(len(at), np.int64)))
                size += len(at)
                if size >= HELD:
                    held = [_added_up(held)]
                    size = len(held[0][0])
                    if 2 * size > HELD:
                        yield packed(*held[0])
                        held, size = [], 0
        if held:
            yield packed(*_added_up(held))
        common.release()

    def add_up(rows):
        context, last = _unpacked(rows, "context", _U), _unpacked(rows, "last", _U)
        often = _added_up([(gram_keys(context, last), context, last, _unpacked(rows, "n", np.int32).astype(np.int64))], least, bits)
        return pa.table([pa.array(x.view(np.int64)) for x in often], names=["key", "context", "last", "n"])

    packs = texts.select("_text").mapInArrow(count, "bucket int, context binary, last binary, n binary")
    return packs.groupBy("bucket").applyInArrow(add_up, "key long, context long, last long, n long")


def weights(counts: DataFrame, shorter: DataFrame | None, total: int, alpha: float) -> DataFrame:
    """(key, n, score, weight): what a text's score gains for each occurrence of a counted n-gram of one length.

    counts: (key, context, last, n). shorter: the weights of the n-grams with one word less; None for words.

    A word gains log10 of its count over a word that occurs once. A longer n-gram gains its own score over the score without its
    first word. The parts of a counted n-gram occur at least as often, so they are counted as well: the sum over all n-grams of a
    text is the sum over its words of the score of the longest n-gram that is counted.
    """
    if shorter is None:
        return counts.select("key", "n", F.log10(F.col("n") / F.lit(total)).alias("score"), F.log10("n").alias("weight"))
    context = shorter.select(F.col("key").alias("context"), F.col("n").alias("before"))
    last = shorter.select(F.col("key").alias("last"), F.col("score").alias("without"))
    score = F.log10(F.col("n") / F.col("before"))
    return counts.join(context.hint("shuffle_hash"), "context").join(last.hint("shuffle_hash"), "last").select("key", "n", score.alias("score"), (score - F.col("without") - F.lit(float(np.log10(alpha)))).alias("weight"))


def _tag(keys: np.ndarray) -> np.ndarray:
    """Eight bits of a key, never 0."""
    return (keys >> _U(56)).astype(np.uint8) | np.uint8(1)


def _slots(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Tables of slots for keys in falling order of their counts: of the keys of one slot the first stays, the others go to a next,
    smaller table, by other bits; so every key has a slot, and the commonest have one in the first table. A table is the keys and
    values of its slots, which slots have more keys in the next, and the tags of the keys (0: the slot is empty)."""
    out, size = [], SLOTS
    while len(keys) or not out:
        slot = (keys >> _U(8 * len(out)) & _U(size - 1)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        held, value, more, tag = np.zeros(size, _U), np.zeros(size), np.zeros(size, bool), np.zeros(size, np.uint8)
        held[slot[first]], value[slot[first]], tag[slot[first]] = keys[first], values[first], _tag(keys[first])
        rest = np.ones(len(keys), bool)
        rest[first] = False
        more[slot[rest]] = True
        out.append((held, value, more, tag))
        keys, values = keys[rest], values[rest]
        size = max(1 << 10, size // 4)
    return out


def _held(tables: list[tuple[np.ndarray, ...]], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys have a slot, their values, 0 for the others). Most keys that have none are told by the small table of tags."""
    found, gain, left = np.zeros(len(keys), bool), np.zeros(len(keys)), None
    for k, (held, value, more, tag) in enumerate(tables):
        asked = keys if left is None else keys[left]
        slot = (asked >> _U(8 * k) & _U(len(held) - 1)).astype(np.int64)
        at = np.flatnonzero(tag[slot] == _tag(asked))
        at = at[held[slot[at]] == asked[at]]
        where = at if left is None else left[at]
        found[where], gain[where] = True, value[slot[at]]
        if k + 1 < len(tables):
            next_table = np.flatnonzero(more[slot])
            left = next_table if left is None else left[next_table]
            left = left[~found[left]]
    return found, gain


def backoff_scores(docs: DataFrame, text: str = "text", id_column: str = "doc_id", order: int = 3, least: int = 2, alpha: float = BACKOFF) -> DataFrame:
    """(id, n_words long, log10_score, mean_log10_score double): one row for each row of `docs`.

    The score of a word is count(n-gram) / count(context) for its longest n-gram, up to `order` words and within its text, that
    occurs at least `least` times in all of `docs`; each word left off the n-gram costs a factor `alpha`; a word alone scores
    count / words of the corpus, with a count of 1 below `least`. log10_score is the sum of logarithms over the text,
    mean_log10_score that by n_words. Words are what blanks, tabs, line feeds, VT, FF and CR separate, A-Z lower-cased.

    How: n-grams of all texts are counted into tables by key (`count_table`), length by length and in slices of keys. Joining
    a table to the one of the next shorter n-grams gives every counted n-gram a weight (`weights`). Each text's n-grams are grouped with the
    weights by bucket of keys, and what they gain by bucket of texts. The n-grams and the gains of a bucket travel as arrays, many in a
    row; buckets become more with the words of the corpus, not larger. n-grams that are a fixed share of all words or more, a bounded
    number, are all looked up in a broadcast, so no key of a bucket holds more than that share of the rows, and the joins among tables can
    be split by Spark where a context has many n-grams.

    Null and empty texts have no words, log10_score 0 and a null mean. Repeated rows each count and get a row; null ids stay.
    Extra columns are ignored; an empty table gives an empty result. Words and n-grams are compared by 64-bit hashes. A text is
    worked on in parts of bounded size.
    """
    if order < 1 or least < 2:
        raise ValueError("order must be at least 1 and least at least 2")
    spark = docs.sparkSession
    common.tune(spark)
    folder = common.shared_dir(spark)
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_digest", F.xxhash64("_text"))

    total, levels = 0, []
    for k in range(1, order + 1):
        tables = []
        for part in range(slices := 1 if k < 3 else COUNT_SLICES):
            # all words are counted, as their sum is needed; there are few different ones in a run of texts
            counted, seen = count_table(rows, k, part, slices, least if k > 1 else 1, _bits(spark, total // slices)), Observation()
            if k == 1:
                counted = counted.observe(seen, F.sum("n").alias("words"))
            tables.append(f"{folder}/counts{k}_{part}")
            counts = common.saved(counted.filter(F.col("n") >= least), tables[-1])
            if k == 1:
                total = seen.get["words"] or 0
        counts = spark.read.schema(counts.schema).parquet(*tables)
        weighed = weights(counts, levels[-1] if levels else None, max(total, 1), alpha)
        levels.append(common.saved(weighed if k < order else weighed.drop("score"), f"{folder}/weights{k}"))
        common.removed(spark, *tables)
    weighted = functools.reduce(DataFrame.union, [x.select("key", "n", "weight") for x in levels])

    often = weighted.filter(F.col("n") * COMMON_SHARE >= max(total, 1)).orderBy(F.desc("n"), "key").select("key", "weight").toArrow()
    slots = spark.sparkContext.broadcast(_slots(often.column(0).to_numpy().view(_U), often.column(1).to_numpy()))

    def sums(batches):
        known = slots.value
        for rb in batches:
            n_words, gained = np.zeros(rb.num_rows, np.int64), np.zeros(rb.num_rows)
            for first, words, cut, lead in _pieces(rb, order):
                n_words[first : first + len(cut) - 1] += np.diff(cut) - lead
                for k, _, _, key, row in grams(words, cut, order):
                    _, gain = _held(known, key)
                    gain[: _new(k, lead)] = 0
                    gained[first : first + len(cut) - 1] += np.bincount(row, gain, minlength=len(cut) - 1)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), pa.array(n_words), pa.array(gained)], names=["_id", "_digest", "n_words", "_common"])

    schema = f"_id {docs.schema[id_column].dataType.simpleString()}, _digest long, n_words long, _common double"
    base = common.saved(rows.select("_id", "_text", "_digest").mapInArrow(sums, schema), f"{folder}/base")

    bits = _bits(spark, order * total // LOOKUP_SLICES)

    def packed(held):
        key, digest = (np.concatenate(x) for x in zip(*held))
        bucket = _bucket(key, bits)
        by_bucket = np.argsort(bucket, kind="stable")
        bucket, digest = bucket[by_bucket], digest[by_bucket]
        first = _starts(bucket)
        runs = np.union1d(first, _starts(digest))  # n-grams of one text and bucket
        at, at_run = np.append(first, len(key)), np.append(np.searchsorted(runs, first), len(runs))
        times = np.diff(np.append(runs, len(key))).astype(np.int32)
        return _packed(bucket[first], ["key", "digest", "times"], [(key[by_bucket], at), (digest[runs], at_run), (times, at_run)])

    def rare(part: int):
        def run(batches):
            known, held, size = slots.value, [], 0
            for rb in batches:
                digests = rb.column(1).to_numpy()
                for first, words, cut, lead in _pieces(rb, order):
                    for k, _, _, key, row in grams(words, cut, order):
                        key, row = key[_new(k, lead) :], row[_new(k, lead) :]
                        at = np.flatnonzero(key % _U(LOOKUP_SLICES) == _U(part))
                        at = at[~_held(known, key[at])[0]]
                        held.append((key[at], digests[first + row[at]]))
                        size += len(at)
                    if size >= HELD:
                        yield packed(held)
                        held, size = [], 0
            if held:
                yield packed(held)
            common.release()

        return run

    def gained(asked, table):
        key, digest, times = _unpacked(asked, "key", _U), _unpacked(asked, "digest", _U), _unpacked(asked, "times", np.int32)
        have, weight = table.column("key").to_numpy().view(_U), table.column("weight").to_numpy()
        gain = np.zeros(len(digest))
        if len(have) and len(key):
            rising = _rising(have, bits)
            at = _places(have[rising], key, bits)
            # place -1 is the 0 behind the weights
            gain = np.add.reduceat(np.append(weight[rising], 0)[at], np.cumsum(times) - times)
        some = np.flatnonzero(gain)
        digest, gain = _gains(digest[some], gain[some])
        bucket = _bucket(digest, bits)
        first = _starts(bucket)
        at = np.append(first, len(digest))
        return pa.Table.from_batches([_packed(bucket[first], ["digest", "gain"], [(digest, at), (gain, at)])])

    def summed(rows):
        digest, gain = _gains(_unpacked(rows, "digest", _U), _unpacked(rows, "gain", float), bits)
        return pa.table([pa.array(digest.view(np.int64)), pa.array(gain)], names=["_digest", "gain"])

    gains = []
    looked_up = weighted.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("bucket"), "key", "weight")
    for s in range(LOOKUP_SLICES):
        asked = rows.select("_text", "_digest").mapInArrow(rare(s), "bucket int, key binary, digest binary, times binary")
        # the key is unsigned in the tasks: the same slice of the table, by the remainder of an unsigned division
        table = looked_up.filter(F.pmod(F.pmod("key", F.lit(LOOKUP_SLICES)) + F.when(F.col("key") < 0, F.lit((1 << 64) % LOOKUP_SLICES)).otherwise(0), F.lit(LOOKUP_SLICES)) == s)
        found = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(gained, "bucket int, digest binary, gain binary")
        gains.append(common.saved(found.groupBy("bucket").applyInArrow(summed, "_digest long, gain double"), f"{folder}/gains{s}"))
    gain = gains[0]
    for more in gains[1:]:
        gain = gain.union(more)
    # rows of one text have been asked for together, so their gains are shared out among them
    gain = gain.groupBy("_digest").agg(F.sum("gain").alias("gain"))
    many = base.groupBy("_digest").agg(F.count("*").alias("rows"))
    shared = common.saved(many.join(gain, "_digest").select("_digest", (F.col("gain") / F.col("rows")).alias("gain")), f"{folder}/gain")
    n = F.col("n_words")
    left_off = F.when(n <= order, n * (n - 1) / 2).otherwise(order * (order - 1) / 2 + (n - order) * (order - 1))
    score = F.col("_common") + F.coalesce("gain", F.lit(0.0)) - n * F.lit(float(np.log10(max(total, 1)))) + left_off * F.lit(float(np.log10(alpha)))
    return base.join(shared, "_digest", "left").select(F.col("_id").alias(id_column), "n_words", score.alias("log10_score"), (score / F.when(n > 0, n)).alias("mean_log10_score"))
