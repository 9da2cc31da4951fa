"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

#: Features: statistics, their buckets, and hashed words.
HASHED = 1 << 15
RANK = 8
#: Labelled rows of which a model is fitted at most: those with the smallest hash of their id.
LABELLED_ROWS = 8000
#: Bytes of their texts at most.
LABELLED_BYTES = 256 << 20
THRESHOLD = 0.3

# Byte classes whose shares are statistics, and the edges of the buckets of a share.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b".,;:", b"!?", b"|", b"$%&*#@^~", b"<>{}[]()/\\=_"]
_EDGES = np.array([0.0005, 0.005, 0.02, 0.05, 0.1, 0.25, 0.5])
_class_of = np.full(256, len(_CLASSES), np.int64)
for _k, _c in enumerate(_CLASSES):
    _class_of[list(_c)] = _k
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_line = np.zeros(256, bool)
_line[10] = True
_alnum = np.zeros(256, bool)
_alnum[48:58] = _alnum[65:91] = _alnum[97:123] = _alnum[128:] = True
STATS = len(_CLASSES) + 1 + 7
BUCKETS = len(_EDGES) + 1


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distinct values of each row; rows: offsets."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=len(rows) - 1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, values, offsets of the rows in them) of whole texts. Every row has its statistics, so none is empty."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row * (len(_CLASSES) + 1) + _class_of[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)
    start, end, words = kernels.word_spans(data, offsets, _blank)
    low = kernels.LOWER[data]
    sums = kernels.prefix_hashes(low)
    h = kernels.range_hashes(sums, start, end)
    n_words = np.diff(words)
    first, last, lines = kernels.word_spans(data, offsets, _line)
    n_lines = np.diff(lines)
    odd = ~_alnum[data[end - 1]] if len(end) else np.zeros(0, bool)
    long_end = odd & (end - start > 2)
    long_end[long_end] &= ~_alnum[data[end[long_end] - 2]]
    per_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[words])
    stats = np.column_stack([
        _share(counts, size[:, None]),
        np.log1p(size) / 14,
        np.log1p(n_words) / 12,
        np.log1p(n_lines) / 10,
        _share(per_row(end - start), n_words) / 20,
        _share(per_row(long_end), n_words),
        1 - _share(_distinct(h, words), n_words),
        1 - _share(_distinct(kernels.range_hashes(sums, first, last), lines), n_lines),
    ])
    stats = np.minimum(stats, 1.0)
    ids = np.arange(STATS)[None, :] * np.ones((n, 1), np.int64)
    buckets = STATS + np.arange(STATS) * BUCKETS + np.searchsorted(_EDGES, stats, side="right")
    base = STATS * (1 + BUCKETS)
    word_row = np.repeat(np.arange(n), n_words)
    key, times = np.unique(word_row * HASHED + (h % np.uint64(HASHED)).astype(np.int64), return_counts=True)
    word_row, word = key // HASHED, key % HASHED
    weight = 1 + np.log(times)
    norm = np.sqrt(np.bincount(word_row, weight * weight, minlength=n))
    row = np.concatenate([np.repeat(np.arange(n), STATS), np.repeat(np.arange(n), STATS), word_row])
    fid = np.concatenate([ids.ravel(), buckets.ravel(), base + word])
    value = np.concatenate([stats.ravel(), np.full(n * STATS, 0.25), weight / norm[word_row]])
    order = np.argsort(row, kind="stable")
    return fid[order], value[order].astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])


SIZE = STATS * (1 + BUCKETS) + HASHED


class Model:
    """bias + sum of w_i x_i + 1/2 sum over factors of ((sum of v_if x_i)^2 - sum of (v_if x_i)^2)."""

    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights = bias, weights  # weights: SIZE x (1 + RANK)

    def raw(self, fid: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = self.weights[fid] * value[:, None]
        total = np.add.reduceat(t, at[:-1], axis=0)
        squares = np.add.reduceat(t[:, 1:] ** 2, at[:-1], axis=0)
        return self.bias + total[:, 0] + 0.5 * (total[:, 1:] ** 2 - squares).sum(1), total[:, 1:], t[:, 1:]

    def score(self, fid, value, at) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(fid, value, at)[0].astype(float), -30, 30)))


def fit(fid: np.ndarray, value: np.ndarray, at: np.ndarray, label: np.ndarray, steps: int = 700, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Model:
    """Logistic loss, about `steps` minibatches, each step scaled by the root of summed squared gradients. Without rows, a model
    that scores 0.5."""
    r = np.random.default_rng(seed)
    weights = np.zeros((SIZE, 1 + RANK), np.float32)
    if not len(label):
        return Model(0.0, weights)
    weights[:, 1:] = r.normal(0, 0.02, (SIZE, RANK))
    share = np.clip(label.mean(), 0.01, 0.99)
    model = Model(float(np.log(share / (1 - share))), weights)
    past, past_bias = np.full_like(weights, 1e-3), 1e-3
    for _ in range(-(-steps * batch // len(label))):
        order = r.permutation(len(label))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            length = at[rows + 1] - at[rows]
            here = np.concatenate([[0], np.cumsum(length)])
            take = np.repeat(at[rows] - here[:-1], length) + np.arange(here[-1])
            f, x = fid[take], value[take]
            out, total, vx = model.raw(f, x, here)
            error = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[rows]) / len(rows)).astype(np.float32)
            e = np.repeat(error, length)
            grad = np.empty((len(f), 1 + RANK), np.float32)
            grad[:, 0] = e * x
            grad[:, 1:] = (e * x)[:, None] * (np.repeat(total, length, axis=0) - vx)
            used, where = np.unique(f, return_inverse=True)
            g = np.zeros((len(used), 1 + RANK), np.float32)
            np.add.at(g, where, grad)
            g += decay * weights[used]
            past[used] += g * g
            weights[used] -= rate * g / np.sqrt(past[used])
            past_bias += float(error.sum()) ** 2
            model.bias -= rate * float(error.sum()) / past_bias**0.5
    return model


def train_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "quality", most_rows: int = LABELLED_ROWS, most_bytes: int = LABELLED_BYTES) -> Model:
    """A model fitted on at most `most_rows` labelled rows, of `most_bytes` of text together, whose crc32(id as text) mod 5 is not 0.

    The sample is those with the smallest hash of their id; the ids (bounded by most_rows) are broadcast. An id with several
    texts counts once, with the text of the least hash, and of these texts those with the smallest hashes are taken as long as they
    stay within most_bytes, so the features that reach the driver are bounded whatever ids repeat and however long texts are.
    Rows with a null id, null label or without document are left out; an id with several labels counts once, with the smallest.
    Labels, language, source and id are no features.
    """
    common.tune(docs.sparkSession)
    known = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("double").alias("_label")).filter("_id is not null and _label is not null and crc32(cast(_id as string)) % 5 <> 0")
    chosen = known.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)

    def make(batches):
        for rb in batches:
            for a, b, data, offsets in common.text_chunks(rb, "_text"):
                fid, value, at = features(data, offsets)
                cut = pa.array(at, pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(fid.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value))]
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, b - a), rb.column(1).slice(a, b - a), *lists], names=["o", "label", "f", "x"])

    texts = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id").withColumn("o", F.xxhash64("_id", "_text"))
    one = texts.groupBy("_id").agg(F.min(F.struct("o", "_text")).alias("m"), F.min("_label").alias("_label")).select("m.o", "_label", "m._text")
    one = common.saved(one, common.shared_dir(docs.sparkSession))
    size = sorted(tuple(r) for r in one.select("o", F.octet_length("_text")).collect())  # at most most_rows rows of two numbers
    within = int(np.searchsorted(np.cumsum([n for _, n in size]), most_bytes, side="right"))
    found = one.filter(F.col("o") <= F.lit(size[within - 1][0])) if within else one.limit(0)
    t = found.mapInArrow(make, "o long, label double, f array<int>, x array<float>").toArrow().sort_by("o").combine_chunks()
    if not t.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0))
    lists = [t.column(c).combine_chunks() for c in ("f", "x")]
    at = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())])
    return fit(lists[0].flatten().to_numpy().astype(np.int64), lists[1].flatten().to_numpy(), at, t.column("label").to_numpy())


def score_quality(docs: DataFrame, model: Model, text: str = "text", id_column: str = "doc_id", threshold: float = THRESHOLD, keep=None) -> DataFrame:
    """`docs` with held_out boolean (crc32(id as text) mod 5 is 0: never learnt from), score double and predicted int (1: score
    >= threshold).

    Works row by row without a shuffle. Null is the empty text, scored by its statistics; a null id isn't held out. Repeated
    rows get equal scores; an empty table gives an empty result. Input columns named like the new ones are replaced.
    keep: input columns to return (default: all).
    """
    names = ("held_out", "score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(rb: pa.RecordBatch) -> list:
        out = [sent.value.score(*features(data, offsets)) for _, _, data, offsets in common.text_chunks(rb, text)]
        score = np.concatenate(out)
        return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]

    base = common.without(docs, names)
    scored = common.append_columns(base, make, [common.field("score", "double"), common.field("predicted", "int")], sorted({*(keep or base.columns), id_column}, key=base.columns.index))
    held = F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))
    return scored.withColumn("held_out", held).select(*(keep or base.columns), *names)
