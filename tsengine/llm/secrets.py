"""Secret scans: fixed patterns, and character Markov models for strings that no pattern names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "markov")
#: What the Markov models read; any other character ends a candidate.
ALPHABET = string.ascii_letters + string.digits + "+/_="
SHORTEST_CANDIDATE = 16
#: Of the ordinary identifiers held out of training, at most this share may reach the threshold.
FALSE_SHARE = 1e-3
#: Cells of the histogram of mean ratios, from -LIMIT to LIMIT, from which the threshold is chosen.
CELLS, LIMIT = 4000, 10.0

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_keyword = ("password", "passwd", "secret", "token", "apikey", "api_key")
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{24,}")
_candidate = re.compile(r"[A-Za-z0-9+/_=]{%d,}" % SHORTEST_CANDIDATE)
_word = re.compile(r"[A-Za-z0-9+/_=]{8,}")
_code = np.zeros(128, np.int64)
for _i, _c in enumerate(ALPHABET):
    _code[ord(_c)] = _i + 1
N = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, code points, ordered by start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _keyword):
        out += [(m.start(), m.end(), 0) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _hex.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _pairs(strings: list[str]) -> np.ndarray:
    """Counts of neighbouring characters, each string led by a start mark."""
    if not strings:
        return np.zeros((N, N), np.int64)
    a = _code[np.frombuffer(("\0" + "\0".join(strings)).encode("ascii"), np.uint8)]
    keep = a[1:] > 0
    return np.bincount(a[:-1][keep] * N + a[1:][keep], minlength=N * N).reshape(N, N)


def random_strings(n: int = 600, seed: int = 11) -> list[str]:
    """Labelled samples of the random class by rule: hex, base-36 upper case and base-62 strings of 16 to 48 characters."""
    r = random.Random(seed)
    sets = ("0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/")
    return ["".join(r.choices(sets[i % 4], k=r.randint(16, 48))) for i in range(n)]


def markov_ratios(random_pairs: np.ndarray, ordinary_pairs: np.ndarray) -> np.ndarray:
    """log P(next | previous) of the random class less that of the ordinary class; counts are smoothed by 0.5."""

    def log_p(c):
        c = c[:, 1:] + 0.5
        return np.log(c / c.sum(1, keepdims=True))

    return np.hstack([np.zeros((N, 1)), log_p(random_pairs) - log_p(ordinary_pairs)])


class Models(NamedTuple):
    """What `train_secret_models` finds: the table of ratios, the threshold of their mean, and on samples held out of training the
    share of random strings that reach it and of ordinary identifiers that do."""

    ratios: np.ndarray
    threshold: float
    recall: float
    false_share: float


def _samples(text: str) -> tuple[list[str], list[str]]:
    """(ordinary identifiers, random strings) of a text: runs of 8 and more characters of the alphabet outside the fixed
    patterns, and the values that those patterns find."""
    ordinary, found, at = [], [], 0
    for start, end, kind in base_spans(text):
        value = text[start:end]
        found += _candidate.findall(_assign.match(value).group(2) if kind == 0 else value)
        ordinary += _word.findall(text, at, start) if start > at else ()
        at = max(at, end)
    return ordinary + _word.findall(text, at), found


def _held_out(strings: list[str]) -> list[bool]:
    """One sample in five, by its own hash, is held out: equal samples are on one side."""
    return [zlib.crc32(s.encode()) % 5 == 0 for s in strings]


def _means(strings: list[str], ratios: np.ndarray) -> np.ndarray:
    out = np.zeros(len(strings))
    for i, s in enumerate(strings):
        a = _code[np.frombuffer(("\0" + s).encode("ascii"), np.uint8)]
        out[i] = ratios[a[:-1], a[1:]].mean()
    return out


def _cells(means: np.ndarray) -> np.ndarray:
    at = np.clip((means + LIMIT) / (2 * LIMIT) * CELLS, 0, CELLS - 1).astype(np.int64)
    return np.bincount(at, minlength=CELLS)


def train_secret_models(docs: DataFrame, text: str = "text", false_share: float = FALSE_SHARE) -> Models:
    """Two character models, trained over all of `docs`, and the threshold between them.

    Labelled samples: the values that the fixed patterns find, with strings random by rule, are the random class; other runs of
    the alphabet's characters are ordinary identifiers. One distinct sample in five, by hash, is held out. Tasks count pairs of
    characters of the others, and only those sums (alphabet squared) reach the driver. The threshold is the least that at most
    `false_share` of the held-out ordinary identifiers of a candidate's length reach, and that lies above 0, where both classes
    are as likely; a second pass makes the histogram of their means, of a fixed number of cells.

    Without ordinary identifiers, as in an empty table, the smoothing leaves that class uniform and the threshold is 0.
    """
    common.tune(docs.sparkSession)

    def table(df: DataFrame, make, size: int) -> np.ndarray:
        """The sum over all texts of the arrays that make(texts) gives."""

        def run(batches):
            total = np.zeros(size, np.int64)
            for rb in batches:
                total += make(common.strings(rb, text))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "n"])

        out = np.zeros(size)
        for cell, n in df.select(text).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[cell] = n
        return out

    def count(texts):
        total = np.zeros((2, N, N), np.int64)
        for k, strings in enumerate(map(list, map(chain.from_iterable, zip(*map(_samples, texts))))):
            total[k] += _pairs([s for s, out in zip(strings, _held_out(strings)) if not out])
        return total.ravel()

    ordinary, found = table(docs, count, 2 * N * N).reshape(2, N, N)
    made = random_strings()
    out = _held_out(made)
    ratios = markov_ratios(found + _pairs([s for s, o in zip(made, out) if not o]), ordinary)

    def measure(texts):
        kept = [[s for s in strings if len(s) >= SHORTEST_CANDIDATE] for strings in map(chain.from_iterable, zip(*map(_samples, texts)))]
        return np.concatenate([_cells(_means([s for s, o in zip(k, _held_out(k)) if o], ratios)) for k in kept])

    seen, right = table(docs, measure, 2 * CELLS).reshape(2, CELLS)
    right = right + _cells(_means([s for s, o in zip(made, out) if o], ratios))
    above = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0)
    share = above(seen) / max(seen.sum(), 1)
    cell = max(int(np.argmax(share <= false_share)), CELLS // 2)
    return Models(ratios, cell / CELLS * 2 * LIMIT - LIMIT, float(above(right)[cell] / max(right.sum(), 1)), float(share[cell]))


def markov_spans(text: str, models: Models, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates outside the `taken` spans whose mean log-likelihood ratio reaches the threshold."""
    out = []
    for m in _candidate.finditer(text):
        start, end = m.span()
        if any(s < end and start < e for s, e, _ in taken):
            continue
        if _means([m.group()], models.ratios)[0] >= models.threshold:
            out.append((start, end, 3))
    return out


def _shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, models: Models, text: str = "text", keep=None, redact: str | None = None) -> DataFrame:
    """`docs` with the secrets of every whole text.

    Columns: n_assign, n_access, n_hex, n_markov long; base_sha256, the SHA-256 of the spans of the fixed patterns; spans, all
    spans as kind:start:end (code points, end exclusive) by start and kind, joined by commas. redact: also `redacted`, the text
    with every span replaced by this string (overlapping spans as one).
    models: from `train_secret_models`. keep: input columns to return (default: all).

    Null is the empty text, without spans. Works row by row: repeated rows and ties keep their place and an empty table gives
    an empty result; texts are read whole. Input columns named like the new ones are replaced.
    """
    if not math.isfinite(float(np.abs(models.ratios).sum())):
        raise ValueError("ratios must be finite")
    fields = [common.field(f"n_{k}", "long") for k in KINDS] + [common.field("base_sha256", "string"), common.field("spans", "string")]
    if redact is not None:
        fields.append(common.field("redacted", "string"))

    def make(rb: pa.RecordBatch) -> list:
        counts, digests, shown, clean = [], [], [], []
        for t in common.strings(rb, text):
            base = base_spans(t)
            more = markov_spans(t, models, base)
            spans = sorted(base + more, key=lambda s: (s[0], s[2]))
            counts.append(np.bincount([s[2] for s in spans], minlength=4) if spans else np.zeros(4, np.int64))
            digests.append(hashlib.sha256(_shown(base).encode()).hexdigest())
            shown.append(_shown(spans))
            if redact is not None:
                parts, at = [], 0
                for start, end, _ in spans:
                    if start >= at:
                        parts += [t[at:start], redact]
                    at = max(at, end)
                clean.append("".join(parts) + t[at:] if spans else t)
        n = np.array(counts, np.int64).reshape(-1, 4)
        cols = [pa.array(n[:, k], pa.int64()) for k in range(4)] + [pa.array(digests, pa.string()), pa.array(shown, pa.string())]
        return cols + ([pa.array(clean, pa.string())] if redact is not None else [])

    return common.append_columns(docs, make, fields, keep)
