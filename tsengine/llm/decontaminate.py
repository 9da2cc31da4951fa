"""Benchmark decontamination with an Aho-Corasick automaton over normalised test items."""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Characters of all normalised items up to which one automaton is built in each worker. Its nodes are words, one for each word
#: of each window at most, so a worker needs some hundred MB at this bound. A larger benchmark is joined by window instead.
CHARS_FOR_AUTOMATON = 4_000_000

_table = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_lower = {c: c + 32 for c in range(65, 91)}
_word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The automaton that this worker built last: (name, automaton, word numbers).
_built: list = []


def words(text: str) -> list[str]:
    """Lower-cases A-Z and takes the runs of digits, letters and characters beyond ASCII."""
    return [w for w in text.encode().translate(_table).decode().split(" ") if w]


def windows(item: list[str], size: int = WINDOW) -> list[tuple[str, ...]]:
    """Runs of `size` words of an item, or all its words where it has fewer; no words, no window."""
    return [tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))] if item else []


def automaton(items: list[tuple[str, list[str]]], size: int):
    """(automaton, number of each item word): one automaton over the windows of all items, with words as letters. Its values are
    (words of the window, items that have it)."""
    import ahocorasick

    number: dict[str, int] = {}
    of: dict[tuple, list[str]] = {}
    for i, text in items:
        for w in windows([number.setdefault(x, len(number) + 1) for x in text], size):
            of.setdefault(w, []).append(i)
    a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w, ids in of.items():
        a.add_word(w, (len(w), sorted(set(ids))))
    if of:
        a.make_automaton()
    return a, number


def _joined(docs: DataFrame, items: DataFrame, text: str, size: int) -> DataFrame:
    """`docs` with _hits (numbers of hit words, from 0) and _items, for a benchmark too large for an automaton: the windows of texts
    meet those of items in a join by their hash and are compared as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = lambda c: F.regexp_extract_all(F.translate(c, upper, lower), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    cut = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.struct(i.alias("at"), F.slice(w, i, n).alias("win")))
    of = items.select("i", split(F.col("t")).alias("w")).filter("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(size)))
    of = of.select("n", F.explode(cut(F.col("w"), F.col("n"))).alias("x"), "i").select("n", "x.win", "i").distinct()
    lengths = [r["n"] for r in of.select("n").distinct().collect()]
    keyed = docs.withColumn("_text_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    once = keyed.groupBy("_text_key").agg(F.first(text).alias("t")).select("_text_key", split(F.coalesce("t", F.lit(""))).alias("w"))
    asked = once.withColumn("n", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"))).filter("size(w) >= n")
    asked = asked.select("_text_key", "n", F.explode(cut(F.col("w"), F.col("n"))).alias("x")).select("_text_key", "n", "x.at", "x.win")
    met = asked.join(of, ["n", "win"])
    covered = met.select("_text_key", F.explode(F.sequence(F.col("at") - 1, F.col("at") + F.col("n") - 2)).alias("j"))
    hits = covered.groupBy("_text_key").agg(F.sort_array(F.collect_set("j")).alias("_hits"))
    ids = met.groupBy("_text_key").agg(F.sort_array(F.collect_set("i")).alias("_items"))
    return keyed.join(hits.join(ids, "_text_key"), "_text_key", "left").drop("_text_key")


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    keep=None,
    spans: bool = False,
) -> DataFrame:
    """`docs` with what they share with the test items.

    A window is a run of `size` item words (a shorter item is one window). One automaton over all windows scans each text once.
    Columns: n_words, n_hit (words inside any occurrence of a window), n_items (items with such windows) long, items_sha256 (of
    their ids, sorted as strings, joined by commas), contaminated boolean; with `spans` also hit_spans array<struct<begin,
    end>>, the runs of hit words as code points of the original text.
    benchmark: (item_id, text); up to CHARS_FOR_AUTOMATON characters are broadcast and built into an automaton once in each
    worker; a larger one is joined by window (`_joined`), with the same results.
    keep: input columns to return (default: all).

    Null texts and null items have no words; rows with a null item id count as the item "null". Repeated items and texts count
    as they stand (an id once). Empty tables give no hits or an empty result. Input columns named like the new ones are replaced.
    """
    import ahocorasick  # noqa: F401  fails here rather than in the tasks

    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    fields = [common.field(c, "long") for c in ("n_words", "n_hit", "n_items")] + [common.field("items_sha256", "string"), common.field("contaminated", "boolean")]
    if spans:
        fields.append(common.field("hit_spans", "array<struct<begin:int,end:int>>"))
    names = [f.name for f in fields]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    small = chars <= CHARS_FOR_AUTOMATON
    # columns by number, so that no name of the table meets one made here
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("_text"))
    own = [c for c in rows.columns if c != "_text"]
    sent = docs.sparkSession.sparkContext.broadcast([(i, words(t)) for i, t in items.collect()] if small else [])
    none, name = hashlib.sha256(b"").hexdigest(), uuid.uuid4().hex

    def scan(texts: list[list[str]]):
        """For each text's words: numbers of the hit ones, and the items found."""
        if not _built or _built[0] != name:
            _built[:] = [name, *automaton(sent.value, size)]
        _, machine, number = _built
        for w in texts:
            if not w or not number:
                yield np.zeros(0, np.int64), []
                continue
            change, ids = {}, set()
            for end, (n, which) in machine.iter(tuple(map(number.get, w, repeat(0)))):
                change[end] = max(n, change.get(end, 0))
                ids.update(which)
            cover = np.zeros(len(w) + 1, np.int64)
            for end, n in change.items():
                cover[end + 1 - n] += 1
                cover[end + 1] -= 1
            yield np.flatnonzero(np.cumsum(cover[:-1]) > 0), sorted(ids)

    def make(rb: pa.RecordBatch) -> list:
        texts = common.strings(rb, "_text")
        split = [words(t) for t in texts]
        if small:
            found = scan(split)
        else:
            told = (rb.column(rb.schema.get_field_index(c)).to_pylist() for c in ("_hits", "_items"))
            found = ((np.array(h or [], np.int64), i or []) for h, i in zip(*told))
        n_words, n_hit, n_items, digest, runs = [], [], [], [], []
        for source, w, (hit, ids) in zip(texts, split, found):
            n_words.append(len(w))
            n_hit.append(len(hit))
            n_items.append(len(ids))
            digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest() if ids else none)
            run = []
            if spans and len(hit):
                at = [m.span() for m in _word.finditer(source.translate(_lower))]
                first = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
                last = np.append(first[1:], len(hit)) - 1
                run = [{"begin": at[hit[a]][0], "end": at[hit[b]][1]} for a, b in zip(first, last)]
            runs.append(run)
        cols = [pa.array(x, pa.int64()) for x in (n_words, n_hit, n_items)] + [pa.array(digest, pa.string()), pa.array([h > 0 for h in n_hit], pa.bool_())]
        if spans:
            cols.append(pa.array(runs, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))))
        return cols

    parts = lambda rb: (rb.slice(a, b - a) for a, b, _, _ in common.text_chunks(rb, "_text"))
    asked = rows if small else _joined(rows, items, "_text", size)
    marked = common.append_columns(asked, make, fields, own, parts)
    return marked.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *names)
