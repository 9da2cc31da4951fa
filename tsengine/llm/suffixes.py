"""Removal of long repeated byte strings by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

#: Bytes of the strings whose hashes choose anchors.
GRAM = 32
#: Bits of a position in a packed (hash, position) value; texts are anchored in pieces of at most that many bytes.
POSITION_BITS = 22
#: Bytes of contexts that one block of suffix sorting holds.
BLOCK = 1 << 20
#: Starts that one sort takes; a block with more goes slice by slice of distances to the anchor.
STARTS = 400_000
#: An anchor with more occurrences than this, and than one in HOT_SHARE of all, is dealt out by more than its hash; so many of
#: them at most, which bounds what is broadcast.
HOT = 2000
HOT_SHARE = 1 << 16
#: Distances to a hot anchor that stay together.
SLICE = 24
#: Bytes of texts that are anchored at a time; arrays with several words for each byte are made.
TEXT_BYTES = 1 << 19
#: Contexts that a task remembers, so that it sends a repeated one once.
CONTEXTS_REMEMBERED = 10_000
#: Words of the runs whose hashes choose the anchors of passages.
SHORT = 8
#: A perfect difference cover: every distance mod PERIOD is a difference of two of these. Fixed values.
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
PERIOD = 57

_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_in_cover = np.zeros(PERIOD, bool)
_in_cover[list(COVER)] = True


def _shifts() -> np.ndarray:
    """shift[r, s]: the least d with (r + d) and (s + d) mod PERIOD both in the cover."""
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for d in range(PERIOD - 1, -1, -1):
        at = _in_cover[(np.arange(PERIOD) + d) % PERIOD]
        out[np.ix_(at, at)] = d
    if (out < 0).any():
        raise AssertionError("not a difference cover")
    return out


SHIFT = _shifts()


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The anchors of all strings of `length` bytes inside the rows: (row, anchor hash, anchor, first start, last start), places in
    bytes of `data`, ordered by row and start. The starts of a row whose strings have one anchor in common are one entry.

    A string's anchor is the least hash of its GRAM-byte strings, the first of equal ones, so equal strings have equal anchors at
    equal places, wherever they stand.
    """
    none = np.zeros(0, np.int64)
    found = []
    sums = kernels.prefix_hashes(data)
    width = length - GRAM + 1
    low = np.uint64((1 << POSITION_BITS) - 1)
    step = (1 << POSITION_BITS) - length
    for row in np.flatnonzero(np.diff(offsets) >= length).tolist():
        a, b = int(offsets[row]), int(offsets[row + 1])
        while b - a >= length:
            stop = min(b, a + step + length - 1)
            h = kernels.windows(sums, GRAM, a, stop - GRAM + 1)
            least = window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), width)
            at = (least & low).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.concatenate([first[1:], [len(at)]]) - 1
            found.append((np.full(len(first), row), h[at[first]], at[first] + a, first + a, last + a))
            a += len(least)
    if not found:
        return none, none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def repeated_starts(text: np.ndarray, starts: np.ndarray, buckets: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of `length` bytes at `starts` occur at another of the starts.

    Suffixes cut to `length` bytes are sorted one bucket at a time: a bucket is a value of `buckets` with the first PERIOD bytes.
    Ties inside a bucket are resolved by the ranks of the cover's positions: two suffixes whose first PERIOD bytes are equal
    compare as the cover's suffixes at their common shift do. Only those, one position in seven, are sorted over their whole
    length.
    """
    n = len(starts)
    if n < 2:
        return np.zeros(n, bool)
    sums = kernels.prefix_hashes(text)
    key = kernels.mix(buckets ^ (kernels.range_hashes(sums, starts, starts + PERIOD)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(edge) - 1
    size = np.bincount(group)
    tied = size[group] > 1
    if not tied.any():
        return np.zeros(n, bool)
    order, group = order[tied], group[tied]
    p = starts[order]
    rank, common_to_next = _cover_ranks(text, p, length)
    out = np.zeros(n, bool)
    # 3-way partition of every tie group around its first element, all groups at once
    while len(p):
        first = np.concatenate([[True], group[1:] != group[:-1]])
        pivot = p[np.flatnonzero(first)][np.cumsum(first) - 1]
        d = SHIFT[p % PERIOD, pivot % PERIOD]
        a, b = rank[p + d], rank[pivot + d]
        equal = _least_between(common_to_next, a, b) >= length - d
        many = np.bincount(group, equal, minlength=group[-1] + 1) > 1
        out[order[equal & many[group]]] = True
        rest = ~equal
        side = (a > b).astype(np.int64)[rest]
        p, order, group = p[rest], order[rest], group[rest] * 2 + side
        again = np.argsort(group, kind="stable")
        p, order, group = p[again], order[again], group[again]
        if len(p):
            new = np.concatenate([[True], group[1:] != group[:-1]])
            group = np.cumsum(new) - 1
            alone = np.bincount(group)[group] == 1
            p, order, group = p[~alone], order[~alone], group[~alone]
            if len(p):
                group = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
    return out


def _cover_ranks(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of the cover's suffixes (cut to `length` bytes) that the starts can reach, by position, and a table of least common
    prefixes between neighbours in rank, for `_least_between`."""
    reach = np.zeros(len(text) + PERIOD + 1, np.int64)
    np.add.at(reach, starts, 1)
    np.add.at(reach, starts + PERIOD, -1)
    wanted = (np.cumsum(reach)[: len(text)] > 0) & _in_cover[np.arange(len(text)) % PERIOD]
    at = np.flatnonzero(wanted)
    padded = np.concatenate([text, np.zeros(length, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, length)
    order = np.argsort(np.ascontiguousarray(rows[at]).view(f"S{length}").ravel(), kind="stable") if not (text == 0).any() else np.lexsort(rows[at].T[::-1])
    at = at[order]
    shared = np.full(max(len(at) - 1, 0), length, np.int64)
    for s in range(0, len(shared), 4096):
        x, y = rows[at[s : min(s + 4096, len(at) - 1)]], rows[at[s + 1 : min(s + 4097, len(at))]]
        differ = x != y
        shared[s : s + len(x)] = np.where(differ.any(1), differ.argmax(1), length)
    rank = np.full(len(text) + PERIOD + 1, -1, np.int64)
    rank[at] = np.arange(len(at))
    table = [shared.astype(np.int16)]
    step = 1
    while 2 * step <= len(shared):
        last = table[-1]
        table.append(np.minimum(last[:-step], last[step:]))
        step *= 2
    return rank, table


def _least_between(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes of ranks a and b: the least of those between neighbours."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    out = np.full(len(a), np.iinfo(np.int16).max, np.int64)
    span = high - low
    level = np.zeros(len(a), np.int64)
    some = span > 0
    level[some] = np.floor(np.log2(span[some])).astype(np.int64)
    for k in np.unique(level[some]).tolist():
        here = some & (level == k)
        out[here] = np.minimum(table[k][low[here]], table[k][high[here] - (1 << k)])
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges [start, end); runs that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return starts[first], ends[np.concatenate([first[1:], [len(starts)]]) - 1]


def _contexts(docs: DataFrame, length: int, sent, hot) -> DataFrame:
    """One row for each context (the bytes under the strings of a repeated anchor) of a task, with the texts that hold it.

    key: what equal strings share; anchor: place of the anchor in the context; many: strings in it; twice: it occurs at several
    places of this task, so all its strings are repeats; holders: the distinct (text digest, start) pairs, as bytes.

    The key is the anchor's hash. For a hot anchor, strings are dealt by their distance to it, SLICE distances together, and the
    key is a hash of the bytes that all strings of such a slice have in common, so that no task meets all contexts of the anchor.
    """

    def run(batches):
        held: dict[bytes, list] = {}

        def flush():
            rows = list(held.values())
            held.clear()
            col = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.int32()))]
            col += [pa.array([r[5] > 1 for r in rows], pa.bool_()), pa.array([np.array(sorted(r[4]), np.int64).tobytes() for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(col, names=["key", "context", "anchor", "many", "twice", "holders"])

        def add(key: int, context: bytes, anchor: int, many: int, place: tuple[int, int]):
            name = key.to_bytes(8, "little", signed=True) + anchor.to_bytes(4, "little", signed=True) + hashlib.blake2b(context, digest_size=16).digest()
            if name in held:
                held[name][4].add(place)
                held[name][5] += 1
            else:
                held[name] = [key, context, anchor, many, {place}, 1]

        for rb in batches:
            digests = rb.column(rb.schema.get_field_index("_digest")).to_numpy()
            for lo, _, data, offsets in common.text_chunks(rb, "_text", TEXT_BYTES):
                row, key, anchor, first, last = anchors(data, offsets, length)
                keep = common.in_bloom(sent.value, key)
                row, key, anchor, first, last = (x[keep] for x in (row, key, anchor, first, last))
                raw = data.tobytes()
                for r, k, at, a, b, h in zip(row.tolist(), key.view(np.int64).tolist(), anchor.tolist(), first.tolist(), last.tolist(), np.isin(key, hot.value).tolist()):
                    digest, base = int(digests[lo + r]), int(offsets[r])
                    if not h:
                        add(k, raw[a : b + length], at - a, b - a + 1, (digest, a - base))
                        continue
                    for q in range((at - b) // SLICE, (at - a) // SLICE + 1):
                        x, y = max(a, at - q * SLICE - SLICE + 1), min(b, at - q * SLICE)
                        core = raw[at - q * SLICE : at - q * SLICE - SLICE + 1 + length]
                        own = hashlib.blake2b(core, digest_size=8, salt=q.to_bytes(4, "little")).digest()
                        add(int.from_bytes(own, "little", signed=True), raw[x : y + length], at - x, y - x + 1, (digest, x - base))
                if len(held) > CONTEXTS_REMEMBERED:
                    yield flush()
        yield flush()
        common.release()

    return docs.mapInArrow(run, "key long, context binary, anchor int, many int, twice boolean, holders binary")


def _ranges(contexts: DataFrame, length: int) -> DataFrame:
    """(digest, ranges) of the bytes under repeated strings. contexts: the rows of a key in one partition and together."""

    def block(t: pa.Table):
        texts = t.column("context").to_pylist()
        many, key, twice = t.column("many").to_numpy(), t.column("key").to_numpy().view(np.uint64), t.column("twice").to_pylist()
        base = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        n = int(many.sum())
        inside = np.arange(n) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(base[:-1], many) + inside
        away = np.repeat(t.column("anchor").to_numpy(), many) - inside
        data, hit, bucket = np.frombuffer(b"".join(texts), np.uint8), np.zeros(n, bool), np.repeat(key, many)
        # equal strings are equally far from their anchors
        order = np.argsort(away, kind="stable") if n > STARTS else np.arange(n)
        s = 0
        while s < n:
            e = n if n <= STARTS else int(np.searchsorted(away[order], away[order[min(n - 1, s + STARTS)]], side="right"))
            part = np.sort(order[s:e])
            hit[part] = repeated_starts(data, starts[part], bucket[part], length)
            s = e
        cut = np.concatenate([[0], np.cumsum(many)])
        digests, ranges = [], []
        for i, holders in enumerate(t.column("holders").to_pylist()):
            at = np.arange(many[i]) if twice[i] else np.flatnonzero(hit[cut[i] : cut[i + 1]])
            if len(at):
                s, e = merged(at, at + length)
                for digest, start in np.frombuffer(holders, np.int64).reshape(-1, 2).tolist():
                    digests.append(digest)
                    ranges.append(np.column_stack([s + start, e + start]).astype(np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(ranges, pa.binary())], names=["digest", "ranges"])

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for rb in batches:
            t = pa.Table.from_batches([rb])
            key = t.column("key").to_numpy()
            while t.num_rows:
                lengths = np.cumsum(pc.binary_length(t.column("context")).to_numpy().astype(np.int64))
                full = int(np.searchsorted(lengths, max(BLOCK - size, 1)))
                if full >= t.num_rows:
                    held.append(t)
                    size += int(lengths[-1])
                    break
                # the block is full: it ends where a key ends
                stop = full
                while stop < t.num_rows and key[stop] == (key[stop - 1] if stop else held[-1].column("key")[-1].as_py() if held else key[0]):
                    stop += 1
                if stop == t.num_rows:
                    held.append(t)
                    size += int(lengths[-1])
                    break
                if stop:
                    held.append(t.slice(0, stop))
                if held:
                    yield block(pa.concat_tables(held))
                held, size = [], 0
                t, key = t.slice(stop), key[stop:]
        if held:
            yield block(pa.concat_tables(held))
        common.release()

    return contexts.mapInArrow(run, "digest long, ranges binary")


def _word_windows(data: np.ndarray, offsets: np.ndarray, words: int):
    """For runs of `words` words of each row: (row, hash of the run, hash of its anchor). The anchor is the least of the hashes of
    its SHORT-word runs, so equal runs have equal anchors."""
    start, end, cut = kernels.word_spans(data, offsets, _blank)
    w = kernels.range_hashes(kernels.prefix_hashes(data), start, end)
    up, down = kernels._powers("up", len(w) + 1), kernels._powers("down", len(w) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)])])

    def runs(k):
        return kernels.mix((sums[k:] - sums[:-k]) * down[: len(w) - k + 1] + np.uint64(k)) if len(w) >= k else np.zeros(0, np.uint64)

    whole, least = runs(words), window_minima(runs(SHORT), words - SHORT + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(cut))
    inside = row[: len(whole)] == row[words - 1 :] if len(whole) else np.zeros(0, bool)
    return row[: len(whole)][inside], whole[inside], least[inside]


def repeated_passages(docs: DataFrame, text: str = "text", words: int = 51) -> DataFrame:
    """(digest long, n_windows long): for texts, by the xxhash64 of their bytes (null: empty), how many runs of `words` words they
    share with another row; texts without such runs are left out.

    Runs are compared by 64-bit hashes. Anchors of runs are counted over all texts; only runs under an anchor that several rows
    have are dealt by their hash, where the least and the greatest row tell whether rows differ. Words are what blanks, tabs, line
    feeds, VT, FF and CR separate. Shorter texts have no runs; every run of a repeated row is shared; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    common.tune(spark)
    folder = common.shared_dir(spark)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_digest", F.xxhash64("_text"))

    def anchors_of(batches):
        for rb in batches:
            for _, _, data, offsets in common.text_chunks(rb, "_text", TEXT_BYTES):
                row, _, least = _word_windows(data, offsets, words)
                new = np.ones(len(row), bool)  # neighbours often have one anchor in common
                new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                key, times = np.unique(least[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(times, pa.int64())], names=["key", "n"])
        common.release()

    seen = texts.select("_text").mapInArrow(anchors_of, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    sent = spark.sparkContext.broadcast(common.bloom(common.saved(seen.select("key"), f"{folder}/passage_anchors"), "key"))

    def asked_of(batches):
        for rb in batches:
            digests = rb.column(rb.schema.get_field_index("_digest")).to_numpy()
            for lo, _, data, offsets in common.text_chunks(rb, "_text", TEXT_BYTES):
                row, whole, least = _word_windows(data, offsets, words)
                keep = common.in_bloom(sent.value, least)
                yield pa.RecordBatch.from_arrays([pa.array(whole[keep].view(np.int64)), pa.array(digests[lo + row[keep]])], names=["run", "digest"])
        common.release()

    asked = common.saved(texts.mapInArrow(asked_of, "run long, digest long"), f"{folder}/passages")
    copies = texts.groupBy(F.col("_digest").alias("digest")).agg(F.count("*").alias("rows"))
    # a table of its own, so that Spark can split the rows of a passage that many texts have when the two are joined
    shared = asked.groupBy("run").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("run")
    shared = common.saved(shared, f"{folder}/passages_shared")
    between = asked.join(shared, "run").groupBy("digest").agg(F.count("*").alias("n"))
    own = asked.groupBy("digest").agg(F.count("*").alias("all"))
    found = own.join(between, "digest", "left").join(copies, "digest")
    # a repeated row shares all it has with its copies; what was asked for it counts once for each
    n = F.when(F.col("rows") > 1, F.col("all") / F.col("rows")).otherwise(F.coalesce("n", F.lit(0)))
    return common.saved(found.select("digest", n.cast("long").alias("n_windows")).filter("n_windows > 0"), f"{folder}/passage_counts")


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 400, keep=None, kept_text: str | None = None) -> DataFrame:
    """`docs` without the bytes that a repeated string of `length` bytes covers.

    Columns: n_bytes (UTF-8), n_removed, n_spans (maximal removed runs) long, kept_sha256; with `kept_text` a binary column of
    that name, the remaining bytes. A string is repeated if it starts anywhere else in the table, its own text included; strings
    never cross texts, and all are judged on the input. keep: input columns to return (default: all).

    How: every string has an anchor that depends on its bytes alone. Anchors are counted over all texts; a Bloom filter of those
    that occur twice goes to the tasks, which send only the bytes under such anchors, each distinct context of a task once.
    Contexts of one anchor meet in one task, block by block, where suffixes are sorted (see `repeated_starts`). What is repeated
    goes back by text digest; only texts with repeats are shuffled once more.

    Null is the empty text. Texts shorter than `length` keep all. Repeated rows are repeats of each other. Ids aren't used, so
    null or repeated ones do no harm. An empty table gives an empty result. Input columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    common.tune(spark)
    folder = common.shared_dir(spark)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ([kept_text] if kept_text else [])
    kept = [c for c in (keep or docs.columns) if c.lower() not in {n.lower() for n in names}]
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_digest"))

    def count(batches):
        for rb in batches:
            for _, _, data, offsets in common.text_chunks(rb, "_text", TEXT_BYTES):
                key, times = np.unique(anchors(data, offsets, length)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(times, pa.int64())], names=["key", "n"])
        common.release()

    repeated = texts.select("_text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    repeated = common.saved(repeated, f"{folder}/repeated")
    sent = spark.sparkContext.broadcast(common.bloom(repeated, "key"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    many = repeated.filter(F.col("n") > max(HOT, total // HOT_SHARE)).select("key").toArrow().column(0).to_numpy()
    hot = spark.sparkContext.broadcast(np.sort(many).view(np.uint64))
    contexts = _contexts(texts, length, sent, hot).repartition(common.partitions(spark), "key").sortWithinPartitions("key")
    ranges = common.saved(_ranges(contexts, length), f"{folder}/ranges")

    hit = spark.sparkContext.broadcast(common.bloom(ranges.select("digest").distinct(), "digest"))
    rows = docs.select(*[docs[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(kept)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_digest", F.xxhash64("_text"))
    own = [c for c in rows.columns if c.startswith("k")]
    maybe = common.append_columns(rows.select("_digest", *own, "_text"), lambda rb: [pa.array(common.in_bloom(hit.value, rb.column(0).to_numpy().view(np.uint64)))], [common.field("_hit", "boolean")])
    per_text = ranges.groupBy("digest").agg(F.collect_set("ranges").alias("_ranges"))
    touched = maybe.filter("_hit").join(per_text.withColumnRenamed("digest", "_digest"), "_digest", "left").select(*own, "_text", "_ranges")
    whole = maybe.filter("not _hit").select(*own, "_text", F.lit(None).cast("array<binary>").alias("_ranges"))

    def make(rb: pa.RecordBatch) -> list:
        n_bytes, removed, spans, digest, left = [], [], [], [], []
        for t, found in zip(common.strings(rb, "_text"), rb.column(rb.schema.get_field_index("_ranges")).to_pylist()):
            data = t.encode()
            s, e = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if found:
                s, e = merged(*np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in found]).T)
            edges = np.concatenate([[0], np.column_stack([s, e]).ravel(), [len(data)]]).reshape(-1, 2).tolist()
            rest = b"".join(data[a:b] for a, b in edges)
            n_bytes.append(len(data))
            removed.append(len(data) - len(rest))
            spans.append(len(s))
            digest.append(hashlib.sha256(rest).hexdigest())
            left.append(rest)
        out = [pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)] + [pa.array(digest, pa.string())]
        return out + ([pa.array(left, pa.binary())] if kept_text else [])

    fields = [common.field(c, "long") for c in names[:3]] + [common.field(c, "string") for c in names[3:4]] + [common.field(c, "binary") for c in names[4:]]
    done = [common.append_columns(x, make, fields, own) for x in (touched, whole)]
    return done[0].union(done[1]).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *names)
