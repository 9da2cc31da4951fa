"""An exact n-gram Jaccard self-join with size-banded tiles and bitmap signatures."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, kernels
from .components import components

#: Counters of shingle frequency; they only choose the order in which a set's shingles are tried, never the result.
COUNTERS = 1 << 20
COUNTERS_PER_ROW = 1 << 14
#: Bits of a signature.
BITS = 2048
#: Before all pairs of a tile are tried, each class asks for its best partners in the tiles of its commonest shingles: so many,
#: in so many tiles.
BEST, LARGEST = 2, 3
#: Rows of a tile beyond which it is cut into pairs of blocks.
TILE = 1024
#: Set digests that a task remembers, so that it sends the shingles of a repeated set once.
SETS_REMEMBERED = 100_000

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted by hash, end to end, and the offsets of the rows."""
    data = kernels.LOWER[data]
    start, end, rows = kernels.word_spans(data, offsets, _space)
    h, at = kernels.shingle_hashes(kernels.range_hashes(kernels.prefix_hashes(data), start, end), rows, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[at[:-1][at[:-1] < len(h)]] = True
    return h[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def set_digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit digests of the sets; equal sets have equal digests."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernels.mix(h ^ np.uint64(0xA24BAED4963EE407)))])
    return kernels.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bitmaps of BITS bits: a set's shingles hashed to bits."""
    n = len(at) - 1
    bits = np.zeros((n, BITS), np.uint8)
    bits[np.repeat(np.arange(n), np.diff(at)), (h >> np.uint64(20)).astype(np.int64) % BITS] = 1
    return np.packbits(bits, axis=1)


def pack_set(h: np.ndarray) -> bytes:
    """The first 48 bits of a set's sorted hashes as gaps, all first bytes before all second ones. Two sets of a thousand elements
    agree by chance in an element with a chance of 4e-9."""
    gaps = np.diff(h >> np.uint64(16), prepend=np.uint64(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unpack_set(b) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(6, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :6] = planes.T
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64)


def most_shared(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most elements that sets with signatures x, y and sizes n, m can share: each bit of one that the other lacks is an
    element that they don't share."""
    only_x = np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
    only_y = np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
    return np.minimum(n - only_x, m - only_y)


def may_link(shared: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n, m that share that many elements reach `percent`."""
    return shared * (100 + percent) >= percent * (n + m)


def _frequencies(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """How many sets have a shingle of each counter, over all of `docs`: COUNTERS numbers, however large the input."""
    rows = COUNTERS // COUNTERS_PER_ROW

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for rb in batches:
            for _, _, data, offsets in common.text_chunks(rb, text):
                h, _ = shingle_sets(data, offsets, k)
                total += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        blocks = np.minimum(total, (1 << 31) - 1).astype(np.int32).reshape(rows, -1)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for rb in batches:
            for block, counts in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                total[block] = total.get(block, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    found = docs.select(text).mapInArrow(count, schema).repartition(min(rows, common.partitions(docs.sparkSession)), "block").mapInArrow(add, schema).collect()
    out = np.zeros((rows, COUNTERS_PER_ROW), np.int64)
    for block, counts in found:
        out[block] = np.frombuffer(counts, np.int64)
    return np.minimum(out.ravel(), (1 << 24) - 1).astype(np.uint64)


def _catalogue(docs: DataFrame, text: str, k: int, percent: int, frequency) -> DataFrame:
    """For each document: cls (digest of its set), n (set size), and, once for each set and task, its signature and prefix: the
    rarest shingles, of which two linked sets share at least one."""

    def make(rb: pa.RecordBatch, seen: set) -> list:
        cls, sizes, sigs, prefixes = [], [], [], []
        for _, _, data, offsets in common.text_chunks(rb, text):
            h, at = shingle_sets(data, offsets, k)
            digest, n = set_digests(h, at).view(np.int64), np.diff(at)
            cls.append(digest)
            sizes.append(n)
            sig = signatures(h, at)
            order = (frequency.value[(h & np.uint64(COUNTERS - 1)).astype(np.int64)] << np.uint64(40)) | (h >> np.uint64(24))
            for i, (a, b, d) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), digest.tolist())):
                if a == b or d in seen:
                    sigs.append(None)
                    prefixes.append(None)
                    continue
                if len(seen) >= SETS_REMEMBERED:
                    seen.clear()
                seen.add(d)
                length = (b - a) - ((b - a) * percent + 99) // 100 + 1
                sigs.append(sig[i].tobytes())
                prefixes.append(h[a:b][np.argsort(order[a:b], kind="stable")[:length]].view(np.int64))
        return [pa.array(np.concatenate(cls), pa.int64()), pa.array(np.concatenate(sizes), pa.int64()), pa.array(sigs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]

    seen: set = set()
    fields = [common.field("_cls", "long"), common.field("_n", "long"), common.field("_sig", "binary"), common.field("_prefix", "array<long>")]
    return common.append_columns(docs, lambda rb: make(rb, seen), fields, [c for c in docs.columns if c != text])


def _checked(docs: DataFrame, text: str, k: int, percent: int, pairs: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """The pairs (a, b) of set digests that link: signatures first, then the sorted sets themselves."""
    side = lambda df, c, names: df.select(F.col("_cls").alias(c), *[F.col(n).alias(f"{n}_{c}") for n in names])
    near = pairs.join(side(classes, "a", ["_n", "_sig"]), "a").join(side(classes, "b", ["_n", "_sig"]), "b")

    def bound(batches):
        for rb in batches:
            if rb.num_rows:
                t = pa.Table.from_batches([rb])
                x, y = (np.frombuffer(b"".join(t.column(f"_sig_{c}").to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in "ab")
                n, m = t.column("_n_a").to_numpy(), t.column("_n_b").to_numpy()
                keep = may_link(most_shared(x, y, n, m), n, m, percent)
                yield from t.select(["a", "b"]).filter(pa.array(keep)).combine_chunks().to_batches()
        common.release()

    near = common.saved(near.mapInArrow(bound, "a long, b long"), f"{folder}/near")
    wanted = common.bloom(near.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c")
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches):
        done: set[int] = set()
        for rb in batches:
            ids, values = [], []
            for _, _, data, offsets in common.text_chunks(rb, text):
                h, at = shingle_sets(data, offsets, k)
                digest = set_digests(h, at)
                for i in np.flatnonzero(common.in_bloom(sent.value, digest) & (np.diff(at) > 0)):
                    d = int(digest[i].view(np.int64))
                    if d not in done:
                        if len(done) >= SETS_REMEMBERED:
                            done.clear()
                        done.add(d)
                        ids.append(d)
                        values.append(pack_set(h[at[i] : at[i + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], names=["_cls", "_set"])
        done.clear()
        common.release()

    # dealt by class once; both joins read that exchange
    kept = docs.select(text).mapInArrow(sets, "_cls long, _set binary").dropDuplicates(["_cls"])

    def exact(batches):
        for rb in batches:
            keep = []
            for x, y in zip(rb.column(rb.schema.get_field_index("_set_a")), rb.column(rb.schema.get_field_index("_set_b"))):
                x, y = unpack_set(x.as_buffer()), unpack_set(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield from pa.Table.from_batches([rb]).select(["a", "b"]).filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches()

    both = near.join(side(kept, "b", ["_set"]), "b").join(side(kept, "a", ["_set"]), "a")
    return common.saved(both.select("a", "b", "_set_a", "_set_b").mapInArrow(exact, "a long, b long"), f"{folder}/links")


def _tile_pairs(tiles: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs of a tile's rows that are of different components and pass the signature bound; repeats within a task left out.

    tiles: key, band, i, j, home, block, asks, _cls, _n, _comp, _sig, the rows of a tile in one partition and together. best: only
    rows that ask look for partners, and take so many with the highest bound.
    """

    def run(batches):
        sent: set[tuple[int, int]] = set()
        rest = None
        names = ["key", "band", "i", "j", "home", "block", "asks", "_cls", "_n", "_comp", "_sig"]

        def pairs(t: pa.Table):
            col = {c: t.column(c).to_numpy() for c in names[:-1]}
            sig = np.frombuffer(b"".join(t.column("_sig").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            change = np.flatnonzero(np.any([col[c][1:] != col[c][:-1] for c in names[:4]], axis=0)) + 1
            out_a, out_b = [], []
            for s, e in zip([0, *change.tolist()], [*change.tolist(), t.num_rows]):
                for at in range(s, e):  # one row against the others: memory stays in proportion to the tile
                    if best and not col["asks"][at]:
                        continue
                    other = np.arange(s if best else at + 1, e)
                    o = col["_comp"][other] != col["_comp"][at]
                    o &= col["home"][other] | col["home"][at]
                    if col["i"][s] != col["j"][s]:  # a pair of blocks: rows of one against rows of the other
                        o &= col["block"][other] != col["block"][at]
                    n, m = col["_n"][at], col["_n"][other]
                    o &= np.minimum(n, m) * 100 >= percent * np.maximum(n, m)
                    other = other[o]
                    if not len(other):
                        continue
                    m = col["_n"][other]
                    shared = most_shared(sig[at : at + 1], sig[other], n, m)
                    fit = may_link(shared, n, m, percent)
                    if best and fit.sum() > best:
                        fit = np.argsort(np.where(fit, shared / (n + m), -1), kind="stable")[-best:]
                    a = int(col["_cls"][at])
                    for b in col["_cls"][other[fit]].tolist():
                        pair = (min(a, b), max(a, b))
                        if pair not in sent:
                            if len(sent) > SETS_REMEMBERED:
                                sent.clear()
                            sent.add(pair)
                            out_a.append(pair[0])
                            out_b.append(pair[1])
            return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

        for rb in batches:
            t = pa.Table.from_batches([rb]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([rb])]).combine_chunks()
            if not t.num_rows:
                continue
            last = [t.column(c)[-1].as_py() for c in names[:4]]
            same = np.all([t.column(c).to_numpy() == v for c, v in zip(names[:4], last)], axis=0)
            cut = t.num_rows - int(same.sum())
            if cut:
                yield pairs(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield pairs(rest)
        rest = None
        common.release()

    return tiles.mapInArrow(run, "a long, b long")


def _tiles(shared: DataFrame, joined: DataFrame, classes: DataFrame, partitions: int, asked: bool) -> DataFrame:
    """The tiles with rows of several components: the rows of one shingle in a band of sizes (home) and in the band above it;
    tiles of many rows as pairs of blocks. asks: a row of one of its class's commonest shingles. asked: only tiles with
    rows that ask."""
    labels = joined.withColumnRenamed("node", "_cls")
    tiles = shared.join(labels, "_cls", "left").withColumn("_comp", F.coalesce("label", "_cls"))
    seats = F.explode(F.array(F.struct(F.col("band"), F.lit(True).alias("home")), F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("home")))).alias("seat")
    tiles = tiles.select("key", seats, "_cls", "_n", "_comp", "asks").select("key", "seat.*", "_cls", "_n", "_comp", "asks")
    tile = Window.partitionBy("key", "band")
    tiles = tiles.withColumns({"lo": F.min("_comp").over(tile), "hi": F.max("_comp").over(tile), "homes": F.max("home").over(tile), "rows": F.count("*").over(tile), "some": F.max("asks").over(tile)})
    tiles = tiles.filter("lo <> hi and homes and some" if asked else "lo <> hi and homes")
    tiles = tiles.withColumn("blocks", F.ceil(F.col("rows") / TILE).cast("int")).withColumn("block", F.pmod(F.xxhash64("_cls"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("key", "band", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "home", "block", "asks", "_cls", "_n", "_comp")
    return tiles.join(classes.select("_cls", "_sig"), "_cls").repartition(partitions, "key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j")


def jaccard_components(docs: DataFrame, text: str = "text", id_column: str = "doc_id", k: int = 5, percent: int = 80, row_keys: bool = False) -> DataFrame:
    """(id, n_shingles long, component_id): one row for each row of `docs`, under the name of `id_column`.

    row_keys: also text_key long, the xxhash64 of the text, and first boolean: whether the row's id (nulls last) and text_key are
    the least of its component, true without words. Components are told apart by their links here, not by component_id, which
    two may share if an id occurs with several texts.

    A text's set is its distinct runs of k words (the whole sequence if it has fewer; none without words), words being what
    blanks, tabs, line feeds, VT, FF and CR separate, A-Z lower-cased. Two texts link when 100 * intersection >= percent *
    union; component_id is the smallest id that links reach.

    How: equal sets become one class. Each class sends its rarest shingles (a prefix of which linked sets share one), ordered by
    frequency over all texts, so common passages draw no candidates. Rows of one shingle and one band of sizes form a tile.
    First a tile only tries each class with its first, then each class asks for its best partners by signature in the tiles of
    its commonest shingles; links found there join what is alike, and then only rows of different components are compared:
    bitmaps bound the overlap, the sorted sets decide. A tile of many rows is cut into pairs of blocks. So no group of similar
    texts emits all its pairs, and none is met by one task whole.

    Null and empty texts have an empty set and are linked with nothing; null ids stay and are never chosen as a component's id
    unless it has no other. Repeated rows each get a row; ids that occur with several texts link all of them only through their
    sets. Extra columns are ignored. An empty table gives an empty result. Digests of sets and shingles have 64 bits, of which the last
    comparison of two sets uses 48.
    """
    spark = docs.sparkSession
    common.tune(spark)
    folder = common.shared_dir(spark)
    docs = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"), *([F.xxhash64(F.col(text)).alias("_key")] if row_keys else []))
    frequency = spark.sparkContext.broadcast(_frequencies(docs, "_text", k))
    catalogue = common.saved(_catalogue(docs, "_text", k, percent, frequency), f"{folder}/catalogue")
    classes = catalogue.filter("_sig is not null").select("_cls", "_n", "_sig").dropDuplicates(["_cls"])
    band = F.floor(F.log(F.col("_n").cast("double")) / math.log(100 / (percent - 0.01))).cast("int")

    by_key, in_order = Window.partitionBy("key"), Window.partitionBy("key").orderBy("_n", "_cls")
    rows = catalogue.filter("_prefix is not null").select(F.posexplode("_prefix").alias("pos", "key"), "_cls", "_n", (F.col("pos") >= F.size("_prefix") - LARGEST).alias("asks"))
    rows = rows.withColumns({"again": F.lag("_cls").over(in_order) == F.col("_cls"), "lo": F.min("_cls").over(by_key), "hi": F.max("_cls").over(by_key)})
    rows = rows.filter("lo <> hi and not coalesce(again, false)").select("key", "_cls", "_n", band.alias("band"), "asks")
    shared = common.saved(rows, f"{folder}/shared")

    leader = F.first(F.struct("_cls", "_n")).over(Window.partitionBy("key", "band").orderBy("_n", "_cls"))
    tried = shared.select("_cls", "_n", leader.alias("o")).filter(f"o._cls <> _cls and least(_n, o._n) * 100 >= {percent} * greatest(_n, o._n)")
    tried = tried.select(F.least("_cls", "o._cls").alias("a"), F.greatest("_cls", "o._cls").alias("b")).distinct()
    links = _checked(docs, "_text", k, percent, tried, classes, f"{folder}/first")
    joined = components(links, f"{folder}/merged")

    tried = common.saved(tried, f"{folder}/tried")
    for step, best in enumerate((BEST, None)):
        tiles = _tiles(shared, joined, classes, common.partitions(spark), best is not None)
        more = _tile_pairs(tiles, percent, best).distinct().join(tried, ["a", "b"], "left_anti")
        more = common.saved(more, f"{folder}/more{step}")
        if not more.isEmpty():
            links = links.union(_checked(docs, "_text", k, percent, more, classes, f"{folder}/checked{step}"))
            joined = components(links, f"{folder}/components{step}")
            tried = tried.union(more)

    keys = ["_key"] if row_keys else []
    members = catalogue.select("_id", "_n", "_cls", *keys).join(joined.withColumnRenamed("node", "_cls"), "_cls", "left").withColumn("label", F.coalesce("label", "_cls"))
    row = F.struct(F.col("_id").isNull().alias("none"), "_id", *keys)
    least = members.filter("_n > 0").groupBy("label").agg((F.min(row) if row_keys else F.struct(F.min("_id").alias("_id"))).alias("least"))
    more = lambda first: [F.col("_key").alias("text_key"), first.alias("first")] if row_keys else []
    linked = members.filter("_n > 0").join(least, "label").select("_id", "_n", F.col("least._id").alias("component_id"), *more(row == F.col("least")))
    alone = members.filter("_n = 0").select("_id", "_n", F.col("_id").alias("component_id"), *more(F.lit(True)))
    return linked.union(alone).withColumnsRenamed({"_id": id_column, "_n": "n_shingles"})
