"""Merkle manifest of a dataset: one tree a group, one over the groups' roots, and a proof for every row."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Nodes that share a parent.
ARITY = 3
#: Leaves of one range of the sorted table; their digests are the only thing that a task holds of them.
LEAVES_PER_RANGE = 500_000
ROWS_OUT = 2000

PROOF = "array<struct<left:string,right:string>>"
_ITEMS = "kind string, part int, g string, lo long, n long, level int, idx long, digest string"


def joined_digest(digests: list[str]) -> str:
    """The digest of a node: SHA-256 of its children's digests as hex text, end to end."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def record_digest(*columns: str | Column) -> Column:
    """SHA-256 (lowercase hex) of a row's fields: `-` for null, else the UTF-8 byte count, `:` and the value as text."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def level_sizes(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves, leaves first."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def _runs(column: pa.Array):
    """(value, first row, row after the last) of the runs of equal values; nulls equal each other."""
    if not len(column):
        return
    encoded = pc.run_end_encode(column)
    ends = encoded.run_ends.to_numpy()
    yield from zip(encoded.values.to_pylist(), [0, *ends[:-1].tolist()], ends.tolist())


def _segments(batches, column: str):
    """(value, list of Arrow batches) of the runs of a column over batches in order."""
    value, held = None, []
    for rb in batches:
        for v, a, b in _runs(rb.column(rb.schema.get_field_index(column))):
            if held and v != value:
                yield value, held
                held = []
            value = v
            held.append(rb.slice(a, b - a))
    if held:
        yield value, held


def _placed(leaves: DataFrame) -> DataFrame:
    """`leaves` (row, g, o, leaf) range-sorted by group, order and digest, in ranges of bounded size.

    A random number written with each row is the last key of the ranges, so rows that are equal in all else are dealt out too;
    being equal, it doesn't matter which of them stands first. The checkpoint keeps ranges and their order.
    """
    spark = leaves.sparkSession
    common.tune(spark)
    keyed = common.saved(leaves.withColumn("salt", F.rand(7)), common.shared_dir(spark))
    ranges = max(common.partitions(spark), -(-keyed.count() // LEAVES_PER_RANGE))
    keys = ["g", "o", "leaf", "salt"]
    return keyed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("salt").checkpoint()


def _offsets(placed: DataFrame) -> tuple[dict[int, int], dict[int, int], dict[int, int], int]:
    """What a range must know of others: leaves of its first group that stand before it, leaves of its first and of its last group
    altogether, each by the range's number; and the most leaves of a range. One row a range comes to the driver."""

    def count(batches):
        first = last = None
        runs = 0
        for value, held in _segments(batches, "g"):
            n = sum(rb.num_rows for rb in held)
            runs += 1
            first = first or (value, n)
            last = (value, n)
        if first:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first[0]], pa.string()), "n_first": [first[1]], "last": pa.array([last[0]], pa.string()), "n_last": [last[1]], "runs": [runs]})

    rows = placed.select("g").mapInArrow(count, "part int, first string, n_first long, last string, n_last long, runs long").collect()
    before, of_first, of_last, open_group = {}, {}, {}, None  # open_group: (value, leaves so far, ranges whose last group it is)
    for r in sorted(rows, key=lambda r: r["part"]):
        p = r["part"]
        if open_group and open_group[0] == (r["first"],):
            before[p] = open_group[1]
        else:
            open_group, before[p] = ((r["first"],), 0, []), 0
        value, n, waiting = open_group
        n += r["n_first"]
        waiting.append((of_first, p))
        if r["runs"] > 1:
            for known, q in waiting:
                known[q] = n
            value, n, waiting = (r["last"],), r["n_last"], []
        waiting.append((of_last, p))
        open_group = (value, n, waiting)
        for known, q in waiting:  # as far as is known; later ranges of the group put it right
            known[q] = n
    return before, of_first, of_last, max((r["n_first"] + r["n_last"] for r in rows), default=1)


def _local(placed: DataFrame, known) -> DataFrame:
    """Of every stretch of a group in a range: a `seg` row; the `root` where the group is whole there; else the `node`s whose
    parents need other ranges, and a `want` for each sibling of its own paths that other ranges hold."""
    before, of_first, of_last = known

    def build(batches):
        part = TaskContext.get().partitionId()
        stretches = _segments(batches, "g")
        this = next(stretches, None)
        first = True
        while this:
            following = next(stretches, None)
            g, held = this
            leaves = list(itertools.chain.from_iterable(rb.column(rb.schema.get_field_index("leaf")).to_pylist() for rb in held))
            lo = before[part] if first else 0
            n = of_first[part] if first else of_last[part] if not following else len(leaves)
            rows = list(_stretch(leaves, lo, n))
            columns = [[part] * len(rows), [g] * len(rows), [lo] * len(rows), [n] * len(rows)]
            kind, level, idx, digest = zip(*rows)
            yield _items(kind, *columns, level, idx, digest)
            this, first = following, False

    return placed.select("g", "leaf").mapInArrow(build, _ITEMS)


def _items(kind, part, g, lo, n, level, idx, digest) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip((kind, part, g, lo, n, level, idx, digest), types)], names=[f.split()[0] for f in _ITEMS.split(", ")])


def _stretch(nodes: list[str], lo: int, n: int):
    """(kind, level, idx, digest) of the leaves [lo, lo + len(nodes)) of a tree of n."""
    sizes, hi = level_sizes(n), lo + len(nodes)
    yield "seg", 0, lo, None
    whole, at = len(nodes) == n, lo
    for level, size in enumerate(sizes):
        if whole and level == len(sizes) - 1:
            yield "root", level, 0, nodes[0]
            return
        end = at + len(nodes)
        p, q = -(-at // ARITY), -(-end // ARITY) if end == size else end // ARITY
        q = max(p, q)
        if not whole:
            for i in itertools.chain(range(at, min(end, p * ARITY)), range(max(at, q * ARITY, p * ARITY), end)):
                yield "node", level, i, nodes[i - at]
        if p == q:
            break
        nodes, at = [joined_digest(nodes[j * ARITY - at : (j + 1) * ARITY - at]) for j in range(p, q)], p
    x, y = lo, hi - 1
    for level, size in enumerate(sizes[:-1]):
        for i in itertools.chain(range(x // ARITY * ARITY, x), range(y + 1, min(size, (y // ARITY + 1) * ARITY))):
            yield "want", level, i, None
        x, y = x // ARITY, y // ARITY


def _finished(items: DataFrame, height: int | None) -> DataFrame:
    """Nodes and wants of groups: builds every level up to `height` (None: the root) and answers the wants below it.

    With a height, the key is the ancestor's coordinate there, so a group's nodes are dealt out over as many tasks as its trees
    have nodes at that height.
    """
    if height is None:
        keyed = items.withColumn("c", F.lit(0).cast("long"))
    else:
        step = F.element_at(F.array(*[F.lit(ARITY**k).cast("long") for k in range(height + 1)]), F.lit(height + 1) - F.col("level"))
        keyed = items.withColumn("step", step).withColumn("c", F.expr("idx div step")).drop("step")

    def build(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes = level_sizes(rows[0]["n"])
        top = len(sizes) - 1
        stop = top if height is None else min(height, top)
        known: list[dict[int, str]] = [{} for _ in range(top + 1)]
        for r in rows:
            if r["kind"] == "node":
                known[r["level"]][r["idx"]] = r["digest"]
        for level in range(stop):
            have = known[level]
            for p in {i // ARITY for i in have}:
                known[level + 1][p] = joined_digest([have[i] for i in range(p * ARITY, min(sizes[level], (p + 1) * ARITY))])
        g, n = rows[0]["g"], rows[0]["n"]
        out = [("answer", r["part"], g, r["lo"], n, r["level"], r["idx"], known[r["level"]][r["idx"]]) for r in rows if r["kind"] == "want"]
        out += [("root" if stop == top else "node", -1, g, 0, n, stop, i, d) for i, d in known[stop].items()]
        return pa.Table.from_batches([_items(*(zip(*out) if out else [[]] * 8))])

    return keyed.groupBy("g", "c").applyInArrow(build, _ITEMS)


def _tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves by range, siblings that ranges lack and the stretches of groups, roots of the groups)."""
    spark = leaves.sparkSession
    placed = _placed(leaves)
    *known, most = _offsets(placed)
    local = common.saved(_local(placed, known), common.shared_dir(spark))
    height = 1  # the nodes of some three to nine ranges of a group meet in one task
    while ARITY ** (height - 1) < most:
        height += 1
    ragged = local.filter("kind in ('node', 'want')")
    low = common.saved(_finished(ragged.filter(F.col("level") < height), height), common.shared_dir(spark))
    high = ragged.filter(F.col("level") >= height).union(low.filter("kind = 'node'"))
    high = common.saved(_finished(high, None), common.shared_dir(spark))
    roots = local.union(low).union(high).filter("kind = 'root'").select("g", "digest")
    items = local.filter("kind = 'seg'").union(low.union(high).filter("kind = 'answer'"))
    return placed, items, roots


def _stretch_proofs(leaves: list[str], lo: int, n: int, outside: dict[tuple[int, int], str]):
    """Lists of (left, right) siblings of each leaf of a stretch, and the root."""
    sizes = level_sizes(n)
    levels, nodes, x, y = [], leaves, lo, lo + len(leaves) - 1
    for level, size in enumerate(sizes[:-1]):
        a, b = x // ARITY * ARITY, min(size, (y // ARITY + 1) * ARITY)
        nodes = [outside[level, i] for i in range(a, x)] + nodes + [outside[level, i] for i in range(y + 1, b)]
        levels.append((a, nodes))
        x, y = x // ARITY, y // ARITY
        nodes = [joined_digest(nodes[j * ARITY - a : (j + 1) * ARITY - a]) for j in range(x, y + 1)]
    memory: list[tuple[int, list]] = [(-1, [])] * len(sizes)

    def path(level: int, i: int) -> list:
        if level == len(levels):
            return []
        if memory[level][0] != i:
            a, row = levels[level]
            r = i // ARITY * ARITY
            memory[level] = i, [("".join(row[r - a : i - a]), "".join(row[i + 1 - a : r + ARITY - a])), *path(level + 1, i // ARITY)]
        return memory[level][1]

    return (path(0, i) for i in range(lo, lo + len(leaves))), nodes[0]


def _proof_array(lists: list[list]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = list(itertools.chain.from_iterable(lists))
    sides = [pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(sides, ["left", "right"]))


def _proved(placed: DataFrame, items: DataFrame, above: DataFrame | None) -> DataFrame:
    """(row, leaf, subroot, root, proof) of the leaves. above: (g, root, proof) of the groups in the tree over them."""
    spark = placed.sparkSession
    if above is None:
        known = items.withColumns({"top": F.lit(None).cast("string"), "upper": F.lit(None).cast(PROOF)})
    else:
        up = above.select(F.col("g").alias("g2"), F.col("root").alias("top"), F.col("proof").alias("upper"))
        known = items.filter("kind = 'seg'").join(up, F.col("g").eqNullSafe(F.col("g2")), "left").drop("g2")
        known = known.unionByName(items.filter("kind = 'answer'"), allowMissingColumns=True)
    own = placed.select("row", "leaf", "g", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"))
    both = own.unionByName(known.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    dealt = both.repartition(max(common.partitions(spark), placed.rdd.getNumPartitions()), "part").sortWithinPartitions("part", "pos")
    schema = T.StructType([placed.schema["row"], *[common.field(c, "string") for c in ("leaf", "subroot", "root")], common.field("proof", PROOF)])
    item = ["kind", "g", "lo", "n", "level", "idx", "digest", "top", "upper"]

    def one_range(batches):
        outside: dict = {}
        stretches: dict = {}
        own = []
        for rb in batches:
            kind = rb.column(rb.schema.get_field_index("kind"))
            for r in rb.select(item).filter(pc.is_valid(kind)).to_pylist():
                if r["kind"] == "seg":
                    stretches[r["g"]] = r
                else:
                    outside.setdefault(r["g"], {})[r["level"], r["idx"]] = r["digest"]
            own.append(rb.select(["row", "leaf", "g"]).filter(pc.is_null(kind)))
        for g, held in _segments(own, "g"):
            seg = stretches[g]
            leaves = list(itertools.chain.from_iterable(rb.column(1).to_pylist() for rb in held))
            paths, subroot = _stretch_proofs(leaves, seg["lo"], seg["n"], outside.get(g, {}))
            upper = [(s["left"], s["right"]) for s in seg["upper"] or []]
            root = subroot if seg["top"] is None else seg["top"]
            for rb in held:
                for at in range(0, rb.num_rows, ROWS_OUT):
                    part = rb.slice(at, ROWS_OUT)
                    proofs = [[*x, *upper] for x in itertools.islice(paths, part.num_rows)]
                    same = [pa.array([v] * part.num_rows, pa.string()) for v in (subroot, root)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *same, _proof_array(proofs)], names=["row", "leaf", "subroot", "root", "proof"])

    def run(batches):
        for _, held in _segments(batches, "part"):  # the ranges that were dealt to this task follow each other
            yield from one_range(held)
        common.release()

    return dealt.mapInArrow(run, schema)


def dataset_manifest(rows: DataFrame, leaf: Column, group: str = "source", order: tuple[str, ...] = ("doc_id",), keep: tuple[str, ...] | None = None) -> DataFrame:
    """`rows` with leaf, subroot, root (lowercase hex) and proof array<struct<left, right>>: a tree of three children a node over
    the leaves of each group in the given order, and one over the groups' roots in byte order, null first.

    leaf: a digest of each row, such as `record_digest`. keep: columns to return (default: all); only these, group, order and leaf
    move, so long texts should stay out. proof: for each level from the leaf to the root the digests, end to end, of the nodes left
    and right of the row's own in its run; `folded(leaf, proof)` gives root.

    The rows are range-sorted by group and order; each range builds the complete subtrees of its own leaves, whose coordinates follow
    from the number of leaves that ranges before hold of its first group (one row a range goes through the driver). Nodes at
    the ragged edges of ranges are dealt out by the coordinate of an ancestor, then by group, to finish the upper levels, and
    ranges get back the few siblings that they lack. A hot group is spread over its ranges, and so are equal rows.

    A null group is a group of its own and comes first, null order values come first, rows with equal ones follow the order of their
    digests. Repeated rows are leaves of their own. A group of one leaf has that leaf as subroot; an only group's subroot is the
    root. An empty table gives an empty result. Input columns named leaf, subroot, root or proof are replaced.
    """
    spark = rows.sparkSession
    kept = common.without(rows.select(*[rows[f"`{c}`"] for c in (keep or rows.columns)]), ["leaf", "subroot", "root", "proof"]).columns
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    leaves = rows.select(row.alias("row"), F.col(f"`{group}`").cast("string").alias("g"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("o"), leaf.alias("leaf"))
    placed, items, roots = _tree(leaves)
    g = F.col("g")
    over, over_items, _ = _tree(roots.select(F.struct(g).alias("row"), F.lit("").alias("g"), F.struct(g).alias("o"), F.col("digest").alias("leaf")))
    above = _proved(over, over_items, None).select("row.g", "root", "proof")
    above = common.saved(above, common.shared_dir(spark))
    return _proved(placed, items, above).select("row.*", "leaf", "subroot", "root", "proof")
