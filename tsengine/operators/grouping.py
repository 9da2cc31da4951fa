"""Clustering as rounds over tables of pairs: affinity propagation, packing, Ward's method and k-means; no group of all sensors.

Points are numbered in the order of their names; numbers stand for names inside, and lower numbers win ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsengine.model import settled

#: Rows of pairs for one task, and rounds between two checkpoints of changing state.
PAIRS_PER_TASK, ROUNDS_KEPT = 200_000, 16


def numbered(names: DataFrame, column: str = "sensor") -> DataFrame:
    """(name, i long): the distinct names of a column, numbered from 0 in their order, by a range sort."""
    one = names.select(F.col(column).cast("string").alias("name")).distinct().orderBy("name")
    return settled(one.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("name string, i long"))


def _blocks(pairs: DataFrame, rows: int, order: str, values: list[str]):
    """An RDD of blocks: the pairs (i, j, values) dealt by their first point, each task's rows as arrays sorted by i and `order`.

    Rounds run on arrays: a round's work in a task is a few passes over its rows, and what tasks tell each other is one number a
    point, or one candidate a task.
    """
    most = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(pairs.repartition(max(1, min(most, -(-rows // PAIRS_PER_TASK))), "i").sortWithinPartitions("i", order))

    def pack(batches):
        held = [rb for rb in batches if rb.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            yield pa.RecordBatch.from_arrays([pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ("i", "j", *values)], names=["i", "j", *values])

    packed = dealt.select("i", "j", *values).mapInArrow(pack, ", ".join(f"{c} binary" for c in ("i", "j", *values)))
    kinds = {c: np.int64 if c in "ij" else np.float64 for c in ("i", "j", *values)}
    return packed.rdd.map(lambda row: {c: np.frombuffer(row[c], k) for c, k in kinds.items()})


def _with_numbers(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """`pairs` (a, b, ...) with i and j in place of a and b."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    left = pairs.join(ids.select(F.col("name").alias("a"), "i"), "a")
    return left.join(ids.select(F.col("name").alias("b"), F.col("i").alias("j")), "b").select("i", "j", *rest)


def _named(found: DataFrame, ids: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(..., sensor, exemplar, is_exemplar) from (..., i, e)."""
    both = found.join(ids.select("i", F.col("name").alias("sensor")), "i").join(ids.select(F.col("i").alias("e"), F.col("name").alias("exemplar")), "e")
    return both.select(*(more or []), "sensor", "exemplar", (F.col("i") == F.col("e")).alias("is_exemplar"))


def order_statistics(df: DataFrame, value: str, ranks: list[int], wide: int = 4096) -> list[float]:
    """The values at these ranks (from 0) of a numeric column without nulls, exactly.

    Each round counts the values in `wide` ranges of those between two bounds and goes on with the range that holds the rank, until
    that holds one value or at most `wide` rows, which are then looked at. No task sorts the column and no more goes to the driver.
    """
    v = df.select(F.col(value).cast("double").alias("v"))
    low, high, many = v.agg(F.min("v"), F.max("v"), F.count("*")).first()
    known: dict[tuple, list[float]] = {}

    def at(rank: int, a: float, b: float, n: int) -> float:
        if a == b:
            return a
        inside = v.filter((F.col("v") >= a) & (F.col("v") <= b))
        if n <= wide:
            if (a, b) not in known:
                known[a, b] = sorted(r["v"] for r in inside.collect())
            return known[a, b][rank]
        cell = F.least(F.floor((F.col("v") - a) / ((b - a) / wide)), F.lit(wide - 1))
        for r in sorted(inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["c"]):
            if rank < r["n"]:
                return at(rank, r["lo"], r["hi"], r["n"])
            rank -= r["n"]
        raise IndexError("rank beyond the column's rows")

    return [at(rank, low, high, many) for rank in ranks]


# --- affinity propagation --------------------------------------------------------------------------------------------------------


def affinity(similarity: DataFrame, names: DataFrame, preference: float | None = None, damping: float = 0.5, rounds: int = 200, steady: int = 15) -> DataFrame:
    """(sensor, exemplar, is_exemplar) by affinity propagation.

    similarity: (a, b, s) for ordered pairs of names, in both directions; pairs that are left out can't be each other's exemplar, so a
    sparse table stays sparse. names: (sensor). preference: of every point (default: the median similarity); earlier names get up
    to 0.001 more, so that points that are alike don't swing together for ever.

    Messages are (i, j, s, r, v): responsibility and availability of j for i, dealt by i. A round takes the two largest v + s of each i
    where its rows lie; the sums of the positive r of each j are added up over all tasks, one number a point, and sent back. It ends
    when the exemplars stay the same for `steady` rounds. State is kept by the executors and written to the checkpoint folder
    each ROUNDS_KEPT rounds; a table of no more rows than one task's makes its rounds there. Then the member with the largest sum of similarities in its group becomes the exemplar, and
    points go to the most similar one; lower names win ties. A point without pairs is its own exemplar. An empty table gives
    an empty result.
    """
    ids = numbered(names)
    n = ids.count()
    pairs = settled(_with_numbers(similarity.select("a", "b", F.col("s").cast("double")), ids).filter("i <> j"))
    many = pairs.count()
    if many == 0:
        return _named(ids.select("i", F.col("i").alias("e")), ids)
    if preference is None:
        preference = float(np.mean(order_statistics(pairs, "s", [(many - 1) // 2, many // 2])))
    own = ids.select("i", F.col("i").alias("j"), (F.lit(preference) + F.lit(1e-3) * (F.lit(n) - F.col("i")) / n).alias("s"))

    def responsibilities(x, v):
        """The block with new r, and for each point: sum of the positive r of others, own r, own v."""
        i, j, s, r = x["i"], x["j"], x["s"], x["r"]
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        size = np.diff(np.append(start, len(i)))
        t = v + s
        first = np.maximum.reduceat(t, start)
        hit = np.flatnonzero(t == np.repeat(first, size))
        at = hit[np.searchsorted(hit, start)]
        t[at] = -np.inf
        second = np.maximum.reduceat(t, start)
        against = np.repeat(first, size)
        against[at] = np.where(size > 1, second, s[at] - 1.0)
        r = damping * r + (1 - damping) * (s - against)
        mine = i == j
        told = np.zeros((3, n))
        told[0] = np.bincount(j, np.where(mine, 0.0, np.maximum(r, 0.0)), n)
        told[1, i[mine]], told[2, i[mine]] = r[mine], v[mine]
        return {"i": i, "j": j, "s": s, "r": r, "v": v}, told

    def answered(x, told):
        i, j, r = x["i"], x["j"], x["r"]
        mine = i == j
        positive, own, _ = told
        new = np.where(mine, positive[j], np.minimum(0.0, own[j] + positive[j] - np.where(mine, 0.0, np.maximum(r, 0.0))))
        return responsibilities(x, damping * x["v"] + (1 - damping) * new)

    def begun(x):
        return responsibilities({**x, "r": np.zeros(len(x["s"]))}, np.zeros(len(x["s"])))

    def ends(told, past):
        """Adds a round's exemplars to `past` and says whether they have been the same for long enough."""
        positive, r, v = told
        past.append(np.flatnonzero(damping * v + (1 - damping) * positive + r > 0))
        return len(past) == rounds or len(past) > steady and len(past[-1]) > 0 and all(np.array_equal(c, past[-1]) for c in past[-steady - 1 : -1])

    def alone(x):
        """All rounds of a table that is one block: there is nobody to tell."""
        (x, told), past = begun(x), []
        while not ends(told, past):
            x, told = answered(x, told)
        return past[-1]

    blocks = _blocks(pairs.unionByName(own), many + n, "j", ["s"])
    if blocks.getNumPartitions() == 1:
        centres = blocks.map(alone).first()
    else:
        state, past, old = blocks.map(begun), [], []
        while True:
            state.persist(StorageLevel.MEMORY_AND_DISK)
            if len(past) % ROUNDS_KEPT == ROUNDS_KEPT - 1:
                state.checkpoint()
            told = state.map(lambda x: x[1]).treeReduce(np.add)
            if len(past) % ROUNDS_KEPT == ROUNDS_KEPT - 1:
                for x in old:
                    x.unpersist()
                old = []
            old.append(state)
            if ends(told, past):
                break
            sent = pairs.sparkSession.sparkContext.broadcast(told)  # three numbers a point
            state = state.map(lambda x, sent=sent: answered(x[0], sent.value))
        for x in old:
            x.unpersist()
        centres = past[-1]
    if not len(centres):
        return _named(ids.select("i", F.col("i").alias("e")), ids)
    centres = pairs.sparkSession.createDataFrame(pa.table({"e": centres.astype(np.int64)}))
    s = pairs.unionByName(own)
    label = _nearest(s, centres, ids)
    group = s.join(label.select("i", "e"), "i").join(label.select(F.col("i").alias("j"), F.col("e").alias("ej")), "j").filter("e = ej")
    chosen = group.groupBy("e", "j").agg(F.sum("s").alias("total")).groupBy("e").agg(F.max(F.struct("total", (-F.col("j")).alias("k"))).alias("x"))
    chosen = settled(chosen.select((-F.col("x.k")).alias("e")))
    return settled(_named(_nearest(s, chosen, ids), ids))


def _nearest(s: DataFrame, centres: DataFrame, ids: DataFrame) -> DataFrame:
    """(i, e): the most similar centre of every point, a centre's own itself; a point that knows no centre stays alone."""
    to = s.join(centres, F.col("j") == F.col("e")).withColumn("s", F.when(F.col("i") == F.col("j"), F.lit(float("inf"))).otherwise(F.col("s")))
    best = to.groupBy("i").agg(F.max(F.struct("s", (-F.col("e")).alias("k"))).alias("x")).select("i", (-F.col("x.k")).alias("e"))
    return settled(ids.select("i").join(best, "i", "left").select("i", F.coalesce("e", "i").alias("e")))


# --- packing ---------------------------------------------------------------------------------------------------------------------


def packs(distance: DataFrame, names: DataFrame, low: float, high: float) -> DataFrame:
    """(sensor, exemplar, is_exemplar) by packing around exemplars.

    distance: (a, b, d) for all ordered pairs of different names. While points are left: if all are further apart than `high`, each
    stays alone; if all are nearer than `low`, they are one cluster around the point with the least sum of distances; else each
    point's sorted distances are cut in two with the least variance inside, and of the points whose near part lies within `high`
    the one whose parts' means lie furthest apart takes its near part, the first of equals (to 12 digits). If there is none, the two
    nearest points form a cluster.

    The sorted rows stay where they were dealt. A round sends which points are left, cuts each row by running sums, and brings one
    candidate a task back, the points of its near part with it. There are as many rounds as clusters of two or more; a table of no
    more rows than one task's makes them there.
    """
    ids = numbered(names)
    n = ids.count()
    pairs = _with_numbers(distance.select("a", "b", F.col("d").cast("double")), ids).filter("i <> j")
    blocks = _blocks(pairs, n * n, "d", ["d"]).persist(StorageLevel.MEMORY_AND_DISK)

    def best_of(x, left):
        """(least d, most d, nearest pair, smallest sum, widest cut) of a block's rows that are left."""
        keep = left[x["i"]] & left[x["j"]]
        i, j, d = x["i"][keep], x["j"][keep], x["d"][keep]
        if not len(i):
            return None
        near = int(np.lexsort((j, i, d))[0])
        out = [d.min(), d.max(), (d[near], i[near], j[near]), (np.inf, -1), (-np.inf, 0, None)]
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        for a, b in zip(start, np.append(start[1:], len(i))):
            row = d[a:b]
            out[3] = min(out[3], (round(float(row.sum()), 12), int(i[a])))
            k = two_groups(row)
            if k and row[k - 1] <= high:
                gap = round(float(row[k:].mean() - row[:k].mean()), 12) if k < len(row) else 0.0
                if (gap, -i[a]) > out[4][:2]:
                    out[4] = (gap, -int(i[a]), j[a:b][row <= row[k - 1]])
        return tuple(out)

    def better(p, q):
        if p is None or q is None:
            return p or q
        return min(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3]), max(p[4], q[4], key=lambda c: c[:2])

    def all_rounds(find):
        left, exemplar = np.ones(n, bool), np.arange(n)
        while left.sum() > 1:
            found = find(left)
            if found is None or found[0] > high:
                break
            if found[1] < low:
                exemplar[left] = found[3][1]
                break
            _, centre, group = found[4]
            if group is None:
                _, centre, other = found[2]
                group = np.array([other])
            group = np.append(group, abs(int(centre)))
            exemplar[group] = abs(int(centre))
            left[group] = False
        return exemplar

    def ask_all(left):
        sent = pairs.sparkSession.sparkContext.broadcast(left)  # a boolean a point
        return blocks.map(lambda x: best_of(x, sent.value)).treeReduce(better)

    if blocks.getNumPartitions() == 1:
        exemplar = blocks.map(lambda x: all_rounds(lambda left: best_of(x, left))).take(1)
        exemplar = exemplar[0] if exemplar else np.arange(n)
    else:
        exemplar = all_rounds(ask_all)
    blocks.unpersist()
    chosen = pairs.sparkSession.createDataFrame(pa.table({"i": np.arange(n), "e": exemplar.astype(np.int64)}))
    return settled(_named(chosen, ids))


def two_groups(values: np.ndarray) -> int:
    """Size of the lower group when sorted values are cut in two with the least variance inside (to 12 digits, the first of
    equals); 0 for fewer than two."""
    n = len(values)
    if n < 2:
        return 0
    s, q = np.cumsum(values), np.cumsum(values * values)
    k = np.arange(1, n)
    inside = q[:-1] - s[:-1] ** 2 / k + (q[-1] - q[:-1]) - (s[-1] - s[:-1]) ** 2 / (n - k)
    return int(np.round(inside, 12).argmin()) + 1


# --- Ward's method ---------------------------------------------------------------------------------------------------------------


def ward(cost: DataFrame, names: DataFrame) -> DataFrame:
    """(step, a, b, height, size): the merges of Ward's method in the order of their heights. cost: (a, b, c) for all pairs a < b, half of
    the squared distance of two points.

    a and b are the two groups that merge, each told by its first name; height is what the union adds to the squared error, never
    less than a part's; size is that of the union.

    A row of the matrix of costs stays one record. A round brings each row's nearest group to the driver (a number a group) and
    merges all pairs that are each other's nearest (ties: the first names); unions take their costs by the Lance-Williams update,
    columns inside each row, then the two rows of a union, which meet in a shuffle. Commonly a third of the groups go each round, so
    there are some log(n) rounds over a matrix that shrinks with the square of their number.
    """
    ids = numbered(names)
    n = ids.count()
    one = _with_numbers(cost.select("a", "b", F.col("c").cast("double")), ids)
    blocks = _blocks(one.union(one.select("j", "i", "c")).filter("i <> j"), n * n, "j", ["c"])
    context = ids.sparkSession.sparkContext

    def rows_of(x):
        start = np.flatnonzero(np.append(True, x["i"][1:] != x["i"][:-1]))
        return [(int(x["i"][a]), (x["j"][a:b], x["c"][a:b])) for a, b in zip(start, np.append(start[1:], len(x["i"])))]

    def nearest(row):
        i, (j, c) = row
        k = int(np.lexsort((j, c))[0])
        return i, int(j[k]), float(c[k])

    def columns(row, to):
        """The row under its group's number: groups, and its part of the sum for each (see `closed`)."""
        rep, merge_c, old, new = to
        i, (j, c) = row
        order = np.argsort(rep[j], kind="stable")
        j, c = j[order], c[order]
        g = rep[j]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        g = g[start]
        c = (np.add.reduceat((old[i] + old[j]) * c, start) - old[i] * merge_c[g]) / (old[i] + new[g])
        other = g != rep[i]
        return int(rep[i]), (g[other], (old[i] + new[g[other]]) * c[other])

    def together(x, y):
        g, c = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
        order = np.argsort(g, kind="stable")
        g, c = g[order], c[order]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        return g[start], np.add.reduceat(c, start)

    def closed(row, to):
        _, merge_c, _, new = to
        i, (g, c) = row
        return i, (g, np.maximum((c - new[g] * merge_c[i]) / (new[i] + new[g]), 0.0))

    rows = blocks.flatMap(rows_of)
    size, height, merges, turn, old = np.ones(n), np.zeros(n), [], 0, []
    while True:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        if turn % 4 == 3:
            rows.checkpoint()
        near = {i: (j, c) for i, j, c in rows.map(nearest).collect()}  # a row a group
        for x in old:
            x.unpersist()
        old = [rows]
        if not near:
            break
        pairs = [(c, i, j) for i, (j, c) in near.items() if i < j and near[j][0] == i]
        pairs = pairs or [min((c, *sorted((i, j))) for i, (j, c) in near.items())]  # sums of two orders may differ in the last digit
        rep, merge_c, before = np.arange(n), np.zeros(n), size.copy()
        for c, i, j in pairs:
            height[i] = max(c, height[i], height[j])
            size[i] += size[j]
            rep[j], merge_c[i] = i, c
            merges.append((float(height[i]), turn, i, j, int(size[i])))
        to = context.broadcast((rep, merge_c, before, size.copy()))  # four numbers a point
        part = rows.map(lambda r, to=to: columns(r, to.value)).filter(lambda r: len(r[1][0]) > 0)  # the last union knows no other group
        rows = part.reduceByKey(together).map(lambda r, to=to: closed(r, to.value))
        turn += 1
    rows.unpersist()
    if not merges:
        return ids.sparkSession.createDataFrame([], "step long, a string, b string, height double, size long")
    told = [(step, i, j, h, s) for step, (h, _, i, j, s) in enumerate(sorted(merges), 1)]
    found = ids.sparkSession.createDataFrame(told, "step long, x long, y long, height double, size long")
    name = lambda c, to: ids.select(F.col("i").alias(c), F.col("name").alias(to))
    return settled(found.join(name("x", "a"), "x").join(name("y", "b"), "y").select("step", "a", "b", "height", "size"))


def ward_groups(merges: DataFrame, names: DataFrame, ks: list[int]) -> DataFrame:
    """(k, sensor, label): the groups, told by their first names, where Ward's merges stop at k of them. The merges, one a sensor, go
    through the driver."""
    points = sorted(r["sensor"] for r in names.select(F.col("sensor").cast("string").alias("sensor")).distinct().collect())
    steps = sorted((r["step"], r["a"], r["b"]) for r in merges.collect())
    out = []
    for k in sorted(x for x in ks if x <= len(points)):
        into = {b: a for _, a, b in steps[: len(points) - k]}
        first: dict[str, str] = {}
        for p in points:  # a group's first name comes before its others
            first[p] = first[into[p]] if p in into else p
        out += [(k, p, first[p]) for p in points]
    return names.sparkSession.createDataFrame(out, "k int, sensor string, label string")


# --- k-means ---------------------------------------------------------------------------------------------------------------------


def kmeans(features: DataFrame, most: int, rounds: int = 100) -> DataFrame:
    """(k, sensor, label int) for every k from 2 to `most`, all in the same rounds. features: (sensor, slot, value), each sensor with
    every slot.

    Starts: the point nearest the mean, then always the one furthest from those chosen. A round sends to the tasks the centres (k
    times slots numbers for each k) and adds up each group's points by slot; it ends when no label changes. Labels follow the order of
    the starts; a group that loses all its points keeps its centre. Lower names win ties.
    """
    ids = numbered(features)
    x = settled(features.select(F.col("sensor").alias("name"), "slot", F.col("value").cast("double").alias("value")).join(ids, "name").select("i", "slot", "value"))
    apart = lambda d: F.sum((F.col("value") - F.col("c")) ** 2).alias(d)
    mean = x.groupBy("slot").agg(F.avg("value").alias("c"))
    first = x.join(mean, "slot").groupBy("i").agg(apart("d")).agg(F.min(F.struct("d", "i")).alias("m")).first()["m"]
    if first is None:
        return ids.sparkSession.createDataFrame([], "k int, sensor string, label int")
    seeds, far = [first["i"]], None
    while len(seeds) < most:
        d = x.join(x.filter(F.col("i") == seeds[-1]).select("slot", F.col("value").alias("c")), "slot").groupBy("i").agg(apart("d"))
        far = settled(d if far is None else far.join(d.withColumnRenamed("d", "d2"), "i").select("i", F.least("d", "d2").alias("d")))
        seeds.append(-far.agg(F.max(F.struct("d", (-F.col("i")).alias("k"))).alias("m")).first()["m"]["k"])
    order = ids.sparkSession.createDataFrame([(k, label, s) for k in range(2, most + 1) for label, s in enumerate(seeds[:k])], "k int, label int, i long")
    centres = order.join(x, "i").select("k", "label", "slot", F.col("value").alias("c"))
    last = None
    for _ in range(rounds):
        d = x.join(centres, "slot").groupBy("i", "k", "label").agg(apart("d"))
        label = settled(d.groupBy("i", "k").agg(F.min(F.struct("d", "label")).alias("m")).select("i", "k", "m.label"))
        if last is not None and label.join(last.withColumnRenamed("label", "before"), ["i", "k"]).filter("label <> before").isEmpty():
            break
        last = label
        new = x.join(label, "i").groupBy("k", "label", "slot").agg(F.avg("value").alias("c2"))
        centres = settled(centres.join(new, ["k", "label", "slot"], "left").select("k", "label", "slot", F.coalesce("c2", "c").alias("c")))
    return label.join(ids, "i").select("k", F.col("name").alias("sensor"), "label")


def medoids(distance: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sensor, exemplar, is_exemplar) of (keys, sensor, label): each group's member with the least sum of distances to the
    group, the first of equals. distance: (a, b, d) for all ordered pairs of different names."""
    a, b = (groups.select(*keys, F.col("sensor").alias(c), "label") for c in "ab")
    total = distance.filter("a <> b").join(a, "a").join(b, [*keys, "b", "label"]).groupBy(*keys, "label", F.col("b").alias("sensor")).agg(F.sum("d").alias("t"))
    every = groups.join(total, [*keys, "label", "sensor"], "left").withColumn("t", F.round(F.coalesce("t", F.lit(0.0)), 12))
    best = every.groupBy(*keys, "label").agg(F.min(F.struct("t", "sensor")).alias("m")).select(*keys, "label", F.col("m.sensor").alias("exemplar"))
    return groups.join(best, [*keys, "label"]).select(*keys, "sensor", "exemplar", (F.col("sensor") == F.col("exemplar")).alias("is_exemplar"))
