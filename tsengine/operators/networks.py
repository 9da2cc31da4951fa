"""Discrete Bayesian networks: counts by Spark, greedy search over a few variables, graph queries on edge tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.model import settled

#: Variables of one network; the search asks for counts of one family at a time.
MOST_VARIABLES = 64


class FamilyScores:
    """BIC of a variable given parents: sum of N_ijk ln(N_ijk / N_ij) - ln(n) / 2 * q (r - 1), q the product of the parents' numbers
    of states. The sums are made by Spark over a table of distinct rows with their counts; only one number a family comes back."""

    def __init__(self, wide: DataFrame, variables: Sequence[str]):
        if len(variables) > MOST_VARIABLES:
            raise ValueError(f"{len(variables)} variables; at most {MOST_VARIABLES}")
        self.variables = list(variables)
        self.counts = wide.select(*variables).groupBy(*variables).agg(F.count("*").alias("_n")).cache()
        row = self.counts.agg(F.sum("_n").alias("_n"), *[F.count_distinct(v).alias(v) for v in variables]).first()
        self.n, self.levels = row["_n"] or 0, {v: max(row[v], 1) for v in variables}
        self.known: dict[tuple, float] = {}

    def _ask(self, families: list[tuple[str, tuple]]) -> None:
        """One job for all families that aren't known yet: their contingency tables side by side."""
        todo = [f for f in families if f not in self.known]
        if not todo or not self.n:
            self.known.update((f, 0.0) for f in todo)
            return
        parts = None
        for k, (child, parents) in enumerate(todo):
            cell = self.counts.groupBy(*parents, child).agg(F.sum("_n").alias("nijk"))
            key = F.concat_ws("|", *[F.col(p).cast("string") for p in parents]) if parents else F.lit("")
            one = cell.select(F.lit(k).alias("family"), key.alias("parents"), "nijk")
            parts = one if parts is None else parts.union(one)
        rows = parts.groupBy("family", "parents").agg(F.sum(F.col("nijk") * F.ln("nijk")).alias("a"), F.sum("nijk").alias("nij"))
        sums = rows.groupBy("family").agg(F.sum(F.col("a") - F.col("nij") * F.ln("nij")).alias("ll")).collect()
        for row in sums:
            child, parents = todo[row["family"]]
            size = math.prod(self.levels[p] for p in parents) * (self.levels[child] - 1)
            self.known[child, parents] = row["ll"] - math.log(self.n) / 2 * size

    def scores(self, families: Iterable[tuple[str, Iterable[str]]]) -> list[float]:
        keyed = [(c, tuple(sorted(p))) for c, p in families]
        self._ask(list(dict.fromkeys(keyed)))
        return [self.known[f] for f in keyed]

    def close(self) -> None:
        self.counts.unpersist()


def reaches(parents: dict[str, set], start: str, goal: str) -> bool:
    """Whether a directed path leads from start to goal."""
    todo, seen = [goal], set()
    while todo:
        v = todo.pop()
        if v == start:
            return True
        if v not in seen:
            seen.add(v)
            todo += parents[v]
    return False


def hill_climb(wide: DataFrame, variables: Sequence[str], blacklist: Iterable[tuple[str, str]] = (), whitelist: Iterable[tuple[str, str]] = (), most_parents: int = 3, tabu: int = 0, most_steps: int = 200) -> tuple[list[tuple[str, str]], float]:
    """(edges, BIC) of the best network found by adding, dropping and turning edges; ties by operation, source, target.

    blacklist: edges never used; whitelist: edges always there. tabu: how many non-improving steps may follow each other, recent
    networks left out. All changes of one step are scored by one Spark job.
    """
    s = FamilyScores(wide, variables)
    black, white = set(blacklist), set(whitelist)
    parents: dict[str, set] = {v: set() for v in s.variables}
    for a, b in sorted(white):
        parents[b].add(a)
    total = sum(s.scores((v, parents[v]) for v in s.variables))
    best, best_total, idle, recent = {v: set(p) for v, p in parents.items()}, total, 0, []
    for _ in range(most_steps):
        moves = []
        for a in s.variables:
            for b in s.variables:
                if a == b:
                    continue
                if a in parents[b]:
                    if (a, b) not in white:
                        moves.append(("drop", a, b, {b: parents[b] - {a}}))
                        if (b, a) not in black and len(parents[a]) < most_parents:
                            turned = {v: set(p) for v, p in parents.items()}
                            turned[b].discard(a)
                            if not reaches(turned, a, b):
                                moves.append(("turn", a, b, {b: parents[b] - {a}, a: parents[a] | {b}}))
                elif b not in parents[a] and (a, b) not in black and len(parents[b]) < most_parents and not reaches(parents, b, a):
                    moves.append(("add", a, b, {b: parents[b] | {a}}))
        wanted = [(v, p) for m in moves for v, p in m[3].items()] + [(v, parents[v]) for v in s.variables]
        score = dict(zip([(v, frozenset(p)) for v, p in wanted], s.scores(wanted)))
        gain = lambda m: sum(score[v, frozenset(p)] - score[v, frozenset(parents[v])] for v, p in m[3].items())
        graded = sorted(((-round(gain(m), 9), m[0], m[1], m[2], m[3]) for m in moves), key=lambda m: m[:4])
        for loss, _, _, _, change in graded:
            after = {v: frozenset(change.get(v, p)) for v, p in parents.items()}
            if after not in recent:
                break
        else:
            break
        if loss >= 0 and idle >= tabu:
            break
        idle = idle + 1 if loss >= 0 else 0
        recent = [*recent, {v: frozenset(p) for v, p in parents.items()}][-10:] if tabu else []
        parents = {v: set(p) for v, p in after.items()}
        total -= loss
        if total > best_total + 1e-9:
            best, best_total = {v: set(p) for v, p in parents.items()}, total
    s.close()
    return sorted((a, b) for b, p in best.items() for a in p), best_total


def edges_table(spark: SparkSession, model: str, edges: Iterable[tuple[str, str]]) -> DataFrame:
    """(model_id, src, dst)."""
    return spark.createDataFrame([(model, a, b) for a, b in edges], "model_id string, src string, dst string")


def effect_blacklist(effect: str, causes: Sequence[str], layers: Sequence[Sequence[str]] = ()) -> list[tuple[str, str]]:
    """Edges from the effect to its causes, and, of layers of variables, all inside a layer."""
    return [(effect, c) for c in causes if c != effect] + [(a, b) for layer in layers for a in layer for b in layer if a != b]


def explain_effect(wide: DataFrame, effect: str, causes: Sequence[str], layers: Sequence[Sequence[str]] = (), **options) -> list[str]:
    """The parents of the effect in the network of it and its causes."""
    columns = [effect, *[c for c in causes if c != effect]]
    edges, _ = hill_climb(wide, columns, effect_blacklist(effect, causes, layers), **options)
    return sorted(a for a, b in edges if b == effect)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, degree, is_root, is_leaf) of every node (column node)."""
    n_in = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    n_out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    d = nodes.select("node").distinct().join(n_in, "node", "left").join(n_out, "node", "left").fillna(0)
    return d.select("node", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"), (F.col("in_degree") == 0).alias("is_root"), (F.col("out_degree") == 0).alias("is_leaf"))


def parents_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("dst") == node).select(F.col("src").alias("node"))


def children_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("src") == node).select(F.col("dst").alias("node"))


def neighbours_of(edges: DataFrame, node: str) -> DataFrame:
    return parents_of(edges, node).union(children_of(edges, node)).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Edges that are there both ways, once, src < dst."""
    return edges.alias("x").join(edges.select(F.col("src").alias("d2"), F.col("dst").alias("s2")).alias("y"), (F.col("x.src") == F.col("s2")) & (F.col("x.dst") == F.col("d2"))).filter("src < dst").select("src", "dst")


def is_acyclic(edges: DataFrame) -> bool:
    """Whether no directed circle exists. Edges from nodes without parents are taken away, round by round, until none or only
    circles are left; only a count a round reaches the driver."""
    left = settled(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        left = settled(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        rest = left.count()
        if rest == n:
            return False
        n = rest
    return True


def conditional_table(wide: DataFrame, child: str, parents: Sequence[str]) -> DataFrame:
    """(parents, child, n, prob): P(child | parents) of the combinations seen."""
    from pyspark.sql.window import Window

    counts = wide.groupBy(*parents, child).agg(F.count("*").alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))))
