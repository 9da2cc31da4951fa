"""Likelihoods of discrete states, their rankings, and sensitivity to factors.

Wide tables here have one column a variable and one row a slot; long ones are states(name, slot, state).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _all_in(sets: Mapping[str, Sequence]) -> Column:
    out = F.lit(True)
    for column, values in sets.items():
        out &= F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return out


def joint_probability(wide: DataFrame, sets: Mapping[str, Sequence]) -> DataFrame:
    """(prob): share of rows in which every column is in its set; null for no rows."""
    return wide.agg(F.avg(_all_in(sets).cast("double")).alias("prob"))


def conditional_probability(wide: DataFrame, effect: Mapping[str, Sequence], cause: Mapping[str, Sequence]) -> DataFrame:
    """(prob): P(effect | cause); 0 if the cause never occurs."""
    given = F.count_if(_all_in(cause))
    return wide.agg(F.coalesce(F.try_divide(F.count_if(_all_in(cause) & _all_in(effect)), given), F.lit(0.0)).cast("double").alias("prob"))


def cause_likelihood(wide: DataFrame, causes: Sequence[str], effect: str, values: Sequence) -> DataFrame:
    """(causes, prob): P(effect in values | causes) for every combination of their observed values; 0 for those never seen
    together. The value tables are small (states), so their product is."""
    seen = wide.groupBy(*causes).agg(F.avg(F.coalesce(F.col(effect).isin(list(values)), F.lit(False)).cast("double")).alias("prob"))
    grid = None
    for c in causes:
        one = wide.select(c).distinct()
        grid = one if grid is None else grid.crossJoin(one)
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}")) for c in causes]
    return grid.alias("g").join(seen.alias("s"), same, "left").select(*[F.col(f"g.{c}").alias(c) for c in causes], F.coalesce("s.prob", F.lit(0.0)).alias("prob"))


def effect_probability(wide: DataFrame, effect: str, cause: Mapping[str, Sequence]) -> DataFrame:
    """(effect, prob): P(effect = s | cause), for every observed state of the effect."""
    given = wide.select(F.col(effect), _all_in(cause).alias("_g"))
    counts = given.groupBy(effect).agg(F.count_if("_g").alias("_n"))
    return counts.withColumn("prob", F.coalesce(F.try_divide(F.col("_n"), F.sum("_n").over(Window.partitionBy())), F.lit(0.0)).cast("double")).drop("_n")


def state_likelihoods(states: DataFrame, effects: Sequence[str] | None = None, extreme: str = "max") -> DataFrame:
    """(effect, peak, cause, state, prob): P(the effect is at its extreme state | the cause is in that state), for all pairs.

    states is joined to itself on the slot, so a pair's counts are of the slots that both have; the extreme is the largest or
    the smallest state of the effect.
    """
    pick = F.max("state") if extreme == "max" else F.min("state")
    e = states if effects is None else states.filter(F.col("name").isin(list(effects)))
    peaks = e.groupBy("name").agg(pick.alias("peak"))
    e = e.join(F.broadcast(peaks), "name").select("slot", F.col("name").alias("effect"), "peak", (F.col("state") == F.col("peak")).cast("double").alias("hit"))
    c = states.select("slot", F.col("name").alias("cause"), "state")
    return e.join(c, "slot").filter("effect <> cause").groupBy("effect", "peak", "cause", "state").agg(F.avg("hit").alias("prob"))


def best_states(likelihoods: DataFrame) -> DataFrame:
    """(effect, cause, opt_state, opt_prob): of each cause the state with the highest likelihood, the smallest of equal ones."""
    best = F.max_by(F.struct("state", "prob"), F.struct("prob", -F.col("state")))
    return likelihoods.groupBy("effect", "cause").agg(best.alias("b")).select("effect", "cause", F.col("b.state").alias("opt_state"), F.col("b.prob").alias("opt_prob"))


def top_causes(ranked: DataFrame, n: int) -> DataFrame:
    """The n causes of each effect with the highest likelihood, by name where equal, with their rank."""
    w = Window.partitionBy("effect").orderBy(F.desc("opt_prob"), "cause")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def peak_analysis(states: DataFrame, effects: Sequence[str] | None = None) -> DataFrame:
    """Likelihoods for the smallest and the largest state of each effect, with extreme."""
    both = [state_likelihoods(states, effects, x).withColumn("extreme", F.lit(x)) for x in ("min", "max")]
    return both[0].union(both[1])


def likelihood_spread(ranked: DataFrame) -> DataFrame:
    """(effect, spread): population deviation of the causes' best likelihoods."""
    return ranked.groupBy("effect").agg(F.stddev_pop("opt_prob").alias("spread"))


def likelihood_matrix(likelihoods: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Likelihoods as a matrix of two causes; missing pairs are null."""
    return likelihoods.groupBy(rows).pivot(columns, list(values)).agg(F.first("prob"))


def factor_shares(states: DataFrame, factor: str) -> DataFrame:
    """(name, level, state, prob): P(state | level of the factor column); the states that a level never shows have 0."""
    counts = states.groupBy("name", F.col(factor).alias("level"), "state").agg(F.count("*").alias("n"))
    share = counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("name", "level")))
    levels, values = counts.select("name", "level").distinct(), counts.select("name", "state").distinct()
    return levels.join(values, "name").join(share.drop("n"), ["name", "level", "state"], "left").fillna(0.0, ["prob"])


def sensitivity(states: DataFrame, factor: str, distance: str = "h") -> DataFrame:
    """(name, sensitivity): mean distance between the state distributions of all ordered pairs of levels, each with itself too.

    distance: h Hellinger, b Bhattacharyya, v half the total variation, at most 0.5.
    """
    p = factor_shares(states, factor)
    q = p.select("name", F.col("level").alias("other"), "state", F.col("prob").alias("q"))
    pairs = p.join(q, ["name", "state"]).groupBy("name", "level", "other")
    if distance == "v":
        measured = pairs.agg((0.5 * F.least(F.lit(1.0), F.sum(F.abs(F.col("prob") - F.col("q"))))).alias("d"))
    else:
        overlap = F.least(F.lit(1.0), F.sum(F.sqrt(F.col("prob") * F.col("q"))))
        measured = pairs.agg((F.sqrt(1 - overlap) if distance == "h" else F.when(overlap > 0, -F.ln(overlap))).alias("d"))
        if distance == "b":  # without overlap the distance is unbounded: twice the largest finite one of the variable
            top = F.max("d").over(Window.partitionBy("name"))
            measured = measured.withColumn("d", F.coalesce("d", 2 * top))
    return measured.groupBy("name").agg(F.avg("d").alias("sensitivity"))


def sensitivity_report(states: DataFrame, factors: Sequence[str], distance: str = "h") -> DataFrame:
    """(name, factor, sensitivity, total): of every factor, with the sum over factors."""
    out = None
    for f in factors:
        one = sensitivity(states, f, distance).withColumn("factor", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("total", F.sum("sensitivity").over(Window.partitionBy("name"))).select("name", "factor", "sensitivity", "total")


def most_sensitive(report: DataFrame, most: int) -> DataFrame:
    """(name, total, rank): the names whose sensitivities sum highest; ties by name. One row a name, ranked together."""
    totals = report.groupBy("name").agg(F.sum("sensitivity").alias("total"))
    top = totals.orderBy(F.desc("total"), "name").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "name")))


def above(ranked: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Ranked causes whose best likelihood exceeds the threshold."""
    return ranked.filter(F.col("opt_prob") > threshold)


def time_effect_map(states: DataFrame) -> DataFrame:
    """(name, month, weekday, hour, state, prob): P(state | month, weekday, hour)."""
    counts = states.groupBy("name", "month", "weekday", "hour", "state").agg(F.count("*").alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("name", "month", "weekday", "hour"))).drop("n")


def month_distances(effect_map: DataFrame) -> DataFrame:
    """(name, month, other, distance): Frobenius distance of the months' maps, cells that one lacks counting as 0."""
    months = effect_map.select("name", "month").distinct()
    cells = effect_map.select("name", "weekday", "hour", "state").distinct()
    full = months.join(cells, "name").join(effect_map, ["name", "month", "weekday", "hour", "state"], "left").fillna(0.0, ["prob"])
    other = full.select("name", "weekday", "hour", "state", F.col("month").alias("other"), F.col("prob").alias("q"))
    pairs = full.join(other, ["name", "weekday", "hour", "state"]).filter("month < other")
    return pairs.groupBy("name", "month", "other").agg(F.sqrt(F.sum(F.pow(F.col("prob") - F.col("q"), 2))).alias("distance"))


def irregular_states(states: DataFrame) -> DataFrame:
    """(name, slot, irregular): 1 where a variable is in its rarest state; in its two rarest if ten times their number is below
    the third's. A variable of one state is never irregular."""
    counts = states.groupBy("name", "state").agg(F.count("*").alias("n"))
    w = Window.partitionBy("name").orderBy("n", "state")
    ranked = counts.withColumns({"_i": F.row_number().over(w), "_k": F.count("*").over(Window.partitionBy("name"))})
    n = lambda i: F.max(F.when(F.col("_i") == i, F.col("n"))).over(Window.partitionBy("name"))
    two = F.coalesce((n(1) + n(2)) * 10 < n(3), F.lit(False))
    rare = ranked.withColumn("irregular", ((F.col("_k") > 1) & ((F.col("_i") == 1) | ((F.col("_i") == 2) & two))).cast("int"))
    return states.join(rare.select("name", "state", "irregular"), ["name", "state"]).select("name", "slot", "irregular")


def irregular_skew(irregular: DataFrame) -> DataFrame:
    """(name, skew): |irregular - regular| / sqrt(irregular * regular) of the numbers of slots; null where one is 0."""
    i, r = F.sum("irregular"), F.count_if(F.col("irregular") == 0)
    return irregular.groupBy("name").agg(F.try_divide(F.abs(i - r), F.when(i * r > 0, F.sqrt(i * r))).cast("double").alias("skew"))


def correlation(a: str, b: str, places: int = 3) -> Column:
    """Pearson correlation as an aggregate, rounded; null where one side is constant. From moments, which every task sums."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.round(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), places)


def likely(best: DataFrame, least: float = 0.9) -> DataFrame:
    """The rows of `best_states` with a likelihood above `least`."""
    return best.filter(F.col("opt_prob") > least)
