"""Model Confidence Sets with a stationary block bootstrap, for many sets at once.

A set is one value of the key columns (a regime and a metric, a horizon, a universe). All sets are worked on together: draws, resampled
losses, pair moments and the state of the elimination are tables in which the set is a column, so the number of jobs does not
depend on how many sets there are. The driver holds the model names alone.

1. `bootstrap_draws`: one task per (resample, slice of positions); a block that is open at the end of a slice is carried into the next.
2. `resampled_excess`: draws meet the losses of their position; one row per (set, resample) with every model's excess, the
   mean loss in the resample less the mean loss over all units.
3. `pair_moments`: mean difference and bootstrap variance of every pair of models as rows.
4. `eliminate`: rounds over a table with one row per (set, model). Which model leaves depends on the pair moments only, so all
   rounds are known before the statistics are needed.
5. `p_values`: the survivors of later rounds are subsets of those of earlier ones, so one pass over the resamples gives the statistic of
   every round as a running sum or maximum from the last round to the first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volarium.functions.scalars import keyed_uniform
from volarium.operators.ordering import number_rows, running_total
from volarium.session import BROADCAST_ROWS, Staged, attach, spread, stage

SLICE = 4096  # positions of a resample that one task draws
CHAIN = 12    # elimination rounds in one plan, before the state is written


@dataclass(frozen=True)
class Lengths:
    """Distinct numbers of positions (column t), and the largest of them."""

    table: DataFrame
    longest: int


def bootstrap_draws(rows: Staged | Lengths, n_boot: int, block: int, seed: int = 0, slice_rows: int = SLICE) -> DataFrame:
    """(b, pos, idx): the row drawn at each position of each resample.

    `rows` is a table with one row per position 0..t-1, or lengths, whose draws then carry t. A position starts a
    new block with probability 1/block (position 0 always does) at a uniform row; inside a block the row index grows by one
    and wraps around. Draws depend on (seed, b, pos) and t only, not on how the positions are sliced.
    """
    if isinstance(rows, Staged):
        lengths = rows.table.sparkSession.range(rows.rows, rows.rows + 1).select(F.col("id").alias("t"))  # no literal, which the window's keys would lose
        longest, keep = rows.rows, []
    else:
        lengths, longest, keep = rows.table.select(F.col("t").cast("long").alias("t")).distinct(), rows.longest, ["t"]
    boots = spread(lengths.where("t > 0").select("t", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")), "t", "b")
    last = ((F.col("t") - 1) / slice_rows).cast("long")
    slices = spread(boots.select("t", "b", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("slice")), "t", "b", "slice")
    first = F.col("slice") * slice_rows
    start = F.when(
        (F.col("pos") == 0) | (keyed_uniform(F.lit(f"r{seed}"), "b", "pos") < F.lit(1.0 / block)),
        F.floor(keyed_uniform(F.lit(f"s{seed}"), "b", "pos") * F.col("t")) - F.col("pos"))

    def positions(of: DataFrame) -> DataFrame:
        # Inside a block the index is start + (pos - start position), so filling start - position is enough.
        return of.select("*", F.explode(F.sequence(first, F.least(first + slice_rows, F.col("t")) - 1)).alias("pos")).withColumn("start", start)

    # No join: Spark takes what a generator makes for as small as the row before it, and would broadcast the positions.
    filled = F.col("start")
    if longest > slice_rows:
        opens = positions(slices).groupBy("t", "b", "slice").agg(F.max_by("start", F.when(F.col("start").isNotNull(), F.col("pos"))).alias("open"))
        before = Window.partitionBy("t", "b").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        slices = spread(opens.select("t", "b", "slice", F.last("open", ignorenulls=True).over(before).alias("carry")), "t", "b", "slice")
        filled = F.coalesce(filled, F.when(F.col("pos") == first, F.col("carry")))
    inside = Window.partitionBy("t", "b", "slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    base = F.last(filled, ignorenulls=True).over(inside)
    return positions(slices).select(*keep, "b", F.col("pos").cast("int").alias("pos"), F.pmod(base + F.col("pos"), F.col("t")).cast("int").alias("idx"))


def loss_matrix(losses: DataFrame, unit: str, models: Sequence[str], metric: str) -> Staged:
    """Wide losses with a 0-based position per unit (a ticker or a date): (pos, l0, l1, ...) in model order.

    All means must run over the same units: a unit that lacks a model's loss, or has NaN for it, is an error.
    """
    wide = losses.groupBy(unit).pivot("model", list(models)).agg(F.first(metric))
    named = wide.select(F.col(unit).alias("unit"), *[F.col(f"`{m}`").alias(f"l{k}") for k, m in enumerate(models)])
    numbered = number_rows(named, "unit", "pos")
    losses_ = [F.col(f"l{k}") for k in range(len(models))]
    lacking = numbered.table.where(F.greatest(*[F.when(c.isNull() | F.isnan(c), 1).otherwise(0) for c in losses_], F.lit(0)) > 0).count()
    if lacking:
        raise ValueError(f"{lacking} units lack the loss of a model")
    return Staged(numbered.table.withColumn("pos", F.col("pos").cast("int")).drop("unit"), numbered.rows)


def loss_vectors(losses: DataFrame, keys: Sequence[str], unit: str, models: Sequence[str], metric: str) -> tuple[Staged, Staged, Lengths]:
    """Units with their losses in model order, (set__, idx, t, l), and the sets with their mean losses, (set__, t, mean).

    `set__` is a struct of the key columns, null keys included. All means of a set must run over the same units: a unit that
    lacks a model's loss, or whose loss is not a finite number, is an error.
    """
    keyed = losses.select(F.struct(*keys, F.lit(0).alias("one__")).alias("set__"), F.col(unit).alias("unit__"), "model", F.col(metric).cast("double").alias("loss__"))
    wide = keyed.groupBy("set__", "unit__").pivot("model", list(models)).agg(F.first("loss__"))
    vectors = wide.select("set__", "unit__", F.array(*[F.col(f"`{m}`") for m in models]).alias("l"), F.lit(1).cast("long").alias("one__"))
    numbered = running_total(vectors, ["set__"], "unit__", "one__", "idx")
    odd = F.exists("l", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    means = F.array(*[F.avg(F.get("l", F.lit(m))) for m in range(len(models))])
    sets = stage(numbered.table.groupBy("set__").agg(F.count(F.lit(1)).alias("t"), F.count(F.when(odd, 1)).alias("lacking"), means.alias("mean")), "sets",
                 lacking=F.sum("lacking"), longest=F.max("t"))
    lacking, longest = sets.seen["lacking"], sets.seen["longest"]
    if lacking:
        raise ValueError(f"{lacking} units lack the loss of a model")
    units = attach(numbered.table.select("set__", "idx", "l"), Staged(sets.table.select("set__", "t"), sets.rows), ["set__"])
    return Staged(units, numbered.rows), Staged(sets.table.drop("lacking"), sets.rows), Lengths(sets.table.select("t"), longest or 0)


def resampled_excess(units: Staged, sets: Staged, draws: DataFrame, n_models: int) -> DataFrame:
    """(set__, b, e): for every resample the mean losses in model order, less those over all units."""
    drawn = attach(draws.select("t", "b", "idx"), units, ["t", "idx"], max_rows=BROADCAST_ROWS // max(1, n_models))
    sums = drawn.groupBy("set__", "b", "t").agg(*[F.sum(F.get("l", F.lit(m))).alias(f"s{m}") for m in range(n_models)])
    mean = F.array(*[F.col(f"s{m}") / F.col("t") for m in range(n_models)])
    small = Staged(sets.table.select("set__", F.col("mean").alias("all__")), sets.rows)
    return attach(sums.select("set__", "b", mean.alias("mean__")), small, ["set__"]).select("set__", "b", F.zip_with("mean__", "all__", lambda x, y: x - y).alias("e"))


def pair_moments(excess: DataFrame, sets: Staged, n_models: int) -> DataFrame:
    """(set__, i, j, dbar, variance) for i < j: the mean of loss(j) - loss(i), and its bootstrap variance."""
    first = excess.select("set__", "e", F.posexplode("e").alias("i", "ei"))
    both = first.select("set__", "i", "ei", F.posexplode(F.slice("e", F.col("i") + 2, n_models)).alias("after", "ej"))
    spread_ = both.groupBy("set__", "i", (F.col("i") + F.col("after") + 1).alias("j")).agg(F.avg((F.col("ej") - F.col("ei")) * (F.col("ej") - F.col("ei"))).alias("variance"))
    return attach(spread_, Staged(sets.table.select("set__", "mean"), sets.rows), ["set__"]).select(
        "set__", "i", "j", (F.get("mean", F.col("j")) - F.get("mean", F.col("i"))).alias("dbar"), "variance")


def check_arguments(alpha: float, n_boot: int, block: int, algorithm: str) -> None:
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must lie between 0 and 1, found {alpha}")
    if int(n_boot) != n_boot or n_boot < 1:
        raise ValueError(f"the number of resamples must be a whole number of at least 1, found {n_boot}")
    if int(block) != block or block < 1:
        raise ValueError(f"the block length must be a whole number of at least 1, found {block}")
    if algorithm not in ("R", "SQ"):
        raise TypeError(f"algorithm must be 'R' or 'SQ', found {algorithm!r}")


def _standardised(value: Column, variance: Column) -> Column:
    """value / sd; two models that never differ have no variance and no difference."""
    return (F.when(variance > 0, value / F.sqrt(variance)).when(value == 0, F.lit(0.0))
            .when(value > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))


def model_state(pairs: DataFrame, sets: Staged) -> DataFrame:
    """(set__, j, l, v): a model's mean loss and the variances of its differences to all models, itself (0) included, in model order."""
    own = sets.table.select("set__", F.posexplode("mean").alias("j", "l"))
    rows = (pairs.select("set__", "j", F.col("i").alias("other"), "variance").unionByName(pairs.select("set__", F.col("i").alias("j"), F.col("j").alias("other"), "variance"))
            .unionByName(own.select("set__", "j", F.col("j").alias("other"), F.lit(0.0).alias("variance"))))
    v = rows.groupBy("set__", "j").agg(F.transform(F.sort_array(F.collect_list(F.struct("other", "variance"))), lambda x: x["variance"]).alias("v"))
    return own.join(v, ["set__", "j"])


def eliminate(state: DataFrame, n_models: int, chain: int = CHAIN) -> Staged:
    """(set__, j, step): the round in which a model leaves its set, or n_models - 1 for the last survivor.

    A round drops the model with the largest standardised mean loss against the other survivors (the first of them if tied). With
    V(i, j) the variances of the differences between m survivors, the variance of model j's mean difference to the m - 1 others is
    (m * sum_i V(i, j) - sum_ij V(i, j) / 2) / (m - 1)^2, so a round needs the survivors' rows only, of all sets together.
    """
    whole = Window.partitionBy("set__").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = state.withColumn("step", F.lit(None).cast("int"))
    alive = F.col("step").isNull()
    for r in range(n_models - 1):
        m = n_models - r
        state = state.withColumn("peers", F.collect_list(F.when(alive, F.struct("j", "l"))).over(whole))
        state = state.withColumns({
            "gap": F.aggregate("peers", F.lit(0.0), lambda s, p: s + (F.col("l") - p["l"])) / (m - 1),
            "around": F.aggregate("peers", F.lit(0.0), lambda s, p: s + F.get("v", p["j"]))}).drop("peers")
        state = state.withColumn("total", F.sum(F.when(alive, F.col("around"))).over(whole))
        t = _standardised(F.col("gap"), (F.col("around") * m - F.col("total") / 2) / (m - 1) ** 2)
        state = state.withColumn("worst", F.max(F.when(alive, F.struct(t.alias("t"), (-F.col("j")).alias("j")))).over(whole))
        state = state.select("set__", "j", "l", "v", F.when(alive & (F.col("worst.j") == -F.col("j")), F.lit(r)).otherwise(F.col("step")).alias("step"))
        if r % chain == chain - 1:
            state = stage(state, "survivors").table
    return stage(state.select("set__", "j", F.coalesce("step", F.lit(n_models - 1)).alias("step")), "elimination")


def p_values(excess: DataFrame, pairs: DataFrame, steps: Staged, sets: Staged, algorithm: str) -> DataFrame:
    """(set__, step, raw_p): the share of resamples whose statistic over the survivors of a round exceeds the observed one.

    A pair takes part in all rounds up to the one in which its first model leaves.
    """
    at = lambda c: Staged(steps.table.select("set__", F.col("j").alias(c), F.col("step").alias(f"{c}_step")), steps.rows)
    timed = attach(attach(pairs, at("i"), ["set__", "i"]), at("j"), ["set__", "j"])
    z = _standardised(F.col("dbar"), F.col("variance"))
    peer = F.struct("i", "j", F.when(F.col("variance") > 0, 1 / F.sqrt("variance")).otherwise(0.0).alias("w"), F.abs(z).alias("z"))
    rounds = timed.groupBy("set__", F.least("i_step", "j_step").alias("step")).agg(F.sort_array(F.collect_list(peer)).alias("peers"))
    rounds = rounds.groupBy("set__").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "peers"))), lambda r: r["peers"]).alias("rounds"))
    zero = F.lit(0.0)
    one = (lambda s, x: F.greatest(s, x)) if algorithm == "R" else (lambda s, x: s + x * x)
    over = (lambda s, x: F.greatest(s, x)) if algorithm == "R" else (lambda s, x: s + x)

    def statistics(value) -> Column:
        """For every round the statistic over its pairs and those of all later rounds."""
        own = F.transform("rounds", lambda peers: F.aggregate(peers, zero, lambda s, p: one(s, value(p))))
        return F.transform(own, lambda _, k: F.aggregate(F.slice(own, k + 1, F.size("rounds")), zero, over))

    seen = rounds.select("set__", "rounds", statistics(lambda p: p["z"]).alias("seen"))
    drawn = attach(excess, Staged(seen, sets.rows), ["set__"]).select(
        "set__", "seen", statistics(lambda p: F.abs(F.get("e", p["j"]) - F.get("e", p["i"])) * p["w"]).alias("drawn"))
    hits = drawn.select("set__", F.posexplode(F.zip_with("drawn", "seen", lambda d, s: (d > s).cast("double"))).alias("step", "hit"))
    return hits.groupBy("set__", "step").agg(F.avg("hit").alias("raw_p"))


def excess_and_moments(losses: DataFrame, keys: Sequence[str], unit: str, models: Sequence[str], metric: str, n_boot: int, block: int, seed: int = 0) -> tuple[DataFrame, DataFrame, Staged]:
    """Resampled excess losses and pair moments, both written, and the sets."""
    units, sets, lengths = loss_vectors(losses, keys, unit, models, metric)
    excess = stage(resampled_excess(units, sets, bootstrap_draws(lengths, n_boot, block, seed), len(models)), "resamples").table
    return excess, stage(pair_moments(excess, sets, len(models)), "pair-moments").table, sets


def difference_moments(losses: DataFrame, keys: Sequence[str], unit: str, models: Sequence[str], metric: str, n_boot: int, block: int, seed: int = 0) -> DataFrame:
    """(keys, i, j, dbar, variance) for every ordered pair of model names: mean of loss(j) - loss(i) and its bootstrap variance."""
    pairs = excess_and_moments(losses, keys, unit, models, metric, n_boot, block, seed)[1]
    name = lambda c: F.get(F.array(*map(F.lit, models)), F.col(c)).alias(c)
    both = pairs.unionByName(pairs.select("set__", F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("dbar")).alias("dbar"), "variance"))
    return both.select(*[F.col("set__")[k].alias(k) for k in keys], name("i"), name("j"), "dbar", "variance")


def confidence_sets(losses: DataFrame, keys: Sequence[str], unit: str, models: Sequence[str], metric: str, alpha: float = 0.05,
                    n_boot: int = 10_000, block: int = 2, algorithm: str = "SQ", seed: int = 0) -> DataFrame:
    """(keys, model, step, p_value, included) for every set: elimination order with monotone bootstrap p-values.

    The last survivor has p-value 1. Sets with as many units use the same draws.
    """
    check_arguments(alpha, n_boot, block, algorithm)
    models = sorted(models)
    excess, pairs, sets = excess_and_moments(losses, keys, unit, models, metric, n_boot, block, seed)
    steps = eliminate(model_state(pairs, sets), len(models))
    raw = p_values(excess, pairs, steps, sets, algorithm)
    running = Window.partitionBy("set__").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    table = steps.table.join(raw, ["set__", "step"], "left").withColumn("p_value", F.max(F.coalesce("raw_p", F.lit(1.0))).over(running))
    name = F.get(F.array(*map(F.lit, models)), F.col("j")).alias("model")
    return table.select(*[F.col("set__")[k].alias(k) for k in keys], name, "step", "p_value", (F.col("p_value") > F.lit(alpha)).alias("included"))


def confidence_set(losses: DataFrame, unit: str, models: Sequence[str], metric: str, alpha: float = 0.05,
                   n_boot: int = 10_000, block: int = 2, algorithm: str = "SQ", seed: int = 0) -> DataFrame:
    """(model, step, p_value, included) of one set, all of `losses`."""
    return confidence_sets(losses, [], unit, models, metric, alpha, n_boot, block, algorithm, seed)


def confidence_reports(losses: DataFrame, keys: Sequence[str], unit: str, models: Sequence[str], baseline: str, metric: str,
                       shown: Sequence[str] | None = None, **kw) -> DataFrame:
    """Per set: mean loss, ratio to the baseline, average rank and confidence-set p-value of every model.

    `shown` names the models of the printed report in its order: others take part in ranks and test but are left out, and
    `place` (from 1) is a model's line.
    """
    from volarium.operators.evaluate import average_rank, ratio_to_baseline

    table = losses.groupBy(*keys, "model").agg(F.avg(metric).alias("loss"))
    table = average_rank(ratio_to_baseline(table, baseline, ["loss"], by=keys), "loss", "rank", by=keys)
    report = table.join(confidence_sets(losses, keys, unit, models, metric, **kw), [*keys, "model"])
    if shown is None:
        return report
    return report.withColumn("place", F.array_position(F.array(*map(F.lit, shown)), F.col("model")).cast("int")).where("place > 0")


def mcs_report(losses: DataFrame, unit: str, models: Sequence[str], baseline: str, metric: str, **kw) -> DataFrame:
    """Mean loss, ratio to the baseline, average rank and confidence-set p-value per model."""
    return confidence_reports(losses, [], unit, models, baseline, metric, **kw)
