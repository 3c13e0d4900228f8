"""Choosing each record's set of matches, and one owner for each pool record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

PAIR = ["s1_id", "cand_id"]
CAP = 30  # pairs of a record that the exact cut weighs


def _ranked(probs: DataFrame) -> DataFrame:
    return probs.withColumn("k", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("p"), "cand_id")))


def select_approximate(probs: DataFrame, mass: DataFrame | None = None) -> DataFrame:
    """The k that maximizes 1.25 x (sum of the k largest p) / (k + 0.25 x mass), or none if no match at all is
    likelier than that. mass: s1_id, e_m, by default the sum of p. Returns the chosen pairs."""
    order = Window.partitionBy("s1_id").orderBy("k")
    per = Window.partitionBy("s1_id")
    d = _ranked(probs)
    d = d.withColumn("e_m", F.sum("p").over(per)) if mass is None else d.join(mass, "s1_id", "left").na.fill(0.0, ["e_m"])
    d = d.withColumn("score", 1.25 * F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)) / (F.col("k") + 0.25 * F.col("e_m")))
    none = F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-12)))).over(per))
    best = F.max(F.struct(F.col("score"), (-F.col("k")).alias("less"))).over(per)  # of equal scores the smaller k
    return d.withColumn("best", best).withColumn("none", none).filter((F.col("none") <= F.col("best.score")) & (F.col("k") <= -F.col("best.less"))).select(*PAIR, "p")


def _convolve(dist: Column, p: Column) -> Column:
    """The distribution of a count (array) after one more independent event of probability p."""
    zero = F.array(F.lit(0.0))
    return F.zip_with(F.concat(dist, zero), F.concat(zero, dist), lambda stay, move: stay * (1.0 - p) + move * p)


def expected_f05(ps: Column) -> Column:
    """ps: descending probabilities, at most ``CAP``. Array of struct(k, e): the exact expected F0.5 of choosing
    the first k, k = 0 .. n, with pairs independent. Entry 0 is the chance that there is no match."""
    start = F.array(F.array(F.lit(1.0)))
    grown = lambda xs: F.aggregate(xs, start, lambda rows, p: F.array_append(rows, _convolve(F.element_at(rows, -1), p)))
    n = F.size(ps)

    def values(both: Column) -> Column:  # both is bound, so that no distribution is computed again for another k
        def value(k: Column) -> Column:
            hits, rest = F.element_at(both["first"], k + 1), F.element_at(both["last"], n - k + 1)
            inner = lambda a, h: F.aggregate(F.transform(rest, lambda b, r: a * b * 1.25 * h / (k + 0.25 * (h + r))), F.lit(0.0), lambda t, y: t + y)
            e = F.aggregate(F.transform(hits, inner), F.lit(0.0), lambda t, y: t + y)
            return F.struct(k.alias("k"), F.when(k == 0, F.element_at(rest, 1)).otherwise(e).alias("e"))

        return F.transform(F.sequence(F.lit(0), n), value)

    # Of each number of likeliest pairs and of each number of the others: how many hits there are, each list from the one before it.
    both = F.struct(grown(ps).alias("first"), grown(F.reverse(ps)).alias("last"))
    return F.element_at(F.transform(F.array(both), values), 1)


def select_exact(probs: DataFrame, cap: int = CAP) -> DataFrame:
    """The first k with the largest exact expected F0.5 (strictly better than any fewer). Returns the chosen pairs."""
    first = _ranked(probs).filter(F.col("k") <= cap)
    lists = first.groupBy("s1_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("ps"))
    scored = lists.withColumn("es", expected_f05(F.col("ps")))
    start = F.struct(F.lit(0).alias("k"), F.lit(-1.0).cast("double").alias("e"))
    cut = F.aggregate("es", start, lambda a, x: F.when(x["e"] > a["e"], x).otherwise(a))["k"]
    return first.join(scored.select("s1_id", cut.alias("cut")), "s1_id").filter("k <= cut").select(*PAIR, "p")


def select_threshold(probs: DataFrame, at: float) -> DataFrame:
    return probs.filter(F.col("p") >= at).select(*PAIR, "p")


def losers(chosen: DataFrame) -> DataFrame:
    """Claims that give way: a pool record stays with the likeliest claimant, then the smaller s1_id."""
    owner = F.row_number().over(Window.partitionBy("cand_id").orderBy(F.desc("p"), "s1_id"))
    return chosen.withColumn("o", owner).filter("o > 1").select(*PAIR)


def repair(probs: DataFrame, select=select_exact, rounds: int = 5, mode: str = "accumulate") -> DataFrame:
    """Chosen pairs in which every pool record has one owner at most, after at most ``rounds``.

    ``accumulate``: removed claims stay removed, and only records that lost one choose again. ``restart``: each round
    chooses from the full list without that round's losers. Every round is checkpointed; the driver sees one count."""
    shared_dir(probs.sparkSession)  # sets a folder for checkpoints in a local session; a cluster names its own
    left, chosen = probs, select(probs)
    for _ in range(rounds):
        chosen = chosen.checkpoint()
        out = losers(chosen).checkpoint()
        if out.isEmpty():
            break
        if mode == "restart":
            chosen = select(probs.join(out, PAIR, "left_anti"))
            continue
        left = left.join(out, PAIR, "left_anti")
        hurt = out.select("s1_id").distinct()
        chosen = chosen.join(hurt, "s1_id", "left_anti").unionByName(select(left.join(hurt, "s1_id", "left_semi")))
    return chosen


def f05(chosen: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """s1_id, k (chosen), m (true), h (both), f05; nothing chosen and nothing true counts 1. ids: s1_id."""
    count = lambda df, out: df.groupBy("s1_id").agg(F.count(F.lit(1)).alias(out))
    each = ids.join(count(chosen, "k"), "s1_id", "left").join(count(truth, "m"), "s1_id", "left").join(count(chosen.join(truth, PAIR, "left_semi"), "h"), "s1_id", "left").na.fill(0, ["k", "m", "h"])
    score = F.when((F.col("k") == 0) & (F.col("m") == 0), 1.0).when(F.col("h") == 0, 0.0).otherwise(1.25 * F.col("h") / (F.col("k") + 0.25 * F.col("m")))
    return each.withColumn("f05", score)


def error_taxonomy(scored: DataFrame) -> DataFrame:
    """category, n, lost (thousandths of F0.5) of ``f05`` rows with a country, by category and country."""
    kind = (
        F.when(F.col("f05") == 1, "right").when((F.col("m") == 0) & (F.col("k") > 0), "false match").when((F.col("m") > 0) & (F.col("k") == 0), "missed all")
        .when(F.col("h") == 0, "all wrong").when(F.col("h") < F.col("k"), "some wrong").otherwise("too few")
    )
    return scored.withColumn("category", kind).groupBy("category", "country").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(1 - F.col("f05")), 6).alias("lost"))
