"""Training rows for scorers and encoders, and what a run's output looks like by threshold and country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .selection import PAIR


def _shuffled(salt: str) -> Column:
    """An order of pairs that is the same on every run and machine."""
    return F.md5(F.concat(F.lit(salt), "s1_id", F.lit("-"), "cand_id"))


def _first(pairs: DataFrame, n: int, salt: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(_shuffled(salt), "cand_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= n)


def training_pairs(truth: DataFrame, from_percent: int = 70) -> DataFrame:
    """s1_id, cand_id: one true partner for each reference record whose bucket of 100 is below ``from_percent``; the
    others are held out."""
    return _first(truth.filter(T.bucket(F.col("s1_id"), 100) < from_percent), 1, "pair").select(*PAIR)


def training_negatives(candidates: DataFrame, truth: DataFrame, n: int = 3) -> DataFrame:
    """s1_id, cand_id, rank: up to n candidates of each record that aren't its matches. They come from the candidate
    lists, so no pairs are made for this."""
    return _first(candidates.select(*PAIR).join(truth, PAIR, "left_anti"), n, "negative").select(*PAIR, "rank")


def rescored_mass(probs: DataFrame, rescored: DataFrame) -> DataFrame:
    """s1_id, e_m: the expected number of matches with the probabilities of ``rescored`` in place of the older ones."""
    new = rescored.select(*PAIR, F.col("p").alias("newer"))
    return probs.join(new, PAIR, "left").groupBy("s1_id").agg(F.sum(F.coalesce("newer", "p")).alias("e_m"))


def threshold_sweep(probs: DataFrame, truth: DataFrame, ids: DataFrame, percents: tuple[int, ...]) -> DataFrame:
    """percent, f05: the macro F0.5 of choosing every pair of at least that probability, over all of ``ids`` (s1_id).

    A record with nothing above the threshold is right if it has no match; such records are counted, not listed."""
    spark = probs.sparkSession
    steps = sorted(percents)
    true = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("m"))
    n, matchless = ids.join(true, "s1_id", "left").agg(F.count(F.lit(1)), F.count(F.when(F.col("m").isNull(), 1))).first()
    hit = probs.join(truth.select(*PAIR).withColumn("hit", F.lit(1)), PAIR, "left")
    passed = sum(((F.col("p") >= x / 100.0).cast("int") for x in steps), F.lit(0))  # how many thresholds a pair passes: the lowest ones
    counts = hit.groupBy("s1_id", passed.alias("passed")).agg(F.count(F.lit(1)).alias("k"), F.count("hit").alias("h")).filter("passed > 0")
    lists = counts.groupBy("s1_id").agg(F.collect_list(F.struct("passed", "k", "h")).alias("x"))  # a list is no longer than the thresholds
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("least"), F.lit(x).alias("percent")) for i, x in enumerate(steps, 1)])).alias("t")
    over = lambda field: F.aggregate(F.filter("x", lambda y: y["passed"] >= F.col("least")), F.lit(0).cast("long"), lambda t, y: t + y[field]).alias(field)
    sets = lists.select("s1_id", "x", each).select("s1_id", "x", "t.*").select("s1_id", "percent", over("k"), over("h")).filter("k > 0").join(true, "s1_id", "left")
    score = F.when(F.col("h") == 0, 0.0).otherwise(1.25 * F.col("h") / (F.col("k") + 0.25 * F.coalesce("m", F.lit(0))))
    sums = sets.groupBy("percent").agg(F.sum(score).alias("s"), F.count(F.when(F.col("m").isNull(), 1)).alias("wrong"))
    right = F.coalesce("s", F.lit(0.0)) + F.lit(matchless) - F.coalesce("wrong", F.lit(0))
    whole = spark.range(1).select(F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    return whole.join(sums, "percent", "left").select("percent", F.round(right / F.lit(max(n, 1)), 6).alias("f05"))


def country_summary(chosen: DataFrame, s1: DataFrame) -> DataFrame:
    """country, records, pairs, largest (most matches of a record), empty (records without a match)."""
    sizes = chosen.groupBy(F.col("s1_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("k"))
    each = s1.select("entity_id", "country").join(sizes, "entity_id", "left").na.fill(0, ["k"])
    return each.groupBy("country").agg(F.count(F.lit(1)).alias("records"), F.sum("k").alias("pairs"), F.max("k").alias("largest"), F.count(F.when(F.col("k") == 0, 1)).alias("empty"))


def plain_text(text: Column) -> Column:
    """Accents off, lower case, everything but letters and digits one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), T.ACCENTED, T.PLAIN), "[^a-z0-9]+", " "))


def suffixed_text(text: Column) -> Column:
    """The same with the usual words for legal forms and streets in one spelling; an ampersand between letters is ``and``."""
    plain = F.regexp_replace(F.translate(F.lower(text), T.ACCENTED, T.PLAIN), r"(?<=[a-z0-9_])&(?:amp;)?(?=[a-z0-9_])", " and ")
    known = F.create_map(*[F.lit(x) for pair in T.PROTOTYPE_FORMS.items() for x in pair])
    return F.trim(F.regexp_replace(F.array_join(F.transform(F.split(plain, "[^a-z0-9]+"), lambda w: F.coalesce(F.try_element_at(known, w), w)), " "), " +", " "))


def sample_rows(df: DataFrame, n: int, key: str, salt: str = "sample") -> DataFrame:
    """n rows, the same on every run: those with the smallest hash of ``key``. A bounded sort, no full one."""
    return df.orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key).limit(n)


def country_batches(pairs: DataFrame, countries: DataFrame, size: int, salt: str = "batch") -> DataFrame:
    """Adds country, batch and place: training pairs in batches of one country each, in an order that is the same on every run. The last batch of a
    country is left out if it isn't full. pairs: s1_id, cand_id; countries: s1_id, country."""
    keyed = pairs.join(countries, "s1_id").withColumn("h", _shuffled(salt)).withColumn("sub", F.substring("h", 1, 2))
    # A country's order is that of its hashes: numbered by their first two digits apart and shifted, so a country that holds most pairs is 256 groups.
    counts = keyed.groupBy("country", "sub").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("country").orderBy("sub")
    shift = counts.select("country", "sub", (F.sum("n").over(upto) - F.col("n")).alias("shift"), F.sum("n").over(Window.partitionBy("country")).alias("total"))
    inside = F.row_number().over(Window.partitionBy("country", "sub").orderBy("h", "cand_id")) - 1
    dealt = keyed.withColumn("inside", inside).join(shift, ["country", "sub"]).withColumn("at", F.col("inside") + F.col("shift"))
    dealt = dealt.withColumn("batch", F.floor(F.col("at") / size).cast("int")).withColumn("place", (F.col("at") % size).cast("int"))
    return dealt.filter((F.col("batch") + 1) * size <= F.col("total")).select("country", "batch", "place", *PAIR)
