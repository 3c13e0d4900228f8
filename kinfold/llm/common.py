"""What the operators of this package share: tables, written intermediates, gapless numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, shared_dir, table, written, written_by

__all__ = ["SPACE_CHARS", "SPACE_CLASS", "ascii_lower", "discard", "gapless", "shared_dir", "table", "written", "written_by"]

#: White space of the word contracts: space and \x09-\x0D, as a Java character class and as a list.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, _UPPER, _LOWER)


def gapless(df: DataFrame, group: str, order: list[str], out: str, spread: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Numbers the rows of each ``group`` 0, 1, 2 ... without one task per group.

    Rows are dealt to ``spread`` (by default as many as there are shuffle partitions, 64 at least) sub-buckets of their group by a hash of ``by`` (the order columns, unless
    said; fewer columns let the pass that counts read less); each sub-bucket is numbered alone and shifted by the counts of those before it. The table of counts has
    at most ``spread`` rows a group. Equal rows are interchangeable, so the numbers are a
    function of the row set up to such swaps."""
    sub = f"__sub_{out}"
    spread = spread or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn(sub, F.pmod(F.xxhash64(*(by or order)), F.lit(spread)).cast("int"))
    before = Window.partitionBy(group).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        dealt.groupBy(group, sub).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .select(F.col(group).alias("__g"), F.col(sub).alias("__s"), "__shift")
    )
    inside = Window.partitionBy(group, sub).orderBy(*order)
    return (
        dealt.withColumn("__at", F.row_number().over(inside) - 1)
        .join(shift, F.col(group).eqNullSafe(F.col("__g")) & (F.col(sub) == F.col("__s")))
        .withColumn(out, (F.col("__at") + F.col("__shift")).cast("long"))
        .drop(sub, "__at", "__g", "__s", "__shift")
    )
