"""Readers of the raw sources and writers of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_source(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """Tab-separated records under our own column names, whatever the header says; empty fields stay empty strings."""
    df = spark.read.csv(path, sep="\t", header=True, schema=RAW, enforceSchema=True, nullValue="\0", emptyValue="", quote="")
    df = df.na.fill("")
    return df if limit is None else df.limit(limit)


def read_column(spark: SparkSession, path: str | list[str], column: str = "entity_id") -> DataFrame:
    """One column of the tab-separated records; the others aren't parsed."""
    return read_source(spark, path).select(column)


def read_tables(spark: SparkSession, *paths: str, columns: list[str] | None = None, where: dict[str, list] | None = None) -> DataFrame:
    """Several Parquet files or folders as one table. ``columns`` alone are read, and ``where`` (column: the values it may have) goes down to the scan."""
    df = spark.read.parquet(*paths)
    for column, values in (where or {}).items():
        df = df.filter(F.col(column).isin(list(values)))
    return df.select(*columns) if columns else df


def registered(spark: SparkSession, table, name: str) -> DataFrame:
    """An Arrow or pandas table as a relation that SQL can name."""
    df = spark.createDataFrame(table)
    df.createOrReplaceTempView(name)
    return df


def read_truth(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """s1_id, cand_id of the true matches; ids (entity_id) restricts them."""
    df = spark.read.csv(path, sep="\t", header=True, schema=TRUTH, enforceSchema=True, quote="").filter("matched_entity_ids IS NOT NULL AND matched_entity_ids <> ''")
    if ids is not None:
        df = df.join(ids.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    each = df.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("c"))
    return each.select("s1_id", F.trim("c").alias("cand_id")).filter("cand_id <> ''")


def with_row_order(df: DataFrame) -> DataFrame:
    """Adds the file (``__file``) and the place within it (``__row``, a struct of where the split begins and a growing number), for results in file order. For
    tables read from files, before any shuffle."""
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    return df.select("*", F.col("_metadata.file_path").alias("__file"), place.alias("__row"))


def canonical_text(df: DataFrame) -> DataFrame:
    """Adds ``text``: name | address, lower-cased, white space collapsed; an empty address is said to be unknown."""
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "))
    address = tidy("business_address")
    return df.withColumn("text", F.concat(tidy("business_name"), F.lit(" | "), F.when(address == "", "unknown address").otherwise(address)))


def in_file_order(lines: DataFrame, source: DataFrame, key: str = "source1_entity_id") -> DataFrame:
    """``lines`` in the order of the source's rows. source: ``with_row_order`` of a table that has entity_id."""
    order = source.select(F.col("entity_id").alias(key), "__file", "__row")
    return lines.join(order, key).orderBy("__file", "__row").drop("__file", "__row")


def match_lines(ids: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """One line for every id, its sorted partners joined by commas (empty if none)."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("cand_id")), ",").alias(column))
    return ids.select(F.col("entity_id").alias("source1_entity_id")).join(lists.withColumnRenamed("s1_id", "source1_entity_id"), "source1_entity_id", "left").select("source1_entity_id", F.coalesce(column, F.lit("")).alias(column))


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, shard: int | None = None) -> str:
    """Parquet with zstd; a shard gets a folder of its own. Spark's commit makes a finished folder visible at once."""
    to = path if shard is None else f"{path}/shard={shard}"
    (df if columns is None else df.select(*columns)).write.mode("overwrite").option("compression", "zstd").parquet(to)
    return to


def write_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Tab-separated with a header, null as empty; sorted by ``order`` if it is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def append_table(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table, which may not be there yet."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def versioned(path: str, version: int | str) -> str:
    """A folder for each version of what makes a table, so that tables of an older one are never read."""
    return f"{path.rstrip('/')}/version={version}"


def write_one_file(df: DataFrame, path: str) -> None:
    """Tab-separated with a header in one file, in the rows' order. For results of a line a record; all rows pass one task."""
    df.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="", quote="")


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def run_shards(spark: SparkSession, s1: DataFrame, shards: int, path: str, work) -> DataFrame:
    """Runs ``work`` on each hash shard of the reference records, skipping those that an earlier run finished, and reads all."""
    from ..functions.text import bucket

    for i in range(shards):
        to = f"{path}/shard={i}"
        if not finished(spark, to):
            write_table(work(s1.filter(bucket(F.col("entity_id"), shards, "shard") == i)), path, shard=i)
    return spark.read.parquet(path)


def exclusive(truth: DataFrame) -> DataFrame:
    """One row: records of the truth and how many of them have several owners."""
    owners = truth.groupBy("cand_id").agg(F.count(F.lit(1)).alias("n"))
    return owners.agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("n") > 1, 1)).alias("shared"))


def validate(ids: DataFrame, matches: DataFrame, candidates: DataFrame, pool: DataFrame) -> dict[str, int]:
    """Counts of what is wrong with results: ids without or with several lines, matches outside the candidates,
    partners that the pool lacks, pool records with several owners. All zero is valid."""
    each = lambda df, c: df.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split(c, ",")).alias("cand_id")).filter("cand_id <> ''")
    m, c = each(matches, "matched_entity_ids"), each(candidates, "candidate_entity_ids")
    known = ids.select(F.col("entity_id").alias("source1_entity_id"))
    return {
        "missing": known.join(matches, "source1_entity_id", "left_anti").count(),
        "repeated": matches.groupBy("source1_entity_id").count().filter("count > 1").count(),
        "not_candidates": m.join(c, ["s1_id", "cand_id"], "left_anti").count(),
        "unknown": m.join(pool.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_anti").count(),
        "owners": m.groupBy("cand_id").count().filter("count > 1").count(),
    }
