"""URL filters as a sort-merge range join.

A host's labels are reversed and ended by \\x01 each, so that "this host and its subdomains" is one interval of
keys: from the host's own key up to the same key ended by \\x02. Hosts of rules nest or are disjoint. Rows and
the intervals' ends are sorted together; the sweep carries the stack of rules that are active from the
last end on, and a row takes the longest rule of its stack whose path fits.

Only built-in expressions and windows are used. The sweep runs in range partitions of the sorted keys (a page
id breaks ties, so that equal urls spread); what is active at a partition's start is the last end
before it, carried from partition to partition in a table with one row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table, written


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block"):
            raise ValueError(self.verdict)


#: The rules of the registered query.
CONTRACT_RULES = (
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end. The group is atomic: a url without a path has none, whatever
    its query holds."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*(/[^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


def rule_table(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    """host, path, verdict. Large rule lists come as a DataFrame of these columns instead."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    each = F.explode(F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in rules]))
    return spark.range(1).select(each.alias("r")).select("r.*")


def boundaries(rules: DataFrame) -> DataFrame:
    """Where the set of active rules changes: ``key`` and the ``stack`` (array of rule, path, verdict, rhost) that
    holds from there on. At a host's start these are the rules of the host and of its
    parents, at its end those of its parents."""
    r = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        ascii_lower(F.col("host")).alias("rhost"),
        F.struct(
            F.concat("host", "path").alias("rule"), "path", "verdict", ascii_lower(F.col("host")).alias("rhost")
        ).alias("item"),
    )
    own = r.groupBy("rhost").agg(F.collect_set("item").alias("items"))
    labels = F.split("rhost", r"\.")
    ups = own.select("rhost", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up"))
    chain = ups.join(own.select(F.col("rhost").alias("up"), "items"), "up").groupBy("rhost").agg(
        F.flatten(F.collect_list("items")).alias("stack"),
        F.flatten(F.collect_list(F.when(F.col("up") != F.col("rhost"), F.col("items")))).alias("outer"),
    )
    key = host_key(F.col("rhost"))
    starts = chain.select(key.alias("key"), "stack")
    ends = chain.select(F.concat(F.substr(key, F.lit(1), F.length(key) - 1), F.lit("\x02")).alias("key"), F.col("outer").alias("stack"))
    return starts.unionByName(ends)


def judge_urls(df: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", tie: str = "page_id") -> DataFrame:
    """Adds host, path, rule (null where none fits) and verdict (``default`` where none fits); columns of these names are replaced, others stay.

    The longest rule wins (host and path together), then the smaller rule text, then ``block``. A null url, or one without
    ``://``, has an empty host and path and so no rule but one for the empty host. No rows are lost or
    repeated, equal urls are judged alike, urls are read at any length, an empty table gives an empty result; rules in bounded number a host, as the stack of a key holds the rules of its parent hosts."""
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    rows = df.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    at = boundaries(rules)
    nothing = at.schema["stack"].dataType
    events = rows.select(
        host_key(F.col("host")).alias("__key"), F.lit(1).alias("__kind"), F.xxhash64(tie, "path").alias("__tie"),
        F.lit(None).cast(nothing).alias("__stack"), F.struct(*rows.columns).alias("__row"),
    ).unionByName(
        at.select(
            F.col("key").alias("__key"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__tie"),
            F.col("stack").alias("__stack"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType).alias("__row"),
        )
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["__key", "__kind", "__tie"]
    dealt, _ = written(events.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "urls")
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("__seen", F.last("__stack", ignorenulls=True).over(inside)).filter("__kind = 1")
    # One row a range partition: the stack after its last end, carried over partitions that have none.
    tail = dealt.groupBy("__part").agg(F.max_by("__stack", F.when(F.col("__kind") == 0, F.struct("__key", "__tie"))).alias("__tail"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = tail.select("__part", F.last("__tail", ignorenulls=True).over(before).alias("__carry"))
    fits = lambda x: F.startswith(F.col("path"), x["path"]) & (
        (F.col("host") == x["rhost"]) | F.endswith(F.col("host"), F.concat(F.lit("."), x["rhost"]))
    )
    ranked = lambda x: F.struct((-F.length(x["rule"])).alias("n"), x["rule"].alias("rule"), (x["verdict"] != "block").alias("later"), x["verdict"].alias("verdict"))
    return (
        swept.join(F.broadcast(carry), "__part")
        .select(F.coalesce("__seen", "__carry").alias("__active"), "__row.*")
        .withColumn("__best", F.array_min(F.transform(F.filter(F.coalesce("__active", F.array().cast(nothing)), fits), ranked)))
        .select(*keep, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the five rules; a url without a rule is allowed."""
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(urls, rule_table(spark, CONTRACT_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest
), hit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(hit.verdict, 'allow') AS verdict FROM u LEFT JOIN hit USING (page_id)
"""
