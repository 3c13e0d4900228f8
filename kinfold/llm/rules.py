"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document; the ledger keeps one failure bit a rule beside the
measurements. Policies are versioned masks over those bits, so that applying one, changing one or asking what a rule
costs (its ablation) reads the ledger and never the texts. Built-in expressions only; a document's words meet in
arrays of their own row, so there is no shuffle and no skew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, table

SYMBOL_CLASS = r"[#*$%&|<>]"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """``fails`` maps a lookup of measurements to a condition; the rule's place in the list is its bit."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Policy:
    version: int
    name: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        at = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << at[n] for n in self.rules)


RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("word_chars")),
    Rule("repeated_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
)
BASE = Policy(1, "base", ("few_words", "repeated_words"))
FULL = Policy(2, "full", tuple(r.name for r in RULES))
POLICIES = (BASE, FULL)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements (long) of the whole text; null counts as empty. Columns of these names are replaced.

    n_repeat_words counts the words that lie in a window of three words which the text holds twice or more. Windows are
    compared by 64-bit hashes: sorted with their positions, equal neighbours are the repeated ones."""
    keep = [c for c in df.columns if c not in MEASURES and not c.startswith("__")]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*keep, body.alias("__text"), F.split(F.btrim(body, F.lit(SPACE_CHARS)), f"{SPACE_CLASS}+").alias("__w"))
    rows = rows.select(
        *keep, "__text",
        F.filter(F.split("__text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("__lines"),
        F.when(F.get("__w", F.lit(0)) == "", F.lit(0)).otherwise(F.size("__w")).alias("__n"),
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"),
    )
    rows = rows.select(
        *keep,
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__text", f"{SPACE_CLASS}+", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", f"{SYMBOL_CLASS}+", ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.col("__n") > WINDOW,
            F.zip_with(
                F.zip_with(F.slice("__h", F.lit(1), F.col("__n") - 2), F.slice("__h", F.lit(2), F.col("__n") - 2), lambda a, b: F.xxhash64(a, b)),
                F.slice("__h", F.lit(3), F.col("__n") - 2),
                lambda ab, c: F.xxhash64(ab, c),
            ),
        ).alias("__g"),
    )
    done = [*keep, *MEASURES[:5]]
    rows = rows.select(
        *done,
        F.when(
            F.size(F.array_distinct("__g")) < F.size("__g"), F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ).alias("__s"),
    )
    same = lambda x, at: F.coalesce(F.get("__s", at)["h"] == x["h"], F.lit(False))
    repeated = F.filter("__s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    rows = rows.select(*done, F.sort_array(F.transform(repeated, lambda x: x["i"])).alias("__p"))
    gaps = F.zip_with(
        F.slice("__p", F.lit(2), F.size("__p") - 1), F.slice("__p", F.lit(1), F.size("__p") - 1), lambda later, p: F.least(later - p, F.lit(WINDOW))
    )
    covered = F.when(F.col("__p").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x))
    # A filter over the result must not be pushed below, where it would repeat the arrays' expressions inside their
    # own lambdas; the optimizer leaves a projection with a partition's number alone.
    return rows.select(*done, F.when(F.spark_partition_id() >= 0, covered.cast("long")).alias("n_repeat_words"))


def ledger(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``df`` with the measurements and ``failures``: bit i is set if rule i fails. A row is measured by its own text alone, so rows that
    repeat get the same entry; null text counts as empty, texts are read whole, an empty table gives an empty result. Columns of the measurements'
    names, and of names that begin with two underscores, are replaced or left out; others stay."""
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(r.fails(F.col), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(df, text).withColumn("failures", bits)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule of it: ``failed`` documents, ``alone`` (those that only this rule rejects, which come
    back without it), and ``with_rules``: the other failures of the failed ones, OR-ed. Entries shrink to one row
    for each pattern of bits before anything else."""
    patterns = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    what = F.array(*[
        F.struct(F.lit(p.version).alias("version"), F.lit(p.name).alias("policy"), F.lit(r.name).alias("rule"),
                 F.lit(1 << i).cast("long").alias("bit"), F.lit(p.mask(rules)).cast("long").alias("mask"))
        for p in policies for i, r in enumerate(rules) if r.name in p.rules
    ])
    each = patterns.select("failures", "n", F.explode(what).alias("x")).select("failures", "n", "x.*")
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    fails = hit.bitwiseAND(F.col("bit")) != 0
    return each.groupBy("version", "policy", "rule", "bit").agg(
        F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(hit == F.col("bit"), F.col("n"))), F.lit(0)).alias("alone"),
        F.coalesce(F.bit_or(F.when(fails, hit.bitwiseXOR(F.col("bit")))), F.lit(0)).alias("with_rules"),
    ).drop("bit")


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document and its verdict under the base and the full policy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), passes(FULL).alias("kept"), "n_lines", "failures",
    )


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), a AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM a)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), c AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM a LEFT JOIN c USING (rid)
), f AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > word_chars)::BIGINT
    + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT)::BIGINT AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
  failures = 0 AS kept, n_lines, failures FROM f
"""
