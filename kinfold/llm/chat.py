"""Chat formatting: a finite-state machine over roles and a declarative template.

All of it is built-in expressions. The rows of a conversation meet in one sorted array, which is no
larger than the text that the conversation becomes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class ChatTemplate:
    """``begin open role close text end`` for each turn.

    ``loss_roles`` are trained on. ``transitions`` maps (state, role) to the next state; a turn with no
    entry is out of order, and the machine goes on from that role's own state. ``accepting`` are the
    states in which a conversation may end."""

    begin: str = "<s>"
    open: str = "[INST]"
    close: str = "[/INST]"
    end: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.open, self.close, self.end)

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or "\\" in c or c[0] in c[1:]:
                raise ValueError(f"control string {c!r}: two characters at least, no backslash, first character once")

    def escape(self, text: Column) -> Column:
        """Doubles backslashes and puts one behind the first character of each control string, so that
        no control string is left. ``unescape`` undoes exactly that."""
        parts = "|".join(f"{re.escape(c[0])}(?={_quote(c[1:])})" for c in self.controls)
        return F.regexp_replace(text, rf"\\|{parts}", r"$0\\")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quote(text: str) -> str:
    """A Java regular expression for the literal text."""
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def format_conversations(df: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per ``conv_id``: ``formatted`` text, its ``segments`` (text, loss) in order, ``n_turns``,
    and the machine's finding: ``valid``, ``error_turn`` (position from 0 of the first turn that is out of
    order; null if none) and ``complete`` (it ends in an accepting state).

    Needs conv_id, turn, role, text; other columns are ignored. Null text and null role count as empty;
    a null turn sorts first; equal turns sort by role, then text; rows without conv_id form one
    conversation of their own; rows that repeat are turns of their own. Texts are taken whole at any length. Conversations that break the
    order are formatted too and flagged. An empty table gives an empty result."""
    t = template or ChatTemplate()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = df.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.concat(F.lit(t.begin + t.open), t.escape(role), F.lit(t.close)).alias("head"),
            t.escape(text).alias("body"),
            role.isin(*t.loss_roles).alias("loss"),
        ).alias("r"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("turns"))
    step = F.create_map(*[F.lit(x) for (s, r), to in t.transitions.items() for x in (f"{s}\n{r}", to)])
    known = sorted({s for s, _ in t.transitions} | set(t.transitions.values()))

    def move(acc: Column, x: Column) -> Column:
        to = F.try_element_at(step, F.concat(acc["state"], F.lit("\n"), x["role"]))
        resync = F.when(x["role"].isin(*known), x["role"]).otherwise(F.lit(t.start))
        return F.struct(
            F.coalesce(to, resync).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.when(acc["bad"].isNull() & to.isNull(), acc["at"]).otherwise(acc["bad"]).alias("bad"),
        )

    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(x["head"], F.lit(False)), segment(x["body"], x["loss"]), segment(F.lit(t.end), F.lit(False))
            ),
        )
    )
    return (
        grouped.select("conv_id", F.size("turns").alias("n_turns"), F.aggregate("turns", begin, move).alias("fsm"), segments.alias("segments"))
        .select(
            "conv_id",
            "n_turns",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
            F.col("fsm.bad").isNull().alias("valid"),
            F.col("fsm.bad").alias("error_turn"),
            F.col("fsm.state").isin(*t.accepting).alias("complete"),
        )
    )


def parse_formatted(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (role, text) that a formatted text holds: the inverse of ``format_conversations``."""
    t = template or ChatTemplate()
    pieces = F.filter(F.split(formatted, _quote(t.end)), lambda p: F.startswith(p, F.lit(t.begin + t.open)))
    skip = len(t.begin + t.open) + 1

    def turn(p: Column) -> Column:
        return F.struct(
            t.unescape(F.substr(F.split_part(p, F.lit(t.close), F.lit(1)), F.lit(skip))).alias("role"),
            t.unescape(F.split_part(p, F.lit(t.close), F.lit(2))).alias("text"),
        )

    return F.transform(pieces, turn)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and number -7, whose texts hold the template's own control strings; the digests
    are read back from the formatted text and the loss mask."""
    control = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = format_conversations(rows)
    back = out.select(
        "conv_id",
        parse_formatted(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: ChatTemplate.unescape(s["text"])), "").alias("lost"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "error_turn",
        "complete",
    )
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "error_turn",
        "complete",
    )


#: The same rows in DuckDB: digests from the source rows, the machine as a test of neighbouring roles.
OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER w - 1 AS pos, lag(role) OVER w AS prev,
    length(role) + length(text) + 20
    + (length(text) - length(replace(text, '\', '')))
    + (length(role) - length(replace(role, '\', '')))
    + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]'))
    + len(regexp_extract_all(role, '<s>|</s>|\[INST\]|\[/INST\]')) AS width
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, NOT ((prev IS NULL AND role IN ('system', 'user')) OR (prev = 'system' AND role = 'user')
    OR (prev = 'user' AND role = 'assistant') OR (prev = 'assistant' AND role = 'user')
    OR (prev NOT IN ('system', 'user', 'assistant') AND role IN ('system', 'user'))) AS bad
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  sum(width)::BIGINT AS formatted_chars,
  NOT bool_or(bad) AS valid,
  min(CASE WHEN bad THEN pos END)::INTEGER AS error_turn,
  arg_max(role, pos) = 'assistant' AS complete
FROM f GROUP BY conv_id
"""
