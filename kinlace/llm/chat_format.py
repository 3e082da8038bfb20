"""Chat formatting with DataFrame functions only.

A declarative template names the control strings around a turn, the roles that carry loss, and a
finite-state machine over roles. Each turn is escaped on its own before turns of a conversation
meet, so the only thing gathered per conversation is the output itself.

Escaping is reversible and touches control strings only: behind the first character of a control
string in a text goes one backslash more than stood there already, and reading takes one away.

Defined cases: a null text is an empty text; a null role is the role ''; roles that the machine does
not know keep their name and make the conversation invalid; rows with equal turn numbers stand in
the order of (role, text), nulls first (texts as escaped); a null conv_id is a conversation of its own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlace.llm.tables import table


@dataclass(frozen=True)
class Template:
    """start + role + sep + text + end for each turn."""

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    #: Strings that a model reads as control strings too, so that texts must not contain them bare.
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}; the machine begins in "begin".
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "prompted", "user": "asked"},
            "prompted": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def controls(self) -> tuple[str, ...]:
        return (self.start, self.sep, self.end, *self.reserved)

    def pattern(self, escaped: bool) -> str:
        """Groups: first character, backslashes that stay, rest."""
        firsts = "".join(sorted({re.escape(c[0]) for c in self.controls()}))
        rests = "|".join(re.escape(c[1:]) for c in sorted(set(self.controls()), key=lambda c: (-len(c), c)))
        return rf"([{firsts}])" + (r"\\" if escaped else "") + rf"(\\*)({rests})"


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, template.pattern(False), r"$1\\$2$3")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, template.pattern(True), "$1$2$3")


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>, valid,
    first_bad_turn (0-based position of the first row that the machine refuses, or null)."""
    t = template or Template()
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            escape(F.coalesce(F.col("text").cast("string"), F.lit("")), t).alias("text"),
        ).alias("row"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    step = F.create_map(*[F.lit(x) for state, moves in t.machine.items() for r, to in moves.items() for x in (f"{state}>{r}", to)])
    walked = F.aggregate(
        "rows",
        F.struct(F.lit("begin").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad")),
        lambda s, row: F.struct(
            F.coalesce(step[F.concat(s["state"], F.lit(">"), row["role"])], F.lit("refused")).alias("state"),
            (s["n"] + 1).alias("n"),
            F.coalesce(s["bad"], F.when(step[F.concat(s["state"], F.lit(">"), row["role"])].isNull(), s["n"])).alias("bad"),
        ),
    )
    parts = F.flatten(
        F.transform(
            "rows",
            lambda row: F.array(
                F.struct(F.concat(F.lit(t.start), escape(row["role"], t), F.lit(t.sep)).alias("text"), F.lit(False).alias("loss")),
                F.struct(row["text"].alias("text"), row["role"].isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return (
        grouped.withColumn("end", walked)
        .withColumn("segments", parts)
        .select(
            "conv_id",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
            (F.col("end.bad").isNull() & F.col("end.state").isin(*t.final)).alias("valid"),
            F.col("end.bad").alias("first_bad_turn"),
        )
    )


def parse_formatted(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted text, as array<struct<role, text>>: the inverse of the formatting."""
    t = template or Template()
    # every turn begins with the start string, which no escaped text contains
    bodies = F.filter(F.split(formatted, re.escape(t.start)), lambda _, i: i > 0)

    def turn(body: Column) -> Column:
        cut = F.instr(body, t.sep)
        text = F.substring(body, cut + len(t.sep), F.length(body) - cut - (len(t.sep) + len(t.end)) + 1)
        return F.struct(unescape(F.substring(body, F.lit(1), cut - 1), t).alias("role"), unescape(text, t).alias("text"))

    return F.transform(bodies, turn)


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back from the formatted text."""
    t = Template()
    source = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    out = format_conversations(source.unionByName(probe), t)
    read = out.withColumn("turns", parse_formatted(F.col("formatted"), t))
    # what a trainer would see: the segments whose flag is set
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    return read.withColumn("loss_text", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.coalesce("first_bad_turn", F.lit(-1)).cast("long").alias("first_bad_turn"),
    )


def _sql_escape(column: str, t: Template) -> str:
    pattern = t.pattern(False).replace("'", "''")
    return rf"regexp_replace({column}, '{pattern}', '\1\\\2\3', 'g')"


def op1_sql() -> str:
    t = Template()
    fixed = len(t.start + t.sep + t.end)
    # in this machine, the state before a row is decided by the row before it
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
), placed AS (
  SELECT *, {_sql_escape('text', t)} AS esc,
    row_number() OVER w - 1 AS n,
    lag(role) OVER w AS before
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {_sql_escape('text', t)})
), judged AS (
  SELECT *, CASE role
      WHEN 'system' THEN before IS NULL
      WHEN 'user' THEN before IS NULL OR (before = 'system' AND n = 1) OR before = 'assistant'
      WHEN 'assistant' THEN coalesce(before = 'user', false)
      ELSE false END AS fine
  FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({fixed} + length({_sql_escape('role', t)}) + length(esc))::BIGINT AS formatted_chars,
  bool_and(fine) AND arg_max(role, n) = 'assistant' AS valid,
  coalesce(min(n) FILTER (NOT fine), -1)::BIGINT AS first_bad_turn
FROM judged GROUP BY conv_id
"""
