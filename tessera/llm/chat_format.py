"""Chat formatting from a declarative template, with a loss flag for each segment, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles are trained on, and in which order roles may follow each other.

    A turn is ``before + role + between + text + after``.  Role and text are written with ``escapes``, which replace each
    character that occurs in a mark, and the escape character itself, by the escape character and a letter: no mark
    can then occur within a text, and the replacement can be undone.  ``steps`` is a finite-state machine: (state, role)
    to state; roles that it does not name lead to the state ``error``, which nothing leaves.
    """

    before: str = "<turn "
    between: str = ">"
    after: str = "</turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    steps: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "briefed"),
        ("start", "user", "asked"),
        ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )


def _escaped(c: Column, t: Template) -> Column:
    for plain, code in t.escapes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _unescaped(c: Column, t: Template) -> Column:
    for plain, code in reversed(t.escapes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_conversations(df: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, final_state, valid and segments (array of text and loss), one row for each conversation.

    The output of a conversation is its segments' texts one after the other; loss is true for the texts of the template's
    loss roles and for nothing else.  Turns come in the order of turn, null turns first, ties by role and text.  Null
    texts and roles count as empty.  Rows with a null conv_id form one conversation.  Invalid conversations are formatted
    like others and marked by ``valid``.  Repeated rows are repeated turns.  Other columns are ignored.
    """
    t = template
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    steps = F.create_map(*[F.lit(x) for state, role, to in t.steps for x in (f"{state} {role}", to)])
    state = F.aggregate("turns", F.lit(t.start), lambda now, x: F.coalesce(F.try_element_at(steps, F.concat(now, F.lit(" "), x["role"])), F.lit("error")))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    written = lambda x: F.array(
        segment(F.concat(F.lit(t.before), _escaped(x["role"], t), F.lit(t.between)), F.lit(False)),
        segment(_escaped(x["text"], t), x["role"].isin(*t.loss_roles)),
        segment(F.lit(t.after), F.lit(False)),
    )
    return grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.alias("final_state"), F.flatten(F.transform("turns", written)).alias("segments")).withColumn("valid", F.col("final_state").isin(*t.accepting))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns, array of role and text, that a formatted conversation holds."""
    t = template
    pieces = F.split(formatted, r"\Q" + t.after + r"\E")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, t.between, 1)
        text = F.substring(piece, F.length(role) + F.lit(len(t.between) + 1), F.length(piece))
        return F.struct(_unescaped(F.substring(role, F.lit(len(t.before) + 1), F.length(role)), t).alias("role"), _unescaped(text, t).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: _unescaped(s["text"], template)), "")


PROBE = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like marks, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    out = format_conversations(rows.unionByName(probe))
    out = out.select("conv_id", "valid", "segments", formatted_text(F.col("segments")).alias("formatted"), loss_text(F.col("segments")).alias("loss"))
    turns = read_back(F.col("formatted"))
    return out.withColumn("turns", turns).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS escaped,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(escaped + 15) AS BIGINT) AS formatted_chars,
    string_agg(letter, '' ORDER BY turn NULLS FIRST, role, text) AS letters
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(letters, 's?(ua)+') AS valid FROM g
"""
