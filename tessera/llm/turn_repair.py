"""Repair of conversations: which turns to keep, to give another role, to delete and to insert, at the lowest cost.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant.  Turns stay in order.
The cheapest edits are a shortest path over retained turns.  Between two of them lie deletions, whose costs are
differences of prefix sums, and inserts, which the roles of the two determine.  With the sum up to a turn taken off its
cost, a deletion changes nothing: for each role of the last retained turn the least such cost so far is kept, and a new
retained turn is priced from these four minima (none, system, user, assistant).

Among equal costs the audit that comes first as text counts.  An audit has one letter for each turn besides inserts, and
costs follow from its letters, so of two audits up to the same turn neither begins the other; their order for the
four minima is all that later turns need.

Conversations are cut into pieces of a bounded number of turns.  A piece gives, for each pair of roles before and after it, the
least cost and the order of audits.  Pieces of a long conversation are combined in runs, level by level, and
the roles between them then come back from above; so no task holds a conversation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle
from .scratch import saved, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"s": "system", "u": "user", "a": "assistant"}
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What is appended to an audit at a turn, in the order of texts.
STEPS = ("D", "IK", "IR", "K", "R")
#: Roles that end a conversation need these inserts.
ENDINGS = {NONE: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
#: Characters that make no word.
BLANK = " \t\n\x0b\x0c\r"
#: Characters of a text by which turns of one number and role are ordered before its hash is.
BEGIN = 200
_INF = 1 << 40
_LETTERS = " sua"


def _steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each kind of turn (first letter of its role by 3, plus 0 sound, 1 truncated, 2 to be deleted), last role, and ways to it: role before, cost less that of deletion, step."""
    before, cost, step = np.zeros((12, 4, 5), np.int64), np.full((12, 4, 5), _INF), np.zeros((12, 4, 5), np.int64)
    inserts = {(NONE, SYSTEM): 0, (NONE, USER): 0, (SYSTEM, USER): 0, (USER, USER): 1, (ASSISTANT, USER): 0, (NONE, ASSISTANT): 1, (SYSTEM, ASSISTANT): 1, (USER, ASSISTANT): 0, (ASSISTANT, ASSISTANT): 1}
    for kind in range(12):
        own, state = divmod(kind, 3)
        for to in range(4):
            before[kind, to], cost[kind, to, 0] = to, 0
            if to == NONE or state == 2 or (to == SYSTEM and own != SYSTEM):
                continue
            for slot, (role, _) in enumerate(((p, t) for p, t in inserts if t == to), 1):
                kept, n = own == to, inserts[role, to]
                before[kind, to, slot] = role
                cost[kind, to, slot] = INSERT * n + (KEEP if kept else REROLE) + TRUNCATED * state - DELETE
                step[kind, to, slot] = STEPS.index("I" * n + ("K" if kept else "R"))
    return before, cost, step


_BEFORE, _COST, _STEP = _steps()


def _order(sub: np.ndarray) -> np.ndarray:
    """The place of each of the last axis' numbers, from 0."""
    return np.argsort(np.argsort(sub, axis=-1, kind="stable"), axis=-1, kind="stable")


def _passed(kinds: np.ndarray, start: np.ndarray, length: np.ndarray, value: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least costs and orders of audits after all pieces, turn by turn; and each turn's way to each role.

    Pieces come with the longest first.  value and rank: pieces x entries x roles.
    """
    way = np.zeros((len(kinds), *value.shape[1:]), np.int8)
    for t in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t))  # pieces longer than t
        kind = kinds[start[:n] + t]
        before = np.broadcast_to(_BEFORE[kind][:, None], (n, value.shape[1], 4, 5))
        of = lambda x: np.take_along_axis(x[:n, :, None, :], before, axis=3)  # noqa: E731, B023
        key = ((of(value) + _COST[kind][:, None]) << 5) + (of(rank) << 3) + _STEP[kind][:, None]
        best = key.argmin(axis=3)[..., None]
        chosen = np.take_along_axis(key, best, axis=3)[..., 0]
        value[:n], rank[:n] = np.minimum(chosen >> 5, _INF), _order(chosen & 31)
        way[start[:n] + t] = (np.take_along_axis(before, best, axis=3)[..., 0] << 3) + (chosen & 7)
    return value, rank, way


def _ended(value: np.ndarray, rank: np.ndarray) -> int:
    """The last role of the cheapest whole conversation."""
    cost = value + np.array([INSERT * len(ENDINGS[s]) for s in range(4)])
    return int(np.lexsort((rank, cost))[0])


def _pieces(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order; first row and length of each piece, the longest first; and the same of rows' kinds."""
    pdf = pdf.sort_values("at", ignore_index=True)
    edge = np.flatnonzero((pdf["conv"] != pdf["conv"].shift()) | (pdf["piece"] != pdf["piece"].shift()))
    length = np.diff(np.append(edge, len(pdf)))
    order = np.argsort(-length, kind="stable")
    return pdf, edge[order], length[order], pdf["kind"].to_numpy(np.int64)


def _start(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and orders before a piece, for pieces x entries of roles."""
    value = np.where(np.arange(4) == entries[..., None], 0, _INF)
    return value, np.broadcast_to(np.arange(4), value.shape).copy()


_NODE = "conv string, num long, m long, v array<long>, r array<int>, exit int"


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, start, length, kinds = _pieces(pdf)
    value, rank, _ = _passed(kinds, start, length, *_start(np.tile(np.arange(4), (len(start), 1))))
    ends = [_ended(value[i, NONE], rank[i, NONE]) for i in range(len(start))]
    return pd.DataFrame({"conv": pdf["conv"].to_numpy()[start], "piece": pdf["piece"].to_numpy()[start], "v": list(value.reshape(-1, 16)), "r": list(rank.reshape(-1, 16).astype(np.int32)), "exit": np.array(ends, np.int32)})


def _over(nodes: pd.DataFrame, value: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Costs and orders (entries x roles) after a run of nodes; and for each node and role after it the role before."""
    ways = []
    for v, r in zip(nodes["v"], nodes["r"], strict=True):
        key = ((value[:, :, None] + np.reshape(v, (1, 4, 4))) << 4) + (rank[:, :, None] << 2) + np.reshape(r, (1, 4, 4))
        best = key.argmin(axis=1)
        chosen = np.take_along_axis(key, best[:, None], axis=1)[:, 0]
        value, rank = np.minimum(chosen >> 4, _INF), _order(chosen & 15)
        ways.append(best)
    return value, rank, ways


def _combined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("num")
    value, rank, _ = _over(pdf, *_start(np.arange(4)))
    return pd.DataFrame({"conv": [key[0]], "num": [key[1]], "m": pdf["m"].iloc[:1].to_numpy(), "v": [value.ravel()], "r": [rank.ravel().astype(np.int32)], "exit": np.array([_ended(value[NONE], rank[NONE])], np.int32)})


def _parted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Roles before and after each node of a run, from those of the run."""
    pdf = pdf.sort_values("num")
    _, _, ways = _over(pdf, *_start(np.array([int(pdf["p"].iloc[0])])))
    role, before, after = int(pdf["q"].iloc[0]), [], []
    for way in reversed(ways):
        after.append(role)
        role = int(way[0, role])
        before.append(role)
    return pd.DataFrame({"conv": key[0], "num": pdf["num"].to_numpy(), "p": np.array(before[::-1], np.int32), "q": np.array(after[::-1], np.int32)})


def _edited(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edits of each row: letters, and the roles that they are about."""
    pdf, start, length, kinds = _pieces(pdf)
    _, _, way = _passed(kinds, start, length, *_start(pdf["p"].to_numpy(np.int64)[start][:, None]))
    role, steps, after = pdf["q"].to_numpy(np.int64)[start], np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    for t in reversed(range(int(length[0]))):
        n = int(np.searchsorted(-length, -t))
        own = way[start[:n] + t, 0, role[:n]].astype(np.int64)
        steps[start[:n] + t], after[start[:n] + t] = own & 7, role[:n]
        role[:n] = own >> 3
    other = {"s": "", "u": "a", "a": "u"}
    made = [(STEPS[s], "-" if s == 0 else (other[_LETTERS[r]] if STEPS[s][0] == "I" else "") + _LETTERS[r]) for s, r in zip(steps.tolist(), after.tolist(), strict=True)]
    letters, roles = [x[0] for x in made], [x[1] for x in made]
    for i, n, whole in zip(start, length, pdf["last"].to_numpy()[start], strict=True):
        if whole:
            ending = ENDINGS[int(after[i + n - 1])]
            letters[i + n - 1] += "I" * len(ending)
            roles[i + n - 1] += ending
    return pd.DataFrame({"at": pdf["at"], "letters": letters, "roles": roles, "fault": pdf["fault"]})


def _roles_between(pieces: DataFrame, fan: int) -> DataFrame:
    """conv, piece, last, and the roles p before and q after each piece on its conversation's cheapest path."""
    by = Window.partitionBy("conv")
    numbered = saved(pieces.withColumns({"num": F.row_number().over(by.orderBy("piece")).cast("long") - 1, "m": F.count("*").over(by)}), "repair-pieces", pieces)
    out = numbered.where("m = 1").select("conv", "piece", F.lit(True).alias("last"), F.lit(NONE).alias("p"), F.col("exit").alias("q"))
    most = numbered.agg(F.max("m")).first()[0] or 0
    if most < 2:
        return out
    levels, run = [numbered.where("m > 1")], F.shiftright("num", fan)
    while most > 1:
        open_runs = levels[-1].where("m > 1").select("conv", "num", "m", "v", "r", run.alias("run"))
        combined = open_runs.groupBy("conv", "run").applyInPandas(_combined, _NODE).withColumn("m", F.shiftright(F.col("m") + ((1 << fan) - 1), fan))
        levels.append(saved(combined, "repair-level"))
        most = -(-most // (1 << fan))
    known = None
    for below, level in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        tops = level.where("m = 1").select("conv", F.col("num").alias("run"), F.lit(NONE).alias("p"), F.col("exit").alias("q"))
        known = tops if known is None else tops.union(known.select("conv", F.col("num").alias("run"), "p", "q"))
        parts = below.where("m > 1").withColumn("run", run).join(known, ["conv", "run"])
        known = parts.groupBy("conv", "run").applyInPandas(_parted, "conv string, num long, p int, q int")
    return out.union(numbered.join(known, ["conv", "num"]).select("conv", "piece", (F.col("num") == F.col("m") - 1).alias("last"), "p", "q"))


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def edited_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = 10, task: int = 4, fan: int = 6) -> DataFrame:
    """conv (a key of the id), at, turn, role, text, fault (0 none, 1 blank, 2 duplicate, 3 truncated), letters and roles of each row of df.

    letters are the row's edits: of inserts before it (I), itself (K, R or D), and, at the end of a conversation, inserts after it;
    roles are the roles that these give, - for a deletion.  Rows are in the order of at: by turn, null first, then by role and the
    text's first BEGIN characters, and then by a hash of it.  Null roles and texts count as one space.  A null id is a conversation of its own.  Other columns are not
    read.  An empty df gives an empty result.  piece, task and fan: turns of a piece, pieces of a task, and pieces that are
    combined at once, as powers of two.
    """
    blank = F.lit(" ")
    rows = df.select(_key(F.col(f"`{conv_col}`")).alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), blank).alias("role"), F.coalesce(F.col(f"`{text_col}`"), blank).alias("text"))
    # Ranges are cut by values of a bounded size; equal rows are dealt out by their number.
    order = ["conv", "turn", "role", "begin", "h", "uid"]
    rows = rows.withColumns({"begin": F.left("text", F.lit(BEGIN)), "h": F.xxhash64("text"), "uid": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    facts = saved(ranged.select("conv", F.monotonically_increasing_id().alias("at"), "turn", "role", "text"), "repair-turns")
    worded = F.rtrim(F.col("text"), F.lit(BLANK))
    small = facts.select("conv", "at", F.substring("role", 1, 1).alias("initial"), (worded == "").alias("blank"), (~F.right(worded, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.xxhash64("conv", "role", "text").alias("h"), F.xxhash64(F.lit("second"), "text", "role", "conv").alias("h2"))
    # Written, so that a join deals out both sides by hash: Spark then splits a turn that a conversation repeats very often.
    firsts = saved(small.groupBy("h", "h2").agg(F.min("at").alias("first"), F.max("at").alias("again")).where("first < again").select("h", "h2", "first"), "repair-firsts")
    fault = F.when(F.col("blank"), 1).when(F.col("first") < F.col("at"), 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(F.col("initial") == "a", ASSISTANT).otherwise(NONE)
    found = small.join(firsts, ["h", "h2"], "left").select("conv", "at", fault.alias("fault"), initial.alias("own"))
    state = F.when(F.col("fault").isin(1, 2), 2).when(F.col("fault") == 3, 1).otherwise(0)
    # The first letter "none" has no place in _steps' roles, so no role is kept for it.
    kinds = saved(found.select("conv", "at", F.shiftright("at", piece).alias("piece"), "fault", (F.col("own") * 3 + state).alias("kind")), "repair-kinds", firsts)
    run = F.shiftright("piece", task).alias("task")
    pieces = kinds.groupBy(run).applyInPandas(_summed, "conv string, piece long, v array<long>, r array<int>, exit int")
    between = saved(_roles_between(saved(pieces, "repair-sums"), fan), "repair-roles")
    edits = kinds.join(between, ["conv", "piece"]).groupBy(run).applyInPandas(_edited, "at long, letters string, roles string, fault int")
    return facts.join(edits, "at")


def repaired_turns(edited: DataFrame) -> DataFrame:
    """conv, at, place, role and text of the turns of repaired conversations, in the order of at and place."""
    each = edited.select("conv", "at", "role", "text", F.posexplode(F.arrays_zip(F.split("letters", "").alias("letter"), F.split("roles", "").alias("to"))).alias("place", "e")).where("e.letter <> 'D'")
    named = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[F.col("e.to")]
    return each.select("conv", "at", "place", F.when(F.col("e.letter") == "K", F.col("role")).otherwise(named).alias("role"), F.when(F.col("e.letter") == "I", "").otherwise(F.col("text")).alias("text"))


class _Summary:
    """What one conversation adds up to, row by row in order; the texts go into the digest and are not kept."""

    def __init__(self, conv: str):
        self.conv, self.faults, self.cost, self.illegal, self.turns = conv, [0, 0, 0, 0], 0, 0, 0
        self.first = self.last = self.initial = None
        self.audit, self.digest, self.begun = [], hashlib.sha256(), False

    def add(self, turn: int | None, role: str, text: str, letters: str, roles: str, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if turn is not None:
            self.turns += self.turns == 0 or turn != self.last
            self.first, self.last = turn if self.turns == 1 else self.first, turn
        self.audit.append(letters)
        self.cost += (fault == 3 and "D" not in letters) + sum((DELETE if x == "D" else 0 if x == "K" else REROLE) for x in letters)
        for letter, to in zip(letters, roles, strict=True):
            if letter != "D":
                self.digest.update(b"\n" * self.begun + (role if letter == "K" else ROLES[to]).encode() + b":")
                self.begun = True
                if letter != "I":
                    self.digest.update(text.encode())

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


_SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(edited: DataFrame, convs: DataFrame) -> DataFrame:
    """Counts of faults, cost, audit and digest of the repaired text for each key of convs; zeros for one without rows.

    A digest is made from its conversation's bytes in order, so a conversation's rows pass through one task, sorted by Spark;
    the task holds a batch of them, and the audit, which is a value of the result.
    """
    small_batches(edited.sparkSession)
    columns = ["conv", "at", "turn", "role", "text", "letters", "roles", "fault"]
    empty = convs.select("conv", F.lit(None).cast("long").alias("at"), *(F.lit(None).cast(edited.schema[c].dataType).alias(c) for c in columns[2:]))
    rows = edited.select(*columns).union(empty).repartition("conv").sortWithinPartitions("conv", "at")
    schema = pa.schema([(f.split()[0], pa.string() if f.split()[1] == "string" else pa.int64()) for f in _SUMMARY.split(", ")])

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv, at, *values in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Summary(conv)
                if at is not None:
                    now.add(*values)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(run, _SUMMARY)


def damaged(df: DataFrame) -> DataFrame:
    """The rows of conversations after the damage that tests a repair: some dropped, emptied, cut, repeated, or of another role."""
    space = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    rows = df.withColumn("code", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).where("code <> 0")
    changed = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(text("role"))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    convs = rows.select(_key(F.col("conv_id")).alias("conv")).distinct()
    out = summaries(edited_turns(damaged(rows)), convs)
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, 40)).cast(rows.schema["conv_id"].dataType)
    return out.select(conv_id.alias("conv_id"), *out.columns[1:])


def _sql_way(before: str, to: str, inserted: str = "") -> str:
    kept, full = f"own = '{to}'", ROLES[to]
    text = "".join(f" || chr(10) || '{ROLES[x]}:'" for x in inserted)
    return f"""{{'c': {before}.c + {INSERT * len(inserted)} + CASE WHEN {kept} THEN 0 ELSE {REROLE} END + CASE fault WHEN 3 THEN {TRUNCATED} ELSE 0 END,
      'a': {before}.a || '{"I" * len(inserted)}' || CASE WHEN {kept} THEN 'K' ELSE 'R' END, 't': {before}.t{text} || chr(10) || CASE WHEN {kept} THEN role ELSE '{full}' END || ':' || text}}"""


def _sql_least(to: str, *ways: str) -> str:
    gone = f"{{'c': {to}.c + {DELETE}, 'a': {to}.a || 'D', 't': {to}.t}}"
    return f"list_sort(CASE WHEN fault IN (1, 2) THEN [{gone}] ELSE [{', '.join([gone, *ways])}] END)[1]"


def _sql_end(of: str, inserted: str = "") -> str:
    text = "".join(f" || chr(10) || '{ROLES[x]}:'" for x in inserted)
    return f"{{'c': {of}.c + {INSERT * len(inserted)}, 'a': {of}.a || '{'I' * len(inserted)}', 't': {of}.t{text}}}"


_NEVER = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
#: Whole audits and texts for each last role, turn by turn.
ORACLE_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT coalesce('=' || conv_id, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {oracle.crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations
), d AS (
  SELECT conv, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, (VALUES (0), (1)) v(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)
), k AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS k FROM d
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ \t-\r]*$') THEN 3 ELSE 0 END AS fault,
    substr(role, 1, 1) AS own, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY k) AS prior FROM k
), w AS (
  SELECT DISTINCT conv, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS n, {_NEVER} AS s, {_NEVER} AS u, {_NEVER} AS a FROM raw
  UNION ALL SELECT w.conv, f.k, {_sql_least('n')}, CASE WHEN own = 's' THEN {_sql_least('s', _sql_way('n', 's'))} ELSE {_sql_least('s')} END,
    {_sql_least('u', _sql_way('n', 'u'), _sql_way('s', 'u'), _sql_way('u', 'u', 'a'), _sql_way('a', 'u'))},
    {_sql_least('a', _sql_way('n', 'a', 'u'), _sql_way('s', 'a', 'u'), _sql_way('u', 'a'), _sql_way('a', 'a', 'u'))}
  FROM w JOIN f ON f.conv = w.conv AND f.k = w.k + 1
), e AS (
  SELECT conv, list_sort([{_sql_end('n')}, {_sql_end('s', 'ua')}, {_sql_end('u', 'a')}, {_sql_end('a')}])[1] AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv ORDER BY k DESC) = 1
), g AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE prior || own NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv
)
SELECT nullif(substr(conv, 2), '')::BIGINT AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM e LEFT JOIN g USING (conv)
"""
