"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations.

Each source's rows form blocks of equal size.  Of a source with share p of q, block i (from 0) is released in slot
floor(i * q / p) and due by the end of slot ceil((i + 1) * q / p) - 1.  Each slot goes to the released block that is due
first.  As the shares add up to the whole, every block gets a slot in its window, so at any time a source has had within
less than one block of its share of the slots.

The order of slots repeats after q slots.  So the schedule is made for one period, from the shares alone, and a block's
slot is looked up by its number; no row waits for another's.  When a source ends, the others go on in the proportions of
their shares, as a new phase; there are at most as many phases as sources.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .names import fresh

OTHER = "(other)"
#: Shares of the documents' sources in production; all other sources, and rows without one, share one place.
SHARES = {f"src{i}": (8, 4, 2, 1)[i // 5] for i in range(20)}


def period(shares: dict[str, int]) -> list[str]:
    """The source of each slot of one period: of the released blocks the one due first, ties by name."""
    q, done, slots = sum(shares.values()), dict.fromkeys(shares, 0), []
    for t in range(q):
        ready = [(-(-(done[s] + 1) * q // p), s) for s, p in shares.items() if done[s] * q // p <= t and done[s] < p]
        chosen = min(ready)[1]
        done[chosen] += 1
        slots.append(chosen)
    return slots


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[tuple[str, int, int, int, int, int, list[int]]]:
    """Rows (source, first block, end block, first slot, share, period, the share's slots in a period), phase by phase."""
    done, start, out = dict.fromkeys(blocks, 0), 0, []
    while active := {s: shares[s] for s, n in blocks.items() if n > done[s]}:
        part = gcd(*active.values())
        active = {s: p // part for s, p in active.items()}
        order, q = period(active), sum(active.values())
        own = {s: [t for t, x in enumerate(order) if x == s] for s in active}
        last = {s: (blocks[s] - done[s] - 1) // p * q + own[s][(blocks[s] - done[s] - 1) % p] for s, p in active.items()}
        end = min(last.values()) + 1
        for s, p in active.items():
            got = end // q * p + sum(t < end % q for t in own[s])
            if got:
                out.append((s, done[s], done[s] + got, start, p, q, own[s]))
            done[s] += got
        start += end
    return out


def mix_sources(df: DataFrame, shares: dict[str, int], other_share: int = 1, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 16, seed: str = "0", digits: int = 3) -> DataFrame:
    """df with mix_group, mix_block, mix_place, mix_slot: rows in the order of (mix_slot, mix_place) are the mixture.

    shares: a positive whole number for each source; sources it does not name, and null, count as one more group,
    ``(other)``.  Rows of a group come in the order of the digest of seed and id, and equal ids in that of a hash of their
    rows; null ids come first.  Each block has block_rows rows, but a group's last may have fewer.  Every row is
    kept, with all columns; only columns of df named like the four are replaced.  An empty df gives an empty result.

    Numbering is by counts of 16 ** digits parts of each group, so no group is numbered in one task.  The counts of the at
    most len(shares) + 1 groups go to the driver, and the schedule of at most sum(shares) slots for each phase comes back;
    its size follows from the shares alone, whatever the size of df.
    """
    spark = df.sparkSession
    names = ["mix_group", "mix_block", "mix_place", "mix_slot"]
    df = df.drop(*names)
    digest, part, count, before, number, phases_, phase = fresh(df, "digest", "part", "count", "before", "number", "phases", "phase")
    group = F.when(F.col(source_col).isin(*shares), F.col(source_col)).otherwise(F.lit(OTHER))
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    keyed = df.withColumns({"mix_group": group, digest: hashed}).withColumn(part, F.substring(digest, 1, digits))
    parts = keyed.groupBy("mix_group", part).agg(F.count("*").alias(count))
    earlier = F.sum(count).over(Window.partitionBy("mix_group").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("mix_group", part, F.coalesce(earlier, F.lit(0)).alias(before))
    totals = {r[0]: -(-r[1] // block_rows) for r in keyed.groupBy("mix_group").agg(F.count("*")).collect()}
    plan = phases(totals, {OTHER: other_share} | shares)
    schedule = spark.createDataFrame(plan, "mix_group string, low long, high long, start long, share long, period long, slots array<long>")
    schedule = schedule.groupBy("mix_group").agg(F.collect_list(F.struct("low", "high", "start", "share", "period", "slots")).alias(phases_))
    # So that a task that runs again numbers rows of one id as before; maps have no hash.
    own_hash = F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if "map" not in f.dataType.simpleString()))
    place = F.row_number().over(Window.partitionBy("mix_group", part).orderBy(digest, id_col, own_hash)) - 1 + F.col(before)
    rows = keyed.join(offsets, ["mix_group", part]).withColumn(number, place.cast("long"))
    rows = rows.withColumns({"mix_block": F.expr(f"{number} div {block_rows}"), "mix_place": F.expr(f"{number} % {block_rows}")})
    own = F.filter(phases_, lambda p: (p["low"] <= F.col("mix_block")) & (F.col("mix_block") < p["high"]))[0]
    rows = rows.join(F.broadcast(schedule), "mix_group").withColumn(phase, own)
    slot = F.expr(f"{phase}.start + ((mix_block - {phase}.low) div {phase}.share) * {phase}.period + {phase}.slots[cast((mix_block - {phase}.low) % {phase}.share AS int)]")
    return rows.withColumn("mix_slot", slot).select(*(F.col(f"`{c}`") for c in df.columns), *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the production mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs, SHARES).select("doc_id", "mix_group", "mix_block", "mix_place", "mix_slot")


#: The schedule slot by slot, as a recursion over all sources' states.
ORACLE_SQL = """
WITH RECURSIVE keyed AS (
  SELECT doc_id, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
    CASE WHEN regexp_full_match(source, 'src(1?[0-9])') THEN source ELSE '(other)' END AS g FROM documents
), numbered AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY digest, doc_id NULLS FIRST) - 1 AS r FROM keyed
), sources AS (
  SELECT g, CASE WHEN g = '(other)' THEN 1 ELSE [8, 4, 2, 1][CAST(substr(g, 4) AS INT) // 5 + 1] END AS p,
    CAST(ceil(count(*) / 16.0) AS BIGINT) AS n FROM numbered GROUP BY g
), steps AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS t0, g, p, n, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS base, false AS won, CAST(-1 AS BIGINT) AS block FROM sources
  UNION ALL
  SELECT t + 1, CASE WHEN ended THEN t + 2 ELSE t0 END, g, p, n, done + CAST(won AS BIGINT), CASE WHEN ended THEN done + CAST(won AS BIGINT) ELSE base END, won, done
  FROM (
    SELECT *, coalesce(bool_or(won AND done + 1 = n) OVER (), false) AS ended FROM (
      SELECT t, t0, g, p, n, done, base, ready AND row_number() OVER (ORDER BY ready DESC, due, g) = 1 AS won FROM (
        SELECT t, t0, g, p, n, done, base, done < n AND (done - base) * q // p <= t + 1 - t0 AS ready, -((-(done - base + 1) * q) // p) AS due0,
          ((done - base + 1) * q + p - 1) // p AS due
        FROM (SELECT *, CAST(sum(CASE WHEN done < n THEN p ELSE 0 END) OVER () AS BIGINT) AS q, sum(n - done) OVER () AS open FROM steps) WHERE open > 0))
  )
)
SELECT doc_id, r.g AS mix_group, r.r // 16 AS mix_block, r.r % 16 AS mix_place, s.t AS mix_slot
FROM numbered r JOIN steps s ON s.g = r.g AND s.won AND s.block = r.r // 16
"""
