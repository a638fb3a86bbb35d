"""Dead letters and what becomes of them: pending, reprocessed or abandoned.

Transitions are rows that are appended, and a letter's state follows from all of its rows in any
order: reprocessed if one says so, else abandoned if one does, else pending with as many attempts
as replays have failed. So replays that run at the same time, or twice, can neither take a letter
back from a final state nor lose an attempt.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.parsers import PARSERS, parse
from millrace.sources.store import append, load, matching
from millrace.staging import discard, stage
from millrace.streaming.ingest import absorb, dated

LETTER = ["tenant", "dead_letter_id"]
MAX_ATTEMPTS = 5


@dataclass(frozen=True)
class Replayed:
    read: int
    recovered: int
    failed: int
    abandoned: int


def states(spark: SparkSession, root: str) -> DataFrame | None:
    """Every dead letter with its state, attempts and the reason of the last failed attempt."""
    letters = load(spark, f"{root}/dead_letters")
    if letters is None:
        return None
    once = letters.drop("state", "day", "hour").dropDuplicates(LETTER)
    moves = load(spark, f"{root}/dead_letter_moves")
    if moves is None:
        return once.withColumn("state", F.lit("pending")).withColumn("attempts", F.lit(0).cast("long"))
    became = moves.groupBy(*LETTER).agg(
        F.bool_or(F.col("move") == "reprocessed").alias("_done"), F.bool_or(F.col("move") == "abandoned").alias("_left"), F.countDistinct(F.when(F.col("move") == "failed", F.col("replay_id"))).alias("_attempts"),
        F.max_by(F.when(F.col("move") == "failed", F.col("reason")), F.when(F.col("move") == "failed", F.col("at_us"))).alias("_reason"),
    )
    out = once.join(became, LETTER, "left")
    state = F.when(F.col("_done"), "reprocessed").when(F.col("_left"), "abandoned").otherwise("pending")
    return out.withColumn("state", state).withColumn("attempts", F.coalesce("_attempts", F.lit(0).cast("long"))).withColumn("reason", F.coalesce("_reason", "reason")).drop("_done", "_left", "_attempts", "_reason")


def _moved(letters: DataFrame, move: str, replay_id: str, now_us: int, reason: str | None = None) -> DataFrame:
    rows = letters.select(*LETTER, F.lit(move).alias("move"), F.lit(replay_id).alias("replay_id"), F.lit(now_us).alias("at_us"), (F.col(reason) if reason else F.lit(None).cast("string")).alias("reason"))
    return dated(rows, "at_us")


def abandon(spark: SparkSession, root: str, letters: DataFrame, now_us: int | None = None) -> None:
    """Give up the letters (tenant, dead_letter_id) that are pending; reprocessed ones stay so."""
    now_us = now_us or time.time_ns() // 1000
    known = states(spark, root)
    if known is not None:
        append(spark, root, "dead_letter_moves", _moved(matching(known.where("state = 'pending'"), letters, LETTER), "abandoned", uuid.uuid4().hex, now_us))


def replay(spark: SparkSession, root: str, tenant: str | None = None, provider: str | None = None, configs: DataFrame | None = None, token_key: bytes | None = None, parsers: dict = PARSERS, max_attempts: int = MAX_ATTEMPTS, dry_run: bool = False, now_us: int | None = None) -> Replayed:
    """Normalise the pending letters again. Those that parse go into the store as in the stream, filters and token key applied, and are reprocessed.

    One that fails again stays pending with one more attempt, and is abandoned at max_attempts;
    it does not stop the others. The letters are marked after they are absorbed: a replay that
    ends between the two is repeated, which changes nothing. A dry run only counts.
    """
    now_us = now_us or time.time_ns() // 1000
    known = states(spark, root)
    if known is None:
        return Replayed(0, 0, 0, 0)
    wanted = known.where("state = 'pending'")
    wanted = wanted.where(F.col("tenant") == tenant) if tenant else wanted
    wanted = stage(wanted.where(F.col("provider") == provider) if provider else wanted, "letters")
    parsed = parse(wanted.select("tenant", "provider", "received_at", "payload"), parsers, token_key)
    verdict = parsed.select("tenant", F.substring(F.sha2("payload", 256), 1, 16).alias("dead_letter_id"), F.col("parse_error").alias("error")).dropDuplicates(LETTER)
    found = stage(wanted.drop("reason").join(verdict, LETTER, "left").withColumn("error", F.when(~F.col("provider").isin(*parsers), "no parser").otherwise(F.col("error"))), "found")
    good, bad = found.where("error is null"), found.where("error is not null")
    tired = bad.where(F.col("attempts") + 1 >= max_attempts)
    out = Replayed(*(t.count() for t in (found, good, bad, tired)))
    if not dry_run and out.read:
        replay_id = uuid.uuid4().hex
        if out.recovered:
            absorb(spark, good.select("tenant", "provider", "received_at", "payload"), root, configs, token_key, now_us, parsers=parsers)
        append(spark, root, "dead_letter_moves", _moved(good, "reprocessed", replay_id, now_us).union(_moved(bad, "failed", replay_id, now_us, "error")).union(_moved(tired, "abandoned", replay_id, now_us)))
    discard(spark, wanted, found)
    return out
