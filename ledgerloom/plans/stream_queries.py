"""Queries over ledger streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from ..streaming import attempt_stream, ledger_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def st10_stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The events ledger after a stream appended it: as many rows per type as in the batch table."""
    return ledger_stream.replayed(spark, f"{sf}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


QUERIES["st10_stream_replay"] = st10_stream_replay
ORACLES["st10_stream_replay"] = "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type"


def st10_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts per type, the batch form of the windowed stream."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return ledger_stream.windowed(e, "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES["st10_event_windows"] = st10_event_windows
ORACLES["st10_event_windows"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"


_HOURS = 12

_STATES = f"""
WITH RECURSIVE e AS (
  SELECT user_id, epoch_us(ts) AS us, event_type = 'purchase' AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS us, NULL::BIGINT AS until, 0 AS ordinal, NULL::VARCHAR AS what FROM e
  UNION ALL
  SELECT e.user_id, e.i, e.us,
         CASE WHEN e.us < r.until THEN CASE WHEN e.done THEN NULL ELSE r.until END WHEN e.done THEN NULL ELSE e.us + {_HOURS * 3600}000000::BIGINT END,
         CASE WHEN NOT e.done AND coalesce(e.us >= r.until, true) THEN r.ordinal + 1 ELSE r.ordinal END,
         CASE WHEN e.us < r.until THEN CASE WHEN e.done THEN 'SUCCEEDED' ELSE 'BUSY' END WHEN e.done THEN 'STALE' ELSE 'RUNNING' END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1
), b AS (
  SELECT b.user_id, b.ordinal, b.us AS begun, s.us AS ended FROM r b LEFT JOIN r s ON s.user_id = b.user_id AND s.ordinal = b.ordinal AND s.what = 'SUCCEEDED' WHERE b.what = 'RUNNING'
)
SELECT user_id, ordinal, what AS outcome, us AS begun, us AS ended FROM r WHERE what IN ('BUSY', 'STALE')
UNION ALL SELECT user_id, ordinal, CASE WHEN ended IS NULL THEN 'ABANDONED' ELSE 'SUCCEEDED' END, begun, coalesce(ended, begun + {_HOURS * 3600}000000::BIGINT) FROM b
"""


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests for the lease of their user's call; a purchase is the commit."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("user_id").alias("call"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("done"))


def st06_st10_attempt_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Leases and attempts of all users as a stream with timers settles them."""
    return attempt_stream.settled(spark, _calls(spark, sf), _HOURS * 3600).withColumnRenamed("call", "user_id")


def st06_st10_attempt_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The same as one fold down the sorted events of each user."""
    return ledger.attempt_log(_calls(spark, sf), _HOURS * 3600).withColumnRenamed("call", "user_id")


for _name, _query in (("st06_st10_attempt_stream", st06_st10_attempt_stream), ("st06_st10_attempt_fold", st06_st10_attempt_fold)):
    QUERIES[_name], ORACLES[_name] = _query, _STATES
