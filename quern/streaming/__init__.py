"""Streams with a batch twin each: daily budgets, request statistics; preference profiles are in ``operators.profiles``.

Late data: budgets and statistics drop events behind the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.profiles import history_stream  # noqa: F401
from ..operators.ranking import exact_percentiles

DAY = {"windowDuration": "1 day", "startTime": "15 hours"}  # midnight in Seoul is 15:00 UTC


def daily_intake(events: DataFrame, limit: float, late: str = "1 hour") -> DataFrame:
    """(user_id, day_start, known, unknown, remaining) by Seoul day, for streams and batches alike.

    ``events`` has event_id, user_id, ts (timestamp) and value; an event is counted once.
    """
    rows = events.withWatermark("ts", late)
    rows = rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])
    known = F.coalesce(F.sum("value"), F.lit(0.0))
    days = rows.groupBy("user_id", F.window("ts", **DAY).alias("w")).agg(known.alias("known"), F.count_if(F.col("value").isNull()).alias("unknown"))
    return days.select("user_id", F.col("w.start").alias("day_start"), "known", "unknown", (F.lit(limit) - F.col("known")).alias("remaining"))


def request_kpis(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes", accuracy: int = 10_000) -> DataFrame:
    """(start, n, errors, error_rate, fallback_rate, p50, p95) per window. ``events`` has event_id, ts, failed, ms, cards and
    fallbacks (numbers; fallback_rate is NULL without cards).

    A window's state holds counts and one quantile summary, which merges from micro-batch to micro-batch: p50 and p95
    are values of the window whose rank is within n / ``accuracy`` of the true one (a state of about ``accuracy``
    entries at most). ``window_percentiles`` has the exact ones of a batch. Events behind the watermark are dropped.
    """
    rows = events.withWatermark("ts", late)
    rows = rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])
    out = rows.groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("failed")).alias("errors"), F.sum("cards").alias("cards"), F.sum("fallbacks").alias("fallbacks"),
        F.percentile_approx("ms", [0.5, 0.95], accuracy).alias("p"),
    )
    return out.select(
        F.col("w.start").alias("start"), "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate"),
        (F.col("fallbacks") / F.nullif(F.col("cards"), F.lit(0))).alias("fallback_rate"), F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"),
    )


def window_percentiles(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """(start, n, p50, p95): exact percentiles of ms per window, of a batch."""
    rows = events.dropDuplicates(["event_id"]).select(F.window("ts", width)["start"].alias("start"), F.col("ms").cast("double").alias("ms"))
    return exact_percentiles(rows, ["start"], "ms", {"p50": 0.5, "p95": 0.95})


def parsed_logs(lines: DataFrame) -> DataFrame:
    """(evt, fields) of log lines (value) that hold a JSON object with ``evt``."""
    from ..sources import log_objects

    fields = F.from_json(log_objects(F.col("value")), "map<string,string>")
    return lines.select(fields.alias("fields")).where(F.col("fields")["evt"].isNotNull()).select(F.col("fields")["evt"].alias("evt"), "fields")
