"""Reading-time analytics over sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MINIMUM_SECONDS = 5


def log(sessions: DataFrame) -> DataFrame:
    """Drops sessions under 5 s; date and hour are cut from the start time's text."""
    day = F.substring("start_time", 1, 10)
    return sessions.where(F.col("duration_seconds") >= MINIMUM_SECONDS).withColumns({
        "date": F.when(F.length("start_time") >= 10, day).otherwise("unknown"), "hour": F.coalesce(F.substring("start_time", 12, 2).try_cast("int"), F.lit(0)),
    })


def total(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum("duration_seconds"), F.lit(0)).alias("total_seconds"))


def leaderboard(log: DataFrame, limit: int = 20) -> DataFrame:
    """Papers by time read; the name is that of the latest session."""
    g = log.groupBy("paper_id").agg(F.max_by("paper_name", "start_time").alias("paper_name"), F.sum("duration_seconds").alias("total_seconds"))
    return g.orderBy(F.desc("total_seconds"), "paper_id").limit(limit)


def daily(log: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Totals of the last days; the text comparison lets 'unknown' through."""
    return log.where(F.col("date") >= F.date_sub(F.to_date(F.lit(now)), days).cast("string")).groupBy("date").agg(F.sum("duration_seconds").alias("total_seconds")).orderBy("date")


def hourly(log: DataFrame) -> DataFrame:
    """All 24 hours, 0 where nothing was read."""
    spine = log.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    sums = log.groupBy("hour").agg(F.sum("duration_seconds").alias("total_seconds"))
    return spine.join(sums, "hour", "left").select("hour", F.coalesce("total_seconds", F.lit(0)).alias("total_seconds"))


def report(log: DataFrame) -> DataFrame:
    """Total, per day and per hour in one pass by grouping sets."""
    g = log.groupingSets([["date"], ["hour"], []], "date", "hour").agg(F.sum("duration_seconds").alias("total_seconds"), F.grouping_id().cast("int").alias("part"))
    return g.select("part", "date", "hour", "total_seconds")


def bars(totals: DataFrame, floor: float = 2.0) -> DataFrame:
    """Percent of the largest total, at least ``floor``. The input is one row a day."""
    return totals.withColumn("percent", F.greatest(F.col("total_seconds") / F.max("total_seconds").over(Window.partitionBy()) * 100, F.lit(floor)))
