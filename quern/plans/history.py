"""Queries over the assessment log for the rolling-total and version-history operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import trailing, versions
from quern.sources.tables import table

#: What tells two rows of one user and moment apart, beside ``id``.
REST = ["node_id", "category", "status", "confidence", "reasoning"]


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """``user_id, day, score`` of scored log rows; rows alike in every column but ``id`` count once.

    Repeats meet by user and day, with a digest in place of texts; daily sums then need no further exchange.
    """
    logs = table(spark, folder, "resilience_logs").where("score IS NOT NULL AND created_at IS NOT NULL")
    rows = logs.select("user_id", F.to_date("created_at").alias("day"), "created_at", "score", F.unhex(versions.hash_diff(REST)).alias("digest"))
    return rows.repartition("user_id", "day").dropDuplicates().select("user_id", "day", "score")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    days = trailing.peak_days(scored(spark, folder), F.col("user_id"), F.col("day"), F.col("score"))
    return days.select(F.col("entity").alias("user_id"), "period_days", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p1_trailing_totals(spark: SparkSession, folder: str) -> DataFrame:
    days = trailing.trailing_totals(scored(spark, folder), F.col("user_id"), F.col("day"), F.col("score"))
    return days.select(F.col("entity").alias("user_id"), "period_days", F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "n", F.round("mean", 6).alias("mean"), F.round("daily_mean", 6).alias("daily_mean"))


def _log(spark: SparkSession, folder: str) -> DataFrame:
    logs = table(spark, folder, "resilience_logs").where("score IS NOT NULL AND created_at IS NOT NULL")
    return versions.change_log(
        logs,
        keys={"user_id": F.col("user_id"), "node_id": F.col("node_id")},
        at=F.col("created_at"),
        tie=F.col("id"),
        satellites={"status": {"status": F.upper(F.trim("status"))}, "score": {"score": F.col("score")}},
    )


def _moment(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    seen = versions.versions(_log(spark, folder), ["user_id", "node_id"])
    return seen.select("user_id", "node_id", _moment("valid_from").alias("valid_from"), F.coalesce(_moment("valid_to"), F.lit("open")).alias("valid_to"))


def p3_versions(spark: SparkSession, folder: str) -> DataFrame:
    seen = versions.versions(_log(spark, folder), ["user_id", "node_id"])
    return seen.select("user_id", "node_id", "status", "score", _moment("valid_from").alias("valid_from"), _moment("valid_to").alias("valid_to"))


def p3_satellite_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = versions.satellite(_log(spark, folder), ["user_id", "node_id"], "status", ["status"])
    return rows.select("user_id", "node_id", _moment("at").alias("load_at"), "status")


_SCORED = "SELECT DISTINCT user_id, node_id, category, status, score, confidence, reasoning, created_at FROM resilience_logs WHERE score IS NOT NULL AND created_at IS NOT NULL"

_TOTALS = f"""
WITH scored AS ({_SCORED}),
daily AS (SELECT user_id, CAST(created_at AS DATE) AS d, sum(score) AS s, count(*) AS n FROM scored GROUP BY ALL),
calendar AS (SELECT user_id, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM daily GROUP BY user_id),
dense AS (SELECT c.user_id, c.d, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM calendar c LEFT JOIN daily y ON c.user_id IS NOT DISTINCT FROM y.user_id AND c.d = y.d),
totals AS (
  SELECT user_id, CAST(7 AS INTEGER) AS period_days, d, CAST(sum(s) OVER w AS BIGINT) AS total, CAST(sum(n) OVER w AS BIGINT) AS n
  FROM dense WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT user_id, CAST(30 AS INTEGER), d, CAST(sum(s) OVER w AS BIGINT), CAST(sum(n) OVER w AS BIGINT)
  FROM dense WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

_VERSIONS = """
WITH counted AS (
  SELECT user_id, node_id, created_at, upper(trim(status, ' ')) AS status, score
  FROM resilience_logs WHERE score IS NOT NULL AND created_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, node_id, created_at ORDER BY id DESC) = 1),
stepped AS (
  SELECT *, lag(status) OVER w AS old_status, lag(score) OVER w AS old_score, row_number() OVER w AS k
  FROM counted WINDOW w AS (PARTITION BY user_id, node_id ORDER BY created_at))
"""
_ENDED = """, opened AS (SELECT * FROM stepped WHERE k = 1 OR status IS DISTINCT FROM old_status OR score IS DISTINCT FROM old_score),
ended AS (SELECT *, lead(created_at) OVER (PARTITION BY user_id, node_id ORDER BY created_at) AS next_at FROM opened)
"""
_AT = "%Y-%m-%d %H:%M:%S"

SQL = {
    "p1_found": _TOTALS + "SELECT user_id, period_days, strftime(d, '%Y-%m-%d') AS day FROM totals QUALIFY total = max(total) OVER (PARTITION BY user_id, period_days)",
    "p1_trailing_totals": _TOTALS + "SELECT user_id, period_days, strftime(d, '%Y-%m-%d') AS day, total, n, round(total / nullif(n, 0)::DOUBLE, 6) AS mean, round(total::DOUBLE / period_days, 6) AS daily_mean FROM totals",
    "p3_found": _VERSIONS + _ENDED + f"SELECT user_id, node_id, strftime(created_at, '{_AT}') AS valid_from, coalesce(strftime(next_at, '{_AT}'), 'open') AS valid_to FROM ended",
    "p3_versions": _VERSIONS + _ENDED + f"SELECT user_id, node_id, status, score, strftime(created_at, '{_AT}') AS valid_from, strftime(next_at, '{_AT}') AS valid_to FROM ended",
    "p3_satellite_status": _VERSIONS + f"SELECT user_id, node_id, strftime(created_at, '{_AT}') AS load_at, status FROM stepped WHERE k = 1 OR status IS DISTINCT FROM old_status",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_trailing_totals, p3_found, p3_versions, p3_satellite_status)}
