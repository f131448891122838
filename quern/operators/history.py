"""The assessment log: latest rows, recent rows, timelines, domain means, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The domains of assessments and their labels.
DOMAINS = {
    "Personal_Resilience": "فردی",
    "Political_Resilience": "سیاسی",
    "Economic_Resilience": "اقتصادی",
    "Physical_Resilience": "جسمانی",
    "Social_Resilience": "اجتماعی",
    "Spiritual_Cultural_Resilience": "معنوی",
}


def latest(logs: DataFrame, keys: tuple[str, ...] = ("user_id", "node_id"), at: str = "created_at") -> DataFrame:
    """Rows with a key's latest moment (J1, G1); all rows of a tie stay. Rows without ``at`` have no place."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(at)))
    return logs.where(F.col(at).isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def domain(category: Column) -> Column:
    """The domain that a category spelling stands for, or null."""
    plain = F.lower(F.translate(F.trim(category), " ", "_"))
    out = F.lit(None).cast("string")
    for name in DOMAINS:
        out = F.when(plain == name.lower(), name).otherwise(out)
    return out


def domain_means(rows: DataFrame, entity: str, category: Column, score: str) -> DataFrame:
    """``entity, domain, mean_score, n`` with every domain for every entity, 0 where it has no score."""
    sized = rows.select(entity, category.alias("domain"), score)
    means = sized.where("domain IS NOT NULL").groupBy(entity, "domain").agg(F.avg(score).alias("mean_score"), F.count(score).alias("n"))
    every = sized.select(entity).distinct().select(entity, F.explode(F.array(*[F.lit(d) for d in DOMAINS])).alias("domain"))
    same = F.col(f"e.{entity}").eqNullSafe(F.col(f"m.{entity}")) & (F.col("e.domain") == F.col("m.domain"))
    joined = every.alias("e").join(means.alias("m"), same, "left")
    return joined.select(F.col(f"e.{entity}").alias(entity), "e.domain", F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.coalesce("n", F.lit(0)).alias("n"))


def first_rows(logs: DataFrame, key: str, at: str, tie: str, n: int, newest: bool) -> DataFrame:
    """A key's n newest (T1) or oldest (T2) rows with ``place`` from 1; equal moments in order of ``tie``."""
    order = (F.desc(at), F.desc(tie)) if newest else (F.asc(at), F.asc(tie))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return logs.where(F.col(at).isNotNull()).withColumn("place", place).where(F.col("place") <= n)


def timeline_text(rows: DataFrame, key: str, node: str, at: str, tie: str, state: Column, score: Column) -> DataFrame:
    """``key, timeline``: per node the dated states in order, nodes in order of first appearance.

    ``rows`` must hold a bounded number of rows per key, such as the result of first_rows.
    """
    step = F.format_string("[%s] %s(%s)", F.date_format(at, "yyyy-MM-dd"), F.coalesce(state, F.lit("UNKNOWN")), F.coalesce(score.cast("string"), F.lit("N/A")))
    steps = rows.select(key, node, F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), step.alias("step")).alias("s"))
    lines = steps.groupBy(key, node).agg(F.array_sort(F.collect_list("s")).alias("s"))
    line = F.concat(F.lit("• Node "), F.col(node), F.lit(" Timeline: "), F.array_join(F.col("s.step"), " ➔ "))
    lines = lines.select(key, F.struct(F.col("s")[0]["at"].alias("at"), F.col("s")[0]["tie"].alias("tie"), line.alias("line")).alias("l"))
    return lines.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("l"))["line"], "\n").alias("timeline"))


def persisted(assessments: DataFrame) -> DataFrame:
    """Rows as they are appended to the log (P19, K7): defaults filled in, status in upper case.

    A missing score is the sum of the dimensions, a missing status follows from the score.
    """
    from quern.functions.scoring import DIMENSIONS, status, total

    score = F.coalesce("score", total(*[F.col(d) for d in DIMENSIONS]))
    return assessments.select(
        "user_id",
        "node_id",
        F.coalesce("category", F.lit("Personal_Resilience")).alias("category"),
        F.upper(F.coalesce("status", status(score))).alias("status"),
        score.alias("score"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "reasoning",
        "created_at",
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows, laid out by day (K7)."""
    rows.withColumn("created_date", F.to_date("created_at")).write.mode("append").partitionBy("created_date").parquet(path)


def create_tables(spark: SparkSession) -> None:
    """The users and log tables, if they are missing (K9)."""
    spark.sql("CREATE TABLE IF NOT EXISTS users (id BIGINT, username STRING, password_hash STRING, created_at TIMESTAMP) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS resilience_logs (id BIGINT, user_id BIGINT, node_id STRING, category STRING, status STRING, score INT, confidence DOUBLE, reasoning STRING, created_at TIMESTAMP) USING parquet")


def registrable(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates whose trimmed username is new, each name once."""
    fresh = candidates.withColumn("username", F.trim("username")).where("username != ''").dropDuplicates(["username"])
    return fresh.join(users.select(F.trim("username").alias("username")), "username", "left_anti")


def user_by_name(users: DataFrame, name: str) -> DataFrame:
    """The user of a name, compared without outer blanks (S12); the filter reaches the scan's columns only."""
    return users.where(F.trim("username") == name.strip())
