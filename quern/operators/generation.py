"""Synthetic evaluation cases from a knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Buckets of cases with weight in percent, difficulty and case type.
BUCKETS = (
    ("easy_normal", 20, "easy", "normal"),
    ("moderate_normal", 20, "moderate", "normal"),
    ("hard_ambiguous", 15, "hard", "ambiguous"),
    ("moderate_mixed_signal", 15, "moderate", "mixed_signal"),
    ("hard_multi_domain", 10, "hard", "multi_domain"),
    ("hard_high_risk", 10, "hard", "high_risk"),
    ("adversarial", 10, "adversarial", "adversarial"),
)
# Rubric by polarity.
RUBRICS = (("positive", 22, 22, 23, 23), ("negative", 10, 12, 10, 9), ("mixed", 14, 15, 14, 15))


def largest_remainder(weights: DataFrame, count: int) -> DataFrame:
    """``name, position, n``: ``count`` units by weight in percent, rest to the largest fractions, then to the first (T4)."""
    exact = F.lit(count) * F.col("weight") / 100.0
    rows = weights.select("name", "position", F.floor(exact).alias("base"), F.round(exact - F.floor(exact), 9).alias("rest"))
    everything = Window.partitionBy(F.lit(1))
    missing = F.lit(count) - F.sum("base").over(everything)
    # one row per bucket: a single window is small
    place = F.row_number().over(everything.orderBy(F.desc("rest"), "position"))
    return rows.select("name", "position", (F.col("base") + (place <= missing).cast("int")).alias("n"))


def _choose(options: list, seed: int, *salt: Column | str) -> Column:
    pick = F.pmod(F.xxhash64(F.lit(seed), *salt), F.lit(len(options))).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), pick + 1)


def cases(spark: SparkSession, nodes: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """Cases with safety, signals, rubrics and routing (N1-N7), in seeded order (T5).

    The same seed gives the same cases. ``nodes``: node_id, domain; choices are hashes of
    the case, so the result does not depend on partitioning.
    """
    weights = spark.createDataFrame([(b[0], i, b[1], b[2], b[3]) for i, b in enumerate(BUCKETS)], "name string, position int, weight int, difficulty string, case_type string")
    spans = largest_remainder(weights, count).join(weights, ["name", "position"])
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("position"))
    spans = spans.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("n"))
    base = spark.range(count).join(F.broadcast(spans), (F.col("id") >= F.col("lo")) & (F.col("id") < F.col("hi")))
    one = base.select(F.format_string("RM-SC-%04d", F.col("id") + 1).alias("case_id"), "difficulty", "case_type")
    domains = [r["domain"] for r in nodes.where("domain IS NOT NULL").select("domain").distinct().orderBy("domain").collect()]
    turns = F.when(F.col("case_type") == "multi_domain", _choose([2, 3], seed, "case_id", F.lit("turns"))).when(F.col("case_type").isin("adversarial", "ambiguous"), _choose([1, 2], seed, "case_id", F.lit("turns"))).otherwise(1)
    risky = F.col("case_type") == "high_risk"
    built = one.withColumns(
        {
            "domain": _choose(domains, seed, "case_id", F.lit("domain")) if domains else F.lit(None).cast("string"),
            "turn_count": turns,
            "high_risk": risky,
            "risk_category": F.when(risky, _choose(["SELF_HARM", "VIOLENCE", "SEVERE_ABUSE"], seed, "case_id", F.lit("risk"))).otherwise("SAFE"),
        }
    )
    others = F.array_except(F.array(*[F.lit(d) for d in domains]), F.array("domain"))
    second = F.when((F.col("case_type") == "multi_domain") & (F.size(others) > 0), F.element_at(others, F.pmod(F.xxhash64(F.lit(seed), "case_id", F.lit("second")), F.size(others)).cast("int") + 1))
    wanted = F.when(F.col("case_type").isin("mixed_signal", "multi_domain"), 2).otherwise(1)
    # a case takes its nodes by position from the lists of its domains, so only as many rows as signals arise
    lists = nodes.where("domain IS NOT NULL AND node_id IS NOT NULL").groupBy("domain").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))
    asked = built.where("NOT high_risk").select("case_id", "case_type", "difficulty", wanted.alias("wanted"), "domain", second.alias("second"))
    both = asked.join(lists, "domain").join(lists.select(F.col("domain").alias("second"), F.col("nodes").alias("more")), "second", "left")
    offered = F.concat("nodes", F.coalesce("more", F.expr("array()").cast("array<string>")))
    size = F.size("offered")
    start = F.pmod(F.xxhash64(F.lit(seed), "case_id", F.lit("node")), size)
    step = F.when(size > 1, 1 + F.pmod(F.xxhash64(F.lit(seed), "case_id", F.lit("step")), size - 1)).otherwise(0)
    picked = F.transform(F.sequence(F.lit(0), F.least("wanted", size) - 1), lambda k: F.get("offered", F.pmod(start + k * step, size).cast("int")))
    drawn = both.withColumn("offered", offered).select("case_id", "case_type", "difficulty", F.explode(F.array_distinct(picked)).alias("node_id"))
    kinds = F.when(F.col("case_type") == "mixed_signal", _choose(["positive", "negative", "mixed"], seed, "case_id", "node_id")).when(F.col("case_type").isin("ambiguous", "adversarial"), _choose(["negative", "mixed"], seed, "case_id", "node_id")).otherwise(_choose(["positive", "negative"], seed, "case_id", "node_id"))
    signals = drawn.withColumn("polarity", kinds)
    rubric = spark.createDataFrame(RUBRICS, "polarity string, severity int, frequency int, functional int, coping int")
    scored = signals.join(F.broadcast(rubric), "polarity")
    less = F.when(F.col("difficulty") == "hard", 2).otherwise(0)
    dims = [F.greatest(F.col(d) - less, F.lit(0)).alias(d) for d in ("severity", "frequency", "functional", "coping")]
    lists = scored.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "polarity", *dims))).alias("signals"))
    joined = built.join(lists, "case_id", "left").withColumn("signals", F.coalesce("signals", F.expr("array()").cast(lists.schema["signals"].dataType)))
    asks = (F.size("signals") == 0) | F.col("case_type").isin("ambiguous", "adversarial", "multi_domain")
    route = F.when(F.col("high_risk"), "emergency_response").when(asks, "questioner").otherwise("advisor")
    return joined.withColumn("route", route).withColumn("confidence_class", F.when(F.col("route") == "questioner", "low").otherwise("high")).orderBy(F.xxhash64(F.lit(seed), "case_id"))
