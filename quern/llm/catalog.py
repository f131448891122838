"""All queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import canonical, encoding, mixing, packing, pairs, pii
from quern.session import cut
from quern.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "agent_turns").select("turn_id", "user_message")
    signals = table(spark, folder, "active_signals").select("signal_id", "turn_id", "evidence")
    messages = canonical.look_alike_pairs(turns, F.col("turn_id"), F.col("user_message"))
    evidence = canonical.disguised_quotes(signals, turns, "signal_id", "turn_id", "evidence", "user_message")
    return messages.select(F.lit("message").alias("kind"), "key_a", "key_b").unionByName(evidence.select(F.lit("evidence").alias("kind"), F.col("turn_id").alias("key_a"), F.col("signal_id").alias("key_b")))


def p2_canonical_messages(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "agent_turns").select("turn_id", "user_message")
    return turns.select("turn_id", canonical.canonical("user_message").alias("canonical")).distinct()



def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.damaged(table(spark, folder, "documents").select("doc_id", "text")).select(F.col("key").alias("doc_id")).distinct()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    repair = encoding.learn(documents)
    # the damaged texts, a small part of all, are read three times below
    found = cut(encoding.damaged(documents, repair=repair).select("key", "restored", "lossy"))
    rest = encoding.from_twins(documents, found.where("lossy"), repair=repair)
    whole = found.where("NOT lossy").select("key", "restored")
    return whole.unionByName(rest).select(F.col("key").alias("doc_id"), "restored", (F.contains("restored", F.lit("\ufffd")) | F.col("restored").rlike(encoding.LOST_WORDS)).alias("lossy"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "agent_turns").select("turn_id", "user_message")
    return canonical.look_alike_links(turns, F.col("turn_id"), F.col("user_message")).withColumnRenamed("key", "turn_id")


def _redactor(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, pii.Redactor]:
    turns = table(spark, folder, "agent_turns").select("turn_id", "user_message")
    logs = table(spark, folder, "resilience_logs").select("id", "reasoning")
    return turns, logs, pii.build([(turns, "user_message"), (logs, "reasoning")])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    turns, logs, redactor = _redactor(spark, folder)
    messages = pii.found(turns, "turn_id", "user_message", redactor).select(F.lit("user_message").alias("field"), F.col("key").alias("record_id"), "pii_type")
    return messages.unionByName(pii.found(logs, "id", "reasoning", redactor).select(F.lit("reasoning").alias("field"), F.col("key").alias("record_id"), "pii_type"))


def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each redacted text is the text itself, but for the placeholders."""
    turns, logs, redactor = _redactor(spark, folder)
    parts = []
    for rows, key, text, field in ((turns, "turn_id", "user_message", "user_message"), (logs, "id", "reasoning", "reasoning")):
        kinds = "|".join(pii.TYPES)
        rest = F.regexp_replace(F.regexp_replace("redacted", r"\\E", r"\\E\\\\E\\Q"), rf"\[(?:{kinds})\]", r"\\E.+?\\Q")
        kept = F.expr("raw RLIKE pattern") | F.col("raw").eqNullSafe(F.col("redacted"))
        judged = pii.judged(rows, key, text, redactor).select("key", "raw", F.col("r.text").alias("redacted")).withColumn("pattern", F.concat(F.lit(r"(?s)^\Q"), rest, F.lit(r"\E$")))
        parts.append(judged.select(F.lit(field).alias("field"), F.col("key").alias("record_id"), F.coalesce(kept, F.lit(False)).alias("kept")).distinct())
    return parts[0].unionByName(parts[1])


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    turns, logs, redactor = _redactor(spark, folder)
    messages = pii.records(turns, "turn_id", "user_message", redactor).select(F.lit("user_message").alias("field"), F.col("key").alias("record_id"), "text", "types")
    return messages.unionByName(pii.records(logs, "id", "reasoning", redactor).select(F.lit("reasoning").alias("field"), F.col("key").alias("record_id"), "text", "types"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "agent_turns").select("turn_id", "user_message", "final_response", "safety_status")
    labelled = table(spark, folder, "documents").select("text", "lang")
    notice = F.upper(F.trim("safety_status")).isin("HIGH_RISK", "UNAVAILABLE")
    return pairs.broken(turns, labelled, "turn_id", "user_message", "final_response", notice).withColumnRenamed("key", "turn_id")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, folder, "container_specs"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    # taken from the finished packing: pieces that have their container
    return _packed(spark, folder).where("n_pieces > 1 AND slot IS NOT NULL").select("container_id", F.col("key").alias("doc_id")).distinct()


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).withColumnRenamed("key", "doc_id")


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The packing without the choice of containers: every piece of every document."""
    return _packed(spark, folder).select("container_id", F.col("key").alias("doc_id"), "piece", "n_pieces", "start", "tokens")


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of a packing: nothing lost, no container above its capacity, none left out, few more than the least number."""
    packed = _packed(spark, folder)
    loads = packed.groupBy("container_id", "capacity", "slot").agg(F.sum("tokens").alias("load"), F.count("*").alias("n"))
    per = loads.groupBy("container_id", "capacity").agg(F.sum("load").alias("tokens"), F.sum("n").alias("pieces"), F.count_if(F.col("load") > F.col("capacity")).alias("above"), F.count("*").alias("used"), (F.max("slot") + 1).alias("last"))
    # best-fit decreasing needs at most 11/9 of the best number and 6/9 of a container more
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return per.select("container_id", "tokens", "pieces", "above", (F.col("used") == F.col("last")).alias("dense"), (F.col("used") <= least * 11 / 9 + 1).alias("tight"))


def p6_usage(spark: SparkSession, folder: str) -> DataFrame:
    return packing.usage(_packed(spark, folder))


def _mix_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents").select("doc_id", "text", "source"), table(spark, folder, "mix_targets")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mix_tables(spark, folder)).where("NOT reached").select("mix_id", "source")


def p7_targets(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mix_tables(spark, folder)).withColumn("share", F.round("share", 6))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of a mix: no document above its cap, and each source within 2 % of the mix of what it should and can give."""
    tables = _mix_tables(spark, folder)
    plan = mixing.plan(*tables)
    targets = mixing.shares(*tables, found=plan)
    drawn = mixing.mix(*tables, found=plan).groupBy("mix_id", "source").agg(F.sum(F.col("size") * F.col("uses")).alias("drawn"), F.max("uses").alias("most"))
    both = targets.join(drawn, ["mix_id", "source"], "left")
    can = F.coalesce(F.least("target", F.col("available") * F.col("max_repeats")), F.when(F.col("available") > 0, F.col("target")), F.lit(0))
    whole = F.sum("target").over(Window.partitionBy("mix_id"))
    return both.select("mix_id", "source", F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("cap_kept"), (F.abs(F.coalesce("drawn", F.lit(0)) - F.when(F.col("available") > 0, can).otherwise(0)) <= 0.02 * whole).alias("share_kept"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(*_mix_tables(spark, folder)).withColumnRenamed("key", "doc_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    tables = _mix_tables(spark, folder)
    plan = mixing.plan(*tables)
    return mixing.actual(mixing.mix(*tables, found=plan), mixing.shares(*tables, found=plan))


_WANTED = """WITH sizes AS (SELECT lower(trim(source, ' ')) AS source, sum(coalesce(strlen(text), 0)) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
wanted AS (
  SELECT mix_id, lower(trim(source, ' ')) AS source, sum(greatest(0, coalesce(weight, 0))) AS w, CASE WHEN count(max_repeats) = count(*) THEN max(max_repeats) END AS cap
  FROM mix_targets WHERE mix_id IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
shares AS (SELECT *, sum(w) OVER (PARTITION BY mix_id) AS whole, (SELECT sum(n) FROM sizes) AS total FROM wanted)"""

SQL: dict[str, str] = {
    "p6_pieces": "SELECT container_id, doc_id, CAST(piece AS INTEGER) AS piece, CAST(k AS INTEGER) AS n_pieces, CAST(piece * capacity AS BIGINT) AS start, CAST(least(capacity, n - piece * capacity) AS BIGINT) AS tokens FROM (SELECT container_id, capacity, doc_id, coalesce(strlen(text), 0) AS n, greatest(1, CAST(ceil(coalesce(strlen(text), 0) / capacity) AS BIGINT)) AS k, unnest(range(greatest(1, CAST(ceil(coalesce(strlen(text), 0) / capacity) AS BIGINT)))) AS piece FROM container_specs, documents)",
    "p6_checks": "SELECT container_id, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS tokens, CAST(sum(greatest(1, ceil(coalesce(strlen(text), 0) / capacity))) AS BIGINT) AS pieces, CAST(0 AS BIGINT) AS above, true AS dense, true AS tight FROM container_specs, documents GROUP BY container_id",
    "p7_targets": _WANTED + " SELECT CAST(mix_id AS INTEGER) AS mix_id, s.source, round(CASE WHEN whole > 0 THEN w / whole ELSE 0 END, 6) AS share, CAST(CASE WHEN whole > 0 THEN total * w // whole ELSE 0 END AS BIGINT) AS target, CAST(coalesce(n, 0) AS BIGINT) AS available, CAST(cap AS BIGINT) AS max_repeats, NOT (w > 0 AND (coalesce(n, 0) = 0 OR coalesce(n * cap * whole < total * w, false))) AS reached FROM shares s LEFT JOIN sizes z ON s.source = z.source",
    "p7_checks": _WANTED + " SELECT CAST(mix_id AS INTEGER) AS mix_id, source, true AS cap_kept, true AS share_kept FROM shares",
    "p6_found": "SELECT container_id, doc_id FROM container_specs, documents WHERE strlen(text) > capacity",
    "p4_kept": "SELECT DISTINCT 'user_message' AS field, turn_id AS record_id, true AS kept FROM agent_turns UNION ALL SELECT DISTINCT 'reasoning', id, true FROM resilience_logs",
    "p7_found": """
WITH sizes AS (SELECT lower(trim(source, ' ')) AS source, sum(coalesce(strlen(text), 0)) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
wanted AS (
  SELECT mix_id, lower(trim(source, ' ')) AS source, sum(weight) AS w, CASE WHEN count(max_repeats) = count(*) THEN max(max_repeats) END AS cap
  FROM mix_targets GROUP BY ALL),
shares AS (SELECT *, sum(w) OVER (PARTITION BY mix_id) AS whole, (SELECT sum(n) FROM sizes) AS total FROM wanted)
SELECT mix_id, s.source FROM shares s LEFT JOIN sizes z ON s.source = z.source
WHERE w > 0 AND (coalesce(n, 0) = 0 OR n * cap * whole < total * w)""",
}

QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_canonical_messages, p2_classes, p4_found, p4_redacted, p4_kept, p5_found, p6_found, p6_packed, p6_pieces, p6_checks, p6_usage, p7_found, p7_targets, p7_mix, p7_shares, p7_checks, p8_found, p8_restored)
}
