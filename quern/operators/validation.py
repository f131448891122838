"""Rules that a dataset of cases must keep, as rows ``case_id, rule, detail``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scoring import DIMENSIONS, status, total


def _rule(name: str, condition: Column, detail: Column) -> Column:
    return F.when(condition, F.struct(F.lit(name).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")))


def case_rules(cases: DataFrame, strict: bool = False) -> DataFrame:
    """Rules on whole cases: V4, V10-V17 and V23.

    ``cases``: case_id, turn_count, messages array, high_risk, risk_category, route, confidence_class.
    """
    high, safe = F.col("high_risk"), F.col("risk_category") == "SAFE"
    emergency = F.col("route") == "emergency_response"
    rules = [
        _rule("V4", F.coalesce(F.trim("case_id"), F.lit("")) == "", F.lit("case_id")),
        _rule("V10", high & safe, F.col("risk_category")),
        _rule("V11", ~high & ~safe, F.col("risk_category")),
        _rule("V12", high & ~emergency, F.col("route")),
        _rule("V13", ~high & emergency, F.col("route")),
        _rule("V14", (F.col("route") == "questioner") & (F.col("confidence_class") != "low"), F.col("confidence_class")),
        _rule("V15", (F.col("route") == "advisor") & (F.col("confidence_class") != "high"), F.col("confidence_class")),
        *([_rule("V16", F.size("messages") != F.col("turn_count"), F.size("messages"))] if strict else []),
    ]
    rows = cases.select("case_id", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("case_id", "r.*")
    blank = cases.select("case_id", F.posexplode("messages").alias("at", "message")).where("message IS NULL OR trim(message) = ''")
    rows = rows.unionByName(blank.select("case_id", F.lit("V17").alias("rule"), F.col("at").cast("string").alias("detail")))
    twice = cases.groupBy("case_id").count().where("count > 1")
    return rows.unionByName(twice.select("case_id", F.lit("V23").alias("rule"), F.col("count").cast("string").alias("detail")))


def rubric_rules(assessments: DataFrame) -> DataFrame:
    """V1-V3 on rows ``case_id, node_id``, the four dimensions and status."""
    out = F.lit(False)
    for d in DIMENSIONS:
        out = out | ~F.col(d).between(0, 25)
    score = total(*[F.col(d) for d in DIMENSIONS])
    rules = [_rule("V1", out, F.col("node_id")), _rule("V2", ~score.between(0, 100), score), _rule("V3", ~F.col("status").eqNullSafe(status(score)), F.col("status"))]
    return assessments.select("case_id", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("case_id", "r.*")


def node_rules(signals: DataFrame, assessments: DataFrame, nodes: DataFrame) -> DataFrame:
    """V5-V9: unknown nodes, nodes stated twice, signals without assessment (rows ``case_id, node_id``)."""
    known = nodes.select("node_id").distinct()
    out = None
    for rows, unknown, twice in ((signals, "V5", "V7"), (assessments, "V6", "V8")):
        strange = rows.select("case_id", "node_id").distinct().join(known, "node_id", "left_anti")
        again = rows.groupBy("case_id", "node_id").count().where("count > 1")
        for name, r in ((unknown, strange), (twice, again)):
            r = r.select("case_id", F.lit(name).alias("rule"), F.col("node_id").alias("detail"))
            out = r if out is None else out.unionByName(r)
    bare = signals.select("case_id", "node_id").distinct().join(assessments.select("case_id", "node_id").distinct(), ["case_id", "node_id"], "left_anti")
    return out.unionByName(bare.select("case_id", F.lit("V9").alias("rule"), F.col("node_id").alias("detail")))


def evidence_rules(signals: DataFrame, cases: DataFrame) -> DataFrame:
    """V18-V21, the first that fails for each signal: evidence missing, index missing, out of range, not in the message.

    ``signals``: case_id, node_id, evidence, message_index; ``cases``: case_id, messages.
    """
    joined = signals.join(cases.select("case_id", "messages"), "case_id")
    at = F.col("message_index")
    rule = (
        F.when(F.coalesce(F.trim("evidence"), F.lit("")) == "", "V18")
        .when(at.isNull(), "V19")
        .when((at < 0) | (at >= F.size("messages")), "V20")
        .when(~F.contains(F.coalesce(F.get("messages", at), F.lit("")), F.col("evidence")), "V21")
    )
    return joined.select("case_id", rule.alias("rule"), F.col("node_id").alias("detail")).where("rule IS NOT NULL")


def unknown_fields(json_text: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that the schema does not have."""
    return F.array_except(F.json_object_keys(json_text), F.array(*[F.lit(a) for a in allowed]))


def versions_agree(gold: DataFrame, predicted: DataFrame, version: str) -> DataFrame:
    """One row: distinct versions of both sides and whether they are one and the same."""
    sides = gold.select(F.col(version).alias("g"), F.lit(None).cast("string").alias("p")).unionByName(predicted.select(F.lit(None).cast("string").alias("g"), F.col(version).alias("p")))
    n = sides.agg(F.count_distinct("g").alias("gold_versions"), F.count_distinct("p").alias("predicted_versions"), F.min("g").alias("g"), F.min("p").alias("p"))
    return n.select("gold_versions", "predicted_versions", F.coalesce((F.col("gold_versions") == 1) & (F.col("predicted_versions") == 1) & (F.col("g") == F.col("p")), F.lit(False)).alias("agree"))


def schema_rules(rows: DataFrame, key: str, enums: dict[str, list[str]] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``key, rule, detail``: values outside their set (enum) or bounds (range), nulls are not judged."""
    rules = [_rule("enum", F.col(c).isNotNull() & ~F.col(c).isin(*values), F.concat(F.lit(f"{c}="), F.col(c))) for c, values in (enums or {}).items()]
    rules += [_rule("range", F.col(c).isNotNull() & ~F.col(c).between(lo, hi), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c, (lo, hi) in (ranges or {}).items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*rules))).alias("r")).select(key, "r.*")


def rendered_rules(cases: DataFrame, signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """``case_id, rule, detail``: the first rule that a rendered case breaks.

    In this order: number of messages; evidence for nodes without a signal; for each piece of evidence in order of its
    ``position`` an index outside the messages, then a text that the message does not hold; signals
    without evidence. ``cases``: case_id, turn_count, messages; ``signals``: case_id, node_id;
    ``evidence``: case_id, position, node_id, evidence, message_index.
    """
    named = signals.where("node_id IS NOT NULL").groupBy("case_id").agg(F.collect_set("node_id").alias("wanted"))
    given = evidence.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("position", "node_id", "evidence", "message_index"))).alias("given"))
    joined = cases.join(named, "case_id", "left").join(given, "case_id", "left")
    none = F.expr("array()").cast("array<string>")
    wanted, stated = F.coalesce("wanted", none), F.array_distinct(F.coalesce(F.col("given.node_id"), none))
    strange, missing = F.array_sort(F.array_except(stated, wanted)), F.array_sort(F.array_except(wanted, stated))

    def broken(x: Column) -> Column:
        index = F.when((x["message_index"] < 0) | (x["message_index"] >= F.size("messages")), F.concat(F.lit("index:"), x["node_id"]))
        return F.coalesce(index, F.when(~F.contains(F.coalesce(F.get("messages", x["message_index"]), F.lit("")), F.coalesce(x["evidence"], F.lit(""))), F.concat(F.lit("text:"), x["node_id"])))

    first = F.get(F.array_compact(F.transform("given", broken)), F.lit(0))
    rule = (
        F.when(F.size("messages") != F.col("turn_count"), F.struct(F.lit("count").alias("rule"), F.concat_ws("/", F.size("messages"), "turn_count").alias("detail")))
        .when(F.size(strange) > 0, F.struct(F.lit("unknown").alias("rule"), F.array_join(strange, ",").alias("detail")))
        .when(first.isNotNull(), F.struct(F.split_part(first, F.lit(":"), F.lit(1)).alias("rule"), F.split_part(first, F.lit(":"), F.lit(2)).alias("detail")))
        .when(F.size(missing) > 0, F.struct(F.lit("missing").alias("rule"), F.array_join(missing, ",").alias("detail")))
    )
    return joined.select("case_id", rule.alias("r")).where("r IS NOT NULL").select("case_id", "r.*")
