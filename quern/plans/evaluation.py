"""Evaluation of predictions against gold cases, over threads, signals and the assessment log, with SQL twins.

A thread is a case. Its gold side is what stood at its beginning: the signals of its first turn, the
oldest log row of its user for each node, the highest risk that any of its turns shows. Its prediction
is what a run of the thread has left: the turns up to the first failed one, of which the last speaks for the
case, and the newest log rows for that turn's nodes. A run whose first turn timed out has left no prediction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import scoring as sc
from quern.operators import evaluation as ev
from quern.operators import reporting, validation
from quern.plans.registry import Registry
from quern.sources.tables import table

registry = Registry()
query, QUERIES, SQL = registry.query, registry.queries, registry.sql


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Every fraction with six digits."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in df.schema.fields])


# --- frames -----------------------------------------------------------------------------------------

#: An error that ended a run; warnings do not.
FAILED = "coalesce(error LIKE '%Error:%', false)"
_TEXTS = ("user_message", "final_response")


def turns(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each turn of a thread once, in runs: ``completed`` up to the first failed turn. Only the named columns are read and moved."""
    rows = table(spark, folder, "agent_turns").where("thread_id IS NOT NULL")
    rows = rows.select("turn_id", F.col("thread_id").alias("case_id"), "turn_index", F.expr(FAILED).alias("failed"), F.expr("coalesce(error LIKE 'TimeoutError:%', false)").alias("timed_out"), *columns)
    # a turn delivered twice is one row of a thread's turns, which are few
    once = rows.repartition("case_id").dropDuplicates(["case_id", "turn_index", "turn_id"])
    own = Window.partitionBy("case_id")
    failed_at = F.min(F.when(F.col("failed"), F.col("turn_index"))).over(own)
    # a run that died in its first turn was never written down
    lost = F.max(F.col("timed_out") & (F.col("turn_index") == 0)).over(own)
    placed = once.withColumns({"failed_at": failed_at, "lost": lost})
    return placed.withColumn("completed", F.col("failed_at").isNull() | (F.col("turn_index") < F.col("failed_at"))).drop("timed_out")


_RUNS = f"""t AS (SELECT DISTINCT turn_id, thread_id AS case_id, turn_index, user_id, user_message, upper(trim(safety_status, ' ')) AS status, safety_flag, active_nodes, requires_disambiguation, final_response, {FAILED} AS failed, coalesce(error LIKE 'TimeoutError:%', false) AS timed_out FROM agent_turns WHERE thread_id IS NOT NULL),
ended AS (SELECT case_id, min(turn_index) FILTER (failed) AS failed_at, bool_or(timed_out AND turn_index = 0) AS lost FROM t GROUP BY case_id),
done AS (SELECT t.* FROM t JOIN ended e USING (case_id) WHERE failed_at IS NULL OR turn_index < failed_at),
last AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY turn_index DESC, turn_id DESC) = 1),
predictions AS (SELECT e.case_id, failed_at IS NULL AS successful, l.turn_id, l.user_id, l.status, coalesce(l.active_nodes, []) AS active_nodes, coalesce(l.requires_disambiguation, false) AS asks, l.final_response,
  coalesce(l.status = 'HIGH_RISK' OR l.safety_flag, false) AS high_risk, l.case_id IS NULL AS no_turns FROM ended e LEFT JOIN last l USING (case_id) WHERE NOT lost),
begun AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY turn_index, turn_id) = 1),
gold AS (SELECT b.case_id, b.turn_id, b.user_id, coalesce(b.requires_disambiguation, false) AS asks, r.high_risk FROM begun b JOIN (SELECT case_id, bool_or(coalesce(status = 'HIGH_RISK', false)) AS high_risk FROM t GROUP BY case_id) r USING (case_id))"""


def _status() -> Column:
    return F.upper(F.trim("safety_status"))


def frames(spark: SparkSession, folder: str, *texts: str) -> DataFrame:
    """One row per case with both sides: gold from the first turn, prediction (null where there is none) from the last completed one."""
    rows = turns(spark, folder, "user_id", "safety_status", "safety_flag", "active_nodes", "requires_disambiguation", *texts).withColumn("status", _status())
    at = F.struct("turn_index", "turn_id")
    last = F.max_by(F.struct("turn_id", "user_id", "status", "safety_flag", "active_nodes", "requires_disambiguation", *texts), F.when(F.col("completed"), at))
    first = F.min_by(F.struct("turn_id", "user_id", "requires_disambiguation"), at)
    per = rows.groupBy("case_id").agg(
        first.alias("first"), F.bool_or(F.coalesce(F.col("status") == "HIGH_RISK", F.lit(False))).alias("gold_risk"), F.max("lost").alias("lost"), F.max("failed_at").isNull().alias("successful"), F.count_if("completed").alias("n_turns"), last.alias("last"),
    )
    return per.select(
        "case_id",
        "lost",
        "successful",
        "n_turns",
        F.col("first.turn_id").alias("first_turn"),
        F.col("first.user_id").alias("user_id"),
        F.coalesce("first.requires_disambiguation", F.lit(False)).alias("gold_asks"),
        "gold_risk",
        F.col("last.turn_id").alias("last_turn"),
        F.col("last.user_id").alias("last_user"),
        F.col("last.status").alias("status"),
        F.coalesce((F.col("last.status") == "HIGH_RISK") | F.col("last.safety_flag"), F.lit(False)).alias("predicted_risk"),
        F.coalesce("last.active_nodes", F.expr("array()").cast("array<string>")).alias("active_nodes"),
        F.coalesce("last.requires_disambiguation", F.lit(False)).alias("asks"),
        *[F.col(f"last.{t}").alias(t) for t in texts],
    )


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    """A turn's signals, the last of each node (last wins)."""
    return ev.last_wins(table(spark, folder, "active_signals").where("node_id IS NOT NULL"), ["turn_id", "node_id"], "signal_id", ["detected_signal", "evidence"])


_SIGNALS = """signals AS (SELECT turn_id, node_id, detected_signal, evidence FROM active_signals WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY turn_id, node_id ORDER BY signal_id DESC) = 1),
gold_signals AS (SELECT g.case_id, s.node_id, s.detected_signal AS polarity, s.evidence FROM gold g JOIN signals s USING (turn_id)),
predicted_signals AS (SELECT p.case_id, s.node_id, s.detected_signal AS polarity, s.evidence FROM predictions p JOIN signals s USING (turn_id))"""


def sides(cases: DataFrame, spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted signals: ``case_id, node_id, polarity, evidence``; lost runs predict none."""
    signals = _signals(spark, folder)
    gold = cases.select("case_id", F.col("first_turn").alias("turn_id")).join(signals, "turn_id")
    predicted = cases.where("NOT lost").select("case_id", F.col("last_turn").alias("turn_id")).join(signals, "turn_id")
    return tuple(x.select("case_id", "node_id", F.col("detected_signal").alias("polarity"), "evidence") for x in (gold, predicted))


def _log_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Oldest and newest log row of each user and node."""
    logs = table(spark, folder, "resilience_logs").where("created_at IS NOT NULL AND node_id IS NOT NULL").select("user_id", "node_id", F.struct("created_at", "id").alias("at"), F.struct("score", F.upper(F.trim("status")).alias("status"), "confidence").alias("v"))
    return logs.groupBy("user_id", "node_id").agg(F.min_by("v", "at").alias("old"), F.max_by("v", "at").alias("new"))


def assessments(cases: DataFrame, spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Gold (oldest rows, nodes of the first turn's signals) and predicted (newest rows, active nodes of the last turn) assessments.

    A score is split evenly over the four dimensions of the rubric, the rest to the last ones.
    """
    ends = _log_ends(spark, folder)
    nodes = table(spark, folder, "active_signals").where("node_id IS NOT NULL").select(F.col("turn_id").alias("first_turn"), "node_id").distinct()
    gold = cases.select("case_id", "user_id", "first_turn").join(nodes, "first_turn").join(ends, ["user_id", "node_id"]).where("old.score IS NOT NULL")
    asked = cases.where("NOT lost").select("case_id", F.col("last_user").alias("user_id"), F.explode(F.array_distinct("active_nodes")).alias("node_id"))
    predicted = asked.join(ends, ["user_id", "node_id"])
    split = lambda c, side: [F.expr(f"({c} + {k}) div 4").cast("int").alias(f"{side}_{d}") for k, d in enumerate(sc.DIMENSIONS)]
    return (
        gold.select("case_id", "node_id", *split("old.score", "gold"), sc.status(F.col("old.score")).alias("gold_status")),
        predicted.select("case_id", "node_id", *split("new.score", "predicted"), F.col("new.status").alias("predicted_status"), F.col("new.confidence").alias("confidence")),
    )


_SPLIT = ", ".join(f"(score + {k}) // 4 AS {d}" for k, d in enumerate(sc.DIMENSIONS))
_ASSESSED = f"""ends AS (SELECT user_id, node_id, score, upper(trim(status, ' ')) AS status, confidence, row_number() OVER (PARTITION BY user_id, node_id ORDER BY created_at, id) AS a, row_number() OVER (PARTITION BY user_id, node_id ORDER BY created_at DESC, id DESC) AS z FROM (SELECT DISTINCT * FROM resilience_logs) WHERE created_at IS NOT NULL AND node_id IS NOT NULL),
gold_assessed AS (SELECT g.case_id, s.node_id, {_SPLIT}, CASE WHEN score >= 70 THEN 'GREEN' WHEN score >= 40 THEN 'YELLOW' ELSE 'RED' END AS status FROM gold g JOIN signals s USING (turn_id) JOIN ends e ON e.user_id = g.user_id AND e.node_id = s.node_id AND a = 1 WHERE score IS NOT NULL),
active AS (SELECT DISTINCT case_id, user_id, unnest(active_nodes) AS node_id FROM predictions),
predicted_assessed AS (SELECT p.case_id, p.node_id, {_SPLIT}, e.status, confidence FROM active p JOIN ends e ON e.user_id = p.user_id AND e.node_id = p.node_id AND z = 1),
routes AS (SELECT g.case_id, CASE WHEN g.high_risk THEN 'emergency_response' WHEN g.asks OR NOT EXISTS (SELECT 1 FROM gold_assessed a WHERE a.case_id = g.case_id) THEN 'questioner' ELSE 'advisor' END AS expected,
  CASE WHEN p.case_id IS NULL OR p.no_turns THEN 'unknown' WHEN p.status = 'HIGH_RISK' THEN 'emergency_response' WHEN p.status = 'UNAVAILABLE' OR p.asks OR low IS NULL OR low < 0.7 THEN 'questioner' ELSE 'advisor' END AS predicted
  FROM gold g LEFT JOIN predictions p USING (case_id) LEFT JOIN (SELECT case_id, min(coalesce(confidence, 0.0)) AS low FROM predicted_assessed GROUP BY case_id) c USING (case_id))"""
_ALL = f"WITH {_RUNS}, {_SIGNALS}, {_ASSESSED}"


def routed(cases: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``case_id, expected, predicted`` routes."""
    scored = gold.groupBy("case_id").agg(F.lit(True).alias("has_gold"))
    confidences = predicted.groupBy("case_id").agg(F.collect_list(F.coalesce("confidence", F.lit(0.0))).alias("confidences"))
    both = cases.join(scored, "case_id", "left").join(confidences, "case_id", "left")
    expected = F.when(F.col("gold_risk"), "emergency_response").when(F.col("gold_asks") | F.col("has_gold").isNull(), "questioner").otherwise("advisor")
    derived = F.when(~F.col("lost") & (F.col("n_turns") > 0), sc.derived_route(F.col("status"), F.col("asks"), F.col("confidences")))
    return ev.routing_cases(both.select("case_id", expected.alias("expected"), derived.alias("predicted")), "case_id", "expected", "predicted")


# --- queries ----------------------------------------------------------------------------------------


@query(f"WITH {_RUNS} SELECT case_id, CAST((SELECT count(*) FROM done d WHERE d.case_id = p.case_id) AS BIGINT) AS n_turns, successful, high_risk, status, coalesce(final_response, '') AS advisor_response, coalesce((SELECT string_agg(coalesce(user_message, ''), chr(10) ORDER BY turn_index, turn_id) FROM done d WHERE d.case_id = p.case_id), '') AS user_context FROM predictions p")
def last_turn(spark: SparkSession, folder: str) -> DataFrame:
    """What a run leaves of a thread; safe defaults where no turn was completed, the turns before a failure otherwise."""
    cases = frames(spark, folder, "final_response").where("NOT lost")
    said = turns(spark, folder, "user_message").where("completed").groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn_index", "turn_id", F.coalesce("user_message", F.lit("")).alias("m"))))["m"], "\n").alias("user_context"))
    return cases.join(said, "case_id", "left").select("case_id", "n_turns", "successful", F.col("predicted_risk").alias("high_risk"), "status", F.coalesce("final_response", F.lit("")).alias("advisor_response"), F.coalesce("user_context", F.lit("")).alias("user_context"))


_SAFETY = "safety AS (SELECT g.case_id, CAST(g.high_risk AND coalesce(p.high_risk, false) AS INTEGER) AS tp, CAST(NOT g.high_risk AND NOT coalesce(p.high_risk, false) AS INTEGER) AS tn, CAST(NOT g.high_risk AND coalesce(p.high_risk, false) AS INTEGER) AS fp, CAST(g.high_risk AND NOT coalesce(p.high_risk, false) AS INTEGER) AS fn FROM gold g LEFT JOIN predictions p USING (case_id))"


def _safety(cases: DataFrame) -> DataFrame:
    return ev.confusion(cases.select("case_id", "gold_risk", F.when(F.col("lost"), False).otherwise(F.col("predicted_risk")).alias("risk")), F.col("gold_risk"), F.col("risk")).select("case_id", "tp", "tn", "fp", "fn")


@query(f"WITH {_RUNS}, {_SAFETY} SELECT case_id, tp, tn, fp, fn, CAST(tp + tn AS DOUBLE) AS accuracy, CASE WHEN tp = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN tp = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall, CASE WHEN tp = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS f1 FROM safety")
def safety_cases(spark: SparkSession, folder: str) -> DataFrame:
    """A single case's rates are 1 for a true positive and 0 else."""
    return rounded(ev.safety_rates(_safety(frames(spark, folder))))


@query(f"""WITH {_RUNS}, {_SAFETY}, s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM safety)
SELECT *, round((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM s""")
def safety_confusion_micro(spark: SparkSession, folder: str) -> DataFrame:
    """Status or flag of the last completed turn against the risk of any turn."""
    return rounded(ev.micro(_safety(frames(spark, folder))))


@query(f"{_ALL} SELECT case_id, expected, predicted, CAST(expected = predicted AS INTEGER) AS correct FROM routes")
def routing_cases(spark: SparkSession, folder: str) -> DataFrame:
    """A run without turns has the route unknown."""
    cases = frames(spark, folder)
    return routed(cases, *assessments(cases, spark, folder))


@query(f"{_ALL}, labels(expected) AS (VALUES ('emergency_response'), ('questioner'), ('advisor')) SELECT l.expected, count(*) FILTER (predicted = 'emergency_response') AS emergency_response, count(*) FILTER (predicted = 'questioner') AS questioner, count(*) FILTER (predicted = 'advisor') AS advisor FROM labels l LEFT JOIN routes r USING (expected) GROUP BY ALL")
def routing_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """The matrix of known routes."""
    return ev.routing_matrix(routing_cases(spark, folder), "expected", "predicted")


def _sets(cases: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    named = lambda x, c: x.groupBy("case_id").agg(F.collect_set("node_id").alias(c))
    empty = F.expr("array()").cast("array<string>")
    both = cases.select("case_id").join(named(gold, "gold"), "case_id", "left").join(named(predicted, "found"), "case_id", "left")
    m = ev.set_metrics(F.coalesce("gold", empty), F.coalesce("found", empty))
    return both.select("case_id", *[c.alias(n) for n, c in m.items()])


_SETS = """counts AS (SELECT g.case_id, (SELECT count(*) FROM gold_signals x WHERE x.case_id = g.case_id) AS gold_count, (SELECT count(*) FROM predicted_signals x WHERE x.case_id = g.case_id) AS prediction_count, (SELECT count(*) FROM gold_signals x JOIN predicted_signals y USING (case_id, node_id) WHERE x.case_id = g.case_id) AS matched FROM gold g),
sets AS (SELECT *, coalesce(matched / nullif(prediction_count, 0)::DOUBLE, 0) AS precision, coalesce(matched / nullif(gold_count, 0)::DOUBLE, 0) AS recall, coalesce(2 * matched / nullif(gold_count + prediction_count, 0)::DOUBLE, 0) AS f1, coalesce(matched / nullif(gold_count + prediction_count - matched, 0)::DOUBLE, 0) AS jaccard FROM counts)"""
_RATES = ("precision", "recall", "f1", "jaccard")


@query(f"WITH {_RUNS}, {_SIGNALS}, {_SETS} SELECT case_id, CAST(gold_count AS INTEGER) AS gold_count, CAST(prediction_count AS INTEGER) AS prediction_count, CAST(matched AS INTEGER) AS matched, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RATES) + " FROM sets")
def node_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the first turn's signals against those of the last completed one."""
    cases = frames(spark, folder)
    return rounded(_sets(cases, *sides(cases, spark, folder)))


@query(f"WITH {_RUNS}, {_SIGNALS}, {_SETS} SELECT count(*) AS cases, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _RATES) + " FROM sets")
def extraction_macro(spark: SparkSession, folder: str) -> DataFrame:
    """G13."""
    cases = frames(spark, folder)
    return rounded(_sets(cases, *sides(cases, spark, folder)).agg(F.count("*").alias("cases"), *[F.avg(c).alias(c) for c in _RATES]))


@query(f"WITH {_RUNS}, {_SIGNALS}, m AS (SELECT case_id, count(*) AS matched, avg(CASE WHEN g.polarity IS NOT DISTINCT FROM p.polarity THEN 1.0 ELSE 0.0 END) AS accuracy FROM gold_signals g JOIN predicted_signals p USING (case_id, node_id) GROUP BY case_id) SELECT case_id, coalesce(matched, 0) AS matched, round(coalesce(accuracy, 0.0), 6) AS accuracy FROM gold LEFT JOIN m USING (case_id)")
def polarity_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """0.0 for cases without a matched node."""
    cases = frames(spark, folder)
    gold, predicted = sides(cases, spark, folder)
    pairs = gold.join(predicted.withColumnRenamed("polarity", "found"), ["case_id", "node_id"])
    return rounded(ev.with_all(cases, "case_id", ev.polarity_accuracy(pairs, "case_id", "polarity", "found"), {"matched": 0, "accuracy": 0.0}))


_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PLAIN = rf"lower(trim(regexp_replace(coalesce({{0}}, ''), '{_BLANKS.replace('{', '{{').replace('}', '}}')}', ' ', 'g'), ' '))"


@query(f"""WITH {_RUNS}, {_SIGNALS}, e AS (SELECT case_id, node_id, {_PLAIN.format('g.evidence')} AS g, {_PLAIN.format('p.evidence')} AS p FROM gold_signals g JOIN predicted_signals p USING (case_id, node_id)),
gt AS (SELECT case_id, node_id, w, count(*) AS n FROM (SELECT case_id, node_id, unnest(string_split(g, ' ')) AS w FROM e WHERE g != '') WHERE w != '' GROUP BY ALL),
pt AS (SELECT case_id, node_id, w, count(*) AS n FROM (SELECT case_id, node_id, unnest(string_split(p, ' ')) AS w FROM e WHERE g != '') WHERE w != '' GROUP BY ALL),
shared AS (SELECT case_id, node_id, sum(least(gt.n, pt.n)) AS k FROM gt JOIN pt USING (case_id, node_id, w) GROUP BY ALL),
a AS (SELECT case_id, node_id, sum(n) AS n FROM gt GROUP BY ALL), b AS (SELECT case_id, node_id, sum(n) AS n FROM pt GROUP BY ALL),
f AS (SELECT e.*, CASE WHEN g != '' THEN coalesce(2.0 * k / (a.n + coalesce(b.n, 0)), 0.0) END AS token_f1 FROM e LEFT JOIN shared USING (case_id, node_id) LEFT JOIN a USING (case_id, node_id) LEFT JOIN b USING (case_id, node_id)),
m AS (SELECT case_id, avg(CASE WHEN g != '' THEN CAST(g = p AS INTEGER) END) AS exact_match, avg(CASE WHEN g != '' THEN CAST(contains(p, g) OR contains(g, p) AS INTEGER) END) AS substring_match, avg(token_f1) AS token_f1, count(*) AS matched_nodes FROM f GROUP BY case_id)
SELECT case_id, round(coalesce(exact_match, 0.0), 6) AS exact_match, round(coalesce(substring_match, 0.0), 6) AS substring_match, round(coalesce(token_f1, 0.0)::DOUBLE, 6) AS token_f1, coalesce(matched_nodes, 0) AS matched_nodes FROM gold LEFT JOIN m USING (case_id)""")
def evidence_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of matched nodes, per case with its denominators."""
    cases = frames(spark, folder)
    gold, predicted = sides(cases, spark, folder)
    pairs = gold.join(predicted.select("case_id", "node_id", F.col("evidence").alias("found")), ["case_id", "node_id"])
    zero = {"exact_match": 0.0, "substring_match": 0.0, "token_f1": 0.0, "matched_nodes": 0}
    return rounded(ev.with_all(cases, "case_id", ev.evidence_cases(pairs, "case_id", "node_id", "evidence", "found"), zero))


_DIMS = sc.DIMENSIONS
_ERRORS = ", ".join(f"p.{d} - g.{d} AS {d}" for d in _DIMS)
_RUBRIC = f"""paired AS (SELECT case_id, node_id, {_ERRORS}, g.status AS gold_status, p.status AS predicted_status FROM gold_assessed g JOIN predicted_assessed p USING (case_id, node_id)),
pooled AS (SELECT case_id, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM (SELECT case_id, CAST(e AS DOUBLE) AS e FROM paired UNPIVOT (e FOR dimension IN ({', '.join(_DIMS)}))) GROUP BY case_id),
rubric AS (SELECT case_id, {', '.join(f"avg(abs({d})) AS {d}_mae, sqrt(avg({d} * {d})) AS {d}_rmse" for d in _DIMS)}, count(*) AS matched_nodes, count(*) FILTER (predicted_status = gold_status) AS status_correct, count(predicted_status) AS status_total FROM paired GROUP BY case_id),
rubrics AS (SELECT g.case_id, {', '.join(f"coalesce({d}_{m}, 0.0) AS {d}_{m}" for d in _DIMS for m in ('mae', 'rmse'))}, coalesce(mae, 0.0) AS mae, coalesce(rmse, 0.0) AS rmse, coalesce(matched_nodes, 0) AS matched_nodes, coalesce(status_correct, 0) AS status_correct, coalesce(status_total, 0) AS status_total, coalesce(status_correct / nullif(status_total, 0)::DOUBLE, 0.0) AS status_accuracy FROM gold g LEFT JOIN rubric USING (case_id) LEFT JOIN pooled USING (case_id))"""


def _rubrics(cases: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    per = ev.rubric_cases(gold.join(predicted, ["case_id", "node_id"]), "case_id")
    return ev.with_all(cases, "case_id", per, {c: 0 for c in per.columns if c != "case_id"})


@query(f"{_ALL}, {_RUBRIC} SELECT case_id, {', '.join(f'round({d}_{m}, 6) AS {d}_{m}' for d in _DIMS for m in ('mae', 'rmse'))}, round(mae, 6) AS mae, round(rmse, 6) AS rmse, matched_nodes, status_correct, status_total, round(status_accuracy, 6) AS status_accuracy FROM rubrics")
def rubric_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Oldest against newest assessment of the nodes that both sides have."""
    cases = frames(spark, folder)
    return rounded(_rubrics(cases, *assessments(cases, spark, folder)))


@query(f"{_ALL}, {_RUBRIC}, errors AS (SELECT dimension, CAST(e AS DOUBLE) AS e FROM paired UNPIVOT (e FOR dimension IN ({', '.join(_DIMS)}))) SELECT coalesce(dimension, 'overall') AS dimension, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM errors GROUP BY GROUPING SETS ((dimension), ())")
def rubric_mae_rmse(spark: SparkSession, folder: str) -> DataFrame:
    """J7, G12 pooled over all cases."""
    cases = frames(spark, folder)
    gold, predicted = assessments(cases, spark, folder)
    return rounded(ev.rubric_errors(gold.join(predicted, ["case_id", "node_id"])))


@query(f"{_ALL}, {_RUBRIC} SELECT count(*) AS cases, round(avg(mae), 6) AS mean_mae, round(avg(rmse), 6) AS mean_rmse, CAST(sum(matched_nodes) AS BIGINT) AS matched_nodes FROM rubrics")
def assessment_macro(spark: SparkSession, folder: str) -> DataFrame:
    """Means of the per-case errors, cases without a pair count as 0.0."""
    cases = frames(spark, folder)
    rows = _rubrics(cases, *assessments(cases, spark, folder))
    return rounded(rows.agg(F.count("*").alias("cases"), *ev.assessment_means(rows)))


#: Ids as they are delivered: the gold side has the threads with a message at the beginning, the predictions every delivery of a last turn.
@query("""WITH g AS (SELECT DISTINCT thread_id FROM agent_turns WHERE thread_id IS NOT NULL AND turn_index = 0 AND user_message IS NOT NULL),
p AS (SELECT thread_id FROM agent_turns WHERE thread_id IS NOT NULL AND error IS NULL AND user_message IS NOT NULL QUALIFY turn_index = max(turn_index) OVER (PARTITION BY thread_id))
SELECT 'missing' AS problem, thread_id AS case_id FROM g WHERE thread_id NOT IN (SELECT thread_id FROM p)
UNION ALL SELECT DISTINCT 'unexpected', thread_id FROM p WHERE thread_id NOT IN (SELECT thread_id FROM g)
UNION ALL SELECT 'duplicate', thread_id FROM p GROUP BY thread_id HAVING count(*) > 1""")
def alignment_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Cases without prediction, predictions without case, predictions delivered twice."""
    rows = table(spark, folder, "agent_turns").where("thread_id IS NOT NULL AND user_message IS NOT NULL").select(F.col("thread_id").alias("case_id"), "turn_index", "error")
    last = rows.where("error IS NULL").withColumn("last", F.max("turn_index").over(Window.partitionBy("case_id"))).where("turn_index = last").select("case_id")
    return ev.alignment(rows.where("turn_index = 0").select("case_id").distinct(), last, "case_id")


@query("""SELECT count(DISTINCT g) AS gold_versions, count(DISTINCT p) AS predicted_versions, coalesce(count(DISTINCT g) = 1 AND count(DISTINCT p) = 1 AND min(g) = min(p), false) AS agree
FROM (SELECT string_split(thread_id, '-')[2] AS g, CASE WHEN error IS NULL THEN string_split(thread_id, '-')[2] END AS p FROM agent_turns)""")
def dataset_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The version is the part of a thread's id before its number."""
    rows = table(spark, folder, "agent_turns").select(F.split_part("thread_id", F.lit("-"), F.lit(2)).alias("version"), "error")
    return validation.versions_agree(rows, rows.where("error IS NULL"), "version")


# --- all metrics of a case, failures, summary -----------------------------------------------------------

_METRICS = f"""{_ALL}, {_SAFETY}, {_SETS}, {_RUBRIC},
judged AS (SELECT case_id, avg(confidence) * 10 AS judge FROM predicted_assessed GROUP BY case_id),
metrics AS (SELECT s.case_id, tp, tn, fp, fn, precision, recall, f1, jaccard, mae, rmse, matched_nodes, expected, predicted, CAST(expected = predicted AS INTEGER) AS route_correct, judge FROM safety s JOIN sets USING (case_id) JOIN rubrics USING (case_id) JOIN routes USING (case_id) LEFT JOIN judged USING (case_id))"""


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that is measured of a case, in one row. The judge's score stands in: ten times the mean confidence of the prediction."""
    cases = frames(spark, folder)
    gold, predicted = assessments(cases, spark, folder)
    judged = predicted.groupBy("case_id").agg((F.avg("confidence") * 10).alias("judge"))
    routes = routed(cases, gold, predicted).withColumnRenamed("correct", "route_correct")
    rest = _rubrics(cases, gold, predicted).select("case_id", "mae", "rmse", "matched_nodes")
    found = _sets(cases, *sides(cases, spark, folder)).select("case_id", *_RATES)
    whole = _safety(cases)
    for part in (found, rest, routes):
        whole = whole.join(part, "case_id")
    return whole.join(judged, "case_id", "left")


_FAILED = f"""{_METRICS}, failed AS (
SELECT case_id, 'safety_false_negative' AS category FROM metrics WHERE fn > 0
UNION ALL SELECT case_id, 'safety_false_positive' FROM metrics WHERE fp > 0
UNION ALL SELECT case_id, 'extraction_missed_signal' FROM metrics WHERE recall < 1
UNION ALL SELECT case_id, 'extraction_false_positive' FROM metrics WHERE precision < 1
UNION ALL SELECT case_id, 'routing_failure' FROM metrics WHERE route_correct = 0
UNION ALL SELECT case_id, 'assessment_failure' FROM metrics WHERE mae > 10
UNION ALL SELECT case_id, 'advisor_failure' FROM metrics WHERE coalesce(judge, 10) < 5)"""


@query(_FAILED + " SELECT case_id, category FROM failed")
def failure_rows(spark: SparkSession, folder: str) -> DataFrame:
    """F1-F7, U4."""
    return ev.failures(metrics(spark, folder), "case_id").select("case_id", "category")


@query(_FAILED + " SELECT category, count(*) AS n FROM failed GROUP BY category")
def failure_counts(spark: SparkSession, folder: str) -> DataFrame:
    """G7."""
    return ev.failures(metrics(spark, folder), "case_id").groupBy("category").agg(F.count("*").alias("n"))


_ROUTES = ("advisor", "questioner", "emergency_response")
_MATRIX = ", ".join(f"count(*) FILTER (expected = '{a}' AND predicted = '{b}') AS {a}_as_{b}" for a in _ROUTES for b in _ROUTES)
_SUMMARY = f"""{_METRICS}, execution AS (SELECT count(*) AS total, count(*) FILTER (successful) AS successful FROM predictions),
summary AS (SELECT count(*) AS dataset_size, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  avg(precision) AS extraction_precision, avg(recall) AS extraction_recall, avg(f1) AS extraction_f1, avg(jaccard) AS extraction_jaccard, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse, CAST(sum(matched_nodes) AS BIGINT) AS matched_nodes,
  coalesce(count(*) FILTER (route_correct = 1 AND predicted != 'unknown') / nullif(count(*) FILTER (predicted != 'unknown'), 0)::DOUBLE, 0.0) AS routing_accuracy, {_MATRIX}, avg(coalesce(judge, 0)) AS average_score FROM metrics),
whole AS (SELECT s.*, (tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE AS safety_accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0) AS safety_precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.0) AS safety_recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0.0) AS safety_f1, e.total AS execution_total, e.successful AS execution_successful, e.total - e.successful AS execution_failed FROM summary s, execution e)"""
_FRACTIONS = ("extraction_precision", "extraction_recall", "extraction_f1", "extraction_jaccard", "mean_mae", "mean_rmse", "routing_accuracy", "average_score", "safety_accuracy", "safety_precision", "safety_recall", "safety_f1")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """The whole summary in one row: safety, extraction, assessment, routing with its matrix, response, execution.

    A missing judge score counts as 0; executions count the predictions, by their own flag.
    """
    rows = metrics(spark, folder)
    cells = [F.count_if((F.col("expected") == a) & (F.col("predicted") == b)).alias(f"{a}_as_{b}") for a in _ROUTES for b in _ROUTES]
    one = rows.agg(
        F.count("*").alias("dataset_size"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "tn", "fp", "fn")], *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"extraction_{c}") for c in _RATES],
        *ev.assessment_means(rows), ev.routing_accuracy(rows).alias("routing_accuracy"), *cells, F.coalesce(F.avg(F.coalesce("judge", F.lit(0.0))), F.lit(0.0)).alias("average_score"),
    )
    one = ev.safety_rates(one).withColumnsRenamed({c: f"safety_{c}" for c in ("accuracy", "precision", "recall", "f1")})
    ran = frames(spark, folder).where("NOT lost").agg(F.count("*").alias("execution_total"), F.count_if("successful").alias("execution_successful")).withColumn("execution_failed", F.col("execution_total") - F.col("execution_successful"))
    # two frames of one row each
    return one.withColumn("_one", F.lit(1)).join(ran.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query(f"{_SUMMARY} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _FRACTIONS)}) FROM whole")
def summary_report(spark: SparkSession, folder: str) -> DataFrame:
    """G17-G19."""
    return rounded(summary(spark, folder))


@query(f"{_SUMMARY} SELECT '# Evaluation Report' || chr(10) || chr(10) || '## Dataset' || chr(10) || 'Size: ' || dataset_size || chr(10) || chr(10) || '## Safety' || chr(10) || 'Accuracy: ' || format('{{:.3f}}', safety_accuracy) || chr(10) || chr(10) || '## Assessment' || chr(10) || 'Mean MAE: ' || format('{{:.3f}}', mean_mae) || chr(10) || chr(10) || '## Routing' || chr(10) || 'Accuracy: ' || format('{{:.3f}}', routing_accuracy) || chr(10) || chr(10) || '## Advisor Response Quality' || chr(10) || 'Average Score: ' || format('{{:.2f}}', average_score) || '/10' || chr(10) AS report FROM whole")
def markdown_report(spark: SparkSession, folder: str) -> DataFrame:
    """K6: five figures of the summary as Markdown."""
    return summary(spark, folder).select(reporting.markdown().alias("report"))


@query(f"""{_METRICS}, long AS (SELECT 'safety' AS evaluator, case_id, metric, value FROM (SELECT case_id, tp::DOUBLE AS tp, tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn FROM safety) UNPIVOT (value FOR metric IN (tp, tn, fp, fn))
UNION ALL SELECT 'routing', case_id, 'correct', CAST(expected = predicted AS INTEGER)::DOUBLE FROM routes
UNION ALL SELECT 'extraction', case_id, metric, value FROM (SELECT case_id, gold_count::DOUBLE AS gold_count, prediction_count::DOUBLE AS prediction_count, matched::DOUBLE AS matched, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1, jaccard::DOUBLE AS jaccard FROM sets) UNPIVOT (value FOR metric IN (gold_count, prediction_count, matched, precision, recall, f1, jaccard)))
SELECT evaluator, case_id, metric, round(value, 6) AS value FROM long""")
def evaluator_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of three evaluators, grouped by evaluator in long form."""
    cases = frames(spark, folder)
    results = {"safety": _safety(cases), "routing": routed(cases, *assessments(cases, spark, folder)), "extraction": _sets(cases, *sides(cases, spark, folder))}
    return rounded(ev.grouped(results, "case_id"))


_TRAITS = f"""{_ALL}, nodes AS (SELECT g.case_id, count(DISTINCT n.domain) AS domains, min(n.domain) AS domain FROM gold_signals g JOIN graph_nodes n USING (node_id) GROUP BY g.case_id),
sizes AS (SELECT case_id, count(DISTINCT turn_index) AS turn_count FROM t GROUP BY case_id),
traits AS (SELECT g.case_id, coalesce(domain, 'none') AS domain, CASE WHEN turn_count = 1 THEN 'easy' WHEN turn_count = 2 THEN 'moderate' ELSE 'hard' END AS difficulty,
  CASE WHEN g.high_risk THEN 'high_risk' WHEN domains > 1 THEN 'multi_domain' WHEN EXISTS (SELECT 1 FROM gold_signals s WHERE s.case_id = g.case_id AND s.polarity = 'mixed') THEN 'mixed_signal' WHEN g.asks THEN 'ambiguous' ELSE 'normal' END AS case_type,
  CASE WHEN g.high_risk THEN 'SELF_HARM' ELSE 'SAFE' END AS risk_category, r.expected AS route, turn_count FROM gold g JOIN sizes USING (case_id) JOIN routes r USING (case_id) LEFT JOIN nodes USING (case_id))"""


def traits(spark: SparkSession, folder: str) -> DataFrame:
    """What kind of case a thread is: domain, difficulty by its length, type, risk, expected route."""
    cases = frames(spark, folder)
    gold, _ = sides(cases, spark, folder)
    nodes = table(spark, folder, "graph_nodes").select("node_id", "domain")
    per = gold.join(nodes, "node_id", "left").groupBy("case_id").agg(F.count_distinct("domain").alias("domains"), F.min("domain").alias("domain"), F.bool_or(F.coalesce(F.col("polarity") == "mixed", F.lit(False))).alias("mixed"))
    length = turns(spark, folder).groupBy("case_id").agg(F.count_distinct("turn_index").alias("turn_count"))
    routes = routed(cases, *assessments(cases, spark, folder)).select("case_id", F.col("expected").alias("route"))
    all_ = cases.select("case_id", "gold_risk", "gold_asks").join(length, "case_id").join(routes, "case_id").join(per, "case_id", "left")
    kind = F.when(F.col("gold_risk"), "high_risk").when(F.col("domains") > 1, "multi_domain").when(F.col("mixed"), "mixed_signal").when(F.col("gold_asks"), "ambiguous").otherwise("normal")
    return all_.select("case_id", F.coalesce("domain", F.lit("none")).alias("domain"), F.when(F.col("turn_count") == 1, "easy").when(F.col("turn_count") == 2, "moderate").otherwise("hard").alias("difficulty"), kind.alias("case_type"), F.when(F.col("gold_risk"), "SELF_HARM").otherwise("SAFE").alias("risk_category"), "route", "turn_count")


_DIMENSIONS = ("domain", "difficulty", "case_type", "risk_category", "route")


@query(f"{_TRAITS} SELECT dimension, value, count(*) AS n FROM (SELECT {', '.join(_DIMENSIONS)} FROM traits) UNPIVOT (value FOR dimension IN ({', '.join(_DIMENSIONS)})) GROUP BY ALL")
def frequency_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All five counters in one scan."""
    return ev.frequencies(traits(spark, folder), _DIMENSIONS)
