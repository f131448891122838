"""Queries over the assessment log, turns, signals and the knowledge graph, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scoring as sc
from quern.functions import text as tx
from quern.operators import evaluation as ev
from quern.operators import generation, graph, history, validation
from quern.plans.registry import Registry
from quern.sources.tables import table
from quern.streaming import conversations

registry = Registry()
query, QUERIES, SQL = registry.query, registry.queries, registry.sql


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- history ------------------------------------------------------------------------------------

_LOGS = "logs AS (SELECT DISTINCT id, user_id, node_id, category, upper(trim(status, ' ')) AS status, score, confidence, created_at FROM resilience_logs WHERE created_at IS NOT NULL)"
_DOMAINS = "('Personal_Resilience'), ('Political_Resilience'), ('Economic_Resilience'), ('Physical_Resilience'), ('Social_Resilience'), ('Spiritual_Cultural_Resilience')"
_DOMAIN_OF = "replace(lower(trim(category, ' ')), ' ', '_')"


def _logs(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows with a moment, each delivered row once, status in one spelling."""
    logs = table(spark, folder, "resilience_logs").where("created_at IS NOT NULL").select("id", "user_id", "node_id", "category", F.upper(F.trim("status")).alias("status"), "score", "confidence", "created_at")
    return logs.distinct()


_LATEST = _LOGS + ", newest AS (SELECT user_id, node_id, max(created_at) AS at FROM logs GROUP BY ALL), latest AS (SELECT logs.* FROM logs JOIN newest n ON logs.user_id IS NOT DISTINCT FROM n.user_id AND logs.node_id IS NOT DISTINCT FROM n.node_id AND logs.created_at = n.at)"


@query(f"""
WITH {_LATEST}, domains(domain) AS (VALUES {_DOMAINS}),
means AS (SELECT user_id, lower(domain) AS d, avg(score) AS mean_score, count(score) AS n FROM latest JOIN domains ON lower(domain) = {_DOMAIN_OF} GROUP BY ALL)
SELECT u.user_id, domain, round(coalesce(mean_score, 0.0), 6) AS mean_score, coalesce(n, 0) AS n
FROM (SELECT DISTINCT user_id FROM latest) u CROSS JOIN domains LEFT JOIN means m ON u.user_id IS NOT DISTINCT FROM m.user_id AND lower(domain) = m.d""")
def domain_mean_latest(spark: SparkSession, folder: str) -> DataFrame:
    """J1, G1, G2, J14, P18."""
    rows = history.domain_means(history.latest(_logs(spark, folder)), "user_id", history.domain(F.col("category")), "score")
    return rows.select("user_id", "domain", r6("mean_score").alias("mean_score"), "n")


@query(f"WITH {_LATEST} SELECT user_id, node_id, id, status, score, CASE WHEN score >= 70 THEN 'GREEN' WHEN score >= 40 THEN 'YELLOW' WHEN score IS NOT NULL THEN 'RED' END AS derived FROM latest")
def latest_status_per_node(spark: SparkSession, folder: str) -> DataFrame:
    """J1, P2; all rows of a tie."""
    return history.latest(_logs(spark, folder)).select("user_id", "node_id", "id", "status", "score", sc.status(F.col("score")).alias("derived"))


_PLACED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at {0}, id {0}) AS place FROM logs"


@query(f"WITH {_LOGS} SELECT user_id, CAST(place AS INTEGER) AS place, id, strftime(created_at, '%Y-%m-%d %H:%M') AS at, CAST(trunc(confidence * 100) AS INTEGER) AS percent FROM ({_PLACED.format('DESC')}) WHERE place <= 20")
def recent_history(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's 20 newest rows."""
    rows = history.first_rows(_logs(spark, folder), "user_id", "created_at", "id", 20, newest=True)
    return rows.select("user_id", "place", "id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("at"), (F.col("confidence") * 100).cast("int").alias("percent"))


@query(f"WITH {_LOGS} SELECT user_id, CAST(place AS INTEGER) AS place, id, strftime(created_at, '%Y-%m-%d') AS day FROM ({_PLACED.format('ASC')}) WHERE place <= 50")
def timeline_oldest50(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's 50 oldest rows."""
    rows = history.first_rows(_logs(spark, folder), "user_id", "created_at", "id", 50, newest=False)
    return rows.select("user_id", "place", "id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(f"""
WITH {_LOGS}, placed AS ({_PLACED.format('ASC')}),
lines AS (SELECT user_id, node_id, min((created_at, id)) AS first, '• Node ' || node_id || ' Timeline: ' || string_agg('[' || strftime(created_at, '%Y-%m-%d') || '] ' || coalesce(status, 'UNKNOWN') || '(' || coalesce(CAST(score AS VARCHAR), 'N/A') || ')', ' ➔ ' ORDER BY created_at, id) AS line
  FROM placed WHERE place <= 50 GROUP BY user_id, node_id)
SELECT user_id, string_agg(line, chr(10) ORDER BY first) AS timeline FROM lines GROUP BY user_id""")
def timeline_text(spark: SparkSession, folder: str) -> DataFrame:
    """P15 over each user's 50 oldest rows."""
    rows = history.first_rows(_logs(spark, folder), "user_id", "created_at", "id", 50, newest=False)
    return history.timeline_text(rows, "user_id", "node_id", "created_at", "id", F.col("status"), F.col("score"))


@query("""
SELECT id, user_id, node_id, coalesce(category, 'Personal_Resilience') AS category,
  upper(coalesce(status, CASE WHEN s >= 70 THEN 'GREEN' WHEN s >= 40 THEN 'YELLOW' ELSE 'RED' END)) AS status, CAST(s AS INTEGER) AS score, coalesce(confidence, 0.0) AS confidence
FROM (SELECT *, coalesce(score, id % 26 + id % 23 + id % 19 + id % 17) AS s FROM resilience_logs)""")
def persist_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows with defaults; missing scores from rubric values derived of the id."""
    logs = table(spark, folder, "resilience_logs")
    rubric = {d: (F.col("id") % m).cast("int") for d, m in zip(sc.DIMENSIONS, (26, 23, 19, 17), strict=True)}
    done = history.persisted(logs.withColumns(rubric).withColumn("reasoning", F.col("id").cast("string")))
    return done.select(F.col("reasoning").cast("long").alias("id"), "user_id", "node_id", "category", "status", "score", "confidence")


@query("SELECT a.id, trim(a.username, ' ') AS username FROM users a WHERE NOT EXISTS (SELECT 1 FROM users b WHERE b.id < a.id AND trim(b.username, ' ') = trim(a.username, ' ')) AND trim(a.username, ' ') != ''")
def registered_names(spark: SparkSession, folder: str) -> DataFrame:
    """The first holder of each trimmed name."""
    users = table(spark, folder, "users").withColumn("username", F.trim("username")).where("username != ''")
    return users.groupBy("username").agg(F.min("id").alias("id"))


# --- turns, signals, confidence, routes -----------------------------------------------------------

_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TURNS = "turns AS (SELECT DISTINCT turn_id, thread_id, turn_index, user_message, upper(trim(safety_status, ' ')) AS safety_status, active_nodes, requires_disambiguation, final_response FROM agent_turns)"
#: Rubric values of the rules below are derived of the turn's id, as the tables hold none that break a rule.
_RUBRIC = {"severity": 7, "frequency": 11, "functional": 13, "coping": 17}
_DIMS = ", ".join(f"CAST((turn_id * {m}) % 26 AS INTEGER) AS {d}" for d, m in _RUBRIC.items())
#: What was assessed of a turn's node: the newest log row of its user for the node.
_ASSESSED = f"""{_TURNS},
newest AS (SELECT user_id, node_id, upper(trim(status, ' ')) AS status, CAST(round(coalesce(confidence, 0) * 100) AS INTEGER) AS raw FROM (SELECT DISTINCT * FROM resilience_logs) WHERE created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, node_id ORDER BY created_at DESC, id DESC) = 1),
assessed AS (SELECT turn_id, a.node_id, coalesce(status, '-') AS status, raw FROM (SELECT DISTINCT turn_id, user_id, unnest(active_nodes) AS node_id FROM agent_turns) a JOIN newest n ON a.user_id = n.user_id AND a.node_id = n.node_id),
last_signal AS (SELECT turn_id, node_id, arg_max((detected_signal, evidence), signal_id) AS s FROM active_signals GROUP BY ALL),
matched AS (SELECT a.*, coalesce(s[1], 'mixed') AS polarity, trim(regexp_replace(coalesce(s[2], ''), '{_BLANKS}', ' ', 'g'), ' ') AS evidence FROM assessed a LEFT JOIN last_signal l USING (turn_id, node_id)),
weighed AS (SELECT *, CASE WHEN evidence = '' THEN 0 ELSE least(4, len(string_split(evidence, ' '))) END AS words,
  CASE WHEN (status, lower(polarity)) IN (('RED', 'negative'), ('GREEN', 'positive')) THEN 100 WHEN status = 'YELLOW' AND lower(polarity) IN ('positive', 'negative', 'mixed') THEN 80 WHEN (status, lower(polarity)) IN (('RED', 'positive'), ('GREEN', 'negative')) THEN 0 ELSE 50 END AS agree FROM matched),
calibrated AS (SELECT turn_id, node_id, status, polarity, words, (30 * raw + 750 * words + 40 * agree + 50) // 100 AS percent FROM weighed)"""


def _turns(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each delivered turn once with the named columns: repeats are alike, so they meet by id and texts nobody asks for are not moved."""
    turns = table(spark, folder, "agent_turns").withColumn("safety_status", F.upper(F.trim("safety_status")))
    return turns.select("turn_id", *columns).dropDuplicates(["turn_id"])


def _calibrated(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _turns(spark, folder, "user_id", "active_nodes").select("turn_id", "user_id", F.explode(F.array_distinct("active_nodes")).alias("node_id"))
    logs = table(spark, folder, "resilience_logs").where("created_at IS NOT NULL").select("user_id", "node_id", F.struct("created_at", "id").alias("at"), F.struct(F.coalesce(F.upper(F.trim("status")), F.lit("-")).alias("status"), F.coalesce("confidence", F.lit(0.0)).alias("raw")).alias("v"))
    newest = logs.groupBy("user_id", "node_id").agg(F.max_by("v", "at").alias("v")).select("user_id", "node_id", "v.*")
    assessed = nodes.join(newest, ["user_id", "node_id"]).drop("user_id")
    signals = ev.last_wins(table(spark, folder, "active_signals"), ["turn_id", "node_id"], "signal_id", ["detected_signal", "evidence"])
    joined = assessed.join(signals, ["turn_id", "node_id"], "left")
    words = F.size(tx.words(tx.squeezed(F.coalesce("evidence", F.lit("")))))
    polarity = F.coalesce("detected_signal", F.lit("mixed"))
    return joined.select("turn_id", "node_id", "status", polarity.alias("polarity"), F.least(words, F.lit(4)).alias("words"), sc.confidence(F.col("raw"), words, F.col("status"), polarity).alias("confidence"))


@query(f"WITH {_ASSESSED} SELECT turn_id, node_id, status, polarity, CAST(words AS INTEGER) AS words, percent / 100.0::DOUBLE AS confidence FROM calibrated")
def calibrated_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """P3, P4, J2."""
    return _calibrated(spark, folder).select("turn_id", "node_id", "status", "polarity", "words", "confidence")


@query(f"WITH {_ASSESSED} SELECT turn_id, bool_or(percent < 70) AS flagged, CAST(count(*) AS BIGINT) AS n FROM calibrated GROUP BY turn_id")
def disambiguation_flag(spark: SparkSession, folder: str) -> DataFrame:
    """P5."""
    return _calibrated(spark, folder).groupBy("turn_id").agg(F.bool_or(F.col("confidence") < sc.ROUTE_FROM).alias("flagged"), F.count("*").alias("n"))


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    per = _calibrated(spark, folder).groupBy("turn_id").agg(F.collect_list("confidence").alias("confidences"))
    turns = _turns(spark, folder, "safety_status", "requires_disambiguation").join(per, "turn_id", "left")
    return turns.select(
        "turn_id",
        sc.route_after_safety(F.col("safety_status")).alias("gate"),
        sc.route_after_assessment(F.col("requires_disambiguation"), F.col("confidences")).alias("after"),
        sc.derived_route(F.col("safety_status"), F.col("requires_disambiguation"), F.col("confidences")).alias("derived"),
        F.when(F.col("safety_status") == "HIGH_RISK", "emergency_response").when(F.col("requires_disambiguation"), "questioner").otherwise("advisor").alias("expected"),
    )


_ROUTED = f"""{_ASSESSED},
per AS (SELECT turn_id, min(percent) AS least FROM calibrated GROUP BY turn_id),
routed AS (SELECT t.turn_id,
  CASE safety_status WHEN 'HIGH_RISK' THEN 'emergency_response' WHEN 'UNAVAILABLE' THEN 'service_unavailable' ELSE 'extractor' END AS gate,
  CASE WHEN coalesce(requires_disambiguation, false) OR least IS NULL OR least < 70 THEN 'questioner' ELSE 'advisor' END AS after,
  CASE WHEN safety_status = 'HIGH_RISK' THEN 'emergency_response' WHEN safety_status = 'UNAVAILABLE' OR coalesce(requires_disambiguation, false) OR least IS NULL OR least < 70 THEN 'questioner' ELSE 'advisor' END AS derived,
  CASE WHEN safety_status = 'HIGH_RISK' THEN 'emergency_response' WHEN requires_disambiguation THEN 'questioner' ELSE 'advisor' END AS expected
  FROM turns t LEFT JOIN per USING (turn_id))"""


@query(f"WITH {_ROUTED} SELECT turn_id, gate, after FROM routed")
def route_online(spark: SparkSession, folder: str) -> DataFrame:
    """P6, P7."""
    return _routed(spark, folder).select("turn_id", "gate", "after")


@query(f"WITH {_ROUTED} SELECT turn_id, derived FROM routed")
def route_offline(spark: SparkSession, folder: str) -> DataFrame:
    """P8."""
    return _routed(spark, folder).select("turn_id", "derived")


# --- text ------------------------------------------------------------------------------------------

_NORMAL = rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(translate(coalesce({{0}}, ''), '{tx.LETTERS_FROM}', '{tx.LETTERS_TO}'), '[\x{{{{64B}}}}-\x{{{{65F}}}}\x{{{{670}}}}]', '', 'g'), '[\x{{{{200C}}}}\x{{{{200D}}}}\r\n\t\f\x0B!?,.:;\x{{{{61B}}}}\x{{{{61F}}}}\"''()\-\[\]{{{{}}}}<>/\\]', ' ', 'g'), '{_BLANKS.replace('{', '{{').replace('}', '}}')}', ' ', 'g'), ' '))"
_CRISIS = " OR ".join(f"contains(body, '{p}')" for p in tx.CRISIS)


@query(f"SELECT DISTINCT turn_id, {_NORMAL.format('user_message')} AS body FROM agent_turns")
def text_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """P9."""
    return table(spark, folder, "agent_turns").select("turn_id", tx.normalized("user_message").alias("body")).distinct()


@query(f"WITH b AS (SELECT DISTINCT turn_id, {_NORMAL.format('user_message')} AS body, upper(trim(safety_status, ' ')) AS s FROM agent_turns) SELECT turn_id, ({_CRISIS}) AS crisis, CASE WHEN {_CRISIS} THEN 'HIGH_RISK' ELSE coalesce(s, 'UNAVAILABLE') END AS verdict FROM b")
def crisis_flag(spark: SparkSession, folder: str) -> DataFrame:
    """The heuristic goes before the stored verdict; without one the check was unavailable."""
    turns = table(spark, folder, "agent_turns").select("turn_id", "user_message", F.upper(F.trim("safety_status")).alias("s")).distinct()
    flag = tx.crisis("user_message")
    return turns.select("turn_id", flag.alias("crisis"), F.when(flag, "HIGH_RISK").otherwise(F.coalesce("s", F.lit("UNAVAILABLE"))).alias("verdict"))


@query(f"""WITH {_LOGS}, g AS (SELECT status AS p, CASE WHEN score >= 70 THEN 'GREEN' WHEN score >= 40 THEN 'YELLOW' WHEN score IS NOT NULL THEN 'RED' END AS g FROM logs),
labels AS (SELECT g AS label FROM g WHERE g IS NOT NULL UNION SELECT p FROM g WHERE p IS NOT NULL),
n AS (SELECT label, count(*) FILTER (g = label) AS support, count(*) FILTER (p = label) AS predicted, count(*) FILTER (g = label AND p = label) AS hits FROM labels CROSS JOIN g GROUP BY label)
SELECT label, support, predicted, round(coalesce(hits / nullif(predicted, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(hits / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * hits / nullif(predicted + support, 0)::DOUBLE, 0), 6) AS f1 FROM n""")
def multiclass_report(spark: SparkSession, folder: str) -> DataFrame:
    """Stated status against the status of the score."""
    rows = ev.by_class(_logs(spark, folder).select(sc.status(F.col("score")).alias("gold"), "status"), "gold", "status")
    return rows.select("label", "support", "predicted", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_LOGS}, g AS (SELECT status AS p, CASE WHEN score >= 70 THEN 'GREEN' WHEN score >= 40 THEN 'YELLOW' WHEN score IS NOT NULL THEN 'RED' END AS g FROM logs), k AS (SELECT * FROM g WHERE g IS NOT NULL AND p IS NOT NULL),
labels AS (SELECT g AS label FROM k UNION SELECT p FROM k),
n AS (SELECT label, count(*) FILTER (g = label) AS support, count(*) FILTER (p = label) AS predicted, count(*) FILTER (g = label AND p = label) AS hits FROM labels CROSS JOIN k GROUP BY label)
SELECT CAST(sum(support) AS BIGINT) AS total, round(sum(hits) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(coalesce(hits / nullif(predicted, 0)::DOUBLE, 0)), 6) AS macro_precision, round(avg(coalesce(hits / nullif(support, 0)::DOUBLE, 0)), 6) AS macro_recall, round(avg(coalesce(2 * hits / nullif(predicted + support, 0)::DOUBLE, 0)), 6) AS macro_f1 FROM n""")
def multiclass_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy and macro means."""
    one = ev.class_summary(_logs(spark, folder).select(sc.status(F.col("score")).alias("gold"), "status"), "gold", "status")
    return one.select("total", *[r6(c).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


# --- rubric, alignment, rules ------------------------------------------------------------------------


_CASES = f"""{_TURNS},
cases AS (SELECT thread_id AS case_id, max(turn_index) + 1 AS turn_count, list(user_message ORDER BY turn_index) AS messages, bool_or(coalesce(safety_status = 'HIGH_RISK', false)) AS high_risk,
  CASE WHEN max(turn_id) % 7 = 0 THEN 'VIOLENCE' ELSE 'SAFE' END AS risk_category, CASE max(turn_id) % 3 WHEN 0 THEN 'emergency_response' WHEN 1 THEN 'questioner' ELSE 'advisor' END AS route, CASE max(turn_id) % 2 WHEN 0 THEN 'low' ELSE 'high' END AS confidence_class
  FROM turns GROUP BY thread_id),
ass AS (SELECT thread_id AS case_id, node_id, {_DIMS.replace('26', '28')}, upper(trim(safety_status, ' ')) AS status FROM (SELECT turn_id, thread_id, safety_status, unnest(active_nodes) AS node_id FROM turns) WHERE node_id IS NOT NULL),
sig AS (SELECT thread_id AS case_id, node_id, evidence, CAST(turn_index AS INTEGER) AS message_index FROM active_signals JOIN turns USING (turn_id))"""


def _cases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = _turns(spark, folder, "thread_id", "turn_index", "user_message", "safety_status", "active_nodes")
    last = F.max("turn_id")
    cases = turns.groupBy(F.col("thread_id").alias("case_id")).agg(
        (F.max("turn_index") + 1).alias("turn_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "turn_id", "user_message"))), lambda x: x["user_message"]).alias("messages"),
        F.bool_or(F.coalesce(F.col("safety_status") == "HIGH_RISK", F.lit(False))).alias("high_risk"),
        F.when(last % 7 == 0, "VIOLENCE").otherwise("SAFE").alias("risk_category"),
        F.element_at(F.array(F.lit("emergency_response"), F.lit("questioner"), F.lit("advisor")), (last % 3).cast("int") + 1).alias("route"),
        F.when(last % 2 == 0, "low").otherwise("high").alias("confidence_class"),
    )
    rubric = [((F.col("turn_id") * m) % 28).cast("int").alias(d) for d, m in _RUBRIC.items()]
    assessed = turns.select("turn_id", F.col("thread_id").alias("case_id"), F.col("safety_status").alias("status"), F.explode("active_nodes").alias("node_id")).where("node_id IS NOT NULL").select("case_id", "node_id", *rubric, "status")
    signals = table(spark, folder, "active_signals").join(turns.select("turn_id", "thread_id", "turn_index"), "turn_id").select(F.col("thread_id").alias("case_id"), "node_id", "evidence", F.col("turn_index").alias("message_index"))
    return cases, assessed, signals


_TOTAL = "(severity + frequency + functional + coping)"


@query(f"""WITH {_CASES}
SELECT case_id, 'V4' AS rule, 'case_id' AS detail FROM cases WHERE coalesce(trim(case_id, ' '), '') = ''
UNION ALL SELECT case_id, 'V10', risk_category FROM cases WHERE high_risk AND risk_category = 'SAFE'
UNION ALL SELECT case_id, 'V11', risk_category FROM cases WHERE NOT high_risk AND risk_category != 'SAFE'
UNION ALL SELECT case_id, 'V12', route FROM cases WHERE high_risk AND route != 'emergency_response'
UNION ALL SELECT case_id, 'V13', route FROM cases WHERE NOT high_risk AND route = 'emergency_response'
UNION ALL SELECT case_id, 'V14', confidence_class FROM cases WHERE route = 'questioner' AND confidence_class != 'low'
UNION ALL SELECT case_id, 'V15', confidence_class FROM cases WHERE route = 'advisor' AND confidence_class != 'high'
UNION ALL SELECT case_id, 'V16', CAST(len(messages) AS VARCHAR) FROM cases WHERE len(messages) != turn_count
UNION ALL SELECT case_id, 'V17', CAST(i - 1 AS VARCHAR) FROM (SELECT case_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM cases) WHERE m IS NULL OR trim(m, ' ') = ''
UNION ALL SELECT case_id, 'V1', node_id FROM ass WHERE greatest(severity, frequency, functional, coping) > 25
UNION ALL SELECT case_id, 'V2', CAST({_TOTAL} AS VARCHAR) FROM ass WHERE {_TOTAL} > 100
UNION ALL SELECT case_id, 'V3', coalesce(status, '') FROM ass WHERE status IS DISTINCT FROM CASE WHEN {_TOTAL} >= 70 THEN 'GREEN' WHEN {_TOTAL} >= 40 THEN 'YELLOW' ELSE 'RED' END
UNION ALL SELECT DISTINCT case_id, 'V5', node_id FROM sig WHERE node_id NOT IN (SELECT node_id FROM graph_nodes)
UNION ALL SELECT DISTINCT case_id, 'V6', node_id FROM ass WHERE node_id NOT IN (SELECT node_id FROM graph_nodes)
UNION ALL SELECT case_id, 'V7', node_id FROM sig GROUP BY case_id, node_id HAVING count(*) > 1
UNION ALL SELECT case_id, 'V8', node_id FROM ass GROUP BY case_id, node_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT case_id, 'V9', node_id FROM sig WHERE (case_id, node_id) NOT IN (SELECT (case_id, node_id) FROM ass)
UNION ALL SELECT * FROM (SELECT s.case_id, CASE WHEN coalesce(trim(evidence, ' '), '') = '' THEN 'V18' WHEN message_index IS NULL THEN 'V19' WHEN message_index < 0 OR message_index >= len(messages) THEN 'V20' WHEN NOT contains(coalesce(messages[message_index + 1], ''), evidence) THEN 'V21' END AS rule, node_id FROM sig s JOIN cases c ON s.case_id = c.case_id) WHERE rule IS NOT NULL""")
def validate_rules(spark: SparkSession, folder: str) -> DataFrame:
    """V1-V23 over threads as cases."""
    cases, assessed, signals = _cases(spark, folder)
    rows = validation.case_rules(cases, strict=True).unionByName(validation.rubric_rules(assessed))
    rows = rows.unionByName(validation.node_rules(signals, assessed, table(spark, folder, "graph_nodes")))
    return rows.unionByName(validation.evidence_rules(signals, cases))


# --- graph ------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT * FROM graph_edges QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY relation_type DESC NULLS LAST, description DESC NULLS LAST) = 1), valid AS (SELECT * FROM e WHERE source_id IN (SELECT node_id FROM graph_nodes) AND target_id IN (SELECT node_id FROM graph_nodes))"


def _edges(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, folder, "graph_nodes")
    return nodes, graph.valid_edges(graph.single_edges(table(spark, folder, "graph_edges")), nodes)


@query(f"WITH {_EDGES} SELECT source_id, target_id, relation_type, description FROM valid")
def graph_edges_valid(spark: SparkSession, folder: str) -> DataFrame:
    """S8, J8."""
    return _edges(spark, folder)[1].select("source_id", "target_id", "relation_type", "description")


@query(f"WITH {_EDGES} SELECT source_id, target_id, coalesce(name_fa, target_id) AS target_name FROM valid JOIN graph_nodes ON target_id = node_id")
def graph_successors(spark: SparkSession, folder: str) -> DataFrame:
    """J10."""
    nodes, edges = _edges(spark, folder)
    return graph.successors(edges, nodes).select("source_id", "target_id", "target_name")


@query("SELECT signal_id, node_id FROM active_signals WHERE node_id NOT IN (SELECT node_id FROM graph_nodes)")
def unknown_signal_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """J11, S10."""
    return graph.unknown_nodes(table(spark, folder, "active_signals"), table(spark, folder, "graph_nodes")).select("signal_id", "node_id")


_BLOCKS = f"""{_EDGES},
levels AS (SELECT node_id, string_agg('  - [' || upper(k) || '] (' || coalesce(v.code, '') || '): ' || coalesce(v.description, '') || chr(10), '' ORDER BY k) AS t FROM (SELECT node_id, unnest(map_keys(status_levels)) AS k, unnest(map_values(status_levels)) AS v FROM graph_nodes) WHERE v IS NOT NULL GROUP BY node_id),
acts AS (SELECT node_id, string_agg('  - ' || k || ': ' || coalesce(v, '') || chr(10), '' ORDER BY k) AS t FROM (SELECT node_id, unnest(map_keys(interventions)) AS k, unnest(map_values(interventions)) AS v FROM graph_nodes) GROUP BY node_id),
outs AS (SELECT source_id AS node_id, string_agg('  -> Affects ''' || coalesce(name_fa, target_id) || ''' [' || target_id || '] | Relation: ' || coalesce(relation_type, '') || ' (' || coalesce(v.description, '') || ')' || chr(10), '' ORDER BY target_id) AS t FROM valid v JOIN graph_nodes ON target_id = node_id GROUP BY source_id),
blocks AS (SELECT n.node_id, '=== Node: ' || n.node_id || ' (' || coalesce(name_fa, '') || ') ===' || chr(10) || 'Domain: ' || coalesce(domain, '') || chr(10) || 'Description: ' || coalesce(description, '') || chr(10) || chr(10) || 'Status Level Definitions:' || chr(10) || coalesce(l.t, '') || chr(10) || 'Recommended Interventions:' || chr(10) || coalesce(a.t, '') || CASE WHEN o.t IS NOT NULL THEN chr(10) || 'Cross-Domain Impacts on Other Nodes:' || chr(10) || o.t ELSE '' END AS block
  FROM graph_nodes n LEFT JOIN levels l USING (node_id) LEFT JOIN acts a USING (node_id) LEFT JOIN outs o USING (node_id))"""


@query(f"""WITH {_TURNS}, {_BLOCKS}, asked AS (SELECT DISTINCT turn_id, unnest(active_nodes) AS node_id FROM turns)
SELECT t.turn_id, CASE WHEN count(a.node_id) = 0 THEN 'No specific resilience domains were activated.' ELSE chr(10) || repeat('=', 50) || coalesce(string_agg(block, chr(10) ORDER BY a.node_id), '') END AS context
FROM (SELECT DISTINCT turn_id FROM turns) t LEFT JOIN asked a USING (turn_id) LEFT JOIN blocks b ON a.node_id = b.node_id GROUP BY t.turn_id""")
def graph_context_text(spark: SparkSession, folder: str) -> DataFrame:
    """The context of every turn."""
    nodes, edges = _edges(spark, folder)
    return graph.turn_context(_turns(spark, folder, "active_nodes"), "turn_id", "active_nodes", nodes, edges)


@query("""SELECT signal_id, '• Target Node: ' || node_id || chr(10) || '  - Extracted Polarity: ' || upper(coalesce(detected_signal, 'mixed')) || chr(10) || '  - Exact User Substring (Evidence): "' || coalesce(evidence, '') || '"' AS line,
CASE lower(coalesce(detected_signal, 'mixed')) WHEN 'positive' THEN 'up' WHEN 'negative' THEN 'down' WHEN 'mixed' THEN 'both' ELSE upper(detected_signal) END AS label FROM active_signals""")
def signal_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A signal's text and the label of its polarity."""
    p = F.coalesce("detected_signal", F.lit("mixed"))
    line = F.format_string('• Target Node: %s\n  - Extracted Polarity: %s\n  - Exact User Substring (Evidence): "%s"', "node_id", F.upper(p), F.coalesce("evidence", F.lit("")))
    label = F.when(F.lower(p) == "positive", "up").when(F.lower(p) == "negative", "down").when(F.lower(p) == "mixed", "both").otherwise(F.upper(p))
    return table(spark, folder, "active_signals").select("signal_id", line.alias("line"), label.alias("label"))


# --- conversations ---------------------------------------------------------------------------------

_ONCE = f"{_TURNS}, once AS (SELECT DISTINCT ON (thread_id, turn_index) * FROM turns WHERE thread_id IS NOT NULL ORDER BY thread_id, turn_index, turn_id)"


@query(f"WITH {_ONCE} SELECT thread_id, count(*) AS turns, arg_max(coalesce(safety_status, '-'), turn_index) AS last_status, count(user_message) AS n_messages FROM once GROUP BY thread_id")
def conversation_state(spark: SparkSession, folder: str) -> DataFrame:
    """The batch form of the keyed stream state."""
    turns = _turns(spark, folder, "thread_id", "turn_index", "safety_status", "user_message").withColumn("safety_status", F.coalesce("safety_status", F.lit("-")))
    return conversations.threads(turns)


# --- generation --------------------------------------------------------------------------------------


@query("""WITH b(name, position, weight) AS (VALUES ('easy_normal', 0, 20), ('moderate_normal', 1, 20), ('hard_ambiguous', 2, 15), ('moderate_mixed_signal', 3, 15), ('hard_multi_domain', 4, 10), ('hard_high_risk', 5, 10), ('adversarial', 6, 10)),
f AS (SELECT *, (97 * weight) // 100 AS base, (97 * weight) % 100 AS rest FROM b)
SELECT name, position, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, position) <= 97 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM f""")
def largest_remainder(spark: SparkSession, folder: str) -> DataFrame:
    """T4, N2."""
    weights = spark.createDataFrame([(b[0], i, b[1]) for i, b in enumerate(generation.BUCKETS)], "name string, position int, weight int")
    return generation.largest_remainder(weights, 97)


@query()
def gold_generator(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes differ between engines, so rows are tested on their own."""
    return generation.cases(spark, table(spark, folder, "graph_nodes").select("node_id", "domain"), 100)
