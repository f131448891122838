"""Queries for prompts, messages, evidence and checks of rendered cases, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph, rendering, validation
from quern.plans import evaluation as pe
from quern.plans.registry import Registry
from quern.sources.tables import table

registry = Registry()
query, QUERIES, SQL = registry.query, registry.queries, registry.sql

_T = pe._RUNS.split(",\nended AS")[0]


@query(f"""WITH {_T} SELECT case_id, 2 * turn_index AS position, 'human' AS type, 'user' AS role, user_message AS content, '{{}}' AS additional_kwargs, '{{}}' AS response_metadata FROM t WHERE user_message IS NOT NULL
UNION ALL SELECT case_id, 2 * turn_index + 1, 'ai', 'assistant', final_response, '{{}}', '{{}}' FROM t WHERE final_response IS NOT NULL""")
def chat_history(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of every thread with their roles."""
    rows = pe.turns(spark, folder, "user_message", "final_response")
    said = F.array(*[F.struct((2 * F.col("turn_index") + k).alias("position"), rendering.message(F.lit(kind), F.col(c)).alias("m")) for k, (kind, c) in enumerate((("human", "user_message"), ("ai", "final_response")))])
    each = rows.select("case_id", F.inline(said)).select("case_id", "position", "m.*").where("content IS NOT NULL")
    return each.withColumn("role", rendering.role(F.col("type")))


@query("SELECT DISTINCT turn_id, user_id, user_message, CAST(NULL AS VARCHAR) AS safety_status, false AS safety_flag, '' AS subgraph_context, false AS requires_disambiguation, coalesce(final_response, 'پاسخی از سمت سیستم دریافت نشد.') AS served FROM agent_turns")
def initial_states(spark: SparkSession, folder: str) -> DataFrame:
    """The state a turn begins with, and what is shown of its response."""
    rows = table(spark, folder, "agent_turns").select("turn_id", "user_id", "user_message", "final_response").dropDuplicates(["turn_id"])
    state = rendering.initial_state(rows.withColumn("both", F.struct("turn_id", "final_response", "user_id")), "both", "user_message")
    return state.select("user_id.turn_id", "user_id.user_id", "user_message", "safety_status", "safety_flag", "subgraph_context", "requires_disambiguation", rendering.served(F.col("user_id.final_response")).alias("served"))


_BLOCK = """blocks AS (SELECT turn_id, string_agg('• Target Node: ' || coalesce(node_id, 'None') || chr(10) || '  - Extracted Polarity: ' || upper(coalesce(detected_signal, 'mixed')) || chr(10) || '  - Exact User Substring (Evidence): "' || coalesce(evidence, '') || '"', chr(10) ORDER BY signal_id) AS block FROM active_signals GROUP BY turn_id)"""


@query(f"""WITH {_BLOCK} SELECT turn_id, '=== EXTRACTED SIGNALS & EVIDENCE ===' || chr(10) || coalesce(block, 'No explicit extracted signals provided.') || chr(10) || chr(10) || '=== FULL USER MESSAGE ===' || chr(10) || coalesce(user_message, '') AS prompt FROM (SELECT DISTINCT turn_id, user_message FROM agent_turns) LEFT JOIN blocks USING (turn_id)""")
def assessor_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn's signals in one block, or a sentence for none."""
    rows = table(spark, folder, "agent_turns").select("turn_id", "user_message").dropDuplicates(["turn_id"])
    blocks = rendering.evidence_blocks(table(spark, folder, "active_signals"), "turn_id", "signal_id")
    return rendering.assessor_input(rows, blocks, "turn_id", "user_message")


_Q = "coalesce(to_json({0}), 'null')"
_LIST = "'[' || chr(10) || string_agg('    {{' || chr(10) || '      \"concept\": ' || " + _Q.format("node_id") + " || ',' || chr(10) || '      \"{0}\": ' || coalesce(to_json({1})::VARCHAR, 'null') || chr(10) || '    }}', ',' || chr(10) ORDER BY node_id) || chr(10) || '  ]'"


@query(f"""{pe._TRAITS}, s AS (SELECT case_id, {_LIST.format('polarity', 'polarity')} AS text FROM gold_signals GROUP BY case_id),
a AS (SELECT case_id, {_LIST.format('level', 'level')} AS text FROM (SELECT case_id, node_id, CASE status WHEN 'GREEN' THEN 'relatively strong resilience' WHEN 'YELLOW' THEN 'moderate or mixed resilience' ELSE 'low resilience or significant difficulty' END AS level FROM gold_assessed) GROUP BY case_id)
SELECT case_id, '{{' || chr(10) || '  "domain": ' || {_Q.format('domain')} || ',' || chr(10) || '  "difficulty": ' || {_Q.format('difficulty')} || ',' || chr(10) || '  "case_type": ' || {_Q.format('case_type')} || ',' || chr(10) || '  "turn_count": ' || turn_count || ',' || chr(10) || '  "safety_category": ' || {_Q.format('risk_category')} || ',' || chr(10) || '  "signals": ' || coalesce(s.text, '[]') || ',' || chr(10) || '  "assessment_levels": ' || coalesce(a.text, '[]') || chr(10) || '}}' AS prompt FROM traits LEFT JOIN s USING (case_id) LEFT JOIN a USING (case_id)""")
def scenario_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Every case as an indented JSON scenario."""
    cases = pe.frames(spark, folder)
    gold, _ = pe.sides(cases, spark, folder)
    assessed, _ = pe.assessments(cases, spark, folder)
    score = sum((F.col(f"gold_{d}") for d in pe.sc.DIMENSIONS[1:]), F.col(f"gold_{pe.sc.DIMENSIONS[0]}"))
    return rendering.scenario_prompt(pe.traits(spark, folder), gold, assessed.select("case_id", "node_id", score.alias("score")))


_PIECES = """pieces AS (SELECT t.case_id, s.signal_id AS position, s.node_id, s.evidence, t.turn_index AS message_index FROM active_signals s JOIN t USING (turn_id)),
wanted AS (SELECT DISTINCT case_id, unnest(active_nodes) AS node_id FROM t WHERE turn_index = 0)"""


def _pieces(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = pe.turns(spark, folder, "active_nodes")
    signals = table(spark, folder, "active_signals").select("turn_id", F.col("signal_id").alias("position"), "node_id", "evidence")
    pieces = signals.join(rows.select("turn_id", "case_id", F.col("turn_index").alias("message_index")), "turn_id").drop("turn_id")
    wanted = rows.where("turn_index = 0").select("case_id", F.explode("active_nodes").alias("node_id")).distinct()
    return rows, wanted, pieces


@query(f"WITH {_T}, {_PIECES}, newest AS (SELECT * FROM pieces QUALIFY row_number() OVER (PARTITION BY case_id, node_id ORDER BY position DESC) = 1) SELECT w.case_id, w.node_id, n.evidence, n.message_index, n.case_id IS NULL AS missing FROM wanted w LEFT JOIN newest n ON w.case_id = n.case_id AND w.node_id = n.node_id")
def attached_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The first turn's nodes with the last evidence of their thread."""
    _, wanted, pieces = _pieces(spark, folder)
    return rendering.attach_evidence(wanted, pieces)


@query(f"""WITH {_T}, {_PIECES}, cases AS (SELECT case_id, max(turn_index) + 1 AS turn_count, list(user_message ORDER BY turn_index, turn_id) AS messages FROM t GROUP BY case_id),
strange AS (SELECT case_id, string_agg(node_id, ',' ORDER BY node_id) AS d FROM (SELECT DISTINCT case_id, node_id FROM pieces p WHERE node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM wanted w WHERE w.case_id = p.case_id AND w.node_id = p.node_id)) GROUP BY case_id),
lacking AS (SELECT case_id, string_agg(node_id, ',' ORDER BY node_id) AS d FROM (SELECT DISTINCT case_id, node_id FROM wanted w WHERE node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pieces p WHERE w.case_id = p.case_id AND w.node_id = p.node_id)) GROUP BY case_id),
wrong AS (SELECT p.case_id, position, p.node_id AS d, CASE WHEN message_index < 0 OR message_index >= len(messages) THEN 'index' WHEN NOT contains(coalesce(messages[message_index + 1], ''), coalesce(evidence, '')) THEN 'text' END AS rule FROM pieces p JOIN cases c USING (case_id)),
first AS (SELECT case_id, arg_min(rule, position) AS rule, arg_min(d, position) AS d FROM wrong WHERE rule IS NOT NULL GROUP BY case_id)
SELECT * FROM (SELECT case_id, CASE WHEN len(messages) != turn_count THEN 'count' WHEN s.d IS NOT NULL THEN 'unknown' WHEN f.rule IS NOT NULL THEN f.rule WHEN l.d IS NOT NULL THEN 'missing' END AS rule,
  CASE WHEN len(messages) != turn_count THEN len(messages) || '/' || turn_count WHEN s.d IS NOT NULL THEN s.d WHEN f.rule IS NOT NULL THEN f.d ELSE l.d END AS detail FROM cases LEFT JOIN strange s USING (case_id) LEFT JOIN first f USING (case_id) LEFT JOIN lacking l USING (case_id)) WHERE rule IS NOT NULL""")
def rendered_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Threads as rendered cases, the first rule that each breaks."""
    _, wanted, pieces = _pieces(spark, folder)
    rows = pe.turns(spark, folder, "user_message")
    cases = rows.groupBy("case_id").agg((F.max("turn_index") + 1).alias("turn_count"), F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "turn_id", "user_message"))), lambda x: x["user_message"]).alias("messages"))
    return validation.rendered_rules(cases, wanted, pieces)


@query("""SELECT 'signal' AS kind, signal_id AS id, 'enum' AS rule, 'detected_signal=' || detected_signal AS detail FROM active_signals WHERE detected_signal NOT IN ('positive', 'negative', 'mixed')
UNION ALL SELECT DISTINCT 'turn', turn_id, 'enum', 'safety_status=' || safety_status FROM agent_turns WHERE safety_status NOT IN ('SAFE', 'HIGH_RISK', 'UNAVAILABLE')
UNION ALL SELECT DISTINCT 'log', id, 'enum', 'status=' || status FROM resilience_logs WHERE status NOT IN ('GREEN', 'YELLOW', 'RED')
UNION ALL SELECT DISTINCT 'log', id, 'range', 'score=' || score FROM resilience_logs WHERE score NOT BETWEEN 1 AND 99""")
def schema_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Values outside their sets, scores at or beyond the ends of the scale."""
    parts = (
        ("signal", validation.schema_rules(table(spark, folder, "active_signals"), "signal_id", {"detected_signal": ["positive", "negative", "mixed"]})),
        ("turn", validation.schema_rules(table(spark, folder, "agent_turns"), "turn_id", {"safety_status": ["SAFE", "HIGH_RISK", "UNAVAILABLE"]}).distinct()),
        ("log", validation.schema_rules(table(spark, folder, "resilience_logs"), "id", {"status": ["GREEN", "YELLOW", "RED"]}, {"score": (1, 99)}).distinct()),
    )
    out = None
    for kind, rows in parts:
        rows = rows.select(F.lit(kind).alias("kind"), F.col(rows.columns[0]).alias("id"), "rule", "detail")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""{pe._ALL}, said AS (SELECT case_id, string_agg(coalesce(user_message, ''), chr(10) ORDER BY turn_index, turn_id) AS context FROM done GROUP BY case_id),
s AS (SELECT case_id, '[' || string_agg('{{"node_id":' || {_Q.format('node_id')} || ',"detected_signal":' || coalesce(to_json(polarity)::VARCHAR, 'null') || ',"evidence":' || coalesce(to_json(evidence)::VARCHAR, 'null') || '}}', ',' ORDER BY node_id) || ']' AS text FROM predicted_signals GROUP BY case_id),
a AS (SELECT case_id, '[' || string_agg('{{"node_id":' || {_Q.format('node_id')} || ',"severity":' || severity || ',"frequency":' || frequency || ',"functional":' || functional || ',"coping":' || coping || '}}', ',' ORDER BY node_id) || ']' AS text FROM gold_assessed GROUP BY case_id)
SELECT p.case_id, CASE WHEN final_response != '' THEN 'Judge.' || chr(10) || chr(10) || '=== USER CONTEXT ===' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || '=== EXTRACTED SIGNALS ===' || chr(10) || coalesce(s.text, '[]') || chr(10) || chr(10) || '=== ASSESSMENT ===' || chr(10) || coalesce(a.text, '[]') || chr(10) || chr(10) || '=== ADVISOR RESPONSE ===' || chr(10) || final_response || chr(10) || chr(10) || 'Return ONLY the JSON object defined by the output schema.' END AS prompt
FROM predictions p LEFT JOIN said USING (case_id) LEFT JOIN s USING (case_id) LEFT JOIN a USING (case_id)""")
def judge_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """What a judge would be asked about every prediction; null without a response."""
    cases = pe.frames(spark, folder)
    _, predicted = pe.sides(cases, spark, folder)
    gold, _ = pe.assessments(cases, spark, folder)
    listed = lambda df, *fields: df.groupBy("case_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields))), {"ignoreNullFields": "false"}).alias("j"))
    signals = listed(predicted, "node_id", F.col("polarity").alias("detected_signal"), "evidence").withColumnRenamed("j", "signals")
    assessed = listed(gold, "node_id", *[F.col(f"gold_{d}").alias(d) for d in pe.sc.DIMENSIONS]).withColumnRenamed("j", "assessed")
    last = pe.last_turn(spark, folder).join(signals, "case_id", "left").join(assessed, "case_id", "left")
    prompt = rendering.judge_prompt("Judge.", F.col("user_context"), F.coalesce("signals", F.lit("[]")), F.coalesce("assessed", F.lit("[]")), F.col("advisor_response"))
    return last.select("case_id", prompt.alias("prompt"))


@query("""WITH b AS (SELECT thread_id AS case_id, min(created_at) AS begun_at FROM agent_turns WHERE thread_id IS NOT NULL GROUP BY thread_id)
SELECT case_id, strftime(begun_at, '%Y%m%dT%H%M%S%fZ') AS run_id, 'evaluation: ' || strftime(begun_at, '%Y%m%dT%H%M%S%fZ') || ' : ' || string_split(case_id, '-')[2] || ' : ' || case_id AS thread FROM b""")
def thread_names(spark: SparkSession, folder: str) -> DataFrame:
    """Run and thread names by the beginning of each thread."""
    begun = table(spark, folder, "agent_turns").where("thread_id IS NOT NULL").groupBy(F.col("thread_id").alias("case_id")).agg(F.min("created_at").alias("at"))
    run = rendering.run_id(F.col("at"))
    return begun.select("case_id", run.alias("run_id"), rendering.thread_name(run, F.split_part("case_id", F.lit("-"), F.lit(2)), F.col("case_id")).alias("thread"))


@query("SELECT thread_id AS case_id, min(turn_id) AS position FROM agent_turns WHERE thread_id IS NOT NULL GROUP BY thread_id ORDER BY position LIMIT 25")
def first_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The first 25 cases in order of arrival."""
    begun = table(spark, folder, "agent_turns").where("thread_id IS NOT NULL").groupBy(F.col("thread_id").alias("case_id")).agg(F.min("turn_id").alias("position"))
    return rendering.first_rows(begun, "position", 25)


@query("""WITH ids AS (SELECT 'signal' AS kind, node_id, count(*) AS n FROM active_signals GROUP BY ALL UNION ALL SELECT 'edge', target_id, count(*) FROM graph_edges GROUP BY ALL UNION ALL SELECT 'edge', source_id, count(*) FROM graph_edges GROUP BY ALL)
SELECT kind, node_id, CAST(sum(n) AS BIGINT) AS n FROM ids WHERE node_id NOT IN (SELECT node_id FROM graph_nodes) GROUP BY ALL""")
def unknown_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that signals or edges name and the graph lacks."""
    edges = table(spark, folder, "graph_edges")
    named = table(spark, folder, "active_signals").select(F.lit("signal").alias("kind"), "node_id").unionByName(edges.select(F.lit("edge").alias("kind"), F.explode(F.array("source_id", "target_id")).alias("node_id")))
    return graph.unknown_nodes(named, table(spark, folder, "graph_nodes")).where("node_id IS NOT NULL").groupBy("kind", "node_id").agg(F.count("*").alias("n"))
