import json
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation as ev
from quern.operators import generation, graph, history, inference, rendering, reporting, validation
from quern.sources import jsonl
from quern.streaming import conversations


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "x": 2}\n\n{"a": 2}\n', encoding="utf-8")
    assert sorted(r.a for r in jsonl.read_jsonl(spark, str(p), "a int").collect()) == [1, 2]
    raw = spark.read.text(str(p)).where("value != ''").select(validation.unknown_fields(F.col("value"), ["a"]).alias("u"))
    assert sorted(map(tuple, (r.u for r in raw.collect()))) == [(), ("x",)]
    p.write_text('{"a": 1}\n{oops\n', encoding="utf-8")
    with pytest.raises(ValueError, match="malformed line 2 "):
        jsonl.read_jsonl(spark, str(p), "a int")
    p.write_text("", encoding="utf-8")
    with pytest.raises(ValueError, match="no rows"):
        jsonl.read_jsonl(spark, str(p), "a int")
    assert jsonl.read_jsonl(spark, str(p), "a int", allow_empty=True).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("فا", 'say "x"')], "a string, b string")
    jsonl.write_jsonl(df, str(tmp_path / "j"), single=True)
    assert "فا" in next((tmp_path / "j").glob("part-*")).read_text(encoding="utf-8")
    jsonl.write_pretty(df, str(tmp_path / "p.json"))
    assert json.loads((tmp_path / "p.json").read_text(encoding="utf-8")) == {"a": "فا", "b": 'say "x"'}
    jsonl.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().b == 'say "x"'
    assert jsonl.read_lines(spark, str(tmp_path / "j")).count() == 1


def test_graph_document(spark, tmp_path):
    doc = {"nodes": {"A": {"name_fa": "آ", "domain": "D", "description": "d", "status_levels": {"red": {"code": "R", "description": "bad"}}, "interventions": {"on_red": "rest"}}, "B": {}}, "edges": [{"source": "A", "target": "B", "type": "x", "description": "1"}, {"source": "A", "target": "B", "type": "a", "description": "2"}, {"source": "A", "target": "Z", "type": "x"}]}
    p = tmp_path / "g.json"
    p.write_text(json.dumps(doc), encoding="utf-8")
    nodes, edges = jsonl.read_graph(spark, str(p))
    edges = graph.valid_edges(graph.single_edges(edges, "position"), nodes)
    assert [(e.source_id, e.target_id, e.description) for e in edges.collect()] == [("A", "B", "2")]
    block = {r.node_id: r.block for r in graph.context(nodes, edges).collect()}
    assert "  - [RED] (R): bad\n" in block["A"] and "  -> Affects 'B' [B] | Relation: a (2)\n" in block["A"]
    assert "Cross-Domain" not in block["B"]
    turns = spark.createDataFrame([(1, ["B", "A", "A", "?"]), (2, []), (3, None), (4, ["?"])], "t int, active array<string>")
    got = {r.t: r.context for r in graph.turn_context(turns, "t", "active", nodes, edges).collect()}
    assert got[1] == "\n" + "=" * 50 + block["A"] + "\n" + block["B"]
    assert got[2] == got[3] == "No specific resilience domains were activated."
    assert got[4] == "\n" + "=" * 50
    assert jsonl.read_graph(spark, str(tmp_path / "none.json"))[0].count() == 0
    with pytest.raises(ValueError):
        jsonl.read_graph(spark, str(tmp_path / "none.json"), strict=True)


def test_latest_keeps_ties(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', timestamp'2024-01-01', 1), (1, 'a', timestamp'2024-01-02', 2), (1, 'a', timestamp'2024-01-02', 3), (1, 'b', null, 4) AS t(user_id, node_id, created_at, id)")
    assert sorted(r.id for r in history.latest(df).collect()) == [2, 3]


def test_log_append_and_names(spark, tmp_path):
    df = spark.sql("SELECT 1L user_id, 'n' node_id, CAST(NULL AS STRING) category, 'red' status, CAST(NULL AS INT) score, CAST(NULL AS DOUBLE) confidence, 'r' reasoning, timestamp'2024-01-01 10:00:00' created_at, 10 severity, 5 frequency, CAST(NULL AS INT) functional, 3 coping")
    for _ in range(2):
        history.append_log(history.persisted(df), str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(rows) == 2 and (rows[0].status, rows[0].score, rows[0].category) == ("RED", 18, "Personal_Resilience")
    users = spark.createDataFrame([(" ann ",)], "username string")
    new = spark.createDataFrame([("ann",), ("bo",), (" bo",), ("",)], "username string")
    assert [r.username for r in history.registrable(new, users).collect()] == ["bo"]


def test_alignment_and_failures(spark):
    gold, predicted = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (2,), (3,)], "id int")
    assert sorted(map(tuple, ev.alignment(gold, predicted, "id").collect())) == [("duplicate", 2), ("missing", 1), ("unexpected", 3)]
    cases = spark.sql("SELECT 1 id, 1 fn, 0 fp, 0.5D recall, CAST(NULL AS DOUBLE) precision, 0 route_correct, 'a' expected, 'b' predicted, 10.0D mae, CAST(NULL AS DOUBLE) judge")
    assert {r.category for r in ev.failures(cases, "id").collect()} == {"safety_false_negative", "extraction_missed_signal", "routing_failure"}
    matrix = {r.expected: tuple(r)[1:] for r in ev.routing_matrix(cases, "expected", "predicted").collect()}
    assert matrix == {x: (0, 0, 0) for x in ev.ROUTES}


def test_evidence_quirks(spark):
    df = spark.createDataFrame([("a b", ""), ("", "a"), ("A  b", "x a b"), ("a", None)], "g string, p string")
    got = [(r.exact, r.substring, r.token_f1) for r in ev.evidence_scores(df, "g", "p").collect()]
    assert got[0][:2] == (0, 1) and got[1] == (None, None, None) and got[2][:2] == (0, 1) and got[3] == (0, 1, 0.0)


def test_evaluators_are_isolated(spark):
    got = ev.evaluate(spark.sql("SELECT true gold_risk, true predicted_risk"))
    assert isinstance(got["routing"], Exception) and got["safety"].first().tp == 1


def test_generator(spark):
    nodes = spark.createDataFrame([(f"{d}{i}", d) for d in "XYZ" for i in range(2)], "node_id string, domain string")
    a = [tuple(r) for r in generation.cases(spark, nodes, 100).collect()]
    assert a == [tuple(r) for r in generation.cases(spark, nodes.repartition(3), 100).collect()]
    df = spark.createDataFrame(a, generation.cases(spark, nodes, 100).schema)
    counts = {(r.difficulty, r.case_type): r["count"] for r in df.groupBy("difficulty", "case_type").count().collect()}
    assert counts == {("easy", "normal"): 20, ("moderate", "normal"): 20, ("hard", "ambiguous"): 15, ("moderate", "mixed_signal"): 15, ("hard", "multi_domain"): 10, ("hard", "high_risk"): 10, ("adversarial", "adversarial"): 10}
    for r in df.collect():
        assert len(r.signals) == (0 if r.high_risk else 2 if r.case_type in ("mixed_signal", "multi_domain") else 1)
        assert (r.route == "emergency_response") == r.high_risk
        assert r.turn_count in {"multi_domain": (2, 3), "ambiguous": (1, 2), "adversarial": (1, 2)}.get(r.case_type, (1,))


def test_stream_equals_batch_on_repeats(spark, tmp_path):
    """Turns delivered twice, in one file and in later ones, and late turns: the stream ends where the batch does."""
    rows = [(f"t{i % 5}", i // 5, "SAFE" if i % 3 else "HIGH_RISK", f"m{i}" if i % 7 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "thread_id string, turn_index int, safety_status string, user_message string")
    for k in (2, 0, 1, 1, 0):
        part = df.where(F.col("turn_index") % 3 == k)
        part.unionByName(part.limit(3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = conversations.thread_stream(src, timeout=None).writeStream.outputMode("update").format("memory").queryName("threads_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {}
    for r in spark.sql("SELECT * FROM threads_out").collect():
        if r.turns >= got.get(r.thread_id, r).turns:
            got[r.thread_id] = r
    batch = {r.thread_id: (r.turns, r.last_status, r.n_messages) for r in conversations.threads(df.unionByName(df.limit(9))).collect()}
    assert {k: (r.turns, r.last_status, len(r.history)) for k, r in got.items()} == batch
    assert max(len(r.history) for r in conversations.history(df, kept=4).collect()) == 4
    assert max(len(r.history) for r in conversations.history(df).collect()) == 7
    assert conversations.state_of(spark.table("threads_out"), "t1").select("thread_id").distinct().count() == 1


def test_old_threads_leave_the_state(spark, tmp_path):
    """With a timeout a thread's state goes, and what comes later begins anew."""
    schema = "thread_id string, turn_index int, safety_status string, user_message string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", 0, "SAFE", "x"), ("a", 1, "SAFE", "y")])
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = conversations.thread_stream(src, timeout="1 second").writeStream.outputMode("update").format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if q.lastProgress and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0 and spark.table("timed").count():
                break
        put([("a", 2, "SAFE", "z")])
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("timed").count() == 2:
                break
        assert sorted((r.turns, list(r.history)) for r in spark.table("timed").collect()) == [(1, ["z"]), (2, ["x", "y"])]
    finally:
        q.stop()


def test_turns_are_run_in_order(spark):
    def client():
        def call(state, message):
            if message == "break":
                raise RuntimeError("timeout")
            return {"said": [*state.get("said", []), message]}

        return call

    df = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("b", 0, "x"), ("b", 2, "z"), ("b", 1, "break"), ("c", 0, "break")], "case_id string, turn_index int, user_message string")
    got = {(r.case_id, r.turn_index): (r.output, r.error) for r in inference.run_cases(df, client).collect()}
    assert got == {("a", 0): ('{"said": ["x"]}', None), ("a", 1): ('{"said": ["x", "y"]}', None), ("b", 0): ('{"said": ["x"]}', None), ("b", 1): (None, "timeout"), ("c", 0): (None, "timeout")}


def test_prompts(spark):
    row = spark.sql("SELECT 'C' AS c, 'A' AS a, 'R' AS r, '' AS none").select(
        rendering.questioner_prompt("S", F.col("c")).alias("q"), rendering.advisor_prompt("S", F.col("c"), F.col("a")).alias("p"), rendering.judge_prompt("T", F.col("c"), F.lit("[]"), F.lit("[]"), F.col("none")).alias("j"), rendering.role(F.lit("human")).alias("h"), rendering.role(F.lit("ai")).alias("m"),
        rendering.run_id(F.lit("2024-05-06 07:08:09.000123").cast("timestamp")).alias("run"),
    ).first()
    assert tuple(row) == ("S\n\n=== GRAPH CONTEXT ===\nC", "S\n\nC\n\n=== ASSESSMENTS ===\nA", None, "user", "assistant", "20240506T070809000123Z")
    state = rendering.initial_state(spark.sql("SELECT 7L AS u, 'hi' AS m"), "u", "m").first()
    assert (state.user_id, state.active_nodes, state.messages[0].type, state.messages[0].content, state.safety_flag) == (7, [], "human", "hi", False)
    case = spark.sql("SELECT 'c1' AS case_id, 'D' AS domain, 'easy' AS difficulty, 'normal' AS case_type, 1 AS turn_count, 'SAFE' AS risk_category")
    signals = spark.createDataFrame([("c1", "B", 'say "x"'), ("c1", "A", None)], "case_id string, node_id string, polarity string")
    text = rendering.scenario_prompt(case, signals, spark.createDataFrame([("c1", "A", 70), ("c1", "B", 69)], "case_id string, node_id string, score int")).first().prompt
    want = {"domain": "D", "difficulty": "easy", "case_type": "normal", "turn_count": 1, "safety_category": "SAFE", "signals": [{"concept": "A", "polarity": None}, {"concept": "B", "polarity": 'say "x"'}], "assessment_levels": [{"concept": "A", "level": rendering.LEVELS[0]}, {"concept": "B", "level": rendering.LEVELS[1]}]}
    assert text == json.dumps(want, ensure_ascii=False, indent=2)


def test_attached_evidence(spark):
    signals = spark.createDataFrame([("c1", "A"), ("c1", "B")], "case_id string, node_id string")
    evidence = spark.createDataFrame([("c1", "A", "old", 0, 1), ("c1", "A", "new", 1, 2)], "case_id string, node_id string, evidence string, message_index int, position int")
    attached = rendering.attach_evidence(signals, evidence)
    assert sorted(map(tuple, attached.collect())) == [("c1", "A", "new", 1, False), ("c1", "B", None, None, True)]
    with pytest.raises(ValueError, match="c1: missing evidence for B"):
        rendering.check_attached(attached)
    assert rendering.check_attached(attached.where("NOT missing")).count() == 1


def test_rendered_rules(spark):
    cases = spark.createDataFrame([(c, 2, ["hello there", "bye"]) for c in "abcdef"] + [("g", 3, ["x"])], "case_id string, turn_count int, messages array<string>")
    signals = spark.createDataFrame([(c, "A") for c in "abcdef"], "case_id string, node_id string")
    evidence = [("a", 1, "A", "hello", 0), ("b", 1, "Z", "hello", 0), ("c", 1, "A", "x", 5), ("d", 1, "A", "bye", 1), ("d", 2, "A", "hello", 1), ("e", 1, "A", None, 0), ("g", 1, "Z", "q", 9)]
    got = validation.rendered_rules(cases, signals, spark.createDataFrame(evidence, "case_id string, position int, node_id string, evidence string, message_index int"))
    assert {r.case_id: (r.rule, r.detail) for r in got.collect()} == {"b": ("unknown", "Z"), "c": ("index", "A"), "d": ("text", "A"), "f": ("missing", "A"), "g": ("count", "1/3")}


def test_metrics_of_cases(spark):
    pairs = spark.createDataFrame([("c", "n", "a b b", "b b c"), ("c", "m", "", "x"), ("d", "n", "same", "Same"), ("e", "n", None, None)], "c string, n string, g string, p string")
    got = {r.c: (round(r.exact_match, 4), round(r.substring_match, 4), round(r.token_f1, 4), r.matched_nodes) for r in ev.evidence_cases(pairs, "c", "n", "g", "p").collect()}
    assert got == {"c": (0.0, 0.0, 0.6667, 2), "d": (1.0, 1.0, 1.0, 1), "e": (0.0, 0.0, 0.0, 1)}
    one = ev.class_summary(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "a")], "g string, p string"), "g", "p").first()
    assert (one.total, round(one.accuracy, 4), round(one.macro_precision, 4), round(one.macro_recall, 4)) == (3, 0.6667, 0.75, 0.75)
    assert ev.class_summary(pairs.limit(0), "g", "p").first().accuracy == 0.0
    rubric = spark.createDataFrame([("c", 10, 10, 10, 10, 13, 6, None, 10, "RED", "RED"), ("c", 1, 1, 1, 1, None, None, None, None, "RED", None)], "c string, " + ", ".join(f"{s}_{d} int" for s in ("gold", "predicted") for d in ("severity", "frequency", "functional", "coping")) + ", gold_status string, predicted_status string")
    r = ev.rubric_cases(rubric, "c").first()
    assert (r.severity_mae, r.functional_mae, round(r.mae, 4), round(r.rmse, 4), r.matched_nodes, r.status_total, r.status_accuracy) == (3.0, 0.0, 2.3333, 2.8868, 2, 1, 1.0)
    routes = ev.routing_cases(spark.createDataFrame([("x", "advisor", "advisor"), ("y", "advisor", "else"), ("z", "questioner", None)], "k string, e string, p string"), "k", "e", "p")
    assert sorted((r.k, r.predicted, r.correct) for r in routes.collect()) == [("x", "advisor", 1), ("y", "unknown", 0), ("z", "unknown", 0)]
    assert routes.agg(ev.routing_accuracy(routes).alias("a")).first().a == 1.0


def test_markdown(spark, tmp_path):
    one = spark.sql("SELECT 3L AS dataset_size, 0.5D AS safety_accuracy, 1.25D AS mean_mae, 0.0D AS routing_accuracy, 7.126D AS average_score")
    reporting.write_markdown(one, str(tmp_path / "new" / "r.md"))
    text = (tmp_path / "new" / "r.md").read_text(encoding="utf-8")
    assert "Size: 3\n" in text and "Accuracy: 0.500\n" in text and text.endswith("Average Score: 7.13/10\n")


def test_schema_rules_and_names(spark):
    df = spark.createDataFrame([(1, "GREEN", 50), (2, "blue", 101), (3, None, None)], "id int, status string, score int")
    got = validation.schema_rules(df, "id", {"status": ["GREEN"]}, {"score": (0, 100)})
    assert sorted(map(tuple, got.collect())) == [(2, "enum", "status=blue"), (2, "range", "score=101")]
    users = spark.createDataFrame([(1, " Ann "), (2, "Bo")], "id int, username string")
    assert [r.id for r in history.user_by_name(users, "Ann ").collect()] == [1]


def test_hook(spark):
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("503 temporarily unavailable")
        return batch

    import pandas as pd

    assert len(inference.with_retry(flaky, 3, 0.0)(pd.DataFrame({"a": [1]}))) == 1
    with pytest.raises(KeyError):
        inference.with_retry(lambda b: b["no"], 3, 0.0)(pd.DataFrame({"a": [1]}))
    out = inference.infer(spark.range(10), lambda: lambda b: b.assign(id=b.id + 1), "id long", parallel=2)
    assert sorted(r.id for r in out.collect()) == list(range(1, 11))
