"""Texts around model calls: scenario and judge prompts, evidence attached to signals, messages, run names, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences and headings that must come out as they are.
NO_SIGNALS = "No explicit extracted signals provided."
NO_RESPONSE = "پاسخی از سمت سیستم دریافت نشد."
JUDGE_END = "Return ONLY the JSON object defined by the output schema."
LEVELS = ("relatively strong resilience", "moderate or mixed resilience", "low resilience or significant difficulty")


def role(kind: Column) -> Column:
    """Who speaks in a message of a type (P20)."""
    return F.when(kind == "human", "user").otherwise("assistant")


def message(kind: Column, content: Column) -> Column:
    """A message with its four fields (P22); the open ones are empty JSON objects."""
    return F.struct(kind.alias("type"), content.alias("content"), F.lit("{}").alias("additional_kwargs"), F.lit("{}").alias("response_metadata"))


def initial_state(rows: DataFrame, user: str, text: str) -> DataFrame:
    """``user_id, user_message`` and the state that every run begins with."""
    none = F.expr("array()").cast("array<string>")
    return rows.select(
        F.col(user).alias("user_id"), F.col(text).alias("user_message"), F.lit(None).cast("string").alias("safety_status"), F.lit(False).alias("safety_flag"), none.alias("active_nodes"), none.alias("active_signals"), F.lit("").alias("subgraph_context"),
        none.alias("assessments"), F.lit(False).alias("requires_disambiguation"), F.lit("").alias("final_response"), F.array(message(F.lit("human"), F.col(text))).alias("messages"),
    )


def served(response: Column) -> Column:
    """A response as it is shown: a sentence in place of a missing one."""
    return F.coalesce(response, F.lit(NO_RESPONSE))


def level(score: Column) -> Column:
    """A score in words."""
    return F.when(score >= 70, LEVELS[0]).when(score >= 40, LEVELS[1]).when(score.isNotNull(), LEVELS[2])


def _json(value: Column) -> Column:
    """A text as a JSON string."""
    inner = F.to_json(F.array(value))
    return F.coalesce(F.when(value.isNotNull(), F.substr(inner, F.lit(2), F.length(inner) - 2)), F.lit("null"))


def _listed(items: Column, *fields: str) -> Column:
    """An array of structs as a JSON list at depth one, two blanks for each depth."""
    one = lambda x: F.concat(F.lit("    {\n"), F.concat_ws(",\n", *[F.concat(F.lit(f'      "{f}": '), _json(x[f])) for f in fields]), F.lit("\n    }"))
    return F.when(F.size(items) > 0, F.concat(F.lit("[\n"), F.array_join(F.transform(items, one), ",\n"), F.lit("\n  ]"))).otherwise("[]")


def scenario_prompt(cases: DataFrame, signals: DataFrame, assessed: DataFrame) -> DataFrame:
    """``case_id, prompt``: a scenario as indented JSON.

    ``cases``: case_id, domain, difficulty, case_type, turn_count, risk_category; ``signals``: case_id,
    node_id, polarity; ``assessed``: case_id, node_id, score. Both lists stand in order of node ids.
    """
    sig = signals.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("concept"), "polarity"))).alias("s"))
    lev = assessed.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("concept"), level(F.col("score")).alias("level")))).alias("a"))
    both = cases.join(sig, "case_id", "left").join(lev, "case_id", "left")
    empty = lambda c, t: F.coalesce(c, F.expr("array()").cast(t))
    texts = [F.concat(F.lit(f'  "{k}": '), _json(F.col(c)) if c != "turn_count" else F.col(c).cast("string")) for k, c in (("domain", "domain"), ("difficulty", "difficulty"), ("case_type", "case_type"), ("turn_count", "turn_count"), ("safety_category", "risk_category"))]
    texts += [F.concat(F.lit('  "signals": '), _listed(empty("s", sig.schema["s"].dataType), "concept", "polarity")), F.concat(F.lit('  "assessment_levels": '), _listed(empty("a", lev.schema["a"].dataType), "concept", "level"))]
    return both.select("case_id", F.concat(F.lit("{\n"), F.concat_ws(",\n", *texts), F.lit("\n}")).alias("prompt"))


def attach_evidence(signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Signals with ``evidence, message_index, missing`` of their node (P29); of several pieces the last by ``position`` counts.

    ``missing`` marks signals without evidence, which check_attached() turns into an error.
    """
    last = evidence.groupBy("case_id", "node_id").agg(F.max_by(F.struct("evidence", "message_index"), "position").alias("e"))
    joined = signals.join(last, ["case_id", "node_id"], "left")
    return joined.select(*signals.columns, "e.evidence", "e.message_index", F.col("e").isNull().alias("missing"))


def check_attached(attached: DataFrame) -> DataFrame:
    """``attached`` without its mark, or an error that names a signal without evidence."""
    bad = attached.where("missing").select("case_id", "node_id").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['case_id']}: missing evidence for {bad[0]['node_id']}")
    return attached.drop("missing")


def evidence_blocks(signals: DataFrame, key: str, order: str) -> DataFrame:
    """``key, block``: the signals of each turn in order, one block of lines each."""
    text = F.concat(
        F.lit("• Target Node: "), F.coalesce("node_id", F.lit("None")), F.lit("\n  - Extracted Polarity: "), F.upper(F.coalesce("detected_signal", F.lit("mixed"))), F.lit('\n  - Exact User Substring (Evidence): "'), F.coalesce("evidence", F.lit("")), F.lit('"'),
    )
    return signals.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct(order, text.alias("text"))))["text"], "\n").alias("block"))


def assessor_input(turns: DataFrame, blocks: DataFrame, key: str, text: str) -> DataFrame:
    """``key, prompt``: what an assessor is given of each turn; a sentence where it has no signals."""
    block = F.coalesce("block", F.lit(NO_SIGNALS))
    prompt = F.concat(F.lit("=== EXTRACTED SIGNALS & EVIDENCE ===\n"), block, F.lit("\n\n=== FULL USER MESSAGE ===\n"), F.coalesce(text, F.lit("")))
    return turns.join(blocks, key, "left").select(key, prompt.alias("prompt"))


def judge_prompt(template: str, context: Column, signals: Column, assessment: Column, response: Column) -> Column:
    """The judge's prompt (P30); null without a response. Lists come as JSON text."""
    parts = [F.lit(template), F.concat(F.lit("=== USER CONTEXT ===\n"), context), F.concat(F.lit("=== EXTRACTED SIGNALS ===\n"), signals), F.concat(F.lit("=== ASSESSMENT ===\n"), assessment), F.concat(F.lit("=== ADVISOR RESPONSE ===\n"), response), F.lit(JUDGE_END)]
    return F.when(response != "", F.concat_ws("\n\n", *parts))


def questioner_prompt(system: str, context: Column) -> Column:
    """The system message of the question asker (H9)."""
    return F.concat(F.lit(f"{system}\n\n=== GRAPH CONTEXT ===\n"), context)


def advisor_prompt(system: str, context: Column, assessments: Column) -> Column:
    """The system message of the advisor (H9)."""
    return F.concat(F.lit(f"{system}\n\n"), context, F.lit("\n\n=== ASSESSMENTS ===\n"), assessments)


def run_id(at: Column) -> Column:
    """A moment as the name of a run."""
    return F.date_format(at, "yyyyMMdd'T'HHmmssSSSSSS'Z'")


def thread_name(run: Column, version: Column, case: Column) -> Column:
    """The name of a case's thread in a run."""
    return F.concat(F.lit("evaluation: "), run, F.lit(" : "), version, F.lit(" : "), case)


def first_rows(rows: DataFrame, position: str, n: int | None) -> DataFrame:
    """The first ``n`` rows in order of ``position``; all of them without a limit."""
    return rows if n is None else rows.orderBy(position).limit(n)
