"""Metrics of predictions against gold data, per case and over a dataset."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.scoring import DIMENSIONS, f1, ratio

ROUTES = ("emergency_response", "questioner", "advisor")


def confusion(cases: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """tp, tn, fp, fn as 0 or 1 beside each case."""
    g, p = gold.cast("int"), predicted.cast("int")
    return cases.withColumns({"tp": g * p, "tn": (1 - g) * (1 - p), "fp": (1 - g) * p, "fn": g * (1 - p)})


def safety_rates(cases: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of single cases from their 0 or 1 counts."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return cases.withColumns({"accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "precision": p, "recall": r, "f1": f1(p, r)})


def micro(cases: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of the summed counts."""
    s = cases.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "tn", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("tp", "tn", "fp", "fn", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def by_class(cases: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row per label of either column (G5): support, precision, recall, F1; counted in one pass, not one per label."""
    sides = F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), (F.col(gold) == F.col(predicted)).cast("int").alias("hit")))
    n = cases.select(F.inline(sides)).where("label IS NOT NULL").groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return n.select("label", "support", "predicted", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def class_summary(cases: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: ``total, accuracy`` and the macro means of precision, recall and F1 (G5); 0.0 for an empty input.

    Accuracy is the share of all pairs, so that it follows from the per-class counts in one pass.
    """
    n = by_class(cases.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()), gold, predicted)
    hits = F.sum(F.round(F.col("recall") * F.col("support")))
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    return n.agg(F.coalesce(F.sum("support"), F.lit(0)).alias("total"), ratio(F.coalesce(hits, F.lit(0)), F.sum("support")).alias("accuracy"), *means)


def routing_cases(cases: DataFrame, key: str, expected: str, predicted: str, labels: Sequence[str] = ROUTES) -> DataFrame:
    """``key, expected, predicted, correct``: a predicted label outside ``labels``, or none, is ``unknown``."""
    shown = F.when(F.col(predicted).isin(*labels), F.col(predicted)).otherwise("unknown")
    return cases.select(key, F.col(expected).alias("expected"), shown.alias("predicted"), F.col(expected).eqNullSafe(shown).cast("int").alias("correct"))


def routing_accuracy(cases: DataFrame, labels: Sequence[str] = ROUTES) -> Column:
    """Aggregate: share of correct routes among cases with known labels on both sides (G15); 0.0 for none."""
    known = F.col("expected").isin(*labels) & F.col("predicted").isin(*labels)
    return ratio(F.count_if(known & (F.col("expected") == F.col("predicted"))), F.count_if(known))


def routing_matrix(cases: DataFrame, expected: str, predicted: str, labels: Sequence[str] = ROUTES) -> DataFrame:
    """Counts of expected by predicted route, all labels present (G15); other labels are left out."""
    known = cases.where(F.col(expected).isin(*labels) & F.col(predicted).isin(*labels))
    counts = known.groupBy(F.col(expected).alias("expected")).pivot(predicted, list(labels)).count()
    every = cases.sparkSession.createDataFrame([(x,) for x in labels], "expected string")
    return every.join(counts, "expected", "left").na.fill(0)


def set_metrics(gold: Column, predicted: Column) -> dict[str, Column]:
    """Sizes, precision, recall, F1 and Jaccard of two arrays as sets."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    both, either = F.size(F.array_intersect(g, p)), F.size(F.array_union(g, p))
    precision, recall = ratio(both, F.size(p)), ratio(both, F.size(g))
    return {"gold_count": F.size(g), "prediction_count": F.size(p), "matched": both, "precision": precision, "recall": recall, "f1": f1(precision, recall), "jaccard": ratio(both, either)}


def last_wins(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One row per key with the values of its last row."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_v")).select(*keys, "_v.*")


def polarity_accuracy(pairs: DataFrame, key: str, gold: str, predicted: str) -> DataFrame:
    """Share of matched nodes with equal polarity per case."""
    return pairs.groupBy(key).agg(F.count("*").alias("matched"), F.coalesce(F.avg(F.col(gold).eqNullSafe(F.col(predicted)).cast("double")), F.lit(0.0)).alias("accuracy"))


def with_all(cases: DataFrame, key: str, metrics: DataFrame, default: Mapping[str, float | int]) -> DataFrame:
    """Every case with its metrics; a case without any gets the defaults (left join, J3)."""
    return cases.select(key).join(metrics, key, "left").na.fill(dict(default))


def token_overlap(pairs: DataFrame, keys: Sequence[str], gold: str, predicted: str) -> DataFrame:
    """``keys, token_f1`` of texts of any length (G11): words are counted once, never compared with one another.

    ``keys`` must name a row; null where the gold text is empty, 0.0 where the prediction is or nothing is shared.
    """
    side = lambda c, g, p: F.transform(tx.words(tx.evidence(c)), lambda w: F.struct(w.alias("w"), F.lit(g).alias("g"), F.lit(p).alias("p")))
    both = pairs.repartition(*keys).select(*keys, F.explode(F.concat(side(gold, 1, 0), side(predicted, 0, 1))).alias("x")).select(*keys, "x.*")
    counts = both.groupBy(*keys, "w").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    per = counts.groupBy(*keys).agg(F.sum(F.least("g", "p")).alias("k"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    return per.where("g > 0").select(*keys, F.coalesce(F.try_divide(2.0 * F.col("k"), F.col("g") + F.col("p")), F.lit(0.0)).alias("token_f1"))


def evidence_cases(pairs: DataFrame, key: str, node: str, gold: str, predicted: str) -> DataFrame:
    """``key, exact_match, substring_match, token_f1, matched_nodes`` of matched nodes.

    Nodes with empty gold text count as matched but not in the denominators; a case with only such nodes has 0.0.
    """
    scored = evidence_scores(pairs, gold, predicted, overlap=False).drop("token_f1").join(token_overlap(pairs, [key, node], gold, predicted), [key, node], "left")
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return scored.groupBy(key).agg(share("exact").alias("exact_match"), share("substring").alias("substring_match"), share("token_f1").alias("token_f1"), F.count("*").alias("matched_nodes"))


def rubric_cases(pairs: DataFrame, key: str, gold: str = "gold_", predicted: str = "predicted_", gold_status: str = "gold_status", status: str = "predicted_status") -> DataFrame:
    """One row per case: MAE and RMSE of each dimension and over all, matched nodes, statuses (G12); 0.0 where nothing is compared.

    A dimension without a prediction does not count; a status counts where one was predicted.
    """
    out = []
    every, squares, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for d in DIMENSIONS:
        e = (F.col(f"{predicted}{d}") - F.col(f"{gold}{d}")).cast("double")
        out += [F.coalesce(F.avg(F.abs(e)), F.lit(0.0)).alias(f"{d}_mae"), F.coalesce(F.sqrt(F.avg(e * e)), F.lit(0.0)).alias(f"{d}_rmse")]
        every, squares, n = every + F.coalesce(F.sum(F.abs(e)), F.lit(0.0)), squares + F.coalesce(F.sum(e * e), F.lit(0.0)), n + F.count(e)
    right = F.count_if(F.col(status) == F.col(gold_status))
    return pairs.groupBy(key).agg(*out, ratio(every, n).alias("mae"), F.sqrt(ratio(squares, n)).alias("rmse"), F.count("*").alias("matched_nodes"), right.alias("status_correct"), F.count(status).alias("status_total"), ratio(right, F.count(status)).alias("status_accuracy"))


def assessment_means(cases: DataFrame) -> list[Column]:
    """Aggregates: means of the per-case overall errors and the sum of matched nodes."""
    zero = F.lit(0.0)
    return [F.coalesce(F.avg("mae"), zero).alias("mean_mae"), F.coalesce(F.avg("rmse"), zero).alias("mean_rmse"), F.coalesce(F.sum("matched_nodes"), F.lit(0)).alias("matched_nodes")]


def evidence_scores(pairs: DataFrame, gold: str, predicted: str, overlap: bool = True) -> DataFrame:
    """Exact, substring and (with ``overlap``, for short texts) token-F1 agreement of two texts (G10, G11); null where the gold text is empty.

    An empty prediction counts as a substring of its gold text.
    """
    g, p = tx.evidence(gold), tx.evidence(predicted)
    some = g != ""
    return pairs.withColumns({"exact": F.when(some, (g == p).cast("int")), "substring": F.when(some, (F.contains(p, g) | F.contains(g, p)).cast("int")), "token_f1": F.when(some, tx.token_f1(g, p)) if overlap else F.lit(None).cast("double")})


def rubric_errors(pairs: DataFrame, gold: str = "gold_", predicted: str = "predicted_") -> DataFrame:
    """MAE and RMSE per dimension and over all (G12): rows ``dimension, n, mae, rmse``; empty input gives no rows."""
    errors = F.array(*[F.struct(F.lit(d).alias("dimension"), (F.col(f"{predicted}{d}") - F.col(f"{gold}{d}")).cast("double").alias("e")) for d in DIMENSIONS])
    rows = pairs.select(F.inline(errors)).where("e IS NOT NULL")
    both = rows.select(F.explode(F.array("dimension", F.lit("overall"))).alias("dimension"), "e")
    return both.groupBy("dimension").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


def alignment(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """``problem, key``: missing, unexpected and duplicate ids of the predictions."""
    g, p = gold.select(key).distinct(), predicted.select(key)
    parts = (
        ("missing", g.join(p, key, "left_anti")),
        ("unexpected", p.distinct().join(g, key, "left_anti")),
        ("duplicate", p.groupBy(key).count().where("count > 1").select(key)),
    )
    out = None
    for name, rows in parts:
        rows = rows.select(F.lit(name).alias("problem"), key)
        out = rows if out is None else out.unionByName(rows)
    return out


#: Failure categories (F1-F7): name and condition over the per-case metrics.
FAILURES: Mapping[str, Callable[[], Column]] = {
    "safety_false_negative": lambda: F.col("fn") > 0,
    "safety_false_positive": lambda: F.col("fp") > 0,
    "extraction_missed_signal": lambda: F.coalesce("recall", F.lit(1.0)) < 1,
    "extraction_false_positive": lambda: F.coalesce("precision", F.lit(1.0)) < 1,
    "routing_failure": lambda: F.col("route_correct") == 0,
    "assessment_failure": lambda: F.col("mae") > 10,
    "advisor_failure": lambda: F.coalesce("judge", F.lit(10.0)) < 5,
}


def failures(cases: DataFrame, key: str) -> DataFrame:
    """``key, category, details``: every failure of every case, details as JSON."""
    details = {
        "safety_false_negative": ["fn"], "safety_false_positive": ["fp"], "extraction_missed_signal": ["recall"], "extraction_false_positive": ["precision"],
        "routing_failure": ["expected", "predicted"], "assessment_failure": ["mae"], "advisor_failure": ["judge"],
    }
    rows = [F.when(condition(), F.struct(F.lit(name).alias("category"), F.to_json(F.struct(*details[name])).alias("details"))) for name, condition in FAILURES.items()]
    return cases.select(key, F.explode(F.array_compact(F.array(*rows))).alias("f")).select(key, "f.*")


def frequencies(cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``dimension, value, n`` for several columns in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return cases.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


#: Evaluators by name: functions from a frame of cases to a frame of metrics.
EVALUATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def evaluator(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register an evaluator under a name."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        EVALUATORS[name] = f
        return f

    return add


def evaluate(cases: DataFrame, run: bool = False) -> dict[str, DataFrame | Exception]:
    """Every registered evaluator's result; one that fails does not stop the others.

    Errors of planning are caught here; with ``run`` each result is computed once too, so that errors in
    the data are caught as well.
    """
    out: dict[str, DataFrame | Exception] = {}
    for name, f in EVALUATORS.items():
        try:
            out[name] = f(cases)
            if run:
                out[name].write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            out[name] = e
    return out


def grouped(results: Mapping[str, DataFrame], key: str) -> DataFrame:
    """``evaluator, key, metric, value``: numeric metrics of all evaluators in one long frame, grouped by evaluator."""
    out = None
    for name, df in results.items():
        numbers = [f.name for f in df.schema.fields if f.name != key and f.dataType.simpleString() in ("int", "bigint", "double")]
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])
        part = df.select(F.lit(name).alias("evaluator"), key, F.inline(pairs))
        out = part if out is None else out.unionByName(part)
    return out


@evaluator("safety")
def _safety(cases: DataFrame) -> DataFrame:
    return micro(confusion(cases, F.col("gold_risk"), F.col("predicted_risk")))


@evaluator("routing")
def _routing(cases: DataFrame) -> DataFrame:
    return routing_matrix(cases, "expected", "predicted")
