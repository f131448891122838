import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import scoring as sc
from quern.functions import text as tx

# smallest raw confidence (in thousandths) that reaches 0.70, by evidence words and consistency 0.0, 0.5, 0.8, 1.0
REACHES = {0: (None, None, None, 984), 1: (None, None, 1000, 734), 2: (None, None, 750, 484), 3: (None, 900, 500, 234), 4: (None, 650, 250, 0)}
PAIRS = (("RED", "positive"), ("RED", "mixed"), ("YELLOW", "mixed"), ("GREEN", "Positive"))


def test_confidence_thresholds(spark):
    grid = spark.range(1001).crossJoin(spark.range(6).withColumnRenamed("id", "w")).crossJoin(spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "k int, s string, p string"))
    c = sc.confidence(F.col("id") / 1000, F.col("w").cast("int"), F.col("s"), F.col("p"))
    got = {(r.w, r.k): r.m for r in grid.where(c >= 0.70).groupBy("w", "k").agg(F.min("id").alias("m")).collect()}
    for w in range(6):
        for k in range(4):
            assert got.get((w, k)) == REACHES[min(w, 4)][k]


def test_status_and_total(spark):
    row = spark.sql("SELECT 70 a, 69 b, 40 c, 39 d, CAST(NULL AS INT) n").select(*[sc.status(F.col(x)).alias(x) for x in "abcdn"], sc.total(F.col("a"), F.col("n")).alias("t")).first()
    assert tuple(row) == ("GREEN", "YELLOW", "YELLOW", "RED", None, 70)


def test_routes(spark):
    df = spark.createDataFrame([("SAFE", False, [0.7, 0.9]), ("SAFE", False, [0.69]), ("SAFE", False, []), ("SAFE", None, [None]), ("UNAVAILABLE", False, [0.9]), ("HIGH_RISK", True, None), (None, False, [0.9])], "s string, f boolean, c array<double>")
    got = df.select(sc.route_after_safety(F.col("s")), sc.route_after_assessment(F.col("f"), F.col("c")), sc.derived_route(F.col("s"), F.col("f"), F.col("c"))).collect()
    a, q, e = "advisor", "questioner", "emergency_response"
    assert [tuple(r) for r in got] == [("extractor", a, a), ("extractor", q, q), ("extractor", q, q), ("extractor", a, q), ("service_unavailable", a, q), (e, q, e), ("extractor", a, a)]


@pytest.mark.parametrize(("text", "want"), [("  Ｘ", "ｘ"), ("علي‌رضا!كتاب", "علی رضا کتاب"), ("آبِ ۱۲", "اب 12"), (None, ""), ("", ""), ("a[b]\\c", "a b c"), ("x  y", "x y"), ("٣", "٣"), ("،", "،")])
def test_normalized(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.normalized("t")).first()[0] == want


def test_crisis(spark):
    df = spark.createDataFrame([("من میخوام بمیرم",), ("می‌خواهم بمیرم",), ("ok",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.crisis("t")).collect()] == [True, True, False, False]


def f1(g, p):
    from collections import Counter

    g, p = g.split(), p.split()
    shared = sum((Counter(g) & Counter(p)).values())
    return 2 * shared / (len(g) + len(p)) if g or p else 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("ab ", max_size=12), st.text("ab ", max_size=12)), min_size=1, max_size=30))
def test_token_f1(spark, pairs):
    df = spark.createDataFrame(pairs, "g string, p string")
    got = df.select(tx.token_f1(tx.squeezed("g"), tx.squeezed("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([f1(*x) for x in pairs])


def test_cut_uses_the_session_folder(spark, tmp_path):
    from quern.session import cut

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert sorted(r.id for r in cut(spark.range(3)).collect()) == [0, 1, 2]
    assert any(tmp_path.rglob("part-*"))
