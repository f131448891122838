import datetime as dt
import random

from pyspark.sql import functions as F

from quern.operators import versions

SCHEMA = "id long, user long, node string, state string, score int, made timestamp_ntz, at string, bucket string"
KEYS = ["user", "node"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def log(df, **options):
    return versions.change_log(df, {k: F.col(k) for k in KEYS}, F.col("made"), F.col("id"), {"state": {"state": F.col("state")}, "score": {"score": F.col("score")}}, **options)


def brute(rows):
    last = {}
    for i, u, n, s, x, at in rows:
        if at is not None and ((u, n, at) not in last or i > last[u, n, at][0]):
            last[u, n, at] = (i, s, x)
    out, by = [], {}
    for (u, n, at), (_, s, x) in sorted(last.items(), key=lambda z: (str(z[0][0]), str(z[0][1]), z[0][2])):
        if not by.get((u, n)) or by[u, n][-1][1:] != (s, x):
            by.setdefault((u, n), []).append((at, s, x))
    for k, vs in by.items():
        out += [(*k, *v, vs[i + 1][0] if i + 1 < len(vs) else None) for i, v in enumerate(vs)]
    return sorted(out, key=str)


def make(seed, n=400):
    r = random.Random(seed)
    start = dt.datetime(2024, 3, 1)
    rows = [(i, r.choice([1, 1, 1, 2, None]), r.choice(["a", "a", "b", None]), r.choice(["G", "R", None]), r.choice([1, 2, None]), start + dt.timedelta(minutes=7 * r.randint(0, 900)) if r.random() > 0.03 else None) for i in range(n)]
    return rows + rows[:15]


def test_versions_equal_brute_force(spark):
    rows = make(1)
    for hot in (versions.HOT_ROWS, 50, 1):
        got = versions.versions(log(frame(spark, rows), hot_rows=hot), KEYS)
        assert sorted([(x.user, x.node, x.valid_from, x.state, x.score, x.valid_to) for x in got.collect()], key=str) == brute(rows)


def test_satellites_hold_changes_only(spark):
    rows = make(2)
    sat = versions.satellite(log(frame(spark, rows)), KEYS, "state", ["state"]).collect()
    by = {}
    for x in sorted(sat, key=lambda x: x["at"]):
        by.setdefault((x.user, x.node), []).append(x.state)
    assert all(a != b for xs in by.values() for a, b in zip(xs, xs[1:], strict=False))


def test_append_equals_rebuild(spark):
    rows = [r for r in make(3) if r[5] is not None]
    cut = sorted(r[5] for r in rows)[len(rows) // 2]
    early, late = [r for r in rows if r[5] <= cut], [r for r in rows if r[5] > cut]
    state = lambda rs: versions.satellite(log(frame(spark, rs)), KEYS, "state", ["state"])
    plain = frame(spark, late).groupBy("user", "node", F.col("made").alias("m")).agg(F.max_by("state", "id").alias("state")).select("user", "node", F.col("m").alias("at"), "state")
    stored = state(early)
    added = versions.append(stored, plain, KEYS, ["state"])
    both = sorted([tuple(x) for x in stored.unionByName(added).collect()], key=str)
    assert both == sorted([tuple(x) for x in state(rows).collect()], key=str)


def test_empty(spark):
    assert versions.versions(log(frame(spark, [])), KEYS).count() == 0


def test_one_exchange(spark):
    """Without hot keys all rows are exchanged once."""
    df = versions.versions(log(frame(spark, make(4)).repartition(3)), KEYS)
    df.collect()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 2 and "Join" not in plan


def test_late_keys(spark):
    rows = [(1, 7, "a", "G", 1, dt.datetime(2024, 3, 1)), (2, 7, "a", "R", 1, dt.datetime(2024, 3, 5)), (3, None, "b", "R", 1, dt.datetime(2024, 3, 5))]
    stored = versions.satellite(log(frame(spark, rows)), KEYS, "state", ["state"])
    updates = frame(spark, [(4, 7, "a", "G", 1, dt.datetime(2024, 3, 2)), (5, None, "b", "G", 1, dt.datetime(2024, 3, 6)), (6, 9, "c", "G", 1, dt.datetime(2024, 3, 1))]).select("user", "node", F.col("made").alias("at"), "state")
    assert [tuple(x) for x in versions.late_keys(stored, updates, KEYS).collect()] == [(7, "a")]
