import random

from quern.llm import mixing


def brute(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats if sum(weights) else 0):
        i = max((i for i in range(len(weights)) if weights[i]), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_sainte_lague():
    r = random.Random(1)
    for _ in range(400):
        w = [r.randint(0, 50) for _ in range(r.randint(1, 9))]
        n = r.randint(0, 90)
        assert mixing.sainte_lague(w, n) == brute(w, n)
    big = mixing.sainte_lague([1, 2, 3], 6 * 10**12)
    assert big == [10**12, 2 * 10**12, 3 * 10**12]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, shard int, uses string")


TARGETS = "mix_id int, source string, weight int, max_repeats int, size string"


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, "x" * r.randint(1, 400), r.choice(["big"] * 8 + [" Big", "mid", "mid", "tiny"])) for i in range(3000)] + [(9001, None, "big"), (9002, "", "mid"), (9003, "zz", None), (None, "yy", "big"), (7, "dup", "mid")]
    d = docs(spark, rows).repartition(5)
    t = spark.createDataFrame([(1, "BIG", 1, None, "c"), (1, "mid ", 1, 9, "c"), (1, "tiny", 1, 2, "c"), (1, "none", 1, None, "c"), (1, "mid", 0, 1, "c"), (2, "big", None, 1, "c"), (3, None, 1, 1, "c")], TARGETS)
    shares = {(x.mix_id, x.source): x for x in mixing.shares(d, t).collect()}
    total = sum(len(x[1] or "") for x in rows if x[2])
    assert set(shares) == {(1, "big"), (1, "mid"), (1, "tiny"), (1, "none"), (2, "big")}
    assert {k for k, v in shares.items() if not v.reached} == {(1, "tiny"), (1, "none")}
    assert all(shares[1, s].target == total // 4 for s in ("big", "mid", "tiny"))
    drawn = mixing.mix(d, t).collect()
    got = {}
    for x in drawn:
        assert x.uses <= {"big": 10**9, "mid": 9, "tiny": 2}[x.source] and x.size > 0
        got[x.source] = got.get(x.source, 0) + x.size * x.uses
    for s in ("big", "mid"):
        assert abs(got[s] - total // 4) < 0.02 * total
    assert got["tiny"] == 2 * shares[1, "tiny"].available
    again = mixing.mix(d.repartition(2), t).collect()
    assert sorted(map(str, again)) == sorted(map(str, drawn))
    report = {(x.mix_id, x.source): x for x in mixing.actual(mixing.mix(d, t), mixing.shares(d, t)).collect()}
    assert abs(sum(report[1, s].actual for s in ("big", "mid", "tiny", "none")) - 1) < 1e-9


def test_empty(spark):
    t = spark.createDataFrame([(1, "a", 1, None, "c")], TARGETS)
    none = docs(spark, [(1, "x", "a")]).limit(0)
    assert [x.reached for x in mixing.shares(none, t).collect()] == [False]
    assert mixing.mix(none, t).count() == 0 and mixing.mix(docs(spark, [(1, "x", "a")]), t.limit(0)).count() == 0
