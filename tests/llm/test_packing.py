import random
from collections import Counter

from quern.llm import packing

SPECS = "container_id int, capacity long, slot string"


def brute(sizes, capacity):
    """Best-fit decreasing over single items."""
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits)[1]] -= s
        else:
            free.append(capacity - s)
    return len(free)


def test_plan_equals_best_fit_over_items():
    r = random.Random(3)
    for _ in range(60):
        c = r.randint(1, 40)
        sizes = [r.randint(1, c) for _ in range(r.randint(0, 80))]
        entries = packing.plan(Counter(sizes), c)
        load, count = Counter(), Counter(sizes)
        for size in count:
            own = sorted(e for e in entries if e[0] == size)
            for k in range(count[size]):
                e = [e for e in own if e[1] <= k][-1]
                load[e[2] + (k - e[1]) // e[3]] += size
        assert all(0 < x <= c for x in load.values())
        assert sum(load.values()) == sum(sizes)
        assert len(load) == (max(load) + 1 if load else 0) == brute(sizes, c)


def test_pack(spark):
    r = random.Random(4)
    texts = [(i if i else None, "é" * r.choice([0, 1, 7, 7, 7, 30, 200]), 0, "x") for i in range(400)] + [(5, None, 0, "x"), (7, "abc", 0, "x"), (7, "abc", 0, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, tokens int, slot string").repartition(3)
    specs = spark.createDataFrame([(1, 50, "a"), (2, 7, "b"), (2, 7, "c"), (3, 0, "d"), (4, None, "e")], SPECS)
    out = packing.pack(docs, "doc_id", "text", specs, rank_rows=9).collect()
    size = lambda t: len((t or "").encode())
    for cid, cap in ((1, 50), (2, 7)):
        own = [x for x in out if x.container_id == cid]
        assert sum(x.tokens for x in own) == sum(size(t[1]) for t in texts)
        assert len(own) == sum(max(1, -(-size(t[1]) // cap)) for t in texts)
        load = Counter()
        for x in own:
            load[x.slot] += x.tokens
        assert max(load.values()) <= cap and set(load) == set(range(max(load) + 1))
        assert all(x.n_pieces == 1 for x in own if x.n_pieces * cap <= cap)
    assert {x.container_id for x in out} == {1, 2}
    assert packing.usage(packing.pack(docs, "doc_id", "text", specs)).where("containers < at_least").count() == 0
    assert packing.pack(docs.limit(0), "doc_id", "text", specs).count() == 0
