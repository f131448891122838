"""Texts packed into containers of fixed capacity (problem 6).

Sizes are counted into a histogram, and best-fit decreasing is run over its counts instead of over
texts: the plan says, for each size, which containers the first, second, ... text of that size goes
to. Texts then take their slots by their rank within their size. The plan has a few entries for each
size up to the capacity, whatever the number of texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of one size that are ranked in one task, on average; a frequent size is ranked in parts.
RANK_ROWS = 1 << 20


def tokens(text: str) -> Column:
    """Tokens of the byte-level tokenizer of ByT5 without special tokens; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def plan(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over counts: entries ``size, first rank, first container, texts per container``.

    Ranks and containers count from 0; an entry holds for the ranks up to the next entry of the
    size. Sizes must be from 0 to ``capacity``. Texts without tokens go to the first container.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    entries: list[tuple[int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges (first container, containers)
    free: list[int] = []
    used = 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append((first, count))

    for size in sorted((s for s in histogram if s > 0 and histogram[s] > 0), reverse=True):
        if size > capacity:
            raise ValueError(f"size {size} is above the capacity {capacity}")
        wanted, rank = histogram[size], 0
        while wanted:
            k = bisect_left(free, size)
            if k == len(free):
                each = capacity // size
                full, rest = divmod(wanted, each)
                entries.append((size, rank, used, each))
                put(capacity - each * size, used, full)
                put(capacity - rest * size, used + full, 1 if rest else 0)
                used += full + (rest > 0)
                break
            left = free[k]
            first, count = room[left].pop()
            if not room[left]:
                del room[left], free[k]
            each = left // size
            full, rest = divmod(min(wanted, count * each), each)
            entries.append((size, rank, first, each))
            put(left - each * size, first, full)
            if rest:
                put(left - rest * size, first + full, 1)
            put(left, first + full + (rest > 0), count - full - (rest > 0))
            placed = full * each + rest
            wanted -= placed
            rank += placed
    if histogram.get(0):
        entries.append((0, 0, 0, histogram[0]))
    return entries


def pieces(items: DataFrame, key: str, text: str, specs: DataFrame, container: str = "container_id", capacity: str = "capacity") -> DataFrame:
    """``container_id, capacity, key, piece, n_pieces, start, tokens``: each text for each kind of container.

    Only texts above the capacity are split, into full containers and a rest. Kinds without a capacity
    of 1 or more hold nothing and are left out; repeated kinds count once.
    """
    kinds = specs.select(F.col(container).alias("container_id"), F.col(capacity).cast("long").alias("capacity")).where("capacity >= 1").distinct()
    # a plan is made for each kind on the driver, so their number is small; each text is repeated once for each kind
    each = F.array(*[F.struct(F.lit(k["container_id"]).cast(kinds.schema[0].dataType).alias("container_id"), F.lit(k["capacity"]).alias("capacity")) for k in kinds.orderBy("container_id", "capacity").collect()])
    sized = items.select(F.col(key).alias("key"), tokens(text).alias("size"))
    both = sized.select("key", "size", F.inline(each)) if kinds.limit(1).count() else sized.select("key", "size", F.lit(None).cast(kinds.schema[0].dataType).alias("container_id"), F.lit(1).cast("long").alias("capacity")).limit(0)
    both = both.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.expr("try_divide(size, capacity)"))).cast("int"))
    cut = both.select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    start = F.col("piece").cast("long") * F.col("capacity")
    return cut.select("container_id", "capacity", "key", "piece", "n_pieces", start.alias("start"), F.least(F.col("capacity"), F.col("size") - start).alias("tokens"))


def pack(items: DataFrame, key: str, text: str, specs: DataFrame, container: str = "container_id", capacity: str = "capacity", rank_rows: int = RANK_ROWS) -> DataFrame:
    """pieces() with ``slot``, the number of the container (from 0) of its kind that each piece goes to.

    Null and empty texts are pieces without tokens in container 0; a repeated row is packed each
    time; a null key is kept. The histogram that comes to the driver has one row per size, so at
    most the sum of all capacities; the plan sent to the executors is of that order too.
    """
    cut = pieces(items, key, text, specs, container, capacity)
    counts = cut.groupBy("container_id", "capacity", "tokens").count().collect()
    histograms: dict[tuple[int, int], dict[int, int]] = {}
    for r in counts:
        histograms.setdefault((r["container_id"], r["capacity"]), {})[r["tokens"]] = r["count"]
    slot = _slots({kind: plan(h, kind[1]) for kind, h in histograms.items()})
    parts = max((-(-n // rank_rows) for h in histograms.values() for n in h.values()), default=1)
    ranked = cut.withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.lit(parts)).cast("int"))
    same = ["container_id", "capacity", "tokens", "part"]
    before = ranked.groupBy(*same).count().withColumn("before", F.sum("count").over(Window.partitionBy(*same[:3]).orderBy("part")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy(*same).orderBy("key", "piece")) - 1
    kinds_match = F.lit(True)
    for c in same:
        kinds_match = kinds_match & F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    placed = ranked.withColumn("inside", inside).alias("r").join(before.alias("b"), kinds_match).select("r.*", (F.col("inside") + F.col("before")).alias("rank"))
    return placed.withColumn("slot", slot("container_id", "capacity", "tokens", "rank")).drop("part", "inside", "rank")


def _slots(plans: Mapping[tuple[int, int], Iterable[tuple[int, int, int, int]]]):
    """A column function from kind, capacity, size and rank to the container."""
    rows = sorted((kind, *entry) for kind, entries in plans.items() for entry in entries)
    groups: dict[tuple, int] = {}
    for kind, size, *_ in rows:
        groups.setdefault((kind, size), len(groups))
    wide = 1 << 44  # ranks of one size
    keys = np.array([groups[kind, size] * wide + rank for kind, size, rank, _, _ in rows], np.int64)
    ranks, first, each = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
    kinds = {}
    sizes: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for (kind, size), g in groups.items():
        kinds.setdefault(kind, []).append((size, g))
    for kind, pairs in kinds.items():
        pairs.sort()
        sizes[kind] = (np.array([s for s, _ in pairs], np.int64), np.array([g for _, g in pairs], np.int64))

    @F.arrow_udf(T.LongType())
    def slot(container: pa.Array, capacity: pa.Array, size: pa.Array, rank: pa.Array) -> pa.Array:
        cap, n, k = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (capacity, size, rank))
        cid = np.array([np.iinfo(np.int64).min if x is None else x for x in container.to_pylist()], np.int64)
        out = np.zeros(len(n), np.int64)
        for kind, (known, group) in sizes.items():
            own = np.flatnonzero((cid == (np.iinfo(np.int64).min if kind[0] is None else kind[0])) & (cap == kind[1]))
            if len(own):
                g = group[np.searchsorted(known, n[own])]
                at = np.searchsorted(keys, g * wide + k[own], "right") - 1
                out[own] = first[at] + (k[own] - ranks[at]) // each[at]
        return pa.array(out, pa.int64())

    return slot


def usage(packed: DataFrame) -> DataFrame:
    """For each kind: containers used, tokens, the least number of containers possible, and the wasted share."""
    total = packed.groupBy("container_id", "capacity").agg((F.max("slot") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return total.select(
        "container_id",
        "capacity",
        "containers",
        "tokens",
        F.ceil(F.expr("try_divide(tokens, capacity)")).cast("long").alias("at_least"),
        F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("wasted"),
    )
