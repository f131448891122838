"""Sources mixed to target weights by size (problem 7).

The mix is divided into blocks of equal size, which go to the sources one by one by the highest
quotient weight / (2 * blocks + 1) (Sainte-Laguë); a source's blocks go to its shards by the same
rule. Within a shard documents stand in a seeded order, and the blocks drawn decide
which of them are used.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks in a mix, and parts of each source whose sizes are counted.
BLOCKS, FINE = 1 << 20, 8192
#: Rows of a plan that are sent to every task; longer plans are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Least average number of documents in a shard.
SHARD_DOCUMENTS = 64
_LIST = "mix_id int, source string, shard int, width int, quota long, passes long, shift long, whole long"


def sainte_lague(weights: Sequence[int], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1); at equal quotients the first entry goes first.

    Starts from the rounded shares and moves the few seats that differ, so the time does not depend
    on the number of seats.
    """
    total = sum(weights)
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    # below the true result for each entry: then only additions by highest quotient are left
    got = [max(0, (2 * w * seats - total * (len(weights) + 1)) // (2 * total)) for w in weights]
    queue = [(-w / (2 * g + 1), i) for i, (w, g) in enumerate(zip(weights, got, strict=True)) if w > 0]
    exact = [_Quotient(weights[i], got[i], i) for _, i in queue]
    heapq.heapify(exact)
    for _ in range(seats - sum(got)):
        q = heapq.heappop(exact)
        got[q.i] += 1
        heapq.heappush(exact, _Quotient(q.w, q.k + 1, q.i))
    return got


@dataclass
class _Quotient:
    w: int
    k: int
    i: int

    def __lt__(self, other: _Quotient) -> bool:
        a, b = self.w * (2 * other.k + 1), other.w * (2 * self.k + 1)
        return a > b or a == b and self.i < other.i


def plain(source: Column) -> Column:
    """Sources are compared trimmed and in lower case."""
    return F.lower(F.trim(source))


def targets(mixes: DataFrame) -> list[dict]:
    """The target rows, one per mix and source: weights of repeated rows add up, the largest cap holds.

    Rows without mix or source are left out; null and negative weights count as 0.
    """
    rows = mixes.select("mix_id", plain(F.col("source")).alias("source"), F.greatest(F.lit(0), F.coalesce("weight", F.lit(0))).cast("long").alias("weight"), F.col("max_repeats").cast("long").alias("cap")).where("mix_id IS NOT NULL AND source IS NOT NULL")
    rows = rows.groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.when(F.count("cap") == F.count("*"), F.greatest(F.lit(0), F.max("cap"))).alias("cap"))
    return [r.asDict() for r in rows.orderBy("mix_id", "source").collect()]


def _documents(documents: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = documents.select(F.col(key).alias("key"), plain(F.col(source)).alias("source"), size.alias("size")).where("source IS NOT NULL")
    order = F.xxhash64(F.lit(seed), "key")
    return rows.select("key", "source", "size", order.alias("order"), F.pmod(order, F.lit(FINE)).cast("int").alias("fine"))


@dataclass
class Plan:
    """What each source of each mix gets."""

    shares: list[tuple]  # mix_id, source, weight share, target tokens, source tokens, cap, reached
    quotas: list[tuple]  # see _LIST


def allocate(wanted: Sequence[dict], sizes: dict[str, dict[int, tuple[int, int]]], total: int, seed: int, blocks: int = BLOCKS) -> Plan:
    """Blocks for sources and shards. ``sizes``: source -> part -> (documents, tokens); ``total``: tokens of the mix."""
    shares, quotas = [], []
    by_mix: dict[int, list[dict]] = {}
    for t in wanted:
        by_mix.setdefault(t["mix_id"], []).append(t)
    seats = min(blocks, total)
    for mix, rows in by_mix.items():
        weights = [t["weight"] for t in rows]
        whole = sum(weights)
        for t, got in zip(rows, sainte_lague(weights, seats), strict=True):
            parts = sizes.get(t["source"], {})
            own = sum(n for _, n in parts.values())
            # a source is short where it cannot give the blocks that it was allotted; within the rounding
            # of the allotment (a block for each source) the share itself decides
            give = None if t["cap"] is None else own * t["cap"]
            near = not own or give is not None and give * seats < (got + len(rows)) * total
            reached = not t["weight"] or not near or own > 0 and give * whole >= total * t["weight"]
            shares.append((mix, t["source"], t["weight"] / whole if whole else 0.0, total * t["weight"] // whole if whole else 0, own, t["cap"], reached))
            if not got or not own or t["cap"] == 0:
                continue
            tokens = got * total // seats
            passes, rest = divmod(tokens, own)
            if t["cap"] is not None and passes >= t["cap"]:
                passes, rest = t["cap"], 0
            width = max(1, -(-FINE * SHARD_DOCUMENTS // max(1, sum(n for n, _ in parts.values()))))
            shards: dict[int, int] = {}
            for part, (_, n) in parts.items():
                shards[part // width] = shards.get(part // width, 0) + n
            names = sorted(shards)
            drawn = sainte_lague([shards[s] for s in names], min(blocks, rest)) if rest else [0] * len(names)
            for s, n in zip(names, drawn, strict=True):
                quota = n * rest // min(blocks, rest) if rest else 0
                shift = hash_mod((seed, mix, s), shards[s])
                quotas.append((mix, t["source"], s, width, quota, passes, shift, shards[s]))
    return Plan(shares, quotas)


def hash_mod(parts: tuple[int, ...], n: int) -> int:
    """A number below ``n`` that depends on all parts alike on every machine."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = ((x ^ (p & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
    return x % n if n > 0 else 0


def plan(documents: DataFrame, mixes: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, blocks: int = BLOCKS) -> Plan:
    """Count sizes and allocate. One row per source of a mix and part (FINE each) comes to the driver."""
    wanted = targets(mixes)
    names = sorted({t["source"] for t in wanted})
    rows = _documents(documents, key, text, source, seed)
    named = F.when(F.col("source").isin(names), F.col("source")) if names else F.lit(None).cast("string")
    counted = rows.groupBy(named.alias("source"), F.when(named.isNotNull(), F.col("fine")).alias("fine")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    sizes: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counted:
        if r["source"] is not None:
            sizes.setdefault(r["source"], {})[r["fine"]] = (r["n"], r["size"])
    return allocate(wanted, sizes, sum(r["size"] for r in counted), seed, blocks)


def shares(documents: DataFrame, mixes: DataFrame, found: Plan | None = None, **options) -> DataFrame:
    """``mix_id, source, share, target, available, max_repeats, reached`` for every target.

    ``reached`` is false where all the source's documents, each used ``max_repeats`` times, are
    smaller than the target, or the source has no text. A weight of 0 is always reached. Documents
    without source are no part of a mix; null and empty texts have size 0.
    """
    found = found or plan(documents, mixes, **options)
    return documents.sparkSession.createDataFrame(found.shares, "mix_id int, source string, share double, target long, available long, max_repeats long, reached boolean")


def mix(documents: DataFrame, mixes: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, blocks: int = BLOCKS, found: Plan | None = None) -> DataFrame:
    """``mix_id, source, key, size, uses``: how often each document is used in each mix (rows with uses only).

    A document whose middle lies in the drawn stretch of its shard's seeded order is used once more
    than the shard's full passes. Documents without tokens have no part in a mix. Shards, not
    sources, are ordered in a task, and their number grows with the source.
    """
    found = found or plan(documents, mixes, key, text, source, seed, blocks)
    spark = documents.sparkSession
    quotas = spark.createDataFrame(found.quotas, _LIST)
    widths = spark.createDataFrame(sorted({(q[1], q[3]) for q in found.quotas}), "source string, width int")
    rows = _documents(documents, key, text, source, seed).where("size > 0").join(_sent(widths, len(found.quotas)), "source").withColumn("shard", F.floor(F.col("fine") / F.col("width")).cast("int"))
    in_order = Window.partitionBy("source", "shard").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("middle", F.sum("size").over(in_order) - F.floor(F.col("size") / 2))
    # one row per mix, source and shard: at most FINE for each target row
    drawn = placed.join(_sent(quotas.drop("width"), len(found.quotas)), ["source", "shard"])
    more = F.pmod(F.col("middle") + F.col("shift"), F.col("whole")) < F.col("quota")
    return drawn.withColumn("uses", F.col("passes") + more.cast("long")).where("uses > 0").select("mix_id", "source", "key", "size", "uses")


def _sent(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def actual(drawn: DataFrame, wanted: DataFrame) -> DataFrame:
    """``mix_id, source, share, target, drawn, actual``: tokens drawn and their share of what was drawn for the mix."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("size") * F.col("uses")).alias("drawn"))
    both = wanted.join(got, ["mix_id", "source"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return both.select("mix_id", "source", "share", "target", "drawn", F.coalesce(F.try_divide("drawn", F.sum("drawn").over(Window.partitionBy("mix_id"))), F.lit(0.0)).alias("actual"), "reached")
