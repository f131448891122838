"""History of changing attributes, kept as insert-only satellites.

Attributes are split into satellites by how often they change. A satellite only gets a row when
the hash of its attributes differs from that of the row before it, rows are never updated, and the
end of a version is computed by a view from the start of the next one.

One key may hold a large part of all rows, so no task orders a whole hot key: keys are counted first,
and the rows of hot ones are compared inside (key, time bucket), where only one summary row per bucket
meets the key's other buckets. All other keys are compared whole, in one exchange of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which a key is hot, and the time that a part of it spans.
HOT_ROWS, BUCKET = 1_000_000, "day"
#: Hot keys that are sent to every task; more of them are joined by shuffle.
BROADCAST_KEYS = 100_000


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _neighbour(rows: DataFrame, keys: Sequence[str], value: Column, out: str, later: bool) -> DataFrame:
    """``rows`` (with column ``at``) and the value of the key's row just before or after.

    ``value`` must not be null. ``out`` is null for a key's first (or last) row. Where ``rows`` has a
    ``bucket``, keys are parted by it.
    """
    step = F.lead if later else F.lag
    if "bucket" not in rows.columns:
        return rows.withColumn(out, step(value).over(Window.partitionBy(*keys).orderBy("at")))
    parts = [*keys, "bucket"]
    within = rows.withColumn("_inner", step(value).over(Window.partitionBy(*parts).orderBy("at")))
    edge = F.min_by(value, "at") if later else F.max_by(value, "at")
    across = Window.partitionBy(*keys).orderBy("bucket")
    edges = rows.where("bucket != ''").groupBy(*parts).agg(edge.alias("edge")).select(*parts, step("edge").over(across).alias("_edge"))
    joined = within.alias("r").join(edges.alias("e"), _same("r", "e", keys) & (F.col("r.bucket") == F.col("e.bucket")), "left")
    return joined.select("r.*", "_edge").withColumn(out, F.coalesce("_inner", "_edge")).drop("_inner", "_edge")


def hash_diff(columns: Sequence[str]) -> Column:
    """Hash of attribute values; null differs from every value, and values cannot run together."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *marked))


def change_log(updates: DataFrame, keys: Mapping[str, Column], at: Column, tie: Column, satellites: Mapping[str, Mapping[str, Column]], bucket: str = BUCKET, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The moments at which any satellite gets a row.

    ``updates`` are snapshots or update rows in any order, late and repeated ones included. Of
    several rows of one key at one moment the one with the highest ``tie`` counts (at equal ties the
    highest attribute values). Rows without ``at`` are left out. Null keys form a key of
    their own; a null attribute is a value like any other. Columns: keys, ``at``, the attributes, and
    for each satellite ``<name>_changed``. Empty input gives an empty log. Keys are counted at
    once, as the plan depends on whether any has ``hot_rows``; the log then has the column ``bucket`` too.
    """
    attributes = {c: e for group in satellites.values() for c, e in group.items()}
    names = list(keys)
    rows = updates.select(*[e.alias(f"k_{k}") for k, e in keys.items()], at.alias("at"), F.struct(tie.alias("_tie"), *[e.alias(c) for c, e in attributes.items()]).alias("_last")).where("at IS NOT NULL")
    held = [f"k_{k}" for k in names]
    hot = rows.groupBy(*held).count().where(F.col("count") >= hot_rows).select(*held)
    parts = list(held)
    n_hot = hot.limit(BROADCAST_KEYS + 1).count()
    if n_hot:
        hot = hot.withColumn("_hot", F.lit(True))
        joined = rows.alias("r").join((F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot).alias("h"), _same("r", "h", held), "left")
        rows = joined.select("r.*", F.when(F.col("_hot"), F.date_trunc(bucket, "at").cast("string")).otherwise("").alias("bucket"))
        parts.append("bucket")
    # one exchange: what follows groups and orders by the same columns and more
    rows = rows.repartition(*parts).groupBy(*parts, "at").agg(F.max("_last").alias("_last")).select(*parts, "at", *[F.col(f"_last.{c}").alias(c) for c in attributes])
    rows = rows.withColumn("_hash", F.struct(*[hash_diff(list(group)).alias(s) for s, group in satellites.items()]))
    rows = _neighbour(rows, held, F.col("_hash"), "_before", later=False)
    flags = {f"{s}_changed": F.col("_before").isNull() | (F.col(f"_hash.{s}") != F.col(f"_before.{s}")) for s in satellites}
    log = rows.withColumns(flags).where(" OR ".join(flags))
    return log.select(*[F.col(f"k_{k}").alias(k) for k in names], "at", *parts[len(held) :], *attributes, *flags)


def satellite(log: DataFrame, keys: Sequence[str], name: str, columns: Sequence[str]) -> DataFrame:
    """The insert-only rows of one satellite: keys, ``at``, its attributes."""
    return log.where(f"{name}_changed").select(*keys, "at", *columns)


def versions(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The view over all satellites: one row per version with ``valid_from`` and ``valid_to`` (null: open)."""
    ended = _neighbour(log, keys, F.col("at"), "valid_to", later=True)
    return ended.withColumnRenamed("at", "valid_from").drop("bucket", *[c for c in log.columns if c.endswith("_changed")])


def append(stored: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows to append to a stored satellite: ``updates`` (keys, ``at``, attributes) that change it.

    Updates older than a key's newest stored row are not appended here, as later rows
    may depend on them; late_keys() names such keys, which are rebuilt with change_log.
    """
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct("at", *columns), "at").alias("_s"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"u.{k}").eqNullSafe(F.col(f"n.{k}"))
    fresh = updates.alias("u").join(newest.alias("n"), same, "left").where("_s IS NULL OR u.at > _s.at").select("u.*")
    base = newest.select(*keys, "_s.*")
    both = base.select(*keys, "at", *columns, F.lit(0).alias("_new")).unionByName(fresh.select(*keys, "at", *columns, F.lit(1).alias("_new")))
    log = change_log(both, {k: F.col(k) for k in keys}, F.col("at"), F.col("_new"), {"s": {c: F.col(c) for c in columns}, "origin": {"_new": F.col("_new")}})
    return satellite(log.where("_new = 1"), keys, "s", columns)


def late_keys(stored: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with updates at or before their newest stored row: append() leaves those out."""
    newest = stored.groupBy(*keys).agg(F.max("at").alias("_newest"))
    met = updates.alias("u").join(newest.alias("n"), _same("u", "n", keys))
    return met.where("u.at <= _newest").select(*[f"u.{k}" for k in keys]).distinct()
