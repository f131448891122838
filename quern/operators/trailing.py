"""Totals over trailing periods, one row per entity and calendar day.

Every daily amount becomes two deltas: it enters the total on its day and leaves it ``period`` days
later. The running sum of the deltas is the trailing total, and it only changes on days with a delta,
so the calendar is expanded from runs of equal totals instead of being joined in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_runs(events: DataFrame, entity: Column, day: Column, amount: Column, periods: Sequence[int]) -> DataFrame:
    """Runs of days with the same trailing total.

    Columns ``entity, period_days, from_day, to_day, total, n, peak``: on each day from ``from_day``
    to ``to_day`` the ``period_days`` days ending with it hold ``n`` amounts that add up to ``total``;
    ``peak`` is the entity's highest total. Runs cover the calendar from the entity's first to its
    last counted day without gaps.

    Rows without day or amount do not count; a null entity is an entity of its own; an entity without
    a counted row has no calendar; an empty input gives an empty result. Repeated rows all count
    (remove repeats first where they should not). Other columns of ``events`` are not looked at, so
    their names cannot clash. Amounts should be whole numbers or decimals: what enters a
    total is subtracted again later, which floating-point sums do not undo exactly.

    One entity's rows meet in one task only after the sum per day, so a task holds at most two rows
    per calendar day and period, however many events a hot entity has.
    """
    if not periods or min(periods) < 1:
        raise ValueError("periods must be whole numbers of days, 1 or more")
    daily = (
        events.select(entity.alias("entity"), F.to_date(day).alias("day"), amount.alias("amount"))
        .where("day IS NOT NULL AND amount IS NOT NULL")
        .groupBy("entity", "day")
        .agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    )
    sides = F.array(
        *[
            F.struct(F.lit(p).alias("period_days"), F.date_add("day", shift).alias("at"), (F.col("amount") * sign).alias("amount"), (F.col("n") * sign).alias("n"), F.lit(sign > 0).alias("enters"))
            for p in periods
            for sign, shift in ((1, 0), (-1, p))
        ]
    )
    # one exchange of daily rows serves everything below
    deltas = daily.repartition("entity").select("entity", F.inline(sides)).groupBy("entity", "period_days", "at").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"), F.max("enters").alias("enters"))
    own = Window.partitionBy("entity", "period_days")
    in_order = own.orderBy("at")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    runs = deltas.select(
        "entity",
        "period_days",
        F.col("at").alias("from_day"),
        F.lead("at").over(in_order).alias("next_at"),
        F.sum("amount").over(so_far).alias("total"),
        F.sum("n").over(so_far).alias("n"),
        F.max(F.when(F.col("enters"), F.col("at"))).over(own).alias("last_day"),
    ).where("from_day <= last_day")
    return runs.select(
        "entity",
        "period_days",
        "from_day",
        F.least(F.date_sub("next_at", 1), "last_day").alias("to_day"),
        "total",
        "n",
        F.max("total").over(own).alias("peak"),
    )


def spread(runs: DataFrame) -> DataFrame:
    """One row per day of each run: ``from_day, to_day`` become ``day``."""
    kept = [c for c in runs.columns if c not in ("from_day", "to_day")]
    return runs.select(*kept, F.explode(F.sequence("from_day", "to_day")).alias("day"))


def trailing_totals(events: DataFrame, entity: Column, day: Column, amount: Column, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """``entity, period_days, day, total, n, mean, daily_mean`` for every calendar day (see trailing_runs).

    ``mean`` is per amount and null where the period holds none; ``daily_mean`` divides by the
    length of the period.
    """
    days = spread(trailing_runs(events, entity, day, amount, periods))
    return days.select(
        "entity",
        "period_days",
        "day",
        "total",
        "n",
        F.try_divide(F.col("total").cast("double"), F.col("n")).alias("mean"),
        (F.col("total").cast("double") / F.col("period_days")).alias("daily_mean"),
    )


def peak_days(events: DataFrame, entity: Column, day: Column, amount: Column, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Days on which an entity's trailing total equals the highest of its calendar; ties all count."""
    return spread(trailing_runs(events, entity, day, amount, periods).where("total = peak").drop("peak"))
