"""Counts, pivots, trends and the digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.config import COUNTED_STATUSES, OVERDUE, OverduePolicy
from tallyspark.operators import predicates


def weekly_pivot(rows: DataFrame, day: str, status: str, values: Sequence[str] | None = None) -> DataFrame:
    """Count by week (its Monday) and status, a column for each status, 0 where there is none.

    With ``values`` the statuses aren't looked up first, and others are left out."""
    known = rows.filter(F.col(status).isNotNull()).withColumn("Week", F.date_trunc("week", F.col(day)).cast("date"))
    pivot = known.groupBy("Week").pivot(status, list(values)) if values else known.groupBy("Week").pivot(status)
    return pivot.count().na.fill(0)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Count of each value, most frequent first, then by value; nulls don't count (A2, O3)."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), F.asc(column))


def metrics_vector(rows: DataFrame, as_of: Column, status: str = "status", due: str = "due", statuses: Sequence[str] = COUNTED_STATUSES, policy: OverduePolicy = OVERDUE["metrics"]) -> DataFrame:
    """One row: Date and, in code-point order, the count of each status; Overdue also counts tasks that are
    overdue by date (A3, F11, O2). One pass, no grouping key."""
    late = predicates.overdue(F.col(status), F.col(due), as_of, policy)
    counts = []
    for name in sorted(statuses):
        n = F.count_if(F.col(status) == name)
        counts.append((n + F.count_if(late) if name == "Overdue" else n).alias(name))
    return rows.agg(*counts).select(as_of.cast("date").alias("Date"), *(F.col(f"`{n}`") for n in sorted(statuses)))


def digest_lines(rows: DataFrame, as_of: Column, waiting_label: str, order: str = "id", policy: OverduePolicy = OVERDUE["digest"]) -> DataFrame:
    """The digest as lines (section, ``order``, line): the overdue, the due and the waiting tasks (title, status, due), each with
    its section (1 to 3) and its order (A6). Section 0 is the head; a section's own heading, with null order, comes before its
    lines, and None behind it where it has no task. No section is gathered anywhere: sort by section and order to read it."""
    # The headings and line forms below are those of the daily digest.
    name = F.coalesce("title", F.lit("Untitled"))
    day = F.substring_index(F.col("due").cast("string"), "T", 1)
    late = predicates.overdue(F.col("status"), F.col("due"), as_of, policy)
    today = ~late & predicates.due_today(F.col("due"), as_of)
    held = predicates.waiting(F.col("status"), waiting_label)
    entry = lambda cond, section, line: F.when(cond, F.struct(F.lit(section).alias("section"), line.alias("line")))
    entries = F.array_compact(F.array(entry(late, 1, F.concat(F.lit("- "), name, F.lit(" (was due "), day, F.lit(")"))), entry(today, 2, F.concat(F.lit("- "), name)), entry(held, 3, F.concat(F.lit("- "), name))))
    lines = rows.filter(late | today | held).select(F.col(order), F.explode(entries).alias("e")).select("e.section", order, "e.line")
    found = rows.agg(*(F.max(c).alias(f"s{k}") for k, c in enumerate((late, today, held), 1)))
    headings = F.array(
        F.struct(F.lit(0).alias("section"), F.concat(F.lit("Daily Task Summary for "), F.date_format(as_of.cast("date"), "yyyy-MM-dd"), F.lit("\n")).alias("line")),
        *(F.struct(F.lit(k).alias("section"), F.concat(F.lit(("" if k == 1 else "\n") + heading + ":"), F.when(F.col(f"s{k}"), F.lit("")).otherwise(F.lit("\nNone"))).alias("line")) for k, heading in enumerate(("Overdue", "Due Today", f"Waiting on {waiting_label}"), 1)),
    )
    heads = found.select(F.explode(headings).alias("e")).select("e.section", F.lit(None).cast(rows.schema[order].dataType).alias(order), "e.line")
    return heads.unionByName(lines)


def trend(rows: DataFrame, day: str, value_columns: Sequence[str]) -> DataFrame:
    """Wide counts as (day, status, count), by day."""
    return rows.unpivot([day], list(value_columns), "status", "count").orderBy(day, "status")


def latest(rows: DataFrame, *order: str, n: int = 1) -> DataFrame:
    """The last ``n`` rows by ``order`` (L1, L2): a top-k, not a sort of everything."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)
