"""Predicates on tasks. A missing status is replaced before it is negated, so no row is lost to null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.config import DEFAULT_POLICY, OverduePolicy
from tallyspark.functions import text


def overdue(status: Column, due: Column, as_of: Column, policy: OverduePolicy = DEFAULT_POLICY) -> Column:
    """Whether a task is overdue under the policy (F2a to F2d, F10); never null. ``due`` is text, date or timestamp."""
    due = due.cast("string")
    if policy.grain == "date":
        late = text.due_date(due) < as_of.cast("date")
    elif policy.grain == "midnight":
        late = text.due_date(due).cast("timestamp") < as_of.cast("timestamp")
    else:
        late = text.due_time(due) < as_of.cast("timestamp")
    return F.coalesce(late, F.lit(False)) & ~F.coalesce(status, F.lit(policy.default_status)).isin(*policy.exempt)


def due_today(due: Column, as_of: Column) -> Column:
    """Due on the as-of day, whatever the status."""
    return F.coalesce(text.due_date(due.cast("string")) == as_of.cast("date"), F.lit(False))


def waiting(status: Column, label: str) -> Column:
    return F.coalesce(status == label, F.lit(False))


def tagged(tags: Column) -> Column:
    """Whether there is any tag, so that something is to be done (F14); never null."""
    return F.coalesce(F.size(tags) > 0, F.lit(False))


def asks_for(snippet: Column, phrase: str) -> Column:
    """Whether a mail's snippet holds the phrase, in whatever case."""
    return text.has(snippet, phrase)


def mentions_done(title: Column, content: Column, word: str = "Done") -> Column:
    """The word, in this case, in title or content."""
    return F.coalesce(F.contains(title, F.lit(word)), F.lit(False)) | F.coalesce(F.contains(content, F.lit(word)), F.lit(False))


def mailbox(messages: DataFrame, sender: str | None = None, recipient: str | None = None) -> DataFrame:
    """Unread messages, of a sender and to a recipient if given (F8)."""
    out = messages.filter("unread")
    if sender is not None:
        out = out.filter(F.col("sender") == sender)
    return out if recipient is None else out.filter(F.col("recipient") == recipient)


def latest_alerts(history: DataFrame, day: str, cond: Column) -> DataFrame:
    """The rows of the latest day that fulfil ``cond`` (F1, A4): the day is a scalar subquery, so a
    history partitioned by day is pruned to it."""
    last = history.select(F.max(day)).scalar()
    return history.filter((F.col(day) == last) & F.coalesce(cond, F.lit(False)))


def snapshot_alert(priority: str = "Priority", status: str = "Status", high: Sequence[str] = ("High",), late: Sequence[str] = ("Overdue",)) -> Column:
    return F.col(priority).isin(*high) | F.col(status).isin(*late)
