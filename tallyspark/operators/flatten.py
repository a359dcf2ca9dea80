"""Task pages to flat tables, with a dead-letter split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import schemas
from tallyspark.functions import properties as p
from tallyspark.functions import text


def parse_pages(raw: DataFrame, column: str = "value", id_column: str | None = None) -> DataFrame:
    """JSON texts as (id, properties, error): an unreadable text keeps its row, with a reason."""
    page = F.from_json(F.col(column), f"{schemas.PAGE}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rows = raw.withColumn("_page", page)
    reason = F.when(F.col(column).isNull(), F.lit("empty record")).when(F.col("_page._corrupt").isNotNull(), F.lit("malformed record")).when(F.col("_page.properties").isNull(), F.lit("no properties"))
    key = F.coalesce(F.col("_page.id"), F.col(id_column).cast("string") if id_column else F.lit(None).cast("string"))
    return rows.select(key.alias("id"), F.col("_page.properties").alias("properties"), reason.alias("error"))


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts as messages with ``error`` and ``raw``, and the other columns of ``raw`` beside them: an unreadable text and
    a message without id keep their row and their text, with a reason (E1, T5)."""
    message = F.from_json(F.col(column), f"{schemas.MESSAGE}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rows = raw.withColumn("_message", message)
    blank = F.coalesce(F.trim(column), F.lit("")) == ""
    reason = F.when(blank, F.lit("empty record")).when(F.col("_message._corrupt").isNotNull(), F.lit("malformed record")).when(F.coalesce(F.trim("_message.id"), F.lit("")) == "", F.lit("message without id"))
    names = T.StructType.fromDDL(schemas.MESSAGE).names
    return rows.select(*(c for c in raw.columns if c != column and c not in names), *(F.col(f"_message.{n}").alias(n) for n in names), reason.alias("error"), F.col(column).alias("raw"))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows of task_id and error), with the raw text of error rows where there is one."""
    raw = [c for c in ("raw",) if c in rows.columns]
    return rows.filter("error IS NULL").drop("error", *raw), rows.filter("error IS NOT NULL").select(F.col("id").alias("task_id"), "error", *raw)


def tasks(pages: DataFrame) -> DataFrame:
    """The eight flat fields of a task."""
    due = F.coalesce(p.date_start("Due"), F.lit(""))
    return pages.select("id", p.title("Task name", "").alias("title"), p.rich_text("Summary").alias("summary"), p.status_name("Status").alias("status"), p.people("Assignee").alias("assignee"), due.alias("due"), p.select_name("Priority").alias("priority"), p.choices("Tags").alias("tags"), p.select_name("Project").alias("project"))


def snapshot(pages: DataFrame, as_of: Column) -> DataFrame:
    """One dashboard row for each task (P8, P15); Due stays text."""
    return pages.select(as_of.cast("date").alias("Date"), p.title("Task name").alias("Task"), p.status_name("Status", "Unknown").alias("Status"), p.date_start("Due").alias("Due"), p.select_name("Priority", "None", stripped=False).alias("Priority"))


def task_log(rows: DataFrame) -> DataFrame:
    """Title, assignee, priority, due and whether a review is due."""
    blank = (F.coalesce("assignee", F.lit("")) == "") | (F.coalesce("priority", F.lit("")) == "")
    return rows.select(F.col("title").alias("Title"), F.col("assignee").alias("Assignee"), F.col("priority").alias("Priority"), F.col("due").alias("Due"), F.when(blank, "Yes").otherwise("No").alias("Needs Review"))


def mail_tasks(mails: DataFrame) -> DataFrame:
    """HTML mails (subject, body) as tasks."""
    rows = mails.withColumn("Content", text.html_text("body"))
    content = F.col("Content")
    return rows.select(text.strip(F.col("subject")).alias("Task name"), text.due_in_text(content).alias("Due"), text.keyword_tags(content).alias("Tags"), text.priority_in_text(content).alias("Priority"), "Content")


def commands(messages: DataFrame, *more: str) -> DataFrame:
    """(id, title, content) of command mails (P11 to P13, X8, X9), and more of their columns."""
    rows = messages.select("id", *more, p.header("Subject").alias("subject"), p.plain_body().alias("body"))
    return rows.select("id", *more, text.command_title(F.col("subject"), F.col("body")).alias("title"), text.command_content(F.col("body")).alias("content"))


def lines(rows: DataFrame, *columns: str, separator: str = " | ") -> DataFrame:
    """One listing line for each row; nulls are left out."""
    return rows.select(F.concat_ws(separator, *columns).alias("line"))
