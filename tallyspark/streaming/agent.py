"""The mail agent and the nudge counter as streams.

The checkpoint is the cursor that marking messages as read used to be: a batch counts as done when its
outbox rows are written, and their keys make a replay harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyspark import schemas
from tallyspark.config import DOCUMENT_NOTE, Settings
from tallyspark.functions import text
from tallyspark.operators import actions, delivery, flatten, predicates
from tallyspark.sources import mailbox, writers


def record_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Records dropped as files of JSON lines, one file a batch (T2), as messages with error and raw text (E1): nothing is
    lost and nothing collapses before dead letters are split off."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return flatten.parse_messages(raw.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")))


def mailbox_stream(spark: SparkSession, path: str, files_per_poll: int | None = None) -> DataFrame:
    """Records of a mailbox whose messages are marked as read once their batch is done (S7a, S7b, T2 to T4), with error and raw text."""
    mailbox.register(spark)
    reader = spark.readStream.format("mailbox").option("path", path)
    return flatten.parse_messages((reader if files_per_poll is None else reader.option("filesPerPoll", files_per_poll)).load())


def message_stream(spark: SparkSession, path: str, files_per_batch: int = 1, delay: str = "1 day") -> DataFrame:
    """Messages dropped as JSON files, one file a batch (T2), each id once within ``delay`` (T3). Dead letters are split off
    before that: ``record_stream`` has them."""
    good, _ = flatten.split_errors(record_stream(spark, path, files_per_batch))
    timed = good.drop("file", "block").withColumn("received", F.col("received").cast("timestamp")).withWatermark("received", delay)
    return timed.dropDuplicatesWithinWatermark(["id"])


def command_effects(messages: DataFrame, settings: Settings) -> DataFrame:
    """Outbox rows of a batch of command mails: a document, a task page and a reply for each (3.2)."""
    parsed = flatten.commands(predicates.mailbox(messages), "received", "sender")
    todo = parsed.filter(~predicates.mentions_done(F.col("title"), F.col("content")))
    agent = text.routed(F.col("content"), settings.routes, settings.agent)
    page = actions.page_payload(F.col("title"), F.col("content"), F.col("received"), kind="full", agent=settings.agent)
    reply = actions.mail_payload(F.col("sender"), F.concat(F.lit("Done: "), F.col("title")), F.col("content"))
    pieces = (("document", agent, actions.document_payload(F.col("title"), F.col("content"))), ("page", F.lit(settings.database), page), ("mail", F.col("sender"), reply))
    out = [actions.outbox(todo, channel, target, payload, F.col("id"), day=F.col("received")) for channel, target, payload in pieces]
    return out[0].unionByName(out[1]).unionByName(out[2])


def snippet_effects(messages: DataFrame, settings: Settings, phrase: str, title: str, content: str, task: str) -> DataFrame:
    """Outbox rows of unread mails whose snippet asks for something: a document, a log page with its link, and a mail about it
    (S7b, F9, K5c). The document's link is a connector's to give: the page and the mail name the document's key."""
    todo = messages.filter("unread").filter(predicates.asks_for(F.col("snippet"), phrase))
    made = actions.outbox(todo, "document", F.lit(settings.agent), actions.document_payload(F.lit(title), F.lit(content)), F.col("id"), day=F.col("received"))
    link = F.concat(F.lit("document:"), F.sha2(F.concat_ws("\x1f", F.lit("document"), F.col("id")), 256))
    page = actions.page_payload(F.lit(task), F.lit(""), F.col("received"), link, "log", settings.agent)
    note = actions.mail_payload(F.col("sender"), F.lit(DOCUMENT_NOTE[0]), F.concat(F.lit(DOCUMENT_NOTE[1]), link))
    pages = actions.outbox(todo, "page", F.lit(settings.database), page, F.col("id"), day=F.col("received"))
    return made.unionByName(pages).unionByName(actions.outbox(todo, "mail", F.col("sender"), note, F.col("id"), day=F.col("received")))


def run_agent(messages: DataFrame, settings: Settings, outbox: str, errors: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the effects of each batch to the outbox (T1, T4). Of records (with ``error`` and ``raw``), those that aren't messages
    become dead letters with their raw text (T5), each once; other failures stop the query and are retried from the checkpoint.
    The keys of effects and letters make a replay harmless, with a lost checkpoint, too."""
    place = [c for c in ("file", "position", "block") if c in messages.columns]

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        if "error" in rows.columns:
            writers.add_letters(rows.filter("error IS NOT NULL").withColumn("task_id", F.coalesce("id", F.lit(""))), errors, *place)
            rows = rows.filter("error IS NULL").drop("error", "raw", *place)
        writers.add_to_outbox(command_effects(rows, settings), outbox)
        rows.unpersist()

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()


def deliver(spark: SparkSession, ledger: str, connector, at, most: int = 3, *channels: str) -> None:
    """One round of delivery: attempt the effects of a ledger that are pending, or have failed fewer than ``most`` times, and add
    the reports in one transaction (K5 to K10, E4). ``connector`` gets each effect with its ``attempts`` so far; ``at`` is the
    round's time, and a round that is repeated at the same time adds the reports it has not added yet."""
    effects, reports = (writers.ledger(spark, ledger, kind) for kind in (writers.EFFECT, writers.REPORT))
    due = delivery.due_again(delivery.delivery_status(effects, reports.drop("day")), most)
    if channels:
        due = due.filter(F.col("channel").isin(*channels))
    # stored, so that each effect is attempted once, however often the writer looks at the reports
    path = writers.scratch(spark, "attempts")
    delivery.attempts(due, connector, at).write.parquet(path)
    told = spark.read.schema(schemas.REPORT).parquet(path)
    writers.add_to_outbox(effects.limit(0), ledger, told)


def nudge_counts(late: DataFrame) -> DataFrame:
    """A stream of late tasks (id) as running nudge counts (id, nudges), kept as state by id (T6); for output mode update."""
    return late.groupBy("id").agg(F.count(F.lit(1)).alias("nudges"))
