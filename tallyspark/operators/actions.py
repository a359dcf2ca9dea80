"""Intended effects as data: payloads for an outbox, and keyed updates. Nothing is sent from here."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text

#: Bytes of a part of an attachment: a multiple of three, so that the base64 texts of parts can be joined.
PART_BYTES = 3 << 20

# The property names and kinds in the payloads below are those of the task tracker's pages.


def _title(c: Column) -> Column:
    return F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("text"))).alias("title"))


def _rich(c: Column) -> Column:
    return F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("text"))).alias("rich_text"))


def _named(kind: str, c: Column) -> Column:
    return F.struct(F.struct(c.alias("name")).alias(kind))


def _day(c: Column) -> Column:
    return F.struct(F.struct(text.day_text(c).alias("start")).alias("date"))


def page_payload(title: Column, body: Column, as_of: Column, url: Column | None = None, kind: str = "short", agent: str = "agent") -> Column:
    """JSON to create a task page.

    ``short`` has name, summary and status (K5a); ``full`` adds tags, dates, priority, type and url (K5b);
    ``due`` has a due day three days on and the url if it is one (K5d); ``log`` has agent, task and url (K5c)."""
    base = [_title(title).alias("Task name"), _rich(body).alias("Summary"), _named("status", F.lit("Not started")).alias("Status")]
    url = F.lit(None).cast("string") if url is None else url
    if kind == "full":
        base += [
            F.struct(F.array().cast("array<struct<name: string>>").alias("people")).alias("Assignee"),
            F.struct(text.trigger_tags(body).alias("multi_select")).alias("Tags"),
            _day(as_of).alias("Due"), _named("select", F.lit("Medium")).alias("Priority"), _rich(F.lit(agent)).alias("Created by"),
            _day(as_of).alias("Started on"), _named("select", F.lit("Creative")).alias("Task type"), F.struct(url.alias("url")).alias("URL"),
        ]
    elif kind == "due":
        base += [_day(text.days_later(as_of)).alias("Due"), F.struct(text.http_or_null(url).alias("url")).alias("Doc Link")]
    elif kind == "log":
        base = [_title(F.lit(agent)).alias("Agent"), _rich(title).alias("Task"), F.struct(url.alias("url")).alias("Document")]
    return F.to_json(F.struct(F.struct(*base).alias("properties")))


def escalation_payload(nudges: Column) -> Column:
    """JSON to flag a task and count one more nudge."""
    return F.to_json(F.struct(F.struct(F.struct(F.lit(True).alias("checkbox")).alias("Escalation flag"), F.struct(text.incremented(nudges).alias("number")).alias("Nudge count")).alias("properties")))


def document_payload(title: Column, content: Column, writer: Column | None = None) -> Column:
    """JSON to create a document with text at its start, shared with a writer if given."""
    cols = [title.alias("title"), F.struct(F.lit(1).alias("index"), content.alias("text")).alias("insert")]
    if writer is not None:
        cols.append(F.struct(F.lit("user").alias("type"), F.lit("writer").alias("role"), writer.alias("emailAddress")).alias("permission"))
    return F.to_json(F.struct(*cols))


def stamped_document_payload(prefix: str, as_of: Column, writer: Column) -> Column:
    """JSON to create an empty document named by the as-of time and share it with a writer, who is told."""
    permission = F.struct(F.lit("user").alias("type"), F.lit("writer").alias("role"), writer.alias("emailAddress"))
    return F.to_json(F.struct(F.concat(F.lit(prefix), text.stamp_text(as_of)).alias("title"), permission.alias("permission"), F.lit(True).alias("sendNotificationEmail")))


def with_attachments(mails: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """``mails`` with ``filename`` and ``data`` (base64) of the file whose path ends each ``path``; null where there is no such
    file, so the mail goes without (K9a, K9c, S9). ``files`` has path, length and content of whole files."""
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    found = files.select(plain(F.col("path")).alias("_path"), F.base64("content").alias("data")).dropDuplicates(["_path"])
    rows = mails.join(found, plain(F.col(path)) == F.col("_path"), "left")
    return rows.withColumn("filename", F.when(F.col("data").isNotNull(), text.basename(F.col(path)))).drop("_path")


def with_attachment_parts(mails: DataFrame, files: DataFrame, path: str = "path", size: int = PART_BYTES) -> DataFrame:
    """``with_attachments`` for files of any length, unread: a row for each part of ``size`` bytes of a mail's file, with ``filename``,
    ``file``, ``part`` (from 0) and ``parts``; a mail without a file keeps one row, with nulls, and an empty file has one part. No row
    stands for more than a part, so payloads stay below the 20,000,000 characters beyond which ``get_json_object`` gives null.
    ``files`` has path and length; ``readers.with_part_contents`` reads the parts."""
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    parts = F.greatest(F.ceil(F.col("length") / size).cast("long"), F.lit(1).cast("long"))
    found = files.select(plain(F.col("path")).alias("_path"), F.col("path").alias("file"), parts.alias("parts")).dropDuplicates(["_path"])
    rows = mails.join(found, plain(F.col(path)) == F.col("_path"), "left").withColumn("filename", F.when(F.col("file").isNotNull(), text.basename(F.col(path))))
    return rows.withColumn("part", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("_path")


def part_digests(rows: DataFrame, key: str, part: str, content: str) -> DataFrame:
    """(key, sha256) of the contents of each key's parts, joined in order; null without any. SHA-256 takes bytes one after another, so a
    file is a task's work, which holds some parts at a time and never the whole file."""
    spark = rows.sparkSession
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(bound, "2147483647")) == 2147483647:  # parts are large rows
        spark.conf.set(bound, str(8 << 20))
    kind = rows.schema[key].dataType.simpleString()
    placed = rows.select(F.col(key).alias("key"), F.col(part).alias("part"), F.col(content).alias("content")).repartition("key").sortWithinPartitions("key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = kept = None  # a key, its digest so far, and the type of keys
        told = lambda: pa.RecordBatch.from_arrays([pa.array([now], kept), pa.array([state.hexdigest() if state else None], pa.string())], ["key", "sha256"])
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch["key"][k].as_py()
                if kept is None or own != now:
                    if kept is not None:
                        yield told()
                    now, state, kept = own, None, batch["key"].type
                if batch["content"][k].is_valid:
                    state = state or hashlib.sha256()
                    state.update(batch["content"][k].as_buffer())
        if kept is not None:
            yield told()

    return placed.mapInArrow(run, f"key {kind}, sha256 string").withColumnRenamed("key", key)


def mail_payload(to: Column, subject: Column, body: Column, attachment: Column | None = None, filename: Column | None = None, data: Column | None = None, part: Column | None = None) -> Column:
    """JSON of a mail with its base64url body, and an attachment's path and name, or its name and data, or a ``part`` of those (K8, K9)."""
    cols = [to.alias("to"), subject.alias("subject"), text.to_base64url(body).alias("raw")]
    if attachment is not None:
        cols += [attachment.alias("path"), text.basename(attachment).alias("filename")]
    elif data is not None:
        cols += [filename.alias("filename"), data.alias("data"), *([] if part is None else [part.alias("part")])]
    return F.to_json(F.struct(*cols))


def chat_update(name: Column, status: Column, due: Column) -> Column:
    """The chat text about an updated task (K10b, X7); nulls show as empty."""
    show = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.format_string("Task update\n* task: %s\n* status: %s\n* due: %s", show(name), show(status), show(due))


def outbox(rows: DataFrame, channel: str, target: Column, payload: Column, *key: Column, day: Column | None = None) -> DataFrame:
    """(key, channel, target, payload[, day]) of intended effects; the key is a digest of what makes an effect the
    same, so a replayed batch gives the same keys. The day of what caused them divides a large outbox."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(channel), *(k.cast("string") for k in key)), 256)
    return rows.select(digest.alias("key"), F.lit(channel).alias("channel"), target.alias("target"), payload.alias("payload"), *([] if day is None else [day.cast("date").alias("day")]))


def keyed_update(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``rows`` with the non-null values of the update with the same key (K6a). Of several updates for a key,
    the largest values count."""
    changed = [c for c in updates.columns if c != key]
    one = updates.groupBy(key).agg(*(F.max(c).alias(f"__{c}") for c in changed))
    out = rows.join(one, key, "left")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in rows.columns))


def escalations(rows: DataFrame, late: Column, key: str = "id", nudges: str = "nudges") -> DataFrame:
    """Updates (key, flag, nudges + 1) for late tasks."""
    return rows.filter(late).select(key, F.lit(True).alias("escalated"), text.incremented(F.col(nudges)).alias(nudges))
