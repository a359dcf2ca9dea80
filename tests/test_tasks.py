"""Task pages, predicates, metrics, updates, files and streams on small rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.config import OVERDUE, Settings
from tallyspark.functions import text
from tallyspark.operators import actions, delivery, flatten, metrics, predicates
from tallyspark.sources import readers, writers
from tallyspark.streaming import agent


def _pages(spark):
    page = lambda i, **props: (json.dumps({"id": i, "properties": props}),)
    span = lambda t: {"text": {"content": t}}
    rows = [
        page("a", **{"Task name": {"title": [span("One"), span("Two")]}, "Status": {"status": {"name": "Done"}}, "Due": {"date": {"start": "2024-01-02T10:00:00+01:00"}}, "Priority": {"select": {"name": " High "}}, "Assignee": {"people": [{"name": "x"}, {}]}, "Tags": {"multi_select": [{"name": "t"}]}, "Nudge count": {"number": 2}}),
        page("b", **{"Task name": {"title": []}, "Status": {"select": {"name": "Waiting"}}, "Due": {"date": None}, "Priority": {"select": None}}),
        page("c"),
        ("{broken",), (None,), ('{"id": "z"}',),
    ]
    return spark.createDataFrame(rows, "value string")


def test_pages_split_and_flatten(spark):
    good, bad = flatten.split_errors(flatten.parse_pages(_pages(spark)))
    assert sorted((r.task_id or "", r.error) for r in bad.collect()) == [("", "empty record"), ("", "malformed record"), ("z", "no properties")]
    rows = {r.id: r for r in flatten.tasks(good).collect()}
    assert rows["a"].asDict() == {"id": "a", "title": "One", "summary": "", "status": "Done", "assignee": ["x", ""], "due": "2024-01-02T10:00:00+01:00", "priority": "High", "tags": ["t"], "project": ""}
    assert (rows["b"].title, rows["b"].status, rows["b"].due, rows["c"].assignee) == ("", "Waiting", "", [])
    snap = {r.Task: r for r in flatten.snapshot(good, F.lit("2024-01-05")).collect()}
    assert snap["Untitled"].Priority == "None" and str(snap["One"].Date) == "2024-01-05"


def test_overdue_policies(spark):
    rows = [("2024-01-04", None), ("2024-01-05", "In progress"), ("2024-01-05T13:00:00", "x"), ("2024-01-04", "Done"), ("2024-01-04", "Archived"), ("2024-01-04", "Rejected – hold"), (None, None), ("bad", "x")]
    df = spark.createDataFrame(rows, "due string, status string")
    now = F.lit("2024-01-05 12:00:00").cast("timestamp")
    got = df.select(*(predicates.overdue(F.col("status"), F.col("due"), now, p).alias(n) for n, p in OVERDUE.items()), predicates.due_today(F.col("due"), now).alias("today")).collect()
    by = {n: [r[n] for r in got] for n in (*OVERDUE, "today")}
    assert by["metrics"] == [True, False, False, False, True, False, False, False]
    assert by["digest"] == [True, False, False, False, False, True, False, False]
    assert by["guardian"] == [True, True, True, False, False, True, False, False]
    assert by["manager"] == [True, True, False, False, True, True, False, False]
    assert by["today"] == [False, True, True] + [False] * 5


def test_metrics_and_digest(spark, tmp_path):
    rows = [(1, "A", "Done", "2024-01-01"), (2, "B", "In progress", "2024-01-01"), (3, None, "Waiting", "2024-01-05"), (4, "D", "odd", None), (5, "E", "Overdue", None)]
    df = spark.createDataFrame(rows, "id int, title string, status string, due string")
    now = F.lit("2024-01-05").cast("timestamp")
    v = metrics.metrics_vector(df, now).first().asDict()
    assert (v["Done"], v["In progress"], v["Overdue"], v["Waiting"], v["In review"]) == (1, 1, 2, 1, 0)
    writers.write_digest(metrics.digest_lines(df, now, "Waiting"), str(tmp_path / "digest"))
    text_of = lambda: "".join(f.read_text() for f in sorted((tmp_path / "digest").glob("part-*")))
    assert text_of() == "Daily Task Summary for 2024-01-05\n\nOverdue:\n- B (was due 2024-01-01)\n\nDue Today:\n- Untitled\n\nWaiting on Waiting:\n- Untitled\n"
    writers.write_digest(metrics.digest_lines(df.limit(0), now, "Waiting"), str(tmp_path / "digest"))
    assert text_of() == "Daily Task Summary for 2024-01-05\n\nOverdue:\nNone\n\nDue Today:\nNone\n\nWaiting on Waiting:\nNone\n"
    pivot = metrics.weekly_pivot(df.withColumn("day", F.to_date("due")), "day", "status", ["Done", "Waiting"]).collect()
    assert {(str(r.Week), r.Done, r.Waiting) for r in pivot if r.Week} == {("2024-01-01", 1, 1)}
    assert [r["count"] for r in metrics.value_counts(df, "status").collect()] == [1] * 5


def test_updates_and_payloads(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 5)], "id int, s string, nudges int")
    up = spark.createDataFrame([(2, 7), (2, 9), (3, None)], "id int, nudges int")
    assert [(r.id, r.nudges) for r in actions.keyed_update(rows, up, "id").orderBy("id").collect()] == [(1, 1), (2, 9), (3, 5)]
    payload = json.loads(rows.limit(1).select(actions.escalation_payload(F.col("nudges")).alias("p")).first().p)
    assert payload["properties"] == {"Escalation flag": {"checkbox": True}, "Nudge count": {"number": 2}}
    full = json.loads(spark.range(1).select(actions.page_payload(F.lit("t"), F.lit("python"), F.lit("2024-01-01"), F.lit("ftp"), "due").alias("p")).first().p)
    assert full["properties"]["Due"]["date"]["start"] == "2024-01-04" and full["properties"]["Doc Link"] == {}
    mail = json.loads(spark.range(1).select(actions.mail_payload(F.lit("to"), F.lit("s"), F.lit("é?>"), F.lit("/x/y.csv")).alias("p")).first().p)
    assert mail["filename"] == "y.csv" and "+" not in mail["raw"] and "/" not in mail["raw"]


def test_csv_round_trip_and_history(spark, tmp_path):
    rows = [("2024-01-01", " a, \"b\" ", "x", None, "None"), ("2024-01-02", " é", "y", "2024-01-01", "High")]
    df = spark.createDataFrame(rows, "d string, Task string, Status string, Due string, Priority string").select(F.to_date("d").alias("Date"), "Task", "Status", "Due", "Priority")
    writers.export_csv(df, str(tmp_path / "csv"))
    back = readers.csv_table(spark, str(tmp_path / "csv"), schemas.SNAPSHOT)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    writers.append_history(df, str(tmp_path / "h"))
    writers.append_history(df, str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h"))
    assert history.count() == 4
    assert predicates.latest_alerts(history, "Date", predicates.snapshot_alert()).count() == 2
    assert not writers.write_errors(spark.createDataFrame([], schemas.ERRORS), str(tmp_path / "e")) and not (tmp_path / "e").exists()


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"id": "b", "properties": {}}, {"id": "a", "properties": {"Status": {"status": {"name": "Done"}}}}]}))
    assert [r.id for r in readers.task_pages(spark, str(tmp_path / "p.json"), limit=1).collect()] == ["a"]
    (tmp_path / "q.json").write_text("{oops")
    assert readers.task_pages(spark, str(tmp_path / "q.json"), on_error="empty").count() == 0
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.task_pages(spark, str(tmp_path / "q.json")).count()
    (tmp_path / "r.json").write_text('{"object": "error"}')
    assert readers.task_pages(spark, str(tmp_path / "r.json")).count() == 0
    with pytest.raises(Exception, match="a response has no results"):
        readers.task_pages(spark, str(tmp_path / "r.json"), missing="raise").collect()
    assert readers.task_pages(spark, str(tmp_path / "p.json"), missing="raise").count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"properties": {"P": {"type": "select", "select": {"options": [{"name": "x"}, {"name": "y"}]}}, "T": {"type": "title"}}}))
    assert sorted((r.property, r.option or "") for r in readers.database_schema(spark, str(tmp_path / "s.json")).collect()) == [("P", "x"), ("P", "y"), ("T", "")]
    assert readers.attachments(spark, str(tmp_path / "s.json")).count() == 1
    assert readers.attachments(spark, str(tmp_path / "none.json")).count() == 0
    mails = flatten.mail_tasks(spark.createDataFrame([(" S ", "<p>due: 2024-01-01 urgent low</p>")], schemas.HTML_MAIL)).first()
    assert (mails["Task name"], mails.Due, mails.Tags, mails.Priority) == ("S", "2024-01-01", ["urgent"], "Low")


def test_attachments_that_exist_travel(spark, tmp_path):
    (tmp_path / "log.csv").write_bytes(b"a,b\n")
    mails = spark.createDataFrame([(1, str(tmp_path / "log.csv")), (2, str(tmp_path / "gone.csv")), (3, None)], "id int, path string")
    rows = actions.with_attachments(mails, readers.attachments(spark, str(tmp_path / "*.csv")))
    got = rows.select("id", actions.mail_payload(F.lit("t"), F.lit("s"), F.lit("b"), filename=F.col("filename"), data=F.col("data")).alias("p")).collect()
    payloads = {r.id: json.loads(r.p) for r in got}
    assert (payloads[1]["filename"], payloads[1]["data"]) == ("log.csv", "YSxiCg==")
    assert all("filename" not in payloads[k] and "data" not in payloads[k] and payloads[k]["to"] == "t" for k in (2, 3))


def test_delivery(spark):
    box = spark.createDataFrame([(k, "chat", "c", f"text {k}") for k in "abcde"], schemas.OUTBOX)
    at = lambda n: datetime.datetime(2024, 1, 1, 0, n)
    reports = [("a", at(1), 200, None), ("b", at(2), 500, None), ("b", at(1), 200, "x"), ("c", at(1), None, None), ("c", at(5), 200, None), ("d", at(1), None, None), ("zz", at(1), 200, None)]
    status = delivery.delivery_status(box, spark.createDataFrame(reports, schemas.REPORT))
    assert sorted(tuple(r)[0:1] + tuple(r)[4:] for r in status.collect()) == [("a", "sent", 1, None), ("b", "failed", 2, "code 500"), ("c", "sent", 2, "no response"), ("d", "failed", 1, "no response"), ("e", "pending", 0, None)]
    assert sorted(map(tuple, delivery.dead_letters(status, "chat").collect())) == [("b", "chat error: code 500 | Message: text b"), ("d", "chat error: no response | Message: text d")]
    assert delivery.dead_letters(status, "mail").count() == 0
    assert {r.key for r in delivery.due_again(status, most=2).collect()} == {"d", "e"}
    none = delivery.delivery_status(box.limit(0), spark.createDataFrame([], schemas.REPORT))
    assert none.count() == 0 and none.columns == [*box.columns, "state", "attempts", "error"]


def test_snippet_agent(spark):
    rows = [{**_message("1", ""), "snippet": "Kindly WRITE a memo today"}, {**_message("2", ""), "snippet": "hello"}, {**_message("3", "", unread=False), "snippet": "write a memo"}, {**_message("4", ""), "snippet": None}]
    df = spark.read.schema(schemas.MESSAGE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    out = agent.snippet_effects(df, Settings(agent="Agent"), "write a memo", "T", "C", "memo and log").collect()
    by = {r.channel: r for r in out}
    assert len(out) == 3 and json.loads(by["document"].payload)["insert"]["text"] == "C" and str(by["mail"].day) == "2024-01-01"
    page = json.loads(by["page"].payload)["properties"]
    assert page["Task"]["rich_text"][0]["text"]["content"] == "memo and log" and page["Document"]["url"] == "document:" + by["document"].key


def _message(i, body, unread=True, received="2024-01-01T00:00:00"):
    import base64

    return {"id": i, "sender": "s@x", "recipient": "r@x", "unread": unread, "received": received, "snippet": "", "headers": [{"name": "Subject", "value": " Sub "}], "parts": [{"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(body.encode()).decode()}}]}


def test_agent_is_idempotent(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    lines = [_message("1", "Title: t\nContent: python"), _message("2", "all Done"), _message("3", "x", unread=False)]
    (inbox / "a.json").write_text("\n".join(map(json.dumps, lines)))
    run = lambda c: agent.run_agent(agent.message_stream(spark, str(inbox)), Settings(), str(tmp_path / "out"), str(tmp_path / "err"), str(tmp_path / c)).awaitTermination(60)
    run("c1")
    (inbox / "b.json").write_text(json.dumps(lines[0]))
    run("c1")
    run("c2")  # a lost checkpoint: everything again
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.channel for r in out.collect()) == ["document", "mail", "page"]


def test_nudge_state(spark, tmp_path):
    src = tmp_path / "late"
    src.mkdir()
    (src / "1.json").write_text('{"id": "a"}\n{"id": "b"}\n{"id": "a"}')
    got = []
    stream = agent.nudge_counts(spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).json(str(src)))
    run = lambda: stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, n: got.append({r.id: r.nudges for r in df.collect()})).start().awaitTermination(90)
    run()
    (src / "2.json").write_text('{"id": "a"}')
    run()
    assert got[0] == {"a": 2, "b": 1} and got[-1] == {"a": 3}


def test_settings_and_stamp(spark):
    assert Settings.from_env({"SENDER_EMAIL": "x"}).sender == "x"
    assert spark.range(1).select(text.stamp_text(F.lit("2024-01-02 03:04:05").cast("timestamp"))).first()[0] == "20240102-030405"
