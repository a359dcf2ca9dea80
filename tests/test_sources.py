"""Responses with pushed filters, property bags, tables updated in place, histories read once, single files, supervised polls."""

import base64
import csv
import datetime
import hashlib
import io
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.functions import bags
from tallyspark.operators import actions, delivery
from tallyspark.sources import history, keyed, mailbox, readers, responses, writers
from tallyspark.streaming import supervised

DAY = datetime.date


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture
def captured(spark, tmp_path):
    page = lambda k: {"id": f"p{k}", "last_edited_time": f"2024-01-{k:02d}", "properties": {"N": {"number": k}}}
    for n in range(4):
        (tmp_path / f"r{n}.json").write_text(json.dumps({"results": [page(5 * n + k) for k in range(5)]}))
    responses.register(spark)
    return tmp_path


def test_responses(spark, captured):
    read = lambda **more: spark.read.format("responses").options(path=str(captured), **more).load()
    assert read().count() == 20 and read().rdd.getNumPartitions() == 4
    wanted = read().filter("response = 'r2.json' AND edited >= '2024-01-12' AND length(page) > 3")
    pushed, rest = plan(wanted).split("PushedFilters: [")[1].split("]", 1)
    assert "EqualTo(response,r2.json)" in pushed and "GreaterThanOrEqual(edited,2024-01-12)" in pushed
    assert "length(page" in rest and "edited" not in rest.split("Condition :")[1].split("\n")[0]  # what isn't pushed stays
    assert sorted(r.id for r in wanted.collect()) == ["p12", "p13", "p14"] and wanted.rdd.getNumPartitions() == 1
    assert sorted(r.id for r in read().filter(F.col("id").isin("p3", "p17", "zz")).collect()) == ["p17", "p3"]
    assert [r.id for r in read(limit=1).orderBy("response").collect()] == ["p0", "p5", "p10", "p15"]


def test_many_responses_share_partitions(spark, tmp_path):
    """Tasks don't grow with the number of files; limits, broken responses and names stay those of a file."""
    for n in range(1000):
        (tmp_path / f"r{n:04d}.json").write_text("{oops" if n % 10 == 3 else json.dumps({"results": [{"id": f"{n}-{k}", "last_edited_time": str(n)} for k in range(3)]}))
    responses.register(spark)
    read = spark.read.format("responses").options(path=str(tmp_path), onError="empty", limit=2).load()
    assert read.rdd.getNumPartitions() == 250
    want = sorted((f"r{n:04d}.json", f"{n}-{k}", str(n)) for n in range(1000) if n % 10 != 3 for k in range(2))
    assert sorted(tuple(r) for r in read.select("response", "id", "edited").collect()) == want
    assert read.filter("edited IS NULL").count() == 0
    with pytest.raises(Exception, match="isn't JSON: .*r0..3.json"):
        spark.read.format("responses").option("path", str(tmp_path)).load().collect()


def test_responses_that_are_none(spark, captured):
    (captured / "x.json").write_text('{"object": "error"}')
    read = lambda **more: spark.read.format("responses").options(path=str(captured), **more).load()
    assert read().count() == 20
    with pytest.raises(Exception, match="has no results"):
        read(missing="raise").collect()
    (captured / "x.json").write_text("{oops")
    with pytest.raises(Exception, match="isn't JSON"):
        read().collect()
    assert read(onError="empty").count() == 20
    with pytest.raises(Exception, match="raise or empty"):
        read(onError="skip").collect()
    assert spark.read.format("responses").option("path", str(captured / "none")).load().count() == 0


def test_bags_of_unknown_kinds(spark):
    props = {
        "N": {"number": 3}, "F": {"id": "x", "type": "formula", "formula": {"type": "string", "string": "abc"}}, "S": {"select": {"name": "High"}}, "M": {"multi_select": [{"name": "a"}, {"name": "b"}]},
        "T": {"title": [{"text": {"content": "hi"}}, {"plain_text": "you"}]}, "U": {"unique_id": {"prefix": "A", "number": 3}}, "C": {"checkbox": True}, "Z": {"date": None}, "D": {"date": {"start": "2024-01-01"}}, "R": {"relation": []}, "W": 5,
    }
    df = spark.createDataFrame([(1, json.dumps({"id": "a", "properties": props})), (2, "{bro"), (3, "{}"), (4, None), (5, '{"properties": {"N": {"rollup": {"x": 1}}}}')], "k int, page string")
    got = {(r.k, r.property): (r.kind, r.value) for r in bags.properties(df, "page", "k").collect()}
    assert got == {
        (1, "N"): ("number", "3"), (1, "F"): ("formula", '{"string":"abc","type":"string"}'), (1, "S"): ("select", "High"), (1, "M"): ("multi_select", "a, b"), (1, "T"): ("title", "hi, you"), (1, "U"): ("unique_id", '{"number":3,"prefix":"A"}'),
        (1, "C"): ("checkbox", "true"), (1, "Z"): ("date", None), (1, "D"): ("date", "2024-01-01"), (1, "R"): ("relation", ""), (1, "W"): (None, None), (5, "N"): ("rollup", '{"x":1}'),
    }
    assert {(r.property, r.kind): r.n for r in bags.listed_kinds(df.filter("k IN (1, 5)")).collect()}["N", "rollup"] == 1


def files(path):
    return {f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_updates_in_place(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, status string, nudges long"
    rows = spark.createDataFrame([(f"k{k}", "open", k if k % 3 else None) for k in range(200)] + [(None, "open", 1)], schema)
    keyed.create(rows, path, "id", 16)
    before = files(path)
    updates = spark.createDataFrame([("k3", None, 9), ("k3", None, 4), ("k7", "done", None), ("none", "x", 1), (None, "x", 1)], schema)
    want = {r.id: (r.status, r.nudges) for r in actions.keyed_update(rows, updates.filter("id IS NOT NULL"), "id").collect()}
    touched = keyed.update(spark, path, schema, updates, "id", 16)
    assert 1 <= touched <= 3
    assert {r.id: (r.status, r.nudges) for r in keyed.read(spark, path, schema).collect()} == want and keyed.read(spark, path, schema).count() == 201
    folder = lambda f: f.split("bucket=")[1].split("/")[0]
    after = files(path)
    assert {folder(f) for f in before - after} == {folder(f) for f in after - before} and len({folder(f) for f in before - after}) == touched
    assert keyed.update(spark, path, schema, updates.limit(0), "id", 16) == 0 and files(path) == after
    assert sorted(os.listdir(tmp_path)) == ["t"]


def test_history_is_read_once(spark, tmp_path):
    path, sums, schema = str(tmp_path / "h"), str(tmp_path / "s"), "Task string, Status string, Date date"
    rows = lambda day, *statuses: spark.createDataFrame([(f"t{k}", s, day) for k, s in enumerate(statuses)], schema)
    for day, statuses in ((DAY(2024, 1, 1), ("Done", "Open")), (DAY(2024, 1, 3), ("Done", None)), (DAY(2024, 1, 9), ("Open", "Late", "Late")), (None, ("Done",))):
        history.append(rows(day, *statuses), path, sums, "Date", "Status", schema)
    late = history.of_latest_day(spark, path, schema, "Date", F.col("Status") == "Late")
    assert [r.Task for r in late.orderBy("Task").collect()] == ["t1", "t2"]
    assert late.inputFiles() and {f.split("Date=")[1].split("/")[0] for f in late.inputFiles()} >= {"2024-01-09"} and "Date" in plan(late).split("PartitionFilters:")[1].split("]")[0]
    weekly = lambda: {str(r.Week): (r.Done, r.Late, r.Open) for r in history.weekly(spark, sums, "Date", "Status", ("Done", "Late", "Open")).filter("Week IS NOT NULL").collect()}
    assert weekly() == {"2024-01-01": (2, 0, 1), "2024-01-08": (0, 2, 1)}
    before = files(sums)
    history.append(rows(DAY(2024, 1, 9), "Done"), path, sums, "Date", "Status", schema)
    assert weekly() == {"2024-01-01": (2, 0, 1), "2024-01-08": (1, 2, 1)}
    assert {f.split("Date=")[1][:10] for f in before ^ files(sums)} == {"2024-01-09"}
    assert history.days(spark, str(tmp_path / "none"), "Date") == [] and history.days(spark, path, "Date") == ["2024-01-01", "2024-01-03", "2024-01-09"]


def test_one_file_with_one_header(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    rows = spark.range(1000).repartition(7).select(F.col("id").alias("_id"), F.concat(F.lit('a "b", '), "id").alias("Title"), F.when(F.col("id") % 2 == 0, "x\ny").alias("Needs Review"))
    for _ in range(2):
        writers.export_csv_file(rows, path, "_id")
    got = list(csv.reader(io.StringIO((tmp_path / "log.csv").read_text())))
    assert got == [["Title", "Needs Review"]] + [[f'a "b", {k}', "x\ny" if k % 2 == 0 else ""] for k in range(1000)]
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["log.csv"]
    mails = spark.createDataFrame([(path,)], "path string")
    found = actions.with_attachments(mails, readers.attachments(spark, path)).first()
    assert found.filename == "log.csv" and base64.b64decode(found.data) == (tmp_path / "log.csv").read_bytes()


def test_counts_of_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "bad"), ("c", None)], "id string, error string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("split", "")
    assert writers.write_split(rows, str(tmp_path / "t")) == {"good": 2, "bad": 1}
    assert len(tracker.getJobIdsForGroup("split")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.read.parquet(str(tmp_path / "t")).filter("kind = 'bad'").first().id == "b"
    errors = rows.filter("error IS NOT NULL").select(F.col("id").alias("task_id"), "error")
    assert writers.write_errors(errors, str(tmp_path / "e")) and not writers.write_errors(errors.limit(0), str(tmp_path / "f"))
    assert os.path.isdir(tmp_path / "e") and not os.path.exists(tmp_path / "f")


def test_supervised_poll(spark, tmp_path):
    mailbox.register(spark)
    box, left, seen = tmp_path / "in", [2], []
    box.mkdir()
    (box / "a").write_text("one\n")

    def batch(rows, number):
        got = [r.value for r in rows.collect()]
        if left[0]:
            left[0] -= 1
            raise RuntimeError("no connection")
        seen.extend(got)

    def start():
        stream = spark.readStream.format("mailbox").option("path", str(box)).load()
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    at = iter(datetime.datetime(2024, 1, 1, 0, k) for k in range(20))
    ledger = str(tmp_path / "ledger")
    assert supervised.supervise(spark, "mail", start, ledger, clock=lambda: next(at)) == 3 and seen == ["one"]
    reports = writers.ledger(spark, ledger, writers.REPORT).drop("day")
    assert sorted(r.code for r in reports.collect()) == [200, 500, 500]
    status = delivery.delivery_status(writers.ledger(spark, ledger, writers.EFFECT), reports).first()
    assert (status.target, status.state, status.attempts) == ("mail", "sent", 3) and status.error
    left[0] = 99
    (box / "b").write_text("two\n")
    with pytest.raises(Exception, match="no connection"):
        supervised.supervise(spark, "mail", start, ledger, most=2, clock=lambda: next(at))
    assert left[0] == 97 and writers.ledger(spark, ledger, writers.REPORT).count() == 5


def test_timed_trigger(spark, tmp_path):
    """The agent's own trigger by time takes what is there and goes on."""
    import time

    from test_mailbox import arrive
    from test_tasks import _message

    from tallyspark.config import Settings
    from tallyspark.streaming import agent

    arrive(tmp_path / "in", "a.json", json.dumps(_message("1", "Title: t")))
    query = agent.run_agent(agent.mailbox_stream(spark, str(tmp_path / "in"), 1), Settings(), str(tmp_path / "out"), str(tmp_path / "err"), str(tmp_path / "c"), once=False)
    try:
        end = time.time() + 90
        while time.time() < end and writers.ledger(spark, str(tmp_path / "out"), writers.EFFECT).count() < 3:
            time.sleep(1)
        assert query.isActive and writers.ledger(spark, str(tmp_path / "out"), writers.EFFECT).count() == 3
    finally:
        query.stop()
    assert schemas.REPORT


def test_attachments_of_any_length(spark, tmp_path):
    """A log whose base64 text has more than 20,000,000 characters, and parts of small, empty and missing files."""
    from tallyspark.plans import queries

    con = duckdb.connect()
    con.sql(f"COPY (SELECT o.* REPLACE (o_orderkey + 1000000 * k AS o_orderkey) FROM '/root/testdata/sf0.001/orders.parquet' o, range(230) t(k)) TO '{tmp_path}/orders.parquet'")
    con.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet'")
    assert sorted(map(tuple, queries.task_log_mail(spark, str(tmp_path)).collect())) == sorted(con.sql(queries.ORACLE_SQL["task_log_mail"]).fetchall())

    (tmp_path / "a.csv").write_bytes(b"0123456789")
    (tmp_path / "b.csv").write_bytes(b"")
    mails = spark.createDataFrame([(k, p and f"{tmp_path}/{p}.csv") for k, p in enumerate(("a", "b", "gone", None, "a"))], "mail int, path string")
    rows = readers.with_part_contents(actions.with_attachment_parts(mails, readers.attachment_files(spark, f"{tmp_path}/*.csv"), size=3), size=3)
    got = sorted(tuple(r) for r in rows.select("mail", "filename", "part", "parts", "content").collect())
    a = [("a.csv", k, 4, bytearray(b"0123456789"[3 * k : 3 * k + 3])) for k in range(4)]
    assert got == [(0, *r) for r in a] + [(1, "b.csv", 0, 1, bytearray())] + [(2, None, None, None, None), (3, None, None, None, None)] + [(4, *r) for r in a]
    digests = {r.mail: r.sha256 for r in actions.part_digests(rows, "mail", "part", "content").collect()}
    whole = hashlib.sha256(b"0123456789").hexdigest()
    assert digests == {0: whole, 1: hashlib.sha256(b"").hexdigest(), 2: None, 3: None, 4: whole}
