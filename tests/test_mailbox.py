"""The mailbox source, the transactional sink and dead letters with their raw text."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.config import Settings
from tallyspark.operators import flatten
from tallyspark.sources import committed, mailbox, writers
from tallyspark.streaming import agent
from test_tasks import _message


def arrive(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder.parent / name).write_text("\n".join(lines))
    os.rename(folder.parent / name, folder / name)


def run(messages, tmp_path, checkpoint, batch=None):
    """Run the agent once; ``batch`` replaces what it does with a batch."""
    if batch is None:
        query = agent.run_agent(messages, Settings(), str(tmp_path / "out"), str(tmp_path / "err"), str(tmp_path / checkpoint))
    else:
        query = messages.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(100)
    return query


def effects(spark, tmp_path):
    return sorted((r.key, r.channel) for r in writers.ledger(spark, str(tmp_path / "out"), writers.EFFECT).collect())


def test_a_kill_between_batch_and_commit(spark, tmp_path):
    box = tmp_path / "in"
    arrive(box, "a.json", *(json.dumps(_message(str(k), f"Title: t{k}")) for k in range(3)))
    arrive(box, "b.json", json.dumps(_message("3", "Title: t3")), "")

    seen = []

    def killed(rows, number):
        """Writes the batch and dies before Spark learns that it is done."""
        seen.append(sorted(r.id for r in rows.collect()))
        good = rows.filter("error IS NULL").drop("error", "raw", "file", "position")
        writers.add_to_outbox(agent.command_effects(good, Settings()), str(tmp_path / "out"))
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(agent.mailbox_stream(spark, str(box)), tmp_path, "c", killed)
    first = effects(spark, tmp_path)
    assert seen == [["0", "1", "2", "3"]] and len(first) == 12
    assert sorted(os.listdir(box / "_journal")) == ["0" * 20] and not (box / "_read").exists()

    arrive(box, "c.json", json.dumps(_message("4", "Title: t4")))  # arrives before the replay, which must not have it

    def replay(rows, number):
        seen.append((number, sorted(r.id for r in rows.collect())))
        agent_rows = rows.filter("error IS NULL").drop("error", "raw", "file", "position")
        writers.add_to_outbox(agent.command_effects(agent_rows, Settings()), str(tmp_path / "out"))

    for _ in range(3):  # the replay, what has come since, and nothing
        run(agent.mailbox_stream(spark, str(box)), tmp_path, "c", replay)
    assert seen[1:] == [(0, ["0", "1", "2", "3"]), (1, ["4"])]
    assert len(effects(spark, tmp_path)) == 15 and set(first) < set(effects(spark, tmp_path))
    assert sorted(os.listdir(box / "_read")) == ["a.json", "b.json"]  # acknowledged with the next batch
    run(agent.mailbox_stream(spark, str(box)), tmp_path, "other", replay)  # what is read isn't read again; c.json is still unread
    assert seen[3:] == [(0, ["4"])] and len(effects(spark, tmp_path)) == 15


def test_polls_take_so_many_files(spark, tmp_path):
    box = tmp_path / "in"
    for k in range(5):
        arrive(box, f"{k}.json", json.dumps(_message(str(k), "x")))
    reader = mailbox._Reader(str(box), 2)
    start, ends = reader.initialOffset(), []
    for _ in range(4):
        ends.append(reader.latestOffset())
    assert start == {"entry": 0} and ends == [{"entry": 1}, {"entry": 2}, {"entry": 3}, {"entry": 3}]
    names = lambda a, b: [n for p in reader.partitions({"entry": a}, {"entry": b}) for n in p.names]
    assert names(0, 1) == ["0.json", "1.json"] and names(1, 3) == ["2.json", "3.json", "4.json"] and names(3, 3) == []
    reader.commit({"entry": 2})
    assert mailbox._Reader(str(box), None).initialOffset() == {"entry": 2} and sorted(os.listdir(box / "_read")) == ["0.json", "1.json", "2.json", "3.json"]
    again = mailbox._Reader(str(box), None)
    assert again.latestOffset() == {"entry": 3} and names(2, 3) == ["4.json"]
    rows = [r for p in again.partitions({"entry": 2}, {"entry": 3}) for b in again.read(p) for r in b.to_pylist()]
    assert [(r["file"], r["position"], json.loads(r["value"])["id"]) for r in rows] == [("4.json", 0, "4")]
    assert mailbox._Reader(str(tmp_path / "none"), None).latestOffset() == {"entry": 0}


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_lines_of_any_length(tmp_path, monkeypatch, size):
    monkeypatch.setattr(mailbox, "BATCH_BYTES", size)
    text = "one\r\n\n" + "long " * 20 + "\n  \nübrig"
    arrive(tmp_path / "in", "a", text)
    rows = [r for b in mailbox._Reader(str(tmp_path / "in"), None).read(mailbox.Files(("a",))) for r in b.to_pylist()]
    assert [(r["position"], r["value"]) for r in rows] == [(0, "one"), (2, "long " * 20), (4, "übrig")]


@pytest.mark.parametrize("source", [agent.mailbox_stream, agent.record_stream])
def test_six_dead_letters(spark, tmp_path, source):
    box, nameless = tmp_path / "in", json.dumps({**_message("x", "y"), "id": None})
    arrive(box, "a.json", "{broken", json.dumps(_message("1", "Title: t")), nameless, "{broken", nameless, "[1", nameless)
    for checkpoint in ("c1", "c2"):  # the second time with a lost checkpoint
        run(source(spark, str(box)), tmp_path, checkpoint)
        got = writers.letters_in(spark, str(tmp_path / "err")).collect()
        assert sorted((r.task_id, r.error, r.raw) for r in got) == sorted([("", "malformed record", "{broken")] * 2 + [("", "malformed record", "[1")] + [("", "message without id", nameless)] * 3)
        assert len(effects(spark, tmp_path)) == 3


def test_good_messages_are_told_apart_after_the_split(spark, tmp_path):
    box = tmp_path / "in"
    arrive(box, "a.json", "{broken", json.dumps(_message("1", "a")), json.dumps(_message("1", "a")), '{"id": " "}', "{broken")
    got = []
    query = agent.message_stream(spark, str(box)).writeStream.foreachBatch(lambda rows, n: got.extend(rows.collect()))
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(100)
    assert [r.id for r in got] == ["1"]
    rows = flatten.parse_messages(spark.createDataFrame([("{broken",), (None,), ("  ",), ('{"id": ""}',), (json.dumps(_message("5", "a")),)], "value string"))
    good, bad = flatten.split_errors(rows)
    assert [r.id for r in good.collect()] == ["5"] and sorted((r.error, r.raw) for r in bad.filter("raw IS NOT NULL").collect()) == [("empty record", "  "), ("malformed record", "{broken"), ("message without id", '{"id": ""}')]


def shown(spark, path):
    return sorted((r.a, r.kind, r.day) for r in spark.read.schema("a long, commit string, kind string, day date").parquet(path).collect())


def test_committed_writes(spark, tmp_path):
    committed.register(spark)
    path, day = str(tmp_path / "t"), datetime.date(2024, 1, 1)
    os.mkdir(path)
    rows = spark.range(100).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, "x/ü").otherwise("y").alias("kind"), F.when(F.col("id") % 2 == 0, F.lit(day)).alias("day")).repartition(4)
    write = lambda df, **more: df.write.format("committed").options(path=path, partitionBy="kind,day", **more).mode("append").save()

    def breaking(batches):
        for batch in batches:
            yield batch
            if 97 in batch["a"].to_pylist():
                raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):  # other tasks have written their files by then
        write(rows.repartition(8, "a").mapInArrow(breaking, rows.schema), commit="n")
    assert shown(spark, path) == [] and not [f for f in os.listdir(path) if not f.startswith("_")]
    want = sorted((k, "y" if k % 3 else "x/ü", None if k % 2 else day) for k in range(100))
    key = lambda r: (r[0], r[1], str(r[2]))
    for _ in range(2):  # the second is a replay
        write(rows, commit="n")
        assert sorted(shown(spark, path), key=key) == sorted(want, key=key)
    for f in os.listdir(f"{path}/_staging"):
        os.utime(f"{path}/_staging/{f}", (0, 0))
    write(rows.limit(0), commit="m")
    assert not os.listdir(f"{path}/_staging")
    write(rows.limit(1))
    assert len(shown(spark, path)) == 101
    with pytest.raises(Exception, match="only append"):
        rows.write.format("committed").option("path", path).mode("overwrite").save()


def test_effects_and_reports_together(spark, tmp_path):
    path, at = str(tmp_path / "box"), datetime.datetime(2024, 1, 2, 3)
    day = at.date()
    box = spark.createDataFrame([("k1", "chat", "t", "p", day), ("k2", "chat", "t", "p", None), ("k2", "chat", "t", "p", None)], f"{schemas.OUTBOX}, day date")
    reports = spark.createDataFrame([("k1", at, 500, "x"), ("k1", at, 500, "x"), ("k2", None, None, None)], schemas.REPORT)

    def lost(batches):
        for batch in batches:
            raise RuntimeError("lost")
            yield batch

    with pytest.raises(Exception, match="lost"):
        writers.add_to_outbox(box, path, reports.mapInArrow(lost, reports.schema))
    assert writers.ledger(spark, path, writers.EFFECT).count() == 0 == writers.ledger(spark, path, writers.REPORT).count()
    for _ in range(3):
        writers.add_to_outbox(box, path, reports)
        assert sorted(map(tuple, writers.ledger(spark, path, writers.EFFECT).collect())) == [("k1", "chat", "t", "p", day), ("k2", "chat", "t", "p", None)]
        assert sorted(map(tuple, writers.ledger(spark, path, writers.REPORT).collect())) == [("k1", at, 500, "x", day), ("k2", None, None, None, None)]
    assert len([d for d in os.listdir(path) if d.startswith("commit=")]) == 1
    writers.add_to_outbox(box.limit(0), path, reports.limit(0))
    of_day = writers.ledger(spark, path, writers.EFFECT, (day, day))
    assert [r.key for r in of_day.collect()] == ["k1"]
    pruned = of_day._jdf.queryExecution().toString().split("PartitionFilters:")[1].split("DataFilters")[0]
    assert "kind" in pruned and "month" in pruned


def test_committed_stream(spark, tmp_path):
    mailbox.register(spark)
    committed.register(spark)
    box = tmp_path / "in"
    for k, name in enumerate("ab"):
        arrive(box, name, *(str(k * 10 + j) for j in range(3)))
        stream = spark.readStream.format("mailbox").option("path", str(box)).load().select(F.col("value").cast("long").alias("a"))
        for _ in range(2):
            query = stream.writeStream.format("committed").option("path", str(tmp_path / "t")).option("commit", "s").option("checkpointLocation", str(tmp_path / "c"))
            query.trigger(availableNow=True).start().awaitTermination(100)
    rows = spark.read.schema("a long, commit string").parquet(str(tmp_path / "t")).collect()
    assert sorted((r.a, r.commit[-1]) for r in rows) == [(0, "0"), (1, "0"), (2, "0"), (10, "1"), (11, "1"), (12, "1")]


def test_rounds_of_delivery(spark, tmp_path):
    """One record's failure is its own; a lost commit repeats the attempts and adds each report once."""
    from tallyspark.operators import delivery

    path = str(tmp_path / "box")
    box = spark.createDataFrame([(f"k{k}", "chat" if k else "mail", "t", str(k), None) for k in range(6)], f"{schemas.OUTBOX}, day date")
    writers.add_to_outbox(box, path)

    def connector(effect):
        if effect["payload"] == "1":
            raise ValueError("no such page")
        return (200, None) if effect["payload"] != "2" or effect["attempts"] else (503, "later")

    state = lambda: {r.key: (r.state, r.attempts, r.error) for r in delivery.delivery_status(writers.ledger(spark, path, writers.EFFECT), writers.ledger(spark, path, writers.REPORT).drop("day")).collect()}
    agent.deliver(spark, path, connector, F.lit("2024-01-01 00:00:00"), 3, "chat")
    assert state() == {"k0": ("pending", 0, None), "k1": ("failed", 1, "ValueError: no such page"), "k2": ("failed", 1, "later"), **{f"k{k}": ("sent", 1, None) for k in (3, 4, 5)}}
    for _ in range(2):  # the same round again: the reports it has are there already
        reports = delivery.attempts(box.withColumn("attempts", F.lit(0)).filter("key = 'k1'"), connector, F.lit("2024-01-01 00:00:00"))
        writers.add_to_outbox(box.limit(0), path, reports)
    assert state()["k1"] == ("failed", 1, "ValueError: no such page")
    for k in range(1, 5):
        agent.deliver(spark, path, connector, F.lit(f"2024-01-01 00:0{k}:00"))
    assert state() == {"k0": ("sent", 1, None), "k1": ("failed", 3, "ValueError: no such page"), "k2": ("sent", 2, "later"), **{f"k{k}": ("sent", 1, None) for k in (3, 4, 5)}}


def test_reports_of_other_rounds_are_not_compared(spark, tmp_path):
    """An equal report has an equal time, so only reports of the new ones' times are read to find those that are there."""
    ledger, at = str(tmp_path / "ledger"), lambda n: datetime.datetime(2024, 1, 1, 0, n)
    told = lambda *rows: spark.createDataFrame([(*r, datetime.date(2024, 1, 1)) for r in rows], f"{schemas.REPORT}, day date")
    effects = spark.createDataFrame([], f"{schemas.OUTBOX}, day date")
    writers.add_to_outbox(effects, ledger, told(("a", at(1), 500, None), ("b", None, None, "x")))
    new = told(("a", at(1), 500, None), ("a", at(2), 500, None), ("a", at(2), 500, None), ("b", None, None, "x"), ("c", None, None, "x"))
    apart = writers._known_apart(writers._entries(new, writers.REPORT), ledger, writers.REPORT, ["key", "at", "code", "error"])
    assert sorted((r.key, r["at"]) for r in apart.collect()) == [("a", at(2)), ("c", None)]
    later = writers._known_apart(writers._entries(told(("a", at(2), 500, None)), writers.REPORT), ledger, writers.REPORT, ["key", "at", "code", "error"])
    assert ">= 2024-01-01 00:02:00" in later._jdf.queryExecution().optimizedPlan().toString()
