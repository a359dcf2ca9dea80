"""The queries of task analytics by name, and the same results in SQL.

Tasks are a view of ``orders``, daily history one of ``events``, mail one of ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.config import OVERDUE, Settings
from tallyspark.functions import bags, text
from tallyspark.operators import actions, delivery, flatten, metrics, predicates
from tallyspark.sources import history, keyed, mailbox, readers, responses, writers
from tallyspark.streaming import agent, supervised

AS_OF = "1998-06-15 12:00:00"
#: Days of the wide history.
WIDE_DAYS = ("1995-03-01 00:00:00", AS_OF)
WAITING = "In progress"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
# The statuses, markers and payload fields in the views and the SQL below are those of the task tracker.
#: Keywords that the test documents hold, so that tags aren't all empty.
KEYWORDS = ("license", "the", "low", "due")
TRIGGERS = (("legal", ("license", "licensed")), ("english", (" the ", " and ")), ("french", (" le ", " les ")), ("none", ("zzzz",)))
ROUTES = (("license", "owner"), (" the ", "swarm"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", "Not started").when(F.col("o_orderstatus") == "P", "In progress")
    code = F.substring("o_orderpriority", 1, 1)
    priority = F.when(code == "1", "Urgent").when(code == "2", "High").when(code == "3", "Medium").when(code == "5", "Low")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Task "), F.col("o_orderkey")).alias("title"), status.alias("status"), priority.alias("priority"),
        F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("agent-"), F.col("o_custkey") % 10)).alias("assignee"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("due"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 5).alias("nudges"), F.col("o_totalprice").alias("price"),
    )


TASKS_SQL = """tasks AS (
    SELECT o_orderkey AS id, 'Task ' || o_orderkey AS title,
           CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Not started' WHEN 'P' THEN 'In progress' END AS status,
           CASE o_orderpriority[1] WHEN '1' THEN 'Urgent' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' WHEN '5' THEN 'Low' END AS priority,
           CASE WHEN o_custkey % 7 <> 0 THEN 'agent-' || o_custkey % 10 END AS assignee,
           strftime(o_orderdate, '%Y-%m-%d') AS due,
           CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END AS nudges, o_totalprice AS price
    FROM orders)"""


def weekly_status_pivot(spark, sf_dir):
    return metrics.weekly_pivot(_read(spark, sf_dir, "events"), "ts", "event_type", EVENT_TYPES)


def weekly_task_status(spark, sf_dir):
    return metrics.weekly_pivot(tasks(spark, sf_dir).withColumn("day", F.to_date("due")), "day", "status", ("Done", "In progress", "Not started"))


def status_counts(spark, sf_dir):
    return metrics.value_counts(tasks(spark, sf_dir), "status").withColumnRenamed("count", "n")


def metrics_vector(spark, sf_dir):
    return metrics.metrics_vector(tasks(spark, sf_dir), as_of())


def _alerts(spark, sf_dir):
    history = _read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return predicates.latest_alerts(history, "day", predicates.snapshot_alert("event_type", "event_type", ("error",), ()) | (F.col("value") > 100))


def latest_snapshot_alert_rows(spark, sf_dir):
    return _alerts(spark, sf_dir).select("event_id", "day", "event_type", "value")


def latest_snapshot_alert_flag(spark, sf_dir):
    return _alerts(spark, sf_dir).agg((F.count(F.lit(1)) > 0).alias("alert"))


def _overdue(policy):
    def query(spark, sf_dir):
        return tasks(spark, sf_dir).filter(predicates.overdue(F.col("status"), F.col("due"), as_of(), OVERDUE[policy])).select("id", "status", "due")

    return query


def due_today(spark, sf_dir):
    return tasks(spark, sf_dir).filter(predicates.due_today(F.col("due"), as_of())).select("id", "status", "due")


def waiting(spark, sf_dir):
    return tasks(spark, sf_dir).filter(predicates.waiting(F.col("status"), WAITING)).select("id", "status")


def nudge_updates(spark, sf_dir):
    late = predicates.overdue(F.col("status"), F.col("due"), as_of(), OVERDUE["guardian"])
    return actions.escalations(tasks(spark, sf_dir), late).select("id", "escalated", "nudges")


def review_routing(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    tags = text.review_tags(F.nullif("status", F.lit("In progress")), F.col("priority"), F.col("assignee"))
    return rows.withColumn("tags", tags).filter(predicates.tagged(F.col("tags"))).select("id", F.array_join(F.transform("tags", lambda t: t["name"]), ", ").alias("tags"))


def task_log(spark, sf_dir):
    return flatten.task_log(tasks(spark, sf_dir)).select("Title", "Assignee", "Priority", "Due", F.col("Needs Review").alias("needs_review"))


def daily_digest(spark, sf_dir):
    return metrics.digest_lines(tasks(spark, sf_dir), as_of(), WAITING)


def _mails(spark, sf_dir):
    """Bodies with and without markers, of orders."""
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 4
    body = (
        F.when(kind == 0, F.concat(F.lit("Title: order "), key, F.lit("\nContent: ship "), F.col("o_orderpriority"), F.lit(" due: 1998-0"), key % 9 + 1, F.lit("-15")))
        .when(kind == 1, F.concat(F.lit("  note - customer "), F.col("o_custkey"), F.lit(" overdue 1997-01-02\nSUBJECT late")))
        .when(kind == 2, F.concat(F.lit("plain text "), key))
        .otherwise(F.concat(F.lit("subject:\nnext line "), key, F.lit(" Due: 1999-01-01")))
    )
    return _read(spark, sf_dir, "orders").select(key.alias("id"), F.concat(F.lit(" Re "), key, F.lit(" ")).alias("subject"), body.alias("body"))


_MAILS_SQL = """mails AS (
    SELECT o_orderkey AS id, ' Re ' || o_orderkey || ' ' AS subject, CASE o_orderkey % 4
        WHEN 0 THEN 'Title: order ' || o_orderkey || chr(10) || 'Content: ship ' || o_orderpriority || ' due: 1998-0' || (o_orderkey % 9 + 1) || '-15'
        WHEN 1 THEN '  note - customer ' || o_custkey || ' overdue 1997-01-02' || chr(10) || 'SUBJECT late'
        WHEN 2 THEN 'plain text ' || o_orderkey
        ELSE 'subject:' || chr(10) || 'next line ' || o_orderkey || ' Due: 1999-01-01' END AS body
    FROM orders)"""


def command_title(spark, sf_dir):
    return _mails(spark, sf_dir).select("id", text.command_title(F.col("subject"), F.col("body")).alias("title"))


def command_content(spark, sf_dir):
    return _mails(spark, sf_dir).select("id", text.command_content(F.col("body")).alias("content"))


def due_from_text(spark, sf_dir):
    return _mails(spark, sf_dir).select("id", text.due_in_text(F.col("body")).alias("due"))


def keyword_tags(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.keyword_tags(F.col("text"), KEYWORDS), ",").alias("tags"))


def tag_triggers(spark, sf_dir):
    tags = F.transform(text.trigger_tags(F.col("text"), TRIGGERS), lambda t: t["name"])
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


def text_priority(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.priority_in_text(F.col("text")).alias("priority"))


def agent_routing(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.routed(F.col("text"), ROUTES, "default").alias("agent"))


def skip_done(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    return rows.filter(~predicates.mentions_done(F.col("title"), F.concat_ws(": ", "priority", "status"))).select("id", "title")


def _props(spark, sf_dir):
    """Pages of events; some are broken, some without properties."""
    raw = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{"), F.col("props"))).when(F.col("event_id") % 50 == 1, F.lit("{}"))
    k = F.get_json_object("props", "$.k")
    whole = F.concat(F.lit('{"id": "'), F.col("event_id"), F.lit('", "properties": {"Kind": {"select": {"name": " '), F.col("event_type"), F.lit(' "}}, "Nudge count": {"number": '), k, F.lit("}}}"))
    return flatten.parse_pages(_read(spark, sf_dir, "events").select("event_id", F.coalesce(raw, whole).alias("value")), id_column="event_id")


def props_extract(spark, sf_dir):
    from tallyspark.functions import properties as p

    good, _ = flatten.split_errors(_props(spark, sf_dir))
    return good.select("id", p.select_name("Kind").alias("kind"), p.select_name("Missing").alias("missing"), p.number("Nudge count").alias("number"), p.number("Missing").alias("no_number"))


def props_dead_letter(spark, sf_dir):
    return flatten.split_errors(_props(spark, sf_dir))[1]


def base64url_roundtrip(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", text.from_base64url(text.to_base64url(F.col("text"))).alias("text"))


def _messages(spark, sf_dir):
    """Turns of conversations as messages: those of users are unread."""
    received = F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn") + 86400).cast("timestamp_ntz")
    return _read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("sender"), F.lit("team").alias("recipient"), (F.col("role") == "user").alias("unread"), received.alias("received"), F.substring("text", 1, 60).alias("snippet"), "conv_id", "turn", "text")


def latest_message(spark, sf_dir):
    return readers.latest_message(_messages(spark, sf_dir), recipient="team").select("conv_id", "turn", "text")


def mailbox_unread(spark, sf_dir):
    return predicates.mailbox(_messages(spark, sf_dir), "user", "team").filter(predicates.asks_for(F.col("snippet"), "the ")).select("id", "snippet")


def mail_headers(spark, sf_dir):
    from tallyspark.functions import properties as p

    rows = _read(spark, sf_dir, "conversations")
    head = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    part = lambda kind, value: F.struct(F.lit(kind).alias("mimeType"), F.struct(value.alias("data")).alias("body"))
    headers = F.when(F.col("turn") == 0, F.array(head("From", F.col("role")))).otherwise(F.array(head("subject", F.lit("no")), head("Subject", F.col("role")), head("Subject", F.lit("second"))))
    parts = F.array(part("text/plain", text.to_base64url(F.lit("first"))), part("text/html", text.to_base64url(F.lit("<p>"))), part("text/plain", F.when(F.col("turn") % 2 == 0, text.to_base64url(F.col("text"))).otherwise(F.lit(""))))
    return rows.select("conv_id", "turn", headers.alias("headers"), parts.alias("parts")).select("conv_id", "turn", p.header("Subject").alias("subject"), p.plain_body().alias("body"))


def payload_json(spark, sf_dir):
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://example.com/"), F.col("id"))).otherwise(F.lit("none"))
    payload = actions.page_payload(F.col("title"), F.col("status"), as_of(), url, "due")
    return tasks(spark, sf_dir).select("id", payload.alias("payload"))


def trend_sorted(spark, sf_dir):
    events = _read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    wide = events.groupBy("day").agg(*(F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES))
    return metrics.trend(wide, "day", EVENT_TYPES).withColumnRenamed("count", "n")


def snapshot_append(spark, sf_dir):
    """The history of all tasks by year; the snapshot of 1998 is appended twice."""
    rows, path = tasks(spark, sf_dir).withColumn("year", F.substring("due", 1, 4)).select("id", "year"), writers.scratch(spark, "history")
    writers.append_history(rows, path, "year")
    writers.append_history(rows.filter("year = '1998'"), path, "year")
    return spark.read.schema("id long, year string").parquet(path)


def keyed_update(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    late = predicates.overdue(F.col("status"), F.col("due"), as_of(), OVERDUE["guardian"])
    updates = actions.escalations(rows, late).select("id", "nudges")
    return actions.keyed_update(rows.select("id", "status", "nudges"), updates, "id")


def html_text(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.html_text("html").alias("text"))


#: Bodies with ``N`` for an order's number, and the texts that are seen of them.
BODIES = (
    ("<div><p>Order N <b>bold", "Order N bold"),
    ("<!-- note --><ul><li>Order N</li><li>&lt;x&gt;</ul>", "Order N<x>"),
    ('<script>if (a < b) { "<p>" }</script>Order N<style>p{}</style> end', "Order N end"),
    ("a < b &amp; c Order N", "a < b & c Order N"),
    ("<table><tr><td>Order<td>N</table><br/>&#233;", "OrderN\u00e9"),
    ("<p title='>'>Order N</p><SCRIPT>x</SCRIPT>!", "Order N!"),
)


def html_bodies(spark, sf_dir):
    """Broken and nested HTML, of orders."""
    key = F.col("o_orderkey")
    body = F.replace(F.element_at(F.array(*(F.lit(b) for b, _ in BODIES)), (key % len(BODIES) + 1).cast("int")), F.lit("N"), key.cast("string"))
    return _read(spark, sf_dir, "orders").select(key.alias("id"), text.html_text(body).alias("text"))


def schema_inspect(spark, sf_dir):
    """A description of the task database, as its service gives it, with the priorities of orders as options."""
    names = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).distinct()
    options = names.agg(F.collect_list(F.struct("name")).alias("options"))  # the kinds of priority, a handful
    kinds = F.struct(F.struct(F.lit("select").alias("type"), F.struct("options").alias("select")).alias("Priority"), F.struct(F.lit("title").alias("type")).alias("Title"))
    path = writers.scratch(spark, "schema")
    options.select(F.to_json(F.struct(kinds.alias("properties"))).alias("value")).write.text(path)
    return readers.database_schema(spark, path)


def chat_updates(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    return actions.outbox(rows, "chat", F.lit("tasks"), actions.chat_update(F.col("title"), F.col("priority"), F.col("due")), F.col("id"))


def listing(spark, sf_dir):
    return flatten.lines(tasks(spark, sf_dir), "title", "status", "priority", "due")


def _pages(spark, sf_dir):
    """Orders as task pages: names in spans, some blank; assignees as people; tags in a list or, for some, as a select."""
    o = tasks(spark, sf_dir)
    span = lambda c: F.array(F.struct(F.struct(c.alias("content")).alias("text")))
    named = lambda kind, c: F.struct(F.struct(c.alias("name")).alias(kind))
    titles = F.when(F.col("id") % 11 == 0, F.array().cast("array<struct<text: struct<content: string>>>")).otherwise(F.concat(span(F.col("title")), span(F.lit("second"))))
    people = F.when(F.col("assignee").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("name")))).otherwise(F.array(F.struct(F.col("assignee").alias("name")), F.struct(F.lit("helper").alias("name"))))
    tags = F.when(F.col("id") % 3 == 0, F.array(F.struct(F.lit("a").alias("name")), F.struct(F.lit("b").alias("name"))))
    props = F.struct(
        F.struct(titles.alias("title")).alias("Task name"), F.struct(span(F.concat(F.lit("about "), F.col("title"))).alias("rich_text")).alias("Summary"),
        named("status", F.col("status")).alias("Status"), F.struct(people.alias("people")).alias("Assignee"), F.struct(F.struct(F.col("due").alias("start")).alias("date")).alias("Due"),
        named("select", F.concat(F.lit(" "), F.col("priority"), F.lit(" "))).alias("Priority"), F.struct(tags.alias("multi_select"), F.when(tags.isNull(), F.struct(F.lit("one").alias("name"))).alias("select")).alias("Tags"),
    )
    raw = o.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), props.alias("properties"))).alias("value"))
    return flatten.split_errors(flatten.parse_pages(raw))[0]


def task_fields(spark, sf_dir):
    rows = flatten.tasks(_pages(spark, sf_dir))
    return rows.select("id", "title", "summary", "status", F.array_join("assignee", ",").alias("assignee"), "due", "priority", F.array_join("tags", ",").alias("tags"), "project")


def task_snapshot(spark, sf_dir):
    return flatten.snapshot(_pages(spark, sf_dir), as_of()).select(F.col("Date").alias("day"), F.col("Task").alias("task"), F.col("Status").alias("status"), F.col("Due").alias("due"), F.col("Priority").alias("priority"))


def page_payloads(spark, sf_dir):
    """Payloads of all kinds but the one in ``payload_json``."""
    args = (F.col("title"), F.concat(F.lit("python "), F.col("status")), as_of(), F.concat(F.lit("u"), F.col("id")))
    return tasks(spark, sf_dir).select("id", *(actions.page_payload(*args, kind).alias(kind) for kind in ("short", "full", "log")))


def document_and_mail_payloads(spark, sf_dir):
    shared = actions.document_payload(F.col("title"), F.col("status"), F.lit("w@example.com"))
    stamped = actions.stamped_document_payload("doc-", as_of(), F.lit("w@example.com"))
    mail = actions.mail_payload(F.lit("t@example.com"), F.col("title"), F.lit("~~~???"), F.concat(F.lit("/logs/"), F.col("id"), F.lit(".csv")))
    return tasks(spark, sf_dir).select("id", actions.document_payload(F.col("title"), F.col("status")).alias("document"), shared.alias("shared"), stamped.alias("stamped"), mail.alias("mail"))


def mail_tasks(spark, sf_dir):
    """HTML mails about orders as tasks."""
    key = F.col("o_orderkey")
    body = F.concat(F.lit("<style>p {}</style><p>Order "), key, F.lit(" &amp; client</p><script>var due = 1;</script> due: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(key % 2 == 0, " LOW").otherwise(""))
    mails = _read(spark, sf_dir, "orders").select(F.concat(F.lit(" Mail "), key).alias("subject"), body.alias("body"))
    return flatten.mail_tasks(mails).select(F.col("Task name").alias("name"), F.col("Due").alias("due"), F.array_join("Tags", ",").alias("tags"), F.col("Priority").alias("priority"), F.col("Content").alias("content"))


def _delivery(spark, sf_dir):
    """The chat outbox of tasks, and reports of attempts: some fail once, some always, some have none."""
    k = F.col("id") % 5
    key = F.sha2(F.concat_ws("\x1f", F.lit("chat"), F.col("id").cast("string")), 256)
    attempt = lambda n, code, error: F.struct(key.alias("key"), F.timestamp_seconds(F.col("id") + n).cast("timestamp_ntz").alias("at"), F.lit(code).cast("int").alias("code"), F.lit(error).cast("string").alias("error"))
    tried = F.when(k == 1, F.array(attempt(0, 200, None))).when(k == 2, F.array(attempt(0, 500, None), attempt(9, 200, None))).when(k == 3, F.array(attempt(5, 429, "ratelimited"), attempt(1, None, None)))
    tried = tried.when(k == 4, F.array(attempt(0, 200, "not_in_channel"), attempt(7, 404, None), attempt(3, None, None)))
    reports = tasks(spark, sf_dir).select(F.explode(tried).alias("r")).select("r.*")
    return delivery.delivery_status(chat_updates(spark, sf_dir), reports)


def delivery_status(spark, sf_dir):
    return _delivery(spark, sf_dir).select("key", "state", "attempts", "error")


def delivery_dead_letters(spark, sf_dir):
    return delivery.dead_letters(_delivery(spark, sf_dir), "chat", "mail")


def delivery_due_again(spark, sf_dir):
    return delivery.due_again(_delivery(spark, sf_dir)).select("key", "state")


def _connector(effect):
    """A stand-in for a service: some requests fail at first, some are refused, some break off each time."""
    n = int(effect["payload"])
    if n % 7 == 0:
        raise ConnectionError("broken off")
    if n % 5 == 0:
        return 429, "ratelimited"
    return (500, None) if n % 3 == 0 and effect["attempts"] == 0 else (200, None)


def delivery_rounds(spark, sf_dir):
    """The state of all effects after four rounds of delivery, three attempts each at most."""
    day = F.when(F.col("id") % 4 != 0, F.to_date("due"))
    path = writers.scratch(spark, "ledger")
    writers.add_to_outbox(actions.outbox(tasks(spark, sf_dir), "chat", F.lit("tasks"), F.col("id").cast("string"), F.col("id"), day=day), path)
    for k in range(4):
        agent.deliver(spark, path, _connector, F.lit(f"1998-06-15 12:0{k}:00"))
    status = delivery.delivery_status(writers.ledger(spark, path, writers.EFFECT), writers.ledger(spark, path, writers.REPORT).drop("day"))
    return status.select("key", "state", "attempts", "error")


def response_tasks(spark, sf_dir):
    """Tasks out of captured responses, one for each customer's orders."""
    o = _read(spark, sf_dir, "orders")
    page = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.struct(F.struct(F.struct(F.col("o_orderstatus").alias("name")).alias("status")).alias("Status")).alias("properties"))
    path = writers.scratch(spark, "responses")
    o.groupBy("o_custkey").agg(F.collect_list(page).alias("results")).select(F.to_json(F.struct("results")).alias("value")).write.text(path)
    return flatten.tasks(readers.task_pages(spark, path, missing="raise", multi_line=False)).select("id", "status", "title", "due")


def _responses(spark, sf_dir, broken=True):
    """A folder of responses with up to 100 orders each, as a service pages them; some aren't JSON, some have no results."""
    o = _read(spark, sf_dir, "orders").withColumn("response", F.expr("o_orderkey DIV 400"))
    status = F.struct(F.struct(F.struct(F.col("o_orderstatus").alias("name")).alias("status")).alias("Status"), F.struct(F.lit("formula").alias("type"), F.struct(F.col("o_totalprice").alias("number")).alias("formula")).alias("Price"))
    page = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_edited_time"), status.alias("properties"))
    pages = F.array_sort(F.collect_list(F.struct("o_orderkey", page.alias("page"))))  # 100 at most
    whole = o.groupBy("response").agg(F.transform(pages, lambda p: p["page"]).alias("results")).withColumn("text", F.to_json(F.struct("results")))
    kind = F.col("response") % 10
    path = writers.scratch(spark, "responses")
    text_ = F.when(kind == 3, F.lit("{broken")).when(kind == 7, F.lit('{"object": "error"}')).otherwise(F.col("text")) if broken else F.col("text")
    whole.select(text_.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def captured_pages(spark, sf_dir):
    """Pages that were edited lately, the first 20 of each response: filters and limit are the source's."""
    responses.register(spark)
    read = spark.read.format("responses").option("path", _responses(spark, sf_dir)).option("onError", "empty").option("limit", 20).load()
    return read.filter("edited >= '1995-06-01'").select("id", "edited", F.get_json_object("page", "$.properties.Status.status.name").alias("status"))


def first_pages(spark, sf_dir):
    """The first 50 pages by id: the limit is the feature."""
    return readers.task_pages(spark, _responses(spark, sf_dir), on_error="empty", limit=50, multi_line=False).select("id")


def property_bags(spark, sf_dir):
    """Properties of whatever kind: a status, and one that no schema has."""
    responses.register(spark)
    pages = spark.read.format("responses").option("path", _responses(spark, sf_dir, False)).load()
    return bags.properties(pages, "page", "id")


def property_kinds(spark, sf_dir):
    responses.register(spark)
    return bags.listed_kinds(spark.read.format("responses").option("path", _responses(spark, sf_dir, False)).load())


def bucketed_update(spark, sf_dir):
    """``keyed_update`` in place, on a table in folders by key."""
    rows, schema = tasks(spark, sf_dir).select("id", "status", "nudges"), "id long, status string, nudges long"
    late = predicates.overdue(F.col("status"), F.col("due"), as_of(), OVERDUE["guardian"])
    path = writers.scratch(spark, "tasks")
    keyed.create(rows, path, "id", 8)
    keyed.update(spark, path, schema, actions.escalations(tasks(spark, sf_dir), late).select("id", "nudges"), "id", 8)
    return keyed.read(spark, path, schema).drop(keyed.BUCKET)


def _history(spark, sf_dir):
    """The history of events and its sums by day; half of the last day's events come later."""
    rows = _read(spark, sf_dir, "events").select("event_id", "event_type", "value", F.to_date("ts").alias("day"))
    path, sums, schema = writers.scratch(spark, "history"), writers.scratch(spark, "sums"), "event_id long, event_type string, value double, day date"
    last = rows.select(F.max("day")).scalar()
    later = (F.col("day") == last) & (F.col("event_id") % 2 == 0)
    for part in (rows.filter(~later), rows.filter(later)):
        history.append(part, path, sums, "day", "event_type", schema)
    return path, sums, schema


def history_alerts(spark, sf_dir):
    path, _, schema = _history(spark, sf_dir)
    alert = predicates.snapshot_alert("event_type", "event_type", ("error",), ()) | (F.col("value") > 100)
    return history.of_latest_day(spark, path, schema, "day", alert).select("event_id", "day", "event_type", "value")


def history_weekly(spark, sf_dir):
    return history.weekly(spark, _history(spark, sf_dir)[1], "day", "event_type", EVENT_TYPES)


def wide_history(spark, sf_dir):
    """Metric vectors of two days, appended to a wide table."""
    path = writers.scratch(spark, "wide")
    for at in WIDE_DAYS:
        writers.append_history(metrics.metrics_vector(tasks(spark, sf_dir), F.lit(at).cast("timestamp_ntz")), path)
    rows = spark.read.parquet(path)
    return rows.withColumn("Date", F.col("Date").cast("date"))


def task_log_mail(spark, sf_dir):
    """Mails with the exported task log, and with a file that isn't there."""
    path = writers.scratch(spark, "log") + ".csv"
    writers.export_csv_file(flatten.task_log(tasks(spark, sf_dir)).withColumn("_id", F.substring("Title", 6, 20).cast("long")), path, "_id")
    mails = spark.createDataFrame([(1, path), (2, path + ".gone")], "mail int, path string")
    found = readers.with_part_contents(actions.with_attachment_parts(mails, readers.attachment_files(spark, path)))
    payload = actions.mail_payload(F.lit("t@example.com"), F.lit("Daily Task Log"), F.lit("attached"), filename=F.when(F.col("filename").isNotNull(), "log.csv"), data=F.base64("content"), part=F.col("part"))
    sent = found.select("mail", payload.alias("p"))
    field = lambda name: F.get_json_object("p", f"$.{name}")
    rows = sent.select("mail", field("part").cast("long").alias("part"), F.unbase64(field("data")).alias("content"))
    logs = actions.part_digests(rows, "mail", "part", "content").select("mail", F.col("sha256").alias("log"))
    return sent.groupBy("mail").agg(F.max(field("filename")).alias("filename")).join(logs, "mail")


def error_log(spark, sf_dir):
    """Dead letters as a CSV, and whether one was written; there is none where there are no errors."""
    errors, path = flatten.split_errors(_props(spark, sf_dir))[1], writers.scratch(spark, "errors")
    written, none = writers.write_errors(errors, path), writers.write_errors(errors.limit(0), path + "-none")
    return readers.csv_table(spark, path, schemas.ERRORS).select("task_id", "error", F.lit(written).alias("written"), F.lit(none).alias("none_written"))


def split_counts(spark, sf_dir):
    """Good and bad records in one table, and their counts, out of one job."""
    path = writers.scratch(spark, "split")
    counts = writers.write_split(_props(spark, sf_dir).select("id", "error"), path)
    rows = spark.read.schema("id string, error string, kind string").parquet(path)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.lit(counts["good"]).alias("good"), F.lit(counts["bad"]).alias("bad"))


def supervised_poll(spark, sf_dir):
    """Unread turns through a poll that fails twice: each once, with the poll's state and attempts."""
    mailbox.register(spark)
    inbox, out, ledger, checkpoint = (writers.scratch(spark, n) for n in ("mailbox", "turns", "ledger", "poll"))
    _messages(spark, sf_dir).filter("unread").select(F.col("id").alias("value")).write.text(inbox)
    failures = [1, 2]

    def batch(rows, number):
        if failures:
            raise RuntimeError(f"no connection {failures.pop()}")
        rows.select("value").write.mode("overwrite").parquet(f"{out}/batch={number}")

    def start():
        stream = spark.readStream.format("mailbox").option("path", inbox).load()
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    supervised.supervise(spark, "turns", start, ledger)
    status = delivery.delivery_status(writers.ledger(spark, ledger, writers.EFFECT), writers.ledger(spark, ledger, writers.REPORT).drop("day")).first()
    return spark.read.schema("value string, batch int").parquet(out).select(F.col("value").alias("id"), F.lit(status["state"]).alias("state"), F.lit(status["attempts"]).alias("attempts"))


def csv_roundtrip(spark, sf_dir):
    """A snapshot exported as CSV and read back, with blanks, quotes and line breaks in its names."""
    rows, path = tasks(spark, sf_dir), writers.scratch(spark, "csv")
    name = F.concat(F.lit(' "'), F.col("title"), F.lit('", '), F.when(F.col("id") % 2 == 0, "\n").otherwise(""), F.col("due"), F.lit(" "))
    writers.export_csv(rows.select(F.to_date("due").alias("Date"), name.alias("Task"), F.coalesce("status", F.lit("None")).alias("Status"), "due", F.col("priority").alias("Priority")), path)
    return readers.csv_table(spark, path, schemas.SNAPSHOT, multi_line=True).select(F.col("Date").alias("day"), F.col("Task").alias("task"), F.col("Status").alias("status"), F.col("Due").alias("due"), F.col("Priority").alias("priority"))


def agent_effects(spark, sf_dir):
    """The mail agent as a stream over all turns of conversations, some of which come twice."""
    part = F.struct(F.lit("text/plain").alias("mimeType"), F.struct(text.to_base64url(F.col("text")).alias("data")).alias("body"))
    head = F.struct(F.lit("Subject").alias("name"), F.col("id").alias("value"))
    mails = _messages(spark, sf_dir).select("id", "sender", "recipient", "unread", "received", "snippet", F.array(head).alias("headers"), F.array(part).alias("parts"), "turn")
    inbox, out = writers.scratch(spark, "inbox"), writers.scratch(spark, "outbox")
    mails.unionByName(mails.filter("turn = 1")).drop("turn").write.json(inbox)
    stream = agent.message_stream(spark, inbox, files_per_batch=1000, delay="20000 days")
    agent.run_agent(stream, Settings(), out, writers.scratch(spark, "errors"), writers.scratch(spark, "agent")).awaitTermination()
    return writers.ledger(spark, out, writers.EFFECT).select("key", "channel")


def _mailbox(spark, sf_dir):
    """Outbox and dead letters of the mail agent over a mailbox of all turns: some of its lines are broken, some messages have
    no id, some come in two files; all is run twice, the second time with a lost checkpoint."""
    part = F.struct(F.lit("text/plain").alias("mimeType"), F.struct(text.to_base64url(F.col("text")).alias("data")).alias("body"))
    head = F.struct(F.lit("Subject").alias("name"), F.col("id").alias("value"))
    rows = _messages(spark, sf_dir).withColumns({"headers": F.array(head), "parts": F.array(part), "kind": F.col("conv_id") % 7})
    whole = F.to_json(F.struct("id", "sender", "recipient", "unread", "received", "snippet", "headers", "parts"))
    line = F.when(F.col("kind") == 3, F.concat(F.lit("{broken "), F.col("id"))).when(F.col("kind") == 5, F.concat(F.lit('{"snippet": "'), F.col("id"), F.lit('"}'))).otherwise(whole)
    inbox, out, letters = (writers.scratch(spark, name) for name in ("mailbox", "outbox", "letters"))
    lines = rows.select(line.alias("value"), "kind", "turn")
    lines.unionByName(lines.filter("kind = 1")).select("value").write.text(inbox)
    for _ in range(2):
        agent.run_agent(agent.mailbox_stream(spark, inbox), Settings(), out, letters, writers.scratch(spark, "agent")).awaitTermination()
    return out, letters


def mailbox_effects(spark, sf_dir):
    return writers.ledger(spark, _mailbox(spark, sf_dir)[0], writers.EFFECT).select("key", "channel", F.col("day").cast("string").alias("day"))


def mailbox_letters(spark, sf_dir):
    return writers.letters_in(spark, _mailbox(spark, sf_dir)[1]).select("task_id", "error", "raw")


def outbox_ledger(spark, sf_dir):
    """Chat effects and the reports of their attempts, written together and then once more; some days are null."""
    rows = tasks(spark, sf_dir)
    day = F.when(F.col("id") % 4 != 0, F.to_date("due"))
    effects = actions.outbox(rows, "chat", F.lit("tasks"), F.col("title"), F.col("id"), day=day)
    failed = F.col("id") % 3 == 0
    reports = rows.select(F.sha2(F.concat_ws("\x1f", F.lit("chat"), F.col("id").cast("string")), 256).alias("key"), F.to_timestamp_ntz("due").alias("at"), F.when(failed, 500).otherwise(200).alias("code"), F.when(failed, F.lit("late")).alias("error"), day.alias("day"))
    path = writers.scratch(spark, "ledger")
    for _ in range(2):
        writers.add_to_outbox(effects, path, reports)
    status = delivery.delivery_status(writers.ledger(spark, path, writers.EFFECT), writers.ledger(spark, path, writers.REPORT).drop("day"))
    return status.select("key", F.col("day").cast("string").alias("day"), "state", "attempts", "error")


def nudge_stream(spark, sf_dir):
    """Running nudge counts of a stream of late tasks, each of which is late once or twice, at its end."""
    late = tasks(spark, sf_dir).filter(predicates.overdue(F.col("status"), F.col("due"), as_of(), OVERDUE["guardian"])).select(F.col("id").cast("string").alias("id"))
    inbox, out = writers.scratch(spark, "late"), writers.scratch(spark, "nudges")
    late.unionByName(late.filter("CAST(id AS LONG) % 2 = 0")).write.json(inbox)
    counts = agent.nudge_counts(spark.readStream.schema("id string").option("maxFilesPerTrigger", 1000).json(inbox))
    write = counts.writeStream.outputMode("update").foreachBatch(lambda rows, number: rows.write.mode("append").parquet(out))
    write.option("checkpointLocation", writers.scratch(spark, "nudging")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id string, nudges long").parquet(out).groupBy("id").agg(F.max("nudges").alias("nudges"))


QUERIES = {f.__name__: f for f in (
    html_bodies, delivery_rounds, captured_pages, first_pages, property_bags, property_kinds, bucketed_update, history_alerts, history_weekly, wide_history, task_log_mail, error_log, split_counts, supervised_poll,
    response_tasks, csv_roundtrip, agent_effects, mailbox_effects, mailbox_letters, outbox_ledger, nudge_stream, task_fields, task_snapshot, page_payloads, document_and_mail_payloads, mail_tasks, mailbox_unread, delivery_status, delivery_dead_letters, delivery_due_again,
    weekly_status_pivot, weekly_task_status, status_counts, metrics_vector, latest_snapshot_alert_rows, latest_snapshot_alert_flag,
    due_today, waiting, nudge_updates, review_routing, task_log, daily_digest, command_title, command_content, due_from_text,
    keyword_tags, tag_triggers, text_priority, agent_routing, skip_done, props_extract, props_dead_letter, base64url_roundtrip,
    latest_message, mail_headers, payload_json, trend_sorted, snapshot_append, keyed_update, html_text, schema_inspect, chat_updates, listing,
)} | {f"overdue_{p}": _overdue(p) for p in OVERDUE}

_AS_OF = f"TIMESTAMP '{AS_OF}'"
_LATE = f"due::DATE < {_AS_OF}::DATE AND coalesce(status, '') NOT IN ('Done', 'Archived')"
_GUARD = f"due::TIMESTAMP < {_AS_OF} AND coalesce(status, '') NOT IN ('Done', 'Archived')"
_DAY = "SELECT *, ts::DATE AS day FROM events"


def _tasks_sql(sql: str) -> str:
    return f"WITH {TASKS_SQL} {sql}"


def _case(column: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{w}') THEN '{v}'" for w, v in pairs) + f" ELSE '{default}' END"


_TAGS = lambda pairs: "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in words)} THEN '{tag}' END" for tag, words in pairs) + "], lambda x: x IS NOT NULL)"
_MARK = lambda pattern, fallback: f"CASE WHEN regexp_matches(body, '{pattern}') THEN regexp_extract(body, '{pattern}', 1) ELSE trim({fallback}) END"

ORACLE_SQL = {
    "weekly_status_pivot": "SELECT date_trunc('week', ts)::DATE AS \"Week\", " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES) + " FROM events GROUP BY 1",
    "weekly_task_status": _tasks_sql("SELECT date_trunc('week', due::DATE)::DATE AS \"Week\", " + ", ".join(f"count(*) FILTER (status = '{t}') AS \"{t}\"" for t in ("Done", "In progress", "Not started")) + " FROM tasks GROUP BY 1"),
    "status_counts": _tasks_sql("SELECT status, count(*) AS n FROM tasks GROUP BY 1"),
    "metrics_vector": _tasks_sql(f"SELECT {_AS_OF}::DATE AS \"Date\", " + ", ".join(f"count(*) FILTER (status = '{s}') AS \"{s}\"" for s in ("Not started", "In progress", "In review", "Waiting", "Rejected – actioned", "Rejected – hold", "Done")) + f", count(*) FILTER (status = 'Overdue') + count(*) FILTER (due::DATE < {_AS_OF}::DATE AND status NOT IN ('Done', 'Rejected – hold')) AS \"Overdue\" FROM tasks"),
    "latest_snapshot_alert_rows": f"WITH h AS ({_DAY}) SELECT event_id, day, event_type, value FROM h WHERE day = (SELECT max(day) FROM h) AND (event_type = 'error' OR value > 100)",
    "latest_snapshot_alert_flag": f"WITH h AS ({_DAY}) SELECT count(*) > 0 AS alert FROM h WHERE day = (SELECT max(day) FROM h) AND (event_type = 'error' OR value > 100)",
    "overdue_metrics": _tasks_sql(f"SELECT id, status, due FROM tasks WHERE due::DATE < {_AS_OF}::DATE AND coalesce(status, 'Unknown') NOT IN ('Done', 'Rejected – hold')"),
    "overdue_digest": _tasks_sql(f"SELECT id, status, due FROM tasks WHERE {_LATE}"),
    "overdue_guardian": _tasks_sql(f"SELECT id, status, due FROM tasks WHERE {_GUARD}"),
    "overdue_manager": _tasks_sql(f"SELECT id, status, due FROM tasks WHERE due::TIMESTAMP < {_AS_OF} AND coalesce(status, '') <> 'Done'"),
    "due_today": _tasks_sql(f"SELECT id, status, due FROM tasks WHERE due::DATE = {_AS_OF}::DATE"),
    "waiting": _tasks_sql(f"SELECT id, status FROM tasks WHERE status = '{WAITING}'"),
    "nudge_updates": _tasks_sql(f"SELECT id, TRUE AS escalated, coalesce(nudges, 0) + 1 AS nudges FROM tasks WHERE {_GUARD}"),
    "review_routing": _tasks_sql("SELECT id, concat_ws(', ', CASE WHEN coalesce(priority, '') = '' OR coalesce(assignee, '') = '' THEN 'Needs Review' END, CASE WHEN status = 'In progress' THEN 'Unsorted' END) AS tags FROM tasks WHERE coalesce(priority, '') = '' OR coalesce(assignee, '') = '' OR status = 'In progress'"),
    "task_log": _tasks_sql("SELECT title AS \"Title\", assignee AS \"Assignee\", priority AS \"Priority\", due AS \"Due\", CASE WHEN assignee IS NULL OR priority IS NULL THEN 'Yes' ELSE 'No' END AS needs_review FROM tasks"),
    "daily_digest": _tasks_sql(f"""
        SELECT section, id, line FROM (
            SELECT 1 AS section, id, '- ' || title || ' (was due ' || due || ')' AS line FROM tasks WHERE {_LATE}
            UNION ALL SELECT 2, id, '- ' || title FROM tasks WHERE due::DATE = {_AS_OF}::DATE
            UNION ALL SELECT 3, id, '- ' || title FROM tasks WHERE status = '{WAITING}')
        UNION ALL SELECT 0, NULL, 'Daily Task Summary for ' || strftime({_AS_OF}, '%Y-%m-%d') || chr(10)
        UNION ALL SELECT 1, NULL, 'Overdue:' || CASE WHEN NOT EXISTS (FROM tasks WHERE {_LATE}) THEN chr(10) || 'None' ELSE '' END
        UNION ALL SELECT 2, NULL, chr(10) || 'Due Today:' || CASE WHEN NOT EXISTS (FROM tasks WHERE due::DATE = {_AS_OF}::DATE) THEN chr(10) || 'None' ELSE '' END
        UNION ALL SELECT 3, NULL, chr(10) || 'Waiting on {WAITING}:' || CASE WHEN NOT EXISTS (FROM tasks WHERE status = '{WAITING}') THEN chr(10) || 'None' ELSE '' END"""),
    "command_title": f"WITH {_MAILS_SQL} SELECT id, {_MARK('(?i)(?:title|subject)[:-]?\\s*(.*)', 'subject')} AS title FROM mails",
    "command_content": f"WITH {_MAILS_SQL} SELECT id, {_MARK('(?i)(?:content|body|note)[:-]?\\s*(.*)', 'body')} AS content FROM mails",
    "due_from_text": f"WITH {_MAILS_SQL} SELECT id, nullif(regexp_extract(body, 'due[: -]+([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS due FROM mails",
    "keyword_tags": f"SELECT doc_id, array_to_string({_TAGS([(k, (k,)) for k in KEYWORDS])}, ',') AS tags FROM documents",
    "tag_triggers": f"SELECT doc_id, array_to_string({_TAGS(TRIGGERS)}, ',') AS tags FROM documents",
    "text_priority": f"SELECT doc_id, {_case('text', (('high', 'High'), ('medium', 'Medium'), ('low', 'Low')), 'Medium')} AS priority FROM documents",
    "agent_routing": f"SELECT doc_id, {_case('text', ROUTES, 'default')} AS agent FROM documents",
    "skip_done": _tasks_sql("SELECT id, title FROM tasks WHERE NOT contains(title, 'Done') AND NOT contains(concat_ws(': ', priority, status), 'Done')"),
    "props_extract": "SELECT event_id::VARCHAR AS id, event_type AS kind, '' AS missing, json_extract_string(props, '$.k')::BIGINT AS number, 0::BIGINT AS no_number FROM events WHERE event_id % 50 > 1",
    "props_dead_letter": "SELECT event_id::VARCHAR AS task_id, CASE event_id % 50 WHEN 0 THEN 'malformed record' ELSE 'no properties' END AS error FROM events WHERE event_id % 50 < 2",
    "base64url_roundtrip": "SELECT doc_id, text FROM documents",
    "latest_message": "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 1",
    "mail_headers": "SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' ELSE role END AS subject, CASE WHEN turn % 2 = 0 AND text <> '' THEN text ELSE 'first' END AS body FROM conversations",
    "payload_json": _tasks_sql(f"SELECT id, '{{\"properties\":{{\"Task name\":{{\"title\":[{{\"text\":{{\"content\":\"' || title || '\"}}}}]}},\"Summary\":{{\"rich_text\":[{{\"text\":{{\"content\":\"' || status || '\"}}}}]}},\"Status\":{{\"status\":{{\"name\":\"Not started\"}}}},\"Due\":{{\"date\":{{\"start\":\"' || strftime({_AS_OF} + INTERVAL 3 DAY, '%Y-%m-%d') || '\"}}}},\"Doc Link\":{{' || CASE WHEN id % 2 = 0 THEN '\"url\":\"https://example.com/' || id || '\"' ELSE '' END || '}}}}}}' AS payload FROM tasks"),
    "trend_sorted": "SELECT ts::DATE AS day, t.status AS status, count(*) FILTER (event_type = t.status) AS n FROM events, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS status) t GROUP BY 1, 2",
    "snapshot_append": _tasks_sql("SELECT id, due[1:4] AS year FROM tasks UNION ALL SELECT id, due[1:4] FROM tasks WHERE due[1:4] = '1998'"),
    "task_fields": _tasks_sql("SELECT id::VARCHAR AS id, CASE WHEN id % 11 = 0 THEN '' ELSE title END AS title, 'about ' || title AS summary, coalesce(status, '') AS status, coalesce(assignee || ',helper', '') AS assignee, due, coalesce(priority, '') AS priority, CASE WHEN id % 3 = 0 THEN 'a,b' ELSE 'one' END AS tags, '' AS project FROM tasks"),
    "task_snapshot": _tasks_sql(f"SELECT {_AS_OF}::DATE AS day, CASE WHEN id % 11 = 0 THEN 'Untitled' ELSE title END AS task, coalesce(status, 'Unknown') AS status, due, coalesce(' ' || priority || ' ', 'None') AS priority FROM tasks"),
    "page_payloads": _tasks_sql(f"""
        SELECT id, '{{"properties":{{' || base || '}}}}' AS short,
            '{{"properties":{{' || base || ',"Assignee":{{"people":[]}},"Tags":{{"multi_select":[{{"name":"tech"}}]}},"Due":{{"date":{{"start":"' || day || '"}}}},"Priority":{{"select":{{"name":"Medium"}}}},"Created by":{{"rich_text":[{{"text":{{"content":"agent"}}}}]}},"Started on":{{"date":{{"start":"' || day || '"}}}},"Task type":{{"select":{{"name":"Creative"}}}},"URL":{{"url":"u' || id || '"}}}}}}' AS "full",
            '{{"properties":{{"Agent":{{"title":[{{"text":{{"content":"agent"}}}}]}},"Task":{{"rich_text":[{{"text":{{"content":"' || title || '"}}}}]}},"Document":{{"url":"u' || id || '"}}}}}}' AS log
        FROM (SELECT *, strftime({_AS_OF}, '%Y-%m-%d') AS day, '"Task name":{{"title":[{{"text":{{"content":"' || title || '"}}}}]}},"Summary":{{"rich_text":[{{"text":{{"content":"python ' || status || '"}}}}]}},"Status":{{"status":{{"name":"Not started"}}}}' AS base FROM tasks)"""),
    "document_and_mail_payloads": _tasks_sql(f"""
        SELECT id, '{{' || doc || '}}' AS document, '{{' || doc || ',' || writer || '}}' AS shared,
            '{{"title":"doc-' || strftime({_AS_OF}, '%Y%m%d-%H%M%S') || '",' || writer || ',"sendNotificationEmail":true}}' AS stamped,
            '{{"to":"t@example.com","subject":"' || title || '","raw":"fn5-Pz8_","path":"/logs/' || id || '.csv","filename":"' || id || '.csv"}}' AS mail
        FROM (SELECT *, '"title":"' || title || '","insert":{{"index":1,"text":"' || status || '"}}' AS doc, '"permission":{{"type":"user","role":"writer","emailAddress":"w@example.com"}}' AS writer FROM tasks)"""),
    "mail_tasks": """SELECT 'Mail ' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS due, 'client' AS tags, CASE WHEN o_orderkey % 2 = 0 THEN 'Low' ELSE 'Medium' END AS priority,
        'Order ' || o_orderkey || ' & client due: ' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' LOW' ELSE '' END AS content FROM orders""",
    "mailbox_unread": "SELECT conv_id || '-' || turn AS id, text[1:60] AS snippet FROM conversations WHERE role = 'user' AND contains(lower(text[1:60]), 'the ')",
    "delivery_status": _tasks_sql("""
        SELECT sha256('chat' || chr(31) || id) AS key, CASE id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'sent' WHEN 2 THEN 'sent' ELSE 'failed' END AS state,
            [0, 1, 2, 2, 3][id % 5 + 1] AS attempts, [NULL, NULL, 'code 500', 'ratelimited', 'code 404'][id % 5 + 1] AS error FROM tasks"""),
    "delivery_dead_letters": _tasks_sql("""
        SELECT sha256('chat' || chr(31) || id) AS task_id, 'chat error: ' || CASE id % 5 WHEN 3 THEN 'ratelimited' ELSE 'code 404' END || ' | Message: Task update' || chr(10) || '* task: ' || title
            || chr(10) || '* status: ' || coalesce(priority, '') || chr(10) || '* due: ' || due AS error FROM tasks WHERE id % 5 > 2"""),
    "delivery_due_again": _tasks_sql("SELECT sha256('chat' || chr(31) || id) AS key, CASE id % 5 WHEN 0 THEN 'pending' ELSE 'failed' END AS state FROM tasks WHERE id % 5 IN (0, 3)"),
    "response_tasks": "SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, '' AS title, '' AS due FROM orders",
    "csv_roundtrip": _tasks_sql("SELECT due::DATE AS day, ' \"' || title || '\", ' || CASE WHEN id % 2 = 0 THEN chr(10) ELSE '' END || due || ' ' AS task, coalesce(status, 'None') AS status, due, priority FROM tasks"),
    "agent_effects": f"""
        WITH mails AS (SELECT conv_id || '-' || turn AS id, conv_id || '-' || turn AS subject, text AS body FROM conversations WHERE role = 'user'),
        parsed AS (SELECT id, {_MARK('(?i)(?:title|subject)[:-]?\\s*(.*)', 'subject')} AS title, {_MARK('(?i)(?:content|body|note)[:-]?\\s*(.*)', 'body')} AS content FROM mails)
        SELECT sha256(channel || chr(31) || id) AS key, channel FROM parsed, (SELECT unnest(['document', 'page', 'mail']) AS channel)
        WHERE NOT contains(title, 'Done') AND NOT contains(content, 'Done')""",
    "mailbox_effects": f"""
        WITH mails AS (SELECT conv_id || '-' || turn AS id, conv_id || '-' || turn AS subject, text AS body, strftime(to_timestamp(conv_id * 1000 + turn + 86400) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day
            FROM conversations WHERE role = 'user' AND conv_id % 7 NOT IN (3, 5)),
        parsed AS (SELECT id, day, {_MARK('(?i)(?:title|subject)[:-]?\\s*(.*)', 'subject')} AS title, {_MARK('(?i)(?:content|body|note)[:-]?\\s*(.*)', 'body')} AS content FROM mails)
        SELECT sha256(channel || chr(31) || id) AS key, channel, day FROM parsed, (SELECT unnest(['document', 'page', 'mail']) AS channel)
        WHERE NOT contains(title, 'Done') AND NOT contains(content, 'Done')""",
    "mailbox_letters": """
        SELECT '' AS task_id, 'malformed record' AS error, '{broken ' || conv_id || '-' || turn AS raw FROM conversations WHERE conv_id % 7 = 3
        UNION ALL SELECT '', 'message without id', '{"snippet": "' || conv_id || '-' || turn || '"}' FROM conversations WHERE conv_id % 7 = 5""",
    "outbox_ledger": _tasks_sql("""
        SELECT sha256('chat' || chr(31) || id) AS key, CASE WHEN id % 4 <> 0 THEN due END AS day, CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'sent' END AS state,
            1 AS attempts, CASE WHEN id % 3 = 0 THEN 'late' END AS error FROM tasks"""),
    "nudge_stream": _tasks_sql(f"SELECT id::VARCHAR AS id, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS nudges FROM tasks WHERE {_GUARD}"),
    "keyed_update": _tasks_sql(f"SELECT id, status, CASE WHEN {_GUARD} THEN coalesce(nudges, 0) + 1 ELSE nudges END AS nudges FROM tasks"),
    "schema_inspect": "SELECT 'Priority' AS property, 'select' AS type, o_orderpriority AS option FROM orders GROUP BY 3 UNION ALL SELECT 'Title', 'title', NULL",
    "chat_updates": _tasks_sql("SELECT sha256('chat' || chr(31) || id) AS key, 'chat' AS channel, 'tasks' AS target, 'Task update' || chr(10) || '* task: ' || title || chr(10) || '* status: ' || coalesce(priority, '') || chr(10) || '* due: ' || due AS payload FROM tasks"),
    "listing": _tasks_sql("SELECT concat_ws(' | ', title, status, priority, due) AS line FROM tasks"),
}

_LATELY = "SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%d') AS edited, o_orderstatus AS status, row_number() OVER (PARTITION BY o_orderkey // 400 ORDER BY o_orderkey) AS n FROM orders WHERE (o_orderkey // 400) % 10 NOT IN (3, 7)"
_LOG = "title || ',' || coalesce(assignee, '') || ',' || coalesce(priority, '') || ',' || due || ',' || CASE WHEN assignee IS NULL OR priority IS NULL THEN 'Yes' ELSE 'No' END || chr(10)"

ORACLE_SQL |= {
    "html_bodies": "SELECT o_orderkey AS id, replace([" + ", ".join(f"'{t}'" for _, t in BODIES) + f"][o_orderkey % {len(BODIES)} + 1], 'N', o_orderkey::VARCHAR) AS text FROM orders",
    "delivery_rounds": _tasks_sql("""
        SELECT sha256('chat' || chr(31) || id) AS key, CASE WHEN id % 7 = 0 OR id % 5 = 0 THEN 'failed' ELSE 'sent' END AS state,
            CASE WHEN id % 7 = 0 OR id % 5 = 0 THEN 3 WHEN id % 3 = 0 THEN 2 ELSE 1 END AS attempts,
            CASE WHEN id % 7 = 0 THEN 'ConnectionError: broken off' WHEN id % 5 = 0 THEN 'ratelimited' WHEN id % 3 = 0 THEN 'code 500' END AS error FROM tasks"""),
    "captured_pages": f"SELECT id, edited, status FROM ({_LATELY}) WHERE n <= 20 AND edited >= '1995-06-01'",
    "first_pages": f"SELECT id FROM ({_LATELY}) ORDER BY id LIMIT 50",
    "property_bags": """SELECT o_orderkey::VARCHAR AS id, 'Status' AS property, 'status' AS kind, o_orderstatus AS value FROM orders
        UNION ALL SELECT o_orderkey::VARCHAR, 'Price', 'formula', '{"number":' || regexp_replace(o_totalprice::VARCHAR, '\\.0$', '') || '}' FROM orders""",
    "property_kinds": "SELECT 'Status' AS property, 'status' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'Price', 'formula', count(*) FROM orders",
    "bucketed_update": ORACLE_SQL["keyed_update"],
    "history_alerts": ORACLE_SQL["latest_snapshot_alert_rows"],
    "history_weekly": ORACLE_SQL["weekly_status_pivot"],
    "wide_history": " UNION ALL ".join(f"({ORACLE_SQL['metrics_vector'].replace(AS_OF, at)})" for at in WIDE_DAYS),
    "task_log_mail": _tasks_sql(f"""SELECT 1 AS mail, 'log.csv' AS filename, sha256('Title,Assignee,Priority,Due,Needs Review' || chr(10) || string_agg({_LOG}, '' ORDER BY id)) AS log FROM tasks
        UNION ALL SELECT 2, NULL, NULL"""),
    "error_log": f"SELECT *, TRUE AS written, FALSE AS none_written FROM ({ORACLE_SQL['props_dead_letter']})",
    "split_counts": """WITH c AS (SELECT count(*) FILTER (event_id % 50 > 1) AS good, count(*) FILTER (event_id % 50 < 2) AS bad FROM events)
        SELECT 'good' AS kind, good AS n, good, bad FROM c UNION ALL SELECT 'bad', bad, good, bad FROM c""",
    "supervised_poll": "SELECT conv_id || '-' || turn AS id, 'sent' AS state, 3 AS attempts FROM conversations WHERE role = 'user'",
}
