"""Text functions on hand-made texts, each with its expected values."""

from pyspark.sql import functions as F

from tallyspark.functions import text

#: (subject, body, stripped subject, title, content, due, tags, priority)
CASES = [
    ("  Hi  ", "Title: buy milk\nContent: two litres", "Hi", "buy milk", "two litres", None, [], "Medium"),
    (" s ", "no marker", "s", "s", "no marker", None, [], "Medium"),
    ("s", "subject:\nnext line", "s", "next line", "subject:\nnext line", None, [], "Medium"),
    ("s", "TITLE - x\r\ny", "s", "- x\r", "TITLE - x\r\ny", None, [], "Medium"),
    ("", "overdue 2024-01-01 due: 2024-02-03", "", "", "overdue 2024-01-01 due: 2024-02-03", "2024-01-01", [], "Medium"),
    ("s", "Due: 2024-01-01", "s", "s", "Due: 2024-01-01", None, [], "Medium"),
    ("s", "due--- 2025-99-99", "s", "s", "due--- 2025-99-99", "2025-99-99", [], "Medium"),
    ("s", "it is below the line", "s", "s", "it is below the line", None, [], "Low"),
    ("\t", "note body:  text ", "", "", "body:  text ", None, [], "Medium"),
    ("x", "subtitle:done", "x", "done", "subtitle:done", None, [], "Medium"),
    ("s", "contentment", "s", "s", "ment", None, [], "Medium"),
    ("s", "title", "s", "", "title", None, [], "Medium"),
    ("s", "", "s", "s", "", None, [], "Medium"),
    ("\x1c a \x1f", "HIGH and low", "a", "a", "HIGH and low", None, [], "High"),
    ("\u00a0é\u2003", "\u00a0Growth for the CLIENT\u2028", "é", "é", "Growth for the CLIENT", None, ["growth", "client"], "Medium"),
    ("s", "title\u00a0 a\u2003b\nsubject: c", "s", "a\u2003b", "title\u00a0 a\u2003b\nsubject: c", None, [], "Medium"),
    ("s", "urgent: marketing, medium; body- x due 2024-05-06", "s", "s", "x due 2024-05-06", "2024-05-06", ["marketing", "urgent"], "Medium"),
    ("s", "İ note:y", "s", "s", "y", None, [], "Medium"),
]


def test_texts(spark):
    s, b = F.col("s"), F.col("b")
    got = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CASES)], "i int, s string, b string").select(
        "i", text.strip(s).alias("strip"), text.command_title(s, b).alias("title"), text.command_content(b).alias("content"), text.due_in_text(b).alias("due"),
        text.keyword_tags(b).alias("tags"), text.priority_in_text(b).alias("priority"), text.from_base64url(text.to_base64url(b)).alias("again"),
    )
    for r in got.collect():
        assert (r.strip, r.title, r.content, r.due, r.tags, r.priority) == CASES[r.i][2:], CASES[r.i]
        assert r.again == CASES[r.i][1]


def test_nulls_and_dates(spark):
    rows = [("2024-02-29",), ("2023-02-29",), ("2024-02-29T10:11:12+02:00",), ("20240229",), ("2024",), (" 2024-02-29",), ("",), (None,)]
    got = spark.createDataFrame(rows, "d string").select("d", text.due_date(F.col("d")).cast("string").alias("day"), text.due_time(F.col("d")).cast("string").alias("time"), text.command_title(F.col("d"), F.lit(None)).alias("title"), text.priority_in_text(F.lit(None).cast("string")).alias("p")).collect()
    assert [r.day for r in got] == ["2024-02-29", None, "2024-02-29", None, None, None, None, None]
    assert got[2].time == "2024-02-29 08:11:12" and got[1].time is None
    assert got[-1].title == "" and got[-1].p == "Medium"


def test_triggers_routes_and_tags(spark):
    df = spark.createDataFrame([("Python lesson, please APPROVE", "", None, "a"), ("nothing", "Done", "High", "b"), (None, None, "Low", None)], "t string, s string, p string, a string")
    r = df.select(text.trigger_tags(F.col("t")).alias("tags"), text.routed(F.col("t"), (("approve", "owner"),), "default").alias("agent"), text.review_tags(F.col("s"), F.col("p"), F.col("a")).alias("review"), text.http_or_null(F.lit("https://x")).alias("u"), text.basename(F.lit("/a/b.csv")).alias("n")).collect()
    names = lambda x: [y["name"] for y in x]
    assert [names(x.tags) for x in r] == [["course", "tech"], [], []]
    assert [x.agent for x in r] == ["owner", "default", "default"]
    assert [names(x.review) for x in r] == [["Needs Review", "Unsorted"], [], ["Needs Review", "Unsorted"]]
    assert r[0].u == "https://x" and r[0].n == "b.csv"


def test_html(spark):
    html = "<!DOCTYPE html><!-- c --><p>a &amp; b<script>var t='</p>';</script><style>p{}</style> c</p>"
    got = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(text.html_text("h").alias("t")).collect()
    assert [r.t for r in got] == ["a & b c", None, ""]
