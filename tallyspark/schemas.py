"""Schemas of task pages, snapshots, mail and outbox rows, as DDL strings."""

SPAN = "STRUCT<plain_text: STRING, text: STRUCT<content: STRING>>"
NAMED = "STRUCT<name: STRING>"
#: One property of a task page: all kinds side by side, the absent ones null.
PROPERTY = f"STRUCT<title: ARRAY<{SPAN}>, rich_text: ARRAY<{SPAN}>, status: {NAMED}, `select`: {NAMED}, multi_select: ARRAY<{NAMED}>, people: ARRAY<{NAMED}>, date: STRUCT<start: STRING>, number: BIGINT, checkbox: BOOLEAN, url: STRING>"
PAGE = f"id STRING, properties MAP<STRING, {PROPERTY}>"
PAGES = f"results ARRAY<STRUCT<id: STRING, properties: MAP<STRING, {PROPERTY}>>>"
TASK = "title STRING, summary STRING, status STRING, assignee ARRAY<STRING>, due STRING, priority STRING, tags ARRAY<STRING>, project STRING"
SNAPSHOT = "Date DATE, Task STRING, Status STRING, Due STRING, Priority STRING"
TASK_LOG = "Title STRING, Assignee STRING, Priority STRING, Due STRING, `Needs Review` STRING"
ERRORS = "task_id STRING, error STRING"
#: A dead letter with its raw text; the key tells its record apart from all others.
LETTER = f"key STRING, {ERRORS}, raw STRING"
MESSAGE = "id STRING, sender STRING, recipient STRING, unread BOOLEAN, received TIMESTAMP_NTZ, snippet STRING, headers ARRAY<STRUCT<name: STRING, value: STRING>>, parts ARRAY<STRUCT<mimeType: STRING, body: STRUCT<data: STRING>>>"
HTML_MAIL = "subject STRING, body STRING"
OUTBOX = "key STRING, channel STRING, target STRING, payload STRING"
REPORT = "key STRING, at TIMESTAMP_NTZ, code INT, error STRING"
#: What one table holds of effects and attempts; ``commit``, ``kind`` and ``month`` (the first day of the day's) are folders.
LEDGER = f"{OUTBOX}, at TIMESTAMP_NTZ, code INT, error STRING, day DATE, commit STRING, kind STRING, month DATE"
