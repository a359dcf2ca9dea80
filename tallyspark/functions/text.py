"""Text functions on columns. All but ``html_text`` stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import config

# The markers, separators and date shapes below are those of the mails and task pages.
#: Unicode white space and the four ASCII separators, as a Java class under the U flag.
_BLANK = r"[\s\x1c-\x1f]"
#: Flags i, d, U: ignore case, only \n ends a line, Unicode classes.
_TITLE = r"(?idU)(?:title|subject)[:\-]?\s*(.*)"
_CONTENT = r"(?idU)(?:content|body|note)[:\-]?\s*(.*)"
_DUE = r"due[:\- ]+(\d{4}-\d{2}-\d{2})"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_DATETIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def strip(text: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(text, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def has(text: Column, word: str | Column) -> Column:
    """Whether the lower-cased text holds the word; null counts as empty."""
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), word if isinstance(word, Column) else F.lit(word))


def http_or_null(url: Column) -> Column:
    """The url if it begins with http, else null."""
    return F.when(F.startswith(url, F.lit("http")), url)


def date_part(text: Column) -> Column:
    """What stands before the first T."""
    return F.substring_index(text, "T", 1)


def due_date(text: Column) -> Column:
    """The day of an ISO date or datetime; null for anything else."""
    day = date_part(text)
    return F.when(day.rlike(_DATE), day.try_cast("date"))


def due_time(text: Column) -> Column:
    """The time of an ISO date or datetime, in the session's zone if it names none; null for anything else."""
    return F.when(text.rlike(_DATETIME), text.try_cast("timestamp"))


def _marked(body: Column, pattern: str, fallback: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    return F.when(body.rlike(pattern), F.regexp_extract(body, pattern, 1)).otherwise(strip(F.coalesce(fallback, F.lit(""))))


def command_title(subject: Column, body: Column) -> Column:
    """The line behind the first title or subject marker of the body, else the stripped subject."""
    return _marked(body, _TITLE, subject)


def command_content(body: Column) -> Column:
    """The line behind the first content, body or note marker, else the stripped body."""
    return _marked(body, _CONTENT, body)


def due_in_text(text: Column) -> Column:
    """The date behind ``due`` and separators, as text; null if there is none."""
    return F.nullif(F.regexp_extract(text, _DUE, 1), F.lit(""))


def keyword_tags(text: Column, keywords: Sequence[str] = config.TAG_KEYWORDS) -> Column:
    """The keywords that the text holds, in their order (X11)."""
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: has(text, k))


def trigger_tags(text: Column, triggers: Sequence[tuple[str, Sequence[str]]] = config.TAG_TRIGGERS) -> Column:
    """``{name}`` of each tag of which the text holds a keyword, in the triggers' order."""
    table = F.array(*(F.struct(F.lit(tag).alias("tag"), F.array(*map(F.lit, words)).alias("words")) for tag, words in triggers))
    hit = F.filter(table, lambda t: F.exists(t["words"], lambda w: has(text, w)))
    return F.transform(hit, lambda t: F.struct(t["tag"].alias("name")))


def priority_in_text(text: Column, priorities: Sequence[str] = config.PRIORITIES, default: str = "Medium") -> Column:
    """The first priority that the text names, in the list's order."""
    out = F.lit(default)
    for p in reversed(priorities):
        out = F.when(has(text, p.lower()), F.lit(p)).otherwise(out)
    return out


def routed(text: Column, routes: Sequence[tuple[str, str]], default: str) -> Column:
    """The agent of the first keyword that the text holds."""
    out = F.lit(default)
    for word, agent in reversed(routes):
        out = F.when(has(text, word), F.lit(agent)).otherwise(out)
    return out


def day_text(as_of: Column) -> Column:
    return F.date_format(as_of, "yyyy-MM-dd")


def stamp_text(as_of: Column) -> Column:
    return F.date_format(as_of, "yyyyMMdd-HHmmss")


def days_later(as_of: Column, days: int = 3) -> Column:
    """The day so many days after ``as_of``."""
    return F.date_add(as_of.cast("date"), days)


def from_base64url(data: Column) -> Column:
    """UTF-8 text of base64url data."""
    return F.decode(F.unbase64(F.translate(data, "-_", "+/")), "UTF-8")


def to_base64url(text: Column) -> Column:
    """base64url of UTF-8 text, without line breaks."""
    return F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", ""), "+/", "-_")


def review_tags(status: Column, priority: Column, assignee: Column) -> Column:
    """``{name}`` tags for tasks without assignee or priority, and without status."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    names = F.array_compact(F.array(F.when(blank(assignee) | blank(priority), F.lit("Needs Review")), F.when(blank(status), F.lit("Unsorted"))))
    return F.transform(names, lambda n: F.struct(n.alias("name")))


def incremented(n: Column) -> Column:
    """One more, where null is 0."""
    return F.coalesce(n, F.lit(0)) + 1


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


class _Visible(HTMLParser):
    """Collects text, but not that of scripts and styles; comments and declarations don't count as text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Visible()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


def _visible_texts(html: pd.Series) -> pd.Series:
    return html.map(visible_text, na_action="ignore")


def html_text(html: Column | str) -> Column:
    """The text of HTML, entities decoded, without comments, doctype, scripts and styles."""
    return F.pandas_udf(_visible_texts, T.StringType())(html)
