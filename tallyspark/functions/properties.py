"""Values of task properties (``schemas.PROPERTY``), null-safe at every level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import text


def prop(name: str, bag: str = "properties") -> Column:
    """One property of the bag; null if it isn't there."""
    return F.try_element_at(F.col(bag), F.lit(name))


def select_name(name: str, default: str = "", stripped: bool = True) -> Column:
    """Name of a select (P1; P6 without strip)."""
    value = F.coalesce(prop(name)["select"]["name"], F.lit(default))
    return text.strip(value) if stripped else value


def status_name(name: str, default: str = "") -> Column:
    """Name of a status, or of a select where only that is there."""
    return F.coalesce(prop(name)["status"]["name"], prop(name)["select"]["name"], F.lit(default))


def first_span(spans: Column, default: str) -> Column:
    """Text of the first span (L3)."""
    span = F.get(spans, F.lit(0))
    return F.coalesce(span["text"]["content"], span["plain_text"], F.lit(default))


def title(name: str, default: str = "Untitled") -> Column:
    """First span of a title."""
    return first_span(prop(name)["title"], default)


def rich_text(name: str, default: str = "") -> Column:
    """First span of a rich text."""
    return first_span(prop(name)["rich_text"], default)


def date_start(name: str) -> Column:
    """Start of a date as text; null if there is none."""
    return prop(name)["date"]["start"]


def people(name: str) -> Column:
    """Names of people, "" for one without a name; a select's name where only that is there (P5)."""
    chosen = F.when(prop(name)["select"]["name"].isNotNull(), F.array(prop(name)["select"]["name"]))
    named = F.transform(prop(name)["people"], lambda p: F.coalesce(p["name"], F.lit("")))
    return F.coalesce(named, chosen, F.array().cast("array<string>"))


def choices(name: str) -> Column:
    """Names of a multi-select; a select's name where only that is there."""
    one = F.when(prop(name)["select"]["name"].isNotNull(), F.array(prop(name)["select"]["name"]))
    return F.coalesce(F.transform(prop(name)["multi_select"], lambda p: p["name"]), one, F.array().cast("array<string>"))


def number(name: str) -> Column:
    """A number, 0 for null."""
    return F.coalesce(prop(name)["number"], F.lit(0))


def header(name: str, headers: str = "headers") -> Column:
    """Value of the first mail header of exactly this name, else "" (P11)."""
    return F.coalesce(F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"], F.lit(""))


def plain_body(parts: str = "parts") -> Column:
    """Decoded text of the last plain part that has data, else "" (P12, P13, F12)."""
    full = F.filter(parts, lambda p: (p["mimeType"] == "text/plain") & (F.coalesce(p["body"]["data"], F.lit("")) != ""))
    return F.coalesce(text.from_base64url(F.try_element_at(full, F.lit(-1))["body"]["data"]), F.lit(""))
