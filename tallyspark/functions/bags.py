"""Property bags of any kind, as variants: kinds that no schema foresees are listed and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag(json: Column) -> Column:
    """A page's properties as a variant; null where the text is no JSON or has none."""
    return F.try_variant_get(F.try_parse_json(json), "$.properties", "variant")


def kind(prop: Column) -> Column:
    """A property's kind: its ``type`` if it says one, else its one field that isn't ``id``."""
    fields = F.map_keys(F.try_variant_get(prop, "$", "map<string, variant>"))
    rest = F.filter(fields, lambda k: ~k.isin("id", "type"))
    return F.coalesce(F.try_variant_get(prop, "$.type", "string"), F.when(F.size(rest) == 1, rest[0]))


def value(prop: Column) -> Column:
    """What a property holds, as a variant: the field that its kind names."""
    return F.try_variant_get(prop, "$", "map<string, variant>")[kind(prop)]


def shown(v: Column) -> Column:
    """A value as text: plain texts and numbers as they are, options by their name, spans and lists joined, the rest as JSON."""
    one = lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$.plain_text", "string"), F.try_variant_get(x, "$.text.content", "string"), F.try_variant_get(x, "$.start", "string"))
    many = F.try_variant_get(v, "$", "array<variant>")
    plain = F.when(~F.schema_of_variant(v).startswith("OBJECT") & ~F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "string"))
    listed = F.array_join(F.transform(many, lambda x: F.coalesce(one(x), F.to_json(x))), ", ")
    return F.coalesce(plain, one(v), listed, F.when(~F.is_variant_null(v), F.to_json(v)))


def properties(pages: DataFrame, json: str = "page", *keep: str) -> DataFrame:
    """(keep, property, kind, value) of every property of every page."""
    rows = pages.select(*keep, bag(F.col(json)).alias("_bag")).filter("_bag IS NOT NULL")
    each = rows.select(*keep, F.explode(F.try_variant_get(F.col("_bag"), "$", "map<string, variant>")).alias("property", "_of"))
    return each.select(*keep, "property", kind(F.col("_of")).alias("kind"), shown(value(F.col("_of"))).alias("value"))


def listed_kinds(pages: DataFrame, json: str = "page") -> DataFrame:
    """(property, kind, n): the kinds that each property has in these pages, and how often."""
    return properties(pages, json).groupBy("property", "kind").agg(F.count(F.lit(1)).alias("n"))
