"""Records from page sources and labelled text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def elements(pages: DataFrame, key: str, html: str, tag: str, attribute: str) -> DataFrame:
    """key, position, value: an attribute of every element with that tag."""
    found = F.regexp_extract_all(html, F.lit(rf'<{tag} {attribute}="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("position", "value"))


def form_fields(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, position, tag, name, label: each input, select and textarea, with the label right before it if there is one of under 100 characters."""
    pattern = r"(?s)(?:<label[^>]*>([^<]{1,99})</label>\s*)?<(input|select|textarea)\b([^>]*)>"
    parts = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "label"), (2, "tag"), (3, "attributes"))])
    return pages.select(key, F.posexplode(parts).alias("position", "_f")).select(key, "position", "_f.tag", F.regexp_extract("_f.attributes", r'\bname="([^"]*)"', 1).alias("name"), F.trim("_f.label").alias("label"))


def labelled(rows: DataFrame, key: str, text: str, pattern: str, group: int) -> DataFrame:
    """key, first_value, last_value of the pattern's group over a text's lines; rows without a match have none."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.col("line").rlike(pattern))
    value = F.regexp_extract("line", pattern, group)
    return lines.groupBy(key).agg(F.min_by(value, "pos").alias("first_value"), F.max_by(value, "pos").alias("last_value"))
