"""Markdown files as a source: whole texts, their front matter, and what changed since the last look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, skip: str = r"/(mem-[0-9a-f]{4}-[^/]*|MEMORY)\.md$") -> DataFrame:
    """``path``, ``text``, ``sha`` of the folder's ``*.md`` files without own projections and the index."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    x = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return x.filter(~F.col("path").rlike(skip)).withColumn("sha", F.sha2("text", 256))


def front_matter(text: Column, key: str) -> Column:
    """A value from the ``---`` block that opens a text, without quotes; null where there is none."""
    head = F.regexp_extract(text, r"\A---[ \t]*\r?\n((?s:.*?))\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    value = F.regexp_extract(head, rf"(?m)^{key}[ \t]*:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
    return F.nullif(value, F.lit(""))


def changes(now: DataFrame, seen: DataFrame) -> DataFrame:
    """``path``, ``change`` (new, changed, deleted) of two listings (``path``, ``sha``): one join by path."""
    x = now.select("path", F.col("sha").alias("_a")).join(seen.select("path", F.col("sha").alias("_b")), "path", "full")
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "changed")
    return x.select("path", change.alias("change")).filter("change is not null")
