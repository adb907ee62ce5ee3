"""Agent transcripts: lines of JSON in one of three wire formats become blocks of text.

Each reader takes a DataFrame with ``line`` and any other columns (say a file and a line number), which it keeps, and adds ``block`` and
``text``. Lines that don't parse, empty texts and thinking are left out. Parsing is done by Spark's variant and JSON functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "type string, text string, name string, input string, content string"


def _items(content: Column) -> Column:
    """A variant that is a text or a list of items, as a list of items."""
    many = F.schema_of_variant(content).startswith("ARRAY")
    one = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.try_variant_get(content, "$", "string").alias("text"))), ITEM))
    return F.when(many, F.from_json(F.to_json(content), f"array<struct<{ITEM}>>")).otherwise(one)


def _nested(content: Column) -> Column:
    """The text of a tool's result: itself, or its items' texts by line."""
    inner = F.from_json(content, f"array<struct<{ITEM}>>")
    return F.when(content.startswith("[{"), F.array_join(F.transform(inner, lambda x: x["text"]), "\n")).otherwise(content)


def _exploded(df: DataFrame, role: Column, items: Column) -> DataFrame:
    kept = [c for c in df.columns if not c.startswith("_")]
    x = df.withColumns({"_role": role, "_item": F.explode(items)})
    kind = F.col("_item.type")
    block = F.when(kind.isin("tool_use", "tool_result"), kind).when(kind.isin("text", "input_text", "output_text"), F.when(F.col("_role") == "system", "system").otherwise(F.concat("_role", F.lit("_text"))))
    text = F.when(kind == "tool_use", F.concat_ws(" ", "_item.name", "_item.input")).when(kind == "tool_result", _nested(F.col("_item.content"))).otherwise(F.col("_item.text"))
    return x.withColumns({"block": block, "text": text}).filter("block is not null and trim(text) <> ''").select(*kept, "block", "text")


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_v", F.try_parse_json("line")).drop("line").filter("_v is not null")


def _field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("_v", path, kind)


def cc(lines: DataFrame, sidechains: bool = False) -> DataFrame:
    """``type`` user, assistant or system, with ``message.content`` a text or a list; side chains only on request."""
    x = _parsed(lines).filter(_field("$.type").isin("user", "assistant", "system"))
    x = x if sidechains else x.filter(~F.coalesce(_field("$.isSidechain", "boolean"), F.lit(False)))
    x = x.withColumn("_c", F.try_variant_get("_v", "$.message.content", "variant")).filter("_c is not null")
    return _exploded(x, _field("$.type"), _items(F.col("_c")))


def pi(lines: DataFrame) -> DataFrame:
    """``type`` message, with ``message.role``; aborted turns go."""
    x = _parsed(lines).filter((_field("$.type") == "message") & _field("$.message.role").isin("user", "assistant"))
    x = x.filter(F.coalesce(_field("$.message.stopReason"), F.lit("")) != "aborted")
    x = x.withColumn("_c", F.try_variant_get("_v", "$.message.content", "variant")).filter("_c is not null")
    return _exploded(x, _field("$.message.role"), _items(F.col("_c")))


def codex(lines: DataFrame) -> DataFrame:
    """User messages from events, assistant texts from response items."""
    x = _parsed(lines)
    user = (_field("$.type") == "event_msg") & (_field("$.payload.type") == "user_message")
    answer = (_field("$.type") == "response_item") & (_field("$.payload.type") == "message") & (_field("$.payload.role") == "assistant")
    x = x.filter(user | answer).withColumn("_c", F.coalesce(F.try_variant_get("_v", "$.payload.content", "variant"), F.try_variant_get("_v", "$.payload.message", "variant"))).filter("_c is not null")
    return _exploded(x, F.when(_field("$.type") == "event_msg", "user").otherwise("assistant"), _items(F.col("_c")))


READERS = {"cc": cc, "pi": pi, "codex": codex}
