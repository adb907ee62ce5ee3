"""Reading a spool as a stream: complete lines past an offset, retries with a dead-letter table, line watermarks, turns as sessions, and a change feed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import graph

TRIES = 3


def tail(files: DataFrame, seen: DataFrame) -> DataFrame:
    """``path``, ``lines``, ``offset``: the complete lines of each file (``path``, ``content``, bytes) past what was read (``path``, ``offset``), and the new offset. A file that shrank is read anew; a line without its end waits."""
    x = files.join(seen.select("path", F.col("offset").alias("_o")), "path", "left")
    start = F.when(F.col("_o").isNull() | (F.col("_o") > F.octet_length("content")), F.lit(0)).otherwise(F.col("_o"))
    x = x.withColumn("_o", start).withColumn("_new", F.expr("cast(substring(content, cast(_o + 1 as int)) as binary)"))
    x = x.withColumn("_t", F.decode("_new", "utf-8")).withColumn("_whole", F.regexp_extract("_t", r"(?s)\A(.*\n)", 1))
    lines = F.filter(F.split("_whole", "\n", -1), lambda s: F.trim(s) != "")
    return x.select("path", lines.alias("lines"), (F.col("_o") + F.octet_length("_whole")).cast("long").alias("offset"))


def numbered(lines: DataFrame, watermark: DataFrame) -> DataFrame:
    """``stream``, ``n``, ``line`` of the lines (``stream``, ``n``, physical numbers from 1) past each stream's watermark (``stream``, ``done``) that hold JSON; blank and broken lines have a number too."""
    x = lines.join(watermark, "stream", "left").filter(F.col("n") > F.coalesce("done", F.lit(0)))
    return x.filter(F.try_parse_json("line").isNotNull() & (F.trim("line") != "")).select("stream", "n", "line")


def watermark(lines: DataFrame) -> DataFrame:
    return lines.groupBy("stream").agg(F.max("n").alias("done"))


def attempt(jobs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs (``id``, ``tries``) after one more try: those that are done, those that wait, and those that are dead. ``work`` gives ``id`` and ``outcome`` (ok, failed, suspended); a suspended try doesn't count, nor does a job without an answer."""
    x = graph.cut(jobs.join(work(jobs).select("id", "outcome"), "id", "left").withColumn("tries", F.col("tries") + F.when(F.col("outcome") == "failed", 1).otherwise(0)))
    ok = F.coalesce(F.col("outcome"), F.lit("suspended")) == "ok"
    dead = ~ok & (F.col("tries") >= TRIES)
    return tuple(x.filter(f).drop("outcome") for f in (ok, ~ok & ~dead, dead))


def turns(events: DataFrame) -> DataFrame:
    """``conv_id``, ``scene``, ``n``, ``first_turn``, ``last_turn`` of closed turns of a stream (``conv_id``, ``turn``, ``role``): a turn ends with the assistant's text, not with a gap.

    What is open is held in state for each conversation, across batches.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        scene, n, first = state.get if state.exists else (0, 0, -1)
        out = []
        for row in pd.concat(list(batches)).sort_values("turn").itertuples():
            first = row.turn if n == 0 else first
            n += 1
            if row.role == "assistant":
                out.append((key[0], scene, n, first, row.turn))
                scene, n, first = scene + 1, 0, -1
        state.update((scene, n, first))
        yield pd.DataFrame(out, columns=["conv_id", "scene", "n", "first_turn", "last_turn"])

    kinds = "conv_id long, scene long, n long, first_turn long, last_turn long"
    return events.groupBy("conv_id").applyInPandasWithState(step, kinds, "scene long, n long, first long", "append", "NoTimeout")


def run(spark: SparkSession, stream: DataFrame, kinds: str, mode: str = "append", anchor: bool = False) -> DataFrame:
    """All rows that a stream gives until its source is exhausted, as a table. With ``anchor`` the first batch only marks where to begin: history is skipped."""
    base = graph.scratch(spark, "spool")
    spark.createDataFrame([], kinds).write.parquet(f"{base}/out")

    def keep(batch: DataFrame, epoch: int) -> None:
        if not (anchor and epoch == 0):
            batch.write.mode("append").parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(kinds).parquet(f"{base}/out")


def files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a stream, whether it is one file or many."""
    own = spark.read.parquet(f"{folder}/{name}.parquet")
    single = all(f.endswith(f"/{name}.parquet") for f in own.inputFiles())
    reader = spark.readStream.schema(own.schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def feed(changes: DataFrame, since: int, quiet: int) -> DataFrame:
    """``burst``, ``first``, ``last``, ``n`` of commits (``at``, milliseconds) past a cursor: commits less than ``quiet`` apart are one notification."""
    parts = changes.filter(F.col("at") > since).withColumn("_p", F.floor(F.col("at") / 3_600_000))
    w = Window.partitionBy("_p").orderBy("at")
    # An hour's commits are compared within it; its first one with the last of the hours before, of which there is one row each.
    ends = parts.groupBy("_p").agg(F.max("at").alias("_end"))
    before = ends.select(F.col("_p"), F.lag("_end").over(Window.partitionBy(F.lit(1)).orderBy("_p")).alias("_before"))
    x = parts.withColumn("_prev", F.lag("at").over(w)).join(before, "_p").withColumn("_prev", F.coalesce("_prev", "_before"))
    starts = x.withColumn("_new", (F.col("_prev").isNull() | (F.col("at") - F.col("_prev") >= quiet)).cast("long"))
    per = starts.groupBy("_p").agg(F.sum("_new").alias("_k"))
    base = per.select("_p", F.coalesce(F.sum("_k").over(Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    y = starts.join(base, "_p").withColumn("burst", F.col("_base") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return y.groupBy("burst").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
