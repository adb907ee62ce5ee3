"""Units of the input that travel as single values, and tables written on the way."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import arrow

UNIT, LEVEL = 8 << 20, 6  #: bytes of text in a unit (or one longer text), and how hard they are compressed, as units may be exchanged more than once


def saved(df: DataFrame) -> DataFrame:
    """``df``, written to the shared checkpoint folder and read again: lineage is cut and nothing is computed twice. The folder goes when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/lorekeep-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a session within one process, as in tests, may do without: it has one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def units(docs: DataFrame, size: int = UNIT, columns: tuple[str, ...] = ("doc_id", "text"), change: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """``unit``, ``bytes``, ``blob``: rows (``columns``, one of them ``text``), compressed, ``size`` bytes of text in each value or one longer text.

    They are written once, so a unit is the same whenever it is read, however tasks are made up and whatever executors are lost. ``change`` is put to a
    few MB of rows at a time before; a ``mapInArrow`` of its own would take a second Python worker in every task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def unit() -> pa.RecordBatch:
            blob = arrow.pack(pa.Table.from_batches(held).combine_chunks(), LEVEL)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["unit", "bytes", "blob"])

        rows = batches if change is None else map(change, arrow.slices(batches))
        for rb in arrow.slices(rows, size=min(size, arrow.SLICE)):
            if held and n + rb["text"].nbytes > size:
                yield unit()
                held, n = [], 0
            # A copy, as a slice keeps its whole batch.
            held.append(arrow.copied(rb))
            n += rb["text"].nbytes
        if held:
            yield unit()

    return saved(docs.select(*columns).mapInArrow(run, "unit long, bytes long, blob binary"))


def opened(blob: pa.Scalar | bytes, size: int = arrow.SLICE) -> list[pa.RecordBatch]:
    """A unit's rows, a few MB at a time."""
    return list(arrow.slices(iter(arrow.unpack(blob if isinstance(blob, bytes) else blob.as_py()).to_batches()), size=size))
