"""Folds over ordered rows that no window function can express: greedy bins with a budget, and runs of equal rows.

A group's rows are sorted within its partition and pass through one at a time, so the memory does not depend on a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: all of Unicode's space separators.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def bins(df: DataFrame, by: str, order: str, size: str, budget: int, same: str | None = None) -> DataFrame:
    """Adds ``bin``, from 0 in each group. A row opens the next bin where the bin's sizes would exceed the budget or, with ``same``, where that column changes.

    A row above the budget has a bin of its own; a null size counts as 0; rows with equal order keep any order.
    """
    names, marks = df.columns, [by, size] + ([same] if same else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kind, used, at, started = None, None, 0, 0, False
        for rb in batches:
            out = []
            cols = [rb[c].to_pylist() for c in marks]
            for row in zip(*cols, strict=True):
                g, n, k = row[0], row[1] or 0, row[2] if same else None
                if not started or g != group:
                    group, kind, used, at, started = g, k, n, 0, True
                elif k != kind or used + n > budget:
                    kind, used, at = k, n, at + 1
                else:
                    used += n
                out.append(at)
            yield pa.RecordBatch.from_arrays([*(rb[c] for c in names), pa.array(out, pa.int64())], names=[*names, "bin"])

    return df.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, StructType([*df.schema.fields]).add("bin", "long"))


def tokens(text: Column) -> Column:
    """A rough count of a text's tokens, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def whole_paragraphs(text: Column) -> Column:
    """What blank lines divide, without spaces of any kind at the ends. Blanks are dropped."""
    # Possessive, as a group that may give back what it took needs a stack as deep as there are blank lines.
    return F.filter(F.transform(F.split(text, r"\n(?:[ \t]*\n)++"), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")


def paragraphs(text: Column, most: int = 1500) -> Column:
    """Blank lines divide paragraphs; those above ``most`` characters are divided after full stops. Blanks are dropped."""
    return F.flatten(F.transform(whole_paragraphs(text), lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.filter(F.split(p, "(?<=[。.])"), lambda x: F.trim(x) != ""))))


def split_by(items: Column, ends: Column) -> Column:
    """A list cut after the given counts of items; an end beyond the list counts as its length."""
    full = F.array_distinct(F.filter(F.concat(F.transform(ends, lambda e: F.least(e, F.size(items))), F.array(F.size(items))), lambda e: e > 0))
    return F.transform(full, lambda e, i: F.slice(items, F.when(i == 0, 1).otherwise(F.element_at(full, F.when(i == 0, 1).otherwise(i)) + 1), e - F.when(i == 0, 0).otherwise(F.element_at(full, F.when(i == 0, 1).otherwise(i)))))


def merge_thin(segments: Column, least: int = 2) -> Column:
    """Segments of fewer than ``least`` items join the one before; a thin first one joins the next."""
    step = lambda done, s: F.when(
        (F.size(done) > 0) & ((F.size(s) < least) | ((F.size(done) == 1) & (F.size(F.element_at(done, 1)) < least))),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, F.size(done)), s))),
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(segments, F.slice(segments, 1, 0), step)
