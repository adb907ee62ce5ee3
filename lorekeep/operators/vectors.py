"""Vector operators. The query side of a search is one vector or a checked number of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.scores import dot

BROADCAST_ROWS = 20_000  #: of the small side of a search, checked where it is used


def unit(df: DataFrame, v: str = "v") -> DataFrame:
    """Vectors scaled to length 1; a zero vector stays zero."""
    n = F.sqrt(dot(F.col(v), F.col(v)))
    return df.withColumn("_n", n).withColumn(v, F.when(F.col("_n") == 0, F.col(v)).otherwise(F.transform(v, lambda x: x / F.col("_n")))).drop("_n")


def top_k(df: DataFrame, query: list[float], k: int = 10, least: float | None = None) -> DataFrame:
    """The k nearest of one query vector by cosine; a wrong dimension gives nothing."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = unit(df.filter(F.size("v") == len(query))).withColumn("sim", dot(F.col("v"), q) / F.lit(sum(x * x for x in query) ** 0.5 or 1.0))
    out = out.filter(F.col("sim") >= least) if least is not None else out
    return out.orderBy(F.desc("sim"), "id").limit(k)


def _cells(left: DataFrame, right: DataFrame, rows: int, best: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], least: float) -> DataFrame:
    """``a``, ``b``, ``w`` of the pairs that ``best`` keeps in each cell: a block of left vectors times a block of right ones, so that no task holds more than two blocks.

    Blocks follow from the counts, so a block's size does not.
    """
    m, n = max(1, -(-left.count() // rows)), max(1, -(-right.count() // rows))
    # The sides have other names for the same columns: they may come from one table, whose columns must not be taken for one another.
    side = lambda d, names, own, k, other, j: d.select(F.col("id").alias(names[0]), F.col("v").alias(names[1]), F.pmod(F.xxhash64("id"), F.lit(k)).alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(j - 1)).cast("array<bigint>")))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not (x.num_rows and y.num_rows):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
        ids, others = x["a"].to_numpy(), y["b"].to_numpy()
        p, q = np.stack(x["p"].to_numpy()), np.stack(y["q"].to_numpy())
        w = np.round(p @ q.T, 9)
        w[ids[:, None] == others[None]] = -2
        # Of equal ones the least id, so columns stand in order of ids.
        order = np.argsort(others)
        i, j = best(w[:, order])
        j = order[j]
        keep = w[i, j] >= least
        return pa.table({"a": ids[i[keep]], "b": others[j[keep]], "w": w[i, j][keep]})

    return side(left, "ap", "i", m, "j", n).groupBy("i", "j").cogroup(side(right, "bq", "j", n, "i", m).groupBy("i", "j")).applyInArrow(run, "a long, b long, w double")


def _top(k: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    def best(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = np.argsort(-w, axis=1, kind="stable")[:, :k]
        return np.repeat(np.arange(len(w)), j.shape[1]), j.ravel()

    return best


def _graph(pairs: DataFrame, k: int) -> DataFrame:
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))).filter(F.col("r") <= k)
    return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"))


def knn_graph(df: DataFrame, k: int = 8, least: float = 0.6, rows: int = 4096) -> DataFrame:
    """Edges ``a`` < ``b``, ``w``: each vector's k nearest others with at least this cosine, once for each pair. Exact: every pair is compared, block by block."""
    u = unit(df.select("id", "v"))
    return _graph(_cells(u, u, rows, _top(k), least), k)


def near_graph(df: DataFrame, size: int, k: int = 8, least: float = 0.6, bits: int = 6, tables: int = 24, seed: int = 7, rows: int = 4096) -> DataFrame:
    """``knn_graph`` among vectors (of ``size`` numbers) that share a cell: the signs of ``bits`` fixed random projections, in any of ``tables``.

    Two vectors at cosine c share a sign with probability 1 - acos(c) / pi, so the recall at c is 1 - (1 - p^bits)^tables: 0.95 at 0.6 for the
    defaults. Add a bit for every doubling of the number of vectors, and tables to keep the recall. A cell of more than ``rows`` is dealt to several.
    """
    planes = np.random.default_rng(seed).standard_normal((tables * bits, size))
    u = unit(df.select("id", "v"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                sign = (np.stack(rb["v"].to_numpy(zero_copy_only=False)) @ planes.T > 0).reshape(rb.num_rows, tables, bits)
                key = (sign * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)
                yield pa.RecordBatch.from_arrays([rb["id"], rb["v"], pa.array(key.tolist(), pa.list_(pa.int64()))], names=["id", "v", "keys"])

    each = u.mapInArrow(keys, "id long, v array<double>, keys array<bigint>").select("id", "v", F.explode("keys").alias("key"))
    parts = each.groupBy("key").agg(F.ceil(F.count("*") / rows).alias("parts"))
    dealt = each.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    upto = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    x = dealt.select(F.col("key").alias("kx"), F.col("id").alias("a"), F.col("v").alias("p"), F.col("own").alias("ix"), F.explode(upto).alias("jx"))
    y = dealt.select(F.col("key").alias("ky"), F.col("id").alias("b"), F.col("v").alias("q"), F.col("own").alias("jy"), F.explode(upto).alias("iy"))

    def run(s: pa.Table, t: pa.Table) -> pa.Table:
        if not (s.num_rows and t.num_rows):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
        ids, others = s["a"].to_numpy(), t["b"].to_numpy()
        w = np.round(np.stack(s["p"].to_numpy()) @ np.stack(t["q"].to_numpy()).T, 9)
        w[ids[:, None] == others[None]] = -2
        i, j = _top(k)(w)
        keep = w[i, j] >= least
        return pa.table({"a": ids[i[keep]], "b": others[j[keep]], "w": w[i, j][keep]})

    pairs = x.groupBy("kx", "ix", "jx").cogroup(y.groupBy("ky", "iy", "jy")).applyInArrow(run, "a long, b long, w double").dropDuplicates(["a", "b"])
    return _graph(pairs, k)


def centroids(df: DataFrame, by: str) -> DataFrame:
    """Mean vector of each group."""
    each = df.select(by, F.posexplode("v").alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def nearest(left: DataFrame, right: DataFrame, rows: int = 4096) -> DataFrame:
    """Of each left (id, v) the most similar right one with another id: ``id``, ``best``, ``sim``. Exact, block by block."""
    p = _cells(unit(left.select("id", "v")), unit(right.select("id", "v")), rows, _top(1), -1.5)
    return p.groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct("w", -F.col("b"))).alias("best"), F.max("w").alias("sim"))
