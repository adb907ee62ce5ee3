"""Near-duplicates: b-bit MinHash signatures, a multi-index Hamming join, and confirmation on full shingle sets.

A text's set holds its distinct five-word shingles. Texts with equal sets form a class, and only its smallest document goes on. A signature
has WIDE minima of BITS bits. The first SIZE of them stand in chunks of three: two signatures that differ in at most RADIUS of these differ,
by pigeonhole, in at most one of some chunk; so each chunk is indexed once for every single one left out, and all pairs within RADIUS meet
under some key. Pairs that meet stay candidates while they differ in at most FAR of all WIDE. Sets with similarity 0.75 differ in a quarter
on average; more than RADIUS has a chance of 1.4e-7 there, more than FAR of 2.6e-8, and both less above.

Pairs within a key are not listed. First every class is compared with the smallest class that it shares a key with, which joins most copies
to one another. Then, in keys where several components still meet, the members outside the largest are compared with the others, in blocks of
bounded size: in one round with the nearest signature of each other component; in the last, all that still meet another component are tested
on full sets with all of its members. Every link between different components that the keys can show is tested on the full sets, so no cap or sample decides anything.

Classes, not ids, are what is linked, so null ids and ids that several texts share do no harm.

Defined results: texts of one to four words have one shingle, the whole; a null text or one without words has an empty set and is linked
with nothing (its component is its own id); repeated rows are one class; rows that share an id with different texts are documents of their
own; a null id is larger than all others, and a component of null ids alone is null; ``kept`` holds where id and component agree, nulls
too, so all rows with that id keep it, while ``keep_one`` keeps one row of each component (of equal smallest ids any one, and every row with an
empty set); a very long text is taken whole, by itself; other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lorekeep.llm import arrow, blocks, graph

SHINGLE, PERCENT = 5, 75
SIZE, WIDE, CHUNK, BITS = 36, 128, 3, 16
RADIUS, FAR = 2 * (SIZE // CHUNK) - 1, 60
LEFT, RIGHT = 512, 4096  #: rows of a key that meet in one task
HELD = 1 << 20  #: shingles of full sets on each side of a cell, or one larger set
_ODD = (np.random.default_rng(7).integers(0, 1 << 63, WIDE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = np.random.default_rng(8).integers(0, 1 << 63, WIDE, dtype=np.uint64)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within each; text i has those from bounds[i] to bounds[i + 1]."""
    words = arrow.Words(texts, lower=True)
    h = words.hashes()
    w, whole = words.windows(SHINGLE, h)
    sets = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= SHINGLE:
            s = np.sort(w[a : b - SHINGLE + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            one = np.array([n], np.uint64)
            for x in h[a:b]:
                one = arrow.mix(one * np.uint64(0x9E3779B97F4A7C15) + x)
            sets.append(one)
        else:
            sets.append(h[:0])
    return np.concatenate(sets) if sets else h, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """WIDE minima, BITS bits of each, of non-empty sets."""
    out = np.empty((len(bounds) - 1, WIDE), "<u2")
    for k in range(WIDE):
        out[:, k] = arrow.mix(np.minimum.reduceat((values ^ _XOR[k]) * _ODD[k], bounds[:-1])) & np.uint64((1 << BITS) - 1)
    return out


def _named(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each of the sets that start at ``at``."""
    return np.add.reduceat(arrow.mix(values), at), np.bitwise_xor.reduceat(arrow.mix(values * np.uint64(0xD1342543DE82EF95) + np.uint64(1)), at)


def sketch(docs: DataFrame, carried: str | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``a`` and ``b`` (bits that name the set), ``sig`` (null for an empty set), and the column ``carried``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in arrow.slices(batches):
            values, bounds = shingles(arrow.utf8(rb["text"]))
            n = np.diff(bounds)
            a, b, sig = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), [None] * len(n)
            full = np.flatnonzero(n)
            if len(full):
                at = bounds[:-1][full]
                a[full], b[full] = _named(values, at)
                for i, s in zip(full.tolist(), signatures(values, np.append(at, bounds[-1])), strict=True):
                    sig[i] = s.tobytes()
            columns = [rb["doc_id"], pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [rb[c] for c in more], names=["doc_id", "n_shingles", "a", "b", "sig", *more])

    more = [carried] if carried else []
    kinds = docs.select(*more).schema
    for c, kind in (("sig", "binary"), ("b", "long"), ("a", "long"), ("n_shingles", "long"), ("doc_id", "long")):
        kinds = StructType([StructField(c, LongType() if kind == "long" else BinaryType()), *kinds.fields])
    return docs.select("doc_id", "text", *more).mapInArrow(run, kinds)


def _keys(classes: DataFrame) -> DataFrame:
    """``key``, ``id``, ``n``: the index entries of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            sig = np.frombuffer(b"".join(rb["sig"].to_pylist()), "<u2").reshape(-1, WIDE)[:, :SIZE].astype(np.int64)
            keys = []
            for c in range(0, SIZE, CHUNK):
                for out in range(CHUNK):
                    x, y = (c + i for i in range(CHUNK) if i != out)
                    keys.append((c + out) << 2 * BITS | sig[:, x] << BITS | sig[:, y])
            n = len(keys)
            ids, sizes = rb["id"].to_numpy(zero_copy_only=False), rb["n"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(ids, n)), pa.array(np.tile(sizes, n))], names=["key", "id", "n"])

    return classes.select("id", "n", "sig").mapInArrow(run, "key long, id long, n long")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``x``, ``y`` whose set sizes allow a link and whose signatures differ in at most FAR minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                s, t = (np.frombuffer(b"".join(rb[c].to_pylist()), "<u2").reshape(-1, WIDE) for c in ("sx", "sy"))
                yield rb.filter(pa.array((s != t).sum(axis=1) <= FAR)).select(["x", "y"])

    x = classes.select(F.col("id").alias("x"), F.col("sig").alias("sx"))
    y = classes.select(F.col("id").alias("y"), F.col("sig").alias("sy"))
    return pairs.join(x, "x").join(y, "y").select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long")


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``id``, ``set``: the full set of each class (``id``, ``a``, ``b``, and ``doc``, a document that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in arrow.slices(batches):
            values, bounds = shingles(arrow.utf8(rb["text"]))
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                a, b = _named(values, bounds[:-1][full])
                sets = [values[x:y].astype("<u8").tobytes() for x, y in zip(bounds[full], bounds[full + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sets, pa.binary())], names=["a", "b", "set"])

    own = docs.join(classes.select("doc").distinct(), F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi").select("doc_id", "text")
    # Of texts that share an id, those of other classes fall away here.
    return own.mapInArrow(run, "a long, b long, set binary").dropDuplicates(["a", "b"]).join(classes.select("a", "b", "id"), ["a", "b"]).select("id", "set")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``x``, ``y`` whose full sets reach PERCENT. The set of x is sent once for every 256 of its pairs, that of y once a pair."""
    parts = pairs.groupBy("x").agg(F.ceil(F.count("*") / 256).alias("parts"))
    dealt = pairs.join(parts, "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")))
    heads = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).join(sets.withColumnRenamed("id", "x"), "x")
    tails = dealt.join(sets.withColumnRenamed("id", "y"), "y")
    rows = heads.select("x", "part", F.lit(None).cast("long").alias("y"), "set").unionByName(tails.select("x", "part", "y", "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, np.zeros(0, "<u8")
        for rb in batches:
            out = []
            for x, part, y, s in zip(*(rb[c].to_pylist() for c in ("x", "part", "y", "set")), strict=True):
                values = np.frombuffer(s, "<u8")
                if y is None:
                    at, head = (x, part), values
                elif at == (x, part) and _similar(head, values):
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.repartition("x", "part").sortWithinPartitions("x", "part", F.asc_nulls_first("y")).mapInArrow(run, "a long, b long")


def _across(shared: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """``x``, ``root``, ``y``: classes that share a key with a likely one of another component ``root``, and the nearest there."""
    rooted = shared.select("key", "id", "n").join(roots.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("most")).filter("m > most")
    mixed = mixed.withColumns({"lefts": F.ceil((F.col("m") - F.col("most")) / LEFT), "rights": F.ceil(F.col("m") / RIGHT)})
    rows = rooted.join(mixed, "key").join(classes.select("id", "sig"), "id").select("key", "id", "n", "root", "sig", "main", "lefts", "rights")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    one = lambda c: F.pmod(F.xxhash64("id", "key"), F.col(c))
    left = rows.filter("root <> main").withColumns({"i": one("lefts"), "side": F.lit(0)}).withColumn("j", F.explode(upto("rights")))
    right = rows.withColumns({"j": one("rights"), "side": F.lit(1)}).withColumn("i", F.explode(upto("lefts")))
    cells = left.unionByName(right).select("key", "i", "j", "side", "id", "n", "root", "main", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for rb in batches:
            key = np.stack([rb[c].to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "side")], axis=1)
            if not len(key):
                continue
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            out = [np.zeros((4, 0), np.int64)]
            ids, n, root, main = (rb[c].to_numpy(zero_copy_only=False) for c in ("id", "n", "root", "main"))
            sig = np.frombuffer(b"".join(rb["sig"].to_pylist()), "<u2").reshape(-1, WIDE)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                cell = tuple(key[a, :3].tolist())
                if key[a, 3] == 0:
                    own = [*(own if cell == at else []), (ids[a:b], n[a:b], root[a:b], sig[a:b])]
                    at = cell
                elif cell == at:
                    for li, ln, lr, ls in own:
                        for k in range(len(li)):
                            ok = (root[a:b] != lr[k]) & (100 * np.minimum(n[a:b], ln[k]) >= PERCENT * np.maximum(n[a:b], ln[k]))
                            near = a + np.flatnonzero(ok)
                            off = (sig[near] != ls[k]).sum(axis=1)
                            near, off = near[off <= FAR], off[off <= FAR]
                            # Each pair counts under the first key that it shares, and once if both sides are outside the main component.
                            own_key = (sig[near, :SIZE] == ls[k][:SIZE]).reshape(-1, SIZE // CHUNK, CHUNK)
                            shares = (own_key.sum(axis=2, keepdims=True) - own_key >= CHUNK - 1).reshape(len(near), SIZE)
                            once = (shares.argmax(axis=1) == cell[0] >> 2 * BITS) & ((root[near] == main[near]) | (ids[near] > li[k]))
                            near, off = near[once], off[once]
                            if len(near) > 1:
                                order = np.lexsort((ids[near], off, root[near]))
                                near, off = near[order], off[order]
                                first = np.concatenate([[True], root[near][1:] != root[near][:-1]])
                                near, off = near[first], off[first]
                            out.append(np.stack([np.full(len(near), li[k]), ids[near], root[near], off]))
            columns = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["x", "y", "root", "off"])

    pairs = cells.mapInArrow(run, "x long, y long, root long, off long")
    return pairs.groupBy("x", "root").agg(F.min_by("y", F.struct("off", "y")).alias("y"))


def _joined(met: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """A link ``a``, ``b`` of every ``x`` of ``met`` with the component ``root`` it met, if there is any.

    The x that met a component and its members go to cells of bounded size with their full sets. Sets are sent once for each cell, never
    for each pair, and one confirmed link of an x leaves a cell, as more of them join nothing else.
    """
    member = classes.select("id", "n", "sig").join(roots.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    size = lambda rows: F.ceil(F.greatest(F.count("*") / rows, F.sum("n") / HELD))
    lefts = met.select(F.col("x").alias("id"), "root").join(member.select("id", "n"), "id").groupBy("root").agg(size(LEFT).alias("lefts"))
    counts = lefts.join(member.groupBy("root").agg(size(RIGHT).alias("rights")), "root")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    one = lambda c: F.pmod(F.xxhash64("id", "root"), F.col(c))
    left = met.select(F.col("x").alias("id"), "root").join(counts, "root").join(member.drop("root"), "id").withColumns({"i": one("lefts"), "side": F.lit(0)})
    right = member.join(counts, "root").withColumns({"j": one("rights"), "side": F.lit(1)})
    left = left.join(sets, "id").withColumn("j", F.explode(upto("rights")))
    right = right.join(sets, "id").withColumn("i", F.explode(upto("lefts")))
    names = ["root", "i", "j", "side", "id", "n", "sig", "set"]
    cells = left.select(names).unionByName(right.select(names)).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}
        for rb in batches:
            if not rb.num_rows:
                continue
            out = []
            sig = np.frombuffer(b"".join(rb["sig"].to_pylist()), "<u2").reshape(-1, WIDE)
            key = np.stack([rb[c].to_numpy(zero_copy_only=False) for c in ("root", "i", "j", "side")], axis=1)
            ids, n, sets_ = rb["id"].to_pylist(), rb["n"].to_numpy(zero_copy_only=False), rb["set"]
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                cell = tuple(key[a, :3].tolist())
                if key[a, 3] == 0:
                    own = own if cell == at else {}
                    at = cell
                    own |= {ids[k]: (int(n[k]), sig[k], np.frombuffer(sets_[k].as_py(), "<u8")) for k in range(a, b)}
                elif cell == at:
                    for x, (m, s, head) in list(own.items()):
                        ok = (100 * np.minimum(n[a:b], m) >= PERCENT * np.maximum(n[a:b], m)) & ((sig[a:b] != s).sum(axis=1) <= FAR)
                        for k in (a + np.flatnonzero(ok)).tolist():
                            if _similar(head, np.frombuffer(sets_[k].as_py(), "<u8")):
                                out.append((x, ids[k]))
                                del own[x]
                                break
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _similar(head: np.ndarray, values: np.ndarray) -> bool:
    both = int((head[np.minimum(np.searchsorted(head, values), len(head) - 1)] == values).sum())
    return 100 * both >= PERCENT * (len(head) + len(values) - both)


def _components(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``a``, ``b``, ``root``, ``component_id`` of every class: a name of its component, and the smallest document there."""
    found = sketches.filter("n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    # Numbers follow the documents: near copies mostly come after what they were made from, which then is the class that others are compared with.
    ordered = (F.asc_nulls_last("doc"), F.asc("a"), F.asc("b"))
    classes = blocks.saved(found.repartitionByRange(*ordered).sortWithinPartitions(*ordered).withColumn("id", F.monotonically_increasing_id()))
    keys = _keys(classes)
    hubs = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.max("id").alias("last")).filter("hub.id < last").select("key", "hub")
    shared = blocks.saved(keys.join(hubs, "key"))
    stars = shared.filter("id > hub.id").filter(f"100 * least(n, hub.n) >= {PERCENT} * greatest(n, hub.n)").groupBy(F.col("id").alias("y")).agg(F.min("hub.id").alias("x")).select("x", "y")
    sets = blocks.saved(_sets(docs, classes.join(shared.select("id").distinct(), "id", "left_semi")))
    roots = graph.forest_roots(_linked(blocks.saved(_likely(stars, classes)), sets))
    for last in (False, True):
        met = blocks.saved(_across(shared, roots, classes))
        if met.isEmpty():
            break
        links = _joined(met, roots, classes, sets) if last else _linked(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), sets)
        roots = graph.components(roots.unionByName(links))
    rooted = classes.join(roots.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("a", "b", "doc", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    return rooted.drop("doc").join(least, "root").select("a", "b", "root", "component_id")


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row of ``docs`` (``doc_id``, ``text``)."""
    docs = docs.select("doc_id", "text")
    sketches = blocks.saved(sketch(docs))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return sketches.join(_components(docs, sketches), ["a", "b"], "left").select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """A row of ``docs`` for each component, of a smallest document, and every row with an empty set; with its own columns."""
    names = docs.columns
    sketches = blocks.saved(sketch(docs.select("doc_id", "text", F.struct("*").alias("_row")), "_row").withColumn("_n", F.monotonically_increasing_id()))
    # Rows have numbers of their own, as ids may be null or repeated.
    least = sketches.filter("n_shingles > 0").join(_components(docs, sketches.drop("_row")), ["a", "b"]).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_n")).alias("one"))
    first = sketches.select("_n", "_row").join(least.select(F.col("one._n").alias("_n")), "_n", "left_semi")
    return first.unionByName(sketches.filter("n_shingles = 0").select("_n", "_row")).select("_row.*").select(*names)
