"""Graph, similarity, ingest and stream operators on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import extract
from lorekeep.operators import changes, fused, graph, ingest, tagtree, vectors
from lorekeep.streaming import spool


def cliques(spark, sizes, bridge=1.0):
    rows, at = [], 0
    for n in sizes:
        rows += [(at + i, at + j, 1.0) for i in range(n) for j in range(i + 1, n)]
        at += n
    firsts = [sum(sizes[:k]) for k in range(len(sizes))]
    rows += [(a, b, bridge) for a, b in zip(firsts, firsts[1:], strict=False)]
    return spark.createDataFrame(rows, "a long, b long, w double")


def test_louvain_finds_cliques_and_levels_shrink(spark):
    e = cliques(spark, [5, 5, 4])
    got = {r["id"]: r["community"] for r in tagtree.louvain(e).collect()}
    assert [len({got[i] for i in part}) for part in (range(5), range(5, 10), range(10, 14))] == [1, 1, 1] and len(set(got.values())) == 3
    q = tagtree.modularity(e, tagtree.louvain(e)).first()["q"]
    assert q > tagtree.modularity(e, graph.degrees(e).select("id", F.lit(0).alias("community"))).first()["q"] == pytest.approx(0)
    assert tagtree.levels(e, more_than=0).agg(F.max("level")).first()[0] >= 1
    assert tagtree.louvain(e, least=5).select("community").distinct().count() == 2


def test_centrality_converges(spark):
    e = cliques(spark, [4, 3])
    r = {x["id"]: x["rank"] for x in graph.centrality(e).collect()}
    assert max(r.values()) == 1.0 and r[0] == 1.0 and r[1] == pytest.approx(r[2])
    f = spark.createDataFrame([("f", 0, 1), ("g", 9, None)], "id string, subject_id long, object_id long")
    assert {x["id"]: x["centrality"] for x in graph.fact_centrality(f, graph.centrality(e)).collect()} == {"f": 1.0, "g": 0.0}


def test_near_graph_has_the_recall_it_promises(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 32))
    v = np.repeat(base, 5, axis=0) + 0.45 * rng.standard_normal((300, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    pairs = lambda g: {(r["a"], r["b"]) for r in g.collect()}
    exact, near = pairs(vectors.knn_graph(df, 4, 0.6, rows=64)), pairs(vectors.near_graph(df, 32, 4, 0.6, rows=64))
    assert len(exact) > 300 and len(exact & near) / len(exact) >= 0.9
    assert pairs(vectors.knn_graph(df, 4, 0.6)) == exact


def test_merges_see_the_batch(spark):
    unit = lambda c: [c, math.sqrt(1 - c * c), 0.0]
    old = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "id long, v array<double>")
    new = spark.createDataFrame([(10, unit(0.95)), (11, unit(0.85)), (12, [0.0, 0.0, 1.0]), (13, [0.0, 0.1, 1.0])], old.schema)
    got = {r["id"]: (r["verdict"], r["other"]) for r in tagtree.merged_near(new, old).collect()}
    assert got == {10: ("merge", 1), 11: ("edge", 1), 12: ("new", None), 13: ("merge", 12)}


def test_predicates_gather(spark):
    raws = [("uses", [1.0, 0.0]), ("likes_it", [0.9, 0.1]), ("likes_that", [0.8, 0.2]), ("eats", [0.0, 1.0]), ("zero", [0.0, 0.0])]
    assert tagtree.predicate_groups(raws, core=("uses",)) == {"uses": "uses", "likes_it": "likes_it", "likes_that": "likes_it", "eats": "eats", "zero": "zero"}


def test_gate_is_all_or_nothing(spark):
    c = spark.createDataFrame([(1, False), (2, True), (3, True)], "id long, wing boolean")
    v = lambda rows: spark.createDataFrame(rows, "id long, keep boolean")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(fused.gate(c, v([(2, True), (3, False)]))) == [1, 2]
    assert ids(fused.gate(c, v([(2, True)]))) == [1] and ids(fused.gate(c, None)) == [1]
    assert ids(fused.gate(c, v([(2, True), (3, True), (9, True)]))) == [1]


def test_judges_answer_for_all_or_none(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    full, short = (lambda r: r.withColumn("score", F.col("id") / 2)), (lambda r: r.filter("id = 1").withColumn("score", F.lit(1.0)))
    scores = lambda j: sorted((r["id"], r["score"]) for r in tagtree.judged(rows, j).collect())
    assert scores(full) == [(1, 0.5), (2, 1.0)] and scores(short) == [(1, None), (2, None)] and scores(None) == [(1, None), (2, None)]


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    sha = lambda s: __import__("hashlib").sha256(s.encode()).hexdigest()
    cache = spark.createDataFrame([(sha("a"), [5.0, 5.0]), (sha("b"), [1.0])], "key string, v array<double>")
    got, every = tagtree.embedded(texts, cache, lambda ts: [[float(len(t)), 0.0] for t in ts], 2)
    assert {r["key"]: r["v"] for r in got.collect()} == {sha("a"): [5.0, 5.0], sha("b"): [1.0, 0.0]} and every.count() == 2


def test_gaps(spark):
    s = spark.createDataFrame([(1, i, 0.9 if i == 2 else 0.1 + i / 1000) for i in range(40)], "doc long, at long, p double")
    got = sorted(r["at"] for r in tagtree.gap_bounds(s).collect())
    assert got[0] == 2 and len(got) == 3


def test_resolution_by_a_judge(spark):
    e = spark.createDataFrame([("1", "Alpha", ["al"], 2), ("2", "alpha", [], 1), ("3", "Beta", ["AL"], 1)], "id string, name string, aliases array<string>, created_at int")
    n = spark.createDataFrame([("ALPHA", "x"), ("al", "x"), ("gamma", "x"), ("delta", "x")], "name string, entity_type string")
    near = spark.createDataFrame([("gamma", "3", 0.6), ("delta", "3", 0.4)], "name string, id string, confidence double")
    assert {r["name"]: (r["id"], r["how"]) for r in ingest.resolve(n, e, near).collect()} == {"ALPHA": ("2", "name"), "al": ("3", "alias"), "gamma": ("3", "judge"), "delta": (None, "create")}
    assert {r["surface"]: r["id"] for r in ingest.dictionary(e).collect()} == {"alpha": "2", "al": "3", "beta": "3"}


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(extract.mask_code(F.lit("a\n```py\nx\n```\nb = 1\nsee x.py\ngit add\nend"))) == "a\n     \n \n   \n     \n        \n       \nend"
    assert one(extract.mask_code(F.lit("~~~\nopen"))) == "   \n    "
    assert [r["name"] for r in one(extract.entities(F.lit('Big Cat saw "two words" in camelCase and snake_case, XMLFile A.Bc 用 Spark 做')))][:3] == ["Big Cat", "two words", "A.Bc"]
    assert [tuple(r) for r in one(extract.relations(F.lit("引擎使用了缓存")))] == [("引擎", "uses", "缓存")]
    assert one(extract.cleanse(F.lit("<system-reminder>x</system-reminder>\n\n\n\n<command-name>/go</command-name> "), "cc")) == "/go"
    with pytest.raises(ValueError):
        extract.cleanse(F.lit(""), "nobody")
    assert [one(extract.whole_word(F.lit(t), F.lit("c++"))) for t in ("use C++ now", "c++x", "")] == [True, False, False]
    assert [one(extract.verbatim(F.lit(e), F.lit("the **bold** `x`  y"))) for e in ("bold x y", "the  **bold**", "bald")] == [True, True, False]
    assert one(extract.salvaged_json(F.lit('x [{"a": 1}, {"b": 2}] y'))) == ['{"a":1}', '{"b":2}']
    assert one(extract.yaml_scalar(F.lit('a: "b"'))) == '"a: \\"b\\""'


def test_spool(spark):
    files = spark.createDataFrame([("new", b"a\nb\npart"), ("grown", b"12345\nxy\n"), ("shrunk", b"z\n")], "path string, content binary")
    seen = spark.createDataFrame([("grown", 6), ("shrunk", 50)], "path string, offset int")
    assert {r["path"]: (r["lines"], r["offset"]) for r in spool.tail(files, seen).collect()} == {"new": (["a", "b"], 4), "grown": (["xy"], 9), "shrunk": (["z"], 2)}
    jobs = spark.createDataFrame([(1, 0), (2, 2), (3, 2), (4, 2)], "id long, tries int")
    out = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "suspended")], "id long, outcome string")
    done, waiting, dead = (sorted((r["id"], r["tries"]) for r in x.collect()) for x in spool.attempt(jobs, lambda _: out))
    assert (done, waiting, dead) == ([(1, 0)], [(3, 2), (4, 2)], [(2, 3)])


def test_export(spark, tmp_path):
    n = spark.createDataFrame([(1, ["x"])], "id long, aliases array<string>")
    changes.export(n, cliques(spark, [3]), f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/edges.csv").count() == 3 and spark.read.json(f"file://{tmp_path}/out/nodes.json").first()["aliases"] == ["x"]
