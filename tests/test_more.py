"""Transcript wire formats, markdown, folds and changes on literal rows."""

import json
import random
import re

import duckdb

from pyspark.sql import functions as F

from lorekeep.functions import extract
from lorekeep.operators import changes, folds, ingest, recall
from lorekeep.plans import registry
from lorekeep.sources import markdown, transcripts


def lines(spark, rows):
    return spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "n int, line string")


def blocks(df):
    return sorted((r["n"], r["block"], r["text"]) for r in df.collect())


def test_cc(spark):
    say = lambda kind, content, **more: {"type": kind, "message": {"role": kind, "content": content}} | more
    rows = [
        say("user", "hello [x]"),
        say("user", "[{odd"),
        "{broken",
        say("assistant", [{"type": "thinking", "thinking": "secret"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "name": "ls", "input": {"a": 1}}]),
        say("user", [{"type": "tool_result", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]),
        say("user", "aside", isSidechain=True),
        say("summary", "no"),
        say("user", "  "),
        {"type": "user"},
    ]
    want = [(0, "user_text", "hello [x]"), (1, "user_text", "[{odd"), (3, "assistant_text", "hi"), (3, "tool_use", 'ls {"a":1}'), (4, "tool_result", "a\nb")]
    assert blocks(transcripts.cc(lines(spark, rows))) == want
    assert (5, "user_text", "aside") in blocks(transcripts.cc(lines(spark, rows), sidechains=True))


def test_pi_and_codex(spark):
    say = lambda role, text, stop=None: {"type": "message", "message": {"role": role, "stopReason": stop, "content": [{"type": "text", "text": text}]}}
    assert blocks(transcripts.pi(lines(spark, [say("user", "a"), say("assistant", "b", "stop"), say("assistant", "c", "aborted"), "null", ""]))) == [(0, "user_text", "a"), (1, "assistant_text", "b")]
    rows = [
        {"type": "event_msg", "payload": {"type": "user_message", "message": "q"}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "r"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "twice"}]}},
        {"type": "response_item", "payload": {"type": "reasoning"}},
    ]
    assert blocks(transcripts.codex(lines(spark, rows))) == [(0, "user_text", "q"), (1, "assistant_text", "r")]


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\nname: "A b"\nfact_id: f1\n---\nbody\n---\nname: other\n---\n')
    (tmp_path / "b.md").write_text("no head\n---\nname: x\n---\n")
    (tmp_path / "MEMORY.md").write_text("index")
    (tmp_path / "mem-00ff-x.md").write_text("own")
    x = markdown.read(spark, str(tmp_path)).select("path", markdown.front_matter(F.col("text"), "name").alias("name"), markdown.front_matter(F.col("text"), "fact_id").alias("id"), "sha")
    assert sorted((r["path"].rsplit("/", 1)[1], r["name"], r["id"]) for r in x.collect()) == [("a.md", "A b", "f1"), ("b.md", None, None)]
    old, new = (spark.createDataFrame(r, "path string, sha string") for r in ([("a", "1"), ("b", "1"), ("c", "1")], [("b", "2"), ("c", "1"), ("d", "1")]))
    assert {tuple(r) for r in markdown.changes(new, old).collect()} == {("a", "deleted"), ("b", "changed"), ("d", "new")}


def test_bins(spark):
    rows = [("x", 1, 60, "u"), ("x", 2, 50, "u"), ("x", 3, 500, "a"), ("x", 4, None, "a"), ("x", 5, 10, "a"), ("y", 1, 100, "u"), ("y", 2, 1, "a")]
    df = spark.createDataFrame(rows, "g string, k int, n int, who string")
    got = lambda *a: [r["bin"] for r in folds.bins(df, "g", "k", "n", 110, *a).orderBy("g", "k").collect()]
    assert got() == [0, 0, 1, 2, 2, 0, 0]
    assert got("who")[:3] == [0, 0, 1] and got("who")[5:] == [0, 1]
    assert folds.bins(df.limit(0), "g", "k", "n", 110).count() == 0


def test_segments(spark):
    s = lambda x: [list(y) for y in x]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    items = F.array(*map(F.lit, "abcdef"))
    ends = lambda *e: F.array(*map(F.lit, e))
    assert s(one(folds.split_by(items, ends(2, 5, 6)))) == [["a", "b"], ["c", "d", "e"], ["f"]]
    assert s(one(folds.split_by(items, ends(6)))) == [list("abcdef")]
    seg = lambda *x: F.array(*[F.array(*map(F.lit, y)) for y in x])
    assert s(one(folds.merge_thin(seg("ab", "c", "de")))) == [list("abc"), list("de")]
    assert s(one(folds.merge_thin(seg("a", "bc", "de")))) == [list("abc"), list("de")]
    assert one(folds.paragraphs(F.lit("a\n\n b \n \n\n" + "x" * 900 + "." + "y" * 900 + "."))) == ["a", "b", "x" * 900 + ".", "y" * 900 + "."]


def test_changes(spark):
    old = spark.createDataFrame([("1", "A", "t")], "id string, name string, entity_type string")
    new = spark.createDataFrame([("2", "A", "t"), ("4", "B", "t"), ("3", "B", "t")], "id string, name string, entity_type string")
    assert {tuple(r) for r in changes.insert_entities(old, new).collect()} == {("1", "A", "t"), ("3", "B", "t")}
    atoms = spark.createDataFrame([(1, None), (2, None)], "id long, valid_to timestamp")
    edges = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.5)], "a long, b long, w double")
    ended, left = changes.retire(atoms, edges, spark.createDataFrame([(2,), (2,)], "id long"), "2024-01-01")
    assert {r["id"]: r["valid_to"] is None for r in ended.collect()} == {1: True, 2: False} and left.collect() == edges.filter("a = 3").collect()
    name, text = changes.projection(F.lit(65537), F.lit('say "x"\nnow'), F.lit("fact"))
    r = spark.range(1).select(name.alias("n"), text.alias("t")).first()
    assert r["n"] == "mem-0001-say_x_now.md" and r["t"] == "---\nname: \"say 'x' now\"\ntype: fact\n---\n\nsay \"x\"\nnow\n"


def test_quota(spark):
    df = spark.createDataFrame([(i, 1.0 - i / 100, "a" if i < 6 else "b") for i in range(12)], "id long, score double, anchor string")
    assert [r["id"] for r in recall.quota(df, "anchor").collect()] == [0, 1, 2, 6, 7, 8]


def test_stride_counts_every_group_once(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k")).unionByName(spark.range(150).select(F.lit(None).cast("long").alias("k")))
    keys = sorted(i * 7919 % 20_011 for i in range(20_000)) + [None] * 150
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r["k"] for r in ingest.stride(rows, "k", 100).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=lambda k: (k is None, k)) == keys[::100]


def queried(spark, folder, name, rows, columns="doc_id long, text string", table="documents"):
    """Rows of a query and of its SQL over one table."""
    spark.createDataFrame(rows, columns).write.parquet(f"{folder}/{table}.parquet")
    own = registry.queries()[name](spark, str(folder))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet/*.parquet'")
        other = c.sql(registry.oracle_sql()[name]).select(*own.columns).fetchall()
    return sorted(map(repr, map(tuple, own.collect()))), sorted(map(repr, other))


def test_paragraphs_keep_digits_and_count_whole_ones(spark, tmp_path):
    long = "a part. " + "x" * 1600
    texts = ["0abc0\n\n1def1\n \n 2 ", "a part.\n\n" + long, long, "  a　\n\n \n\n\tb", "a" + "\n" * 20_000 + "b", "\n\n", "", None]
    own, other = queried(spark, tmp_path, "paragraph_split", [*enumerate(texts), (None, "of no document\n\nx")])
    assert own == other and repr((0, 3, 11)) in own and repr((1, 1, 7)) in own


def test_names_keep_digits(spark, tmp_path):
    texts = ['"0abc0" and "1def1" and "2ghi2"', 'Foo  Bar "  0x"', '"00" "11"', "", None]
    own, other = queried(spark, tmp_path, "entity_mentions", list(enumerate(texts)))
    assert own == other and repr((0, "0abc0", "quoted_term")) in own and repr((0, "1def1", "quoted_term")) in own


def test_relations_keep_digits(spark):
    got = spark.range(1).select(F.inline(extract.relations(F.lit("00 Alpha uses  beta 0.")))).collect()
    assert [tuple(r) for r in got] == [("00 Alpha", "uses", "beta 0")]


def test_long_names(spark, tmp_path):
    draw = random.Random(7)
    for _ in range(20_000):
        t = "".join(draw.choice(["A", "a", "Ab", "b", "1", "_", ".", " ", "\n", "-"]) for _ in range(draw.randrange(14)))
        for i, p in extract.LONG_ENTITIES.items():
            assert re.findall(p, t, re.ASCII) == re.findall(extract.ENTITIES[i][0], t, re.ASCII), (i, t)
    texts = ["Foo Bar " * 10_000, "Foo." * 10_000 + "Bar", "a" + "Foo" * 10_000, "a" + "_foo" * 10_000]
    own, other = queried(spark, tmp_path, "entity_mentions", list(enumerate(texts)))
    assert own == other and len(own) == 4
