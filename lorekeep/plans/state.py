"""Queries of the operators that change or inspect the store, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import text as texts
from lorekeep.operators import changes, ingest, maintain, recall, temporal
from lorekeep.plans import core
from lorekeep.plans.core import ATOM, FACT, NOW, query
from lorekeep.sources import tables

_LIVE = "status = 'active' AND valid_to IS NULL"
_ENT = "ent AS (SELECT 's:' || s_suppkey AS id, s_name AS name, 'supplier' AS entity_type FROM supplier UNION ALL SELECT 'p:' || p_partkey, p_name, 'part' FROM part)"
_TRUST = "CASE {0} WHEN 'llm' THEN 0.7::DOUBLE WHEN 'human' THEN 0.9 WHEN 'vote' THEN 0.85 ELSE 0.4 END"


@query(f"WITH {FACT} SELECT id, subject_id, predicate, status FROM fact WHERE id IN (SELECT 'f:' || l_suppkey || ':' || l_partkey FROM lineitem WHERE l_orderkey <= 20)")
def facts_by_id(spark, d):
    ids = tables.table(spark, d, "lineitem").filter("l_orderkey <= 20").select(F.concat(F.lit("f:"), "l_suppkey", F.lit(":"), "l_partkey").alias("id"))
    return temporal.by_id(tables.facts(spark, d), ids).select("id", "subject_id", "predicate", "status")


@query(f"""WITH {FACT} SELECT id, {_TRUST.format('extractor')} AS lif_source, CASE fact_type WHEN 'stable' THEN 1.0::DOUBLE WHEN 'ephemeral' THEN 0.5 END AS veracity,
  coalesce(CASE WHEN confidence < 0.5 THEN valid_from END, TIMESTAMP '{NOW}') AS valid_from, 'active' AS status FROM fact""")
def put_facts(spark, d):
    f = tables.facts(spark, d)
    new = f.select("id", "subject_id", "predicate", F.col("object_id").alias("value"), "extractor", F.when(F.col("fact_type") == "stable", "user_prose").when(F.col("fact_type") == "ephemeral", "system").alias("provenance"), F.when(F.col("confidence") < 0.5, F.col("valid_from")).alias("valid_from"))
    return ingest.with_defaults(new, NOW).select("id", "lif_source", "veracity", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"), "status")


@query(f"""WITH {FACT} SELECT id, CASE WHEN confidence < 0.2 THEN 'superseded' ELSE status END AS status, CASE WHEN confidence < 0.2 THEN 'weak' END AS reason,
  CASE WHEN confidence < 0.1 THEN subject_id END AS supersedes_id FROM fact""")
def lifecycle_reasons(spark, d):
    f = tables.facts(spark, d).withColumns({"reason": F.lit(None).cast("string"), "supersedes_id": F.lit(None).cast("string")})
    edits = f.filter("confidence < 0.2").select("id", F.lit("superseded").alias("status"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit("weak").alias("reason"), F.when(F.col("confidence") < 0.1, F.col("subject_id")).alias("supersedes_id"))
    return changes.update(f, edits).select("id", "status", "reason", "supersedes_id")


@query(f"""WITH {ATOM}, gone AS (SELECT vec_id AS id FROM embeddings WHERE label = 3)
SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (FROM gone)""")
def retired_vectors(spark, d):
    v = tables.vectors(spark, d)
    return changes.without(v, v.filter("tag_id = 3").select("id")).select("id")


@query(f"""WITH {_ENT}, a AS (SELECT id, name, [name, upper(name), 'x', 'x', ''] AS old FROM ent)
SELECT id, list_filter(['x', upper(name), 'new'], lambda v: v <> name AND v <> 'gone' AND NOT (v = 'x' AND id LIKE 'p:%')) AS aliases FROM a""")
def alias_lists(spark, d):
    e = tables.entities(spark, d)
    old = F.array("name", F.lit("x"), F.upper("name"), F.lit("x"), F.lit(""), F.lit("gone"))
    drop = F.when(F.col("id").startswith("p:"), F.array(F.lit("gone"), F.lit("x"))).otherwise(F.array(F.lit("gone")))
    return e.select("id", ingest.aliases(old, add=F.array(F.lit("new"), F.upper("name")), remove=drop, name=F.col("name")).alias("aliases"))


@query(f"""WITH {_ENT}, s AS (SELECT lower(name) AS surface, id, name FROM ent UNION ALL SELECT lower(split_part(name, ' ', 1)), id, name FROM ent)
SELECT surface, arg_min(id, id) AS id, arg_min(name, id) AS name FROM s GROUP BY 1""")
def alias_dictionary(spark, d):
    e = tables.entities(spark, d).withColumns({"aliases": F.array(F.split_part("name", F.lit(" "), F.lit(1))), "created_at": F.lit(0)})
    return ingest.dictionary(e)


@query(f"""WITH {_ENT}, n AS (SELECT DISTINCT upper(name) AS name, entity_type FROM ent WHERE entity_type = 'part' UNION ALL SELECT DISTINCT split_part(name, '#', 2), entity_type FROM ent WHERE entity_type = 'supplier' UNION ALL SELECT 'nothing like it', 'part'),
x AS (SELECT n.name, n.entity_type, min(CASE WHEN lower(e.name) = lower(n.name) THEN e.id END) AS a, min(CASE WHEN lower(split_part(e.name, '#', 2)) = lower(n.name) THEN e.id END) AS b
  FROM n LEFT JOIN ent e ON lower(e.name) = lower(n.name) OR lower(split_part(e.name, '#', 2)) = lower(n.name) GROUP BY 1, 2)
SELECT name, entity_type, coalesce(a, b) AS id, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'alias' ELSE 'create' END AS how FROM x""")
def resolved_entities(spark, d):
    e = tables.entities(spark, d).withColumns({"aliases": F.array(F.split_part("name", F.lit("#"), F.lit(2))), "created_at": F.lit(0)})
    n = e.filter("entity_type = 'part'").select(F.upper("name").alias("name"), "entity_type").unionByName(e.filter("entity_type = 'supplier'").select(F.col("aliases")[0].alias("name"), "entity_type")).unionByName(spark.createDataFrame([("nothing like it", "part")], "name string, entity_type string"))
    return ingest.resolve(n, e)


@query("SELECT vec_id AS id, vec_id % 3 = 0 OR vec_id % 5 = 0 AS fresh FROM embeddings")
def embedding_backfill(spark, d):
    """Vectors are filled in where there is none or one of another size; others stay."""
    v = tables.vectors(spark, d).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 5 == 0, F.slice("v", 1, 8)).otherwise(F.col("v")).alias("v"))
    fill = tables.vectors(spark, d).select("id", F.transform("v", lambda x: x + 1).alias("v"))
    out = changes.backfill(v, fill, 64).withColumnRenamed("v", "n").join(tables.vectors(spark, d).select("id", "v"), "id")
    return out.select("id", (F.col("n")[0] != F.col("v")[0]).alias("fresh"))


@query("""WITH l AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '- [own](mem-' || lpad(CAST(page_id AS VARCHAR), 4, '0') || '-x.md)' ELSE '- native ' || page_id END AS line FROM pages),
k AS (SELECT line, page_id AS p FROM l WHERE page_id % 3 <> 0 UNION ALL SELECT '- [new](mem-' || lpad(CAST(page_id AS VARCHAR), 4, '0') || '-y.md)', 1000000 + page_id FROM pages WHERE page_id % 50 = 1)
SELECT CAST(p AS BIGINT) AS position, line FROM k""")
def index_lines(spark, d):
    p = tables.table(spark, d, "pages")
    name = lambda tag, end: F.concat(F.lit(f"- [{tag}](mem-"), F.lpad(F.col("page_id").cast("string"), 4, "0"), F.lit(f"-{end}.md)"))
    old = p.select(F.col("page_id").alias("position"), F.when(F.col("page_id") % 3 == 0, name("own", "x")).otherwise(F.concat(F.lit("- native "), "page_id")).alias("line"))
    new = p.filter("page_id % 50 = 1").select((1000000 + F.col("page_id")).alias("position"), name("new", "y").alias("line"))
    return changes.index(old, new)


@query(f"WITH {FACT} SELECT id, subject_id || ' ' || predicate || ' ' || object_id AS line FROM fact WHERE {_LIVE} AND confidence >= 0.8")
def export_lines(spark, d):
    f = temporal.live_facts(tables.facts(spark, d)).filter("confidence >= 0.8")
    return f.select("id", F.concat_ws(" ", "subject_id", "predicate", "object_id").alias("line"))


@query(f"WITH {_ENT} SELECT id, name FROM ent WHERE lower(name) LIKE '%00_1%' OR lower(name) LIKE '%e%d%'")
def name_wildcards(spark, d):
    return recall.named(tables.entities(spark, d), ["00_1", "e%d"]).select("id", "name")


@query(f"WITH {FACT} SELECT id FROM fact WHERE {_LIVE} AND (contains(lower(object_id), '11') OR contains(lower(object_id), 'p:7'))")
def value_matches(spark, d):
    return recall.value_leg(temporal.live_facts(tables.facts(spark, d)).withColumn("value", F.col("object_id")), ["11", "p:7"]).select("id")


@query("SELECT part.p_partkey AS id FROM part WHERE contains('which lavender frosted thing', lower(split_part(p_name, ' ', 1))) OR contains(lower(split_part(p_name, ' ', 1)), 'which') OR contains(lower(split_part(p_name, ' ', 1)), 'thing') OR contains(lower(split_part(p_name, ' ', 1)), 'lavender') OR contains(lower(split_part(p_name, ' ', 1)), 'frosted')")
def subject_anchors(spark, d):
    p = tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("subjects"))
    q = F.lit("which Lavender frosted thing")
    return p.filter(recall.anchored(F.col("subjects"), q, texts.query_tokens(q))).select("id")


@query(f"""WITH {ATOM} SELECT id FROM atom WHERE valid_to IS NULL AND p_dur < 0.6 AND label NOT IN ('preference', 'event') AND source_cwd <> '/ws/src1'""")
def low_value_atoms(spark, d):
    a = tables.atoms(spark, d).withColumns({"gist": F.lit(None).cast("string"), "from_markdown": F.col("source_cwd") == "/ws/src1"})
    return temporal.low_value(a, exempt=("preference", "event")).select("id")


@query(f"""WITH {ATOM}, p AS (SELECT id, 'preference' AS lane, row_number() OVER (ORDER BY p_dur DESC, id) AS r, 40 AS size FROM atom WHERE valid_to IS NULL AND label = 'preference'),
e AS (SELECT id, 'event' AS lane, row_number() OVER (ORDER BY abs(epoch(valid_from) - epoch(TIMESTAMP '2024-01-20')), id) AS r, 40 AS size FROM atom WHERE valid_to IS NULL AND label = 'event'
  AND valid_from BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-02-10'),
u AS (SELECT * FROM p WHERE r <= 3 UNION ALL SELECT * FROM e WHERE r <= 3)
SELECT id, lane FROM (SELECT *, sum(size) OVER (ORDER BY lane DESC, r) AS s FROM u) WHERE s <= 200""")
def lanes(spark, d):
    return recall.lanes(tables.atoms(spark, d).withColumn("text", F.lit("x" * 40)), "2024-01-20 00:00:00", budget=200).select("id", "lane")


@query(f"""WITH {FACT}, r AS (SELECT 'f:' || a.l_suppkey || ':' || a.l_partkey AS source_id, 'f:' || b.l_suppkey || ':' || b.l_partkey AS target_id, max(a.l_discount) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 GROUP BY 1, 2)
SELECT source_id, target_id, weight FROM r JOIN fact a ON a.id = source_id JOIN fact b ON b.id = target_id WHERE a.status = 'active' AND a.valid_to IS NULL AND b.status = 'active' AND b.valid_to IS NULL""")
def live_relations(spark, d):
    li = tables.table(spark, d, "lineitem")
    name = F.concat(F.lit("f:"), "l_suppkey", F.lit(":"), "l_partkey")
    one, two = li.filter("l_linenumber = 1").select("l_orderkey", name.alias("source_id"), F.col("l_discount").alias("weight")), li.filter("l_linenumber = 2").select("l_orderkey", name.alias("target_id"))
    r = one.join(two, "l_orderkey").groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"))
    return temporal.both_live(r, "source_id", "target_id", temporal.live_facts(tables.facts(spark, d)))


@query(core._PAIR + """, live AS (SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0) SELECT a, b, round(w, 6) AS w FROM g WHERE a IN (FROM live) AND b IN (FROM live)""")
def live_atom_edges(spark, d):
    return temporal.both_live(core._knn(spark, d), "a", "b", temporal.live_atoms(tables.atoms(spark, d))).select("a", "b", F.round("w", 6).alias("w"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 4)")
def unmounted_atoms(spark, d):
    m = tables.vectors(spark, d).filter("tag_id <> 4").select(F.col("id").alias("atom_id"), "tag_id")
    return recall.unmounted(tables.atoms(spark, d), m).select("id")


@query(f"WITH {FACT}, {_ENT} SELECT f.id, s.name AS subject, o.name AS object FROM fact f JOIN ent s ON s.id = subject_id LEFT JOIN ent o ON o.id = object_id AND o.name NOT LIKE 'a%' WHERE {_LIVE.replace('valid_to', 'f.valid_to')}")
def named_facts(spark, d):
    e = tables.entities(spark, d)
    return recall.with_names(temporal.live_facts(tables.facts(spark, d)), e, e.filter("name not like 'a%'")).select("id", "subject", "object")


@query(f"""WITH {ATOM}, p AS (SELECT a.text AS old_text, b.text AS new_text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
l AS (SELECT text, min(id) AS id FROM atom WHERE valid_to IS NULL GROUP BY 1)
SELECT DISTINCT a.id AS old_id, b.id AS new_id FROM p JOIN l a ON a.text = old_text JOIN l b ON b.text = new_text WHERE a.id <> b.id""")
def settled_supersedes(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", "text")
    p = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("old_text")).join(docs.select((F.col("doc_id") - 1).alias("i"), F.col("text").alias("new_text")), "i").select("old_text", "new_text")
    return ingest.settle(p, tables.atoms(spark, d))


@query("""WITH r AS (SELECT l_orderkey AS id, l_suppkey AS ref FROM lineitem) SELECT id FROM r GROUP BY 1 HAVING bool_and(ref % 3 = 0)""")
def orphaned_by_sources(spark, d):
    items = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_suppkey").alias("source_refs"))
    return ingest.all_sources_gone(items, tables.table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("ref")))


@query("""WITH f AS (SELECT page_id * 2 AS id FROM pages) SELECT f.id, d.doc_id IS NOT NULL AS present FROM f LEFT JOIN documents d ON d.doc_id = f.id""")
def projection_files(spark, d):
    files = tables.table(spark, d, "pages").select((F.col("page_id") * 2).alias("id"))
    return changes.presence(files, tables.atoms(spark, d))


@query("SELECT coalesce(CASE WHEN source = 'src1' THEN NULL ELSE source END, 'unknown') AS harness, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, harness")
def harness_counts(spark, d):
    return maintain.counted(tables.table(spark, d, "documents").withColumn("harness", F.when(F.col("source") != "src1", F.col("source"))), "harness")


@query(f"""WITH {FACT}, x AS (SELECT *, object_id[1:3] AS okey FROM fact WHERE {_LIVE}),
g AS (SELECT subject_id, predicate, okey, arg_min(id, (valid_from, id)) AS id, max(access_count) AS access_count, max(confidence) AS confidence, arg_max(extractor, ({_TRUST.format('extractor')}, extractor)) AS extractor, count(*) AS merged, list_sort(list(DISTINCT object_id)) AS source_refs FROM x GROUP BY 1, 2, 3)
SELECT subject_id, predicate, id, access_count, confidence, extractor, merged, source_refs FROM g WHERE merged > 1""")
def merged_facts(spark, d):
    f = temporal.live_facts(tables.facts(spark, d)).withColumns({"okey": F.substring("object_id", 1, 3), "source_refs": F.array("object_id")})
    return ingest.merged(f, NOW, ["subject_id", "predicate", "okey"]).filter("merged > 1").select("subject_id", "predicate", "id", "access_count", "confidence", "extractor", "merged", "source_refs")


@query(f"""WITH {FACT}, q AS (SELECT extractor, count(*) AS n, avg((fact_type <> 'ephemeral')::INT) AS u, avg((status = 'superseded')::INT) AS c, any_value({_TRUST.format('extractor')}) AS w FROM fact GROUP BY 1)
SELECT extractor, n, round(u, 6) AS upgraded, round(c, 6) AS contradicted, round(CASE WHEN c >= 0.3 THEN greatest(0.1, w - 0.05) - w WHEN u >= 0.5 THEN 0.05 ELSE 0 END, 6) AS change FROM q WHERE n >= 5""")
def extractor_quality(spark, d):
    return ingest.extractor_quality(tables.facts(spark, d)).withColumns({c: F.round(c, 6) for c in ("upgraded", "contradicted")})


@query(f"WITH {FACT} SELECT predicate, count(*) AS n, count(DISTINCT subject_id) AS subjects, round(count(*) / (SELECT count(*) FROM fact)::DOUBLE, 6) AS share FROM fact GROUP BY 1")
def predicate_stats(spark, d):
    return maintain.predicates(tables.facts(spark, d))


@query("""WITH v AS (SELECT o_custkey AS s, lower(o_orderpriority) AS o, o_orderkey AS w, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 't' || o_orderkey END AS topic, o_totalprice AS c FROM orders)
SELECT s, o, arg_min(topic, w) FILTER (topic <> '') AS topic, max(c) AS confidence, count(*) AS n FROM v GROUP BY 1, 2 HAVING count(*) >= 3""")
def topical_vote(spark, d):
    o = tables.table(spark, d, "orders")
    v = o.select(F.col("o_custkey").cast("string").alias("s"), F.lit("p").alias("p"), F.lower("o_orderpriority").alias("o"), F.col("o_orderkey").alias("wing"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit("t"), "o_orderkey")).alias("topic"), F.col("o_totalprice").alias("confidence"))
    return ingest.vote(v, 6).select(F.col("s").cast("long").alias("s"), "o", "topic", "confidence", "n")


@query("""WITH c AS (SELECT o_custkey AS k, o_orderpriority AS cwd, count(*) AS n, min(o_orderdate) AS t FROM orders GROUP BY 1, 2)
SELECT k, arg_min(cwd, (-n, cwd)) AS cwd, min(t) AS created_at, CAST(count(*) AS BIGINT) AS refs FROM c GROUP BY 1""")
def atom_origins(spark, d):
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("cwd"), F.col("o_orderdate").alias("at"))
    return ingest.majority(o, "k", "cwd").join(o.groupBy("k").agg(F.min("at").alias("created_at"), F.countDistinct("cwd").alias("refs")), "k")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, min(value) AS least, max(value) FILTER (r = n // 4) AS p25, max(value) FILTER (r = n // 2) AS median, max(value) FILTER (r = floor(n * 0.75)) AS p75, max(value) AS most, round(avg(value), 6) AS mean FROM r GROUP BY 1""")
def distributions(spark, d):
    return ingest.distribution(tables.table(spark, d, "events"), "value", ["event_type"]).withColumn("mean", F.round("mean", 6))


@query("SELECT count(DISTINCT text) AS texts, count(*) AS n FROM documents WHERE text IS NOT NULL")
def backfill_counts(spark, d):
    return tables.table(spark, d, "documents").filter("text is not null").agg(F.countDistinct("text").alias("texts"), F.count("*").alias("n"))


@query("SELECT count(*) AS entities, max(vec_id) AS last_entity FROM embeddings")
def row_cursors(spark, d):
    return changes.cursor(tables.vectors(spark, d))


@query("SELECT o_orderkey AS id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 100 = 0")
def stride_sample(spark, d):
    return ingest.stride(tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 100)


@query("SELECT least(20, count(*)) AS taken, greatest(0, count(*) - 20) AS remaining FROM orders WHERE o_orderstatus = 'O'")
def batch_remainder(spark, d):
    o = tables.table(spark, d, "orders").filter("o_orderstatus = 'O'")
    some, left = ingest.capped(o, ["o_orderkey"], 20)
    return some.agg(F.count("*").alias("taken")).join(o.agg(left.alias("remaining")))


@query("SELECT conv_id, least(3, count(*)) AS turns FROM conversations WHERE role = 'user' GROUP BY 1")
def counted_turns(spark, d):
    t = tables.transcripts(spark, d).filter("role = 'user'")
    return t.groupBy("conv_id").agg(F.least(F.lit(3), F.count("*")).alias("turns"))


@query(f"""WITH {FACT}, old AS (SELECT subject_id, predicate, max({_TRUST.format('extractor')}) AS t FROM fact WHERE {_LIVE} GROUP BY 1, 2), new AS (SELECT * FROM fact WHERE status <> 'active')
SELECT n.id, CASE WHEN predicate = 'uses' OR t IS NULL OR n.confidence < 0.4 THEN 'ADD' WHEN {_TRUST.format('extractor')} < t THEN 'NOOP' ELSE 'SUPERSEDE' END AS decision FROM new n LEFT JOIN old USING (subject_id, predicate)""")
def tiered_decisions(spark, d):
    f = tables.facts(spark, d).withColumn("value", F.col("object_id"))
    new = f.filter("status <> 'active'").select("id", "subject_id", "predicate", "value", "extractor", (F.col("confidence") >= 0.4).alias("contradicts"))
    return ingest.decide(new, temporal.live_facts(f)).select("id", "decision")


@query(f"""WITH {FACT}, h AS (SELECT 'f:' || l_suppkey || ':' || l_partkey AS id, count(*) AS n, max(l_shipdate) + INTERVAL 1 DAY AS t, count(DISTINCT l_orderkey) AS s FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT f.id, access_count + CASE WHEN n IS NULL OR extractor = 'regex' THEN 0 ELSE n END AS access_count, CASE WHEN n IS NULL OR extractor = 'regex' THEN last_accessed_at ELSE greatest(last_accessed_at, t) END AS last_accessed_at, coalesce(s, 0) AS seen_sessions FROM fact f LEFT JOIN h USING (id)""")
def replayed_facts(spark, d):
    hits = tables.table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("f:"), "l_suppkey", F.lit(":"), "l_partkey").alias("id"), F.col("l_orderkey").alias("session_id"), F.expr("cast(l_shipdate as timestamp) + interval 1 day").alias("at"))
    late = hits.limit(1).withColumn("id", F.lit("f:none"))
    return ingest.refreshed(tables.facts(spark, d), hits.unionByName(late)).select("id", "access_count", F.col("last_accessed_at").cast("timestamp_ntz").alias("last_accessed_at"), "seen_sessions")


@query(f"""WITH {FACT}, e AS (SELECT 'f:' || l_suppkey || ':' || l_partkey AS id, max((l_returnflag = 'R')::INT) AS g FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT id, CASE WHEN status = 'active' AND g = 1 THEN 'superseded' ELSE status END AS status, round(CASE WHEN status = 'active' AND g = 0 THEN least(1.0, confidence + 0.05) ELSE confidence END, 6) AS confidence FROM fact LEFT JOIN e USING (id)""")
def human_edits(spark, d):
    e = tables.table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("f:"), "l_suppkey", F.lit(":"), "l_partkey").alias("id"), F.when(F.col("l_returnflag") == "R", "deleted").otherwise("modified").alias("op"))
    return ingest.human_edits(tables.facts(spark, d), e).select("id", "status", F.round("confidence", 6).alias("confidence"))


@query("""WITH q AS (SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INT) AS a, CASE o_orderstatus WHEN 'O' THEN 'done' WHEN 'F' THEN 'failed' ELSE 'suspended' END AS r FROM orders WHERE o_orderkey % 5 <> 0)
SELECT o_orderkey AS id, CASE WHEN r IS NULL THEN 'running' WHEN r = 'done' THEN 'done' WHEN r = 'failed' AND o_orderkey % 4 + 1 >= 3 THEN 'dead' ELSE 'pending' END AS status, CAST(o_orderkey % 4 + CASE WHEN r = 'failed' THEN 1 ELSE 0 END AS INT) AS attempts FROM orders LEFT JOIN q ON id = o_orderkey""")
def queue_steps(spark, d):
    o = tables.table(spark, d, "orders")
    q = o.select(F.col("o_orderkey").alias("id"), F.lit("running").alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"))
    r = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "done").when(F.col("o_orderstatus") == "F", "failed").otherwise("suspended").alias("result"))
    return ingest.step(q, r).select("id", "status", F.col("attempts").cast("int").alias("attempts"))


@query(core._MOUNT + """, r AS (SELECT *, row_number() OVER (ORDER BY w, atom_id, tag_id) AS r FROM mount WHERE w < 0.03)
SELECT tag_id, atom_id, round(w * 2, 6) AS w FROM mount m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tag_id = m.tag_id AND r.atom_id = m.atom_id AND r <= 20)""")
def audited_mounts(spark, d):
    m = core._mounts(spark, d)
    return maintain.audit(m, m.select("tag_id", "atom_id", F.col("w").alias("judged")), least=0.03, most=20, reweight=lambda w, j: F.round(j * 2, 6))


@query(core._MOUNT + """, t AS (SELECT tag_id AS x, atom_id FROM mount), o AS (SELECT atom_id, CAST(atom_id % 7 AS BIGINT) AS k FROM mount),
cc AS (SELECT k, x, count(*) AS n FROM o JOIN t USING (atom_id) GROUP BY 1, 2), s AS (SELECT k, count(*) AS size FROM o GROUP BY 1)
SELECT k, arg_min(x, (-n, x)) AS tag_id FROM cc JOIN s USING (k) WHERE 10 * n >= size GROUP BY 1""")
def reused_tags(spark, d):
    m = core._mounts(spark, d)
    return maintain.reuse(m.select(F.col("atom_id") % 7, "atom_id").toDF("k", "atom_id"), m, share=0.1)


@query("""WITH a AS (SELECT conv_id, list_sort(list(DISTINCT turn)) AS x FROM conversations GROUP BY 1), b AS (SELECT conv_id, list_sort(list(DISTINCT turn)) AS y FROM conversations WHERE role <> 'system' GROUP BY 1)
SELECT conv_id, x = coalesce(y, []) AS covered FROM a LEFT JOIN b USING (conv_id)""")
def covered_sets(spark, d):
    t = tables.transcripts(spark, d).select(F.col("conv_id").alias("key"), F.col("turn").alias("id"), "role")
    return maintain.covers(t, t.filter("role <> 'system'")).withColumnRenamed("key", "conv_id")


@query(f"WITH {ATOM} SELECT 'atom:' || id AS id, p_dur AS \"LIF\", p_dur AS confidence, sha256(coalesce(text, '')) AS digest FROM atom WHERE valid_to IS NULL")
def atom_contract(spark, d):
    a = recall.as_facts(temporal.live_atoms(tables.atoms(spark, d)))
    return a.select("id", "LIF", "confidence", F.sha2(F.coalesce("value", F.lit("")), 256).alias("digest"))


@query("SELECT user_id, count(*) AS hits, min(event_id) AS first_id FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) >= 2")
def frequent_hits(spark, d):
    s = tables.signals(spark, d).filter("stream = 'recall_hits'")
    return s.groupBy(F.col("session_id").alias("user_id")).agg(F.count("*").alias("hits"), F.min("event_id").alias("first_id")).filter("hits >= 2")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)
SELECT conv_id, turn FROM t WHERE role = 'assistant' AND (nx IS NULL OR nx = 'user')""")
def turn_ends(spark, d):
    """The last assistant text before a turn ends, with the next user's text or the transcript."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = tables.transcripts(spark, d).withColumn("_next", F.lead("role").over(w))
    return t.filter((F.col("role") == "assistant") & (F.col("_next").isNull() | (F.col("_next") == "user"))).select("conv_id", "turn")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE CAST(json_extract(props, '$.k') AS VARCHAR) LIKE '%7%'")
def json_paths(spark, d):
    return recall.json_paths(tables.table(spark, d, "events").select("event_id", F.col("props").alias("json")), "7").select("event_id", "value")

