"""One query for each operator family, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import scores, text
from lorekeep.operators import graph, maintain, recall, temporal, vectors
from lorekeep.sources import tables
from lorekeep.streaming import signals as stream

NOW = "2024-03-01 00:00:00"
QUERY = "the thing with erst"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ATOM = """
atom AS (
  SELECT doc_id AS id, text, list_extract(['fact','judgment','experience','summary','preference','event'], CAST(doc_id % 6 + 1 AS INT)) AS label,
         CASE WHEN quality IS NULL THEN 0.0 WHEN quality = 1 THEN 0.8 ELSE 0.3 END::DOUBLE AS p_dur, '/ws/' || source AS source_cwd,
         TIMESTAMP '2024-01-01' + to_hours(doc_id) AS valid_from,
         CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id) + INTERVAL 30 DAY END AS valid_to,
         CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id) + to_days(CAST(doc_id % 40 AS INT)) END AS last_seen_at,
         quality IS NULL AS needs_audit
  FROM documents LEFT JOIN labels USING (doc_id))"""
FACT = """
fact AS (
  SELECT 'f:' || l_suppkey || ':' || l_partkey AS id, 's:' || l_suppkey AS subject_id, 'p:' || l_partkey AS object_id,
         list_extract(['supplies','uses','avoids','likes','dislikes'], CAST(l_partkey % 5 + 1 AS INT)) AS predicate,
         list_extract(['ephemeral','stable','permanent'], CAST(l_partkey % 3 + 1 AS INT)) AS fact_type,
         list_extract(['regex','llm','human','vote','agent'], CAST((l_suppkey + l_partkey) % 5 + 1 AS INT)) AS extractor,
         count(*) AS access_count, count(DISTINCT l_orderkey) AS sessions, max(l_shipdate) AS last_accessed_at, min(l_shipdate) AS valid_from,
         CASE WHEN l_partkey % 11 = 0 THEN min(l_shipdate) + INTERVAL 365 DAY END AS valid_to,
         CASE WHEN l_partkey % 11 = 0 THEN 'superseded' WHEN l_partkey % 13 = 0 THEN 'deprecated' ELSE 'active' END AS status,
         (l_suppkey * 7 + l_partkey) % 10 / 10.0::DOUBLE AS confidence
  FROM lineitem GROUP BY l_suppkey, l_partkey)"""
EDGE = """
edge AS (SELECT least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b FROM fact WHERE status = 'active' AND valid_to IS NULL GROUP BY 1, 2),
two AS (SELECT a AS u, b AS v FROM edge UNION ALL SELECT b, a FROM edge)"""
VEC = "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS tag_id FROM embeddings)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return temporal.live_facts(tables.facts(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_facts(spark, d))


_TOKENS = "list_value(" + ", ".join(f"'{t}'" for t in QUERY.split()) + ")"
_HIT = " OR ".join(f"contains(lower(text), '{t}')" for t in QUERY.split())
_N = " + ".join(f"contains(lower(text), '{t}')::INT" for t in QUERY.split())
_RECALL = f"""
WITH {ATOM}, hit AS (
  SELECT id, label, valid_from, last_seen_at, p_dur, least(1.0, ({_N}) / {len(QUERY.split())}.0::DOUBLE + CASE WHEN contains(lower(text), '{QUERY}') THEN 0.2 ELSE 0 END) AS m
  FROM atom WHERE valid_to IS NULL AND ({_HIT})),
s AS (SELECT id, m, p_dur * CASE WHEN label = 'fact' THEN greatest(0.25, pow(0.5, greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(coalesce(last_seen_at, valid_from))) / 86400.0 / 90.0)) ELSE 1.0 END AS p FROM hit)
SELECT id, round(m, 6) AS match, round(0.5 * m + 0.2 * least(1.0, 0.7 * p + 0.3 * p), 6) AS score FROM s WHERE round(0.5 * m + 0.2 * least(1.0, 0.7 * p + 0.3 * p), 6) >= 0.3"""


@query(_RECALL + " ORDER BY score DESC, id LIMIT 50")
def recall_text(spark, d):
    return recall.recall(tables.atoms(spark, d), QUERY, NOW, k=50).select("id", F.round("match", 6).alias("match"), "score")


@query(f"WITH {ATOM} SELECT id, label, source_cwd FROM atom WHERE valid_to IS NULL")
def atom_live(spark, d):
    return temporal.live_atoms(tables.atoms(spark, d)).select("id", "label", "source_cwd")


@query(f"WITH {ATOM} SELECT id, label FROM atom WHERE valid_from <= TIMESTAMP '2024-02-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-02-01')")
def atom_as_of(spark, d):
    return temporal.live_atoms(tables.atoms(spark, d), "2024-02-01 00:00:00").select("id", "label")


@query(f"WITH {FACT} SELECT id, predicate, status FROM fact WHERE status = 'active' AND valid_to IS NULL")
def fact_live(spark, d):
    return _facts(spark, d).select("id", "predicate", "status")


@query(f"WITH {FACT} SELECT id, status FROM fact WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-01')")
def fact_as_of(spark, d):
    return temporal.live_facts(tables.facts(spark, d), "1996-06-01 00:00:00").select("id", "status")


@query(f"WITH {ATOM} SELECT id, source_cwd FROM atom WHERE source_cwd = '/ws/src1' OR starts_with(source_cwd, '/ws/src1/')")
def scope_scan(spark, d):
    return temporal.in_scope(tables.atoms(spark, d), "/ws/src1").select("id", "source_cwd")


@query(f"WITH {FACT} SELECT id FROM fact WHERE subject_id IN ('s:1', 's:2', 's:3') OR object_id IN ('p:5', 'p:7')")
def facts_touching(spark, d):
    ids = spark.createDataFrame([(x,) for x in ("s:1", "s:2", "s:3", "p:5", "p:7")], "id string")
    return temporal.touching(tables.facts(spark, d), ids).select("id")


@query(f"WITH {FACT} SELECT id, valid_from FROM fact WHERE subject_id = 's:1' AND status = 'active'")
def facts_by_subject(spark, d):
    return tables.facts(spark, d).filter("subject_id = 's:1' and status = 'active'").orderBy(F.desc("valid_from"), "id").select("id", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"))


@query(f"""WITH {ATOM} SELECT id FROM atom WHERE p_dur < 0.35 AND NOT needs_audit AND coalesce(last_seen_at, valid_from) < TIMESTAMP '{NOW}' - INTERVAL 21 DAY
  AND label NOT IN ('judgment', 'experience', 'summary', 'preference', 'event')""")
def ttl_retire(spark, d):
    return temporal.ttl_expired(tables.atoms(spark, d), NOW).select("id")


@query(f"""WITH {FACT} SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'superseded') AS superseded,
  count(*) FILTER (status = 'deprecated') AS deprecated, round(count(*) FILTER (status = 'superseded') / count(*)::DOUBLE, 6) AS supersede_rate,
  round(count(*) FILTER (status = 'active') / count(*)::DOUBLE, 6) AS active_ratio FROM fact""")
def churn_stats(spark, d):
    return maintain.churn(tables.facts(spark, d))


@query(f"WITH {ATOM} SELECT coalesce(label, 'all') AS label, count(*) AS n, round(avg(p_dur), 6) AS mean FROM atom GROUP BY ROLLUP (label)")
def label_counts(spark, d):
    return tables.atoms(spark, d).rollup("label").agg(F.count("*").alias("n"), F.round(F.avg("p_dur"), 6).alias("mean")).select(F.coalesce("label", F.lit("all")).alias("label"), "n", "mean")


@query(f"""WITH {FACT} SELECT subject_id, predicate, min_by(id, (valid_from, id)) AS id, max(access_count) AS access_count, max(confidence) AS confidence, count(*) AS merged
  FROM fact GROUP BY subject_id, predicate""")
def dedup_groups(spark, d):
    return maintain.merge_duplicates(tables.facts(spark, d), ["subject_id", "predicate"])


_LIF = f"""
WITH {FACT}, kin AS (SELECT subject_id, list(DISTINCT predicate) AS k, count(*) AS n FROM fact WHERE status = 'active' AND valid_to IS NULL GROUP BY 1),
l AS (SELECT f.*, 0.25 * (1 - exp(-access_count / 5.0::DOUBLE))
  + 0.30 * CASE WHEN fact_type = 'permanent' THEN 1.0 ELSE exp(-ln(2.0::DOUBLE) * greatest(0, (epoch(TIMESTAMP '{NOW}') - epoch(last_accessed_at)) / 3600.0::DOUBLE) / (CASE WHEN fact_type = 'ephemeral' THEN 7.0 ELSE 90.0 END * 24)) END
  + 0.15 * least(1.0, sessions / 5.0::DOUBLE)
  + 0.15 * greatest(0, 1 - ((list_contains(k, 'likes') AND list_contains(k, 'dislikes'))::INT + (list_contains(k, 'uses') AND list_contains(k, 'avoids'))::INT) / n::DOUBLE)
  + 0.15 * CASE extractor WHEN 'llm' THEN 0.7 WHEN 'human' THEN 0.9 WHEN 'vote' THEN 0.85 ELSE 0.4 END AS lif
  FROM fact f JOIN kin USING (subject_id) WHERE status = 'active' AND valid_to IS NULL)"""


@query(_LIF + "SELECT id, round(lif, 6) AS lif, CASE WHEN lif < 0.3 THEN 'deprecated' ELSE status END AS status FROM l")
def lif_decay(spark, d):
    return maintain.decay(tables.facts(spark, d), NOW, least=0.3).select("id", F.round("lif", 6).alias("lif"), "status")


@query(_LIF + """SELECT fact_type, count(*) AS n FROM (SELECT CASE WHEN fact_type = 'ephemeral' AND lif >= 0.7 THEN 'stable'
  WHEN fact_type = 'stable' AND lif >= 0.85 THEN 'permanent' ELSE fact_type END AS fact_type FROM l) GROUP BY 1""")
def promotion(spark, d):
    return maintain.promote(maintain.decay(tables.facts(spark, d), NOW)).groupBy("fact_type").agg(F.count("*").alias("n"))


@query(f"WITH {FACT} SELECT id, round(0.7 * access_count / 10.0 + 0.3 * confidence, 6) AS weighted, round(confidence, 6) AS only FROM (SELECT id, confidence, least(10, access_count) AS access_count FROM fact)")
def mem_scores(spark, d):
    f = tables.facts(spark, d).withColumn("x", F.least(F.lit(10), F.col("access_count")) / 10.0)
    return f.select("id", F.round(scores.mem_score(F.col("x"), F.col("confidence")), 6).alias("weighted"), F.round(scores.mem_score(F.col("confidence"), F.col("x"), "lif"), 6).alias("only"))


_TOP = """SELECT id, round(list_dot_product(v, (SELECT v FROM vec WHERE id = 0)) / sqrt(list_dot_product(v, v)) / sqrt((SELECT list_dot_product(v, v) FROM vec WHERE id = 0)), 6) AS sim FROM vec"""


@query(f"WITH {VEC}, s AS ({_TOP}) SELECT id, sim FROM s ORDER BY sim DESC, id LIMIT 20")
def knn_top(spark, d):
    v = tables.vectors(spark, d)
    q = v.filter("id = 0").select("v").first()
    return vectors.top_k(v, q["v"] if q else [], 20).select("id", F.round("sim", 6).alias("sim"))


_PAIR = f"""
WITH {VEC}, u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vec),
p AS (SELECT x.id AS a, y.id AS b, round(list_dot_product(x.v, y.v), 9) AS w FROM u x JOIN u y ON x.id <> y.id),
k AS (SELECT a, b, w FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM p WHERE w >= 0.3) WHERE r <= 8),
g AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(w) AS w FROM k GROUP BY 1, 2)"""


@query(_PAIR + "SELECT a, b, round(w, 6) AS w FROM g")
def knn_graph(spark, d):
    return _knn(spark, d).select("a", "b", F.round("w", 6).alias("w"))


def _knn(spark, d) -> DataFrame:
    """The synthetic vectors are nearly orthogonal, so the least cosine is lower than the operator's own."""
    return vectors.knn_graph(tables.vectors(spark, d), least=0.3)


def _mounts(spark, d) -> DataFrame:
    v = vectors.unit(tables.vectors(spark, d))
    c = vectors.unit(vectors.centroids(v, "tag_id"))
    j = v.join(c.withColumnRenamed("v", "c"), "tag_id")
    return j.select("tag_id", F.col("id").alias("atom_id"), F.round(scores.dot(F.col("v"), F.col("c")), 6).alias("w"))


_MOUNT = f"""
WITH {VEC}, u AS (SELECT id, tag_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vec),
e AS (SELECT tag_id, i, avg(v[i]) AS x FROM u, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2),
c AS (SELECT tag_id, list(x ORDER BY i) AS c FROM e GROUP BY 1),
mount AS (SELECT u.tag_id, id AS atom_id, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS w FROM u JOIN c USING (tag_id))"""


@query(_MOUNT + "SELECT tag_id, atom_id, w FROM mount WHERE w >= 0.05")
def tag_mounts(spark, d):
    return _mounts(spark, d).filter("w >= 0.05")


@query(_MOUNT + "SELECT tag_id, count(*) AS n, min(w) AS least, max(w) AS most FROM mount GROUP BY 1")
def tag_stats(spark, d):
    return _mounts(spark, d).groupBy("tag_id").agg(F.count("*").alias("n"), F.min("w").alias("least"), F.max("w").alias("most"))


@query(_MOUNT + """, own AS (SELECT DISTINCT tag_id FROM mount WHERE atom_id IN (0, 1))
SELECT atom_id AS id, max(w) AS w FROM mount WHERE tag_id IN (SELECT tag_id FROM own) AND atom_id NOT IN (0, 1) AND w > 0 GROUP BY 1 ORDER BY w DESC, id LIMIT 8""")
def tag_wing(spark, d):
    return recall.tag_wing(spark.createDataFrame([(0,), (1,)], "id long"), _mounts(spark, d))


@query(_PAIR + """, n AS (SELECT a AS hit, b AS id, w FROM g UNION ALL SELECT b, a, w FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY w DESC, id) AS r FROM n WHERE w >= 0.3 AND hit IN (0, 1, 2) AND id NOT IN (0, 1, 2))
SELECT id, round(max(w), 6) AS w FROM r WHERE r <= 4 GROUP BY 1 ORDER BY max(w) DESC, id LIMIT 8""")
def edge_wing(spark, d):
    hits = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    return recall.edge_wing(hits, _knn(spark, d), least=0.3).withColumn("w", F.round("w", 6))


@query(f"WITH {FACT}, {EDGE} SELECT u AS id, count(*) AS degree FROM two GROUP BY 1")
def degree(spark, d):
    return graph.degrees(_edges(spark, d))


def _rank(rounds: int) -> str:
    sql = f"WITH {FACT}, {EDGE}, deg AS (SELECT u, count(*)::DOUBLE AS k FROM two GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM deg), r0 AS (SELECT u AS id, 1 / n AS rank FROM deg, n)"
    for i in range(rounds):
        sql += f", r{i + 1} AS (SELECT v AS id, 0.15 / any_value(n) + 0.85 * sum(rank / k) AS rank FROM two JOIN r{i} ON u = id JOIN deg USING (u), n GROUP BY v)"
    return sql + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query(_rank(5))
def pagerank(spark, d):
    return graph.pagerank(_edges(spark, d), 5).select("id", F.round("rank", 9).alias("rank"))


@query(f"""WITH {FACT}, {EDGE}, h0 AS (SELECT 's:1' AS id, 0 AS hop), h1 AS (SELECT DISTINCT v AS id, 1 AS hop FROM two WHERE u = 's:1'),
h2 AS (SELECT DISTINCT v AS id, 2 AS hop FROM two JOIN h1 ON u = id WHERE v NOT IN (SELECT id FROM h1) AND v <> 's:1')
SELECT * FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2) ORDER BY hop, id LIMIT 50""")
def bfs_two_hops(spark, d):
    return graph.bfs(_edges(spark, d), spark.createDataFrame([("s:1",)], "id string"), 2, 50)


@query(_PAIR.replace("WITH", "WITH RECURSIVE", 1) + """, two AS (SELECT a AS u, b AS v FROM g UNION SELECT b, a FROM g),
reach AS (SELECT u AS id, u AS root FROM two UNION SELECT v, root FROM reach JOIN two ON id = u) SELECT id, min(root) AS root FROM reach GROUP BY id""")
def components(spark, d):
    return graph.components(_knn(spark, d))


@query(f"""WITH {FACT}, {EDGE}, deg AS (SELECT u, count(*) AS degree FROM two GROUP BY 1)
SELECT 's:' || s_suppkey AS id, s_name AS name, 'supplier' AS entity_type, degree FROM supplier JOIN deg ON u = 's:' || s_suppkey
UNION ALL SELECT 'p:' || p_partkey, p_name, 'part', degree FROM part JOIN deg ON u = 'p:' || p_partkey""")
def graph_snapshot(spark, d):
    return tables.entities(spark, d).join(graph.degrees(_edges(spark, d)), "id")


@query(f"""WITH {FACT} SELECT 's:' || s_suppkey AS id FROM supplier WHERE 's:' || s_suppkey NOT IN (SELECT subject_id FROM fact)
UNION ALL SELECT 'p:' || p_partkey FROM part WHERE 'p:' || p_partkey NOT IN (SELECT object_id FROM fact)""")
def orphan_entities(spark, d):
    f = tables.facts(spark, d)
    used = f.select(F.col("subject_id").alias("id")).unionByName(f.select(F.col("object_id").alias("id")))
    return tables.entities(spark, d).join(used, "id", "left_anti").select("id")


_STREAM = "CASE event_type WHEN 'view' THEN 'recall_hits' WHEN 'click' THEN 'confirm_arrivals' WHEN 'purchase' THEN 'citations' WHEN 'signup' THEN 'agent_crud' WHEN 'error' THEN 'contradiction_pending' END"


@query("SELECT user_id % 50 AS fact_no, count(*) AS hits, count(DISTINCT user_id) AS sessions, max(ts) AS last_at FROM events WHERE event_type = 'view' GROUP BY 1")
def signal_replay(spark, d):
    return maintain.replay(tables.signals(spark, d)).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


@query(f"SELECT {_STREAM} AS stream, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 2")
def signal_counts(spark, d):
    return tables.signals(spark, d).groupBy("stream").agg(F.count("*").alias("n")).filter("n >= 2")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return stream.windowed(tables.table(spark, d, "events"))


@query("""WITH t AS (SELECT *, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS scene FROM conversations)
SELECT conv_id, CAST(scene AS BIGINT) AS scene, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM t GROUP BY 1, 2""")
def turn_scenes(spark, d):
    return maintain.scenes(tables.transcripts(spark, d))


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS r FROM conversations WHERE role = 'assistant' AND len(text) >= 120) WHERE r = 1")
def end_steps(spark, d):
    t = tables.transcripts(spark, d).filter((F.col("role") == "assistant") & (F.length("text") >= 120))
    return t.groupBy("text").agg(F.min(F.struct("conv_id", "turn")).alias("x")).select("x.*", "text")


@query("SELECT conv_id, turn FROM (SELECT *, sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations WHERE role = 'user') WHERE s <= 1200")
def recent_user_blocks(spark, d):
    t = tables.transcripts(spark, d).filter("role = 'user'").withColumn("size", F.length("text"))
    return maintain.within_budget(t, "conv_id", [F.desc("turn")], "size", 1200).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r <= 3")
def first_turns(spark, d):
    t = tables.transcripts(spark, d).filter("role = 'user'")
    return t.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("r <= 3").select("conv_id", "turn")


@query(r"""SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))::VARCHAR[] AS raw FROM benchmark""".replace("list_distinct(", "len(list_distinct(").replace("::VARCHAR[] AS raw", ")::BIGINT AS n_tokens"))
def query_tokens(spark, d):
    return tables.table(spark, d, "benchmark").select("item_id", F.size(text.query_tokens(F.col("text"))).cast("long").alias("n_tokens"))


_KV = r"""(?i)\b([a-z0-9_]*(?:api[_-]?key|apikey|secret|access[_-]?token|auth[_-]?token|token|passwd|password|pwd|authorization))\s*([=:])\s*["'']?[A-Za-z0-9._~+/=-]{12,}["'']?"""


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace(text, '\bAKIA[0-9A-Z]{{16}}', '[REDACTED_SECRET]', 'g') AS t, len(regexp_extract_all(text, '\bAKIA[0-9A-Z]{{16}}')) AS n FROM documents)
SELECT doc_id, CAST(n + len(regexp_extract_all(t, '{_KV}')) AS BIGINT) AS n, sha256(regexp_replace(t, '{_KV}', '\1\2 [REDACTED_SECRET]', 'g')) AS digest FROM a""")
def redact_secrets(spark, d):
    clean, n = text.redact(F.col("text"))
    return tables.table(spark, d, "documents").select("doc_id", n.cast("long").alias("n"), F.sha2(clean, 256).alias("digest"))


@query(r"""SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;\n]+[。！？；.!?;]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))::BIGINT AS n FROM documents""")
def split_units(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.size(text.units(F.col("text"))).cast("long").alias("n"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script(?:\s[^>]*)?>.*?</script>', '', 'g'), '(?s)<style(?:\s[^>]*)?>.*?</style>', '', 'g'), '\s+', ' ', 'g')) AS x FROM pages""".replace("trim(", "sha256(trim(").replace(" AS x", ") AS digest"))
def cleanse_pages(spark, d):
    x = text.cleanse(F.col("html"), ("script", "style"))
    return tables.table(spark, d, "pages").select("page_id", F.sha2(F.trim(F.regexp_replace(x, r"\s+", " ")), 256).alias("digest"))


@query("SELECT DISTINCT lower(replace(replace(p_type, ' ', '_'), '-', '_')) AS predicate, p_type AS raw FROM part")
def normal_predicates(spark, d):
    return tables.table(spark, d, "part").select(text.normal_predicate(F.col("p_type")).alias("predicate"), F.col("p_type").alias("raw")).distinct()


@query("SELECT s, p, o, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey AS s, o_orderstatus AS p, o_orderpriority AS o, o_orderkey AS w FROM orders) GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def majority_vote(spark, d):
    o = tables.table(spark, d, "orders")
    votes = o.select(F.col("o_custkey").cast("string").alias("s"), F.col("o_orderstatus").alias("p"), F.col("o_orderpriority").alias("o"), F.col("o_orderkey").alias("wing"), F.lit(0.6).alias("confidence"))
    return maintain.vote(votes, 3).select(F.col("s").cast("long").alias("s"), "p", "o", "n")


@query("""SELECT o_orderkey AS id, round(o_totalprice / 1000, 6) AS priority FROM orders WHERE o_orderstatus = 'O' ORDER BY priority DESC, o_orderdate, o_orderkey LIMIT 20""")
def priority_dequeue(spark, d):
    o = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 1000, 6).alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"))
    return maintain.dequeue(o).select("id", "priority")


@query(f"""WITH {FACT}, old AS (SELECT subject_id, predicate, object_id AS value FROM fact WHERE status = 'active' AND valid_to IS NULL),
new AS (SELECT subject_id, predicate, object_id AS value FROM fact WHERE status <> 'active' UNION ALL SELECT subject_id, predicate, value FROM old)
SELECT subject_id, predicate, value, CASE WHEN (subject_id, predicate, value) IN (FROM old) THEN 'UPDATE' WHEN predicate = 'supplies' AND (subject_id, predicate) IN (SELECT subject_id, predicate FROM old) THEN 'SUPERSEDE' ELSE 'ADD' END AS decision FROM new""")
def ingest_decisions(spark, d):
    f = tables.facts(spark, d)
    old = temporal.live_facts(f).select("subject_id", "predicate", F.col("object_id").alias("value"))
    new = f.filter("status <> 'active'").select("subject_id", "predicate", F.col("object_id").alias("value")).unionByName(old)
    return maintain.decide(new, old)


@query("""SELECT item_id, CASE WHEN s IS NULL THEN 0.0::DOUBLE ELSE round(least(1.2, 1 - s + 0.2), 6) END AS priority FROM (
  SELECT item_id, CASE WHEN item_id % 5 <> 0 THEN (item_id % 10) / 10.0::DOUBLE END AS s FROM benchmark)""")
def novelty_priority(spark, d):
    b = tables.table(spark, d, "benchmark").withColumn("s", F.when(F.col("item_id") % 5 != 0, F.col("item_id") % 10 / 10.0))
    return b.select("item_id", F.round(scores.priority(1 - F.col("s"), F.lit(1.0)), 6).alias("priority"))


@query("""WITH v AS (SELECT doc_id % 100 / 100.0::DOUBLE AS p, quality AS y FROM labels), t AS (SELECT unnest(generate_series(1, 19)) / 20.0::DOUBLE AS t)
SELECT t AS threshold, round(avg(((p >= t)::INT = y)::INT), 6) AS accuracy FROM v, t GROUP BY t ORDER BY avg(((p >= t)::INT = y)::INT) DESC, t DESC LIMIT 1""")
def best_threshold(spark, d):
    v = tables.table(spark, d, "labels").select((F.col("doc_id") % 100 / 100.0).alias("p"), F.col("quality").alias("y"))
    t = v.withColumn("threshold", F.explode(F.array(*[F.lit(k / 20) for k in range(1, 20)])))
    g = t.groupBy("threshold").agg(F.avg(((F.col("p") >= F.col("threshold")).cast("int") == F.col("y")).cast("int")).alias("a"))
    return g.orderBy(F.desc("a"), F.desc("threshold")).limit(1).select("threshold", F.round("a", 6).alias("accuracy"))


@query("SELECT DISTINCT event_id, event_type, user_id FROM events")
def streaming_ledger(spark, d):
    """Signals read as a stream into a ledger that applies each record once; the rows are those of the batch."""
    return stream.once(spark, d).select("event_id", "event_type", "user_id")
