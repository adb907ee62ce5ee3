"""Queries of graphs, similarity, whole recalls and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import fused, graph, recall, tagtree, temporal, vectors
from lorekeep.plans import core
from lorekeep.plans.core import ATOM, EDGE, FACT, NOW, query
from lorekeep.sources import tables
from lorekeep.streaming import spool

_LABELS = "lab AS (SELECT vec_id AS id, label AS c FROM embeddings), tw AS (SELECT a AS u, b AS v, w FROM g UNION ALL SELECT b, a, w FROM g)"
_Q = "tot AS (SELECT x.c, sum(w) AS t, coalesce(sum(w) FILTER (x.c = y.c), 0) AS i FROM tw JOIN lab x ON x.id = u JOIN lab y ON y.id = v GROUP BY 1)"


@query(core._PAIR + f", {_LABELS}, {_Q} SELECT round(sum(i / (SELECT sum(w) FROM tw) - pow(t / (SELECT sum(w) FROM tw), 2)), 6) AS q FROM tot")
def label_modularity(spark, d):
    member = tables.vectors(spark, d).select("id", F.col("tag_id").alias("community"))
    return tagtree.modularity(core._knn(spark, d), member).select(F.round("q", 6).alias("q"))


@query(core._PAIR + f", {_LABELS}, {_Q} SELECT 1 AS better FROM (SELECT sum(i / (SELECT sum(w) FROM tw) - pow(t / (SELECT sum(w) FROM tw), 2)) AS q FROM tot)")
def communities(spark, d):
    """Louvain communities against the labels: a row where their modularity is no less."""
    e = graph.cut(core._knn(spark, d))
    own, label = tagtree.louvain(e), tables.vectors(spark, d).select("id", F.col("tag_id").alias("community"))
    q = tagtree.modularity(e, own).withColumnRenamed("q", "x")
    return q.filter(F.col("x") >= tagtree.modularity(e, label).scalar()).select(F.lit(1).alias("better"))


@query(core._PAIR + ", lab AS (SELECT vec_id AS id, label AS c FROM embeddings) SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, count(*) AS n, round(sum(w), 5) AS w FROM g JOIN lab x ON x.id = a JOIN lab y ON y.id = b WHERE x.c <> y.c GROUP BY 1, 2")
def cross_clusters(spark, d):
    member = tables.vectors(spark, d).select("id", F.col("tag_id").alias("community"))
    return tagtree.cross_edges(core._knn(spark, d), member).withColumn("w", F.round("w", 5))


@query(core._PAIR.replace("WITH", "WITH RECURSIVE", 1) + """, lab AS (SELECT vec_id AS id, label AS c FROM embeddings), s AS (SELECT least(x.c, y.c) AS p, greatest(x.c, y.c) AS q, sum(w) AS s FROM g JOIN lab x ON x.id = a JOIN lab y ON y.id = b WHERE x.c <> y.c GROUP BY 1, 2),
two AS (SELECT p AS u, q AS v FROM s WHERE s >= 7 UNION SELECT q, p FROM s WHERE s >= 7), reach AS (SELECT u AS id, u AS root FROM two UNION SELECT v, root FROM reach JOIN two ON id = u) SELECT id, min(root) AS root FROM reach GROUP BY id""")
def tag_clusters(spark, d):
    member = tables.vectors(spark, d).select("id", F.col("tag_id").alias("community"))
    return tagtree.tag_clusters(core._knn(spark, d), member, 7.0)


@query(core._PAIR + ", lab AS (SELECT vec_id AS id, label AS c FROM embeddings) SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, count(*) AS w FROM g JOIN lab x ON x.id = a JOIN lab y ON y.id = b WHERE x.c <> y.c GROUP BY 1, 2 HAVING count(*) > 2")
def quotient_graph(spark, d):
    return graph.quotient(core._knn(spark, d), tables.vectors(spark, d).select("id", F.col("tag_id").alias("community")))


def _converged(rounds: int) -> str:
    return core._rank(rounds).rsplit(" SELECT id", 1)[0] + f", top AS (SELECT max(rank) AS m FROM r{rounds})"


@query(_converged(8) + " SELECT id, round(rank / m, 6) AS rank FROM r8, top")
def centrality(spark, d):
    return graph.centrality(core._edges(spark, d), 0.0, most=8).select("id", F.round("rank", 6).alias("rank"))


@query(f"WITH {FACT}, {EDGE}, deg AS (SELECT u AS id, count(*)::DOUBLE AS k FROM two GROUP BY 1) SELECT f.id, round(greatest(coalesce(s.k, 0), coalesce(o.k, 0)), 6) AS centrality FROM fact f LEFT JOIN deg s ON s.id = subject_id LEFT JOIN deg o ON o.id = object_id WHERE status = 'active' AND valid_to IS NULL")
def fact_centrality(spark, d):
    k = graph.degrees(core._edges(spark, d)).select("id", F.col("degree").cast("double").alias("rank"))
    return graph.fact_centrality(core._facts(spark, d), k).select("id", F.round("centrality", 6).alias("centrality"))


_NEAREST = core._MOUNT + """, q AS (SELECT tag_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c),
s AS (SELECT u.id AS atom_id, q.tag_id, round(list_dot_product(u.v, q.c), 9) AS w FROM u, q)"""


@query(_NEAREST + " SELECT atom_id, tag_id, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY atom_id ORDER BY w DESC, tag_id) AS r FROM s WHERE w >= 0.05) WHERE r <= 3")
def nearest_tags(spark, d):
    v = tables.vectors(spark, d)
    t = vectors.centroids(vectors.unit(v), "tag_id")
    return tagtree.mount(v, t, least=0.05).withColumn("w", F.round("w", 6))


_SPLIT = core._PAIR.split("k AS (")[0].rstrip().rstrip(",") + ", n AS (SELECT a AS id, arg_max(b, (w, -b)) AS best, max(w) AS sim FROM p WHERE a % 2 = 1 AND b % 2 = 0 GROUP BY 1)"


@query(_SPLIT + " SELECT id, best, round(sim, 6) AS sim, CASE WHEN sim >= 0.9 THEN 'merge' WHEN sim >= 0.8 THEN 'edge' ELSE 'new' END AS verdict, CASE WHEN sim >= 0.45 THEN 'covered' WHEN sim >= 0.4 THEN 'partly' ELSE 'open' END AS layer, CASE WHEN sim > 0.92 THEN 0.5 ELSE 1.0::DOUBLE END AS priority FROM n")
def coverage_layers(spark, d):
    v = tables.vectors(spark, d)
    n = vectors.nearest(v.filter("id % 2 = 1"), v.filter("id % 2 = 0"))
    s = F.col("sim")
    return n.select("id", "best", F.round("sim", 6).alias("sim"), tagtree.verdict(s).alias("verdict"), tagtree.layers(s, 0.45, 0.4).alias("layer"), tagtree.suppressed(F.lit(1.0), s).alias("priority"))


@query(_SPLIT.replace("b % 2 = 0 GROUP", "b % 2 = 0 AND b < 400 GROUP") + " SELECT id, round(1 - sim, 6) AS novelty, round(least(1.2, 1 - sim + 0.2 * (id % 3 = 0)::INT), 6) AS priority FROM n")
def novelty_of_vectors(spark, d):
    from lorekeep.functions import scores

    v = tables.vectors(spark, d)
    n = vectors.nearest(v.filter("id % 2 = 1"), v.filter("id % 2 = 0 and id < 400"))
    fresh = 1 - F.col("sim")
    return n.select("id", F.round(fresh, 6).alias("novelty"), F.round(scores.priority(fresh, (F.col("id") % 3 == 0).cast("int")), 6).alias("priority"))


@query("""WITH p AS (SELECT l_orderkey AS s, l_partkey AS t, l_discount * 10 AS w FROM lineitem) SELECT s AS source_id, t AS target_id, max(w) AS weight FROM p WHERE w >= 0.7 AND s <> t GROUP BY 1, 2""")
def semantic_edges(spark, d):
    li = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), (F.col("l_discount") * 10).alias("score"))
    return tagtree.semantic_edges(li)


@query("""WITH t AS (SELECT p_partkey AS tag_id, CAST(p_partkey % 5 AS INT) AS level FROM part WHERE p_partkey <= 100), n AS (SELECT p_partkey AS tag_id, p_partkey % 150 AS parent_id FROM part WHERE p_partkey > 100)
SELECT n.tag_id, CASE WHEN level + 1 <= 4 THEN parent_id END AS parent_id, CASE WHEN level + 1 <= 4 THEN level + 1 ELSE 1 END AS level FROM n LEFT JOIN t ON t.tag_id = parent_id""")
def placed_tags(spark, d):
    p = tables.table(spark, d, "part").select(F.col("p_partkey").alias("tag_id"))
    old = p.filter("tag_id <= 100").withColumn("level", (F.col("tag_id") % 5).cast("int"))
    return tagtree.place(p.filter("tag_id > 100").withColumn("parent_id", F.col("tag_id") % 150), old)


# A recall with every leg. Similarities and weights are made from keys, so that both engines have the same.
_FQ = "000000007 p:11"
_FT = [f"'{t}'" for t in _FQ.split()]
_FULL = f"""WITH {FACT}, {EDGE}, ent AS (SELECT 's:' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'p:' || p_partkey, p_name FROM part),
live AS (SELECT *, object_id AS value, TRY_CAST(split_part(id, ':', 2) AS BIGINT) * 13 % 100 / 100.0::DOUBLE AS sim FROM fact WHERE status = 'active' AND valid_to IS NULL),
nm AS (SELECT id, 0 AS hop FROM ent WHERE {" OR ".join(f"contains(lower(name), {t})" for t in _FT)}), far AS (SELECT DISTINCT v AS id, 1 AS hop FROM two JOIN nm ON nm.id = u WHERE v NOT IN (SELECT id FROM nm)), near AS (FROM nm UNION ALL FROM far),
l AS (SELECT live.*, CASE WHEN subject_id IN (SELECT id FROM nm) OR object_id IN (SELECT id FROM nm) THEN 0 WHEN {" OR ".join(f"contains(lower(value), {t})" for t in _FT)} THEN 1 WHEN sim >= 0.9 THEN 2
  WHEN subject_id IN (SELECT id FROM near) OR object_id IN (SELECT id FROM near) THEN 3 END AS leg FROM live),
x AS (SELECT l.*, coalesce(least(s.hop, o.hop), -1) AS h, greatest(coalesce(ds.k, 0), coalesce(dk.k, 0)) AS c,
  least(1.0::DOUBLE, ({" + ".join(f"contains(lower(value), {t})::INT" for t in _FT)}) / 2.0::DOUBLE + CASE WHEN contains(lower(value), '{_FQ}') THEN 0.2 ELSE 0 END) AS m
  FROM l LEFT JOIN near s ON s.id = subject_id LEFT JOIN near o ON o.id = object_id LEFT JOIN dg ds ON ds.id = subject_id LEFT JOIN dg dk ON dk.id = object_id WHERE leg IS NOT NULL),
y AS (SELECT id, leg, round(m, 6) AS match, h AS hop, leg >= 2 AS wing, round((0.5 * m + 0.3 * c + 0.2 * confidence + 0.3 * CASE WHEN sim >= 0.9 THEN sim ELSE 0 END + 0.1 * CASE WHEN h < 0 THEN 0 ELSE pow(0.5, h) END)
  * CASE WHEN leg >= 2 THEN 0.5 + 0.5 * least(1.0, CASE extractor WHEN 'llm' THEN 0.7 WHEN 'human' THEN 0.9 WHEN 'vote' THEN 0.85 ELSE 0.4 END / 0.7) ELSE 1 END, 6) AS score FROM x)""".replace(
    ", ent AS (", ", d0 AS (SELECT u AS id, count(*)::DOUBLE AS k FROM two GROUP BY 1), dg AS (SELECT id, k / (SELECT max(k) FROM d0) AS k FROM d0), ent AS (", 1
)


def _full(spark, d, **more):
    from lorekeep.functions import scores

    f = tables.facts(spark, d).withColumns({"value": F.col("object_id"), "topic": F.lit(None).cast("string"), "lif": F.col("confidence"), "lif_source": scores.trust(F.col("extractor"))})
    sims = f.select("id", ((F.split_part("id", F.lit(":"), F.lit(2)).cast("long") * 13) % 100 / 100.0).alias("sim")).filter("sim >= 0.9")
    k = graph.degrees(core._edges(spark, d))
    top = k.agg(F.max("degree").alias("m"))
    ranks = k.select("id", (F.col("degree") / top.scalar()).alias("rank"))
    return fused.fact_recall(f, tables.entities(spark, d), _FQ, sims=sims, ranks=ranks, hops=1, k=None, **more)


@query(_FULL + " SELECT id, leg, match, hop, score, wing FROM y WHERE wing OR score >= 0.3")
def fact_recall_full(spark, d):
    return _full(spark, d)


@query(_FULL + " SELECT id, leg, score FROM y WHERE (wing AND leg = 2) OR (NOT wing AND score >= 0.3)")
def gated_recall(spark, d):
    hits = graph.cut(_full(spark, d))
    return fused.gate(hits, hits.filter("wing").select("id", (F.col("leg") == 2).alias("keep"))).select("id", "leg", "score")


@query(_FULL + " SELECT count(*) AS n, count(*) < 3 AS more_hops FROM y WHERE NOT wing AND score >= 0.3")
def recall_hint(spark, d):
    return fused.hint(_full(spark, d, gated=True))


_AT = [f"'{t}'" for t in core.QUERY.split()]
_FUSED = core._PAIR + f""", {ATOM}, e AS (SELECT tag_id, i, avg(v[i]) AS x FROM u0, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2), c AS (SELECT tag_id, list(x ORDER BY i) AS c FROM e GROUP BY 1),
mount AS (SELECT u0.tag_id, id AS atom_id, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS w FROM u0 JOIN c USING (tag_id)),
live AS (SELECT * FROM atom WHERE valid_to IS NULL), sims AS (SELECT b AS id, w AS sim FROM p WHERE a = 0 UNION ALL SELECT 0, 1.0),
l0 AS (SELECT id, 0 AS leg FROM live WHERE {" OR ".join(f"contains(lower(text), {t})" for t in _AT)}), l1 AS (SELECT id, 1 AS leg FROM sims WHERE sim >= 0.3 AND id IN (SELECT id FROM live)),
hits AS (SELECT id FROM l0 UNION SELECT id FROM l1), own AS (SELECT tag_id, atom_id, w * sim AS w FROM mount JOIN sims ON id = atom_id WHERE atom_id IN (SELECT id FROM live)),
t AS (SELECT DISTINCT tag_id FROM (SELECT *, row_number() OVER (PARTITION BY atom_id ORDER BY w DESC, tag_id) AS r FROM own WHERE atom_id IN (FROM hits)) WHERE r <= 2),
l2 AS (SELECT atom_id AS id, 2 AS leg FROM own WHERE tag_id IN (FROM t) AND atom_id NOT IN (FROM hits) GROUP BY 1 HAVING max(w) > 0 ORDER BY max(w) DESC, id LIMIT 8),
tw AS (SELECT a AS hit, b AS id, w FROM g UNION ALL SELECT b, a, w FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY w DESC, id) AS r FROM tw WHERE w >= 0.5 AND hit IN (FROM hits) AND id NOT IN (FROM hits)),
l4 AS (SELECT id, 4 AS leg FROM (SELECT id, max(w) AS w FROM r WHERE r <= 4 GROUP BY 1 ORDER BY w DESC, id LIMIT 8) WHERE id IN (SELECT id FROM live)),
legs AS (SELECT id, min(leg) AS leg FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l4) GROUP BY 1),
m AS (SELECT live.id, leg, coalesce(sim, 0) AS sim, least(1.0::DOUBLE, ({" + ".join(f"contains(lower(text), {t})::INT" for t in _AT)}) / {len(_AT)}.0::DOUBLE + CASE WHEN contains(lower(text), '{core.QUERY}') THEN 0.2 ELSE 0 END) AS m,
  p_dur * CASE WHEN label = 'fact' THEN greatest(0.25, pow(0.5, greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(coalesce(last_seen_at, valid_from))) / 86400.0 / 90.0)) ELSE 1.0 END AS pd FROM live JOIN legs USING (id) LEFT JOIN sims USING (id)),
f AS (SELECT id, leg, round(m, 6) AS match, round(0.5 * m + 0.2 * least(1.0, 0.7 * pd + 0.3 * pd) + 0.3 * sim, 6) AS score, leg >= 2 AS wing FROM m)
SELECT id, leg, match, score, wing FROM f WHERE leg > 0 OR score >= 0.3""".replace("u0", "(SELECT u.id, vec.tag_id, u.v FROM u JOIN vec USING (id)) u0", 1).replace(" JOIN c USING (tag_id))", " JOIN c ON c.tag_id = u0.tag_id)", 1)


@query(_FUSED.replace("FROM u0 JOIN c ON", "FROM (SELECT u.id, vec.tag_id, u.v FROM u JOIN vec USING (id)) u0 JOIN c ON"))
def atom_recall_fused(spark, d):
    v = vectors.unit(tables.vectors(spark, d))
    q = v.filter("id = 0").first()
    q = F.array(*[F.lit(x) for x in q["v"]] if q else [F.lit(0.0)])
    sims = v.withColumn("sim", F.round(vectors.dot(F.col("v"), q), 9)).select("id", F.when(F.col("id") == 0, 1.0).otherwise(F.col("sim")).alias("sim"))
    return fused.atom_recall(tables.atoms(spark, d), core.QUERY, NOW, sims=sims, mounts=core._mounts(spark, d), edges=core._knn(spark, d), k=None)


@query(f"""WITH {ATOM}, lane AS (SELECT id, row_number() OVER (ORDER BY p_dur DESC, id) AS r FROM atom WHERE valid_to IS NULL AND label = 'preference'),
h AS (SELECT id, source_cwd[5:] AS anchor, CAST(id % 97 AS DOUBLE) AS score FROM atom WHERE valid_to IS NULL),
b AS (SELECT id, score, row_number() OVER (PARTITION BY CASE WHEN contains('about src1 and src2', anchor) THEN anchor ELSE '#' || id END ORDER BY score DESC, id) AS k FROM h),
t AS (SELECT id, score FROM b WHERE k <= 3 ORDER BY score DESC, id LIMIT 8),
x AS (SELECT 'preference' AS lane, id, 0 AS l, 0 AS o, id AS i FROM lane WHERE r <= 3 UNION ALL SELECT 'hit', id, 1, -score, id FROM t)
SELECT lane, id, CAST(row_number() OVER (ORDER BY l, o, i) AS INT) AS at FROM x QUALIFY sum(11) OVER (ORDER BY l, o, i) <= 100""")
def injected_context(spark, d):
    a = tables.atoms(spark, d).withColumn("text", F.lit("ten bytes!"))
    hits = temporal.live_atoms(a).select("id", "text", (F.col("id") % 97).cast("double").alias("score"), F.substring("source_cwd", 5, 100).alias("name"))
    lanes = recall.lanes(a.filter("label = 'preference'"), "2024-01-20 00:00:00")
    return fused.context(hits, lanes, "About src1 and SRC2", 0, budget=100).select("lane", "id", "at")


@query(core._MOUNT + f""", {ATOM}, p AS (SELECT id, label = 'preference' AS pinned, round(0.7 * p_dur + 0.3 * p_dur, 6) AS score FROM atom WHERE valid_to IS NULL AND id % 3 <> 0),
top AS (SELECT atom_id AS id, arg_min(tag_id, (-w, tag_id)) AS tag FROM mount GROUP BY 1), k AS (SELECT p.*, CASE WHEN pinned OR tag IS NULL THEN '#' || p.id ELSE tag::VARCHAR END AS k FROM p LEFT JOIN top USING (id))
SELECT id, pinned, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS r FROM k) WHERE r = 1 AND (pinned OR score >= 0.3)""")
def synthesis_lines(spark, d):
    a = temporal.live_atoms(tables.atoms(spark, d)).withColumns({"LIF": F.col("p_dur"), "confidence": F.col("p_dur")})
    return fused.synthesis(a, a.filter("id % 3 <> 0").select("id"), core._mounts(spark, d), 0.3)


@query(f"""WITH {FACT}, {ATOM} SELECT 'fact:' || status AS what, count(*) AS n FROM fact GROUP BY 1 UNION ALL SELECT 'entity:supplier', count(*) FROM supplier UNION ALL SELECT 'entity:part', count(*) FROM part
UNION ALL SELECT 'atom:' || label, count(*) FROM atom GROUP BY 1""")
def store_stats(spark, d):
    return fused.stats(tables.facts(spark, d), tables.entities(spark, d), tables.atoms(spark, d))


@query("""WITH l AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id, props FROM events)
SELECT stream, n, CASE WHEN event_id % 4 = 1 THEN props ELSE '{"a": 1}' END AS line FROM l WHERE n > CASE WHEN stream % 2 = 0 THEN 10 ELSE 0 END AND event_id % 4 > 0 AND event_id % 4 < 3""")
def numbered_lines(spark, d):
    from pyspark.sql import Window

    e = tables.table(spark, d, "events")
    line = F.when(F.col("event_id") % 4 == 0, " ").when(F.col("event_id") % 4 == 1, F.col("props")).when(F.col("event_id") % 4 == 2, '{"a": 1}').otherwise("{broken")
    lines = e.select(F.col("user_id").alias("stream"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("n"), line.alias("line"))
    done = e.filter("user_id % 2 = 0").select(F.col("user_id").alias("stream"), F.lit(10).alias("done")).distinct()
    return spool.numbered(lines, done)


@query("""WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), o AS (SELECT doc_id, b, CASE WHEN doc_id % 3 = 0 OR octet_length(b) < 100 THEN 0 ELSE 100 END AS o FROM b WHERE NOT regexp_matches(decode(b), '[^\\x00-\\x7f]')),
w AS (SELECT doc_id, o, regexp_extract(substring(decode(b), o + 1), '(?s)^(.*\\n)', 1) AS w FROM o)
SELECT doc_id AS path, CAST(o + octet_length(encode(w)) AS BIGINT) AS "offset", CAST(len(list_filter(string_split(w, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n FROM w""")
def spool_tails(spark, d):
    docs = tables.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("t")).filter(~F.col("t").rlike(r"[^\x00-\x7f]"))
    seen = docs.filter("path % 3 <> 0").select("path", F.lit(100).alias("offset"))
    return spool.tail(docs.select("path", F.encode("t", "utf-8").alias("content")), seen).select("path", "offset", F.size("lines").cast("long").alias("n"))


@query("""WITH t AS (SELECT *, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS scene FROM conversations)
SELECT conv_id, CAST(scene AS BIGINT) AS scene, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM t GROUP BY 1, 2 HAVING max((role = 'assistant')::INT) = 1""")
def streamed_turns(spark, d):
    s = spool.files(spark, d, "conversations").select("conv_id", "turn", "role")
    return spool.run(spark, spool.turns(s), "conv_id long, scene long, n long, first_turn long, last_turn long")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 3 AS tries, CASE WHEN o_orderstatus = 'O' THEN 'ok' WHEN o_orderstatus = 'F' THEN 'failed' END AS r FROM orders)
SELECT id, CASE WHEN r = 'ok' THEN 'done' WHEN r = 'failed' AND tries + 1 >= 3 THEN 'dead' ELSE 'waiting' END AS state, tries + CASE WHEN r = 'failed' THEN 1 ELSE 0 END AS tries FROM o""")
def dead_letters(spark, d):
    o = tables.table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("tries"))
    results = o.filter("o_orderstatus in ('O', 'F')").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "ok").otherwise("failed").alias("outcome"))
    done, waiting, dead = spool.attempt(jobs, lambda _: results)
    named = [x.withColumn("state", F.lit(s)) for x, s in ((done, "done"), (waiting, "waiting"), (dead, "dead"))]
    return named[0].unionByName(named[1]).unionByName(named[2]).select("id", "state", "tries")


@query("""WITH e AS (SELECT epoch_us(ts) // 1000 AS t FROM events), p AS (SELECT t, CASE WHEN lag(t) OVER (ORDER BY t) IS NULL OR t - lag(t) OVER (ORDER BY t) >= 600000 THEN 1 ELSE 0 END AS s FROM e WHERE t > 1704200000000),
b AS (SELECT t, sum(s) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS b FROM p) SELECT CAST(b AS BIGINT) AS burst, min(t) AS first, max(t) AS last, count(*) AS n FROM b GROUP BY 1""")
def change_bursts(spark, d):
    e = tables.table(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return spool.feed(e, 1704200000000, 600_000)
