"""Queries of the text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import extract, scores
from lorekeep.functions import text as texts
from lorekeep.operators import folds
from lorekeep.plans.core import query
from lorekeep.sources import tables

_ASCII = r"regexp_replace(rtrim(coalesce(text, ''), chr(10)), '[^\x00-\x7f]', '~', 'g')"


def _ascii(spark, d, name="documents"):
    """Texts in ASCII, as the other engine's word edges know no other letters."""
    t = tables.table(spark, d, name)
    return t.withColumn("text", F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n+\z", ""), r"[^\x00-\x7f]", "~"))


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_NAMES = " UNION ALL ".join(f"SELECT doc_id, {k} AS p, {_lit(kind)} AS kind, {least} AS least, regexp_extract_all(text, {_lit(p)}, {g}) AS l FROM t" for k, (p, kind, g, least) in enumerate(extract.ENTITIES[:7]))


@query(f"""WITH t AS (SELECT doc_id, {_ASCII} AS text FROM documents), l AS ({_NAMES}),
e AS (SELECT doc_id, p, kind, least, trim(unnest(l)) AS name, generate_subscripts(l, 1) AS i FROM l),
f AS (SELECT doc_id, name, arg_min(kind, p * 10000000 + i) AS entity_type, min(p * 10000000 + i) AS pos FROM e WHERE len(name) >= least GROUP BY 1, 2)
SELECT doc_id, name, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM f) WHERE r <= 20""")
def entity_mentions(spark, d):
    return _ascii(spark, d).select("doc_id", F.inline(extract.entities(F.col("text"))))


_PAIRS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS p, '{p}' AS predicate, regexp_extract_all(text, {_lit(pat)}, 1) AS s, regexp_extract_all(text, {_lit(pat)}, 2) AS o FROM t"
    for k, (pat, p) in enumerate((rf"(?i)(\w[\w\s]{{1,40}}?)\s+{verb}(.+?)(?:\.|,|$)", p) for verb, p in extract.RELATIONS)
)


@query(f"""WITH t AS (SELECT item_id AS doc_id, 'Alpha is a Beta. Gamma uses delta, and ' || {_ASCII} || '. Epsilon depends on zeta' AS text FROM benchmark), l AS ({_PAIRS}),
e AS (SELECT doc_id, p, predicate, trim(unnest(s)) AS subject, trim(unnest(o)) AS object, generate_subscripts(s, 1) AS i FROM l)
SELECT doc_id AS item_id, subject, predicate, object FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, i) AS r FROM e WHERE len(subject) > 1 AND len(object) > 1) WHERE r <= 15""")
def relation_triples(spark, d):
    t = _ascii(spark, d, "benchmark").withColumn("text", F.concat(F.lit("Alpha is a Beta. Gamma uses delta, and "), "text", F.lit(". Epsilon depends on zeta")))
    return t.select("item_id", F.inline(extract.relations(F.col("text"))))


_LOOKS = " OR ".join(f"regexp_matches(x, {_lit(p)})" for p in (extract.CODE, extract.PATH, extract.ADDRESS, extract.ASSIGNED))
_FENCED = "'~~~ a' || chr(10) || 'kept = no' || chr(10) || '~~~' || chr(10) || "


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT doc_id, {_FENCED}{_ASCII} AS t FROM documents)),
f AS (SELECT *, regexp_matches(x, '^\\s*(```|~~~)') AS fence FROM l), g AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f)
SELECT doc_id, sha256(string_agg(CASE WHEN fence OR inside OR {_LOOKS} THEN regexp_replace(x, '\\S', ' ', 'g') ELSE x END, chr(10) ORDER BY i)) AS digest FROM g GROUP BY 1""")
def code_masks(spark, d):
    t = _ascii(spark, d).withColumn("text", F.concat(F.lit("~~~ a\nkept = no\n~~~\n"), "text"))
    return t.select("doc_id", F.sha2(extract.mask_code(F.col("text")), 256).alias("digest"))


def _cleaned(wire: str, x: str) -> str:
    drop, unwrap = extract.BLOCKS[wire]
    for tags, put in ((drop, ""), (unwrap, "\\1")):
        for tag in tags:
            x = f"regexp_replace({x}, '(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>', '{put}', 'g')"
    if wire in extract.HEADERS:
        x = f"regexp_replace({x}, {_lit(extract.HEADERS[wire])}, '', 'g')"
    return f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


_WRAPPED = "'# AGENTS.md instructions x' || chr(10) || '<system-reminder a=\"1\">' || role || '</system-reminder> <command-name>/go</command-name>' || chr(10) || chr(10) || chr(10) || chr(10) || '<bridge_context>' || role || '</bridge_context><user_input>' || regexp_replace(text, '[^\\x00-\\x7f]', '~', 'g') || '</user_input> <goal_round>n</goal_round>'"


@query(" UNION ALL ".join(f"SELECT conv_id, turn, '{w}' AS wire, sha256({_cleaned(w, _WRAPPED)}) AS digest FROM conversations" for w in extract.BLOCKS))
def cleansed_turns(spark, d):
    t = tables.transcripts(spark, d)
    raw = F.concat(F.lit('# AGENTS.md instructions x\n<system-reminder a="1">'), "role", F.lit("</system-reminder> <command-name>/go</command-name>\n\n\n\n<bridge_context>"), "role", F.lit("</bridge_context><user_input>"), F.regexp_replace("text", r"[^\x00-\x7f]", "~"), F.lit("</user_input> <goal_round>n</goal_round>"))
    each = F.array(*[F.struct(F.lit(w).alias("wire"), F.sha2(extract.cleanse(F.col("raw"), w), 256).alias("digest")) for w in extract.BLOCKS])
    return t.select("conv_id", "turn", raw.alias("raw")).select("conv_id", "turn", F.inline(each))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{t}', '{a}')" for w, t, a in extract.rule_table()) + ") AS r(wire, tag, action)")
def cleansing_rules(spark, d):
    return spark.createDataFrame(extract.rule_table(), "wire string, tag string, action string")


_EVEN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_BARE = "regexp_replace(" + _EVEN + ", '[*`]', '', 'g')"


@query(f"""WITH e AS (SELECT item_id, regexp_replace(substring(text, 5, 40), ' ', chr(10) || ' **', 'g') AS e, text AS s FROM benchmark UNION ALL SELECT item_id, reverse(substring(text, 5, 40)), text FROM benchmark)
SELECT item_id, e AS evidence, contains(s, e) OR contains({_EVEN.format('s')}, {_EVEN.format('e')}) OR ({_BARE.format('e')} <> '' AND contains({_BARE.format('s')}, {_BARE.format('e')})) AS ok FROM e""")
def evidence_checks(spark, d):
    b = tables.table(spark, d, "benchmark")
    cut = F.substring("text", 5, 40)
    both = b.select("item_id", "text", F.explode(F.array(F.regexp_replace(cut, " ", "\n **"), F.reverse(cut))).alias("evidence"))
    return both.select("item_id", "evidence", extract.verbatim(F.col("evidence"), F.col("text")).alias("ok"))


_SCALAR = """CASE WHEN s = '' THEN '""' WHEN regexp_matches(s, '[:#"''\\[\\]{}`]|^[!&*?|\\-+>%@]') THEN '"' || replace(replace(s, '\\', '\\\\'), '"', '\\"') || '"' ELSE s END"""


@query(f"""WITH x AS (SELECT page_id, trim(translate(coalesce(url, ''), chr(13) || chr(10), '  ')) AS s FROM pages)
SELECT page_id, {_SCALAR} AS scalar, replace(replace(replace(s, '\\', '\\\\'), '[', '\\['), ']', '\\]') AS link,
  page_id || '. ' || CASE WHEN s = '' THEN '?' ELSE s END || ' — ' || CASE WHEN len(s) > 20 THEN rtrim(left(s, 20)) || '…' ELSE s END AS line FROM x""")
def markdown_fields(spark, d):
    p = tables.table(spark, d, "pages")
    u = extract.one_line(F.col("url"))
    return p.select("page_id", extract.yaml_scalar(F.col("url")).alias("scalar"), extract.link_text(u).alias("link"), extract.display(F.col("page_id"), u, u, most=20).alias("line"))


@query("""WITH w AS (SELECT item_id, split_part(text, ' ', 1) AS surface FROM benchmark), c AS (SELECT conv_id, turn, ' ' || lower(text) || ' ' AS t FROM conversations)
SELECT conv_id, turn, item_id FROM c, w WHERE len(surface) >= 2 AND len(list_filter(regexp_split_to_array(t, '[^\\p{L}\\p{N}_]+'), lambda x: x = lower(surface))) > 0 AND NOT regexp_matches(surface, '[^\\p{L}\\p{N}_]')""")
def dictionary_hits(spark, d):
    """The dictionary is of a checked size, so each text is tried with all of it in place."""
    words = tables.table(spark, d, "benchmark").select("item_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("surface")).filter(~F.col("surface").rlike(r"[^\p{L}\p{N}_]"))
    t = tables.transcripts(spark, d)
    tokens = t.select("conv_id", "turn", "text", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("token"))
    near = tokens.join(words.withColumn("token", F.lower("surface")), "token")
    return near.filter(extract.whole_word(F.col("text"), F.col("surface"))).select("conv_id", "turn", "item_id")


@query("""WITH s AS (SELECT DISTINCT '/home/ws/' || source || '/a.b' AS cwd, source FROM documents)
SELECT cwd, replace(replace(cwd, '/', '-'), '.', '-') AS cc, '--' || replace(trim(cwd, '/'), '/', '-') || '--' AS dsh, cwd || '/memory' AS plain, 'repo:' || source AS tag FROM s""")
def folder_names(spark, d):
    c = F.col("cwd")
    s = tables.table(spark, d, "documents").select(F.concat(F.lit("/home/ws/"), "source", F.lit("/a.b")).alias("cwd")).distinct()
    return s.select("cwd", extract.folder(c, "cc").alias("cc"), extract.folder(c, "dsh").alias("dsh"), extract.folder(c, "plain").alias("plain"), extract.repo_tag(c, "/home/ws").alias("tag"))


@query("""SELECT user_id, list_sort(list(DISTINCT 'session:' || event_type)) AS tags FROM events GROUP BY 1""")
def session_tags(spark, d):
    e = tables.table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.concat(F.lit("session:"), "event_type", F.lit("#"), "event_id")).alias("refs"))
    return e.select("user_id", extract.session_tags(F.concat("refs", F.array(F.lit("file:x")))).alias("tags"))


_SOURCE = "CASE role WHEN 'user' THEN 'user_prose' WHEN 'assistant' THEN 'agent_assert' ELSE 'system' END"


@query(f"SELECT conv_id, turn, {_SOURCE} AS provenance, CASE {_SOURCE} WHEN 'user_prose' THEN 1.0::DOUBLE ELSE 0.5 END AS veracity FROM conversations")
def block_provenance(spark, d):
    p = extract.provenance(F.concat("role", F.lit("_text")))
    return tables.transcripts(spark, d).select("conv_id", "turn", p.alias("provenance"), extract.veracity(p).alias("veracity"))


@query("SELECT event_id, date_trunc('second', ts) - to_hours(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END) AS at FROM events")
def iso_instants(spark, d):
    e = tables.table(spark, d, "events")
    stamp = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise(""))
    return e.select("event_id", extract.utc(stamp).cast("timestamp_ntz").alias("at"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS whole, left(sha256(coalesce(text, '')), 16) AS short, 'chunk:' || left(sha256(coalesce(text, '')), 16) AS chunk FROM documents")
def ledger_keys(spark, d):
    whole, short, chunk = extract.keys(F.coalesce("text", F.lit("")))
    return tables.table(spark, d, "documents").select("doc_id", whole.alias("whole"), short.alias("short"), chunk.alias("chunk"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 2 + event_id % 2 AS n FROM events")
def loose_json(spark, d):
    """A fenced object, and a list or loose objects among words."""
    e = tables.table(spark, d, "events")
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    loose = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("so: ["), "props", F.lit(', {"a": 1}, '), "props", F.lit("] done"))).otherwise(F.concat(F.lit("first "), "props", F.lit(" then {broken} and "), "props"))
    return e.select("event_id", F.try_variant_get(extract.fenced_json(fenced), "$.k", "bigint").alias("k"), F.size(extract.salvaged_json(loose)).cast("long").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount + l_tax = 0 THEN 0.0 ELSE 2 * l_discount * l_tax / (l_discount + l_tax) END, 6) AS harmonic, round(0.5 + 0.5 * least(1.0, l_discount / 0.7), 6) AS source_modifier,
  round(l_quantity * (0.5 + 0.5 * l_tax), 6) AS reranked, round(least(2.0, l_quantity / 30 + l_tax), 6) AS bumped, CAST(ceil(greatest(1, l_partkey // 4) / 100.0) AS BIGINT) AS shards FROM lineitem""")
def score_terms(spark, d):
    li, c = tables.table(spark, d, "lineitem"), F.col
    return li.select(
        "l_orderkey", "l_linenumber", F.round(scores.mem_score(c("l_discount"), c("l_tax"), "harmonic"), 6).alias("harmonic"), F.round(scores.source_modifier(c("l_discount")), 6).alias("source_modifier"),
        F.round(scores.reranked(c("l_quantity"), c("l_tax")), 6).alias("reranked"), F.round(scores.bumped(c("l_quantity") / 30, c("l_tax")), 6).alias("bumped"),
        scores.shards(c("l_partkey"), 100).alias("shards"),
    )


@query("""SELECT user_id, event_type, event_type = 'view' OR (event_type = 'click' AND avg(value) < 0.7 AND count(*) < 2) AS restricted FROM events GROUP BY 1, 2""")
def restricted_refresh(spark, d):
    e = tables.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("source"), F.count("*").alias("n"))
    kind = F.when(F.col("event_type") == "view", "regex").when(F.col("event_type") == "click", "llm").otherwise("human")
    return e.select("user_id", "event_type", extract.restricted(kind, F.col("source"), F.col("n"), unlocked=True).alias("restricted"))


@query(r"""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n(?:[ \t]*\n)+'), lambda x: trim(x)), lambda x: x <> '')) AS p FROM documents)
SELECT doc_id, count(*) AS n, CAST(sum(len(p)) AS BIGINT) AS size FROM p WHERE len(p) <= 1500 GROUP BY 1""")
def paragraph_split(spark, d):
    whole = tables.table(spark, d, "documents").select("doc_id", F.explode(folds.whole_paragraphs(F.col("text"))).alias("w"))
    p = whole.select("doc_id", "w", F.explode(folds.paragraphs(F.col("w"))).alias("p"))
    # One that was divided has none of its parts counted, whatever else the document has.
    return p.filter((F.col("p") == F.col("w")) & (F.length("p") <= 1500)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("size"))


@query("""SELECT part AS name, p_name AS value FROM (SELECT p_name, unnest(string_split(p_name, ' ')) AS part FROM part) WHERE len(part) >= 3 AND NOT regexp_matches(part, '^[A-Z][A-Z0-9_]*_[A-Z0-9_]+$')""")
def entity_names(spark, d):
    p = tables.table(spark, d, "part").select(F.col("p_name").alias("value"), F.explode(F.split("p_name", " ")).alias("name"))
    return p.filter(texts.clean_name(F.col("name")) & ~texts.env_name(F.col("name"))).select("name", "value")
