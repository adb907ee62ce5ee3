"""What texts say: code zones, entity and relation patterns, transcript cleansing by wire format, quoted evidence, loose JSON, and names for folders and keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a line code.
FENCE = r"(?:```|~~~)"
CODE = (
    r"^\s*(?:(?:git|cargo|npm|pnpm|yarn|pip|python3?|node|make|docker|sudo|apt|brew|curl|wget|cd|ls|cat|echo|export|rm|mv|cp|mkdir|touch|grep|sed|awk)\b"
    r"|(?:import|from|def|class|fn|func|const|let|var|struct|impl|enum|package|use|pub|return|if|for|while|switch|match)\b|#!|/\*|//)"
)
PATH = r"\b[\w.-]+\.(?:py|rs|js|ts|tsx|jsx|json|toml|yaml|yml|db|sqlite3?|sql|sh|bash|zsh|go|java|c|cpp|h|hpp|lock|log)\b"
ADDRESS, ASSIGNED = r"\w+://\S+", r"\S+\s*=\s*\S+"

# Entity patterns with their type, the group that is the name, and the least length.
ENTITIES = (
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", "named_entity", 1, 2),
    (r'"([^"]{2,80})"', "quoted_term", 1, 3),
    (r"\b([A-Z][a-zA-Z0-9]*(?:\.[A-Z][a-zA-Z0-9]*)+)\b", "technical_term", 1, 2),
    (r"\b([a-z]+(?:[A-Z][a-z]+)+)\b", "identifier", 1, 5),
    (r"\b([A-Z][a-z]+[A-Z][A-Za-z0-9]*)\b", "technical_term", 1, 4),
    (r"\b([A-Z]{2,}[a-z][A-Za-z0-9]*)\b", "technical_term", 1, 4),
    (r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b", "identifier", 1, 5),
    (r"[《「『]([^》」』]{2,20})[》」』]", "quoted_term", 1, 2),
    (r"(?:(?<=[一-龥])[ \t]*[A-Za-z][A-Za-z0-9._-]{1,15}|[A-Za-z][A-Za-z0-9._-]{1,15}(?=[ \t]*[一-龥]))", "technical_term", 0, 3),
)
# The same patterns where a group repeats, by place, with the same matches: the group never gives back what it took, so the engine's stack doesn't grow with a match.
LONG_ENTITIES = {
    0: r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+\b)++)",
    2: r"\b([A-Z][a-zA-Z0-9]*(?:\.[A-Z][a-zA-Z0-9]*\b)++)",
    3: r"\b([a-z]+(?:[A-Z][a-z]+)++)\b",
    6: r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)++)\b",
}
MOST_ENTITIES, MOST_RELATIONS = 20, 15
# Verbs of a relation between what stands before and what stands after, in English and in Chinese.
RELATIONS = (
    (r"(?:is\s+an?\s+|are\s+)", "is_a"), (r"(?:uses?|utilizes?)\s+", "uses"), (r"(?:depends?\s+on|requires?)\s+", "depends_on"), (r"(?:contains?|has?)\s+", "contains"),
    (r"(?:belongs?\s+to)\s+", "belongs_to"), (r"(?:implements?)\s+", "implements"), (r"(?:connects?\s+to|links?\s+to)\s+", "connected_to"),
    (r"(?:is\s+located\s+in|is\s+based\s+in)\s+", "located_in"), (r"(?:causes?|leads?\s+to|results?\s+in)\s+", "causes"),
    (r"(?:is\s+based\s+on|derives?\s+from|builds?\s+on)\s+", "based_on"), (r"(?:prefers?|likes?|favors?)\s+", "prefers"), (r"(?:decided\s+to\s+(?:adopt|use|choose)|chose)\s+", "decided"),
)
RELATIONS_CJK = (
    ("是(?:一个|一种|一款)?", "is_a"), ("(?<!决定)(?:使用|采用|调用|利用)(?:了|着|过)?", "uses"), ("(?:依赖|需要)(?:了|着|过)?", "depends_on"), ("(?:包含|包括)(?:了|着|过)?", "contains"),
    ("(?:属于|隶属于?)", "belongs_to"), ("(?:实现|落地)(?:了|着|过)?", "implements"), ("(?:连接到|对接|接入|集成(?:了)?)(?:了|着|过)?", "connected_to"), ("(?:位于|坐落于?)", "located_in"),
    ("(?:导致|引发)(?:了|着|过)?", "causes"), ("(?:基于|参考了?|借鉴)(?:了|着|过)?", "based_on"), ("(?:喜欢|偏好|偏爱|首选)(?:了|着|过)?", "prefers"), ("(?:决定(?:采用|使用|选)|选定|选择了|拍板)(?:了|着|过)?", "decided"),
)

# Tag blocks that a wire format injects: dropped with their content, or opened.
BLOCKS = {
    "cc": (("system-reminder", "local-command-stdout", "local-command-caveat", "persisted-output", "command-message", "task_id", "task_type"), ("command-name", "command-args", "task-notification", "tool_use_error", "output", "result")),
    "codex": (("environment_context", "INSTRUCTIONS", "permissions", "approval_policy", "sandbox_mode", "network_access"), ()),
    "dsh": (("system-reminder", "available_skills", "skill_content", "compacted-summary", "goal_round", "long_task_round", "long_task_ledger"), ()),
    "pi": (("bridge_context", "bridge_instructions", "quoted_messages"), ("user_input",)),
}
BLOCKS |= {"omp": BLOCKS["pi"]}
HEADERS = {"codex": r"(?m)^# AGENTS\.md instructions[^\n]*\n?"}

# Where a block's words come from, and how far they are believed.
PROVENANCE = {"user_text": "user_prose", "assistant_text": "agent_assert", "tool_use": "agent_assert", "tool_result": "tool_obs"}
VERACITY = {"user_prose": 1.0, "tool_obs": 0.9, "human": 0.9, "agent_assert": 0.5, "system": 0.5}


def _blank(x: Column) -> Column:
    return F.regexp_replace(x, r"\S", " ")


def mask_code(text: Column) -> Column:
    """The text with fenced blocks and lines that look like code blanked, every line as long as before. A fence that isn't closed goes to the end."""
    line = rf"[^\S\n]*{FENCE}[^\n]*"
    fenced = rf"(?m)^{line}(?:\n(?!{line}$)[^\n]*)*+(?:\n{line}$)?"
    blocks = F.regexp_extract_all(text, F.lit(fenced), F.lit(0))
    looks = lambda x: x.rlike(CODE) | x.rlike(PATH) | x.rlike(ADDRESS) | x.rlike(ASSIGNED)
    plain = lambda part: F.array_join(F.transform(F.split(part, "\n", -1), lambda x: F.when(looks(x), _blank(x)).otherwise(x)), "\n")
    parts = F.split(text, fenced, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(plain(p), _blank(F.coalesce(F.get(blocks, i), F.lit(""))))), "")


def entities(text: Column, most: int = MOST_ENTITIES) -> Column:
    """Names with their type, in the order of the patterns and once each: array of struct(name, entity_type)."""
    # A bare F.trim would be given the index as a second argument, the characters to cut off.

    def named(pattern: str, kind: str, group: int, least: int) -> Column:
        names = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.trim(x))
        return F.transform(F.filter(names, lambda n: F.length(n) >= least), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("entity_type")))

    found = [named(LONG_ENTITIES.get(i, e[0]), *e[1:]) for i, e in enumerate(ENTITIES)]
    every = F.concat(*found)
    names = F.slice(F.array_distinct(F.transform(every, lambda x: x["name"])), 1, most)
    return F.transform(names, lambda n: F.element_at(F.filter(every, lambda x: x["name"] == n), 1))


def relations(text: Column, most: int = MOST_RELATIONS) -> Column:
    """Subject, predicate, object by pattern, in the order of the patterns: array of structs."""
    end = "[一-龥A-Za-z][一-龥A-Za-z0-9]"
    every = [(rf"(?i)(\w[\w\s]{{1,40}}?)\s+{verb}(.+?)(?:\.|,|$)", p) for verb, p in RELATIONS]
    every += [(rf"({end}{{0,7}})\s*{verb}\s*({end}{{0,9}})", p) for verb, p in RELATIONS_CJK]

    def triples(pattern: str, predicate: str) -> Column:
        ends = F.arrays_zip(*[F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), lambda x: F.trim(x)).alias(n) for g, n in ((1, "subject"), (2, "object"))])
        whole = F.filter(ends, lambda x: (F.length(x["subject"]) > 1) & (F.length(x["object"]) > 1))
        return F.transform(whole, lambda x: F.struct(x["subject"].alias("subject"), F.lit(predicate).alias("predicate"), x["object"].alias("object")))

    found = [triples(*e) for e in every]
    return F.slice(F.concat(*found), 1, most)


def whole_word(text: Column, surface: Column) -> Column:
    """Whether ``surface`` stands in the text as a word of its own, whatever the case; shorter than two characters never does."""
    hay, s = F.concat(F.lit(" "), F.lower(text), F.lit(" ")), F.lower(surface)
    pieces = F.split(hay, F.concat(F.lit(r"\Q"), s, F.lit(r"\E")), -1)
    edge = lambda x, at: ~F.when(F.length(x) == 0, F.lit("x")).otherwise(F.right(x, F.lit(1)) if at else F.left(x, F.lit(1))).rlike(r"[\p{L}\p{N}_]")
    found = F.exists(F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces) - 1), lambda a, b: edge(a, True) & edge(b, False)), lambda x: x)
    return (F.length(s) >= 2) & (F.size(pieces) > 1) & found


def cleanse(text: Column, wire: str) -> Column:
    """A transcript text without what the wire format injects; then three or more line ends become two, and ends are trimmed. An unknown format is an error."""
    if wire not in BLOCKS:
        raise ValueError(f"no rules for {wire!r}; there are some for {sorted(BLOCKS)}")
    drop, unwrap = BLOCKS[wire]
    for tags, put in ((drop, ""), (unwrap, "$1")):
        for tag in tags:
            text = F.regexp_replace(text, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", put)
    if wire in HEADERS:
        text = F.regexp_replace(text, HEADERS[wire], "")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def rule_table(wires: Iterable[str] = tuple(BLOCKS)) -> list[tuple[str, str, str]]:
    """(format, tag, action) of every rule."""
    return [(w, tag, action) for w in wires for tags, action in zip(BLOCKS[w], ("drop", "unwrap"), strict=True) for tag in tags]


def verbatim(evidence: Column, segment: Column) -> Column:
    """Whether evidence is quoted from a segment: as it stands, or but for spaces, or but for spaces and the marks * and `."""
    even = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    bare = lambda x: F.regexp_replace(even(x), "[*`]", "")
    return F.contains(segment, evidence) | F.contains(even(segment), even(evidence)) | ((bare(evidence) != "") & F.contains(bare(segment), bare(evidence)))


def provenance(block: Column) -> Column:
    out = F.lit("system")
    for k, v in PROVENANCE.items():
        out = F.when(block == k, v).otherwise(out)
    return out


def veracity(source: Column) -> Column:
    """Null for a source that is not known."""
    out = F.lit(None).cast("double")
    for k, v in VERACITY.items():
        out = F.when(source == k, v).otherwise(out)
    return out


def one_line(text: Column) -> Column:
    return F.trim(F.translate(F.coalesce(text, F.lit("")), "\r\n", "  "))


def yaml_scalar(text: Column) -> Column:
    """A value for front matter, quoted where YAML needs it."""
    s = one_line(text)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(s == "", '""').when(s.rlike(r"""[:#"'\[\]{}`]|^[!&*?|\-+>%@]"""), quoted).otherwise(s)


def link_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def topic(topic: Column, subject: Column, predicate: Column, value: Column) -> Column:
    """The topic, or the triple where there is none."""
    triple = F.concat_ws(" ", F.coalesce(subject, F.lit("?")), F.coalesce(predicate, F.lit("")), F.coalesce(value, F.lit("")))
    return F.when(one_line(topic) != "", one_line(topic)).otherwise(one_line(triple))


def display(n: Column, topic: Column, value: Column, score: Column | None = None, most: int = 200) -> Column:
    """A numbered line of a recall: topic, value (cut), score."""
    v = one_line(value)
    v = F.when(F.length(v) > most, F.concat(F.rtrim(F.left(v, F.lit(most))), F.lit("…"))).otherwise(v)
    out = F.concat(n.cast("string"), F.lit(". "), F.when(one_line(topic) == "", "?").otherwise(one_line(topic)), F.lit(" — "), v)
    return out if score is None else F.concat(out, F.when(score.isNull(), "").otherwise(F.format_string(" [score %.2f]", score)))


def utc(stamp: Column) -> Column:
    """Any ISO instant as UTC seconds; one without an offset is UTC; null if it isn't one."""
    plain = F.trim(stamp)
    zoned = F.when(plain.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), plain).otherwise(F.concat(plain, F.lit("Z")))
    return F.date_trunc("second", F.try_to_timestamp(F.regexp_replace(zoned, r"^(\d{4}-\d\d-\d\d)Z$", "$1T00:00:00Z")))


def folder(cwd: Column, wire: str) -> Column:
    """How a working directory is written in the name of a folder."""
    if wire == "dsh":
        return F.concat(F.lit("--"), F.translate(F.regexp_replace(cwd, "^/+|/+$", ""), "/", "-"), F.lit("--"))
    return F.translate(cwd, "/.", "--") if wire == "cc" else F.concat(F.regexp_replace(cwd, "/+$", ""), F.lit("/memory"))


def repo_tag(cwd: Column, root: str) -> Column:
    """The tag of the repository below ``root`` that a folder lies in; null elsewhere."""
    name = F.regexp_extract(cwd, rf"^\Q{root.rstrip('/')}\E/([^/]+)", 1)
    return F.when(name != "", F.concat(F.lit("repo:"), name))


def session_tags(refs: Column) -> Column:
    """Sessions among the references, without the part after #."""
    own = F.filter(refs, lambda r: r.startswith("session:"))
    return F.array_sort(F.array_distinct(F.transform(own, lambda r: F.regexp_replace(r, r"#\d+$", ""))))


def keys(text: Column) -> tuple[Column, Column, Column]:
    """A text's key in a ledger: whole, short, and of a chunk."""
    sha = F.sha2(text, 256)
    return sha, F.left(sha, F.lit(16)), F.concat(F.lit("chunk:"), F.left(sha, F.lit(16)))


def fenced_json(text: Column) -> Column:
    """JSON that may stand in a code fence, as a variant; null if it doesn't parse."""
    s = F.trim(text)
    body = F.regexp_extract(s, r"(?s)\A```[^\n]*\n(.*)```\s*\z", 1)
    return F.try_parse_json(F.when(s.startswith("```") & (body != ""), body).otherwise(s))


def salvaged_json(text: Column) -> Column:
    """The objects of a loose answer: those of the first list that parses, or else every flat object that stands in the text. Array of JSON texts."""
    listed = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    items = F.from_json(F.to_json(F.try_parse_json(listed)), "array<variant>")
    many = F.filter(F.transform(items, lambda x: F.to_json(x)), lambda x: x.startswith("{"))
    flat = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))
    loose = F.filter(F.transform(flat, lambda x: F.to_json(F.try_parse_json(x))), lambda x: x.isNotNull())
    return F.when(F.size(many) > 0, many).otherwise(loose)


def restricted(extractor: Column, source: Column, sessions: Column, unlocked: bool = False) -> Column:
    """Whether a recall may only be observed: always for pattern facts; with the cold start unlocked, also for model facts of low source that fewer than two sessions confirm."""
    pending = (extractor == "llm") & (F.coalesce(source, F.lit(0.0)) < 0.7) & (F.coalesce(sessions, F.lit(0)) < 2)
    return (F.coalesce(extractor, F.lit("regex")) == "regex") | (pending if unlocked else F.lit(False))
