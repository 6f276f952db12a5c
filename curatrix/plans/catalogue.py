"""Queries over the reference operators, with the SQL that each is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.functions import text as X
from curatrix.operators import curation as C
from curatrix.operators import experts as E
from curatrix.operators import geometry as G
from curatrix.operators import grammar as H
from curatrix.operators import packs as K
from curatrix.operators import profile as P
from curatrix.operators import scoring as S
from curatrix.operators import selection as L
from curatrix.operators import tools as T
from curatrix.schemas import NORMALIZED
from curatrix.session import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


# ---- texts and messages

PATTERN = r"(?s)<\|start\|>(.*?)<\|message\|>(.*?)(<\|end\|>|<\|call\|>|<\|return\|>)"
MSG = f"""
m0 AS (SELECT id, text, ingested_at,
  unnest(regexp_extract_all(text, '{PATTERN}', 1)) AS h,
  unnest(regexp_extract_all(text, '{PATTERN}', 2)) AS c,
  unnest(regexp_extract_all(text, '{PATTERN}', 3)) AS e,
  unnest(range(1, len(regexp_extract_all(text, '{PATTERN}', 1)) + 1)) AS pos
  FROM normalized WHERE text IS NOT NULL),
m AS (SELECT *, CASE WHEN contains(h, '<|channel|>') THEN split_part(h, '<|channel|>', 1) ELSE h END AS role,
  CASE WHEN contains(h, '<|channel|>') THEN substr(h, instr(h, '<|channel|>') + 11) END AS channel FROM m0)
"""
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def norm(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "normalized").where("text is not null")


@query(f"WITH {MSG} SELECT id, ingested_at, pos, role, coalesce(channel, '') AS channel, length(c) AS chars, e AS end_tag FROM m")
def parse_messages(spark, root):
    """Every message of every text."""
    m = norm(spark, root).select("id", "ingested_at", F.posexplode(H.messages("text")).alias("p", "m"))
    return m.select("id", "ingested_at", (F.col("p") + 1).cast("long").alias("pos"), "m.role", F.coalesce("m.channel", F.lit("")).alias("channel"), F.length("m.content").cast("long").alias("chars"), "m.end_tag")


@query(rf"""WITH {MSG},
v AS (SELECT id, text, ingested_at, NOT contains(regexp_replace(text, '{PATTERN}', chr(1), 'g'), '<|start|>') AS ok FROM normalized WHERE text IS NOT NULL),
a AS (SELECT id, ingested_at, count(*) AS n, count(*) FILTER (WHERE role = 'assistant' OR starts_with(role, 'assistant ')) AS na,
  bool_or(role NOT IN ('system','developer','user','assistant') AND NOT starts_with(role, 'assistant')) AS tool,
  arg_max(c, pos) FILTER (WHERE (role = 'assistant' OR starts_with(role, 'assistant ')) AND (channel IS NULL OR channel = 'final')) AS fin
  FROM m GROUP BY id, ingested_at)
SELECT v.id, v.ingested_at, ok AS valid, ok AND length({STRIP.format("coalesce(fin, '')")}) >= 32 AS completion_nonempty,
  ok AND (contains(text, '<|call|>') OR coalesce(tool, false)) AS has_tool,
  CASE WHEN ok THEN coalesce(n, 0) ELSE 0 END::BIGINT AS message_count, CASE WHEN ok THEN coalesce(na, 0) ELSE 0 END::BIGINT AS assistant_count,
  ok AND ends_with(regexp_replace(text, '\s+$', ''), '<|return|>') AS ends_with_return
FROM v LEFT JOIN a ON v.id = a.id AND v.ingested_at = a.ingested_at""")
def quality_flags(spark, root):
    """Flags computed from the texts."""
    q = H.quality_flags("text", F.col("__messages"))
    counts = ("message_count", "assistant_count")
    return H.with_messages(norm(spark, root), "text").select("id", "ingested_at", *[(c.cast("long") if n in counts else c).alias(n) for n, c in q.items()])


@query(rf"""WITH {MSG} SELECT n.id, n.ingested_at, coalesce(string_agg({STRIP.format('c')}, chr(10) || chr(10) ORDER BY pos), '') AS prompt
FROM normalized n LEFT JOIN m ON n.id = m.id AND n.ingested_at = m.ingested_at AND role = 'user' AND {STRIP.format('c')} <> '' WHERE n.text IS NOT NULL GROUP BY n.id, n.ingested_at""")
def prompt_view(spark, root):
    """What the user says."""
    return norm(spark, root).select("id", "ingested_at", H.prompt_view("text").alias("prompt"))


@query(rf"""WITH {MSG}, o AS (SELECT *, CASE WHEN channel = 'analysis' THEN 1 WHEN channel IS NULL OR channel = 'final' THEN 2 ELSE 3 END AS k FROM m
  WHERE (role = 'assistant' OR starts_with(role, 'assistant ')) AND e <> '<|call|>' AND {STRIP.format('c')} <> ''),
b AS (SELECT id, ingested_at, min(k) AS k FROM o GROUP BY ALL),
x AS (SELECT o.id, o.ingested_at, string_agg({STRIP.format('c')}, chr(10) || chr(10) ORDER BY pos) AS t FROM o JOIN b ON o.id = b.id AND o.ingested_at = b.ingested_at AND (b.k = 3 OR o.k = b.k) GROUP BY o.id, o.ingested_at)
SELECT n.id, n.ingested_at, regexp_replace(substr(coalesce(t, ''), 1, 50000), '\s+$', '') AS excerpt FROM normalized n LEFT JOIN x ON n.id = x.id AND n.ingested_at = x.ingested_at WHERE n.text IS NOT NULL""")
def reasoning_excerpt_view(spark, root):
    """What the assistant thinks, or says."""
    return norm(spark, root).select("id", "ingested_at", H.excerpt_view("text").alias("excerpt"))


WHOLE = f"v AS (SELECT id, text, ingested_at, NOT contains(regexp_replace(text, '{PATTERN}', chr(1), 'g'), '<|start|>') AS ok FROM normalized WHERE text IS NOT NULL)"


@query(rf"""WITH RECURSIVE {MSG}, {WHOLE}, p AS (SELECT id, ingested_at, pos, role, h, c, e,
  regexp_extract_all(text, '(?s)(.*?<\|start\|>.*?<\|message\|>.*?(?:<\|end\|>|<\|call\|>|<\|return\|>))', 1)[pos] AS w FROM m),
q AS (SELECT *, sum(length(w)) OVER (PARTITION BY id, ingested_at ORDER BY pos) - length(e) AS stop FROM p)
SELECT q.id, q.ingested_at, (row_number() OVER (PARTITION BY q.id, q.ingested_at ORDER BY pos) - 1)::INT AS k, (stop - length(c))::INT AS start, stop::INT AS stop, c AS content
FROM q JOIN v ON v.id = q.id AND v.ingested_at = q.ingested_at AND v.ok WHERE role = 'assistant' OR starts_with(role, 'assistant ')""")
def assistant_spans(spark, root):
    """Where assistant contents lie in the texts."""
    s = norm(spark, root).select("id", "ingested_at", "text", F.posexplode(H.spans("text")).alias("k", "s"))
    return s.select("id", "ingested_at", "k", "s.start", "s.stop", F.expr("substring(text, s.start + 1, s.stop - s.start)").alias("content"))


@query(f"""WITH {MSG}, r AS (SELECT id, ingested_at, string_agg('<|start|>' || h || '<|message|>' || c || e, '' ORDER BY pos) AS t FROM m GROUP BY ALL)
SELECT n.id, n.ingested_at, sha1(coalesce(t, '')) AS rendered FROM normalized n LEFT JOIN r ON n.id = r.id AND n.ingested_at = r.ingested_at WHERE n.text IS NOT NULL""")
def render_messages(spark, root):
    """Parsed texts rendered again."""
    return norm(spark, root).select("id", "ingested_at", F.sha1(H.render(H.messages("text"))).alias("rendered"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS words,
 CASE WHEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') = '' THEN 'empty' WHEN contains(text, '\boxed') THEN 'boxed' WHEN contains(text, '```') THEN 'code'
  WHEN regexp_full_match(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[-+]?[0-9]+(\.[0-9]+)?') THEN 'numeric'
  WHEN substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 1) IN ('{', '[') THEN 'json' ELSE 'text' END AS kind FROM documents""")
def text_shapes(spark, root):
    """Words and kind of each document."""
    return read_table(spark, root, "documents").select("doc_id", F.when(F.col("text").isNotNull(), X.word_count("text")).cast("long").alias("words"), X.answer_type("text").alias("kind"))


@query(r"""WITH u AS (SELECT DISTINCT dataset, split FROM normalized) SELECT dataset, split,
 CASE WHEN contains(lower(dataset), 'proof') THEN 'proof' WHEN contains(lower(dataset), 'agentic') THEN 'agentic' WHEN contains(lower(dataset), 'science') THEN 'science' WHEN contains(lower(dataset), 'instruction') THEN 'chat_if' ELSE 'math' END AS domain,
 CASE WHEN starts_with(lower(split), 'low') THEN 'low' WHEN starts_with(lower(split), 'medium') THEN 'medium' WHEN starts_with(lower(split), 'high') THEN 'high' END AS difficulty,
 regexp_replace(dataset, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM u""")
def dataset_labels(spark, root):
    """Domain, difficulty and safe name that datasets and splits tell."""
    u = read_table(spark, root, "normalized").select("dataset", "split").distinct()
    return u.select("dataset", "split", X.dataset_domain("dataset").alias("domain"), X.split_difficulty("split").alias("difficulty"), X.safe_name("dataset").alias("safe"))


# Calls whose role names the tool and whose content holds its arguments, and what tools say; as in these tables, no payload
# wraps its arguments. An output belongs to a call if the last call or output before it is a call.
OUTPUT = "role NOT IN ('system','developer','user','assistant') AND NOT starts_with(role, 'assistant') AND trim(role) <> ''"
KEYSET = f"CASE WHEN json_valid(c) AND starts_with({STRIP.format('c')}, chr(123)) THEN coalesce(nullif(array_to_string(list_sort(list_filter(json_keys(c), lambda x: trim(x) <> ''))[1:16], ','), ''), 'dict_empty') WHEN json_valid(c) AND starts_with({STRIP.format('c')}, '[') THEN 'list' ELSE 'nonjson' END"
STATUS = f"CASE WHEN {STRIP.format('c')} = '' THEN 'empty' WHEN regexp_matches(lower(c), 'traceback|error|exception') THEN 'error' WHEN {STRIP.format('c')} IN (chr(123) || chr(125), '[]') THEN 'empty' WHEN json_valid(c) AND starts_with({STRIP.format('c')}, chr(123)) AND list_contains(json_keys(c), 'stderr') THEN 'error' ELSE 'ok' END"
EVENTS = rf"""ev AS (SELECT m.id, m.ingested_at, pos, c, trim(role) AS role, e = '<|call|>' AS call, {OUTPUT} AS output, regexp_extract(role, '^assistant\s+to=(\S+)', 1) AS to_,
    lag(e = '<|call|>') OVER (PARTITION BY m.id, m.ingested_at ORDER BY pos) AS after_call
  FROM m JOIN v ON v.id = m.id AND v.ingested_at = m.ingested_at AND v.ok WHERE e = '<|call|>' OR ({OUTPUT}))"""
SIGNATURE = rf"""{EVENTS},
ca AS (SELECT id, ingested_at, count(*) AS n, list(to_ ORDER BY pos) AS names, list(to_ || '[' || CASE WHEN json_valid(c) AND starts_with({STRIP.format('c')}, chr(123)) THEN array_to_string(list_sort(json_keys(c))[1:16], ',') ELSE '' END || ']' ORDER BY pos) AS args FROM ev WHERE call GROUP BY ALL),
o0 AS (SELECT *, row_number() OVER (PARTITION BY id, ingested_at ORDER BY pos) AS k, {STATUS} AS status, {KEYSET} AS ks FROM ev WHERE output AND after_call),
oc AS (SELECT o0.id, o0.ingested_at, list(status ORDER BY pos) AS status, list(ks ORDER BY pos) AS ks, list(CASE WHEN role = 'tool' THEN names[k] ELSE role END ORDER BY pos) AS roles FROM o0 JOIN ca ON ca.id = o0.id AND ca.ingested_at = o0.ingested_at WHERE k <= ca.n GROUP BY ALL),
i0 AS (SELECT *, row_number() OVER (PARTITION BY id, ingested_at ORDER BY pos) AS k, {STATUS} AS status, {KEYSET} AS ks FROM ev WHERE output),
im AS (SELECT id, ingested_at, list(CASE WHEN role = 'tool' THEN 'tool[' || ks || ']' ELSE role END ORDER BY pos) AS names, list(status ORDER BY pos) AS status, list(ks ORDER BY pos) AS ks FROM i0 WHERE k <= 16 GROUP BY ALL),
fi AS (SELECT id, ingested_at, arg_max(c, pos) FILTER (WHERE (role = 'assistant' OR starts_with(role, 'assistant ')) AND (channel IS NULL OR channel = 'final')) AS fin,
  arg_min(c, pos) FILTER (WHERE role = 'assistant' AND channel = 'analysis' AND {STRIP.format('c')} <> '') AS plan1, arg_min(c, pos) FILTER (WHERE role = 'assistant' AND {STRIP.format('c')} <> '') AS plan2 FROM m GROUP BY ALL),
s AS (SELECT v.id, v.ingested_at, v.ok, coalesce(ca.names, im.names, []) AS names, CASE WHEN ca.n IS NULL THEN list_transform(coalesce(im.names, []), lambda x: x || '[]') ELSE ca.args END AS args,
  CASE WHEN ca.n IS NULL THEN im.status ELSE oc.status END AS status, CASE WHEN ca.n IS NULL THEN im.ks ELSE oc.ks END AS ks, CASE WHEN ca.n IS NULL THEN im.names ELSE oc.roles END AS roles, coalesce(fin, '') AS fin, coalesce(plan1, plan2) AS plan
  FROM v LEFT JOIN ca ON v.id = ca.id AND v.ingested_at = ca.ingested_at LEFT JOIN oc ON v.id = oc.id AND v.ingested_at = oc.ingested_at LEFT JOIN im ON v.id = im.id AND v.ingested_at = im.ingested_at LEFT JOIN fi ON v.id = fi.id AND v.ingested_at = fi.ingested_at),
filled AS (SELECT *, list_concat(coalesce(status, []), list_transform(range(len(names) - coalesce(len(status), 0)), lambda x: 'missing')) AS st, list_concat(coalesce(ks, []), list_transform(range(len(names) - coalesce(len(ks), 0)), lambda x: 'missing')) AS kk, list_concat(coalesce(roles, []), list_transform(range(len(names) - coalesce(len(roles), 0)), lambda x: 'missing')) AS rr, {STRIP.format('fin')} AS f FROM s)"""


def joined_or_none(column: str, by: str) -> str:
    return f"coalesce(nullif(array_to_string({column}, '{by}'), ''), 'none')"


@query(rf"""WITH {MSG}, {WHOLE}, {SIGNATURE} SELECT id, ingested_at, CASE WHEN NOT ok THEN '' ELSE 'TOOL_SEQ: ' || {joined_or_none('names', ' -> ')} || chr(10) || 'CALLS: ' || len(names) || chr(10) || 'ARGS: ' || {joined_or_none('args', ' | ')} || chr(10) || 'RETURNS: ' || {joined_or_none('st', ' | ')}
  || chr(10) || 'RET_KEYS: ' || {joined_or_none('kk', ' | ')} || chr(10) || 'RET_ROLES: ' || {joined_or_none('rr', ' | ')} || chr(10) || 'USED_TOOL_OUTPUT: ' || CASE WHEN regexp_matches(lower(fin), '\btool output\b|\bbased on the tool\b|\baccording to the tool\b') THEN 'yes' ELSE 'no' END
  || chr(10) || 'ANSWER_TYPE: ' || CASE WHEN f = '' THEN 'empty' WHEN contains(f, '\boxed') THEN 'boxed' WHEN contains(f, '```') THEN 'code' WHEN regexp_full_match(f, '[-+]?[0-9]+(\.[0-9]+)?') THEN 'numeric' WHEN substr(f, 1, 1) IN (chr(123), '[') AND json_valid(f) THEN 'json' ELSE 'text' END
  || CASE WHEN plan IS NULL THEN '' ELSE chr(10) || 'PLAN_EXCERPT: ' || rtrim(substr(array_to_string(list_filter(regexp_split_to_array(plan, '\s+'), lambda x: x <> '')[1:128], ' '), 1, 800)) END END AS signature FROM filled""")
def behavior_signature(spark, root):
    """Tool behaviour of the conversations."""
    return norm(spark, root).select("id", "ingested_at", T.behaviour_udf("text").alias("signature"))


@query(f"""WITH {MSG}, {WHOLE}, {EVENTS}, o AS (SELECT id, ingested_at, string_agg(role, ' | ' ORDER BY pos) AS tools, string_agg({KEYSET}, ' | ' ORDER BY pos) AS keysets FROM ev WHERE output GROUP BY ALL)
SELECT v.id, v.ingested_at, coalesce(tools, '') AS tools, coalesce(keysets, '') AS keysets FROM v LEFT JOIN o ON v.id = o.id AND v.ingested_at = o.ingested_at""")
def tool_outputs(spark, root):
    """Which tools speak in a conversation, in order, and the keys of what they say."""
    return norm(spark, root).select("id", "ingested_at", T.output_roles_udf("text").alias("tools"), T.output_keysets_udf("text").alias("keysets"))


@query(rf"""WITH {MSG}, {WHOLE}, {EVENTS} SELECT v.id, v.ingested_at, coalesce(bool_and({STRIP.format('c')} = '' OR NOT regexp_matches({STRIP.format('c')}, '^[\[' || chr(123) || ']') OR json_valid(c)), true) AS ok FROM v LEFT JOIN ev ON v.id = ev.id AND v.ingested_at = ev.ingested_at AND ev.output GROUP BY ALL""")
def tool_payloads(spark, root):
    """Whether the payloads of tools are fine JSON."""
    return norm(spark, root).select("id", "ingested_at", T.tool_payloads_ok_udf("text").alias("ok"))


@query("SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keyset FROM events")
def json_keyset(spark, root):
    """Keys of the events' properties."""
    return read_table(spark, root, "events").select("event_id", T.keyset_udf("props").alias("keyset"))


# ---- filters, pools, keep-first, joins

OK = "coalesce(quality_valid_harmony, false) AND coalesce(quality_completion_nonempty, false) AND coalesce(quality_valid_tool_schema, false)"
POOLS = f"""WITH b AS (SELECT * FROM normalized WHERE {OK}), p AS (
 SELECT id, ingested_at, meta_correctness, stats_char_len, unnest([
  CASE WHEN quality_has_tool THEN 'tool_use' END, CASE WHEN meta_correctness IS NOT NULL THEN 'has_correctness_meta' ELSE 'missing_correctness_meta' END,
  CASE WHEN NOT isnan(meta_correctness) AND meta_correctness >= 0.875 THEN 'high_correctness' END, CASE WHEN NOT isnan(meta_correctness) AND meta_correctness <= 0.25 THEN 'low_correctness' END,
  CASE WHEN NOT isnan(meta_correctness) AND meta_correctness > 0.25 AND meta_correctness < 0.875 THEN 'mid_correctness' END,
  CASE WHEN meta_domain = 'math' AND meta_difficulty_bin = 'high' AND NOT isnan(meta_correctness_high) AND meta_correctness_high >= 0.875 THEN 'math_high_verified_correct' END,
  CASE WHEN source_reasoning = 'on' THEN 'reasoning_on' END, CASE WHEN source_reasoning = 'off' THEN 'reasoning_off' END,
  CASE WHEN source_capability_target = 'chat' THEN 'capability_chat' END, CASE WHEN source_capability_target = 'structured_outputs' THEN 'capability_structured_outputs' END]) AS pool FROM b)"""


@query(f"SELECT id, ingested_at FROM normalized WHERE {OK}")
def base_filter_null_false(spark, root):
    """Rows whose quality flags are all true."""
    df = read_table(spark, root, "normalized")
    return df.where(C.base_quality(df)).select("id", "ingested_at")


@query(f"{POOLS} SELECT id, ingested_at, pool FROM p WHERE pool IS NOT NULL")
def candidate_pools(spark, root):
    """The pools of every good row."""
    df = read_table(spark, root, "normalized")
    return C.pools(df.where(C.base_quality(df))).select("id", "ingested_at", "pool")


@query(f"{POOLS} SELECT pool, count(*) AS n, round(avg(stats_char_len), 6) AS mean_chars FROM p WHERE pool IS NOT NULL GROUP BY pool")
def pool_counts(spark, root):
    """Size of each pool."""
    df = read_table(spark, root, "normalized")
    return C.pools(df.where(C.base_quality(df))).groupBy("pool").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("stats_char_len")).alias("mean_chars"))


@query("SELECT id, ingested_at FROM normalized WHERE coalesce(quality_valid_harmony, false) AND meta_domain IN ('math', 'science') AND meta_difficulty_bin IN ('high', 'medium') AND meta_correctness >= 0.5 AND NOT isnan(meta_correctness)")
def candidate_filters(spark, root):
    """Domain, difficulty and correctness filters."""
    return C.candidate_filter(read_table(spark, root, "normalized"), ("quality_valid_harmony", "absent_flag"), ("math", "science"), ("high", "medium"), 0.5).select("id", "ingested_at")


@query(r"SELECT id, ingested_at FROM normalized WHERE id IS NOT NULL AND ('0x' || substr(sha1(lower(regexp_replace(id, '^\s+|\s+$', '', 'g'))), 1, 8))::BIGINT % 10 < 3")
def hash_sample(spark, root):
    """Three tenths of the ids."""
    return C.hash_sample(read_table(spark, root, "normalized"), 10, 3).select("id", "ingested_at")


@query("SELECT id, dataset, split, ingested_at FROM normalized WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at, dataset, split) = 1")
def exact_dedup_keep_first(spark, root):
    """The first row of each id."""
    return C.keep_first(read_table(spark, root, "normalized"), "id", "ingested_at", "dataset", "split").select("id", "dataset", "split", "ingested_at")


@query("SELECT sha1(text) AS text_id, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_report(spark, root):
    """Texts that several documents share."""
    d = read_table(spark, root, "documents").where("text is not null")
    return d.groupBy(F.sha1("text").alias("text_id")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("SELECT id, written_at FROM embedding_shards WHERE id IN (SELECT id FROM nll_scores)")
def ids_semi_join(spark, root):
    """Embeddings of scored ids."""
    return C.only_ids(read_table(spark, root, "embedding_shards").select("id", "written_at"), read_table(spark, root, "nll_scores"))


@query("SELECT DISTINCT id FROM embedding_shards WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM normalized WHERE id IS NOT NULL)")
def missing_ids_anti(spark, root):
    """Embedded ids without a normalised row."""
    return C.missing_ids(read_table(spark, root, "embedding_shards"), read_table(spark, root, "normalized"))


@query(r"""WITH k AS (SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k, max(lower(regexp_replace(mix_group, '^\s+|\s+$', '', 'g'))) AS g FROM mix_map
  WHERE id IS NOT NULL AND regexp_replace(id, '^\s+|\s+$', '', 'g') <> '' AND regexp_replace(mix_group, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1)
SELECT n.id, n.ingested_at, g AS mix_group FROM normalized n JOIN k ON k.k = lower(regexp_replace(n.id, '^\s+|\s+$', '', 'g')) WHERE g IN ('tool', 'reasoning', 'general')""")
def mix_group_attach(spark, root):
    """Normalised rows with the group of their id."""
    return C.attach_group(read_table(spark, root, "normalized").select("id", "ingested_at"), read_table(spark, root, "mix_map"), ("tool", "reasoning", "general"))


@query("""SELECT id, dataset, split, stats_char_len FROM normalized n WHERE EXISTS (SELECT 1 FROM nll_scores s WHERE s.id = n.id AND s.dataset = n.dataset AND s.subdir = n.split AND s.ppl < 3)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at, text) = 1""")
def export_selected(spark, root):
    """Full rows of well-predicted ids."""
    sel = read_table(spark, root, "nll_scores").where("ppl < 3").select("dataset", F.col("subdir").alias("split"), "id")
    return C.export_selected(sel, read_table(spark, root, "normalized")).select("id", "dataset", "split", "stats_char_len")


# ---- lengths, samples, blocks

@query("""SELECT CASE WHEN coalesce(prompt_tokens, 0) < 128 THEN 'len_00000_00128' WHEN prompt_tokens < 256 THEN 'len_00128_00256' WHEN prompt_tokens < 512 THEN 'len_00256_00512' ELSE 'len_00512_inf' END AS len_bucket,
 count(*) AS n, coalesce(sum(prompt_tokens), 0)::BIGINT AS tokens FROM embedding_shards GROUP BY 1""")
def length_bucket_pack(spark, root):
    """Rows and tokens of each length bucket."""
    b = C.length_buckets(read_table(spark, root, "embedding_shards"), "prompt_tokens")
    return b.groupBy("len_bucket").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("tokens"))


@query("""WITH q AS (SELECT quantile_cont(n_chars, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM documents)
SELECT (n_chars >= q[2])::INT + (n_chars >= q[3])::INT + (n_chars >= q[4])::INT + (n_chars >= q[5])::INT AS stratum, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents, q WHERE n_chars IS NOT NULL GROUP BY 1""")
def length_strata_quantiles(spark, root):
    """Documents by fifths of their length."""
    s, _ = L.length_strata(read_table(spark, root, "documents").where("n_chars is not null"), "n_chars")
    return s.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""WITH s AS (SELECT source, n_chars AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL),
q AS (SELECT unnest([0.5, 0.9, 0.95]) AS q) SELECT source, q::DOUBLE AS q, v AS value FROM s, q WHERE i = round_even(q * (n - 1), 0)""")
def nearest_rank_quantiles(spark, root):
    """Length quantiles of each source, by nearest rank."""
    return P.nearest_rank(read_table(spark, root, "documents"), "n_chars", (0.5, 0.9, 0.95), "source")


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1")
def linear_quantiles(spark, root):
    """Interpolated quantiles of event values."""
    return read_table(spark, root, "events").groupBy("event_type").agg(*[r6(F.percentile("value", q)).alias(n) for n, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))])


@query(r"SELECT coalesce(nullif(regexp_replace(source, '^\s+|\s+$', '', 'g'), ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def value_counts_topn(spark, root):
    """The twenty most frequent sources."""
    return P.value_counts(read_table(spark, root, "documents"), "source", 20)


@query("SELECT doc_id, substr(sha256('7' || chr(10) || doc_id::VARCHAR), 1, 16) AS score FROM documents ORDER BY score, doc_id LIMIT 100")
def min_hash_sample(spark, root):
    """A hundred documents by hash."""
    return C.smallest_hashes(read_table(spark, root, "documents"), 100, "doc_id", 7).select("doc_id", "score")


@query("SELECT source, doc_id, substr(sha256('7' || chr(10) || doc_id::VARCHAR), 1, 16) AS score FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY score, doc_id) <= 5")
def per_source_min_hash(spark, root):
    """Five documents of each source by hash."""
    return C.smallest_hashes(read_table(spark, root, "documents"), 5, "doc_id", 7, "source").select("source", "doc_id", "score")


@query("""WITH p AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT d.source, doc_id, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) - 1 AS turn, place FROM documents d JOIN p ON d.source = p.source""")
def round_robin_union(spark, root):
    """Sources take turns."""
    d = read_table(spark, root, "documents").where("source is not null").select("source", "doc_id")
    return C.round_robin(d, "source", "doc_id").select("source", "doc_id", F.col("turn").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))


@query("""WITH t AS (SELECT doc_id, greatest(coalesce(n_chars, 0), 0) // 4 + 1 AS n FROM documents), o AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM t),
b AS (SELECT *, unnest(range(o // 2048, (o + n - 1) // 2048 + 1)) AS block FROM o)
SELECT doc_id, block, greatest(o, block * 2048) - o AS first, least(o + n, (block + 1) * 2048) - greatest(o, block * 2048) AS length FROM b""")
def block_packing(spark, root):
    """Documents laid end to end in blocks of 2,048 tokens (of four characters)."""
    d = read_table(spark, root, "documents").select("doc_id", F.floor(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)) / 4).alias("t"))
    return C.block_pieces(d, "t", 2048, "doc_id").select("doc_id", "block", "first", "length")


def blocks_sql(block: int, sizes: str) -> str:
    """The pieces of documents laid end to end in blocks."""
    return f"""t AS (SELECT doc_id, {sizes} + 1 AS n FROM documents), o AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM t),
b AS (SELECT *, unnest(range(o // {block}, (o + n - 1) // {block} + 1)) AS block FROM o), p AS (SELECT doc_id, block, greatest(o, block * {block}) - o AS first, least(o + n, (block + 1) * {block}) - greatest(o, block * {block}) AS length FROM b)"""


QUARTER = "greatest(coalesce(n_chars, 0), 0) // 4"
FULL = "SELECT doc_id, block, first, length, 1 AS scored_from FROM p WHERE block IN (SELECT block FROM p GROUP BY 1 HAVING sum(length) = {0})"


def quartered(spark, root):
    return read_table(spark, root, "documents").select("doc_id", F.floor(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)) / 4).alias("t"))


@query(f"WITH {blocks_sql(512, QUARTER)} {FULL.format(512)}")
def blocks_collector(spark, root):
    """Whole blocks of 512 tokens, the first of which isn't scored."""
    return K.blocks(quartered(spark, root), "t", 512, "doc_id").select("doc_id", "block", "first", "length", "scored_from")


@query(f"WITH {blocks_sql(513, QUARTER)} {FULL.format(513)}")
def blocks_parity(spark, root):
    """Whole blocks of one token more."""
    return K.blocks(quartered(spark, root), "t", 512, "doc_id", dialect="parity").select("doc_id", "block", "first", "length", "scored_from")


@query(f"WITH {blocks_sql(512, f'least({QUARTER}, 300)')} SELECT doc_id, block, first, length, 0 AS scored_from FROM p")
def blocks_profiler(spark, root):
    """Rows cut at 300 tokens, the short last block too."""
    return K.blocks(quartered(spark, root), "t", 512, "doc_id", dialect="profiler", row_most=300).select("doc_id", "block", "first", "length", "scored_from")


@query("""WITH d AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), p AS (SELECT unnest(range(200)) AS k)
SELECT doc_id, source FROM d WHERE i IN (SELECT (k * (SELECT count(*) FROM documents)) // 200 FROM p)""")
def strided_sample(spark, root):
    """Two hundred documents at even steps."""
    return C.strided(read_table(spark, root, "documents").select("doc_id", "source"), 200, "doc_id")


@query(rf"""WITH {MSG} SELECT 1 AS one, count(*) AS assistant_messages, sum(length(c))::BIGINT AS chars FROM m JOIN (SELECT DISTINCT id AS i, ingested_at AS a FROM normalized WHERE NOT contains(regexp_replace(text, '{PATTERN}', chr(1), 'g'), '<|start|>')) v ON m.id = v.i AND m.ingested_at = v.a WHERE role = 'assistant' OR starts_with(role, 'assistant ')""")
def token_keep_mask(spark, root):
    """Characters that count for the loss: those in assistant spans."""
    s = norm(spark, root).select(F.explode(H.spans("text")).alias("s"))
    return s.agg(F.count(F.lit(1)).alias("assistant_messages"), F.sum(F.expr("cast(s.stop - s.start as long)")).alias("chars")).select(F.lit(1).alias("one"), "assistant_messages", "chars")


# ---- selection

def emb(spark, root):
    return read_table(spark, root, "embeddings")


@query()
def lsh_buckets(spark, root):
    """Vectors by the side of random planes, with the best of each bucket."""
    k = L.lsh_keys(emb(spark, root).withColumn("score", F.pmod(F.col("vec_id") * 7919, F.lit(1000)).cast("double")), "embedding", 64, 12)
    return L.bucket_best(k, ("bucket_key",), "score", "vec_id", "label")


BUCKETS = "b AS (SELECT doc_id, source, lang, n_chars, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT % 64 AS bucket FROM documents)"


def bucketed(spark, root):
    d = read_table(spark, root, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.withColumn("bucket", F.pmod(F.conv(F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(64)))


@query(f"""WITH {BUCKETS} SELECT bucket, count(*) AS bucket_count, arg_min(doc_id, (-coalesce(n_chars, -1), doc_id)) AS doc_id, max(coalesce(n_chars, -1))::DOUBLE AS score FROM b GROUP BY 1""")
def bucket_best(spark, root):
    """The longest document of each bucket."""
    return L.bucket_best(bucketed(spark, root), ("bucket",), "n_chars", "doc_id")


@query(f"""WITH {BUCKETS}, g AS (SELECT bucket, source, count(*) AS n, arg_min(doc_id, (-coalesce(n_chars, -1), doc_id)) AS doc_id, max(coalesce(n_chars, -1))::DOUBLE AS score FROM b GROUP BY 1, 2)
SELECT bucket, source, doc_id, score, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, doc_id)::INT AS pick, sum(n) OVER (PARTITION BY bucket)::BIGINT AS bucket_count FROM g QUALIFY pick <= 3""")
def bucket_topn_distinct(spark, root):
    """Up to three documents a bucket, of different sources."""
    return L.bucket_top_distinct(bucketed(spark, root), "bucket", "source", "n_chars", "doc_id")


@query(f"""WITH {BUCKETS}, c AS (SELECT bucket, count(*) AS n FROM b GROUP BY 1), h AS (SELECT * FROM c ORDER BY n DESC, bucket LIMIT 16),
t AS (SELECT * FROM c WHERE bucket NOT IN (SELECT bucket FROM h) ORDER BY sha1('0:' || bucket::VARCHAR), bucket LIMIT 4)
SELECT *, 'dense' AS part FROM h UNION ALL SELECT *, 'tail' AS part FROM t""")
def dense_tail_selection(spark, root):
    """Twenty buckets: sixteen of the fullest, four of the others."""
    return L.dense_and_tail(bucketed(spark, root).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), 20, "n", "bucket")


QUOTA = {"en": 40, "de": 20, "fr": 10}


@query("""SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id)::INT AS rank FROM documents WHERE lang IN ('en', 'de', 'fr')
QUALIFY rank <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 20 ELSE 10 END""")
def domain_quota_topk(spark, root):
    """The longest documents of three languages, by quota."""
    return L.quota_top(read_table(spark, root, "documents"), "lang", QUOTA, "n_chars", "doc_id").select("lang", "doc_id", "n_chars", "rank")


@query("""WITH n AS (SELECT event_type AS name, count(*) AS c FROM events GROUP BY 1), r AS (SELECT name, 1001 * c / sum(c) OVER () AS raw FROM n), f AS (SELECT name, floor(raw + 1e-9) AS k, raw - floor(raw + 1e-9) AS rest FROM r)
SELECT name, (k + (row_number() OVER (ORDER BY round(rest, 9) DESC, name) <= 1001 - (SELECT sum(k) FROM f))::INT)::INT AS k FROM f""")
def largest_remainder_alloc(spark, root):
    """1,001 places in proportion to the events of each type."""
    counts = read_table(spark, root, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(sorted(L.largest_remainder(1001, {r.event_type: float(r.n) for r in counts.collect()}).items()), "name string, k int")


@query("""SELECT source, lang, max(n_chars) AS n_chars FROM documents WHERE n_chars IS NOT NULL GROUP BY 1, 2""")
def best_per_domain(spark, root):
    """The longest document of each source and language."""
    d = read_table(spark, root, "documents").where("n_chars is not null")
    return L.best_of_each(d, ("source", "lang"), "n_chars", "doc_id").select("source", "lang", "n_chars")


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events), n AS (SELECT * FROM r WHERE t <= 4), a AS (SELECT event_id FROM n WHERE t = 1 ORDER BY event_id LIMIT 50),
p AS (SELECT event_id, user_id, CASE WHEN event_id IN (SELECT event_id FROM a) THEN 1 ELSE 2 END AS phase FROM n) SELECT * FROM p ORDER BY phase, event_id LIMIT 120""")
def tool_seq_backfill(spark, root):
    """120 events, 50 users first, four of a user at most."""
    return L.sequence_backfill(read_table(spark, root, "events").select("event_id", "user_id"), 120, "user_id", "event_id", 4, 50)


@query("SELECT l_orderkey, l_linenumber, (l_linenumber::BIGINT << 32) | l_orderkey AS key FROM lineitem")
def composite_keys(spark, root):
    """Line number and order in one number."""
    return read_table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", L.composite_key("l_linenumber", "l_orderkey", 32).alias("key"))


# The walk bucket by bucket, with what is picked so far in lists; no second walk is needed on these tables.
@query(f"""WITH RECURSIVE {BUCKETS}, d AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS bucket_count, row_number() OVER (PARTITION BY bucket, lang ORDER BY coalesce(n_chars, -1) DESC, doc_id) AS k FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY coalesce(n_chars, -1) DESC, doc_id) AS pick FROM d WHERE k = 1),
o AS (SELECT *, dense_rank() OVER (ORDER BY bucket_count DESC, bucket) AS i FROM t WHERE pick <= 3),
g AS (SELECT i, list(struct_pack(l := coalesce(lang, '~'), d := doc_id) ORDER BY pick) AS c FROM o GROUP BY i),
w AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ls, []::BIGINT[] AS ds, 0::BIGINT AS m
  UNION ALL SELECT i, CASE WHEN p IS NOT NULL THEN list_append(ls, p.l) ELSE ls END, CASE WHEN p IS NOT NULL THEN list_append(ds, p.d) ELSE ds END, m + 1 FROM (
    SELECT g.i AS i, ls, ds, m, CASE WHEN len(ds) < 20 THEN list_filter(g.c, lambda x: len(list_filter(ls, lambda y: y = x.l)) < 7)[1] END AS p FROM w JOIN g ON g.i = w.i + 1)),
z AS (SELECT unnest(ds) AS doc_id FROM w WHERE i = (SELECT max(i) FROM g))
SELECT bucket, lang, doc_id, coalesce(n_chars, -1)::DOUBLE AS score, pick::INT AS pick, bucket_count FROM o JOIN z USING (doc_id)""")
def capped_cover_selection(spark, root):
    """Twenty buckets, no language over its cap."""
    best = L.bucket_top_distinct(bucketed(spark, root), "bucket", "lang", "n_chars", "doc_id")
    return L.capped_pick(best, 20, "lang", "bucket", "bucket_count", "score", "doc_id")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")
def tool_seq_cap(spark, root):
    """At most three events a user."""
    return L.sequence_cap(read_table(spark, root, "events").select("user_id", "event_id", "value"), "user_id", "event_id", 3)


# ---- geometry

@query("SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS mean_norm FROM embeddings GROUP BY 1")
def l2_norm_stats(spark, root):
    """Mean length of the vectors of each label."""
    return emb(spark, root).groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(G.l2_norm("embedding"))).alias("mean_norm"))


KNN = """WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, a.label AS la, b.label AS lb, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour)::INT AS rank FROM p QUALIFY rank <= 10)"""


def near(spark, root):
    e = emb(spark, root)
    return G.knn(e, e.where("vec_id % 20 = 0"), 10, "vec_id", "embedding")


@query(f"{KNN} SELECT query, neighbour, cosine, rank FROM k")
def cosine_knn(spark, root):
    """The ten most similar vectors of every vector whose id 20 divides."""
    return near(spark, root)


@query(f"{KNN} SELECT t::DOUBLE AS threshold, round(avg((cosine >= t)::INT), 6) AS rate FROM k, (SELECT unnest([0.5, 0.7, 0.9]) AS t) WHERE rank = 1 GROUP BY 1")
def knn_dup_rate(spark, root):
    """Shares of vectors with a neighbour that near."""
    return G.near_duplicate_rates(near(spark, root), (0.5, 0.7, 0.9)).select("threshold", r6("rate").alias("rate"))


@query(f"{KNN}, q AS (SELECT query, avg((la = lb)::INT) AS p FROM k GROUP BY 1) SELECT round(avg(p), 6) AS purity FROM q")
def label_purity(spark, root):
    """How often neighbours share the label."""
    return G.label_purity(near(spark, root), emb(spark, root), "vec_id", "label").select(r6("purity").alias("purity"))


@query(f"{KNN} SELECT query, cosine FROM k WHERE rank = 1 ORDER BY cosine, query LIMIT 10")
def outliers(spark, root):
    """The vectors furthest from any other."""
    return G.outliers(near(spark, root))


def nearest_sql(dims: int) -> str:
    dot = f"list_inner_product(a.embedding[1:{dims}]::DOUBLE[], b.embedding[1:{dims}]::DOUBLE[])"
    size = lambda x: f"sqrt(list_inner_product({x}.embedding[1:{dims}]::DOUBLE[], {x}.embedding[1:{dims}]::DOUBLE[]))"
    return f"SELECT a.vec_id AS q, b.vec_id AS n, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({dot} / {size('a')} / {size('b')}, 6) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"


@query(f"WITH a AS (SELECT * FROM ({nearest_sql(64)}) WHERE r <= 10), b AS (SELECT * FROM ({nearest_sql(32)}) WHERE r <= 10) SELECT (SELECT count(*) FROM a JOIN b USING (q, n)) / 10.0 / (SELECT count(DISTINCT q) FROM a)::DOUBLE AS overlap")
def neighbour_overlap(spark, root):
    """Neighbours in all dimensions against those in the first 32."""
    e = emb(spark, root)
    half = e.withColumn("embedding", F.slice("embedding", 1, 32))
    return G.neighbour_overlap(near(spark, root), G.knn(half, half.where("vec_id % 20 = 0"), 10, "vec_id", "embedding"), 10)


@query()
def pca_projection(spark, root):
    """Three principal coordinates of every vector."""
    comp, mean, _ = G.pca(emb(spark, root), "embedding", 64)
    return G.project(emb(spark, root), "embedding", comp, mean).select("vec_id", "label", *[r6(c).alias(c) for c in ("pca_x", "pca_y", "pca_z")])


XYZ = "e AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), q AS (SELECT quantile_cont(x, [0.005, 0.995]) AS qx, quantile_cont(y, [0.005, 0.995]) AS qy, quantile_cont(z, [0.005, 0.995]) AS qz FROM e)"
CUBE = f"""WITH {XYZ}, c AS (SELECT label, {", ".join(f"greatest(0, least(7, floor(({v} - q{v}[1]) / (q{v}[2] - q{v}[1]) * 8)))::INT AS \"b{v}\"" for v in "xyz")} FROM e, q)"""


def axes(spark, root):
    return emb(spark, root).select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


@query(f"{CUBE} SELECT label, bx, \"by\", bz, count(*) AS count FROM c GROUP BY ALL")
def density_bins(spark, root):
    """Vectors in cubes of their first three coordinates."""
    return G.density_bins(axes(spark, root), "x", "y", "z", ("label",), 16, 8).where("kind = 'xyz'").drop("kind")


@query(f"{CUBE}, b AS (SELECT label, bx, \"by\", bz, count(*) AS n FROM c GROUP BY ALL) SELECT label, sum(n)::BIGINT AS points, count(*) AS cells, round(sum(n) / count(*), 6) AS mean_points, round(count(*) / 512.0, 6) AS occupancy FROM b GROUP BY 1")
def density_group_stats(spark, root):
    """How the labels fill the cubes."""
    s = G.density_stats(G.density_bins(axes(spark, root), "x", "y", "z", ("label",), 16, 8), ("label",), "xyz", 8)
    return s.select("label", "points", "cells", r6("mean_points").alias("mean_points"), r6("occupancy").alias("occupancy"))


@query(r"""WITH c AS (SELECT coalesce(nullif(regexp_replace(source, '^\s+|\s+$', '', 'g'), ''), 'unknown') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT n, row_number() OVER (ORDER BY n, s) AS i, count(*) OVER () AS g, sum(n) OVER () AS t FROM c)
SELECT max(g) AS groups, round((sum((2 * i - g - 1) * n) / max(g * t))::DOUBLE, 6) AS gini, round(exp(-sum(n / t * ln(n / t))), 6) AS effective, round((1 / sum((n / t) * (n / t)))::DOUBLE, 6) AS inverse_simpson, round((max(n) / max(t))::DOUBLE, 6) AS top_share FROM r""")
def gini_effective_groups(spark, root):
    """How evenly documents spread over sources."""
    b = G.balance(P.value_counts(read_table(spark, root, "documents"), "source"))
    return b.select("groups", *[r6(c).alias(c) for c in ("gini", "effective", "inverse_simpson", "top_share")])


@query()
def kmeans_kpis(spark, root):
    """Balance of twenty spherical k-means clusters."""
    return G.balance(G.kmeans_sizes(emb(spark, root), "embedding", 20))


# ---- scores: events play the token facts

FACTS = "f AS (SELECT event_type AS pack, 'm' || (user_id % 2) AS model, -value / 50 AS logprob, exp(-value / 50) AS p, ('0x' || substr(sha1(event_id::VARCHAR), 1, 6))::BIGINT / 16777216.0 AS h FROM events)"


def facts(spark, root):
    h = F.conv(F.substring(F.sha1(F.col("event_id").cast("string")), 1, 6), 16, 10).cast("double") / 16777216.0
    lp = -F.col("value") / 50
    return read_table(spark, root, "events").select(F.col("event_type").alias("pack"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(2))).alias("model"), lp.alias("logprob"), F.exp(lp).alias("p"), h.alias("h"))


@query(f"WITH {FACTS} SELECT pack, model, count(*) AS tokens, round(-sum(logprob), 6) AS nll_sum, round(-avg(logprob), 6) AS nll_mean, round(exp(least(30, -avg(logprob))), 6) AS ppl FROM f GROUP BY 1, 2")
def nll_ppl_per_group(spark, root):
    """Perplexity of each pack and model."""
    p = S.perplexity(facts(spark, root), ("pack", "model"))
    return p.select("pack", "model", "tokens", *[r6(c).alias(c) for c in ("nll_sum", "nll_mean", "ppl")])


@query("""SELECT model, dataset, count(*) AS n, sum(completion_token_count)::BIGINT AS tokens, round(exp(least(30, sum(nll_sum) / sum(completion_token_count))), 6) AS ppl
FROM (SELECT DISTINCT id, model, dataset, nll_sum, completion_token_count FROM nll_scores WHERE completion_token_count > 0 AND NOT isnan(nll_sum)) GROUP BY 1, 2""")
def corpus_perplexity(spark, root):
    """Perplexity of each dataset from the scores of its texts."""
    s = read_table(spark, root, "nll_scores").where("completion_token_count > 0 and not isnan(nll_sum)").select("id", "model", "dataset", "nll_sum", "completion_token_count").distinct()
    g = s.groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("completion_token_count").alias("tokens"), F.sum("nll_sum").alias("s"))
    return g.select("model", "dataset", "n", "tokens", r6(F.exp(F.least(F.lit(30.0), F.col("s") / F.col("tokens")))).alias("ppl"))


CUTS = "t AS (SELECT pack, model, quantile_cont(p, 0.15) AS tp, quantile_cont(h, 0.15) AS th FROM f GROUP BY 1, 2)"


@query(f"""WITH {FACTS}, {CUTS} SELECT pack, model, round(avg((p <= tp AND h <= th)::INT), 6) AS cc_rate, round(avg((p <= tp AND h > th)::INT), 6) AS lh, round(avg((p > tp AND h <= th)::INT), 6) AS hl, round(avg((p > tp AND h > th)::INT), 6) AS hh
FROM f JOIN t USING (pack, model) GROUP BY 1, 2""")
def cc_rate_quadrants(spark, root):
    """Confident conflicts and the other quadrants."""
    q = S.quadrants(facts(spark, root), ("pack", "model"), "p", "h")
    return q.select("pack", "model", *[r6(c).alias(c) for c in ("cc_rate", "lh", "hl", "hh")])


def bins(c: str, n: int) -> str:
    return f"least({n - 1}, floor({c} * {n}))::INT"


@query(f"WITH {FACTS} SELECT pack, {bins('h', 40)} AS bin, count(*) AS n FROM f WHERE h BETWEEN 0 AND 1 GROUP BY 1, 2")
def hist1d(spark, root):
    """Histogram of entropies."""
    return S.histogram(facts(spark, root), ("pack",), "h", 0.0, 1.0, 40)


@query(f"WITH {FACTS} SELECT pack, model, {bins('p', 16)} AS ix, {bins('h', 12)} AS iy, count(*) AS n FROM f WHERE p BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1 GROUP BY ALL")
def hist2d(spark, root):
    """Histogram of probability and entropy."""
    return S.histogram_2d(facts(spark, root), ("pack", "model"), "p", "h", (0.0, 1.0, 16), (0.0, 1.0, 12))


@query(f"""WITH {FACTS}, b AS (SELECT pack, {bins('h', 40)} AS bin, count(*) AS n FROM f GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY pack ORDER BY bin) AS c, sum(n) OVER (PARTITION BY pack) AS t FROM b)
SELECT pack, round((min(bin) + 1) / 40.0, 6)::DOUBLE AS value FROM c WHERE c >= 0.9 * t GROUP BY 1""")
def hist_quantile(spark, root):
    """The ninth decile as the histogram tells it."""
    q = S.histogram_quantile(S.histogram(facts(spark, root), ("pack",), "h", 0.0, 1.0, 40), ("pack",), 0.9, 0.0, 1.0, 40)
    return q.select("pack", r6("value").alias("value"))


JS = f"""b AS (SELECT pack, model, {bins('h', 40)} AS bin, count(*) AS n FROM f GROUP BY ALL), u AS (SELECT pack, bin, coalesce(sum(n) FILTER (WHERE model = 'm0'), 0) AS a, coalesce(sum(n) FILTER (WHERE model = 'm1'), 0) AS c FROM b GROUP BY 1, 2),
v AS (SELECT pack, bin, a / sum(a) OVER (PARTITION BY pack) AS p, c / sum(c) OVER (PARTITION BY pack) AS q FROM u),
js AS (SELECT pack, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js FROM v GROUP BY 1)"""


def js_table(spark, root):
    h = S.histogram(facts(spark, root), ("pack", "model"), "h", 0.0, 1.0, 40)
    one = lambda m: h.where(F.col("model") == m).drop("model")
    return S.js_divergence(one("m0"), one("m1"), ("pack",), ("bin",))


@query(f"WITH {FACTS}, {JS} SELECT pack, round(js, 6) AS js FROM js")
def js_divergence_pair(spark, root):
    """Divergence of the two models' entropies."""
    return js_table(spark, root).select("pack", r6("js").alias("js"))


def js_dialect_sql(dialect: str) -> str:
    x, y = {"clip": ("greatest(p, 1e-12)", "greatest(q, 1e-12)"), "add": ("(p + 1e-12)", "(q + 1e-12)"), "clip_mean": ("greatest(p, 1e-12)", "greatest(q, 1e-12)")}[dialect]
    m = "greatest((p + q) / 2, 1e-12)" if dialect == "clip" else f"(({x} + {y}) / 2)"
    return f"SELECT pack, '{dialect}' AS dialect, round(sum({x} * ln({x} / {m}) + {y} * ln({y} / {m})) / 2, 6) AS js FROM v GROUP BY 1"


@query(f"WITH {FACTS}, {JS} {' UNION ALL '.join(map(js_dialect_sql, ('clip', 'clip_mean', 'add')))}")
def js_dialects(spark, root):
    """The same divergence as three other programs write it."""
    h = S.histogram(facts(spark, root), ("pack", "model"), "h", 0.0, 1.0, 40)
    one = lambda m: h.where(F.col("model") == m).drop("model")
    out = [S.js_divergence(one("m0"), one("m1"), ("pack",), ("bin",), d).select("pack", F.lit(d).alias("dialect"), r6("js").alias("js")) for d in ("clip", "clip_mean", "add")]
    return out[0].unionByName(out[1]).unionByName(out[2])


RUNS = f"{FACTS}, {CUTS}, r AS (SELECT pack, model, 1024 AS seq_len, exp(-avg(logprob)) AS ppl, avg((p <= tp AND h <= th)::INT) AS cc_rate, avg(p) AS mean_prob FROM f JOIN t USING (pack, model) GROUP BY 1, 2)"


def runs(spark, root):
    f = facts(spark, root)
    m = f.groupBy("pack", "model").agg(F.exp(-F.avg("logprob")).alias("ppl"), F.avg("p").alias("mean_prob"))
    return m.join(S.quadrants(f, ("pack", "model"), "p", "h").select("pack", "model", "cc_rate"), ["pack", "model"]).withColumn("seq_len", F.lit(1024))


DELTA = f"WITH {RUNS}, {JS}, d AS (SELECT a.pack, a.seq_len, a.ppl AS b, c.ppl - a.ppl AS d_ppl, c.cc_rate - a.cc_rate AS d_cc, c.mean_prob - a.mean_prob AS d_p, js.js AS js FROM r a JOIN r c ON a.pack = c.pack AND a.model = 'm0' AND c.model = 'm1' JOIN js ON js.pack = a.pack)"


def deltas(spark, root):
    r = runs(spark, root)
    return S.gate(r.where("model = 'm0'"), r.where("model = 'm1'"), js_table(spark, root).withColumn("seq_len", F.lit(1024)))


@query(f"{DELTA} SELECT pack, seq_len, round(d_ppl, 6) AS d_ppl, round(d_cc, 6) AS d_cc, round(d_p, 6) AS d_p, round(js, 6) AS js, abs(d_ppl) <= 0.25 AND abs(d_ppl) <= 0.05 * b AND abs(d_cc) <= 0.002 AND abs(d_p) <= 0.02 AND js <= 0.02 AS accepted FROM d")
def pair_gate(spark, root):
    """Whether one model may stand for the other."""
    return deltas(spark, root).select("pack", "seq_len", *[r6(c).alias(c) for c in ("d_ppl", "d_cc", "d_p", "js")], "accepted")


Z = "({0} - avg({0}) OVER w) / CASE WHEN stddev_pop({0}) OVER w = 0 THEN 1e-9 ELSE stddev_pop({0}) OVER w END"


@query(f"{DELTA}, l AS (SELECT *, -d_p AS lost FROM d) SELECT pack, seq_len, round({Z.format('d_ppl')} + {Z.format('d_cc')} + {Z.format('js')} + {Z.format('lost')}, 5) AS score FROM l WINDOW w AS (PARTITION BY seq_len)")
def degradation_score(spark, root):
    """Composite degradation of each pack."""
    return S.degradation(deltas(spark, root)).select("pack", "seq_len", F.round("score", 5).alias("score"))


@query(f"WITH {RUNS}, a AS (SELECT seq_len, model, avg(ppl) AS ppl, avg(cc_rate) AS cc_rate, avg(mean_prob) AS mean_prob FROM r GROUP BY 1, 2) SELECT seq_len, model, round(ppl, 6) AS ppl, round(-({Z.format('ppl')}) - ({Z.format('cc_rate')}) + {Z.format('mean_prob')}, 5) AS quality FROM a WINDOW w AS (PARTITION BY seq_len)")
def model_leaderboard(spark, root):
    """Models by quality."""
    return S.leaderboard(runs(spark, root)).select("seq_len", "model", r6("ppl").alias("ppl"), F.round("quality", 5).alias("quality"))


@query(f"""WITH {RUNS}, d AS (SELECT a.model, b.model AS o, avg(b.ppl - a.ppl) AS p, avg(b.cc_rate - a.cc_rate) AS c, avg(b.mean_prob - a.mean_prob) AS q FROM r a JOIN r b ON a.pack = b.pack AND a.seq_len = b.seq_len AND a.model <> b.model GROUP BY 1, 2)
SELECT model, sum((p > 1e-9 AND c > 1e-9 AND q < -1e-9)::INT)::BIGINT AS wins FROM d GROUP BY 1""")
def pairwise_ordering(spark, root):
    """Models by the others they beat."""
    return S.pairwise_wins(runs(spark, root))


@query(f"""WITH {FACTS}, {CUTS}, b AS (SELECT pack, model, {bins('p', 16)} AS ix, {bins('h', 12)} AS iy, count(*) AS n FROM f GROUP BY ALL)
SELECT pack, model, round(sum(CASE WHEN ix / 16.0 <= tp AND iy / 12.0 <= th THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS cc_rate FROM b JOIN t USING (pack, model) GROUP BY 1, 2""")
def cc_from_histogram(spark, root):
    """Conflict rate from the histogram alone."""
    xr, yr = (0.0, 1.0, 16), (0.0, 1.0, 12)
    f = facts(spark, root)
    cuts = S.quadrants(f, ("pack", "model"), "p", "h").select("pack", "model", "t_p", "t_h")
    c = S.conflicts_from_histogram(S.histogram_2d(f, ("pack", "model"), "p", "h", xr, yr), cuts, ("pack", "model"), xr, yr)
    return c.select("pack", "model", r6("cc_rate").alias("cc_rate"))


ERF = "(CASE WHEN {x} < 0 THEN -1 ELSE 1 END) * (1 - ((((1.061405429 * (1 / (1 + 0.3275911 * abs({x}))) - 1.453152027) * (1 / (1 + 0.3275911 * abs({x}))) + 1.421413741) * (1 / (1 + 0.3275911 * abs({x}))) - 0.284496736) * (1 / (1 + 0.3275911 * abs({x}))) + 0.254829592) * (1 / (1 + 0.3275911 * abs({x}))) * exp(-{x} * {x}))"
MEANS = "s AS (SELECT pack, model, avg(logprob) AS m, var_pop(logprob) AS v, count(*) AS n FROM f GROUP BY 1, 2), j AS (SELECT a.pack, a.m AS m1, a.v AS v1, a.n AS n1, b.m AS m2, b.v AS v2, b.n AS n2 FROM s a JOIN s b ON a.pack = b.pack AND a.model = 'm0' AND b.model = 'm1'), z AS (SELECT *, (m2 - m1) / sqrt(v1 / n1 + v2 / n2) AS z, sqrt(v1 / n1 + v2 / n2) AS se FROM j)"


@query(f"WITH {FACTS}, s AS (SELECT pack, model, -avg(logprob) AS m, var_pop(logprob) AS v, count(*) AS n FROM f GROUP BY 1, 2) SELECT pack, model, round(m - 1.96 * sqrt(v / n), 6) AS nll_lo, round(m + 1.96 * sqrt(v / n), 6) AS nll_hi, round(exp(m - 1.96 * sqrt(v / n)), 6) AS ppl_lo, round(exp(m + 1.96 * sqrt(v / n)), 6) AS ppl_hi FROM s")
def nll_intervals(spark, root):
    """Intervals of each model's mean negative log-likelihood and perplexity."""
    m = facts(spark, root).groupBy("pack", "model").agg((-F.avg("logprob")).alias("m"), F.var_pop("logprob").alias("v"), F.count(F.lit(1)).alias("n"))
    return m.select("pack", "model", *[r6(c).alias(n) for n, c in S.nll_interval("m", "v", "n").items()])


@query(f"WITH {FACTS}, {MEANS} SELECT pack, round(m2 - m1 - 1.96 * se, 6) AS lo, round(m2 - m1 + 1.96 * se, 6) AS hi FROM z")
def delta_intervals(spark, root):
    """Intervals of the models' differences."""
    m = facts(spark, root).groupBy("pack", "model").agg(F.avg("logprob").alias("m"), F.var_pop("logprob").alias("v"), F.count(F.lit(1)).alias("n"))
    side = lambda k, i: m.where(F.col("model") == k).select("pack", F.col("m").alias(f"m{i}"), F.col("v").alias(f"v{i}"), F.col("n").alias(f"n{i}"))
    lo, hi = S.delta_interval("m1", "v1", "n1", "m2", "v2", "n2")
    return side("m0", 1).join(side("m1", 2), "pack").select("pack", r6(lo).alias("lo"), r6(hi).alias("hi"))


@query(f"""{DELTA}, l AS (SELECT *, -d_p AS lost FROM d), c AS (SELECT *, {Z.format('d_ppl')} + {Z.format('d_cc')} + {Z.format('js')} + {Z.format('lost')} AS score FROM l WINDOW w AS (PARTITION BY seq_len)), y AS (SELECT *, {Z.format('score')} AS z FROM c WINDOW w AS (PARTITION BY seq_len)),
p AS (SELECT *, 1 - {ERF.format(x='(abs(z) / sqrt(2.0))')} AS p FROM y)
SELECT pack, seq_len, round(z, 5) AS z, round(p, 5) AS p, CASE WHEN d_ppl > 0 AND d_cc > 0 AND js > 0 AND z >= 2 AND p < 0.05 THEN 'worse' WHEN d_ppl < 0 AND d_cc < 0 AND z <= -2 AND p < 0.05 THEN 'better' ELSE 'mixed' END AS verdict FROM p""")
def pack_verdicts(spark, root):
    """Whether a pack got definitely worse or better."""
    v = S.verdicts(S.degradation(deltas(spark, root)))
    return v.select("pack", "seq_len", F.round("z", 5).alias("z"), F.round("p", 5).alias("p"), "verdict")


@query(f"WITH {FACTS}, {MEANS} SELECT pack, round(z, 6) AS z, round(1 - {ERF.format(x='(abs(z) / sqrt(2.0))')}, 6) AS p FROM z")
def significance(spark, root):
    """Differences of the models' mean log-probabilities, with z and p."""
    m = facts(spark, root).groupBy("pack", "model").agg(F.avg("logprob").alias("m"), F.var_pop("logprob").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    a = m.where("model = 'm0'").select("pack", F.col("m").alias("m1"), F.col("v").alias("v1"), F.col("n").alias("n1"))
    b = m.where("model = 'm1'").select("pack", F.col("m").alias("m2"), F.col("v").alias("v2"), F.col("n").alias("n2"))
    z, p = S.welch("m1", "v1", "n1", "m2", "v2", "n2")
    return a.join(b, "pack").select("pack", r6(z).alias("z"), r6(p).alias("p"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:20], lambda x: exp(x::DOUBLE)) AS p FROM embeddings), s AS (SELECT vec_id, p, list_sum(p) AS t FROM e)
SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x / t * ln(x / t))) / ln(20), 6) AS entropy FROM s""")
def topk_entropy(spark, root):
    """Entropy of twenty probabilities, between 0 and 1."""
    return emb(spark, root).select("vec_id", r6(S.topk_entropy(F.slice("embedding", 1, 20))).alias("entropy"))


@query(f"""WITH {FACTS}, t AS (SELECT quantile_cont(p, 0.15) AS tp, quantile_cont(h, 0.15) AS th FROM f), r AS (SELECT CASE WHEN p >= tp AND h <= th THEN 'good' WHEN p < tp AND h <= th THEN 'conflict' ELSE 'uncertain' END AS region FROM f, t)
SELECT region, count(*) AS n, round(sum(CASE region WHEN 'good' THEN 1.0 WHEN 'conflict' THEN -2.0 ELSE 0.25 END), 6)::DOUBLE AS weight FROM r GROUP BY 1""")
def token_weight_regions(spark, root):
    """Tokens by region, with their weight."""
    r = S.token_regions(facts(spark, root), "p", "h")
    return r.groupBy("region").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("weight")).alias("weight"))


# ---- experts: line items play the router facts

ROUTER = "f AS (SELECT l_linenumber AS layer, l_suppkey % 16 AS expert, l_discount + 0.01 AS gate, l_quantity AS norm, l_orderkey AS token FROM lineitem)"
SAL = f"""{ROUTER}, s AS (SELECT layer, expert, count(*) AS count, sum(gate) AS gate_sum, sum(norm) AS norm_sum, sum(gate * norm) AS gate_norm_sum FROM f GROUP BY 1, 2),
z AS (SELECT a.layer, b.expert, coalesce(count, 0) AS count, coalesce(gate_sum, 0) AS gate_sum, coalesce(norm_sum, 0) AS norm_sum, coalesce(gate_norm_sum, 0) AS gate_norm_sum FROM (SELECT DISTINCT layer FROM f) a JOIN (SELECT DISTINCT expert FROM f) b ON true LEFT JOIN s USING (layer, expert)),
k AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY gate_norm_sum DESC, expert)::INT AS rank FROM z)"""


def router(spark, root):
    return read_table(spark, root, "lineitem").select(F.col("l_linenumber").alias("layer"), F.pmod("l_suppkey", F.lit(16)).alias("expert"), (F.col("l_discount") + 0.01).alias("gate"), F.col("l_quantity").alias("norm"), F.col("l_orderkey").alias("token"))


@query(f"WITH {SAL} SELECT layer, expert, count, round(gate_sum, 4) AS gate_sum, round(gate_norm_sum, 4) AS gate_norm_sum, round(gate_norm_sum / greatest(1, count), 6) AS gate_norm_mean FROM k")
def expert_saliency(spark, root):
    """Saliency sums of each expert."""
    s = E.saliency(router(spark, root))
    return s.select("layer", "expert", "count", F.round("gate_sum", 4).alias("gate_sum"), F.round("gate_norm_sum", 4).alias("gate_norm_sum"), r6("gate_norm_mean").alias("gate_norm_mean"))


@query(f"WITH {ROUTER}, g AS (SELECT layer, expert, gate * norm AS x, (token % 5 - 2) / 2.0 AS w FROM f) SELECT layer, expert, round(sum(w * x), 4) AS weighted_sum, round(sum(greatest(w, 0) * x), 4) AS positive_sum, round(sum(greatest(-w, 0) * x), 4) AS negative_sum, count(*) FILTER (WHERE w > 0) AS positive_count, count(*) FILTER (WHERE w < 0) AS negative_count FROM g GROUP BY 1, 2")
def signed_saliency(spark, root):
    """Saliency weighted by token, by the weight's sign."""
    w = E.weighted_saliency(router(spark, root).withColumn("weight", (F.pmod("token", F.lit(5)) - 2) / 2.0))
    return w.select("layer", "expert", *[F.round(c, 4).alias(c) for c in ("weighted_sum", "positive_sum", "negative_sum")], "positive_count", "negative_count")


USED = f"{ROUTER}, u AS (SELECT token % 7 AS layer, token, gate AS p, row_number() OVER (PARTITION BY token % 7, token ORDER BY gate DESC) AS r FROM f)"


@query(f"WITH {USED} SELECT layer, count(DISTINCT token) AS tokens, count(*) AS selections, round(avg(p), 6) AS prob_mean, round(avg(p) FILTER (WHERE r = 1), 6) AS top1_mean, round(avg(p) FILTER (WHERE r = 2), 6) AS top2_mean FROM u GROUP BY 1")
def expert_usage(spark, root):
    """How sure the router is."""
    means, _ = E.usage(router(spark, root).withColumn("layer", F.pmod("token", F.lit(7))), "token", "gate")
    return means.select("layer", "tokens", "selections", *[r6(c).alias(c) for c in ("prob_mean", "top1_mean", "top2_mean")])


@query(f"WITH {ROUTER}, d AS (SELECT token % 2 AS d, layer, expert, sum(gate * norm) AS m FROM f WHERE token % 2 = 0 OR expert < 9 GROUP BY ALL) SELECT layer, expert, round(sum(CASE d WHEN 0 THEN 0.25 ELSE 2.0 END * m), 4) AS mass FROM d GROUP BY 1, 2")
def domain_mass_union(spark, root):
    """Masses of two domains, one of which lacks some experts."""
    f = router(spark, root).where("token % 2 = 0 or expert < 9")
    part = lambda d: E.saliency(f.where(F.pmod("token", F.lit(2)) == d)).where("count > 0")
    return E.domain_mass({"a": (part(0), 0.25), "b": (part(1), 2.0)}).select("layer", "expert", F.round("mass", 4).alias("mass"))


@query(f"WITH {SAL} SELECT layer, expert, rank FROM k")
def expert_ranking(spark, root):
    """Experts by mass."""
    return E.ranking(E.saliency(router(spark, root))).select("layer", "expert", "rank")


@query(f"WITH {SAL} SELECT layer, round(sum(gate_norm_sum) FILTER (WHERE rank <= 4) / sum(gate_norm_sum), 6) AS top4, round(sum(gate_norm_sum) FILTER (WHERE rank <= 8) / sum(gate_norm_sum), 6) AS top8 FROM k GROUP BY 1")
def concentration(spark, root):
    """How much the first experts hold."""
    return E.concentration(E.ranking(E.saliency(router(spark, root))), tops=(4, 8)).select("layer", r6("top4").alias("top4"), r6("top8").alias("top8"))


@query(f"WITH {SAL}, c AS (SELECT *, coalesce(sum(gate_norm_sum) OVER (PARTITION BY layer ORDER BY gate_norm_sum DESC, expert ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(gate_norm_sum) OVER (PARTITION BY layer) AS t FROM z) SELECT layer, expert FROM c WHERE b < 0.8 * t")
def coverage_set(spark, root):
    """The fewest experts that hold four fifths."""
    return E.coverage(E.saliency(router(spark, root)), 0.8).select("layer", "expert")


@query(f"""WITH {ROUTER}, s AS (SELECT 'd' || token % 2 AS domain, layer, expert, sum(gate * norm) AS g FROM f GROUP BY ALL), c AS (SELECT *, coalesce(sum(g) OVER (PARTITION BY layer, domain ORDER BY g DESC, expert ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(g) OVER (PARTITION BY layer, domain) AS t FROM s),
k AS (SELECT layer, expert, row_number() OVER (PARTITION BY layer ORDER BY sum(g) DESC, expert) AS r FROM s GROUP BY layer, expert)
SELECT layer, expert FROM c WHERE t > 0 AND b < 0.6 * t UNION SELECT layer, expert FROM k WHERE r <= 4""")
def union_keep_sets(spark, root):
    """Coverage sets of two domains together, with a core."""
    f = router(spark, root).withColumn("domain", F.concat(F.lit("d"), F.pmod("token", F.lit(2))))
    s = f.groupBy("domain", "layer", "expert").agg(F.sum(F.col("gate") * F.col("norm")).alias("gate_norm_sum"))
    return E.union_keep(s, 0.6, 4)


@query(f"WITH {SAL}, r AS (SELECT layer, expert, rank AS a, row_number() OVER (PARTITION BY layer ORDER BY count DESC, expert) AS b FROM k) SELECT layer, expert FROM r QUALIFY row_number() OVER (PARTITION BY layer ORDER BY (a > 3 AND b > 3)::INT, a) <= 8")
def core_fill(spark, root):
    """Eight experts a layer, the core first."""
    return E.core_and_fill(E.saliency(router(spark, root)), 8, 3)


@query(f"WITH {ROUTER}, d AS (SELECT DISTINCT token % 7 AS layer, token, expert FROM f) SELECT a.layer, a.expert AS expert_i, b.expert AS expert_j, count(*) AS n FROM d a JOIN d b ON a.token = b.token AND a.layer = b.layer AND a.expert < b.expert GROUP BY ALL")
def coactivation_pairs(spark, root):
    """Experts that serve the same token."""
    return E.coactivation(router(spark, root).withColumn("layer", F.pmod("token", F.lit(7))), "token")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, (l_returnflag = CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END)::INT AS same, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) AS i FROM lineitem),
o AS (SELECT l_orderkey, coalesce(min(i) FILTER (WHERE same = 0), max(i) + 1) - 1 AS accepted FROM l GROUP BY 1) SELECT accepted::INT AS accepted, count(*) AS orders FROM o GROUP BY 1""")
def accept_length(spark, root):
    """Matching beginnings of two sequences."""
    o = read_table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("a"))
    n = S.accepted_prefix(F.col("a.l_returnflag"), F.transform("a.l_linestatus", lambda x: F.when(x == "O", "N").otherwise("R")))
    return o.groupBy(n.alias("accepted")).agg(F.count(F.lit(1)).alias("orders"))


@query("""WITH o AS (SELECT o_orderstatus AS s, o_custkey % 9 AS a FROM orders) SELECT s, count(*) AS n, round(avg(a), 6) AS mean, round(quantile_cont(a, 0.5), 6) AS p50, round(quantile_cont(a, 0.9), 6) AS p90, round(quantile_cont(a, 0.99), 6) AS p99, round(sum(a) / (count(*) * 8), 6)::DOUBLE AS rate FROM o GROUP BY 1""")
def accept_summary(spark, root):
    """Accepted lengths (made from customer keys) by status."""
    o = read_table(spark, root, "orders").select(F.col("o_orderstatus").alias("s"), F.pmod("o_custkey", F.lit(9)).alias("a"))
    return S.accept_summary(o, "a", 8, "s").select("s", "n", *[r6(c).alias(c) for c in ("mean", "p50", "p90", "p99", "rate")])


# ---- profiles, labels, time

@query("""WITH n AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, min(v) AS least, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, max(v) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)) AS p95, max(v) AS most FROM n GROUP BY 1""")
def numeric_profile(spark, root):
    """Summary of the events' values."""
    p = P.numeric_summary(read_table(spark, root, "events"), "value", "event_type")
    return p.select("event_type", "n", "least", r6("mean").alias("mean"), r6("median").alias("median"), "p95", "most")


@query("""WITH k AS (SELECT props, unnest(json_keys(props)) AS field FROM events) SELECT field, 'BIGINT' AS type, count(*) AS n FROM k WHERE json_type(props, '$.' || field) IN ('UBIGINT', 'BIGINT') GROUP BY 1""")
def json_field_types(spark, root):
    """Fields of the events' properties by type."""
    return P.json_fields(read_table(spark, root, "events"), "props")


@query("""WITH j AS (SELECT CASE WHEN json_valid(text) AND json_type(text) = 'ARRAY' THEN text::JSON END AS j FROM documents), m AS (SELECT unnest(json_extract(j, '$[*]')) AS m FROM j WHERE j IS NOT NULL), k AS (SELECT m, unnest(json_keys(m)) AS field FROM m WHERE json_type(m) = 'OBJECT')
SELECT json_extract_string(m, '$.role') AS role, field, CASE json_type(m, '$.' || field) WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(m, '$.' || field) END AS type, count(*) AS n FROM k GROUP BY ALL""")
def message_fields(spark, root):
    """Fields of messages in lists of JSON, by role and type."""
    return P.message_fields(read_table(spark, root, "documents"), "text")


@query("""WITH b AS (SELECT doc_id, CASE WHEN n_chars IS NULL THEN NULL ELSE n_chars * doc_id END AS n FROM documents)
SELECT doc_id, CASE WHEN coalesce(n, 0) = 0 THEN 'n/a' WHEN n < 1024 THEN format('{:.2f} B', n::DOUBLE) WHEN n < 1048576 THEN format('{:.2f} KB', n / 1024.0) WHEN n < 1073741824 THEN format('{:.2f} MB', n / 1048576.0) ELSE format('{:.2f} GB', n / 1073741824.0) END AS size FROM b""")
def readable_sizes(spark, root):
    """Sizes as people read them."""
    return read_table(spark, root, "documents").select("doc_id", X.human_bytes(F.col("n_chars") * F.col("doc_id")).alias("size"))

@query("""SELECT f AS field, count(v) AS present, count(*) FILTER (WHERE v IS NULL) AS missing, min(length(v))::BIGINT AS least_length, round(avg(length(v)), 6) AS mean_length, max(length(v))::BIGINT AS most_length
FROM (SELECT 'text' AS f, text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY 1""")
def field_profile(spark, root):
    """Presence and lengths of the documents' fields."""
    p = P.field_profile(read_table(spark, root, "documents"), "text", "lang", "source")
    return p.select("field", "present", "missing", F.col("least_length").cast("long").alias("least_length"), r6("mean_length").alias("mean_length"), F.col("most_length").cast("long").alias("most_length"))


@query(f"WITH {MSG} SELECT role, coalesce(channel, '') AS channel, count(*) AS n, sum(length(c))::BIGINT AS chars FROM m GROUP BY 1, 2")
def message_profile(spark, root):
    """Messages by role and channel."""
    return P.message_profile(norm(spark, root), "text")


@query("SELECT count(*) AS rows, sum(strlen(text) + 1)::BIGINT AS bytes, round(avg(strlen(text) + 1), 6) AS mean_bytes FROM documents WHERE text IS NOT NULL")
def row_estimate(spark, root):
    """Bytes of the documents as lines."""
    return P.row_estimate(read_table(spark, root, "documents"), "text").select("rows", "bytes", r6("mean_bytes").alias("mean_bytes"))


@query("SELECT 'source' AS column, least(count(DISTINCT source), 500000) AS n FROM documents UNION ALL SELECT 'text', least(count(DISTINCT text), 500000) FROM documents")
def distinct_signatures(spark, root):
    """Distinct texts and sources."""
    return P.distinct_counts(read_table(spark, root, "documents"), "source", "text", cap=500_000)


@query("SELECT dataset, split, count(*) AS n FROM normalized GROUP BY 1, 2")
def dataset_counts(spark, root):
    """Rows of each dataset and split."""
    return read_table(spark, root, "normalized").groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT l_orderkey, max(l_tax) AS best FROM lineitem GROUP BY 1) SELECT l.l_orderkey, max(best) AS accuracy, arg_min('s' || l_linenumber, l_linenumber) AS setting FROM lineitem l JOIN o ON l.l_orderkey = o.l_orderkey AND l.l_tax = o.best GROUP BY 1""")
def best_eval_setting(spark, root):
    """The best line of each order, the first of equals."""
    from curatrix.operators.normalize import best_setting

    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("s"), "l_linenumber").alias("setting"), F.col("l_tax").alias("accuracy"))))
    o = read_table(spark, root, "lineitem").groupBy("l_orderkey").agg(rows.alias("m"))
    b = best_setting("m")
    return o.select("l_orderkey", b["meta_correctness"].alias("accuracy"), b["meta_eval_best_setting"].alias("setting"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_event_pool(spark, root):
    """Events by hour (the batch form of the stream)."""
    from curatrix.streaming.ingest import hourly

    return hourly(read_table(spark, root, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


NT = "nt AS (SELECT sha1(text) AS id, text, TIMESTAMP '2000-01-01 00:00:00' AS ingested_at, dataset, split FROM normalized WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY dataset NULLS FIRST, split NULLS FIRST) = 1)"
TYPES = {"string": "VARCHAR", "boolean": "BOOLEAN", "bigint": "BIGINT", "double": "DOUBLE", "array<string>": "VARCHAR[]"}


def normalised_columns(given: dict[str, str]) -> str:
    """The columns of the schema, nulls for those that aren't given."""
    return ", ".join(f"{given.get(f.name, 'NULL')}::{TYPES[f.dataType.simpleString()]} AS {f.name}" for f in NORMALIZED)


@query(rf"""WITH {NT}, {MSG.replace('FROM normalized WHERE', 'FROM nt WHERE')}, {WHOLE.replace('FROM normalized WHERE', 'FROM nt WHERE')},
g AS (SELECT id, bool_or(role NOT IN ('system','developer','user','assistant') AND NOT starts_with(role, 'assistant')) AS tool, arg_max(c, pos) FILTER (WHERE (role = 'assistant' OR starts_with(role, 'assistant ')) AND (channel IS NULL OR channel = 'final')) AS fin,
  bool_and(NOT ({OUTPUT}) OR {STRIP.format('c')} = '' OR NOT regexp_matches({STRIP.format('c')}, '^[\[' || chr(123) || ']') OR json_valid(c)) AS fine FROM m GROUP BY 1)
SELECT {normalised_columns({'id': 'v.id', 'dataset': 'nt.dataset', 'split': 'nt.split', 'text': 'v.text', 'loss_mode': "'assistant_all'", 'quality_valid_harmony': 'ok', 'quality_completion_nonempty': f"(ok AND length({STRIP.format("coalesce(fin, '')")}) >= 32)",
  'quality_has_tool': "(ok AND (contains(v.text, '<|call|>') OR coalesce(tool, false)))", 'quality_valid_tool_schema': '(ok AND coalesce(fine, true))', 'stats_char_len': 'length(v.text)',
  'meta_domain': "(CASE WHEN contains(lower(dataset), 'proof') THEN 'proof' WHEN contains(lower(dataset), 'agentic') THEN 'agentic' WHEN contains(lower(dataset), 'science') THEN 'science' WHEN contains(lower(dataset), 'instruction') THEN 'chat_if' ELSE 'math' END)",
  'meta_difficulty_bin': "(CASE WHEN starts_with(lower(split), 'low') THEN 'low' WHEN starts_with(lower(split), 'medium') THEN 'medium' WHEN starts_with(lower(split), 'high') THEN 'high' END)"})}
FROM v JOIN nt ON nt.id = v.id LEFT JOIN g ON g.id = v.id""")
def normalize_texts(spark, root):
    """Texts brought to the normalised schema."""
    from curatrix.operators.normalize import normalize

    return normalize(read_table(spark, root, "normalized").select("text", "dataset", "split"), "dataset", "split")


@query("SELECT sha1(props) AS tools_id, props AS tools FROM (SELECT DISTINCT replace(props, ' ', '') AS props FROM events)")
def tool_catalog(spark, root):
    """Distinct property objects by the hash of their canonical form."""
    from curatrix.sources.writers import tools_catalogue

    return tools_catalogue(read_table(spark, root, "events"), "props")
