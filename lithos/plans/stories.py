"""Queries over story keys, scripts, the graph, prompts and the hybrid search, registered with the catalogue, and their oracles.

`documents` has no story fields, so these are bound to its columns, or made from them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.functions import stories as S
from lithos.functions import text as X
from lithos.operators import evidence, graph, retrieval, scripts
from lithos.plans.catalogue import THREE, _asked, _edges, _list, _strip, _three, graph_sql, lists_sql, near_sql, query, read

PATH = "concat(CASE doc_id % 4 WHEN 0 THEN '[UC]info/' WHEN 1 THEN './' ELSE '' END, CASE doc_id % 3 WHEN 0 THEN 'Activities/' WHEN 1 THEN 'obt/roguelike/' ELSE '' END, coalesce(lang, 'x'), '/level_A', doc_id, CASE doc_id % 5 WHEN 0 THEN '_beg' WHEN 1 THEN '_end' ELSE '' END, '.txt')"


@query(f"""WITH x AS (SELECT doc_id, {PATH} AS p FROM documents), k AS (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(p, '\\.txt$', ''), '^\\./', ''), '^\\[UC\\]info/', '')) AS key FROM x),
s AS (SELECT *, string_split(key, '/') AS q FROM k)
SELECT doc_id, key AS story_key, regexp_replace(substr(q[-1], 7), '_(beg|end)$', '') AS stage_id, CASE WHEN len(q) > 1 AND q[1] = 'activities' THEN q[2] WHEN len(q) > 2 AND q[1] = 'obt' AND q[2] = 'roguelike' THEN q[3] WHEN len(q) > 1 THEN q[1] END AS activity FROM s""")
def story_keys(spark, d):
    key = S.story_key(F.expr(PATH))
    return read(spark, d, "documents").select("doc_id", key.alias("story_key"), S.stage_id(S.stage_of_key(key)).alias("stage_id"), S.activity_hint(key).alias("activity"))


@query("""WITH x AS (SELECT doc_id, doc_id % 120 AS a, doc_id % 10 AS b FROM documents), n AS (SELECT doc_id, list_filter([CASE WHEN a BETWEEN 1 AND 99 THEN a END, CASE WHEN b > 0 THEN b END, 13], lambda v: v IS NOT NULL) AS v FROM x),
u AS (SELECT doc_id, list_filter(v, lambda q, i: list_position(v, q) = i) AS v FROM n)
SELECT doc_id, array_to_string(list_transform(v, lambda q: concat('第', q, '章,', q, '章,main_', lpad(q::VARCHAR, 2, '0'), ',level_main_', lpad(q::VARCHAR, 2, '0'), CASE WHEN q < 10 THEN concat(',main_', q, ',level_main_', q) ELSE '' END, ',EPISODE ', q)), ';') AS terms FROM u""")
def chapter_terms(spark, d):
    text = F.concat(F.lit("见第 "), (F.col("doc_id") % 120).cast("string"), F.lit(" 章与MAIN_0"), (F.col("doc_id") % 10).cast("string"), F.lit("，第十三章"))
    # the names of one chapter; of two digits, some are the same
    names = F.transform(S.chapter_numbers(text), lambda n: F.array_join(S.chapter_terms(F.concat(F.lit("第"), n.cast("string"), F.lit("章"))), ","))
    return read(spark, d, "documents").select("doc_id", F.array_join(names, ";").alias("terms"))


SCRIPT = "CASE turn % 7 WHEN 0 THEN concat('[HEADER(k=1)] part ', conv_id) WHEN 1 THEN concat('[name=\"', role, '\"] ', text) WHEN 2 THEN '' WHEN 3 THEN '[Dialog(dialogHead=\"$avatar_x\")]' WHEN 4 THEN text WHEN 5 THEN text ELSE concat('[Sub(dialogHead=\"y\")] ', text) END"


@query(rf"""WITH l AS (SELECT conv_id AS story, turn AS place, {_strip("regexp_replace(" + SCRIPT + ", chr(10), ' ', 'g')")} AS x, turn % 7 AS f FROM conversations),
k AS (SELECT *, CASE WHEN x = '' THEN 'blank' WHEN x LIKE '[HEADER%' THEN 'header' WHEN x LIKE '[name=%' THEN 'spoken' WHEN x LIKE '[%' THEN 'command' ELSE 'plain' END AS form FROM l),
a AS (SELECT *, CASE WHEN form = 'command' AND f = 6 THEN 'y' WHEN form = 'command' THEN 'X' END AS head, CASE WHEN form = 'command' THEN {_strip("regexp_replace(x, '^.*\\]', '')")} END AS after FROM k),
w AS (SELECT *, max(CASE WHEN form IN ('command', 'plain') THEN place END) OVER (PARTITION BY story ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spot, sum(CASE WHEN form <> 'plain' OR lag_form IS DISTINCT FROM 'plain' THEN 1 ELSE 0 END) OVER (PARTITION BY story ORDER BY place) AS block FROM (SELECT *, lag(form) OVER (PARTITION BY story ORDER BY place) AS lag_form FROM a)),
v AS (SELECT w.*, CASE WHEN b.form = 'command' AND b.after = '' THEN b.head END AS who FROM w LEFT JOIN a b ON b.story = w.story AND b.place = w.spot),
g AS (SELECT story, block, min(form) AS form, arg_min(x, place) AS x, arg_min(coalesce(after, ''), place) AS after, arg_min(coalesce(head, ''), place) AS head, arg_min(coalesce(who, ''), place) AS who, string_agg(x, ' ' ORDER BY place) AS plain FROM v WHERE form <> 'blank' GROUP BY story, block),
s AS (SELECT story, block, CASE form WHEN 'spoken' THEN regexp_extract(x, '^\[name="([^"]+)"\]', 1) WHEN 'command' THEN nullif(head, '') WHEN 'plain' THEN nullif(who, '') END AS speaker,
{_strip("regexp_replace(regexp_replace(CASE form WHEN 'header' THEN regexp_replace(x, '^\\[HEADER.*\\]\\s*', '') WHEN 'spoken' THEN regexp_replace(x, '^\\[name=.[^\"]+.\\]\\s*', '') WHEN 'command' THEN after ELSE plain END, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')")} AS text, form FROM g),
t AS (SELECT *, CASE WHEN form = 'header' THEN 'header' WHEN form = 'spoken' OR speaker IS NOT NULL THEN 'dialogue' ELSE 'narration' END AS kind FROM s WHERE text <> ''),
n AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND p = kind AND q IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END) OVER (PARTITION BY story ORDER BY block) - 1 AS segment FROM (SELECT *, lag(kind) OVER (PARTITION BY story ORDER BY block) AS p, lag(speaker) OVER (PARTITION BY story ORDER BY block) AS q FROM t))
SELECT story, segment::BIGINT AS segment, speaker, kind, string_agg(text, chr(10) ORDER BY block) AS text FROM n GROUP BY story, segment, speaker, kind""")
def script_parse(spark, d):
    lines = read(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.expr(SCRIPT.replace('"', '\\"')), "\n", " ").alias("line"))
    return scripts.parse(lines, "conv_id", "turn", "line", {"avatar_x": "X"})


NAMES = {"the": "A", "and": "B", "hand": "A", "an": "C", "tion": "D", "Apache": "E"}


@query(f"""WITH n AS (SELECT unnest(['{"', '".join(NAMES)}']) AS name, unnest(['{"', '".join(NAMES.values())}']) AS canonical), h AS (SELECT doc_id, canonical, instr(text, name) + length(name) AS e, -length(name) AS l FROM documents, n WHERE contains(text, name)),
f AS (SELECT doc_id, canonical, min((e, l)) AS met FROM h GROUP BY ALL) SELECT d.doc_id, coalesce(string_agg(canonical, ',' ORDER BY met), '') AS entities FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def alias_entities(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(graph.alias_entities(F.col("text"), NAMES), ",").alias("entities"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(coalesce(lang, '')) <> '' THEN 'activity:' || trim(lang) END, CASE WHEN trim(coalesce(source, '')) <> '' THEN 'story:' || trim(source) END, 'stage:' || doc_id % 7], lambda e: e IS NOT NULL), ',') AS entities,
CASE WHEN coalesce(lang, '') NOT IN ('', 'en') THEN 'activity:' || lang WHEN doc_id % 3 = 0 THEN 'activity:act' || doc_id % 5 WHEN doc_id % 3 = 1 THEN 'activity:main_' || doc_id % 9 ELSE 'activity:main_zone' END AS scope FROM documents""")
def passage_scope(spark, d):
    story = F.expr("case doc_id % 3 when 0 then concat('x/activities/act', doc_id % 5, '/s') when 1 then concat('obt/level_main_0', doc_id % 9, '-1') else 'none' end")
    entities = graph.metadata_entities(F.col("lang"), F.col("source"), (F.col("doc_id") % 7).cast("string"), F.lit(None).cast("string"))
    return read(spark, d, "documents").select("doc_id", F.array_join(entities, ",").alias("entities"), graph.scope_key(F.col("lang"), story, F.lit("main_zone"), ["en"]).alias("scope"))


@query(f"{graph_sql()}, dir AS (SELECT doc_id, sum(least(weight, 4)::DOUBLE / place) AS s FROM (SELECT e.*, row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS place FROM edges e JOIN asked USING (entity)) GROUP BY doc_id), both_ AS (SELECT doc_id, s FROM dir UNION ALL SELECT doc_id, s FROM walk), t AS (SELECT doc_id, round(sum(s), 6) AS score FROM both_ GROUP BY doc_id) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM t QUALIFY rank < 40")
def graph_search(spark, d):
    return graph.graph_search(_edges(spark, d), _asked(spark).withColumn("pos", F.monotonically_increasing_id()), 40)


def rules_sql(seeds: str, k: int) -> str:
    """After CTEs that define `seeds`(doc, rank)."""
    return f"""{seeds}, k AS (SELECT doc_id AS doc, source AS story, lang AS activity, concat('s', doc_id % 7) AS stage, doc_id // 50 AS sort, CASE WHEN coalesce(source, '') <> '' THEN row_number() OVER (PARTITION BY source ORDER BY doc_id) END AS place FROM documents),
s AS (SELECT seeds.rank AS seed, k.* FROM seeds JOIN k USING (doc) WHERE seeds.rank < 24),
met AS (SELECT k.doc, (seed, 0, k.place - s.place, 0) AS m FROM k JOIN s ON k.story = s.story AND k.story <> '' AND abs(k.place - s.place) <= 2
UNION ALL SELECT doc, (seed, 1, abs(g), g) FROM (SELECT k.doc, seed, k.place - s.place AS g, row_number() OVER (PARTITION BY seed ORDER BY abs(k.place - s.place), k.place - s.place) AS n FROM k JOIN s ON k.story = s.story AND k.story <> '' WHERE seed < 8) WHERE n <= 24
UNION ALL SELECT k.doc, (seed, 2, k.doc, 0) FROM k JOIN s ON k.activity = s.activity AND k.stage = s.stage AND k.activity <> ''
UNION ALL SELECT k.doc, (seed, 3, k.sort, k.doc) FROM k JOIN s ON k.activity = s.activity AND abs(k.sort - s.sort) <= 1 AND k.activity <> ''),
u AS (SELECT doc, 0 AS part, rank AS spot, NULL AS m, CAST(NULL AS VARCHAR) AS source FROM seeds UNION ALL SELECT doc, 1, NULL, min(m), 'neighbor' FROM met WHERE doc NOT IN (SELECT doc FROM seeds) GROUP BY doc)
SELECT doc, source, row_number() OVER (ORDER BY part, spot, m, doc) - 1 AS rank FROM u QUALIFY rank < {k}"""


def _passages(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("story"), F.col("lang").alias("activity"), F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")).alias("stage"), F.floor(F.col("doc_id") / 50).alias("sort"))


@query(rules_sql(f"WITH {lists_sql(20)}, seeds AS (SELECT doc_id AS doc, rank FROM long_)", 150))
def neighbor_rules(spark, d):
    seeds = _list(spark, d, "n_chars", 20).select(F.col("doc_id").alias("doc"), "rank")
    return retrieval.expand_by_rules(seeds, _passages(spark, d), 150, sweep=True)


FUSED = f"""WITH {lists_sql()}, fu AS (SELECT doc_id, 1.0::DOUBLE / (60 + rank + 1) AS w FROM long_ UNION ALL SELECT doc_id, 0.8::DOUBLE / (60 + rank + 1) FROM early UNION ALL SELECT doc_id, 0.35::DOUBLE / (60 + rank + 1) FROM short),
seeds AS (SELECT doc_id AS doc, row_number() OVER (ORDER BY round(sum(w), 9) DESC, doc_id) - 1 AS rank FROM fu GROUP BY doc_id QUALIFY rank < 80)"""


@query(rules_sql(FUSED, 80))
def search_hybrid(spark, d):
    lists = [_list(spark, d, by).select("doc_id", "score", "rank") for by in ("n_chars", "-doc_id", "-n_chars")]
    weights = {"dense": 1.0, "sparse": 0.8, "graph": retrieval.graph_weight("fact", 0.35)}
    return retrieval.search_pre_rerank(*lists, _passages(spark, d), 80, 32, weights, sweep=True).withColumn("source", F.when(F.col("source") == "neighbor", F.col("source")))


@query(f"WITH {lists_sql()}, {THREE}, f AS (SELECT doc_id, min((list, rank)) AS met FROM three GROUP BY doc_id) SELECT doc_id, row_number() OVER (ORDER BY met, doc_id) - 1 AS rank FROM f QUALIFY rank < 100")
def merge_keep_order(spark, d):
    return retrieval.keep_order(_three(spark, d), 100)


@query(f"WITH {lists_sql()}, {THREE} SELECT doc_id, max(score) AS score FROM three GROUP BY doc_id")
def merge_max(spark, d):
    return retrieval.max_merge(_three(spark, d), ["score"])


@query("""WITH x AS (SELECT doc_id, [trim(coalesce(source, '')), trim(coalesce(lang, '')), trim(coalesce(source, ''))] AS p FROM documents), y AS (SELECT doc_id, list_filter(p, lambda v, i: v <> '' AND list_position(p, v) = i) AS p FROM x)
SELECT doc_id, array_to_string(p, chr(10)) AS text, CASE WHEN doc_id % 2 = 0 THEN 'doc:' || doc_id ELSE 'idx:' || doc_id END AS identity FROM y""")
def evidence_texts(spark, d):
    marked = F.concat(F.lit("[E1] "), "source", F.lit(" [EVIDENCE_TYPES=a,b]"))
    own = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(" ")
    return read(spark, d, "documents").select("doc_id", evidence.evidence_text(marked, F.col("lang"), F.col("source")).alias("text"), evidence.identity(own, F.col("doc_id"), F.col("text")).alias("identity"))


def _items(spark, d):
    top = _list(spark, d, "n_chars", 40).select("doc_id", "rank").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return top.select(F.lit(0).alias("query"), F.col("doc_id").alias("id"), F.col("rank").cast("long").alias("pos"), X.similarity_tokens(F.col("text")).alias("tokens"), (F.col("doc_id") % 5).cast("double").alias("score"))


@query(f"{near_sql()}, c AS (SELECT doc_id, n, doc_id % 5 AS score FROM kept_docs) SELECT doc_id AS id, score::DOUBLE AS score, row_number() OVER (ORDER BY score DESC, n) - 1 AS rank FROM c QUALIFY rank < 12")
def prompt_top(spark, d):
    return evidence.prompt_top_k(_items(spark, d), "query", 12).select("id", "score", "rank")


@query("""WITH x AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents QUALIFY rank < 3) SELECT source, doc_id, rank, substr(""" + _strip("regexp_replace(text, '\\s+', ' ', 'g')") + """, 1, 80) AS snippet FROM x""")
def trace_top(spark, d):
    top = retrieval.ranked(read(spark, d, "documents").select("source", "doc_id", "text", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], ["source"], 5)
    return evidence.trace_summary(top, "source", "rank", "text").select("source", "doc_id", "rank", "snippet")


@query(r"""WITH x AS (SELECT item_id, (item_id % 8)::INT AS n, trim(substr(text, 1, 60), ' ' || chr(10)) AS a, trim(substr(text, 11, 90), ' ' || chr(10)) AS b, regexp_replace(text, '\s+', '', 'g') AS pool FROM benchmark),
y AS (SELECT *, length(a) + length(b) + 9 AS total FROM x),
f AS (SELECT item_id, n, total, list_transform(range(1, n + 1), lambda i: list_filter(['supported_fact_' || i || '_too_many_quotes:3>2', CASE WHEN length(b) > 80 THEN 'supported_fact_' || i || '_ref_2_quote_over_80' END, 'supported_fact_' || i || '_ref_3_quote_not_found', CASE WHEN total > 160 THEN 'supported_fact_' || i || '_quote_total_over_160' END], lambda s: s IS NOT NULL)) AS own FROM y)
SELECT item_id, CASE WHEN n = 0 THEN 'missing_supported_facts' ELSE array_to_string(list_filter(flatten([[CASE WHEN n > 6 THEN 'too_many_supported_facts:' || n || '>6' END], flatten(own), [CASE WHEN total * n > 400 THEN 'answer_quote_total_over_400:' || total * n END]]), lambda s: s IS NOT NULL), '|') END AS issues FROM f""")
def quote_check(spark, d):
    text = F.col("text")
    quotes = F.array(F.substring(text, 1, 60), F.substring(text, 11, 90), F.lit("not there"))
    facts = F.array_repeat(F.struct(F.lit("a fact").alias("fact"), quotes.alias("quotes")), (F.col("item_id") % 8).cast("int"))
    return read(spark, d, "benchmark").select("item_id", F.array_join(evidence.quote_issues(facts, text), "|").alias("issues"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 1) THEN text WHEN turn % 4 = 2 THEN role WHEN turn >= 6 THEN coalesce(nullif(text, ''), '现有检索证据不足以确认。') END AS answer FROM conversations""")
def terminal_answer(spark, d):
    action = F.expr("case turn % 4 when 0 then 'answer_directly' when 1 then 'abstain' when 2 then 'clarify_user' else 'retrieve_more' end")
    return read(spark, d, "conversations").select("conv_id", "turn", evidence.final_answer(action, F.col("text"), F.col("role"), F.col("turn"), 6).alias("answer"))


@query(f"""WITH x AS (SELECT conv_id, turn, role, unnest(string_split(concat(role, CASE WHEN turn % 2 = 0 THEN ' :' ELSE ': ' END, text), chr(10))) AS line FROM conversations), y AS (SELECT conv_id, turn, {_strip("line")} AS line FROM x),
z AS (SELECT conv_id, turn, lower(regexp_extract(line, '(?i)^(user|assistant)\\s*:', 1)) AS role, {_strip("regexp_replace(line, '(?i)^(user|assistant)\\s*:', '')")} AS content FROM y)
SELECT conv_id, turn, count(*) FILTER (WHERE role <> '') AS spoken, count(*) AS entries, sum(length(content))::BIGINT AS chars FROM z WHERE content <> '' GROUP BY conv_id, turn""")
def dialogue_parse(spark, d):
    said = F.concat("role", F.when(F.col("turn") % 2 == 0, " :").otherwise(": "), "text")
    e = S.dialogue_entries(said)
    out = read(spark, d, "conversations").select("conv_id", "turn", e.alias("e")).where("size(e) > 0")
    chars = F.aggregate("e", F.lit(0), lambda a, x: a + F.length(x["content"]))
    return out.select("conv_id", "turn", F.size(F.filter("e", lambda x: x["role"].isNotNull())).cast("long").alias("spoken"), F.size("e").cast("long").alias("entries"), chars.cast("long").alias("chars"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || '：' || t WHEN 1 THEN 'a' || chr(10) || 'b "c' ELSE t END AS clean FROM (SELECT *, """ + _strip("regexp_replace(regexp_replace(text, chr(10), ' ', 'g'), '\\[[^\\]]+\\]', '', 'g')") + """ AS t FROM conversations)""")
def script_clean(spark, d):
    flat = F.regexp_replace("text", "\n", " ")
    said = F.regexp_replace(flat, r"^\s+|\s+$", "")
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('[name="'), "role", F.lit('"]'), said)).when(F.col("turn") % 3 == 1, F.lit('[Sticker(text="a\\nb \\"c")]')).otherwise(F.concat(F.lit("[Delay(t=1)]\n"), flat))
    return read(spark, d, "conversations").select("conv_id", "turn", S.script_context(line).alias("clean"))


@query("""SELECT doc_id, coalesce(lang, '') || 'abc' AS anchor, length(coalesce(lang, 'x') || 'ab') BETWEEN 2 AND 16 AND doc_id % 3 = 0 AND coalesce(lang, 'x') <> 'de' AS generic, CASE WHEN coalesce(source, '') NOT IN ('', 'src1') THEN source ELSE coalesce(lang, '') END AS story, 'and x和y said' AS resolved FROM documents""")
def term_scalars(spark, d):
    lang = F.coalesce("lang", F.lit(""))
    token = F.concat(F.coalesce("lang", F.lit("x")), F.lit("ab"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("吗"))
    resolved = S.resolve_pronoun(F.lit(" and 他们 said "), F.array(F.lit("x"), F.lit("y"), F.lit("z")), ["他", "他们"])
    return read(spark, d, "documents").select("doc_id", S.anchor_term(F.concat(F.lit("《 "), lang, F.lit(" abc》为什么会"))).alias("anchor"), S.generic_entity(token, ["deab"]).alias("generic"), S.story_name(F.col("source"), F.col("lang"), ["src1"]).alias("story"), resolved.alias("resolved"))
