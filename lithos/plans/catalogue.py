"""The driver's queries of the retrieval engine, and an oracle in SQL for each that SQL can express.

Each runs over its whole tables; limits stand only where the operator is a top-k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.functions import text as X
from lithos.operators import answers, chains, corpus, evidence, graph, retrieval, support

FLAGSHIP = "bm25_topk"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERY_TEXT = "the thing and licensed apache version"
TERMS = "', '".join(QUERY_TEXT.split())


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS n_distinct FROM documents")
def tok_bm25(spark, d):
    t = X.bm25_tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


POSTINGS = """tok AS (SELECT doc_id, source, lang, regexp_extract_all(lower(text), '[a-z0-9_]+') AS tokens FROM documents),
word AS (SELECT doc_id, source, lang, len(tokens) AS dl, unnest(tokens) AS term FROM tok),
post AS (SELECT doc_id, source, lang, dl, term, count(*) AS tf FROM word GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raws AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM dfs),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws),
avgs AS (SELECT avg(len(tokens)) AS avgdl FROM tok)"""


def bm25_sql(where: str = "TRUE", terms: str = f"SELECT 0 AS query_id, unnest(['{TERMS}']) AS term") -> str:
    return f"""{POSTINGS}, asked AS ({terms}), wanted AS (SELECT query_id, term, count(*) AS qtf FROM asked GROUP BY ALL),
scored AS (SELECT w.query_id, p.doc_id, round(sum(w.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / a.avgdl))), 6) AS score FROM post p JOIN wanted w USING (term) JOIN idfs i USING (term) CROSS JOIN avgs a WHERE {where} GROUP BY ALL),
top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored WHERE score > 0)"""


@query(f"WITH {POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def bm25_stats(spark, d):
    return retrieval.bm25_terms(read(spark, d, "documents"), "doc_id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark, d, k, scope=None, queries=None):
    docs = read(spark, d, "documents")
    q = spark.createDataFrame([(0, QUERY_TEXT)], "q int, t string") if queries is None else queries
    return retrieval.bm25(docs, "doc_id", "text", q, "q", "t", k, scope)


@query(f"WITH {bm25_sql()} SELECT doc_id, score, rank FROM top WHERE rank < 10")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10).select("doc_id", "score", "rank")


@query(f"WITH {bm25_sql(chr(112) + '.source = ' + chr(39) + 'src1' + chr(39))} SELECT doc_id, score, rank FROM top WHERE rank < 10")
def bm25_topk_scoped(spark, d):
    return _bm25(spark, d, 10, F.col("source") == "src1").select("doc_id", "score", "rank")


@query("WITH " + bm25_sql("TRUE", "SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark") + " SELECT query_id, doc_id, score, rank FROM top WHERE rank < 5")
def bm25_batch(spark, d):
    return _bm25(spark, d, 5, None, read(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("t")))


def dense_sql(where: str = "TRUE") -> str:
    return f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score FROM embeddings, q WHERE {where}) SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM s QUALIFY rank < 10"


def _dense(spark, d, where):
    v = read(spark, d, "embeddings")
    return retrieval.dense(v.where(where), "vec_id", "embedding", v.where("vec_id = 0").select("vec_id", "embedding"), "vec_id", 10).select("vec_id", "score", "rank")


@query(dense_sql())
def dense_topk(spark, d):
    return _dense(spark, d, "true")


@query(dense_sql("label = 3"))
def dense_topk_scoped(spark, d):
    return _dense(spark, d, "label = 3")


#: Rankings of documents by a property, to be fused.
BY = {"long_": ("n_chars", 1.0), "early": ("-doc_id", 0.8), "short": ("-n_chars", 0.35)}


def _list(spark, d, by, k=60):
    docs = read(spark, d, "documents")
    return retrieval.ranked(docs.select("doc_id", "source", "lang", F.expr(f"cast({by} as double)").alias("score")), [F.desc("score"), F.asc("doc_id")], None, k)


def lists_sql(k: int = 60) -> str:
    return ", ".join(f"{n} AS (SELECT doc_id, source, lang, CAST({by} AS DOUBLE) AS score, row_number() OVER (ORDER BY {by} DESC, doc_id) - 1 AS rank FROM documents QUALIFY rank < {k})" for n, (by, _) in BY.items())


@query(f"""WITH {lists_sql()}, u AS ({' UNION ALL '.join(f"SELECT doc_id, '{n}' AS src, score, {w} / (60 + rank + 1) AS w FROM {n}" for n, (_, w) in BY.items())}),
f AS (SELECT doc_id, round(sum(w), 9) AS fusion_score, {', '.join(f"max(CASE WHEN src = '{n}' THEN score END) AS {n}_score" for n in BY)} FROM u GROUP BY doc_id)
SELECT *, row_number() OVER (ORDER BY fusion_score DESC, doc_id) - 1 AS rank FROM f QUALIFY rank < 80""")
def rrf_fuse(spark, d):
    return retrieval.reciprocal_rank_fusion({n: (_list(spark, d, by), w) for n, (by, w) in BY.items()}, 80)


@query(f"""WITH {lists_sql()}, u AS (SELECT doc_id, score, 0 AS part, rank AS place, CAST(NULL AS VARCHAR) AS supplemental_source FROM long_ UNION ALL SELECT doc_id, score, 1, rank, 'early' FROM early WHERE doc_id NOT IN (SELECT doc_id FROM long_))
SELECT doc_id, score, supplemental_source, row_number() OVER (ORDER BY part, place, doc_id) - 1 AS rank FROM u QUALIFY rank < 90""")
def append_fuse(spark, d):
    return retrieval.append_supplemental(_list(spark, d, "n_chars"), _list(spark, d, "-doc_id"), 90, "early")


def _three(spark, d):
    out = None
    for i, (by, _) in enumerate(BY.values()):
        one = _list(spark, d, by).withColumn("list", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


THREE = f"three AS ({' UNION ALL '.join(f'SELECT {i} AS list, * FROM {n}' for i, n in enumerate(BY))})"


@query(f"""WITH {lists_sql()}, {THREE}, m AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS rank_score, count(*) AS matches, min(rank) AS best_rank, max(score) AS max_score FROM three GROUP BY doc_id)
SELECT *, row_number() OVER (ORDER BY rank_score DESC, matches DESC, best_rank, max_score DESC, doc_id) - 1 AS rank FROM m QUALIFY rank < 50""")
def multi_query_merge(spark, d):
    return retrieval.merge_ranked(_three(spark, d), 50)


def scope_sql(scope: str, ratio: float) -> str:
    return f"""WITH {lists_sql()}, {THREE}, v AS (SELECT {scope}, round(sum(CASE WHEN list = 0 THEN 1.25 ELSE 1.0 END::DOUBLE / sqrt(rank + 1)), 6) AS score, count(*) AS votes FROM three WHERE rank < 40 GROUP BY {scope}),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, {scope}) AS n, lead(score) OVER (ORDER BY score DESC, {scope}) AS second FROM v),
e AS (SELECT *, round(score / coalesce(second, 1e-6::DOUBLE), 6) AS edge FROM o WHERE n = 1)
SELECT {scope}, score, votes, edge FROM e WHERE votes >= 3 AND NOT (coalesce(second, 0) > 0 AND edge < {ratio} AND votes < 6)"""


@query(scope_sql("source", 1.15))
def dominant_scope(spark, d):
    return retrieval.dominant_scope(_three(spark, d), "source", 1.15)


@query(scope_sql("lang", 1.10))
def dominant_multi_scope(spark, d):
    return retrieval.dominant_scope(_three(spark, d), "lang", 1.10)


@query(f"""WITH {lists_sql(10)} SELECT doc_id, score, rank FROM long_ WHERE source IN ('src1', 'src2', 'src3')""")
def scope_filter(spark, d):
    return _list(spark, d, "n_chars", 10).where(F.col("source").isin("src1", "src2", "src3")).select("doc_id", "score", "rank")


@query("""WITH s AS (SELECT conv_id, turn, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) - 1 AS rank FROM conversations QUALIFY rank < 20),
m AS (SELECT c.conv_id, c.turn, s.rank AS a, abs(c.turn - s.turn) AS b, c.turn AS t FROM conversations c JOIN s ON c.conv_id = s.conv_id AND c.turn BETWEEN s.turn - 2 AND s.turn + 2),
f AS (SELECT conv_id, turn, a, b, t FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY a, b, t) = 1)
SELECT conv_id, turn, row_number() OVER (ORDER BY a, b, t, conv_id) - 1 AS rank FROM f QUALIFY rank < 60""")
def neighbor_expand(spark, d):
    c = read(spark, d, "conversations")
    seeds = retrieval.ranked(c.select("conv_id", "turn", F.length("text").alias("n")), [F.desc("n"), F.asc("conv_id"), F.asc("turn")], None, 20)
    return retrieval.expand_neighbours(seeds, c, "conv_id", "turn", 2, 60)


@query("""WITH b AS (SELECT conv_id, turn, role, text, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS n FROM conversations),
i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS segment FROM b)
SELECT conv_id, CAST(segment AS BIGINT) AS segment, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, segment, role""")
def segment_merge(spark, d):
    return corpus.merge_segments(read(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("""WITH RECURSIVE seg AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, CAST(length(text) AS BIGINT) AS len FROM conversations),
w(conv_id, n, size, first, closed_first, closed_last) AS (
SELECT conv_id, n, len + 1, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) FROM seg WHERE n = 0
UNION ALL SELECT s.conv_id, s.n, CASE WHEN w.size + s.len + 1 > 420 THEN p.len + s.len + 1 ELSE w.size + s.len + 1 END,
CASE WHEN w.size + s.len + 1 > 420 THEN w.n ELSE w.first END, CASE WHEN w.size + s.len + 1 > 420 THEN w.first ELSE -1 END, CASE WHEN w.size + s.len + 1 > 420 THEN w.n ELSE -1 END
FROM w JOIN seg s ON s.conv_id = w.conv_id AND s.n = w.n + 1 JOIN seg p ON p.conv_id = w.conv_id AND p.n = w.n)
SELECT conv_id, closed_first AS first, closed_last AS last FROM w WHERE closed_first >= 0
UNION ALL SELECT conv_id, first, n AS last FROM w QUALIFY n = max(n) OVER (PARTITION BY conv_id)""")
def chunk_pack(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    out = turns.withColumn("lens", F.transform("t", lambda x: x.n)).select("conv_id", F.explode(corpus.pack_chunks(F.col("lens"))).alias("c"))
    return out.select("conv_id", F.col("c.first").cast("long").alias("first"), F.col("c.last").cast("long").alias("last"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents")
def text_normalize(spark, d):
    return read(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("clean"))


@query("""SELECT l_orderkey, l_linenumber, nullif(trim(c_name), '') AS customer, nullif(trim(n_name), '') AS nation, nullif(trim(r_name), '') AS region, coalesce(nullif(trim(c_mktsegment), ''), nullif(trim(o_orderpriority), '')) AS label
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def meta_resolve(spark, d):
    fact = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    chain = [
        (read(spark, d, "orders"), "l_orderkey", "o_orderkey", {"cust": "o_custkey", "priority": "o_orderpriority"}),
        (read(spark, d, "customer"), "cust", "c_custkey", {"customer": "c_name", "nat": "c_nationkey", "segment": "c_mktsegment"}),
        (read(spark, d, "nation"), "nat", "n_nationkey", {"nation": "n_name", "reg": "n_regionkey"}),
        (read(spark, d, "region"), "reg", "r_regionkey", {"region": "r_name"}),
    ]
    return corpus.resolve(fact, chain).select("l_orderkey", "l_linenumber", "customer", "nation", "region", F.coalesce("segment", "priority").alias("label"))


@query("SELECT a.n_name AS name, list_sort(list(DISTINCT b.n_name)) AS related FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name GROUP BY a.n_name")
def alias_closure(spark, d):
    return corpus.alias_closure(read(spark, d, "nation"), "n_regionkey", "n_name")


ALIASES = {"the": ["th", "zz"], "and": ["qq"], "of": ["zz", "yy"]}


@query("""WITH a AS (SELECT doc_id, text, [['and', 'qq'], ['of', 'zz'], ['of', 'yy'], ['the', 'th'], ['the', 'zz']] AS pairs FROM documents),
p AS (SELECT doc_id, text, unnest(pairs) AS pair, generate_subscripts(pairs, 1) AS n FROM a),
f AS (SELECT doc_id, pair[2] AS term, min(n) AS n FROM p WHERE contains(text, pair[1]) AND NOT contains(text, pair[2]) GROUP BY doc_id, pair[2])
SELECT d.doc_id, coalesce(string_agg(f.term, ' ' ORDER BY f.n), '') AS added FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def alias_append(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(corpus.append_aliases(F.col("text"), ALIASES), " ").alias("added"))


ENTITY = r"([A-Z][a-z]{3,})"
EDGES = """found AS (SELECT doc_id, regexp_extract_all(text, '([A-Z][a-z]{3,})', 1) AS es FROM documents), exploded AS (SELECT doc_id, unnest(es) AS entity, generate_subscripts(es, 1) - 1 AS pos FROM found),
edges AS (SELECT entity, doc_id, count(*) AS weight, min(pos) AS first FROM exploded GROUP BY entity, doc_id)"""


def _edges(spark, d):
    return graph.entity_edges(read(spark, d, "documents"), "doc_id", "text", ENTITY)


def _asked(spark):
    return spark.createDataFrame([("The",), ("This",), ("That",), ("Thing",)], "entity string")


ASKED = "asked AS (SELECT unnest(['The', 'This', 'That', 'Thing']) AS entity)"


@query(f"WITH {EDGES} SELECT entity, doc_id, weight, CAST(first AS INTEGER) AS first FROM edges")
def entity_edges(spark, d):
    return _edges(spark, d)


@query(f"WITH {EDGES}, {ASKED}, p AS (SELECT e.*, row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS place FROM edges e JOIN asked USING (entity)) SELECT doc_id, round(sum(least(weight, 4)::DOUBLE / place), 6) AS score FROM p GROUP BY doc_id")
def graph_direct(spark, d):
    return graph.direct_scores(_edges(spark, d), _asked(spark)).select("doc_id", F.round("score", 6).alias("score"))


def hop_sql(h: int) -> str:
    new = "" if h == 1 else "WHERE target NOT IN (SELECT entity FROM asked) "
    return f"""g{h} AS (SELECT doc_id, sum(mass * least(weight, 4) / (place + 1)) AS c FROM posting JOIN m{h} USING (entity) GROUP BY doc_id),
o{h} AS (SELECT target, sum(c / n / k) AS mass FROM g{h} JOIN ofdoc USING (doc_id) {new}GROUP BY target),
m{h + 1} AS (SELECT target AS entity, mass FROM o{h} WHERE mass >= 1e-4 ORDER BY round(mass, 9) DESC, target LIMIT 256)"""


def graph_sql() -> str:
    return f"""WITH {EDGES}, {ASKED}, posting AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY doc_id) - 1 AS place FROM edges QUALIFY place < 128),
od AS (SELECT doc_id, entity AS target, row_number() OVER (PARTITION BY doc_id ORDER BY first, entity) AS k FROM edges QUALIFY k <= 16), ofdoc AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM od),
m1 AS (SELECT entity, 1.0::DOUBLE AS mass FROM asked), {hop_sql(1)}, {hop_sql(2)}, {hop_sql(3)},
walk AS (SELECT doc_id, c * 0.35::DOUBLE AS s FROM g1 UNION ALL SELECT doc_id, c * 0.1225::DOUBLE FROM g2 UNION ALL SELECT doc_id, c * 0.042875::DOUBLE FROM g3)"""


@query(f"{graph_sql()} SELECT doc_id, round(sum(s), 6) AS score FROM walk GROUP BY doc_id")
def graph_ppr(spark, d):
    return graph.propagate(_edges(spark, d), _asked(spark)).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH r AS (SELECT n_name AS head, r_name AS tail FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
b AS (SELECT head AS entity, tail AS neighbour FROM r UNION ALL SELECT tail, head FROM r) SELECT DISTINCT b.entity, neighbour FROM b JOIN nation ON n_name = b.entity""")
def graph_relations(spark, d):
    n, r, s = read(spark, d, "nation"), read(spark, d, "region"), read(spark, d, "supplier")
    rel = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("head"), F.col("r_name").alias("tail")).union(s.join(n, s.s_nationkey == n.n_nationkey).select("s_name", "n_name"))
    return graph.relation_neighbours(rel, n.select(F.col("n_name").alias("entity")))


@query("""SELECT conv_id, turn, CASE WHEN text LIKE '%?%' THEN 'question' WHEN len(regexp_extract_all(lower(text), '[a-z0-9_]+')) >= 80 THEN 'detail' WHEN contains(lower(text), 'the') THEN 'fact' ELSE 'other' END AS mode FROM conversations""")
def query_mode(spark, d):
    low = F.lower("text")
    mode = F.when(F.col("text").contains("?"), "question").when(F.size(X.bm25_tokens(F.col("text"))) >= 80, "detail").when(low.contains("the"), "fact").otherwise("other")
    return read(spark, d, "conversations").select("conv_id", "turn", mode.alias("mode"))


@query(f"WITH {bm25_sql()}, t AS (SELECT doc_id, score FROM top WHERE rank < 40), w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents JOIN t USING (doc_id)) SELECT term, 2 * count(*) AS weight FROM w WHERE length(term) >= 4 AND term NOT IN ('{TERMS}') GROUP BY term ORDER BY weight DESC, term LIMIT 30")
def bridge_terms(spark, d):
    top = _bm25(spark, d, 40).select("doc_id")
    words = read(spark, d, "documents").join(F.broadcast(top), "doc_id").select(F.explode(X.bm25_tokens(F.col("text"))).alias("term"))  # 40 rows
    n = words.where((F.length("term") >= 4) & ~F.col("term").isin(QUERY_TEXT.split())).groupBy("term").agg((2 * F.count(F.lit(1))).alias("weight"))
    return n.orderBy(F.desc("weight"), "term").limit(30)


@query("""SELECT doc_id, CASE WHEN contains(text, 'Licensed') THEN 'background' WHEN contains(text, ' | ') THEN 'table' ELSE 'story' END AS source_type,
list_sort(list_filter([CASE WHEN contains(lower(text), 'thing') THEN 'action' END, CASE WHEN contains(lower(text), 'licensed') THEN 'context' END, CASE WHEN contains(lower(text), 'for') THEN 'motive' END], lambda x: x IS NOT NULL)) AS roles FROM documents""")
def source_roles(spark, d):
    low = F.lower("text")
    kind = F.when(F.col("text").contains("Licensed"), "background").when(F.col("text").contains(" | "), "table").otherwise("story")
    roles = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(r)) for w, r in (("thing", "action"), ("licensed", "context"), ("for", "motive"))]))
    return read(spark, d, "documents").select("doc_id", kind.alias("source_type"), F.sort_array(roles).alias("roles"))


@query("""SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, round(least(1.0::DOUBLE, 0.45::DOUBLE + CASE WHEN b.turn - a.turn <= 1 THEN 0.25 WHEN b.turn - a.turn <= 3 THEN 0.12 ELSE 0 END::DOUBLE + CASE WHEN a.role = b.role THEN 0.2 ELSE 0 END::DOUBLE
+ 0.08::DOUBLE * least(3, len(list_intersect(list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9_]{6,}')), list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_]{6,}')))))), 6) AS link
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn""")
def link_pairs(spark, d):
    c = read(spark, d, "conversations").withColumn("terms", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{6,}"), 0)))
    a, b = c.alias("a"), c.alias("b")
    gap = F.col("b.turn") - F.col("a.turn")
    near = F.when(gap <= 1, 0.25).when(gap <= 3, 0.12).otherwise(0.0)
    shared = F.least(F.lit(3), F.size(F.array_intersect("a.terms", "b.terms")))
    link = F.least(F.lit(1.0), 0.45 + near + F.when(F.col("a.role") == F.col("b.role"), 0.2).otherwise(0.0) + 0.08 * shared)
    return a.join(b, F.expr("a.conv_id = b.conv_id and a.turn < b.turn")).select("a.conv_id", F.col("a.turn").alias("turn_a"), F.col("b.turn").alias("turn_b"), F.round(link, 6).alias("link"))


BRIDGES, ASKED_WORDS, MOTIVES, OUTCOMES, TARGETS, COMMITS = ["license", "work", "law", "limitations", "permissions"], ["licensed", "thing"], ["because", "for"], ["result", "may"], ["except", "you"], ["compliance", "agree"]


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


def _some(words: list[str]) -> str:
    return f"list_filter(['{(chr(39) + ', ' + chr(39)).join(words)}'], lambda t: contains(low, t))"


LINK = """round(least(1e0, CASE WHEN x.story <> '' AND x.story = y.story THEN 45e-2 ELSE 0e0 END + CASE WHEN x.activity <> '' AND x.activity = y.activity AND NOT (x.background AND y.background AND x.story <> y.story) THEN
2e-1 + CASE WHEN x.stage <> '' AND x.stage = y.stage THEN 25e-2 ELSE 0e0 END + CASE WHEN abs(x.sort - y.sort) <= 1 THEN 25e-2 WHEN abs(x.sort - y.sort) <= 3 THEN 12e-2 ELSE 0e0 END + CASE abs(x.stage_no - y.stage_no) WHEN 0 THEN 22e-2 WHEN 1 THEN 14e-2 ELSE 0e0 END ELSE 0e0 END
+ least(3, len(list_intersect(x.b, y.b))) * 8e-2), 6)"""
CANDIDATES = f"""{bm25_sql()}, c1 AS (SELECT t.doc_id AS id, t.score AS base, coalesce(lang, '') AS activity, coalesce(source, '') AS story, concat('s', t.doc_id % 3) AS stage, t.doc_id // 50 AS sort, t.doc_id % 5 AS stage_no, contains(text, 'Licensed') AS background, text, lower(text) AS low FROM top t JOIN documents USING (doc_id) WHERE rank < 40),
c2 AS (SELECT *, {_some(QUERY_TEXT.split())} AS q, {_some(BRIDGES)} AS b, {_has(COMMITS)} AS commits FROM c1),
c AS (SELECT *, list_filter([CASE WHEN {_has(ASKED_WORDS)} OR len(q) >= 3 THEN 'action' END, CASE WHEN len(b) >= 2 THEN 'context' END, CASE WHEN {_has(MOTIVES)} AND len(q) + len(b) > 0 THEN 'motive' END, CASE WHEN {_has(OUTCOMES)} AND len(q) + len(b) > 0 THEN 'outcome' END, CASE WHEN {_has(TARGETS)} AND len(b) > 0 THEN 'target' END], lambda r: r IS NOT NULL) AS r FROM c2),
l AS (SELECT x.id AS a, y.id AS b, {LINK} AS link FROM c x JOIN c y ON x.id <> y.id)"""
STRICT = f"""{CANDIDATES}, seeds AS (SELECT id FROM c WHERE len(r) > 0 OR len(q) >= 2 OR len(b) >= 2 ORDER BY base DESC, id LIMIT 24),
p AS (SELECT s.id AS seed, c.*, coalesce(l.link, 1e0) AS link FROM seeds s JOIN c ON true LEFT JOIN l ON l.a = s.id AND l.b = c.id WHERE c.id = s.id OR l.link >= 4e-1),
m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY seed ORDER BY len(r) DESC, link DESC, len(b) DESC, base DESC, id) <= 8),
av AS (SELECT x.seed, avg(l.link) AS av FROM m x JOIN m y ON x.seed = y.seed AND x.id < y.id JOIN l ON l.a = x.id AND l.b = y.id GROUP BY x.seed),
g AS (SELECT seed, count(*) AS n, list_sort(list_distinct(flatten(list(r)))) AS r, len(list_distinct(flatten(list(q)))) AS nq, len(list_distinct(flatten(list(b)))) AS nb FROM m GROUP BY seed),
h AS (SELECT *, list_contains(r, 'action') AS ac, list_contains(r, 'outcome') AS oc, list_contains(r, 'motive') AS mo, list_contains(r, 'target') AS ta, list_contains(r, 'context') AS cx FROM g),
strict AS (SELECT seed, n, r, round(35e-2 * ac::INT + 3e-1 * oc::INT + 25e-2 * mo::INT + 18e-2 * ta::INT + 12e-2 * cx::INT + 25e-2 * (ac AND oc)::INT + 18e-2 * (ac AND mo)::INT + least(nq, 8) * 4e-2 + least(nb, 6) * 6e-2 + coalesce(av, 0e0) * 45e-2 + least(n, 5) * 3e-2, 6) AS score FROM h LEFT JOIN av USING (seed) WHERE len(r) >= 2 AND CASE WHEN ac THEN oc OR ta ELSE mo AND oc END)"""
BONUS = f"""{STRICT}, best AS (SELECT *, row_number() OVER (ORDER BY score DESC, seed) AS k FROM strict QUALIFY k <= 3),
bonus AS (SELECT m.id, round(max(least(best.score, 125e-2) * pow(85e-2, k - 1) + 8e-2 * len(m.r) + 12e-2 * list_contains(m.r, 'action')::INT + 11e-2 * list_contains(m.r, 'outcome')::INT + 1e-1 * list_contains(m.r, 'motive')::INT), 6) AS bonus
FROM best JOIN m USING (seed) WHERE list_has_any(m.r, ['target', 'outcome']) OR (list_contains(m.r, 'action') AND len(list_filter(m.q, lambda t: length(t) >= 4)) > 0) OR (list_contains(m.r, 'motive') AND len(m.b) >= 2 AND m.commits) GROUP BY m.id),
f AS (SELECT c.id, base, coalesce(bonus, 0e0) AS bonus, background, len(list_filter(q, lambda t: length(t) >= 5)) > 0 AS exact, {_has(ASKED_WORDS)} AS acts FROM c LEFT JOIN bonus USING (id)),
focus AS (SELECT *, CASE WHEN exact THEN 105e-2 ELSE 0e0 END + CASE WHEN exact AND acts THEN 35e-2 ELSE 0e0 END + CASE WHEN bonus > 0 THEN 0e0 ELSE CASE WHEN acts AND NOT exact THEN -22e-2 ELSE 0e0 END + CASE WHEN exact THEN 0e0 ELSE -45e-2 END + CASE WHEN acts THEN 0e0 ELSE -2e-1 END END + CASE WHEN background THEN -11e-1 ELSE 8e-1 END AS focus FROM f)"""


def _candidates(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    c = _bm25(spark, d, 40).select(F.col("query_id").alias("query"), "doc_id", "score").join(docs, "doc_id").withColumn("low", F.lower("text"))
    c = c.withColumn("q_terms", chains.present(F.col("low"), QUERY_TEXT.split())).withColumn("b_terms", chains.present(F.col("low"), BRIDGES))
    c = c.withColumn("roles", chains.evidence_roles(F.col("low"), F.col("q_terms"), F.col("b_terms"), ASKED_WORDS, MOTIVES, OUTCOMES, TARGETS))
    return c.select(
        "query", F.col("doc_id").alias("id"), F.col("score").alias("base"), "roles", "q_terms", "b_terms", F.col("b_terms").alias("chain_terms"), F.coalesce("source", F.lit("")).alias("story"), F.coalesce("lang", F.lit("")).alias("activity"),
        F.concat(F.lit("s"), F.col("doc_id") % 3).alias("stage"), F.floor(F.col("doc_id") / 50).alias("sort"), (F.col("doc_id") % 5).alias("stage_no"), F.col("text").contains("Licensed").alias("background"), (X.hits(F.col("low"), COMMITS) > 0).alias("commits"), "low",
    )


@query(f"WITH {STRICT} SELECT seed, n AS n_members, r AS roles, score FROM strict")
def chain_strict(spark, d):
    return chains.strict_chains(_candidates(spark, d), "query").select("seed", F.size("members").cast("long").alias("n_members"), "roles", "score")


@query(f"""WITH {CANDIDATES}, g0 AS (SELECT * REPLACE (CASE WHEN len(r) = 0 AND len(q) + len(b) > 0 THEN ['context'] ELSE r END AS r) FROM c),
seeds AS (SELECT id, row_number() OVER (ORDER BY len(q) DESC, len(b) DESC, len(r) DESC, base DESC, id) AS place FROM g0 WHERE len(q) > 0 OR len(b) > 0 OR base > 0 QUALIFY place <= 32),
p AS (SELECT s.id AS seed, s.place, g0.*, coalesce(l.link, 1e0) AS link FROM seeds s JOIN g0 ON true LEFT JOIN l ON l.a = s.id AND l.b = g0.id WHERE g0.id = s.id OR l.link >= 25e-2),
m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY seed ORDER BY id = seed DESC, link DESC, len(q) DESC, len(b) DESC, len(r) DESC, base DESC, id) <= 5),
g AS (SELECT seed, min(place) AS place, list_sort(list(id)) AS members, avg(base) AS mean, list_sort(list_distinct(flatten(list(r)))) AS r, len(list_distinct(flatten(list(q)))) AS nq, len(list_distinct(flatten(list(b)))) AS nb FROM m GROUP BY seed HAVING count(*) >= 2)
SELECT seed, members, r AS roles, round(least(nq, 8) * 12e-2 + least(nb, 6) * 8e-2 + least(len(r), 4) * 5e-2 + mean * 1e-1, 4) AS score FROM g QUALIFY row_number() OVER (PARTITION BY members ORDER BY place) = 1""")
def chain_generic(spark, d):
    out = chains.generic_chains(_candidates(spark, d), "query")
    return out.select("seed", F.sort_array(F.transform("members", lambda x: x["id"])).alias("members"), "roles", F.round("score", 4).alias("score"))


def _focused(spark, d):
    c = _candidates(spark, d)
    bonus = chains.chain_bonus(chains.strict_chains(c, "query"), "query")
    c = c.join(bonus, ["query", "id"], "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    kind = F.when(F.col("background"), "background").otherwise("story")
    asked = [t for t in QUERY_TEXT.split() if len(t) >= 5]
    return c.withColumn("focus", chains.causal_focus(F.col("low"), F.col("bonus"), asked, ASKED_WORDS) + chains.source_focus(kind, False, True, False))


@query(f"WITH {BONUS} SELECT id AS doc_id, bonus, round(focus, 6) AS focus FROM focus")
def focus_adjust(spark, d):
    return _focused(spark, d).select(F.col("id").alias("doc_id"), "bonus", F.round("focus", 6).alias("focus"))


@query(f"WITH {BONUS} SELECT id AS doc_id, round(base + bonus + focus, 6) AS score, row_number() OVER (ORDER BY round(base + bonus + focus, 6) DESC, id) - 1 AS rank FROM focus QUALIFY rank < 20")
def chain_rerank(spark, d):
    scored = _focused(spark, d).select("query", F.col("id").alias("doc_id"), F.round(F.col("base") + F.col("bonus") + F.col("focus"), 6).alias("score"))
    return retrieval.ranked(scored, [F.desc("score"), F.asc("doc_id")], ["query"], 20).select("doc_id", F.col("score"), F.col("rank").cast("long").alias("rank"))


DEFINERS = ["Licensed", "means", "under"]


@query("""WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS t FROM documents),
y AS (SELECT doc_id, contains(t, 'Apache')::INT AS a1, contains(t, 'License')::INT AS a2, contains(t, 'Licensed')::INT + contains(t, 'means')::INT + contains(t, 'under')::INT AS m,
regexp_matches(t, 'Apache.{0,32}(?:Licensed|means|under)|(?:Licensed|means|under).{0,32}Apache')::INT AS n1, regexp_matches(t, 'License.{0,32}(?:Licensed|means|under)|(?:Licensed|means|under).{0,32}License')::INT AS n2 FROM x),
z AS (SELECT doc_id, CASE WHEN a1 + a2 = 0 THEN 0 ELSE 4 * (a1 + a2) + m + 3 * (a1 * n1 + a2 * n2) END AS score FROM y)
SELECT doc_id, score::BIGINT AS score FROM z WHERE score >= 7 ORDER BY score DESC, doc_id LIMIT 10""")
def definition_best(spark, d):
    score = support.definition(F.col("text"), ["Apache", "License"], DEFINERS).cast("long")
    return read(spark, d, "documents").select("doc_id", score.alias("score")).where(F.col("score") >= support.LEAST_DEFINITION).orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"""WITH x AS (SELECT doc_id, coalesce(source, '') AS source, lower(coalesce(text, '')) AS low FROM documents),
y AS (SELECT doc_id, source, len({_some(["because", "for", "result"])}) AS m, len({_some(["thing", "apache"])}) AS x, len({_some(["use", "agree"])}) AS a, {_has(["because"])} AS direct FROM x),
z AS (SELECT *, CASE WHEN m > 0 AND x + a > 0 THEN least(m, 4) * 42e-2 + least(x, 2) * 28e-2 + least(a, 2) * 35e-2 WHEN x > 0 AND a > 0 THEN 35e-2 ELSE 0e0 END + CASE WHEN m >= 2 AND source = 'src1' THEN 55e-2 ELSE 0e0 END AS score FROM y)
SELECT doc_id, round(CASE WHEN source = 'src2' AND (NOT direct OR a = 0) THEN least(score, 2e-1) - 12e-1 ELSE score END, 6) AS bonus FROM z""")
def causality_support(spark, d):
    source = F.coalesce("source", F.lit(""))
    bonus = support.causality(F.lower("text"), ["thing", "apache"], ["use", "agree"], ["because", "for", "result"], ["because"], source == "src1", source == "src2")
    return read(spark, d, "documents").select("doc_id", F.round(bonus, 6).alias("bonus"))


SIM = "list_distinct(regexp_extract_all(lower(regexp_replace(text, '\\s+', '', 'g')), '[a-z0-9_]{2,}'))"

@query(f"""WITH x AS (SELECT doc_id, {SIM} AS t, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents QUALIFY rank < 40),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, len(list_intersect(a.t, b.t)) AS n, len(a.t) AS la, len(b.t) AS lb FROM x a JOIN x b ON a.rank < b.rank)
SELECT doc_a, doc_b, round(CASE WHEN la = 0 OR lb = 0 THEN 0 ELSE n::DOUBLE / (la + lb - n) END, 6) AS similarity FROM p""")
def jaccard_pairs(spark, d):
    top = _list(spark, d, "n_chars", 40).select("doc_id", "rank").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    x = top.select("doc_id", "rank", X.similarity_tokens(F.col("text")).alias("t"))
    a, b = x.alias("a"), x.alias("b")
    return a.join(b, F.expr("a.rank < b.rank")).select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), F.round(X.jaccard(F.col("a.t"), F.col("b.t")), 6).alias("similarity"))


def near_sql() -> str:
    return f"""WITH RECURSIVE x AS (SELECT doc_id, {SIM} AS t, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents QUALIFY n <= 40),
p AS (SELECT a.n AS na, b.n AS nb FROM x a JOIN x b ON a.n < b.n WHERE len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.82),
near AS (SELECT x.n, x.doc_id, coalesce(list(p.na) FILTER (p.na IS NOT NULL), []) AS before FROM x LEFT JOIN p ON p.nb = x.n GROUP BY x.n, x.doc_id),
k(n, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT near.n, CASE WHEN list_has_any(k.kept, near.before) THEN k.kept ELSE list_append(k.kept, near.n) END FROM k JOIN near ON near.n = k.n + 1),
kept_docs AS (SELECT doc_id, n FROM near WHERE list_contains((SELECT kept FROM k ORDER BY n DESC LIMIT 1), n))"""


@query(f"{near_sql()} SELECT doc_id FROM kept_docs")
def near_dup(spark, d):
    top = _list(spark, d, "n_chars", 40).select("doc_id", "rank").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    items = top.agg(F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").alias("id"), X.similarity_tokens(F.col("text")).alias("tokens")))).alias("x"))  # top-k rows
    return items.select(F.explode(evidence.near_duplicates(F.col("x"))).alias("kept")).select(F.col("kept.id").alias("doc_id"))


@query()
def mmr_select(spark, d):
    hits = _bm25(spark, d, 30).join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return evidence.mmr(hits.select("query_id", "doc_id", "score", X.similarity_tokens(F.col("text")).alias("tokens")), "query_id", 10)


@query("""SELECT doc_id, CASE WHEN c = 0 THEN 0 ELSE 3 * c + b END AS score FROM (SELECT doc_id, contains(text, 'Licensed')::INT + contains(text, 'Apache')::INT AS c, contains(text, 'the')::INT + contains(text, 'and')::INT AS b FROM documents) WHERE (CASE WHEN c = 0 THEN 0 ELSE 3 * c + b END) >= 5""")
def bundle_score(spark, d):
    score = evidence.bundle_score(F.col("text"), ["Licensed", "Apache"], ["the", "and"])
    return read(spark, d, "documents").select("doc_id", score.alias("score")).where("score >= 5")


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\\n\\r。！？；]+'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents),
e AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(regexp_extract_all(lower(sentence), '(the|and|of)')) DESC, pos) AS n FROM e)
SELECT doc_id, string_agg(sentence, chr(10) ORDER BY pos) AS text FROM r WHERE n <= 4 GROUP BY doc_id""")
def sentence_refine(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("score", F.size(F.regexp_extract_all(F.lower("sentence"), F.lit("(the|and|of)"), 1)))
    best = s.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))).where("n <= 4")
    return best.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x.sentence), "\n").alias("text"))


@query("""WITH u AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 20000 OR n = 1""")
def render_budget(spark, d):
    return evidence.within_budget(read(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars", 20000).select("source", "doc_id", "used")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents QUALIFY rank < 5) SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN rank = 1 THEN 2147483647 ELSE rank END) - 1 AS position FROM r""")
def pyramid_order(spark, d):
    top = retrieval.ranked(read(spark, d, "documents").select("source", "doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], ["source"], 5)
    return top.select("source", "doc_id", (F.row_number().over(Window.partitionBy("source").orderBy(evidence.pyramid(F.col("rank")))) - 1).alias("position"))


@query("""WITH q AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS q FROM benchmark), e AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS e FROM documents) SELECT item_id, doc_id FROM q JOIN e ON contains(e, q) WHERE q <> ''""")
def quote_ground(spark, d):
    q = read(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return evidence.ground_quotes(q, "quote", read(spark, d, "documents").select("doc_id", "text"), "text").select("item_id", "doc_id")


@query("""WITH p AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
t AS (SELECT conv_id, turn, lower(before) AS e, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS ts FROM p WHERE role = 'assistant' AND before IS NOT NULL),
m AS (SELECT conv_id, turn, len(ts) AS n_tokens, len(list_filter(ts, lambda x: length(x) >= 3 AND NOT contains(e, x))) AS missed FROM t)
SELECT conv_id, turn, n_tokens, missed, n_tokens = 0 OR (n_tokens - missed) / n_tokens::DOUBLE >= 0.25 OR missed < 4 AS grounded FROM m""")
def token_ground(spark, d):
    c = read(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant' and before is not null")
    tokens, missed = evidence.ungrounded(F.array_distinct(X.bm25_tokens(F.col("text"))), F.lower("before"))
    c = c.select("conv_id", "turn", F.size(tokens).cast("long").alias("n_tokens"), F.size(missed).cast("long").alias("missed"))
    return c.withColumn("grounded", (F.col("n_tokens") == 0) | F.coalesce((F.col("n_tokens") - F.col("missed")) / F.nullif(F.col("n_tokens"), F.lit(0)) >= 0.25, F.lit(False)) | (F.col("missed") < 4))


TIES = ["purchase", "click", "view", "signup"]


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS votes, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS p FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, votes FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, p, event_type) = 1""")
def vote_action(spark, d):
    return evidence.vote(read(spark, d, "events"), "user_id", "event_type", TIES)


PAGE_LINES = """l AS (SELECT page_id, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript>', ' ', 'g'), '(?is)<svg\\b[^>]*>.*?</svg>', ' ', 'g'), '(?is)<template\\b[^>]*>.*?</template>', ' ', 'g'), '(?i)<(br|/p|/div|/li|/h[1-6])\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(10)), lambda s: trim(regexp_replace(s, '[ \\t\\r\\f]+', ' ', 'g'))), lambda s: length(s) >= 8) AS lines FROM pages)"""


@query(f"WITH {PAGE_LINES} SELECT page_id, array_to_string(lines, chr(10)) AS text FROM l")
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(X.html_lines(F.col("html")), "\n").alias("text"))


@query(f"WITH {PAGE_LINES}, e AS (SELECT page_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM l), h AS (SELECT * FROM e WHERE contains(lower(line), 'the')), u AS (SELECT page_id, pos, line, sum(length(line)) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM h) SELECT page_id, CAST(pos AS INTEGER) AS pos, line FROM u WHERE used <= 1200")
def focus_lines(spark, d):
    lines = read(spark, d, "pages").select("page_id", F.posexplode(X.html_lines(F.col("html"))).alias("pos", "line")).where(F.lower("line").contains("the"))
    used = F.sum(F.length("line")).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).where("used <= 1200").select("page_id", "pos", "line")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def link_extract(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))


@query("SELECT page_id, regexp_matches(url, '^https?://') AND NOT regexp_matches(lower(url), '\\.(png|jpg|gif|css|js|pdf)(\\?|#|$)') AND NOT regexp_matches(lower(url), '://[^/]*(casino|ads-track|spam|adult)') AS usable FROM pages")
def url_usable(spark, d):
    u, low = F.col("url"), F.lower("url")
    return read(spark, d, "pages").select("page_id", (u.rlike("^https?://") & ~low.rlike(r"\.(png|jpg|gif|css|js|pdf)(\?|#|$)") & ~low.rlike("://[^/]*(casino|ads-track|spam|adult)")).alias("usable"))


@query(f"WITH {lists_sql()}, v AS (SELECT source, sum(greatest(1, 12 - rank))::BIGINT AS votes FROM long_ WHERE rank < 12 AND coalesce(source, '') <> '' GROUP BY source) SELECT source, votes FROM v WHERE votes >= 3 ORDER BY votes DESC, length(source) DESC, source LIMIT 1")
def story_vote(spark, d):
    return retrieval.story_vote(_list(spark, d, "n_chars").select("rank", "source"), "source", 12, 3)


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id")
def history_window(spark, d):
    last = read(spark, d, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("n <= 4")
    said = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("said"))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x.said), "\n").alias("history"))


@query()
def json_repair(spark, d):
    return read(spark, d, "events").select("event_id", evidence.repaired(F.expr("substring(props, 1, length(props) - 1)")).alias("props"))


_SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_SPACE}+|{_SPACE}+\z', '', 'g')"


@query(rf"""WITH x AS (SELECT conv_id, turn, text, role || ': <think>' || text || '</think>' || chr(10) || 'warning: low' || chr(10) || text || ' [end of text]' || chr(10) || 'load_ model' AS raw, role || ':' AS prompt FROM conversations),
a AS (SELECT conv_id, turn, {_strip("substr(raw, length(prompt) + 1)")} AS t FROM x),
b AS (SELECT conv_id, turn, {_strip(f"regexp_replace(t, '(?s)<think>.*?</think>{_SPACE}*', '', 'g')")} AS t FROM a),
c AS (SELECT conv_id, turn, {_strip("regexp_replace(t, '(?m)^warning:.*$', '', 'g')")} AS t FROM b),
d AS (SELECT conv_id, turn, {_strip("regexp_replace(t, '(?m)^(main|common_|llama_|load_|print_info:|system_info:|sampler ).*$', '', 'g')")} AS t FROM c)
SELECT conv_id, turn, {_strip("replace(t, '[end of text]', '')")} AS answer FROM d""")
def clean_output(spark, d):
    c = read(spark, d, "conversations")
    raw = F.concat("role", F.lit(": <think>"), "text", F.lit("</think>\nwarning: low\n"), "text", F.lit(" [end of text]\nload_ model"))
    return c.select("conv_id", "turn", answers.clean_output(raw, F.concat("role", F.lit(":"))).alias("answer"))


@query(rf"""WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[、,，;；]{_SPACE}*'), lambda s: {_strip("s")}), lambda s: s <> '') AS l FROM documents),
y AS (SELECT doc_id, list_filter(l, lambda s, i: list_position(l, s) = i) AS l FROM x)
SELECT doc_id, len(l[1:6]) AS n, array_to_string(l[1:6], '|') AS items FROM y""")
def string_list(spark, d):
    x = read(spark, d, "documents").select("doc_id", answers.string_list(F.col("text"), 6).alias("l"))
    return x.select("doc_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("items"))


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'abstain' ELSE 'answer' END AS action, list_filter(['not', 'cannot', 'sorry'], lambda m: contains(coalesce(text, ''), m)) AS m FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, action = 'abstain' OR len(m) > 0 AS abstains, array_to_string(m, ' ') AS markers FROM x""")
def abstain_answers(spark, d):
    c = read(spark, d, "conversations").where("role = 'assistant'")
    action, markers = F.when(F.col("turn") % 5 == 4, "abstain").otherwise("answer"), ["not", "cannot", "sorry"]
    return c.select("conv_id", "turn", answers.abstains(action, F.col("text"), markers).alias("abstains"), F.array_join(answers.abstain_markers(F.col("text"), markers), " ").alias("markers"))


@query(rf"""WITH x AS (SELECT source, doc_id, {_strip(f"regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g')")} AS t, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 3)
SELECT source, rank, doc_id, CASE WHEN length(t) > 900 THEN {_strip("substr(t, 1, 899)")} || '…' ELSE t END AS text FROM x""")
def abstain_evidence(spark, d):
    return answers.abstain_evidence(read(spark, d, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], "text").select("source", F.col("rank").cast("long").alias("rank"), "doc_id", "text")
