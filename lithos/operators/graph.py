"""Entity-passage graph: edges, direct scores, propagation and relations, as joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.stories import strip
from lithos.operators.retrieval import ranked

DECAY, HOPS, FAN_OUT, DOC_ENTITIES, WEIGHT_CAP = 0.35, 3, 128, 16, 4
LEAST_MASS, KEPT = 1e-4, 256
# What relations weigh.
TRAVERSAL, EDGE, ENDPOINT, EVIDENCE, WEAK_EVIDENCE = 1.4, 1.5, 0.5, 2.4, 0.45


def entity_edges(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(entity, doc_id, weight, first): occurrences of what `pattern` (one group) finds in each document, and the first's place."""
    found = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("pos", "entity"))
    return found.groupBy("entity", "doc_id").agg(F.count(F.lit(1)).alias("weight"), F.min("pos").alias("first"))


def _placed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("doc_id")) - 1)


def direct_scores(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, score): sum over query entities of min(weight, 4) / (place in the posting list + 1)."""
    hit = _placed(edges.join(entities, "entity", "left_semi"))
    return hit.groupBy("doc_id").agg(F.sum(F.least("weight", F.lit(WEIGHT_CAP)) / (F.col("place") + 1)).alias("score"))


def node_weight(entity: Column) -> Column:
    """Entities that come from a passage's description weigh a quarter."""
    return F.when(entity.rlike("^(activity|story|stage):"), 0.25).otherwise(1.0)


def fan_out(entity: Column) -> Column:
    return F.when(entity.rlike("^(activity|story|stage):"), 48).otherwise(FAN_OUT)


def propagate(edges: DataFrame, entities: DataFrame, hops: int = HOPS, relations: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of a bounded personalised walk from the query entities.

    In each hop an entity hands its mass, by its node weight, to the first
    passages of its posting list, FAN_OUT or fewer; a passage hands what it
    got to its first DOC_ENTITIES entities, later ones less, and an entity to
    its relations' other ends (entity, neighbour). From the second hop on,
    query entities are no targets. scope (doc_id): only these passages count.
    Unrolled: each hop is a join and an aggregate, cut to the KEPT heaviest
    entities.
    """
    posting = _placed(edges).where(F.col("place") < fan_out(F.col("entity")))
    if scope is not None:
        posting = _placed(posting.drop("place").join(scope, "doc_id", "left_semi"))
    order = Window.partitionBy("doc_id").orderBy("first", "entity")
    of_doc = edges.withColumn("offset", F.row_number().over(order)).where(F.col("offset") <= DOC_ENTITIES)
    of_doc = of_doc.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).select("doc_id", F.col("entity").alias("target"), "offset", "n")
    mass = entities.select("entity", node_weight(F.col("entity")).alias("mass"))
    parts = None
    for hop in range(1, hops + 1):
        given = posting.join(mass, "entity").withColumn("c", F.col("mass") * node_weight(F.col("entity")) * F.least("weight", F.lit(WEIGHT_CAP)) / (F.col("place") + 1))
        of_hop = given.groupBy("doc_id").agg(F.sum("c").alias("c"))
        part = of_hop.select("doc_id", (F.col("c") * DECAY**hop).alias("score"))
        parts = part if parts is None else parts.unionByName(part)
        onward = of_hop.join(of_doc, "doc_id").select("target", (F.col("c") / F.col("n") / F.col("offset") * node_weight(F.col("target"))).alias("mass"))
        if relations is not None:
            onward = onward.unionByName(relations.join(mass, "entity").select(F.col("neighbour").alias("target"), (F.col("mass") * TRAVERSAL).alias("mass")))
        onward = onward.groupBy("target").agg(F.sum("mass").alias("mass")).where(F.col("mass") >= LEAST_MASS)
        if hop > 1:
            onward = onward.join(entities.select(F.col("entity").alias("target")), "target", "left_anti")
        mass = onward.orderBy(F.desc(F.round("mass", 9)), "target").limit(KEPT).select(F.col("target").alias("entity"), "mass")
    return parts.groupBy("doc_id").agg(F.sum("score").alias("score"))


def alias_names(aliases: DataFrame) -> DataFrame:
    """(name, canonical) of (place, canonical, aliases): every name of two characters or more; of one that several have, the last."""
    all_ = aliases.select("place", "canonical", F.posexplode(F.concat(F.array("canonical"), F.col("aliases"))).alias("n", "name")).withColumn("name", strip(F.col("name")))
    return all_.where(F.length("name") >= 2).groupBy("name").agg(F.max_by("canonical", F.struct("place", "n")).alias("canonical"))


def alias_entities(text: Column, names: dict[str, str]) -> Column:
    """What the names in a text stand for, each once, by where its first name ends (of two that end together, the longer). Overlaps count."""
    if not names:
        return F.array().cast("array<string>")
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("canonical")) for n, c in sorted(names.items())])
    here = F.filter(table, lambda a: F.coalesce(text.contains(a["name"]), F.lit(False)))
    placed = F.transform(here, lambda a: F.struct((F.call_function("instr", text, a["name"]) + F.length(a["name"])).alias("end"), (-F.length(a["name"])).alias("long"), a["canonical"].alias("canonical")))
    return F.array_distinct(F.transform(F.sort_array(placed), lambda p: p["canonical"]))


def metadata_entities(activity: Column, story: Column, stage_code: Column, stage_name: Column) -> Column:
    """activity:, story: and stage: entities of a passage's description; blank fields give none."""
    parts = [(activity, "activity:"), (story, "story:"), (stage_code, "stage:"), (stage_name, "stage:")]
    return F.array_compact(F.array(*[F.when(strip(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(p), strip(c))) for c, p in parts]))


def gate_terms(text: Column, stop: list[str], keywords: list[str]) -> Column:
    """Terms by which a question and a relation meet: runs without a stop word, pairs to quadruples of longer Chinese ones, and the keywords in the text."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}·]{2,32}|[A-Za-z][A-Za-z0-9_.\-]{1,31}"), F.lit(0)), strip)
    stops = F.array(*[F.lit(s) for s in stop]).cast("array<string>")
    runs = F.filter(runs, lambda r: (F.length(r) >= 2) & ~F.exists(stops, lambda s: r.contains(s)))

    def grams(run: Column) -> Column:
        def of(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))

        sizes = [of(2), of(3), of(4)]
        return F.when(run.rlike(r"\A[\x{4e00}-\x{9fff}]") & (F.length(run) >= 4), F.filter(F.concat(*sizes), lambda g: ~F.array_contains(stops, g))).otherwise(F.array().cast("array<string>"))

    said = F.filter(F.array(*[F.lit(k) for k in keywords]).cast("array<string>"), lambda k: text.contains(k))
    return F.array_distinct(F.concat(runs, F.flatten(F.transform(runs, grams)), said))


def scope_key(activity: Column, story: Column, zone: Column, excluded: list[str]) -> Column:
    """The activity within which a walk over the graph stays; empty if there is none."""
    a, s, z = (strip(F.coalesce(c, F.lit(""))) for c in (activity, story, zone))
    folder, main = F.regexp_extract(s, "(?:^|/)activities/([^/]+)/", 1), F.regexp_extract(s, r"(?i)(?:^|/)(?:level_)?main[_-](\d{1,2})(?:[-_/]|$)", 1)
    named = F.when((a != "") & ~a.isin(excluded or [""]), a).when(folder != "", folder).when(main != "", F.concat(F.lit("main_"), main.try_cast("int").cast("string"))).when(z.startswith("main_"), z)
    return F.coalesce(F.concat(F.lit("activity:"), named), F.lit(""))


def relation_scores(relations: DataFrame, edges: DataFrame, entities: DataFrame, question: str, stop: list[str], keywords: list[str], scope: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): what relations (head, relation, tail, source, evidence: array of doc ids) that touch a query entity add to passages.

    entities: (entity, pos). A relation counts once, through the first of them
    that it touches. It is strong if both ends are known to the question, or
    one is and they share a term or a long end; then its evidence and ends
    weigh more. scope (doc_id): relations without evidence in it are left out.
    """
    key = ["head", "relation", "tail", "source"]
    ends = relations.withColumn("end", F.explode(F.array("head", "tail")))
    met = ends.join(entities.select(F.col("entity").alias("end"), "pos"), "end").groupBy(*key).agg(F.min_by("end", "pos").alias("through"))
    met = met.join(relations.groupBy(*key).agg(F.first("evidence").alias("evidence")), key)
    known = entities.agg(F.collect_set("entity").alias("known"))  # a question's own, few
    met = met.crossJoin(F.broadcast(known))
    if scope is not None:
        inside = met.select(*key, F.posexplode("evidence").alias("n", "doc_id")).join(scope, "doc_id", "left_semi")
        met = met.join(inside.select(*key).distinct(), key, "left_semi")
    q = F.lit(question)
    hit = lambda e: (F.array_contains("known", F.col(e)) | q.contains(F.col(e)) | F.col("through").contains(F.col(e))).cast("int")
    ours, theirs = gate_terms(q, stop, keywords), gate_terms(F.concat_ws(" ", "head", "tail", "relation"), stop, keywords)
    matched = hit("head") + hit("tail")
    phrase = ((F.length("head") >= 3) & q.contains(F.col("head"))) | ((F.length("tail") >= 3) & q.contains(F.col("tail")))
    strong = (matched >= 2) | ((matched >= 1) & (F.arrays_overlap(ours, theirs) | phrase))
    met = met.withColumn("strong", strong).withColumn("bonus", EDGE * F.greatest(F.lit(1), matched))

    def placed(rows: DataFrame, first: int, by: list[str]) -> DataFrame:
        rows = rows.where(F.col("n") < first)
        if scope is not None:
            rows = rows.join(scope, "doc_id", "left_semi")
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("n")))

    evidence = placed(met.select(*key, "strong", "bonus", F.posexplode("evidence").alias("n", "doc_id")), 8, key)
    parts = [evidence.select("doc_id", (F.col("bonus") * F.when(F.col("strong"), EVIDENCE).otherwise(WEAK_EVIDENCE) / F.col("rank")).alias("score"))]
    post = _placed(edges).select(F.col("entity").alias("end"), "doc_id", F.col("place").alias("n"))
    sides = met.select(*key, "strong", "bonus", F.posexplode(F.array("head", "tail")).alias("side", "end")).join(post, "end")
    parts.append(placed(sides, FAN_OUT, [*key, "side"]).select("doc_id", (ENDPOINT / F.col("rank")).alias("score")))
    parts.append(placed(sides.where("strong"), 32, [*key, "side"]).select("doc_id", (F.col("bonus") / F.col("rank")).alias("score")))
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sum("score").alias("score"))


def graph_search(edges: DataFrame, entities: DataFrame, k: int, relations: DataFrame | None = None, question: str = "", stop: list[str] | None = None, keywords: list[str] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, rank): the sum of direct scores, the walk and the relations, the k best. entities: (entity, pos)."""
    direct = edges if scope is None else edges.join(scope, "doc_id", "left_semi")
    ends = None if relations is None else relation_neighbours(relations, relations.select(F.explode(F.array("head", "tail")).alias("entity")).distinct()).where("entity != neighbour")
    parts = [direct_scores(direct, entities), propagate(edges, entities, relations=ends, scope=scope)]
    if relations is not None:
        parts.append(relation_scores(relations, edges, entities, question, stop or [], keywords or [], scope))
    total = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return ranked(total, [F.desc("score"), F.asc("doc_id")], None, k)


def relation_neighbours(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, neighbour): ends of the relations of each query entity, either way."""
    both = relations.select(F.col("head").alias("entity"), F.col("tail").alias("neighbour")).union(relations.select("tail", "head"))
    return both.join(entities, "entity", "left_semi").distinct()
