"""Answers to questions over entities, relationships, communities and text units: matching in stages, expansion, retrieval,
global, local and hybrid search. All take tables of questions, so a batch is the usual case.

questions are (query_id, entities array, keywords array, type, confidence); entities (id, name, type, description,
units array of unit ids), relationships (src, dst, description), units (unit_id, text), communities (community, level, title,
summary, size) and their members (community, name). Ties are broken by id, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .containment import contains_pairs
from .graph import written
from .text import edit_matches

def matched_entities(questions: DataFrame, entities: DataFrame, most: int = 10, enough: int = 5, few: int = 3) -> DataFrame:
    """The entities that a question names: (query_id, id, stage, place), place from 1.

    Stage 1: the same name; 2: one name contains the other; 3, if there are fewer than `enough` so far: a keyword is a
    character of the name or a word of the description; 4, if still fewer than `few`: names within min(2, half the
    mention's length) edits. Each entity counts at its first stage; within a stage the order is by mention, then by id.
    """
    # of the entities that one text or word leads to at one stage, those after the first `cap` by id are behind them for every question
    cap = max(most, enough, few)
    mentions = questions.select("query_id", F.posexplode("entities").alias("pos", "mention"))
    names = written(_first_ids(entities.select("name", "id"), "name", cap))
    exact = mentions.join(names, F.col("mention") == F.col("name")).select("query_id", "id", F.lit(1).alias("stage"), F.lit(0).alias("pos"))
    asked, known = mentions.select(F.col("mention").alias("text")).distinct(), names.select(F.col("name").alias("text")).distinct()
    within = lambda few, many: contains_pairs(few.select(F.col("text").alias("needle")), many.select(F.col("text").alias("hay_id"), F.col("text").alias("hay")))
    inside = within(asked, known).select(F.col("needle").alias("mention"), F.col("hay_id").alias("name"))
    around = within(known, asked).select(F.col("hay_id").alias("mention"), F.col("needle").alias("name"))
    led = _first_ids(inside.unionByName(around).distinct().join(names, "name").select("mention", "id"), "mention", cap)
    part = mentions.join(led, "mention").select("query_id", "id", F.lit(2).alias("stage"), "pos")
    first = written(_once(exact.unionByName(part)))
    words = questions.select("query_id", F.explode("keywords").alias("word")).join(_with_few(questions, first, enough), "query_id", "left_semi")
    parts = entities.select("id", F.explode(F.array_distinct(F.concat(F.split("name", ""), F.coalesce(F.split("description", r"\s+"), F.array().cast("array<string>"))))).alias("word")).where("word <> ''")
    said = _first_ids(parts.join(words.select("word").distinct(), "word", "left_semi").select("word", "id"), "word", cap)
    told = words.join(said, "word").select("query_id", "id", F.lit(3).alias("stage"), F.lit(0).alias("pos"))
    second = written(_once(first.unionByName(told)))
    rest = written(mentions.join(_with_few(questions, second, few), "query_id", "left_semi"))
    near = edit_matches(names.select("name"), rest.select(F.col("mention").alias("query"))).select(F.col("query").alias("mention"), "name")
    close = _first_ids(near.join(names, "name").select("mention", "id"), "mention", cap)
    typed = rest.join(close, "mention").select("query_id", "id", F.lit(4).alias("stage"), "pos")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("stage", "pos", "id"))
    return _once(second.unionByName(typed)).withColumn("place", place).where(F.col("place") <= most).select("query_id", "id", "stage", "place")


def _first_ids(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first `n` different ids of each key."""
    place = F.row_number().over(W.partitionBy(key).orderBy("id"))
    return rows.select(key, "id").distinct().withColumn("p", place).where(F.col("p") <= n).select(key, "id")


def _once(found: DataFrame) -> DataFrame:
    best = F.min(F.struct("stage", "pos"))
    return found.groupBy("query_id", "id").agg(best.alias("b")).select("query_id", "id", "b.stage", "b.pos")


def _with_few(questions: DataFrame, found: DataFrame, n: int) -> DataFrame:
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    return questions.select("query_id").join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < n).select("query_id")


def asked_once(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The targets (query_id, id) of the first of those questions that have just the same ones, and each question with that
    first one: (query_id, first). What depends on the targets alone is worked out once for all of them (`for_each`)."""
    sets = targets.groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    sets = sets.select("query_id", "ids", F.sha2(F.to_json("ids"), 256).alias("key"))  # to join by; the ids decide
    firsts = sets.groupBy("key", "ids").agg(F.min("query_id").alias("first"))
    like = written(sets.join(firsts, ["key", "ids"]).select("query_id", "first"))
    own = like.where("query_id = first").select("query_id")
    return written(targets.select("query_id", "id").join(own, "query_id", "left_semi")), like


def for_each(like: DataFrame, found: DataFrame) -> DataFrame:
    """What was found for the first of like questions, for each of them."""
    rest = [c for c in found.columns if c != "query_id"]
    return like.join(found.withColumnRenamed("query_id", "first"), "first").select("query_id", *rest)


def related_entities(targets: DataFrame, relationships: DataFrame, hops: int = 2, most: int = 20) -> DataFrame:
    """Entities within so many steps of a question's targets, the nearest first: (query_id, id, hop), `most` at most.
    Questions with the same targets are followed once."""
    targets, like = asked_once(targets)
    return for_each(like, reached(targets, relationships, hops, most))


def reached(targets: DataFrame, relationships: DataFrame, hops: int = 2, most: int = 20) -> DataFrame:
    """`related_entities` followed for each question by itself."""
    links = relationships.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("other"))
    links = links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    seen = targets.select("query_id", "id", F.lit(0).alias("hop"))
    largest = seen.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0  # one row
    # a question goes on while it has fewer than `most`, so that it has seen fewer than `largest` + `most` entities: of an
    # entity's links the first `most` beyond so many hold the first `most` new ones
    order = F.row_number().over(W.partitionBy("id").orderBy("other"))
    links = written(links.withColumn("link", order).where(F.col("link") <= largest + (2 * most if hops > 1 else most)))
    frontier = seen
    for hop in range(1, hops + 1):
        reach = links.where(F.col("link") <= largest + (most if hop == 1 else 2 * most))
        near = frontier.join(reach, "id").select("query_id", F.col("other").alias("id")).distinct()
        place = F.row_number().over(W.partitionBy("query_id").orderBy("id"))
        found = near.join(seen, ["query_id", "id"], "left_anti").withColumn("p", place).where(F.col("p") <= most)
        found = written(found.select("query_id", "id", F.lit(hop).alias("hop")))
        seen = seen.unionByName(found)
        full = seen.where("hop > 0").groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= most)
        frontier = found.join(full, "query_id", "left_anti")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("hop", "id"))
    return seen.where("hop > 0").withColumn("place", place).where(F.col("place") <= most).select("query_id", "id", "hop")


def retrieved_units(targets: DataFrame, relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """The units (`relevant_units`) of each question's targets and what is related to them, found once for questions with
    the same targets."""
    targets, like = asked_once(targets)
    related = written(reached(targets, relationships)).select("query_id", "id")
    return for_each(like, written(relevant_units(targets.unionByName(related), entities)))


def relevant_units(ids: DataFrame, entities: DataFrame, most: int = 20) -> DataFrame:
    """Text units by the share of a question's entities (query_id, id) that name them: (query_id, unit_id, score, place)."""
    total = ids.groupBy("query_id").agg(F.count("*").alias("total"))
    named = entities.select("id", F.explode(F.array_distinct("units")).alias("unit_id"))
    score = F.count("*") / F.first("total")
    found = ids.join(total, "query_id").join(named, "id").groupBy("query_id", "unit_id").agg(score.alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "unit_id"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def primary_entities(targets: DataFrame, entities: DataFrame, most: int = 3) -> DataFrame:
    """The targets in focus: longer names first, then longer descriptions, then by name."""
    rows = targets.select("query_id", "id").join(entities.select("id", "name", "type", "description"), "id")
    order = [F.desc(F.length("name")), F.desc(F.length(F.coalesce("description", F.lit("")))), F.asc("name"), F.asc("id")]
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= most)


def key_relationships(targets: DataFrame, relationships: DataFrame, most: int = 15) -> DataFrame:
    """Relationships that touch a question's target: (query_id, src, dst, description), `most` at most, by their ends."""
    rows = relationships.select("src", "dst", "description").distinct()
    # what comes after the first `most` of an end is behind them for every question
    first = lambda end: rows.withColumn("p", F.row_number().over(W.partitionBy(end).orderBy("src", "dst", "description"))).where(F.col("p") <= most).drop("p")
    a = targets.select("query_id", F.col("id").alias("src")).join(first("src"), "src")
    b = targets.select("query_id", F.col("id").alias("dst")).join(first("dst"), "dst").select(*a.columns)
    found = a.unionByName(b).distinct()
    place = F.row_number().over(W.partitionBy("query_id").orderBy("src", "dst", "description"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("query_id", "src", "dst", "description", "place")


def network(targets: DataFrame, related: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A question's nodes (query_id, id, is_target) and the relationships with both ends among them."""
    nodes = targets.select("query_id", "id", F.lit(True).alias("is_target")).unionByName(related.select("query_id", "id", F.lit(False).alias("is_target")))
    nodes = nodes.groupBy("query_id", "id").agg(F.max("is_target").alias("is_target"))
    from_ = nodes.select("query_id", F.col("id").alias("src"))
    edges = from_.join(relationships, "src").join(nodes.select("query_id", F.col("id").alias("dst")), ["query_id", "dst"]).select("query_id", "src", "dst", "description")
    return nodes, edges.distinct()


def evidence_texts(primary: DataFrame, retrieved: DataFrame, units: DataFrame, most: int = 15) -> DataFrame:
    """A question's retrieved units that contain the name of an entity in focus, in their order."""
    asked = retrieved.select("query_id", "unit_id", "place")
    texts = units.join(asked.select("unit_id").distinct(), "unit_id", "left_semi")
    named = primary.select("query_id", F.lower("name").alias("needle"))
    inside = contains_pairs(named.select("needle"), texts.select(F.col("unit_id").alias("hay_id"), F.lower("text").alias("hay")))
    hit = asked.join(inside.select("needle", F.col("hay_id").alias("unit_id")), "unit_id").join(named, ["query_id", "needle"]).select("query_id", "unit_id", "place").distinct()
    order = F.row_number().over(W.partitionBy("query_id").orderBy("place", "unit_id"))
    best = hit.withColumn("place", order).where(F.col("place") <= most)
    return best.join(units.select("unit_id", "text"), "unit_id").select("query_id", "unit_id", "place", "text")


def relationship_evidence(relationships: DataFrame, units: DataFrame, most: int = 10) -> DataFrame:
    """For each relationship (query_id, src, dst, description, place) the first unit that contains a word of its
    description: (query_id, place, unit_id), the first `most` relationships of a question."""
    words = relationships.select("query_id", "place", F.explode(F.array_distinct(F.split(F.lower("description"), r"\s+"))).alias("word")).where("word <> ''")
    pairs = contains_pairs(words.select(F.col("word").alias("needle")), units.select(F.col("unit_id").alias("hay_id"), F.lower("text").alias("hay")))
    first = pairs.groupBy(F.col("needle").alias("word")).agg(F.min("hay_id").alias("unit_id"))
    found = words.join(first, "word").groupBy("query_id", "place").agg(F.min("unit_id").alias("unit_id"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy("place"))
    return found.withColumn("n", order).where(F.col("n") <= most).select("query_id", "place", "unit_id")


def local_strategy(kind: Column, n_entities: Column) -> Column:
    return F.when(kind == "relation_search", "relationship").when(kind.isin("entity_search", "local_search"), "entity").when(n_entities >= 2, "relationship").otherwise("entity")


def global_strategy(kind: Column, n_entities: Column, default: str = "community") -> Column:
    return F.when(kind.isin("summary", "comparison") | ((kind == "global_search") & (n_entities > 3)), "hierarchical").when(kind == "global_search", "community").otherwise(default)


def local_search(questions: DataFrame, entities: DataFrame, relationships: DataFrame, units: DataFrame) -> DataFrame:
    """An answer's material and confidence for each question that names an entity: query_id, strategy, targets (names in
    focus), related, relationships, evidence (counts), sources, confidence."""
    targets = written(matched_entities(questions, entities))
    firsts, like = asked_once(targets)
    near = written(reached(firsts, relationships))
    related = for_each(like, near)
    retrieved = for_each(like, relevant_units(firsts.unionByName(near.select("query_id", "id")), entities))
    primary = primary_entities(targets, entities)
    evidence = written(evidence_texts(primary, retrieved, units))
    keys = key_relationships(targets, relationships)
    focus = primary.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "name", F.concat(F.lit("實體: "), "name", F.lit(" ("), "type", F.lit(")")).alias("source")))).alias("f"),
        F.avg(F.when(F.coalesce("description", F.lit("")) != "", 1.0).otherwise(0.7)).alias("quality"))
    cited = evidence.where("place <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("文本證據: "), F.substring("text", 1, 50), F.lit("...")).alias("source")))).alias("e"))
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    rows = questions.join(focus, "query_id").join(cited, "query_id", "left")
    for df, name in ((related, "related"), (keys, "relationships"), (evidence, "evidence")):
        rows = rows.join(count(df, name), "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    strategy = local_strategy(F.col("type"), F.size("entities"))
    by_entity = 0.5 * F.col("confidence") + 0.3 * F.col("quality") + F.least(F.col("relationships") / 10, F.lit(0.2))
    by_relation = 0.6 * F.col("confidence") + F.least(F.col("relationships") / 10, F.lit(0.4))
    sources = F.concat(F.transform("f", lambda x: x["source"]), F.coalesce(F.transform("e", lambda x: x["source"]), F.array().cast("array<string>")))
    return rows.select("query_id", strategy.alias("strategy"), F.array_join(F.transform("f", lambda x: x["name"]), ",").alias("targets"), "related", "relationships", "evidence", sources.alias("sources"), F.round(F.least(F.when(strategy == "entity", by_entity).otherwise(by_relation), F.lit(1.0)), 6).alias("confidence"))


def community_relevance(questions: DataFrame, communities: DataFrame, members: DataFrame, most: int = 5) -> DataFrame:
    """Communities that may be among the `most` best of a level for a question: (query_id, community, level, score).

    The score is .3 for each keyword in the summary, .4 for each entity that is a member, .1 times the level for global
    questions and summaries, and min(size / 10, .2), 1 at most. What no keyword or entity leads to differs between
    questions by the level only, so of those the `most` largest of each level are enough.
    """
    words = questions.select("query_id", F.explode(F.array_distinct("keywords")).alias("keyword")).withColumn("needle", F.lower("keyword"))
    inside = contains_pairs(words.select("needle"), communities.select(F.col("community").alias("hay_id"), F.lower("summary").alias("hay")))
    hits = words.join(inside.withColumnRenamed("hay_id", "community"), "needle").groupBy("query_id", "community").agg(F.count("*").alias("hits"))
    named = questions.select("query_id", F.explode(F.array_distinct("entities")).alias("name")).join(members.select("community", "name").distinct(), "name").groupBy("query_id", "community").agg(F.count("*").alias("overlap"))
    bonus = F.least(F.col("size") / 10, F.lit(0.2))
    largest = communities.withColumn("p", F.row_number().over(W.partitionBy("level").orderBy(bonus.desc(), "community"))).where(F.col("p") <= most)
    base = questions.select("query_id").crossJoin(F.broadcast(largest.select("community")))  # `most` rows a level
    pairs = base.unionByName(hits.select("query_id", "community")).unionByName(named.select("query_id", "community")).distinct()
    rows = pairs.join(hits, ["query_id", "community"], "left").join(named, ["query_id", "community"], "left").join(communities, "community").join(questions.select("query_id", "type"), "query_id")
    n = lambda c: F.coalesce(c, F.lit(0))
    level = F.when(F.col("type").isin("global_search", "summary"), F.col("level") * 0.1).otherwise(0.0)
    score = 0.3 * n("hits") + 0.4 * n("overlap") + level + F.when(F.col("size") > 0, bonus).otherwise(0.0)
    return rows.select("query_id", "community", "level", F.round(F.least(score, F.lit(1.0)), 9).alias("score"))


def global_search(questions: DataFrame, communities: DataFrame, members: DataFrame, most: int = 5, each: int = 3) -> DataFrame:
    """An answer's material and confidence for each question: query_id, strategy, communities (in order), sources,
    confidence. The hierarchical strategy takes the best of each level from the highest down, the other the best of all."""
    ranked = community_relevance(questions, communities, members, most).join(questions.select("query_id", global_strategy(F.col("type"), F.size("entities")).alias("strategy")), "query_id")
    within = F.row_number().over(W.partitionBy("query_id", "level").orderBy(F.desc("score"), "community"))
    overall = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "community"))
    kept = ranked.withColumn("a", within).withColumn("b", overall).where(((F.col("strategy") == "hierarchical") & (F.col("a") <= each)) | ((F.col("strategy") != "hierarchical") & (F.col("b") <= most)))
    kept = kept.join(communities.select("community", "title", "summary"), "community")
    hierarchical = F.col("strategy") == "hierarchical"
    order = F.struct(F.when(hierarchical, -F.col("level")).otherwise(0).alias("l"), F.when(hierarchical, F.col("a")).otherwise(F.col("b")).alias("p"), "community", "title", "summary", "level")
    lists = kept.groupBy("query_id", "strategy").agg(F.array_sort(F.collect_list(order)).alias("x"), F.count_distinct("level").alias("levels"), F.count("*").alias("n"), F.avg(F.when(F.coalesce("summary", F.lit("")) != "", 1.0).otherwise(0.5)).alias("quality"))
    told = F.transform("x", lambda c: F.array(F.concat(F.lit("社群: "), c["title"]), F.when(F.coalesce(c["summary"], F.lit("")) != "", F.concat(F.lit("摘要: "), F.substring(c["summary"], 1, 100), F.lit("...")))))
    by_level = F.transform("x", lambda c: F.concat(F.lit("層級 "), c["level"].cast("string"), F.lit(": "), c["title"]))
    rows = lists.join(questions.select("query_id", "confidence", F.size("entities").alias("n_entities")), "query_id")
    plain = 0.4 * F.col("confidence") + 0.3 * F.col("quality") + F.least(F.col("n_entities") / 5, F.lit(0.3))
    layered = 0.6 + 0.1 * F.col("levels") + 0.05 * F.col("n")
    return rows.select("query_id", "strategy", F.array_join(F.transform("x", lambda c: c["community"]), ",").alias("communities"), F.when(hierarchical, by_level).otherwise(F.array_compact(F.flatten(told))).alias("sources"), F.round(F.least(F.when(hierarchical, layered).otherwise(plain), F.lit(1.0)), 6).alias("confidence"))


def answered(questions: DataFrame, global_found: DataFrame, local_found: DataFrame) -> DataFrame:
    """One row for each question (with the column `search`: global, local or hybrid): query_id, search, confidence, sources
    (20 at most). A hybrid answer has both, .6 and .4 of their confidences, or the one that is there; what has neither
    falls back to confidence .1."""
    g = global_found.select("query_id", F.col("confidence").alias("gc"), F.col("sources").alias("gs"))
    l_ = local_found.select("query_id", F.col("confidence").alias("lc"), F.col("sources").alias("ls"))
    rows = questions.select("query_id", "search").join(g, "query_id", "left").join(l_, "query_id", "left")
    use_g, use_l = F.col("gc").isNotNull() & (F.col("search") != "local"), F.col("lc").isNotNull() & (F.col("search") != "global")
    none = F.array().cast("array<string>")
    sources = F.slice(F.concat(F.when(use_g, F.col("gs")).otherwise(none), F.when(use_l, F.col("ls")).otherwise(none)), 1, 20)
    confidence = F.when(use_g & use_l, 0.6 * F.col("gc") + 0.4 * F.col("lc")).when(use_g, F.col("gc")).when(use_l, F.col("lc")).otherwise(0.1)
    return rows.select("query_id", F.when(use_g | use_l, F.col("search")).otherwise("fallback").alias("search"), F.round(confidence, 6).alias("confidence"), sources.alias("sources"))


def batch_summary(answers: DataFrame) -> DataFrame:
    """Answers, mean confidence and mean sources of each search."""
    return answers.groupBy("search").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.size("sources")), 6).alias("sources"))


def entity_context(primary: DataFrame, relationships: DataFrame) -> DataFrame:
    """The text that an answer is asked with: numbered entities with their descriptions, then relationships."""
    lines = primary.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.col("place").cast("string"), F.lit(". "), "name", F.lit(" ("), "type", F.lit("): "), F.coalesce("description", F.lit("無描述"))).alias("line")))).alias("a"))
    told = relationships.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), "description").alias("line")))).alias("b"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    both = lines.join(told, "query_id", "left")
    return both.select("query_id", F.concat_ws("\n", F.lit("目標實體："), joined("a"), F.when(F.col("b").isNotNull(), F.concat(F.lit("關係：\n"), joined("b")))).alias("context"))


def query_context(analyzed: DataFrame) -> DataFrame:
    """How an analysed question (query_id, type, intent, n_entities, n_keywords, confidence) is best searched: method,
    entity_focus, reasoning, complexity, hints (joined)."""
    method = F.when(F.col("type").isin("global_search", "summary", "comparison"), "global_search").otherwise("local_search")
    low = F.col("confidence") < 0.6
    hints = F.concat_ws("|", F.when(low, "查詢可能需要更明確的表達"), F.when(low & (F.col("n_entities") == 0), "建議在查詢中包含具體的實體名稱"), F.when(low & (F.col("n_keywords") < 3), "建議添加更多關鍵詞來明確查詢意圖"),
                        F.when(F.col("type") == "global_search", "這是一個全域查詢，系統將基於整體知識圖譜回答").when(F.col("type") == "local_search", "這是一個本地查詢，系統將基於相關實體詳細回答"), F.when(F.col("n_entities") > 5, "查詢包含較多實體，可能需要分解為多個子查詢"))
    return analyzed.select("query_id", method.alias("method"), (F.col("n_entities") > 0).alias("entity_focus"), F.col("intent").isin("explanation", "problem_solving", "planning").alias("reasoning"), F.when(F.col("confidence") > 0.8, "high").otherwise("medium").alias("complexity"), hints.alias("hints"))
