"""Entity graphs: edges, components, neighbourhoods, communities and their reports.

Edges are (src, dst) with any number of further columns; nodes are strings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def written(df: DataFrame) -> DataFrame:
    """The table written to the session's checkpoint folder and read back, so that a loop's plan stays short."""
    spark = df.sparkSession
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:  # a session that names no folder gets one beside its tables
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
        top = sc.getCheckpointDir()
    path = f"{top}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    pairs = edges.select("src", "dst").where("src <> dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are known nodes."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no known node."""
    ids = nodes.select("node").distinct()
    lost = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst")
    return lost.unionByName(edges.join(ids.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")).distinct()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """The smallest node that each node reaches: (node, component). In a round each node that is left hangs on the smallest
    of itself and its neighbours, each tree becomes its root, and the edges become those between roots: those within a tree
    go. Of two neighbours one is no root, so at least half the nodes that have edges go, and the smallest always stays."""
    left = written(known_edges(edges, nodes).select("src", "dst").where("src <> dst"))
    labels = nodes.select("node", F.col("node").alias("component")).distinct()
    for _ in range(most_rounds):
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = written(both.groupBy(F.col("src").alias("at")).agg(F.min("dst").alias("near")).select("at", F.least("at", "near").alias("root")))
        if roots.isEmpty():
            return written(labels)
        roots = _to_the_top(roots, most_rounds)
        labels = written(labels.join(roots, F.col("component") == F.col("at"), "left").select("node", F.coalesce("root", "component").alias("component")))
        a, b = roots.select(F.col("at").alias("src"), F.col("root").alias("a")), roots.select(F.col("at").alias("dst"), F.col("root").alias("b"))
        left = written(left.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    raise RuntimeError("the components did not settle")


def _to_the_top(roots: DataFrame, most_rounds: int) -> DataFrame:
    """(at, root) with the root of each root taken on until none changes: the rounds grow with the logarithm of the depth."""
    for _ in range(most_rounds):
        up = roots.select(F.col("at").alias("root"), F.col("root").alias("above"))
        jumped = written(roots.join(up, "root").select("at", "root", "above"))
        settled = jumped.where("root <> above").isEmpty()
        roots = jumped.select("at", F.col("above").alias("root"))
        if settled:
            return roots
    raise RuntimeError("the trees did not settle")


def communities(labels: DataFrame, least: int = 3, most: int = 1 << 40) -> DataFrame:
    """Components of an admissible size with their rank, the share of all nodes."""
    total = labels.agg(F.count("*").alias("total"))
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size").between(least, most))
    return sizes.crossJoin(F.broadcast(total)).select("component", "size", F.round(F.col("size") / F.col("total"), 6).alias("rank"))  # total is one row


def inner_edges(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges within one component: (component, src, dst)."""
    a, b = labels.select(F.col("node").alias("src"), F.col("component")), labels.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").where("component = other").select("component", "src", "dst")


def k_hop(start: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within so many steps of a start node: (node, hop), the start at 0."""
    links = both_ways(edges)
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        frontier = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def incident_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch one of the nodes."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")).distinct()


def resolved(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges between names as edges between ids, both names looked up within the batch; of entities of one name the last
    counts. mentions are (batch, source, target), entities (batch, name, id, ord)."""
    ids = entities.groupBy("batch", "name").agg(F.max_by("id", "ord").alias("id"))
    left = ids.select("batch", F.col("name").alias("source"), F.col("id").alias("src"))
    right = ids.select("batch", F.col("name").alias("target"), F.col("id").alias("dst"))
    return mentions.join(left, ["batch", "source"]).join(right, ["batch", "target"]).select("batch", "src", "dst")


def type_counts(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    return labels.join(nodes, "node").groupBy("component", F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def titles(counts: DataFrame) -> DataFrame:
    """The most common type of each component; ties to the first name."""
    return counts.groupBy("component").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("title"))


def reports(labels: DataFrame, nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """One row for each community: size, edges, types, first names, and importance
    .3 min(nodes / 20, 1) + .3 min(edges / 30, 1) + .2 min(types / 5, 1) + .2 rank."""
    found = communities(labels, least)
    inner = inner_edges(labels, edges).groupBy("component").agg(F.count("*").alias("edges"))
    counts = type_counts(labels, nodes)
    types = counts.groupBy("component").agg(F.count("*").alias("types"))
    # the first five names by rank in the group, not a list of all
    first = labels.withColumn("place", F.row_number().over(W.partitionBy("component").orderBy("node"))).where("place <= 5")
    names = first.groupBy("component").agg(F.array_join(F.sort_array(F.collect_list("node")), ",").alias("names"))
    rows = found.join(inner, "component", "left").join(types, "component").join(titles(counts), "component").join(names, "component")
    least_ = lambda x, n: F.least(F.coalesce(x, F.lit(0)) / n, F.lit(1.0))
    score = 0.3 * least_(F.col("size"), 20) + 0.3 * least_(F.col("edges"), 30) + 0.2 * least_(F.col("types"), 5) + 0.2 * F.col("rank")
    return rows.select("component", "size", F.coalesce("edges", F.lit(0)).alias("edges"), "types", "title", "names", F.round(score, 4).alias("importance"))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def relevance(found: DataFrame, keywords: list[str], text: Column, size: Column) -> DataFrame:
    """Communities by .3 for each keyword in their text plus min(size / 10, .2), 1 at most."""
    score = F.least(size / 10, F.lit(0.2))
    for word in keywords:
        score = score + F.contains(F.lower(text), F.lit(word)).cast("int") * 0.3
    return found.withColumn("relevance", F.round(F.least(score, F.lit(1.0)), 6))


def _first_of(rows: DataFrame, value: str, order: list, n: int, name: str) -> DataFrame:
    """The first `n` values of each community, as an array in order; no group is collected whole."""
    place = F.row_number().over(W.partitionBy("community").orderBy(*order))
    first = rows.withColumn("__p", place).where(F.col("__p") <= n)
    return first.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", value))), lambda x: x[value]).alias(name))


def summaries(members: DataFrame, relations: DataFrame) -> DataFrame:
    """A sentence or two on each community: its first five names and its first three relationships, with their numbers.
    members are (community, name, ord), relations (community, description, ord)."""
    names = _first_of(members, "name", ["ord"], 5, "names").join(members.groupBy("community").agg(F.count("*").alias("n")), "community")
    told = _first_of(relations, "description", ["ord"], 3, "told").join(relations.groupBy("community").agg(F.count("*").alias("m")), "community")
    n, m = F.col("n").cast("string"), F.col("m").cast("string")
    who = F.concat(F.lit("這個社群包含 "), n, F.lit(" 個實體："), F.array_join("names", ", "), F.when(F.col("n") > 5, F.concat(F.lit(" 等 "), n, F.lit(" 個實體"))).otherwise(""))
    what = F.concat(F.lit("主要關係包括："), F.array_join("told", "; "), F.when(F.col("m") > 3, F.concat(F.lit(" 等 "), m, F.lit(" 個關係"))).otherwise(""))
    rows = names.join(told, "community", "full_outer")
    return rows.select("community", F.concat(F.concat_ws("。", who, what), F.lit("。")).alias("summary"))


def detailed_summaries(communities: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    """The longer text of a report: title, numbers, the five highest ranked names, types by number, three relationships.
    communities are (community, title), members (community, name, type, rank, ord)."""
    types = members.groupBy("community", F.coalesce("type", F.lit("未知")).alias("type")).agg(F.count("*").alias("n"))
    told_types = types.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "type"))), lambda x: F.concat((-x["o"]).cast("string"), F.lit("個"), x["type"])), ", ").alias("types"), F.sum("n").alias("n"))
    top = _first_of(members, "name", [F.desc("rank"), F.asc("ord")], 5, "names")
    first = _first_of(relations, "description", ["ord"], 3, "told")
    m = relations.groupBy("community").agg(F.count("*").alias("m"))
    rows = communities.join(told_types, "community", "left").join(top, "community", "left").join(first, "community", "left").join(m, "community", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    text = F.concat_ws(
        "。",
        F.concat(F.lit("這是一個名為「"), "title", F.lit("」的社群")),
        F.concat(F.lit("包含 "), count("n"), F.lit(" 個實體和 "), count("m"), F.lit(" 個關係")),
        F.concat(F.lit("主要實體包括："), F.array_join("names", ", ")),
        F.concat(F.lit("實體類型分佈："), F.col("types")),
        F.concat(F.lit("主要關係："), F.array_join("told", "; ")),
    )
    return rows.select("community", F.concat(text, F.lit("。")).alias("summary"))


def community_keywords(members: DataFrame, relations: DataFrame, most: int = 20) -> DataFrame:
    """Names of members and words of more than two characters of relationships: the first `most` by alphabet."""
    words = relations.select("community", F.explode(F.split("description", r"\s+")).alias("keyword")).where(F.length("keyword") > 2)
    every = members.select("community", F.col("name").alias("keyword")).where("keyword <> ''").unionByName(words).distinct()
    place = F.row_number().over(W.partitionBy("community").orderBy("keyword"))
    return every.withColumn("place", place).where(F.col("place") <= most).select("community", "keyword", "place")


def relation_type_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy("community", F.coalesce("type", F.lit("未知")).alias("type")).agg(F.count("*").alias("n"))


def looked_up(communities: DataFrame, ids: str, table: DataFrame, key: str) -> DataFrame:
    """The rows of `table` that the communities' arrays of ids name, in the array's order; unknown ids are dropped."""
    named = communities.select("community", F.posexplode(ids).alias("pos", key))
    return named.join(table, key)


def first_seen_units(entities: DataFrame, units: DataFrame) -> DataFrame:
    """Distinct known units of each community's entities (community, ord, units array), in the order in which the entities
    name them: (community, unit_id, place)."""
    named = entities.select("community", "ord", F.posexplode("units").alias("pos", "unit_id")).join(units.select("unit_id").distinct(), "unit_id")
    first = named.groupBy("community", "unit_id").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return first.select("community", "unit_id", F.row_number().over(W.partitionBy("community").orderBy("at", "unit_id")).alias("place"))


def with_reports(communities: DataFrame, found: DataFrame) -> DataFrame:
    """Communities with what their report says, or the defaults if there is none."""
    rows = communities.join(found.select("community", "title", "summary", "rank"), "community", "left")
    return rows.select(*communities.columns, F.coalesce("title", F.concat(F.lit("社群 "), "community")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("rank", F.lit(0.0)).alias("rank"))


def sized(communities: DataFrame, children: DataFrame) -> DataFrame:
    """Communities (community, parent, n_entities, n_relationships) with size, is_root and is_leaf."""
    parents = children.where("parent IS NOT NULL").select(F.col("parent").alias("community")).distinct().withColumn("__p", F.lit(True))
    rows = communities.join(parents, "community", "left")
    return rows.select("community", (F.col("n_entities") + F.col("n_relationships")).alias("size"), F.col("parent").isNull().alias("is_root"), F.col("__p").isNull().alias("is_leaf"))


def size_statistics(communities: DataFrame) -> DataFrame:
    """Number of communities and mean, largest and smallest size, over all and by level (null: all)."""
    return communities.groupingSets([[], [F.col("level")]], F.col("level")).agg(F.count("*").alias("n"), F.round(F.avg("size"), 6).alias("mean"), F.max("size").alias("most"), F.min("size").alias("least"))


def converted_entities(rows: DataFrame) -> DataFrame:
    """Entities of another workflow's output (title or name, type, description, degree) in this library's columns."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    name = F.trim(F.coalesce(has("title").cast("string"), has("name").cast("string"), F.lit("")))
    return rows.select(F.coalesce(has("id").cast("string"), F.md5(name)).alias("id"), name.alias("name"), F.upper(F.coalesce(has("type").cast("string"), F.lit("unknown"))).alias("type"), F.coalesce(has("description").cast("string"), F.lit("")).alias("description"), F.coalesce(has("degree").cast("double"), F.lit(0.0)).alias("rank"))


def directed_pairs(relationships: DataFrame) -> DataFrame:
    """(src, dst) of relationships (src, dst, bidirectional), both ways round where they hold both ways."""
    back = relationships.where("bidirectional").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return relationships.select("src", "dst").unionByName(back)


def full_reports(communities: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    """One nested row for each community (community, title, rank): counts, types of entities and relationships as maps,
    keywords, importance and the detailed summary."""
    types = lambda df, name: df.groupBy("community", F.coalesce("type", F.lit("未知")).alias("type")).agg(F.count("*").alias("n")).groupBy("community").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias(name), F.sum("n").alias("n_" + name))
    words = community_keywords(members, relations).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    rows = communities.join(types(members, "entity_types"), "community", "left").join(types(relations, "relationship_types"), "community", "left").join(words, "community", "left")
    rows = rows.join(detailed_summaries(communities.select("community", "title"), members, relations), "community", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    part = lambda x, most: F.least(x / most, F.lit(1.0))
    importance = 0.3 * part(n("n_entity_types"), 20) + 0.3 * part(n("n_relationship_types"), 30) + 0.2 * part(F.coalesce(F.size("entity_types"), F.lit(0)), 5) + 0.2 * F.col("rank")
    return rows.select("community", "title", n("n_entity_types").alias("entities"), n("n_relationship_types").alias("relationships"), "entity_types", "relationship_types", "keywords", F.round(importance, 3).alias("importance"), "summary")


def extraction_prompts(units: DataFrame, size: int = 10) -> DataFrame:
    """What a model is asked to extract entities from: the units (document_id, chunk_index, unit_id, text) of a document, ten
    to a batch, each under its id: (document_id, batch, unit_ids, prompt)."""
    batch = F.floor(F.col("chunk_index") / size).cast("int")
    rows = units.groupBy("document_id", batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "unit_id", "text"))).alias("u"))
    told = F.transform("u", lambda x: F.concat(F.lit("["), x["unit_id"], F.lit("]\n"), x["text"]))
    return rows.select("document_id", "batch", F.transform("u", lambda x: x["unit_id"]).alias("unit_ids"), F.array_join(told, "\n\n").alias("prompt"))
