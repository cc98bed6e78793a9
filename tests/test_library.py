"""Operators against hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarryline.operators import consistency as C
from quarryline.operators import graph as G
from quarryline.operators import metrics as M
from quarryline.operators import questions as Q
from quarryline.operators import text as T
from quarryline.operators import vectors as V
from quarryline.sources import files
from quarryline.sources.collections import Collections
from quarryline.streaming import rollups


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "clean"),
    [("", ""), (None, ""), ("  你好\n\n世界  ", "你好 世界"), ("你好，，，世界！！", "你好，世界"), ("a@b.c 100%", "abc 100"), ("。。。", ""), ("中　文", "中 文")],
)
def test_clean(spark, text, clean):
    assert one(spark, T.clean(F.col("t")), t=text) == clean


def test_sentences_and_chunks(spark):
    assert one(spark, T.sentences(F.col("t")), t="第一句。第二句！a。\n最後 ") == ["第一句", "第二句", "最後"]
    assert one(spark, T.sentence_chunks(F.col("t"), 10), t="一二三四。五六七八。九十一二。" + "長" * 12 + "。尾巴") == ["一二三四 五六七八", "九十一二", "長" * 12, "尾巴"]
    assert one(spark, T.sentence_chunks(F.col("t"), 10), t="") == []


def test_statistics_of_chinese(spark):
    docs = spark.createDataFrame([(1, "這是測試。Hello world！\n\n第二段"), (2, ""), (3, None)], "id int, t string")
    a, b, c = T.statistics(docs, "id", "t").orderBy("id").collect()
    assert (a.char_count, a.word_count, a.sentence_count, a.paragraph_count, a.chinese_char_count, a.english_word_count, a.punctuation_count) == (22, 9, 3, 2, 7, 2, 2)
    assert b[1:] == c[1:] and b.char_count == 0
    assert {r.quality_level for r in T.quality(docs, "id", "t").collect()} <= {"excellent", "good", "fair", "poor"}


def test_patterns(spark):
    docs = spark.createDataFrame([(1, "2024年1月5日 上午 13:45 打 13912345678 或 a@b.com，100元 50% www.x.tw")], "id int, t string")
    r = T.pattern_counts(docs, "id", "t").first()
    assert (r.date, r.phone, r.email, r.percent, r.url) == (2, 1, 1, 1, 1) and r.time == 2


@pytest.mark.parametrize(("question", "kind", "search"), [("總結主要內容", "summary", "global"), ("微軟公司是什麼", "entity_search", "hybrid"), ("abc", "global_search", "global")])
def test_questions(spark, question, kind, search):
    r = Q.analyzed(spark.createDataFrame([(1, question)], "id int, t string"), "id", "t").first()
    assert r.type == kind and r.search in (search, "hybrid")


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("a", "b"), ("a", "ghost"), ("q", "q")], "src string, dst string")
    nodes = spark.createDataFrame([(n, "t") for n in "abcxyzq"], "node string, type string")
    labels = {r.node: r.component for r in G.components(nodes, edges).collect()}
    assert labels == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z", "q": "q"}
    assert [(r.component, r["size"]) for r in G.communities(G.components(nodes, edges)).collect()] == [("a", 3)]
    assert {(r.node, r.hop) for r in G.k_hop(spark.createDataFrame([("x",)], "node string"), edges, 2).collect()} == {("x", 0), ("y", 1)}
    assert {(r.src, r.dst) for r in G.dangling_edges(edges, nodes).collect()} == {("a", "ghost")}
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(200)], "src string, dst string")
    ends = spark.createDataFrame([(f"n{i:03}", "t") for i in range(201)], "node string, type string")
    assert G.components(ends, chain).select("component").distinct().count() == 1


def events(spark, rows):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), 1, k, float(v)) for i, (m, k, v) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, value double")


def test_metrics(spark):
    e = events(spark, [(i, "a", i) for i in range(10)])
    assert M.trend(e, "event_type").first().trend == "rising"
    assert M.trend(e.limit(3), "event_type").first().trend == "unknown"
    t = M.timer_stats(e, "event_type").first()
    assert (t.p50, t.p95, t.p99) == (5.0, 9.0, 9.0)
    q = M.exclusive_quantiles(e, "event_type", {"m": 0.5}).first()
    assert q.m == 4.5
    kept = sorted(r.event_id for r in M.down_sampled(e, "user_id", 240).collect())
    assert kept == [0, 4, 8]
    assert abs(M.smoothed(e, "user_id").first().smoothed - 4.5) < 1e-9


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(6)], "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in V.dense_search(v, [2.0, 1.0], 3).collect()] == [2, 1, 3]
    q = v.where("vec_id = 5").withColumnRenamed("vec_id", "query_id")
    assert [r.vec_id for r in V.batch_search(v, q, 2).orderBy("rank").collect()] == [5, 4]
    assert V.batch_search(v, q.limit(0), 2).count() == 0


def test_consistency(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1)], "path string, hash string, size int")
    new = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("d", "1", 1)], "path string, hash string, size int")
    assert {(r.path, r.change) for r in C.snapshot_changes(old, new).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}


def test_edit_matches_as_brute_force(spark):
    names, queries = ["anna", "anne", "bob", "boob", "x", "annabel"], ["ana", "bb", "anna", "q", "annebel"]
    found = T.edit_matches(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in queries], "query string"))
    pairs = spark.createDataFrame([(q, n) for q in queries for n in names], "query string, name string").withColumn("d", F.levenshtein("query", "name"))
    want = {(r["query"], r["name"]) for r in pairs.collect() if r["d"] <= min(2, len(r["query"]) // 2)}
    assert {(r["query"], r["name"]) for r in found.collect()} == want


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("你好", encoding="utf-8")
    (tmp_path / "sub/b.md").write_text("<p>x</p>\n\n\ny", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes("你好嗎".encode("gbk"))
    (tmp_path / "d.bin").write_bytes(b"1")
    (tmp_path / "e.txt").write_text(" \n")
    found = {r.title: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert found == {"a": ("你好", None), "b": ("x\n\ny", None), "c": ("你好嗎", None), "e": (None, "empty")}
    answers = spark.createDataFrame([(1, '```json\n{"entities": [{"name": "A", "type": "org"}], "relationships": [{"source": "A", "target": "B"}]}\n```'), (2, "no json")], "id int, t string")
    ents, rels = files.parsed_graph(answers, "id", "t")
    assert [(r["name"], r["type"]) for r in ents.collect()] == [("A", "ORG")] and rels.count() == 1


def test_collections(spark, tmp_path):
    store = Collections(spark, str(tmp_path / "store"))
    assert store.create("v", "label string") and not store.create("v") and store.names() == ["v"]
    rows = spark.createDataFrame([("a", [1.0, 2.0], "x"), ("b", [3.0, 4.0], "y"), ("", [0.0, 0.0], "z")], "id string, vector array<double>, label string")
    store.insert("v", rows)
    assert tuple(store.describe("v").first()) == (2, 2)
    store.upsert("v", spark.createDataFrame([("b", [5.0, 6.0], "new")], "id string, vector array<double>, label string"))
    assert store.get("v", "b").first().label == "new" and store.read("v").count() == 2
    store.delete("v", spark.createDataFrame([("a",)], "id string"))
    assert store.backup("v", str(tmp_path / "copy")) == 1
    assert store.drop("v") and store.names() == []


def test_stream(spark, tmp_path):
    e = events(spark, [(0, "a", 1), (30, "a", 2), (61, "b", 3), (600, "a", 4)])
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    query = rollups.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.event_type, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
