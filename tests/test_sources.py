"""Sinks, encodings, collections and passages against hand-made cases."""

import datetime as dt

from pyspark.sql import functions as F

from quarryline.operators import consistency as C
from quarryline.operators import passages as P
from quarryline.operators import text as T
from quarryline.sources import files, sinks
from quarryline.sources.collections import Collections


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def brute_windows(text, size, overlap):
    chunks, start = [], 0
    while start < len(text):
        end, chunk = start + size, text[start : start + size]
        if end < len(text):
            stop = chunk.rfind("。")
            if stop > size // 2:
                chunk, end = chunk[: stop + 1], start + stop + 1
        if chunk.strip():
            chunks.append(chunk.strip())
        start = max(start + 1, end - overlap)
    return chunks


def test_window_chunks(spark):
    texts = ["", "短", "一二三。" * 30, "字" * 95, "  \n ", "句子很長沒有停頓" * 10 + "。尾巴", "a。b" * 40, "。" * 50]
    for size, overlap in ((20, 5), (30, 0), (10, 9), (50, 20)):
        rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", P.window_chunks(F.col("t"), size, overlap).alias("x")).orderBy("id").collect()
        assert [r.x for r in rows] == [brute_windows(t, size, overlap) for t in texts]
    assert one(spark, P.window_chunks(F.col("t")), t=None) == []


def test_sentence_chunks_overlap(spark):
    text = "一二三四。五六七八。九十一二。三四五六。"
    assert one(spark, P.sentence_chunks(F.col("t"), 8, 0), t=text) == ["一二三四 五六七八", "九十一二 三四五六"]
    assert one(spark, P.sentence_chunks(F.col("t"), 8, 3), t=text) == ["一二三四 五六七八", "六七八 九十一二", "十一二 三四五六"]
    assert one(spark, P.sentence_chunks(F.col("t"), 8, 3), t="") == []


def test_names_and_entities(spark):
    assert set(one(spark, P.chinese_names(F.col("t")), t="張小明叫李四，王先生")) >= {"張小明", "李四"}
    assert one(spark, P.chinese_names(F.col("t")), t="小明姓什麼")[0] == "小明"
    found = one(spark, P.question_entities(F.col("t")), t="微軟公司 和 張三 的 Azure 平台")
    assert "微軟公司" in found and "Azure" in found and len(found) <= 15
    spans = P.pattern_spans(spark.createDataFrame([(1, "打 13912345678 或 a@b.com")], "id int, t string"), "id", "t")
    assert {(r.match, r.start, r.end) for r in spans.where("kind = 'email'").collect()} == {("a@b.com", 16, 23)}
    got = P.entity_candidates(spark.createDataFrame([(1, "a@bc.com")], "id int, t string"), "id", "t").collect()
    assert {(r.match, r.type, r.confidence) for r in got} >= {("a@bc.com", "email", 0.9), ("bc", "eng", 0.8)}


def test_page_text(spark):
    assert one(spark, P.cleaned_pdf(F.col("t")), t="中 文 字 。 第 3 頁 Page 4 好 Copyright 2020 rest") == "中文字。  好"
    assert one(spark, P.is_page_furniture(F.col("t")), t="第 12 頁") and not one(spark, P.is_page_furniture(F.col("t")), t="a longer paragraph that has more than thirty characters in it")
    assert one(spark, P.parsed_segmentation(F.col("t")), t="# x\n輸出：\n我 愛 你") == ["我", "愛", "你"]
    assert one(spark, P.duration(F.lit(3725.0)), t="") == "1h 2m" and one(spark, P.duration(F.lit(75.5)), t="") == "1m 15.5s"
    assert one(spark, C.is_iso_time(F.col("t")), t="2024-02-30") is False and one(spark, C.is_iso_time(F.col("t")), t="2024-02-29T10:00:00+08:00")
    assert C.merge_settings({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}


def test_quality_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "一些文字。"), (1, "more words here"), (None, "x"), (2, None)], "id int, t string")
    assert sorted(str(r.id) for r in T.quality(docs, "id", "t").collect()) == ["1", "1", "2", "None"]


def test_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("你好", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("你好嗎".encode("gbk"))
    (tmp_path / "c.bin").write_bytes(b"x")
    every = files.scan_files(spark, str(tmp_path), ("txt", "bin"))
    found = {r.name: r.e for r in every.select("name", files.detected_encoding(F.col("content")).alias("e")).collect()}
    assert found == {"a.txt": "utf-8", "b.txt": "gbk", "c.bin": "utf-8"}
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in files.validated_files(every, 6).collect()}
    assert reasons == {"a.txt": None, "b.txt": None, "c.bin": "suffix"}
    assert [r.name for r in files.sorted_listing(every).collect()] == ["a.txt", "b.txt", "c.bin"]
    r = files.read_documents(spark, str(tmp_path), language="zh").where("title = 'a'").first()
    assert r.language == "zh" and r.metadata["file_name"] == "a.txt"


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "T", "text", {"k": "v"})], "id string, title string, text string, metadata map<string,string>")
    ents = spark.createDataFrame([("e1", "A", "about a"), ("e2", "B", "")], "id string, name string, description string")
    rels = spark.createDataFrame([("r1", "e1", "e2", "a to b")], "id string, src string, dst string, description string")
    tables = {"documents": docs, "entities": ents, "relationships": rels, "communities": ents}
    sinks.save_index(tables, str(tmp_path / "index"))
    back = sinks.load_index(spark, str(tmp_path / "index"), {n: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema) for n, t in tables.items()})
    assert all(sorted(map(str, back[n].collect())) == sorted(map(str, t.collect())) for n, t in tables.items())
    assert {(r.unit_id, r.text) for r in sinks.virtual_units(docs, ents, rels).collect()} == {("document_d1", "text"), ("entity_e1", "A: about a"), ("entity_e2", "B"), ("relationship_r1", "a to b")}
    assert spark.read.parquet(sinks.documents_to_parquet(docs, str(tmp_path))).first().title == "T"


def test_results_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "line one\nline two", 0.5, "local", 1.0)], "query string, answer string, confidence double, search_type string, search_time double")
    for form in ("json", "csv", "markdown", "txt"):
        sinks.save_results(rows, str(tmp_path / form), form)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().answer == "line one line two"
    assert "## q1" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "markdown")).collect())
    sinks.export_records(rows.select("query", F.struct("confidence").alias("s")), str(tmp_path / "x"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).first().s == '{"confidence":0.5}'
    changes = spark.createDataFrame([(1, 5, False), (2, 3, False), (3, 1, True)], "change_id int, at long, processed boolean")
    assert [r.change_id for r in sinks.pending(changes, 1).collect()] == [2]


def test_collection_store_and_restore(spark, tmp_path):
    store = Collections(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", [1.0, 2.0], "x"), ("b", None, "y")], "id string, embedding array<double>, name string")
    assert store.store("entities", rows) == 1 and store.exists("entities") and store.schema("entities") == {"name": "string"}
    store.backup("entities", str(tmp_path / "copy"))
    store.delete("entities", spark.createDataFrame([("a",)], "id string"))
    assert store.restore("entities", str(tmp_path / "copy")) == 1
    assert tuple(store.statistics().first()) == (1, 1, [2])
    assert tuple(Collections(spark, str(tmp_path / "none")).statistics().first()) == (0, 0, [])


def test_down_sampled_keys(spark):
    from quarryline.operators import metrics as M

    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=s), k) for i, (k, s) in enumerate([("a", 0), ("a", 5), ("a", 10), ("b", 3), ("b", 4), ("a", 21), (None, 1), (None, 2)])]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, k string")
    assert sorted(r.event_id for r in M.down_sampled(e, "k", 10).collect()) == [0, 2, 3, 5, 6]


def test_batch_search_as_brute_force(spark):
    import random

    from quarryline.operators import vectors as V

    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [1.0, None, 2.0, 0.0]), (902, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in V.batch_search(v, v.where("vec_id % 30 = 0").withColumnRenamed("vec_id", "query_id"), 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.distance))
    good = [(i, x) for i, x in rows if x and len(x) == 4 and None not in x]
    assert set(got) == {i for i, _ in good if i % 30 == 0}
    for q, found in got.items():
        far = sorted((sum((a - b) ** 2 for a, b in zip(x, dict(good)[q], strict=True)), i) for i, x in good)[:7]
        assert sorted(found) == [(k + 1, i, d) for k, (d, i) in enumerate(far)]


def test_polled_changes(spark):
    from quarryline.streaming import rollups

    old = spark.createDataFrame([("a", "1", 1)], "path string, hash string, size int")
    changes, state = rollups.polled_changes(old, spark.createDataFrame([("b", "2", 1)], "path string, hash string, size int"))
    assert {r.change for r in changes.collect()} == {"added", "deleted"} and state.count() == 1


def test_questions_file_and_keys(spark, tmp_path):
    from quarryline.operators import questions as Q

    (tmp_path / "q.txt").write_text("what?\n\n  why? \n")
    assert [r.question for r in files.read_questions(spark, str(tmp_path / "q.txt")).collect()] == ["what?", "why?"]
    (tmp_path / "m.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert [r.a for r in files.read_records(spark, str(tmp_path / "m.jsonl"), "a int").collect()] == [1, 2]
    key = one(spark, Q.composite_key(F.col("t"), F.lit("k"), F.lit("i"), F.array(F.lit("b"), F.lit("a")), F.array(F.lit("z"))), t=" Q ")
    assert key == "q|k|i|a_b|z"
