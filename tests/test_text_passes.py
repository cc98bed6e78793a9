"""Texts are measured, cut and searched in one pass in the tasks, as the expressions over columns did."""

import random

from pyspark.sql import functions as F
from quarryline.operators import embeddings as E
from quarryline.operators import passages as P
from quarryline.operators import text as T

ODD = [None, "\uf900\ufa00", "", " ", "。", "a", "12", "-12-", "[ 3 ]", "Page 7 of", "pAgE 7", "1/2", "copyright © 2020 x\ny", "x confidential y", "copy- 1 -right 2020 gone", "第 3 頁", "2020-01-02", "2020年1月2日", "1-2-2020", "天 地　人 3 月 4", "ä ö\x85ü\x1c\x1d", "a@b.cc 13812345678 0123-1234567", "10:20:30 5% 百分之3 $4.5 ￥6 7萬元 8元", "版權所有 2020", "「 天 」 ，", "the THE The x y 天", "😀 é ñ ß ﬁ ① ½ 豈"]
ALPHABET = "ab Z09 -/.@%:[]()\n\t\r\x0b\x1c\x85\xa0 　。，！？天地月年點豈－—·é😀'\"|_©"


def frame(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices(ALPHABET, k=rng.randint(1, 120))) for _ in range(300)] + ["".join(rng.choices("ab .\n9", k=700)).replace(".", "。") for _ in range(20)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), texts


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_cleaned_and_cut(spark):
    docs, texts = frame(spark)
    assert pairs(docs.select("doc_id", T.clean(F.col("text")))) == {k: T.cleaned(t) for k, t in enumerate(texts)}
    whole = T.clean(F.col("text"))
    assert pairs(docs.select("doc_id", T.sentences(whole))) == {k: T.cut_sentences(T.cleaned(t)) for k, t in enumerate(texts)}
    kept = F.filter(T.words(whole), lambda w: ~F.lower(w).isin(T.STOP_WORDS) & ((F.length(w) > 1) | w.rlike(f"[{T.CJK}]")))
    assert pairs(docs.select("doc_id", P.segments(F.col("text")))) == pairs(docs.select("doc_id", kept))


def test_counts(spark):
    docs, texts = frame(spark)
    t = F.coalesce("text", F.lit(""))
    n = lambda p: F.regexp_count(t, F.lit(p))
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    links = sum((F.contains(t, F.lit(w)).cast("int") for w in T.COHERENCE_WORDS), F.lit(0))
    special = n(f"[^{T.KEPT}]")
    want = docs.select("doc_id", F.array(F.length(t), F.size(T.words(t)), F.size(T.sentences(t)), lines, n(f"[{T.CJK}]"), n("[a-zA-Z]+"), n(T.CHINESE_PUNCTUATION), F.size(F.array_distinct(T.words(t))), special, links))
    assert pairs(want) == {k: list(T.count_text(t)) for k, t in enumerate(texts)}
    plan = T.quality(docs, "doc_id", "text")._jdf.queryExecution().toString()
    assert "regexp" not in plan


def test_pdf(spark):
    docs, _ = frame(spark)
    c = T.CJK
    out = F.regexp_replace("text", r"(?U)\s+", " ")
    steps = [(f"([{c}])\\s+(?=[{c}])", "$1"), (r"\s+([，。！？；：])", "$1"), (r"([「『（【《〈])\s+", "$1"), (f"(\\d)\\s+([{c}])", "$1$2"), (f"([{c}])\\s+(\\d)", "$1$2"), (" +", " ")]
    for pattern, new in steps + [(p, "") for p in P.PAGE_MARKS + P.CLOSING_MARKS] + [(r"[^\p{L}\p{N}_\s，。！？；：「」『』（）【】《》〈〉—–…－(),.!?;:\"']", "")]:
        out = F.regexp_replace(out, pattern, new)
    assert pairs(docs.select("doc_id", P.cleaned_pdf(F.col("text")))) == pairs(docs.select("doc_id", P.stripped(out)))


def test_candidates(spark):
    """Rows that share an id or have none count a place once, others are settled in their task without a shuffle."""
    docs, texts = frame(spark)
    many = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id % 50 = 1").withColumn("doc_id", F.lit(None).cast("long")))
    for least in (0.6, 0.9):
        listed = P.PATTERNS | ({"eng": ["[A-Za-z]{2,}"]} if least < 0.9 else {})
        rows = P.pattern_spans(many, "doc_id", "text", listed).withColumn("confidence", F.when(F.col("kind") == "eng", 0.8).otherwise(0.9))
        best = F.min(F.struct((-F.col("confidence")).alias("o"), "kind"))
        want = rows.groupBy("doc_id", "match", "start", "end").agg(best.alias("b")).select("doc_id", "match", "start", "end", "b.kind", (-F.col("b.o")).alias("c"))
        got = [tuple(r) for r in P.entity_candidates(many, "doc_id", "text", least).collect()]
        assert sorted(got, key=repr) == sorted((tuple(r) for r in want.collect()), key=repr)
    plan = P.entity_candidates(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_model_metrics_read_a_text_once(spark, monkeypatch):
    from quarryline.operators import graph as G

    seen, plain = [], G.written

    def kept(df):
        seen.append(df.columns)
        return plain(df)

    monkeypatch.setattr(G, "written", kept)
    rows = spark.createDataFrame([(f"m{k % 2}", k, [1.0, float(k)], "天地" * k + "ab", k % 3, 1) for k in range(12)], "model string, vec_id long, embedding array<float>, text string, domain int, quality int")
    near = spark.createDataFrame([(a, a + 2) for a in range(8)], "a long, b long")
    got = {r["model"]: r for r in E.model_metrics(rows, near, near).collect()}
    share = [2 * k / (2 * k + 2) for k in range(0, 12, 2)]
    assert abs(got["m0"]["ratio"] - sum(share) / 6) < 1e-12 and got["m0"]["n"] == 6
    assert "chinese" in seen[0] and all("text" not in c for c in seen)
