"""Questions: their type, intent, the search they call for, and confidences of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of each type of question and of each intent, in order of preference.
TYPES = {
    "global_search": ["整體|全域|總體|概況|全貌|綜合|宏觀", "所有.*?是什麼|全部.*?如何", "總共有.*?個|一共.*?種", "系統.*?功能|平台.*?特點"],
    "local_search": ["具體|詳細|特定|明確|準確", ".*?是什麼|.*?如何|.*?為什麼", "告訴我.*?的|介紹.*?的", ".*?的定義|.*?的含義"],
    "entity_search": [".*?公司|.*?組織|.*?機構", ".*?人物|.*?專家|.*?學者", ".*?產品|.*?服務|.*?技術", "尋找|查找|搜尋.*?相關"],
    "relation_search": [".*?和.*?的關係|.*?與.*?之間", ".*?如何影響.*?|.*?導致.*?", ".*?屬於.*?|.*?包含.*?", "相關性|關聯性|依賴關係"],
    "summary": ["總結|摘要|概括|歸納", "簡述|簡要說明|大致介紹", "主要內容|核心要點|重點"],
    "comparison": ["比較|對比|區別|差異", ".*?vs.*?|.*?和.*?哪個", "優缺點|利弊|好壞", "相同點|不同點|異同"],
    "causal": ["為什麼|原因|起因|導致", "因為|由於|造成|引起", "結果|後果|影響|效果", "如何產生|怎麼形成"],
    "temporal": ["時間|日期|年份|月份", "何時|什麼時候|多久", "之前|之後|期間|過程", "發展歷程|演變過程|時間線"],
}
INTENTS = {
    "information_seeking": ["是什麼|什麼是|如何|怎樣", "告訴我|介紹|說明|解釋", "資訊|資料|內容|詳情"],
    "fact_checking": ["是否|是不是|對不對|正確嗎", "真的嗎|確定嗎|可信嗎", "驗證|查證|確認|核實"],
    "explanation": ["為什麼|怎麼回事|原理|機制", "解釋|說明|闡述|論述", "工作原理|運作方式|實現方法"],
    "comparison": ["比較|對比|區別|差異", "哪個更好|哪種更適合", "優勢|劣勢|特點|特色"],
    "recommendation": ["推薦|建議|選擇|挑選", "應該|最好|適合|合適", "方案|策略|方法|途徑"],
    "problem_solving": ["解決|處理|應對|克服", "問題|困難|挑戰|障礙", "方法|辦法|措施|對策"],
    "planning": ["計劃|規劃|安排|組織", "如何實施|怎麼執行|步驟", "流程|程序|順序|階段"],
}
# What names of persons, organizations, places, products and concepts look like.
NAMES = {
    "person": "[一-鿿]{2,4}(?:先生|女士|教授|博士|主任|經理|總監|董事|局長|部長)",
    "organization": "[一-鿿]{2,15}(?:公司|企業|機構|組織|部門|學校|大學|研究所|協會|基金會)",
    "location": "[一-鿿]{2,10}(?:市|縣|區|省|國|地區|城市|鄉|鎮|村|街道)",
    "product": "[一-鿿]{2,10}(?:系統|平台|軟體|應用|工具|服務|產品|技術)",
    "concept": "[一-鿿]{2,8}(?:概念|理論|方法|模型|框架|標準|規範|原則)",
}


def entities(text: Column) -> Column:
    """Names that end like persons, organizations, places, products or concepts, each once."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in NAMES.values()]
    return F.array_distinct(F.concat(*found))


def _best(text: Column, table: dict[str, list[str]], bonus: dict[str, Column], fallback: Column) -> Column:
    """The kind with the largest share of matching patterns (the first of equals), with the share; a fallback if none."""
    rows = []
    for n, (kind, patterns) in enumerate(table.items()):
        hits = sum((text.rlike(bare(p)).cast("int") for p in patterns), F.lit(0)) + bonus.get(kind, F.lit(0.0))
        rows.append(F.struct((hits / len(patterns)).alias("score"), F.lit(-n).alias("order"), F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*rows))
    return F.when(best["score"] < 0.1, fallback).otherwise(F.struct(best["kind"].alias("kind"), F.least(best["score"], F.lit(1.0)).alias("confidence")))


def bare(pattern: str) -> str:
    """The pattern without lazy runs at the ends of its alternatives: a search finds a match for just the same texts, but
    doesn't look on to a text's end from every place."""
    return "|".join(x.removeprefix(".*?").removesuffix(".*?") for x in pattern.split("|"))


def _told(kind: str, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))


def query_type(text: Column, n: Column) -> Column:
    bonus = {"entity_search": F.when(n > 0, 0.5).otherwise(0.0), "relation_search": F.when(n >= 2, 0.5).otherwise(0.0), "global_search": F.when(n > 3, 0.3).otherwise(0.0)}
    fallback = F.when(n == 0, _told("global_search", 0.6)).when(n == 1, _told("entity_search", 0.6)).otherwise(_told("relation_search", 0.6))
    return _best(text, TYPES, bonus, fallback)


def intent(text: Column) -> Column:
    return _best(text, INTENTS, {}, _told("information_seeking", 0.5))


def search_type(kind: Column, aim: Column, n: Column, confidence: Column, low: float = 0.5) -> Column:
    """Which search a question calls for: hybrid if in doubt, else by the number of entities, the intent, the type."""
    base = F.when(kind.isin("global_search", "summary", "comparison", "causal", "temporal"), "global").when(kind.isin("local_search", "entity_search", "relation_search"), "local").otherwise("hybrid")
    return F.when(confidence < low, "hybrid").when(n == 0, "global").when(n == 1, "local").when(n >= 4, "global").when(aim.isin("explanation", "comparison"), "global").when(aim == "fact_checking", "local").otherwise(base)


def analyzed(queries: DataFrame, id_: str, text: str) -> DataFrame:
    """Each question's normal form, entities, type, intent, mean confidence and search."""
    from .text import normalized_query

    rows = queries.select(id_, normalized_query(F.col(text)).alias("query"))
    rows = rows.withColumn("entities", entities(F.col("query"))).withColumn("n_entities", F.size("entities"))
    rows = rows.withColumn("type", query_type(F.col("query"), F.col("n_entities"))).withColumn("intent", intent(F.col("query")))
    mean = F.round((F.col("type.confidence") + F.col("intent.confidence")) / 2, 6)
    rows = rows.select(id_, "query", "n_entities", F.col("type.kind").alias("type"), F.col("intent.kind").alias("intent"), mean.alias("confidence"))
    return rows.withColumn("search", search_type(F.col("type"), F.col("intent"), F.col("n_entities"), F.col("confidence")))


def pattern_key(text: Column) -> Column:
    size = F.when(F.length(text) < 50, "short").when(F.length(text) < 200, "medium").otherwise("long")
    return F.concat_ws("+", size, *[F.when(F.contains(F.lower(text), F.lit(w)), F.lit(w)) for w in ("what", "how", "why", "where")])


def cache_key(text: Column, kind: Column, aim: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lower(F.trim(text)), kind, aim))


def composite_key(text: Column, kind: Column, aim: Column, names: Column, words: Column) -> Column:
    """The key of a question with what was found in it: entities and keywords count in any order."""
    joined = lambda x: F.array_join(F.array_sort(x), "_")
    return F.concat_ws("|", F.lower(F.trim(text)), kind, aim, joined(names), joined(words))


def cached(queries: DataFrame, cache: DataFrame, ttl: int, least: float | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """Questions with the latest answer to the same text within `ttl` seconds before them: (id, answer). Of answers of one time
    that with the largest columns `then` counts, of equals the largest. Answers of less confidence than `least` were never
    admitted."""
    if least is not None:
        cache = cache.where(F.col("confidence") >= least)
    hit = queries.join(cache, "key").where((F.col("cached_at") <= F.col("at")) & (F.col("cached_at") > F.col("at") - ttl))
    return hit.groupBy("id").agg(F.max_by("answer", F.struct("cached_at", *then, "answer")).alias("answer"))


def route(text: Column, rules: dict[str, str], default: str = "default") -> Column:
    """The target of the first rule whose pattern is part of the question or has it as a part; case doesn't count."""
    lower = F.lower(F.trim(text))
    out = F.lit(default)
    for pattern, target in reversed(rules.items()):
        out = F.when(F.contains(lower, F.lit(pattern.lower())) | F.contains(F.lit(pattern.lower()), lower), target).otherwise(out)
    return out


def answer_confidence(kind: str, confidence: Column, quality: Column, n: Column) -> Column:
    """The confidence of an answer from communities (global), entities or relations."""
    score = {"global": 0.4 * confidence + 0.3 * quality + F.least(n / 5, F.lit(0.3)), "entity": 0.5 * confidence + 0.3 * quality + F.least(n / 10, F.lit(0.2)), "relation": 0.6 * confidence + F.least(n / 10, F.lit(0.4))}[kind]
    return F.least(score, F.lit(1.0))


def layered_confidence(levels: Column, communities: Column) -> Column:
    """The confidence of an answer from several levels of communities; 0 without any."""
    return F.when(levels == 0, 0.0).otherwise(F.least(0.6 + 0.1 * levels + 0.05 * communities, F.lit(1.0)))


def hybrid_confidence(from_communities: Column, from_entities: Column) -> Column:
    """.6 and .4 of two confidences, or the one that there is, or .1."""
    return F.coalesce(0.6 * from_communities + 0.4 * from_entities, from_communities, from_entities, F.lit(0.1))
