"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import questions as Q
from ..operators import text as T
from ..session import load

_doc = lambda s, d: load(s, d, "documents")
_part = lambda s, d: load(s, d, "part")


def _asked(s, d):
    return load(s, d, "conversations").where("role = 'user'").withColumn("id", F.concat_ws("-", "conv_id", "turn"))


def _whole_key():
    """The whole normalised question (question_cache takes its first eight characters, as its SQL does)."""
    return F.md5(F.lower(F.trim("text")))


QUERIES = {
    "text_clean": lambda s, d: _doc(s, d).select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned")),
    "text_statistics": lambda s, d: T.statistics(_doc(s, d), "doc_id", "text"),
    "text_quality": lambda s, d: T.quality(_doc(s, d), "doc_id", "text"),
    "text_sentences": lambda s, d: _doc(s, d).select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"), F.md5(F.array_join(T.sentences(F.col("text")), "|")).alias("digest")),
    "text_window_chunks": lambda s, d: T.window_chunks(_doc(s, d), "doc_id", "text").select("doc_id", "chunk_index", F.md5("chunk").alias("digest")),
    "text_sentence_chunks": lambda s, d: _doc(s, d).select("doc_id", F.size(T.sentence_chunks(F.col("text"))).alias("n")),
    "text_patterns": lambda s, d: T.pattern_counts(_doc(s, d), "doc_id", "text"),
    "text_emails": lambda s, d: T.pattern_matches(_doc(s, d), "doc_id", "text", "email"),
    "text_keywords": lambda s, d: _doc(s, d).select("doc_id", F.array_join(T.keywords(F.col("text")), ",").alias("keywords")),
    "text_frequent_words": lambda s, d: T.frequent_words(_doc(s, d), "doc_id", "text", 5, 3),
    "text_jaccard": lambda s, d: _part(s, d).select("p_partkey", F.round(T.jaccard(F.lower("p_name"), F.lower("p_type")), 6).alias("jaccard")),
    "text_preview": lambda s, d: _doc(s, d).select("doc_id", T.preview(F.col("text")).alias("preview")),
    "text_file_size": lambda s, d: _doc(s, d).select("doc_id", T.file_size(F.octet_length("text") * 37).alias("size")),
    "text_chinese_weight": lambda s, d: _doc(s, d).select("doc_id", T.chinese_weight(F.col("text")).alias("weight")),
    "text_content_hash": lambda s, d: _doc(s, d).select("doc_id", F.sha2("text", 256).alias("hash")),
    "page_text": lambda s, d: load(s, d, "pages").select("page_id", F.md5(T.strip_markup(F.col("html"))).alias("text")),
    "edit_matches": lambda s, d: T.edit_matches(load(s, d, "nation").select(F.lower("n_name").alias("name")), load(s, d, "nation").select(F.lower(F.concat(F.substring("n_name", 1, 3), F.lit("x"), F.substring("n_name", 5, 40))).alias("query"))),
    "label_scores": lambda s, d: T.scores(_doc(s, d).join(load(s, d, "labels"), "doc_id"), F.length("text") >= 200, F.col("quality") == 1),
    "question_analysis": lambda s, d: Q.analyzed(_asked(s, d), "id", "text").select("id", "n_entities", "type", "intent", "confidence", "search"),
    "question_patterns": lambda s, d: _asked(s, d).groupBy(Q.pattern_key(F.col("text")).alias("pattern")).agg(F.count("*").alias("n")),
    "question_top": lambda s, d: _asked(s, d).groupBy(F.substring(F.trim(F.lower("text")), 1, 100).alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(10),
    "question_cache": lambda s, d: Q.cached(_asked(s, d).select("id", F.md5(F.substring("text", 1, 8)).alias("key"), (F.col("conv_id") * 10).alias("at")), load(s, d, "conversations").where("role = 'user'").select(F.md5(F.substring("text", 1, 8)).alias("key"), (F.col("conv_id") * 10 - 5).alias("cached_at"), "turn", F.md5("text").alias("answer")), 300, then=("turn",)),
    "question_cache_whole": lambda s, d: Q.cached(_asked(s, d).select("id", _whole_key().alias("key"), (F.col("conv_id") * 10).alias("at")), load(s, d, "conversations").where("role = 'user'").select(_whole_key().alias("key"), (F.col("conv_id") * 10 - 5).alias("cached_at"), "turn", F.md5("text").alias("answer")), 300, then=("turn",)),
    "answer_confidence": lambda s, d: _asked(s, d).select("id", *[F.round(Q.answer_confidence(k, F.lit(0.6), F.least(F.length("text") / 500, F.lit(1.0)), F.col("turn")), 6).alias(k) for k in ("global", "entity", "relation")]),
    "response_quality": lambda s, d: _pairs(s, d),
}


def _pairs(s, d):
    """Each user turn with the assistant's next: .4 for length, half the question's at least, .6 for Chinese."""
    c = load(s, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("told"))
    share = lambda x, y: F.least(F.lit(1.0), x / F.greatest(F.lit(1.0), y))
    score = 0.4 * share(F.length("told"), 0.5 * F.length("asked")) + 0.6 * share(F.regexp_count("told", F.lit(f"[{T.CJK}]")), 0.3 * F.length("told"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.when(F.trim("told") == "", 0.0).otherwise(score), 6).alias("quality"))


_ASKED = "(SELECT *, conv_id || '-' || turn AS id FROM conversations WHERE role = 'user')"
_W = r"regexp_extract_all(text, '[a-zA-Z0-9]+|[一-鿿]')"
_S = r"list_filter(list_transform(regexp_split_to_array(text, '[。！？；\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) >= 2)"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_KEPT = T.KEPT
_COUNT = lambda p, t="text": f"len(regexp_extract_all({t}, '{p}'))"
_STATS = rf"SELECT doc_id, length(text)::int AS char_count, len({_W})::int AS word_count, len({_S})::int AS sentence_count, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''))::int AS paragraph_count, {_COUNT('[一-鿿]')}::int AS chinese_char_count, {_COUNT('[a-zA-Z]+')}::int AS english_word_count, {_COUNT(T.CHINESE_PUNCTUATION)}::int AS punctuation_count FROM documents"


def _types(table, bonus, default):
    """The best kind of a table of patterns, as SQL."""
    rows = []
    for n, (kind, patterns) in enumerate(table.items()):
        hits = " + ".join(f"regexp_matches(q, '{p}')::int" for p in patterns)
        rows.append(f"{{'score': ({hits} + {bonus.get(kind, '0')})::double / {len(patterns)}, 'ord': {-n}, 'kind': '{kind}'}}")
    return f"CASE WHEN list_max([{', '.join(rows)}]).score < 0.1 THEN {default} ELSE {{'kind': list_max([{', '.join(rows)}]).kind, 'confidence': least(list_max([{', '.join(rows)}]).score, 1.0::double)}} END"


_ENT = " || ".join(f"regexp_extract_all(q, '{p}')" for p in Q.NAMES.values())
_told = lambda k, c: f"{{'kind': '{k}', 'confidence': {c}::double}}"
ORACLES = {
    "text_clean": rf"SELECT doc_id, md5(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(text, '{_SPACE}', ' ', 'g'), '[^{_KEPT}]', '', 'g'), '－', '—'), '，+', '，', 'g'), '^[ ，。！？；：]+|[ ，。！？；：]+$', '', 'g')) AS cleaned FROM documents",
    "text_statistics": f"SELECT *, round(CASE WHEN sentence_count > 0 THEN char_count / sentence_count ELSE 0 END, 6) AS avg_sentence_length, round(CASE WHEN word_count > 0 THEN chinese_char_count / word_count ELSE 0 END, 6) AS avg_word_length FROM ({_STATS})",
    "text_quality": rf"WITH s AS ({_STATS}), x AS (SELECT doc_id, len({_W}) AS nw, len(list_distinct({_W})) AS nd, {_COUNT('[^' + T.KEPT.replace('豈-﫿', '') + ']')} AS ns, {' + '.join(f'contains(text, {chr(39)}{w}{chr(39)})::int' for w in T.COHERENCE_WORDS)} AS nl FROM documents), t AS (SELECT doc_id, 0.15::double * (CASE WHEN char_count < 50 THEN 0.3 WHEN char_count > 10000 THEN 0.8 ELSE 1 END)::double + 0.15::double * (CASE WHEN char_count = 0 OR chinese_char_count / char_count < 0.3 THEN 0.5 ELSE least(1, chinese_char_count / char_count * 1.2) END)::double + 0.2::double * (CASE WHEN sentence_count = 0 THEN 0 WHEN char_count / sentence_count < 5 THEN 0.4 WHEN char_count / sentence_count > 100 THEN 0.6 ELSE 1 END)::double + 0.15::double * (CASE WHEN nw = 0 THEN 0 ELSE least(1, nd / nw * 2) END)::double + 0.1::double * (CASE WHEN char_count = 0 OR punctuation_count / char_count < 0.02 THEN 0.3 WHEN punctuation_count / char_count > 0.15 THEN 0.6 ELSE 1 END)::double + 0.15::double * (CASE WHEN sentence_count > 5 THEN least(1, nl / (sentence_count * 0.1::double)) ELSE 0.8 END)::double + 0.1::double * (CASE WHEN ns > char_count * 0.05::double THEN 0.5 ELSE 1 END)::double AS total FROM s JOIN x USING (doc_id)) SELECT doc_id, round(total, 6) AS overall_score, CASE WHEN total >= 0.9 THEN 'excellent' WHEN total >= 0.7 THEN 'good' WHEN total >= 0.5 THEN 'fair' ELSE 'poor' END AS quality_level FROM t",
    "text_sentences": f"SELECT doc_id, len(x)::int AS n, md5(array_to_string(x, '|')) AS digest FROM (SELECT doc_id, {_S} AS x FROM documents)",
    "text_window_chunks": "SELECT doc_id, i::int AS chunk_index, md5(substring(text, (i * 800 + 1)::int, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 201) // 800 + 1)) AS i FROM documents WHERE length(text) > 0)",
    "text_patterns": "SELECT doc_id, " + ", ".join("(" + " + ".join(_COUNT(p) for p in ps) + f")::int AS {k}" for k, ps in T.PATTERNS.items()) + " FROM documents",
    "text_emails": f"SELECT doc_id, unnest(regexp_extract_all(text, '{T.PATTERNS['email'][0]}')) AS match FROM documents",
    "text_keywords": rf"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g')), '{_SPACE}'), lambda w: length(w) > 2 AND NOT list_contains({T.STOP_WORDS!r}, w))[1:10], ',') AS keywords FROM documents",
    "text_frequent_words": f"SELECT * FROM (SELECT doc_id, word, n, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS weight, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word))::int AS place FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_W.replace('text', 'lower(text)')}) AS word FROM documents) WHERE length(word) >= 3 GROUP BY 1, 2)) WHERE place <= 5",
    "text_jaccard": "SELECT p_partkey, round(CASE WHEN p_name = '' OR p_type = '' THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS jaccard FROM (SELECT *, string_split(lower(p_name), '') AS a, string_split(lower(p_type), '') AS b FROM part)",
    "text_preview": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview FROM documents",
    "text_file_size": "SELECT doc_id, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN round(b::double, 2)::varchar || ' B' WHEN b < 1048576 THEN round(b / 1024, 2)::varchar || ' KB' ELSE round(b / 1048576, 2)::varchar || ' MB' END AS size FROM (SELECT doc_id, strlen(text) * 37 AS b FROM documents)",
    "text_chinese_weight": "SELECT doc_id, CASE WHEN length(text) > 0 THEN least(1.3::double, 1 + 0.3::double * len(regexp_extract_all(text, '[一-鿿]')) / length(text)) ELSE 1 END AS weight FROM documents",
    "text_content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "page_text": r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\n\s*\n', chr(10) || chr(10), 'g')) AS text FROM pages",
    "edit_matches": "SELECT * FROM (SELECT query, name, levenshtein(query, name) AS distance FROM (SELECT DISTINCT lower(n_name) AS name FROM nation), (SELECT DISTINCT lower(substring(n_name, 1, 3) || 'x' || substring(n_name, 5, 40)) AS query FROM nation)) WHERE distance <= least(2, length(query) // 2)",
    "label_scores": "SELECT round(tp / np, 6) AS precision, round(tp / na, 6) AS recall, round(2 * (tp / np) * (tp / na) / (tp / np + tp / na), 6) AS f1 FROM (SELECT count(*) FILTER (length(text) >= 200 AND quality = 1) AS tp, count(*) FILTER (length(text) >= 200) AS np, count(*) FILTER (quality = 1) AS na FROM documents JOIN labels USING (doc_id))",
    "question_analysis": rf"WITH a AS (SELECT id, translate(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' '), '?!,', '？！，') AS q FROM {_ASKED}), b AS (SELECT *, len(list_distinct({_ENT}))::int AS n FROM a), c AS (SELECT *, {_types(Q.TYPES, {'entity_search': '(n > 0)::int * 0.5', 'relation_search': '(n >= 2)::int * 0.5', 'global_search': '(n > 3)::int * 0.3'}, 'CASE WHEN n = 0 THEN ' + _told('global_search', 0.6) + ' WHEN n = 1 THEN ' + _told('entity_search', 0.6) + ' ELSE ' + _told('relation_search', 0.6) + ' END')} AS t, {_types(Q.INTENTS, {}, _told('information_seeking', 0.5))} AS i FROM b), e AS (SELECT id, n AS n_entities, t.kind AS type, i.kind AS intent, round((t.confidence + i.confidence) / 2, 6) AS confidence FROM c) SELECT *, CASE WHEN confidence < 0.5 THEN 'hybrid' WHEN n_entities = 0 THEN 'global' WHEN n_entities = 1 THEN 'local' WHEN n_entities >= 4 THEN 'global' WHEN intent IN ('explanation', 'comparison') THEN 'global' WHEN intent = 'fact_checking' THEN 'local' WHEN type IN ('global_search', 'summary', 'comparison', 'causal', 'temporal') THEN 'global' ELSE 'local' END AS search FROM e",
    "question_patterns": f"SELECT concat_ws('+', CASE WHEN length(text) < 50 THEN 'short' WHEN length(text) < 200 THEN 'medium' ELSE 'long' END, {', '.join(f'CASE WHEN contains(lower(text), {chr(39)}{w}{chr(39)}) THEN {chr(39)}{w}{chr(39)} END' for w in ('what', 'how', 'why', 'where'))}) AS pattern, count(*) AS n FROM {_ASKED} GROUP BY 1",
    "question_top": f"SELECT substring(trim(lower(text), ' '), 1, 100) AS query, count(*) AS n FROM {_ASKED} GROUP BY 1 ORDER BY n DESC, query LIMIT 10",
    "question_cache": f"SELECT q.id, arg_max(md5(c.text), c.conv_id * 10 - 5) AS answer FROM {_ASKED} q JOIN conversations c ON c.role = 'user' AND substring(c.text, 1, 8) = substring(q.text, 1, 8) AND c.conv_id * 10 - 5 <= q.conv_id * 10 AND c.conv_id * 10 - 5 > q.conv_id * 10 - 300 GROUP BY 1",
    "question_cache_whole": f"SELECT q.id, arg_max(md5(c.text), c.conv_id * 10 - 5) AS answer FROM {_ASKED} q JOIN conversations c ON c.role = 'user' AND lower(trim(c.text, ' ')) = lower(trim(q.text, ' ')) AND c.conv_id * 10 - 5 <= q.conv_id * 10 AND c.conv_id * 10 - 5 > q.conv_id * 10 - 300 GROUP BY 1",
    "answer_confidence": f"SELECT id, round(least(1, 0.24::double + 0.3::double * z + least(turn / 5, 0.3::double)), 6) AS global, round(least(1, 0.3::double + 0.3::double * z + least(turn / 10, 0.2::double)), 6) AS entity, round(least(1, 0.36::double + least(turn / 10, 0.4::double)), 6) AS relation FROM (SELECT *, least(length(text) / 500, 1) AS z FROM {_ASKED})",
    "response_quality": "SELECT a.conv_id, a.turn, round(CASE WHEN trim(b.text) = '' THEN 0 ELSE 0.4::double * least(1, length(b.text) / greatest(1, 0.5::double * length(a.text))) + 0.6::double * least(1, len(regexp_extract_all(b.text, '[一-鿿]')) / greatest(1, 0.3::double * length(b.text))) END, 6) AS quality FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'",
}
