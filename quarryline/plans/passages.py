"""Queries over chunks, spans and page text. Where Chinese punctuation matters, the documents' full stops are put for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passages as P
from ..operators import segmentation as S
from ..operators import text as T
from ..session import load
from .texts import _SPACE

_doc = lambda s, d: load(s, d, "documents")
_stops = lambda s, d: _doc(s, d).withColumn("text", F.translate("text", ".", "。"))


def _chunks(df, chunks):
    return df.select("doc_id", F.posexplode(chunks).alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))


def _lines(s, d):
    return _doc(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


#: A Chinese character for each Latin letter, as the tables hold no Chinese.
HAN = "天地人你我他大小上下左右日月水火木金土山川風雨雪花鳥"


def _han(s, d):
    """The names of all parts, letter by letter in Chinese and without blanks."""
    return load(s, d, "part").select("p_partkey", F.translate(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")), "abcdefghijklmnopqrstuvwxyz", HAN).alias("text"))


def _segmented(s, d):
    rows = _han(s, d)
    return rows.select("p_partkey", F.array_join(P.segments(F.col("text"), tokenizer=S.segmenter(S.counted_words(rows, "text"))), " ").alias("words"))


QUERIES = {
    "passage_windows": lambda s, d: _chunks(_stops(s, d), P.window_chunks(F.col("text"))),
    "passage_sentences": lambda s, d: _chunks(_stops(s, d), P.sentence_chunks(F.col("text"), 300, 60)),
    "passage_first": lambda s, d: _stops(s, d).select("doc_id", F.md5(P.first_segment(F.col("text"))).alias("digest")),
    "passage_segments": lambda s, d: _doc(s, d).select("doc_id", F.md5(F.array_join(P.segments(F.col("text")), " ")).alias("digest")),
    "question_keywords": lambda s, d: load(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(P.question_keywords(F.col("text")), ",").alias("keywords")),
    "pattern_spans": lambda s, d: P.pattern_spans(_doc(s, d), "doc_id", "text"),
    "entity_candidates": lambda s, d: P.entity_candidates(_doc(s, d), "doc_id", "text").groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.round(F.avg("confidence"), 6).alias("confidence")),
    "page_furniture": lambda s, d: _lines(s, d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(P.is_page_furniture(F.col("text"))).alias("furniture")),
    "docx_clean": lambda s, d: _doc(s, d).select("doc_id", F.md5(P.cleaned_docx(F.col("text"))).alias("digest")),
    "pdf_clean": lambda s, d: _doc(s, d).select("doc_id", F.md5(P.cleaned_pdf(F.col("text"))).alias("digest")),
    "punctuation": lambda s, d: _doc(s, d).select("doc_id", F.md5(P.normalized_punctuation(F.concat(F.lit("“a”－‘b’...."), F.col("text")))).alias("digest")),
    "flat_tables": lambda s, d: load(s, d, "supplier").groupBy("s_nationkey").agg(P.flattened_table(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))), lambda x: F.array(x["s_name"], F.when(x["s_suppkey"] % 3 == 0, " ").otherwise(F.lit("x ")), F.floor(x["s_acctbal"]).cast("string")))).alias("text")),
    "durations": lambda s, d: load(s, d, "events").select("event_id", P.duration(F.floor(F.col("value") * F.col("value"))).alias("duration")),
    "segmentation_answers": lambda s, d: load(s, d, "part").select("p_partkey", F.array_join(P.parsed_segmentation(F.concat(F.lit("# 分詞\n輸出：\n"), F.when(F.col("p_partkey") % 2 == 0, F.lit("紅 色 ")).otherwise(""), "p_name", F.lit("\n完"))), "|").alias("words")),
    "texts_of_length": lambda s, d: load(s, d, "part").select("p_partkey", P.of_length(F.col("p_name"), 25).alias("text")),
    "embeddable_texts": lambda s, d: P.embeddable(_doc(s, d), "text", 500).select("doc_id", F.md5("text").alias("digest")),
    "question_suggestions": lambda s, d: load(s, d, "part").select("p_partkey", F.array_join(P.suggestions(F.col("p_name"), 3), "|").alias("questions")),
    "chinese_names": lambda s, d: load(s, d, "part").select("p_partkey", F.array_join(F.array_sort(P.chinese_names(F.when(F.col("p_size") % 2 == 0, "她叫阿寶").otherwise("張大同去"))), "|").alias("names")),
    "question_names": lambda s, d: load(s, d, "part").select("p_partkey", F.array_join(P.question_entities(F.concat(F.lit("微軟公司 "), "p_name")), "|").alias("entities")),
    "word_dictionary": lambda s, d: S.counted_words(_han(s, d), "text"),
    "segmented_names": lambda s, d: _segmented(s, d),
    "segmented_questions": lambda s, d: _han(s, d).select("p_partkey", F.array_join(P.question_entities(F.concat(F.lit("可以進行"), "text"), tokenizer=S.segmenter(S.counted_words(_han(s, d), "text"))), "|").alias("entities")),
    "chinese_dominance": lambda s, d: load(s, d, "part").select("p_partkey", P.is_mostly_chinese(F.concat(F.repeat(F.lit("中文"), 3), "p_name")).alias("dominant")),
}

_CLEAN = rf"regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(t, '{_SPACE}', ' ', 'g'), '[^{T.KEPT}]', '', 'g'), '－', '—'), '。+', '。', 'g'), '^[ ，。！？；：]+|[ ，。！？；：]+$', '', 'g')"
_STRIP = r"regexp_replace({t}, '^[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_SENT = r"list_filter(list_transform(regexp_split_to_array({t}, '[。！？；\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) >= 2)"
_STOPS = "SELECT doc_id, translate(text, '.', '。') AS t FROM documents"
_PIECE = "substring(t, start + 1, 1000)"
_W = r"regexp_extract_all({t}, '[a-zA-Z0-9]+|[一-鿿]')"
_STOP = repr(T.STOP_WORDS)


def _span_sql():
    parts = []
    for kind, patterns in T.PATTERNS.items():
        for p in patterns:
            parts.append(f"SELECT doc_id, '{kind}' AS kind, text, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS b FROM documents WHERE regexp_matches(text, '{p}')")
    return _places(" UNION ALL ".join(parts))


def _places(rows):
    return f"SELECT doc_id, kind, m[i] AS match, s::int AS start, (s + length(m[i]))::int AS \"end\" FROM (SELECT doc_id, kind, m, i, coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM (SELECT doc_id, kind, m, b, unnest(range(1, len(m) + 1)) AS i FROM ({rows})))"


_LATIN = _places("SELECT doc_id, 'eng' AS kind, text, regexp_extract_all(text, '[A-Za-z]{2,}') AS m, regexp_split_to_array(text, '[A-Za-z]{2,}') AS b FROM documents WHERE regexp_matches(text, '[A-Za-z]{2,}')")
_HAS = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"


def _pdf(t):
    c = T.CJK
    steps = [(f"([{c}])\\s+([{c}])", "\\1\\2"), (f"([{c}])\\s+([{c}])", "\\1\\2"), (r"\s+([，。！？；：])", "\\1"), (r"([「『（【《〈])\s+", "\\1"), (f"(\\d)\\s+([{c}])", "\\1\\2"), (f"([{c}])\\s+(\\d)", "\\1\\2"), (" +", " ")]
    for pattern, new in steps + [(p, "") for p in P.PAGE_MARKS + P.CLOSING_MARKS] + [(r"[^\p{L}\p{N}_\s，。！？；：「」『』（）【】《》〈〉—–…－(),.!?;:\"'']", "")]:
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return t


ORACLES = {
    "passage_windows": f"WITH RECURSIVE d AS ({_STOPS} WHERE length(text) > 0), r AS (SELECT doc_id, t, 0 AS start, {_PIECE.replace('start', '0')} AS piece FROM d UNION ALL SELECT doc_id, t, nx, substring(t, nx + 1, 1000) FROM (SELECT doc_id, t, greatest(start + 1, (CASE WHEN start + 1000 < length(t) AND lp > 500 THEN start + lp + 1 ELSE start + 1000 END) - 200)::int AS nx FROM (SELECT *, CASE WHEN contains(piece, '。') THEN length(piece) - strpos(reverse(piece), '。') ELSE -1 END AS lp FROM r)) WHERE nx < length(t)), c AS (SELECT doc_id, start, {_STRIP.format(t='CASE WHEN start + 1000 < length(t) AND lp > 500 THEN substring(piece, 1, (lp + 1)::int) ELSE piece END')} AS chunk FROM (SELECT *, CASE WHEN contains(piece, '。') THEN length(piece) - strpos(reverse(piece), '。') ELSE -1 END AS lp FROM r)) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::int AS chunk_index, md5(chunk) AS digest FROM c WHERE chunk <> ''",
    "passage_sentences": f"WITH RECURSIVE d AS (SELECT doc_id, {_SENT.format(t='c')} AS x FROM (SELECT doc_id, {_CLEAN} AS c FROM ({_STOPS}))), r AS (SELECT doc_id, x, 0 AS i, '' AS o, 0 AS n, NULL::varchar AS done FROM d UNION ALL SELECT doc_id, x, i + 1, CASE WHEN f AND length(o) > 60 THEN substring(o, length(o) - 59) || ' ' || s WHEN f THEN s WHEN o = '' THEN s ELSE o || ' ' || s END, CASE WHEN f AND length(o) > 60 THEN 61 + length(s) WHEN f THEN length(s) ELSE n + length(s) END::int, CASE WHEN f THEN trim(o, ' ') END FROM (SELECT *, x[i + 1] AS s, n + length(x[i + 1]) > 300 AND o <> '' AS f FROM r WHERE i < len(x))), e AS (SELECT doc_id, i, done FROM r WHERE done <> '' UNION ALL SELECT doc_id, i + 1, trim(o, ' ') FROM r WHERE i = len(x) AND trim(o, ' ') <> '') SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS chunk_index, md5(done) AS digest FROM e",
    "passage_first": f"WITH RECURSIVE d AS (SELECT doc_id, t, c, {_SENT.format(t='c')} AS x FROM (SELECT doc_id, t, {_CLEAN} AS c FROM ({_STOPS}))), r AS (SELECT doc_id, t, c, x, 1 AS i, '' AS o FROM d UNION ALL SELECT doc_id, t, c, x, i + 1, o || x[i] || ' ' FROM r WHERE i <= len(x) AND (o = '' OR length(o) + length(x[i]) <= 512)) SELECT doc_id, md5(CASE WHEN trim(coalesce(t, ''), ' ') = '' THEN '' WHEN length(c) <= 512 THEN c WHEN trim(o, ' ') <> '' THEN trim(o, ' ') ELSE substring(c, 1, 512) END) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS p FROM r) WHERE p = 1",
    "passage_segments": f"SELECT doc_id, md5(array_to_string(list_filter({_W.format(t='c')}, lambda w: NOT list_contains({_STOP}, lower(w)) AND (length(w) > 1 OR regexp_matches(w, '[一-鿿]'))), ' ')) AS digest FROM (SELECT doc_id, {_CLEAN.replace('。+', '，+').replace(chr(39) + '。' + chr(39), chr(39) + '，' + chr(39), 1)} AS c FROM (SELECT doc_id, text AS t FROM documents))",
    "question_keywords": rf"SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_zip(x, range(1, len(x) + 1)), lambda p: list_position(x, p[1]) = p[2]), lambda p: p[1])[1:10], ',') AS keywords FROM (SELECT conv_id, turn, list_filter({_W.format(t='text')}, lambda w: length(w) > 1 AND NOT list_contains({_STOP}, lower(w)) AND NOT regexp_matches(w, '^\d+$')) AS x FROM conversations WHERE role = 'user')",
    "pattern_spans": _span_sql(),
    "entity_candidates": f"SELECT doc_id, type, count(*) AS n, sum(start)::bigint AS starts, round(avg(c), 6) AS confidence FROM (SELECT doc_id, match, start, \"end\", arg_min(kind, (-c, kind)) AS type, max(c) AS c FROM (SELECT *, 0.9::double AS c FROM ({_span_sql()}) UNION ALL SELECT *, 0.8::double FROM ({_LATIN})) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2",
    "page_furniture": rf"SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(lower(x), '^(第\s*\d+\s*頁|page\s*\d+|\d+\s*/\s*\d+)$') OR regexp_matches(x, '\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}') OR {_HAS('lower(x)', P.COPYRIGHT_WORDS)} OR (length(x) < 50 AND {_HAS('x', P.COMPANY_WORDS)}) OR (length(x) < 30 AND len(list_filter(regexp_split_to_array(trim(x, ' '), '\s+'), lambda w: w <> '')) <= 5)) AS furniture FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY 1",
    "docx_clean": rf"SELECT doc_id, md5({_STRIP.format(t=rf'''regexp_replace(regexp_replace(text, '{_SPACE}', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s，。！？；：「」『』（）【】《》〈〉|]', '', 'g')''')}) AS digest FROM documents",
    "pdf_clean": f"SELECT doc_id, md5({_STRIP.format(t=_pdf(f'''regexp_replace(text, '{_SPACE}', ' ', 'g')'''))}) AS digest FROM documents",
    "punctuation": "SELECT doc_id, md5(regexp_replace(translate('“a”－‘b’....' || text, '“”‘’－', '\"\"' || chr(39) || chr(39) || '—'), '\\.{3,}', '…', 'g')) AS digest FROM documents",
    "flat_tables": "SELECT s_nationkey, string_agg(s_name || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' | x' END || ' | ' || floor(s_acctbal)::bigint, chr(10) ORDER BY s_suppkey) AS text FROM supplier GROUP BY 1",
    "durations": "SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s::double) WHEN s < 3600 THEN printf('%dm %.1fs', s // 60, (s % 60)::double) ELSE printf('%dh %dm', s // 3600, s % 3600 // 60) END AS duration FROM (SELECT event_id, floor(value * value)::bigint AS s FROM events)",
    "segmentation_answers": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '紅|色|' || replace(p_name, ' ', '|') ELSE '完' END AS words FROM part",
    "texts_of_length": "SELECT p_partkey, substring(repeat(p_name, 26), 1, 25) AS text FROM part",
    "embeddable_texts": f"SELECT doc_id, md5(substring(x, 1, 500)) AS digest FROM (SELECT doc_id, {_STRIP.format(t='text')} AS x FROM documents) WHERE x <> ''",
    "question_suggestions": "SELECT p_partkey, p_name || '是什麼？|' || p_name || '如何運作？|' || p_name || '有哪些特點？' AS questions FROM part",
    "chinese_names": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '阿寶' ELSE '張大同' END AS names FROM part",
    "question_names": "SELECT p_partkey, array_to_string(['微軟公司'] || list_sort(list_distinct(string_split(p_name, ' '))), '|') AS entities FROM part",
    "word_dictionary": f"""WITH t AS (SELECT translate(replace(lower(p_name), ' ', ''), 'abcdefghijklmnopqrstuvwxyz', '{HAN}') AS x FROM part), r AS (SELECT unnest(regexp_extract_all(x, '[一-鿿]+')) AS x FROM t),
g AS MATERIALIZED (SELECT substring(x, i, k) AS word, count(*) AS n FROM (SELECT x, k, unnest(range(1, length(x) - k + 2)) AS i FROM r, range(1, 5) q(k)) GROUP BY 1), m AS (SELECT sum(n) AS total FROM g WHERE length(word) = 1),
c AS (SELECT w.word, w.n, a.n AS na, b.n AS nb FROM (SELECT word, n, unnest(range(1, length(word))) AS k FROM g WHERE length(word) > 1 AND n >= 2) w JOIN g a ON a.word = substring(w.word, 1, k) JOIN g b ON b.word = substring(w.word, k + 1))
SELECT word, n FROM g WHERE length(word) = 1 UNION ALL SELECT word, any_value(n) FROM c, m GROUP BY word HAVING bool_and(n * total >= 2 * na * nb)""",
    "chinese_dominance": "SELECT p_partkey, 6 / (6 + length(p_name)) >= 0.3 AS dominant FROM part",
}
# the first chunker, without overlap
_texts_sentences = f"WITH RECURSIVE d AS (SELECT doc_id, {_SENT.format(t='text')} AS x FROM documents), r AS (SELECT doc_id, x, 0 AS i, 0 AS o, 0 AS n FROM d UNION ALL SELECT doc_id, x, i + 1, CASE WHEN o = 0 OR o + length(x[i + 1]) + 1 > 1000 THEN length(x[i + 1]) ELSE o + 1 + length(x[i + 1]) END::int, (n + (o > 0 AND o + length(x[i + 1]) + 1 > 1000)::int)::int FROM r WHERE i < len(x)) SELECT doc_id, (n + (o > 0)::int)::int AS n FROM r WHERE i = len(x)"
ORACLES["text_sentence_chunks"] = _texts_sentences
