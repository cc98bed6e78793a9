"""Chunks, spans, names and page text: what turns documents into passages and passages into candidates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _WORD, CJK, PATTERNS, STOP_WORDS, clean, cleaned, cut_sentences, once, sentences, words

# Family names and patterns that results depend on.
SURNAMES = [
    "王", "李", "張", "劉", "陳", "楊", "趙", "黃", "周", "吳", "徐", "孫", "胡", "朱", "高", "林", "何", "郭", "馬", "羅", "梁", "宋", "鄭", "謝", "韓", "唐", "馮", "于", "董", "蕭",
    "程", "柴", "袁", "鄧", "許", "傅", "沈", "曾", "彭", "呂",
]
NOT_ENTITIES = [
    "可以", "應該", "需要", "必須", "能夠", "想要", "希望", "建議", "重要", "必要", "有效", "成功",
    "失敗", "困難", "簡單", "複雜", "進行", "實施", "執行", "完成", "開始", "結束", "繼續", "停止",
]
NAME_PATTERNS = ["[一-龯]{2,3}(?=姓|的|是|在|有|和|與)", "[一-龯]{2}(?=先生|女士|老師|經理|主任)"]
CALLED_PATTERNS = ["([一-龯]{2,3})姓(?:什麼|甚麼|\\?)", "叫([一-龯]{2,3})", "名叫([一-龯]{2,3})", "稱為([一-龯]{2,3})"]
COPYRIGHT_WORDS = ["copyright", "©", "版權", "著作權", "confidential", "機密"]
COMPANY_WORDS = ["公司", "Co.", "Ltd", "Inc"]
PAGE_MARKS = [r"(?i)第\s*\d+\s*頁", r"(?i)Page\s*\d+", r"\d+\s*/\s*\d+", r"-\s*\d+\s*-", r"\[\s*\d+\s*\]", r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?", r"\d{1,2}[-/]\d{1,2}[-/]\d{4}"]
CLOSING_MARKS = [r"(?i)copyright\s*©?\s*\d{4}.*", r"(?i)©\s*\d{4}.*", r"(?i)版權所有.*", r"(?i)著作權.*", r"(?i)confidential.*", r"(?i)機密.*"]

#: What a text must have for a pattern to match: a sign, or for those with Chinese in them anything beyond ASCII.
SIGNS = {PATTERNS["email"][0]: "@", PATTERNS["date"][1]: "-", PATTERNS["date"][2]: "/", PATTERNS["time"][0]: ":", PATTERNS["time"][1]: ":", PATTERNS["phone"][1]: "-", PATTERNS["percent"][0]: "%"}
BEYOND_ASCII = {p for ps in PATTERNS.values() for p in ps if not p.isascii()}
#: Spans that a task emits at once.
SPANS = 50_000
_SPACE = r"(?U)\s+"
#: The same characters, for what is cut in Python.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_GAPS = re.compile(f"[{WHITE_SPACE}]+")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalized_punctuation(text: Column) -> Column:
    """Straight quotes, one kind of dash, and an ellipsis for three dots or more."""
    return F.regexp_replace(F.translate(text, "“”‘’－", "\"\"''—"), r"\.{3,}", "…")


def cut_windows(text: str | None, size: int, overlap: int) -> list[str]:
    """See `window_chunks`: one pass forward, each character read a few times whatever the text's length."""
    chunks, start, n = [], 0, len(text or "")
    while start < n:
        stop = text.rfind("。", start, start + size) - start
        end = start + stop + 1 if start + size < n and stop > size // 2 else start + size
        chunk = text[start:end].strip(WHITE_SPACE)
        if chunk:
            chunks.append(chunk)
        start = max(start + 1, end - overlap)
    return chunks


def window_chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Chunks of `size` characters, each cut after its last Chinese full stop if that is beyond its half, the next one
    beginning `overlap` characters before its end; the last chunk may lie within the one before. Blank chunks are left out,
    a null or empty text has none."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_windows(t, size, overlap))

    return cut(text)


def packed_sentences(text: str | None, size: int, overlap: int) -> list[str]:
    """See `sentence_chunks`."""
    chunks, open_, held = [], "", 0
    for sentence in cut_sentences(cleaned(text)):
        if open_ == "" or held + len(sentence) <= size:
            open_ = f"{open_} {sentence}" if open_ else sentence
            held += len(sentence)
            continue
        if open_.strip(" "):
            chunks.append(open_.strip(" "))
        open_ = f"{open_[-overlap:]} {sentence}" if 0 < overlap < len(open_) else sentence
        held = len(open_)
    return [*chunks, open_.strip(" ")] if open_.strip(" ") else chunks


def sentence_chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Sentences of the cleaned text packed in order. A chunk is closed before a sentence that would bring the characters
    of its sentences above `size`; the next one begins with its last `overlap` characters if it is longer than these."""

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed_sentences(t, size, overlap))

    return pack(text)


def first_segment(text: Column, size: int = 512) -> Column:
    """What is embedded of a text: the cleaned text, of one longer than `size` the sentences that fit at its beginning."""

    def add(state: Column, sentence: Column) -> Column:
        fits = state["open"] & (F.length(state["text"]) + F.length(sentence) <= size)
        first = state["text"] == ""
        return F.struct(F.when(fits | first, F.concat(state["text"], sentence, F.lit(" "))).otherwise(state["text"]).alias("text"), F.when(fits | first, state["open"]).otherwise(F.lit(False)).alias("open"))

    def cut(whole: Column) -> Column:
        # each takes three characters at least, so that no more of them can fit
        some = F.slice(sentences(whole), 1, size // 3 + 2)
        packed = F.aggregate(some, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")), add, lambda s: F.trim(s["text"]))
        return F.when(F.length(whole) <= size, whole).otherwise(F.coalesce(F.nullif(packed, F.lit("")), F.substring(whole, 1, size)))

    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "").otherwise(once(clean(text), cut))


def segments(text: Column, stop_words: list[str] = STOP_WORDS, tokenizer: Callable[[Column], Column] = words) -> Column:
    """Words of the cleaned text without stop words and single letters that aren't Chinese, by `words` or a tokenizer that
    knows the corpus's words (`segmentation.segmenter`)."""
    if tokenizer is not words:
        return F.filter(tokenizer(clean(text)), lambda w: ~F.lower(w).isin(stop_words) & ((F.length(w) > 1) | w.rlike(f"[{CJK}]")))
    stops = set(stop_words)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w for w in _WORD.findall(cleaned(t)) if w.lower() not in stops and (len(w) > 1 or w > "\x7f")])

    return cut(text)


def question_keywords(text: Column, most: int = 10) -> Column:
    """The first different words of two characters or more that are no stop words or numbers."""
    return F.slice(F.array_distinct(F.filter(words(text), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(STOP_WORDS) & ~w.rlike(r"^\d+$"))), 1, most)


def quick(pattern: str) -> str:
    """The same pattern with its first repeated digit written out, as `re` looks for a first character fast only if it stands alone."""
    return re.sub(r"^\\d(\+|\{(\d),(\d)\}|\{(\d)\})", lambda m: "[0-9]" + (r"\d*" if m[1] == "+" else rf"\d{{{int(m[2]) - 1},{int(m[3]) - 1}}}" if m[2] else rf"\d{{{int(m[4]) - 1}}}"), pattern)


def searchable(patterns: list[str], text: str) -> list[str]:
    """Those of the patterns that can match the text by their SIGNS."""
    return [p for p in patterns if SIGNS.get(p, "") in text and not (p in BEYOND_ASCII and text.isascii())]


def pattern_spans(docs: DataFrame, id_: str, text: str, patterns: dict[str, list[str]] = PATTERNS) -> DataFrame:
    """Matches of all patterns with their places: (id, kind, match, start, end), ends excluded. Every pattern of a kind counts
    by itself. The table is read once, and each text is searched for all patterns where it is read; a null text has none."""
    listed = [(kind, p) for kind, ps in patterns.items() for p in ps]
    kind_of_id = docs.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = {p: re.compile(quick(p), re.ASCII) for _, p in listed}  # classes are of ASCII, as in the JVM
        for batch in batches:
            at, kinds, found, starts, ends = [], [], [], [], []
            for n, value in enumerate(batch.column(1)):
                t = value.as_py()
                can = set(searchable(list(searched), t)) if t is not None else ()
                for kind, p in listed if t is not None else ():
                    for m in searched[p].finditer(t) if p in can else ():
                        at.append(n)
                        kinds.append(kind)
                        found.append(m[0])
                        starts.append(m.start())
                        ends.append(m.end())
                if len(at) >= SPANS or n + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(found, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [id_, "kind", "match", "start", "end"])
                    at, kinds, found, starts, ends = [], [], [], [], []

    return docs.select(id_, F.col(text).alias("__text")).mapInArrow(run, f"`{id_}` {kind_of_id}, kind string, match string, start int, end int")


def entity_candidates(docs: DataFrame, id_: str, text: str, least: float = 0.6) -> DataFrame:
    """Candidates for entities: (id, match, start, end, type, confidence). Words of Latin letters are candidates of .8, if
    `least` admits that, matches of patterns of .9; of several at one place the surest stays, then the first by type."""
    listed = [(kind, p) for kind, ps in sorted(PATTERNS.items()) for p in ps] + ([("eng", "[A-Za-z]{2,}")] if least <= 0.8 else [])
    kind_of_id = docs.schema[id_].dataType.simpleString()
    made = f"`{id_}` {kind_of_id}, match string, start int, end int, type string, confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = {p: re.compile(quick(p), re.ASCII) for _, p in listed if p != "[A-Za-z]{2,}"} | {"[A-Za-z]{2,}": re.compile("[A-Za-z][A-Za-z]+")}
        for batch in batches:
            at, spans = [], []
            for n, t in enumerate(batch.column(1).to_pylist()):
                if t is not None:
                    can, best = set(searchable(list(searched), t)), {}
                    for kind, p in listed:  # the surest first, then by type
                        if p in can:
                            for m in searched[p].finditer(t):
                                best.setdefault(m.span(), kind)
                    at += [n] * len(best)
                    spans += [(t[a:b], a, b, kind, 0.8 if kind == "eng" else 0.9) for (a, b), kind in best.items()]
                if len(at) >= SPANS or n + 1 == batch.num_rows:
                    columns = zip(*spans, strict=True) if spans else ([],) * 5
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [id_, "match", "start", "end", "type", "confidence"])
                    at, spans = [], []

    rows = docs.select(id_, F.col(text).alias("__text"))
    # what a place is counts once a row; only rows that share an id have to meet
    shared = rows.groupBy(id_).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_).alias("__shared"))
    same = F.col(id_).eqNullSafe(F.col("__shared"))
    alone = rows.join(shared, same, "left_anti").mapInArrow(run, made)
    best = F.min(F.struct((-F.col("confidence")).alias("o"), "type"))
    several = rows.join(shared, same, "left_semi").mapInArrow(run, made).groupBy(id_, "match", "start", "end").agg(best.alias("b"))
    return alone.unionByName(several.select(id_, "match", "start", "end", F.col("b.type").alias("type"), (-F.col("b.o")).alias("confidence")))


def chinese_names(text: Column) -> Column:
    """Names of persons of two to four characters: by family name, by what stands before or after; each once."""
    all_ = lambda p, g=0: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    by_family = [all_(f"{x}[一-龯]{{1,2}}") for x in SURNAMES]
    called = [all_(p, 1) for p in CALLED_PATTERNS]
    return F.filter(F.array_distinct(F.concat(*by_family, *called, *[all_(p) for p in NAME_PATTERNS])), lambda n: F.length(n).between(2, 4))


def question_entities(text: Column, most: int = 15, tokenizer: Callable[[Column], Column] = words) -> Column:
    """Entities of a question: by suffix, names of persons, then other words of two characters or more that aren't numbers or
    NOT_ENTITIES; `most` at most. Chinese words come from the tokenizer (see `segments`)."""
    from .questions import entities

    tokens = F.array_sort(F.filter(tokenizer(text), lambda w: (F.length(w) >= 2) & ~w.isin(NOT_ENTITIES) & ~w.rlike(r"^[\d.,]+$")))
    surnames = F.regexp_extract_all(text, F.lit("([一-龯]{2,3})姓"), F.lit(1))
    return F.slice(F.array_distinct(F.concat(entities(text), chinese_names(text), tokens, surnames)), 1, most)


def is_page_furniture(text: Column) -> Column:
    """Whether a paragraph is a page number, a date line, a copyright or company line, or just short."""
    lower = F.lower(text)
    short = (F.length(text) < 30) & (F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) <= 5)
    has = lambda c, ws: F.exists(F.lit(ws), lambda w: F.contains(c, w))
    return lower.rlike(r"^(第\s*\d+\s*頁|page\s*\d+|\d+\s*/\s*\d+)$") | text.rlike(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}") | has(lower, COPYRIGHT_WORDS) | ((F.length(text) < 50) & has(text, COMPANY_WORDS)) | short


def cleaned_docx(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, _SPACE, " "), r"[^\p{L}\p{N}_\s，。！？；：「」『』（）【】《》〈〉|]", "")
    return stripped(out)


#: The steps of `cleaned_pdf`: pattern, replacement, and what a text in lower case must have for it ("": nothing; None: a
#: character beyond ASCII). Gaps are single spaces by then.
PDF_STEPS = [(f"([{CJK}])\\s+(?=[{CJK}])", r"\1", None), (r"\s+([，。！？；：])", r"\1", None), (r"([「『（【《〈])\s+", r"\1", None), (f"(\\d)\\s+([{CJK}])", r"\1\2", None), (f"([{CJK}])\\s+(\\d)", r"\1\2", None)]
PDF_STEPS += [(p, "", sign) for p, sign in zip(PAGE_MARKS, (None, "page", "/", "-", "[", "", ""), strict=True)]
PDF_STEPS += [(p, "", sign) for p, sign in zip(CLOSING_MARKS, ("copyright", None, None, None, "confidential", None), strict=True)]


def without_page_marks(text: str, steps: list[tuple[re.Pattern, str, str | None]]) -> str:
    for pattern, new, sign in steps:
        if not text.isascii() if sign is None else sign in text.lower():
            text = pattern.sub(new, text)
    return text


def cleaned_pdf(text: Column) -> Column:
    """Page text as one line: gaps within Chinese closed, page numbers, dates and what follows a copyright mark dropped."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        steps = [(re.compile(quick(p), re.ASCII), new, sign) for p, new, sign in PDF_STEPS]  # classes are of ASCII, as in the JVM
        return texts.map(lambda t: None if t is None else without_page_marks(_GAPS.sub(" ", t), steps))

    return stripped(F.regexp_replace(cut(text), r"[^\p{L}\p{N}_\s，。！？；：「」『』（）【】《》〈〉—–…－(),.!?;:\"']", ""))


def flattened_table(rows: Column) -> Column:
    """A table (array of rows of cells) as text: the non-blank cells of a row between bars, a line for each row that has
    some."""
    lines = F.transform(rows, lambda cells: F.array_join(F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != ""), " | "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def parsed_segmentation(response: Column) -> Column:
    """The words of an answer to a segmentation request: those of its first line with Chinese that is no heading, or else
    of its first line."""
    lines = F.filter(F.transform(F.split(F.trim(response), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    told = F.filter(lines, lambda x: x.rlike(f"[{CJK}]") & ~x.rlike("^(#|輸出：|結果：)"))
    line = F.coalesce(F.get(told, F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def duration(seconds: Column) -> Column:
    s = seconds.cast("double")
    one = lambda x: F.format_string("%.1f", x)
    whole = lambda x: F.floor(x).cast("string")
    minutes = F.concat(whole(s / 60), F.lit("m "), one(s - F.floor(s / 60) * 60), F.lit("s"))
    hours = F.concat(whole(s / 3600), F.lit("h "), whole((s - F.floor(s / 3600) * 3600) / 60), F.lit("m"))
    return F.when(s < 60, F.concat(one(s), F.lit("s"))).when(s < 3600, minutes).otherwise(hours)


def is_mostly_chinese(text: Column, least: float = 0.3) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[{CJK}]")) / F.nullif(F.length(text), F.lit(0)) >= least, F.lit(False))


def of_length(text: Column, n: int) -> Column:
    """The text repeated and cut to n characters; an empty one stays empty."""
    times = F.ceil(F.lit(n) / F.greatest(F.length(text), F.lit(1))).cast("int")
    return F.substr(F.repeat(text, times), F.lit(1), F.lit(n))


def embeddable(docs: DataFrame, text: str, most: int = 8192) -> DataFrame:
    """Rows with a text that isn't blank, stripped and of `most` characters at most."""
    bare = stripped(F.col(text))
    return docs.withColumn(text, F.substring(bare, 1, most)).where(F.col(text) != "")


def suggestions(partial: Column, most: int = 10) -> Column:
    """Questions that begin with what has been typed."""
    forms = [F.concat(partial, F.lit(x)) for x in ("是什麼？", "如何運作？", "有哪些特點？", "的主要功能是什麼？", "與其他的區別？")]
    return F.when(F.coalesce(F.trim(partial), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.slice(F.array(*forms), 1, most))
