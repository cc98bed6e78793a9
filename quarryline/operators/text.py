"""Cleaning, splitting, measuring and matching of texts, Chinese ones in particular.

Java's white space class is ASCII only; where Unicode white space counts, the pattern says (?U).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Character classes, word lists and patterns that results depend on.
CJK = r"一-鿿"
KEPT = r"一-鿿㐀-䶿豈-﫿a-zA-Z0-9\s，。！？；：「」『』（）【】《》〈〉、…—－·‧"
CHINESE_PUNCTUATION = r"[，。！？；：「」『』（）【】《》〈〉、…—－·‧]"
#: The ASCII characters that KEPT hasn't, one by one: most characters are ASCII, and the long class is slow to say no.
ASCII_DROPPED = "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum() and chr(c) not in " \t\n\x0b\x0c\r")
#: Unicode white space but the space.
OTHER_SPACE = r"\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "this", "that", "these", "those",
]
COHERENCE_WORDS = [
    "但是", "然而", "因此", "所以", "而且", "並且", "另外", "此外", "首先", "其次", "最後", "總之",
]
PATTERNS = {
    "date": [r"\d{4}年\d{1,2}月\d{1,2}日", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{4}/\d{1,2}/\d{1,2}", r"\d{1,2}月\d{1,2}日"],
    "time": [r"\d{1,2}:\d{2}:\d{2}", r"\d{1,2}:\d{2}", r"\d{1,2}點\d{1,2}分", r"上午|下午|中午|凌晨"],
    "number": [r"\d+\.?\d*", r"[一二三四五六七八九十百千萬億]+"],
    "phone": [r"1[3-9]\d{9}", r"\d{3,4}-\d{7,8}", r"\(\d{3,4}\)\d{7,8}"],
    "email": [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"],
    "url": [r"https?://[^\s]+", r"www\.[^\s]+"],
    "money": [r"\d+\.?\d*元", r"￥\d+\.?\d*", r"\$\d+\.?\d*", r"\d+\.?\d*萬元", r"\d+\.?\d*億元"],
    "percent": [r"\d+\.?\d*%", r"百分之\d+\.?\d*"],
}
QUALITY_WEIGHTS = {"length": 0.15, "chinese_ratio": 0.15, "sentence_structure": 0.20, "vocabulary_richness": 0.15, "punctuation": 0.10, "coherence": 0.15, "special_chars": 0.10}


def clean(text: Column) -> Column:
    """White space to single spaces, characters beyond letters, digits and usual punctuation dropped, repeated marks
    collapsed, ends trimmed; null is empty."""
    out = single_spaces(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, f"[{ASCII_DROPPED}]+|(?![\\x00-\\x7f])[^{KEPT}]+", "")
    out = F.translate(out, "－", "—")
    out = F.regexp_replace(out, r"([，。！？；：])\1+", "$1")
    return F.btrim(out, F.lit(" \t\n\r，。！？；："))


def single_spaces(text: Column) -> Column:
    """Runs of Unicode white space as one space each. A space that stands alone isn't matched, as it is one."""
    return F.regexp_replace(text, f"[{OTHER_SPACE}][ {OTHER_SPACE}]*| [ {OTHER_SPACE}]+", " ")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once for each row, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalized_query(text: Column) -> Column:
    out = F.btrim(single_spaces(text))
    return F.translate(out, "?!,", "？！，")


def sentences(text: Column) -> Column:
    """Pieces between sentence ends and line ends, trimmed, of two characters at least."""
    return F.filter(F.transform(F.split(text, r"[。！？；\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 2)


def words(text: Column) -> Column:
    """Runs of Latin letters and digits, and single Chinese characters: the default for a tokenizer."""
    return F.regexp_extract_all(text, F.lit(rf"[a-zA-Z0-9]+|[{CJK}]"), F.lit(0))


#: The classes and separators for what is counted in Python, where \\s and \\d are wider than in the JVM.
_KEPT = KEPT.replace(r"\s", " \t-\r")
_SPACES = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]:0>4}", OTHER_SPACE) + " ]+")
_DROPPED, _REPEATED, _ENDS = re.compile(f"[^{_KEPT}]+"), re.compile(r"([，。！？；：])\1+"), re.compile(r"[。！？；\n]+")
_WORD, _LATIN, _CJK, _MARK = (re.compile(p) for p in (f"[a-zA-Z0-9]+|[{CJK}]", "[a-zA-Z][a-zA-Z]*", f"[{CJK}]", CHINESE_PUNCTUATION))
_SPECIAL = re.compile(f"[^{_KEPT}]")
COUNTED = ["char_count", "word_count", "sentence_count", "paragraph_count", "chinese_char_count", "english_word_count", "punctuation_count", "n_distinct", "n_special", "n_links"]


def cleaned(text: str | None) -> str:
    """`clean` of one text."""
    out = _DROPPED.sub("", _SPACES.sub(" ", text or "")).replace("－", "—")
    return (out if out.isascii() else _REPEATED.sub(r"\1", out)).strip(" \t\n\r，。！？；：")


def cut_sentences(text: str) -> list[str]:
    """`sentences` of one text."""
    return [x for x in (x.strip(" ") for x in _ENDS.split(text)) if len(x) >= 2]


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTED of one text; null is empty. Each is one pass, and ASCII has nothing Chinese to count."""
    t = text or ""
    found, plain = _WORD.findall(t), t.isascii()
    lines = sum(x.strip(" ") != "" for x in t.split("\n"))
    counts = (0, 0, 0) if plain else (len(_CJK.findall(t)), len(_MARK.findall(t)), sum(w in t for w in COHERENCE_WORDS))
    return len(t), len(found), len(cut_sentences(t)), lines, counts[0], len(_LATIN.findall(t)), counts[1], len(set(found)), len(_SPECIAL.findall(t)), counts[2]


def _counted(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{c} int" for c in COUNTED))
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_text(t) for t in texts], columns=COUNTED, dtype="int32")

    return count(text)


def statistics(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """Counts of characters, words, sentences, paragraphs, Chinese characters, English words and punctuation."""
    counted = docs.select(id_, _counted(F.col(text)).alias("c")).select(id_, *[f"c.{c}" for c in COUNTED[:7]])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.withColumns({"avg_sentence_length": F.round(ratio("char_count", "sentence_count"), 6), "avg_word_length": F.round(ratio("chinese_char_count", "word_count"), 6)})


def quality(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """The weighted sum of seven scores of a text, and its level."""
    s = docs.select(id_, _counted(F.col(text)).alias("c")).select(id_, "c.*")
    n, k = F.col("char_count"), F.col("sentence_count")
    chinese = F.when(n > 0, F.col("chinese_char_count") / n).otherwise(0.0)
    marks = F.when(n > 0, F.col("punctuation_count") / n).otherwise(0.0)
    mean = F.when(k > 0, n / k).otherwise(0.0)
    scores = {
        "length": F.when(n < 50, 0.3).when(n > 10000, 0.8).otherwise(1.0),
        "chinese_ratio": F.when(chinese < 0.3, 0.5).otherwise(F.least(F.lit(1.0), chinese * 1.2)),
        "sentence_structure": F.when(k == 0, 0.0).when(mean < 5, 0.4).when(mean > 100, 0.6).otherwise(1.0),
        "vocabulary_richness": F.when(F.col("word_count") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("n_distinct") / F.col("word_count") * 2)),
        "punctuation": F.when(marks < 0.02, 0.3).when(marks > 0.15, 0.6).otherwise(1.0),
        "coherence": F.when(k > 5, F.least(F.lit(1.0), F.col("n_links") / (k * 0.1))).otherwise(0.8),
        "special_chars": F.when(F.col("n_special") > n * 0.05, 0.5).otherwise(1.0),
    }
    total = sum((scores[x] * w for x, w in QUALITY_WEIGHTS.items()), F.lit(0.0))
    level = F.when(total >= 0.9, "excellent").when(total >= 0.7, "good").when(total >= 0.5, "fair").otherwise("poor")
    return s.select(id_, F.round(total, 6).alias("overall_score"), level.alias("quality_level"))


def window_chunks(docs: DataFrame, id_: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of fixed size with overlap for texts without a Chinese full stop, in closed form: (id, chunk_index, chunk)."""
    t = F.col(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(t) - overlap - 1), F.lit(size - overlap))
    rows = docs.where(F.length(t) > 0).select(id_, text, F.posexplode(starts).alias("chunk_index", "start"))
    return rows.select(id_, "chunk_index", F.substr(t, F.col("start") + 1, F.lit(size)).alias("chunk"))


def sentence_chunks(text: Column, size: int = 1000) -> Column:
    """Sentences packed in order into chunks of at most `size` characters (a longer sentence is one)."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, sentence: Column) -> Column:
        fits = (F.length(state["open"]) == 0) | (F.length(state["open"]) + F.length(sentence) + 1 <= size)
        joined = F.when(F.length(state["open"]) == 0, sentence).otherwise(F.concat(state["open"], F.lit(" "), sentence))
        return F.struct(F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"), F.when(fits, joined).otherwise(sentence).alias("open"))

    return F.aggregate(sentences(text), empty, add, lambda s: F.when(F.length(s["open"]) > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def pattern_counts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """How many matches of each type of pattern a text has, all patterns of the type added up."""
    return docs.select(id_, *[sum((F.regexp_count(F.col(text), F.lit(p)) for p in ps), F.lit(0)).alias(kind) for kind, ps in PATTERNS.items()])


def pattern_matches(docs: DataFrame, id_: str, text: str, kind: str) -> DataFrame:
    parts = [docs.select(id_, F.explode(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).alias("match")) for p in PATTERNS[kind]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keywords(text: Column, most: int = 10) -> Column:
    """The first words of more than two characters that aren't stop words, without ASCII punctuation."""
    bare = F.regexp_replace(text, r"[!-/:-@\[-`{-~]", "")
    found = F.filter(F.split(F.lower(bare), r"(?U)\s+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return F.slice(found, 1, most)


def frequent_words(docs: DataFrame, id_: str, text: str, most: int = 20, least_len: int = 2) -> DataFrame:
    """Each document's most frequent words with their share of its words; ties in alphabetical order."""
    long = docs.select(id_, F.explode(words(F.lower(F.col(text)))).alias("word")).where(F.length("word") >= least_len)
    counts = long.groupBy(id_, "word").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(id_))
    place = F.row_number().over(W.partitionBy(id_).orderBy(F.desc("n"), "word"))
    return counts.select(id_, "word", "n", F.round(F.col("n") / total, 6).alias("weight"), place.alias("place")).where(F.col("place") <= most)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the characters of two strings; 0 if either is empty."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def strip_markup(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\n\s*\n", "\n\n")


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def file_size(size: Column) -> Column:
    """Bytes in the largest unit that leaves one at least, to two places."""
    step = F.when(size <= 0, 0).otherwise(F.least(F.lit(4), F.floor(F.log2(size.cast("double")) / 10 + 1e-12)))
    return F.when(size <= 0, "0 B").otherwise(F.concat(F.round(size / F.pow(F.lit(1024.0), step), 2).cast("string"), F.lit(" "), F.element_at(F.lit(["B", "KB", "MB", "GB", "TB"]), (step + 1).cast("int"))))


def chinese_weight(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.least(F.lit(1.3), 1 + 0.3 * F.regexp_count(text, F.lit(f"[{CJK}]")) / n)).otherwise(1.0)


def edit_matches(names: DataFrame, queries: DataFrame, most: int = 2) -> DataFrame:
    """Names within min(`most`, half the query's length) edits of a query: (query, name, distance).

    A query is cut into `most` + 1 pieces, as even as can be. So many edits leave one of them whole, and in a name, which is
    at most `most` characters longer or shorter, it begins at most `most` characters earlier or later: the join is on the
    query's length, the piece's number and the piece, `most` + 1 rows a query and (2 * `most` + 1) ^ 2 times as many a name,
    each of a share of its characters. Only names of about the length of some query are taken apart, each within its row, so
    that no task holds the pieces. The distance is checked after. A query shorter than `most` + 1 characters has an empty
    piece, which all names of about its length share.
    """
    shifts = F.sequence(F.lit(-most), F.lit(most))
    bound = lambda n, i: F.floor(n * i / (most + 1)).cast("int")
    size = lambda n, i: bound(n, i + 1) - bound(n, i)
    n = F.length("query")
    own = F.array(*[F.struct(F.lit(i).alias("i"), F.substr("query", bound(n, i) + 1, size(n, i)).alias("piece")) for i in range(most + 1)])
    asked = queries.select("query").distinct().select("query", n.alias("n"), F.explode(own).alias("s")).select("query", "n", "s.*")
    lengths = F.broadcast(queries.select(n.alias("n")).distinct())  # a row a length
    of = names.select("name").distinct().select("name", F.explode(F.transform(shifts, lambda d: F.length("name") + d)).alias("n")).where("n >= 0").join(lengths, "n", "left_semi")
    n = F.col("n")

    def spans(i: int) -> Column:
        starts = F.filter(F.transform(shifts, lambda d: bound(n, i) + d), lambda at: at >= 0)
        return F.transform(starts, lambda at: F.struct(F.lit(i).alias("i"), F.substr("name", at + 1, size(n, i)).alias("piece")))

    told = of.select("name", "n", F.explode(F.array_distinct(F.concat(*[spans(i) for i in range(most + 1)]))).alias("s")).select("name", "n", "s.*")
    pairs = asked.join(told, ["n", "i", "piece"]).select("query", "name").distinct()
    limit = F.least(F.lit(most), F.floor(F.length("query") / 2))
    far = F.levenshtein("query", "name", most)  # -1 beyond; in time that grows with the length
    return pairs.select("query", "name", far.alias("distance"), limit.alias("limit")).where("distance BETWEEN 0 AND limit").drop("limit")


def scores(docs: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Precision, recall and F1 of a prediction."""
    hit = docs.select(predicted.alias("p"), actual.alias("a")).agg(F.count_if(F.col("p") & F.col("a")).alias("tp"), F.count_if(F.col("p")).alias("np"), F.count_if(F.col("a")).alias("na"))
    p, r = F.col("tp") / F.col("np"), F.col("tp") / F.col("na")
    return hit.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))
