"""The first segment cleans a text once, and cuts odd texts like plain loops do."""

import random
import re

from pyspark.sql import functions as F

from quarryline.operators import passages as P
from quarryline.operators import text as T

WHITE = "[" + P.WHITE_SPACE + "]"


def plain(text, size):
    if (text or "").strip(" ") == "":
        return ""
    kept = T.KEPT.replace(r"\s", "\t\n\x0b\x0c\r ")
    whole = re.sub(f"[^{kept}]", "", re.sub(WHITE + "+", " ", text)).replace("－", "—")
    whole = re.sub(r"([，。！？；：])\1+", r"\1", whole).strip(" \t\n\r，。！？；：")
    if len(whole) <= size:
        return whole
    out = ""
    for x in (y.strip(" ") for y in re.split(r"[。！？；\n]+", whole)):
        if len(x) >= 2:
            if out and len(out) + len(x) > size:
                break
            out += x + " "
    return out.strip(" ") or whole[:size]


def test_like_plain_loops(spark):
    rng = random.Random(7)
    letters = list(P.WHITE_SPACE) + list("aB9.，。。！？；：「中文－—-*@#é/ab cd\x00\x1f\x7f​﻿")
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 30, 300])))) for k in range(600)] + [(600, None), (601, "ab。" * 400), (602, "a" * 100)]
    frame = spark.createDataFrame(rows, "id int, t string").select("id", P.first_segment(F.col("t"), 40).alias("x"))
    got = dict(map(tuple, frame.collect()))
    assert got == {k: plain(t, 40) for k, t in rows}


def test_cleaned_once():
    assert str(P.first_segment(F.col("t"))).count("regexp_replace") <= 3
