"""Lengths and texts beyond the sizes that the operators take at once, against brute force."""

import itertools
import random
import tracemalloc

import pytest

from quarryline.llm import lang_parse, mixture_fit


def words_of(lengths, taken):
    return sum(n * t for n, t in zip(lengths, taken, strict=True))


@pytest.mark.parametrize(
    ("lengths", "counts", "budget", "want"),
    [([70000, 71000, 500000], [1, 1, 1], 72000, 71000), ([66000, 70000, 500000], [1, 3, 1], 140000, 140000), ([500000], [1], 200000, 0), ([500000], [1], 300000, 500000), ([], [], 5, 0), ([0, 3], [2, 0], 5, 0)],
)
def test_long_documents(lengths, counts, budget, want):
    assert words_of(lengths, mixture_fit.fit_lengths(lengths, counts, budget)) == want


def test_fit_as_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        lengths = rng.sample(range(1, rng.choice([20, 200, 90_000])), rng.randint(1, 4))
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 3 * max(lengths))
        taken = mixture_fit.fit_lengths(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        best = min(abs(words_of(lengths, t) - budget) for t in itertools.product(*[range(c + 1) for c in counts]))
        assert abs(words_of(lengths, taken) - budget) == best


def test_many_long_lengths():
    rng = random.Random(2)
    lengths = sorted({rng.randint(100_000, 400_000) for _ in range(1500)})
    assert abs(words_of(lengths, mixture_fit.fit_lengths(lengths, [1] * len(lengths), 77_777_777)) - 77_777_777) <= 10


def brute_parse(text, sample):
    n = at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, max(end, at + 1)
    return n


def test_parse_of_long_texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeéü ") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    samples = {g: " ".join(rng.choice(words[k * 10 : k * 10 + 50]) for _ in range(400)).encode() for k, g in enumerate("abc")}
    parser = lang_parse.Parser(samples)
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 300, 800, 3000]))).encode() for _ in range(20)]
    texts += [samples["a"] * 2, b"a" * 5000, b"zzz" * 900, b"", b"\xff" * 2000, samples["b"][:1024], samples["b"][:2048]]
    for t, counts in zip(texts, parser.phrases(texts), strict=True):
        assert counts.tolist() == [brute_parse(t, samples[g]) for g in parser.langs]


def test_bounded_samples(spark):
    """A stretch of each text, however long all texts of a language are; the bounds hold for one language and for all."""
    texts = [(i, f"some words of text number {chr(97 + i % 26)} " * (1 + i % 40), "en") for i in range(300)] + [(1001 + i, "langer text " * 150_000, "fr") for i in range(8)] + [(1100, "1", "es"), (None, "verloren", "it")]
    docs = spark.createDataFrame(texts + [(k, "kurz", "de") for k in range(2000, 2050)], "doc_id long, text string, lang string")
    found = lang_parse.fit_samples(docs)
    assert set(found) == {"en", "de", "fr"} and found["de"] == b"kurz" and 8_000 < len(found["en"]) <= 16_384 and 900 <= len(found["fr"]) <= 8 * 1025
    whole = {" ".join(t.lower().split()) + " " for _, t, _ in texts}
    assert all(len(t) <= 1024 and any(t in w for w in whole) for t in found["en"].decode().split("\n")[:-1])
    assert sum(map(len, lang_parse.fit_samples(docs, all_bytes=3_000).values())) <= 3_000


def test_few_huge_documents():
    """Sums of few documents of many words: near the budget, in little memory."""
    rng = random.Random(3)
    lengths = [20_000_000 + rng.randint(0, 999_999) for _ in range(40)]
    budget = 307_234_567
    tracemalloc.start()
    taken = mixture_fit.fit_lengths(lengths, [1] * 40, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(taken) <= {0, 1} and abs(words_of(lengths, taken) - budget) < 40_000 and peak < 200_000_000


def test_many_steps():
    """More steps of the programme than are kept between two sums."""
    lengths = [2 * n for n in range(1000, 1400)]
    for budget in (77_777, 123_457, 5):
        taken = mixture_fit.fit_lengths(lengths, [1] * len(lengths), budget)
        assert abs(words_of(lengths, taken) - budget) == (1 if budget > 5 else 5)
