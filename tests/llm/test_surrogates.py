"""Surrogates: one entity in several spellings, formats and checksums, gender, shared parts, distinctness, recall by type."""

import random
import re

from quarryline.llm import pii_surrogates as P


def replaced(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r.text for r in sorted(P.replace_entities(docs, key).collect(), key=lambda r: r.doc_id)]


def digits(text):
    return re.sub(r"\D", "", text)


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def test_one_phone_in_several_spellings(spark):
    spelled = ["+1 906 555 7738", "+19065557738", "+1 (906) 555-7738", "+1-906-555-7738"]
    out = replaced(spark, [f"call {p} now" for p in spelled] + ["call +49 30 1234567 now", "call +353 1 2345678 now", "call 030 1234567 now"])
    assert len({digits(t) for t in out[:4]}) == 1 and digits(out[0]).startswith("1") and digits(out[0]) != "19065557738"
    assert [re.sub(r"\d", "9", t) for t in out[:4]] == [re.sub(r"\d", "9", f"call {p} now") for p in spelled]
    assert out[4].startswith("call +49 ") and out[5].startswith("call +353 ") and out[6].startswith("call 0")


def test_accounts_and_security_numbers(spark):
    rng = random.Random(2)
    accounts = []
    for country in ("DE", "FR", "GB"):
        for _ in range(20):
            rest = ("WEST" if country == "GB" else "") + "".join(rng.choice("0123456789") for _ in range(18))
            accounts.append(f"{country}{98 - mod97(country + '00' + rest):02}{rest}")
    out = replaced(spark, [f"to {a} paid" for a in accounts] + ["to " + " ".join(re.findall("..?.?.?", accounts[0])) + " paid"])
    new = [t.split()[1] for t in out[:-1]]
    for a, b in zip(accounts, new, strict=True):
        assert a[:2] == b[:2] and a != b and mod97(b) == 1 and re.sub("[A-Z]", "A", re.sub(r"\d", "9", a)) == re.sub("[A-Z]", "A", re.sub(r"\d", "9", b))
    assert out[-1].replace(" ", "") == f"to{new[0]}paid" and len(set(new)) == len(new)
    ssn = [t.split()[1] for t in replaced(spark, [f"ssn {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} x" for _ in range(300)])]
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", s) for s in ssn)


def test_letter_case(spark):
    out = replaced(spark, ["to John.Doe@Example.com x", "to john.doe@example.com x", "to JOHN.DOE@EXAMPLE.COM x", "Mr SMITH here", "Mr Smith here"])
    a, b, c = (t.split()[1] for t in out[:3])
    assert a.lower() == b == c.lower() and c.isupper() and [x.isupper() for x in a] == [x.isupper() for x in "John.Doe@Example.com"]
    d, e = (t.split()[1] for t in out[3:])
    assert d.isupper() and d.capitalize() == e


def test_names(spark):
    out = replaced(spark, ["Mr. Smith met Mrs. Smith and Dr. Smith and Mr John Smith.", "Yours, signed Anna Jones\nend", "My name is Anna Jones.", "write to Anna Jones <anna.jones@mail.org> today", "Mein Name ist Jürgen Groß", "The New York Times and Anna Jones went", "Меня зовут Анна Иванова"])
    men, women, other, full = re.fullmatch(r"Mr\. (\w+) met Mrs\. (\w+) and Dr\. (\w+) and Mr (\w+ \w+)\.", out[0]).groups()
    assert men == women == other == full.split()[1]  # one surname, whoever bears it
    assert out[1].startswith("Yours, signed ") and "Anna" not in out[1] + out[2] + out[3] and "Jones" not in out[1] + out[2]
    name = out[1].removeprefix("Yours, signed ").removesuffix("\nend")
    assert out[2] == f"My name is {name}." and out[3].startswith(f"write to {name} <")
    assert "Jürgen" not in out[4] and "Иванова" not in out[6] and out[5] == "The New York Times and Anna Jones went"


def test_one_person_with_any_title_or_none(spark):
    texts = ["Mr John Smith wrote. Regards, John Smith", "Dr John Smith is here, and John too; ask JOHN or Smith's aide.", "Mr O'Brien and Mrs Anna D'Arcy; O'Brien left, Anna stayed", "John alone is nobody known here, Johnson neither", "Mr John F. Smith, Johnny and John"]
    out = replaced(spark, texts)
    given, last = re.fullmatch(r"Mr (\w+) (\w+) wrote\. Regards, (\w+) (\w+)", out[0]).groups()[:2]
    assert out[0] == f"Mr {given} {last} wrote. Regards, {given} {last}"
    assert out[1] == f"Dr {given} {last} is here, and {given} too; ask {given.upper()} or {last}'s aide."
    assert not re.search("Brien|Anna|Arcy", out[2])
    irish, anna = re.fullmatch(r"Mr (\S+) and Mrs (\w+) \S+; (\S+) left, (\w+) stayed", out[2]).group(1, 2)
    assert out[2].endswith(f"; {irish} left, {anna} stayed") and anna.endswith(("lia", "na", "rina", "sia"))
    assert out[3] == texts[3] and out[4].startswith(f"Mr {given} ") and out[4].endswith(f" {last}, Johnny and {given}")
    assert given.endswith(("ldo", "n", "rik", "s"))  # Mr tells, for all rows


def test_counts_and_clashes(spark):
    docs = spark.createDataFrame([(1, "Mr John Smith and John, or SMITH", "x", 7, "f", "m"), (2, None, "x", 7, "f", "m")], "doc_id long, text string, __found string, n_entities int, found string, row string")
    rows = sorted(P.replace_entities(docs, "k").collect(), key=lambda r: r.doc_id)
    assert [r.n_entities for r in rows] == [3, 0] and rows[0].asDict()["__found"] == "x" and (rows[0].found, rows[0].row) == ("f", "m")


def test_plain_numbers_and_addresses(spark):
    texts = ["call 5551234567 or 555-123-4567 now", "at 2001:db8:85a3:0:0:8a2e:370:7334 and fe80::1ff:fe23:4567:890a", "AT FE80::1FF:FE23:4567:890A", "at 12:30:45, std::vector, 1234567890 and 55512345678"]
    out = replaced(spark, texts)
    a, b = re.fullmatch(r"call (\d{10}) or (\d{3}-\d{3}-\d{4}) now", out[0]).groups()
    assert a == b.replace("-", "") != "5551234567"
    assert "db8" not in out[1] and "fe80" not in out[1] and out[1].split()[-1].upper() == out[2].split()[-1] and out[1].count(":") == texts[1].count(":")
    assert out[3] == texts[3]


def test_parts_stay_shared_after_redraws(spark):
    """So many surnames that some are drawn again: a name's parts still agree with the same parts elsewhere."""
    rng = random.Random(5)
    surnames = sorted({"".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))).capitalize() for _ in range(2500)})
    docs = spark.createDataFrame([(i, f"Mr {s} and Mr John {s}") for i, s in enumerate(surnames)], "doc_id long, text string").repartition(3)
    drawn = P.redraws(docs, "k").collect()
    assert drawn
    out = replaced(spark, [f"Mr {s} and Mr John {s}" for s in surnames])
    pairs = [re.fullmatch(r"Mr (\w+) and Mr (\w+) (\w+)", t).groups() for t in out]
    assert all(a == c for a, _, c in pairs) and len({b for _, b, _ in pairs}) == 1
    assert len({a for a, _, _ in pairs}) == len(surnames) and not {a for a, _, _ in pairs} & set(surnames)


def test_recall_by_type(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = {
        "email": lambda: f"{word(5)}.{word(4)}{num(1)}@{word(6)}.example.org",
        "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "card": lambda: f"4{num(3)}-{num(4)}-{num(4)}-{num(4)}",
        "ssn": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "iban": lambda: f"DE{num(20)}",
        "phone": lambda: rng.choice([f"+{rng.randint(1, 99)} {num(3)} {num(7)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}"]),
        "secret": lambda: rng.choice([f"AKIA{num(16)}", "".join(rng.choice("0123456789abcdef") for _ in range(40))]),
        "name": lambda: f"Frau {word(6).capitalize()} {word(7).capitalize()}",
        "person": lambda: f"signed {word(6).capitalize()} {word(7).capitalize()}",
    }
    planted = [(kind, make()) for kind, make in made.items() for _ in range(60)]
    out = replaced(spark, [f"some words {x} and more" for _, x in planted])
    for kind in made:
        lost = [x for (k, x), t in zip(planted, out, strict=True) if k == kind and x in t]
        assert not lost, (kind, lost)
