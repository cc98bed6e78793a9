"""Surrogates for personal data, by DataFrame functions only.

Entities are found by one pattern. Each has a canonical form, whatever way it is written: an address in lower case, a
number's digits, a secret's value, a name's parts, whatever title they come with. A keyed hash of type and canonical form
gives the canonical form of its replacement, for a name in the gender that the titles of the whole corpus tell, and it is
then written as the entity is, in its spelling, letter case and format. So the same entity always gets the same replacement
(coreference), and distinctness needs checking once for each entity: replacements that two share, or that an entity of the
corpus is itself, are drawn again until none are. Where a text names a person, parts of that name that stand alone in the
same text are replaced too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_LABEL = r"(?i:password|passwd|secret|api[_-]?key|token)[\"']?\h*+[=:]\h*+[\"']?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: A part of a name: a capital and letters, an apostrophe before another capital; between parts an initial may stand.
_PART = r"\p{Lu}(?:\p{L}*+['’](?=\p{Lu}))?+\p{L}++"
_MORE = rf"(?:[ -](?:\p{{Lu}}\. )?{_PART})"
_FULL_NAME = rf"{_PART}{_MORE}{{1,2}}"
_HEX = "[0-9A-Fa-f]{1,4}"
# What a full name without a title follows, in the languages of the titles.
_INTRODUCED = "signed|Signed|sincerely|Sincerely|regards|Regards|my name is|My name is|mein Name ist|Mein Name ist|je m'appelle|Je m'appelle|me llamo|Me llamo|mi nombre es|Mi nombre es|меня зовут|Меня зовут|Name|name"
#: Type and pattern, in order of preference where several match at one place. All start where a word does, and runs give
#: nothing back, so the time grows with the text.
TYPES = {
    "email": r"(?<![.%+-])[\w.%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z0-9-]++",
    "ip": rf"(?=\d)(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "ipv6": rf"(?=[0-9A-Fa-f])(?<!:)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:)(?![\w:])",
    "card": r"(?=\d)(?<!-)(?:\d{4}[ -]?){3}\d{1,7}(?![\w-])",
    "ssn": r"(?=\d)(?<!-)\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?=[\d+(])(?<![+(])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}[ .-]?\d{2,4}(?:[ .-]?\d{2,4})?|\+\d{7,15}|[2-9]\d{9})(?!\w)",
    "secret": rf"(?=[PpSsAaTt]){_LABEL}[^\s\"']{{6,}}|AKIA[A-Z0-9]{{16}}(?!\w)|[0-9A-Fa-f]{{32,64}}(?!\w)",
    "name": r"(?=[MDHFSГ])(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Señora|Señor|Sra|Sr|Monsieur|Madame|Mme|Господин|Госпожа)\.? " + _PART + _MORE + "{0,2}",
    "person": rf"(?=\p{{Lu}})(?:(?<=(?:{_INTRODUCED})[,:]?[ \n]){_FULL_NAME}|{_FULL_NAME}(?= <[\w.+-]{{1,64}}@))",
}
PATTERN = r"(?<![\p{L}\w])(?:" + "|".join(TYPES.values()) + ")"
# Titles of women; names are made of syllables, with endings by gender.
WOMEN = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Госпожа"
MEN = "Mr|Herr|Señor|Sr|Monsieur|Господин"
SYLLABLES = {"latin": "ba be bo da de do ga ka ke la le lo ma me mo na ne ni ra re ri ro sa se ta to va ve vi zo".split(), "cyrillic": "ба ве во га да до за ка ко ла ле ло ма ми мо на не ни па по ра ре ри ро са се та то ту фа".split()}
ENDINGS = {("latin", "f"): "lia na rina sia".split(), ("latin", "m"): "ldo n rik s".split(), ("cyrillic", "f"): "ва на рина ская".split(), ("cyrillic", "m"): "в н рик ский".split()}
DEFAULT_KEY = "surrogates"


# Calling codes of one and two digits; all others have three.
CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: What is kept of a phone number's canonical form: the plus sign and calling code, and a leading zero.
_KEPT = rf"^(\+(?:{CODES})|\+\d{{3}}|0?)"


def kind_of(found: Column) -> Column:
    out = F.when(found.rlike(rf"^{_FULL_NAME}$"), F.lit("name")).otherwise(F.lit("phone"))
    for name, pattern in reversed(TYPES.items()):
        if name != "person":  # told by what stands around it
            out = F.when(found.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def value_of(found: Column) -> Column:
    """A secret without its label."""
    return F.regexp_replace(found, f"^{_LABEL}", "")


def title_of(found: Column) -> Column:
    return F.regexp_extract(found, rf"^((?:{WOMEN}|{MEN}|Dr)\.? )", 1)


def parts_of(found: Column) -> Column:
    """The parts of a name without its title."""
    return F.split(F.substr(found, F.length(title_of(found)) + 1), "[ -]")


def entities_of(found: Column, kind: Column) -> Column:
    """The canonical forms of a match, an array of (entity, gender): of a name its parts, else one. Case and separators are
    aside where the type has none that matter; a hexadecimal secret counts in either case. A title tells the gender (f, m)
    of all parts but a surname in Latin letters, which has none; other entities have none."""
    value = value_of(found)
    digits = F.regexp_replace(found, r"[^\p{L}\p{N}]", "")
    one = (
        F.when(kind.isin("email", "ipv6"), F.lower(found))
        .when(kind.isin("card", "ssn", "iban"), digits)
        .when(kind == "phone", F.concat(F.when(F.startswith(found, F.lit("+")), "+").otherwise(""), digits))
        .when(kind == "secret", F.when(value.rlike("^[0-9A-Fa-f]{32,}$"), F.lower(value)).otherwise(value))
        .otherwise(found)
    )
    parts, none = parts_of(found), F.lit(None).cast("string")
    told = F.when(found.rlike(rf"^(?:{WOMEN})\b"), "f").when(found.rlike(rf"^(?:{MEN})\b"), "m")
    named = F.transform(parts, lambda p, i: F.struct(F.initcap(F.lower(p)).alias("entity"), F.when((i < F.size(parts) - 1) | p.rlike(r"\p{IsCyrillic}"), told).otherwise(none).alias("gender")))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(one.alias("entity"), none.alias("gender"))))


def stream(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that only who has the key can tell."""
    base = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), entity)
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(str(n)), base), 256) for n in range(4)])


def number(hexes: Column, at: Column) -> Column:
    """The number of the four digits from place `at` (taken around) on."""
    return F.conv(F.substr(hexes, F.pmod(at * 4, F.lit(252)) + 1, F.lit(4)), 16, 10).cast("int")


def scrambled(text: Column, hexes: Column, from_: int = 0) -> Column:
    """Each letter and digit from place `from_` on replaced by another of its case, script or kind; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = number(hexes, i)
        pick = lambda letters: F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))
        return (
            F.when(i < from_, c)
            .when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike(r"\p{Lu}") & c.rlike(r"\p{IsCyrillic}"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
            .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя"))
            .when(c.rlike(r"\p{L}"), pick("àáâãäåæçèéêëìíîïñòóôõöøùúûüý"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn_valid(card: Column) -> Column:
    """Digits whose last is set so that the checksum holds."""
    digits = F.split(card, "")
    size = F.size(digits)

    def add(total: Column, pair: Column) -> Column:
        d = pair["d"].cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((size - pair["i"]) % 2 == 0, twice).otherwise(d)

    body = F.transform(F.slice(digits, 1, size - 1), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.concat(F.array_join(F.slice(digits, 1, size - 1), ""), (F.pmod(F.lit(10) - F.aggregate(body, F.lit(0), add) % 10, F.lit(10))).cast("string"))


def iban_valid(account: Column) -> Column:
    """An account number whose two digits after the country are set so that the remainder by 97 is 1."""
    country, rest = F.substr(account, F.lit(1), F.lit(2)), F.substr(account, F.lit(5))
    values = F.transform(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: F.conv(c, 36, 10).cast("int"))
    left = F.aggregate(values, F.lit(0), lambda r, v: F.when(v > 9, r * 100 + v).otherwise(r * 10 + v) % 97)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def name_part(part: Column, gender: Column, hexes: Column) -> Column:
    def made(script: str) -> Column:
        syllables = F.lit(SYLLABLES[script])
        pick = lambda place: F.element_at(syllables, number(hexes, F.lit(place)) % len(SYLLABLES[script]) + 1)
        end = lambda g: F.element_at(F.lit(ENDINGS[script, g]), number(hexes, F.lit(9)) % 4 + 1)
        return F.initcap(F.concat(*[pick(n) for n in range(4)], F.when(gender == "f", end("f")).when(gender == "m", end("m")).otherwise(F.lit(""))))

    return F.when(part.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(part.rlike(r"^[\p{IsLatin}]+$"), made("latin")).otherwise(scrambled(part, hexes))


def replacement(kind: Column, entity: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an entity's replacement."""
    made = F.transform(F.array(stream(key, kind, entity, attempt)), lambda hexes: _replacement(kind, entity, gender, hexes))
    return F.element_at(made, 1)


def _replacement(kind: Column, entity: Column, gender: Column, hexes: Column) -> Column:
    n = lambda place: number(hexes, F.lit(place))
    octets = F.concat_ws(".", (n(0) % 223 + 1).cast("string"), *[(n(k) % 256).cast("string") for k in (1, 2, 3)])
    ssn = F.concat(F.lpad((n(0) % 665 + 1).cast("string"), 3, "0"), F.lpad((n(1) % 99 + 1).cast("string"), 2, "0"), F.lpad((n(2) % 9999 + 1).cast("string"), 4, "0"))
    end = F.regexp_extract(entity, r"(\.[a-z0-9-]+)$", 1)
    email = F.concat(scrambled(F.substr(entity, F.lit(1), F.length(entity) - F.length(end)), hexes), end)
    kept = F.regexp_extract(entity, _KEPT, 1)
    phone = F.concat(kept, scrambled(F.substr(entity, F.length(kept) + 1), hexes))
    secret = F.when(entity.rlike("^[0-9a-f]{32,}$"), F.substr(hexes, F.lit(1), F.length(entity))).when(entity.rlike("^AKIA"), scrambled(entity, hexes, 4)).otherwise(scrambled(entity, hexes))
    hexadecimal = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substr(hexes, F.pmod(i * 3, F.lit(250)) + 1, F.lit(1)))), "")
    return (
        F.when(kind == "email", email)
        .when(kind == "ipv6", hexadecimal)
        .when(kind == "ip", octets)
        .when(kind == "card", luhn_valid(scrambled(entity, hexes, 1)))
        .when(kind == "ssn", ssn)
        .when(kind == "iban", iban_valid(scrambled(entity, hexes, 2)))
        .when(kind == "phone", phone)
        .when(kind == "secret", secret)
        .otherwise(name_part(entity, gender, hexes))
    )


def refilled(shape: Column, filling: Column) -> Column:
    """`shape` with its letters and digits replaced in turn by the characters of `filling`."""
    tokens = F.split(shape, "")
    marks = F.transform(tokens, lambda c: c.rlike(r"[\p{L}\p{N}]").cast("int"))
    upto = F.transform(tokens, lambda c, i: F.aggregate(F.slice(marks, 1, i + 1), F.lit(0), lambda a, b: a + b))
    return F.array_join(F.zip_with(tokens, upto, lambda c, n: F.when(c.rlike(r"[\p{L}\p{N}]"), F.substr(filling, n, F.lit(1))).otherwise(c)), "")


def cased(shape: Column, lower: Column) -> Column:
    """`lower`, which is as long as `shape`, with capitals where `shape` has them. Where all letters of `shape` are
    capitals all are, as letters and digits of hexadecimal text aren't at the same places."""
    each = F.array_join(F.zip_with(F.split(shape, ""), F.split(lower, ""), lambda s, c: F.when(s.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return F.when(~shape.rlike(r"\p{Lu}"), lower).when(~shape.rlike(r"\p{Ll}"), F.upper(lower)).otherwise(each)


def in_case(part: Column, new: Column) -> Column:
    return F.when((F.length(part) > 1) & ~part.rlike(r"\p{Ll}"), F.upper(new)).otherwise(new)


def written(found: Column, kind: Column, new: Column) -> Column:
    """Replacements in the way that the match is written; `new` are their canonical forms."""
    one = F.element_at(new, 1)
    value = value_of(found)
    label = F.substr(found, F.lit(1), F.length(found) - F.length(value))
    secret = F.when(value.rlike("^[0-9A-Fa-f]{32,}$"), cased(value, one)).otherwise(one)
    title = title_of(found)
    bare = F.substr(found, F.length(title) + 1)
    spaces = F.regexp_extract_all(bare, F.lit("[ -]"), F.lit(0))
    parts = F.zip_with(parts_of(found), new, in_case)
    name = F.array_join(F.flatten(F.zip_with(parts, F.concat(spaces, F.array(F.lit(""))), lambda p, s: F.array(p, s))), "")
    return (
        F.when(kind.isin("email", "ipv6"), cased(found, one))
        .when(kind == "ip", one)
        .when(kind.isin("card", "ssn", "iban"), refilled(found, one))
        .when(kind == "phone", refilled(found, F.regexp_replace(one, r"^\+", "")))
        .when(kind == "secret", F.concat(label, secret))
        .otherwise(F.concat(title, name))
    )


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


#: Entities of a task that computes replacements.
DEALT = 2_000


def found_in(docs: DataFrame) -> DataFrame:
    """(row, text_md5, found): the rows whose text has matches, as a written table; `row` holds all columns, so none clashes."""
    rows = docs.select(F.struct("*").alias("row"), F.md5("text").alias("text_md5"), matches(F.col("text")).alias("found"))
    return materialize(rows.where(F.size("found") > 0))


def mentions(hits: DataFrame) -> DataFrame:
    """(text_md5, pos, found, kind, part, entity, gender): the entities of the matches of each different text, as a written table."""
    once = hits.select("text_md5", "found").dropDuplicates(["text_md5"]).select("text_md5", F.posexplode("found").alias("pos", "found"))
    typed = once.withColumn("kind", kind_of(F.col("found")))
    return materialize(typed.select("*", F.posexplode(entities_of(F.col("found"), F.col("kind"))).alias("part", "u")).select("text_md5", "pos", "found", "kind", "part", "u.entity", "u.gender"))


def known(each: DataFrame) -> DataFrame:
    """The different entities with the gender that the titles of all mentions agree on: f, m, or n."""
    said = lambda g: F.coalesce(F.max(F.col("gender") == g), F.lit(False))
    return each.groupBy("kind", "entity").agg(said("f").alias("f"), said("m").alias("m")).select("kind", "entity", F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("n").alias("gender"))


def redraws(docs: DataFrame, key: str) -> DataFrame:
    """The entities of all texts that were drawn again, with their attempts."""
    return drawn(known(mentions(found_in(docs))), key).where("attempt > 0").select("kind", "entity", "attempt")


def drawn(entities: DataFrame, key: str, most_rounds: int = 20) -> DataFrame:
    """The replacement of each entity (kind, entity, gender): (kind, entity, gender, attempt, given). Those whose first one is
    another's too, or is an entity itself, are drawn again until each has its own."""
    now = materialize(entities.withColumn("attempt", F.lit(0)))
    # a row is small but its replacement takes long: dealt by number, after the reading, which would put all into few tasks
    tasks = -(-now.count() // DEALT)
    names = now.select(F.col("kind").alias("k"), F.col("entity").alias("e"))
    for _ in range(most_rounds):
        dealt = now.repartition(max(1, tasks), "entity")
        marked = materialize(dealt.withColumn("given", replacement(F.col("kind"), F.col("entity"), F.col("gender"), F.col("attempt"), key)))
        # of those that share one the first keeps it, unless an entity is called so
        keeper = marked.groupBy("kind", "given").agg(F.min("entity").alias("keeper"), F.count("*").alias("n"))
        shared = marked.join(keeper.where("n > 1"), ["kind", "given"]).where(F.col("entity") != F.col("keeper")).select("kind", "entity")
        taken = marked.join(names, (marked["kind"] == names["k"]) & (marked["given"] == names["e"]), "left_semi").select("kind", "entity")
        again = materialize(shared.unionByName(taken).distinct().withColumn("again", F.lit(1)))
        if not again.take(1):
            return marked
        now = materialize(marked.drop("given").join(again, ["kind", "entity"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again"))
    raise RuntimeError("too many entities share a surrogate")


def _alone(part: Column) -> Column:
    """Where a part of a name stands by itself."""
    return F.concat(F.lit(r"(?<![\p{L}\w])\Q"), part, F.lit(r"\E(?![\p{L}\w])"))


def replace_entities(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """Replace the personal data in `text`; adds n_entities, keeps the other columns and all rows.

    E-mail and IP addresses, card, social security, bank account and phone numbers, secrets, names after a title and full
    names that are introduced or stand before an address get surrogates, and so do the parts of these names (two letters or
    more) elsewhere in the same text. Numbers keep their calling code, country or first digit and hold their checksums;
    entities of one spelling or another, and the parts that names share whatever their titles, get the same surrogates in
    all rows, different entities of a type different ones. A name's gender is what all titles that it has in the table agree
    on. Null texts stay null and empty ones empty, with 0 entities. A column named n_entities in the input is replaced.
    """
    hits = found_in(docs)
    each = mentions(hits)
    given = drawn(known(each), key).select("kind", "entity", "given")
    of = each.join(given, ["kind", "entity"]).groupBy("text_md5", "pos", "found", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "given"))), lambda x: x["given"]).alias("new"))
    spelled = F.flatten(F.zip_with(parts_of(F.col("found")), "new", lambda p, n: F.transform(F.array(p, F.initcap(F.lower(p)), F.upper(p)), lambda v: F.struct(v.alias("old"), in_case(v, n).alias("new")))))
    named = F.when(F.col("kind") == "name", F.filter(spelled, lambda x: x["old"].rlike(r"^\p{L}['’\p{L}]+$"))).otherwise(F.filter(spelled, lambda x: F.lit(False)))
    by_text = of.select("text_md5", F.struct("pos", written(F.col("found"), F.col("kind"), F.col("new")).alias("new")).alias("m"), named.alias("named"))
    by_text = by_text.groupBy("text_md5").agg(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["new"]).alias("new"), F.array_distinct(F.flatten(F.collect_list("named"))).alias("named"))

    text = F.col("row.text")
    has = hits.join(by_text, "text_md5").select("row", "found", "new", "named", F.split(text, PATTERN, -1).alias("between"))
    # the parts of names that stand alone between the matches
    there = F.array_distinct(F.flatten(F.transform("between", lambda b: F.regexp_extract_all(b, F.lit(_PART), F.lit(0)))))
    has = has.withColumn("met", F.when(F.size("named") > 0, F.array_intersect(F.transform("named", lambda x: x["old"]), there)))
    has = has.withColumn("alone", F.filter("named", lambda x: F.array_contains("met", x["old"])))
    any_in = lambda b: F.exists("alone", lambda x: F.contains(b, x["old"]))
    swapped = F.transform("between", lambda b: F.when(any_in(b), F.aggregate("alone", b, lambda t, x: F.regexp_replace(t, _alone(x["old"]), x["new"]))).otherwise(b))
    more = F.aggregate("between", F.lit(0), lambda n, b: n + F.when(any_in(b), F.aggregate("alone", F.lit(0), lambda k, x: k + F.regexp_count(b, _alone(x["old"])))).otherwise(0))
    some = F.coalesce(F.size("alone") > 0, F.lit(False))
    pieces = F.when(some, swapped).otherwise(F.col("between"))
    put = F.array_join(F.flatten(F.zip_with(pieces, "new", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    kept = [c for c in docs.columns if c != "n_entities"]
    replaced = has.select(*[put.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in kept], (F.size("found") + F.when(some, more).otherwise(0)).alias("n_entities"))
    rest = docs.where(F.coalesce(F.size(matches(F.col("text"))), F.lit(0)) <= 0).select(*[F.col(c) for c in kept], F.lit(0).alias("n_entities"))
    return replaced.unionByName(rest)
