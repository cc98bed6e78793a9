"""Questions that share hubs and names: the same rows as plain loops, without writing out what a question can't use."""

import random

import pytest

from quarryline.operators import answers as A


@pytest.fixture
def sizes(monkeypatch):
    found, plain = [], A.written

    def counted(df):
        out = plain(df)
        found.append(out.count())
        return out

    monkeypatch.setattr(A, "written", counted)
    return found


def test_related_of_hubs(spark, sizes):
    rng = random.Random(3)
    pairs = {(f"n{k:03}", f"hub{k % 2}") for k in range(300)} | {("hub0", "top"), ("hub1", "top"), ("lone", "pair")} | {(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(40)}
    asked = {q: rng.sample(["hub0", "hub1", "top", "lone", "n001", "n002", "n007", "missing"], rng.randint(1, 4)) for q in range(60)}
    links = {}
    for a, b in pairs:
        if a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    want = set()
    for q, ids in asked.items():
        seen, frontier, order = set(ids), set(ids), []
        for hop in (1, 2):
            frontier = {y for x in frontier for y in links.get(x, ())} - seen
            seen |= frontier
            order += [(q, y, hop) for y in sorted(frontier)]
        want |= set(order[:7])
    targets = spark.createDataFrame([(q, x) for q, ids in asked.items() for x in ids], "query_id int, id string")
    rels = spark.createDataFrame([(a, b, a + b) for a, b in pairs], "src string, dst string, description string")
    got = A.related_entities(targets, rels, 2, 7).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sizes and max(sizes[1:]) <= 60 * 7
    keys = {tuple(r) for r in A.key_relationships(targets, rels, 7).collect()}
    plain = {q: sorted((a, b, a + b) for a, b in pairs if a in ids or b in ids)[:7] for q, ids in asked.items()}
    assert keys == {(q, *r, k + 1) for q, rows in plain.items() for k, r in enumerate(rows)}


def test_matches_of_shared_names(spark, sizes):
    """400 entities of one name and 400 that contain it: of each stage no more than ten ids of a mention are written."""
    entities = spark.createDataFrame([(f"a{k:03}", "acme", "c", "makes things", []) for k in range(400)] + [(f"b{k:03}", f"acme {k:03}", "c", None, []) for k in range(400)], "id string, name string, type string, description string, units array<long>")
    ask = {0: (["acme"], []), 1: (["acm", "acme 1"], []), 2: (["acne"], []), 3: ([], ["things"]), 4: (["acme 123"], ["7"])}
    questions = spark.createDataFrame([(q, *x, "t", 0.5) for q, x in ask.items()], "query_id int, entities array<string>, keywords array<string>, type string, confidence double")
    got = {}
    for r in A.matched_entities(questions, entities).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["stage"]))
    first = [f"a{k:03}" for k in range(10)]
    assert got[0] == [(x, 1) for x in first] and got[1] == [(x, 2) for x in first]
    assert got[2] == [(x, 4) for x in first] and got[3] == [(x, 3) for x in first]
    assert got[4] == [("b123", 1)] + [(x, 2) for x in first[:9]]
    assert max(sizes[1:]) <= 10 * 8


def test_like_questions_are_followed_once(spark, sizes):
    """Of 300 questions with two sets of targets, what is related and the units are written out for two."""
    rels = spark.createDataFrame([(f"s{k:03}", f"n{k % 2}", "trades") for k in range(100)] + [("n0", "top", "lies"), ("n1", "top", "lies")], "src string, dst string, description string")
    entities = spark.createDataFrame([(f"s{k:03}", [k]) for k in range(100)] + [("n0", [500, 501, 500]), ("n1", [502, 3]), ("top", None)], "id string, units array<long>")
    sets = [["s005", "n0"], ["n0", "s005"], ["n1"]]
    targets = spark.createDataFrame([(q, x) for q in range(300) for x in sets[q % 3]], "query_id int, id string")
    got, related = {}, {}
    for r in A.retrieved_units(targets, rels, entities).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["unit_id"], r["score"]))
    for r in A.related_entities(targets, rels).collect():
        related.setdefault(r["query_id"], []).append((r["hop"], r["id"]))
    assert max(x for x in sizes if x != 300) <= 204  # the links, both ways; 300 are the questions with their first
    units = {f"s{k:03}": {k} for k in range(100)} | {"n0": {500, 501}, "n1": {502, 3}, "top": set()}
    links = {}
    for k in range(100):
        links.setdefault(f"s{k:03}", set()).add(f"n{k % 2}")
        links.setdefault(f"n{k % 2}", set()).add(f"s{k:03}")
    for n in ("n0", "n1"):
        links[n].add("top")
        links.setdefault("top", set()).add(n)
    for q in range(300):
        seen, frontier, order = set(sets[q % 3]), set(sets[q % 3]), []
        for hop in (1, 2):
            frontier = {y for x in frontier for y in links[x]} - seen
            seen |= frontier
            order += [(hop, y) for y in sorted(frontier)]
        assert sorted(related[q]) == order[:20]
        ids = sets[q % 3] + [x for _, x in order[:20]]
        counts = {u: sum(u in units[x] for x in ids) for x in ids for u in units[x]}
        best = sorted(counts, key=lambda u: (-counts[u], u))[:20]
        assert sorted(got[q]) == [(k + 1, u, counts[u] / len(ids)) for k, u in enumerate(best)]
