"""The queries over the whole graph against brute force."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(sql):
    return duckdb.connect().execute(sql.replace("{", f"'{DATA}/").replace("}", ".parquet'")).fetchall()


@pytest.fixture(scope="module")
def graph():
    edges = [(f"nation{a}", f"region{b}") for a, b in rows("SELECT n_nationkey, n_regionkey FROM {nation}")]
    edges += [(f"customer{a}", f"nation{b}") for a, b in rows("SELECT c_custkey, c_nationkey FROM {customer}")]
    edges += [(f"supplier{a}", f"nation{b}") for a, b in rows("SELECT s_suppkey, s_nationkey FROM {supplier}")]
    edges += [(f"supplier{a}", f"part{b}") for a, b in rows("SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}")]
    nodes = [f"{t}{k}" for t, c in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")) for (k,) in rows(f"SELECT {c} FROM {{{t}}}")]
    near = {n: set() for n in nodes}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return nodes, edges, near


def test_degree_and_hops(spark, graph):
    _, _, near = graph
    assert {r.node: r.degree for r in entry.queries()["graph_whole_degree"](spark, DATA).collect()} == {n: len(x) for n, x in near.items() if x}
    hop = {"region1": 0, "supplier3": 0}
    for k in (1, 2):
        for n in [n for n, h in hop.items() if h == k - 1]:
            for m in near[n]:
                hop.setdefault(m, k)
    assert {r.node: r.hop for r in entry.queries()["graph_whole_k_hop"](spark, DATA).collect()} == hop


def test_components_and_reports(spark, graph):
    nodes, edges, near = graph
    known, of = set(nodes), {}
    for n in sorted(nodes):
        todo = [n] if n not in of else []
        while todo:
            x = todo.pop()
            if x not in of:
                of[x] = n
                todo += [m for m in near[x] if m in known]
    assert {r.node: r.component for r in entry.queries()["graph_whole_components"](spark, DATA).collect()} == of
    sizes = {c: list(of.values()).count(c) for c in set(of.values())}
    inner = [of[a] for a, b in edges if a in of and b in of]
    got = {r.component: (r["size"], r.edges) for r in entry.queries()["graph_whole_reports"](spark, DATA).collect()}
    assert got == {c: (n, inner.count(c)) for c, n in sizes.items() if n >= 3}


def test_rounds_leave_edges_between_roots_only(spark, monkeypatch):
    """A hub with a thousand leaves and a long path: labels as by brute force, and after the first round no more than a few edges."""
    from quarryline.operators import graph as G

    sizes, plain = [], G.written

    def counted(df):
        out = plain(df)
        if set(out.columns) == {"src", "dst"}:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "written", counted)
    pairs = [(f"leaf{k:04}", "a") for k in range(1000)] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(200)] + [("x", "x"), ("y", "unknown")]
    names = {n for p in pairs for n in p} - {"unknown"}
    nodes = spark.createDataFrame([(n,) for n in sorted(names)], "node string")
    got = {r["node"]: r["component"] for r in G.components(nodes, spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {n: "a" if n[0] in "al" else "p000" if n[0] == "p" else n for n in names}
    assert sizes == [1200, 0]
