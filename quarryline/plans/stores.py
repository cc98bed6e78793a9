"""Queries over registries, snapshots and counts of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consistency as C
from ..session import load

_doc = lambda s, d: load(s, d, "documents")


def _snapshot(s, d, new):
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    rows = _doc(s, d).where("doc_id % 11 <> 3" if new else "doc_id % 13 <> 5")
    changed = F.when((F.col("doc_id") % 17 == 0) & F.lit(new), F.reverse("text")).otherwise(F.col("text"))
    return rows.select(path.alias("path"), F.md5(changed).alias("hash"), F.length("text").alias("size"))


def _registry(s, d):
    return _doc(s, d).where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))


def _stored(s, d):
    return load(s, d, "labels").select(F.col("doc_id").alias("id")).join(_doc(s, d).select(F.col("doc_id").alias("id"), "n_chars"), "id").select("id", (F.col("n_chars") + (F.col("id") % 4 == 1).cast("int")).alias("size"))


def _counts(s, d):
    out = None
    for name in ("documents", "pages", "conversations", "embeddings", "customer", "supplier"):
        one = load(s, d, name).agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "snapshot_changes": lambda s, d: C.snapshot_changes(_snapshot(s, d, False), _snapshot(s, d, True)),
    "registry_issues": lambda s, d: C.registry_issues(_registry(s, d), _stored(s, d)),
    "issue_counts": lambda s, d: C.issue_counts(C.registry_issues(_registry(s, d), _stored(s, d))),
    "upserted_rows": lambda s, d: C.upserted(_registry(s, d), _doc(s, d).where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("size"), F.col("doc_id").alias("ord")), "id"),
    "deleted_rows": lambda s, d: C.deleted(_registry(s, d), load(s, d, "labels").select(F.col("doc_id").alias("id")), "id"),
    "key_changes": lambda s, d: C.key_changes(_doc(s, d).where("doc_id % 2 = 0").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("value")), _doc(s, d).where("doc_id % 3 = 0").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("value"))),
    "kept_snapshots": lambda s, d: C.kept_snapshots(load(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("at")), 50, 10500).select("id"),
    "validated_documents": lambda s, d: C.validated(_doc(s, d), {"text": F.trim("text") != "", "language": F.col("lang").rlike("^[a-z]{2}$"), "size": F.col("n_chars") >= 100}).select("doc_id", "broken", "is_valid"),
    "table_counts": _counts,
    "documents_by_source": lambda s, d: _doc(s, d).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")),
    "weight_statistics": lambda s, d: load(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.max("l_quantity").alias("most"), F.min("l_quantity").alias("least"), F.round(F.stddev_samp("l_quantity"), 6).alias("deviation")),
    "order_pages": lambda s, d: load(s, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(50).select("o_orderkey"),
}

_P = "SELECT source || '/' || doc_id AS path, md5({t}) AS hash, length(text) AS size FROM documents WHERE {w}"
_R = "(SELECT doc_id AS id, n_chars AS size FROM documents WHERE doc_id % 3 <> 0)"
_T = "(SELECT doc_id AS id, n_chars + (doc_id % 4 = 1)::int AS size FROM labels JOIN documents USING (doc_id))"
_I = f"SELECT id, 'missing' AS issue, 'high' AS severity FROM {_R} WHERE id NOT IN (SELECT id FROM {_T}) UNION ALL SELECT id, 'orphaned', 'medium' FROM {_T} WHERE id NOT IN (SELECT id FROM {_R}) UNION ALL SELECT r.id, 'mismatch', 'low' FROM {_R} r JOIN {_T} t USING (id) WHERE r.size <> t.size"
ORACLES = {
    "snapshot_changes": f"SELECT change[1:3] || '_' || md5(path)[1:8] AS change_id, path, change FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.hash <> b.hash OR a.size <> b.size THEN 'modified' END AS change FROM ({_P.format(t='text', w='doc_id % 13 <> 5')}) a FULL JOIN ({_P.format(t='CASE WHEN doc_id % 17 = 0 THEN reverse(text) ELSE text END', w='doc_id % 11 <> 3')}) b ON a.path = b.path) WHERE change IS NOT NULL",
    "registry_issues": _I,
    "issue_counts": f"SELECT issue, severity, count(*) AS n FROM ({_I}) GROUP BY GROUPING SETS ((issue), (severity))",
    "upserted_rows": f"SELECT id, size FROM {_R} WHERE id % 5 <> 0 UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id % 5 = 0",
    "deleted_rows": f"SELECT id, size FROM {_R} WHERE id NOT IN (SELECT doc_id FROM labels)",
    "key_changes": "SELECT key, change FROM (SELECT coalesce(a.source, b.source) AS key, CASE WHEN a.source IS NULL THEN 'added' WHEN b.source IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' END AS change FROM (SELECT source, count(*) AS v FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS v FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) b ON a.source = b.source) WHERE change IS NOT NULL",
    "kept_snapshots": "SELECT id FROM (SELECT o_orderkey AS id, o_orderdate::date - DATE '1970-01-01' AS day, row_number() OVER (ORDER BY o_orderdate::date DESC, o_orderkey) AS place FROM orders) WHERE place <= 50 OR day >= 10500",
    "validated_documents": "SELECT doc_id, broken, broken = '' AS is_valid FROM (SELECT doc_id, concat_ws(',', CASE WHEN trim(text, ' ') = '' THEN 'text' END, CASE WHEN NOT regexp_matches(lang, '^[a-z]{2}$') THEN 'language' END, CASE WHEN n_chars < 100 THEN 'size' END) AS broken FROM documents)",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("documents", "pages", "conversations", "embeddings", "customer", "supplier")),
    "documents_by_source": "SELECT source, lang, count(*) AS n, sum(n_chars)::bigint AS chars FROM documents GROUP BY 1, 2",
    "weight_statistics": "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS most, min(l_quantity) AS least, round(stddev_samp(l_quantity), 6) AS deviation FROM lineitem GROUP BY 1",
    "order_pages": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20",
}
