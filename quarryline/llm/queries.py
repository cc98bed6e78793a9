"""The queries of this subpackage: thin digests of its operators, by name, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25_wand, bpe_trie, centroid_trees, lang_parse, mixture_fit, pii_surrogates, quality_pairs, ring_shards, role_repair, simhash_gray, suffix_spans, toxic_lengths, vector_cells
from .common import held_out, table


def op1_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a ranker fitted on at most 20,000 labelled rows of the learnable fold. Null and empty texts
    are scored like others; repeated rows stay; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    found = quality_pairs.score_quality(docs, quality_pairs.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced. Null texts stay null, with 0 entities; repeated rows get equal texts."""
    return pii_surrogates.replace_entities(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op3_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document. Texts without words have fingerprint 0 and are one group; of a
    group whose ids are all null the component is null."""
    found = simhash_gray.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards whose counts are at most one apart (law `rows`). Rows of one id, nulls included,
    start at one place of the ring; null texts have size 16 and no checksum."""
    found = ring_shards.shard_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixture_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document. Null texts have size 0; a null source is a source, weighed last."""
    found = mixture_fit.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of all that are most like each document whose id is divisible by 50. A query is all distinct terms of
    its whole text (rows that share an id are one query, with each term's largest count); a document without a term asks
    nothing and is found by none. Ties go to the smaller doc_id, nulls last."""
    docs = table(spark, sf_dir, "documents")
    return bm25_wand.search_like(docs, docs.where(F.col("doc_id") % 50 == 0), most=None, least_df=1)


def op6_vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at cosine 0.9. Vectors that are null, zero, or hold null or non-finite components stay
    alone; equal vectors are linked."""
    return vector_cells.near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op7_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that a smaller doc_id has too. Null texts are empty; a null
    id counts as the largest; rows of one id don't take from each other."""
    return suffix_spans.kept_digest(suffix_spans.remove_repeats(table(spark, sf_dir, "documents")))


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's token ids and of what they decode to. Null texts are empty."""
    docs = table(spark, sf_dir, "documents")
    return bpe_trie.digests(bpe_trie.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from whole texts of the learnable fold (64 a language, 16 KiB). Null texts and
    those without a letter are `und` with score 0."""
    docs = table(spark, sf_dir, "documents")
    found = lang_parse.identify(docs, lang_parse.fit_samples(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_toxic_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by dictionaries and thresholds fitted on at most 20,000 labelled rows of the learnable fold. Null
    and empty texts are scored like others; repeated rows stay; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    found = toxic_lengths.score_toxicity(docs, toxic_lengths.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxic_lengths.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the damage that its rows' checksums choose: its faults, the cheapest repair's cost and edits,
    and the hash of what it becomes. A null id is a conversation like others."""
    return role_repair.repair_digest(table(spark, sf_dir, "conversations"))


def op13_centroid_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 finite components after ten rounds from eight seeded centroids. Other vectors have no
    row; of rows without an id none is a first centroid unless others are too few."""
    return centroid_trees.with_inertia(*centroid_trees.cluster(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_pairs, op2_pii_surrogates, op3_simhash_gray, op4_ring_shards, op5_bm25_wand, op6_vector_cells, op7_suffix_spans, op8_bpe_trie, op9_mixture_fit, op10_language_id, op11_toxic_lengths, op12_role_repair, op13_centroid_trees)}
_ROUND = """
, apart{n} AS MATERIALIZED (SELECT i, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, centroid{n})
, near{n} AS MATERIALIZED (SELECT i, any_value(v) AS v, min({{'d': d, 'c': c}}) AS m FROM apart{n} GROUP BY i)
"""
_MOVE = """
, sums{m} AS (SELECT m.c AS c, k, sum(v[k])::BIGINT AS s, count(*) AS n FROM near{n}, range(1, 65) t(k) GROUP BY m.c, k)
, mean{m} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY k) AS w FROM sums{m} GROUP BY c)
, centroid{m} AS MATERIALIZED (SELECT o.c, coalesce(mean{m}.w, o.w) AS w FROM centroid{n} o LEFT JOIN mean{m} USING (c))
"""
CLUSTERS_SQL = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)
, centroid0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS w FROM kept ORDER BY sha256('3:' || vec_id) NULLS LAST, v LIMIT 8)
"""
    + "".join(_ROUND.format(n=n) + _MOVE.format(n=n, m=n + 1) for n in range(10))
    + _ROUND.format(n=10)
    + """
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM kept JOIN near10 USING (i) JOIN centroid10 ON m.c = c
"""
)
ORACLES: dict[str, str] = {"op13_centroid_trees": CLUSTERS_SQL}
