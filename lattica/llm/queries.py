"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embed_neardup, html_extract, jaccard_join, langid, license_scan, packing, quality, token_counts, toxicity
from .common import table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.contract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.contract(table(spark, sf_dir, "documents"))


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_neardup.contract(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.contract(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.contract(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.contract(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.query(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_language_id, op3_embedding_neardup, op4_best_fit_packing, op5_toxicity, op6_license_scan, op7_jaccard_join, op8_token_counts, op9_quality, op10_decontamination)}

#: Connected groups: every id with each id that it is reached from; the smallest is its component.
_REACHED = "c(id, root) AS (SELECT id, id FROM nodes UNION SELECT e.b, c.root FROM c JOIN edges e ON e.a = c.id), components AS (SELECT id, min(root) AS root FROM c GROUP BY id)"

_SETS = r"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id AS id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
posted AS (SELECT id, unnest(s) AS x FROM sets),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM posted a JOIN posted b ON a.x = b.x AND a.id <> b.id GROUP BY 1, 2),
edges AS (SELECT a, b FROM shared JOIN sets x ON x.id = a JOIN sets y ON y.id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
nodes AS (SELECT id FROM sets)"""

_NEAR = """
vectors AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fine AS (SELECT * FROM vectors WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
edges AS (SELECT a.id AS a, b.id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.id <> b.id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
nodes AS (SELECT id FROM vectors)"""

#: The others train models, run tokenizers, or return labels of an expression parser: tests/llm compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_neardup": f"WITH RECURSIVE {_NEAR}, {_REACHED} SELECT k.id AS vec_id, (SELECT count(*) FROM edges e WHERE e.a = k.id) AS n_links, k.root AS component_id, k.id = k.root AS kept FROM components k",
    "op7_jaccard_join": f"WITH RECURSIVE {_SETS}, {_REACHED} SELECT s.id AS doc_id, len(s.s) AS n_shingles, k.root AS component_id FROM sets s JOIN components k ON k.id = s.id",
}
