"""Queries over the nested documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.operators.nested import nested_leaves, nested_tables, parse_payloads, typed_records
from spanforge.session import table


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = typed_records(table(spark, sf_dir, "nlm_gene_train"))
    return typed.unionByName(parse_payloads(table(spark, sf_dir, "nlm_gene_raw")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_leaves(all_records(spark, sf_dir))


def p4_entity_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_tables(all_records(spark, sf_dir))["entity_identifiers"]


def p4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_tables(all_records(spark, sf_dir))["passages"]


QUERIES = {"p4_found": p4_found, "p4_entity_identifiers": p4_entity_identifiers, "p4_passages": p4_passages}

_RAW = "SELECT rec_id, try_cast(payload AS JSON) AS j FROM nlm_gene_raw"


def _parent(name: str) -> str:
    """Parents of both tables as JSON, with their positions."""
    return f"""
  SELECT rec_id, CAST(i - 1 AS BIGINT) AS parent_no, to_json({name}[i]) AS e
  FROM (SELECT rec_id, {name}, unnest(range(1, len({name}) + 1)) AS i FROM nlm_gene_train)
  UNION ALL
  SELECT rec_id, CAST(i AS BIGINT), json_extract(j, '$.{name}[' || i || ']')
  FROM (SELECT rec_id, j, unnest(range(json_array_length(j, '$.{name}')::BIGINT)) AS i FROM ({_RAW}) WHERE json_type(j, '$.{name}') = 'ARRAY')"""


def _children(parent: str, child: str) -> str:
    return f"""
  SELECT rec_id, parent_no, CAST(k AS BIGINT) AS child_no, json_extract(e, '$.{child}[' || k || ']') AS x
  FROM (SELECT rec_id, parent_no, e, unnest(range(json_array_length(e, '$.{child}')::BIGINT)) AS k FROM {parent} WHERE json_type(e, '$.{child}') = 'ARRAY')"""


def _texts(parent: str) -> str:
    return f"""{_children(parent, 'text')}
  UNION ALL SELECT rec_id, parent_no, 0, json_extract(e, '$.text') FROM {parent} WHERE json_type(e, '$.text') = 'VARCHAR'"""


_ID = "coalesce(json_extract_string(x, '$.db_id'), json_extract_string(x, '$.id'))"
_HEAD = f"WITH passages AS ({_parent('passages')}), entities AS ({_parent('entities')})"

SQL = {
    "p4_found": f"""{_HEAD}
SELECT rec_id, 'passages.text' AS leaf_path, parent_no, child_no, CAST(length(x ->> '$') AS VARCHAR) AS leaf FROM ({_texts('passages')}) WHERE json_type(x) = 'VARCHAR'
UNION ALL SELECT rec_id, 'entities.text', parent_no, child_no, CAST(length(x ->> '$') AS VARCHAR) FROM ({_texts('entities')}) WHERE json_type(x) = 'VARCHAR'
UNION ALL SELECT rec_id, 'passages.offsets', parent_no, child_no, (x ->> '$[0]') || '-' || (x ->> '$[1]') FROM ({_children('passages', 'offsets')}) WHERE json_type(x) = 'ARRAY'
UNION ALL SELECT rec_id, 'entities.offsets', parent_no, child_no, (x ->> '$[0]') || '-' || (x ->> '$[1]') FROM ({_children('entities', 'offsets')}) WHERE json_type(x) = 'ARRAY'
UNION ALL SELECT rec_id, 'entities.normalized', parent_no, child_no, {_ID} FROM ({_children('entities', 'normalized')}) WHERE {_ID} IS NOT NULL""",
    "p4_entity_identifiers": f"""{_HEAD}
SELECT rec_id, parent_no, child_no, json_extract_string(x, '$.db_name') AS db_name, {_ID} AS db_id FROM ({_children('entities', 'normalized')}) WHERE {_ID} IS NOT NULL""",
    "p4_passages": f"""{_HEAD}, named AS (
  SELECT rec_id, document_id FROM nlm_gene_train
  UNION ALL SELECT rec_id, coalesce(json_extract_string(j, '$.document_id'), json_extract_string(j, '$.id')) FROM ({_RAW}))
SELECT p.rec_id, document_id, parent_no, lower(coalesce(json_extract_string(e, '$.kind'), json_extract_string(e, '$.type'))) AS kind
FROM passages p JOIN named n ON p.rec_id = n.rec_id WHERE json_type(e) = 'OBJECT'""",
}
