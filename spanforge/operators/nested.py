"""Deeply nested annotated records as related flat tables.

A record holds passages and entities, which hold lists of texts, offset pairs and identifiers. Every flat table is
one projection: nested ``transform`` calls attach the ancestor key and the positions, ``flatten`` joins the lists and
one ``inline`` emits the rows. Nothing is shuffled, exploded step by step, or handed to Python.

Defined results: a null or empty list, a null passage or entity, and a null element give no row, but every element
keeps its position (from 0). An identifier that is missing, null or blank gives no row, nor does an offset that is not
a pair of two numbers. A text given as a plain string is element 0. A payload that is null, no valid JSON or no JSON
object gives no row. Columns besides the named ones are ignored, whatever their names; repeated records give repeated
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARENTS = ("passages", "entities")
#: leaf path -> (parent list, child list)
LEAVES = {
    "passages.text": ("passages", "text"),
    "passages.offsets": ("passages", "offsets"),
    "entities.text": ("entities", "text"),
    "entities.offsets": ("entities", "offsets"),
    "entities.normalized": ("entities", "normalized"),
}


def _variant_list(parent: str) -> str:
    return f"try_variant_get(v, '$.{parent}', 'array<variant>')"


def _text_of(e: str) -> str:
    return (
        f"CASE WHEN schema_of_variant(try_variant_get({e}, '$.text', 'variant')) = 'STRING' "
        f"THEN array(try_variant_get({e}, '$.text', 'string')) "
        f"ELSE try_variant_get({e}, '$.text', 'array<string>') END"
    )


def parse_payloads(raw: DataFrame, payload: str = "payload", rec_id: str = "rec_id") -> DataFrame:
    """Raw JSON documents in the shape of the typed table: rec_id, document_id, passages, entities.

    Keys may come in any order, be new, missing or null; ``document_id`` may be called ``id``, ``db_id`` too.
    """
    string = lambda e, key: f"try_variant_get({e}, '$.{key}', 'string')"
    common = (
        f"'kind', coalesce({string('e', 'kind')}, {string('e', 'type')}), 'text', {_text_of('e')}, "
        "'offsets', try_variant_get(e, '$.offsets', 'array<array<bigint>>')"
    )
    present = "CASE WHEN NOT is_variant_null(e) THEN named_struct({}) END"
    identifiers = (
        "transform(try_variant_get(e, '$.normalized', 'array<variant>'), n -> named_struct("
        f"'db_name', {string('n', 'db_name')}, 'db_id', coalesce({string('n', 'db_id')}, {string('n', 'id')})))"
    )
    documents = raw.select(F.col(rec_id).alias("rec_id"), F.try_parse_json(F.col(payload)).alias("v"))
    return documents.select(
        "rec_id",
        F.expr(f"coalesce({string('v', 'document_id')}, {string('v', 'id')})").alias("document_id"),
        F.expr(f"transform({_variant_list('passages')}, e -> {present.format(common)})").alias("passages"),
        F.expr(f"transform({_variant_list('entities')}, e -> {present.format(f"{common}, 'normalized', {identifiers}")})").alias("entities"),
    )


def typed_records(train: DataFrame) -> DataFrame:
    """The typed table with the offsets widened, so that it can be united with parsed payloads."""
    wide = "transform(e.offsets, o -> transform(o, x -> CAST(x AS BIGINT)))"
    return train.select(
        F.col("rec_id"),
        F.col("document_id"),
        F.expr(f"transform(passages, e -> CASE WHEN e IS NOT NULL THEN named_struct('kind', e.kind, 'text', e.text, 'offsets', {wide}) END)").alias("passages"),
        F.expr(
            f"transform(entities, e -> CASE WHEN e IS NOT NULL THEN named_struct('kind', e.kind, 'text', e.text, 'offsets', {wide}, 'normalized', "
            "transform(e.normalized, n -> named_struct('db_name', n.db_name, 'db_id', n.db_id))) END)"
        ).alias("entities"),
    )


def _child_rows(parent: str, child: str, fields: str) -> str:
    """SQL of an array with one struct per child element: positions of both levels plus ``fields`` of parent e, child x."""
    return (
        f"flatten(filter(transform({parent}, (e, i) -> transform(e.{child}, (x, j) -> named_struct("
        f"'parent_no', CAST(i AS BIGINT), 'child_no', CAST(j AS BIGINT), {fields}))), a -> a IS NOT NULL))"
    )


def _leaf(child: str) -> str:
    return {
        "text": "CAST(length(x) AS STRING)",
        "offsets": "CASE WHEN size(x) = 2 AND x[0] IS NOT NULL AND x[1] IS NOT NULL THEN concat(x[0], '-', x[1]) END",
        "normalized": "CASE WHEN trim(x.db_id) <> '' THEN x.db_id END",
    }[child]


def nested_leaves(records: DataFrame) -> DataFrame:
    """One flat table of all leaves: rec_id, leaf_path, parent_no, child_no, leaf."""
    arrays = [
        f"filter({_child_rows(parent, child, f"'leaf', {_leaf(child)}")}, r -> r.leaf IS NOT NULL)" for parent, child in LEAVES.values()
    ]
    tagged = [
        f"coalesce(transform({a}, r -> named_struct('leaf_path', '{path}', 'parent_no', r.parent_no, 'child_no', r.child_no, 'leaf', r.leaf)), array())"
        for path, a in zip(LEAVES, arrays, strict=True)
    ]
    return records.select("rec_id", F.expr(f"inline(concat({', '.join(tagged)}))"))


def nested_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The related flat tables; each child row carries rec_id, the parent's position and its own."""
    def children(parent: str, child: str, fields: str, keep: str) -> DataFrame:
        rows = f"filter({_child_rows(parent, child, fields)}, r -> {keep})"
        return records.select("rec_id", F.expr(f"inline({rows})"))

    def parents(name: str) -> DataFrame:
        rows = f"filter(transform({name}, (e, i) -> named_struct('parent_no', CAST(i AS BIGINT), 'present', e IS NOT NULL, 'kind', lower(e.kind))), r -> r.present)"
        return records.select("rec_id", "document_id", F.expr(f"inline({rows})")).drop("present")

    pair = "'start_pos', x[0], 'end_pos', x[1]"
    both = "r.start_pos IS NOT NULL AND r.end_pos IS NOT NULL"
    return {
        "documents": records.select("rec_id", "document_id"),
        "passages": parents("passages"),
        "passage_texts": children("passages", "text", "'text', x", "r.text IS NOT NULL"),
        "passage_offsets": children("passages", "offsets", pair, both),
        "entities": parents("entities"),
        "entity_texts": children("entities", "text", "'text', x", "r.text IS NOT NULL"),
        "entity_offsets": children("entities", "offsets", pair, both),
        "entity_identifiers": children(
            "entities", "normalized", "'db_name', x.db_name, 'db_id', x.db_id", "trim(r.db_id) <> ''"
        ),
    }

