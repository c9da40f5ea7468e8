import json

from spanforge.operators.nested import LEAVES, nested_leaves, nested_tables, parse_payloads, typed_records

TYPED = """rec_id bigint, document_id string, passages array<struct<kind:string,text:array<string>,offsets:array<array<int>>>>,
entities array<struct<kind:string,text:array<string>,offsets:array<array<int>>,normalized:array<struct<db_name:string,db_id:string>>>>, leaf string"""


def brute(rec_id, passages, entities):
    """Leaves of one record by plain loops."""
    out = []
    for group, rows in (("passages", passages), ("entities", entities)):
        for i, e in enumerate(rows or []):
            if e is None:
                continue
            for j, t in enumerate(e.get("text") or []):
                if t is not None:
                    out.append((rec_id, f"{group}.text", i, j, str(len(t))))
            for j, o in enumerate(e.get("offsets") or []):
                if o is not None and len(o) == 2 and None not in o:
                    out.append((rec_id, f"{group}.offsets", i, j, f"{o[0]}-{o[1]}"))
            for j, n in enumerate(e.get("normalized") or []):
                if n and n.get("db_id"):
                    out.append((rec_id, "entities.normalized", i, j, n["db_id"]))
    return out


CASES = [
    (1, [{"kind": "title", "text": ["aé", None, ""], "offsets": [[0, 2], None, [3]]}, None], [{"kind": "Gene", "text": [], "offsets": None, "normalized": [None, {"db_name": "x", "db_id": "7"}, {"db_name": "x", "db_id": None}]}]),
    (2, None, None),
    (3, [], [None]),
    (4, [{"kind": None, "text": None, "offsets": [[1, None], [1, 2]]}], [{"kind": None, "text": ["x" * 100_000, "😀"], "offsets": [], "normalized": []}]),
    (1, [{"kind": "title", "text": ["aé"], "offsets": []}], []),
]


def test_typed_leaves(spark):
    df = spark.createDataFrame([(r, "d", p, e, "clash") for r, p, e in CASES], TYPED)
    got = sorted(tuple(r) for r in nested_leaves(typed_records(df)).collect())
    assert got == sorted(x for r, p, e in CASES for x in brute(r, p, e))


def test_empty_table(spark):
    df = spark.createDataFrame([], TYPED)
    assert nested_leaves(typed_records(df)).count() == 0
    assert all(t.count() == 0 for t in nested_tables(typed_records(df)).values())


def test_payloads(spark):
    good = {"id": 5, "new": {"a": 1}, "passages": [{"type": "Title", "text": "abc"}, None, {"text": ["d", None, "ef"]}], "entities": [
        {"normalized": [{"id": 12}, None, {"db_id": None}, {"db_id": "Q"}], "text": "xy", "offsets": [[3, 4]]}]}
    rows = [(1, json.dumps(good)), (2, json.dumps(good)[:-3]), (3, None), (4, "[]"), (5, "null"), (6, '{"passages": null, "entities": 3}'), (7, "")]
    records = parse_payloads(spark.createDataFrame(rows, "rec_id bigint, payload string"))
    got = {tuple(r)[1:] for r in nested_leaves(records).where("rec_id = 1").collect()}
    assert got == {
        ("passages.text", 0, 0, "3"), ("passages.text", 2, 0, "1"), ("passages.text", 2, 2, "2"), ("entities.text", 0, 0, "2"), ("entities.offsets", 0, 0, "3-4"),
        ("entities.normalized", 0, 0, "12"), ("entities.normalized", 0, 3, "Q"),
    }
    assert nested_leaves(records).where("rec_id <> 1").count() == 0
    assert {r.document_id for r in records.where("rec_id = 1").collect()} == {"5"}
    assert set(LEAVES) >= {p for p, *_ in got}


def test_tables_keep_links(spark):
    df = spark.createDataFrame([(r, "d", p, e, "") for r, p, e in CASES], TYPED)
    tables = nested_tables(typed_records(df))
    parents = {(r.rec_id, r.parent_no) for r in tables["passages"].collect()}
    assert {(r.rec_id, r.parent_no) for r in tables["passage_texts"].collect()} <= parents
    assert tables["documents"].count() == len(CASES)
