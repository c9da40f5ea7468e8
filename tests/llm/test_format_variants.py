import random
import unicodedata
from collections import defaultdict

from spanforge.llm import format_variants as f

KB = "kb_id bigint, term string, tax_id string, gene_id string, key string"
TAXA = "tax_id string, species string"


def brute(rows, taxa):
    groups = defaultdict(list)
    for i, *values in rows:
        if None in values:
            continue
        made = ["".join(c for c in v.lower() if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd") for v in values]
        kinds = {"s": [], "g": [], "t": []}
        for v in made:
            kinds["s" if v in taxa else "g" if v.isdigit() else "t" if any(c.isalpha() for c in v) else "s"].append(v)
        if all(len(x) == 1 and x[0] for x in kinds.values()):
            groups[tuple(x[0] for x in kinds.values())].append(i)
    return groups


def frames(spark, rows, taxa):
    kb = spark.createDataFrame([(*r, "clash") for r in rows], KB)
    return f.record_keys(kb, spark.createDataFrame([(t, "x") for t in taxa], TAXA))


ROWS = [
    (1, "IL-2", "9606", "100000001"), (2, "il 2", "'9606'", "100,000,001"), (3, "9606\r", "IL2", "100000001"), (4, "IL2", "10090", "100000001"),
    (5, None, "9606", "100000001"), (6, "-", "9606", "100000001"), (7, "", "9606", "100000001"), (8, "IL2", None, "1"), (9, "55", "9606", "100000001"),
    (10, "TNFβ", "9606", "7"), (11, "tnfΒ", "7", "9606"), (12, "IL-2", "9606", "100000001"), (12, "IL-2", "9606", "100000001"), (13, "A" * 50_000, "9606", "8"), (14, "A" * 49_999 + "B", "9606", "8"),
]


def test_copies(spark):
    keyed = frames(spark, ROWS, ["9606", "10090"])
    got = sorted(tuple(r) for r in f.copies_beyond_first(keyed).collect())
    want = sorted((min(g), i) for g in brute(ROWS, {"9606", "10090"}).values() for i in sorted(g)[1:])
    assert got == want
    counts = {r.lo: r.n for r in f.collapse_records(keyed).collect()}
    assert counts == {min(g): len(g) for g in brute(ROWS, {"9606", "10090"}).values()}


def test_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "HOT", "h-o-t"]) if i % 3 else f"t{i // 6}", "9606", "5") for i in range(3000)]
    keyed = frames(spark, rows, ["9606"])
    assert f.hot_keys(keyed)[0] == ["hot|5|9606"]
    got = sorted(tuple(r) for r in f.copies_beyond_first(keyed).collect())
    groups = brute(rows, {"9606"})
    assert got == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert {r.lo: r.n for r in f.collapse_records(keyed).collect()} == {min(g): len(g) for g in groups.values()}


def test_empty(spark):
    keyed = frames(spark, [], [])
    assert f.copies_beyond_first(keyed).count() == 0 and f.collapse_records(keyed).count() == 0
