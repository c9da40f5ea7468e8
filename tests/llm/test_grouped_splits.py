import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import grouped_splits as g

ROWS = "row_id bigint, doc_id string, id string, grp string"
LINKS = "id_a string, id_b string"


def test_article_keys(spark):
    cases = {
        "30000001": "a30000001", " PMID: 30000001": "a30000001", "pubmed/30000001": "a30000001", "0030000001 ": "a30000001", "30000001.2": "a30000001",
        "PMC30000001": "bpmc30000001", "10.5555/BXG.2000071 ": "b10.5555/bxg.2000071", "bxg-2015-0000072": "bbxg-2015-0000072", "123456789": "b123456789", "": None, " ": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "k string").select("k", g.article_key(F.col("k")).alias("v"))
    assert {r.k: r.v for r in df.collect()} == cases


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 60)]  # a long chain
    pairs += [(f"m{rng.randrange(80):02}", f"m{rng.randrange(80):02}") for _ in range(60)]
    pairs += [("hub", f"x{i}") for i in range(50)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in pairs], "u string, v string")
    assert {r.node: r.root for r in g.components(df).collect()} == brute(pairs)


def test_hubs_take_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(g, "max", lambda *_: 5, raising=False)
    pairs = [("hub", f"x{i:02}") for i in range(40)] + [("x39", "y")]
    df = spark.createDataFrame(pairs, "u string, v string")
    assert {r.node: r.root for r in g.components(df).collect()} == brute(pairs)


def test_star_ends_the_rounds(spark):
    star = spark.createDataFrame([("b", "a"), ("c", "a"), ("e", "d")], "u string, v string")
    assert g._are_stars(star) and g._are_stars(star.where("false"))
    assert not g._are_stars(star.union(spark.createDataFrame([("c", "d")], star.schema)))
    assert not g._are_stars(star.union(spark.createDataFrame([("a", "Z")], star.schema)))


def test_difference_balances():
    rng = np.random.default_rng(0)
    w = np.sort(rng.integers(1, 100, 400))[::-1].reshape(40, 10)
    bins = g.difference(w)
    totals = np.bincount(bins.ravel(), weights=w.ravel(), minlength=10)
    assert totals.max() - totals.min() <= 5
    assert all(sorted(row) == list(range(10)) for row in bins)


def rows_and_links():
    rng = random.Random(5)
    docs = [30000000 + i for i in range(300)]
    rows = [(i, rng.choice(["{}", "PMID:{}", "{}.0", " {} "]).format(rng.choice(docs)), "x", "y") for i in range(4000)]
    rows += [(4000 + i, None, "x", "y") for i in range(20)] + [(5000, "PMC77", "x", "y"), (5001, "pmc77", "x", "y")] + [(6000 + i, "30000000", "x", "y") for i in range(1500)]
    links = [(f"{d}", f"PMC{d - 29999999}") for d in docs[::7]] + [("PMC1", "30000299"), (None, "PMC1"), ("PMC5", "PMC5")]
    return rows, links


def test_split(spark):
    rows, links = rows_and_links()
    a, b = spark.createDataFrame(rows, ROWS), spark.createDataFrame(links, LINKS)
    for tuples in (g.TUPLES, 3):  # in one task, and by parallel rounds first
        out = g.split_related(a, b, bins=20, tuples=tuples).collect()
        assert Counter(r.id for r in out) == Counter(r[0] for r in rows)
        of = {}
        for r in out:
            assert of.setdefault(r.grp, r.split) == r.split
        share = Counter(r.split for r in out)
        assert abs(share["train"] / len(out) - 0.8) < 0.06 and min(share["validation"], share["test"]) / len(out) > 0.05
        groups = {r.id: r.grp for r in out}
        assert groups[5000] == groups[5001] == "bpmc77" and len({groups[4000 + i] for i in range(20)}) == 20
        assert {groups[i] for i, d, *_ in rows if d and "30000299" in d} == {"a30000000"}


def test_empty(spark):
    a, b = spark.createDataFrame([], ROWS), spark.createDataFrame([], LINKS)
    assert g.split_related(a, b).count() == 0
