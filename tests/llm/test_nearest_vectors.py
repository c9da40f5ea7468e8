import numpy as np

from spanforge.llm import nearest_vectors as v
from spanforge.llm.queries import QUERIES
from spanforge.session import table

ROW = "id bigint, v array<float>, cosine double"


def exact(q, e, k):
    out = []
    for i, x in q:
        x = np.asarray(x, np.float64)
        scored = []
        for j, y in e:
            y = np.asarray(y, np.float64)
            scored.append((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), j))
        out += [(i, j) for _, j in sorted(scored)[:k]]
    return out


def test_pigeonhole():
    """m tables probed with up to t flips give every code within m (t + 1) - 1, each exactly as far in some substring."""
    rng = np.random.default_rng(1)
    bits = rng.random((3000, 96)) < 0.5
    near = bits[:40].copy()
    near[:, :5] ^= True
    index = v.MultiIndex(np.concatenate([bits, near]), 12)
    queries = bits[:50]
    values, codes, m = index.substrings(queries), v.words_of(queries), len(index.tables)
    d = np.bitwise_count(codes[:, None] ^ index.codes[None]).sum(axis=2)
    met = set()
    for t in range(4):
        q, r = index.probe(values, t, range(m))
        met |= set(zip(q.tolist(), r.tolist(), strict=True))
        within = {tuple(x) for x in np.argwhere(d <= m * (t + 1) - 1).tolist()}
        assert within <= met
    assert len(met) < d.size / 2


def test_probing_gives_the_rows():
    """Without near neighbours the search goes on until it has met enough; pairs visited stay below rows x rows."""
    rng = np.random.default_rng(5)
    unit = lambda a: a / np.linalg.norm(a, axis=1)[:, None]
    y = unit(rng.standard_normal((4000, 64)))
    x = unit(y[:300] + 0.08 * rng.standard_normal((300, 64)))
    mean, rotation = v.learn_rotations(y)
    q, r, _, visited = v.search(x, y, np.arange(4000), mean, rotation, 1)
    assert (r == q).mean() > 0.98 and visited < 0.1 * len(x) * len(y)
    far = unit(rng.standard_normal((40, 64)))
    q, r, _, _ = v.search(far, y, np.arange(4000), mean, rotation, 10)
    want = np.argsort(-(far @ y.T), axis=1)[:, :10]
    assert np.mean([b in want[a] for a, b in zip(q, r, strict=True)]) > 0.95
    few = v.search(far, y[:7], np.arange(7), mean, rotation, 10)
    assert len(few[0]) == 7 * 40


def test_hard_cases(spark):
    rng = np.random.default_rng(2)
    e = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(60)]
    e += [(100 + i, e[3][1]) for i in range(15)]  # equal vectors: the smaller ids win
    bad = [(200, None), (201, [0.0] * 16), (202, [1.0, None] + [0.0] * 14), (203, [float("nan")] + [1.0] * 15), (204, [1.0]), (205, [])]
    entities = spark.createDataFrame([(*x, 0.5) for x in e + bad], ROW)
    queries = spark.createDataFrame([(i, x, 0.5) for i, x in e[:10] + bad], ROW)
    got = v.nearest(v.usable(queries, "id", "v"), v.usable(entities, "id", "v"), 10).collect()
    assert sorted((r.query_id, r.id) for r in got) == sorted(exact(e[:10], e, 10))


def test_few_and_empty(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, v array<float>")
    assert v.nearest(e, e, 10).count() == 4
    assert v.nearest(e, e.where("false"), 10).count() == 0
    assert v.nearest(e.where("false"), e, 10).count() == 0


def test_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    e = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame(e, "id bigint, v array<float>")
    monkeypatch.setattr(v, "ENTITY_BLOCK", 90)
    monkeypatch.setattr(v, "LEAST_QUERIES", 70)
    got = sorted((r.query_id, r.id) for r in v.nearest(df, df, 5).collect())
    want = exact(e, e, 5)
    assert len(set(got) & set(want)) >= 0.97 * len(want)


def test_recall_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.row_id, r.entity_id) for r in QUERIES["p5_found"](spark, sf).collect()}
    pairs = [("bioelqa_dev_mention_vectors", "row_id"), ("bioelqa_dev_candidates_sapbert_genelevel_top20", "entity_id")]
    q, e = ([(r.id, list(r.v)) for r in v.usable(table(spark, sf, t), c, "embedding").collect()] for t, c in pairs)
    want = exact(q, e, 10)
    assert len(got) == len(want) and len(got & set(want)) >= 0.98 * len(want)
