"""The k most similar vectors by multi-index hashing.

(1) Codes: ``ROTATIONS`` rotations of the unit vectors are learned on a bounded sample (iterative quantisation: rotate so
that the signs lose least), each giving one bit per dimension. (2) Index: the code is split into substrings of about
log2(codes) bits, so that a bucket holds about one code whatever the block's size; each substring has a direct-address
table from value to rows. (3) Probing, progressively: the tables are probed with all values one flip further away in
each round, ``GROUP`` tables at a time. By the pigeonhole principle m tables probed with t flips retrieve every code within
Hamming radius m (t + 1) - 1. The codes met are compared whole, and those that can still hold one of the k best are ranked
by their floats, in doubles. (4) Stop: a query is done when a vector as similar as its k-th best so far would have been
met with probability 1 - ``MISS`` at least (the chance that a bit differs is the angle over pi); a query without near
neighbours goes on until it has met all codes. Every row returned comes from a probe; there is no other search.

Scale: entities and queries are cut into blocks, and each pair of blocks is one task, so no side is broadcast and
nothing is collected but the sample for the rotations (at most ``SAMPLE`` vectors). What is moved is entities x blocks
of queries + queries x blocks of entities. Blocks are large, and queries are cut further only to keep the cores busy.

Defined results: null, empty, wrongly sized and all-zero vectors, and ones with a null or NaN in them, take no part.
Ties go to the smaller id. Fewer than k entities give fewer rows. No sampling of rows, and no cap on the candidates.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROTATIONS, SAMPLE, STEPS = 4, 20_000, 25
#: Probability of missing a vector as similar as the k-th best, and standard deviations of its code's distance.
MISS, SURE = 0.05, 1.5
QUERIES, GROUP = 128, 4
ENTITY_BLOCK, QUERY_BLOCK, LEAST_QUERIES = 100_000, 100_000, 2_000


def learn_rotations(sample: np.ndarray, rotations: int = ROTATIONS, steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotations (dimension x bits) that lose least when only signs are kept."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    x, d = sample - mean, sample.shape[1]
    parts = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        parts.append(r)
    return mean, np.concatenate(parts, axis=1)


def bits_of(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return (x - mean) @ rotation > 0


def words_of(bits: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


@functools.cache
def ring(flips: int, bits: int) -> np.ndarray:
    """All masks with exactly so many of the bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), flips)], np.int64)


@functools.cache
def chances(bits: int) -> np.ndarray:
    """[t, i]: the chance that fewer than t of the bits differ, where each does with probability i / 1000."""
    p = np.arange(1001) / 1000
    terms = [math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(bits + 1)]
    return np.concatenate([np.zeros((1, 1001)), np.cumsum(terms, axis=0)])


class MultiIndex:
    """Codes with a table for each of their substrings; bits that fill no substring are only compared."""

    def __init__(self, bits: np.ndarray, sub: int | None = None):
        n, width = bits.shape
        self.sub = min(width, 20, max(8, round(math.log2(max(2, n))))) if sub is None else sub
        self.codes = words_of(bits)
        self.tables = []
        for values in self.substrings(bits).T:
            starts = np.zeros((1 << self.sub) + 1, np.int64)
            np.cumsum(np.bincount(values, minlength=1 << self.sub), out=starts[1:])
            self.tables.append((np.argsort(values, kind="stable").astype(np.int32), starts.astype(np.int32)))

    def substrings(self, bits: np.ndarray) -> np.ndarray:
        """Values of the substrings, one column each."""
        weight = 1 << np.arange(self.sub)
        return np.stack([bits[:, j : j + self.sub] @ weight for j in range(0, bits.shape[1] - self.sub + 1, self.sub)], axis=1)

    def probe(self, values: np.ndarray, flips: int, tables: range) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the codes that differ from the query in exactly so many bits of one of these substrings."""
        masks, found_q, found_r = ring(flips, self.sub), [], []
        for j in tables:
            rows, starts = self.tables[j]
            v = (values[:, j, None] ^ masks[None, :]).ravel()
            a = starts[v]
            n = starts[v + 1] - a
            met = np.nonzero(n)[0]
            a, n = a[met], n[met]
            ends = np.cumsum(n, dtype=np.int64)
            found_r.append(rows[np.repeat(a - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)])
            found_q.append(np.repeat((met // len(masks)).astype(np.int32), n))
        return np.concatenate(found_q), np.concatenate(found_r)


Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # query, row, cosine
NONE: Found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes, row by row."""
    counts = np.bitwise_count(a ^ b)
    total = counts[:, 0].astype(np.int16)
    for w in range(1, counts.shape[1]):
        total += counts[:, w]
    return total


def _best(so_far: Found, q: np.ndarray, r: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> Found:
    """The k best of each query among those so far and the new pairs, of which only such count that reach the k-th best so
    far: cosine to nine places, then the smaller id. What was met before counts too, wherever its code lies."""
    score = np.empty(len(q))
    for a in range(0, len(q), 20_000):
        score[a : a + 20_000] = np.einsum("ij,ij->i", x[q[a : a + 20_000]], y[r[a : a + 20_000]])
    score = np.round(score, 9) + 0.0
    good = score >= least[q]
    q, r, score = (np.concatenate(c) for c in zip(so_far, (q[good], r[good], score[good]), strict=True))
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])  # copies of a pair are neighbours
    q, r, score = q[once], r[once], score[once]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], r[keep], score[keep]


def _kth(found: Found, n: int, k: int) -> np.ndarray:
    """The k-th best cosine of each query so far, -1 for less than k."""
    q, _, score = found
    low = np.ones(n)
    np.minimum.at(low, q, score)
    return np.where(np.bincount(q, minlength=n) >= k, low, -1.0)


def search(x: np.ndarray, y: np.ndarray, ids: np.ndarray, mean: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, cosine) of the k most similar unit vectors of y for each of x, and how many pairs were visited."""
    index = MultiIndex(bits_of(y, mean, rotation))
    asked = bits_of(x, mean, rotation)
    codes, values, width = words_of(asked), index.substrings(asked), asked.shape[1]
    m, n, below = len(index.tables), len(y), chances(index.sub)
    out, visited = [], 0
    for first in range(0, len(x), QUERIES):
        own, vectors = codes[first : first + QUERIES], x[first : first + QUERIES]
        size = len(own)
        seen = np.zeros(size * n, bool)
        found, kth, active = NONE, np.full(size, -1.0), np.arange(size)
        for flips in range(index.sub + 1):
            for table in range(0, m, GROUP):
                upto = min(m, table + GROUP)
                q, r = index.probe(values[first + active], flips, range(table, upto))
                q = active[q]
                pair = q * n + r
                fresh = np.nonzero(~seen[pair])[0]
                q, r = q[fresh], r[fresh]
                seen[pair[fresh]] = True
                share = np.arccos(np.clip(kth, -1, 1)) / math.pi
                radius = width * share + SURE * np.sqrt(width * share * (1 - share))
                near = np.nonzero(_distances(own[q], index.codes[r]) <= radius.astype(np.int16)[q])[0]
                if len(near):
                    found = _best(found, q[near], r[near], vectors, y, ids, kth, k)
                    kth = _kth(found, size, k)
                at = np.rint(np.arccos(np.clip(kth[active], -1, 1)) / math.pi * 1000).astype(int)
                miss = (1 - below[flips + 1, at]) ** upto * (1 - below[flips, at]) ** (m - upto)
                active = active[miss > MISS]
                if not len(active):
                    break
            if not len(active):
                break
        visited += int(np.count_nonzero(seen))
        out.append((found[0] + first, *found[1:]))
    return (*(np.concatenate(c) for c in zip(*out, strict=True)), visited) if out else (*NONE, 0)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows whose vector can be compared."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & sound)


def nearest(queries: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, cosine): the k most similar entities of each query. Both sides have the columns id and v."""
    spark = queries.sparkSession
    sample = entities.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
    schema = "query_id bigint, id bigint, cosine double"
    if sample.empty:
        return spark.createDataFrame([], schema)
    d = max(sample["v"].map(len).mode())
    queries, entities = (df.where(F.size("v") == d) for df in (queries, entities))
    rows = _unit(sample["v"][sample["v"].map(len) == d])
    mean, rotation = learn_rotations(rows)
    entity_blocks = max(1, math.ceil(entities.count() / ENTITY_BLOCK))
    asked = queries.count()
    if not asked:
        return spark.createDataFrame([], schema)
    # Each query is searched by itself: how many share a block changes no result.
    spread_over = min(math.ceil(spark.sparkContext.defaultParallelism / entity_blocks), math.ceil(asked / LEAST_QUERIES))
    query_blocks = max(math.ceil(asked / QUERY_BLOCK), spread_over)
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "v", place(query_blocks).alias("qb"), every(entity_blocks).alias("eb"))
    right = entities.select("id", "v", place(entity_blocks).alias("eb"), every(query_blocks).alias("qb"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "cosine": []})
        ids = b["id"].to_numpy()
        q, r, score, _ = search(_unit(a["asked"]), _unit(b["v"]), ids, mean, rotation, k)
        return pd.DataFrame({"query_id": a["query_id"].to_numpy()[q], "id": ids[r], "cosine": score})

    # New names on one side: both may stem from the same frame.
    cells = query_blocks * entity_blocks
    cell = (F.col("qb") * entity_blocks + F.col("eb")).alias("cell")
    left, right = left.select(F.col("id").alias("query_id"), F.col("v").alias("asked"), cell), right.select("id", "v", cell)
    spread = [df.repartitionById(cells, "cell") for df in (left, right)]
    met = spread[0].groupBy("cell").cogroup(spread[1].groupBy("cell")).applyInPandas(pair, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.col("id"))
    if entity_blocks == 1:
        return met
    return met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
