"""Train, validation and test splits that keep related records together.

(1) Document ids are brought to one spelling; ids of one article are linked over any number of alias rows, so the
groups are the connected components of the alias graph, found by alternating star contractions (each round is a
minimum per node and a join; rounds grow with the logarithm of the longest chain, and end when every component is a star). (2) Groups are weighed by their rows.
(3) Largest-differencing balance: groups sorted by weight fill tuples of ``BINS`` slots; the two tuples of greatest
spread are combined again and again, heaviest slot on lightest, until one tuple of nearly equal bins is left. While
there are more than ``TUPLES`` tuples, all neighbours in the order of spread are combined in parallel, halving their
number in each round; the rest, a bounded number, is combined in one task. (4) Whole bins go to the split that misses
most of its proportion.

Nothing but the weights of ``BINS`` bins and row counts reaches the driver.

Defined results: rows with a null or blank document id form a group of their own each. An alias row that misses a side,
or ties an id to itself, links nothing. Groups without a PMID have no number (null). Repeated rows count as rows; an
empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import article_id, pmid
from spanforge.operators.ordering import numbered
from spanforge.session import cut, shuffle_width

BINS = 500
TUPLES = 5_000
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def article_key(doc_id: Column) -> Column:
    """'a' and eight digits for a PMID, 'b' and the folded id for any other, null for a null or blank one: the least
    key of a group is its smallest PMID, if it has one."""
    return F.coalesce(F.concat(F.lit("a"), pmid(doc_id)), F.concat(F.lit("b"), article_id(doc_id)))


def _minima(edges: DataFrame) -> DataFrame:
    """u, v and the least of u and its neighbours. Nodes with so many neighbours that they would fill a task, at most
    4 x shuffle partitions, get it from a broadcast, the others by a join."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    rows = edges.count()
    limit = max(100_000, rows // (4 * shuffle_width(edges.sparkSession)))
    if rows <= limit:
        return edges.join(least.drop("n"), "u")
    least = cut(least)
    hubs = least.where(F.col("n") > limit).drop("n")
    if hubs.isEmpty():
        return edges.join(least.drop("n"), "u")
    of_hubs = edges.join(F.broadcast(hubs), "u")
    others = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("n") <= limit).drop("n"), "u")
    return of_hubs.unionByName(others)


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each node points to one root, and no root points on: then every component is one star. One aggregation of
    narrow rows."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    each = ends.groupBy("node").agg(F.sum("child").alias("children"), F.max("root").alias("root"))
    return each.where("children > 1 OR (children = 1 AND root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the least node of its component."""
    pairs = edges.select("u", "v").where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct()
    pairs = cut(pairs)
    while not _are_stars(pairs):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minima(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        met = _minima(cut(large))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u <> v").distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _combine(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the joint slots, and for each slot of a and of b the joint slot it went to: heaviest on lightest."""
    ra, rb = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
    to_a, to_b = np.empty(len(a), int), np.empty(len(b), int)
    to_a[ra], to_b[rb] = np.arange(len(a)), np.arange(len(b))
    return a[ra] + b[rb], to_a, to_b


def difference(tuples: np.ndarray) -> np.ndarray:
    """Largest differencing of n tuples of k slots: for each slot of each tuple the bin it ends in."""
    n, k = tuples.shape
    heap = [(-int(t.max() - t.min()), i) for i, t in enumerate(tuples)]
    heapq.heapify(heap)
    weights: dict[int, np.ndarray] = dict(enumerate(tuples))
    parts: dict[int, tuple[int, np.ndarray, int, np.ndarray]] = {}
    nxt = n
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        weights[nxt], to_i, to_j = _combine(weights.pop(i), weights.pop(j))
        parts[nxt] = (i, to_i, j, to_j)
        heapq.heappush(heap, (-int(weights[nxt].max() - weights[nxt].min()), nxt))
        nxt += 1
    places = {nxt - 1: np.arange(k)}
    for node in range(nxt - 1, n - 1, -1):
        at = places.pop(node)
        i, to_i, j, to_j = parts[node]
        places[i], places[j] = at[to_i], at[to_j]
    return np.stack([places[i] for i in range(n)]) if n else np.empty((0, k), int)


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with its global rank ``r`` from 0 in the given order."""
    return numbered(df, list(order), "r").withColumn("r", F.col("r") - 1)


def _combine_pairs(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            weights, to_a, to_b = [], [], []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                w, x, y = _combine(np.asarray(a), np.asarray(b) if b is not None else np.zeros(k, np.int64))
                weights.append(w)
                to_a.append(x)
                to_b.append(y)
            yield pd.DataFrame({"parent": pdf["parent"], "w": weights, "ca": pdf["ca"], "to_a": to_a, "cb": pdf["cb"], "to_b": to_b})

    return run


def balanced_bins(weights: DataFrame, bins: int = BINS, tuples: int = TUPLES) -> DataFrame:
    """(grp, weight, bin): groups in nearly equal bins by largest differencing."""
    ranked = _ranked(weights, F.desc("weight"), F.col("grp"))
    slots = cut(ranked.select("grp", "weight", F.expr(f"r div {bins}").alias("t"), (F.col("r") % bins).cast("int").alias("slot")))
    full = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("bigint")))
    level = slots.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("m")).select("t", full.alias("w"))
    level, links = cut(level), []
    while level.count() > tuples:
        spread = F.array_max("w") - F.array_min("w")
        r = _ranked(level.withColumn("spread", spread), F.desc("spread"), F.col("t"))
        pair = r.groupBy(F.expr("r div 2").alias("parent")).agg(
            F.min_by("t", "r").alias("ca"), F.min_by("w", "r").alias("a"),
            F.max(F.when(F.col("r") % 2 == 1, F.struct("t", "w"))).alias("o"),
        )
        pair = pair.select("parent", "ca", "a", F.col("o.t").alias("cb"), F.col("o.w").alias("b"))
        schema = "parent bigint, w array<bigint>, ca bigint, to_a array<int>, cb bigint, to_b array<int>"
        joint = cut(pair.mapInPandas(_combine_pairs(bins), schema))
        links.append(joint.select(F.col("ca").alias("t"), F.col("to_a").alias("to"), "parent").unionByName(
            joint.where("cb IS NOT NULL").select(F.col("cb").alias("t"), F.col("to_b").alias("to"), "parent")))
        level = joint.select(F.col("parent").alias("t"), "w")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        ends = difference(np.array(pdf["w"].tolist(), dtype=np.int64).reshape(len(pdf), bins))
        return pd.DataFrame({"t": pdf["t"], "place": list(ends.astype("int32"))})

    placed = level.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(last, "t bigint, place array<int>")  # at most ``tuples`` rows
    for link in reversed(links):
        joined = link.join(placed.withColumnRenamed("t", "parent"), "parent")
        placed = joined.select("t", F.transform("to", lambda i: F.get("place", i)).alias("place"))
    return slots.join(placed, "t").select("grp", "weight", F.get("place", F.col("slot")).alias("bin"))


def allot(bin_weights: dict[int, int], proportions: dict[str, float]) -> dict[int, str]:
    """Whole bins, heaviest first, each to the split that misses most of its proportion."""
    total = sum(bin_weights.values())
    missing = {s: p * total for s, p in proportions.items()}
    to = {}
    for b, w in sorted(bin_weights.items(), key=lambda x: (-x[1], x[0])):
        s = max(missing, key=lambda x: missing[x])
        to[b] = s
        missing[s] -= w
    return to


def split_related(
    rows: DataFrame, aliases: DataFrame, id_col: str = "row_id", proportions: dict[str, float] | None = None, bins: int = BINS, tuples: int = TUPLES
) -> DataFrame:
    """(id, grp, split) of every row; ``grp`` is the group's least article key."""
    links = aliases.select(article_key(F.col("id_a")).alias("u"), article_key(F.col("id_b")).alias("v")).dropna()
    roots = components(links)
    keyed = rows.select(F.col(id_col).alias("id"), article_key(F.col("doc_id")).alias("node"))
    alone = F.concat(F.lit("n"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    grouped = keyed.where("node IS NOT NULL").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("grp"))
    grouped = cut(grouped.unionByName(keyed.where("node IS NULL").select("id", alone.alias("grp"))))
    placed = cut(balanced_bins(grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("weight")), bins, tuples))
    weights = {r["bin"]: r["w"] for r in placed.groupBy("bin").agg(F.sum("weight").alias("w")).collect()}
    to = allot(weights, proportions or PROPORTIONS)
    split = F.element_at(F.create_map(*(F.lit(x) for pair in to.items() for x in pair)), F.col("bin")) if to else F.lit(None).cast("string")
    return grouped.join(placed.select("grp", split.alias("split")), "grp")
