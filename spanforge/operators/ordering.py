"""Operators that depend on the order of rows: an explicit order column decides everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import cut


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself, or an error before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the first in order. Aggregation only, so it combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return picked.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return picked.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def best_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key: the greatest by the order columns, compared one after another."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return picked.select(*keys, *(F.col(f"r.{c}").alias(c) for c in (*order, *rest)))


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int, name: str = "pos") -> DataFrame:
    """The first ``most`` rows of each key with their place from 1; the plan prunes groups before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= most)


def numbered(df: DataFrame, order: str | list[Column], name: str = "ordinal") -> DataFrame:
    """Global ordinal from 1 in the given order without a single-task sort. The sorted rows are written once, each with
    its place in its partition: a second evaluation could cut the ranges elsewhere. The partitions' sizes, a few thousand
    at most, give the offsets."""
    placed = cut(df.orderBy(order).select("*", F.monotonically_increasing_id().alias("_numbered_at")))
    part = F.shiftright("_numbered_at", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.array(*(F.lit(b) for b in before)), part.cast("int") + 1) if before else F.lit(0)
    return placed.withColumn(name, offset.cast("bigint") + F.col("_numbered_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_numbered_at")


def zipped(left: DataFrame, right: DataFrame, order: str, suffix: str = "_right") -> DataFrame:
    """Row i of one side with row i of the other; the longer side's rest has no partner and is left out."""
    a, b = numbered(left, order, "_row"), numbered(right, order, "_row")
    return a.join(b.select("_row", *(F.col(c).alias(f"{c}{suffix}") for c in right.columns)), "_row").drop("_row")


def nth_occurrence(df: DataFrame, keys: Sequence[str], order: str, name: str = "nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def match_occurrences(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The k-th row of a key on one side with the k-th on the other; each right row is used once."""
    a, b = nth_occurrence(left, keys, order), nth_occurrence(right, keys, order)
    return a.join(b.withColumnRenamed(order, f"{order}_right"), [*keys, "nth"], "left")


def most_common(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The most frequent values, ties to the one seen first."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(most)


def mode_per_key(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key with its count, ties to the one seen first. Two aggregations, the second on
    the already small counts."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first_seen")).alias("seen"), value)).alias("b"))
    return best.select(*keys, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n_count"))
