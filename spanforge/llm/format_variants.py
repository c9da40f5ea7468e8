"""Duplicates hidden by formatting differences.

Two rows are copies when their values agree after letter case and everything but letters and digits are dropped, and
after each value is put in the column it belongs to (term, gene or species), wherever it was written.

Plan. (1) Rows are counted by a bucket of their canonical key's hash: partial counts, at most ``BUCKETS`` rows move per
task. (2) Only keys of buckets at least as full as the hot threshold are counted themselves, again with partial counts;
a key is hot when its exact count reaches the threshold, rows / (4 x shuffle partitions), so there are never more than
4 x shuffle partitions hot keys, and only these (a bounded list) are sent to the driver and broadcast. (3) Hot keys are
aggregated in two levels, first by (key, salt), then by key; all others by one shuffle on the key. The representative
is the smallest identifier.

Defined results: rows with a null or empty value, or whose values aren't one term, one gene and one species, take no
part. Exact copies are copies. Repeated identifiers are rows of their own. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import cut, shuffle_width

BUCKETS = 1 << 14
SALTS = 64


def canonical_value(value: Column) -> Column:
    """Lower case, letters and digits only; plain ASCII values skip the Unicode pattern."""
    folded = F.lower(value)
    return F.when(folded.rlike(r"^[a-z0-9]*\z"), folded).otherwise(F.regexp_replace(F.lower(F.upper(folded)), r"[^\p{L}\p{Nd}]", ""))


def record_keys(kb: DataFrame, taxa: DataFrame, id_col: str = "kb_id") -> DataFrame:
    """(id, key) of the rows that form a record: term, gene and species in this order whatever columns they stood in.

    ``taxa`` is a fixed dimension (a few hundred species); its values travel as one literal array. The check of its
    size keeps that so.
    """
    species = [r[0] for r in taxa.select(canonical_value(F.col("tax_id").cast("string"))).dropna().distinct().limit(20_001).collect()]
    if len(species) > 20_000:
        raise ValueError("taxa is taken to be a small dimension of at most 20,000 species")
    values = [canonical_value(F.col(c)).alias(f"v{i}") for i, c in enumerate(("term", "gene_id", "tax_id"))]
    rows = kb.select(F.col(id_col).alias("id"), *values)
    def kind(v: Column) -> Column:
        digits = v.rlike(r"^[0-9]+\z")
        number = F.when(v.isin(species), 2).otherwise(1) if species else F.lit(1)
        return F.when(digits, number).when(v.rlike(r"\p{L}"), 0)

    kinds = rows.select("*", *(kind(F.col(f"v{i}")).alias(f"k{i}") for i in range(3)))
    key = F.lit(None)
    for order in permutations(range(3)):  # order[k]: the column that holds the value of kind k
        fits = (F.col(f"k{order[0]}") == 0) & (F.col(f"k{order[1]}") == 1) & (F.col(f"k{order[2]}") == 2)
        key = F.when(fits, F.array(F.concat_ws("|", *(f"v{c}" for c in order)))).otherwise(key)
    # An empty array gives no row. A filter would be pushed below the projections and make the values once more.
    return kinds.select("id", F.explode(key).alias("key"))


def hot_keys(keyed: DataFrame) -> tuple[list[str], DataFrame]:
    """The keys that hold at least rows / (4 x shuffle partitions) rows, found exactly; at most 4 x shuffle partitions. And
    the rows to go on with: where a bucket is full enough they are written, so that the keys are made twice in all."""
    width = shuffle_width(keyed.sparkSession)
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS))
    counts = keyed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    full = counts.select("bucket", "n", F.sum("n").over(Window.partitionBy()).alias("rows"))  # at most BUCKETS rows
    full = full.where(F.col("n") * 4 * width >= F.col("rows")).where(F.col("n") > 1).collect()
    if not full:
        return [], keyed
    keyed = cut(keyed.select("id", "key"))
    least = full[0]["rows"] / (4 * width)
    within = keyed.where(bucket.isin([r["bucket"] for r in full]))
    exact = within.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("n") > 1))
    return [r["key"] for r in exact.select("key").collect()], keyed


def _split(keyed: DataFrame, hot: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    is_hot = F.col("key").isin(list(hot))
    return keyed.where(is_hot), keyed.where(~is_hot)


def _hot_records(rows: DataFrame) -> DataFrame:
    salted = rows.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    first = salted.agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"))
    return first.groupBy("key").agg(F.min("lo").alias("lo"), F.sum("n").alias("n"))


def collapse_records(keyed: DataFrame) -> DataFrame:
    """One row per record: key, representative (the smallest id) and number of copies."""
    hot, keyed = hot_keys(keyed)
    if not hot:
        return keyed.groupBy("key").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"))
    hot_rows, others = _split(keyed, hot)
    return others.groupBy("key").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")).unionByName(_hot_records(hot_rows))


def copies_beyond_first(keyed: DataFrame) -> DataFrame:
    """(lo, hi) for each copy beyond the first. Hot rows look their representative up in a broadcast of at most
    4 x shuffle partitions rows; the others meet it in one sorted pass over their shuffle partition."""
    hot, keyed = hot_keys(keyed)
    hot_rows, others = _split(keyed, hot) if hot else (None, keyed)
    order = Window.partitionBy("key").orderBy("id")
    ranked = others.select("id", F.first("id").over(order).alias("lo"), F.row_number().over(order).alias("nth"))
    found = ranked.where("nth > 1").select("lo", F.col("id").alias("hi"))
    if hot_rows is None:
        return found
    met = hot_rows.join(F.broadcast(_hot_records(hot_rows)), "key")
    return found.unionByName(met.where("id <> lo").select("lo", F.col("id").alias("hi")))
