"""Breakdowns of errors, enrichments and selections around the main pipeline."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import alnum_key
from spanforge.operators.ordering import capped

#: Words that name a family of genes rather than one.
FAMILY_WORDS = ("cytokine", "chemokine", "kinase", "mapk", "erk", "wnt", "tcr", "gpcr", "nf-kappa", "nf-κb", "interleukin", "receptor", "integrin", "complex", "family")
#: Mentions that stand for a whole family.
FAMILY_MENTIONS = ("MAPK", "NF-KAPPAB", "NF-ΚB", "WNT", "WNTS", "AKT", "ERK1/2")

#: Mentions that are looked at as triggers of family errors.
TRIGGER_MENTIONS = (
    "MAPK", "MAPK (p38)", "mitogen-activated protein kinase", "mitogen-activated protein kinases", "mitogen activated protein kinase", "NF-kappaB", "NF-κB",
    "nuclear factor (NF)-κB", "H3", "(H3", "histone", "WNT", "Wnt", "Wnts", "ERK1/2", "chemokines", "chemokine",
)
#: Genes of each family.
FAMILY_GENES = {
    "mapk": "5594 5595 26413 26416 26417 50689 1432",
    "mitogenactivatedproteinkinase": "5594 5595 26413 26416 26417 50689 1432",
    "erk12": "5594 5595 26417",
    "erk1and2": "5594 5595 26417",
    "mek12": "5604 5605 26395 26396",
    "nfkb": "4790 4791 5970 309165 18033 81736",
    "nfkappab": "4790 4791 5970 309165 18033 81736",
    "hif1alpha": "3091 29560",
    "hif1a": "3091 29560",
    "wnt": "7471 7472 7473 7474 7475 22408 22410 22415",
    "notch": "4851 4853 18128 18129 18130 18131 30718",
    "stat": "6772 6773 6774 6775 20848 20850",
    "akt": "207 208 10000 11651 11652 23797 101910198",
    "smad": "4086 4087 4088 4089 4090 17125 17126 17127 17128 17129 55994",
    "mcp1": "6347 24770 20296",
    "ccl2": "6347 24770 20296",
    "cxcl9": "17329 4283",
    "cxcl10": "15945 3627",
    "cxcl11": "56066",
    "chemokine": "6347 24770 20296 17329 4283 15945 3627 56066 6352 6387",
    "chemokines": "6347 24770 20296 17329 4283 15945 3627 56066 6352 6387",
    "h3": "15268 838577",
    "histone": "15268 838577 180073 837440",
    "cd68": "968 12514 287435",
    "cd44": "960 12505",
    "cd14": "929 12475 60350",
    "prc2": "2146 2147 2148",
    "tric": "6950",
    "ikbkinase": "3551 3552",
}
#: Parts of a key that name a family, and keys that begin with its name.
FAMILY_PARTS = {
    "mapk": "mapk", "mitogenactivatedproteinkinase": "mapk", "erk12": "erk12", "erk1and2": "erk12", "mek12": "mek12", "mek1and2": "mek12", "nfkb": "nfkb",
    "nfkappab": "nfkb", "hif1alpha": "hif1alpha", "hif1a": "hif1alpha",
}
FAMILY_STARTS = ("wnt", "stat", "smad", "akt")


def names_family(mention: Column) -> Column:
    """Longer than two characters, with a word that names a family."""
    low = F.lower(mention)
    return (F.length(mention) > 2) & low.rlike("|".join(FAMILY_WORDS))


def error_kind(gold: Column, mention: Column) -> Column:
    """Kind of a wrong answer: several gold genes, a mention that stands for a family, or another."""
    return F.when(F.size(gold) > 1, "multi_gold").when(F.upper(mention).isin(*FAMILY_MENTIONS), "family").otherwise("other")


def family_candidates(mention: Column) -> Column:
    """Sorted genes of the families that a mention names: by its key, by what it contains and by how it begins."""
    key = F.regexp_replace(alnum_key(mention), "[^a-z0-9]", "")
    genes = lambda name: F.array(*(F.lit(g) for g in FAMILY_GENES[name].split()))
    none = F.array().cast("array<string>")
    met = [F.when(key == name, genes(name)).otherwise(none) for name in FAMILY_GENES]
    met += [F.when(key.contains(part), genes(name)).otherwise(none) for part, name in FAMILY_PARTS.items()]
    met += [F.when(key.startswith(name), genes(name)).otherwise(none) for name in FAMILY_STARTS]
    return F.array_sort(F.array_distinct(F.concat(*met)))


def trigger_report(rows: DataFrame) -> DataFrame:
    """rows: mention, right, oracle (the list holds a gold gene). One row: how mentions that stand for many genes fare."""
    trigger = F.coalesce(F.col("mention").isin(*TRIGGER_MENTIONS), F.lit(False))
    wrong = F.col("oracle") & ~F.col("right")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(trigger).alias("trigger_total"), F.count_if(trigger & F.col("right")).alias("trigger_correct"),
        F.count_if(trigger & wrong).alias("trigger_wrong_oracle"), F.count_if(~trigger).alias("other_total"), F.count_if(~trigger & wrong).alias("other_wrong_oracle"),
    )


def missing_spans(gold: DataFrame, predicted: DataFrame, span: Sequence[str]) -> DataFrame:
    """Gold spans without a prediction."""
    return gold.join(predicted, list(span), "left_anti")


def soft_override(base: DataFrame, better: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values replaced where the other run has the same document, mention and gold."""
    new = better.groupBy(*keys).agg(F.max(value).alias("_new"))
    return base.join(new, list(keys), "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def enriched(candidates: DataFrame, genes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Candidates with columns of their gene, UNKNOWN where there's none; genes are unique."""
    met = candidates.join(genes.select("gene_id", *columns), "gene_id", "left")
    return met.withColumns({c: F.coalesce(F.col(c), F.lit("UNKNOWN")) for c in columns})


def gold_taxa(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """id and the sorted set of species of its gold genes."""
    met = rows.select("id", F.explode("gold").alias("gene_id")).join(genes.select("gene_id", "tax_id").distinct(), "gene_id")
    return met.groupBy("id").agg(F.array_sort(F.collect_set("tax_id")).alias("taxa"))


def cell_matches(mentions: DataFrame, cells: DataFrame, most: int = 5) -> DataFrame:
    """Cells (file, line, cell_no, cell) whose normalised text is a mention's, at most ``most`` per mention, in order."""
    asked = mentions.select("mention", alnum_key(F.col("mention")).alias("key")).distinct().where("key <> ''")
    met = asked.join(cells.withColumn("key", alnum_key(F.col("cell"))), "key")
    return capped(met, ["mention"], [F.col("file"), F.col("line"), F.col("cell_no")], most, "hit").drop("key")


def class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """How many negatives there are for each positive."""
    return rows.agg(F.round(F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1)), 6).alias("weight"))


def stacked(stages: Sequence[tuple[str, int]], total: int, spark) -> DataFrame:
    """Constant gains of successive systems with the running share of the total."""
    rows, run = [], 0
    for name, gain in stages:
        run += gain
        rows.append((name, gain, run, round(run / total, 6) if total else 0.0))
    return spark.createDataFrame(rows, "stage string, gain int, correct int, accuracy double")


def species_bonus(tax: Column, focus: Column, named: Column) -> Column:
    """0.8 for the document's species, 1 more for a species named by the model."""
    return F.when(tax == focus, 0.8).otherwise(0.0) + F.when(tax == named, 1.0).otherwise(0.0)


def sequential_permutation(ids: Sequence[str], seed: int, most: int = 1_000_000) -> list[str]:
    """The standard library's own shuffle of a bounded list, where a published split must be met bit by bit; anything
    larger is permuted by hash order instead."""
    if len(ids) > most:
        raise ValueError("use hash order beyond a million ids")
    out = list(ids)
    random.Random(seed).shuffle(out)
    return out


def sequential_orders(sizes: Sequence[int], seed: int) -> list[list[int]]:
    """One permutation per row with one generator that goes on from row to row."""
    generator, out = random.Random(seed), []
    for n in sizes:
        order = list(range(n))
        generator.shuffle(order)
        out.append(order)
    return out


def hash_order(key: Column, seed: int) -> Column:
    """The parallel permutation: sort by this."""
    return F.xxhash64(F.lit(seed), key)
