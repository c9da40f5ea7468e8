"""Symbols to identifiers, by cascades of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import species_priority

#: Steps of each cascade: column and name of the mode.
CASCADES = {
    "species": [("exact_gene", "species"), ("only_gene", "unique_global"), ("human_gene", "human_fallback"), ("first_gene", "first_fallback")],
    "named": [("exact_gene", "species"), ("only_gene", "unique_global"), ("prior_gene", "prior_tax"), ("common_gene", "count_fallback")],
    "prior": [("only_gene", "unique_global"), ("prior_gene", "prior_tax"), ("common_gene", "count_fallback")],
    "global": [("last_gene", "global")],
}


def _per_term(dictionary: DataFrame) -> DataFrame:
    """What a term means without its species: the only gene; the human one; that of the first of human, mouse and rat;
    the most frequent; the first and the last in the order of species."""
    frequent = F.struct((-F.col("n_count")).alias("less"), "tax_id", "gene_id")
    prior = F.when(species_priority(F.col("tax_id")) < 99, F.struct(species_priority(F.col("tax_id")).alias("p"), (-F.col("n_count")).alias("less"), "gene_id"))
    return dictionary.groupBy("term").agg(
        F.when(F.min("gene_id") == F.max("gene_id"), F.min("gene_id")).alias("only_gene"),
        F.min(F.when(F.col("tax_id") == "9606", F.col("gene_id"))).alias("human_gene"),
        F.min(prior)["gene_id"].alias("prior_gene"),
        F.min(frequent)["gene_id"].alias("common_gene"),
        F.min(F.struct("tax_id", "gene_id"))["gene_id"].alias("first_gene"),
        F.max(F.struct("tax_id", "gene_id"))["gene_id"].alias("last_gene"),
    )


def ground(asked: DataFrame, dictionary: DataFrame, cascade: str = "species") -> DataFrame:
    """asked (id, term, tax_id) with gene_id and the mode that found it.

    'species': term and species, then the only gene of the term, then the human one, then the first. 'prior': the only
    gene, then that of the first of human, mouse and rat, then the most frequent. 'named': term and species, then as
    'prior'. 'global': the last gene whatever the species.
    """
    exact = dictionary.groupBy("term", "tax_id").agg(F.max(F.struct("n_count", "gene_id"))["gene_id"].alias("exact_gene"))
    met = asked.join(_per_term(dictionary), "term", "left")
    if cascade in ("species", "named"):
        met = met.join(exact, ["term", "tax_id"], "left")
    steps = CASCADES[cascade]
    mode = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(m)) for c, m in steps), F.lit("unmapped"))
    return met.select(*asked.columns, F.coalesce(*(F.col(c) for c, _ in steps)).alias("gene_id"), mode.alias("mode"))


def focus_species(rows: DataFrame, focus: DataFrame, key: str, default: str | None = "9606") -> DataFrame:
    """rows with the species of their document, or the default."""
    tax = F.col("focus_tax") if default is None else F.coalesce("focus_tax", F.lit(default))
    return rows.join(focus, key, "left").withColumn("focus_tax", tax)


def override(base: DataFrame, better: DataFrame, key: str, value: str, only_missing: bool) -> DataFrame:
    """base with values from ``better``: where base has none (only_missing), or wherever better has one."""
    new = better.select(key, F.col(value).alias("_new"))
    order = (F.col(value), F.col("_new")) if only_missing else (F.col("_new"), F.col(value))
    return base.join(new, key, "left").withColumn(value, F.coalesce(*order)).drop("_new")


def gated(rows: DataFrame, trust, a: str, b: str, name: str = "chosen") -> DataFrame:
    """Value a where ``trust`` holds, else b."""
    return rows.withColumn(name, F.when(F.coalesce(trust, F.lit(False)), F.col(a)).otherwise(F.col(b)))


def boosted(predictions: DataFrame, gold: DataFrame, terms: DataFrame, span: list[str], term: str) -> DataFrame:
    """Predictions and, with an empty identifier, the gold spans that they miss and whose text is a listed term."""
    missing = gold.join(terms.select(F.col(term)).distinct(), term, "left_semi").join(predictions, span, "left_anti")
    return predictions.select(*span, "gene_id").unionByName(missing.select(*span, F.lit(None).cast("string").alias("gene_id")))
