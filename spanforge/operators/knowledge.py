"""Dictionaries and entity tables built from knowledge-base lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.candidates import distinct_folded
from spanforge.functions.text import lenient_int, listed_species, species_name, strip_field
from spanforge.operators.ordering import first_wins, mode_per_key


def clean_lines(kb: DataFrame, order: str = "kb_id") -> DataFrame:
    """Lines with a term that is no placeholder, and an identifier: ord, term, tax_id, gene_id, n_count."""
    named = [strip_field(F.col(c)).alias(c) for c in ("term", "tax_id", "gene_id")]
    rows = kb.select(F.col(order).alias("ord"), *named, lenient_int(F.col("n_count")).alias("n_count"))
    sound = "term <> '' AND term <> '-' AND tax_id <> '' AND gene_id <> ''"
    # An empty array gives no row. A filter would be pushed below the projection and strip every value once more.
    kept = F.explode(F.when(F.expr(sound), F.array(F.struct("term", "tax_id", "gene_id")))).alias("r")
    return rows.select("ord", kept, "n_count").select("ord", "r.term", "r.tax_id", "r.gene_id", "n_count")


def lines_of(lines: DataFrame, asked: DataFrame, key: Column) -> DataFrame:
    """The lines whose ``key`` is the value of a row of ``asked`` (one column): a dictionary for them needs no others, and
    what is left out is not aggregated."""
    keys = asked.select(F.col(asked.columns[0]).alias("_asked")).dropna().distinct()
    return lines.join(keys, key == F.col("_asked"), "left_semi")


def symbol_dictionary(lines: DataFrame, by_species: bool = True) -> DataFrame:
    """The most frequent gene of each upper-case term (and species); ties to the line seen first."""
    keys = ["term", "tax_id"] if by_species else ["term"]
    return mode_per_key(lines.withColumn("term", F.upper("term")), keys, "gene_id", "ord")


def _entities(ranked: DataFrame, most: int, unknown: str = "taxid:") -> DataFrame:
    """gene_id, tax_id, species, term, entity_text of genes from their terms in order (pos, term): the text is what an
    encoder gets, the terms and the species with spaces between."""
    few = ranked.where(F.col("pos") <= most)
    lists = few.groupBy("gene_id", "tax_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda s: s["term"]).alias("terms"))
    species = species_name(F.col("tax_id"), unknown)
    return lists.select("gene_id", "tax_id", species.alias("species"), F.get("terms", F.lit(0)).alias("term"), F.concat_ws(" ", F.array_join("terms", " "), species).alias("entity_text"))


def entity_terms(lines: DataFrame, most: int = 8) -> DataFrame:
    """Genes of the listed species with their ``most`` terms of greatest count, ties by term."""
    best = lines.where(listed_species(F.col("tax_id"))).groupBy("gene_id", "tax_id", "term").agg(F.max("n_count").alias("n_count"))
    order = Window.partitionBy("gene_id", "tax_id").orderBy(F.desc("n_count"), "term")
    return _entities(best.withColumn("pos", F.row_number().over(order)), most)


def entity_counted_terms(lines: DataFrame, most: int = 8) -> DataFrame:
    """Genes of every species with their terms by count, ties in the order of the lines; terms that differ only in case
    count once, as the first of them in that order is written."""
    rank = F.struct((-F.col("n_count")).alias("less"), "ord")
    best = lines.groupBy("gene_id", "tax_id", F.lower("term").alias("folded")).agg(F.min(rank).alias("rank"), F.min_by("term", rank).alias("term"))
    order = Window.partitionBy("gene_id", "tax_id").orderBy("rank")
    return _entities(best.withColumn("pos", F.row_number().over(order)), most, "taxid_")


def entity_first_terms(lines: DataFrame, most: int = 8) -> DataFrame:
    """Genes of the listed species with their first terms in the order of the lines, told apart by more than letter case."""
    # The first line of each folded term bounds the list by the gene's terms, not its lines.
    listed = lines.where(listed_species(F.col("tax_id")))
    first = listed.groupBy("gene_id", "tax_id", F.lower("term").alias("folded")).agg(F.min("ord").alias("ord"), F.min_by("term", "ord").alias("term"))
    order = Window.partitionBy("gene_id", "tax_id").orderBy("ord")
    return _entities(first.withColumn("pos", F.row_number().over(order)), most)


def gene_info_entities(info: DataFrame, most: int = 8) -> DataFrame:
    """Entities of a gene table (_ord, tax_id, gene_id, symbol, synonyms, description) of the listed species: symbol and
    synonyms told apart by more than case, species and description; the first row of each gene and species counts."""
    terms = F.filter(F.transform(F.concat(F.array("symbol"), "synonyms"), lambda t: F.trim(t)), lambda t: (t != "") & (t != "-"))
    rows = info.where(listed_species(F.col("tax_id")) & F.col("description").isNotNull()).withColumn("terms", distinct_folded(terms, most))
    first = first_wins(rows.where(F.size("terms") > 0), ["gene_id", "tax_id"], "_ord")
    species = species_name(F.col("tax_id"))
    text = F.concat_ws(" ", F.array_join("terms", " "), species, "description")
    return first.select("gene_id", "tax_id", species.alias("species"), F.get("terms", F.lit(0)).alias("term"), text.alias("entity_text"))
