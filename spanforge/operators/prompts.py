"""Prompt records, their gold side table and their rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.candidates import entries, option_lines, unpack
from spanforge.functions.text import flat

TEMPLATES = ("candidates", "context", "compact", "marked", "direct", "symbol", "species", "family", "rerank")


def prompt_text(template: str, mention: Column, context: Column, options: Column | None = None) -> Column:
    """The text for one case; null parts are left empty."""
    m, c = (F.coalesce(x, F.lit("")) for x in (mention, context))
    o = F.lit("") if options is None else options
    return {
        "candidates": F.concat(F.lit("Mention: "), m, F.lit("\nContext: "), flat(c), F.lit("\nCandidates:\n"), o, F.lit("\nGive the letter of the gene as Answer: <letter>.")),
        "context": F.concat(F.lit("Text: "), flat(c), F.lit("\nWhich gene is "), m, F.lit("?\n"), o, F.lit("\nAnswer:")),
        "compact": F.concat(F.lit("question: which gene is "), m, F.lit("? options: "), F.replace(o, F.lit("\n"), F.lit(" "))),
        "marked": F.concat(F.lit("Text: "), flat(F.replace(c, m, F.concat(F.lit("[MENTION]"), m, F.lit("[/MENTION]")))), F.lit("\nOptions for the marked gene:\n"), o, F.lit("\nAnswer:")),
        "species": F.concat(F.lit("Mention: "), m, F.lit("\nContext: "), flat(c), F.lit("\nGive the organism as TaxID: <number or unclear> and Species: <name>.")),
        "family": F.concat(F.lit("Mention: "), m, F.lit("\nContext: "), flat(c), F.lit("\nThe mention may stand for a family of genes. Options:\n"), o, F.lit("\nGive the letter of the gene meant as Answer: <letter>.")),
        "rerank": F.concat(F.lit("Mention: "), m, F.lit("\nContext: "), flat(c), F.lit("\nCandidate: "), o, F.lit("\nIs this the gene meant? Answer: <A for yes, B for no>.")),
        "direct": F.concat(F.lit("Mention: "), m, F.lit("\nContext: "), flat(c), F.lit("\nGive the identifier as GeneID: <number>.")),
        "symbol": F.concat(F.lit("Mention: "), m, F.lit("\nContext: "), flat(c), F.lit("\nGive the official symbol as Symbol: <symbol>.")),
    }[template]


def build_prompts(rows: DataFrame, template: str = "candidates", style: str = "full", most: int | None = None, parser: str = "maxsplit") -> DataFrame:
    """rows (case_id, mention, context, packed candidates) with prompt, reason and n_options. A case without usable
    candidates has no prompt but a reason; all cases stay, so that the gold table keeps one row each. ``most`` cuts the
    lists; a list of more than 26 raises."""
    every = unpack(F.col("candidates"), parser)
    listed = rows.withColumn("_c", every if most is None else F.slice(every, 1, most))
    reason = F.when(F.size(entries(F.col("candidates"))) == 0, "empty_candidates").when(F.size("_c") == 0, "bad_candidate_format")
    prompt = F.when(reason.isNull(), prompt_text(template, F.col("mention"), F.col("context"), option_lines(F.col("_c"), style)))
    return listed.select(*rows.columns, prompt.alias("prompt"), reason.alias("reason"), F.size("_c").alias("n_options")).drop("_c")


def rejects(prompts: DataFrame) -> DataFrame:
    """The cases without a prompt, with the first 500 characters of their context on one line."""
    return prompts.where("reason IS NOT NULL").select("case_id", "mention", "reason", F.substring(flat(F.coalesce("context", F.lit(""))), 1, 500).alias("context"))


def records_json(prompts: DataFrame) -> DataFrame:
    """One JSON object per written prompt; characters beyond ASCII stay as they are."""
    return prompts.where("prompt IS NOT NULL").select(F.to_json(F.struct("case_id", "mention", "context", "prompt")).alias("value"))
