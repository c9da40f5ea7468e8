"""Command line: python -m spanforge COMMAND ... Each command reads and writes the files of one stage."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import answers, candidates, text
from spanforge.operators import contexts, diagnostics, evaluation, knowledge, models, ordering, prompts, retrieval
from spanforge.session import build_session
from spanforge.sources import lines, sinks
from spanforge.sources.arrow_ipc import read_arrow

KEYS = ["doc_id", "mention", "start_pos", "end_pos", "gold_geneid"]


def _numbered(df: DataFrame) -> DataFrame:
    return ordering.numbered(df.withColumn("_i", F.monotonically_increasing_id()), "_i", "row_id").drop("_i")


def _letters(spark, path: str) -> DataFrame:
    rows = lines.read_predictions(spark, path)
    return ordering.last_wins(rows.select("case_id", answers.answer_letter(F.col("answer")).alias("letter"), "_ord"), ["case_id"], "_ord").drop("_ord")


def _report(made: DataFrame, a) -> None:
    """Shows a summary and, on demand, writes it as a table."""
    made.show(truncate=False)
    if getattr(a, "summary_output", ""):
        sinks.write_tsv(made, a.summary_output, single=True)


def _model(name: str):
    """The factory named by 'module:function'."""
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def _records(spark, path: str) -> DataFrame:
    return read_arrow(spark, path).withColumn("rec_id", F.monotonically_increasing_id())


def mentions(spark, a):
    rows = contexts.gold_mentions(read_arrow(spark, a.input).withColumn("rec_id", F.monotonically_increasing_id()), a.genes_only)
    sinks.write_tsv(rows, a.output, ["rec_id", "ent_no"])


def dictionary_build(spark, a):
    rows = lines.gene_info_terms(lines.read_gene_info(spark, a.input)).withColumnRenamed("_ord", "ord")
    sinks.write_tsv(knowledge.symbol_dictionary(rows), a.output, ["term", "tax_id"])


def dictionary(spark, a):
    rows = _numbered(lines.read_tsv(spark, a.mentions))
    listed = retrieval.candidate_lists(retrieval.dictionary_candidates(rows, lines.read_dictionary(spark, a.dictionary), a.k))
    packed = candidates.pack(F.coalesce("candidates", F.array())).alias("packed")
    sinks.write_tsv(rows.join(listed, "row_id", "left").select(*rows.columns, packed).withColumnRenamed("packed", "candidates"), a.output, ["row_id"])


def attach(spark, a):
    left, right = (lines.read_tsv(spark, p) for p in (a.candidates, a.contexts))
    sinks.write_tsv(contexts.attach(left, right, KEYS), a.output)


def shuffle(spark, a):
    rows = _numbered(lines.read_tsv(spark, a.input))
    listed = rows.withColumn("c", candidates.unpack(F.col("candidates")))
    moved = listed.withColumn("p", candidates.permuted(F.col("c"), lambda i: diagnostics.hash_order(F.concat_ws(":", F.col("row_id"), i), a.seed)))
    sinks.write_tsv(moved.withColumn("candidates", candidates.pack(F.transform("p", lambda s: s["c"]))).select(*rows.columns), a.output, ["row_id"])
    places = moved.select("row_id", F.posexplode("p").alias("new_pos", "s")).select("row_id", "new_pos", F.col("s.old_pos").alias("old_pos"), F.col("s.c.gene_id").alias("gene_id"))
    sinks.write_tsv(places, a.map_output, ["row_id", "new_pos"])


def split(spark, a):
    """Mentions of whole documents, a hashed share of them apart."""
    rows = contexts.gold_mentions(_records(spark, a.input), True)
    made = evaluation.hash_split(rows, F.col("doc_id"), a.seed, a.held_out_percent)
    for part, path in (("dev", a.dev_output), ("train", a.train_output)):
        sinks.write_tsv(made.where(F.col("part") == part).drop("part"), path, ["rec_id", "ent_no"])


def build_contexts(spark, a):
    """The context of each mention in six widths; documents that are missing give empty ones."""
    rows = lines.read_tsv(spark, a.mentions)
    rows = rows.select("*", F.col("start_pos").cast("int").alias("_a"), F.col("end_pos").cast("int").alias("_b"))
    passages = F.col("passages")
    docs = ordering.first_wins(
        _records(spark, a.input).select("rec_id", F.col("document_id").alias("doc_id"), contexts.text_with_gaps(passages).alias("_doc"), contexts.title_and_abstract(passages).alias("_abs")).where("doc_id IS NOT NULL"),
        ["doc_id"], "rec_id",
    )
    made = contexts.with_sentence_contexts(rows, docs, "doc_id", "_doc", "_a", "_b").join(docs.drop("rec_id"), "doc_id", "left")
    none = lambda c: F.coalesce(c, F.lit(""))
    window = text.window_context(F.col("_doc"), F.col("_a"), F.col("_b"), 500)
    own = rows.drop("_a", "_b").columns
    wide = {"ctx_mention": F.col("mention"), "ctx_sentence": F.col("sentence"), "ctx_3sent": F.col("three_sentences"), "ctx_500": window, "ctx_abstract": F.col("_abs"), "ctx_document": F.col("_doc")}
    sinks.write_tsv(made.select(*own, *(none(c).alias(n) for n, c in wide.items())), a.output, ["doc_id", "start_pos"])


def dense(spark, a):
    """Candidates by vectors of a dictionary's or a gene table's entities; the encoder is the caller's."""
    if not (a.gene_info or a.dictionary):
        raise SystemExit("give --gene-info or --dictionary")
    entities = knowledge.gene_info_entities(lines.read_gene_info(spark, a.gene_info, 9)) if a.gene_info else knowledge.entity_terms(lines.read_dictionary(spark, a.dictionary))
    entities = ordering.numbered(entities, "gene_id", "id")
    rows = _numbered(lines.read_tsv(spark, a.mentions))
    vectors = lambda df, column: retrieval.encode_texts(df.select("id", F.col(column).alias("text")), _model(a.encoder))
    top = retrieval.dense_top(vectors(rows.withColumnRenamed("row_id", "id"), "mention"), vectors(entities, "entity_text"), a.k)
    named = top.join(entities.withColumnRenamed("id", "entity_id"), "entity_id").withColumnRenamed("query_id", "row_id")
    listed = retrieval.candidate_lists(named)
    made = rows.join(listed, "row_id", "left").withColumn("candidates", candidates.pack(F.coalesce("candidates", F.array())))
    sinks.write_tsv(made.select(*rows.columns, "candidates"), a.output, ["row_id"])


def infer(spark, a):
    """Letters of prompts by a scorer, or decoded texts by a generator; the model is the caller's."""
    rows = lines.read_jsonl(spark, a.input, "case_id string, prompt string")
    made = models.score_letters(rows, _model(a.scorer)) if a.scorer else models.generate(rows, _model(a.generator)).withColumnRenamed("decoded", "answer")
    sinks.write_tsv(made, a.output, ["case_id"])


def evaluate_letters(spark, a):
    """Letters against the gold table: with prompts, missing and invalid answers told apart."""
    rows = lines.read_tsv(spark, a.gold)
    prompted = F.col("prompt_written") == "1" if "prompt_written" in rows.columns else F.lit(True)
    scored = rows.select("case_id", prompted.alias("prompted"), candidates.gold_set(F.col(a.gold_column)).alias("gold"), candidates.unpack(F.col("candidates")).alias("candidates"))
    met = scored.join(_letters(spark, a.predictions), "case_id", "left")
    _report(evaluation.selector_metrics(met).select(F.lit(a.label).alias("label"), "*"), a)


def analyze_order(spark, a):
    def run(path, said):
        rows = lines.read_tsv(spark, path).select("case_id", F.transform(candidates.unpack(F.col("candidates")), lambda c: c["gene_id"]).alias("ids"))
        return rows.join(_letters(spark, said), "case_id", "left")

    made = evaluation.order_stability(run(a.original, a.original_predictions), run(a.shuffled, a.shuffled_predictions), "case_id")
    _report(made.select(F.lit(a.seed).alias("seed"), "*"), a)


def build(spark, a):
    rows = lines.read_tsv(spark, a.candidates)
    rows = rows if "case_id" in rows.columns else _numbered(rows).withColumn("case_id", F.concat_ws("_", F.lit(a.case_prefix), "row_id"))
    made = prompts.build_prompts(rows.withColumn("context", F.col(a.context_column)), a.template, a.option_format, a.max_options or None)
    sinks.write_lines(prompts.records_json(made), a.prompts_output)
    if a.gold_output:
        sinks.write_tsv(made.select("case_id", "gold_geneid", F.col("prompt").isNotNull().cast("int").alias("prompt_written"), "candidates"), a.gold_output)
    if a.prompted_gold_output:
        sinks.write_tsv(made.where("prompt IS NOT NULL").select("case_id", "gold_geneid", "candidates"), a.prompted_gold_output)
    if a.skipped_output:
        sinks.write_tsv(prompts.rejects(made), a.skipped_output)


def evaluate(spark, a):
    rows = lines.read_tsv(spark, a.candidates)
    scored = rows.select("case_id", candidates.gold_set(F.col(a.gold_column)).alias("gold"), candidates.unpack(F.col("candidates")).alias("candidates"))
    met = scored.join(_letters(spark, a.predictions), "case_id", "left")
    _report(evaluation.selector_metrics(met), a)
    wrong = met.join(rows.select("case_id", "mention"), "case_id") if "mention" in rows.columns else None
    if wrong is not None:
        picked = candidates.candidate_at(F.col("candidates"), F.col("letter"))["gene_id"]
        missed = wrong.where(~F.coalesce(F.array_contains("gold", picked), F.lit(False)))
        missed.groupBy("mention").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "mention").limit(a.top).show(truncate=False)


def evaluate_spans(spark, a):
    span = ["doc_id", "start_pos", "end_pos"]
    gold = contexts.gold_mentions(read_arrow(spark, a.gold).withColumn("rec_id", F.monotonically_increasing_id()), True)
    gold = gold.select(*span, candidates.gold_set(F.col("gold_geneid")).alias("gold"))
    gene = text.bare_identifier(F.col("identifier"))
    found = lines.parse_pubtator(lines._lines(spark, a.predictions)).select(*span, gene.alias("gene_id"), "_ord").where(F.col("gene_id").rlike("^[0-9]"))
    found = ordering.last_wins(found, span, "_ord").drop("_ord")
    if a.mode == "tuple":
        _report(evaluation.tuple_metrics(gold.select(*span, F.explode("gold").alias("gene_id")).distinct(), found.distinct()), a)
    else:
        _report(evaluation.span_metrics(gold.dropDuplicates(span), found, span), a)


COMMANDS = {
    "mentions": (mentions, ["input", "output"], {"genes-only": False}),
    "dictionary-build": (dictionary_build, ["input", "output"], {}),
    "dictionary": (dictionary, ["mentions", "dictionary", "output"], {"k": 10}),
    "attach-contexts": (attach, ["candidates", "contexts", "output"], {}),
    "shuffle-candidates": (shuffle, ["input", "output", "map-output"], {"seed": 1}),
    "prompts": (build, ["candidates", "prompts-output"], {"context-column": "context", "template": "candidates", "option-format": "full", "max-options": 0, "case-prefix": "case", "gold-output": "", "prompted-gold-output": "", "skipped-output": ""}),
    "split": (split, ["input", "train-output", "dev-output"], {"seed": 42, "held-out-percent": 20}),
    "contexts": (build_contexts, ["mentions", "input", "output"], {}),
    "dense": (dense, ["mentions", "output"], {"gene-info": "", "dictionary": "", "encoder": "spanforge.operators.models:stub_encoder", "k": 20}),
    "infer": (infer, ["input", "output"], {"scorer": "", "generator": "spanforge.operators.models:stub_generator"}),
    "evaluate": (evaluate, ["candidates", "predictions"], {"gold-column": "gold_geneid", "summary-output": "", "top": 20}),
    "evaluate-letters": (evaluate_letters, ["gold", "predictions"], {"gold-column": "gold_geneid", "label": "", "summary-output": ""}),
    "evaluate-spans": (evaluate_spans, ["gold", "predictions"], {"mode": "all", "summary-output": ""}),
    "analyze-order": (analyze_order, ["original", "original-predictions", "shuffled", "shuffled-predictions"], {"seed": 1, "summary-output": ""}),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("spanforge")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, required, optional) in COMMANDS.items():
        own = commands.add_parser(name)
        for r in required:
            own.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            own.add_argument(f"--{o}", **({"action": "store_true"} if default is False else {"default": default, "type": type(default)}))
    args = parser.parse_args(argv)
    COMMANDS[args.command][0](build_session(), args)


if __name__ == "__main__":
    main()
