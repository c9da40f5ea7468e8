"""Queries of the linking pipeline over the knowledge base, the mentions and their contexts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import answers, candidates, text
from spanforge.operators import contexts, evaluation, grounding, knowledge, ordering, prompts, retrieval
from spanforge.operators.nested import nested_tables
from spanforge.plans.linking_sql import SQL  # noqa: F401
from spanforge.plans.nested_queries import all_records
from spanforge.session import table

KB, MENTIONS, CONTEXTS = "ncbi_symbol_synonym_taxid_kb", "bioelqa_dev_mentions", "bioelqa_dev_mentions_contexts"
VECTORS, ENTITIES, ITEMS = "bioelqa_dev_mention_vectors", "bioelqa_dev_candidates_sapbert_genelevel_top20", "bioelqa_test_items"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.clean_lines(table(spark, d, KB))


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.symbol_dictionary(_lines(spark, d))


def _candidates(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    mentions = table(spark, d, MENTIONS)
    lines = knowledge.lines_of(_lines(spark, d), mentions.select(text.compact_key(F.col("mention"))), text.compact_key(F.upper("term")))
    return retrieval.dictionary_candidates(mentions, knowledge.symbol_dictionary(lines), k)


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """row_id, mention, context, gold (array), candidates (array, null if none)."""
    rows = table(spark, d, MENTIONS).select("row_id", "case_id", "mention", "context", candidates.gold_set(F.col("gold_geneid")).alias("gold"))
    return rows.join(retrieval.candidate_lists(_candidates(spark, d)), "row_id", "left")


def _letter(expr: str) -> Column:
    return candidates.letter_of(F.expr(f"CAST({expr} AS INT)"))


def kb_symbols(spark, d):
    return _dictionary(spark, d)


def kb_symbols_global(spark, d):
    return knowledge.symbol_dictionary(_lines(spark, d), by_species=False)


def kb_entity_terms(spark, d):
    return knowledge.entity_terms(_lines(spark, d))


def kb_entity_counted_terms(spark, d):
    return knowledge.entity_counted_terms(_lines(spark, d))


def kb_entity_first_terms(spark, d):
    return knowledge.entity_first_terms(_lines(spark, d))


def kb_gene_like(spark, d):
    rows = _lines(spark, d).where(text.gene_like(F.col("term")) & ~text.stopped(F.col("term")))
    return rows.groupBy("tax_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("term").alias("n_terms"))


def kb_species(spark, d):
    tax = F.col("tax_id")
    return _lines(spark, d).select("tax_id").distinct().select("tax_id", text.species_name(tax).alias("species"), text.species_priority(tax).alias("priority"))


def kb_most_common_terms(spark, d):
    return ordering.most_common(_lines(spark, d), "term", "ord", 25).select("term", "n")


def kb_first_and_last(spark, d):
    lines = _lines(spark, d).select("term", "ord", "gene_id")
    a = ordering.first_wins(lines, ["term"], "ord").select("term", F.col("gene_id").alias("first_gene"))
    b = ordering.last_wins(lines, ["term"], "ord").select("term", F.col("gene_id").alias("last_gene"))
    return a.join(b, "term")


def term_keys(spark, d):
    t = F.col("term")
    return _lines(spark, d).select(
        "ord", text.compact_key(t).alias("compact"), text.alnum_key(t).alias("alnum"), text.alnum_key(t, " ").alias("spaced_alnum"),
        text.greek_key(t).alias("greek"), text.spaced_key(t).alias("spaced"), text.symbol_key(t).alias("symbol"), text.without_suffix(t).alias("bare"),
    )


def mention_mode(spark, d):
    rows = table(spark, d, MENTIONS).where("gold_geneid IS NOT NULL")
    return ordering.mode_per_key(rows, ["mention"], "gold_geneid", "row_id")


def dictionary_candidates(spark, d):
    return _candidates(spark, d)


def dictionary_recall(spark, d):
    rows = _lists(spark, d).where(F.size("gold") > 0)
    return evaluation.recall_at(rows.select("gold", F.transform("candidates", lambda c: c["gene_id"]).alias("ids")), (1, 5, 10))


def candidate_strings(spark, d):
    """Lists packed and read again by the three parsers."""
    packed = _lists(spark, d).where("candidates IS NOT NULL").select("row_id", candidates.pack(F.col("candidates")).alias("packed"))
    sizes = (F.size(candidates.unpack(F.col("packed"), p)).alias(p) for p in candidates.PARSERS)
    return packed.select("row_id", "packed", *sizes)


def _dense(spark, d, k):
    q = table(spark, d, VECTORS).select(F.col("row_id").alias("id"), F.col("embedding").alias("v"))
    e = table(spark, d, ENTITIES).select(F.col("entity_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.dense_top(q, e, k)


def dense_candidates(spark, d):
    return _dense(spark, d, 20)


def dense_genes(spark, d):
    genes = table(spark, d, ENTITIES).select("entity_id", "gene_id")
    return retrieval.one_per_gene(_dense(spark, d, 50).join(genes, "entity_id"), 10).select("query_id", "gene_id", "pos")


def dense_recall(spark, d):
    genes = table(spark, d, ENTITIES).select("entity_id", "gene_id")
    lists = _dense(spark, d, 20).join(genes, "entity_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gene_id"))), lambda s: s["gene_id"]).alias("ids"))
    gold = table(spark, d, MENTIONS).select(F.col("row_id").alias("query_id"), candidates.gold_set(F.col("gold_geneid")).alias("gold")).where(F.size("gold") > 0)
    asked = table(spark, d, VECTORS).select(F.col("row_id").alias("query_id"))
    return evaluation.recall_at(gold.join(asked, "query_id").join(lists, "query_id", "left"), (1, 5, 10, 20))


def ngram_candidates(spark, d):
    """The five best terms of every mention row, each by its least entity; equal mentions are scored once."""
    rows = table(spark, d, VECTORS).where("mention IS NOT NULL").select(F.col("mention").alias("text"), "row_id")
    known = table(spark, d, ENTITIES).where("term IS NOT NULL").groupBy(F.col("term").alias("text")).agg(F.min("entity_id").alias("id"))
    asked = rows.groupBy("text").agg(F.min("row_id").alias("id"))
    best = retrieval.ngram_top(asked, known, 5).join(asked.withColumnRenamed("id", "query_id"), "query_id")
    return best.join(rows, "text").select("row_id", "entry_id", "score", "pos")


def ngram_genes(spark, d):
    asked = table(spark, d, VECTORS).select(F.col("row_id").alias("id"), F.col("mention").alias("text"))
    known = table(spark, d, ENTITIES).select(F.col("entity_id").alias("id"), "gene_id", F.col("term").alias("text"))
    return retrieval.ngram_genes(asked, known, 20)


def lexical_scores(spark, d):
    genes = table(spark, d, ENTITIES).where("term IS NOT NULL").groupBy("gene_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    rows = table(spark, d, MENTIONS).where("gold_geneid IS NOT NULL AND mention IS NOT NULL AND context IS NOT NULL")
    met = rows.select("row_id", "mention", "context", F.explode(candidates.gold_set(F.col("gold_geneid"))).alias("gene_id")).join(genes, "gene_id")
    f = evaluation.lexical_features(F.col("mention"), F.col("terms"), F.col("context"))
    bonus = evaluation.lexical_bonus(F.col("mention"), F.col("terms"), F.col("context"))
    return met.select("row_id", "gene_id", f["exact"].alias("exact"), f["appears"].alias("appears"), F.array_join(f["overlap"], "|").alias("overlap"), F.round(bonus, 6).alias("bonus"))


def context_attached(spark, d):
    keys = ["doc_id", "mention", "start_pos", "end_pos", "gold_geneid"]
    right = ordering.first_wins(table(spark, d, CONTEXTS).select(*keys, "row_id", "ctx_mention", "ctx_sentence"), keys, "row_id").drop("row_id")
    return contexts.attach(table(spark, d, MENTIONS).select("row_id", *keys), right, keys).select("row_id", "ctx_mention", "ctx_sentence")


def context_windows(spark, d):
    t, a, b = F.col("ctx_document"), F.col("start_pos"), F.col("end_pos")
    rows = table(spark, d, CONTEXTS).where("ctx_document <> '' AND start_pos >= 0 AND end_pos >= start_pos")
    return rows.select("row_id", text.window_context(t, a, b, 60).alias("window_60"), text.window_context(t, a, b, 500).alias("window_500"), text.marked_context(t, a, b, 160).alias("marked"))


def plain_sentences(spark, d):
    rows = ordering.first_wins(table(spark, d, CONTEXTS).where("ctx_document <> ''").select("doc_id", "row_id", "ctx_document"), ["doc_id"], "row_id")
    return rows.select("doc_id", F.inline(text.simple_sentences(F.col("ctx_document"))))


def sentence_contexts(spark, d):
    rows = table(spark, d, CONTEXTS)
    docs = ordering.first_wins(rows.where("ctx_document <> ''").select("doc_id", "row_id", "ctx_document"), ["doc_id"], "row_id")
    spans = rows.select("row_id", "doc_id", "start_pos", "end_pos")
    return contexts.with_sentence_contexts(spans, docs, "doc_id", "ctx_document", "start_pos", "end_pos").select("row_id", "sentence", "three_sentences")


def offset_sanity(spark, d):
    cut = F.expr("substring(ctx_document, start_pos + 1, end_pos - start_pos)")
    rows = table(spark, d, CONTEXTS).where("ctx_document <> '' AND mention <> ''")
    sane = F.coalesce((cut != "") & text.either_contains(cut, F.col("mention")), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n"), evaluation.rate(F.count_if(sane), F.count(F.lit(1))).alias("sane"))


def context_species(spark, d):
    rows = table(spark, d, MENTIONS).select("row_id", text.species_of_context(F.col("context")).alias("tax"))
    return rows.groupBy("tax").agg(F.count(F.lit(1)).alias("n"))


def text_lengths(spark, d):
    rows = table(spark, d, CONTEXTS).where("ctx_abstract <> ''").select("doc_id", "ctx_abstract").distinct()
    words, chars = F.size(F.split(F.col("ctx_abstract"), " ")), F.length("ctx_abstract")
    stats = lambda c, n: (F.round(F.avg(c), 6).alias(f"{n}_mean"), F.median(c).alias(f"{n}_median"), F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"))
    return rows.agg(F.count(F.lit(1)).alias("n"), *stats(words, "words"), *stats(chars, "chars"))


def _gold(spark, d, genes_only=True):
    return contexts.gold_mentions(all_records(spark, d), genes_only)


def gold_mentions(spark, d):
    return _gold(spark, d, False)


def gene_mentions(spark, d):
    return _gold(spark, d)


def document_texts(spark, d):
    p = F.col("passages")
    rows = all_records(spark, d).where("passages IS NOT NULL")
    return rows.select("rec_id", contexts.passage_text(p, "title").alias("title"), contexts.passage_text(p, "abstract").alias("abstract"), contexts.joined_text(p).alias("joined"))


def document_canvas(spark, d):
    p = F.col("passages")
    rows = all_records(spark, d).where("passages IS NOT NULL")
    return rows.select("rec_id", contexts.text_by_offsets(p).alias("canvas"), contexts.text_with_gaps(p).alias("padded"))


SPAN = ["doc_id", "start_pos", "end_pos"]


def _gold_spans(spark, d):
    rows = _gold(spark, d).select(text.article_id(F.col("doc_id")).alias("doc_id"), "start_pos", "end_pos", "gold_geneid", F.struct("rec_id", "ent_no").alias("ord"))
    return ordering.last_wins(rows, SPAN, "ord").select(*SPAN, candidates.gold_set(F.col("gold_geneid")).alias("gold"))


def _predicted_spans(spark, d):
    """Spans with the first candidate, if it is a number; ids of every kind keep their rows."""
    gene = text.bare_identifier(F.col("gene_id"))
    top = _candidates(spark, d, 1).select("row_id", F.when(gene.rlike("^[0-9]"), gene).alias("gene_id"))
    rows = table(spark, d, MENTIONS).select("row_id", text.article_id(F.col("doc_id")).alias("doc_id"), "start_pos", "end_pos").dropna()
    return ordering.last_wins(rows.join(top, "row_id", "left"), SPAN, "row_id").select(*SPAN, "gene_id")


def _focus(spark, d):
    """doc, focus_tax: the species that the entities of a document name most often."""
    records = all_records(spark, d)
    made = nested_tables(records)
    named = made["entity_identifiers"].where("db_name = 'Taxonomy'").join(made["documents"], "rec_id")
    order = F.col("rec_id") * 1_000_000 + F.col("parent_no") * 1000 + F.col("child_no")
    rows = named.select(text.article_id(F.col("document_id")).alias("doc"), F.col("db_id").alias("focus_tax"), order.alias("ord")).where("doc IS NOT NULL")
    return ordering.mode_per_key(rows, ["doc"], "focus_tax", "ord").drop("n_count")


def _with_focus(spark, d, default="9606"):
    rows = table(spark, d, MENTIONS).select("row_id", "mention", "context", text.article_id(F.col("doc_id")).alias("doc"))
    return grounding.focus_species(rows, _focus(spark, d), "doc", default)


def focus_species(spark, d):
    """Species of each mention's document, with the default and without."""
    bare = _with_focus(spark, d, None).select("row_id", F.coalesce("focus_tax", F.lit("")).alias("known_tax"))
    return _with_focus(spark, d).select("row_id", "focus_tax").join(bare, "row_id")


def span_accuracy(spark, d):
    return evaluation.span_metrics(_gold_spans(spark, d), _predicted_spans(spark, d), SPAN)


def tuple_scores(spark, d):
    gold = _gold_spans(spark, d).select(*SPAN, F.explode("gold").alias("gene_id")).distinct()
    return evaluation.tuple_metrics(gold, _predicted_spans(spark, d).where("gene_id IS NOT NULL"))


def span_scores(spark, d):
    return evaluation.tuple_metrics(_gold_spans(spark, d).select(*SPAN), _predicted_spans(spark, d).select(*SPAN))


def span_overlaps(spark, d):
    return evaluation.overlap_class(_gold_spans(spark, d), _predicted_spans(spark, d), "doc_id")


def error_stages(spark, d):
    met = _gold_spans(spark, d).join(_predicted_spans(spark, d).withColumn("seen", F.lit(True)), SPAN, "left")
    stage = F.when(F.col("seen").isNull(), "recognition_miss").when(F.coalesce(F.array_contains("gold", F.col("gene_id")), F.lit(False)), "correct").otherwise("linking_error")
    return met.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def gold_cardinality(spark, d):
    rows = table(spark, d, MENTIONS).select(F.size(candidates.gold_set(F.col("gold_geneid"))).alias("n_ids"))
    return rows.groupBy("n_ids").agg(F.count(F.lit(1)).alias("n_rows"))


def item_options(spark, d):
    rows = table(spark, d, ITEMS)
    options = F.regexp_extract_all("choices", F.lit(r"[A-Z]\. ([0-9]+)"), F.lit(1))
    made = rows.select("item_id", "answer", options.alias("ids"))
    return made.select("item_id", F.size("ids").alias("n_options"), F.get("ids", candidates.position_of(F.col("answer"))).alias("answer_gene"))


_ANSWERS = ["concat('Answer: ', answer)", "concat('answer:', lower(answer))", "concat('It is ', answer, '.')", "'none'", "concat('GeneID: ', item_id)", "concat('Symbol: ABC-', item_id, ' x')"]


def parsed_answers(spark, d):
    cases = " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(_ANSWERS))
    said = table(spark, d, ITEMS).select("item_id", F.expr(f"CASE item_id % 6 {cases} END").alias("said"))
    t = F.col("said")
    return said.select("item_id", answers.answer_letter(t).alias("letter"), answers.option_letter(t).alias("option"), answers.gene_number(t).alias("gene"), answers.symbol(t).alias("symbol"), answers.symbol(t, greedy=True).alias("symbol_line"))


def selector_scores(spark, d):
    rows = _lists(spark, d).where(F.size("gold") > 0).select("gold", "candidates", F.when(F.expr("row_id % 7 <> 0"), _letter("row_id % 5")).alias("letter"))
    return evaluation.selector_metrics(rows)


def option_texts(spark, d):
    rows = _lists(spark, d).where("candidates IS NOT NULL")
    return rows.select("row_id", *(candidates.option_lines(F.col("candidates"), s).alias(s) for s in ("full", "term_species", "term_only")))


def prompt_records(spark, d):
    packed = _lists(spark, d).select("case_id", "mention", "context", candidates.pack(F.coalesce("candidates", F.array())).alias("candidates"))
    return prompts.build_prompts(packed).select("case_id", "prompt", "reason", "n_options")


def _shuffled(spark, d):
    rows = _lists(spark, d).where("candidates IS NOT NULL")
    return rows.select("row_id", "candidates", candidates.permuted(F.col("candidates"), lambda i: (i * 7 + 3) % 11).alias("p"))


def position_map(spark, d):
    rows = _shuffled(spark, d).select("row_id", F.posexplode("p").alias("new_pos", "s"))
    letter = candidates.letter_of
    return rows.select("row_id", "new_pos", F.col("s.old_pos").alias("old_pos"), letter(F.col("new_pos")).alias("new_option"), letter(F.col("s.old_pos")).alias("old_option"), F.col("s.c.gene_id").alias("gene_id"))


def order_stability(spark, d):
    rows = _shuffled(spark, d)
    a = rows.select("row_id", F.transform("candidates", lambda c: c["gene_id"]).alias("ids"), _letter("row_id % 3").alias("letter"))
    b = rows.select("row_id", F.transform("p", lambda s: s["c"]["gene_id"]).alias("ids"), _letter("row_id % 4").alias("letter"))
    return evaluation.order_stability(a, b, "row_id")


def _asked(spark, d):
    """Symbol of each mention, and the species named in its context or else of its document."""
    tax = F.coalesce(text.species_of_context(F.col("context")), F.col("focus_tax"))
    return _with_focus(spark, d).select("row_id", text.symbol_key(F.col("mention")).alias("term"), tax.alias("tax_id"))


def _grounded(spark, d, cascade="species"):
    asked = _asked(spark, d)
    lines = knowledge.lines_of(_lines(spark, d), asked.select("term"), F.upper("term"))
    return grounding.ground(asked, knowledge.symbol_dictionary(lines), cascade)


def _ground(cascade):
    return lambda spark, d: _grounded(spark, d, cascade).select("row_id", "gene_id", "mode")


def mapping_modes(spark, d):
    made = _grounded(spark, d)
    gold = table(spark, d, MENTIONS).select("row_id", candidates.gold_set(F.col("gold_geneid")).alias("gold"))
    right = F.coalesce(F.array_contains("gold", F.col("gene_id")), F.lit(False))
    return made.join(gold, "row_id").groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"))


def _rescue(spark, d):
    rows = table(spark, d, MENTIONS).where("gold_geneid IS NOT NULL").select(F.lower("mention").alias("key"), F.explode(candidates.gold_set(F.col("gold_geneid"))).alias("gene"))
    return evaluation.dominant_value(rows.where("key IS NOT NULL"), "key", "gene")


def dominant_genes(spark, d):
    return _rescue(spark, d)


def rescued(spark, d, only_missing=True):
    """Dictionary predictions, the missing ones filled from reliable mentions; and what that gains and hurts."""
    top = _candidates(spark, d, 1).select("row_id", "gene_id")
    base = table(spark, d, MENTIONS).select("row_id", F.lower("mention").alias("key"), candidates.gold_set(F.col("gold_geneid")).alias("gold")).join(top, "row_id", "left")
    sure = evaluation.reliable(_rescue(spark, d)).select("key", F.col("top_value").alias("gene_id"))
    filled = grounding.override(base.withColumn("before", F.col("gene_id")), sure, "key", "gene_id", only_missing=only_missing)
    return evaluation.gain_hurt(filled, F.array_contains("gold", F.col("before")), F.array_contains("gold", F.col("gene_id")))


def overridden(spark, d):
    """The same with reliable mentions put in wherever there are any."""
    return rescued(spark, d, only_missing=False)


def _parts(spark, d):
    """Mention rows with their gold genes and the part of their document."""
    rows = table(spark, d, MENTIONS).select(F.col("row_id").alias("id"), text.article_id(F.col("doc_id")).alias("doc"), candidates.gold_set(F.col("gold_geneid")).alias("gold")).where("doc IS NOT NULL")
    return evaluation.hash_split(rows, F.col("doc"))


def _seen(spark, d):
    parts = _parts(spark, d)
    return evaluation.seen_split(parts.where("part = 'dev'"), parts.where("part = 'train'"), "gold")


def seen_genes(spark, d):
    return _seen(spark, d).groupBy("seen").agg(F.count(F.lit(1)).alias("n"))


def seen_accuracy(spark, d):
    """Accuracy of the first candidate where a gold gene occurs in the training part, and where none does."""
    top = _candidates(spark, d, 1).select(F.col("row_id").alias("id"), "gene_id")
    rows = _seen(spark, d).where(F.size("gold") > 0).join(top, "id", "left")
    return evaluation.accuracy_by(rows, "seen", F.array_contains("gold", F.col("gene_id")))


def split_overlap(spark, d):
    parts = _parts(spark, d)
    genes = lambda part: parts.where(F.col("part") == part).select(F.explode("gold").alias("gene_id"))
    return evaluation.overlap_count(genes("dev"), genes("train"))


def document_split(spark, d):
    docs = table(spark, d, MENTIONS).select(text.article_id(F.col("doc_id")).alias("doc")).dropna().distinct()
    return evaluation.hash_split(docs, F.col("doc"))


def occurrence_pairs(spark, d):
    """The k-th row of a mention with the k-th row of its contexts."""
    a, b = (table(spark, d, t).where("mention IS NOT NULL").select("mention", "row_id") for t in (MENTIONS, CONTEXTS))
    return ordering.match_occurrences(a, b, ["mention"], "row_id").select("row_id", "row_id_right", F.col("nth").cast("bigint").alias("nth"))


def positional_pairs(spark, d):
    """Row i of the mentions with row i of their contexts."""
    a, b = (table(spark, d, t).select("row_id", "mention") for t in (MENTIONS, CONTEXTS))
    return ordering.zipped(a, b, "row_id")


def row_cases(spark, d):
    made = ordering.numbered(table(spark, d, MENTIONS).select("row_id", "mention"), "row_id")
    return made.select(F.concat(F.lit("case_"), F.col("ordinal").cast("string")).alias("case_id"), "row_id", "mention")


def prompt_cases(spark, d):
    """Ordinals among the cases that get a prompt."""
    written = _lists(spark, d).where("size(candidates) > 0").select("row_id", "mention")
    return ordering.numbered(written, "row_id").select(F.concat(F.lit("prompt_case_"), F.col("ordinal").cast("string")).alias("case_id"), "row_id", "mention")


def training_examples(spark, d):
    pool = _lines(spark, d).groupBy(text.compact_key(F.col("term")).alias("surface"), "gene_id").agg(F.min("ord").alias("ord"))
    rows = table(spark, d, MENTIONS).select(F.col("row_id").alias("id"), text.compact_key(F.col("mention")).alias("surface"), candidates.gold_set(F.col("gold_geneid")).alias("golds"))
    return evaluation.training_examples(rows.where("surface IS NOT NULL AND size(golds) > 0"), pool, 3, "surface", "ord")


def example_split(spark, d):
    """Training examples in a hashed order's ten percent and the rest."""
    rows = training_examples(spark, d)
    return evaluation.hash_split(rows, F.concat_ws(":", F.col("id").cast("string"), "gold_id", "gene_id"), 7, 10, "validation")


def unanswered(spark, d):
    rows = table(spark, d, MENTIONS).select("row_id", "case_id")
    return rows.join(table(spark, d, CONTEXTS).select("row_id"), "row_id", "left_anti")


def token_spans(spark, d):
    """Tokens of each context labelled B, I or O by the mention, and merged to spans again."""
    rows = table(spark, d, MENTIONS).where("context IS NOT NULL AND start_pos IS NOT NULL AND end_pos > start_pos").select("row_id", "context", "start_pos", "end_pos")
    made = contexts.tokens(rows, "context").select("row_id", "tok_no", "tok_start", "tok_end", contexts.bio_label(*(F.col(c) for c in ("tok_start", "tok_end", "start_pos", "end_pos"))).alias("label"))
    return contexts.merged_spans(made, ["row_id"]).select("row_id", "span_start", "span_end")


def event_props(spark, d):
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def event_spread(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return rows.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"))


def order_lines(spark, d):
    """A large equi-join of the general tables, aggregated on both sides."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    met = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return met.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("amount"), 2).alias("amount"))


QUERIES = {f.__name__: f for f in (
    kb_symbols, kb_symbols_global, kb_entity_terms, kb_entity_counted_terms, kb_entity_first_terms, kb_gene_like, kb_species, kb_most_common_terms, kb_first_and_last, term_keys, mention_mode,
    dictionary_candidates, dictionary_recall, candidate_strings, dense_candidates, dense_genes, dense_recall, ngram_candidates, ngram_genes, lexical_scores, context_attached,
    context_windows, plain_sentences, sentence_contexts, offset_sanity, context_species, text_lengths, gold_mentions, gene_mentions, document_texts, document_canvas,
    span_accuracy, tuple_scores, span_scores, span_overlaps, error_stages, gold_cardinality, item_options, parsed_answers, selector_scores, option_texts, prompt_records,
    position_map, order_stability, mapping_modes, dominant_genes, rescued, overridden, focus_species, seen_genes, seen_accuracy, split_overlap, document_split, occurrence_pairs,
    positional_pairs, row_cases, prompt_cases, training_examples, example_split, unanswered, token_spans,
    event_props, event_spread, order_lines,
)} | {f"grounded_{c}": _ground(c) for c in ("species", "prior", "named", "global")}
