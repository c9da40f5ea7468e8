"""Texts of documents, gold mentions, and the contexts attached to mentions."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import sentence_context, simple_sentences, span_sentence, strip

#: Entity types that count as a gene.
GENE_KINDS = ("Gene", "GENERIF", "STARGENE")


def gold_mentions(records: DataFrame, genes_only: bool = False) -> DataFrame:
    """rec_id, doc_id, ent_no, mention, start_pos, end_pos, kind, gold_geneid of the entities that have an offset and an
    identifier; the identifiers as a sorted '|' list. ``genes_only`` keeps gene types and NCBIGene identifiers."""
    kept = "AND n.db_name = 'NCBIGene'" if genes_only else ""
    ids = f"transform(filter(e.normalized, n -> n IS NOT NULL AND n.db_id <> '' {kept}), n -> regexp_replace(n.db_id, '^(NCBI ?Gene:|GeneID:)', ''))"
    rows = f"""inline(filter(transform(entities, (e, i) -> named_struct('ent_no', CAST(i AS BIGINT), 'mention', e.text[0],
        'start_pos', e.offsets[0][0], 'end_pos', e.offsets[0][1], 'kind', e.kind,
        'gold_geneid', array_join(array_sort(array_distinct({ids})), '|'))),
        m -> m.start_pos IS NOT NULL AND m.gold_geneid <> ''))"""
    # An empty list of texts or offsets has no first element: get() gives null where [] would be an error.
    rows = rows.replace("e.text[0]", "get(e.text, 0)").replace("e.offsets[0][0]", "get(get(e.offsets, 0), 0)").replace("e.offsets[0][1]", "get(get(e.offsets, 0), 1)")
    out = records.select("rec_id", F.col("document_id").alias("doc_id"), F.expr(rows))
    return out.where(F.col("kind").isin(*GENE_KINDS)) if genes_only else out


def _spans(passages: Column) -> Column:
    """(start, end, text) of the passages that have both, in order of their start."""
    spans = F.transform(passages, lambda p: F.struct(
        F.get(F.get(p["offsets"], F.lit(0)), F.lit(0)).cast("int").alias("start"),
        F.get(F.get(p["offsets"], F.lit(0)), F.lit(1)).cast("int").alias("end"),
        F.array_join(p["text"], " ").alias("text"),
    ))
    return F.array_sort(F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & s["text"].isNotNull()))


def text_by_offsets(passages: Column) -> Column:
    """The document as a canvas of spaces with every passage at its offsets, clipped to its range."""
    spans = _spans(passages)
    size = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))

    def laid(canvas: Column, s: Column) -> Column:
        piece = F.substring(s["text"], F.lit(1), F.greatest(s["end"] - s["start"], F.lit(0)))
        return F.when(F.length(piece) > 0, F.overlay(canvas, piece, s["start"] + 1)).otherwise(canvas)

    return F.aggregate(spans, F.rpad(F.lit(""), size, F.lit(" ")), laid)


def text_with_gaps(passages: Column) -> Column:
    """Passages in order of their start, gaps filled with spaces, nothing clipped."""
    return F.aggregate(_spans(passages), F.lit(""), lambda t, s: F.concat(F.rpad(t, F.greatest(F.length(t), s["start"]), F.lit(" ")), s["text"]))


def joined_text(passages: Column) -> Column:
    """All texts joined by one space; offsets may drift."""
    return F.array_join(F.flatten(F.filter(F.transform(passages, lambda p: p["text"]), lambda t: t.isNotNull())), " ")


def passage_text(passages: Column, kind: str) -> Column:
    """Text of the passages of one kind, whatever its case."""
    own = F.filter(passages, lambda p: F.lower(p["kind"]) == kind)
    return strip(F.array_join(F.transform(own, lambda p: F.array_join(p["text"], " ")), " "))


def title_and_abstract(passages: Column) -> Column:
    return strip(F.concat_ws(" ", passage_text(passages, "title"), passage_text(passages, "abstract")))


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_context") -> DataFrame:
    """Left join on null-safe keys against a right side that must be unique: a repeated key raises when it is met.
    Columns of the right side that clash get the suffix."""
    doubled = F.count(F.lit(1)) > 1
    rest = [c for c in right.columns if c not in keys]
    named = {c: f"{c}{suffix}" if c in left.columns else c for c in rest}
    row = F.first(F.struct(*(F.col(c).alias(named[c]) for c in rest)))
    unique = right.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.when(doubled, F.raise_error(F.lit("repeated key"))).otherwise(row).alias("_r"))
    on = None
    for k in keys:
        equal = left[k].eqNullSafe(unique[f"_{k}"])
        on = equal if on is None else on & equal
    return left.join(unique, on, "left").select(*left.columns, *(F.col(f"_r.{c}").alias(c) for c in named.values()))


def with_sentence_contexts(df: DataFrame, documents: DataFrame, key: str, text: str, start: str, end: str, default: Column | None = None) -> DataFrame:
    """df with ``sentence`` and ``three_sentences`` of each span; windows of 120 and 250 where no sentence meets it, the
    default (or '') where the document is missing. Documents are unique by key; each is split once, before the join."""
    cut = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t"), simple_sentences(F.col(text)).alias("_s"))
    met = df.join(cut, F.col(key) == F.col("_k"), "left").withColumn("_at", span_sentence(F.col("_s"), F.col(start), F.col(end)))
    other = F.lit("") if default is None else F.coalesce(default, F.lit(""))
    own = lambda around, width: F.coalesce(sentence_context(F.col("_t"), F.col("_s"), F.col("_at"), F.col(start), F.col(end), around, width), other)
    return met.withColumns({"sentence": own(0, 120), "three_sentences": own(1, 250)}).drop("_k", "_t", "_s", "_at")


_WORD = re.compile(r"[^ \t\n\v\f\r]+")


def tokens(df: DataFrame, text: str) -> DataFrame:
    """The rows with one token each: tok_no, token, tok_start, tok_end; tokens are what white space parts. Places come
    from one pass over the text in Arrow batches."""
    @F.pandas_udf("array<struct<tok_start:int,tok_end:int,token:string>>")
    def run(texts: pd.Series) -> pd.Series:
        of = lambda t: [{"tok_start": m.start(), "tok_end": m.end(), "token": m.group()} for m in _WORD.finditer(t)]
        return pd.Series([None if t is None else of(t) for t in texts])

    return df.select("*", F.posexplode(run(F.col(text))).alias("tok_no", "_t")).select("*", "_t.*").drop("_t")


def bio_label(tok_start: Column, tok_end: Column, start: Column, end: Column) -> Column:
    """B for the token where the span begins, I inside it, O outside."""
    inside = (F.greatest(tok_start, start) < F.least(tok_end, end))
    return F.when(inside & (tok_start <= start), "B").when(inside, "I").otherwise("O")


def merged_spans(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of B and I tokens as character spans: gaps and islands over tok_no within the keys."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("tok_no")
    starts = (F.col("label") == "B") | ((F.col("label") == "I") & (F.lag("label", 1, "O").over(order) == "O"))
    islands = labelled.withColumn("island", F.sum(starts.cast("int")).over(order)).where("label <> 'O'")
    return islands.groupBy(*keys, "island").agg(F.min("tok_start").alias("span_start"), F.max("tok_end").alias("span_end"))
