"""Writers. A single ordered file is only for results that one task can hold; everything else stays partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None, single: bool = False, mode: str = "overwrite") -> None:
    """Tab-separated with a header, quotes doubled; ordered by range, one file on demand."""
    out = df.orderBy(*order) if order else df
    out = out.coalesce(1) if single else out
    out.write.mode(mode).csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The column value as plain lines."""
    df.select("value").write.mode(mode).text(path)


def flat_predictions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tabs and line breaks of the answers become spaces."""
    return df.withColumns({c: F.translate(F.col(c), "\t\n\r", "   ") for c in columns})


def append_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_both(df: DataFrame, parsed: list[str], parsed_path: str, raw_path: str) -> None:
    """Parsed columns and raw responses from one run of the plan."""
    kept = df.persist()
    try:
        write_tsv(kept.select(*parsed), parsed_path)
        write_jsonl(kept, raw_path)
    finally:
        kept.unpersist()


def pubtator_blocks(texts: DataFrame, mentions: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """doc_id, value: one block per document: title, abstract, species line, mention lines in order, and a blank line.

    texts: doc_id, title, abstract; mentions: doc_id, start_pos, end_pos, mention, identifier; focus: doc_id, focus_tax.
    """
    line = F.concat_ws("\t", "doc_id", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), "mention", F.lit("Gene"), F.coalesce("identifier", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "mention", line.alias("line"))))
    lines = mentions.groupBy("doc_id").agg(F.transform(ordered, lambda s: s["line"]).alias("lines"))
    head = F.array(F.concat("doc_id", F.lit("|t|"), F.coalesce("title", F.lit(""))), F.concat("doc_id", F.lit("|a|"), F.coalesce("abstract", F.lit(""))))
    out = texts.join(lines, "doc_id", "left")
    species = F.array().cast("array<string>")
    if focus is not None:
        out = out.join(focus, "doc_id", "left")
        tax = F.coalesce("focus_tax", F.lit("9606"))
        species = F.array(F.concat_ws("\t", "doc_id", F.lit("0"), F.lit("0"), tax, F.lit("Species"), F.concat(F.lit("*"), tax)))
    body = F.concat(head, species, F.coalesce("lines", F.array().cast("array<string>")), F.array(F.lit("")))
    return out.select("doc_id", F.array_join(body, "\n").alias("value"))


def last_per_case(df: DataFrame, order: str) -> DataFrame:
    """One row per case, the last one written."""
    w = Window.partitionBy("case_id").orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
