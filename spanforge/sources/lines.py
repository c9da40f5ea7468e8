"""Text formats of the trade. Readers keep identifiers as strings and give lines an order column where it matters.

``_ord`` is increasing along each file, not gapless; ``ordering.numbered`` makes gapless numbers of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.text import lenient_int

#: Names that a dictionary's columns go by.
ALIASES = {
    "term": ("term", "symbol", "name", "alias", "synonym"),
    "tax_id": ("tax_id", "taxid"),
    "gene_id": ("gene_id", "geneid"),
    "n_count": ("n_count", "count", "freq", "frequency"),
}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("_ord"), "value")


def _fields(lines: DataFrame, at_least: int) -> DataFrame:
    return lines.select("_ord", "value", F.split("value", "\t").alias("f")).where(F.size("f") >= at_least)


def _at(i: int) -> Column:
    return F.col("f")[i]


def has_open_lines(spark: SparkSession, path: str) -> bool:
    """Whether any line holds an odd number of quotes, as where a field goes on over a line break."""
    return not spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty()


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multiline: bool | None = None) -> DataFrame:
    """A table with a header, all strings: 'NA' stays a text, an empty field is an empty text; quoted fields may hold
    tabs, doubled quotes and line breaks. Only files with line breaks in fields are read whole by one task; whether there
    are any is looked up unless it is said."""
    multiline = has_open_lines(spark, path) if multiline is None else multiline
    df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=multiline, nullValue="\u0000", emptyValue="")
    df = df.fillna("")
    return df.select(*columns) if columns else df


def read_gene_info(spark: SparkSession, path: str, at_least: int = 5) -> DataFrame:
    """_ord, tax_id, gene_id, symbol, synonyms (array), description; comments and short lines are left out."""
    lines = _fields(_lines(spark, path).where(~F.col("value").startswith("#")), at_least)
    synonyms = F.filter(F.split(_at(4), r"\|"), lambda s: (s != "-") & (s != ""))
    return lines.select("_ord", _at(0).alias("tax_id"), _at(1).alias("gene_id"), _at(2).alias("symbol"), synonyms.alias("synonyms"), F.get("f", F.lit(8)).alias("description"))


def gene_info_terms(info: DataFrame) -> DataFrame:
    """_ord, term, tax_id, gene_id: symbol and synonyms, without placeholders."""
    terms = F.explode(F.concat(F.array("symbol"), "synonyms")).alias("term")
    return info.select("_ord", terms, "tax_id", "gene_id").where("term <> '-' AND term <> ''")


def read_kb_lines(spark: SparkSession, path: str) -> DataFrame:
    """_ord, term, tax_id, gene_id, n_count of a table with these four columns in this order: the header and lines with
    fewer fields are left out, a count that's none is 0."""
    lines = _fields(_lines(spark, path), 4)
    header = spark.read.text(path).head()
    if header:
        lines = lines.where(F.col("value") != header[0])
    return lines.select("_ord", _at(0).alias("term"), _at(1).alias("tax_id"), _at(2).alias("gene_id"), lenient_int(_at(3)).alias("n_count"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """_ord, term, tax_id, gene_id, n_count of a table whose header names the columns by any of their names; a missing one
    raises, but for the count, which then is 0. Lines that don't reach a needed column are left out."""
    header = [h.strip().lower() for h in (spark.read.text(path).head() or [""])[0].split("\t")]
    where = {c: next((header.index(n) for n in names if n in header), None) for c, names in ALIASES.items()}
    missing = [c for c in ("term", "tax_id", "gene_id") if where[c] is None]
    if missing:
        raise ValueError(f"the header names no {', '.join(missing)}")
    lines = _fields(_lines(spark, path), max(where[c] for c in ("term", "tax_id", "gene_id")) + 1).where(F.lower("value") != "\t".join(header))
    pick = lambda c: F.get("f", F.lit(where[c])) if where[c] is not None else F.lit(None).cast("string")
    return lines.select("_ord", *(F.trim(pick(c)).alias(c) for c in ("term", "tax_id", "gene_id")), lenient_int(pick("n_count")).alias("n_count"))


def guess_columns(fields: Column) -> Column:
    """term, tax_id and gene_id of a line without a header, told by which of its first three fields are numbers: (tax,
    gene, term), (term, gene, tax) or (gene, term, tax). Null for any other pattern or fewer than four fields."""
    number = [F.coalesce(F.get(fields, F.lit(i)).rlike("^[0-9]+$"), F.lit(False)) for i in range(3)]
    struct = lambda term, tax, gene: F.struct(F.get(fields, F.lit(term)).alias("term"), F.get(fields, F.lit(tax)).alias("tax_id"), F.get(fields, F.lit(gene)).alias("gene_id"))
    a, b, c = number
    enough = F.size(fields) >= 4
    return F.when(enough & a & b & ~c, struct(2, 0, 1)).when(enough & ~a & b & c, struct(0, 2, 1)).when(enough & a & ~b & c, struct(1, 2, 0))


def read_headerless(spark: SparkSession, path: str) -> DataFrame:
    """_ord, term, tax_id, gene_id of such lines; those of no known pattern are left out."""
    return _fields(_lines(spark, path), 4).select("_ord", guess_columns(F.col("f")).alias("g")).where("g IS NOT NULL").select("_ord", "g.*")


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """One object per line; blank lines are skipped. The limit, if any, counts in file order."""
    rows = spark.read.text(path)
    if limit is not None:
        # Ordered by file and place in it: only so many rows per task are kept and merged.
        rows = rows.select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_n"))
        rows = rows.where(F.trim("value") != "").orderBy("_f", "_n").limit(limit)
    rows = rows.where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """_ord, case_id, answer: cut at the first tab only; the header and lines without a tab are left out."""
    parts = F.split("value", "\t", 2)
    rows = _lines(spark, path).select("_ord", parts.alias("f")).where(F.size("f") == 2)
    return rows.select("_ord", _at(0).alias("case_id"), _at(1).alias("answer")).where("case_id <> 'case_id'")


def read_loose_predictions(spark: SparkSession, path: str, case: str = r"([A-Za-z_]*case_[0-9]+)") -> DataFrame:
    """_ord, case_id, value: lines with a case id anywhere in them."""
    return _lines(spark, path).select("_ord", F.regexp_extract("value", case, 1).alias("case_id"), "value").where("case_id <> ''")


def parse_pubtator(lines: DataFrame, kind: str | None = "Gene", at_least: int = 6) -> DataFrame:
    """_ord, doc_id, start_pos, end_pos, mention, kind, identifier of annotation lines (_ord, value)."""
    rows = _fields(lines, at_least)
    out = rows.select(
        "_ord", _at(0).alias("doc_id"), _at(1).try_cast("int").alias("start_pos"), _at(2).try_cast("int").alias("end_pos"),
        _at(3).alias("mention"), _at(4).alias("kind"), F.get("f", F.lit(5)).alias("identifier"),
    )
    return out.where(F.col("kind") == kind) if kind else out


def parse_pubtator_texts(lines: DataFrame) -> DataFrame:
    """doc_id, title, abstract of the |t| and |a| lines."""
    part = lambda mark: F.max(F.when(F.col("mark") == mark, F.col("text")))
    rows = lines.select(*(F.regexp_extract("value", r"^([^|\t]+)\|([ta])\|(.*)$", i).alias(c) for i, c in ((1, "doc_id"), (2, "mark"), (3, "text")))).where("mark <> ''")
    return rows.groupBy("doc_id").agg(part("t").alias("title"), part("a").alias("abstract"))


def parse_focus_species(lines: DataFrame) -> DataFrame:
    """doc_id, focus_tax of the species lines with a marked identifier; a document's last line counts."""
    rows = parse_pubtator(lines, "Species").where(F.col("identifier").startswith("*"))
    return rows.groupBy("doc_id").agg(F.max_by(F.replace("identifier", F.lit("*"), F.lit("")), "_ord").alias("focus_tax"))


def packed_genes(packed: Column) -> Column:
    """Array of (tax_id, gene_id) of 'tax:gene-x,*gene-y|tax:...'."""
    def of(group: Column) -> Column:
        tax = F.regexp_extract(group, "^([0-9]+):", 1)
        genes = F.split(F.regexp_replace(group, "^[0-9]+:", ""), ",")
        made = F.transform(genes, lambda g: F.struct(tax.alias("tax_id"), F.regexp_extract(g, r"^\*?([0-9]+)", 1).alias("gene_id")))
        return F.filter(made, lambda s: (s["tax_id"] != "") & (s["gene_id"] != ""))

    return F.flatten(F.transform(F.split(packed, r"\|"), of))


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """file, line (from 1), cell_no, cell of every csv, tsv and txt file below a folder; commas within quotes part nothing.
    Lines are numbered within their file, so a file is the unit that one task must hold."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,tsv,txt}").text(folder)
    placed = files.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_n"), "value")
    rows = placed.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("_n")).cast("bigint"))
    commas = F.transform(F.split("value", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"')))
    cells = F.when(F.col("file").endswith(".csv"), commas).otherwise(F.split("value", "\t"))
    return rows.select("file", "line", F.posexplode(cells).alias("cell_no", "cell"))
