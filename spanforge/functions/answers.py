"""Reading a model's free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of an answer are those of the patterns below.
_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def answer_letter(text: Column, default: str = "NONE") -> Column:
    """'Answer: x' in any case, x any letter whatever follows; else a capital on its own; else the default."""
    return F.coalesce(F.upper(_found(text, r"(?i)Answer:\s*([A-Z])")), _found(text, _EDGE + "([A-Z])" + _END), F.lit(default))


def option_letter(text: Column) -> Column:
    """The same for A to E, where the letter must stand alone; null if there's none."""
    return F.coalesce(F.upper(_found(text, r"(?i)Answer\s*:\s*([A-E])" + _END)), _found(text, _EDGE + "([A-E])" + _END))


def known_letter(text: Column) -> Column:
    letter = F.upper(F.trim(text))
    return F.when(letter.isin("A", "B", "C", "D", "E"), letter)


def gene_number(text: Column) -> Column:
    return _found(text, r"GeneID:\s*([0-9]+)")


def symbol(text: Column, greedy: bool = False) -> Column:
    """The word behind the label, or greedily the rest of its line."""
    return F.trim(_found(text, r"Symbol:\s*(.+)")) if greedy else _found(text, r"Symbol:\s*([A-Za-z0-9_.\-/]+)")


def tax_number(text: Column) -> Column:
    return _found(text, r"TaxID:\s*([0-9]+|unclear)")


def species(text: Column) -> Column:
    return F.trim(_found(text, r"Species:\s*([^\t\n\r]+)"))
