"""Candidate lists: packed strings ``gene::tax::species::term|...`` and arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("gene_id", "tax_id", "species", "term")
PARSERS = ("strict", "maxsplit", "unchecked")


def pack(candidates: Column) -> Column:
    """Array of candidate structs to its string."""
    return F.array_join(F.transform(candidates, lambda c: F.concat_ws("::", *(c[f] for f in FIELDS))), "|")


def entries(packed: Column) -> Column:
    """Trimmed, non-empty entries of a packed list."""
    return F.filter(F.transform(F.split(F.coalesce(packed, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def unpack(packed: Column, parser: str = "maxsplit") -> Column:
    """Array of candidate structs. 'strict' drops entries that aren't four fields, 'maxsplit' lets the term hold '::',
    'unchecked' keeps every entry."""
    if parser not in PARSERS:
        raise ValueError(f"parser is one of {PARSERS}")
    parts = F.transform(entries(packed), lambda e: F.split(e, "::", -1 if parser == "strict" else 4))
    if parser != "unchecked":
        parts = F.filter(parts, lambda p: F.size(p) == 4)
    return F.transform(parts, lambda p: F.struct(*(F.get(p, F.lit(i)).alias(f) for i, f in enumerate(FIELDS))))


def gold_set(gold: Column) -> Column:
    """Distinct identifiers of a '|' list, sorted as strings."""
    return F.array_sort(F.array_distinct(entries(gold)))


def letter_of(position: Column) -> Column:
    """'A' for position 0; null beyond 'Z'."""
    return F.when(position.between(0, 25), F.char(position + 65))


def position_of(letter: Column) -> Column:
    return F.when(letter.rlike("^[A-Z]$"), F.ascii(letter) - 65)


def candidate_at(candidates: Column, letter: Column) -> Column:
    """The candidate that a letter names, null where there's none."""
    return F.get(candidates, position_of(letter))


def first_index(values: Column, value: Column) -> Column:
    """Position from 0 of the first equal element, null where there's none."""
    at = F.array_position(values, value)
    return F.when(at > 0, at - 1)


def distinct_folded(values: Column, most: int) -> Column:
    """The first ``most`` elements that differ in more than letter case, in order."""
    kept = F.aggregate(
        values,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)),
    )
    return F.slice(kept, 1, most)


def option_lines(candidates: Column, style: str = "full", most: int | None = None) -> Column:
    """Lettered options, one per line: all, or the first ``most``. More than 26 have no letters and raise."""
    def text(c: Column) -> Column:
        full = F.concat(F.lit("GeneID: "), c["gene_id"], F.lit(" | Species: "), c["species"], F.lit(" | Matched term: "), c["term"])
        return {
            "full": full,
            "geneid_species_term": full,
            "term_species": F.concat_ws(" ", c["term"], c["species"]),
            "term_only": c["term"],
        }[style]

    head = candidates if most is None else F.slice(candidates, 1, most)
    lines = F.array_join(F.transform(head, lambda c, i: F.concat(letter_of(i), F.lit(". "), text(c))), "\n")
    return F.when(F.size(head) > 26, F.raise_error(F.lit("more than 26 options"))).otherwise(lines)


def permuted(candidates: Column, key) -> Column:
    """Structs (old_pos, c) in the order of key(position); both sides of a position map."""
    tagged = F.transform(candidates, lambda c, i: F.struct(key(i).alias("k"), i.alias("old_pos"), c.alias("c")))
    return F.transform(F.array_sort(tagged), lambda t: F.struct(t["old_pos"].alias("old_pos"), t["c"].alias("c")))
