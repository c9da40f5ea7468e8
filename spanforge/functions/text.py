"""Column functions over terms, identifiers and texts with offsets. All stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The species that matter most and their order of preference.
SPECIES_NAMES = {
    "9606": "human",
    "10090": "mouse",
    "10116": "rat",
    "7955": "zebrafish",
    "7227": "fruit fly",
    "3702": "arabidopsis",
    "6239": "worm",
    "4932": "yeast",
}
SPECIES_PRIORITY = {"9606": 0, "10090": 1, "10116": 2}
#: Spelled-out Greek letters.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "κ": "kappa"}
#: Words that may trail a gene name.
SUFFIXES = ("proteins", "protein", "genes", "gene", "receptors", "receptor", "pathway", "signaling", "family", "complex")
#: Mentions that name no single gene.
STOP_TERMS = (
    "cytokines", "cytokine", "chemokines", "chemokine", "mapk", "wnt", "nf-kappab", "nf-κb", "erk1/2", "mek1/2", "gpcr", "gpcrs", "mcm2-7", "orc", "sac", "sac proteins",
    "kinase", "kinases", "receptor", "receptors", "transcription", "adrenaline", "histone", "complex iii", "actin filaments", "corticosterone",
)
#: Words of a text that tell its species, in order of preference.
SPECIES_WORDS = {
    "10090": ("mouse", "mice", "murine", "mus musculus", "c57bl", "balb/c", "129/sv", "nod mice"),
    "10116": ("rat", "rats", "rattus", "sprague-dawley", "wistar", "wk y", "sh r", "f344"),
    "9606": ("human", "humans", "patient", "patients", "clinical", "homo sapiens", "men", "women"),
}
#: The names that may stand before a PMID.
PMID = r"^(?:(?:https?://)?[a-z0-9.]*pubmed[a-z0-9.]*(?:[/:\s#=_-]+id)?[/:\s#=_-]*|(?:pmid|medline|pm)(?:[/:\s#=_-]+id)?[/:\s#=_-]*)?0*([1-9][0-9]{7})(?:\.[0-9]+|v[0-9]+)?/?\z"
#: Greek letters as a symbol spells them.
GREEK_UPPER = {"β": "BETA", "α": "ALPHA", "γ": "GAMMA"}
#: What is stripped from both ends of a symbol.
SYMBOL_EDGE = "`'\".,;:()[]{}"


_OUTER = r"^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def strip_field(c: Column) -> Column:
    """``strip`` for a plain column: values that begin and end with a visible ASCII character skip the pattern."""
    sound = F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)
    return F.when(sound, c).otherwise(strip(c))


def pmid(c: Column) -> Column:
    """The eight digits of an id that is a PMID whatever stands around it, else null; digits within other ids are none."""
    return F.nullif(F.regexp_extract(F.lower(F.regexp_replace(c, _OUTER, "")), PMID, 1), F.lit(""))


def article_id(c: Column) -> Column:
    """The PMID, or the id without case and outer white space; null where there's none."""
    return F.coalesce(pmid(c), F.nullif(F.lower(F.regexp_replace(c, _OUTER, "")), F.lit("")))


def compact_key(c: Column) -> Column:
    """Lower case without hyphens, underscores and spaces: the key of the dictionary lookup."""
    return strip_field(F.translate(F.lower(c), "-_ ", ""))


def alnum_key(c: Column, gap: str = "") -> Column:
    """Greek letters spelled out, then only a-z and digits; other runs become ``gap``."""
    out = F.lower(c)
    for letter, name in GREEK.items():
        out = F.replace(out, F.lit(letter), F.lit(name))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", gap))


def greek_key(c: Column) -> Column:
    """Lower-case letters, digits and Greek letters only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9αβγδκ]", "")


def spaced_key(c: Column) -> Column:
    """Lower case without hyphens, runs of white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "-", ""), r"\s+", " "))


def symbol_key(c: Column, greek: bool = False) -> Column:
    """A predicted symbol: label and outer punctuation dropped, upper case; Greek letters spelled out on demand."""
    bare = strip(F.replace(strip(F.replace(strip(c), F.lit("Gene Symbol:"), F.lit(""))), F.lit("Symbol:"), F.lit("")))
    bare = F.btrim(bare, F.lit(SYMBOL_EDGE))
    for letter, name in GREEK_UPPER.items() if greek else ():
        bare = F.replace(bare, F.lit(letter), F.lit(name))
    return F.upper(bare)


def species_key(c: Column) -> Column:
    """A predicted species: lower case, label and outer punctuation dropped."""
    return F.btrim(strip(F.replace(F.lower(strip(c)), F.lit("species:"), F.lit(""))), F.lit(SYMBOL_EDGE))


def bare_identifier(c: Column) -> Column:
    """First identifier of a list, without its database prefix and mark."""
    first = F.split(F.split(c, r"\|")[0], ",")[0]
    return F.trim(F.replace(F.regexp_replace(first, "^(NCBI ?Gene:|GeneID:)", ""), F.lit("*"), F.lit("")))


def lenient_int(c: Column) -> Column:
    """The number in front of the point, 0 where there's none."""
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))


def _mapping(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def species_name(tax_id: Column, unknown: str = "taxid:") -> Column:
    return F.coalesce(F.try_element_at(_mapping(SPECIES_NAMES), tax_id), F.concat(F.lit(unknown), tax_id))


def listed_species(tax_id: Column) -> Column:
    """Whether it is one of the species that the dense entities are restricted to."""
    return tax_id.isin(*SPECIES_NAMES)


def species_priority(tax_id: Column) -> Column:
    return F.coalesce(F.try_element_at(_mapping(SPECIES_PRIORITY), tax_id), F.lit(99))


def gene_like(c: Column) -> Column:
    """2 to 60 characters, at most 15 digits and 8 words, and a letter."""
    return (
        F.length(c).between(2, 60)
        & (F.regexp_count(c, F.lit("[0-9]")) <= 15)
        & (F.size(F.split(F.trim(c), r"\s+")) <= 8)
        & c.rlike("[a-zA-Z]")
    )


def stopped(c: Column) -> Column:
    """Whether the mention's key is on the stop list."""
    return spaced_key(c).isin(*sorted({" ".join(t.replace("-", "").split()) for t in STOP_TERMS}))


def without_suffix(mention: Column) -> Column:
    """Trailing words such as 'protein' dropped, however many."""
    return F.regexp_replace(mention, f"(?i)( ({'|'.join(SUFFIXES)}))+$", "")


def span_without_suffix(mention: Column, start: Column) -> Column:
    """(mention, end): trailing words dropped, and where the rest ends."""
    bare = without_suffix(mention)
    return F.struct(bare.alias("mention"), (start + F.length(bare)).alias("end"))


def either_contains(a: Column, b: Column) -> Column:
    return F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))


def flat(c: Column) -> Column:
    """Tabs and line breaks become spaces."""
    return F.translate(c, "\t\n\r", "   ")


def window_context(text: Column, start: Column, end: Column, width: int) -> Column:
    """``width`` characters on both sides of a span, clipped to the text, on one line."""
    low = F.greatest(start - width, F.lit(0))
    high = F.least(end + width, F.length(text))
    return F.replace(F.substring(text, low + 1, F.greatest(high - low, F.lit(0))), F.lit("\n"), F.lit(" "))


def marked_context(text: Column, start: Column, end: Column, width: int) -> Column:
    """The window with the span in [MENTION] marks."""
    low = F.greatest(start - width, F.lit(0))
    high = F.least(end + width, F.length(text))
    part = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    return F.concat(part(low, start), F.lit("[MENTION]"), part(start, end), F.lit("[/MENTION]"), part(end, high))


_PIECE = re.compile(r"[^.!?]+(?:[.!?]+|$)")
_WHITE = "\t\n\v\f\r\x85" + "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c).startswith("Z"))


def _sentences_of(text: str) -> list[dict]:
    out = []
    for m in _PIECE.finditer(text):
        body = m.group().strip(_WHITE)
        if body:
            start = m.start() + len(m.group()) - len(m.group().lstrip(_WHITE))
            out.append({"start": start, "end": start + len(body), "text": body})
    return out


def simple_sentences(text: Column) -> Column:
    """Spans (start, end, text) between end marks, trimmed: the old plain rule, without abbreviations.

    Offsets are running sums over the pieces; array functions would copy the list for each, so an Arrow batch does it in
    one pass over the text.
    """
    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _sentences_of(t) for t in texts])

    return run(text)


def span_sentence(sentences: Column, start: Column, end: Column) -> Column:
    """Position (from 0) of the first sentence that overlaps the span, else null."""
    hits = F.filter(
        F.transform(sentences, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"))),
        lambda s: F.greatest(s["a"], start) < F.least(s["b"], end),
    )
    return F.get(hits, F.lit(0))["i"]


def sentence_context(text: Column, sentences: Column, at: Column, start: Column, end: Column, around: int, fallback: int) -> Column:
    """The sentence at position ``at`` with ``around`` neighbours on both sides; a window of the text where ``at`` is null.

    ``sentences`` and ``at`` are columns made by a projection of their own: both are used several times.
    """
    low = F.greatest(at - around, F.lit(0))
    part = F.array_join(F.transform(F.slice(sentences, low + 1, at - low + 1 + around), lambda s: s["text"]), " ")
    return F.coalesce(part, strip(window_context(text, start, end, fallback)))


def species_of_context(text: Column) -> Column:
    """A species named in the text: mouse before rat before human; substrings count."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.greatest(F.lit(False), *(low.contains(w) for w in words)), tax) for tax, words in SPECIES_WORDS.items()))
