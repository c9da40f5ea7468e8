"""One consistent form for texts that look the same and are written with other characters.

Each character is brought to one width, ligatures and styled letters to their letters, all spaces and hyphens to one, and
what shows nothing is dropped; all this follows from the characters' own compatibility decompositions. Then each word is
read as a token: every letter has the set of scripts in which it, or a letter drawn like it, exists; the sets are
intersected. One script left: the token is spelled in it (this mends mixed-script look-alikes). Several left: the whole
token could be of either script, and it takes the script that holds most unmistakable letters of the text, else Latin.
None left: the token is truly mixed (a Latin symbol with a Greek suffix), and its ambiguous letters are spelled in Latin
where that exists. What remains is composed again (NFC).

Case, digits (also raised ones), accents, and letters that are not drawn alike are kept.

Classes: documents are grouped by a 128-bit hash of the form; only groups with two or more different texts go on. Pairs
are joined over pairs of different texts, so that equal texts never meet and the work follows the result; every join is
salted, with the rarer text of a pair on the side that is repeated, so that a text or form that many documents have is
spread over tasks.

Defined results: null and blank texts take no part; their form is null and themselves. Equal texts are no pair.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.session import cut

SALTS = 8
#: Tokens whose spelling a task remembers.
KNOWN = 200_000
SCRIPTS = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "ARMENIAN": "A", "COPTIC": "P", "CHEROKEE": "K", "LISU": "S"}
#: A Latin letter and the one drawn like it, by script.
_LIKE_LATIN = {
    "C": "aа cс dԁ eе hһ iі jј lӏ oо pр qԛ sѕ vѵ wԝ xх yу æӕ əә AА BВ CС EЕ GԌ HН IІ JЈ KК MМ OО PР SЅ TТ VѴ WԜ XХ YҮ ÆӔ ƏӘ",
    "G": "oο pρ vν AΑ BΒ EΕ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ",
    "A": "gց hհ jյ nո oօ qզ uս LԼ OՕ SՏ UՍ",
    "P": "cⲥ oⲟ pⲣ CⲤ HⲎ IⲒ KⲔ MⲘ NⲚ OⲞ PⲢ TⲦ XⲬ YⲨ ZⲌ",
    "K": "bᏏ dᏧ hᏂ iᎥ AᎪ BᏴ CᏟ DᎠ EᎬ GᏀ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ RᎡ SᏚ TᎢ VᏙ WᎳ YᎩ ZᏃ",
    "S": "AꓮBꓐCꓚDꓓEꓰFꓝGꓖHꓧIꓲJꓙKꓗLꓡMꓟNꓠOꓳPꓑRꓣSꓢTꓔUꓴVꓦWꓪXꓫYꓬZꓜ",
}
#: Cyrillic and Greek letters drawn alike that Latin has none for.
_CYRILLIC_GREEK = "ГΓ ПΠ ФΦ"
#: Rare letters and signs drawn like a Latin letter; nothing is spelled with them.
_LIKE_RARE = "cϲ gɡ jϳ CϹ FϜ JͿ IӀ"
#: Signs with a decomposition that are drawn in another way, and letters with one that is two marks.
_KEPT = "№℀℁℅℆ſϐϑϒϓϔϕϖϰϱϴϵำຳ"

_SPELLINGS: dict[str, dict[str, str]] = {}
for _script_, _pairs in _LIKE_LATIN.items():
    _letters = _pairs.replace(" ", "")
    for _latin, _other in zip(_letters[::2], _letters[1::2], strict=True):
        _row = _SPELLINGS.setdefault(_latin, {"L": _latin})
        _row[_script_] = _other
        _SPELLINGS[_other] = _row
for _pair in _CYRILLIC_GREEK.split():
    _SPELLINGS |= dict.fromkeys(_pair, dict(zip("CG", _pair, strict=True)))
for _latin, _other in _LIKE_RARE.split():
    _SPELLINGS[_other] = _SPELLINGS.setdefault(_latin, {"L": _latin})
_FOREIGN = regex.compile("[" + "".join(rf"\p{{{s}}}" for s in SCRIPTS if s != "LATIN") + "ɡ]")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_JOINER = regex.compile(r"(?<!\p{Extended_Pictographic}\uFE0F?)\u200D|\u200D(?!\p{Extended_Pictographic})", regex.V1)
_HIDDEN = regex.compile(r"[\p{Cf}--[\u200D\u0600-\u0605\u06DD\u070F\u08E2\U000E0020-\U000E007F]]|[\uFE00-\uFE0F\u034F\u115F\u1160\u17B4\u17B5\u180B-\u180E\u3164\uFFA0]|[\p{Cc}--[\t\n]]", regex.V1)
_HYPHENS = "‐‑‒−﹣－"
_ASCII_HIDDEN = regex.compile(r"[\x00-\x08\x0B-\x1F\x7F]")
_SAME = ("<font>", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")


class _Plain(dict):
    """What each character is written as, found out when it is first met."""

    def __missing__(self, code: int) -> str | int:
        c = chr(code)
        if _HIDDEN.fullmatch(c):
            to: str | int = ""
        elif c in _HYPHENS:
            to = "-"
        elif unicodedata.category(c) == "Zs":
            to = " "
        elif c not in _KEPT and unicodedata.decomposition(c).startswith(_SAME) and not (made := unicodedata.normalize("NFKC", c)).startswith(" "):
            to = made
        else:
            to = code
        self[code] = to
        return to


class _Script(dict):
    """Script of each letter that is unmistakable, '' for what tells nothing."""

    def __missing__(self, c: str) -> str:
        self[c] = to = "" if c in _SPELLINGS or not c.isalpha() else SCRIPTS.get(unicodedata.name(c, "-").split()[0], "-")
        return to


class _Spelled(dict):
    """Spelling of each token in a text whose unmistakable letters are mostly of the script ``main``."""

    def __init__(self, main: str):
        self.main = main

    def __missing__(self, token: str) -> str:
        if len(self) > KNOWN:
            self.clear()
        scripts = {*SCRIPTS.values(), "-"}
        for c in token:
            if c.isalpha():
                scripts &= set(_SPELLINGS[c]) if c in _SPELLINGS else {_SCRIPT[c]}
        if len(scripts) == 1:
            to = scripts.pop()
        elif scripts:
            to = self.main if self.main in scripts else "L" if "L" in scripts else min(scripts)
        else:
            to = "L"
        self[token] = made = "".join(_SPELLINGS[c].get(to, next(iter(_SPELLINGS[c].values()))) if c in _SPELLINGS else c for c in token)
        return made


_PLAIN, _SCRIPT = _Plain(), _Script()
_SPELLED = {s: _Spelled(s) for s in SCRIPTS.values()}


def _plain(text: str) -> str:
    if "\u200d" in text:
        text = _JOINER.sub("", text)
    return text.translate(_PLAIN).replace("ํา", "ำ").replace("ໍາ", "ຳ")


def main_script(text: str) -> str:
    """The script of most unmistakable letters."""
    if text.isascii() or not _FOREIGN.search(text):
        return "L"
    sure = Counter(map(_SCRIPT.__getitem__, text))
    return max(_SPELLED, key=lambda s: sure[s])


def _in_one_script(text: str, main: str) -> str:
    spelled = _SPELLED[main]
    return _TOKEN.sub(lambda m: spelled[m.group()], unicodedata.normalize("NFD", text))


def word_form(word: str, main: str) -> str:
    """The consistent form of one word of a text of this main script."""
    if word.isascii():
        return word
    word = _plain(word)
    return unicodedata.normalize("NFC", _in_one_script(word, main) if _FOREIGN.search(word) else word)


def visual_form(text: str) -> str:
    """The consistent form; equal for texts that look the same."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return _ASCII_HIDDEN.sub("", text)
    text = _plain(text)
    if _FOREIGN.search(text):
        text = _in_one_script(text, main_script(unicodedata.normalize("NFD", text)))
    return unicodedata.normalize("NFC", text)


def _shapes() -> dict[str, str]:
    """One letter for all that are alike in some script or case. Greek nu is left out: it would tie v to n."""
    to: dict[str, str] = {}
    for letter, row in _SPELLINGS.items():
        if letter != "ν":
            to[letter.casefold()] = next(iter(row.values())).casefold()
    return to


_SHAPE = _shapes()


def casefold_shape(c: str) -> str:
    """A character without case, accents apart from their letter, and one letter for all drawn alike."""
    folded = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c).casefold())
    return "".join(_SHAPE.get(x, x) for x in folded)


def _formed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "form": [visual_form(t) for t in pdf["text"]], "mark": pdf["mark"]})


def visual_forms(documents: DataFrame) -> DataFrame:
    """(doc_id, form, mark) of the documents whose text shows something; mark tells different texts apart."""
    shown = documents.select("doc_id", "text", F.md5("text").alias("mark")).where(F.col("text").rlike(r"\S"))
    return shown.mapInPandas(_formed, "doc_id bigint, form string, mark string").where(F.trim("form") != "")


def _each_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _mixed(documents: DataFrame) -> DataFrame:
    """(doc_id, key, mark, salt) of the documents whose form comes with several texts. The forms are made once and written
    as narrow rows; what the joins read again is only the mixed ones."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    docs = cut(visual_forms(documents).select("doc_id", F.unhex(F.md5("form")).alias("key"), F.unhex("mark").alias("mark"), salt.alias("salt")))
    keys = docs.groupBy("key").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where("least <> most").select("key")
    return cut(docs.join(_each_salt(keys), ["key", "salt"]).select("doc_id", "key", "mark", "salt"))


def look_alike_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, variant_id): for each document that looks like another with different characters the least
    doc_id that looks so, and the least one with exactly its text. One row per document, however large the class."""
    docs = _mixed(documents)
    least = docs.groupBy("key", "mark").agg(F.min("doc_id").alias("variant_id"))
    classes = least.groupBy("key").agg(F.min("variant_id").alias("class_id"))
    known = _each_salt(least.join(classes, "key"))
    return docs.join(known, ["key", "mark", "salt"]).select("doc_id", "class_id", "variant_id")


def look_alike_pairs(documents: DataFrame) -> DataFrame:
    """(doc_lo, doc_hi): every pair of documents that look the same with different characters."""
    docs = _mixed(documents)
    kinds = docs.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("n"))
    a, b = (kinds.select("key", F.col("mark").alias(f"mark_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    # Each pair of texts once, the one with more documents first.
    pairs = a.join(b, "key").where("n_a > n_b OR (n_a = n_b AND mark_a < mark_b)").select("key", "mark_a", "mark_b")
    left = docs.select("key", "salt", F.col("mark").alias("mark_a"), F.col("doc_id").alias("a"))
    right = _each_salt(docs.select("key", F.col("mark").alias("mark_b"), F.col("doc_id").alias("b")))
    met = _each_salt(pairs).join(left, ["key", "mark_a", "salt"]).join(right, ["key", "mark_b", "salt"])
    return met.select(F.least("a", "b").alias("doc_lo"), F.greatest("a", "b").alias("doc_hi"))
