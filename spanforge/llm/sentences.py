"""Sentence units of texts in many languages and scripts.

A pushdown automaton reads a text once. One stack holds the open quotations and brackets; an opening that is never closed
is dropped before the run, so it can't swallow the rest. End marks count only where this stack is empty, or where they
directly precede the mark that empties it. Another stack holds the levels of lists: a label (number, letter, Roman or
dotted number) where one can stand opens a level if it is the first of its style, or goes on with a level on the stack,
closing those above it; its full stop ends nothing. Whether any other full stop ends the sentence is decided by a trie of
abbreviations, read backwards from the stop, by what follows, and by dates.

Scripts: full-width and CJK marks, danda, and Arabic marks end a sentence by themselves; in Thai a space parts
sentences.

Defined results: offsets count code points, the end is exclusive, outer white space is left out. A null, empty or blank
text has no sentence. Line breaks alone end nothing. Texts are read whole, in time linear in their length. A document id
with several rows gives its least non-empty abstract; null document ids are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values. Abbreviations behind which a sentence never ends; behind which it goes on before a number or a small
#: letter; behind which it ends if a sentence seems to start.
_NEVER = [
    "e.g", "i.e", "i.v", "i.p", "s.c", "cf", "viz", "Suppl", "vgl", "Vgl", "sp", "nov", "spp", "subsp", "z.B", "z. B",
    "d.h", "d. h", "d", "u.a", "u. a", "u", "z", "p.ej", "p. ej", "p.ex", "p. ex", "т.е", "т. е", "т", "т.к", "т. к", "см", "डॉ", "प्रो", "د",
]
_NUMBERED = [
    "fig", "Fig", "figs", "Figs", "No", "no", "Nos", "Nr", "nr", "núm", "Núm", "n°", "vs", "v", "V", "p", "pp", "P", "S", "approx", "Approx", "Aprox", "aprox", "Env",
    "env", "ca", "Ca", "ref", "Ref", "refs", "Refs", "réf", "Réf", "tab", "Tab", "tabl", "Tabl", "Abb", "abb", "Eq", "eq", "Vol", "vol", "ch", "Ch", "рис", "Рис", "табл",
    "стр", "с", "bzw", "resp", "circa", "suppl", "Chap", "chap", "Sec", "sec", "Sect", "sect", "Art", "art", "Para", "para", "App", "app", "Ed", "ed", "Eds", "eds",
    "Kap", "Bd", "Abs", "Jh", "Std", "cap", "Cap", "pág", "págs", "vol", "гл", "Гл", "п", "пп", "тыс", "млн", "млрд",
]
_TITLE = [
    "Dr", "Drs", "Prof", "Assoc", "Asst", "Mr", "Mrs", "Ms", "Messrs", "Mme", "Mlle", "St", "Sr", "Sra", "Srta", "Gen", "Col", "Maj", "Capt", "Lt", "Sgt", "Cpl", "Adm",
    "Cmdr", "Rev", "Hon", "Gov", "Sen", "Rep", "Insp", "Supt", "Pres",
]
_MAY = [
    "U.S", "U.K", "E.U", "U.S.A", "U.N", "a.m", "p.m", "h", "al", "т.д", "т. д", "т.п", "т. п", "др", "ед", "г", "мг", "мл", "Inc", "Ltd", "Co", "Corp", "Jr", "Ph.D",
    "Ph. D", "M.D", "B.A", "M.A", "B.Sc", "M.Sc", "D.C", "Bros", "dept", "Dept", "Univ",
]
#: Words of English that begin a sentence rather than a name: articles, pronouns, prepositions, conjunctions, auxiliaries.
_BEGIN = {
    "A", "An", "The", "This", "That", "These", "Those", "It", "Its", "We", "Our", "He", "She", "They", "Their", "I", "You", "One", "Each", "Every", "Both", "All", "Any",
    "Some", "Many", "Most", "Few", "Several", "Such", "No", "None", "Neither", "Either", "In", "On", "At", "By", "Of", "To", "From", "For", "With", "Without", "Within",
    "Into", "Under", "Over", "After", "Before", "During", "Since", "Until", "Between", "Among", "Through", "Upon", "Using", "As", "If", "When", "Where", "While", "Whereas",
    "Although", "Though", "Because", "But", "And", "Or", "So", "Yet", "However", "Thus", "Hence", "Therefore", "Moreover", "Here", "There", "Then", "Now", "What", "Which",
    "Who", "Whose", "Why", "How", "Is", "Are", "Was", "Were", "Does", "Do", "Did", "Has", "Have", "Had", "Can", "Could", "May", "Might", "Will", "Would", "Should", "Must",
}
#: Words that go on with the name of an institution behind the abbreviation of its country.
_NAMED = {
    "National", "Government", "Department", "Food", "Army", "Navy", "Air", "Marine", "Coast", "Congress", "Senate", "House", "President", "Supreme", "Court", "Constitution",
    "Patent", "Public", "Federal", "Centers", "Census", "Bureau", "Environmental", "Preventive", "Secretary", "State", "States", "Treasury", "Geological", "Forest", "Office",
    "Agency", "Agricultural", "Veterans", "Surgeon", "Pharmacopeia", "Ministry", "Medical", "Commission", "Council", "Parliament", "Security", "General", "Biobank",
}
_DAYS = {"Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"}
_MONTHS = {
    "Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember", "January", "February", "March", "May", "June",
    "July", "October", "December",
}
#: Words that carry a sentence on behind a closing quotation.
_ON = {"but", "and", "or", "yet", "is", "was", "as", "in", "of", "to", "he", "it", "we", "at", "by", "so", "on", "if", "an", "no", "de", "et", "la", "le", "en", "el", "un", "du"}

OPENERS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "„": "“", "“": "”", "‘": "’", "‹": "›", '"': '"'}
_QUOTES = set('«„“「『‹"')
_BRACKETS = set("([{（［【")
CLOSERS = set(OPENERS.values())
WIDE = set("。！？｡．")
ENDS = set(".!?…।॥؟۔") | WIDE
_MARK = regex.compile(r"[.!?…।॥؟۔。！？｡．()\[\]{}（）［］【】《》〈〉「」『』«»„“”\"‹›]|\s+")
_SPACE = regex.compile(r"\s*")
_WORD = regex.compile(r"[^\s]*")
_THAI = regex.compile(r"\p{Thai}")
_CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Devanagari}\p{Arabic}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_COUNTED = regex.compile(r"\d+[\p{Han}\p{Hiragana}\p{Katakana}]")
_CLAUSE = regex.compile(r"[^.!?。！？।؟]*")
_INITIALS = regex.compile(r"(?:\p{L}{1,2}\.)+\p{L}{1,2}")
_DOTTED = regex.compile(r"\d{1,3}(?:\.\d{1,3})+")
_ROMAN = regex.compile(r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})|(?=[IVXLC])(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})")
_DIGITS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_GENE = regex.compile(r"\p{Ll}[\p{L}]*[-_/]?\d")


class Trie:
    """Words by their letters from the last to the first; the longest one that starts at a word's edge counts."""

    def __init__(self, classes: dict[str, list[str]]):
        self.root: dict = {}
        for kind, words in classes.items():
            for w in words:
                node = self.root
                for c in reversed(w):
                    node = node.setdefault(c, {})
                node[""] = kind

    def before(self, text: str, stop: int) -> tuple[str, str]:
        """Class and word of the longest abbreviation that ends right before ``stop``."""
        node, i, found = self.root, stop - 1, ("", "")
        while i >= 0:
            c = " " if text[i].isspace() else text[i]
            if c not in node:
                break
            node = node[c]
            if "" in node and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in "._-/")):
                found = (node[""], text[i:stop])
            i -= 1
        return found


_ABBREVIATIONS = Trie({"never": _NEVER, "title": _TITLE, "numbered": _NUMBERED, "may": _MAY})


def _pairs(text: str, marks: list[tuple[int, str]]) -> dict[int, int]:
    """Position of each opening that is closed, and of its closing mark."""
    stack: list[tuple[str, int]] = []
    open_: Counter = Counter()
    pairs: dict[int, int] = {}
    for at, c in marks:
        if open_[c] and not (c == "“" and stack[-1][0] != "“"):
            while True:  # what was left open inside is no nesting
                wanted, begin = stack.pop()
                open_[wanted] -= 1
                if wanted == c:
                    break
            pairs[begin] = at
        elif c in OPENERS:
            stack.append((OPENERS[c], at))
            open_[OPENERS[c]] += 1
    return pairs


def _roman(numeral: str) -> int:
    values = [_DIGITS[c] for c in numeral.lower()]
    return sum(-v if v < after else v for v, after in zip(values, [*values[1:], 0], strict=True))


def _labels(token: str) -> list[tuple[str, int]]:
    """Styles and values that a token can have as a list label."""
    made = []
    if token.isascii() and token.isdigit() and len(token) <= 3:
        made.append(("1", int(token)))
    if len(token) == 1 and token.isascii() and token.isalpha():
        made.append(("a" if token.islower() else "A", ord(token.lower()) - 96))
    if _ROMAN.fullmatch(token):
        made.append(("i" if token.islower() else "I", _roman(token)))
    return made


class Levels:
    """The open levels of lists: style and last value of each, the innermost last."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []

    def takes(self, token: str, mark: str) -> bool:
        """Whether the token, with this mark behind it, is the next label of an open level or the first of a new one."""
        if _DOTTED.fullmatch(token):
            return True
        for style, value in _labels(token):
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth] == (style + mark, value - 1):
                    self.stack[depth:] = [(style + mark, value)]
                    return True
        for style, value in _labels(token):
            if value == 1:
                self.stack.append((style + mark, value))
                return True
        return False


def _label_place(text: str, start: int, k: int) -> bool:
    """Whether a list label can stand at k: first in its sentence, behind a colon or semicolon, or first on its line."""
    gap = k
    while gap > start and text[gap - 1].isspace():
        gap -= 1
    return gap <= start or text[gap - 1] in ":;：；" or "\n" in text[gap:k]


def _starts(text: str, at: int) -> bool:
    """Whether the text at ``at`` looks like the start of a sentence: capital, opening mark, caseless script, or a name
    with a digit in it."""
    c = text[at : at + 1]
    if not c:
        return True
    return bool(_COUNTED.match(text, at)) or c.isupper() or c.istitle() or c in "¿¡«„“\"([（「『" or bool(_CASELESS.match(c)) or bool(_GENE.match(text, at))


def _stop_ends(text: str, i: int, j: int, start: int, levels: Levels) -> bool:
    """Whether the full stop at i, whose run of marks ends at j, ends the sentence that began at ``start``."""
    n = len(text)
    following = text[j : j + 1]
    nxt = _SPACE.match(text, j).end()
    if nxt == n:
        return True
    k = i
    while k > start and not text[k - 1].isspace():
        k -= 1
    word = text[k:i]
    if nxt == j:  # nothing between the stop and what follows
        if following in "¿¡":
            return True
        if _CJK.match(following):
            return bool(word) and not word[-1].isdigit()
        if not following.isupper():
            return False
        after = regex.match(r"\p{L}+", text[j:]).group()
        plain = word.isalpha() and word.islower() and len(word) > 2
        titled = len(after) > 1 and after[1:].islower() and text[j + len(after) : j + len(after) + 1] in " ,:\n"
        return plain or (titled and len(word) > 1 and (word[-1] in ")]" or word[-1].isdigit() or len(word) > 3 and word.isalpha()))
    if j - i > 1:  # an ellipsis
        return _starts(text, nxt) and not text[nxt].isdigit()
    if text[start:i].strip().isdigit():
        levels.takes(word, ".")
        return False  # the number of a list item
    if _label_place(text, start, k) and levels.takes(word, "."):
        return False
    following = text[nxt]
    if word.isdigit() and _WORD.match(text, nxt).group().strip(",.;:") in _MONTHS:
        return False
    kind, abbreviation = _ABBREVIATIONS.before(text, i)
    if not kind and _INITIALS.fullmatch(word):
        kind, abbreviation = "may", word
    if kind == "never":
        return False
    if kind == "numbered" and (following.isdigit() or following.islower() and not _GENE.match(text, nxt)):
        return False
    if kind == "title":
        # Behind "of" it is rather a symbol than a title.
        word = _WORD.match(text, nxt).group()
        return word.strip(",.;:") in _BEGIN or word[-1] in ",:" or text[start:k].rstrip().endswith(" of")
    if kind == "may":
        word = _WORD.match(text, nxt).group()
        symbol = len(word) == 2 and word.isascii() and word.isalpha() and word not in _ON  # a gene symbol in small letters
        if not _starts(text, nxt) and not (symbol and abbreviation != "h"):
            return False
        goes_on = _NAMED if abbreviation in ("U.S", "U.K", "E.U", "U.N", "U.S.A") else _DAYS | _MONTHS if abbreviation in ("a.m", "p.m") else ()
        return word.strip(",.;:") not in goes_on
    bare = word.lstrip("([{\"'«„“")
    if len(bare) == 1 and bare.isupper():
        return not (following.islower() and not _GENE.match(text, nxt))
    return following not in ",;:"


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence of ``text``."""
    n = len(text)
    found: list[tuple[int, int]] = []
    marks = [(m.start(), m.group()) for m in _MARK.finditer(text)]
    pairs = _pairs(text, [x for x in marks if x[1] in OPENERS or x[1] in CLOSERS])
    closes = {v: k for k, v in pairs.items()}
    start, done = _SPACE.match(text).end(), 0
    stack: list[int] = []
    levels = Levels()
    thai = bool(_THAI.search(text))

    def emit(end: int) -> None:
        nonlocal start, done
        piece = text[start:end]
        if piece.strip():
            found.append((start, start + len(piece.rstrip())))
        start, done = _SPACE.match(text, end).end(), end

    for at, c in marks:
        if at < done:
            continue
        if at in pairs:
            stack.append(at)
            continue
        if c == ")":  # "a)" or "(i)" may be a label
            k = at
            while k > start and at - k < 5 and text[k - 1].isalnum():
                k -= 1
            if k < at and _label_place(text, start, k - (text[k - 1] == "(")):
                levels.takes(text[k:at], ")")
        if at in closes:
            while stack and stack[-1] >= closes[at]:
                stack.pop()
            continue
        if c.isspace():
            if thai and not stack and at > start and _THAI.search(text, start, at):
                emit(at)
            continue
        if c not in ENDS:
            continue
        j = at + 1
        while j < n and text[j] in ENDS:
            j += 1
        # The marks that close what is open, right behind the end marks.
        end, inner = j, list(stack)
        while inner:
            k = end
            while k < n and text[k].isspace() and text[k] != "\n":
                k += 1
            if k < n and closes.get(k) == inner[-1]:
                inner.pop()
                end = k + 1
            else:
                break
        if inner:
            continue
        if stack:
            outer = stack[0]
            whole = outer == start
            nxt = _SPACE.match(text, end).end()
            if text[outer] not in _QUOTES and not whole:
                continue
            if nxt < n:
                if text[outer] in _BRACKETS:
                    ends = text[nxt] not in ",;:.—–" and (nxt > end or bool(_CJK.match(text[nxt])))
                else:
                    word = _WORD.match(text, nxt).group()
                    upper = text[nxt].isupper() or text[nxt] in "¿¡«„“\"([" or bool(_GENE.match(text, nxt))
                    short = text[nxt].islower() and len(word) <= 2 and word.isalpha() and word not in _ON and text[outer] == '"'
                    # Another script behind the quotation is another sentence.
                    other = _CASELESS.search(_CLAUSE.match(text, nxt).group()) and not _CASELESS.search(text, start, end)
                    ends = nxt > end and (upper or short or bool(other))
                if not ends:
                    continue
            stack.clear()
            emit(end)
            continue
        if c == "." or (c == "…"):
            if not _stop_ends(text, at, j, start, levels):
                done = j
                continue
        elif c == "．" and text[j : j + 1].isdigit() and text[at - 1 : at].isdigit():
            continue
        elif c in "!?" and text[j : j + 1] in (",", ";") or (c in "!?" and text[j : j + 1].isalnum() and text[at - 1 : at].isalnum() and text[j].islower()):
            continue
        emit(j)
    emit(n)
    return found


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, nos, starts, ends = [], [], [], []
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            for no, (a, b) in enumerate(sentences(text)):
                ids.append(doc)
                nos.append(no)
                starts.append(a)
                ends.append(b)
        yield pd.DataFrame({"doc_id": ids, "sent_no": nos, "start_off": starts, "end_off": ends})


def sentence_units(rows: DataFrame, id_col: str = "doc_id", text_col: str = "ctx_abstract") -> DataFrame:
    """(doc_id, sent_no, start_off, end_off): one text per document goes through the automaton."""
    texts = rows.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    return one.mapInPandas(_split, "doc_id string, sent_no bigint, start_off bigint, end_off bigint")
