"""Held-out passages that stand, wholly or partly, in the documents of a corpus.

A prefix-filtered set join, with both sides as tables.

(1) One scan brings every document to words: markup is dropped, words are what white space parts, and each is folded once
(look-alikes, case, punctuation) and kept as a 64-bit code. Texts of scripts that don't space words (Chinese, Japanese)
are read as letters and digits. The scan makes the shingles (four words, or twelve letters) and keeps, for the documents
that hold enough of the items' shingles to qualify, one narrow row: its units and these shingles. A bitmap of the items'
shingles, at most ``MOST_BITS`` bits whatever their number, is all that is broadcast; it only spares rows, as the join
is by the shingles themselves. (2) Shingles are counted by document and ordered by rarity. (3) A stretch of L words with
k changes keeps all but 4k of its shingles, so at least one of its 4k + 1 rarest: only these prefix shingles of an item
are joined with the documents' (for letters, where nothing may change, the rarest of each window). (4) Pairs that
meet and share as many shingles as the item's length asks are verified on the coded words: so many of them in one diagonal
band (positional bound), and then a chain of matching words with the fewest edits. No item, shingle or document is collected.

A document holds an item when it has the whole passage, or at least ``WORDS`` consecutive words of it, with at most one
word in eight changed, added or missing; or ``LETTERS`` consecutive letters or digits unchanged. A changed number is a
change like any other. A stretch with changes in which the item's symbols (words with a capital behind their first letter, or
with letters and digits) are replaced throughout, also up to five words beside it, and none is kept, is a sentence of the
same build about something else and doesn't count.

Defined results: null or empty texts and passages hold nothing. Items with the same passage all count. Repeated
documents give a row each per doc_id. An item shorter than the least stretch must be there as a whole.
"""

from __future__ import annotations

import html
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.look_alikes import casefold_shape, main_script, word_form
from spanforge.session import cut

WORDS, LETTERS, EIGHTH = 15, 40, 8
EDITS = 4
SHINGLE, LETTER_SHINGLE = 4, 12
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Units of a scan that are worked on together, and folded words that a task remembers.
UNITS, KNOWN = 1_000_000, 500_000
_TAG = regex.compile(r"""</?\p{L}[\w:-]*+(?:\s++[\w:-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?+)*+\s*+/?>|<![^<>]*+>|<\|[^<>|]*+\|>""")
_BROKEN = regex.compile(r"(?<=\p{Ll})[-‐]\s*\n\s*(?=\p{Ll})")
_OUT = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_SYMBOL = regex.compile(r"\w\p{Lu}|\p{L}[^\s\p{L}]*\d|\d[^\s\p{L}]*\p{L}")


def without_markup(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text and ("-" in text or "‐" in text):
        text = _BROKEN.sub("", text)
    return _TAG.sub(" ", text) if "<" in text else text


class _Codes(dict):
    """Code of each word as it is written: its folded form's hash, the lowest bit telling a symbol; 0 for what holds no
    letter or digit."""

    def __init__(self, main: str):
        self.main = main

    def __missing__(self, word: str) -> int:
        form = _OUT.sub("", word_form(word, self.main).casefold())
        code = (xxhash.xxh3_64_intdigest(form.encode()) | 1) ^ (not _SYMBOL.search(word)) if form else 0
        self[word] = code
        return code


class _Letters(dict):
    """Letters and digits of each character, folded."""

    def __missing__(self, c: int) -> str:
        self[c] = form = _OUT.sub("", casefold_shape(chr(c)))
        return form


_CODES: dict[str, _Codes] = {}
_LETTERS = _Letters()


def words_of(text: str) -> np.ndarray:
    """Codes of a text's words."""
    main = main_script(text)
    known = _CODES.get(main)
    if known is None or len(known) > KNOWN:
        known = _CODES[main] = _Codes(main)
    words = text.split()
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return codes[codes != 0]


def letters_of(text: str) -> str:
    return text.translate(_LETTERS)


def is_unspaced(text: str) -> bool:
    return not text.isascii() and len(_UNSPACED.findall(text)) * 4 > sum(c.isalpha() for c in text)


def _points(run: str) -> np.ndarray:
    return np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def shingles(units: np.ndarray, size: int) -> np.ndarray:
    """A code of each ``size`` consecutive units."""
    if len(units) < size:
        return np.zeros(0, np.uint64)
    out = np.full(len(units) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + units[i : len(units) - size + 1 + i]
        out ^= out >> np.uint64(31)
    return out


def _bare(codes: np.ndarray) -> np.ndarray:
    return codes >> np.uint64(1)


def item_units(passage: str) -> tuple[str, int, np.ndarray]:
    """Kind ('w' words, 'l' letters), size of the shingles and units of an item. Short items are one shingle."""
    text = without_markup(passage)
    if is_unspaced(text):
        units = _points(letters_of(text))
        return "l", min(LETTER_SHINGLE, len(units)), units
    units = words_of(text)
    return "w", min(SHINGLE, len(units)), units


def needed(kind: str, n: int) -> int:
    """Shingles that the item and a document that holds it share at least."""
    if kind == "l":
        return max(1, min(LETTERS, n) - LETTER_SHINGLE + 1)
    return min(SHINGLE + 1, max(1, n - SHINGLE + 1 - SHINGLE * (n // EIGHTH)))


def prefix_places(rank: list, kind: str, units: int) -> set[int]:
    """Places of the item's shingles that any qualifying stretch must share one of; ``rank`` orders them by rarity."""
    n = len(rank)
    chosen: set[int] = set()
    stretches = [(min(LETTERS, units), 1)] if kind == "l" else [
        (length, SHINGLE * (length // EIGHTH) + 1) for length in sorted({min(units, x) for x in (WORDS, 16, 24, 32)} | {units})
    ]
    size = LETTER_SHINGLE if kind == "l" else SHINGLE
    for length, prefix in stretches:
        span = max(1, length - size + 1)
        for a in range(max(1, n - span + 1)):
            window = range(a, min(n, a + span))
            chosen.update(window if len(window) <= prefix else sorted(window, key=rank.__getitem__)[:prefix])
    return chosen


def stretches(item: list[int], doc: list[int], low: int, high: int) -> bool:
    """Whether any stretch of the item between two matches on these diagonals (document minus item position) is long
    enough and has at most one edit in eight words; exact, as each match keeps, for each number of edits, its earliest
    start without symbols (0), with swapped ones only (1) and with a kept one (2).

    Up to ``EDITS`` edits suffice: of a qualifying stretch of 36 words or more one half qualifies too. A gap between two
    matches costs its longer side.
    """
    n = len(item)
    least, most = min(WORDS, n), min(EDITS, n // EIGHTH)
    places: dict[int, list[int]] = defaultdict(list)
    for j in range(max(0, low), min(len(doc), n + high)):
        places[doc[j] >> 1].append(j)
    rows: list[dict[int, tuple[int, list[list[int]]]]] = []
    for i, word in enumerate(item):
        row: dict[int, tuple[int, list[list[int]]]] = {}
        for j in places.get(word >> 1, ()):
            if not low <= j - i <= high:
                continue
            run, starts = 1, [[n] * (most + 1) for _ in range(3)]
            own = 2 if word & 1 else 0
            starts[own if own else 1 if _swap_near(item, doc, i, j, -1) else 0][0] = i
            for p in range(min(most, i - 1) + 1 if i else 0):
                for j2, (length, old) in rows[i - 1 - p].items():
                    q = j - 1 - j2
                    if not 0 <= q <= most:
                        continue
                    cost = max(p, q)
                    if not cost:
                        run = length + 1
                    swap = bool(p and q) and any(a & 1 for a in item[i - p : i])
                    for s in range(3):
                        to = starts[max(s, own, int(swap))]
                        for e in range(most + 1 - cost):
                            to[e + cost] = min(to[e + cost], old[s][e])
            outside = n - 1 - i
            if run >= least or (i + 1 - run + outside) * EIGHTH <= n:
                return True
            after = _swap_near(item, doc, i, j, 1)
            for s in (0, 2):
                if s == 0 and after:
                    continue
                for e, start in enumerate(starts[s]):
                    length = i - start + 1
                    if start < n and ((e + start + outside) * EIGHTH <= n or length >= least and e * EIGHTH <= length):
                        return True
            row[j] = run, starts
        rows.append(row)
    return False


def _swap_near(item: list[int], doc: list[int], i: int, j: int, way: int) -> bool:
    """Whether beside a match something else stands for a symbol of the item: another symbol up to three words on, or any
    word up to five words on where the same build goes on before or behind it, also with a word more or less."""
    def same(d: int, shift: int = 0) -> bool:
        a, b = i + way * d, j + way * (d + shift)
        return 0 <= a < len(item) and 0 <= b < len(doc) and item[a] >> 1 == doc[b] >> 1

    met = False
    for d in range(1, 6):
        a, b = i + way * d, j + way * d
        if not (0 <= a < len(item) and 0 <= b < len(doc)):
            return False
        if same(d):
            met = True
        elif item[a] & 1 and (met or d <= 3 and doc[b] & 1 or any(same(d + e, s) for e in (1, 2) for s in (-1, 0, 1) if e + s > 0)):
            return True
    return False


def _bands(hits: list[tuple[int, int]], slack: int) -> Iterator[list[tuple[int, int]]]:
    """Groups of (document, item) places whose diagonals lie close together."""
    hits.sort(key=lambda h: (h[0] - h[1], h[0]))
    start = 0
    for x in range(1, len(hits) + 1):
        if x == len(hits) or (hits[x][0] - hits[x][1]) - (hits[x - 1][0] - hits[x - 1][1]) > slack:
            yield hits[start:x]
            start = x


def _dense(group: list[tuple[int, int]], need: int) -> bool:
    """Whether ``need`` shingles lie within a stretch of 32 words of the item."""
    places = sorted({i for _, i in group})
    return any(bisect_left(places, places[k] + 32) - k >= need for k in range(len(places)))


class Document:
    """Units of a document with the places of its shingles of each size."""

    def __init__(self, kind: str, units: np.ndarray):
        self.kind, self.units, self.places = kind, units, {}
        self.bare = _bare(units) if kind == "w" else units
        self.words = units.tolist() if kind == "w" else None

    def at(self, size: int) -> dict[int, list[int]]:
        if size not in self.places:
            made: dict[int, list[int]] = defaultdict(list)
            for p, c in enumerate(shingles(self.bare, size).tolist()):
                made[c].append(p)
            self.places[size] = made
        return self.places[size]

    def holds(self, size: int, units: np.ndarray) -> bool:
        """Whether the document has enough of an item of its kind."""
        n, places = len(units), self.at(size)
        bare = _bare(units) if self.kind == "w" else units
        hits = [(p, i) for i, c in enumerate(shingles(bare, size).tolist()) for p in places.get(c, ())]
        if not hits:
            return False
        if size == n:
            return True
        need = needed(self.kind, n)
        if self.kind == "l":
            # Consecutive shingles on one diagonal are a run of equal letters.
            hits.sort(key=lambda h: (h[0] - h[1], h[0]))
            run = 1
            for a, b in zip(hits, hits[1:], strict=False):
                if run >= need:
                    break
                run = run + 1 if b[0] - a[0] == 1 == b[1] - a[1] else 1
            return run >= need
        if len({i for _, i in hits}) < need:
            return False
        item, band = units.tolist(), max(3, n // EIGHTH + 2)
        for group in _bands(hits, 3):
            if len({i for _, i in group}) >= need and _dense(group, need):
                low, high = group[0][0] - group[0][1], group[-1][0] - group[-1][1]
                if stretches(item, self.words, low - band, high + band):
                    return True
        return False


def _signed(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.int64)


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = [item_units(p) for p in pdf["passage"]]
        codes = [_signed(shingles(_bare(u) if k == "w" else u, s)) if s else _signed(u) for k, s, u in made]
        need = [needed(k, len(u)) for k, _, u in made]
        # Of the places that must be shared, so many codes are different ones at least.
        share = [max(1, n - len(c) + len(np.unique(c))) for n, c in zip(need, codes, strict=True)]
        rows = pd.DataFrame({
            "item": pdf["item"], "kind": [k for k, _, _ in made], "size": [s for _, s, _ in made], "units": [_signed(u) for _, _, u in made],
            "need": need, "share": share, "codes": codes,
        })
        if len(rows := rows[rows["size"] > 0]):
            yield rows


def _scanned(sizes: dict[str, list[int]], least: dict[str, int], bitmap):
    """Rows of the documents that hold enough of the items' shingles: units and the shingles, for each kind."""
    def kept(kind: str, rows: list, units: list[np.ndarray]) -> pd.DataFrame:
        lengths = np.array([len(u) for u in units])
        joint = np.concatenate(units)
        owner = np.repeat(np.arange(len(units)), lengths)
        ends = np.cumsum(lengths)[owner]
        bits = bitmap.value
        bare = _bare(joint) if kind == "w" else joint
        owners, codes = [], []
        for size in sizes[kind]:
            made = shingles(bare, size)
            at = np.nonzero(bits[(made & np.uint64(len(bits) * 8 - 1)) >> np.uint64(3)] >> (made & np.uint64(7)).astype(np.uint8) & 1)[0]
            at = at[at + size <= ends[at]]  # none reaches into the next document
            owners.append(owner[at])
            codes.append(made[at])
        owners, codes = np.concatenate(owners), np.concatenate(codes)
        met = np.nonzero(np.bincount(owners, minlength=len(units)) >= least[kind])[0]
        order = np.argsort(owners, kind="stable")
        owners, codes = owners[order], codes[order]
        a, b = np.searchsorted(owners, met), np.searchsorted(owners, met, side="right")
        return pd.DataFrame({
            "doc_id": [rows[m][0] for m in met], "at": [rows[m][1] for m in met], "kind": kind, "units": [_signed(units[m]) for m in met],
            "codes": [_signed(np.unique(codes[x:y])) for x, y in zip(a, b, strict=True)],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: dict[str, tuple[list, list]] = {k: ([], []) for k in sizes}
            size = 0
            for doc, at, raw in zip(pdf["doc_id"], pdf["at"], pdf["text"], strict=True):
                text = without_markup(raw)
                for kind, (rows, units) in held.items():
                    if kind == "w" or not text.isascii() and _UNSPACED.search(text):
                        made = words_of(text) if kind == "w" else _points(letters_of(text))
                        if len(made) >= sizes[kind][0]:
                            rows.append((doc, at))
                            units.append(made)
                            size += len(made)
                if size > UNITS:
                    yield from (out for k, x in held.items() if x[0] and len(out := kept(k, *x)))
                    held, size = {k: ([], []) for k in sizes}, 0
            yield from (out for k, x in held.items() if x[0] and len(out := kept(k, *x)))

    return run


def _prefixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        items, codes = [], []
        for item, kind, n, met in zip(pdf["item"], pdf["kind"], pdf["n"], pdf["met"], strict=True):
            # Ties in rarity go by the code: the same order for every item.
            for i in prefix_places([(m["df"], m["code"], m["pos"]) for m in met], kind, n):
                items.append(item)
                codes.append(met[i]["code"])
        yield pd.DataFrame({"item": items, "code": codes}, dtype="int64").drop_duplicates()


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, document = None, None
    for pdf in batches:
        right = []
        for at, kind, units, size, item in zip(pdf["at"], pdf["kind"], pdf["units"], pdf["size"], pdf["item_units"], strict=True):
            key = (at, kind)
            if key != last:
                last, document = key, Document(kind, np.asarray(units, np.int64).view(np.uint64))
            right.append(document.holds(size, np.asarray(item, np.int64).view(np.uint64)))
        yield pdf.loc[np.array(right, bool), ["doc_id", "item"]]


def _bitmap(codes: DataFrame, shingles_in_items: int) -> np.ndarray:
    """Bits of the items' shingles, 16 for each up to ``MOST_BITS``: what reaches the driver, 64 bits a row, has that bound."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(16 * max(1, shingles_in_items)))))
    place = F.shiftright(F.col("code").bitwiseAND(F.lit(size - 1)), 6)
    words = codes.groupBy(place.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(code & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(size // 64, "<i8")
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): one row for each document and each item that it holds."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text <> ''")
    wanted = items.select("item_id", "passage").where("item_id IS NOT NULL AND passage <> ''").distinct()
    passages = wanted.groupBy("passage").agg(F.min("item_id").alias("item"))
    units = "item bigint, kind string, size int, units array<bigint>, need int, share int, codes array<bigint>"
    known = cut(passages.select("item", "passage").mapInPandas(_item_rows, units))
    # At most as many rows as there are sizes of shingles.
    kinds = known.groupBy("kind", "size").agg(F.min("need").alias("need"), F.sum(F.size("codes")).alias("n")).collect()
    empty = texts.select("doc_id", F.lit(0).cast("bigint").alias("item_id")).where("false")
    if not kinds:
        return empty
    sizes = {k: sorted({r["size"] for r in kinds if r["kind"] == k}) for k in sorted({r["kind"] for r in kinds})}
    least = {k: min(r["need"] for r in kinds if r["kind"] == k) for k in sizes}
    each = known.select("item", "kind", F.size("units").alias("n"), F.posexplode("codes").alias("pos", "code"))
    bitmap = spark.sparkContext.broadcast(_bitmap(each, sum(r["n"] for r in kinds)))
    schema = "doc_id bigint, at bigint, kind string, units array<bigint>, codes array<bigint>"
    # Read three times below: the corpus is scanned once, and the rows that can matter are written.
    held = cut(texts.select("doc_id", F.monotonically_increasing_id().alias("at"), "text").mapInPandas(_scanned(sizes, least, bitmap), schema))
    hits = held.select("at", "kind", F.explode("codes").alias("code"))
    rarity = hits.groupBy("kind", "code").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(rarity, ["kind", "code"], "left").groupBy("item", "kind", "n").agg(
        F.array_sort(F.collect_list(F.struct("pos", "code", F.coalesce("df", F.lit(0)).alias("df")))).alias("met"))
    index = ranked.mapInPandas(_prefixed, "item bigint, code bigint")
    pairs = hits.join(index, "code").select("at", "kind", "item").distinct()
    # The narrow rows first: units are joined to the pairs that share enough.
    enough = F.size(F.array_intersect("codes", "item_codes")) >= F.col("share")
    wide = pairs.join(held.select("at", "kind", "codes"), ["at", "kind"]).join(known.select("item", "kind", "share", F.col("codes").alias("item_codes")), ["item", "kind"])
    close = wide.where(enough).select("at", "kind", "item")
    met = close.join(held.select("at", "kind", "doc_id", "units"), ["at", "kind"]).join(known.select("item", "kind", "size", F.col("units").alias("item_units")), ["item", "kind"])
    sorted_ = met.select("doc_id", "at", "kind", "units", "size", "item_units", "item").sortWithinPartitions("at", "kind")
    found = sorted_.mapInPandas(_verified, "doc_id bigint, item bigint").distinct()
    same = wanted.join(passages, "passage").select("item", "item_id")
    return found.join(same, "item").select("doc_id", "item_id")
