"""Token ids of every text by a public byte-level tokenizer, each distinct chunk being encoded once.

Texts are cut where a rolling hash of their last ``WINDOW`` characters says so, hence the same passage gives the same
chunks in whatever document it stands; a cut moves on to the next sure boundary if there's one within ``SNAP`` characters.
Equal chunks of a batch are brought into one row with the places they stand at, so that their text travels once from each
batch; the rows of a chunk meet by its 128-bit hash and it is encoded once. Where one is so frequent that its rows fill a
task, the planner splits them, and each piece encodes it once.

At cuts that are no sure boundary the ids are repaired: the stretch from the last sure boundary before the join to the
first one behind it is encoded again; where a chunk holds no such boundary the stretch grows over the next chunk, until it
ends at one. Between sure boundaries the tokenizer's own split is the same in the chunk as in the whole text, so the
result agrees exactly with the encoding of the whole text. Joins at sure boundaries need no repair: those documents' ids
are put together in the JVM.

A boundary is sure behind a non-space before a space, and behind a letter or digit before anything that is neither: no
piece of the tokenizer's pattern reaches over such a place, whatever stands around it.

Defined results: null and empty texts give an empty list. Names of special tokens are ordinary text. Texts are encoded
whole, whatever their length. Repeated doc_ids keep a list each.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.settings import TOKENIZERS

WINDOW, MASK, LEAST, MOST, SNAP = 16, 0x1FF, 128, 4096, 64
#: Characters of texts that are cut together, and of the chunks in either half of a task's memory.
TOGETHER, KNOWN = 1_000_000, 8_000_000
#: The tokenizer's published split pattern, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SURE = regex.compile(r"(?<=\S)(?=\s)|(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def encoder(path: str):
    """The tokenizer and the byte length of each of its tokens, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def _hash_ends(joint: str) -> np.ndarray:
    """Places behind the windows whose hash ends in zeros; the hash doubles its window in each step."""
    codes = np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.zeros(0, np.int64)
    rolled = (codes + np.uint64(1)) * _BASE
    rolled ^= rolled >> np.uint64(29)
    factor, width = 0x100000001B3, 1
    while width < WINDOW:
        rolled = rolled[:-width] * np.uint64(factor) + rolled[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    return np.nonzero((rolled >> np.uint64(40)) & np.uint64(MASK) == 0)[0] + WINDOW


def _placed(text: str, at: list[int]) -> tuple[list[int], list[bool]]:
    """Ends of the chunks, LEAST to MOST + SNAP apart, and whether each is a sure boundary."""
    n, last = len(text), 0
    ends, sure = [], []

    def add(p: int) -> None:
        nonlocal last
        m = SURE.search(text, p, min(n, p + SNAP + 1))
        last = m.start() if m else p
        ends.append(last)
        sure.append(m is not None)

    for p in at:
        while p - last > MOST:
            add(last + MOST)
        if p - last >= LEAST:
            add(p)
    while n - last > MOST:
        add(last + MOST)
    if last < n:
        ends.append(n)
        sure.append(True)
    return ends, sure


def cuts(text: str) -> list[int]:
    """Ends of a text's chunks."""
    at = _hash_ends(text)
    return _placed(text, at[at < len(text)].tolist())[0]


def _combined(docs: list, texts: list[str]) -> pd.DataFrame:
    """One row for each distinct chunk with the documents, numbers and open sides (1 left, 2 right) of its places."""
    marks = _hash_ends("".join(texts))
    upto = np.cumsum([len(t) for t in texts])
    a, b = np.searchsorted(marks, upto - [len(t) for t in texts] + WINDOW), np.searchsorted(marks, upto)
    met: dict[bytes, tuple] = {}
    for (doc, row), text, begin, x, y in zip(docs, texts, upto.tolist(), a.tolist(), b.tolist(), strict=True):
        ends, sure = _placed(text, (marks[x:y] - (begin - len(text))).tolist())
        start, left = 0, True
        for no, (end, right) in enumerate(zip(ends, sure, strict=True)):
            chunk = text[start:end]
            key = xxhash.xxh3_128_digest(chunk.encode())
            known = met.get(key)
            if known is None:
                known = met[key] = (chunk, [], [], [], [])
            known[1].append(doc)
            known[2].append(row)
            known[3].append(no)
            known[4].append((not left) + 2 * (not right))
            start, left = end, right
    columns = dict(zip(("chunk", "docs", "rows", "nos", "open"), zip(*met.values(), strict=True), strict=True))
    return pd.DataFrame({"hash": list(met), **columns})


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        docs, texts, size = [], [], 0
        for doc, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"], strict=True):
            docs.append((doc, row))
            texts.append(text)
            size += len(text)
            if size > TOGETHER:
                yield _combined(docs, texts)
                docs, texts, size = [], [], 0
        if texts:
            yield _combined(docs, texts)


def sure_ends(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[int, str, int, str]:
    """First and last sure boundary within a chunk: how many tokens stand before the first and the text they encode, how
    many before the last and the text behind it. -1 where the chunk has none."""
    first = SURE.search(text, 1)
    if first is None:
        return -1, text, -1, ""
    at = first.start()
    last = at
    back = 64
    while last == at:  # the last one, looked for from the end
        window = max(at, len(text) - back)
        for m in SURE.finditer(text, window):
            last = m.start()
        if window == at:
            break
        back *= 4
    ends = np.cumsum(lengths[ids])
    i, j = (int(np.searchsorted(ends, len(text[:p].encode()), side="right")) for p in (at, last))
    return i, text[:at], j, text[last:]


class _Memory:
    """Ids of chunks in two halves: when the young one is full it becomes the old one, and what was used meanwhile is in
    it, so frequent chunks stay."""

    def __init__(self, most: int):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def get(self, key: bytes, size: int, make) -> tuple:
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key) or make()
            if self.size > self.most:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[key] = got
            self.size += size
        return got


_COLUMNS = ("doc_id", "row", "no", "open", "ids", "before", "head", "upto", "tail")


def _encoded(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, lengths = encoder(path)
        memory = _Memory(KNOWN)
        for pdf in batches:
            made: list[tuple] = []
            for key, chunk, docs, rows, nos, opens in zip(*(pdf[c] for c in ("hash", "chunk", "docs", "rows", "nos", "open")), strict=True):
                ids = memory.get(key, len(chunk), lambda chunk=chunk: (np.asarray(tokens.encode_ordinary(chunk), np.int32),))[0]
                ends = sure_ends(chunk, ids, lengths) if any(opens) else (None, None, None, None)
                made += [(doc, row, no, o, ids, *ends) for doc, row, no, o in zip(docs, rows, nos, opens, strict=True)]
            if made:
                yield pd.DataFrame(dict(zip(_COLUMNS, zip(*made, strict=True), strict=True)))

    return run


def joined_ids(chunks: list[tuple], tokens) -> np.ndarray:
    """Ids of the whole text from its chunks in order: (ids, open sides, tokens before the first sure boundary, their text,
    tokens before the last one, the text behind it); the last four only where a side is open."""
    out: list[np.ndarray] = []
    pending = ""

    def again(text: str) -> None:
        if text:
            out.append(np.asarray(tokens.encode_ordinary(text), np.int32))

    for ids, sides, before, head, upto, tail in chunks:
        left, right = sides & 1, sides & 2
        if not left:
            again(pending)
            pending = ""
        if not sides:
            out.append(ids)
        elif before < 0:  # no boundary within: all of it joins the stretch
            pending += head
        else:
            if left:
                again(pending + head)
                pending = ""
            out.append(ids[before if left else 0 : upto if right else len(ids)])
            if right:
                pending = tail
    again(pending)
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _repair(path: str):
    @F.pandas_udf("array<int>")
    def run(parts: pd.Series) -> pd.Series:
        tokens, _ = encoder(path)
        # Numbers beside nulls come as floats.
        whole = lambda x: None if x is None or x != x else int(x)
        take = lambda p: (np.asarray(p["ids"], np.int32), int(p["open"]), whole(p["before"]), p["head"], whole(p["upto"]), p["tail"])
        return pd.Series([None if chunks is None else joined_ids([take(p) for p in chunks], tokens) for chunks in parts])

    return run


def encode_corpus(documents: DataFrame, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids) of every document."""
    path = os.path.join(tokenizers, f"{name}.tiktoken")
    texts = documents.select("doc_id", "text")
    empty = texts.where("text IS NULL OR text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    # Copies of a doc_id need a name of their own: the row's place in its file.
    filled = texts.where("text <> ''").select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    chunks = filled.mapInPandas(_chunked, "hash binary, chunk string, docs array<bigint>, rows array<bigint>, nos array<int>, open array<int>")
    # Equal chunks come to one task, unless they are so many that the planner splits them: then to a few.
    placed = chunks.hint("rebalance", F.col("hash"))
    encoded = placed.mapInPandas(_encoded(path), "doc_id bigint, row bigint, no int, open int, ids array<int>, before int, head string, upto int, tail string")
    part = F.struct("no", "ids", "open", "before", "head", "upto", "tail")
    joined = encoded.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(part)).alias("parts"), (F.max("open") > 0).alias("open"))
    # Only documents with a join to mend go to Python.
    mended = joined.select("doc_id", "open", "parts", _repair(path)(F.when(F.col("open"), F.col("parts"))).alias("mended"))
    ids = F.when(F.col("open"), F.col("mended")).otherwise(F.flatten(F.transform("parts", lambda p: p["ids"])))
    return mended.select("doc_id", ids.alias("ids")).unionByName(empty)
