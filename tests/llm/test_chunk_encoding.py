import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import chunk_encoding as c
from spanforge.llm.settings import TOKENIZERS

PATH = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
PIECES = ["don't", "'ll", " ", "  ", "\n\n", "a" * 30, "x1", "é", "漢字。", "ไทย", "🧬", "‍", "3.14", "...", "'", "s", "\t", "<|endoftext|>", "Б", "́"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.lists(st.integers(1, 300), max_size=12))
def test_any_cut_gives_the_whole_texts_ids(pieces, at):
    tokens, lengths = c.encoder(PATH)
    text = "".join(pieces)
    if not text:
        return
    edges = sorted({0, len(text), *(a for a in at if a < len(text))})
    chunks = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    sure = [True, *(c.SURE.match(text, e) is not None for e in edges[1:-1]), True]
    made = []
    for x, left, right in zip(chunks, sure, sure[1:], strict=False):
        ids, sides = np.array(tokens.encode_ordinary(x), np.int32), (not left) + 2 * (not right)
        made.append((ids, sides, *(c.sure_ends(x, ids, lengths) if sides else (None,) * 4)))
    assert c.joined_ids(made, tokens).tolist() == tokens.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=1, max_size=12), st.integers(1, 800))
def test_cuts_cover_the_text(piece, times):
    text = piece * times
    ends = c.cuts(text)
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    assert all(b - a <= c.MOST + c.SNAP for a, b in zip([0, *ends], ends, strict=False))


def test_chunks_are_shared():
    import random

    rng = random.Random(0)
    body = "".join(rng.choice("abcdef ghij.") for _ in range(20_000))
    parts = lambda t: {t[a:b] for a, b in zip([0, *c.cuts(t)], c.cuts(t), strict=False)}
    a, b = parts(body), parts("something else first. " + body)
    assert len(a & b) >= 0.9 * len(a)


def test_memory_keeps_frequent_chunks():
    memory, made = c._Memory(10), []
    for i in range(50):
        for key in ("often", f"once {i}"):
            memory.get(key, 1, lambda key=key: made.append(key) or (key,))
    assert made.count("often") == 1


def test_operator_agrees_with_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [None, "", " ", "<|endoftext|> end", "don't " * 3000, "漢字。" * 5000, "a" * 20_000, "\u0000\r\n\t x", "🧬👩‍🔬" * 900, "same", "same", "ไทย ไทย" * 700, "".join(f"{i} plain words, " for i in range(900)) + "字" * 9000 + " and so on" * 400]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(texts)] + [(0, "again", "", 2)], "doc_id bigint, text string, chunk string, row int")
    got = sorted((r.doc_id, list(r.ids)) for r in c.encode_corpus(df).collect())
    want = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in [*enumerate(texts), (0, "again")]]
    assert got == sorted(want)
    assert c.encode_corpus(df.where("false")).count() == 0
