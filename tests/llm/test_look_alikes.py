import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm.look_alikes import look_alike_classes, look_alike_pairs, visual_form

ALIKE = [
    ("severe pancreas", "ѕеvеrе раnсrеаѕ"), ("BE", "ВЕ"), ("file", "ﬁle"), ("ABC 12", "ＡＢＣ　１２"), ("café", "café"), ("example", "ex­am​ple﻿"), ("a b", "a b"),
    ("IL-2", "IL‑2"), ("IL-2", "IL－2"), ("ёж", "ёж"), ("ë", "ё"), ("bell", "be\u0007ll"), ("рак", "pак"), ("FP7β HPO", "FP7β ΗΡΟ"), ("น้ำ", "น้ํา"),
    ("A", "𝐀"), ("IV", "Ⅳ"), ("°C", "℃"), ("oh", "օh"), ("pH", "ⲣH"), ("DNA", "ᎠNA"), ("BE", "ꓐꓰ"), ("...", "…"), ("μm", "µm"), ("OS", "ՕՏ"), ("HIV", "ᎻIᏙ"),
    ("gene", "ɡene"), ("(1)", "⑴"), ("ﷲ", "الله"), ("ГП", "ΓΠ"),
]
DIFFERENT = [("severe", "Severe"), ("cafe", "café"), ("10³", "103"), ("a1", "al"), ("FP7α", "FP7a"), ("a-b", "a—b"), ("№ 2", "No 2"), ("👩‍🔬", "👩🔬"), ("ab", "a b"), ("е", "э"), ("A", "Ⓐ"), ("CO₂", "CO2"), ("½", "1/2"), ("Straße", "Strasse"), ("σ", "ς"), ("o", "ö")]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(a, b):
    assert visual_form(a) == visual_form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert visual_form(a) != visual_form(b)


def test_other_scripts_keep_their_words():
    for text in ("Հայերեն օր", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "Ⲁⲛⲟⲕ ⲡⲉ", "Ελληνικά νόμος", "Книга о ней"):
        assert visual_form(text) == text


def test_script_of_the_text_wins():
    assert visual_form("Белок в pоcте") == "Белок в росте"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aаeеoоοBВΒжβ1 -‐​́éｅﬁ\n", max_size=30))
def test_form_is_stable(text):
    form = visual_form(text)
    assert visual_form(form) == form
    assert unicodedata.normalize("NFC", form) == form
    assert visual_form(unicodedata.normalize("NFD", text)) == form


def test_pairs(spark):
    texts = [a for a, _ in ALIKE[:3]] + [b for _, b in ALIKE[:3]] + ["severe pancreas", None, "", "  ", "​"] + ["hot"] * 40 + ["hοt"] * 2 + ["x" * 200_000, "х" * 200_000]
    df = spark.createDataFrame([(i, t, "k", "m") for i, t in enumerate(texts)], "doc_id bigint, text string, key string, mark string")
    got = sorted(tuple(r) for r in look_alike_pairs(df).collect())
    forms = {i: visual_form(t) for i, t in enumerate(texts) if t and t.strip() and visual_form(t).strip()}
    want = sorted((i, j) for i in forms for j in forms if i < j and forms[i] == forms[j] and texts[i] != texts[j])
    assert got == want and len(want) == 4 + 80 + 1
    assert look_alike_pairs(df.where("false")).count() == 0
    group = lambda i, same: min(j for j in forms if same(forms[j], forms[i]))
    mixed = {i for pair in want for i in pair}
    classes = [(i, group(i, str.__eq__), min(j for j in forms if texts[j] == texts[i])) for i in sorted(mixed)]
    assert sorted(tuple(r) for r in look_alike_classes(df).collect()) == classes
    assert look_alike_classes(df.where("false")).count() == 0
