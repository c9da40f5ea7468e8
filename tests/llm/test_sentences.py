import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm.sentences import sentence_units, sentences

CASES = {
    "en": ["It rose in E. coli K-5 (Fig. 2C; n = 4).", "Both arms came from the U.S.", "In the U.S. National cohort, i.e. rats, p5 fell vs. 3.4 at 9 a.m. and 6 p.m.", "Is it required?!", '(See Suppl. Fig. 4 in mice.)', 'The protocol states: "Stop if it rises! Do not add it."', 'One reading is that "It is spared. It binds." but rats disagree.', "p63Y was lost within 8.3 h.", "What remains (does it act? does it matter?) is early ... at least in cells."],
    "de": ["Bei ca. 79 % war es z. B. in der Lunge erhöht.", "Am 2. Mai wurde es gemessen.", "„X fehlt. Das überrascht.“ heißt es im Protokoll.", "Dies gilt d. h. nur für A (vgl. Abb. 5 und Tab. 4)."],
    "fr": ["«\xa0X est absent. C'est étonnant.\xa0», note le protocole.", "Pourquoi X manque-t-il\xa0?", "Ont été mesurés X, Y, etc.", "Avec X (réf. 6), la fièvre augmente (p. 4 du suppl.)."],
    "es": ["«X no actúa. Nunca lo hizo.», pero Y sí.", "¿Por qué falta X?", "Aprox. 6 % expresan X, p. ej. en el timo."],
    "ru": ["Измеряли X и т. д.", "«X не найден. Это странно.» — сказано в отчёте.", "Около 7 %, т. е. немногие, и др. влияют (рис. 7)."],
    "hi": ['"X नहीं मिला। यह अजीब है।" ऐसा लिखा है।', "डॉ. के अनुसार 8.7 है॥", "क्या X मिला?"],
    "ar": ["لماذا يغيب X عن الجلد؟", "بلغت القيمة 5.5 عند Vc."],
}
GLUED = {
    "zh": ["报告写道：“A未检出。结果出人意料。”但B仍存在。", "“A能否恢复？”这是下一个问题。", "约6.7%（见图9.4）。"],
    "ja": ["記録には「Aは検出されない。予想外である。」とあるが，Bは残る。", "発現は79であった．", "老化は止まった！"],
}


@pytest.mark.parametrize("lang", [*CASES, *GLUED])
@pytest.mark.parametrize("gap", [" ", "\n", "  "])
def test_units(lang, gap):
    units = CASES.get(lang) or GLUED[lang]
    joint = gap if lang in CASES else ""
    text = joint.join(units)
    assert [text[a:b] for a, b in sentences(text)] == units


def test_mixed_and_thai():
    parts = ["หนูที่ขาดGY-26มีการอักเสบลดลง", "ระดับเพิ่มขึ้น5.9เท่า", "No asthma was seen!"]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts
    text = "Early transcytosis.No colitis was seen!"
    assert [text[a:b] for a, b in sentences(text)] == ["Early transcytosis.", "No colitis was seen!"]


def test_open_quote_does_not_swallow():
    assert len(sentences('He said "stop. Then he left. It rained.')) == 3


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 .!?\"()«»„“”。、\n।ก'", max_size=60))
def test_spans_cover_the_text(text):
    spans = sentences(text)
    left = [c for i, c in enumerate(text) if not any(a <= i < b for a, b in spans)]
    assert not "".join(left).strip()
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


LISTS = [
    ["The steps are: 1. Wash the plate.", "2. Dry it.", "3. Store it."],
    ["1. Cells were grown.", "a. They were washed.", "b. They were dried.", "i. Twice in water.", "ii. Once in ethanol.", "c. They were stored.", "2. Mice were fed.", "3. The end came."],
    ["1.1. Aims were set.", "1.2. Methods were tried.", "1.2.1. Assays followed.", "2.1. Results came."],
    ["(i) Cells grew.", "(ii) Mice ate.", "(a) Some ate more.", "(iii) Rats slept."],
    ["A. The first part.", "B. The second part.", "I. The inner part.", "II. Another inner part.", "C. The third part."],
    ["Rats fell into group 1.", "The others fell into group 2.", "It was vitamin A.", "Then came II.", "All died."],
]
WHOLE = [
    "We met Gen. Smith there.", "It was led by Assoc. Prof. Jones.", "At 5 p.m. Monday it began.", "See Chap. 3 for more.", "See Sec. 4 for more.", "Two Ph.D. students left.",
    "The U.S. Food and Drug Administration agreed.", "Capt. Cook sailed.", "It lies in Washington D.C. near the river.",
]


@pytest.mark.parametrize("units", LISTS)
@pytest.mark.parametrize("gap", [" ", "\n"])
def test_list_levels(units, gap):
    text = gap.join(units)
    assert [text[a:b] for a, b in sentences(text)] == units


@pytest.mark.parametrize("text", WHOLE)
def test_abbreviations_go_on(text):
    joint = text + " Then it ended."
    assert [joint[a:b] for a, b in sentences(joint)] == [text, "Then it ended."]


def test_unclosed_brackets_are_linear():
    import time

    start = time.process_time()
    assert len(sentences("It fell (again. " * 100_000)) == 100_000
    sentences("([„" * 50_000 + "))]“" * 20_000)
    assert time.process_time() - start < 4


def test_long_text_is_linear():
    assert len(sentences("It fell by 3.4 (Fig. 2). " * 40_000)) == 40_000


def test_operator(spark):
    rows = [("a", None, 1), ("a", "One. Two", 2), ("a", "One. Two", 3), ("b", "", 4), ("c", "  \n", 5), (None, "X.", 6)]
    df = spark.createDataFrame(rows, "doc_id string, ctx_abstract string, sent_no int")
    got = sorted(tuple(r) for r in sentence_units(df).collect())
    assert got == [("a", 0, 0, 4), ("a", 1, 5, 8)]
    assert sentence_units(df.where("false")).count() == 0
