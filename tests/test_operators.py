import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.functions import answers, candidates, text
from spanforge.operators import contexts, diagnostics, evaluation, grounding, knowledge, models, ordering, prompts, retrieval
from spanforge.sources import annotator, arrow_ipc, lines, sinks
from spanforge.streaming import resume


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).head().x


def test_keys(spark):
    t = F.col("t")
    assert one(spark, text.compact_key(t), t=" IL-2_b\t") == "il2b"
    assert one(spark, text.alnum_key(t), t="TNF-α 1") == "tnfalpha1"
    assert one(spark, text.symbol_key(t), t="Gene Symbol: (abc1).") == "ABC1"
    assert one(spark, text.bare_identifier(t), t="NCBIGene:12*|13") == "12"
    assert one(spark, text.without_suffix(t), t="abc protein GENE") == "abc"
    assert one(spark, text.lenient_int(t), t="3.9") == 3
    assert one(spark, text.lenient_int(t), t="x") == 0


def test_window_is_clipped(spark):
    c = text.window_context(F.col("t"), F.col("a"), F.col("b"), 3)
    assert one(spark, c, t="ab\ncdefgh", a=2, b=4) == "ab cdef"
    assert one(spark, c, t="abc", a=0, b=3) == "abc"


def test_simple_sentences(spark):
    got = one(spark, text.simple_sentences(F.col("t")), t="!! A b.  C?  ")
    assert [(s.start, s.end, s.text) for s in got] == [(2 + 1, 7, "A b."), (9, 11, "C?")]


def test_sentence_context_falls_back(spark):
    df = spark.createDataFrame([(1, "x", 5, 8), (2, "y", 500, 501), (3, "none", 0, 1), (4, None, 0, 1)], "id int, d string, a int, b int")
    docs = spark.createDataFrame([("x", "One. Two here. Three."), ("y", "..."), ("z", None)], "d string, t string")
    got = {r.id: (r.sentence, r.three_sentences) for r in contexts.with_sentence_contexts(df, docs, "d", "t", "a", "b").collect()}
    assert got == {1: ("Two here.", "One. Two here. Three."), 2: ("", ""), 3: ("", ""), 4: ("", "")}
    own = contexts.with_sentence_contexts(df, docs, "d", "t", "a", "b", default=F.lit("own")).where("id = 3").head()
    assert (own.sentence, own.three_sentences) == ("own", "own")


def test_parsers_disagree_on_purpose(spark):
    packed = "1::2::h::a|bad|3::4::m::x::y|"
    sizes = [one(spark, F.size(candidates.unpack(F.col("p"), q)), p=packed) for q in candidates.PARSERS]
    assert sizes == [1, 2, 3]
    assert one(spark, candidates.pack(candidates.unpack(F.col("p"))), p=packed) == "1::2::h::a|3::4::m::x::y"
    with pytest.raises(ValueError):
        candidates.unpack(F.col("p"), "other")


def test_answers(spark):
    t = F.col("t")
    assert one(spark, answers.answer_letter(t), t="Answer: none") == "N"
    assert one(spark, answers.option_letter(t), t="Answer: none") is None
    assert one(spark, answers.answer_letter(t), t="It is D.") == "D"
    assert one(spark, answers.answer_letter(t), t="") == "NONE"
    assert one(spark, answers.gene_number(t), t="GeneID: 77 x") == "77"
    assert one(spark, answers.tax_number(t), t="TaxID: unclear") == "unclear"


def test_too_many_options_raise(spark):
    many = F.transform(F.sequence(F.lit(1), F.lit(27)), lambda i: F.struct(*(i.cast("string").alias(f) for f in candidates.FIELDS)))
    with pytest.raises(Exception, match="26"):
        spark.range(1).select(candidates.option_lines(many)).collect()
    assert spark.range(1).select(candidates.option_lines(many, most=26).alias("x")).head().x.count("\n") == 25
    packed = spark.range(1).select(F.lit("c").alias("case_id"), F.lit("m").alias("mention"), F.lit("t").alias("context"), candidates.pack(many).alias("candidates"))
    with pytest.raises(Exception, match="26"):
        prompts.build_prompts(packed).collect()
    assert prompts.build_prompts(packed, most=5).head().n_options == 5


def test_numbering_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = ordering.numbered(df, "k").collect()
    assert all(r.ordinal == r.k + 1 for r in got)


@pytest.mark.parametrize("partitions", [4, 200])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbering_loses_no_row(spark, partitions, adaptive):
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        wide = spark.range(600_000).select((F.col("id") * 7919 % 600_000).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 6).alias("payload")).repartition(7)
        made = ordering.numbered(wide, "k")
        row = made.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ordinal").alias("d"), F.count_if(F.col("ordinal") != F.col("k") + 1).alias("wrong")).head()
        assert tuple(row) == (600_000, 600_000, 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbering_of_nothing_and_ties(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert sorted(r.ordinal for r in ordering.numbered(df, "k").collect()) == [1, 2, 3]
    assert ordering.numbered(df.where("false"), "k").count() == 0


def test_positional_zip(spark):
    a = spark.createDataFrame([(5, "x"), (7, "y"), (9, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "q"), (1, "p")], "k int, v string")
    assert sorted(tuple(r) for r in ordering.zipped(a, b, "k").collect()) == [(5, "x", 1, "p"), (7, "y", 2, "q")]


def test_article_ids(spark):
    ids = {"PMID: 30000001": "30000001", "pubmed/0030000001": "30000001", "30000001.1": "30000001", " 30000001\u00a0": "30000001", "PMC30000001": None, "10.5555/bxg.30000001": None, "x": None, "": None}
    df = spark.createDataFrame([(k,) for k in ids], "t string")
    assert {r.t: r.p for r in df.select("t", text.pmid(F.col("t")).alias("p")).collect()} == ids
    assert one(spark, text.article_id(F.col("t")), t=" PMC7 ") == "pmc7"


def test_symbols_species_and_suffixes(spark):
    t = F.col("t")
    assert one(spark, text.symbol_key(t, greek=True), t="tgf-β") == "TGF-BETA"
    assert one(spark, text.species_key(t), t="Species: 'Mus musculus'.") == "mus musculus"
    got = one(spark, text.span_without_suffix(t, F.lit(10)), t="p53 protein family")
    assert (got.mention, got.end) == ("p53", 13)
    assert one(spark, text.strip_field(t), t="\u00a0 x ") == "x" and one(spark, text.strip_field(t), t="x y") == "x y" and one(spark, text.strip_field(t), t="") == ""


def test_families(spark):
    t = F.col("t")
    assert one(spark, diagnostics.family_candidates(t), t="WNT3") == sorted(diagnostics.FAMILY_GENES["wnt"].split())
    assert one(spark, diagnostics.family_candidates(t), t="NF-κB") == sorted(diagnostics.FAMILY_GENES["nfkappab"].split())
    assert one(spark, diagnostics.family_candidates(t), t="p38 MAPK/Akt1") == sorted(diagnostics.FAMILY_GENES["mapk"].split())
    assert one(spark, diagnostics.family_candidates(t), t="BRCA1") == []
    rows = spark.createDataFrame([("WNT", False, True), ("H3", True, True), ("x", False, True), (None, False, False)], "mention string, right boolean, oracle boolean")
    assert tuple(diagnostics.trigger_report(rows).head()) == (4, 2, 1, 1, 2, 1)


def test_stages_add_up_to_the_total(spark):
    made = diagnostics.stacked([("a", 3), ("b", -1), ("c", 2)], 8, spark).collect()
    assert [(r.stage, r.correct, r.accuracy) for r in made] == [("a", 3, 0.375), ("b", 2, 0.25), ("c", 4, 0.5)]
    assert diagnostics.stacked([("a", 1)], 0, spark).head().accuracy == 0.0


def test_permutations_with_seeds(spark):
    ids = [f"d{i}" for i in range(50)]
    want = list(ids)
    random.Random(42).shuffle(want)
    assert diagnostics.sequential_permutation(ids, 42) == want
    with pytest.raises(ValueError, match="million"):
        diagnostics.sequential_permutation(ids, 42, most=10)
    orders = diagnostics.sequential_orders([3, 0, 5], 7)
    assert [sorted(o) for o in orders] == [[0, 1, 2], [], [0, 1, 2, 3, 4]] and orders == diagnostics.sequential_orders([3, 0, 5], 7)
    rows = spark.range(100).select(diagnostics.hash_order(F.col("id"), 1).alias("a"), diagnostics.hash_order(F.col("id"), 2).alias("b")).collect()
    assert len({r.a for r in rows}) == 100 and [r.a for r in rows] != [r.b for r in rows]


def test_pair_scores(spark):
    df = spark.createDataFrame([(1, "ab", "abc"), (2, "x", None)], "id int, a string, b string")
    model = lambda: lambda left, right: [len(x or "") / (1 + len(y or "")) for x, y in zip(left, right, strict=True)]
    assert {r.id: r.score for r in models.score_pairs(df, model, ["a", "b"]).collect()} == {1: 0.5, 2: 1.0}


def test_predictions_written_and_read(spark, tmp_path):
    (tmp_path / "loose").write_text("noise\nrow test_case_7 Answer: B\nmy_case_12: C\n")
    assert [(r.case_id, r.value[-1]) for r in lines.read_loose_predictions(spark, str(tmp_path / "loose")).collect()] == [("test_case_7", "B"), ("my_case_12", "C")]
    flat = sinks.flat_predictions(spark.createDataFrame([("c", "a\tb\r\nc")], "case_id string, answer string"), ["answer"])
    assert flat.head().answer == "a b  c"
    for order, answer in ((1, "A"), (2, "B")):
        sinks.append_predictions(spark.createDataFrame([("c", answer, order), ("d", "C", order)], "case_id string, answer string, n int"), str(tmp_path / "out"))
    last = sinks.last_per_case(spark.read.parquet(str(tmp_path / "out")), "n")
    assert sorted((r.case_id, r.answer) for r in last.collect()) == [("c", "B"), ("d", "C")]


def test_single_letters(spark):
    t = F.col("t")
    assert one(spark, answers.known_letter(t), t=" b ") == "B" and one(spark, answers.known_letter(t), t="F") is None and one(spark, answers.known_letter(t), t="AB") is None
    assert one(spark, answers.species(t), t="Species: Mus musculus\tx") == "Mus musculus"


def test_gene_table_entities(spark):
    rows = [(1, "9606", "1", "ABC", ["abc", "Abc2", "-"], "a gene"), (2, "9606", "1", "later", [], "x"), (3, "1", "2", "other", [], "y"), (4, "9606", "3", "-", [], "z"), (5, "10090", "4", "D", ["E"], None)]
    info = spark.createDataFrame(rows, "_ord int, tax_id string, gene_id string, symbol string, synonyms array<string>, description string")
    assert [tuple(r) for r in knowledge.gene_info_entities(info).collect()] == [("1", "9606", "human", "ABC", "ABC Abc2 human a gene")]


def test_remote_annotations(spark):
    answer = {"annotations": [
        {"obj": "gene", "id": ["NCBIGene:7", "x"], "mention": "TP53", "span": {"begin": 0, "end": 4}}, {"obj": "gene", "id": ["other:1", "NCBIGene:9"], "mention": "B", "span": {"begin": 1, "end": 2}},
        {"obj": "gene", "id": []}, {"obj": "disease", "id": ["NCBIGene:5"], "mention": "flu", "span": {"begin": 3, "end": 5}}]}
    body = json.dumps(answer)

    def transport():
        def call(t):
            if t == "bad":
                raise TimeoutError("120 s")
            return "no json" if t == "odd" else body

        return call

    docs = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "odd"), ("4", None)], "doc_id string, text string")
    made = annotator.request_annotations(docs, transport, pace=0.0).cache()
    assert {r.doc_id: r.error for r in made.collect()} == {"1": None, "2": "TimeoutError: 120 s", "3": None}
    assert [tuple(r) for r in annotator.parse_annotations(made).collect()] == [("1", 0, 4, "TP53", "Gene", "7")]


def test_tokens_of_long_texts_are_linear(spark):
    df = spark.createDataFrame([(1, "word " * 200_000), (2, None), (3, "")], "id int, t string")
    assert contexts.tokens(df, "t").count() == 200_000
    assert df.select(F.size(text.simple_sentences(F.repeat(F.lit("One. "), 50_000))).alias("n")).head().n == 50_000


def test_first_last_mode_ties(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("a", "x", 4), ("b", None, 5)], "k string, v string, o int")
    assert {r.k: r.v for r in ordering.first_wins(df, ["k"], "o").collect()} == {"a": "x", "b": None}
    assert {r.k: r.v for r in ordering.last_wins(df, ["k"], "o").collect()} == {"a": "x", "b": None}
    assert {r.k: (r.v, r.n_count) for r in ordering.mode_per_key(df, ["k"], "v", "o").collect()} == {"a": ("x", 2), "b": (None, 1)}
    with pytest.raises(ValueError, match="missing"):
        ordering.require_columns(df, ["nope"])


def test_attach_is_null_safe_and_strict(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "z")], "id int, k string")
    b = spark.createDataFrame([(None, 9), ("x", 8), ("z", 7)], "k string, id int")
    assert {r.id: r.id_context for r in contexts.attach(a, b, ["k"]).collect()} == {1: 9, 2: 8, 3: 7}
    with pytest.raises(Exception, match="repeated key"):
        contexts.attach(a, b.union(b), ["k"]).collect()


def test_canvas(spark):
    schema = "p array<struct<kind:string,text:array<string>,offsets:array<array<int>>>>"
    df = spark.createDataFrame([([("abstract", ["world!!"], [[7, 12]]), ("title", ["Hello"], [[0, 5]])],), ([],)], schema)
    got = [tuple(r) for r in df.select(contexts.text_by_offsets(F.col("p")), contexts.text_with_gaps(F.col("p"))).collect()]
    assert got == [("Hello  world", "Hello  world!!"), ("", "")]


def test_bio_round_trip(spark):
    df = spark.createDataFrame([(1, "the zinc finger 5 gene", 4, 17)], "id int, t string, a int, b int")
    made = contexts.tokens(df, "t").withColumn("label", contexts.bio_label(*(F.col(c) for c in ("tok_start", "tok_end", "a", "b"))))
    assert [tuple(r) for r in contexts.merged_spans(made, ["id"]).select("span_start", "span_end").collect()] == [(4, 17)]


def test_cascade_modes(spark):
    d = spark.createDataFrame([("A", "9606", "1", 3), ("A", "10090", "2", 5), ("B", "1", "3", 1), ("C", "5", "4", 1), ("C", "6", "5", 2)], "term string, tax_id string, gene_id string, n_count int")
    q = spark.createDataFrame([(1, "A", "10090"), (2, "A", "7"), (3, "B", "7"), (4, "C", "7"), (5, "Z", "7"), (6, None, None)], "id int, term string, tax_id string")
    got = {r.id: (r.gene_id, r.mode) for r in grounding.ground(q, d).collect()}
    assert got == {1: ("2", "species"), 2: ("1", "human_fallback"), 3: ("3", "unique_global"), 4: ("4", "first_fallback"), 5: (None, "unmapped"), 6: (None, "unmapped")}
    assert {r.id: r.gene_id for r in grounding.ground(q, d, "prior").collect()} == {1: "1", 2: "1", 3: "3", 4: "5", 5: None, 6: None}
    assert {r.id: r.gene_id for r in grounding.ground(q, d, "global").collect()}[4] == "5"


def test_order_stability_rejects_other_cases(spark):
    a = spark.createDataFrame([(1, ["x", "y"], "A")], "k int, ids array<string>, letter string")
    b = spark.createDataFrame([(1, ["y", "x"], "B")], "k int, ids array<string>, letter string")
    r = evaluation.order_stability(a, b, "k").head()
    assert (r.comparable, r.same_id, r.moved, r.followed_id) == (1, 1, 1, 1)
    with pytest.raises(Exception, match="differ"):
        evaluation.order_stability(a, spark.createDataFrame([(2, ["x"], "A")], "k int, ids array<string>, letter string"), "k").collect()


def test_rates_without_cases(spark):
    empty = spark.createDataFrame([], "doc_id string, start_pos int, end_pos int, gold array<string>")
    pred = spark.createDataFrame([], "doc_id string, start_pos int, end_pos int, gene_id string")
    r = evaluation.span_metrics(empty, pred, ["doc_id", "start_pos", "end_pos"]).head()
    assert (r.n_gold, r.accuracy_all) == (0, 0.0)


def test_gate_override_boost(spark):
    base = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    better = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert {r.k: r.v for r in grounding.override(base, better, "k", "v", True).collect()} == {1: "x", 2: "b"}
    assert {r.k: r.v for r in grounding.override(base, better, "k", "v", False).collect()} == {1: "x", 2: "y"}
    gold = spark.createDataFrame([("d", 1, "t"), ("d", 2, "u")], "doc string, at int, term string")
    pred = spark.createDataFrame([("d", 3, "9")], "doc string, at int, gene_id string")
    terms = spark.createDataFrame([("t",)], "term string")
    assert grounding.boosted(pred, gold, terms, ["doc", "at"], "term").count() == 2
    rows = spark.createDataFrame([(True, "a", "b"), (None, "a", "b")], "g boolean, a string, b string")
    assert [r.chosen for r in grounding.gated(rows, F.col("g"), "a", "b").collect()] == ["a", "b"]


def test_prompts_and_rejects(spark):
    rows = [("c1", "m", "x\ty", "1::9606::human::T"), ("c2", "m", None, ""), ("c3", "m", "t" * 900, "bad")]
    made = prompts.build_prompts(spark.createDataFrame(rows, "case_id string, mention string, context string, candidates string"))
    assert {r.case_id: r.reason for r in made.collect()} == {"c1": None, "c2": "empty_candidates", "c3": "bad_candidate_format"}
    assert "Context: x y" in made.where("case_id = 'c1'").head().prompt
    assert {r.case_id: len(r.context) for r in prompts.rejects(made).collect()} == {"c2": 0, "c3": 500}
    out = models.generate(made, models.stub_generator)
    assert [r.case_id for r in out.collect()] == ["c1"]
    scored = models.score_letters(made, models.stub_scorer, (" {}", "{}")).head()
    loss = models.loss_scorer(lambda: lambda texts, ends: ([0.5 if e == "B" else 1.0 for e in ends], [2] * len(ends)))
    assert models.score_letters(made, loss).head().asDict() == {"case_id": "c1", "letter": "B", **{f"score_{x}": -1.0 if x == "B" else -2.0 for x in models.LETTERS}}
    assert all("rose" in r.p for t in prompts.TEMPLATES if t != "compact" for r in spark.range(1).select(prompts.prompt_text(t, F.lit("m"), F.lit("m rose")).alias("p")).collect())
    assert scored[f"score_{scored.letter}"] == max(scored[f"score_{x}"] for x in models.LETTERS)


def test_encoder_and_dense(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, None)], "id bigint, text string")
    v = retrieval.encode_texts(df, models.stub_encoder)
    got = retrieval.dense_top(v, v, 2)
    assert {(r.query_id, r.pos): r.entity_id for r in got.collect()}[(1, 1)] == 1


def test_retries():
    calls = []

    def call(x):
        calls.append(x)
        raise OSError

    assert models.with_retries(call, 3, 0, 0)("a") == (None, "OSError: ")
    assert models.with_retries(str.upper, 3, 0, 0)("a") == ("A", None)
    assert len(calls) == 3


def test_arrow_files(spark, tmp_path):
    table = pa.table({"id": [1, 2], "t": [["a"], None]})
    for name, make in (("file.arrow", pa.ipc.new_file), ("stream.arrow", pa.ipc.new_stream)):
        with pa.OSFile(str(tmp_path / name), "wb") as f, make(f, table.schema) as w:
            w.write_table(table)
    assert sorted((r.id, r.t) for r in arrow_ipc.read_arrow(spark, str(tmp_path)).collect()) == [(1, ["a"]), (1, ["a"]), (2, None), (2, None)]
    for path in (f"file://{tmp_path}", str(tmp_path / "*.arrow"), f"file://{tmp_path}/*.arrow"):
        assert arrow_ipc.read_arrow(spark, path).count() == 4
    with pa.OSFile(str(tmp_path / "many"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        for _ in range(arrow_ipc.BATCHES + 5):
            w.write_table(table)
    many = arrow_ipc.read_arrow(spark, str(tmp_path / "many"))
    assert many.count() == 2 * (arrow_ipc.BATCHES + 5) and many.rdd.getNumPartitions() == 2


def test_line_formats(spark, tmp_path):
    (tmp_path / "g").write_text("#c\n9606\t10\tABC1\t-\tIL-2|IL2\t-\t-\t-\tdemo\nshort\n")
    assert {r.term for r in lines.gene_info_terms(lines.read_gene_info(spark, str(tmp_path / "g"))).collect()} == {"ABC1", "IL-2", "IL2"}
    (tmp_path / "k").write_text("symbol\ttaxid\tgeneid\tfreq\nA\t9606\t1\t5\nB\t9606\t2\tx\n")
    assert {(r.term, r.n_count) for r in lines.read_dictionary(spark, str(tmp_path / "k")).collect()} == {("A", 5), ("B", 0)}
    (tmp_path / "t").write_text('a\tb\nNA\t"x ""y"""\n\t2\n')
    assert sorted(tuple(r) for r in lines.read_tsv(spark, str(tmp_path / "t")).collect()) == [("", "2"), ("NA", 'x "y"')]
    assert not lines.has_open_lines(spark, str(tmp_path / "t"))
    (tmp_path / "o").write_text('a\tb\n1\t"x\ny"\n')
    assert lines.has_open_lines(spark, str(tmp_path / "o")) and [tuple(r) for r in lines.read_tsv(spark, str(tmp_path / "o")).collect()] == [("1", "x\ny")]
    (tmp_path / "p").write_text("case_id\tanswer\nc1\tAnswer: B\tC\nbroken\n")
    assert [tuple(r)[1:] for r in lines.read_predictions(spark, str(tmp_path / "p")).collect()] == [("c1", "Answer: B\tC")]
    (tmp_path / "j").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in lines.read_jsonl(spark, str(tmp_path / "j"), "a int").collect()] == [1, 2]
    got = one(spark, lines.packed_genes(F.col("s")), s="9606:9466-3562,*9244-3489|10090:218624-51395|bad")
    assert [(x.tax_id, x.gene_id) for x in got] == [("9606", "9466"), ("9606", "9244"), ("10090", "218624")]
    for line, want in {"9606,7,ABC,1": ("ABC", "9606", "7"), "ABC,7,9606,1": ("ABC", "9606", "7"), "7,ABC,9606,x": ("ABC", "9606", "7"), "A,B,7,1": None, "7,ABC,9606": None}.items():
        got = one(spark, lines.guess_columns(F.split(F.col("s"), ",")), s=line)
        assert (got and (got.term, got.tax_id, got.gene_id)) == want
    (tmp_path / "h").write_text("ABC\t7\t9606\t1\nA\tB\tC\tD\n")
    assert [tuple(r)[1:] for r in lines.read_headerless(spark, str(tmp_path / "h")).collect()] == [("ABC", "9606", "7")]
    (tmp_path / "l").write_text("term\ttax_id\tgene_id\tcount\nA\t9606\t1\tx\nB\t9606\t2\n")
    assert [tuple(r)[1:] for r in lines.read_kb_lines(spark, str(tmp_path / "l")).collect()] == [("A", "9606", "1", 0)]
    (tmp_path / "m").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="term, tax_id, gene_id"):
        lines.read_dictionary(spark, str(tmp_path / "m"))
    (tmp_path / "many").mkdir()
    for name, rows in (("b", "3 4"), ("a", "1  2")):
        (tmp_path / "many" / name).write_text("\n".join(f'{{"a": {x}}}' if x else "" for x in rows.split(" ")))
    assert [r.a for r in lines.read_jsonl(spark, str(tmp_path / "many"), "a int", 3).collect()] == [1, 2, 3]
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.csv").write_text('a,"b, ""c"""\nd,\n')
    got = [(r.line, r.cell_no, r.cell) for r in lines.read_cells(spark, str(tmp_path / "d")).orderBy("line", "cell_no").collect()]
    assert got == [(1, 0, "a"), (1, 1, 'b, "c"'), (2, 0, "d"), (2, 1, "")]


def test_pubtator_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([("d1", "T", "A b"), ("d2", None, None)], "doc_id string, title string, abstract string")
    mentions = spark.createDataFrame([("d1", 2, 3, "b", "7"), ("d1", 0, 1, "A", None)], "doc_id string, start_pos int, end_pos int, mention string, identifier string")
    blocks = sinks.pubtator_blocks(texts, mentions, spark.createDataFrame([("d1", "10090")], "doc_id string, focus_tax string"))
    sinks.write_lines(blocks, str(tmp_path / "out"))
    read = lines._lines(spark, str(tmp_path / "out"))
    assert sorted((r.start_pos, r.mention, r.identifier) for r in lines.parse_pubtator(read).collect()) == [(0, "A", ""), (2, "b", "7")]
    assert {r.doc_id: r.focus_tax for r in lines.parse_focus_species(read).collect()} == {"d1": "10090", "d2": "9606"}
    assert {r.doc_id: r.abstract for r in lines.parse_pubtator_texts(read).collect()} == {"d1": "A b", "d2": ""}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 'x"\ny'), ("a", "NA")], "k string, v string")
    sinks.write_tsv(df, str(tmp_path / "t"), ["k"], single=True)
    assert [tuple(r) for r in lines.read_tsv(spark, str(tmp_path / "t")).orderBy("k").collect()] == [("a", "NA"), ("b", 'x"\ny')]
    sinks.write_both(df, ["k"], str(tmp_path / "p"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_resume(spark, tmp_path):
    path, seen = str(tmp_path / "out"), []

    def answer(df):
        seen.append(df.count())
        return df.select("case_id", F.lit("A").alias("letter"))

    a = spark.createDataFrame([("1",), ("2",), ("2",)], "case_id string")
    resume.run_batch(spark, a, answer, path)
    resume.run_batch(spark, spark.createDataFrame([("2",), ("3",)], "case_id string"), answer, path)
    assert seen == [2, 1] and spark.read.parquet(path).count() == 3
    (tmp_path / "in").mkdir()
    for n, rows in (("a", '{"case_id": "3"}\n{"case_id": "4"}\n'), ("b", '{"case_id": "5"}\n')):
        (tmp_path / "in" / f"{n}.json").write_text(rows)
        resume.run_stream(spark, str(tmp_path / "in"), "case_id string", answer, path, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.case_id for r in spark.read.parquet(path).collect()) == ["1", "2", "3", "4", "5"]


def test_training_examples_are_filled(spark):
    pool = spark.createDataFrame([("a", g, i) for i, g in enumerate("123456")] + [("b", "7", 9), ("c", "8", 10), ("c", "9", 11)], "surface string, gene_id string, ord int")
    rows = spark.createDataFrame([(1, "a", ["1", "3"]), (2, "b", ["7"]), (3, "none", ["x"]), (4, "c", ["9"])], "id int, surface string, golds array<string>")
    made = {}
    for r in evaluation.training_examples(rows, pool, 3, "surface", "ord").collect():
        made.setdefault((r.id, r.gold_id), ([], []))[r.label].append(r.gene_id)
    assert {key: positive for key, (_, positive) in made.items()} == {(1, "1"): ["1"], (1, "3"): ["3"], (2, "7"): ["7"], (3, "x"): ["x"], (4, "9"): ["9"]}
    golds = {1: {"1", "3"}, 2: {"7"}, 3: {"x"}, 4: {"9"}}
    assert all(len(negative) == len(set(negative)) == 3 and not golds[i] & set(negative) for (i, _), (negative, _) in made.items())
    assert sorted(made[1, "1"][0]) == sorted(made[1, "3"][0]) == ["2", "4", "5"] and "8" in made[4, "9"][0]
    few = pool.where("surface <> 'a'")
    assert evaluation.training_examples(rows.where("id = 2"), few, 3, "surface", "ord").where("label = 0").count() == 2


def test_ngram_genes_keep_all_rows_and_genes(spark):
    queries = spark.createDataFrame([(1, "abc1"), (2, "abc1"), (3, None), (4, "xyz")], "id int, text string")
    entries = spark.createDataFrame([(10, "g1", "abc1"), (11, "g2", "abc1"), (12, "g1", "abc12"), (13, "g3", "abc1"), (14, "g2", "abc1"), (15, None, "abc1")], "id int, gene_id string, text string")
    got = sorted(tuple(r) for r in retrieval.ngram_genes(queries, entries, 20).collect())
    assert got == [(q, g, p) for q in (1, 2) for p, g in enumerate(("g1", "g2", "g3"), 1)]
    assert retrieval.ngram_genes(queries, entries, 2).where("pos > 2 OR gene_id = 'g3'").count() == 0
