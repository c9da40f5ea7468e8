import pyarrow as pa

import spanforge.__main__ as cli


def test_stages(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    p = lambda n: str(tmp_path / n)
    (tmp_path / "info").write_text("9606\t10\tABC1\t-\tIL-2|X9\t-\t-\t-\tdemo\n10090\t20\tAbc1\t-\t-\t-\t-\t-\tdemo\n")
    cli.main(["dictionary-build", "--input", p("info"), "--output", p("dict")])
    (tmp_path / "m").write_text("doc_id\tmention\tstart_pos\tend_pos\tgold_geneid\tcontext\nd1\tabc 1\t0\t5\t20\tabc 1 rose\nd2\tNA\t0\t2\t10\tNA fell\n")
    cli.main(["dictionary", "--mentions", p("m"), "--dictionary", p("dict"), "--output", p("cands")])
    rows = {r.mention: r.candidates for r in cli.lines.read_tsv(spark, p("cands")).collect()}
    assert rows == {"abc 1": "10::9606::human::ABC1|20::10090::mouse::ABC1", "NA": ""}
    cli.main(["prompts", "--candidates", p("cands"), "--prompts-output", p("prompts"), "--gold-output", p("gold"), "--skipped-output", p("skipped")])
    assert spark.read.text(p("prompts")).count() == 1 and cli.lines.read_tsv(spark, p("skipped")).head().reason == "empty_candidates"
    cli.main(["shuffle-candidates", "--input", p("cands"), "--output", p("shuffled"), "--map-output", p("map"), "--seed", "3"])
    assert cli.lines.read_tsv(spark, p("map")).count() == 2
    (tmp_path / "ctx").write_text("doc_id\tmention\tstart_pos\tend_pos\tgold_geneid\tcontext\nd1\tabc 1\t0\t5\t20\tall of it\n")
    cli.main(["attach-contexts", "--candidates", p("m"), "--contexts", p("ctx"), "--output", p("attached")])
    assert {r.context_context for r in cli.lines.read_tsv(spark, p("attached")).collect()} == {"all of it", ""}
    (tmp_path / "cases").write_text("case_id\tgold_geneid\tcandidates\nc1\t20\t10::9606::human::ABC1|20::10090::mouse::ABC1\nc2\t10\t\n")
    (tmp_path / "said").write_text("case_id\tanswer\nc1\tAnswer: B\n")
    cli.main(["evaluate", "--candidates", p("cases"), "--predictions", p("said")])
    assert "0.5" in capsys.readouterr().out
    cli.main(["dense", "--mentions", p("m"), "--gene-info", p("info"), "--output", p("dense"), "--k", "2"])
    assert all(r.candidates.count("::") == 6 for r in cli.lines.read_tsv(spark, p("dense")).collect())
    (tmp_path / "jsonl").write_text('{"case_id": "c1", "prompt": "x"}\n')
    for more in ([], ["--scorer", "spanforge.operators.models:stub_scorer"]):
        cli.main(["infer", "--input", p("jsonl"), "--output", p("inferred"), *more])
        assert cli.lines.read_tsv(spark, p("inferred")).head().case_id == "c1"
    cli.main(["evaluate-letters", "--gold", p("cases"), "--predictions", p("said"), "--label", "run", "--summary-output", p("summary")])
    row = cli.lines.read_tsv(spark, p("summary")).head()
    assert (row.label, row.prompts, row.missing, row.correct) == ("run", "2", "1", "1")
    (tmp_path / "turned").write_text("case_id\tgold_geneid\tcandidates\nc1\t20\t20::10090::mouse::ABC1|10::9606::human::ABC1\nc2\t10\t\n")
    cli.main(["analyze-order", "--original", p("cases"), "--original-predictions", p("said"), "--shuffled", p("turned"), "--shuffled-predictions", p("said"), "--summary-output", p("order")])
    assert cli.lines.read_tsv(spark, p("order")).head().repeated_letter == "1"


def test_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    p = lambda n: str(tmp_path / n)
    passages = [{"kind": "title", "text": ["A b."], "offsets": [[0, 4]]}, {"kind": "abstract", "text": ["TP53 rose. It fell."], "offsets": [[5, 24]]}]
    entities = [{"kind": "Gene", "text": ["TP53"], "offsets": [[5, 9]], "normalized": [{"db_name": "NCBIGene", "db_id": "7"}]}]
    table = pa.table({"document_id": [f"d{i}" for i in range(20)], "passages": [passages] * 20, "entities": [entities] * 20})
    with pa.OSFile(p("docs.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    cli.main(["split", "--input", p("docs.arrow"), "--train-output", p("train"), "--dev-output", p("dev"), "--held-out-percent", "50"])
    train, dev = (cli.lines.read_tsv(spark, p(n)) for n in ("train", "dev"))
    assert train.count() + dev.count() == 20 and 0 < dev.count() < 20 and train.join(dev, "doc_id").count() == 0
    (tmp_path / "m").write_text("doc_id\tmention\tstart_pos\tend_pos\nd1\tTP53\t5\t9\nzz\tTP53\t5\t9\n")
    cli.main(["contexts", "--mentions", p("m"), "--input", p("docs.arrow"), "--output", p("ctx")])
    got = {r.doc_id: r for r in cli.lines.read_tsv(spark, p("ctx")).collect()}
    assert (got["d1"].ctx_sentence, got["d1"].ctx_abstract, got["zz"].ctx_document) == ("TP53 rose.", "A b. TP53 rose. It fell.", "")
    (tmp_path / "found").write_text("d1\t5\t9\tTP53\tGene\tNCBIGene:7\nd2\t5\t9\tTP53\tGene\tnone\n")
    cli.main(["evaluate-spans", "--gold", p("docs.arrow"), "--predictions", p("found"), "--summary-output", p("spans")])
    row = cli.lines.read_tsv(spark, p("spans")).head()
    assert (row.n_gold, row.recognised, row.correct) == ("20", "1", "1")
