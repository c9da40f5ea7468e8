"""Relations that must hold between results, whatever the data."""

import pytest
from pyspark.sql import functions as F

from spanforge.operators import evaluation
from spanforge.plans import diagnostic_queries as g
from spanforge.plans import linking_queries as q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lists(spark):
    return q._lists(spark, SF).where(F.size("gold") > 0).select("gold", F.transform("candidates", lambda c: c["gene_id"]).alias("ids")).cache()


def test_recall_grows_with_k_and_ignores_order(spark, lists):
    r = evaluation.recall_at(lists, (1, 2, 5, 10)).head()
    assert r.recall_1 <= r.recall_2 <= r.recall_5 <= r.recall_10
    turned = evaluation.recall_at(lists.withColumn("ids", F.reverse("ids")), (10,)).head()
    assert turned.recall_10 == r.recall_10


def test_top_lists_are_prefixes(spark):
    a = {(r.row_id, r.pos): r.gene_id for r in q._candidates(spark, SF, 3).collect()}
    b = {(r.row_id, r.pos): r.gene_id for r in q._candidates(spark, SF, 10).collect()}
    assert a == {k: v for k, v in b.items() if k[1] <= 3}
    genes = {}
    for (row, _), gene in b.items():
        assert gene not in genes.setdefault(row, set())
        genes[row].add(gene)


def test_selector_counts_are_nested(spark):
    r = q.selector_scores(spark, SF).head()
    assert r.correct <= r.gold_in_list <= r.n and r.invalid <= r.answered <= r.n
    assert abs(r.recall * r.selector_accuracy - r.final_accuracy) < 1e-5


def test_stages_add_up(spark):
    stages = {r.stage: r.n for r in q.error_stages(spark, SF).collect()}
    spans = q.span_accuracy(spark, SF).head()
    assert sum(stages.values()) == spans.n_gold and stages["correct"] == spans.correct
    assert stages["recognition_miss"] == g.missed_gold(spark, SF).count()
    scores = q.span_scores(spark, SF).head()
    assert scores.tp + scores.fn == spans.n_gold and scores.tp == spans.recognised


def test_position_map_is_a_permutation(spark):
    rows = q.position_map(spark, SF).groupBy("row_id").agg(F.array_sort(F.collect_list("new_pos")).alias("a"), F.array_sort(F.collect_list("old_pos")).alias("b"))
    assert rows.where(F.col("a") != F.col("b")).count() == 0


def test_every_positive_has_its_negatives(spark):
    made = q.training_examples(spark, SF).groupBy("id", "gold_id").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"), F.countDistinct("gene_id").alias("g"))
    assert made.count() > 0 and made.where("p <> 1 OR n <> 3 OR g <> 4").count() == 0


def test_splits_share_no_document(spark):
    parts = q.document_split(spark, SF)
    assert parts.groupBy("doc").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_merged_spans_hold_the_mention(spark):
    spans = q.token_spans(spark, SF)
    rows = q.table(spark, SF, q.MENTIONS).select("row_id", "start_pos", "end_pos")
    outside = spans.join(rows, "row_id").where("span_start >= end_pos OR span_end <= start_pos")
    assert outside.count() == 0


@pytest.mark.parametrize("numbers", [(1517, 2518, 60.25), (1488, 2014, 73.88), (1488, 3360, 44.29), (1488, 1953, 76.19)])
def test_published_arithmetic(spark, numbers):
    a, b, percent = numbers
    got = spark.range(1).select(evaluation.rate(F.lit(a), F.lit(b)).alias("r")).head().r
    assert round(got * 100, 2) == percent
