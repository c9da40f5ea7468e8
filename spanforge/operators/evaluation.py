"""Metrics and diagnostics. Each is one aggregation over one join; a rate without cases is 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.candidates import candidate_at, first_index
from spanforge.functions.text import alnum_key


def rate(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def recall_at(rows: DataFrame, ks: Sequence[int]) -> DataFrame:
    """rows: gold (array), ids (ranked array, may be null). One row: n, no_candidate, and recall for each k."""
    hit = lambda k: F.coalesce(F.arrays_overlap(F.slice("ids", 1, k), "gold"), F.lit(False))
    n = F.count(F.lit(1))
    none = F.count_if(F.coalesce(F.size("ids"), F.lit(0)) <= 0)
    return rows.agg(n.alias("n"), none.alias("no_candidate"), *(rate(F.count_if(hit(k)), n).alias(f"recall_{k}") for k in ks))


def selector_metrics(rows: DataFrame) -> DataFrame:
    """rows: gold (array), candidates (array of structs), letter, and perhaps prompted. Missing, invalid and wrong letters
    are told apart; an answer is missing where a prompt was written, which is where there are candidates if not said."""
    ids = F.transform("candidates", lambda c: c["gene_id"])
    picked = candidate_at(F.col("candidates"), F.col("letter"))["gene_id"]
    has = F.coalesce(F.size("candidates"), F.lit(0)) > 0
    inside = F.coalesce(F.arrays_overlap(ids, F.col("gold")), F.lit(False))
    right = F.coalesce(F.array_contains("gold", picked), F.lit(False))
    prompted = F.col("prompted") if "prompted" in rows.columns else has
    made = rows.select(has.alias("has"), prompted.alias("prompted"), inside.alias("inside"), right.alias("right"), picked.isNotNull().alias("valid"), F.col("letter").isNotNull().alias("answered"))
    n = F.count(F.lit(1))
    counts = made.agg(
        n.alias("n"), F.count_if(~F.col("has")).alias("no_candidate"), F.count_if("prompted").alias("prompts"), F.count_if("answered").alias("answered"),
        F.count_if(F.col("prompted") & ~F.col("answered")).alias("missing"),
        F.count_if(F.col("answered") & ~F.col("valid")).alias("invalid"), F.count_if("inside").alias("gold_in_list"), F.count_if("right").alias("correct"),
    )
    c = F.col
    return counts.select("*", rate(c("gold_in_list"), c("n")).alias("recall"), rate(c("correct"), c("gold_in_list")).alias("selector_accuracy"), rate(c("correct"), c("n")).alias("final_accuracy"))


def span_metrics(gold: DataFrame, predicted: DataFrame, span: list[str]) -> DataFrame:
    """gold: span and gold (array); predicted: span and gene_id; both unique by span. Accuracy over all gold spans and
    over the recognised ones."""
    met = gold.join(predicted.select(*span, "gene_id", F.lit(True).alias("seen")), span, "left")
    right = F.coalesce(F.array_contains("gold", F.col("gene_id")), F.lit(False))
    counts = met.agg(F.count(F.lit(1)).alias("n_gold"), F.count("seen").alias("recognised"), F.count_if(right).alias("correct"))
    c = F.col
    return counts.select(
        "*", rate(c("correct"), c("n_gold")).alias("accuracy_all"), rate(c("correct"), c("recognised")).alias("accuracy_recognised"),
        rate(c("recognised"), c("n_gold")).alias("recognition_rate"),
    )


def tuple_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 of two sets of equal tuples: one grouping of the tagged union instead of three joins."""
    tagged = gold.withColumn("_g", F.lit(1)).withColumn("_p", F.lit(0)).unionByName(predicted.withColumn("_g", F.lit(0)).withColumn("_p", F.lit(1)))
    sides = tagged.groupBy(*gold.columns).agg(F.max("_g").alias("g"), F.max("_p").alias("p"))
    counts = sides.agg(
        F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.col("p") * (1 - F.col("g"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.col("g") * (1 - F.col("p"))), F.lit(0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def overlap_class(gold: DataFrame, predicted: DataFrame, doc: str) -> DataFrame:
    """Each gold span (doc, start_pos, end_pos) as exact, partial or miss against the predicted spans of its document,
    with the first overlapping one. An equi-join on the document with a range condition; a document's spans are few."""
    g = gold.select(doc, "start_pos", "end_pos").distinct()
    p = predicted.select(F.col(doc).alias("p_doc"), F.col("start_pos").alias("p_start"), F.col("end_pos").alias("p_end")).distinct()
    meets = (g[doc] == p["p_doc"]) & (g["start_pos"] < p["p_end"]) & (p["p_start"] < g["end_pos"])
    met = g.join(p, meets, "left")
    exact = (F.col("start_pos") == F.col("p_start")) & (F.col("end_pos") == F.col("p_end"))
    best = met.groupBy(doc, "start_pos", "end_pos").agg(F.max(exact).alias("exact"), F.min(F.when(F.col("p_start").isNotNull(), F.struct("p_start", "p_end"))).alias("first"))
    kind = F.when(F.col("exact"), "exact").when(F.col("first").isNotNull(), "partial").otherwise("miss")
    return best.select(doc, "start_pos", "end_pos", kind.alias("overlap"), "first.p_start", "first.p_end")


def order_stability(original: DataFrame, shuffled: DataFrame, key: str) -> DataFrame:
    """Both: key, ids (array), letter. The runs must have the same keys and the same candidates, else an error."""
    a = original.select(key, F.col("ids").alias("ids_a"), F.col("letter").alias("letter_a"), F.lit(True).alias("in_a"))
    b = shuffled.select(key, F.col("ids").alias("ids_b"), F.col("letter").alias("letter_b"), F.lit(True).alias("in_b"))
    same = F.coalesce(F.col("in_a") & F.col("in_b") & (F.array_sort("ids_a") == F.array_sort("ids_b")), F.lit(False))
    pick = lambda ids, letter: F.get(F.col(ids), F.ascii(F.col(letter)) - 65)
    met = a.join(b, key, "full").select("*", same.alias("same"), pick("ids_a", "letter_a").alias("id_a"), pick("ids_b", "letter_b").alias("id_b"))
    both = F.col("id_a").isNotNull() & F.col("id_b").isNotNull()
    moved = first_index(F.col("ids_a"), F.col("id_a")) != first_index(F.col("ids_b"), F.col("id_a"))
    same_id, same_letter = F.col("id_a") == F.col("id_b"), F.col("letter_a") == F.col("letter_b")
    count = lambda condition: F.count_if(both & condition)
    # The check is a count like the others: a filter that raises could be moved or dropped by the optimizer.
    counts = met.agg(
        F.count_if(~F.col("same")).alias("differing"), F.count_if(both).alias("comparable"), count(same_id).alias("same_id"), count(same_letter).alias("same_letter"),
        count(moved).alias("moved"), count(moved & same_id).alias("followed_id"), count(moved & same_letter).alias("repeated_letter"),
    )
    c = F.col
    checked = F.when(c("differing") > 0, F.raise_error(F.lit("the runs differ in cases or candidates"))).otherwise(c("comparable"))
    rest = ("same_id", "same_letter", "moved", "followed_id", "repeated_letter")
    rates = (rate(c("same_id"), c("comparable")).alias("same_id_rate"), rate(c("followed_id"), c("moved")).alias("followed_rate"))
    return counts.select(checked.alias("comparable"), *rest, *rates)


def gain_hurt(rows: DataFrame, base: Column, new: Column) -> DataFrame:
    """Cases that only the new run, or only the base run, has right."""
    b, n = F.coalesce(base, F.lit(False)), F.coalesce(new, F.lit(False))
    return rows.agg(F.count_if(~b & n).alias("gain"), F.count_if(b & ~n).alias("hurt"), (F.count_if(~b & n) - F.count_if(b & ~n)).alias("net"))


def dominant_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key its rows, most frequent value (ties to the smaller), that value's share, and all counts as a string."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))))
    out = counts.groupBy(key).agg(F.sum("n").alias("freq"), listed.alias("l"))
    top = F.get("l", F.lit(0))
    histogram = F.array_join(F.transform("l", lambda s: F.concat_ws(":", s["v"], (-s["m"]).cast("string"))), ";")
    return out.select(key, "freq", top["v"].alias("top_value"), (-top["m"]).alias("top_count"), rate(-top["m"], F.col("freq")).alias("ratio"), histogram.alias("histogram"))


def reliable(dominant: DataFrame, least: int = 2, ratio: float = 0.8) -> DataFrame:
    return dominant.where((F.col("freq") >= least) & (F.col("ratio") >= ratio))


def seen_split(test: DataFrame, train: DataFrame, gold: str) -> DataFrame:
    """test (id, ...) with ``seen``: whether any gold identifier occurs in train."""
    known = train.select(F.explode(gold).alias("g")).distinct()
    hits = test.select("id", F.explode(gold).alias("g")).join(known, "g", "left_semi").select("id").distinct().withColumn("seen", F.lit(True))
    return test.join(hits, "id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def _term_hits(mention: Column, terms: Column, context: Column) -> Column:
    """Per usable term: the term, and whether it is the mention, stands in the context, or shares a part with it. All
    are compared by their letters and digits, Greek letters spelled out."""
    m, c = alnum_key(mention), alnum_key(context)
    keyed = F.filter(F.transform(terms, lambda t: F.struct(t.alias("term"), alnum_key(t).alias("key"))), lambda t: F.length(t["key"]) >= 2)
    hit = lambda t: F.struct(
        t["term"].alias("term"), (t["key"] == m).alias("exact"), c.contains(t["key"]).alias("inside"), (m.contains(t["key"]) | t["key"].contains(m)).alias("part"),
    )
    return F.transform(keyed, hit)


def lexical_features(mention: Column, terms: Column, context: Column) -> Column:
    """exact: a term is the mention; appears: a term stands in the context; overlap: up to ten that do either or share a
    part with the mention, sorted."""
    hits = _term_hits(mention, terms, context)
    found = F.array_sort(F.array_distinct(F.transform(F.filter(hits, lambda h: h["exact"] | h["inside"] | h["part"]), lambda h: h["term"])))
    return F.struct(F.exists(hits, lambda h: h["exact"]).alias("exact"), F.exists(hits, lambda h: h["inside"]).alias("appears"), F.slice(found, 1, 10).alias("overlap"))


def lexical_bonus(mention: Column, terms: Column, context: Column) -> Column:
    """For each term 1 if it is the mention, 0.6 if it stands in the context, 0.3 if it shares a part; at most 2."""
    worth = lambda flag, x: F.when(flag, F.lit(x)).otherwise(F.lit(0.0))
    added = F.aggregate(_term_hits(mention, terms, context), F.lit(0.0), lambda s, h: s + worth(h["exact"], 1.0) + worth(h["inside"], 0.6) + worth(h["part"], 0.3))
    return F.least(added, F.lit(2.0))


def training_examples(positive: DataFrame, pool: DataFrame, negatives: int, surface: str, order: str) -> DataFrame:
    """(id, gold_id, gene_id, label): each gold gene of each mention as a positive, with exactly ``negatives`` genes that
    aren't gold for the mention: first others of its surface in the given order, then genes in hash order.

    positive has id, surface and golds (array); pool has each gene of a surface once. A mention meets its surface as one
    list, cut to what can be needed. Filling walks the genes by md5 from a place given by id and gold gene, past as many
    as may be excluded, so it falls short only where the pool has too few genes.
    """
    need = positive.groupBy(surface).agg((F.max(F.size("golds")) + negatives).alias("_need"))
    window = Window.partitionBy(surface).orderBy(order, "gene_id")
    few = pool.join(need, surface).withColumn("_n", F.row_number().over(window)).where("_n <= _need")
    ranked = F.array_sort(F.collect_list(F.struct("_n", "gene_id")))
    lists = few.groupBy(surface).agg(F.transform(ranked, lambda s: s["gene_id"]).alias("others"))
    others = F.array_except(F.coalesce("others", F.array().cast("array<string>")), F.col("golds"))
    rows = positive.join(lists, surface, "left").select("id", "golds", F.slice(others, 1, negatives).alias("hard"), F.explode("golds").alias("gold_id"))
    label = lambda c, n: F.struct(c.alias("gene_id"), F.lit(n).alias("label"))
    sure = rows.select("id", "gold_id", F.inline(F.concat(F.array(label(F.col("gold_id"), 1)), F.transform("hard", lambda g: label(g, 0)))))
    genes = pool.select("gene_id").distinct().withColumn("_h", F.md5("gene_id"))
    n = genes.count()
    if not n:
        return sure
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), "gold_id")), 1, 8), 16, 10).cast("bigint")
    steps = F.sequence(F.lit(0), F.least(F.lit(n), F.size("golds") + negatives) - 1)
    short = rows.where(F.size("hard") < negatives).select("*", F.posexplode(F.transform(steps, lambda i: F.pmod(start + i, F.lit(n)))).alias("_k", "_at"))
    # Numbered by buckets of the hash (4,096 at most), not by partitions: those needn't be the same in two branches of a plan.
    placed = genes.withColumn("_b", F.substring("_h", 1, 3))
    sizes = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h"))
    numbers = placed.withColumn("_no", within).join(F.broadcast(before), "_b").select("gene_id", (F.col("_no") + F.col("_before") - 1).alias("_at"))
    met = short.join(numbers, "_at").where("NOT array_contains(golds, gene_id) AND NOT array_contains(hard, gene_id)")
    first = F.row_number().over(Window.partitionBy("id", "gold_id").orderBy("_k"))
    filled = met.withColumn("_f", first).where(F.col("_f") + F.size("hard") <= negatives).select("id", "gold_id", "gene_id", F.lit(0).alias("label"))
    return sure.unionByName(filled)


def hash_split(df: DataFrame, key: Column, seed: int = 42, held_out: int = 20, name: str = "dev") -> DataFrame:
    """df with a part per key, the same on any cluster: the md5 of seed and key puts ``held_out`` percent in ``name``."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("part", F.when(F.pmod(place, F.lit(100)) < held_out, name).otherwise("train"))


def accuracy_by(rows: DataFrame, stratum: str, right: Column) -> DataFrame:
    """Rows, right ones and accuracy of each stratum."""
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(right, F.lit(False))).alias("correct"))
    return counts.select("*", rate(F.col("correct"), F.col("n")).alias("accuracy"))


def overlap_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many distinct rows two sets share."""
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n_shared"))
