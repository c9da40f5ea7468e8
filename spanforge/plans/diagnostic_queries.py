"""Queries of the diagnostics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions.candidates import gold_set
from spanforge.functions.text import article_id, species_of_context, window_context
from spanforge.operators import contexts, diagnostics, evaluation, ordering
from spanforge.plans import linking_queries as q
from spanforge.plans.linking_sql import ARTICLE, CANDS, FOCUS, GOLD, LINES, LISTS, NAMED_SPECIES, SPANS, TEXTS, _alnum, _gold
from spanforge.session import table


def _genes(spark, d):
    return table(spark, d, q.ENTITIES).where("gene_id IS NOT NULL")


def _judged(spark, d):
    """mention, gold, right (the first candidate is gold), oracle (the list holds a gold gene), nearest candidate first."""
    rows = q._lists(spark, d).where("mention IS NOT NULL AND size(gold) > 0")
    ids = F.transform("candidates", lambda c: c["gene_id"])
    no = F.lit(False)
    return rows.select("row_id", "mention", "gold", F.coalesce(F.array_contains("gold", F.get(ids, F.lit(0))), no).alias("right"), F.coalesce(F.arrays_overlap(ids, "gold"), no).alias("oracle"))


def error_kinds(spark, d):
    """Kinds of the wrong answers."""
    kind = diagnostics.error_kind(F.col("gold"), F.col("mention"))
    return _judged(spark, d).where("NOT right").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def family_words(spark, d):
    rows = table(spark, d, q.MENTIONS).where("mention IS NOT NULL")
    return rows.groupBy(diagnostics.names_family(F.col("mention")).alias("names_family")).agg(F.count(F.lit(1)).alias("n"))


def trigger_mentions(spark, d):
    return diagnostics.trigger_report(_judged(spark, d))


def missed_gold(spark, d):
    return diagnostics.missing_spans(q._gold_spans(spark, d), q._predicted_spans(spark, d), q.SPAN).select(*q.SPAN)


def oracle_wrong(spark, d):
    """Mentions whose list holds a gold gene that the first candidate isn't."""
    rows = q._lists(spark, d).where("candidates IS NOT NULL")
    ids = F.transform("candidates", lambda c: c["gene_id"])
    return rows.where(F.arrays_overlap(ids, "gold") & ~F.array_contains("gold", F.get(ids, F.lit(0)))).select("row_id")


def enriched_candidates(spark, d):
    genes = _genes(spark, d).groupBy("gene_id").agg(F.min("species").alias("gene_species"), F.min("term").alias("gene_term"))
    return diagnostics.enriched(q._candidates(spark, d).select("row_id", "pos", "gene_id"), genes, ["gene_species", "gene_term"])


def gold_species(spark, d):
    rows = table(spark, d, q.MENTIONS).select(F.col("row_id").alias("id"), gold_set(F.col("gold_geneid")).alias("gold"))
    return diagnostics.gold_taxa(rows, q._lines(spark, d)).select("id", F.array_join("taxa", "|").alias("taxa"))


def united_lookup(spark, d):
    """The most frequent gene of each lower-case term over the lines and the entities together."""
    a = q._lines(spark, d).select(F.lower("term").alias("term"), "gene_id", "ord")
    b = _genes(spark, d).where("term IS NOT NULL").select(F.lower("term").alias("term"), "gene_id", (F.col("entity_id") + 1_000_000_000).alias("ord"))
    return ordering.mode_per_key(a.unionByName(b), ["term"], "gene_id", "ord")


def soft_overrides(spark, d):
    top = q._candidates(spark, d, 1).select("row_id", "gene_id")
    keys = (article_id(F.col("doc_id")).alias("doc"), "mention", "gold_geneid")
    rows = table(spark, d, q.MENTIONS).where("doc_id IS NOT NULL AND mention IS NOT NULL AND gold_geneid IS NOT NULL").select("row_id", *keys)
    base = rows.join(top, "row_id", "left").withColumn("gene_id", F.coalesce("gene_id", F.lit("0")))
    better = table(spark, d, q.CONTEXTS).where("gold_geneid IS NOT NULL").select(*keys, F.col("gold_geneid").alias("gene_id"))
    return diagnostics.soft_override(base, better, ["doc", "mention", "gold_geneid"], "gene_id").select("row_id", "gene_id")


def entity_cells(spark, d):
    """Mentions found as a whole cell of the entity table, in any of three columns."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("cell_no"), F.col(c).alias("cell")) for i, c in enumerate(("term", "entity_text", "gene_id")))))
    made = table(spark, d, q.ENTITIES).select(F.lit("entities").alias("file"), F.col("entity_id").alias("line"), cells.alias("c")).select("file", "line", "c.*").where("cell IS NOT NULL")
    mentions = table(spark, d, q.MENTIONS).where("mention IS NOT NULL").select("mention")
    return diagnostics.cell_matches(mentions, made).select("mention", "line", "cell_no", "hit")


def best_scored(spark, d):
    """The best candidate of each mention by its vote: priority, then count, then identifier, compared one by one."""
    rows = q._candidates(spark, d).select("row_id", (-F.col("pos")).alias("score"), "gene_id", "tax_id")
    return ordering.best_per_key(rows, ["row_id"], "score", "gene_id")


def pair_weight(spark, d):
    return diagnostics.class_weight(q.training_examples(spark, d))


def species_bonuses(spark, d):
    """Bonus of each candidate for the species of the document, and for the one named in the context."""
    known = q._with_focus(spark, d).select("row_id", "focus_tax", species_of_context(F.col("context")).alias("named"))
    bonus = diagnostics.species_bonus(F.col("tax_id"), F.col("focus_tax"), F.coalesce("named", F.lit("")))
    return q._candidates(spark, d).join(known, "row_id").select("row_id", "pos", F.round(bonus, 6).alias("bonus"))


def mention_groups(spark, d):
    """Rows collected per article and mention, in order."""
    rows = table(spark, d, q.MENTIONS).where("mention IS NOT NULL").select(article_id(F.col("doc_id")).alias("doc"), "mention", "row_id").where("doc IS NOT NULL")
    return rows.groupBy("doc", "mention").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row_id")), lambda x: x.cast("string")), ",").alias("rows"))


def family_genes(spark, d):
    """Genes of the families that mentions and the terms of the knowledge base name."""
    genes = lambda rows: rows.select("source", "id", diagnostics.family_candidates(F.col("name")).alias("genes")).where(F.size("genes") > 0)
    mentions = table(spark, d, q.MENTIONS).select(F.lit("mention").alias("source"), F.col("row_id").alias("id"), F.col("mention").alias("name"))
    terms = q._lines(spark, d).select(F.lit("term").alias("source"), F.col("ord").alias("id"), F.col("term").alias("name"))
    return genes(mentions.unionByName(terms)).select("source", "id", F.array_join("genes", "|").alias("genes"))


def pair_examples(spark, d):
    """Pairwise examples: mention, candidate, features and label, with the offsets in the key."""
    rows = q._lists(spark, d).where("candidates IS NOT NULL AND context IS NOT NULL").select("row_id", "mention", "context", "gold", F.posexplode("candidates").alias("pos", "c"))
    f = evaluation.lexical_features(F.col("mention"), F.array("c.term"), F.col("context"))
    return rows.select("row_id", "pos", "c.gene_id", f["exact"].alias("exact"), f["appears"].alias("appears"), F.array_contains("gold", F.col("c.gene_id")).cast("int").alias("label"))


def direct_cases(spark, d):
    """Ordinals among the gene mentions, in order of record and entity, with their window."""
    rows = contexts.gold_mentions(q.all_records(spark, d), True)
    order = F.col("rec_id") * 1_000_000 + F.col("ent_no")
    text = q.all_records(spark, d).select("rec_id", contexts.joined_text(F.col("passages")).alias("text"))
    made = ordering.numbered(rows.withColumn("o", order), "o").join(text, "rec_id")
    window = window_context(F.col("text"), F.col("start_pos"), F.col("end_pos"), 40)
    return made.select(F.concat(F.lit("direct_case_"), F.col("ordinal").cast("string")).alias("case_id"), "mention", window.alias("context"))


QUERIES = {f.__name__: f for f in (
    error_kinds, family_words, trigger_mentions, missed_gold, oracle_wrong, enriched_candidates, gold_species, united_lookup, soft_overrides, entity_cells, best_scored, pair_weight, species_bonuses,
    mention_groups, family_genes, pair_examples, direct_cases,
)}

_FAMILY = f"(length(mention) > 2 AND regexp_matches(lower(mention), '{'|'.join(diagnostics.FAMILY_WORDS)}'))"
_JUDGED = f"""WITH {LISTS}, judged AS (SELECT row_id, mention, gold, coalesce(list_contains(gold, ids[1]), false) AS "right", coalesce(list_has_any(ids, gold), false) AS oracle
  FROM lists WHERE mention IS NOT NULL AND len(gold) > 0)"""
_FAMILIES = {"is": {f: f for f in diagnostics.FAMILY_GENES}, "holds": diagnostics.FAMILY_PARTS, "begins": {f: f for f in diagnostics.FAMILY_STARTS}}
_RULES = " UNION ALL ".join(
    f"SELECT '{how}' AS how, '{part}' AS part, string_split('{diagnostics.FAMILY_GENES[name]}', ' ') AS genes" for how, rules in _FAMILIES.items() for part, name in rules.items()
)
SQL = {
    "error_kinds": f"""{_JUDGED} SELECT CASE WHEN len(gold) > 1 THEN 'multi_gold' WHEN upper(mention) IN {diagnostics.FAMILY_MENTIONS} THEN 'family' ELSE 'other' END AS kind, count(*) AS n FROM judged WHERE NOT "right" GROUP BY kind""",
    "family_words": f"SELECT {_FAMILY} AS names_family, count(*) AS n FROM bioelqa_dev_mentions WHERE mention IS NOT NULL GROUP BY ALL",
    "trigger_mentions": f"""{_JUDGED}, t AS (SELECT *, mention IN {diagnostics.TRIGGER_MENTIONS} AS t, oracle AND NOT "right" AS wrong FROM judged)
SELECT count(*) AS total, count(*) FILTER (t) AS trigger_total, count(*) FILTER (t AND "right") AS trigger_correct, count(*) FILTER (t AND wrong) AS trigger_wrong_oracle,
  count(*) FILTER (NOT t) AS other_total, count(*) FILTER (NOT t AND wrong) AS other_wrong_oracle FROM t""",
    "missed_gold": f"WITH {SPANS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos FROM gspan g ANTI JOIN pspan p USING (doc_id, start_pos, end_pos)",
    "oracle_wrong": f"""WITH {CANDS}, l AS (SELECT row_id, list(gene_id ORDER BY pos) AS ids FROM cands GROUP BY row_id)
SELECT row_id FROM l JOIN bioelqa_dev_mentions m USING (row_id) WHERE list_has_any(ids, {_gold('gold_geneid')}) AND NOT list_contains({_gold('gold_geneid')}, ids[1])""",
    "enriched_candidates": f"""WITH {CANDS}, g AS (SELECT gene_id, min(species) AS s, min(term) AS t FROM bioelqa_dev_candidates_sapbert_genelevel_top20 WHERE gene_id IS NOT NULL GROUP BY gene_id)
SELECT c.gene_id, row_id, CAST(pos AS INTEGER) AS pos, coalesce(s, 'UNKNOWN') AS gene_species, coalesce(t, 'UNKNOWN') AS gene_term FROM cands c LEFT JOIN g USING (gene_id)""",
    "gold_species": f"""WITH {LINES}, r AS (SELECT row_id AS id, unnest({_gold('gold_geneid')}) AS gene_id FROM bioelqa_dev_mentions), t AS (SELECT DISTINCT gene_id, tax_id FROM lines)
SELECT id, string_agg(DISTINCT tax_id, '|' ORDER BY tax_id) AS taxa FROM r JOIN t USING (gene_id) GROUP BY id""",
    "united_lookup": f"""WITH {LINES}, u AS (SELECT lower(term) AS term, gene_id, ord FROM lines UNION ALL SELECT lower(term), gene_id, entity_id + 1000000000 FROM bioelqa_dev_candidates_sapbert_genelevel_top20 WHERE term IS NOT NULL AND gene_id IS NOT NULL),
c AS (SELECT term, gene_id, count(*) AS n, min(ord) AS s FROM u GROUP BY ALL) SELECT term, gene_id, n AS n_count FROM c QUALIFY row_number() OVER (PARTITION BY term ORDER BY n DESC, s) = 1""",
    "soft_overrides": f"""WITH {CANDS}, r AS (SELECT row_id, {ARTICLE.format('doc_id')} AS doc, mention, gold_geneid FROM bioelqa_dev_mentions WHERE doc_id IS NOT NULL AND mention IS NOT NULL AND gold_geneid IS NOT NULL),
b AS (SELECT DISTINCT {ARTICLE.format('doc_id')} AS doc, mention, gold_geneid FROM bioelqa_dev_mentions_contexts WHERE gold_geneid IS NOT NULL)
SELECT r.row_id, CASE WHEN b.mention IS NOT NULL THEN r.gold_geneid ELSE coalesce(c.gene_id, '0') END AS gene_id
FROM r LEFT JOIN b ON r.doc = b.doc AND r.mention = b.mention AND r.gold_geneid = b.gold_geneid LEFT JOIN (SELECT row_id, gene_id FROM cands WHERE pos = 1) c ON c.row_id = r.row_id""",
    "entity_cells": f"""WITH c AS (SELECT entity_id AS line, unnest([0, 1, 2]) AS cell_no, unnest([term, entity_text, gene_id]) AS cell FROM bioelqa_dev_candidates_sapbert_genelevel_top20),
m AS (SELECT DISTINCT mention, {_alnum('mention')} AS key FROM bioelqa_dev_mentions WHERE mention IS NOT NULL)
SELECT mention, line, CAST(cell_no AS INTEGER) AS cell_no, CAST(row_number() OVER (PARTITION BY mention ORDER BY line, cell_no) AS INTEGER) AS hit FROM m JOIN c ON key = {_alnum('cell')} WHERE key <> '' QUALIFY hit <= 5""",
    "best_scored": f"WITH {CANDS} SELECT row_id, CAST(-pos AS INTEGER) AS score, gene_id, tax_id FROM cands WHERE pos = 1",
    "pair_weight": f"SELECT round(count(*) FILTER (label = 0)::DOUBLE / nullif(count(*) FILTER (label = 1), 0), 6) AS weight FROM ({q.SQL['training_examples']})",
    "direct_cases": f"""WITH g AS ({GOLD}), t AS ({TEXTS}), n AS (SELECT *, row_number() OVER (ORDER BY rec_id, ent_no) AS k FROM g)
SELECT 'direct_case_' || k AS case_id, mention, replace(substring(joined, greatest(start_pos - 40, 0) + 1, greatest(least(end_pos + 40, length(joined)) - greatest(start_pos - 40, 0), 0)), chr(10), ' ') AS context
FROM n LEFT JOIN t USING (rec_id)""",
    "species_bonuses": f"""WITH {CANDS}, {FOCUS} SELECT c.row_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN tax_id = focus_tax THEN 0.8::DOUBLE ELSE 0 END
  + CASE WHEN tax_id = {NAMED_SPECIES} THEN 1.0::DOUBLE ELSE 0 END, 6) AS bonus FROM cands c JOIN with_focus USING (row_id)""",
    "mention_groups": f"SELECT doc, mention, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS rows FROM (SELECT {ARTICLE.format('doc_id')} AS doc, mention, row_id FROM bioelqa_dev_mentions WHERE mention IS NOT NULL) WHERE doc IS NOT NULL GROUP BY ALL",
    "family_genes": f"""WITH {LINES}, named AS (SELECT 'mention' AS source, row_id AS id, mention AS name FROM bioelqa_dev_mentions UNION ALL SELECT 'term', ord, term FROM lines),
keyed AS (SELECT source, id, {_alnum('name')} AS k FROM named), met AS (SELECT k.source, k.id, unnest(r.genes) AS gene FROM keyed k JOIN ({_RULES}) r
  ON (r.how = 'is' AND k = r.part) OR (r.how = 'holds' AND contains(k, r.part)) OR (r.how = 'begins' AND starts_with(k, r.part)))
SELECT source, id, string_agg(DISTINCT gene, '|' ORDER BY gene) AS genes FROM met GROUP BY ALL""",
    "pair_examples": f"""WITH {CANDS}, m AS (SELECT row_id, {_alnum('mention')} AS low, {_alnum('context')} AS ctx, {_gold('gold_geneid')} AS gold FROM bioelqa_dev_mentions WHERE context IS NOT NULL)
SELECT row_id, CAST(pos - 1 AS INTEGER) AS pos, gene_id, length({_alnum('term')}) >= 2 AND {_alnum('term')} = low AS exact, length({_alnum('term')}) >= 2 AND contains(ctx, {_alnum('term')}) AS appears, CAST(list_contains(gold, gene_id) AS INTEGER) AS label
FROM cands JOIN m USING (row_id)""",
}
