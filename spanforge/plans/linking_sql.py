"""SQL of the linking queries, for DuckDB over the same tables."""

from __future__ import annotations

from spanforge.functions.text import GREEK, SPECIES_NAMES, SPECIES_PRIORITY, SPECIES_WORDS, STOP_TERMS, SUFFIXES, SYMBOL_EDGE
from spanforge.operators.grounding import CASCADES
from spanforge.plans.nested_queries import _RAW, _parent


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _compact(x: str) -> str:
    return _strip(f"regexp_replace(lower({x}), '[-_ ]', '', 'g')")


def _case(x: str, pairs: dict, other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in pairs.items()) + f" ELSE {other} END"


def _gold(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(string_split(coalesce({x}, ''), '|'), lambda g: trim(g)), lambda g: g <> '')))"


_STOPPED = ", ".join(f"'{' '.join(t.replace('-', '').split())}'" for t in STOP_TERMS)
_SPECIES, _PRIORITY = _case("tax_id", SPECIES_NAMES, "'taxid:' || tax_id"), _case("tax_id", SPECIES_PRIORITY, "99")

LINES = f"""lines AS (SELECT * FROM (
  SELECT kb_id AS ord, {_strip('term')} AS term, {_strip('tax_id')} AS tax_id, {_strip('gene_id')} AS gene_id,
    coalesce(try_cast(trunc(try_cast(n_count AS DOUBLE)) AS INTEGER), 0) AS n_count
  FROM ncbi_symbol_synonym_taxid_kb) WHERE term <> '' AND term <> '-' AND tax_id <> '' AND gene_id <> '')"""


def _mode(keys: str, value: str, source: str, order: str) -> str:
    return f"""SELECT {keys}, {value}, n AS n_count FROM (
  SELECT {keys}, {value}, count(*) AS n, min({order}) AS s FROM {source} GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, s) = 1"""


_UP = "(SELECT upper(term) AS term, tax_id, gene_id, ord FROM lines)"
DICT = f"{LINES}, dict AS ({_mode('term, tax_id', 'gene_id', _UP, 'ord')})"
CANDS = f"""{DICT}, asked AS (SELECT row_id, {_compact('mention')} AS key FROM bioelqa_dev_mentions WHERE {_compact('mention')} <> ''),
keyed AS (SELECT {_compact('term')} AS key, *, {_PRIORITY} AS priority FROM dict),
genes AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key, gene_id ORDER BY priority, n_count DESC, term, tax_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority, n_count DESC, gene_id, term, tax_id) AS pos FROM genes),
cands AS (SELECT row_id, pos, gene_id, tax_id, {_SPECIES} AS species, term FROM asked JOIN ranked USING (key) WHERE pos <= 10)"""
LISTS = f"""{CANDS}, packed AS (
  SELECT row_id, list(gene_id ORDER BY pos) AS ids, list(species ORDER BY pos) AS sp, list(term ORDER BY pos) AS terms,
    string_agg(gene_id || '::' || tax_id || '::' || species || '::' || term, '|' ORDER BY pos) AS packed FROM cands GROUP BY row_id),
lists AS (SELECT m.row_id, case_id, mention, context, {_gold('gold_geneid')} AS gold, ids, packed FROM bioelqa_dev_mentions m LEFT JOIN packed USING (row_id))"""
_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"
DENSE = f"""q AS (SELECT row_id, {_UNIT} AS v FROM bioelqa_dev_mention_vectors WHERE embedding IS NOT NULL),
e AS (SELECT entity_id, gene_id, {_UNIT} AS v FROM bioelqa_dev_candidates_sapbert_genelevel_top20 WHERE embedding IS NOT NULL),
qn AS (SELECT row_id, v, sqrt(list_dot_product(v, v)) AS n FROM q WHERE list_dot_product(v, v) > 0),
en AS (SELECT entity_id, gene_id, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE list_dot_product(v, v) > 0),
dense AS (SELECT row_id AS query_id, entity_id, gene_id, round(list_dot_product(qn.v, en.v) / qn.n / en.n, 9) AS score FROM qn, en),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS pos FROM dense)"""


def _rate(a: str, b: str) -> str:
    return f"round(coalesce({a}::DOUBLE / nullif({b}, 0), 0.0), 6)"


def _greek(x: str) -> str:
    for letter, name in GREEK.items():
        x = f"replace({x}, '{letter}', '{name}')"
    return x


def _alnum(x: str) -> str:
    return f"trim(regexp_replace({_greek(f'lower({x})')}, '[^a-z0-9]+', '', 'g'))"


_NAMED = f"SELECT rec_id, document_id FROM nlm_gene_train UNION ALL SELECT rec_id, coalesce(json_extract_string(j, '$.document_id'), json_extract_string(j, '$.id')) FROM ({_RAW})"
#: Entities of both tables with their identifiers, read from JSON.
_ENTITIES = f"""SELECT x.rec_id, n.document_id AS doc_id, parent_no AS ent_no,
    CASE json_type(e, '$.text') WHEN 'VARCHAR' THEN json_extract_string(e, '$.text') ELSE json_extract_string(e, '$.text[0]') END AS mention,
    try_cast(json_extract_string(e, '$.offsets[0][0]') AS BIGINT) AS start_pos, try_cast(json_extract_string(e, '$.offsets[0][1]') AS BIGINT) AS end_pos,
    coalesce(json_extract_string(e, '$.kind'), json_extract_string(e, '$.type')) AS kind,
    list_transform(range(coalesce(json_array_length(e, '$.normalized'), 0)::BIGINT), lambda k: {{'k': k, 'db': json_extract_string(e, '$.normalized[' || k || '].db_name'),
      'id': coalesce(json_extract_string(e, '$.normalized[' || k || '].db_id'), json_extract_string(e, '$.normalized[' || k || '].id'))}}) AS ns
  FROM ({_parent('entities')}) x JOIN ({_NAMED}) n USING (rec_id)"""
_GOLD_ROWS = """SELECT * FROM (SELECT rec_id, doc_id, ent_no, mention, start_pos, end_pos, kind,
    array_to_string(list_sort(list_distinct(list_transform(list_filter(ns, lambda n: n.id <> '' {1}), lambda n: regexp_replace(n.id, '^(NCBI ?Gene:|GeneID:)', '')))), '|') AS gold_geneid
  FROM ({0})) WHERE start_pos IS NOT NULL AND gold_geneid <> ''"""
GOLD_ALL = _GOLD_ROWS.format(_ENTITIES, "")
GOLD = _GOLD_ROWS.format(_ENTITIES, "AND n.db = 'NCBIGene'") + " AND kind IN ('Gene', 'GENERIF', 'STARGENE')"
_BARE_ID = "lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
#: An article's id: eight digits whatever name, zeros, version or .0 stands around them; else the id without case and outer white space.
ARTICLE = (
    f"CASE WHEN regexp_matches({_BARE_ID}, '^((https?://)?[a-z0-9./]*pubmed[^a-z0-9]*|pmid[^a-z0-9]*|medline[^a-z0-9]*)?0*[1-9][0-9]{{{{7}}}}(\\.[0-9]+|v[0-9]+)?$') "
    f"THEN regexp_extract({_BARE_ID}, '([1-9][0-9]{{{{7}}}})(\\.[0-9]+|v[0-9]+)?$', 1) ELSE nullif({_BARE_ID}, '') END"
)
#: rec_id, title, abstract, joined of the records that have passages.
_TEXTS_OF = f"""p AS (SELECT rec_id, parent_no AS i, lower(coalesce(json_extract_string(e, '$.kind'), json_extract_string(e, '$.type'))) AS kind,
  CASE json_type(e, '$.text') WHEN 'VARCHAR' THEN [json_extract_string(e, '$.text')] WHEN 'ARRAY' THEN CAST(json_extract(e, '$.text') AS VARCHAR[]) END AS ts FROM ({_parent('passages')})),
r AS (SELECT rec_id FROM nlm_gene_train WHERE passages IS NOT NULL UNION ALL SELECT rec_id FROM ({_RAW}) WHERE json_type(j, '$.passages') = 'ARRAY')"""
TEXTS = f"""WITH {_TEXTS_OF}
SELECT r.rec_id, {_strip("coalesce(string_agg(array_to_string(ts, ' '), ' ' ORDER BY i) FILTER (kind = 'title' AND ts IS NOT NULL), '')")} AS title,
  {_strip("coalesce(string_agg(array_to_string(ts, ' '), ' ' ORDER BY i) FILTER (kind = 'abstract' AND ts IS NOT NULL), '')")} AS abstract,
  array_to_string(flatten(coalesce(list(ts ORDER BY i) FILTER (ts IS NOT NULL), [])), ' ') AS joined
FROM r LEFT JOIN p USING (rec_id) GROUP BY r.rec_id"""
FOCUS = f"""tax AS (SELECT {ARTICLE.format('doc_id')} AS doc, n.id AS tax, rec_id * 1000000 + ent_no * 1000 + n.k AS ord FROM (SELECT *, unnest(ns) AS n FROM ({_ENTITIES})) WHERE n.db = 'Taxonomy' AND trim(n.id) <> ''),
focus AS (SELECT doc, tax FROM (SELECT doc, tax, count(*) AS n, min(ord) AS s FROM tax WHERE doc IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, s) = 1),
with_focus AS (SELECT row_id, mention, context, coalesce(tax, '9606') AS focus_tax, coalesce(tax, '') AS known_tax FROM (SELECT *, {ARTICLE.format('doc_id')} AS doc FROM bioelqa_dev_mentions) LEFT JOIN focus USING (doc))"""
NAMED_SPECIES = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(context), '{w}')" for w in words)} THEN '{t}'" for t, words in SPECIES_WORDS.items()) + " END"


SPANS = f"""{CANDS}, gold AS ({GOLD}),
gspan AS (SELECT {ARTICLE.format('doc_id')} AS doc_id, start_pos, end_pos, string_split(gold_geneid, '|') AS gold FROM gold QUALIFY row_number() OVER (PARTITION BY {ARTICLE.format('doc_id')}, start_pos, end_pos ORDER BY rec_id DESC, ent_no DESC) = 1),
pspan AS (SELECT doc_id, start_pos, end_pos, gene_id FROM (SELECT row_id, {ARTICLE.format('doc_id')} AS doc_id, start_pos, end_pos FROM bioelqa_dev_mentions) m
  LEFT JOIN (SELECT row_id, CASE WHEN regexp_matches(gene_id, '^[0-9]') THEN gene_id END AS gene_id FROM cands WHERE pos = 1) c USING (row_id) WHERE doc_id IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id, start_pos, end_pos ORDER BY row_id DESC) = 1)"""


def _tuples(g: str, p: str) -> str:
    return f"""{SPANS}, g AS ({g}), p AS ({p}), c AS (SELECT (SELECT count(*) FROM (FROM g INTERSECT FROM p)) AS tp,
  (SELECT count(*) FROM (FROM p EXCEPT FROM g)) AS fp, (SELECT count(*) FROM (FROM g EXCEPT FROM p)) AS fn)
SELECT *, {_rate('tp', '(tp + fp)')} AS precision, {_rate('tp', '(tp + fn)')} AS recall, {_rate('(2 * tp)', '(2 * tp + fp + fn)')} AS f1 FROM c"""


def _grams(t: str) -> str:
    per = "flatten(list_transform([2, 3, 4, 5], lambda n: list_transform(range(1, greatest(length(w) - n + 2, 1)), lambda i: substring(w, i, n))))"
    return f"flatten(list_transform(list_transform(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> ''), lambda w: ' ' || w || ' '), lambda w: {per}))"


def _symbol(x: str) -> str:
    edge = SYMBOL_EDGE.replace("'", "''")
    return f"upper(trim({_strip('replace(' + _strip('replace(' + _strip(x) + ', ' + chr(39) + 'Gene Symbol:' + chr(39) + ', ' + chr(39) * 2 + ')') + ', ' + chr(39) + 'Symbol:' + chr(39) + ', ' + chr(39) * 2 + ')')}, '{edge}'))"


ASKED = f"""{DICT}, {FOCUS}, asked AS (SELECT row_id, {_symbol('mention')} AS term, coalesce({NAMED_SPECIES}, focus_tax) AS tax_id FROM with_focus),
exact AS (SELECT term, tax_id, arg_max(gene_id, (n_count, gene_id)) AS exact_gene FROM dict GROUP BY ALL),
per_term AS (SELECT term, CASE WHEN min(gene_id) = max(gene_id) THEN min(gene_id) END AS only_gene, min(gene_id) FILTER (tax_id = '9606') AS human_gene,
  arg_min(gene_id, ({_PRIORITY}, -n_count, gene_id)) FILTER (tax_id IN ('9606', '10090', '10116')) AS prior_gene, arg_min(gene_id, (-n_count, tax_id, gene_id)) AS common_gene,
  arg_min(gene_id, (tax_id, gene_id)) AS first_gene, arg_max(gene_id, (tax_id, gene_id)) AS last_gene FROM dict GROUP BY ALL),
met AS (SELECT row_id, exact_gene, p.* EXCLUDE (term) FROM asked a LEFT JOIN exact USING (term, tax_id) LEFT JOIN per_term p ON a.term = p.term)"""


def _grounded(steps: list[tuple[str, str]]) -> str:
    mode = "CASE " + " ".join(f"WHEN {c} IS NOT NULL THEN '{m}'" for c, m in steps) + " ELSE 'unmapped' END"
    return f"SELECT row_id, coalesce({', '.join(c for c, _ in steps)}, NULL) AS gene_id, {mode} AS mode FROM met"


_BY_SPECIES = _grounded(CASCADES["species"])
DOMINANT = f"""pairs AS (SELECT lower(mention) AS key, unnest({_gold('gold_geneid')}) AS gene FROM bioelqa_dev_mentions WHERE gold_geneid IS NOT NULL AND mention IS NOT NULL),
counted AS (SELECT key, gene, count(*) AS n FROM pairs GROUP BY ALL),
dominant AS (SELECT key, sum(n)::BIGINT AS freq, list(gene ORDER BY n DESC, gene) AS gs, list(n ORDER BY n DESC, gene) AS ns FROM counted GROUP BY key),
dom AS (SELECT key, freq, gs[1] AS top_value, ns[1] AS top_count, {_rate('ns[1]', 'freq')} AS ratio,
  array_to_string(list_transform(range(1, len(gs) + 1), lambda i: gs[i] || ':' || ns[i]), ';') AS histogram FROM dominant)"""
SHUFFLE = f"""{LISTS}, flat AS (SELECT row_id, pos - 1 AS old_pos, gene_id FROM cands),
shuffled AS (SELECT row_id, old_pos, gene_id, row_number() OVER (PARTITION BY row_id ORDER BY (old_pos * 7 + 3) % 11) - 1 AS new_pos FROM flat)"""
PIECES = """docs AS (SELECT doc_id, arg_min(ctx_document, row_id) AS t FROM bioelqa_dev_mentions_contexts WHERE ctx_document <> '' GROUP BY doc_id),
cut AS (SELECT doc_id, length(regexp_extract(t, '^[.!?]*')) AS lead, regexp_extract_all(t, '[^.!?]+(?:[.!?]+|$)') AS ps FROM docs),
each_piece AS (SELECT doc_id, lead, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM cut),
at_piece AS (SELECT *, lead + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM each_piece),
sents AS (SELECT doc_id, CAST(p + length(regexp_extract(piece, '^[\\s\\p{Z}]*')) AS INTEGER) AS start, regexp_replace(piece, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS text FROM at_piece)"""
WINDOW = "replace(substring(ctx_document, greatest(start_pos - {0}, 0) + 1, greatest(least(end_pos + {0}, length(ctx_document)) - greatest(start_pos - {0}, 0), 0)), chr(10), ' ')"
_SAID = """CASE item_id % 6 WHEN 0 THEN 'Answer: ' || answer WHEN 1 THEN 'answer:' || lower(answer) WHEN 2 THEN 'It is ' || answer || '.' WHEN 3 THEN 'none'
  WHEN 4 THEN 'GeneID: ' || item_id ELSE 'Symbol: ABC-' || item_id || ' x' END"""
_EDGE, _END = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"
_LISTED = f"tax_id IN ({', '.join(f'{chr(39)}{t}{chr(39)}' for t in SPECIES_NAMES)})"


def _entity(species: str) -> str:
    return f"""SELECT gene_id, tax_id, {species} AS species, first(term ORDER BY pos) AS term, string_agg(term, ' ' ORDER BY pos) || ' ' || {species} AS entity_text
FROM r WHERE pos <= 8 GROUP BY gene_id, tax_id"""


def _part(key: str, seed: int = 42, held_out: int = 20, name: str = "dev") -> str:
    return f"CASE WHEN CAST('0x' || substring(md5('{seed}|' || {key}), 1, 8) AS BIGINT) % 100 < {held_out} THEN '{name}' ELSE 'train' END"


SEEN = f"""r AS (SELECT row_id, doc, {_part('doc')} = 'dev' AS dev, gold FROM (SELECT row_id, {ARTICLE.format('doc_id')} AS doc, {_gold('gold_geneid')} AS gold FROM bioelqa_dev_mentions) WHERE doc IS NOT NULL),
k AS (SELECT DISTINCT unnest(gold) AS g FROM r WHERE NOT dev), h AS (SELECT DISTINCT row_id FROM (SELECT row_id, unnest(gold) AS g FROM r WHERE dev) JOIN k USING (g)),
judged AS (SELECT r.row_id, gold, h.row_id IS NOT NULL AS seen FROM r LEFT JOIN h USING (row_id) WHERE dev)"""

SQL = {
    "kb_symbols": f"WITH {DICT} SELECT term, tax_id, gene_id, n_count FROM dict",
    "kb_symbols_global": f"WITH {LINES} {_mode('term', 'gene_id', _UP, 'ord')}",
    "kb_entity_terms": f"""WITH {LINES}, best AS (SELECT gene_id, tax_id, term, max(n_count) AS n FROM lines WHERE {_LISTED} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY gene_id, tax_id ORDER BY n DESC, term) AS pos FROM best) {_entity(_SPECIES)}""",
    "kb_entity_counted_terms": f"""WITH {LINES}, f AS (SELECT gene_id, tax_id, term, n_count, ord FROM lines QUALIFY row_number() OVER (PARTITION BY gene_id, tax_id, lower(term) ORDER BY n_count DESC, ord) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY gene_id, tax_id ORDER BY n_count DESC, ord) AS pos FROM f) {_entity(_case("tax_id", SPECIES_NAMES, "'taxid_' || tax_id"))}""",
    "kb_entity_first_terms": f"""WITH {LINES}, f AS (SELECT gene_id, tax_id, term, ord FROM lines WHERE {_LISTED} QUALIFY row_number() OVER (PARTITION BY gene_id, tax_id, lower(term) ORDER BY ord) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY gene_id, tax_id ORDER BY ord) AS pos FROM f) {_entity(_SPECIES)}""",
    "kb_gene_like": f"""WITH {LINES} SELECT tax_id, count(*) AS n_rows, count(DISTINCT term) AS n_terms FROM lines
WHERE length(term) BETWEEN 2 AND 60 AND len(regexp_extract_all(term, '[0-9]')) <= 15 AND len(regexp_split_to_array(trim(term), '\\s+')) <= 8
  AND regexp_matches(term, '[a-zA-Z]') AND trim(regexp_replace(replace(lower(term), '-', ''), '[\\s\\v]+', ' ', 'g')) NOT IN ({_STOPPED}) GROUP BY tax_id""",
    "kb_species": f"WITH {LINES} SELECT DISTINCT tax_id, {_SPECIES} AS species, {_PRIORITY} AS priority FROM lines",
    "kb_most_common_terms": f"WITH {LINES} SELECT term, n FROM (SELECT term, count(*) AS n, min(ord) AS s FROM lines GROUP BY term) ORDER BY n DESC, s LIMIT 25",
    "kb_first_and_last": f"WITH {LINES} SELECT term, arg_min(gene_id, ord) AS first_gene, arg_max(gene_id, ord) AS last_gene FROM lines GROUP BY term",
    "term_keys": f"""WITH {LINES} SELECT ord, {_compact('term')} AS compact, trim(regexp_replace({_greek('lower(term)')}, '[^a-z0-9]+', '', 'g')) AS alnum,
  trim(regexp_replace({_greek('lower(term)')}, '[^a-z0-9]+', ' ', 'g')) AS spaced_alnum, regexp_replace(lower(term), '[^a-z0-9αβγδκ]', '', 'g') AS greek,
  trim(regexp_replace(replace(lower(term), '-', ''), '[\\s\\v]+', ' ', 'g')) AS spaced, {_symbol('term')} AS symbol,
  regexp_replace(term, '( ({'|'.join(SUFFIXES)}))+$', '', 'i') AS bare FROM lines""",
    "mention_mode": _mode("mention", "gold_geneid", "(SELECT * FROM bioelqa_dev_mentions WHERE gold_geneid IS NOT NULL)", "row_id"),
    "dictionary_candidates": f"WITH {CANDS} SELECT * FROM cands",
    "dictionary_recall": f"""WITH {LISTS} SELECT count(*) AS n, count(*) FILTER (ids IS NULL) AS no_candidate, {_rate('count(*) FILTER (list_has_any(ids[:1], gold))', 'count(*)')} AS recall_1,
  {_rate('count(*) FILTER (list_has_any(ids[:5], gold))', 'count(*)')} AS recall_5, {_rate('count(*) FILTER (list_has_any(ids[:10], gold))', 'count(*)')} AS recall_10
FROM lists WHERE len(gold) > 0""",
    "candidate_strings": f"""WITH {LISTS}, parts AS (SELECT row_id, packed, list_filter(list_transform(string_split(packed, '|'), lambda x: trim(x)), lambda x: x <> '') AS es FROM lists WHERE packed IS NOT NULL)
SELECT row_id, packed, len(list_filter(es, lambda x: len(string_split(x, '::')) = 4)) AS strict, len(list_filter(es, lambda x: len(string_split(x, '::')) >= 4)) AS maxsplit, len(es) AS unchecked FROM parts""",
    "dense_candidates": f"WITH {DENSE} SELECT query_id, entity_id, score, pos FROM placed WHERE pos <= 20",
    "dense_genes": f"""WITH {DENSE}, best AS (SELECT query_id, gene_id, min(pos) AS p FROM placed WHERE pos <= 50 GROUP BY ALL)
SELECT query_id, gene_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS pos FROM best QUALIFY pos <= 10""",
    "dense_recall": f"""WITH {DENSE}, l AS (SELECT query_id, list(gene_id ORDER BY pos) AS ids FROM placed WHERE pos <= 20 GROUP BY query_id),
g AS (SELECT ids, {_gold('m.gold_geneid')} AS gold FROM bioelqa_dev_mention_vectors v JOIN bioelqa_dev_mentions m USING (row_id) LEFT JOIN l ON l.query_id = v.row_id)
SELECT count(*) AS n, count(*) FILTER (ids IS NULL) AS no_candidate, {', '.join(f"{_rate(f'count(*) FILTER (list_has_any(ids[:{k}], gold))', 'count(*)')} AS recall_{k}" for k in (1, 5, 10, 20))} FROM g WHERE len(gold) > 0""",
    "ngram_candidates": f"""WITH q AS (SELECT mention AS text, min(row_id) AS id FROM bioelqa_dev_mention_vectors WHERE mention IS NOT NULL GROUP BY ALL),
e AS (SELECT term AS text, min(entity_id) AS id FROM bioelqa_dev_candidates_sapbert_genelevel_top20 WHERE term IS NOT NULL GROUP BY ALL),
idf AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM e)) / (1 + count(*))) + 1 AS idf FROM (SELECT DISTINCT id, unnest({_grams('text')}) AS gram FROM e) GROUP BY gram),
qw AS (SELECT id, gram, count(*) * any_value(idf) AS w FROM (SELECT id, unnest({_grams('text')}) AS gram FROM q) JOIN idf USING (gram) GROUP BY ALL),
ew AS (SELECT id, gram, count(*) * any_value(idf) AS w FROM (SELECT id, unnest({_grams('text')}) AS gram FROM e) JOIN idf USING (gram) GROUP BY ALL),
qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM qw GROUP BY id), en AS (SELECT id, sqrt(sum(w * w)) AS n FROM ew GROUP BY id),
s AS (SELECT a.id AS query_id, b.id AS entry_id, round(sum(a.w / qn.n * (b.w / en.n)), 6) AS score FROM qw a JOIN ew b USING (gram) JOIN qn ON qn.id = a.id JOIN en ON en.id = b.id GROUP BY ALL)
SELECT v.row_id, entry_id, score, pos FROM (SELECT query_id, entry_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS pos FROM s QUALIFY pos <= 5)
JOIN q ON q.id = query_id JOIN bioelqa_dev_mention_vectors v ON v.mention = q.text""",
    "ngram_genes": f"""WITH q AS (SELECT mention AS text, min(row_id) AS id FROM bioelqa_dev_mention_vectors WHERE mention IS NOT NULL GROUP BY ALL),
e AS (SELECT term AS text, min(entity_id) AS id FROM bioelqa_dev_candidates_sapbert_genelevel_top20 WHERE term IS NOT NULL AND gene_id IS NOT NULL GROUP BY ALL),
idf AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM e)) / (1 + count(*))) + 1 AS idf FROM (SELECT DISTINCT id, unnest({_grams('text')}) AS gram FROM e) GROUP BY gram),
qw AS (SELECT id, gram, count(*) * any_value(idf) AS w FROM (SELECT id, unnest({_grams('text')}) AS gram FROM q) JOIN idf USING (gram) GROUP BY ALL),
ew AS (SELECT id, gram, count(*) * any_value(idf) AS w FROM (SELECT id, unnest({_grams('text')}) AS gram FROM e) JOIN idf USING (gram) GROUP BY ALL),
qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM qw GROUP BY id), en AS (SELECT id, sqrt(sum(w * w)) AS n FROM ew GROUP BY id),
s AS (SELECT a.id AS query_id, b.id AS entry_id, round(sum(a.w / qn.n * (b.w / en.n)), 6) AS score FROM qw a JOIN ew b USING (gram) JOIN qn ON qn.id = a.id JOIN en ON en.id = b.id GROUP BY ALL),
pairs AS (SELECT term AS text, gene_id, min(entity_id) AS pair FROM bioelqa_dev_candidates_sapbert_genelevel_top20 WHERE term IS NOT NULL AND gene_id IS NOT NULL GROUP BY ALL),
best AS (SELECT s.query_id, gene_id, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, pair) AS r FROM s JOIN e ON e.id = s.entry_id JOIN pairs USING (text) QUALIFY r <= 20),
once AS (SELECT query_id, gene_id, min(r) AS r FROM best GROUP BY ALL)
SELECT v.row_id AS query_id, gene_id, CAST(row_number() OVER (PARTITION BY v.row_id ORDER BY r) AS INTEGER) AS pos
FROM once JOIN q ON q.id = once.query_id JOIN bioelqa_dev_mention_vectors v ON v.mention = q.text""",
    "lexical_scores": f"""WITH terms AS (SELECT gene_id, list(DISTINCT term) AS raw, list_filter(list_transform(list(DISTINCT term), lambda r: {_alnum('r')}), lambda t: length(t) >= 2) AS ts
  FROM bioelqa_dev_candidates_sapbert_genelevel_top20 WHERE term IS NOT NULL GROUP BY gene_id),
m AS (SELECT row_id, {_alnum('mention')} AS low, {_alnum('context')} AS ctx, unnest({_gold('gold_geneid')}) AS gene_id FROM bioelqa_dev_mentions WHERE gold_geneid IS NOT NULL AND mention IS NOT NULL AND context IS NOT NULL)
SELECT row_id, gene_id, len(list_filter(ts, lambda t: t = low)) > 0 AS exact, len(list_filter(ts, lambda t: contains(ctx, t))) > 0 AS appears,
  array_to_string(list_sort(list_filter(raw, lambda r: length({_alnum('r')}) >= 2 AND ({_alnum('r')} = low OR contains(ctx, {_alnum('r')}) OR contains(low, {_alnum('r')}) OR contains({_alnum('r')}, low))))[:10], '|') AS overlap,
  round(least(len(list_filter(ts, lambda t: t = low)) * 1.0::DOUBLE + len(list_filter(ts, lambda t: contains(ctx, t))) * 0.6::DOUBLE
    + len(list_filter(ts, lambda t: contains(low, t) OR contains(t, low))) * 0.3::DOUBLE, 2.0), 6) AS bonus FROM m JOIN terms USING (gene_id)""",
    "context_attached": """WITH u AS (SELECT * FROM bioelqa_dev_mentions_contexts QUALIFY row_number() OVER (PARTITION BY doc_id, mention, start_pos, end_pos, gold_geneid ORDER BY row_id) = 1)
SELECT m.row_id, u.ctx_mention, u.ctx_sentence FROM bioelqa_dev_mentions m LEFT JOIN u ON m.doc_id IS NOT DISTINCT FROM u.doc_id AND m.mention IS NOT DISTINCT FROM u.mention
  AND m.start_pos IS NOT DISTINCT FROM u.start_pos AND m.end_pos IS NOT DISTINCT FROM u.end_pos AND m.gold_geneid IS NOT DISTINCT FROM u.gold_geneid""",
    "context_windows": f"""SELECT row_id, {WINDOW.format(60)} AS window_60, {WINDOW.format(500)} AS window_500,
  substring(ctx_document, greatest(start_pos - 160, 0) + 1, greatest(start_pos - greatest(start_pos - 160, 0), 0)) || '[MENTION]' || substring(ctx_document, start_pos + 1, end_pos - start_pos)
  || '[/MENTION]' || substring(ctx_document, end_pos + 1, greatest(least(end_pos + 160, length(ctx_document)) - end_pos, 0)) AS marked
FROM bioelqa_dev_mentions_contexts WHERE ctx_document <> '' AND start_pos >= 0 AND end_pos >= start_pos""",
    "plain_sentences": f"WITH {PIECES} SELECT doc_id, start, CAST(start + length(text) AS INTEGER) AS \"end\", text FROM sents WHERE text <> ''",
    "sentence_contexts": f"""WITH {PIECES}, numbered AS (SELECT doc_id, start, start + length(text) AS stop, text, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i FROM sents WHERE text <> ''),
m AS (SELECT c.row_id, c.doc_id, c.start_pos, c.end_pos, d.t AS ctx_document FROM bioelqa_dev_mentions_contexts c LEFT JOIN docs d USING (doc_id)),
hit AS (SELECT row_id, m.doc_id, min(i) AS i FROM m JOIN numbered n ON m.doc_id = n.doc_id AND greatest(n.start, start_pos) < least(n.stop, end_pos) GROUP BY ALL),
near AS (SELECT h.row_id, string_agg(text, ' ' ORDER BY n.i) AS three, max(text) FILTER (n.i = h.i) AS one FROM hit h JOIN numbered n ON h.doc_id = n.doc_id AND n.i BETWEEN h.i - 1 AND h.i + 1 GROUP BY ALL)
SELECT m.row_id, coalesce(one, {_strip(WINDOW.format(120))}, '') AS sentence, coalesce(three, {_strip(WINDOW.format(250))}, '') AS three_sentences FROM m LEFT JOIN near ON m.row_id = near.row_id""",
    "offset_sanity": f"""WITH c AS (SELECT lower(substring(ctx_document, start_pos + 1, end_pos - start_pos)) AS cut, lower(mention) AS m FROM bioelqa_dev_mentions_contexts WHERE ctx_document <> '' AND mention <> '')
SELECT count(*) AS n, {_rate("count(*) FILTER (cut <> '' AND (contains(cut, m) OR contains(m, cut)))", 'count(*)')} AS sane FROM c""",
    "context_species": "SELECT tax, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {' OR '.join(f"contains(c, '{w}')" for w in words)} THEN '{t}'" for t, words in SPECIES_WORDS.items())
    + " END AS tax FROM (SELECT lower(context) AS c FROM bioelqa_dev_mentions)) GROUP BY tax",
    "text_lengths": """WITH t AS (SELECT DISTINCT doc_id, ctx_abstract AS a FROM bioelqa_dev_mentions_contexts WHERE ctx_abstract <> ''), s AS (SELECT len(string_split(a, ' ')) AS w, length(a) AS c FROM t)
SELECT count(*) AS n, round(avg(w), 6) AS words_mean, median(w) AS words_median, min(w) AS words_min, max(w) AS words_max, round(avg(c), 6) AS chars_mean, median(c) AS chars_median,
  min(c) AS chars_min, max(c) AS chars_max FROM s""",
    "gold_mentions": GOLD_ALL,
    "gene_mentions": GOLD,
    "document_texts": TEXTS,
    "document_canvas": f"""WITH {_TEXTS_OF}, q AS (SELECT rec_id, parent_no AS i, try_cast(json_extract_string(e, '$.offsets[0][0]') AS INTEGER) AS s, try_cast(json_extract_string(e, '$.offsets[0][1]') AS INTEGER) AS n FROM ({_parent('passages')})),
sp AS (SELECT rec_id, s, n, array_to_string(ts, ' ') AS t FROM p JOIN q USING (rec_id, i) WHERE s IS NOT NULL AND n IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT rec_id, max(n) AS size, list({{'s': s, 'n': n, 't': t}} ORDER BY s, n, t) AS xs FROM sp GROUP BY rec_id)
SELECT r.rec_id, coalesce(list_reduce(list_prepend({{'s': 0, 'n': 0, 't': rpad('', size, ' ')}}, xs), lambda a, b: {{'s': 0, 'n': 0,
    't': substring(a.t, 1, b.s) || substring(b.t, 1, greatest(b.n - b.s, 0)) || substring(a.t, b.s + length(substring(b.t, 1, greatest(b.n - b.s, 0))) + 1)}}).t, '') AS canvas,
  coalesce(list_reduce(list_prepend({{'s': 0, 'n': 0, 't': ''}}, xs), lambda a, b: {{'s': 0, 'n': 0, 't': rpad(a.t, greatest(length(a.t), b.s)::INTEGER, ' ') || b.t}}).t, '') AS padded
FROM r LEFT JOIN l USING (rec_id)""",
    "span_accuracy": f"""WITH {SPANS}, j AS (SELECT gold, p.gene_id, p.doc_id IS NOT NULL AS seen FROM gspan g LEFT JOIN pspan p ON g.doc_id = p.doc_id AND g.start_pos = p.start_pos AND g.end_pos = p.end_pos),
c AS (SELECT count(*) AS n_gold, count(*) FILTER (seen) AS recognised, count(*) FILTER (list_contains(gold, gene_id)) AS correct FROM j)
SELECT *, {_rate('correct', 'n_gold')} AS accuracy_all, {_rate('correct', 'recognised')} AS accuracy_recognised, {_rate('recognised', 'n_gold')} AS recognition_rate FROM c""",
    "tuple_scores": "WITH " + _tuples("SELECT DISTINCT doc_id, start_pos, end_pos, unnest(gold) AS gene_id FROM gspan", "SELECT * FROM pspan WHERE gene_id IS NOT NULL"),
    "span_scores": "WITH " + _tuples("SELECT doc_id, start_pos, end_pos FROM gspan", "SELECT doc_id, start_pos, end_pos FROM pspan"),
    "span_overlaps": f"""WITH {SPANS}, m AS (SELECT g.doc_id, g.start_pos, g.end_pos, p.start_pos AS ps, p.end_pos AS pe FROM gspan g
  LEFT JOIN pspan p ON g.doc_id = p.doc_id AND g.start_pos < p.end_pos AND p.start_pos < g.end_pos)
SELECT doc_id, start_pos, end_pos, CASE WHEN bool_or(ps = start_pos AND pe = end_pos) THEN 'exact' WHEN count(ps) > 0 THEN 'partial' ELSE 'miss' END AS overlap,
  first(ps ORDER BY ps, pe) AS p_start, first(pe ORDER BY ps, pe) AS p_end FROM m GROUP BY doc_id, start_pos, end_pos""",
    "error_stages": f"""WITH {SPANS} SELECT CASE WHEN p.doc_id IS NULL THEN 'recognition_miss' WHEN list_contains(gold, p.gene_id) THEN 'correct' ELSE 'linking_error' END AS stage, count(*) AS n
FROM gspan g LEFT JOIN pspan p ON g.doc_id = p.doc_id AND g.start_pos = p.start_pos AND g.end_pos = p.end_pos GROUP BY stage""",
    "gold_cardinality": f"SELECT len({_gold('gold_geneid')}) AS n_ids, count(*) AS n_rows FROM bioelqa_dev_mentions GROUP BY ALL",
    "item_options": """SELECT item_id, len(ids) AS n_options, ids[ascii(answer) - 64] AS answer_gene FROM (SELECT *, regexp_extract_all(choices, '[A-Z]\\. ([0-9]+)', 1) AS ids FROM bioelqa_test_items)""",
    "parsed_answers": f"""WITH s AS (SELECT item_id, {_SAID} AS t FROM bioelqa_test_items)
SELECT item_id, coalesce(nullif(upper(regexp_extract(t, '(?i)Answer:\\s*([A-Z])', 1)), ''), nullif(regexp_extract(t, '{_EDGE}([A-Z]){_END}', 1), ''), 'NONE') AS letter,
  coalesce(nullif(upper(regexp_extract(t, '(?i)Answer\\s*:\\s*([A-E]){_END}', 1)), ''), nullif(regexp_extract(t, '{_EDGE}([A-E]){_END}', 1), '')) AS option,
  nullif(regexp_extract(t, 'GeneID:\\s*([0-9]+)', 1), '') AS gene, nullif(regexp_extract(t, 'Symbol:\\s*([A-Za-z0-9_.\\-/]+)', 1), '') AS symbol,
  nullif(trim(regexp_extract(t, 'Symbol:\\s*(.+)', 1)), '') AS symbol_line FROM s""",
    "selector_scores": f"""WITH {LISTS}, r AS (SELECT gold, ids, CASE WHEN row_id % 7 <> 0 THEN row_id % 5 END AS l FROM lists WHERE len(gold) > 0),
c AS (SELECT count(*) AS n, count(*) FILTER (ids IS NULL) AS no_candidate, count(*) FILTER (ids IS NOT NULL) AS prompts, count(*) FILTER (ids IS NOT NULL AND l IS NULL) AS missing, count(l) AS answered, count(*) FILTER (l IS NOT NULL AND ids[l + 1] IS NULL) AS invalid,
  count(*) FILTER (list_has_any(ids, gold)) AS gold_in_list, count(*) FILTER (list_contains(gold, ids[l + 1])) AS correct FROM r)
SELECT *, {_rate('gold_in_list', 'n')} AS recall, {_rate('correct', 'gold_in_list')} AS selector_accuracy, {_rate('correct', 'n')} AS final_accuracy FROM c""",
    "option_texts": f"""WITH {CANDS} SELECT row_id, string_agg(chr(CAST(64 + pos AS INTEGER)) || '. GeneID: ' || gene_id || ' | Species: ' || species || ' | Matched term: ' || term, chr(10) ORDER BY pos) AS "full",
  string_agg(chr(CAST(64 + pos AS INTEGER)) || '. ' || term || ' ' || species, chr(10) ORDER BY pos) AS term_species, string_agg(chr(CAST(64 + pos AS INTEGER)) || '. ' || term, chr(10) ORDER BY pos) AS term_only FROM cands GROUP BY row_id""",
    "prompt_records": f"""WITH {LISTS}, o AS (SELECT row_id, count(*) AS k, string_agg(chr(CAST(64 + pos AS INTEGER)) || '. GeneID: ' || gene_id || ' | Species: ' || species || ' | Matched term: ' || term, chr(10) ORDER BY pos) AS opts FROM cands GROUP BY row_id)
SELECT case_id, CASE WHEN opts IS NOT NULL THEN 'Mention: ' || coalesce(mention, '') || chr(10) || 'Context: ' || translate(coalesce(context, ''), chr(9) || chr(10) || chr(13), '   ') || chr(10) || 'Candidates:' || chr(10) || opts
  || chr(10) || 'Give the letter of the gene as Answer: <letter>.' END AS prompt, CASE WHEN opts IS NULL THEN 'empty_candidates' END AS reason, CAST(coalesce(k, 0) AS INTEGER) AS n_options FROM lists LEFT JOIN o USING (row_id)""",
    "position_map": f"WITH {SHUFFLE} SELECT row_id, new_pos, old_pos, chr(CAST(65 + new_pos AS INTEGER)) AS new_option, chr(CAST(65 + old_pos AS INTEGER)) AS old_option, gene_id FROM shuffled",
    "order_stability": f"""WITH {SHUFFLE}, a AS (SELECT row_id, list(gene_id ORDER BY old_pos) AS a, list(gene_id ORDER BY new_pos) AS b, row_id % 3 AS la, row_id % 4 AS lb FROM shuffled GROUP BY row_id),
p AS (SELECT *, a[la + 1] AS ia, b[lb + 1] AS ib FROM a), c AS (SELECT *, list_position(a, ia) <> list_position(b, ia) AS moved FROM p WHERE ia IS NOT NULL AND ib IS NOT NULL),
n AS (SELECT count(*) AS comparable, count(*) FILTER (ia = ib) AS same_id, count(*) FILTER (la = lb) AS same_letter, count(*) FILTER (moved) AS moved, count(*) FILTER (moved AND ia = ib) AS followed_id,
  count(*) FILTER (moved AND la = lb) AS repeated_letter FROM c) SELECT *, {_rate('same_id', 'comparable')} AS same_id_rate, {_rate('followed_id', 'moved')} AS followed_rate FROM n""",
    "mapping_modes": f"""WITH {ASKED}, g AS ({_BY_SPECIES}) SELECT mode, count(*) AS n, count(*) FILTER (list_contains({_gold('gold_geneid')}, gene_id)) AS correct
FROM g JOIN bioelqa_dev_mentions m USING (row_id) GROUP BY mode""",
    "grounded_species": f"WITH {ASKED} {_BY_SPECIES}",
    "grounded_named": f"WITH {ASKED} {_grounded(CASCADES['named'])}",
    "grounded_prior": f"WITH {ASKED} {_grounded(CASCADES['prior'])}",
    "grounded_global": f"WITH {ASKED} {_grounded(CASCADES['global'])}",
    "dominant_genes": f"WITH {DOMINANT} SELECT * FROM dom",
    "rescued": f"""WITH {CANDS}, {DOMINANT}, b AS (SELECT {_gold('gold_geneid')} AS gold, c.gene_id AS before, coalesce(c.gene_id, d.top_value) AS after FROM bioelqa_dev_mentions m
  LEFT JOIN (SELECT row_id, gene_id FROM cands WHERE pos = 1) c USING (row_id) LEFT JOIN (SELECT * FROM dom WHERE freq >= 2 AND ratio >= 0.8) d ON lower(m.mention) = d.key),
f AS (SELECT coalesce(list_contains(gold, before), false) AS x, coalesce(list_contains(gold, after), false) AS y FROM b)
SELECT count(*) FILTER (NOT x AND y) AS gain, count(*) FILTER (x AND NOT y) AS hurt, count(*) FILTER (NOT x AND y) - count(*) FILTER (x AND NOT y) AS net FROM f""",
    "focus_species": f"WITH {FOCUS} SELECT row_id, focus_tax, known_tax FROM with_focus",
    "seen_genes": f"WITH {SEEN} SELECT seen, count(*) AS n FROM judged GROUP BY seen",
    "seen_accuracy": f"""WITH {CANDS}, {SEEN}, t AS (SELECT seen, coalesce(list_contains(gold, c.gene_id), false) AS ok FROM judged j LEFT JOIN (SELECT row_id, gene_id FROM cands WHERE pos = 1) c USING (row_id) WHERE len(gold) > 0)
SELECT seen, count(*) AS n, count(*) FILTER (ok) AS correct, {_rate('count(*) FILTER (ok)', 'count(*)')} AS accuracy FROM t GROUP BY seen""",
    "split_overlap": f"WITH {SEEN} SELECT count(*) AS n_shared FROM (SELECT unnest(gold) AS g FROM r WHERE dev INTERSECT SELECT g FROM k)",
    "document_split": f"SELECT doc, {_part('doc')} AS part FROM (SELECT DISTINCT {ARTICLE.format('doc_id')} AS doc FROM bioelqa_dev_mentions) WHERE doc IS NOT NULL",
    "occurrence_pairs": """WITH a AS (SELECT mention, row_id, row_number() OVER (PARTITION BY mention ORDER BY row_id) AS nth FROM bioelqa_dev_mentions WHERE mention IS NOT NULL),
b AS (SELECT mention, row_id, row_number() OVER (PARTITION BY mention ORDER BY row_id) AS nth FROM bioelqa_dev_mentions_contexts WHERE mention IS NOT NULL)
SELECT a.row_id, b.row_id AS row_id_right, a.nth FROM a LEFT JOIN b ON a.mention = b.mention AND a.nth = b.nth""",
    "positional_pairs": """SELECT a.row_id, a.mention, b.row_id AS row_id_right, b.mention AS mention_right FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS k FROM bioelqa_dev_mentions) a
JOIN (SELECT *, row_number() OVER (ORDER BY row_id) AS k FROM bioelqa_dev_mentions_contexts) b USING (k)""",
    "row_cases": "SELECT 'case_' || row_number() OVER (ORDER BY row_id) AS case_id, row_id, mention FROM bioelqa_dev_mentions",
    "prompt_cases": f"WITH {LISTS} SELECT 'prompt_case_' || row_number() OVER (ORDER BY row_id) AS case_id, row_id, mention FROM lists WHERE ids IS NOT NULL",
    "training_examples": f"""WITH {LINES}, pool AS (SELECT {_compact('term')} AS surface, gene_id, min(ord) AS o FROM lines GROUP BY ALL),
m AS (SELECT row_id AS id, {_compact('mention')} AS surface, {_gold('gold_geneid')} AS golds FROM bioelqa_dev_mentions WHERE mention IS NOT NULL),
p AS (SELECT *, unnest(golds) AS gold_id FROM m),
hard AS (SELECT id, gold_id, gene_id FROM p JOIN pool USING (surface) WHERE NOT list_contains(golds, gene_id) QUALIFY row_number() OVER (PARTITION BY id, gold_id ORDER BY o, gene_id) <= 3),
ring AS (SELECT gene_id, row_number() OVER (ORDER BY md5(gene_id)) - 1 AS at, count(*) OVER () AS n FROM (SELECT DISTINCT gene_id FROM lines)),
num AS (SELECT p.*, (SELECT count(*) FROM hard h WHERE h.id = p.id AND h.gold_id = p.gold_id) AS h, CAST('0x' || substring(md5(id || '|' || gold_id), 1, 8) AS BIGINT) AS start FROM p),
fill AS (SELECT id, gold_id, r.gene_id, h FROM num JOIN ring r ON (r.at - start % r.n + r.n) % r.n < len(golds) + 3
  WHERE h < 3 AND NOT list_contains(golds, r.gene_id) AND NOT EXISTS (SELECT 1 FROM hard x WHERE x.id = num.id AND x.gold_id = num.gold_id AND x.gene_id = r.gene_id)
  QUALIFY row_number() OVER (PARTITION BY id, gold_id ORDER BY (r.at - start % r.n + r.n) % r.n) + h <= 3)
SELECT id, gold_id, gold_id AS gene_id, 1 AS label FROM p UNION ALL SELECT id, gold_id, gene_id, 0 FROM hard UNION ALL SELECT id, gold_id, gene_id, 0 FROM fill""",
    "example_split": "",
    "unanswered": "SELECT row_id, case_id FROM bioelqa_dev_mentions WHERE row_id NOT IN (SELECT row_id FROM bioelqa_dev_mentions_contexts WHERE row_id IS NOT NULL)",
    "token_spans": """WITH m AS (SELECT row_id, start_pos AS a, end_pos AS b, regexp_extract_all(context, '\\s*\\S+') AS ws FROM bioelqa_dev_mentions WHERE context IS NOT NULL AND start_pos IS NOT NULL AND end_pos > start_pos),
w AS (SELECT row_id, a, b, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM m),
t AS (SELECT *, sum(length(w)) OVER (PARTITION BY row_id ORDER BY i) AS te, te - length(regexp_replace(w, '^\\s+', '')) AS ts FROM w),
l AS (SELECT *, CASE WHEN greatest(ts, a) < least(te, b) THEN CASE WHEN ts <= a THEN 'B' ELSE 'I' END ELSE 'O' END AS label FROM t),
s AS (SELECT *, label = 'B' OR (label = 'I' AND lag(label, 1, 'O') OVER (PARTITION BY row_id ORDER BY i) = 'O') AS new FROM l),
g AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY row_id ORDER BY i) AS island FROM s)
SELECT row_id, CAST(min(ts) AS INTEGER) AS span_start, CAST(max(te) AS INTEGER) AS span_end FROM g WHERE label <> 'O' GROUP BY row_id, island""",
    "event_props": "SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL",
    "event_spread": "SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM (SELECT avg(value) AS m FROM events GROUP BY event_type)",
    "order_lines": """WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS a FROM lineitem GROUP BY l_orderkey)
SELECT o_orderpriority, count(*) AS n_orders, round(sum(a), 2) AS amount FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
}
SQL["overridden"] = SQL["rescued"].replace("coalesce(c.gene_id, d.top_value)", "coalesce(d.top_value, c.gene_id)")
SQL["example_split"] = f"SELECT *, {_part("id || ':' || gold_id || ':' || gene_id", 7, 10, 'validation')} AS part FROM ({SQL['training_examples']})"
#: Columns whose type DuckDB gives another width than Spark.
_TYPES = {
    "dictionary_candidates": "pos INTEGER", "candidate_strings": "strict INTEGER, maxsplit INTEGER, unchecked INTEGER", "dense_candidates": "pos INTEGER", "dense_genes": "pos INTEGER",
    "ngram_candidates": "pos INTEGER", "text_lengths": "words_min INTEGER, words_max INTEGER, chars_min INTEGER, chars_max INTEGER", "gold_mentions": "start_pos BIGINT, end_pos BIGINT",
    "gene_mentions": "start_pos BIGINT, end_pos BIGINT", "span_overlaps": "start_pos BIGINT, end_pos BIGINT", "gold_cardinality": "n_ids INTEGER", "item_options": "n_options INTEGER",
    "position_map": "new_pos INTEGER, old_pos INTEGER",
}
for _name, _columns in _TYPES.items():
    _casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in map(str.split, _columns.split(", ")))
    SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({SQL[_name]})"
