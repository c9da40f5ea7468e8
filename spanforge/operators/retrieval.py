"""Ranked candidates: exact lookup by key, brute-force vectors, and character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import compact_key, species_name, species_priority


def dictionary_candidates(mentions: DataFrame, dictionary: DataFrame, k: int = 10) -> DataFrame:
    """row_id, pos, gene_id, tax_id, species, term: genes whose term has the mention's key, by species priority, count
    and identifier, each gene once.

    Mentions repeat, so the lookup runs on their distinct keys, and each key's list is cut to k before it meets the
    mentions: a term under many genes never multiplies with its mentions.
    """
    asked = mentions.select("row_id", compact_key(F.col("mention")).alias("key")).where("key <> ''")
    lines = dictionary.withColumn("key", compact_key(F.col("term")))
    met = lines.join(asked.select("key").distinct(), "key", "left_semi")
    rank = F.struct(species_priority(F.col("tax_id")).alias("priority"), (-F.col("n_count")).alias("less"), "gene_id", "term", "tax_id")
    genes = met.groupBy("key", "gene_id").agg(F.min(rank).alias("r")).select("key", "r.*")
    order = Window.partitionBy("key").orderBy("priority", "less", "gene_id", "term", "tax_id")
    lists = genes.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)
    return asked.join(lists, "key").select("row_id", "pos", "gene_id", "tax_id", species_name(F.col("tax_id")).alias("species"), "term")


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """row_id and its candidates in order."""
    item = F.struct("pos", "gene_id", "tax_id", "species", "term")
    ordered = F.array_sort(F.collect_list(item))
    bare = lambda s: F.struct(s["gene_id"].alias("gene_id"), s["tax_id"].alias("tax_id"), s["species"].alias("species"), s["term"].alias("term"))
    return candidates.groupBy("row_id").agg(F.transform(ordered, bare).alias("candidates"))


def normalised(vector: Column) -> Column:
    """Unit length; null where there's no direction."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length))


ENTITY_BLOCK, QUERY_BLOCK, LEAST_QUERIES, SCORES = 50_000, 20_000, 500, 4_000_000


def _in_cells(queries: DataFrame, entities: DataFrame, values: Sequence[str], kernel) -> DataFrame:
    """query_id, entity_id, score of every pair of blocks that ``kernel`` keeps. Both sides have id and ``values``; each
    pair of blocks is one task, and a query's result depends on the blocks of entities only."""
    schema = "query_id bigint, entity_id bigint, score double"
    n_entities, n_queries = entities.count(), queries.count()
    if not n_entities or not n_queries:
        return queries.sparkSession.createDataFrame([], schema)
    eb = math.ceil(n_entities / ENTITY_BLOCK)
    busy = math.ceil(2 * queries.sparkSession.sparkContext.defaultParallelism / eb)
    qb = max(math.ceil(n_queries / QUERY_BLOCK), min(busy, math.ceil(n_queries / LEAST_QUERIES)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(*(F.col(c).alias(f"q_{c}") for c in ("id", *values)), place(qb).alias("q"), every(eb).alias("e"))
    right = entities.select("id", *values, place(eb).alias("e"), every(qb).alias("q"))
    sides = [df.withColumn("cell", F.col("q") * eb + F.col("e")).drop("q", "e").repartitionById(qb * eb, "cell").groupBy("cell") for df in (left, right)]

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "entity_id": [], "score": []})
        q, r, score = kernel(a, b)
        return pd.DataFrame({"query_id": a["q_id"].to_numpy()[q], "entity_id": b["id"].to_numpy()[r], "score": score})

    return sides[0].cogroup(sides[1]).applyInPandas(cell, schema)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, ties to the smaller id."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, -k, axis=1)[:, -k]
    q, r = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[r], -scores[q, r], q))
    q, r = q[order], r[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], r[keep]


def _k_best(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    return met.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def dense_top(queries: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """query_id, entity_id, score, pos: exact cosine of every query with every entity, in blocks of both sides; each block
    keeps its k best, the blocks' lists are merged. Inputs have id and v; vectors without direction take no part."""
    unit = lambda v: (x := np.stack(v.to_numpy()).astype(np.float64)) / np.linalg.norm(x, axis=1)[:, None]

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, ids = unit(a["q_v"]), unit(b["v"]), b["id"].to_numpy()
        tile, out = max(1, SCORES // len(y)), []
        for at in range(0, len(x), tile):
            scores = np.round(x[at : at + tile] @ y.T, 9)
            q, r = _best(scores, ids, k)
            out.append((q + at, r, scores[q, r]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    sound = [df.select("id", "v").where(F.exists("v", lambda e: e != 0)) for df in (queries, entities)]
    return _k_best(_in_cells(*sound, ["v"], kernel), k)


def one_per_gene(ranked: DataFrame, k: int) -> DataFrame:
    """The best place of each gene, then the first k; may be fewer."""
    best = ranked.groupBy("query_id", "gene_id").agg(F.min("pos").alias("old_pos"))
    order = Window.partitionBy("query_id").orderBy("old_pos")
    return best.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def char_ngrams(text: Column, least: int = 2, most: int = 5) -> Column:
    """Character n-grams within words, each word padded with a space on both sides."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of_length(padded: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - n + 1)
        return F.when(F.length(padded) >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.flatten(F.array(*(of_length(padded, n) for n in range(least, most + 1))))

    return F.flatten(F.transform(words, grams))


def _weights(texts: DataFrame, idf: DataFrame) -> DataFrame:
    counts = texts.select("id", F.explode(char_ngrams(F.col("text"))).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    weighted = counts.join(idf, "gram").select("id", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("w"))


def ngram_top(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """query_id, entry_id, score, pos: cosine of smooth tf-idf vectors of character n-grams. Both sides have id and text;
    callers pass distinct texts, so that copies don't multiply.

    A join on the n-grams would emit every pair that shares a frequent one, once for each. Here the vectors meet in blocks:
    a block's entries are inverted, and a query adds up the lists of its n-grams (as 64-bit hashes) in place.
    """
    n = entries.count()
    grams = entries.select("id", F.explode(F.array_distinct(char_ngrams(F.col("text")))).alias("gram"))
    idf = grams.groupBy("gram").agg((F.log(F.lit(1.0 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    vectors = lambda df: _weights(df, idf).groupBy("id").agg(F.collect_list(F.xxhash64("gram")).alias("g"), F.collect_list("w").alias("w"))

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes = b["id"].to_numpy(), [len(g) for g in b["g"]]
        g, w = (np.concatenate(b[c].to_numpy()) for c in ("g", "w"))
        order = np.argsort(g, kind="stable")
        g, w, owner = g[order], w[order], np.repeat(np.arange(len(b)), sizes)[order]
        out = []
        for i, (own, weight) in enumerate(zip(a["q_g"], a["q_w"], strict=True)):
            lo = np.searchsorted(g, own)
            many = np.searchsorted(g, own, side="right") - lo
            at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            scores = np.round(np.bincount(owner[at], weights=w[at] * np.repeat(weight, many), minlength=len(b)), 6)
            met = np.unique(owner[at])
            if len(met):
                _, r = _best(scores[None, met], ids[met], k)
                out.append((np.full(len(r), i), met[r], scores[met[r]]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    met = _in_cells(vectors(queries), vectors(entries), ["g", "w"], kernel)
    return _k_best(met, k).withColumnRenamed("entity_id", "entry_id")


def ngram_genes(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """query_id, gene_id, pos: the genes among the k best entries of each query, each once.

    queries: id and text; entries: id, gene_id and text. An entry is a term of a gene (its least id). Distinct texts are
    scored; then every gene of a term, and every query of a text, is joined back. The k best entries lie within the k best
    terms, at most k of each.
    """
    pairs = entries.where("text IS NOT NULL AND gene_id IS NOT NULL").groupBy("text", "gene_id").agg(F.min("id").alias("id"))
    known = pairs.groupBy("text").agg(F.min("id").alias("id"))
    asked = queries.where("text IS NOT NULL").groupBy("text").agg(F.min("id").alias("id"))
    few = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("text").orderBy("id"))).where(F.col("_n") <= k)
    genes = few.join(known.withColumnRenamed("id", "entry_id"), "text").select("entry_id", F.col("id").alias("pair"), "gene_id")
    met = ngram_top(asked, known, k).drop("pos").join(genes, "entry_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pair")
    best = one_per_gene(met.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k), k)
    texts = asked.withColumnRenamed("id", "query_id").join(queries.withColumnRenamed("id", "row"), "text").select("query_id", "row")
    return best.join(texts, "query_id").select(F.col("row").alias("query_id"), "gene_id", "pos")


def encode_texts(df: DataFrame, encoder, text: str = "text", id_col: str = "id", batch: int = 128) -> DataFrame:
    """id and unit vector of each text. ``encoder()`` is called once per task and returns texts -> matrix."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                x = np.asarray(model(part[text].fillna("").tolist()), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"id": part[id_col], "v": list(x.astype(np.float32))})

    return df.select(id_col, text).mapInPandas(run, "id bigint, v array<float>")
