"""A remote annotator as a source: one request for each document, its answers as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.models import with_retries

#: The shape of an answer.
ANSWER = "annotations array<struct<obj:string,id:array<string>,mention:string,span:struct<begin:int,end:int>>>"


def request_annotations(docs: DataFrame, transport: Callable, tries: int = 1, pause: float = 0.0, pace: float = 0.5) -> DataFrame:
    """doc_id, response, error of docs (doc_id, text). ``transport()`` is called once per task and returns a function from
    a text to the answer's JSON, with its own timeout; a document that fails has the reason and no response."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(transport(), tries, pause, pace)
        for pdf in batches:
            made = [call(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "response": [m[0] for m in made], "error": [m[1] for m in made]})

    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInPandas(run, "doc_id string, response string, error string")


def parse_annotations(responses: DataFrame) -> DataFrame:
    """doc_id, start_pos, end_pos, mention, kind, identifier of the genes whose first id is an NCBIGene one."""
    each = responses.select("doc_id", F.explode(F.from_json("response", ANSWER)["annotations"]).alias("a"))
    first = F.get("a.id", F.lit(0))
    kept = each.where((F.col("a.obj") == "gene") & first.startswith("NCBIGene:"))
    return kept.select("doc_id", F.col("a.span.begin").alias("start_pos"), F.col("a.span.end").alias("end_pos"), "a.mention", F.lit("Gene").alias("kind"), F.replace(first, F.lit("NCBIGene:"), F.lit("")).alias("identifier"))
