"""Models behind Arrow batches: the caller gives a factory, called once per task; stubs serve for tests.

Only the data flow is built here; fine-tuning is left to the model's own library, on the examples of
``evaluation.training_examples``.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = ("A", "B", "C", "D", "E")


def generate(prompts: DataFrame, factory: Callable, batch: int = 16) -> DataFrame:
    """case_id, decoded. ``factory()`` gives a function from a list of prompts to a list of texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                yield pd.DataFrame({"case_id": part["case_id"], "decoded": list(model(part["prompt"].tolist()))})

    return prompts.where("prompt IS NOT NULL").select("case_id", "prompt").mapInPandas(run, "case_id string, decoded string")


def score_letters(prompts: DataFrame, factory: Callable, spellings: tuple[str, ...] = ("{}",)) -> DataFrame:
    """case_id, letter, score_A..score_E: the likelihood of each letter, the best over its spellings; ties to the first.
    ``factory()`` gives a function from prompts and continuations to scores."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            texts = pdf["prompt"].tolist()
            out = {"case_id": pdf["case_id"]}
            for letter in LETTERS:
                tried = [model(texts, [s.format(letter)] * len(texts)) for s in spellings]
                out[f"score_{letter}"] = [float(max(x)) for x in zip(*tried, strict=True)]
            yield pd.DataFrame(out)

    scores = ", ".join(f"score_{x} double" for x in LETTERS)
    scored = prompts.where("prompt IS NOT NULL").select("case_id", "prompt").mapInPandas(run, f"case_id string, {scores}")
    best = F.greatest(*(f"score_{x}" for x in LETTERS))
    letter = F.coalesce(*(F.when(F.col(f"score_{x}") == best, x) for x in LETTERS))
    return scored.withColumn("letter", letter)


def loss_scorer(factory: Callable) -> Callable:
    """A scorer for ``score_letters`` from a sequence model: ``factory()`` gives a function from texts and targets to mean
    losses and numbers of target tokens; the score is minus the loss of the whole target."""
    def make() -> Callable:
        model = factory()

        def score(texts: list[str], targets: list[str]) -> list[float]:
            losses, lengths = model(texts, targets)
            return [-loss * length for loss, length in zip(losses, lengths, strict=True)]

        return score

    return make


def score_pairs(pairs: DataFrame, factory: Callable, columns: list[str]) -> DataFrame:
    """pairs with ``score``; the factory's function takes two lists of texts."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields), "score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            yield pdf.assign(score=[float(x) for x in model(pdf[columns[0]].tolist(), pdf[columns[1]].tolist())])

    return pairs.mapInPandas(run, schema)


def with_retries(call: Callable, tries: int = 3, pause: float = 5.0, pace: float = 0.5) -> Callable:
    """A remote call made again after a pause: (answer, None), or (None, reason) after the last failure, so that a broken
    service doesn't look like an empty answer."""
    def run(text: str):
        reason = None
        for attempt in range(tries):
            try:
                answer = call(text)
                time.sleep(pace)
                return answer, None
            except Exception as error:
                reason = f"{type(error).__name__}: {error}"
                if attempt + 1 < tries:
                    time.sleep(pause)
        return None, reason

    return run


def stub_generator() -> Callable:
    """Answers by a checksum of the prompt: the same on every machine."""
    return lambda prompts: [f"Answer: {LETTERS[hashlib.md5(p.encode()).digest()[0] % len(LETTERS)]}" for p in prompts]


def stub_scorer() -> Callable:
    return lambda texts, ends: [hashlib.md5((t + e).encode()).digest()[0] / 255 for t, e in zip(texts, ends, strict=True)]


def stub_encoder(dimension: int = 64) -> Callable:
    """Hashed character trigrams."""
    import numpy as np

    def encode(texts: list[str]):
        x = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for k in range(max(1, len(t) - 2)):
                x[i, int.from_bytes(hashlib.md5(t[k : k + 3].encode()).digest()[:4], "big") % dimension] += 1
        return x

    return encode
