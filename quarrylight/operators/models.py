"""Where models plug in. Each takes a function over a batch and runs it inside Arrow batches.

Offline stand-ins live elsewhere: hashed vectors (``dense.hashed_search``), keyword reranking
(``fusion.keyword_rerank``), template answers (``answers.template_answer``), overlap judging
(``faithfulness.judge_fallback``) and keyword rewriting (``corrective.keyword_rewrite``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import vocab as V
from quarrylight.operators.ranking import top_k

Embed = Callable[[list[str]], np.ndarray]
Score = Callable[[list[str], list[str]], list[float]]
Generate = Callable[[list[str]], list[str]]


def embed(text: Column, load: Callable[[], Embed], as_query: bool = False) -> Column:
    """Vectors of texts. ``load`` runs once per Python worker; questions get the model's prefix."""
    prefix = V.QUERY_PREFIX if as_query else ""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(np.asarray(model([prefix + (t or "") for t in texts]), dtype=np.float32)))

    return run(text)


def rerank(candidates: DataFrame, load: Callable[[], Score], k: int) -> DataFrame:
    """Best ``k`` of ``candidates(query_id, chunk_id, question, text)`` by a pair-scoring model."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, texts in batches:
            yield pd.Series(model(list(questions), list(texts)), dtype="float64")

    scored = candidates.select("query_id", "chunk_id", run("question", "text").alias("score"))
    return top_k(scored, k)


def generate(prompt: Column, load: Callable[[], Generate]) -> Column:
    """Replies to prompts; a batch that fails as a whole gives nulls, for the caller to fill in."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            try:
                yield pd.Series(model([p or "" for p in prompts]))
            except Exception:  # the model is a remote service: leave a gap, not a failed job
                yield pd.Series([None] * len(prompts))

    return run(prompt)
