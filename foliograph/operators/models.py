"""Models as pluggable functions on batches; the defaults are deterministic and need no files.

A model is a factory: it is called once per Python worker and returns a function on lists.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embed = Callable[[], Callable[[list[str]], tuple[np.ndarray, list[dict[int, float]]]]]
Score = Callable[[], Callable[[list[str], list[str]], list[float]]]
Write = Callable[[], Callable[[list[str]], list[str]]]
_WORD = re.compile(r"[^\W_]+")


def _slot(word: str, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") % size


def hashed_embedder(dims: int = 64, vocabulary: int = 250_002) -> Embed:
    """Words hashed to slots: a unit vector and weights by 1-based index. Not a language model."""

    def make():
        def run(texts: list[str]):
            dense, sparse = np.zeros((len(texts), dims)), []
            for i, t in enumerate(texts):
                words = _WORD.findall((t or "").lower())
                w: dict[int, float] = {}
                for x in words:
                    dense[i, _slot(x, dims)] += 1 if _slot(x + "#", 2) else -1
                    k = _slot(x, vocabulary) + 1
                    w[k] = w.get(k, 0.0) + 1.0
                sparse.append({k: 1 + math.log(v) for k, v in w.items()})
                n = np.linalg.norm(dense[i])
                dense[i] = dense[i] / n if n else dense[i]
            return dense, sparse

        return run

    return make


def overlap_reranker() -> Score:
    """The logit of the share of the query's words that a text holds; the text is cut, never the query."""

    def make():
        def run(queries: list[str], texts: list[str]) -> list[float]:
            out = []
            for q, t in zip(queries, texts):
                a, b = set(_WORD.findall((q or "").lower())), set(_WORD.findall((t or "").lower()))
                p = (len(a & b) + 0.5) / (len(a) + 1)
                out.append(math.log(p / (1 - p)))
            return out

        return run

    return make


def template_writer() -> Write:
    def make():
        return lambda prompts: [" ".join((p or "").split())[:200] for p in prompts]

    return make


def embed(text: Column, model: Embed | None = None) -> Column:
    """``struct(dense array<float>, sparse map<int,float>)``; the model is made once per worker."""
    factory = model or hashed_embedder()

    @F.pandas_udf("dense array<float>, sparse map<int,float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = factory()
        for b in batches:
            d, s = f(b.fillna("").tolist())
            yield pd.DataFrame({"dense": list(d.astype(np.float32)), "sparse": s})

    return run(text)


def rerank(query: Column, text: Column, model: Score | None = None) -> Column:
    factory = model or overlap_reranker()

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        f = factory()
        for q, t in batches:
            yield pd.Series(f(q.fillna("").tolist(), t.fillna("").tolist()))

    return run(query, text)


def write(prompt: Column, model: Write | None = None) -> Column:
    """Prefixes or answers from prompts."""
    factory = model or template_writer()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = factory()
        for b in batches:
            yield pd.Series(f(b.fillna("").tolist()))

    return run(prompt)
