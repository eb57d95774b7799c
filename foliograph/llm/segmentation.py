"""Problem 4: splitting oversized items at natural boundaries (lexical-cohesion segmentation).

Words are gathered into short sequences; the similarity of the blocks before and after each gap is low where the
topic changes. Within each size window the deepest valley becomes the cut, snapped to the natural boundary beside it, and
the next piece repeats the last characters before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQUENCE = 20  # words of a sequence
BLOCK = 6  # sequences of a block
SPAN = 512  # gaps scored at once, which bounds the memory whatever the text's length

_WORD = re.compile(r"[^\W\d_]{2,}")
#: Boundaries by rank: after a blank line, after a line, after a sentence, after white space.
_BREAKS = (
    re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*"),
    re.compile(r"(?:\r\n|\n|\r)[ \t]*"),
    re.compile(r"[.!?…;:][\"'»”)\]]*\s+"),
    re.compile(r"\s+"),
)


def _gap_depths(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the gaps between sequences, and how deep the valley of similarity is at each."""
    starts, words = [], []
    for m in _WORD.finditer(text):
        starts.append(m.start())
        words.append(m.group().lower())
    n = len(words) // SEQUENCE
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.asarray(starts[SEQUENCE : n * SEQUENCE : SEQUENCE], np.int64)
    sims = np.empty(n - 1)
    for lo in range(0, n - 1, SPAN):
        hi = min(n - 1, lo + SPAN)
        a, b = max(0, lo + 1 - BLOCK), min(n, hi + BLOCK)
        codes, _ = pd.factorize(np.asarray(words[a * SEQUENCE : b * SEQUENCE], object))
        counts = np.zeros((b - a + 1, codes.max() + 1))
        np.add.at(counts, (np.repeat(np.arange(1, b - a + 1), SEQUENCE), codes), 1.0)
        counts = counts.cumsum(axis=0)
        gaps = np.arange(lo + 1, hi + 1) - a
        left = counts[gaps] - counts[np.maximum(gaps - BLOCK, 0)]
        right = counts[np.minimum(gaps + BLOCK, b - a)] - counts[gaps]
        norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
        sims[lo:hi] = (left * right).sum(1) / np.where(norm > 0, norm, 1)
    return at, _depths(sims)


def _depths(sims: np.ndarray) -> np.ndarray:
    """Climb from each gap to the next peak on either side; the depth is the sum of both climbs."""
    n = len(sims)
    left, right = sims.copy(), sims.copy()
    for i in range(1, n):
        if left[i - 1] >= sims[i]:
            left[i] = left[i - 1] if sims[i - 1] >= sims[i] else sims[i]
    for i in range(n - 2, -1, -1):
        if right[i + 1] >= sims[i]:
            right[i] = right[i + 1] if sims[i + 1] >= sims[i] else sims[i]
    return left + right - 2 * sims


def _boundary(text: str, at: int, reach: int, lo: int, hi: int) -> int | None:
    """The natural boundary that a valley's gap is snapped to: within ``reach`` of it and of the window, the strongest kind, of
    that kind the nearest."""
    a, b = max(lo, at - reach), min(hi, at + reach)
    for kind in _BREAKS:
        ends = [m.end() for m in kind.finditer(text, a, b) if lo < m.end() <= hi]
        if ends:
            return min(ends, key=lambda e: (abs(e - at), e))
    return None


def split(text: str, limit: int = 8000, overlap: int = 200, least: float = 0.5) -> list[tuple[int, int]]:
    """Pieces ``(start, end)`` of a text in code points: none longer than ``limit``, each starting ``overlap`` before
    the end of the one before it.

    A cut lies in the window from ``least`` of the limit to the limit, at the deepest valley there (of equal depths the later
    one). A valley is known to a sequence of words; the kind of boundary only snaps it, to the strongest kind (blank
    line, line, sentence, white space) within about a sequence of it. Where a window has no valley, the strongest boundary nearest to its
    end is taken; without white space the cut is at the limit. A text within the limit is one piece.
    """
    if not 0 <= overlap < limit * least:
        raise ValueError("the overlap must be smaller than the least piece")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    at, depth = _gap_depths(text)
    # What a sequence of words takes up, on average.
    reach = int(np.clip(np.diff(at).mean(), 40, 400)) if len(at) > 1 else 120
    depth = np.round(depth, 9)
    pieces, start = [], 0
    while n - start > limit:
        lo, hi = start + max(int(limit * least), overlap + 1), start + limit
        i, j = np.searchsorted(at, lo, side="right"), np.searchsorted(at, hi, side="right")
        cut = None
        for g in i + np.lexsort((at[i:j], depth[i:j]))[::-1]:
            cut = _boundary(text, int(at[g]), reach, lo, hi)
            if cut is not None:
                break
        cut = cut or _boundary(text, hi, limit, lo, hi) or hi
        pieces.append((start, cut))
        start = cut - overlap
    pieces.append((start, n))
    return pieces


PIECE = T.StructType(
    [
        T.StructField("part_index", T.IntegerType(), False),
        T.StructField("part_total", T.IntegerType(), False),
        T.StructField("char_start", T.IntegerType(), False),
        T.StructField("char_end", T.IntegerType(), False),
        T.StructField("content", T.StringType(), False),
    ]
)


def split_oversized(items: DataFrame, key: str = "id", text: str = "content", keep: tuple[str, ...] = ("safety_blocks",), limit: int = 8000, overlap: int = 200) -> DataFrame:
    """The pieces of every item longer than ``limit``: ``(key, part_index 1..n, part_total, char_start, char_end, text, *keep)``.

    * Lengths are code points. Items within the limit, null or empty texts give no row; there's no piece without text.
    * ``keep`` columns are repeated on every piece as they are, nulls included; other columns are ignored.
    * Rows that repeat a key are split each on its own. An empty table gives an empty result.

    There is no shuffle: long texts are filtered in the scan and cut in Arrow batches of their own partition.
    """
    long = items.filter(F.length(f"`{text}`") > limit).select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept") if keep else F.lit(None).cast("string").alias("_kept")
    )

    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for t in batch:
                spans = split(t, limit, overlap)
                out.append([(i + 1, len(spans), a, b, t[a:b]) for i, (a, b) in enumerate(spans)])
            yield pd.Series(out)

    udf = F.pandas_udf(cut, T.ArrayType(PIECE))
    cutup = long.select("_key", "_kept", F.explode(udf("_text")).alias("_p"))
    kept = [F.col(f"_kept.`{c}`").alias(c) for c in keep]
    return cutup.select(F.col("_key").alias(key), "_p.part_index", "_p.part_total", "_p.char_start", "_p.char_end", F.col("_p.content").alias(text), *kept)
