"""Problem 7: evaluation texts leaking into training text (q-gram lemma filtering).

Texts are reduced to lower-case words with one space between. A stretch of ``words`` words of a passage that occurs in a document
with at most ``edits`` edited characters shares at least ``length + 1 - q - q * edits`` q-grams with it, all on neighbouring
diagonals (position in the document minus position in the passage). Shared q-grams are counted in overlapping bands of
diagonals; bands that reach the bound are kept and verified by an alignment confined to the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.llm import wordcodes as wc

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
#: Positions hashed at once, which bounds the memory of a task.
STRIDE = 1 << 19
#: Characters of passages that one pass over the documents holds; more are taken in further passes.
PASS_CHARS = 4_000_000

FOUND = T.StructType(
    [
        T.StructField("_d", T.LongType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("first_word", T.IntegerType()),
        T.StructField("words", T.IntegerType()),
        T.StructField("aligned", T.IntegerType()),
        T.StructField("edits", T.IntegerType()),
    ]
)


def normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words of the texts with one space after each, and where each text begins (one more entry at the end)."""
    codes, _, start, stop, first = wc.words(texts)
    inside = wc.alnum()[codes]
    keep = inside.copy()
    keep[stop] = True
    out = np.where(inside, codes, 32)[keep].astype(np.uint32)
    ends = np.cumsum(stop - start + 1)
    return out, np.concatenate(([0], ends))[first]


def gram_hashes(text: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling the length of the hashed pieces."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, _U)
    h, size = wc.mix(text.astype(_U) + _U(1)), 1
    out, done = None, 0
    rest = q
    while rest:
        if rest & 1:
            part = h[done : done + n]
            out = part.copy() if out is None else (out * _BASE) ^ part
            if done:
                out ^= out >> _U(31)
            done += size
        rest >>= 1
        if rest:
            h = (h[:-size] * _BASE) ^ h[size:]
            h ^= h >> _U(29)
            size *= 2
    return out * _BASE


@dataclass
class Index:
    """Q-grams of the passages with their places."""

    items: list[str]
    texts: list[np.ndarray]
    shortest: np.ndarray
    need: np.ndarray
    q: int
    edits: int
    words: int
    grams: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    at: np.ndarray
    sieve: np.ndarray

    @classmethod
    def build(cls, items: list[str], passages: list[str | None], words: int, edits: int, q: int) -> Index | None:
        flat, bounds = normal(passages)
        texts, names, shortest = [], [], []
        for name, a, b in zip(items, bounds[:-1], bounds[1:]):
            t = flat[a:b]
            ends = np.concatenate(([0], np.flatnonzero(t == 32) + 1))
            if len(ends) > words:
                texts.append(t)
                names.append(name)
                shortest.append(int((ends[words:] - ends[:-words]).min()) - 1)
        if not texts:
            return None
        least = min(shortest)
        # As many edits as leave the bound at one q-gram at least, for the passage with the shortest words.
        q = max(2, min(q, least // (edits + 1)))
        need = np.maximum(np.asarray(shortest) + 1 - q - q * edits, 1)
        h = [gram_hashes(t, q) for t in texts]
        grams = np.concatenate(h)
        item = np.repeat(np.arange(len(h)), [len(x) for x in h])
        at = np.concatenate([np.arange(len(x)) for x in h])
        order = np.argsort(grams, kind="stable")
        grams, item, at = grams[order], item[order], at[order]
        unique, begin = np.unique(grams, return_index=True)
        sieve = np.zeros(1 << _FILTER_BITS, bool)
        sieve[(unique >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls(names, texts, np.asarray(shortest), need, q, edits, words, unique, np.append(begin, len(grams)), item, at, sieve)

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose q-gram occurs in a passage, and the q-gram's number."""
        where, which = [], []
        for a in range(0, max(len(flat) - self.q + 1, 0), STRIDE):
            h = gram_hashes(flat[a : a + STRIDE + self.q - 1], self.q)
            p = np.flatnonzero(self.sieve[(h >> _U(64 - _FILTER_BITS)).view(np.int64)])
            g = np.searchsorted(self.grams, h[p])
            ok = g < len(self.grams)
            p, g = p[ok], g[ok]
            ok = self.grams[g] == h[p]
            where.append(p[ok] + a)
            which.append(g[ok])
        return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, np.int64),) * 2

    def regions(self, flat: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text, item, diagonal, first, last)`` of every band of diagonals that reaches the bound of its passage."""
        p, g = self.hits(flat)
        owner = np.searchsorted(bounds, p, side="right") - 1
        ok = p + self.q <= bounds[owner + 1]
        p, g, owner = p[ok], g[ok], owner[ok]
        # A kept stretch has the least number of hits within its own length, whatever the passage.
        least, span = int(self.need.min()), max(len(t) for t in self.texts) + self.edits
        if len(p) < least:
            return
        dense = np.zeros(len(p), bool)
        close = p[least - 1 :] - p[: len(p) - least + 1] <= span
        mark = np.concatenate((close.astype(np.int32), np.zeros(least, np.int32)))
        run = np.cumsum(mark)
        dense = run[: len(p)] - np.concatenate((np.zeros(least, np.int32), run))[: len(p)] > 0
        p, g, owner = p[dense], g[dense], owner[dense]
        count = self.begin[g + 1] - self.begin[g]
        total = int(count.sum())
        if not total:
            return
        slot = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.begin[g], count)
        doc, pos = np.repeat(owner, count), np.repeat(p, count)
        item, diag = self.item[slot], pos - self.at[slot]
        width = self.edits + 1
        band = (diag + span) // width
        doc, item, pos = np.tile(doc, 2), np.tile(item, 2), np.tile(pos, 2)
        band = np.concatenate((band, band + 1))
        order = np.lexsort((pos, band, item, doc))
        doc, item, band, pos = doc[order], item[order], band[order], pos[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(doc)))
        # Edits spoil at most q q-grams each, so the bound holds in each window as long as the shortest stretch.
        group = np.repeat(np.arange(len(first)), size)
        need = self.need[item]
        ahead = np.arange(len(pos)) + need - 1
        there = np.minimum(ahead, len(pos) - 1)
        full = (ahead < len(pos)) & (group[there] == group) & (pos[there] - pos <= need - 1 + (self.q + 1) * self.edits)
        reached = np.zeros(len(first), bool)
        reached[group[full]] = True
        # A band whose hits all lie on the half shared with the band before it adds nothing.
        last = first + size - 1
        same = np.zeros(len(first), bool)
        x, y = first[1:], first[:-1]
        same[1:] = (size[1:] == size[:-1]) & (doc[x] == doc[y]) & (item[x] == item[y]) & (band[x] == band[y] + 1) & (pos[x] == pos[y]) & (pos[last[1:]] == pos[last[:-1]])
        same[1:] &= ~same[:-1]
        for a, b in zip(first[reached & ~same], last[reached & ~same]):
            yield int(doc[a]), int(item[a]), int((band[a] - 1) * width - span), int(pos[a]), int(pos[b]) + self.q


def common_run(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int]:
    """The most consecutive equal words of two word texts on one diagonal (a's position minus b's): ``(words, start in a)``."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi <= lo:
        return 0, 0
    x, y = a[lo:hi], b[lo - shift : hi - shift]
    differ = np.concatenate(([-1], np.flatnonzero(x != y), [len(x)]))
    best = (0, 0)
    for s, e in zip(differ[:-1] + 1, differ[1:]):
        if e - s < 2:
            continue
        seg = x[s:e]
        space = np.flatnonzero(seg == 32)
        begins_a = s + lo == 0 or a[s + lo - 1] == 32
        begins_b = s + lo - shift == 0 or b[s + lo - shift - 1] == 32
        n = len(space) - (0 if begins_a and begins_b else 1)
        if n > best[0]:
            best = (n, int(s + lo + (0 if begins_a and begins_b else space[0] + 1)))
    return best


def banded(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best local alignment of each pair of texts within its band: ``(characters of b aligned, edits)``.

    ``b`` holds a passage in each row, of ``length`` characters; ``a`` the document from the lowest diagonal of the band
    on, as many characters longer as the band is wide, less one. An equal character scores 1 and an edit -4, so a
    stretch is extended over an edit where that pays.
    """
    rows, width = len(b), a.shape[1] - b.shape[1] + 1
    score, begun, cost = (np.zeros((rows, width), np.int32) for _ in range(3))
    best, aligned, edits = (np.zeros(rows, np.int32) for _ in range(3))
    for j in range(b.shape[1]):
        equal = (a[:, j : j + width] == b[:, j, None]) & (length > j)[:, None]
        now = np.where(equal, score + 1, score - 4)
        since = np.where(score > 0, begun, j)
        paid = cost + ~equal
        down = score[:, 1:] - 4 > now[:, :-1]
        now[:, :-1] = np.where(down, score[:, 1:] - 4, now[:, :-1])
        since[:, :-1] = np.where(down, begun[:, 1:], since[:, :-1])
        paid[:, :-1] = np.where(down, cost[:, 1:] + 1, paid[:, :-1])
        for k in range(1, width):
            over = now[:, k - 1] - 4 > now[:, k]
            now[:, k] = np.where(over, now[:, k - 1] - 4, now[:, k])
            since[:, k] = np.where(over, since[:, k - 1], since[:, k])
            paid[:, k] = np.where(over, paid[:, k - 1] + 1, paid[:, k])
        alive = now > 0
        score, begun, cost = now * alive, np.where(alive, since, j + 1), paid * alive
        k = score.argmax(1)
        top = score[np.arange(rows), k]
        more = top > best
        best = np.where(more, top, best)
        aligned = np.where(more, j + 1 - begun[np.arange(rows), k], aligned)
        edits = np.where(more, cost[np.arange(rows), k], edits)
    return aligned, edits


def _verify(index: Index, regions: list[tuple]) -> list[tuple]:
    """Of ``(document, item, low, lead, text)`` those whose alignment is as long as a stretch must be. ``low`` is the band's
    lowest diagonal in ``text``, and ``lead`` the number of the document's words before ``text``."""
    width = 2 * index.edits + 2
    passages = [index.texts[k] for _, k, *_ in regions]
    length = np.asarray([len(p) for p in passages])
    b = np.zeros((len(regions), int(length.max())), np.uint32)
    a = np.ones((len(regions), b.shape[1] + width - 1), np.uint32)
    for r, (_, _, low, _, text) in enumerate(regions):
        b[r, : length[r]] = passages[r]
        lo, hi = max(0, -low), min(a.shape[1], len(text) - low)
        a[r, lo:hi] = text[lo + low : hi + low]
    aligned, edits = banded(a, b, length)
    out = []
    for r, (d, k, low, lead, text) in enumerate(regions):
        if aligned[r] < index.shortest[k] - 5 * index.edits:
            continue
        words, at = max((common_run(text, passages[r], s) for s in range(low, low + width)), key=lambda x: x[0])
        out.append((d, index.items[k], lead + int((text[:at] == 32).sum()), words, int(aligned[r]), int(edits[r])))
    return out


def _scan(index: Index, ids: np.ndarray, texts: list[str | None]) -> list[tuple]:
    found: list[tuple] = []
    waiting: list[tuple] = []
    for s in wc.slices(texts):
        flat, bounds = normal(texts[s])
        own = ids[s]
        for d, k, diag, first, last in index.regions(flat, bounds):
            a0 = max(int(bounds[d]), min(first, diag) - 8 * index.edits - 8)
            a1 = min(int(bounds[d + 1]), max(last, diag + len(index.texts[k])) + 8 * index.edits + 8)
            if a0 > bounds[d]:
                back = np.flatnonzero(flat[bounds[d] : a0] == 32)
                a0 = int(bounds[d]) + (int(back[-1]) + 1 if len(back) else 0)
            lead = int((flat[bounds[d] : a0] == 32).sum())
            waiting.append((int(own[d]), k, diag - a0, lead, flat[a0:a1].copy()))
            if len(waiting) == 4096:
                found += _verify(index, waiting)
                waiting = []
    if waiting:
        found += _verify(index, waiting)
    best: dict[tuple[int, str], tuple] = {}
    for r in found:
        rank = (r[3], r[4], -r[5], -r[2])
        if r[:2] not in best or rank > best[r[:2]][0]:
            best[r[:2]] = (rank, r)
    return [r for _, r in best.values()]


def leaks(docs: DataFrame, key: str, text: str, held: DataFrame, item: str, passage: str, words: int = 15, edits: int = 1, q: int = 20) -> DataFrame:
    """Documents and the held-out items that leaked into them:
    ``(key, item_id, first_word, words, aligned, edits)``.

    ``words`` is the longest run of consecutive words common to the document and the passage, beginning at the document's
    word number ``first_word`` (from 0); ``aligned`` is the number of the passage's normalised characters in the best
    alignment and ``edits`` the edits in it. One row per pair with a verified region; a pair with ``words`` consecutive
    words in common is always among them, also with up to ``edits`` edited characters.

    * Documents without an id, null or blank texts and passages, and passages of fewer than ``words`` words, have no row.
    * A document id that occurs on several rows may have a row for each; an item's deliveries count as one item.
    * Empty tables give an empty result; other columns are ignored.

    Documents are scanned in place, without a shuffle. Held-out passages are taken in passes of at most
    ``PASS_CHARS`` characters, so what a pass sends to the executors is bounded.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{key}`").cast("long").alias("_d"), F.col(f"`{text}`").alias("_t"))
    kept = held.filter(F.col(f"`{passage}`").isNotNull()).select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{passage}`").alias("p")).distinct()
    chars = kept.agg(F.sum(F.length("p"))).first()[0] or 0
    passes = chars // PASS_CHARS + 1
    out = None
    for k in range(passes):
        part = kept if passes == 1 else kept.filter(F.pmod(F.xxhash64("i", "p"), F.lit(passes)) == k)
        rows = sorted((r.i or "", r.p) for r in part.collect())
        index = Index.build([i for i, _ in rows], [p for _, p in rows], words, edits, q)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, texts = b["_d"].to_numpy(), b["_t"].tolist()
                rows = _scan(shared.value, ids, texts)
                yield pd.DataFrame(rows, columns=FOUND.names)

        found = source.filter("_d is not null and _t is not null").mapInPandas(run, FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], FOUND)
    return out.withColumnRenamed("_d", key)
