"""Problem 3: the most similar vectors for every vector (additive quantisation).

A vector is written as a sum of full-dimensional codewords, one of each codebook, found by beam search. The first
codebook is large and its code is the vector's cell; the others hold what is left. A query looks into the cells whose
codewords are nearest to it, scores what lies there by its sums of codewords at length one (the sums of lookup tables, as
matrix products), and what comes near the best is ranked again by the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.session import materialise

LEVELS, WORDS, BEAM = 4, 64, 4
#: Every vector lies in so many cells, its nearest ones, and a query looks into so many.
CELLS, PROBES = 2, 16
#: Cells at most, and rows of the sample a cell is fitted on: 262,144 rows at most, 67 MB. Every row is indexed.
MOST_CELLS, PER_CELL, LEAST_SAMPLE = 32_768, 8, 40_000
#: Rows of a group of cells, and queries compared with them in one task, at most.
GROUP, QUERIES = 16_384, 131_072
#: Queries travel as 16-bit integers, this many to one; their cosines are exact to about 1e-5.
SHORT = 32_767
#: Queries scored together within a task.
STEP = 4096
#: Scores held at once, by a cell's rows and queries.
SCORES = 1 << 21
#: Vectors held against all cells at once, and cells whose best one is looked at first.
ROWS, RUN = 256, 64


def cells_for(n: int) -> int:
    """Cells grow with the collection to the power 0.72, as a power of two, from 16 to ``MOST_CELLS``."""
    return 1 << int(np.clip(round(np.log2(max(n, 1)) * 0.72), 4, np.log2(MOST_CELLS)))


def sample_for(cells: int) -> int:
    return max(LEAST_SAMPLE, PER_CELL * cells)


def parts_for(asks: int, groups: int, cores: int) -> int:
    """Tasks that a group's queries are divided among, each with a copy of the group: what the bound on a task's queries asks
    for, and up to three where a small collection has fewer groups than there are cores."""
    return max(1, -(-asks // QUERIES), min(3, -(-asks // 8192), -(-2 * cores // max(groups, 1))))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of ``x``; with fewer rows than centres, rows are repeated."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    block = max(256, (1 << 24) // k)
    for _ in range(rounds if k <= 4096 else rounds // 2):
        a = np.concatenate([np.argmax(x[i : i + block] @ c.T - 0.5 * (c * c).sum(1), 1) for i in range(0, len(x), block)])
        order = np.argsort(a, kind="stable")
        n = np.bincount(a, minlength=k)
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(n[some])[:-1])), axis=0) / n[some, None]
    return c


@dataclass
class Quantiser:
    cells: np.ndarray  # (cells, dims)
    books: np.ndarray  # (LEVELS, WORDS, dims)
    margin: float = 0.1

    def __post_init__(self):
        self.half = 0.5 * (self.cells**2).sum(1)
        flat = self.books.reshape(-1, self.books.shape[2])
        self.norms = (flat**2).sum(1).reshape(self.books.shape[:2])
        self.with_cells = (self.cells @ flat.T).reshape(len(self.cells), *self.books.shape[:2])
        self.gram = (flat @ flat.T).reshape(self.books.shape[0], WORDS, self.books.shape[0], WORDS)

    def probes(self, x: np.ndarray, p: int) -> np.ndarray:
        """The ``p`` nearest cells of each vector, nearest first."""
        n = len(self.cells)
        p = min(p, n)
        if p < n:
            return np.concatenate([self._probes(x[i : i + ROWS], p) for i in range(0, len(x), ROWS)] or [np.zeros((0, p), np.int64)])
        s = x @ self.cells.T - self.half
        return np.argsort(-s, axis=1, kind="stable")

    def _probes(self, x: np.ndarray, p: int) -> np.ndarray:
        s = x @ self.cells.T
        s -= self.half
        top = None
        if s.shape[1] % RUN == 0 and s.shape[1] // RUN > p:
            # The best p lie in those p runs of cells whose own best ones are the best.
            runs = s.reshape(len(x), -1, RUN)
            run = np.argpartition(runs.max(2), -p, axis=1)[:, -p:]
            top = (run[:, :, None] * RUN + np.arange(RUN)).reshape(len(x), -1)
            s = np.take_along_axis(runs, run[:, :, None], 1).reshape(len(x), -1)
        at = np.argpartition(s, -p, axis=1)[:, -p:]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)
        return at if top is None else np.take_along_axis(top, at, 1)

    def encode(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search from the given cells on: ``(cell, codes)``."""
        n, h = len(x), near.shape[1]
        cell = near.copy()
        err = 2 * self.half[cell] - 2 * np.einsum("nd,nhd->nh", x, self.cells[cell])
        codes = np.zeros((n, h, 0), np.int64)
        for m in range(len(self.books)):
            cost = (self.norms[m] - 2 * (x @ self.books[m].T))[:, None, :] + 2 * self.with_cells[cell, m]
            for j in range(m):
                cost += 2 * self.gram[j, codes[:, :, j], m]
            total = (err[:, :, None] + cost).reshape(n, -1)
            h = min(BEAM, total.shape[1])
            best = np.argpartition(total, h - 1, axis=1)[:, :h]
            err = np.take_along_axis(total, best, 1)
            from_, word = best // WORDS, best % WORDS
            cell = np.take_along_axis(cell, from_, 1)
            codes = np.concatenate((np.take_along_axis(codes, from_[:, :, None], 1), word[:, :, None]), axis=2)
        k = err.argmin(1)
        r = np.arange(n)
        return cell[r, k], codes[r, k].astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self.cells[cell].copy()
        for m in range(len(self.books)):
            out += self.books[m][codes[:, m]]
        return out


def fit(x: np.ndarray, cells: int) -> Quantiser:
    """Codebooks by k-means on residuals, then twice by least squares over all residual codebooks at once, given the beam
    search's codes. The margin is the standard deviation of the scores' errors among neighbours in the sample; what scores within two
    margins of the best goes to the exact ranking."""
    x = x.astype(np.float32)
    first = kmeans(x, cells)
    q = Quantiser(first, np.zeros((0, WORDS, x.shape[1]), np.float32))
    near = q.probes(x, BEAM)  # the cells stay as they are from here on
    left, books = x - first[near[:, 0]], []
    for m in range(LEVELS):
        c = kmeans(left, WORDS, seed=m)
        books.append(c)
        left = left - c[np.argmax(left @ c.T - 0.5 * (c * c).sum(1), 1)]
    q = Quantiser(first, np.stack(books))
    for _ in range(2):
        cell, codes = _encoded(q, x, near)
        rows = np.zeros((len(x), LEVELS * WORDS), np.float32)
        rows[np.arange(len(x))[:, None], codes + np.arange(LEVELS) * WORDS] = 1
        gram = rows.T @ rows + 0.1 * np.eye(rows.shape[1], dtype=np.float32)
        books = np.linalg.solve(gram.astype(np.float64), (rows.T @ (x - first[cell])).astype(np.float64))
        q = Quantiser(first, books.astype(np.float32).reshape(LEVELS, WORDS, -1))
    cell, codes = _encoded(q, x, near)
    back = q.decode(cell, codes)
    back /= np.maximum(np.linalg.norm(back, axis=1, keepdims=True), 1e-9)
    by = np.argsort(cell, kind="stable")
    other = np.empty(len(x), np.int64)
    other[by] = np.roll(by, 1)
    q.margin = max(float(np.std((x[other] * back).sum(1) - (x[other] * x).sum(1))), 0.02)
    return q


def _encoded(q: Quantiser, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [q.encode(x[i : i + 1024], near[i : i + 1024]) for i in range(0, len(x), 1024)]
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


def grouping(q: Quantiser, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """``(group of each cell, blocks of each group)``: cells that lie together make groups of about ``GROUP`` rows; a cell
    with more rows is a group of its own, in several blocks."""
    order: list[int] = []

    def halve(c: np.ndarray) -> None:
        if len(c) <= 2:
            order.extend(c.tolist())
            return
        x = q.cells[c] - q.cells[c].mean(0)
        axis = np.ones(x.shape[1])
        for _ in range(12):
            axis = x.T @ (x @ axis)
            axis /= max(np.linalg.norm(axis), 1e-12)
        c = c[np.argsort(x @ axis, kind="stable")]
        halve(c[: len(c) // 2])
        halve(c[len(c) // 2 :])

    halve(np.arange(len(q.cells)))
    group, blocks, size = np.zeros(len(q.cells), np.int64), [1], 0
    for c in order:
        n = counts.get(c, 0)
        if size and size + n > GROUP:
            blocks.append(1)
            size = 0
        group[c], size = len(blocks) - 1, size + n
        blocks[-1] = max(1, -(-size // GROUP))
    return group, np.asarray(blocks)


def compare(q: Quantiser, k: int, ids: np.ndarray, x: np.ndarray, cell: np.ndarray, codes: np.ndarray, qids: np.ndarray, qx: np.ndarray, probes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` most similar of ``ids`` for each query, within the cells it probes: ``(query number, id, cosine)``."""
    order = np.argsort(cell, kind="stable")
    ids, x, cell, codes = ids[order], x[order], cell[order], codes[order].astype(np.int64)
    present, begin = np.unique(cell, return_index=True)
    ends = np.append(begin[1:], len(cell))
    # Sums of codewords at length one: their products with a query are the sums of its table entries times the stored norms.
    back = q.decode(cell, codes)
    back /= np.maximum(np.linalg.norm(back, axis=1, keepdims=True), 1e-9)
    out = [_compare(q, k, ids, x, back, present, begin, ends, qids[i : i + STEP], qx[i : i + STEP], probes[i : i + STEP], i) for i in range(0, len(qids), STEP)]
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _compare(q, k, ids, x, back, present, begin, ends, qids, qx, probes, base):
    sizes = np.fromiter(map(len, probes), np.int64, len(probes))
    flat = np.concatenate(probes)
    who = np.repeat(np.arange(len(probes)), sizes)
    nearest = np.zeros(len(flat), bool)
    nearest[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    by = np.argsort(flat, kind="stable")
    flat, who, nearest = flat[by], who[by], nearest[by]
    lows, highs = np.searchsorted(flat, present), np.searchsorted(flat, present, side="right")
    asker = np.argsort(qids, kind="stable")
    mine = asker[np.minimum(np.searchsorted(qids, ids, sorter=asker), len(qids) - 1)]
    mine[qids[mine] != ids] = -1  # of each row, its own query
    floor, least = (np.full(len(qids), -2.0, np.float32) for _ in range(2))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def visit(a: int, b: int, qs: np.ndarray, bare: bool) -> None:
        """A cell's rows (down) for queries (across). What comes within two margins of the floor of scores is held by the
        vectors themselves against the k-th best so far; where queries are ``bare`` of floors, the cell sets them."""
        s, e = back[a:b] @ qx[qs].T, x[a:b] @ qx[qs].T
        at = np.minimum(np.searchsorted(qs, mine[a:b]), len(qs) - 1)
        own = np.flatnonzero(qs[at] == mine[a:b])
        s[own, at[own]] = e[own, at[own]] = -3.0
        if bare and b - a >= k:
            floor[qs] = _kth(s, k)
        near = s >= floor[qs] - 2 * q.margin
        if bare and b - a >= k:
            least[qs] = _kth(np.where(near, e, np.float32(-3.0)), k)
        near &= e >= np.maximum(least[qs] - 1e-4, -2.5)
        hit = np.flatnonzero(near)
        found.append((qs[hit % len(qs)], a + hit // len(qs)))

    # Each query's first cell sets what the others must come near to; the rest only has to pass it.
    for first in (True, False):
        for a, b, lo, hi in zip(begin, ends, lows, highs):
            qs = who[lo:hi][nearest[lo:hi] == first]
            without = floor[qs] < -1
            width = max(1, SCORES // (b - a))
            for some, bare in ((qs[without], True), (qs[~without], False)):
                for i in range(0, len(some), width):
                    visit(a, b, some[i : i + width], bare)
    qn, dn = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    # A row that was met in two of its cells counts once.
    _, number = np.unique(ids, return_inverse=True)
    _, once = np.unique(qn.astype(np.int64) * len(ids) + number[dn], return_index=True)
    qn, dn = qn[once], dn[once]

    def exact(kind) -> np.ndarray:
        parts = [np.einsum("nd,nd->n", qx[qn[i : i + 65536]].astype(kind), x[dn[i : i + 65536]].astype(kind)) for i in range(0, len(qn), 65536)]
        return np.concatenate(parts or [np.zeros(0, kind)])

    # Single precision first; what it can't set apart from the last place is settled in double precision.
    cos = exact(np.float32)
    order = np.lexsort((-cos, qn))
    qn, dn, cos = qn[order], dn[order], cos[order]
    begin = np.searchsorted(qn, qn)
    last = np.minimum(begin + k - 1, np.searchsorted(qn, qn, side="right") - 1)
    near = cos >= cos[last] - 1e-5
    qn, dn = qn[near], dn[near]
    cos = exact(np.float64)
    order = np.lexsort((ids[dn], -cos, qn))
    qn, dn, cos = qn[order], dn[order], cos[order]
    top = np.arange(len(qn)) - np.searchsorted(qn, qn) < k
    return qn[top] + base, ids[dn[top]], cos[top]


ENCODED = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("x", T.BinaryType()), T.StructField("short", T.BinaryType()), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("codes", T.ArrayType(T.BinaryType())), T.StructField("probes", T.ArrayType(T.IntegerType()))]
)
HITS = "id long, neighbour long, cosine double"


def usable(v: str, dims: int) -> F.Column:
    """Whether a vector has ``dims`` finite values that aren't all zero."""
    return (
        F.col(v).isNotNull()
        & (F.size(v) == dims)
        & F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
        & F.exists(v, lambda a: a != 0)
    )


def neighbours(items: DataFrame, key: str, vector: str, version: str | None = None, k: int = 5, dims: int = 64, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """For every usable vector the ``k`` most similar others by cosine: ``(id, neighbour, cosine, place)``.

    * Unusable vectors (null, of another length, not finite, all zero) are neither queries nor neighbours; nor are
      rows without an id.
    * ``version`` orders deliveries of one id, the last counts. Of equal cosines the smaller id goes first.
    * With fewer than ``k`` other vectors all are returned; an empty table gives an empty result.
    * The result is approximate: every vector lies in its ``CELLS`` nearest cells, and a query sees the rows of its ``probes``
      nearest ones. In those nothing is capped. ``exact`` looks into all cells and ranks all rows by the vectors themselves,
      at a cost that grows with the square of the collection.

    Copies of a vector are one point of the index, with the ``k + 1`` smallest ids of its rows, which is all that any
    query can need; so a third of all rows may be copies. Cells are gathered in groups of bounded size, large cells are
    divided, and queries come in bounded blocks, so that no task holds more than ``GROUP`` rows and ``QUERIES`` queries.
    A query goes to the groups of its cells, at most ``probes`` of them, and a group to every ``QUERIES`` queries, so what is
    shuffled for a vector is bounded whatever the size of the collection. The driver fits the codebooks on at most
    ``PER_CELL * MOST_CELLS`` rows and holds one count per cell and group.
    """
    spark = items.sparkSession
    at = F.col(f"`{version}`") if version else F.lit(0)
    rows = items.select(F.col(f"`{key}`").cast("long").alias("id"), at.alias("at"), F.col(f"`{vector}`").cast("array<float>").alias("v"))
    rows = rows.filter("id is not null").groupBy("id").agg(F.max(F.struct("at", "v")).alias("r")).select("id", F.col("r.v").alias("v")).filter(usable("v", dims))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.hash("v"))
    rows = materialise(rows, "usable")
    points = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min(F.struct("id", "v")).alias("f")).select("h1", "h2", "rep", "n", F.col("f.v").alias("v"))
    total = rows.count()
    most = sample_for(cells_for(total))
    part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(total, 1))) < int(0.97 * most)).limit(most)
    sample = _matrix(part, dims)
    if total == 0:
        return spark.createDataFrame([], "id long, neighbour long, cosine double, place int")
    q = fit(sample if len(sample) else np.eye(1, dims, dtype=np.float32), cells_for(total))
    copies = 1 if exact else CELLS
    if exact:
        q.margin, probes = 3.0, len(q.cells)
    shared = spark.sparkContext.broadcast(q)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for b in batches:
            for i in range(0, len(b), 1024):
                p = b.iloc[i : i + 1024]
                x = unit(np.stack(p["v"].to_numpy()))
                near = q.probes(x, probes)
                coded = [q.encode(x, near[:, j : j + 1])[1] for j in range(min(copies, near.shape[1]))]
                codes = [[c[r].tobytes() for c in coded] for r in range(len(x))]
                yield pd.DataFrame({"id": p["id"].to_numpy(), "x": [r.tobytes() for r in x], "short": [r.tobytes() for r in np.rint(x * SHORT).astype(np.int16)], "cells": list(near[:, :copies].astype(np.int32)), "codes": codes, "probes": list(near.astype(np.int32))})

    index = materialise(points.select(F.col("rep").alias("id"), "v").mapInPandas(encode, ENCODED), "encoded")
    counts = {r.cell: r["count"] for r in index.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}
    group, blocks = grouping(q, counts)
    lookup = F.lit(group.astype(int).tolist())
    wanted = index.select(F.col("id").alias("qid"), F.col("short").alias("qx"), "probes", F.explode(F.array_distinct(F.transform("probes", lambda c: lookup[c]))).alias("g"))
    asked = {r.g: r["count"] for r in wanted.groupBy("g").count().collect()}
    parts = np.asarray([parts_for(asked.get(g, 0), len(blocks), spark.sparkContext.defaultParallelism) for g in range(len(blocks))])
    sizes = F.broadcast(spark.createDataFrame(pd.DataFrame({"g": np.arange(len(blocks)), "blocks": blocks, "parts": parts}).astype("int32")))
    # Cogrouped keys must agree in type, or equal keys fall into different partitions.
    key_cols = [F.col(c).cast("int").alias(c) for c in ("g", "d", "p")]
    data = (
        index.select("id", "x", F.explode(F.arrays_zip("cells", "codes")).alias("z"))
        .select("id", "x", F.col("z.cells").alias("cell"), F.col("z.codes").alias("codes"), lookup[F.col("z.cells")].alias("g"))
        .join(sizes, "g")
        .withColumn("d", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*key_cols, "id", "x", "cell", "codes")
    )
    asks = (
        wanted.join(sizes, "g")
        .withColumn("p", F.pmod(F.xxhash64("qid", F.lit(1)), F.col("parts")).cast("int"))
        .withColumn("d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("probes", F.filter("probes", lambda c: lookup[c] == F.col("g")))
        .select(*key_cols, "qid", "qx", "probes")
    )

    def search(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(a):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        x = np.frombuffer(b"".join(d["x"]), np.float32).reshape(len(d), -1)
        qx = unit(np.frombuffer(b"".join(a["qx"]), np.int16).reshape(len(a), -1))
        codes = np.frombuffer(b"".join(d["codes"]), np.uint8).reshape(len(d), -1)
        qids = a["qid"].to_numpy()
        n, near, cos = compare(shared.value, k, d["id"].to_numpy(), x, d["cell"].to_numpy(), codes, qids, qx, a["probes"].tolist())
        return pd.DataFrame({"id": qids[n], "neighbour": near, "cosine": cos})

    # A block is heavy in computing and light in bytes, so blocks aren't put together by size: the number is stated.
    tasks = int(4 * (blocks * parts).sum())
    left, right = data.repartition(tasks, "g", "d", "p"), asks.repartition(tasks, "g", "d", "p")
    hits = left.groupBy("g", "d", "p").cogroup(right.groupBy("g", "d", "p")).applyInPandas(search, HITS)
    better = lambda a, b: F.when(a.cosine > b.cosine, -1).when(a.cosine < b.cosine, 1).when(a.id < b.id, -1).when(a.id > b.id, 1).otherwise(0)
    met = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("cosine", F.col("neighbour").alias("id"))), better).alias("met"))
    # A row in two cells may come from two groups: the first of each id counts.
    first = F.slice(F.array_distinct(F.transform("met", lambda e: e["id"])), 1, k)
    best = met.select("id", F.transform(first, lambda i: F.struct(F.get(F.filter("met", lambda e: e["id"] == i), F.lit(0))["cosine"].alias("cosine"), i.alias("id"))).alias("near"))
    several = points.filter("n > 1").select("h1", "h2", "rep")
    copied = materialise(rows.select("id", "h1", "h2").join(several, ["h1", "h2"]).select("id", "rep"), "copies")
    if copied.isEmpty():
        out = best.select("id", F.posexplode("near").alias("i", "e"))
        return out.select("id", F.col("e.id").alias("neighbour"), F.col("e.cosine").alias("cosine"), (F.col("i") + 1).alias("place"))
    # Of each point the k + 1 smallest ids stand for all; limits per task come before the shuffle.
    w = Window.partitionBy("rep").orderBy("id")
    heads = copied.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    spread = best.select("id", F.explode("near").alias("e")).select("id", F.col("e.id").alias("rep"), F.col("e.cosine").alias("cosine"))
    spread = spread.join(heads, "rep", "left").select("id", "cosine", F.explode(F.coalesce("ids", F.array("rep"))).alias("o"))
    own = heads.select(F.col("rep").alias("id"), F.lit(1.0).alias("cosine"), F.explode("ids").alias("o"))
    lists = spread.unionByName(own).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("cosine", F.col("o").alias("id"))), better), 1, k + 1 + k).alias("near"))
    members = copied.unionByName(best.select("id", F.col("id").alias("rep")).join(copied.select("rep").distinct(), "rep", "left_anti").select("id", "rep"))
    joined = members.join(lists.select(F.col("id").alias("rep"), "near"), "rep")
    final = joined.select("id", F.slice(F.filter("near", lambda e: e.id != F.col("id")), 1, k).alias("near"))
    out = final.select("id", F.posexplode("near").alias("i", "e"))
    return out.select("id", F.col("e.id").alias("neighbour"), F.col("e.cosine").alias("cosine"), (F.col("i") + 1).alias("place"))


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column, -2 at least."""
    return np.maximum(np.partition(np.ascontiguousarray(s.T), len(s) - k, axis=1)[:, len(s) - k], -2.0)


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length one; the largest value is divided out first, so that no square overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _matrix(part: DataFrame, dims: int) -> np.ndarray:
    col = part.select("v").toArrow()["v"].combine_chunks()
    flat = np.asarray(col.flatten(), np.float64)
    return unit(flat.reshape(-1, dims)) if len(flat) else np.zeros((0, dims), np.float32)
