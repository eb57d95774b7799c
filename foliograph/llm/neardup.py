"""Problem 5: near-duplicate records with small edits (multi-index Hamming join).

A record's signature is a row of minwise hashes over its word shingles, ``SYMBOLS`` symbols long; the distance of two
signatures is the number of symbols in which they differ. The signature is cut into ``CHUNKS`` chunks of five symbols.
By the pigeonhole principle, two records within ``FAR`` differ in at most ``ERRORS`` symbols of some chunk, so leaving
out, in each chunk and in every way, that many symbols gives a key in which the two agree. Pairs met are held against a
sketch of two bits of ``SKETCH`` minwise hashes, and then against the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.llm import wordcodes as wc
from foliograph.session import materialise

SYMBOLS, CHUNKS, ERRORS = 50, 10, 2
#: Pairs within this distance share a key without exception. Pairs beyond it that share one are compared as well: at the
#: similarity 0.6 a pair shares none with a probability of 1e-5, at 0.65 of 5e-7.
FAR = CHUNKS * (ERRORS + 1) - 1
#: Minwise hashes in the sketch, two bits of each, and in how many of them a pair may differ: at the similarity 0.6 a pair
#: differs in 38 on average, with a standard deviation of 5.2; in more than 63 with a probability of about 1e-6.
SKETCH, SKETCH_FAR = 128, 63
#: A key met by more representatives is refined by further symbols.
HOT = 256
#: Share of the representatives on which hot keys are looked for: one in so many. It decides only how a key is treated.
LOOK = 8
#: Representatives of one key, or links of one text, that are compared in one piece.
BLOCK = 1024
#: Shingles held at once when pairs are compared by text.
HELD = 1 << 20

_SEEDS = wc.mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_PACKED = [f"p{i}" for i in range(SKETCH // 32)]
SIGNED = T.StructType(
    [
        T.StructField("_id", T.LongType()),
        T.StructField("_v", T.StructType([T.StructField("at", T.TimestampType()), T.StructField("h", T.LongType())])),
        T.StructField("_n", T.IntegerType()),
        T.StructField("_fp", T.ArrayType(T.LongType())),
        T.StructField("_sig", T.ArrayType(T.IntegerType())),
        T.StructField("_packed", T.ArrayType(T.LongType())),
    ]
)


def signatures(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minwise hashes ``(texts, SKETCH)`` of 32 bits; texts without shingles have zeros."""
    n = np.diff(first)
    some = np.flatnonzero(n > 0)
    out = np.zeros((len(n), SKETCH), np.uint32)
    if not len(some):
        return out
    at = first[:-1][some]
    for k, seed in enumerate(_SEEDS):
        x = (s ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        out[some, k] = (np.minimum.reduceat(x, at) >> np.uint64(20)).astype(np.uint32)
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of every minwise hash, 32 hashes to a 64-bit integer: ``(texts, SKETCH // 32)``."""
    two = (sig & np.uint32(3)).astype(np.uint64).reshape(len(sig), SKETCH // 32, 32)
    return np.bitwise_or.reduce(two << np.arange(0, 64, 2, dtype=np.uint64), axis=2).view(np.int64)


def kept() -> list[tuple[int, ...]]:
    """Symbols of each key: those of one chunk but ``ERRORS``. Chunk ``c`` has every ``CHUNKS``-th symbol from ``c`` on."""
    return [left for c in range(CHUNKS) for left in combinations(range(c, SYMBOLS, CHUNKS), SYMBOLS // CHUNKS - ERRORS)]


def refined() -> tuple[list[list[int]], list[tuple[int, int]]]:
    """``(the symbols that are not in each key, pairs of places among them)``.

    Records within ``FAR`` that share a key agree in at least ``SYMBOLS - FAR - 3`` of the other symbols, 18 of 47. Cut into one chunk
    fewer than that, they agree in two symbols of some chunk; the pairs are those within a chunk.
    """
    keys = kept()
    others = [[x for x in range(SYMBOLS) if x not in key] for key in keys]
    chunks = SYMBOLS - FAR - len(keys[0]) - 1
    return others, [two for c in range(chunks) for two in combinations(range(c, len(others[0]), chunks), 2)]


def _table(rows: list[tuple[int, ...]], *names: str) -> F.Column:
    """A literal array of structs, one a row, for ``inline``."""
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, row)]) for row in rows])


def keyed(reps: DataFrame) -> DataFrame:
    """Every representative under each of its keys: ``(id, p0.., _sig, n, key)``."""
    numbered = [(n, *symbols) for n, symbols in enumerate(kept())]
    rows = reps.select(F.col("_rep").alias("id"), *[F.col("_packed")[i].alias(p) for i, p in enumerate(_PACKED)], "_sig", F.inline(_table(numbered, "n", "a", "b", "c")))
    return rows.select("id", *_PACKED, "_sig", "n", F.xxhash64("n", F.col("_sig")[F.col("a")], F.col("_sig")[F.col("b")], F.col("_sig")[F.col("c")]).alias("key"))


def signed(items: DataFrame, size: int) -> DataFrame:
    """Of every row of ``(_id, _v, _text)`` its number of shingles, a 128-bit fingerprint of their set, its signature and
    its sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for part in wc.slices(whole["_text"].tolist()):
                b = whole.iloc[part]
                codes, _, start, stop, first = wc.words(b["_text"].tolist())
                s, first = wc.shingles(wc.word_hashes(codes, start, stop), first, size)
                sig = signatures(s, first)
                n = np.diff(first)
                fp = np.zeros((len(n), 2), np.uint64)
                for j, x in enumerate((s, wc.mix(s ^ np.uint64(0x5851F42D4C957F2D)))):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
                    fp[:, j] = total[first[1:]] - total[first[:-1]]
                symbols = np.ascontiguousarray(sig[:, :SYMBOLS]).view(np.int32)
                yield pd.DataFrame({"_id": b["_id"], "_v": b["_v"], "_n": n.astype(np.int32), "_fp": list(fp.view(np.int64)), "_sig": list(symbols), "_packed": list(sketches(sig))})

    return items.mapInPandas(run, SIGNED)


def _differ(a: str, b: str) -> F.Column:
    """Minwise hashes in which two sketches differ."""
    total = F.lit(0)
    low = F.lit(0x5555555555555555).cast("long")
    for p in _PACKED:
        x = F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
    return total


def _broadcast_if(small: DataFrame, rows: int) -> DataFrame:
    """A table of two numbers a row, broadcast up to 100,000 rows (2 MB), else joined by a shuffle."""
    return F.broadcast(small) if rows < 100_000 else small


def candidates(reps: DataFrame, far: int = SKETCH_FAR) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of representatives that share a key and whose sketches lie within ``far``.

    The representatives of a hot key are not compared all with all: they get further keys of two more symbols each, which
    pairs within ``FAR`` share too, so that comparisons grow with the number of records and not with its square. A refined
    key that is still hot holds records that agree in five symbols; its rows fall into blocks, every two of which
    are compared in a task of their own, so that no task holds a whole hot key and no pair is lost.
    """
    flat = keyed(reps)
    seen = flat.filter(F.pmod(F.xxhash64("id"), F.lit(LOOK)) == 0)
    warm = materialise(seen.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > HOT // LOOK).select("key"), "hotkeys")
    few = warm.count()
    narrow = flat.select("key", "id", *_PACKED)
    if not few:
        # No key is hot: one shuffle by key serves both sides.
        return _pairs(narrow.alias("x"), narrow.alias("y"), ["key"], far)
    cold = narrow.join(_broadcast_if(warm, few), "key", "left_anti")
    others, twos = refined()
    lookup = F.lit(others)
    # A literal of all keys' other symbols; the row's key says which apply.
    more = flat.join(_broadcast_if(warm, few), "key").withColumn("_o", lookup[F.col("n")])
    more = more.select("key", "id", *_PACKED, "_sig", "_o", F.inline(_table([(m, *two) for m, two in enumerate(twos)], "m", "i", "j")))
    more = more.select("id", *_PACKED, F.xxhash64("key", "m", F.col("_sig")[F.col("_o")[F.col("i")]], F.col("_sig")[F.col("_o")[F.col("j")]]).alias("key"))
    more = materialise(more, "refined")
    still = materialise(more.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "hotkeys")
    few = still.count()
    found = _pairs(cold.alias("x"), cold.alias("y"), ["key"], far)
    if not few:
        return found.unionByName(_pairs(more.alias("x"), more.alias("y"), ["key"], far)).distinct()
    joined = more.join(_broadcast_if(still, few), "key", "left")
    rest = joined.filter("blocks is null").drop("blocks")
    found = found.unionByName(_pairs(rest.alias("x"), rest.alias("y"), ["key"], far))
    split = joined.filter("blocks is not null").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    b = _blocked(split, ["key"], "id", _PACKED).filter(_differ("x", "y") <= far).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return found.unionByName(b).distinct()


def _blocked(rows: DataFrame, on: list[str], id: str, payload: list[str]) -> DataFrame:
    """Rows ``x`` and ``y`` of one key that differ in ``id``, each two once: every two blocks of a key (``own`` of ``blocks``)
    meet under a key of their own; within a block the smaller id is ``x``."""
    other = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = other.select(*on, F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", id, *payload)
    x, y = spread.filter("own = i").alias("x"), spread.filter("own = j").alias("y")
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*on, "i", "j")])
    return met.filter((F.col("x.i") < F.col("x.j")) | (F.col(f"x.{id}") < F.col(f"y.{id}")))


def _pairs(x: DataFrame, y: DataFrame, on: list[str], far: int) -> DataFrame:
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on] + [F.col("x.id") < F.col("y.id")])
    return met.filter(_differ("x", "y") <= far).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Pairs with their similarity by the texts themselves, where it is at least ``least``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            # Every text of a batch is cut into shingles once, however many pairs it is in.
            ids = np.concatenate((whole["a"].to_numpy(), whole["b"].to_numpy()))
            _, first_seen, number = np.unique(ids, return_index=True, return_inverse=True)
            both = whole["ta"].tolist() + whole["tb"].tolist()
            distinct = [both[i] for i in first_seen]
            sets: list[np.ndarray] = []
            for part in wc.slices(distinct):
                codes, _, start, stop, first = wc.words(distinct[part])
                s, first = wc.shingles(wc.word_hashes(codes, start, stop), first, size)
                sets += [s[i:j] for i, j in zip(first[:-1], first[1:])]
            sizes = np.asarray([len(x) for x in sets])
            left, right = number[: len(whole)], number[len(whole) :]
            weight = np.cumsum(sizes[left] + sizes[right]) // HELD
            for k in np.unique(weight):
                rows = np.flatnonzero(weight == k)
                s = np.concatenate([sets[i] for i in left[rows]] + [sets[i] for i in right[rows]])
                pair = np.concatenate((np.repeat(np.arange(len(rows)), sizes[left[rows]]), np.repeat(np.arange(len(rows)), sizes[right[rows]])))
                order = np.lexsort((s, pair))
                s, pair = s[order], pair[order]
                same = (s[1:] == s[:-1]) & (pair[1:] == pair[:-1])
                shared = np.bincount(pair[1:][same], minlength=len(rows))
                union = sizes[left[rows]] + sizes[right[rows]] - shared
                # In whole numbers, so that a share that equals the threshold isn't lost to rounding.
                keep = (union > 0) & (shared * 10_000 >= round(least * 10_000) * union)
                yield pd.DataFrame({"a": whole["a"].to_numpy()[rows[keep]], "b": whole["b"].to_numpy()[rows[keep]], "similarity": shared[keep] / union[keep]})

    hot = pairs.select(F.explode(F.array("a", "b")).alias("_id")).groupBy("_id").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK)
    hot = materialise(hot.select("_id", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "hottexts")
    few = hot.count()
    met = _with_text(_with_text(pairs, "a", "b", "ta", texts, hot, few), "b", "a", "tb", texts, hot, few)
    return met.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long, similarity double")


def _with_text(pairs: DataFrame, own: str, other: str, name: str, texts: DataFrame, hot: DataFrame, few: int) -> DataFrame:
    """Pairs with the text of one side. A text in many pairs is sent once for every ``BLOCK`` of them, so that its pairs
    don't fall into one task."""
    t = texts.select(F.col("_id").alias(own), F.col("_text").alias(name))
    if not few:
        return pairs.join(t, own)
    small = _broadcast_if(hot.withColumnRenamed("_id", own), few)
    salt = F.pmod(F.xxhash64(other), F.coalesce("blocks", F.lit(1))).cast("int")
    left = pairs.join(small, own, "left").withColumn("_s", salt).drop("blocks")
    right = t.join(small, own, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return left.join(right, [own, "_s"]).drop("_s")


class NearDuplicates:
    """The near duplicates of a table.

    ``members``: ``(id, rep, n)``: each item with the smallest id whose set of shingles is the same, and its number of
    shingles. ``links``: ``(a, b, similarity)``, a < b: all pairs of representatives whose shingle sets share at least
    ``least`` of their union.

    * Words are runs of letters and digits in lower case. A null text is empty; a text with fewer than ``size`` words
      is its own representative and has no link.
    * ``version`` names the column that orders deliveries of one id; the last counts. Rows without an id and other columns are ignored.
    * An empty table gives empty results.
    """

    def __init__(self, items: DataFrame, key: str, text: F.Column, version: str | None = None, size: int = 5, least: float = 0.8):
        self.size, self.least = size, least
        at = F.col(f"`{version}`").cast("timestamp") if version else F.lit(None).cast("timestamp")
        source = items.select(F.col(f"`{key}`").cast("long").alias("_id"), at.alias("_at"), text.alias("_text")).filter("_id is not null")
        source = source.withColumn("_v", F.struct(F.col("_at").alias("at"), F.xxhash64("_text").alias("h"))).drop("_at")
        rows = signed(source.select("_id", "_v", "_text"), size)
        rest = [c for c in rows.columns if c != "_id"]
        rows = rows.groupBy("_id").agg(F.max(F.struct(*rest)).alias("_r")).select("_id", "_r.*")
        rows = materialise(rows, "signed")
        groups = rows.filter("_n > 0").groupBy("_fp", "_n").agg(F.min("_id").alias("_rep"), F.count("*").alias("_c"), F.min(F.struct("_id", "_packed", "_sig")).alias("_f"))
        reps = materialise(groups.select("_fp", "_n", "_rep", "_c", "_f._packed", "_f._sig"), "representatives")
        #: Sets of shingles that occur more than once: their fingerprint, representative and number of items.
        self.copied = reps.filter("_c > 1").select(F.col("_fp")[0].alias("_f0"), F.col("_fp")[1].alias("_f1"), "_n", "_rep", "_c")
        few = self.copied.count()
        # Items of a set with many copies are spread over as many keys as it has blocks of them, if it isn't broadcast.
        small = self.copied.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15)))) if few >= 100_000 else F.broadcast(self.copied.withColumn("_s", F.lit(0)))
        salt = F.pmod(F.xxhash64("_id"), F.lit(16)).cast("int") if few >= 100_000 else F.lit(0)
        plain = rows.select(F.col("_id").alias("id"), F.col("_fp")[0].alias("_f0"), F.col("_fp")[1].alias("_f1"), "_n", salt.alias("_s"))
        self.members = plain.join(small, ["_f0", "_f1", "_n", "_s"], "left").select(
            "id", F.coalesce("_rep", "id").alias("rep"), F.col("_n").alias("n"), F.coalesce("_c", F.lit(1)).alias("copies")
        )
        found = materialise(candidates(reps), "candidates")
        need = found.select(F.explode(F.array("a", "b")).alias("_id")).distinct().join(rows.select("_id", F.col("_v.h").alias("_h")), "_id")
        texts = source.select("_id", F.col("_v.h").alias("_h"), "_text").join(need, ["_id", "_h"]).groupBy("_id").agg(F.first("_text").alias("_text"))
        self.links = materialise(_verified(found, texts, size, least), "links")

    def pairs(self) -> DataFrame:
        """All pairs ``(id_a, id_b)``, id_a < id_b, copies written out: links times members, and copies of one text.

        Copies of one text meet in blocks of ``BLOCK``, each two blocks in a task of their own; the copies that a link
        multiplies by are spread over the blocks of its other end.
        """
        m = self.members.filter("n > 0").withColumn("blocks", F.ceil(F.col("copies") / BLOCK).cast("int"))
        many = m.filter("copies > 1").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        many = materialise(many.select("id", "rep", "own", "blocks"), "copies")
        across = self.links.select("a", "b")
        for end, whole in (("a", "wa"), ("b", "wb")):
            # A representative with one item is its own; the others' items come in by block.
            some = many.select(F.col("rep").alias(end), F.col("own").alias(f"_{end}"), F.col("id").alias(whole))
            count = self.copied.select(F.col("_rep").alias(end), F.ceil(F.col("_c") / BLOCK).cast("int").alias("_blocks"))
            left = across.join(count, end, "left").withColumn(f"_{end}", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
            met = left.join(some, [end, f"_{end}"], "left").withColumn(whole, F.when(F.col("_blocks").isNull(), F.col(end)).otherwise(F.col(whole)))
            across = met.filter(F.col(whole).isNotNull()).drop(f"_{end}", "_blocks")
        across = across.select(F.least("wa", "wb").alias("id_a"), F.greatest("wa", "wb").alias("id_b"))
        same = _blocked(many, ["rep"], "id", []).select(F.least("x.id", "y.id").alias("id_a"), F.greatest("x.id", "y.id").alias("id_b"))
        return across.unionByName(same)

    def spread(self, values: DataFrame) -> DataFrame:
        """Every item with the values of its representative, null where there are none: ``values`` has one row per ``rep``.

        Items of copied texts take theirs over 16 salts, as one text may have a third of all items.
        """
        single = self.members.filter("copies = 1").join(values, "rep", "left")
        some = values.join(self.copied.select(F.col("_rep").alias("rep")), "rep", "left_semi").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15))))
        many = self.members.filter("copies > 1").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(some, ["rep", "_s"], "left").drop("_s")
        return single.unionByName(many)
