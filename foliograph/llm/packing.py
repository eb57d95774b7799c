"""Problem 6: filling containers of fixed capacity (length-histogram planning).

Best fit runs over the counts of lengths, not over documents: the driver sees at most ``capacity`` numbers. The plan
says, for each length, which ranks go into which containers; documents take their slots by their rank in the length.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.session import materialise

#: White space as Unicode has it (the no-break space included), and the separators U+001C to U+001F.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+"


def token_count(text) -> F.Column:
    """Tokens of a text: longest runs of letters, digits and underscores, or of other characters but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over ``{length: count}``.

    Returns runs ``(length, first_rank, count, first_container, per_container)``: the item of that length with rank r
    (from 0) goes into container ``first_container + (r - first_rank) // per_container``. Containers that are filled
    alike stay together as ranges, so a step costs a range and not a document; a step uses up a range or a length,
    so there are at most a few runs per length.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    used = 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in free:
                bisect.insort(rooms, room)
                free[room] = []
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                break
            room = rooms[k]
            first, n = free[room].pop()
            if not free[room]:
                del free[room], rooms[k]
            take = min(n, left)
            runs.append((length, rank, take, first, 1))
            put(room, first + take, n - take)
            put(room - length, first, take)
            left, rank = left - take, rank + take
        if left:
            per = capacity // length
            whole, rest = divmod(left, per)
            runs.append((length, rank, left, used, per))
            put(capacity - per * length, used, whole)
            put(capacity - rest * length, used + whole, 1 if rest else 0)
            used += whole + (1 if rest else 0)
    return runs


def pack(docs: DataFrame, key: str, text: str, capacity: int = 1024) -> DataFrame:
    """Every document's place: ``(key, piece, n_pieces, first_token, tokens, container)``.

    * A text of at most ``capacity`` tokens is one piece and stays whole; a longer one is divided after every
      ``capacity`` tokens, and its full pieces fill a container each. ``first_token`` counts from 0.
    * A null, empty or blank text takes no room: one row with 0 tokens and a null container.
    * Rows that repeat a key are items of their own. Further columns are ignored.
    * Containers are numbered from 0 without gaps. An empty table gives an empty result.

    Scale: tokens are counted once, into a table of two narrow columns; the histogram has at most ``capacity`` rows
    and the plan a few times as many, which bounds what the driver holds and broadcasts whatever the input. Ranks
    within a length are counted in buckets of about a million items, so one length may hold any share of the items.
    """
    counted = docs.select(F.col(f"`{key}`").alias("_k"), token_count(F.col(f"`{text}`")).cast("long").alias("_n"))
    counted = materialise(counted, "tokens")
    n, last = F.col("_n"), F.col("_n") % capacity
    pieces = (
        counted.withColumn("_p", F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int"))
        .withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("_p"))))
        .withColumn("_len", F.when(F.col("piece") < F.col("_p"), F.lit(capacity)).when((n > 0) & (last == 0), F.lit(capacity)).otherwise(last).cast("int"))
    )
    total = pieces.count()
    buckets = 32 + total // 1_000_000
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("_k", "piece"), F.lit(buckets)).cast("int"))
    sizes = pieces.filter("_len > 0").groupBy("_len", "_b").agg(F.count("*").alias("_c"))
    counts = {int(r[0]): int(r[1]) for r in sizes.groupBy("_len").agg(F.sum("_c")).collect()}
    schema = T.StructType([T.StructField("_l", T.IntegerType()), T.StructField("_runs", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("r", "n", "c", "per")])))])
    by: dict[int, list] = {}
    for length, rank, m, first, per in plan(counts, capacity):
        by.setdefault(length, []).append((rank, m, first, per))
    plans = docs.sparkSession.createDataFrame(sorted(by.items()), schema)
    before = Window.partitionBy("_len").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_len").alias("_sl"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_c").over(before.partitionBy("_len")), F.lit(0)).alias("_start"))
    ranked = (
        pieces.filter("_len > 0")
        .withColumn("_r", F.row_number().over(Window.partitionBy("_len", "_b").orderBy("_k", "piece")) - 1)
        .join(starts, (F.col("_len") == F.col("_sl")) & (F.col("_b") == F.col("_sb")))
        .withColumn("_rank", F.col("_start") + F.col("_r"))
        .join(F.broadcast(plans), F.col("_len") == F.col("_l"))
        .withColumn("_run", F.filter("_runs", lambda x: (x.r <= F.col("_rank")) & (F.col("_rank") < x.r + x.n))[0])
        .withColumn("container", F.col("_run.c") + F.floor((F.col("_rank") - F.col("_run.r")) / F.col("_run.per")))
    )
    shape = [F.col("_k").alias(key), "piece", F.col("_p").alias("n_pieces"), ((F.col("piece") - 1).cast("long") * capacity).alias("first_token"), F.col("_len").alias("tokens")]
    none = pieces.filter("_len = 0").select(*shape, F.lit(None).cast("long").alias("container"))
    return ranked.select(*shape, F.col("container").cast("long").alias("container")).unionByName(none)
