"""The queries of the eight problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.sources.tables import latest, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from foliograph.llm.ranking import ranked

    rows = table(spark, folder, "retrieved_chunks")
    return ranked(rows, "ask_id", "chunk_id", top=5).select("ask_id", "chunk_id")


def p2_ranking(spark: SparkSession, folder: str) -> DataFrame:
    from foliograph.llm.ranking import ranked

    out = ranked(table(spark, folder, "retrieved_chunks"), "ask_id", "chunk_id")
    return out.withColumn("closeness", F.round("closeness", 6))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized chunk, of its last delivery."""
    from foliograph.llm.segmentation import split_oversized

    chunks = table(spark, folder, "chunks")
    # Deliveries are settled on narrow rows; of the texts, only the long ones travel.
    mark = F.struct("created_at", F.xxhash64("content"), F.length("content").alias("n"))
    last = chunks.groupBy("id").agg(F.max(mark).alias("_last")).filter("_last.n > 8000").withColumnRenamed("id", "_lid")
    long = chunks.select("id", "created_at", "content", "safety_blocks").filter(F.length("content") > 8000)
    long = long.join(last, (F.col("id") == F.col("_lid")) & (mark == F.col("_last")))
    once = long.groupBy("id").agg(F.first(F.struct("content", "safety_blocks")).alias("_r")).select("id", "_r.*")
    return split_oversized(once)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pieces(spark, folder).filter("part_index = 2").select("id")


def p4_sound(spark: SparkSession, folder: str) -> DataFrame:
    """Of every oversized chunk, whether its pieces keep the limit, share 200 characters with the next, give the text back when
    put together, and keep the safety blocks."""
    pieces = p4_pieces(spark, folder)
    chunks = table(spark, folder, "chunks")
    last = chunks.groupBy("id").agg(F.max(F.struct("created_at", F.xxhash64("content"), "content", "safety_blocks")).alias("r")).select("id", "r.content", F.col("r.safety_blocks").alias("blocks"))
    by = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part_index", "char_start", "char_end", "content", "safety_blocks"))).alias("p"), F.max("part_total").alias("n"))
    x = by.join(last.filter(F.length("content") > 8000).withColumnRenamed("content", "whole"), "id")
    steps = F.slice("p", 2, F.size("p") - 1)
    back = F.aggregate(steps, F.get("p", F.lit(0))["content"], lambda a, e: F.concat(a, e["content"].substr(F.lit(201), F.length(e["content"]))))
    return x.select(
        "id",
        (F.size("p") == F.col("n")).alias("complete"),
        F.forall("p", lambda e: F.length(e["content"]) <= 8000).alias("within"),
        (back == F.col("whole")).alias("whole"),
        F.forall("p", lambda e: e["safety_blocks"].eqNullSafe(F.col("blocks"))).alias("kept"),
    )


def p5_near(spark: SparkSession, folder: str):
    from foliograph.llm.neardup import NearDuplicates

    text = F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("content", F.lit("")))
    return NearDuplicates(table(spark, folder, "chunks"), "id", text, version="created_at", size=3, least=0.6)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_near(spark, folder).pairs()


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    from foliograph.llm.packing import pack

    return pack(table(spark, folder, "documents"), "doc_id", "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that take a container whole, of those placed in containers by rank within length, and go on in another."""
    placed = p6_containers(spark, folder).filter("container is not null and n_pieces > 1")
    return placed.groupBy("doc_id").agg(F.countDistinct("container").alias("containers")).filter("containers > 1").select("doc_id")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How the containers came out: pieces placed, their tokens, containers, the fullest, the least number that could do."""
    placed = p6_containers(spark, folder).filter("container is not null")
    each = placed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("c"))
    return each.agg(F.sum("c").alias("pieces"), F.sum("t").alias("tokens"), (F.max("t") <= 1024).alias("within"), (F.count("*") <= F.ceil(F.sum("t") * 1.01 / 1024) + 1).alias("tight"), (F.max("container") + 1 == F.count("*")).alias("gapless"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_ranking, p4_found, p4_pieces, p4_sound, p5_found, p6_found, p6_containers, p6_fill)
}


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    from foliograph.llm.leakage import leaks

    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "heldout_passages"), "item_id", "passage")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The exact check after the alignment: fifteen consecutive words of the passage."""
    return p7_leaks(spark, folder).filter("words >= 15").select("doc_id", "item_id").distinct()


QUERIES |= {f.__name__: f for f in (p7_found, p7_leaks)}


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from foliograph.llm.vectors import neighbours

    return neighbours(table(spark, folder, "chunks"), "id", "embedding_dense", version="created_at")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = p3_neighbours(spark, folder)
    return pairs.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


QUERIES |= {f.__name__: f for f in (p3_found, p3_neighbours)}


def p1_defects(spark: SparkSession, folder: str) -> DataFrame:
    """The last delivery of every result, with its defects."""
    from foliograph.llm.pairs import defects

    rows = latest(table(spark, folder, "eval_results"), ["result_id"], "run_at", ["result_id", "id", "question", "answer"])
    golden = table(spark, folder, "golden_set").select("id", (F.col("category") == "honest_refusal").alias("may_refuse")).dropDuplicates(["id"])
    return defects(rows.join(golden, "id", "left"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_defects(spark, folder).filter("defect is not null").select("result_id", "defect")


QUERIES |= {f.__name__: f for f in (p1_found, p1_defects)}


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text with placeholders, and how many mentions were replaced."""
    from foliograph.llm.pii import mentions

    rows = mentions(table(spark, folder, "documents"))
    return rows.select("doc_id", F.size("mentions").alias("n_mentions"), "redacted")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    from foliograph.llm.pii import mentions

    rows = mentions(table(spark, folder, "documents"))
    found = rows.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.kind", "m.found")
    return found.distinct()


QUERIES |= {f.__name__: f for f in (p8_found, p8_redacted)}


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with its class (the smallest id of its group of near duplicates) and its number of links to other texts."""
    from foliograph.operators.components import components

    near = p5_near(spark, folder)
    ends = near.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = components(near.links).select(F.col("id").alias("rep"), F.col("class"))
    out = near.spread(classes.join(ends, "rep"))
    return out.select("id", "rep", F.coalesce("class", "rep").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES |= {f.__name__: f for f in (p5_groups,)}
