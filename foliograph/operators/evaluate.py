"""Evaluation: targets found by content, ranks, reciprocal ranks, answers held against their expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def targets(golden: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``(qid, chunk_id)``: chunks that meet every stated part of a question's target: the manual's file, the start of the
    heading, a piece of the content (taken literally), the control module. A target that states nothing has none.

    Targets that name a manual, the usual case, or a heading are equi-joins; the rest, if any, is compared with all chunks,
    the questions being a stated set of bounded size.
    """
    t = golden.select(F.col("id").alias("qid"), *[F.col(f"target_chunk.{c}").alias(f"t_{c}") for c in ("doc", "heading_startswith", "content_contains", "control_module")])
    t = t.filter("coalesce(t_doc, t_heading_startswith, t_content_contains, t_control_module) is not null")
    names = docs.select(F.col("id").alias("d_id"), "filename")
    c = chunks.select(F.col("id").alias("chunk_id"), "doc_id", "heading", "content", F.col("control_module").alias("cm"))
    meets = (
        (F.col("t_heading_startswith").isNull() | F.col("heading").startswith(F.col("t_heading_startswith")))
        & (F.col("t_content_contains").isNull() | F.col("content").contains(F.col("t_content_contains")))
        & (F.col("t_control_module").isNull() | (F.col("cm") == F.col("t_control_module")))
    )
    named = t.filter("t_doc is not null").join(names, F.col("t_doc") == F.col("filename")).join(c, F.col("d_id") == F.col("doc_id")).filter(meets)
    out = named.select("qid", "chunk_id")
    free = t.filter("t_doc is null")
    shortest = free.agg(F.min(F.length("t_heading_startswith"))).first()[0]
    if shortest:
        # Headings meet on as many characters as the shortest start has.
        by_head = free.filter("t_heading_startswith is not null").withColumn("k", F.substring("t_heading_startswith", 1, shortest))
        heads = c.withColumn("h", F.substring("heading", 1, shortest))
        out = out.unionByName(heads.join(by_head, F.col("h") == F.col("k")).filter(meets).select("qid", "chunk_id"))
        free = free.filter("t_heading_startswith is null")
    if not free.isEmpty():
        out = out.unionByName(c.join(free, meets).select("qid", "chunk_id"))
    return out.distinct()


def best_ranks(ranks: DataFrame, hits: DataFrame, group: str = "ask_id") -> DataFrame:
    """The best rank of any target in each branch: ``(group, branch, best)`` from ``(group, branch, chunk_id, rank)`` and the
    targets ``(group, chunk_id)``."""
    return ranks.join(hits, [group, "chunk_id"], "left_semi").groupBy(group, "branch").agg(F.min("rank").alias("best"))


def retrieval_metrics(rows: DataFrame, by: list[str], rank: str = "best", top: int = 6) -> DataFrame:
    """First places, places within ``top``, and the mean reciprocal rank over all rows, those without a rank included."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(rank) == 1).alias("first"),
        F.count_if(F.col(rank) <= top).alias("in_top"),
        F.count_if(F.col(rank).isNull()).alias("missing"),
        F.round(F.sum(F.coalesce(1.0 / F.col(rank), F.lit(0.0))) / F.count("*"), 6).alias("mrr"),
    )


def unmet(answer: str, expectations: str) -> Column:
    """Expectations without any of their alternatives in the answer, whatever the case; alternatives are joined by a bar."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    missed = F.filter(F.coalesce(expectations, F.array().cast("array<array<string>>")), lambda alts: ~F.exists(alts, lambda a: F.contains(low, F.lower(a))))
    return F.transform(missed, lambda alts: F.array_join(alts, " | "))


def forbidden(answer: str, words: str) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.contains(low, F.lower(w)))


def check_answers(results: DataFrame, golden: DataFrame) -> DataFrame:
    """Each answer with ``missing``, ``forbidden``, ``cited`` pages, ``pages_ok`` and the verdict ``passes``. Pages inform only."""
    from foliograph.functions.text import cited_pages

    g = golden.select(F.col("id").alias("gid"), "expected_contains", "must_not_contain", "expected_pages", F.col("category").alias("golden_category"))
    rows = results.join(g, results["id"] == g["gid"])
    rows = rows.withColumns({"missed": unmet("answer", "expected_contains"), "banned": forbidden("answer", "must_not_contain"), "cited": cited_pages(F.coalesce("answer", F.lit("")))})
    span = F.when(F.size("expected_pages") > 0, F.exists("cited", lambda p: p.between(F.col("expected_pages")[0], F.element_at("expected_pages", -1))))
    return rows.withColumn("pages_ok", span).withColumn("passes", (F.size("missed") == 0) & (F.size("banned") == 0) & (F.coalesce("error", F.lit("")) == ""))


def by_category(rows: DataFrame, category: str, passed: str) -> DataFrame:
    """Passed and total per category, and the whole percentage."""
    out = rows.groupBy(category).agg(F.count_if(F.col(passed)).alias("passed"), F.count("*").alias("total"))
    return out.withColumn("percent", F.floor(100 * F.col("passed") / F.col("total")).cast("int"))


def variant_gaps(scored: DataFrame, hits: DataFrame, rivals: DataFrame, group: str = "ask_id", score: str = "rerank") -> DataFrame:
    """``(group, right, rival, gap)``: the best score among the targets, among their rivals, and the difference."""
    kind = hits.withColumn("right", F.lit(True)).unionByName(rivals.withColumn("right", F.lit(False)))
    both = scored.join(kind, [group, "chunk_id"])
    out = both.groupBy(group).agg(F.max(F.when(F.col("right"), F.col(score))).alias("right_score"), F.max(F.when(~F.col("right"), F.col(score))).alias("rival_score"))
    return out.withColumn("gap", F.round(F.col("right_score") - F.col("rival_score"), 6))
