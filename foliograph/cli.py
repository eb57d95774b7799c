"""Command surface: ``python -m foliograph.cli COMMAND --tables FOLDER ...``. Tables are parquet files in one folder."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliograph.config import Settings
from foliograph.operators import answer, catalog, evaluate, fusionlab, layout, models, procedures, quality, search
from foliograph.operators import families as fam
from foliograph.plans import evaluation, views
from foliograph.sources import files
from foliograph.sources.tables import table


def _list(text: str | None) -> list[str] | None:
    """A comma-separated list, trimmed; None if it holds nothing."""
    out = [x.strip() for x in (text or "").split(",") if x.strip()]
    return out or None


def _say(df: DataFrame, n: int = 50) -> None:
    df.show(n, truncate=100)


def _layout(spark: SparkSession, a) -> tuple[DataFrame, DataFrame]:
    """Blocks and drawings of PDF files, or the layout tables of a folder."""
    if getattr(a, "pdf", None):
        spark.dataSource.register(files.PdfLayout)
        spark.dataSource.register(files.PdfDrawings)
        return spark.read.format("pdf_layout").load(a.pdf), spark.read.format("pdf_drawings").load(a.pdf)
    folder = getattr(a, "layout", None) or a.tables
    return files.layout_blocks(spark, f"{folder}/layout_blocks"), files.layout_drawings(spark, f"{folder}/layout_drawings")


def cut(spark: SparkSession, a) -> int:
    """Layout tables (or PDF files, where PyMuPDF is installed) to chunk files; prints the heading profile first."""
    blocks, drawings = _layout(spark, a)
    _say(layout.validated(layout.heading_profile(blocks)))
    chunks = procedures.build_chunks(layout.extract(blocks, drawings, a.first, a.last), layout.page_sections(blocks), limit=Settings().max_chunk_chars)
    chunks = chunks.withColumnRenamed("doc", "filename").drop("proc", "has_warning")
    docs = chunks.select("filename").distinct().join(layout.title_pages(blocks).withColumnRenamed("doc", "filename"), "filename")
    files.write_chunks(docs, chunks, a.out)
    _say(chunks.groupBy("chunk_type").count())
    return 0


def load(spark: SparkSession, a) -> int:
    """Chunk files into tables: documents merged by filename, chunks of known documents replaced, prefixes from the cache, vectors."""
    rows = files.read_chunks(spark, a.files, a.filename)
    known = views.docs(spark, a.tables)
    new = rows.groupBy("filename").agg(F.first("doc_models").alias("applicable_models"), F.first("serial_prefixes").alias("serial_prefixes"))
    new = new.select(F.lit(None).cast("long").alias("id"), "filename", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("page_count"), F.current_timestamp().alias("indexed_at"), "applicable_models", "serial_prefixes")
    docs = catalog.upsert_documents(known, new)
    fresh = rows.join(docs.select("filename", F.col("id").alias("doc_id")), "filename")
    fresh = fresh.withColumn("prefix", models.write(F.concat(answer.document_line("filename", "doc_models", "serial_prefixes"), F.lit(" "), F.coalesce("heading", F.lit("")))))
    fresh = fresh.withColumn("e", models.embed(catalog.embed_text(F.col("prefix"), F.col("content"))))
    fresh = fresh.withColumns({"embedding_dense": F.col("e.dense"), "embedding_sparse": F.col("e.sparse"), "context_prefix": F.col("prefix"), "created_at": F.current_timestamp()}).drop("e", "prefix")
    docs.write.mode("overwrite").parquet(f"{a.out}/documents")
    catalog.overwrite_documents(fresh, f"{a.out}/chunks")
    return 0


def query(spark: SparkSession, a) -> int:
    """One question: filtered hybrid search, rerank, context."""
    s = Settings()
    rows, docs = views.chunks(spark, a.tables, "heading", "content", "page_start", "page_end", "applicable_models", "control_module"), views.docs(spark, a.tables)
    e = models.embed(F.col("content"))
    rows = fam.with_docs(rows, docs)
    if _list(a.models):
        rows = fam.applicable(rows, fam.expand(fam.family_cover(views.chunks(spark, a.tables, "applicable_models"), docs), _list(a.models)))
    if a.cm:
        rows = rows.filter(F.col("control_module") == a.cm)
    vec = rows.withColumn("e", e).withColumns({"embedding_dense": F.col("e.dense"), "embedding_sparse": F.col("e.sparse")})
    q = spark.createDataFrame([(-1, a.question)], "id long, content string").withColumn("e", models.embed(F.col("content"))).withColumns({"embedding_dense": F.col("e.dense"), "embedding_sparse": F.col("e.sparse")})
    dense = search.dense_topk(q, vec, s.dense_top_k, dims=s.embed_dims)
    sparse = search.ranked(search.sparse_scores(search.postings(q), search.postings(vec)), "query_id", "score", "id", s.sparse_top_k)
    hits = search.details(search.rrf(dense, sparse, top=s.rrf_top_k).select("query_id", "id", F.col("place").alias("fused")), rows, ["heading", "content", "page_start", "page_end", "doc_filename", "doc_models", "applicable_models", "control_module"])
    hits = hits.withColumn("rerank", models.rerank(F.lit(a.question), F.col("content")))
    w = Window.partitionBy("query_id").orderBy(F.col("rerank").desc(), "fused")
    top = hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= a.top_n)
    _say(top.select("place", "doc_filename", "heading", F.round("rerank", 4).alias("logit"), answer.applicability_line().alias("applies")).orderBy("place"))
    for r in answer.context(top, "query_id").collect():
        print(r.context)
    return 0


def trace(spark: SparkSession, a) -> int:
    out = evaluation.stage_trace(spark, a.tables)
    if a.csv:
        files.write_scores_csv(out, a.csv)
    _say(out.orderBy("ask_id", "rrf_rank"))
    return 0


def evals(spark: SparkSession, a) -> int:
    golden = table(spark, a.tables, "golden_set") if not a.golden_set else files.golden_set(spark, a.golden_set)
    ids = _list(a.id)
    kept = golden.filter(F.col("id").isin(ids)) if ids else golden
    kept = kept.filter(F.col("category") == a.category) if a.category else kept
    print(f"{kept.count()} of {golden.count()} questions")
    rows = evaluate.check_answers(views.results(spark, a.tables).drop("category"), kept)
    _say(evaluate.by_category(rows.withColumn("category", F.col("golden_category")), "category", "passes").orderBy("category"))
    return 0


def retrieval(spark: SparkSession, a) -> int:
    _say(evaluation.eval_mrr(spark, a.tables).orderBy("arm", "branch"))
    return 0


def ranks(spark: SparkSession, a) -> int:
    asks = views.asks(spark, a.tables)
    rows = evaluation._ranks(asks).filter(F.col("branch").isin("dense", "sparse")).join(asks.select("ask_id", "qid", "arm").distinct(), "ask_id")
    files.write_ranks(rows.select("arm", "qid", "branch", F.col("rank").alias("pos"), "chunk_id", "score"), a.out)
    return 0


def lab(spark: SparkSession, a) -> int:
    best = evaluation._lab(spark, a.tables)
    best = best.filter(F.col("arm") == a.arm) if a.arm else best
    _say(fusionlab.summary(best, ["variant"]).join(fusionlab.against_control(best, "ask_id"), "variant").orderBy(F.col("mrr").desc()))
    return 0


def families(spark: SparkSession, a) -> int:
    """The family table, what the guard dropped, and orphans; fails if there are orphans."""
    chunks, docs = views.chunks(spark, a.tables, "applicable_models"), views.docs(spark, a.tables)
    cover = fam.family_cover(chunks, docs)
    _say(fam.families(cover))
    _say(fam.dropped_families(cover))
    lost = fam.orphans(chunks, docs)
    _say(lost)
    if _list(a.models):
        wide, narrow = fam.expand(cover, _list(a.models)), spark.createDataFrame([(m,) for m in _list(a.models)], "model string")
        _say(fam.reach_gain(fam.with_docs(chunks, docs), wide, narrow))
    return 1 if lost.take(1) else 0


def verify(spark: SparkSession, a) -> int:
    """Invariants of the chunks; fails if one has violations."""
    from foliograph.plans.procedures import lost_safety_blocks, step_gap_check

    bad = {
        "page ranges": quality.bad_citations(views.chunks(spark, a.tables, "page_start", "page_end")),
        "step numbers": step_gap_check(spark, a.tables),
        "warnings without steps": quality.unattached_warnings(views.chunks(spark, a.tables, "chunk_type", "has_warning", "step_count")),
        "lost safety blocks": lost_safety_blocks(spark, a.tables),
    }
    if a.layout or a.pdf:
        blocks, drawings = _layout(spark, a)
        bad |= quality.layout_invariants(layout.extract(blocks, drawings), blocks.filter(layout.is_banner() & layout.in_body()), limit=Settings().max_chunk_chars)
    n = {k: v.count() for k, v in bad.items()}
    for k, v in n.items():
        print(f"{k}: {v} violations")
    return int(any(n.values()))


def gate(spark: SparkSession, a) -> int:
    """Acceptance of manuals: the five checks over their pages where there is a layout, else what the tables can tell."""
    if a.layout or a.pdf:
        out = quality.accept(layout.page_facts(_layout(spark, a)[0]), _list(a.prefixes) or [])
        _say(out)
        return int(bool(out.filter("not accepted").take(1)))
    out = quality.publication_stats(views.docs(spark, a.tables), views.chunks(spark, a.tables, "icode", "page_start"), _list(a.prefixes) or [])
    _say(out)
    return int(bool(out.filter("not (prefix_ok and density_ok)").take(1)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliograph")
    sub = p.add_subparsers(dest="command", required=True)

    def add(f, *options: tuple[str, dict]) -> None:
        c = sub.add_parser(f.__name__, help=f.__doc__)
        c.add_argument("--tables", default=os.environ.get("FOLIOGRAPH_TABLES", "tables"))
        for names, kw in options:
            c.add_argument(*names.split(), **kw)
        c.set_defaults(run=f)

    add(cut, ("--pdf", {}), ("--out", {"required": True}), ("--first", {"type": int, "default": 1}), ("--last", {"type": int}))
    add(load, ("--files", {"required": True}), ("--filename", {}), ("--out", {"required": True}))
    add(query, ("question", {}), ("--models -m", {}), ("--cm", {}), ("--top-n", {"type": int, "default": Settings().rerank_top_n}))
    add(trace, ("--csv", {}))
    add(evals, ("--category -c", {}), ("--id", {}), ("--golden-set", {}))
    add(retrieval)
    add(ranks, ("--out", {"required": True}))
    add(lab, ("--arm", {}))
    add(families, ("--models -m", {}))
    add(verify, ("--layout", {}), ("--pdf", {}))
    add(gate, ("--prefixes", {}), ("--layout", {}), ("--pdf", {}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("foliograph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
