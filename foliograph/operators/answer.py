"""Answer assembly: context, applicability line, grounding, header, score-log record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as ft

# Prompts and labels by language.
SYSTEM = {
    "en": "You answer questions on engine manuals from the numbered fragments alone. Cite document and page. Say so if they hold no answer.",
    "ru": "Вы отвечаете на вопросы по руководствам двигателей только по пронумерованным фрагментам. Указывайте документ и страницу. Если ответа в них нет, скажите об этом.",
}
APPLIES = {"en": "Applies to: ", "ru": "Применимо к: "}
ENGINES = {"en": "engines with ", "ru": "двигатели с "}


def _clean(models: str) -> Column:
    return F.filter(F.transform(F.coalesce(models, F.array().cast("array<string>")), lambda m: F.trim(m)), lambda m: m != "")


def applicability_line(control_module: str = "control_module", own: str = "applicable_models", of_doc: str = "doc_models", lang: str = "en") -> Column:
    """Control module (with the chunk's own models), else own models, else the manual's, else null."""
    mine, theirs, cm = _clean(own), _clean(of_doc), F.nullif(F.trim(F.coalesce(control_module, F.lit(""))), F.lit(""))
    body = (
        F.when(cm.isNotNull(), F.concat_ws(" · ", F.concat(F.lit(ENGINES[lang]), cm), F.nullif(F.array_join(mine, ", "), F.lit(""))))
        .when(F.size(mine) > 0, F.array_join(mine, ", "))
        .when(F.size(theirs) > 0, F.array_join(theirs, ", "))
    )
    return F.concat(F.lit(APPLIES[lang]), body)


def header(answer: str, line: str, window: int | None = None) -> Column:
    """The line stands before an answer that doesn't decline; ``window`` looks at so many first characters only."""
    seen = F.substring(answer, 1, window) if window else F.col(answer)
    return F.when(F.col(line).isNotNull() & ~ft.declines(seen), F.col(line))


def context(fragments: DataFrame, group: str = "ask_id", place: str = "place") -> DataFrame:
    """``(group, context)``: numbered fragments with document, heading and pages, in order. Fragments per question are few: they are
    the cut of a ranking."""
    item = F.format_string(
        "--- Fragment %d — SOURCE [%s, %s] — %s ---\n%s\n",
        F.col(place),
        ft.publication_id(F.col("doc_filename")),
        ft.citation(F.col("page_start"), F.col("page_end")),
        F.coalesce("heading", F.lit("")),
        F.coalesce("content", F.lit("")),
    )
    x = fragments.withColumn("_i", F.struct(F.col(place).alias("p"), item.alias("t")))
    return x.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_i")), lambda e: e["t"]), "\n").alias("context"))


def claims(answer: str) -> Column:
    """Measurements, then part numbers, repetitions kept."""
    text = F.coalesce(answer, F.lit(""))
    return F.concat(ft.measurements(text), F.regexp_extract_all(text, F.lit(ft.PART_NUMBER), 1))


def grounding(answer: str, source: str) -> Column:
    """``struct(ok, unverified, claims)``: claims that the source doesn't hold, white space aside."""
    bare = ft.squeezed(F.lower(F.coalesce(source, F.lit(""))))
    c = claims(answer)
    lost = F.filter(c, lambda x: ~F.contains(bare, ft.squeezed(F.lower(x))))
    return F.struct((F.size(lost) == 0).alias("ok"), lost.alias("unverified"), c.alias("claims"))


def document_line(filename: str, models: str, serials: str) -> Column:
    """Document, models and serial prefixes for a prefix."""
    return F.concat_ws(
        "; ",
        F.concat(F.lit("Document: "), ft.publication_id(F.col(filename), "unknown document")),
        F.when(F.size(models) > 0, F.concat(F.lit("models "), F.array_join(models, ", "))),
        F.when(F.size(serials) > 0, F.concat(F.lit("serial prefixes "), F.array_join(serials, ", "))),
    )


def score_record(rows: DataFrame, group: str, top: int = 6) -> DataFrame:
    """The record of each query: best scores as probability and logit, control modules, their ambiguity, documents.

    ``rows`` are the ranked fragments of each query with ``place`` and ``rerank`` (a logit).
    """
    p = ft.sigmoid(F.col("rerank"))
    x = rows.filter(F.col("place") <= top)
    out = x.groupBy(group, "backend").agg(
        F.count("*").alias("n"),
        F.round(F.max(p), 6).alias("top_score"),
        F.round(F.max(ft.logit(p)), 4).alias("top_logit"),
        F.array_sort(F.collect_set("control_module")).alias("control_modules"),
        F.array_sort(F.collect_set("doc_filename")).alias("doc_filenames"),
    )
    return out.withColumn("cm_ambiguous", F.size("control_modules") > 1)
