"""Files: layout tables, chunk JSON in two forms, golden questions, rank dumps, score logs, caches."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliograph.operators.layout import BLOCKS, DRAWINGS

CHUNK = (
    "heading string, icode string, section string, page_start int, page_end int, chunk_type string, content string, smcs_codes array<string>, part_numbers array<string>, "
    "illustrations array<string>, applicable_models array<string>, control_module string, step_count int, part_index int, part_total int, safety_blocks array<struct<type:string,text:string>>"
)
DOCUMENT = "filename string, serial_prefixes array<string>, applicable_models array<string>"
RANKS = "arm string, qid string, branch string, pos int, chunk_id long, score double"


class PdfLayout(DataSource):
    """``spark.read.format("pdf_layout").load(path)``: layout blocks of PDF files, a partition per file, where PyMuPDF is installed."""

    @classmethod
    def name(cls) -> str:
        return "pdf_layout"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return _PdfReader(self.options)


class PdfDrawings(PdfLayout):
    """``spark.read.format("pdf_drawings").load(path)``: rectangles of the drawings of the same files."""

    @classmethod
    def name(cls) -> str:
        return "pdf_drawings"

    def schema(self) -> str:
        return DRAWINGS

    def reader(self, schema) -> DataSourceReader:
        return _PdfDrawings(self.options)


class _PdfReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.first, self.last = int(options.get("first", 1)), int(options.get("last", 10**9))

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import os

        import fitz  # not part of the requirements

        with fitz.open(partition.value) as doc:
            for n, page in enumerate(doc, 1):
                if self.first <= n <= self.last:
                    for i, b in enumerate(page.get_text("dict")["blocks"]):
                        lines = [{"spans": [{"text": s["text"], "size": s["size"], "flags": s["flags"], "bbox": dict(zip(("x0", "y0", "x1", "y1"), s["bbox"])) if "bbox" in s else None} for s in x["spans"]]} for x in b.get("lines", [])]
                        yield os.path.basename(partition.value), n, i, b["type"], dict(zip(("x0", "y0", "x1", "y1"), b["bbox"])), lines or None


class _PdfDrawings(_PdfReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import os

        import fitz  # not part of the requirements

        with fitz.open(partition.value) as doc:
            for n, page in enumerate(doc, 1):
                if self.first <= n <= self.last:
                    for i, d in enumerate(page.get_drawings()):
                        yield os.path.basename(partition.value), n, i, d["type"], *map(float, d["rect"])


def layout_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).json(path)


def layout_drawings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DRAWINGS).json(path)


def write_chunks(documents: DataFrame, chunks: DataFrame, path: str) -> None:
    """One JSON object per document: ``{document, chunks}``. A document's chunks are one record of the format."""
    cols = [c for c in chunks.columns if c != "filename"]
    packed = chunks.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("chunks"))
    out = documents.join(packed, "filename").select(F.struct(*documents.columns).alias("document"), "chunks")
    out.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str, filename: str | None = None) -> DataFrame:
    """Chunks from files of either form: ``{document, chunks}`` or a flat list. Rows carry ``filename``, models and prefixes of the
    document. A file that names no document is refused unless ``filename`` is given: nothing is guessed."""
    text = spark.read.text(path, wholetext=True).select("value")
    # The record form may hold one object per line.
    whole = text.select(F.explode(F.when(F.ltrim("value").startswith("["), F.array("value")).otherwise(F.filter(F.split("value", "\n(?=\\{\"document\")"), lambda v: F.trim(v) != ""))).alias("v"))
    flat = whole.filter(F.ltrim("v").startswith("[")).select(F.lit(None).cast(f"struct<{_types(DOCUMENT)}>").alias("document"), F.from_json("v", f"array<struct<{_types(CHUNK)}>>").alias("chunks"))
    named = whole.filter(~F.ltrim("v").startswith("[")).select(F.from_json("v", f"document struct<{_types(DOCUMENT)}>, chunks array<struct<{_types(CHUNK)}>>").alias("x")).select("x.*")
    out = named.unionByName(flat).withColumn("name", F.coalesce(F.nullif(F.trim("document.filename"), F.lit("")), F.lit(filename)))
    if out.filter("name is null").take(1):
        raise ValueError("a chunk file names no document; give a filename")
    none = F.array().cast("array<string>")
    return out.select(F.col("name").alias("filename"), F.coalesce("document.applicable_models", none).alias("doc_models"), F.coalesce("document.serial_prefixes", none).alias("serial_prefixes"), F.explode("chunks").alias("c")).select("filename", "doc_models", "serial_prefixes", "c.*")


def _types(ddl: str) -> str:
    return ddl.replace(" array<string>", ":array<string>").replace(" array<struct<", ":array<struct<").replace(" string", ":string").replace(" int", ":int")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from YAML or JSON, a bounded file read on the driver; a plain expected string is a list of one."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    try:
        items = json.loads(raw)
    except ValueError:
        import yaml  # optional

        items = yaml.safe_load(raw)
    items = items.get("questions", items.get("items", [])) if isinstance(items, dict) else items
    rows = []
    for x in items:
        t = x.get("target_chunk") or None
        rows.append(
            (
                x["id"],
                x["question"],
                x.get("category"),
                [[e] if isinstance(e, str) else list(e) for e in x.get("expected_contains") or []],
                list(x.get("must_not_contain") or []),
                list(x.get("expected_pages") or []),
                tuple(t.get(k) for k in ("doc", "heading_startswith", "content_contains", "control_module")) if t else None,
                x.get("notes"),
            )
        )
    return spark.createDataFrame(
        rows,
        "id string, question string, category string, expected_contains array<array<string>>, must_not_contain array<string>, expected_pages array<int>, target_chunk struct<doc:string,heading_startswith:string,content_contains:string,control_module:string>, notes string",
    )


def write_scores_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_ranks(ranks: DataFrame, path: str) -> None:
    """Rank dump: a row per (arm, question, branch) with the list of chunks in order. Lists are windows of at most a few dozen."""
    item = F.struct("pos", "chunk_id", "score")
    ranks.groupBy("arm", "qid", "branch").agg(F.array_sort(F.collect_list(item)).alias("items")).write.mode("overwrite").json(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.schema("arm string, qid string, branch string, items array<struct<pos:int,chunk_id:long,score:double>>").json(path)
    return x.select("arm", "qid", "branch", F.explode("items").alias("e")).select("arm", "qid", "branch", "e.pos", "e.chunk_id", "e.score")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cache_key string, prefix string").parquet(path)


def append_cache(rows: DataFrame, path: str) -> None:
    rows.select("cache_key", "prefix").write.mode("append").parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, parts: int, low: int, high: int) -> DataFrame:
    """A relational table, read in ranges of its key."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, numPartitions=parts, lowerBound=low, upperBound=high).load()
