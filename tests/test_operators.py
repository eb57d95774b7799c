"""Literal cases of families, search, fusion, answers, loading, models, sources and streams; nulls, ties and empty tables."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from foliograph.config import Settings
from foliograph.functions import text as ft
from foliograph.functions import vectors as fv
from foliograph.operators import answer, catalog, evaluate, fusionlab, models, quality, search
from foliograph.operators import families as fam
from foliograph.sources import files
from foliograph.sources.tables import latest, newest
from foliograph.streaming import scorelog

DOC = "id long, filename string, applicable_models array<string>"
CHUNK = "id long, doc_id long, applicable_models array<string>"


def small(spark):
    docs = spark.createDataFrame([(1, "A.pdf", ["3508B", "3512B", "3516B", "3508C"]), (2, "B.pdf", ["3500B", "3500C"]), (3, "C.pdf", [])], DOC)
    chunks = spark.createDataFrame([(1, 1, ["3500B"]), (2, 2, ["3512B"]), (3, 1, []), (4, 1, ["3500D"]), (5, 3, []), (6, 1, ["3500C"])], CHUNK)
    return chunks, docs


def test_families(spark):
    chunks, docs = small(spark)
    cover = fam.family_cover(chunks, docs)
    assert {r.token: r.covers for r in fam.families(cover).collect()} == {"3500B": ["3508B", "3512B", "3516B"], "3500C": ["3508C"]}
    assert [r.token for r in fam.dropped_families(cover).collect()] == ["3512B"]
    assert [(r.filename, r.token, r.n_chunks) for r in fam.orphans(chunks, docs).collect()] == [("A.pdf", "3500D", 1)]
    assert {r.model for r in fam.expand(cover, ["3512B"]).collect()} == {"3512B", "3500B"}
    assert {r.model for r in fam.expand(cover, ["3500B"]).collect()} == {"3500B"}


def test_applicability(spark):
    chunks, docs = small(spark)
    rows = fam.with_docs(chunks, docs)
    asked = fam.expand(fam.family_cover(chunks, docs), ["3512B"])
    assert sorted(r.id for r in fam.applicable(rows, asked).collect()) == [1, 2, 3]
    none = asked.limit(0)
    assert fam.applicable(rows, none).count() == 0


def test_wider_questions_never_lose_rows(spark):
    chunks, docs = small(spark)
    rows = fam.with_docs(chunks, docs)
    cover = fam.family_cover(chunks, docs)
    one = {r.id for r in fam.applicable(rows, fam.expand(cover, ["3512B"])).collect()}
    two = {r.id for r in fam.applicable(rows, fam.expand(cover, ["3512B", "3508C"])).collect()}
    assert one <= two


def test_dense_topk_ties_nulls_and_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0], [1.0, 0.0]])], "id long, embedding_dense array<float>")
    monkeypatch.setattr(search, "BLOCK", 1)
    got = search.dense_topk(rows.filter("id in (0, 2, 3)"), rows, k=2, dims=2).orderBy("query_id", "rank").collect()
    assert [(g.query_id, g.id, g.score) for g in got] == [(0, 1, 1.0), (0, 7, 1.0), (2, 0, 0.0), (2, 1, 0.0)]
    assert search.dense_topk(rows.limit(0), rows, dims=2).count() == 0
    assert search.dense_topk(rows, rows.limit(0), dims=2).count() == 0


def test_sparse(spark):
    rows = spark.createDataFrame([(1, {1: 0.5, 2: -1.0}), (2, {1: 2.0}), (3, {}), (4, None)], "id long, embedding_sparse map<int,float>")
    p = search.postings(rows)
    assert {(r.id, r.token, r.weight) for r in p.collect()} == {(1, 1, 0.5), (2, 1, 2.0)}
    assert [(r.query_id, r.id, r.score) for r in search.sparse_scores(p.filter("id = 1"), p).collect()] == [(1, 2, 1.0)]


def naive_rrf(dense, sparse, k=60, miss=51):
    order = {c: i for i, c in enumerate(dense + [c for c in sparse if c not in dense])}
    rank = lambda lst, c: lst.index(c) + 1 if c in lst else miss
    score = {c: 1 / (k + rank(dense, c)) + 1 / (k + rank(sparse, c)) for c in order}
    return sorted(order, key=lambda c: (-score[c], order[c]))


@pytest.mark.parametrize("seed", range(4))
def test_rrf_random(spark, seed):
    r = random.Random(seed)
    dense, sparse = r.sample(range(30), 12), r.sample(range(30), [12, 0, 5, 1][seed])
    frame = lambda lst: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(lst)], "query_id long, id long, rank int")
    got = search.rrf(frame(dense), frame(sparse), top=None).orderBy("place").collect()
    assert [g.id for g in got] == naive_rrf(dense, sparse)
    again = search.rrf(frame(dense[::-1]).withColumn("rank", F.lit(13) - F.col("rank")).repartition(7), frame(sparse), top=None)
    assert [g.id for g in again.orderBy("place").collect()] == naive_rrf(dense, sparse)


def test_fusion_variants_random(spark):
    r = random.Random(9)
    rows = [(1, c, r.random() if r.random() < 0.7 else None, r.choice([0.0, r.random(), None])) for c in range(20)]
    df = spark.createDataFrame(rows, "ask_id long, chunk_id long, dense double, sparse double")
    placed = fusionlab.fused(fusionlab.branch_ranks(df, "ask_id", "dense", "sparse", "chunk_id"), "ask_id", "chunk_id")
    got = {}
    for x in placed.orderBy("place").collect():
        got.setdefault(x.variant, []).append(x.chunk_id)
    dense = [c for _, c, d, _ in sorted(rows, key=lambda x: (-(x[2] or 0), x[1])) if d is not None]
    sparse = [c for _, c, _, s in sorted(rows, key=lambda x: (-(x[3] or 0), x[1])) if s is not None]
    zero = [c for c in sparse if rows[c][3] > 1e-9]
    for name, kind, k, miss, ws, drop in fusionlab.VARIANTS:
        s = zero if drop else sparse
        pos = lambda lst, c: lst.index(c) + 1 if c in lst else None

        def score(c):
            a, b = pos(dense, c), pos(s, c)
            if kind == "impute":
                return 1 / (k + (a or miss)) + 1 / (k + (b or miss))
            x, y = (1 / (k + a) if a else 0), (ws / (k + b) if b else 0)
            return max(x, y) if kind == "max" else x + y

        every = dense + [c for c in s if c not in dense]
        assert got[name] == sorted(every, key=lambda c: (-round(score(c), 12), every.index(c))), name


def test_target_parts_are_literal(spark):
    golden = spark.createDataFrame([("g1", ("A.pdf", "Air", "50%", None)), ("g2", (None, "Fuel", None, None)), ("g3", None), ("g4", (None, None, None, None))], "id string, target_chunk struct<doc:string,heading_startswith:string,content_contains:string,control_module:string>")
    docs = spark.createDataFrame([(1, "A.pdf", [])], DOC)
    chunks = spark.createDataFrame([(1, 1, "Air Shutoff", "at 50% load", None), (2, 1, "Air Shutoff", "at 500 load", None), (3, 1, "Fuel Filter", "x", "ADEM II"), (4, 1, None, None, None)], "id long, doc_id long, heading string, content string, control_module string")
    assert {(r.qid, r.chunk_id) for r in evaluate.targets(golden, chunks, docs).collect()} == {("g1", 1), ("g2", 3)}


def test_answer_checks(spark):
    golden = spark.createDataFrame([("g", [["205 kPa", "30 psi"], ["stop"]], ["never"], [5, 7], "c")], "id string, expected_contains array<array<string>>, must_not_contain array<string>, expected_pages array<int>, category string")
    rows = spark.createDataFrame([(1, "g", "STOP at 30 PSI, p. 6", ""), (2, "g", "Never 205 kPa", ""), (3, "g", None, "timeout")], "result_id long, id string, answer string, error string")
    got = {r.result_id: r for r in evaluate.check_answers(rows, golden).collect()}
    assert got[1].passes and got[1].pages_ok and got[1].cited == [6]
    assert not got[2].passes and got[2].missed == ["stop"] and got[2].banned == ["never"] and not got[2].pages_ok
    assert not got[3].passes and len(got[3].missed) == 2


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 4), ("a", None)], "arm string, best int")
    r = evaluate.retrieval_metrics(rows, ["arm"]).first()
    assert (r.n, r.first, r.in_top, r.missing, r.mrr) == (3, 1, 2, 1, round((1 + 0.25) / 3, 6))


def test_grounding(spark):
    cases = [("Set 205 kPa and use 174-6854.", "limit 205kPa; part 174-6854", True, 2), ("Set 210 kPa", "limit 205 kPa", False, 1), ("Wait 1 minute", "x", True, 0), ("5 psi", "15 psi", True, 1), (None, None, True, 0)]
    df = spark.createDataFrame([(a, c) for a, c, _, _ in cases], "a string, c string").select(answer.grounding("a", "c").alias("v"))
    assert [(r.v.ok, len(r.v.claims)) for r in df.collect()] == [(ok, n) for _, _, ok, n in cases]


def test_applicability_and_header(spark):
    rows = [("ADEM II", ["3500B"], ["3512B"], "Answer."), (None, [" "], ["3512B"], "This is not in the O&M Manual."), (None, None, [], "x"), ("", ["3508B"], None, "is not in the O&M Manual" + " " * 0)]
    df = spark.createDataFrame(rows, "control_module string, applicable_models array<string>, doc_models array<string>, answer string").withColumn("line", answer.applicability_line())
    got = df.select("line", answer.header("answer", "line").alias("h")).collect()
    assert [g.line for g in got] == ["Applies to: engines with ADEM II · 3500B", "Applies to: 3512B", None, "Applies to: 3508B"]
    assert [g.h for g in got] == ["Applies to: engines with ADEM II · 3500B", None, None, None]


def test_text_functions(spark):
    one = lambda c, *v: spark.createDataFrame([tuple(v)], [f"v{i}" for i in range(len(v))]).select(c).first()[0]
    assert one(ft.language(F.col("v0")), "") == "ru" and one(ft.language(F.col("v0")), "a" * 95 + "б" * 5) == "en" and one(ft.language(F.col("v0")), "a" * 89 + "б" * 11) == "ru"
    assert one(ft.control_module(F.col("v0"), F.col("v1")), "", "Test ADEM II or ADEM III") is None and one(ft.control_module(F.col("v0"), F.col("v1")), "ADEM III", "ADEM II") == "ADEM III"
    assert one(ft.publication_id(F.col("v0")), " X-1.PDF") == "X-1" and one(ft.publication_id(F.col("v0")), "  ") == "unknown source"
    assert one(ft.smcs_codes(F.col("v0")), "SMCS Code: 1105-040; 1106,\n2") == ["1105-040", "1106", "2"]
    assert one(ft.citation(F.col("v0"), F.col("v1")), 3, 3) == "p. 3" and one(ft.citation(F.col("v0"), F.col("v1")), 3, 5) == "pp. 3–5"
    assert one(ft.heading(F.col("v0")), "Inspect/ Clean/\nTest ") == "Inspect/Clean/Test"
    assert one(ft.cache_key(F.col("v0"), F.col("v1")), "a", "x") != one(ft.cache_key(F.col("v0"), F.col("v1")), "b", "x")
    assert abs(one(ft.logit(ft.sigmoid(F.col("v0"))), 2.5) - 2.5) < 1e-9 and one(ft.logit(F.col("v0")), 0.0) < -20


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(fv.cosine("a", "b")).collect()] == [1.0, None, None, None]
    m = spark.createDataFrame([({"5": 0.25, "x": 1.0, "7": -1.0, "300000": 1.0},), ({},)], "m map<string,double>").select(fv.sparse_literal(fv.sparse_index("m"))).collect()
    assert [r[0] for r in m] == ["{6:0.25}/250002", "{}/250002"]


def test_catalog(spark):
    doc = "id long, filename string, title string, indexed_at timestamp, applicable_models array<string>, serial_prefixes array<string>"
    old = spark.createDataFrame([(1, "a", "A", None, ["x"], ["p"]), (2, "b", "B", None, [], None)], doc)
    new = spark.createDataFrame([(9, "a", None, None, [], ["q"]), (9, "c", "C", None, None, []), (9, None, "N", None, [], [])], doc)
    got = {r.filename: r for r in catalog.upsert_documents(old, new).collect()}
    assert (got["a"].id, got["a"].title, got["a"].applicable_models, got["a"].serial_prefixes) == (1, "A", ["x"], ["q"])
    assert got["b"].serial_prefixes == [] and got["c"].title == "C" and set(got) == {"a", "b", "c"}
    chunks = spark.createDataFrame([(1, 1, "o"), (2, 2, "o")], "id long, doc_id long, t string")
    fresh = spark.createDataFrame([(3, 1, "n")], "id long, doc_id long, t string")
    assert {(r.id, r.t) for r in catalog.reindex(chunks, fresh).collect()} == {(2, "o"), (3, "n")}
    assert [r.id for r in catalog.cascade(chunks, old.filter("id = 2")).collect()] == [2]


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "c")
    frame = lambda *r: spark.createDataFrame(list(r), "id long, doc_id long")
    catalog.overwrite_documents(frame((1, 1), (2, 2)), path)
    catalog.overwrite_documents(frame((3, 1)), path)
    assert {(r.id, r.doc_id) for r in spark.read.parquet(path).collect()} == {(3, 1), (2, 2)}


def test_latest(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "a", {"k": 1}), (1, "2024-01-02", "b", {"k": 2}), (1, "2024-01-02", "b", {"k": 2}), (None, None, None, None)], "id long, at string, v string, m map<string,int>")
    assert {(r.id, r.v) for r in latest(df, ["id"], "at", ["id", "v"]).collect()} == {(1, "b"), (None, None)}
    assert {(r.id, r.v) for r in newest(df, ["id"], "at").collect()} == {(1, "b"), (None, None)}


def test_models_are_deterministic(spark):
    df = spark.createDataFrame([("Oil filter", "the oil filter"), (None, "")], "q string, t string")
    a = df.select(models.embed(F.col("t")).alias("e"), models.rerank(F.col("q"), F.col("t")).alias("r"), models.write(F.col("t")).alias("w")).collect()
    assert abs(sum(x * x for x in a[0].e.dense) - 1) < 1e-6 and len(a[0].e.sparse) == 3 and a[1].e.sparse == {} and a[0].r > a[1].r and a[0].w == "the oil filter"


def test_settings():
    assert Settings.of(rrf_k=10).rrf_k == 10 and Settings().rrf_miss == 51
    with pytest.raises(ValueError, match="unknown settings: oops"):
        Settings.of(oops=1)


def test_chunk_files_both_forms(spark, tmp_path):
    chunk = {"heading": "Насос", "content": "a\nb", "page_start": 1, "safety_blocks": [{"type": "WARNING", "text": "t"}]}
    (tmp_path / "new.json").write_text(json.dumps({"document": {"filename": "A.pdf", "applicable_models": ["3512B"], "serial_prefixes": []}, "chunks": [chunk, chunk]}, ensure_ascii=False, indent=1))
    (tmp_path / "old.json").write_text(json.dumps([chunk]))
    with pytest.raises(ValueError, match="names no document"):
        files.read_chunks(spark, str(tmp_path))
    got = files.read_chunks(spark, str(tmp_path), filename="B.pdf").collect()
    assert sorted((g.filename, g.heading, g.doc_models, g.safety_blocks[0]["type"]) for g in got) == [("A.pdf", "Насос", ["3512B"], "WARNING")] * 2 + [("B.pdf", "Насос", [], "WARNING")]
    docs = spark.createDataFrame([("A.pdf", ["S1"], ["3512B"])], files.DOCUMENT)
    out = str(tmp_path / "out")
    files.write_chunks(docs, files.read_chunks(spark, str(tmp_path / "new.json")).select("filename", "heading", "content", "page_start"), out)
    back = files.read_chunks(spark, out).collect()
    assert [(b.filename, b.heading, b.content) for b in back] == [("A.pdf", "Насос", "a\nb")] * 2
    assert "Насос" in "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out) if f.endswith(".json"))


def test_golden_ranks_cache_csv(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"id": "gs1", "question": "q", "expected_contains": ["a", ["b", "c"]], "target_chunk": {"doc": "A.pdf"}}, {"id": "gs2", "question": "q"}]))
    g = files.golden_set(spark, str(tmp_path / "g.json")).orderBy("id").collect()
    assert g[0].expected_contains == [["a"], ["b", "c"]] and g[0].target_chunk.doc == "A.pdf" and g[1].target_chunk is None
    ranks = spark.createDataFrame([("x", "q", "dense", 1, 5, 0.5), ("x", "q", "dense", 2, 4, 0.25)], files.RANKS)
    files.write_ranks(ranks, str(tmp_path / "r"))
    assert {tuple(r) for r in files.read_ranks(spark, str(tmp_path / "r")).collect()} == {tuple(r) for r in ranks.collect()}
    files.append_cache(spark.createDataFrame([("k", "p")], "cache_key string, prefix string"), str(tmp_path / "c"))
    hits, missed = catalog.cached(spark.createDataFrame([("k",), ("z",)], "cache_key string"), files.read_cache(spark, str(tmp_path / "c")))
    assert [h.prefix for h in hits.collect()] == ["p"] and [m.cache_key for m in missed.collect()] == ["z"]
    files.write_scores_csv(ranks, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2


def test_log_stream_equals_table(spark, tmp_path):
    import datetime

    rows = [(datetime.datetime(2024, 1, 1), "cli", b, "q", 0.9, t, [], False, ["A"], refused, ok, [], 1, 6) for b, t, refused, ok in (("onnx", 1.0, False, True), ("onnx", 3.0, True, None), ("torch", -1.0, False, False))]
    log = spark.createDataFrame(rows, scorelog.RECORD)
    path = str(tmp_path / "log")
    scorelog.append(log.limit(2), path)
    scorelog.append(log.filter("backend = 'torch'"), path)
    want = {tuple(r) for r in scorelog.metrics(scorelog.read(spark, path)).collect()}
    q = scorelog.metrics(scorelog.stream(spark, path)).writeStream.format("memory").queryName("logm").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("logm").collect()} == want == {("onnx", 2, 1, 0, 2.0), ("torch", 1, 0, 1, -1.0)}


def test_event_windows_stream_equals_table(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.limit(300).write.parquet(str(tmp_path / "e"))
    part = spark.read.parquet(str(tmp_path / "e"))
    want = {tuple(r) for r in scorelog.event_windows(part).collect()}
    s = scorelog.event_windows(spark.readStream.schema(part.schema).parquet(str(tmp_path / "e")))
    q = s.writeStream.format("memory").queryName("evw").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("evw").collect()} == want


def test_reindex_stream(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    frame = lambda *r: spark.createDataFrame(list(r), "id long, doc_id long")
    for rows in (((1, 1), (2, 2)), ((3, 1),)):
        frame(*rows).coalesce(1).write.mode("append").parquet(src)
        scorelog.reindex_stream(spark.readStream.schema("id long, doc_id long").parquet(src), dst, str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.id, r.doc_id) for r in spark.read.parquet(dst).collect()} == {(3, 1), (2, 2)}


def test_invariants_fire(spark):
    rows = spark.createDataFrame([(1, 0, 3), (2, 5, 4), (3, 1, 1), (4, None, 1)], "id long, page_start int, page_end int")
    assert sorted(r.id for r in quality.bad_citations(rows).collect()) == [1, 2, 4]
    parts = spark.createDataFrame([("d", 1, 1, 7), ("d", 1, 2, 7), ("d", 1, 1, 8)], "doc string, proc long, part_index int, run long")
    assert [r.run for r in quality.split_tables(parts).collect()] == [7]
    caps = spark.createDataFrame([("d", 1, 0, "table", True, False), ("d", 1, 1, "table_row", False, True), ("d", 1, 2, "h2", False, False), ("d", 1, 3, "table", True, False), ("d", 1, 4, "para", False, False)], "doc string, proc long, seq long, kind string, caption boolean, content boolean")
    assert [r.seq for r in quality.captions_alone(caps).collect()] == [3]
    chunks = spark.createDataFrame([([("WARNING", "a")],), ([("NOTICE", "b")],)], "safety_blocks array<struct<type:string,text:string>>")
    banners = spark.createDataFrame([(1,), (2,)], "n int")
    assert not quality.warning_coverage(banners, chunks).first().ok and quality.warning_coverage(banners.limit(1), chunks).first().ok


def test_publication_gate(spark):
    pages = [("good", p, ["i1" + str(p)], "SEBU1", ["BR9"]) for p in range(1, 25)] + [("few", 1, ["i1"], "SEBU2", [])] + [("other", p, ["i" + str(p)], "SEBU3", ["ZZ1"]) for p in range(1, 25)]
    got = {r.doc: r.accepted for r in quality.accept(spark.createDataFrame(pages, "doc string, page int, icodes array<string>, footer_code string, prefixes array<string>"), ["BR9"]).collect()}
    assert got == {"good": True, "few": False, "other": False}
