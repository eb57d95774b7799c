"""The eight operators against brute force, round trips and defined edge cases."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import leakage, neardup, packing, pairs, pii, pii_table, queries, ranking, segmentation, sql, vectors
from foliograph.llm import wordcodes as wc
from tests.compare import check, connect

WORD = re.compile(r"[^\W_]+")


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_sql(name, spark, data, con):
    check(spark, data, con, queries.QUERIES[name], sql.SQL[name])


@pytest.mark.parametrize("name", ["p1_defects", "p2_ranking", "p3_neighbours", "p4_pieces", "p5_groups", "p6_containers", "p7_leaks", "p8_redacted", "p1_found", "p3_found", "p8_found"])
def test_whole_tables(name, spark, data):
    assert queries.QUERIES[name](spark, data).count() > 0


# 1


@pytest.mark.parametrize(
    "question, answer, may, want",
    [
        ("Which torque applies here?", None, False, "empty"),
        ("Which torque applies here?", "  \n", False, "empty"),
        ("Which torque applies here?", "N/A", False, "empty"),
        ("Which torque applies here?", "[QENR1-2, p. 5]", False, "empty"),
        ("Which torque applies here?", "Answer:", False, "empty"),
        ("Which torque applies here?", "Which  torque applies HERE", False, "copied_question"),
        ("Which torque applies here?", 'You asked: "Which torque applies here?"', False, "copied_question"),
        ("Which torque applies here?", "Here applies which torque?", False, "copied_question"),
        ("Which torque applies here?", "Which torque applies here: Tighten it evenly to 50 kPa.", False, None),
        ("Which torque applies here?", "Sorry, I am unable to answer this question.", False, "refusal"),
        ("Which torque applies here?", "Sorry, I am unable to answer this question.", True, None),
        ("Which torque applies here?", "The manual does not name the tool, yet the limit is clear. Hold 5 kPa for 3 minutes.", False, None),
        ("Какой момент указан?", "Не могу ответить на этот вопрос.", False, "refusal"),
        ("Какой момент указан?", "Es tut mir leid, dazu gibt es keine Angaben.", False, "refusal"),
        ("Какой момент указан?", "Tighten the bolt evenly and look for leaks.", False, "wrong_language"),
        ("Which torque applies here?", "Der Kolben ist bis 5 kPa zugelassen und wird danach geprüft.", False, "wrong_language"),
        ("Which torque applies here?", "El pistón admite hasta 5 kPa y después se revisa.", False, "wrong_language"),
        ("Какой момент указан?", "205 kPa (30 psi) [QENR1-2, p. 5]", False, None),
        ("Which torque applies here?", "Hold 5 kPa and look for a", False, "truncated"),
        ("Which torque applies here?", "Hold 5 kPa (see fig", False, "truncated"),
        ("Which torque applies here?", "Hold 5 kPa. [QENR", False, "truncated"),
        ("Which torque applies here?", "Carry out these 3 steps:\n1. Stop.\n2. Look.", False, "truncated"),
        ("Which torque applies here?", "Work in this order:\n1. Stop it\n2. Take 5 kPa from the table", False, None),
        ("Which torque applies here?", "Work in this order:", False, "truncated"),
        (None, "Hold 5 kPa.", False, None),
        ("", "", False, "empty"),
    ],
)
def test_defects(question, answer, may, want):
    found = pairs.judge(question, answer, may)[0]
    assert (found[0] if found else None) == want


def test_defects_table(spark):
    whole = [(i, "Which part fits the pump?", f"Work in this order:\n1. Use part {i} with a new gasket\n2. Take {i} kPa from the long table", None) for i in range(5)]
    rows = spark.createDataFrame(whole + [(9, "Which part fits the pump?", "Work in this order:\n1. Stop it\n2. Take 7 kPa from the long", None), (9, None, None, True)], "result_id long, question string, answer string, may_refuse boolean")
    got = pairs.defects(rows.withColumn("defect", F.lit("clash"))).collect()
    assert sorted((g.result_id, g.defect or "") for g in got) == [(i, "") for i in range(5)] + [(9, "empty"), (9, "truncated")]
    assert pairs.defects(rows.limit(0)).count() == 0


# 2


def naive_ideal(items, low=0.1, high=0.9):
    x = np.array([[np.nan if v is None else v for v in it[1:]] for it in items], float)
    for j in range(x.shape[1]):
        col = x[:, j]
        col[~np.isfinite(col)] = np.nan
        col[np.isnan(col)] = np.nanmin(col) if np.isfinite(col).any() else 0
        s = np.sort(col)
        n = len(s)
        col[:] = np.clip(col, s[max(int(np.ceil(low * n)) - 1, 0)], s[max(int(np.ceil(high * n)) - 1, 0)])
        col -= col.mean()
        norm = np.sqrt((col**2).sum())
        col /= norm if norm > 1e-12 else 1
    best, worst = np.sqrt(((x - x.max(0)) ** 2).sum(1)), np.sqrt(((x - x.min(0)) ** 2).sum(1))
    return np.where(best + worst > 0, worst / np.where(best + worst > 0, best + worst, 1), 0)


def test_ideal_point(spark):
    r = random.Random(5)
    rows = [(g, i, *[r.choice([None, r.gauss(0, 10**k), float("nan")]) if r.random() < 0.3 else r.gauss(0, 10**k) for k in range(4)]) for g in (1, 2, None) for i in range(25)]
    rows += [(7, 1, None, None, None, None), (8, 1, 1.0, 1.0, 1.0, 1.0), (8, 2, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows + rows[:5], "ask_id long, chunk_id long, rrf_score double, dense double, sparse double, rerank double").withColumn("closeness", F.lit(9)).withColumn("_g", F.lit("x"))
    got = {(x.ask_id, x.chunk_id): x.closeness for x in ranking.ideal_point(df, "ask_id", "chunk_id").collect()}
    assert len(got) == len(rows)
    for g in (1, 2, None):
        own = [x[1:] for x in rows if x[0] == g]
        np.testing.assert_allclose([got[(g, x[0])] for x in own], naive_ideal(own), atol=1e-9)
    assert got[(7, 1)] == 0 and got[(8, 1)] == got[(8, 2)] == 0
    assert ranking.ranked(df.limit(0), "ask_id", "chunk_id", top=5).count() == 0


def test_scale_has_no_say(spark):
    r = random.Random(6)
    rows = [(1, i, r.random(), r.random(), r.random(), r.random()) for i in range(30)]
    df = spark.createDataFrame(rows, "ask_id long, chunk_id long, rrf_score double, dense double, sparse double, rerank double")
    place = lambda d: {x.chunk_id: x.place for x in ranking.ranked(d, "ask_id", "chunk_id").collect()}
    assert place(df) == place(df.withColumn("sparse", F.col("sparse") * 10_000 + 7).withColumn("dense", F.col("dense") / 1000 - 3))


# 3


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(3, x[3].tolist(), 1), (4, x[5].tolist(), 0), (2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [1.0] * 3, 1), (None, x[9].tolist(), 1)]
    df = spark.createDataFrame(rows, "id long, embedding_dense array<float>, v int").withColumn("cell", F.lit("clash"))
    got = vectors.neighbours(df, "id", "embedding_dense", version="v", dims=16).collect()
    found = collections.defaultdict(dict)
    for g in got:
        found[g.id][g.place] = g.neighbour
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert set(found) == set(range(1500)) and all(set(f) == {1, 2, 3, 4, 5} for f in found.values())
    assert np.mean([j in found[i].values() for i in range(1500) for j in want[i]]) > 0.95
    assert vectors.neighbours(df.limit(0), "id", "embedding_dense", dims=16).count() == 0


def test_copies_of_vectors_stand_for_each_other(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, x[0].tolist() if i % 2 else x[i].tolist()) for i in range(40)]
    got = collections.defaultdict(list)
    for g in sorted(vectors.neighbours(spark.createDataFrame(rows, "id long, e array<float>"), "id", "e", dims=8).collect(), key=lambda g: g.place):
        got[g.id].append(g.neighbour)
    copies = [0] + list(range(1, 40, 2))
    assert all(got[i] == [c for c in copies if c != i][:5] for i in copies)
    assert len(got) == 40 and all(len(v) == 5 for v in got.values())


def test_few_vectors(spark):
    got = vectors.neighbours(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, e array<float>"), "id", "e", dims=2).collect()
    assert {(g.id, g.neighbour) for g in got} == {(1, 2), (2, 1)}


def test_beam_beats_greedy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 12)).astype(np.float32)
    q = vectors.fit(x, 16)
    near = q.probes(x, vectors.BEAM)
    wide, narrow = q.decode(*q.encode(x, near)), q.decode(*q.encode(x, near[:, :1]))
    assert ((x - wide) ** 2).sum() <= ((x - narrow) ** 2).sum() < ((x - q.cells[near[:, 0]]) ** 2).sum()


# 4


@pytest.mark.parametrize("seed", range(6))
def test_split_covers_and_overlaps(seed):
    r = random.Random(seed)
    seps = ["\n\n", "\r\n", "\r", ". ", " ", ""][seed:] or [" "]
    text = "".join(r.choice(["насос", "oil", "x" * 40, "😀", "valve"]) + r.choice(seps) for _ in range(5000))
    spans = segmentation.split(text, 1000, 50)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= 1000 for a, b in spans) and all(b1 - a2 == 50 for (_, b1), (a2, _) in zip(spans, spans[1:]))
    assert "".join(text[a + (50 if i else 0) : b] for i, (a, b) in enumerate(spans)) == text
    if seed == 0:
        assert all(text[b - 1] in "\n\r" for _, b in spans[:-1])


def test_split_prefers_the_change_of_topic():
    one, two = "pump seal oil grease filter drain", "captain letter office invoice paper stamp"
    text = "\n".join([one] * 20 + [two] * 20 + [one] * 20)
    first = segmentation.split(text, 1000, 20)[0][1]
    assert text[:first].endswith(one + "\n") and text[first:].startswith(two)


def test_split_short_long_and_table(spark):
    assert segmentation.split("a" * 8000) == [(0, 8000)] and segmentation.split("a" * 8001) == [(0, 8000), (7800, 8001)]
    rows = [(1, "w. " * 3000, [("WARNING", "t")]), (2, "short", None), (3, None, None), (4, "", []), (1, "z" * 20000, None)]
    df = spark.createDataFrame(rows, "id long, content string, safety_blocks array<struct<type:string,text:string>>").withColumn("part_index", F.lit("clash")).withColumn("_key", F.lit(0))
    got = segmentation.split_oversized(df).collect()
    assert {g.id for g in got} == {1} and all(len(g.content) <= 8000 for g in got)
    by = collections.Counter((g.part_total, g.safety_blocks is None) for g in got)
    assert by == {(2, False): 2, (3, True): 3}
    assert segmentation.split_oversized(df.limit(0)).count() == 0


# 5


def shingles(text, size):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_word_hashes_and_shingles():
    texts = ["Der Ölfilter, der ölfilter ist", None, "", "a b", "Насос №5 x_y 10²", "a b a b a b a b"]
    codes, _, start, stop, first = wc.words(texts)
    words = ["".join(map(chr, codes[a:b])) for a, b in zip(start, stop)]
    assert [words[a:b] for a, b in zip(first[:-1], first[1:])] == [WORD.findall((t or "").lower()) for t in texts]
    h = wc.word_hashes(codes, start, stop)
    assert len({(int(a), b) for a, b in zip(h, words)}) == len(set(words)) == len({int(a) for a in h})
    s, f = wc.shingles(h, first, 3)
    assert [b - a for a, b in zip(f[:-1], f[1:])] == [len(shingles(t, 3)) for t in texts]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(80)]
        texts.append(base)
        for _ in range(r.randint(0, 4)):
            t = base[:]
            for _ in range(r.randint(0, 8)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(t)
    texts = [" ".join(t) for t in texts]
    texts += [texts[0]] * 6 + [texts[0].upper() + "!", "", None, "two words", "two words", "three little words", "Three, little words"]
    df = spark.createDataFrame([(i, t, "2024-01-01 00:00:00") for i, t in enumerate(texts)] + [(1, "an older delivery of this text", "2020-01-01 00:00:00"), (2, texts[2], "2024-01-01 00:00:00"), (None, texts[0], None)], "id long, content string, at string")
    df = df.withColumn("at", F.to_timestamp("at")).withColumn("_rep", F.lit("clash")).withColumn("key", F.lit(1))
    sets = [shingles(t, 3) for t in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    for block in (2048, 2):
        monkeypatch.setattr(neardup, "BLOCK", block)
        near = neardup.NearDuplicates(df, "id", F.col("content"), version="at", size=3, least=0.6)
        got = [(g.id_a, g.id_b) for g in near.pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert near.members.count() == len(texts)
    empty = neardup.NearDuplicates(df.limit(0), "id", F.col("content"))
    assert empty.pairs().count() == 0 and empty.members.count() == 0


# 6


def test_plan_is_tight_and_valid():
    r = random.Random(9)
    for _ in range(40):
        cap = r.choice([10, 64, 1024])
        counts = {r.randint(1, cap): r.randint(1, 50) for _ in range(r.randint(1, 40))}
        load, seen = collections.Counter(), collections.Counter()
        for length, rank, n, first, per in packing.plan(counts, cap):
            for i in range(n):
                load[first + i // per] += length
            assert rank == seen[length]
            seen[length] += n
        assert seen == counts and max(load.values()) <= cap and set(load) == set(range(len(load)))
        total = sum(k * v for k, v in counts.items())
        assert len(load) <= 11 / 9 * -(-total // cap) + 6 / 9 + sum(v for k, v in counts.items() if k > cap / 3)


def test_pack(spark):
    r = random.Random(10)
    texts = [" ".join("w" for _ in range(n)) for n in [0, 1, 10, 20, 21, 40, 41, 100] + [r.randint(1, 30) for _ in range(300)]] + [None, "  \n", "a.b c_d!?x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("container", F.lit("clash")).withColumn("_len", F.lit(0))
    got = packing.pack(df, "doc_id", "text", 20).collect()
    load = collections.Counter()
    for g in got:
        if g.container is not None:
            load[g.container] += g.tokens
    size = lambda t: len(re.findall(r"\w+|[^\w\s]+", t or ""))
    by = collections.defaultdict(list)
    for g in got:
        by[g.doc_id].append(g)
    for i, t in enumerate(texts):
        n = size(t)
        assert sum(g.tokens for g in by[i]) == n and len(by[i]) == max(1, -(-n // 20)) and sorted(g.first_token for g in by[i]) == [20 * k for k in range(len(by[i]))]
    assert max(load.values()) <= 20 and set(load) == set(range(len(load))) and len(load) <= 1.03 * sum(load.values()) / 20 + 2
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def test_tokens_of_all_scripts(spark):
    texts = ["a1_b-c...d", "Насос №5, 10 °C", "x y　z", "東京タワー!!", "é é", "\t\n", "а́б", "__--__", "\x1cab\x1f"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(packing.token_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t)) for t in texts]


# 7


def naive_leaks(docs, held, n=15):
    grams = collections.defaultdict(set)
    for i, p in held:
        w = WORD.findall((p or "").lower())
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(i)
    return {(d, i) for d, t in docs for w in [WORD.findall((t or "").lower())] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def leak_case():
    r = random.Random(11)
    words = ["насос", "pump", "the", "of", "valve", "kPa", "и", "на"] + [f"n{i}" for i in range(60)]
    held = [(f"h{i}", " ".join(r.choice(words) for _ in range(r.randint(10, 60)))) for i in range(25)] + [("same", "a b c d e f g h i j k l m n o p q"), ("none", None), ("short", "too short")]
    docs = []
    for d in range(150):
        w = [r.choice(words) for _ in range(r.randint(0, 120))]
        if d % 2:
            p = r.choice(held[:26])[1].split()
            a = r.randrange(len(p))
            w[len(w) // 2 : len(w) // 2] = p[a : a + r.randint(8, 30)]
        docs.append((d, r.choice([" ", ", ", "\n", " <-> "]).join(w).upper() if d % 3 else " ".join(w)))
    return docs + [(900, None), (None, docs[1][1]), (901, ""), (902, " ".join(x for x in "abcdefghijklmno"))], held


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_leaks_equal_brute_force(spark, edits, monkeypatch):
    docs, held = leak_case()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("item_id", F.lit(0))
    h = spark.createDataFrame(held + held[:3], "item_id string, passage string")
    want = naive_leaks([d for d in docs if d[0] is not None], held)
    monkeypatch.setattr(leakage, "PASS_CHARS", 4_000_000 if edits else 500)
    got = leakage.leaks(df, "doc_id", "text", h, "item_id", "passage", edits=edits)
    assert len(want) > 20 and {(g.doc_id, g.item_id) for g in got.filter("words >= 15").collect()} == want
    assert leakage.leaks(df.limit(0), "doc_id", "text", h, "item_id", "passage").count() == 0
    assert leakage.leaks(df, "doc_id", "text", h.limit(0), "item_id", "passage").count() == 0


def test_edited_passages_are_found_too(spark):
    w = [f"word{i}" for i in range(30)]
    w2 = w[:]
    w2[7] = "wxrd7"
    df = spark.createDataFrame([(1, "before " + " ".join(w2) + " after")], "doc_id long, text string")
    g = leakage.leaks(df, "doc_id", "text", spark.createDataFrame([("h", " ".join(w))], "item_id string, passage string"), "item_id", "passage").first()
    assert g.words == 22 and g.edits == 1 and g.first_word == 9


# 8


def test_tagger_on_unseen_sentences():
    tag = pii.tagger()
    hit = total = 0
    for pieces in pii_table.examples(600, seed=1234):
        text = "".join(p for p, _ in pieces)
        gold = {(k, p) for p, k in pieces if k}
        got = {(k, f) for k, _, _, f in pii.find(tag, [text])[0]}
        hit += len(gold & got)
        total += len(gold | got)
    assert hit / total > 0.8


def test_pruned_decoding_equals_whole_viterbi():
    tag = pii.tagger()
    texts = ["".join(p for p, _ in e) for e in pii_table.examples(60, seed=77)]
    for t in texts:
        toks = pii.tokens(t)
        ids = np.arange(len(toks))
        em = pii.emissions(tag.scores(toks).astype(np.float32), ids, np.zeros(len(toks), int))
        shapes = np.array([pii.shape(x) for x in toks])
        em += tag.triple_weights[tag.rows_of_three(shapes, np.zeros(len(toks), int))]
        em[:, 1::2] += pii.BEGIN
        line = np.array(["\n" in x or "\r" in x for x in toks])
        em[line[:, None] & pii.INSIDE] = -1e4
        row = pii.viterbi(em[None], np.array([len(toks)]), tag.trans, tag.trans[0].copy())[0]
        starts = [i for i in range(len(row)) if row[i] and (row[i] % 2 == 1 or i == 0 or row[i - 1] == 0)]
        assert len(pii._decode(tag, [t])[0]) == len(starts)


def test_gradient_fits_and_viterbi_is_best():
    rng = np.random.default_rng(5)
    em, trans, start = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    import itertools

    score = lambda y: start[y[0]] + sum(em[0, i, y[i]] for i in range(4)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
    best = max(itertools.product(range(3), repeat=4), key=score)
    assert tuple(pii.viterbi(em, np.array([4]), trans, start)[0]) == best


def test_mentions_table(spark):
    rows = [(1, "Dear Ms Hawthorne, the parts leave on Monday."), (2, None), (3, ""), (4, "Order 6287-920-784 covers one drain plug."), (1, "Call back on +1 416 555 0155 before noon."), (5, "x " * 200_000), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mentions", F.lit("clash"))
    got = pii.mentions(df).collect()
    got = [g for g in got if g.doc_id is not None]
    out = sorted((g.doc_id, [(m.kind, m.found) for m in g.mentions or []], (g.redacted or "")[:60]) for g in got)
    assert out[0] == (1, [("name", "Hawthorne")], "Dear Ms [NAME], the parts leave on Monday.")
    assert out[1] == (1, [("phone", "+1 416 555 0155")], "Call back on [PHONE] before noon.")
    assert [o[1] for o in out[2:]] == [[], [], [], []] and next(g.redacted for g in got if g.doc_id == 2) is None
    assert pii.mentions(df.limit(0)).count() == 0
