"""Problem 8: personal information inside free text (linear-chain conditional random field).

Every token has the features of its own form, of its neighbours' and of the shapes of three tokens in a row; weights are
fitted to a labelled table by the gradient of the likelihood, and texts are decoded by Viterbi, many stretches at a time.
``python -m foliograph.llm.pii`` fits anew and writes the weights to ``WEIGHTS``, the same in every run.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.llm import pii_table
from foliograph.llm import wordcodes as wc
from foliograph.llm.pii_table import KINDS

LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
#: A token with the white space before it: a run of letters, a run of digits, or one other character.
_TOKEN = re.compile(r"\s*(?:[^\W\d_]+|\d+|[^\s]|$)")
#: Features that occur less often in the table have no weight, so that made-up words and names have none of their own; nor
#: have rare rows of three shapes.
LEAST, LEAST_TRIPLES = 16, 6
#: Added to the scores of labels that begin a mention: the value at which recall and precision on the held-out part of
#: the table balance, as a mention that is missed does more harm than a word that is hidden.
BEGIN = 1.4
#: Tokens from a possible beginning on that are decoded with it.
REACH = 24
INSIDE = np.asarray([x[0] == "I" for x in LABELS])
PLACEHOLDER = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}


def tokens(text: str) -> list[str]:
    out = _TOKEN.findall(text)
    while out and not out[-1].strip():
        out.pop()
    return out


def features(token: str) -> tuple[list[str], list[str]]:
    """Features of a token: those that neighbours see, and those of its own form beside."""
    word = token.lstrip()
    gap = "g=" if len(word) == len(token) else "g=n" if "\n" in token or "\r" in token else "g=s"
    low = word.lower()
    if word[0].isdigit():
        return ["d=" + str(min(len(word), 13)), gap], ["kd", "d0=" + word[0] + str(min(len(word), 13)), "zz=" + str(word[:2] == "00")]
    if not word[0].isalpha():
        return ["p=" + word, gap], ["kp"]
    shape = "X" if len(word) == 1 and word.isupper() else "XX" if word.isupper() else "Xx" if word[0].isupper() and word[1:].islower() else "x" if word.islower() else "xX"
    near = ["w=" + low, "s=" + shape, gap]
    own = ["c=" + ("k" if low[0] >= "а" else "l") + shape, "n=" + str(min(len(low), 8))]
    if len(low) > 3:
        own += ["e3=" + low[-3:], "e2=" + low[-2:], "b3=" + low[:3], "e4=" + low[-4:]]
    return near, own


#: Shapes of a token for the rows of three; punctuation marks have a shape each.
_MARKS = {c: i for i, c in enumerate(".,;:@()[]-/<>=|+\"'№#&_")}
SHAPES = 128


def shape(token: str) -> int:
    """The number of a token's shape; one more bit tells whether it begins a line."""
    word = token.lstrip()
    if word[0].isdigit():
        k = 1 + min(len(word), 8)
    elif word[0].isalpha():
        rest = word[1:]
        k = 10 + (0 if not rest and word.isupper() else 1 if word.isupper() else 2 if word[0].isupper() and rest.islower() else 3 if word.islower() else 4)
        k += 5 if word[0].lower() >= "а" else 0
    else:
        k = 20 + _MARKS.get(word[0], len(_MARKS))
    line = token[0].isspace() and ("\n" in token or "\r" in token)
    return k + (SHAPES // 2 if line else 0)


@dataclass
class Tagger:
    index: dict[str, int]
    weights: np.ndarray  # (offsets, features + 1, labels); the last feature is none
    trans: np.ndarray  # (labels, labels)
    start: np.ndarray
    triples: np.ndarray  # rows of three shapes that have weights, in order
    triple_weights: np.ndarray  # (triples + 1, labels); the last is for all others
    known: dict[str, int] = field(default_factory=dict)
    tables: list[np.ndarray] = field(default_factory=list)
    shapes: list[np.ndarray] = field(default_factory=list)
    places: np.ndarray | None = None  # of every row of three shapes, its number among those that have weights

    def columns(self, types: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the features of each type of token: seen by neighbours, and all."""
        none, pad = len(self.index), 10
        near, full = (np.full((len(types), pad), none, np.int64) for _ in range(2))
        for i, t in enumerate(types):
            a, b = features(t)
            a = [self.index[x] for x in a if x in self.index]
            b = [self.index[x] for x in b if x in self.index]
            near[i, : len(a)] = a
            full[i, : len(a) + len(b)] = a + b
        return near, full

    def scores(self, types: list[str]) -> np.ndarray:
        """``(offsets, types, labels)``: what a type adds to the labels of the tokens around it."""
        near, full = self.columns(types)
        return np.stack([self.weights[k][full if abs(o) < 2 else near].sum(1) for k, o in enumerate(OFFSETS)])

    def rows_of_three(self, shapes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The number of the row of three around each token; beyond a text's ends there is shape 0."""
        if self.places is None:
            self.places = np.full(SHAPES**3, len(self.triples), np.int32)
            self.places[self.triples] = np.arange(len(self.triples))
        return self.places[triples(shapes, owner)]


def triples(shapes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    before, after = np.zeros_like(shapes), np.zeros_like(shapes)
    same = owner[1:] == owner[:-1]
    before[1:][same] = shapes[:-1][same]
    after[:-1][same] = shapes[1:][same]
    return (before * SHAPES + shapes) * SHAPES + after


def emissions(scores: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Scores of the labels of each token from its neighbours within the same text."""
    n = len(ids)
    out = np.zeros((n, scores.shape[2]), scores.dtype)
    for k, o in enumerate(OFFSETS):
        a, b = max(0, -o), min(n, n - o)
        if b <= a:
            continue
        part = scores[k][ids[a + o : b + o]]
        if o:
            part[owner[a + o : b + o] != owner[a:b]] = 0
        out[a:b] += part
    return out


#: The fitted weights; made by ``python -m foliograph.llm.pii``.
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
_FITTED: list[Tagger] = []


def tagger(path: str = WEIGHTS) -> Tagger:
    """The fitted tagger: from its file, or fitted to the table where there is none. It is kept in the driver."""
    if not _FITTED:
        _FITTED.append(load(path) if os.path.exists(path) else fit(pii_table.examples()))
    return _FITTED[0]


def save(tag: Tagger, path: str = WEIGHTS) -> None:
    """Weights in steps of 1/64, by feature, without those that are zero throughout."""
    with open(path, "wb") as f:
        grid = lambda x: np.clip(np.rint(x * 64), -32000, 32000).astype(np.int16)
        np.savez_compressed(f, index="\n".join(tag.index), weights=grid(tag.weights), trans=tag.trans, start=tag.start, triples=tag.triples, triple_weights=grid(tag.triple_weights))


def load(path: str = WEIGHTS) -> Tagger:
    with np.load(path) as z:
        index = {f: i for i, f in enumerate(str(z["index"]).split("\n"))}
        return Tagger(index, z["weights"].astype(np.float32) / 64, z["trans"], z["start"], z["triples"], z["triple_weights"].astype(np.float32) / 64)


def labelled(pieces: list[tuple[str, str | None]]) -> tuple[list[str], list[int]]:
    """Tokens of a labelled text and the numbers of their labels."""
    text = "".join(p for p, _ in pieces)
    spans, at = [], 0
    for p, k in pieces:
        if k:
            spans.append((at, at + len(p), k))
        at += len(p)
    toks, labels, at = tokens(text), [], 0
    for t in toks:
        s, e = at + len(t) - len(t.lstrip()), at + len(t)
        at = e
        hit = next(((a, k) for a, b, k in spans if a <= s and e <= b), None)
        labels.append(0 if hit is None else 1 + 2 * KINDS.index(hit[1]) + (s != hit[0]))
    return toks, labels


def fit(texts: list[list[tuple[str, str | None]]], rounds: int = 40, rate: float = 0.05, decay: float = 2e-4, trace: list[float] | None = None) -> Tagger:
    """Maximum likelihood by gradient steps of adaptive size (Adam) over all texts at once; forward and backward sums are
    scaled at each position."""
    data = [labelled(t) for t in texts]
    data.sort(key=lambda d: len(d[0]))
    types = sorted({t for toks, _ in data for t in toks})
    number = {t: i for i, t in enumerate(types)}
    ids = np.concatenate([[number[t] for t in toks] for toks, _ in data])
    often = np.bincount(ids, minlength=len(types))
    seen: Counter[str] = Counter()
    for t, n in zip(types, often.tolist()):
        for part in features(t):
            for f in part:
                seen[f] += n
    names = sorted(f for f, n in seen.items() if n >= LEAST)
    gold = np.concatenate([y for _, y in data])
    lens = np.asarray([len(y) for _, y in data])
    owner = np.repeat(np.arange(len(data)), lens)
    begin = np.cumsum(lens) - lens
    pos = np.arange(len(ids)) - begin[owner]
    form = np.asarray([shape(t) for t in types], np.int64)[ids]
    code, count = np.unique(triples(form, owner), return_counts=True)
    code = code[count >= LEAST_TRIPLES]
    L = len(LABELS)
    tag = Tagger({f: i for i, f in enumerate(names)}, np.zeros((len(OFFSETS), len(names) + 1, L)), np.zeros((L, L)), np.zeros(L), code, np.zeros((len(code) + 1, L)))
    near, full = tag.columns(types)
    three = tag.rows_of_three(form, owner)
    size, longest = len(data), int(lens.max())
    forbidden = np.zeros((L, L))
    for j, l in enumerate(LABELS):
        if l[0] == "I":
            forbidden[[i for i in range(L) if LABELS[i][2:] != l[2:]], j] = -1e4
    first = np.where([l[0] == "I" for l in LABELS], -1e4, 0.0)
    params = [tag.weights, tag.trans, tag.start, tag.triple_weights]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    true_trans = np.zeros((L, L))
    inner = owner[1:] == owner[:-1]
    np.add.at(true_trans, (gold[:-1][inner], gold[1:][inner]), 1)
    true_start = np.bincount(gold[begin], minlength=L).astype(float)
    def sums(group: np.ndarray, count: int):
        """Sums of rows by group, by one sort made beforehand."""
        order = np.argsort(group, kind="stable")
        some, at = np.unique(group[order], return_index=True)

        def add(rows: np.ndarray) -> np.ndarray:
            out = np.zeros((count, rows.shape[1]))
            out[some] = np.add.reduceat(rows[order], at, axis=0)
            return out

        return add

    by_type = []
    for o in OFFSETS:
        a, b = max(0, -o), min(len(ids), len(ids) - o)
        ok = np.flatnonzero(owner[a + o : b + o] == owner[a:b])
        by_type.append((a + ok, sums(ids[a + o + ok], len(types))))
    by_feature = {}
    for name, cols in (("near", near), ("full", full)):
        row, col = np.nonzero(cols < len(names))
        by_feature[name] = (row, sums(cols[row, col], len(names) + 1))
    by_triple = sums(three, len(code) + 1)
    # Texts stand in order of length, so those that reach a position are the last ones.
    since = np.searchsorted(lens, np.arange(longest), side="right")
    for step in range(1, rounds + 1):
        scores = np.stack([tag.weights[k][full if abs(o) < 2 else near].sum(1) for k, o in enumerate(OFFSETS)])
        em = emissions(scores, ids, owner) + tag.triple_weights[three]
        em -= em.max(1, keepdims=True)
        e = np.ones((size, longest, L))
        e[owner, pos] = np.exp(em)
        t = np.exp(tag.trans + forbidden)
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        a = np.exp(tag.start + first) * e[:, 0]
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for i in range(1, longest):
            k = since[i]
            a = (alpha[k:, i - 1] @ t) * e[k:, i]
            alpha[k:, i] = a / a.sum(1, keepdims=True)
        exp_trans = np.zeros((L, L))
        for i in range(longest - 1, 0, -1):
            k = since[i]
            m = e[k:, i] * beta[k:, i]
            b = m @ t.T
            beta[k:, i - 1] = b / b.sum(1, keepdims=True)
            scale = 1 / ((alpha[k:, i - 1] @ t) * m).sum(1, keepdims=True)
            exp_trans += t * ((alpha[k:, i - 1] * scale).T @ m)
        post = alpha * beta
        d = post[owner, pos]
        d /= d.sum(1, keepdims=True)
        start_grad = d[begin].sum(0) - true_start
        d[np.arange(len(gold)), gold] -= 1
        grad_w = np.zeros_like(tag.weights)
        for k, o in enumerate(OFFSETS):
            rows, add = by_type[k]
            row, gather = by_feature["full" if abs(o) < 2 else "near"]
            grad_w[k] = gather(add(d[rows])[row])
        grad_w[:, -1] = 0
        if trace is not None:
            trace.append(float(-np.log(np.maximum(d[np.arange(len(gold)), gold] + 1, 1e-300)).mean()))
        for p, g, (m1, m2) in zip(params, (grad_w / size, (exp_trans - true_trans) / size, start_grad / size, by_triple(d) / size), moments):
            g = g + decay * p
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            p -= rate * min(1.0, 3 * (1 - step / (rounds + 1))) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    tag.trans = np.maximum(tag.trans + forbidden, -1e4)
    tag.start = tag.start + first
    tag.weights = tag.weights.astype(np.float32)
    tag.triple_weights = tag.triple_weights.astype(np.float32)
    return tag


def viterbi(em: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best labels of each stretch: ``em`` is (stretches, longest, labels), beyond ``lens`` it doesn't count."""
    n, longest, _ = em.shape
    back = np.zeros(em.shape, np.int8)
    score = em[:, 0] + start
    into = np.ascontiguousarray(trans.T)  # by the label gone to, so that the best one before lies side by side
    for i in range(1, longest):
        cand = score[:, None, :] + into
        best = cand.argmax(2)
        back[:, i] = best
        score = np.where((lens > i)[:, None], np.take_along_axis(cand, best[:, :, None], 2)[:, :, 0] + em[:, i], score)
    out = np.zeros((n, longest), np.int8)
    label = score.argmax(1)
    for i in range(longest - 1, -1, -1):
        live = lens > i
        out[live, i] = label[live]
        label = np.where(live, back[np.arange(n), i, label], label) if i else label
    return out


def _decode(tag: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans ``(start, end, kind)`` of the mentions of each text."""
    toks: list[str] = []
    counts = []
    for t in texts:
        x = tokens(t)
        counts.append(len(x))
        toks += x
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not toks:
        return spans
    types = tag.known
    fresh = list({t for t in set(toks) if t not in types})
    if len(types) + len(fresh) > 400_000:
        types.clear()
        tag.tables, tag.shapes = [], []
        fresh = list(set(toks))
    if fresh:
        tag.tables.append(tag.scores(fresh).astype(np.float32))
        tag.shapes = [np.concatenate([*tag.shapes, np.asarray([shape(t) for t in fresh], np.int64)])]
        types.update(zip(fresh, range(len(types), len(types) + len(fresh))))
        if len(tag.tables) > 1:
            tag.tables = [np.concatenate(tag.tables, axis=1)]
    ids = np.fromiter(map(types.__getitem__, toks), np.int64, len(toks))
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)))
    owner = np.repeat(np.arange(len(texts)), counts)
    em = emissions(tag.tables[0], ids, owner) + tag.triple_weights[tag.rows_of_three(tag.shapes[0][ids], owner)]
    em[:, 1::2] += BEGIN
    # What leaving O can gain, at most: a mention begins at some token, goes on over others and ends. Where no mention that
    # begins at a token can gain anything, none begins there.
    at_line = tag.shapes[0][ids] >= SHAPES // 2
    em[at_line[:, None] & INSIDE] = -1e4  # a mention stays within its line
    # All tokens of a mention are of one kind, so the kinds are looked at one by one.
    step = (np.where(tag.trans > -1e3, tag.trans, -np.inf) - tag.trans[0, 0]).astype(np.float32)
    rise = em[:, 1:] - em[:, :1]
    first, inner = rise[:, ::2] + step[:, 1::2].max(0), np.maximum(rise[:, 1::2] + step[:, 2::2].max(0), 0)
    close = np.maximum(step[1::2][:, [0, *range(1, len(LABELS), 2)]].max(1), step[2::2][:, [0, *range(1, len(LABELS), 2)]].max(1))
    ahead = np.concatenate((np.zeros((1, len(KINDS))), np.cumsum(inner, axis=0, dtype=np.float64)))
    here = np.arange(len(ids))
    far = np.minimum(here + REACH, len(ids))
    hot = np.flatnonzero((first + (ahead[far] - ahead[here + 1]) + np.maximum(close, 0) > 0).any(1))
    if not len(hot):
        return spans
    base = np.cumsum(counts) - counts
    lo = np.maximum(hot - 1, base[owner[hot]])
    hi = np.minimum(hot + REACH, base[owner[hot]] + np.asarray(counts)[owner[hot]])
    new = np.ones(len(hot), bool)
    new[1:] = (lo[1:] > hi[:-1]) | (owner[hot][1:] != owner[hot][:-1])
    group = np.flatnonzero(new)
    lo, hi = lo[group], hi[np.append(group[1:], len(hot)) - 1]
    start = tag.trans[0].copy()
    shift = np.concatenate(([0], ends))
    order = np.argsort(hi - lo, kind="stable")
    for i in range(0, len(order), 512):
        part = order[i : i + 512]
        a, n = lo[part], (hi - lo)[part]
        grid = np.minimum(a[:, None] + np.arange(n.max()), len(ids) - 1)
        best = viterbi(em[grid], n, tag.trans, start)
        for r in np.flatnonzero(best.any(1)):
            row = best[r, : n[r]]
            at = np.flatnonzero(row)
            cut = np.flatnonzero((row[at] % 2 == 1) | np.concatenate(([True], np.diff(at) > 1)))
            for s, e in zip(cut, np.append(cut[1:], len(at))):
                x, y = a[r] + at[s], a[r] + at[e - 1]
                d = owner[x]
                off = shift[base[d]]
                text_at = int(ends[x] - off - len(toks[x].lstrip()))
                spans[d].append((text_at, int(ends[y] - off), KINDS[(row[at[s]] - 1) // 2]))
    return [sorted(s) for s in spans]


#: Abbreviations in addresses that are written with a full stop, always or at times.
ABBREVIATED = {"st", "str", "blvd", "ул", "пер", "просп", "пр", "д", "кв", "г"}
SOMETIMES = {"rd", "ave", "apt", "ln", "ct"}
_AT = re.compile(r"@|[(\[]\s*at\s*[)\]]|\sat\s", re.I)


#: What a ship is announced by, what a machine, a part or an order is, and words that are no name by themselves.
_SHIP = re.compile(r"(?:(?<!\w)(?:M/?V|M/?T|M/?S|S/?S|HMS|т/х|м/в)|(?<!\w)(?i:tug|tugboat|barge|ferry|trawler|tanker|vessel|motor vessel|ship|yacht|dredger|буксир|судно|теплоход|танкер|баржа|паром|schiff|schlepper|frachter|buque|remolcador|barco))\.?[ \"«'„“]+(?:[A-ZА-ЯЁ][\w-]*[ ]+){0,2}\Z")
_SHIP_FIRST = re.compile(r"(?:(?:M/?V|M/?T|M/?S|S/?S|HMS|т/х)|(?i:tug|barge|vessel|судно|теплоход|буксир|buque|schiff))[ ]")
_MACHINE = re.compile(
    r"(?<!\w)(?:counter|engine|motor|device|gauge|meter|unit|machine|pump|serial|s/n|part|order|seal|tag|drum|batch|lot|kit|valve|tool|panel|module|invoice|счётчик|счетчик|двигатель|прибор|насос|деталь|заказ|пломба|партия|накладная|модуль"
    r"|zähler|gerät|pumpe|teil|bestellung|plombe|equipo|bomba|pieza|pedido|precinto|contador)s?(?:[ ]+(?:no\.?|nos\.?|number|numbers|num\.|№|nr\.?|nummer|n\.º|nº|número|номер|#))?[ :#№]*\Z",
    re.I,
)
_NO_NAME = set(
    "we i you he she it they who this that these those there here all both the a an tel fax phone mobile mail from to cc dear subject wir ich sie er es ihr der die das ein eine den dem alle beide telefon mobil "
    "nosotros yo él ella ellos usted ustedes el la los las un una todos tel teléfono мы я вы он она они это все оба тел факс телефон кому от".split()
)
_ARTICLES = {"the", "a", "an", "der", "die", "das", "ein", "eine", "el", "los", "las", "una"}
_HEADING = re.compile(r"[ \t]+[-–—][ \t]+([^\W\d_]+)")
_HEADS = {w.lower() for w in pii_table.HEADS}
_GIVEN = re.compile(r",[ ][A-ZА-ЯЁ][a-zа-яё]+(?:-[A-ZА-ЯЁ][a-zа-яё]+)?(?=[ \t]*(?:[\n\r(<;|]|\Z))")
#: The floor of a house, the only ordinal number that goes on inside an address.
_FLOOR = r"(?!(?:Stock|OG|Etage|Obergeschoss|floor|этаж|piso)\b)"


def settle(text: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """A mention as what stands before and after it has it: ships, machines, parts, headings and pronouns are none, and a
    mention doesn't run into a list number or the next sentence. Bounds are made exact by ``tidy`` afterwards."""
    while start < end and text[start].isspace():
        start += 1
    if start == end:
        return None
    s, before = text[start:end], text[max(0, start - 60) : start]
    if kind in ("name", "address") and (_SHIP.search(before) or _SHIP_FIRST.match(s)):
        return None
    if kind == "name":
        words = re.findall(r"[^\W\d_]+", s)
        if not words or (words[0].lower() in _NO_NAME if len(words) == 1 else s.split()[0].lower() in _ARTICLES):
            return None
        # The line, as far as 200 characters around: texts may be one long line.
        line_at = max(text.rfind("\n", max(0, start - 200), start) + 1, start - 200, 0)
        line = text[line_at : end + 200].split("\n")[0] if "\n" not in s else s
        if len(words) == 1 and words[0].islower() and not line.islower():
            return None  # a single word in lower case is a name only where all is in lower case
        head = _HEADING.match(text, end)
        if head and not text[line_at:start].strip(" \t0123456789.#*") and head.group(1).lower() in _HEADS:
            return None
        while text[end - 1] in ", ":
            end -= 1
        if len(words) == 1 and len(words[0]) > 2 and words[0].isupper() and not line.isupper():
            given = _GIVEN.match(text, end)
            end = given.end() if given else end
    elif kind == "email":
        while start and (text[start - 1].isalnum() or text[start - 1] in "._+-") and text[start].isalnum():
            start -= 1
    elif kind in ("phone", "id_number"):
        digit = re.search(r"[^\W_]*\d", s)
        at = start + (digit.start() if digit else 0)
        if _MACHINE.search(text[max(0, at - 60) : at]):
            return None
        last = re.compile(r"(\d{3}-\d{3}-\d{3}) \d\d(?!\d)").match(text, start)
        if kind == "phone" and last and end <= last.end():
            return start, last.end(), "id_number"  # the Russian insurance number (СНИЛС)
        number = re.search(r"(?<=\w)\s+\d{1,2}\.?\s*\Z", s)
        if kind == "id_number" and number and re.match(r"\.?\s+[^\W\d_]", text[end : end + 9]) and not re.fullmatch(r"[\d\s-]+", s[: number.start()]):
            end = start + number.start()
    else:
        for how in (
            rf"\d\.\s+{_FLOOR}(?=[A-ZА-ЯЁ][a-zа-яё]|\d)",  # a number that closes a sentence
            r"(?<=\d\d\d\d\d) (?=[A-Z][a-z]*[ ][A-Z])(?<=[A-Za-z] \d\d\d\d\d )",  # what follows a town's postcode
        ):
            m = re.search(how, s)
            if m:
                end = start + m.start() + (s[m.start()].isdigit())
                s = text[start:end]
        town = re.search(r"(?<!\d)\d{5} [A-ZÄÖÜ][\wäöüß]+(?:[ -][A-ZÄÖÜ][\wäöüß]+)*(?= [a-zäöüß]{3,}\b)", s)
        if town:
            end = start + town.end()
        s = text[start:end]
        number = re.search(r"(?<=[a-z]) \d{1,2}\Z", s)
        if number and re.match(r"\.\s+[^\W\d_]", text[end : end + 9]) and any(c.isdigit() for c in s[: number.start()]):
            end = start + number.start()
        elif re.search(r", [A-Z][a-z]+(?: [A-Z][a-z]+)*\Z", s):
            code = re.compile(r" \d{5}(?![\w-])").match(text, end)
            end = code.end() if code else end
    return start, end, kind


_TAXPAYER = re.compile(r"(?<!\w)(?:ИНН|инн|Инн)[ :№]{1,3}(\d{12}|\d{10})(?!\d)")
_BEFORE_MAIL = re.compile(r"(?<![\w-])([^\W\d_][\w'’-]+(?: [^\W\d_]\.)?|[^\W\d_]\.) ([^\W\d_][\w'’-]+) [(<]\Z")
_SALUTED = re.compile(r"(?<!\w)(?:Dear (?:Mr|Mrs|Ms|Dr)\.?|Sehr geehrter Herr|Sehr geehrte Frau|Estimado Sr\.?|Estimada Sra\.?) ((?:[A-ZÄÖÜÁÉÍÓÚÑ][\w'’-]+)(?: [A-ZÄÖÜÁÉÍÓÚÑ][\w'’-]+)?)(?=,)")


def more(text: str, mentions: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The mentions with those that their form alone proves: a taxpayer's number (ИНН) of its published length, the name in a
    salutation, and the two words before a bracketed mail address that has one of them in it. A part of such a name found
    by itself gives way to it."""
    out = [(*m.span(1), "id_number") for m in _TAXPAYER.finditer(text)] + [(*m.span(1), "name") for m in _SALUTED.finditer(text)]
    for a, b, k in mentions:
        m = _BEFORE_MAIL.search(text, max(0, a - 60), a) if k == "email" else None
        local = re.split(_AT, text[a:b])[0].lower() if m else ""
        if m and any(len(w) > 3 and w.lower() in local for w in re.findall(r"[^\W\d_]+", m.group())):
            out.append((m.start(1), m.end(2), "name"))
    begins, parts, new = [a for a, _, _ in mentions], set(), []  # mentions are in order and apart
    for x in out:
        i = bisect_left(begins, x[1])
        met = set()
        while i and mentions[i - 1][1] > x[0]:
            i -= 1
            met.add(mentions[i])
        if all(x[0] <= a and b <= x[1] and k == x[2] == "name" for a, b, k in met):
            new.append(x)
            parts |= met
    return sorted([m for m in mentions if m not in parts] + new)


def tidy(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """A mention's exact bounds, or None if it can't be one of its kind."""
    s = text[start:end]
    if kind == "phone":
        m = re.search(r"[+(]?\d.*\d", s, re.S)
        if not m or sum(c.isdigit() for c in s) < 7:
            return None
        a, b = start + m.start(), start + m.end()
        if text[a] == "+" and sum(c.isdigit() for c in text[a:b]) < 10:
            more = re.compile(r"(?:[ -]\d{2,4})+(?!\d)").match(text, b)
            b = more.end() if more else b
        if a and text[a - 1] == "+" and text[a] != "+":
            a -= 1
        return a, b
    if kind == "email":
        while end > start and not text[end - 1].isalnum() and text[end - 1] not in ")]":
            end -= 1
        return (start, end) if _AT.search(text[start:end]) else None
    if kind == "id_number":
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while start < end and not text[start].isalnum():
            start += 1
        # A number goes on to the end of its run and over hyphens; two national formats, the British insurance number and
        # the Russian one (СНИЛС), end in a group of their own.
        more = re.compile(r"[^\W_]*(?:-\d+)*(?!\w)").match(text, end)
        end = more.end() if more else end
        last = r" [A-Z](?!\w)" if re.fullmatch(r"[A-Z]{2}(?: \d\d){3}", text[start:end]) else r" \d\d(?!\d)" if re.fullmatch(r"\d{3}-\d{3}-\d{3}", text[start:end]) else r"(?!)"
        more = re.compile(last).match(text, end)
        end = more.end() if more else end
        return (start, end) if sum(c.isdigit() for c in text[start:end]) >= 5 else None
    while end > start and text[end - 1] in ",;:|<>()\"' \n\r\t-=" or text[start:end].endswith(".."):
        end -= 1
    while start < end and text[start] in ".,;:|<>()\"' \n\r\t-":
        start += 1
    if kind == "address":
        # No sentence begins inside an address.
        for m in re.finditer(r"([^\W_]+)\.\s+(?=[^\W\d_])", text[start:end]):
            if m.group(1).lower() not in ABBREVIATED and not any(c.isdigit() for c in text[start + m.end() : end]):
                end = start + m.end(1)
                break
    # A closing full stop belongs to an abbreviation or an initial, else to the sentence.
    if end > start and text[end - 1] == ".":
        end -= 1
    last = re.search(r"([^\W\d_]+)$", text[start:end])
    word = last.group(1) if last else ""
    if text[end : end + 1] == "." and (len(word) == 1 and word.isupper() if kind == "name" else word.lower() in ABBREVIATED or word.lower() in SOMETIMES and text[end + 1 : end + 2] in (".", ",")):
        end += 1
    if kind == "address":
        return (start, end) if any(c.isdigit() for c in text[start:end]) else None
    return (start, end) if re.search(r"[^\W\d_]{2}", text[start:end]) else None


MENTION = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("found", T.StringType())])
TAGGED = T.StructType([T.StructField("mentions", T.ArrayType(MENTION)), T.StructField("redacted", T.StringType())])


def find(tag: Tagger, texts: list[str | None]) -> list[list[tuple[str, int, int, str]]]:
    """Mentions ``(kind, start, end, found)`` of each text, in order and without overlap."""
    out: list[list[tuple[str, int, int, str]]] = []
    for part in wc.slices(texts, 1 << 18):
        batch = [t or "" for t in texts[part]]
        for t, spans in zip(batch, _decode(tag, batch)):
            row, last = [], 0
            spans = sorted(x for x in (settle(t, *s) for s in spans) if x)
            for a, b, k in more(t, spans):
                fixed = tidy(t, a, b, k)
                if fixed and fixed[0] >= last and fixed[1] > fixed[0]:
                    row.append((k, *fixed, t[fixed[0] : fixed[1]]))
                    last = fixed[1]
            out.append(row)
    return out


def redact(text: str | None, mentions: list[tuple[str, int, int, str]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for k, a, b, _ in mentions:
        out += [text[at:a], PLACEHOLDER[k]]
        at = b
    return "".join(out) + text[at:]


def mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its mentions and the text with placeholders in their places: ``(key, mentions, redacted)``.

    * ``mentions`` are ``(kind, start, end, found)`` in code points, in order, ``found`` exactly as in the text.
    * A null text has no mentions and stays null; a text without mentions stays as it is. Rows that repeat a key are
      tagged each on its own. Other columns are ignored; an empty table gives an empty result.

    Texts are tagged whole, in Arrow batches of their own partition, without a shuffle. Executors get the weights, a few
    megabytes whatever the input.
    """
    tag = tagger()
    shared = docs.sparkSession.sparkContext.broadcast(Tagger(tag.index, tag.weights, tag.trans, tag.start, tag.triples, tag.triple_weights))

    def run(cols: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in cols:
            texts = texts.tolist()
            found = find(shared.value, texts)
            yield pd.DataFrame({"mentions": found, "redacted": [redact(t, m) for t, m in zip(texts, found)]})

    udf = F.pandas_udf(run, TAGGED)
    return docs.select(F.col(f"`{key}`").alias(key), udf(F.col(f"`{text}`")).alias("_t")).select(key, "_t.*")


if __name__ == "__main__":
    save(fit(pii_table.examples()))
