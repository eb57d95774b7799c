"""Problem 1: broken prompt and response pairs (ordered rules).

Rules look at the answer beside its question: no statement, the question given back, a mere refusal, another
language, an abrupt end. Where a list stops without punctuation, the ends of all other answers decide: a last pair of
words that goes on elsewhere and ends nowhere was cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.session import materialise

#: Defects in the order of the rules.
KINDS = ("empty", "copied_question", "refusal", "wrong_language", "truncated")

_CITATION = re.compile(r"\[[^\[\]\n]*\d[^\[\]\n]*\]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_LABEL = re.compile(r"^\s*(?:answer|ответ|antwort|respuesta|réponse|question|вопрос|frage|pregunta|q|a)\s*[:：]\s*", re.I | re.M)
_FRAME = re.compile(
    r"\b(?:you asked|you are asking|your question (?:is|was)|the question (?:is|was)|asked|вы спросили|вы спрашиваете|ваш вопрос|вопрос звучит так|sie fragten|ihre frage|usted preguntó|su pregunta|question|вопрос|frage|pregunta|answer|ответ)\b",
    re.I,
)
_NOTHING = set(
    "n/a|na|n.a.|nil|null|none|nan|empty|blank|no answer|no response|not available|unknown|tbd|todo|нет ответа|нет|пусто|без ответа|неизвестно|не указано|keine antwort|keine|leer|sin respuesta|vacío|ninguna|sans réponse".split("|")
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W_]+")
#: A run without white space that has a digit, found from its beginning only.
_DIGITS = re.compile(r"(?<!\S)[^\s\d]*+\d\S*")
_MASKS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|\d+|[,:;]")
_BULLET = re.compile(r"^\s*(?:\d+[.)]|[-*•–])\s+")
_STOPPED = re.compile(r"(?<=[.!?…])\s+")
_MARKS = re.compile(r"[\s()\[\]{}<>*_.\"'`«»–—\-]+")
_CYRILLIC = re.compile(r"[а-яёіїєґ]", re.I)
_UNITS = set("kpa psi bar rpm mm cm m l ml kw w hz mv v n nm mpa kg g c f s h min кпа бар мм см м л мл квт вт гц мв в н нм мпа кг г об мин ч с стр p pp page adem".split())

_REFUSAL = [
    re.compile(p, re.I)
    for p in (
        # English
        r"\b(?:can(?:no|['’])t|can not|could not|couldn['’]t|unable to|not able to|am not able)\b.*\b(?:answer|help|advise|assist|find|provide|comment|say|tell|locate|determine|respond)\b",
        r"\b(?:must|have to|i) (?:decline|refuse)\b|\bi(?: am|['’]m) sorry\b|^sorry\b.*\b(?:unable|cannot|can['’]t|not|no)\b",
        r"\bi (?:do not|don['’]t|did not|didn['’]t) know\b|\bno (?:data|information|answer|details?)\b.*\b(?:available|given|found|about)\b",
        r"\b(?:documentation|manual|handbook|excerpts?|fragments?|pages?|publication|document|text)\b.*\b(?:do(?:es)? not|don['’]t|doesn['’]t|did not)\b.*\b(?:describe|mention|contain|cover|say|include|list|state|give|specify)\b",
        r"\b(?:documentation|manual|handbook|publication|document|text)\b.*\bsays? nothing\b",
        r"\bis(?: not|n['’]t) (?:listed|mentioned|described|given|stated|covered|available|included|in the)\b|\bthere is no information\b",
        r"\boutside (?:of )?(?:what|the scope)\b|\bbeyond the scope\b|\bunsafe for me\b|\bno answer can be given\b",
        # Russian
        r"\bне могу\b.*\b(?:ответ|помо|подсказ|сказать|совет|найти)|\bне (?:вправе|имею права)\b|\bзатрудня\w+ (?:ответ|с ответ)|\bвынужден\w* отказ|\bотказываюсь\b",
        r"\bне (?:нашл\w*|найден\w*|обнаружен\w*|содерж\w*|описыва\w*|упомина\w*|указан\w*|приложен\w*)\b|\bничего не сказано\b|\bэтого нет\b|\bнет (?:информации|данных|сведений|ответа)\b",
        r"\bза рамк\w+\b|\bответить нельзя\b|\bданных\b.*\bнедостаточно\b|\bобратитесь к\b|\bне знаю\b|\bне располагаю\b",
        # Turned down without "cannot"
        r"\bi(?:['’]d| would) (?:rather|prefer) not\b|\bnot something i(?: am|['’]m| can| could)\b|\bno way (?:of knowing|to know|for me)\b|\bas an? (?:ai|language model|assistant)\b|\bi won['’]t be able\b|\bi am afraid i\b|\bi['’]m afraid (?:i|that)\b|\bno comment\b",
        # Chinese, Japanese, Korean, Arabic
        r"无法|不能(?:回答|提供)|抱歉|对不起|不知道|没有(?:相关|找到)|申し訳|お答えできません|(?:わ|分)かりません|記載(?:され|が)(?:ていません|ありません)|죄송|답변할 수 없|알 수 없|모르겠|لا (?:أستطيع|يمكنني|أعرف|أعلم)|آسف|عذرا",
        # German, Spanish, Italian, Portuguese, French
        r"\b(?:kann|können|darf)\b.*\bnicht\b.*\b(?:beantworten|antworten|helfen|sagen|finden)\b|\bweiß (?:ich )?(?:es )?nicht\b|\bleider\b.*\b(?:nicht|kein\w*)\b|\bkeine (?:angaben?|informationen?|daten)\b|\btut mir leid\b|\bnicht (?:beschrieben|erwähnt|enthalten|angegeben)\b",
        r"\bno (?:puedo|podemos)\b.*\b(?:responder|contestar|ayudar|encontrar|decir)\b|\blo siento\b|\bno (?:sé|se menciona|se describe|figura|aparece|consta|hay (?:información|datos))\b|\bel manual no\b",
        r"\bnon (?:posso|possiamo|sono in grado|lo so|è (?:indicato|descritto|riportato))\b|\bmi dispiace\b|\bnon ho (?:informazioni|dati)\b",
        r"\bnão (?:posso|podemos|consigo|sei|consta|é (?:indicado|descrito))\b|\b(?:desculpe|lamento|sinto muito)\b|\bnão (?:há|tenho) (?:informaç|dados)",
        r"\bne (?:peux|puis|pouvons)\b.*\b(?:répondre|aider|trouver|dire)\b|\bje ne sais pas\b|\bdésolé\w*\b|\baucune (?:information|donnée)\b",
    )
]
#: Sentences that say nothing by themselves.
_PREAMBLE = [
    re.compile(p, re.I)
    for p in (
        r"^(?:thank|thanks)\b|^спасибо\b|^danke\b|^gracias\b|^merci\b|^hello\b|^здравствуйте\b",
        r"^i (?:have )?(?:looked|read|searched|checked|reviewed|went|gone)\b[^.]*\b(?:pages?|manual|excerpts?|fragments?|documents?|documentation|material|text)\b",
        r"^я (?:просмотрел\w*|прочитал\w*|проверил\w*|изучил\w*|посмотрел\w*)\b[^.]*$",
        r"^(?:to be clear|уточню сразу|good question|хороший вопрос)[.:]?$",
        r"\b(?:please )?(?:ask|contact|consult|call) (?:a|an|your|the)\b[^.]*\b(?:dealer|technician|service|manufacturer)\b|\bобратитесь\b|\blieber\b.*\bhändler\b",
        r"\b(?:let me know|anything else|something else)\b|\bчем-нибудь ещё\b|\bесли (?:появятся|возникнут) вопросы\b",
    )
]
_STOP = {
    "en": set("the of and to is it in for with that this from at on be are was by an as or not before until must take use which when has have".split()),
    "de": set("der die das und ist nicht mit von den dem ein eine einen für auf bei nach muss wird bitte wieder bis zum zur dann im siehe auch wert lautet zuerst danach".split()),
    "es": set("el la los las y es de del que para con una un por se no al en debe luego después primero hasta vea también pieza use dato su lo".split()),
    "it": set("il lo la gli le e è di del della che per con una un non si nel al dopo prima fino anche sono deve questo quando valore olio pompa".split()),
    "pt": set("o os a as e é de do da dos das que para com uma um não se no na ao depois antes até também são deve este quando valor óleo bomba".split()),
    "fr": set("le la les et est de des du que pour avec une un par se ne pas au aux en doit puis après il elle dans sur".split()),
}
#: Languages of each of these words.
_TOLD = {w: tuple(k for k, v in _STOP.items() if w in v) for v in _STOP.values() for w in v}
#: Scripts that tell the language by themselves.
_SCRIPTS = (("ja", re.compile("[\u3040-\u30ff]")), ("ko", re.compile("[\uac00-\ud7af\u1100-\u11ff]")), ("zh", re.compile("[\u4e00-\u9fff]")), ("ar", re.compile("[\u0600-\u06ff]")), ("he", re.compile("[\u0590-\u05ff]")), ("el", re.compile("[\u0370-\u03ff]")), ("hi", re.compile("[\u0900-\u097f]")), ("th", re.compile("[\u0e00-\u0e7f]")), ("ka", re.compile("[\u10a0-\u10ff]")), ("hy", re.compile("[\u0530-\u058f]")))
_OTHER = re.compile("[\u0370-\u03ff\u0530-\u06ff\u0900-\u0eff\u10a0-\u11ff\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")
_MARKED = {"it": re.compile("[èìò]"), "pt": re.compile("[ãõ]"), "de": re.compile("[äöüß]"), "es": re.compile("[ñ¿¡áíóú]"), "fr": re.compile("[àâçèêëîïôùûœ]")}
_FUNCTION = set(
    "a an the of and or to in on at by for with from into over under if when which than as is are was be not cannot can must before after between until while but so then because without during per via about against and/or "
    "и или а но в во на к ко у о об от до за из с со по при под над без для через если когда что чтобы который которая которое которые не ни как так то же бы ли либо чем между перед после пока также "
    "der die das und oder mit von den dem ein eine einen für auf bei nach zum zur im am wenn dass bis vor nicht "
    "el la los las y o de del que para con una un por al en si cuando hasta sin no se su".split()
)
_ITEM = re.compile(r"^\s*(?:\d+[.)]|[-*•–])\s+\S")
_COUNTED = re.compile(r"\b(\d{1,3})\s+(?:\w+\s+)?(?:шаг\w*|действи\w*|пункт\w*|операци\w*|steps?|items?|points?|actions?|schritte?n?|punkte?n?|pasos?|puntos?|étapes?)\s*:", re.I)
_CLOSED = re.compile(r"[.!?…。！？][\"'”»)\]*]*$")
_PAIRS = (("(", ")"), ("[", "]"), ("«", "»"), ("“", "”"), ("„", "“"), ("{", "}"))


def language(text: str, least: int = 2) -> str | None:
    """The language of a text's words; figures, units, codes and citations have none. None where it can't be told."""
    bare = _DIGITS.sub(" ", _CITATION.sub(" ", _TAG.sub(" ", text)))
    words = [w for w in (x.lower() for x in _WORD.findall(bare)) if w not in _UNITS and len(w) > 1 or w in ("y", "a", "в", "и", "с", "к", "у", "о")]
    if not words:
        return None
    letters = "".join(words)
    strange = _OTHER.findall(letters)
    if len(strange) * 3 > len(letters):
        # Kana tell Japanese from Chinese, so they count as all its signs.
        return next((k for k, m in _SCRIPTS if m.search(letters) and (k in ("ja", "zh", "ko") or len(m.findall(letters)) * 2 > len(strange))), None)
    cyrillic = sum("\u0400" <= w[0] <= "\u04ff" for w in words)
    if cyrillic * 2 > len(words):
        return "ru" if cyrillic >= 1 else None
    latin = [w for w in words if not "\u0400" <= w[0] <= "\u04ff"]
    if len(latin) < least:
        return None
    score = dict.fromkeys(_STOP, 0)
    for w in latin:
        for k in _TOLD.get(w, ()):
            score[k] += 1
    if not letters.isascii():
        for w in latin:
            if not w.isascii():
                for k, m in _MARKED.items():
                    score[k] += bool(m.search(w))
    best = max(score, key=lambda k: (score[k], k == "en", -_ORDER[k]))
    return best if score[best] else ("en" if len(latin) >= 3 else None)


#: Of equal scores the language of the manuals goes first.
_ORDER = {k: i for i, k in enumerate(("en", "de", "es", "fr", "it", "pt"))}


@lru_cache(maxsize=10_000)
def _asked(question: str) -> str | None:
    """The language of a question; questions come again and again."""
    return language(question)


_ENDS = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|(?<=[。！？])|\n+")
#: A sentence that declines holds one of these.
_NO = re.compile(r"n['’]t\b|\bnot?\b|cannot|unable|declin|refus|sorry|nothing|outside|beyond|unsafe|rather|prefer|afraid|as an? |\bне|\bнет\b|нич|затрудн|отказ|рамк|обратитесь|nicht|kein|leid|\bsé\b|siento|\bnon\b|dispiace|não|desculpe|lamento|sinto|\bne\b|désol|aucune|[^\x00-\u024f\u0400-\u04ff\u2000-\u22ff]", re.I)


def _sentences(text: str) -> list[str]:
    parts = _ENDS.split(text)
    out = []
    for p in parts:
        p = re.sub(r"^\s*(?:\d+[.)]|[-*•])\s+", "", p).strip()
        p = re.sub(r"^(?:to be clear|уточню сразу|in short|коротко)\s*:\s*", "", p, flags=re.I)
        if _TOKEN.search(p):
            out.append(p)
    return out


def _only_declines(text: str) -> bool:
    refused = False
    for s in _sentences(text):
        if _NO.search(s) and any(p.search(s) for p in _REFUSAL):
            # A sentence that declines and yet goes on to give the matter is an answer.
            if re.search(r"\b(?:yet|but|however|зато|но|однако|aber|pero)\b.+", s, re.I) or re.search(r"\d+(?:[.,]\d+)?\s?(?:kPa|psi|bar|rpm|mm|L|kW|Hz|mV|N·m|°C|кПа|бар|мм|л|кВт|Н·м|об/мин)", s):
                return False
            refused = True
        elif not any(p.search(s) for p in _PREAMBLE):
            return False
    return refused


def _gives_back(question: str, answer: str) -> bool:
    q = {w.lower() for w in _TOKEN.findall(question)}
    a = [w.lower() for w in _TOKEN.findall(_FRAME.sub(" ", _LABEL.sub(" ", answer)))]
    if len(q) < 3 or not a:
        return False
    own = set(a)
    return len(own & q) >= 0.75 * len(q) and len(own - q) <= max(1, len(q) // 8) and not any(any(c.isdigit() for c in w) for w in own - q)


def _masked(text: str) -> list[str]:
    return _MASKS.findall(_DIGITS.sub("0", text.lower()))


def _bare(text: str) -> bool:
    """Whether a text holds values and codes only."""
    rest = _DIGITS.sub(" ", text)
    return bool(re.search(r"\d", text)) and not [w for w in _WORD.findall(rest) if w.lower() not in _UNITS and len(w) > 1]


def _stops(answer: str) -> tuple[bool, str | None]:
    """``(whether the answer stops early, the tail of its last list item where that isn't plain)``."""
    body = re.sub(r"(?:\s*\[[^\[\]\n]*\d[^\[\]\n]*\])+\s*$", "", answer).rstrip()
    if re.search(r"\[[^\]]*$", answer):
        return True, None
    for a, b in _PAIRS[:1] + _PAIRS[2:3]:
        if body.count(a) > body.count(b):
            return True, None
    if body.count('"') % 2 or body.count("“") > body.count("”") + body.count("„"):
        return True, None
    lines = [x for x in body.split("\n") if x.strip()]
    if not lines:
        return False, None
    items = sum(bool(_ITEM.match(x)) for x in lines)
    counted = _COUNTED.search(body)
    if counted and items < int(counted.group(1)) <= 100:
        return True, None
    last = lines[-1].rstrip()
    if re.search(r"[,:;–—(\-]$|\.\.\.$|…$", last):
        return True, None
    if _CLOSED.search(last):
        words = _WORD.findall(last)
        return bool(words) and words[-1].lower() in ("the", "and", "or", "of", "и", "или") and last.endswith("."), None
    words = _TOKEN.findall(last)
    if words and words[-1].lower() in _FUNCTION:
        return True, None
    if _ITEM.match(last):
        text = re.sub(r"^\s*(?:\d+[.)]|[-*•–])\s+", "", last)
        tail = _masked(text)[-2:]
        if not tail:
            return True, None
        return False, " ".join(tail) if len(tail) == 2 else None
    return not _bare(last), None


def _grams(answer: str) -> tuple[list[str], list[str]]:
    """Pairs of words with which finished sentences and list items end, and pairs that go on."""
    ends, mids = [], []
    body = _CITATION.sub(" ", answer)
    lines = [x for x in body.split("\n") if x.strip()]
    for i, line in enumerate(lines):
        line = _BULLET.sub("", line)
        parts = _STOPPED.split(line.strip())
        for j, p in enumerate(parts):
            t = _masked(p)
            finished = bool(_CLOSED.search(p)) or j < len(parts) - 1 or i < len(lines) - 1
            if len(t) > 1:
                mids += [f"{a} {b}" for a, b in zip(t[:-2], t[1:-1])]
                (ends if finished else []).append(f"{t[-2]} {t[-1]}")
    return ends, mids


JUDGED = T.StructType(
    [
        T.StructField("defects", T.ArrayType(T.StringType())),
        T.StructField("tail", T.StringType()),
        T.StructField("ends", T.ArrayType(T.StringType())),
        T.StructField("mids", T.ArrayType(T.StringType())),
    ]
)


def judge(question: str | None, answer: str | None, may_refuse: bool) -> tuple[list[str], str | None, list[str], list[str]]:
    """Every defect the rules see, in their order, the tail that the corpus must decide on, and word pairs for it."""
    question, answer = question or "", answer or ""
    plain = _TAG.sub(" ", _CITATION.sub(" ", answer))
    core = _LABEL.sub(" ", plain)
    mark = _MARKS.sub(" ", core).strip().lower() if len(core) < 200 else ""
    empty = not _TOKEN.search(core) or mark in _NOTHING
    ends, mids = ([], []) if empty else _grams(answer)
    found = ["empty"] if empty else []
    if _gives_back(question, plain):
        found.append("copied_question")
    declines = _only_declines(core)
    if declines and not may_refuse:
        found.append("refusal")
    asked, told = _asked(question), language(core, 3)
    if asked and told and asked != told:
        found.append("wrong_language")
    stops, tail = _stops(answer)
    if stops:
        found.append("truncated")
    # Marks that leave a citation alone empty aren't cut tails as well.
    return found, None if stops or empty else tail, ends, mids


def defects(pairs: DataFrame, key: str = "result_id", question: str = "question", answer: str = "answer", may_refuse: str = "may_refuse") -> DataFrame:
    """All pairs with their defects: ``(key, defects, defect)``; ``defects`` lists every rule that fired, in the order of
    ``KINDS``, and ``defect`` is the first, or null for a sound pair.

    * A null or blank answer is ``empty``; a null question has no language and nothing to give back. A null ``may_refuse``
      counts as false. Rows that repeat a key are judged each on its own; an empty table gives an empty result.
    * Whole texts are read. Word pairs are counted over all answers, with partial sums before the shuffle; only distinct
      pairs are joined, so frequent ones make no hot keys.
    """

    def run(cols: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for q, a, m in cols:
            yield pd.DataFrame([judge(x, y, bool(z)) for x, y, z in zip(q, a, m)], columns=JUDGED.names)

    udf = F.pandas_udf(run, JUDGED)
    rows = pairs.select(F.col(f"`{key}`").alias("_k"), udf(F.col(f"`{question}`"), F.col(f"`{answer}`"), F.coalesce(F.col(f"`{may_refuse}`"), F.lit(False))).alias("_j"))
    rows = materialise(rows.select("_k", "_j.*"), "judged")
    seen = rows.select(F.explode("ends").alias("g"), F.lit(1).alias("e")).unionByName(rows.select(F.explode("mids").alias("g"), F.lit(0).alias("e")))
    seen = seen.groupBy("g").agg(F.max("e").alias("e"), F.min("e").alias("m")).select("g", F.substring_index("g", " ", 1).alias("g1"), (F.col("e") == 1).alias("ends"), (F.col("m") == 0).alias("goes_on"))
    tails = rows.filter("tail is not null").groupBy("tail").agg(F.count("*").alias("n")).withColumn("t1", F.substring_index("tail", " ", 1))
    met = tails.join(seen, (F.col("t1") == F.col("g1")) & F.col("g").startswith(F.col("tail")))
    cut = met.groupBy("tail").agg(F.max((F.col("g") == F.col("tail")) & F.col("ends")).alias("whole"), F.max((F.col("g") != F.col("tail")) | F.col("goes_on")).alias("more"))
    cut = cut.filter("more and not whole").select("tail", F.lit(True).alias("cut"))
    out = rows.join(cut, "tail", "left").withColumn("defects", F.when(F.col("cut"), F.array_append("defects", "truncated")).otherwise(F.col("defects")))
    return out.select(F.col("_k").alias(key), "defects", F.try_element_at("defects", F.lit(1)).alias("defect"))
