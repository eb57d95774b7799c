"""Problem 1 on languages, scripts and refusals that the test tables don't have, and every defect of a pair."""

import pytest

from foliograph.llm.pairs import judge, language

Q = "Which torque applies to the bolt?"


@pytest.mark.parametrize(
    "answer, want",
    [
        ("これは日本語の回答です。", ["wrong_language"]),
        ("螺栓的扭矩是四十牛米。", ["wrong_language"]),
        ("هذه هي الإجابة على السؤال.", ["wrong_language"]),
        ("La valvola è chiusa dopo il controllo della pompa.", ["wrong_language"]),
        ("A válvula não é aberta até o fim do teste da bomba.", ["wrong_language"]),
        ("抱歉，我无法回答这个问题。", ["refusal", "wrong_language"]),
        ("Mi dispiace, non posso rispondere.", ["refusal", "wrong_language"]),
        ("Lamento, não posso responder.", ["refusal", "wrong_language"]),
        ("I'd rather not discuss that.", ["refusal"]),
        ("That's not something I'm able to share.", ["refusal"]),
        ("As an AI language model, I have no way of knowing.", ["refusal"]),
        ("Answer:", ["empty", "truncated"]),
        ("The bolt takes 40 N·m.", []),
        ("40 N·m", []),
    ],
)
def test_defects(answer, want):
    assert judge(Q, answer, False)[0] == want


def test_scripts():
    assert [language(t) for t in ("질문에 대한 답변입니다", "Η απάντηση είναι εδώ", "यह उत्तर है", "Это ответ", "12 kPa", "")] == ["ko", "el", "hi", "ru", None, None]


def test_long_runs_without_digits_take_linear_time():
    assert judge(Q, "x" * 300_000, False)[0] in ([], ["truncated"])
