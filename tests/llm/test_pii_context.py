"""Problem 8: what stands around a mention, on sentences that are in no table."""

import time

import pytest

from foliograph.llm import pii

NONE: set = set()


def found(text):
    return {(k, f) for k, _, _, f in pii.find(pii.tagger(), [text])[0]}


@pytest.mark.parametrize(
    "text, kind, begin, want",
    [
        # Ships, machines, parts, headings and pronouns are no cases.
        ("The crew of MV Golden Plover rang us.", "name", "Golden Plover", None),
        ("Экипаж MV Golden Plover сообщил о течи.", "name", "Plover", None),
        ("The engine counter 0047110815 was read.", "id_number", "0047110815", None),
        ("Motor QK447120: sin ruido.", "id_number", "QK447120", None),
        ("Seal numbers 611-2040, 902-1177 were cut.", "phone", "611-2040, 902-1177", None),
        ("Glow Plug Harness - Inspect\nLet it cool.", "name", "Glow Plug Harness", None),
        ("We told nobody.", "name", "We", None),
        ("Der Ventildeckel ist dicht.", "name", "Der Ventildeckel", None),
        ("Слесарь бережно снял крышку.", "name", "бережно", None),
        # What is one stays one.
        ("care of A. Pemberley. Thanks", "name", "A. Pemberley", "A. Pemberley"),
        ("ask capt. pemberley for it", "name", "pemberley", "pemberley"),
        # A mention ends where it ends, and begins where it begins.
        ("id=ABC771204X 3. Drain the tank.", "id_number", "ABC771204X 3", "ABC771204X"),
        ("Bitte an Ahornweg 7, 20095 Hamburg liefern.", "address", "Ahornweg 7, 20095 Hamburg liefern", "Ahornweg 7, 20095 Hamburg"),
        ("Bill to 12 Alder Street, Boston 02108. 2. Oil the rail.", "address", "12 Alder Street, Boston 02108. 2", "12 Alder Street, Boston 02108"),
        ("Bill to 12 Alder Street, Boston 02108", "address", "12 Alder Street, Boston", "12 Alder Street, Boston 02108"),
        ("From: J. Pemberley <pemberley88[at]mail.test>", "email", "88[at]mail.test", "pemberley88[at]mail.test"),
        ("Yours,\nPEMBERLEY, Joan\nFitter", "name", "PEMBERLEY,", "PEMBERLEY, Joan"),
    ],
)
def test_a_mention_is_settled_by_what_stands_around_it(text, kind, begin, want):
    a = text.index(begin)
    seen = pii.settle(text, a, a + len(begin), kind)
    if want is None:
        assert seen is None
    else:
        assert seen[2] == kind
        a, b = pii.tidy(text, *seen)
        assert text[a:b] == want


def test_an_insurance_number_is_no_phone():
    text = "док=112-233-445 95 Двигатель"
    assert pii.settle(text, 4, 15, "phone") == (4, 18, "id_number")


@pytest.mark.parametrize(
    "text, want",
    [
        ("Пропуск выдан, ИНН 000012345678.", ("id_number", "000012345678")),
        ("Pump Cover - Remove Joan Pemberley (joan.pemberley@mail.test) called.", ("name", "Joan Pemberley")),
        ("from: joan pemberley <pemberley_j4@mail.test>", ("name", "joan pemberley")),
        ("Oil Pan - Drain Dear Ms Pemberley, the pump has left.", ("name", "Pemberley")),
    ],
)
def test_forms_that_prove_a_mention(text, want):
    assert want in found(text)


def test_ships_are_not_found_and_the_rest_stays_readable():
    text = "Crew of MV Golden Plover found the ring worn.\nThe tug Plover left."
    assert found(text) == NONE


def test_a_long_line_takes_time_in_proportion():
    text = "Mr Pemberley signed; Dear Ms Pemberley, ИНН 000012345678 and MV Golden Plover, "
    pii.find(pii.tagger(), [text])

    def seconds(n):
        began = time.process_time()
        pii.find(pii.tagger(), [text * n])
        return time.process_time() - began

    assert seconds(4000) < 12 * max(seconds(1000), 0.1)
